"""Append-only logs: the last line of a key wins, in batch and as a stream."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def read_log(spark: SparkSession, path: str, schema: str, stream: bool = False, files: int | None = None) -> DataFrame:
    """JSON lines; a line that does not parse is kept with its text in `_corrupt`, not dropped. A stream takes up to `files` files a batch."""
    reader = (spark.readStream if stream else spark.read).schema(f"{schema}, _corrupt string")
    if stream and files is not None:
        reader = reader.option("maxFilesPerTrigger", files)
    return reader.option("columnNameOfCorruptRecord", "_corrupt").option("mode", "PERMISSIVE").json(path)


def last_wins(log: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key by the order columns."""
    rest = [c for c in log.columns if c != key]
    return log.groupBy(key).agg(F.max_by(F.struct(*rest), F.struct(*order)).alias("r")).select(key, "r.*")


def spend(log: DataFrame, family: str, amount: str, corrupt: str | None = None) -> DataFrame:
    """Totals by family; one unreadable line makes every total unknown (NaN), so that a budget check refuses."""
    total = F.sum(amount)
    if corrupt is None:
        return log.groupBy(family).agg(total.alias("total"), F.count("*").alias("n"))
    broken = log.agg(F.count_if(F.col(corrupt).isNotNull()).alias("__broken"))
    out = log.where(F.col(corrupt).isNull()).groupBy(family).agg(total.alias("__t"), F.count("*").alias("n")).crossJoin(F.broadcast(broken))
    return out.select(family, F.when(F.col("__broken") > 0, F.lit(float("nan"))).otherwise(F.col("__t")).alias("total"), "n")


def windowed_counts(events: DataFrame, time: str, by: str, size: str, slide: str | None = None, late: str | None = None) -> DataFrame:
    """Counts and sums in tumbling or sliding windows; `late` sets a watermark for streams. An extension for event streams."""
    if late is not None:
        events = events.withWatermark(time, late)
    window = F.window(time, size, slide) if slide else F.window(time, size)
    out = events.groupBy(window.alias("w"), by).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(F.col("w.start").alias("start"), by, "n", "total")


def session_counts(events: DataFrame, time: str, by: str, gap: str, late: str | None = None) -> DataFrame:
    """Sessions by gap of inactivity."""
    if late is not None:
        events = events.withWatermark(time, late)
    out = events.groupBy(F.session_window(time, gap).alias("w"), by).agg(F.count("*").alias("n"))
    return out.select(by, F.col("w.start").alias("start"), F.col("w.end").alias("end"), "n")


def run_once(df: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """Process what a stream has now into Parquet files and stop; run again, it goes on where it stopped."""
    query = df.writeStream.outputMode(mode).format("parquet").option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


def fold_state(stream: DataFrame, folder: str, part: Callable[[DataFrame], DataFrame], merge: Callable[[DataFrame], DataFrame]) -> str:
    """Fold a stream into a table, one version for each batch; returns the path of the last.

    `part` sums up a batch, `merge` the union of the last version and that. A version is named by its batch, so a batch that is
    repeated after a failure starts from the version before it, and a restarted run goes on from what is there.
    """
    spark = stream.sparkSession
    jvm = spark.sparkContext._jvm
    path = jvm.org.apache.hadoop.fs.Path(folder)
    store = path.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())

    def version(below: int | None) -> str | None:
        """The newest complete version, of a batch before `below`."""
        found = [s.getPath().getName() for s in store.listStatus(path)] if store.exists(path) else []
        ids = [int(n.removeprefix("batch-")) for n in found if n.startswith("batch-") and store.exists(jvm.org.apache.hadoop.fs.Path(f"{folder}/{n}/_SUCCESS"))]
        ids = [i for i in ids if below is None or i < below]
        return f"{folder}/batch-{max(ids)}" if ids else None

    def fold(batch: DataFrame, n: int) -> None:
        now, old = part(batch), version(n)
        if old is not None:
            now = merge(batch.sparkSession.read.schema(now.schema).parquet(old).unionByName(now))
        now.write.mode("overwrite").parquet(f"{folder}/batch-{n}")

    stream.writeStream.foreachBatch(fold).option("checkpointLocation", f"{folder}-log").trigger(availableNow=True).start().awaitTermination()
    return version(None)
