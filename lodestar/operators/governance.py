"""Tables in provenance tiers, their packing, and audits that return violations."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator

import pyarrow as pa
import pyarrow.fs as pafs
import pyarrow.parquet as pq
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

TIERS = ("native", "read", "derived", "agent", "expert")


def tier_violations(df: DataFrame, table: str, tier: str) -> DataFrame:
    """(table, problem, n) of rows whose tier column is missing or not the table's own."""
    bad = F.when(F.col("tier").isNull(), "no tier").when(F.col("tier") != tier, F.concat(F.lit("tier "), F.col("tier")))
    return df.select(F.lit(table).alias("table_name"), bad.alias("problem")).where("problem is not null").groupBy("table_name", "problem").agg(F.count("*").alias("n"))


def write_checked(df: DataFrame, path: str, tier: str, columns: list[str], mode: str = "overwrite") -> None:
    """Write only declared columns of the right tier; anything else is refused before a byte is written."""
    extra = sorted(set(df.columns) - set(columns) - {"tier"})
    if tier not in TIERS or extra:
        raise ValueError(f"refused: tier {tier!r}, undeclared columns {extra}")
    if "tier" in df.columns and not df.where(~F.col("tier").eqNullSafe(F.lit(tier))).isEmpty():
        raise ValueError(f"refused: rows of another tier than {tier}")
    df.withColumn("tier", F.lit(tier)).select(*columns, "tier").write.mode(mode).parquet(path)


def replace_keys(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """Idempotent upsert: rows of `old` whose key is in `new` give way."""
    return old.join(new.select(*keys).distinct(), keys, "left_anti").unionByName(new)


def insert_absent(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """`old` and those rows of `new` whose key it lacks."""
    return old.unionByName(new.join(old.select(*keys).distinct(), keys, "left_anti"))


def replace_prefix(old: DataFrame, key: str, prefix: str, new: DataFrame) -> DataFrame:
    """Rows of `old` whose key starts with the prefix give way to `new`."""
    return old.where(~F.col(key).startswith(prefix) | F.col(key).isNull()).unionByName(new)


def snapshot(tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, n, content): rows, and a sum of row hashes that no order of rows changes.

    A row is hashed over the hashes of its cells, an unknown cell over a mark that no hash is, so neither nulls nor separators can
    make two rows alike.
    """
    out = None
    for name, df in sorted(tables.items()):
        row = F.md5(F.concat_ws(",", *(F.coalesce(F.md5(F.col(f"`{c}`").cast("string").cast("binary")), F.lit("-")) for c in df.columns)).cast("binary"))
        content = F.sum(F.conv(F.substring(row, 1, 12), 16, 10).cast("decimal(38,0)")).cast("string")
        one = df.agg(F.count("*").alias("n"), content.alias("content")).select(F.lit(name).alias("table_name"), "n", "content")
        out = one if out is None else out.unionByName(one)
    return out


def verify(pinned: DataFrame, tables: dict[str, DataFrame]) -> DataFrame:
    """(table_name, change) of the tables that are no longer what a pinned snapshot() says; no rows if all are."""
    return changed(pinned, snapshot(tables))


def changed(before: DataFrame, after: DataFrame) -> DataFrame:
    """(table_name, change) between two snapshots: added, removed or changed."""
    b, a = before.select("table_name", F.struct("n", "content").alias("b")), after.select("table_name", F.struct("n", "content").alias("a"))
    change = F.when(F.col("b").isNull(), "added").when(F.col("a").isNull(), "removed").when(F.col("a") != F.col("b"), "changed")
    return b.join(a, "table_name", "full").select("table_name", change.alias("change")).where("change is not null")


def orphans(child: DataFrame, key: str, parent: DataFrame, parent_key: str, name: str) -> DataFrame:
    """(reference, key) of references that resolve to nothing."""
    c = child.where(F.col(key).isNotNull()).select(F.col(key).alias("k")).distinct()
    return c.join(parent.select(F.col(parent_key).alias("k")).distinct(), "k", "left_anti").select(F.lit(name).alias("reference"), F.col("k").cast("string").alias("key"))


def measured(spark: SparkSession, folder: str, table: str) -> list[tuple[str, int, str]]:
    """(file, rows, sha256) of a table's files in key order, read by the tasks; the driver gets this list only."""
    fs, root = pafs.FileSystem.from_uri(folder)
    names = sorted(f.base_name for f in fs.get_file_info(pafs.FileSelector(f"{root}/{table}")) if f.base_name.endswith(".parquet"))
    if not names:
        return []

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        store, top = pafs.FileSystem.from_uri(folder)
        for b in batches:
            files = b.column(0).to_pylist()
            found = [(f, _rows(store, f"{top}/{table}/{f}"), _digest(store, f"{top}/{table}/{f}")) for f in files]
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in found]) for k in range(3)], names=["file", "rows", "sha256"])

    files = spark.createDataFrame([(n,) for n in names], "file string").repartition(min(len(names), spark.sparkContext.defaultParallelism * 4))
    return sorted(tuple(r) for r in files.mapInArrow(each, "file string, rows long, sha256 string").collect())


def pack(tables: dict[str, DataFrame], keys: dict[str, list[str]], folder: str) -> dict:
    """Write each table sorted by key, zstd-compressed, with a manifest of rows and file digests; returns the manifest.

    Files are written by Spark's tasks in range partitions, so a large table is many files in key order. The address is the
    SHA-256 of the tables' names, rows and file digests in that order, so equal data in equal files has one address
    whatever the files are called. A row that repeats a key stands by the hash of all its columns.
    """
    fs, root = pafs.FileSystem.from_uri(folder)
    manifest, content = {}, []
    for name, df in sorted(tables.items()):
        order = [*keys[name], F.xxhash64(*df.columns)]
        df.repartitionByRange(*keys[name]).sortWithinPartitions(*order).write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        files = measured(df.sparkSession, folder, name)
        manifest[name] = {"rows": sum(f[1] for f in files), "files": {f[0]: f[2] for f in files}}
        content.append([name, manifest[name]["rows"], [f[2] for f in files if f[1]]])
    with fs.open_output_stream(f"{root}/manifest.json") as out:
        out.write(json.dumps(manifest, sort_keys=True).encode())
    return manifest | {"address": hashlib.sha256(json.dumps(content).encode()).hexdigest()}


def _rows(fs: pafs.FileSystem, path: str) -> int:
    """Rows by the footer; -1 for a file that is no longer Parquet."""
    try:
        return pq.read_metadata(path, filesystem=fs).num_rows
    except pa.ArrowInvalid:
        return -1


def _digest(fs: pafs.FileSystem, path: str) -> str:
    h = hashlib.sha256()
    with fs.open_input_stream(path, compression=None) as f:
        while block := f.read(1 << 20):
            h.update(block)
    return h.hexdigest()


def unpack(spark: SparkSession, folder: str) -> dict[str, DataFrame]:
    """The tables of a pack; refused if a digest or a row count differs from the manifest."""
    fs, root = pafs.FileSystem.from_uri(folder)
    with fs.open_input_stream(f"{root}/manifest.json") as f:
        manifest = json.loads(f.read())
    out = {}
    for name, told in manifest.items():
        files = measured(spark, folder, name)
        changed = sorted(set(told["files"].items()) ^ {(f[0], f[2]) for f in files})
        if changed:
            raise ValueError(f"{name}/{changed[0][0]} is not what was packed")
        if sum(f[1] for f in files) != told["rows"]:
            raise ValueError(f"{name} has another number of rows than was packed")
        out[name] = spark.read.parquet(f"{folder}/{name}")
    return out
