"""Helpers that several training-data operators share."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.session import cut


def split_of(doc_id: Column) -> Column:
    """crc32 of the id as text, modulo 4; remainder 2 is the held-out part. A null id counts as the text ''."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % 4


def quoted(name: str) -> str:
    """A column name for select(), dots and all."""
    return "`" + name.replace("`", "``") + "`"


def nest(docs: DataFrame, *own: str) -> DataFrame:
    """The columns `own` and one struct `rest` with all others, so that no name an operator adds can clash with theirs."""
    others = [F.col(quoted(c)) for c in docs.columns if c not in own]
    return docs.select(*(F.col(quoted(c)) for c in own), *([F.struct(*others).alias("rest")] if others else []))


def unnest(df: DataFrame, like: DataFrame, *own: str) -> DataFrame:
    """The columns of `like` in their order from a frame that nest() made (and an operator added to)."""
    return df.select(*(F.col(quoted(c)) if c in own else F.col("rest").getField(c).alias(c) for c in like.columns))


def tasks_for(spark: SparkSession, size: int, items: int, per_task: int = 16 << 20) -> int:
    """How many tasks read `items` files or ranges of `size` bytes in all: all cores if there is enough, `per_task` bytes each beyond.

    Given as a number to repartition(), which adaptive execution leaves alone: it would judge by the size of the paths.
    """
    return max(1, min(items, max(spark.sparkContext.defaultParallelism, -(-size // per_task))))


def gathered(df: DataFrame, rows: int, per_task: int = 500_000) -> DataFrame:
    """`df` of about `rows` small rows in no more tasks, and so files, than these ask for; at least as many as there are cores."""
    return df.coalesce(max(df.sparkSession.sparkContext.defaultParallelism, -(-rows // per_task)))


def join_hot(big: DataFrame, small: DataFrame, keys: list[str], how: str = "inner", hot: int = 100_000) -> DataFrame:
    """`big` joined (inner or left) to `small`, which has one row for a key; both are written tables.

    A key of more than `hot` rows (and more than one in 10,000 of all) would fill one task of a shuffle. There are 10,000 such keys
    at most, so their rows of `small` are sent to every task; all other keys meet by the shuffle.
    """
    least = max(hot, big.count() // 10_000)
    sizes = big.groupBy(*keys).agg(F.count("*").alias("__n")).where(F.col("__n") > least).select(*keys)
    sizes = cut(sizes, "hot-keys")
    if sizes.isEmpty():
        return big.join(small, keys, how)
    there = F.broadcast(sizes)
    often = big.join(there, keys, "left_semi").join(F.broadcast(small.join(there, keys, "left_semi")), keys, how)
    return often.unionByName(big.join(there, keys, "left_anti").join(small.join(there, keys, "left_anti"), keys, how))


def strings(col: pa.Array, step: int = 64) -> Iterator[str | None]:
    """The values of a string column, few of them at a time in memory besides the column itself."""
    for at in range(0, len(col), step):
        yield from col.slice(at, step).to_pylist()


def utf8_of(col: pa.Array, step: int = 64) -> Iterator[bytes]:
    """A string column as UTF-8 bytes, null as empty, few at a time."""
    for at in range(0, len(col), step):
        for b in col.slice(at, step).cast(pa.binary()).to_pylist():
            yield b"" if b is None else b


def runs(batches: Iterator[pa.RecordBatch], keys: list[str], rows: int = 65536, size: int = 32 << 20) -> Iterator[pa.Table]:
    """Regroup a stream sorted by `keys` into tables that never split a run of equal keys.

    A table holds at least `rows` rows or `size` bytes unless the stream ends; what is carried over is one run.
    """

    def last_start(t: pa.Table) -> int:
        same = np.ones(t.num_rows, bool)
        for k in keys:
            v = t.column(k).to_numpy()
            same &= v == v[-1]
        return t.num_rows - int(np.argmin(same[::-1])) if not same.all() else 0

    held: list[pa.RecordBatch] = []
    count = weight = 0
    for b in batches:
        if b.num_rows:
            held.append(b)
            count, weight = count + b.num_rows, weight + b.nbytes
        if count >= rows or weight >= size:
            t = pa.Table.from_batches(held).combine_chunks()
            at = last_start(t)
            if at:
                yield t.slice(0, at)
            rest = t.slice(at).combine_chunks()
            held, count, weight = rest.to_batches(), rest.num_rows if at else 0, rest.nbytes if at else 0
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def pairs_in_runs(group: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Index pairs (i < j) within runs of equal values of a sorted array, a bounded number at a time.

    Nothing leaves the task: callers test the pairs and emit a forest or counts.
    """
    n = len(group)
    if n < 2:
        return
    starts = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
    sizes = np.diff(np.r_[starts, n])
    small = np.repeat(sizes <= 64, sizes)
    lag = 1
    while True:
        i = np.flatnonzero((group[:-lag] == group[lag:]) & small[:-lag]) if lag < n else np.empty(0, np.int64)
        if not len(i):
            break
        yield i, i + lag
        lag += 1
    for s, m in zip(starts[sizes > 64], sizes[sizes > 64], strict=True):
        step = max(1, 2_000_000 // int(m))
        for a in range(0, int(m), step):
            i, j = np.meshgrid(np.arange(a, min(a + step, m)), np.arange(a, m), indexing="ij")
            keep = i < j
            yield s + i[keep], s + j[keep]


def forest(n: int, a: np.ndarray, b: np.ndarray, root: np.ndarray | None = None) -> np.ndarray:
    """Labels 0..n-1 after joining the pairs (a, b) to the labelling `root`."""
    label = np.arange(n) if root is None else root
    while len(a):
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        new = new[new]
        live = new[a] != new[b]
        done = not live.any() and np.array_equal(new, label)
        label = new
        if done:
            break
        if not live.any():
            a, b = a[:0], b[:0]
        else:
            a, b = a[live], b[live]
    while not np.array_equal(label[label], label):
        label = label[label]
    return label


def spread_lists(postings: DataFrame, key: str, item: str, block: int, most: int = 100_000, weight: Column | None = None) -> DataFrame:
    """Give every list of an inverted index groups (key, `i`, `j`) of about two blocks in which each pair meets.

    A list of more than `block` items (or of items that weigh more together) is cut by a hash of the item into blocks (`own`); an item goes to the group of every
    pair of blocks that has its own, so no group outgrows two blocks however long the list is. The long lists
    are sent to every task if they are `most` at most (counted), else joined by a shuffle.
    """
    sizes = postings.groupBy(key).agg((F.count("*") if weight is None else F.sum(weight)).alias("__n")).where(F.col("__n") > block)
    long = cut(sizes, "lists").withColumn("__b", F.ceil(F.col("__n") / F.lit(block)).cast("int")).drop("__n")
    if long.limit(most + 1).count() <= most:
        long = F.broadcast(long)
    own = F.pmod(F.xxhash64(item, F.lit(7)), F.col("__b").cast("long")).cast("int")
    return (
        postings.join(long, key, "left")
        .withColumn("__b", F.coalesce("__b", F.lit(1)))
        .withColumn("own", own)
        .withColumn("__o", F.explode(F.sequence(F.lit(0), F.col("__b") - 1)))
        .withColumn("i", F.least("own", "__o"))
        .withColumn("j", F.greatest("own", "__o"))
        .drop("__b", "__o")
    )


def _star(e: DataFrame) -> DataFrame:
    """One round over edges (hi, lo): every node's larger neighbours, then its smaller ones, join the smallest it knows."""
    both = e.select(F.col("hi").alias("u"), F.col("lo").alias("v")).unionByName(e.select(F.col("lo").alias("u"), F.col("hi").alias("v")))
    low = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(low, "u").where("v > u").select(F.col("v").alias("hi"), F.col("m").alias("lo")).distinct()
    low = large.groupBy("hi").agg(F.min("lo").alias("m"))
    small = large.join(low, "hi").select(F.col("lo").alias("hi"), F.col("m").alias("lo")).where("hi <> lo")
    return small.unionByName(low.select("hi", F.col("m").alias("lo"))).distinct()


def connected_components(edges: DataFrame, label: str) -> DataFrame:
    """(id, root) for every id of `edges` (u, v): root is the smallest id reachable, by alternating stars.

    Rounds grow with the logarithm of the longest path. Each is written to the shared folder, so lost executors cost one
    round at most. It ends when the edges are stars: each larger end has one smaller end, which has none.
    The driver sees counts only.
    """
    e = cut(edges.select(F.greatest("u", "v").alias("hi"), F.least("u", "v").alias("lo")).where("hi <> lo").distinct(), label)
    while True:
        ends = e.select(F.col("hi").alias("id"), F.lit(1).alias("h"), F.lit(0).alias("l")).unionByName(e.select(F.col("lo").alias("id"), F.lit(0).alias("h"), F.lit(1).alias("l")))
        ends = ends.groupBy("id").agg(F.sum("h").alias("h"), F.max("l").alias("l"))
        bent, count = ends.agg(F.count_if((F.col("h") > 1) | ((F.col("h") > 0) & (F.col("l") > 0))), F.coalesce(F.sum("h"), F.lit(0))).first()
        if not bent:
            break
        e = cut(gathered(_star(e), count), label)
    roots = e.select(F.col("lo").alias("id")).distinct().withColumn("root", F.col("id"))
    return e.select(F.col("hi").alias("id"), F.col("lo").alias("root")).unionByName(roots)
