"""Folds, thinning, matching and resampling by a fixed order of ids, so that any engine can repeat them.

An id's place is (id * 1103515245 + salt) mod 2^31: the same rule everywhere, no state, no random stream.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.digests import low_half
from lodestar.operators import ranking
from lodestar.session import cut, prepare

Draw = Callable[[Column, Column, int], Column]
ROWS, COUNTS = 1 << 17, 1 << 21  # rows of a block of a permutation test; counts held at a time


def draw(id_: Column, salt: int | Column = 12345) -> Column:
    """A number in [0, 2^31) for an integer id; ids are reduced first so that the product fits a long."""
    s = salt if isinstance(salt, Column) else F.lit(salt)
    return F.pmod(F.pmod(id_.cast("long"), F.lit(1 << 31)) * 1103515245 + s.cast("long") * 12820163, F.lit(1 << 31))


def uniform(id_: Column, rep: Column, seed: int) -> Column:
    """A number in [0, 1) for a row in a replicate, from a hash of all three."""
    return F.shiftrightunsigned(F.xxhash64(id_, rep, F.lit(seed)), 11) / float(1 << 53)


def portable(id_: Column, rep: Column, seed: int) -> Column:
    """The same from MD5, which every engine has."""
    return F.conv(F.substring(_digest(id_, rep, seed), 1, 13), 16, 10).cast("double") / float(1 << 52)


def _digest(id_: Column, rep: Column, seed: int) -> Column:
    return F.md5(F.concat_ws("-", id_.cast("string"), rep.cast("string"), F.lit(str(seed))).cast("binary"))


def _ordered(draw_of: Draw, id_: Column, rep: Column, seed: int) -> tuple[Column, Callable[[float], Column]]:
    """A column in the order of the draws, and what a number in [0, 1) is in that order.

    A portable draw is the first 13 of the digest's hexadecimal digits, so the digest itself is compared as text and no number is made of it.
    """
    if draw_of is portable:
        return _digest(id_, rep, seed), lambda c: F.lit(format(math.ceil(c * (1 << 52)), "013x"))
    return draw_of(id_, rep, seed), F.lit


def poisson_steps() -> list[float]:
    """Where the distribution of Poisson(1) steps, as far as a 52-bit number can tell."""
    steps, c, p, k = [], 0.0, 0.36787944117144233, 0  # exp(-1)
    while c + p < 1 and p > 2**-53:
        c, k = c + p, k + 1
        steps.append(c)
        p /= k
    return steps


def replicates(df: DataFrame, draws: int) -> DataFrame:
    """Each row once in each of `rep` 0 .. draws - 1, spread over all cores first: a few rows are many once repeated."""
    spread = df.repartition(max(64, 4 * df.sparkSession.sparkContext.defaultParallelism))
    return spread.withColumn("rep", F.explode(F.sequence(F.lit(0), F.lit(draws - 1))))


def folds(df: DataFrame, key: str, k: int, salt: int = 12345) -> DataFrame:
    """`fold` in 0..k-1 by the key: rows of one block share a fold."""
    return df.withColumn("fold", F.pmod(F.floor(draw(F.col(key), salt) / 65536), F.lit(k)).cast("int"))


def thin(df: DataFrame, block: str, label: str, id_: str) -> DataFrame:
    """One positive for each block (the first by draw); every negative stays."""
    w = Window.partitionBy(block).orderBy(draw(F.col(id_)), id_)
    pos = df.where(F.col(label) == 1).withColumn("__k", F.row_number().over(w)).where("__k = 1").drop("__k")
    return pos.unionByName(df.where(F.col(label) == 0))


def match_background(df: DataFrame, level: str, label: str, id_: str, ratio: int) -> DataFrame:
    """Negatives in proportion to the positives of their level: at most ratio x positives of that level, by draw."""
    want = df.where(F.col(label) == 1).groupBy(level).agg((F.count("*") * ratio).alias("__want"))
    w = Window.partitionBy(level).orderBy(draw(F.col(id_)), id_)
    neg = df.where(F.col(label) == 0).withColumn("__k", F.row_number().over(w)).join(want, level).where("__k <= __want").drop("__k", "__want")
    return df.where(F.col(label) == 1).unionByName(neg.select(df.columns))


def stratified(df: DataFrame, stratum: str, id_: str, sizes: dict[str, int]) -> DataFrame:
    """The first n rows of each stratum by draw."""
    want = F.coalesce(*(F.when(F.col(stratum) == k, F.lit(n)) for k, n in sizes.items()), F.lit(0))
    w = Window.partitionBy(stratum).orderBy(draw(F.col(id_)), id_)
    return df.withColumn("__k", F.row_number().over(w)).where(F.col("__k") <= want).drop("__k")


def resample(df: DataFrame, id_: str, draws: int, seed: int, draw_of: Draw = uniform) -> DataFrame:
    """`df` in `draws` Poisson(1) resamples: `w` is a row's weight in the replicate `rep`.

    A weight is looked up in the Poisson distribution by the row's own draw, so nothing is gathered: rows are
    exploded and aggregated map-side.
    """
    out = replicates(df, draws)
    key, mark = _ordered(draw_of, F.col(id_), F.col("rep"), seed)
    steps = poisson_steps()
    weight = F.when(F.col("__u") < mark(steps[0]), 0)
    for k, c in enumerate(steps[1:], 1):
        weight = weight.when(F.col("__u") < mark(c), k)
    return out.withColumn("__u", key).withColumn("w", weight.otherwise(len(steps))).drop("__u")


def bootstrap_precision(df: DataFrame, id_: str, score: str, label: str, draws: int = 200, seed: int = 7, draw_of: Draw = uniform) -> DataFrame:
    """(rep, average_precision) of resamples with positives and negatives apart: each class keeps its weight."""
    return ranking.weighted_precision(resample(df.select(id_, score, label), id_, draws, seed, draw_of), score, label, "w", ["rep"])


def paired_bootstrap(df: DataFrame, id_: str, scores: tuple[str, str], label: str, draws: int = 200, seed: int = 7, draw_of: Draw = uniform) -> DataFrame:
    """(rep, difference) of the average precision of two scores under the same draws."""
    reps = resample(df.select(id_, *scores, label), id_, draws, seed, draw_of)
    both = reps.select("rep", "w", label, F.explode(F.array(*(F.struct(F.lit(k).alias("which"), F.col(s).cast("double").alias("score")) for k, s in enumerate(scores)))).alias("x")).select("rep", "w", label, "x.*")
    each = ranking.weighted_precision(both, "score", label, "w", ["rep", "which"])
    return each.groupBy("rep").agg((F.max(F.when(F.col("which") == 0, F.col("average_precision"))) - F.max(F.when(F.col("which") == 1, F.col("average_precision")))).alias("difference"))


def rank_permutation(df: DataFrame, id_: str, a: str, b: str, label: str, draws: int = 10_000, seed: int = 3, draw_of: Draw = uniform) -> DataFrame:
    """(observed, p_value): is score a better than b in average precision? One-sided, (hits + 1) / (draws + 1).

    Both scores become normalised ranks; in a replicate each row swaps its two ranks with probability one half. What a replicate needs are the
    counts of both classes at each rank, first and second; `observed` is the replicate -1, without swaps.
    """
    ranked = ranking.average_rank(ranking.average_rank(df, a, "__ra"), b, "__rb").select(id_, label, "__ra", "__rb")
    ranked = ranked.where(F.col(label).isNotNull()).select(F.concat_ws("-", F.col(id_).cast("string"), F.lit("")).alias("head"), F.col(id_).alias("id"), (F.col(label) == 1).alias("pos"), "__ra", "__rb")
    ranked = cut(ranked, "ranks")
    counts = (_swapped if draw_of is portable else _swapped_rows)(ranked, draws, seed, draw_of)
    at = counts.groupBy("rep", "score").agg(*(F.sum(c).alias(c) for c in ("a", "b", "c", "d")))
    order = Window.partitionBy("rep").orderBy(F.desc("score")).rowsBetween(Window.unboundedPreceding, 0)  # a replicate's distinct ranks
    at = at.withColumns({f"t{c}": F.sum(c).over(order) for c in "abcd"})
    precision = lambda p, q: F.sum(F.when(F.col(p) > 0, F.col(p) * (F.col(f"t{p}") / (F.col(f"t{p}") + F.col(f"t{q}")))).otherwise(0.0)) / F.sum(p)
    d = at.groupBy("rep").agg(F.when((F.sum("a") > 0) & (F.sum("b") > 0), precision("a", "b") - precision("c", "d")).alias("d")).where("d IS NOT NULL")
    d = cut(d, "differences")  # a number for each replicate
    told = d.where("rep = -1").select(F.col("d").alias("observed"))
    return d.where("rep >= 0").crossJoin(F.broadcast(told)).agg(F.max("observed").alias("observed"), ((F.count_if(F.col("d") >= F.col("observed") - 1e-12) + 1) / (F.count("*") + 1)).alias("p_value"))


def _swapped_rows(ranked: DataFrame, draws: int, seed: int, draw_of: Draw) -> DataFrame:
    """(rep, score, a, b, c, d): positives and others with this rank first, and with it second; every draw is a row."""
    reps = replicates(ranked, draws).withColumn("__s", draw_of(F.col("id"), F.col("rep"), seed) < 0.5)
    rows = reps.unionByName(ranked.withColumns({"rep": F.lit(-1), "__s": F.lit(False)}))
    one, none = (F.col("pos").cast("long"), (~F.col("pos")).cast("long")), (F.lit(0).cast("long"), F.lit(0).cast("long"))
    side = lambda score, *n: F.struct(score.alias("score"), *(x.alias(k) for k, x in zip("abcd", n, strict=True)))
    first, second = F.when(F.col("__s"), F.col("__rb")).otherwise(F.col("__ra")), F.when(F.col("__s"), F.col("__ra")).otherwise(F.col("__rb"))
    return rows.select("rep", F.explode(F.array(side(first, *one, *none), side(second, *none, *one))).alias("x")).select("rep", "x.*")


def _swapped(ranked: DataFrame, draws: int, seed: int, draw_of: Draw) -> DataFrame:
    """The same for portable draws, counted in numpy: a task draws a range of the replicates for a block of the rows and gives their counts.

    Its memory is bounded by the block and by COUNTS, however many ranks are distinct.
    """
    spark = prepare(ranked.sparkSession)
    rows = cut(ranked.groupBy("head", "pos", "__ra", "__rb").agg(F.count("*").alias("n")), "ranked-rows")
    blocks = max(1, -(-rows.count() // ROWS))
    ranges = max(1, -(-max(64, 4 * spark.sparkContext.defaultParallelism) // blocks))
    size = -(-draws // ranges)
    dealt = rows.withColumn("__g", F.pmod(F.xxhash64("head", "pos", "__ra", "__rb"), F.lit(blocks)).cast("int")).withColumn("__h", F.explode(F.sequence(F.lit(0), F.lit(ranges - 1))))

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if not held:
            return
        rows = pa.Table.from_batches(held)
        for h in pc.unique(rows.column("__h")).to_pylist():
            here = rows.filter(pc.equal(rows.column("__h"), h))
            heads = [t.encode() for t in here.column("head").to_pylist()]
            score, at = np.unique(np.concatenate([here.column(c).to_numpy() for c in ("__ra", "__rb")]), return_inverse=True)
            n, other = here.column("n").to_numpy(), 1 - here.column("pos").to_numpy().astype(np.int64)
            at = (at.reshape(2, -1) * 2 + other).astype(np.int64)  # a line for each rank and class
            base = np.stack([np.bincount(k, n, 2 * len(score)).astype(np.int64) for k in at])
            wide = max(1, COUNTS // (2 * len(score)))
            for low in range(h * size, min(draws, (h + 1) * size), wide):
                reps = np.arange(low, min(draws, (h + 1) * size, low + wide))
                yield _told(score, base, reps, _moved(heads, at, n, len(score), [f"{k}-{seed}".encode() for k in reps]))
            if h == 0:
                yield _told(score, base, np.array([-1]), np.zeros((2 * len(score), 1), np.int64))

    return dealt.repartitionById(blocks * ranges, F.col("__g") * ranges + F.col("__h")).mapInArrow(count, "rep long, score double, a long, b long, c long, d long")


def _moved(heads: list[bytes], at: np.ndarray, n: np.ndarray, ranks: int, tails: list[bytes]) -> np.ndarray:
    """By rank and class (lines) and replicate (columns): rows that swap to it less those that swap away from it."""
    out, deep = np.zeros((2 * ranks, len(tails)), np.int64), max(1, (1 << 22) // len(tails))
    for k in range(0, len(heads), deep):
        for s, a, b, times in zip(low_half(heads[k : k + deep], tails), *at[:, k : k + deep], n[k : k + deep], strict=True):
            s = s if times == 1 else s * times
            out[a] -= s
            out[b] += s
    return out


def _told(score: np.ndarray, base: np.ndarray, reps: np.ndarray, moved: np.ndarray) -> pa.RecordBatch:
    """A row for each rank and replicate."""
    first, second = base[0][:, None] + moved, base[1][:, None] - moved
    columns = [np.tile(reps, len(score)), np.repeat(score, len(reps)), *(side[k::2].ravel() for side in (first, second) for k in (0, 1))]
    return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["rep", "score", "a", "b", "c", "d"])


def two_level_bootstrap(df: DataFrame, run: str, id_: str, value: str, draws: int = 200, seed: int = 5, draw_of: Draw = uniform) -> DataFrame:
    """(rep, mean) where runs are resampled first, then rows: a row's weight is the product of its run's and its own."""
    runs = resample(df.select(run).distinct(), run, draws, seed, draw_of).withColumnRenamed("w", "wr")
    rows = resample(df.select(run, id_, value), id_, draws, seed + 1, draw_of)
    rows = rows.groupBy(run, "rep").agg(F.sum(F.col("w") * F.col(value)).alias("__wv"), F.sum("w").alias("__w")).join(runs, [run, "rep"])
    return rows.groupBy("rep").agg((F.sum(F.col("wr") * F.col("__wv")) / F.nullif(F.sum((F.col("wr") * F.col("__w")).cast("double")), F.lit(0.0))).alias("mean"))


def components(nodes: DataFrame, edges: DataFrame, folder: str, most: int = 60) -> DataFrame:
    """(id, root) by spreading the smallest id along edges (u, v) until nothing changes."""
    spark = nodes.sparkSession
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct()
    both.write.parquet(f"{folder}/edges")
    both = spark.read.parquet(f"{folder}/edges")
    now = nodes.select("id", F.col("id").alias("root"))
    before = None
    for n in range(most):
        low = both.join(now, both.v == now.id).groupBy("u").agg(F.min("root").alias("low"))
        now = now.join(low, now.id == low.u, "left").select("id", F.least("root", F.coalesce("low", "root")).alias("root"))
        jump = now.select(F.col("id").alias("__i"), F.col("root").alias("__r"))
        now = now.join(jump, now.root == jump["__i"], "left").select("id", F.least("root", F.coalesce("__r", "root")).alias("root"))
        now.write.parquet(f"{folder}/{n}")
        now = spark.read.parquet(f"{folder}/{n}")
        total = now.agg(F.sum("root")).first()[0]
        if total == before:
            return now
        before = total
    raise RuntimeError("components did not settle")
