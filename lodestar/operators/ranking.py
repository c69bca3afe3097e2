"""Ranks, bins and ranking metrics. Ties are always taken together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.session import cut


def _same(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = F.lit(True)
    for k in keys:
        cond = cond & left[k].eqNullSafe(right[k])
    return cond


def running(df: DataFrame, value: str, sums: dict[str, str], by: list[str] | None = None, descending: bool = False, parts: int = 64) -> DataFrame:
    """`df` with running totals {new name: column} in order of `value` within `by`; equal values share no order.

    In two levels: ranges of the value (by approximate quantiles, which steer the layout only) are summed by themselves, then
    each is moved by the totals of the ranges before it. So no window holds all rows of a group.
    """
    by = by or []
    bounds = df.agg(F.percentile_approx(F.col(value).cast("double"), [i / parts for i in range(1, parts)], 1000).alias("__bounds"))
    part = F.coalesce(F.size(F.filter("__bounds", lambda x: x <= F.col(value))), F.lit(0))
    placed = df.crossJoin(F.broadcast(bounds)).withColumn("__part", part).drop("__bounds")
    order = F.desc if descending else F.asc
    inside = Window.partitionBy(*by, "__part").orderBy(order(value)).rowsBetween(Window.unboundedPreceding, 0)
    across = Window.partitionBy(*by).orderBy(order("__part")).rowsBetween(Window.unboundedPreceding, -1)  # `parts` rows
    totals = placed.groupBy(*by, "__part").agg(*(F.sum(c).alias(f"__{n}") for n, c in sums.items()))
    before = totals.select(*by, "__part", *(F.coalesce(F.sum(f"__{n}").over(across), F.lit(0)).alias(f"__{n}") for n in sums))
    placed = placed.withColumns({n: F.sum(c).over(inside) for n, c in sums.items()})
    joined = placed.join(before, _same(placed, before, [*by, "__part"]))
    return joined.select(*(placed[c] for c in df.columns), *((placed[n] + before[f"__{n}"]).alias(n) for n in sums))


def average_rank(df: DataFrame, value: str, out: str, by: list[str] | None = None) -> DataFrame:
    """Rank from 1 ascending, ties share their mean rank; nulls count as 0 before ranking.

    Ranks are counted over the distinct values (aggregated map-side first), in ranges of the value.
    """
    by = by or []
    v = F.coalesce(F.col(value), F.lit(0)).cast("double")
    sizes = df.groupBy(*by, v.alias("__v")).agg(F.count("*").alias("__n"))
    ranks = running(sizes, "__v", {"__seen": "__n"}, by)
    ranks = ranks.select(*by, "__v", (F.col("__seen") - F.col("__n") + (F.col("__n") + 1) / 2).alias(out))
    return df.join(ranks, _same(df, ranks, by) & (v == ranks["__v"]), "left").select(df["*"], out)


def score_table(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """(by, score, n, pos) with running totals from the highest score down: tn rows and tp positives at or above it."""
    by = by or []
    at = df.where(F.col(score).isNotNull()).groupBy(*by, F.col(score).alias("s")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("pos"))
    return running(at, "s", {"seen": "n", "hits": "pos"}, by, descending=True)


def ranking_metrics(df: DataFrame, score: str, label: str, by: list[str] | None = None) -> DataFrame:
    """Average precision (ties grouped), ROC area (Mann-Whitney), rows and positives; null with one class only."""
    by = by or []
    t = score_table(df, score, label, by)
    n, p = F.sum("n"), F.sum("pos")
    q = n - p
    ap = F.sum(F.col("pos") * F.col("hits") / F.col("seen")) / p
    below = F.sum(F.col("pos") * (F.lit(0.0) - (F.col("seen") - F.col("hits")) + (F.col("n") - F.col("pos")) / 2.0))
    roc = (below + p * q) / (p * q)
    both = (p > 0) & (q > 0)
    return t.groupBy(*by).agg(n.alias("n"), p.alias("positives"), F.when(both, ap).alias("average_precision"), F.when(both, roc).alias("roc_auc"))


def places(df: DataFrame, order: str, name: str) -> DataFrame:
    """`df` with its place from 1 in ascending order of a column of any type, nulls last; equal values in no set order.

    Rows are dealt out by ranges of the value itself and written with the number of their range; a row's place is the rows of the
    ranges before plus its place in its own, so no window holds all rows.
    """
    way = F.col(order).asc_nulls_last()
    dealt = cut(df.repartitionByRange(way).withColumn("__part", F.spark_partition_id()), "places")
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)  # a row for each range
    sizes = dealt.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    inside = F.row_number().over(Window.partitionBy("__part").orderBy(way))
    return dealt.withColumn("__in", inside).join(F.broadcast(sizes), "__part").select(*df.columns, (F.col("__before") + F.col("__in")).alias(name))


def capture(df: DataFrame, score: str, label: str, tiebreak: str, share: float) -> DataFrame:
    """Share of the positives among the best round(share * rows) rows; ties by a distinct `tiebreak` of any type, ascending, nulls last.

    The cut falls at one score, found from the counts of the scores; only the rows of that score are ordered.
    """
    s = F.coalesce(F.col(score).cast("double"), F.lit(float("-inf")))
    rows = df.select(s.alias("s"), F.col(label).cast("long").alias("pos"), F.col(tiebreak).alias("tie"))
    at = running(rows.groupBy("s").agg(F.count("*").alias("n"), F.sum("pos").alias("pos")), "s", {"seen": "n", "hits": "pos"}, descending=True)
    total = rows.agg(F.count("*").alias("rows"), F.sum("pos").alias("p")).withColumn("k", F.round(F.col("rows") * share))
    limit = at.crossJoin(F.broadcast(total)).where((F.col("seen") >= F.col("k")) & (F.col("seen") - F.col("n") < F.col("k")))
    limit = limit.select("s", (F.col("seen") - F.col("n")).alias("above"), (F.col("hits") - F.col("pos")).alias("above_hits"), "k")
    tied = rows.join(F.broadcast(limit), "s")
    tied = places(tied, "tie", "place").where(F.col("above") + F.col("place") <= F.col("k")).agg(F.count("*").alias("n"), F.coalesce(F.sum("pos"), F.lit(0)).alias("hits"))
    first = limit.agg(F.coalesce(F.max("above"), F.lit(0)).alias("above"), F.coalesce(F.max("above_hits"), F.lit(0)).alias("above_hits"))
    hits = F.col("above_hits") + F.col("hits")
    return total.crossJoin(tied).crossJoin(first).select((F.col("above") + F.col("n")).alias("taken"), hits.alias("hits"), (hits.cast("double") / F.col("p")).alias("captured"))


def weighted_precision(df: DataFrame, score: str, label: str, weight: str, by: list[str]) -> DataFrame:
    """(by, average_precision) with the classes' weights brought to their numbers of rows, ties grouped; null with one class only."""
    w, pos = F.col(weight).cast("double"), F.col(label) == 1
    at = df.groupBy(*by, F.col(score).alias("s")).agg(F.sum(F.when(pos, w).otherwise(0.0)).alias("a"), F.sum(F.when(~pos, w).otherwise(0.0)).alias("b"), F.count_if(pos).alias("n"), F.count_if(~pos).alias("m"))
    order, all_ = Window.partitionBy(*by).orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0), Window.partitionBy(*by)  # a replicate's distinct scores
    sizes = {"__p": F.sum("n").over(all_), "__q": F.sum("m").over(all_), "__wp": F.nullif(F.sum("a").over(all_), F.lit(0.0)), "__wq": F.nullif(F.sum("b").over(all_), F.lit(0.0))}
    at = at.withColumns({"ta": F.sum("a").over(order), "tb": F.sum("b").over(order)} | sizes)
    hits, misses = F.col("ta") * F.col("__p") / F.col("__wp"), F.col("tb") * F.col("__q") / F.col("__wq")
    gain = F.when(F.col("a") > 0, F.col("a") / F.col("__wp") * hits / (hits + misses)).otherwise(0.0)
    both = F.min(F.col("__wp").isNotNull() & F.col("__wq").isNotNull())
    return at.groupBy(*by).agg(F.when(both, F.sum(gain)).alias("average_precision"))


def calibration(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """Equal-width bins: count, mean probability, share of positives."""
    b = F.least(F.lit(bins - 1), F.floor(F.col(prob) * bins)).cast("int")
    return df.where(F.col(prob).isNotNull()).groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.avg(prob).alias("mean_prob"), F.avg(F.col(label).cast("double")).alias("share"))


def calibration_error(df: DataFrame, prob: str, label: str, bins: int = 10) -> DataFrame:
    """Expected calibration error and Brier score."""
    c = calibration(df, prob, label, bins)
    ece = c.agg((F.sum(F.col("n") * F.abs(F.col("mean_prob") - F.col("share"))) / F.sum("n")).alias("ece"))
    brier = df.where(F.col(prob).isNotNull()).agg(F.avg(F.pow(F.col(prob) - F.col(label), 2)).alias("brier"))
    return ece.crossJoin(brier)


def bin_of(value: Column, edges: Column) -> Column:
    """How many edges lie at or below the value (right-sided search), clipped to the bins between the edges."""
    k = F.size(F.filter(edges, lambda e: e <= value)) - 1
    return F.least(F.greatest(k, F.lit(0)), F.size(edges) - 2)


def quantile_edges(df: DataFrame, value: str, bins: int) -> DataFrame:
    """One row with the array of bins + 1 exact quantiles."""
    return df.agg(F.percentile(F.col(value).cast("double"), [i / bins for i in range(bins + 1)]).alias("edges"))


def spearman(df: DataFrame, a: str, b: str) -> DataFrame:
    """Rank correlation, ties by mean rank."""
    ranked = average_rank(average_rank(df, a, "__a"), b, "__b")
    return ranked.agg(F.corr("__a", "__b").alias("spearman"))
