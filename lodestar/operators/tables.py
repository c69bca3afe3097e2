"""Reshaping, matching and comparing tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pivot(long: DataFrame, key: str, name: str, value: str, names: list[str]) -> DataFrame:
    """Tall to wide with a fixed list of columns; a name that a key lacks is null."""
    return long.groupBy(key).agg(*(F.max(F.when(F.col(name) == n, F.col(value))).alias(n) for n in names))


def unpivot(wide: DataFrame, key: str, names: list[str], name: str = "name", value: str = "value") -> DataFrame:
    """Wide to tall; nulls stay rows."""
    return wide.unpivot([key], names, name, value)


def keep_first(df: DataFrame, keys: list[str], order: list[Column | str]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("__k", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__k = 1").drop("__k")


def coalesce_named(columns: list[str]) -> tuple[Column, Column]:
    """The first known value of several columns and the name of the column it is from."""
    source = F.coalesce(*(F.when(F.col(c).isNotNull(), F.lit(c)) for c in columns))
    return F.coalesce(*(F.col(c) for c in columns)), source


def diff(before: DataFrame, after: DataFrame, key: str, value: str) -> DataFrame:
    """Full outer comparison: added, removed, changed or same."""
    b = before.select(F.col(key).alias("__kb"), F.col(value).alias("before"))
    a = after.select(F.col(key).alias("__ka"), F.col(value).alias("after"))
    status = F.when(F.col("__kb").isNull(), "added").when(F.col("__ka").isNull(), "removed").when(F.col("before").eqNullSafe(F.col("after")), "same").otherwise("changed")
    return b.join(a, F.col("__kb") == F.col("__ka"), "full").select(F.coalesce("__kb", "__ka").alias(key), "before", "after", status.alias("status"))


def drift(before: DataFrame, after: DataFrame, key: str, value: str, shift: float = 0.25, change: float = 0.25) -> DataFrame:
    """Median shift in units of the earlier interquartile range and change of count, with a verdict.

    A constant feature drifts on any change of its median; a key on one side only drifts.
    """

    def summary(df: DataFrame, tag: str) -> DataFrame:
        q = F.percentile(F.col(value).cast("double"), [0.25, 0.5, 0.75])
        return df.groupBy(F.col(key).alias(f"__{tag}")).agg(F.count(value).alias(f"n_{tag}"), q.alias(f"q_{tag}"))

    j = summary(before, "b").join(summary(after, "a"), F.col("__b") == F.col("__a"), "full")
    iqr = F.col("q_b")[2] - F.col("q_b")[0]
    moved = F.abs(F.col("q_a")[1] - F.col("q_b")[1])
    rel = F.when(iqr > 0, moved / iqr)
    count = F.when(F.col("n_b") > 0, F.abs(F.col("n_a") - F.col("n_b")) / F.col("n_b"))
    why = (
        F.when(F.col("__a").isNull(), "removed").when(F.col("__b").isNull(), "added")
        .when((iqr == 0) & (moved > 0), "constant moved").when(rel > shift, "median").when(count > change, "count").otherwise("none")
    )
    return j.select(F.coalesce("__b", "__a").alias(key), rel.alias("median_shift"), count.alias("count_change"), why.alias("reason"))


def dense_years(df: DataFrame, year: Column) -> DataFrame:
    """Rows for each year from the first to the last, empty years too, and the undated rows under null."""
    y = df.select(year.cast("int").alias("year"))
    counts = y.groupBy("year").agg(F.count("*").alias("n"))
    span = y.agg(F.min("year").alias("a"), F.max("year").alias("b")).where("a is not null").select(F.explode(F.sequence("a", "b")).alias("year"))
    dense = span.join(counts.where("year is not null"), "year", "left").select("year", F.coalesce("n", F.lit(0)).cast("long").alias("n"))
    return dense.unionByName(counts.where("year is null"))


def sessions(df: DataFrame, key: str, time: str, gap_seconds: int, order: list[str]) -> DataFrame:
    """`session` numbers the runs of a key whose steps are at most the gap apart; `position` counts in the run."""
    w = Window.partitionBy(key).orderBy(time, *order)
    step = F.unix_micros(F.col(time).cast("timestamp")) - F.unix_micros(F.lag(time).over(w).cast("timestamp"))
    opened = F.when(step.isNull() | (step > gap_seconds * 1_000_000), 1).otherwise(0)
    out = df.withColumn("__o", opened).withColumn("session", F.sum("__o").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return out.drop("__o").withColumn("position", F.row_number().over(Window.partitionBy(key, "session").orderBy(time, *order)))


def coverage(entities: DataFrame, long: DataFrame, key: str, name: str, thin: float = 0.40) -> DataFrame:
    """For each feature the share of entities with a value; thin at or under the bound."""
    total = entities.select(key).distinct().agg(F.count("*").alias("total"))
    have = long.groupBy(name).agg(F.count_distinct(key).alias("have"))
    share = F.round(F.col("have") / F.col("total"), 3)
    return have.crossJoin(F.broadcast(total)).select(name, "have", share.alias("share"), (share <= thin).alias("thin"))
