"""Evidence scores: memberships, weighted means over what is known, contributions and what-if.

Unknown is not zero: a criterion without a value adds neither weight nor score, and a row whose known weight is too small
has no score.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Criterion:
    """shape: falling(full, none), rising(none, full), band(a, b, c, d), binary(), percentile_rising(q_none, q_full)."""

    key: str
    feature: str
    shape: str
    weight: float
    params: tuple[float, ...] = ()


def clamp(x: Column) -> Column:
    return F.when(x.isNotNull(), F.least(F.lit(1.0), F.greatest(F.lit(0.0), x)))


def falling(v: Column, full: Column | float, none: Column | float) -> Column:
    """1 up to `full`, 0 from `none`, straight between."""
    full, none = (x if isinstance(x, Column) else F.lit(float(x)) for x in (full, none))
    return clamp((none - v) / (none - full))


def rising(v: Column, none: Column | float, full: Column | float) -> Column:
    full, none = (x if isinstance(x, Column) else F.lit(float(x)) for x in (full, none))
    return F.when(full != none, clamp((v - none) / F.nullif(full - none, F.lit(0.0))))


def band(v: Column, a: float, b: float, c: float, d: float) -> Column:
    """Trapezoid: 0 outside (a, d), 1 in [b, c]."""
    return F.when(v.isNotNull(), F.least(clamp((v - a) / F.lit(float(b - a))), clamp((d - v) / F.lit(float(d - c)))))


def memberships(df: DataFrame, criteria: list[Criterion]) -> DataFrame:
    """`df` with a column m_<key> for each criterion; quantile thresholds come from one aggregation of the whole column."""
    quantiles = {c.key: F.percentile(F.col(c.feature).cast("double"), list(c.params)).alias(f"__q_{c.key}") for c in criteria if c.shape == "percentile_rising"}
    if quantiles:
        df = df.crossJoin(F.broadcast(df.agg(*quantiles.values())))
    out = {}
    for c in criteria:
        v = F.col(c.feature).cast("double")
        if c.shape == "falling":
            m = falling(v, *c.params)
        elif c.shape == "rising":
            m = rising(v, *c.params)
        elif c.shape == "band":
            m = band(v, *c.params)
        elif c.shape == "binary":
            m = F.when(v.isNotNull(), (v > 0).cast("double"))
        elif c.shape == "percentile_rising":
            m = rising(v, F.col(f"__q_{c.key}")[0], F.col(f"__q_{c.key}")[1])
        else:
            raise ValueError(f"unknown shape {c.shape}")
        out[f"m_{c.key}"] = m
    return df.withColumns(out).drop(*(f"__q_{k}" for k in quantiles))


def score(df: DataFrame, criteria: list[Criterion], least_known: float) -> DataFrame:
    """Adds known_share and score (null if known_share is under `least_known`)."""
    total = sum(c.weight for c in criteria)
    known = sum((F.when(F.col(f"m_{c.key}").isNotNull(), c.weight).otherwise(0.0) for c in criteria), F.lit(0.0))
    met = sum((F.coalesce(F.col(f"m_{c.key}") * c.weight, F.lit(0.0)) for c in criteria), F.lit(0.0))
    df = df.withColumn("known_share", known / total)
    return df.withColumn("score", F.when(F.col("known_share") >= least_known, met / F.nullif(known, F.lit(0.0))))


def contributions(df: DataFrame, id_: str, criteria: list[Criterion]) -> DataFrame:
    """Long form (id, criterion, weight, membership, contribution); unknown stays null."""
    rows = F.array(*(F.struct(F.lit(c.key).alias("criterion"), F.lit(c.weight).alias("weight"), F.col(f"m_{c.key}").alias("membership")) for c in criteria))
    return df.select(id_, F.explode(rows).alias("r")).select(id_, "r.*").withColumn("contribution", F.col("weight") * F.col("membership"))


def sensitivity(long: DataFrame, id_: str) -> DataFrame:
    """For each criterion: the score if it were fully met and if not met at all, the others as they are, and the span."""
    from pyspark.sql import Window

    w = Window.partitionBy(id_)
    known = F.col("membership").isNotNull()
    others_w = F.sum(F.when(known, F.col("weight")).otherwise(0.0)).over(w) - F.when(known, F.col("weight")).otherwise(0.0)
    others_s = F.sum(F.coalesce("contribution", F.lit(0.0))).over(w) - F.coalesce("contribution", F.lit(0.0))
    met, unmet = (others_s + F.col("weight")) / (others_w + F.col("weight")), others_s / (others_w + F.col("weight"))
    out = long.withColumns({"score_if_met": met, "score_if_not": unmet})
    return out.withColumn("span", F.col("score_if_met") - F.col("score_if_not"))
