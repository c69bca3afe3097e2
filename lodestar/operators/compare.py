"""Comparing scores: logistic fits by aggregated normal equations, calibration slope, added information, views of answers."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.session import cut


def newton_logistic(df: DataFrame, features: list[Column], label: Column, rounds: int = 25, ridge: float = 1e-9) -> tuple[list[float], float] | None:
    """(coefficients with the intercept first, log-likelihood) of an unpenalised logistic fit; None where it does not exist.

    Each round is one aggregation; the driver gets the sums of the normal equations only, (k + 1)(k + 4) / 2 numbers.
    """
    k = len(features) + 1
    rows = cut(df.select(F.array(F.lit(1.0), *(f.cast("double") for f in features)).alias("x"), label.cast("double").alias("y")), "logistic")
    seen = rows.agg(F.min("y"), F.max("y"), F.count("*")).first()
    if seen[2] < 3 or seen[0] == seen[1]:
        return None
    b = np.zeros(k)
    value = lambda i: F.col("x")[i]
    for _ in range(rounds):
        z = sum((float(b[i]) * value(i) for i in range(k)), F.lit(0.0))
        mu = 1 / (1 + F.exp(-F.greatest(F.lit(-30.0), F.least(F.lit(30.0), z))))
        w = mu * (1 - mu) + ridge
        pairs = [(i, j) for i in range(k) for j in range(i, k)]
        got = rows.select("x", "y", mu.alias("mu"), w.alias("w")).agg(*(F.sum(F.col("w") * value(i) * value(j)) for i, j in pairs), *(F.sum((F.col("y") - F.col("mu")) * value(i)) for i in range(k))).first()
        h, g = np.zeros((k, k)), np.array(got[len(pairs) :], float)
        for (i, j), v in zip(pairs, got, strict=False):
            h[i, j] = h[j, i] = v
        try:
            step = np.linalg.solve(h, g)
        except np.linalg.LinAlgError:
            return None
        b = b + step
        if np.abs(step).max() < 1e-8:
            break
    if not np.isfinite(b).all() or np.abs(b[1:]).max() >= 1e3:
        return None
    p = 1 / (1 + F.exp(-sum((float(b[i]) * value(i) for i in range(k)), F.lit(0.0))))
    p = F.greatest(F.lit(1e-12), F.least(F.lit(1 - 1e-12), p))
    return [float(v) for v in b], float(rows.agg(F.sum(F.col("y") * F.log(p) + (1 - F.col("y")) * F.log(1 - p))).first()[0])


def calibration_slope(df: DataFrame, prob: str, label: str) -> float | None:
    """Slope of the outcome on the logit of the stated probability: 1 is calibrated, under 1 overconfident; None if degenerate."""
    p = F.greatest(F.lit(1e-4), F.least(F.lit(1 - 1e-4), F.col(prob)))
    rows = df.where(F.col(prob).isNotNull() & ~F.isnan(prob))
    low, high = rows.agg(F.min(p), F.max(p)).first()
    if low is None or high - low < 1e-9:
        return None
    fit = newton_logistic(rows, [F.log(p / (1 - p))], F.col(label))
    return fit[0][1] if fit else None


def added_information(df: DataFrame, base: str, extra: str, label: str) -> tuple[float, float, float] | None:
    """(likelihood ratio, coefficient, one-sided p) of `extra` beside `base`, both already ranks from 0 to 1."""
    small, large = newton_logistic(df, [F.col(base)], F.col(label)), newton_logistic(df, [F.col(base), F.col(extra)], F.col(label))
    if small is None or large is None:
        return None
    ratio = max(0.0, 2 * (large[1] - small[1]))
    two = math.erfc(math.sqrt(ratio / 2))  # upper tail of chi-squared with one degree of freedom
    return ratio, large[0][2], two / 2 if large[0][2] > 0 else 1 - two / 2


def binomial_tail(df: DataFrame, n: str, k: str, block: int = 4096) -> DataFrame:
    """`df` with `tail`: the chance of at most `k` heads (at most half of `n`) in `n` throws of a fair coin.

    One row for each term of the sum, made in blocks. A term is taken from Stirling's formula with its correction, so that no
    two large logarithms are subtracted: n log 2 less the entropy is a function of the distance from one half.
    """
    exact = F.array(*(F.lit(math.lgamma(x + 1) - (x + 0.5) * math.log(x) + x - 0.5 * math.log(2 * math.pi) if x else 0.0) for x in range(16)))

    def correction(x: Column) -> Column:
        y = 1 / (x * x)
        return F.when(x < 16, F.get(exact, F.least(x, F.lit(15.0)).cast("int"))).otherwise((1 / 12 - y * (1 / 360 - y * (1 / 1260 - y / 1680))) / x)

    rows = df.withColumn("__id", F.monotonically_increasing_id())
    rows = cut(rows, "tails")
    terms = rows.select("__id", F.col(n).cast("double").alias("n"), F.col(k).cast("long").alias("k"), F.explode(F.sequence(F.lit(0).cast("long"), F.col(k).cast("long"), F.lit(block).cast("long"))).alias("at"))
    terms = terms.repartition("__id", "at").select("__id", "n", F.explode(F.sequence("at", F.least(F.col("at") + block - 1, F.col("k")))).alias("x"))
    terms = terms.withColumn("x", F.col("x").cast("double")).withColumns({"y": F.col("n") - F.col("x")}).withColumn("d", F.when(F.col("n") > 0, (F.col("y") - F.col("x")) / F.col("n")))
    u, v = 1 + F.col("d"), 1 - F.col("d")
    entropy = F.col("n") / 2 * (u * F.log1p("d") + v * F.log1p(-F.col("d")))
    log = correction(F.col("n")) - correction(F.col("x")) - correction(F.col("y")) - entropy + 0.5 * F.log(F.col("n") / (2 * math.pi * F.col("x") * F.col("y")))
    term = F.when(F.col("x") > 0, F.exp(log)).otherwise(F.exp(F.col("n") * -math.log(2.0)))
    tails = terms.groupBy("__id").agg(F.sum(term).alias("tail"))
    return rows.join(tails, "__id").drop("__id")


def answer_view(df: DataFrame, own: bool = False, abstain: str = "abstain") -> DataFrame:
    """`df` with p, v and abstained from published, probability, verdict: what a refused answer counts as.

    By the tie rule a refused answer has no probability and abstains; by its own rule it keeps what it stated and abstains.
    """
    there = F.coalesce(F.col("answered"), F.lit(False))
    shown = there if own else there & F.coalesce(F.col("published"), F.lit(False))
    verdict = F.when(shown, F.coalesce("verdict", F.lit(""))).otherwise("")
    refused = ~F.coalesce(F.col("published"), F.lit(False))
    return df.select("*", F.when(shown, F.col("probability")).alias("p"), verdict.alias("v"), (~shown | (verdict == abstain) | refused).alias("abstained"))
