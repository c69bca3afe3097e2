"""Rule checks over records. A rule flags and never drops a record."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

Check = Callable[[], tuple[Column, Column]]
REGISTRY: dict[str, Check] = {}
SEVERITY = {"pass": 0, "note": 1, "warn": 2, "fail": 3}


def rule(f: Check) -> Check:
    """Register a rule under its name: it gives the outcome of a record (null where it does not apply) and a detail."""
    REGISTRY[f.__name__] = f
    return f


def run(df: DataFrame, names: list[str], scope: str = "row_id") -> DataFrame:
    """(rule, outcome, scope_id, detail, severity), a row for each rule that applies to a record; one pass over the records."""
    told = []
    for name in names:
        result, detail = REGISTRY[name]()
        told.append(F.struct(F.lit(name).alias("rule"), result.alias("outcome"), detail.cast("string").alias("detail")))
    levels = F.create_map(*(F.lit(x) for kv in SEVERITY.items() for x in kv))
    rows = df.select(F.col(scope).cast("string").alias("scope_id"), F.explode(F.filter(F.array(*told), lambda t: t["outcome"].isNotNull())).alias("t"))
    return rows.select("t.rule", "t.outcome", "scope_id", "t.detail", levels[F.col("t.outcome")].alias("severity"))


def worst(results: DataFrame) -> DataFrame:
    """The worst outcome of each record over all rules, and the rules that did not pass."""
    bad = F.array_sort(F.collect_set(F.when(F.col("severity") > 0, F.col("rule"))))
    return results.groupBy("scope_id").agg(F.max_by("outcome", "severity").alias("outcome"), bad.alias("rules"))


def worst_of(df: DataFrame, names: list[str], scope: str = "row_id") -> DataFrame:
    """`worst(run(df, names, scope))` with each record's rules settled before the shuffle: a number for the worst and a bit for each rule that did not pass."""
    if len(names) > 62:
        raise ValueError(f"{len(names)} rules are more than the 62 bits of a long")
    names = sorted(names)
    level = lambda outcome: F.coalesce(*(F.when(outcome == k, v) for k, v in SEVERITY.items()))
    rows = df.select(F.col(scope).cast("string").alias("scope_id"), *(level(REGISTRY[n]()[0]).alias(f"__{k}") for k, n in enumerate(names)))
    levels = [F.col(f"__{k}") for k in range(len(names))]
    bits = sum((F.when(x > 0, F.lit(1 << k)).otherwise(0).cast("long") for k, x in enumerate(levels)), F.lit(0).cast("long"))
    rows = rows.select("scope_id", (F.greatest(*levels) if len(levels) > 1 else levels[0]).alias("severity"), bits.alias("bits")).where("severity IS NOT NULL")
    told = rows.groupBy("scope_id").agg(F.max("severity").alias("severity"), F.bit_or("bits").alias("bits"))
    bad = F.array_compact(F.array(*(F.when(F.col("bits").bitwiseAND(F.lit(1 << k)) != 0, n) for k, n in enumerate(names))))
    outcome = F.coalesce(*(F.when(F.col("severity") == v, k) for k, v in SEVERITY.items()))
    return told.select("scope_id", outcome.alias("outcome"), bad.alias("rules"))


@rule
def positive_quantity() -> tuple[Column, Column]:
    return F.when(F.col("quantity") > 0, "pass").otherwise("fail"), F.col("quantity")


@rule
def unit_price_range() -> tuple[Column, Column]:
    """Unit price within a quarter of the list price; a note where the list price is unknown."""
    unit = F.col("price") / F.col("quantity")
    off = F.abs(unit - F.col("list_price")) / F.col("list_price")
    return F.when(F.col("list_price").isNull(), "note").when(off <= 0.25, "pass").when(off <= 0.75, "warn").otherwise("fail"), F.round(unit, 2)


@rule
def share_range() -> tuple[Column, Column]:
    return F.when(F.col("discount").between(0, 1) & F.col("tax").between(0, 1), "pass").otherwise("fail"), F.col("discount")


@rule
def shipped_after_order() -> tuple[Column, Column]:
    return F.when(F.col("ordered").isNull(), None).when(F.col("shipped") >= F.col("ordered"), "pass").otherwise("warn"), F.datediff("shipped", "ordered")
