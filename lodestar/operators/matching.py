"""Fuzzy matching: similar names, and greedy one-to-one pairing. Arrow UDFs hold the two measures that Spark lacks."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, LongType, StringType


def indel_ratio(a: str, b: str) -> float:
    """2 x longest common subsequence / total length, in per cent."""
    if not a and not b:
        return 100.0
    row = [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else max(row[j], row[j - 1])), row[j]
    return 200.0 * row[-1] / (len(a) + len(b))


def longest_common(a: str, b: str) -> int:
    """Length of the longest common run of characters."""
    best, row = 0, [0] * (len(b) + 1)
    for x in a:
        left = 0
        for j, y in enumerate(b, 1):
            row[j], left = (left + 1 if x == y else 0), row[j]
            best = max(best, row[j])
    return best


@F.pandas_udf(DoubleType())
def similarity(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else indel_ratio(x, y) for x, y in zip(a, b, strict=True)], dtype="float64")


@F.pandas_udf(LongType())
def common_run(a: pd.Series, b: pd.Series) -> pd.Series:
    return pd.Series([None if x is None or y is None else longest_common(x, y) for x, y in zip(a, b, strict=True)], dtype="Int64")


@F.pandas_udf(StringType())
def compatibility_form(a: pd.Series) -> pd.Series:
    """Unicode NFKC, case folded."""
    return a.map(lambda x: None if x is None else unicodedata.normalize("NFKC", x).casefold())


def squashed(name: Column) -> Column:
    """Letters and digits of every script, in lower case; null if there are none."""
    return F.nullif(F.regexp_replace(F.lower(name), r"[^\p{L}\p{N}]", ""), F.lit(""))


def fuzzy_join(left: DataFrame, right: DataFrame, left_name: str, right_name: str, floor: float, near: tuple[str, str] | None = None, reach: float | None = None) -> DataFrame:
    """Best right row for each left row by similarity of names at `floor` or more; exact matches first.

    Candidates share a gram of three characters of the squashed names. A pair at the floor differs by at most
    2 (1 - f) / f x length single-character edits, each of which spoils three grams; so of each name only its rarest
    3 x edits + 1 grams are joined, and common grams make no pairs where a name has rare ones. Names of under three
    characters match exactly or not at all; names without a letter or digit match nothing. With `near`, the columns of a
    position that both sides have, a pair must lie within `reach` of each other unless the names are equal; ties go to the
    nearer. Both sides need an `id`.
    """
    f = floor / 100
    x, y = near or (None, None)

    def grams(df: DataFrame, name: str, tag: str) -> DataFrame:
        place = [F.col(c).alias(f"{tag}_{k}") for k, c in (("x", x), ("y", y)) if c is not None]
        k = df.select(F.col("id").alias(f"{tag}_id"), squashed(F.col(name)).alias(f"{tag}_key"), *place).where(F.col(f"{tag}_key").isNotNull())
        at = F.sequence(F.lit(1), F.greatest(F.lit(1), F.length(f"{tag}_key") - 2))
        return k.withColumn("gram", F.explode(F.array_distinct(F.transform(at, lambda i: F.substring(F.col(f"{tag}_key"), i, F.lit(3))))))

    sides = [(grams(left, left_name, "l"), "l"), (grams(right, right_name, "r"), "r")]
    common = sides[0][0].select("gram").unionByName(sides[1][0].select("gram")).groupBy("gram").agg(F.count("*").alias("n"))

    def rarest(df: DataFrame, tag: str) -> DataFrame:
        edits = F.floor(2 * (1 - f) / f * F.length(f"{tag}_key") + 1e-9)
        k = F.row_number().over(Window.partitionBy(f"{tag}_id").orderBy("n", "gram"))
        return df.join(common, "gram").withColumn("k", k).where(F.col("k") <= 3 * edits + 1).drop("k", "n")

    pairs = rarest(*sides[0]).join(rarest(*sides[1]), "gram").drop("gram").distinct()
    same = F.col("l_key") == F.col("r_key")
    apart = F.lit(0.0) if near is None else F.hypot(F.col("l_x") - F.col("r_x"), F.col("l_y") - F.col("r_y"))
    pairs = pairs.withColumn("apart", apart)
    if near is not None and reach is not None:
        pairs = pairs.where(same | (F.col("apart") <= reach))
    scored = pairs.withColumn("score", F.when(same, 100.0).otherwise(similarity("l_key", "r_key"))).where(F.col("score") >= floor)
    best = F.row_number().over(Window.partitionBy("l_id").orderBy(F.desc("score"), F.asc_nulls_last("apart"), "r_id"))
    return scored.withColumn("k", best).where("k = 1").select(F.col("l_id").alias("left_id"), F.col("r_id").alias("right_id"), "score")


def greedy_pairs(candidates: DataFrame, group: str) -> DataFrame:
    """One-to-one pairs (group, a, b, score) taken best first within each group; ties by a, then b.

    Sequential by nature, so a group is in one task; its rows stream by in order, and only the ends already taken are held.
    """
    best = F.when(~F.isnan("score"), F.col("score")).desc_nulls_last()
    rows = candidates.select(group, "a", "b", F.col("score").cast("double").alias("score")).repartition(group)
    rows = rows.sortWithinPartitions(group, best, F.asc_nulls_last("a"), F.asc_nulls_last("b"))

    def pair(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, used_a, used_b = object(), set(), set()
        for batch in batches:
            keep = []
            for k, (g, a, b) in enumerate(zip(*(batch.column(c).to_pylist() for c in range(3)), strict=True)):
                if g != now:
                    now, used_a, used_b = g, set(), set()
                if a not in used_a and b not in used_b:
                    used_a.add(a)
                    used_b.add(b)
                    keep.append(k)
            yield batch.take(pa.array(keep, pa.int64()))

    return rows.mapInArrow(pair, rows.schema)
