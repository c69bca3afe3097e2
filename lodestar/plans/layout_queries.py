"""Page layout queries: a conversation is a page, its words set ten to a line; values are quoted from its turns, some of them misread."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import locating
from lodestar.plans.registry import query
from lodestar.session import table


def words(spark: SparkSession, d: str) -> DataFrame:
    """(pool, no, text, line, x0, y0, x1, y1): turns in order, ten words to a line."""
    w = table(spark, d, "conversations").select(F.col("conv_id").alias("pool"), "turn", F.posexplode(F.split(F.trim("text"), r"\s+")).alias("at", "text"))
    no = F.row_number().over(Window.partitionBy("pool").orderBy("turn", "at")) - 1
    w = w.where("text <> ''").select("pool", no.alias("no"), "text").withColumn("line", F.floor(F.col("no") / 10))
    x, y = F.col("no") % 10 / 10.0, F.col("line") / 1000.0
    return w.select("pool", "no", "text", "line", x.alias("x0"), y.alias("y0"), (x + 0.09).alias("x1"), (y + 0.0008).alias("y1"))


def values(spark: SparkSession, d: str) -> DataFrame:
    """(value_id, pool, value, quote): of every third turn, one to four words from its middle; by its number as printed, without signs, run together, or misread."""
    c = table(spark, d, "conversations").where("(conv_id + turn) % 3 = 0").withColumn("w", F.split(F.trim("text"), r"\s+"))
    at = F.floor(F.size("w") / 2).cast("int") + 1
    part = F.slice("w", at, (F.col("turn") % 4 + 1).cast("int"))
    plain, k = F.array_join(part, " "), F.col("conv_id") % 5
    told = F.when(k == 1, F.regexp_replace(plain, "[.,]", "")).when(k == 2, F.array_join(part, "")).when(k == 3, F.concat(plain, F.lit("x"))).when(k == 4, F.substring(plain, 1, 3)).otherwise(plain)
    return c.select((F.col("conv_id") * 1000 + F.col("turn")).alias("value_id"), F.col("conv_id").alias("pool"), told.alias("value"), F.array_join(F.slice("w", at, 8), " ").alias("quote"))


@query()
def k8_locate_value(spark: SparkSession, d: str) -> DataFrame:
    """The likeness of strings is beyond SQL; tests hold the operator against a search over all spans."""
    found = locating.locate_values(words(spark, d), values(spark, d))
    return found.select("value_id", F.round("score", 6).alias("score"), "method", "first", "size", "text", "ambiguous", "digits", "note")


@query()
def k8_locate_row(spark: SparkSession, d: str) -> DataFrame:
    """A quote's words are used up one by one, which SQL cannot say; tests hold the operator against a search over all lines."""
    found = locating.locate_rows(words(spark, d), values(spark, d).select(F.col("value_id").alias("row_id"), "pool", "quote"))
    return found.select("row_id", F.round("score", 6).alias("score"), "method", F.get("lines", F.lit(0)).alias("line"), "words", "ambiguous")
