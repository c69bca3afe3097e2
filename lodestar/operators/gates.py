"""Gates: every number of a claim must trace to a value it cites; names that must not appear are found or removed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import numbers_in, renderings


def unsupported_numbers(claims: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (claim_id, number) of numbers that no cited value prints as.

    claims: (claim_id, text, cited array of value ids); values: (value_id, value). Whole numbers up to 10 are bare words.
    """
    said = claims.select("claim_id", F.explode(numbers_in(F.col("text"))).alias("number"))
    said = said.where(~F.col("number").rlike(r"^(10|[0-9])$"))
    cited = claims.select("claim_id", F.explode("cited").alias("value_id")).join(values, "value_id")
    allowed = cited.select("claim_id", F.explode(renderings(F.col("value"))).alias("number")).distinct()
    return said.join(allowed, ["claim_id", "number"], "left_anti")


def unknown_citations(claims: DataFrame, values: DataFrame) -> DataFrame:
    """Rows (claim_id, value_id) of citations that name no value."""
    return claims.select("claim_id", F.explode("cited").alias("value_id")).join(values, "value_id", "left_anti").distinct()


def scrub(text: Column, names: list[str], mark: str = "[name]") -> Column:
    """Whole words of a short list replaced, whatever their case. The list is one alternation, so it is read once a row."""
    import re

    if not names:
        return text
    words = "|".join(re.escape(n) for n in sorted(names, key=len, reverse=True))
    return F.regexp_replace(text, rf"(?i)\b(?:{words})\b", mark)


def leaks(texts: DataFrame, id_: str, text: str, names: DataFrame) -> DataFrame:
    """(id, name) where a name of one token stands in a text; names may be many: the join is on tokens."""
    words = texts.select(F.col(id_), F.explode(F.array_distinct(F.regexp_extract_all(F.lower(F.col(text)), F.lit("[a-z0-9à-ÿ]+"), F.lit(0)))).alias("name"))
    return words.join(names.select(F.lower("name").alias("name")).distinct(), "name").select(id_, "name")
