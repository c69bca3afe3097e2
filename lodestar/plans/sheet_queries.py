"""Sheet queries: a tenth of the vectors is a sheet, with headers of several kinds laid into it."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import sheets
from lodestar.plans.registry import query
from lodestar.session import table

# By number of the sheet % 5: named columns; a house name for the hole; an oxide in parts per million; a metal column; no header.
HEADS = (("Hole ID", "From (m)", "To (m)", "U3O8 %"), ("Company_Ref", "From", "To", "Sample No"), ("DDH", "Start", "End", "U3O8 ppm"), ("BHID", "Sample", "Type", "U ppm"), ("notes", "from", "what", "who"))
_HEAD = "CASE kind " + " ".join(f"WHEN {k} THEN CASE col " + " ".join(f"WHEN {c} THEN '{t}'" for c, t in enumerate(h)) + " END" for k, h in enumerate(HEADS)) + " END"


def cells(spark: SparkSession, d: str) -> DataFrame:
    """A vector is a row of four cells; headers stand in row 2 and, for a second table, in row 51."""
    i = F.col("vec_id")
    e = table(spark, d, "embeddings").select(i, (i % 10).alias("sheet_id"), (F.floor(i / 10) * 2 + 4).alias("row"), (i % 5).cast("int").alias("kind"), F.floor(F.abs(F.col("embedding")[0].cast("double")) * 1000).alias("v"))
    hole = F.when(i % 7 == 0, F.lit("")).otherwise(F.concat(F.lit("AB-"), (i % 90 + 10).cast("string"), F.lit("-"), (i % 50 + 10).cast("string")))
    third = F.when(F.col("kind") == 3, F.when(i % 11 == 0, "Blank").otherwise("core")).otherwise((F.col("v") + 3).cast("string"))
    fourth = F.when(i % 13 == 0, "n/a").when(i % 5 == 0, F.concat(F.lit("<"), (F.col("v") / 100).cast("string"))).otherwise(F.concat(F.col("v").cast("string"), F.lit(",5")))
    second = F.when(F.col("kind") == 3, F.concat(F.lit("S"), i.cast("string"))).otherwise(F.col("v").cast("string"))
    body = e.select("sheet_id", "row", F.posexplode(F.array(hole, second, third, fourth)).alias("col", "value"))
    head = F.array(*(F.array(*map(F.lit, h)) for h in HEADS))
    heads = e.select("sheet_id", "kind").distinct().withColumn("row", F.explode(F.array(F.lit(2).cast("long"), F.lit(51).cast("long"))))
    return body.unionByName(heads.select("sheet_id", "row", F.posexplode(F.get(head, F.col("kind"))).alias("col", "value")))


SHEET = f"""WITH e AS (SELECT vec_id AS i, vec_id % 10 AS sheet_id, vec_id // 10 * 2 + 4 AS row, vec_id % 5 AS kind, CAST(floor(abs(CAST(embedding[1] AS DOUBLE)) * 1000) AS BIGINT) AS v FROM embeddings),
hd AS (SELECT sheet_id, kind, h.r AS row, c.c AS col FROM (SELECT DISTINCT sheet_id, kind FROM e), (VALUES (2), (51)) h(r), (VALUES (0), (1), (2), (3)) c(c)), header AS (SELECT sheet_id, kind, row, col, {_HEAD} AS value FROM hd)"""
# The rows as the sheets' rule has them, straight from the vectors; a row belongs to the second header from row 52 on.
_ROWS = f"""{SHEET}, b AS (SELECT *, CASE WHEN i % 7 = 0 THEN NULL ELSE 'AB-' || (i % 90 + 10) || '-' || (i % 50 + 10) END AS hole, CASE WHEN i % 13 = 0 THEN NULL WHEN i % 5 = 0 THEN v / 100 ELSE v + 0.5 END AS assay, i % 13 <> 0 AND i % 5 = 0 AS low,
  CASE WHEN i % 13 = 0 THEN 'n/a' WHEN i % 5 = 0 THEN '<' || CAST(v / 100 AS VARCHAR) ELSE CAST(v AS VARCHAR) || ',5' END AS printed FROM e WHERE kind < 4)
SELECT sheet_id, row, CAST(HEADROW AS BIGINT) AS header_row, hole AS hole_id, CASE WHEN kind = 1 THEN lower(printed) WHEN kind = 3 THEN 's' || i END AS sample_id,
  CAST(CASE WHEN kind < 3 THEN v END AS DOUBLE) AS from_m, CAST(CASE WHEN kind < 3 THEN v + 3 END AS DOUBLE) AS to_m, CASE WHEN kind = 0 THEN assay WHEN kind = 2 THEN round(assay / 10000, 9) END AS u3o8_pct, CASE WHEN kind = 3 THEN assay END AS u_ppm,
  kind IN (0, 2, 3) AND low AS below_detection, kind = 3 AND i % 11 = 0 AS control FROM b WHERE (hole IS NOT NULL OR kind IN (1, 3)) AND (kind < 3 OR assay IS NOT NULL)"""


def _shown(rows: DataFrame) -> DataFrame:
    return rows.select("sheet_id", "row", "header_row", "hole_id", "sample_id", "from_m", "to_m", F.round("u3o8_pct", 9).alias("u3o8_pct"), "u_ppm", "below_detection", "control")


@query(_ROWS.replace("HEADROW", "2"))
def k3_interval_rows(spark: SparkSession, d: str) -> DataFrame:
    """The first header rules the whole sheet; the second is a row without numbers."""
    c = cells(spark, d)
    return _shown(sheets.intervals(c, sheets.headers(c)))


@query(_ROWS.replace("HEADROW", "CASE WHEN row > 51 THEN 51 ELSE 2 END"))
def k3_interval_rows_by_header(spark: SparkSession, d: str) -> DataFrame:
    c = cells(spark, d)
    return _shown(sheets.intervals(c, sheets.headers(c, every=True)))


_COL = lambda a, b, c, e: f"CASE kind WHEN 0 THEN {a} WHEN 1 THEN {b} WHEN 2 THEN {c} WHEN 3 THEN {e} END"


@query(f"""{SHEET}, look AS (SELECT sheet_id, i FROM e WHERE row BETWEEN 3 AND 27 AND i % 7 <> 0), n AS (SELECT sheet_id, count(*) AS n FROM look GROUP BY sheet_id)
SELECT DISTINCT sheet_id, CAST(2 AS BIGINT) AS row, CAST({_COL('0', 'CASE WHEN n >= 3 THEN 0 END', '0', '0')} AS DOUBLE) AS hole, CAST({_COL('NULL', '3', 'NULL', '1')} AS DOUBLE) AS sample, CAST({_COL('1', '1', '1', 'NULL')} AS DOUBLE) AS from_,
CAST({_COL('3', 'NULL', '3', 'NULL')} AS DOUBLE) AS u3o8, CAST({_COL('NULL', 'NULL', 'NULL', '3')} AS DOUBLE) AS u_ppm FROM header LEFT JOIN n USING (sheet_id) WHERE kind < 4 AND row = 2""")
def k1_header_roles(spark: SparkSession, d: str) -> DataFrame:
    found = sheets.headers(cells(spark, d))
    at = lambda r: F.try_element_at("roles", F.lit(r)).cast("double")
    return found.select("sheet_id", "row", at("hole").alias("hole"), at("sample").alias("sample"), at("from").alias("from_"), at("u3o8").alias("u3o8"), at("u_ppm").alias("u_ppm"))
