"""Raster queries over a height model made of the parts: 20 pixels wide, a row for every 20 parts."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import rasters
from lodestar.plans.registry import query
from lodestar.session import table


def heights(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    return table(spark, d, "part").select((k % 20).alias("col"), F.floor(k / 20).alias("row"), (F.col("p_size") + (k % 20) * 3).cast("double").alias("z"))


def _box(source: str, values: list[str], width: int, name: str) -> str:
    """CTEs of a square mean: mirrored pixels are added on both sides, then RANGE windows along one direction and the other."""
    p, out, src = width // 2, [], source
    for step, (a, b) in enumerate((("row", "col"), ("col", "row"))):
        most = f"(SELECT max({a}) FROM {source})"
        mirrored = f"SELECT * FROM {src} UNION ALL SELECT * REPLACE (-{a} AS {a}) FROM {src} WHERE {a} BETWEEN 1 AND {p} UNION ALL SELECT * REPLACE (2 * {most} - {a} AS {a}) FROM {src} WHERE {a} BETWEEN {most} - {p} AND {most} - 1"
        means = ", ".join(f"avg({v}) OVER w AS {v}" for v in values)
        out.append(f"{name}{step}m AS ({mirrored}), {name}{step}a AS (SELECT * REPLACE ({means}) FROM {name}{step}m WINDOW w AS (PARTITION BY {b} ORDER BY {a} RANGE BETWEEN {p} PRECEDING AND {p} FOLLOWING))")
        out.append(f"{name}{step} AS (SELECT * FROM {name}{step}a WHERE {a} BETWEEN 0 AND {most})")
        src = f"{name}{step}"
    return ", ".join(out)


def _slope(a: str, b: str) -> str:
    w = f"OVER (PARTITION BY {b} ORDER BY {a})"
    return f"CASE WHEN lag(z) {w} IS NULL THEN lead(z) {w} - z WHEN lead(z) {w} IS NULL THEN z - lag(z) {w} ELSE (lead(z) {w} - lag(z) {w}) / 2 END / 100"


@query(f"""WITH h AS (SELECT p_partkey % 20 AS col, p_partkey // 20 AS row, CAST(p_size + (p_partkey % 20) * 3 AS DOUBLE) AS z FROM part), {_box("h", ["z"], 3, "b")},
flat AS (SELECT h.col, h.row, h.z - b1.z AS z FROM h JOIN b1 USING (col, row)), g AS (SELECT col, row, {_slope('col', 'row')} AS gx, {_slope('row', 'col')} AS gy FROM flat),
t AS (SELECT col, row, gx * gx AS xx, gy * gy AS yy, gx * gy AS xy FROM g), {_box("t", ["xx", "yy", "xy"], 5, "s")},
e AS (SELECT col, row, CASE WHEN xx + yy > 1e-8 THEN sqrt((xx - yy) ** 2 + 4 * xy * xy) / (xx + yy) ELSE 0 END AS coherence, ((degrees(0.5 * atan2(2 * xy, xx - yy)) + 90) % 180 + 180) % 180 AS axis FROM s1)
SELECT col, row, CASE WHEN coherence >= 1e-6 THEN round(axis, 4) % 180 END AS axis, round(coherence, 6) AS coherence FROM e""")
def d27_landform_grain(spark: SparkSession, d: str) -> DataFrame:
    found = rasters.landform_grain(heights(spark, d), 100.0, 100.0, detrend=300.0, smooth=500.0, tile=64)
    return found.select("col", "row", (F.round("axis", 4) % 180).alias("axis"), F.round("coherence", 6).alias("coherence"))
