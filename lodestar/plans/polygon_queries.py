"""Polygon queries over a map of `part`: each part a quadrangle of a sheet that leaves no gaps, every fifth size with a hole.

The corners of the sheet are moved off a square lattice by their numbers, so neighbours share their sides exactly.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import polygons
from lodestar.plans.registry import query
from lodestar.plans.spatial_queries import CTE, R, SIZE, X0, cells, points
from lodestar.session import table

CORNERS = ((0, 0), (1, 0), (1, 1), (0, 1))
HOLE = ((-8, -6), (9, -5), (1, 8))


def _corner(gx: Column, gy: Column) -> tuple[Column, Column]:
    return gx * 100 + (gx * 7919 + gy * 104729) % 60 - 2530, gy * 100 + (gx * 1299709 + gy * 15485863) % 60 - 2030


def sheet(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Vertices (poly_id, ring, seq, x, y, domain) and polygons (poly_id, domain, cls)."""
    k = F.col("p_partkey")
    p = table(spark, d, "part").select(k.alias("poly_id"), F.col("p_brand").alias("domain"), F.col("p_type").alias("cls"), "p_size", (k % 50).alias("gx"), F.floor(k / 50).alias("gy"))
    corners = []
    for n, (a, b) in enumerate(CORNERS):
        x, y = _corner(F.col("gx") + a, F.col("gy") + b)
        corners.append(F.struct(F.lit(0).alias("ring"), F.lit(n).alias("seq"), x.alias("x"), y.alias("y")))
    hole = [F.struct(F.lit(1).alias("ring"), F.lit(n).alias("seq"), (F.col("gx") * 100 - 2450 + a).alias("x"), (F.col("gy") * 100 - 1950 + b).alias("y")) for n, (a, b) in enumerate(HOLE)]
    rows = F.when(F.col("p_size") % 5 == 0, F.array(*corners, *hole)).otherwise(F.array(*corners))
    vertices = p.select("poly_id", "domain", "cls", "p_size", F.explode(rows).alias("v")).select("poly_id", "domain", "cls", "p_size", "v.*")
    return vertices, p.select("poly_id", "domain", "cls", "p_size")


def covered(spark: SparkSession, d: str) -> DataFrame:
    vertices, named = sheet(spark, d)
    return polygons.cover(cells(spark), vertices, named, SIZE, X0, X0)


def _node(gx: str, gy: str) -> tuple[str, str]:
    return f"({gx}) * 100 + (({gx}) * 7919 + ({gy}) * 104729) % 60 - 2530", f"({gy}) * 100 + (({gx}) * 1299709 + ({gy}) * 15485863) % 60 - 2030"


def _sides_sql() -> str:
    out = []
    for n, (a, b) in enumerate(CORNERS):
        (x1, y1), (c, e) = _node(f"gx + {a}", f"gy + {b}"), CORNERS[(n + 1) % 4]
        x2, y2 = _node(f"gx + {c}", f"gy + {e}")
        out.append(f"SELECT poly_id, 0 AS ring, CAST({x1} AS DOUBLE) AS x1, CAST({y1} AS DOUBLE) AS y1, CAST({x2} AS DOUBLE) AS x2, CAST({y2} AS DOUBLE) AS y2 FROM poly")
    for n in range(3):
        (a, b), (c, e) = HOLE[(n + 1) % 3], HOLE[n]  # against the shell's direction
        out.append(f"SELECT poly_id, 1, gx * 100 - 2450 + {a}, gy * 100 - 1950 + {b}, gx * 100 - 2450 + {c}, gy * 100 - 1950 + {e} FROM poly WHERE p_size % 5 = 0")
    return " UNION ALL ".join(out)


# Every cell with every side whose box meets the cell's column: the height of the side, held to the cell's range, is integrated in closed form.
_HELD = "CASE WHEN {u} <= ya THEN ya * {u} WHEN {u} >= yb THEN yb * {u} - yb * yb / 2 + ya * ya / 2 ELSE {u} * {u} / 2 + ya * ya / 2 END"
SHEET = f"""{CTE}, poly AS (SELECT p_partkey AS poly_id, p_brand AS domain, p_type AS cls, p_size, p_partkey % 50 AS gx, p_partkey // 50 AS gy FROM part),
side AS ({_sides_sql()}),
meet AS (SELECT c.cell_id, s.poly_id, s.*, cx - {SIZE // 2} AS xa, cx + {SIZE // 2} AS xb, cy - {SIZE // 2} AS ya, cy + {SIZE // 2} AS yb FROM c JOIN poly p ON p.gx * 100 - 2530 < cx + {SIZE // 2} AND p.gx * 100 - 2370 > cx - {SIZE // 2}
  AND p.gy * 100 - 2030 < cy + {SIZE // 2} AND p.gy * 100 - 1870 > cy - {SIZE // 2} JOIN side s ON s.poly_id = p.poly_id WHERE x1 <> x2),
part_of AS (SELECT *, greatest(least(x1, x2), xa) AS xs, least(greatest(x1, x2), xb) AS xe, (y2 - y1) / (x2 - x1) AS m FROM meet),
tall AS (SELECT *, y1 + (xs - x1) * m AS u, y1 + (xe - x1) * m AS w FROM part_of WHERE xe > xs),
whole AS (SELECT cell_id, poly_id, -sum(sign(x2 - x1) * (CASE WHEN m = 0 THEN (greatest(ya, least(yb, u)) - ya) * (xe - xs)
  ELSE (({_HELD.format(u='w')}) - ({_HELD.format(u='u')})) / m - ya * (xe - xs) END)) AS area FROM tall GROUP BY cell_id, poly_id),
cov AS (SELECT w.cell_id, w.area, p.* FROM whole w JOIN poly p USING (poly_id) WHERE area > 0.001)
"""


@query(f"{SHEET} SELECT cell_id, poly_id, round(area, 3) AS area FROM cov")
def c13_polygon_overlay(spark: SparkSession, d: str) -> DataFrame:
    return covered(spark, d).where("area > 0.001").select("cell_id", "poly_id", F.round("area", 3).alias("area"))


_TOP = "b AS (SELECT cell_id, arg_max(cls, (round(area, 6), -poly_id)) AS value_text, count(*) AS n_obs FROM cov GROUP BY cell_id)"


@query(f"{SHEET}, {_TOP} SELECT c.cell_id, value_text, coalesce(n_obs, 0) AS n_obs FROM c LEFT JOIN b USING (cell_id)")
def d6_polygon_class(spark: SparkSession, d: str) -> DataFrame:
    return polygons.largest_class(cells(spark), covered(spark, d).withColumn("area", F.round("area", 6)), "cls")


@query(f"""{SHEET}, {_TOP} SELECT c.cell_id, CASE WHEN contains(lower(value_text), 'econ') OR contains(lower(value_text), 'promo') THEN 1.0
WHEN n_obs > 0 AND col % 3 <> 0 THEN 0.0 END AS value, coalesce(n_obs, 0) AS n_obs FROM c LEFT JOIN b USING (cell_id)""")
def d7_polygon_host(spark: SparkSession, d: str) -> DataFrame:
    """Hosts by words of the class; another class says nothing where the ground is covered."""
    c = cells(spark).withColumn("covered", F.col("col") % 3 == 0)
    return polygons.host(c, covered(spark, d).withColumn("area", F.round("area", 6)), "cls", ["econ", "promo"], "covered")


@query(f"""{SHEET}, {_TOP} SELECT c.cell_id, CASE WHEN contains(lower(value_text), 'econ') OR contains(lower(value_text), 'promo') THEN 1.0
WHEN n_obs > 0 THEN 0.0 END AS value, coalesce(n_obs, 0) AS n_obs FROM c LEFT JOIN b USING (cell_id)""")
def d8_polygon_host_surface(spark: SparkSession, d: str) -> DataFrame:
    return polygons.host(cells(spark), covered(spark, d).withColumn("area", F.round("area", 6)), "cls", ["econ", "promo"])


@query(f"{SHEET}, n AS (SELECT cell_id, count(*) AS value FROM cov WHERE p_size % 2 = 0 GROUP BY cell_id) SELECT c.cell_id, coalesce(value, 0) AS value FROM c LEFT JOIN n USING (cell_id)")
def d9_polygon_overlap_count(spark: SparkSession, d: str) -> DataFrame:
    n = covered(spark, d).where("p_size % 2 = 0 AND area > 0.001").groupBy("cell_id").agg(F.count("*").alias("value"))
    return cells(spark).select("cell_id").join(n, "cell_id", "left").select("cell_id", F.coalesce("value", F.lit(0)).cast("long").alias("value"))


_PAIRS = f"""pair AS (SELECT a.domain AS da, b.domain AS db, {_node('a.gx + 1', 'a.gy')[0]} AS x1, {_node('a.gx + 1', 'a.gy')[1]} AS y1, {_node('a.gx + 1', 'a.gy + 1')[0]} AS x2, {_node('a.gx + 1', 'a.gy + 1')[1]} AS y2
  FROM poly a JOIN poly b ON b.gx = a.gx + 1 AND b.gy = a.gy UNION ALL SELECT a.domain, b.domain, {_node('a.gx', 'a.gy + 1')[0]}, {_node('a.gx', 'a.gy + 1')[1]}, {_node('a.gx + 1', 'a.gy + 1')[0]}, {_node('a.gx + 1', 'a.gy + 1')[1]}
  FROM poly a JOIN poly b ON b.gx = a.gx AND b.gy = a.gy + 1)"""


@query(f"""{SHEET}, {_PAIRS}, t AS (SELECT cell_id, cx, cy, x1, y1, x2, y2, greatest(0, least(1, ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM c, pair WHERE da <> db)
SELECT cell_id, round(min(sqrt((cx - x1 - t * (x2 - x1)) ** 2 + (cy - y1 - t * (y2 - y1)) ** 2)), 3) AS value FROM t GROUP BY cell_id""")
def d21_domain_boundary_distance(spark: SparkSession, d: str) -> DataFrame:
    """The sheet leaves no gaps, so a tiny tolerance finds all contacts."""
    vertices, _ = sheet(spark, d)
    return polygons.boundary_distance(cells(spark), vertices, "domain", 1e-6, 200.0).withColumn("value", F.round("value", 3))


@query(f"""{SHEET}, {_PAIRS}, whole_ring AS (SELECT p.domain, count(*) AS n, sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS l FROM side s JOIN poly p USING (poly_id) GROUP BY p.domain),
inner_ AS (SELECT da AS domain, 2 * count(*) AS n, 2 * sum(sqrt((x2 - x1) ** 2 + (y2 - y1) ** 2)) AS l FROM pair WHERE da = db GROUP BY da)
SELECT w.domain, CAST(w.n - coalesce(i.n, 0) AS BIGINT) AS sides, round(w.l - coalesce(i.l, 0), 3) AS length FROM whole_ring w LEFT JOIN inner_ i USING (domain)""")
def d21_dissolved_domains(spark: SparkSession, d: str) -> DataFrame:
    o = polygons.outline(sheet(spark, d)[0], "domain")
    length = F.sqrt(F.pow(F.col("x2") - F.col("x1"), 2) + F.pow(F.col("y2") - F.col("y1"), 2))
    return o.groupBy("domain").agg(F.count("*").alias("sides"), F.round(F.sum(length), 3).alias("length"))


@query(f"""{SHEET}, sh AS (SELECT cell_id, cls AS unit, sum(area) / {SIZE * SIZE}.0 AS share FROM cov GROUP BY cell_id, cls)
SELECT cell_id, unit, round(share, 6) AS share, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY round(share, 9) DESC, unit) AS INTEGER) AS rank FROM sh""")
def d35_unit_shares(spark: SparkSession, d: str) -> DataFrame:
    return polygons.unit_shares(covered(spark, d), "cls", SIZE).withColumn("share", F.round("share", 6))


@query(f"""{SHEET}, a AS (SELECT poly_id, -sum((x2 - x1) * (y1 + y2) / 2) AS area FROM side GROUP BY poly_id), g AS (SELECT domain, cls, sum(area) AS area FROM a JOIN poly USING (poly_id) GROUP BY domain, cls)
SELECT domain, cls AS "group", round(area / sum(area) OVER (PARTITION BY domain), 6) AS share FROM g""")
def d36_domain_shares(spark: SparkSession, d: str) -> DataFrame:
    vertices, named = sheet(spark, d)
    return polygons.character(vertices, named, "domain", "cls").withColumn("share", F.round("share", 6))


@query(f"""{SHEET}, t AS (SELECT DISTINCT cell_id, 2 AS t FROM cov WHERE p_size % 25 = 7 UNION ALL SELECT DISTINCT cell_id, 1 FROM j WHERE label = 3 AND d2 <= {R * R // 4}), b AS (SELECT cell_id, max(t) AS t FROM t GROUP BY cell_id)
SELECT c.cell_id, CASE WHEN t = 2 THEN 'deposit' WHEN t = 1 THEN 'occurrence' ELSE 'unlabelled' END AS tier FROM c LEFT JOIN b USING (cell_id)""")
def i34_polygon_labels(spark: SparkSession, d: str) -> DataFrame:
    deposits = sheet(spark, d)[0].where("p_size % 25 = 7")
    return polygons.label_tiers(cells(spark), deposits, SIZE, points(spark, d).where("label = 3"), R / 2, X0, X0)
