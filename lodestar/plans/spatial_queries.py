"""Spatial queries. Points are the first two components of the vectors as integers, so distances are exact."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.operators import footprints, positions, spatial
from lodestar.plans.registry import query
from lodestar.session import table

SIZE, SIDE, R = 500, 12, 400
X0 = -SIZE * SIDE // 2

CTE = f"""
WITH p AS (SELECT vec_id AS id, CAST(label AS BIGINT) AS label,
    CAST(floor(CAST(embedding[1] AS DOUBLE) * 10000) AS BIGINT) AS x,
    CAST(floor(CAST(embedding[2] AS DOUBLE) * 10000) AS BIGINT) AS y,
    CAST(floor(CAST(embedding[3] AS DOUBLE) * 10000) AS BIGINT) AS v FROM embeddings),
c AS (SELECT printf('%04d_%04d', a.i, b.i) AS cell_id, CAST(a.i AS INTEGER) AS col, CAST(b.i AS INTEGER) AS row,
    CAST({X0} + a.i * {SIZE} + {SIZE // 2} AS DOUBLE) AS cx, CAST({X0} + b.i * {SIZE} + {SIZE // 2} AS DOUBLE) AS cy
    FROM generate_series(0, {SIDE - 1}) a(i), generate_series(0, {SIDE - 1}) b(i)),
j AS (SELECT c.cell_id, c.cx, c.cy, p.*, (p.x - c.cx) * (p.x - c.cx) + (p.y - c.cy) * (p.y - c.cy) AS d2 FROM c, p),
near AS (SELECT * FROM j WHERE d2 <= {R * R}),
s0 AS (SELECT label AS line_id, id AS seq, x AS x1, y AS y1, lead(x) OVER w AS x2, lead(y) OVER w AS y2 FROM p
    WINDOW w AS (PARTITION BY label ORDER BY id)),
s AS (SELECT *, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS length, (x1 + x2) / 2 AS mx, (y1 + y2) / 2 AS my,
    (degrees(atan2(CAST(x2 - x1 AS DOUBLE), CAST(y2 - y1 AS DOUBLE))) % 180 + 180) % 180 AS axis FROM s0 WHERE x2 IS NOT NULL),
r AS (SELECT p_partkey AS rect_id, p_type AS cls, CAST((p_partkey * 7919) % 5000 - 2500 AS DOUBLE) AS x0,
    CAST((p_partkey * 104729) % 5000 - 2500 AS DOUBLE) AS y0, p_size FROM part),
rect AS (SELECT rect_id, cls, x0, y0, x0 + p_size * 20 AS x1, y0 + p_size * 13 AS y1 FROM r)
"""


def points(spark: SparkSession, d: str) -> DataFrame:
    scaled = lambda k: F.floor(F.col("embedding")[k].cast("double") * 10000).cast("long")
    t = table(spark, d, "embeddings")
    return t.select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("label"), scaled(0).alias("x"), scaled(1).alias("y"), scaled(2).alias("v"))


def cells(spark: SparkSession) -> DataFrame:
    return spatial.grid(spark, X0, X0, SIDE, SIDE, SIZE)


def lines(spark: SparkSession, d: str) -> DataFrame:
    return spatial.segments(points(spark, d), "label", "id")


def rects(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_partkey")
    t = table(spark, d, "part").select(k.alias("rect_id"), F.col("p_type").alias("cls"), (k * 7919 % 5000 - 2500).cast("double").alias("x0"), (k * 104729 % 5000 - 2500).cast("double").alias("y0"), "p_size")
    return t.select("rect_id", "cls", "x0", "y0", (F.col("x0") + F.col("p_size") * 20).alias("x1"), (F.col("y0") + F.col("p_size") * 13).alias("y1"))


@query(f"{CTE} SELECT cell_id, count(*) AS n, sum(id) AS id_sum FROM near GROUP BY cell_id")
def c10_radius_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.radius_join(cells(spark), points(spark, d), R).groupBy("cell_id").agg(F.count("*").alias("n"), F.sum("id").alias("id_sum"))


@query(f"{CTE} SELECT cell_id, id, rank FROM (SELECT cell_id, id, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY d2, id) AS INTEGER) AS rank FROM j) WHERE rank <= 3")
def c11_knn_join(spark: SparkSession, d: str) -> DataFrame:
    return spatial.knn_join(cells(spark), points(spark, d), 3, R).select("cell_id", "id", "rank")


@query(f"{CTE} SELECT cell_id, id AS nearest_id, round(sqrt(d2), 6) AS distance FROM (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, id) AS k FROM j) WHERE k = 1")
def c9_nearest_one(spark: SparkSession, d: str) -> DataFrame:
    near = spatial.knn_join(cells(spark), points(spark, d), 1, R)
    return near.select("cell_id", F.col("id").alias("nearest_id"), F.round(F.sqrt("d2"), 6).alias("distance"))


@query(f"{CTE} SELECT cell_id, label, round(sqrt(min(d2)), 6) AS distance FROM j GROUP BY cell_id, label")
def c8_nearest_by_label(spark: SparkSession, d: str) -> DataFrame:
    """The points are read once and reduced with map-side combine; the cells are a fixed grid, so their size is bounded."""
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    pairs = points(spark, d).crossJoin(F.broadcast(cells(spark)))
    return pairs.groupBy("cell_id", "label").agg(F.round(F.sqrt(F.min(d2)), 6).alias("distance"))


@query(f"""{CTE}, a AS (SELECT cell_id, count(*) AS hits, count(v) AS n_obs, CAST(max(v) AS DOUBLE) AS max_value, round(avg(v), 6) AS mean_value,
    round(quantile_cont(CAST(v AS DOUBLE), 0.9), 6) AS p90_value, round(sqrt(min(d2)), 6) AS nearest FROM near GROUP BY cell_id)
SELECT c.cell_id, coalesce(hits, 0) AS hits, coalesce(n_obs, 0) AS n_obs, max_value, mean_value, p90_value, nearest FROM c LEFT JOIN a USING (cell_id)""")
def d3_point_stats(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.point_stats(cells(spark), points(spark, d), "v", R)
    return out.withColumns({c: F.round(c, 6) for c in ("mean_value", "p90_value", "nearest")})


@query(f"""{CTE}, k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY d2, id) AS n FROM near),
a AS (SELECT cell_id, round(CASE WHEN min(d2) < 1 THEN arg_min(CAST(v AS DOUBLE), n) ELSE sum(v / greatest(d2, 1)) / sum(1 / greatest(d2, 1)) END, 6) AS value,
    count(*) AS n_obs, round(sqrt(min(d2)), 6) AS nearest FROM k WHERE n <= 8 GROUP BY cell_id)
SELECT c.cell_id, value, coalesce(n_obs, 0) AS n_obs, nearest FROM c LEFT JOIN a USING (cell_id)""")
def d5_inverse_distance(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.inverse_distance(cells(spark), points(spark, d), "v", 8, R)
    return out.withColumns({"value": F.round("value", 6), "nearest": F.round("nearest", 6)})


@query(f"""{CTE}, b AS (SELECT quantile_cont(CAST(v AS DOUBLE), 0.75) AS bar FROM p),
a AS (SELECT cell_id, count(*) AS n_obs, CASE WHEN count(*) >= 3 THEN round(avg(CASE WHEN v > bar THEN 1.0 ELSE 0.0 END), 6) END AS share FROM near, b GROUP BY cell_id)
SELECT c.cell_id, coalesce(n_obs, 0) AS n_obs, share FROM c LEFT JOIN a USING (cell_id)""")
def d11_share_above(spark: SparkSession, d: str) -> DataFrame:
    return spatial.share_above(cells(spark), points(spark, d), "v", 0.75, R).withColumn("share", F.round("share", 6))


@query(f"""{CTE}, t AS (SELECT *, ((degrees(atan2(x - cx, y - cy)) - 225) % 360 + 360) % 360 AS turn FROM j WHERE d2 BETWEEN 10000 AND 1000000),
a AS (SELECT cell_id, CAST(max(v) AS DOUBLE) AS max_value, count(*) AS n_obs FROM t WHERE least(turn, 360 - turn) <= 30 GROUP BY cell_id)
SELECT c.cell_id, max_value, coalesce(n_obs, 0) AS n_obs FROM c LEFT JOIN a USING (cell_id)""")
def d15_point_cone(spark: SparkSession, d: str) -> DataFrame:
    return spatial.cone_max(cells(spark), points(spark, d), "v", 225.0, 30.0, 100, 1000)


@query(f"""{CTE} SELECT cell_id, round(CASE WHEN count(v) FILTER (WHERE label >= 1) = 0 THEN NULL ELSE avg(greatest(v, 0) / label) FILTER (WHERE label >= 1) END, 6) AS mean_ratio,
count(*) FILTER (WHERE label >= 1) AS n_obs FROM near GROUP BY cell_id""")
def d10_point_ratio(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("ratio", F.when(F.col("label") >= 1, F.greatest(F.col("v"), F.lit(0)) / F.col("label")))
    near = spatial.radius_join(cells(spark), p, R)
    return near.groupBy("cell_id").agg(F.round(F.avg("ratio"), 6).alias("mean_ratio"), F.count("ratio").alias("n_obs"))


@query(f"{CTE} SELECT line_id, seq, round(length, 6) AS length, round(axis, 6) AS axis FROM s")
def d16_segments(spark: SparkSession, d: str) -> DataFrame:
    return lines(spark, d).select("line_id", "seq", F.round("length", 6).alias("length"), F.round("axis", 6).alias("axis"))


@query(f"""{CTE}, w AS (SELECT line_id, sum(length * sin(radians(2 * axis))) AS a, sum(length * cos(radians(2 * axis))) AS b, sum(length) AS l FROM s GROUP BY line_id)
SELECT line_id, round(((degrees(atan2(a, b)) / 2) % 180 + 180) % 180, 6) AS mean_axis, round(sqrt(a * a + b * b) / l, 6) AS coherence FROM w""")
def d13_regional_axis(spark: SparkSession, d: str) -> DataFrame:
    twice = F.radians(2 * F.col("axis"))
    a, b = F.sum(F.col("length") * F.sin(twice)), F.sum(F.col("length") * F.cos(twice))
    return lines(spark, d).groupBy("line_id").agg(F.round(geo.mean_axis(F.col("axis"), F.col("length")), 6).alias("mean_axis"), F.round(F.sqrt(a * a + b * b) / F.sum("length"), 6).alias("coherence"))


@query(f"""{CTE}, m AS (SELECT c.cell_id, s.length, CAST(floor((axis + 22.5) / 45) AS INTEGER) % 4 AS k FROM c, s WHERE (mx - cx) * (mx - cx) + (my - cy) * (my - cy) <= {R * R}),
a AS (SELECT cell_id, sum(CASE WHEN k = 0 THEN length ELSE 0 END) AS ns, sum(CASE WHEN k = 1 THEN length ELSE 0 END) AS ne, sum(CASE WHEN k = 2 THEN length ELSE 0 END) AS ew, sum(CASE WHEN k = 3 THEN length ELSE 0 END) AS nw FROM m GROUP BY cell_id)
SELECT c.cell_id, round(coalesce(ns, 0), 4) AS ns, round(coalesce(ne, 0), 4) AS ne, round(coalesce(ew, 0), 4) AS ew, round(coalesce(nw, 0), 4) AS nw FROM c LEFT JOIN a USING (cell_id)""")
def d17_length_by_trend(spark: SparkSession, d: str) -> DataFrame:
    out = spatial.length_by_trend(cells(spark), lines(spark, d), R)
    return out.withColumns({c: F.round(c, 4) for c in ("ns", "ne", "ew", "nw")})


@query(f"""{CTE}, q AS (SELECT c.cell_id, cx, cy, s.*, CASE WHEN length > 0 THEN greatest(0, least(1, ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / (length * length))) ELSE 0 END AS t FROM c, s)
SELECT cell_id, round(sqrt(min(power(cx - x1 - t * (x2 - x1), 2) + power(cy - y1 - t * (y2 - y1), 2))), 4) AS value FROM q GROUP BY cell_id""")
def d1_distance_to_lines(spark: SparkSession, d: str) -> DataFrame:
    return spatial.line_distance(cells(spark), lines(spark, d)).withColumn("value", F.round("value", 4))


_SPAN = "CASE WHEN {b} = {a} THEN CASE WHEN {a} BETWEEN {l} AND {h} THEN {in_} ELSE {out} END ELSE {f}(({l} - {a}) / ({b} - {a}), ({h} - {a}) / ({b} - {a})) END"
_AX = {"a": "x1", "b": "x2", "l": "(cx - 250)", "h": "(cx + 250)"}
_AY = {"a": "y1", "b": "y2", "l": "(cy - 250)", "h": "(cy + 250)"}
_FIRST = [_SPAN.format(**k, in_="0.0", out="1.0", f="least") for k in (_AX, _AY)]
_LAST = [_SPAN.format(**k, in_="1.0", out="0.0", f="greatest") for k in (_AX, _AY)]


@query(f"""{CTE}, k AS (SELECT cell_id, length * greatest(0, least(1.0, {_LAST[0]}, {_LAST[1]}) - greatest(0.0, {_FIRST[0]}, {_FIRST[1]})) AS piece FROM c, s)
SELECT cell_id, round(sum(piece) / {SIZE * SIZE}, 8) AS value, count(*) FILTER (WHERE piece > 1e-9) AS n_obs FROM k GROUP BY cell_id""")
def d2_line_density(spark: SparkSession, d: str) -> DataFrame:
    return spatial.line_density(cells(spark), lines(spark, d), SIZE).withColumn("value", F.round("value", 8))


_SIDE = "(({o}.x2 - {o}.x1) * ({t}.y{e} - {o}.y1) - ({o}.y2 - {o}.y1) * ({t}.x{e} - {o}.x1))"
_A, _B, _C, _D = (_SIDE.format(o=o, t=t, e=e) for o, t, e in (("p", "q", 1), ("p", "q", 2), ("q", "p", 1), ("q", "p", 2)))


CROSS = f"""z0 AS (SELECT p.x1, p.y1, p.x2, p.y2, q.x1 AS u1, q.y1 AS v1, q.x2 AS u2, q.y2 AS v2, CAST({_C} AS DOUBLE) / ({_C} - {_D}) AS t FROM s p, s q
    WHERE p.line_id < q.line_id AND sign({_A}) * sign({_B}) < 0 AND sign({_C}) * sign({_D}) < 0), z1 AS (SELECT *, x1 + t * (x2 - x1) AS x, y1 + t * (y2 - y1) AS y FROM z0),
z AS (SELECT DISTINCT CAST(floor(x + 0.5) AS BIGINT) AS x, CAST(floor(y + 0.5) AS BIGINT) AS y FROM z1 WHERE (x - x1) ** 2 + (y - y1) ** 2 > 1 AND (x - x2) ** 2 + (y - y2) ** 2 > 1 AND (x - u1) ** 2 + (y - v1) ** 2 > 1 AND (x - u2) ** 2 + (y - v2) ** 2 > 1)"""


@query(f"{CTE}, {CROSS} SELECT x, y FROM z")
def c14_line_crossings(spark: SparkSession, d: str) -> DataFrame:
    return spatial.crossings(lines(spark, d), SIZE)


@query(f"""{CTE}, o AS (SELECT cell_id, rect_id, cls, greatest(0, least(x1, cx + 250) - greatest(x0, cx - 250)) * greatest(0, least(y1, cy + 250) - greatest(y0, cy - 250)) AS area FROM c, rect),
k AS (SELECT *, row_number() OVER (PARTITION BY cell_id ORDER BY area DESC, rect_id) AS n FROM o WHERE area > 0)
SELECT c.cell_id, max(cls) FILTER (WHERE n = 1) AS cls, count(rect_id) AS n_obs FROM c LEFT JOIN k USING (cell_id) GROUP BY c.cell_id""")
def d6_rectangle_class(spark: SparkSession, d: str) -> DataFrame:
    return spatial.rectangle_class(cells(spark), rects(spark, d), SIZE)


@query(f"""{CTE}, o AS (SELECT cell_id, cls, greatest(0, least(x1, cx + 250) - greatest(x0, cx - 250)) * greatest(0, least(y1, cy + 250) - greatest(y0, cy - 250)) AS area FROM c, rect)
SELECT cell_id, cls, sum(area) AS area, round(sum(area) / sum(sum(area)) OVER (PARTITION BY cell_id), 6) AS share FROM o WHERE area > 0 GROUP BY cell_id, cls""")
def d36_class_share(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    by = spatial.rectangle_overlaps(cells(spark), rects(spark, d), SIZE).groupBy("cell_id", "cls").agg(F.sum("area").alias("area"))
    return by.withColumn("share", F.round(F.col("area") / F.sum("area").over(Window.partitionBy("cell_id")), 6))


@query(f"{CTE} SELECT cell_id, col, row, cx, cy FROM c")
def d23_grid(spark: SparkSession, d: str) -> DataFrame:
    return cells(spark)


@query(f"""{CTE} SELECT printf('%04d_%04d', CAST(floor((x - {X0}) / {SIZE}) AS INTEGER), CAST(floor((y - {X0}) / {SIZE}) AS INTEGER)) AS cell_id, round(avg(v), 6) AS mean_value,
CAST(min(v) AS DOUBLE) AS min_value, CAST(max(v) AS DOUBLE) AS max_value, CAST(max(v) - min(v) AS DOUBLE) AS relief, count(v) AS n_obs FROM p WHERE x >= {X0} AND y >= {X0} GROUP BY 1""")
def d26_zonal_stats(spark: SparkSession, d: str) -> DataFrame:
    return spatial.zonal(points(spark, d), X0, X0, SIZE, "v").withColumn("mean_value", F.round("mean_value", 6))


@query(f"""{CTE}, k AS (SELECT CAST(floor(x / {SIZE}) AS BIGINT) AS i, CAST(floor(y / {SIZE}) AS BIGINT) AS j, label FROM p),
g AS (SELECT i, j, count(*) AS n, count(*) FILTER (WHERE label >= 8) AS cloud, count(*) FILTER (WHERE label < 4) AS low FROM k GROUP BY i, j)
SELECT i, j, n, CASE WHEN cloud <= 0.35 * n AND n > cloud THEN round(low / (n - cloud), 6) END AS fraction FROM g""")
def d25_zonal_fraction(spark: SparkSession, d: str) -> DataFrame:
    """Share of a class among valid pixels; unknown where over 35 % of the pixels are clouded."""
    g = points(spark, d).groupBy(F.floor(F.col("x") / SIZE).alias("i"), F.floor(F.col("y") / SIZE).alias("j")).agg(F.count("*").alias("n"), F.count_if(F.col("label") >= 8).alias("cloud"), F.count_if(F.col("label") < 4).alias("low"))
    valid = F.col("n") - F.col("cloud")
    return g.select("i", "j", "n", F.when((F.col("cloud") <= 0.35 * F.col("n")) & (valid > 0), F.round(F.col("low") / valid, 6)).alias("fraction"))


@query(f"""{CTE} SELECT label, arg_min(id, [CAST(round(abs(v) / 20) AS BIGINT), abs(x), id]) AS best_id FROM p GROUP BY label""")
def d28_best_scene(spark: SparkSession, d: str) -> DataFrame:
    rank = F.struct(F.round(F.abs("v") / 20).cast("long"), F.abs("x"), F.col("id"))
    return points(spark, d).groupBy("label").agg(F.min_by("id", rank).alias("best_id"))


_DEG = "(x / 100.0)", "(y / 100.0)"


@query(f"""{CTE} SELECT id, round(2 * 6371 * asin(sqrt(least(1.0, power(sin((radians(y / 100.0) - radians(10.0)) / 2), 2) + cos(radians(10.0)) * cos(radians(y / 100.0)) * power(sin(radians(x / 100.0 - 20.0) / 2), 2)))), 4) AS km,
round((degrees(atan2(x - 100.0, y - 100.0)) % 360 + 360) % 360, 4) AS bearing, CASE WHEN x / 100.0 BETWEEN -180 AND 180 THEN CAST(least(60, floor((x / 100.0 + 180) / 6) + 1) AS INTEGER) END AS zone,
(['N','NE','E','SE','S','SW','W','NW'])[1 + CAST(floor(((degrees(atan2(x - 100.0, y - 100.0)) % 360 + 360) % 360 + 22.5) / 45) AS INTEGER) % 8] AS compass FROM p""")
def d29_haversine_bearing(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = F.col("x") / 100.0, F.col("y") / 100.0
    b = geo.bearing(F.col("x") - 100, F.col("y") - 100)
    return points(spark, d).select("id", F.round(geo.haversine_km(F.lit(20.0), F.lit(10.0), lon, lat), 4).alias("km"), F.round(b, 4).alias("bearing"), geo.utm_zone(lon).alias("zone"), geo.compass(b).alias("compass"))


@query(f"""{CTE}, n AS (SELECT cell_id, count(*) AS n, round(sqrt(min(d2)), 6) AS nearest FROM near WHERE label <> 0 GROUP BY cell_id),
f AS (SELECT DISTINCT cell_id FROM j WHERE d2 <= 4 * {R * R} AND label <> 0)
SELECT c.cell_id, CASE WHEN n.n IS NOT NULL THEN 'present' WHEN f.cell_id IS NOT NULL THEN 'absent' ELSE 'unknown' END AS state, coalesce(n.n, 0) AS n, nearest
FROM c LEFT JOIN n USING (cell_id) LEFT JOIN f USING (cell_id)""")
def d31_footprint_state(spark: SparkSession, d: str) -> DataFrame:
    """Present, absent (the layer covers the cell and shows nothing) or unknown (not covered): three states, never a zero."""
    p, c = points(spark, d).where("label <> 0"), cells(spark).select("cell_id", "cx", "cy")
    near = spatial.radius_join(c, p, R).groupBy("cell_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.min("d2")), 6).alias("nearest"))
    covered = spatial.radius_join(c, p, 2 * R).select("cell_id").distinct().withColumn("__in", F.lit(True))
    out = c.join(near, "cell_id", "left").join(covered, "cell_id", "left")
    state = F.when(F.col("n").isNotNull(), "present").when(F.col("__in"), "absent").otherwise("unknown")
    return out.select("cell_id", state.alias("state"), F.coalesce("n", F.lit(0)).cast("long").alias("n"), "nearest")


@query(f"""{CTE} SELECT cell_id, id, rank, round(sqrt(d2), 6) AS distance, round((degrees(atan2(x - cx, y - cy)) % 360 + 360) % 360, 4) AS bearing FROM
(SELECT *, CAST(row_number() OVER (PARTITION BY cell_id ORDER BY d2, id) AS INTEGER) AS rank FROM near) WHERE rank <= 5""")
def d32_nearby(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    near = spatial.radius_join(cells(spark), points(spark, d), R).withColumn("rank", F.row_number().over(Window.partitionBy("cell_id").orderBy("d2", "id")))
    return near.where("rank <= 5").select("cell_id", "id", "rank", F.round(F.sqrt("d2"), 6).alias("distance"), F.round(geo.bearing(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), 4).alias("bearing"))


@query(f"""{CTE}, t AS (SELECT *, 1960 + v % 60 AS year FROM near WHERE id % 4 <> 0), a AS (SELECT cell_id, min(year) AS first_year, max(year) AS last_year, count(*) AS n_obs, round(sqrt(min(d2)), 6) AS nearest FROM t GROUP BY cell_id)
SELECT c.cell_id, CAST(first_year AS DOUBLE) AS first_year, CAST(last_year AS DOUBLE) AS last_year, coalesce(n_obs, 0) AS n_obs, nearest FROM c LEFT JOIN a USING (cell_id)""")
def d4_year_near(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d).withColumn("year", F.when(F.col("id") % 4 != 0, 1960 + F.col("v") % 60))
    out = spatial.year_near(cells(spark), p, "year", R)
    return out.select("cell_id", F.col("first_year").cast("double").alias("first_year"), F.col("last_year").cast("double").alias("last_year"), "n_obs", F.round("nearest", 6).alias("nearest"))


@query(f"""{CTE}, g AS (SELECT cell_id, (col * 37 + row * 11) % 180 AS grain, (col * 7 + row * 3) % 10 / 10.0 AS coh FROM c), k AS (SELECT cell_id, CASE WHEN coh >= 0.5 THEN (grain + 90) % 180 END AS axis, coh FROM g),
m AS (SELECT ((degrees(atan2(sum(coh * sin(radians(2 * axis))), sum(coh * cos(radians(2 * axis))))) / 2) % 180 + 180) % 180 AS mean FROM k WHERE axis IS NOT NULL), x AS (SELECT cell_id, coalesce(axis, mean) AS a, axis IS NOT NULL AS own FROM k, m),
o AS (SELECT *, abs(((a - 225 + 180) % 360 + 360) % 360 - 180) AS near_, abs(((a + 180 - 225 + 180) % 360 + 360) % 360 - 180) AS far_ FROM x) SELECT cell_id, round(CASE WHEN near_ <= far_ THEN a ELSE a + 180 END, 6) AS bearing, own FROM o""")
def d14_flow_frame(spark: SparkSession, d: str) -> DataFrame:
    g = cells(spark).select("cell_id", ((F.col("col") * 37 + F.col("row") * 11) % 180).alias("grain"), ((F.col("col") * 7 + F.col("row") * 3) % 10 / 10.0).alias("coh"))
    return spatial.flow_frame(g, "grain", "coh").select("cell_id", F.round("bearing", 6).alias("bearing"), "own")


_AREA = "greatest(0, least(x1, cx + 250) - greatest(x0, cx - 250)) * greatest(0, least(y1, cy + 250) - greatest(y0, cy - 250))"


@query(f"{CTE}, o AS (SELECT cell_id, rect_id FROM c, rect WHERE {_AREA} > 0) SELECT c.cell_id, count(DISTINCT rect_id) AS value FROM c LEFT JOIN o USING (cell_id) GROUP BY c.cell_id")
def d9_overlap_count(spark: SparkSession, d: str) -> DataFrame:
    return spatial.overlap_count(cells(spark), rects(spark, d), SIZE)


_BEST = f"o AS (SELECT cell_id, cls, row_number() OVER (PARTITION BY cell_id ORDER BY {_AREA} DESC, rect_id) AS k FROM c, rect WHERE {_AREA} > 0 AND rect_id % 3 = 0)"


@query(f"{CTE}, {_BEST} SELECT c.cell_id, CASE WHEN contains(cls, 'STEEL') THEN 1.0 WHEN cls IS NOT NULL AND NOT (col % 3 = 0) THEN 0.0 END AS value FROM c LEFT JOIN (SELECT * FROM o WHERE k = 1) b USING (cell_id)")
def d7_host(spark: SparkSession, d: str) -> DataFrame:
    """Known hosts and known others; a mapped class under cover says nothing unless it is the host."""
    c = cells(spark).withColumn("covered", F.col("col") % 3 == 0)
    return spatial.host_of(c, rects(spark, d).where("rect_id % 3 = 0"), SIZE, "STEEL", "covered")


@query(f"{CTE}, {_BEST} SELECT c.cell_id, CASE WHEN contains(cls, 'STEEL') THEN 1.0 WHEN cls IS NOT NULL THEN 0.0 END AS value FROM c LEFT JOIN (SELECT * FROM o WHERE k = 1) b USING (cell_id)")
def d8_host_surface(spark: SparkSession, d: str) -> DataFrame:
    return spatial.host_of(cells(spark), rects(spark, d).where("rect_id % 3 = 0"), SIZE, "STEEL")


RING = [(-2100, -1700), (300, -2300), (2050, -900), (900, 450), (1900, 2100), (-700, 1500), (-1500, 2050), (-2300, 100)]
_RING = " UNION ALL ".join(f"SELECT {a[0]} AS x1, {a[1]} AS y1, {b[0]} AS x2, {b[1]} AS y2" for a, b in zip(RING, [*RING[1:], RING[0]], strict=True))


@query(f"""{CTE}, g AS ({_RING}), t AS (SELECT cell_id, cx, cy, g.*, greatest(0, least(1, ((cx - x1) * (x2 - x1) + (cy - y1) * (y2 - y1)) / ((x2 - x1) ** 2 + (y2 - y1) ** 2))) AS t FROM c, g),
a AS (SELECT cell_id, sqrt(min((cx - x1 - t * (x2 - x1)) ** 2 + (cy - y1 - t * (y2 - y1)) ** 2)) AS far_, count(*) FILTER (WHERE (y1 > cy) <> (y2 > cy) AND cx < x1 + (cy - y1) * (x2 - x1) / (y2 - y1)) % 2 AS odd FROM t GROUP BY cell_id)
SELECT cell_id, round(CASE WHEN odd = 1 THEN far_ ELSE -far_ END, 6) AS value FROM a""")
def d19_edge_distance(spark: SparkSession, d: str) -> DataFrame:
    ring = spark.createDataFrame([(*a, *b) for a, b in zip(RING, [*RING[1:], RING[0]], strict=True)], "x1 long, y1 long, x2 long, y2 long")
    return spatial.edge_distance(cells(spark), ring).withColumn("value", F.round("value", 6))


@query(f"""{CTE}, n AS (SELECT cell_id, count(*) FILTER (WHERE label = 1) AS na, count(*) FILTER (WHERE label = 2) AS nb FROM near GROUP BY cell_id), f AS (SELECT cell_id, bool_or(label = 1) AS ia, bool_or(label = 2) AS ib FROM j WHERE d2 <= {4 * R * R} GROUP BY cell_id),
g AS (SELECT a.cell_id, min(sqrt((a.x - b.x) ** 2 + (a.y - b.y) ** 2)) AS gap FROM near a JOIN near b USING (cell_id) WHERE a.label = 1 AND b.label = 2 GROUP BY a.cell_id),
k AS (SELECT c.cell_id, coalesce(na, 0) AS na, coalesce(nb, 0) AS nb, coalesce(ia, false) AS ia, coalesce(ib, false) AS ib, gap FROM c LEFT JOIN n USING (cell_id) LEFT JOIN f USING (cell_id) LEFT JOIN g USING (cell_id))
SELECT cell_id, CASE WHEN na >= 3 THEN 'known' WHEN na > 0 THEN 'thin' ELSE 'absent' END AS state_a, CASE WHEN nb >= 3 THEN 'known' WHEN nb > 0 THEN 'thin' ELSE 'absent' END AS state_b,
CASE WHEN na > 0 AND nb > 0 THEN 'known' WHEN (na = 0 AND NOT ia) OR (nb = 0 AND NOT ib) THEN 'unknown' ELSE 'absent' END AS state, round(gap, 6) AS gap FROM k""")
def d33_layer_pairs(spark: SparkSession, d: str) -> DataFrame:
    p = points(spark, d)
    out = spatial.layer_pairs(cells(spark), p.where("label = 1"), p.where("label = 2"), R)
    return out.withColumn("gap", F.round("gap", 6))


def _geodesic_sql(rounds: int) -> str:
    """Vincenty's iteration as a chain of tables, one for each round."""
    f, b = 1 / 298.257223563, 6378137.0 * (1 - 1 / 298.257223563)
    angles = "SELECT *, atan2(ss, cs) AS s, 1 - sa * sa AS c2, coalesce(cs - 2 * s1 * s2 / nullif(1 - sa * sa, 0), 0) AS m FROM (SELECT *, c1 * c2_ * sin(lam) / nullif(ss, 0) AS sa FROM (SELECT *, sqrt((c2_ * sin(lam)) ** 2 + (c1 * s2 - s1 * c2_ * cos(lam)) ** 2) AS ss, s1 * s2 + c1 * c2_ * cos(lam) AS cs FROM {0}))"
    out = [f"g0 AS (SELECT *, l AS lam, CAST(9 AS DOUBLE) AS prev FROM (SELECT id, sin(u1) AS s1, cos(u1) AS c1, sin(u2) AS s2, cos(u2) AS c2_, radians(lon - 20) AS l FROM (SELECT *, atan({1 - f!r} * tan(radians(10))) AS u1, atan({1 - f!r} * tan(radians(lat))) AS u2 FROM ll)))"]
    for k in range(rounds):
        out.append(f"g{k + 1} AS (SELECT id, s1, c1, s2, c2_, l, l + (1 - c) * {f!r} * sa * (s + c * ss * (m + c * cs * (2 * m * m - 1))) AS lam, lam AS prev FROM (SELECT *, {f / 16!r} * c2 * (4 + {f!r} * (4 - 3 * c2)) AS c FROM ({angles.format(f'g{k}')})))")
    out.append(f"done AS (SELECT *, c2 * {(6378137.0**2 - b**2) / b**2!r} AS u FROM ({angles.format(f'g{rounds}')}))")
    out.append("big AS (SELECT *, 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u))) AS aa, u / 1024 * (256 + u * (-128 + u * (74 - 47 * u))) AS bb FROM done)")
    metres = f"{b!r} * aa * (s - bb * ss * (m + bb / 4 * (cs * (2 * m * m - 1) - bb / 6 * m * (4 * ss * ss - 3) * (4 * m * m - 3))))"
    return ", ".join(out) + f" SELECT id, CASE WHEN abs(lam - prev) < 1e-11 THEN round({metres}, 3) END AS metres, CASE WHEN abs(lam - prev) < 1e-11 THEN round((degrees(atan2(c2_ * sin(lam), c1 * s2 - s1 * c2_ * cos(lam))) + 360) % 360, 6) END AS bearing FROM big"


@query(f"{CTE}, ll AS (SELECT id, 20 + x / 70.0 AS lon, y / 110.0 + 5 AS lat FROM p WHERE abs(x / 70.0) < 120 AND abs(y / 110.0) < 80), {_geodesic_sql(24)}")
def d30_geodesic(spark: SparkSession, d: str) -> DataFrame:
    lon, lat = 20 + F.col("x") / 70.0, F.col("y") / 110.0 + 5
    p = points(spark, d).where("abs(x / 70.0) < 120 AND abs(y / 110.0) < 80").select("id", geo.geodesic(F.lit(20.0), F.lit(10.0), lon, lat).alias("g"))
    return p.select("id", F.round("g.metres", 3).alias("metres"), F.round("g.bearing", 6).alias("bearing"))


_EDGES = """k AS (SELECT DISTINCT label, x, y FROM p), e AS (SELECT a.label, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS by_ FROM k a JOIN k b ON a.label = b.label AND (a.x <> b.x OR a.y <> b.y)
WHERE NOT EXISTS (SELECT 1 FROM k c WHERE c.label = a.label AND ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) < 0 OR ((b.x - a.x) * (c.y - a.y) - (b.y - a.y) * (c.x - a.x) = 0 AND (c.x - a.x) * (c.x - b.x) + (c.y - a.y) * (c.y - b.y) > 0))))"""


@query(f"{CTE}, {_EDGES} SELECT label, count(*) AS vertices, CAST(sum(ax * by_ - bx * ay) AS DOUBLE) / 2 AS area, round(sum(sqrt((bx - ax) ** 2 + (by_ - ay) ** 2)), 4) AS perimeter, CAST(min(ax) AS DOUBLE) AS west FROM e GROUP BY label")
def d42_hull(spark: SparkSession, d: str) -> DataFrame:
    from pyspark.sql import Window

    ring = footprints.hulls(points(spark, d), "label")
    w = Window.partitionBy("label").orderBy("seq")
    nxt = lambda c: F.coalesce(F.lead(c).over(w), F.first(c).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    s = ring.select("label", "x", "y", nxt("x").alias("u"), nxt("y").alias("v"))
    return s.groupBy("label").agg(F.count("*").alias("vertices"), (F.sum(F.col("x") * F.col("v") - F.col("u") * F.col("y")) / 2).alias("area"), F.round(F.sum(F.sqrt(F.pow(F.col("u") - F.col("x"), 2) + F.pow(F.col("v") - F.col("y"), 2))), 4).alias("perimeter"), F.min("x").alias("west"))


@query("""WITH v AS (SELECT vec_id AS i, vec_id % 9 AS k, vec_id % 4 = 0 AS named FROM embeddings)
SELECT i AS hole_id, CASE WHEN k = 0 THEN 'no_coordinates' WHEN k IN (1, 2) THEN 'not_transformable_local_grid' WHEN k = 3 THEN 'not_transformable_no_datum' WHEN k = 4 AND i % 2 = 0 THEN 'transform_failed' ELSE 'transformed' END AS status,
CASE WHEN k >= 5 THEN 'extracted_nad83' WHEN k = 4 AND i % 2 = 1 THEN 'extracted_transformed' WHEN named AND i % 8 = 0 THEN 'provincial_geods' WHEN named THEN 'provincial_compilation' ELSE 'none' END AS source,
CASE WHEN k >= 5 OR (k = 4 AND i % 2 = 1) OR NOT named THEN 'none' WHEN i % 8 = 0 THEN 'g' || i ELSE 'c' || i END AS record,
CASE WHEN k = 7 THEN true ELSE false END AS zone_inferred FROM v""")
def k11_positions(spark: SparkSession, d: str) -> DataFrame:
    """Nine kinds of printed coordinates; every fourth hole is in the province's records under another spelling; half of the file pairs have no grid of shifts."""
    i = F.col("vec_id")
    e = table(spark, d, "embeddings").select(i, (i % 9).alias("k"), (F.col("embedding")[0].cast("double") * 50_000).alias("dx"), (F.col("embedding")[1].cast("double") * 50_000).alias("dy"))
    k = F.col("k")
    when = lambda cond, v: F.when(cond, v)
    file = F.concat(F.lit("f"), (i % 50).cast("string"))
    holes = e.select(
        i.alias("hole_id"), file.alias("file"), F.concat(F.lit("AB-0"), i.cast("string")).alias("name"),
        F.when(k.isin(3, 5, 7), 500_000 + F.col("dx")).when(k == 2, 1000.0).alias("easting"), F.when(k.isin(3, 5, 7), 6_400_000 + F.col("dy")).when(k == 2, 200.0).alias("northing"),
        when(k.isin(4, 6, 8), 57.75 + F.col("dy") / 1e6 + F.when((k == 4) & (i % 2 == 0), 20).otherwise(0)).alias("lat"), when(k.isin(4, 6, 8), 105.0 + F.col("dx") / 1e6).alias("lon"), when(k == 1, 12.0).alias("grid_x"), F.lit(None).cast("double").alias("grid_y"),
        F.when(k == 4, "N.A.D. 27").when(k.isin(5, 7), "UTM NAD 83").when(k == 6, "WGS84").when(k == 8, "north american datum 1983").alias("datum"), F.when(k == 3, "13").when(k == 5, "Zone 13V").alias("zone"), (k == 2).alias("local_page"),
    )
    named = e.where("vec_id % 4 = 0").select(file.alias("file"), F.concat(F.lit("ab "), i.cast("string")).alias("name"), F.lit(-105.0).alias("lon"), F.lit(57.7).alias("lat"), i)
    province = named.where("vec_id % 8 = 0").select("file", "name", F.lit(1).alias("source"), F.concat(F.lit("g"), i.cast("string")).alias("record"), "lon", "lat")
    province = province.unionByName(named.select("file", "name", F.lit(2).alias("source"), F.concat(F.lit("c"), i.cast("string")).alias("record"), "lon", "lat"))
    sheets = e.select(file.alias("file")).distinct().select("file", F.lit(-106.5).alias("x0"), F.lit(57.0).alias("y0"), F.lit(-103.5).alias("x1"), F.lit(58.5).alias("y1"))
    nodes = spark.range(-1100, -1000).select(F.col("id").alias("gx")).crossJoin(spark.range(550, 610).select(F.col("id").alias("gy")))  # a fixed grid of shifts
    grid = nodes.select("gx", "gy", F.lit(-0.0006).alias("dlon"), (F.col("gy") * 1e-7).alias("dlat"))
    out = positions.positions(holes, province, sheets, grid)
    return out.select("hole_id", "status", "source", F.coalesce("record", F.lit("none")).alias("record"), "zone_inferred")
