"""Rules of records, one query for each: orders play the holes, their lines the intervals and grades, events the printed values."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import matching, records
from lodestar.plans.registry import query
from lodestar.session import table

I = """WITH s AS (SELECT l_orderkey AS hole_id, l_partkey AS pk, l_suppkey AS sk, l_quantity AS q, l_extendedprice AS price, l_returnflag AS rf, l_linestatus AS ls, l_discount AS disc,
  row_number() OVER w AS seq, coalesce(sum(l_quantity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS top FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice)),
i AS (SELECT *, hole_id || '-' || seq AS interval_id, CASE rf WHEN 'A' THEN 'lith' ELSE 'assays' END AS grp, CASE WHEN pk % 17 = 0 THEN top + q WHEN pk % 11 = 0 THEN greatest(top - 5, 0) ELSE top END AS from_m,
  CASE WHEN pk % 17 = 0 OR sk % 13 = 0 AND pk % 11 <> 0 THEN top ELSE top + q END AS to_m, CASE WHEN sk % 5 = 0 THEN NULL WHEN sk % 9 = 0 THEN q + 1 ELSE q END AS width, CASE rf WHEN 'R' THEN NULL ELSE 'm' END AS depth_unit FROM s),
g AS (SELECT interval_id AS value_id, CASE pk % 4 WHEN 0 THEN NULL WHEN 1 THEN '%' ELSE 'ppm' END AS unit, CASE pk % 4 WHEN 1 THEN price / 400 ELSE price * 25 END AS grade,
  CASE sk % 4 WHEN 0 THEN 'U' WHEN 1 THEN 'U3O8' WHEN 2 THEN 'eU3O8' ELSE 'not_printed' END AS species, CASE ls WHEN 'O' THEN 'chemical' ELSE 'probe_equivalent' END AS basis,
  CASE pk % 5 WHEN 0 THEN 'eU3O8 by hand' WHEN 1 THEN 'Gamma cps' ELSE 'U3O8 assay' END AS printed, CASE WHEN disc = 0 THEN NULL ELSE 'as printed' END AS quote FROM i)"""


def intervals(spark, d) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice")
    s = table(spark, d, "lineitem").select(
        F.col("l_orderkey").alias("hole_id"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"), F.col("l_quantity").alias("q"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("rf"),
        F.col("l_linestatus").alias("ls"), F.col("l_discount").alias("disc"), F.row_number().over(w).alias("seq"), F.coalesce(F.sum("l_quantity").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("top"),
    )
    pk, sk, top, q = (F.col(c) for c in ("pk", "sk", "top", "q"))
    return s.withColumns({
        "interval_id": F.concat_ws("-", "hole_id", "seq"), "grp": F.when(F.col("rf") == "A", "lith").otherwise("assays"),
        "from_m": F.when(pk % 17 == 0, top + q).when(pk % 11 == 0, F.greatest(top - 5, F.lit(0.0))).otherwise(top), "to_m": F.when((pk % 17 == 0) | ((sk % 13 == 0) & (pk % 11 != 0)), top).otherwise(top + q),
        "width": F.when(sk % 5 == 0, None).when(sk % 9 == 0, q + 1).otherwise(q), "depth_unit": F.when(F.col("rf") != "R", "m"),
    })


def grades(spark, d) -> DataFrame:
    i, pk, sk = intervals(spark, d), F.col("pk"), F.col("sk") % 4
    return i.select(
        F.col("interval_id").alias("value_id"), F.when(pk % 4 == 0, None).when(pk % 4 == 1, "%").otherwise("ppm").alias("unit"), F.when(pk % 4 == 1, F.col("price") / 400).otherwise(F.col("price") * 25).alias("grade"),
        F.when(sk == 0, "U").when(sk == 1, "U3O8").when(sk == 2, "eU3O8").otherwise("not_printed").alias("species"), F.when(F.col("ls") == "O", "chemical").otherwise("probe_equivalent").alias("basis"),
        F.when(pk % 5 == 0, "eU3O8 by hand").when(pk % 5 == 1, "Gamma cps").otherwise("U3O8 assay").alias("printed"), F.when(F.col("disc") != 0, "as printed").alias("quote"),
    )


H = """WITH h AS (SELECT o_orderkey AS hole_id, o_custkey AS file_id, CASE WHEN k % 5 = 0 THEN NULL WHEN k % 10 = 1 THEN 5400000 + k * 37 % 1000 * 1000 ELSE 100000 + k * 37 % 900 * 1000 END AS easting,
  CASE WHEN k % 5 = 0 THEN NULL WHEN k % 10 = 1 THEN 200000 + k % 500 * 1000 ELSE 5300000 + k * 53 % 1500 * 1000 END AS northing, CASE WHEN k % 5 = 0 THEN NULL ELSE 45 + k % 20 END AS latitude, CASE WHEN k % 5 = 0 THEN NULL ELSE -(95 + k % 20) END AS longitude,
  CASE WHEN k % 3 = 0 THEN NULL ELSE 'NAD27' END AS datum, k % 4 <> 0 AS located, o_orderstatus = 'F' AS transformed, -(k % 100) - 0.5 AS dip, k % 380 AS azimuth, CASE k % 4 WHEN 1 THEN 'page_header' WHEN 2 THEN 'carried' ELSE 'own' END AS id_source FROM (SELECT *, o_orderkey AS k FROM orders))"""


def holes(spark, d) -> DataFrame:
    k = F.col("o_orderkey")
    there = lambda c: F.when(k % 5 != 0, c)
    return table(spark, d, "orders").select(
        k.alias("hole_id"), F.col("o_custkey").alias("file_id"), there(F.when(k % 10 == 1, 5400000 + k * 37 % 1000 * 1000).otherwise(100000 + k * 37 % 900 * 1000)).alias("easting"),
        there(F.when(k % 10 == 1, 200000 + k % 500 * 1000).otherwise(5300000 + k * 53 % 1500 * 1000)).alias("northing"), there(45 + k % 20).alias("latitude"), there(-(95 + k % 20)).alias("longitude"),
        F.when(k % 3 != 0, "NAD27").alias("datum"), (k % 4 != 0).alias("datum_located"), (F.col("o_orderstatus") == "F").alias("transformed"), (-(k % 100) - 0.5).alias("dip"), (k % 380).alias("azimuth"),
        F.when(k % 4 == 1, "page_header").when(k % 4 == 2, "carried").otherwise("own").alias("id_source"),
    )


def only(df: DataFrame, rule: str) -> DataFrame:
    return df.where(F.col("rule") == rule).select("outcome", "scope_id", "detail")


D = f"{I}, b AS (SELECT hole_id, sum(q) AS total FROM i GROUP BY hole_id), p AS (SELECT i.hole_id, max(to_m) AS deepest, CASE WHEN i.hole_id % 8 = 0 THEN any_value(total) / 3.3 WHEN i.hole_id % 6 = 1 THEN NULL ELSE 50 + i.hole_id % 100 END AS recorded, CASE WHEN i.hole_id % 5 = 0 THEN NULL WHEN i.hole_id % 7 = 0 THEN (60 + i.hole_id % 90) * 0.3048 ELSE 60 + i.hole_id % 90 END AS printed FROM i JOIN b USING (hole_id) GROUP BY i.hole_id)"


def hole_depths(spark, d) -> tuple[DataFrame, DataFrame]:
    i, k = intervals(spark, d), F.col("hole_id")
    total = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("hole_id")).agg(F.sum("l_quantity").alias("total"))
    return i, total.select(
        k, F.when(k % 8 == 0, F.col("total") / 3.3).when(k % 6 == 1, None).otherwise(50 + k % 100).alias("recorded_depth"), F.when(k % 5 != 0, 60 + k % 90).alias("printed_depth"), F.when(k % 7 == 0, "ft").otherwise("m").alias("depth_unit_printed"),
    )


@query(f"{D} SELECT 'flag' AS outcome, interval_id AS scope_id, 'no depth unit is printed' AS detail FROM i WHERE depth_unit IS NULL UNION ALL SELECT 'fail', CAST(hole_id AS VARCHAR), 'feet were read as metres' FROM p WHERE recorded > 0 AND abs(deepest / recorded - 1 / 0.3048) <= 0.12")
def v01_depth_units(spark, d):
    found = records.told(intervals(spark, d), "interval_id", *records.interval_tests())
    return only(found.unionByName(records.depths(*hole_depths(spark, d))), "V01")


PAIR = "SELECT interval_id, price / 10 AS ppm_u, price / 10 / 10000 * CASE sk % 3 WHEN 0 THEN 1.0 WHEN 1 THEN 1.17924 ELSE 1.8 END AS pct FROM i"


@query(f"""{I}, p AS ({PAIR}), x AS (SELECT interval_id, abs(pct - ppm_u / 10000) / (ppm_u / 10000) AS off_u, abs(pct - ppm_u / 10000 * 1.17924) / (ppm_u / 10000 * 1.17924) AS off FROM p)
SELECT 'flag' AS outcome, value_id AS scope_id, 'no grade unit is printed' AS detail FROM g WHERE unit IS NULL UNION ALL SELECT 'fail', value_id, 'over 100 per cent' FROM g WHERE unit = '%' AND grade > 100 UNION ALL SELECT 'fail', value_id, 'over a million parts per million' FROM g WHERE unit = 'ppm' AND grade > 1000000
UNION ALL SELECT 'fail', interval_id, 'the element may be stored as the oxide' FROM x WHERE off_u <= 0.03 AND off > 0.05 UNION ALL SELECT 'flag', interval_id, 'the two printed grades disagree' FROM x WHERE off_u > 0.03 AND off > 0.25""")
def v02_grade_units(spark, d):
    i, k = intervals(spark, d), F.col("sk") % 3
    pairs = i.select("interval_id", (F.col("price") / 10).alias("ppm_u"), (F.col("price") / 10 / 10000 * F.when(k == 0, 1.0).when(k == 1, 1.17924).otherwise(1.8)).alias("pct_u3o8"))
    return only(records.told(grades(spark, d), "value_id", *records.grade_tests()).unionByName(records.told(pairs, "interval_id", *records.pair_tests())), "V02")


@query(f"{I} SELECT 'flag' AS outcome, value_id AS scope_id, CASE species WHEN 'not_printed' THEN 'no species is printed' ELSE 'a species without a quote' END AS detail FROM g WHERE species = 'not_printed' OR quote IS NULL")
def v03_species(spark, d):
    return only(records.told(grades(spark, d), "value_id", *records.grade_tests()), "V03")


@query(f"""{I} SELECT 'fail' AS outcome, value_id AS scope_id, 'a probe reading stored as chemical' AS detail FROM g WHERE basis = 'chemical' AND regexp_matches(printed, '(?i)probe|cps|count|gamma|radiometric|equivalent|\\beu')
UNION ALL SELECT 'flag', value_id, 'a probe reading with a chemical species' FROM g WHERE basis = 'probe_equivalent' AND species IN ('U', 'U3O8')""")
def v04_basis(spark, d):
    return only(records.told(grades(spark, d), "value_id", *records.grade_tests()), "V04")


@query(f"{I} SELECT CASE WHEN from_m > to_m THEN 'fail' ELSE 'flag' END AS outcome, interval_id AS scope_id, CASE WHEN from_m > to_m THEN 'the start is below the end' ELSE 'zero length' END AS detail FROM i WHERE from_m >= to_m")
def v05_from_to(spark, d):
    return only(records.told(intervals(spark, d), "interval_id", *records.interval_tests()), "V05")


@query(f"{I}, w AS (SELECT *, lag(to_m) OVER (PARTITION BY hole_id, grp ORDER BY from_m, to_m, interval_id) AS before FROM i) SELECT 'flag' AS outcome, interval_id AS scope_id, 'overlaps the interval before it' AS detail FROM w WHERE from_m < before - 1e-6 AND to_m > before + 1e-6")
def v06_overlaps(spark, d):
    return only(records.overlaps(intervals(spark, d)), "V06")


@query(f"{I} SELECT 'flag' AS outcome, interval_id AS scope_id, 'printed width is not to minus from' AS detail FROM i WHERE abs(width - (to_m - from_m)) > greatest(0.05, abs(to_m - from_m) * 0.01)")
def v07_width(spark, d):
    return only(records.told(intervals(spark, d), "interval_id", *records.interval_tests()), "V07")


@query(f"{D} SELECT 'fail' AS outcome, CAST(hole_id AS VARCHAR) AS scope_id, CASE WHEN printed IS NULL THEN 'recorded' ELSE 'printed' END AS detail FROM p WHERE coalesce(printed, recorded) > 0 AND deepest > coalesce(printed, recorded) * 1.02 + 0.5")
def v08_total_depth(spark, d):
    return only(records.depths(*hole_depths(spark, d)), "V08")


@query("""WITH t AS (SELECT l_orderkey AS k, count(*) AS stored FROM lineitem GROUP BY l_orderkey), c AS (SELECT k, CAST(k % 3 = 0 AS INTEGER) + CAST(k % 4 <> 0 AND k % 6 = 1 AS INTEGER) + CAST(k % 7 = 0 AS INTEGER) AS deficits FROM t)
SELECT CASE WHEN deficits >= 2 THEN 'fail' ELSE 'flag' END AS outcome, CAST(k AS VARCHAR) AS scope_id, CASE WHEN deficits >= 2 THEN 'rows are missing' ELSE 'one counter disagrees' END AS detail FROM c WHERE deficits > 0""")
def v09_row_counts(spark, d):
    k, n = F.col("table_id"), F.col("stored")
    t = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("table_id")).agg(F.count("*").alias("stored"))
    t = t.withColumns({"counted": n + (k % 3 == 0).cast("int"), "geometric": F.when(k % 4 == 0, None).when(k % 6 == 1, n + 2).otherwise(n), "truncated": k % 7 == 0})
    return only(records.told(t, "table_id", *records.table_tests()), "V09")


@query(f"""{H} SELECT 'flag' AS outcome, CAST(hole_id AS VARCHAR) AS scope_id, 'the datum''s quote is not on the page' AS detail FROM h WHERE datum IS NOT NULL AND NOT located UNION ALL SELECT 'flag', CAST(hole_id AS VARCHAR), 'coordinates without a datum' FROM h WHERE datum IS NULL AND coalesce(easting, northing, latitude, longitude) IS NOT NULL
UNION ALL SELECT 'fail', CAST(hole_id AS VARCHAR), 'a datum was applied that is not printed' FROM h WHERE datum IS NULL AND transformed""")
def v10_datum(spark, d):
    return only(records.told(holes(spark, d), "hole_id", *records.hole_tests()), "V10")


@query("""WITH p AS (SELECT c_custkey AS k, c_custkey % 9 <> 0 AS placed, CASE c_custkey % 5 WHEN 0 THEN NULL WHEN 1 THEN false ELSE true END AS sheets, c_custkey % 3 <> 0 AS inside FROM customer)
SELECT CASE WHEN NOT sheets THEN 'fail' ELSE 'flag' END AS outcome, CAST(k AS VARCHAR) AS scope_id, CASE WHEN NOT sheets THEN 'outside the file''s sheets' ELSE 'over 2 km from the file''s holes' END AS detail FROM p WHERE placed AND (NOT sheets OR sheets AND NOT inside)""")
def v11_inside_sheets(spark, d):
    k = F.col("c_custkey")
    p = table(spark, d, "customer").select(k, (k % 9 != 0).alias("placed"), F.when(k % 5 == 0, None).otherwise(k % 5 != 1).alias("inside_sheets"), (k % 3 != 0).alias("inside_file"))
    return only(records.told(p, "c_custkey", *records.position_tests()), "V11")


@query(f"""{H}, s AS (SELECT *, northing BETWEEN 150000 AND 850000 AND easting BETWEEN 5400000 AND 6700000 AS swapped FROM h WHERE easting IS NOT NULL)
SELECT 'fail' AS outcome, CAST(hole_id AS VARCHAR) AS scope_id, 'easting and northing look swapped' AS detail FROM s WHERE swapped UNION ALL SELECT 'flag', CAST(hole_id AS VARCHAR), 'outside the plausible range' FROM s WHERE NOT swapped AND NOT (easting BETWEEN 150000 AND 850000 AND northing BETWEEN 5400000 AND 6700000)
UNION ALL SELECT 'flag', CAST(hole_id AS VARCHAR), 'latitude outside' FROM s WHERE NOT latitude BETWEEN 49.0 AND 60.5 UNION ALL SELECT 'flag', CAST(hole_id AS VARCHAR), 'longitude outside' FROM s WHERE NOT abs(longitude) BETWEEN 100 AND 111""")
def v12_coordinates(spark, d):
    return only(records.told(holes(spark, d), "hole_id", *records.hole_tests()), "V12")


BOX = "user_id AS page, ({0} * 7 % 100) / 100.0 AS x0, (CAST(floor(value) AS BIGINT) % 5) / 5.0 AS y0, ({0} * 7 % 100) / 100.0 + 0.08 AS x1, (CAST(floor(value) AS BIGINT) % 5) / 5.0 + 0.03 AS y1"
PAGES = f"""WITH v AS (SELECT event_id AS value_id, printf('%.2f', value) AS printed, {BOX.format('event_id')} FROM events WHERE event_id % 2 = 0), w AS (SELECT event_id AS word_id, printf('%.2f', value) AS word, {BOX.format('event_id')} FROM events WHERE event_id % 2 = 1),
o AS (SELECT value_id, printed, word_id, word, w.x0 AS x0 FROM v JOIN w USING (page) WHERE least(v.x1, w.x1) > greatest(v.x0, w.x0) AND least(v.y1, w.y1) > greatest(v.y0, w.y0)
  AND (least(v.x1, w.x1) - greatest(v.x0, w.x0)) * (least(v.y1, w.y1) - greatest(v.y0, w.y0)) / greatest(1e-9, (w.x1 - w.x0) * (w.y1 - w.y0)) > 0.35)"""


def page_boxes(spark, d) -> tuple[DataFrame, DataFrame]:
    e = F.col("event_id")
    x, y = (e * 7 % 100) / F.lit(100.0), (F.floor("value") % 5) / F.lit(5.0)
    rows = table(spark, d, "events").select(e, F.col("user_id").alias("page"), F.format_string("%.2f", "value").alias("printed"), x.alias("x0"), y.alias("y0"), (x + 0.08).alias("x1"), (y + 0.03).alias("y1"))
    return rows.where(e % 2 == 0).withColumnRenamed("event_id", "value_id"), rows.where(e % 2 == 1).withColumnsRenamed({"event_id": "word_id", "printed": "word"})


@query(f"{PAGES} SELECT value_id, word_id FROM o")
def c20_box_overlap(spark, d):
    return records.overlapping(*page_boxes(spark, d), "page", 0.35).select("value_id", "word_id")


@query(rf"{PAGES}, t AS (SELECT value_id, regexp_replace(any_value(printed), '\D', '', 'g') AS want, string_agg(regexp_replace(word, '\D', '', 'g'), '' ORDER BY x0, word_id) AS got FROM o GROUP BY value_id) SELECT 'flag' AS outcome, CAST(value_id AS VARCHAR) AS scope_id, got AS detail FROM t WHERE NOT contains(got, want) AND NOT contains(want, got)")
def v13_text_layer(spark, d):
    return only(records.text_layer(*page_boxes(spark, d), "page"), "V13")


@query("SELECT 'flag' AS outcome, p_brand AS scope_id, p_type || ' ' || count(DISTINCT p_size) AS detail FROM part WHERE p_size % 3 <> 0 GROUP BY p_brand, p_type HAVING count(DISTINCT p_size) > 1 UNION ALL SELECT 'flag', p_brand, count(*) || ' times' FROM part GROUP BY p_brand, p_size % 5 HAVING count(*) > 1")
def v14_conflicts(spark, d):
    p = table(spark, d, "part")
    values = p.select(F.col("p_brand").alias("hole_id"), F.col("p_type").alias("field"), F.when(F.col("p_size") % 3 != 0, F.col("p_size").cast("double")).alias("value"))
    return only(records.conflicts(values).unionByName(records.repeated(p.select(F.col("p_brand").alias("hole_id"), (F.col("p_size") % 5).alias("file_id")))), "V14")


@query(r"""WITH q AS (SELECT item_id, text AS printed, CASE item_id % 5 WHEN 0 THEN 'as said: ' || text || '!' WHEN 1 THEN left(text, 30) || ' ... ' || right(text, 20) WHEN 2 THEN left(text, 40) WHEN 3 THEN '123 456' ELSE left(text, 10) || '…' || '999999' END AS quote FROM benchmark),
b AS (SELECT *, regexp_replace(lower(printed), '[^\p{L}\p{N}]', '', 'g') AS want, regexp_replace(lower(quote), '[^\p{L}\p{N}]', '', 'g') AS have, replace(quote, '…', '...') AS e FROM q),
c AS (SELECT *, CASE WHEN contains(e, '...') AND contains(want, regexp_replace(lower(split_part(e, '...', 1)), '[^\p{L}\p{N}]', '', 'g')) AND contains(want, regexp_replace(lower(split_part(e, '...', 2)), '[^\p{L}\p{N}]', '', 'g')) THEN 'elided' WHEN length(want) > 60 AND contains(want, have) THEN 'shorter' ELSE 'absent' END AS kind FROM b WHERE want <> '' AND NOT contains(have, want))
SELECT CASE kind WHEN 'absent' THEN 'fail' ELSE 'flag' END AS outcome, CAST(item_id AS VARCHAR) AS scope_id, CASE kind WHEN 'absent' THEN 'not in its quote' ELSE kind END AS detail FROM c""")
def v15_value_in_quote(spark, d):
    k, t = F.col("item_id") % 5, F.col("text")
    short = F.concat(F.left(t, F.lit(30)), F.lit(" ... "), F.right(t, F.lit(20)))
    quote = F.when(k == 0, F.concat(F.lit("as said: "), t, F.lit("!"))).when(k == 1, short).when(k == 2, F.left(t, F.lit(40))).when(k == 3, "123 456").otherwise(F.concat(F.left(t, F.lit(10)), F.lit("…999999")))
    values = table(spark, d, "benchmark").select(F.col("item_id").alias("value_id"), t.alias("printed"), quote.alias("quote"))
    return only(records.quotes(values, matching.common_run("want", "have")), "V15")


V = r"""WITH v AS (SELECT event_id, user_id, CASE user_id % 5 WHEN 0 THEN '<0.5' WHEN 1 THEN '<0.5' WHEN 2 THEN 'trace' ELSE printf('%.2f', value) END AS printed, CASE user_id % 5 WHEN 1 THEN '<' END AS qualifier, user_id % 5 = 2 AS non_numeric,
  CASE WHEN user_id % 5 = 1 AND event_id % 2 = 0 THEN 0 WHEN user_id % 5 = 2 AND event_id % 3 = 0 THEN NULL ELSE value END AS value, CASE event_id % 4 WHEN 0 THEN NULL WHEN 1 THEN 'fuzzy' ELSE 'exact' END AS located FROM events),
r AS (SELECT *, CASE event_id % 3 WHEN 0 THEN printed WHEN 1 THEN translate(printed, '015', 'OlS') ELSE replace(replace(printed, '1', '9'), '5', '3') END AS read_as FROM v)"""


def printed_values(spark, d) -> DataFrame:
    e, u, v = F.col("event_id"), F.col("user_id") % 5, F.col("value")
    rows = table(spark, d, "events").select(
        e, F.when(u < 2, "<0.5").when(u == 2, "trace").otherwise(F.format_string("%.2f", v)).alias("printed"), F.when(u == 1, "<").alias("qualifier"), (u == 2).alias("non_numeric"),
        F.when((u == 1) & (e % 2 == 0), 0.0).when((u == 2) & (e % 3 == 0), None).otherwise(v).alias("value"), F.when(e % 4 == 0, None).when(e % 4 == 1, "fuzzy").otherwise("exact").alias("located"),
    )
    p = F.col("printed")
    read = F.when(e % 3 == 0, p).when(e % 3 == 1, F.translate(p, "015", "OlS")).otherwise(F.translate(p, "15", "93"))
    return rows.withColumn("agreement", tx.digit_agreement(p, read))


@query(rf"""{V}, a AS (SELECT event_id, regexp_replace(printed, '\D', '', 'g') AS p, regexp_replace(read_as, '\D', '', 'g') AS x, regexp_replace(translate(read_as, 'OolISBZ', '0011582'), '\D', '', 'g') AS y, located FROM r)
SELECT 'flag' AS outcome, CAST(event_id AS VARCHAR) AS scope_id, CASE WHEN contains(y, p) THEN 'equal but for look-alikes' ELSE 'two readers disagree' END AS detail FROM a WHERE p <> '' AND located IS NOT NULL AND NOT contains(x, p)""")
def v16_second_reader(spark, d):
    return only(records.told(printed_values(spark, d), "event_id", *records.value_tests()), "V16")


@query(f"{V} SELECT 'fail' AS outcome, CAST(event_id AS VARCHAR) AS scope_id, CASE WHEN printed[1] = '<' AND qualifier IS NULL THEN 'a limit''s sign was lost' WHEN qualifier IS NOT NULL THEN 'below detection stored as zero' ELSE 'not a number but stored as one' END AS detail FROM v WHERE printed[1] = '<' AND qualifier IS NULL OR qualifier IS NOT NULL AND value = 0 OR non_numeric AND value IS NOT NULL")
def v17_qualifiers(spark, d):
    return only(records.told(printed_values(spark, d), "event_id", *records.value_tests()), "V17")


@query(f"{H} SELECT 'flag' AS outcome, CAST(hole_id AS VARCHAR) AS scope_id, 'dip outside its range' AS detail FROM h WHERE dip < -90.000001 UNION ALL SELECT 'flag', CAST(hole_id AS VARCHAR), 'azimuth outside its range' FROM h WHERE azimuth > 360")
def v18_dip_azimuth(spark, d):
    return only(records.told(holes(spark, d), "hole_id", *records.hole_tests()), "V18")


@query(f"{H} SELECT 'flag' AS outcome, CAST(hole_id AS VARCHAR) AS scope_id, 'taken from ' || id_source AS detail FROM h WHERE id_source <> 'own'")
def v19_carried_id(spark, d):
    return only(records.told(holes(spark, d), "hole_id", *records.hole_tests()), "V19")


@query("""WITH f AS (SELECT c_custkey AS k, c_custkey % 12 AS expected FROM customer), n AS (SELECT o_custkey AS k, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey), m AS (SELECT o_custkey AS k, count(DISTINCT o_orderkey) AS missing FROM orders WHERE o_orderstatus <> 'F' GROUP BY o_custkey),
j AS (SELECT f.k, expected, coalesce(n, 0) AS n, coalesce(missing, 0) AS missing FROM f LEFT JOIN n ON n.k = f.k LEFT JOIN m ON m.k = f.k)
SELECT 'flag' AS outcome, CAST(k AS VARCHAR) AS scope_id, n || ' of ' || expected AS detail FROM j WHERE expected > n UNION ALL SELECT 'flag', CAST(k AS VARCHAR), missing || ' recorded holes are missing' FROM j WHERE missing > 0""")
def v20_hole_counts(spark, d):
    files = table(spark, d, "customer").select(F.col("c_custkey").alias("file_id"), (F.col("c_custkey") % 12).alias("expected"))
    o = table(spark, d, "orders").select(F.col("o_custkey").alias("file_id"), F.col("o_orderkey").alias("name"), "o_orderstatus")
    return only(records.hole_counts(files, o.where("o_orderstatus = 'F'"), o), "V20")
