"""Model comparison, folds around camps, snapshots, appends and the small views of runs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.functions import text as tx
from lodestar.operators import applicability, compare, governance, ranking, retrieval, sampling, spatial
from lodestar.plans.registry import query
from lodestar.plans.spatial_queries import CTE, R, cells, points, rects
from lodestar.plans.stat_queries import M, marked, portable_sql, precision_sql
from lodestar.plans.text_queries import BM
from lodestar.session import table


@query(f"{CTE} SELECT c.cell_id, coalesce(min(label), -1) AS fold FROM c LEFT JOIN (SELECT DISTINCT cell_id, label FROM j WHERE d2 <= {R * R} AND label IN (2, 5, 7)) n USING (cell_id) GROUP BY c.cell_id")
def h4_camp_folds(spark, d):
    """Leave one camp out with the ground around it: the first camp with a member near a cell is its fold; -1 trains only."""
    near = spatial.radius_join(cells(spark).select("cell_id", "cx", "cy"), points(spark, d).where("label in (2, 5, 7)"), R)
    fold = near.groupBy("cell_id").agg(F.min("label").alias("fold"))
    return cells(spark).select("cell_id").join(fold, "cell_id", "left").na.fill(-1, ["fold"])


ANSWERS = "WITH a AS (SELECT event_id, event_id % 7 <> 0 AS answered, event_id % 3 <> 0 AS published, CASE WHEN event_id % 7 <> 0 THEN value / 500 END AS probability, CASE WHEN event_id % 7 = 0 THEN NULL WHEN event_id % 5 = 0 THEN 'abstain' ELSE event_type END AS verdict FROM events)"


def answers(spark, d):
    e = F.col("event_id")
    return table(spark, d, "events").select(e, (e % 7 != 0).alias("answered"), (e % 3 != 0).alias("published"), F.when(e % 7 != 0, F.col("value") / 500).alias("probability"), F.when(e % 7 == 0, None).when(e % 5 == 0, "abstain").otherwise(F.col("event_type")).alias("verdict"))


def _view_sql(shown: str) -> str:
    return f"{ANSWERS} SELECT event_id, CASE WHEN {shown} THEN probability END AS p, CASE WHEN {shown} THEN verdict ELSE '' END AS v, NOT ({shown}) OR verdict = 'abstain' OR NOT published AS abstained FROM a"


@query(_view_sql("answered AND published"))
def s1_tie_rule(spark, d):
    return compare.answer_view(answers(spark, d)).select("event_id", "p", "v", "abstained")


@query(_view_sql("answered"))
def s1_own_rule(spark, d):
    return compare.answer_view(answers(spark, d), own=True).select("event_id", "p", "v", "abstained")


@query()
def i10_calibration_slope(spark, d):
    """Newton's method on aggregated sums; iteration is beyond SQL."""
    slope = compare.calibration_slope(marked(spark, d), "prob", "label")
    return spark.createDataFrame([(slope,)], "slope double")


@query()
def i20_added_information(spark, d):
    """Does a second score add to the first? Likelihood ratio of two logistic fits on ranks; iteration is beyond SQL."""
    m = marked(spark, d)
    n = m.count()
    ranked = ranking.average_rank(ranking.average_rank(m, "score", "ra"), "prob", "rb").select("label", (F.col("ra") / n).alias("a"), (F.col("rb") / n).alias("b"))
    found = compare.added_information(ranked, "a", "b", "label")
    return spark.createDataFrame([found or (None, None, None)], "ratio double, coefficient double, p_value double")


K = f"{M}, k AS (SELECT doc_id, label, lang, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS ra, rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0 AS rb FROM m)"


@query(f"""{K}, v AS (SELECT rep, label, ra, rb, {portable_sql('doc_id', 21)} < 0.5 AS sw FROM k, generate_series(0, 999) g(rep) UNION ALL SELECT -1, label, ra, rb, false FROM k), r0 AS (SELECT rep, label, CASE WHEN sw THEN rb ELSE ra END AS s, 1 AS w FROM v), r1 AS (SELECT rep, label, CASE WHEN sw THEN ra ELSE rb END AS s, 1 AS w FROM v),
{precision_sql('r0', 'rep', 'e0')}, {precision_sql('r1', 'rep', 'e1')}, x AS (SELECT rep, e0.ap - e1.ap AS d FROM e0 JOIN e1 USING (rep)), o AS (SELECT d AS observed FROM x WHERE rep = -1), c AS (SELECT corr(ra, rb) AS spearman, count(*) AS n FROM k)
SELECT round(max(observed), 9) AS difference, (count(*) FILTER (WHERE d >= observed - 1e-12) + 1) / CAST(count(*) + 1 AS DOUBLE) AS p_value, round(max(spearman), 9) AS spearman, max(n) AS n FROM x, o, c WHERE rep >= 0""")
def i21_contrast(spark, d):
    """One row for two rankings: difference of average precision, its permutation test, rank correlation, rows."""
    m = marked(spark, d)
    test = sampling.rank_permutation(m, "doc_id", "score", "prob", "label", 1000, 21, sampling.portable)
    rank = ranking.spearman(m, "score", "prob").select(F.round("spearman", 9).alias("spearman"))
    return test.select(F.round("observed", 9).alias("difference"), "p_value").crossJoin(rank).crossJoin(m.agg(F.count("*").alias("n")))


@query(f"{M}, r0 AS (SELECT lang, label, score AS s, 1 AS w FROM m), r1 AS (SELECT lang, label, prob AS s, 1 AS w FROM m), {precision_sql('r0', 'lang', 'e0')}, {precision_sql('r1', 'lang', 'e1')} SELECT lang, round(e0.ap - e1.ap, 9) AS difference FROM e0 JOIN e1 USING (lang)")
def i22_subset_sensitivity(spark, d):
    """The contrast on each subset."""
    m = marked(spark, d)
    a, b = (ranking.ranking_metrics(m, s, "label", ["lang"]).select("lang", F.col("average_precision").alias(s)) for s in ("score", "prob"))
    return a.join(b, "lang").where("score is not null and prob is not null").select("lang", F.round(F.col("score") - F.col("prob"), 9).alias("difference"))


@query(f"""{M}, r0 AS (SELECT 'score' AS name, label, score AS s, 1 AS w FROM m UNION ALL SELECT 'prob', label, prob, 1 FROM m), {precision_sql('r0', 'name', 'e')}, b AS (SELECT avg(CAST(label AS DOUBLE)) AS p FROM m)
SELECT name, 'arm' AS kind, round(ap, 9) AS average_precision, CASE name WHEN 'prob' THEN (SELECT round(avg((prob - label) ** 2), 9) FROM m) END AS brier FROM e UNION ALL SELECT 'random', 'baseline', round(p, 9), NULL FROM b""")
def s6_benchmark_table(spark, d):
    """Arms and baselines in one set of columns; null for what an arm never had."""
    m = marked(spark, d)
    arm = lambda s: ranking.ranking_metrics(m, s, "label").select(F.lit(s).alias("name"), F.lit("arm").alias("kind"), F.round("average_precision", 9).alias("average_precision"))
    brier = m.agg(F.round(F.avg(F.pow(F.col("prob") - F.col("label"), 2)), 9).alias("brier"))
    random = m.agg(F.round(F.avg(F.col("label").cast("double")), 9).alias("average_precision")).select(F.lit("random").alias("name"), F.lit("baseline").alias("kind"), "average_precision")
    return arm("prob").crossJoin(brier).unionByName(arm("score"), allowMissingColumns=True).unionByName(random, allowMissingColumns=True)


@query("SELECT c_custkey AS k, c_name AS v FROM customer UNION ALL SELECT s_suppkey, s_name FROM supplier")
def a14_append(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.col("c_name").alias("v"))
    return c.unionByName(table(spark, d, "supplier").select(F.col("s_suppkey").alias("k"), F.col("s_name").alias("v")))


@query("SELECT p_name AS k, p_size AS v FROM part WHERE NOT starts_with(p_brand, 'Brand#1') UNION ALL SELECT 'Brand#1/new', 0")
def a16_replace_prefix(spark, d):
    """Everything under a prefix gives way to what is appended."""
    old = table(spark, d, "part").select(F.col("p_name").alias("k"), F.col("p_size").alias("v"), "p_brand")
    return governance.replace_prefix(old, "p_brand", "Brand#1", spark.createDataFrame([("Brand#1/new", 0, "Brand#1")], old.schema)).drop("p_brand")


SNAP = "count(*) AS n, sum(CAST(CAST('0x' || substr(md5(coalesce(md5(CAST({0} AS VARCHAR)), '-') || ',' || coalesce(md5(CAST({1} AS VARCHAR)), '-')), 1, 12) AS UBIGINT) AS BIGINT)) AS content"


@query(f"SELECT 'customer' AS table_name, n, CAST(content AS VARCHAR) AS content FROM (SELECT {SNAP.format('c_custkey', 'c_name')} FROM customer) UNION ALL SELECT 'supplier', n, CAST(content AS VARCHAR) FROM (SELECT {SNAP.format('s_suppkey', 's_name')} FROM supplier)")
def o3_snapshot(spark, d):
    """Rows and a content sum of each table, whatever the order of the rows; two snapshots are compared by these."""
    t = {n: table(spark, d, n) for n in ("customer", "supplier")}
    return governance.snapshot({"customer": t["customer"].select("c_custkey", "c_name"), "supplier": t["supplier"].select("s_suppkey", "s_name")})


@query(f"""WITH s AS (SELECT 'customer' AS t, {SNAP.format('c_custkey', 'c_mktsegment')} FROM customer), w AS (SELECT {SNAP.format('c_custkey', "CASE WHEN c_custkey % 100 = 7 THEN NULL ELSE c_mktsegment END")} FROM customer)
SELECT t AS table_name, 'changed' AS change FROM s WHERE n <> (SELECT n FROM w) OR content <> (SELECT content FROM w) UNION ALL SELECT 'supplier', 'removed' UNION ALL SELECT 'nation', 'added'""")
def o3_verify(spark, d):
    """Against a pinned snapshot: one table has lost cells, one is gone, one is new, one is as it was."""
    t = {n: table(spark, d, n) for n in ("customer", "supplier", "nation", "region")}
    segments = t["customer"].select("c_custkey", "c_mktsegment")
    pinned = governance.snapshot({"customer": segments, "supplier": t["supplier"], "region": t["region"]})
    lost = segments.withColumn("c_mktsegment", F.when(F.col("c_custkey") % 100 != 7, F.col("c_mktsegment")))
    return governance.verify(pinned, {"customer": lost, "nation": t["nation"], "region": t["region"]})


@query(BM.replace("2.5 / (tf + 1.5 *", "2.2 / (tf + 1.2 *").replace("least(qf, 3)", "qf"))
def m3_bm25_repeats(spark, d):
    """The second scoring: k1 1.2, and a query term counts as often as it is repeated."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    q = items.select(F.col("item_id").alias("query_id"), F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    out = retrieval.bm25(docs, "doc_id", tx.tokens(F.col("text")), q, k1=1.2, cap=None)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query("SELECT item_id, substr(text, greatest(1, coalesce(nullif(strpos(lower(text), 'the'), 0), 1) - 20), 60) AS part FROM benchmark")
def j9_snippet(spark, d):
    return table(spark, d, "benchmark").select("item_id", tx.snippet(F.col("text"), F.array(F.lit("the")), 20, 60).alias("part"))


@query("SELECT o_orderkey, CAST(regexp_extract(CAST(o_orderdate AS VARCHAR) || '/1999', '\\d{4}', 0) AS DOUBLE) AS year FROM orders")
def j18_first_year(spark, d):
    t = F.concat(F.date_format("o_orderdate", "yyyy-MM-dd"), F.lit("/1999"))
    return table(spark, d, "orders").select("o_orderkey", F.regexp_extract(t, r"\d{4}", 0).cast("double").alias("year"))


@query("SELECT user_id, CAST((epoch_us(max(ts)) - epoch_us(min(ts))) // 1000 AS BIGINT) AS wall_ms FROM events GROUP BY user_id")
def j19_wall_clock(spark, d):
    """Timestamps parsed from ISO text; the wall clock of a run is last minus first."""
    iso = table(spark, d, "events").select("user_id", F.date_format(F.col("ts").cast("timestamp"), "yyyy-MM-dd'T'HH:mm:ss.SSSSSS").alias("t"))
    ts = F.unix_micros(F.to_timestamp("t"))
    return iso.groupBy("user_id").agg(F.floor((F.max(ts) - F.min(ts)) / 1000).alias("wall_ms"))


_AREA = "greatest(0, least(x1, cx + 250) - greatest(x0, cx - 250)) * greatest(0, least(y1, cy + 250) - greatest(y0, cy - 250))"


@query(f"{CTE}, o AS (SELECT cell_id, cls FROM c, rect WHERE {_AREA} > 0) SELECT c.cell_id, count(DISTINCT cls) AS value FROM c LEFT JOIN o USING (cell_id) GROUP BY c.cell_id")
def d22_group_count(spark, d):
    """Different classes that a cell touches."""
    n = spatial.rectangle_overlaps(cells(spark), rects(spark, d), 500).groupBy("cell_id").agg(F.count_distinct("cls").alias("value"))
    return cells(spark).select("cell_id").join(n, "cell_id", "left").na.fill(0, ["value"])


@query(f"{CTE} SELECT label, chr(CAST(64 + row_number() OVER (ORDER BY min(x * x + y * y), label) AS INTEGER)) AS letter FROM p GROUP BY label")
def d37_lettered_domains(spark, d):
    """Domains lettered from the nearest to a centre outwards."""
    near = points(spark, d).groupBy("label").agg(F.min(F.col("x") * F.col("x") + F.col("y") * F.col("y")).alias("d2"))
    return near.select("label", F.char((64 + F.row_number().over(Window.orderBy("d2", "label"))).cast("long")).alias("letter"))  # a row a domain


@query(f"{CTE}, h AS (SELECT label, count(*) FILTER (WHERE x * x + y * y <= 360000) AS hits, sqrt(min(x * x + y * y)) AS nearest FROM p GROUP BY label) SELECT label, hits, round(nearest, 6) AS nearest, row_number() OVER (ORDER BY hits DESC, nearest, label) AS place FROM h WHERE hits > 0")
def d43_files_near(spark, d):
    """Files ranked by how many of their records lie in a radius, then by the nearest."""
    d2 = F.col("x") * F.col("x") + F.col("y") * F.col("y")
    h = points(spark, d).groupBy("label").agg(F.count_if(d2 <= 360000).alias("hits"), F.sqrt(F.min(d2)).alias("nearest")).where("hits > 0")
    return h.select("label", "hits", F.round("nearest", 6).alias("nearest"), F.row_number().over(Window.orderBy(F.desc("hits"), "nearest", "label")).cast("long").alias("place"))


@query(f"{CTE} SELECT id, round(sqrt(x * x + y * y), 6) AS distance, round((degrees(atan2(CAST(x AS DOUBLE), CAST(y AS DOUBLE))) % 360 + 360) % 360, 6) AS bearing FROM p WHERE x * x + y * y <= 640000")
def s34_around_centre(spark, d):
    """Points around a centre with their distance and bearing."""
    x, y = F.col("x"), F.col("y")
    return points(spark, d).where(x * x + y * y <= 640000).select("id", F.round(F.sqrt(x * x + y * y), 6).alias("distance"), F.round(geo.bearing(x.cast("double"), y.cast("double")), 6).alias("bearing"))


@query(f"{M} SELECT doc_id, CASE WHEN prob >= 0.7 THEN 'yes' WHEN prob <= 0.3 THEN 'no' ELSE 'abstain' END AS verdict FROM m")
def s4_threshold_verdicts(spark, d):
    p = F.col("prob")
    return marked(spark, d).select("doc_id", F.when(p >= 0.7, "yes").when(p <= 0.3, "no").otherwise("abstain").alias("verdict"))


@query("SELECT doc_id, doc_id IN (SELECT item_id FROM benchmark) AS flagged FROM documents")
def s17_flagged_rows(spark, d):
    """Rows flagged by a list of ids, none dropped."""
    ids = table(spark, d, "benchmark").select(F.col("item_id").alias("doc_id")).distinct().withColumn("flagged", F.lit(True))
    return table(spark, d, "documents").select("doc_id").join(ids, "doc_id", "left").na.fill(False, ["flagged"])


@query("SELECT conv_id, max(turn) AS newest, count(*) AS rows_ FROM conversations WHERE conv_id % 4 <> 0 GROUP BY conv_id")
def s25_cascade_delete(spark, d):
    """Runs that were withdrawn take all their rows with them."""
    c = table(spark, d, "conversations")
    gone = c.select("conv_id").distinct().where("conv_id % 4 = 0")
    return c.join(gone, "conv_id", "left_anti").groupBy("conv_id").agg(F.max("turn").alias("newest"), F.count("*").alias("rows_"))


@query("SELECT source, lang, count(*) AS n, sum(n_chars) AS chars FROM documents GROUP BY GROUPING SETS ((source, lang), (source), ())")
def s42_inventory(spark, d):
    """Counts by source and language, with totals."""
    return table(spark, d, "documents").rollup("source", "lang").agg(F.count("*").alias("n"), F.sum("n_chars").alias("chars"))


AOA = """WITH f AS (SELECT vec_id, label IN (1, 4) AS train, CAST(floor(CAST(embedding[1] AS DOUBLE) * 40) AS DOUBLE) AS a, CAST(floor(CAST(embedding[2] AS DOUBLE) * 40) AS DOUBLE) AS b, CASE WHEN vec_id % 17 = 0 THEN NULL ELSE CAST(floor(CAST(embedding[3] AS DOUBLE) * 40) AS DOUBLE) END AS c FROM embeddings),
m AS (SELECT avg(a) AS ma, stddev_pop(a) AS sa, avg(b) AS mb, stddev_pop(b) AS sb, avg(c) AS mc, stddev_pop(c) AS sc FROM f WHERE train AND c IS NOT NULL), z AS (SELECT vec_id, train, (a - ma) / sa AS a, (b - mb) / sb AS b, (c - mc) / sc AS c FROM f, m WHERE f.c IS NOT NULL),
n AS (SELECT p.vec_id, p.train, min(sqrt((p.a - q.a) ** 2 + (p.b - q.b) ** 2 + (p.c - q.c) ** 2)) FILTER (WHERE q.vec_id <> p.vec_id) AS other FROM z p, z q WHERE q.train GROUP BY p.vec_id, p.train), t AS (SELECT 2 * quantile_cont(other, 0.95) AS t FROM n WHERE train)
SELECT f.vec_id, CASE WHEN n.train THEN 0.0 ELSE round(other, 6) END AS distance, CASE WHEN n.vec_id IS NOT NULL THEN round(t, 6) END AS threshold, CAST(CASE WHEN n.train THEN true ELSE other <= t END AS VARCHAR) AS applicable FROM f LEFT JOIN n USING (vec_id), t"""


@query(AOA)
def i6_area_of_applicability(spark, d):
    e = lambda k: F.floor(F.col("embedding")[k].cast("double") * 40).cast("double")
    rows = table(spark, d, "embeddings").select("vec_id", F.col("label").isin(1, 4).alias("train"), e(0).alias("a"), e(1).alias("b"), F.when(F.col("vec_id") % 17 != 0, e(2)).alias("c"))
    out = applicability.area_of_applicability(rows, "vec_id", ["a", "b", "c"], "train")
    return out.select("vec_id", F.round("distance", 6).alias("distance"), F.round("threshold", 6).alias("threshold"), F.col("applicable").cast("string").alias("applicable"))
