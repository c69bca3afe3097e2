"""Projection, reshaping, joins, sets, aggregates and windows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lodestar.operators import tables
from lodestar.operators.ranking import running
from lodestar.plans.registry import query
from lodestar.session import cut, table

KINDS = ["click", "error", "purchase", "signup", "view"]


def T(spark: SparkSession, d: str, *names: str) -> list[DataFrame]:
    return [table(spark, d, n) for n in names]


@query("SELECT event_id, user_id, value FROM events WHERE event_type IN ('click', 'view') AND value > 100")
def b1_filter(spark, d):
    return table(spark, d, "events").filter("event_type in ('click', 'view') and value > 100").select("event_id", "user_id", "value")


@query("SELECT p_partkey, p_name, regexp_matches(lower(p_type), 'tin|brass|steel') AS metal FROM part")
def b3_contains_any(spark, d):
    return table(spark, d, "part").select("p_partkey", "p_name", F.lower("p_type").rlike("tin|brass|steel").alias("metal"))


@query("SELECT event_id, TRY_CAST(json_extract_string(props, '$.k') AS DOUBLE) AS k, TRY_CAST(event_type AS DOUBLE) AS bad FROM events")
def b4_coerce_numeric(spark, d):
    return table(spark, d, "events").select("event_id", F.get_json_object("props", "$.k").try_cast("double").alias("k"), F.col("event_type").try_cast("double").alias("bad"))


@query("SELECT c_custkey, CASE WHEN c_acctbal IS NOT NULL THEN greatest(c_acctbal, 0) END AS clipped FROM customer")
def b5_clip(spark, d):
    return table(spark, d, "customer").select("c_custkey", F.when(F.col("c_acctbal").isNotNull(), F.greatest("c_acctbal", F.lit(0.0))).alias("clipped"))


_LONG = "SELECT user_id, event_type, sum(value) AS v FROM events GROUP BY user_id, event_type"
_HIGH = _LONG.replace("events GROUP", "events WHERE value > 100 GROUP")  # few enough that some are missing


@query(f"SELECT user_id, {', '.join(f'''round(max(v) FILTER (WHERE event_type = '{k}'), 4) AS "{k}"''' for k in KINDS)} FROM ({_LONG}) GROUP BY user_id")
def b7_pivot(spark, d):
    long = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.sum("value"), 4).alias("v"))
    return tables.pivot(long, "user_id", "event_type", "v", KINDS)


@query("SELECT p_partkey, 'price' AS name, p_retailprice AS value FROM part UNION ALL SELECT p_partkey, 'size', CAST(p_size AS DOUBLE) FROM part")
def b9_unpivot(spark, d):
    wide = table(spark, d, "part").select("p_partkey", F.col("p_retailprice").alias("price"), F.col("p_size").cast("double").alias("size"))
    return tables.unpivot(wide, "p_partkey", ["price", "size"])


@query(f"""WITH w AS (SELECT u.user_id, t.k, l.v FROM (SELECT DISTINCT user_id FROM events WHERE value > 100) u CROSS JOIN (SELECT unnest({KINDS}) AS k) t LEFT JOIN ({_HIGH}) l ON l.user_id = u.user_id AND l.event_type = t.k),
m AS (SELECT k FROM w WHERE v IS NULL GROUP BY k) SELECT w.user_id, w.k AS feature, CASE WHEN w.v IS NULL THEN 1.0 ELSE 0.0 END AS missing FROM w JOIN m USING (k)""")
def b11_missing_indicators(spark, d):
    """1 where a feature is unknown, only for features that are ever unknown."""
    long = table(spark, d, "events").where("value > 100").groupBy("user_id", "event_type").agg(F.sum("value").alias("v"))
    tall = tables.unpivot(tables.pivot(long, "user_id", "event_type", "v", KINDS), "user_id", KINDS, "feature", "v")
    ever = tall.where("v is null").select("feature").distinct()
    return tall.join(F.broadcast(ever), "feature").select("user_id", "feature", F.col("v").isNull().cast("double").alias("missing"))


@query("""SELECT p_partkey, CASE WHEN lower(p_type) LIKE '%steel%' THEN 'steel' WHEN lower(p_type) LIKE '%copper%' THEN 'copper' WHEN p_type IS NULL THEN NULL ELSE 'other' END AS grp FROM part""")
def b13_first_match_bucket(spark, d):
    t = F.lower("p_type")
    return table(spark, d, "part").select("p_partkey", F.when(t.contains("steel"), "steel").when(t.contains("copper"), "copper").when(t.isNotNull(), "other").alias("grp"))


@query("SELECT conv_id, turn, role, text FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k FROM conversations) WHERE k = 1")
def b20_keep_first(spark, d):
    return tables.keep_first(table(spark, d, "conversations"), ["conv_id", "turn"], ["role", "text"]).select("conv_id", "turn", "role", "text")


@query("""SELECT c_custkey, coalesce(a, b, c) AS value, CASE WHEN a IS NOT NULL THEN 'a' WHEN b IS NOT NULL THEN 'b' WHEN c IS NOT NULL THEN 'c' END AS source
FROM (SELECT c_custkey, CASE WHEN c_acctbal < 0 THEN c_acctbal END AS a, CASE WHEN c_acctbal > 5000 THEN c_acctbal END AS b, CASE WHEN c_custkey % 2 = 0 THEN 0.0 END AS c FROM customer)""")
def b21_coalesce_named(spark, d):
    bal = F.col("c_acctbal")
    t = table(spark, d, "customer").select("c_custkey", F.when(bal < 0, bal).alias("a"), F.when(bal > 5000, bal).alias("b"), F.when(F.col("c_custkey") % 2 == 0, F.lit(0.0)).alias("c"))
    value, source = tables.coalesce_named(["a", "b", "c"])
    return t.select("c_custkey", value.alias("value"), source.alias("source"))


@query("SELECT o_orderkey, c_name, n_name FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey WHERE o_totalprice > 100000")
def c1_inner_join(spark, d):
    o, c, n = T(spark, d, "orders", "customer", "nation")
    return o.where("o_totalprice > 100000").join(c, o.o_custkey == c.c_custkey).join(n, c.c_nationkey == n.n_nationkey).select("o_orderkey", "c_name", "n_name")


@query("SELECT c_custkey, count(o_orderkey) AS n, max(o_totalprice) AS best FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def c2_left_join_counts(spark, d):
    """Orders are reduced before the join, so each customer meets one row."""
    c, o = T(spark, d, "customer", "orders")
    per = o.groupBy("o_custkey").agg(F.count("*").alias("n"), F.max("o_totalprice").alias("best"))
    return c.join(per, c.c_custkey == per.o_custkey, "left").select("c_custkey", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "best")


@query("SELECT n_nationkey, n_name, coalesce(s.k, 0) > 0 AS supplied FROM (SELECT s_nationkey, count(*) AS k FROM supplier GROUP BY s_nationkey) s RIGHT JOIN nation ON s.s_nationkey = n_nationkey")
def c3_right_join(spark, d):
    s, n = T(spark, d, "supplier", "nation")
    return s.groupBy("s_nationkey").agg(F.count("*").alias("k")).join(n, F.col("s_nationkey") == n.n_nationkey, "right").select("n_nationkey", "n_name", (F.coalesce("k", F.lit(0)) > 0).alias("supplied"))


@query("SELECT doc_id, quality FROM labels WHERE doc_id IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def c5_semi_join(spark, d):
    l, t = T(spark, d, "labels", "documents")
    return l.join(t.where("lang = 'en'"), "doc_id", "left_semi").select("doc_id", "quality")


@query("SELECT doc_id, lang FROM documents t WHERE NOT EXISTS (SELECT 1 FROM labels l WHERE l.doc_id = t.doc_id)")
def c6_anti_join(spark, d):
    l, t = T(spark, d, "labels", "documents")
    return t.join(l, "doc_id", "left_anti").select("doc_id", "lang")


@query("""WITH a AS (SELECT c_custkey AS k, c_name AS nm, regexp_replace(lower(c_name), '[^a-z0-9]', '', 'g') AS key FROM customer), b AS (SELECT s_suppkey AS s, regexp_replace(lower('customer_' || printf('%09d', s_suppkey)), '[^a-z0-9]', '', 'g') AS key FROM supplier)
SELECT k, s FROM a JOIN b USING (key)""")
def c18_normalised_key_join(spark, d):
    c, s = T(spark, d, "customer", "supplier")
    norm = lambda x: F.regexp_replace(F.lower(x), "[^a-z0-9]", "")
    a = c.select(F.col("c_custkey").alias("k"), norm(F.col("c_name")).alias("key"))
    b = s.select(F.col("s_suppkey").alias("s"), norm(F.concat(F.lit("customer_"), F.format_string("%09d", "s_suppkey"))).alias("key"))
    return a.join(b, "key").select("k", "s")


_RUN = """WITH r AS (SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice,
 sum(l_quantity) OVER w - l_quantity AS lo, sum(l_quantity) OVER w AS hi FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice ROWS UNBOUNDED PRECEDING))"""
_ORDER = ["l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_quantity", "l_extendedprice"]


def intervals(spark: SparkSession, d: str) -> DataFrame:
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER).rowsBetween(Window.unboundedPreceding, 0)
    hi = F.sum("l_quantity").over(w)
    return table(spark, d, "lineitem").withColumns({"hi": hi}).withColumn("lo", F.col("hi") - F.col("l_quantity"))


@query(f"""{_RUN}, p AS (SELECT *, lag(hi) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate, l_quantity, l_extendedprice) AS before FROM r)
SELECT l_orderkey, count(*) AS rows, count(*) FILTER (WHERE before IS NOT NULL AND lo < before - 1e-9) AS overlaps, count(*) FILTER (WHERE lo > before + 1e-9) AS gaps, max(hi) AS deepest FROM p GROUP BY l_orderkey""")
def c19_interval_neighbours(spark, d):
    """Each interval against the one before it: overlaps and gaps."""
    w = Window.partitionBy("l_orderkey").orderBy(*_ORDER)
    p = intervals(spark, d).withColumn("before", F.lag("hi").over(w))
    return p.groupBy("l_orderkey").agg(F.count("*").alias("rows"), F.count_if(F.col("lo") < F.col("before") - 1e-9).alias("overlaps"), F.count_if(F.col("lo") > F.col("before") + 1e-9).alias("gaps"), F.max("hi").alias("deepest"))


_HALVES = "WITH b AS (SELECT user_id, count(*) AS n FROM events WHERE ts < TIMESTAMP '2024-01-16' GROUP BY user_id), a AS (SELECT user_id, count(*) AS n FROM events WHERE ts >= TIMESTAMP '2024-01-16' GROUP BY user_id)"


@query(f"""{_HALVES} SELECT coalesce(b.user_id, a.user_id) AS user_id, b.n AS before, a.n AS after,
CASE WHEN b.user_id IS NULL THEN 'added' WHEN a.user_id IS NULL THEN 'removed' WHEN a.n = b.n THEN 'same' ELSE 'changed' END AS status FROM b FULL JOIN a ON a.user_id = b.user_id""")
def c22_full_outer_diff(spark, d):
    e = table(spark, d, "events")
    half = lambda c: e.where(c).groupBy("user_id").agg(F.count("*").alias("n"))
    return tables.diff(half("ts < timestamp'2024-01-16'"), half("ts >= timestamp'2024-01-16'"), "user_id", "n")


@query("SELECT event_type, count(*) AS n, count(*) FILTER (WHERE value > 250) AS high, round(median(value) FILTER (WHERE value > 250), 6) AS median_high, count(DISTINCT user_id) AS users FROM events GROUP BY event_type")
def e2_filtered_aggregates(spark, d):
    high = F.col("value") > 250
    return table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.count_if(high).alias("high"), F.round(F.median(F.when(high, F.col("value"))), 6).alias("median_high"), F.count_distinct("user_id").alias("users"))


@query("SELECT event_type, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.25), 6) AS p25, round(quantile_cont(value, 0.5), 6) AS p50, round(quantile_cont(value, 0.75), 6) AS p75, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY event_type")
def e4_exact_quantiles(spark, d):
    q = table(spark, d, "events").groupBy("event_type").agg(F.percentile("value", [0.05, 0.25, 0.5, 0.75, 0.95]).alias("q"))
    return q.select("event_type", *(F.round(F.col("q")[i], 6).alias(n) for i, n in enumerate(("p05", "p25", "p50", "p75", "p95"))))


@query("SELECT event_type, list_sort(list(value))[(count(*) + 1) // 2] AS median_low, list_sort(list(value))[count(*) // 2 + 1] AS middle FROM events GROUP BY event_type")
def e5_other_medians(spark, d):
    """The lower median and the middle element, by rank instead of gathering a list."""
    w = Window.partitionBy("event_type").orderBy("value", "event_id")
    e = table(spark, d, "events").withColumns({"k": F.row_number().over(w), "n": F.count("*").over(Window.partitionBy("event_type"))})
    return e.groupBy("event_type").agg(F.max(F.when(F.col("k") == F.floor((F.col("n") + 1) / 2), F.col("value"))).alias("median_low"), F.max(F.when(F.col("k") == F.floor(F.col("n") / 2) + 1, F.col("value"))).alias("middle"))


@query("SELECT user_id, arg_max(event_id, [value, -event_id]) AS best, arg_min(event_id, [value, event_id]) AS worst FROM events GROUP BY user_id")
def e6_argmax(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.max_by("event_id", F.struct(F.col("value"), -F.col("event_id"))).alias("best"), F.min_by("event_id", F.struct("value", "event_id")).alias("worst"))


@query("WITH h AS (SELECT event_type, count(DISTINCT user_id) AS have FROM events WHERE value > 300 GROUP BY event_type), t AS (SELECT count(DISTINCT user_id) AS total FROM events) SELECT event_type, have, round(have / CAST(total AS DOUBLE), 3) AS share, round(have / CAST(total AS DOUBLE), 3) <= 0.4 AS thin FROM h, t")
def e11_coverage(spark, d):
    e = table(spark, d, "events")
    return tables.coverage(e, e.where("value > 300"), "user_id", "event_type")


@query("WITH y AS (SELECT year(o_orderdate) AS y FROM orders), s AS (SELECT unnest(generate_series((SELECT min(y) FROM y), (SELECT max(y) FROM y))) AS year) SELECT CAST(s.year AS INTEGER) AS year, count(y.y) AS n FROM s LEFT JOIN y ON y.y = s.year GROUP BY s.year")
def e15_year_histogram(spark, d):
    return tables.dense_years(table(spark, d, "orders"), F.year("o_orderdate"))


@query("SELECT lang, dense_rank() OVER (ORDER BY first_id) AS code FROM (SELECT lang, min(doc_id) AS first_id FROM documents GROUP BY lang)")
def e16_dictionary_encode(spark, d):
    first = table(spark, d, "documents").groupBy("lang").agg(F.min("doc_id").alias("first_id"))
    return first.select("lang", F.dense_rank().over(Window.orderBy("first_id")).cast("long").alias("code"))


_PAIR = "p AS (SELECT l.doc_id, l.quality AS a, CASE WHEN d.n_chars > 200 THEN 1 ELSE 0 END AS b, d.lang FROM labels l JOIN documents d USING (doc_id))"


@query(f"""WITH {_PAIR} SELECT lang, count(*) AS n, count(*) FILTER (WHERE a = b) AS agreed, count(*) FILTER (WHERE a = 1 AND b = 0) AS only_a, count(*) FILTER (WHERE a = 0 AND b = 1) AS only_b,
round(count(*) FILTER (WHERE a = 1 AND b = 1) / CAST(nullif(count(*) FILTER (WHERE a = 1 OR b = 1), 0) AS DOUBLE), 9) AS union_rate FROM p GROUP BY GROUPING SETS ((lang), ())""")
def e17_agreement_tally(spark, d):
    """Two readers by language and overall, in one pass of grouping sets."""
    l, t = T(spark, d, "labels", "documents")
    p = l.join(t, "doc_id").select("lang", (F.col("quality") == 1).alias("a"), (F.col("n_chars") > 200).alias("b"))
    a, b = F.col("a"), F.col("b")
    both = F.count_if(a & b) / F.nullif(F.count_if(a | b), F.lit(0))
    return p.rollup("lang").agg(F.count("*").alias("n"), F.count_if(a == b).alias("agreed"), F.count_if(a & ~b).alias("only_a"), F.count_if(~a & b).alias("only_b"), F.round(both, 9).alias("union_rate"))


@query(f"WITH {_PAIR} SELECT round(count(*) FILTER (WHERE a = 1 AND b = 1) / CAST(count(*) FILTER (WHERE b = 1) AS DOUBLE), 9) AS precision_, round(count(*) FILTER (WHERE a = 1 AND b = 1) / CAST(count(*) FILTER (WHERE a = 1) AS DOUBLE), 9) AS recall FROM p")
def e18_precision_recall(spark, d):
    l, t = T(spark, d, "labels", "documents")
    p = l.join(t, "doc_id").select((F.col("quality") == 1).alias("a"), (F.col("n_chars") > 200).alias("b"))
    hit = F.count_if(F.col("a") & F.col("b"))
    return p.agg(F.round(hit / F.count_if("b"), 9).alias("precision_"), F.round(hit / F.count_if("a"), 9).alias("recall"))


_D = "SELECT event_type, quantile_cont(value, 0.25) AS q1, quantile_cont(value, 0.5) AS q2, quantile_cont(value, 0.75) AS q3, count(*) AS n FROM events WHERE ts {} TIMESTAMP '2024-01-16' GROUP BY event_type"


@query(f"""WITH b AS ({_D.format('<')}), a AS ({_D.format('>=')}), j AS (SELECT coalesce(b.event_type, a.event_type) AS event_type, a.event_type AS ak, b.event_type AS bk, abs(a.q2 - b.q2) AS moved, b.q3 - b.q1 AS iqr, abs(a.n - b.n) / CAST(b.n AS DOUBLE) AS ch FROM b FULL JOIN a ON a.event_type = b.event_type)
SELECT event_type, round(CASE WHEN iqr > 0 THEN moved / iqr END, 9) AS median_shift, round(ch, 9) AS count_change,
CASE WHEN ak IS NULL THEN 'removed' WHEN bk IS NULL THEN 'added' WHEN iqr = 0 AND moved > 0 THEN 'constant moved' WHEN moved / iqr > 0.25 THEN 'median' WHEN ch > 0.25 THEN 'count' ELSE 'none' END AS reason FROM j""")
def e24_drift(spark, d):
    e = table(spark, d, "events")
    out = tables.drift(e.where("ts < timestamp'2024-01-16'"), e.where("ts >= timestamp'2024-01-16'"), "event_type", "value")
    return out.withColumns({"median_shift": F.round("median_shift", 9), "count_change": F.round("count_change", 9)})


@query("SELECT c_custkey, round((rank() OVER (ORDER BY c_acctbal DESC) + count(*) OVER (PARTITION BY c_acctbal) - 1) / CAST(count(*) OVER () AS DOUBLE), 9) AS share FROM customer")
def e26_share_at_least(spark, d):
    """Share of all rows whose value is at least the row's, over distinct values."""
    c = table(spark, d, "customer")
    per = c.groupBy("c_acctbal").agg(F.count("*").alias("n"))
    seen = per.withColumn("seen", F.sum("n").over(Window.orderBy(F.desc("c_acctbal")).rowsBetween(Window.unboundedPreceding, 0))).drop("n")
    total = c.agg(F.count("*").alias("total"))
    return c.join(seen, "c_acctbal").crossJoin(F.broadcast(total)).select("c_custkey", F.round(F.col("seen") / F.col("total"), 9).alias("share"))


@query("SELECT conv_id, arg_max(text, [turn, role = 'assistant']) AS last_text, max(turn) AS last_turn FROM (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role, text) AS k FROM conversations) WHERE k = 1) GROUP BY conv_id")
def f9_latest_per_key(spark, d):
    last = tables.keep_first(table(spark, d, "conversations"), ["conv_id"], [F.desc("turn"), F.asc("role"), F.asc("text")])
    return last.select("conv_id", F.col("text").alias("last_text"), F.col("turn").alias("last_turn"))


@query("""WITH s AS (SELECT *, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w <= 21600000000 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
k AS (SELECT *, sum(o) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS session FROM s)
SELECT event_id, CAST(session AS BIGINT) AS session, CAST(row_number() OVER (PARTITION BY user_id, session ORDER BY ts, event_id) AS INTEGER) AS position FROM k""")
def f12_sessions(spark, d):
    return tables.sessions(table(spark, d, "events"), "user_id", "ts", 6 * 3600, ["event_id"]).select("event_id", "session", "position")


@query("SELECT event_type, next_type, count(*) AS n FROM (SELECT event_type, coalesce(lead(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id), 'end') AS next_type FROM events) GROUP BY ALL")
def f11_transitions(spark, d):
    nxt = F.coalesce(F.lead("event_type").over(Window.partitionBy("user_id").orderBy("ts", "event_id")), F.lit("end"))
    return table(spark, d, "events").select("event_type", nxt.alias("next_type")).groupBy("event_type", "next_type").agg(F.count("*").alias("n"))


@query("SELECT event_type, user_id, event_id FROM (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS k FROM events) WHERE k <= 3 ORDER BY k, event_type LIMIT 10")
def f18_round_robin(spark, d):
    """The best of each family in turn."""
    k = F.row_number().over(Window.partitionBy("event_type").orderBy(F.desc("value"), "event_id"))
    return table(spark, d, "events").withColumn("k", k).where("k <= 3").orderBy("k", "event_type").limit(10).select("event_type", "user_id", "event_id")


@query("SELECT o_orderkey, total FROM (SELECT o_orderkey, o_totalprice, count(*) OVER () AS total FROM orders) ORDER BY o_totalprice DESC, o_orderkey LIMIT 20 OFFSET 40")
def f19_page_with_total(spark, d):
    o = table(spark, d, "orders")
    page = o.orderBy(F.desc("o_totalprice"), "o_orderkey").offset(40).limit(20).select("o_orderkey")
    return page.crossJoin(o.agg(F.count("*").alias("total")))


@query("SELECT c_nationkey AS k FROM customer INTERSECT SELECT s_nationkey FROM supplier")
def g2_intersection(spark, d):
    c, s = T(spark, d, "customer", "supplier")
    return c.select(F.col("c_nationkey").alias("k")).intersect(s.select("s_nationkey"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_orderstatus = 'P'")
def g3_difference(spark, d):
    c, o = T(spark, d, "customer", "orders")
    return c.select(F.col("c_custkey").alias("k")).subtract(o.where("o_orderstatus = 'P'").select("o_custkey"))


@query("SELECT doc_id AS k FROM labels UNION SELECT item_id FROM benchmark")
def g4_union_of_keys(spark, d):
    l, b = T(spark, d, "labels", "benchmark")
    return l.select(F.col("doc_id").alias("k")).union(b.select("item_id")).distinct()


@query("SELECT user_id, len(list_distinct(list(event_type))) = 5 AS has_all, list_has_all(list(event_type), ['purchase', 'error']) AS has_both FROM events GROUP BY user_id")
def g6_subset_test(spark, d):
    """Sets of at most five kinds for each user."""
    s = table(spark, d, "events").groupBy("user_id").agg(F.collect_set("event_type").alias("k"))
    return s.select("user_id", (F.size("k") == 5).alias("has_all"), (F.size(F.array_except(F.array(F.lit("purchase"), F.lit("error")), "k")) == 0).alias("has_both"))


@query("SELECT c_custkey, sum(coalesce(hit, 0)) AS later, round(avg(share), 9) AS share FROM (SELECT c_custkey, hit, (rank() OVER (ORDER BY early DESC) + count(*) OVER (PARTITION BY early) - 1) / CAST(count(*) OVER () AS DOUBLE) AS share FROM (SELECT c_custkey, coalesce(sum(o_totalprice) FILTER (WHERE o_orderdate < TIMESTAMP '1999-01-01'), 0) AS early, count(*) FILTER (WHERE o_orderdate >= TIMESTAMP '1999-01-01') AS hit FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey)) GROUP BY c_custkey HAVING sum(hit) > 0")
def i26_hindcast(spark, d):
    """Freeze at a cutoff, rank by what was known then, and see where the later ones stood.

    Totals are summed as decimals: equal ones tie, whatever the order in which tasks add their rows.
    """
    c, o = T(spark, d, "customer", "orders")
    end = F.lit("1999-01-01").cast("timestamp_ntz")
    price = F.col("o_totalprice").cast("decimal(28,6)")
    per = o.groupBy("o_custkey").agg(F.sum(F.when(F.col("o_orderdate") < end, price)).alias("early"), F.count_if(F.col("o_orderdate") >= end).alias("later"))
    all_ = c.join(per, c.c_custkey == per.o_custkey, "left").select("c_custkey", F.coalesce("early", F.lit(0)).alias("early"), F.coalesce("later", F.lit(0)).cast("long").alias("later"))
    all_ = cut(all_, "hindcast")
    at = running(all_.groupBy("early").agg(F.count("*").alias("n")), "early", {"seen": "n"}, descending=True).select("early", "seen")
    total = all_.agg(F.count("*").alias("total"))
    return all_.where("later > 0").join(at, "early").crossJoin(F.broadcast(total)).select("c_custkey", "later", F.round(F.col("seen") / F.col("total"), 9).alias("share"))
