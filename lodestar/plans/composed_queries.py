"""Composed queries: labels, camps, nested records, retrieval tiers, guards and logs."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import matching, models, ranking, retrieval, sampling, spatial
from lodestar.plans.registry import query
from lodestar.plans.spatial_queries import CROSS, CTE, R, cells, lines, points
from lodestar.plans.stat_queries import M, draw_sql, marked
from lodestar.plans.text_queries import TOK
from lodestar.session import scratch, table


@query(f"""{CTE}, a AS (SELECT cell_id, bool_or(label = 0 AND d2 <= 40000) AS dep, bool_or(label = 1 AND d2 <= {R * R}) AS occ FROM j GROUP BY cell_id)
SELECT cell_id, CASE WHEN dep THEN 'deposit' WHEN occ THEN 'occurrence' ELSE 'unlabelled' END AS tier FROM a""")
def i34_labels(spark, d):
    """The stronger label within its own radius wins; none is a label too."""
    near = spatial.radius_join(cells(spark).select("cell_id", "cx", "cy"), points(spark, d), R)
    by = near.groupBy("cell_id").agg(F.bool_or((F.col("label") == 0) & (F.col("d2") <= 40000)).alias("dep"), F.bool_or(F.col("label") == 1).alias("occ"))
    tier = F.when(F.col("dep"), "deposit").when(F.col("occ"), "occurrence").otherwise("unlabelled")
    return cells(spark).select("cell_id").join(by, "cell_id", "left").select("cell_id", tier.alias("tier"))


@query("""WITH RECURSIVE p AS (SELECT vec_id AS id, CAST(floor(CAST(embedding[1] AS DOUBLE) * 10000) AS BIGINT) AS x, CAST(floor(CAST(embedding[2] AS DOUBLE) * 10000) AS BIGINT) AS y FROM embeddings),
e AS (SELECT a.id AS u, b.id AS v FROM p a JOIN p b ON (a.x - b.x) * (a.x - b.x) + (a.y - b.y) * (a.y - b.y) <= 3600),
r AS (SELECT id, id AS o FROM p UNION SELECT r.id, e.v FROM r JOIN e ON e.u = r.o) SELECT id, min(o) AS camp FROM r GROUP BY id""")
def h5_camps(spark, d):
    """Single linkage: points within 60 of one another, by spreading the smallest id."""
    p = points(spark, d).select("id", "x", "y")
    q = p.select(F.col("id").alias("cell_id"), F.col("x").cast("double").alias("cx"), F.col("y").cast("double").alias("cy"))
    edges = spatial.radius_join(q, p, 60).where("cell_id < id").select(F.col("cell_id").alias("u"), F.col("id").alias("v"))
    return sampling.components(p, edges, scratch(spark, "camps")).select("id", F.col("root").alias("camp"))


@query(f"""{CTE}, {CROSS}, n AS (SELECT c.cell_id, count(z.x) FILTER (WHERE (z.x - cx) ** 2 + (z.y - cy) ** 2 <= {R * R}) AS n, round(sqrt(min((z.x - cx) ** 2 + (z.y - cy) ** 2) FILTER (WHERE (z.x - cx) ** 2 + (z.y - cy) ** 2 <= {R * R})), 6) AS nearest FROM c LEFT JOIN z ON true GROUP BY c.cell_id) SELECT * FROM n""")
def d18_crossings_near(spark, d):
    z = spatial.crossings(lines(spark, d), 500)
    near = spatial.radius_join(cells(spark).select("cell_id", "cx", "cy"), z, R).groupBy("cell_id").agg(F.count("*").alias("n"), F.round(F.sqrt(F.min("d2")), 6).alias("nearest"))
    return cells(spark).select("cell_id").join(near, "cell_id", "left").select("cell_id", F.coalesce("n", F.lit(0)).cast("long").alias("n"), "nearest")


@query("SELECT o_orderkey, count(*) AS holes, sum(l_quantity) AS total, max(l_partkey) AS part FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY o_orderkey")
def b18_nested_flatten(spark, d):
    """Rows nested as a record holds them, and flattened again."""
    o, l = table(spark, d, "orders"), table(spark, d, "lineitem")
    nested = o.join(l, o.o_orderkey == l.l_orderkey).groupBy("o_orderkey").agg(F.collect_list(F.struct("l_partkey", "l_quantity")).alias("holes"))
    flat = nested.select("o_orderkey", F.explode("holes").alias("h")).select("o_orderkey", "h.*")
    return flat.groupBy("o_orderkey").agg(F.count("*").alias("holes"), F.sum("l_quantity").alias("total"), F.max("l_partkey").alias("part"))


@query("""WITH a AS (SELECT doc_id, n_chars AS v FROM documents WHERE n_chars > 500), b AS (SELECT doc_id, -n_chars AS v FROM documents WHERE lang = 'en')
SELECT coalesce(a.doc_id, b.doc_id) AS doc_id, coalesce(a.v, b.v) AS v, CASE WHEN a.doc_id IS NOT NULL THEN 'layer' ELSE 'read' END AS source FROM a FULL JOIN b ON a.doc_id = b.doc_id""")
def b22_merge_priority(spark, d):
    t = table(spark, d, "documents")
    a = t.where("n_chars > 500").select(F.col("doc_id").alias("a_id"), F.col("n_chars").alias("a_v"))
    b = t.where("lang = 'en'").select(F.col("doc_id").alias("b_id"), (-F.col("n_chars")).alias("b_v"))
    return a.join(b, F.col("a_id") == F.col("b_id"), "full").select(F.coalesce("a_id", "b_id").alias("doc_id"), F.coalesce("a_v", "b_v").alias("v"), F.when(F.col("a_id").isNotNull(), "layer").otherwise("read").alias("source"))


@query("""SELECT o_orderkey, coalesce(c.c_name, s.s_name, n.n_name) AS resolved, CASE WHEN c.c_name IS NOT NULL THEN 'same' WHEN s.s_name IS NOT NULL THEN 'collection' WHEN n.n_name IS NOT NULL THEN 'prefix' END AS how
FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) c ON c_custkey = o_custkey LEFT JOIN supplier s ON s_suppkey = o_custkey LEFT JOIN nation n ON n_nationkey = o_custkey % 30""")
def c17_first_match_resolution(spark, d):
    o, c, s, n = (table(spark, d, t) for t in ("orders", "customer", "supplier", "nation"))
    j = o.join(c.where("c_acctbal > 5000"), o.o_custkey == c.c_custkey, "left").join(s, o.o_custkey == s.s_suppkey, "left").join(n, o.o_custkey % 30 == n.n_nationkey, "left")
    how = F.when(F.col("c_name").isNotNull(), "same").when(F.col("s_name").isNotNull(), "collection").when(F.col("n_name").isNotNull(), "prefix")
    return j.select("o_orderkey", F.coalesce("c_name", "s_name", "n_name").alias("resolved"), how.alias("how"))


@query("""WITH x AS (SELECT conv_id, turn, CASE WHEN role = 'system' OR turn % 3 = 0 THEN role END AS head FROM (SELECT *, row_number() OVER (PARTITION BY conv_id, turn ORDER BY role, text) AS k FROM conversations) WHERE k = 1)
SELECT conv_id, turn, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS head FROM x""")
def s12_carry_forward(spark, d):
    first = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))
    x = table(spark, d, "conversations").withColumn("k", first).where("k = 1").withColumn("h", F.when((F.col("role") == "system") | (F.col("turn") % 3 == 0), F.col("role")))
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return x.select("conv_id", "turn", F.last("h", ignorenulls=True).over(w).alias("head"))


@query("SELECT conv_id, string_agg(upper(left(role, 1)) || ':' || CAST(length(text) AS VARCHAR), '|' ORDER BY turn, role, text) AS line FROM conversations GROUP BY conv_id")
def s13_joined_text(spark, d):
    """Parts put in order and joined; a conversation is short by what it is."""
    part = F.concat(F.upper(F.substring("role", 1, 1)), F.lit(":"), F.length("text").cast("string"))
    rows = F.array_sort(F.collect_list(F.struct("turn", "role", "text", part.alias("p"))))
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.array_join(F.transform(rows, lambda r: r["p"]), "|").alias("line"))


@query("""WITH s AS (SELECT event_id, event_id // 3 AS parent, value AS dur FROM events) SELECT p.event_id AS parent, count(c.event_id) AS children, round(sum(c.dur), 4) AS inside, round(quantile_cont(c.dur, 0.95), 6) AS p95
FROM s p JOIN s c ON c.parent = p.event_id AND c.event_id <> p.event_id GROUP BY p.event_id""")
def s43_span_tree(spark, d):
    s = table(spark, d, "events").select("event_id", F.floor(F.col("event_id") / 3).alias("parent"), F.col("value").alias("dur"))
    p = s.select(F.col("event_id").alias("p_id"))
    j = s.join(p, (s.parent == F.col("p_id")) & (s.event_id != F.col("p_id")))
    return j.groupBy(F.col("p_id").alias("parent")).agg(F.count("*").alias("children"), F.round(F.sum("dur"), 4).alias("inside"), F.round(F.percentile("dur", F.lit(0.95)), 6).alias("p95"))


@query("SELECT event_type, round(sum(value) / sum(user_id + 1), 9) AS ratio, count(*) FILTER (WHERE value > 100) AS over, round(avg(CASE WHEN user_id % 4 <> 0 THEN value END), 6) AS known_mean FROM events GROUP BY event_type")
def e21_ratio_of_sums(spark, d):
    return table(spark, d, "events").groupBy("event_type").agg(F.round(F.sum("value") / F.sum(F.col("user_id") + 1), 9).alias("ratio"), F.count_if(F.col("value") > 100).alias("over"), F.round(F.avg(F.when(F.col("user_id") % 4 != 0, F.col("value"))), 6).alias("known_mean"))


@query("SELECT c.conv_id, count(*) AS turns, count(*) FILTER (WHERE role = 'user') AS user_turns FROM conversations c GROUP BY c.conv_id")
def e23_turn_counts(spark, d):
    return table(spark, d, "conversations").groupBy("conv_id").agg(F.count("*").alias("turns"), F.count_if(F.col("role") == "user").alias("user_turns"))


@query("SELECT source, round(avg(n_chars), 6) AS mean_chars, count(*) AS n, list_aggregate(list_sort(list_distinct(list(lang)))[1:40], 'string_agg', ',') AS langs FROM documents GROUP BY source")
def e9_file_summary(spark, d):
    return table(spark, d, "documents").groupBy("source").agg(F.round(F.avg("n_chars"), 6).alias("mean_chars"), F.count("*").alias("n"), F.array_join(F.slice(F.array_sort(F.collect_set("lang")), 1, 40), ",").alias("langs"))


@query("""WITH w AS (SELECT item_id, string_split(text, ' ') AS w FROM benchmark), g AS (SELECT item_id, unnest(generate_series(1, len(w))) AS i, w FROM w), n AS (SELECT item_id, i, unnest([1, 2, 3, 4, 5, 6]) AS k, w FROM g)
SELECT item_id, k, count(DISTINCT array_to_string(w[i:i + k - 1], ' ')) AS grams FROM n WHERE i + k - 1 <= len(w) GROUP BY item_id, k""")
def f15_sliding_grams(spark, d):
    w = table(spark, d, "benchmark").select("item_id", F.split("text", " ").alias("w"))
    n = w.withColumn("k", F.explode(F.array(*(F.lit(k) for k in range(1, 7))))).where(F.size("w") >= F.col("k"))
    grams = F.transform(F.sequence(F.lit(1), F.size("w") - F.col("k") + 1), lambda i: F.array_join(F.slice(F.col("w"), i, F.col("k")), " "))
    return n.select("item_id", "k", F.explode(grams).alias("g")).groupBy("item_id", "k").agg(F.count_distinct("g").alias("grams"))


@query("SELECT p_brand, CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER) AS version, row_number() OVER (ORDER BY CAST(regexp_extract(p_brand, '(\\d+)', 1) AS INTEGER), p_brand) AS place FROM (SELECT DISTINCT p_brand FROM part)")
def f17_natural_sort(spark, d):
    v = F.regexp_extract("p_brand", r"(\d+)", 1).cast("int")
    b = table(spark, d, "part").select("p_brand").distinct().withColumn("version", v)
    return b.withColumn("place", F.row_number().over(Window.orderBy("version", "p_brand")).cast("long"))


@query(f"{M}, t AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY block, label ORDER BY {draw_sql('doc_id')}, doc_id) AS k FROM m) WHERE label = 1 OR k = 1), w AS (SELECT lang, 4 * count(*) AS want FROM t WHERE label = 0 GROUP BY lang), g AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY {draw_sql('doc_id')}, doc_id) AS r FROM t WHERE label = 1) SELECT doc_id FROM t WHERE label = 0 UNION ALL SELECT doc_id FROM g JOIN w USING (lang) WHERE r <= want")
def h8_training_mask(spark, d):
    """Thin the rarer class by block, then match the other to it by language."""
    flipped = marked(spark, d).withColumn("label", 1 - F.col("label"))
    return sampling.match_background(sampling.thin(flipped, "block", "label", "doc_id"), "lang", "label", "doc_id", 4).select("doc_id")


@query(f"""{M}, a AS (SELECT lang, doc_id, (rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0) AS ra, (rank() OVER (ORDER BY prob) + (count(*) OVER (PARTITION BY prob) - 1) / 2.0) AS rb, count(*) OVER () AS n FROM m)
SELECT doc_id, round((ra / n + rb / n) / 2, 9) AS score FROM a""")
def i17_rank_average(spark, d):
    m = ranking.average_rank(ranking.average_rank(marked(spark, d), "score", "ra"), "prob", "rb")
    n = m.agg(F.count("*").alias("n"))
    return m.crossJoin(F.broadcast(n)).select("doc_id", F.round((F.col("ra") / F.col("n") + F.col("rb") / F.col("n")) / 2, 9).alias("score"))


@query(f"{M} SELECT lang, count(*) AS n, round(avg(CASE WHEN (prob >= 0.5) = (label = 1) THEN 1.0 ELSE 0.0 END), 9) AS accuracy, round(avg(CASE WHEN prob BETWEEN 0.45 AND 0.55 THEN 1.0 ELSE 0.0 END), 9) AS abstained FROM m GROUP BY GROUPING SETS ((lang), ())")
def i12_per_stratum(spark, d):
    right = ((F.col("prob") >= 0.5) == (F.col("label") == 1)).cast("double")
    return marked(spark, d).rollup("lang").agg(F.count("*").alias("n"), F.round(F.avg(right), 9).alias("accuracy"), F.round(F.avg(F.col("prob").between(0.45, 0.55).cast("double")), 9).alias("abstained"))


def _tier_sql(k: int) -> str:
    return f"""WITH q AS (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark), qs AS (SELECT DISTINCT * FROM q),
a AS (SELECT DISTINCT doc_id AS id, unnest({TOK.format('text')}) AS term FROM documents WHERE lang = 'en'), b AS (SELECT DISTINCT doc_id AS id, unnest({TOK.format('text')}) AS term FROM documents WHERE lang <> 'en'),
h AS (SELECT query_id, id, 1 AS tier, count(*) AS hits FROM a JOIN qs USING (term) GROUP BY ALL UNION ALL SELECT query_id, id, 2, count(*) FROM b JOIN qs USING (term) GROUP BY ALL)
SELECT query_id, id, tier, hits, CAST(k AS INTEGER) AS place FROM (SELECT *, row_number() OVER (PARTITION BY query_id, tier ORDER BY hits DESC, id) AS k FROM h) WHERE k <= {k}"""


@query(_tier_sql(3))
def m7_tiered_retrieval(spark, d):
    """The best of each tier of trust, tiers in order."""
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    q = items.select(F.col("item_id").alias("query_id"), F.explode(tx.tokens(F.col("text"))).alias("term")).distinct()
    tier = F.when(F.col("lang") == "en", 1).otherwise(2)
    hits = retrieval.shared_terms(docs.withColumn("tier", tier), "doc_id", tx.tokens(F.col("text")), q, ["tier"])
    place = F.row_number().over(Window.partitionBy("query_id", "tier").orderBy(F.desc("hits"), "id"))
    return hits.withColumn("place", place).where("place <= 3").select("query_id", "id", "tier", "hits", "place")


@query("SELECT l.doc_id FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents WHERE source = 'src0') AND l.quality = 1")
def o10_held_out_guard(spark, d):
    """Rows that a training set must not have: an empty result lets the run go on."""
    l, t = table(spark, d, "labels"), table(spark, d, "documents")
    return l.where("quality = 1").join(t.where("source = 'src0'"), "doc_id", "left_semi").select("doc_id")


@query("WITH s AS (SELECT event_type, sum(value) AS used FROM events GROUP BY event_type) SELECT event_type, used <= 20000 AS allowed, sum(used) OVER () <= 100000 AS total_allowed FROM s")
def o9_budget_guard(spark, d):
    s = table(spark, d, "events").groupBy("event_type").agg(F.sum("value").alias("used"))
    total = s.agg(F.sum("used").alias("total"))
    return s.crossJoin(F.broadcast(total)).select("event_type", (F.col("used") <= 20000).alias("allowed"), (F.col("total") <= 100000).alias("total_allowed"))


@query("SELECT doc_id FROM documents d WHERE NOT EXISTS (SELECT 1 FROM documents e WHERE sha256(e.text) = sha256(d.text) AND e.lang = 'en' AND e.n_chars < 1000)")
def p8_call_cache_misses(spark, d):
    """Work whose content hash no successful call is stored under."""
    t = table(spark, d, "documents").select("doc_id", "lang", "n_chars", F.sha2(F.col("text").cast("binary"), 256).alias("h"))
    return t.join(t.where("lang = 'en' and n_chars < 1000").select("h").distinct(), "h", "left_anti").select("doc_id")


@query("WITH b AS (SELECT count(DISTINCT user_id) AS n FROM events WHERE event_type = 'view'), s AS (SELECT event_type, count(DISTINCT user_id) AS n FROM events WHERE user_id IN (SELECT user_id FROM events WHERE event_type = 'view') GROUP BY event_type) SELECT event_type, s.n AS covered, s.n >= 0.9 * b.n AS full_run FROM s, b")
def s2_full_runs(spark, d):
    e = table(spark, d, "events").select("user_id", "event_type").distinct()
    base = e.where("event_type = 'view'").select("user_id")
    n = base.agg(F.count("*").alias("base"))
    s = e.join(base, "user_id", "left_semi").groupBy("event_type").agg(F.count("*").alias("covered"))
    return s.crossJoin(F.broadcast(n)).select("event_type", "covered", (F.col("covered") >= 0.9 * F.col("base")).alias("full_run"))


@query()
def c15_fuzzy_names(spark, d):
    """Distinct part names against misprinted ones, by shared grams and similarity; Indel similarity is beyond SQL."""
    names = table(spark, d, "part").groupBy("p_name").agg(F.min("p_partkey").alias("id"))
    wrong = names.select("id", F.translate("p_name", "aeo", "eao").alias("title"))
    return matching.fuzzy_join(names, wrong, "p_name", "title", 60)


@query()
def c16_greedy_alignment(spark, d):
    """Turns of the two roles of a conversation paired best first; the order dependence is beyond SQL."""
    c = table(spark, d, "conversations")
    u, a = c.where("role = 'user'"), c.where("role = 'assistant'")
    pairs = u.select("conv_id", F.col("turn").alias("a"), F.length("text").alias("n")).join(a.select("conv_id", F.col("turn").alias("b"), F.length("text").alias("m")), "conv_id")
    return matching.greedy_pairs(pairs.select("conv_id", "a", "b", (1 / (1 + F.abs(F.col("n") - F.col("m")))).alias("score")), "conv_id")


@query()
def i5_out_of_fold(spark, d):
    """Logistic scores from models that never saw the block's fold; fitting is beyond SQL."""
    m = sampling.folds(marked(spark, d), "block", 3).withColumn("label", F.col("label").cast("int"))
    ready, names = models.with_indicators(m, ["score", "n_chars", "prob"])
    return models.out_of_fold(ready, models.classifier("logistic", names, "label"), "label").select("doc_id", "fold", "score")
