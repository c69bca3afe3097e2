"""Small column, filter and pick operators, one query each."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.plans.registry import query
from lodestar.plans.stat_queries import M, marked, portable_sql
from lodestar.session import table


def portable(c, seed: int):
    from lodestar.operators.sampling import portable as draw

    return draw(c, F.lit(0), seed)


def place_sql(id_: str, seed: int) -> str:
    return portable_sql(id_, seed).replace("CAST(rep AS VARCHAR)", "'0'")


@query("SELECT event_id FROM events WHERE event_id % 100 BETWEEN 10 AND 40 AND value BETWEEN 20 AND 60")
def b6_box_filter(spark, d):
    e = table(spark, d, "events")
    return e.where((F.col("event_id") % 100).between(10, 40) & F.col("value").between(20, 60)).select("event_id")


@query("SELECT user_id, max(CASE WHEN event_type = 'view' THEN value END) AS best_view, max(CASE WHEN event_type = 'click' THEN value END) AS best_click FROM events GROUP BY user_id")
def b8_case_pivot(spark, d):
    best = lambda k: F.max(F.when(F.col("event_type") == k, F.col("value")))
    return table(spark, d, "events").groupBy("user_id").agg(best("view").alias("best_view"), best("click").alias("best_click"))


NULLS = "WITH n AS (SELECT event_id, CASE WHEN event_id % 3 <> 0 THEN value END AS a, CASE WHEN event_id % 5 <> 0 THEN value * 2 END AS b FROM events)"


def with_nulls(spark, d):
    e, v = F.col("event_id"), F.col("value")
    return table(spark, d, "events").select(e, F.when(e % 3 != 0, v).alias("a"), F.when(e % 5 != 0, v * 2).alias("b"))


@query(f"{NULLS} SELECT event_id, a, b FROM n WHERE a IS NOT NULL AND b IS NOT NULL")
def b10_complete_cases(spark, d):
    return with_nulls(spark, d).na.drop(subset=["a", "b"])


@query("SELECT o_orderkey, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderstatus = 'F' AS DOUBLE) END AS is_f, CASE WHEN o_orderstatus <> 'P' THEN CAST(o_orderstatus = 'O' AS DOUBLE) END AS is_o FROM orders")
def b12_one_hot(spark, d):
    """1 or 0 by class, null where no class is mapped."""
    s = F.col("o_orderstatus")
    return table(spark, d, "orders").select("o_orderkey", *(F.when(s != "P", (s == k).cast("double")).alias(f"is_{k.lower()}") for k in ("F", "O")))


@query(f"{NULLS} SELECT event_id, round(b - a, 3) AS gain FROM n")
def b14_difference(spark, d):
    return with_nulls(spark, d).select("event_id", F.round(F.col("b") - F.col("a"), 3).alias("gain"))


@query("SELECT c_custkey AS id, c_name AS name, 'customer' AS origin, 'native' AS tier FROM customer")
def b15_provenance(spark, d):
    return table(spark, d, "customer").withColumnsRenamed({"c_custkey": "id", "c_name": "name"}).select("id", "name").withColumns({"origin": F.lit("customer"), "tier": F.lit("native")})


@query("SELECT event_id, CASE WHEN event_id % 4 IN (0, 1) THEN NULL ELSE value END AS value FROM events")
def b16_finite_or_null(spark, d):
    e = F.col("event_id") % 4
    odd = F.when(e == 0, float("nan")).when(e == 1, float("-inf")).otherwise(F.col("value"))
    return table(spark, d, "events").select("event_id", tx.finite(odd).alias("value"))


@query("SELECT conv_id, turn, unnest(string_split(role || ',' || CAST(turn AS VARCHAR), ',')) AS item FROM conversations")
def b17_json_array(spark, d):
    array = F.to_json(F.array(F.col("role"), F.col("turn").cast("string")))
    return table(spark, d, "conversations").select("conv_id", "turn", array.alias("j")).select("conv_id", "turn", F.explode(F.from_json("j", "array<string>")).alias("item"))


@query("WITH keep AS (SELECT * FROM lineitem WHERE l_returnflag <> 'R') SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM keep)")
def b19_drop_with_values(spark, d):
    """Rows go, and with them the values that only they cite."""
    kept = table(spark, d, "lineitem").where("l_returnflag <> 'R'").select(F.col("l_partkey").alias("p_partkey"))
    return table(spark, d, "part").join(kept, "p_partkey", "left_semi").select("p_partkey")


@query("SELECT o_custkey, min(o_orderpriority) AS first_priority, min(o_clerk) AS one FROM (SELECT o_custkey, o_orderpriority, 'k' || o_custkey AS o_clerk FROM orders) GROUP BY o_custkey")
def e7_any_value(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderpriority", F.concat(F.lit("k"), "o_custkey").alias("clerk"))
    return o.groupBy("o_custkey").agg(F.min("o_orderpriority").alias("first_priority"), F.any_value("clerk").alias("one"))


@query("SELECT user_id, event_type, round(avg(value), 6) AS score, count(*) AS repeats FROM events GROUP BY user_id, event_type")
def e8_repeated_scores(spark, d):
    return table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("score"), F.count("*").alias("repeats"))


@query("SELECT c_custkey, coalesce(count(o_orderkey) FILTER (WHERE o_orderpriority LIKE '1%'), 0) AS effort, coalesce(count(o_orderkey) FILTER (WHERE o_orderpriority NOT LIKE '1%'), 0) AS geology FROM customer LEFT JOIN orders ON o_custkey = c_custkey GROUP BY c_custkey")
def e10_coverage_by_effort(spark, d):
    effort = F.col("o_orderpriority").startswith("1")
    n = table(spark, d, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count_if(effort).alias("effort"), F.count_if(~effort).alias("geology"))
    return table(spark, d, "customer").select("c_custkey").join(n, "c_custkey", "left").fillna(0, ["effort", "geology"])


@query("SELECT CAST(floor(value / 10) AS BIGINT) AS cell, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1")
def e25_bincount(spark, d):
    return table(spark, d, "events").groupBy(F.floor(F.col("value") / 10).alias("cell")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("SELECT doc_id, row_number() OVER (PARTITION BY lang ORDER BY n_chars DESC, source, doc_id) AS place FROM documents")
def f16_stable_sort(spark, d):
    """Places by several keys with tiebreaks, within a language."""
    w = Window.partitionBy("lang").orderBy(F.desc("n_chars"), "source", "doc_id")
    return table(spark, d, "documents").select("doc_id", F.row_number().over(w).cast("long").alias("place"))


ROWS = "WITH b AS (SELECT event_id AS word_id, user_id AS page, value / 500 AS y, (event_id * 7 % 100) / 100.0 AS x FROM events), l AS (SELECT *, y - lag(y) OVER w AS gap FROM b WINDOW w AS (PARTITION BY page ORDER BY y, word_id))"


@query(f"{ROWS}, r AS (SELECT *, sum(CASE WHEN gap > 0.01 OR gap IS NULL THEN 1 ELSE 0 END) OVER (PARTITION BY page ORDER BY y, word_id ROWS UNBOUNDED PRECEDING) AS line FROM l) SELECT page, line, count(*) AS words, string_agg(CAST(word_id AS VARCHAR), ' ' ORDER BY x, word_id) AS text FROM r GROUP BY page, line")
def f13_rows_of_words(spark, d):
    """Words to lines: a new one starts where the centre is more than a tolerance below the word before."""
    e, w = F.col("event_id"), Window.partitionBy("page").orderBy("y", "word_id")
    b = table(spark, d, "events").select(e.alias("word_id"), F.col("user_id").alias("page"), (F.col("value") / 500).alias("y"), (e * 7 % 100 / F.lit(100.0)).alias("x"))
    start = F.coalesce((F.col("y") - F.lag("y").over(w) > 0.01).cast("int"), F.lit(1))
    r = b.withColumn("start", start).withColumn("line", F.sum("start").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    words = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("x", "word_id"))), lambda s: s["word_id"].cast("string")), " ")
    return r.groupBy("page", "line").agg(F.count("*").alias("words"), words.alias("text"))


@query("SELECT conv_id, list_aggregate(list_distinct(list(role)), 'string_agg', ',') AS roles FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role ORDER BY conv_id, t) GROUP BY conv_id HAVING false UNION ALL SELECT conv_id, string_agg(role, ',' ORDER BY t, role) FROM (SELECT conv_id, role, min(turn) AS t FROM conversations GROUP BY conv_id, role) GROUP BY conv_id")
def g5_ordered_distinct(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("a"))
    return c.select("conv_id", F.array_join(F.array_distinct(F.transform("a", lambda s: s["role"])), ",").alias("roles"))


@query(f"{M}, k AS (SELECT doc_id, source, row_number() OVER (PARTITION BY source ORDER BY {place_sql('doc_id', 18)}, doc_id) AS k FROM m) SELECT doc_id, row_number() OVER (ORDER BY k, source) AS place FROM k WHERE k <= 3")
def h18_stratum_cursor(spark, d):
    """One of each stratum in turn: the first of all, then the second of all."""
    k = F.row_number().over(Window.partitionBy("source").orderBy(portable(F.col("doc_id"), 18), "doc_id"))
    m = marked(spark, d).withColumn("k", k).where("k <= 3")
    return m.select("doc_id", F.row_number().over(Window.orderBy("k", "source")).cast("long").alias("place"))  # three rows a stratum


@query("SELECT source, doc_id FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY sha256('split-' || CAST(doc_id AS VARCHAR)), doc_id) AS k FROM documents) WHERE k = 1")
def h19_lowest_hash(spark, d):
    """Of each source the row with the lowest hash is held out."""
    h = F.sha2(F.concat(F.lit("split-"), F.col("doc_id").cast("string")).cast("binary"), 256)
    return table(spark, d, "documents").groupBy("source").agg(F.min_by("doc_id", F.struct(h, "doc_id")).alias("doc_id"))


@query("SELECT user_id, event_type, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS spread FROM events GROUP BY user_id, event_type HAVING count(*) > 1")
def h21_seed_average(spark, d):
    g = table(spark, d, "events").groupBy("user_id", "event_type").agg(F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_samp("value"), 6).alias("spread"), F.count("*").alias("n"))
    return g.where("n > 1").drop("n")


@query(f"{M} SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY {place_sql('doc_id', 22)}, doc_id) AS k FROM m) WHERE k <= CASE label WHEN 1 THEN 12 ELSE 8 END")
def h22_pilot_draw(spark, d):
    k = F.row_number().over(Window.partitionBy("label").orderBy(portable(F.col("doc_id"), 22), "doc_id"))
    return marked(spark, d).withColumn("k", k).where(F.col("k") <= F.when(F.col("label") == 1, 12).otherwise(8)).select("doc_id", "label")


@query(f"{M} SELECT doc_id, CAST(floor({place_sql('doc_id', 33)} * 5) AS BIGINT) AS fold FROM m")
def h3_random_folds(spark, d):
    return marked(spark, d).select("doc_id", F.floor(portable(F.col("doc_id"), 33) * 5).alias("fold"))


@query(f"{M}, b AS (SELECT avg(CAST(label AS DOUBLE)) AS p, count(*) AS n FROM m) SELECT n AS n_cells, round(p, 9) AS precision, 0.5 AS recall, round(p / (p + 0.5), 9) AS f1, round(p, 9) AS pr_auc, 0.5 AS roc_auc, round(list_avg(list_transform([0.05, 0.15, 0.25, 0.35, 0.45, 0.55, 0.65, 0.75, 0.85, 0.95], lambda x: abs(p - x))), 9) AS ece FROM b")
def i13_random_expectation(spark, d):
    """What a uniform random probability scores at a threshold of one half, in closed form."""
    b = marked(spark, d).agg(F.avg(F.col("label").cast("double")).alias("p"), F.count("*").alias("n"))
    p = F.col("p")
    gap = sum((F.abs(p - (k + 0.5) / 10) for k in range(10)), F.lit(0.0)) / 10
    return b.select(F.col("n").alias("n_cells"), F.round(p, 9).alias("precision"), F.lit(0.5).alias("recall"), F.round(p / (p + 0.5), 9).alias("f1"), F.round(p, 9).alias("pr_auc"), F.lit(0.5).alias("roc_auc"), F.round(gap, 9).alias("ece"))


FILES = "SELECT p_partkey, CASE p_partkey % 4 WHEN 0 THEN ' maw ' || CAST(p_partkey AS VARCHAR) WHEN 1 THEN '74h' || printf('%02d', p_size % 16 + 1) || '-' || printf('%03d', p_partkey % 1000) WHEN 2 THEN 'MAW0' || CAST(p_partkey AS VARCHAR) ELSE 'file ' || p_brand END AS t, p_partkey % 4 AS k, p_size, p_brand FROM part"


@query(f"""SELECT p_partkey, CASE k WHEN 0 THEN 'MAW' || printf('%05d', p_partkey) WHEN 1 THEN '74H' || printf('%02d', p_size % 16 + 1) || '-' || printf('%04d', p_partkey % 1000) WHEN 2 THEN 'MAW' || printf('%05d', p_partkey) ELSE upper('file' || replace(p_brand, ' ', '')) END AS file_num, CASE k WHEN 1 THEN '74H' || printf('%02d', p_size % 16 + 1) END AS sheet FROM ({FILES})""")
def j6_file_number(spark, d):
    k, id_ = F.col("p_partkey") % 4, F.col("p_partkey")
    t = F.when(k == 0, F.concat(F.lit(" maw "), id_.cast("string"))).when(k == 1, F.concat(F.lit("74h"), F.format_string("%02d", F.col("p_size") % 16 + 1), F.lit("-"), F.format_string("%03d", id_ % 1000))).when(k == 2, F.concat(F.lit("MAW0"), id_.cast("string"))).otherwise(F.concat(F.lit("file "), F.col("p_brand")))
    return table(spark, d, "part").select("p_partkey", tx.file_number(t).alias("file_num"), tx.sheet_of(t).alias("sheet"))


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN 'CUSTOMER' WHEN 1 THEN 'K & L' WHEN 2 THEN 'NORD' ELSE 'UNKNOWN' END AS company FROM customer")
def j15_company_key(spark, d):
    k = F.col("c_custkey") % 4
    name = F.when(k == 0, F.concat(F.lit("The Customer Co. Ltd, no. "), F.col("c_custkey").cast("string"))).when(k == 1, "K & L Surveys Inc").when(k == 2, "NORD LTD-SUED MINES LTD").otherwise("(tenure holder)")
    return table(spark, d, "customer").select("c_custkey", tx.company_key(name).alias("company"))


@query("SELECT o_orderkey, CASE WHEN y < 1980 THEN '1970s' WHEN y < 2000 THEN '1980s-1990s' ELSE '2000s+' END AS era, y < 1968 AS early FROM (SELECT o_orderkey, year(o_orderdate) - o_orderkey % 40 AS y FROM orders)")
def j15_era(spark, d):
    e = tx.era(F.year("o_orderdate") - F.col("o_orderkey") % 40)
    return table(spark, d, "orders").select("o_orderkey", e.alias("e")).select("o_orderkey", "e.era", "e.early")


@query("WITH s AS (SELECT s_suppkey AS k, s_suppkey % 90 + 1 AS a, s_suppkey % 5 AS n FROM supplier), x AS (SELECT k, a, a + n AS b FROM s) SELECT k AS s_suppkey, 'SB-' || CASE WHEN length(CAST(a AS VARCHAR)) = length(CAST(b AS VARCHAR)) THEN lpad(CAST(i AS VARCHAR), CAST(length(CAST(a AS VARCHAR)) AS INTEGER), '0') ELSE CAST(i AS VARCHAR) END AS name FROM (SELECT k, a, b, unnest(generate_series(a, b)) AS i FROM x)")
def j12_name_range(spark, d):
    a = F.col("s_suppkey") % 90 + 1
    t = F.concat(F.lit("SB-"), a.cast("string"), F.lit(" to SB-"), (a + F.col("s_suppkey") % 5).cast("string"))
    return table(spark, d, "supplier").select("s_suppkey", F.explode(tx.name_range(t)).alias("name"))


@query("SELECT page_id, left(regexp_replace(url, '[^A-Za-z0-9._-]+', '_', 'g'), 80) AS file FROM pages")
def j14_safe_name(spark, d):
    return table(spark, d, "pages").select("page_id", tx.safe_file_name(F.col("url")).alias("file"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 7 <> 0 THEN CAST(year(o_orderdate) AS DOUBLE) END AS year FROM orders")
def j17_epoch_year(spark, d):
    millis = F.unix_millis(F.col("o_orderdate").cast("timestamp"))
    return table(spark, d, "orders").select("o_orderkey", tx.year_of_millis(F.when(F.col("o_orderkey") % 7 == 0, F.lit(-9_000_000_000_000)).otherwise(millis)).cast("double").alias("year"))


@query("SELECT s_suppkey, CASE s_suppkey % 5 WHEN 0 THEN 'eU3O8' WHEN 1 THEN 'U3O8' WHEN 2 THEN 'U' WHEN 3 THEN 'not_printed' ELSE 'other' END AS species, CASE s_suppkey % 5 WHEN 0 THEN 'probe_equivalent' WHEN 1 THEN 'chemical' ELSE 'not_printed' END AS basis FROM supplier")
def j24_species(spark, d):
    k = F.col("s_suppkey") % 5
    t = F.when(k == 0, "eU 3O8 by probe").when(k == 1, "U3O8 assay").when(k == 2, "U ppm").when(k == 3, " ").otherwise("Ni %")
    return table(spark, d, "supplier").select("s_suppkey", tx.species_of(t).alias("species"), tx.basis_of(t).alias("basis"))


@query("SELECT event_id, CASE WHEN event_id % 3 = 0 THEN 'm1' WHEN value = floor(value) THEN 'int' ELSE 'm2' END AS fmt, round(3 + 6 * log10(1 + least(value, 100)) / log10(101), 9) AS radius FROM events")
def j27_format_and_radius(spark, d):
    unit = F.when(F.col("event_id") % 3 == 0, "ppm").otherwise("pct")
    return table(spark, d, "events").select("event_id", tx.number_format(unit, F.col("value")).alias("fmt"), F.round(tx.point_radius(F.col("value"), 100.0), 9).alias("radius"))


@query("SELECT event_id, CASE event_id % 4 WHEN 0 THEN true WHEN 1 THEN false WHEN 2 THEN true ELSE false END AS same FROM events")
def j25_same_print(spark, d):
    k, t = F.col("event_id") % 4, F.format_string("%.2f", F.col("value"))
    other = F.when(k == 0, t).when(k == 1, F.concat(F.lit("<"), t)).when(k == 2, F.format_string("%.3f", F.round("value", 2) + 0.004)).otherwise(F.format_string("%.2f", F.col("value") + 1))
    return table(spark, d, "events").select("event_id", tx.same_print(t, other).alias("same"))


BOXES = "SELECT event_id, (event_id % 10) / 10.0 AS ax, (event_id % 7) / 10.0 AS ay, (user_id % 10) / 10.0 AS bx, (user_id % 7) / 10.0 AS b_y FROM events"


@query(f"SELECT event_id, round(CASE WHEN abs(ax - bx) < 0.25 AND abs(ay - b_y) < 0.15 THEN (0.25 - abs(ax - bx)) * (0.15 - abs(ay - b_y)) / (0.25 * 0.15) ELSE 0 END, 6) AS overlap, round(greatest(0, 0.15 - abs(ay - b_y)) / 0.15, 6) AS band, round(greatest(0, ax - 0.02), 6) AS left_edge, round(least(1, ax + 0.27), 6) AS right_edge FROM ({BOXES})")
def j31_boxes(spark, d):
    """Overlap of boxes and of their bands, and a padded box clamped to the page."""
    e, u = F.col("event_id"), F.col("user_id")
    a = [e % 10 / F.lit(10.0), e % 7 / F.lit(10.0)]
    b = [u % 10 / F.lit(10.0), u % 7 / F.lit(10.0)]
    a, b = [*a, a[0] + 0.25, a[1] + 0.15], [*b, b[0] + 0.25, b[1] + 0.15]
    pad = tx.padded_box(a, 0.02)
    return table(spark, d, "events").select("event_id", F.round(tx.box_overlap(a, b), 6).alias("overlap"), F.round(tx.band_overlap(a, b), 6).alias("band"), F.round(pad[0], 6).alias("left_edge"), F.round(pad[2], 6).alias("right_edge"))


@query("SELECT event_id, CASE WHEN event_id % 2 = 0 THEN 'c' ELSE 'a' END AS kept, CASE WHEN event_id % 2 = 0 THEN value ELSE 1.0 END AS a_or_c FROM events")
def j32_map_merge(spark, d):
    """Two maps of values joined, the right one wins; then only the cited id stays."""
    e, v = F.col("event_id"), F.col("value")
    left, right = F.create_map(F.lit("a"), F.lit(0.0), F.lit("b"), v), F.create_map(F.lit("a"), F.lit(1.0), F.lit("c"), v)
    merged = F.map_concat(F.map_filter(left, lambda k, _: ~F.map_contains_key(right, k)), right)
    cited = F.when(e % 2 == 0, "c").otherwise("a")
    kept = F.map_filter(merged, lambda k, _: k == cited)
    return table(spark, d, "events").select("event_id", F.get(F.map_keys(kept), F.lit(0)).alias("kept"), F.get(F.map_values(kept), F.lit(0)).alias("a_or_c"))


@query("""SELECT event_id, '{"a":' || CASE WHEN event_id % 2 = 0 THEN 'null' ELSE CAST(user_id AS VARCHAR) || '.0' END || ',"b":' || CAST(user_id AS VARCHAR) || '}' AS j FROM events""")
def j36_safe_json(spark, d):
    """JSON in which NaN is null."""
    a = F.when(F.col("event_id") % 2 == 0, float("nan")).otherwise(F.col("user_id").cast("double"))
    return table(spark, d, "events").select("event_id", tx.json_of(F.struct(tx.finite(a).alias("a"), F.col("user_id").alias("b"))).alias("j"))


@query("SELECT conv_id, string_agg(CASE WHEN turn % 2 = 0 THEN role END, '; ' ORDER BY turn, role) AS work FROM conversations GROUP BY conv_id")
def j13_joined_fields(spark, d):
    """Fields of a record that are split over rows, joined in order; unknown ones leave no gap."""
    part = F.struct("turn", "role", F.when(F.col("turn") % 2 == 0, F.col("role")).alias("v"))
    c = table(spark, d, "conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(part)).alias("a"))
    return c.select("conv_id", F.array_join(F.transform("a", lambda s: s["v"]), "; ").alias("work"))
