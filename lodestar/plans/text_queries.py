"""Text functions, retrieval, gates and privacy."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as tx
from lodestar.operators import gates, leakaudit, retrieval
from lodestar.plans.registry import query
from lodestar.session import table

STOP = ", ".join(f"'{w}'" for w in tx.STOP_WORDS)
TOK = f"list_filter(regexp_extract_all(lower(coalesce({{}}, '')), '[a-z0-9à-ÿ]+'), lambda w: length(w) > 1 AND w NOT IN ({STOP}))"
NUM = r"[-+]?\d+(?:,\d{3})*(?:\.\d+)?"


@query(r"SELECT page_id, trim(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '-') AS slug, regexp_replace(url, '\D', '', 'g') AS digits, regexp_replace(lower(url), '[^a-z0-9]', '', 'g') AS squashed FROM pages")
def j8_slug_digits(spark, d):
    u = F.col("url")
    return table(spark, d, "pages").select("page_id", tx.slug(u).alias("slug"), tx.digits_of(u).alias("digits"), tx.squash(u).alias("squashed"))


@query(r"""SELECT p_partkey, CASE WHEN regexp_replace(p_brand, '\D', '', 'g') = '' THEN 'na' WHEN contains(regexp_replace(r, '\D', '', 'g'), regexp_replace(p_brand, '\D', '', 'g')) THEN 'exact'
WHEN contains(regexp_replace(translate(r, 'OolISBZ', '0011582'), '\D', '', 'g'), regexp_replace(p_brand, '\D', '', 'g')) THEN 'confusable' ELSE 'mismatch' END AS agreement
FROM (SELECT *, CASE p_partkey % 3 WHEN 0 THEN p_brand WHEN 1 THEN translate(p_brand, '15', 'lS') ELSE replace(p_brand, '1', '9') END AS r FROM part)""")
def j2_digit_agreement(spark, d):
    b, k = F.col("p_brand"), F.col("p_partkey") % 3
    read = F.when(k == 0, b).when(k == 1, F.translate(b, "15", "lS")).otherwise(F.regexp_replace(b, "1", "9"))
    return table(spark, d, "part").select("p_partkey", tx.digit_agreement(b, read).alias("agreement"))


@query(f"SELECT doc_id, CAST(len({TOK.format('text')}) AS INTEGER) AS n, list_sort(list_distinct({TOK.format('text')}))[1] AS first FROM documents")
def j10_tokens(spark, d):
    t = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(t).alias("n"), F.get(F.array_sort(F.array_distinct(t)), F.lit(0)).alias("first"))


@query(r"SELECT c_custkey, list_aggregate(list_transform(regexp_extract_all(upper(c_name), '[A-Z]+|[0-9]+'), lambda g: regexp_replace(g, '^0+([0-9])', '\1')), 'string_agg', '') AS key FROM customer")
def j5_name_key(spark, d):
    return table(spark, d, "customer").select("c_custkey", tx.name_key(F.col("c_name")).alias("key"))


@query(rf"""SELECT event_id, TRY_CAST(replace(regexp_extract(t, '([<>]?)\s*({NUM})', 2), ',', '') AS DOUBLE) AS value, nullif(regexp_extract(t, '([<>]?)\s*({NUM})', 1), '') AS qualifier,
CAST(length(regexp_extract(t, '\.(\d+)', 1)) AS INTEGER) AS decimals FROM (SELECT event_id, CASE event_id % 3 WHEN 0 THEN '<' || CAST(user_id AS VARCHAR) || '.50' WHEN 1 THEN 'n/a' ELSE '1,' || printf('%03d', user_id % 1000) || '.5 m' END AS t FROM events)""")
def j22_parse_number(spark, d):
    k, u = F.col("event_id") % 3, F.col("user_id")
    t = F.when(k == 0, F.concat(F.lit("<"), u.cast("string"), F.lit(".50"))).when(k == 1, "n/a").otherwise(F.concat(F.lit("1,"), F.format_string("%03d", u % 1000), F.lit(".5 m")))
    return table(spark, d, "events").withColumn("t", t).select("event_id", tx.parse_number(F.col("t")).alias("p"), "t").select("event_id", "p.value", "p.qualifier", tx.decimals(F.col("t")).alias("decimals"))


@query(r"SELECT o_orderkey, list_filter(list_transform(regexp_extract_all('no ' || CAST(o_custkey + 1000 AS VARCHAR) || ' of ' || CAST(year(o_orderdate) AS VARCHAR), '\b(\d{4})\b', 1), lambda y: CAST(y AS INTEGER)), lambda y: y BETWEEN 1900 AND 2026)[1] AS year FROM orders")
def j16_year_in_text(spark, d):
    t = F.concat(F.lit("no "), (F.col("o_custkey") + 1000).cast("string"), F.lit(" of "), F.year("o_orderdate").cast("string"))
    return table(spark, d, "orders").select("o_orderkey", tx.plausible_year(t).alias("year"))


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, l_quantity, round(l_quantity * 0.3048, 6) AS metres, round(l_extendedprice / 10000, 8) AS percent, CASE WHEN l_quantity = floor(l_quantity) THEN 'int' ELSE 'm1' END AS fmt FROM lineitem")
def j21_unit_conversion(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_quantity", F.round(q * 0.3048, 6).alias("metres"), F.round(F.col("l_extendedprice") / 10000, 8).alias("percent"), F.when(q == F.floor(q), "int").otherwise("m1").alias("fmt"))


@query("SELECT event_id, sha256('{\"event_type\":\"' || event_type || '\",\"user_id\":' || CAST(user_id AS VARCHAR) || '}') AS digest FROM events")
def j34_canonical_hash(spark, d):
    """Content address: SHA-256 of JSON with sorted keys and no white space."""
    return table(spark, d, "events").select("event_id", F.sha2(F.to_json(F.struct("event_type", "user_id")), 256).alias("digest"))


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS k, count(*) AS n, count(DISTINCT user_id) AS users FROM events GROUP BY 1")
def j33_json_field(spark, d):
    e = table(spark, d, "events").select(F.get_json_object("props", "$.k").cast("long").alias("k"), "user_id")
    return e.groupBy("k").agg(F.count("*").alias("n"), F.count_distinct("user_id").alias("users"))


BM = f"""WITH q AS (SELECT item_id AS query_id, unnest({TOK.format('text')}) AS term FROM benchmark), qf AS (SELECT query_id, term, count(*) AS qf FROM q GROUP BY ALL),
d AS (SELECT doc_id AS id, {TOK.format('text')} AS t FROM documents), s AS (SELECT count(*) AS n, avg(len(t)) AS al FROM d),
p AS (SELECT id, len, term, count(*) AS tf FROM (SELECT id, len(t) AS len, unnest(t) AS term FROM d) WHERE term IN (SELECT term FROM qf) GROUP BY ALL),
f AS (SELECT term, count(*) AS df FROM p GROUP BY term),
r AS (SELECT query_id, id, sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * len / al)) * least(qf, 3)) AS score FROM p JOIN f USING (term) JOIN qf USING (term), s GROUP BY ALL)
SELECT query_id, id, round(score, 6) AS score, CAST(k AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, id) AS k FROM r) WHERE k <= 5"""


@query(BM)
def m2_bm25(spark, d):
    docs, items = table(spark, d, "documents"), table(spark, d, "benchmark")
    q = items.select(F.col("item_id").alias("query_id"), F.explode(tx.tokens(F.col("text"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qf"))
    out = retrieval.bm25(docs, "doc_id", tx.tokens(F.col("text")), q)
    return out.select("query_id", "id", F.round("score", 6).alias("score"), "rank")


@query(f"WITH d AS (SELECT doc_id, unnest({TOK.format('text')}) AS term FROM documents) SELECT term, count(DISTINCT doc_id) AS df, count(*) AS cf FROM d GROUP BY term")
def m1_document_frequency(spark, d):
    p = retrieval.postings(table(spark, d, "documents"), "doc_id", tx.tokens(F.col("text")))
    return p.groupBy("term").agg(F.count("*").alias("df"), F.sum("tf").alias("cf"))


@query(r"SELECT conv_id, turn, role, regexp_replace(text, '(?i)\b(?:assistant|system|user|the)\b', '[name]', 'g') AS scrubbed FROM conversations")
def m10_scrub(spark, d):
    return table(spark, d, "conversations").select("conv_id", "turn", "role", gates.scrub(F.col("text"), ["user", "assistant", "system", "the"]).alias("scrubbed"))


@query("WITH n AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z0-9à-ÿ]+')) AS name FROM benchmark), w AS (SELECT DISTINCT doc_id, unnest(regexp_extract_all(lower(text), '[a-z0-9à-ÿ]+')) AS name FROM documents) SELECT doc_id, count(*) AS names FROM w JOIN n USING (name) GROUP BY doc_id")
def m13_leak_scan(spark, d):
    words = table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9à-ÿ]+"), F.lit(0))).alias("name"))
    return gates.leaks(table(spark, d, "documents"), "doc_id", "text", words).groupBy("doc_id").agg(F.count("*").alias("names"))


CLAIM = """WITH v AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS value_id, round(sum(value), 2) AS value FROM events GROUP BY user_id),
c AS (SELECT user_id AS claim_id, 'spent ' || CASE WHEN user_id % 3 = 0 THEN '99999.5' ELSE printf('%.2f', value) END || ' in 7 visits' AS text, CASE WHEN user_id % 5 = 0 THEN 'gone' ELSE value_id END AS cited FROM (SELECT DISTINCT user_id FROM events) JOIN v ON value_id = 'u' || CAST(user_id AS VARCHAR))"""


def claims(spark, d):
    v = table(spark, d, "events").groupBy("user_id").agg(F.round(F.sum("value"), 2).alias("value"))
    u = F.col("user_id")
    values = v.select(F.concat(F.lit("u"), u.cast("string")).alias("value_id"), "value")
    text = F.concat(F.lit("spent "), F.when(u % 3 == 0, "99999.5").otherwise(F.format_string("%.2f", "value")), F.lit(" in 7 visits"))
    cited = F.array(F.when(u % 5 == 0, "gone").otherwise(F.concat(F.lit("u"), u.cast("string"))))
    return v.select(u.alias("claim_id"), text.alias("text"), cited.alias("cited")), values


@query(f"{CLAIM} SELECT claim_id, regexp_extract(text, 'spent ([0-9.]+)', 1) AS number FROM c WHERE claim_id % 3 = 0 OR claim_id % 5 = 0")
def n3_claim_gate(spark, d):
    return gates.unsupported_numbers(*claims(spark, d))


@query(f"{CLAIM} SELECT claim_id, cited AS value_id FROM c WHERE cited NOT IN (SELECT value_id FROM v)")
def n3_unknown_citations(spark, d):
    return gates.unknown_citations(*claims(spark, d))


@query(r"SELECT item_id, regexp_replace(text || ' 12,500 and 3.5 m', '[-+]?\d+(?:,\d{3})*(?:\.\d+)?', '[n]', 'g') AS redacted FROM (SELECT item_id, regexp_replace(text, '[0-9]', '', 'g') AS text FROM benchmark)")
def m11_redact_numbers(spark, d):
    t = table(spark, d, "benchmark").select("item_id", F.concat(F.regexp_replace("text", "[0-9]", ""), F.lit(" 12,500 and 3.5 m")).alias("t"))
    return t.select("item_id", tx.redact_numbers(F.col("t")).alias("redacted"))


@query(r"""WITH n AS (SELECT count(*) AS n FROM benchmark), w AS (SELECT item_id, lower(unnest(regexp_extract_all(coalesce(text, ''), '[a-zA-ZÀ-ÿ0-9_]+'))) AS term FROM benchmark), t AS (SELECT item_id, term, count(*) AS tf FROM w WHERE regexp_full_match(term, '[a-z]{2,}') GROUP BY item_id, term),
v AS (SELECT term, count(*) AS df FROM t GROUP BY term HAVING count(*) >= 2 AND count(*) <= 0.9 * (SELECT n FROM n)), x AS (SELECT item_id, term, (1 + ln(tf)) * (ln((1 + n) / (1.0 + df)) + 1) AS w FROM t JOIN v USING (term), n)
SELECT item_id, term, round(w / sqrt(sum(w * w) OVER (PARTITION BY item_id)), 6) AS weight FROM x""")
def i28_term_weights(spark, d):
    weights, _ = leakaudit.term_weights(table(spark, d, "benchmark"), "item_id", "text")
    return weights.select(F.col("id").alias("item_id"), "term", F.round("weight", 6).alias("weight"))


@query()
def i28_leak_audit(spark, d):
    """Do the words of the user's and the system's turns tell which conversations are short? The fit is beyond SQL."""
    c = table(spark, d, "conversations")
    texts = c.where("role <> 'assistant'").groupBy("conv_id").agg(F.concat_ws(" ", F.transform(F.array_sort(F.collect_list(F.struct("turn", "text"))), lambda r: r.text)).alias("text"))
    labels = c.groupBy("conv_id").agg((F.count("*") <= 5).cast("int").alias("label"))
    rows = texts.join(labels, "conv_id").withColumn("fold", F.crc32(F.col("conv_id").cast("string").cast("binary")) % 5)
    return leakaudit.audit(rows, "conv_id", "text", "label", "fold")[0]
