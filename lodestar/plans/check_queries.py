"""Rule checks, audits and logs."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators import checks, governance
from lodestar.plans.registry import query
from lodestar.session import scratch, table
from lodestar.streaming import logs

L = """WITH x AS (SELECT CAST(l_orderkey AS VARCHAR) || '-' || CAST(l_linenumber AS VARCHAR) || '-' || CAST(l_partkey AS VARCHAR) || '-' || CAST(l_suppkey AS VARCHAR) AS row_id, l_quantity AS quantity, l_extendedprice AS price, l_discount AS discount, l_tax AS tax,
 l_shipdate AS shipped, o_orderdate AS ordered, p_retailprice AS list_price FROM lineitem LEFT JOIN orders ON o_orderkey = l_orderkey LEFT JOIN part ON p_partkey = l_partkey),
r AS (SELECT 'positive_quantity' AS rule, row_id AS scope_id, CASE WHEN quantity > 0 THEN 'pass' ELSE 'fail' END AS outcome FROM x
UNION ALL SELECT 'unit_price_range', row_id, CASE WHEN list_price IS NULL THEN 'note' WHEN abs(price / quantity - list_price) / list_price <= 0.25 THEN 'pass' WHEN abs(price / quantity - list_price) / list_price <= 0.75 THEN 'warn' ELSE 'fail' END FROM x
UNION ALL SELECT 'share_range', row_id, CASE WHEN discount BETWEEN 0 AND 1 AND tax BETWEEN 0 AND 1 THEN 'pass' ELSE 'fail' END FROM x
UNION ALL SELECT 'shipped_after_order', row_id, CASE WHEN shipped >= ordered THEN 'pass' ELSE 'warn' END FROM x WHERE ordered IS NOT NULL)"""
NAMES = ["positive_quantity", "unit_price_range", "share_range", "shipped_after_order"]


def records(spark, d):
    l, o, p = (table(spark, d, t) for t in ("lineitem", "orders", "part"))
    row = F.concat_ws("-", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey")
    return l.join(o, l.l_orderkey == o.o_orderkey, "left").join(p, l.l_partkey == p.p_partkey, "left").select(
        row.alias("row_id"), F.col("l_quantity").alias("quantity"), F.col("l_extendedprice").alias("price"), F.col("l_discount").alias("discount"), F.col("l_tax").alias("tax"),
        F.col("l_shipdate").alias("shipped"), F.col("o_orderdate").alias("ordered"), F.col("p_retailprice").alias("list_price"),
    )


@query(f"{L} SELECT rule, outcome, count(*) AS n FROM r GROUP BY rule, outcome")
def l_rule_outcomes(spark, d):
    return checks.run(records(spark, d), NAMES).groupBy("rule", "outcome").agg(F.count("*").alias("n"))


@query(f"{L}, s AS (SELECT *, CASE outcome WHEN 'pass' THEN 0 WHEN 'note' THEN 1 WHEN 'warn' THEN 2 ELSE 3 END AS v FROM r) SELECT scope_id, arg_max(outcome, v) AS outcome, coalesce(string_agg(DISTINCT rule, ',' ORDER BY rule) FILTER (WHERE v > 0), '') AS rules FROM s GROUP BY scope_id")
def l_worst_outcome(spark, d):
    """The worst outcome travels up to the record."""
    return checks.worst_of(records(spark, d), NAMES).select("scope_id", "outcome", F.array_join("rules", ",").alias("rules"))


@query("SELECT sha256(text) AS digest, count(*) AS copies, count(DISTINCT lang) AS langs, min(doc_id) AS first_id FROM documents GROUP BY sha256(text) HAVING count(*) > 1")
def v14_duplicates(spark, d):
    g = table(spark, d, "documents").groupBy(F.sha2(F.col("text").cast("binary"), 256).alias("digest"))
    return g.agg(F.count("*").alias("copies"), F.count_distinct("lang").alias("langs"), F.min("doc_id").alias("first_id")).where("copies > 1")


@query("""SELECT 'labels.doc_id' AS reference, CAST(doc_id AS VARCHAR) AS key FROM labels WHERE doc_id NOT IN (SELECT doc_id FROM documents) UNION ALL SELECT 'lineitem.l_orderkey', CAST(k AS VARCHAR) FROM (SELECT DISTINCT l_orderkey AS k FROM lineitem) WHERE k NOT IN (SELECT o_orderkey FROM orders)
UNION ALL SELECT 'orders.o_custkey', CAST(k AS VARCHAR) FROM (SELECT DISTINCT o_custkey AS k FROM orders) WHERE k NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0)""")
def o2_lineage_audit(spark, d):
    t = lambda n: table(spark, d, n)
    out = governance.orphans(t("labels"), "doc_id", t("documents"), "doc_id", "labels.doc_id")
    out = out.unionByName(governance.orphans(t("lineitem"), "l_orderkey", t("orders"), "o_orderkey", "lineitem.l_orderkey"))
    return out.unionByName(governance.orphans(t("orders"), "o_custkey", t("customer").where("c_acctbal > 0"), "c_custkey", "orders.o_custkey"))


@query("SELECT 'documents' AS table_name, CASE WHEN tier IS NULL THEN 'no tier' ELSE 'tier ' || tier END AS problem, count(*) AS n FROM (SELECT CASE WHEN lang = 'en' THEN 'native' WHEN lang = 'de' THEN NULL ELSE 'read' END AS tier FROM documents) WHERE tier IS NULL OR tier <> 'native' GROUP BY ALL")
def o1_tier_audit(spark, d):
    tier = F.when(F.col("lang") == "en", "native").when(F.col("lang") == "de", None).otherwise("read")
    return governance.tier_violations(table(spark, d, "documents").withColumn("tier", tier), "documents", "native")


@query("SELECT c_custkey, CASE WHEN c_custkey % 3 = 0 THEN 'new' ELSE c_mktsegment END AS c_mktsegment FROM customer")
def a15_upsert(spark, d):
    old = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    new = old.where("c_custkey % 3 = 0").withColumn("c_mktsegment", F.lit("new"))
    return governance.replace_keys(old, new, ["c_custkey"])


@query("SELECT c_custkey AS k, 'customer' AS origin FROM customer UNION ALL SELECT DISTINCT o_orderkey, 'order' FROM orders WHERE o_orderkey NOT IN (SELECT c_custkey FROM customer)")
def a17_insert_absent(spark, d):
    old = table(spark, d, "customer").select(F.col("c_custkey").alias("k"), F.lit("customer").alias("origin"))
    new = table(spark, d, "orders").select(F.col("o_orderkey").alias("k"), F.lit("order").alias("origin")).distinct()
    return governance.insert_absent(old, new, ["k"])


@query("SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON r_regionkey = n_regionkey")
def a18_pack_round_trip(spark, d):
    """Pack two tables, verify the digests and join what comes back."""
    folder = scratch(spark, "pack")
    governance.pack({t: table(spark, d, t) for t in ("nation", "region")}, {"nation": ["n_nationkey"], "region": ["r_regionkey"]}, folder)
    back = governance.unpack(spark, folder)
    return back["nation"].join(back["region"], F.col("r_regionkey") == F.col("n_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("SELECT user_id, arg_max(event_type, [CAST(epoch_us(ts) AS DOUBLE), event_id]) AS event_type, arg_max(value, [CAST(epoch_us(ts) AS DOUBLE), event_id]) AS value FROM events GROUP BY user_id")
def a11_last_line_wins(spark, d):
    e = table(spark, d, "events").select("user_id", "ts", "event_id", "event_type", "value")
    return logs.last_wins(e, "user_id", ["ts", "event_id"]).select("user_id", "event_type", "value")


@query("SELECT event_type, round(sum(value), 4) AS total, count(*) AS n FROM events GROUP BY event_type")
def e20_spend(spark, d):
    return logs.spend(table(spark, d, "events"), "event_type", "value").withColumn("total", F.round("total", 4))


@query("SELECT user_id, count(*) AS calls, count(*) FILTER (WHERE event_type = 'error') AS failed, round(sum(value) / nullif(count(*) FILTER (WHERE event_type <> 'error'), 0), 6) AS cost_per_ok, (epoch_us(max(ts)) - epoch_us(min(ts))) // 1000000 AS wall_s FROM events GROUP BY user_id")
def e19_run_usage(spark, d):
    e, bad = table(spark, d, "events"), F.col("event_type") == "error"
    micros = lambda c: F.unix_micros(c.cast("timestamp"))
    wall = F.floor((micros(F.max("ts")) - micros(F.min("ts"))) / 1_000_000)
    return e.groupBy("user_id").agg(F.count("*").alias("calls"), F.count_if(bad).alias("failed"), F.round(F.sum("value") / F.nullif(F.count_if(~bad), F.lit(0)), 6).alias("cost_per_ok"), wall.alias("wall_s"))


@query("SELECT CAST(epoch_us(time_bucket(INTERVAL 1 DAY, ts)) // 1000000 AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL")
def p9_tumbling_windows(spark, d):
    out = logs.windowed_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "event_type", "1 day")
    return out.select(F.unix_seconds("start").alias("start"), "event_type", "n", F.round("total", 4).alias("total"))


@query("""WITH s AS (SELECT user_id, ts, CASE WHEN epoch_us(ts) - lag(epoch_us(ts)) OVER w < 7200000000 THEN 0 ELSE 1 END AS o FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
k AS (SELECT user_id, ts, sum(o) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS g FROM s) SELECT user_id, epoch_us(min(ts)) AS start, epoch_us(max(ts)) + 7200000000 AS end_, count(*) AS n FROM k GROUP BY user_id, g""")
def p9_session_windows(spark, d):
    out = logs.session_counts(table(spark, d, "events").withColumn("ts", F.col("ts").cast("timestamp")), "ts", "user_id", "2 hours")
    return out.select("user_id", F.unix_micros("start").alias("start"), F.unix_micros("end").alias("end_"), "n")


@query("SELECT event_id, user_id, event_type FROM events")
def p1_stream_log(spark, d):
    """Events written as JSON lines and read back by a stream that stops when it has seen all files."""
    folder = scratch(spark, "stream")
    e = table(spark, d, "events").select("event_id", "user_id", "event_type")
    e.repartition(4).write.json(f"{folder}/in")
    stream = logs.read_log(spark, f"{folder}/in", "event_id long, user_id long, event_type string", stream=True)
    logs.run_once(stream.where("_corrupt is null").drop("_corrupt"), f"{folder}/out", f"{folder}/state")
    return spark.read.schema(e.schema).parquet(f"{folder}/out")


@query("SELECT user_id, count(*) AS n, max(event_id) AS last_id FROM events GROUP BY user_id")
def p2_stream_state(spark, d):
    """A state log replayed as a stream: each batch is folded into the state table by foreachBatch, the last one wins."""
    folder = scratch(spark, "state")
    e = table(spark, d, "events").select("event_id", "user_id")
    e.repartition(3).write.json(f"{folder}/in")
    stream = logs.read_log(spark, f"{folder}/in", "event_id long, user_id long", stream=True, files=1)

    def part(batch: DataFrame) -> DataFrame:
        return batch.groupBy("user_id").agg(F.count("*").alias("n"), F.max("event_id").alias("last_id"))

    def merge(both: DataFrame) -> DataFrame:
        return both.groupBy("user_id").agg(F.sum("n").alias("n"), F.max("last_id").alias("last_id"))

    return spark.read.parquet(logs.fold_state(stream, f"{folder}/state", part, merge))
