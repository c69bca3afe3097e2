"""The gate over chains made of conversations: a turn is a claim about the length of a turn, every twelfth kind with its own fault."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import nodegate
from lodestar.plans.registry import query
from lodestar.session import cut, table


def _parts(spark: SparkSession, d: str) -> tuple[DataFrame, ...]:
    c = table(spark, d, "conversations").select(F.col("conv_id").alias("c"), F.col("turn").alias("t"), F.length("text").alias("n"))
    run, cell = F.concat(F.lit("r"), F.col("c").cast("string")), F.col("c").cast("string")
    values = c.select(F.concat(F.lit("c:cell:"), cell, F.lit(":f"), F.col("t").cast("string")).alias("value_id"), F.when(F.col("t") != 6, F.col("n").cast("double")).alias("value"))
    flags = c.where("t = 0 AND c % 4 = 0").select(F.concat(F.lit("c:nb:"), cell, F.lit(":layer:500:in_footprint")).alias("value_id"), F.lit(0.0).alias("value"))
    k = (F.col("c") * 7 + F.col("t") * 5) % 12
    mine = F.concat(F.lit("c:cell:"), cell, F.lit(":f"), F.col("t").cast("string"))
    other = F.concat(F.lit("c:cell:"), (F.col("c") + 3).cast("string"), F.lit(":f"), F.col("t").cast("string"))
    true = F.when(F.col("n") >= 300, "met").otherwise("not_met")
    false = F.when(F.col("n") >= 300, "not_met").otherwise("met")
    status = F.when(k.isin(3, 4), false).when(k.isin(5, 6), "unknown").when(k == 8, "not_met").otherwise(true)
    text = F.when(k == 1, "a length of 98765.5 letters").when(k == 4, "however it stands").when(k == 7, "the average of 5 turns").otherwise(F.concat(F.lit("a length of "), F.format_string("%.1f", F.col("n").cast("double")), F.lit(" letters")))
    ids = F.when(k == 0, F.array(mine, F.lit("c:cell:none:zz"))).when(k == 2, F.array(mine, other)).when(k == 9, F.array().cast("array<string>")).when(k == 5, F.array().cast("array<string>")).otherwise(F.array(mine))
    text = F.when(k.isin(5, 9), "nothing is said").otherwise(text)
    on = F.when(F.col("t") % 3 == 2, F.array((F.col("t") - 1).cast("string"), (F.col("t") - 2).cast("string"))).when(F.col("t") % 5 == 4, F.array((F.col("t") + 1).cast("string"))).otherwise(F.array().cast("array<string>"))
    nodes = c.select(
        run.alias("run_id"), F.col("t").cast("string").alias("node_id"), cell.alias("cell"), F.lit("criterion").alias("kind"), F.concat(F.lit("k"), F.col("t").cast("string")).alias("criterion"), status.alias("status"),
        F.when(k == 5, 2).when(status == "unknown", 0).otherwise(3).alias("strength"), text.alias("text"), ids.alias("value_ids"), on.alias("depends_on"),
    )
    turns = c.select(F.col("t").cast("string").alias("t")).distinct()
    criteria = turns.select(F.concat(F.lit("k"), "t").alias("criterion"), F.concat(F.lit("f"), "t").alias("feature"), F.lit("rising").alias("direction"), F.lit(300.0).alias("bar"))
    near = c.where("c % 2 = 0").select(cell.alias("cell"), (F.col("c") + 3).cast("string").alias("other")).distinct()
    unknown = c.where("c % 5 = 0").select(cell.alias("cell"), F.concat(F.lit("f"), F.col("t").cast("string")).alias("feature"))
    layers = criteria.select("criterion", F.lit("layer").alias("layer"))
    return nodes, values.unionByName(flags), criteria, near, unknown, layers


# Each fault told again from its own rule on the numbers, without ids or texts.
_GATE = """WITH RECURSIVE c AS (SELECT conv_id AS c, turn AS t, CAST(length(text) AS BIGINT) AS n, (conv_id * 7 + turn * 5) % 12 AS k FROM conversations), x AS (SELECT *, c.t = 6 AS blank, (SELECT o.n FROM c o WHERE o.c = c.c + 3 AND o.t = c.t) AS other, EXISTS (SELECT 1 FROM c o WHERE o.c = c.c + 3 AND o.t = c.t) AS kin, c % 4 = 0 AND EXISTS (SELECT 1 FROM c z WHERE z.c = c.c AND z.t = 0) AS bare,
  EXISTS (SELECT 1 FROM c z WHERE z.c = c.c + 3 AND z.t = 0) AND c % 2 = 0 AND (c + 3) % 4 = 0 AS bare_kin FROM c),
y AS (SELECT *, CASE WHEN k IN (3, 4) THEN n < 300 WHEN k = 8 THEN false ELSE n >= 300 END AS says FROM x),
f AS (SELECT c, t, 'ids' AS rule FROM y WHERE k = 0 OR (k = 2 AND NOT kin) OR k = 1 OR (blank AND k NOT IN (1, 4, 5, 7, 9)) UNION ALL SELECT c, t, 'identity' FROM y WHERE (k = 2 AND c % 2 <> 0) OR k = 0
UNION ALL SELECT c, t, 'polarity' FROM y WHERE k NOT IN (5, 6) AND (k = 9 OR (NOT blank AND k <> 4 AND says <> (CASE WHEN k = 2 AND kin THEN other ELSE n END >= 300))) UNION ALL SELECT c, t, 'unknown' FROM y WHERE k = 5 OR (k = 6 AND NOT blank AND c % 5 <> 0 AND NOT bare AND NOT bare_kin)
UNION ALL SELECT c, t, 'arithmetic' FROM y WHERE k = 7 UNION ALL SELECT c, t, 'footprint' FROM y WHERE k NOT IN (5, 6) AND NOT says AND (bare OR bare_kin))"""


@query(f"{_GATE} SELECT DISTINCT 'r' || c AS run_id, CAST(t AS VARCHAR) AS node_id, rule FROM f")
def n4_node_gate(spark: SparkSession, d: str) -> DataFrame:
    nodes, *rest = _parts(spark, d)
    return nodegate.problems(nodes, *rest).select("run_id", "node_id", "rule").distinct()


# A claim passes if no claim that it can reach, itself included, is refused, missing or waits for itself.
@query(f"""{_GATE}, e AS (SELECT c, t, t - 1 AS o FROM c WHERE t % 3 = 2 UNION ALL SELECT c, t, t - 2 FROM c WHERE t % 3 = 2 UNION ALL SELECT c, t, t + 1 FROM c WHERE t % 3 <> 2 AND t % 5 = 4),
reach AS (SELECT c, t, o FROM e UNION SELECT r.c, r.t, e.o FROM reach r JOIN e ON e.c = r.c AND e.t = r.o),
held AS (SELECT DISTINCT r.c, r.t FROM reach r WHERE r.o = r.t OR NOT EXISTS (SELECT 1 FROM c WHERE c.c = r.c AND c.t = r.o) OR EXISTS (SELECT 1 FROM f WHERE f.c = r.c AND f.t = r.o) OR EXISTS (SELECT 1 FROM reach q WHERE q.c = r.c AND q.t = r.o AND q.o = r.o))
SELECT 'r' || c.c AS run_id, CAST(c.t AS VARCHAR) AS node_id, CASE WHEN EXISTS (SELECT 1 FROM f WHERE f.c = c.c AND f.t = c.t) THEN 'refused' WHEN EXISTS (SELECT 1 FROM held h WHERE h.c = c.c AND h.t = c.t) THEN 'held' ELSE 'passed' END AS state FROM c""")
def n4_settled_chains(spark: SparkSession, d: str) -> DataFrame:
    nodes, *rest = _parts(spark, d)
    return nodegate.settle(nodes, nodegate.problems(nodes, *rest)).select("run_id", "node_id", "state")


@query("""WITH v AS (SELECT conv_id, turn, length(text) * 1.37 + 11.0 AS v FROM conversations), r AS (SELECT *, CAST(round(v * 100) AS BIGINT) AS cents FROM v)
SELECT 'stated_plainly' AS kind, true AS honest, count(*) AS put, CAST(0 AS BIGINT) AS refused, count(*) AS passed FROM v UNION ALL SELECT 'uncited', false, count(*), count(*), 0 FROM v
UNION ALL SELECT 'hand_conversion', false, count(*), count(*), 0 FROM v WHERE turn % 2 = 0""")
def n5_gate_suite(spark: SparkSession, d: str) -> DataFrame:
    """Kinds whose outcome follows from the numbers alone; the others' counts hang on the draws and are held by tests."""
    v = table(spark, d, "conversations").select(F.concat_ws(":", F.lit("c:cell"), F.col("conv_id"), F.col("turn")).alias("value_id"), F.round(F.length("text") * 1.37 + 11.0, 2).alias("value"), F.when(F.col("turn") % 2 == 0, "m").otherwise("ppm").alias("unit"))
    cases = cut(nodegate.suite(v), "gate-cases")
    return nodegate.judged(cases, v).where("kind IN ('stated_plainly', 'uncited', 'hand_conversion')")


@query()
def n5_confusion_by_kind(spark: SparkSession, d: str) -> DataFrame:
    """All kinds; draws are hashes, which SQL does not share."""
    v = table(spark, d, "conversations").select(F.concat_ws(":", F.lit("c:cell"), F.col("conv_id"), F.col("turn")).alias("value_id"), F.round(F.length("text") * 1.37 + 11.0, 2).alias("value"), F.when(F.col("turn") % 2 == 0, "m").otherwise("ppm").alias("unit"))
    return nodegate.judged(cut(nodegate.suite(v), "gate-cases"), v)
