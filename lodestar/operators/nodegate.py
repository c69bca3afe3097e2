"""The gate of a chain of claims, and the suite that tests a gate.

Nodes are (run_id, node_id, cell, kind, criterion, status, strength, text, value_ids, depends_on): a claim that a criterion is met, not met or unknown
in a cell, with the ids of the values it rests on. Values are (value_id, value), ids `c:<kind>:<cell>:<rest>`. Six rules find problems,
each by joins on ids; then the chain is settled in rounds from the claims that rest on nothing.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.functions.text import renderings
from lodestar.session import cut

# How numbers stand in a text, those that need no source, words that grant a contrary value, and the forms of arithmetic.
_DIGITS = r"(?<![\w.:-])(?<!\d,)(\d(?:[\d,]*\d)?(?:\.\d+)?)"
NUMBERS = (_DIGITS + r"(?![\w:-]|\.\d)", _DIGITS + r"(?=(?:km|mm|cm|m|ft|in|ppm|ppb|cps|%|deg|kg|g|wt)\b)", _DIGITS + r"(?=:(?:\s|$))")
BARE = ("0", "1", "2", "3", "4", "5", "6", "7", "8", "9", "10", "100")
HEDGES = r"(?i)\b(however|but|despite)\b"
ARITHMETIC = {
    "equals": r"\d\s*=\s*\d", "operator": r"\d\s*[+×÷]\s*\d", "approximation": r"≈",
    "word": r"(?i)\b(sum|average|total of|per ?cent of|percent of)\b[^.;]{0,24}\d|\d[^.;]{0,24}\b(sum|average|total of|per ?cent of|percent of)\b",
}
MET, CELL_LESS = 0.5, ("cov",)
KEY = ["run_id", "node_id"]


def stated_numbers(c: Column) -> Column:
    """Distinct numbers of a text: standing alone, glued to a unit, or ending a label."""
    return F.array_distinct(F.flatten(F.array(*(F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(p), F.lit(1)) for p in NUMBERS))))


def unbacked(claims: DataFrame, values: DataFrame, keys: list[str], context: DataFrame | None = None) -> DataFrame:
    """(keys, number): numbers of a text that no cited value prints as, nor `context` (keys, text) quotes. Thousands' commas count for nothing."""
    bare = lambda c: F.replace(c, F.lit(","), F.lit(""))
    said = claims.select(*keys, F.explode(stated_numbers(F.col("text"))).alias("number")).where(~bare(F.col("number")).isin(*BARE))
    cited = claims.select(*keys, F.explode("value_ids").alias("value_id")).distinct().join(values.select("value_id", "value"), "value_id")
    allowed = cited.select(*keys, F.explode(renderings(F.col("value"))).alias("number"))
    if context is not None:
        allowed = allowed.unionByName(context.select(*keys, F.explode(stated_numbers(F.col("text"))).alias("number")))
    allowed = allowed.select(*keys, bare(F.col("number")).alias("plain")).distinct()
    return said.withColumn("plain", bare(F.col("number"))).join(allowed, [*keys, "plain"], "left_anti").select(*keys, "number")


def problems(nodes: DataFrame, values: DataFrame, criteria: DataFrame, neighbours: DataFrame, unknown: DataFrame, layers: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(run_id, node_id, rule, detail), one row for each problem.

    criteria: (criterion, feature, direction rising/falling/percentile, bar); neighbours: (cell, other) that a cell may cite besides itself;
    unknown: (cell, feature) without a value; layers: (criterion, layer) that a criterion rests on.

    1 ids: a cited id that no value has, or that is no id; a number without a cited value that prints so. 2 identity: an id of another cell.
    3 polarity: a met or not met criterion must cite its feature or its membership, and agree with it (membership first, half and above is
    favourable) unless the text says so. 4 unknown: strength 0, and no measured value of a feature that is not unknown here. 5 arithmetic.
    6 footprint: not met, though a layer's footprint flag at the cell is 0.
    """
    nodes = cut(nodes, "gate-nodes")
    told = lambda df, rule, detail: df.select(*KEY, F.lit(rule).alias("rule"), detail.alias("detail"))
    known = values.select("value_id", "value").dropDuplicates(["value_id"])
    cites = nodes.select(*KEY, "cell", "kind", "criterion", "status", "strength", "text", F.posexplode("value_ids").alias("at", "value_id"))
    cites = cites.groupBy(*(c for c in cites.columns if c != "at")).agg(F.max("at").alias("at"))
    part = F.split("value_id", ":")
    formed = (F.size(part) >= 3) & (F.get(part, F.lit(0)) == "c")
    kind = F.when(formed, F.get(part, F.lit(1)))
    place = F.when(formed & ~kind.isin(*CELL_LESS), F.get(part, F.lit(2)))
    last = F.element_at(part, -1)
    cites = cites.withColumns({"id_kind": kind, "id_cell": place, "last": last, "parts": F.size(part)})
    held = cut(cites.join(known.withColumn("there", F.lit(True)), "value_id", "left"), "gate-cites")
    out = told(held.where("there IS NULL"), "ids", F.concat(F.lit("no value "), F.col("value_id")))
    out = out.unionByName(told(held.where("id_kind IS NULL"), "ids", F.concat(F.lit("no id "), F.col("value_id"))))
    out = out.unionByName(told(unbacked(nodes, known, KEY, context), "ids", F.concat(F.lit("number "), F.col("number"))))
    strange = held.where("id_cell IS NOT NULL AND id_cell <> cell").join(neighbours.select("cell", F.col("other").alias("id_cell")).distinct(), ["cell", "id_cell"], "left_anti")
    out = out.unionByName(told(strange, "identity", F.concat(F.lit("cell "), F.col("id_cell"))))
    ruled = nodes.where("kind = 'criterion'").join(criteria, "criterion", "left")
    out = out.unionByName(told(ruled.where("feature IS NULL"), "criterion", F.concat(F.lit("no criterion "), F.coalesce("criterion", F.lit("")))))
    # Of the memberships and of the feature's values that a node cites the last counts; the membership decides before the value.
    own = held.where("there AND kind = 'criterion'").join(criteria, "criterion")
    member, feature = (F.col("id_kind") == "crit") & (F.col("last") == F.col("criterion")) & (F.col("parts") == 4), (F.col("id_kind") == "cell") & (F.col("last") == F.col("feature")) & (F.col("parts") == 4)
    own = own.where(member | feature).groupBy(*KEY).agg(F.max_by(F.col("value"), F.when(member, F.col("at"))).alias("member"), F.max_by(F.col("value"), F.when(feature, F.col("at"))).alias("measure"), F.count("*").alias("cited"))
    ruled = ruled.where("feature IS NOT NULL").join(own, KEY, "left")
    by_value = F.when(F.col("direction") == "rising", F.col("measure") >= F.col("bar")).when(F.col("direction") == "falling", F.col("measure") <= F.col("bar"))
    good = F.coalesce(F.col("member") >= MET, by_value)
    stated = ruled.where("status IN ('met', 'not_met')")
    out = out.unionByName(told(stated.where("cited IS NULL"), "polarity", F.concat(F.lit("cites neither "), F.col("feature"), F.lit(" nor its membership"))))
    against = stated.where(F.col("cited").isNotNull() & good.isNotNull() & ((F.col("status") == "met") != good) & ~F.coalesce(F.col("text"), F.lit("")).rlike(HEDGES))
    out = out.unionByName(told(against, "polarity", F.concat(F.lit("says "), F.col("status"))))
    out = out.unionByName(told(nodes.where("status = 'unknown' AND coalesce(strength, 0) <> 0"), "unknown", F.lit("strength")))
    # Footprint flags of the node's own layers at its cell or a neighbour: 0 where nothing was mapped.
    flags = known.where(F.col("value_id").endswith(":in_footprint") & (F.col("value") == 0)).withColumn("p", F.split("value_id", ":")).where("p[1] IN ('nb', 'x')")
    flags = flags.select(F.col("p")[2].alias("at"), F.explode(F.slice("p", F.lit(4), F.greatest(F.size("p") - 4, F.lit(0)))).alias("layer")).distinct()
    near = neighbours.select("cell", F.col("other").alias("at")).unionByName(nodes.select("cell", F.col("cell").alias("at"))).distinct()
    bare = cut(nodes.join(layers, "criterion").join(near, "cell").join(flags, ["at", "layer"]).select(*KEY, "status", "layer").distinct(), "gate-footprints")
    out = out.unionByName(told(bare.where("status = 'not_met'"), "footprint", F.concat(F.lit("nothing of "), F.col("layer"))))
    measured = ruled.where("status = 'unknown' AND (member IS NOT NULL OR measure IS NOT NULL)").join(unknown.select("cell", "feature").distinct(), ["cell", "feature"], "left_anti").join(bare.select(*KEY), KEY, "left_anti")
    out = out.unionByName(told(measured, "unknown", F.concat(F.lit("measured "), F.col("feature"))))
    for name, pattern in ARITHMETIC.items():
        out = out.unionByName(told(nodes.where(F.coalesce(F.col("text"), F.lit("")).rlike(pattern)), "arithmetic", F.lit(name)))
    return out.distinct()


def settle(nodes: DataFrame, found: DataFrame) -> DataFrame:
    """(run_id, node_id, state, round): refused for problems of its own; held if it rests on a claim that is refused, held or missing,
    or on itself; else passed.

    Rounds go from the claims that rest on nothing: a claim is decided once all it rests on are. Each round is written, and there are as many as
    the longest chain is deep; claims that wait for each other are left over and held (round null).
    """
    bad = found.select(*KEY).distinct().withColumn("bad", F.lit(True))
    todo = cut(nodes.select(*KEY).distinct().join(bad, KEY, "left"), "chain")
    edges = cut(nodes.select(*KEY, F.explode("depends_on").alias("on")).where("on IS NOT NULL").distinct(), "chain-edges")
    state = lambda weak: F.when(F.col("bad"), "refused").when(weak, "held").otherwise("passed")
    missing = edges.join(todo.select("run_id", F.col("node_id").alias("on")), ["run_id", "on"], "left_anti").select(*KEY).distinct().withColumn("weak", F.lit(True))
    waits = edges.select(*KEY).distinct().withColumn("waits", F.lit(True))
    start = todo.join(missing, KEY, "left").join(waits, KEY, "left")
    first = F.col("waits").isNull() | F.col("weak") | F.col("bad")
    decided = cut(start.where(first).select(*KEY, state(F.col("weak")).alias("state"), F.lit(0).alias("round")), "chain-round")
    todo, done, n = cut(start.where(~F.coalesce(first, F.lit(False))).select(*KEY, "bad"), "chain-left"), decided, 0
    edges = cut(edges.join(todo.select(*KEY), KEY, "left_semi"), "chain-edges")
    while not todo.isEmpty():
        n += 1
        on = edges.join(done.select("run_id", F.col("node_id").alias("on"), "state"), ["run_id", "on"], "left")
        ready = on.groupBy(*KEY).agg(F.count_if(F.col("state").isNull()).alias("open"), F.count_if(F.col("state") != "passed").alias("weak")).where("open = 0 OR weak > 0")
        new = cut(todo.join(ready, KEY).select(*KEY, state(F.col("weak") > 0).alias("state"), F.lit(n).alias("round")), "chain-round")
        if new.isEmpty():
            done = done.unionByName(todo.select(*KEY, F.lit("held").alias("state"), F.lit(None).cast("int").alias("round")))
            break
        done = cut(done.unionByName(new), "chain-done")
        todo = cut(todo.join(new, KEY, "left_anti"), "chain-left")
        edges = cut(edges.join(todo.select(*KEY), KEY, "left_semi"), "chain-edges")
    return done


CORRUPTIONS = ("digit_slip", "decimal_shift", "transposed", "false_precision", "hand_conversion", "invented")


def suite(values: DataFrame, seed: str = "gate") -> DataFrame:
    """(case_id, kind, honest, text, value_ids, token): claims about values (value_id, value, unit), honest and corrupted in six ways, and with no citation.

    A draw is a function of the seed, the kind and the value's id, so the suite is the same wherever and however often it is made. A
    corruption that is again a way to print its value is no case. Conversion by hand is for lengths in metres only.
    """
    v, id_ = F.col("value").cast("double"), F.col("value_id")
    draw = lambda kind, k=0: F.pmod(F.xxhash64(F.lit(f"{seed}/{kind}/{k}"), id_), F.lit(1 << 30))
    text = F.when(v == F.floor(v), F.format_string("%.1f", v)).otherwise(F.regexp_replace(F.format_string("%.6f", v), "0+$", ""))
    places = F.filter(F.transform(F.sequence(F.lit(1), F.length(text)), lambda k: F.when(F.substring(text, k, F.lit(1)).rlike("[0-9]"), k)), lambda k: k.isNotNull())
    at = F.get(places, F.pmod(draw("slip"), F.size(places).cast("long")).cast("int"))
    old = F.substring(text, at, F.lit(1)).cast("int")
    slip = F.concat(F.substring(text, F.lit(1), at - 1), F.pmod(old + 1 + F.pmod(draw("slip", 1), F.lit(9)), F.lit(10)).cast("string"), F.substring(text, at + 1, F.length(text)))
    swap = F.get(F.filter(places, lambda k: F.array_contains(places, k + 1) & (F.substring(text, k, F.lit(1)) != F.substring(text, k + 1, F.lit(1)))), F.lit(0))
    swapped = F.concat(F.substring(text, F.lit(1), swap - 1), F.substring(text, swap + 1, F.lit(1)), F.substring(text, swap, F.lit(1)), F.substring(text, swap + 2, F.length(text)))
    short = lambda c: F.regexp_replace(F.regexp_replace(F.format_string("%.6f", c), "0+$", ""), r"\.$", "")
    size = F.greatest(F.abs(v), F.lit(1.0))
    made = size * (0.3 + 2.2 * F.pmod(draw("invented"), F.lit(1000)) / 1000)
    tokens = {
        "digit_slip": slip, "decimal_shift": short(v * F.when(draw("shift") % 2 == 0, 10.0).otherwise(0.1)), "transposed": swapped,
        "false_precision": F.concat(F.format_string("%.3f", v), (F.pmod(draw("precision"), F.lit(9)) + 1).cast("string")),
        "hand_conversion": F.when(F.col("unit") == "m", short(v / 100)), "invented": F.when(size < 100, F.format_string("%.1f", made)).otherwise(F.format_string("%.0f", made)),
    }
    cases = [F.struct(F.lit("stated_plainly").alias("kind"), F.lit(True).alias("honest"), F.format_string("%.2f", v).alias("token"), F.array(id_).alias("value_ids"))]
    cases += [F.struct(F.lit(k).alias("kind"), F.lit(False).alias("honest"), t.alias("token"), F.array(id_).alias("value_ids")) for k, t in tokens.items()]
    cases += [F.struct(F.lit("uncited").alias("kind"), F.lit(False).alias("honest"), F.format_string("%.2f", v).alias("token"), F.array().cast("array<string>").alias("value_ids"))]
    own = F.transform(renderings(v), lambda r: F.replace(r, F.lit(","), F.lit("")))
    rows = values.where(v.isNotNull()).select("value_id", own.alias("own"), F.explode(F.array(*cases)).alias("c")).select("value_id", "own", "c.*")
    rows = rows.where(F.col("token").isNotNull() & (F.col("honest") | (F.col("kind") == "uncited") | ~F.array_contains("own", F.col("token"))))
    return rows.select(F.concat_ws("/", "kind", "value_id").alias("case_id"), "kind", "honest", F.concat(F.lit("a value of "), F.col("token"), F.lit(" is reported")).alias("text"), "value_ids", "token")


def judged(cases: DataFrame, values: DataFrame, context: DataFrame | None = None) -> DataFrame:
    """(kind, honest, put, refused, passed): what the gate makes of each kind of case; `context` (case_id, text) may be quoted."""
    refused = unbacked(cases, values, ["case_id"], context).select("case_id").distinct().withColumn("no", F.lit(1))
    out = cases.join(refused, "case_id", "left").groupBy("kind", "honest").agg(F.count("*").alias("put"), F.count("no").alias("refused"))
    return out.withColumn("passed", F.col("put") - F.col("refused"))
