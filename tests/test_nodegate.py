"""Six rules, each with a claim that breaks it and one that does not; chains; the suite of corrupted claims."""

from __future__ import annotations

import pytest

from lodestar.operators import nodegate

NODE = "run_id string, node_id string, cell string, kind string, criterion string, status string, strength int, text string, value_ids array<string>, depends_on array<string>"


@pytest.fixture(scope="module")
def world(spark):
    values = spark.createDataFrame([("c:cell:A:dist", 120.0), ("c:cell:A:grade", None), ("c:crit:A:near", 0.9), ("c:cell:B:dist", 5.0), ("c:cell:Z:dist", 7.0), ("c:cov:dist", 0.93), ("c:nb:A:faults:5000:in_footprint", 0.0), ("c:x:B:pair:lines:in_footprint", 1.0), ("c:cell:A:depth", 40.0)], "value_id string, value double")
    criteria = spark.createDataFrame([("near", "dist", "falling", 200.0), ("rich", "grade", "rising", 5.0), ("deep", "depth", "rising", 100.0), ("top", "dist", "percentile", None)], "criterion string, feature string, direction string, bar double")
    near = spark.createDataFrame([("A", "B")], "cell string, other string")
    unknown = spark.createDataFrame([("A", "grade")], "cell string, feature string")
    layers = spark.createDataFrame([("deep", "faults"), ("near", "lines")], "criterion string, layer string")
    return values, criteria, near, unknown, layers


CASES = {
    "ok": (("near", "met", 3, "it is 120 m away, a share of 0.90, in 2 places", ["c:cell:A:dist", "c:crit:A:near"]), set()),
    "glued": (("near", "met", 3, "it is 120m away", ["c:cell:A:dist"]), set()),
    "label": (("near", "met", 3, "121: drilled", ["c:cell:A:dist"]), {"ids"}),
    "inside": (("near", "met", 3, "sheet 74H09 and PLS12-023", ["c:cell:A:dist"]), set()),
    "number": (("near", "met", 3, "it is 12 m away", ["c:cell:A:dist"]), {"ids"}),
    "gone": (("near", "met", 3, "near", ["c:cell:A:dist", "c:cell:A:none"]), {"ids"}),
    "form": (("near", "met", 3, "near", ["c:cell:A:dist", "what"]), {"ids"}),
    "strange": (("near", "met", 3, "near", ["c:cell:A:dist", "c:cell:Z:dist"]), {"identity"}),
    "neighbour": (("near", "met", 3, "near", ["c:cell:A:dist", "c:cell:B:dist", "c:cov:dist"]), set()),
    "against": (("near", "not_met", 3, "far", ["c:cell:A:dist"]), {"polarity"}),
    "hedged": (("near", "not_met", 3, "however, far", ["c:cell:A:dist"]), set()),
    "member": (("deep", "met", 3, "deep", ["c:cell:A:depth"]), {"polarity"}),
    "uncited": (("near", "met", 3, "near", ["c:cov:dist"]), {"polarity"}),
    "percentile": (("top", "not_met", 3, "low", ["c:cell:A:dist"]), set()),
    "strength": (("rich", "unknown", 1, "not known", []), {"unknown"}),
    "measured": (("near", "unknown", 0, "not known", ["c:cell:A:dist"]), {"unknown"}),
    "unknown": (("rich", "unknown", 0, "not known", ["c:cell:A:grade"]), set()),
    "uncharted": (("deep", "unknown", 0, "not known", ["c:cell:A:depth"]), set()),
    "equals": (("near", "met", 3, "5 = 5", ["c:cell:A:dist"]), {"arithmetic"}),
    "sum": (("near", "met", 3, "an average near 5", ["c:cell:A:dist"]), {"arithmetic"}),
    "footprint": (("deep", "not_met", 3, "shallow", ["c:cell:A:depth"]), {"footprint"}),
    "mapped": (("near", "not_met", 3, "but far", ["c:cell:A:dist"]), set()),
    "nothing": (("none", "met", 3, "x", []), {"criterion"}),
}


def frame(spark, rows):
    return spark.createDataFrame(rows, NODE)


def test_each_rule_has_a_failing_and_a_passing_claim(spark, world):
    nodes = frame(spark, [("r", k, "A", "criterion", *c[0], []) for k, c in CASES.items()] + [("r", "null", "A", "criterion", "rich", "unknown", 0, None, None, None)])
    found = {}
    for r in nodegate.problems(nodes, *world).collect():
        found.setdefault(r.node_id, set()).add(r.rule)
    assert found == {k: c[1] for k, c in CASES.items() if c[1]}
    context = spark.createDataFrame([("r", "number", "the log says 12 m")], "run_id string, node_id string, text string")
    assert "number" not in {r.node_id for r in nodegate.problems(nodes, *world, context).collect()}
    assert nodegate.problems(nodes.where("false"), *world).count() == 0


def test_chains_settle_in_rounds(spark):
    on = {"a": [], "b": ["a"], "c": ["b", "a"], "bad": [], "d": ["bad"], "e": ["d", "c"], "gone": ["nobody"], "f": ["gone"], "x": ["y"], "y": ["x"], "z": ["x", "a"], "self": ["self"], "worse": ["a"]}
    nodes = frame(spark, [(r, k, "A", "criterion", "k", "met", 1, "", [], v) for r in ("1", "2") for k, v in on.items()])
    bad = spark.createDataFrame([("1", "bad", "ids"), ("1", "bad", "polarity"), ("1", "worse", "ids")], "run_id string, node_id string, rule string")
    got = {(r.run_id, r.node_id): (r.state, r.round) for r in nodegate.settle(nodes, bad).collect()}
    assert len(got) == 26
    one = {k: got["1", k] for k in on}
    assert {k for k, v in one.items() if v[0] == "passed"} == {"a", "b", "c"} and {k for k, v in one.items() if v[0] == "refused"} == {"bad", "worse"}
    assert [one[k][1] for k in ("a", "b", "c", "x", "self")] == [0, 1, 2, None, None] and one["e"][0] == one["f"][0] == one["z"][0] == "held"
    assert got["2", "e"][0] == "passed"
    assert nodegate.settle(nodes.where("false"), bad).count() == 0


def test_the_suite_is_made_again_the_same_and_the_gate_sorts_it(spark):
    rows = [(f"c:cell:{k}:f", v, "m" if k % 2 else "ppm") for k, v in enumerate([12.5, 1200.0, 0.37, 88.0, 3456.78, -4.2, 7.0, 11.11] * 12)] + [("c:cell:n:f", None, "m")]
    values = spark.createDataFrame(rows, "value_id string, value double, unit string")
    cases = nodegate.suite(values)
    one, two = {r.case_id: r for r in cases.collect()}, {r.case_id: r for r in nodegate.suite(values.repartition(5)).collect()}
    assert one == two and len(one) == len(cases.collect()) and one != {r.case_id: r for r in nodegate.suite(values, seed="other").collect()}
    kinds = {r.kind: r for r in nodegate.judged(cases, values).collect()}
    assert set(kinds) == {*nodegate.CORRUPTIONS, "stated_plainly", "uncited"}
    assert (kinds["stated_plainly"].put, kinds["stated_plainly"].refused) == (96, 0) and kinds["hand_conversion"].put <= 48
    for k in nodegate.CORRUPTIONS:
        assert kinds[k].put == kinds[k].refused + kinds[k].passed and kinds[k].refused >= 0.7 * kinds[k].put, k
    assert one["transposed/c:cell:0:f"].token == "21.5" and one["false_precision/c:cell:0:f"].token.startswith("12.500")
    assert all(r.token.count(".") <= 1 and r.token not in (None, "") for r in one.values())
    quoted = spark.createDataFrame([(f"uncited/{i}", f"the record reads {v:.2f}") for i, v, _ in rows if v is not None], "case_id string, text string")
    assert {r.kind: r.refused for r in nodegate.judged(cases, values, quoted).collect()}["uncited"] < kinds["uncited"].refused
