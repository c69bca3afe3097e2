"""Odd and larger inputs on which queries of the round before went wrong."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestar.functions import text as tx


def test_file_number_keeps_more_than_five_digits(spark):
    df = spark.createDataFrame([("maw 7",), ("MAW0100002",), ("MAW 99999",)], "t string")
    assert [r[0] for r in df.select(tx.file_number(F.col("t"))).collect()] == ["MAW00007", "MAW100002", "MAW99999"]


def test_hindcast_ties_do_not_depend_on_the_order_of_the_rows(spark, tmp_path):
    from datetime import datetime

    early, late = datetime(1998, 1, 1), datetime(2000, 1, 1)
    prices = {1: [0.1, 0.2, 0.3], 2: [0.3, 0.2, 0.1], 3: [1e6], 4: []}
    orders = [(k, early, p) for k, v in prices.items() for p in v] + [(k, late, 1.0) for k in prices]
    spark.createDataFrame([(k,) for k in prices], "c_custkey long").write.parquet(f"file://{tmp_path}/customer.parquet")
    spark.createDataFrame(orders, "o_custkey long, o_orderdate timestamp_ntz, o_totalprice double").write.parquet(f"file://{tmp_path}/orders.parquet")
    from lodestar.plans.table_queries import i26_hindcast

    assert {(r.c_custkey, r.share) for r in i26_hindcast(spark, f"file://{tmp_path}").collect()} == {(1, 0.75), (2, 0.75), (3, 0.25), (4, 1.0)}


def test_binomial_tail(spark):
    from math import comb

    from lodestar.operators import compare

    cases = [(0, 0), (1, 0), (7, 3), (31, 15), (40, 12), (1000, 470), (20_000, 9_900), (20_000, 10_000)]
    got = {(r.n, r.k): r.tail for r in compare.binomial_tail(spark.createDataFrame(cases, "n long, k long"), "n", "k", block=64).collect()}
    for n, k in cases:
        term, total = comb(n, k), 0
        for i in range(k, -1, -1):
            total, term = total + term, term * i // (n - i + 1)
        assert abs(got[n, k] / ((total << 64 >> n) / 2**64) - 1) < 1e-11 if total << 64 >> n else got[n, k] < 1e-18


def test_binomial_tail_of_many_throws_ends(spark):
    """A million terms are a million steps, not their square."""
    from lodestar.operators import compare

    got = compare.binomial_tail(spark.createDataFrame([(2_000_000, 1_000_000)], "n long, k long"), "n", "k").first().tail
    assert abs(got - 0.5 - 0.5 / (3.141592653589793 * 1_000_000) ** 0.5) < 1e-9


def test_portable_draws_compare_as_text(spark):
    from lodestar.operators import sampling

    steps = sampling.poisson_steps()
    df = spark.range(500)
    w = {(r.id, r.rep): r.w for r in sampling.resample(df, "id", 20, 7, sampling.portable).collect()}
    u = {(r.id, r.rep): r.u for r in sampling.replicates(df, 20).select("id", "rep", sampling.portable(F.col("id"), F.col("rep"), 7).alias("u")).collect()}
    assert w == {k: sum(c <= v for c in steps) for k, v in u.items()}
    assert sampling.replicates(df, 20).rdd.getNumPartitions() >= 64


def test_weighted_precision_without_weight_on_a_class_is_null(spark):
    from lodestar.operators import ranking

    df = spark.createDataFrame([(0, 0.5, 1, 0), (0, 0.2, 0, 1), (1, 0.5, 1, 1), (1, 0.2, 0, 1)], "rep int, s double, label int, w int")
    assert dict(ranking.weighted_precision(df, "s", "label", "w", ["rep"]).collect()) == {0: None, 1: 1.0}


def test_worst_of_is_worst_of_run(spark):
    from lodestar.operators import checks

    day = "timestamp'2020-01-0{}'"
    rows = [("a", 1.0, 10.0, 0.1, 0.1, 10.0), ("b", -1.0, 10.0, 2.0, 0.1, None), ("b", 1.0, 15.0, 0.1, 0.1, 10.0), ("c", 1.0, 90.0, 0.1, 0.1, 10.0), ("d", 1.0, 10.0, 0.1, None, 10.0)]
    df = spark.createDataFrame(rows, "row_id string, quantity double, price double, discount double, tax double, list_price double")
    df = df.selectExpr("*", f"{day.format(1)} AS shipped", f"CASE WHEN row_id = 'a' THEN {day.format(2)} WHEN row_id = 'c' THEN {day.format(1)} END AS ordered")
    names = ["positive_quantity", "unit_price_range", "share_range", "shipped_after_order"]
    told = {tuple(map(str, r)) for r in checks.worst_of(df, names).collect()}
    assert told == {tuple(map(str, r)) for r in checks.worst(checks.run(df, names)).collect()}
    assert len(told) == 4
    plan = checks.worst_of(df, names)._jdf.queryExecution().optimizedPlan().toString()
    assert "Generate" not in plan  # no row for each rule


def test_greedy_pairs_against_a_plain_search(spark):
    import random

    from lodestar.operators import matching

    rnd = random.Random(5)
    rows = [(g, a, b, rnd.choice([0.1, 0.5, 0.9, None, float("nan")])) for g in ("p", "q", None) for a in range(9) for b in range(7)]
    want = set()
    for g in ("p", "q", None):
        used_a, used_b = set(), set()
        for _, a, b, s in sorted((r for r in rows if r[0] == g), key=lambda r: (-r[3] if r[3] is not None and r[3] == r[3] else 1, r[1], r[2])):
            if a not in used_a and b not in used_b:
                want.add((g, a, b, str(s)))
                used_a.add(a)
                used_b.add(b)
    out = matching.greedy_pairs(spark.createDataFrame(rows, "page string, a long, b long, score double"), "page")
    assert {(r.page, r.a, r.b, str(r.score)) for r in out.collect()} == want
    assert "FlatMapGroups" not in out._jdf.queryExecution().optimizedPlan().toString()  # no call for each group


def test_shared_terms(spark):
    from lodestar.operators import retrieval

    docs = spark.createDataFrame([(1, "x y x z", 1), (2, "z", 2), (3, "w", 1), (4, None, 2)], "doc_id long, text string, tier int")
    q = spark.createDataFrame([(10, "x"), (10, "z"), (11, "z")], "query_id long, term string")
    got = retrieval.shared_terms(docs, "doc_id", F.split("text", " "), q, ["tier"])
    assert {tuple(r) for r in got.collect()} == {(10, 1, 1, 2), (11, 1, 1, 1), (10, 2, 2, 1), (11, 2, 2, 1)}


def test_contacts_keep_a_small_plan(spark):
    """The geometry once grew to generated code that the driver could not compile."""
    from lodestar.operators import polygons

    sides = [("a", 0.0, 0.0, 0.0, 10.0), ("b", 0.0, 2.0, 0.0, 8.0), ("c", 50.0, 0.0, 50.0, 10.0)]
    found = polygons.contacts(spark.createDataFrame(sides, "domain string, x1 double, y1 double, x2 double, y2 double"), 1e-6, 40.0)
    assert {(r.domain, r.other) for r in found.collect()} == {("a", "b"), ("b", "a")}
    assert len(found._jdf.queryExecution().optimizedPlan().toString()) < 12_000


def test_distances_that_equal_the_limit_are_applicable(spark):
    """On a grid all of these are two steps of the training rows apart, whatever the rounding of the standardised values."""
    from lodestar.operators import applicability

    starts = [1000 + 7 * j for j in range(60)] + [12345 + 7 * j for j in range(3)]
    train = [(k, float(v), True) for k, v in enumerate(a + i for a in starts for i in (0, 1))]
    asked = [(1000 + k, float(a + 3 + k % 2 * (a in (starts[59], starts[62]))), False) for k, a in enumerate(starts)]
    got = applicability.area_of_applicability(spark.createDataFrame(train + asked, "id long, a double, t boolean"), "id", ["a"], "t").where("id >= 1000")
    assert {r.id: r.applicable for r in got.collect()} == {1000 + k: k != 59 for k in range(63)}  # 59 is three steps away


def test_leak_audit_takes_few_passes(spark):
    """Rare terms once made each fit slow to settle; every step sends the driver a number for each term."""
    import random

    from lodestar.operators import leakaudit

    rnd = random.Random(3)
    words = [f"w{chr(97 + a)}{chr(97 + b)}{chr(97 + c)}" for a in range(12) for b in range(12) for c in range(12)]
    rows = [(k, " ".join(words[int(len(words) * rnd.random() ** 4)] for _ in range(60)), k % 2, k % 5) for k in range(400)]
    docs = spark.createDataFrame(rows, "id long, text string, y int, fold int").repartition(4)
    spark.sparkContext.setJobGroup("leak-audit", "leak-audit")
    metrics, _ = leakaudit.audit(docs, "id", "text", "y", "fold")
    spark.sparkContext.setJobGroup("after", "after")
    assert metrics.count() == 2
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("leak-audit")) < 140


def test_pages_are_searched_once(spark):
    from lodestar.operators import locating

    w = spark.createDataFrame([(1, k, t, 0, k / 10, 0.0, k / 10 + 0.09, 0.01) for k, t in enumerate(["ab", "cd", "ab"])], "pool long, no long, text string, line long, x0 double, y0 double, x1 double, y1 double")
    found = locating.locate_values(w, spark.createDataFrame([(1, 1, "ab"), (2, 1, "cd"), (3, 1, "zz")], "value_id long, pool long, value string"))
    assert {(r.value_id, r.first, r.ambiguous) for r in found.collect()} == {(1, 0, True), (2, 1, False), (3, None, False)}
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroupsInArrow") == 1
