"""Operators on hand-made rows: sources, matching, models, gates, packs and logs."""

from __future__ import annotations

import json

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestar.operators import compare, governance, matching, models, ranking, sampling, scoring, spatial, tables
from lodestar.sources import layers, paged
from lodestar.streaming import logs


def test_paged_source_pushes_filters(spark, tmp_path):
    for p in range(3):
        rows = [{"attributes": {"id": p * 10 + i, "name": f"n{i}", "extra": 1}} for i in range(4)]
        (tmp_path / f"p{p}.json").write_text(json.dumps({"features": rows}))
    paged.register(spark)
    df = spark.read.format("paged_json").schema("id long, name string").option("path", f"file://{tmp_path}").load()
    assert df.count() == 12
    assert {r.id for r in df.where("id >= 10 and name = 'n1'").collect()} == {11, 21}
    (tmp_path / "p9.json").write_text("<html>refused</html>")
    with pytest.raises(Exception, match="not JSON"):
        spark.read.format("paged_json").schema("id long").option("path", f"file://{tmp_path}").load().count()


def test_layers(spark, tmp_path):
    features = [
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}, "properties": {"id": 1, "n": "a"}},
        {"type": "Feature", "geometry": {"type": "LineString", "coordinates": [[0, 0], [3, 4]]}, "properties": {"id": 2}},
        {"type": "Feature", "geometry": {"type": "Point", "coordinates": []}, "properties": {"id": 3}},
        {"type": "Feature", "geometry": None, "properties": {"id": 4}},
    ]
    (tmp_path / "l.geojson").write_text(json.dumps({"type": "FeatureCollection", "features": features}, indent=1))
    layer = layers.read_geojson(spark, f"file://{tmp_path}/l.geojson", "id: long, n: string")
    assert [tuple(r) for r in layers.points_of(layer).collect()] == [(1, "a", 1.5, 2.5)]
    assert [tuple(r) for r in layers.lines_of(layer, "id").orderBy("seq").collect()] == [(2, 0, 0.0, 0.0), (2, 1, 3.0, 4.0)]
    (tmp_path / "d.toml").write_text('[[criterion]]\nkey = "a"\nweight = 2.0\n[[criterion]]\nkey = "b"\n')
    dim = layers.read_dimension(spark, f"file://{tmp_path}/d.toml", "criterion", "key string, weight double")
    assert [tuple(r) for r in dim.orderBy("key").collect()] == [("a", 2.0), ("b", None)]
    with pytest.raises(ValueError, match="weight"):
        layers.read_dimension(spark, f"file://{tmp_path}/d.toml", "criterion", "key string")
    layers.write_csv(dim, f"file://{tmp_path}/csv", ["key"])
    assert spark.read.option("header", True).csv(f"file://{tmp_path}/csv").count() == 2


@given(st.text("ab c", max_size=8), st.text("ab c", max_size=8))
def test_string_measures(a, b):
    def lcs(x, y):
        return 0 if not x or not y else lcs(x[1:], y[1:]) + 1 if x[0] == y[0] else max(lcs(x[1:], y), lcs(x, y[1:]))

    runs = max((j - i for i in range(len(a) + 1) for j in range(i, len(a) + 1) if a[i:j] in b), default=0)
    assert matching.longest_common(a, b) == runs
    assert matching.indel_ratio(a, b) == (100.0 if not a and not b else 200.0 * lcs(a, b) / (len(a) + len(b)))


def test_matching(spark):
    left = spark.createDataFrame([(1, "North Lake-1"), (2, "Alpha Hole 22"), (3, "zz")], "id long, name string")
    right = spark.createDataFrame([(10, "NORTH LAKE 1"), (11, "Alpha Hole 2"), (12, "Beta")], "id long, title string")
    assert sorted(tuple(r) for r in matching.fuzzy_join(left, right, "name", "title", 90).collect()) == [(1, 10, 100.0), (2, 11, pytest.approx(95.24, abs=0.01))]
    other = spark.createDataFrame([(1, "北京"), (2, "Ω-Lake"), (3, "--"), (4, None)], "id long, name string")
    names = spark.createDataFrame([(10, "Москва"), (11, "ω lake"), (12, "++"), (13, "")], "id long, title string")
    assert [tuple(r) for r in matching.fuzzy_join(other, names, "name", "title", 80).collect()] == [(2, 11, 100.0)]
    here = spark.createDataFrame([(1, "Alpha Hole 22", 0.0, 0.0), (2, "Beta", 0.0, 0.0)], "id long, name string, x double, y double")
    there = spark.createDataFrame([(10, "Alpha Hole 2", 9.0, 0.0), (11, "Alpha Hole 23", 3.0, 4.0), (12, "beta", 900.0, 0.0)], "id long, title string, x double, y double")
    gated = matching.fuzzy_join(here, there, "name", "title", 80, ("x", "y"), 6.0).collect()
    assert sorted((r.left_id, r.right_id) for r in gated) == [(1, 11), (2, 12)]
    c = spark.createDataFrame([("p", 1, 1, 0.9), ("p", 1, 2, 0.8), ("p", 2, 1, 0.85), ("p", 2, 2, 0.1), ("q", 1, 1, 0.5)], "page string, a long, b long, score double")
    assert sorted(tuple(r)[:3] for r in matching.greedy_pairs(c, "page").collect()) == [("p", 1, 1), ("p", 2, 2), ("q", 1, 1)]
    assert spark.createDataFrame([("ﬁ Å",)], "t string").select(matching.compatibility_form("t")).first()[0] == "fi å"


def test_models_out_of_fold(spark):
    df = spark.range(300).select("id", (F.col("id") % 7).cast("double").alias("x"), F.when(F.col("id") % 5 != 0, F.col("id") % 11).cast("double").alias("y"))
    df = sampling.folds(df.withColumn("label", (F.col("x") > 4).cast("int")), "id", 3)
    ready, names = models.with_indicators(df, ["x", "y"])
    assert names == ["x", "y", "missing_y"]
    for kind in ("boosted", "forest", "logistic"):
        out = models.out_of_fold(ready, models.classifier(kind, names, "label", trees=20), "label")
        assert out.count() == 300
        m = ranking.ranking_metrics(out, "score", "label").first()
        assert m.roc_auc > 0.95, kind
    one = models.out_of_fold(ready.withColumn("label", F.lit(1)), models.classifier("logistic", names, "label"), "label")
    assert one.count() == 0
    bag = models.bagged(ready, ready, models.classifier("logistic", names, "label"), "label", "id", 2, 2)
    assert bag.count() == 300


def test_ranking_ties_and_one_class(spark):
    df = spark.createDataFrame([(1, 0.9, 1), (2, 0.9, 0), (3, 0.5, 1), (4, None, 1), (5, 0.1, 0)], "id long, s double, y int")
    m = ranking.ranking_metrics(df, "s", "y").first()
    assert (m.n, m.positives) == (4, 2)
    assert m.average_precision == pytest.approx((1 * 0.5 + 1 * 2 / 3) / 2)
    assert m.roc_auc == pytest.approx(0.625)
    one = ranking.ranking_metrics(df.where("y = 1"), "s", "y").first()
    assert one.average_precision is None and one.roc_auc is None
    r = {x.id: x.r for x in ranking.average_rank(df, "s", "r").collect()}
    assert r == {4: 1.0, 5: 2.0, 3: 3.0, 1: 4.5, 2: 4.5}  # an unknown counts as 0 and ties with true zeros


def test_unknown_is_not_zero(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0), ("b", 1e6, 0.0)], "cell_id string, cx double, cy double")
    points = spark.createDataFrame([(1, 10.0, 0.0, None), (2, 0.0, 5.0, 4.0)], "id long, x double, y double, v double")
    got = {r.cell_id: r for r in spatial.point_stats(cells, points, "v", 100).collect()}
    assert (got["a"].hits, got["a"].n_obs, got["a"].max_value, got["a"].nearest) == (2, 1, 4.0, 5.0)
    assert (got["b"].hits, got["b"].n_obs, got["b"].max_value, got["b"].nearest) == (0, 0, None, None)
    exact = spatial.inverse_distance(spark.createDataFrame([("a", 0.0, 5.2)], "cell_id string, cx double, cy double"), points, "v", 8, 100).first()
    assert exact.value == 4.0
    crit = [scoring.Criterion("k", "v", "rising", 1.0, (0.0, 8.0)), scoring.Criterion("l", "w", "binary", 3.0)]
    df = spark.createDataFrame([(1, 4.0, None), (2, None, 0.0), (3, 4.0, 1.0)], "id long, v double, w double")
    s = {r.id: r.score for r in scoring.score(scoring.memberships(df, crit), crit, 0.5).collect()}
    assert s == {1: None, 2: 0.0, 3: (0.5 + 3) / 4}


def test_touching_edges_share_no_area(spark):
    cells = spark.createDataFrame([("a", 50.0, 50.0)], "cell_id string, cx double, cy double")
    rects = spark.createDataFrame([(1, "x", 100.0, 0.0, 200.0, 100.0), (2, "y", 90.0, 0.0, 200.0, 100.0), (3, "z", 0.0, 90.0, 100.0, 100.0)], "rect_id long, cls string, x0 double, y0 double, x1 double, y1 double")
    assert spatial.rectangle_class(cells, rects, 100).first()[1:] == ("y", 2)


def test_components_of_camps(spark, tmp_path):
    nodes = spark.range(10).withColumnRenamed("id", "id")
    edges = spark.createDataFrame([(0, 1), (1, 2), (2, 3), (5, 4), (7, 8)], "u long, v long")
    got = {r.id: r.root for r in sampling.components(nodes, edges, f"file://{tmp_path}").collect()}
    assert got == {0: 0, 1: 0, 2: 0, 3: 0, 4: 4, 5: 4, 6: 6, 7: 7, 8: 7, 9: 9}


def test_tiers_and_packs(spark, tmp_path):
    df = spark.createDataFrame([(2, "b"), (1, "a")], "id long, t string")
    governance.write_checked(df, f"file://{tmp_path}/t", "native", ["id", "t"])
    back = spark.read.parquet(f"file://{tmp_path}/t")
    assert governance.tier_violations(back, "t", "native").count() == 0
    assert governance.tier_violations(back, "t", "read").first().n == 2
    for bad in (lambda: governance.write_checked(df, "x", "native", ["id"]), lambda: governance.write_checked(df, "x", "other", ["id", "t"]), lambda: governance.write_checked(back, "x", "read", ["id", "t"])):
        with pytest.raises(ValueError, match="refused"):
            bad()
    folder = f"file://{tmp_path}/pack"
    told = governance.pack({"t": df}, {"t": ["id"]}, folder)
    assert told["t"]["rows"] == 2 and governance.unpack(spark, folder)["t"].count() == 2
    assert governance.pack({"t": df.orderBy("id")}, {"t": ["id"]}, f"file://{tmp_path}/pack2")["address"] == told["address"]
    assert governance.pack({"t": df.where("id = 1")}, {"t": ["id"]}, f"file://{tmp_path}/pack3")["address"] != told["address"]
    part = next((tmp_path / "pack/t").glob("*.parquet"))
    part.write_bytes(part.read_bytes()[:-1] + b"x")
    with pytest.raises(ValueError, match="not what was packed"):
        governance.unpack(spark, folder)


def test_diff_drift_and_years(spark):
    a = spark.createDataFrame([(1, 5), (2, 6), (3, None)], "k long, v long")
    b = spark.createDataFrame([(2, 6), (3, 1), (4, 9)], "k long, v long")
    assert {r.k: r.status for r in tables.diff(a, b, "k", "v").collect()} == {1: "removed", 2: "same", 3: "changed", 4: "added"}
    x = spark.createDataFrame([("c", 1.0), ("c", 1.0), ("m", 1.0), ("m", 3.0)], "f string, v double")
    y = spark.createDataFrame([("c", 2.0), ("c", 2.0), ("n", 1.0)], "f string, v double")
    assert {r.f: r.reason for r in tables.drift(x, y, "f", "v").collect()} == {"c": "constant moved", "m": "removed", "n": "added"}
    d = spark.createDataFrame([("2001",), ("2003",), (None,)], "y string")
    assert sorted((tuple(r) for r in tables.dense_years(d, F.col("y").cast("int")).collect()), key=str) == [(2001, 1), (2002, 0), (2003, 1), (None, 1)]


def test_logs(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in/a.json").write_text('{"k": 1, "f": "x", "usd": 2.0}\n{"k": 1, "f": "x", "usd": 3.0}\nbroken\n')
    log = logs.read_log(spark, f"file://{tmp_path}/in", "k long, f string, usd double").cache()
    assert str(logs.spend(log, "f", "usd", "_corrupt").first().total) == "nan"
    assert logs.spend(log.where("_corrupt is null"), "f", "usd").first().total == 5.0
    events = spark.createDataFrame([(1, "a", 1.0), (2, "a", 2.0), (1, "b", 3.0)], "k long, s string, usd double")
    assert {r.k: r.s for r in logs.last_wins(events, "k", ["usd"]).collect()} == {1: "b", 2: "a"}
    stream = logs.read_log(spark, f"file://{tmp_path}/in", "k long, f string, usd double", stream=True).where("_corrupt is null").select("k", "usd")
    for _ in range(2):  # the second run finds nothing new
        logs.run_once(stream, f"file://{tmp_path}/out", f"file://{tmp_path}/cp")
    assert spark.read.schema("k long, usd double").parquet(f"file://{tmp_path}/out").count() == 2


def test_state_goes_on_after_a_restart(spark, tmp_path):
    (tmp_path / "in").mkdir()
    part = lambda b: b.groupBy("k").agg(F.count("*").alias("n"))
    merge = lambda u: u.groupBy("k").agg(F.sum("n").alias("n"))

    def run():
        stream = logs.read_log(spark, f"file://{tmp_path}/in", "k long", stream=True, files=1)
        return {r.k: r.n for r in spark.read.parquet(logs.fold_state(stream, f"file://{tmp_path}/state", part, merge)).collect()}

    for i in range(3):
        (tmp_path / f"in/{i}.json").write_text('{"k": 1}\n' + f'{{"k": {i}}}\n')
    assert run() == {0: 1, 1: 4, 2: 1}
    assert len(list((tmp_path / "state").glob("batch-*"))) == 3  # one file a batch, so the fold has run
    (tmp_path / "in/9.json").write_text('{"k": 1}\n{"k": 9}\n')
    assert run() == {0: 1, 1: 5, 2: 1, 9: 1}


def test_resampling_draws_are_apart(spark):
    df = spark.range(5).crossJoin(spark.range(200).withColumnRenamed("id", "rep"))
    for draw in (sampling.uniform, sampling.portable):
        u = [r.u for r in df.select(draw(F.col("id"), F.col("rep"), 7).alias("u")).collect()]
        assert len(set(u)) == 1000 and 0 <= min(u) and max(u) < 1 and abs(sum(u) / 1000 - 0.5) < 0.04
    w = [r.w for r in sampling.resample(spark.range(300), "id", 100, 7).collect()]
    assert abs(sum(w) / len(w) - 1) < 0.02 and abs(sum(x * x for x in w) / len(w) - 2) < 0.06


def test_rank_permutation_against_brute_force(spark):
    """A score that ranks better is told from one that does not; observed difference by hand."""
    rows = [(i, int(i % 3 == 0), float(i % 3 == 0) + (i * 7 % 10) / 8, float(i * 37 % 101)) for i in range(60)]
    df = spark.createDataFrame(rows, "id long, y int, a double, b double")

    def precision(score):
        seen = hits = 0
        total = 0.0
        for s in sorted({score(r) for r in rows}, reverse=True):
            tied = [r for r in rows if score(r) == s]
            seen, hits = seen + len(tied), hits + sum(r[1] for r in tied)
            total += sum(r[1] for r in tied) * hits / seen
        return total / sum(r[1] for r in rows)

    got = sampling.rank_permutation(df, "id", "a", "b", "y", 400).first()
    assert abs(got.observed - (precision(lambda r: r[2]) - precision(lambda r: r[3]))) < 1e-9
    assert got.p_value < 0.02 and sampling.rank_permutation(df, "id", "b", "a", "y", 400).first().p_value > 0.9


def test_running_totals_in_ranges(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1000 / 10).alias("v"), (F.col("id") % 2).alias("g"), F.lit(1).alias("one"))
    got = ranking.running(df, "v", {"t": "one"}, ["g"], parts=7).collect()
    for g in (0, 1):
        mine = sorted((r.v, r.t) for r in got if r.g == g)
        assert [t for _, t in mine] == list(range(1, 501))
    cut = ranking.capture(df.withColumn("s", F.floor("v")).withColumn("y", (F.col("v") > 80).cast("int")), "s", "y", "v", 0.25).first()
    assert (cut.taken, cut.hits) == (250, 199)


def test_logistic_slope_and_added_information(spark):
    """Against the same fits in numpy."""
    import math

    import numpy as np

    rng = np.random.default_rng(5)
    a, b = rng.random(200), rng.random(200)
    y = (rng.random(200) < 1 / (1 + np.exp(-(3 * a + 2 * b - 2.5)))).astype(int)
    df = spark.createDataFrame([(float(i), float(j), int(k)) for i, j, k in zip(a, b, y)], "a double, b double, y int")

    def fit(*cols):
        x = np.column_stack([np.ones(200), *cols])
        w = np.zeros(x.shape[1])
        for _ in range(50):
            mu = 1 / (1 + np.exp(-(x @ w)))
            w = w + np.linalg.solve(x.T @ (x * (mu * (1 - mu))[:, None]), x.T @ (y - mu))
        mu = 1 / (1 + np.exp(-(x @ w)))
        return w, float((y * np.log(mu) + (1 - y) * np.log(1 - mu)).sum())

    small, large = fit(a), fit(a, b)
    ratio, coefficient, p = compare.added_information(df, "a", "b", "y")
    assert ratio == pytest.approx(2 * (large[1] - small[1]), abs=1e-6) and coefficient == pytest.approx(large[0][2], abs=1e-6)
    assert p == pytest.approx(math.erfc(math.sqrt(ratio / 2)) / 2)
    prob = np.clip(a, 1e-4, 1 - 1e-4)
    assert compare.calibration_slope(df, "a", "y") == pytest.approx(fit(np.log(prob / (1 - prob)))[0][1], abs=1e-6)
    assert compare.calibration_slope(df.withColumn("a", F.lit(0.5)), "a", "y") is None
    assert compare.added_information(df.withColumn("y", F.lit(1)), "a", "b", "y") is None


def test_snapshots_tell_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    before = governance.snapshot({"t": a, "u": a, "w": a})
    after = governance.snapshot({"t": a.orderBy("k", ascending=False), "u": a.withColumn("v", F.lit("z")), "n": a})
    assert {r.table_name: r.change for r in governance.changed(before, after).collect()} == {"u": "changed", "w": "removed", "n": "added"}


def test_capture_takes_a_tiebreak_of_any_type(spark):
    rows = [("0002_0001", 5.0, 1), ("0001_0001", 5.0, 0), ("0001_0002", 5.0, 1), (None, 5.0, 1), ("0009_0009", 9.0, 0), ("0000_0000", 1.0, 1)]
    df = spark.createDataFrame(rows, "cell string, s double, y int")
    assert tuple(ranking.capture(df, "s", "y", "cell", 0.5).first()) == (3, 1, 0.25)
    assert tuple(ranking.capture(df, "s", "y", "cell", 0.67).first()) == (4, 2, 0.5)
    many = spark.range(5000).select(F.format_string("%05d", F.col("id")).alias("cell"), F.lit(1.0).alias("s"), (F.col("id") < 700).cast("int").alias("y"))
    assert tuple(ranking.capture(many, "s", "y", "cell", 0.1).first()) == (500, 500, 500 / 700)
    assert [r.p for r in ranking.places(many, "cell", "p").orderBy("cell").collect()] == list(range(1, 5001))


def test_snapshots_tell_nulls_and_separators_apart(spark):
    of = lambda *rows: {"t": spark.createDataFrame(rows, "a string, b string")}
    for one, two in ((("a", None), (None, "a")), (("a|b", "c"), ("a", "b|c")), (("-", "x"), (None, "x"))):
        assert [tuple(r) for r in governance.verify(governance.snapshot(of(one)), of(two)).collect()] == [("t", "changed")]
    assert governance.verify(governance.snapshot(of(("a", None), ("b", "c"))), of(("b", "c"), ("a", None))).count() == 0


def test_layer_pairs_stay_within_the_radius(spark):
    cells = spark.createDataFrame([("a", 0.0, 0.0), ("b", 100.0, 0.0), ("c", 15.0, 0.0), ("d", 300.0, 0.0)], "cell_id string, cx double, cy double")
    left = spark.createDataFrame([(1, 9.0, 0.0), (2, 101.0, 0.0), (5, 301.0, 0.0)], "id long, x double, y double")
    right = spark.createDataFrame([(3, -9.0, 0.0), (4, 11.0, 0.0), (6, 318.0, 0.0)], "id long, x double, y double")
    got = {r.cell_id: (r.state, r.gap) for r in spatial.layer_pairs(cells, left, right, 10.0).collect()}
    assert got == {"a": ("known", 18.0), "b": ("unknown", None), "c": ("known", 2.0), "d": ("absent", None)}
