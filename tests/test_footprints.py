"""Hulls, geodesics and the leak audit against plain computation and published values."""

from __future__ import annotations

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.functions import geo
from lodestar.operators import footprints, leakaudit


def plain_hull(points):
    """Directed pairs with every other point on their left or between them."""
    points, edges = sorted(set(points)), {}
    for a in points:
        for b in points:
            if a != b:
                ok = True
                for c in points:
                    side = (b[0] - a[0]) * (c[1] - a[1]) - (b[1] - a[1]) * (c[0] - a[0])
                    ok = ok and (side > 0 or (side == 0 and (c[0] - a[0]) * (c[0] - b[0]) + (c[1] - a[1]) * (c[1] - b[1]) <= 0))
                if ok:
                    edges[a] = b
    at = min(points)
    out = [at]
    while edges and edges[out[-1]] != at:
        out.append(edges[out[-1]])
    return out


def test_hulls_of_hulls_equal_the_hull_of_all(spark):
    rng = random.Random(3)
    groups = {g: [(float(rng.randint(0, 12)), float(rng.randint(0, 12))) for _ in range(rng.choice([1, 2, 5, 90]))] for g in range(12)}
    groups[20] = [(float(k), 2.0 * k) for k in range(9)]  # in line
    groups[None] = [(0.0, 0.0), (4.0, 0.0), (4.0, 3.0), (0.0, 3.0), (2.0, 1.0)]
    rows = [(g, x, y) for g, p in groups.items() for x, y in p] + [(3, None, 1.0), (3, float("nan"), 900.0)]
    df = spark.createDataFrame(rows, "g long, x double, y double").repartition(7)
    got = {}
    for r in sorted(footprints.hulls(df, "g").collect(), key=lambda r: r.seq):
        got.setdefault(r.g, []).append((r.x, r.y))
    assert set(got) == set(groups)
    for g, p in groups.items():
        assert got[g] == plain_hull(p), g
    hot = spark.range(40_000).select(F.lit(1).alias("g"), (F.col("id") % 200).cast("double").alias("x"), F.floor(F.col("id") / 200).cast("double").alias("y"))
    assert [(r.x, r.y) for r in footprints.hulls(hot, "g").orderBy("seq").collect()] == [(0.0, 0.0), (199.0, 0.0), (199.0, 199.0), (0.0, 199.0)]
    assert footprints.hulls(df.where("false"), "g").count() == 0


def test_grown_hulls(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (1, 10.0, 0.0), (1, 10.0, 4.0), (1, 0.0, 4.0), (2, 5.0, 5.0), (3, 0.0, 0.0), (3, 8.0, 0.0)], "g long, x double, y double")
    rings = {}
    for r in footprints.footprints(df, "g", 2.0, quarter=90).orderBy("g", "seq").collect():
        rings.setdefault(r.g, []).append((r.x, r.y))
    area = lambda p: sum(a[0] * b[1] - b[0] * a[1] for a, b in zip(p, p[1:] + p[:1], strict=True)) / 2
    assert area(rings[1]) == pytest.approx(40 + 28 * 2 + math.pi * 4, rel=1e-3)
    assert area(rings[2]) == pytest.approx(math.pi * 4, rel=1e-3) and area(rings[3]) == pytest.approx(32 + math.pi * 4, rel=1e-3)
    assert min(x for x, _ in rings[1]) == pytest.approx(-2) and max(y for _, y in rings[1]) == pytest.approx(6)


def test_geodesics_are_within_a_millimetre_of_published_values(spark):
    dms = lambda d, m, s: math.copysign(abs(d) + m / 60 + s / 3600, d)
    rows = [
        (dms(144, 25, 29.5244), dms(-37, 57, 3.7203), dms(143, 55, 35.3839), dms(-37, 39, 10.1561), 54972.271, dms(306, 52, 5.37)),
        (0.0, 0.0, 0.0, 90.0, 10001965.729, 0.0), (0.0, 0.0, 1.0, 0.0, 111319.491, 90.0), (179.5, 10.0, -179.5, 10.0, 109639.322, 89.913),
        (5.0, 5.0, 5.0, 5.0, 0.0, None), (0.0, 0.0, 180.0, 0.0, None, None), (0.0, 0.3, 179.7, -0.2, None, None), (0.0, 95.0, 1.0, 1.0, None, None), (None, 0.0, 1.0, 1.0, None, None),
    ]
    df = spark.createDataFrame([r[:4] for r in rows], "a double, b double, c double, d double")
    got = [r.g for r in df.select(geo.geodesic(*(F.col(c) for c in "abcd")).alias("g")).collect()]
    for g, row in zip(got, rows, strict=True):
        if row[4] is None:
            assert g is None
        elif row[5] is None:
            assert tuple(g) == (0.0, None)
        else:
            assert g.metres == pytest.approx(row[4], abs=0.001) and g.bearing == pytest.approx(row[5], abs=2e-3 if row[0] == 179.5 else 2e-6)


def test_leak_audit_finds_a_planted_word(spark):
    rng = random.Random(1)
    words = [f"w{chr(97 + a)}{chr(97 + b)}" for a in range(12) for b in range(12)]
    rows = []
    for k in range(300):
        y = int(rng.random() < 0.3)
        text = " ".join(rng.choices(words, k=25) + (["drilled"] if y and rng.random() < 0.95 else []) + ["the"] + ([f"only{chr(97 + k % 26)}{chr(97 + k // 26)}"]))
        rows.append((k, text, y, k % 5))
    rows += [(900, None, 0, 1), (901, "", 1, 2)]
    docs = spark.createDataFrame(rows, "id long, text string, y int, fold int")
    metrics, found = leakaudit.audit(docs, "id", "text", "y", "fold")
    m = {r.ranking: r for r in metrics.collect()}
    assert m["text"].average_precision > 0.9 and m["text"].n == 302 and m["length"].n == 302
    top = {(r.toward, r["rank"]): r.term for r in found.collect()}
    assert top["positive", 1] == "drilled" and not any(t.startswith("only") or t == "the" for t in top.values())
    shuffled = docs.withColumn("y", (F.xxhash64("id") % 3 == 0).cast("int"))
    assert {r.ranking: r for r in leakaudit.audit(shuffled, "id", "text", "y", "fold")[0].collect()}["text"].roc_auc < 0.68
    with pytest.raises(ValueError):
        leakaudit.vectors(docs, "id", "text", bound=5)
    one = leakaudit.audit(docs.where("y = 0"), "id", "text", "y", "fold")
    assert one[1].count() == 0 and one[0].where("average_precision IS NOT NULL").count() == 0


def test_the_fit_is_that_of_the_penalised_likelihood(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(0, 1, (200, 4))
    y = (x[:, 0] + rng.normal(0, 1, 200) > 0.7).astype(int)
    from pyspark.ml.linalg import Vectors

    rows = spark.createDataFrame([(k, int(y[k]), Vectors.dense(x[k].tolist())) for k in range(200)], ["id", "label", "features"])
    model = leakaudit._fit(rows, 1.0)
    s, w = np.where(y == 1, 200 / (2 * y.sum()), 200 / (2 * (200 - y.sum()))), np.zeros(5)
    z = np.c_[x, np.ones(200)]
    for _ in range(50):
        p = 1 / (1 + np.exp(-z @ w))
        hold = np.diag([1.0] * 4 + [0.0])
        w -= np.linalg.solve(z.T @ (z * (s * p * (1 - p))[:, None]) + hold, z.T @ (s * (p - y)) + hold @ w)
    assert model.coefficients.toArray() == pytest.approx(w[:4], abs=1e-4) and model.intercept == pytest.approx(w[4], abs=1e-4)
