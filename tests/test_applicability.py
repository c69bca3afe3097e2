"""Nearest training rows and the area of applicability against all distances."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import applicability


def brute(x, train, share=0.95, factor=2.0):
    whole = ~np.isnan(x).any(axis=1)
    t = np.flatnonzero(train & whole)
    z = (x - x[t].mean(axis=0)) / np.where(x[t].std(axis=0) > 0, x[t].std(axis=0), 1.0)
    d = np.sqrt(((z[:, None] - z[None, t]) ** 2).sum(axis=2))
    own = d[t].copy()
    own[np.arange(len(t)), np.arange(len(t))] = np.inf
    bar = np.quantile(own.min(axis=1), share) * factor
    near = d.min(axis=1)
    return near, bar, [None if not w else bool(v <= bar) for v, w in zip(near, whole, strict=True)]


@pytest.mark.parametrize("block", [16, 4096])
def test_equals_all_distances(spark, monkeypatch, block):
    monkeypatch.setattr(applicability, "BLOCK", block)
    rng = np.random.default_rng(4096)
    x = np.concatenate([rng.normal(0, 1, (250, 5)), rng.normal(4, 0.2, (250, 5)), np.tile(rng.normal(1, 1, (1, 5)), (120, 1)), rng.normal(0, 9, (60, 5))])
    x[:, 4] = 7.0  # no deviation
    x[::41, 2] = np.nan
    train = rng.random(len(x)) < 0.4
    near, bar, want = brute(x, train)
    rows = spark.createDataFrame([(f"c{k:04d}", *map(float, r), bool(t)) for k, (r, t) in enumerate(zip(x, train, strict=True))], "cell string, a double, b double, c double, d double, e double, t boolean")
    got = {r.cell: r for r in applicability.area_of_applicability(rows, "cell", list("abcde"), "t").collect()}
    assert len(got) == len(x)
    for k, v in enumerate(want):
        r = got[f"c{k:04d}"]
        assert r.applicable == v
        assert (r.distance, r.threshold) == ((None, None) if v is None else (pytest.approx(near[k], abs=1e-9), pytest.approx(bar)))
    assert {False, True, None} == set(want)


def test_quantiles_and_empty_training(spark):
    values = [3.0, 1.0, 1.0, 8.0, 2.0, 9.5, 9.5]
    df = spark.createDataFrame([(v, 1) for v in values], "v double, n int").groupBy("v").agg(F.sum("n").alias("n"))
    for q in (0.0, 0.3, 0.5, 0.95, 1.0):
        assert applicability.quantile(df, "v", "n", q) == pytest.approx(np.quantile(values, q))
    assert applicability.quantile(df.where("false"), "v", "n", 0.5) is None
    rows = spark.createDataFrame([(1, 1.0, False), (2, 2.0, None)], "i long, a double, t boolean")
    assert {(r.i, r.distance, r.applicable) for r in applicability.area_of_applicability(rows, "i", ["a"], "t").collect()} == {(1, None, None), (2, None, None)}
    one = rows.unionByName(spark.createDataFrame([(3, 5.0, True)], rows.schema))
    assert {r.i: r.distance for r in applicability.area_of_applicability(one, "i", ["a"], "t").collect()}[3] == 0.0
