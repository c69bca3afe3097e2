"""Stencils over tiles against one array."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from lodestar.operators import rasters


def mean(a, width):
    """The mean over a square with reflected edges, pixel by pixel."""
    p = width // 2
    b = np.pad(a, p, mode="reflect")
    return np.array([[b[i : i + width, j : j + width].mean() for j in range(a.shape[1])] for i in range(a.shape[0])])


def plain(z, dx, dy, broad, fine):
    z = z - mean(z, broad)
    gy, gx = np.gradient(z, dy, dx)
    out = np.empty((*z.shape, 2))
    xx, yy, xy = mean(gx * gx, fine), mean(gy * gy, fine), mean(gx * gy, fine)
    for at in np.ndindex(z.shape):
        values, vectors = np.linalg.eigh([[xx[at], xy[at]], [xy[at], yy[at]]])
        across = vectors[:, 0]  # along the ridge: the direction of least change
        out[at] = np.degrees(np.arctan2(across[1], across[0])) % 180, (values[1] - values[0]) / values.sum()
    return out


def frame(spark, z, c0=0, r0=0):
    rows = [(c0 + int(j), r0 + int(i), None if np.isnan(z[i, j]) else float(z[i, j])) for i, j in np.ndindex(z.shape)]
    return spark.createDataFrame(rows, "col long, row long, z double")


def test_grain_equals_the_whole_array_whatever_the_tiles(spark):
    rng = np.random.default_rng(3)
    y, x = np.mgrid[0:41, 0:57]
    z = 8 * np.sin((x + 0.5 * y) / 2.5) + 0.3 * x + rng.normal(0, 1, x.shape)
    want = plain(z, 10.0, 20.0, 9, 5)
    for tile in (14, 30, 500):
        got = rasters.landform_grain(frame(spark, z, -7, 100), 10.0, 20.0, detrend=90.0, smooth=50.0, tile=tile).collect()
        assert len(got) == z.size
        for r in got:
            axis, coherence = want[r.row - 100, r.col + 7]
            assert r.coherence == pytest.approx(coherence, abs=1e-9)
            assert min(abs(r.axis - axis), 180 - abs(r.axis - axis)) < 1e-5


def test_ridges_have_their_own_axis_and_flat_ground_none(spark):
    y, x = np.mgrid[0:30, 0:30]
    ridge = rasters.landform_grain(frame(spark, np.sin((x - y) / 2.0) * 50), 1.0, 1.0, detrend=9.0, smooth=5.0).where("col between 10 and 20 and row between 10 and 20")
    assert all(abs(r.axis - 45) < 1 and r.coherence > 0.99 for r in ridge.collect())
    flat = rasters.landform_grain(frame(spark, np.full((30, 30), 7.0)), 1.0, 1.0, detrend=9.0, smooth=5.0).collect()
    assert {(r.axis, r.coherence) for r in flat} == {(None, 0.0)}


def test_missing_heights_small_rasters_repeats_and_nulls(spark):
    rng = np.random.default_rng(5)
    z = rng.normal(0, 1, (30, 30))
    whole = {(r.col, r.row): (r.axis, r.coherence) for r in rasters.landform_grain(frame(spark, z), 1.0, 1.0, detrend=3.0, smooth=3.0).collect()}
    z[15, 15] = np.nan
    holed = frame(spark, z).where("NOT (col = 3 AND row = 4)")
    odd = holed.unionByName(holed.withColumn("z", F.col("z") + 5)).unionByName(spark.createDataFrame([(None, 3, 1.0)], holed.schema))
    got = {(r.col, r.row): (r.axis, r.coherence) for r in rasters.landform_grain(odd, 1.0, 1.0, detrend=3.0, smooth=3.0, tile=8).collect()}
    assert len(got) == 899 and (3, 4) not in got
    for at, values in got.items():
        near = max(abs(at[0] - 15), abs(at[1] - 15)) <= 2 or max(abs(at[0] - 3), abs(at[1] - 4)) <= 2
        if near:
            assert values == (None, None)
        elif max(abs(at[0] - 15), abs(at[1] - 15)) > 3 and max(abs(at[0] - 3), abs(at[1] - 4)) > 3:
            assert values == pytest.approx(whole[at], abs=1e-9)
    few = rasters.landform_grain(frame(spark, z[:4]), 1.0, 1.0, detrend=3.0, smooth=3.0).collect()
    assert len(few) == 120 and {(r.axis, r.coherence) for r in few} == {(None, 0.0)}
    assert rasters.landform_grain(frame(spark, z).where("false"), 1.0, 1.0).count() == 0
