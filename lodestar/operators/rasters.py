"""Stencils over rasters whose pixels are rows (col, row, z), col and row whole numbers.

A raster is cut into square tiles. A tile's task gets its own pixels and a halo as wide as the stencil reaches, so a pixel is sent to
the tiles around it that need it and no task holds more than a tile with its halo, whatever the raster's size. At the raster's own
edges values are reflected, the edge itself once.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import prepare


def box_mean(a: np.ndarray, width: int) -> np.ndarray:
    """Mean over a square of odd `width`, one direction after the other, edges reflected; unknown where a value is missing."""
    pad = width // 2
    lost = np.isnan(a)
    for axis in (0, 1):
        ends = [(pad, pad) if k == axis else (0, 0) for k in (0, 1)]
        sums = np.cumsum(np.pad(np.where(lost, 0.0, a), ends, mode="reflect"), axis=axis)
        gone = np.cumsum(np.pad(lost, ends, mode="reflect"), axis=axis)
        cut = lambda s: np.moveaxis(np.moveaxis(s, axis, 0)[width - 1 :] - np.concatenate([np.zeros_like(np.moveaxis(s, axis, 0)[:1]), np.moveaxis(s, axis, 0)[: -width]]), 0, axis)  # noqa: E731, B023
        a, lost = cut(sums) / width, cut(gone) > 0
    return np.where(lost, np.nan, a)


def structure(z: np.ndarray, dx: float, dy: float, detrend: int, smooth: int, floor: float) -> tuple[np.ndarray, np.ndarray]:
    """Axis in degrees [0, 180) across the mean gradient, and coherence, of heights less their broad mean.

    The tensor of the gradient, averaged over `smooth` pixels, has the closed-form axis of a symmetric matrix of order two. Where its trace
    is at most `floor` there is no slope: the axis is unknown and the coherence 0.
    """
    z = z - box_mean(z, detrend)
    gy, gx = np.gradient(z, dy, dx)
    xx, yy, xy = box_mean(gx * gx, smooth), box_mean(gy * gy, smooth), box_mean(gx * gy, smooth)
    trace = xx + yy
    solid = trace > floor
    coherence = np.where(solid, np.sqrt((xx - yy) ** 2 + 4 * xy * xy) / np.where(solid, trace, 1.0), np.where(np.isnan(trace), np.nan, 0.0))
    axis = np.mod(np.degrees(0.5 * np.arctan2(2 * xy, xx - yy)) + 90.0, 180.0)
    return np.where(solid, axis, np.nan), coherence


def stencil(pixels: DataFrame, names: tuple[str, ...], reach: int, tile: int, work: Callable[[np.ndarray], tuple[np.ndarray, ...]]) -> DataFrame:
    """(col, row, *names): `work` of the raster's values, a function of the pixels within `reach`, tile by tile.

    Pixels that are not there are unknown. Of pixels at one place the smallest value counts. Results that are unknown are null.
    """
    spark = prepare(pixels.sparkSession)
    known = pixels.where("col IS NOT NULL AND row IS NOT NULL").select(F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row"), F.col("z").cast("double").alias("z"))
    known = known.groupBy("col", "row").agg(F.min("z").alias("z"))
    schema = ", ".join(["col long", "row long", *(f"{n} double" for n in names)])
    bounds = known.agg(F.min("col"), F.min("row"), F.max("col"), F.max("row")).first()
    if bounds[0] is None:
        return spark.createDataFrame([], schema)
    c0, r0, c1, r1 = bounds

    def homes(c: str, low: int, high: int):
        at = lambda v: F.floor((v - low) / F.lit(tile)).cast("long")
        return F.sequence(at(F.greatest(F.col(c) - reach, F.lit(low))), at(F.least(F.col(c) + reach, F.lit(high))))

    def one(table: pa.Table) -> pa.Table:
        i, j = table.column("i")[0].as_py(), table.column("j")[0].as_py()
        left, low = max(c0, c0 + i * tile - reach), max(r0, r0 + j * tile - reach)
        right, high = min(c1, c0 + (i + 1) * tile - 1 + reach), min(r1, r0 + (j + 1) * tile - 1 + reach)
        grid, there = np.full((high - low + 1, right - left + 1), np.nan), np.zeros((high - low + 1, right - left + 1), bool)
        col, row = table.column("col").to_numpy(), table.column("row").to_numpy()
        grid[row - low, col - left] = table.column("z").to_numpy(zero_copy_only=False)
        there[row - low, col - left] = True
        out = work(grid)
        own = there.copy()
        own[:, : c0 + i * tile - left] = False
        own[:, c0 + (i + 1) * tile - left :] = False
        own[: r0 + j * tile - low] = False
        own[r0 + (j + 1) * tile - low :] = False
        at = np.nonzero(own)
        return pa.table([pa.array(at[1] + left, pa.int64()), pa.array(at[0] + low, pa.int64()), *(pa.array(o[at], pa.float64(), from_pandas=True) for o in out)], names=["col", "row", *names])

    posted = known.withColumn("i", F.explode(homes("col", c0, c1))).withColumn("j", F.explode(homes("row", r0, r1)))
    return posted.groupBy("i", "j").applyInArrow(one, schema)


def landform_grain(pixels: DataFrame, dx: float, dy: float, detrend: float = 15_000.0, smooth: float = 5_000.0, floor: float = 1e-8, least: float = 1e-6, tile: int = 512) -> DataFrame:
    """(col, row, axis, coherence) of the terrain at each pixel, dx and dy its size in the units of the heights.

    The regional slope, a mean over `detrend`, is taken off first; the tensor is smoothed over `smooth`. An axis has no sense: 45 is also
    225. Unknown (null, 0): no slope above `floor`, or a coherence below `least`; everywhere if a side of the raster has fewer than
    five pixels or less than three times the broad mean. Windows with a missing height are unknown in both.
    """
    r = pixels.agg(F.max("col") - F.min("col") + 1, F.max("row") - F.min("row") + 1).first()
    sides = min(r[0] or 0, r[1] or 0)
    odd = lambda length: max(3, int(round(length / max(dx, 1.0))) | 1)
    broad, fine = odd(detrend), max(3, min(odd(smooth), (sides - 1) | 1))
    if sides < 5 or broad > sides // 3:
        none = pixels.where("col IS NOT NULL AND row IS NOT NULL").select(F.col("col").cast("long").alias("col"), F.col("row").cast("long").alias("row")).distinct()
        return none.select("col", "row", F.lit(None).cast("double").alias("axis"), F.lit(0.0).alias("coherence"))
    found = stencil(pixels, ("axis", "coherence"), broad // 2 + 1 + fine // 2, max(tile, broad + fine), lambda z: structure(z, dx, dy, broad, fine, floor))
    return found.withColumn("axis", F.when(F.col("coherence") >= least, F.col("axis")))
