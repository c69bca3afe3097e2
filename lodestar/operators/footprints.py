"""Convex hulls of points by group, and hulls grown by a distance.

Every batch of points is reduced to its own hulls first, hulls are merged in salted parts and then by group: what is shuffled are
hull vertices, a handful for each batch and group, so a group that holds most points is no larger than any other.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.session import prepare


def hull(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Vertices of the hull against the clock from the leftmost (lowest of these), without points on its sides; one or two if all are in line."""
    points = np.unique(np.stack([x, y], axis=1), axis=0)
    if len(points) > 64:
        # What lies inside the quadrangle of four extreme points cannot be a vertex.
        s, d = points.sum(axis=1), points[:, 0] - points[:, 1]
        corners = points[[s.argmin(), d.argmax(), s.argmax(), d.argmin()]]
        inside = np.ones(len(points), bool)
        for a, b in zip(corners, np.roll(corners, -1, axis=0), strict=True):
            inside &= (b[0] - a[0]) * (points[:, 1] - a[1]) - (b[1] - a[1]) * (points[:, 0] - a[0]) > 0
        points = points[~inside]

    def chain(rows: list) -> list:
        out: list = []
        for p in rows:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) - (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]) <= 0:
                out.pop()
            out.append(p)
        return out[:-1]

    rows = points.tolist()
    return np.array(rows if len(rows) < 3 else chain(rows) + chain(rows[::-1])).reshape(-1, 2)


def grown(ring: np.ndarray, by: float, quarter: int = 8) -> np.ndarray:
    """The ring at a distance from a hull: each side moved out along its support line, corners rounded by arcs of `quarter` steps a quarter turn."""
    n, step = len(ring), math.pi / 2 / quarter
    if n == 1:
        turns = np.arange(4 * quarter) * step
        return ring[0] + by * np.stack([np.cos(turns), np.sin(turns)], axis=1)
    sides = np.roll(ring, -1, axis=0) - ring
    out_ = np.arctan2(-sides[:, 0], sides[:, 1])  # the direction out of each side
    rows = []
    for k in range(n):
        a, b = out_[k - 1], out_[k]
        turn = (b - a) % (2 * math.pi)
        arcs = max(1, math.ceil(turn / step - 1e-9))
        for t in a + turn * np.arange(arcs + 1) / arcs:
            rows.append((ring[k, 0] + by * math.cos(t), ring[k, 1] + by * math.sin(t)))
    return np.array(rows)


def _merge(df: DataFrame, keys: list[str], schema: str) -> DataFrame:
    def one(table: pa.Table) -> pa.Table:
        ring = hull(table.column("x").to_numpy(), table.column("y").to_numpy())
        first = table.slice(0, 1).select(keys)
        rows = pa.table([pa.array(first.column(k).to_pylist() * len(ring), first.column(k).type) for k in keys], names=keys)
        return rows.append_column("x", pa.array(ring[:, 0])).append_column("y", pa.array(ring[:, 1]))

    return df.groupBy(*keys).applyInArrow(one, schema)


def hulls(points: DataFrame, group: str, parts: int = 64) -> DataFrame:
    """(group, seq, x, y): the hull of each group's points (group, x, y), against the clock; points with an unknown coordinate are left out."""
    prepare(points.sparkSession)
    known = points.where("x IS NOT NULL AND y IS NOT NULL AND NOT isnan(x) AND NOT isnan(y)").select(F.col(group).alias("g"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    kind = known.schema["g"].dataType.simpleString()

    def reduce_(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            codes = b.column(0).dictionary_encode(null_encoding="encode")
            x, y, code = b.column(1).to_numpy(), b.column(2).to_numpy(), codes.indices.to_numpy()
            order = np.argsort(code, kind="stable")
            bounds = np.flatnonzero(np.r_[True, np.diff(code[order]) != 0, True]) if len(order) else np.zeros(1, int)
            rings = [(code[order[a]], hull(x[order[a:e]], y[order[a:e]])) for a, e in zip(bounds[:-1], bounds[1:], strict=True)]
            if rings:
                at = np.concatenate([np.full(len(r), c, np.int64) for c, r in rings])
                every = np.concatenate([r for _, r in rings])
                yield pa.RecordBatch.from_arrays([codes.dictionary.take(pa.array(at)), pa.array(every[:, 0]), pa.array(every[:, 1])], names=["g", "x", "y"])

    small = known.mapInArrow(reduce_, f"g {kind}, x double, y double")
    salted = small.withColumn("salt", F.pmod(F.xxhash64("x", "y"), F.lit(parts)).cast("int"))
    merged = _merge(_merge(salted, ["g", "salt"], f"g {kind}, salt int, x double, y double").select("g", "x", "y"), ["g"], f"g {kind}, x double, y double")
    # The order of a ring is kept by its angle from a point inside, against the clock from the leftmost vertex.
    rings = merged.groupBy("g").agg(F.collect_list(F.struct("x", "y")).alias("v"))
    return rings.select(F.col("g").alias(group), F.posexplode(_turned(F.col("v")))).select(group, F.col("pos").alias("seq"), "col.x", "col.y")


def _turned(v):
    """Vertices by angle around their mean, the leftmost (then lowest) first."""
    n = F.size(v)
    mx, my = F.aggregate(v, F.lit(0.0), lambda a, p: a + p.x) / n, F.aggregate(v, F.lit(0.0), lambda a, p: a + p.y) / n
    keyed = F.array_sort(F.transform(v, lambda p: F.struct(F.atan2(p.y - my, p.x - mx).alias("t"), p.x.alias("x"), p.y.alias("y"))))
    ring = F.transform(keyed, lambda p: F.struct(p.x.alias("x"), p.y.alias("y")))
    first = F.array_position(ring, F.array_min(ring)).cast("int")
    return F.concat(F.slice(ring, first, n), F.slice(ring, F.lit(1), first - 1))


def footprints(points: DataFrame, group: str, by: float, quarter: int = 8) -> DataFrame:
    """(group, seq, x, y): hulls() grown by a distance, corners rounded."""
    ring = hulls(points, group)
    kind = ring.schema[group].dataType.simpleString()

    def one(table: pa.Table) -> pa.Table:
        t = table.sort_by("seq")
        out = grown(np.stack([t.column("x").to_numpy(), t.column("y").to_numpy()], axis=1), by, quarter)
        return pa.table([pa.array(t.column(group).slice(0, 1).to_pylist() * len(out), t.schema.field(group).type), pa.array(np.arange(len(out), dtype=np.int32)), pa.array(out[:, 0]), pa.array(out[:, 1])], names=[group, "seq", "x", "y"])

    return ring.groupBy(group).applyInArrow(one, f"{group} {kind}, seq int, x double, y double")
