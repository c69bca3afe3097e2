"""Polygons with holes: area shares of square cells, dissolved domains and the contacts between them.

A polygon is the rows of its rings: (poly_id, ring, seq, x, y), ring 0 the shell and the others holes, each closed from its last
vertex to its first, in either direction. Nothing is gathered by polygon: all work is on sides.

The area of a polygon in a cell is an integral along its sides (Green): a side adds, over the part of its x range in the cell's column, the
height below it. So each side is cut at the borders of the grid; a piece gives its own cell the area below it, and the
cells under it a full strip of its width. Strips are a running sum down a column of one polygon, and cells that no side enters are
filled in from it. Rows grow with the pieces and with the cells covered, however many vertices there are.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.operators.spatial import line_distance, radius_join
from lodestar.session import cut, prepare


def sides(vertices: DataFrame, *carry: str) -> DataFrame:
    """(poly_id, ring, seq, x1, y1, x2, y2, turn, *carry): the sides of all rings that have an area.

    `turn` is 1 where the interior is below a side that runs to the right, else -1: a shell counts its inside, a hole takes it away.
    """
    ring = Window.partitionBy("poly_id", "ring")
    way = ring.orderBy("seq")
    nxt = lambda c: F.coalesce(F.lead(c).over(way), F.first(c).over(way.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing))).cast("double")
    s = vertices.select("poly_id", "ring", "seq", F.col("x").cast("double").alias("x1"), F.col("y").cast("double").alias("y1"), nxt("x").alias("x2"), nxt("y").alias("y2"), *carry)
    whole = F.sum((F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / 2).over(ring)
    s = s.withColumn("__a", whole).where("__a <> 0 AND (x1 <> x2 OR y1 <> y2)")
    return s.withColumn("turn", F.signum("__a") * F.when(F.col("ring") == 0, 1.0).otherwise(-1.0)).drop("__a")


def areas(vertices: DataFrame) -> DataFrame:
    """(poly_id, area): shells less holes."""
    part = F.col("turn") * (F.col("x2") - F.col("x1")) * (F.col("y1") + F.col("y2")) / 2
    return sides(vertices).groupBy("poly_id").agg(F.sum(part).alias("area"))


def overlay(vertices: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(poly_id, i, j, area) for each cell (i, j) of a grid from (x0, y0) of which a polygon covers a positive area.

    A polygon that only touches a cell's border covers none of it; what is below a billionth of a cell is rounding.
    """
    s = sides(vertices).where("x1 <> x2")
    s = s.select("poly_id", "turn", *((F.col(c) - o).alias(c) for c, o in (("x1", x0), ("y1", y0), ("x2", x0), ("y2", y0))))
    x1, y1, dx, dy = F.col("x1"), F.col("y1"), F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    row = lambda y: F.floor(y / F.lit(size))
    s = s.withColumn("i", F.explode(F.sequence(row(F.least("x1", "x2")), row(F.greatest("x1", "x2")))))
    a, b = (F.col("i") * size - x1) / dx, ((F.col("i") + 1) * size - x1) / dx
    s = s.withColumns({"ta": F.greatest(F.lit(0.0), F.least(a, b)), "tb": F.least(F.lit(1.0), F.greatest(a, b))}).where("tb > ta")
    ya, yb = y1 + F.col("ta") * dy, y1 + F.col("tb") * dy
    s = s.withColumn("j", F.explode(F.sequence(row(F.least(ya, yb)), row(F.greatest(ya, yb)))))
    # The part of the side within the row; a level side lies in one row only.
    c, d = F.try_divide(F.col("j") * size - y1, dy), F.try_divide((F.col("j") + 1) * size - y1, dy)
    ta = F.when(dy == 0, F.col("ta")).otherwise(F.greatest(F.col("ta"), F.least(c, d)))
    tb = F.when(dy == 0, F.col("tb")).otherwise(F.least(F.col("tb"), F.greatest(c, d)))
    s = s.withColumns({"ta": ta, "tb": tb}).where("tb > ta")
    width = F.col("turn") * (F.col("tb") - F.col("ta")) * dx
    under = y1 + (F.col("ta") + F.col("tb")) / 2 * dy - F.col("j") * size
    pieces = s.groupBy("poly_id", "i", "j").agg(F.sum(width).alias("width"), F.sum(width * under).alias("own"))
    down = Window.partitionBy("poly_id", "i").orderBy(F.col("j").desc())
    above = F.coalesce(F.sum("width").over(down.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    cells = pieces.withColumns({"above": above, "below": F.lead("j").over(down)})
    strips = F.col("above") + F.col("width")  # what covers the cells from here down to the next side
    # Without slack, rounding in a closed column would fill cells down to the next side with nothing.
    last = F.when(F.abs(strips) > size * 1e-9, F.coalesce(F.col("below") + 1, F.col("j"))).otherwise(F.col("j"))
    filled = cells.select("poly_id", "i", F.col("j").alias("__j"), "own", "above", strips.alias("__s"), F.explode(F.sequence(F.col("j"), last, F.lit(-1))).alias("j"))
    area = F.when(F.col("j") == F.col("__j"), F.col("own") + F.col("above") * size).otherwise(F.col("__s") * size)
    return filled.select("poly_id", "i", "j", area.alias("area")).where(F.col("area") > size * size * 1e-9)


def cover(cells: DataFrame, vertices: DataFrame, polygons: DataFrame, size: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(cell_id, columns of `polygons`, area) for each polygon that covers part of a cell (cell_id, cx, cy)."""
    place = cells.select("cell_id", F.floor((F.col("cx") - x0) / size).alias("i"), F.floor((F.col("cy") - y0) / size).alias("j"))
    return place.join(overlay(vertices, size, x0, y0), ["i", "j"]).join(polygons, "poly_id").drop("i", "j")


def largest_class(cells: DataFrame, covered: DataFrame, cls: str) -> DataFrame:
    """(cell_id, value_text, n_obs): class of the polygon that covers most of a cell (ties: smallest poly_id) and how many cover some.

    Ground without a polygon is null and 0; a polygon without a class is an unnamed one, null too.
    """
    best = covered.groupBy("cell_id").agg(F.max_by(F.col(cls), F.struct(F.col("area"), -F.col("poly_id"))).alias("value_text"), F.count("*").alias("n_obs"))
    out = cells.select("cell_id").join(best, "cell_id", "left")
    return out.select("cell_id", F.when(F.col("value_text") != "", F.col("value_text")).alias("value_text"), F.coalesce("n_obs", F.lit(0)).cast("long").alias("n_obs"))


def host(cells: DataFrame, covered: DataFrame, cls: str, words: list[str], under_cover: str | None = None) -> DataFrame:
    """1 where the largest class names one of `words`; 0 where another is mapped and the cell is not `under_cover`; else null."""
    best = largest_class(cells, covered, cls)
    named = F.lit(False)
    for w in words:
        named = named | F.coalesce(F.lower("value_text").contains(w), F.lit(False))
    hidden = F.coalesce(F.col(under_cover), F.lit(False)) if under_cover else F.lit(False)
    value = F.when(named & (F.col("n_obs") > 0), 1.0).when((F.col("n_obs") > 0) & ~hidden, 0.0)
    return cells.select("cell_id", *([under_cover] if under_cover else [])).join(best, "cell_id").select("cell_id", value.alias("value"), "n_obs")


def unit_shares(covered: DataFrame, cls: str, size: float) -> DataFrame:
    """(cell_id, unit, share, rank): share of a cell that each class covers, largest first, then by name."""
    share = covered.where(F.col(cls).isNotNull()).groupBy("cell_id", F.col(cls).alias("unit")).agg((F.sum("area") / (size * size)).alias("share"))
    order = Window.partitionBy("cell_id").orderBy(F.round("share", 9).desc(), "unit")
    return share.withColumn("rank", F.row_number().over(order))


def character(vertices: DataFrame, polygons: DataFrame, domain: str, group: str) -> DataFrame:
    """(domain, group, share): share of a domain's mapped area by group."""
    a = areas(vertices).join(polygons, "poly_id").groupBy(domain, group).agg(F.sum("area").alias("area"))
    return a.select(F.col(domain).alias("domain"), F.col(group).alias("group"), (F.col("area") / F.sum("area").over(Window.partitionBy(domain))).alias("share"))


def outline(vertices: DataFrame, domain: str) -> DataFrame:
    """(domain, x1, y1, x2, y2): the sides of each domain once its polygons are dissolved.

    A side that two polygons of a domain share is inside it and goes; ends are ordered so that both directions are one side.
    """
    s = sides(vertices, domain).where(F.col(domain).isNotNull() & (F.col(domain) != ""))
    swap = F.struct("x1", "y1") > F.struct("x2", "y2")
    ends = {c: F.when(swap, F.col(d)).otherwise(F.col(c)) for c, d in (("x1", "x2"), ("y1", "y2"), ("x2", "x1"), ("y2", "y1"))}
    s = s.select(F.col(domain).alias("domain"), *(v.alias(k) for k, v in ends.items()))
    return s.groupBy("domain", "x1", "y1", "x2", "y2").agg(F.count("*").alias("n")).where("n % 2 = 1").drop("n")


def _stay(a: list[np.ndarray], b: list[np.ndarray], r: float) -> tuple[np.ndarray, np.ndarray]:
    """Ranges of the parameter of segments `a` within the distance `r` of segments `b` (first > last: none).

    The points within `r` of a segment are a convex set of a rectangle and two discs, so the range is from the least to the
    greatest of the three ranges.
    """
    ax, ay, bx, by = a[2] - a[0], a[3] - a[1], b[2] - b[0], b[3] - b[1]
    n, m = np.sqrt(bx * bx + by * by), ax * ax + ay * ay
    far, ox, oy = 2.0, a[0] - b[0], a[1] - b[1]

    def between(start: np.ndarray, step: np.ndarray, low: float | np.ndarray, high: float | np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        inside = (start >= low) & (start <= high)
        with np.errstate(divide="ignore", invalid="ignore"):
            p, q = (low - start) / step, (high - start) / step
        return np.where(step != 0, np.minimum(p, q), np.where(inside, 0.0, far)), np.where(step != 0, np.maximum(p, q), np.where(inside, 1.0, -far))

    along = between((ox * bx + oy * by) / n, (ax * bx + ay * by) / n, 0.0, n)
    across = between((oy * bx - ox * by) / n, (ay * bx - ax * by) / n, -r, r)
    ranges = [(np.maximum(0.0, np.maximum(along[0], across[0])), np.minimum(1.0, np.minimum(along[1], across[1])))]
    for px, py in ((b[0], b[1]), (b[2], b[3])):
        dx, dy = a[0] - px, a[1] - py
        half, d = (dx * ax + dy * ay) / m, dx * dx + dy * dy - r * r
        root = half * half - d / m
        s = np.sqrt(np.maximum(root, 0.0))
        ranges.append((np.where(root >= 0, np.maximum(0.0, -half - s), far), np.where(root >= 0, np.minimum(1.0, -half + s), -far)))
    first, last = np.full(len(m), far), np.full(len(m), -far)
    for p, q in ranges:
        first, last = np.where(p <= q, np.minimum(first, p), first), np.where(p <= q, np.maximum(last, q), last)
    return first, last


def contacts(outlines: DataFrame, tolerance: float, size: float) -> DataFrame:
    """(domain, other, x1, y1, x2, y2): the pieces of a domain's outline that are within twice `tolerance` of another domain's.

    This is where the two, both grown by the tolerance, meet: gaps and overlaps that digitising leaves along a contact are bridged.
    Sides are posted to the square bins of their boxes grown by the reach, and a pair is tested in one bin only, if its boxes come that near.
    The geometry is numpy on batches: as column expressions its generated code does not fit the driver.
    """
    r = 2.0 * tolerance
    outlines = cut(outlines, "outline")
    prepare(outlines.sparkSession)
    low, high = (lambda a, b: F.floor((F.least(a, b) - r) / size)), (lambda a, b: F.floor((F.greatest(a, b) + r) / size))
    posted = outlines.withColumns({"i0": low("x1", "x2"), "j0": low("y1", "y2")})
    posted = posted.withColumn("i", F.explode(F.sequence("i0", high("x1", "x2")))).withColumn("j", F.explode(F.sequence("j0", high("y1", "y2"))))
    p, q = posted.alias("p"), posted.alias("q")
    pairs = p.join(q, (F.col("p.i") == F.col("q.i")) & (F.col("p.j") == F.col("q.j")) & (F.col("p.domain") != F.col("q.domain")))
    pairs = pairs.where((F.col("p.i") == F.greatest("p.i0", "q.i0")) & (F.col("p.j") == F.greatest("p.j0", "q.j0")))
    for u, v in (("x1", "x2"), ("y1", "y2")):
        for k, o in ("pq", "qp"):
            pairs = pairs.where(F.least(f"{k}.{u}", f"{k}.{v}") - F.greatest(f"{o}.{u}", f"{o}.{v}") <= 2 * r)
    ends = ("x1", "y1", "x2", "y2")
    pairs = pairs.select(F.col("p.domain").alias("domain"), F.col("q.domain").alias("other"), *(F.col(f"{k}.{c}").alias(f"{k}{c}") for k in "pq" for c in ends))

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            v = [batch.column(k).to_numpy(zero_copy_only=False) for k in range(2, 10)]
            a = v[:4]
            t0, t1 = _stay(a, v[4:], r)
            at = [u + t * (w - u) for t in (t0, t1) for u, w in ((a[0], a[2]), (a[1], a[3]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *map(pa.array, at)], names=["domain", "other", *ends]).filter(pa.array(t1 > t0))

    kind = outlines.schema["domain"].dataType.simpleString()
    return pairs.mapInArrow(pieces, f"domain {kind}, other {kind}, x1 double, y1 double, x2 double, y2 double")


def boundary_distance(cells: DataFrame, vertices: DataFrame, domain: str, tolerance: float, size: float) -> DataFrame:
    """(cell_id, value): distance of each cell's centre to the nearest contact of two domains; null if no two domains meet."""
    lines = cut(contacts(outline(vertices, domain), tolerance, size), "contacts")
    return line_distance(cells, lines)


def label_tiers(cells: DataFrame, deposits: DataFrame, size: float, occurrences: DataFrame, radius: float, x0: float = 0.0, y0: float = 0.0) -> DataFrame:
    """(cell_id, tier): deposit where a deposit polygon covers part of the cell, else occurrence where one lies within the radius, else unlabelled."""
    place = cells.select("cell_id", F.floor((F.col("cx") - x0) / size).alias("i"), F.floor((F.col("cy") - y0) / size).alias("j"))
    first = place.join(overlay(deposits, size, x0, y0).select("i", "j").distinct(), ["i", "j"]).select("cell_id", F.lit(2).alias("t"))
    second = radius_join(cells.select("cell_id", "cx", "cy"), occurrences, radius).select("cell_id", F.lit(1).alias("t"))
    best = first.unionByName(second).groupBy("cell_id").agg(F.max("t").alias("t"))
    tier = F.when(F.col("t") == 2, "deposit").when(F.col("t") == 1, "occurrence").otherwise("unlabelled")
    return cells.select("cell_id").join(best, "cell_id", "left").select("cell_id", tier.alias("tier"))
