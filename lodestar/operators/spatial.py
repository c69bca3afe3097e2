"""Spatial joins and per-cell features on plane coordinates.

Points are (id, x, y, ...), cells (cell_id, cx, cy, ...), segments (line_id, x1, y1, x2, y2), rectangles (rect_id, x0, y0,
x1, y1). A radius join is an equality join on square bins as wide as the radius: each query looks in its own bin and the
eight around it, so rows are shuffled by bin and no pair beyond the neighbourhood is made. Rectangles and segments are
posted to the bins they cross.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestar.functions.geo import angle_between, axis, bearing
from lodestar.session import cut, prepare

BLOCK, PAIRS = 16384, 100_000_000  # segments of a bin that meet in one group; pairs of a task


def _bin(c: Column, size: float) -> Column:
    return F.floor(c / F.lit(size))


def radius_join(cells: DataFrame, points: DataFrame, radius: float) -> DataFrame:
    """Every (cell, point) with distance <= radius; `d2` is the squared distance."""
    around = F.sequence(F.lit(-1), F.lit(1))
    left = (
        cells.withColumn("__i", F.explode(F.transform(around, lambda k: _bin(F.col("cx"), radius) + k)))
        .withColumn("__j", F.explode(F.transform(around, lambda k: _bin(F.col("cy"), radius) + k)))
    )
    right = points.withColumns({"__i": _bin(F.col("x"), radius), "__j": _bin(F.col("y"), radius)})
    d2 = F.pow(F.col("x") - F.col("cx"), 2) + F.pow(F.col("y") - F.col("cy"), 2)
    return left.join(right, ["__i", "__j"]).withColumn("d2", d2).where(F.col("d2") <= radius * radius).drop("__i", "__j")


def _reach_of_all(cells: DataFrame, xs: list[tuple[DataFrame, str, str]]) -> float:
    """A distance that no pair exceeds: the diagonal of everything (four numbers a table reach the driver)."""
    low, high = [float("inf")] * 2, [float("-inf")] * 2
    for df, x, y in [(cells, "cx", "cy"), *xs]:
        r = df.agg(F.min(x), F.min(y), F.max(x), F.max(y)).first()
        if r[0] is not None:
            low, high = [min(low[k], float(r[k])) for k in (0, 1)], [max(high[k], float(r[k + 2])) for k in (0, 1)]
    return max(1.0, ((high[0] - low[0]) ** 2 + (high[1] - low[1]) ** 2) ** 0.5) if high[0] >= low[0] else 1.0


def knn_join(cells: DataFrame, points: DataFrame, k: int, reach: float) -> DataFrame:
    """The k nearest points of each cell, ties by point id; `rank` from 1; all points where there are fewer.

    The reach doubles for the cells that have fewer than k points so far; only those are joined again, until the reach
    spans everything.
    """
    order = Window.partitionBy("cell_id").orderBy("d2", "id")
    found, todo, most = None, cells, _reach_of_all(cells, [(points, "x", "y")])
    while True:
        near = radius_join(todo, points, reach).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
        near = cut(near, "knn")  # each round once: the next one needs to know which cells are done
        full = near.where(F.col("rank") == k).select("cell_id")
        part = near if reach >= most else near.join(full, "cell_id", "left_semi")
        found = part if found is None else found.unionByName(part)
        if reach >= most:
            return found
        todo = cut(todo.join(full, "cell_id", "left_anti"), "knn-left")
        if todo.isEmpty():
            return found
        reach *= 2


def point_stats(cells: DataFrame, points: DataFrame, value: str, radius: float) -> DataFrame:
    """count, max, mean, 90th percentile of `value` within the radius and the nearest distance.

    A count answers everywhere (0 where nothing is), the others are null there; n_obs counts known values.
    """
    near = radius_join(cells.select("cell_id", "cx", "cy"), points, radius)
    v = F.col(value).cast("double")
    stats = near.groupBy("cell_id").agg(
        F.count("*").alias("hits"), F.count(v).alias("n_obs"), F.max(v).alias("max_value"), F.avg(v).alias("mean_value"),
        F.percentile(v, F.lit(0.9)).alias("p90_value"), F.sqrt(F.min("d2")).alias("nearest"),
    )
    return cells.select("cell_id").join(stats, "cell_id", "left").na.fill(0, ["hits", "n_obs"])


def inverse_distance(cells: DataFrame, points: DataFrame, value: str, k: int, radius: float) -> DataFrame:
    """Weighted mean of the k nearest known values within the radius, weights 1 / max(d, 1)^2; an exact hit returns itself."""
    order = Window.partitionBy("cell_id").orderBy("d2", "id")
    near = radius_join(cells.select("cell_id", "cx", "cy"), points.where(F.col(value).isNotNull()), radius)
    near = near.withColumn("__r", F.row_number().over(order)).where(F.col("__r") <= k)
    v, w = F.col(value).cast("double"), 1 / F.greatest(F.col("d2"), F.lit(1.0))
    out = near.groupBy("cell_id").agg(
        F.when(F.min("d2") < 1, F.min_by(v, F.struct("d2", "id"))).otherwise(F.sum(v * w) / F.sum(w)).alias("value"),
        F.count("*").alias("n_obs"), F.sqrt(F.min("d2")).alias("nearest"),
    )
    return cells.select("cell_id").join(out, "cell_id", "left").na.fill(0, ["n_obs"])


def share_above(cells: DataFrame, points: DataFrame, value: str, quantile: float, radius: float, least: int = 3) -> DataFrame:
    """Share of the readings near a cell above the whole layer's own quantile; null under `least` readings."""
    bar = points.agg(F.percentile(F.col(value).cast("double"), F.lit(quantile)).alias("__bar"))
    near = radius_join(cells.select("cell_id", "cx", "cy"), points.where(F.col(value).isNotNull()), radius).crossJoin(F.broadcast(bar))
    out = near.groupBy("cell_id").agg(F.count("*").alias("n_obs"), F.avg((F.col(value) > F.col("__bar")).cast("double")).alias("__s"))
    out = out.select("cell_id", "n_obs", F.when(F.col("n_obs") >= least, F.col("__s")).alias("share"))
    return cells.select("cell_id").join(out, "cell_id", "left").na.fill(0, ["n_obs"])


def cone_max(cells: DataFrame, points: DataFrame, value: str, toward: float, half: float, inner: float, outer: float) -> DataFrame:
    """Largest reading at a distance in [inner, outer] whose bearing is within `half` degrees of `toward`."""
    near = radius_join(cells.select("cell_id", "cx", "cy"), points, outer).where(F.col("d2") >= inner * inner)
    turn = angle_between(bearing(F.col("x") - F.col("cx"), F.col("y") - F.col("cy")), F.lit(toward))
    out = near.where(turn <= half).groupBy("cell_id").agg(F.max(F.col(value).cast("double")).alias("max_value"), F.count("*").alias("n_obs"))
    return cells.select("cell_id").join(out, "cell_id", "left").na.fill(0, ["n_obs"])


def segments(points: DataFrame, line: str, order: str) -> DataFrame:
    """Consecutive points of a line as segments with midpoint, length and axis; the last point opens none."""
    w = Window.partitionBy(line).orderBy(order)
    s = points.select(F.col(line).alias("line_id"), F.col(order).alias("seq"), F.col("x").alias("x1"), F.col("y").alias("y1"), F.lead("x").over(w).alias("x2"), F.lead("y").over(w).alias("y2"))
    dx, dy = F.col("x2") - F.col("x1"), F.col("y2") - F.col("y1")
    return s.where("x2 is not null").withColumns({"length": F.sqrt(F.pow(dx, 2) + F.pow(dy, 2)), "axis": axis(dx, dy), "mx": (F.col("x1") + F.col("x2")) / 2, "my": (F.col("y1") + F.col("y2")) / 2})


def segment_distance2(px: Column, py: Column, x1: Column, y1: Column, x2: Column, y2: Column) -> Column:
    """Squared distance of a point to a segment."""
    dx, dy = x2 - x1, y2 - y1
    n = F.pow(dx, 2) + F.pow(dy, 2)
    t = F.when(n > 0, ((px - x1) * dx + (py - y1) * dy) / n).otherwise(F.lit(0.0))
    t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), t))
    return F.pow(px - x1 - t * dx, 2) + F.pow(py - y1 - t * dy, 2)


def along(lines: DataFrame, size: float) -> DataFrame:
    """Segments posted to the square bins (__i, __j) that they cross: as many as the length asks for, not the bounding box."""
    x1, y1, x2, y2 = (F.col(c).cast("double") for c in ("x1", "y1", "x2", "y2"))
    posted = lines.withColumn("__i", F.explode(F.sequence(F.floor(F.least(x1, x2) / size), F.floor(F.greatest(x1, x2) / size))))
    slope = F.try_divide(y2 - y1, x2 - x1)
    at = lambda edge: y1 + slope * (F.greatest(F.least(x1, x2), F.least(F.greatest(x1, x2), edge)) - x1)
    left, right = F.coalesce(at(F.col("__i") * size), y1), F.coalesce(at((F.col("__i") + 1) * size), y2)
    slack = size * 1e-9  # rounding must not lose a bin at whose border the segment passes
    low = F.greatest(F.least(left, right) - slack, F.least(y1, y2))
    high = F.least(F.greatest(left, right) + slack, F.greatest(y1, y2))
    return posted.withColumn("__j", F.explode(F.sequence(F.floor(F.least(low, high) / size), F.floor(F.greatest(low, high) / size))))


def line_distance(cells: DataFrame, lines: DataFrame, reach: float | None = None) -> DataFrame:
    """Distance of each cell centre to the nearest segment, null if there is none.

    Segments are posted to the bins they cross and a cell looks in its own and the eight around it: whatever is nearer than
    a bin's width is found. The width doubles for the cells without a segment that near, until it spans everything.
    """
    d2 = segment_distance2(F.col("cx"), F.col("cy"), F.col("x1"), F.col("y1"), F.col("x2"), F.col("y2"))
    todo = cells.select("cell_id", "cx", "cy")
    most = _reach_of_all(cells, [(lines, "x1", "y1"), (lines, "x2", "y2")])
    reach, found = reach or most / 64, None
    around = F.sequence(F.lit(-1), F.lit(1))
    while True:
        keyed = todo.withColumn("__i", F.explode(F.transform(around, lambda k: _bin(F.col("cx"), reach) + k)))
        keyed = keyed.withColumn("__j", F.explode(F.transform(around, lambda k: _bin(F.col("cy"), reach) + k)))
        near = keyed.join(along(lines.select("x1", "y1", "x2", "y2"), reach), ["__i", "__j"]).groupBy("cell_id").agg(F.sqrt(F.min(d2)).alias("value"))
        near = cut(near.where(F.col("value") <= reach), "line-distance")
        found = near if found is None else found.unionByName(near)
        if reach >= most:
            break
        todo = cut(todo.join(near, "cell_id", "left_anti"), "line-left")
        if todo.isEmpty():
            break
        reach *= 2
    return cells.select("cell_id").join(found, "cell_id", "left")


def clipped_length(x1: Column, y1: Column, x2: Column, y2: Column, x0: Column, y0: Column, xe: Column, ye: Column) -> Column:
    """Length of a segment inside the rectangle (x0, y0)-(xe, ye): the overlap of the two ranges of its parameter."""

    def span(a: Column, b: Column, low: Column, high: Column) -> tuple[Column, Column]:
        d = (b - a).cast("double")
        flat = (a >= low) & (a <= high)
        first = F.when(d == 0, F.when(flat, F.lit(0.0)).otherwise(F.lit(1.0))).otherwise(F.least((low - a) / d, (high - a) / d))
        last = F.when(d == 0, F.when(flat, F.lit(1.0)).otherwise(F.lit(0.0))).otherwise(F.greatest((low - a) / d, (high - a) / d))
        return first, last

    (a, b), (c, d) = span(x1, x2, x0, xe), span(y1, y2, y0, ye)
    part = F.least(F.lit(1.0), b, d) - F.greatest(F.lit(0.0), a, c)
    return F.greatest(F.lit(0.0), part) * F.sqrt(F.pow(x2 - x1, 2) + F.pow(y2 - y1, 2))


def line_density(cells: DataFrame, lines: DataFrame, size: float) -> DataFrame:
    """Length of line inside each square cell per unit of area, and the pieces that have length. 0 is an answer."""
    posted = along(lines, size)
    keyed = cells.withColumns({"__i": F.floor(F.col("cx") / F.lit(size)), "__j": F.floor(F.col("cy") / F.lit(size))})
    half = F.lit(size / 2)
    inside = clipped_length(*(F.col(c) for c in ("x1", "y1", "x2", "y2")), F.col("cx") - half, F.col("cy") - half, F.col("cx") + half, F.col("cy") + half)
    out = keyed.join(posted, ["__i", "__j"]).withColumn("__l", inside).groupBy("cell_id").agg(F.sum("__l").alias("__sum"), F.count_if(F.col("__l") > 0).alias("n_obs"))
    out = cells.select("cell_id").join(out, "cell_id", "left")
    return out.select("cell_id", (F.coalesce("__sum", F.lit(0.0)) / F.lit(size * size)).alias("value"), F.coalesce("n_obs", F.lit(0)).cast("long").alias("n_obs"))


def length_by_trend(cells: DataFrame, lines: DataFrame, radius: float) -> DataFrame:
    """Length of the segments with midpoint in the radius, by axis: NS (wraps at 0), NE, EW, NW."""
    mids = lines.select(F.col("mx").alias("x"), F.col("my").alias("y"), "length", "axis")
    near = radius_join(cells.select("cell_id", "cx", "cy"), mids, radius)
    sector = F.pmod(F.floor((F.col("axis") + 22.5) / 45), F.lit(4)).cast("int")
    names = ("ns", "ne", "ew", "nw")
    out = near.groupBy("cell_id").agg(*(F.sum(F.when(sector == k, F.col("length")).otherwise(0.0)).alias(n) for k, n in enumerate(names)))
    return cells.select("cell_id").join(out, "cell_id", "left").na.fill(0.0, list(names))


def crossings(lines: DataFrame, size: float, end: float = 1.0) -> DataFrame:
    """Points where segments of different lines cross properly, each once, rounded to whole units.

    A crossing within `end` of an end of either segment is a touch and left out. Segments meet in the bins that both cross, and
    a pair counts in the bin of its crossing only; sides are told by cross products. A bin is cut into blocks of its segments, so a group
    holds two blocks at most, tests their pairs in numpy and gives each point once.
    """
    spark = prepare(lines.sparkSession)
    ends = [F.col(c).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")]
    s = cut(along(lines.select(F.col("line_id").alias("l"), F.xxhash64("line_id", "seq").alias("__h"), *ends).where("l IS NOT NULL"), size), "postings")
    sizes = cut(s.groupBy("__i", "__j").agg(F.count("*").alias("n")), "bins")
    pairs = sizes.agg(F.sum(F.pow("n", 2))).first()[0] or 0
    full = sizes.where(F.col("n") > BLOCK).select("__i", "__j", F.ceil(F.col("n") / BLOCK).cast("int").alias("blocks"))  # one row for BLOCK postings at most
    s = s.join(F.broadcast(full), ["__i", "__j"], "left").na.fill(1, ["blocks"])
    s = s.withColumn("own", F.pmod("__h", F.col("blocks").cast("long")).cast("int")).withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    s = s.select("__i", "__j", F.least("own", "with").alias("__a"), F.greatest("own", "with").alias("__b"), "own", "l", "x1", "y1", "x2", "y2")

    def meet(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
        i, j, a, b = (k.as_py() for k in key)
        line = pc.rank(rows.column("l"), tiebreaker="dense").to_numpy().astype(np.int64)
        order = np.argsort(line, kind="stable")
        line, own, at = line[order], rows.column("own").to_numpy()[order], np.stack([rows.column(c).to_numpy()[order] for c in ("x1", "y1", "x2", "y2")])
        blocks = [(line, at)] if a == b else [(line[own == k], at[:, own == k]) for k in (a, b)]
        found, seen = [], np.empty((0, 2), np.int64)
        for p, q in [(0, 0)] if a == b else [(0, 1), (1, 0)]:
            for x, y in _crossed(*blocks[p], *blocks[q], (i * size, j * size), size, end):
                found.append(_once(x, y))
                if sum(map(len, found)) > 1 << 20:
                    seen = _once(*np.concatenate([seen, *found]).T)
                    found = []
        seen = _once(*np.concatenate([seen, *found]).T)
        return pa.table([pa.array(seen[:, 0]), pa.array(seen[:, 1])], names=["x", "y"])

    keys = ["__i", "__j", "__a", "__b"]
    tasks = int(max(64, 4 * spark.sparkContext.defaultParallelism, min(10_000, pairs // PAIRS)))  # given, else few bytes would be few tasks
    return s.repartition(tasks, *keys).groupBy(*keys).applyInArrow(meet, "x long, y long").distinct()


def _once(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distinct points, a row each."""
    if not len(x):
        return np.empty((0, 2), np.int64)
    low, wide = y.min(), y.max() - y.min() + 1
    key = np.unique((x - x.min()) * wide + (y - low))
    return np.stack([key // wide + x.min(), key % wide + low], axis=1)


def _crossed(lp: np.ndarray, p: np.ndarray, lq: np.ndarray, q: np.ndarray, corner: tuple[float, float], size: float, end: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rounded crossings in a bin of segments `p` (x1, y1, x2, y2) with those of `q` whose line is greater; both are ordered by line."""
    side = lambda o, t, e: (o[2] - o[0]) * (t[e + 1] - o[1]) - (o[3] - o[1]) * (t[e] - o[0])
    step, slack = max(1, (1 << 18) // max(1, len(lq))), size * 1e-9  # a border's points may be rounded off their bin
    for k in range(0, len(lp), step):
        first = np.searchsorted(lq, lp[k], "right")
        if first == len(lq):
            return
        u, v = p[:, k : k + step, None], q[:, None, first:]
        c, d = side(v, u, 0), side(v, u, 2)
        apart = ((c < 0) & (d > 0)) | ((c > 0) & (d < 0))
        a, b = side(u, v, 0), side(u, v, 2)
        apart &= ((a < 0) & (b > 0)) | ((a > 0) & (b < 0))
        apart &= lp[k : k + step, None] < lq[None, first:]
        m, n = np.nonzero(apart)
        c, d, u, v = c[m, n], d[m, n], p[:, k + m], q[:, first + n]
        t = c / (c - d)
        x, y = u[0] + t * (u[2] - u[0]), u[1] + t * (u[3] - u[1])
        here = (x >= corner[0] - slack) & (x < corner[0] + size + slack) & (y >= corner[1] - slack) & (y < corner[1] + size + slack)
        for o in (u, v):
            for e in (0, 2):
                here &= (x - o[e]) ** 2 + (y - o[e + 1]) ** 2 > end * end
        yield np.floor(x[here] + 0.5).astype(np.int64), np.floor(y[here] + 0.5).astype(np.int64)


def overlap_area(ax0: Column, ay0: Column, ax1: Column, ay1: Column, bx0: Column, by0: Column, bx1: Column, by1: Column) -> Column:
    """Area two rectangles share; touching edges share none."""
    w, h = F.least(ax1, bx1) - F.greatest(ax0, bx0), F.least(ay1, by1) - F.greatest(ay0, by0)
    return F.greatest(w, F.lit(0)) * F.greatest(h, F.lit(0))


def rectangle_overlaps(cells: DataFrame, rects: DataFrame, size: float) -> DataFrame:
    """(cell_id, rect columns, area) for each rectangle that covers part of a square cell."""
    posted = rects
    for a, b, name in (("x0", "x1", "__i"), ("y0", "y1", "__j")):
        posted = posted.withColumn(name, F.explode(F.sequence(F.floor(F.col(a) / F.lit(size)), F.floor(F.col(b) / F.lit(size)))))
    keyed = cells.select("cell_id", "cx", "cy").withColumns({"__i": F.floor(F.col("cx") / F.lit(size)), "__j": F.floor(F.col("cy") / F.lit(size))})
    half = F.lit(size / 2)
    area = overlap_area(F.col("cx") - half, F.col("cy") - half, F.col("cx") + half, F.col("cy") + half, *(F.col(c) for c in ("x0", "y0", "x1", "y1")))
    return keyed.join(posted, ["__i", "__j"]).withColumn("area", area).where("area > 0").drop("__i", "__j", "cx", "cy")


def rectangle_class(cells: DataFrame, rects: DataFrame, size: float) -> DataFrame:
    """Class of the rectangle that covers most of the cell (ties: smallest rect_id) and how many cover some; null and 0 if none."""
    best = rectangle_overlaps(cells, rects, size).groupBy("cell_id").agg(F.max_by("cls", F.struct(F.col("area"), -F.col("rect_id"))).alias("cls"), F.count("*").alias("n_obs"))
    return cells.select("cell_id").join(best, "cell_id", "left").na.fill(0, ["n_obs"])


def grid(spark, x0: int, y0: int, columns: int, rows: int, size: int) -> DataFrame:
    """Square cells (cell_id 'CCCC_RRRR', col, row, cx, cy) from a corner."""
    c = spark.range(columns).select(F.col("id").cast("int").alias("col"))
    r = spark.range(rows).select(F.col("id").cast("int").alias("row"))
    cells = c.crossJoin(r)
    centre = lambda k, o: (F.lit(o) + F.col(k) * size + F.lit(size / 2)).cast("double")
    return cells.select(F.format_string("%04d_%04d", "col", "row").alias("cell_id"), "col", "row", centre("col", x0).alias("cx"), centre("row", y0).alias("cy"))


def zonal(pixels: DataFrame, x0: float, y0: float, size: float, value: str) -> DataFrame:
    """Mean, least, most, relief and count of pixel values by cell, the cell by arithmetic."""
    cell = F.format_string("%04d_%04d", F.floor((F.col("x") - x0) / size).cast("int"), F.floor((F.col("y") - y0) / size).cast("int"))
    v = F.col(value).cast("double")
    return pixels.where((F.col("x") >= x0) & (F.col("y") >= y0)).groupBy(cell.alias("cell_id")).agg(
        F.avg(v).alias("mean_value"), F.min(v).alias("min_value"), F.max(v).alias("max_value"), (F.max(v) - F.min(v)).alias("relief"), F.count(v).alias("n_obs")
    )


def year_near(cells: DataFrame, points: DataFrame, year: str, radius: float) -> DataFrame:
    """First and last known year within the radius, and how many records have one; the records without a year do not count."""
    near = radius_join(cells.select("cell_id", "cx", "cy"), points.where(F.col(year).isNotNull()), radius)
    out = near.groupBy("cell_id").agg(F.min(year).alias("first_year"), F.max(year).alias("last_year"), F.count("*").alias("n_obs"), F.sqrt(F.min("d2")).alias("nearest"))
    return cells.select("cell_id").join(out, "cell_id", "left").na.fill(0, ["n_obs"])


def flow_frame(cells: DataFrame, grain: str, coherence: str, least: float = 0.5, regional: float = 225.0) -> DataFrame:
    """(cell_id, bearing, own): the cell's own axis where it is coherent, else the mean axis of those, turned to the end nearer `regional`.

    `grain` is an angle clockwise from east, so the compass axis is 90 on.
    """
    axis_ = F.pmod(F.col(grain).cast("double") + 90.0, F.lit(180.0))
    rows = cells.select("cell_id", F.when(F.col(coherence) >= least, axis_).alias("axis"), F.when((F.col(coherence) >= least) & axis_.isNotNull(), F.col(coherence)).alias("w"))
    twice = F.radians(2 * F.col("axis"))
    mean = rows.agg(F.pmod(F.degrees(F.atan2(F.sum(F.col("w") * F.sin(twice)), F.sum(F.col("w") * F.cos(twice)))) / 2, F.lit(180.0)).alias("mean"))
    mean = mean.select(F.coalesce("mean", F.lit(regional % 180.0)).alias("mean"))
    a = F.coalesce("axis", "mean")
    off = lambda x: F.abs(F.pmod(x - regional + 180.0, F.lit(360.0)) - 180.0)
    return rows.crossJoin(F.broadcast(mean)).select("cell_id", F.when(off(a) <= off(a + 180.0), a).otherwise(a + 180.0).alias("bearing"), F.col("axis").isNotNull().alias("own"))


def overlap_count(cells: DataFrame, rects: DataFrame, size: float) -> DataFrame:
    """How many rectangles share area with the cell; none is an answer."""
    n = rectangle_overlaps(cells, rects, size).groupBy("cell_id").agg(F.count_distinct("rect_id").alias("value"))
    return cells.select("cell_id").join(n, "cell_id", "left").na.fill(0, ["value"])


def host_of(cells: DataFrame, rects: DataFrame, size: float, wanted: str, covered: str | None = None) -> DataFrame:
    """1 if the cell's largest class is `wanted`; 0 if it is mapped otherwise (and not `covered`); else unknown."""
    best = rectangle_class(cells.select("cell_id", "cx", "cy"), rects, size)
    hidden = F.coalesce(F.col(covered), F.lit(False)) if covered else F.lit(False)
    value = F.when(F.col("cls").contains(wanted), 1.0).when(F.col("cls").isNotNull() & ~hidden, 0.0)
    return cells.join(best, "cell_id").select("cell_id", value.alias("value"))


def edge_distance(cells: DataFrame, ring: DataFrame) -> DataFrame:
    """Distance to the nearest side of a polygon (x1, y1, x2, y2 by row): positive inside, negative outside.

    A centre is inside if a ray to the right crosses the sides an odd number of times; sides meet it in their bands of y only.
    """
    far = line_distance(cells, ring).withColumnRenamed("value", "far")
    size = F.greatest((F.max(F.greatest("y1", "y2")) - F.min(F.least("y1", "y2"))) / 256, F.lit(1e-9)).alias("band")
    band = ring.agg(size)
    sides = ring.crossJoin(F.broadcast(band)).withColumn("__j", F.explode(F.sequence(F.floor(F.least("y1", "y2") / F.col("band")), F.floor(F.greatest("y1", "y2") / F.col("band")))))
    rows = cells.select("cell_id", "cx", "cy").crossJoin(F.broadcast(band)).withColumn("__j", F.floor(F.col("cy") / F.col("band"))).drop("band")
    spans = (F.col("y1") > F.col("cy")) != (F.col("y2") > F.col("cy"))
    right = F.col("cx") < F.col("x1") + F.try_divide((F.col("cy") - F.col("y1")) * (F.col("x2") - F.col("x1")), (F.col("y2") - F.col("y1")).cast("double"))
    odd = rows.join(sides, "__j").where(spans & right).groupBy("cell_id").agg((F.count("*") % 2).alias("odd"))
    return far.join(odd, "cell_id", "left").select("cell_id", F.when(F.col("odd") == 1, F.col("far")).otherwise(-F.col("far")).alias("value"))


def nearest_pairs(left: DataFrame, right: DataFrame, reach: float) -> DataFrame:
    """(cell_id, gap): the smallest distance between a left and a right point (cell_id, x, y) of the same cell, none of which exceeds `reach`.

    Points of a cell meet in small square bins; bins double for the cells that have found no pair as near as a bin is wide.
    """
    a, b = left.select("cell_id", F.col("x").alias("ax"), F.col("y").alias("ay")).distinct(), right.select("cell_id", F.col("x").alias("bx"), F.col("y").alias("by")).distinct()
    a, b = cut(a, "left-points"), cut(b, "right-points")
    todo = cut(a.select("cell_id").distinct().join(b.select("cell_id").distinct(), "cell_id", "left_semi"), "pair-cells")
    size, found, around = reach / 32, None, F.sequence(F.lit(-1), F.lit(1))
    while True:
        here = a.join(todo, "cell_id", "left_semi").withColumn("__i", F.explode(F.transform(around, lambda k: _bin(F.col("ax"), size) + k)))
        here = here.withColumn("__j", F.explode(F.transform(around, lambda k: _bin(F.col("ay"), size) + k)))
        there = b.join(todo, "cell_id", "left_semi").withColumns({"__i": _bin(F.col("bx"), size), "__j": _bin(F.col("by"), size)})
        d2 = F.pow(F.col("ax") - F.col("bx"), 2) + F.pow(F.col("ay") - F.col("by"), 2)
        near = cut(here.join(there, ["cell_id", "__i", "__j"]).groupBy("cell_id").agg(F.sqrt(F.min(d2)).alias("gap")).where(F.col("gap") <= size), "nearest-pairs")
        found = near if found is None else found.unionByName(near)
        todo = cut(todo.join(near, "cell_id", "left_anti"), "pair-cells-left")
        if size > reach or todo.isEmpty():
            return found
        size *= 2


def layer_pairs(cells: DataFrame, left: DataFrame, right: DataFrame, radius: float, least: int = 3, footprint: float | None = None) -> DataFrame:
    """For each cell the state of two point layers within the radius and how near they come to one another there.

    A layer is known where it has `least` records, thin where it has fewer, absent where it has none. The pair is known where both have
    records; else absent if every side without one covers the cell (has a record within `footprint`, twice the radius if not given), and unknown if
    one does not. `gap` is the smallest distance between a record of one and of the other, both within the radius.
    """
    place = cells.select("cell_id", "cx", "cy")
    near, out = {}, cells.select("cell_id")
    for name, layer in (("a", left), ("b", right)):
        points = layer.select("id", "x", "y")
        near[name] = radius_join(place, points, radius).select("cell_id", "x", "y")
        covers = radius_join(place, points, footprint or 2 * radius).select("cell_id").distinct().withColumn(f"in_{name}", F.lit(True))
        out = out.join(near[name].groupBy("cell_id").agg(F.count("*").alias(f"n_{name}")), "cell_id", "left").join(covers, "cell_id", "left")
    out = out.join(nearest_pairs(near["a"], near["b"], 2 * radius), "cell_id", "left").na.fill(0, ["n_a", "n_b"]).na.fill(False, ["in_a", "in_b"])
    side = lambda n: F.when(n >= least, "known").when(n > 0, "thin").otherwise("absent")
    blank = ((F.col("n_a") == 0) & ~F.col("in_a")) | ((F.col("n_b") == 0) & ~F.col("in_b"))
    state = F.when((F.col("n_a") > 0) & (F.col("n_b") > 0), "known").when(blank, "unknown").otherwise("absent")
    return out.select("cell_id", side(F.col("n_a")).alias("state_a"), side(F.col("n_b")).alias("state_b"), state.alias("state"), "gap")
