"""Where a fitted model may be trusted: rows that lie as near to the training rows as these lie to one another.

Nearest neighbours in the standardised space of all features are exact. Equal rows are one point with a count. Points are dealt to
the cells of pivots drawn from the training points; a point first searches its own cell, which bounds its distance, and then only cells that the
triangle inequality does not rule out. Cells are cut into blocks, so a group holds two blocks at most, however many rows are alike.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.operators.ranking import running
from lodestar.session import cut, prepare

BLOCK, PIVOTS = 4096, 1024  # points of a block; pivots at most
ROUNDING = 1e-12  # share of the limit by which an equal distance may come out greater


def standardised(rows: DataFrame, features: list[str], train: str) -> DataFrame:
    """`rows` with `z`: the features less the training mean over the training deviation (1 where that is 0); null where a feature is unknown."""
    known = lambda k: F.when(~F.isnan(F.col(k).cast("double")), F.col(k).cast("double"))
    whole = F.lit(True)
    for k in features:
        whole = whole & known(k).isNotNull()
    part = rows.where(F.col(train) & whole).agg(*(F.avg(known(k)).alias(f"__m{i}") for i, k in enumerate(features)), *(F.stddev_pop(known(k)).alias(f"__s{i}") for i, k in enumerate(features)))
    z = F.array(*((known(k) - F.col(f"__m{i}")) / F.when(F.col(f"__s{i}") > 0, F.col(f"__s{i}")).otherwise(1.0) for i, k in enumerate(features)))
    return rows.crossJoin(F.broadcast(part)).withColumn("z", F.when(whole, z)).drop(*(f"__{c}{i}" for c in "ms" for i in range(len(features))))


def quantile(df: DataFrame, value: str, weight: str, q: float) -> float | None:
    """The exact quantile of values with whole weights, between two ranks in proportion; counted over distinct values in ranges, two rows reach the driver."""
    at = df.where(F.col(value).isNotNull()).groupBy(F.col(value).cast("double").alias("v")).agg(F.sum(weight).alias("n"))
    at = cut(running(at, "v", {"seen": "n"}), "quantile")
    total = at.agg(F.max("seen")).first()[0]
    if not total:
        return None
    place = q * (total - 1)
    low, high = int(np.floor(place)), int(np.ceil(place))
    pick = lambda k: at.where((F.col("seen") > k) & (F.col("seen") - F.col("n") <= k)).first()["v"]
    a, b = pick(low), pick(high)
    return a + (b - a) * (place - low)


def _far(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Distances of all rows of `a` to all rows of `b`, by differences: equal rows are at 0."""
    out = np.zeros((len(a), len(b)))
    for k in range(a.shape[1]):
        out += (a[:, k : k + 1] - b[None, :, k]) ** 2
    return np.sqrt(out)


def _matrix(col) -> np.ndarray:
    flat = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return flat.flatten().to_numpy(zero_copy_only=False).reshape(len(flat), -1)


def nearest_training(points: DataFrame) -> DataFrame:
    """(id, distance) of each point (id, z, train) to the nearest training point other than itself; null if there is none."""
    spark = prepare(points.sparkSession)
    points = cut(points.select("id", "z", "train"), "points")
    trained = points.where("train")
    n = trained.count()
    if not n:
        return points.select("id", F.lit(None).cast("double").alias("distance"))
    drawn = trained.orderBy(F.xxhash64("id"), "id").limit(min(PIVOTS, int(np.ceil(np.sqrt(n)))))
    pivots = spark.sparkContext.broadcast(np.array([r.z for r in drawn.select("z").collect()]))  # PIVOTS rows at most

    def assign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if not b.num_rows:
                continue
            z, home, far = _matrix(b.column(1)), np.empty(b.num_rows, np.int32), np.empty(b.num_rows)
            for k in range(0, len(z), 1024):
                d = _far(z[k : k + 1024], pivots.value)
                home[k : k + 1024] = d.argmin(axis=1)
                far[k : k + 1024] = d.min(axis=1)
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(home), pa.array(far)], names=["id", "z", "train", "home", "far"])

    kind = points.schema["id"].dataType.simpleString()
    placed = cut(points.mapInArrow(assign, f"id {kind}, z array<double>, train boolean, home int, far double"), "placed-points")
    cells = placed.where("train").groupBy("home").agg(F.max("far").alias("radius"), F.count("*").alias("n")).collect()  # a row for each pivot
    radius, size = {r.home: r.radius for r in cells}, {r.home: r.n for r in cells}
    blocks = F.create_map(*(x for h, k in size.items() for x in (F.lit(h), F.lit(-(-k // BLOCK)))))
    own = F.pmod(F.xxhash64("id"), blocks[F.col("home")].cast("long")).cast("int")
    held = placed.where("train").select(F.col("home").alias("cell"), own.alias("block"), F.col("id").alias("other"), F.col("z").alias("there"))

    def meet(posts: DataFrame) -> DataFrame:
        """(id, distance) over posts (id, z, cell): a cell's blocks by blocks of the points that search it."""
        counts = cut(posts.groupBy("cell").agg(F.count("*").alias("asking")), "asking")
        wide = F.broadcast(counts.select("cell", F.ceil(F.col("asking") / BLOCK).cast("int").alias("parts")))  # a row for each pivot
        asked = posts.join(wide, "cell").withColumn("part", F.pmod(F.xxhash64("id", F.lit(3)), F.col("parts").cast("long")).cast("int"))
        asked = asked.withColumn("block", F.explode(F.sequence(F.lit(0), blocks[F.col("cell")].cast("int") - 1))).select("cell", "block", "part", "id", "z")
        kept = held.join(wide, "cell").withColumn("part", F.explode(F.sequence(F.lit(0), F.col("parts") - 1))).select("cell", "block", "part", "other", "there")

        def search(key, left: pa.Table, right: pa.Table) -> pa.Table:
            a, b = _matrix(left.column("z")) if left.num_rows else np.empty((0, 1)), _matrix(right.column("there")) if right.num_rows else np.empty((0, 1))
            found = np.full(len(a), np.inf)
            if len(a) and len(b):
                mine = {v: k for k, v in enumerate(right.column("other").to_pylist())}
                same = np.array([mine.get(v, -1) for v in left.column("id").to_pylist()])
                for k in range(0, len(a), 512):
                    d = _far(a[k : k + 512], b)
                    own_at = same[k : k + 512]
                    rows = np.flatnonzero(own_at >= 0)
                    d[rows, own_at[rows]] = np.inf
                    found[k : k + 512] = d.min(axis=1)
            return pa.table([left.column("id"), pa.array(found)], names=["id", "distance"])

        met = asked.groupBy("cell", "block", "part").cogroup(kept.groupBy("cell", "block", "part")).applyInArrow(search, f"id {kind}, distance double")
        return met.groupBy("id").agg(F.min("distance").alias("distance"))

    first = cut(meet(placed.select("id", "z", F.col("home").alias("cell"))), "nearest-home")
    reach = placed.join(first, "id")

    def elsewhere(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The other cells that can hold a nearer point: their radius reaches closer than the bound."""
        out = np.array([radius.get(h, -np.inf) for h in range(len(pivots.value))])
        for b in batches:
            if not b.num_rows:
                continue
            z, home, bound = _matrix(b.column(1)), b.column(2).to_numpy(), b.column(3).to_numpy()
            for k in range(0, len(z), 1024):
                open_ = _far(z[k : k + 1024], pivots.value) - out[None, :] <= bound[k : k + 1024, None] * (1 + 1e-12) + 1e-12
                open_[np.arange(len(open_)), home[k : k + 1024]] = False
                at, cell = np.nonzero(open_)
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at + k)), b.column(1).take(pa.array(at + k)), pa.array(cell.astype(np.int32))], names=["id", "z", "cell"])

    posts = reach.select("id", "z", "home", "distance").mapInArrow(elsewhere, f"id {kind}, z array<double>, cell int")
    both = first.unionByName(meet(cut(posts, "searches"))).groupBy("id").agg(F.min("distance").alias("d"))
    return both.select("id", F.when(F.col("d") < float("inf"), F.col("d")).alias("distance"))


def area_of_applicability(rows: DataFrame, id_: str, features: list[str], train: str, share: float = 0.95, factor: float = 2.0) -> DataFrame:
    """(id, distance, threshold, applicable): distance to the nearest training row, and whether it is at most `factor` times the `share` quantile
    of the training rows' own distances.

    A training row's own distance is that to the nearest other training row (0 if another is equal); it is itself at 0 and so always
    applicable. Rows with an unknown feature are unknown in all three; without training rows all are. On a grid many distances equal the limit but for
    rounding, which changes with the order of the sums: they count as equal.
    """
    z = standardised(rows, features, train)
    z = cut(z.select(F.col(id_).alias("id"), "z", F.coalesce(F.col(train), F.lit(False)).alias("train")), "standardised")
    points = z.where("z IS NOT NULL").groupBy("z").agg(F.min("id").alias("point"), F.count_if("train").alias("n"))
    near = nearest_training(points.select(F.col("point").alias("id"), "z", (F.col("n") > 0).alias("train"))).withColumnRenamed("id", "point")
    near = cut(points.join(near, "point"), "nearest")
    own = near.where("n > 0").select(F.when(F.col("n") > 1, 0.0).otherwise(F.col("distance")).alias("own"), "n")
    bar = quantile(own, "own", "n", share)
    limit = F.lit(None if bar is None else bar * factor).cast("double")
    far = near.select("z", F.when(F.col("n") > 0, 0.0).otherwise(F.col("distance")).alias("distance"))
    out = z.select("id", "z").join(far, "z", "left")
    unknown = F.col("z").isNull() | F.col("distance").isNull()
    return out.select(F.col("id").alias(id_), "distance", F.when(~unknown, limit).alias("threshold"), F.when(~unknown, F.col("distance") <= limit * (1 + ROUNDING)).alias("applicable"))
