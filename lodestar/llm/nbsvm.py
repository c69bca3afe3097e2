"""Quality classifier: naive Bayes support vectors.

Features are indicators of n-grams of 1 to 3 characters (case kept), of whether there are words at all, and of which eighth of
the words repeat the word before. They are hashed to `2 ** bits` buckets. Each is scaled by its class log-count ratio, the vector is set to
length 1, and a linear hinge-loss model is fitted by dual coordinate descent. A logistic curve on the margins of a
fifth of the sample, which the ratios and the model have not seen, turns margins into scores from 0 to 1. With under five
rows of a class in either part, the sample is not divided: all of it serves for both.

Fitting uses a sample of at most `sample` labelled rows, the first by a hash of the doc_id; that bound is why the ids can
be broadcast and one task can fit. Scoring reads every whole text and moves none.

Cases: a null text is empty and is scored like one (its only feature is that it is empty). A document with several labels has the
lowest. Labels that are null or not 0 or 1 are left out. With one class only (or no labels), every score is that
class's (1.0 without labels), so nothing is rejected for want of labels. Repeated rows are scored each; other columns pass.
"""

from __future__ import annotations

import operator
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, IntegerType, StructField, StructType

from lodestar.llm.common import split_of, strings
from lodestar.session import cut, prepare

_MIX = np.uint64(0x9E3779B97F4A7C15)


def features(text: str | None, bits: int) -> np.ndarray:
    """The sorted buckets of the n-grams that occur."""
    cp = np.frombuffer((text or "").encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
    b = np.uint64(21)
    two = cp[:-1] << b | cp[1:]
    three = two[:-1] << b | cp[2:]
    words = (text or "").split()
    again = sum(map(operator.eq, words, words[1:]))
    share = 0 if again == 0 else 1 + min(7, 8 * again // len(words))  # how much of the text repeats the word before
    own = np.array([(1 << 63) + share, (1 << 63) + 100 + min(len(words), 1)], np.uint64)
    codes = np.concatenate([cp, two, three, own])
    return np.unique((codes * _MIX) >> np.uint64(64 - bits)).astype(np.int64)


def descend(rows: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int, seed: int) -> tuple[np.ndarray, np.ndarray]:
    """(weights with the bias last, dual variables) of the hinge-loss model on unit rows ratio[buckets], by dual coordinate descent."""
    w = np.zeros(len(ratio) + 1)
    length = np.array([max(np.sqrt(ratio[r] @ ratio[r]), 1e-12) for r in rows])
    most = np.where(y > 0, cost * len(y) / (2 * max(1, (y > 0).sum())), cost * len(y) / (2 * max(1, (y < 0).sum())))
    norm = np.array([(ratio[r] / k) @ (ratio[r] / k) + 1 for r, k in zip(rows, length, strict=True)])
    alpha = np.zeros(len(rows))
    rng = np.random.default_rng(seed)
    for _ in range(epochs):
        moved = 0.0
        for i in rng.permutation(len(rows)):
            r = rows[i]
            v = ratio[r] / length[i]  # made again each time: kept, the values would be twice the rows
            slope = y[i] * (w[r] @ v + w[-1]) - 1
            new = min(max(alpha[i] - slope / norm[i], 0.0), most[i])
            step = (new - alpha[i]) * y[i]
            if step:
                w[r] += step * v
                w[-1] += step
                alpha[i] = new
                moved = max(moved, abs(step))
        if moved < 1e-3:
            break
    return w, alpha


def logistic(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of the curve that turns margins into probabilities; targets are smoothed."""
    up, down = (y > 0).sum(), (y < 0).sum()
    t = np.where(y > 0, (up + 1) / (up + 2), 1 / (down + 2))
    x = np.c_[margin, np.ones(len(margin))]
    b = np.array([1.0, 0.0])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        h = x.T @ (x * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
        step = np.linalg.solve(h, x.T @ (t - p))
        b += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(b[0]), float(b[1])


def margin(row: np.ndarray, ratio: np.ndarray, w: np.ndarray) -> float:
    v = ratio[row]
    return float(w[row] @ v / max(np.sqrt(v @ v), 1e-12) + w[-1])


def fit(docs: DataFrame, labels: DataFrame, sample: int = 8000, bits: int = 17, most: int = 32 << 20, cost: float = 1.0, epochs: int = 20, seed: int = 17) -> dict | None:
    """The model, or None if there is no labelled training text: ratio and weights by bucket, slope and intercept.

    Two documented bounds let one task fit: at most `sample` labelled ids, one row each (of an id's rows that with the least hash of its features), in order of
    a hash of the id; and of these the first whose features, `most` in all, make up four bytes each.
    """
    spark = prepare(docs.sparkSession)
    marks = labels.select(F.col("doc_id").cast("long").alias("__id"), F.col("quality").cast("int").alias("__y"))
    marks = marks.where(F.col("__id").isNotNull() & F.col("__y").isin(0, 1) & (split_of(F.col("__id")) != 2))
    marks = marks.groupBy("__id").agg(F.min("__y").alias("__y")).orderBy(F.xxhash64("__id", F.lit(seed)), "__id").limit(sample)
    marks = cut(marks, "nbsvm-labels")  # at most `sample` rows of 12 bytes: broadcast below
    texts = docs.select(F.col("doc_id").cast("long").alias("__id"), "text").join(F.broadcast(marks), "__id")

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = pa.array([features(t, bits).astype("<i4").tobytes() for t in strings(b.column("text"))], pa.binary())
            yield pa.RecordBatch.from_arrays([b.column("__id"), b.column("__y"), found], names=["id", "y", "x"])

    def learn(t: pa.Table) -> pa.Table:
        order = np.argsort(t.column("id").to_numpy(), kind="stable")  # an id is one row
        y = t.column("y").to_numpy()[order] * 2 - 1
        blobs = t.column("x").combine_chunks()
        rows = [np.frombuffer(blobs[int(i)].as_buffer(), "<i4") for i in order]
        size = 1 << bits
        part = np.random.default_rng(seed).random(len(y)) < 0.8
        few = min((part & (y > 0)).sum(), (part & (y < 0)).sum(), (~part & (y > 0)).sum(), (~part & (y < 0)).sum()) < 5
        part = np.ones(len(y), bool) if few else part
        up, down = np.ones(size), np.ones(size)
        for r, s, p in zip(rows, y, part, strict=True):
            if p:
                (up if s > 0 else down)[r] += 1
        ratio = np.log(up / up.sum()) - np.log(down / down.sum())
        if (y > 0).all() or (y < 0).all():
            w, slope, base = np.zeros(size + 1), 0.0, float(30 * y[0])
        else:
            w, _ = descend([r for r, p in zip(rows, part, strict=True) if p], y[part], ratio, cost, epochs, seed)
            rest = part if few else ~part
            slope, base = logistic(np.array([margin(r, ratio, w) for r, p in zip(rows, rest, strict=True) if p]), y[rest])
        used = np.flatnonzero((w[:-1] != 0) | (up + down > 2))
        bucket = np.r_[used, -1, -2, -3]
        return pa.table({"bucket": bucket, "ratio": np.r_[ratio[used], 0, 0, 0], "weight": np.r_[w[used], w[-1], slope, base]})

    own = texts.mapInArrow(extract, "id long, y int, x binary")
    own = cut(own.groupBy("id", "y").agg(F.min_by("x", F.struct(F.xxhash64("x"), "x")).alias("x")), "nbsvm-rows")
    size = Window.orderBy(F.xxhash64("id", F.lit(seed)), "id").rowsBetween(Window.unboundedPreceding, 0)  # `sample` rows of two numbers
    within = own.select("id", F.sum(F.length("x") / 4).over(size).alias("n")).where(F.col("n") <= most).select("id")
    one = own.join(F.broadcast(within), "id").groupBy(F.lit("sample")).applyInArrow(learn, "bucket long, ratio double, weight double")
    found = cut(one, "nbsvm-model").toArrow()
    if not found.num_rows:
        return None
    bucket, ratio, weight = (found.column(c).to_numpy() for c in ("bucket", "ratio", "weight"))
    out = {"bits": bits, "ratio": np.zeros(1 << bits), "weights": np.zeros((1 << bits) + 1)}
    own = bucket >= 0
    out["ratio"][bucket[own]], out["weights"][bucket[own]] = ratio[own], weight[own]
    out["weights"][-1], out["slope"], out["base"] = (float(weight[bucket == k][0]) for k in (-1, -2, -3))
    return out


def score(docs: DataFrame, model: dict | None, threshold: float = 0.7) -> DataFrame:
    """`docs` with score and predicted added (they win over columns of the same name)."""
    docs = docs.drop("score", "predicted")
    if model is None:
        return docs.withColumns({"score": F.lit(1.0), "predicted": F.lit(1)})
    prepare(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    names = docs.columns

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = shared.value
        for b in batches:
            found = [margin(features(t, m["bits"]), m["ratio"], m["weights"]) for t in strings(b.column("text"))]
            z = m["slope"] * np.array(found, np.float64) + m["base"]
            p = 1 / (1 + np.exp(-np.clip(z, -30, 30)))
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(p), pa.array((p >= threshold).astype(np.int32))], names=[*names, "score", "predicted"])

    added = [StructField("score", DoubleType()), StructField("predicted", IntegerType())]
    return docs.mapInArrow(each, StructType([*docs.schema.fields, *added]))
