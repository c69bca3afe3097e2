"""Does the text alone give the label away? Terms weighted by rarity, a logistic fit scored out of fold, and the terms that carry it."""

from __future__ import annotations

from collections import deque
from collections.abc import Generator, Iterator
from types import SimpleNamespace

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import Broadcast
from pyspark.ml.linalg import DenseVector, SparseVector, VectorUDT
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestar.operators import ranking
from lodestar.session import cut, prepare

WORD = r"[a-zA-Z][a-zA-Z]+"
GAP, TERMS, STEPPING = 1e-6, 65536, 2_000_000  # share of the least loss at which a fit stops; terms of a range; weights of fits that step together


def term_weights(docs: DataFrame, id_: str, text: str, least: int = 2, most: float = 0.9) -> tuple[DataFrame, DataFrame]:
    """((id, term, weight), (term, documents)): 1 + ln of a term's count, times ln((1 + n) / (1 + documents)) + 1, rows of length 1.

    Terms are runs of two Latin letters or more between word borders, in lower case; those in fewer than `least` documents or in more than the share `most`
    are left out. Counts are summed map-side; a common term is one row of the vocabulary, not a list.
    """
    n = docs.count()
    words = F.regexp_extract_all(F.coalesce(F.col(text), F.lit("")), F.lit(rf"(?U)\b{WORD}\b"), F.lit(0))
    tf = docs.select(F.col(id_).alias("id"), F.explode(F.transform(words, F.lower)).alias("term")).groupBy("id", "term").agg(F.count("*").alias("tf"))
    tf = cut(tf, "terms")
    vocabulary = cut(tf.groupBy("term").agg(F.count("*").alias("documents")).where((F.col("documents") >= least) & (F.col("documents") <= most * n)), "vocabulary")
    weighed = tf.join(vocabulary, "term").select("id", "term", ((1 + F.log("tf")) * (F.log((1 + n) / (1 + F.col("documents"))) + 1)).alias("w"))
    length = weighed.groupBy("id").agg(F.sqrt(F.sum(F.pow("w", 2))).alias("l"))
    return weighed.join(length, "id").select("id", "term", (F.col("w") / F.col("l")).alias("weight")), vocabulary


def vectors(docs: DataFrame, id_: str, text: str, bound: int = 4_000_000) -> tuple[DataFrame, DataFrame, int]:
    """((id, features), (term, place), size). A fit keeps a number for each term on the driver, so a vocabulary beyond `bound` is refused."""
    weights, vocabulary = term_weights(docs, id_, text)
    size = vocabulary.count()
    if size > bound:
        raise ValueError(f"{size} terms are more than {bound}: raise the least number of documents or the bound")
    placed = cut(ranking.places(vocabulary, "term", "place").select("term", (F.col("place") - 1).cast("int").alias("place")), "term-places")

    @F.udf(VectorUDT())
    def sparse(pairs):
        return SparseVector(size, [p[0] for p in pairs], [p[1] for p in pairs])

    prepare(docs.sparkSession)
    rows = weights.join(placed, "term").groupBy("id").agg(F.sort_array(F.collect_list(F.struct("place", "weight"))).alias("v"))
    none = F.array().cast("array<struct<place:int,weight:double>>")
    every = docs.select(F.col(id_).alias("id")).join(rows, "id", "left").withColumn("v", F.coalesce("v", none))
    return every.select("id", sparse("v").alias("features")), placed, size


def _batch(b: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The row, the place and the value of each number of a batch that is not 0."""
    row = np.repeat(np.arange(b.num_rows), pc.list_value_length(b.column("places")).to_numpy(zero_copy_only=False))
    return row, b.column("places").flatten().to_numpy(zero_copy_only=False), b.column("values").flatten().to_numpy(zero_copy_only=False)


def _margins(batch: tuple, n: int, w: np.ndarray) -> np.ndarray:
    row, place, value = batch
    return np.bincount(row, value * w[place], minlength=n) + w[-1]


def _descent(w: np.ndarray, gap: float, held: float, most: int = 300, memory: int = 10) -> Generator[np.ndarray, tuple[float, np.ndarray], np.ndarray]:
    """Limited-memory quasi-Newton steps: yields points, is sent (loss, gradient) there, and returns a point whose loss is proven to be within
    a share `gap` of the least, as the loss is at least as curved as `held` (the intercept apart)."""
    loss, g = yield w
    past: deque[tuple[np.ndarray, np.ndarray]] = deque(maxlen=memory)
    for _ in range(most):
        if g @ g <= 2 * held * gap * loss:
            break
        d, used = -g, []
        for s, y in reversed(past):
            used.append((s @ d) / (s @ y))
            d = d - used[-1] * y
        if past:
            d = d * ((past[-1][0] @ past[-1][1]) / (past[-1][1] @ past[-1][1]))
        for (s, y), a in zip(past, reversed(used), strict=True):
            d = d + (a - (y @ d) / (s @ y)) * s
        slope, step, low, high = g @ d, 1.0 if past else 1 / np.sqrt(g @ g), 0.0, np.inf
        for _ in range(40):
            there, new = yield w + step * d
            if there > loss + 1e-4 * step * slope:
                high = step
            elif new @ d < 0.9 * slope:
                low = step
            else:
                break
            step = (low + high) / 2 if high < np.inf else 2 * low
        else:
            break  # no step is better in double precision
        past.append((step * d, new - g))
        w, loss, g = w + step * d, there, new
    return w


def _fits(rows: DataFrame, c: float, held: list) -> list[SimpleNamespace | None]:
    """A logistic fit on all rows but those of each held fold (None: on all): the classes brought to the same weight, the square of the
    weights held down, strength `c` for each row; None where there is one class only.

    Fits ask for their gradients in the same pass, as many as keep the driver's weights bounded. These are summed in tasks and by ranges of terms, so that
    the driver is sent one number of four bytes for a term and a fit, however many tasks there are.
    """
    spark = prepare(rows.sparkSession)
    rows = rows if "fold" in rows.columns else rows.withColumn("fold", F.lit(None).cast("int"))
    counts = rows.groupBy("fold").agg(F.count("*").alias("n"), F.sum("label").alias("pos")).collect()  # folds are few
    shape = rows.select(F.unwrap_udt("features").alias("v")).select(F.coalesce(F.col("v.size"), F.size("v.values"))).first()
    size, state, waiting, done = shape[0] if shape else 0, {}, deque(), [None] * len(held)
    taken = [[h is None or r.fold not in (None, h) for r in counts] for h in held]
    sums = [(sum(r.n for r, t in zip(counts, told, strict=True) if t), sum(r.pos for r, t in zip(counts, told, strict=True) if t)) for told in taken]
    for k, (n, pos) in enumerate(sums):
        if pos and pos < n:
            waiting.append((k, 1 / (c * n)))
    folds = {r.fold: i for i, r in enumerate(counts)}
    data = _sparse(rows).select(F.col("label").cast("double").alias("label"), _index(folds).alias("at"), "places", "values")

    def gradients(points: Broadcast) -> DataFrame:
        def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            total = {k: [0.0, np.zeros(size + 1)] for k in points.value}
            for b in batches:
                batch, y, at = _batch(b), b.column("label").to_numpy(), b.column("at").to_numpy()
                row, place, value = batch
                for k, w in points.value.items():
                    n, pos = sums[k]
                    use = np.where(y == 1, n / (2.0 * pos), n / (2.0 * (n - pos))) / n * np.array(taken[k])[at]
                    m = _margins(batch, b.num_rows, w)
                    off = use * (1 / (1 + np.exp(-np.clip(m, -700, 700))) - y)
                    total[k][0] += float(use @ (np.logaddexp(0, m) - y * m))
                    total[k][1][:-1] += np.bincount(place, value * off[row], minlength=size)
                    total[k][1][-1] += off.sum()
            out = [(k, a // TERMS, loss if a == 0 else 0.0, g[a : a + TERMS].tobytes()) for k, (loss, g) in total.items() for a in range(0, size + 1, TERMS)]
            yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(zip(*out, strict=True), (pa.int32(), pa.int32(), pa.float64(), pa.binary()), strict=True)], names=["fit", "part", "loss", "g"])

        def add(t: pa.Table) -> pa.Table:
            g = sum(np.frombuffer(x.as_buffer()) for x in t.column("g")).astype(np.float32)
            return pa.table({"fit": t.column("fit")[:1], "part": t.column("part")[:1], "loss": [pc.sum(t.column("loss")).as_py()], "g": [g.tobytes()]})

        made = "fit int, part int, loss double, g binary"
        return data.mapInArrow(each, made).groupBy("fit", "part").applyInArrow(add, made)

    while state or waiting:
        while waiting and len(state) < max(1, STEPPING // (size + 1)):
            k, ridge = waiting.popleft()
            steps = _descent(np.zeros(size + 1), GAP, ridge)
            state[k] = steps, next(steps)
        points = spark.sparkContext.broadcast({k: w for k, (_, w) in state.items()})
        told: dict[int, list] = {k: [] for k in state}
        for r in gradients(points).collect():  # a number for each term and fit
            told[r.fit].append(r)
        points.unpersist()
        for k, (steps, w) in list(state.items()):
            parts, ridge = sorted(told[k], key=lambda r: r.part), 1 / (c * sums[k][0])
            g, loss = np.concatenate([np.frombuffer(r.g, np.float32) for r in parts]).astype(float), sum(r.loss for r in parts)
            g[:-1] += ridge * w[:-1]
            try:
                state[k] = steps, steps.send((loss + ridge / 2 * float(w[:-1] @ w[:-1]), g))
            except StopIteration as end:
                done[k] = SimpleNamespace(coefficients=DenseVector(end.value[:-1]), intercept=float(end.value[-1]))
                del state[k]
    return done


def _sparse(rows: DataFrame) -> DataFrame:
    v = F.unwrap_udt("features")
    rows = rows.withColumn("__v", v)
    dense = F.when(F.size("__v.values") > 0, F.sequence(F.lit(0), F.size("__v.values") - 1)).otherwise(F.array().cast("array<int>"))
    return rows.withColumn("places", F.coalesce("__v.indices", dense)).withColumn("values", F.col("__v.values")).drop("__v", "features")


def _index(folds: dict) -> Column:
    """The number of a row's fold; folds are few."""
    out = F.lit(-2)
    for fold, i in folds.items():
        out = F.when(F.col("fold").eqNullSafe(F.lit(fold)), i).otherwise(out)
    return out


def _fit(rows: DataFrame, c: float) -> SimpleNamespace | None:
    return _fits(rows, c, [None])[0]


def _scored(rows: DataFrame, fits: dict) -> DataFrame:
    """(id, label, probability) of each row by the fit without its fold, 0.5 where there is none."""
    spark = prepare(rows.sparkSession)
    folds = {fold: i for i, fold in enumerate(fits)}
    known = spark.sparkContext.broadcast({folds[f]: np.append(m.coefficients.toArray(), m.intercept) for f, m in fits.items() if m})

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, at, batch = np.full(b.num_rows, 0.5), b.column("at").to_numpy(), _batch(b)
            for i, w in known.value.items():
                mine = at == i
                if mine.any():
                    p[mine] = 1 / (1 + np.exp(-np.clip(_margins(batch, b.num_rows, w)[mine], -700, 700)))
            yield pa.RecordBatch.from_arrays([b.column("id"), b.column("label"), pa.array(p)], names=["id", "label", "probability"])

    data = _sparse(rows).select("id", F.col("label").cast("int").alias("label"), _index(folds).alias("at"), "places", "values")
    return data.mapInArrow(each, f"id {rows.schema['id'].dataType.simpleString()}, label int, probability double")


def out_of_fold(rows: DataFrame, c: float = 1.0) -> tuple[DataFrame, SimpleNamespace | None]:
    """((id, label, probability), fit) of rows (id, label, fold, features): each fold by a fit on the others, 0.5 where these have one class only, and the fit on all."""
    folds = [r[0] for r in rows.select("fold").where("fold IS NOT NULL").distinct().orderBy("fold").collect()]  # folds are few
    *each, whole = _fits(rows, c, [*folds, None])
    return _scored(rows.where("fold IS NOT NULL"), dict(zip(folds, each, strict=True))), whole


def audit(docs: DataFrame, id_: str, text: str, label: str, fold: str, terms: int = 25) -> tuple[DataFrame, DataFrame]:
    """(metrics, words): average precision and ROC area out of fold of a ranking by text, and of one by the length of the text; the words toward each class.

    metrics: (ranking, n, positives, average_precision, roc_auc); words: (toward, rank, term, weight) of a fit on all rows.
    """
    x, placed, _ = vectors(docs, id_, text)
    rows = x.join(docs.select(F.col(id_).alias("id"), F.col(label).cast("int").alias("label"), F.col(fold).alias("fold"), F.coalesce(F.length(text), F.lit(0)).alias("length")), "id")
    rows = cut(rows, "audit-rows")
    scored, model = out_of_fold(rows)
    scored = cut(scored, "audit-scores")
    by_text = ranking.ranking_metrics(scored, "probability", "label").select(F.lit("text").alias("ranking"), "*")
    by_length = ranking.ranking_metrics(rows, "length", "label").select(F.lit("length").alias("ranking"), "*")
    if model is None:
        words = rows.sparkSession.createDataFrame([], "toward string, rank int, term string, weight double")
    else:
        # The fit's weights are on the driver already; only the first few terms by weight are named.
        w = model.coefficients.toArray()
        order = w.argsort()
        picks = [("positive", k + 1, int(i), float(w[i])) for k, i in enumerate(order[::-1][:terms])] + [("negative", k + 1, int(i), float(w[i])) for k, i in enumerate(order[:terms])]
        named = rows.sparkSession.createDataFrame(picks, "toward string, rank int, place int, weight double")
        words = placed.join(F.broadcast(named), "place").select("toward", "rank", "term", "weight")
    return by_text.unionByName(by_length), words
