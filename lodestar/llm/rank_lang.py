"""Language identification by rank-order profiles.

A text is lower-cased, everything but letters becomes one space, and its n-grams of 1 to 3 characters are ranked by
frequency. A language's profile is the ranking of its n-grams over all training documents. The distance of a document
to a language is the sum, over the document's `top` most frequent n-grams, of how far the n-gram is out of place in the
profile (`top` if it is absent); the nearest language wins, the first by name on a tie.

score is 1 - distance / largest possible distance of the document: 0 if no n-gram is in the profile, 1 for the same ranks.

Profiles are counted over every training document: tasks merge counts of their own texts before one shuffle of n-gram
counts, and the rankings (languages x `top` rows) are all that reaches the driver.

Cases: a null text or one without letters is `und` with score 0; so is every text if nothing can be learned from. Very
long texts count whole. A row with a null doc_id is in the training part (split of the text ''). Repeated rows count
and are predicted each. Other columns are left out.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import split_of, strings
from lodestar.session import cut, prepare

_LETTER: np.ndarray | None = None


def _letters() -> np.ndarray:
    """Whether each code point is a letter, made once in each worker."""
    global _LETTER
    if _LETTER is None:
        _LETTER = np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000)
    return _LETTER


def ngrams(text: str | None) -> tuple[np.ndarray, np.ndarray]:
    """(codes, counts) of the n-grams; a code holds up to three code points of 21 bits. Empty without letters."""
    none = np.empty(0, np.int64)
    cp = np.frombuffer((text or "").lower().encode("utf-32-le", "surrogatepass"), "<u4").astype(np.int64)
    letter = _letters()[cp]
    if not letter.any():
        return none, none
    cp = np.where(letter, cp, 32)
    cp = np.r_[32, cp, 32]
    cp = cp[np.r_[True, (cp[1:] != 32) | (cp[:-1] != 32)]]
    two = cp[:-1] << 21 | cp[1:]
    codes = np.sort(np.concatenate([cp[cp != 32], two, two[:-1] << 21 | cp[2:]]))
    first = np.flatnonzero(np.r_[True, codes[1:] != codes[:-1]])
    return codes[first], np.diff(np.r_[first, len(codes)])


def ranked(codes: np.ndarray, counts: np.ndarray, top: int) -> np.ndarray:
    """The most frequent codes in order; ties by code."""
    if len(codes) > top:
        floor = np.partition(counts, len(counts) - top)[len(counts) - top]
        codes, counts = codes[counts >= floor], counts[counts >= floor]
    return codes[np.lexsort((codes, -counts))[:top]]


def profiles(docs: DataFrame, top: int) -> dict[str, np.ndarray]:
    """The ranked n-grams of each language, from rows (lang, text)."""

    def merged(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        codes, inverse = np.unique(np.concatenate([p[0] for p in parts]), return_inverse=True)
        counts = np.zeros(len(codes), np.int64)
        np.add.at(counts, inverse, np.concatenate([p[1] for p in parts]))
        return codes, counts

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, list] = {}
        waiting = 0
        for b in batches:
            for lang, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                found = ngrams(text)
                held.setdefault(lang, []).append(found)
                waiting += len(found[0])
                if waiting > 1_000_000:
                    held = {k: [merged(v)] for k, v in held.items()}
                    waiting = 0
        for lang, parts in held.items():
            codes, counts = merged(parts)
            for at in range(0, len(codes), 1 << 16):
                c = codes[at : at + (1 << 16)]
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(c)), pa.array(c), pa.array(counts[at : at + (1 << 16)])], names=["lang", "code", "n"])

    counts = docs.select("lang", "text").mapInArrow(count, "lang string, code long, n long").groupBy("lang", "code").agg(F.sum("n").alias("n"))
    rank = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "code"))
    rows = counts.withColumn("rank", rank).where(F.col("rank") <= top).select("lang", "code", "rank").collect()
    out: dict[str, np.ndarray] = {}
    for lang, code, r in rows:
        out.setdefault(lang, np.zeros(top, np.int64))[r - 1] = code
    sizes: dict[str, int] = {}
    for lang, _, r in rows:
        sizes[lang] = max(sizes.get(lang, 0), r)
    return {k: out[k][: sizes[k]] for k in sorted(out)}


def distance(doc: np.ndarray, order: np.ndarray, rank: np.ndarray, top: int) -> int:
    """Out-of-place distance; order are a profile's codes sorted, rank their places."""
    at = np.minimum(np.searchsorted(order, doc), len(order) - 1)
    off = np.where(order[at] == doc, np.abs(rank[at] - np.arange(len(doc))), top)
    return int(np.minimum(off, top).sum())


def predict(docs: DataFrame, learned: dict[str, np.ndarray], top: int) -> DataFrame:
    """(doc_id, lang_pred, score) from the text alone."""
    known = docs.sparkSession.sparkContext.broadcast([(lang, np.sort(p), np.argsort(p, kind="stable")) for lang, p in learned.items()])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            langs, scores = [], []
            for text in strings(b.column(1)):
                doc = ranked(*ngrams(text), top)
                if not len(doc) or not known.value:
                    langs.append("und")
                    scores.append(0.0)
                    continue
                far, lang = min((distance(doc, order, rank, top), lang) for lang, order, rank in known.value)
                langs.append(lang)
                scores.append(1 - far / (top * len(doc)))
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], names=["doc_id", "lang_pred", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, lang_pred string, score double")


def identify(docs: DataFrame, top: int = 400) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) for each row of `docs` (doc_id, text, lang)."""
    prepare(docs.sparkSession)
    train = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (split_of(F.col("doc_id")) != 2))
    out = predict(docs, profiles(train, top), top)
    return out.select("doc_id", (split_of(F.col("doc_id")) == 2).alias("held_out"), "lang_pred", "score")
