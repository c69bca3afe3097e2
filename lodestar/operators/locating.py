"""Where a value or a row of text stands among the words that a second reader found on a page.

Words are (pool, no, text, line, x0, y0, x1, y1): a pool is a page, or one row of it, `no` the order in it; boxes are shares of the
page. Values are (value_id, pool, value). A value's candidates are spans of up to six words of its own pool, found by its letters: the page's
letters are one string with the offsets of its words, in which the value, or for likeness pieces of it, are looked up in an index. So a value
meets neither other pages nor all spans of its own; the spans found are ranked by Spark. A group is one page with the values asked of it.

Only the second reader's words are folded, never the value. A page without words, a value without letters and a null value are not located.
"""

from __future__ import annotations

import unicodedata
from bisect import bisect_left, bisect_right
from collections.abc import Iterator
from itertools import accumulate

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import DoubleType, StructField, StructType

from lodestar.session import prepare

# What a reader may print for the sign on the right, the scores of the kinds of match, and the least scores.
FOLD = {
    "l": "1", "I": "1", "i": "1", "|": "1", "!": "1", "O": "0", "o": "0", "Q": "0", "D": "0", "°": "0", "º": "0", "S": "5", "s": "5", "B": "8",
    "Z": "2", "z": "2", "G": "6", "†": "+", "‡": "+", "t": "+", ",": ".", "·": ".", "•": ".", "'": "", "`": "",
}
EXACT, SEPARATORS, FOLDED, MERGED, LEAST, ROW_LEAST = 100.0, 99.0, 98.0, 90.0, 82.0, 40.0
WIDEST, TALLEST, APART, PAD, LONGEST = 0.60, 0.03, 0.012, 0.003, 6

NOWHERE = np.empty(0, np.int64)
_ONE = {chr(c): unicodedata.normalize("NFKC", chr(c)) for c in range(128, 0x10000) if not 0xD800 <= c < 0xE000}
_ONE = {c: k for c, k in _ONE.items() if k != c and len(k) == 1}
_MORE = {c: unicodedata.normalize("NFKC", c) for c in "ﬀﬁﬂﬃﬄﬅﬆ½¼¾№℡㎡㎞㎏…"}


def compatible(c: Column) -> Column:
    """Compatibility forms of single characters and common ligatures; marks are not composed."""
    for a, b in _MORE.items():
        c = F.replace(c, F.lit(a), F.lit(b))
    return F.translate(c, "".join(_ONE), "".join(_ONE.values()))


def norm(c: Column) -> Column:
    """One form of compatible characters, dashes, quotes and white space, without case; null is empty."""
    c = F.translate(compatible(F.coalesce(c, F.lit(""))), "‐‑‒–—―−⁃‘’“”", "--------''\"\"")
    return F.replace(F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " "))), F.lit("ß"), F.lit("ss"))


def squash(c: Column) -> Column:
    return F.replace(norm(c), F.lit(" "), F.lit(""))


def bare(c: Column) -> Column:
    """Letters a to z and digits alone."""
    return F.regexp_replace(norm(c), "[^0-9a-z]+", "")


def foldbare(c: Column) -> Column:
    """bare() once look-alikes are folded: for the second reader's words only."""
    gone = "".join(k for k, v in FOLD.items() if not v)
    kept = {k: v for k, v in FOLD.items() if v}
    return bare(F.translate(compatible(F.coalesce(c, F.lit(""))), "".join(kept) + gone, "".join(kept.values())))


def digits(c: Column) -> Column:
    return F.regexp_replace(norm(c), r"[^0-9]", "")


def digit_agreement(value: Column, read: Column) -> Column:
    """exact, confusable, mismatch, or na where the value has no digit: the value's digits in the reading."""
    want, got = digits(value), digits(read)
    folded = F.regexp_replace(foldbare(read), "[^0-9]", "")
    return F.when(want == "", "na").when(got == "", "mismatch").when(F.contains(got, want), "exact").when((folded != "") & F.contains(folded, want), "confusable").otherwise("mismatch")


def padded(box: Column) -> Column:
    low, high = (lambda c: F.round(F.greatest(F.lit(0.0), c - PAD), 5)), (lambda c: F.round(F.least(F.lit(1.0), c + PAD), 5))
    return F.struct(low(box.x0).alias("x0"), low(box.y0).alias("y0"), high(box.x1).alias("x1"), high(box.y1).alias("y1"))


def letter_bits(a: str) -> dict[str, int]:
    """The places of each letter as bits."""
    where: dict[str, int] = {}
    for k, c in enumerate(a):
        where[c] = where.get(c, 0) | 1 << k
    return where


def common_letters(a: str, b: str, where: dict[str, int] | None = None) -> int:
    """Length of the longest common subsequence, a column of bits for each letter of `b`; `where` is letter_bits(a) if it is known."""
    where = letter_bits(a) if where is None else where
    full = row = (1 << len(a)) - 1
    for c in b:
        if c in where:
            u = row & where[c]
            row = (row + u | row - u) & full
    return len(a) - row.bit_count()


def likeness(pairs: DataFrame, left: str, right: list[str]) -> DataFrame:
    """`pairs` with `score`: 100 times twice the common letters over all letters, the best of the right columns."""
    prepare(pairs.sparkSession)
    schema = StructType([*pairs.schema.fields, StructField("score", DoubleType())])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            want, others = b.column(left).to_pylist(), [b.column(r).to_pylist() for r in right]
            scores = [max(200.0 * common_letters(w, o) / (len(w) + len(o)) if w or o else 0.0 for o in found) for w, *found in zip(want, *others, strict=True)]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(scores, pa.float64())], names=[*b.schema.names, "score"])

    return pairs.mapInArrow(each, schema)


FOUND = (
    "value_id {id}, pool {pool}, first {no}, size int, score double, method string, text string, lines array<{line}>,"
    " box struct<x0 double, y0 double, x1 double, y1 double>, centre double"
)


def _starts(offsets: list[int], low: float, high: float) -> range:
    """Words that start at an offset from `low` to `high`."""
    return range(bisect_left(offsets, low), bisect_right(offsets, high))


def _occurrences(text: str, part: str) -> Iterator[int]:
    at = text.find(part)
    while at >= 0:
        yield at
        at = text.find(part, at + 1)


class _Page:
    """The words of one pool as three strings of letters, each with the offset at which every word starts, and an index of short strings."""

    def __init__(self, columns: dict[str, list]):
        self.c, self.n = columns, len(columns["no"])
        self.text, self.at, self.grams = {}, {}, {}
        for form in ("ws", "wb", "wf"):
            self.text[form] = "".join(columns[form])
            self.at[form] = [0, *accumulate(map(len, columns[form]))]

    def allowed(self, i: int, size: int) -> bool:
        """Words on one line, or on lines that nearly touch."""
        if size < 1 or size > LONGEST or i + size > self.n:
            return False
        span = slice(i, i + size)
        middle = [(a + b) / 2 for a, b in zip(self.c["y0"][span], self.c["y1"][span], strict=True)]
        return len(set(self.c["line"][span])) < 2 or max(middle) - min(middle) <= APART

    def equal(self, form: str, value: str) -> Iterator[tuple[int, int]]:
        """Runs of words whose letters are the value's."""
        offsets = self.at[form]
        for at in _occurrences(self.text[form], value):
            for i in _starts(offsets[:-1], at, at):
                for size in range(1, LONGEST + 1):
                    if i + size <= self.n and offsets[i + size] == at + len(value) and self.allowed(i, size):
                        yield i, size

    def ends(self, value: str) -> Iterator[tuple[int, int]]:
        """Single words that start or end with the value."""
        for form in ("wb", "wf"):
            offsets = self.at[form]
            for at in _occurrences(self.text[form], value):
                i = bisect_right(offsets, at) - 1
                whole = offsets[i + 1] - offsets[i]
                if len(value) < whole and at + len(value) <= offsets[i + 1] and (at == offsets[i] or at + len(value) == offsets[i + 1]):
                    yield i, 1

    def places(self, form: str, gram: str) -> np.ndarray:
        key = form, len(gram)
        if key not in self.grams:
            index: dict[str, list[int]] = {}
            text = self.text[form]
            for k in range(len(text) - len(gram) + 1):
                index.setdefault(text[k : k + len(gram)], []).append(k)
            self.grams[key] = index
        return np.array(self.grams[key].get(gram, NOWHERE))

    def alike(self, value: str) -> set[tuple[int, int]]:
        """Runs of words that may be like the value: nearly as long, with enough of its pieces at nearly their places.

        Of a score of 82 follows that at most d = 18 % of all letters differ. A difference spoils one piece at most, and moves the others by
        d at most, so of m pieces m - d are whole. Pieces are two letters, or one where two would not leave any.
        """
        n, out = len(value), set()
        most = int(0.18 * (n + int(n * 1.18 / 0.82)))  # differences, of the longest run that can be like the value
        if not most:
            return out  # only an equal run is like it
        width = 2 if n // 2 > most else 1
        pieces = [(k, value[k : k + width]) for k in range(0, n - width + 1, width)]
        for form in ("wb", "wf"):
            offsets = np.array(self.at[form])
            starts, whole = offsets[:-1], np.zeros(self.n, np.int32)
            for k, piece in pieces:
                at = self.places(form, piece) - k
                if len(at):
                    edge = np.zeros(self.n + 1, np.int32)
                    np.add.at(edge, np.searchsorted(starts, at - most), 1)
                    np.add.at(edge, np.searchsorted(starts, at + most, "right"), -1)
                    whole += np.cumsum(edge[:-1]) > 0
            for size in range(1, min(LONGEST, self.n) + 1):
                i = np.arange(self.n - size + 1)
                a = offsets[size:] - starts[: len(i)]
                close = (np.abs(a - n) <= 0.18 * (a + n)) & (whole[: len(i)] >= len(pieces) - np.floor(0.18 * (a + n)))
                out.update((int(k), size) for k in np.flatnonzero(close) if self.allowed(int(k), size))
        return out

    def score(self, value: str, where: dict[str, int], i: int, size: int) -> float:
        best = 0.0
        for form in ("wb", "wf"):
            got = self.text[form][self.at[form][i] : self.at[form][i + size]]
            if got:
                best = max(best, 200.0 * common_letters(value, got, where) / (len(value) + len(got)))
        return best

    def row(self, i: int, size: int) -> tuple:
        span = slice(i, i + size)
        c = {k: self.c[k][span] for k in ("text", "line", "x0", "y0", "x1", "y1")}
        box = {"x0": min(c["x0"]), "y0": min(c["y0"]), "x1": max(c["x1"]), "y1": max(c["y1"])}
        centre = sum((a + b) / 2 for a, b in zip(c["x0"], c["x1"], strict=True)) / size
        return self.c["no"][i], size, " ".join(c["text"]), sorted(set(c["line"])), box, centre


def _spans_of(page: _Page, squashed: str, letters: str) -> dict[tuple[int, int], tuple[float, str]]:
    """Every run of words that is the value, with its score: the kinds of match in their order, and likeness where none is equal."""
    found: dict[tuple[int, int], tuple[float, str]] = {}
    for at in page.equal("ws", squashed):
        found[at] = (EXACT, "exact")
    if letters:
        for at in page.equal("wb", letters):
            found.setdefault(at, (SEPARATORS, "exact"))
        for at in page.equal("wf", letters):
            found.setdefault(at, (FOLDED, "fuzzy"))
        if len(letters) > 1:
            for at in page.ends(letters):
                found.setdefault(at, (MERGED, "fuzzy"))
        if not any(score == EXACT for score, _ in found.values()):
            where = letter_bits(letters)
            for at in page.alike(letters) - found.keys():
                score = page.score(letters, where, *at)
                if score >= LEAST:
                    found[at] = (score, "fuzzy")
    return found


def candidates(words: DataFrame, values: DataFrame) -> DataFrame:
    """(value_id, pool, first, size, score, method, text, lines, box, centre): every span that is its value by a score of 82 at least.

    A page's words and the values asked of it meet in one group, which is as large as the page: runs of words are not made, but
    found at the places of the value's letters in the page's.
    """
    prepare(words.sparkSession)
    asked = values.where(F.col("value").isNotNull()).select("value_id", "pool", squash(F.col("value")).alias("vs"), bare(F.col("value")).alias("vb")).where("vs <> ''")
    seen = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(asked.select("pool").distinct(), "pool", "left_semi")
    text = F.col("text")
    seen = seen.select("pool", "no", "text", "line", "x0", "y0", "x1", "y1", squash(text).alias("ws"), bare(text).alias("wb"), foldbare(text).alias("wf"))
    kind = lambda c, df=seen: df.schema[c].dataType.simpleString()
    schema = FOUND.format(id=kind("value_id", asked), pool=kind("pool"), no=kind("no"), line=kind("line"))
    names, own = ["value_id", "pool", "first", "size", "score", "method", "text", "lines", "box", "centre"], to_arrow_schema(StructType.fromDDL(schema))

    def one(key, left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            page = _Page(left.sort_by("no").to_pydict())
            for vid, squashed, letters in zip(*(right.column(c).to_pylist() for c in ("value_id", "vs", "vb")), strict=True):
                for (i, size), (score, method) in _spans_of(page, squashed, letters).items():
                    first, n, told, lines, box, centre = page.row(i, size)
                    rows.append((vid, key[0].as_py(), first, n, score, method, told, lines, box, centre))
        return pa.table([pa.array([r[k] for r in rows], own.field(n).type) for k, n in enumerate(names)], schema=own)

    return seen.groupBy("pool").cogroup(asked.groupBy("pool")).applyInArrow(one, schema)


def locate_values(words: DataFrame, values: DataFrame, columns: DataFrame | None = None, many_lines: bool = False) -> DataFrame:
    """(value_id, score, method, first, size, text, box, lines, ambiguous, digits, note): the best span of each value.

    Best is the highest score, then the span nearest to the middle of the value's column if `columns` (value_id, left, right) has
    one, then the fewest words, then the first. Another span that is as good in all three makes it ambiguous. A box of most of the page's
    width, or across lines and tall, is no cell: it is refused with a note. A value that is not found has method none and score 0.
    """
    found = candidates(words, values).drop("pool")
    if columns is None:
        found = found.withColumn("off", F.lit(0.0))
    else:
        found = found.join(columns.select("value_id", "left", "right"), "value_id", "left").withColumn("off", F.coalesce(F.round(F.abs(F.col("centre") - (F.col("left") + F.col("right")) / 2), 3), F.lit(0.0)))
    rank = F.struct(-F.col("score"), F.col("off"), F.col("size"))
    # Spans of equal rank first, then the best rank, so that the pages are searched once.
    level = found.groupBy("value_id", rank.alias("rank")).agg(F.min_by(F.struct("score", "method", "first", "size", "text", "box", "lines"), "first").alias("b"), (F.count("*") > 1).alias("ambiguous"))
    best = level.groupBy("value_id").agg(F.min_by(F.struct("b", "ambiguous"), "rank").alias("t"))
    out = values.join(best.select("value_id", "t.b.*", "t.ambiguous"), "value_id", "left")
    out = out.withColumn("box", F.when(F.col("score").isNotNull(), padded(F.col("box"))))
    wide = F.lit(not many_lines) & (F.col("box.x1") - F.col("box.x0") > WIDEST)
    tall = F.lit(not many_lines) & (F.size("lines") > 1) & (F.col("box.y1") - F.col("box.y0") > TALLEST)
    refused = F.coalesce(wide | tall, F.lit(False))
    note = F.when(F.col("score").isNull(), "not found").when(wide, "wider than a cell").when(tall, "across lines")
    agreed = F.when(F.col("score").isNull(), "na").otherwise(digit_agreement(F.col("value"), F.col("text")))
    return out.select(
        "value_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(F.col("score").isNull() | refused, "none").otherwise(F.col("method")).alias("method"),
        "first", "size", "text", F.when(~refused, F.col("box")).alias("box"), "lines",
        F.coalesce("ambiguous", F.lit(False)).alias("ambiguous"), agreed.alias("digits"), note.alias("note"),
    )


def rivals(words: DataFrame, values: DataFrame) -> DataFrame:
    """(value_id, no, text, score): for values that are mostly digits, the number of their pool that reads most like them.

    For pools of one row, after a value was not found: a number of nearly the same length that shares 55 % of the digits is a disagreement
    of the readers, not a failure to find. Candidates share a digit, through an index of digits.
    """
    want = values.select("value_id", "pool", digits(F.col("value")).alias("want"), bare(F.col("value")).alias("vb")).where("want <> '' AND length(want) >= 0.5 * length(vb)")
    got = words.select("pool", "no", "text", digits(F.col("text")).alias("got")).where("got <> ''")
    each = lambda c: F.explode(F.array_distinct(F.split(c, "")))
    pairs = want.withColumn("d", each("want")).join(got.withColumn("d", each("got")), ["pool", "d"]).where("abs(length(got) - length(want)) <= 1").drop("d").distinct()
    found = likeness(pairs, "want", ["got"]).where("score >= 55")
    return found.groupBy("value_id").agg(F.max_by(F.struct("no", "text", "score"), F.struct("score", -F.col("no"))).alias("b")).select("value_id", "b.*")


class _Lines:
    """The words of one page by printed line, and a search for words that hold a word of a quote or are held by it."""

    def __init__(self, columns: dict[str, list]):
        self.c = columns
        self.bands: dict = {}
        for k, line in enumerate(columns["line"]):
            self.bands.setdefault(line, []).append(k)
        self.order = sorted(self.bands, key=lambda x: self.bands[x][0])
        self.letters = {x: sum(len(columns["wb"][k]) for k in rows) for x, rows in self.bands.items()}
        self.known: dict[str, list[int]] = {}
        for k, w in enumerate(columns["wb"]):
            if w:
                self.known.setdefault(w, []).append(k)
        self.strings = [("\n".join(columns[f]), [0, *accumulate(len(w) + 1 for w in columns[f])]) for f in ("wb", "wf")]
        self.found: dict[str, set[int]] = {}

    def related(self, t: str) -> set[int]:
        """Words that hold `t` in either form, or of two letters at least and are held by it."""
        if t not in self.found:
            hit = {bisect_right(offsets, at) - 1 for text, offsets in self.strings for at in _occurrences(text, t)}
            few = len(t) * len(t) < 2 * len(self.known) + 200
            parts = {t[a:b] for a in range(len(t)) for b in range(a + 2, len(t) + 1)} if few else {w for w in self.known if len(w) > 1 and w in t}
            self.found[t] = {k for k in hit.union(*(self.known[p] for p in parts if p in self.known)) if self.c["wb"][k]}
        return self.found[t]

    def score(self, tokens: list[str], lines: tuple) -> tuple[float, list[int]]:
        """F1 of a line or two, and the words that are matched: from left to right, each uses up the first word of the quote that it goes with."""
        left, chars, hits = list(tokens), 0, []
        any_ = set().union(*(self.related(t) for t in tokens))
        for k in (k for x in lines for k in self.bands[x] if k in any_):
            t = next((t for t in left if k in self.related(t)), None)
            if t is not None:
                left.remove(t)
                chars += min(len(t), len(self.c["wb"][k]))
                hits.append(k)
        total = sum(self.letters[x] for x in lines)
        recall, precision = (len(tokens) - len(left)) / len(tokens), min(1.0, chars / total) if total else 0.0
        return (200 * precision * recall / (precision + recall) if precision + recall else 0.0), hits

    def best(self, tokens: list[str]) -> tuple | None:
        """(score, second score, lines, words, box) of the best line or two neighbours; lines that share nothing with the quote are not scored."""
        met = {self.c["line"][k] for t in tokens for k in self.related(t)}
        top, second = None, 0.0
        for at, line in enumerate(self.order):
            for lines in ((line,), (line, self.order[at + 1])) if at + 1 < len(self.order) else ((line,),):
                if met.isdisjoint(lines):
                    continue
                score, hits = self.score(tokens, lines)
                if top is None or score > top[0]:
                    second = top[0] if top else 0.0
                    top = (score, lines, hits)
                else:
                    second = max(second, score)
        if top is None:
            return None
        score, lines, hits = top
        whole = [k for x in lines for k in self.bands[x]]
        shown, c = hits or whole, self.c
        box = {"x0": min(c["x0"][k] for k in shown), "y0": min(c["y0"][k] for k in whole), "x1": max(c["x1"][k] for k in shown), "y1": max(c["y1"][k] for k in whole)}
        return score, second, list(lines), len(shown), box


def locate_rows(words: DataFrame, quotes: DataFrame) -> DataFrame:
    """(row_id, score, method, lines, words, box, ambiguous): the printed line, or two lines in a row, that explains a quoted row best.

    The score is the F1 of the quote's words that are found and of the line's letters that they explain. A line's words are taken from left to right; each uses up
    the first word of the quote that it holds, or that holds it. A page and the rows quoted from it are one group; lines that share nothing with a quote are not scored.
    Quotes are (row_id, pool, quote). Best is the highest score, then the first line, one line before two.
    """
    prepare(words.sparkSession)
    tokens = F.filter(F.transform(F.split(norm(F.col("quote")), " "), lambda t: F.regexp_replace(t, "[^0-9a-z]+", "")), lambda t: t != "")
    asked = quotes.where("quote IS NOT NULL").select("row_id", "pool", tokens.alias("tokens")).where(F.size("tokens") > 0)
    seen = words.where(F.trim(F.coalesce("text", F.lit(""))) != "").join(asked.select("pool").distinct(), "pool", "left_semi")
    seen = seen.select("pool", "line", "no", bare(F.col("text")).alias("wb"), foldbare(F.col("text")).alias("wf"), "x0", "y0", "x1", "y1")
    kind = lambda c, df: df.schema[c].dataType.simpleString()
    schema = f"row_id {kind('row_id', quotes)}, score double, second double, lines array<{kind('line', words)}>, words int, box struct<x0 double, y0 double, x1 double, y1 double>"
    own = to_arrow_schema(StructType.fromDDL(schema))

    def one(left: pa.Table, right: pa.Table) -> pa.Table:
        rows = []
        if left.num_rows and right.num_rows:
            page = _Lines(left.sort_by("no").to_pydict())
            for row, told in zip(right.column("row_id").to_pylist(), right.column("tokens").to_pylist(), strict=True):
                found = page.best(told)
                if found:
                    rows.append((row, *found))
        return pa.table([pa.array([r[k] for r in rows], f.type) for k, f in enumerate(own)], schema=own)

    best = seen.groupBy("pool").cogroup(asked.groupBy("pool")).applyInArrow(one, schema)
    ok = F.coalesce(F.col("score") >= ROW_LEAST, F.lit(False))
    return quotes.select("row_id").join(best, "row_id", "left").select(
        "row_id", F.coalesce("score", F.lit(0.0)).alias("score"), F.when(~ok, "none").when(F.col("score") >= 99, "exact").otherwise("fuzzy").alias("method"),
        F.when(ok, F.col("lines")).alias("lines"), F.when(ok, F.col("words")).alias("words"), F.when(ok, padded(F.col("box"))).alias("box"), (ok & (F.col("second") > 0) & (F.col("score") - F.col("second") < 3)).alias("ambiguous"),
    )


def row_pools(words: DataFrame, rows: DataFrame, slack: float = 0.004) -> DataFrame:
    """Words whose middle is in a located row's band, as pools by row_id, from left to right; rows are (row_id, pool, box)."""
    placed = rows.where("box IS NOT NULL").select("row_id", "pool", (F.col("box.y0") - slack).alias("__a"), (F.col("box.y1") + slack).alias("__b"))
    middle = (F.col("y0") + F.col("y1")) / 2
    inside = words.join(placed, "pool").where((middle >= F.col("__a")) & (middle <= F.col("__b")))
    no = F.row_number().over(Window.partitionBy("row_id").orderBy("x0", "no"))
    return inside.select(F.col("row_id").alias("pool"), no.alias("no"), "text", "line", "x0", "y0", "x1", "y1")
