"""Exact token counts at every prefix of a text, stored once and asked as often as one likes.

The encoding of a word under byte-pair merges has a property that makes it a dynamic programme over prefixes: whatever stands
before a token is itself the encoding of that prefix, and a row of tokens is an encoding as soon as every two neighbours
are one. So the last token of prefix j is the one token that ends there, starts at some i, and fits the last token of
prefix i; its count is that of i plus one. The same step with tokens that close a word gives what the prefix would have if the
text ended there. Whole words add up; a text's table holds, for each character, the count of the text up to it.

    table  := u8 width, u32 step, u64 characters, (i64 count before, i64 least count within)* for each `step` characters,
              signed differences of `width` bytes, one for each character

`tokens_at` and `chars_within` answer from a table alone: how many tokens a prefix has, and the longest prefix within a budget (a
prefix can have more tokens than a longer one, so this is not the first place where the budget is passed).

Tokenizer files: byte-pair merges over bytes with a word-end mark, white space dropped, lower-casing and canonical composition
(`word_bpe_49k.json`). Others raise ValueError. Special strings count as one token, as is the library's default; a prefix that
ends within one is plain text. Where composition joins a letter and the marks after it, a cut between them would
change the letter: every character of such a cluster has the count of the text up to the cluster's end.

Cases: a null text is empty and has an empty table; repeated ids have a row each; a null id stays null; other columns
are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import json
import os
import struct
import unicodedata
from collections.abc import Iterator

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
import regex
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType

from lodestar.llm.common import strings
from lodestar.llm.tokens import ENTRY, PIECE, _byte_letters
from lodestar.session import prepare, scratch

NEVER, HEAD, STEP, HEADS = 1 << 30, struct.Struct("<BIQ"), 4096, 5
SHORT, ASCII = 20, 60  # characters of a chunk, of one in ASCII, whose counts are surely below 256
ADD = [bytes((x + k) % 256 for x in range(256)) for k in range(256)]  # adds k to the counts of a short chunk
COUNTS = "doc_id long, n_bytes long, n_chars long, n_tokens long, prefix_counts binary"


class Merges:
    """The merge tree of every token, and which two tokens may stand beside each other."""

    def __init__(self, vocabulary: dict[str, int], merges: list, mark: str):
        self.left, self.right, self.rank, body, closes = {}, {}, {}, {}, {}
        for letter in _byte_letters().values():
            for name, closing in ((letter, False), (letter + mark, True)):
                if name not in vocabulary:
                    raise ValueError(f"the vocabulary lacks {name!r}")
                t = vocabulary[name]
                self.rank[t], body[t], closes[t] = -1, letter, closing
        self.merged, self.known, self.heads = {}, {}, {}
        for rank, pair in enumerate(merges):
            a, b = pair if isinstance(pair, list) else pair.split(" ")
            t, a, b = vocabulary[a + b], vocabulary[a], vocabulary[b]
            if t in self.rank:
                raise ValueError("a token has two merges")
            self.merged[a, b] = rank
            self.left[t], self.right[t], self.rank[t] = a, b, rank
            body[t], closes[t] = body[a] + body[b], closes[b]
        found: dict[str, tuple[int, int]] = {}  # the token that a string is within a word and at its end; -1 if it is none
        whole = set()
        for t in sorted(body, key=self.rank.__getitem__):
            if self.rank[t] >= 0:
                a, b = self.left[t], self.right[t]
                if a not in whole or b not in whole or not self.apart(a, b, self.rank[t]):
                    continue  # the merges never arrive at this token
            whole.add(t)
            inner, last = found.get(body[t], (-1, -1))
            found[body[t]] = (inner, t) if closes[t] else (t, last)
        self.ending = ahocorasick.Automaton()
        for s, (inner, last) in found.items():
            self.ending.add_word(s, (len(s), inner, last))
        self.ending.make_automaton()

    def apart(self, a: int, b: int, until: int = NEVER) -> bool:
        """Whether no merge joins the end of `a` to the start of `b` before both are formed (before rank `until`).

        Walks back in time: of the two tokens at the border, the one that was formed later gives way to its part there. A
        border merge happens if its rank is below those at which either neighbour was taken up; of equal ranks the left one
        goes first.
        """
        rank = self.rank
        until_a = until_b = until
        while True:
            m = self.merged.get((a, b), NEVER)
            if m < until_a and m <= until_b and m < until:
                return False
            ra, rb = rank[a], rank[b]
            if ra < 0 and rb < 0:
                return True
            if ra > rb:
                a, until_a = self.right[a], ra
            else:
                b, until_b = self.left[b], rb

    def counts(self, letters: str) -> list[int]:
        """Tokens of each prefix of a word, as if the word ended there; element j is that of the first j letters.

        Words that start alike share the rows of their first HEADS letters.
        """
        n, done = len(letters), 0
        if n > HEADS:
            row = self.heads.get(letters[:HEADS])
            if row is None:
                row = self._rows(letters[:HEADS], HEADS + 1, 0, [-1] * (HEADS + 1), [0] * (HEADS + 1), [0] * (HEADS + 1))
                if len(self.heads) > 200_000:
                    self.heads.clear()
                self.heads[letters[:HEADS]] = row
            more, done = n - HEADS, HEADS
            last, inner, closed = row[0] + [-1] * more, row[1] + [0] * more, row[2] + [0] * more
        else:
            last, inner, closed = [-1] * (n + 1), [0] * (n + 1), [0] * (n + 1)
        return self._rows(letters, n, done, last, inner, closed)[2]

    def _rows(self, letters: str, n: int, done: int, last: list[int], inner: list[int], closed: list[int]) -> tuple[list[int], list[int], list[int]]:
        """Continue the three rows after `done` letters: last token, tokens within the word, tokens if the word ended there."""
        known, apart = self.known, self.apart
        for j, (size, t, end) in self.ending.iter(letters):  # at each place the longest token first
            j += 1
            if j <= done:
                continue
            i = j - size
            before = last[i]
            if last[j] < 0 <= t and j < n:
                pair = before << 20 | t
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = before < 0 or apart(before, t)
                if ok:
                    last[j], inner[j] = t, inner[i] + 1
            if end >= 0 and not closed[j]:
                pair = before << 20 | end
                ok = known.get(pair)
                if ok is None:
                    ok = known[pair] = before < 0 or apart(before, end)
                if ok:
                    closed[j] = inner[i] + 1
        if len(known) > 1_000_000:
            known.clear()
        return last, inner, closed


class _Known(dict):
    """Chunks of a text and the counts of their prefixes, in two generations bounded by their bytes."""

    def __init__(self, compute, most: int):
        super().__init__()
        self.compute, self.most, self.held, self.old = compute, most, 0, {}

    def __missing__(self, chunk: str) -> bytes:
        counts = self.old.get(chunk) or self.compute(chunk)
        self.held += ENTRY + len(chunk) + len(counts)
        self[chunk] = counts
        return counts

    def age(self) -> None:
        if self.held > self.most // 2:
            self.old = dict(self)
            self.clear()
            self.held = 0


class PrefixCounter:
    """counts(text) is an array with the tokens of text[:1], text[:2] and so on."""

    def __init__(self, path: str, most: int = 192 << 20):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # Spark's tasks are the parallelism
        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model, steps = spec["model"], (spec["pre_tokenizer"] or {}).get("pretokenizers", [])
        kinds = {x["type"] for x in (spec["normalizer"] or {}).get("normalizers", [])}
        ok = model["type"] == "BPE" and model.get("end_of_word_suffix") and not model.get("continuing_subword_prefix") and kinds <= {"NFC", "Replace", "Lowercase"} and "Lowercase" in kinds
        ok = ok and len(steps) == 2 and steps[0]["type"] == "Split" and steps[0]["invert"] and steps[0]["behavior"] == "Removed" and steps[1]["type"] == "ByteLevel" and not steps[1]["use_regex"] and not steps[1]["add_prefix_space"]
        if not ok or any(t["normalized"] or t["lstrip"] or t["rstrip"] or t["single_word"] for t in spec["added_tokens"]):
            raise ValueError(f"{path}: prefix counts need byte-pair merges with a word-end mark over words without white space")
        self.library = Tokenizer.from_file(path)
        self.pattern = regex.compile(steps[0]["pattern"]["Regex"])
        self.merges = Merges(model["vocab"], model["merges"], model["end_of_word_suffix"])
        special = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.special = regex.compile("|".join(map(regex.escape, special))) if special else None
        self.letters = _byte_letters()
        self.words, self.chunks = _Known(self._word, most // 3), _Known(self._chunk, most * 2 // 3)
        self.plain = {c for c in map(chr, range(256)) if self._alike(c)}
        self.joining: set[str] | None = None

    def _alike(self, c: str) -> bool:
        """Whether this module's pattern and lower-casing split a character as the library does, and character by character."""
        probes = [f"a{c}", f"1{c}", f":{c}", f"{c}{c}a"]
        return len(c.lower()) == 1 and all([x.group() for x in self.pattern.finditer(p.lower())] == [p.lower()[a:b] for a, b in self._spans(p)] for p in probes)

    def _spans(self, text: str) -> list[tuple[int, int]]:
        """The library's words of a text as ranges of its normalized form."""
        return [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(self.library.normalizer.normalize_str(text))]

    def _counts(self, word: str) -> list[int]:
        """Counts of the prefixes of one word, by character."""
        raw = word.encode()
        counts = self.merges.counts(raw.decode("latin-1").translate(self.letters))
        if len(raw) == len(word):
            counts = counts[1:]
        else:
            counts = [counts[k + 1] for k in range(len(raw)) if k + 1 == len(raw) or raw[k + 1] & 0xC0 != 0x80]
        if word[0] == "'" and word[1:].isalpha():
            counts[:-1] = [len(self.pattern.findall(word[:k])) for k in range(1, len(word))]  # a contraction that is cut is two words: the mark, and a letter
        return counts

    def _word(self, word: str) -> bytes:
        return bytes(self._counts(word))

    def _clusters(self, text: str) -> list[str]:
        """A text cut before every character that composition cannot join to the one before."""
        if self.joining is None:
            parts = (unicodedata.decomposition(chr(c)) for c in range(0x110000))
            self.joining = {chr(int(p.split()[1], 16)) for p in parts if p and p[0] != "<" and " " in p}
            self.joining |= {chr(c) for c in [*range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]}
        out: list[str] = []
        for c in text:
            first = unicodedata.normalize("NFD", c)[0]
            if out and (unicodedata.combining(first) or c in self.joining or first in self.joining):
                out[-1] += c
            else:
                out.append(c)
        return out

    def _plain(self, text: str) -> np.ndarray:
        """Counts of the prefixes of a text without special strings."""
        if self.plain.issuperset(text):
            norm, places = text.lower(), None
            spans = [m.span() for m in self.pattern.finditer(norm)]
        else:
            clusters = self._clusters(text)
            forms = [self.library.normalizer.normalize_str(c) for c in clusters]
            norm = "".join(forms)
            ends = np.cumsum([len(f) for f in forms])
            places = np.repeat(ends, [len(c) for c in clusters])
            spans = [at for _, at in self.library.pre_tokenizer.pre_tokenize_str(norm)]
        counts, done = np.zeros(len(norm) + 1, "<i4"), 0
        at = 0
        for a, b in spans:
            counts[at : a + 1] = done
            word = norm[a:b]
            counts[a + 1 : b + 1] = done + (np.frombuffer(self.words[word], np.uint8) if len(word) <= SHORT else np.array(self._counts(word))).astype("<i4")
            at, done = b, int(counts[b])
        counts[at:] = done
        return counts[1:] if places is None else counts[places]

    def _chunk(self, chunk: str) -> bytes:
        """Counts of the prefixes of a short chunk without spaces, and once more the whole count for the space after it."""
        if not chunk:
            return b"\0"
        if self.plain.issuperset(chunk):
            if chunk.isalpha():
                own = self._of(chunk.lower())
                return own + own[-1:]
            if chunk[-1] in ",." and chunk[:-1].isalpha():
                own = self._of(chunk[:-1].lower())
                return own + ADD[own[-1]][1:2] * 2
            if self.special is None or not self.special.search(chunk):
                norm, out, done = chunk.lower(), b"", 0
                for m in self.pattern.finditer(norm):
                    out += ADD[0][done : done + 1] * (m.start() - len(out)) + self._of(m.group()).translate(ADD[done])
                    done = out[-1]
                return out + ADD[0][done : done + 1] * (len(norm) + 1 - len(out))
        counts = self._long(chunk).astype(np.uint8).tobytes()
        return counts + counts[-1:]

    def _of(self, word: str) -> bytes:
        return self.words[word] if len(word) <= SHORT else self._word(word)

    def _long(self, chunk: str) -> np.ndarray:
        """Counts of the prefixes of any text, read as one chunk."""
        parts, base, at = [], 0, 0
        for m in self.special.finditer(chunk) if self.special else ():
            total = int(self._plain(chunk[at : m.start()])[-1]) if m.start() > at else 0
            cut = self._plain(chunk[at : m.end()])  # a special string that is cut is plain text
            cut[-1] = total + 1
            parts.append(cut + base)
            base, at = base + total + 1, m.end()
        if at < len(chunk):
            parts.append(self._plain(chunk[at:]) + base)
        return np.concatenate(parts)

    def counts(self, text: str) -> np.ndarray:
        """int64 counts of text[:1], text[:2], ..., text."""
        text = text.replace("\n", " ").replace("\t", " ").replace("\r", " ")
        out, at, base = [], 0, 0
        while at < len(text):
            end = text.find(" ", at + PIECE)
            end = len(text) if end < 0 else end + 1
            out.append(self._piece(text[at:end]) + base)
            at, base = end, int(out[-1][-1])
        return np.concatenate(out) if out else np.empty(0, np.int64)

    def _piece(self, text: str) -> np.ndarray:
        parts = text.split(" ")
        self.words.age()
        self.chunks.age()
        if any([len(p) > SHORT and (len(p) > ASCII or not p.isascii()) for p in parts]):
            short = lambda p: len(p) <= SHORT or (len(p) <= ASCII and p.isascii())
            each = [np.frombuffer(self.chunks[p], np.uint8) if short(p) else self._long(p) for p in parts]
            flat = np.concatenate([x if short(p) else np.r_[x, x[-1]] for x, p in zip(each, parts, strict=True)]).astype("<i4")
        else:
            flat = np.frombuffer(b"".join(map(self.chunks.__getitem__, parts)), np.uint8)
        sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
        whole = flat[np.cumsum(sizes) - 1].astype(np.int64)
        return (flat + np.repeat(np.cumsum(whole) - whole, sizes))[:-1]


_COUNTERS: dict[str, PrefixCounter] = {}


def counter(path: str) -> PrefixCounter:
    """One counter for each worker process."""
    if path not in _COUNTERS:
        _COUNTERS[path] = PrefixCounter(path)
    return _COUNTERS[path]


def pack(counts: np.ndarray, step: int = STEP) -> bytes:
    """The table of a text from the counts of its prefixes."""
    counts = counts.astype(np.int64)
    deltas = np.diff(counts, prepend=0)
    width = next(w for w in (1, 2, 4, 8) if not len(deltas) or w == 8 or max(-int(deltas.min()) - 1, int(deltas.max())) < 1 << (8 * w - 1))
    starts = np.arange(0, len(counts), step)
    blocks = np.empty((len(starts), 2), "<i8")
    if len(starts):
        blocks[:, 0] = np.r_[0, counts[starts[1:] - 1]]
        blocks[:, 1] = np.minimum.reduceat(counts, starts)
    return HEAD.pack(width, step, len(counts)) + blocks.tobytes() + deltas.astype(f"<i{width}").tobytes()


class Table:
    """Answers from one packed table; reads one block of it for each question."""

    def __init__(self, packed: bytes):
        self.packed = packed
        self.width, self.step, self.chars = HEAD.unpack_from(packed)
        self.blocks = np.frombuffer(packed, "<i8", 2 * -(-self.chars // self.step), HEAD.size).reshape(-1, 2)

    def _block(self, k: int) -> np.ndarray:
        n = min(self.step, self.chars - k * self.step)
        at = HEAD.size + self.blocks.nbytes + k * self.step * self.width
        return self.blocks[k, 0] + np.cumsum(np.frombuffer(self.packed, f"<i{self.width}", n, at), dtype=np.int64)

    def tokens(self, chars: int) -> int:
        """Tokens of the first `chars` characters; all of them beyond the end."""
        chars = min(chars, self.chars)
        if chars <= 0:
            return 0
        k = (chars - 1) // self.step
        return int(self._block(k)[chars - 1 - k * self.step])

    def longest(self, budget: int) -> int:
        """Characters of the longest prefix with `budget` tokens at most."""
        fitting = np.flatnonzero(self.blocks[:, 1] <= budget)
        if not len(fitting):
            return 0
        k = int(fitting[-1])
        return k * self.step + int(np.flatnonzero(self._block(k) <= budget)[-1]) + 1


def prefix_counts(docs: DataFrame, tokenizer: str) -> DataFrame:
    """(doc_id, n_bytes, n_chars, n_tokens, prefix_counts) for each row of `docs` (doc_id, text), not yet stored."""
    prepare(docs.sparkSession)
    names = [c.split(" ")[0] for c in COUNTS.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(tokenizer)
        for b in batches:
            ids, rows, held, first = b.column(0), [], 0, 0
            for k, text in enumerate(strings(b.column(1))):
                counts = count.counts(text or "")
                rows.append((len((text or "").encode()), len(counts), int(counts[-1]) if len(counts) else 0, pack(counts)))
                held += len(rows[-1][3])
                if held > 32 << 20 or k + 1 == len(ids):
                    cols = [pa.array([r[i] for r in rows], t) for i, t in enumerate((pa.int64(), pa.int64(), pa.int64(), pa.binary()))]
                    yield pa.RecordBatch.from_arrays([ids.slice(first, len(rows)), *cols], names=names)
                    rows, held, first = [], 0, k + 1

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, COUNTS)


def store(counts: DataFrame) -> DataFrame:
    """The tables written once to the shared folder; differences are small, so they are compressed well."""
    path = scratch(counts.sparkSession, "prefix-counts")
    counts.write.option("compression", "zstd").parquet(path)
    return counts.sparkSession.read.schema(counts.schema).parquet(path)


@F.pandas_udf(LongType())
def tokens_at(table: pd.Series, chars: pd.Series) -> pd.Series:
    """Tokens of the first `chars` characters of a text, from its table."""
    return pd.Series([None if t is None or n != n else Table(t).tokens(int(n)) for t, n in zip(table, chars, strict=True)], dtype="Int64")


@F.pandas_udf(LongType())
def chars_within(table: pd.Series, budget: pd.Series) -> pd.Series:
    """Characters of the longest prefix of a text that has `budget` tokens at most, from its table."""
    return pd.Series([None if t is None or n != n else Table(t).longest(int(n)) for t, n in zip(table, budget, strict=True)], dtype="Int64")


def truncated(docs: DataFrame, counts: DataFrame, budget: int) -> DataFrame:
    """`docs` with each text cut to its longest prefix within `budget` tokens, for ids that are unique and not null."""
    fits = counts.select("doc_id", chars_within("prefix_counts", F.lit(budget)).cast("int").alias("__chars"))
    return docs.join(fits, "doc_id").withColumn("text", F.substring(F.col("text"), F.lit(1), F.col("__chars"))).drop("__chars")


def within_budget(counts: DataFrame, limit: int) -> DataFrame:
    """(doc_id, n_bytes, n_tokens, over_limit, fit_chars, fit_tokens): how each text stands to a limit, from stored tables alone."""
    table, whole = F.col("prefix_counts"), F.col("n_chars")
    out = counts.select("doc_id", "n_bytes", tokens_at(table, whole).alias("n_tokens"), chars_within(table, F.lit(limit)).alias("fit_chars"), _tokens_of_fit(table, F.lit(limit)).alias("fit_tokens"))
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"), "fit_chars", "fit_tokens")


@F.pandas_udf(LongType())
def _tokens_of_fit(table: pd.Series, budget: pd.Series) -> pd.Series:
    found = [Table(t) for t in table]
    return pd.Series([t.tokens(t.longest(int(n))) for t, n in zip(found, budget, strict=True)], dtype="Int64")


def over(column: Column, limit: int) -> Column:
    """Whether a text of these tables has more than `limit` tokens."""
    return tokens_at(column, F.lit(1 << 62)) > limit
