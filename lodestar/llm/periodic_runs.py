"""Runs of words that repeat with a period, found as Gusfield and Stoye find tandem repeats, in time linear in the words.

Words that cannot belong to a run are set aside first, by counts alone: in a run of period q and at least max(6, 4q) words
every three neighbouring words stand there three times or more, so stretches of words whose triples are that frequent within
the stretch are kept (counts by hash bucket, which can only be too high) until nothing more falls away. What is left goes
through the method, one stretch at a time:

1. A suffix tree with suffix links; each node knows the first place of its string.
2. Lempel-Ziv blocks, read off the tree. For every block, extensions to both sides of its borders (Z functions) give
   squares that cover the leftmost occurrence of every kind of square.
3. The squares are placed in the tree bottom-up, only those of a node's first place; walks along suffix links rotate each by one word
   after the other and complete the vocabulary.
4. The leaves below a square's place are its occurrences. Consecutive ones of one period merge into a run.

Only squares whose half is no power of a shorter word are carried, so a run's period is its smallest, and a place starts few of them.

Cases: a null text has no words; a null id has no planted repeat and stays null; repeated ids have a row each; other columns are
left out; an empty table gives an empty table. A text is taken as UTF-8 bytes, words are maximal strings without
white space (0x20, 0x09 to 0x0D). Memory grows with one text, never with a group of texts.
"""

from __future__ import annotations

import hashlib
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import utf8_of
from lodestar.session import prepare

LEAST, TIMES, PIECE = 6, 4, 1 << 20  # words and periods of a run at least; bytes that are hashed at a time
_BASE = np.full(PIECE, 0x9E3779B97F4A7C15, np.uint64)
_BASE[0] = 1
POWERS = np.multiply.accumulate(_BASE)
_BASE[1:] = pow(0x9E3779B97F4A7C15, -1, 1 << 64)
INVERSE = np.multiply.accumulate(_BASE)
MIX = np.uint64(0xC2B2AE3D27D4EB4F)
RESULT = "doc_id long, n_runs long, start long, length long, period long, exponent_milli long, runs_sha256 string, collapsed_sha256 string"


def spans(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """First bytes of the words of a text and the bytes after them."""
    word = np.zeros(len(data) + 2, np.int8)
    word[1:-1] = (data != 32) & ((data < 9) | (data > 13))
    edge = np.diff(word)
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def word_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64 bits of each word; equal words have equal ones. A word longer than a piece is hashed by its own bytes."""
    out, k = np.empty(len(starts), np.uint64), 0
    while k < len(starts):
        at = int(starts[k])
        to = int(np.searchsorted(ends, at + PIECE, "right"))
        if to <= k:
            out[k] = int.from_bytes(hashlib.blake2b(data[at : ends[k]], digest_size=8).digest(), "big")
            k += 1
            continue
        part = data[at : ends[to - 1]].astype(np.uint64)
        part[(part == 32) | ((part >= 9) & (part <= 13))] = 0
        part *= POWERS[: len(part)]
        first = starts[k:to] - at
        out[k:to] = np.add.reduceat(part, first) * INVERSE[first]
        k = to
    return out


def stretches(words: np.ndarray, limits: np.ndarray) -> list[tuple[int, int]]:
    """Ranges of words outside of which no run can be; `limits` are the first words of the texts, and the end."""
    n = len(words)
    if n < LEAST:
        return []
    triple = (words[:-2] * MIX + words[1:-1]) * MIX + words[2:]
    triple ^= triple >> np.uint64(29)
    group = np.zeros(n - 2, np.uint64)  # the stretch that a triple starts in
    group[limits[1:-1][limits[1:-1] < n - 2]] = 1
    group = np.cumsum(group, dtype=np.uint64)
    live = np.ones(n - 2, bool)
    for back in (1, 2):  # triples that cross from one text to the next
        over = limits[1:-1] - back
        live[over[(over >= 0) & (over < n - 2)]] = False
    where = np.flatnonzero(live)
    mask = np.uint64((1 << min(24, max(16, int(n).bit_length() + 3))) - 1)  # more words share buckets, which keeps more of them
    while len(where):
        key = triple[where] + group * MIX if len(group) == len(where) else triple[where] + group[where] * MIX
        key *= np.uint64(0xD6E8FEB86659FD93)
        key = (key ^ (key >> np.uint64(32))) & mask
        often = np.bincount(key.astype(np.int64), minlength=0)[key] >= TIMES - 1
        kept = where[often]
        if len(kept):
            # A run of period q has 4 triples at least, and its triples are neighbours.
            new = np.r_[True, np.diff(kept) != 1]
            label = np.cumsum(new) - 1
            kept = kept[np.bincount(label)[label] >= LEAST - 2]
        if len(kept) == len(where):
            break
        where = kept
        new = np.r_[True, np.diff(where) != 1] if len(where) else np.empty(0, bool)
        group = np.cumsum(new).astype(np.uint64)
    if not len(where):
        return []
    first = np.flatnonzero(np.r_[True, np.diff(where) != 1])
    last = np.r_[first[1:], len(where)] - 1
    return [(int(where[a]), int(where[b]) + 3) for a, b in zip(first, last, strict=True)]


class SuffixTree:
    """Suffix tree of small integers with suffix links, built from left to right. Node 0 is the root; the text ends in -1."""

    def __init__(self, text: list[int]):
        self.text = text = [*text, -1]
        n = len(text)
        self.width = width = max(text) + 2
        # An edge is its lower node; it reads text[at[v] : to[v]]. Children are keyed by node * width + symbol + 1.
        at, to, link = array("q", [0]), array("q", [0]), array("q", [0])
        child: dict[int, int] = {}
        node, place, length, rest = 0, 0, 0, 0  # active point; suffixes still to be added
        for i, c in enumerate(text):
            rest += 1
            waiting = 0
            while rest:
                if not length:
                    place = i
                key = node * width + text[place] + 1
                v = child.get(key)
                if v is None:
                    child[key] = len(at)
                    at.append(i)
                    to.append(n)
                    link.append(0)
                    if waiting:
                        link[waiting] = node
                        waiting = 0
                else:
                    size = min(to[v], i + 1) - at[v]
                    if length >= size:
                        place, length, node = place + size, length - size, v
                        continue
                    if text[at[v] + length] == c:
                        length += 1
                        if waiting:
                            link[waiting] = node
                        break
                    mid = len(at)
                    child[key] = mid
                    at.append(at[v])
                    to.append(at[v] + length)
                    link.append(0)
                    child[mid * width + c + 1] = mid + 1
                    at.append(i)
                    to.append(n)
                    link.append(0)
                    at[v] += length
                    child[mid * width + text[at[v]] + 1] = v
                    if waiting:
                        link[waiting] = mid
                    waiting = mid
                rest -= 1
                if node == 0 and length:
                    length -= 1
                    place = i - rest + 1
                elif node:
                    node = link[node]
        self.child, self.at, self.to, self.link = child, at, to, link
        self._measure()

    def _measure(self) -> None:
        """Parent and depth of each node, its leaves as a range of `leaves`, and the first place of its string."""
        n, m = len(self.text), len(self.at)
        below: dict[int, list[int]] = {}
        for key, v in self.child.items():
            below.setdefault(key // self.width, []).append(v)
        self.parent, self.depth = [0] * m, [0] * m
        self.low, self.high, self.first = [0] * m, [0] * m, [n] * m
        self.order, self.leaves = [], []
        stack = [0]
        while stack:
            v = stack.pop()
            self.order.append(v)
            self.low[v] = len(self.leaves)
            inner = below.get(v)
            if inner is None:
                self.first[v] = n - self.depth[v]
                self.leaves.append(n - self.depth[v])
                continue
            d = self.depth[v]
            for c in inner:
                self.parent[c], self.depth[c] = v, d + self.to[c] - self.at[c]
            stack += inner
        parent, first, high = self.parent, self.first, self.high
        for v in reversed(self.order):
            high[v] = max(high[v], self.low[v] + 1)
            p = parent[v]
            if v:
                first[p] = min(first[p], first[v])
                high[p] = max(high[p], high[v])

    def blocks(self) -> list[int]:
        """Starts of the Lempel-Ziv blocks: each the longest string that also starts earlier, or one new word."""
        n, starts, i = len(self.text) - 1, [], 0
        while i < n:
            starts.append(i)
            v, size = 0, 0
            while i + size < n:
                c = self.child.get(v * self.width + self.text[i + size] + 1)
                if c is None or self.first[c] >= i:
                    break
                v, size = c, min(self.depth[c], n - i)
            i += max(1, size)
        return starts


def z_function(s: list[int]) -> list[int]:
    """For each place the length of the longest string that starts there and at 0."""
    n = len(s)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(z[i - left], right - i) if i < right else 0
        while i + k < n and s[k] == s[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def covering_squares(text: list[int], starts: list[int]) -> dict[int, set[int]]:
    """Squares (start: halves) that cover the first occurrence of each kind of square, their halves at most a quarter of the text.

    A square's first occurrence has its middle in a block and reaches beyond the block before it: it crosses the end of the block
    (its second half does, or it starts there), or the block's start with its first half.
    """
    n = len(text)
    most = n // TIMES
    found: dict[int, set[int]] = {}
    for b, h in enumerate(starts):
        h1 = starts[b + 1] if b + 1 < len(starts) else n
        h2 = starts[b + 2] if b + 2 < len(starts) else n
        # Around the end of the block, the half up to as long as the block.
        if h1 < n:
            _around(text, h1, min(h1 - h, most), -1, n, found)
        # Around its start, the half up to as long as the block and the next.
        if h:
            _around(text, h, min(h2 - h, most), 1, h1, found)
    return found


def _around(text: list[int], h: int, most: int, side: int, middle: int, found: dict[int, set[int]]) -> None:
    """Squares that reach over the border h and whose other half's border is k words before (side -1) or after it, for k up to `most`."""
    if most < 1:
        return
    n, reach = len(text), 2 * most
    left, right = text[max(0, h - reach) : h][::-1], text[h : h + reach]
    runs: list[tuple[int, int, int]] = []
    if side < 0:
        # Forward from h and h - k: z of right + left part; backward from h - 1 and h - k - 1: z of the reversed left.
        ahead = z_function([*right, -2, *text[max(0, h - most) : h], *right])
        base = len(right) + 1 + min(h, most)
    else:
        ahead = z_function(right)
        base = 0
    if side < 0:
        behind = z_function(left)
        shift = 0
    else:
        behind = z_function([*left, -2, *text[h : h + most][::-1], *left])
        shift = len(left) + 1 + min(n - h, most)
    for k in range(1, most + 1):
        q = h + side * k
        if q < 0 or q > n:
            break
        if side < 0:
            forward = min(ahead[base - k], len(right)) if base - k > len(right) else 0
            back = behind[k] if k < len(behind) else 0
        else:
            forward = ahead[k] if k < len(ahead) else 0
            back = min(behind[shift - k], len(left)) if shift - k > len(left) else 0
        if forward + back < k:
            continue
        low = min(q, h)  # the earlier of the two compared places
        first, last = low - back, low + forward - k  # starts of the squares of this half
        start = max(first, low - k + 1 if forward else low - k)
        if start > last:
            continue
        end = last + 2 * k
        if any(k % d == 0 and s <= start and e >= end for d, s, e in runs):
            continue  # its half is a power of a shorter word
        runs.append((k, first, end))
        found.setdefault(start, set()).add(k)


def vocabulary(tree: SuffixTree, squares: dict[int, set[int]]) -> set[tuple[int, int]]:
    """(node, half) of every kind of square: it ends on the edge down to the node."""
    text, child, width = tree.text, tree.child, tree.width
    parent, depth, first, at, link = tree.parent, tree.depth, tree.first, tree.at, tree.link
    held = {i: sorted(k) for i, k in squares.items()}
    places = []
    for v in reversed(tree.order):
        waiting = held.get(first[v]) if v else None
        while waiting and 2 * waiting[-1] > depth[parent[v]]:
            places.append((v, waiting.pop()))
    marked = set(places)
    for v, k in places:
        size = 2 * k
        while True:
            i = first[v]
            u = parent[v]
            w, d = (link[u], depth[u] - 1) if u else (0, 0)
            while d < size - 1:  # down by whole edges to the string without its first word
                w = child[w * width + text[i + 1 + d] + 1]
                d = depth[w]
            want = text[i]
            if d == size - 1:
                w = child.get(w * width + want + 1)
                if w is None:
                    break
            elif text[at[w] + size - 1 - depth[parent[w]]] != want:
                break
            if (w, k) in marked:
                break
            marked.add((w, k))
            v = w
    return marked


def runs_of(text: list[int]) -> list[tuple[int, int, int]]:
    """(start, length, period) of the runs of a row of small integers, by start and then period."""
    n = len(text)
    if n < LEAST:
        return []
    tree = SuffixTree(text)
    squares = covering_squares(text, tree.blocks())
    starts: dict[int, list[int]] = {}
    for v, k in vocabulary(tree, squares):
        starts.setdefault(k, []).extend(tree.leaves[tree.low[v] : tree.high[v]])
    out = []
    for k, where in starts.items():
        where = np.unique(np.array(where, np.int64))
        new = np.flatnonzero(np.r_[True, np.diff(where) != 1])
        last = np.r_[new[1:], len(where)] - 1
        length = where[last] - where[new] + 2 * k
        out += [(int(s), int(m), k) for s, m in zip(where[new], length, strict=True) if m >= max(LEAST, TIMES * k)]
    return sorted(out)


def planted(doc_id: int | None, n: int) -> tuple[int, int] | None:
    """(a, p): words from a on repeat the p words there, for a tenth of the ids by crc32."""
    h = zlib.crc32(str(doc_id).encode())
    if doc_id is None or h % 10 or not n:
        return None
    g = h // 10
    a = g % n
    return a, 1 + (n - a) // (3 + g % 8)


class Text:
    """The words of one text, perhaps with a planted repeat, by their bytes."""

    def __init__(self, raw: bytes, plant: bool, doc_id: int | None):
        self.raw, self.data = raw, np.frombuffer(raw, np.uint8)
        self.starts, self.ends = spans(self.data)
        self.n = len(self.starts)
        found = planted(doc_id, self.n) if plant else None
        self.index = None
        if found:
            a, p = found
            self.index = np.arange(self.n)
            self.index[a:] = a + (self.index[a:] - a) % p

    def hashes(self) -> np.ndarray:
        h = word_hashes(self.data, self.starts, self.ends)
        return h if self.index is None else h[self.index]

    def words(self, a: int, b: int) -> list[bytes]:
        at = slice(a, b) if self.index is None else self.index[a:b]
        return [self.raw[s:e] for s, e in zip(self.starts[at].tolist(), self.ends[at].tolist(), strict=True)]

    def collapsed(self, runs: list[tuple[int, int, int]]) -> str:
        """SHA-256 of the words that stay, joined by one space: of each run its first period, and what no run holds."""
        if not runs and self.index is None and len(self.raw) <= PIECE:
            return hashlib.sha256(b" ".join(self.raw.split())).hexdigest()
        gone = np.zeros(self.n + 1, np.int64)
        for s, m, q in runs:
            gone[s + q] += 1
            gone[s + m] -= 1
        keep = np.flatnonzero(np.cumsum(gone)[:-1] == 0)
        at = keep if self.index is None else self.index[keep]
        digest = hashlib.sha256()
        for k in range(0, len(at), 65536):
            part = at[k : k + 65536]
            words = [self.raw[s:e] for s, e in zip(self.starts[part].tolist(), self.ends[part].tolist(), strict=True)]
            digest.update((b" " if k else b"") + b" ".join(words))
        return digest.hexdigest()


def _runs(text: Text, ranges: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    out = []
    for a, b in ranges:
        ids: dict[bytes, int] = {}
        row = [ids.setdefault(w, len(ids)) for w in text.words(a, b)]
        out += [(a + s, m, q) for s, m, q in runs_of(row)]
    return sorted(out)


def all_runs(texts: list[Text]) -> list[list[tuple[int, int, int]]]:
    """The runs of each text; texts are sifted together."""
    limits = np.cumsum([0] + [t.n for t in texts])
    found: list[list[tuple[int, int]]] = [[] for _ in texts]
    for a, b in stretches(np.concatenate([t.hashes() for t in texts]), limits) if texts else []:
        k = int(np.searchsorted(limits, a, "right")) - 1
        found[k].append((a - int(limits[k]), b - int(limits[k])))
    return [_runs(t, ranges) for t, ranges in zip(texts, found, strict=True)]


def _texts(col: pa.Array, ids: list[int | None], plant: bool) -> Iterator[list[Text]]:
    """Texts of a column, about a piece of bytes at a time."""
    held, size = [], 0
    for raw, doc in zip(utf8_of(col), ids, strict=True):
        held.append(Text(raw, plant, doc))
        size += len(raw)
        if size >= PIECE:
            yield held
            held, size = [], 0
    yield held


def run_rows(docs: DataFrame) -> DataFrame:
    """(doc_id, start, length, period): every run of every text of `docs` (doc_id, text)."""
    prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0).to_pylist(), []
            at = 0
            for texts in _texts(b.column(1), ids, False):
                for found in all_runs(texts):
                    rows += [(ids[at], *r) for r in found]
                    at += 1
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "length", "period"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, start long, length long, period long")


def collapse(docs: DataFrame) -> DataFrame:
    """(doc_id, text): each text with the repeats of its runs left out, words joined by one space; a null text stays null."""
    prepare(docs.sparkSession)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, at = b.column(0), 0
            for texts in _texts(b.column(1), ids.to_pylist(), False):
                out = []
                for t, runs in zip(texts, all_runs(texts), strict=True):
                    drop = np.zeros(t.n + 1, np.int64)
                    for s, m, q in runs:
                        drop[s + q] += 1
                        drop[s + m] -= 1
                    keep = np.flatnonzero(np.cumsum(drop)[:-1] == 0)
                    known = b.column(1)[at + len(out)].is_valid
                    out.append(b" ".join(t.raw[s:e] for s, e in zip(t.starts[keep].tolist(), t.ends[keep].tolist(), strict=True)).decode() if known else None)
                yield pa.RecordBatch.from_arrays([ids.slice(at, len(out)), pa.array(out, pa.string())], names=["doc_id", "text"])
                at += len(out)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, "doc_id long, text string")


def summaries(docs: DataFrame, plant: bool = False) -> DataFrame:
    """A row for each text: number of runs, the longest (ties: smallest start, then period), digests of all runs and of the collapsed text.

    With `plant`, a tenth of the texts by crc32 of the id first have their last words replaced by a repeat (planted()).
    """
    prepare(docs.sparkSession)
    kinds = (*[pa.int64()] * 5, pa.string(), pa.string())
    names = [c.split(" ")[0] for c in RESULT.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids, rows = b.column(0), []
            for texts in _texts(b.column(1), ids.to_pylist(), plant):
                for t, runs in zip(texts, all_runs(texts), strict=True):
                    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                    told = "".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()
                    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
                    rows.append((len(runs), *four, hashlib.sha256(told).hexdigest(), t.collapsed(runs)))
            yield pa.RecordBatch.from_arrays([ids, *(pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds))], names=names)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(each, RESULT)
