"""SimHash near-duplicates by a byte-position inverted index with count filtering.

A fingerprint has eight bytes. Two fingerprints that differ in at most `max_bits` = 3 bits differ in at most three
bytes, so they share at least 8 - 3 = 5 bytes at equal positions: the guaranteed minimum. Cut the eight positions in
two halves of four: one half then holds three of the five shared bytes. So the index has a list for each value of three
positional bytes, eight lists for each fingerprint (the triples within either half), and any linked pair
meets in one of them. Within a list the shared positional bytes of each pair are tallied, pairs under the minimum are
dropped, the others are verified on all 64 bits, and a spanning forest is emitted, never the pairs.

For groups by similarity (`similar_groups`) a like index finds candidates over prints whose bytes agree as often as the documents
do: 64 bytes, each of the least of the distinct five-word shingles under a hash of its own, so a byte is equal with the Jaccard
similarity as its probability. Lists are keyed by the 21 disjoint triples of positions (pairs that share 43 of the first 63 bytes
always meet), and a candidate must share 32 bytes. At exactly 0.8 a pair is no candidate with a probability under one in a
million. Components of candidates are only where to look: within them the exact similarity of the shingle sets links.

Cases: a null or empty text, or one of white space only, has no words and fingerprint zero; these texts link with one
another like any others. Equal fingerprints are one node of the index. A null doc_id never becomes a component id
unless the component has no other. Repeated rows each get their row. Other columns are left alone.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import connected_components, forest, gathered, join_hot, nest, pairs_in_runs, runs, spread_lists, unnest, utf8_of
from lodestar.session import cut, prepare

TRIPLES = [*combinations(range(4), 3), *combinations(range(4, 8), 3)]
LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
FACTORS = np.random.default_rng(42).integers(0, 1 << 63, 64, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
WORD = re.compile(rb"[^\x20\x09-\x0D]+")

SET_BYTES = 12 << 20  # of the shingle sets that meet in one block


def fingerprint(text: bytes, words: int = 3, seed: int = 42) -> int:
    """64-bit SimHash of the word shingles, repeats included; bit set if set in over half of the hashes."""
    found = WORD.findall(text.translate(LOWER))
    if not found:
        return 0
    joined = b" ".join(found)
    if len(found) <= words:
        return xxhash.xxh64_intdigest(joined, seed)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    start = (end - size)[: len(found) - words + 1].tolist()
    stop = end[words - 1 :].tolist()
    digest = xxhash.xxh64_intdigest
    h = np.fromiter((digest(joined[a:b], seed) for a, b in zip(start, stop, strict=True)), np.uint64, len(start))
    ones = np.zeros(64, np.int64)
    for at in range(0, len(h), 1 << 16):
        bits = np.unpackbits(h[at : at + (1 << 16)].astype(">u8").view(np.uint8).reshape(-1, 8), axis=1)
        ones += bits.sum(0, dtype=np.int64)
    return int.from_bytes(np.packbits(ones * 2 > len(h)).tobytes(), "big")


def fingerprints(docs: DataFrame, words: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the 64-bit fingerprint as a signed long."""

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.array([fingerprint(t, words) for t in utf8_of(b.column(1))], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp)], names=["doc_id", "fp"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text"))
    return rows.mapInArrow(each, "doc_id long, fp long")


def linked(fps: DataFrame, max_bits: int = 3, block: int = 2048) -> DataFrame:
    """A forest (u, v) over distinct fingerprints `fp` whose trees are the linked groups (up to joining lists)."""
    if not 0 <= max_bits <= 3:
        raise ValueError("the index guarantees five shared bytes for at most 3 differing bits")
    least = 8 - max_bits
    keys = []
    for k, triple in enumerate(TRIPLES):
        value = F.lit(k).cast("long")
        for p in triple:
            value = value * 256 + F.shiftrightunsigned("fp", 56 - 8 * p).bitwiseAND(F.lit(255).cast("long"))
        keys.append(value)
    postings = fps.select("fp", F.explode(F.array(*keys)).alias("list"))
    groups = spread_lists(postings, "list", "fp", block).select("list", "i", "j", "own", "fp")

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["list", "i", "j"]):
            fp = t.column("fp").to_numpy()
            x = fp.view(np.uint64)
            i, j, own = (t.column(c).to_numpy() for c in ("i", "j", "own"))
            new = np.r_[True, (np.diff(t.column("list").to_numpy()) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]
            root = np.arange(len(fp))
            for a, b in pairs_in_runs(np.cumsum(new)):
                apart = (i[a] == j[a]) | (own[a] != own[b])
                a, b = a[apart], b[apart]
                differ = x[a] ^ x[b]
                tally = (differ.view(np.uint8).reshape(-1, 8) == 0).sum(1)
                kept = tally >= least
                kept[kept] = np.bitwise_count(differ[kept]) <= max_bits
                root = forest(len(fp), a[kept], b[kept], root)
            child = np.flatnonzero(root != np.arange(len(fp)))
            yield pa.RecordBatch.from_arrays([pa.array(fp[child]), pa.array(fp[root[child]])], names=["u", "v"])

    return groups.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(join, "u long, v long")


def simhash_groups(docs: DataFrame, words: int = 3, max_bits: int = 3) -> DataFrame:
    """(doc_id, fp, component_id) for each row of `docs` (doc_id, text)."""
    prepare(docs.sparkSession)
    prints = cut(fingerprints(docs, words), "simhash-prints")
    classes = cut(prints.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "simhash-classes")
    tree = connected_components(linked(classes.select("fp"), max_bits), "simhash-links")
    named = classes.join(tree, classes.fp == tree.id, "left").select("fp", "first_id", F.coalesce("root", "fp").alias("root"))
    named = cut(named, "simhash-named")
    first = cut(named.groupBy("root").agg(F.min("first_id").alias("component_id")), "simhash-first")
    of_print = cut(join_hot(named, first, ["root"]).select("fp", "component_id"), "simhash-components")
    return join_hot(prints, of_print, ["fp"]).select("doc_id", "fp", "component_id")


def shingles(text: bytes, words: int = 5) -> np.ndarray:
    """The distinct hashes of the word shingles, sorted; fewer words are one shingle, none have none."""
    found = WORD.findall(text.translate(LOWER))
    if not found:
        return np.empty(0, np.uint64)
    joined = b" ".join(found)
    size = np.fromiter(map(len, found), np.int64, len(found))
    end = np.cumsum(size + 1) - 1
    n = max(1, len(found) - words + 1)
    start, stop = (end - size)[:n].tolist(), (end[words - 1 :] if len(found) >= words else end[-1:]).tolist()
    digest = xxhash.xxh64_intdigest
    return np.unique(np.fromiter((digest(joined[a:b], 42) for a, b in zip(start, stop, strict=True)), np.uint64, n))


def name_of(h: np.ndarray) -> tuple[int, int]:
    """128 bits, as two longs, that name a set of shingles."""
    n = xxhash.xxh3_128_intdigest(h.tobytes(), 42)
    return (n >> 64) - (1 << 63), (n & (1 << 64) - 1) - (1 << 63)


def least_print(h: np.ndarray) -> np.ndarray:
    """64 bytes as eight longs, each byte of the least hash of the set under its own function; zero for no shingles."""
    if not len(h):
        return np.zeros(8, np.int64)
    low = np.full(64, np.iinfo(np.uint64).max, np.uint64)
    for at in range(0, len(h), 1024):
        z = h[at : at + 1024, None] * FACTORS
        z ^= z >> np.uint64(29)
        z *= np.uint64(0xBF58476D1CE4E5B9)
        z ^= z >> np.uint64(32)
        np.minimum(low, z.min(0), out=low)
    return low.astype(np.uint8).view(np.int64)


def similar_sets(groups: np.ndarray, sets: pa.BinaryArray, apart: Callable[..., np.ndarray], similarity: float) -> np.ndarray:
    """Labels of the rows after joining all pairs in runs of equal `groups` whose sets are similar; connected pairs are not compared again."""
    root = np.arange(len(groups))
    at = np.frombuffer(sets.buffers()[1], np.int32)[sets.offset : sets.offset + len(sets) + 1] // 8
    h, size = np.frombuffer(sets.buffers()[2] or b"", np.uint64), np.diff(at)

    def like(u: int, v: int) -> bool:
        a, b = h[at[u] : at[u + 1]], h[at[v] : at[v + 1]]
        both = int((a[np.minimum(a.searchsorted(b), len(a) - 1)] == b).sum()) if len(a) else 0
        return both >= similarity * (len(a) + len(b) - both) - 1e-9

    for u, v in pairs_in_runs(groups):
        near = apart(u, v) & (np.minimum(size[u], size[v]) >= similarity * np.maximum(size[u], size[v]) - 1e-6)
        u, v = u[near], v[near]
        while len(u):
            live = root[u] != root[v]
            u, v = u[live], v[live]
            a, b = u[:4096], v[:4096]
            kept = np.fromiter(map(like, a.tolist(), b.tolist()), bool, len(a))
            root = forest(len(groups), a[kept], b[kept], root)
            u, v = u[4096:], v[4096:]
    return root


def similar_classes(docs: DataFrame, words: int = 5, similarity: float = 0.8, block: int = 2048, least: int = 32) -> DataFrame:
    """(doc_id, mark, root) for each row of `docs`: mark is a hash of its text, root names its group."""
    prepare(docs.sparkSession)
    lanes = [f"p{k}" for k in range(8)]
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("mark"), "text")

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            p, name = np.empty((b.num_rows, 8), np.int64), np.empty((b.num_rows, 2), np.int64)
            for k, t in enumerate(utf8_of(b.column(2))):
                h = shingles(t, words)
                p[k], name[k] = least_print(h), name_of(h)
            columns = [pa.array(np.ascontiguousarray(v)) for v in (*name.T, *p.T)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), *columns], names=["doc_id", "mark", "a", "b", *lanes])

    prints = cut(docs.mapInArrow(each, ", ".join(f"{c} long" for c in ["doc_id", "mark", "a", "b", *lanes])), "wide-prints")
    rows = prints.count()
    shown = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "mark")).alias("shown")
    classes = prints.groupBy("a", "b").agg(shown, *(F.first(c).alias(c) for c in lanes)).withColumn("node", F.monotonically_increasing_id())
    classes = cut(gathered(classes, rows, 100_000), "wide-classes")

    def byte(k: int) -> F.Column:
        return F.shiftrightunsigned(lanes[k // 8], 8 * (k % 8)).bitwiseAND(F.lit(255).cast("long"))

    keys = [((F.lit(n).cast("long") * 256 + byte(3 * n)) * 256 + byte(3 * n + 1)) * 256 + byte(3 * n + 2) for n in range(21)]
    postings = classes.select("node", *lanes, F.explode(F.array(*keys)).alias("list"))
    groups = spread_lists(postings, "list", "node", block).select("list", "i", "j", "own", "node", *lanes)

    def grouped(t: pa.Table, key: str) -> tuple[np.ndarray, Callable[..., np.ndarray]]:
        k, i, j, own = (t.column(c).to_numpy() for c in (key, "i", "j", "own"))
        new = np.r_[True, (np.diff(k) != 0) | (np.diff(i) != 0) | (np.diff(j) != 0)]
        return np.cumsum(new), lambda u, v: (i[u] == j[u]) | (own[u] != own[v])

    def links(node: np.ndarray, root: np.ndarray) -> pa.RecordBatch:
        child = np.flatnonzero(root != np.arange(len(node)))
        return pa.RecordBatch.from_arrays([pa.array(node[child]), pa.array(node[root[child]])], names=["u", "v"])

    def join(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["list", "i", "j"], 16384):
            node = t.column("node").to_numpy()
            x = np.stack([t.column(c).to_numpy() for c in lanes], 1).view(np.uint8)
            run, apart = grouped(t, "list")
            root = np.arange(len(node))
            for a, b in pairs_in_runs(run):
                for at in range(0, len(a), 200_000):
                    u, v = a[at : at + 200_000], b[at : at + 200_000]
                    kept = apart(u, v) & (root[u] != root[v])
                    u, v = u[kept], v[kept]
                    kept = (x[u] == x[v]).sum(1) >= least
                    root = forest(len(node), u[kept], v[kept], root)
            yield links(node, root)

    found = groups.repartition("list", "i", "j").sortWithinPartitions("list", "i", "j").mapInArrow(join, "u long, v long")
    loose = classes.join(connected_components(found, "wide-candidates"), F.col("node") == F.col("id"))

    def known(c: str) -> F.Column:
        return F.coalesce(c, F.lit(-(1 << 63)))

    wanted = loose.select(known("shown.doc_id").alias("of"), F.col("shown.mark").alias("mark"), "a", "b", "node", "root")
    texts = docs.withColumn("of", known("doc_id")).join(wanted, ["of", "mark"]).select("text", "a", "b", "node", "root")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                b = whole.slice(at, 256)
                h = [shingles(t, words) for t in utf8_of(b.column(0))]
                name = np.array([name_of(x) for x in h], np.int64).reshape(-1, 2)
                right = (name[:, 0] == b.column(1).to_numpy()) & (name[:, 1] == b.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([b.column(3), b.column(4), pa.array([x.tobytes() for x in h], pa.binary())], names=["node", "root", "h"]).filter(pa.array(right))

    members = cut(texts.mapInArrow(sets, "node long, root long, h binary").dropDuplicates(["node"]), "wide-sets")
    # Sets are cut into blocks by their bytes: a group of long texts is more blocks, not larger ones.
    spread = spread_lists(members, "root", "node", SET_BYTES, weight=F.length("h") + 64).select("root", "i", "j", "own", "node", "h")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for t in runs(batches, ["root", "i", "j"], 1024):
            run, apart = grouped(t, "root")
            yield links(t.column("node").to_numpy(), similar_sets(run, t.column("h").combine_chunks(), apart, similarity))

    exact = spread.repartition("root", "i", "j").sortWithinPartitions("root", "i", "j").mapInArrow(verify, "u long, v long")
    tree = connected_components(exact, "wide-links")
    named = cut(classes.join(tree, classes.node == tree.id, "left").select("a", "b", F.coalesce("root", "node").alias("root")), "wide-named")
    return join_hot(prints.select("doc_id", "mark", "a", "b"), named, ["a", "b"]).select("doc_id", "mark", "root")


def similar_groups(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """(doc_id, component_id) for each row of `docs`: groups linked at the similarity or more."""
    rows = cut(similar_classes(docs, words, similarity), "wide-groups")
    first = cut(rows.groupBy("root").agg(F.min("doc_id").alias("component_id")), "wide-first")
    return join_hot(rows, first, ["root"]).select("doc_id", "component_id")


def keep_one(docs: DataFrame, words: int = 5, similarity: float = 0.8) -> DataFrame:
    """The rows of `docs`, one document of each group: that with the smallest id.

    A group keeps one row, also where its smallest id is that of other texts too: these are in groups of their own.
    Rows with a null id are kept as they are. Other columns pass through, whatever their names.
    """
    groups = similar_classes(docs, words, similarity)
    kept = groups.where("doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("k")).select(F.col("k.doc_id").alias("of"), F.col("k.mark").alias("mark"))
    rows = nest(docs, "doc_id", "text").withColumns({"of": F.col("doc_id").cast("long"), "mark": F.xxhash64("text")})
    whole = "rest" in rows.columns and "map<" not in rows.schema["rest"].dataType.simpleString()  # maps have no hash
    order = Window.partitionBy("of", "mark").orderBy(F.xxhash64("rest" if whole else "text"))
    chosen = rows.where("of is not null").join(kept, ["of", "mark"], "left_semi").withColumn("copy", F.row_number().over(order)).where("copy = 1")
    return unnest(chosen.unionByName(rows.where("of is null"), allowMissingColumns=True), docs, "doc_id", "text")
