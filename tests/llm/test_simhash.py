from __future__ import annotations

import random

import numpy as np
import xxhash
from pyspark.sql import functions as F

from lodestar.llm import simhash


def brute_print(text):
    words = "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")
    for c in "\t\n\x0b\x0c\r":
        words = words.replace(c, " ")
    words = [w for w in words.split(" ") if w]
    if not words:
        return 0
    grams = [" ".join(words[i : i + 3]) for i in range(max(1, len(words) - 2))]
    h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_groups(prints):
    root = list(range(len(prints)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= 3:
                root[find(i)] = find(j)
    return [find(i) for i in range(len(prints))]


def test_fingerprint_matches_definition():
    texts = ["", " \t\n", "One", "one TWO", "a b c", "Ä ä\x0bB c d e" * 5, "the cat sat " * 200, "  x y z w"]
    for t in texts:
        assert simhash.fingerprint(t.encode()) == brute_print(t)


def test_groups_equal_all_pairs(spark):
    rng = random.Random(4)
    base = ["".join(rng.choice("abcdefgh") for _ in range(rng.randint(2, 7))) for _ in range(400)]
    texts = [None, "", "  ", "word", "word", "two words"]
    for _ in range(25):
        words = [rng.choice(base) for _ in range(rng.randint(40, 400))]
        texts.append(" ".join(words))
        for _ in range(rng.randint(0, 5)):
            w = list(words)
            w[rng.randrange(len(w))] = "changed"
            texts.append(" ".join(w))
    docs = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, fp string")
    got = {r.doc_id: r for r in simhash.simhash_groups(docs).collect()}
    prints = [brute_print(t) for t in texts]
    roots = brute_groups(prints)
    first = {r: min(i for i, x in enumerate(roots) if x == r) for r in set(roots)}
    assert {i: (r.fp % (1 << 64), r.component_id) for i, r in got.items()} == {i: (p, first[roots[i]]) for i, p in enumerate(prints)}


def test_links_at_three_bits_and_in_long_lists(spark):
    rng = np.random.default_rng(1)
    centre = int(rng.integers(0, 1 << 63))
    prints = {centre}
    for n in range(1, 6):
        for _ in range(60):
            x = centre
            for b in rng.choice(64, n, replace=False):
                x ^= 1 << int(b)
            prints.add(x)
    prints = sorted(p - (1 << 64) if p >> 63 else p for p in prints)
    fps = spark.createDataFrame([(p,) for p in prints], "fp long")
    from lodestar.llm.common import connected_components

    tree = {r.id: r.root for r in connected_components(simhash.linked(fps, block=16), "test").collect()}
    roots = brute_groups([p % (1 << 64) for p in prints])
    groups = {}
    for p, r in zip(prints, roots):
        groups.setdefault(r, set()).add(p)
    want = {frozenset(g) for g in groups.values() if len(g) > 1}
    found = {}
    for p, r in tree.items():
        found.setdefault(r, set()).add(p)
    assert {frozenset(g) for g in found.values()} == want


def test_keep_one_and_odd_rows(spark):
    rows = [(1, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (2, "a b c d e f g", "en"), (None, "a b c d e f g", None), (5, None, None), (6, "", "de"), (9, "other words are here now", "x"), (9, "other words are here now", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, component_id string")
    kept = simhash.keep_one(docs).collect()
    assert sorted((r.doc_id is not None, r.doc_id or 0) for r in kept) == [(False, 0), (True, 1), (True, 5), (True, 9)]
    assert simhash.keep_one(docs).columns == docs.columns
    assert simhash.simhash_groups(docs.where(F.lit(False))).count() == 0


def similar_texts():
    rng = random.Random(8)
    texts = [None, "", "one two", "one two"]
    for n in (10, 20, 20, 20, 40, 40, 100, 100, 300, 1000):
        for part in range(12):
            words = [f"w{rng.randrange(10**6)}" for _ in range(n + 4)]
            texts.append(" ".join(words))
            for cut in (0.6, 0.667, 0.7, 0.75, 0.78, 0.8, 0.82, 0.9, 1.0):
                if rng.random() < 0.35:
                    gone = round(n * (1 - cut) / (1 + cut)) if part % 2 else int(n * (1 - cut))
                    texts.append(" ".join([f"x{rng.randrange(10**6)}" for _ in range(gone if part % 2 else 0)] + words[gone:]))
    return texts


def brute_similar(texts, least=0.8):
    sets = []
    for t in texts:
        w = (t or "").lower().split()
        sets.append({tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set())
    root = list(range(len(sets)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(sets)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 10 * both >= round(10 * least) * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(sets))]


def test_similar_groups_equal_all_pairs(spark):
    texts = similar_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.component_id for r in simhash.similar_groups(docs).collect()}
    assert got == dict(enumerate(brute_similar(texts)))


def test_keep_one_with_repeated_ids(spark):
    one, two, three = ("alpha beta gamma delta epsilon", "quite other words stand here now", "a third text is here as well")
    rows = [(3, one), (3, two), (3, two), (4, one), (2, three), (7, three), (7, two)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(tuple(r) for r in simhash.keep_one(docs).collect()) == [(2, three), (3, one), (3, two)]
