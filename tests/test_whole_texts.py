"""Queries that read whole texts, against brute force on a small fixture: what differs comes late in the text."""

from __future__ import annotations

import math
import random
from collections import Counter

import pytest

from lodestar import plans


@pytest.fixture(scope="module")
def texts(spark, tmp_path_factory):
    rng, d = random.Random(3), str(tmp_path_factory.mktemp("texts"))
    docs = [(i, " ".join(f"w{rng.randrange(60)}x" for _ in range(rng.randint(5, 40))), rng.choice(["en", "de"])) for i in range(80)]
    items = [(i, " ".join(["common"] * 9 + [f"w{rng.randrange(60)}x" for _ in range(20)] + [f"w{i}x"] * i)) for i in range(6)]
    spark.createDataFrame(docs, "doc_id long, text string, lang string").write.parquet(f"{d}/documents.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    return d, docs, items


def test_bm25_reads_whole_queries(spark, texts):
    d, docs, items = texts
    bags = {i: Counter(t.split()) for i, t, _ in docs}
    length = {i: sum(b.values()) for i, b in bags.items()}
    mean, df = sum(length.values()) / len(docs), Counter(w for b in bags.values() for w in b)
    want = {}
    for q, text in items:
        score = {}
        for i, bag in bags.items():
            for w, n in Counter(text.split()).items():
                if w in bag:
                    idf = math.log(1 + (len(docs) - df[w] + 0.5) / (df[w] + 0.5))
                    score[i] = score.get(i, 0) + idf * bag[w] * 2.5 / (bag[w] + 1.5 * (0.25 + 0.75 * length[i] / mean)) * min(n, 3)
        best = sorted(score, key=lambda i: (-round(score[i], 9), i))[:5]
        want |= {(q, i, k + 1): pytest.approx(score[i], abs=2e-6) for k, i in enumerate(best)}
    got = plans.queries()["m2_bm25"](spark, d).collect()
    assert {(r.query_id, r.id, r["rank"]): r.score for r in got} == want


def test_tiers_read_whole_queries(spark, texts):
    d, docs, items = texts
    want = set()
    for q, text in items:
        for tier in (1, 2):
            hits = {i: len(set(t.split()) & set(text.split())) for i, t, lang in docs if (lang == "en") == (tier == 1)}
            best = sorted((i for i in hits if hits[i]), key=lambda i: (-hits[i], i))[:3]
            want |= {(q, i, tier, hits[i], k + 1) for k, i in enumerate(best)}
    assert {tuple(r) for r in plans.queries()["m7_tiered_retrieval"](spark, d).collect()} == want


def test_sliding_grams_read_all_words_and_sizes(spark, texts):
    d, _, items = texts
    want = {(i, k, len({tuple(w[a : a + k]) for a in range(len(w) - k + 1)})) for i, t in items for w in [t.split(" ")] for k in range(1, 7)}
    assert {tuple(r) for r in plans.queries()["f15_sliding_grams"](spark, d).collect()} == want
