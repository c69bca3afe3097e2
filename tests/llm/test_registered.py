"""The registered queries on the smallest tables, each against a plain recomputation of its contract."""

from __future__ import annotations

import hashlib
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
import xxhash
from pyspark.sql import functions as F
from test_bwt_dedup import brute
from tokenizers import Tokenizer

from lodestar.llm import nbsvm, queries
from lodestar.session import table

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    return pq.read_table(f"{SF}/documents.parquet").to_pylist()


def held(doc_id):
    return zlib.crc32(str(doc_id).encode()) % 4 == 2


def rows_of(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, SF).collect()]


def test_op2(spark, docs):
    got = {r["doc_id"]: r for r in rows_of(spark, "op2_media_shards")}
    assert len(got) == len(docs)
    for d in docs:
        b = (d["text"] or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        r, v = got[d["doc_id"]], np.frombuffer(p, np.uint8)
        assert (r["n_bytes"], r["payload_bytes"], r["payload_sha256"], r["tail_crc32"]) == (len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:]))
        assert r["media_bytes"] > 0 and len(r["media_sha256"]) == 64
        assert r["feature"].startswith(f"n={len(p)};mean={v.mean():.4f};std={v.std():.4f};")


def test_op3(spark, docs):
    want = brute([(d["doc_id"], (d["text"] or "").encode()) for d in docs])
    got = {r["doc_id"]: (r["n_bytes"], r["n_removed"], r["n_spans"], r["kept_sha256"]) for r in rows_of(spark, "op3_bwt_dedup")}
    assert got == want and any(r[1] for r in want.values())


def test_op4_takes_the_rows_of_the_permutation(spark, docs):
    """Weights by a bisection of its own; the order of blocks and documents from the hashes; then a plain walk."""
    got = rows_of(spark, "op4_temperature_mix")
    assert all(len({d["text"] for d in docs if d["doc_id"] == i}) == 1 for i in {d["doc_id"] for d in docs})
    n = {d["doc_id"]: len((d["text"] or "").split()) for d in docs}
    by = defaultdict(list)
    for d in docs:
        by[d["source"]].append(d["doc_id"])
    share = {s: sum(n[i] for i in ids) / sum(n.values()) for s, ids in by.items()}

    def weights(a):
        z = sum(p**a for p in share.values())
        return {s: p**a / z for s, p in share.items()}

    def largest(holds):
        low, high = 0.0, 1.0
        for _ in range(60):
            mid = (low + high) / 2
            low, high = (mid, high) if holds(mid) else (low, mid)
        return low

    entropy = lambda a: -sum(w * math.log(w) for w in weights(a).values())
    a = max(largest(lambda a: entropy(a) >= 0.95 * math.log(len(share))), largest(lambda a: max(w / share[s] for s, w in weights(a).items()) > 2))
    w = weights(a)
    key = F.xxhash64("doc_id", "text", "source")
    order = {(r.doc_id, e): (r[f"h{e}"], r.key) for r in table(spark, SF, "documents").select("doc_id", key.alias("key"), *(F.xxhash64(key, F.lit(e), F.lit(30)).alias(f"h{e}") for e in range(3))).collect() for e in range(3)}
    taken = {(r["doc_id"], r["epoch"]): r["token_start"] for r in got}
    want = {}
    for s, ids in by.items():
        tokens = sum(n[i] for i in ids)
        quota = math.floor(w[s] * sum(n.values()) + 1e-6)
        for e in range(int(quota // tokens) + 1):
            at = 0
            for i in sorted(ids, key=lambda i: order[i, e]):  # one block a source at this size
                if e < quota // tokens or at + n[i] <= quota % tokens:
                    want[i, e] = at
                at += n[i]
    assert taken == want
    assert all(abs(r["weight"] - w[r["source"]]) < 1e-6 for r in got)


def test_op5(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    ids = {d["doc_id"]: whole.encode(d["text"] or "", add_special_tokens=False).ids + [0] for d in docs}
    got, at, fill = rows_of(spark, "op5_packing"), Counter(), Counter()
    for r in sorted(got, key=lambda r: (r["doc_id"], r["start"])):
        own = ids[r["doc_id"]]
        assert r["start"] == at[r["doc_id"]] and r["doc_tokens"] == len(own) and r["length"] > 0
        assert r["ids_crc32"] == zlib.crc32(np.array(own[r["start"] : r["start"] + r["length"]], "<u4").tobytes())
        at[r["doc_id"]] += r["length"]
    assert at == {i: len(v) for i, v in ids.items()}
    for r in sorted(got, key=lambda r: (r["sequence_id"], r["offset"])):
        assert r["offset"] == fill[r["sequence_id"]]
        fill[r["sequence_id"]] += r["length"]
    assert max(fill.values()) <= 1024
    padding = sum(0 if n & (n - 1) == 0 else 1024 - n for n in fill.values())
    assert padding <= 0.02 * sum(fill.values())


def test_op7(spark, docs):
    whole = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    whole.encode_special_tokens = True
    got, at = {r["doc_id"]: r for r in rows_of(spark, "op7_token_table")}, 0
    for d in sorted(docs, key=lambda d: d["doc_id"]):
        ids = np.array(whole.encode(d["text"] or "", add_special_tokens=False).ids + [2], "<u4")
        r = got[d["doc_id"]]
        assert (r["start"], r["n_tokens"], r["ids_crc32"]) == (at, len(ids), zlib.crc32(ids.tobytes()))
        at += len(ids)


def test_op8(spark, docs):
    fp = {}
    for d in docs:
        lower = "".join(c.lower() if "A" <= c <= "Z" else c for c in d["text"] or "")
        words = [w for w in lower.translate(dict.fromkeys([32, *range(9, 14)], " ")).split(" ") if w]
        grams = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
        h = [xxhash.xxh64_intdigest(g.encode(), 42) for g in grams]
        fp[d["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))
    ids = sorted(fp)
    component = {}
    for i in ids:
        if i not in component:
            todo = [i]
            component[i] = i
            while todo:
                a = todo.pop()
                for b in ids:
                    if b not in component and (fp[a] ^ fp[b]).bit_count() <= 3:
                        component[b] = i
                        todo.append(b)
    assert {(r["doc_id"], r["fingerprint"], r["component_id"]) for r in rows_of(spark, "op8_simhash")} == {(i, f"{fp[i]:016x}", component[i]) for i in ids}


def test_op9(spark, docs):
    """Ranks and out-of-place distances with plain counters."""

    def grams(text):
        c = Counter()
        s = " " + "".join(x if x.isalpha() else " " for x in (text or "").lower()) + " "
        s = " ".join(s.split())
        if s:
            s = f" {s} "
            for k in (1, 2, 3):
                c.update(s[i : i + k] for i in range(len(s) - k + 1) if s[i : i + k] != " ")
        return c

    def ranks(c):
        code = lambda g: sum(ord(x) << 21 * (len(g) - 1 - i) for i, x in enumerate(g))
        return {g: r for r, (g, _) in enumerate(sorted(c.items(), key=lambda x: (-x[1], code(x[0])))[:400])}

    learned = defaultdict(Counter)
    for d in docs:
        if not held(d["doc_id"]) and d["lang"] is not None and d["text"] is not None:
            learned[d["lang"]] += grams(d["text"])
    profile = {k: ranks(v) for k, v in learned.items()}
    got = {r["doc_id"]: r for r in rows_of(spark, "op9_rank_lang")}
    for d in docs:
        own, r = ranks(grams(d["text"])), got[d["doc_id"]]
        far = {k: sum(min(400, abs(p[g] - at)) if g in p else 400 for g, at in own.items()) for k, p in profile.items()}
        assert r["held_out"] == held(d["doc_id"])
        if own:
            best = min(far.items(), key=lambda x: (x[1], x[0]))
            assert (r["lang_pred"], round(r["score"], 9)) == (best[0], round(1 - best[1] / (400 * len(own)), 9))
        else:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)


def buckets(text, bits=17):
    """The features by their definition, one n-gram at a time."""
    t, mask = [ord(c) for c in text or ""], (1 << 64) - 1
    codes = set(t) | {a << 21 | b for a, b in zip(t, t[1:])} | {(a << 21 | b) << 21 | c for a, b, c in zip(t, t[1:], t[2:])}
    words = (text or "").split()
    again = sum(a == b for a, b in zip(words, words[1:]))
    codes |= {(1 << 63) + (1 + min(7, 8 * again // len(words)) if again else 0), (1 << 63) + 100 + (1 if words else 0)}
    return sorted({((c & mask) * 0x9E3779B97F4A7C15 & mask) >> (64 - bits) for c in codes})


def test_op10(spark, docs):
    model = nbsvm.fit(table(spark, SF, "documents"), table(spark, SF, "labels"))
    got = {r["doc_id"]: r for r in rows_of(spark, "op10_nbsvm")}
    for d in docs:
        x = buckets(d["text"])
        v = model["ratio"][x]
        z = model["slope"] * (model["weights"][x] @ v / max(math.sqrt(v @ v), 1e-12) + model["weights"][-1]) + model["base"]
        r = got[d["doc_id"]]
        assert abs(r["score"] - 1 / (1 + math.exp(-z))) < 1e-9
        assert r["held_out"] == held(d["doc_id"]) and r["predicted"] == (r["score"] >= 0.7)


def test_op10_ratios_and_duality_gap():
    rng = np.random.default_rng(4)
    rows = [np.sort(rng.choice(64, 12, replace=False)) for _ in range(120)]
    y = np.array([1 if (r < 24).sum() + rng.normal() > 4.5 else -1 for r in rows])
    up, down = np.ones(64), np.ones(64)
    for r, s in zip(rows, y):
        (up if s > 0 else down)[r] += 1
    ratio = np.log(up / up.sum()) - np.log(down / down.sum())
    w, alpha = nbsvm.descend(rows, y, ratio, 1.0, 500, 1)
    x = np.zeros((len(rows), 65))
    for i, r in enumerate(rows):
        x[i, r] = ratio[r] / np.sqrt(ratio[r] @ ratio[r])
    x[:, 64] = 1
    most = np.where(y > 0, len(y) / (2 * (y > 0).sum()), len(y) / (2 * (y < 0).sum()))
    assert np.allclose(w, x.T @ (alpha * y)) and (alpha >= 0).all() and (alpha <= most + 1e-12).all()
    primal = w @ w / 2 + (most * np.maximum(0, 1 - y * (x @ w))).sum()
    dual = alpha.sum() - w @ w / 2
    assert 0 <= primal - dual + 1e-9 < 0.01 * primal
