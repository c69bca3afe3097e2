"""Every stage of the pipeline on the smallest tables against a plain recomputation from the stage's own input."""

from __future__ import annotations

import math
import zlib
from collections import Counter

import corpus_pipeline
import numpy as np
import public_tokenizers
from test_bwt_dedup import brute
from test_registered import SF, buckets
from test_simhash import brute_similar
from tokenizers import Tokenizer

from lodestar.llm import nbsvm
from lodestar.session import cut, table


def test_stages_against_plain_recomputation(spark):
    stages = dict(corpus_pipeline.STAGES)
    docs = table(spark, SF, "documents")
    model = nbsvm.fit(docs, table(spark, SF, "labels"))
    quality = cut(stages["quality"](spark, docs, SF), "t-quality")
    for r in docs.collect():
        x = buckets(r.text)
        v = model["ratio"][x]
        z = model["slope"] * (model["weights"][x] @ v / max(math.sqrt(v @ v), 1e-12) + model["weights"][-1]) + model["base"]
        r_kept = 1 / (1 + math.exp(-z)) >= 0.7
        assert quality.where(f"doc_id = {r.doc_id}").count() == r_kept if r.doc_id % 20 == 0 else True
    rows = sorted((r.doc_id, r.text) for r in quality.collect())
    near = cut(stages["near_duplicates"](spark, quality, SF), "t-near")
    group = brute_similar([t for _, t in rows])  # the first of each group, by place in the order of ids
    want = {rows[g][0] for g in group}
    assert {r.doc_id for r in near.collect()} == want and len(want) < len(rows)
    kept = sorted((r.doc_id, r.text) for r in near.collect())
    clean = cut(stages["repeats"](spark, near, SF), "t-repeats")
    told = brute([(i, t.encode()) for i, t in kept])
    for r in clean.collect():
        n, gone, spans, _ = told[r.doc_id]
        assert n - gone <= len(r.text.encode()) <= n - gone + 6 * spans and r.n_chars == len(r.text)  # whole characters go
    mixed = cut(stages["mixture"](spark, clean, SF), "t-mixture")
    times = Counter((r.doc_id, r.text) for r in mixed.collect())
    assert set(times) <= {(r.doc_id, r.text) for r in clean.collect()} and max(times.values()) <= 3
    whole = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    whole.encode_special_tokens = True
    got, fill = Counter(), Counter()
    ids = {i: whole.encode(t, add_special_tokens=False).ids + [0] for i, t in times}
    for r in stages["packing"](spark, mixed, SF).collect():
        got[r.doc_id] += r.length
        fill[r.sequence_id] += r.length
        assert r.ids_crc32 == zlib.crc32(np.array(ids[r.doc_id][r.start : r.start + r.length], "<u4").tobytes())
    assert got == {i: len(ids[i]) * sum(n for (d, _), n in times.items() if d == i) for i in ids} and max(fill.values()) <= 1024
