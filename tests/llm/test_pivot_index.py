from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from lodestar.llm import pivot_index


def brute(rows, threshold=0.95):
    ids = [r[0] for r in rows]
    vec = [None if r[1] is None or not r[1] or any(x is None or not np.isfinite(x) for x in r[1]) or not any(r[1]) else np.array(r[1], float) for r in rows]
    link = [[j for j in range(len(ids)) if j != i and vec[i] is not None and vec[j] is not None and len(vec[i]) == len(vec[j]) and vec[i] @ vec[j] / np.sqrt((vec[i] @ vec[i]) * (vec[j] @ vec[j])) >= threshold] for i in range(len(ids))]
    out = []
    for i in range(len(ids)):
        seen, todo = {i}, [i]
        while todo:
            for j in link[todo.pop()]:
                if j not in seen:
                    seen.add(j)
                    todo.append(j)
        out.append((ids[i], len(link[i]), min(ids[j] for j in seen)))
    return sorted(out)


def fixture():
    rng = np.random.default_rng(3)
    rows = [(i, rng.normal(size=16).tolist()) for i in range(200)]
    for k in range(40):
        rows.append((300 + k, (np.array(rows[k][1]) + rng.normal(scale=0.05, size=16)).tolist()))
    for k in range(150):  # a dense group
        rows.append((500 + k, (np.array(rows[7][1]) + rng.normal(scale=0.02, size=16)).tolist()))
    rows += [(900 + k, rows[3][1]) for k in range(20)]  # equal vectors
    rows += [(1000, None), (1001, [0.0] * 16), (1002, [float("nan")] + [1.0] * 15), (1003, [float("inf")] + [1.0] * 15), (1004, [None] + [1.0] * 15), (1005, []), (1006, [1.0, 2.0]), (1007, [2.0, 4.0]), (1008, [1e300] * 16), (1009, [1e-300] * 16), (1010, [-0.0, 1.0]), (1011, [0.0, 1.0])]
    return rows


def test_equals_all_pairs(spark):
    rows = fixture()
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = pivot_index.near_vectors(df, block=32).collect()
    found = sorted((r.vec_id, r.n_links, r.component_id) for r in got)
    small = [r for r in rows if r[0] not in (1008, 1009)]  # their squares leave the range of the brute force
    want = brute(small)
    links, all_links = sum(r[1] for r in found), sum(r[1] for r in want)
    assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    by_id = {r[0]: r for r in found}
    assert all(by_id[w[0]][1] <= w[1] for w in want)
    assert links >= 0.99 * all_links
    assert by_id[1008][2] == by_id[1009][2] == 1008
    assert all(by_id[i][1] == 0 for i in (1000, 1001, 1002, 1003, 1004, 1005))


def test_empty_and_extra_columns(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0], 5), (2, [1.0, 0.01], 6)], "vec_id long, embedding array<float>, n_links int")
    assert sorted(map(tuple, pivot_index.near_vectors(df).collect())) == [(1, 1, 1, True), (2, 1, 1, False)]
    assert pivot_index.near_vectors(df.where(F.lit(False))).count() == 0
