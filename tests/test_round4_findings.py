"""Larger and odd inputs on which queries of round 4 went wrong."""

from __future__ import annotations

import hashlib
import random

from lodestar.operators import spatial

SEGMENTS = "line_id long, seq long, x1 long, y1 long, x2 long, y2 long"


def plain_crossings(rows):
    side = lambda o, t, e: (o[4] - o[2]) * (t[2 * e + 1] - o[3]) - (o[5] - o[3]) * (t[2 * e] - o[2])
    found = set()
    for p in rows:
        for q in rows:
            if p[0] < q[0] and side(p, q, 1) * side(p, q, 2) < 0 and side(q, p, 1) * side(q, p, 2) < 0:
                t = side(q, p, 1) / (side(q, p, 1) - side(q, p, 2))
                x, y = p[2] + t * (p[4] - p[2]), p[3] + t * (p[5] - p[3])
                if all((x - o[2 * e]) ** 2 + (y - o[2 * e + 1]) ** 2 > 1 for o in (p, q) for e in (1, 2)):
                    found.add((int((x + 0.5) // 1), int((y + 0.5) // 1)))
    return found


def test_crossings_are_dealt_to_many_tasks_by_bins_and_blocks(spark, monkeypatch):
    """All pairs once met in one task: 2,000 segments took half a minute."""
    monkeypatch.setattr(spatial, "BLOCK", 8)
    rnd = random.Random(4)
    rows = [(k % 4, k, *(rnd.randrange(1200) for _ in range(4))) for k in range(160)]
    found = spatial.crossings(spark.createDataFrame(rows, SEGMENTS), 500)
    assert {(r.x, r.y) for r in found.collect()} == plain_crossings(rows)
    assert found.count() == len(plain_crossings(rows))
    assert "RepartitionByExpression" in found._jdf.queryExecution().optimizedPlan().toString()


def test_a_crossing_on_the_border_of_two_bins_is_kept(spark):
    """Its x comes out a bit below 500, in a bin where the upright segment is not."""
    rows = [(1, 1, 13, 842, 778, 514), (2, 1, 500, 505, 500, 995)]
    assert [tuple(r) for r in spatial.crossings(spark.createDataFrame(rows, SEGMENTS), 500).collect()] == [(500, 633)]


def test_cells_near_a_crossing_on_a_border(spark, tmp_path):
    from lodestar.plans.composed_queries import d18_crossings_near

    ends = [(1, 1, 13, 842), (2, 1, 778, 514), (3, 2, 500, 505), (4, 2, 500, 995)]
    rows = [(k, label, [(x + 0.5) / 10000, (y + 0.5) / 10000, 0.0]) for k, label, x, y in ends]
    spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>").write.parquet(f"file://{tmp_path}/embeddings.parquet")
    near = {r.cell_id: round(r.nearest**2) for r in d18_crossings_near(spark, f"file://{tmp_path}").where("n = 1").collect()}
    centres = {f"{i:04d}_{j:04d}": (-2750 + 500 * i, -2750 + 500 * j) for i in range(12) for j in range(12)}
    assert near == {k: (500 - x) ** 2 + (633 - y) ** 2 for k, (x, y) in centres.items() if (500 - x) ** 2 + (633 - y) ** 2 <= 400**2}
    assert near


def test_many_digests_at_once():
    from lodestar.functions.digests import low_half

    heads = [b"", *(f"{k}-".encode() for k in (0, 7, 12, 345, 99_999, 1_234_567)), *(b"x" * k for k in range(40, 70)), *(f"{k}-".encode() for k in range(90, 120))]
    tails = [f"{k}-3".encode() for k in (0, 5, 9, 10, 11, 99, 100, 9_999, 3, 10_000)]
    want = [[hashlib.md5(h + t).hexdigest()[0] < "8" for t in tails] for h in heads]
    assert low_half(heads, tails).tolist() == want
    assert low_half(heads, []).shape == (len(heads), 0)


def permuted(rows, draws, seed):
    """The test in plain Python: rows are (id, a, b, label)."""

    def rank(k):
        values = [r[k] for r in rows]
        return [sum(w < v for w in values) + (sum(w == v for w in values) + 1) / 2 for v in values]

    def precision(scores):
        seen = hits = total = 0
        for v in sorted(set(scores), reverse=True):
            here = [r[3] == 1 for r, s in zip(rows, scores, strict=True) if s == v]
            seen, hits = seen + len(here), hits + sum(here)
            total += sum(here) * hits / seen
        return total / hits

    a, b = rank(1), rank(2)
    d = []
    for rep in range(-1, draws):
        swap = [rep >= 0 and hashlib.md5(f"{r[0]}-{rep}-{seed}".encode()).hexdigest()[0] < "8" for r in rows]
        first, second = ([y if s == way else x for x, y, s in zip(a, b, swap, strict=True)] for way in (True, False))
        d.append(precision(first) - precision(second))
    return d[0], (sum(v >= d[0] - 1e-12 for v in d[1:]) + 1) / (draws + 1)


def test_permutation_is_counted_by_rank_not_by_draw(spark, monkeypatch):
    """Each draw of each row was once two rows: 40 million for 4,000 labelled rows."""
    from lodestar.operators import sampling

    monkeypatch.setattr(sampling, "ROWS", 40)  # several blocks
    monkeypatch.setattr(sampling, "COUNTS", 200)  # and a few replicates at a time
    rnd = random.Random(9)
    rows = [(k * 7, float(rnd.randrange(6)), float(rnd.randrange(9)), int(rnd.random() < 0.4)) for k in range(120)]
    rows += rows[:3]  # equal rows draw alike
    df = spark.createDataFrame(rows, "id long, a double, b double, y int")
    got = sampling.rank_permutation(df, "id", "a", "b", "y", 130, 3, sampling.portable).first()
    observed, p_value = permuted(rows, 130, 3)
    assert abs(got.observed - observed) < 1e-12 and got.p_value == p_value
    monkeypatch.setattr(sampling, "ROWS", 1000)
    ranked = df.selectExpr("concat(id, '-') AS head", "y = 1 AS pos", "a AS __ra", "b AS __rb")
    counts = sampling._swapped(ranked, 130, 3, sampling.portable)
    assert counts.count() == 131 * len({r[1] for r in rows} | {r[2] for r in rows})


def test_permutation_with_one_class_has_nothing_to_compare(spark):
    """As the SQL has it: no replicate counts."""
    from lodestar.operators import sampling

    df = spark.createDataFrame([(1, 0.5, 0.1, 1), (2, 0.2, 0.3, 1)], "id long, a double, b double, y int")
    for draw_of in (sampling.portable, sampling.uniform):
        assert tuple(sampling.rank_permutation(df, "id", "a", "b", "y", 20, 3, draw_of).first()) == (None, 1.0)
