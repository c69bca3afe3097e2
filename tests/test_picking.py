"""The pick under counters against the sequential one; reserves that are extended."""

from __future__ import annotations

import random
from collections import Counter

from lodestar.operators import picking


def sequential(rows, eras, per_era, cap, least):
    rows = sorted((r for r in rows if r[1] in eras), key=lambda r: (-(r[4] if r[4] is not None else float("-inf")), r[0]))
    rows = [(i, e, c or "", bool(z), s) for i, e, c, z, s in rows]
    chosen, era, comp = [], Counter(), Counter()
    for r in rows:
        if era[r[1]] < per_era and comp[r[2]] < cap:
            chosen.append(r)
            era[r[1]] += 1
            comp[r[2]] += 1
    at = {r[0]: k for k, r in enumerate(rows)}
    for r in rows:
        if sum(c[3] for c in chosen) >= least:
            break
        if not r[3] or r in chosen:
            continue
        for v in sorted((c for c in chosen if c[1] == r[1] and not c[3]), key=lambda c: -at[c[0]]):
            if comp[r[2]] - (v[2] == r[2]) < cap:
                chosen.remove(v)
                chosen.append(r)
                comp[v[2]] -= 1
                comp[r[2]] += 1
                break
    return {r[0] for r in chosen}


def test_the_pick_equals_the_sequential_one(spark):
    rng, eras = random.Random(6), ["old", "mid", "new"]
    swapped = 0
    for k in range(10):
        few, rare = rng.choice([2, 4, 30]), rng.choice([0.02, 0.2])
        rows = [(i, rng.choice([*eras, "none"]), rng.choice([f"c{j}" for j in range(few)] + [None]), rng.random() < rare or None, rng.choice([None, *range(12)]) if k % 2 else rng.random()) for i in range(rng.choice([6, 60, 250]))]
        df = spark.createDataFrame([(i, e, c, z, None if s is None else float(s)) for i, e, c, z, s in rows], "id long, era string, company string, zone boolean, score double").repartition(5)
        got = picking.greedy_pick(df, eras, 4, 2, 3).collect()
        assert {r.id for r in got} == sequential(rows, eras, 4, 2, 3), k
        swapped += any(r.how != "ranked" for r in got)
        for e in eras:
            assert sorted(r.place for r in got if r.era == e) == list(range(1, sum(r.era == e for r in got) + 1))
    assert swapped


def test_what_is_unmet(spark):
    rows = spark.createDataFrame([(1, "old", "a", True, 3.0), (2, "old", "a", False, 2.0), (3, "new", "a", False, 1.0)], "id long, era string, company string, zone boolean, score double")
    got = picking.greedy_pick(rows, ["old", "new"], 2, 2, 2)
    assert {tuple(r) for r in picking.unmet(got, ["old", "new"], 2, 2, 2).collect()} == {("per_era", "new", 0), ("min_zone", "", 1)}
    assert picking.greedy_pick(rows.where("false"), ["old"], 2, 2, 1).count() == 0


def test_reserves_are_extended_until_enough_pass(spark):
    rng = random.Random(4)
    rows = [(i, f"e{i % 7}", rng.choice([None, 1.0, 2.0, rng.random()]), rng.choice([True, False, False, None])) for i in range(180)] + [(900, "tiny", 1.0, False), (901, None, 1.0, True)]
    got = {}
    for r in picking.extended(spark.createDataFrame(rows, "id long, era string, score double, passes boolean").repartition(6), 4, 3, 4, 14).collect():
        got.setdefault(r.era, []).append((r["rank"], r.id, r.extended))
    for era in {r[1] for r in rows} - {None}:
        order = sorted((r for r in rows if r[1] == era), key=lambda r: (r[2] is None, -(r[2] or 0), r[0]))
        n = 4
        while sum(bool(r[3]) for r in order[:n]) < 4 and n < 14 and n < len(order):
            n += 3
        assert sorted(got[era]) == [(k + 1, r[0], k >= 4) for k, r in enumerate(order[:n])], era
