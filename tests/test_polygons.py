"""Polygons with holes against plain clipping and against sampling."""

from __future__ import annotations

import math
import random

import pytest

from lodestar.operators import polygons


def clip(ring, x0, y0, x1, y1):
    """A ring cut to a rectangle, one half-plane after the other."""
    for axis, bound, keep in ((0, x0, 1), (0, x1, -1), (1, y0, 1), (1, y1, -1)):
        out = []
        for k, b in enumerate(ring):
            a = ring[k - 1]
            da, db = keep * (a[axis] - bound), keep * (b[axis] - bound)
            if (da >= 0) != (db >= 0):
                t = da / (da - db)
                out.append((a[0] + t * (b[0] - a[0]), a[1] + t * (b[1] - a[1])))
            if db >= 0:
                out.append(b)
        ring = out
        if not ring:
            return []
    return ring


def area(ring):
    return abs(sum((b[0] - a[0]) * (a[1] + b[1]) / 2 for a, b in zip(ring, ring[1:] + ring[:1], strict=True))) if ring else 0.0


def frame(spark, shapes):
    rows = [(k, r, n, float(x), float(y), d) for k, (d, rings) in shapes.items() for r, ring in enumerate(rings) for n, (x, y) in enumerate(ring)]
    return spark.createDataFrame(rows, "poly_id long, ring int, seq int, x double, y double, domain string")


def star(rng, cx, cy, big):
    n = rng.randint(3, 12)
    turns = [2 * math.pi * (k + rng.uniform(-0.2, 0.2)) / n for k in range(n)]  # gaps below a half turn: no side crosses another
    ring = [(cx + big * rng.uniform(0.4, 1) * math.cos(t), cy + big * rng.uniform(0.4, 1) * math.sin(t)) for t in turns]
    return ring[::-1] if rng.random() < 0.5 else ring


def inside(shape, x, y):
    odd = False
    for ring in shape:
        for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
            if (a[1] > y) != (b[1] > y) and x < a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]):
                odd = not odd
    return odd


def test_overlay_equals_clipping(spark):
    rng, shapes = random.Random(5), {}
    for k in range(40):
        cx, cy, big = rng.uniform(-50, 50), rng.uniform(-50, 50), rng.choice([3, 15, 60])
        rings = [[(cx - big, cy - big), (cx + big, cy - big), (cx + big * 0.7, cy + big), (cx - big, cy + big * 0.5)], star(rng, cx, cy - big * 0.2, big * 0.3)]
        shapes[k] = ("d", rings if k % 2 else [star(rng, cx, cy, big)])
    # On the lines of the grid: a rectangle, one with a hole, one that touches only, a ring without area.
    shapes[100] = ("d", [[(0, 0), (20, 0), (20, 30), (0, 30)]])
    shapes[101] = ("d", [[(-20, -20), (-20, 20), (20, 20), (20, -20)], [(-10, -10), (10, -10), (10, 10), (-10, 10)]])
    shapes[102] = ("d", [[(5, 5), (9, 9), (5, 5)]])
    shapes[103] = ("d", [[(-15, 5), (25, 5), (25, 10), (-15, 10)]])
    want = {}
    for k, (_, rings) in shapes.items():
        for i in range(-14, 14):
            for j in range(-14, 14):
                box = (i * 10, j * 10, i * 10 + 10, j * 10 + 10)
                a = area(clip(rings[0], *box)) - sum(area(clip(h, *box)) for h in rings[1:])
                if a > 1e-6:
                    want[k, i, j] = a
    got = {(r.poly_id, r.i, r.j): r.area for r in polygons.overlay(frame(spark, shapes), 10.0).collect()}
    assert set(got) == set(want)
    assert all(got[k] == pytest.approx(want[k], abs=1e-6) for k in want)
    assert {k[1:] for k in got if k[0] == 100} == {(i, j) for i in range(2) for j in range(3)}  # a border that only touches covers none
    whole = {r.poly_id: r.area for r in polygons.areas(frame(spark, shapes)).collect()}
    assert whole[101] == pytest.approx(1200) and 102 not in whole
    moved = {(r.poly_id, r.i, r.j): r.area for r in polygons.overlay(frame(spark, {100: shapes[100]}), 10.0, 5.0, -5.0).collect()}
    assert moved[100, -1, 0] == pytest.approx(25) and sum(moved.values()) == pytest.approx(600)


def test_contacts_bridge_gaps(spark):
    """Two domains 30 apart meet under a tolerance of 50, a third that is 200 away does not; shares of one domain dissolve."""
    shapes = {
        1: ("a", [[(0, 0), (500, 0), (500, 400), (0, 400)]]), 2: ("a", [[(0, 400), (500, 400), (500, 1000), (0, 1000)]]),
        3: ("b", [[(530, 0), (900, 0), (900, 1000), (530, 1000)]]), 4: ("c", [[(1100, 0), (1500, 0), (1500, 1000), (1100, 1000)]]),
        5: ("", [[(-400, 0), (0, 0), (0, 1000), (-400, 1000)]]), 6: (None, [[(0, -300), (900, -300), (900, 0), (0, 0)]]),
    }
    v = frame(spark, shapes)
    outline = [tuple(r) for r in polygons.outline(v, "domain").collect()]
    assert len([r for r in outline if r[0] == "a"]) == 6 and ("a", 0.0, 400.0, 500.0, 400.0) not in outline
    assert {r[0] for r in outline} == {"a", "b", "c"}
    met = {(r.domain, r.other) for r in polygons.contacts(polygons.outline(v, "domain"), 50.0, 250.0).collect()}
    assert met == {("a", "b"), ("b", "a")}
    cells = spark.createDataFrame([("w", 100.0, 500.0), ("on", 515.0, 300.0), ("e", 1300.0, 500.0)], "cell_id string, cx double, cy double")
    got = {r.cell_id: r.value for r in polygons.boundary_distance(cells, v, "domain", 50.0, 250.0).collect()}
    assert got["w"] == pytest.approx(400) and got["on"] == pytest.approx(15)
    assert 760 < got["e"] < 771  # to the side of b, or to the piece along its upper edge next to a
    alone = polygons.boundary_distance(cells, frame(spark, {4: shapes[4]}), "domain", 50.0, 250.0)
    assert {r.value for r in alone.collect()} == {None}


def test_contact_pieces_equal_sampling(spark):
    rng = random.Random(11)
    shapes = {k: ("ab"[k % 2], [star(rng, rng.uniform(0, 300), rng.uniform(0, 300), rng.uniform(20, 90))]) for k in range(14)}
    v = frame(spark, shapes)
    outline = [tuple(r) for r in polygons.outline(v, "domain").collect()]
    got = [tuple(r) for r in polygons.contacts(polygons.outline(v, "domain"), 6.0, 40.0).collect()]

    def gap(p, s):
        dx, dy = s[2] - s[0], s[3] - s[1]
        t = max(0, min(1, ((p[0] - s[0]) * dx + (p[1] - s[1]) * dy) / (dx * dx + dy * dy)))
        return math.hypot(p[0] - s[0] - t * dx, p[1] - s[1] - t * dy)

    for domain, *a in outline:
        mine = [g[2:] for g in got if g[0] == domain]
        for t in (0.03, 0.21, 0.5, 0.77, 0.98):
            p = (a[0] + t * (a[2] - a[0]), a[1] + t * (a[3] - a[1]))
            d = min(gap(p, o[1:]) for o in outline if o[0] != domain)
            if abs(d - 12) > 1e-6:
                assert (d < 12) == any(math.hypot(m[2] - m[0], m[3] - m[1]) > 0 and gap(p, m) < 1e-7 for m in mine)
    for g in got:
        mid = ((g[2] + g[4]) / 2, (g[3] + g[5]) / 2)
        assert min(gap(mid, o[1:]) for o in outline if o[0] == g[1]) <= 12 + 1e-9


def test_classes_hosts_labels_and_empty_maps(spark):
    shapes = {1: ("", [[(0, 0), (10, 0), (10, 6), (0, 6)]]), 2: ("Pelitic gneiss", [[(0, 6), (10, 6), (10, 10), (0, 10)]]), 3: ("Granite", [[(10, 0), (20, 0), (20, 10), (10, 10)]]), 4: ("Granite", [[(20, 0), (25, 0), (25, 10), (20, 10)]]), 5: ("Pelitic gneiss", [[(25, 0), (30, 0), (30, 10), (25, 10)]])}
    v = frame(spark, shapes)
    named = v.select("poly_id", "domain").distinct()
    cells = spark.createDataFrame([("a", 5.0, 5.0, False), ("b", 15.0, 5.0, True), ("c", 25.0, 5.0, None), ("d", 35.0, 5.0, False)], "cell_id string, cx double, cy double, hidden boolean")
    covered = polygons.cover(cells, v, named, 10.0)
    assert {r.cell_id: (r.value_text, r.n_obs) for r in polygons.largest_class(cells, covered, "domain").collect()} == {"a": (None, 2), "b": ("Granite", 1), "c": ("Granite", 2), "d": (None, 0)}
    assert {r.cell_id: r.value for r in polygons.host(cells, covered, "domain", ["pelitic"], "hidden").collect()} == {"a": 0.0, "b": None, "c": 0.0, "d": None}
    shares = {(r.cell_id, r.unit): (round(r.share, 6), r["rank"]) for r in polygons.unit_shares(covered, "domain", 10.0).collect()}
    assert shares["c", "Granite"] == (0.5, 1) and shares["c", "Pelitic gneiss"] == (0.5, 2) and shares["a", ""] == (0.6, 1)
    hits = spark.createDataFrame([(1, 35.0, 6.0), (2, 5.0, 5.0)], "id long, x double, y double")
    tiers = {r.cell_id: r.tier for r in polygons.label_tiers(cells, frame(spark, {1: shapes[1]}), 10.0, hits, 2.0).collect()}
    assert tiers == {"a": "deposit", "b": "unlabelled", "c": "unlabelled", "d": "occurrence"}
    none = v.where("false")
    assert polygons.overlay(none, 10.0).count() == 0 and polygons.cover(cells, none, named, 10.0).count() == 0
    assert {r.value_text for r in polygons.largest_class(cells, polygons.cover(cells, none, named, 10.0), "domain").collect()} == {None}
