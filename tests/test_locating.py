"""Locating values and rows against a plain search over all spans and lines."""

from __future__ import annotations

import random

import pytest

from lodestar.operators import locating as loc

FOLD = str.maketrans(loc.FOLD)


def letters(s):
    return "".join(c for c in s.lower() if c in "0123456789abcdefghijklmnopqrstuvwxyz")


def ratio(a, b):
    row = [0] * (len(b) + 1)
    for x in a:
        new = [0]
        for k, y in enumerate(b):
            new.append(row[k] + 1 if x == y else max(row[k + 1], new[k]))
        row = new
    return 200 * row[-1] / (len(a) + len(b)) if a or b else 100.0


def score(value, span):
    raw = " ".join(w[3] for w in span)
    if "".join(raw.lower().split()) == "".join(value.lower().split()):
        return 100.0, "exact"
    want, rb, rf = letters(value), letters(raw), letters(raw.translate(FOLD))
    if rb and rb == want:
        return 99.0, "exact"
    if rf and rf == want:
        return 98.0, "fuzzy"
    if len(span) == 1 and len(want) >= 2:
        for c in (rb, rf):
            if c and c != want and (c.startswith(want) or c.endswith(want)):
                return 90.0, "fuzzy"
    return (max(ratio(rf, want), ratio(rb, want)), "fuzzy") if want else (0.0, "fuzzy")


def best(value, words):
    if not value or not value.split():
        return 0.0, "none", None, None, False
    found = []
    for size in range(1, 7):
        for i in range(len(words) - size + 1):
            span = words[i : i + size]
            middle = [(w[6] + w[8]) / 2 for w in span]
            if len({w[4] for w in span}) > 1 and max(middle) - min(middle) > 0.012:
                continue
            s, method = score(value, span)
            if s >= 82:
                found.append((-s, size, span[0][2], method, span))
    if not found:
        return 0.0, "none", None, None, False
    top = min(found, key=lambda f: f[:3])
    ambiguous = sum(f[:2] == top[:2] for f in found) > 1
    width = min(1, max(w[7] for w in top[4]) + 0.003) - max(0, min(w[5] for w in top[4]) - 0.003)
    return -top[0], "none" if round(width, 5) > 0.6 else top[3], top[2], top[1], ambiguous


def page(rng, pool, lines):
    """Words (pool, page, no, text, line, x0, y0, x1, y1) of a page with numbers, names and look-alikes."""
    out, no = [], 0
    for line in range(lines):
        x = 0.02
        for _ in range(rng.randint(2, 8)):
            text = rng.choice(["12.5", "1,753", "O.O5", "l2.5", "U3O8", "ppm", "from", "1044.8m", "0.05,", "grn", "PLS12-001", "sandstone", "silicified", "--", str(rng.randint(0, 999)), f"{rng.random() * 50:.2f}"])
            wide = 0.012 * len(text)
            out.append((pool, pool, no, text, line, round(x, 4), round(0.05 + line * 0.04, 4), round(x + wide, 4), round(0.06 + line * 0.04, 4)))
            x, no = x + wide + 0.01, no + 1
    return out


SCHEMA = "pool long, page long, no long, text string, line long, x0 double, y0 double, x1 double, y1 double"


def spoil(rng, text):
    k = rng.randrange(6)
    if k == 0 or len(text) < 3:
        return text
    at = rng.randrange(len(text))
    return [text[:at] + text[at + 1 :], text[:at] + "x" + text[at:], text.replace("0", "9"), text.replace(".", " "), text[: len(text) // 2 + 1]][k - 1]


def test_values_equal_a_search_over_all_spans(spark):
    rng = random.Random(12)
    pages = {p: page(rng, p, rng.randint(1, 6)) for p in range(25)}
    values = []
    for p, words in pages.items():
        for _ in range(12):
            i = rng.randrange(len(words))
            span = words[i : i + rng.randint(1, 5)]
            values.append((len(values), p, spoil(rng, " ".join(w[3] for w in span))))
    pages[300] = [(300, 300, 0, "O.O5", 0, 0.1, 0.1, 0.2, 0.11)]
    values += [(8999, 300, "0.05"), (9000, 1, None), (9001, 1, "  "), (9002, 777, "12.5"), (9003, 2, "zzzqqq")]
    w = spark.createDataFrame([r for rows in pages.values() for r in rows] + [(1, 1, 900, None, 9, 0.0, 0.9, 0.1, 0.91)], SCHEMA)
    got = {r.value_id: r for r in loc.locate_values(w, spark.createDataFrame(values, "value_id long, pool long, value string")).collect()}
    assert len(got) == len(values)
    kinds = set()
    for vid, p, value in values:
        s, method, first, size, ambiguous = best(value, pages.get(p, []))
        r = got[vid]
        assert r.score == pytest.approx(s) and (r.method, r.ambiguous) == (method, ambiguous), (value, r)
        if s:
            assert (r.first, r.size) == (first, size)
        kinds.add(r.score if r.score in (0.0, 90.0, 98.0, 99.0, 100.0) else "like")
    assert kinds == {0.0, 90.0, 98.0, 99.0, 100.0, "like"}


def test_columns_notes_and_digits(spark):
    words = [(1, 1, 0, "12.5", 0, 0.1, 0.1, 0.15, 0.11), (1, 1, 1, "12.5", 0, 0.7, 0.1, 0.75, 0.11), (1, 1, 2, "l7.O", 1, 0.1, 0.2, 0.15, 0.21), (1, 1, 3, "wide", 2, 0.0, 0.3, 0.2, 0.31), (1, 1, 4, "cell", 2, 0.7, 0.3, 0.9, 0.31)]
    w = spark.createDataFrame(words, SCHEMA)
    values = spark.createDataFrame([(1, 1, "12.5"), (2, 1, "17.0"), (3, 1, "wide cell"), (4, 1, "nothing")], "value_id long, pool long, value string")
    columns = spark.createDataFrame([(1, 0.68, 0.78)], "value_id long, left double, right double")
    r = {x.value_id: x for x in loc.locate_values(w, values, columns).collect()}
    assert (r[1].first, r[1].ambiguous, r[1].digits) == (1, False, "exact") and (r[1].box.x0, r[1].box.y1) == (0.697, 0.113)
    assert (r[2].score, r[2].digits) == (98.0, "confusable") and (r[3].method, r[3].note, r[3].box) == ("none", "wider than a cell", None)
    assert (r[4].method, r[4].score, r[4].note, r[4].digits) == ("none", 0.0, "not found", "na")
    assert {x.value_id: x.ambiguous for x in loc.locate_values(w, values).collect()}[1]
    numbers = spark.createDataFrame([(1, 1, "12.9"), (2, 1, "abc1"), (3, 1, "99999")], "value_id long, pool long, value string")
    assert [(x.value_id, x.no, x.text, round(x.score, 1)) for x in loc.rivals(w, numbers).collect()] == [(1, 0, "12.5", 66.7)]


def row_score(words, tokens):
    left, chars, total, hits = list(tokens), 0, 0, []
    for w in words:
        wb, wf = letters(w[3]), letters(w[3].translate(FOLD))
        total += len(wb)
        for t in left:
            if wb and (t in wb or t in wf or (len(wb) >= 2 and wb in t)):
                hits.append(w)
                chars += min(len(t), len(wb))
                left.remove(t)
                break
    recall, precision = (len(tokens) - len(left)) / len(tokens), min(1.0, chars / total) if total else 0.0
    return (200 * precision * recall / (precision + recall) if precision + recall else 0.0), hits


def test_rows_equal_a_search_over_all_lines(spark):
    rng = random.Random(21)
    pages = {p: page(rng, p, rng.randint(1, 7)) for p in range(20)}
    quotes = []
    for p, words in pages.items():
        for _ in range(4):
            i = rng.randrange(len(words))
            quotes.append((len(quotes), p, " ".join(spoil(rng, w[3]) for w in words[i : i + rng.randint(1, 7)])))
    quotes += [(500, 3, None), (501, 3, " -- "), (502, 3, "qqqq wwww"), (503, 99, "12.5")]
    w = spark.createDataFrame([r for rows in pages.values() for r in rows], SCHEMA)
    got = {r.row_id: r for r in loc.locate_rows(w, spark.createDataFrame(quotes, "row_id long, pool long, quote string")).collect()}
    assert len(got) == len(quotes)
    for rid, p, quote in quotes:
        tokens = [t for t in map(letters, (quote or "").split()) if t]
        bands = {}
        for x in pages.get(p, []):
            bands.setdefault(x[4], []).append(x)
        found = []
        order = sorted(bands)
        for k, line in enumerate(order):
            for n in (1, 2):
                if tokens and k + n <= len(order):
                    group = [x for b in order[k : k + n] for x in bands[b]]
                    found.append((-row_score(group, tokens)[0], k, n, row_score(group, tokens)[1] or group))
        r = got[rid]
        if not found or -min(f[0] for f in found) == 0:
            assert (r.method, r.score, r.box) == ("none", 0.0, None)
            continue
        top = min(found, key=lambda f: f[:3])
        second = sorted((-f[0] for f in found), reverse=True)[1:2]
        assert r.score == pytest.approx(-top[0])
        assert r.method == ("none" if -top[0] < 40 else "exact" if -top[0] >= 99 else "fuzzy")
        if r.method != "none":
            assert r.lines == order[top[1] : top[1] + top[2]] and r.words == len(top[3])
            assert r.ambiguous == bool(second and second[0] > 0 and -top[0] - second[0] < 3)
            assert r.box.x0 == pytest.approx(max(0, min(x[5] for x in top[3]) - 0.003), abs=1e-5)


def test_values_of_a_row_are_searched_in_its_words(spark):
    words = [(1, 1, k, t, k // 3, 0.1 + 0.2 * (k % 3), 0.1 + 0.1 * (k // 3), 0.2 + 0.2 * (k % 3), 0.12 + 0.1 * (k // 3)) for k, t in enumerate(["A-1", "5.0", "6.0", "A-2", "5.0", "9.0"])]
    w = spark.createDataFrame(words, SCHEMA)
    rows = loc.locate_rows(w, spark.createDataFrame([(70, 1, "A-2 5.0 9.0"), (71, 1, "no such row")], "row_id long, pool long, quote string"))
    pools = loc.row_pools(w, rows.join(spark.createDataFrame([(70, 1), (71, 1)], "row_id long, pool long"), "row_id"))
    r = loc.locate_values(pools, spark.createDataFrame([(1, 70, "5.0")], "value_id long, pool long, value string")).first()
    assert (r.ambiguous, r.box.y0, r.lines) == (False, 0.197, [1])


def test_forms_of_letters_and_long_words(spark):
    df = spark.createDataFrame([("ﬁve ½ １２．５ –x “q” STRASSE ß",), (None,), ("",)], "t string")
    got = [tuple(r) for r in df.select(loc.norm(df.t), loc.bare(df.t), loc.foldbare(df.t)).collect()]
    assert got[0][0] == 'five 1⁄2 12.5 -x "q" strasse ss' and got[1] == got[2] == ("", "", "")
    words = [(1, 1, 0, "ab1" * 3000, 0, 0.1, 0.1, 0.2, 0.11), (1, 1, 1, "tail", 0, 0.3, 0.1, 0.4, 0.11)]
    w = spark.createDataFrame(words, SCHEMA)
    v = spark.createDataFrame([(1, 1, "b1" + "ab1" * 400), (2, 1, "ab1" * 2999 + "ab2")], "value_id long, pool long, value string")
    r = {x.value_id: (x.score, x.first, x.size) for x in loc.locate_values(w, v).collect()}
    assert r[1] == (90.0, 0, 1) and r[2][0] > 99 and r[2][1:] == (0, 1)
    q = spark.createDataFrame([(1, 1, "ab1ab1 tail")], "row_id long, pool long, quote string")
    assert loc.locate_rows(w, q).first().words == 2 or loc.locate_rows(w, q).first().method == "none"
    assert loc.locate_values(w.where("false"), v).count() == 2 and loc.locate_rows(w, q.where("false")).count() == 0
