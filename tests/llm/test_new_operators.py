"""Prefix counts, conversation repair and periodic runs against plain recomputation."""

from __future__ import annotations

import hashlib
import random
import zlib
from functools import cache
from itertools import product

import numpy as np
import public_tokenizers
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import conversation_repair, periodic_runs, prefix_counts, queries

SF, WORD = "/root/testdata/sf0.001", public_tokenizers.path("word_bpe_49k.json")
WHITE = " \t\n\x0b\x0c\r"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(WORD)


def tokens(library, text):
    return len(library.encode(text, add_special_tokens=False).ids)


def test_every_prefix_has_the_count_of_the_library(library):
    rng, count = random.Random(3), prefix_counts.PrefixCounter(WORD)
    letters = list(" \n\t\r'sdtrelvm,.ABÉéßİςΣ1٣½-! 　̧́\x1f中😀가ᅡᆨ각ກक़Å̈") + ["<|endoftext|>", "<|startoftext|>", "'re", "'ll", "<|end", "hello", "ing", "\x85\xa0", "https://an.example.org/long/path"]
    for _ in range(400):
        text = "".join(rng.choice(letters) for _ in range(rng.randint(0, 12)))
        got, end = count.counts(text).tolist(), 0
        assert len(got) == len(text)
        for cluster in count._clusters(text):
            end += len(cluster)
            assert got[end - 1] == tokens(library, text[:end]), (text, end)


def test_long_texts_and_words_and_tables(library):
    count = prefix_counts.PrefixCounter(WORD)
    for text in ("word, " * 30_000, "a" * 3000 + " " + "=" * 3000, "é中" * 700 + " tail of ascii", "x\n\n" * 400_000):
        got = count.counts(text)
        assert got[-1] == tokens(library, text)
        table = prefix_counts.Table(prefix_counts.pack(got))
        for n in (0, 1, 4095, 4096, 4097, len(text) // 2, len(text), len(text) + 9):
            assert table.tokens(n) == (got[min(n, len(text)) - 1] if n else 0)
        for budget in (0, 1, 7, 1000, 10**9):
            fits = np.flatnonzero(got <= budget)
            assert table.longest(budget) == (fits[-1] + 1 if len(fits) else 0)
    wide = np.array([5, 400, 3, 90_000, 2, 1 << 40], np.int64)
    table = prefix_counts.Table(prefix_counts.pack(wide, step=2))
    assert [table.tokens(k + 1) for k in range(6)] == wide.tolist() and table.longest(4) == 5 and table.longest(1) == 0


def test_other_tokenizers_are_refused():
    with pytest.raises(ValueError):
        prefix_counts.PrefixCounter(public_tokenizers.path("byte_bpe_50k.json"))


def test_op11(spark, library):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: r for r in queries.op11_prefix_counts(spark, SF).collect()}
    assert len(got) == len(docs)
    for d in docs:
        text = d["text"] or ""
        n, r = tokens(library, text), got[d["doc_id"]]
        assert (r.n_bytes, r.n_tokens, r.over_limit) == (len(text.encode()), n, n > 2048)
        assert r.fit_tokens == tokens(library, text[: r.fit_chars]) <= 2048 and (r.fit_chars == len(text)) == (n <= 2048)


def test_prefix_counts_of_odd_rows(spark, library):
    rows = [(1, None, 5), (2, "", 6), (None, "no id", 7), (3, "twice", 8), (3, "twice again", 9), (4, "long " * 50_000, 1), (5, "<|endoftext|> and 'll", 2)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_tokens long")
    counts = prefix_counts.store(prefix_counts.prefix_counts(docs, WORD))
    got = sorted((r.doc_id or 0, r.n_tokens) for r in prefix_counts.within_budget(counts, 2048).collect())
    assert got == sorted((i or 0, tokens(library, t or "")) for i, t, _ in rows)
    empty = prefix_counts.prefix_counts(docs.where("false"), WORD)
    assert prefix_counts.within_budget(empty, 2048).count() == 0
    some = docs.where("doc_id in (4, 5)")
    cut = {r.doc_id: r.text for r in prefix_counts.truncated(some, counts, 100).collect()}
    assert tokens(library, cut[4]) == 100 and cut[4] == "long " * 100 and cut[5] == rows[6][1]
    asked = counts.where("doc_id = 4").select(prefix_counts.tokens_at("prefix_counts", F.lit(24)).alias("n")).first().n
    assert asked == tokens(library, ("long " * 9)[:24])


# --- conversations


def legal(initials):
    rest = initials[1:] if initials[:1] == "s" else initials
    return initials == "" or (len(rest) >= 2 and rest == "ua" * (len(rest) // 2))


def brute(rows):
    """Least (cost, audit) and the repaired turns, by search over all edits with up to two inserts at each place."""
    seen, marks = set(), []
    for role, text in rows:
        visible = text.rstrip(WHITE)
        marks.append("b" if not visible else "d" if (role, text) in seen else "t" if visible[-1] not in ".!?" else "")
        seen.add((role, text))

    @cache
    def best(at, before):
        """Least (cost, audit, turns) for rows from `at`, when `before` is the initial of the turn before."""
        found = []
        if at == len(rows):
            found.append((0, "", ()) if before in ("", "a") else None)
        else:
            role, text = rows[at]
            mark = marks[at]
            for cost, letter, turn in [(4, "D", None)] + ([] if mark in ("b", "d") else [(0, "K", role), (3, "R", "user"), (3, "R", "assistant")]):
                c = turn[:1] if turn is not None else before
                if turn is not None and not follows(before, c):
                    continue
                rest = best_from(at + 1, c)
                if rest:
                    found.append((cost + (3 if mark == "t" and turn is not None else 0) + rest[0], letter + rest[1], ((f"{turn}:{text}",) if turn is not None else ()) + rest[2]))
        found = [f for f in found if f]
        return min(found, default=None, key=lambda f: f[:2])

    @cache
    def best_from(at, before):
        """As best(), with inserts first."""
        found = [best(at, before)]
        for puts in [p for k in (1, 2, 3) for p in product(("user", "assistant"), repeat=k)]:
            c, ok = before, True
            for p in puts:
                ok = ok and follows(c, p[:1])
                c = p[:1]
            rest = best(at, c) if ok else None
            if rest:
                found.append((3 * len(puts) + rest[0], "I" * len(puts) + rest[1], tuple(f"{p}:" for p in puts) + rest[2]))
        found = [f for f in found if f]
        return min(found, default=None, key=lambda f: f[:2])

    def follows(a, b):
        return (a, b) in {("", "s"), ("", "u"), ("s", "u"), ("a", "u"), ("u", "a")}

    cost, audit, turns = best_from(0, "")
    initials = "".join(t[0] for t in turns)
    assert legal(initials)
    pairs = [a[:1] + b[:1] for (a, _), (b, _) in zip(rows, rows[1:], strict=False)]
    return tuple(sum(m == k for m in marks) for k in "bdt") + (sum(p not in ("su", "ua", "au") for p in pairs), cost, audit, hashlib.sha256("\n".join(turns).encode()).hexdigest())


def expected(rows):
    """Contract rows from (conv_id, turn, role, text) tuples."""
    kept = {}
    for conv, turn, role, text in rows:
        kept.setdefault(conv, [])
        role, text = " " if role is None else role, " " if text is None else text
        how = zlib.crc32(f"{' ' if conv is None else conv}:{' ' if turn is None else turn}".encode()) % 20
        if how == 1:
            text = ""
        if how == 2:
            text = "".join(c for c in text if c not in ".!?")
        if how == 4:
            role = "user"
        kept[conv] += [(turn, role, text)] * (0 if how == 0 else 2 if how == 3 else 1)
    out = {}
    for conv, found in kept.items():
        found.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1], hashlib.md5(r[2].encode()).hexdigest()))
        turns = {r[0] for r in found if r[0] is not None}
        gaps = max(turns) - min(turns) + 1 - len(turns) if turns else 0
        out[conv] = (gaps, *brute([r[1:] for r in found])) if found else (0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())
    return out


FIELDS = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256")


def test_op12(spark):
    rows = [tuple(r.values()) for r in pq.read_table(f"{SF}/conversations.parquet").to_pylist()]
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in queries.op12_conversation_repair(spark, SF).collect()}
    assert got == expected(rows) and len({r[6] for r in got.values()}) > 5


def test_op12_on_random_and_odd_conversations(spark, tmp_path):
    rng = random.Random(8)
    roles, texts = ["user", "assistant", "system", "tool", None, "", "user", "assistant"], ["Yes.", "No", " \t", None, "Same again!", "why?  ", "", "a\nb."]
    rows = [(c, t if rng.random() < 0.9 else None, rng.choice(roles), rng.choice(texts) if rng.random() < 0.5 else f"Text {rng.random()}.") for c in range(150) for t in range(rng.randint(1, 9))]
    rows += [(None, t, "user", f"t{t}.") for t in range(3)] + [(500, None, None, None)] * 3 + [(501, 4, "user", "Same.")] * 5
    spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumn("cost", F.lit("x")).write.parquet(f"{tmp_path}/conversations.parquet")
    got = {r.conv_id: tuple(r[c] for c in FIELDS) for r in queries.op12_conversation_repair(spark, str(tmp_path)).collect()}
    assert got == expected(rows)


def test_long_conversations_seal_their_audits():
    rng = random.Random(2)
    for blank in (0.02, 1.0):
        rows = [(rng.choice(["user", "assistant"]) if rng.random() < 0.3 else ("user", "assistant")[k % 2], "" if rng.random() < blank else f"Turn {k}.") for k in range(2600)]
        one = conversation_repair.Repair(1)
        plain = conversation_repair.Repair(1)
        plain._seal = lambda: None
        for k, (role, text) in enumerate(rows):
            for r in (one, plain):
                r.add(k, role, text, text, False)
        assert one.result() == plain.result() and len(one.result()[7]) >= 2600
        assert max(len(s[2]) for s in one.states.values()) < 1100


def test_repaired_turns_follow_the_grammar(spark):
    rows = [(c, t, r, x) for c in range(40) for t, (r, x) in enumerate(random.Random(c).choices([("user", "A."), ("assistant", "B"), ("system", "C."), ("tool", "D!"), ("user", "")], k=c % 7))]
    marked = conversation_repair.faults(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    planned = conversation_repair.plans(marked)
    turns = {}
    for r in sorted(conversation_repair.repaired(marked, planned).collect(), key=lambda r: (r.conv_id, r.place)):
        turns.setdefault(r.conv_id, []).append((r.role, r.text))
    for r in planned.collect():
        mine = turns.get(r.conv_id, [])
        assert legal("".join(role[0] for role, _ in mine))
        assert hashlib.sha256("\n".join(f"{a}:{b}" for a, b in mine).encode()).hexdigest() == r.repaired_sha256
    assert conversation_repair.plans(conversation_repair.faults(spark.createDataFrame([], "conv_id long, turn long, role string, text string"))).count() == 0


def test_a_turn_that_a_conversation_repeats_is_one_row_of_the_join(spark):
    rows = spark.range(5000).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.lit("user").alias("role"), F.lit("Same.").alias("text"))
    got = conversation_repair.plans(conversation_repair.faults(rows)).first()
    assert (got.duplicate, got.blank, got.cost, got.audit) == (4999, 0, 4999 * 4 + 3, "K" + "D" * 4999 + "I")


# --- runs


def plain_runs(x):
    n, out = len(x), []
    for q in range(1, n // 4 + 1):
        i = 0
        while i + q < n:
            if x[i] != x[i + q]:
                i += 1
                continue
            j = i
            while j + q < n and x[j] == x[j + q]:
                j += 1
            w = x[i : i + q]
            if j + q - i >= max(6, 4 * q) and not any(q % d == 0 and w == w[:d] * (q // d) for d in range(1, q)):
                out.append((i, j + q - i, q))
            i = j
    return sorted(out)


def told(doc_id, text, plant=True):
    words = [w.decode() for w in (text or "").encode().split()]
    h = zlib.crc32(str(doc_id).encode())
    if plant and doc_id is not None and h % 10 == 0 and words:
        g, n = h // 10, len(words)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
    runs = plain_runs(words)
    gone = {i for s, m, q in runs for i in range(s + q, s + m)}
    best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    four = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (len(runs), *four, digest("".join(f"{s},{m},{q}\n" for s, m, q in runs)), digest(" ".join(w for i, w in enumerate(words) if i not in gone)))


def test_runs_of_random_rows():
    rng = random.Random(4)
    for k in range(1500):
        if k % 3:
            x = []
            while len(x) < rng.randint(5, 110):
                x += ([rng.randint(0, 2) for _ in range(rng.randint(1, 9))] * rng.randint(1, 9))[: rng.randint(1, 60)]
        else:
            x = [rng.randint(0, 1 + k % 2) for _ in range(rng.randint(0, 70))]
        assert periodic_runs.runs_of(x) == plain_runs(x), x


def test_texts_are_sifted_together():
    rng = random.Random(9)
    for _ in range(60):
        rows = []
        for _ in range(rng.randint(1, 12)):
            words = []
            while len(words) < rng.randint(0, 80):
                words += ([rng.choice("abcdefghijk") * rng.randint(1, 3) for _ in range(rng.randint(1, 7))] * rng.choice([1, 1, 1, 5]))[:40]
            rows.append(rng.choice([" ", "\n \t", "\x0b"]).join(words))
        got = periodic_runs.all_runs([periodic_runs.Text(r.encode(), False, None) for r in rows])
        assert got == [plain_runs(r.split()) for r in rows]


def test_op13(spark):
    docs = pq.read_table(f"{SF}/documents.parquet").to_pylist()
    got = {r.doc_id: tuple(r)[1:] for r in queries.op13_periodic_runs(spark, SF).collect()}
    want = {d["doc_id"]: told(d["doc_id"], d["text"]) for d in docs}
    assert got == want and sum(r[0] > 0 for r in want.values()) > 10


def test_runs_of_odd_rows(spark):
    rows = [(0, None), (1, ""), (None, "a b " * 9), (2, " \x85 a b\x1fc "), (3, "one " * 20_000), (3, "x y z " * 900 + "tail"), (4, "ab" * 800_000 + " tail tail tail tail tail tail"), (5, "é ü " * 5)]
    docs = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, start string")
    got = sorted(map(str, (tuple(r) for r in periodic_runs.summaries(docs).collect())))
    assert got == sorted(str((i, *told(i, t, False))) for i, t in rows)
    assert periodic_runs.summaries(docs.where("false")).count() == 0
    every = {(r.doc_id, r.start, r.length, r.period) for r in periodic_runs.run_rows(docs).collect()}
    assert {(3, 0, 20_000, 1), (3, 0, 2700, 3), (4, 1, 6, 1), (5, 0, 10, 2)} <= every
    short = {r.text for r in periodic_runs.collapse(docs).collect()}
    assert {None, "", "one", "x y z tail", "é ü"} <= short


def test_a_text_of_many_words_keeps_to_linear_time():
    row = [k % 7 for k in range(20_000)] + list(range(7, 107)) + [k % 1200 for k in range(5000)]
    assert periodic_runs.runs_of(row) == [(0, 20_000, 7), (20_100, 5000, 1200)]
