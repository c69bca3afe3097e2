"""Language, quality, mixing and the pipeline."""

from __future__ import annotations

import math
import random
import zlib

import numpy as np
from pyspark.sql import functions as F

import corpus_pipeline
from lodestar.llm import nbsvm, rank_lang, temperature_mix

WORDS = {"en": "the and of to in that it is was for on with as his they at be this from", "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine", "fr": "de la le et les des en un du une que est pour qui dans par plus pas au sur"}


def texts(n, seed=1):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        lang = rng.choice(list(WORDS))
        rows.append((i, " ".join(rng.choice(WORDS[lang].split()) for _ in range(rng.randint(8, 60))), lang))
    return rows


def held(i):
    return zlib.crc32(str(i).encode()) % 4 == 2


def test_language(spark):
    rows = texts(200) + [(900, None, "en"), (901, "", "de"), (902, "123 !!", "fr"), (903, "der die das", None), (None, "the and of", "en")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = {r.doc_id: r for r in rank_lang.identify(docs, top=100).collect()}
    test = [r for r in rows[:200] if held(r[0])]
    assert len(test) > 30 and sum(got[i].lang_pred == lang for i, _, lang in test) >= 0.95 * len(test)
    assert all(got[i].held_out == held(i) for i, _, _ in rows[:200])
    assert all((got[i].lang_pred, got[i].score) == ("und", 0.0) for i in (900, 901, 902))
    assert got[903].lang_pred == "de" and all(0 <= r.score <= 1 for r in got.values())
    none = rank_lang.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert {r.lang_pred for r in none} == {"und"}
    assert rank_lang.identify(docs.where(F.lit(False))).count() == 0


def test_distance_is_out_of_place():
    doc, profile = np.array([5, 7, 9]), np.array([7, 5, 11])
    order, rank = np.sort(profile), np.argsort(profile, kind="stable")
    assert rank_lang.distance(doc, order, rank, 10) == 1 + 1 + 10


def quality_rows(n=400):
    rng = random.Random(2)
    rows, labels = [], []
    for i, t, lang in texts(n, 3):
        bad = i % 4 == 0
        kind = rng.randrange(3)
        junk = [" ".join(w.upper() + "!!" for w in t.split()), " | ".join(t.split()), (t.split()[0] + " ") * 40][kind]
        rows.append((i, junk if bad else t.capitalize() + ".", lang))
        labels.append((i, 0 if bad else 1))
    return rows, labels


def test_quality(spark):
    rows, labels = quality_rows()
    docs = spark.createDataFrame(rows + [(5000, None, "x"), (5001, "", "x"), (5002, "word " * 50000, "x")], "doc_id long, text string, predicted string")
    marks = spark.createDataFrame(labels + [(0, None), (1, 7)], "doc_id long, quality int")
    model = nbsvm.fit(docs, marks, bits=14)
    got = {r.doc_id: r for r in nbsvm.score(docs, model).collect()}
    test = [(i, y) for i, y in labels if held(i)]
    assert sum(got[i].predicted == y for i, y in test) >= 0.95 * len(test)
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    assert nbsvm.fit(docs, marks.where(F.lit(False))) is None
    assert {r.predicted for r in nbsvm.score(docs, None).collect()} == {1}
    one = nbsvm.fit(docs, marks.where("quality = 1"), bits=14)
    assert {r.predicted for r in nbsvm.score(docs, one).collect()} == {1}


def mix_rows():
    rng = random.Random(4)
    sizes = {"a": 600, "b": 60, "c": 40, None: 20, "empty": 3}
    rows, i = [], 0
    for s, n in sizes.items():
        for _ in range(n):
            rows.append((i, "" if s == "empty" else "w " * rng.randint(1, 30), s))
            i += 1
    return rows + [(i, "w " * 10, "a"), (i, "w " * 10, "a")]


def test_mixture_meets_entropy_and_budget(spark):
    rows = mix_rows()
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("epoch", F.lit("x"))
    got = temperature_mix.select_rows(docs, entropy=0.9, repeats=50.0, block=16).toPandas()
    tokens = {}
    for _, t, s in rows:
        tokens[s] = tokens.get(s, 0) + len(t.split())
    total = sum(tokens.values())
    share = {s: n / total for s, n in tokens.items() if n}
    low, high = 0.0, 1.0
    for _ in range(60):
        a = (low + high) / 2
        z = sum(p**a for p in share.values())
        h = -sum(p**a / z * math.log(p**a / z) for p in share.values())
        low, high = (a, high) if h >= 0.9 * math.log(len(share)) else (low, a)
    z = sum(p**low for p in share.values())
    for s, p in share.items():
        mine = got[got.source.isna()] if s is None else got[got.source == s]
        quota = p**low / z * total
        assert abs(mine.weight.iloc[0] - p**low / z) < 1e-6
        assert quota - 31 <= mine.n_tokens.sum() <= quota + 1  # the next document would not fit
        epochs = mine.groupby("doc_id").size()
        assert epochs.max() - epochs.min() <= 1
    assert (got[got.source == "empty"].groupby("doc_id").size() == 1).all()
    for (_, e), g in got[got.source == "a"].groupby(["source", "epoch"]):
        g = g.sort_values("token_start")
        assert g.token_start.tolist() == np.cumsum([0] + g.n_tokens.tolist())[:-1].tolist()


def test_repetition_limit_and_stage(spark):
    docs = spark.createDataFrame(mix_rows(), "doc_id long, text string, source string")
    got = temperature_mix.select_rows(docs, entropy=1.0, repeats=2.0, block=16)
    tokens = {r.source: r.n for r in docs.groupBy("source").agg(F.sum(F.regexp_count("text", F.lit(r"\S+"))).alias("n")).collect()}
    for r in got.groupBy("source").agg(F.sum("n_tokens").alias("n")).collect():
        assert r.n <= 2 * tokens[r.source] + 1
    assert temperature_mix.mixed(docs, block=16).columns == docs.columns
    assert temperature_mix.mixed(docs.where(F.lit(False))).count() == 0
    assert temperature_mix.mixed(docs, entropy=0.0, block=16).count() == docs.count()  # exponent 1: every row once


def test_pipeline_stages(spark, tmp_path):
    rows, labels = quality_rows()
    rng = random.Random(8)
    passage = "".join(rng.choice("abcdefghijklmnop ") for _ in range(300))
    good = [(1000 + i, f"{t} {passage} {i}", lang) for i, t, lang in texts(30, 9)]
    copies = [(2000 + i, rows[1][1], "en") for i in range(5)]
    all_rows = [(i, t, lang, f"s{i % 3}", len(t)) for i, t, lang in rows + good + copies]
    docs = spark.createDataFrame(all_rows, "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels + [(i, 1) for i, _, _ in good], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert names == ["quality", "near_duplicates", "repeats", "mixture", "packing"]
    kept = corpus_pipeline.quality(spark, docs, str(tmp_path)).toPandas()
    bad = {i for i, y in labels if y == 0}
    assert len(bad & set(kept.doc_id)) <= 2 and len(set(kept.doc_id) - bad) >= 0.98 * (len(all_rows) - len(bad))
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    assert 1 in {r.doc_id for r in kept.select("doc_id").collect()} and not {2000, 2001, 2002, 2003, 2004} & {r.doc_id for r in kept.select("doc_id").collect()}
    clean = {r.doc_id: r for r in corpus_pipeline.repeats(spark, docs, str(tmp_path)).collect()}
    assert passage in clean[1000].text and not any(passage in clean[1000 + i].text for i in range(1, 30))
    assert all(r.n_chars == len(r.text) for r in clean.values())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        assert stage(spark, docs, str(tmp_path)).columns == docs.columns, name
    assert corpus_pipeline.run(spark, str(tmp_path)).count() > 0
    none = docs.where(F.lit(False))
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, none, str(tmp_path)).count() == 0


def test_the_classifier_keeps_its_bounds(spark):
    """An id that many rows repeat is one row, and the features of all rows are bounded."""
    text = F.concat_ws(" ", F.lit("word"), (F.col("id") % 50).cast("string"), F.md5((F.col("id") % 50).cast("string")))
    docs = spark.range(600).select((F.col("id") % 2).alias("doc_id"), text.alias("text"))
    labels = spark.createDataFrame([(0, 1), (1, 0)], "doc_id long, quality int")
    many, once = nbsvm.fit(docs, labels), nbsvm.fit(docs.repartition(3), labels)
    few = sum(len(nbsvm.features(r.text, 17)) for r in docs.groupBy("doc_id").agg(F.min("text").alias("text")).collect())
    assert np.count_nonzero(many["weights"][:-1]) <= few + 40 and many["slope"] == once["slope"]
    wide = spark.range(400).select(F.col("id").alias("doc_id"), F.concat_ws(" ", *(F.md5((F.col("id") * 7 + k).cast("string")) for k in range(20))).alias("text"))
    marks = spark.range(400).select(F.col("id").alias("doc_id"), (F.col("id") % 2).cast("int").alias("quality"))
    small, whole = nbsvm.fit(wide, marks, most=20_000), nbsvm.fit(wide, marks)
    assert np.count_nonzero(small["weights"]) < np.count_nonzero(whole["weights"])
    assert nbsvm.fit(wide, marks, most=1) is None
