"""What must hold at any size: tasks that read files back, clashing names, odd rows, dense clusters."""

from __future__ import annotations

import zlib

import corpus_pipeline
import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import bwt_dedup, media_shards, nbsvm, packing, pivot_index, rank_lang, simhash, temperature_mix, token_table, warc_chunks
from lodestar.llm.common import join_hot
from lodestar.session import cut, scratch

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))


def many(spark, n=400, parts=4):
    text = F.concat_ws(" ", F.lit("page"), F.col("id").cast("string"), F.repeat(F.md5(F.col("id").cast("string")), 40))
    return spark.range(n).repartition(parts).select(F.col("id").alias("doc_id"), F.col("id").alias("page_id"), F.lit("u").alias("url"), text.alias("text"), text.alias("html"))


def reading_tasks(df):
    """Partitions that yield rows."""
    return df.select(F.spark_partition_id().alias("p")).distinct().count()


def test_archives_are_read_by_many_tasks(spark):
    archives = warc_chunks.write_archives(warc_chunks.plan(many(spark)), range_bytes=2000)
    assert archives.count() > 40 and archives.select("archive").distinct().count() < archives.count()
    chunks = warc_chunks.read_chunks(archives)
    assert reading_tasks(chunks) == spark.sparkContext.defaultParallelism
    assert warc_chunks.resolve(chunks).select(F.sum("page_id")).first()[0] == 400 * 399 // 2


def test_archives_roll_over(spark):
    archives = warc_chunks.write_archives(warc_chunks.plan(many(spark, parts=1)), archive_bytes=5000, range_bytes=2000)
    assert archives.select("archive").distinct().count() > 5
    assert warc_chunks.resolve(warc_chunks.read_chunks(archives)).count() == 400


def test_token_shards_roll_over_and_are_read_by_many_tasks(spark):
    shards = token_table.write_shards(many(spark), WORD, 2, shard_bytes=100_000)
    assert shards.groupBy("part").count().agg(F.max("count")).first()[0] > 1
    rows = token_table.read_shards(shards)
    assert reading_tasks(rows) == spark.sparkContext.defaultParallelism
    got = sorted(map(tuple, rows.collect()))
    assert [r[1] for r in got] == np.cumsum([0] + [r[2] for r in got])[:-1].tolist() and len(got) == 400


def test_media_shards_roll_over_and_are_read_by_many_tasks(spark):
    folder = scratch(spark, "media-test")
    index = media_shards.write_shards(many(spark, parts=1), folder, shard_bytes=20_000)
    assert index.select("shard").distinct().count() > 3
    rows = media_shards.payload_columns(media_shards.canonical(index), folder)
    assert reading_tasks(rows) == spark.sparkContext.defaultParallelism and rows.count() == 400


def test_packing_of_long_texts_merges_groups_and_powers_of_two(spark):
    docs = spark.range(300).repartition(40).select(F.col("id").alias("doc_id"), F.concat(F.lit("some words "), F.repeat(F.lit("of a text "), (F.col("id") % 60).cast("int"))).alias("text"))
    docs = docs.unionByName(spark.createDataFrame([(1000, "a long text " * 60_000)], "doc_id long, text string"))
    got = packing.pack(docs, BYTE, fan_in=8, powers=True).toPandas()
    assert got[got.sequence_id >= 1 << 62].sequence_id.map(lambda s: s >> 32).nunique() > 2  # several merging tasks
    fill = got.groupby("sequence_id").length.sum()
    assert fill.max() == 1024
    merged = fill[fill.index >= 1 << 62]
    assert sum(0 if n & (n - 1) == 0 else 1024 - n for n in fill) <= 16 * len(merged)
    whole = Tokenizer.from_file(BYTE).encode("a long text " * 60_000, add_special_tokens=False).ids + [0]
    mine = got[got.doc_id == 1000].sort_values("start")
    assert mine.length.sum() == len(whole)
    assert all(r.ids_crc32 == zlib.crc32(np.array(whole[r.start : r.start + r.length], "<u4").tobytes()) for r in mine.itertuples())


def test_unpadded_cuts_into_powers_of_two():
    window = [(1, 0, bytes(4 * 300), 300), (2, 5, bytes(4 * 401), 406)]
    parts = list(packing.unpadded(window))
    assert [sum(len(p[2]) // 4 for p in part) for part in parts] == [512, 128, 32, 16, 8, 4, 1]
    pieces = [p for part in parts for p in part]
    assert [(p[0], p[1]) for p in pieces][:3] == [(1, 0), (2, 5), (2, 217)] and sum(len(p[2]) for p in pieces) == 4 * 701


def odd(spark):
    """Documents with nulls, empty and long texts, repeated ids, and columns whose names clash or have dots."""
    rng = np.random.default_rng(6)
    words = [f"w{k}" for k in range(400)]
    body = [" ".join(rng.choice(words, 60)) for _ in range(12)]
    rows = [(i, t, "en", "s", len(t)) for i, t in enumerate(body)] + [(None, body[0], "en", None, 1), (None, None, None, "s", None), (20, "", "en", "s", 0), (21, None, "en", "s", None), (2, body[5] + " tail of its own", "en", "s", 3), (2, " ".join(rng.choice(words, 60)), "en", "s", 4), (30, " ".join(rng.choice(words, 30_000)), "en", "s", 9), (31, body[1], "en", "s", 9)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    clash = ["n_bytes", "n_removed", "n_spans", "kept_sha256", "text_kept", "text_clean", "score", "predicted", "mark", "of", "key", "times", "again", "copy", "rest", "a.b", "x`y", "__row", "__key", "__copy"]
    return docs.select("*", *(F.lit(777 + k).alias(c) for k, c in enumerate(clash))), clash


def test_pipeline_stages_keep_clashing_columns(spark, tmp_path):
    docs, clash = odd(spark)
    spark.createDataFrame([(i, i % 2) for i in range(8)], "doc_id long, quality int").write.parquet(f"{tmp_path}/labels.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        got = stage(spark, docs, str(tmp_path))
        assert got.columns == docs.columns, name
        for r in got.collect():
            assert [r[c] for c in clash] == [777 + k for k in range(len(clash))], name
    kept = corpus_pipeline.near_duplicates(spark, docs, str(tmp_path))
    found = [(r.doc_id, r.text) for r in kept.collect()]
    texts = {t for _, t in found}
    assert sum(i is None for i, _ in found) == 2  # null ids stay
    ids = {i for i, _ in found}
    assert sum(i == 2 for i, _ in found) == 3  # three texts of one id; one of them is like the text of 5, which goes
    assert not {5, 31} & ids and len({20, 21} & ids) == 1
    assert {r.text for r in docs.where("doc_id < 12 and doc_id <> 5").collect()} <= texts
    clean = {(r.doc_id, r.n_bytes): r.text for r in corpus_pipeline.repeats(spark, docs.where("doc_id = 21"), str(tmp_path)).collect()}
    assert clean == {(21, 777): None}
    mixed = corpus_pipeline.mixture(spark, docs, str(tmp_path))
    assert {r.doc_id for r in mixed.collect()} <= {r.doc_id for r in docs.collect()}


def test_two_rows_of_one_id_and_source_are_taken_by_themselves(spark):
    rows = [(1, "a b c", "x"), (1, "a b c", "y"), (2, None, "x"), (3, "word " * 50_000, "x"), (4, "d e", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got = temperature_mix.mixed(docs, entropy=0.0).collect()
    assert sorted((r.doc_id, r.source) for r in got) == [(1, "x"), (1, "y"), (2, "x"), (3, "x"), (4, "y")]


def test_operators_with_null_and_repeated_rows(spark):
    long = "wort und zahl " * 40_000
    rows = [(None, "ein text mit worten", "de"), (1, long, "de"), (1, long, "de"), (2, "", "de"), (3, None, "en"), (5, "some words in a text", "en"), (6, "123 456", "en"), (7, "zz", None)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    lang = sorted(((r.doc_id or 0, r.lang_pred) for r in rank_lang.identify(docs).collect()))
    assert [x for x in lang if x[0] in (1, 2, 3, 6)] == [(1, "de"), (1, "de"), (2, "und"), (3, "und"), (6, "und")]
    labels = spark.createDataFrame([(None, 1), (1, 1), (5, 0), (5, 1), (3, None), (2, 7)], "doc_id long, quality int")
    model = nbsvm.fit(docs, labels)
    scored = nbsvm.score(docs, model).collect()
    assert len(scored) == len(rows) and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in scored)
    assert {r.predicted for r in nbsvm.score(docs, None).collect()} == {1}
    groups = simhash.simhash_groups(docs).collect()
    assert len(groups) == len(rows)
    by = {(r.doc_id, r.fp): r.component_id for r in groups}
    assert by[2, 0] == by[3, 0] == 2  # no words: one fingerprint; the text with a null id is a component without id
    assert [r.component_id for r in groups if r.doc_id is None] == [None]
    assert bwt_dedup.remove_repeats(docs).count() == len(rows)


def test_one_long_text_loses_its_repeats_whole(spark):
    rng = np.random.default_rng(2)
    first = "".join(rng.choice(list("abcdefgh "), 3 << 20))
    docs = spark.createDataFrame([(1, first), (2, "start " + first[1_000_000:2_200_000] + " end")], "doc_id long, text string")
    got = {r.doc_id: (r.n_removed, r.n_spans, r.text_clean) for r in bwt_dedup.remove_repeats(docs).collect()}
    assert got[1][:2] == (0, 0) and got[2][0] in range(1_200_000, 1_200_004) and got[2][1] == 1 and len(got[2][2]) < 12


@pytest.mark.parametrize(("n", "d"), [(600, 16), (2000, 64)])
def test_planted_clusters_are_found(spark, n, d):
    """Recall of links against all pairs, for pairs at the threshold, dense clusters and equal vectors; no false link."""
    rng = np.random.default_rng(n)
    unit = lambda v: v / np.linalg.norm(v, axis=-1, keepdims=True)
    base = unit(rng.normal(size=(n, d)))
    side = rng.normal(size=(n // 2, d))
    side = unit(side - (side * base[: n // 2]).sum(1, keepdims=True) * base[: n // 2])
    cos = rng.uniform(0.951, 0.999, size=(n // 2, 1))
    near = cos * base[: n // 2] + np.sqrt(1 - cos**2) * side
    dense = unit(base[7] + 0.02 * rng.normal(size=(150, d)) / np.sqrt(d) * 4)
    vec = np.concatenate([base, near, dense, np.repeat(base[3:4], 20, 0)]).astype("f4")
    wide = unit(vec.astype(float))
    link = wide @ wide.T >= 0.95
    np.fill_diagonal(link, False)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(vec)], "vec_id long, embedding array<float>")
    got = {r.vec_id: r for r in pivot_index.near_vectors(df, block=256).collect()}
    found = np.array([got[i].n_links for i in range(len(vec))])
    assert (found <= link.sum(1)).all() and found.sum() >= 0.97 * link.sum()
    component = np.arange(len(vec))
    while True:
        low = np.minimum(component, np.where(link, component[None, :], len(vec)).min(1))
        if (low == component).all():
            break
        component = low
    assert np.mean([got[i].component_id == component[i] for i in range(len(vec))]) >= 0.97
    assert all(got[i].kept == (got[i].component_id == i) for i in got)


def test_pivots_keep_their_order():
    rng = np.random.default_rng(1)
    points, unit = rng.normal(size=(40, 8)), rng.normal(size=(30, 8))
    near = pivot_index.nearest(unit, points, 8).astype(int)
    assert np.array_equal(near, np.argsort(-(unit @ points.T), axis=1, kind="stable")[:, :8])
    codes = pivot_index.list_codes(near, 6, 8)
    want = sorted({8 << 40 | min(near[0, i], near[0, j]) << 20 | max(near[0, i], near[0, j]) for i in range(8) for j in range(i + 1, 8) if i + j <= 6})
    assert codes[0].tolist() == [int(x) for x in want]
    tied = np.ones((1, 3))
    assert pivot_index.nearest(tied, np.ones((5, 3)), 4).tolist() == [[0, 1, 2, 3]]


def test_vectors_with_null_ids_and_many_lengths(spark):
    rows = [(i, [1.0 + i % 2] * (i // 2 + 2)) for i in range(30)] + [(None, [1.0, 1.0]), (4, [1.0, 2.0, 3.0])]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = sorted(((-1 if r.vec_id is None else r.vec_id, r.n_links, r.component_id) for r in pivot_index.near_vectors(df).collect()))
    want = sorted([(-1, 2, 0), (0, 2, 0), (1, 2, 0), (4, 0, 4)] + [(i, 1, i // 2 * 2) for i in range(2, 30)])
    assert got == want


def test_hot_keys_are_joined_like_others(spark):
    big = cut(spark.range(3000).select("id", F.when(F.col("id") % 3 == 0, -1).otherwise(F.col("id") % 50).alias("k")), "big")
    small = cut(spark.range(-1, 45).select(F.col("id").alias("k"), (F.col("id") * 2).alias("v")), "small")
    for how in ("inner", "left"):
        got = sorted(map(tuple, join_hot(big, small, ["k"], how, hot=100).select("id", "k", "v").na.fill(-99).collect()))
        assert got == sorted(map(tuple, big.join(small, "k", how).select("id", "k", "v").na.fill(-99).collect()))


def test_ties_thresholds_and_few_labels(spark):
    docs = spark.createDataFrame([(1, "aa bb", "xx"), (3, "aa bb", "ww"), (4, "aa", None)], "doc_id long, text string, lang string")
    assert {r.lang_pred for r in rank_lang.identify(docs).collect()} == {"ww"}  # equally far: the first by name
    rows = [(i, ("good words " * (i % 5 + 1)) if i % 2 else ("xx " * 30), "s") for i in range(40)]
    texts = spark.createDataFrame(rows, "doc_id long, text string, source string")
    labels = spark.createDataFrame([(i, i % 2) for i in range(12)], "doc_id long, quality int")  # under five of a class: not divided
    model = nbsvm.fit(texts, labels)
    scored = nbsvm.score(texts, model).collect()
    assert {r.predicted for r in scored if r.doc_id % 2} == {1} and {r.predicted for r in scored if r.doc_id % 2 == 0} == {0}
    at = max(r.score for r in scored if r.doc_id % 2 == 0)
    assert {r.predicted for r in nbsvm.score(texts, model, threshold=at).collect() if r.score == at} == {1}
    assert nbsvm.fit(texts, labels.where("quality = 1"))["slope"] == 0.0
