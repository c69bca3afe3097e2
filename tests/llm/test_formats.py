"""Packing, token tables, media shards and archives: exact round trips."""

from __future__ import annotations

import hashlib
import io
import tarfile
import zlib

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from lodestar.llm import media_shards, packing, token_table, tokens, warc_chunks
from lodestar.llm.storage import locate

BYTE, WORD = (public_tokenizers.path(n) for n in ("byte_bpe_50k.json", "word_bpe_49k.json"))
TEXTS = [(1, "Hello, world. It's  two spaces"), (2, None), (3, ""), (4, "Éa ñ 中文 😀\n\n\tx" * 40), (4, "same id"), (None, "no id"), (9, "word " * 5000), (10, "word " * 700), (11, "<|endoftext|> tail")]


def frame(spark, rows=TEXTS):
    return spark.createDataFrame([(i, t, "c") for i, t in rows], "doc_id long, text string, length string")


@pytest.fixture(scope="module")
def whole():
    out = {}
    for p in (BYTE, WORD):
        out[p] = Tokenizer.from_file(p)
        out[p].encode_special_tokens = True
    return out


@settings(max_examples=300, deadline=None)
@given(st.text(st.one_of(st.sampled_from(" \n\t\r'sdtrelvm,.ABÉéßİςΣ1٣½-! 　́\x1f中😀"), st.characters(codec="utf-8")), max_size=60))
def test_words_give_the_ids_of_whole_texts(text):
    for path in (BYTE, WORD):
        e = tokens.encoder(path)
        assert e.by_word
        assert np.frombuffer(e.encode(text), "<u4").tolist() == e.whole.encode(text, add_special_tokens=False).ids


def test_packing_covers_every_id_once(spark, whole):
    rows = TEXTS + [(100 + i, "some words of a document " * (i % 97)) for i in range(300)]
    got = packing.pack(frame(spark, rows).repartition(5), BYTE, open_windows=4).toPandas()
    want = sorted((i if i is not None else -1, whole[BYTE].encode(t or "", add_special_tokens=False).ids + [0]) for i, t in rows)
    by_doc = {}
    for r in got.itertuples():
        by_doc.setdefault(-1 if r.doc_id != r.doc_id else int(r.doc_id), []).append(r)
    for i, ids in want:
        if [w[0] for w in want].count(i) > 1:
            continue
        pieces = sorted(by_doc[i], key=lambda r: r.start)
        assert [p.start for p in pieces] == np.cumsum([0] + [p.length for p in pieces])[:-1].tolist()
        assert sum(p.length for p in pieces) == len(ids) == pieces[0].doc_tokens
        for p in pieces:
            assert p.ids_crc32 == zlib.crc32(np.array(ids[p.start : p.start + p.length], "<u4").tobytes())
    assert got.length.sum() == sum(len(ids) for _, ids in want)
    for _, g in got.groupby("sequence_id"):
        g = g.sort_values("offset")
        assert g.offset.tolist() == np.cumsum([0] + g.length.tolist())[:-1].tolist() and g.length.sum() <= 1024
    totals = got.groupby("sequence_id").length.sum()
    assert sum(1024 - x for x in totals) < 0.05 * 1024 * len(totals)
    assert packing.pack(frame(spark).where(F.lit(False)), BYTE).count() == 0


def test_token_table_round_trip_and_lookup(spark, whole):
    rows = [(i, t) for i, t in TEXTS if i != 4] + [(-5, "negative"), (4, "b"), (4, "a")]
    shards = token_table.write_shards(frame(spark, rows), WORD, end_id=2)
    got = sorted(map(tuple, token_table.read_shards(shards).collect()), key=lambda r: r[1])
    order = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    at = 0
    for (i, t), r in zip(order, got, strict=True):
        ids = whole[WORD].encode(t or "", add_special_tokens=False).ids + [2]
        assert r == (i, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        at += len(ids)
    readers = [token_table.Reader(r.path) for r in shards.collect()]
    assert sum(len(r.get(4)) for r in readers) == 2
    assert not any(r.get(12345) for r in readers)
    one = [x for r in readers for x in r.get(9)]
    assert one[0].tolist() == whole[WORD].encode("word " * 5000, add_special_tokens=False).ids + [2]
    assert token_table.read_shards(token_table.write_shards(frame(spark).where(F.lit(False)), WORD, 2)).count() == 0


def test_token_table_blocks_and_damage(tmp_path):
    import pyarrow.fs as pafs

    path = str(tmp_path / "t.lsst")
    w = token_table.Writer(pafs.LocalFileSystem().open_output_stream(path), 4, block_bytes=256)
    for i in range(500):
        w.add(token_table.key_of(i * 7 - 900), np.arange(i % 9) + 70000)
    w.close()
    r = token_table.Reader(path)
    assert len(r.blocks) > 10
    assert [(token_table.id_of(k), v.tolist()) for k, v in r.scan()] == [(i * 7 - 900, (np.arange(i % 9) + 70000).tolist()) for i in range(500)]
    assert all(r.get(i * 7 - 900)[0].tolist() == (np.arange(i % 9) + 70000).tolist() for i in range(500))
    assert not any(r.get(i * 7 - 899) for i in range(500))
    raw = bytearray(open(path, "rb").read())
    raw[-80] ^= 255
    open(path, "wb").write(raw)
    with pytest.raises(ValueError):
        token_table.Reader(path)


def test_media_round_trip(spark):
    rows = TEXTS + [(20, "word " * 700), (21, "x" * 64), (22, "x" * 63)]
    got = media_shards.media_columns(frame(spark, rows).repartition(3)).collect()
    want = {}
    for i, t in rows:
        b = (t or "").encode()
        p = b + bytes(max(64, -(-len(b) // 64) * 64) - len(b))
        want.setdefault(i, []).append((len(b), len(p), hashlib.sha256(p).hexdigest(), zlib.crc32(p[-64:])))
    found = {}
    for r in got:
        found.setdefault(r.doc_id, []).append((r.n_bytes, r.payload_bytes, r.payload_sha256, r.tail_crc32))
        assert (r.width, r.height, r.bits) == (64, r.payload_bytes // 64, 8)
    assert {k: sorted(v) for k, v in found.items()} == {k: sorted(v) for k, v in want.items()}
    same = {r.doc_id: (f"{r.folder}/{r.shard}", r.offset, r.media_sha256, r.feature) for r in got}
    assert same[10] == same[20]
    fs, path = locate(same[10][0])
    with tarfile.open(fileobj=io.BytesIO(fs.open_input_file(path).read())) as t:  # a plain tar reader can read the shard
        assert all(hashlib.sha256(media_shards.from_png(t.extractfile(m).read())).hexdigest() + ".png" == m.name for m in t)
    folder = got[0].folder
    index = media_shards.write_shards(frame(spark, rows), folder + "-2")
    heads = media_shards.header_columns(media_shards.canonical(index), folder + "-2").collect()
    assert {(r.width, r.height, r.bits) for r in heads} == {(r.width, r.height, r.bits) for r in got}
    assert media_shards.media_columns(frame(spark).where(F.lit(False))).count() == 0


def test_png_damage_is_seen():
    media = bytearray(media_shards.to_png(b"a" * 128))
    media[50] ^= 1
    with pytest.raises(ValueError):
        media_shards.from_png(bytes(media))


def pages(spark, rows):
    return spark.createDataFrame(rows, "page_id long, url string, html string, last string")


def test_archives_round_trip(spark):
    long = "<p>é</p>\r\n\r\nWARC/1.1\r\n" * 4000
    rows = [(3, "http://a/ü?x=1\n2", long, ""), (1, None, long, ""), (2, "u", "short", ""), (5, "u", "short", ""), (6, "u", None, ""), (7, "u", "", ""), (8, "u", "y" * 100, ""), (9, "u", "y" * 100, ""), (10, "u", "y" * 99, ""), (None, "u", "y" * 100, "")]
    archives = warc_chunks.write_archives(warc_chunks.plan(pages(spark, rows)).repartition(2), chunk=1000)
    chunks = warc_chunks.read_chunks(archives, chunk=1000)
    got = {r.page_id: tuple(r) for r in warc_chunks.resolve(chunks).collect()}
    sha = lambda t: hashlib.sha256((t or "").encode()).hexdigest()
    first = {sha(long): 1, sha("y" * 100): 8}
    for i, _, t, _ in rows:
        again = len((t or "").encode()) >= 100 and first[sha(t)] != i
        assert got[i] == (i, len((t or "").encode()), sha(t), "revisit" if again else "response", first[sha(t)] if again else None)
    parts = [r for r in chunks.where("page_id = 1").orderBy("chunk_no").collect()]
    body = b"".join(r.chunk for r in parts)
    assert body == long.encode() and len(parts) == -(-len(body) // 1000)
    for r in parts:
        assert r.payload_digest == hashlib.sha256(body[: r.payload_bytes]).hexdigest()
    empty = warc_chunks.write_archives(warc_chunks.plan(pages(spark, rows).where(F.lit(False))))
    assert warc_chunks.resolve(warc_chunks.read_chunks(empty)).count() == 0
