"""Token ids in sorted-string-table shards.

A shard holds documents in ascending key order. A key is the doc_id as eight bytes that sort as the number does; a null
doc_id is the empty key, which comes first. Entries stand in blocks: length of the prefix shared with the key
before, rest of the key, ids. Every block starts with a whole key. After the blocks come the sparse index (first key,
offset and length of each block), a Bloom filter over the keys and a footer of fixed size. A lookup reads footer,
filter and index, searches the index by bisection and reads one block.

    block   := entry*          entry := varint shared, varint rest, varint value bytes, rest of key, value
    index   := (varint key bytes, key, u64 offset, u64 length)*
    footer  := u64 index at, u64 index bytes, u64 filter at, u64 filter bytes, u64 documents, u64 ids, u32 width, u32 crc32, "LSST0001"

Cases: a null text has the end id only; repeated ids stand beside each other in order of their text; other columns
are left out; an empty table gives no shards and no rows.
"""

from __future__ import annotations

import bisect
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestar.llm.common import strings, tasks_for
from lodestar.llm.storage import fresh, locate
from lodestar.llm.tokens import encoder
from lodestar.session import cut, prepare, scratch

MAGIC, FOOTER = b"LSST0001", struct.Struct("<6QII8s")


def key_of(doc_id: int | None) -> bytes:
    return b"" if doc_id is None else (doc_id + (1 << 63)).to_bytes(8, "big")


def id_of(key: bytes) -> int | None:
    return int.from_bytes(key, "big") - (1 << 63) if key else None


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _read_varint(data: bytes, at: int) -> tuple[int, int]:
    n = shift = 0
    while True:
        b = data[at]
        n |= (b & 127) << shift
        at, shift = at + 1, shift + 7
        if b < 128:
            return n, at


def _probes(key: bytes, bits: int, count: int = 7) -> list[int]:
    a, b = xxhash.xxh64_intdigest(key, 1), xxhash.xxh64_intdigest(key, 2) | 1
    return [(a + i * b) % bits for i in range(count)]


class Writer:
    """Writes one shard to an open stream; `width` is the bytes of an id."""

    def __init__(self, stream: pa.NativeFile, width: int, block_bytes: int = 64 << 10):
        self.stream, self.width, self.most = stream, width, block_bytes
        self.block, self.last, self.index, self.keys = bytearray(), b"", [], []
        self.at = self.ids = self.first = 0

    def add(self, key: bytes, ids: np.ndarray) -> None:
        if not self.block:
            self.head, self.last = key, b""
        shared = next((i for i, (x, y) in enumerate(zip(key, self.last, strict=False)) if x != y), min(len(key), len(self.last)))
        value = ids.astype(f"<u{self.width}").tobytes()
        self.block += _varint(shared) + _varint(len(key) - shared) + _varint(len(value)) + key[shared:]
        self.block += value
        self.last = key
        self.keys.append(key)
        self.ids += len(ids)
        if len(self.block) >= self.most:
            self._flush()

    def _flush(self) -> None:
        if self.block:
            self.stream.write(bytes(self.block))
            self.index.append((self.head, self.at, len(self.block)))
            self.at += len(self.block)
            self.block = bytearray()

    def close(self) -> None:
        self._flush()
        index = b"".join(_varint(len(k)) + k + struct.pack("<QQ", at, n) for k, at, n in self.index)
        bits = max(64, 10 * len(self.keys))
        bloom = np.zeros(-(-bits // 8), np.uint8)
        for k in set(self.keys):
            for p in _probes(k, len(bloom) * 8):
                bloom[p >> 3] |= 1 << (p & 7)
        bloom_bytes = bloom.tobytes()
        crc = zlib.crc32(bloom_bytes, zlib.crc32(index))
        self.stream.write(index + bloom_bytes)
        self.stream.write(FOOTER.pack(self.at, len(index), self.at + len(index), len(bloom_bytes), len(self.keys), self.ids, self.width, crc, MAGIC))
        self.stream.close()


class Reader:
    """Reads a shard by ranges: all entries in order, or one key."""

    def __init__(self, uri: str):
        fs, path = locate(uri)
        self.file = fs.open_input_file(path)
        size = self.file.size()
        foot = FOOTER.unpack(self.file.read_at(FOOTER.size, size - FOOTER.size))
        if foot[-1] != MAGIC:
            raise ValueError(f"{uri}: not a token table")
        self.documents, self.ids, self.width = foot[4], foot[5], foot[6]
        index, self.bloom = self.file.read_at(foot[1], foot[0]), self.file.read_at(foot[3], foot[2])
        if zlib.crc32(self.bloom, zlib.crc32(index)) != foot[7]:
            raise ValueError(f"{uri}: index or filter damaged")
        self.blocks, at = [], 0
        while at < len(index):
            n, at = _read_varint(index, at)
            self.blocks.append((index[at : at + n], *struct.unpack_from("<QQ", index, at + n)))
            at += n + 16

    def _entries(self, block: int) -> Iterator[tuple[bytes, np.ndarray]]:
        _, start, n = self.blocks[block]
        data, at, key = self.file.read_at(n, start), 0, b""
        while at < n:
            shared, at = _read_varint(data, at)
            rest, at = _read_varint(data, at)
            value, at = _read_varint(data, at)
            key = key[:shared] + data[at : at + rest]
            at += rest
            yield key, np.frombuffer(data, f"<u{self.width}", value // self.width, at)
            at += value

    def scan(self) -> Iterator[tuple[bytes, np.ndarray]]:
        for b in range(len(self.blocks)):
            yield from self._entries(b)

    def get(self, doc_id: int | None) -> list[np.ndarray]:
        """The ids of every entry with this key."""
        key = key_of(doc_id)
        if not all(self.bloom[p >> 3] >> (p & 7) & 1 for p in _probes(key, len(self.bloom) * 8)):
            return []
        heads = [b[0] for b in self.blocks]
        found = []
        for b in range(max(0, bisect.bisect_left(heads, key) - 1), bisect.bisect_right(heads, key)):
            found += [ids for k, ids in self._entries(b) if k == key]
        return found

    def close(self) -> None:
        self.file.close()


def write_shards(docs: DataFrame, tokenizer: str, end_id: int, shard_bytes: int = 256 << 20) -> DataFrame:
    """Write `docs` (doc_id, text) in ascending order; (path, part, roll, documents, ids) for each shard."""
    spark = prepare(docs.sparkSession)
    folder = scratch(spark, "token-table")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        end, width = np.array([end_id], "<u4").tobytes(), 2 if max(words.vocabulary - 1, end_id) < 1 << 16 else 4
        writer, path, out = None, "", []

        def close() -> None:
            writer.close()
            out.append((path, part, len(out), len(writer.keys), writer.ids))

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                if writer is None:
                    path = fresh(folder, part, ".lsst")
                    fs, at = locate(path)
                    writer = Writer(fs.open_output_stream(at), width)
                writer.add(key_of(doc), np.frombuffer(words.encode(text or "") + end, "<u4"))
                if writer.at >= shard_bytes:
                    close()
                    writer = None
        if writer is not None:
            close()
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["path", "part", "roll", "documents", "ids"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    head = F.substring("text", 1, 32)  # an id that very many rows repeat is spread too, if their texts differ
    ordered = rows.repartitionByRange("doc_id", head).sortWithinPartitions("doc_id", "text")
    return cut(ordered.mapInArrow(write, "path string, part long, roll long, documents long, ids long"), "token-shards")


def read_shards(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, read back from the shards."""
    before = F.sum("ids").over(Window.orderBy("part", "roll").rowsBetween(Window.unboundedPreceding, -1))  # a row for each shard

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                reader, rows = Reader(path), []
                for key, ids in reader.scan():
                    rows.append((id_of(key), at, len(ids), zlib.crc32(ids.astype("<u4").tobytes())))
                    at += len(ids)
                    if len(rows) == 65536:
                        yield batch(rows)
                        rows = []
                reader.close()
                yield batch(rows)

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], pa.int64()) for i in range(4)], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    files, ids = shards.agg(F.count("*"), F.coalesce(F.sum("ids"), F.lit(0))).first()
    tasks = tasks_for(shards.sparkSession, 4 * ids, files)
    placed = shards.withColumn("base", F.coalesce(before, F.lit(0)).cast("long"))
    return placed.select("path", "base").repartition(tasks).mapInArrow(read, "doc_id long, start long, n_tokens long, ids_crc32 long")
