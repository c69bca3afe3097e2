"""Media payloads by content address in tar shards.

A payload is the UTF-8 text padded with bytes 0 to a positive multiple of 64. It is stored without loss as the samples of an
8-bit grey PNG, 64 wide, named by the SHA-256 of the payload, in a POSIX tar shard. Each task writes shards of its
own and stores a payload once per shard, so nothing is moved to write them, and a payload that a third of all
rows share costs one member for each shard. The index says for each row: digest, shard, offset and length of
the media. One address (the smallest) of each digest is canonical; only these are read.

Metadata columns come from ranged reads of the tar header and the first 33 bytes of the PNG; features come from the samples.

Cases: a null text is empty: one row of zeros. Equal texts share one address and all values. A null doc_id stays null;
repeated rows each get their row. Other columns are left out; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
import struct
import tarfile
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import join_hot, tasks_for, utf8_of
from lodestar.llm.storage import fresh, locate
from lodestar.session import cut, prepare, scratch

WIDTH, SIGNATURE = 64, b"\x89PNG\r\n\x1a\n"
HEADER = tarfile.BLOCKSIZE + 33  # tar header, PNG signature and IHDR


def padded(text: bytes) -> bytes:
    return text + bytes(max(WIDTH, -(-len(text) // WIDTH) * WIDTH) - len(text))


def _part(kind: bytes, body: bytes) -> bytes:
    return struct.pack(">I", len(body)) + kind + body + struct.pack(">I", zlib.crc32(kind + body))


def to_png(payload: bytes) -> bytes:
    """8-bit grey, one row for each 64 bytes."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    lines = np.zeros((len(rows), WIDTH + 1), np.uint8)  # filter 0 before each row
    lines[:, 1:] = rows
    head = struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)
    return SIGNATURE + _part(b"IHDR", head) + _part(b"IDAT", zlib.compress(lines.tobytes(), 9)) + _part(b"IEND", b"")


def png_size(head: bytes) -> tuple[int, int, int]:
    """Width, height and bit depth from the first 33 bytes."""
    if head[:8] != SIGNATURE or head[12:16] != b"IHDR":
        raise ValueError("not a PNG")
    return struct.unpack(">IIB", head[16:25])


def from_png(media: bytes) -> bytes:
    """The samples of a PNG written by to_png; checksums are verified."""
    width, height, _ = png_size(media)
    at, body = 8, b""
    while at < len(media):
        (n,) = struct.unpack_from(">I", media, at)
        kind, part = media[at + 4 : at + 8], media[at + 8 : at + 8 + n]
        if zlib.crc32(kind + part) != struct.unpack_from(">I", media, at + 8 + n)[0]:
            raise ValueError("PNG chunk damaged")
        body += part if kind == b"IDAT" else b""
        at += n + 12
    lines = np.frombuffer(zlib.decompress(body), np.uint8).reshape(height, width + 1)
    return lines[:, 1:].tobytes()


def describe(samples: bytes) -> str:
    """Moments and an eight-bin histogram of the samples."""
    v = np.frombuffer(samples, np.uint8)
    bins = np.bincount(v >> 5, minlength=8)
    return f"n={len(v)};mean={v.mean():.4f};std={v.std():.4f};bins={','.join(map(str, bins))}"


def write_shards(docs: DataFrame, folder: str, shard_bytes: int = 256 << 20) -> DataFrame:
    """The index (doc_id, n_bytes, digest, shard, offset, length), written once.

    digest is binary, shard a file name in `folder`, offset that of the PNG in it.
    """
    prepare(docs.sparkSession)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stream, path, at, stored = TaskContext.get().partitionId(), None, "", 0, {}
        for b in batches:
            out: list[list] = [[], [], [], [], []]
            for text in utf8_of(b.column(1)):
                payload = padded(text)
                digest = hashlib.sha256(payload).digest()
                if stream is None:
                    path = fresh(folder, part, ".tar")
                    fs, name = locate(path)
                    stream, at, stored = fs.open_output_stream(name), 0, {}
                if digest not in stored:
                    media = to_png(payload)
                    member = tarfile.TarInfo(f"{digest.hex()}.png")
                    member.size = len(media)
                    stream.write(member.tobuf(tarfile.USTAR_FORMAT) + media + bytes(-len(media) % tarfile.BLOCKSIZE))
                    stored[digest] = (path.rsplit("/", 1)[1], at + tarfile.BLOCKSIZE, len(media))
                    at += tarfile.BLOCKSIZE + len(media) + -len(media) % tarfile.BLOCKSIZE
                for o, v in zip(out, (len(text), digest, *stored[digest]), strict=True):
                    o.append(v)
                if at >= shard_bytes:
                    stream.write(bytes(2 * tarfile.BLOCKSIZE))
                    stream.close()
                    stream = None
            kinds = [pa.int64(), pa.binary(), pa.string(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([b.column(0), *(pa.array(o, k) for o, k in zip(out, kinds, strict=True))], names=["doc_id", "n_bytes", "digest", "shard", "offset", "length"])
        if stream is not None:
            stream.write(bytes(2 * tarfile.BLOCKSIZE))
            stream.close()

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return cut(rows.mapInArrow(write, "doc_id long, n_bytes long, digest binary, shard string, offset long, length long"), "media-index")


def canonical(index: DataFrame) -> DataFrame:
    """(digest, shard, offset, length): one address for each digest, the smallest."""
    return index.groupBy("digest").agg(F.min(F.struct("shard", "offset", "length")).alias("a")).select("digest", "a.*")


def _header(file: pa.NativeFile, digest: bytes, offset: int, length: int) -> tuple[int, int, int]:
    """Width, height and bits by one ranged read of the tar header and the head of the PNG."""
    head = file.read_at(HEADER, offset - tarfile.BLOCKSIZE)
    member = tarfile.TarInfo.frombuf(head[: tarfile.BLOCKSIZE], "utf-8", "strict")
    if member.name != f"{digest.hex()}.png" or member.size != length:
        raise ValueError(f"{digest.hex()}: the shard has {member.name} there")
    return png_size(head[tarfile.BLOCKSIZE :])


def _body(file: pa.NativeFile, digest: bytes, offset: int, length: int) -> tuple:
    """Metadata by the header read, then what the stored bytes say."""
    size = _header(file, digest, offset, length)
    media = file.read_at(length, offset)
    samples = from_png(media)
    return (*size, len(samples), hashlib.sha256(samples).digest(), zlib.crc32(samples[-WIDTH:]), len(media), hashlib.sha256(media).digest(), describe(samples))


def _ranges(addresses: DataFrame, folder: str, added: str, read) -> DataFrame:
    """Addresses with the columns of read(file, digest, offset, length), ranges of shards in order of offset, as many as their bytes ask for."""
    schema = f"digest binary, shard string, offset long, {added}"
    names = [x.split()[0] for x in schema.split(", ")]
    kinds = [{"binary": pa.binary(), "string": pa.string(), "long": pa.int64()}[x.split()[1]] for x in schema.split(", ")]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shard, file = None, None
        for b in batches:
            rows = []
            for digest, name, offset, length in zip(*(b.column(c).to_pylist() for c in ("digest", "shard", "offset", "length")), strict=True):
                if name != shard:
                    if file is not None:
                        file.close()
                    fs, path = locate(f"{folder}/{name}")
                    shard, file = name, fs.open_input_file(path)
                rows.append((digest, name, offset, *read(file, digest, offset, length)))
            yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], k) for i, k in enumerate(kinds)], names=names)
        if file is not None:
            file.close()

    size, items = addresses.agg(F.coalesce(F.sum("length"), F.lit(0)), F.count("*")).first()
    tasks = tasks_for(addresses.sparkSession, size, items)
    return addresses.repartitionByRange(tasks, "shard", "offset").sortWithinPartitions("shard", "offset").mapInArrow(each, schema)


def header_columns(addresses: DataFrame, folder: str) -> DataFrame:
    """(digest, shard, offset, width, height, bits) from the headers alone: 545 bytes of each member are read."""
    return _ranges(addresses, folder, "width long, height long, bits long", _header)


def payload_columns(addresses: DataFrame, folder: str) -> DataFrame:
    """The header columns and, from the stored bytes, payload and media digests and the feature."""
    added = "width long, height long, bits long, payload_bytes long, payload_sha256 binary, tail_crc32 long, media_bytes long, media_sha256 binary, feature string"
    return _ranges(addresses, folder, added, _body)


def media_columns(docs: DataFrame) -> DataFrame:
    """Index, metadata and features of each row of `docs` (doc_id, text); digests as lower-case hex."""
    folder = scratch(docs.sparkSession, "media")
    index = write_shards(docs, folder)
    known = cut(payload_columns(cut(canonical(index), "media-addresses"), folder), "media-known")
    out = join_hot(index.select("doc_id", "n_bytes", "digest"), known, ["digest"]).drop("digest")
    return out.withColumns({c: F.lower(F.hex(c)) for c in ("payload_sha256", "media_sha256")}).withColumn("folder", F.lit(folder))
