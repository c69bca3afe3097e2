"""WARC archives written from rows and read back as a table of chunks.

Writing: a record for each row, a gzip member each, streamed in chunks. Of records with equal payloads of `least` bytes or
more, that with the smallest page_id is a response; the others are revisits that name it. Smaller ones are all
responses. Which is which is settled on digests alone, before the payloads move once.

Reading: an archive is inflated as a stream; a record comes out as rows (record, chunk number, bytes), each with the count and
SHA-256 of the payload so far, so no whole record is held in memory however large it is. The row marked `last`
carries the digest of the whole payload.

Cases: a null html is an empty payload. Rows that repeat a page_id and payload are all responses. A null page_id counts as
largest: it is a revisit of an equal page with an id, else a response. A null url leaves the target out. Other columns
are left alone; an empty table gives no archives and no rows.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator
from urllib.parse import quote

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import join_hot, tasks_for
from lodestar.llm.storage import fresh, locate
from lodestar.session import cut, prepare, scratch

HTTP = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n"
PROFILE = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"
CHUNKS = "archive string, record_id string, page_id long, record_type string, refers_to long, declared_digest string, chunk_no long, chunk binary, payload_bytes long, payload_digest string, last boolean"


def plan(pages: DataFrame, least: int = 100) -> DataFrame:
    """`pages` as (page_id, url, payload, digest, refers_to); refers_to is null for a response."""
    payload = F.encode(F.coalesce("html", F.lit("")), "UTF-8")
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), "url", payload.alias("payload"), F.sha2(payload, 256).alias("digest"))
    long = pages.select(F.col("page_id").cast("long").alias("page_id"), F.sha2(payload, 256).alias("digest"), F.length(payload).alias("n")).where(F.col("n") >= least)
    long = cut(long.select("page_id", "digest"), "warc-digests")
    first = long.groupBy("digest").agg(F.min("page_id").alias("first_id"), F.count("*").alias("n")).where("n > 1 and first_id is not null").drop("n")
    later = join_hot(long, cut(first, "warc-first"), ["digest"]).where("page_id is null or page_id <> first_id").select(F.col("page_id").alias("__id"), F.col("digest").alias("__digest"), F.col("first_id").alias("refers_to")).distinct()
    return rows.join(later, rows.page_id.eqNullSafe(later["__id"]) & (rows.digest == later["__digest"]), "left").drop("__id", "__digest")


def _record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None) -> tuple[bytes, memoryview]:
    """The head of a record and the payload bytes that follow it."""
    body = b"" if refers_to is not None else payload
    block = HTTP % len(payload)
    fields = [
        ("WARC-Type", "response" if refers_to is None else "revisit"),
        ("WARC-Record-ID", f"<urn:page:{page_id}>" if page_id is not None else f"<urn:page:none:{digest}>"),
        ("WARC-Date", "1970-01-01T00:00:00Z"),
        ("WARC-Target-URI", quote(url, safe=":/?#[]@!$&'()*+,;=%~") if url is not None else None),
        ("WARC-Payload-Digest", f"sha256:{digest}"),
        ("WARC-Refers-To", None if refers_to is None else f"<urn:page:{refers_to}>"),
        ("WARC-Profile", None if refers_to is None else PROFILE),
        ("Content-Type", "application/http;msgtype=response"),
        ("Content-Length", str(len(block) + len(body))),
    ]
    head = "WARC/1.1\r\n" + "".join(f"{k}: {v}\r\n" for k, v in fields if v is not None) + "\r\n"
    return head.encode() + block, memoryview(body)


def write_archives(planned: DataFrame, archive_bytes: int = 256 << 20, chunk: int = 1 << 20, range_bytes: int = 4 << 20) -> DataFrame:
    """(archive, offset, bytes, records): ranges of whole gzip members of the archives written, at least `range_bytes` each but the last."""
    folder = scratch(prepare(planned.sparkSession), "warc")

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, stream, path, begun, count, out = TaskContext.get().partitionId(), None, "", 0, 0, []
        for b in batches:
            for r in range(b.num_rows):  # one payload at a time
                page_id, url, payload, digest, refers_to = (b.column(c)[r].as_py() for c in ("page_id", "url", "payload", "digest", "refers_to"))
                if stream is None:
                    path, begun, count = fresh(folder, part, ".warc.gz"), 0, 0
                    fs, name = locate(path)
                    stream = fs.open_output_stream(name, compression=None)
                head, body = _record(page_id, url, payload, digest, refers_to)
                gz = zlib.compressobj(6, zlib.DEFLATED, 31)
                stream.write(gz.compress(head))
                for at in range(0, len(body), chunk):
                    stream.write(gz.compress(body[at : at + chunk]))
                stream.write(gz.compress(b"\r\n\r\n") + gz.flush())
                count += 1
                size = stream.tell()
                if size - begun >= range_bytes or size >= archive_bytes:
                    out.append((path, begun, size - begun, count))
                    begun, count = size, 0
                if size >= archive_bytes:
                    stream.close()
                    stream = None
        if stream is not None:
            if count:
                out.append((path, begun, stream.tell() - begun, count))
            stream.close()
        cols = [pa.array([r[i] for r in out], t) for i, t in enumerate((pa.string(), pa.int64(), pa.int64(), pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, names=["archive", "offset", "bytes", "records"])

    rows = planned.select("page_id", "url", "payload", "digest", "refers_to")
    return cut(rows.mapInArrow(write, "archive string, offset long, bytes long, records long"), "warc-archives")


class _Inflated:
    """The next `left` bytes of a gzip file, whole members, as one stream of bytes, a bounded piece at a time."""

    def __init__(self, file: pa.NativeFile, left: int, step: int):
        self.file, self.left, self.step, self.gz, self.held = file, left, step, zlib.decompressobj(31), bytearray()

    def _more(self) -> bool:
        data = self.gz.unconsumed_tail or self.gz.unused_data
        if self.gz.eof:
            self.gz = zlib.decompressobj(31)
        if not data:
            data = self.file.read(min(self.step, self.left))
            self.left -= len(data)
            if not data:
                return False
        self.held += self.gz.decompress(data, self.step)
        return True

    def line(self) -> bytes | None:
        """Up to and with the next CR LF; None at the end."""
        while (at := self.held.find(b"\r\n")) < 0:
            if not self._more():
                return None
        out = bytes(self.held[:at])
        del self.held[: at + 2]
        return out

    def some(self, most: int) -> bytes:
        """Exactly `most` bytes."""
        while len(self.held) < most:
            if not self._more():
                raise ValueError("archive ends within a record")
        out = bytes(self.held[:most])
        del self.held[:most]
        return out


def _number(urn: str | None) -> int | None:
    text = (urn or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def records(file: pa.NativeFile, size: int, chunk: int) -> Iterator[tuple]:
    """The chunk rows of the next `size` bytes of an archive, in its order."""
    data = _Inflated(file, size, chunk)
    while (line := data.line()) is not None:
        if not line:
            continue
        if not line.startswith(b"WARC/"):
            raise ValueError("not a WARC record")
        fields = {}
        while line := data.line():
            name, _, value = line.decode().partition(":")
            fields[name.lower()] = value.strip()
        left = int(fields["content-length"])
        while (line := data.line()) is not None:  # the HTTP head
            left -= len(line) + 2
            if not line:
                break
        told = (fields["warc-record-id"], _number(fields["warc-record-id"]), fields["warc-type"], _number(fields.get("warc-refers-to")), fields["warc-payload-digest"].removeprefix("sha256:"))
        digest, done, number = hashlib.sha256(), 0, 0
        while True:
            body = data.some(min(chunk, left))
            left -= len(body)
            done += len(body)
            digest.update(body)
            yield (*told, number, body, done, digest.hexdigest(), left == 0)
            number += 1
            if not left:
                break


def read_chunks(archives: DataFrame, chunk: int = 1 << 20, batch_bytes: int = 4 << 20) -> DataFrame:
    """The chunk table of `archives` (archive, offset, bytes); see CHUNKS. Ranges are read by as many tasks as their bytes ask for."""
    names = [x.split()[0] for x in CHUNKS.split(", ")]
    kinds = [pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.binary(), pa.int64(), pa.string(), pa.bool_()]

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, offset, length in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fs, name = locate(path)
                with fs.open_input_file(name) as file:
                    file.seek(offset)
                    rows, size = [], 0
                    for r in records(file, length, chunk):
                        rows.append((path, *r))
                        size += len(r[6]) + 200
                        if size >= batch_bytes:
                            yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)
                            rows, size = [], 0
                    yield pa.RecordBatch.from_arrays([pa.array([x[i] for x in rows], k) for i, k in enumerate(kinds)], names=names)

    size, ranges = archives.agg(F.coalesce(F.sum("bytes"), F.lit(0)), F.count("*")).first()
    tasks = tasks_for(archives.sparkSession, size, ranges)
    return archives.select("archive", "offset", "bytes").repartition(tasks).mapInArrow(each, CHUNKS)


def resolve(chunks: DataFrame) -> DataFrame:
    """A row for each record; a revisit takes length and digest from the response it names."""
    whole = chunks.where("last").select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "declared_digest")
    whole = cut(whole, "warc-records")
    own = whole.where("record_type = 'response'").select(F.col("page_id").alias("__id"), F.col("payload_digest").alias("__digest"), F.col("payload_bytes").alias("__bytes")).distinct()
    again = whole.where("record_type = 'revisit'").join(own, (F.col("refers_to") == F.col("__id")) & (F.col("declared_digest") == F.col("__digest")), "left")
    again = again.select("page_id", F.col("__bytes").alias("payload_bytes"), F.col("__digest").alias("payload_digest"), "record_type", "refers_to")
    return whole.where("record_type = 'response'").select(*again.columns).unionByName(again)
