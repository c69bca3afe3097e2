"""Bounded-space online packing of token sequences.

Each partition keeps at most `open_windows` windows open. Of a document, whole windows are cut off first; what is left
goes to the open window it fits best. If it fits none and all are in use, the fullest window is emitted: the
piece is cut to fill its gap if the gap has `min_cut` ids or more, else the gap stays as padding. Windows still open at
the end of a partition are leftovers; their pieces, with ids, are packed again in the same way, longest
first, those of `fan_in` partitions in one task. So memory is bounded in both rounds and no task sees all leftovers. Where a
sequence whose length is a power of two needs no padding (`powers`), the windows left at the very end are cut into such.

Cases: a null text is empty and has the end id only. A null doc_id stays null. Repeated rows are packed each
by itself. Other columns are left out. An empty table gives no rows.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import strings
from lodestar.llm.tokens import encoder
from lodestar.session import cut, prepare

PIECE = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


class Packer:
    """Places pieces (doc, start, ids, doc_tokens) in windows; `done` gets (sequence, pieces) as windows close."""

    def __init__(self, size: int, open_windows: int, min_cut: int, done: Callable[[list], None]):
        self.size, self.most, self.min_cut, self.done = size, open_windows, min_cut, done
        self.windows: list[list] = []
        self.room = np.zeros(0, np.int64)

    def _emit(self, k: int) -> None:
        self.done(self.windows.pop(k))
        self.room = np.delete(self.room, k)

    def _open(self, piece: tuple, n: int) -> None:
        self.windows.append([piece])
        self.room = np.append(self.room, self.size - n)

    def add(self, doc: int | None, start: int, ids: bytes, tokens: int) -> None:
        n, at = len(ids) // 4, 0
        if n >= self.size:  # a view: whole windows are cut off without copying the rest each time
            view = memoryview(ids)
            while n >= self.size:
                self.done([(doc, start, view[at : at + 4 * self.size], tokens)])
                start, at, n = start + self.size, at + 4 * self.size, n - self.size
            ids = bytes(view[at:])
        if not n:
            return
        fits = np.where(self.room >= n, self.room, self.size + 1)
        k = int(np.argmin(fits)) if len(fits) else -1
        if k >= 0 and fits[k] <= self.size:
            self.windows[k].append((doc, start, ids, tokens))
            self.room[k] -= n
            if self.room[k] == 0:
                self._emit(k)
            return
        if len(self.windows) >= self.most:
            k = int(np.argmin(self.room))
            gap = int(self.room[k])
            if gap >= self.min_cut:
                self.windows[k].append((doc, start, ids[: 4 * gap], tokens))
                start, ids, n = start + gap, ids[4 * gap :], n - gap
            self._emit(k)
        self._open((doc, start, ids, tokens), n)


def unpadded(window: list[tuple]) -> Iterator[list[tuple]]:
    """The window cut into sequences whose lengths are powers of two, the longest first: these need no padding."""
    left = sum(len(p[2]) // 4 for p in window)
    part, room = [], 1 << left.bit_length() - 1
    for doc, start, ids, tokens in window:
        at = 0
        while at < len(ids) // 4:
            n = min(room, len(ids) // 4 - at)
            part.append((doc, start + at, ids[4 * at : 4 * (at + n)], tokens))
            at, room, left = at + n, room - n, left - n
            if not room:
                yield part
                part, room = [], 1 << left.bit_length() - 1 if left else 0


class _Rows:
    """Collects pieces of closed windows as columns."""

    def __init__(self, first: int):
        self.sequence, self.cols = first, [[] for _ in range(7)]

    def close(self, window: list) -> None:
        at = 0
        for doc, start, ids, tokens in window:
            for col, v in zip(self.cols, (doc, start, len(ids) // 4, zlib.crc32(ids), tokens, self.sequence, at), strict=True):
                col.append(v)
            at += len(ids) // 4
        self.sequence += 1

    def batch(self) -> list[pa.Array]:
        out = [pa.array(c, pa.int64()) for c in self.cols]
        self.cols = [[] for _ in range(7)]
        return out


NAMES = [x.split()[0] for x in PIECE.split(", ")]


def pack(
    docs: DataFrame,
    tokenizer: str,
    end_id: int = 0,
    size: int = 1024,
    open_windows: int = 64,
    min_cut: int = 16,
    fan_in: int = 16,
    powers: bool = False,
) -> DataFrame:
    """One row for each piece of each document of `docs` (doc_id, text); see PIECE."""
    prepare(docs.sparkSession)
    end = np.array([end_id], "<u4").tobytes()

    def online(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, part = encoder(tokenizer), TaskContext.get().partitionId()
        rows = _Rows(part << 32)
        packer = Packer(size, open_windows, min_cut, rows.close)

        def out(left: list[tuple]) -> pa.RecordBatch:
            cols = rows.batch()
            n, m = len(cols[0]), len(left)
            more = [pa.array([x[i] for x in left], pa.int64()) for i in (0, 1)] + [pa.array([len(x[2]) // 4 for x in left], pa.int64()), pa.nulls(m, pa.int64()), pa.array([x[3] for x in left], pa.int64()), pa.nulls(m, pa.int64()), pa.nulls(m, pa.int64())]
            cols = [pa.concat_arrays([a, b]) for a, b in zip(cols, more, strict=True)]
            cols.append(pa.array([None] * n + [part // fan_in] * m, pa.int64()))
            cols.append(pa.array([None] * n + [x[2] for x in left], pa.binary()))
            return pa.RecordBatch.from_arrays(cols, names=[*NAMES, "merge", "ids"])

        for b in batches:
            for doc, text in zip(b.column(0).to_pylist(), strings(b.column(1)), strict=True):
                ids = words.encode(text or "") + end
                packer.add(doc, 0, ids, len(ids) // 4)
            yield out([])
        yield out([p for w in packer.windows for p in w])

    def merge(group: pa.Table) -> pa.Table:
        rows = _Rows((1 << 62) | (group.column("merge")[0].as_py() << 32))
        packer = Packer(size, open_windows, min_cut, rows.close)
        pieces = zip(*(group.column(c).to_pylist() for c in ("length", "doc_id", "start", "ids", "doc_tokens")), strict=True)
        for _, doc, start, ids, tokens in sorted(pieces, key=lambda p: (-p[0], p[1] is None, p[1], p[2])):
            packer.add(doc, start, ids, tokens)
        for w in packer.windows:
            for part in unpadded(w) if powers else [w]:
                rows.close(part)
        return pa.table(rows.batch(), names=NAMES)

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    placed = cut(rows.mapInArrow(online, f"{PIECE}, merge long, ids binary"), "packing")
    merged = placed.where("merge is not null").groupBy("merge").applyInArrow(merge, PIECE)
    return placed.where("merge is null").select(*NAMES).unionByName(merged)
