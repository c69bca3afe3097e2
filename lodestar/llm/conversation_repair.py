"""Repair of the structure of conversations: the cheapest edits after which roles follow the grammar (s?(ua)+)?.

Rows are (conv_id, turn, role, text). A row's first fault counts: blank (nothing but white space), duplicate (role and text
stood in an earlier row of its conversation), truncated (the last visible character ends no sentence). Edits: Keep costs 0, Rerole
to user or assistant 3, Delete 4, Insert an empty turn 3; blank and duplicate rows must go; a truncated row that stays
adds 3. Of repairs that cost the same, the one whose audit (the initials of its edits in order) comes first as a string is taken.

A forward Viterbi pass goes over each conversation with four states: nothing yet, after a system turn, after a user turn, after
an assistant turn. A state carries the least (cost, audit) and the running digest of the turns it has kept. A row moves states by its
edits; then inserts close the layer, two at most, as a third would come back to a state. Two audits of equal cost in one
layer are never one the start of the other, as each further letter costs, so the lesser prefix stays the lesser.

Earlier copies of a text are found by Spark: the least place of every (conversation, role, digest of the text) is counted before it
is joined, so a text that a long conversation repeats is one row. The pass itself is a stream over rows sorted by conversation and turn:
texts are digested and let go, states share the audit they have in common, and a conversation takes memory only for its
audit, which is a cell of the result. The digest of a repaired conversation is sequential by its nature, so one
conversation is one task's stream, however long.

Cases: null roles and texts are one space; null turns come first and leave the gaps alone; a null conv_id is a conversation
of its own; rows of equal turn are ordered by role and digest of the text; other columns are left out; an empty table gives an empty table.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestar.llm.common import join_hot, strings
from lodestar.session import cut, prepare

#: White space, and the states (from, to) between which a role's initial moves.
WHITE = " \t\n\x0b\x0c\r"
KEEP = {"s": ((0, 1),), "u": ((0, 2), (1, 2), (3, 2)), "a": ((2, 3),)}
PUT = (("user", KEEP["u"]), ("assistant", KEEP["a"]))
PLAN = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"


def faults(rows: DataFrame) -> DataFrame:
    """Rows with nulls filled, `digest` of the text, and whether the same role and text stood at an earlier turn (`later`); written once."""
    prepare(rows.sparkSession)
    filled = rows.select(
        F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
        F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"),
    )
    filled = filled.withColumns({"digest": F.md5(F.col("text").cast("binary")), "conv": F.coalesce(F.col("conv_id").cast("string"), F.lit("")), "place": F.struct(F.col("turn").isNotNull().alias("known"), F.col("turn"))})
    held = cut(filled, "turns")
    first = held.groupBy("conv", "role", "digest").agg(F.min("place").alias("first"), F.count("*").alias("n")).where("n > 1").drop("n")
    marked = join_hot(held, cut(first, "repeated-turns"), ["conv", "role", "digest"], "left")
    return marked.select("conv_id", "turn", "role", "text", "digest", F.coalesce(F.col("place") > F.col("first"), F.lit(False)).alias("later"))


def _in_order(rows: DataFrame, *first: str) -> DataFrame:
    return rows.repartition("conv_id").sortWithinPartitions(F.col("conv_id").asc_nulls_first(), *first, F.col("turn").asc_nulls_first(), "role", "digest")


class Repair:
    """The Viterbi pass over one conversation, row by row.

    A state is (cost, rank, tail, sealed, digest). Its audit is the chain of pieces `sealed` and then `tail`. Now and then all tails
    are sealed to the same length; ranks tell how the sealed parts compare, equal ones share their chain.
    """

    def __init__(self, conv_id: int | None):
        self.conv_id = conv_id
        self.states = {0: (0, 0, "", None, None)}
        self.low = self.high = self.last = self.before = None
        self.turns = self.blank = self.duplicate = self.truncated = self.illegal = 0
        self._close()

    def _offer(self, new: dict, moves: tuple, cost: int, letter: str, role: str, text: str) -> None:
        """Offer an edit that appends a turn to the states it can follow; its digest waits until the best is known."""
        for a, b in moves:
            if a in self.states:
                total, rank, tail, sealed, digest = self.states[a]
                found = (total + cost, rank, tail + letter, sealed, digest, role, text)
                if b not in new or found[:3] < new[b][:3]:
                    new[b] = found

    @staticmethod
    def _settled(state: tuple) -> tuple:
        if len(state) == 5:
            return state
        digest, turn = state[4], f"{state[5]}:{state[6]}".encode()
        if digest is None:
            digest = hashlib.sha256(turn)
        else:
            digest = digest.copy()
            digest.update(b"\n" + turn)
        return (*state[:4], digest)

    def _close(self) -> None:
        for _ in range(2):
            new: dict = {}
            for role, moves in PUT:
                self._offer(new, moves, 3, "I", role, "")
            for b, s in new.items():
                if b not in self.states or s[:3] < self.states[b][:3]:
                    self.states[b] = self._settled(s)

    def _seal(self) -> None:
        size = min(len(s[2]) for s in self.states.values())
        order = sorted({(s[1], s[2][:size]) for s in self.states.values()})
        nodes: dict = {}
        for b, (cost, rank, tail, sealed, digest) in self.states.items():
            key = rank, tail[:size]
            node = nodes.setdefault(key, (sealed, tail[:size]))
            self.states[b] = (cost, order.index(key), tail[size:], node, digest)

    def add(self, turn: int | None, role: str, text: str, digest: str, later: bool) -> None:
        if turn is not None:
            self.turns += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn
        if self.before is not None:
            self.illegal += self.before[:1] + role[:1] not in ("su", "ua", "au")
        visible, same = text.rstrip(WHITE), self.last == (role, digest)
        self.before, self.last = role, (role, digest)
        extra, stays = 0, False
        if not visible:
            self.blank += 1
        elif later or same:
            self.duplicate += 1
        else:
            stays = True
            if visible[-1] not in ".!?":
                self.truncated += 1
                extra = 3
        new: dict = {}
        if stays:
            self._offer(new, KEEP.get(role[:1], ()), extra, "K", role, text)
            for name, moves in PUT:
                self._offer(new, moves, 3 + extra, "R", name, text)
        for state, (cost, rank, tail, sealed, kept) in self.states.items():
            gone = (cost + 4, rank, tail + "D", sealed, kept)
            if state not in new or gone[:3] < new[state][:3]:
                new[state] = gone
        self.states = {b: self._settled(s) for b, s in new.items()}
        self._close()
        if len(self.states[0][2]) > 1024:
            self._seal()

    def result(self) -> tuple:
        cost, _, tail, sealed, digest = min((self.states[k] for k in (0, 3)), key=lambda s: s[:3])
        pieces = [tail]
        while sealed:
            sealed, piece = sealed
            pieces.append(piece)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.turns
        return self.conv_id, gaps, self.blank, self.duplicate, self.truncated, self.illegal, cost, "".join(reversed(pieces)), (digest or hashlib.sha256()).hexdigest()


def plans(marked: DataFrame) -> DataFrame:
    """One row for each conversation of faults(): counts of faults, least cost, audit and digest of the repaired turns."""
    kinds = (pa.int64(),) * 7 + (pa.string(),) * 2
    names = [c.split(" ")[0] for c in PLAN.split(", ")]

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=names)

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, out, held = None, [], 0
        for b in batches:
            ids, turns, roles, digests, laters = (b.column(k).to_pylist() for k in (0, 1, 2, 4, 5))
            for conv, turn, role, text, digest, later in zip(ids, turns, roles, strings(b.column(3)), digests, laters, strict=True):
                if now is None or conv != now.conv_id:
                    if now is not None:
                        out.append(now.result())
                        held += 200 + len(out[-1][7])
                    now = Repair(conv)
                    if held > 8 << 20:
                        yield batch(out)
                        out, held = [], 0
                now.add(turn, role, text, digest, later)
        if now is not None:
            out.append(now.result())
        yield batch(out)

    return _in_order(marked).mapInArrow(each, PLAN)


def repaired(marked: DataFrame, planned: DataFrame) -> DataFrame:
    """(conv_id, place, role, text): the turns that the audits of plans() leave, in order from 0."""
    heads = planned.select("conv_id", F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.col("audit").alias("text"), F.lit("").alias("digest"), F.lit(0).alias("kind"))
    rows = heads.unionByName(marked.select("conv_id", "turn", "role", "text", "digest", F.lit(1).alias("kind")))
    kinds = (pa.int64(), pa.int64(), pa.string(), pa.string())

    def batch(rows: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, t in enumerate(kinds)], names=["conv_id", "place", "role", "text"])

    def each(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, audit, at, place, role = None, "", 0, 0, ""
        out, held = [], 0

        def put(name: str, text: str) -> None:
            nonlocal place, role, held
            out.append((conv, place, name, text))
            held += 100 + len(text)
            place, role = place + 1, name[:1]

        def inserts() -> None:
            nonlocal at
            while at < len(audit) and audit[at] == "I":
                put("assistant" if role == "u" else "user", "")
                at += 1

        for b in batches:
            ids, names, kind = (b.column(k).to_pylist() for k in (0, 2, 5))
            for c, name, text, k in zip(ids, names, strings(b.column(3)), kind, strict=True):
                if k == 0:
                    conv, audit, at, place, role = c, text, 0, 0, ""
                    inserts()
                    continue
                letter, at = audit[at], at + 1
                if letter == "K":
                    put(name, text)
                elif letter == "R":
                    put("assistant" if role == "u" else "user", text)
                inserts()
                if held > 8 << 20:
                    yield batch(out)
                    out, held = [], 0
        yield batch(out)

    return _in_order(rows, "kind").mapInArrow(each, "conv_id long, place long, role string, text string")


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows (conv_id, turn, role, text) with planted faults, by the remainder of crc32('conv_id:turn') modulo 20.

    0 drops a row, 1 empties its text, 2 removes the ends of its sentences, 3 repeats it, 4 makes it a user's. Nulls are one space first.
    """
    told = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    how = F.crc32(F.concat_ws(":", told("conv_id"), told("turn")).cast("binary")) % 20
    text = F.when(how == 1, F.lit("")).when(how == 2, F.regexp_replace(told("text"), "[.!?]", "")).otherwise(told("text"))
    copies = F.when(how == 0, 0).when(how == 3, 2).otherwise(1)
    row = F.struct("conv_id", "turn", F.when(how == 4, F.lit("user")).otherwise(told("role")).alias("role"), text.alias("text"))
    return conversations.select(F.explode(F.array_repeat(row, copies)).alias("r")).select("r.*")
