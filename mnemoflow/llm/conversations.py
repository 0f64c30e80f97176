"""Repair of the structure of conversations: the cheapest edits that make a transcript follow the grammar of turns.

A transcript's roles must read ``s?(ua)+`` or nothing at all: a system turn at most, then user and assistant in
turn. A row that is blank, or says what its role said before, has to go; one whose text breaks off may stay at a
price. Rows can be kept, given the other role, deleted, and turns without text can be put in.

1. ``rows_of`` orders each conversation's rows. They're dealt by ranges of (conversation, turn), so that a
   conversation of any length is shared by many tasks.
2. Within a task each conversation is a block, or several of BLOCK rows. ``Chain`` holds what it costs to get
   through a block from each state of the grammar to each other.
3. The cost-to-go is taken backward over (turn, state). A conversation inside one task is solved there; of those
   that others share, only the 16 costs of each block meet in one task, which returns the cost-to-go at its end.
4. The walk goes forward: of the edits that keep to the cost-to-go it takes the one whose letter is least. The
   turns that it leaves are rebuilt and hashed as they come, a block at a time (a hash is sequential by nature).

Which text was said before is told by a grouping on the text's digest, combined before the shuffle; only groups of
several come back.

Defined results: a null conversation is one like others; null turns come first; rows of one turn are ordered by a
hash of role and text, then by these, so repeated rows are adjacent; a null role or text is one space; a role that
begins with no s, u or a must be changed or deleted; a conversation with no rows left has zeros, an empty audit and
the hash of nothing; further columns are ignored. Rows that agree in conversation, turn, role and text are read by one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import stored

#: Rows of a block, and characters of their text, at most (one row more).
BLOCK, BLOCK_CHARS = 16384, 16 << 20

# States of the grammar: before anything, after system, after user, after assistant.
START, SYSTEM, USER, ASSISTANT = range(4)
#: What a turn of user or assistant leads to from each state.
NEXT = (USER, USER, ASSISTANT, USER)
#: Prices.
DELETE, REROLE, INSERT, BROKEN = 4, 3, 3, 3
_NEVER = 1 << 40
#: Cost-to-go behind the last row: what must be put in to end well.
END = (0, 2 * INSERT, INSERT, 0)

# Classes of rows: the role's first letter (s, u, a or another), 4 more if the text breaks off; what must go; what is gone already.
_MUST_GO, GONE = 8, 9


def row_class(letter: str, fault: str) -> int:
    if fault in ("blank", "duplicate"):
        return _MUST_GO
    return ("sua".index(letter) if letter in ("s", "u", "a") else 3) + 4 * (fault == "truncated")


@lru_cache(None)
def edits(kind: int, state: int) -> tuple[tuple[str, int, int], ...]:
    """(letter, cost, next state) of what can be done with a row."""
    if kind == GONE:
        return (("", 0, state),)
    out = [("D", DELETE, state)]
    if kind != _MUST_GO:
        letter, more = kind % 4, BROKEN * (kind // 4)
        kept = {0: {START: SYSTEM}, 1: {START: USER, SYSTEM: USER, ASSISTANT: USER}, 2: {USER: ASSISTANT}}.get(letter, {})
        if state in kept:
            out.append(("K", more, kept[state]))
        out.append(("R", REROLE + more, NEXT[state]))
    return tuple(out)


@lru_cache(None)
def _into(kind: int) -> tuple[tuple[int, ...], ...]:
    """The cost from each state before a row to each behind it, turns put in before it included."""
    direct = [[min([c for _, c, to in edits(kind, q) if to == p], default=_NEVER) for p in range(4)] for q in range(4)]
    for _ in range(3):
        direct = [[min(direct[q][p], INSERT + direct[NEXT[q]][p]) for p in range(4)] for q in range(4)] if kind != GONE else direct
    return tuple(map(tuple, direct))


@lru_cache(1 << 16)
def _before(kind: int, ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Cost-to-go before a row, from that behind it."""
    return tuple(min(c + a for c, a in zip(row, ahead, strict=True)) for row in _into(kind))


@lru_cache(1 << 16)
def _move(kind: int, ahead: tuple[int, ...], state: int) -> tuple[str, int]:
    """The letters of the cheapest edits up to and with a row, ASCII-least of these, and the state behind it."""
    here, letters = _before(kind, ahead), ""
    while True:
        own = [(e, to, True) for e, c, to in edits(kind, state) if c + ahead[to] == here[state]]
        if kind != GONE and INSERT + here[NEXT[state]] == here[state]:
            own.append(("I", NEXT[state], False))
        letter, state, done = min(own)
        letters += letter
        if done:
            return letters, state


@lru_cache(1 << 16)
def _through(costs: tuple[int, ...], kind: int) -> tuple[int, ...]:
    """The 16 costs of a block with one row more."""
    row = _into(kind)
    return tuple(min(min(costs[4 * q + m] + row[m][p] for m in range(4)), _NEVER) for q in range(4) for p in range(4))


def _level(costs: tuple[int, ...]) -> tuple[tuple[int, ...], int]:
    """Costs over their least, which few tuples stand for, and the least."""
    low = min(costs)
    return tuple(c - low for c in costs), low


def costs_of(kinds: bytes) -> list[int]:
    """What it costs to get through rows from each state to each (4 x 4)."""
    own, base = tuple(0 if q == p else _NEVER for q in range(4) for p in range(4)), 0
    for kind in kinds:
        own, low = _level(_through(own, kind))
        own, base = tuple(_NEVER if c > _NEVER >> 1 else c for c in own), base + low
    return [c + base for c in own]


def to_go(costs: list[int], ahead: tuple[int, ...]) -> tuple[int, ...]:
    """Cost-to-go at the start of a block, from that at its end."""
    return tuple(min(costs[4 * q + p] + ahead[p] for p in range(4)) for q in range(4))


@dataclass
class Block:
    """Consecutive rows of a conversation."""

    kinds: bytearray = field(default_factory=bytearray)
    roles: list[str] = field(default_factory=list)
    texts: list[str] = field(default_factory=list)
    faults: list[int] = field(default_factory=lambda: [0, 0, 0])
    illegal: int = 0
    letters: str = ""
    low: int | None = None
    high: int | None = None
    distinct: int = 0
    chars: int = 0

    def add(self, turn: int | None, role: str, text: str, fault: str, gone: bool) -> None:
        if gone:
            return
        letter = role[:1] or " "
        self.kinds.append(row_class(letter, fault))
        self.roles.append(role)
        self.texts.append(text)
        self.chars += len(text)
        if fault:
            self.faults[("blank", "duplicate", "truncated").index(fault)] += 1
        if self.letters or len(self.kinds) > 1:
            self.illegal += not _legal(self.letters[-1:] + letter)
        self.letters = (self.letters[:1] if len(self.kinds) > 1 else letter) + letter
        if turn is not None:
            self.distinct += turn != self.high
            self.low, self.high = turn if self.low is None else self.low, turn


def _legal(pair: str) -> bool:
    return pair in ("su", "ua", "au")


class Walk:
    """The forward walk over a conversation's blocks: counts, audit and hash so far."""

    def __init__(self) -> None:
        self.state, self.audit, self.hash, self.rows = START, [], hashlib.sha256(), 0
        self.counts, self.illegal, self.last = [0, 0, 0], 0, None
        self.low = self.high = None
        self.distinct = 0
        self.cost: int | None = None

    def _say(self, role: str, text: str) -> None:
        self.hash.update((("\n" if self.rows else "") + f"{role}:{text}").encode("utf-8", "surrogatepass"))
        self.rows += 1

    def _put_in(self, letters: str, state: int) -> int:
        for _ in range(letters.count("I")):
            state = NEXT[state]
            self._say("user" if state == USER else "assistant", "")
        return state

    def block(self, kinds: bytes, roles: list[str], texts: list[str], faults: list[int], illegal: int, letters: str, low, high, distinct: int, ahead: tuple[int, ...]) -> None:
        """``ahead``: the cost-to-go at the block's end."""
        self.counts = [a + b for a, b in zip(self.counts, faults, strict=True)]
        if kinds:
            self.illegal += illegal + (self.last is not None and not _legal(self.last + letters[:1]))
            self.last = letters[1:]
        if low is not None:
            self.distinct += distinct - (low == self.high)
            self.low, self.high = low if self.low is None else self.low, high
        vectors = [ahead]
        for kind in reversed(kinds):
            level, least = _level(vectors[-1])
            vectors.append(tuple(least + c for c in _before(kind, level)))
        if self.cost is None:
            self.cost = vectors[-1][START]
        for k, kind in enumerate(kinds):
            before = self.state
            move, self.state = _move(kind, _level(vectors[len(kinds) - 1 - k])[0], before)
            self.audit.append(move)
            before = self._put_in(move, before)
            if move[-1:] == "K":
                self._say(roles[k], texts[k])
            elif move[-1:] == "R":
                self._say("user" if self.state == USER else "assistant", texts[k])

    def end(self, conv_id) -> tuple:
        tail = {SYSTEM: "II", USER: "I"}.get(self.state, "")
        self._put_in(tail, self.state)
        gaps = 0 if self.low is None else self.high - self.low + 1 - self.distinct
        return (conv_id, gaps, *self.counts, self.illegal, self.cost or 0, "".join(self.audit) + tail, self.hash.hexdigest())


_RESULT = "gaps bigint, blank bigint, duplicate bigint, truncated bigint, illegal bigint, cost bigint, audit string, repaired_sha256 string"
_BLOCK = "part int, idx int, costs array<bigint>, kinds binary, roles array<string>, texts array<string>, faults array<bigint>, bad bigint, letters string, low bigint, high bigint, turns bigint"
_BLOCK_NAMES = ["kinds", "roles", "texts", "faults", "bad", "letters", "low", "high", "turns"]


def _text_after(kind: Column, text: Column) -> Column:
    return F.when(kind == 1, "").when(kind == 2, F.regexp_replace(text, "[.!?]", "")).otherwise(text)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows as a bad export leaves them: by crc32 of conversation and turn, of 20 rows one is dropped, one emptied, one loses
    its sentence marks, one is repeated, one is the user's. A dropped row stays, marked ``gone``, so that no conversation is lost."""
    space = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = (F.crc32(F.concat(space("conv_id"), F.lit(":"), space("turn")).cast("binary")) % 20).cast("int")
    rows = conversations.select("conv_id", F.col("turn").cast("long").alias("turn"), space("role").alias("role"), space("text").alias("text"), kind.alias("kind"))
    rows = rows.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), _text_after(F.col("kind"), F.col("text")).alias("text"), (F.col("kind") == 0).alias("gone"), "kind")
    return rows.withColumn("again", F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("kind", "again")


def rows_of(transcripts: DataFrame) -> DataFrame:
    """Rows in order, over partitions: conv_id, turn, role, text, gone, fault and ``again``, whether what is said was
    said ``before`` or at the ``same`` turn. ``transcripts``: (conv_id, turn, role, text, gone)."""
    said = F.sha2(F.concat(F.length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)
    rows = transcripts.withColumn("said", said)
    groups = rows.where("NOT gone").groupBy("conv_id", "said").agg(F.min(F.struct("turn")).alias("first"), F.count("*").alias("many")).where("many > 1")
    groups = stored(groups.select(F.col("conv_id").alias("c"), F.col("said").alias("s"), "first"), "said")
    rows = rows.join(groups, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("said") == F.col("s")), "left")
    blank = ~F.col("text").rlike(r"[^\x20\x09-\x0D]")
    broken = ~F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z")
    again = F.when(F.col("first").isNull() | F.col("gone"), "").when(F.struct("turn") > F.col("first"), "before").otherwise("same")
    fault = F.when(blank, "blank").when(again == "before", "duplicate").when(broken, "truncated").otherwise("")
    rows = rows.select("conv_id", "turn", "role", "text", "gone", fault.alias("fault"), again.alias("again"), F.xxhash64("role", "text").alias("h"))
    return rows.repartitionByRange("conv_id", "turn", "h").sortWithinPartitions("conv_id", "turn", "h", "role", "text")


def _solved(rows: DataFrame) -> DataFrame:
    """Conversations inside a partition, ``done``; blocks of those that others may share, or that are long."""
    kind = T.StructType([T.StructField("conv_id", rows.schema["conv_id"].dataType), *T.StructType.fromDDL(f"done boolean, {_RESULT}, {_BLOCK}").fields])
    no_result, no_block = (None,) * 8, (None,) * 12

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, names = TaskContext.get().partitionId(), ["conv_id", *[f.name for f in kind.fields[1:]]]
        out: list[tuple] = []
        conv, block, idx, shared, schema, last = None, None, 0, True, None, None

        def flush() -> None:
            nonlocal idx
            out.append((conv, False, *no_result, part, idx, costs_of(bytes(block.kinds)), bytes(block.kinds), block.roles, block.texts, block.faults, block.illegal, block.letters, block.low, block.high, block.distinct))
            idx += 1

        def rows_out() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(0).type if k == 0 else _arrow(kind.fields[k].dataType)) for k, c in enumerate(columns)], names=names)

        for batch in batches:
            schema = schema or batch.schema
            for cid, turn, role, text, gone, fault, again, _ in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if block is None or cid != conv:
                    if block is not None:
                        if shared:
                            flush()
                        else:
                            walk = Walk()
                            walk.block(bytes(block.kinds), block.roles, block.texts, block.faults, block.illegal, block.letters, block.low, block.high, block.distinct, END)
                            done = walk.end(conv)
                            out.append((done[0], True, *done[1:], *no_block))
                    shared = block is None  # the first may have begun before
                    conv, block, last = cid, Block(), None
                elif len(block.kinds) >= BLOCK or block.chars >= BLOCK_CHARS:
                    flush()
                    block, shared = Block(), True
                if again == "same" and last == (turn, role, text) and fault != "blank":
                    fault = "duplicate"
                if again:
                    last = (turn, role, text)
                block.add(turn, role, text, fault, gone)
                if len(out) >= 1024 or (out and len(out[-1][13] or ()) >= BLOCK):
                    yield rows_out()
        if block is not None:
            flush()
        if out:
            yield rows_out()

    return rows.mapInArrow(run, kind)


def _arrow(kind: T.DataType) -> pa.DataType:
    if isinstance(kind, T.ArrayType):
        return pa.list_(_arrow(kind.elementType))
    return {T.LongType: pa.int64(), T.IntegerType: pa.int32(), T.StringType: pa.string(), T.BinaryType: pa.binary(), T.BooleanType: pa.bool_()}[type(kind)]


def _costs_ahead(blocks: DataFrame) -> DataFrame:
    """(part, idx, ahead): the cost-to-go at each block's end. A task gets 16 numbers a block of a conversation."""

    def run(table: pa.Table) -> pa.Table:
        rows = sorted(zip(*(table[c].to_pylist() for c in ("part", "idx", "costs")), strict=True), key=lambda r: r[:2], reverse=True)
        ahead, out = END, []
        for part, idx, costs in rows:
            out.append((part, idx, list(ahead)))
            ahead = to_go(costs, ahead)
        return pa.table({"part": pa.array([r[0] for r in out], pa.int32()), "idx": pa.array([r[1] for r in out], pa.int32()), "ahead": pa.array([r[2] for r in out], pa.list_(pa.int64()))})

    return blocks.select("conv_id", "part", "idx", "costs").groupBy("conv_id").applyInArrow(run, "part int, idx int, ahead array<bigint>")


def repair(transcripts: DataFrame) -> DataFrame:
    """Per conversation: gaps, faults by kind, illegal neighbours, the least cost, the audit of its edits and the hash of
    the repaired transcript (``role:text`` lines). ``transcripts``: (conv_id, turn, role, text, gone)."""
    found = stored(_solved(rows_of(transcripts)), "conversations")
    blocks = found.where("NOT done")
    ordered = blocks.join(_costs_ahead(blocks), ["part", "idx"]).select("conv_id", "part", "idx", "ahead", *_BLOCK_NAMES)
    ordered = ordered.repartition("conv_id").sortWithinPartitions("conv_id", "part", "idx")
    kind = T.StructType([T.StructField("conv_id", found.schema["conv_id"].dataType), *T.StructType.fromDDL(_RESULT).fields])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        conv, walk, out, schema = None, None, [], None

        def rows_out() -> pa.RecordBatch:
            columns = list(zip(*out, strict=True))
            out.clear()
            return pa.RecordBatch.from_arrays([pa.array(c, schema.field(0).type if k == 0 else _arrow(kind.fields[k].dataType)) for k, c in enumerate(columns)], names=kind.names)

        for batch in batches:
            schema = schema or batch.schema
            for i in range(batch.num_rows):
                row = [c[i].as_py() for c in batch.columns]
                if walk is None or row[0] != conv:
                    if walk is not None:
                        out.append(walk.end(conv))
                    conv, walk = row[0], Walk()
                walk.block(*row[4:], tuple(row[3]))
            if len(out) >= 1024:
                yield rows_out()
        if walk is not None:
            out.append(walk.end(conv))
        if out:
            yield rows_out()

    return found.where("done").select(*kind.names).unionByName(ordered.mapInArrow(run, kind))
