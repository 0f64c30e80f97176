"""Substring deduplication over a log-structured index of window fingerprints.

A window is ``size`` consecutive words of one document. Of its groups of GRAM
words the one with the smallest hash is its anchor: equal windows have equal
anchors at the same place, and neighbouring windows mostly share theirs, so
anchors are about a quarter as many as windows. The index is a list of runs:
immutable tables of sorted anchor fingerprints, cut by their top bits into the
same ranges. ``ingest`` takes a batch:

1. Segments of the batch send their anchors' fingerprints, sorted and packed,
   to the task of each range, which merges them with the runs of that range.
   Anchors that stand twice in the batch, or in a run, return to their
   documents; the new ones become the batch's own run.
2. Matches are verified: documents with such anchors are joined with their
   text, and the windows about these anchors meet again, with 96 bits of hash
   of all their words and their document's id. A window repeats if a document
   with a smaller id, or a historical one, has it.
3. Words inside repeating windows are removed.
4. ``compact`` merges runs by size, each range on its own.

Which documents to join is told by a bit map of bounded size; the join is
exact, so what the map lets through in error only costs time.

``deduplicate`` takes a whole table in batches of ascending ids, so that each
meets the runs of those before.

Defined results: a null text has no words; one of fewer words than a window
keeps all; windows of equal ids aren't smaller, so a repeated row keeps its
own; a null id is larger than any other; columns not asked for are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import Words, chunks, window_hashes, words_of
from .fingerprints import Layout, SegmentNumber, home, layout_for, map_bits, packed, packed_sorted, split, unpacked, unpacked_sorted
from .scratch import delete, new_path, part, stored, write

SIZE = 13
GRAM = 7
#: Runs that an index holds before the smaller ones are merged.
RUNS = 4
#: Shares of the ids after which ``deduplicate`` cuts a table into batches.
CUTS = (0.5,)
_LAST = np.iinfo(np.int64).max
_CHUNK = 1 << 20
_SENT = "`range` int, seg bigint, keys binary, refs binary, docs binary"
_MERGED = "kind int, `range` int, seg bigint, keys binary, docs binary"
_WINDOWS = "`range` int, seg bigint, keys binary, checks binary, ids binary, refs binary, docs binary"


@dataclass
class Index:
    """Runs, the oldest first: (path, fingerprints). All have the same layout."""

    layout: Layout
    size: int = SIZE
    runs: list[tuple[str, int]] = field(default_factory=list)

    def read(self, spark: SparkSession) -> DataFrame:
        kind = "`range` int, keys binary"
        if not self.runs:
            return spark.createDataFrame([], kind)
        return spark.read.schema(kind).parquet(*[p for p, _ in self.runs])


def new_index(docs: DataFrame, text: str = "text", size: int = SIZE, growth: int = 1) -> Index:
    """An index for ``growth`` times the text of ``docs``."""
    return Index(layout_for(docs, text, growth), size)


def _base(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    key = F.coalesce(F.col(doc_id).cast("long"), F.lit(int(_LAST)))
    return docs.select(key.alias("k"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("h"), F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))


def anchors(words: Words, size: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes of all groups of words (those across texts are never used), the windows' first words and their anchors'."""
    gram = min(GRAM, size)
    n = len(words.hash) - size + 1
    if n <= 0:
        none = np.zeros(0, np.int64)
        return np.zeros(0, np.uint64), none, none
    grams = window_hashes(words, gram, everywhere=True)
    best, at = grams[:n].copy(), np.zeros(n, np.int64)
    for k in range(1, size - gram + 1):
        own = grams[k : k + n]
        less = own < best
        best[less], at[less] = own[less], k
    windows = np.flatnonzero(words.text[:n] == words.text[size - 1 :])
    return grams, windows, windows + at[windows]


def _rows(columns: list[tuple[str, pa.DataType]], rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], t) for i, (_, t) in enumerate(columns)], names=[n for n, _ in columns])


_BINARY = pa.binary()
_SENT_COLUMNS = [("range", pa.int32()), ("seg", pa.int64()), ("keys", _BINARY), ("refs", _BINARY), ("docs", _BINARY)]
_WINDOW_COLUMNS = [("range", pa.int32()), ("seg", pa.int64()), ("keys", _BINARY), ("checks", _BINARY), ("ids", _BINARY), ("refs", _BINARY), ("docs", _BINARY)]


_NONE = np.zeros(0, np.int64)


def _document_table(docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]], settled: np.ndarray = _NONE, followers: np.ndarray = _NONE, leaders: np.ndarray = _NONE) -> bytes:
    """What goes with a segment's home: its documents (k, h, number of words); places that need no
    answer, as the segment itself has what they repeat; places that share the answer of another, and that."""
    parts = [*(np.concatenate(x) for x in zip(*docs, strict=True)), settled, followers, leaders]
    return b"".join(len(x).to_bytes(8, "little") + x for x in (packed(np.ascontiguousarray(x).view(np.uint64)) for x in parts))


def _documents(b: bytes) -> list[np.ndarray]:
    out, at = [], 0
    for _ in range(6):
        n = int.from_bytes(b[at : at + 8], "little")
        out.append(unpacked(b[at + 8 : at + 8 + n]).view(np.int64))
        at += 8 + n
    return out


def _send(base: DataFrame, index: Index) -> DataFrame:
    """Anchors of the batch's segments, by range; a segment's table of documents goes with its home."""
    layout = index.layout

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = SegmentNumber()
        keys: list[np.ndarray] = []
        refs: list[np.ndarray] = []
        docs: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        held = 0

        def segment() -> pa.RecordBatch:
            k, r = np.concatenate(keys), np.concatenate(refs)
            order = np.argsort(k)
            k, r, seg = k[order], r[order], number()
            # an anchor that the segment has several times is sent once, without a place
            first = np.ones(len(k), bool)
            first[1:] = k[1:] != k[:-1]
            several = np.diff(np.append(np.flatnonzero(first), len(k))) > 1
            table = _document_table(docs, np.sort(r[np.repeat(several, np.diff(np.append(np.flatnonzero(first), len(k))))]))
            k, r = k[first], np.where(several, 0, r[first] + 1)
            at_home = home(seg, layout.ranges)
            rows = [(at, seg, packed_sorted(k[part] >> layout.shift), packed(r[part]), table if at == at_home else None) for at, part in split(k, layout.ranges)]
            if all(x[0] != at_home for x in rows):
                rows.append((at_home, seg, packed(np.zeros(0)), packed(np.zeros(0)), table))
            return _rows(_SENT_COLUMNS, rows)

        for batch in chunks(batches, most=_CHUNK):
            words = words_of(batch.column("text"))
            if docs and held + len(words.hash) > layout.segment_words:
                yield segment()
                keys, refs, docs, held = [], [], [], 0
            grams, _, own = anchors(words, index.size)
            own = np.unique(own)
            keys.append(grams[own])
            refs.append(own + held)
            docs.append((batch.column("k").to_numpy(), batch.column("h").to_numpy(), words.count.astype(np.int64)))
            held += len(words.hash)
        if docs:
            yield segment()

    return base.select("k", "h", "text").mapInArrow(send, _SENT)


def _merge(new: pa.Table, old: pa.Table) -> pa.Table:
    """A range: each segment's anchors that stand elsewhere too (kind 0), the run of the new ones (1), those that a run has (2)."""
    out: list[tuple] = []
    if new.num_rows:
        keys = [unpacked_sorted(x.as_py()) for x in new["keys"]]
        distinct, back, n = np.unique(np.concatenate(keys), return_inverse=True, return_counts=True)
        seen = np.zeros(len(distinct), bool)
        for x in old["keys"]:
            run = unpacked_sorted(x.as_py())
            if len(run):
                seen |= run[np.minimum(np.searchsorted(run, distinct), len(run) - 1)] == distinct
        twice = ((n > 1) | seen)[back]
        at_range = new["range"][0].as_py()
        ends = np.cumsum([len(k) for k in keys])
        for i, part in enumerate(np.split(twice, ends[:-1])):
            refs = unpacked(new["refs"][i].as_py())[part]
            refs = np.sort(refs[refs > 0]) - np.uint64(1)
            out.append((0, at_range, new["seg"][i].as_py(), packed_sorted(refs), new["docs"][i].as_py()))
        out.append((1, at_range, int((~seen).sum()), packed_sorted(distinct[~seen]), None))
        if seen.any():
            out.append((2, at_range, int(seen.sum()), packed_sorted(distinct[seen]), None))
    kinds = [("kind", pa.int32()), ("range", pa.int32()), ("seg", pa.int64()), ("keys", _BINARY), ("docs", _BINARY)]
    return pa.Table.from_batches([_rows(kinds, out)])


def _of_documents(table: pa.Table) -> pa.Table:
    """A segment's words, by document: k, h and the sorted places within the document."""
    k, h, n, settled, followers, leaders = _documents(next(x for x in table["docs"].to_pylist() if x is not None))
    starts = np.cumsum(n) - n
    answered = np.concatenate([unpacked_sorted(x.as_py()) for x in table["keys"]]).astype(np.int64)
    at = np.sort(np.concatenate([answered, settled, followers[np.isin(leaders, answered)]]))
    doc = np.searchsorted(np.cumsum(n), at, side="right")
    some, first = np.unique(doc, return_index=True)
    parts = np.split(at, first[1:]) if len(some) else []
    return pa.table({"k": pa.array(k[some]), "h": pa.array(h[some]), "places": pa.array([packed_sorted((p - starts[d]).astype(np.uint64)) for d, p in zip(some, parts, strict=True)], _BINARY)})


def _by_document(rows: DataFrame, path: str) -> DataFrame:
    """(k, h, places), one row for rows that repeat."""
    return write(rows.groupBy("seg").applyInArrow(_of_documents, "k bigint, h bigint, places binary").dropDuplicates(["k", "h"]), path)


def _gathered_map(words: DataFrame, size: int) -> np.ndarray:
    """The bit map from rows (w, v) of its 64-bit words."""
    rows = words.groupBy("w").agg(F.bit_or("v").alias("v")).toArrow()
    out = np.zeros(size // 64, np.int64)
    out[rows["w"].to_numpy()] = rows["v"].to_numpy()
    return out.view(np.uint64)


def _bit(size: int) -> Column:
    return F.pmod(F.xxhash64("k"), F.lit(size))


def _map_of_ids(rows: DataFrame, size: int) -> np.ndarray:
    return _gathered_map(rows.select(F.floor(_bit(size) / 64).cast("int").alias("w"), F.pmod(_bit(size), F.lit(64)).cast("int").alias("b")).select("w", F.expr("shiftleft(1L, b)").alias("v")), size)


def _map_of_keys(rows: DataFrame, size: int) -> np.ndarray:
    """The map of packed fingerprints."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for x in batch.column("keys").to_pylist():
                bit = _key_bit(unpacked_sorted(x), size)
                yield pa.RecordBatch.from_arrays([pa.array((bit >> np.uint64(6)).astype(np.int32)), pa.array((np.uint64(1) << (bit & np.uint64(63))).view(np.int64))], names=["w", "v"])

    return _gathered_map(rows.select("keys").mapInArrow(spread, "w int, v bigint"), size)


def _key_bit(key: np.ndarray, size: int) -> np.ndarray:
    return key & np.uint64(size - 1)


def _in_map(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    return ((bits[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63))) & np.uint64(1)).astype(bool)


def _text_batches(batches: Iterator[pa.RecordBatch], columns: list[str]) -> Iterator[pa.RecordBatch]:
    """Batches of packed texts, unpacked a bounded number of bytes at a time."""
    for batch in batches:
        sizes = batch.column("bytes").to_pylist()
        at = 0
        while at < batch.num_rows:
            stop, held = at, 0
            while stop < batch.num_rows and (stop == at or held + sizes[stop] <= _CHUNK):
                held += sizes[stop]
                stop += 1
            part = batch.slice(at, stop - at)
            texts = pa.array([pa.decompress(z, n, codec="zstd", asbytes=True) if n else b"" for z, n in zip(part.column("z").to_pylist(), sizes[at:stop], strict=True)], _BINARY)
            yield pa.RecordBatch.from_arrays([*(part.column(c) for c in columns), texts.cast(pa.string())], names=[*columns, "text"])
            at = stop


class _WindowSender:
    """Windows by range, with all that the verification needs, a segment at a time."""

    def __init__(self, layout: Layout, number: SegmentNumber) -> None:
        self.layout, self.number = layout, number
        self.clear()

    def clear(self) -> None:
        self.parts: list[tuple] = []
        self.docs: list[tuple] = []
        self.held = self.many = 0

    def add(self, words: Words, at: np.ndarray, k: np.ndarray, h: np.ndarray, size: int) -> None:
        hashes = window_hashes(words, size, everywhere=True)[at]
        checks = window_hashes(words, size, everywhere=True, factor=0xD6E8FEB86659FD93, check=True)[at] >> np.uint64(32)
        self.parts.append((hashes, checks, k[words.text[at]].view(np.uint64), (at + self.held).astype(np.uint64)))
        self.docs.append((k, h, words.count.astype(np.int64)))
        self.held += len(words.hash)
        self.many += len(at)

    def rows(self) -> pa.RecordBatch:
        """A window that the segment has several times is sent once, with the least id of its documents.
        Documents with a larger id repeat it, whatever the answer; further places in that of the least id share its answer."""
        keys, checks, ids, refs = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        order = np.lexsort((refs, ids.view(np.int64), checks, keys))
        keys, checks, ids, refs, seg = keys[order], checks[order], ids[order], refs[order].astype(np.int64), self.number()
        first = np.ones(len(keys), bool)
        first[1:] = (keys[1:] != keys[:-1]) | (checks[1:] != checks[:-1])
        lead = np.maximum.accumulate(np.where(first, np.arange(len(keys)), 0))
        same = ~first & (ids == ids[lead])
        table = _document_table(self.docs, np.sort(refs[~first & ~same]), refs[same], refs[lead[same]])
        keys, rest = keys[first], [checks[first], ids[first], refs[first].view(np.uint64)]
        at_home = home(seg, self.layout.ranges)
        out = [(r, seg, packed_sorted(keys[at]), *(packed(x[at]) for x in rest), table if r == at_home else None) for r, at in split(keys, self.layout.ranges)]
        if all(x[0] != at_home for x in out):
            out.append((at_home, seg, *[packed(np.zeros(0))] * 4, table))
        self.clear()
        return _rows(_WINDOW_COLUMNS, out)


def _verify(table: pa.Table) -> pa.Table:
    """A range: each segment's windows that a document with a smaller id has too."""
    keys, checks, ids = (np.concatenate([f(x.as_py()) for x in table[c]]) for c, f in (("keys", unpacked_sorted), ("checks", unpacked), ("ids", unpacked)))
    ids = ids.view(np.int64)
    order = np.lexsort((checks, keys))
    k, c, own = keys[order], checks[order], ids[order]
    first = np.flatnonzero(np.concatenate([[True], (k[1:] != k[:-1]) | (c[1:] != c[:-1])])) if len(k) else np.zeros(0, np.int64)
    repeats = np.zeros(len(k), bool)
    if len(k):
        repeats[order] = own > np.repeat(np.minimum.reduceat(own, first), np.diff(np.append(first, len(k))))
    out, at = [], 0
    for i in range(table.num_rows):
        refs = unpacked(table["refs"][i].as_py())
        part = repeats[at : at + len(refs)]
        at += len(refs)
        if table["seg"][i].as_py() >= 0:
            out.append((table["seg"][i].as_py(), packed_sorted(np.sort(refs[part])), table["docs"][i].as_py()))
    return pa.Table.from_batches([_rows([("seg", pa.int64()), ("keys", _BINARY), ("docs", _BINARY)], out)])


def _candidate_windows(affected: DataFrame, index: Index) -> DataFrame:
    size, layout = index.size, index.layout

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _WindowSender(layout, SegmentNumber())
        for batch in _text_batches(batches, ["k", "h", "places"]):
            words = words_of(batch.column("text"), checked=True)
            _, windows, own = anchors(words, size)
            starts = np.cumsum(words.count) - words.count
            marked = np.zeros(len(words.hash) + 1, bool)
            for i, x in enumerate(batch.column("places").to_pylist()):
                if x is not None:
                    marked[starts[i] + unpacked_sorted(x).astype(np.int64)] = True
            sender.add(words, windows[marked[own]], batch.column("k").to_numpy(), batch.column("h").to_numpy(), size)
            if sender.many > layout.segment_words:
                yield sender.rows()
        if sender.docs:
            yield sender.rows()

    return affected.mapInArrow(send, _WINDOWS)


def _historical_windows(history: DataFrame, index: Index, bits: np.ndarray, text: str) -> DataFrame:
    """Windows of historical documents about the anchors in the map; their id is smaller than any, and none returns."""
    size, layout = index.size, index.layout
    sent = history.sparkSession.sparkContext.broadcast(bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sender = _WindowSender(layout, lambda: -1)
        for batch in chunks(batches, most=_CHUNK):
            words = words_of(batch.column("text"), checked=True)
            grams, windows, own = anchors(words, size)
            at = windows[_in_map(sent.value, _key_bit(grams[own] >> layout.shift, 64 * len(sent.value)))]
            least = np.full(len(words.count), np.iinfo(np.int64).min)
            sender.add(words, at, least, least, size)
            if sender.many > layout.segment_words:
                yield sender.rows()
        if sender.docs:
            yield sender.rows()

    return history.select(F.col(text).alias("text")).mapInArrow(send, _WINDOWS)


def ingest(docs: DataFrame, index: Index, history: DataFrame | None = None, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Index]:
    """Per document of the batch: doc_id, n_words, n_removed, kept_sha256 and kept_text; and the index with the batch's run.

    ``history``: the documents that the index has seen, to verify matches with; asked for if it has seen any.
    """
    if index.runs and history is None:
        raise ValueError("an index with runs needs the historical documents to verify its matches")
    spark = docs.sparkSession
    base = _base(docs, doc_id, text)
    size = index.size
    path = new_path(spark, "merged")
    sent, runs = _send(base, index), index.read(spark)
    sent.groupBy("range").cogroup(runs.groupBy("range")).applyInArrow(_merge, _MERGED).write.partitionBy("kind").option("compression", "zstd").parquet(path)
    rest = T.StructType.fromDDL(_MERGED.removeprefix("kind int, "))
    found, added, met = (part(spark, path, f"kind={k}") for k in range(3))
    at = new_path(spark, "places")
    places = _by_document(_read(spark, found, rest), at)
    delete(found)
    run = _read(spark, added, rest)
    grown = Index(index.layout, size, [*index.runs, (added, run.agg(F.sum("seg")).first()[0])] if run.head(1) else index.runs)

    many = map_bits(places.count())
    bits = spark.sparkContext.broadcast(_map_of_ids(places, many))
    base = base.withColumn("bit", _bit(many))

    def with_text(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            part = batch.filter(pa.array(_in_map(bits.value, batch.column("bit").to_numpy().astype(np.uint64))))
            raw = _raw(part.column("text"))
            yield pa.RecordBatch.from_arrays(
                [part.column("k"), part.column("h"), part.column("doc_id"), pa.array([pa.compress(x, codec="zstd", asbytes=True) if x else b"" for x in raw], _BINARY), pa.array([len(x) for x in raw], pa.int64())],
                names=["k", "h", "doc_id", "z", "bytes"],
            )

    out_kind = "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string, kept_text string"

    def untouched(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(b.filter(pa.array(~_in_map(bits.value, b.column("bit").to_numpy().astype(np.uint64)))) for b in batches):
            kept = [b" ".join(x.split()) for x in _raw(batch.column("text"))]
            yield _kept_rows(batch.column("doc_id"), [x.count(b" ") + 1 if x else 0 for x in kept], [0] * len(kept), kept)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in _text_batches(batches, ["doc_id", "repeats"]):
            n_words, n_removed, kept = [], [], []
            for x, r in zip(_raw(batch.column("text")), batch.column("repeats").to_pylist(), strict=True):
                words = x.split()
                removed = np.zeros(len(words) + 1, np.int64)
                if r is not None:
                    at = unpacked_sorted(r).astype(np.int64)
                    np.add.at(removed, at, 1)
                    np.add.at(removed, at + size, -1)
                gone = np.cumsum(removed[:-1]) > 0
                n_words.append(len(words))
                n_removed.append(int(gone.sum()))
                kept.append(b" ".join([w for w, g in zip(words, gone.tolist(), strict=True) if not g]))
            yield _kept_rows(batch.column("doc_id"), n_words, n_removed, kept)

    affected = stored(base.select("k", "h", "doc_id", "text", "bit").mapInArrow(with_text, "k bigint, h bigint, doc_id bigint, z binary, bytes bigint").join(places, ["k", "h"], "left"), "affected")
    delete(at)
    windows = _candidate_windows(affected, index)
    if index.runs:
        matched = _read(spark, met, rest)
        seen = _map_of_keys(matched, map_bits(matched.agg(F.sum("seg")).first()[0] or 0))
        windows = windows.unionByName(_historical_windows(history, index, seen, text))
    repeats = _by_document(windows.groupBy("range").applyInArrow(_verify, "seg bigint, keys binary, docs binary"), new_path(spark, "repeats")).withColumnRenamed("places", "repeats")
    delete(met)
    changed = affected.drop("places").join(repeats, ["k", "h"], "left").mapInArrow(cut, out_kind)
    return base.select("doc_id", "text", "bit").mapInArrow(untouched, out_kind).unionByName(changed), grown


def _raw(column: pa.Array) -> list[bytes]:
    kind = pa.large_binary() if pa.types.is_large_string(column.type) else pa.binary()
    return [x or b"" for x in column.cast(kind).to_pylist()]


def _kept_rows(ids: pa.Array, n_words: list[int], n_removed: list[int], kept: list[bytes]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [ids, pa.array(n_words, pa.int64()), pa.array(n_removed, pa.int64()), pa.array([hashlib.sha256(x).hexdigest() for x in kept], pa.string()), pa.array(kept, pa.binary()).cast(pa.string())],
        names=["doc_id", "n_words", "n_removed", "kept_sha256", "kept_text"],
    )


def _read(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A part of a written table; one that has no rows wasn't written."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    if not at.getFileSystem(spark._jsc.hadoopConfiguration()).exists(at):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).parquet(path)


def _merge_runs(table: pa.Table) -> pa.Table:
    keys = np.unique(np.concatenate([unpacked_sorted(x.as_py()) for x in table["keys"]]))
    return pa.table({"range": table["range"].slice(0, 1), "seg": pa.array([len(keys)], pa.int64()), "keys": pa.array([packed_sorted(keys)], pa.binary())})


def compact(spark: SparkSession, index: Index, most: int = RUNS) -> Index:
    """The index with at most ``most`` runs: the smallest are merged, range by range, into a new one."""
    if len(index.runs) <= most:
        return index
    by_size = sorted(index.runs, key=lambda r: r[1])
    small, large = by_size[: len(by_size) - most + 1], by_size[len(by_size) - most + 1 :]
    rows = spark.read.schema("`range` int, keys binary").parquet(*[p for p, _ in small])
    path = new_path(spark, "run")
    rows.groupBy("range").applyInArrow(_merge_runs, "`range` int, seg bigint, keys binary").write.option("compression", "zstd").parquet(path)
    return Index(index.layout, index.size, [*large, (path, spark.read.parquet(path).agg(F.sum("seg")).first()[0] or 0)])


def deduplicate(docs: DataFrame, size: int = SIZE, doc_id: str = "doc_id", cuts: Sequence[float] = CUTS, runs: int = RUNS) -> DataFrame:
    """The rows of ``ingest`` of all documents, by batches of ascending ids, those without an id last; between
    batches the index is compacted to ``runs`` runs."""
    spark, key = docs.sparkSession, F.col(doc_id).cast("long")
    share, largest = docs.agg(F.percentile_approx(key, list(cuts or [0.5]), 1000), F.max(key)).first()
    ends = sorted(set(share or [])) if cuts else []
    inner = [key < b for b in ends]
    if largest == _LAST:  # the number that stands for no id is taken: rows without one are a batch of their own
        batches, earlier = [*inner, key.isNotNull(), key.isNull()], [*inner, key.isNotNull()]
    else:
        batches, earlier = [*inner, F.lit(True)], inner
    index, out = new_index(docs, size=size), []
    for k, upto in enumerate(batches):
        batch = docs.where(upto & ((key >= ends[k - 1]) | key.isNull()) if 0 < k <= len(ends) else upto)
        kept, index = ingest(batch, index, docs.where(earlier[k - 1]) if index.runs else None, doc_id)
        out.append(kept)
        if k < len(batches) - 1:
            before, index = index, compact(spark, index, runs)
            for path, _ in set(before.runs) - set(index.runs):
                delete(path)
    return reduce(DataFrame.unionByName, out)
