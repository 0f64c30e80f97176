"""Exact deduplication against immutable snapshots screened by binary fuse filters.

Texts are equal if they are once each run of blanks is one space; the SHA-256 of that form is their digest. An index
is a list of snapshots, one a batch, written once and never changed. A snapshot has

* its exact buckets: of each digest of the batch the text, the row that stays and how many rows have it, dealt by
  the digest's first bits into a number of buckets that all snapshots of the index share;
* a static binary fuse filter a bucket (about 9 bits a digest, one false positive in 256) over the digests that the
  batch added.

``ingest`` takes a batch:

1. The batch's own copies are grouped by digest, combined before the shuffle, so a group of any size is one row.
2. Each bucket's digests meet the filters of that bucket. What no filter holds is new, without reading any text.
3. What a filter passes joins the exact buckets by digest, and the two texts are compared byte for byte. Only a text
   that is the same becomes a copy of the historical row; a digest that other bytes share stays a group of its own.
4. The snapshot is written: buckets first, its filters last.

``deduplicate`` takes a whole table in batches of ascending ids, so that the row which stays is in the earliest.
Groups that hold over a HOT-th of all rows, at most HOT, come to the rows by broadcast, all others by a join.

Defined results: a null text is empty; a null id is larger than any other; of rows with equal text and id one stays,
the others are copies of it; further columns are ignored; an empty table gives none.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field, replace
from functools import reduce
from math import log

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import mixed
from .scratch import new_path, stored, write

#: Rows of a bucket of a snapshot, at about; a filter over so many digests takes about 1.1 MB.
BUCKET = 1 << 20
#: Shares of the ids after which ``deduplicate`` cuts a table into batches.
CUTS = (0.5,)
#: A group is hot if it holds more than a HOT-th of all rows: there are HOT such groups at most.
HOT = 2000


class FuseFilter:
    """A three-wise binary fuse filter with fingerprints of 8 bits over distinct 64-bit keys.

    Each key has a slot in three neighbouring segments; slots that one key alone has are peeled, all at once,
    until no key is left, and filled in reverse, so that a key's three slots add up to its fingerprint.
    """

    def __init__(self, keys: np.ndarray) -> None:
        n = len(keys)
        self.segment = 1 << (int(log(n) / log(3.33) + 2.25) if n > 1 else 2)
        self.segment = min(self.segment, 1 << 18)
        room = int(n * (max(1.125, 0.875 + 0.25 * log(1e6) / log(n)) if n > 1 else 1))
        self.count = max(1, -(-room // self.segment) - 2)
        size = (self.count + 2) * self.segment
        for seed in range(100):  # a few keys in a hundred thousand attempts can't be peeled
            self.seed = seed
            hashed = self._hashed(keys)
            slots = self._slots(hashed)
            order = self._peeled(slots, size)
            if order is not None:
                break
        else:
            raise ValueError("keys of a filter must be distinct")
        self.marks = np.zeros(size, np.uint8)
        print_of = self._print(hashed)
        for who, slot in reversed(order):
            own = slots[:, who]
            self.marks[slot] = 0  # what the other two leave to the key's own slot
            self.marks[slot] = print_of[who] ^ self.marks[own[0]] ^ self.marks[own[1]] ^ self.marks[own[2]]

    def _hashed(self, keys: np.ndarray) -> np.ndarray:
        return mixed(keys + np.uint64(0x9E3779B97F4A7C15 * (self.seed + 1) & (1 << 64) - 1))

    def _slots(self, hashed: np.ndarray) -> np.ndarray:
        first = ((hashed >> np.uint64(32)) * np.uint64(self.count) >> np.uint64(32)).astype(np.int64)
        inner = mixed(hashed ^ np.uint64(0xD6E8FEB86659FD93))
        mask = np.uint64(self.segment - 1)
        places = [((inner >> np.uint64(20 * k)) & mask).astype(np.int64) for k in range(3)]
        return np.stack([(first + k) * self.segment + p for k, p in enumerate(places)])

    @staticmethod
    def _print(hashed: np.ndarray) -> np.ndarray:
        return (hashed & np.uint64(0xFF)).astype(np.uint8)

    @staticmethod
    def _peeled(slots: np.ndarray, size: int) -> list[tuple[np.ndarray, np.ndarray]] | None:
        """Rounds of (keys, the slot that each has alone)."""
        n = slots.shape[1]
        many = np.bincount(slots.ravel(), minlength=size)
        who = np.zeros(size, np.int64)  # the sum of the keys at a slot: of one key, the key
        for row in slots:
            np.add.at(who, row, np.arange(n))
        at, order, left = np.flatnonzero(many == 1), [], n
        while len(at):
            keys, first = np.unique(who[at], return_index=True)
            order.append((keys, at[first]))
            left -= len(keys)
            touched = slots[:, keys].ravel()
            np.subtract.at(many, touched, 1)
            np.subtract.at(who, touched, np.tile(keys, 3))
            touched = np.unique(touched)
            at = touched[many[touched] == 1]
        return order if left == 0 else None

    def holds(self, keys: np.ndarray) -> np.ndarray:
        """True for every key of the filter, and for one in 256 others."""
        hashed = self._hashed(keys)
        own = self.marks[self._slots(hashed)]
        return self._print(hashed) == own[0] ^ own[1] ^ own[2]

    def packed(self) -> bytes:
        return np.array([self.seed, self.segment, self.count], np.int64).tobytes() + self.marks.tobytes()

    @classmethod
    def unpacked(cls, raw: bytes) -> FuseFilter:
        out = cls.__new__(cls)
        out.seed, out.segment, out.count = (int(x) for x in np.frombuffer(raw[:24], np.int64))
        out.marks = np.frombuffer(raw[24:], np.uint8)
        return out


@dataclass(frozen=True)
class Snapshot:
    """Where a batch's exact buckets and its filters are."""

    number: int
    buckets: str
    filters: str


@dataclass(frozen=True)
class Index:
    """Snapshots, the oldest first."""

    buckets: int
    snapshots: tuple[Snapshot, ...] = field(default=())


_EXACT = "bucket int, digest binary, key long, body string, doc_id {kind}, place long, many long"
_FILTER = "bucket int, number int, filter binary"


def new_index(rows: int) -> Index:
    """An index for about so many rows a batch."""
    return Index(max(1, -(-rows // BUCKET)))


def normalised(text: Column) -> Column:
    """The text with each run of blanks as one space; of null, nothing."""
    return F.coalesce(F.regexp_replace(text, r"[\x20\x09-\x0D]+", " "), F.lit(""))


def digest(body: Column) -> Column:
    return F.unhex(F.sha2(body, 256))


def _read(spark: SparkSession, kind: str, paths: list[tuple[int, str]]) -> DataFrame:
    parts = [spark.read.schema(kind).parquet(p).withColumn("number", F.lit(n)) for n, p in paths]
    return reduce(DataFrame.unionByName, parts)


def _screened(keys: DataFrame, filters: DataFrame) -> DataFrame:
    """(digest, number): the snapshots whose filters may hold each digest of (bucket, digest, key)."""

    def run(new: pa.Table, old: pa.Table) -> pa.Table:
        digests, numbers = [pa.array([], pa.binary())], [pa.array([], pa.int32())]
        if new.num_rows:
            own, names = new["key"].to_numpy().view(np.uint64), new["digest"].combine_chunks()
            for number, raw in zip(old["number"].to_pylist(), old["filter"], strict=True):
                at = np.flatnonzero(FuseFilter.unpacked(raw.as_py()).holds(own))
                digests.append(names.take(pa.array(at)))
                numbers.append(pa.array(np.full(len(at), number, np.int32)))
        return pa.table({"digest": pa.concat_arrays(digests), "number": pa.concat_arrays(numbers)})

    return keys.groupBy("bucket").cogroup(filters.groupBy("bucket")).applyInArrow(run, "digest binary, number int")


def _filters(added: DataFrame, number: int) -> DataFrame:
    def run(table: pa.Table) -> pa.Table:
        raw = FuseFilter(np.unique(table["key"].to_numpy()).view(np.uint64)).packed()
        return pa.table({"bucket": table["bucket"].combine_chunks().slice(0, 1), "number": pa.array([number], pa.int32()), "filter": pa.array([raw], pa.binary())})

    return added.select("bucket", "key").groupBy("bucket").applyInArrow(run, _FILTER)


def ingest(docs: DataFrame, index: Index, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame, Index]:
    """The batch's rows (doc_id, digest, place, number), its groups (digest, origin, doc_id, place, many, number) and the index with its snapshot.

    ``number`` is the batch's snapshot, ``origin`` the one that has the group's text first; a group's doc_id and place
    are those of the row that stays, in the origin's batch. ``place`` tells rows of equal id and text apart.
    """
    spark, number = docs.sparkSession, len(index.snapshots)
    body = normalised(F.col(text))
    read = docs.select(F.col(doc_id).alias("doc_id"), body.alias("body"), digest(body).alias("digest"))
    rows = stored(read.select("doc_id", "digest", F.monotonically_increasing_id().alias("place")), "rows").withColumn("number", F.lit(number))
    least = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "place")).alias("least")
    groups = rows.groupBy("digest").agg(least, F.count("*").alias("many"))
    # a group's texts are equal: a task sends one of them
    bodies = read.groupBy("digest").agg(F.any_value("body").alias("body"))
    key = F.xxhash64("digest")
    exact = groups.join(bodies, "digest").select(F.pmod(key, F.lit(index.buckets)).cast("int").alias("bucket"), "digest", key.alias("key"), "body", "least.doc_id", "least.place", "many")
    at, kind = new_path(spark, "exact"), _EXACT.format(kind=docs.schema[doc_id].dataType.simpleString())
    exact.write.option("compression", "zstd").parquet(at)
    exact = spark.read.schema(kind).parquet(at)
    own = exact.drop("body").withColumn("number", F.lit(number))
    if index.snapshots:
        passed = _screened(exact.select("bucket", "digest", "key"), _read(spark, "bucket int, filter binary", [(s.number, s.filters) for s in index.snapshots]))
        passed = stored(passed, "passed")
        old = _read(spark, kind, [(s.number, s.buckets) for s in index.snapshots])
        met = passed.join(old, ["digest", "number"]).select("digest", F.struct("number", "doc_id", "place").alias("old"), F.col("body").alias("old_body"))
        same = met.join(exact.select("digest", "body"), "digest").where(F.col("body").cast("binary") == F.col("old_body").cast("binary"))
        known = stored(same.groupBy("digest").agg(F.min("old").alias("old")), "known")
        own = own.join(known, "digest", "left")
        added = own.where("old IS NULL")
        mine = F.col("old").isNull()
        own = own.select("digest", F.coalesce("old.number", "number").alias("origin"), *[F.when(mine, F.col(c)).otherwise(F.col(f"old.{c}")).alias(c) for c in ("doc_id", "place")], "many", "number")
    else:
        added, own = own, own.select("digest", F.col("number").alias("origin"), "doc_id", "place", "many", "number")
    filters = new_path(spark, "filters")
    write(_filters(added, number), filters)
    return rows, own, replace(index, snapshots=(*index.snapshots, Snapshot(number, at, filters)))


def deduplicate(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", cuts: Sequence[float] = CUTS) -> DataFrame:
    """Per document: doc_id, keep_id, group_size, kept and text_sha256. ``cuts``: shares of the ids after which a batch ends;
    ids that aren't numbers come in one batch. How many batches there are changes no row but which of equal ids stays."""
    spark, key = docs.sparkSession, F.col(doc_id)
    numeric = isinstance(docs.schema[doc_id].dataType, T.NumericType)
    total, ends = docs.agg(F.count("*"), F.percentile_approx(key, list(cuts), 1000) if cuts and numeric else F.lit(None)).first()
    ends, index, rows, groups = sorted(set(ends or [])), new_index(total), [], []
    for k in range(len(ends) + 1):
        from_here = F.lit(True) if k == 0 else key >= ends[k - 1]
        batch = docs.where(from_here & (key < ends[k])) if k < len(ends) else docs.where(from_here | key.isNull())
        own_rows, own_groups, index = ingest(batch, index, doc_id, text)
        rows.append(own_rows)
        groups.append(own_groups)
    return _named(reduce(DataFrame.unionByName, rows), reduce(DataFrame.unionByName, groups), total)


def _named(rows: DataFrame, groups: DataFrame, total: int) -> DataFrame:
    """Each row with the row that stays and the size of its group."""
    size = groups.groupBy("digest", "origin").agg(F.sum("many").alias("size")).where("size > 1")
    repeats = groups.withColumnRenamed("doc_id", "keep_id").withColumnRenamed("place", "keep_place").join(size, ["digest", "origin"])
    repeats = stored(repeats, "repeats")
    on = ["digest", "number"]
    hot = F.broadcast(repeats.where(F.col("many") * HOT > total).drop("many"))
    rest = repeats.where(F.col("many") * HOT <= total).drop("many")
    stays = (F.col("number") == F.col("origin")) & (F.col("place") == F.col("keep_place"))
    sha = F.lower(F.hex("digest")).alias("text_sha256")
    shared = lambda df: df.select("doc_id", "keep_id", F.col("size").alias("group_size"), stays.alias("kept"), sha)
    others = rows.join(hot, on, "left_anti").join(rest, on, "left")
    alone = F.col("size").isNull()
    others = others.select("doc_id", F.when(alone, F.col("doc_id")).otherwise(F.col("keep_id")).alias("keep_id"), F.coalesce("size", F.lit(1)).alias("group_size"), F.coalesce(stays, F.lit(True)).alias("kept"), sha)
    return shared(rows.join(hot, on)).unionByName(others)
