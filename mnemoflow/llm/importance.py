"""Importance resampling toward a target distribution by hashed n-grams.

1. A task takes its texts a few megabytes at a time. Words become numbers and a suffix array sorts all places by the
   words that follow, as far as the longest n-gram. Places with the same n words in front are neighbours in it: the
   lengths of the common prefixes (LCP) cut it into runs, one for each different n-gram of each length.
2. An n-gram's bucket is taken once a run, from its bytes, and scattered back to the places of the run.
3. First pass: buckets are counted, in the documents and in the target; a task sends BUCKETS numbers. The logarithm of
   the two smoothed shares is a bucket's gain: one number a bucket, which is what the driver and the broadcast hold.
4. Second pass: a document's weight is the mean gain of its n-grams. A Gumbel number drawn from its id is added, and
   the highest sums are the sample, without replacement. Scores are whole numbers: their counts, no more rows than
   there are different scores, tell where the cut lies, and only what is above it is sorted, by ranges.

Defined results: a null text has no words and a weight of 0; a null id is drawn as an empty one and is larger than any
other; rows of equal score and id are ordered by their number of n-grams, then as they come; further columns are
ignored; empty tables count nothing.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .batches import WORD_TABLE, Words, byte_view, chunks, words_of
from .scratch import stored

BUCKETS = 10000
#: Words of the longest n-gram.
LONGEST = 1
#: Documents of fewer words aren't drawn.
LEAST_WORDS = 20
#: Percent of the others that are.
SHARE = 10
SEED = 2024

_FOLD = np.frombuffer(WORD_TABLE, np.uint8)
_BLANK = _FOLD == 32


def word_numbers(words: Words, data: bytes) -> np.ndarray:
    """A number for each different word; words whose hashes agree are told apart by a second one, and by their bytes if that differs."""
    _, first, numbers = np.unique(words.hash, return_index=True, return_inverse=True)
    if (words.check != words.check[first[numbers]]).any():
        known: dict[bytes, int] = {}
        numbers = np.array([known.setdefault(data[a:b], len(known)) for a, b in zip(words.start.tolist(), words.end.tolist(), strict=True)], np.int64)
    return numbers


def suffix_array(numbers: np.ndarray, text: np.ndarray, longest: int) -> np.ndarray:
    """Places ordered by the ``longest`` words from there on; a text's end comes before any word."""
    rank, depth = numbers, 1
    while depth < longest:
        ahead = np.zeros(len(rank), np.int64)
        ahead[:-depth] = np.where(text[:-depth] == text[depth:], rank[depth:] + 1, 0)
        _, rank = np.unique(rank * (int(rank.max()) + 2) + ahead, return_inverse=True)
        depth *= 2
    return np.argsort(rank, kind="stable")


def common_prefixes(order: np.ndarray, numbers: np.ndarray, left: np.ndarray, longest: int) -> np.ndarray:
    """How many words each place of the suffix array shares with the one before it, ``longest`` at most; ``left``: words up to the text's end."""
    same, out = np.ones(len(order) - 1, bool), np.zeros(len(order), np.int64)
    for k in range(longest):
        a, b = order[:-1], order[1:]
        same &= (left[a] > k) & (left[b] > k)
        at = np.flatnonzero(same)
        same[at] = numbers[a[at] + k] == numbers[b[at] + k]
        out[1:] += same
    return out


def buckets_of(column: pa.Array, longest: int, buckets: int) -> tuple[Words, list[tuple[np.ndarray, np.ndarray]]]:
    """The words of some texts, and for each length the places where n-grams start and their buckets."""
    words = words_of(column, _FOLD, checked=True, blank=_BLANK)
    if not len(words.hash):
        return words, []
    data = byte_view(column)[0].tobytes().translate(WORD_TABLE)
    numbers = word_numbers(words, data)
    left = np.cumsum(words.count)[words.text] - np.arange(len(numbers))
    order = suffix_array(numbers, words.text, longest)
    shared = common_prefixes(order, numbers, left, longest)
    start, end, out = words.start.tolist(), words.end.tolist(), []
    for n in range(1, longest + 1):
        whole = left[order] >= n
        places, head = order[whole], (shared < n)[whole]
        if not len(places):
            break
        runs = np.flatnonzero(head)
        once = [zlib.crc32(b" ".join([data[start[i + k] : end[i + k]] for k in range(n)])) % buckets for i in places[runs].tolist()]
        out.append((places, np.repeat(np.array(once, np.int64), np.diff(np.append(runs, len(places))))))
    return words, out


def bucket_counts(docs: DataFrame, text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS) -> np.ndarray:
    """How often the n-grams of all texts fall into each bucket."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in chunks(batches, "text"):
            for _, own in buckets_of(batch.column("text"), longest, buckets)[1]:
                total += np.bincount(own, minlength=buckets)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    rows = docs.select(F.col(text).cast("string").alias("text")).mapInArrow(run, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n")).toArrow()
    out = np.zeros(buckets, np.int64)
    out[rows["bucket"].to_numpy()] = rows["n"].to_numpy()
    return out


def gains(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Of each bucket, 1,000 times the logarithm of its smoothed share in the target over that in the source, rounded down."""
    n = len(source)
    ratio = (target + 1.0) * (float(source.sum()) + n) / ((source + 1.0) * (float(target.sum()) + n))
    return np.floor(1000 * np.log(ratio)).astype(np.int64)


def weigh(docs: DataFrame, gain: np.ndarray, keep: list[str], text: str = "text", longest: int = LONGEST) -> DataFrame:
    """``keep`` columns with ``n_words``, ``n_features`` and ``weight``, the mean gain of a text's n-grams, rounded down."""
    inner = [f"__{k}" for k in range(len(keep))]
    base = docs.select(*[F.col(f"`{n}`").alias(i) for n, i in zip(keep, inner, strict=True)], F.col(text).cast("string").alias("__text"))
    sent = docs.sparkSession.sparkContext.broadcast(gain)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, "__text"):
            words, levels = buckets_of(batch.column("__text"), longest, len(sent.value))
            count, total = np.zeros(batch.num_rows, np.int64), np.zeros(batch.num_rows, np.int64)
            for places, own in levels:
                of = words.text[places]
                count += np.bincount(of, minlength=batch.num_rows)
                by_place = np.zeros(len(words.text) + 1, np.int64)
                by_place[places + 1] = sent.value[own]
                ends = np.cumsum(words.count)
                summed = np.cumsum(by_place)
                total += summed[ends] - summed[ends - words.count]
            weight = np.where(count > 0, total // np.maximum(count, 1), 0)
            yield pa.RecordBatch.from_arrays([*(batch.column(i) for i in inner), pa.array(words.count.astype(np.int64)), pa.array(count), pa.array(weight)], names=[*inner, "n_words", "n_features", "weight"])

    made = T.StructType.fromDDL("n_words bigint, n_features bigint, weight bigint")
    return base.mapInArrow(run, T.StructType([*base.schema.fields[:-1], *made.fields])).toDF(*keep, "n_words", "n_features", "weight")


def gumbel(doc_id: Column, seed: int = SEED) -> Column:
    """1,000 times a Gumbel number that the id fixes, rounded down."""
    named = F.concat(F.lit(f"{seed}:"), F.coalesce(doc_id.cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(named, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / 4294967296.0)))


def resample(docs: DataFrame, target: DataFrame, doc_id: str = "doc_id", text: str = "text", longest: int = LONGEST, buckets: int = BUCKETS, share: int = SHARE, least_words: int = LEAST_WORDS, seed: int = SEED) -> DataFrame:
    """Every document's doc_id, n_features, weight, score and, if it's drawn, its rank from 1 on.

    Of the N documents of ``least_words`` words or more the ``share`` * N // 100 of the highest scores are drawn.
    """
    gain = gains(bucket_counts(docs, text, longest, buckets), bucket_counts(target, text, longest, buckets))
    plain = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text"))
    scored = weigh(plain, gain, ["doc_id"], "text", longest).withColumn("score", F.col("weight") + gumbel(F.col("doc_id"), seed))
    scored = stored(scored, "scored")
    able = F.col("n_words") >= least_words
    per_score = scored.where(able).groupBy("score").agg(F.count("*").alias("n")).orderBy(F.desc("score")).toArrow()
    values, counts = per_score["score"].to_numpy(), per_score["n"].to_numpy()
    wanted = int(counts.sum()) * share // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    none = F.lit(None).cast("long").alias("rank")
    if not wanted:
        return scored.select(*columns, none)
    cut = int(values[np.searchsorted(np.cumsum(counts), wanted)])
    high = able & (F.col("score") >= cut)
    ranked = _numbered(scored.where(high).select(*columns, (-F.col("score")).alias("__down"), F.monotonically_increasing_id().alias("__tie")))
    drawn = ranked.select(*columns, F.when(F.col("rank") <= wanted, F.col("rank")).alias("rank"))
    return scored.where(~high).select(*columns, none).unionByName(drawn)


def _numbered(rows: DataFrame) -> DataFrame:
    """Rows with ``rank``, from 1 on, by score downward, id and number of n-grams: each range is sorted and counted, then moved up by those before it."""
    ordered = ["__down", F.col("doc_id").asc_nulls_last(), "n_features", "__tie"]
    sorted_rows = rows.repartitionByRange(*ordered).sortWithinPartitions(*ordered).drop("__down", "__tie")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, before = TaskContext.get().partitionId(), 0
        for batch in batches:
            n = batch.num_rows
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(np.full(n, part, np.int32)), pa.array(np.arange(before + 1, before + n + 1))], names=[*batch.schema.names, "__part", "__place"])
            before += n

    kind = T.StructType([*sorted_rows.schema.fields, *T.StructType.fromDDL("__part int, __place bigint").fields])
    placed = stored(sorted_rows.mapInArrow(run, kind), "placed")
    sizes = placed.groupBy("__part").agg(F.max("__place").alias("n")).orderBy("__part").toArrow()
    ends = np.cumsum(sizes["n"].to_numpy()) - sizes["n"].to_numpy()
    # one row a partition of the sort
    moved = rows.sparkSession.createDataFrame(pa.table({"__part": sizes["__part"], "__before": pa.array(ends)}))
    return placed.join(F.broadcast(moved), "__part").withColumn("rank", F.col("__place") + F.col("__before"))
