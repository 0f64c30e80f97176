"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the training tokens' postings as immutable segments,
one row each. A segment holds whole documents, lays their words on one line
of positions (a free position between documents) and keeps, for each term, the
sorted positions. ``match`` looks up the benchmark's phrases: it orders the
terms of a phrase by their document frequency over all segments, starts from
the rarest term's list and intersects the others', shifted by their offsets.

Nothing is shuffled but the document frequencies of benchmark terms, so no key
is hot. The benchmark is taken in blocks of ``block_bytes`` of text: each is
a broadcast of bounded size, and a task holds one of them at a time.

Defined results: a null or wordless text has no words and no hit; a null or
wordless item has no window; an item that repeats under several ids counts
each id; items without an id share the empty one; rows that repeat or share an
id are judged each; extra columns are ignored.
"""

from __future__ import annotations

import pickle
import zlib
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import arrow, chunks, lower_words, raw_texts
from .scratch import stored

WINDOW = 10
#: Words that a lightly edited passage may have besides a window's, for proximity matches in production.
SLOP = 2
#: Words in a segment; a longer document is a segment of its own.
SEGMENT_WORDS = 1 << 20
#: Benchmark text that is looked up, and broadcast, at a time.
BLOCK_BYTES = 16 << 20

_INDEX = "doc_ids array<bigint>, text_hashes array<bigint>, n_words array<int>, terms binary, docs_with binary, ends binary, positions binary"
_INDEX_ARROW = pa.schema(
    [
        ("doc_ids", pa.list_(pa.int64())),
        ("text_hashes", pa.list_(pa.int64())),
        ("n_words", pa.list_(pa.int32())),
        ("terms", pa.binary()),
        ("docs_with", pa.binary()),
        ("ends", pa.binary()),
        ("positions", pa.binary()),
    ]
)


def _segment(doc_ids: list[tuple], texts: list[list[bytes]]) -> dict[str, list]:
    ids: defaultdict[bytes, int] = defaultdict()
    ids.default_factory = ids.__len__
    counts = np.fromiter(map(len, texts), np.int64, len(texts))
    total = int(counts.sum())
    term = np.fromiter((ids[w] for words in texts for w in words), np.int32, total)
    doc = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    at = np.arange(total, dtype=np.int64) + doc  # a free position between documents
    order = np.argsort(term, kind="stable")
    by_term = np.bincount(term, minlength=len(ids))
    ends = np.cumsum(by_term)
    at, doc = at[order], doc[order]
    starts = ends - by_term
    first = np.ones(total, bool)
    first[1:] = doc[1:] != doc[:-1]
    if total:
        first[starts] = True
    docs_with = np.add.reduceat(first, starts).astype(np.int32) if total else np.zeros(0, np.int32)
    steps = at.copy()
    steps[1:] -= at[:-1]
    if total:
        steps[starts] = at[starts]
    return {
        "doc_ids": [[x[0] for x in doc_ids]],
        "text_hashes": [[x[1] for x in doc_ids]],
        "n_words": [counts.tolist()],
        "terms": [b" ".join(ids)],
        "docs_with": [docs_with.tobytes()],
        "ends": [ends.astype(np.int64).tobytes()],
        "positions": [steps.astype(np.int32).tobytes()],
    }


def build_index(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", segment_words: int = SEGMENT_WORDS) -> DataFrame:
    """One row per segment; store it before looking up more than once."""

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids: list = []
        texts: list[list[bytes]] = []
        held = 0
        for batch in chunks(batches, most=1 << 20):
            for *key, raw in zip(batch.column("doc_id").to_pylist(), batch.column("text_hash").to_pylist(), raw_texts(batch), strict=True):
                words = lower_words(raw)
                if texts and held + len(words) > segment_words:
                    yield arrow(_segment(ids, texts), _INDEX_ARROW)
                    ids, texts, held = [], [], 0
                ids.append(key)
                texts.append(words)
                held += len(words)
        if texts:
            yield arrow(_segment(ids, texts), _INDEX_ARROW)

    return docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), F.col(text).alias("text")).mapInArrow(build, _INDEX)


class Segment:
    """A stored segment; postings are unpacked when asked for."""

    def __init__(self, row: dict) -> None:
        self.doc_ids, self.text_hashes = row["doc_ids"], row["text_hashes"]
        self.n_words = np.asarray(row["n_words"], np.int64)
        terms = row["terms"].split(b" ") if row["terms"] else []
        self.at = {t: i for i, t in enumerate(terms)}
        self.ends = np.frombuffer(row["ends"], np.int64)
        self.steps = np.frombuffer(row["positions"], np.int32)
        #: The first position of each document.
        self.starts = np.concatenate([[0], np.cumsum(self.n_words + 1)])[:-1]
        self.found: dict[bytes, np.ndarray] = {}

    def postings(self, term: bytes) -> np.ndarray:
        if term not in self.found:
            i = self.at[term]
            self.found[term] = np.cumsum(self.steps[self.ends[i - 1] if i else 0 : self.ends[i]], dtype=np.int64)
        return self.found[term]

    def doc(self, positions: np.ndarray) -> np.ndarray:
        """The documents, by their place in the segment, that hold the positions."""
        return np.searchsorted(self.starts, positions, side="right") - 1

    def phrase(self, terms: tuple[bytes, ...], order: list[int]) -> np.ndarray:
        """Positions where the phrase starts; ``order``: its offsets, the rarest term's first."""
        if any(t not in self.at for t in terms):
            return np.zeros(0, np.int64)
        starts = self.postings(terms[order[0]]) - order[0]
        for k in order[1:]:
            own = self.postings(terms[k])
            j = np.searchsorted(own, starts + k)
            starts = starts[own[np.minimum(j, len(own) - 1)] == starts + k]
            if not len(starts):
                break
        return starts

    def near(self, terms: tuple[bytes, ...], order: list[int], span: int) -> np.ndarray:
        """First positions of spans, in one document, that hold every term, as often as the window does, in any order."""
        if any(t not in self.at for t in terms):
            return np.zeros(0, np.int64)
        anchor = self.postings(terms[order[0]])
        for k in order[1:]:  # each other term must be within reach
            own = self.postings(terms[k])
            j = np.searchsorted(own, anchor - span + 1)
            anchor = anchor[(j < len(own)) & (own[np.minimum(j, len(own) - 1)] < anchor + span)]
            if not len(anchor):
                return anchor
        doc = self.doc(anchor)
        start = (anchor[:, None] - np.arange(span)).ravel()
        low, high = np.repeat(self.starts[doc], span), np.repeat(self.starts[doc] + self.n_words[doc], span)
        ok = start >= low
        start, stop = start[ok], np.minimum(start + span, high)[ok]
        for t, times in Counter(terms[k] for k in order).items():  # the rarest first
            own = self.postings(t)
            j = np.searchsorted(own, start) + times - 1
            ok = (j < len(own)) & (own[np.minimum(j, len(own) - 1)] < stop)
            start, stop = start[ok], stop[ok]
            if not len(start):
                break
        return np.unique(start)


def item_windows(words: list[bytes], size: int = WINDOW) -> list[tuple[bytes, ...]]:
    if not words:
        return []
    return [tuple(words[i : i + size]) for i in range(max(1, len(words) - size + 1))]


def frequencies(index: DataFrame, wanted: set[bytes]) -> dict[bytes, int]:
    """Documents with each wanted term, over all segments; no more rows than wanted terms reach the driver."""
    spark = index.sparkSession
    sent = spark.sparkContext.broadcast(wanted)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: defaultdict[bytes, int] = defaultdict(int)
        for batch in batches:
            for terms, docs in zip(batch.column("terms").to_pylist(), batch.column("docs_with").to_pylist(), strict=True):
                for t, n in zip(terms.split(b" "), np.frombuffer(docs, np.int32), strict=False):
                    if t in sent.value:
                        total[t] += int(n)
        yield pa.RecordBatch.from_pydict({"term": pa.array(list(total), pa.binary()), "n": pa.array(list(total.values()), pa.int64())})

    rows = index.select("terms", "docs_with").mapInArrow(count, "term binary, n bigint").groupBy("term").agg(F.sum("n").alias("n")).collect()
    return {bytes(r.term): r.n for r in rows}


def _block_phrases(df: dict[bytes, int], items: list[tuple[str, bytes]], window: int) -> bytes:
    """The block's distinct windows under their rarest term, packed for broadcasting."""
    owners: defaultdict[tuple[bytes, ...], list[str]] = defaultdict(list)
    for item, text in items:
        for w in set(item_windows(lower_words(text), window)):
            owners[w].append(item)
    by_rarest: defaultdict[bytes, list] = defaultdict(list)
    for w, own in owners.items():
        order = sorted(range(len(w)), key=lambda k: (df.get(w[k], 0), w[k], k))
        if df.get(w[order[0]]):  # a term that no document has can't match
            by_rarest[w[order[0]]].append((w, order, own))
    return zlib.compress(pickle.dumps(dict(by_rarest)), 1)


def _blocks(benchmark: DataFrame, item_id: str, text: str, block_bytes: int) -> Iterator[list[tuple[str, bytes]]]:
    """The benchmark in blocks of bounded size; one block is on the driver at a time."""
    rows = benchmark.where(F.col(text).isNotNull()).select(F.col(item_id).cast("string").alias("item"), F.encode(text, "UTF-8").alias("text"))
    block, held = [], 0
    for r in rows.toLocalIterator():
        block.append((r.item or "", bytes(r.text)))
        held += len(r.text)
        if held >= block_bytes:
            yield block
            block, held = [], 0
    if block:
        yield block


def match(
    index: DataFrame,
    benchmark: DataFrame,
    item_id: str = "item_id",
    text: str = "text",
    window: int = WINDOW,
    slop: int | None = None,
    block_bytes: int = BLOCK_BYTES,
) -> DataFrame:
    """Per document: ``n_words``, ``n_hit`` (words inside exact matches), ``items``
    (ids with an exact match) and, with ``slop``, ``n_near`` (spans of window +
    slop words that hold all words of a window, each as often, in any order);
    ``text_hash`` tells rows that share an id apart."""
    spark = index.sparkSession
    wanted = {t for items in _blocks(benchmark, item_id, text, block_bytes) for _, x in items for t in lower_words(x)}
    df = frequencies(index, wanted) if wanted else {}
    sent = [spark.sparkContext.broadcast(_block_phrases(df, x, window)) for x in _blocks(benchmark, item_id, text, block_bytes)]
    schema = pa.schema([("doc_id", pa.int64()), ("text_hash", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_near", pa.int64()), ("items", pa.list_(pa.string()))])

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, phrases = -1, {}
        for row in (x for batch in batches for k in range(batch.num_rows) for x in batch.slice(k, 1).to_pylist()):
            n = len(row["doc_ids"])
            edge = np.zeros(sum(row["n_words"]) + n + 1, np.int64)
            items_of: defaultdict[int, set[str]] = defaultdict(set)
            near = np.zeros(n, np.int64)
            seg = Segment(row)
            for b in range(len(sent)):
                if at != b:  # one block in memory at a time
                    at, phrases = b, pickle.loads(zlib.decompress(sent[b].value))
                for rarest in seg.at.keys() & phrases.keys():
                    for w, order, own in phrases[rarest]:
                        starts = seg.phrase(w, order)
                        if len(starts):
                            np.add.at(edge, starts, 1)
                            np.add.at(edge, starts + len(w), -1)
                            for d in np.unique(seg.doc(starts)):
                                items_of[int(d)].update(own)
                        if slop is not None:
                            np.add.at(near, seg.doc(seg.near(w, order, len(w) + slop)), 1)
            hit = np.concatenate([[0], np.cumsum(np.cumsum(edge[:-1]) > 0)])
            yield arrow(
                {
                    "doc_id": seg.doc_ids,
                    "text_hash": seg.text_hashes,
                    "n_words": seg.n_words.tolist(),
                    "n_hit": (hit[seg.starts + seg.n_words] - hit[seg.starts]).tolist(),
                    "n_near": near.tolist(),
                    "items": [sorted(items_of.get(d, ())) for d in range(n)],
                },
                schema,
            )

    return index.mapInArrow(look_up, "doc_id bigint, text_hash bigint, n_words bigint, n_hit bigint, n_near bigint, items array<string>")


def decontaminate(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int | None = None) -> DataFrame:
    """``match`` over a freshly stored index of ``docs``."""
    return match(stored(build_index(docs), "postings"), benchmark, window=window, slop=slop)
