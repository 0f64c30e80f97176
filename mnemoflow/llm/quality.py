"""Text quality by the votes of the nearest labelled texts in a latent space.

A text's terms are its words, hashed, its pairs of neighbouring characters, by
class (each lower-case letter, each mark; capitals, digits and other letters
as one class each), and the bins of its shape: how much it repeats words and
phrases, its capitals, digits, marks, word and line lengths. Log counts times
inverse document frequency, scaled to length 1, and the shape's bins, scaled
likewise, are projected on the first singular vectors of a bounded sample of
labelled texts (``sample`` rows, the first by a hash of their ids).
The sample's latent vectors and labels are broadcast: ``sample`` x RANK
numbers, whatever the input. Every text is compared with all of them by exact
cosine, in blocks, in one pass without a shuffle; the nearest K vote with
their similarities as weights.

Defined results: a text without terms (null, empty, blank) gets the sample's
mean label; so does one whose neighbours' weights are all 0. With no labelled
text the score is 0.5. Rows that repeat are scored each. A null label isn't
learnt from. Of documents that share a labelled id, the text of the smallest
hash is learnt from. Columns not asked for are ignored; a kept column named
``score`` comes back as ``score_kept``.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .batches import beside, byte_view, chunks, mixed, window_hashes, words_of

SAMPLE = 4000
RANK = 48
NEIGHBOURS = 15
#: Length of the vector of shapes beside that of terms, 1.
SHAPE_WEIGHT = 1.5
_CLASSES = 56
_WORD_TERMS = 960
TERMS = _CLASSES * _CLASSES + _WORD_TERMS
#: A text's share of each kind is told by the bin between these edges.
_SHARE_EDGES = np.array([0.002, 0.01, 0.03, 0.08, 0.2, 0.4, 0.7])
_LENGTH_EDGES = np.array([2.0, 3, 4, 5, 6, 8, 12])
_LINE_EDGES = np.array([2.0, 4, 8, 16, 32, 64, 128])
_BINS = 8
_SHAPES = 8
_CHUNK = 2 << 20
#: Bytes whose pairs are counted at a time, and texts that are scored at a time.
_COUNTED = 1 << 20
_ROWS = 512
_MARKS = ".,;:!?'\"()-/%$#&*=|[]{}<>"


def _classes() -> np.ndarray:
    out = np.full(256, 55, np.uint8)
    out[97:123] = np.arange(26)
    out[65:91], out[48:58], out[[9, 11, 12, 13, 32]], out[10] = 26, 27, 28, 29
    out[[ord(c) for c in _MARKS]] = 30 + np.arange(len(_MARKS))
    out[128:] = 54
    return out


_CLASS = _classes()


def term_counts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Texts x TERMS counts, and the bin of each of a text's shapes."""
    data, offsets = byte_view(column)
    n = len(offsets) - 1
    counts, kinds = np.zeros(n * TERMS, np.int64), np.zeros(n * 64, np.int64)
    for low in range(0, len(data), _COUNTED):  # a few bytes at a time, however long a text is
        first, last = max(low - 1, 0), min(low + _COUNTED, len(data))
        code = _CLASS[data[first:last]].astype(np.int64)
        text = np.repeat(np.arange(n), np.diff(np.clip(offsets, first, last)))
        same = text[1:] == text[:-1]
        counts += np.bincount((text[1:] * TERMS + code[:-1] * _CLASSES + code[1:])[same], minlength=n * TERMS)
        own = slice(1 if low else 0, None)
        kinds += np.bincount(text[own] * 64 + code[own], minlength=n * 64)
    words = words_of(column)
    own = words.text * TERMS + _CLASSES * _CLASSES + (words.hash % np.uint64(_WORD_TERMS)).astype(np.int64)
    counts = (counts + np.bincount(own, minlength=n * TERMS)).reshape(n, TERMS)
    kinds = kinds.reshape(n, 64)

    size = np.maximum(np.diff(offsets), 1)
    letters = np.maximum(kinds[:, :27].sum(1) + kinds[:, 54] // 2, 1)
    marks = kinds[:, 30 : 30 + len(_MARKS)]
    many = np.maximum(words.count, 1)
    again = np.zeros(n)
    if len(words.hash) > 1:
        twice = (words.hash[1:] == words.hash[:-1]) & (words.text[1:] == words.text[:-1])
        again = np.bincount(words.text[1:], twice, n)
    windows, at = window_hashes(words, 3)
    of = words.text[at]
    first = np.unique(mixed(windows + of.astype(np.uint64)), return_index=True)[1]
    total = np.bincount(of, minlength=n)
    repeated = 1 - np.bincount(of[first], minlength=n) / np.maximum(total, 1)
    repeated[total == 0] = 0
    shares = [again / many, repeated, kinds[:, 26] / letters, kinds[:, 27] / size, marks.sum(1) / size, marks.max(1) / np.maximum(words.count, 1)]
    bins = [np.searchsorted(_SHARE_EDGES, x, side="right") for x in shares]
    bins += [np.searchsorted(_LENGTH_EDGES, (size - kinds[:, 28] - kinds[:, 29]) / many, side="right"), np.searchsorted(_LINE_EDGES, words.count / (kinds[:, 29] + 1), side="right")]
    return counts, np.stack(bins, 1)


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-12)


def _features(counts: np.ndarray, bins: np.ndarray, idf: np.ndarray) -> np.ndarray:
    """Scaled terms beside scaled shapes; a bin also counts a little for its neighbours."""
    shape = np.zeros((len(counts), _SHAPES, _BINS + 2), np.float32)
    row, kind = np.arange(len(counts))[:, None], np.arange(_SHAPES)[None, :]
    for step, weight in ((0, 0.5), (1, 1.0), (2, 0.5)):
        shape[row, kind, bins + step] = weight
    return np.hstack([_unit(np.log1p(counts, dtype=np.float32) * idf), SHAPE_WEIGHT * _unit(shape.reshape(len(counts), _SHAPES * (_BINS + 2)))])


@dataclass
class Voters:
    idf: np.ndarray
    basis: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    neighbours: int = NEIGHBOURS

    @property
    def mean(self) -> float:
        return float(self.labels.mean()) if len(self.labels) else 0.5

    def latent(self, counts: np.ndarray, bins: np.ndarray) -> np.ndarray:
        return _unit(_features(counts, bins, self.idf) @ self.basis)

    def scores(self, counts: np.ndarray, bins: np.ndarray) -> np.ndarray:
        out = np.full(len(counts), self.mean)
        if not len(self.labels):
            return out
        k = min(self.neighbours, len(self.labels))
        near = self.latent(counts, bins) @ self.vectors.T
        top = np.argpartition(-near, k - 1, axis=1)[:, :k]
        weight = np.maximum(np.take_along_axis(near, top, 1).astype(np.float64), 0)
        total = weight.sum(1)
        ok = (total > 0) & (counts.sum(1) > 0)
        out[ok] = ((weight * self.labels[top]).sum(1)[ok]) / total[ok]
        return np.clip(out, 0.0, 1.0)


def estimate(counts: np.ndarray, bins: np.ndarray, labels: np.ndarray, rank: int = RANK, neighbours: int = NEIGHBOURS) -> Voters:
    """Latent vectors by a randomised singular value decomposition."""
    n = len(labels)
    idf = (np.log((1 + n) / (1 + (counts > 0).sum(0))) + 1).astype(np.float32)
    x = _features(counts, bins, idf)
    random = np.random.Generator(np.random.PCG64(7))
    y = x @ random.standard_normal((x.shape[1], min(rank + 16, max(n, 1))), np.float32) if n else np.zeros((0, 1), np.float32)
    for _ in range(3):
        y = x @ (x.T @ np.linalg.qr(y)[0]) if n else y
    basis = np.linalg.svd(np.linalg.qr(y)[0].T @ x, full_matrices=False)[2][:rank].T if n else np.zeros((x.shape[1], 1), np.float32)
    return Voters(idf, np.ascontiguousarray(basis, np.float32), _unit(x @ basis).astype(np.float32), labels.astype(np.float64), neighbours)


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", doc_id: str = "doc_id", text: str = "text", sample: int = SAMPLE) -> Voters:
    """Voters from at most ``sample`` rows of ``labels`` (doc_id, label), the first by a hash; their texts are looked up in ``docs``."""
    rows = labels.select(F.col(doc_id).alias("k"), F.col(label).cast("int").alias("y")).where("k IS NOT NULL AND y IS NOT NULL")
    drawn = rows.orderBy(F.xxhash64("k"), "k", "y").limit(sample)
    found = docs.select(F.col(doc_id).alias("k"), F.col(text).alias("text")).join(F.broadcast(drawn.select("k").distinct()), "k", "left_semi")
    one = found.groupBy("k").agg(F.min_by("text", F.xxhash64("text")).alias("text"))  # no id has more than one text
    kind = docs.schema[doc_id].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=_CHUNK):
            for at in range(0, batch.num_rows, _ROWS):
                part = batch.slice(at, _ROWS)
                c = np.hstack(term_counts(part.column("text"))).astype(np.int64)
                yield pa.RecordBatch.from_arrays([part.column("k"), part.column("y"), pa.array([_sparse(r) for r in c], pa.binary())], names=["k", "y", "c"])

    got = one.join(F.broadcast(drawn), "k").mapInArrow(count, f"k {kind}, y int, c binary").toArrow()
    order = sorted(range(got.num_rows), key=lambda i: (str(got["k"][i]), got["c"][i].as_py(), got["y"][i].as_py()))
    counts = np.zeros((len(order), TERMS + _SHAPES), np.int32)
    for row, i in enumerate(order):
        at, many = np.frombuffer(got["c"][i].as_py(), np.int64).reshape(2, -1)
        counts[row, at] = many
    return estimate(counts[:, :TERMS], counts[:, TERMS:], np.array([got["y"][i].as_py() for i in order], float))


def _sparse(counts: np.ndarray) -> bytes:
    at = np.flatnonzero(counts)
    return np.concatenate([at, counts[at]]).tobytes()


def score(docs: DataFrame, voters: Voters, keep: list[str], text: str = "text") -> DataFrame:
    """``keep`` columns with ``score``, the weighted share of neighbours labelled 1."""
    sent = docs.sparkSession.sparkContext.broadcast(voters)

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        def make(texts: pa.Array) -> list[pa.Array]:
            return [pa.array(np.concatenate([sent.value.scores(*term_counts(texts.slice(at, _ROWS))) for at in range(0, len(texts), _ROWS)]))]

        return make

    return beside(docs, keep, text, "score double", start, _CHUNK)
