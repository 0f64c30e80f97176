"""Language identification by interpolated Kneser-Ney character models.

Each language has a 4-gram model: raw counts at the highest order,
continuation counts below it, one absolute discount per order. ``fit`` learns
from a bounded sample of whole labelled texts (of each language those of the
smallest hashes, ``train_chars`` characters at about and MIN_TEXTS texts at
least, or all it has) and merges all languages into one
sorted array of 64-bit n-gram hashes per order, each with the languages that
have seen it and their log probabilities, so that the model grows with the
samples and not with their number times that of languages. Texts are scored in
one pass without a shuffle, a bounded piece at a time: in a language that hasn't
seen an n-gram it backs off to the next order. The language of the lowest
cross-entropy per character wins, ties going to the first by name. A tenth of
the sample stays out of the counts; it calibrates the temperature that turns
cross-entropies into ``score`` and each language's rejection threshold. A
language with fewer than MIN_TEXTS texts beside that tenth is learned from all
of its sample and has no threshold.

Defined results: a text that is null or has no letter is ``und`` with score 0
and not rejected; so is any text if no labelled text was given. Texts keep
their whole length. Rows with a null label or without a letter aren't learnt from. Rows that
repeat are predicted each. Columns not asked for are ignored; a kept column
named as a made one comes back with ``_kept`` behind its name.
"""

from __future__ import annotations

import unicodedata
from collections import defaultdict
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .batches import beside, chunks, mixed

ORDER = 4
#: Characters of each language, at about, that the model learns from.
TRAIN_CHARS = 2_000_000
#: Texts of each language that the model learns from at least, however long they are, if there are so many.
MIN_TEXTS = 10
#: Of the calibration texts of a language, the share with a cross-entropy below its threshold.
ACCEPTED = 0.999
UNKNOWN = "und"
_START, _BLANK = 1, 32
_CHUNK = 1 << 20
#: Characters of a text that are looked up at a time, and numbers of a table of n-grams by languages.
PIECE = 1 << 20
_TABLE = 1 << 22


@cache
def _folds() -> tuple[np.ndarray, np.ndarray]:
    """Per code point: its lower-case letter or mark as 16 bits, else a blank; whether it's a letter."""
    fold, letter = np.full(0x110000, _BLANK, np.uint64), np.zeros(0x110000, bool)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha() or (c > 0x2FF and unicodedata.category(x)[0] == "M"):
            low = x.lower()
            v = ord(low) if len(low) == 1 else c
            fold[c], letter[c] = (v ^ (v >> 16)) & 0xFFFF, x.isalpha()
    return fold, letter


_NEW = np.full(3, _START, np.uint64)


def _coded(text: str, before: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The packed 4-grams of (a piece of) a text that goes on from the codes ``before``; its last three codes."""
    fold, _ = _folds()
    code = np.concatenate([before, fold[np.frombuffer(text.encode("utf-32-le", "replace"), np.uint32)]])
    blank = code == _BLANK
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    keep[:3] = True
    code = code[keep]
    key = code.copy()
    for k in range(1, ORDER):
        key[k:] |= code[:-k] << np.uint64(16 * k)
    return key[3:], code[-3:]


def has_letter(text: str | None) -> bool:
    return any(map(str.isalpha, text or ""))


def grams(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """4-grams packed in 64 bits, the number of the text of each, and which texts have a letter."""
    fold, letter = _folds()
    parts = [t or "" for t in texts]
    sizes = np.fromiter((len(t) + 3 for t in parts), np.int64, len(parts))
    raw = np.frombuffer("".join("   " + t for t in parts).encode("utf-32-le", "replace"), np.uint32)
    code = fold[raw]
    starts = np.cumsum(sizes) - sizes
    has = np.add.reduceat(letter[raw], starts) > 0 if len(raw) else np.zeros(0, bool)
    real = np.ones(len(code), bool)
    for k in range(3):
        code[starts + k], real[starts + k] = _START, False
    text = np.repeat(np.arange(len(parts), dtype=np.int32), sizes)
    blank = code == _BLANK
    keep = np.ones(len(code), bool)
    keep[1:] = ~(blank[1:] & blank[:-1])
    code, text, real = code[keep], text[keep], real[keep]
    key = code.copy()
    for k in range(1, ORDER):
        key[k:] |= code[:-k] << np.uint64(16 * k)
    return key[real], text[real], has


def pieces(texts: list[str | None], most: int = PIECE) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """``grams`` of all texts, at most about ``most`` characters at a time; a longer text comes in several parts."""
    start = held = 0
    for i in range(len(texts) + 1):
        size = len(texts[i] or "") if i < len(texts) else 0
        if start < i and (i == len(texts) or held + size > most):
            keys, text, has = grams(texts[start:i])
            yield keys, text + start, np.flatnonzero(has) + start
            start, held = i, 0
        if size > most:
            before, whole = _NEW, texts[i]
            for at in range(0, size, most):
                part = whole[at : at + most]
                keys, before = _coded(part, before)
                yield keys, np.full(len(keys), i, np.int32), np.array([i] if has_letter(part) else [], np.int64)
            start = i + 1
        held += size if start <= i else 0


@dataclass
class HashArray:
    """Sorted hashes, each with a row of languages and their values; an index over the top bits shortens the search."""

    hashes: np.ndarray
    #: Row i is low[i] to low[i + 1] of ``who`` and ``value``.
    low: np.ndarray
    who: np.ndarray
    value: np.ndarray
    bits: int
    first: np.ndarray
    most: int

    @staticmethod
    def of(parts: list[tuple[np.ndarray, np.ndarray]]) -> HashArray:
        """``parts``: each language's keys and values."""
        none = np.zeros(0, np.uint64)
        h = mixed(np.concatenate([none, *(k for k, _ in parts)]))
        who = np.repeat(np.arange(len(parts)), [len(k) for k, _ in parts]).astype(np.uint16)
        order = np.argsort(h, kind="stable")
        h, who = h[order], who[order]
        value = np.concatenate([np.zeros(0), *(v for _, v in parts)])[order].astype(np.float32)
        fresh = np.ones(len(h), bool)
        fresh[1:] = h[1:] != h[:-1]
        low = np.append(np.flatnonzero(fresh), len(h)).astype(np.int64)
        h = h[fresh]
        bits = max(1, int(len(h)).bit_length())
        first = np.searchsorted(h >> np.uint64(64 - bits), np.arange((1 << bits) + 1, dtype=np.uint64)).astype(np.int32)
        return HashArray(h, low, who, value, bits, first, int(np.diff(first).max(initial=0)))

    def find(self, keys: np.ndarray) -> np.ndarray:
        """The place of each key, or -1."""
        out = np.full(len(keys), -1, np.int32)
        if not len(self.hashes):
            return out
        h = mixed(keys)
        bucket = (h >> np.uint64(64 - self.bits)).astype(np.int64)
        at, end = self.first[bucket], self.first[bucket + 1]
        left = np.flatnonzero(at < end)
        at, end, h = at[left], end[left], h[left]
        for _ in range(self.most):
            hit = self.hashes[at] == h
            out[left[hit]] = at[hit]
            at = at + 1
            go = ~hit & (at < end)
            if not go.any():
                break
            left, at, end, h = left[go], at[go], end[go], h[go]
        return out

    def entries(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Of the keys that are here: the key's place among ``keys``, the language and the value, for each language that has it."""
        at = self.find(keys)
        row = np.flatnonzero(at >= 0)
        low, many = self.low[at[row]], self.low[at[row] + 1] - self.low[at[row]]
        flat = np.arange(many.sum()) + np.repeat(low - (np.cumsum(many) - many), many)
        return np.repeat(row, many), self.who[flat], self.value[flat]


@dataclass
class Model:
    languages: list[str]
    #: By order, from 1: n-grams with log probabilities; contexts with log back-off weights, 0 in a language without one.
    seen: list[HashArray]
    backoff: list[HashArray]
    unseen: np.ndarray
    temperature: float = 1.0
    thresholds: np.ndarray | None = None

    def log_probabilities(self, keys: np.ndarray, order: int = ORDER) -> np.ndarray:
        """Of distinct n-grams, in all languages."""
        if not order:
            return np.repeat(self.unseen[None, :], len(keys), 0)
        if order == 1:
            out = self.log_probabilities(keys, 0)
        else:
            shorter, back = np.unique(keys & np.uint64((1 << 16 * (order - 1)) - 1), return_inverse=True)
            out = self.log_probabilities(shorter, order - 1)[back]
            context, back = np.unique(keys >> np.uint64(16), return_inverse=True)
            weights = np.zeros((len(context), len(self.languages)), np.float32)
            row, who, value = self.backoff[order - 1].entries(context)
            weights[row, who] = value
            out += weights[back]
        row, who, value = self.seen[order - 1].entries(keys)
        out[row, who] = value
        return out

    def cross_entropies(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
        """Per text and language, nats per character; which texts have a letter."""
        size = len(self.languages)
        total, n, has = np.zeros((len(texts), size)), np.zeros(len(texts)), np.zeros(len(texts), bool)
        for keys, text, letters in pieces(texts):
            has[letters] = True
            n += np.bincount(text, minlength=len(texts))
            some, back = np.unique(keys, return_inverse=True)
            step = max(1024, _TABLE // max(size, 1))
            for at in range(0, len(some), step):
                logs = self.log_probabilities(some[at : at + step])
                own = slice(None) if len(some) <= step else np.flatnonzero((back >= at) & (back < at + step))
                where, of = text[own], back[own] - at
                for k in range(size):
                    total[:, k] += np.bincount(where, logs[of, k], len(texts))
        return -total / np.maximum(n, 1)[:, None], has


def _discount(counts: np.ndarray) -> float:
    n1, n2 = int((counts == 1).sum()), int((counts == 2).sum())
    return n1 / (n1 + 2 * n2) if n1 and n2 else 0.5


def estimate(counts: dict[str, tuple[np.ndarray, np.ndarray]]) -> Model:
    """Models of all languages from their distinct packed 4-grams and counts, one language at a time."""
    languages = sorted(counts)
    letters = [np.unique(counts[name][0] & np.uint64(0xFFFF)) for name in languages]
    uniform = 1.0 / (len(np.unique(np.concatenate(letters))) + 1) if languages else 1.0
    seen: list[list] = [[] for _ in range(ORDER)]
    backoff: list[list] = [[] for _ in range(ORDER)]
    unseen = np.zeros(len(languages), np.float32)
    for j, name in enumerate(languages):
        keys, c = counts[name]
        order = np.argsort(keys)
        levels = [(keys[order], c[order].astype(np.float64))]
        for k in range(ORDER - 1, 0, -1):  # below the highest order, how many n-grams end so
            below, many = np.unique(levels[0][0] & np.uint64((1 << 16 * k) - 1), return_counts=True)
            levels.insert(0, (below, many.astype(np.float64)))
        lower, lower_keys = np.full(1, uniform), np.zeros(1, np.uint64)
        for k, (own, c) in enumerate(levels, 1):
            d = _discount(c)
            contexts, of = np.unique(own >> np.uint64(16), return_inverse=True) if k > 1 else (np.zeros(1, np.uint64), np.zeros(len(own), np.int64))
            total = np.bincount(of, c, len(contexts))
            weights = d * np.bincount(of, minlength=len(contexts)) / total
            p = np.maximum(c - d, 0) / total[of] + weights[of] * lower[np.searchsorted(lower_keys, own & np.uint64((1 << 16 * (k - 1)) - 1))]
            if k == 1:
                unseen[j] = np.log(weights[0] * uniform)
            seen[k - 1].append((own, np.log(p)))
            backoff[k - 1].append((contexts, np.log(weights)))
            lower, lower_keys = p, own
    return Model(languages, [HashArray.of(x) for x in seen], [HashArray.of(x) for x in backoff], unseen)


def _calibrated(model: Model, truth: np.ndarray, entropies: np.ndarray) -> Model:
    """The temperature of the least loss on held-back texts, and thresholds of their own cross-entropies."""
    def loss(t: float) -> float:
        z = -entropies * t
        z -= z.max(1, keepdims=True)
        return float(np.mean(np.log(np.exp(z).sum(1)) - z[np.arange(len(truth)), truth]))

    if len(truth):
        model.temperature = min((2.0**k for k in range(-2, 8)), key=loss)
    own = [entropies[truth == k, k] for k in range(len(model.languages))]
    model.thresholds = np.array([np.quantile(x, ACCEPTED) * 1.05 if len(x) else np.inf for x in own])
    return model


def sampled(rows: DataFrame, train_chars: int) -> DataFrame | None:
    """Of each language of ``rows`` (k, text, lang) the texts to learn from, and whether they are ``held`` out.

    Hashes are counted in steps of an eighth of a power of two, so the sample has all texts up to a step.
    """
    key = F.coalesce("k", "text")
    drawn = F.pmod(F.xxhash64(key, F.lit(2)), F.lit(1 << 62)) + 1
    rows = rows.withColumn("step", F.floor(F.log2(drawn.cast("double")) * 8)).withColumn("held", F.pmod(F.xxhash64(key, F.lit(3)), F.lit(10)) == 0)
    steps: defaultdict[str, list] = defaultdict(list)
    for r in rows.groupBy("lang", "step").agg(F.sum(F.length("text")).alias("chars"), F.count("*").alias("n"), F.count_if(~F.col("held")).alias("learned")).collect():
        steps[r.lang].append((r.step, r.chars, r.n, r.learned))
    if not steps:
        return None
    last, whole = {}, []
    for name, own in steps.items():
        chars = n = learned = 0
        for step, more, texts, kept in sorted(own):
            chars, n, learned, last[name] = chars + more, n + texts, learned + kept, step
            if chars >= train_chars and n >= MIN_TEXTS:
                break
        if learned < MIN_TEXTS:
            whole.append(name)
    up_to = F.create_map(*[F.lit(x) for pair in last.items() for x in pair])
    return rows.where(F.col("step") <= F.try_element_at(up_to, "lang")).withColumn("held", F.col("held") & ~F.col("lang").isin(whole))


def fit(docs: DataFrame, labelled: Column, text: str = "text", lang: str = "lang", row_key: str = "doc_id", train_chars: int = TRAIN_CHARS) -> Model:
    """A model from at about ``train_chars`` characters and MIN_TEXTS texts at least of each language, of the rows
    that ``labelled`` holds for.

    The driver gets the sums of ``sampled`` and the sample's distinct 4-grams, no more than the sample has characters.
    """
    rows = docs.where(labelled & F.col(lang).isNotNull() & F.col(text).rlike(r"\p{L}")).select(F.col(row_key).cast("string").alias("k"), F.col(text).alias("text"), F.col(lang).cast("string").alias("lang"))
    sample = sampled(rows, train_chars)
    if sample is None:
        return estimate({})

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in chunks(batches, most=_CHUNK):
            names = np.array(batch.column("lang").to_pylist(), object)
            for keys, of, _ in pieces(batch.column("text").to_pylist()):
                for name in dict.fromkeys(names[np.unique(of)]):
                    k, n = np.unique(keys[(names == name)[of]], return_counts=True)
                    yield pa.RecordBatch.from_pydict({"lang": pa.array([name] * len(k), pa.string()), "k": pa.array(k.view(np.int64)), "n": pa.array(n)})

    got = sample.where(~F.col("held")).mapInArrow(count, "lang string, k bigint, n bigint").groupBy("lang", "k").agg(F.sum("n").alias("n")).toArrow()
    names = np.array(got.column("lang").to_pylist(), object)
    keys, n = got.column("k").to_numpy().view(np.uint64), got.column("n").to_numpy()
    model = estimate({name: (keys[names == name], n[names == name]) for name in dict.fromkeys(names)})
    held = predict(sample.where(F.col("held") & F.col("lang").isin(model.languages)), model, ["lang"], entropies=True).toArrow() if model.languages else None
    if held is None:
        return model
    place = {x: k for k, x in enumerate(model.languages)}
    ok = [(place[x], e) for x, e in zip(held.column("lang").to_pylist(), held.column("entropies").to_pylist(), strict=True) if e]
    return _calibrated(model, np.array([x for x, _ in ok], np.int64), np.array([e for _, e in ok]).reshape(-1, len(place)))


def predict(docs: DataFrame, model: Model, keep: list[str], text: str = "text", entropies: bool = False) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` (posterior of that language), ``rejected`` (its
    cross-entropy is above the threshold) and ``cross_entropy``; with ``entropies``, those of all languages."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def start() -> Callable[[pa.Array], list[pa.Array]]:
        m = sent.value
        limits = m.thresholds if m.thresholds is not None else np.full(len(m.languages), np.inf)

        def make(column: pa.Array) -> list[pa.Array]:
            n, texts = len(column), column.to_pylist()
            if m.languages:
                ce, has = m.cross_entropies(texts)
                best = ce.argmin(1)
                z = -(ce - ce.min(1, keepdims=True)) * m.temperature
                score = 1 / np.exp(z).sum(1)
                least = ce[np.arange(n), best]
            else:
                has, best, score, least, ce = np.zeros(n, bool), np.zeros(n, int), np.zeros(n), np.zeros(n), np.zeros((n, 0))
            columns = [
                pa.array([m.languages[b] if h else UNKNOWN for b, h in zip(best, has, strict=True)], pa.string()),
                pa.array(np.where(has, score, 0.0)),
                pa.array([bool(h and e > limits[b]) for h, e, b in zip(has, least, best, strict=True)], pa.bool_()),
                pa.array(np.where(has, least, np.nan), from_pandas=True),
            ]
            every = [pa.array([list(e) if h else None for h, e in zip(has, ce, strict=True)], pa.list_(pa.float64()))] if entropies else []
            return columns + every

        return make

    made = "lang_pred string, score double, rejected boolean, cross_entropy double" + (", entropies array<double>" if entropies else "")
    return beside(docs, keep, text, made, start, _CHUNK)
