"""Importance resampling and exact deduplication against plain versions."""

from __future__ import annotations

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from mnemoflow.llm import exact_dedup, importance
from mnemoflow.llm.batches import words_of

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
UPPER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def plain_features(text, longest):
    words = WORD.findall((text or "").translate(UPPER))
    return len(words), [" ".join(words[i : i + n]) for n in range(1, longest + 1) for i in range(len(words) - n + 1)]


def plain_resample(docs, target, longest, buckets, share, least):
    bucket = lambda f: zlib.crc32(f.encode()) % buckets
    count = [Counter(bucket(f) for t in texts for f in plain_features(t, longest)[1]) for texts in ([t for _, t in docs], target)]
    S, T = (sum(c.values()) for c in count)
    gain = {b: math.floor(1000 * math.log((count[1][b] + 1) * (S + buckets) / ((count[0][b] + 1) * (T + buckets)))) for b in range(buckets)}
    out = []
    for n, (doc_id, text) in enumerate(docs):
        n_words, features = plain_features(text, longest)
        weight = sum(gain[bucket(f)] for f in features) // len(features) if features else 0
        h = int(hashlib.sha256(f"2024:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        out.append([n, doc_id, len(features), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296))), n_words])
    able = sorted((r for r in out if r[5] >= least), key=lambda r: (-r[4], r[1] is None, r[1] or 0, r[2]))
    rank = {r[0]: k for k, r in enumerate(able[: len(able) * share // 100], 1)}
    return Counter((*r[1:5], rank.get(r[0])) for r in out)


@pytest.mark.parametrize("longest", [1, 2, 3])
def test_resample_equals_the_plain_version(spark, longest):
    rng = random.Random(longest)
    vocabulary = ["Ab", "ab", "c-d", "été", "x1", "zz", "q"]
    docs = [(n // 2 if n % 7 else None, " ".join(rng.choices(vocabulary, k=rng.choice([0, 1, 2, 3, 30, 60])))) for n in range(60)]
    docs += [(500, None), (501, ""), (502, "..!"), (7, "ab " * 3000), (7, "ab " * 3000)]
    target = [" ".join(rng.choices(vocabulary[:4], k=20)) for _ in range(5)] + [None]
    df = spark.createDataFrame([(*d, "e") for d in docs], "doc_id long, text string, score string").repartition(3)
    aim = spark.createDataFrame([(t,) for t in target], "text string")
    got = importance.resample(df, aim, longest=longest, buckets=97, share=30, least_words=5)
    assert Counter(tuple(r) for r in got.select("doc_id", "n_features", "weight", "score", "rank").collect()) == plain_resample(docs, target, longest, 97, 30, 5)


def test_resample_of_nothing(spark):
    none = spark.createDataFrame([], "doc_id long, text string")
    assert importance.resample(none, none).collect() == []
    few = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert [(r.n_features, r.rank) for r in importance.resample(few, none).collect()] == [(3, None)]


def test_suffix_array_and_prefixes():
    rng = random.Random(1)
    for longest in (1, 2, 3, 5):
        texts = [rng.choices("abc", k=rng.randrange(9)) for _ in range(20)]
        numbers = np.array([ord(c) for t in texts for c in t])
        text = np.repeat(np.arange(20), [len(t) for t in texts])
        left = np.cumsum([len(t) for t in texts])[text] - np.arange(len(text))
        order = importance.suffix_array(numbers, text, longest)
        heads = [numbers[i : i + min(left[i], longest)].tolist() for i in order]
        assert heads == sorted(heads)
        lcp = importance.common_prefixes(order, numbers, left, longest)
        assert lcp[1:].tolist() == [next((k for k, (a, b) in enumerate(zip(x, y)) if a != b), min(len(x), len(y))) for x, y in zip(heads, heads[1:])]


def test_words_whose_hashes_agree_stay_apart():
    column = pa.array(["one two one three", "two"])
    words = words_of(column, importance._FOLD, checked=True, blank=importance._BLANK)
    words.hash[:] = 7  # all alike
    assert importance.word_numbers(words, b"one two one threetwo").tolist() == [0, 1, 0, 2, 1]


def plain_copies(rows):
    body = lambda t: re.sub(r"[\x20\x09-\x0D]+", " ", t or "")
    groups: dict[str, list] = {}
    for doc_id, text, *_ in rows:
        groups.setdefault(body(text), []).append(doc_id)
    out = Counter()
    for text, ids in groups.items():
        least = min(ids, key=lambda i: (i is None, i or 0))
        for k, i in enumerate(sorted(ids, key=lambda i: (i is None, i or 0))):
            out[i, least, len(ids), k == 0, hashlib.sha256(text.encode()).hexdigest()] += 1
    return out


COPIES = ["doc_id", "keep_id", "group_size", "kept", "text_sha256"]


@pytest.mark.parametrize("cuts", [(), (0.5,), (0.2, 0.5, 0.8)])
def test_copies_equal_the_plain_version(spark, monkeypatch, cuts):
    rng = random.Random(4)
    texts = ["a b", "a  b", "a\tb", " a b", "", None, " ", "long " * 5000, "é", "é b"]
    rows = [(rng.choice([None, *range(90)]), rng.choice([*texts, f"own {n}"]), "x", n) for n in range(300)]
    rows += [(5, "hot copy", "x", 0)] * 150  # one group, and one row, is a third of all
    docs = spark.createDataFrame(rows, "doc_id long, text string, digest string, place int").repartition(5)
    monkeypatch.setattr(exact_dedup, "HOT", 4)
    got = exact_dedup.deduplicate(docs, cuts=cuts).select(COPIES)
    assert Counter(tuple(r) for r in got.collect()) == plain_copies(rows)


def test_copies_of_nothing_and_of_ids_that_are_text(spark):
    assert exact_dedup.deduplicate(spark.createDataFrame([], "doc_id long, text string")).collect() == []
    rows = [("b", "x"), ("a", "x"), (None, "x"), ("c", "y")]
    got = exact_dedup.deduplicate(spark.createDataFrame(rows, "doc_id string, text string")).select(COPIES).collect()
    assert {(r.doc_id, r.keep_id, r.group_size, r.kept) for r in got} == {("a", "a", 3, True), ("b", "a", 3, False), (None, "a", 3, False), ("c", "c", 1, True)}


def test_bytes_decide_where_digests_agree(spark, monkeypatch):
    """Later batches: a digest that is there already with other bytes is no copy."""
    monkeypatch.setattr(exact_dedup, "digest", lambda body: F.unhex(F.sha2(F.substring(body, 1, 1), 256)))
    index = exact_dedup.new_index(10)
    groups = []
    for batch in ([(1, "ab"), (2, "c")], [(3, "ab"), (4, "cd")], [(5, "cd"), (6, "ab"), (7, "x")]):
        _, own, index = exact_dedup.ingest(spark.createDataFrame(batch, "doc_id long, text string"), index)
        groups.append(sorted((r.origin, r.doc_id) for r in own.collect()))
    assert groups == [[(0, 1), (0, 2)], [(0, 1), (1, 4)], [(0, 1), (1, 4), (2, 7)]]


def test_filters_hold_all_their_keys():
    rng = np.random.default_rng(2)
    for n in (1, 2, 3, 7, 100, 5000, 200000):
        keys = np.unique(rng.integers(0, 1 << 64, n, dtype=np.uint64))
        own = exact_dedup.FuseFilter.unpacked(exact_dedup.FuseFilter(keys).packed())
        assert own.holds(keys).all()
        assert own.holds(rng.integers(0, 1 << 64, 100000, dtype=np.uint64)).mean() < 1 / 128
