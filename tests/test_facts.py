"""The memory of facts: at once, batch after batch, and against a plain version."""

from __future__ import annotations

import random

from pyspark.sql import functions as F

from mnemoflow.operators import facts
from mnemoflow.plans.remember import recall, remember
from mnemoflow.sources.store import MemoryStore

KIND = "shard_id string, event_id long, ordinal long, content string"


def some_events():
    rng = random.Random(8)
    words = [f"Thing{'abcdefgh'[k % 8] * (k % 5 + 1)}" for k in range(40)]
    rows, pool = [], []
    for n in range(300):
        if pool and rng.random() < 0.6:
            own = rng.choice(pool).split()
            if rng.random() < 0.7:
                own[rng.randrange(len(own))] = rng.choice(words)
            text = " ".join(own)
        else:
            text = " ".join(rng.sample(words, rng.randint(1, 6)))
        pool.append(text)
        rows.append((rng.choice("ab"), n, n * 700, text))
    return rows + [("a", 900, 300_000, None), ("a", 901, 300_001, "of the"), ("b", 902, 300_002, "")]


def plain_memories(rows):
    seen, latest, root, terms_of, versions = {}, {}, {}, {}, {}
    for shard, event, _, text in sorted(rows, key=lambda r: (r[2], r[1])):
        terms = list(dict.fromkeys((text or "").lower().split()))
        terms = [t for t in terms if t.startswith("thing")]
        if not terms:
            continue
        if (shard, text) in seen:
            versions[root[seen[shard, text]]][2] += 1
            continue
        seen[shard, text] = event
        keys = sorted(terms, key=lambda t: (-len(t), t))[: facts.KEYS]
        near = None
        for k in keys:
            old = latest.get((shard, k))
            if old is not None:
                share = len(set(terms) & set(terms_of[old])) / len(set(terms) | set(terms_of[old]))
                if share >= facts.SIMILAR:
                    near = max(near or (0, 0), (share, old))
        root[event] = root[near[1]] if near else event
        terms_of[event] = terms
        versions.setdefault(root[event], [shard, event, 0, 0])
        versions[root[event]][1] = event
        versions[root[event]][2] += 1
        versions[root[event]][3] += 1
        for k in keys:
            latest[shard, k] = event
    return {(shard, str(m), str(event), n, said) for m, (shard, event, said, n) in versions.items()}


def found(df):
    return {(r.shard_id, r.memory_id, r.event_id, r.n_versions, r.n_said) for r in df.collect()}


def test_batches_give_what_one_gives(spark, tmp_path):
    rows = some_events()
    events = spark.createDataFrame(rows, KIND).repartition(3)
    expected = plain_memories(rows)
    assert any(n > 2 for *_, n, _ in expected) and any(said > n for *_, n, said in expected)
    for name, cuts in (("one", []), ("four", [50_000, 51_000, 180_000])):
        store = MemoryStore(spark, str(tmp_path / name))
        for k, (low, high) in enumerate(zip([-1, *cuts], [*cuts, 1 << 40], strict=True)):
            batch = events.where((F.col("ordinal") > low) & (F.col("ordinal") <= high))
            assert remember(store, batch, f"batch{k}")
            assert not remember(store, batch, f"batch{k}")  # a batch that comes again counts once
        assert found(recall(store)) == expected


def test_nothing_to_remember(spark, tmp_path):
    store = MemoryStore(spark, str(tmp_path))
    assert remember(store, spark.createDataFrame([("a", 1, 1, None)], KIND), "t")
    assert recall(store).collect() == []
