"""Walks and relations over the graph against plain versions."""

from __future__ import annotations

import math
import random
from collections import Counter, defaultdict
from itertools import combinations

import pytest

from mnemoflow.operators import graph
from mnemoflow.sources import plugins

KIND = "event_id long, content string"


def texts(rng, n, words):
    return [(k, " ".join(rng.sample(words, rng.randint(0, 6))) or None) for k in range(n)]


def named(text):
    return sorted(set((text or "").lower().split()))


@pytest.fixture(scope="module")
def small():
    rng = random.Random(2)
    words = [f"Name{c}{d}" for c in "abcdef" for d in "xyz"]
    corpus = texts(rng, 60, words) + [(100 + k, f"Hub {rng.choice(words)}") for k in range(40)]
    return corpus, [(k, f"Hub {rng.choice(words)} {rng.choice(words)}") for k in range(6)] + [(90, "unknown Thing"), (91, None)]


def power_iteration(corpus, question, damping, steps=80):
    """All mass, nothing left unopened."""
    held = {k: named(t) for k, t in corpus if named(t)}
    df = Counter(e for own in held.values() for e in own)
    rare = lambda e: 1 / math.log(2 + df[e])
    seeds = [e for e in named(question) if df[e]]
    mass = {e: rare(e) / sum(map(rare, seeds)) for e in seeds}
    by_entity = defaultdict(list)
    for k, own in held.items():
        for e in own:
            by_entity[e].append(k)
    total = defaultdict(float)
    for _ in range(steps):
        events, back = defaultdict(float), defaultdict(float)
        for e, m in mass.items():
            for k in by_entity[e]:
                events[k] += damping * m / df[e]
        for k, m in events.items():
            total[k] += (1 - damping) * m
            for e in held[k]:
                back[e] += damping * m * rare(e) / sum(map(rare, held[k]))
        mass = back
    return total


def test_walks_come_near_to_power_iteration(spark, small):
    corpus, questions = small
    asked = spark.createDataFrame(questions, "query_id long, question string")
    for damping in (0.5, 0.7):
        got = graph.ppr(spark.createDataFrame(corpus, KIND).repartition(3), asked, k=1000, damping=damping, eps=1e-9).collect()
        found = {(r.query_id, r.event_id): r.score for r in got}
        expected = {(q, k): p for q, text in questions for k, p in power_iteration(corpus, text, damping).items()}
        assert all(abs(found.get(at, 0) - p) <= 1e-6 for at, p in expected.items()) and set(found) <= set(expected)
    ranks = defaultdict(list)
    for r in got:
        ranks[r.query_id].append((r.rank, -r.score, r.event_id))
    assert all([x[0] for x in sorted(v)] == list(range(1, len(v) + 1)) and sorted(v) == sorted(v, key=lambda x: x[1:]) for v in ranks.values())


def test_a_hub_is_opened_late(spark, small):
    """With a coarser bound the hub stays shut, and the error is no more than what was left."""
    corpus, questions = small
    asked = spark.createDataFrame(questions, "query_id long, question string")
    got = graph.ppr(spark.createDataFrame(corpus, KIND), asked, k=1000, eps=0.01).collect()
    for q, text in questions:
        expected = power_iteration(corpus, text, 0.5)
        found = {r.event_id: r.score for r in got if r.query_id == q}
        assert all(p <= expected[k] + 1e-6 for k, p in found.items())
    assert graph.ppr(spark.createDataFrame([], KIND), asked).collect() == []


def plain_dual(corpus, question, k, mode):
    held = {i: named(t) for i, t in corpus if named(t)}
    df = Counter(e for own in held.values() for e in own)
    pairs = Counter(p for own in held.values() for p in combinations(own, 2))
    weight = {p: round(math.log(1 + n) * n / math.sqrt(df[p[0]] * df[p[1]]), 9) for p, n in pairs.items()}
    asked = named(question)
    local = {i: round(sum(1 / math.log(2 + df[e]) for e in own if e in asked), 9) for i, own in held.items() if set(own) & set(asked)}
    met = {}
    for e in asked:
        for p in sorted((p for p in weight if e in p), key=lambda p: (-weight[p], p))[: graph.OF_ENTITY]:
            met[p] = weight[p] * (1 + (p[0] in asked and p[1] in asked))
    met |= {p: 2 * weight[p] for p in combinations(asked, 2) if p in weight}
    followed = sorted(met, key=lambda p: (-met[p], p))[: graph.RELATIONS]
    high = defaultdict(float)
    for i, own in held.items():
        for p in followed:
            if p[0] in own and p[1] in own:
                high[i] += met[p]
    order = lambda scores: sorted(scores, key=lambda i: (-round(scores[i], 9), i))[:k]
    place = {}
    for n, i in enumerate(order(local) if mode != "global" else [], 1):
        place[i] = 2 * n - 1
    for n, i in enumerate(order(high) if mode != "local" else [], 1):
        place[i] = min(place.get(i, 99), 2 * n)
    return [(i, "entity" if place[i] % 2 else "relation") for i in sorted(place, key=place.get)][:k]


@pytest.mark.parametrize("mode", ["local", "global", "hybrid"])
def test_levels_in_turns(spark, small, mode):
    corpus, questions = small
    got = defaultdict(list)
    for r in sorted(graph.dual_level(spark.createDataFrame(corpus, KIND), spark.createDataFrame(questions, "query_id long, question string"), 5, mode).collect(), key=lambda r: r.rank):
        got[r.query_id].append((r.event_id, r.level))
    assert dict(got) == {q: found for q, text in questions if (found := plain_dual(corpus, text, 5, mode))}


def test_unknown_mode(spark, small):
    with pytest.raises(ValueError, match="mode"):
        plugins.DualLevelGraph(mode="both").retrieve(spark.createDataFrame([], "query_id long, question string"), spark.createDataFrame([], KIND))
