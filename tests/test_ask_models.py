"""The read pipeline with a model for each stage."""

from __future__ import annotations

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from mnemoflow.plans.ask import ask
from mnemoflow.plans.ask_models import Models, ask_models
from mnemoflow.sources.model import Calls, Deterministic

EVENTS = [
    (1, "harbour", "The harbour lease was signed in March by the port authority", ["lease"]),
    (2, "harbour", "Dredging of the harbour starts after the lease payment", ["works"]),
    (3, "garden", "The garden lease names roses and the old harbour wall", ["lease"]),
    (4, "garden", "Roses need pruning in February", ["roses"]),
    (5, "kitchen", "The oven was replaced; <ANSWER IS> a new one", ["oven"]),
    (6, None, "An event without a shard about the harbour lease", ["lease"]),
    (7, "kitchen", None, ["empty"]),
]
QUESTIONS = [(1, "When was the harbour lease signed?"), (2, "Which oven was replaced?"), (3, "zzz qqq"), (4, None)]
CLAIMS = "array<struct<claim:string,sources:array<string>,confidence:double>>"


@pytest.fixture(scope="module")
def tables(spark):
    corpus = spark.createDataFrame([(*e, 10, True, 0) for e in EVENTS], "event_id long, shard_id string, content string, tags array<string>, token_count int, is_core boolean, tier int")
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.shuffle.partitions", "1")
    yield spark.createDataFrame(QUESTIONS, "query_id long, question string"), corpus.where("shard_id IS NOT NULL AND content IS NOT NULL"), F.lit(dt.datetime(2024, 2, 1))
    spark.conf.set("spark.sql.shuffle.partitions", before)


def rows(df):
    return {r.query_id: r for r in df.collect()}


def test_deterministic_models_answer_as_the_stages_do(tables):
    packets, calls = ask_models(*tables)
    got, plain, facts = rows(packets), rows(ask(*tables)), calls.collect()
    assert set(got) == {1, 2, 3, 4}
    for q, r in plain.items():
        mine = [f for f in facts if f.query_id == q]
        assert (got[q].n_routed, got[q].n_failed) == (r.n_routed, 0)
        assert sum(f.stage == "probe" for f in mine) == r.n_routed
        assert sum(f.stage == "recall" for f in mine) == got[q].n_recalls
        assert sum(f.stage == "synthesis" for f in mine) == (got[q].n_recalls > 1)
        if got[q].n_recalls == r.n_recalls:  # where no shard had to say that it knows nothing
            assert (got[q].summary, got[q].context) == (r.summary, r.context)
    assert got[1].n_recalls > 1 and got[1].n_recalls == plain[1].n_recalls
    assert got[1].key_claims[0].sources[0].startswith("harbour@S001:")
    assert all(f.attempts == 1 and f.input_tokens > 0 and f.output_tokens > 0 for f in facts)


def canned(fault=None):
    """A model that answers by the stage it is asked for; ``fault``: the stage that it fails, or "once" for probes that need the reminder."""

    def start():
        async def call(prompt):
            stage = "probe" if prompt.startswith("Does this shard know") else "recall" if prompt.startswith("What does this shard say") else "synthesis"
            if stage == fault or (fault == "once" and stage == "probe" and "could not be read" not in prompt):
                return json.dumps({"knows": True, "confidence": 7, "memory_type": "sure"})
            said = {
                "probe": {"knows": True, "confidence": 0.8, "memory_type": "direct", "answer_value": "high", "needs_recall": True, "relevant": ["1", "x"]},
                "recall": {"confidence": 0.8, "answer": "stub", "claims": [{"claim": "fact", "support": ["1"], "confidence": 0.8}, {"claim": "no support"}]},
                "synthesis": {"summary": "all", "key_claims": [{"claim": "c", "sources": ["harbour@S001:1"], "confidence": 0.9}, 3], "context": "ctx"},
            }[stage]
            return "Thinking first.\n```json\n" + json.dumps(said) + "\n```"

        return call

    return Calls(start, limit=2, base_ms=1)


def test_models_behind_calls(tables):
    model = canned()
    packets, calls = ask_models(*tables, Models(model, model, model))
    got, facts = rows(packets), calls.collect()
    assert (got[1].summary, got[1].context, got[1].n_failed) == ("all", "ctx", 0)
    assert [(c.claim, c.sources) for c in got[1].key_claims] == [("c", ["harbour@S001:1"])]
    assert got[1].caveats == [] and got[1].conflicts == []
    assert {f.attempts for f in facts} == {1}


def test_answers_that_do_not_fit_are_asked_for_again_and_then_left_out(tables):
    good = canned()
    once, calls = ask_models(*tables, Models(canned("once"), good, good))
    assert rows(once)[1].summary == "all"
    assert {(f.stage, f.attempts) for f in calls.collect()} == {("probe", 2), ("recall", 1), ("synthesis", 1)}

    none, calls = ask_models(*tables, Models(canned("probe"), good, good))
    r = rows(none)[1]
    assert (r.n_recalls, r.n_failed, r.summary) == (0, r.n_routed, "No relevant memory found in any consulted shard.")
    assert {f.stage for f in calls.collect()} == {"probe"}

    unmerged, calls = ask_models(*tables, Models(good, good, canned("synthesis")))
    r = rows(unmerged)[1]
    assert r.summary is None and r.context is None and r.n_failed == 1 and r.n_recalls > 1
    assert [f.attempts for f in calls.collect() if f.stage == "synthesis" and f.query_id == 1] == [2]


def test_stages_take_models_of_different_kinds(tables):
    mute = Deterministic(lambda p: F.lit(None).cast("string"))
    packets, _ = ask_models(*tables, Models(recall=mute))
    assert {r.n_recalls for r in packets.collect()} == {0}
    empty, calls = ask_models(tables[0].limit(0), tables[1], tables[2])
    assert empty.count() == calls.count() == 0
