"""Calls in flight, retries and order-free answers."""

from __future__ import annotations

import asyncio

import pytest
from pyspark.sql import functions as F

from mnemoflow.sources.model import Calls, Deterministic

KIND = "key string, prompt string"


def counting():
    """Tells how many calls are in flight; the first of them is the last to end."""
    flying, first = [0], [True]

    async def call(prompt):
        flying[0] += 1
        seen = flying[0]
        slow, first[0] = first[0], False
        await asyncio.sleep(0.2 if slow else 0.001)
        flying[0] -= 1
        return str(seen)

    return call


def test_no_more_calls_than_the_limit(spark):
    asked = spark.createDataFrame([(str(k), "p") for k in range(60)], KIND).coalesce(1)
    for limit in (1, 3, 100):
        got = Calls(counting, limit=limit).complete(asked).collect()
        assert sorted(int(r.key) for r in got) == list(range(60))
        most = max(int(r.response) for r in got)
        assert most == min(limit, 60)
        assert (got[0].key == "0") == (limit == 1)  # nothing waits for the slow first one


def faulty():
    tried = {}

    async def call(prompt):
        tried[prompt] = tried.get(prompt, 0) + 1
        kind, _, times = prompt.partition(":")
        if tried[prompt] <= int(times or 0):
            raise {"busy": OSError("HTTP 503"), "no": ValueError("HTTP 401"), "slow": TimeoutError()}[kind]
        if kind == "hangs":
            await asyncio.sleep(60)
        return "fine"

    return call


def test_faults_that_pass_are_tried_again(spark):
    asked = spark.createDataFrame([("a", "busy:2"), ("b", "busy:9"), ("c", "no:1"), ("d", "slow:1"), ("e", "hangs"), ("f", None)], KIND)
    got = {r.key: (r.response, r.attempts, r.error) for r in Calls(faulty, base_ms=1, attempts=3, timeout_s=0.2).complete(asked).collect()}
    assert got == {"a": ("fine", 3, None), "b": (None, 3, "HTTP 503"), "c": (None, 1, "HTTP 401"), "d": ("fine", 2, None), "e": (None, 3, "timed out"), "f": ("fine", 1, None)}
    assert Calls(faulty).complete(asked.limit(0)).collect() == []
    with pytest.raises(ValueError, match="limit"):
        Calls(faulty, limit=0)


def test_deterministic_answers(spark):
    model = Deterministic(lambda p: F.upper(p))
    assert [tuple(r) for r in model.complete(spark.createDataFrame([("k", "yes")], KIND)).collect()] == [("k", "YES")]
