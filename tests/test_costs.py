"""Costs of all stages in cells' open maps."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from mnemoflow.operators import costs


def plain(cell, system):
    """A cell's (input, output, latency, meta, mended) by hand."""
    s, i, o, t, text = cell
    try:
        meta = json.loads(text) if text is not None else None
    except ValueError:
        meta = None
    if s != system or (isinstance(meta, dict) and "finalCallInputTokens" in meta):
        return i, o, t, meta, False
    held = meta if isinstance(meta, dict) else {}
    packet = held.get("packetCost") if isinstance(held.get("packetCost"), dict) else {}
    cost = [packet.get(k, 0) if isinstance(packet.get(k, 0), int) else 0 for k in ("inputTokensEstimate", "outputTokensEstimate", "latencyMs")]
    last = [x or 0 for x in (i, o, t)]
    shares = {f"{who}{name}": v for who, vs in (("finalCall", last), ("pipeline", cost)) for name, v in zip(("InputTokens", "OutputTokens", "LatencyMs"), vs, strict=True)}
    return *[a + b for a, b in zip(last, cost, strict=True)], {**held, **shares}, True


CELLS = [
    ("m", 10, 2, 30, '{"packetCost":{"inputTokensEstimate":100,"outputTokensEstimate":20,"latencyMs":300},"keep":[1,{"a":null}]}'),
    ("m", 10, 2, 30, '{"finalCallInputTokens":4,"pipelineInputTokens":6,"finalCallOutputTokens":2,"finalCallLatencyMs":30}'),
    ("m", 10, 2, 30, '{"finalCallInputTokens":null}'),
    ("m", None, None, None, None),
    ("m", 1, 1, 1, "[1,2]"),
    ("m", 1, 1, 1, "{broken"),
    ("m", 1, 1, 1, '{"packetCost":"none","pipelineLatencyMs":9}'),
    ("m", 1, 1, 1, '{"packetCost":{"latencyMs":5}}'),
    ("other", 1, 1, 1, '{"packetCost":{"latencyMs":5}}'),
    (None, 1, 1, 1, None),
]


def test_cells_are_mended_once(spark):
    kind = "id int, system string, input_tokens long, output_tokens long, latency_ms int, meta string"
    cells = spark.createDataFrame([(k, *c) for k, c in enumerate(CELLS)], kind).withColumn("meta", F.try_parse_json("meta"))
    mended = costs.mend(cells, "m")
    assert mended.schema["latency_ms"].dataType.simpleString() == "int"
    told = lambda df: {r.id: (r.input_tokens, r.output_tokens, r.latency_ms, json.loads(r.j) if r.j is not None else None, r.mended) for r in df.withColumn("j", F.to_json("meta")).collect()}
    got = told(mended)
    assert got == {k: plain(c, "m") for k, c in enumerate(CELLS)}
    again = told(costs.mend(mended.drop("mended"), "m"))
    assert {k: v[:4] for k, v in again.items()} == {k: v[:4] for k, v in got.items()} and not any(v[4] for v in again.values())
    assert [r.id for r in costs.unbalanced(cells).collect()] == [2]
    assert [r.id for r in costs.unbalanced(mended).collect()] == [2]


def test_calls_by_stage(spark):
    calls = spark.createDataFrame([(1, "probe", 2, 10, 1), (1, "probe", 1, 5, 1), (1, "recall", 1, 7, 3), (2, "synthesis", 1, 9, 9)], "query_id long, stage string, attempts int, input_tokens long, output_tokens long")
    got = {r.query_id: r.asDict() for r in costs.by_stage(calls).collect()}
    assert got[1] == {"query_id": 1, "calls": 4, "input_tokens": 22, "output_tokens": 5, "probe_tokens": 17, "recall_tokens": 10, "synthesis_tokens": 0}
    assert got[2]["synthesis_tokens"] == 18
