"""Runs over long-context sets, settings, stable JSON and bridges put into an order, against cases told by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mnemoflow.config import DEFAULT, Config
from mnemoflow.functions import model_output
from mnemoflow.operators import folds, retrieval
from mnemoflow.plans import haystack

ROWS = [
    {"input": "Mary went home. The cat is in the hall. It sat.", "target": "hall", "question": "Where is the cat?"},
    {"input": "John took the milk. The dog is in the park.", "target": "park", "question": "Where is the dog?"},
    {"input": "Nobody came.", "target": "roof", "question": "Where is the bird?"},
]


class Reader:
    """Says the place that its context names and cites the event's line."""

    def complete(self, asked):
        place, event = (F.regexp_extract("prompt", r"\[([^\]]+)\] The \w+ is in the (\w+)", k) for k in (2, 1))
        return asked.select("key", F.concat(F.lit("ANSWER: "), place, F.lit("\nCITATIONS: "), event).alias("response"))


def test_each_question_reads_its_own_shard(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text("".join(json.dumps(r) + "\n" for r in ROWS))
    out, waves = str(tmp_path / "rows"), []
    kind = "system string, task string, length string, query_id string"

    def read():
        return spark.read.parquet(out) if waves else spark.createDataFrame([], kind)

    def write(rows):
        rows.write.mode("append").parquet(out)
        waves.append(1)

    mute = lambda queries, own: queries.where("query_id = 'b1-0'").select("query_id", F.lit("HALL.").alias("chosen"), F.array().cast("array<string>").alias("cited"), F.lit(3).alias("input_tokens"))
    systems = {"reader": haystack.long_context(Reader(), 4096), "mute": mute}
    first = haystack.sweep(spark, {("1", "4K"): str(path)}, systems, write, read)
    got = {r.system: r for r in first.collect()}
    assert (got["reader"].n, got["mute"].n, got["mute"].errors) == (3, 3, 2)
    by = {(r.system, r.query_id): r for r in read().collect()}
    assert by["reader", "b1-0"].correct and by["reader", "b1-0"].citation_recall == 1.0 and by["reader", "b1-1"].chosen == "park"
    assert not by["reader", "b1-2"].correct and by["mute", "b1-1"].error == "no answer" and by["mute", "b1-0"].correct
    haystack.sweep(spark, {("1", "4K"): str(path)}, systems, write, read)
    assert read().count() == 6
    with pytest.raises(ValueError, match="lengths"):
        haystack.sweep(spark, {("1", "5K"): str(path)}, systems, write, read)
    with pytest.raises(ValueError, match="sample"):
        haystack.sweep(spark, {}, systems, write, read, sample=0)


def test_settings_fall_back():
    said = {"MNEMOFLOW_FLOOR_K": "0", "MNEMOFLOW_EXPAND_MAX": " 12abc", "MNEMOFLOW_ENTITY_K": "  ", "MNEMOFLOW_ENTITY_MAX": "many", "MNEMOFLOW_ACCURACY": "0.9"}
    got = Config.read(said)
    assert (got.floor_k, got.expand_max, got.entity_k, got.entity_max, got.accuracy) == (0, 12, DEFAULT.entity_k, DEFAULT.entity_max, 0.9)
    assert Config.read({}) == DEFAULT


def test_json_keys_stand_in_order(spark):
    said = ['{"b": 1, "a": {"z": [{"y": null, "x": "q"}], "c": true}}', "[2, 1]", "no", None, '{"a": 1, "a": 2}']
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, s string").select("i", model_output.stable_json(F.col("s")).alias("j"))
    assert [r.j for r in rows.orderBy("i").collect()] == ['{"a":{"c":true,"z":[{"x":"q","y":null}]},"b":1}', "[2,1]", None, None, None]


def test_entities_of_each_event_bridge_to_others(spark):
    events = [(1, "s", "Mary got the milk"), (2, "s", "Mary went to the garden"), (3, "s", "John-Paul sat"), (4, "s", "a xJohn-Paul sang"), (5, "t", "Mary slept"), (6, "s", "then John-Paul met Mary")]
    corpus = spark.createDataFrame(events, "event_id long, shard_id string, content string")
    base = spark.createDataFrame([(9, 1, 1), (9, 3, 2)], "query_id long, event_id long, rank int")
    questions = spark.createDataFrame([(9, "?")], "query_id long, question string")
    groups = retrieval.entity_groups(corpus, base, questions)
    by = {}
    for r in groups.orderBy("anchor_rank", "rank").collect():
        by.setdefault(r.anchor, []).append(r.event_id)
    assert by == {1: [6, 2], 3: [6]}
    got = [r.event_id for r in folds.expand_shards(base, groups, 24, 6).orderBy("place").collect()]
    assert got == folds.expand([1, 3], [(1, [6, 2]), (3, [6])], 24, 6) == [1, 6, 2, 3]
