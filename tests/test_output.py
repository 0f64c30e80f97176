"""What models say, prompts, contexts, batches, evidence: against fixtures told by hand."""

from __future__ import annotations

import json

import pytest
from pyspark.sql import functions as F

from mnemoflow.functions import model_output, prompts, text
from mnemoflow.operators import agent, context, report, retrieval, validate
from mnemoflow.plans import answer


def column(spark, values, make):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(values)], "i int, v string")
    return [r.x for r in rows.select("i", make(F.col("v")).alias("x")).orderBy("i").collect()]


def test_json_in_answers(spark):
    said = [
        '{"a": 1}', "```json\n[1, 2]\n```", 'prose {"a": "} \\" {"} more', "no json", None, "{ {broken} then [1]", 'half {"a": 1', "```\nnot json\n``` but [3]", "7", "", '] [ "', "[" * 300,
    ]
    got = column(spark, said, model_output.extract_json)
    assert got == ['{"a": 1}', "[1, 2]", '{"a": "} \\" {"}', None, None, None, None, "[3]", "7", None, None, None]


def test_conforming_takes_the_last_element_that_has_all(spark):
    got = column(spark, ['{"a": 1, "b": "x"}', '{"b": "x"}', '[{"a": 1}, {"a": 2, "b": "y"}, {"b": "z"}]', "[]", "7", None], lambda v: model_output.conforming(v, "a INT, b STRING", ["a"]))
    assert [r and (r.a, r.b) for r in got] == [(1, "x"), None, (2, "y"), None, None, None]


def test_claims_that_are_whole(spark):
    (got, none, nil) = column(spark, ['[{"claim": "a", "support": ["x"], "confidence": 0.5}, 7, {"claim": "b"}, {"claim": "c", "support": [], "confidence": "no"}]', "no", None], model_output.tolerant_claims)
    assert [c.claim for c in got] == ["a"] and none == [] and nil == []


def test_fences(spark):
    assert column(spark, ["```json\n{}\n```", "```\na\nb", "plain ```x```", "```x```", " ```py\nq\n``` "], model_output.unfence) == ["{}", "a\nb", "plain ```x```", "", "q"]


def test_sources_and_orders(spark):
    assert column(spark, ["s@S1:e1", "s@S1", "s:", "a:b: c "], model_output.source_event) == ["e1", None, None, "c"]
    row = spark.range(1).select(context.retrieval_order(F.array(F.lit("b"), F.lit("a"), F.lit("b")), F.array(F.lit("a"), F.lit("c"))).alias("o"), context.retrieval_order(F.lit(None).cast("array<string>"), F.array(F.lit("c"))).alias("p")).first()
    assert row.o == ["b", "a", "c"] and row.p == ["c"]


class Scripted:
    """A model that answers by what a prompt holds, and faultily at first where it is told to."""

    def __init__(self, replies):
        self.replies = replies

    def complete(self, asked):
        def say(prompt):
            for key, (first, then) in self.replies.items():
                if key in prompt:
                    return then if "could not be read" in prompt else first
            return "?"

        speak = F.udf(say, "string")
        return asked.select("key", speak("prompt").alias("response"))


def test_a_model_is_asked_once_more(spark):
    asked = spark.createDataFrame([("1", "alpha"), ("2", "beta"), ("3", "gamma")], "key string, prompt string")
    model = Scripted({"alpha": ('{"a": 1}', "-"), "beta": ("oops", 'so: {"a": 2}'), "gamma": ("no", "never")})
    got = {r.key: (r.data and r.data.a, r.attempts) for r in answer.complete_valid(model, asked, "a INT", ["a"], "Thing").collect()}
    assert got == {"1": (1, 1), "2": (2, 2), "3": (None, 2)}


def test_answers_cite_what_was_packed_if_they_cite_nothing(spark):
    questions = spark.createDataFrame([(1, "which", ["x", "y"]), (2, "what", None), (3, "who", ["x"])], "query_id long, question string, options array<string>")
    contexts = spark.createDataFrame([(1, "ctx", ["e1"], ["e9"]), (2, "ctx", [], ["e9"]), (3, "ctx", ["e1"], [])], "query_id long, context string, packed array<string>, retrieved array<string>")
    model = Scripted({"which": ("ANSWER: 2\nCITATIONS: none", ""), "what": ("ANSWER: blue\nCITATIONS: none", ""), "who": ("ANSWER: 7\nCITATIONS: none", "")})
    got = {r.query_id: (r.chosen_option, r.chosen_answer, r.cited) for r in answer.answer(questions, contexts, model).collect()}
    assert got == {1: (2, None, ["e1"]), 2: (None, "blue", ["e9"]), 3: (None, None, [])}


def test_prompts_number_their_options(spark):
    row = spark.range(1).select(prompts.choice(F.lit("q?"), F.array(F.lit("a"), F.lit("b")), F.lit("c")).alias("p"), prompts.stage("probe", F.lit("s"), F.lit("q"), F.lit("body")).alias("s")).first()
    assert "1. a\n2. b" in row.p and "1 to 2" in row.p and row.s.endswith("SHARD: s\nQUERY: q\n\nbody")


def test_contexts_keep_to_their_budget(spark):
    packets = spark.createDataFrame([(1, "h" * 40), (2, "h" * 40)], "query_id long, header string")
    orders = spark.createDataFrame([(1, 0, "a"), (1, 1, "gone"), (1, 2, "b"), (1, 3, "c")], "query_id long, place int, event_id string")
    corpus = spark.createDataFrame([("a", "x" * 15), ("b", "y" * 35), ("c", "z")], "event_id string, content string")
    got = {r.query_id: r for r in context.assemble(packets, orders, corpus, 22).collect()}
    assert got[1].packed == ["a"] and got[1].context_tokens == 15 and got[2].packed == [] and "(none)" in got[2].context


def test_batches_with_faults_fail(spark):
    kind = "id string, category string, options array<string>, correctOption int"
    good = spark.createDataFrame([("q1", "adversarial", ["It was rejected", "never proposed", "DEFERRED", "x"], 4)], kind)
    assert validate.check_batch(good, 1, 4).count() == 1
    bad = spark.createDataFrame([("q2", "adversarial", ["a", "a", "b"], 9), ("q3", None, None, None)], kind)
    faults = {r.id: r.faults for r in validate.query_faults(bad, 4).collect()}
    assert faults == {"q2": ["option_count", "correct_option", "duplicate_option", "too_few_negatives"], "q3": ["option_count", "correct_option"]}
    with pytest.raises(ValueError, match="q2"):
        validate.check_batch(bad, 2, 4)
    with pytest.raises(ValueError, match="1 queries, 2 asked"):
        validate.check_batch(good, 2, 4)


def test_merges_fail_on_repeated_ids(spark):
    kind = "id string, category string, options array<string>, correctOption int"
    a, b = (spark.createDataFrame([(i, None, ["x"], 1)], kind) for i in ("q2", "q1"))
    assert [r.id for r in validate.merge_queries([a, b]).collect()] == ["q1", "q2"]
    with pytest.raises(ValueError, match="q2"):
        validate.merge_queries([a, a])
    phase = spark.createDataFrame([("e1", "s", "abcde", 9, False, 2)], "id string, shardId string, content string, tokenCount long, isCore boolean, tier int")
    merged, counts = validate.merge_phases({"p1": phase})
    assert tuple(merged.first()) == ("e1", "s", "abcde", 2, True, 0)
    c = counts.first()
    assert (c.n_events, c.tokens, c.core_fixed, c.tier_fixed, c.tokens_fixed) == (1, 2, 1, 1, 1)
    with pytest.raises(ValueError, match="e1"):
        validate.merge_phases({"p1": phase, "p2": phase})


def test_reranking_keeps_the_order_of_ties(spark):
    ranked = spark.createDataFrame([(1, k, k) for k in range(1, 9)], "query_id long, event_id long, rank int")
    scorer = lambda pool: pool.where("event_id IN (3, 6)").select("query_id", "event_id", F.lit(0.5).alias("score"))
    got = retrieval.rerank_pool(ranked, 3, scorer).orderBy("rank").collect()
    assert [(r.event_id, r.rank) for r in got] == [(3, 1), (6, 2), (1, 3)]
    assert [r.event_id for r in retrieval.rerank_pool(ranked, 2).orderBy("rank").collect()] == [1, 2]


def test_neighbours_do_not_depend_on_batches(spark):
    rows = [(3, [0.5000001]), (2, [0.50000009]), (1, [0.50000005])]
    asked = spark.createDataFrame([(9, [1.0])], "query_id long, vec array<double>")
    for parts in (1, 3):
        vectors = spark.createDataFrame(rows, "event_id long, vec array<double>").repartition(parts)
        assert [r.event_id for r in retrieval.knn(vectors, asked, 2).orderBy("rank").collect()] == [1, 2]


TURNS = [
    ("s", "t1", 1, "Turn 1 User: the password reset came on March 1, 2024"),
    ("s", "t2", 2, "Turn 2 Assistant: weather is fine"),
    ("s", "t3", 3, "Turn 3 User: my question about the invoice on March 5, 2024"),
    ("s", "t4", 4, "Turn 4 User: another invoice, not the same"),
    ("s", "t5", 5, "Turn 5 Assistant: the invoice of April 9, 2024"),
]


def test_capsules_by_intent(spark):
    events = spark.createDataFrame(TURNS, "shard_id string, event_id string, turn long, content string")
    asks = [
        (1, "How many days between when the password reset came and when the invoice question came?"),
        (2, "How many different invoices did I mention?"),
        (3, "Why did this invoice matter?"),
        (4, "Tell the weather"),
        (5, "Summarize the invoice history"),
        (6, "Which statement is correct, did they contradict the invoice?"),
    ]
    asked = spark.createDataFrame([(q, "s", t) for q, t in asks], "query_id long, shard_id string, query string")
    got = {r.query_id: r.capsule.split("\n") for r in agent.capsules(events, asked).collect()}
    assert sorted(got) == [1, 2, 5, 6]  # a reason that can't be known and a plain question get none
    assert got[1][0].startswith("Temporal") and got[1][1].startswith("- Temporal calculation: from March 1, 2024 [t1]") and got[1][1].endswith("= 4 days.")
    assert all("assistant:" not in line for line in got[2])
    assert [line.split("]")[0] for line in got[5][1:]] == ["- [t1", "- [t3", "- [t4", "- [t5"]
    assert got[6][0].startswith("Contradiction") and any("[t4]" in line for line in got[6])


def test_roles_need_different_events(spark):
    events = agent.scored(spark.createDataFrame(TURNS, "shard_id string, event_id string, turn long, content string"), text.strings(["invoice", "password"]))
    anchored = agent.anchors(events, ["shard_id"]).join(events.select("shard_id", "event_id", "content"), ["shard_id", "event_id"])
    ask = lambda a, b: spark.createDataFrame([("s", a, b)], "shard_id string, left array<string>, right array<string>")
    one = agent.segment_pair(anchored, ask(["invoice"], ["question"]), ["shard_id"]).first()
    assert (one.first.event_id, one.second.event_id) == ("t1", "t3") or (one.first.event_id, one.second.event_id) == ("t3", "t5")
    two = agent.segment_pair(anchored, ask(["password"], ["invoice"]), ["shard_id"]).first()
    assert (two.first.event_id, two.second.event_id, two.days) == ("t1", "t3", 4)


def test_runs_keep_their_configuration(spark, tmp_path):
    summary = spark.createDataFrame([("a", 8192, 1000, 0.5), ("b", 8192, 1000, 0.25)], "system string, model_context long, corpus_size long, accuracy double")
    report.write_run(spark, str(tmp_path), {"b": 1, "a": [2]}, summary)
    assert report.read_config(spark, str(tmp_path)) == {"a": [2], "b": 1} and report.read_config(spark, f"{tmp_path}/none") == {}
    line = next((tmp_path / "config").glob("part-*")).read_text()
    assert line.strip() == json.dumps({"a": [2], "b": 1})
    row = report.pivoted(summary).first()
    assert (row.a, row.b) == (0.5, 0.25)


def test_headline_lines(spark):
    table = spark.createDataFrame([("a", 4, 0.5, 0.25, 100.0, 2000.0, 2.0)], "system string, n long, accuracy double, mean_f1 double, mean_input_tokens double, mean_latency_ms double, f1_ratio double")
    ci = spark.createDataFrame([("a", 0.2, 0.8)], "system string, ci_low double, ci_high double")
    assert report.headline_lines(table, ci, "a")[2] == "| **a** | 2/4 (50%) | [20, 80]% | 0.250 | 2 s | 100 |"
