from __future__ import annotations

import datetime as dt
import math

import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from mnemoflow import queries
from mnemoflow.functions import dates, maths, text
from mnemoflow.operators import agent, answers, evaluate, fillers, folds, rank, resample, router
from mnemoflow.sources import views


def one(spark, column, **values):
    row = spark.createDataFrame([tuple(values.values())] if values else [(0,)], list(values) or ["x"])
    return row.select(column.alias("v")).first().v


@pytest.mark.parametrize(
    ("cited", "relevant", "expected"),
    [([], [], (1, 1, 1)), ([], ["r"], (0, 0, 0)), (["c"], [], (0, 1, 0)), (["a", "b", "a"], ["b", "c"], (0.5, 0.5, 0.5))],
)
def test_citation_scores(spark, cited, relevant, expected):
    array = lambda xs: F.array(*map(F.lit, xs)).cast("array<string>")
    assert tuple(one(spark, maths.citation_scores(array(cited), array(relevant)))) == expected


@pytest.mark.parametrize(("a", "b", "expected"), [("authentication", "auth", True), ("agile", "ag", False), ("ag", "ag", True), ("config", "configuration", True), ("abcd", "abce", False)])
def test_prefix_match(spark, a, b, expected):
    assert one(spark, text.prefix_match(F.lit(a), F.lit(b))) is expected


def test_normalise(spark):
    assert one(spark, answers.normalise(F.lit("  The Kitchen. "))) == "kitchen"


def test_citations(spark):
    assert one(spark, answers.citations(F.lit("[e1], (e2); **e3**, none, e0009]."))) == ["e1", "e2", "e3", "e0009"]


@pytest.mark.parametrize(
    ("output", "chosen"),
    [("ANSWER: 1 no ANSWER: 3", 3), ("ANSWER: 9", None), ("Option 2 it is", 2), ("out of 12 I say 4", 4), ("nothing", None), ("", None)],
)
def test_choice(spark, output, chosen):
    assert one(spark, answers.parse_choice(F.lit(output), F.lit(5)))["chosen"] == chosen


@pytest.mark.parametrize(("output", "chosen"), [("ANSWER: the barn\nANSWER: no", "the barn"), ("\nCITATIONS: e1\n a guess \n", "a guess"), ("", None)])
def test_free_form(spark, output, chosen):
    assert one(spark, answers.parse_free(F.lit(output)))["chosen"] == chosen


def test_correct(spark):
    accepted = F.array(F.lit("The Kitchen"), F.lit("pantry"))
    assert one(spark, answers.is_correct(F.lit(" kitchen! "), accepted)) is True
    assert one(spark, answers.is_correct(F.lit(None).cast("string"), accepted)) is False


@pytest.mark.parametrize(("pct", "name"), [(54.9, "continue"), (55, "watch"), (65, "split_candidate"), (75, "freeze_recommended"), (85, "danger_zone"), (100, "danger_zone")])
def test_health(spark, pct, name):
    assert one(spark, maths.health(F.lit(float(pct)))) == name


def test_dates(spark):
    phrases = one(spark, dates.date_phrases(F.lit("on March 3, 2024 and 2024-03-12; Feb-31-2023")))
    assert phrases == ["March 3, 2024", "Feb 31 2023", "2024-03-12"]
    assert str(one(spark, dates.parse_date(F.lit("Feb 31 2023")))) == "2023-03-03"
    assert str(one(spark, dates.parse_date(F.lit("March 3, 2024")))) == "2024-03-03"
    assert one(spark, dates.parse_date(F.lit("soon"))) is None


def test_sizes(spark):
    assert [one(spark, text.human_size(F.lit(x))) for x in ("8K", "1.5m", "2B", "7", "x")] == [8000, 1_500_000, 2_000_000_000, 7, None]


def test_truncate_and_tokens(spark):
    assert one(spark, text.truncate(F.lit("abcdef"), 4)) == "abc…"
    assert one(spark, text.estimate_tokens(F.lit("abcde"))) == 2
    assert one(spark, text.estimate_tokens(F.lit(None).cast("string"))) == 0


def test_turns(spark):
    talk = "[March-3-2024 | Turn 1] User: hi\n[March-4-2024 | Turn 2] Assistant: yes"
    parts = one(spark, text.split_turns(F.lit(talk)))
    assert parts == ["[March-3-2024 | Turn 1] User: hi", "[March-4-2024 | Turn 2] Assistant: yes"]
    assert one(spark, text.event_role(F.lit(parts[1]))) == "assistant"
    assert str(one(spark, dates.turn_time(F.lit(parts[0])))) == "2024-03-03"
    assert one(spark, text.split_turns(F.lit("Turn 1 User: alone"))) == []


def test_stream_equals_the_column(spark):
    stream = folds.draws(42)
    expected = [next(stream) for _ in range(50)]
    got = [r.x for r in spark.range(1, 51).select(maths.mulberry32(F.lit(42), F.col("id")).alias("x")).orderBy("id").collect()]
    assert got == expected


def test_hash_equals_the_column(spark):
    for word in ("", "a", "filler-7"):
        assert one(spark, folds.fnv1a_column(F.lit(word))) == folds.fnv1a(word)


@given(st.lists(st.integers(), unique=True), st.integers(0, 2**32 - 1))
def test_shuffle_is_a_permutation(items, seed):
    once = folds.shuffled(items, seed)
    assert sorted(once) == sorted(items) and once == folds.shuffled(items, seed)


@pytest.mark.parametrize(
    ("base", "groups", "most", "per", "expected"),
    [
        (["fa", "e1", "ta"], [("e1", ["e1", "e2", "e3"])], 5, 9, ["fa", "e1", "e2", "e3", "ta"]),
        (["a1", "b1"], [("a1", ["a1", "a2", "a3"]), ("b1", ["b2"])], 4, 9, ["a1", "a2", "a3", "b1"]),
        (["a1", "b1"], [("a1", ["a2", "a3", "a4"]), ("b1", ["b2", "b3"])], 10, 2, ["a1", "a2", "a3", "b1", "b2", "b3"]),
        (["a1"], [("a1", ["a2"])], 1, 9, ["a1"]),
        (["a1"], [("zz", ["a2"])], 9, 9, ["a1"]),
        (["a1"], [("a1", ["x"]), ("a1", ["y"])], 9, 9, ["a1", "y", "x"]),
    ],
)
def test_expansion(base, groups, most, per, expected):
    assert folds.expand(base, groups, most, per) == expected


def test_claims_merge_into_the_first_that_contains_them():
    merged = folds.merge_claims([("Rain fell.", ["a"], 0.6), ("rain fell. It was cold", ["b"], 0.9), ("Sun", ["c"], 0.7)])
    assert merged == [("Rain fell.", ["a", "b"], 0.9), ("Sun", ["c"], 0.7)]


def test_sampler_keeps_core_and_budget(spark):
    rows = [(1, 100, True), (2, 200, True)] + [(10 + k, 100, False) for k in range(50)]
    corpus = spark.createDataFrame(rows, "event_id long, token_count long, is_core boolean")
    got = folds.sample_corpus(corpus, 7, [1000, 200]).collect()
    ids = {r.event_id for r in got if r.target == 1000}
    assert {1, 2} <= ids and len(ids) == 9
    assert [r.ordinal for r in got if r.target == 200] == [-1]  # the core alone is larger


def test_backfill(spark):
    base = spark.createDataFrame([(1, 5, 1), (1, 6, 2)], "query_id long, event_id long, rank int")
    ranked = spark.createDataFrame([(1, 6, 1), (1, 7, 2), (1, 8, 3), (1, 9, 4), (2, 3, 1)], "query_id long, event_id long, rank int")
    got = {(r.query_id, r.rank): r.event_id for r in rank.backfill(base, ranked, ["query_id"], 4).collect()}
    assert got == {(1, 1): 5, (1, 2): 6, (1, 3): 7, (1, 4): 8, (2, 1): 3}
    assert rank.backfill(base, ranked, ["query_id"], 0).count() == 2


def test_aggregate_of_nothing(spark):
    kind = "system string, correct boolean, citation_precision double, citation_recall double, input_tokens long, latency_ms long, error string"
    assert evaluate.aggregate(spark.createDataFrame([], kind), ["system"]).collect() == []


def test_mcnemar(spark):
    rows = [(s, str(k), c) for k in range(20) for s, c in (("a", k < 18), ("b", k >= 18))]
    got = evaluate.mcnemar(spark.createDataFrame(rows, "system string, q string, correct boolean"), "a", "b", ["q"]).first()
    assert (got.a_only, got.b_only, got.winner) == (18, 2, "a") and got.p < 0.05
    same = spark.createDataFrame([(s, "1", True) for s in "ab"], "system string, q string, correct boolean")
    assert evaluate.mcnemar(same, "a", "b", ["q"]).first().p == 1.0


def test_router_prefers_prefix_matches_and_gives_reasons(spark):
    questions = spark.createDataFrame([(1, "How does authentication work?")], "query_id long, question string")
    entries = spark.createDataFrame(
        [("a", "n", "d", ["auth"], "s", "active", "fresh", 80.0), ("b", "n", "d", ["random", "thing"], "s", "frozen", "stale", 10.0)],
        "id string, name string, description string, tags array<string>, summary_short string, status string, staleness string, fullness_pct double",
    ).withColumn("updated_at", F.lit(None).cast("timestamp"))
    got = router.candidates(questions, entries, F.lit("2024-01-01").cast("timestamp")).collect()
    assert [r.shard_id for r in got] == ["a"]  # the other has a score below 0 and isn't active
    assert got[0].reasons == ["tagOverlap=1", "fullness=80.0% -0.5"] and got[0].score == 1.5


def test_router_choice_is_recalled_though_its_probe_was_rejected(spark):
    probed = spark.createDataFrame(
        [(1, "a", False, 0.0, "none", "none", False, []), (1, "b", True, 0.9, "direct", "high", True, [3])],
        "query_id long, shard_id string, knows boolean, confidence double, memory_type string, answer_value string, needs_recall boolean, relevant array<long>",
    )
    routed = spark.createDataFrame([(1, "a", 1), (1, "b", 2)], "query_id long, shard_id string, rank int")
    assert [r.shard_id for r in router.recall_targets(probed, routed).orderBy("place").collect()] == ["a", "b"]


def test_dated_pair(spark):
    rows = [("s", f"d{k}", t, c) for k, (t, c) in enumerate([(1, "Turn 1 User: launch on March 10, 2024"), (2, "Turn 2 User: launch review on March 12, 2024"), (3, "Turn 3 User: lunch on May 1, 2024"), (4, "Turn 4 User: none")])]
    events = agent.scored(spark.createDataFrame(rows, "shard_id string, event_id string, turn long, content string"), text.strings(["launch"]))
    got = agent.top_pair(agent.anchors(events, ["shard_id"]), ["shard_id"]).first()
    assert (got.days, got.first.event_id, got.second.event_id) == (2, "d0", "d1")


def test_fillers_are_deterministic_and_change_numbers():
    seed = "We paid $40K for 12 engineers, 30% up since Jan 3 and 2024-02-01, on Stripe v1 with P0."
    once = fillers.mutate(seed, folds.draws(5))
    assert once == fillers.mutate(seed, folds.draws(5)) and once != seed and "Stripe" not in once
    assert fillers.mutate("plain words", folds.draws(5)) == "plain words"
    assert "2024-02-01" in once and fillers.mutate("on 2026-02-01", folds.draws(5)) != "on 2026-02-01"  # years that fillers move


def test_variants_share_the_stream_of_their_seed(spark):
    text = "We paid $40K on 2026-03-01"
    rows = [("f2-a7", "s", text, ["t"], "2026-01-05T10:00:00Z"), ("b", "s", text, ["t"], None)]
    seeds = spark.createDataFrame(rows, "event_id string, shard_id string, content string, tags array<string>, timestamp string")
    got = {r.event_id: r for r in fillers.variants(seeds, 2, 42, 3).collect()}
    assert sorted(got) == ["f3-a7-v000", "f3-a7-v001", "f3-b-v000", "f3-b-v001"]
    stream = folds.draws(folds.fnv1a("f2-a7") ^ 42)
    for k in range(2):
        r = got[f"f3-a7-v00{k}"]
        assert r.content == fillers.mutate(text, stream) and r.tags == ["t"] and not r.is_core
        shift = math.floor((next(stream) - 0.5) * 120)
        assert r.timestamp == (dt.datetime(2026, 1, 5, 10) + dt.timedelta(days=shift)).strftime("%Y-%m-%dT%H:%M:%S.000Z")
    assert got["f3-b-v000"].timestamp is None


def plain_interval(ys, rounds, seed=42):
    """The generator run step by step, one resample after the other."""
    state, means = seed, []
    for _ in range(rounds):
        hits = 0
        for _ in ys:
            state = (state + 0x6D2B79F5) & 0xFFFFFFFF
            t = ((state ^ (state >> 15)) * (state | 1)) & 0xFFFFFFFF
            t ^= (t + (((t ^ (t >> 7)) * (t | 61)) & 0xFFFFFFFF)) & 0xFFFFFFFF
            hits += ys[int((t ^ (t >> 14)) / 4294967296 * len(ys))]
        means.append(hits / len(ys))
    means.sort()
    return len(ys), round(means[int(0.025 * rounds)], 6), round(means[int(0.975 * rounds)], 6)


def test_full_bootstrap_takes_all_resamples(spark, tmp_path):
    lines = [(o, o * 7 % 5 + 1, 1.0, o * 31 % 97, o % 4 + 1) for o in range(1, 160)]
    spark.createDataFrame(lines, "l_orderkey long, l_suppkey long, l_quantity double, l_partkey long, l_linenumber long").write.parquet(f"{tmp_path}/lineitem.parquet")
    key = lambda r: (r.system, r.model_context, r.corpus_size)
    groups = {}
    for r in sorted(evaluate.current_cells(views.cells(spark, str(tmp_path))).collect(), key=lambda r: (r.query_id, r.trial)):
        groups.setdefault(key(r), []).append(int(r.correct))
    got = {key(r): (r.n, r.ci_low, r.ci_high) for r in queries.QUERIES["bootstrap_ci_full"](spark, str(tmp_path)).collect()}
    assert got == {k: plain_interval(ys, 10_000) for k, ys in groups.items()}
    assert got != {k: plain_interval(ys, 200) for k, ys in groups.items()}


def test_bootstrap_of_several_blocks_slices_and_null_keys(spark, monkeypatch):
    """Small blocks, slices and chunks, so that a group is several of each; null keys and null outcomes."""
    monkeypatch.setattr(resample, "BLOCK_WORDS", 2)
    monkeypatch.setattr(resample, "DRAWS", 100)
    monkeypatch.setattr(resample, "_CHUNK", 32)
    rows = [(None if o % 3 == 0 else f"s{o % 3}", f"q{o % 50:03}", o // 50, None if o % 11 == 0 else o * 7 % 5 < 2) for o in range(700)]
    cells = spark.createDataFrame(rows, "system string, query_id string, trial int, correct boolean").repartition(7)
    groups = {}
    for s, _, _, y in sorted(rows, key=lambda r: (r[1], r[2])):
        groups.setdefault(s, []).append(int(bool(y)))
    got = {r.system: (r.n, r.ci_low, r.ci_high) for r in evaluate.bootstrap(cells, ["system"], 60).collect()}
    assert got == {s: plain_interval(ys, 60) for s, ys in groups.items()}
    assert evaluate.bootstrap(cells.where("false"), ["system"], 60).count() == 0
