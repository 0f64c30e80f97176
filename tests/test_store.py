from __future__ import annotations

import json

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from mnemoflow.operators import commit
from mnemoflow.plans import bench
from mnemoflow.sources import plugins, store, views
from mnemoflow.streaming import ingest


def test_missing_tables_are_empty(spark, tmp_path):
    assert store.read_json(spark, str(tmp_path / "none.jsonl"), store.EVENT).count() == 0
    assert store.MemoryStore(spark, str(tmp_path)).read("chronicle", "a STRING").count() == 0


def test_strict_and_tolerant_readers(spark, tmp_path):
    path = tmp_path / "r.jsonl"
    rows = [{"system": "a", "corpusSize": 1, "modelContext": 1, "trial": 0, "queryId": "q", "correct": c} for c in (False, True)]
    path.write_text("\n".join(map(json.dumps, rows)) + "\n{broken\n\n")
    assert [r.correct for r in store.read_results(spark, str(path)).collect()] == [True]  # the last of a cell's rows
    with pytest.raises(Exception, match="MALFORMED|FAILFAST|Malformed"):
        store.read_json(spark, str(path), store.CELL).collect()


def test_queries_get_a_kind(spark, tmp_path):
    path = tmp_path / "q.json"
    path.write_text(json.dumps({"version": 1, "queries": [{"id": "a", "question": "?"}, {"id": "b", "kind": "free-form"}]}))
    assert {r.id: r.kind for r in store.read_queries(spark, str(path)).collect()} == {"a": "mcq", "b": "free-form"}
    assert store.read_queries(spark, str(path), ["b"]).count() == 1
    path.write_text(json.dumps({"version": 2, "queries": []}))
    with pytest.raises(ValueError, match="version"):
        store.read_queries(spark, str(path))


def test_haystack(spark, tmp_path):
    path = tmp_path / "h.jsonl"
    path.write_text(json.dumps({"input": "Mary went home. The cat is in the hall. It sat.", "target": "hall", "question": "Where?"}) + "\n")
    events, queries = store.read_haystack(spark, str(path), "1")
    assert [r.content for r in events.orderBy("place").collect()] == ["Mary went home.", "The cat is in the hall.", "It sat."]
    assert queries.first().relevant == [events.where("place = 1").first().event_id]


def test_leaderboard_ledger_documents(spark, tmp_path):
    (tmp_path / "l.csv").write_text("model_name,task,0k,1k\nm,qa1,0.5,\n")
    assert [(r.length, r.score) for r in store.read_leaderboard(spark, str(tmp_path / "l.csv")).collect()] == [("0k", 0.5)]
    (tmp_path / "d.json").write_text(json.dumps({"decisions": {"D1": {"summary": "s", "shardIds": ["x"], "phase": "p", "eventIds": ["e1", "e2"]}}}))
    assert store.read_ledger(spark, str(tmp_path / "d.json")).count() == 2
    (tmp_path / "a.jsonl").write_text("﻿" + json.dumps({"id": "1", "content": "c", "user_id": "u"}) + "\n\n")
    assert store.read_documents(spark, str(tmp_path / "a.jsonl"), "u").first().id == "1"
    assert store.read_documents(spark, str(tmp_path / "a.jsonl"), "v").count() == 0


def test_corpus_of_repeated_ids_fails(spark):
    part = spark.createDataFrame([("a", "s")], "id string, shardId string")
    with pytest.raises(ValueError, match="repeat"):
        store.build_corpus(part, [part])
    other = spark.createDataFrame([("b", "s")], "id string, shardId string")
    assert [(r.id, r.tier, r.isCore) for r in store.build_corpus(part, [other]).collect()] == [("a", 0, True), ("b", 1, False)]


def test_snapshots_are_written_once(spark, tmp_path):
    s = store.MemoryStore(spark, str(tmp_path))
    events = spark.range(3)
    s.write_snapshot("a", "S002", events)
    s.write_snapshot("a", "S001", events)
    assert s.snapshot_ids("a") == ["S001", "S002"] and s.snapshot_ids("b") == []
    with pytest.raises(AnalysisException):
        s.write_snapshot("a", "S001", events)


def test_logs_append_and_keyed_tables_replace(spark, tmp_path):
    s = store.MemoryStore(spark, str(tmp_path))
    kind = "id STRING, v INT"
    row = lambda *rows: spark.createDataFrame(list(rows), kind)
    s.append("chronicle", row(("a", 1)))
    s.append("chronicle", row(("a", 2)))
    assert s.read("chronicle", kind).count() == 2
    s.put("directory", row(("a", 1), ("b", 1)))
    s.put("directory", row(("b", 2), ("c", 2)))
    assert {r.id: r.v for r in s.read("directory", kind).collect()} == {"a": 1, "b": 2, "c": 2}
    with pytest.raises(ValueError, match="log"):
        s.append("directory", row(("a", 1)))


def test_cache_refuses_short_answers(spark, tmp_path):
    s = store.MemoryStore(spark, str(tmp_path))
    asked = spark.createDataFrame([("k1", "p"), ("k2", "p")], "key string, prompt string")
    calls = []

    def answer(missing):
        calls.append(missing.count())
        return missing.select("key", F.when(F.col("key") == "k1", "a long one").otherwise("no").alias("response"))

    assert s.cached(asked, answer).count() == 2
    assert s.cached(asked, answer).count() == 2
    assert calls == [2, 1]


def test_run_stops_a_failing_system(spark):
    kind = "system string, model_context long, corpus_size long, trial int, query_id string, correct boolean, citation_precision double, citation_recall double, input_tokens long, latency_ms long, error string, line_no long"
    cells, sizes = [], []
    grid = spark.createDataFrame([(s, 8192, n, 0, "q") for s in ("good", "bad") for n in (10, 20, 30)], "system string, model_context long, corpus_size long, trial int, query_id string")

    def answer(wave):
        sizes.append(sorted(r.system for r in wave.collect()))
        right = (F.col("system") == "good") | (F.col("corpus_size") < 20)
        return wave.select("*", right.alias("correct"), *[F.lit(0.0).alias(c) for c in ("citation_precision", "citation_recall")], F.lit(1).cast("long").alias("input_tokens"), F.lit(1).cast("long").alias("latency_ms"), F.lit(None).cast("string").alias("error"), F.col("corpus_size").alias("line_no"))

    read = lambda: spark.createDataFrame(cells, kind)
    got = bench.run(grid, spark.createDataFrame([], kind), answer, lambda df: cells.extend(map(tuple, df.collect())), read)
    assert sizes == [["bad", "good"], ["bad", "good"], ["good"]]
    assert {(r.system, r.corpus_size): r.early_stopped for r in got.collect()}[("bad", 20)] is False
    assert bench.replay(read()).count() == got.count()


def test_stream_equals_batch(spark, sf, tmp_path):
    events = views.table(spark, sf, "events")
    events.write.parquet(str(tmp_path / "in"))
    stream = ingest.windowed(spark.readStream.schema(events.schema).parquet(str(tmp_path / "in")), late="60 days")
    q = stream.writeStream.format("memory").queryName("hours").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert sorted(map(str, spark.table("hours").collect())) == sorted(map(str, ingest.windowed(events).collect()))


def test_commits_by_micro_batch(spark, tmp_path):
    kind = "decision_id long, action string, target string, content string, tags array<string>, ordinal long"
    spark.createDataFrame([(1, "write", "a", "hello", ["t"], 1), (2, "no_op", "a", "", [], 2)], kind).write.parquet(str(tmp_path / "in"))
    manifests = spark.createDataFrame([("a", "active", 4, 10)], "shard_id string, status string, n_events long, tokens long")
    stream = spark.readStream.schema(kind).parquet(str(tmp_path / "in"))
    ingest.apply_batches(stream, lambda d: commit.apply(d, manifests), str(tmp_path / "out"), str(tmp_path / "cp")).awaitTermination()
    got = spark.read.parquet(str(tmp_path / "out")).collect()
    assert [(r.event_id, r.snapshot_id, r.parent_id) for r in got] == [("e_0005", "S002", "S001")]


def test_plugged_retrievers(spark, sf):
    corpus, questions = views.events(spark, sf), views.questions(spark, sf)
    asked = questions.join(views.vectors(spark, sf), F.col("query_id") == F.col("event_id")).select("query_id", "vec")
    hybrid = plugins.Hybrid(plugins.Lexical(), plugins.Vector(views.vectors(spark, sf), asked))
    for r in (hybrid, plugins.EntityGraph()):
        got = r.retrieve(questions, corpus)
        assert {"query_id", "event_id", "score", "rank"} <= set(got.columns)
        assert got.groupBy("query_id").agg(F.max("rank").alias("m")).where("m > 10").count() == 0


def test_results_and_haystacks_do_not_depend_on_file_sizes(spark, tmp_path):
    """A large newer file and a small older one: the newer row wins; rows are counted by file and place."""
    import os

    cell = {"system": "a", "modelContext": 1, "corpusSize": 1, "trial": 0, "queryId": "q"}
    old, new = tmp_path / "r" / "part-b.json", tmp_path / "r" / "part-a.json"
    old.parent.mkdir()
    old.write_text(json.dumps(cell | {"correct": False}) + "\n")
    os.utime(old, (1_700_000_000, 1_700_000_000))
    new.write_text("".join(json.dumps(cell | {"queryId": f"q{k}", "correct": False}) + "\n" for k in range(3000)) + json.dumps(cell | {"correct": True}) + "\n")
    got = {r.queryId: r.correct for r in store.read_results(spark, str(tmp_path / "r")).collect()}
    assert got["q"] is True and len(got) == 3001
    old.write_text(json.dumps(cell | {"correct": False, "timestampIso": "2024-01-02"}) + "\n" + json.dumps(cell | {"correct": True, "timestampIso": "2024-01-01"}) + "\n")
    os.utime(old, (1_700_000_000, 1_700_000_000))
    assert {r.queryId: r.correct for r in store.read_results(spark, str(tmp_path / "r")).collect()}["q"] is False  # its own time comes first
    folder = tmp_path / "h"
    folder.mkdir()
    for name, n in (("b", 1), ("a", 500), ("c", 2)):
        (folder / f"{name}.json").write_text("".join(json.dumps({"input": f"{name} {k}.", "target": "t", "question": "q"}) + "\n" for k in range(n)))
    events, queries = store.read_haystack(spark, str(folder), "1")
    assert sorted(int(r.query_id[3:]) for r in queries.collect()) == list(range(503))
    assert events.where("shard_id = '1-500'").first().content == "b 0."
    assert store.read_haystack(spark, str(folder), "1", sample=7)[1].count() == 7


def test_commits_write_and_reads_do_not(spark, tmp_path):
    from pyspark.sql import functions as F

    from mnemoflow.plans import ask, commit

    s = store.MemoryStore(spark, str(tmp_path / "store"))
    now = F.lit("2024-02-01").cast("timestamp")
    shards = spark.createDataFrame([("a", "Alpha", "of a", ["x"], "sum"), ("b", "Beta", "of b", ["y"], "sum")], "id string, name string, description string, tags array<string>, summary string")
    commit.create_shards(s, shards, now)
    assert s.shard_ids() == ["a", "b"]
    with pytest.raises(ValueError, match="a"):
        commit.create_shards(s, shards.where("id = 'a'"), now)
    kind = "decision_id long, action string, target string, content string, tags array<string>, confidence double, reason string, ordinal int"
    rows = [
        (1, "write", "a", "the launch is in March", ["Plan", "x"], 0.9, "r1", 2), (2, "update", "a", "the launch moved", None, 0.4, "r2", 1), (3, "write", "gone", "c", None, 0.5, "r", 3),
        (4, "no_op", None, None, None, None, "r", 4), (5, "freeze", "b", None, None, None, "r5", 5), (6, "split", "a", None, None, None, "r", 6), (7, "write", None, "c", None, 0.5, "r", 7),
    ]
    out = {r.decision_id: r.outcome for r in commit.commit(s, spark.createDataFrame(rows, kind), now).collect()}
    assert out == {1: "written", 2: "written", 3: "unknown_target", 4: "unchanged", 5: "frozen", 6: "not_applied", 7: "unknown_target"}
    again = {r.decision_id: r.outcome for r in commit.commit(s, spark.createDataFrame([(8, "write", "b", "c", None, 0.5, "r", 1), (9, "write", "a", "third", None, 0.5, "r", 1)], kind), now).collect()}
    assert again == {8: "rejected", 9: "written"}
    manifests = {r.shardId: r for r in s.read("manifests", store.MANIFEST).collect()}
    assert manifests["a"].latestSnapshotId == "S004" and manifests["a"].snapshotIds == ["S001", "S002", "S003", "S004"] and manifests["a"].nEvents == 3
    assert manifests["a"].tags == ["x", "plan"] and manifests["b"].status == "frozen"
    entry = {r.id: r for r in s.read("directory", store.ENTRY).collect()}
    assert entry["a"].snapshotId == "S004" and entry["a"].tokens == manifests["a"].tokens > 0 and entry["b"].status == "frozen"
    events = {r.eventId: r for r in s.read("events", store.STORED_EVENT).collect()}
    assert [events[e].content for e in ("e_0001", "e_0002", "e_0003")] == ["the launch moved", "the launch is in March", "third"]
    assert events["e_0002"].importance == 0.9 and events["e_0002"].role == "commit_note"
    assert s.events("a", "S002").count() == 1 and s.events("a").count() == 3
    traces = sorted((r.type, r.targetShardId, r.oldSnapshotId or "", r.newSnapshotId) for r in s.read("chronicle", store.CHRONICLE).collect())
    assert traces == [("commit_update", "a", "S001", "S002"), ("commit_write", "a", "S002", "S003"), ("commit_write", "a", "S003", "S004"), ("shard_created", "a", "", "S001"), ("shard_created", "b", "", "S001"), ("shard_frozen", "b", "S001", "S001")]

    before = s.fingerprint()
    questions = spark.createDataFrame([(1, "when is the launch"), (2, "nothing known here")], "query_id long, question string")
    run = ask.ask_stored(s, questions, now).collect()
    assert len(run) == 2 and not any(r.mutated for r in run) and s.fingerprint() == before
    commit.commit(s, spark.createDataFrame([(10, "write", "a", "fourth", None, 0.5, "r", 1)], kind), now)
    assert s.fingerprint() != before


def test_cache_counts_what_it_keeps(spark, tmp_path):
    s = store.MemoryStore(spark, str(tmp_path))
    assert s.cache_stats() == (0, 0)
    s.put("cache", spark.createDataFrame([("k1", "abcde"), ("k2", "fünf!")], "key string, response string"))
    assert s.cache_stats() == (2, 11)


DECISIONS = "decision_id long, action string, target string, content string, tags array<string>, confidence double, reason string, ordinal int"


def _one_shard(spark, tmp_path):
    from mnemoflow.plans import commit

    s, now = store.MemoryStore(spark, str(tmp_path / "store")), F.lit("2024-02-01").cast("timestamp")
    commit.create_shards(s, spark.createDataFrame([("a", "A", "d", ["x"], "s")], "id string, name string, description string, tags array<string>, summary string"), now)
    return s, now


def _writes(spark, start, many):
    return spark.range(start, start + many).select(F.col("id").alias("decision_id"), F.lit("write").alias("action"), F.lit("a").alias("target"), F.concat(F.lit("c"), F.col("id").cast("string")).alias("content"), F.array(F.lit("t")).alias("tags"), F.lit(0.5).alias("confidence"), F.lit("r").alias("reason"), F.col("id").cast("int").alias("ordinal"))


def test_snapshots_past_999(spark, tmp_path):
    """2,000 writes in three commits make 2,001 snapshots; a snapshot holds what was written up to it."""
    from mnemoflow.plans import commit

    s, now = _one_shard(spark, tmp_path)
    for start, many in ((0, 997), (997, 3), (1000, 1000)):
        commit.commit(s, _writes(spark, start, many), now)
    manifest = s.read("manifests", store.MANIFEST).first()
    assert manifest.latestSnapshotId == "S2001" and manifest.snapshotIds == [f"S{n:03d}" for n in range(1, 2002)] and manifest.nEvents == 2000
    events = s.read("events", store.STORED_EVENT)
    assert events.select("snapshotId").distinct().count() == events.count() == 2000
    assert [s.events("a", x).count() for x in ("S001", "S999", "S1000", "S2001")] == [0, 998, 999, 2000]
    assert s.snapshot_ids("a") == manifest.snapshotIds and s.snapshot_ids("none") == []


def test_a_transaction_counts_once_and_as_a_whole(spark, tmp_path, monkeypatch):
    from mnemoflow.plans import commit

    s, now = _one_shard(spark, tmp_path)
    first = sorted(map(tuple, commit.commit(s, _writes(spark, 0, 3), now, "t1").collect()))
    before = s.fingerprint()
    assert sorted(map(tuple, commit.commit(s, _writes(spark, 0, 3), now, "t1").collect())) == first and s.fingerprint() == before
    whole = store.MemoryStore.publish

    def broken(self, transaction, tables, **more):  # it fails after the first of its tables
        list(tables.values())[0].write.mode("overwrite").parquet(f"{self.path('events')}/part={3:012d}-{transaction}")
        raise OSError("lost")

    monkeypatch.setattr(store.MemoryStore, "publish", broken)
    with pytest.raises(OSError, match="lost"):
        commit.commit(s, _writes(spark, 3, 2), now, "t2")
    monkeypatch.setattr(store.MemoryStore, "publish", whole)
    assert s.fingerprint() == before
    commit.commit(s, _writes(spark, 3, 2), now, "t2")
    assert s.events("a").count() == 5 and s.read("manifests", store.MANIFEST).first().latestSnapshotId == "S006"
    assert s.read("chronicle", store.CHRONICLE).count() == 6
    monkeypatch.setattr(s, "transactions", lambda: whole_list[:-1])
    whole_list = store.MemoryStore.transactions(s)
    with pytest.raises(RuntimeError, match="repeat"):  # a writer that hasn't seen the last transaction
        s.publish("late", {"telemetry": spark.range(1)})


def test_a_stream_commits_each_batch_once(spark, tmp_path):
    s, now = _one_shard(spark, tmp_path)
    _writes(spark, 0, 4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(_writes(spark, 0, 1).schema).parquet(str(tmp_path / "in"))
    for checkpoint in ("c1", "c2"):  # the second has lost its progress and sends the batch again
        ingest.commit_batches(stream, s, now, "decisions", str(tmp_path / checkpoint)).awaitTermination()
        assert s.events("a").count() == 4


def test_parts_are_folded_and_misses_alone_are_written(spark, tmp_path):
    s, calls = store.MemoryStore(spark, str(tmp_path)), spark.sparkContext.accumulator(0)

    def embed(texts):
        calls.add(len(texts))
        return [[float(len(t)), 1.0] for t in texts]

    texts = lambda *t: spark.createDataFrame([(x,) for x in t], "text string")
    assert sorted(r.vec[0] for r in s.embedded(texts("a", "bb", "bb", None), embed).collect()) == [0.0, 1.0, 2.0, 2.0]
    assert calls.value == 3
    assert sorted(r.vec[0] for r in s.embedded(texts("bb", "ccc"), embed).collect()) == [2.0, 3.0]
    assert calls.value == 4 and spark.read.parquet(s.parts("embeddings")[-1]).count() == 1
    s.put("embeddings", s.read("embeddings", store.EMBEDDED).where("vec[0] = 3").withColumn("vec", F.array(F.lit(9.0))))
    for _ in range(2):
        assert sorted(r.vec[0] for r in s.read("embeddings", store.EMBEDDED).collect()) == [0.0, 1.0, 2.0, 9.0]
        s.compact("embeddings", store.EMBEDDED)
    assert len(s.parts("embeddings")) == 1
