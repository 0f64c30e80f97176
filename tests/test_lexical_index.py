"""The stored lexical index against the search that reads all postings."""

from __future__ import annotations

import random

import pytest
from pyspark.sql import functions as F

from mnemoflow.operators import lexical_index, retrieval

KIND = "event_id long, content string"


def rows(n):
    rng = random.Random(n)
    frequent, rare = ["alpha", "beta", "gamma", "delta"], [f"rare{k}" for k in range(60)]
    out = [(k, " ".join(rng.choices(frequent, k=rng.randint(0, 30)) + rng.choices(rare, k=rng.randint(0, 3)))) for k in range(n)]
    return out + [(n, None), (n + 1, ""), (n + 2, "?!"), (n + 3, out[0][1]), (n + 4, out[0][1])]


QUESTIONS = [(1, "alpha beta rare3 rare5"), (2, "gamma"), (3, "alpha alpha alpha delta rare7"), (4, "unknown"), (5, None), (6, "rare1 rare1 RARE2"), (7, "alpha beta gamma delta")]


def ranked(df):
    return sorted((r.query_id, r.rank, r.event_id, r.score) for r in df.collect())


@pytest.mark.parametrize("batches", [1, 3])
def test_the_same_hits(spark, tmp_path, monkeypatch, batches):
    monkeypatch.setattr(lexical_index, "BLOCK", 8)
    monkeypatch.setattr(lexical_index, "STRETCH", 100)
    corpus, questions = spark.createDataFrame(rows(700), KIND), spark.createDataFrame(QUESTIONS, "query_id long, question string")
    index = lexical_index.LexicalIndex(spark)
    for k in range(batches):
        index = lexical_index.extend(index, corpus.where(F.col("event_id") % batches == k), str(tmp_path / str(k)))
    for k in (1, 5, 20, 2000):
        assert ranked(lexical_index.search(index, questions, k)) == ranked(retrieval.bm25(corpus, questions, k))


def test_most_postings_of_frequent_words_are_not_read(spark, tmp_path):
    corpus, questions = spark.createDataFrame(rows(2000), KIND), spark.createDataFrame([(1, "alpha beta rare3 rare5"), (2, "delta gamma rare9")], "query_id long, question string")
    index = lexical_index.extend(lexical_index.LexicalIndex(spark), corpus, str(tmp_path / "a"))
    planned = {(r.query_id, r.tok): r.needed for r in lexical_index.plan(index, lexical_index._terms(index, questions), 5).collect()}
    assert not any(needed for (_, tok), needed in planned.items() if tok in ("alpha", "beta", "gamma", "delta"))
    assert planned[1, "rare3"] and planned[1, "rare5"] and planned[2, "rare9"]


def test_an_index_of_nothing(spark, tmp_path):
    with pytest.raises(ValueError, match="segment"):
        lexical_index.search(lexical_index.LexicalIndex(spark), spark.createDataFrame([], "query_id long, question string"))
    index = lexical_index.extend(lexical_index.LexicalIndex(spark), spark.createDataFrame([], KIND), str(tmp_path / "a"))
    assert lexical_index.search(index, spark.createDataFrame(QUESTIONS, "query_id long, question string")).collect() == []


def test_postings_are_made_where_their_events_are(spark, tmp_path):
    """postings were shuffled by word, which filled the disks."""
    context = spark.sparkContext
    context.setJobGroup("extend", "extend")
    index = lexical_index.extend(lexical_index.LexicalIndex(spark), spark.createDataFrame(rows(300), KIND), str(tmp_path / "a"))
    context.setJobGroup("others", "others")
    tracker = context.statusTracker()
    assert [len(tracker.getJobInfo(job).stageIds) for job in tracker.getJobIdsForGroup("extend")] == [1]
    found = {(r.tok, r.event_id): r.tf for r in index.table("blocks").select("tok", F.explode("postings").alias("p")).select("tok", "p.*").collect()}
    assert found == {(w, e): text.split().count(w) for e, text in rows(300) if text for w in text.split() if w != "?!"}
