"""The read pipeline for all questions at once; it changes nothing durable."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..operators import folds, router
from ..sources.cut import cut
from ..sources.store import MemoryStore


def ask(questions: DataFrame, corpus: DataFrame, ref: Column, events: DataFrame | None = None) -> DataFrame:
    """(query_id, n_routed, n_recalls, summary, context): route, probe, recall, then one packet per question.

    Questions with two recalls or more are merged; the others need no merging. ``events`` may be the corpus as the directory
    needn't have it, without its labels. What several steps read, a few rows a question, is written once.
    """
    entries = cut(router.directory(corpus))
    corpus = corpus if events is None else events
    routed = cut(router.candidates(questions, entries, ref))
    targets = cut(router.recall_targets(router.probes(questions, corpus, entries, routed), routed))
    recalled = cut(router.recalls(questions, corpus, targets))
    counts = questions.select("query_id").join(routed.groupBy("query_id").agg(F.count("*").alias("n_routed")), "query_id", "left").join(recalled.groupBy("query_id").agg(F.count("*").alias("n_recalls")), "query_id", "left")
    many = recalled.join(counts.where("n_recalls > 1").select("query_id"), "query_id", "left_semi")
    single = router.packets(questions, recalled).select("query_id", "summary", "context")
    packets = single.unionByName(folds.synthesize(many).select("query_id", "summary", "context"))
    return counts.join(packets, "query_id").select("query_id", F.coalesce("n_routed", F.lit(0)).alias("n_routed"), F.coalesce("n_recalls", F.lit(0)).alias("n_recalls"), "summary", "context")


def ask_stored(store: MemoryStore, questions: DataFrame, ref: Column) -> DataFrame:
    """``ask`` over the store's latest snapshots. The answers go to the run log; ``mutated``: whether anything else of the store is another than before."""
    before = store.fingerprint()
    transaction = uuid.uuid4().hex
    run = ask(questions, store.events(), ref).withColumn("asked_at", ref).withColumn("run", F.lit(transaction))
    store.publish(transaction, {"query_runs": run})
    mutated = before != store.fingerprint()
    kept = store.spark.read.parquet(store.parts("query_runs")[-1])
    return kept.drop("run").withColumn("mutated", F.lit(mutated))
