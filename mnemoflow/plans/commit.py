"""Writes to a store, a batch at a time: new shards and committed decisions, each with its trace in the chronicle."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions import maths, text
from ..sources.store import CHRONICLE, ENTRY, MANIFEST, MemoryStore, snapshot_number


def _columns(kind: str) -> list[str]:
    return [part.split()[0] for part in kind.replace("\n", " ").split(", ")]


def create_shards(store: MemoryStore, shards: DataFrame, now: Column, transaction: str | None = None) -> None:
    """``shards``: (id, name, description, tags, summary). Each gets an empty first snapshot; one that is there already
    fails, but for a ``transaction`` that is run again, which changes nothing."""
    if transaction and store.published(transaction):
        return
    known = [r.id for r in shards.join(store.read("manifests", MANIFEST).select(F.col("shardId").alias("id")), "id").select("id").limit(5).collect()]
    if known:
        raise ValueError(f"shards that exist: {', '.join(known)}")
    first, zero = F.lit("S001"), F.lit(0).cast("long")
    rows = shards.withColumns({"status": F.lit("active"), "createdAt": now, "updatedAt": now, "tokens": zero})
    entries = rows.withColumns({"snapshotId": first, "fullnessPct": F.lit(0.0), "summaryShort": F.col("summary")})
    manifests = rows.withColumnRenamed("id", "shardId").withColumns({"latestSnapshotId": first, "snapshotIds": F.array(first), "nEvents": zero})
    reason = F.concat(F.lit("Created shard "), "id", F.lit(" ("), "name", F.lit(")"))
    traces = rows.select(F.lit("shard_created").alias("type"), now.alias("createdAt"), F.col("id").alias("targetShardId"), F.lit(None).cast("string").alias("oldSnapshotId"), first.alias("newSnapshotId"), reason.alias("reason"), F.lit("user").alias("actor"))
    tables = {"chronicle": traces.select(_columns(CHRONICLE)), "manifests": manifests.select(_columns(MANIFEST)), "directory": entries.select(_columns(ENTRY))}
    store.publish(transaction or uuid.uuid4().hex, tables)


def snapshot(number: Column) -> Column:
    return F.format_string("S%03d", number)


def judged(decisions: DataFrame, manifests: DataFrame) -> DataFrame:
    """The decisions with what their target's manifest says and their ``outcome``."""
    rows = decisions.join(manifests.select(F.col("shardId").alias("target"), "status", "nEvents", "tokens", "latestSnapshotId"), "target", "left")
    writing = F.col("action").isin("write", "update")
    outcome = (
        F.when(F.col("action").isin("no_op", "ask_confirmation"), "unchanged").when(F.col("target").isNull() | F.col("status").isNull(), "unknown_target")
        .when(writing & (F.col("status") != "active"), "rejected").when(writing, "written").when(F.col("action") == "freeze", "frozen").otherwise("not_applied")
    )
    return rows.withColumn("outcome", outcome)


def commit(store: MemoryStore, decisions: DataFrame, now: Column, transaction: str | None = None) -> DataFrame:
    """(decision_id, outcome) of decisions (decision_id, action, target, content, tags, confidence, reason, ordinal).

    A write or update to an active shard appends an event and makes a snapshot, in the order of ordinals; a freeze ends
    writing; all else changes nothing. Each change is in the chronicle. All changes are one transaction of the store:
    they're seen together or not at all. A ``transaction`` that is run again changes nothing and gives the outcomes of the first time.
    """
    at = f"{store.root}/_decisions/{transaction or uuid.uuid4().hex}"
    if transaction and store.published(transaction):
        return store.spark.read.parquet(at).select("decision_id", "outcome")
    manifests = store.read("manifests", MANIFEST)
    # written once, so that what follows sees the decisions and manifests of one moment
    judged(decisions, manifests).write.mode("overwrite").parquet(at)
    rows = store.spark.read.parquet(at)
    place = F.row_number().over(Window.partitionBy("target").orderBy("ordinal", "decision_id"))
    last = snapshot_number(F.col("latestSnapshotId"))
    tags = F.transform(F.coalesce("tags", F.array().cast("array<string>")), F.lower)
    cost = text.estimate_tokens(F.col("content")) + text.estimate_tokens(F.lit("commit_note")) + 8 + text.estimate_tokens(F.array_join("tags", ","))
    written = rows.where("outcome = 'written'").select("*", place.alias("place"), tags.alias("own_tags"), cost.alias("cost")).select(
        "*", F.format_string("e_%04d", F.col("nEvents") + F.col("place")).alias("eventId"), snapshot(last + F.col("place")).alias("snapshotId"), snapshot(last + F.col("place") - 1).alias("parentId")
    )
    frozen = rows.where("outcome = 'frozen'").select(F.col("target").alias("shardId"), "reason", "latestSnapshotId").dropDuplicates(["shardId"])

    per = written.groupBy(F.col("target").alias("shardId")).agg(F.count("*").alias("more"), F.sum("cost").alias("cost"))
    # a shard's different tags, at most its vocabulary, by the place where each comes first
    seen = written.select(F.col("target").alias("shardId"), "place", F.posexplode("own_tags").alias("k", "tag")).groupBy("shardId", "tag").agg(F.min(F.struct("place", "k")).alias("first"))
    per = per.join(seen.groupBy("shardId").agg(F.array_sort(F.collect_list(F.struct("first", "tag")))["tag"].alias("more_tags")), "shardId", "left")
    changed = manifests.join(per, "shardId", "left").join(frozen.select("shardId", F.lit("frozen").alias("now_frozen")), "shardId", "left").where("more IS NOT NULL OR now_frozen IS NOT NULL")
    more, number = F.coalesce("more", F.lit(0)), snapshot_number(F.col("latestSnapshotId"))
    made = F.when(more > 0, F.transform(F.sequence(number + 1, number + F.greatest(more, F.lit(1))), snapshot)).otherwise(F.array().cast("array<string>"))
    updated = changed.withColumns({
        "status": F.coalesce("now_frozen", "status"),
        "snapshotIds": F.concat("snapshotIds", made),
        "latestSnapshotId": F.when(more > 0, snapshot(number + more)).otherwise(F.col("latestSnapshotId")),
        "nEvents": F.col("nEvents") + more,
        "tokens": F.col("tokens") + F.coalesce("cost", F.lit(0)),
        "tags": F.array_distinct(F.concat("tags", F.coalesce("more_tags", F.array().cast("array<string>")))),
        "updatedAt": now,
    }).select(_columns(MANIFEST))
    entries = store.read("directory", ENTRY).drop("tags", "status", "tokens", "updatedAt").join(
        updated.select(F.col("shardId").alias("id"), "tags", "status", "tokens", "updatedAt", "latestSnapshotId"), "id"
    )
    entries = entries.withColumns({"snapshotId": F.col("latestSnapshotId"), "fullnessPct": maths.round2(maths.fullness(F.col("tokens"), F.lit(DEFAULT.context_limit)))}).select(_columns(ENTRY))

    kind = F.when(F.col("action") == "write", "commit_write").otherwise("commit_update")
    traces = written.select(kind.alias("type"), now.alias("createdAt"), F.col("target").alias("targetShardId"), F.col("parentId").alias("oldSnapshotId"), F.col("snapshotId").alias("newSnapshotId"), "reason", F.lit("system").alias("actor"))
    traces = traces.unionByName(frozen.select(F.lit("shard_frozen").alias("type"), now.alias("createdAt"), F.col("shardId").alias("targetShardId"), F.col("latestSnapshotId").alias("oldSnapshotId"), F.col("latestSnapshotId").alias("newSnapshotId"), "reason", F.lit("system").alias("actor")))
    if rows.where("outcome IN ('written', 'frozen')").limit(1).count():
        events = written.select(F.col("target").alias("shardId"), "snapshotId", "eventId", F.lit("commit_note").alias("role"), "content", F.col("confidence").alias("importance"), F.col("own_tags").alias("tags"), now.alias("createdAt"))
        store.publish(transaction or uuid.uuid4().hex, {"events": events, "chronicle": traces.select(_columns(CHRONICLE)), "manifests": updated, "directory": entries})
    return rows.select("decision_id", "outcome")
