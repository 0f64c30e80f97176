"""The write path in batches: validated decisions, new snapshots, the audit log."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions import maths, text
from .rank import upsert

ACTIONS = ("write", "update", "freeze", "split", "merge", "no_op", "ask_confirmation")


def dry_run(decisions: DataFrame, manifests: DataFrame) -> DataFrame:
    """What each decision (decision_id, action, target, content) would do."""
    known = manifests.select(F.col("shard_id").alias("target"), F.lit(True).alias("known"))
    rows = decisions.join(known, "target", "left")
    idle, writes = F.col("action").isin("no_op", "ask_confirmation"), F.col("action").isin("write", "update")
    no_target, unknown = F.col("target").isNull(), F.col("known").isNull()
    would = ~idle & ~no_target & ~unknown
    # How each outcome is told.
    description = (
        F.when(idle, F.concat(F.lit("No durable change for action="), "action", F.lit(".")))
        .when(no_target, F.concat(F.lit("Action "), "action", F.lit(" requires target_shard_id.")))
        .when(unknown, F.concat(F.lit("Target shard "), "target", F.lit(" not found; would be a no-op.")))
        .when(writes, F.concat(F.lit("Would append commit_note event to "), "target", F.lit(', creating new snapshot. content="'), text.truncate(F.col("content"), 80), F.lit('"')))
        .when(F.col("action") == "freeze", F.concat(F.lit("Would freeze shard "), "target", F.lit(" (status:active→frozen).")))
        .otherwise(F.concat(F.lit("Action "), "action", F.lit(" not implemented in MVP. Would be a no-op.")))
    )
    kind = F.when(~would, "none").when(F.col("action") == "write", "commit_write").when(F.col("action") == "update", "commit_update").when(F.col("action") == "freeze", "shard_frozen").otherwise("none")
    return rows.select("decision_id", "action", "target", would.alias("would_mutate"), description.alias("description"), kind.alias("chronicle_type"))


def apply(decisions: DataFrame, manifests: DataFrame) -> DataFrame:
    """Writes to active shards, in order: event and snapshot numbers and the shard's running tokens.

    ``decisions``: (decision_id, action, target, content, tags, ordinal); ``manifests``: (shard_id, status, n_events, tokens)
    and, if shards have more than their first snapshot, ``snapshot_id``, the latest.
    """
    active = manifests.where("status = 'active'").withColumnRenamed("shard_id", "target")
    rows = decisions.where(F.col("action").isin("write", "update")).join(active, "target")
    w = Window.partitionBy("target").orderBy("ordinal", "decision_id")
    cost = text.estimate_tokens(F.col("content")) + text.estimate_tokens(F.lit("commit_note")) + 8 + text.estimate_tokens(F.array_join("tags", ","))
    place = F.row_number().over(w)
    latest = F.regexp_extract("snapshot_id", r"(\d+)$", 1).cast("long") if "snapshot_id" in manifests.columns else F.lit(1)
    tokens = F.col("tokens") + F.sum(cost).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return rows.select(
        "decision_id",
        F.col("target").alias("shard_id"),
        F.format_string("e_%04d", F.col("n_events") + place).alias("event_id"),
        F.format_string("S%03d", latest + place).alias("snapshot_id"),
        F.format_string("S%03d", latest + place - 1).alias("parent_id"),
        tokens.alias("tokens"),
        F.round(maths.fullness(tokens, F.lit(DEFAULT.context_limit)), 9).alias("fullness_pct"),
        F.when(F.col("action") == "write", "commit_write").otherwise("commit_update").alias("chronicle_type"),
    )


def freeze(directory: DataFrame, decisions: DataFrame) -> DataFrame:
    """The directory with the targets of freeze decisions frozen."""
    targets = decisions.where("action = 'freeze'").select(F.col("target").alias("id")).distinct()
    changed = directory.join(targets, "id", "left_semi").withColumn("status", F.lit("frozen"))
    return upsert(directory, changed, "id")


def rejected(decisions: DataFrame, manifests: DataFrame) -> DataFrame:
    """Writes whose target is there but isn't active."""
    closed = manifests.where("status <> 'active'").select(F.col("shard_id").alias("target"), "status")
    return decisions.where(F.col("action").isin("write", "update")).join(closed, "target").select("decision_id", "target", "status")
