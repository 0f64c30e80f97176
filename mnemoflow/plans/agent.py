"""An agent's retrieval: hits, neighbours and coverage in one order, for all scopes at once."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import agent, rank, retrieval


def retrieve(events: DataFrame, hits: int, most: int) -> DataFrame:
    """(shard_id, event_id, place). ``events``: scored turns."""
    best = rank.top_k(events.where("score > 0"), ["shard_id"], [F.desc("score"), F.asc("turn"), F.asc("event_id")], hits)
    near = retrieval.neighbours(events, best.select("event_id"))
    near = near.join(events.select(F.col("event_id").alias("hit"), "shard_id"), "hit").select("shard_id", F.col("neighbour").alias("event_id"), F.lit(1000).alias("place"))
    wide = agent.coverage(events.withColumn("scope", F.col("shard_id")), ["scope"], most).select("shard_id", "event_id", (F.lit(2000) + F.col("bucket")).cast("int").alias("place"))
    ordered = rank.first_wins(best.select("shard_id", "event_id", F.col("rank").alias("place")).unionByName(near).unionByName(wide), ["shard_id"], "event_id", "place")
    return rank.top_k(ordered.withColumnRenamed("place", "priority"), ["shard_id"], [F.asc("priority"), F.asc("event_id")], most, "place").select("shard_id", "event_id", "place")
