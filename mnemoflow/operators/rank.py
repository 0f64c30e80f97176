"""Ranking, packing and ordered unions. Every order ends with an id, so that ties are settled."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, rank: str = "rank") -> DataFrame:
    """The first k rows of each group with their rank; partial limits run before the shuffle."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn(rank, F.row_number().over(w)).where(F.col(rank) <= k)


def prefix_pack(df: DataFrame, keys: list[str], order: list[Column], cost: Column, budget: int | Column, name: str = "cum_tokens") -> DataFrame:
    """Rows in order as long as the running cost stays in the budget. Exact for costs of 1 or more."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    return df.withColumn(name, F.sum(cost).over(w)).where(F.col(name) <= budget)


def first_wins(df: DataFrame, keys: list[str], item: str, place: str) -> DataFrame:
    """Each item once per group, at its first place."""
    return df.groupBy(*keys, item).agg(F.min(place).alias(place))


def backfill(base: DataFrame, ranked: DataFrame, keys: list[str], k: int) -> DataFrame:
    """``base`` (keys, event_id, rank) filled up to k rows a group by the best of ``ranked`` that it lacks."""
    have = base.groupBy(*keys).agg(F.count("*").alias("__have"), F.max("rank").alias("__last"))
    lacking = ranked.join(base.select(*keys, "event_id"), [*keys, "event_id"], "left_anti").join(have, keys, "left")
    w = Window.partitionBy(*keys).orderBy("rank", "event_id")
    more = lacking.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= k - F.coalesce("__have", F.lit(0)))
    more = more.select(*keys, "event_id", (F.coalesce("__last", F.lit(0)) + F.col("__n")).cast("int").alias("rank"), F.lit("floor").alias("via"))
    return base.select(*keys, "event_id", F.col("rank").cast("int").alias("rank"), F.lit("base").alias("via")).unionByName(more)


def latest_wins(df: DataFrame, keys: list[str], *place: str) -> DataFrame:
    """Of rows of a key, the one of the largest place; a null is before all."""
    w = Window.partitionBy(*keys).orderBy(*[F.desc_nulls_last(c) for c in place])
    return df.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """``new`` replaces rows of the same key; the others are appended."""
    return old.join(new.select(key), key, "left_anti").unionByName(new)


def timeline(df: DataFrame, keys: list[str], order: list[Column], limit: int) -> DataFrame:
    """At most ``limit`` rows, spread evenly over each group's order; groups within it stay whole."""
    w = Window.partitionBy(*keys)
    placed = df.withColumn("pos", F.row_number().over(w.orderBy(*order)) - 1).withColumn("many", F.count("*").over(w))
    wanted = F.array_distinct(F.transform(F.sequence(F.lit(0), F.lit(limit - 1)), lambda i: F.floor(i * (F.col("many") - 1) / max(limit - 1, 1) + 0.5).cast("int")))
    return placed.where((F.col("many") <= limit) | F.array_contains(wanted, F.col("pos").cast("int"))).drop("many")
