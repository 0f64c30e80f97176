"""A memory of facts that grows batch by batch.

What an event says is a fact; its terms are what it's about. A fact that was said before in its shard, word for word,
is a repeat and only counted. A new one meets, for each of its KEYS longest terms, the latest fact before it that has
this term among its own longest. The nearest of these, by the share of terms in common, is what it updates, if they share
SIMILAR at least; else it's a memory of its own. A memory is the chain of its versions, the last of which holds.

What a fact meets lies before it, so batches in the order of their ordinals give what one batch gives. The state that a
batch joins is the digests of what was said, and a row for each shard and term: the latest fact with it. The latest
fact before another is told within stretches of BUCKET ordinals and between these, so that a term of many facts is no
single task; repeats are combined before any of this.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions.text import bridge_terms
from ..sources.cut import cut

KEYS = 3
SIMILAR = 0.5
BUCKET = 1 << 16
#: A fact as it's kept: op is add, update or repeat, n how often a batch said it.
FACT = "shard_id STRING, said STRING, op STRING, event_id STRING, ordinal LONG, previous STRING, memory_id STRING, similarity DOUBLE, n LONG"
TAIL = "key STRING, shard_id STRING, term STRING, event_id STRING, ordinal LONG, terms ARRAY<STRING>, memory_id STRING"


def key_terms(terms: Column) -> Column:
    by_length = F.array_sort(F.transform(terms, lambda t: F.struct((-F.length(t)).alias("n"), t.alias("t"))))
    return F.transform(F.slice(by_length, 1, KEYS), lambda x: x["t"])


def _before(listed: DataFrame) -> DataFrame:
    """Each row of (shard_id, term, ordinal, event_id, terms) with ``met``, the row before it of its shard and term, if any."""
    own = F.struct("ordinal", "event_id", "terms")
    rows = listed.withColumn("bucket", F.floor(F.col("ordinal") / BUCKET))
    inner = Window.partitionBy("shard_id", "term", "bucket").orderBy("ordinal", "event_id")
    placed = rows.withColumn("met", F.lag(own).over(inner))
    ends = rows.groupBy("shard_id", "term", "bucket").agg(F.max(own).alias("last"))
    ends = ends.withColumn("before", F.lag("last").over(Window.partitionBy("shard_id", "term").orderBy("bucket"))).drop("last")
    return placed.join(ends, ["shard_id", "term", "bucket"]).withColumn("met", F.coalesce("met", "before")).drop("bucket", "before")


def _memory_ids(facts: DataFrame) -> DataFrame:
    """(event_id, memory_id) of facts (event_id, previous, known): the first fact of the chain, or the known memory that it leads to.
    Each round a fact looks twice as far back; those that have arrived leave."""
    at_end = F.col("previous").isNull() | F.col("known").isNotNull()
    done = facts.where(at_end).select("event_id", F.coalesce("known", "event_id").alias("memory_id"))
    left = cut(facts.where(~at_end).select("event_id", F.col("previous").alias("parent")))
    arrived = [cut(done)]
    while left.limit(1).count():
        met = arrived[0]
        for more in arrived[1:]:
            met = met.unionByName(more)
        found = left.join(met.select(F.col("event_id").alias("parent"), "memory_id"), "parent").select("event_id", "memory_id")
        jump = left.join(left.select(F.col("event_id").alias("parent"), F.col("parent").alias("further")), "parent").select("event_id", F.col("further").alias("parent"))
        arrived.append(cut(found))
        left = cut(jump)
    out = arrived[0]
    for more in arrived[1:]:
        out = out.unionByName(more)
    return out


def consolidate(events: DataFrame, facts: DataFrame, tails: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The batch's rows of FACT and of TAIL, from ``events`` (shard_id, event_id, ordinal, content) and what is kept so far."""
    spoken = events.select(F.col("shard_id").cast("string"), F.col("event_id").cast("string"), F.col("ordinal").cast("long"), F.sha2("content", 256).alias("said"), bridge_terms(F.col("content")).alias("terms")).where("size(terms) > 0")
    first = F.min(F.struct("ordinal", "event_id")).alias("first")
    statements = spoken.groupBy("shard_id", "said").agg(first, F.count("*").alias("n"), F.any_value("terms").alias("terms"))
    statements = cut(statements.select("shard_id", "said", "first.event_id", "first.ordinal", "n", "terms"))
    known = facts.where("op <> 'repeat'").select("shard_id", "said", F.lit(True).alias("old"))
    statements = cut(statements.join(known, ["shard_id", "said"], "left"))
    new = statements.where("old IS NULL").drop("old")

    listed = _before(new.select("shard_id", "event_id", "ordinal", "terms", F.explode(key_terms(F.col("terms"))).alias("term")))
    stored = tails.select("shard_id", "term", F.struct("ordinal", "event_id", "terms").alias("kept"), F.col("memory_id").alias("kept_memory"))
    met = listed.join(stored, ["shard_id", "term"], "left").withColumn("known", F.when(F.col("met").isNull(), F.col("kept_memory"))).withColumn("met", F.coalesce("met", "kept")).where("met IS NOT NULL")
    share = F.size(F.array_intersect("terms", "met.terms")) / F.size(F.array_union("terms", "met.terms"))
    near = met.select("event_id", F.struct(share.alias("share"), F.col("met.ordinal").alias("ordinal"), F.col("met.event_id").alias("previous"), "known").alias("near")).where(F.col("near.share") >= SIMILAR)
    near = near.groupBy("event_id").agg(F.max("near").alias("near"))
    judged = cut(new.join(near, "event_id", "left").select("shard_id", "said", "event_id", "ordinal", "n", "terms", "near.previous", "near.known", F.round("near.share", 6).alias("similarity")))
    named = judged.join(_memory_ids(judged.select("event_id", "previous", "known")), "event_id")
    op = F.when(F.col("previous").isNull(), "add").otherwise("update").alias("op")
    columns = [f.split()[0] for f in FACT.split(", ")]
    made = cut(named.select(*[op if c == "op" else F.col(c) for c in columns], "terms"))
    none = F.lit(None)
    repeats = statements.where("old IS NOT NULL").select("shard_id", "said", F.lit("repeat").alias("op"), "event_id", "ordinal", none.cast("string").alias("previous"), none.cast("string").alias("memory_id"), none.cast("double").alias("similarity"), "n")
    ends = made.select("shard_id", F.explode(key_terms(F.col("terms"))).alias("term"), F.struct("ordinal", "event_id", "terms", "memory_id").alias("own")).groupBy("shard_id", "term").agg(F.max("own").alias("own"))
    ends = ends.select(F.concat_ws("\x1f", "shard_id", "term").alias("key"), "shard_id", "term", "own.event_id", "own.ordinal", "own.terms", "own.memory_id")
    return made.drop("terms").unionByName(repeats), ends


def memories(facts: DataFrame) -> DataFrame:
    """Per memory: shard_id, memory_id, event_id of the version that holds, n_versions, and n_said, how often any was said."""
    times = facts.groupBy("shard_id", "said").agg(F.sum("n").alias("n"), F.max_by(F.struct("memory_id", "event_id", "ordinal"), F.when(F.col("op") != "repeat", 1).otherwise(0)).alias("own"))
    latest = F.max(F.struct("own.ordinal", "own.event_id"))["event_id"]
    return times.groupBy("shard_id", F.col("own.memory_id").alias("memory_id")).agg(latest.alias("event_id"), F.count("*").alias("n_versions"), F.sum("n").alias("n_said"))
