"""Rules over batches of queries and events, and the merges that enforce them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens

# What options of an adversarial query say.
NEGATIVE = ("rejected", "evaluated", "vetoed", "considered", "deferred", "paused", "rolled it back", "no such decision", "never proposed", "never integrated")


def negatives(options: Column) -> Column:
    return F.size(F.filter(options, lambda o: _any([F.contains(F.lower(o), F.lit(k)) for k in NEGATIVE])))


def _any(tests: list[Column]) -> Column:
    out = F.lit(False)
    for t in tests:
        out = out | t
    return out


def query_faults(queries: DataFrame, options: int = 40, least_negative: int = 3) -> DataFrame:
    """(id, faults) of queries (id, category, options, correctOption)."""
    o = F.col("options")
    rules = [
        (F.coalesce(F.size(o), F.lit(0)) != options, "option_count"),
        (F.coalesce(~F.col("correctOption").between(1, options), F.lit(True)), "correct_option"),
        (F.size(F.array_distinct(o)) != F.size(o), "duplicate_option"),
        ((F.col("category") == "adversarial") & (negatives(o) < least_negative), "too_few_negatives"),
    ]
    return queries.select("id", F.array_compact(F.array(*[F.when(F.coalesce(test, F.lit(False)), name) for test, name in rules])).alias("faults"))


def check_batch(queries: DataFrame, size: int, options: int = 40) -> DataFrame:
    """The batch as it is; a wrong number of queries or any fault fails."""
    bad = [(r.id, list(r.faults)) for r in query_faults(queries, options).where("size(faults) > 0").limit(5).collect()]
    n = queries.count()
    if n != size or bad:
        raise ValueError(f"{n} queries, {size} asked for; faults: {bad}")
    return queries


def repeated_ids(rows: DataFrame, key: str = "id") -> DataFrame:
    return rows.groupBy(key).count().where("count > 1").select(key)


def _unique(rows: DataFrame, what: str) -> DataFrame:
    again = [r[0] for r in repeated_ids(rows).orderBy("id").limit(5).collect()]
    if again:
        raise ValueError(f"{what} that repeat: {', '.join(map(str, again))}")
    return rows


def merge_queries(batches: list[DataFrame]) -> DataFrame:
    """All batches in the order of ids; a repeated id fails."""
    whole = batches[0]
    for b in batches[1:]:
        whole = whole.unionByName(b)
    return _unique(whole, "queries").orderBy("id")


def per_category(queries: DataFrame) -> DataFrame:
    return queries.groupBy(F.coalesce("category", F.lit("uncategorised")).alias("category")).agg(F.count("*").alias("n"), F.sum(F.size("options")).cast("long").alias("n_options"))


def normalised(events: DataFrame) -> DataFrame:
    """Events of a phase made core ones of tier 0 with their tokens counted anew, and what was changed of each."""
    tokens = estimate_tokens(F.col("content"))
    changed = {
        "core_fixed": ~F.coalesce(F.col("isCore"), F.lit(False)),
        "tier_fixed": F.coalesce(F.col("tier") != 0, F.lit(True)),
        "tokens_fixed": F.coalesce(F.col("tokenCount") != tokens, F.lit(True)),
    }
    return events.select("*", *[c.alias(n) for n, c in changed.items()]).withColumns({"isCore": F.lit(True), "tier": F.lit(0), "tokenCount": tokens})


def merge_phases(phases: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """All phases' events in the order of ids, and per phase and shard what was counted and fixed. A repeated id fails."""
    whole = None
    for name, part in phases.items():
        rows = normalised(part).withColumn("phase", F.lit(name))
        whole = rows if whole is None else whole.unionByName(rows)
    counts = phase_counts(whole)
    return _unique(whole, "events").drop("phase", "core_fixed", "tier_fixed", "tokens_fixed").orderBy("id"), counts


def phase_counts(rows: DataFrame) -> DataFrame:
    fixed = [F.sum(F.col(c).cast("long")).alias(c) for c in ("core_fixed", "tier_fixed", "tokens_fixed")]
    return rows.groupBy("phase", "shardId").agg(F.count("*").alias("n_events"), F.sum("tokenCount").alias("tokens"), *fixed)
