"""Runs over long-context sets: each question is asked of its own shard only, cell by cell, and scored."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import maths, text
from ..operators import answers, evaluate, rank, retrieval
from ..sources import store
from ..sources.plugins import StageModel
from . import answer as asking

# The tokens that a length's name stands for.
LENGTHS = {"0K": 0, "4K": 4_096, "8K": 8_192, "32K": 32_768, "128K": 131_072, "256K": 262_144, "1M": 1_048_576}
KEY = ["system", "task", "length", "query_id"]
CELL = ["system", "task", "length"]
#: (queries, own events: query_id, event_id, place, content, token_count) -> (query_id, chosen, cited, input_tokens[, error])
System = Callable[[DataFrame, DataFrame], DataFrame]


def own_events(queries: DataFrame, events: DataFrame) -> DataFrame:
    """Each question with the events of its shard, by an equi-join; a question without a shard fails the run."""
    lost = queries.where("shard_id IS NULL").limit(1).collect()
    if lost:
        raise ValueError(f"{lost[0].query_id}: names no shard")
    return queries.select("query_id", "shard_id").join(events, "shard_id")


def long_context(model: StageModel, budget: int) -> System:
    """The events in order while they fit the budget, read by the model as they stand."""

    def system(queries: DataFrame, own: DataFrame) -> DataFrame:
        line = retrieval.context_line(F.col("event_id"), F.col("content"))
        lines = own.select("query_id", "place", "event_id", line.alias("line"), text.estimate_tokens(line).alias("tokens"))
        fitting = rank.prefix_pack(lines, ["query_id"], [F.asc("place")], F.col("tokens"), budget - DEFAULT.scaffolding_tokens)
        packed = fitting.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "event_id", "line"))).alias("p"), F.sum("tokens").alias("input_tokens"))
        none = F.array().cast("array<string>")
        contexts = queries.select("query_id").join(packed, "query_id", "left").select("query_id", F.array_join(F.coalesce("p.line", none), "").alias("context"), none.alias("packed"), none.alias("retrieved"), F.coalesce("input_tokens", F.lit(0)).alias("input_tokens"))
        said = asking.answer(queries.select("query_id", "question", F.lit(None).cast("array<string>").alias("options")), contexts, model)
        return said.join(contexts.select("query_id", "input_tokens"), "query_id").select("query_id", F.col("chosen_answer").alias("chosen"), "cited", "input_tokens")

    return system


def scored(queries: DataFrame, said: DataFrame) -> DataFrame:
    """Each question's row of results: what was said, whether it is right, how its citations score. A question that
    a system says nothing to, or whose row has an ``error``, is wrong and scores nothing."""
    said = said if "error" in said.columns else said.withColumn("error", F.lit(None).cast("string"))
    rows = queries.select("query_id", "answer", "relevant").join(said.withColumn("told", F.lit(True)), "query_id", "left")
    error = F.when(F.col("told").isNull(), F.lit("no answer")).otherwise(F.col("error"))
    cited = F.coalesce("cited", F.array().cast("array<string>"))
    scores = maths.citation_scores(cited, F.coalesce("relevant", F.array().cast("array<string>")))
    rows = rows.select("*", error.alias("fault"), scores.alias("s"))
    good = F.col("fault").isNull()
    return rows.select(
        "query_id",
        F.when(good, F.col("chosen")).alias("chosen"),
        F.col("answer").alias("correct_answer"),
        F.when(good, cited).otherwise(F.array().cast("array<string>")).alias("cited"),
        (good & answers.is_correct(F.col("chosen"), F.array("answer"))).alias("correct"),
        *[F.when(good, F.col(f"s.{c}")).otherwise(0.0).alias(f"citation_{c}") for c in ("precision", "recall")],
        F.when(good, F.coalesce("input_tokens", F.lit(0))).otherwise(0).cast("long").alias("input_tokens"),
        F.col("fault").alias("error"),
    )


def run(queries: DataFrame, events: DataFrame, systems: dict[str, System], task: str, length: str, done: DataFrame, write: Callable[[DataFrame], None]) -> None:
    """Ask each system what ``done`` (system, task, length, query_id) lacks of this cell; ``write`` appends the rows."""
    if length not in LENGTHS:
        raise ValueError(f"{length}: lengths are {', '.join(LENGTHS)}")
    for name, system in systems.items():
        had = done.where((F.col("system") == name) & (F.col("task") == task) & (F.col("length") == length)).select("query_id")
        left = queries.join(had, "query_id", "left_anti")
        rows = scored(left, system(left, own_events(left, events)))
        write(rows.select(F.lit(name).alias("system"), F.lit(task).alias("task"), F.lit(length).alias("length"), "*", F.lit(0).cast("long").alias("latency_ms"), F.current_timestamp().alias("asked_at")))


def sweep(spark: SparkSession, paths: dict[tuple[str, str], str], systems: dict[str, System], write: Callable[[DataFrame], None], read: Callable[[], DataFrame], sample: int | None = None) -> DataFrame:
    """Run every (task, length) of ``paths`` and sum up all rows so far; a cell that is there already is not asked again.

    ``sample``: the first so many questions of each file, if not all. Fails if it isn't positive.
    """
    if sample is not None and sample <= 0:
        raise ValueError("a sample is of 1 question or more")
    for (task, length), path in paths.items():
        events, queries = store.read_haystack(spark, path, task, sample=sample)
        run(queries, events, systems, task, length, read().select(*KEY), write)
    return summary(read())


def summary(rows: DataFrame, rounds: int = DEFAULT.bootstrap) -> DataFrame:
    """A row per system, task and length: how many are right, with the interval of that, mean scores, tokens and errors."""
    interval = evaluate.bootstrap(rows.withColumn("trial", F.lit(0)), CELL, rounds).drop("n")
    return evaluate.aggregate(rows, CELL).join(interval, CELL)
