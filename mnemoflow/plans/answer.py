"""Asking a plugged-in model: validated JSON with one retry, and answers to assembled contexts."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import model_output, prompts, text
from ..operators import answers, context
from ..sources.cut import cut
from ..sources.plugins import StageModel


def complete_valid(model: StageModel, asked: DataFrame, schema: str, required: list[str], name: str) -> DataFrame:
    """(key, data, attempts) of (key, prompt): ``data`` is the answer as the schema has it. What can't be read is asked
    once more with a reminder; what can't be read then either has no data."""

    def tried(prompts_: DataFrame, attempt: int) -> DataFrame:
        got = model.complete(prompts_).select("key", "response")
        data = model_output.conforming(model_output.extract_json(F.col("response")), schema, required)
        return got.select("key", data.alias("data"), F.lit(attempt).alias("attempts"))

    first = cut(tried(asked, 1))  # written, as a model isn't asked twice for the same answer, whatever machine is lost
    failed = asked.join(first.where("data IS NULL").select("key"), "key", "left_semi")
    again = tried(failed.select("key", prompts.reminded(F.col("prompt"), name).alias("prompt")), 2)
    return first.where("data IS NOT NULL").unionByName(again)


def complete_counted(model: StageModel, asked: DataFrame, schema: str, required: list[str], name: str, valid: Callable[[Column], Column] | None = None) -> DataFrame:
    """(key, data, attempts, input_tokens, output_tokens) for every key of ``asked``: as ``complete_valid``, with what both
    attempts cost. ``valid`` says which answers of the schema are taken. Answers are written as they come."""

    def tried(prompts_: DataFrame) -> DataFrame:
        sizes = prompts_.select("key", text.estimate_tokens(F.coalesce("prompt", F.lit(""))).cast("long").alias("input_tokens"))
        read = sizes.join(model.complete(prompts_).select("key", "response"), "key", "left")
        data = model_output.conforming(model_output.extract_json(F.col("response")), schema, required)
        kept = read.select("key", data.alias("data"), "input_tokens", text.estimate_tokens(F.coalesce("response", F.lit(""))).cast("long").alias("output_tokens"))
        return cut(kept.withColumn("data", F.when(valid(F.col("data")), F.col("data"))) if valid else kept)

    first = tried(asked.select("key", "prompt"))
    failed = asked.join(first.where("data IS NULL").select("key"), "key", "left_semi")
    again = tried(failed.select("key", prompts.reminded(F.col("prompt"), name).alias("prompt"))).select("key", *[F.col(c).alias(f"{c}_2") for c in ("data", "input_tokens", "output_tokens")])
    total = lambda c: (F.col(c) + F.coalesce(f"{c}_2", F.lit(0))).alias(c)
    both = first.join(again, "key", "left")
    return both.select("key", F.coalesce("data", "data_2").alias("data"), F.when(F.col("input_tokens_2").isNull(), 1).otherwise(2).alias("attempts"), total("input_tokens"), total("output_tokens"))


def answer(questions: DataFrame, contexts: DataFrame, model: StageModel) -> DataFrame:
    """(query_id, chosen_option, chosen_answer, cited). ``questions``: (query_id, question, options), options null for a free
    answer; ``contexts``: (query_id, context, packed, retrieved)."""
    rows = questions.join(contexts, "query_id")
    prompt = F.when(F.col("options").isNotNull(), prompts.choice(F.col("question"), F.col("options"), F.col("context"))).otherwise(prompts.free(F.col("question"), F.col("context")))
    asked = rows.select(F.col("query_id").cast("string").alias("key"), prompt.alias("prompt"))
    said = model.complete(asked).select("key", "response")
    read = rows.withColumn("key", F.col("query_id").cast("string")).join(said, "key", "left")
    one, other = answers.parse_choice(F.col("response"), F.size("options")), answers.parse_free(F.col("response"))
    read = read.select("*", F.when(F.col("options").isNotNull(), one).alias("one"), F.when(F.col("options").isNull(), other).alias("other"))
    chosen = F.coalesce(F.col("one.chosen").cast("string"), F.col("other.chosen"))
    cited = F.coalesce("one.cited", "other.cited")
    return read.select("query_id", F.col("one.chosen").alias("chosen_option"), F.col("other.chosen").alias("chosen_answer"), context.with_fallback(chosen, cited, F.col("packed"), F.col("retrieved")).alias("cited"))
