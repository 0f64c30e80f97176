"""The engine's tables as views of the tables at hand. Each is a projection; nothing is collected."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import estimate_tokens


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Benchmark events: event_id, shard_id, content, token_count, is_core, tier, tags."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels").select("doc_id", "quality")
    core = F.coalesce(F.col("quality") == 1, F.lit(False))
    docs = docs.withColumn("tokens", estimate_tokens(F.col("text")))  # before the join, so that it can do without texts
    return docs.join(labels, "doc_id", "left").select(
        F.col("doc_id").alias("event_id"),
        F.col("source").alias("shard_id"),
        F.col("text").alias("content"),
        F.col("tokens").alias("token_count"),
        core.alias("is_core"),
        F.when(core, 0).otherwise(1 + F.col("doc_id") % 4).cast("int").alias("tier"),
        F.array("lang", "source").alias("tags"),
    )


def events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The corpus without the labels' columns, which needs no join."""
    return table(spark, sf_dir, "documents").select(F.col("doc_id").alias("event_id"), F.col("source").alias("shard_id"), F.col("text").alias("content"), F.array("lang", "source").alias("tags"))


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """query_id and question, the item's whole text."""
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("question"))


def vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("event_id"), F.col("embedding").alias("vec"), "label")


def turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversation turns as events with a dated head; their place in the conversation gives the date."""
    day = F.date_add(F.lit("2024-01-01").cast("date"), ((F.col("conv_id") * 3 + F.col("turn")) % 700).cast("int"))
    content = F.concat(F.lit("[Turn "), F.col("turn").cast("string"), F.lit("] "), F.initcap("role"), F.lit(": "), F.col("text"), F.lit(" on "), day.cast("string"))
    event_id = F.concat(F.lit("conv-"), F.col("conv_id").cast("string"), F.lit("#turn-"), F.col("turn").cast("string"))
    return table(spark, sf_dir, "conversations").select(event_id.alias("event_id"), F.col("conv_id").alias("shard_id"), "turn", "role", content.alias("content"), day.alias("day"))


def cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Result cells of a sweep, from order lines: each line is an answered query with scores and costs."""
    k = F.col("l_orderkey")
    return (
        table(spark, sf_dir, "lineitem")
        .groupBy("l_orderkey", "l_linenumber")
        .agg(F.max("l_suppkey").alias("s"), F.sum("l_quantity").alias("q"), F.max("l_partkey").alias("p"))
        .select(
            F.element_at(F.array(*map(F.lit, ["memory", "vanilla", "hybrid", "longctx"])), (F.col("s") % 4 + 1).cast("int")).alias("system"),
            F.element_at(F.array(*[F.lit(x) for x in (100_000, 1_000_000, 10_000_000)]), (F.col("l_linenumber") % 3 + 1).cast("int")).cast("long").alias("corpus_size"),
            F.when(k % 2 == 0, 8192).otherwise(32_768).cast("long").alias("model_context"),
            (k % 3).cast("int").alias("trial"),
            F.concat(F.lit("q"), (k % 97).cast("string")).alias("query_id"),
            ((F.col("p") * 7 + k) % 10 < 7 - F.col("l_linenumber") % 3 * 2).alias("correct"),
            (F.col("p") % 5 / 4).alias("citation_precision"),
            (F.col("s") % 3 / 2).alias("citation_recall"),
            F.col("q").cast("long").alias("input_tokens"),
            (k % 1000).alias("latency_ms"),
            F.when(k % 31 == 0, "timeout").alias("error"),
            (k * 10 + F.col("l_linenumber")).alias("line_no"),
        )
    )
