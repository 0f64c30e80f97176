"""The registered queries of this subpackage, and their SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import conversations, exact_dedup, importance, language_id, licenses, mixing, neighbours, ngram_join, oracles, personal_data, quality, substrings, token_counts
from .decontaminate import SLOP, decontaminate


def fold(doc_id: str, parts: int):
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")) % parts


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))
    return found.select(
        "doc_id",
        "n_words",
        "n_hit",
        F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"),
        (F.col("n_hit") > 0).alias("contaminated"),
    )


def op1_decontaminate_near(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Exact and proximity matches; ``contaminated`` by either."""
    found = decontaminate(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"), slop=SLOP)
    return found.select("doc_id", "n_words", "n_hit", "n_near", ((F.col("n_hit") > 0) | (F.col("n_near") > 0)).alias("contaminated"))


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    model = language_id.fit(docs, fold("doc_id", 4) != 2)
    marked = docs.select("doc_id", (fold("doc_id", 4) == 2).alias("held_out"), "text")
    return language_id.predict(marked, model, ["doc_id", "held_out"])


def op3_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts.token_counts(_table(spark, sf_dir, "documents"), token_counts.read_vocabulary(token_counts.VOCABULARY), ["doc_id"])


def _joined(spans: str):
    """kind:start:end of each span, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def _same(kind: str):
    return lambda k: F.when(k == kind, 1)


def op4_personal_data(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents").select("doc_id", "text")
    found = personal_data.find(docs, personal_data.fit(docs), ["doc_id"])
    counts = [F.size(F.array_compact(F.transform("base.kind", _same(k)))).cast("long").alias(f"n_{k}") for k in personal_data.BASE_KINDS]
    return found.select("doc_id", *counts, F.sha2(_joined("base"), 256).alias("base_sha256"), _joined("spans").alias("spans"))


def op6_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix(_table(spark, sf_dir, "documents")).documents


def op7_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"), ["doc_id"])
    labels = lambda *cols: F.array_join(F.array_sort(F.array_distinct(F.concat(*cols))), ",")
    return found.select(
        "doc_id",
        "n_words",
        F.size("places").cast("long").alias("n_base"),
        F.array_min("places.start").cast("long").alias("first_word"),
        F.array_max("places.start").cast("long").alias("last_word"),
        labels("places.label").alias("base_labels"),
        labels("places.label", "matches.label", "runs.label").alias("labels"),
        F.when(F.size("places") > 0, 1.0).otherwise(F.coalesce(F.greatest(F.array_max("matches.containment"), F.array_max("runs.containment")), F.lit(0.0))).alias("score"),
    )


#: Documents with a score below it are rejected.
QUALITY = 0.3


def op8_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    voters = quality.fit(docs, _table(spark, sf_dir, "labels").where(fold("doc_id", 5) != 0))
    marked = docs.select("doc_id", (fold("doc_id", 5) == 0).alias("held_out"), "text")
    return quality.score(marked, voters, ["doc_id", "held_out"]).withColumn("predicted", (F.col("score") >= QUALITY).cast("int"))


def op9_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where(F.col("vec_id") % 100 == 0))


def op10_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = ngram_join.jaccard_components(_table(spark, sf_dir, "documents"), size=3, percent=90)
    return found.select("doc_id", "n_shingles", "component_id", "n_links")


def op5_substrings(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = substrings.deduplicate(_table(spark, sf_dir, "documents"))
    return kept.select("doc_id", "n_words", "n_removed", "kept_sha256")


def op11_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def op12_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return conversations.repair(conversations.damaged(_table(spark, sf_dir, "conversations")))


def op13_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_dedup.deduplicate(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_decontaminate": op1_decontaminate,
    "op1_decontaminate_near": op1_decontaminate_near,
    "op2_language_id": op2_language_id,
    "op3_token_counts": op3_token_counts,
    "op4_personal_data": op4_personal_data,
    "op5_substrings": op5_substrings,
    "op6_mixing": op6_mixing,
    "op7_licenses": op7_licenses,
    "op8_quality": op8_quality,
    "op9_nearest": op9_nearest,
    "op10_ngram_join": op10_ngram_join,
    "op11_importance": op11_importance,
    "op12_conversations": op12_conversations,
    "op13_exact_dedup": op13_exact_dedup,
}

ORACLES: dict[str, str] = oracles.SQL
