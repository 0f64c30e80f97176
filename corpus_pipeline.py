"""Five stages from raw documents to a mixed training set.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame; its result is
written as Parquet and read again before the next. All but the last return
the columns they were given.

Defined results: a null text is empty; every row is judged by its own text,
whether it has an id of its own, shares one or has none.
"""

from __future__ import annotations

from collections.abc import Callable

from mnemoflow.llm import decontaminate, mixing, ngram_join, personal_data, quality
from mnemoflow.llm.catalog import QUALITY, fold
from mnemoflow.llm.scratch import delete, new_path, temporary, write
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What tells rows apart: their id, if any, as text, and a hash of their text.
KEY = ["__id", "__hash"]


def _plain(docs: DataFrame) -> tuple[DataFrame, list[str]]:
    """The columns by number, so that none clashes with an operator's own; the names needed are kept beside."""
    names = docs.columns
    return docs.toDF(*[n if n in ("doc_id", "text", "source", "n_chars") else f"__column_{k}" for k, n in enumerate(names)]), names


def _id() -> Column:
    return F.coalesce(F.col("doc_id").cast("string"), F.lit(""))


def _keyed(rows: DataFrame) -> DataFrame:
    return rows.withColumn("__id", _id()).withColumn("__hash", F.coalesce(F.xxhash64("text"), F.lit(0)))


def drop_low_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the nearest labelled ones vote for; labels come from the training folds."""
    rows, names = _plain(docs)
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where(fold("doc_id", 5) != 0)
    voters = quality.fit(rows, labels)
    return quality.score(rows, voters, rows.columns).where(F.col("score") >= QUALITY).drop("score").toDF(*names)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of documents linked by five-word shingles at 0.8 or more, the one of the smallest id,
    and of equal ids of the smallest hash. Documents without words are in no group and stay."""
    rows, names = _plain(docs)
    at = new_path(spark, "near-copies")
    with temporary():
        found = ngram_join.jaccard_components(rows, size=5, percent=80).where("n_shingles > 0")
        found = write(found.select(_id().alias("__id"), F.col("text_hash").alias("__hash"), "set_digest", "leads"), at)
    copies = found.where("NOT leads").select(KEY).distinct()
    kept = _keyed(rows).join(copies, KEY, "left_anti")
    # rows of one id whose texts are equal, or have equal sets
    alike = found.where("leads").groupBy("__id", "set_digest").agg(F.count("*").alias("many"), F.min("__hash").alias("first")).where("many > 1")
    if alike.limit(1).count():
        members = found.where("leads").join(alike, ["__id", "set_digest"]).select(*KEY, (F.col("__hash") == F.col("first")).alias("stays")).distinct()
        first = kept.join(members.where("stays"), KEY, "left_semi").dropDuplicates(KEY)
        kept = kept.join(members, KEY, "left_anti").unionByName(first)
    return kept.select(rows.columns).toDF(*names)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item, exactly or with its words moved or up to SLOP put in."""
    rows, names = _plain(docs)
    at = new_path(spark, "contaminated")
    with temporary():
        found = decontaminate.decontaminate(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), slop=decontaminate.SLOP)
        hit = write(found.where("n_hit > 0 OR n_near > 0").select(_id().alias("__id"), F.col("text_hash").alias("__hash")).distinct(), at)
    return _keyed(rows).join(hit, KEY, "left_anti").select(rows.columns).toDF(*names)


def mask_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, each span of personal data replaced by its kind in brackets."""
    rows, names = _plain(docs)
    found = personal_data.find(rows, personal_data.fit(rows), rows.columns)
    length = F.length("masked").cast(rows.schema["n_chars"].dataType) if "n_chars" in names else None
    changed = [F.col("masked").alias("text") if n == "text" else length.alias(n) if n == "n_chars" else F.col(n) for n in rows.columns]
    return found.select(*changed).toDF(*names)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The mixed set, one row per document: doc_id, size, source_size, target, taken, its ``text`` and its
    ``pieces``, the words of it that go into each slot; ``mixing.stream`` lays them out in the order of the slots."""
    return mixing.texts(mixing.mix(docs), docs)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality", drop_low_quality),
    ("near copies", drop_near_copies),
    ("decontamination", drop_contaminated),
    ("personal data", mask_personal_data),
    ("mixing", mix_sources),
]

#: SQL can't express the classifiers; tests hold run() against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``. What a stage stored goes once its result is written, its result once the next one's is."""
    docs, last = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        at = new_path(spark, "stage-" + name.replace(" ", "-"))
        with temporary():
            docs = write(stage(spark, docs, sf_dir), at)
        if last:
            delete(last)
        last = at
    return docs
