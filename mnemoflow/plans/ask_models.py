"""The read pipeline with a model for each stage: probes, recalls and packets are what the models say, checked and counted."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..config import DEFAULT, Config
from ..functions import model_output, prompts, text
from ..operators import folds, router
from ..sources.cut import cut
from ..sources.model import Baked, baked
from ..sources.plugins import StageModel
from .answer import complete_counted

# What a probe may say.
MEMORY_TYPES = ("direct", "adjacent", "conflicting", "vague", "none")
ANSWER_VALUES = ("none", "low", "medium", "high")

PROBE = "knows boolean, confidence double, memory_type string, answer_value string, needs_recall boolean, relevant array<string>"
RECALL = "confidence double, answer string, claims string, unknowns array<string>, conflicts array<string>"
PACKET = "summary string, key_claims string, conflicts array<string>, caveats array<string>, context string"
SNAPSHOT = "S001"
_NONE = "array<string>"


@dataclass(frozen=True)
class Models:
    """A model for each stage; the deterministic ones answer as ``ask`` does."""

    probe: StageModel = field(default_factory=Baked)
    recall: StageModel = field(default_factory=Baked)
    synthesis: StageModel = field(default_factory=Baked)


def _share(c: Column) -> Column:
    return c.between(0, 1)


def _probe_fits(d: Column) -> Column:
    return _share(d["confidence"]) & d["memory_type"].isin(*MEMORY_TYPES) & d["answer_value"].isin(*ANSWER_VALUES)


def _list(c: str) -> Column:
    return F.coalesce(c, F.array().cast(_NONE))


def _stage(name: str, model: StageModel, rows: DataFrame, schema: str, required: list[str], said: DataFrame | None, valid=None) -> tuple[DataFrame, DataFrame]:
    """The rows (query_id, shard_id, question, body, ...) with the stage's data, and a fact for each call.

    ``said``: (query_id, shard_id, answer) of the deterministic stage, which a ``Baked`` model is handed in its prompt.
    """
    keys = ["query_id", "shard_id"]
    prompt = prompts.stage(name, F.col("shard_id"), F.col("question"), F.coalesce("body", F.lit("")))
    asked = rows.withColumn("key", F.to_json(F.struct(*keys)))
    if isinstance(model, Baked):
        known = said.select(F.to_json(F.struct(*keys)).alias("key"), "answer")
        asked = asked.join(known, "key", "left").withColumn("prompt", F.concat(prompt, baked(F.coalesce("answer", F.lit(""))))).drop("answer")
    else:
        asked = asked.withColumn("prompt", prompt)
    asked = cut(asked.drop("body", "question"))
    got = cut(complete_counted(model, asked.select("key", "prompt"), schema, required, name, valid))
    facts = asked.select("key", *keys).join(got, "key").select("query_id", F.lit(name).alias("stage"), F.col("shard_id").cast("string").alias("shard_id"), "attempts", "input_tokens", "output_tokens", F.col("data").isNull().alias("failed"))
    return asked.drop("prompt").join(got.select("key", "data"), "key").drop("key"), facts


def ask_models(questions: DataFrame, corpus: DataFrame, ref: Column, models: Models | None = None, config: Config = DEFAULT, events: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """Packets and calls.

    Packets: (query_id, n_routed, n_recalls, n_failed, summary, key_claims, caveats, conflicts, context), one for each question; calls:
    (query_id, stage, shard_id, attempts, input_tokens, output_tokens, failed), with what all attempts of a call cost.

    A probe goes to each routed shard, a recall to the shards whose probe wants it and to the router's first choice, and the
    merging model is asked where there are two recalls or more only. An answer that isn't what its stage asks for is asked
    for once more; a probe or a recall that fails then is left out and counted; where merging fails the packet is null.
    Questions are told by their ``query_id``, which must be unique and not null; a null text is an empty question.
    ``events`` may be the corpus without its labels, which only the directory needs.
    Each stage's answers are written before the next one starts, so that a lost executor asks no model twice for a stage that has ended.
    """
    models = models or Models()
    questions = questions.select("query_id", F.coalesce("question", F.lit("")).alias("question"))
    entries = cut(router.directory(corpus))
    corpus = corpus if events is None else events
    routed = cut(router.candidates(questions, entries, ref))

    pairs = routed.where(F.col("rank") <= config.probe_shards).select("query_id", "shard_id")
    index = router.probe_index(questions, corpus, pairs, config.probe_index_chars).select("query_id", "shard_id", "digest")
    about = entries.select(F.col("id").alias("shard_id"), "summary_short")
    rows = pairs.join(questions, "query_id").join(about, "shard_id").join(index, ["query_id", "shard_id"], "left")
    rows = rows.select("query_id", "shard_id", "question", F.concat(F.lit("SUMMARY: "), "summary_short", F.lit("\n\nEVENTS:\n"), F.coalesce("digest", F.lit("(no events)"))).alias("body"))
    said = None
    if isinstance(models.probe, Baked):
        found = router.probes(questions, corpus, entries, pairs)
        said = found.select("query_id", "shard_id", F.to_json(F.struct("knows", "confidence", "memory_type", "answer_value", "needs_recall", F.col("relevant").cast(_NONE).alias("relevant"))).alias("answer"))
    probed, probe_calls = _stage("probe", models.probe, rows, PROBE, ["knows", "confidence", "memory_type", "answer_value", "needs_recall"], said, _probe_fits)
    ids = f"array<{corpus.schema['event_id'].dataType.simpleString()}>"
    relevant = F.filter(F.coalesce(F.col("data.relevant"), F.array().cast(_NONE)).try_cast(ids), lambda e: e.isNotNull())
    answers = probed.where("data IS NOT NULL").select("query_id", "shard_id", "data.knows", "data.confidence", "data.memory_type", "data.answer_value", "data.needs_recall", relevant.alias("relevant"))

    targets = cut(router.recall_targets(answers, routed, config.recall_shards))
    digest = router.recall_digest(corpus, targets, config.recall_tokens).select("query_id", "shard_id", "digest")
    rows = targets.select("query_id", "shard_id", "place").join(questions, "query_id").join(digest, ["query_id", "shard_id"], "left")
    rows = rows.select("query_id", "shard_id", "place", "question", F.concat(F.lit("EVENTS:\n"), F.coalesce("digest", F.lit("(no events)"))).alias("body"))
    said = _baked_recalls(questions, corpus, targets) if isinstance(models.recall, Baked) else None
    heard, recall_calls = _stage("recall", models.recall, rows, RECALL, ["confidence", "answer"], said, lambda d: _share(d["confidence"]))
    source = F.concat(F.col("shard_id").cast("string"), F.lit(f"@{SNAPSHOT}"))
    claims = F.transform(model_output.tolerant_claims(F.col("data.claims")), lambda c: F.struct(c["claim"].alias("claim"), F.transform(c["support"], lambda e: F.concat(source, F.lit(":"), e)).alias("support"), c["confidence"].alias("confidence")))
    recalled = cut(heard.where("data IS NOT NULL").select("query_id", "shard_id", "place", source.alias("source"), "data.confidence", "data.answer", claims.alias("claims"), _list("data.unknowns").alias("unknowns"), _list("data.conflicts").alias("conflicts")))

    # a question has a few recalls, config.recall_shards at most
    per = cut(recalled.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "shard_id", "source", "confidence", "answer", "claims", "unknowns", "conflicts"))).alias("recalls")))
    many = per.where(F.size("recalls") > 1)
    rows = many.join(questions, "query_id").select("query_id", F.lit(None).cast("string").alias("shard_id"), "question", F.to_json("recalls").alias("body"))
    said = None
    if isinstance(models.synthesis, Baked):
        merged = folds.synthesize(recalled.join(many.select("query_id"), "query_id", "left_semi"), as_json=True)
        flat = lambda c: F.flatten(F.transform("recalls", lambda r: r[c]))
        more = many.select("query_id", flat("unknowns").alias("caveats"), flat("conflicts").alias("conflicts"))
        # the claims are JSON already and stay as a text, which is read alike
        said = merged.join(more, "query_id").select("query_id", F.lit(None).cast("string").alias("shard_id"), F.to_json(F.struct("summary", "key_claims", "caveats", "conflicts", "context")).alias("answer"))
    joined, packet_calls = _stage("synthesis", models.synthesis, rows, PACKET, ["summary", "context"], said)

    calls = probe_calls.unionByName(recall_calls).unionByName(packet_calls)
    return _packets(questions, routed, per, joined, calls), calls


def _baked_recalls(questions: DataFrame, corpus: DataFrame, targets: DataFrame) -> DataFrame:
    """The deterministic recalls as JSON; a shard none of whose events has a word of the question says so."""
    found = router.recalls(questions, corpus, targets).select("query_id", "shard_id", "confidence", "answer", F.transform("claims", lambda c: F.struct(c["claim"].alias("claim"), F.transform(c["support"], lambda s: F.substring_index(s, ":", -1)).alias("support"), c["confidence"].alias("confidence"))).alias("claims"))
    rows = targets.select("query_id", "shard_id").join(questions.select("query_id", F.array_distinct(text.tokenize_router(F.col("question"))).alias("terms")), "query_id").join(found, ["query_id", "shard_id"], "left")
    none = F.col("answer").isNull()
    # What a shard says that has nothing.
    unknown = F.concat(F.lit("No events in this shard mention: "), F.array_join(F.slice("terms", 1, 5), ", "))
    answer = F.struct(
        F.coalesce("confidence", F.lit(0.0)).alias("confidence"),
        F.coalesce("answer", F.lit("This shard does not contain information about the query.")).alias("answer"),
        F.coalesce("claims", F.array().cast(found.schema["claims"].dataType)).alias("claims"),
        F.when(none, F.array(unknown)).otherwise(F.array().cast(_NONE)).alias("unknowns"),
        F.array().cast(_NONE).alias("conflicts"),
    )
    return rows.select("query_id", "shard_id", F.to_json(answer).alias("answer"))


def _packets(questions: DataFrame, routed: DataFrame, per: DataFrame, joined: DataFrame, calls: DataFrame) -> DataFrame:
    n = F.coalesce(F.size("recalls"), F.lit(0))
    rows = questions.select("query_id").join(per, "query_id", "left").join(joined.select("query_id", "data"), "query_id", "left")
    one = F.get("recalls", F.lit(0))
    own = F.transform(one["claims"], lambda c: F.struct(c["claim"].alias("claim"), c["support"].alias("sources"), c["confidence"].alias("confidence")))
    by = lambda none, single, many: F.when(n == 0, none).when(n == 1, single).when(F.col("data").isNotNull(), many)
    empty = F.array().cast(_NONE)
    merged = model_output.tolerant_claims(F.col("data.key_claims"), "sources")
    # What an empty packet says.
    packets = rows.select(
        "query_id",
        n.cast("long").alias("n_recalls"),
        by(F.lit("No relevant memory found in any consulted shard."), one["answer"], F.col("data.summary")).alias("summary"),
        by(F.array().cast("array<struct<claim:string,sources:array<string>,confidence:double>>"), own, merged).alias("key_claims"),
        by(F.array(F.lit("Searched shards yielded no recall.")), one["unknowns"], _list("data.caveats")).alias("caveats"),
        by(empty, one["conflicts"], _list("data.conflicts")).alias("conflicts"),
        by(F.lit("No memory packet available; answer from general knowledge."), F.concat(one["source"], F.lit(": "), one["answer"]), F.col("data.context")).alias("context"),
    )
    sent = routed.groupBy("query_id").agg(F.count("*").alias("n_routed"))
    failed = calls.groupBy("query_id").agg(F.sum(F.col("failed").cast("long")).alias("n_failed"))
    whole = packets.join(sent, "query_id", "left").join(failed, "query_id", "left")
    return whole.select("query_id", *[F.coalesce(c, F.lit(0)).alias(c) for c in ("n_routed", "n_recalls", "n_failed")], "summary", "key_claims", "caveats", "conflicts", "context")
