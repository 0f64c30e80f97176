"""From a packet and its recalls to the context that an answering model reads."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.model_output import source_event
from ..functions.text import estimate_tokens
from .best import of_events
from .rank import prefix_pack
from .retrieval import context_line


def cited(sources: Column) -> Column:
    """Distinct events that an array of sources names, in order."""
    return F.array_distinct(F.array_compact(F.transform(sources, source_event)))


def recalled(claims: Column) -> Column:
    """Distinct events that support an array of claims, in order."""
    return F.array_distinct(F.flatten(F.transform(claims, lambda c: c["support"])))


def retrieval_order(cited_ids: Column, recalled_ids: Column) -> Column:
    """Cited events, then recalled ones, each at its first place."""
    none = F.array().cast("array<string>")
    return F.array_distinct(F.concat(F.coalesce(cited_ids, none), F.coalesce(recalled_ids, none)))


# Own wording; the parts and their order are fixed.
def header(summary: Column, claims: Column, conflicts: Column, caveats: Column) -> Column:
    """``claims``: (claim, sources, confidence)."""
    line = lambda c: F.concat(F.lit("- "), c["claim"], F.lit(" (sources: "), F.array_join(c["sources"], ", "), F.lit(", conf="), F.format_string("%.2f", c["confidence"]), F.lit(")"))
    listed = F.when(F.size(claims) > 0, F.array_join(F.transform(claims, line), "\n")).otherwise(F.lit("- (no key claims surfaced)"))
    part = lambda name, xs: F.when(F.size(xs) > 0, F.concat(F.lit(f"\n{name}:\n"), F.array_join(F.transform(xs, lambda x: F.concat(F.lit("- "), x)), "\n")))
    return F.concat_ws("\n", F.lit("MEMORY PACKET:"), F.concat(F.lit("SUMMARY: "), summary), F.concat(F.lit("KEY CLAIMS:\n"), listed), part("CONFLICTS", conflicts), part("CAVEATS", caveats))


def assemble(packets: DataFrame, orders: DataFrame, corpus: DataFrame, budget: int) -> DataFrame:
    """(query_id, context, context_tokens, packed): the header, then the events of the order while both fit the budget.

    ``packets``: (query_id, header); ``orders``: (query_id, place, event_id); events that the corpus lacks are passed over.
    """
    heads = packets.select("query_id", "header", estimate_tokens(F.col("header")).alias("head_tokens"))
    line = context_line(F.col("event_id"), F.col("content"))
    lines = orders.join(of_events(corpus, orders).select("event_id", line.alias("line"), estimate_tokens(line).alias("tokens")), "event_id").join(heads.select("query_id", "head_tokens"), "query_id")
    fitting = prefix_pack(lines, ["query_id"], [F.asc("place")], F.col("tokens"), budget - F.col("head_tokens"))
    packed = fitting.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("place", "event_id", "line"))).alias("p"), F.sum("tokens").alias("used"))
    rows = heads.join(packed, "query_id", "left")
    events = F.when(F.col("p").isNull(), "CITED EVENTS:\n(none)\n").otherwise(F.concat(F.lit("CITED EVENTS:\n"), F.array_join(F.col("p.line"), "")))
    return rows.select(
        "query_id",
        F.concat("header", F.lit("\n"), events).alias("context"),
        (F.col("head_tokens") + F.coalesce("used", F.lit(0))).alias("context_tokens"),
        F.coalesce(F.transform("p", lambda x: x["event_id"].cast("string")), F.array().cast("array<string>")).alias("packed"),
    )


def with_fallback(chosen: Column, cited_ids: Column, packed: Column, retrieved: Column) -> Column:
    """Citations of an answer; of one that cites nothing, what was packed, else what was retrieved."""
    used = F.when(F.size(packed) > 0, packed).otherwise(retrieved)
    return F.when(chosen.isNotNull() & (F.size(cited_ids) == 0), used).otherwise(cited_ids)


def ordered(rows: DataFrame) -> DataFrame:
    """(query_id, place, event_id) of (query_id, order): arrays laid out."""
    return rows.select("query_id", F.posexplode("order").alias("place", "event_id"))


def latest_text(events: DataFrame, text: str = "content", place: str = "event_id") -> DataFrame:
    """(text_sha, event_id): what text stands for which event; of events with the same text the last one wins."""
    return events.groupBy(F.sha2(F.col(text), 256).alias("text_sha")).agg(F.max_by("event_id", place).alias("event_id"))


def reverse_lookup(retrieved: DataFrame, events: DataFrame, text: str = "content") -> DataFrame:
    """``retrieved`` (…, ``text``) with the event of equal text, or null."""
    return retrieved.withColumn("text_sha", F.sha2(F.col(text), 256)).join(latest_text(events, text), "text_sha", "left").drop("text_sha")
