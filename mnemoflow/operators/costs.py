"""Costs of runs: a fact for each stage's call, totals of all of them, and cells whose totals left the stages out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# A cell's measures, what its ``meta`` calls them and what a packet's cost calls them.
MEASURES = {
    "input_tokens": ("InputTokens", "inputTokensEstimate"),
    "output_tokens": ("OutputTokens", "outputTokensEstimate"),
    "latency_ms": ("LatencyMs", "latencyMs"),
}
MARK = "$.finalCallInputTokens"


def by_stage(calls: DataFrame, stages: tuple[str, ...] = ("probe", "recall", "synthesis")) -> DataFrame:
    """(query_id, calls, input_tokens, output_tokens, <stage>_tokens...): what a question's calls cost, all attempts of them."""
    each = [F.coalesce(F.sum(F.when(F.col("stage") == s, F.col("input_tokens") + F.col("output_tokens"))), F.lit(0)).alias(f"{s}_tokens") for s in stages]
    return calls.groupBy("query_id").agg(F.sum("attempts").alias("calls"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"), *each)


def _number(meta: Column, path: str) -> Column:
    """A whole number in an open map; 0 where it is missing or something else."""
    return F.coalesce(F.try_variant_get(meta, path, "long"), F.lit(0).cast("long"))


def _marked(meta: Column) -> Column:
    return F.coalesce(F.variant_get(meta, MARK, "variant").isNotNull(), F.lit(False))


def mend(cells: DataFrame, system: str) -> DataFrame:
    """Cells whose measures are those of all calls, with the pipeline's and the last call's share in ``meta`` (a VARIANT); ``mended``: whether a cell was changed.

    A cell of ``system`` without the mark gets its packet's cost added, null measures counting as 0. One that has it, or is of
    another system, stays as it is, so that mending again changes nothing. A ``meta`` that is null or no object counts as an empty one.
    """
    at = F.coalesce(F.col("system") == system, F.lit(False)) & ~_marked(F.col("meta"))
    rows = cells.withColumn("mended", at)
    added, shares = {}, []
    for measure, (name, packet) in MEASURES.items():
        if measure not in cells.columns:
            continue
        kind = cells.schema[measure].dataType
        last, before = F.coalesce(F.col(measure).cast("long"), F.lit(0).cast("long")), _number(F.col("meta"), f"$.packetCost.{packet}")
        added[measure] = F.when(F.col("mended"), (last + before).cast(kind)).otherwise(F.col(measure))
        shares += [(f"finalCall{name}", last), (f"pipeline{name}", before)]
    held = F.coalesce(F.col("meta").try_cast("map<string,variant>"), F.create_map().cast("map<string,variant>"))
    other = F.map_filter(held, lambda k, _: ~k.isin(*[k for k, _ in shares]))
    new = F.create_map(*[x for k, v in shares for x in (F.lit(k), v.cast("variant"))])
    meta = F.when(F.col("mended"), F.to_variant_object(F.map_concat(other, new))).otherwise(F.col("meta"))
    return rows.select(*[added.get(c, meta if c == "meta" else F.col(c)).alias(c) for c in cells.columns], "mended")


def unbalanced(cells: DataFrame) -> DataFrame:
    """Cells with the mark whose measures aren't the pipeline's and the last call's together."""
    off = F.lit(False)
    for measure, (name, _) in MEASURES.items():
        if measure in cells.columns:
            off = off | (F.coalesce(F.col(measure).cast("long"), F.lit(0).cast("long")) != _number(F.col("meta"), f"$.pipeline{name}") + _number(F.col("meta"), f"$.finalCall{name}"))
    return cells.where(_marked(F.col("meta")) & off)
