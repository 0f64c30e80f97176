"""Reports and plot data; sinks write what these return."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import maths
from .evaluate import aggregate


def rows(summary: DataFrame) -> DataFrame:
    """One line of a table per cell summary."""
    return summary.select(F.format_string("| %s | %d | %d | %.1f%% | %.2f |", "system", "model_context", "corpus_size", F.floor(F.col("accuracy") * 1000 + 0.5) / 10, maths.round2(F.col("mean_f1"))).alias("line"))


def accuracy_by_size(summary: DataFrame, context: int) -> DataFrame:
    return summary.where(F.col("model_context") == context).select("system", "corpus_size", "accuracy", maths.format_tokens(F.col("corpus_size")).alias("label"))


def claims(summary: DataFrame, expected: list[tuple[str, float]]) -> DataFrame:
    """Whether each system's accuracy is at least what is claimed."""
    wanted = summary.sparkSession.createDataFrame(expected, "system string, least_accuracy double")
    return wanted.join(summary.select("system", "n", "accuracy"), "system", "left").withColumn("holds", F.col("accuracy") >= F.col("least_accuracy"))


def vega(title: str, x: str, y: str, color: str, data: str) -> dict:
    """A chart's specification over a dataset that a sink wrote."""
    axis = lambda field, kind: {"field": field, "type": kind}
    return {"title": title, "data": {"url": data}, "mark": {"type": "line", "point": True}, "encoding": {"x": axis(x, "ordinal"), "y": axis(y, "quantitative"), "color": axis(color, "nominal")}}


def with_models(cells: DataFrame, runs: DataFrame) -> DataFrame:
    """Cells (run_id, …) with the model of their run's configuration (run_id, model)."""
    return cells.join(runs, "run_id", "left").withColumn("model", F.coalesce("model", F.lit("unknown-model")))


def headline_table(cells: DataFrame, main: str) -> DataFrame:
    """Per system, on the queries that ``main`` has answered: accuracy, F1 and costs; of ``main`` its F1 against the best other's."""
    common = cells.where(F.col("system") == main).select("query_id").distinct()
    per = aggregate(cells.join(common, "query_id", "left_semi"), ["system"]).select("system", "n", "accuracy", "mean_f1", "mean_input_tokens", "mean_latency_ms")
    best = per.where(F.col("system") != main).agg(F.max("mean_f1").alias("best"))  # one row
    ratio = F.when(F.col("system") == main, F.round(F.col("mean_f1") / F.greatest("best", F.lit(1e-9)), 6))
    return per.join(F.broadcast(best)).select(*per.columns, ratio.alias("f1_ratio"))


def headline_lines(table: DataFrame, intervals: DataFrame, main: str) -> list[str]:
    """A table in Markdown, the most accurate first. ``intervals``: (system, ci_low, ci_high). A handful of systems."""
    out = ["| System | Accuracy | 95% CI | Citation F1 | Latency | Input tokens |", "|---|---|---|---|---|---|"]
    for r in table.join(intervals, "system").orderBy(F.desc("accuracy"), "system").collect():
        mark = "**" if r.system == main else ""
        correct = int(r.accuracy * r.n + 0.5)
        out.append(f"| {mark}{r.system}{mark} | {correct}/{r.n} ({r.accuracy * 100:.0f}%) | [{r.ci_low * 100:.0f}, {r.ci_high * 100:.0f}]% | {r.mean_f1:.3f} | {r.mean_latency_ms / 1000:.0f} s | {r.mean_input_tokens:.0f} |")
    return out


def write_run(spark: SparkSession, path: str, config: dict, summary: DataFrame) -> None:
    """A run's configuration as one JSON line of sorted keys, and its summaries beside it."""
    line = json.dumps(config, sort_keys=True)
    spark.createDataFrame([(line,)], "value string").coalesce(1).write.text(f"{path}/config")
    summary.select(*sorted(summary.columns)).orderBy("system", "model_context", "corpus_size").coalesce(1).write.json(f"{path}/summary")


def read_config(spark: SparkSession, path: str) -> dict:
    """A run's configuration; empty if none was written."""
    from ..sources.store import exists

    rows = spark.read.text(f"{path}/config").collect() if exists(spark, f"{path}/config") else []
    return json.loads(rows[0].value) if rows else {}


def pivoted(summary: DataFrame, value: str = "accuracy") -> DataFrame:
    """A row per size and context, a column per system."""
    return summary.groupBy("model_context", "corpus_size").pivot("system").agg(F.first(value))
