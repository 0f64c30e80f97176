"""Scoring, summaries, intervals, paired tests and sweeps, over the fact table of result cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions import maths
from ..sources.cut import cut
from . import resample
from .rank import latest_wins

CELL = ["system", "model_context", "corpus_size", "trial", "query_id"]
GROUP = ["system", "model_context", "corpus_size"]


def current_cells(cells: DataFrame) -> DataFrame:
    """The last row of each cell wins, so that a cell run again counts once."""
    return latest_wins(cells, CELL, "line_no")


def _mean(c: str | Column) -> Column:
    return F.round(F.coalesce(F.avg(c), F.lit(0.0)), 6)


def aggregate(cells: DataFrame, keys: list[str]) -> DataFrame:
    f1 = F.when(F.col("citation_precision") + F.col("citation_recall") == 0, 0.0).otherwise(2 * F.col("citation_precision") * F.col("citation_recall") / (F.col("citation_precision") + F.col("citation_recall")))
    return cells.groupBy(*keys).agg(
        F.count("*").alias("n"),
        _mean(F.col("correct").cast("double")).alias("accuracy"),
        _mean("citation_precision").alias("mean_precision"),
        _mean("citation_recall").alias("mean_recall"),
        _mean(f1).alias("mean_f1"),
        _mean("input_tokens").alias("mean_input_tokens"),
        _mean("latency_ms").alias("mean_latency_ms"),
        F.sum(F.col("error").isNotNull().cast("long")).alias("errors"),
    )


def early_stops(cells: DataFrame, threshold: float = DEFAULT.early_stop) -> DataFrame:
    """The least size at which a system in a context fell below the threshold; errors count as wrong."""
    per = cells.groupBy(*GROUP).agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return per.groupBy("system", "model_context").agg(F.min(F.when(F.col("accuracy") < threshold, F.col("corpus_size"))).alias("failed_at"))


def summaries(cells: DataFrame) -> DataFrame:
    rows = aggregate(cells, GROUP).join(early_stops(cells), ["system", "model_context"])
    return rows.withColumn("early_stopped", F.coalesce(F.col("corpus_size") > F.col("failed_at"), F.lit(False))).drop("failed_at")


def not_stopped(grid: DataFrame, stops: DataFrame) -> DataFrame:
    """Cells below the size at which their system was stopped."""
    return grid.join(stops, ["system", "model_context"], "left").where("failed_at IS NULL OR corpus_size < failed_at").drop("failed_at")


def bootstrap(cells: DataFrame, keys: list[str], rounds: int, seed: int = DEFAULT.seed) -> DataFrame:
    """95 % interval of the accuracy: means of seeded resamples, in order, by index without interpolation.

    Outcomes, in the order of their questions and trials, are bits in blocks (``resample``); an outcome that is null counts as wrong.
    """
    right = F.coalesce(F.col("correct").cast("int"), F.lit(0))
    packed = resample.blocks(resample.numbered(cells, keys, ["query_id", "trial"], right, cut), keys)
    return resample.interval(resample.round_hits(packed, keys, rounds, seed), keys, rounds)


def paired(cells: DataFrame, a: str, b: str, keys: list[str]) -> DataFrame:
    side = lambda s, c: cells.where(F.col("system") == s).select(*keys, F.col("correct").alias(c))
    return side(a, "a").join(side(b, "b"), keys)


def mcnemar(cells: DataFrame, a: str, b: str, keys: list[str], alpha: float = DEFAULT.alpha) -> DataFrame:
    """Discordant counts, the exact two-sided p, and the winner at alpha."""
    counts = paired(cells, a, b, keys).agg(*[F.count_if(test).alias(n) for n, test in (("a_only", F.col("a") & ~F.col("b")), ("b_only", ~F.col("a") & F.col("b")), ("both_right", F.col("a") & F.col("b")), ("neither", ~F.col("a") & ~F.col("b")))])
    p = maths.binomial_p(F.col("a_only"), F.col("b_only"))
    winner = F.when((F.col("p") < alpha) & (F.col("a_only") > F.col("b_only")), a).when((F.col("p") < alpha) & (F.col("a_only") < F.col("b_only")), b).otherwise("tie")
    return counts.withColumn("p", F.round(p, 9)).withColumn("winner", winner)


def benjamini_hochberg(tests: DataFrame, p: str = "p", key: str = "id") -> DataFrame:
    """Adjusted p: from the largest down, the least of p * n / rank so far. The number of tests is small, so one task orders them."""
    w = Window.orderBy(p, key)
    ranked = tests.withColumn("rank", F.row_number().over(w)).withColumn("n", F.count("*").over(Window.partitionBy()))
    back = w.rowsBetween(Window.currentRow, Window.unboundedFollowing)
    return ranked.withColumn("adjusted", F.round(F.least(F.lit(1.0), F.min(F.col(p) * F.col("n") / F.col("rank")).over(back)), 9)).drop("n", "rank")


def multiplier(summary: DataFrame, context: int, threshold: float = DEFAULT.accuracy) -> DataFrame:
    at = summary.where(F.col("model_context") == context)
    return at.groupBy("system").agg(F.coalesce(F.max(F.when(F.col("accuracy") >= threshold, F.col("corpus_size"))), F.lit(0)).alias("max_size")).withColumn("multiplier", F.round(F.col("max_size") / context, 6))


def headline_cell(cells: DataFrame, size: int, context: int) -> DataFrame:
    """Per system the exact cell, else the one of the most rows (the smallest first)."""
    per = cells.groupBy(*GROUP).agg(F.count("*").alias("rows"))
    w = Window.partitionBy("system").orderBy(F.desc((F.col("corpus_size") == size) & (F.col("model_context") == context)), F.desc("rows"), "model_context", "corpus_size")
    return per.withColumn("__n", F.row_number().over(w)).where("__n = 1").drop("__n")


def trial_summary(cells: DataFrame) -> DataFrame:
    per = cells.groupBy("system", "trial").agg(F.avg(F.col("correct").cast("double")).alias("accuracy"))
    return per.groupBy("system").agg(F.count("*").alias("trials"), F.round(F.avg("accuracy"), 6).alias("mean"), F.round(F.coalesce(F.stddev_samp("accuracy"), F.lit(0.0)), 6).alias("sd"))


def scaling_trend(summary: DataFrame, keys: list[str], flat: float = DEFAULT.trend) -> DataFrame:
    """First and last size per system: changes of accuracy and citation scores, and a verdict."""
    metrics = ("accuracy", "mean_precision", "mean_recall", "mean_f1")
    ends = summary.groupBy(*keys).agg(*[x for m in metrics for x in (F.min_by(m, "corpus_size").alias(f"{m}_0"), F.max_by(m, "corpus_size").alias(f"{m}_1"))], F.count("*").alias("sizes"))
    deltas = ends.select(*keys, "sizes", *[F.round(F.col(f"{m}_1") - F.col(f"{m}_0"), 6).alias(f"d_{m}") for m in metrics])
    a, f = F.col("d_accuracy"), F.col("d_mean_f1")
    verdict = (
        F.when(F.col("sizes") < 2, "single point")
        .when((a >= -flat) & (f >= -flat), "holds")
        .when(a >= -flat, "accuracy holds, citations fall")
        .when(f >= -flat, "citations hold, accuracy falls")
        .otherwise("falls")
    )
    return deltas.withColumn("verdict", verdict)


def compare_runs(old: DataFrame, new: DataFrame) -> DataFrame:
    """Full outer by system; a missing side is a dash."""
    side = lambda df, s: df.select("system", F.col("accuracy").alias(f"accuracy_{s}"), F.col("mean_f1").alias(f"f1_{s}"))
    rows = side(old, "old").join(side(new, "new"), "system", "full_outer")
    shown = lambda c: F.when(F.col(c).isNull(), "—").otherwise(F.format_string("%.3f", c))
    return rows.select("system", shown("accuracy_old").alias("old"), shown("accuracy_new").alias("new"), F.round(maths.pct_delta(F.col("accuracy_old"), F.col("accuracy_new")), 6).alias("delta_pct"))


def resume(grid: DataFrame, done: DataFrame) -> DataFrame:
    """Cells of the grid without a row that ended well."""
    return grid.join(done.where("error IS NULL").select(*CELL), CELL, "left_anti")


def sweep(systems: DataFrame, contexts: DataFrame, sizes: DataFrame, trials: DataFrame, queries: DataFrame) -> DataFrame:
    """Every combination; the axes but the queries are lists of a few values."""
    return systems.crossJoin(contexts).crossJoin(sizes).crossJoin(trials).crossJoin(queries)
