"""A benchmark run over a sweep, size by size, and the replay of its results."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import evaluate


def run(grid: DataFrame, done: DataFrame, answer: Callable[[DataFrame], DataFrame], write: Callable[[DataFrame], None], read: Callable[[], DataFrame]) -> DataFrame:
    """Answer what the grid lacks, in ascending sizes; a system stopped in a context isn't asked at larger sizes.

    A size is one job for all systems, contexts, trials and queries; ``write`` appends its cells and ``read`` gives all so far.
    """
    for size in sorted(r.corpus_size for r in grid.select("corpus_size").distinct().collect()):
        stops = evaluate.early_stops(evaluate.current_cells(read()))
        wave = evaluate.not_stopped(evaluate.resume(grid.where(F.col("corpus_size") == size), done), stops)
        write(answer(wave))
    return evaluate.summaries(evaluate.current_cells(read()))


def replay(cells: DataFrame) -> DataFrame:
    """Summaries of stored results, as a run would have made them."""
    return evaluate.summaries(evaluate.current_cells(cells))
