"""Bootstrap intervals over outcomes packed as bits in blocks: rounds, slices of draws and blocks are separate tasks."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType
from pyspark.sql.window import Window

WORD = 32  # outcomes in a word
BLOCK_WORDS = 1 << 18  # words in a block: 8 million outcomes, 2 MB
DRAWS = 1 << 22  # draws of a task, about
_CHUNK = 1 << 16  # draws made at once

# The generator's constants, as in ``functions.maths``.
_STEP, _ONE, _SIXTY_ONE = np.uint32(0x6D2B79F5), np.uint32(1), np.uint32(61)


def _draws(seed: int, first: int, n: int) -> np.ndarray:
    """Draws first .. first + n - 1 of the seed's stream, as 32-bit numbers; each depends on its number alone."""
    a = np.arange(first, first + n, dtype=np.uint64).astype(np.uint32) * _STEP + np.uint32(seed & 0xFFFFFFFF)
    t = (a ^ (a >> np.uint32(15))) * (a | _ONE)
    t ^= t + (t ^ (t >> np.uint32(7))) * (t | _SIXTY_ONE)
    return t ^ (t >> np.uint32(14))


def _hits(bits: np.ndarray, start: int, n: int, seed: int, first: int, draws: int) -> int:
    """How many of the draws fall on a 1 among the outcomes start .. start + len(bits) - 1 of n."""
    out, whole = 0, start == 0 and len(bits) == n
    for at in range(0, draws, _CHUNK):
        drawn = (_draws(seed, first + at, min(_CHUNK, draws - at)) * (n / 4294967296.0)).astype(np.int64)
        if not whole:
            drawn -= start
            drawn = drawn[(drawn >= 0) & (drawn < len(bits))]
        out += int(np.count_nonzero(bits[drawn]))
    return out


def _rounds(bits: np.ndarray, n: int, seed: int, first: int, last: int) -> np.ndarray:
    """The hits of each of the rounds first .. last - 1, where all outcomes are at hand and a chunk holds whole rounds."""
    out = []
    per = max(1, _CHUNK // n)
    for at in range(first, last, per):
        k = min(per, last - at)
        drawn = (_draws(seed, at * n + 1, k * n) * (n / 4294967296.0)).astype(np.int64)
        out.append(bits[drawn].reshape(k, n).sum(axis=1, dtype=np.int64))
    return np.concatenate(out)


def numbered(cells: DataFrame, keys: list[str], order: list[str], outcome: Column, cut: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """(keys, pos, y): each outcome's place in its group, from 0, in the order of ``order``.

    Rows are dealt by ranges of keys and order, so that a large group is many ranges; a row's place is its place in the
    range and the counts of the group's ranges before. The ranges are written, as their bounds come from a sample.
    """
    rows = cells.select(*keys, *order, outcome.cast("long").alias("y"))
    dealt = cut(rows.repartitionByRange(*keys, *order).withColumn("__range", F.spark_partition_id()))
    counts = dealt.groupBy(*keys, "__range").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(*keys).orderBy("__range").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select(*keys, "__range", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    within = dealt.withColumn("__at", F.row_number().over(Window.partitionBy(*keys, "__range").orderBy(*order)) - 1)
    same = [F.col(f"a.{k}").eqNullSafe(F.col(f"b.{k}")) for k in [*keys, "__range"]]
    joined = within.alias("a").join(starts.alias("b"), same)
    return joined.select(*[F.col(f"a.{k}") for k in keys], (F.col("a.__at") + F.col("b.__start")).alias("pos"), F.col("a.y").alias("y"))


def blocks(placed: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, block, n, words): the outcomes of (keys, pos, y) as bits; ``n`` is the group's number of outcomes."""
    words = placed.groupBy(*keys, F.floor(F.col("pos") / WORD).alias("word")).agg(F.sum(F.expr(f"shiftleft(y, CAST(pos % {WORD} AS INT))")).alias("bits"), F.count("*").alias("held"))
    pack = F.array_sort(F.collect_list(F.struct("word", "bits")))
    packed = words.groupBy(*keys, F.floor(F.col("word") / BLOCK_WORDS).alias("block")).agg(pack.alias("words"), F.sum("held").alias("held"))
    n = F.sum("held").over(Window.partitionBy(*keys))
    return packed.select(*keys, "block", "held", n.alias("n"), F.col("words.bits").alias("words"))


def round_hits(packed: DataFrame, keys: list[str], rounds: int, seed: int) -> DataFrame:
    """(keys, n, round, hits): how many right outcomes each round draws.

    A task is a range of rounds of a small group, or a slice of one round's draws of a large one, against one block.
    Draws are functions of their number, so none is sent: a group of several blocks makes them once for each.
    """
    n = F.col("n")
    per = F.when(n > DRAWS, 1).otherwise(F.floor(F.lit(DRAWS) / n)).cast("long")
    slices = F.ceil(n / DRAWS).cast("long")
    work = packed.withColumn("per", F.least(per, F.lit(rounds).cast("long"))).withColumn("slices", slices)
    units = F.sequence(F.lit(0).cast("long"), F.ceil(F.lit(rounds) / F.col("per")) * F.col("slices") - 1)
    # a number of partitions of its own: rows are few and small, what is to be done with them isn't
    spread = max(int(packed.sparkSession.sparkContext.defaultParallelism), 1) * 4
    dealt = work.withColumn("unit", F.explode(units)).repartition(spread, *keys, "block", "unit")
    kinds = StructType([*[packed.schema[k] for k in keys], *[StructField(c, LongType()) for c in ("n", "round", "hits")]])

    def run(table: pa.Table) -> pa.Table:
        row = {c: table.column(c)[0].as_py() for c in ("n", "block", "held", "per", "slices", "unit")}
        n, start = row["n"], row["block"] * BLOCK_WORDS * WORD
        words = table.column("words").combine_chunks().flatten().to_numpy(zero_copy_only=False).astype("<u4")
        bits = np.unpackbits(words.view(np.uint8), bitorder="little")[: row["held"]]
        first = row["unit"] // row["slices"] * row["per"]
        last = min(first + row["per"], rounds)
        if n <= _CHUNK and row["held"] == n:
            hits = _rounds(bits, n, seed, first, last)
        else:
            low = row["unit"] % row["slices"] * DRAWS
            draws = min(DRAWS, n - low) if row["slices"] > 1 else n
            hits = np.array([_hits(bits, start, n, seed, r * n + low + 1, draws) for r in range(first, last)])
        m = last - first
        out = {k: table.column(k).take(pa.array([0] * m)) for k in keys}
        return pa.table({**out, "n": pa.array([n] * m, pa.int64()), "round": pa.array(range(first, last), pa.int64()), "hits": pa.array(hits, pa.int64())})

    made = dealt.groupBy(*keys, "block", "unit").applyInArrow(run, kinds)
    return made.groupBy(*keys, "n", "round").agg(F.sum("hits").alias("hits"))


def interval(hits: DataFrame, keys: list[str], rounds: int) -> DataFrame:
    """(keys, n, ci_low, ci_high): the means of the rounds in order, by index without interpolation."""
    means = hits.select(*keys, "n", (F.col("hits") / F.col("n")).alias("mean"))
    placed = means.withColumn("at", F.row_number().over(Window.partitionBy(*keys).orderBy("mean")) - 1)
    low, high = int(0.025 * rounds), min(int(0.975 * rounds), rounds - 1)
    pick = lambda k: F.round(F.max(F.when(F.col("at") == k, F.col("mean"))), 6)
    return placed.groupBy(*keys).agg(F.max("n").alias("n"), pick(low).alias("ci_low"), pick(high).alias("ci_high"))
