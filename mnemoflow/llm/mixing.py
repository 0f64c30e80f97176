"""Mixing sources to target weights by a low-discrepancy schedule.

A source's documents, in the order of a hash, lie on a line of words. Slot i of
the schedule takes the point frac((i + 1/2) / golden ratio), finds the source
whose share of the cumulative targets holds it, and is ranked among the slots
of that source. The slot of rank r takes words r*block to (r+1)*block of the
source's line, which starts anew after its end: every block has as many words,
however often the source repeats, and the last one is trimmed to the target.
Slots and documents meet by an equi-join on pages of the line, a page being one
block long, so no source is gathered in one task. Running sums are taken in
two levels: within ranges of the hash (or of slots), then over the ranges.

``texts`` puts the words beside the plan, and ``stream`` lays the pieces out in
the order of their slots.

Defined results: a null text has no words; a null source is a source, the last;
an empty table gives no rows; a source without words has target 0 and takes
nothing; rows that repeat lie on the line once each; a row without an id is
placed by its text; columns not asked for are ignored. Sources are few (a list
of them is held on the driver).
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from .scratch import stored

BLOCK = 1024
#: Times a source's words at most.
REPEATS = 3
#: Rows of one source or range, at about, that a task sorts.
RANGE_ROWS = 20_000
_GOLDEN = 0.6180339887498949


def shares(sizes: Sequence[int], weights: Sequence[float], repeats: int = REPEATS) -> list[float]:
    """Targets that sum to all sizes, in proportion to the weights, none above ``repeats`` times its size.

    Sources reach their limit in the order of limit to weight; the rest share what is left.
    """
    order = sorted(range(len(sizes)), key=lambda k: (repeats * sizes[k] / weights[k], k))
    left, weight = sum(sizes), sum(weights)
    out = [0.0] * len(sizes)
    for n, k in enumerate(order):
        level = left / weight
        if level * weights[k] <= repeats * sizes[k]:
            for j in order[n:]:
                out[j] = level * weights[j]
            break
        out[k] = float(repeats * sizes[k])
        left -= repeats * sizes[k]
        weight -= weights[k]
    return out


@dataclass
class Mix:
    #: One row per document: doc_id, size, source_size, target, taken.
    documents: DataFrame
    #: The same with ``text_hash``, which tells rows that share an id apart, and ``pieces``, by slot: (slot, first, last), the document's first and last word (end exclusive) there.
    placed: DataFrame
    #: One row per slot and piece of a document: slot, doc_id, first and last word.
    pieces: DataFrame


def _running(df: DataFrame, group: str, part: str, order: list[str], value: str, name: str) -> DataFrame:
    """``df`` with the sum of ``value`` over the rows before in its group; ``part`` cuts ``order`` into ranges."""
    inner = Window.partitionBy(group, part).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    outer = Window.partitionBy(group).orderBy(part).rowsBetween(Window.unboundedPreceding, -1)
    ranges = df.groupBy(group, part).agg(F.sum(value).alias("__all")).select(group, part, F.coalesce(F.sum("__all").over(outer), F.lit(0)).alias("__base"))
    return df.withColumn("__in", F.coalesce(F.sum(value).over(inner), F.lit(0))).join(ranges, [group, part]).withColumn(name, F.col("__base") + F.col("__in")).drop("__base", "__in")


def _parts(rows: int) -> int:
    """A power of two of ranges, such that each has about RANGE_ROWS rows."""
    return 1 << max(6, (rows // RANGE_ROWS).bit_length())


def mix(docs: DataFrame, weight: Callable[[int], float] = lambda k: k % 3 + 1, doc_id: str = "doc_id", source: str = "source", text: str = "text", block: int = BLOCK, repeats: int = REPEATS) -> Mix:
    """``weight``: of the source by its place in code-point order, null last."""
    spark = docs.sparkSession
    sized = stored(
        docs.select(
            F.col(doc_id).alias("doc_id"),
            F.col(source).cast("string").alias("source"),
            F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long").alias("size"),
            F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.md5(F.coalesce(text, F.lit(""))))), 1, 15), 16, 10).cast("long").alias("key"),
            F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"),
        ),
        "sizes",
    )
    totals = sorted(sized.groupBy("source").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: (r.source is None, r.source or ""))
    sizes = [r["size"] for r in totals]
    targets = shares(sizes, [weight(k) for k in range(len(sizes))], repeats)
    wanted = [int(t + 0.5) for t in targets]
    schema = T.StructType([T.StructField(n, t) for n, t in (("source", T.StringType()), ("s", T.IntegerType()), ("source_size", T.LongType()), ("target", T.DoubleType()), ("wanted", T.LongType()))])
    sources = spark.createDataFrame([(r.source, k, sizes[k], targets[k], wanted[k]) for k, r in enumerate(totals)], schema)
    n = _parts(max([r.n for r in totals], default=0))
    placed = sized.join(sources, sized.source.eqNullSafe(sources.source)).drop("source")
    line = placed.where("size > 0").withColumn("part", F.shiftright("key", 60 - n.bit_length() + 1))
    line = _running(line, "s", "part", ["key", "doc_id", "size", "text_hash"], "size", "start")
    paged = line.select("*", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor((F.col("start") + F.col("size") - 1) / block))).alias("page"))

    slots = _schedule(sources, wanted, block)
    met = paged.join(slots, ["s", "page"], "left").withColumn("__low", F.greatest("start", "low")).withColumn("__high", F.least(F.col("start") + F.col("size"), "high", (F.col("page") + 1) * block))
    met = met.withColumn("__low", F.greatest("__low", F.col("page") * block))
    words = F.when(F.col("slot").isNotNull() & (F.col("__high") > F.col("__low")), F.col("__high") - F.col("__low")).otherwise(0)
    full = met.groupBy("s", "start", "doc_id", "size", "source_size", "target")
    columns = ["doc_id", "size", "source_size", "target", "taken"]
    wordless = placed.where("size = 0").withColumn("taken", F.lit(0).cast("long"))
    documents = full.agg(F.sum(words).alias("taken")).select(columns).unionByName(wordless.select(columns))
    own = F.struct(F.col("slot"), (F.col("__low") - F.col("start")).alias("first"), (F.col("__high") - F.col("start")).alias("last"))
    taken = F.col("slot").isNotNull() & (F.col("__high") > F.col("__low"))
    with_pieces = full.agg(F.sum(words).alias("taken"), F.first("text_hash").alias("text_hash"), F.array_sort(F.collect_list(F.when(taken, own))).alias("pieces"))
    none = F.array().cast(with_pieces.schema["pieces"].dataType)
    columns = [*columns, "text_hash", "pieces"]
    with_pieces = with_pieces.select(columns).unionByName(wordless.withColumn("pieces", none).select(columns))
    return Mix(documents, with_pieces, met.where(taken).select("doc_id", own.alias("p")).select("doc_id", "p.*"))


def texts(mixed: Mix, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``placed`` with the ``text`` of each document instead of its hash."""
    key = F.coalesce(F.col(doc_id).cast("string"), F.lit(""))
    rows = docs.select(key.alias("__k"), F.coalesce(F.xxhash64(text), F.lit(0)).alias("text_hash"), F.col(text).alias("text"))
    placed = stored(mixed.placed.withColumn("__k", F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), "placed")
    again = placed.groupBy("__k", "text_hash").count().where("count > 1").drop("count")
    if again.limit(1).count():  # of rows that repeat each gets the text once
        rows = rows.join(again, ["__k", "text_hash"], "left_anti").unionByName(rows.join(again, ["__k", "text_hash"], "left_semi").dropDuplicates(["__k", "text_hash"]))
    return placed.join(rows, ["__k", "text_hash"]).select("doc_id", "size", "source_size", "target", "taken", "pieces", "text")


def stream(texts: DataFrame) -> DataFrame:
    """The mixed training set: slot, doc_id and the words of each piece, in the order of slots. Words are joined by one blank."""
    words = F.regexp_extract_all("text", F.lit(r"([^\x20\x09-\x0D]+)"))
    rows = texts.select("doc_id", words.alias("words"), F.explode("pieces").alias("p"))
    cut = F.array_join(F.slice("words", (F.col("p.first") + 1).cast("int"), (F.col("p.last") - F.col("p.first")).cast("int")), " ")
    return rows.select(F.col("p.slot").alias("slot"), "doc_id", F.col("p.first").alias("first"), cut.alias("text")).orderBy("slot", "doc_id", "first")


def _schedule(sources: DataFrame, wanted: list[int], block: int) -> DataFrame:
    """Slots with the words of their source's line that they take: slot, s, page, low, high.

    As golden-ratio points fill every interval to within the logarithm of their number, a few
    slots more than the total asks for give each source its share; ranks beyond it fall away.
    A source that still lacks some gets them after the last slot.
    """
    spark = sources.sparkSession
    needed = [-(-w // block) for w in wanted]
    total = sum(needed)
    slots = total + 2 * len(needed) + 64 if total else 0
    ends, at = [], 0.0
    for k in needed:
        at += k / max(total, 1)
        ends.append(at)
    if ends:
        ends[-1] = 2.0
    bounds = F.array(*[F.lit(x) for x in ends]) if ends else F.array(F.lit(2.0))
    i = F.col("id")
    point = (i + 0.5) * _GOLDEN - F.floor((i + 0.5) * _GOLDEN)
    drawn = spark.range(slots).withColumn("u", point).select(i.alias("slot"), F.size(F.filter(bounds, lambda b: b <= F.col("u"))).alias("s"))
    n = _parts(slots)
    drawn = drawn.withColumn("one", F.lit(1).cast("long")).withColumn("part", F.floor(F.col("slot") * n / max(slots, 1)).cast("long"))
    ranked = _running(drawn, "s", "part", ["slot"], "one", "rank").select("slot", "s", "rank")
    had = {r.s: r.n for r in ranked.groupBy("s").agg(F.count("*").alias("n")).collect()}
    short = [(k, had.get(k, 0), needed[k]) for k in range(len(needed)) if had.get(k, 0) < needed[k]]
    if short:
        more = spark.createDataFrame(short, "s int, had long, needed long").select("s", F.explode(F.sequence(F.col("had"), F.col("needed") - 1)).alias("rank"))
        ranked = ranked.unionByName(more.select((F.lit(slots) + F.col("rank")).alias("slot"), "s", "rank"))
    taken = ranked.join(sources.select("s", "source_size", "wanted"), "s").withColumn("from", F.col("rank") * block).withColumn("to", F.least((F.col("rank") + 1) * block, "wanted")).where("from < to")
    # a block may run over the end of the line, for short sources more than once
    lap = taken.select("slot", "s", "source_size", "from", "to", F.explode(F.sequence(F.expr("from div source_size"), F.expr("(to - 1) div source_size"))).alias("lap"))
    cut = lap.select("slot", "s", (F.greatest("from", F.col("lap") * F.col("source_size")) - F.col("lap") * F.col("source_size")).alias("low"), (F.least("to", (F.col("lap") + 1) * F.col("source_size")) - F.col("lap") * F.col("source_size")).alias("high"))
    return cut.select("slot", "s", "low", "high", F.explode(F.sequence(F.floor(F.col("low") / block), F.floor((F.col("high") - 1) / block))).alias("page"))
