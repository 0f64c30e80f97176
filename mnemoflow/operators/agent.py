"""Evidence for an agent: chronological coverage, dated relations, capsules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..config import DEFAULT
from ..functions import dates, text
from .rank import top_k


def scored(events: DataFrame, terms: Column) -> DataFrame:
    """Events with their coverage score, dates and role."""
    return events.select(
        "*", text.coverage_score(F.col("content"), terms).alias("score"), dates.date_phrases(F.col("content")).alias("dates"), text.event_role(F.col("content")).alias("speaker")
    )


def coverage(events: DataFrame, keys: list[str], most: int, buckets: int = DEFAULT.coverage_buckets, per_bucket: int = DEFAULT.coverage_per_bucket) -> DataFrame:
    """The best few events of each stretch of a shard's timeline; whole stretches are taken until ``most`` is reached.

    ``events``: keys, shard_id, event_id, turn, score.
    """
    shard = Window.partitionBy(*keys, "shard_id")
    placed = events.withColumn("pos", F.row_number().over(shard.orderBy("turn", "event_id")) - 1).withColumn("many", F.count("*").over(shard))
    bucketed = placed.withColumn("bucket", F.floor(F.col("pos") / F.greatest(F.lit(1), F.ceil(F.col("many") / buckets))))
    best = top_k(bucketed.where("score > 0"), [*keys, "shard_id", "bucket"], [F.desc("score"), F.asc("turn"), F.asc("event_id")], per_bucket, "place")
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    per = best.groupBy(*keys, "shard_id", "bucket").agg(F.count("*").alias("taken"))
    before = group.orderBy("shard_id", "bucket").rowsBetween(Window.unboundedPreceding, -1)
    open_ = per.withColumn("before", F.coalesce(F.sum("taken").over(before), F.lit(0))).where(F.col("before") < most)
    return best.join(open_.select(*keys, "shard_id", "bucket"), [*keys, "shard_id", "bucket"], "left_semi")


def temporal_priority(events: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """Dated events first, then by score, the user's own turns before others."""
    rows = events.where("score > 0 OR size(dates) > 0")
    return top_k(rows, keys, [F.desc(F.size("dates")), F.desc("score"), F.asc(F.col("speaker") != "user"), F.asc("turn"), F.asc("event_id")], limit)


def anchors(events: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, event_id, date_text, day, score, place): every distinct day of an event, the best event's first."""
    rows = events.select(*keys, "event_id", "score", F.posexplode(F.array_distinct("dates")).alias("p", "date_text")).withColumn("day", dates.parse_date(F.col("date_text"))).where("day IS NOT NULL")
    single = rows.groupBy(*keys, "event_id", "day").agg(F.min_by("date_text", "p").alias("date_text"), F.max("score").alias("score"))
    w = Window.partitionBy(*keys).orderBy(F.desc("score"), "day", "event_id")
    return single.withColumn("place", F.row_number().over(w))


def top_pair(anchored: DataFrame, keys: list[str]) -> DataFrame:
    """The first pair, in the anchors' order, of different events and days.

    The first anchor pairs with the first later one that differs in both, so it's looked for
    from each anchor on; anchors of a group are few.
    """
    a, b = anchored.alias("a"), anchored.alias("b")
    on = [F.col(f"a.{k}") == F.col(f"b.{k}") for k in keys] + [F.col("a.place") < F.col("b.place"), F.col("a.event_id") != F.col("b.event_id"), F.col("a.day") != F.col("b.day")]
    pairs = a.join(b, on).select(*[F.col(f"a.{k}").alias(k) for k in keys], F.struct("a.place", "b.place").alias("o"), F.struct("a.day", "a.date_text", "a.event_id").alias("x"), F.struct("b.day", "b.date_text", "b.event_id").alias("y"))
    first = pairs.groupBy(*keys).agg(F.min_by(F.struct("x", "y"), "o").alias("p")).select(*keys, "p.x", "p.y")
    early, late = F.least("x", "y"), F.greatest("x", "y")
    return first.select(*keys, early.alias("first"), late.alias("second")).withColumn("days", dates.days_between(F.col("first.day"), F.col("second.day")))


def _pair(rows: DataFrame) -> DataFrame:
    """``rows`` with ``first`` and ``second`` of their array ``a`` of anchors, by place: the best for the left role and, of
    another event, for the right one, if on different days; else the first two of different events and days. Null without."""
    best = lambda xs, fit: F.array_max(F.transform(F.filter(xs, lambda x: x[fit] > 0), lambda x: F.struct(x[fit].alias("fit"), (-x["place"]).alias("p"), x.alias("x"))))["x"]
    rows = rows.withColumn("l", best(F.col("a"), "lf"))
    rows = rows.withColumn("r", best(F.filter("a", lambda x: F.col("l").isNull() | (x["event_id"] != F.col("l.event_id"))), "rf"))
    later = lambda x: F.filter("a", lambda y: (y["place"] > x["place"]) & (y["event_id"] != x["event_id"]) & (y["day"] != x["day"]))
    rows = rows.withColumn("t", F.get(F.filter(F.transform("a", lambda x: F.struct(x.alias("x"), F.get(later(x), 0).alias("y"))), lambda p: p["y"].isNotNull()), 0))
    roles = F.coalesce(F.col("l.day") != F.col("r.day"), F.lit(False))
    rows = rows.withColumn("x", F.when(roles, F.col("l")).otherwise(F.col("t.x"))).withColumn("y", F.when(roles, F.col("r")).otherwise(F.col("t.y")))
    early = F.col("x.day") <= F.col("y.day")
    return rows.withColumn("first", F.when(early, F.col("x")).otherwise(F.col("y"))).withColumn("second", F.when(early, F.col("y")).otherwise(F.col("x"))).drop("a", "l", "r", "t", "x", "y")


def segment_pair(anchored: DataFrame, asked: DataFrame, keys: list[str]) -> DataFrame:
    """The pair of dated events that stand for two roles, and the days between. ``anchored``: ``anchors`` with content;
    ``asked``: (keys, left, right), the terms of the roles. A group's anchors are few."""
    fit = lambda side, name: text.coverage_score(F.col("content"), F.col(side)).alias(name)
    one = F.struct("place", "event_id", "day", "date_text", "lf", "rf")
    rows = anchored.join(asked, keys).select("*", fit("left", "lf"), fit("right", "rf")).groupBy(*keys).agg(F.array_sort(F.collect_list(one)).alias("a"))
    return _pair(rows).where("first IS NOT NULL").withColumn("days", dates.days_between(F.col("first.day"), F.col("second.day")))


def between_terms(query: Column) -> tuple[Column, Column]:
    """The two sides of 'between A and B'; empty if the question has none."""
    pattern = r"(?i)\bbetween\s+(?:when\s+)?(.+?)\s+and\s+(?:when\s+)?(.+?)(?:[?.!]|$)"
    clean = text.flat(query)
    return F.regexp_extract(clean, pattern, 1), F.regexp_extract(clean, pattern, 2)


def return_k(intent: Column, k: int) -> Column:
    return F.when(intent["broad_summary"], max(k, DEFAULT.summary_return)).when(intent["temporal"] | intent["contradiction"], max(k, DEFAULT.reasoning_return)).otherwise(k)


def user_first(events: DataFrame, keys: list[str], place: str) -> DataFrame:
    """The user's own turns before all others, each part in its order."""
    w = Window.partitionBy(*keys).orderBy(F.col("speaker") != "user", place)
    return events.withColumn("new_place", F.row_number().over(w))


#: Fixed value: what hints at a conflict.
CONFLICT = r"(?i)\b(never|not|contradict|conflict|inconsistent|before|tested|used|also mentioned)\b"


def wants_capsule(intent: Column) -> Column:
    """No evidence for what can't be known, but for contradictions; else for summaries, times, contradictions and what a user counts."""
    idle = intent["abstention_risk"] & ~intent["contradiction"]
    return ~idle & (intent["broad_summary"] | intent["temporal"] | intent["contradiction"] | (intent["count_like"] & intent["user_centric"]))


def admitted(intent: Column) -> Column:
    """Events that are evidence: all for a summary, else what scores, has a date or, for contradictions, hints at one;
    the user's own turns only where a user counts."""
    own = ~(intent["count_like"] & intent["user_centric"]) | (F.col("speaker") == "user")
    cue = intent["contradiction"] & F.regexp_like("content", F.lit(CONFLICT))
    return own & (intent["broad_summary"] | (F.col("score") > 0) | (F.size("dates") > 0) | cue)


def _evidence(rows: DataFrame) -> DataFrame:
    """Of scored events those that a question's capsule is made of, with their order ``pos``: for a summary the coverage and the
    best, spread over time beside the pinned ones; for times the dated ones first; else all."""
    c, w = F.col, Window.partitionBy("query_id")
    in_time = ["shard_id", "turn", "event_id"]
    best = [F.desc("score"), F.asc("turn"), F.asc("event_id")]
    hit = c("score") > 0
    rows = rows.withColumn("p", F.row_number().over(w.orderBy(*in_time)) - 1).withColumn("many", F.count("*").over(w)).withColumn("s", F.row_number().over(w.orderBy(*best)))
    rows = rows.withColumn("bucket", F.floor(c("p") / F.greatest(F.lit(1), F.ceil(c("many") / DEFAULT.coverage_buckets))))
    rows = rows.withColumn("taken", hit & (F.row_number().over(Window.partitionBy("query_id", "bucket").orderBy(*best)) <= DEFAULT.coverage_per_bucket))
    before = F.coalesce(F.sum(c("taken").cast("int")).over(w.orderBy("bucket").rangeBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.withColumn("pool", (c("taken") & (before < DEFAULT.capsule_coverage)) | (hit & (c("s") <= DEFAULT.capsule_top)))
    rows = rows.withColumn("in_pool", F.sum(c("pool").cast("int")).over(w)).withColumn("pinned", hit & (c("s") <= DEFAULT.capsule_pinned)).withColumn("held", F.sum(c("pinned").cast("int")).over(w))
    rest = Window.partitionBy("query_id", c("pool") & ~c("pinned"))
    rows = rows.withColumn("q", F.row_number().over(rest.orderBy(*in_time)) - 1).withColumn("others", F.count("*").over(rest))
    room = c("limit") - c("held")
    step = (c("others") - 1) / F.greatest(room - 1, F.lit(1))
    places = F.transform(F.sequence(F.lit(0), F.greatest(room - 1, F.lit(0)).cast("int")), lambda i: F.floor(i * step + 0.5))
    spread = (room > 0) & ((c("others") <= room) | F.array_contains(places, c("q").cast("long")))
    summary = c("pool") & ((c("in_pool") <= c("limit")) | c("pinned") | spread)
    urgent = F.struct((-F.size("dates")).alias("a"), (-c("score")).alias("b"), (c("speaker") != "user").cast("int").alias("c"), "turn", "event_id")
    plain = F.struct(F.lit(0).alias("a"), F.lit(0).alias("b"), F.lit(0).alias("c"), "turn", "event_id")
    timed = c("intent.temporal") & ~c("intent.broad_summary")
    dated = hit | (F.size("dates") > 0)
    rows = rows.withColumn("pos", F.when(timed, urgent).otherwise(plain)).withColumn("place", F.row_number().over(Window.partitionBy("query_id", dated).orderBy("pos")))
    chosen = F.when(c("intent.broad_summary"), summary).when(timed, dated & (c("place") <= c("limit"))).otherwise(True)
    return rows.where(chosen).select("query_id", "event_id", "turn", "content", "score", "dates", "speaker", "intent", "terms", "left", "right", "limit", "pos")


def capsules(events: DataFrame, asked: DataFrame) -> DataFrame:
    """(query_id, n_lines, capsule) of questions that want evidence and find some.

    ``events``: (shard_id, event_id, turn, content); ``asked``: (query_id, shard_id, query), the shard to look in.
    """
    wanted = asked.withColumn("intent", text.intent(F.col("query"))).where(wants_capsule(F.col("intent")))
    left, right = between_terms(F.col("query"))
    terms = lambda q: text.expand_terms(text.content_terms(q))
    wanted = wanted.select("query_id", "shard_id", "intent", terms(F.col("query")).alias("terms"), terms(left).alias("left"), terms(right).alias("right"))
    limit = F.when(F.col("intent.broad_summary"), DEFAULT.capsule_top).when(F.col("intent.temporal") | F.col("intent.contradiction"), DEFAULT.capsule_reasoning).otherwise(DEFAULT.capsule_other)
    evidence = _evidence(scored(events.join(wanted, "shard_id"), F.col("terms")).withColumn("limit", limit))

    # the days between two dated events, for questions of times that don't look for contradictions
    dated = evidence.where("intent.temporal AND NOT intent.contradiction").select("*", F.explode(F.array_distinct("dates")).alias("date_text")).withColumn("day", dates.parse_date(F.col("date_text"))).where("day IS NOT NULL")
    two_sided = (F.size("left") > 0) & (F.size("right") > 0)
    fit = lambda side: F.when(two_sided, text.coverage_score(F.col("content"), F.col(side))).otherwise(0)
    one = F.struct((-F.col("score")).alias("s"), "day", "event_id", "date_text", text.date_excerpt(F.col("content"), F.col("date_text"), 180).alias("told"), fit("left").alias("lf"), fit("right").alias("rf"))
    anchored = dated.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("a"))
    anchored = anchored.withColumn("a", F.transform("a", lambda x, i: F.struct(i.alias("place"), x["event_id"].alias("event_id"), x["day"].alias("day"), x["date_text"].alias("date_text"), x["told"].alias("told"), x["lf"].alias("lf"), x["rf"].alias("rf"))))
    end = lambda which: F.concat(F.col(f"{which}.date_text"), F.lit(" ["), F.col(f"{which}.event_id"), F.lit("] ("), F.col(f"{which}.told"), F.lit(")"))
    days = dates.days_between(F.col("first.day"), F.col("second.day"))
    related = _pair(anchored).where("first IS NOT NULL").select("query_id", F.concat(F.lit("Temporal calculation: from "), end("first"), F.lit(" to "), end("second"), F.lit(" = "), days.cast("string"), F.when(days == 1, " day.").otherwise(" days.")).alias("relation"))

    line = text.snippet(F.col("event_id"), F.col("content"), F.col("terms"), DEFAULT.snippet_chars)
    good = evidence.where(admitted(F.col("intent"))).withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("pos"))).where(F.col("n") <= F.col("limit"))
    lines = good.select("query_id", "n", "limit", line.alias("line")).groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("n", "line"))).alias("lines"), F.first("limit").alias("limit"))
    body = wanted.select("query_id", "intent").join(lines, "query_id", "left").join(related, "query_id", "left").where("lines IS NOT NULL OR relation IS NOT NULL")
    heading = F.when(F.col("intent.broad_summary"), "Chronological").when(F.col("intent.temporal"), "Temporal").when(F.col("intent.contradiction"), "Contradiction").otherwise("User-mentioned")
    none = F.array().cast("array<string>")
    all_lines = F.concat(F.when(F.col("relation").isNotNull(), F.array("relation")).otherwise(none), F.coalesce(F.col("lines.line"), none))
    body = body.select("query_id", heading.alias("heading"), F.when(F.col("limit").isNull(), all_lines).otherwise(F.slice(all_lines, F.lit(1), F.coalesce("limit", F.lit(1)))).alias("all"))
    return body.select("query_id", F.size("all").cast("long").alias("n_lines"), F.concat("heading", F.lit(" evidence capsule.\n"), F.array_join(F.transform("all", lambda x: F.concat(F.lit("- "), x)), "\n")).alias("capsule"))


def capsule(events: DataFrame, keys: list[str], terms: Column, limit: int, heading: str) -> DataFrame:
    """One text per group: a heading and the evidence of each event, equal lines once."""
    lines = top_k(events.where("score > 0 OR size(dates) > 0"), keys, [F.desc("score"), F.asc("turn"), F.asc("event_id")], limit)
    lined = lines.select(*keys, "turn", "event_id", text.snippet(F.col("event_id"), F.col("content"), terms, DEFAULT.snippet_chars).alias("line"))
    body = F.transform(F.array_sort(F.collect_list(F.struct("turn", "event_id", "line"))), lambda x: F.concat(F.lit("- "), x["line"]))
    return lined.groupBy(*keys).agg(F.count("*").alias("n_lines"), F.concat(F.lit(heading + "\n"), F.array_join(F.array_distinct(body), "\n")).alias("capsule"))
