"""Queries over conversations: neighbours, coverage, timelines, dated pairs, capsules."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text
from ..operators import agent, rank, retrieval
from ..sources import views
from . import sql

QUERIES, SQL = {}, {}
# The terms that these queries look for.
TERMS = ["that", "about", "password", "number", "thanks", "please", "question"]


def query(f):
    QUERIES[f.__name__] = f
    return f


def _scored(spark, sf):
    return agent.scored(views.turns(spark, sf), text.strings(TERMS))


_SCORED = f"""{sql.TURNS}, scored AS (SELECT *, {sql.coverage('content', sql.words(TERMS))} AS score, {sql.dates('content')} AS dates,
  coalesce(nullif(lower(regexp_extract(content, '(?i)(?:^|\\n)\\s*(?:\\[[^\\]\\n]*?\\s*\\|\\s*)?\\[?Turn\\s+\\d+\\]?\\s+(User|Assistant):', 1)), ''), 'memory') AS speaker FROM turns)"""


@query
def neighbour_expand(spark, sf):
    """The turns before and after each assistant turn."""
    t = views.turns(spark, sf)
    return retrieval.neighbours(t, t.where("role = 'assistant'").select("event_id"))


SQL["neighbour_expand"] = f"""WITH {sql.TURNS}, p AS (SELECT event_id, shard_id, role, row_number() OVER (PARTITION BY shard_id ORDER BY turn, event_id) AS pos FROM turns)
SELECT a.event_id AS hit, CAST(b.pos - a.pos AS INTEGER) AS step, b.event_id AS neighbour FROM p a JOIN p b ON a.shard_id = b.shard_id AND abs(a.pos - b.pos) = 1 WHERE a.role = 'assistant'"""


@query
def coverage_buckets(spark, sf):
    """The best of each stretch of every conversation, until 200 are taken."""
    events = _scored(spark, sf).withColumn("scope", F.lit(0))
    return agent.coverage(events, ["scope"], 200).select("shard_id", "event_id", F.col("bucket").cast("long").alias("bucket"), "place")


SQL["coverage_buckets"] = f"""WITH {_SCORED}, placed AS (SELECT *, row_number() OVER (PARTITION BY shard_id ORDER BY turn, event_id) - 1 AS pos, count(*) OVER (PARTITION BY shard_id) AS many FROM scored),
  b AS (SELECT *, CAST(floor(pos / greatest(1, ceil(many / 12.0))) AS BIGINT) AS bucket FROM placed),
  best AS (SELECT *, row_number() OVER (PARTITION BY shard_id, bucket ORDER BY score DESC, turn, event_id) AS place FROM b WHERE score > 0 QUALIFY place <= 2),
  per AS (SELECT shard_id, bucket, count(*) AS taken FROM best GROUP BY ALL), open AS (SELECT *, coalesce(sum(taken) OVER (ORDER BY shard_id, bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per)
  SELECT shard_id, event_id, bucket, CAST(place AS INTEGER) AS place FROM best SEMI JOIN (SELECT * FROM open WHERE before < 200) o USING (shard_id, bucket)"""


@query
def timeline_spread(spark, sf):
    """At most four turns of each conversation, evenly spread."""
    return rank.timeline(views.turns(spark, sf), ["shard_id"], [F.asc("turn"), F.asc("event_id")], 4).select("shard_id", "event_id", "pos")


SQL["timeline_spread"] = f"""WITH {sql.TURNS}, p AS (SELECT shard_id, event_id, CAST(row_number() OVER (PARTITION BY shard_id ORDER BY turn, event_id) - 1 AS INTEGER) AS pos, count(*) OVER (PARTITION BY shard_id) AS many FROM turns)
SELECT shard_id, event_id, pos FROM p WHERE many <= 4 OR list_contains(list_transform([0, 1, 2, 3], lambda i: CAST(floor(i * (many - 1) / 3.0 + 0.5) AS INTEGER)), pos)"""


@query
def pinned_spread(spark, sf):
    """The two best turns of a conversation and four of the others, spread."""
    events = _scored(spark, sf)
    pinned = rank.top_k(events.where("score > 0"), ["shard_id"], [F.desc("score"), F.asc("turn"), F.asc("event_id")], 2).select("shard_id", "event_id", F.lit("pinned").alias("via"))
    rest = rank.timeline(events.join(pinned, ["shard_id", "event_id"], "left_anti"), ["shard_id"], [F.asc("turn"), F.asc("event_id")], 4)
    return pinned.unionByName(rest.select("shard_id", "event_id", F.lit("spread").alias("via")))


SQL["pinned_spread"] = f"""WITH {_SCORED}, pinned AS (SELECT shard_id, event_id FROM scored WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY score DESC, turn, event_id) <= 2),
  p AS (SELECT shard_id, event_id, row_number() OVER (PARTITION BY shard_id ORDER BY turn, event_id) - 1 AS pos, count(*) OVER (PARTITION BY shard_id) AS many FROM scored ANTI JOIN pinned USING (shard_id, event_id))
  SELECT shard_id, event_id, 'pinned' AS via FROM pinned UNION ALL
  SELECT shard_id, event_id, 'spread' AS via FROM p WHERE many <= 4 OR list_contains(list_transform([0, 1, 2, 3], lambda i: floor(i * (many - 1) / 3.0 + 0.5)), pos)"""


@query
def temporal_priority(spark, sf):
    return agent.temporal_priority(_scored(spark, sf), ["shard_id"], 3).select("shard_id", "event_id", "rank")


SQL["temporal_priority"] = f"""WITH {_SCORED} SELECT shard_id, event_id, CAST(row_number() OVER (PARTITION BY shard_id ORDER BY len(dates) DESC, score DESC, speaker <> 'user', turn, event_id) AS INTEGER) AS rank
FROM scored WHERE score > 0 OR len(dates) > 0 QUALIFY rank <= 3"""


@query
def temporal_pair(spark, sf):
    """The first two dated turns of each conversation, by score, and the days between."""
    pairs = agent.top_pair(agent.anchors(_scored(spark, sf), ["shard_id"]), ["shard_id"])
    return pairs.select("shard_id", F.col("first.event_id").alias("first_id"), F.col("second.event_id").alias("second_id"), F.col("first.date_text").alias("first_date"), F.col("second.date_text").alias("second_date"), "days")


SQL["temporal_pair"] = f"""WITH {_SCORED}, a AS (SELECT shard_id, event_id, d, CAST(d AS DATE) AS day, row_number() OVER (PARTITION BY shard_id ORDER BY score DESC, CAST(d AS DATE), event_id) AS place
    FROM (SELECT DISTINCT shard_id, event_id, score, unnest(dates) AS d FROM scored)),
  p AS (SELECT x.shard_id, x.event_id AS xe, y.event_id AS ye, x.d AS xd, y.d AS yd FROM a x JOIN a y ON x.shard_id = y.shard_id AND x.place < y.place AND x.event_id <> y.event_id AND x.day <> y.day
    QUALIFY row_number() OVER (PARTITION BY x.shard_id ORDER BY x.place, y.place) = 1)
  SELECT shard_id, CASE WHEN xd < yd THEN xe ELSE ye END AS first_id, CASE WHEN xd < yd THEN ye ELSE xe END AS second_id, least(xd, yd) AS first_date, greatest(xd, yd) AS second_date, CAST(abs(CAST(xd AS DATE) - CAST(yd AS DATE)) AS INTEGER) AS days FROM p"""


@query
def temporal_excerpt(spark, sf):
    """Excerpts about the date of each dated turn."""
    from ..functions import dates

    t = views.turns(spark, sf)
    return t.select("event_id", F.md5(dates_excerpt(F.col("content"), F.get(dates.date_phrases(F.col("content")), 0))).alias("excerpt"))


def dates_excerpt(content, date):
    return text.date_excerpt(content, date, 60)


SQL["temporal_excerpt"] = rf"""WITH {sql.TURNS}, c AS (SELECT event_id, trim(regexp_replace(content, '\s+', ' ', 'g')) AS c, ({sql.dates('content')})[1] AS d FROM turns),
  s AS (SELECT event_id, c, greatest(0, instr(lower(c), d) - 1 - 39) AS s FROM c), e AS (SELECT *, least(length(c), s + 60) AS e FROM s)
  SELECT event_id, md5(CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(c, s + 1, e - s)) || CASE WHEN e < length(c) THEN '...' ELSE '' END) AS excerpt FROM e"""


@query
def between_segments(spark, sf):
    """Both sides of questions that ask for the time between two things."""
    q = views.questions(spark, sf)
    asked = F.concat(F.lit("How many days between when "), F.substring_index("question", " ", 4), F.lit(" and when "), F.substring_index("question", " ", -4), F.lit("?"))
    left, right = agent.between_terms(asked)
    return q.select("query_id", left.alias("left_side"), right.alias("right_side"))


SQL["between_segments"] = rf"""WITH {sql.QUESTIONS}, w AS (SELECT query_id, string_split(question, ' ') AS w FROM questions),
  q AS (SELECT query_id, 'How many days between when ' || array_to_string(w[1:4], ' ') || ' and when ' || array_to_string(w[len(w) - 3:], ' ') || '?' AS q FROM w)
  SELECT query_id, regexp_extract(trim(regexp_replace(q, '\s+', ' ', 'g')), '(?i)\bbetween\s+(?:when\s+)?(.+?)\s+and\s+(?:when\s+)?(.+?)(?:[?.!]|$)', 1) AS left_side,
  regexp_extract(trim(regexp_replace(q, '\s+', ' ', 'g')), '(?i)\bbetween\s+(?:when\s+)?(.+?)\s+and\s+(?:when\s+)?(.+?)(?:[?.!]|$)', 2) AS right_side FROM q"""


@query
def user_turn_first(spark, sf):
    return agent.user_first(_scored(spark, sf), ["shard_id"], "turn").select("shard_id", "event_id", "new_place")


SQL["user_turn_first"] = f"WITH {_SCORED} SELECT shard_id, event_id, CAST(row_number() OVER (PARTITION BY shard_id ORDER BY speaker <> 'user', turn) AS INTEGER) AS new_place FROM scored"


@query
def return_limits(spark, sf):
    """How many documents each question's intent asks for."""
    lead = F.element_at(F.array(*map(F.lit, ["Summarize ", "How many days between ", "Tell "])), (F.col("query_id") % 3 + 1).cast("int"))
    return views.questions(spark, sf).select("query_id", agent.return_k(text.intent(F.concat(lead, "question")), 10).cast("int").alias("k"))


SQL["return_limits"] = r"""SELECT item_id AS query_id, CAST(CASE item_id % 3 WHEN 0 THEN 24 WHEN 1 THEN 32 ELSE
  CASE WHEN regexp_matches(lower(text), '\b(summary|summarize|recap|overview|comprehensive)\b') THEN 24
  WHEN regexp_matches(lower(text), '\b(duration|before|after|earlier|later|timeline|chronological|order|contradict|conflict|inconsistent)\b') THEN 32 ELSE 10 END END AS INTEGER) AS k FROM benchmark"""


@query
def evidence_capsule(spark, sf):
    return agent.capsule(_scored(spark, sf), ["shard_id"], text.strings(TERMS), 10, "Temporal evidence capsule.").select("shard_id", "n_lines", F.md5("capsule").alias("capsule"))


SQL["evidence_capsule"] = rf"""WITH {_SCORED}, top AS (SELECT * FROM scored WHERE score > 0 OR len(dates) > 0 QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY score DESC, turn, event_id) <= 10),
  lines AS (SELECT shard_id, turn, event_id, '- [' || event_id || '] ' || coalesce(nullif(regexp_extract(content, '(?:^|\n)\s*((?:\[[^\]\n]*?\s*\|\s*)?\[?[Tt]urn\s+\d+\]?)', 1), ''), event_id) || ' ' || speaker || ':'
    || CASE WHEN len(dates) > 0 THEN ' dates=' || array_to_string(({sql.distinct_in_order('dates')})[1:3], ', ') || ';' ELSE '' END || ' ' || {sql.excerpt('content', sql.words(TERMS), 360)} AS line FROM top)
  SELECT shard_id, count(*) AS n_lines, md5('Temporal evidence capsule.' || chr(10) || string_agg(line, chr(10) ORDER BY turn, event_id)) AS capsule FROM lines GROUP BY shard_id"""


@query
def agent_retrieval(spark, sf):
    """For every conversation, its best turns, their neighbours, then its coverage: each turn once, at its first place."""
    from ..plans.agent import retrieve

    return retrieve(_scored(spark, sf), 2, DEFAULT.reasoning_return)


SQL["agent_retrieval"] = f"""WITH {_SCORED}, best AS (SELECT shard_id, event_id, row_number() OVER (PARTITION BY shard_id ORDER BY score DESC, turn, event_id) AS place FROM scored WHERE score > 0 QUALIFY place <= 2),
  pos AS (SELECT event_id, shard_id, score, turn, row_number() OVER (PARTITION BY shard_id ORDER BY turn, event_id) AS p, count(*) OVER (PARTITION BY shard_id) AS many FROM scored),
  near AS (SELECT a.shard_id, b.event_id, 1000 AS place FROM best JOIN pos a USING (event_id) JOIN pos b ON a.shard_id = b.shard_id AND abs(a.p - b.p) = 1),
  bucketed AS (SELECT *, floor((p - 1) / greatest(1, ceil(many / 12.0))) AS bucket FROM pos),
  wide AS (SELECT shard_id, event_id, bucket FROM bucketed WHERE score > 0 QUALIFY row_number() OVER (PARTITION BY shard_id, bucket ORDER BY score DESC, turn, event_id) <= 2),
  per AS (SELECT shard_id, bucket, count(*) AS n FROM wide GROUP BY ALL), open AS (SELECT *, coalesce(sum(n) OVER (PARTITION BY shard_id ORDER BY bucket ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM per),
  every AS (SELECT shard_id, event_id, place FROM best UNION ALL SELECT * FROM near UNION ALL SELECT shard_id, event_id, 2000 + bucket FROM wide SEMI JOIN (SELECT * FROM open WHERE before < 32) o USING (shard_id, bucket)),
  firsts AS (SELECT shard_id, event_id, min(place) AS priority FROM every GROUP BY ALL)
  SELECT shard_id, event_id, CAST(row_number() OVER (PARTITION BY shard_id ORDER BY priority, event_id) AS INTEGER) AS place FROM firsts QUALIFY place <= 32"""
