"""Queries over the graph of events and entities, and the memory of facts."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import facts, graph
from ..sources import views
from . import sql

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


_EDGES = f"""{sql.QUESTIONS}, held AS (SELECT DISTINCT doc_id AS event_id, unnest({sql.bridge_terms('text')}) AS entity FROM documents),
  dfs AS (SELECT entity, count(*) AS df FROM held GROUP BY ALL),
  edges AS (SELECT event_id, entity, df, count(*) OVER e AS d_event, (1 / ln(2.0::DOUBLE + df)) / sum(1 / ln(2.0::DOUBLE + df)) OVER e AS share
    FROM held JOIN dfs USING (entity) WINDOW e AS (PARTITION BY event_id)),
  asked AS (SELECT DISTINCT query_id, unnest({sql.bridge_terms('question')}) AS entity FROM questions)"""


@query
def graph_ppr_topk(spark, sf):
    """Events by a walk with restarts from the question's entities."""
    return graph.ppr(views.events(spark, sf), views.questions(spark, sf)).select("query_id", "event_id", "score", "rank")


SQL["graph_ppr_topk"] = f"""WITH RECURSIVE {_EDGES},
  links AS (SELECT 'e' || entity AS node, 'v' || event_id AS other, df AS d, 1.0::DOUBLE / df AS part FROM edges
    UNION ALL SELECT 'v' || event_id, 'e' || entity, d_event, share FROM edges),
  degrees AS (SELECT DISTINCT node, d FROM links),
  seeds AS (SELECT query_id, entity, (1 / ln(2.0::DOUBLE + df)) / sum(1 / ln(2.0::DOUBLE + df)) OVER (PARTITION BY query_id) AS r FROM asked JOIN dfs USING (entity)),
  walk AS (
    SELECT 0 AS t, query_id, 'e' || entity AS node, r, 0.0::DOUBLE AS p FROM seeds
    UNION ALL
    SELECT t + 1, query_id, node, sum(r), sum(p) FROM (
      SELECT w.t, query_id, node, CASE WHEN open THEN 0 ELSE r END AS r, p + CASE WHEN open AND node[1] = 'v' THEN 0.5 * r ELSE 0 END AS p
      FROM (SELECT s.*, r > 0.0001 * d AND node[1] = CASE WHEN t % 2 = 0 THEN 'e' ELSE 'v' END AS open FROM walk s JOIN degrees USING (node)) w
      UNION ALL
      SELECT s.t, query_id, l.other, 0.5 * r * l.part, 0.0 FROM walk s JOIN links l USING (node) WHERE r > 0.0001 * l.d AND node[1] = CASE WHEN s.t % 2 = 0 THEN 'e' ELSE 'v' END
    ) WHERE t < 30 GROUP BY t, query_id, node)
  SELECT query_id, event_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS INTEGER) AS rank
  FROM (SELECT query_id, CAST(node[2:] AS BIGINT) AS event_id, round(p, 6) AS score FROM walk WHERE t = 30 AND node[1] = 'v') WHERE score > 0 QUALIFY rank <= 10"""


@query
def graph_dual_level(spark, sf):
    """Events by the question's entities and by the relations between them, in turns."""
    return graph.dual_level(views.events(spark, sf), views.questions(spark, sf))


SQL["graph_dual_level"] = f"""WITH {_EDGES},
  pairs AS (SELECT x.event_id, x.entity AS a, y.entity AS b, x.df * y.df AS dfs FROM edges x JOIN edges y ON x.event_id = y.event_id AND x.entity < y.entity),
  weighed AS (SELECT a, b, round(ln(1.0::DOUBLE + count(*)) * count(*) / sqrt(any_value(dfs)), 9) AS weight FROM pairs GROUP BY a, b),
  strongest AS (SELECT * FROM (SELECT a AS entity, a, b, weight FROM weighed UNION ALL SELECT b, a, b, weight FROM weighed)
    QUALIFY row_number() OVER (PARTITION BY entity ORDER BY weight DESC, a, b) <= 20),
  met AS (SELECT query_id, a, b, max(ends) * any_value(weight) AS strength FROM (
      SELECT query_id, a, b, weight, 1 AS ends FROM asked JOIN strongest USING (entity)
      UNION ALL SELECT x.query_id, a, b, weight, 2 FROM asked x JOIN asked y ON x.query_id = y.query_id AND x.entity < y.entity JOIN weighed ON a = x.entity AND b = y.entity) GROUP BY ALL),
  followed AS (SELECT * FROM met QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY strength DESC, a, b) <= 20),
  by_relation AS (SELECT query_id, event_id, round(sum(strength), 9) AS score FROM followed JOIN pairs USING (a, b) GROUP BY ALL),
  by_entity AS (SELECT query_id, event_id, round(sum(1 / ln(2.0::DOUBLE + df)), 9) AS score FROM asked JOIN edges USING (entity) GROUP BY ALL),
  placed AS (
    SELECT query_id, event_id, 2 * row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) - 1 AS place FROM by_entity QUALIFY place < 20
    UNION ALL SELECT query_id, event_id, 2 * row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS place FROM by_relation QUALIFY place <= 20),
  merged AS (SELECT query_id, event_id, min(place) AS place FROM placed GROUP BY ALL)
  SELECT query_id, event_id, CASE WHEN place % 2 = 1 THEN 'entity' ELSE 'relation' END AS level, CAST(row_number() OVER (PARTITION BY query_id ORDER BY place) AS INTEGER) AS rank
  FROM merged QUALIFY rank <= 10"""


@query
def fact_memory(spark, sf):
    """What all events say, consolidated: versions of a fact are one memory."""
    events = views.events(spark, sf).withColumn("ordinal", F.col("event_id"))
    rows, _ = facts.consolidate(events, spark.createDataFrame([], facts.FACT), spark.createDataFrame([], facts.TAIL))
    return facts.memories(rows)


SQL["fact_memory"] = f"""WITH RECURSIVE spoken AS (SELECT source AS shard_id, doc_id AS event_id, text AS said, {sql.bridge_terms('text')} AS terms FROM documents WHERE text IS NOT NULL),
  statements AS (SELECT shard_id, said, min(event_id) AS event_id, count(*) AS n, any_value(terms) AS terms FROM spoken WHERE len(terms) > 0 GROUP BY shard_id, said),
  listed AS (SELECT shard_id, event_id, terms, unnest(list_transform(list_sort(list_transform(terms, lambda t: {{'n': -length(t), 't': t}}))[1:3], lambda x: x.t)) AS term FROM statements),
  met AS (SELECT *, lag(event_id) OVER w AS previous, lag(terms) OVER w AS other FROM listed WINDOW w AS (PARTITION BY shard_id, term ORDER BY event_id)),
  near AS (SELECT event_id, previous FROM (
      SELECT event_id, previous, len(list_intersect(terms, other))::DOUBLE / len(list_distinct(list_concat(terms, other))) AS share FROM met WHERE previous IS NOT NULL)
    WHERE share >= 0.5 QUALIFY row_number() OVER (PARTITION BY event_id ORDER BY share DESC, previous DESC) = 1),
  chains AS (
    SELECT event_id, event_id AS memory_id FROM statements ANTI JOIN near USING (event_id)
    UNION ALL SELECT near.event_id, memory_id FROM near JOIN chains ON near.previous = chains.event_id)
  SELECT shard_id, CAST(memory_id AS VARCHAR) AS memory_id, CAST(max(event_id) AS VARCHAR) AS event_id, count(*) AS n_versions, CAST(sum(n) AS BIGINT) AS n_said
  FROM statements JOIN chains USING (event_id) GROUP BY shard_id, memory_id"""
