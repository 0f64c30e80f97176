"""Retrieval over the graph of events and the entities they name.

``entities`` makes the graph's one table: an edge for each event and entity in it, 12 at most an event. Two searches
use it for many questions at once.

``ppr`` walks from a question's entities with restarts (personalised PageRank). It pushes what has arrived at a node
and not yet been passed on, the residual, as long as it is more than ``eps`` for each edge of the node: a node of
many edges, a hub, must have gathered as much more before it is opened. A question opens at most 1 / ((1 - damping) * eps)
edges, whatever the size of the graph, and what is left unopened bounds the error. Residuals of all questions go in
the same joins; an entity's edges are dealt by a salt, so that a hub is no single task.

``dual_level`` looks for a question's entities and for relations, pairs of entities that events name together. Each
pair is weighed by how many events have it; a question meets the pairs of its own entities and the strongest of each
of them. The two rankings are merged in turns.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.text import bridge_terms
from ..sources.cut import cut
from .rank import top_k

#: The share of what a node has that it passes on; the rest stays with it.
DAMPING = 0.5
#: Residual that a node needs for each of its edges before it's opened.
EPS = 1e-4
#: Rounds at most. Each halves what is on its way twice, so far fewer are needed.
ROUNDS = 40
#: Tasks that the edges of one entity are dealt to.
SALTS = 8
#: Relations of an entity that a question meets, and those that it follows.
OF_ENTITY, RELATIONS = 20, 20


def entities(corpus: DataFrame) -> DataFrame:
    """(event_id, entity, df, d_event, share): df is how many events name the entity, d_event how many entities the event
    names, share what part of its mass an event passes to it: rare entities get more."""
    held = corpus.select("event_id", F.explode(bridge_terms(F.col("content"))).alias("entity"))
    df = held.groupBy("entity").agg(F.count("*").alias("df"))
    weighed = held.join(df, "entity").withColumn("rarity", 1 / F.log(2.0 + F.col("df")))
    per = weighed.groupBy("event_id").agg(F.sum("rarity").alias("all"), F.count("*").alias("d_event"))
    return weighed.join(per, "event_id").select("event_id", "entity", "df", "d_event", (F.col("rarity") / F.col("all")).alias("share"))


def _seeds(questions: DataFrame, df: DataFrame) -> DataFrame:
    """(query_id, entity, r): a question's known entities share one unit, rare ones getting more."""
    asked = questions.select("query_id", F.explode(bridge_terms(F.col("question"))).alias("entity"))
    known = asked.join(df, "entity").withColumn("r", 1 / F.log(2.0 + F.col("df")))
    total = known.groupBy("query_id").agg(F.sum("r").alias("all"))
    return known.join(total, "query_id").select("query_id", "entity", "df", (F.col("r") / F.col("all")).alias("r"))


def ppr(corpus: DataFrame, questions: DataFrame, k: int = 10, damping: float = DAMPING, eps: float = EPS, rounds: int = ROUNDS) -> DataFrame:
    """(query_id, event_id, score, rank): the k events of the most mass."""
    edges = cut(entities(corpus).withColumn("salt", F.pmod(F.xxhash64("event_id"), F.lit(SALTS)).cast("int")))
    at_entity = cut(_seeds(questions, edges.groupBy("entity").agg(F.count("*").alias("df"))))
    arrived = at_entity.join(edges.drop("df"), "entity").select("query_id", "event_id", "d_event", "r")
    at_event, stayed = at_entity.sparkSession.createDataFrame([], arrived.schema), []
    for _ in range(rounds):
        opened = at_entity.where(F.col("r") > eps * F.col("df"))
        if not opened.limit(1).count():
            break
        dealt = opened.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
        arrived = dealt.join(edges.drop("df", "share"), ["entity", "salt"]).select("query_id", "event_id", "d_event", (damping * F.col("r") / F.col("df")).alias("r"))
        at_event = cut(at_event.unionByName(arrived).groupBy("query_id", "event_id", "d_event").agg(F.sum("r").alias("r")))
        ready = F.col("r") > eps * F.col("d_event")
        stayed.append(at_event.where(ready).select("query_id", "event_id", ((1 - damping) * F.col("r")).alias("p")))
        passed = at_event.where(ready).join(edges.select("event_id", "entity", "df", "share"), "event_id").select("query_id", "entity", "df", (damping * F.col("r") * F.col("share")).alias("r"))
        left = at_entity.where(F.col("r") <= eps * F.col("df"))
        at_entity = cut(left.unionByName(passed).groupBy("query_id", "entity", "df").agg(F.sum("r").alias("r")))
        at_event = at_event.where(~ready)
    mass = reduce(DataFrame.unionByName, stayed, at_event.select("query_id", "event_id", F.lit(0.0).alias("p")))
    scored = mass.groupBy("query_id", "event_id").agg(F.round(F.sum("p"), 6).alias("score")).where("score > 0")
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("event_id")], k)


def relations(graph: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(event_id, a, b) of the pairs of ``entities``, a before b, and (a, b, weight) of the different ones: how many events
    have the pair against how many have either."""
    own = graph.groupBy("event_id").agg(F.array_sort(F.collect_list(F.struct("entity", "df"))).alias("own"))  # 12 at most
    ends = F.flatten(F.transform("own", lambda x, i: F.transform(F.slice("own", i + 2, F.size("own")), lambda y: F.struct(x.alias("x"), y.alias("y")))))
    pairs = own.select("event_id", F.explode(ends).alias("p")).select("event_id", F.col("p.x.entity").alias("a"), F.col("p.y.entity").alias("b"), (F.col("p.x.df") * F.col("p.y.df")).alias("dfs"))
    n = F.count("*")
    weighed = pairs.groupBy("a", "b").agg(F.round(F.log(1.0 + n) * n / F.sqrt(F.first("dfs")), 9).alias("weight"))
    return pairs.drop("dfs"), weighed


def dual_level(corpus: DataFrame, questions: DataFrame, k: int = 10, mode: str = "hybrid") -> DataFrame:
    """(query_id, event_id, level, rank): events by the question's entities (mode ``local``), by its relations (``global``), or by both in turns, entities first."""
    if mode not in ("local", "global", "hybrid"):
        raise ValueError(f"mode {mode}: local, global or hybrid")
    graph = cut(entities(corpus).select("event_id", "entity", "df"))
    asked = questions.select("query_id", F.explode(bridge_terms(F.col("question"))).alias("entity"))
    found = []
    if mode != "global":
        scored = asked.join(graph, "entity").groupBy("query_id", "event_id").agg(F.round(F.sum(1 / F.log(2.0 + F.col("df"))), 9).alias("score"))
        found.append(top_k(scored, ["query_id"], [F.desc("score"), F.asc("event_id")], k).select("query_id", "event_id", (2 * F.col("rank") - 1).alias("place")))
    if mode != "local":
        found.append(_by_relation(graph, asked, k).select("query_id", "event_id", (2 * F.col("rank")).alias("place")))
    first = reduce(DataFrame.unionByName, found).groupBy("query_id", "event_id").agg(F.min("place").alias("place"))
    ranked = top_k(first, ["query_id"], [F.asc("place")], k)
    return ranked.select("query_id", "event_id", F.when(F.col("place") % 2 == 1, "entity").otherwise("relation").alias("level"), "rank")


def _by_relation(graph: DataFrame, asked: DataFrame, k: int) -> DataFrame:
    pairs, weighed = relations(graph)
    weighed = cut(weighed)
    both = [weighed.select(F.col(x).alias("entity"), "a", "b", "weight") for x in ("a", "b")]
    strongest = top_k(both[0].unionByName(both[1]), ["entity"], [F.desc("weight"), F.asc("a"), F.asc("b")], OF_ENTITY)
    one = asked.join(strongest, "entity").select("query_id", "a", "b", "weight", F.lit(1).alias("ends"))
    two = asked.select("query_id", F.col("entity").alias("a")).join(asked.select("query_id", F.col("entity").alias("b")), "query_id").where("a < b")  # 12 entities a question at most
    two = two.join(weighed, ["a", "b"]).select("query_id", "a", "b", "weight", F.lit(2).alias("ends"))
    met = one.unionByName(two).groupBy("query_id", "a", "b").agg((F.max("ends") * F.first("weight")).alias("strength"))
    followed = top_k(met, ["query_id"], [F.desc("strength"), F.asc("a"), F.asc("b")], RELATIONS)
    scored = followed.join(pairs, ["a", "b"]).groupBy("query_id", "event_id").agg(F.round(F.sum("strength"), 9).alias("score"))
    return top_k(scored, ["query_id"], [F.desc("score"), F.asc("event_id")], k)
