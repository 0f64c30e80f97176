"""Queries over retrieval: lexical, vector, fused, packed, expanded."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import text
from ..operators import best, folds, lexical_index, rank, retrieval
from ..sources import views
from ..sources.cut import cut, scratch_path
from . import sql

QUERIES, SQL = {}, {}
_BUDGET = 2000


def query(f):
    QUERIES[f.__name__] = f
    return f


def _asked(spark, sf):
    """Vectors as queries: every id divisible by 20."""
    return views.vectors(spark, sf).where("event_id % 20 = 0").select(F.col("event_id").alias("query_id"), "vec")


def _question_vectors(spark, sf):
    """The vector of each question: the one of its id."""
    return views.questions(spark, sf).join(views.vectors(spark, sf), F.col("query_id") == F.col("event_id")).select("query_id", "vec")


def _fused(spark, sf):
    return retrieval.fuse(retrieval.bm25(views.events(spark, sf), views.questions(spark, sf)), retrieval.knn(views.vectors(spark, sf), _question_vectors(spark, sf)))


_QKNN = sql.knn("q.vec_id IN (SELECT item_id FROM benchmark)")
_FUSE = f"WITH {sql.BM25}, {_QKNN}, {sql.FUSED}"
_LINES = "lines AS (SELECT doc_id AS event_id, CAST(ceil(length('[' || doc_id || '] ' || text || chr(10)) / 4.0) AS BIGINT) AS tokens FROM documents)"


@query
def bm25_topk(spark, sf):
    return retrieval.bm25(views.events(spark, sf), views.questions(spark, sf)).select("query_id", "event_id", "score", "rank")


SQL["bm25_topk"] = f"WITH {sql.BM25} SELECT query_id, event_id, score, rank FROM bm25"


@query
def bm25_indexed(spark, sf):
    """The same hits from a stored index that reads few postings of frequent words."""
    index = lexical_index.extend(lexical_index.LexicalIndex(spark), views.events(spark, sf), scratch_path(spark, "lexical-index"))
    return lexical_index.search(index, views.questions(spark, sf), kept=cut).select("query_id", "event_id", "score", "rank")


SQL["bm25_indexed"] = SQL["bm25_topk"]


@query
def cosine_topk(spark, sf):
    return retrieval.knn(views.vectors(spark, sf), _asked(spark, sf)).select("query_id", "event_id", "score", "rank")


SQL["cosine_topk"] = f"WITH {sql.knn('q.vec_id % 20 = 0')} SELECT query_id, event_id, score, rank FROM knn"


@query
def shard_local_knn(spark, sf):
    """Nearest within the query's own cluster."""
    v = views.vectors(spark, sf).withColumn("shard_id", F.col("label").cast("string"))
    asked = v.where("event_id % 20 = 0").select(F.col("event_id").alias("query_id"), "vec", "shard_id")
    return retrieval.knn(v, asked, 16, local=True).select("query_id", "event_id", "score", "rank")


SQL["shard_local_knn"] = f"WITH {sql.knn('q.vec_id % 20 = 0', k=16, local='AND q.label = e.label')} SELECT query_id, event_id, score, rank FROM knn"


@query
def rrf_hybrid(spark, sf):
    return _fused(spark, sf)


SQL["rrf_hybrid"] = f"{_FUSE} SELECT query_id, event_id, rrf_score, rank FROM fused"


@query
def hybrid_packed(spark, sf):
    return retrieval.hybrid(views.events(spark, sf), views.vectors(spark, sf), views.questions(spark, sf), _question_vectors(spark, sf), _BUDGET)


SQL["hybrid_packed"] = f"""{_FUSE}, {_LINES} SELECT query_id, rank, event_id, rrf_score, cum_tokens FROM (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS cum_tokens FROM fused JOIN lines USING (event_id)) WHERE cum_tokens <= {_BUDGET}"""


@query
def vanilla_rag_packed(spark, sf):
    near = retrieval.knn(views.vectors(spark, sf), _asked(spark, sf), DEFAULT.k_final)
    return retrieval.pack(near, views.events(spark, sf), _BUDGET).select("query_id", "rank", "event_id", "score", "cum_tokens")


SQL["vanilla_rag_packed"] = f"""WITH {sql.knn('q.vec_id % 20 = 0', k=10)}, {_LINES} SELECT query_id, rank, event_id, score, cum_tokens FROM (
  SELECT *, CAST(sum(tokens) OVER (PARTITION BY query_id ORDER BY rank) AS BIGINT) AS cum_tokens FROM knn JOIN lines USING (event_id)) WHERE cum_tokens <= {_BUDGET}"""


@query
def embedding_floor(spark, sf):
    """The four best lexical hits, filled up to ten by vectors."""
    base = retrieval.bm25(views.events(spark, sf), views.questions(spark, sf), 4)
    near = retrieval.knn(views.vectors(spark, sf), _question_vectors(spark, sf), 30)
    return retrieval.embedding_floor(base, near)


SQL["embedding_floor"] = f"""WITH {sql.BM25}, {sql.knn("q.vec_id IN (SELECT item_id FROM benchmark)", k=30)}, base AS (SELECT query_id, event_id, rank FROM bm25 WHERE rank <= 4),
  have AS (SELECT query_id, count(*) AS n, max(rank) AS r FROM base GROUP BY ALL),
  more AS (SELECT k.query_id, k.event_id, row_number() OVER (PARTITION BY k.query_id ORDER BY k.rank, k.event_id) AS i FROM knn k ANTI JOIN base b ON b.query_id = k.query_id AND b.event_id = k.event_id)
  SELECT query_id, event_id, rank, 'base' AS via FROM base UNION ALL
  SELECT m.query_id, event_id, CAST(coalesce(r, 0) + i AS INTEGER) AS rank, 'floor' AS via FROM more m LEFT JOIN have h USING (query_id) WHERE i <= 10 - coalesce(n, 0)"""


@query
def rag_floor(spark, sf):
    """Orders of under 8 events filled up in corpus order from the shard of the best hit, if it scores above the floor."""
    events = views.events(spark, sf)
    base = retrieval.bm25(events, views.questions(spark, sf), 3)
    top = base.where((F.col("rank") == 1) & (F.col("score") > DEFAULT.rag_floor_score)).join(best.of_events(events.select("event_id", "shard_id"), base), "event_id").select("query_id", "shard_id")
    # a shard's first events are the same for all questions: they are taken before the join
    first = rank.top_k(events.select("shard_id", "event_id"), ["shard_id"], [F.asc("event_id")], DEFAULT.rag_floor_events + 3)
    of_shard = top.join(first, "shard_id")
    return rank.backfill(base, of_shard, ["query_id"], DEFAULT.rag_floor_events)


SQL["rag_floor"] = f"""WITH {sql.BM25}, base AS (SELECT query_id, event_id, rank, score FROM bm25 WHERE rank <= 3),
  have AS (SELECT query_id, count(*) AS n, max(rank) AS r FROM base GROUP BY ALL),
  pool AS (SELECT b.query_id, d.doc_id AS event_id FROM base b JOIN documents s ON s.doc_id = b.event_id JOIN documents d ON d.source = s.source WHERE b.rank = 1 AND b.score > 4),
  more AS (SELECT p.query_id, p.event_id, row_number() OVER (PARTITION BY p.query_id ORDER BY p.event_id) AS i FROM pool p ANTI JOIN base b ON b.query_id = p.query_id AND b.event_id = p.event_id)
  SELECT query_id, event_id, rank, 'base' AS via FROM base UNION ALL
  SELECT m.query_id, event_id, CAST(coalesce(r, 0) + i AS INTEGER) AS rank, 'floor' AS via FROM more m LEFT JOIN have h USING (query_id) WHERE i <= 8 - coalesce(n, 0)"""


@query
def last_per_shard(spark, sf):
    return retrieval.last_per_shard(_fused(spark, sf), views.events(spark, sf))


SQL["last_per_shard"] = f"{_FUSE} SELECT query_id, source AS shard_id, arg_max(event_id, rank) AS event_id, max(rank) AS rank FROM fused JOIN documents ON doc_id = event_id GROUP BY ALL"


@query
def rerank_fallback(spark, sf):
    return retrieval.rerank_pool(retrieval.bm25(views.events(spark, sf), views.questions(spark, sf)), 5).select("query_id", "event_id", "rank", "rerank_score")


SQL["rerank_fallback"] = f"WITH {sql.BM25} SELECT query_id, event_id, rank, 0.0::DOUBLE AS rerank_score FROM bm25 WHERE rank <= 5"


def _footholds(spark, sf):
    return cut(retrieval.last_per_shard(retrieval.bm25(views.events(spark, sf), views.questions(spark, sf), 3), views.events(spark, sf)))


@query
def lexical_bridge(spark, sf):
    """In each foothold's shard, the events that hold most of the question's terms."""
    seeds = _footholds(spark, sf)
    terms = seeds.select("query_id", "shard_id").join(views.questions(spark, sf), "query_id").select("query_id", "shard_id", text.bridge_terms(F.col("question")).alias("terms"))
    return retrieval.bridge(views.events(spark, sf), seeds, terms, DEFAULT.entity_k)


_SEEDS = "seeds AS (SELECT query_id, source AS shard_id, arg_max(event_id, rank) AS seed FROM bm25 JOIN documents ON doc_id = event_id WHERE rank <= 3 GROUP BY ALL)"
_BRIDGED = """words AS (SELECT doc_id AS event_id, source AS shard_id, text FROM documents),
  hits AS (SELECT query_id, shard_id, event_id, count(*) AS score FROM (SELECT query_id, shard_id, seed, unnest(terms) AS t FROM own) JOIN words USING (shard_id)
    WHERE event_id <> seed AND regexp_matches(lower(text), '\\b' || regexp_escape(t) || '\\b') GROUP BY ALL)
  SELECT query_id, shard_id, event_id, CAST(score AS INTEGER) AS score, CAST(row_number() OVER (PARTITION BY query_id, shard_id ORDER BY score DESC, event_id DESC) AS INTEGER) AS rank FROM hits QUALIFY rank <= 6"""
SQL["lexical_bridge"] = f"WITH {sql.BM25}, {_SEEDS}, own AS (SELECT query_id, shard_id, seed, {sql.bridge_terms('question')} AS terms FROM seeds JOIN questions USING (query_id)), {_BRIDGED}"


@query
def entity_bridge(spark, sf):
    """As the lexical bridge, with the terms of the question and of the foothold's own text."""
    events, seeds = views.events(spark, sf), _footholds(spark, sf)
    own = seeds.join(best.of_events(events.select("event_id", "content"), seeds), "event_id").join(views.questions(spark, sf), "query_id")
    terms = own.select("query_id", "shard_id", text.bridge_terms(F.concat("question", F.lit("\n"), "content")).alias("terms"))
    return retrieval.bridge(events, seeds, terms, DEFAULT.entity_k)


SQL["entity_bridge"] = f"""WITH {sql.BM25}, {_SEEDS}, full_text AS (SELECT query_id, shard_id, seed, question || chr(10) || text AS x FROM seeds JOIN questions USING (query_id) JOIN documents ON doc_id = seed),
  own AS (SELECT query_id, shard_id, seed, {sql.bridge_terms('x')} AS terms FROM full_text), {_BRIDGED}"""


@query
def shard_expansion(spark, sf):
    """Nearest siblings put behind the last event of each shard that the order touches."""
    events = views.events(spark, sf)
    base = retrieval.bm25(events, views.questions(spark, sf), 6)
    # of a shard's nearest the order can have no more than its own 6 already
    groups = retrieval.sibling_groups(events, base, views.vectors(spark, sf), _question_vectors(spark, sf), DEFAULT.expand_k + 6)
    return folds.expand_shards(base, groups, DEFAULT.expand_max, DEFAULT.expand_k)


@query
def lexical_insertion(spark, sf):
    """The lexical bridge's events put into the order, behind the last event of each shard that it touches."""
    events, questions = views.events(spark, sf), views.questions(spark, sf)
    base = retrieval.bm25(events, questions, 6)
    return folds.expand_shards(base, retrieval.lexical_groups(events, base, questions), DEFAULT.lexical_max, DEFAULT.entity_k)


SQL["lexical_insertion"] = f"""WITH {sql.BM25}, base AS (SELECT query_id, event_id, rank, source AS shard_id FROM bm25 JOIN documents ON doc_id = event_id WHERE rank <= 6),
  anchors AS (SELECT query_id, shard_id, min(rank) AS first, max(rank) AS last FROM base GROUP BY ALL),
  own AS (SELECT query_id, shard_id, first, last, unnest({sql.bridge_terms('question')}) AS t FROM anchors JOIN questions USING (query_id)),
  hits AS (SELECT query_id, shard_id, first, last, doc_id AS event_id, count(*) AS score FROM own JOIN documents ON source = shard_id
    WHERE regexp_matches(lower(text), '\\b' || regexp_escape(t) || '\\b') GROUP BY ALL),
  ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY score DESC, event_id DESC) AS r FROM hits QUALIFY r <= 16),
  fresh AS (SELECT query_id, event_id, first, last, row_number() OVER (PARTITION BY query_id, shard_id ORDER BY r) AS m FROM ranked ANTI JOIN base USING (query_id, event_id) QUALIFY m <= 6),
  room AS (SELECT query_id, 20 - count(*) AS room FROM base GROUP BY ALL),
  added AS (SELECT query_id, event_id, last, m, row_number() OVER (PARTITION BY query_id ORDER BY first, m) AS n, room FROM fresh JOIN room USING (query_id) QUALIFY n <= room)
  SELECT query_id, event_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rank, m) - 1 AS INTEGER) AS place
  FROM (SELECT query_id, event_id, rank, 0 AS m FROM base UNION ALL SELECT query_id, event_id, last, m FROM added)"""


@query
def entity_insertion(spark, sf):
    """The entity bridge's events put into the order, behind each event whose terms they share."""
    events, questions = views.events(spark, sf), views.questions(spark, sf)
    base = retrieval.bm25(events, questions, 6)
    return folds.expand_shards(base, retrieval.entity_groups(events, base, questions), DEFAULT.entity_max, DEFAULT.entity_k)


@query
def longctx_pack(spark, sf):
    """The events of the sampled slice of each size in a seeded order, packed to the budget."""
    c = views.corpus(spark, sf)
    core = c.where("is_core").agg(F.sum("token_count")).first()[0] or 0
    slices = folds.sample_corpus(c, DEFAULT.seed, [core + 10_000, core + 100_000]).where("event_id IS NOT NULL")
    order = folds.shuffled_order(slices.withColumn("target", F.col("target").cast("string")), 0x6C6F6E67, "target")
    lines = order.join(c.select("event_id", text.estimate_tokens(retrieval.context_line(F.col("event_id"), F.col("content"))).alias("tokens")), "event_id")
    return rank.prefix_pack(lines, ["target"], [F.asc("ordinal")], F.col("tokens"), 8000 - DEFAULT.scaffolding_tokens)


@query
def corpus_sampler(spark, sf):
    c = views.corpus(spark, sf)
    core = c.where("is_core").agg(F.sum("token_count")).first()[0] or 0
    return folds.sample_corpus(c, DEFAULT.seed, [core + 10_000, core + 100_000])


@query
def seeded_shuffle(spark, sf):
    return folds.shuffled_order(views.events(spark, sf), DEFAULT.seed)


@query
def filler_variants(spark, sf):
    """Variants of core events whose numbers are jittered by a stream of their own."""
    from ..operators.fillers import variants

    made = variants(views.corpus(spark, sf).where("is_core"), 2, DEFAULT.seed)
    return made.select("event_id", "shard_id", F.md5("content").alias("content"), "token_count", "tier", F.array_join("tags", ",").alias("tags"))
