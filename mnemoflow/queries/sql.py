"""Pieces of DuckDB SQL that several oracles share."""

from __future__ import annotations

from ..functions.words import BRIDGE_STOP, CONTENT_STOP, HIGH_SIGNAL, ROUTER_STOP, SYNONYMS

CORPUS = """corpus AS (
  SELECT d.doc_id AS event_id, source AS shard_id, text AS content, CAST(ceil(length(coalesce(text, '')) / 4.0) AS BIGINT) AS token_count,
    coalesce(l.quality = 1, FALSE) AS is_core,
    CAST(CASE WHEN coalesce(l.quality = 1, FALSE) THEN 0 ELSE 1 + d.doc_id % 4 END AS INTEGER) AS tier, [lang, source] AS tags
  FROM documents d LEFT JOIN labels l USING (doc_id))"""
QUESTIONS = "questions AS (SELECT item_id AS query_id, text AS question FROM benchmark)"
_DAY = "CAST(DATE '2024-01-01' + CAST((conv_id * 3 + turn) % 700 AS INTEGER) AS DATE)"
TURNS = f"""turns AS (
  SELECT 'conv-' || conv_id || '#turn-' || turn AS event_id, conv_id AS shard_id, turn, role,
    '[Turn ' || turn || '] ' || upper(role[1]) || lower(role[2:]) || ': ' || text || ' on ' || {_DAY} AS content, {_DAY} AS day FROM conversations)"""
CELLS = """cells AS (
  SELECT ['memory', 'vanilla', 'hybrid', 'longctx'][CAST(s % 4 + 1 AS INTEGER)] AS system,
    CAST([100000, 1000000, 10000000][CAST(l_linenumber % 3 + 1 AS INTEGER)] AS BIGINT) AS corpus_size,
    CAST(CASE WHEN l_orderkey % 2 = 0 THEN 8192 ELSE 32768 END AS BIGINT) AS model_context, CAST(l_orderkey % 3 AS INTEGER) AS trial,
    'q' || (l_orderkey % 97) AS query_id, (p * 7 + l_orderkey) % 10 < 7 - l_linenumber % 3 * 2 AS correct,
    p % 5 / 4.0::DOUBLE AS citation_precision, s % 3 / 2.0::DOUBLE AS citation_recall, CAST(q AS BIGINT) AS input_tokens,
    l_orderkey % 1000 AS latency_ms, CASE WHEN l_orderkey % 31 = 0 THEN 'timeout' END AS error, l_orderkey * 10 + l_linenumber AS line_no
  FROM (SELECT l_orderkey, l_linenumber, max(l_suppkey) AS s, sum(l_quantity) AS q, max(l_partkey) AS p FROM lineitem GROUP BY ALL)
), current AS (SELECT * FROM cells QUALIFY row_number() OVER (PARTITION BY system, model_context, corpus_size, trial, query_id ORDER BY line_no DESC) = 1)"""
BM25 = f"""{QUESTIONS}, asked AS (
  SELECT query_id, tok, count(*) AS times FROM (SELECT query_id, unnest(regexp_split_to_array(lower(question), '[^a-z0-9]+')) AS tok FROM questions) WHERE length(tok) >= 2 GROUP BY ALL
), held AS (SELECT doc_id AS event_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 2) AS toks FROM documents
), stats AS (SELECT count(*) AS documents, avg(len(toks)) AS average FROM held
), postings AS (SELECT event_id, tok, any_value(n) AS length, count(*) AS tf FROM (SELECT event_id, len(toks) AS n, unnest(toks) AS tok FROM held) WHERE tok IN (SELECT tok FROM asked) GROUP BY event_id, tok
), df AS (SELECT tok, count(*) AS df FROM postings GROUP BY tok
), lexical AS (
  SELECT query_id, event_id, round(sum(times * ln((documents - df + 0.5) / (df + 0.5) + 1) * (tf * 2.5) / (tf + 1.5 * (1 - 0.75 + 0.75 * length / average))), 6) AS score
  FROM postings JOIN asked USING (tok) JOIN df USING (tok), stats GROUP BY ALL
), bm25 AS (
  SELECT query_id, event_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS INTEGER) AS rank FROM lexical WHERE score > 0 QUALIFY rank <= 20)"""


def knn(asked: str, name: str = "knn", k: int = 20, local: str = "") -> str:
    """Ranked dot products; ``asked``: a condition for the vectors that are queries."""
    return f"""{name} AS (
  SELECT query_id, event_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, event_id) AS INTEGER) AS rank FROM (
    SELECT q.vec_id AS query_id, e.vec_id AS event_id, round(list_dot_product(CAST(q.embedding AS DOUBLE[]), CAST(e.embedding AS DOUBLE[])), 6) AS score
    FROM embeddings q, embeddings e WHERE {asked} {local}) QUALIFY rank <= {k})"""


FUSED = """fused AS (
  SELECT query_id, event_id, rrf_score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf_score DESC, l NULLS LAST, v NULLS LAST, event_id) AS INTEGER) AS rank FROM (
    SELECT query_id, event_id, min(l) AS l, min(v) AS v, round(coalesce(1.0 / (60 + min(l)), 0) + coalesce(1.0 / (60 + min(v)), 0), 9)::DOUBLE AS rrf_score FROM (
      SELECT query_id, event_id, rank AS l, NULL::INTEGER AS v FROM bm25 UNION ALL SELECT query_id, event_id, NULL, rank FROM knn) GROUP BY ALL) QUALIFY rank <= 10)"""


def words(values: list[str]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def router(x: str) -> str:
    return f"list_filter(regexp_split_to_array(lower({x}), '[^a-z0-9_]+'), lambda t: length(t) > 1 AND NOT list_contains({words(ROUTER_STOP)}, t))"


def distinct_in_order(x: str) -> str:
    return f"list_filter({x}, lambda v, i: list_position({x}, v) = i)"


def tokens(x: str) -> str:
    return f"CAST(ceil(length(coalesce({x}, '')) / 4.0) AS BIGINT)"


def dates(x: str) -> str:
    from ..functions.dates import ISO, NAMED

    return f"list_concat(list_transform(regexp_extract_all({x}, '{NAMED}'), lambda d: replace(d, '-', ' ')), regexp_extract_all({x}, '{ISO}'))[1:8]"


def terms(x: str, pattern: str, stop: list[str], most: int) -> str:
    """A correlated subquery: the distinct terms of a text in order."""
    return f"""(SELECT coalesce((list(term ORDER BY place))[1:{most}], []) FROM (
      SELECT term, min(place) AS place FROM (
        SELECT regexp_replace(lower(raw), '''s$', '') AS term, raw, place FROM (
          SELECT unnest(regexp_extract_all({x}, '{pattern}')) AS raw, generate_subscripts(regexp_extract_all({x}, '{pattern}'), 1) AS place))
      WHERE (length(term) >= 4 OR raw[1] = upper(raw[1])) AND NOT list_contains({words(stop)}, term) GROUP BY term))"""


def bridge_terms(x: str) -> str:
    return terms(x, "[A-Za-z][A-Za-z''-]{2,}", BRIDGE_STOP, 12)


def content_terms(x: str) -> str:
    return terms(x, "[A-Za-z][A-Za-z0-9_.:-]{2,}", CONTENT_STOP, 16)


def has_word(content: str, t: str) -> str:
    """Whether a term stands between word borders."""
    return f"regexp_matches(lower({content}), '\\b' || regexp_escape({t}) || '\\b')"


def coverage(content: str, own: str) -> str:
    return f"""(coalesce(list_sum(list_transform(list_filter({own}, lambda t: {has_word(content, "t")}), lambda t: CASE WHEN length(t) >= 7 THEN 2 ELSE 1 END)), 0)
      + CASE WHEN len({dates(content)}) > 0 THEN 1 ELSE 0 END)"""


def weight(t: str) -> str:
    return f"""CASE WHEN list_contains({words(HIGH_SIGNAL)}, lower({t})) THEN 100 WHEN regexp_matches(lower({t}), '^\\d{{4}}-\\d{{2}}-\\d{{2}}$')
      OR regexp_matches(lower({t}), '^(jan|feb|mar|apr|may|jun|jul|aug|sep|oct|nov|dec)') THEN 80 ELSE least(40, length({t})) END"""


def expand(x: str) -> str:
    out = x
    for trigger, more in SYNONYMS.items():
        extra = words(more)
        out = f"(SELECT CASE WHEN list_contains(y, '{trigger}') THEN list_concat(y, list_filter({extra}, lambda v: NOT list_contains(y, v))) ELSE y END FROM (SELECT {out} AS y))"
    return f"({out})[1:48]"


def excerpt(content: str, own: str, most: int) -> str:
    """A correlated subquery: the window about the strongest of the terms and dates."""
    clean = f"trim(regexp_replace({content}, '\\s+', ' ', 'g'))"
    needles = f"list_distinct(list_concat(list_filter({own}, lambda t: length(t) > 0), list_transform({dates(clean)}, lambda d: lower(d))))"
    hits = f"list_filter(list_transform({needles}, lambda t: {{'w': {weight('t')}, 'p': -instr(lower({clean}), lower(t))}}), lambda x: x.p < 0)"
    return f"""(SELECT CASE WHEN length(c) <= {most} THEN c ELSE CASE WHEN s > 0 THEN '...' ELSE '' END || trim(substr(c, s + 1, least(length(c), s + {most}) - s)) || CASE WHEN s + {most} < length(c) THEN '...' ELSE '' END END
    FROM (SELECT c, CAST(greatest(0, coalesce(-(list_sort(hits))[-1].p - 1, 0) - {most // 3}) AS BIGINT) AS s FROM (SELECT {clean} AS c, {hits} AS hits)))"""
