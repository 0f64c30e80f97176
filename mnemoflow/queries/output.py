"""Queries over what models say and are asked, packets and contexts, batches and merges, evidence for agents."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import model_output, prompts, text
from ..operators import agent, context, evaluate, report, retrieval, validate
from ..sources import views
from ..sources.cut import scratch_path
from ..sources.model import Calls
from ..sources.store import EMBEDDED, MemoryStore
from . import sql
from .agent import _SCORED, TERMS

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


def _said(spark, sf):
    """An answer for each event: its JSON bare, fenced, in prose with brackets in strings, or broken."""
    body = F.to_json(F.struct(F.col("event_id").alias("id"), F.concat(F.lit('x } " '), "shard_id").alias("note")))
    k = F.col("event_id") % 4
    said = (
        F.when(k == 0, F.concat(F.lit("  "), body, F.lit("\n"))).when(k == 1, F.concat(F.lit("Sure:\n```json\n"), body, F.lit("\n```\nDone.")))
        .when(k == 2, F.concat(F.lit("I think (a} so "), body, F.lit(" and {more"))).otherwise(F.concat(F.lit("{ none "), F.col("event_id").cast("string")))
    )
    return views.events(spark, sf).select("event_id", "shard_id", said.alias("said"))


@query
def json_extract(spark, sf):
    """The JSON of each answer, and what a schema makes of it."""
    json = model_output.extract_json(F.col("said"))
    rows = _said(spark, sf).select("event_id", json.alias("json"))
    read = model_output.conforming(F.col("json"), "id BIGINT, note STRING", ["id"])
    return rows.select("event_id", "json", read["id"].alias("id"), read["note"].alias("note"))


SQL["json_extract"] = """WITH e AS (SELECT doc_id AS event_id, 'x } " ' || source AS note FROM documents)
SELECT event_id, CASE WHEN event_id % 4 < 3 THEN '{"id":' || event_id || ',"note":"' || replace(note, '"', '\\"') || '"}' END AS json,
  CASE WHEN event_id % 4 < 3 THEN event_id END AS id, CASE WHEN event_id % 4 < 3 THEN note END AS note FROM e"""


@query
def json_last_valid(spark, sf):
    """Of an array of thoughts the last element that has what is required."""
    said = F.concat(F.lit('[{"id": 1}, {"id": '), F.col("event_id").cast("string"), F.lit(', "note": "'), "shard_id", F.lit('"}, {"thought": "'), F.col("event_id").cast("string"), F.lit('"}]'))
    read = model_output.conforming(model_output.extract_json(F.concat(F.lit("Here: "), said)), "id BIGINT, note STRING", ["id", "note"])
    return views.events(spark, sf).select("event_id", read["id"].alias("id"), read["note"].alias("note"))


SQL["json_last_valid"] = "SELECT doc_id AS event_id, doc_id AS id, source AS note FROM documents"


@query
def claims_tolerant(spark, sf):
    """Whole claims of arrays of which one lacks its support and one has a word for a number."""
    n = F.col("event_id").cast("string")
    said = F.concat(F.lit('[{"claim": "a'), n, F.lit('", "support": ["'), "shard_id", F.lit('"], "confidence": 0.5}, {"claim": "b"}, {"claim": "c", "support": [], "confidence": "high"}, {"claim": "d", "support": ["x", "y"], "confidence": 1}]'))
    rows = views.events(spark, sf).select("event_id", F.explode(model_output.tolerant_claims(said)).alias("c"))
    return rows.select("event_id", F.col("c.claim").alias("claim"), F.array_join("c.support", ",").alias("support"), F.col("c.confidence").alias("confidence"))


SQL["claims_tolerant"] = """SELECT doc_id AS event_id, 'a' || doc_id AS claim, source AS support, 0.5::DOUBLE AS confidence FROM documents
UNION ALL SELECT doc_id, 'd', 'x,y', 1.0::DOUBLE FROM documents"""


@query
def markers(spark, sf):
    """Events wrapped, fenced, unfenced and found again."""
    wrapped = model_output.wrap_event(F.col("event_id").cast("string"), F.coalesce("content", F.lit("")))
    rows = views.events(spark, sf).select("event_id", wrapped.alias("w"))
    fenced = F.concat(F.lit("```\n"), "w", F.lit("\n```"))
    return rows.select("event_id", F.array_join(model_output.marked_events(F.concat("w", "w")), ",").alias("ids"), (model_output.unfence(fenced) == text.strip(F.col("w"))).alias("same"), F.md5(model_output.unfence(F.col("w"))).alias("plain"))


SQL["markers"] = """SELECT doc_id AS event_id, doc_id || ',' || doc_id AS ids, TRUE AS same, md5('<<<EVT id=' || doc_id || '>>>' || chr(10) || coalesce(text, '') || chr(10) || '<<<END>>>') AS plain FROM documents"""


@query
def retry_plan(spark, sf):
    """Which faults pass by themselves, and how long to wait before each attempt."""
    words = ["HTTP 429 too many", "HTTP 404 not found", "request Timed Out", "HTTP 5030", "overloaded", "bad key", "RESOURCE_EXHAUSTED"]
    message = F.element_at(F.array(*map(F.lit, words)), (F.col("event_id") % 7 + 1).cast("int"))
    return views.events(spark, sf).select("event_id", model_output.transient(message).alias("transient"), model_output.retry_delay((F.col("event_id") % 5).cast("double"), 500).alias("delay_ms"))


SQL["retry_plan"] = "SELECT doc_id AS event_id, list_contains([0, 2, 4, 6], doc_id % 7) AS transient, CAST(500 * 2 ** (doc_id % 5) AS BIGINT) AS delay_ms FROM documents"


def _counting():
    """A model that says how long the prompt is. It fails twice, and then answers, or fails for good, by the length."""
    tried: dict[str, int] = {}

    async def call(prompt: str) -> str:
        tried[prompt] = tried.get(prompt, 0) + 1
        if len(prompt) % 13 == 0:
            raise ValueError("HTTP 400 refused")
        if len(prompt) % 7 == 0 and tried[prompt] % 3:
            raise OSError("HTTP 503 busy")
        return f"length {len(prompt)}"

    return call


@query
def model_calls(spark, sf):
    """Every event is asked about, a few calls at a time; faults that pass by themselves are tried again."""
    asked = views.events(spark, sf).select(F.col("event_id").cast("string").alias("key"), F.concat(F.col("event_id").cast("string"), F.lit(" "), F.coalesce("content", F.lit(""))).alias("prompt"))
    return Calls(_counting, limit=4, base_ms=1).complete(asked)


SQL["model_calls"] = """SELECT CAST(doc_id AS VARCHAR) AS key, CASE WHEN n % 13 <> 0 THEN 'length ' || n END AS response,
  CAST(CASE WHEN n % 13 = 0 THEN 1 WHEN n % 7 = 0 THEN 3 ELSE 1 END AS INTEGER) AS attempts, CASE WHEN n % 13 = 0 THEN 'HTTP 400 refused' END AS error
  FROM (SELECT doc_id, length(doc_id || ' ' || coalesce(text, '')) AS n FROM documents)"""


def _measures(texts: list[str]) -> list[list[float]]:
    return [[float(len(t)), float(t.count(" "))] for t in texts]


@query
def embedding_cache(spark, sf):
    """Vectors of the questions' texts, then of all texts: the second time those that are there aren't made again."""
    store = MemoryStore(spark, scratch_path(spark, "store"))
    texts = views.events(spark, sf).select(F.coalesce("content", F.lit("")).alias("text"))
    store.embedded(views.questions(spark, sf).select(F.col("question").alias("text")), _measures)
    store.embedded(texts, _measures)
    first, second = (spark.read.parquet(p).select("text_sha") for p in store.parts("embeddings"))
    made = first.withColumn("made", F.lit("first")).unionByName(second.withColumn("made", F.lit("second")))
    vectors = store.read("embeddings", EMBEDDED)
    return made.join(vectors, "text_sha").select("text_sha", "made", F.col("vec")[0].alias("length"), F.col("vec")[1].alias("blanks"))


SQL["embedding_cache"] = f"""WITH {sql.QUESTIONS}, texts AS (SELECT question AS t, 'first' AS made FROM questions UNION ALL SELECT coalesce(text, ''), 'second' FROM documents)
  SELECT sha256(t) AS text_sha, min(made) AS made, CAST(length(t) AS DOUBLE) AS length, CAST(length(t) - length(replace(t, ' ', '')) AS DOUBLE) AS blanks FROM texts GROUP BY t"""


@query
def choice_prompts(spark, sf):
    """Prompts over all nations as options."""
    options = views.table(spark, sf, "nation").agg(F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", "n_name"))), lambda x: x["n_name"]).alias("options"))
    rows = views.questions(spark, sf).join(F.broadcast(options))  # one row
    return rows.select("query_id", F.md5(prompts.numbered(F.col("options"))).alias("options"), F.md5(prompts.choice(F.col("question"), F.col("options"), F.lit("none"))).alias("choice"), F.md5(prompts.free(F.col("question"), F.lit("none"))).alias("free"))


SQL["choice_prompts"] = f"""WITH {sql.QUESTIONS}, o AS (SELECT string_agg(CAST(i AS VARCHAR) || '. ' || n_name, chr(10) ORDER BY i) AS listed, count(*) AS n FROM (SELECT n_name, row_number() OVER (ORDER BY n_nationkey) AS i FROM nation)),
  c AS (SELECT chr(10) || 'CITATIONS: event ids from the context that support it, with commas between, or none' AS cite, chr(10) || chr(10) AS gap)
  SELECT query_id, md5(listed) AS options,
  md5('Choose the option that the context supports best.' || gap || 'CONTEXT:' || chr(10) || 'none' || gap || 'QUESTION: ' || question || gap || 'OPTIONS:' || chr(10) || listed || gap || 'Reason briefly, then end with these two lines:' || chr(10) || 'ANSWER: a number from 1 to ' || n || cite) AS choice,
  md5('Answer from the context alone.' || gap || 'CONTEXT:' || chr(10) || 'none' || gap || 'QUESTION: ' || question || gap || 'Reply with these two lines only:' || chr(10) || 'ANSWER: a word or short phrase' || cite) AS free FROM questions, o, c"""


@query
def context_assembly(spark, sf):
    """Packets whose claims cite every second hit; cited events come first, then the other hits, while header and events fit."""
    events, asked = views.events(spark, sf), views.questions(spark, sf)
    hits = retrieval.bm25(events, asked).select("query_id", "rank", "event_id", F.concat(F.lit("s@S001:"), F.col("event_id").cast("string")).alias("source"))
    per = hits.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", "source", "event_id"))).alias("h"))
    sources = F.transform(F.filter("h", lambda x: x["rank"] % 2 == 0), lambda x: x["source"])
    claims = F.transform(sources, lambda s: F.struct(s.alias("claim"), F.array(s).alias("sources"), F.lit(0.5).alias("confidence")))
    rows = asked.join(per, "query_id").withColumn("claims", claims)
    none = F.array().cast("array<string>")
    packets = rows.select("query_id", context.header(F.col("question"), F.col("claims"), none, F.array(F.lit("as stored"))).alias("header"))
    order = context.retrieval_order(context.cited(F.flatten("claims.sources")), F.transform("h", lambda x: x["event_id"].cast("string")))
    orders = context.ordered(rows.select("query_id", order.alias("order"))).withColumn("event_id", F.col("event_id").cast("long"))
    out = context.assemble(packets, orders, events, 2000)
    return out.select("query_id", F.md5("context").alias("context"), "context_tokens", F.array_join("packed", ",").alias("packed"))


SQL["context_assembly"] = f"""WITH {sql.BM25},
  heads AS (SELECT query_id, 'MEMORY PACKET:' || chr(10) || 'SUMMARY: ' || question || chr(10) || 'KEY CLAIMS:' || chr(10) ||
    coalesce(string_agg('- s@S001:' || event_id || ' (sources: s@S001:' || event_id || ', conf=0.50)', chr(10) ORDER BY rank) FILTER (WHERE rank % 2 = 0), '- (no key claims surfaced)') || chr(10) || chr(10) || 'CAVEATS:' || chr(10) || '- as stored' AS h
    FROM bm25 JOIN questions USING (query_id) GROUP BY query_id, question),
  lines AS (SELECT b.query_id, b.event_id, h, row_number() OVER (PARTITION BY query_id ORDER BY rank % 2, rank) AS place, '[' || event_id || '] ' || text || chr(10) AS line FROM bm25 b JOIN heads USING (query_id) JOIN documents ON doc_id = event_id),
  sums AS (SELECT *, {sql.tokens("h")} AS ht, sum({sql.tokens("line")}) OVER (PARTITION BY query_id ORDER BY place) AS used FROM lines),
  packed AS (SELECT query_id, string_agg(line, '' ORDER BY place) AS body, CAST(max(used) AS BIGINT) AS used, string_agg(CAST(event_id AS VARCHAR), ',' ORDER BY place) AS packed FROM sums WHERE used <= 2000 - ht GROUP BY query_id)
  SELECT query_id, md5(h || chr(10) || 'CITED EVENTS:' || chr(10) || coalesce(body, '(none)' || chr(10))) AS context, {sql.tokens("h")} + coalesce(used, 0) AS context_tokens, coalesce(packed, '') AS packed FROM heads LEFT JOIN packed USING (query_id)"""


@query
def reverse_lookup(spark, sf):
    """The event that each text stands for, of equal texts the last."""
    events = views.events(spark, sf)
    found = context.reverse_lookup(events.select(F.col("event_id").alias("asked"), "content"), events.select("event_id", "content"))
    return found.select("asked", "event_id")


SQL["reverse_lookup"] = "SELECT a.doc_id AS asked, b.event_id FROM documents a LEFT JOIN (SELECT text, max(doc_id) AS event_id FROM documents WHERE text IS NOT NULL GROUP BY text) b USING (text)"


@query
def phase_merge(spark, sf):
    """Events of each language as a phase: what a merge counts and mends."""
    c = views.corpus(spark, sf)
    rows = c.select(F.col("event_id").alias("id"), F.col("shard_id").alias("shardId"), "content", (F.col("token_count") + F.when(F.col("event_id") % 3 == 0, 1).otherwise(0)).alias("tokenCount"), F.col("is_core").alias("isCore"), "tier", F.col("tags")[0].alias("phase"))
    return validate.phase_counts(validate.normalised(rows))


SQL["phase_merge"] = f"""WITH {sql.CORPUS} SELECT tags[1] AS phase, shard_id AS "shardId", count(*) AS n_events, CAST(sum(token_count) AS BIGINT) AS tokens,
  CAST(count(*) FILTER (WHERE NOT is_core) AS BIGINT) AS core_fixed, CAST(count(*) FILTER (WHERE tier <> 0) AS BIGINT) AS tier_fixed, CAST(count(*) FILTER (WHERE event_id % 3 = 0) AS BIGINT) AS tokens_fixed FROM corpus GROUP BY ALL"""


def _queries(spark, sf):
    """Queries over words of the items: options are an item's words."""
    o = F.split("question", " ")
    return views.questions(spark, sf).select(F.col("query_id").alias("id"), F.when(F.col("query_id") % 2 == 0, "adversarial").when(F.col("query_id") % 3 == 0, "lookup").alias("category"), o.alias("options"), (F.col("query_id") % 45).alias("correctOption"))


@query
def batch_faults(spark, sf):
    return validate.query_faults(_queries(spark, sf)).select("id", F.array_join("faults", ",").alias("faults"))


_NEGATIVE = "len(list_filter(o, lambda x: len(list_filter({}, lambda k: contains(lower(x), k))) > 0))".format(sql.words(list(validate.NEGATIVE)))
SQL["batch_faults"] = f"""WITH q AS (SELECT item_id AS id, string_split(text, ' ') AS o, item_id % 45 AS c, CASE WHEN item_id % 2 = 0 THEN 'adversarial' WHEN item_id % 3 = 0 THEN 'lookup' END AS category FROM benchmark)
  SELECT id, concat_ws(',', CASE WHEN len(o) <> 40 THEN 'option_count' END, CASE WHEN c NOT BETWEEN 1 AND 40 THEN 'correct_option' END, CASE WHEN len(list_distinct(o)) <> len(o) THEN 'duplicate_option' END,
  CASE WHEN category = 'adversarial' AND {_NEGATIVE} < 3 THEN 'too_few_negatives' END) AS faults FROM q"""


@query
def query_categories(spark, sf):
    return validate.per_category(_queries(spark, sf))


SQL["query_categories"] = """SELECT CASE WHEN item_id % 2 = 0 THEN 'adversarial' WHEN item_id % 3 = 0 THEN 'lookup' ELSE 'uncategorised' END AS category, count(*) AS n, CAST(sum(len(string_split(text, ' '))) AS BIGINT) AS n_options FROM benchmark GROUP BY ALL"""


@query
def cells_enriched(spark, sf):
    """Summaries with the model of their run; a run without a configuration has an unknown one."""
    runs = views.table(spark, sf, "region").select(F.concat(F.lit("run-"), F.col("r_regionkey").cast("string")).alias("run_id"), F.lower("r_name").alias("model")).where("model <> 'asia'")
    cells = evaluate.current_cells(views.cells(spark, sf)).withColumn("run_id", F.concat(F.lit("run-"), F.col("trial").cast("string")))
    return report.with_models(evaluate.aggregate(cells, ["run_id", "system"]), runs).select("run_id", "system", "model", "n", "accuracy")


SQL["cells_enriched"] = f"""WITH {sql.CELLS}, runs AS (SELECT 'run-' || r_regionkey AS run_id, lower(r_name) AS model FROM region WHERE lower(r_name) <> 'asia')
  SELECT run_id, system, coalesce(model, 'unknown-model') AS model, n, accuracy FROM (SELECT 'run-' || trial AS run_id, system, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM current GROUP BY ALL) LEFT JOIN runs USING (run_id)"""


@query
def headline_table(spark, sf):
    """Systems on the queries that the main one has, with its citation F1 against the best other's."""
    return report.headline_table(evaluate.current_cells(views.cells(spark, sf)), "memory")


SQL["headline_table"] = f"""WITH {sql.CELLS}, common AS (SELECT DISTINCT query_id FROM current WHERE system = 'memory'),
  t AS (SELECT system, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(CASE WHEN citation_precision + citation_recall = 0 THEN 0.0 ELSE 2 * citation_precision * citation_recall / (citation_precision + citation_recall) END), 6)::DOUBLE AS mean_f1,
    round(avg(input_tokens), 6) AS mean_input_tokens, round(avg(latency_ms), 6) AS mean_latency_ms FROM current SEMI JOIN common USING (query_id) GROUP BY system),
  best AS (SELECT max(mean_f1) AS f FROM t WHERE system <> 'memory')
  SELECT t.*, CASE WHEN system = 'memory' THEN round(mean_f1 / greatest(f, 1e-9), 6) END AS f1_ratio FROM t, best"""


@query
def two_role_pair(spark, sf):
    """The days between the best dated turns for two roles in each conversation, else between the first pair."""
    rows = agent.scored(views.turns(spark, sf), text.strings(TERMS))
    anchored = agent.anchors(rows, ["shard_id"]).join(rows.select("shard_id", "event_id", "content"), ["shard_id", "event_id"])
    asked = rows.select("shard_id").distinct().select("shard_id", text.strings(TERMS[2:5]).alias("left"), text.strings(TERMS[5:]).alias("right"))
    pairs = agent.segment_pair(anchored, asked, ["shard_id"])
    return pairs.select("shard_id", F.col("first.event_id").alias("first_id"), F.col("second.event_id").alias("second_id"), "days")


SQL["two_role_pair"] = f"""WITH {_SCORED}, a AS (SELECT shard_id, event_id, content, d, CAST(d AS DATE) AS day, row_number() OVER (PARTITION BY shard_id ORDER BY score DESC, CAST(d AS DATE), event_id) AS place
    FROM (SELECT DISTINCT shard_id, event_id, content, score, unnest(dates) AS d FROM scored)),
  fits AS (SELECT *, {sql.coverage('content', sql.words(TERMS[2:5]))} AS lf, {sql.coverage('content', sql.words(TERMS[5:]))} AS rf FROM a),
  l AS (SELECT * FROM fits WHERE lf > 0 QUALIFY row_number() OVER (PARTITION BY shard_id ORDER BY lf DESC, place) = 1),
  r AS (SELECT f.* FROM fits f LEFT JOIN l USING (shard_id) WHERE f.rf > 0 AND f.event_id IS DISTINCT FROM l.event_id QUALIFY row_number() OVER (PARTITION BY f.shard_id ORDER BY f.rf DESC, f.place) = 1),
  roles AS (SELECT l.shard_id, l.event_id AS xe, r.event_id AS ye, l.day AS xd, r.day AS yd FROM l JOIN r USING (shard_id) WHERE l.day <> r.day),
  firsts AS (SELECT x.shard_id, x.event_id AS xe, y.event_id AS ye, x.day AS xd, y.day AS yd FROM a x JOIN a y ON x.shard_id = y.shard_id AND x.place < y.place AND x.event_id <> y.event_id AND x.day <> y.day
    QUALIFY row_number() OVER (PARTITION BY x.shard_id ORDER BY x.place, y.place) = 1),
  p AS (SELECT * FROM roles UNION ALL SELECT * FROM firsts ANTI JOIN roles USING (shard_id))
  SELECT shard_id, CASE WHEN xd < yd THEN xe ELSE ye END AS first_id, CASE WHEN xd < yd THEN ye ELSE xe END AS second_id, CAST(abs(xd - yd) AS INTEGER) AS days FROM p"""


@query
def capsules(spark, sf):
    """Evidence for a question of every kind, one for each conversation."""
    asks = ["Summarize what the number and the thanks were about", "How many days between when the password came and when the question was asked?", "Did I ever contradict the number before?", "How many different things did I thank you about?", "Why choose this rationale?", "Tell the weather"]
    turns = views.turns(spark, sf)
    q = F.element_at(F.array(*map(F.lit, asks)), (F.col("shard_id") % len(asks) + 1).cast("int"))
    asked = turns.select("shard_id").distinct().select(F.col("shard_id").alias("query_id"), "shard_id", q.alias("query"))
    return agent.capsules(turns, asked).select("query_id", "n_lines", F.md5("capsule").alias("capsule"))


@query
def stable_json(spark, sf):
    """Nested JSON whose keys stand in disorder, with its keys in order."""
    pages = spark.read.parquet(f"{sf}/pages.parquet")
    inner = F.struct(F.length("html").alias("z"), F.array(F.struct(F.col("url").alias("b"), F.col("page_id").alias("a"))).alias("m"))
    said = F.to_json(F.struct(F.col("url"), F.col("page_id"), inner.alias("meta")), {"ignoreNullFields": "false"})
    return pages.select("page_id", model_output.stable_json(said).alias("json"))


SQL["stable_json"] = """SELECT page_id, CAST(json_object('meta', json_object('m', json_array(json_object('a', page_id, 'b', url)), 'z', length(html)), 'page_id', page_id, 'url', url) AS VARCHAR) AS json FROM pages"""
