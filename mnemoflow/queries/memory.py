"""Queries over the memory pipeline: directory, routing, probing, recall, packets, commits."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..functions import maths, text
from ..operators import commit, costs, folds, retrieval, router
from ..sources import views
from ..sources.cut import cut
from . import sql

QUERIES, SQL = {}, {}



def query(f):
    QUERIES[f.__name__] = f
    return f


def _ref():
    return F.lit("2024-02-01").cast("timestamp")


def _pipeline(spark, sf):
    corpus, questions = views.corpus(spark, sf), views.questions(spark, sf)
    entries = cut(router.directory(corpus))
    routed = cut(router.candidates(questions, entries, _ref()))
    return views.events(spark, sf), questions, entries, routed


@query
def shard_tier_stats(spark, sf):
    return views.corpus(spark, sf).groupBy("shard_id", "tier").agg(F.count("*").alias("n"), F.sum("token_count").alias("tokens"), F.min("event_id").alias("first"), F.max("event_id").alias("last"), F.round(F.avg(F.col("is_core").cast("double")), 6).alias("core_share"))


SQL["shard_tier_stats"] = f"WITH {sql.CORPUS} SELECT shard_id, tier, count(*) AS n, CAST(sum(token_count) AS BIGINT) AS tokens, min(event_id) AS first, max(event_id) AS last, round(avg(CAST(is_core AS DOUBLE)), 6) AS core_share FROM corpus GROUP BY ALL"


@query
def tag_union(spark, sf):
    return views.corpus(spark, sf).select("shard_id", F.explode("tags").alias("tag")).groupBy("shard_id").agg(F.array_join(F.array_sort(F.collect_set(F.lower("tag"))), ",").alias("tags"))


SQL["tag_union"] = f"WITH {sql.CORPUS} SELECT shard_id, string_agg(DISTINCT lower(tag), ',' ORDER BY lower(tag)) AS tags FROM (SELECT shard_id, unnest(tags) AS tag FROM corpus) GROUP BY ALL"


@query
def shard_directory(spark, sf):
    return router.directory(views.corpus(spark, sf)).select("id", "name", "description", F.array_join("tags", ",").alias("tags"), "summary_short", "n_events", "tokens", F.round("fullness_pct", 6).alias("fullness_pct"))


_DIRECTORY = f"""{sql.CORPUS}, directory AS (SELECT shard_id AS id, 'Shard ' || shard_id AS name, 'Events of ' || shard_id AS description,
  list_distinct_order AS tags, count || ' events, ' || n_core || ' core' AS summary_short, count AS n_events, tokens, least(100.0, tokens / 128000.0 * 100) AS fullness_pct FROM (
  SELECT shard_id, count(*) AS count, CAST(sum(token_count) AS BIGINT) AS tokens, count_if(is_core) AS n_core, list_append(list_sort(list(DISTINCT lower(tags[1]))), lower(shard_id)) AS list_distinct_order FROM corpus GROUP BY shard_id))"""
SQL["shard_directory"] = f"WITH {_DIRECTORY} SELECT id, name, description, array_to_string(tags, ',') AS tags, summary_short, n_events, tokens, round(fullness_pct, 6)::DOUBLE AS fullness_pct FROM directory"


@query
def shard_health(spark, sf):
    """Fullness and its label, of the tokens of events, roles and tags."""
    c = views.corpus(spark, sf)
    cost = text.estimate_tokens(F.col("content")) + text.estimate_tokens(F.lit("user")) + 8 + text.estimate_tokens(F.array_join("tags", ","))
    per = c.groupBy("shard_id").agg(F.sum(cost).alias("tokens"))
    pct = maths.fullness(F.col("tokens"), F.lit(50_000))
    return per.select("shard_id", "tokens", F.round(pct, 6).alias("fullness_pct"), maths.health(pct).alias("recommendation"), F.concat(maths.health(pct, 2), F.lit(" (fullness="), F.format_string("%.1f", pct), F.lit("%, status=active)")).alias("reason"))


_LABEL = "CASE WHEN p < 55 THEN '{}' WHEN p < 65 THEN '{}' WHEN p < 75 THEN '{}' WHEN p < 85 THEN '{}' ELSE '{}' END"
SQL["shard_health"] = f"""WITH {sql.CORPUS}, per AS (SELECT shard_id, CAST(sum(token_count + 1 + 8 + {sql.tokens("array_to_string(tags, ',')")}) AS BIGINT) AS tokens FROM corpus GROUP BY ALL),
  f AS (SELECT *, least(100.0::DOUBLE, tokens / 50000.0::DOUBLE * 100) AS p FROM per)
  SELECT shard_id, tokens, round(p, 6) AS fullness_pct, {_LABEL.format(*[h[1] for h in maths.HEALTH])} AS recommendation, {_LABEL.format(*[h[2] for h in maths.HEALTH])} || printf(' (fullness=%.1f%%, status=active)', p) AS reason FROM f"""

_MATCH = """len(list_filter(terms, lambda qt: len(list_filter({v}, lambda w: qt = w OR (least(length(qt), length(w)) >= 4 AND (starts_with(qt, w) OR starts_with(w, qt))))) > 0))"""
_ROUTED = f"""{_DIRECTORY}, {sql.QUESTIONS}, asked AS (SELECT query_id, {sql.distinct_in_order(sql.router('question'))} AS terms FROM questions),
known AS (SELECT *, list_transform(tags, lambda g: lower(g)) AS of_tags, {sql.router('description')} AS of_description, {sql.router('name')} AS of_name, {sql.router('summary_short')} AS of_summary FROM directory),
counts AS (SELECT query_id, id AS shard_id, fullness_pct, {_MATCH.format(v='of_tags')} AS tag, {_MATCH.format(v='of_description')} AS des, {_MATCH.format(v='of_name')} AS nam, {_MATCH.format(v='of_summary')} AS summ,
  greatest(0, 1 - (epoch(TIMESTAMP '2024-02-01') - epoch(TIMESTAMP '2024-01-01')) / 86400.0 / 90) AS rec FROM asked, known),
scored AS (SELECT *, round((tag * 2 + des + nam * 1.5 + summ * 0.75 + rec - CASE WHEN fullness_pct >= 85 THEN 1.0 WHEN fullness_pct >= 75 THEN 0.5 ELSE 0 END)::DOUBLE, 6) AS score FROM counts),
routed AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, shard_id) AS INTEGER) AS rank FROM scored QUALIFY rank <= 8)"""


@query
def router_candidates(spark, sf):
    return _pipeline(spark, sf)[3].select("query_id", "shard_id", "score", "rank")


SQL["router_candidates"] = f"WITH {_ROUTED} SELECT query_id, shard_id, score, rank FROM routed"


@query
def router_reasons(spark, sf):
    return _pipeline(spark, sf)[3].select("query_id", "shard_id", F.array_join("reasons", "; ").alias("reasons"))


SQL["router_reasons"] = f"""WITH {_ROUTED} SELECT query_id, shard_id, concat_ws('; ', CASE WHEN tag > 0 THEN 'tagOverlap=' || tag END, CASE WHEN des > 0 THEN 'descMatch=' || des END, CASE WHEN nam > 0 THEN 'nameMatch=' || nam END,
  CASE WHEN summ > 0 THEN 'summaryMatch=' || summ END, CASE WHEN rec > 0 THEN printf('recency=%.2f', rec::DOUBLE) END,
  CASE WHEN fullness_pct >= 85 THEN printf('fullness=%.1f%% -1.0', fullness_pct::DOUBLE) WHEN fullness_pct >= 75 THEN printf('fullness=%.1f%% -0.5', fullness_pct::DOUBLE) END) AS reasons FROM routed"""

_PROBED = f"""{_ROUTED}, event_terms AS (SELECT shard_id, event_id, unnest(list_distinct(list_concat({sql.router('content')}, flatten(list_transform(tags, lambda g: {sql.router('g')}))))) AS tok FROM corpus),
q_terms AS (SELECT query_id, unnest(terms) AS tok FROM asked),
hits AS (SELECT query_id, shard_id, event_id, count(*) AS hits FROM event_terms JOIN q_terms USING (tok) GROUP BY ALL),
per AS (SELECT query_id, shard_id, CAST(sum(hits) AS BIGINT) AS hits, (list(event_id ORDER BY event_id))[1:6] AS relevant FROM hits GROUP BY ALL),
signals AS (SELECT a.query_id, k.id AS shard_id, relevant, coalesce(hits, 0) + len(list_filter(tags, lambda t: list_contains(terms, lower(t)))) * 2 + len(list_filter(terms, lambda t: list_contains(of_summary, t))) AS signal,
  len(terms) AS nq, n_events FROM asked a CROSS JOIN known k LEFT JOIN per p ON p.query_id = a.query_id AND p.shard_id = k.id),
raw AS (SELECT *, greatest(0.0, least(1.0, signal / greatest(1.0, nq + n_events / 3.0::DOUBLE)))::DOUBLE AS c FROM signals),
probed AS (SELECT query_id, shard_id, signal > 0 AS knows, floor(c * 100 + 0.5) / 100 AS confidence,
  CASE WHEN signal = 0 THEN 'none' WHEN c >= 0.5 THEN 'direct' WHEN c >= 0.2 THEN 'adjacent' ELSE 'vague' END AS memory_type,
  CASE WHEN signal = 0 THEN 'none' WHEN c >= 0.6 THEN 'high' WHEN c >= 0.3 THEN 'medium' ELSE 'low' END AS answer_value,
  signal > 0 AND c >= 0.25 AS needs_recall, coalesce(relevant, []) AS relevant FROM raw)"""


@query
def probe_mock(spark, sf):
    corpus, questions, entries, _ = _pipeline(spark, sf)
    return router.probes(questions, corpus, entries).withColumn("relevant", F.array_join(F.col("relevant").cast("array<string>"), ","))


SQL["probe_mock"] = f"WITH {_PROBED} SELECT query_id, shard_id, knows, confidence, memory_type, answer_value, needs_recall, array_to_string(relevant, ',') AS relevant FROM probed"


def _targets(spark, sf):
    corpus, questions, entries, routed = _pipeline(spark, sf)
    return corpus, questions, cut(router.recall_targets(router.probes(questions, corpus, entries, routed), routed))


_TARGETS = f"""{_PROBED}, seen AS (SELECT p.*, r.rank AS route, round(confidence * 0.6 + CASE answer_value WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.6 WHEN 'low' THEN 0.3 ELSE 0 END * 0.25
    + CASE memory_type WHEN 'direct' THEN 1.0 WHEN 'adjacent' THEN 0.6 WHEN 'vague' THEN 0.2 ELSE 0 END * 0.15, 6)::DOUBLE AS probe_score
  FROM probed p JOIN routed r ON r.query_id = p.query_id AND r.shard_id = p.shard_id),
chosen AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY probe_score DESC, route) AS place FROM seen WHERE knows AND answer_value <> 'none' AND
  ((needs_recall AND confidence >= 0.45) OR (confidence >= 0.7 AND answer_value IN ('high', 'medium') AND memory_type IN ('direct', 'adjacent', 'conflicting'))) QUALIFY place <= 4),
trusted AS (SELECT *, 0 AS place FROM seen s WHERE route = 1 AND NOT EXISTS (SELECT 1 FROM chosen c WHERE c.query_id = s.query_id AND c.shard_id = s.shard_id)),
targets AS (SELECT * FROM (SELECT * EXCLUDE (place), row_number() OVER (PARTITION BY query_id ORDER BY place) AS place FROM (SELECT * FROM chosen UNION ALL SELECT * FROM trusted)) WHERE place <= 4)"""


@query
def recall_trigger(spark, sf):
    return _targets(spark, sf)[2].select("query_id", "shard_id", "place", "probe_score")


SQL["recall_trigger"] = f"WITH {_TARGETS} SELECT query_id, shard_id, CAST(place AS INTEGER) AS place, probe_score FROM targets"

_RECALLS = f"""{_TARGETS}, picks AS (SELECT t.query_id, t.shard_id, t.place, h.event_id, h.hits + CASE WHEN list_contains(t.relevant, h.event_id) THEN 1 ELSE 0 END AS score,
    row_number() OVER (PARTITION BY t.query_id, t.shard_id ORDER BY h.hits + CASE WHEN list_contains(t.relevant, h.event_id) THEN 1 ELSE 0 END DESC, h.event_id) AS rank
  FROM targets t JOIN hits h ON h.query_id = t.query_id AND h.shard_id = t.shard_id QUALIFY rank <= 3),
recalls AS (SELECT query_id, p.shard_id, place, count(*) AS n_claims, least(0.95, 0.4 + count(*) * 0.15)::DOUBLE AS confidence,
  'Based on ' || count(*) || ' relevant event(s) in ' || p.shard_id || '@S001: ' || arg_min(CASE WHEN length(content) > 320 THEN content[1:319] || '…' ELSE content END, rank) AS answer,
  string_agg(p.shard_id || '@S001:' || p.event_id, ';' ORDER BY rank) AS sources, round(max(least(0.95, 0.5 + score * 0.1)), 6)::DOUBLE AS best
  FROM picks p JOIN corpus c ON c.event_id = p.event_id GROUP BY query_id, p.shard_id, place)"""


@query
def recall_mock(spark, sf):
    corpus, questions, targets = _targets(spark, sf)
    r = router.recalls(questions, corpus, targets)
    return r.select("query_id", "shard_id", "place", F.size("claims").cast("long").alias("n_claims"), F.round("confidence", 6).alias("confidence"), F.md5("answer").alias("answer"), F.array_join(F.flatten("claims.support"), ";").alias("sources"), F.round(F.array_max("claims.confidence"), 6).alias("best"))


SQL["recall_mock"] = f"WITH {_RECALLS} SELECT query_id, shard_id, CAST(place AS INTEGER) AS place, n_claims, round(confidence, 6) AS confidence, md5(answer) AS answer, sources, best FROM recalls"


@query
def recall_digest(spark, sf):
    corpus, _, targets = _targets(spark, sf)
    return router.recall_digest(corpus, targets).select("query_id", "shard_id", "n_kept", "n_events", F.md5("digest").alias("digest"))


SQL["recall_digest"] = f"""WITH {_TARGETS}, lines AS (SELECT t.query_id, t.shard_id, c.event_id, NOT list_contains(t.relevant, c.event_id) AS late,
    '- [' || c.event_id || '] (user) ' || CASE WHEN length(content) > 480 THEN content[1:479] || '…' ELSE content END || '  tags=[' || array_to_string(c.tags, ',') || ']' AS line FROM targets t JOIN corpus c ON c.shard_id = t.shard_id),
  cum AS (SELECT *, sum(CAST(ceil(length(line) / 4.0) AS BIGINT)) OVER w AS used, row_number() OVER w AS n, count(*) OVER (PARTITION BY query_id, shard_id) AS n_all FROM lines
    WINDOW w AS (PARTITION BY query_id, shard_id ORDER BY late, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  kept AS (SELECT query_id, shard_id, count_if(used <= 1200)::BIGINT AS n_kept, max(n_all) AS n_events, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE used <= 1200), '') AS body FROM cum GROUP BY ALL)
  SELECT query_id, shard_id, n_kept, n_events, md5(body || CASE WHEN n_events > n_kept THEN CASE WHEN n_kept > 0 THEN chr(10) ELSE '' END || '- (… ' || (n_events - n_kept) || ' more events truncated to fit budget)' ELSE '' END) AS digest FROM kept"""


@query
def probe_index(spark, sf):
    corpus, questions, _, routed = _pipeline(spark, sf)
    return router.probe_index(questions, corpus, routed).select("query_id", "shard_id", "n_kept", "n_events", F.md5("digest").alias("digest"))


SQL["probe_index"] = f"""WITH {_ROUTED}, rows AS (SELECT r.query_id, r.shard_id, c.event_id, terms, c.tags, content FROM routed r JOIN asked USING (query_id) JOIN corpus c ON c.shard_id = r.shard_id),
  lines AS (SELECT query_id, shard_id, event_id, '- [' || event_id || '] tags=[' || array_to_string(tags, ',') || '] "' || regexp_replace(content, '\\s+', ' ', 'g')[1:80] || CASE WHEN length(content) > 80 THEN '…' ELSE '' END || '"' AS line,
    2 * len(list_filter(tags, lambda g: len(list_filter(terms, lambda t: t = lower(g) OR (length(t) >= 4 AND (starts_with(t, lower(g)) OR starts_with(lower(g), t))))) > 0))
      + len(list_filter(terms, lambda t: contains(lower(content[1:200]), t))) AS score FROM rows),
  cum AS (SELECT *, sum(length(line)) OVER w AS used, row_number() OVER w AS n, count(*) OVER (PARTITION BY query_id, shard_id) AS n_all FROM lines
    WINDOW w AS (PARTITION BY query_id, shard_id ORDER BY score DESC, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW)),
  kept AS (SELECT query_id, shard_id, count_if(used <= 1200)::BIGINT AS n_kept, max(n_all) AS n_events, coalesce(string_agg(line, chr(10) ORDER BY n) FILTER (WHERE used <= 1200), '') AS body FROM cum GROUP BY ALL)
  SELECT query_id, shard_id, n_kept, n_events, md5(body || CASE WHEN n_events > n_kept THEN CASE WHEN n_kept > 0 THEN chr(10) ELSE '' END || '- (… ' || (n_events - n_kept) || ' more events truncated)' ELSE '' END) AS digest FROM kept"""


@query
def packet_single(spark, sf):
    """Packets of the questions that no shard or one answers, taking each question's first target."""
    corpus, questions, targets = _targets(spark, sf)
    return router.packets(questions, router.recalls(questions, corpus, targets.where("place = 1"))).select("query_id", F.md5("summary").alias("summary"), "sources", "caveats", F.md5("context").alias("context"))


SQL["packet_single"] = f"""WITH {_RECALLS}, one AS (SELECT * FROM recalls WHERE place = 1) SELECT q.query_id, md5(coalesce(answer, 'No relevant memory found in any consulted shard.')) AS summary, coalesce(sources, '') AS sources,
  CASE WHEN answer IS NULL THEN 'Searched shards yielded no recall.' ELSE '' END AS caveats, md5(coalesce(shard_id || '@S001: ' || answer, 'No memory packet available; answer from general knowledge.')) AS context
  FROM questions q LEFT JOIN one USING (query_id)"""


@query
def synth_merge(spark, sf):
    corpus, questions, targets = _targets(spark, sf)
    return folds.synthesize(router.recalls(questions, corpus, targets))


@query
def ask_pipeline(spark, sf):
    """Every question through routing, probing, recall and packets."""
    from ..plans.ask import ask

    return ask(views.questions(spark, sf), views.corpus(spark, sf), _ref(), views.events(spark, sf))


@query
def ask_stages(spark, sf):
    """Every question through the stages with a model each, the deterministic ones, and what its calls cost by stage."""
    from ..plans.ask_models import ask_models

    packets, calls = ask_models(views.questions(spark, sf), views.corpus(spark, sf), _ref(), events=views.events(spark, sf))
    said = packets.select("query_id", "n_routed", "n_recalls", "n_failed", F.md5("summary").alias("summary"), F.size("key_claims").alias("n_claims"), F.md5("context").alias("context"))
    return said.join(costs.by_stage(calls), "query_id", "left")


def _log(spark, sf):
    """Commit decisions from the event log: some lack a target, some aim at shards that aren't there or aren't open."""
    e = views.table(spark, sf, "events")
    action = F.element_at(F.array(*map(F.lit, commit.ACTIONS)), (F.col("event_id") % 7 + 1).cast("int"))
    return e.select(
        F.col("event_id").alias("decision_id"), action.alias("action"), F.when(F.col("event_id") % 13 != 0, F.concat(F.lit("u"), (F.col("user_id") + F.when(F.col("event_id") % 17 == 0, 1000).otherwise(0)).cast("string"))).alias("target"),
        F.concat("event_type", F.lit(": "), F.coalesce("props", F.lit(""))).alias("content"), F.array("event_type").alias("tags"), F.expr("timestampdiff(MICROSECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', ts)").alias("ordinal"),
    )


def _manifests(spark, sf):
    users = views.table(spark, sf, "events").select("user_id").distinct()
    return users.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("shard_id"), F.when(F.col("user_id") % 10 == 3, "frozen").otherwise("active").alias("status"), (F.col("user_id") % 5).alias("n_events"), (F.col("user_id") * 10).alias("tokens"))


_LOG = f"""log AS (SELECT event_id AS decision_id, {list(commit.ACTIONS)!r}[CAST(event_id % 7 + 1 AS INTEGER)] AS action,
  CASE WHEN event_id % 13 <> 0 THEN 'u' || (user_id + CASE WHEN event_id % 17 = 0 THEN 1000 ELSE 0 END) END AS target, event_type || ': ' || coalesce(props, '') AS content, event_type, epoch_us(ts) AS ordinal FROM events),
manifests AS (SELECT DISTINCT 'u' || user_id AS shard_id, CASE WHEN user_id % 10 = 3 THEN 'frozen' ELSE 'active' END AS status, user_id % 5 AS n_events, user_id * 10 AS tokens FROM events)"""


@query
def commit_dryrun(spark, sf):
    return commit.dry_run(_log(spark, sf), _manifests(spark, sf))


SQL["commit_dryrun"] = f"""WITH {_LOG}, k AS (SELECT l.*, m.shard_id IS NOT NULL AS known FROM log l LEFT JOIN manifests m ON m.shard_id = l.target)
SELECT decision_id, action, target, action NOT IN ('no_op', 'ask_confirmation') AND target IS NOT NULL AND known AS would_mutate,
  CASE WHEN action IN ('no_op', 'ask_confirmation') THEN 'No durable change for action=' || action || '.' WHEN target IS NULL THEN 'Action ' || action || ' requires target_shard_id.'
    WHEN NOT known THEN 'Target shard ' || target || ' not found; would be a no-op.'
    WHEN action IN ('write', 'update') THEN 'Would append commit_note event to ' || target || ', creating new snapshot. content="' || CASE WHEN length(content) > 80 THEN content[1:79] || '…' ELSE content END || '"'
    WHEN action = 'freeze' THEN 'Would freeze shard ' || target || ' (status:active→frozen).' ELSE 'Action ' || action || ' not implemented in MVP. Would be a no-op.' END AS description,
  CASE WHEN action IN ('no_op', 'ask_confirmation') OR target IS NULL OR NOT known THEN 'none' WHEN action = 'write' THEN 'commit_write' WHEN action = 'update' THEN 'commit_update' WHEN action = 'freeze' THEN 'shard_frozen' ELSE 'none' END AS chronicle_type FROM k"""


@query
def commit_apply_batch(spark, sf):
    return commit.apply(_log(spark, sf), _manifests(spark, sf))


_APPLIED = f"""{_LOG}, applied AS (SELECT decision_id, target AS shard_id, action, n_events, row_number() OVER w AS place,
  CAST(tokens + sum(CAST(ceil(length(content) / 4.0) AS BIGINT) + 3 + 8 + CAST(ceil(length(event_type) / 4.0) AS BIGINT)) OVER w AS BIGINT) AS tokens
  FROM log JOIN manifests ON shard_id = target WHERE action IN ('write', 'update') AND status = 'active' WINDOW w AS (PARTITION BY target ORDER BY ordinal, decision_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))"""
SQL["commit_apply_batch"] = f"""WITH {_APPLIED} SELECT decision_id, shard_id, printf('e_%04d', n_events + place) AS event_id, printf('S%03d', place + 1) AS snapshot_id, printf('S%03d', place) AS parent_id, tokens,
  round(least(100.0::DOUBLE, tokens / 128000.0::DOUBLE * 100), 9) AS fullness_pct, CASE WHEN action = 'write' THEN 'commit_write' ELSE 'commit_update' END AS chronicle_type FROM applied"""


@query
def commit_rejected(spark, sf):
    return commit.rejected(_log(spark, sf), _manifests(spark, sf))


SQL["commit_rejected"] = f"WITH {_LOG} SELECT decision_id, target, status FROM log JOIN manifests ON shard_id = target WHERE action IN ('write', 'update') AND status <> 'active'"


@query
def directory_upsert(spark, sf):
    entries = _manifests(spark, sf).select(F.col("shard_id").alias("id"), "status")
    return commit.freeze(entries, _log(spark, sf))


SQL["directory_upsert"] = f"WITH {_LOG} SELECT shard_id AS id, CASE WHEN shard_id IN (SELECT target FROM log WHERE action = 'freeze' AND target IS NOT NULL) THEN 'frozen' ELSE status END AS status FROM manifests"


@query
def snapshot_chain(spark, sf):
    """Per shard the chain of snapshots: the last one, and each parent found."""
    a = commit.apply(_log(spark, sf), _manifests(spark, sf))
    w = Window.partitionBy("shard_id").orderBy(F.length("snapshot_id"), "snapshot_id")
    linked = a.withColumn("before", F.lag("snapshot_id").over(w))
    return linked.groupBy("shard_id").agg(F.count("*").alias("n"), F.max_by("snapshot_id", F.struct(F.length("snapshot_id"), "snapshot_id")).alias("latest"), F.count_if(F.coalesce("before", F.lit("S001")) != F.col("parent_id")).alias("broken"))


SQL["snapshot_chain"] = f"WITH {_APPLIED} SELECT shard_id, count(*) AS n, printf('S%03d', max(place) + 1) AS latest, CAST(0 AS BIGINT) AS broken FROM applied GROUP BY shard_id"


@query
def chronicle_tail(spark, sf):
    """The last 20 entries of the audit log, the oldest of them first."""
    log = _log(spark, sf).select("decision_id", "action", "target", "ordinal")
    w = Window.orderBy("ordinal", "decision_id")
    return log.orderBy(F.desc("ordinal"), F.desc("decision_id")).limit(20).withColumn("place", F.row_number().over(w))


SQL["chronicle_tail"] = f"WITH {_LOG}, t AS (SELECT decision_id, action, target, ordinal FROM log ORDER BY ordinal DESC, decision_id DESC LIMIT 20) SELECT *, CAST(row_number() OVER (ORDER BY ordinal, decision_id) AS INTEGER) AS place FROM t"


@query
def router_recall_at_3(spark, sf):
    """How often the shard of a question's gold document is among the router's first three."""
    gold = _gold(spark, sf).groupBy("query_id").agg(F.collect_set("shard_id").alias("gold"))
    top = _pipeline(spark, sf)[3].where("rank <= 3").groupBy("query_id").agg(F.collect_set("shard_id").alias("top"))
    return gold.join(top, "query_id").agg(F.count("*").alias("cases"), F.round(F.coalesce(F.avg(F.arrays_overlap("gold", "top").cast("double")), F.lit(0.0)), 6).alias("recall_at_3"))


def _gold(spark, sf):
    return retrieval.holding(views.events(spark, sf), views.questions(spark, sf).withColumnRenamed("question", "passage"))


_GOLD = "gold AS (SELECT item_id AS query_id, doc_id AS event_id, source AS shard_id FROM benchmark b JOIN documents d ON contains(d.text, b.text))"
SQL["router_recall_at_3"] = f"""WITH {_ROUTED}, {_GOLD}, g AS (SELECT query_id, max(CASE WHEN shard_id IN (SELECT shard_id FROM routed r WHERE r.query_id = gold.query_id AND rank <= 3) THEN 1.0 ELSE 0.0 END) AS hit FROM gold GROUP BY query_id)
SELECT count(*) AS cases, round(coalesce(avg(hit), 0), 6)::DOUBLE AS recall_at_3 FROM g"""


@query
def citation_prf(spark, sf):
    """Cited: the ten fused hits of a question. Relevant: the documents that hold its item."""
    from .retrieval import _fused

    cited = _fused(spark, sf).select("query_id", "event_id", F.lit(1).alias("c"), F.lit(0).alias("r"))
    relevant = _gold(spark, sf).where("event_id IS NOT NULL").select("query_id", "event_id", F.lit(0).alias("c"), F.lit(1).alias("r"))
    pairs = cited.unionByName(relevant).groupBy("query_id", "event_id").agg(F.max("c").alias("c"), F.max("r").alias("r"))
    counts = pairs.groupBy("query_id").agg(F.sum("c").alias("c"), F.sum("r").alias("r"), F.sum(F.col("c") * F.col("r")).alias("both"))
    rows = views.questions(spark, sf).select("query_id").join(counts, "query_id", "left").fillna(0, ["c", "r", "both"])
    s = maths.citation_rates(F.col("c"), F.col("r"), F.col("both"))
    return rows.select("query_id", s.alias("s")).select("query_id", *[F.round(f"s.{c}", 6).alias(c) for c in ("precision", "recall", "f1")])


SQL["citation_prf"] = f"""WITH {sql.BM25}, {sql.knn("q.vec_id IN (SELECT item_id FROM benchmark)")}, {sql.FUSED}, {_GOLD},
  c AS (SELECT query_id, count(*) AS n FROM fused GROUP BY ALL), r AS (SELECT query_id, count(DISTINCT event_id) AS n FROM gold GROUP BY ALL), h AS (SELECT query_id, count(DISTINCT event_id) AS n FROM fused SEMI JOIN gold USING (query_id, event_id) GROUP BY ALL),
  v AS (SELECT q.query_id, coalesce(c.n, 0) AS c, coalesce(r.n, 0) AS r, coalesce(h.n, 0)::DOUBLE AS h FROM questions q LEFT JOIN c USING (query_id) LEFT JOIN r USING (query_id) LEFT JOIN h USING (query_id)),
  pr AS (SELECT query_id, CASE WHEN c = 0 AND r = 0 THEN 1.0::DOUBLE WHEN c = 0 OR r = 0 THEN 0.0::DOUBLE ELSE h / c END AS p, CASE WHEN r = 0 THEN 1.0::DOUBLE WHEN c = 0 THEN 0.0::DOUBLE ELSE h / r END AS q FROM v)
  SELECT query_id, round(p, 6) AS precision, round(q, 6) AS recall, round(CASE WHEN p + q = 0 THEN 0.0::DOUBLE ELSE 2 * p * q / (p + q) END, 6) AS f1 FROM pr"""
