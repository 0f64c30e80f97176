"""Queries over text functions: scans, tokens, parsers, excerpts, dates."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import dates, text
from ..operators import answers, folds
from ..sources import views
from . import sql

QUERIES, SQL = {}, {}


def query(f):
    QUERIES[f.__name__] = f
    return f


@query
def corpus_projection(spark, sf):
    c = views.corpus(spark, sf)
    return c.select("event_id", "shard_id", "token_count", "is_core", "tier", F.array_join("tags", ",").alias("tags"))


SQL["corpus_projection"] = f"WITH {sql.CORPUS} SELECT event_id, shard_id, token_count, is_core, tier, array_to_string(tags, ',') AS tags FROM corpus"


@query
def scope_filter(spark, sf):
    return views.table(spark, sf, "events").where("user_id = 7").select("event_id", "event_type", "value")


SQL["scope_filter"] = "SELECT event_id, event_type, value FROM events WHERE user_id = 7"


@query
def corpus_quality_rules(spark, sf):
    c = views.corpus(spark, sf)
    rules = {"no_content": F.length("content") == 0, "bad_tier": ~F.col("tier").between(0, 4), "core_tier": F.col("is_core") & (F.col("tier") != 0), "no_shard": F.col("shard_id").isNull(), "long": F.col("token_count") > 4000}
    return c.agg(F.count("*").alias("n"), F.countDistinct("event_id").alias("n_ids"), *[F.count_if(t).alias(n) for n, t in rules.items()])


SQL["corpus_quality_rules"] = f"""WITH {sql.CORPUS} SELECT count(*) AS n, count(DISTINCT event_id) AS n_ids, count_if(length(content) = 0)::BIGINT AS no_content,
  count_if(tier NOT BETWEEN 0 AND 4)::BIGINT AS bad_tier, count_if(is_core AND tier <> 0)::BIGINT AS core_tier, count_if(shard_id IS NULL)::BIGINT AS no_shard, count_if(token_count > 4000)::BIGINT AS long FROM corpus"""


@query
def leak_scan(spark, sf):
    """Texts that hold a banned term, with 30 characters either side of its first place."""
    banned = ["token = ", "password="]
    docs = views.table(spark, sf, "documents")
    rows = docs.select("doc_id", "text", F.explode(F.array(*map(F.lit, banned))).alias("term")).where(F.contains("text", F.col("term")))
    at = F.instr("text", F.col("term"))
    return rows.select("doc_id", "term", F.substring("text", F.greatest(F.lit(1), at - 30), F.least(F.lit(30), at - 1) + F.length("term") + 30).alias("excerpt"))


SQL["leak_scan"] = """SELECT doc_id, term, substr(text, greatest(1, p - 30), least(30, p - 1) + length(term) + 30) AS excerpt
FROM (SELECT doc_id, text, term, instr(text, term) AS p FROM documents, (SELECT unnest(['token = ', 'password=']) AS term)) WHERE p > 0"""


@query
def page_html_strip(spark, sf):
    pages = views.table(spark, sf, "pages")
    clean = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("html", r"(?is)<(script|style)[^>]*>.*?</(script|style)>", " "), "<[^>]+>", " "), "[ \t\r\n]+", " "))
    return pages.select("page_id", F.regexp_extract("url", "^[a-z]+://([^/]+)", 1).alias("host"), F.length(clean).cast("long").alias("n_chars"), F.md5(clean).alias("md5"))


SQL["page_html_strip"] = r"""SELECT page_id, regexp_extract(url, '^[a-z]+://([^/]+)', 1) AS host, length(t) AS n_chars, md5(t) AS md5 FROM (
  SELECT page_id, url, trim(regexp_replace(regexp_replace(regexp_replace(html, '(?is)<(script|style)[^>]*>.*?</(script|style)>', ' ', 'g'), '<[^>]+>', ' ', 'g'), '[ \t\r\n]+', ' ', 'g')) AS t FROM pages)"""


@query
def tokenize_router(spark, sf):
    t = text.tokenize_router(F.col("text"))
    return views.table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


SQL["tokenize_router"] = f"SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, {sql.router('text')} AS t FROM documents)"


@query
def tokenize_bm25(spark, sf):
    t = text.tokenize_bm25(F.col("text"))
    return views.table(spark, sf, "documents").select("doc_id", F.size(t).cast("long").alias("n"), F.md5(F.array_join(t, " ")).alias("tokens"))


SQL["tokenize_bm25"] = "SELECT doc_id, len(t) AS n, md5(array_to_string(t, ' ')) AS tokens FROM (SELECT doc_id, list_filter(regexp_split_to_array(lower(text), '[^a-z0-9]+'), lambda t: length(t) >= 2) AS t FROM documents)"


@query
def bridge_terms(spark, sf):
    return views.table(spark, sf, "documents").select("doc_id", F.array_join(text.bridge_terms(F.col("text")), ",").alias("terms"))


SQL["bridge_terms"] = f"SELECT doc_id, array_to_string({sql.bridge_terms('text')}, ',') AS terms FROM documents"


@query
def content_terms(spark, sf):
    return views.table(spark, sf, "conversations").select("conv_id", "turn", F.array_join(text.content_terms(F.col("text")), ",").alias("terms"))


SQL["content_terms"] = f"SELECT conv_id, turn, array_to_string({sql.content_terms('text')}, ',') AS terms FROM conversations"


@query
def coverage_terms(spark, sf):
    """Triggers and what they add, from words put before each turn."""
    trigger = F.element_at(F.array(*map(F.lit, ["security", "database", "weather", "performance", "other"])), (F.col("turn") % 5 + 1).cast("int"))
    t = text.expand_terms(F.concat(F.array(trigger), text.content_terms(F.col("text"))))
    return views.table(spark, sf, "conversations").select("conv_id", "turn", F.size(t).cast("long").alias("n"), F.array_join(t, ",").alias("terms"))


SQL["coverage_terms"] = f"""SELECT conv_id, turn, len(t) AS n, array_to_string(t, ',') AS terms FROM (SELECT conv_id, turn,
  {sql.expand("list_concat([['security', 'database', 'weather', 'performance', 'other'][CAST(turn % 5 + 1 AS INTEGER)]], " + sql.content_terms("text") + ")")} AS t FROM conversations)"""

_OUTPUT = "concat('Reasoning 12 about option ', o_orderkey % 9, '. ANSWER: ', o_custkey % 7, ' then', chr(10), CASE WHEN o_orderkey % 3 = 0 THEN concat('ANSWER = ', o_custkey % 5, chr(10)) ELSE '' END, 'CITATIONS: [e', o_orderkey, '], (e', o_custkey, '); **none**, `e7`.')"


def _outputs(spark, sf):
    """Model outputs made of orders, with repeated answers and wrapped citations."""
    out = _OUTPUT.replace("chr(10)", "'\\n'")
    return views.table(spark, sf, "orders").selectExpr("o_orderkey", f"CASE WHEN o_orderkey % 11 = 0 THEN concat('I pick choice ', o_custkey % 6, ' of 4') ELSE {out} END AS output")


_OUTPUTS = f"outputs AS (SELECT o_orderkey, CASE WHEN o_orderkey % 11 = 0 THEN concat('I pick choice ', o_custkey % 6, ' of 4') ELSE {_OUTPUT} END AS output FROM orders)"
_CITED = r"list_filter(list_transform(regexp_split_to_array({x}, '[,;]'), lambda s: regexp_replace(s, '^[\s\[\](){{}}`''\"*.!?:]+|[\s\[\](){{}}`''\"*.!?:]+$', '', 'g')), lambda s: length(s) > 0 AND lower(s) <> 'none')"


@query
def mcq_parse(spark, sf):
    p = answers.parse_choice(F.col("output"), F.lit(5))
    return _outputs(spark, sf).select("o_orderkey", p["chosen"].alias("chosen"), F.array_join(p["cited"], ",").alias("cited"))


SQL["mcq_parse"] = rf"""WITH {_OUTPUTS}, parts AS (SELECT o_orderkey,
  regexp_extract_all(output, '(?i)ANSWER\s*[:=]\s*(\d+)', 1) AS a, regexp_extract_all(output, '(?i)\b(?:option|choice|answer)\s+(\d+)\b', 1) AS o,
  list_filter(list_transform(regexp_extract_all(output, '\b\d+\b'), lambda s: TRY_CAST(s AS INTEGER)), lambda n: n BETWEEN 1 AND 5) AS n,
  regexp_extract_all(output, '(?i)CITATIONS\s*[:=]\s*([^\n\r]+)', 1) AS c FROM outputs)
SELECT o_orderkey, CASE WHEN len(a) > 0 THEN CASE WHEN CAST(a[-1] AS INTEGER) BETWEEN 1 AND 5 THEN CAST(a[-1] AS INTEGER) END
  ELSE coalesce(CASE WHEN TRY_CAST(o[-1] AS INTEGER) BETWEEN 1 AND 5 THEN TRY_CAST(o[-1] AS INTEGER) END, n[1]) END AS chosen,
  coalesce(array_to_string({_CITED.format(x='c[-1]')}, ','), '') AS cited FROM parts"""


@query
def freeform_parse(spark, sf):
    p = answers.parse_free(F.col("output"))
    return _outputs(spark, sf).select("o_orderkey", p["chosen"].alias("chosen"), F.array_join(p["cited"], ",").alias("cited"))


SQL["freeform_parse"] = rf"""WITH {_OUTPUTS}, parts AS (SELECT o_orderkey, regexp_extract_all(output, '(?i)ANSWER\s*[:=]\s*([^\n\r]+)', 1) AS a,
  list_filter(list_transform(string_split(output, chr(10)), lambda s: trim(s)), lambda s: length(s) > 0 AND NOT regexp_matches(s, '(?i)^citations\s*[:=]')) AS l,
  regexp_extract_all(output, '(?i)CITATIONS\s*[:=]\s*([^\n\r]+)', 1) AS c FROM outputs)
SELECT o_orderkey, CASE WHEN len(a) > 0 THEN nullif(trim(a[1]), '') ELSE l[1] END AS chosen, coalesce(array_to_string({_CITED.format(x='c[1]')}, ','), '') AS cited FROM parts"""


@query
def citation_parse(spark, sf):
    raw = F.concat(F.lit("[e"), F.col("doc_id").cast("string"), F.lit("], ("), F.col("source"), F.lit("); **"), F.coalesce("lang", F.lit("none")), F.lit("**, none. ; `x-"), (F.col("doc_id") % 7).cast("string"), F.lit("`!")) 
    return views.table(spark, sf, "documents").select("doc_id", F.array_join(answers.citations(raw), ",").alias("ids"))


SQL["citation_parse"] = rf"""SELECT doc_id, array_to_string({_CITED.format(x="concat('[e', doc_id, '], (', source, '); **', coalesce(lang, 'none'), '**, none. ; `x-', doc_id % 7, '`!')")}, ',') AS ids FROM documents"""


@query
def normalise_answer(spark, sf):
    raw = F.concat(F.lit("  The  "), F.col("p_name"), F.lit(" "), F.col("p_type"), F.lit(".!  "))
    return views.table(spark, sf, "part").select("p_partkey", answers.normalise(raw).alias("answer"))


SQL["normalise_answer"] = r"""SELECT p_partkey, regexp_replace(regexp_replace(regexp_replace(lower(trim(concat('  The  ', p_name, ' ', p_type, '.!  '))), '[.!?,;:]+$', ''), '^the\s+', ''), '\s+', ' ', 'g') AS answer FROM part"""


@query
def intent_flags(spark, sf):
    words = ["Summarize our discussion of ", "How many days between ", "Did I ever ask before about ", "How many different ", "Why did we choose ", "Tell "]
    lead = F.element_at(F.array(*map(F.lit, words)), (F.col("query_id") % 6 + 1).cast("int"))
    return views.questions(spark, sf).select("query_id", text.intent(F.concat(lead, "question")).alias("i")).select("query_id", "i.*")


SQL["intent_flags"] = rf"""WITH {sql.QUESTIONS}, q AS (SELECT query_id, lower(['Summarize our discussion of ', 'How many days between ', 'Did I ever ask before about ', 'How many different ', 'Why did we choose ', 'Tell '][CAST(query_id % 6 + 1 AS INTEGER)] || question) AS q FROM questions)
SELECT query_id, regexp_matches(q, '\b(summary|summarize|recap|overview|comprehensive|across (our|my|the) (discussion|discussions|conversation|conversations|history))\b') AS broad_summary,
  regexp_matches(q, '\b(how many (days|weeks|months|years)|duration|between when|between .* and|before|after|earlier|later|when did|timeline|chronological|order)\b') AS temporal,
  regexp_matches(q, '\b(contradict|contradictory|conflict|inconsistent|which statement is correct|have i .* before|did i .* before)\b') AS contradiction,
  regexp_matches(q, '\b(how many|number of|count|different|distinct)\b') AS count_like, regexp_matches(q, '\b(i|my|me|mine)\b') AS user_centric,
  regexp_matches(q, '\b(rationale|reason behind|why did|why was|why choose|why choosing|choosing)\b') AS abstention_risk FROM q"""


@query
def turn_parse(spark, sf):
    t = views.turns(spark, sf)
    return t.select("event_id", text.event_role(F.col("content")).alias("speaker"), text.turn_label(F.col("content")).alias("label"), text.turn_number(F.col("content"), F.col("event_id")).alias("number"))


SQL["turn_parse"] = rf"""WITH {sql.TURNS} SELECT event_id,
  coalesce(nullif(lower(regexp_extract(content, '(?i)(?:^|\n)\s*(?:\[[^\]\n]*?\s*\|\s*)?\[?Turn\s+\d+\]?\s+(User|Assistant):', 1)), ''), 'memory') AS speaker,
  nullif(regexp_extract(content, '(?:^|\n)\s*((?:\[[^\]\n]*?\s*\|\s*)?\[?[Tt]urn\s+\d+\]?)', 1), '') AS label,
  coalesce(CAST(nullif(regexp_extract(content, '(?i)\bTurn\s+(\d+)\b', 1), '') AS BIGINT), CAST(nullif(regexp_extract(event_id, '#turn-(\d+)$', 1), '') AS BIGINT), 9007199254740991) AS number FROM turns"""


@query
def date_extract(spark, sf):
    """Dates by name and ISO, days beyond a month's end among them."""
    named = F.concat(F.element_at(F.array(*map(F.lit, ["January", "Feb", "March", "Sep"])), (F.col("turn") % 4 + 1).cast("int")), F.lit(" "), (F.col("shard_id") % 31 + 1).cast("string"), F.lit(", 2023 and "))
    rows = views.turns(spark, sf).select("event_id", F.posexplode(dates.date_phrases(F.concat(named, "content"))).alias("place", "phrase"))
    return rows.select("event_id", F.col("place").cast("int").alias("place"), "phrase", dates.parse_date(F.col("phrase")).alias("day"))


SQL["date_extract"] = f"""WITH {sql.TURNS}, t AS (SELECT event_id, concat(['January', 'Feb', 'March', 'Sep'][CAST(turn % 4 + 1 AS INTEGER)], ' ', shard_id % 31 + 1, ', 2023 and ', content) AS c FROM turns),
p AS (SELECT event_id, {sql.dates('c')} AS d FROM t), e AS (SELECT event_id, unnest(d) AS phrase, CAST(generate_subscripts(d, 1) - 1 AS INTEGER) AS place FROM p)
SELECT event_id, place, phrase, CASE WHEN regexp_matches(phrase, '^\\d{{4}}-') THEN CAST(phrase AS DATE) ELSE
  CAST(make_date(CAST(regexp_extract(phrase, '(\\d{{4}})$', 1) AS BIGINT), (instr('janfebmaraprmayjunjulaugsepoctnovdec', lower(phrase[1:3])) + 2) // 3, 1) + CAST(regexp_extract(phrase, ' (\\d{{1,2}}),', 1) AS INTEGER) - 1 AS DATE) END AS day FROM e"""


@query
def excerpt(spark, sf):
    """360 characters about the strongest of each document's own last terms."""
    docs = views.table(spark, sf, "documents").where("length(text) > 0")
    own = F.reverse(text.bridge_terms(F.substring("text", -200, 200)))
    return docs.select("doc_id", F.md5(text.excerpt(F.col("text"), own, 360)).alias("excerpt"))


SQL["excerpt"] = f"""WITH own AS (SELECT doc_id, text, list_reverse({sql.bridge_terms('right(text, 200)')}) AS terms FROM documents WHERE length(text) > 0)
SELECT doc_id, md5({sql.excerpt('text', 'terms', 360)}) AS excerpt FROM own"""


@query
def slugify(spark, sf):
    return views.table(spark, sf, "pages").select("page_id", text.slugify(F.col("url")).alias("slug"))


SQL["slugify"] = "SELECT page_id, substr(regexp_replace(regexp_replace(lower(url), '[^a-z0-9]+', '-', 'g'), '^-+|-+$', '', 'g'), 1, 60) AS slug FROM pages"


@query
def human_size(spark, sf):
    raw = F.concat((F.col("p_size") / 2).cast("string"), F.element_at(F.array(*map(F.lit, ["K", " m", "B", "", "x"])), (F.col("p_partkey") % 5 + 1).cast("int")))
    from ..functions.maths import format_tokens

    return views.table(spark, sf, "part").select("p_partkey", text.human_size(raw).alias("size"), format_tokens(F.col("p_partkey") * 1000 + 400).alias("shown"))


SQL["human_size"] = r"""SELECT p_partkey, CAST(floor(TRY_CAST(regexp_extract(r, '^([0-9.]+)\s*([KkMmBbGg]?)$', 1) AS DOUBLE) * CASE lower(regexp_extract(r, '^([0-9.]+)\s*([KkMmBbGg]?)$', 2)) WHEN 'k' THEN 1e3 WHEN 'm' THEN 1e6 WHEN 'b' THEN 1e9 WHEN 'g' THEN 1e9 ELSE 1 END + 0.5) AS BIGINT) AS size,
  CASE WHEN n >= 1e9 THEN printf('%.0fB', n / 1e9) WHEN n >= 1e6 THEN printf('%.0fM', n / 1e6) WHEN n >= 1e3 THEN printf('%.0fK', n / 1e3) ELSE CAST(n AS VARCHAR) END AS shown
FROM (SELECT p_partkey, (p_size / 2) || ['K', ' m', 'B', '', 'x'][CAST(p_partkey % 5 + 1 AS INTEGER)] AS r, p_partkey * 1000 + 400 AS n FROM part)"""


@query
def cache_keys(spark, sf):
    """Keys of cached answers: a hash of the request with sorted fields; answers under 5 characters aren't kept."""
    rows = views.table(spark, sf, "conversations").where("length(trim(text)) >= 5")
    request = F.to_json(F.struct(F.lit("m").alias("model"), F.col("text").alias("prompt"), F.lit(0).alias("temperature")))
    return rows.groupBy(F.sha2(F.concat(F.lit("m|"), "text"), 256).alias("key")).agg(F.count("*").alias("hits"), F.countDistinct(F.sha2(request, 256)).alias("requests"))


SQL["cache_keys"] = "SELECT sha256('m|' || text) AS key, count(*) AS hits, CAST(1 AS BIGINT) AS requests FROM conversations WHERE length(trim(text)) >= 5 GROUP BY text"


@query
def sentence_split(spark, sf):
    s = text.split_sentences(F.col("text"))
    return views.table(spark, sf, "documents").select("doc_id", F.posexplode(s).alias("place", "sentence")).groupBy("doc_id").agg(F.count("*").alias("n"), F.max(F.length("sentence")).cast("long").alias("longest"))


SQL["sentence_split"] = r"""WITH s AS (SELECT doc_id, unnest(string_split(regexp_replace(text, '([.!?])[ \t\n\r\f\v]+([A-Z])', '\1' || chr(1) || '\2', 'g'), chr(1))) AS x FROM documents),
  t AS (SELECT doc_id, regexp_replace(x, '^[ \t\n\r\f\v]+|[ \t\n\r\f\v]+$', '', 'g') AS x FROM s) SELECT doc_id, count(*) AS n, max(length(x)) AS longest FROM t WHERE length(x) > 0 GROUP BY doc_id"""


@query
def transcript_split(spark, sf):
    """Conversations as one transcript each, split into turns again."""
    t = views.turns(spark, sf)
    whole = t.groupBy("shard_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "content"))), lambda x: x["content"]), "\n").alias("content"))
    return whole.select("shard_id", F.size(text.split_turns(F.col("content"))).alias("n_turns"))


SQL["transcript_split"] = rf"""WITH {sql.TURNS}, w AS (SELECT shard_id, string_agg(content, chr(10) ORDER BY turn, content) AS c FROM turns GROUP BY shard_id),
  m AS (SELECT shard_id, len(regexp_extract_all(c, '(?:^|\n)\s*(?:\[[^\]\n]*?\s*\|\s*)?\[?Turn\s+\d+\]?\s+(?:User|Assistant):')) AS n FROM w) SELECT shard_id, CAST(CASE WHEN n > 1 THEN n ELSE 0 END AS INTEGER) AS n_turns FROM m"""


@query
def hash_fnv(spark, sf):
    return views.table(spark, sf, "nation").select("n_nationkey", folds.fnv1a_column(F.col("n_name")).alias("hash"))


SQL["hash_fnv"] = """SELECT n_nationkey, list_reduce(list_prepend(CAST(2166136261 AS BIGINT), list_transform(string_split(n_name, ''), lambda c: CAST(ord(c) AS BIGINT))),
  lambda h, c: (xor(h, c) * 16777619) % 4294967296) AS hash FROM nation"""
