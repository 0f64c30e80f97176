"""Queries over result cells: summaries, intervals, tests, sweeps, reports; streams over events."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..config import DEFAULT
from ..functions import maths
from ..operators import costs, evaluate, report
from ..sources import views
from . import sql

QUERIES, SQL = {}, {}
_G = "system, model_context, corpus_size"


def query(f):
    QUERIES[f.__name__] = f
    return f


def _cells(spark, sf):
    return evaluate.current_cells(views.cells(spark, sf))


_F1 = "CASE WHEN citation_precision + citation_recall = 0 THEN 0.0 ELSE 2 * citation_precision * citation_recall / (citation_precision + citation_recall) END"
_MEANS = f"""count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy, round(avg(citation_precision), 6) AS mean_precision, round(avg(citation_recall), 6) AS mean_recall, round(avg({_F1}), 6)::DOUBLE AS mean_f1,
  round(avg(input_tokens), 6) AS mean_input_tokens, round(avg(latency_ms), 6) AS mean_latency_ms, CAST(count(error) AS BIGINT) AS errors"""
_SUMMARY = f"""{sql.CELLS}, stops AS (SELECT system, model_context, min(CASE WHEN a < 0.5 THEN corpus_size END) AS failed_at FROM (SELECT {_G}, avg(CAST(correct AS DOUBLE)) AS a FROM current GROUP BY ALL) GROUP BY ALL),
  summary AS (SELECT s.*, coalesce(s.corpus_size > failed_at, FALSE) AS early_stopped FROM (SELECT {_G}, {_MEANS} FROM current GROUP BY ALL) s JOIN stops USING (system, model_context))"""


@query
def latest_cell_wins(spark, sf):
    return _cells(spark, sf).select(*evaluate.CELL, "line_no", "correct")


SQL["latest_cell_wins"] = f"WITH {sql.CELLS} SELECT system, model_context, corpus_size, trial, query_id, line_no, correct FROM current"


@query
def cell_summary(spark, sf):
    return evaluate.summaries(_cells(spark, sf))


SQL["cell_summary"] = f"WITH {_SUMMARY} SELECT * FROM summary"


@query
def early_stop(spark, sf):
    """Cells that stay when each system stops at the first size it fails."""
    c = _cells(spark, sf)
    kept = evaluate.not_stopped(c, evaluate.early_stops(c))
    return kept.groupBy("system", "model_context", "corpus_size").agg(F.count("*").alias("n"))


SQL["early_stop"] = f"WITH {_SUMMARY} SELECT {_G}, count(*) AS n FROM current JOIN stops USING (system, model_context) WHERE failed_at IS NULL OR corpus_size < failed_at GROUP BY ALL"


@query
def bootstrap_ci(spark, sf):
    """Intervals of each cell's accuracy over its questions and trials, as inside the run loop: few resamples."""
    return evaluate.bootstrap(_cells(spark, sf), evaluate.GROUP, DEFAULT.bootstrap_loop)


SQL["bootstrap_ci"] = f"""WITH {sql.CELLS}, per AS (SELECT {_G}, list(CAST(correct AS INTEGER) ORDER BY query_id, trial) AS ys FROM current GROUP BY {_G}),
  d AS (SELECT {_G}, ys, len(ys) AS n, r, i, (42 + ((r * len(ys) + i) * 1831565813) % 4294967296) % 4294967296 AS a FROM per, (SELECT unnest(range(200)) AS r), LATERAL (SELECT unnest(range(1, len(ys) + 1)) AS i)),
  t1 AS (SELECT *, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % 4294967296 AS BIGINT) AS t FROM d),
  t2 AS (SELECT *, CAST((t + CAST((CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296 AS BIGINT)) % 4294967296 AS BIGINT) AS u FROM t1),
  t3 AS (SELECT *, xor(t, u) AS v FROM t2),
  means AS (SELECT {_G}, n, r, sum(ys[CAST(floor(xor(v, v >> 14) / 4294967296.0::DOUBLE * n) AS INTEGER) + 1]) / n::DOUBLE AS m FROM t3 GROUP BY {_G}, n, r),
  placed AS (SELECT *, row_number() OVER (PARTITION BY {_G} ORDER BY m) - 1 AS k FROM means)
  SELECT {_G}, n, round(max(CASE WHEN k = 5 THEN m END), 6) AS ci_low, round(max(CASE WHEN k = 195 THEN m END), 6) AS ci_high FROM placed GROUP BY {_G}, n"""


@query
def bootstrap_ci_full(spark, sf):
    """The same intervals as the final summary takes them, from all resamples. It has no SQL."""
    return evaluate.bootstrap(_cells(spark, sf), evaluate.GROUP, DEFAULT.bootstrap)


_PAIR = ["model_context", "corpus_size", "trial", "query_id"]


@query
def mcnemar(spark, sf):
    c = _cells(spark, sf)
    rows = [evaluate.mcnemar(c, "memory", b, _PAIR).withColumn("against", F.lit(b)) for b in ("vanilla", "hybrid", "longctx")]
    return rows[0].unionByName(rows[1]).unionByName(rows[2])


SQL["mcnemar"] = f"""WITH {sql.CELLS}, p AS (SELECT b.system AS against, count_if(a.correct AND NOT b.correct)::BIGINT AS a_only, count_if(NOT a.correct AND b.correct)::BIGINT AS b_only, count_if(a.correct AND b.correct)::BIGINT AS both_right, count_if(NOT a.correct AND NOT b.correct)::BIGINT AS neither
    FROM (SELECT * FROM current WHERE system = 'memory') a JOIN (SELECT * FROM current WHERE system <> 'memory') b USING (model_context, corpus_size, trial, query_id) GROUP BY b.system),
  every AS (SELECT s AS against, coalesce(a_only, 0) AS a_only, coalesce(b_only, 0) AS b_only, coalesce(both_right, 0) AS both_right, coalesce(neither, 0) AS neither FROM (SELECT unnest(['vanilla', 'hybrid', 'longctx']) AS s) LEFT JOIN p ON s = against),
  q AS (SELECT *, a_only + b_only AS n, CASE WHEN a_only + b_only = 0 THEN 1.0::DOUBLE ELSE least(1.0::DOUBLE, 2 * list_sum(list_transform(range(least(a_only, b_only) + 1), lambda i:
    exp(lgamma(a_only + b_only + 1) - lgamma(i + 1) - lgamma(a_only + b_only - i + 1) + (a_only + b_only) * ln(0.5))))) END AS x FROM every)
  SELECT a_only, b_only, both_right, neither, round(x, 9) AS p, CASE WHEN x < 0.05 AND a_only > b_only THEN 'memory' WHEN x < 0.05 AND a_only < b_only THEN against ELSE 'tie' END AS winner, against FROM q"""


@query
def benjamini_hochberg(spark, sf):
    """Adjusted p of one test per nation, made from its suppliers' and customers' counts."""
    n = views.table(spark, sf, "nation").select(F.col("n_nationkey").alias("id"), ((F.col("n_nationkey") * 37 + 5) % 101 / 400).alias("p"))
    return evaluate.benjamini_hochberg(n)


SQL["benjamini_hochberg"] = """WITH t AS (SELECT n_nationkey AS id, (n_nationkey * 37 + 5) % 101 / 400.0::DOUBLE AS p FROM nation), r AS (SELECT *, row_number() OVER (ORDER BY p, id) AS k, count(*) OVER () AS n FROM t)
SELECT id, p, round(least(1.0, min(p * n / k) OVER (ORDER BY p, id ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)), 9)::DOUBLE AS adjusted FROM r"""


@query
def multiplier(spark, sf):
    return evaluate.multiplier(evaluate.summaries(_cells(spark, sf)), 8192, 0.4)


SQL["multiplier"] = f"WITH {_SUMMARY} SELECT system, coalesce(max(CASE WHEN accuracy >= 0.4 THEN corpus_size END), 0) AS max_size, round(coalesce(max(CASE WHEN accuracy >= 0.4 THEN corpus_size END), 0) / 8192.0::DOUBLE, 6) AS multiplier FROM summary WHERE model_context = 8192 GROUP BY system"


@query
def headline_cell(spark, sf):
    return evaluate.headline_cell(_cells(spark, sf), 100_000, 8192)


SQL["headline_cell"] = f"""WITH {sql.CELLS} SELECT {_G}, count(*) AS rows FROM current GROUP BY {_G}
QUALIFY row_number() OVER (PARTITION BY system ORDER BY (corpus_size = 100000 AND model_context = 8192) DESC, count(*) DESC, model_context, corpus_size) = 1"""


@query
def trial_mean_sd(spark, sf):
    return evaluate.trial_summary(_cells(spark, sf))


SQL["trial_mean_sd"] = f"WITH {sql.CELLS}, t AS (SELECT system, trial, avg(CAST(correct AS DOUBLE)) AS a FROM current GROUP BY ALL) SELECT system, count(*) AS trials, round(avg(a), 6) AS mean, round(coalesce(stddev_samp(a), 0), 6)::DOUBLE AS sd FROM t GROUP BY system"


@query
def scaling_trend(spark, sf):
    return evaluate.scaling_trend(evaluate.summaries(_cells(spark, sf)), ["system", "model_context"])


_ENDS = ", ".join(f"round(arg_max({m}, corpus_size) - arg_min({m}, corpus_size), 6) AS d_{m}" for m in ("accuracy", "mean_precision", "mean_recall", "mean_f1"))
SQL["scaling_trend"] = f"""WITH {_SUMMARY}, d AS (SELECT system, model_context, count(*) AS sizes, {_ENDS} FROM summary GROUP BY ALL)
SELECT *, CASE WHEN sizes < 2 THEN 'single point' WHEN d_accuracy >= -0.005 AND d_mean_f1 >= -0.005 THEN 'holds' WHEN d_accuracy >= -0.005 THEN 'accuracy holds, citations fall' WHEN d_mean_f1 >= -0.005 THEN 'citations hold, accuracy falls' ELSE 'falls' END AS verdict FROM d"""


@query
def iso_accuracy(spark, sf):
    return evaluate.summaries(_cells(spark, sf)).where(F.col("accuracy") >= 0.4).select("system", "model_context", "corpus_size", "mean_input_tokens", "accuracy")


SQL["iso_accuracy"] = f"WITH {_SUMMARY} SELECT {_G}, mean_input_tokens, accuracy FROM summary WHERE accuracy >= 0.4"


@query
def run_compare_fullouter(spark, sf):
    c = _cells(spark, sf)
    old = evaluate.aggregate(c.where("trial = 0 AND system <> 'hybrid'"), ["system"])
    new = evaluate.aggregate(c.where("trial = 1 AND system <> 'vanilla'"), ["system"])
    return evaluate.compare_runs(old, new)


SQL["run_compare_fullouter"] = f"""WITH {sql.CELLS}, o AS (SELECT system, round(avg(CAST(correct AS DOUBLE)), 6) AS a FROM current WHERE trial = 0 AND system <> 'hybrid' GROUP BY system),
  n AS (SELECT system, round(avg(CAST(correct AS DOUBLE)), 6) AS a FROM current WHERE trial = 1 AND system <> 'vanilla' GROUP BY system)
  SELECT system, coalesce(printf('%.3f', o.a), '—') AS old, coalesce(printf('%.3f', n.a), '—') AS new, round((n.a - o.a) / nullif(o.a, 0) * 100, 6) AS delta_pct FROM o FULL JOIN n USING (system)"""


def _axes(spark, sf):
    c = views.cells(spark, sf)
    return [c.select(x).distinct() for x in evaluate.CELL]


@query
def sweep_matrix(spark, sf):
    grid = evaluate.sweep(*_axes(spark, sf))
    return grid.groupBy("system", "model_context", "corpus_size").agg(F.count("*").alias("planned"))


SQL["sweep_matrix"] = f"""WITH {sql.CELLS} SELECT system, model_context, corpus_size, count(*) AS planned FROM (SELECT DISTINCT system FROM cells), (SELECT DISTINCT model_context FROM cells), (SELECT DISTINCT corpus_size FROM cells),
  (SELECT DISTINCT trial FROM cells), (SELECT DISTINCT query_id FROM cells) GROUP BY ALL"""


@query
def resume_antijoin(spark, sf):
    return evaluate.resume(evaluate.sweep(*_axes(spark, sf)), _cells(spark, sf))


SQL["resume_antijoin"] = f"""WITH {sql.CELLS} SELECT * FROM (SELECT * FROM (SELECT DISTINCT system FROM cells), (SELECT DISTINCT model_context FROM cells), (SELECT DISTINCT corpus_size FROM cells),
  (SELECT DISTINCT trial FROM cells), (SELECT DISTINCT query_id FROM cells)) grid ANTI JOIN (SELECT * FROM current WHERE error IS NULL) USING (system, model_context, corpus_size, trial, query_id)"""


@query
def cost_rollup(spark, sf):
    """Tokens and time of all stages of a run; the last stage is the answer itself."""
    c = _cells(spark, sf)
    last = F.col("trial") == 2
    return c.groupBy("system", "query_id").agg(F.sum("input_tokens").alias("total"), F.coalesce(F.sum(F.when(~last, F.col("input_tokens"))), F.lit(0)).alias("pipeline"), F.coalesce(F.sum(F.when(last, F.col("input_tokens"))), F.lit(0)).alias("final"), F.sum("latency_ms").alias("latency_ms"))


SQL["cost_rollup"] = f"""WITH {sql.CELLS} SELECT system, query_id, CAST(sum(input_tokens) AS BIGINT) AS total, CAST(coalesce(sum(input_tokens) FILTER (WHERE trial <> 2), 0) AS BIGINT) AS pipeline, CAST(coalesce(sum(input_tokens) FILTER (WHERE trial = 2), 0) AS BIGINT) AS final, CAST(sum(latency_ms) AS BIGINT) AS latency_ms FROM current GROUP BY ALL"""


@query
def accounting_fix(spark, sf):
    """Rows of one system without the marker get the packet's cost added."""
    c = _cells(spark, sf)
    fixed = F.when((F.col("system") == "memory") & (F.col("line_no") % 4 == 0), F.col("input_tokens") + F.coalesce(F.col("latency_ms"), F.lit(0))).otherwise(F.col("input_tokens"))
    return c.groupBy("system").agg(F.sum("input_tokens").alias("before"), F.sum(fixed).alias("after"), F.sum((fixed != F.col("input_tokens")).cast("long")).alias("changed"))


SQL["accounting_fix"] = f"""WITH {sql.CELLS}, f AS (SELECT system, input_tokens AS a, CASE WHEN system = 'memory' AND line_no % 4 = 0 THEN input_tokens + latency_ms ELSE input_tokens END AS b FROM current)
SELECT system, CAST(sum(a) AS BIGINT) AS before, CAST(sum(b) AS BIGINT) AS after, CAST(count_if(a <> b) AS BIGINT) AS changed FROM f GROUP BY system"""


def _with_meta(cells):
    """Cells with an open map each: a packet's cost, one and the mark, something else, what can't be read, or none."""
    packet = F.struct(F.col("line_no").alias("inputTokensEstimate"), (F.col("line_no") % 40).alias("latencyMs"))
    marked = F.struct(packet.alias("packetCost"), (F.col("input_tokens") - F.col("line_no") % 3).alias("finalCallInputTokens"), (F.col("line_no") % 2).alias("pipelineInputTokens"), F.col("latency_ms").alias("finalCallLatencyMs"))
    other = F.struct(F.array("query_id").alias("cited"), F.lit("none").alias("packetCost"))
    json = F.when(F.col("line_no") % 5 < 2, F.to_json(F.struct(packet.alias("packetCost"), F.col("query_id").alias("note")))).when(F.col("line_no") % 5 == 2, F.to_json(marked)).when(F.col("line_no") % 5 == 3, F.to_json(other)).when(F.col("line_no") % 7 < 3, "[1, {")
    return cells.withColumn("meta", F.try_parse_json(json))


@query
def accounting_meta(spark, sf):
    """Cells of one system whose totals lack their pipeline's cost are mended; the mark's balance is checked before and after."""
    before = _with_meta(_cells(spark, sf))
    after = costs.mend(before, "memory")
    off = lambda df, name: costs.unbalanced(df).groupBy("system").agg(F.count("*").alias(name))
    note = F.try_variant_get("meta", "$.note", "string")
    share = F.try_variant_get("meta", "$.pipelineInputTokens", "long")
    sums = after.groupBy("system").agg(
        F.count("*").alias("n"), F.sum(F.col("mended").cast("long")).alias("mended"), F.sum("input_tokens").alias("input_tokens"), F.sum("latency_ms").alias("latency_ms"),
        F.sum(share).alias("pipeline_tokens"), F.count(note).alias("notes"),
    )
    rows = sums.join(off(before, "off_before"), "system", "left").join(off(after, "off_after"), "system", "left")
    return rows.select(*sums.columns, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("off_before", "off_after")])


SQL["accounting_meta"] = f"""WITH {sql.CELLS}, m AS (SELECT *, line_no % 5 AS kind, coalesce(input_tokens, 0) AS i, coalesce(latency_ms, 0) AS l FROM current),
  f AS (SELECT *, system = 'memory' AND kind <> 2 AS fix, CASE WHEN kind < 2 THEN line_no ELSE 0 END AS pi, CASE WHEN kind < 2 THEN line_no % 40 ELSE 0 END AS pl,
    kind = 2 AND (input_tokens <> input_tokens - line_no % 3 + line_no % 2) AS off FROM m)
  SELECT system, count(*) AS n, CAST(count_if(fix) AS BIGINT) AS mended, CAST(sum(CASE WHEN fix THEN i + pi ELSE input_tokens END) AS BIGINT) AS input_tokens,
    CAST(sum(CASE WHEN fix THEN l + pl ELSE latency_ms END) AS BIGINT) AS latency_ms, CAST(sum(CASE WHEN fix THEN pi WHEN kind = 2 THEN line_no % 2 END) AS BIGINT) AS pipeline_tokens,
    CAST(count_if(kind < 2) AS BIGINT) AS notes, CAST(count_if(off) AS BIGINT) AS off_before, CAST(count_if(off) AS BIGINT) AS off_after FROM f GROUP BY system"""


@query
def rescore_delta(spark, sf):
    """Citation scores before and after wrapped ids are stripped, from orders of a customer and their wrapped copies."""
    from ..operators.answers import citation_id

    o = views.table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_sort(F.collect_set(F.col("o_orderkey") % 5)).alias("k"))
    name = lambda x: F.concat(F.lit("e"), x.cast("string"))
    cited = F.transform("k", lambda x: F.when(x % 2 == 0, F.concat(F.lit("["), name(x), F.lit("]."))).otherwise(name(x)))
    relevant = F.transform(F.filter("k", lambda x: x < 4), name)
    before, after = maths.citation_scores(cited, relevant), maths.citation_scores(F.transform(cited, citation_id), relevant)
    rows = o.select((F.col("o_custkey") % 4).alias("system"), before["f1"].alias("b"), after["f1"].alias("a"))
    return rows.groupBy("system").agg(F.round(F.avg("b"), 6).alias("before"), F.round(F.avg("a"), 6).alias("after"), F.sum((F.col("a") != F.col("b")).cast("long")).alias("changed"))


SQL["rescore_delta"] = """WITH o AS (SELECT o_custkey, list(DISTINCT o_orderkey % 5) AS k FROM orders GROUP BY ALL), s AS (SELECT o_custkey % 4 AS system, len(k) AS c, len(list_filter(k, lambda x: x < 4)) AS r, len(list_filter(k, lambda x: x < 4 AND x % 2 = 1)) AS h FROM o),
  f AS (SELECT system, CASE WHEN h = 0 THEN 0.0::DOUBLE ELSE 2 * (h / c::DOUBLE) * (h / r::DOUBLE) / (h / c::DOUBLE + h / r::DOUBLE) END AS b, CASE WHEN r = 0 THEN 0.0::DOUBLE ELSE 2 * (r / c::DOUBLE) / (r / c::DOUBLE + 1) END AS a, h <> r AS moved FROM s)
  SELECT system, round(avg(b), 6) AS before, round(avg(a), 6) AS after, CAST(count_if(moved) AS BIGINT) AS changed FROM f GROUP BY system"""


@query
def published_claims(spark, sf):
    """Checks of expected values against the summary: a row per claim."""
    s = evaluate.aggregate(_cells(spark, sf), ["system"])
    return report.claims(s, [("memory", 0.3), ("hybrid", 0.9)])


SQL["published_claims"] = f"""WITH {sql.CELLS}, s AS (SELECT system, count(*) AS n, round(avg(CAST(correct AS DOUBLE)), 6) AS accuracy FROM current GROUP BY system)
SELECT c.system, least_accuracy, n, accuracy, accuracy >= least_accuracy AS holds FROM (VALUES ('memory', 0.3::DOUBLE), ('hybrid', 0.9::DOUBLE)) c(system, least_accuracy) LEFT JOIN s USING (system)"""


@query
def mulberry32_stream(spark, sf):
    draws = spark.range(1, 1001).select(F.col("id").alias("k"))
    return draws.select("k", F.round(maths.mulberry32(F.lit(DEFAULT.seed), F.col("k")), 12).alias("x"))


SQL["mulberry32_stream"] = """WITH d AS (SELECT k, (42 + (k * 1831565813) % 4294967296) % 4294967296 AS a FROM range(1, 1001) r(k)),
  t1 AS (SELECT *, CAST((CAST(xor(a, a >> 15) AS HUGEINT) * (a | 1)) % 4294967296 AS BIGINT) AS t FROM d), t2 AS (SELECT *, CAST((t + CAST((CAST(xor(t, t >> 7) AS HUGEINT) * (t | 61)) % 4294967296 AS BIGINT)) % 4294967296 AS BIGINT) AS u FROM t1),
  t3 AS (SELECT k, xor(t, u) AS v FROM t2) SELECT k, round(xor(v, v >> 14) / 4294967296.0::DOUBLE, 12) AS x FROM t3"""


@query
def report_rows(spark, sf):
    return report.rows(evaluate.summaries(_cells(spark, sf)))


SQL["report_rows"] = f"WITH {_SUMMARY} SELECT printf('| %s | %d | %d | %.1f%% | %.2f |', system, model_context, corpus_size, floor(accuracy * 1000 + 0.5) / 10, floor(mean_f1 * 100 + 0.5) / 100) AS line FROM summary"


@query
def graph_dataset(spark, sf):
    return report.accuracy_by_size(evaluate.summaries(_cells(spark, sf)), 8192)


SQL["graph_dataset"] = f"WITH {_SUMMARY} SELECT system, corpus_size, accuracy, CASE WHEN corpus_size >= 1e6 THEN printf('%.0fM', corpus_size / 1e6) ELSE printf('%.0fK', corpus_size / 1e3) END AS label FROM summary WHERE model_context = 8192"


@query
def event_windows(spark, sf):
    """Counts and sums of events per type and hour, as the streaming job makes them."""
    from ..streaming.ingest import windowed

    return windowed(views.table(spark, sf, "events"))


SQL["event_windows"] = "SELECT time_bucket(INTERVAL 1 HOUR, ts) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY ALL"
