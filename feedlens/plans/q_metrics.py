"""Queries for metrics (MT1–MT10, A7), log windows and alarms."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from .. import schemas as S
from ..operators import metrics as MT
from ..operators import sketches as SK
from ..session import checkpoint_dir
from ..sources import fixtures as FX
from .catalog import query
from .sql_snippets import BILLED, rsum
from .q_repair import SELF_CHECK_REPAIRED, repaired_self_check


def bucket_sql(ts: str, seconds: int) -> str:
    us = seconds * 1_000_000
    return f"make_timestamp((epoch_us({ts}) // {us}) * {us})"


def hist_sql(src: str, labels: list[str], value: str, buckets: list[float], metric: str) -> str:
    """Cumulative histogram rows of `src` in long form."""
    lab = ", ".join(labels)
    sel = (lab + ", ") if labels else ""
    aggs = ", ".join(f"CAST(sum(CASE WHEN {value} <= {b!r} THEN 1 ELSE 0 END) AS DOUBLE) AS b{i}"
                     for i, b in enumerate(buckets))
    rows = [f"{{'metric': '{metric}_bucket', 'le': '{MT.le_label(b)}', 'value': b{i}}}" for i, b in enumerate(buckets)]
    rows += [f"{{'metric': '{metric}_bucket', 'le': '+Inf', 'value': cnt}}",
             f"{{'metric': '{metric}_count', 'le': NULL, 'value': cnt}}",
             f"{{'metric': '{metric}_sum', 'le': NULL, 'value': total}}"]
    group = f"GROUP BY {lab}" if labels else ""
    return f"""
SELECT r.metric AS metric, {sel}r.le AS le, r.value AS value FROM (
  SELECT {sel}unnest([{", ".join(rows)}]) AS r FROM (
    SELECT {sel}{aggs}, CAST(count({value}) AS DOUBLE) AS cnt, {rsum(value)} AS total FROM {src} {group}))"""


def _runs(spark, sf):
    return FX.fx_runs(spark, sf)


def _log(spark, sf, *events):
    return MT.parse_log(FX.fx_log(spark, sf), events=events)


@query("scan_log", """
SELECT event, level, run_id, provider, success, total_cost_usd, total_latency_ms, error, field, ts FROM fx_log""")
def scan_log(spark, sf):
    return _log(spark, sf).filter(F.col(MT.CORRUPT).isNull()).select(
        "event", "level", "run_id", "provider", "success", "total_cost_usd", "total_latency_ms", "error", "field", "ts")


@query("scan_log_bad", """
SELECT count(*) FILTER (WHERE event_id % 101 = 0) AS corrupt_lines, CAST(0 AS BIGINT) AS bad_times FROM fx_runs""")
def scan_log_bad(spark, sf):
    """Cut lines are kept and counted; whole-second times are read."""
    return MT.unreadable_lines(_log(spark, sf))


EXECUTIONS = """(SELECT CASE WHEN raised THEN 'unknown' ELSE provider END AS provider,
    CASE WHEN raised THEN 'unknown' ELSE model END AS model,
    CASE WHEN raised THEN 'error' WHEN success THEN 'success' ELSE 'failure' END AS status FROM fx_runs)"""
RESULTS = "(SELECT * REPLACE (CASE WHEN from_cache THEN 0.0 ELSE cost_usd END AS cost_usd) FROM fx_runs WHERE NOT raised)"


@query("m_executions", f"SELECT provider, model, status, count(*) AS value FROM {EXECUTIONS} GROUP BY ALL")
def m_executions(spark, sf):
    return MT.executions(_runs(spark, sf))


@query("m_duration_hist", hist_sql(RESULTS, ["provider", "model"], "duration_s", S.DURATION_BUCKETS,
                                   "workflow_duration_seconds"))
def m_duration_hist(spark, sf):
    return MT.histogram(MT.with_result(_runs(spark, sf)), ["provider", "model"], "duration_s", S.DURATION_BUCKETS,
                        "workflow_duration_seconds")


@query("m_cost_hist", hist_sql(RESULTS, ["provider", "model"], "cost_usd", S.COST_BUCKETS, "workflow_cost_usd"))
def m_cost_hist(spark, sf):
    return MT.histogram(MT.with_result(_runs(spark, sf)), ["provider", "model"], "cost_usd", S.COST_BUCKETS,
                        "workflow_cost_usd")


# stated by counting: runs begun less runs ended at every event time, and at each period's start
ACTIVE = f"""
WITH x AS (SELECT started_at AS t, 1 AS d FROM fx_runs UNION ALL SELECT completed_at, -1 FROM fx_runs),
at_time AS (SELECT DISTINCT t, sum(d) OVER (ORDER BY t RANGE UNBOUNDED PRECEDING) AS level FROM x),
period AS (SELECT unnest(generate_series(min({bucket_sql('t', 300)}), max({bucket_sql('t', 300)}), INTERVAL 300 SECOND))
           AS bucket FROM x),
entry AS (SELECT p.bucket, coalesce(a.level, 0) AS level FROM period p ASOF LEFT JOIN at_time a ON p.bucket > a.t),
inside AS (SELECT {bucket_sql('t', 300)} AS bucket, max(level) AS level FROM at_time GROUP BY 1)
SELECT e.bucket, CAST(greatest(e.level, coalesce(i.level, e.level)) AS BIGINT) AS peak_active
FROM entry e LEFT JOIN inside i ON e.bucket = i.bucket"""


@query("m_active_runs", ACTIVE)
def m_active_runs(spark, sf):
    return MT.active_runs(_runs(spark, sf))


@query("m_active_runs_far", f"""{ACTIVE}
UNION ALL SELECT TIMESTAMP '9999-12-30 00:00:00', 1""")
def m_active_runs_far(spark, sf):
    """MT4 with a stray run in the year 9999: one more period, not 800 million."""
    r = _runs(spark, sf).select("started_at", "completed_at")
    far = spark.sql("SELECT TIMESTAMP '9999-12-30 00:01:00' AS started_at, TIMESTAMP '9999-12-30 00:02:00' AS completed_at")
    return MT.active_runs(r.unionByName(far))


@query("m_tokens", """
SELECT provider, model, 'input' AS type, CAST(sum(tokens_input) AS BIGINT) AS value FROM fx_runs GROUP BY ALL
UNION ALL
SELECT provider, model, 'output', CAST(sum(tokens_output) AS BIGINT) FROM fx_runs GROUP BY ALL""")
def m_tokens(spark, sf):
    return MT.tokens(_runs(spark, sf))


STEP_SECONDS = """(SELECT step, provider, CAST((epoch_us(completed_at) - epoch_us(started_at)) // 1000 AS DOUBLE) / 1000
  AS duration_s FROM fx_steps)"""


@query("m_step_hist", hist_sql(STEP_SECONDS, ["step", "provider"], "duration_s", S.STEP_DURATION_BUCKETS,
                               "agent_step_duration_seconds"))
def m_step_hist(spark, sf):
    s = FX.fx_steps(spark, sf)
    d = ((F.unix_micros("completed_at") - F.unix_micros("started_at")) / 1000).cast("long").cast("double") / 1000
    return MT.histogram(s.withColumn("duration_s", d), ["step", "provider"], "duration_s",
                        S.STEP_DURATION_BUCKETS, "agent_step_duration_seconds")


@query("m_step_failures", "SELECT step, provider, count(*) AS value FROM fx_steps WHERE status = 'failed' GROUP BY ALL")
def m_step_failures(spark, sf):
    return MT.step_failures(FX.fx_steps(spark, sf))


@query("m_risk_hist", hist_sql("fx_runs", [], "risk", S.RISK_BUCKETS, "hallucination_risk_score"))
def m_risk_hist(spark, sf):
    return MT.histogram(_runs(spark, sf), [], "risk", S.RISK_BUCKETS, "hallucination_risk_score")


@query("m_rejections", f"""
SELECT rejection_reason AS reason, count(*) AS value FROM ({SELF_CHECK_REPAIRED}) WHERE NOT approved GROUP BY 1""")
def m_rejections(spark, sf):
    return MT.rejections(repaired_self_check(spark, sf))


@query("m_rollup", """
SELECT provider, model, status, count(*) AS value, GROUPING(provider, model, status) AS level
FROM """ + EXECUTIONS + """
GROUP BY ROLLUP (provider, model, status)""")
def m_rollup(spark, sf):
    return MT.rollup_executions(_runs(spark, sf))


def lines_sql(src: str, labels: list[str], metric: str = "metric") -> str:
    """Text lines of samples (labels…, value, and le where there is one)."""
    parts = [f"'{x}=\"' || {x} || '\"'" for x in labels]
    if metric == "metric":
        parts.append("CASE WHEN le IS NOT NULL THEN 'le=\"' || le || '\"' END")
    inside = f"concat_ws(',', {', '.join(parts)})" if parts else "''"
    return (f"SELECT {metric} || CASE WHEN {inside} = '' THEN '' ELSE '{{' || {inside} || '}}' END || ' ' || "
            f"regexp_replace(CAST(CAST(value AS DOUBLE) AS VARCHAR), '\\.0$', '') AS line FROM ({src})")


@query("metrics_text", lines_sql(f"SELECT provider, model, status, count(*) AS value FROM {EXECUTIONS} GROUP BY ALL",
                                 ["provider", "model", "status"], "'workflow_executions_total'"))
def metrics_text(spark, sf):
    e = MT.executions(_runs(spark, sf)).withColumn("metric", F.lit("workflow_executions_total"))
    return MT.exposition(e, ["provider", "model", "status"])


def _win_sql(where: str, seconds: int, agg: str = "count(*)") -> str:
    return f"SELECT {bucket_sql('ts', seconds)} AS window_start, {agg} AS n FROM fx_log WHERE {where} GROUP BY 1"


@query("log_completed", _win_sql("event = 'workflow_execution_completed'", 300))
def log_completed(spark, sf):
    return MT.window_counts(_log(spark, sf).filter(F.col("event") == S.EV_COMPLETED), "5 minutes")


@query("log_failed", _win_sql("event = 'workflow_execution_failed'", 300))
def log_failed(spark, sf):
    return MT.window_counts(_log(spark, sf, S.EV_FAILED), "5 minutes")


@query("log_cost", _win_sql("event = 'workflow_execution_completed' AND total_cost_usd IS NOT NULL", 300,
                            f"{rsum('total_cost_usd')}"))
def log_cost(spark, sf):
    l = _log(spark, sf).filter((F.col("event") == S.EV_COMPLETED) & F.col("total_cost_usd").isNotNull())
    return MT.window_counts(l, "5 minutes", F.col("total_cost_usd"))


FAILED = "event = 'workflow_execution_failed'"
UNSUCCESSFUL = f"{FAILED} OR (event = 'workflow_execution_completed' AND NOT success)"


def _unsuccessful(log):
    return log.filter((F.col("event") == S.EV_FAILED) | ((F.col("event") == S.EV_COMPLETED) & ~F.col("success")))


def _alarm_sql(seconds: int, where: str = FAILED) -> str:
    c = _win_sql(where, seconds)
    return f"""
SELECT a.window_start, a.n, b.n AS prev_n FROM ({c}) a JOIN ({c}) b
  ON b.window_start + INTERVAL {seconds} SECOND = a.window_start WHERE a.n > 5 AND b.n > 5"""


@query("alarm_errors", _alarm_sql(300))
def alarm_errors(spark, sf):
    c = MT.window_counts(_log(spark, sf, S.EV_FAILED), "5 minutes")
    return MT.alarm(c, 300)


@query("alarm_errors_any", _alarm_sql(300).replace("n > 5", "n > 0"))
def alarm_errors_any(spark, sf):
    """L4 over 300 s periods with threshold 0, which the given events do reach."""
    c = MT.window_counts(_log(spark, sf, S.EV_FAILED), "5 minutes")
    return MT.alarm(c, 300, threshold=0)


@query("log_succeeded", _win_sql("event = 'workflow_execution_completed' AND success", 300))
def log_succeeded(spark, sf):
    """L1 by success: completed runs that ended well."""
    return MT.window_counts(_log(spark, sf).filter((F.col("event") == S.EV_COMPLETED) & F.col("success")), "5 minutes")


@query("log_unsuccessful", _win_sql(UNSUCCESSFUL, 300))
def log_unsuccessful(spark, sf):
    """L2 by success (K13): runs that raised or completed without success."""
    return MT.window_counts(_unsuccessful(_log(spark, sf, S.EV_FAILED, S.EV_COMPLETED)), "5 minutes")


@query("alarm_errors_1h", _alarm_sql(3600, UNSUCCESSFUL))
def alarm_errors_1h(spark, sf):
    """L4 by success over one hour."""
    return MT.alarm(MT.window_counts(_unsuccessful(_log(spark, sf, S.EV_FAILED, S.EV_COMPLETED)), "1 hour"), 3600)


@query("rate_5m", """
SELECT ws AS window_start, ws + INTERVAL 5 MINUTE AS window_end, count(*) AS n, round(count(*) / 300, 6) AS rate
FROM (SELECT make_timestamp((epoch_us(ts) // 60000000 - k) * 60000000) AS ws
      FROM fx_log, (VALUES (0), (1), (2), (3), (4)) AS t(k) WHERE event = 'workflow_execution_completed')
GROUP BY ws""")
def rate_5m(spark, sf):
    return MT.sliding_rate(_log(spark, sf).filter(F.col("event") == S.EV_COMPLETED))


@query("latency_pct", """
SELECT provider, CAST(0.5 AS DOUBLE) AS p, round(quantile_cont(duration_s, 0.5), 6) AS value FROM fx_runs GROUP BY provider
UNION ALL SELECT provider, 0.95, round(quantile_cont(duration_s, 0.95), 6) FROM fx_runs GROUP BY provider
UNION ALL SELECT provider, 0.99, round(quantile_cont(duration_s, 0.99), 6) FROM fx_runs GROUP BY provider""")
def latency_pct(spark, sf):
    r = MT.exact_percentiles(_runs(spark, sf), ["provider"], "duration_s", [0.5, 0.95, 0.99])
    return r.select("provider", "p", F.round("value", 6).alias("value"))


@query("alert_rules", f"""
SELECT 'error_rate' AS rule, window_start, round(v, 6) AS value, CAST(0.05 AS DOUBLE) AS threshold FROM (
  SELECT {bucket_sql('started_at', 300)} AS window_start, avg(CASE WHEN success THEN 0.0 ELSE 1.0 END) AS v
  FROM fx_runs GROUP BY 1) WHERE v > 0.05
UNION ALL
SELECT 'p95_latency_s', window_start, round(v, 6), 10.0 FROM (
  SELECT {bucket_sql('started_at', 3600)} AS window_start, quantile_cont(duration_s, 0.95) AS v
  FROM fx_runs GROUP BY 1) WHERE v > 10.0
UNION ALL
SELECT 'rejection_rate', window_start, round(v, 6), 0.3 FROM (
  SELECT {bucket_sql('started_at', 3600)} AS window_start, avg(CASE WHEN approved THEN 0.0 ELSE 1.0 END) AS v
  FROM fx_runs GROUP BY 1) WHERE v > 0.3
UNION ALL
SELECT 'cost_per_hour', window_start, round(v, 6), 0.5 FROM (
  SELECT {bucket_sql('started_at', 3600)} AS window_start, {rsum(BILLED)} AS v FROM fx_runs GROUP BY 1) WHERE v > 0.5""")
def alert_rules(spark, sf):
    r = _runs(spark, sf).withColumn("ts", F.col("started_at"))
    return MT.alert_rules(r)


@query("budget_alert", f"""
SELECT day, env, cost AS cost_usd, budget_usd, cost > budget_usd AS over_budget FROM (
  SELECT CAST(started_at AS DATE) AS day, environment AS env, {rsum(BILLED)} AS cost
  FROM fx_runs GROUP BY ALL) c
JOIN (VALUES ('dev', CAST(10.0 AS DOUBLE)), ('staging', 100.0), ('prod', 1000.0)) AS b(env2, budget_usd) ON c.env = b.env2""")
def budget_alert(spark, sf):
    return MT.budget_alert(_runs(spark, sf))


@query("log_warnings", "SELECT event, field, count(*) AS n FROM fx_log WHERE level = 'warning' GROUP BY ALL")
def log_warnings(spark, sf):
    return MT.warnings(_log(spark, sf))


RANKS = """
SELECT provider, TRUE AS p50_ok, TRUE AS p95_ok, TRUE AS p99_ok FROM fx_runs GROUP BY provider"""


@query("latency_sketch", RANKS)
def latency_sketch(spark, sf):
    """L7 from stored sketches of five minutes, merged: is each value's rank within the sketches' bound?"""
    runs = _runs(spark, sf)
    stored = f"{checkpoint_dir(spark)}/latency-sketches-{uuid.uuid4().hex[:12]}"
    SK.write(SK.sketch(runs, "duration_s", ["provider"], ts="started_at"), stored)
    merged = SK.percentiles(SK.current(spark.read.parquet(stored), ["provider"]), ["provider"], [0.5, 0.95, 0.99])
    each = merged.groupBy("provider").agg(*[F.max(F.when(F.col("p") == p, F.col("value"))).alias(name)
                                            for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99"))])
    j = runs.select("provider", "duration_s").join(F.broadcast(each), "provider")  # one row per provider
    n = F.count(F.lit(1))
    ok = []
    for p, name in ((0.5, "p50"), (0.95, "p95"), (0.99, "p99")):
        low, high = F.count_if(F.col("duration_s") < F.col(name)) / n, F.count_if(F.col("duration_s") <= F.col(name)) / n
        ok.append(((low <= p + SK.RANK_ERROR) & (high >= p - SK.RANK_ERROR)).alias(f"{name}_ok"))
    return j.groupBy("provider").agg(*ok)


@query("latency_pct_approx", RANKS)
def latency_pct_approx(spark, sf):
    """L7 in one pass with a mergeable sketch: is each value's rank within its stated bound (1/1000 of the rows)?"""
    runs = _runs(spark, sf)
    ps, names = [0.5, 0.95, 0.99], ["p50", "p95", "p99"]
    a = MT.approx_percentiles(runs, ["provider"], "duration_s", ps, accuracy=1000)
    j = runs.select("provider", "duration_s").join(F.broadcast(a), "provider")  # one row per provider
    n = F.count(F.lit(1))
    below = [F.count_if(F.col("duration_s") < F.col("values")[k]) for k in range(3)]
    upto = [F.count_if(F.col("duration_s") <= F.col("values")[k]) for k in range(3)]
    ok = [((lo <= p * n + n / 1000 + 1) & (hi >= p * n - n / 1000 - 1)).alias(f"{name}_ok")
          for lo, hi, p, name in zip(below, upto, ps, names)]
    return j.groupBy("provider").agg(*ok)


DURATION_HIST = hist_sql(RESULTS, ["provider", "model"], "duration_s", S.DURATION_BUCKETS, "workflow_duration_seconds")


@query("metrics_text_hist", lines_sql(DURATION_HIST, ["provider", "model"]))
def metrics_text_hist(spark, sf):
    """A7 for the duration histogram (MT2): bucket, count and sum lines."""
    h = MT.histogram(MT.with_result(_runs(spark, sf)), ["provider", "model"], "duration_s", S.DURATION_BUCKETS,
                     "workflow_duration_seconds")
    return MT.exposition(h, ["provider", "model"])


def _registry_sql() -> str:
    by = ["provider", "model"]
    bodies = {
        "workflow_executions_total": lines_sql(
            f"SELECT provider, model, status, count(*) AS value FROM {EXECUTIONS} GROUP BY ALL", [*by, "status"],
            "'workflow_executions_total'"),
        "workflow_duration_seconds": lines_sql(DURATION_HIST, by),
        "workflow_cost_usd": lines_sql(hist_sql(RESULTS, by, "cost_usd", S.COST_BUCKETS, "workflow_cost_usd"), by),
        "tokens_consumed_total": lines_sql(
            "SELECT provider, model, 'input' AS type, sum(tokens_input) AS value FROM fx_runs GROUP BY ALL UNION ALL "
            "SELECT provider, model, 'output', sum(tokens_output) FROM fx_runs GROUP BY ALL", [*by, "type"],
            "'tokens_consumed_total'"),
        "agent_step_duration_seconds": lines_sql(
            hist_sql(STEP_SECONDS, ["step", "provider"], "duration_s", S.STEP_DURATION_BUCKETS,
                     "agent_step_duration_seconds"), ["step", "provider"]),
        "agent_step_failures_total": lines_sql(
            "SELECT step, provider, count(*) AS value FROM fx_steps WHERE status = 'failed' GROUP BY ALL",
            ["step", "provider"], "'agent_step_failures_total'"),
        "hallucination_risk_score": lines_sql(
            hist_sql("fx_runs", [], "risk", S.RISK_BUCKETS, "hallucination_risk_score"), []),
        "self_check_rejections_total": lines_sql(
            f"SELECT rejection_reason AS reason, count(*) AS value FROM ({SELF_CHECK_REPAIRED}) WHERE NOT approved "
            "GROUP BY 1", ["reason"], "'self_check_rejections_total'"),
        "active_workflows": lines_sql(
            f"SELECT arg_max(peak_active, bucket) AS value FROM ({ACTIVE})", [], "'active_workflows'"),
    }
    parts = []
    for name, (kind, text) in S.METRICS.items():
        parts.append(f"SELECT '{name}' AS family, 0 AS pos, '# HELP {name} {text}' AS line")
        parts.append(f"SELECT '{name}', 1, '# TYPE {name} {kind}'")
        parts.append(f"SELECT '{name}', 2, line FROM ({bodies[name]})")
    return "\nUNION ALL ".join(parts)


@query("metrics_text_all", _registry_sql())
def metrics_text_all(spark, sf):
    """The nine metrics with their HELP and TYPE lines."""
    return MT.registry(_runs(spark, sf), FX.fx_steps(spark, sf), repaired_self_check(spark, sf))
