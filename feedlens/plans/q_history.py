"""Queries for run-history dashboards and provider comparison (Q1–Q17)."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import deletion as D
from ..operators import history as Hs
from ..operators import search as SE
from ..session import checkpoint_dir
from ..sources import fixtures as FX
from .catalog import query
from .sql_snippets import BILLED, rsum, xavg

START, END, PREV = "2024-01-08 00:00:00", "2024-01-15 00:00:00", "2024-01-01 00:00:00"
RANGE = f"started_at >= TIMESTAMP '{START}' AND started_at < TIMESTAMP '{END}'"


def _runs(spark, sf):
    return FX.fx_runs(spark, sf)


@query("summary", f"""
SELECT count(*) AS total_runs, {rsum(BILLED)} AS total_cost_usd, {xavg('duration_s')} AS avg_latency_s,
       round(avg(CASE WHEN success THEN 1.0 ELSE 0.0 END), 6) AS success_rate,
       round(avg(CASE WHEN from_cache THEN 1.0 ELSE 0.0 END), 6) AS cache_hit_rate
FROM fx_runs WHERE {RANGE}""")
def summary(spark, sf):
    return Hs.summary(_runs(spark, sf), START, END)


@query("cost_by_provider", f"SELECT provider, {rsum(BILLED)} AS cost_usd, count(*) AS runs FROM fx_runs GROUP BY 1")
def cost_by_provider(spark, sf):
    return Hs.cost_by_provider(_runs(spark, sf))


@query("runs_by_day", "SELECT CAST(started_at AS DATE) AS day, count(*) AS runs FROM fx_runs GROUP BY 1")
def runs_by_day(spark, sf):
    return Hs.by_day(_runs(spark, sf)).select("day", "runs")


@query("trend_daily", f"""
SELECT CAST(started_at AS DATE) AS day, {xavg('duration_s')} AS avg_latency_s, {rsum(BILLED)} AS cost_usd
FROM fx_runs GROUP BY 1""")
def trend_daily(spark, sf):
    return Hs.by_day(_runs(spark, sf)).select("day", "avg_latency_s", "cost_usd")


@query("period_delta", f"""
SELECT cr AS current_runs, pr AS previous_runs, round((cr - pr) * 100.0 / pr, 6) AS runs_change_pct,
       cc AS current_cost_usd, pc AS previous_cost_usd FROM (
  SELECT CAST(sum(CASE WHEN started_at >= TIMESTAMP '{START}' THEN 1 ELSE 0 END) AS BIGINT) AS cr,
         CAST(sum(CASE WHEN started_at < TIMESTAMP '{START}' THEN 1 ELSE 0 END) AS BIGINT) AS pr,
         {rsum(f"CASE WHEN started_at >= TIMESTAMP '{START}' THEN {BILLED} ELSE 0.0 END")} AS cc,
         {rsum(f"CASE WHEN started_at < TIMESTAMP '{START}' THEN {BILLED} ELSE 0.0 END")} AS pc
  FROM fx_runs WHERE started_at >= TIMESTAMP '{PREV}' AND started_at < TIMESTAMP '{END}')""")
def period_delta(spark, sf):
    return Hs.period_delta(_runs(spark, sf), START, END, PREV)


@query("quality_avg", f"""
SELECT provider, {xavg('accuracy')} AS avg_accuracy, {xavg('risk')} AS avg_risk FROM fx_runs
WHERE success GROUP BY 1""")
def quality_avg(spark, sf):
    return Hs.quality_avg(_runs(spark, sf))


@query("latency_hist", "SELECT floor(duration_s / 5.0) * 5.0 AS bucket_s, count(*) AS n FROM fx_runs GROUP BY 1")
def latency_hist(spark, sf):
    h = Hs.latency_hist(_runs(spark, sf))
    return h.select(F.col("bucket_s").cast("double").alias("bucket_s"), "n")


@query("history_filter", f"""
SELECT run_id, started_at, cost_usd FROM fx_runs
WHERE {RANGE} AND provider = 'google' AND NOT success AND source = 'crm'""")
def history_filter(spark, sf):
    r = Hs.history_filter(_runs(spark, sf), START, END, provider="google", success=False, source="crm")
    return r.select("run_id", "started_at", "cost_usd")


@query("history_page", """
SELECT run_id, cost_usd, (SELECT count(*) FROM fx_runs) AS total, CAST(ceil((SELECT count(*) FROM fx_runs) / 20) AS BIGINT) AS pages
FROM fx_runs ORDER BY cost_usd DESC, run_id ASC LIMIT 20 OFFSET 40""")
def history_page(spark, sf):
    return Hs.history_page(_runs(spark, sf), "cost_usd", page=3).select("run_id", "cost_usd", "total", "pages")


@query("history_search", """
SELECT request_id FROM fx_feedback
WHERE content ILIKE '%worthless%' OR levenshtein(lower(customer_id), 'cust-1234') <= 2""")
def history_search(spark, sf):
    return Hs.history_search(FX.fx_feedback(spark, sf), "worthless", "cust-1234").select("request_id")


@query("history_search_index", """
SELECT request_id FROM fx_feedback
WHERE content ILIKE '%worthless%' OR levenshtein(lower(customer_id), 'cust-1234') <= 2""")
def history_search_index(spark, sf):
    """Q9 by stored indexes: trigrams of contents, shortened forms of customer ids."""
    f = FX.fx_feedback(spark, sf)
    at = f"{checkpoint_dir(spark)}/search-{uuid.uuid4().hex[:12]}"
    SE.write(SE.content_index(f, "request_id"), f"{at}/contents")
    SE.write(SE.id_index(f), f"{at}/ids")
    return SE.search(f, spark.read.parquet(f"{at}/contents"), spark.read.parquet(f"{at}/ids"), "request_id",
                     "worthless", "cust-1234").select("request_id")


@query("history_delete", """
SELECT run_id FROM fx_runs WHERE run_id NOT IN (SELECT run_id FROM fx_runs WHERE NOT success)""")
def history_delete(spark, sf):
    r = _runs(spark, sf)
    # delete the failed runs: the id list is itself derived from the table
    return Hs.history_delete(r, r.filter(~F.col("success"))).select("run_id")


@query("history_delete_files", """
SELECT run_id, CAST(started_at AS DATE) AS day FROM fx_runs WHERE success OR user_id % 7 <> 0""")
def history_delete_files(spark, sf):
    """Q10 in a stored table by day: only the days that hold a deleted run are written anew."""
    path = f"{checkpoint_dir(spark)}/history-{uuid.uuid4().hex[:12]}"
    r = _runs(spark, sf)
    r.select("run_id", F.to_date("started_at").alias("day")).write.partitionBy("day").parquet(path)
    D.delete(spark, path, r.filter(~F.col("success") & (F.col("user_id") % 7 == 0)).select("run_id"), "day")
    return spark.read.parquet(path).select("run_id", "day")


@query("recent_runs", "SELECT run_id, started_at FROM fx_runs ORDER BY started_at DESC, run_id LIMIT 10")
def recent_runs(spark, sf):
    return Hs.recent_runs(_runs(spark, sf)).select("run_id", "started_at")


SCORED = "CASE WHEN success THEN accuracy END"


def _pivot_cols():
    cols = []
    for p in Hs.PROVIDER_ORDER:
        for m, src in (("latency_s", "duration_s"), ("cost_usd", BILLED), ("accuracy", SCORED)):
            x = f"CASE WHEN provider = '{p}' THEN {src} END"
            cols.append(f"{xavg(x)} AS {p}_{m}")
    return ", ".join(cols)


@query("compare_pivot", f"SELECT input_key, {_pivot_cols()} FROM fx_runs GROUP BY input_key")
def compare_pivot(spark, sf):
    return Hs.compare_pivot(_runs(spark, sf))


STATS = f"""(SELECT input_key, provider, {xavg('duration_s')} AS latency_s, {xavg(BILLED)} AS cost_usd,
  {xavg(SCORED)} AS accuracy FROM fx_runs GROUP BY 1, 2)"""


@query("compare_winner", f"""
SELECT input_key, provider, score FROM (
  SELECT *, row_number() OVER (PARTITION BY input_key ORDER BY score DESC NULLS LAST, provider) AS r
  FROM (SELECT *, accuracy / nullif(cost_usd, 0) AS score FROM {STATS})) WHERE r = 1""")
def compare_winner(spark, sf):
    return Hs.compare_winner(_runs(spark, sf))


@query("compare_cost_diff", f"""
SELECT input_key, provider, cost_usd,
  (cost_usd - min(cost_usd) OVER (PARTITION BY input_key)) * 100 / nullif(min(cost_usd) OVER (PARTITION BY input_key), 0)
  AS pct_over_cheapest FROM {STATS}""")
def compare_cost_diff(spark, sf):
    return Hs.compare_cost_diff(_runs(spark, sf))


@query("quality_band", """
SELECT run_id, CASE WHEN accuracy > 0.9 THEN 'green' WHEN accuracy >= 0.8 THEN 'yellow' ELSE 'red' END AS band
FROM fx_runs""")
def quality_band(spark, sf):
    return Hs.quality_band(_runs(spark, sf))


@query("route_cheapest", f"""
SELECT arg_min(provider, c) AS provider, min(c) AS avg_cost_usd FROM (
  SELECT provider, quantile_cont(duration_s, 0.95) AS p95, {xavg(BILLED)} AS c FROM fx_runs GROUP BY 1)
WHERE p95 <= 47.0""")
def route_cheapest(spark, sf):
    return Hs.route_cheapest(_runs(spark, sf), 47.0)


@query("retry_failed_any_source", """
SELECT f.run_id FROM fx_runs f
WHERE NOT f.success AND NOT EXISTS (
  SELECT 1 FROM fx_runs s WHERE s.success AND s.user_id = f.user_id AND s.started_at > f.started_at
  AND nullif(s.source, 'view') IS NOT DISTINCT FROM nullif(f.source, 'view'))""")
def retry_failed_any_source(spark, sf):
    """Q17 where some runs have no source: a later success without one counts for them."""
    r = _runs(spark, sf).withColumn("source", F.nullif("source", F.lit("view")))
    return Hs.retry_failed(r).select("run_id")


@query("retry_failed", """
SELECT f.run_id FROM fx_runs f
LEFT JOIN (SELECT user_id, source, max(started_at) AS last_ok FROM fx_runs WHERE success GROUP BY 1, 2) s
  ON f.user_id = s.user_id AND f.source = s.source
WHERE NOT f.success AND (s.last_ok IS NULL OR s.last_ok <= f.started_at)""")
def retry_failed(spark, sf):
    return Hs.retry_failed(_runs(spark, sf)).select("run_id")
