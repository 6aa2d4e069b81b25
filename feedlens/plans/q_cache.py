"""Queries for the cache (H1–H8, A4, A5)."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import keys
from ..functions.exact import rsum
from .sql_snippets import rsum as sql_rsum
from ..operators import cache as H
from ..operators import metrics as MT
from ..sources import fixtures as FX
from .catalog import query
from .q_results import _outcome, record, record_sql

KEY_SQL = "'workflow:result:' || sha256(content || ':google:gemini-2.5-flash-lite')"


def _requests(spark, sf):
    f = FX.fx_feedback(spark, sf).withColumn("provider", F.lit(S.DEFAULT_PROVIDER)) \
        .withColumn("model", F.lit(S.DEFAULT_MODEL))
    return H.with_cache_key(f).select("request_id", "cache_key", "requested_at")


def _looked(spark, sf, ttl=S.CACHE_TTL_SECONDS):
    return H.lookup(_requests(spark, sf), FX.fx_cache(spark, sf), ttl_seconds=ttl)


def _hit_cols(df):
    r = F.from_json("result_json", S.RESULT)
    return df.select("request_id", r["run_id"].alias("cached_run_id"),
                     r["total_cost_usd"].alias("cached_cost_usd"), "written_at")


@query("cache_key", f"SELECT request_id, {KEY_SQL} AS cache_key FROM fx_feedback")
def cache_key(spark, sf):
    return _requests(spark, sf).select("request_id", "cache_key")


def hits_sql(ttl: int) -> str:
    return f"""
SELECT request_id, arg_max(cached_run_id, c.written_at) AS cached_run_id,
       arg_max(cached_cost_usd, c.written_at) AS cached_cost_usd, max(c.written_at) AS written_at
FROM (SELECT request_id, requested_at, {KEY_SQL} AS k FROM fx_feedback) r
JOIN fx_cache c ON c.cache_key = r.k AND c.written_at <= r.requested_at
  AND r.requested_at < c.written_at + INTERVAL {ttl} SECOND
GROUP BY request_id"""


@query("cache_hits", hits_sql(S.CACHE_TTL_SECONDS))
def cache_hits(spark, sf):
    return _hit_cols(H.hits(_looked(spark, sf)))


@query("cache_misses", f"""
SELECT request_id, cache_key FROM (SELECT request_id, {KEY_SQL} AS cache_key FROM fx_feedback)
WHERE request_id NOT IN (SELECT request_id FROM ({hits_sql(S.CACHE_TTL_SECONDS)}))""")
def cache_misses(spark, sf):
    return H.misses(_looked(spark, sf)).select("request_id", "cache_key")


@query("cache_ttl", hits_sql(1200))
def cache_ttl(spark, sf):
    return _hit_cols(H.hits(_looked(spark, sf, ttl=1200)))


@query("cache_latest", """
SELECT cache_key, arg_max(cached_run_id, written_at) AS cached_run_id, max(written_at) AS written_at
FROM fx_cache GROUP BY cache_key""")
def cache_latest(spark, sf):
    l = H.latest_entries(FX.fx_cache(spark, sf))
    return l.select("cache_key", F.get_json_object("result_json", "$.run_id").alias("cached_run_id"), "written_at")


@query("cache_roundtrip", """
SELECT cache_key, cached_run_id AS run_id, cached_cost_usd AS total_cost_usd,
       'google' AS provider_used, TRUE AS success, written_at FROM fx_cache""")
def cache_roundtrip(spark, sf):
    r = H.read_results(FX.fx_cache(spark, sf))
    return r.select("cache_key", F.col("result.run_id").alias("run_id"),
                    F.col("result.total_cost_usd").alias("total_cost_usd"),
                    F.col("result.provider_used").alias("provider_used"),
                    F.col("result.success").alias("success"), "written_at")


@query("cache_write", f"""
SELECT {KEY_SQL} AS cache_key, f.requested_at AS written_at, x.* EXCLUDE (error)
FROM ({record_sql()}) x JOIN fx_feedback f ON x.run_id = f.request_id WHERE x.success""")
def cache_write(spark, sf):
    """A4 and back (A5): the whole record of every successful run, through its cached JSON."""
    o = _outcome(spark, sf)
    f = FX.fx_feedback(spark, sf).select(F.col("request_id").alias("run_id"), F.col("content").alias("note"),
                                         F.col("requested_at").alias("written_at"))
    res = (o.join(f, "run_id").withColumn("provider", F.lit(S.DEFAULT_PROVIDER))
           .withColumn("model", F.lit(S.DEFAULT_MODEL)))
    res = H.with_cache_key(res, content="note").drop("provider", "model", "note")
    back = H.read_results(H.entries_for(res))
    nested = [f.name for f in S.RESULT.fields if f.name in o.columns and f.name != "error"]
    return record(back.select("cache_key", "written_at", *[F.col(f"result.{c}").alias(c) for c in nested]))


@query("cache_union", f"""
SELECT request_id, coalesce(cached_run_id, own) AS run_id, cached_run_id IS NOT NULL AS from_cache
FROM (SELECT request_id, sha256(request_id || chr(1) || 'google' || chr(1) || 'gemini-2.5-flash-lite') AS own FROM fx_feedback)
LEFT JOIN ({hits_sql(S.CACHE_TTL_SECONDS)}) USING (request_id)""")
def cache_union(spark, sf):
    """H2: one row for every request, its cached result or its own run."""
    looked = _looked(spark, sf)
    own = keys.run_id(F.col("request_id"), F.lit(S.DEFAULT_PROVIDER), F.lit(S.DEFAULT_MODEL))
    hit = H.results_of_hits(H.hits(looked)).select("request_id", "run_id", "from_cache")
    return hit.unionByName(H.misses(looked).select("request_id", own.alias("run_id"), F.lit(False).alias("from_cache")))


@query("dedupe_calls", f"""
SELECT request_id, min(request_id) OVER (PARTITION BY {KEY_SQL}) AS leader_request_id FROM fx_feedback""")
def dedupe_calls(spark, sf):
    return H.leaders(_requests(spark, sf)).select("request_id", "leader_request_id")


@query("dedupe_savings", f"""
SELECT count(*) AS requests, count(DISTINCT {KEY_SQL}) AS calls, count(*) - count(DISTINCT {KEY_SQL}) AS saved_calls
FROM fx_feedback""")
def dedupe_savings(spark, sf):
    l = H.leaders(_requests(spark, sf))
    return l.agg(F.count(F.lit(1)).alias("requests"),
                 F.sum((F.col("request_id") == F.col("leader_request_id")).cast("long")).alias("calls")) \
        .withColumn("saved_calls", F.col("requests") - F.col("calls"))


@query("cache_hit_rate", """
SELECT provider, count(*) FILTER (WHERE event = 'cache_hit') AS hits,
       count(*) FILTER (WHERE event = 'cache_miss') AS misses,
       round(avg(CASE WHEN event = 'cache_hit' THEN 1.0 ELSE 0.0 END), 6) AS hit_rate
FROM fx_log WHERE event IN ('cache_hit', 'cache_miss') GROUP BY provider""")
def cache_hit_rate(spark, sf):
    return MT.cache_hit_rate(MT.parse_log(FX.fx_log(spark, sf)))


@query("cache_savings", f"""
SELECT count(*) AS n_hits, {sql_rsum('cached_cost_usd')} AS saved_usd FROM ({hits_sql(S.CACHE_TTL_SECONDS)})""")
def cache_savings(spark, sf):
    h = _hit_cols(H.hits(_looked(spark, sf)))
    return h.agg(F.count(F.lit(1)).alias("n_hits"), rsum("cached_cost_usd").alias("saved_usd"))
