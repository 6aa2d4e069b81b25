"""Queries for the rate limiter (U1) and trailing request counts."""

from __future__ import annotations

from ..operators import ratelimit as U
from ..sources.tables import table
from .catalog import query


def _rate_sql(limit: int, window_s: int) -> str:
    w = window_s * 1_000_000
    live = f"list_filter(r.win, lambda x: x > e.t - {w})"
    return f"""
WITH RECURSIVE ev AS (
  SELECT user_id, event_id, epoch_us(CAST(ts AS TIMESTAMP)) AS t,
         row_number() OVER (PARTITION BY user_id ORDER BY epoch_us(CAST(ts AS TIMESTAMP)), event_id) AS rn
  FROM events),
r AS (
  SELECT user_id, rn, event_id, TRUE AS admitted, [t] AS win FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.user_id, e.rn, e.event_id, len({live}) < {limit},
         CASE WHEN len({live}) < {limit} THEN list_append({live}, e.t) ELSE {live} END
  FROM r JOIN ev e ON e.user_id = r.user_id AND e.rn = r.rn + 1)
SELECT event_id, user_id, admitted FROM r"""


@query("rate_limit", _rate_sql(10, 60))
def rate_limit(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return U.rate_limit(e).select("event_id", "user_id", "admitted")


@query("rate_limit_daily", _rate_sql(5, 86400))
def rate_limit_daily(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return U.rate_limit(e, limit=5, window_seconds=86400).select("event_id", "user_id", "admitted")


@query("req_rate_60s", """
SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY epoch_us(CAST(ts AS TIMESTAMP))
       RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW) AS n_window FROM events""")
def req_rate_60s(spark, sf):
    e = table(spark, sf, "events").select("event_id", "user_id", "ts")
    return U.trailing_count(e).select("event_id", "n_window")
