"""Streaming queries (L5, H9), run to completion with availableNow and read back."""

from __future__ import annotations

from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S
from ..operators import cache as H
from ..sources import fixtures as FX
from ..sources.tables import table
from ..streaming import jobs as ST
from .catalog import query
from .q_limits import _rate_sql
from .q_metrics import _alarm_sql

EVENTS = T.StructType([T.StructField("event_id", T.LongType()), T.StructField("ts", T.TimestampNTZType()),
                       T.StructField("user_id", T.LongType()), T.StructField("event_type", T.StringType()),
                       T.StructField("value", T.DoubleType()), T.StructField("props", T.StringType())])


def _events(spark, sf, late_seconds=0, beat_seconds=None):
    """The events as a stream of four micro-batches, some rows coming late by up to `late_seconds`."""
    staged = ST.scratch(spark, "stream-events")
    ST.stage_slices(table(spark, sf, "events"), "ts", staged, late_seconds=late_seconds, beat_seconds=beat_seconds)
    return spark.readStream.schema(EVENTS).option("maxFilesPerTrigger", ST.FILES).parquet(staged)


@query("stream_windows", """
SELECT make_timestamp((epoch_us(ts) // 300000000) * 300000000) AS window_start, event_type, count(*) AS n
FROM events GROUP BY ALL""")
def stream_windows(spark, sf):
    src = _events(spark, sf, late_seconds=1800).withColumn("ts", F.col("ts").cast("timestamp"))
    agg = ST.windowed_counts(src, delay="1 hour", keys=("event_type",))
    out, ck = ST.scratch(spark, "stream-windows-out"), ST.scratch(spark, "stream-windows-ck")
    ST.run_update_to_parquet(agg, out, ck)
    return ST.latest_rows(spark, out, ["window_start", "event_type"])


def _dedupe_sql(ttl_s: int) -> str:
    w = ttl_s * 1_000_000
    return f"""
WITH RECURSIVE ev AS (
  SELECT request_id, 'workflow:result:' || sha256(content || ':google:gemini-2.5-flash-lite') AS k,
         epoch_us(requested_at) AS t,
         row_number() OVER (PARTITION BY 'workflow:result:' || sha256(content || ':google:gemini-2.5-flash-lite')
                            ORDER BY epoch_us(requested_at), request_id) AS rn
  FROM fx_feedback),
r AS (
  SELECT k, rn, request_id, FALSE AS hit, t AS written FROM ev WHERE rn = 1
  UNION ALL
  SELECT e.k, e.rn, e.request_id, e.t < r.written + {w},
         CASE WHEN e.t < r.written + {w} THEN r.written ELSE e.t END
  FROM r JOIN ev e ON e.k = r.k AND e.rn = r.rn + 1)
SELECT request_id, hit FROM r"""


@query("stream_dedupe", _dedupe_sql(S.CACHE_TTL_SECONDS))
def stream_dedupe(spark, sf):
    f = FX.fx_feedback(spark, sf).withColumn("provider", F.lit(S.DEFAULT_PROVIDER)) \
        .withColumn("model", F.lit(S.DEFAULT_MODEL))
    req = H.with_cache_key(f).select("request_id", "cache_key", "requested_at")
    staged = ST.scratch(spark, "stream-dedupe-in")
    ST.stage_slices(req, "requested_at", staged, late_seconds=300, beat_seconds=86_400)
    src = spark.readStream.schema(req.schema).option("maxFilesPerTrigger", ST.FILES).parquet(staged)
    out, ck = ST.scratch(spark, "stream-dedupe-out"), ST.scratch(spark, "stream-dedupe-ck")
    with ST.rocksdb_state(spark):
        ST.run_append_to_parquet(ST.cache_stream(src), out, ck)
    return spark.read.parquet(out).filter("request_id is not null").select("request_id", "hit")


@query("stream_rate_limit", _rate_sql(10, 60))
def stream_rate_limit(spark, sf):
    src = _events(spark, sf, late_seconds=300, beat_seconds=86_400)
    out, ck = ST.scratch(spark, "stream-rate-out"), ST.scratch(spark, "stream-rate-ck")
    with ST.rocksdb_state(spark):
        ST.run_append_to_parquet(ST.rate_limit_stream(src), out, ck)
    got = spark.read.parquet(out).filter("event_id is not null").select("event_id", "admitted")
    return got.join(table(spark, sf, "events").select("event_id", "user_id"), "event_id")


def _failures(events):
    """The failures of the runs that raised, at the time they are logged: start + value/10 seconds."""
    raised = events.filter((F.col("event_type") == "error") & FX.run_raises(F.col("event_id")))
    return raised.withColumn("ts", F.timestamp_micros(F.unix_micros(FX.run_start(F.col("event_id"), F.col("ts")))
                                                      + F.round(F.col("value") * 100000).cast("long")))


def _changes_sql(period_s: int) -> str:
    step = f"INTERVAL {period_s} SECOND"
    return f"""
WITH a AS (SELECT window_start AS w FROM ({_alarm_sql(period_s).replace("n > 5", "n > 1")}))
SELECT 'alarm' AS name, 'ALARM' AS state, w AS since FROM a WHERE w - {step} NOT IN (SELECT w FROM a)
UNION ALL SELECT 'alarm', 'OK', w + {step} FROM a WHERE w + {step} NOT IN (SELECT w FROM a)"""


@query("stream_alarm_changes", _changes_sql(3600))
def stream_alarm_changes(spark, sf):
    """L4 live: when the alarm goes on and off, from closed hours of the stream and a two-period state."""
    staged = ST.scratch(spark, "stream-failures")
    rows = _failures(table(spark, sf, "events")).select("event_id", "ts")
    ST.stage_slices(rows, "ts", staged, late_seconds=1800, beat_seconds=10 * 86_400)
    src = spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", ST.FILES).parquet(staged)
    out, ck = ST.scratch(spark, "stream-changes-out"), ST.scratch(spark, "stream-changes-ck")
    with ST.rocksdb_state(spark):
        ST.run_append_to_parquet(ST.alarm_stream(src, 3600, threshold=1, delay="1 hour"), out, ck)
    return spark.read.parquet(out)


@query("stream_alarm", _alarm_sql(3600).replace("n > 5", "n > 1"))
def stream_alarm(spark, sf):
    """L5, then L4 as a batch over the stream's sink: failure counts per hour, then the two-period alarm."""
    from ..operators import metrics as MT
    src = _failures(_events(spark, sf, late_seconds=1800))
    agg = ST.windowed_counts(src, period="1 hour", delay="1 hour")
    out, ck = ST.scratch(spark, "stream-alarm-out"), ST.scratch(spark, "stream-alarm-ck")
    ST.run_update_to_parquet(agg, out, ck)
    return MT.alarm(ST.latest_rows(spark, out, ["window_start"]), 3600, threshold=1)
