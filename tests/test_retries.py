"""Retries wait for their due time; errors that no retry mends do not."""
import time
from datetime import datetime, timedelta, timezone


from feedlens.operators import generate as G
from feedlens.streaming import jobs as ST

T0 = datetime(2024, 1, 1)
ATTEMPT = "run_id string, step string, provider string, attempt int, success boolean, error_kind string, failed_at timestamp"


def test_waits_double_between_their_bounds():
    assert [G.wait_seconds(a) for a in range(1, 8)] == [4, 4, 8, 16, 30, 30, 30]


def test_due_times(spark):
    rows = [(f"r{a}", "extract", "google", a, False, "TimeoutError", T0) for a in range(1, 7)]
    rows += [("bad", "extract", "google", 1, False, "ValueError", T0), ("ok", "extract", "google", 1, True, None, T0)]
    got = {r.run_id: r.due_at - T0 for r in G.retry_due(spark.createDataFrame(rows, ATTEMPT), max_attempts=7).collect()}
    assert got == {f"r{a}": timedelta(seconds=G.wait_seconds(a)) for a in range(1, 7)}


def test_release_times_keep_the_pace():
    at, free = ST.release_times([100, 100, 100, 900], 0, 50)
    assert (at, free) == ([100, 150, 200, 900], 950)
    assert ST.release_times([100], 500, 50) == ([500], 550)
    assert ST.release_times([], 7, 50) == ([], 7)


def test_stream_waits(spark):
    """On a running stream with waits of two seconds: retries leave when due and paced, the rest at once."""
    path, out, ck = (ST.scratch(spark, n) for n in ("failed", "retries", "ck"))
    start = datetime.now(timezone.utc)
    rows = [(f"r{k}", "extract", "google", 1, False, "TimeoutError", start) for k in range(6)]
    rows += [("v", "extract", "google", 1, False, "ValueError", start), ("last", "extract", "openai", 2, False, "TimeoutError", start),
             ("o", "extract", None, 1, False, None, start)]
    df = spark.createDataFrame(rows, ATTEMPT)
    df.write.mode("append").parquet(path)
    src = spark.readStream.schema(df.schema).parquet(path)
    with ST.rocksdb_state(spark):
        q = (ST.retry_stream(src, per_second=5, wait=lambda a: 2).writeStream.outputMode("append").format("parquet")
             .option("path", out).option("checkpointLocation", ck).trigger(processingTime="500 milliseconds").start())
        try:
            end = time.time() + 90
            while time.time() < end:
                time.sleep(2)
                if q.lastProgress and spark.read.schema(ST.RETRIES).parquet(out).count() >= 9:
                    break
        finally:
            q.stop()
    got = {r.run_id: r for r in spark.read.parquet(out).collect()}
    assert len(got) == 9
    assert {i for i, r in got.items() if r.state == "given_up"} == {"v", "last"}
    failed = int(start.timestamp() * 1000)
    for i, r in got.items():
        if r.state == "retry":
            assert r.attempt == 2 and r.due_ms == failed + 2000 and r.released_ms >= r.due_ms
    assert got["o"].provider == "unknown"
