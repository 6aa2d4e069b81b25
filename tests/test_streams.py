"""Stream = batch: the streaming forms give the same answers as the batch forms on the same data."""

import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as E
from feedlens.operators import history as Hs
from feedlens.operators import metrics as MT
from feedlens.operators import ratelimit as U
from feedlens.sources import fixtures as FX
from feedlens.sources.tables import table
from feedlens.streaming import jobs as ST


def _rows(df, cols):
    return sorted(tuple(r[c] for c in cols) for r in df.select(*cols).collect())


def test_stream_windows_equals_batch(spark, sf_dir):
    s = E.queries()["stream_windows"](spark, sf_dir)
    ev = table(spark, sf_dir, "events").withColumn("ts", F.col("ts").cast("timestamp"))
    b = ev.groupBy(F.window("ts", "5 minutes").start.alias("window_start"), "event_type") \
        .agg(F.count(F.lit(1)).alias("n"))
    assert _rows(s, ["window_start", "event_type", "n"]) == _rows(b, ["window_start", "event_type", "n"])


def test_stream_rate_limit_equals_batch(spark, sf_dir):
    s = E.queries()["stream_rate_limit"](spark, sf_dir)
    b = U.rate_limit(table(spark, sf_dir, "events").select("event_id", "user_id", "ts"))
    assert _rows(s, ["event_id", "admitted"]) == _rows(b, ["event_id", "admitted"])


def test_sums_do_not_depend_on_partitioning(spark, sf_dir):
    r = FX.fx_runs(spark, sf_dir)
    a = Hs.summary(r.repartition(1), "2024-01-01", "2024-02-01").first()
    b = Hs.summary(r.repartition(7, "user_id"), "2024-01-01", "2024-02-01").first()
    assert a == b
    h1 = MT.histogram(r.coalesce(1), ["provider"], "cost_usd", [0.001, 0.01], "c")
    h2 = MT.histogram(r.repartition(5), ["provider"], "cost_usd", [0.001, 0.01], "c")
    cols = ["metric", "provider", "le", "value"]
    assert _rows(h1, cols) == _rows(h2, cols)


T0 = datetime(2024, 1, 1)
REQUEST = "request_id string, cache_key string, requested_at timestamp"


def _feed(spark, batches, schema=REQUEST):
    """A source of one micro-batch per list of rows."""
    path = ST.scratch(spark, "feed")
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(path)
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(path)


def _run(spark, stream):
    out = ST.scratch(spark, "out")
    with ST.rocksdb_state(spark):
        q = ST.run_append_to_parquet(stream, out, ST.scratch(spark, "ck"))
    return spark.read.parquet(out).collect(), q


def _row(name, key, minutes):
    return (name, key, T0 + timedelta(minutes=minutes))


BEAT = (None, None, T0 + timedelta(days=30))  # going traffic, which lets the watermark pass what is before it


def test_requests_are_decided_in_event_time_order(spark):
    """A request that comes after a later one, but before the watermark, is decided as if it had come in time."""
    batches = [[_row("b", "k", 60)], [_row("a", "k", 55)], [_row("c", "k", 114)], [_row("d", "k", 116)], [BEAT]]
    rows, _ = _run(spark, ST.cache_stream(_feed(spark, batches)))
    assert {r.request_id: (r.hit, r.late) for r in rows if r.request_id} == {
        "a": (False, False), "b": (True, False), "c": (True, False), "d": (False, False)}


def test_late_requests_come_out_marked(spark):
    batches = [[_row("a", "k", 0)], [_row("b", "k", 300)], [_row("c", "k", 301)], [_row("late", "k", 10)], [BEAT]]
    rows, _ = _run(spark, ST.cache_stream(_feed(spark, batches)))
    assert {r.request_id: (r.hit, r.late) for r in rows if r.request_id} == {
        "a": (False, False), "b": (False, False), "c": (True, False), "late": (False, True)}


def test_state_is_dropped_after_its_life(spark):
    batches = [[_row(str(i), f"k{i}", i % 5) for i in range(50)]] + [[_row(f"x{h}", "x", 60 * h)] for h in (5, 10, 15, 20)]
    rows, q = _run(spark, ST.cache_stream(_feed(spark, [*batches, [BEAT]])))
    assert len([r for r in rows if r.request_id]) == 54
    held = [op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]]
    assert max(held) >= 50 and held[-1] < 12


RATED = "event_id long, user_id long, ts timestamp"


@pytest.mark.parametrize("parts", [1, 4, 16])
def test_any_split_into_micro_batches_gives_the_batch_decisions(spark, parts):
    """Rows in disorder within the watermark's delay: the same decisions for 1, 4 and 16 micro-batches."""
    rng = random.Random(7)
    rows, t = [], 0.0
    for i in range(400):
        t += rng.choice([0, 0.5, 3, 3, 20, 90])
        rows.append((i, rng.choice([1, 2, None]), T0 + timedelta(seconds=t)))
    arrival = sorted(rows, key=lambda r: (r[2] + timedelta(seconds=rng.uniform(0, 500)), r[0]))
    size = -(-len(rows) // parts)
    batches = [arrival[k:k + size] for k in range(0, len(rows), size)]
    got, _ = _run(spark, ST.rate_limit_stream(_feed(spark, [*batches, [BEAT]], RATED)))
    want = U.rate_limit(spark.createDataFrame(rows, RATED)).collect()
    assert not any(r.late for r in got)
    assert {r.event_id: r.admitted for r in got if r.event_id is not None} == {r.event_id: r.admitted for r in want}
    assert len([r for r in got if r.event_id is not None]) == 400


FAILED = "n long, ts timestamp"


def _failures(seed=3):
    """Hours with none to three failures each, some of them silent."""
    rng = random.Random(seed)
    times = [T0 + timedelta(hours=h, minutes=rng.uniform(0, 59)) for h in range(40) for _ in range(rng.choice([0, 0, 1, 2, 3, 3]))]
    return sorted((k, t) for k, t in enumerate(times))


def _want_changes(spark, rows):
    counts = spark.createDataFrame(rows, FAILED).groupBy(F.window("ts", "1 hour").start.alias("window_start")).agg(
        F.count(F.lit(1)).alias("n"))
    on, hour = {r.window_start for r in MT.alarm(counts, 3600, threshold=1).collect()}, timedelta(hours=1)
    return sorted([("ALARM", w) for w in on if w - hour not in on] + [("OK", w + hour) for w in on if w + hour not in on])


def test_live_alarm_equals_the_batch_alarm(spark):
    rows = _failures()
    want = _want_changes(spark, rows)
    assert len(want) >= 4
    size = -(-len(rows) // 4)
    batches = [rows[k:k + size] for k in range(0, len(rows), size)]
    got, _ = _run(spark, ST.alarm_stream(_feed(spark, [*batches, [(None, BEAT[2])]], FAILED), 3600, threshold=1))
    assert sorted((r.state, r.since) for r in got) == want


def test_live_alarm_goes_on_after_a_restart(spark):
    """The stream is stopped after two micro-batches and started anew from its checkpoint: no change twice, none lost."""
    rows = _failures(5)
    path, out, ck = (ST.scratch(spark, n) for n in ("feed", "out", "ck"))
    half = len(rows) // 2
    for part in (rows[:half // 2], rows[half // 2:half]), (rows[half:], [(None, BEAT[2])]):
        for batch in part:
            spark.createDataFrame(batch, FAILED).coalesce(1).write.mode("append").parquet(path)
        src = spark.readStream.schema(FAILED).option("maxFilesPerTrigger", 1).parquet(path)
        with ST.rocksdb_state(spark):
            ST.run_append_to_parquet(ST.alarm_stream(src, 3600, threshold=1), out, ck)
    assert sorted((r.state, r.since) for r in spark.read.parquet(out).collect()) == _want_changes(spark, rows)


def test_slices_are_written_by_many_tasks(spark):
    rows = spark.range(4000).select(F.col("id"), F.timestamp_seconds("id").alias("ts"))
    path = ST.scratch(spark, "slices")
    ST.stage_slices(rows, "ts", path, slices=3, files=5, beat_seconds=60)
    back = spark.read.parquet(path)
    assert back.count() == 4001 and len(back.inputFiles()) == 16
    assert back.filter("id is null").first().ts == datetime(1970, 1, 1, 1, 7, 39)


def test_rows_behind_the_watermark_are_dropped(spark):
    src = _feed(spark, [[_row("a", "k", 0)], [_row("b", "k", 300)], [_row("c", "k", 400)], [_row("late", "k", 10)]])
    agg = ST.windowed_counts(src, ts="requested_at")
    out, ck = ST.scratch(spark, "out"), ST.scratch(spark, "ck")
    ST.run_update_to_parquet(agg, out, ck)
    got = ST.latest_rows(spark, out, ["window_start"]).collect()
    assert sorted(r.window_start for r in got) == [T0, T0 + timedelta(minutes=300), T0 + timedelta(minutes=400)]


def test_keys_of_a_bucket_share_one_state(spark):
    """State is read and written by bucket: many keys with one request each are few entries, decided as ever."""
    batches = [[_row(f"{i}-{m}", f"k{i}", m) for i in range(50)] for m in (0, 30, 90)]
    rows, q = _run(spark, ST.cache_stream(_feed(spark, [*batches, [BEAT]]), buckets=4))
    assert {r.request_id: r.hit for r in rows if r.request_id} == {
        f"{i}-{m}": m == 30 for i in range(50) for m in (0, 30, 90)}
    assert max(op["numRowsTotal"] for p in q.recentProgress for op in p["stateOperators"]) <= 12
