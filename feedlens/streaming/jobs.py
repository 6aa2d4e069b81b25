"""Structured Streaming forms of the live behaviours: windowed log counts (L5), the live alarm (L4), the
stream-side cache with TTL (H9) and the rate limiter (U1).

Both run with `trigger(availableNow=True)` in checks, and continuously in production. Sinks and
checkpoints live under the session's shared `spark.checkpoint.dir`, so a restarted driver or lost
executor resumes from the checkpoint instead of recomputing.
"""

from __future__ import annotations

import uuid
from collections import deque
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import schemas as S
from ..operators.generate import wait_seconds
from ..operators.ratelimit import admit, who
from ..session import checkpoint_dir


def scratch(spark: SparkSession, name: str) -> str:
    """A fresh folder under the shared checkpoint dir."""
    return f"{checkpoint_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex[:12]}"


#: Files of a slice, written by as many tasks and read by as many; a trigger takes them all.
FILES = 4


def stage_slices(df: DataFrame, ts: str, path: str, slices: int = 4, late_seconds: int = 0, files: int = FILES,
                 beat_seconds: int | None = None) -> None:
    """Write `df` as successive time slices of `files` files each, for a source that takes as many a trigger.

    Every second row of the last `late_seconds` of a slice comes with the next one, late and out of order.
    With `beat_seconds` a last slice follows: one row without values but for a time that many seconds on, which
    lets the watermark pass all rows before it, as going traffic would.
    """
    t = F.unix_micros(F.col(ts).cast("timestamp"))
    edge = df.agg(F.min(t).alias("a"), F.max(t).alias("b")).first()
    width = (edge["b"] - edge["a"]) // slices + 1
    nth = F.floor((t - edge["a"]) / width)
    late = ((t - edge["a"]) % width >= width - late_seconds * 1_000_000) & (F.pmod(F.xxhash64(t), F.lit(2)) == 0)
    nth = F.least(F.when(late, nth + 1).otherwise(nth), F.lit(slices - 1))
    for k in range(slices):
        df.filter(nth == k).repartition(files, F.xxhash64(*df.columns)).write.mode("append").parquet(path)
    if beat_seconds is not None:
        at = F.timestamp_micros(F.lit(edge["b"] + beat_seconds * 1_000_000)).cast(df.schema[ts].dataType)
        beat = df.sparkSession.range(0, 1, 1, 1).select(*(
            at.alias(f.name) if f.name == ts else F.lit(None).cast(f.dataType).alias(f.name) for f in df.schema))
        beat.write.mode("append").parquet(path)


def windowed_counts(stream: DataFrame, period: str = "5 minutes", delay: str = "10 minutes",
                    ts: str = "ts", keys: tuple[str, ...] = ()) -> DataFrame:
    """Tumbling counts with a watermark; rows later than the watermark are dropped.

    The grouping key is the window itself: only then does the watermark evict old windows' state.
    """
    counts = stream.withWatermark(ts, delay).groupBy(F.window(ts, period), *keys).agg(F.count(F.lit(1)).alias("n"))
    return counts.select(F.col("window.start").alias("window_start"), *keys, "n")


def run_update_to_parquet(agg: DataFrame, out: str, checkpoint: str, available_now: bool = True):
    """Update-mode stream → append each batch's changed rows with its batch id (latest wins on read)."""
    def sink(df: DataFrame, batch_id: int) -> None:
        df.withColumn("_batch", F.lit(batch_id)).write.mode("append").parquet(out)

    w = agg.writeStream.outputMode("update").foreachBatch(sink).option("checkpointLocation", checkpoint)
    q = (w.trigger(availableNow=True) if available_now else w).start()
    if available_now:
        q.awaitTermination()
    return q


def latest_rows(spark: SparkSession, out: str, keys: list[str]) -> DataFrame:
    from pyspark.sql import Window
    d = spark.read.parquet(out)
    w = Window.partitionBy(*keys).orderBy(F.col("_batch").desc())
    return d.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn", "_batch")


def run_append_to_parquet(df: DataFrame, out: str, checkpoint: str):
    q = (df.writeStream.outputMode("append").format("parquet").option("path", out)
         .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
    q.awaitTermination()
    return q


# --- Keyed folds in event-time order, whatever the micro-batches ------------------------------

ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


@contextmanager
def rocksdb_state(spark: SparkSession):
    """Run queries with the RocksDB state store, then restore the session's own setting."""
    key = "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(key)
    spark.conf.set(key, ROCKSDB)
    try:
        yield
    finally:
        spark.conf.set(key, was)



FOLDED = "id string, ts_us long, decision boolean, late boolean"
#: Step of event time at which requests are decided.
PIECE_SECONDS = 60
#: Event time of one entry of the reorder buffer: what is held in memory of a bucket at once.
SPAN_SECONDS = 7 * 86_400
#: Buckets that the keys are dealt into by hash; each is one group of the state.
BUCKETS = 4096


def _ordered_fold(column: str, step, life_us: int, piece_us: int, span_us: int):
    """A state processor that buffers a bucket's rows by time span and folds them once the watermark has passed them.

    `step(memory, times)` gives a key's new memory (sorted times) and a decision for each of the sorted times. A row
    is passed when its piece is; spans are folded in time order. A row whose piece is already past when it comes is
    `late`, undecided. A key's memory is dropped `life_us` after its last time. Calls of the state are a few for
    a bucket and span, however many keys and rows it has.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

    strings, longs = ArrayType(StringType()), ArrayType(LongType())
    memory_schema = StructType([StructField("keys", strings), StructField("times", ArrayType(longs))])
    span_key = StructType([StructField("span", LongType())])
    span_rows = StructType([StructField("keys", strings), StructField("ids", strings), StructField("times", longs)])

    def ends(times):
        return (times // piece_us + 1) * piece_us

    class Fold(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.memory = handle.getValueState("memory", memory_schema)
            self.spans = handle.getMapState("spans", span_key, span_rows)

        def _wake(self, at_us: int) -> None:
            self.handle.registerTimer(-(-int(at_us) // 1000))

        def _store(self, span: int, keys, ids, times) -> None:
            self.spans.updateValue((span,), (list(keys), list(ids), [int(t) for t in times]))

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            passed, first = timerValues.getCurrentWatermarkInMs() * 1000, None
            for pdf in rows:  # one Arrow batch at a time
                pdf = pdf[pdf["ts_us"].notna()]
                late = ends(pdf["ts_us"]) <= passed
                if late.any():
                    out = pdf.loc[late, ["id", "ts_us"]].copy()
                    out["decision"], out["late"] = False, True
                    yield out
                pdf = pdf[~late]
                for span, part in pdf.groupby(pdf["ts_us"] // span_us):
                    at = (int(span),)
                    held = self.spans.getValue(at) if self.spans.containsKey(at) else ([], [], [])
                    self._store(at[0], [*held[0], *part[column]], [*held[1], *part["id"]], [*held[2], *part["ts_us"]])
                    soonest = int(ends(part["ts_us"]).min())
                    first = soonest if first is None else min(first, soonest)
            if first is not None:
                self._wake(first)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            passed = timerValues.getCurrentWatermarkInMs() * 1000
            kept = self.memory.get() if self.memory.exists() else ([], [])
            memory = dict(zip(kept[0], kept[1]))
            for span in sorted(k[0] for k in self.spans.keys()):
                if span * span_us + piece_us > passed:
                    self._wake(span * span_us + piece_us)
                    break
                keys, ids, times = self.spans.getValue((span,))
                keys, ids = np.array(keys, object), np.array(ids, object)
                times = np.array(times, np.int64)
                due = ends(times) <= passed
                if due.any():
                    yield self._fold(memory, keys[due], ids[due], times[due])
                if due.all():
                    self.spans.removeKey((span,))
                else:
                    if due.any():
                        self._store(span, keys[~due], ids[~due], times[~due])
                    self._wake(ends(times[~due]).min())
                    break
            self._keep(memory, bool(kept[0]), passed // piece_us * piece_us)

        def _fold(self, memory: dict, keys, ids, times) -> pd.DataFrame:
            """Decide rows in the order of key, time and id; `memory` moves on."""
            order = np.lexsort((pd.factorize(ids, sort=True)[0], times, pd.factorize(keys)[0]))
            keys, ids, times = keys[order], ids[order], times[order]
            starts = [0, *(np.flatnonzero(keys[1:] != keys[:-1]) + 1).tolist(), len(keys)]
            decisions = np.zeros(len(keys), bool)
            for a, z in zip(starts, starts[1:]):
                memory[keys[a]], decisions[a:z] = step(list(memory.get(keys[a], [])), times[a:z])
            return pd.DataFrame({"id": ids, "ts_us": times, "decision": decisions, "late": False})

        def _keep(self, memory: dict, had: bool, upto_us: int) -> None:
            """Store the memory of keys that rows after `upto_us` can still see; a timer drops the last of them."""
            alive = {k: [int(t) for t in times] for k, times in memory.items() if times[-1] + life_us > upto_us}
            if alive:
                self.memory.update((list(alive), list(alive.values())))
                last = max(times[-1] for times in alive.values()) + life_us
                self._wake(-(-last // piece_us) * piece_us)
            elif had:
                self.memory.clear()

        def close(self) -> None:
            pass

    return Fold()


def _in_order(rows: DataFrame, key: str, step, life_us: int, delay: str, piece_seconds: int, span_seconds: int,
              buckets: int) -> DataFrame:
    """rows(`key`, id, ts) → FOLDED by a state processor; the watermark follows `ts`, `delay` behind."""
    r = rows.withWatermark("ts", delay).select(F.pmod(F.xxhash64(key), F.lit(buckets)).alias("bucket"), key, "id",
                                               F.unix_micros("ts").alias("ts_us"))
    fold = _ordered_fold(key, step, life_us, piece_seconds * 1_000_000, span_seconds * 1_000_000)
    return r.groupBy("bucket").transformWithStateInPandas(
        statefulProcessor=fold, outputStructType=FOLDED, outputMode="Append", timeMode="EventTime")


def _cache_step(ttl_us: int):
    def step(memory: list[int], times: np.ndarray):
        written = memory[-1] if memory else None
        hits = []
        for now in times.tolist():
            hits.append(written is not None and now < written + ttl_us)
            if not hits[-1]:
                written = now  # a miss computes the result and writes it
        return [written], hits
    return step


def cache_stream(requests: DataFrame, ttl_seconds: int = S.CACHE_TTL_SECONDS, delay: str = "10 minutes",
                 piece_seconds: int = PIECE_SECONDS, span_seconds: int = SPAN_SECONDS, buckets: int = BUCKETS) -> DataFrame:
    """H9: requests(request_id, cache_key, requested_at) → request_id, hit, late; a request within the TTL of
    its key's last computed result is a hit.

    Requests are decided in event-time order once the watermark has passed them, so any split into
    micro-batches gives the same decisions. State is one time a key and the rows still ahead of the watermark;
    a key's time is dropped after its TTL. A request that comes behind the watermark is `late` and no hit: it is
    computed, and does not move the entry. Keys are dealt into `buckets`, whose state is read and written as one;
    a bucket's requests of `span_seconds` are in memory at once. Needs the RocksDB state store provider.
    """
    rows = requests.select("cache_key", F.col("request_id").alias("id"), F.col("requested_at").cast("timestamp").alias("ts"))
    ttl_us = ttl_seconds * 1_000_000
    return _in_order(rows, "cache_key", _cache_step(ttl_us), ttl_us, delay, piece_seconds, span_seconds,
                     buckets).select(
        F.col("id").alias("request_id"), F.col("decision").alias("hit"), "late")


def _rate_step(limit: int, window_us: int):
    def step(memory: list[int], times: np.ndarray):
        kept = deque(memory)
        decisions = np.zeros(len(times), bool)
        decisions[admit(times, kept, limit, window_us)] = True
        return list(kept), decisions
    return step


def rate_limit_stream(requests: DataFrame, limit: int = S.RATE_LIMIT_REQUESTS,
                      window_seconds: int = S.RATE_LIMIT_WINDOW_SECONDS, delay: str = "10 minutes",
                      piece_seconds: int = PIECE_SECONDS, span_seconds: int = SPAN_SECONDS,
                      buckets: int = BUCKETS) -> DataFrame:
    """U1 (stream): requests(event_id, user_id, ts) → event_id, admitted, late.

    Requests are decided in event-time order once the watermark has passed them, so any split into micro-batches
    gives the decisions of the batch job. State per user is at most `limit` times and the rows still ahead of the
    watermark; it is dropped a window after the last admitted request. Requests behind the watermark are `late`
    and not admitted; those without a user are one user's, as in the batch job. Needs the RocksDB state store
    provider (`ROCKSDB`), set before the query starts.
    """
    window_us = window_seconds * 1_000_000
    rows = requests.select(who("user_id").alias("user"), F.col("event_id").cast("string").alias("id"),
                           F.col("ts").cast("timestamp").alias("ts"))
    return _in_order(rows, "user", _rate_step(limit, window_us), window_us, delay, piece_seconds, span_seconds,
                     buckets).select(
        F.col("id").cast("long").alias("event_id"), F.col("decision").alias("admitted"), "late")


# --- L4 live: closed windows feed the alarm's state -------------------------------------------

ALARMED = "name string, state string, since timestamp"


def _alarm_processor(period_us: int, threshold: float, periods: int):
    """Closed windows (start, n) of one alarm in, its changes of state out.

    `periods` successive windows over the threshold raise the alarm, one that is not clears it. Windows without
    events never arrive: the gap before a window, or a timer one period after the last, stands for them.
    """
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import BooleanType, LongType, StructField, StructType

    schema = StructType([StructField("last", LongType()), StructField("run", LongType()), StructField("on", BooleanType())])

    class Alarm(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.state = handle.getValueState("alarm", schema)

        def _rows(self, key, changes):
            return pd.DataFrame({"name": [key[0]] * len(changes), "state": [s for s, _ in changes],
                                 "since": pd.to_datetime([t for _, t in changes], unit="us")})

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            last, run, on = self.state.get() if self.state.exists() else (None, 0, False)
            changes = []
            closed = sorted((int(a), float(n)) for pdf in rows for a, n in zip(pdf["start_us"], pdf["n"]))
            for start, n in closed:  # one row a window
                if last is not None and start > last + period_us:  # silent periods in between
                    run = 0
                    if on:
                        on = False
                        changes.append(("OK", last + period_us))
                run = run + 1 if n > threshold else 0
                if on != (run >= periods):
                    on = not on
                    changes.append(("ALARM" if on else "OK", start))
                last = start
            self.state.update((last, run, on))
            if run:  # the next period is closed, silent or not, when the watermark has passed its end
                self.handle.registerTimer((last + 2 * period_us) // 1000)
            if changes:
                yield self._rows(key, changes)

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            last, run, on = self.state.get()
            if last + 2 * period_us <= expiredTimerInfo.getExpiryTimeInMs() * 1000:  # no window came since
                self.state.update((last, 0, False))
                if on:
                    yield self._rows(key, [("OK", last + period_us)])

        def close(self) -> None:
            pass

    return Alarm()


def alarm_stream(events: DataFrame, period_seconds: int, threshold: float = S.ALARM_THRESHOLD, periods: int = 2,
                 delay: str = "10 minutes", ts: str = "ts", name: str | None = None) -> DataFrame:
    """L4/L5 live: events → (name, state, since), one row each time the alarm is raised (ALARM) or cleared (OK).

    Counts per period leave the first operator when the watermark has closed the period; the second holds the
    last period's outcome. A period without events does not breach.
    """
    named = events.withColumn("name", F.lit("alarm") if name is None else F.col(name))
    counts = named.withWatermark(ts, delay).groupBy(F.window(ts, f"{period_seconds} seconds"), "name").agg(
        F.count(F.lit(1)).alias("n"))
    closed = counts.select("name", "window", F.unix_micros("window.start").alias("start_us"), "n")
    return closed.groupBy("name").transformWithStateInPandas(
        statefulProcessor=_alarm_processor(period_seconds * 1_000_000, threshold, periods),
        outputStructType=ALARMED, outputMode="Append", timeMode="EventTime")


# --- M6 live: failed calls wait for their due time --------------------------------------------

RETRIES = "run_id string, step string, provider string, attempt int, state string, due_ms long, released_ms long"


def release_times(due_ms: list[int], free_ms: int, gap_ms: int) -> tuple[list[int], int]:
    """When calls that are due at `due_ms` (rising) may start, one every `gap_ms`, and when the next one may."""
    out = []
    for due in due_ms:
        out.append(max(due, free_ms))
        free_ms = out[-1] + gap_ms
    return out, free_ms


def _retry_processor(max_attempts: int, gap_ms: int, wait_ms: dict[int, int]):
    """Failed calls of one provider in; each comes out again as `retry` at its time, or as `given_up` at once."""
    from pyspark.sql.streaming.stateful_processor import StatefulProcessor
    from pyspark.sql.types import ArrayType, IntegerType, LongType, StringType, StructField, StructType

    strings, numbers = ArrayType(StringType()), ArrayType(IntegerType())
    waiting_schema = StructType([StructField("runs", strings), StructField("steps", strings),
                                 StructField("attempts", numbers), StructField("dues", ArrayType(LongType()))])

    class Retry(StatefulProcessor):
        def init(self, handle) -> None:
            self.handle = handle
            self.free = handle.getValueState("free", StructType([StructField("ms", LongType())]))
            self.waiting = handle.getMapState("waiting", StructType([StructField("at", LongType())]), waiting_schema)

        def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
            free = self.free.get()[0] if self.free.exists() else 0
            for pdf in rows:
                again = (pdf["attempt"] < max_attempts) & ~pdf["error_kind"].isin(S.NON_RETRYABLE_ERRORS)
                last = pdf[~again]
                if len(last):
                    yield pd.DataFrame({"run_id": last["run_id"], "step": last["step"], "provider": key[0],
                                        "attempt": last["attempt"], "state": "given_up", "due_ms": last["failed_ms"],
                                        "released_ms": timerValues.getCurrentProcessingTimeInMs()})
                calls = sorted((int(t) + wait_ms[int(a)], r, s, int(a)) for t, r, s, a in zip(
                    pdf["failed_ms"][again], pdf["run_id"][again], pdf["step"][again], pdf["attempt"][again]))
                now = timerValues.getCurrentProcessingTimeInMs()
                at, free = release_times([c[0] for c in calls], max(free, now), gap_ms)
                for when, (due, run, step, attempt) in zip(at, calls):
                    held = self.waiting.getValue((when,)) if self.waiting.containsKey((when,)) else ([], [], [], [])
                    self.waiting.updateValue((when,), ([*held[0], run], [*held[1], step], [*held[2], attempt + 1], [*held[3], due]))
                    self.handle.registerTimer(when)
            self.free.update((free,))

        def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
            when = expiredTimerInfo.getExpiryTimeInMs()
            if self.waiting.containsKey((when,)):
                runs, steps, attempts, dues = self.waiting.getValue((when,))
                self.waiting.removeKey((when,))
                yield pd.DataFrame({"run_id": list(runs), "step": list(steps), "provider": key[0], "attempt": list(attempts),
                                    "state": "retry", "due_ms": list(dues),
                                    "released_ms": timerValues.getCurrentProcessingTimeInMs()})

        def close(self) -> None:
            pass

    return Retry()


def retry_stream(failures: DataFrame, per_second: float = 10.0, max_attempts: int = S.MAX_ATTEMPTS,
                 wait=wait_seconds) -> DataFrame:
    """M6 live: failures(run_id, step, provider, attempt, error_kind, failed_at) → calls to make again, when due.

    A call waits 4 to 30 seconds after its failure, doubling (`wait`), and a provider's calls leave at most
    `per_second` a second; errors that no retry mends, and calls without attempts left, come out as `given_up`
    at once. State is the waiting calls of each provider. Needs the RocksDB state store provider.
    """
    waits = {a: int(wait(a) * 1000) for a in range(1, max_attempts)}
    rows = failures.select("run_id", "step", F.coalesce("provider", F.lit("unknown")).alias("provider"),
                           F.col("attempt").cast("int").alias("attempt"), "error_kind",
                           F.unix_millis(F.col("failed_at").cast("timestamp")).alias("failed_ms"))
    return rows.groupBy("provider").transformWithStateInPandas(
        statefulProcessor=_retry_processor(max_attempts, int(1000 / per_second), waits),
        outputStructType=RETRIES, outputMode="Append", timeMode="ProcessingTime")
