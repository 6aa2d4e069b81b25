"""Per-user rate limit (U1) and trailing request counts.

U1 is a greedy limiter: a request is admitted if fewer than `limit` admitted requests of the same
user fall in (t − window, t]; rejected requests do not count. Admission feeds back, so it is a
sequential fold, not a window count. But a request with at most `limit` requests in its window, itself
included, is admitted whatever happened before; after a window of such requests alone, the state is
known: all of them. A user's time is cut into buckets, and a bucket whose last window holds only such
requests ends a segment. Segments are independent and are folded as sorted streams, never as one
in-memory group per user; the next segment is led in by copies of that last window.

A segment is long only while a user keeps sending more than is admitted. There the fold goes from one
admitted request to the next by binary search, so its steps are bounded by admissions, not requests.

Requests without a user are those of one user, "anonymous"; requests without a time are refused.
"""

from __future__ import annotations

from collections import deque
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import schemas as S


BUCKET_WINDOWS = 60
ANONYMOUS = "anonymous"


def who(user) -> Column:
    """The limiter's user of a request: its id as text."""
    return F.coalesce(F.col(user).cast("string"), F.lit(ANONYMOUS))


def admit(times: np.ndarray, kept: deque, limit: int, window_us: int) -> list[int]:
    """Places of the admitted among sorted `times`; `kept`, the last admitted times (at most `limit`), moves on."""
    out, i, n = [], 0, len(times)
    while i < n:
        if len(kept) < limit or kept[0] <= times[i] - window_us:
            if len(kept) == limit:
                kept.popleft()
            kept.append(int(times[i]))
            out.append(i)
            i += 1
        else:  # nothing is admitted before the oldest leaves the window
            i = int(np.searchsorted(times, kept[0] + window_us))
    return out


def _fold_stream(limit: int, window_us: int):
    """Rows sorted by (user, segment, time) in, own rows with `admitted` out; state carries across batches."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        cur, kept = None, deque()
        for b in batches:
            if not b.num_rows:
                continue
            u, seg, t = b.column("_u"), b.column("_s"), b.column("_t").to_numpy()
            new = pc.or_(pc.not_equal(u[1:], u[:-1]), pc.not_equal(seg[1:], seg[:-1])).to_numpy(zero_copy_only=False)
            starts = [0, *(np.flatnonzero(new) + 1).tolist(), b.num_rows]
            admitted = np.zeros(b.num_rows, bool)
            for a, z in zip(starts, starts[1:]):
                key = (u[a].as_py(), seg[a].as_py())
                if key != cur:
                    cur, kept = key, deque()
                admitted[[a + k for k in admit(t[a:z], kept, limit, window_us)]] = True
            keep = [x for x in b.schema.names if x not in ("_s", "_own")]
            out = pa.RecordBatch.from_arrays([*(b.column(x) for x in keep), pa.array(admitted)], names=[*keep, "admitted"])
            yield out.filter(b.column("_own"))
    return run


def _led_in(r: DataFrame, window_us: int, width: int) -> DataFrame:
    """Rows (_t) with their bucket `_b`; rows of a bucket's last window stand in the next bucket too, not `_own`."""
    bucket = F.floor(F.col("_t") / width)
    near_end = F.floor((F.col("_t") + window_us) / width) > bucket
    places = F.when(near_end, F.array(bucket, bucket + 1)).otherwise(F.array(bucket))
    return r.withColumn("_b", F.explode(places)).withColumn("_own", F.col("_b") == F.floor(F.col("_t") / width))


def segments(r: DataFrame, limit: int, window_us: int, width: int) -> DataFrame:
    """Rows (_id, _u, _t) with the segment `_s` they are folded in, led in by the last window before it.

    Row-level windows are partitioned by (user, bucket); only one row per (user, bucket) takes part in
    the per-user pass that joins buckets into segments.
    """
    r = _led_in(r, window_us, width)
    back = F.lag("_t", limit).over(Window.partitionBy("_u", "_b").orderBy("_t", "_id"))
    open_end = F.col("_own") & (F.col("_t") - back < window_us) & (F.col("_t") + window_us >= (F.col("_b") + 1) * width)
    marked = r.withColumn("_open", F.coalesce(open_end, F.lit(False)))
    per = marked.groupBy("_u", "_b").agg(F.max("_open").alias("_open"), F.max("_own").alias("_any"))
    by_user = Window.partitionBy("_u").orderBy("_b")
    joined = F.coalesce(F.lag("_open").over(by_user) & (F.lag("_b").over(by_user) == F.col("_b") - 1), F.lit(False))
    per = per.filter("_any").withColumn("_joined", joined)
    start = F.last(F.when(~F.col("_joined"), F.col("_b")), ignorenulls=True).over(by_user)
    per = per.select("_u", "_b", "_joined", start.alias("_s"))
    # a bucket without rows of its own is not there any more; within a segment the state itself leads on
    return marked.drop("_open").join(per, ["_u", "_b"]).filter("_own or not _joined").drop("_joined", "_b")


def rate_limit(requests: DataFrame, user: str = "user_id", ts: str = "ts", key: str = "event_id",
               limit: int = S.RATE_LIMIT_REQUESTS, window_seconds: int = S.RATE_LIMIT_WINDOW_SECONDS,
               buckets: int | None = None, bucket_seconds: int | None = None) -> DataFrame:
    """U1 (batch): adds `admitted` and `refused` (why not: over_limit, no_time) to every request.

    Segments (see `segments`) are hashed into `buckets` partitions (whole segments stay together),
    each sorted by (user, segment, time) and folded as a stream, so memory per task is one Arrow
    batch plus at most `limit` timestamps. A bucket is `BUCKET_WINDOWS` windows, or `bucket_seconds` (a window at least).
    """
    window_us = window_seconds * 1_000_000
    width = BUCKET_WINDOWS * window_us if bucket_seconds is None else max(bucket_seconds * 1_000_000, window_us)
    n = buckets or int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    # request columns ride along through the fold, so no join back to the requests is needed
    r = requests.withColumns({"_id": F.col(key), "_u": who(user), "_t": F.unix_micros(F.col(ts).cast("timestamp"))})
    timed = segments(r.filter("_t is not null"), limit, window_us, width)
    timed = timed.repartition(n, "_u", "_s").sortWithinPartitions("_u", "_s", "_t", "_id")
    out_schema = T.StructType([f for f in timed.schema.fields if f.name not in ("_s", "_own")]
                              + [T.StructField("admitted", T.BooleanType())])
    decided = timed.mapInArrow(_fold_stream(limit, window_us), out_schema).withColumn(
        "refused", F.when(~F.col("admitted"), F.lit("over_limit")))
    untimed = r.filter("_t is null").withColumns({"admitted": F.lit(False), "refused": F.lit("no_time")})
    return decided.unionByName(untimed).drop("_id", "_u", "_t")


def trailing_count(requests: DataFrame, user: str = "user_id", ts: str = "ts",
                   window_seconds: int = S.RATE_LIMIT_WINDOW_SECONDS) -> DataFrame:
    """Requests of the same user in (t − window, t] (range frame on microseconds).

    A user's time is cut into buckets of `BUCKET_WINDOWS` windows; each row also stands, uncounted for
    itself, in the bucket after its own if a request there can still see it. So a hot user is spread
    over its buckets. Requests without a user count as one user's; without a time the count is null.
    """
    window_us = window_seconds * 1_000_000
    timed = requests.withColumns({"_u": who(user), "_t": F.unix_micros(F.col(ts).cast("timestamp"))})
    rows = _led_in(timed.filter("_t is not null"), window_us, BUCKET_WINDOWS * window_us)
    w = Window.partitionBy("_u", "_b").orderBy("_t").rangeBetween(-(window_us - 1), 0)
    counted = rows.withColumn("n_window", F.count(F.lit(1)).over(w)).filter("_own").drop("_own", "_b")
    untimed = timed.filter("_t is null").withColumn("n_window", F.lit(None).cast("long"))
    return counted.unionByName(untimed).drop("_u", "_t")
