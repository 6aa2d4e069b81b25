"""The segmented limiter against a plain sequential fold; no request is lost."""
import random
from collections import defaultdict
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from feedlens.operators import ratelimit as U

T0 = datetime(2024, 1, 1)
SCHEMA = "event_id long, user_id double, ts timestamp, note string"


def plain(rows, limit, window):
    """{event_id: admitted} by going through each user's requests in time order."""
    times, out = defaultdict(list), {}
    for i, u, t, _ in sorted((r for r in rows if r[2] is not None), key=lambda r: (r[2], r[0])):
        u = "anonymous" if u is None else str(u)
        times[u] = [x for x in times[u] if x > t - timedelta(seconds=window)]
        out[i] = len(times[u]) < limit
        if out[i]:
            times[u].append(t)
    return out | {r[0]: False for r in rows if r[2] is None}


def requests(seed):
    """Users with quiet, steady and crowded stretches, equal times, and requests without user or time."""
    rng, rows, n = random.Random(seed), [], 0
    for u in (1.0, 2.0, None, float("nan"), 5.0):
        t = rng.uniform(0, 50)
        for _ in range(12):
            gap, count = rng.choice([(0.0, 8), (0.5, 60), (3, 50), (7, 60), (2, 20), (40, 10), (400, 3)])
            for _ in range(count):
                t += round(rng.expovariate(1 / gap), 3) if gap else 0
                n += 1
                rows.append((n, u, T0 + timedelta(seconds=t), None))
    rows += [(n + k, None if k % 2 else 1.0, None, "x") for k in range(1, 5)]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed, limit, window, bucket_windows", [(1, 10, 60, 1), (2, 10, 60, 2), (3, 3, 20, 5), (4, 1, 60, 60)])
def test_equals_the_sequential_fold(spark, seed, limit, window, bucket_windows):
    rows = requests(seed)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    got = U.rate_limit(df, limit=limit, window_seconds=window, bucket_seconds=bucket_windows * window).collect()
    assert {r.event_id: r.admitted for r in got} == plain(rows, limit, window)
    assert len(got) == len(rows)
    assert all((r.refused is None) == r.admitted for r in got)
    assert {r.refused for r in got if r.ts is None} == {"no_time"}
    assert all(r.note == "x" for r in got if r.ts is None)


def test_steady_requests_are_cut_into_many_segments(spark):
    """One user who never goes over the limit: every bucket is its own segment, so all tasks take part."""
    df = spark.range(20_000).select(F.col("id").alias("_id"), F.lit("u").alias("_u"), (F.col("id") * 6_000_001).alias("_t"))
    w = 60_000_000
    cut = U.segments(df, 10, w, 60 * w).filter("_own")
    assert cut.select("_s").distinct().count() == cut.select(F.floor(F.col("_t") / (60 * w))).distinct().count() == 34
    crowded = df.withColumn("_t", F.col("_id") * 1_000_000)  # ten times what is admitted: one stretch, one segment
    assert U.segments(crowded, 10, w, 60 * w).filter("_own").select("_s").distinct().count() == 1


def test_crowded_fold_takes_steps_by_admissions():
    from collections import deque

    import numpy as np
    t = np.arange(0, 600_000_000, 100)  # 6 million requests in ten minutes
    kept = deque()
    got = U.admit(t, kept, 10, 60_000_000)
    assert len(got) == 100 and t[got[10]] == 60_000_000
    halves, kept = [], deque()
    for a in range(0, len(t), 777_777):
        halves += [a + k for k in U.admit(t[a:a + 777_777], kept, 10, 60_000_000)]
    assert halves == got


def test_trailing_count_keeps_every_request(spark):
    rows = requests(5)
    got = U.trailing_count(spark.createDataFrame(rows, SCHEMA)).collect()
    assert len(got) == len(rows)
    by = defaultdict(list)
    for _, u, t, _ in rows:
        by["anonymous" if u is None else str(u)].append(t)
    for r in got:
        u = "anonymous" if r.user_id is None else str(r.user_id)
        want = None if r.ts is None else sum(
            t is not None and r.ts - timedelta(seconds=60) < t <= r.ts for t in by[u])
        assert r.n_window == want
