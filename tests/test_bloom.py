"""The Bloom filter never loses a key, lets few others through, and thins the cache before any exchange."""
from datetime import datetime, timedelta

import numpy as np
from pyspark.sql import functions as F

from feedlens.functions import bloom
from feedlens.operators import cache as H


def test_no_key_is_lost_and_few_pass(spark):
    keys = spark.range(5000).select(F.concat(F.lit("k"), F.col("id")).alias("k")).repartition(7)
    other = spark.range(20_000).select(F.concat(F.lit("o"), F.col("id")).alias("k"))
    may = bloom.key_filter(keys, "k", bits=1 << 16)
    assert keys.filter(may(F.col("k"))).count() == 5000
    assert other.filter(may(F.col("k"))).count() < 20_000 * 0.05
    none = bloom.key_filter(keys.filter("false"), "k", bits=1 << 16)
    assert keys.filter(none(F.col("k"))).count() == 0
    full = bloom.key_filter(keys, "k", bits=1 << 9)  # far too small: it only lets more through
    assert keys.filter(full(F.col("k"))).count() == 5000


def test_places_are_within_the_field():
    at = bloom.places(np.array([-1, 0, 1 << 62, -(1 << 63)], np.int64), 1 << 12)
    assert at.shape == (bloom.HASHES, 4) and at.max() < 1 << 12


T0 = datetime(2024, 1, 1)


def _tables(spark, entries):
    cache = spark.createDataFrame([(f"k{i % 400}", f'{{"run_id": "{i}"}}', T0 + timedelta(minutes=i % 977)) for i in range(entries)],
                                  "cache_key string, result_json string, written_at timestamp")
    req = spark.createDataFrame([(str(i), f"k{i * 7}", T0 + timedelta(minutes=200 + 11 * i)) for i in range(60)],
                                "request_id string, cache_key string, requested_at timestamp")
    return req, cache


def test_lookup_is_the_same_with_any_filter(spark):
    req, cache = _tables(spark, 4000)
    want = None
    for bits in (1 << 9, 1 << 20):
        got = sorted((r.request_id, r.hit, r.result_json) for r in H.lookup(req, cache, filter_bits=bits).collect())
        assert len(got) == 60
        want = want or got
        assert got == want
    plain = {}
    for r in req.collect():
        live = [(e.written_at, e.result_json) for e in cache.filter(F.col("cache_key") == r.cache_key).collect()
                if e.written_at <= r.requested_at < e.written_at + timedelta(hours=1)]
        plain[r.request_id] = max(t for t, _ in live) if live else None
    looked = {r.request_id: r.written_at for r in H.lookup(req, cache).collect()}
    assert looked == plain


def test_no_exchange_over_the_unfiltered_cache(spark):
    req, cache = _tables(spark, 500)
    plan = H.lookup(req, cache)._jdf.queryExecution().optimizedPlan().toString()
    scans = [i for i, line in enumerate(plan.split("\n")) if "written_at" in line and "LogicalRDD" in line]
    assert plan.count("ArrowEvalPython") + plan.count("ArrowUDF") >= 2 and scans
