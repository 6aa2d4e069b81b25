"""Result cache as tables (H1–H8).

The lookup is an as-of join: a request hits the newest entry of its key written at or before the
request and still inside the TTL. It is computed as a union + window partitioned by
(key, time bucket) instead of a join, so a hot key never multiplies requests by entries and each
window group is bounded by part of one TTL period of that key's traffic.

The cache grows without end, the requests of a job do not: a Bloom filter of the requests' keys thins the
cache where it is read, so neither entries nor bodies of other keys are shuffled.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .. import schemas as S
from ..functions import keys
from ..functions.bloom import BITS, key_filter
from ..session import cut_lineage


def with_cache_key(df: DataFrame, content: str = "content", provider: str = "provider",
                   model: str = "model") -> DataFrame:
    """H1."""
    return df.withColumn("cache_key", keys.cache_key(F.col(content), F.col(provider), F.col(model)))


def _tie(result: str = "result_json"):
    """Of entries written at the same time, the one whose text hashes highest counts as the last."""
    return F.xxhash64(result)


def latest_entries(cache: DataFrame, now=None) -> DataFrame:
    """H5: last write wins per key (optionally only writes at or before `now`)."""
    c = cache if now is None else cache.filter(F.col("written_at") <= F.lit(now).cast("timestamp"))
    w = Window.partitionBy("cache_key").orderBy(F.col("written_at").desc(), _tie().desc())
    return c.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").drop("_rn")


def lookup(requests: DataFrame, cache: DataFrame, ttl_seconds: int = S.CACHE_TTL_SECONDS,
           now_col: str = "requested_at", key: str = "request_id", splits: int = 4,
           filter_bits: int = BITS) -> DataFrame:
    """H2 + H3 + H5: every request with `hit`, and the entry's `result_json`/`written_at` on hits.

    Time is cut into `splits` buckets a TTL; an entry stands in each bucket that its life touches, so a
    hot key is spread over its buckets. Only an entry's time and hash take part in the search; the
    result bodies are joined to the hits afterwards. Only entries that pass the filter of the requests' keys, and
    whose life touches the requests' time span, are shuffled at all.
    """
    ttl_us = ttl_seconds * 1_000_000
    width = ttl_us // splits
    span = requests.agg(F.min(now_col).alias("a"), F.max(now_col).alias("b")).first()
    cache = cache.filter((F.col("written_at") <= F.lit(span["b"]))  # reaches the scan
                         & (F.unix_micros("written_at") + ttl_us > F.unix_micros(F.lit(span["a"]).cast("timestamp"))))
    cache = cache.filter(key_filter(requests, "cache_key", filter_bits)(F.col("cache_key")))
    r = (requests.withColumn("_t", F.unix_micros(F.col(now_col))).withColumn("_kind", F.lit(1))
         .withColumn("_b", F.floor(F.col("_t") / width)))
    w_t = F.unix_micros(F.col("written_at"))
    e = cache.select("cache_key", w_t.alias("_t"), F.lit(0).alias("_kind"), _tie().alias("_h"),
                     F.struct(w_t.alias("t"), _tie().alias("h")).alias("_entry"),
                     F.explode(F.sequence(F.floor(w_t / width), F.floor((w_t + ttl_us - 1) / width))).alias("_b"))
    u = r.unionByName(e, allowMissingColumns=True)
    win = (Window.partitionBy("cache_key", "_b").orderBy("_t", "_kind", "_h")
           .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    x = u.withColumn("_e", F.last("_entry", ignorenulls=True).over(win)).filter(F.col("_kind") == 1)
    live = F.coalesce(F.col("_t") < F.col("_e.t") + ttl_us, F.lit(False))
    x = x.withColumns({"hit": live, "_wt": F.when(live, F.col("_e.t")), "_wh": F.when(live, F.col("_e.h"))})
    bodies = cache.groupBy("cache_key", w_t.alias("_wt"), _tie().alias("_wh")).agg(
        F.first("result_json").alias("result_json"), F.first("written_at").alias("written_at"))
    return (x.drop("_t", "_kind", "_b", "_h", "_entry", "_e")
            .join(bodies, ["cache_key", "_wt", "_wh"], "left").drop("_wt", "_wh"))


def hits(looked: DataFrame) -> DataFrame:
    return looked.filter("hit")


def misses(looked: DataFrame) -> DataFrame:
    return looked.filter(~F.col("hit"))


def leaders(requests: DataFrame, key: str = "request_id", by: str = "cache_key", settled: bool = False) -> DataFrame:
    """H6: identical inputs in one batch are computed once – the smallest request id per `by` is the
    leader; the others take its result. Pre-aggregated per key, so a hot key is one row. The keys are hashes of
    whole notes: unless the rows are `settled` already, they are written before they are used twice."""
    requests = requests if settled else cut_lineage(requests)
    lead = requests.groupBy(by).agg(F.min(key).alias("leader_" + key))
    return requests.join(lead, by)


def entries_for(results: DataFrame, written_at: str = "written_at") -> DataFrame:
    """A4/H4: successful results as JSON text under their key."""
    payload = [c for c in results.columns if c not in ("cache_key", written_at, "content")]
    return (results.filter(F.col("success"))
            .select("cache_key", F.to_json(F.struct(*payload)).alias("result_json"), F.col(written_at)))


def write(entries: DataFrame, path: str, mode: str = "append") -> None:
    """A4 sink: parquet partitioned by write day, so TTL scans prune old days."""
    (entries.withColumn("write_day", F.to_date("written_at"))
     .write.mode(mode).partitionBy("write_day").parquet(path))


def results_of_hits(hit_rows: DataFrame, key: str = "request_id") -> DataFrame:
    """H2: the cached result of every hit as a result row (`from_cache` is true)."""
    r = F.from_json("result_json", S.RESULT)
    return (hit_rows.withColumn("_r", r)
            .select(key, "cache_key", *[F.col(f"_r.{f.name}").alias(f.name) for f in S.RESULT.fields],
                    F.lit(True).alias("from_cache")))


def read_results(entries: DataFrame) -> DataFrame:
    """A5: cached JSON back to the typed result."""
    return entries.withColumn("result", F.from_json("result_json", S.RESULT))
