"""Percentiles kept as mergeable quantile sketches, one per window and label.

A KLL sketch of `K` keeps a few kilobytes whatever it has seen and merges without losing its bound: the rank of
a percentile is off by at most `RANK_ERROR` of the rows (99 % confidence). Short windows are sketched once and
stored; longer periods merge them. A window that is computed anew (late rows) is appended with a later `version`
and replaces the older one when the table is read.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

K, RANK_ERROR = 800, 0.01


def sketch(df: DataFrame, value: str, labels: list[str], ts: str = "ts", period: str = "5 minutes",
           version: int = 0, k: int = K) -> DataFrame:
    """window_start, labels, n, sketch, version: one row for each window and label that has values."""
    v = F.col(value).cast("double")
    return (df.filter(v.isNotNull() & ~F.isnan(v))
            .groupBy(F.window(ts, period).start.alias("window_start"), *labels)
            .agg(F.count(F.lit(1)).alias("n"), F.kll_sketch_agg_double(v, F.lit(k)).alias("sketch"))
            .withColumn("version", F.lit(version).cast("long")))


def write(sketches: DataFrame, path: str) -> None:
    """Append to the stored table, by day of the window."""
    sketches.withColumn("day", F.to_date("window_start")).write.mode("append").partitionBy("day").parquet(path)


def current(sketches: DataFrame, labels: list[str]) -> DataFrame:
    """The last version of each window and label."""
    last = Window.partitionBy("window_start", *labels).orderBy(F.desc("version"))
    return sketches.withColumn("_nth", F.row_number().over(last)).filter("_nth = 1").drop("_nth")


def percentiles(sketches: DataFrame, labels: list[str], ps: list[float], since=None, until=None) -> DataFrame:
    """labels, p, value, n over the windows from `since` on and before `until`; windows are whole."""
    s = sketches
    if since is not None:
        s = s.filter(F.col("window_start") >= F.lit(since).cast("timestamp"))
    if until is not None:
        s = s.filter(F.col("window_start") < F.lit(until).cast("timestamp"))
    merged = s.groupBy(*labels).agg(F.kll_merge_agg_double("sketch").alias("_s"), F.sum("n").alias("n")).filter("n > 0")
    each = F.array(*[F.struct(F.lit(float(p)).alias("p"), F.kll_sketch_get_quantile_double("_s", F.lit(float(p))).alias("value"))
                     for p in ps])
    return merged.select(*labels, "n", F.explode(each).alias("x")).select(*labels, "x.p", "x.value", "n")
