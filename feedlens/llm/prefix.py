"""Distributed prefix sums over a global order, without a one-task window.

Rows are range-partitioned by (group, order), each range partition is summed on its own, the
per-partition totals (one row for each partition and group it touches) are prefix-summed, and each
row adds its partition's offset. A hot group spans many range partitions, so none is a bottleneck.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle, shuffle_width


def place(df: DataFrame, order: list[str], group: list[str]) -> DataFrame:
    """Range-partition by (group, order) and keep each row's partition number in `_part`.

    The result is settled: range bounds come from a sample, so a second evaluation may draw others.
    """
    n = shuffle_width(df.sparkSession)
    return settle(df.repartitionByRange(n, *group, *order).withColumn("_part", F.spark_partition_id()))


def totals(placed: DataFrame, value: str, group: list[str]) -> DataFrame:
    """Per (partition, group): sum and rows, and those of the group's earlier partitions."""
    keys = ["_part", *group]
    per = placed.groupBy(*keys).agg(F.sum(value).alias("_sum"), F.count(F.lit(1)).alias("_rows"))
    earlier = Window.partitionBy(*group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return (per.withColumn("_sum_off", F.coalesce(F.sum("_sum").over(earlier), F.lit(0).cast("long")))
            .withColumn("_row_off", F.coalesce(F.sum("_rows").over(earlier), F.lit(0).cast("long"))))


def with_prefix(placed: DataFrame, per: DataFrame, order: list[str], value: str,
                group: list[str]) -> DataFrame:
    """`placed` with `before` (sum of `value` over earlier rows of the group) and `index` (their count).

    `per` is `totals(...)`, possibly with more columns, which all reach the rows.
    """
    keys = ["_part", *group]
    here = Window.partitionBy(*keys).orderBy(*order)
    run = F.coalesce(F.sum(value).over(here.rowsBetween(Window.unboundedPreceding, -1)),
                     F.lit(0).cast("long"))
    rows = placed.withColumn("_run", run).withColumn("_nth", F.row_number().over(here) - 1)
    return (rows.join(per, keys)
            .withColumn("before", F.col("_run") + F.col("_sum_off"))
            .withColumn("index", F.col("_nth") + F.col("_row_off")))
