"""Q10: deleting runs from a stored table without rewriting what holds none of them.

The rows' own file names tell which partitions hold an id. Only those are written anew: first, whole, to a folder
beside the table, then over the partitions themselves. Until the second write has ended, the first one holds
every row that stays, and `recover` carries it out again after a crash. Files of other partitions are not touched.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def _fs(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), at


def _exists(spark: SparkSession, path: str) -> bool:
    fs, at = _fs(spark, path)
    return fs.exists(at)


def _remove(spark: SparkSession, path: str) -> None:
    fs, at = _fs(spark, path)
    fs.delete(at, True)


def affected(spark: SparkSession, path: str, ids: DataFrame, key: str = "run_id") -> DataFrame:
    """The folders (one row each) that hold any of the ids."""
    rows = spark.read.parquet(path).select(key, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder"))
    return rows.join(ids.select(key), key, "left_semi").select("folder").distinct()


def delete(spark: SparkSession, path: str, ids: DataFrame, by: str, key: str = "run_id") -> int:
    """Delete the rows of `ids` from the table at `path`, partitioned by `by`; returns how many partitions changed."""
    recover(spark, path, by)
    folders = [r["folder"] for r in affected(spark, path, ids, key).collect()]  # partitions, not rows
    if not folders:
        return 0
    side = f"{path.rstrip('/')}.rewrite"
    draft = f"{path.rstrip('/')}.draft-{uuid.uuid4().hex[:12]}"
    table = spark.read.parquet(path).withColumn("_folder", F.regexp_replace("_metadata.file_path", "/[^/]*$", ""))
    held = table.filter(F.col("_folder").isin(folders))
    stays = held.join(ids.select(F.col(key).alias("_gone")).distinct(), F.col(key) == F.col("_gone"), "left_anti").drop("_folder")
    stays.write.parquet(f"{draft}/rows")
    spark.createDataFrame([(f,) for f in folders], "folder string").coalesce(1).write.parquet(f"{draft}/folders")
    fs, at = _fs(spark, draft)
    fs.rename(at, _fs(spark, side)[1])  # from here on the change is decided
    recover(spark, path, by)
    return len(folders)


def recover(spark: SparkSession, path: str, by: str) -> bool:
    """Carry out a decided rewrite, if there is one; it may have been carried out in part before."""
    side = f"{path.rstrip('/')}.rewrite"
    if not _exists(spark, side):
        return False
    rows = spark.read.parquet(f"{side}/rows")
    (rows.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(by).parquet(path))
    kept = {r["folder"] for r in rows.select(by).distinct().join(
        spark.read.parquet(path).select(by, F.regexp_replace("_metadata.file_path", "/[^/]*$", "").alias("folder")).distinct(),
        by).select("folder").collect()}
    for r in spark.read.parquet(f"{side}/folders").collect():
        if r["folder"] not in kept:  # nothing of this partition stays
            _remove(spark, r["folder"])
    _remove(spark, side)
    return True
