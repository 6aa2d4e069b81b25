"""Small helpers shared by the corpus operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import cut_lineage

#: What separates words throughout the contracts: space and the controls 9 to 13.
WORD = r"[^\x20\x09-\x0D]+"


def settle(df: DataFrame) -> DataFrame:
    """Write `df` into the shared checkpoint folder and read it back.

    Later reads, retries and lost executors see the same rows, and nothing upstream runs twice.
    """
    return cut_lineage(df)


def shuffle_width(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def word_count(text: Column) -> Column:
    """Number of words of `WORD` in a text; null has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def fold(doc_id: Column, n: int) -> Column:
    """crc32 of the id as text, modulo `n` (a null id counts as the empty text)."""
    return (F.crc32(F.encode(F.coalesce(doc_id.cast("string"), F.lit("")), "UTF-8")) % n).cast("int")


def join_summary(rows: DataFrame, summary: DataFrame, on: list[str], most: int = 20_000) -> DataFrame:
    """Join rows to a per-group summary; broadcast it only when it has been counted as small.

    `summary` must be settled (it is counted here). Beyond `most` rows it is a plain join, whose
    skewed partitions Spark splits by itself.
    """
    small = summary.limit(most + 1).count() <= most
    return rows.join(F.broadcast(summary) if small else summary, on)
