"""Contiguous shards of equal bytes: global prefix sums of sizes, cut at equal targets.

Rows are ordered by (doc_id, text_crc32, size), nulls first. A row goes to the shard that the middle
of its byte span falls into, so shards are contiguous in that order and their sizes differ from the
target by at most half a document at either edge.

Edge cases: a null text has size 1 and a null crc; an empty table gives no rows; repeated rows are
counted and placed one by one; a document larger than a target may leave a shard empty; other
columns of the input are ignored by `shard_rows` and kept by `assign`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .prefix import place, totals, with_prefix

ORDER = ["doc_id", "text_crc32", "size"]


def measured(docs: DataFrame) -> DataFrame:
    """doc_id, size (UTF-8 bytes plus one) and crc32 of each document."""
    return docs.select("doc_id", *_measures())


def _measures() -> tuple[Column, Column]:
    size = (F.coalesce(F.octet_length("text"), F.lit(0)) + 1).cast("long").alias("size")
    return size, F.crc32(F.encode("text", "UTF-8")).alias("text_crc32")


def shard_rows(docs: DataFrame, shards: int = 16) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, shard and its slot (gapless from 0)."""
    placed = place(settle(measured(docs).withColumn("_g", F.lit(0))), ORDER, ["_g"])
    per = totals(placed, "size", ["_g"])
    whole = per.groupBy("_g").agg(F.sum("_sum").alias("_all"))
    per = per.join(F.broadcast(whole), "_g")  # one row
    rows = with_prefix(placed, per, ORDER, "size", ["_g"])
    rows = rows.withColumn("shard", F.expr(f"((2 * before + size) * {shards}) div (2 * _all)").cast("int"))
    starts = rows.groupBy("shard").agg(F.min("index").alias("_start"))
    return (rows.join(F.broadcast(starts), "shard")  # at most `shards` rows
            .withColumn("slot", F.col("index") - F.col("_start"))
            .select("doc_id", "size", "text_crc32", "shard", "slot"))


def assign(docs: DataFrame, shards: int = 16) -> DataFrame:
    """`docs` with `size` and `shard`; the texts are not moved.

    The shards' last rows (at most `shards` of them) are read as cut points and every document is
    compared with them. Identical rows stay together. Columns named `size` or `shard` are replaced.
    """
    placed = settle(shard_rows(docs, shards))
    last = (placed.groupBy("shard").agg(F.max(F.struct(*ORDER)).alias("last"))
            .orderBy("shard").collect())
    key = F.struct(F.col("doc_id"), F.col("text_crc32"), F.col("size"))
    size, crc = _measures()
    kept = [c for c in docs.columns if c not in ("size", "shard")]
    out = docs.select(F.struct(*kept).alias("_row"), "doc_id", size, crc)
    shard = F.lit(None).cast("int")
    for r in reversed(last):
        cut = F.struct(*[F.lit(r["last"][c]).cast("long").alias(c) for c in ORDER])
        shard = F.when(key <= cut, F.lit(r["shard"])).otherwise(shard)
    return out.select("_row.*", "size", shard.cast("int").alias("shard"))
