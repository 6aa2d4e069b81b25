"""Mixing sources to target weights: hash-random order within each source, cut at exact budgets.

Each source has a weight; all sources share the total size by weight, but none gets more than
`epochs` times its own size, and what exceeds that is shared anew by weight among the others. The
water level is found in closed form from sources sorted by cap over weight. Within a source,
documents come in the order of a hash of their id; whole epochs are taken first, then documents up
to the exact budget, the one at the cut in part.

Edge cases: a null text has size 0 and is never taken; null sources are one source, last; an empty
table gives no rows; rows repeating an id keep their own share each; a corpus without words has
targets of zero. Extra columns are ignored by `mix_rows` and kept by `mixed`.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import join_summary, settle, word_count
from .prefix import place, totals, with_prefix

ORDER = ["key", "doc_id", "size"]
SEED = "mix:"


def random_key(doc_id: Column) -> Column:
    """60 bits of the md5 of the seeded id: the same order in every run."""
    text = F.concat(F.lit(SEED), F.coalesce(doc_id.cast("string"), F.lit("")))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def group_key(source: Column) -> Column:
    """A null-free text in the order of sources, null last."""
    return F.coalesce(F.concat(F.lit("s"), source), F.lit("t"))


def cycle_weights(rank: Column) -> Column:
    """Weights 1, 2, 3, repeating, by the source's rank from 1."""
    return ((rank - 1) % 3 + 1).cast("double")


def targets(sources: DataFrame, weight=cycle_weights, epochs: int = 3) -> DataFrame:
    """(_g, source_size) to (_g, source_size, target); one row per source, windows over those alone."""
    by_name, everything = Window.orderBy("_g"), Window.partitionBy()
    s = sources.withColumn("w", weight(F.row_number().over(by_name)))
    s = s.withColumn("cap", F.col("source_size") * epochs)
    upto = Window.orderBy(F.col("cap") / F.col("w"), "_g").rowsBetween(Window.unboundedPreceding, 0)
    s = (s.withColumn("left", F.sum("source_size").over(everything) - (F.sum("cap").over(upto) - F.col("cap")))
         .withColumn("weights", F.sum("w").over(everything) - (F.sum("w").over(upto) - F.col("w"))))
    # the level if this source and all later ones stay below their caps; the first that fits holds
    s = s.withColumn("level", F.col("left") / F.col("weights"))
    fits = F.when(F.col("level") * F.col("w") <= F.col("cap"), F.col("level"))
    s = s.withColumn("water", F.max(fits).over(everything))
    return s.select("_g", "source_size", F.least(F.col("cap").cast("double"), F.col("water") * F.col("w")).alias("target"))


def _planned(docs: DataFrame, weight, epochs: int) -> DataFrame:
    light = settle(docs.select("doc_id", group_key(F.col("source")).alias("_g"),
                               random_key(F.col("doc_id")).alias("key"), word_count(F.col("text")).alias("size")))
    placed = place(light, ORDER, ["_g"])
    per = totals(placed, "size", ["_g"])
    plan = targets(per.groupBy("_g").agg(F.sum("_sum").alias("source_size")), weight, epochs)
    rows = with_prefix(placed, per.join(plan, "_g"), ORDER, "size", ["_g"])
    budget = F.floor(F.col("target") + 0.5)
    whole = F.when(F.col("source_size") > 0, F.floor(budget / F.col("source_size"))).otherwise(0)
    rows = rows.withColumn("whole", whole.cast("long"))
    rows = rows.withColumn("rest", (budget - F.col("whole") * F.col("source_size")).cast("long"))
    part = F.least(F.col("size"), F.greatest(F.lit(0).cast("long"), F.col("rest") - F.col("before")))
    return rows.withColumn("part", part).withColumn("taken", F.col("whole") * F.col("size") + F.col("part"))


def mix_rows(docs: DataFrame, weight=cycle_weights, epochs: int = 3) -> DataFrame:
    """One row per document: doc_id, size, source_size, target of its source, words taken."""
    return _planned(docs, weight, epochs).select("doc_id", "size", "source_size", "target", "taken")


def mixed(docs: DataFrame, weight=cycle_weights, epochs: int = 3) -> DataFrame:
    """The mix itself: each document as often as it is taken, the one at a source's cut whole.

    Only each source's whole epochs and cut point (one row per source) meet the texts, which are not
    shuffled. Documents that the mix does not take, and those without words, are left out.
    """
    rows = _planned(docs, weight, epochs)
    here = F.when(F.col("part") > 0, F.struct(*ORDER))
    cuts = settle(rows.groupBy("_g").agg(F.first("whole").alias("_whole"), F.max(here).alias("_cut")))
    keyed = docs.select(F.struct(*docs.columns).alias("_row"), group_key(F.col("source")).alias("_g"), F.struct(
        random_key(F.col("doc_id")).alias("key"), F.col("doc_id"), word_count(F.col("text")).alias("size")).alias("_key"))
    out = join_summary(keyed, cuts, ["_g"])
    times = F.col("_whole") + F.coalesce((F.col("_key") <= F.col("_cut")).cast("long"), F.lit(0))
    times = F.when(F.col("_key.size") > 0, times).otherwise(0)
    return (out.withColumn("_times", times.cast("int")).filter("_times > 0")
            .withColumn("_copy", F.explode(F.expr("sequence(1, _times)"))).select("_row.*"))
