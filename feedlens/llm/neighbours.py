"""Approximate nearest neighbours by inner product: several shifted Hilbert orderings.

Vectors are scaled into the unit ball and lifted onto the sphere by one more coordinate, so that the
largest inner product is the nearest point. For each of `CURVES` curves they are projected onto
`AXES` random orthonormal axes, shifted, and numbered along a Hilbert curve. Spark range-partitions
(curve, key); prefix counts give every vector its rank on every curve. Ranks are cut into blocks of
`BLOCK`; a query meets all blocks within its window of ranks, its best from every block and curve are
merged and ranked by the exact inner product of the original vectors.

The window is measured, not guessed: for up to `PROBES` queries the true neighbours are found by a
scan of all vectors, and the window is the rank distance that reaches `RECALL` of them on some curve.
Vectors without structure need windows in proportion to their number; no curve can avoid that.

Equal vectors are searched once: a class keeps its `top + 1` smallest ids, enough for any result.

Edge cases: vectors that are null, empty, zero, or hold a null or non-finite component take no part, nor do null
ids; vectors of each length are searched among their own (lengths of up to `FEW` vectors, but for the most common
length, by comparing all); a
repeated id with different vectors is that many rows, each a candidate of all others and a query of its own, equal
rows count once; with fewer candidates than `top` all are returned; an empty table gives no rows; extra columns are
ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle
from .prefix import place, totals, with_prefix

CURVES, AXES, BITS = 8, 3, 10
BLOCK, CHUNK = 1024, 64
PROBES, RECALL = 100, 0.97
FEW = 4096
SEED = 11


def hilbert(cells: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Position along the Hilbert curve of grid cells (rows of coordinates below 2^bits).

    Skilling's transform: undo the excess rotations level by level, then Gray-code, then interleave.
    """
    x = cells.astype(np.int64).T.copy()
    axes = len(x)
    for level in (1 << b for b in range(bits - 1, 0, -1)):
        low = level - 1
        for i in range(axes):
            flip = (x[i] & level) != 0
            swap = np.where(flip, 0, (x[0] ^ x[i]) & low)
            x[0] = np.where(flip, x[0] ^ low, x[0] ^ swap)
            x[i] ^= swap
    for i in range(1, axes):
        x[i] ^= x[i - 1]
    turn = np.zeros_like(x[0])
    for level in (1 << b for b in range(bits - 1, 0, -1)):
        turn = np.where((x[-1] & level) != 0, turn ^ (level - 1), turn)
    x ^= turn
    key = np.zeros_like(x[0])
    for b in range(bits - 1, -1, -1):
        for i in range(axes):
            key = (key << 1) | ((x[i] >> b) & 1)
    return key


class Curves:
    """Keys of vectors on all curves; `longest` and `mean_square` describe the norms of the data."""

    def __init__(self, dim: int, longest: float, mean_square: float):
        rng = np.random.default_rng(SEED)
        per = max(1, (dim + 1) // AXES)
        turns = [np.linalg.qr(rng.normal(size=(dim + 1, dim + 1)))[0][:, :per * AXES]
                 for _ in range(-(-CURVES // per))]
        self.axes = np.concatenate(turns, axis=1)[:, :CURVES * AXES].reshape(dim + 1, -1)
        if self.axes.shape[1] < CURVES * AXES:  # fewer dimensions than axes of a curve
            self.axes = np.resize(self.axes, (dim + 1, CURVES * AXES))
        self.shift = rng.random(CURVES * AXES)
        self.longest = longest
        self.reach = 4 * np.sqrt(max(mean_square / longest ** 2, 1e-12) / dim)

    def keys(self, x: np.ndarray, query: bool) -> np.ndarray:
        norm = np.linalg.norm(x, axis=1, keepdims=True)
        if query:
            z = np.hstack([x / norm, np.zeros_like(norm)])
        else:
            z = np.hstack([x / self.longest, np.sqrt(np.maximum(0, 1 - (norm / self.longest) ** 2))])
        grid = ((z @ self.axes / self.reach + 1) / 2 + self.shift) / 2  # the shift moves the grid by up to its width
        cells = np.clip(grid * (1 << BITS), 0, (1 << BITS) - 1).astype(np.int64)
        return np.stack([hilbert(cells[:, c * AXES:(c + 1) * AXES]) for c in range(CURVES)], axis=1)


def _matrix(col: pa.Array | pd.Series) -> np.ndarray:
    if isinstance(col, pd.Series):
        return np.stack(col.to_numpy()).astype(np.float64)
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1).astype(np.float64)


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """(vec_id, v) of the rows that take part."""
    v, most = F.col(vec_col), F.lit(float("inf"))
    fine = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < most)) & F.exists(v, lambda x: x != 0)
    rows = vectors.filter(F.col(id_col).isNotNull() & v.isNotNull() & (F.size(v) > 0)).filter(fine).select(
        F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))
    return rows.distinct()


def classes(rows: DataFrame, keep: int) -> DataFrame:
    """Distinct vectors: rep (a number in the order of their smallest ids), v, and the `keep` smallest ids."""
    first = Window.partitionBy("v").orderBy("vec_id")
    few = rows.withColumn("nth", F.row_number().over(first)).filter(F.col("nth") <= keep)
    out = settle(few.groupBy("v").agg(F.sort_array(F.collect_list("vec_id")).alias("ids")).select(
        F.col("ids")[0].alias("rep"), "v", "ids"))
    if out.groupBy("rep").count().filter("count > 1").isEmpty():
        return out
    # ids that repeat with different vectors: number the classes by smallest id and vector
    placed = place(out.withColumn("one", F.lit(1).cast("long")), ["rep", "v"], [])
    return with_prefix(placed, totals(placed, "one", []), ["rep", "v"], "one", []).select(
        F.col("index").cast("long").alias("rep"), "v", "ids")


def _keys(batches: Iterator[pa.RecordBatch], curves: Curves) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        rep, x = b.column(0).to_numpy(), _matrix(b.column(1))
        asks = np.flatnonzero(b.column(2).to_numpy(zero_copy_only=False))
        for rows, query in ((np.arange(len(rep)), False), (asks, True)):
            if len(rows):
                key = curves.keys(x[rows], query)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.repeat(rep[rows], CURVES)), pa.array(np.tile(np.arange(CURVES, dtype=np.int32), len(rows))),
                     pa.array(key.reshape(-1)), pa.array(np.full(len(rows) * CURVES, int(not query), np.int64))],
                    names=["rep", "curve", "key", "one"])


def _best(q: np.ndarray, reps: np.ndarray, x: np.ndarray, most: int, own: np.ndarray | None = None):
    """For each query row its `most` best candidates (scores, reps), largest first, ties to small ids.

    A candidate whose rep is the query's `own` is left out.
    """
    for start in range(0, len(q), 2048):
        s = q[start:start + 2048] @ x.T
        if own is not None:
            s[own[start:start + 2048, None] == reps[None, :]] = -np.inf
        cut = max(0, s.shape[1] - most)
        near = np.partition(s, cut, axis=1)[:, cut]
        slack = 1e-9 * max(1.0, np.abs(s[np.isfinite(s)]).max(initial=0.0))
        for k in range(len(s)):
            at = np.flatnonzero((s[k] >= near[k] - slack) & np.isfinite(s[k]))
            exact = (x[at] * q[start + k]).sum(axis=1)  # the same sum wherever a pair meets
            order = np.lexsort((reps[at], -exact))[:most]
            yield exact[order], reps[at][order]


def _scan(batches: Iterator[pa.RecordBatch], probes: np.ndarray, ids: np.ndarray, top: int) -> Iterator[pa.RecordBatch]:
    for b in batches:
        if not b.num_rows:
            continue
        found = list(_best(probes, b.column(0).to_numpy(), _matrix(b.column(1)), top + 1))
        n = [len(r) for _, r in found]
        yield pa.RecordBatch.from_arrays(
            [pa.array(np.repeat(ids, n)), pa.array(np.concatenate([r for _, r in found])),
             pa.array(np.concatenate([s for s, _ in found]))], names=["probe", "rep", "score"])


def _window(known: DataFrame, ranks: DataFrame, top: int) -> int:
    """The rank distance within which RECALL of the probes' true neighbours lie on some curve."""
    probes = known.filter("asks").orderBy(F.xxhash64("rep"), "rep").limit(PROBES).select("rep", "v").collect()
    if not probes:
        return 0
    scan = partial(_scan, probes=np.array([r["v"] for r in probes], np.float64),
                   ids=np.array([r["rep"] for r in probes], np.int64), top=top)
    by = Window.partitionBy("probe").orderBy(F.desc("score"), "rep")
    true = (known.select("rep", "v").mapInArrow(scan, "probe long, rep long, score double")
            .filter("probe <> rep").withColumn("nth", F.row_number().over(by)).filter(F.col("nth") <= top))
    at = ranks.filter("one = 0").select(F.col("rep").alias("probe"), "curve", F.col("before").alias("from"))
    away = (true.join(at, "probe").join(ranks.filter("one = 1").select("rep", "curve", "before"), ["rep", "curve"])
            .groupBy("probe", "rep").agg(F.min(F.abs(F.col("before") - F.col("from"))).alias("away")))
    far = away.agg(F.percentile("away", F.lit(RECALL)).alias("far")).first()["far"]
    return int(np.ceil(far or 0))


def _merge_blocks(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    asks = pdf["ask"].to_numpy(bool)
    q, c = pdf[asks], pdf[~asks]
    if not len(q) or not len(c):
        return pd.DataFrame({"rep": pd.Series(dtype="int64"), "scores": pd.Series(dtype=object), "reps": pd.Series(dtype=object)})
    found = list(_best(_matrix(q["v"]), c["rep"].to_numpy(), _matrix(c["v"]), most, q["rep"].to_numpy()))
    return pd.DataFrame({"rep": q["rep"].to_numpy(), "scores": [s for s, _ in found], "reps": [r for _, r in found]})


def _merge_queries(pdf: pd.DataFrame, most: int) -> pd.DataFrame:
    """One query's lists from its blocks and curves to its `most` best distinct candidates."""
    score, reps = np.concatenate(pdf["scores"].to_list()), np.concatenate(pdf["reps"].to_list())
    order = np.lexsort((reps, -score))
    _, first = np.unique(reps[order], return_index=True)
    keep = order[np.sort(first)[:most]]
    return pd.DataFrame({"rep": pdf["rep"].iloc[0], "other": reps[keep], "minus": -score[keep]})


def nearest(vectors: DataFrame, id_col: str = "vec_id", vec_col: str = "embedding", every: int = 20,
            top: int = 20) -> DataFrame:
    """query_id, rank, vec_id, score: the `top` best others of each vector whose id `every` divides."""
    rows = settle(usable(vectors, id_col, vec_col))
    lengths = {r["d"]: r["count"] for r in rows.groupBy(F.size("v").alias("d")).count().collect()}  # one row a length
    usual = max(lengths, key=lambda d: (lengths[d], -d), default=None)
    many = [d for d, n in lengths.items() if n > FEW or d == usual]
    out = None
    if len(many) < len(lengths) or not lengths:
        out = _all_pairs(rows.filter(~F.size("v").isin(many)) if many else rows, every, top)
    for d in many:
        found = _nearest(rows.filter(F.size("v") == d), d, every, top)
        out = found if out is None else out.unionByName(found)
    return out


_FOUND = "query_id long, rank int, vec_id long, score double"


def _all_pairs(rows: DataFrame, every: int, top: int) -> DataFrame:
    """The result for lengths of at most FEW vectors each: every query against all of its length."""
    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("vec_id", kind="stable")
        ids, x, out = pdf["vec_id"].to_numpy(), _matrix(pdf["v"]), []
        for k in np.flatnonzero(ids % every == 0).tolist():
            s = (x * x[k]).sum(axis=1)
            order = np.lexsort((ids, -s))
            order = order[order != k][:top]
            out += [(ids[k], i + 1, ids[o], s[o]) for i, o in enumerate(order.tolist())]
        return pd.DataFrame(out, columns=["query_id", "rank", "vec_id", "score"])
    return rows.groupBy(F.size("v").alias("d")).applyInPandas(run, _FOUND)


def _nearest(rows: DataFrame, dim: int, every: int, top: int) -> DataFrame:
    """The result for vectors of one length, by curves."""
    known = classes(rows, top + 1)
    asking = rows.filter(F.col("vec_id") % every == 0)
    flagged = asking.groupBy("v").agg(F.lit(True).alias("asks"))
    known = settle(known.join(flagged, "v", "left").withColumn("asks", F.coalesce("asks", F.lit(False))))
    square = F.aggregate("v", F.lit(0.0), lambda a, x: a + x.cast("double") * x)
    norms = known.agg(F.max(square).alias("most"), F.avg(square).alias("mean")).first()
    curves = Curves(dim, float(np.sqrt(norms["most"])), norms["mean"])

    keyed = known.select("rep", "v", "asks").mapInArrow(
        partial(_keys, curves=curves), "rep long, curve int, key long, one long")
    order = ["key", "rep", "one"]
    placed = place(settle(keyed), order, ["curve"])
    # `before` counts candidates only (queries have `one` 0): a candidate's rank, a query's place
    ranks = settle(with_prefix(placed, totals(placed, "one", ["curve"]), order, "one", ["curve"])
                   .select("rep", "curve", "one", "before"))
    reach = -(-_window(known, ranks, top) // BLOCK)
    last = (known.count() - 1) // BLOCK

    spots = ranks.withColumn("block", F.floor(F.col("before") / BLOCK).cast("int"))
    spots = spots.withColumn("block", F.least("block", F.lit(last)))
    low = F.greatest(F.lit(0), F.col("block") - reach)
    high = F.least(F.lit(last), F.col("block") + reach)
    asks = spots.filter("one = 0").select(
        "rep", "curve", (F.col("block") / CHUNK).cast("int").alias("chunk"), F.explode(F.sequence(low, high)).alias("block"))
    held = spots.filter("one = 1").select(
        "rep", "curve", F.explode(F.sequence((low / CHUNK).cast("int"), (high / CHUNK).cast("int"))).alias("chunk"), "block")
    both = asks.withColumn("ask", F.lit(True)).unionByName(held.withColumn("ask", F.lit(False)))

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        return _merge_blocks(pdf, top + 1)
    found = (both.join(known.select("rep", "v"), "rep").groupBy("curve", "block", "chunk")
             .applyInPandas(merge, "rep long, scores array<double>, reps array<long>"))

    def best_of(pdf: pd.DataFrame) -> pd.DataFrame:
        return _merge_queries(pdf, top + 1)
    own = known.filter("asks").select("rep", F.array(square).alias("scores"), F.array("rep").alias("reps"))
    best = found.unionByName(own).groupBy("rep").applyInPandas(best_of, "rep long, other long, minus double")

    members = known.select(F.col("rep").alias("other"), F.explode("ids").alias("vec_id"))
    by_member = Window.partitionBy("rep").orderBy("minus", "vec_id")
    listed = (best.join(members, "other").withColumn("nth", F.row_number().over(by_member))
              .filter(F.col("nth") <= top + 1).select("rep", "other", "vec_id", "minus"))
    queries = asking.join(known.select("v", "rep"), "v").select(F.col("vec_id").alias("query_id"), "rep")
    by_query = Window.partitionBy("query_id", "rep").orderBy("minus", "vec_id")
    return (queries.join(listed, "rep").filter("query_id <> vec_id or other <> rep")
            .withColumn("rank", F.row_number().over(by_query)).filter(F.col("rank") <= top)
            .select("query_id", "rank", "vec_id", (-F.col("minus")).alias("score")))
