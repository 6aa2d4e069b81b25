"""SimHash near-duplicates: exact search in tiles, linked into components.

Fingerprints: 64 bits over word shingles hashed with XXH64. Distinct fingerprints are put into cells
by the bit counts of their four 16-bit quarters. Two fingerprints within `radius` bits have quarter
counts that differ by at most `radius` in sum, so only such cells are compared: cells are cut into
tiles of about `TILE` fingerprints, and each pair of tiles is compared whole by exclusive-or and bit
count. A pair of tiles returns a spanning forest of its links, never all pairs. Components come from
alternating large-star and small-star rounds.

Edge cases: null, empty and blank texts have fingerprint zero, linked like any other; texts with
fewer words than a shingle hash their whole word sequence; repeated rows share their fingerprint;
rows without doc_id get the smallest non-null doc_id of their component, null if there is none; an
empty table gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import settle

TILE = 512
_LANES = np.uint64(0x0101010101010101)


def _bit_totals(h: np.ndarray) -> np.ndarray:
    """How many of the hashes have each bit (index 0: lowest) set.

    Eight bits are counted at once in the byte lanes of 64-bit sums over runs of 255 hashes.
    """
    pad = -len(h) % 255
    rows = np.concatenate([h, np.zeros(pad, np.uint64)]).reshape(-1, 255)
    out = np.zeros((8, 8), np.int64)
    for s in range(8):
        lanes = ((rows >> np.uint64(s)) & _LANES).sum(axis=1, dtype=np.uint64)
        out[:, s] = lanes.view(np.uint8).reshape(-1, 8).sum(axis=0, dtype=np.int64)
    return out.reshape(64)  # little-endian lanes: byte k holds bits 8k to 8k + 7


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """The SimHash of a text's word shingles as an unsigned 64-bit number (see the module)."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, and 9-13 and 32 split
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    lens = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lens + 1) - 1
    starts = (ends - lens)[: len(words) - width + 1].tolist()
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    h = np.fromiter((digest(joined[a:b]) for a, b in zip(starts, ends[width - 1:].tolist())),
                    np.uint64, len(starts))
    bits = np.flatnonzero(2 * _bit_totals(h) > len(h))
    return sum(1 << int(b) for b in bits)


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """doc_id and fp (the fingerprint as a signed long) of every document."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(1)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(fp.view(np.int64))], names=["doc_id", "fp"])
    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, fp long")


def _cells(fps: DataFrame) -> DataFrame:
    """fps with p0..p3, the quarters' bit counts, and their cell number."""
    for q in range(4):
        quarter = F.shiftrightunsigned("fp", 16 * q).bitwiseAND(F.lit(0xFFFF).cast("long"))
        fps = fps.withColumn(f"p{q}", F.bit_count(quarter).cast("int"))
    return fps.withColumn("cell", F.expr("((p0 * 17 + p1) * 17 + p2) * 17 + p3"))


def _near_cells(counts: DataFrame, radius: int) -> DataFrame:
    """Pairs of occupied cells (cell <= other) whose quarter counts differ by `radius` at most in sum.

    There are at most 17^4 cells, whatever the corpus.
    """
    steps = range(-radius, radius + 1)
    moves = [(a, b, c, d) for a in steps for b in steps for c in steps for d in steps
             if abs(a) + abs(b) + abs(c) + abs(d) <= radius]
    lit = F.array(*[F.array(*map(F.lit, m)) for m in moves])
    to = counts.withColumn("m", F.explode(lit))
    ok = F.lit(True)
    for q in range(4):
        to = to.withColumn(f"p{q}", F.col(f"p{q}") + F.col("m")[q])
        ok = ok & F.col(f"p{q}").between(0, 16)
    to = to.filter(ok).withColumn("other", F.expr("((p0 * 17 + p1) * 17 + p2) * 17 + p3"))
    to = to.filter("cell <= other").select("cell", "other")
    return to.join(counts.select(F.col("cell").alias("other")), "other", "left_semi")


def _forest(i: np.ndarray, j: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Links between nodes below `n` as (root, member) pairs with the same components."""
    label = np.arange(n)
    while True:
        new = label.copy()
        np.minimum.at(new, i, label[j])
        np.minimum.at(new, j, label[i])
        new = np.minimum(new, new[new])
        if (new == label).all():
            break
        label = new
    member = np.flatnonzero(label != np.arange(n))
    return label[member], member


def _compare(batches: Iterator[pa.RecordBatch], radius: int) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        roots, members = [], []
        left, right, same = batch.column(0), batch.column(1), batch.column(2)
        lv, rv = (c.values.to_numpy().view(np.uint64) for c in (left, right))
        lo, ro = left.offsets.to_numpy(), right.offsets.to_numpy()
        for k in range(batch.num_rows):
            a, b = lv[lo[k]:lo[k + 1]], rv[ro[k]:ro[k + 1]]
            near = np.bitwise_count(a[:, None] ^ b[None, :]) <= radius
            if same[k].as_py():
                near = np.triu(near, 1)
            i, j = np.nonzero(near)
            if len(i):
                both = np.concatenate([a, b]).view(np.int64)
                x, y = _forest(i, j + (0 if same[k].as_py() else len(a)), len(both))
                roots.append(both[x])
                members.append(both[y])
        if roots:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(roots)), pa.array(np.concatenate(members))], names=["a", "b"])


def links(fps: DataFrame, radius: int = 2) -> DataFrame:
    """Links (a, b) between distinct fingerprints `fp` that give the components of distance <= radius."""
    fps = settle(_cells(fps))
    counts = settle(fps.groupBy("cell", "p0", "p1", "p2", "p3").agg(F.ceil(F.count(F.lit(1)) / TILE).alias("tiles")))
    cut = fps.join(F.broadcast(counts.select("cell", "tiles")), "cell")  # at most 17^4 rows
    tiles = settle(cut.withColumn("tile", F.pmod(F.xxhash64("fp"), F.col("tiles")))
                   .groupBy("cell", "tile").agg(F.collect_list("fp").alias("fps")))
    right = tiles.select(F.col("cell").alias("other"), F.col("tile").alias("other_tile"), F.col("fps").alias("fps2"))
    pairs = (tiles.join(_near_cells(counts, radius), "cell").join(right, "other")
             .filter("cell < other or tile <= other_tile")
             .select("fps", "fps2", F.expr("cell = other and tile = other_tile").alias("same")))
    return pairs.mapInArrow(partial(_compare, radius=radius), "a long, b long")


def components(edges: DataFrame) -> DataFrame:
    """(a, b) links to (node, root): the smallest node reachable, for every node with a link.

    Large-star joins each node's larger neighbours to its smallest one, small-star its smaller ones;
    rounds repeat until nothing moves. Each round is settled.
    """
    def state(e: DataFrame):
        return tuple(e.agg(F.count(F.lit(1)), F.bit_xor(F.xxhash64("u", "v"))).first())

    e = settle(edges.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v"))
               .filter("u <> v").distinct())
    was, now = None, state(e)
    while was != now:
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        big = (both.filter("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct())
        least = big.groupBy("u").agg(F.min("v").alias("m"))
        e = settle(big.join(least, "u").select(F.expr("if(v = m, u, v)").alias("u"), F.col("m").alias("v")).distinct())
        was, now = now, state(e)
    return e.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(
        e.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def near_duplicates(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """doc_id, fingerprint (hex) and component_id of every document."""
    marked = settle(fingerprints(docs, width))
    firsts = settle(marked.groupBy("fp").agg(F.min("doc_id").alias("first_id")))
    roots = components(links(firsts.select("fp"), radius))
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(
        "fp", "first_id", F.coalesce("root", "fp").alias("root"))
    smallest = rooted.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = rooted.join(smallest, "root").select("fp", "component_id")
    return marked.join(of, "fp").select(
        "doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, width: int = 3, radius: int = 2) -> DataFrame:
    """`docs` with one document of each component: its smallest doc_id, and of the rows repeating that id the one
    whose text hashes lowest. A row without doc_id stays only where its component has no other.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fp = np.fromiter((fingerprint(t.as_py(), width) for t in b.column(2)), np.uint64, b.num_rows)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(fp.view(np.int64))],
                                             names=["doc_id", "th", "fp"])
    rows = docs.select("doc_id", F.xxhash64("text").alias("th"), "text").mapInArrow(run, "doc_id long, th long, fp long")
    # a row is told by its id and its text; the component's first is carried by fingerprint
    one = F.min(F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "th"))
    firsts = settle(rows.groupBy("fp").agg(one.alias("at")))
    roots = components(links(firsts.select("fp"), radius))
    rooted = firsts.join(roots, firsts["fp"] == roots["node"], "left").select(F.coalesce("root", "fp").alias("root"), "at")
    heads = rooted.groupBy("root").agg(F.min("at").alias("at"))

    def key(doc_id, th):  # plain equalities, so that the join's shuffle serves the window too
        return F.col(doc_id).isNull().alias("_none"), F.coalesce(doc_id, F.lit(0)).alias("_id"), th.alias("_th")
    keys = ["_none", "_id", "_th"]
    told = docs.select(*key("doc_id", F.xxhash64("text")), F.struct(*docs.columns).alias("_row"))
    first = Window.partitionBy(*keys).orderBy(F.xxhash64("_row"))
    return (told.join(heads.select(*key("at.doc_id", F.col("at.th"))), keys, "left_semi")
            .withColumn("_nth", F.row_number().over(first)).filter("_nth = 1").select("_row.*"))
