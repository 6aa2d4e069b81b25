"""N-gram Jaccard join: documents whose sets of word shingles overlap by 85 % or more, linked into components.

The overlaps are cells of a sparse matrix product, documents by shingles times its transpose. It is never
formed whole:

1. Documents with the same set are one row of the matrix (`classes`).
2. A set of n shingles can only reach the share with a partner if they share one of its first
   n - ceil(0.85 n) + 1 shingles in any order that all documents keep. The order is by counts (rare first)
   from a sketch of fixed size over all documents, then by hash: the sketch steers the work, not the result.
3. Only those shingles are shuffled, packed by partition. The documents of one column are compared by set size and
   by place in the order, which bounds the overlap of a pair that meets there first; what stays is a graph of
   candidates, held as links without repeats. Columns longer than a tile are compared tile by tile.
4. Large candidate components hold many pairs that only a chain of others joins. Each set has the parities of its
   hashes' counts in n to 2n cells, one or two bits a shingle: where those of two sets differ, a shingle is in one
   set only, which bounds their overlap whatever the sketch has seen. Members whose bound reaches the share
   are linked, and these components are smaller, near what the links give in the end.
5. The texts of each such component come together once, packed, in blocks of bounded size (larger ones are cut by
   size class and hash, a class into four blocks as long as they fit, so that a text goes to a few pairs of blocks
   and not to as many as there are blocks). Each pair of blocks is multiplied tile by tile in slices of columns,
   overlap counts add up, and documents that can no longer reach the share with any other are dropped between
   slices. Tiles whose documents are all linked already are passed over.
6. Links (a forest for each pair of blocks, never all pairs) give the components.

Shingles are 64-bit hashes, sets 128-bit hashes (64 bits of them among the candidates, where two sets of one name only
make another candidate).

Edge cases: null, empty and blank texts have an empty set, are linked with nothing and keep their own doc_id;
texts with fewer words than a shingle have one shingle, the whole sequence; repeated rows and equal sets share a
component; rows without doc_id get the smallest doc_id of their component, null if there is none; an empty table
gives no rows; extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import partial

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.bloom import among, key_field
from .common import settle, shuffle_width
from .simhash import components

#: Counters of the sketch (4 MB broadcast, whatever the corpus) and counters in one row of it.
CELLS, PART = 1 << 20, 1 << 14
#: Columns multiplied at once, hashes counted at once, postings packed at once.
SLICE, FLUSH, HELD = 4096, 1 << 20, 1 << 18

_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingles(text: str | None, width: int = 4, seed: int = 42) -> np.ndarray:
    """The distinct shingles of a text as sorted unsigned 64-bit hashes (see the module)."""
    words = (text or "").encode("utf-8").lower().split()  # bytes: only A-Z change, and 9-13 and 32 split
    if not words:
        return np.empty(0, np.uint64)
    if len(words) < width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words), seed + 1)], np.uint64)
    digest = partial(xxhash.xxh64_intdigest, seed=seed)
    h = np.fromiter(map(digest, words), np.uint64, len(words))
    n = len(h) - width + 1
    out = h[:n].copy()
    for k in range(1, width):
        out ^= out >> np.uint64(29)
        out *= _MIX
        out += h[k:k + n]
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return np.unique(out)


def _signature(items: np.ndarray) -> bytes:
    return xxhash.xxh3_128_digest(items.tobytes())


def _node_of(sig: str):
    """The second half of a set's hash: its 64-bit name among the candidates."""
    return F.conv(F.hex(F.substring(sig, 9, 8)), 16, -10).cast("long")


def _sets(batches: Iterator[pa.RecordBatch], width: int) -> Iterator[tuple]:
    """(row of the batch, batch, its shingles) of each document."""
    for b in batches:
        texts = b.column(b.schema.get_field_index("text"))
        for i in range(b.num_rows):
            yield i, b, shingles(texts[i].as_py(), width)


_PROFILE = "doc_id long, th long, n long, sig binary, bits binary, part int, counts binary"
_NAMES = [x.split()[0] for x in _PROFILE.split(", ")]


def _profile(docs: DataFrame, width: int) -> DataFrame:
    """Per document its id, text hash, set size, set and parities; besides, per task, its share of the sketch."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(CELLS, np.uint32)
        for b in batches:
            n, sigs, bits, held, size = [], [], [], [], 0
            for _, _, items in _sets(iter([b]), width):
                n.append(len(items))
                sigs.append(_signature(items) if len(items) else None)
                bits.append(_parity(items) if len(items) else None)
                held.append(items)
                size += len(items)
                if size >= FLUSH:
                    counts += _counted(held)
                    held, size = [], 0
            counts += _counted(held)
            none = pa.nulls(b.num_rows, pa.int32()), pa.nulls(b.num_rows, pa.binary())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(sigs, pa.binary()),
                 pa.array(bits, pa.binary()), *none], names=_NAMES)
        for part in np.flatnonzero(counts.reshape(-1, PART).any(axis=1)).tolist():
            blob = zstandard.compress(counts[part * PART:(part + 1) * PART].astype(np.uint64).tobytes(), 1)
            yield pa.RecordBatch.from_arrays(
                [pa.nulls(1, pa.int64())] * 3 + [pa.nulls(1, pa.binary())] * 2 + [
                    pa.array([part], pa.int32()), pa.array([blob], pa.binary())], names=_NAMES)
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("th"), "text")
    return rows.mapInArrow(run, _PROFILE)


def _counted(held: list[np.ndarray]) -> np.ndarray:
    if not held:
        return np.zeros(CELLS, np.uint32)
    cells = (np.concatenate(held) & np.uint64(CELLS - 1)).astype(np.int64)
    return np.bincount(cells, minlength=CELLS).astype(np.uint32)


def _add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Shares of the sketch, added up by part."""
    total: dict[int, np.ndarray] = {}
    for b in batches:
        for part, blob in zip(b.column(0).to_pylist(), b.column(1)):
            own = np.frombuffer(zstandard.decompress(blob.as_py()), np.uint64)
            total[part] = total[part] + own if part in total else own
    if total:
        blobs = [zstandard.compress(v.tobytes(), 1) for v in total.values()]
        yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array(blobs, pa.binary())],
                                         names=["part", "counts"])


def _sketch(profile: DataFrame) -> np.ndarray:
    """Counts of all documents' shingles by cell: CELLS numbers, added up in Spark part by part."""
    shares = profile.filter("part is not null").select("part", "counts")
    whole = shares.mapInArrow(_add, "part int, counts binary").repartition("part").mapInArrow(
        _add, "part int, counts binary")
    out = np.zeros((CELLS // PART, PART), np.uint64)
    for r in whole.collect():  # CELLS / PART rows, 4 MB
        out[r["part"]] = np.frombuffer(zstandard.decompress(r["counts"]), np.uint64)
    return np.minimum(out.reshape(-1), (1 << 32) - 1).astype(np.uint32)


@dataclass(frozen=True)
class Sizes:
    """Postings in a tile of a column, sets and shingles compared at once, postings in a sorted run."""
    tile: int = 512
    sets: int = 512
    items: int = 1 << 20
    run: int = 4096


class Share:
    """The share num/den that intersection over union must reach, in whole numbers."""

    def __init__(self, num: int, den: int):
        self.num, self.den = num, den

    def least(self, n: np.ndarray) -> np.ndarray:
        """Smallest overlap of a set of n with any partner; also the smallest partner's size."""
        return -(-self.num * n // self.den)

    def need(self, n: np.ndarray, m: np.ndarray) -> np.ndarray:
        """Overlap that sets of n and m need: o den >= num (n + m - o)."""
        return -(-self.num * (n + m) // (self.num + self.den))


#: Bytes of a posting before it is packed: its shingle, run, set size, place and set.
_POSTING = np.dtype([("w", np.int64), ("run", np.int32), ("n", np.int32), ("pos", np.int32), ("node", np.int64)])


def _pack(postings: list[np.ndarray], to: zstandard.ZstdCompressor) -> bytes:
    """The columns of some postings, byte by byte of the same weight (high bytes are mostly zeros)."""
    return to.compress(b"".join(np.ascontiguousarray(c.view(np.uint8).reshape(len(c), -1).T).tobytes() for c in postings))


def _unpack(blob: bytes) -> list[np.ndarray]:
    raw = np.frombuffer(zstandard.decompress(blob), np.uint8)
    k, at, out = len(raw) // _POSTING.itemsize, 0, []
    for name in _POSTING.names:
        kind = _POSTING[name]
        out.append(np.ascontiguousarray(raw[at:at + k * kind.itemsize].reshape(kind.itemsize, k).T).view(kind).ravel())
        at += k * kind.itemsize
    return out


def _postings(docs: DataFrame, width: int, share: Share, sizes: Sizes, sketch, keys: np.ndarray) -> DataFrame:
    """The leading shingles of each set, with its size and their places in the common order, packed by partition.

    Of a shingle 48 bits are kept: two that agree in them only make another candidate. One that the sketch sees far
    above the usual gets several sorted runs, dealt by set (`run` from 1 on; 0 where there is one run only).
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = sketch.value
        noise = float(np.median(counts))
        noise += 6 * noise ** 0.5
        to = zstandard.ZstdCompressor(1)
        seen: set[bytes] = set()
        held: list[tuple] = []
        size = 0

        def flush():
            cols = [np.concatenate(c) for c in zip(*held)]
            at = (cols[0] + cols[1].astype(np.int64) * 0x9E3779B1) % len(keys)
            order = np.argsort(at << 48 | cols[0])
            cols, at = [c[order] for c in cols], at[order]
            starts = np.flatnonzero(np.append(True, at[1:] != at[:-1]))
            blobs = [_pack([c[i:j] for c in cols], to) for i, j in zip(starts, np.append(starts[1:], len(at)))]
            return pa.RecordBatch.from_arrays([pa.array(keys[at[starts]]), pa.array(blobs, pa.binary())],
                                              names=["at", "postings"])

        for _, _, items in _sets(batches, width):
            n = len(items)
            if not n or (sig := _signature(items)) in seen:
                continue
            seen.add(sig)
            c = counts[(items & np.uint64(CELLS - 1)).astype(np.int64)]
            # by count, then by hash: items come sorted, and the sort is stable
            order = np.argsort(c.astype(np.uint64) << np.uint64(32) | items >> np.uint64(32), kind="stable")
            lead = order[:n - int(share.least(np.int64(n))) + 1]
            node = np.frombuffer(sig, ">i8")[1].astype(np.int64)
            runs = 1 + (np.maximum(c[lead] - noise, 0) // sizes.run).astype(np.int64)
            k = len(lead)
            place = np.where(runs > 1, 1 + int(node) % runs, 0).astype(np.int32)
            held.append(((items[lead] >> np.uint64(16)).view(np.int64), place, np.full(k, n, np.int32),
                         np.arange(k, dtype=np.int32), np.full(k, node)))
            size += k
            if size >= HELD:
                yield flush()
                held, size = [], 0
        if held:
            yield flush()
    return docs.select("text").mapInArrow(run, "at long, postings binary")


def _dealt(spark, n: int) -> np.ndarray:
    """For each of `n` partitions a number that repartition(n, ...) sends there."""
    first = spark.range(32 * n).groupBy(F.pmod(F.hash("id"), F.lit(n)).alias("at")).agg(F.min("id").alias("id")).collect()
    out = np.arange(n)
    for r in first:  # a partition that none of them reaches stays empty
        out[r["at"]] = r["id"]
    return out


_MET = "w long, tile long, low long, high long, body binary"
_TILE = np.dtype([("n", np.int32), ("pos", np.int32), ("node", np.int64)])
#: Links in one row, columns up to this length are compared all at once.
ROW, SHORT = 1 << 16, 8


def _meet_columns(batches: Iterator[pa.RecordBatch], most: int, share: Share) -> Iterator[pa.RecordBatch]:
    """A partition's postings to links of the sets that meet in a column and may reach the share.

    Columns longer than `most` are cut into tiles; these go on, to be compared with each other.
    """
    blobs = [x.as_py() for b in batches for x in b.column(1)]
    if not blobs:
        return
    w, run, n, pos, node = (np.concatenate(c) for c in zip(*map(_unpack, blobs)))
    del blobs
    order = np.lexsort((node, n, run, w))
    w, run, n, pos, node = (c[order] for c in (w, run, n, pos, node))
    same = np.zeros(len(w), bool)  # one set found in several tasks
    same[1:] = (w[1:] == w[:-1]) & (run[1:] == run[:-1]) & (node[1:] == node[:-1])
    w, run, n, pos, node = (c[~same] for c in (w, run, n, pos, node))
    new = np.append(True, (w[1:] != w[:-1]) | (run[1:] != run[:-1]))
    starts = np.flatnonzero(new)
    length = np.diff(np.append(starts, len(w)))[np.cumsum(new) - 1]  # of the posting's column
    nth = (np.arange(len(w)) - np.repeat(starts, np.diff(np.append(starts, len(w))))) // most
    n, pos = n.astype(np.int64), pos.astype(np.int64)
    links = []

    # short columns all at once: each posting with the one `gap` places on
    some = np.flatnonzero((length > 1) & (length <= min(SHORT, most)))
    for gap in range(1, min(SHORT, most)):
        i, j = some[:-gap], some[gap:]
        here = (w[i] == w[j]) & (run[i] == run[j])
        i, j = i[here], j[here]
        near = np.minimum(n[i] - pos[i], n[j] - pos[j]) >= share.need(n[i], n[j])
        links.append((node[i[near]], node[j[near]]))

    at = np.flatnonzero((new | np.append(True, nth[1:] != nth[:-1])) & (length > min(SHORT, most)))
    ends = np.minimum(at + most, starts[np.searchsorted(starts, at, "right") - 1] + length[at])
    tiles = []
    for a, e in zip(at.tolist(), ends.tolist()):
        i, j = np.nonzero(np.triu(_may_reach(n[a:e], pos[a:e], n[a:e], pos[a:e], share), 1))
        if len(i):
            x, y = _forest(i, j, e - a)
            links.append((node[a:e][x], node[a:e][y]))
        if run[a] or length[a] > most:
            body = np.empty(e - a, _TILE)
            body["n"], body["pos"], body["node"] = n[a:e], pos[a:e], node[a:e]
            tiles.append((int(w[a]), int(run[a]) << 32 | int(nth[a]), int(n[a]), int(n[e - 1]), body.tobytes()))
    # of a run up to SHORT long, the one tile
    for a in np.flatnonzero(new & (run > 0) & (length <= min(SHORT, most))).tolist():
        e = a + int(length[a])
        body = np.empty(e - a, _TILE)
        body["n"], body["pos"], body["node"] = n[a:e], pos[a:e], node[a:e]
        tiles.append((int(w[a]), int(run[a]) << 32, int(n[a]), int(n[e - 1]), body.tobytes()))

    kinds = [pa.int64()] * 4 + [pa.binary()]
    names = ["w", "tile", "low", "high", "body"]
    for k in range(0, len(tiles), 256):
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*tiles[k:k + 256]), kinds)], names=names)
    a, b = (np.concatenate(x) for x in zip(*links)) if links else (np.empty(0, np.int64),) * 2
    a, b = np.minimum(a, b), np.maximum(a, b)
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    both = np.column_stack([a, b])[np.append(True, (a[1:] != a[:-1]) | (b[1:] != b[:-1]))[:len(a)]]
    for k in range(0, len(both), ROW):
        yield pa.RecordBatch.from_arrays([*[pa.nulls(1, pa.int64())] * 4, pa.array([both[k:k + ROW].tobytes()], pa.binary())],
                                         names=names)


def _met(postings: DataFrame, n: int, most: int, share: Share) -> DataFrame:
    """Rows of links (`w` is null), and the tiles of columns that have several."""
    return postings.repartition(n, "at").mapInArrow(partial(_meet_columns, most=most, share=share), _MET)


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


def _may_reach(n, pos, m, qos, share: Share) -> np.ndarray:
    """Whether sets whose first common shingle is at `pos` and `qos` can reach the share (matrix)."""
    need = share.need(n[:, None], m[None, :])
    return np.minimum((n - pos)[:, None], (m - qos)[None, :]) >= need


def _pair(a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def _unlink(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        for x in b.column(0):
            both = np.frombuffer(x.as_py(), np.int64).reshape(-1, 2)
            yield _pair(both[:, 0].copy(), both[:, 1].copy())


def _meet_tiles(batches: Iterator[pa.RecordBatch], share: Share) -> Iterator[pa.RecordBatch]:
    """Forests of the pairs that meet in two tiles of a column and may reach the share."""
    for b in batches:
        got = []
        for x, y in zip(b.column(0), b.column(1)):
            x, y = np.frombuffer(x.as_py(), _TILE), np.frombuffer(y.as_py(), _TILE)
            (n, pos), (m, qos) = ((t["n"].astype(np.int64), t["pos"].astype(np.int64)) for t in (x, y))
            i, j = np.nonzero(_may_reach(n, pos, m, qos, share))
            if len(i):
                node = np.concatenate([x["node"], y["node"]])
                i, j = _forest(i, j + len(x), len(node))
                got.append((node[i], node[j]))
        if got:
            yield _pair(*(np.concatenate(x) for x in zip(*got)))


def _candidates(met: DataFrame, share: Share) -> DataFrame:
    """Links (a, b) whose components are those of all candidate pairs."""
    links = "a long, b long"
    own = met.filter("w is null").select("body").mapInArrow(_unlink, links)
    tiles = met.filter("w is not null")
    spans = tiles.select("w", "tile", "low", "high")
    other = spans.select("w", *(F.col(x).alias(f"{x}2") for x in ("tile", "low", "high")))
    pairs = (spans.join(other, "w").filter("tile < tile2")
             .filter(f"high2 * {share.den} >= low * {share.num} and high * {share.den} >= low2 * {share.num}")
             .select("w", "tile", "tile2"))
    right = tiles.select("w", F.col("tile").alias("tile2"), F.col("body").alias("body2"))
    cross = pairs.join(tiles.select("w", "tile", "body"), ["w", "tile"]).join(right, ["w", "tile2"]).select("body", "body2")
    return own.unionByName(cross.mapInArrow(partial(_meet_tiles, share=share), links))


def _parity(items: np.ndarray) -> bytes:
    """Whether the number of a set's hashes in each of its cells is odd; from n to 2n cells, a power of two."""
    cells = max(64, 1 << (len(items) - 1).bit_length())
    odd = np.bincount((items & np.uint64(cells - 1)).astype(np.int64), minlength=cells) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def _close(n: np.ndarray, bits: list[bytes], share: Share) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that may reach the share: where parities differ, a shingle is in one set only.

    Sets that reach it have as many cells, or one twice as many, whose halves are then laid over each other.
    """
    length = np.array([len(x) for x in bits])
    got = []
    for cells in np.unique(length).tolist():
        a, c = np.flatnonzero(length == cells), np.flatnonzero(length == 2 * cells)
        rows = np.concatenate([a, c])
        own = np.frombuffer(b"".join(bits[k] for k in a), np.uint64).reshape(len(a), -1)
        twice = np.frombuffer(b"".join(bits[k] for k in c), np.uint64).reshape(len(c), 2, own.shape[1])
        both = np.concatenate([own, twice[:, 0] ^ twice[:, 1]])
        differ = np.zeros((len(a), len(rows)), np.int64)
        for k in range(own.shape[1]):
            differ += np.bitwise_count(own[:, k, None] ^ both[None, :, k])
        x, y = n[a][:, None], n[rows][None, :]
        need = share.need(x, y)
        near = (x + y - differ >= 2 * need) & (np.minimum(x, y) >= need)
        i, j = np.nonzero(np.triu(near, 1))  # the first columns are the rows themselves
        got.append((a[i], rows[j]))
    return tuple(np.concatenate(x) for x in zip(*got))


def _product(sizes: np.ndarray, items: list[np.ndarray], share: Share) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows that reach the share, from the product of the incidence matrix with its transpose."""
    rows = np.repeat(np.arange(len(items)), sizes)
    _, column, times = np.unique(np.concatenate(items), return_inverse=True, return_counts=True)
    shared = times > 1
    rows, column = rows[shared[column]], (np.cumsum(shared) - 1)[column[shared[column]]]
    order = np.argsort(column, kind="stable")
    rows, column = rows[order], column[order]
    need = share.need(sizes[:, None], sizes[None, :])
    np.fill_diagonal(need, np.iinfo(np.int64).max)
    overlap = np.zeros(need.shape)
    left = np.bincount(rows, minlength=len(items))
    for at in range(0, int(shared.sum()), SLICE):
        alive = (overlap + np.minimum(left[:, None], left[None, :]) >= need).any(axis=1)
        if not alive.any():
            break
        a, b = np.searchsorted(column, [at, at + SLICE])
        r, c = rows[a:b], column[a:b] - at
        left = left - np.bincount(r, minlength=len(items))
        live = np.flatnonzero(alive)
        place = np.cumsum(alive) - 1
        part = np.zeros((len(live), SLICE if at + SLICE <= shared.sum() else int(shared.sum()) - at), np.float32)
        part[place[r[alive[r]]], c[alive[r]]] = 1
        overlap[np.ix_(live, live)] += part @ part.T
    return np.nonzero(np.triu(overlap >= need, 1))


def _linked(n: np.ndarray, side: np.ndarray, near, share: Share, sizes: Sizes) -> tuple[np.ndarray, np.ndarray]:
    """Forest of the pairs of rows that `near(rows)` finds, of one block or between two (`side` 0 and 1).

    Rows are compared tile by tile. Tiles whose sizes do not agree, or whose rows are one component already, are
    passed over, so that a large group of near copies costs a few rounds of tiles, not all pairs of them.
    """
    order = np.lexsort((n, side))
    at, tiles = 0, ([], [])
    while at < len(order):
        most = order[at:at + sizes.sets]
        fit = (np.cumsum(n[most]) <= sizes.items) & (side[most] == side[most[0]])
        tile = most[:max(1, int(fit.argmin()) if not fit.all() else len(fit))]
        tiles[side[tile[0]]].append(tile)
        at += len(tile)
    first, second = tiles
    pairs = ((x, y) for x in first for y in second) if second else (
        (x, y) for k, x in enumerate(first) for y in first[k:])
    label = np.arange(len(n))
    for x, y in pairs:
        if n[x].max() < share.least(n[y].min()) or n[y].max() < share.least(n[x].min()):
            continue
        rows = x if x is y else np.concatenate([x, y])
        if (label[rows] == label[rows[0]]).all():
            continue
        i, j = near(rows)
        if len(i):
            i, j = _forest(label[rows[i]], label[rows[j]], len(n))
            to = np.arange(len(n))
            to[j] = i
            label = to[label]
    member = np.flatnonzero(label != np.arange(len(n)))
    return label[member], member


_KEY = ["root", "s", "t", "s2", "t2"]


def _groups(batches: Iterator[pa.RecordBatch]) -> Iterator[list[tuple]]:
    """The rows of each key, without it, of batches sorted by key (the first columns)."""
    key, rows = None, []
    for b in batches:
        for row in zip(*(c.to_pylist() for c in b.columns)):
            if key != row[:len(_KEY)]:
                if rows:
                    yield rows
                key, rows = row[:len(_KEY)], []
            rows.append(row[len(_KEY):])
    if rows:
        yield rows


def _refine(batches: Iterator[pa.RecordBatch], share: Share, sizes: Sizes) -> Iterator[pa.RecordBatch]:
    """Rows (side, node, n, bits) of each pair of blocks to a forest of the links that parities allow."""
    for rows in _groups(batches):
        side, node, n, bits = (list(c) for c in zip(*rows))
        n = np.array(n)
        i, j = _linked(n, np.array(side), lambda k: _close(n[k], [bits[x] for x in k], share), share, sizes)
        if len(i):
            node = np.array(node)
            yield _pair(node[i], node[j])


def _multiply(batches: Iterator[pa.RecordBatch], share: Share, sizes: Sizes, width: int) -> Iterator[pa.RecordBatch]:
    """Rows (side, packed text) of each pair of blocks to a forest of its links."""
    for rows in _groups(batches):
        firsts: dict[bytes, tuple] = {}
        for side, blob in rows:
            items = shingles(zstandard.decompress(blob).decode("utf-8"), width)
            firsts.setdefault(_signature(items), (side, items))  # repeated rows count once
        if len(firsts) < 2:
            continue
        nodes, (side, items) = list(firsts), zip(*firsts.values())
        n = np.array([len(x) for x in items])
        i, j = _linked(n, np.array(side), lambda k: _product(n[k], [items[x] for x in k], share), share, sizes)
        if len(i):
            yield pa.RecordBatch.from_arrays([pa.array([nodes[k] for k in i], pa.binary()),
                                              pa.array([nodes[k] for k in j], pa.binary())], names=["a", "b"])


_END = "struct<root: bigint, s: int, t: int, s2: int, t2: int, side: int>"


def _needed_texts(docs: DataFrame, plan: DataFrame) -> DataFrame:
    """The packed text of each set in `plan`, from its row (doc_id, text hash), once for each of its `ends`.

    Only texts that a candidate needs are shuffled, once, and once more to their blocks: a Bloom filter of their rows
    drops the others. A packed text is smaller than its set of 64-bit hashes.
    """
    field = docs.sparkSession.sparkContext.broadcast(key_field(plan.select(F.xxhash64("doc_id", "th"))))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        to = zstandard.ZstdCompressor(3)
        for b in batches:
            b = b.filter(pa.array(among(b.column(2).to_numpy(), field.value)))
            blobs = [to.compress(x.as_buffer()) if x.is_valid else b"" for x in b.column(3)]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(blobs, pa.binary())],
                                             names=["d", "h", "packed"])
    rows = docs.select(F.col("doc_id").cast("long").alias("d"), F.xxhash64("text").alias("h"), "text")
    texts = rows.select("d", "h", F.xxhash64("d", "h").alias("k"), "text").mapInArrow(run, "d long, h long, packed binary")
    at = texts["d"].eqNullSafe(plan["doc_id"]) & (texts["h"] == plan["th"])
    return texts.join(plan.hint("merge"), at).select("packed", F.inline("ends"))


def _blocks(members: DataFrame, share: Share, sizes: Sizes, room: int) -> DataFrame:
    """`members` (root, n, ...) with their block (s, t): one for a small component, else by size class and hash.

    A class gets up to four blocks, more only where these would have more than `room` times the usual shingles: a
    member goes to each block that its own is compared with.
    """
    step = float(np.log(share.den / share.num))
    tiles = F.greatest(F.ceil(F.count(F.lit(1)) / sizes.sets), F.ceil(F.sum("n") / sizes.items))
    most = F.greatest(F.lit(4), F.ceil(F.sum("n") / (sizes.items * room)))
    whole = members.groupBy("root").agg(tiles.alias("cuts"))
    classed = members.join(whole, "root").withColumn(
        "s", F.when(F.col("cuts") > 1, F.floor(F.log("n") / step)).otherwise(F.lit(0)).cast("int"))
    cuts = classed.groupBy("root", "s").agg(F.least(tiles, most).alias("tiles"))
    return classed.join(cuts, ["root", "s"]).select(
        *members.columns, "s", F.pmod(F.xxhash64("node"), F.col("tiles")).cast("int").alias("t"),
        (F.col("cuts") > 1).alias("cut"))


def _placed(blocks: DataFrame, columns: list[str]) -> DataFrame:
    """`columns` of each member, once for its own block and once for each pair of blocks that it is in."""
    own = blocks.select("root", "s", "t", F.col("s").alias("s2"), F.col("t").alias("t2"), F.lit(0).alias("side"), *columns)
    cut = blocks.filter("cut")
    there = cut.select("root", "s", "t").distinct()
    other = there.select("root", F.col("s").alias("s2"), F.col("t").alias("t2"))
    pairs = there.join(other, "root").filter("(s2 = s and t2 > t) or s2 = s + 1")
    sides = (pairs.select("*", F.col("s").alias("bs"), F.col("t").alias("bt"), F.lit(0).alias("side"))
             .unionByName(pairs.select("*", F.col("s2").alias("bs"), F.col("t2").alias("bt"), F.lit(1).alias("side"))))
    members = cut.select("root", F.col("s").alias("bs"), F.col("t").alias("bt"), *columns)
    return own.unionByName(members.join(sides, ["root", "bs", "bt"]).drop("bs", "bt").select(own.columns))


def links(docs: DataFrame, classes: DataFrame, sketch, width: int, share: Share, sizes: Sizes) -> DataFrame:
    """Links (a, b) between sets that give the components of all pairs reaching the share."""
    n = shuffle_width(docs.sparkSession)
    size = classes.agg(F.sum("n")).first()[0] or 0
    parts = min(max(n, -(-size * (share.den - share.num) // share.den >> 20)), (1 << 15) - 1)
    postings = _postings(docs, width, share, sizes, sketch, _dealt(docs.sparkSession, parts))
    roots = settle(components(_candidates(settle(_met(postings, parts, sizes.tile, share)), share)))

    def dealt(rows: DataFrame) -> DataFrame:
        return rows.repartition(n, *_KEY).sortWithinPartitions(*_KEY)

    own = ["sig", "node", "n", "doc_id", "th"]
    members = roots.join(classes, "node").select("root", *own, "bits")
    near = dealt(_placed(settle(_blocks(members, share, sizes, 64)), ["node", "n", "bits"])).mapInArrow(
        partial(_refine, share=share, sizes=sizes), "a long, b long")
    members = components(near).join(classes, "node").select("root", *own)
    ends = _placed(settle(_blocks(members, share, sizes, 8)), ["sig", "doc_id", "th"])
    plan = settle(ends.groupBy("sig", "doc_id", "th").agg(F.collect_list(F.struct(*_KEY, "side")).alias("ends")))
    return dealt(_needed_texts(docs, plan).select(*_KEY, "side", "packed")).mapInArrow(
        partial(_multiply, share=share, sizes=sizes, width=width), "a binary, b binary")


def similar(docs: DataFrame, width: int = 4, num: int = 85, den: int = 100, sizes: Sizes = Sizes()) -> DataFrame:
    """doc_id, n_shingles and component_id of every document; links at num/den of intersection over union."""
    share = Share(num, den)
    profile = settle(_profile(docs, width))
    rows = profile.filter("part is null").select("doc_id", "th", "n", "sig")
    classes = settle(profile.filter("sig is not null").groupBy("sig", "n").agg(
        F.min(F.struct("doc_id", "th")).alias("at"), F.min("doc_id").alias("head"), F.max("bits").alias("bits"))
        .select("sig", _node_of("sig").alias("node"), "n", "at.doc_id", "at.th", "head", "bits"))
    sketch = docs.sparkSession.sparkContext.broadcast(_sketch(profile))
    roots = components(links(docs, classes, sketch, width, share, sizes))
    rooted = classes.join(roots, classes["sig"] == roots["node"], "left").select(
        "sig", "head", F.coalesce("root", "sig").alias("root"))
    least = rooted.groupBy("root").agg(F.min("head").alias("component_id"))
    of = rooted.join(least, "root").select("sig", "component_id")
    return (rows.join(of, "sig", "left")
            .select("doc_id", F.col("n").alias("n_shingles"),
                    F.when(F.col("sig").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id")))
