"""Embedding whitening: principal components of all distinct vectors, scaled to unit variance.

Entries become whole numbers, y = floor(64 c), so that counts, sums and products are exact whatever the
partitioning. Distinct vectors are the fit list. Its sums per dimension are added up in tasks; then the scatter
about the whole number nearest to each mean, moved by what is left of the mean (at most one half), gives the
covariance V. A pivoted Cholesky factor of V (V = G G', G triangular up to the pivots) goes straight into
one-sided Jacobi: rotations make the columns of G orthogonal, their squared norms are the eigenvalues and the
normalised columns the components. Only sums, the factor and the components, whose size depends on the
dimension alone, are ever held whole.

Edge cases: vectors that are null, empty or hold null or non-finite entries take no part; entries beyond 2^50 / 64
count as that bound; vectors of different lengths are whitened apart, each length by its own fit list; where V has
a lower rank than the components asked for (a single distinct vector has rank 0), only those of its rank are
returned; equal eigenvalues come in any order; rows repeating a vec_id or a vector each get their results, rows
without vec_id too; `deviation` is null where it does not fit a long; an empty table gives no rows; extra columns
are ignored. A task holds one d by d matrix; the sum of a dimension over the fit list must fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import settle

SCALE, LIMIT = 64, 1 << 50
#: Bytes of sums and components that are broadcast at once; lengths beyond it follow in further rounds.
SENT = 64 << 20


def _whole(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(length, rows, y) of the valid vectors of a batch, one item per length; y is int64, rows by length."""
    sizes = np.array(column.value_lengths().fill_null(0))
    flat = column.flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)  # null entries become NaN
    starts = np.append(0, np.cumsum(sizes)[:-1]) if len(sizes) else sizes
    for d in np.unique(sizes[sizes > 0]).tolist():
        rows = np.flatnonzero(sizes == d)
        c = flat[starts[rows][:, None] + np.arange(d)]
        good = np.isfinite(c).all(axis=1)
        if good.any():
            yield d, rows[good], np.floor(np.clip(c[good] * SCALE, -LIMIT, LIMIT)).astype(np.int64)


def _packed(y: np.ndarray) -> list[bytes]:
    """Each row in the narrowest of 2, 4 and 8 bytes an entry; equal rows give equal bytes."""
    most = np.abs(y).max(axis=1)
    out: list[bytes] = [b""] * len(y)
    for kind, low, high in ((np.int16, -1, 1 << 15), (np.int32, (1 << 15) - 1, 1 << 31), (np.int64, (1 << 31) - 1, 1 << 62)):
        for k in np.flatnonzero((most > low) & (most < high)).tolist():
            out[k] = y[k].astype(kind).tobytes()
    return out


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[int, np.ndarray]]:
    """(length, y) of a batch of packed vectors (columns d, y), one item per length and width."""
    dims, blobs = batch.column(0).to_numpy(), batch.column(1).to_pylist()
    wide = np.fromiter((len(x) for x in blobs), np.int64, len(blobs)) // dims
    for d, w in sorted(set(zip(dims.tolist(), wide.tolist()))):
        own = b"".join(blobs[k] for k in np.flatnonzero((dims == d) & (wide == w)))
        yield d, np.frombuffer(own, np.dtype(f"i{w}")).reshape(-1, d).astype(np.int64)


def fit_list(vectors: DataFrame, column: str = "embedding") -> DataFrame:
    """d (length) and y (packed) of every distinct valid vector."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for d, _, y in _whole(b.column(0)):
                yield pa.RecordBatch.from_arrays([pa.array([d] * len(y), pa.int32()), pa.array(_packed(y), pa.binary())],
                                                 names=["d", "y"])
    return vectors.select(column).mapInArrow(run, "d int, y binary").distinct()


def _added(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (d, i, n, v) to one for each (d, i): n and the float64 or int64 numbers of v added up."""
    total: dict[tuple, list] = {}
    for b in batches:
        for d, i, n, v in zip(*(b.column(k).to_pylist() for k in range(4))):
            own = np.frombuffer(v, np.int64 if i < 0 else np.float64)
            if (d, i) in total:
                total[d, i][0] += n
                total[d, i][1] = total[d, i][1] + own
            else:
                total[d, i] = [n, own]
    if total:
        yield _rows([(d, i, n, v) for (d, i), (n, v) in total.items()])


_ADDED = "d int, i int, n long, v binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    d, i, n, v = zip(*rows)
    return pa.RecordBatch.from_arrays([pa.array(d, pa.int32()), pa.array(i, pa.int32()), pa.array(n, pa.int64()),
                                       pa.array([x.tobytes() for x in v], pa.binary())], names=["d", "i", "n", "v"])


def _total(fit: DataFrame, share) -> DataFrame:
    """(d, i, n, v): `share(d, y)` of each task's vectors, {i: numbers}, added up over the tasks.

    Row i < 0 holds whole numbers. A task sends one row for each length and i.
    """
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, list] = {}
        for b in batches:
            for d, y in _unpacked(b):
                own = share(d, y)
                if d not in total:
                    total[d] = [0, own]
                else:
                    total[d][1] = {i: total[d][1][i] + v for i, v in own.items()}
                total[d][0] += len(y)
        for d, (n, own) in total.items():
            yield _rows([(d, i, n, v) for i, v in own.items()])
    return fit.select("d", "y").mapInArrow(run, _ADDED).repartition("d", "i").mapInArrow(_added, _ADDED)


def cholesky(v: np.ndarray) -> np.ndarray:
    """G (d by rank) with v = G G': a Cholesky factor with the largest remaining diagonal as pivot."""
    rest, columns = v.astype(np.float64).copy(), []
    floor = len(v) * np.finfo(np.float64).eps * max(float(np.diag(v).max(initial=0)), 0)
    while len(columns) < len(v):
        p = int(np.argmax(np.diag(rest)))
        if rest[p, p] <= floor:
            break
        g = rest[:, p] / np.sqrt(rest[p, p])
        columns.append(g)
        rest -= np.outer(g, g)
        rest[p, :] = rest[:, p] = 0
    return np.stack(columns, axis=1) if columns else np.zeros((len(v), 0))


def jacobi(g: np.ndarray, sweeps: int = 60) -> np.ndarray:
    """`g` with its columns rotated until they are orthogonal; a round rotates disjoint pairs at once."""
    r = g.shape[1]
    g = np.concatenate([g, np.zeros((len(g), r % 2))], axis=1).T.copy()  # rows are easier to gather
    order = np.arange(len(g))
    for _ in range(sweeps):
        worst = 0.0
        for _ in range(max(len(g) - 1, 0)):
            half = len(g) // 2
            p, q = order[:half], order[half:][::-1]
            x, y = g[p], g[q]
            a, b, c = (x * x).sum(axis=1), (y * y).sum(axis=1), (x * y).sum(axis=1)
            size = np.sqrt(a * b)
            off = np.divide(np.abs(c), size, out=np.zeros_like(c), where=size > 0)
            worst = max(worst, float(off.max(initial=0)))
            turn = off > 1e-15
            zeta = np.divide(b - a, 2 * c, out=np.zeros_like(c), where=turn)
            t = np.where(zeta >= 0, 1, -1) / (np.abs(zeta) + np.sqrt(1 + zeta * zeta))
            cos = np.where(turn, 1 / np.sqrt(1 + t * t), 1)
            sin = np.where(turn, cos * t, 0)
            g[p] = cos[:, None] * x - sin[:, None] * y
            g[q] = sin[:, None] * x + cos[:, None] * y
            order = np.concatenate([order[:1], order[-1:], order[1:-1]])  # all pairs meet once a sweep
        if worst <= 1e-14:
            break
    return g.T[:, :r] if r % 2 == 0 else _without_zero(g.T, r)


def _without_zero(g: np.ndarray, r: int) -> np.ndarray:
    keep = np.sort(np.argsort(-(g * g).sum(axis=0), kind="stable")[:r])
    return g[:, keep]


def components(v: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """The largest eigenvalues of v, falling, and their unit vectors as columns."""
    g = jacobi(cholesky(v))
    e = (g * g).sum(axis=0)
    order = np.argsort(-e, kind="stable")
    order = order[e[order] > 0][:most]
    return e[order], g[:, order] / np.sqrt(e[order])


def _centred(y: np.ndarray, n: int, s: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """y minus the whole number nearest to each mean (as float64, exact), and what is left of the mean."""
    mid = (2 * s + n) // (2 * n)
    return (y - mid).astype(np.float64), (s - n * mid) / n


def _deviation(y: np.ndarray, n: int, s: np.ndarray) -> list[int | None]:
    """Sum of (n y - s)^2 of each row, exact; None where a long cannot hold it."""
    most = n * int(np.abs(y).max(initial=0)) + int(np.abs(s).max(initial=0))
    if most * most * y.shape[1] < 1 << 63:
        z = n * y - s
        return (z * z).sum(axis=1).tolist()
    z = n * y.astype(object) - s.astype(object)
    return [x if x < 1 << 63 else None for x in (z * z).sum(axis=1).tolist()]


def _rounds(sizes: list[tuple[int, int]]) -> list[list[int]]:
    """Lengths in groups whose bytes stay within SENT (a length beyond it is a group of its own)."""
    out, room = [], 0
    for d, size in sorted(sizes):
        if not out or size > room:
            out.append([])
            room = SENT
        out[-1].append(d)
        room -= size
    return out


def _model(fit: DataFrame, sums: DataFrame, most: int):
    """{d: (n, s, eigenvalues, components, trace, identity error)} of the lengths in `sums`."""
    sc = fit.sparkSession.sparkContext
    means = sc.broadcast({r["d"]: (r["n"], np.frombuffer(r["v"], np.int64)) for r in sums.collect()})

    def scatter(d, y):
        c, _ = _centred(y, *means.value[d])
        return dict(enumerate(c.T @ c))

    def solve(rows: pd.DataFrame) -> pd.DataFrame:
        d, n = int(rows["d"].iloc[0]), int(rows["n"].iloc[0])
        m = np.stack([np.frombuffer(x) for x in rows.sort_values("i")["v"]])
        _, rest = _centred(np.zeros((1, d), np.int64), *means.value[d])
        v = m / n - np.outer(rest, rest)
        e, w = components((v + v.T) / 2, most)
        return pd.DataFrame([(d, float(np.trace(v)), e.tobytes(), w.tobytes())], columns=["d", "trace", "e", "w"])

    # one row for each of a length's dimensions: the matrix itself
    solved = settle(_total(fit, scatter).groupBy("d").applyInPandas(solve, "d int, trace double, e binary, w binary"))
    found = {}
    for r in solved.collect():
        e = np.frombuffer(r["e"])
        found[r["d"]] = (*means.value[r["d"]], e, np.frombuffer(r["w"]).reshape(r["d"], len(e)), r["trace"])
    model = sc.broadcast(found)

    def product(d, y):
        z = project(y, *model.value[d][:4])
        return {0: z.T @ z, 1: z.sum(axis=0)}

    error = {}
    got: dict[int, dict] = {}
    for r in _total(fit, product).collect():  # `most` squared numbers for each length
        got.setdefault(r["d"], {})[r["i"]] = np.frombuffer(r["v"]) / r["n"]
    for d, own in got.items():
        k = len(found[d][2])
        cov = own[0].reshape(k, k) - np.outer(own[1], own[1])
        error[d] = float(np.abs(cov - np.eye(k)).max(initial=0))
    return sc.broadcast({d: (*x, error[d]) for d, x in found.items()})


def project(y: np.ndarray, n: int, s: np.ndarray, e: np.ndarray, w: np.ndarray) -> np.ndarray:
    """The vectors' coordinates on the components, each of unit variance over the fit list."""
    c, rest = _centred(y, n, s)
    return (c - rest) @ w / np.sqrt(e)


_OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, "
        "identity_error double")


def whiten(vectors: DataFrame, most: int = 16, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """A row for each valid vector and each of the first `most` components (see the module)."""
    fit = settle(fit_list(vectors, column))
    sums = settle(_total(fit, lambda d, y: {-1: y.sum(axis=0)}).filter("n > 1"))
    sizes = [(r["d"], 16 * r["d"] * (most + 1)) for r in sums.select("d").collect()]
    out = None
    for dims in _rounds(sizes):
        own = F.col("d").isin(dims)
        model = _model(fit.filter(own), sums.filter(own), most)

        def run(batches: Iterator[pa.RecordBatch], model=model) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for d, rows, y in _whole(b.column(1)):
                    if d not in model.value:
                        continue
                    n, s, e, w, trace, error = model.value[d]
                    k, m = len(e), len(rows)
                    yield pa.RecordBatch.from_arrays(
                        [b.column(0).take(pa.array(np.repeat(rows, k))),
                         pa.array(np.tile(np.arange(1, k + 1), m), pa.int32()), pa.array(np.full(m * k, n), pa.int64()),
                         pa.array(_deviation(y, n, s), pa.int64()).take(pa.array(np.repeat(np.arange(m), k))),
                         pa.array(project(y, n, s, e, w).reshape(-1)), pa.array(np.tile(e / trace, m) if k else []),
                         pa.array(np.full(m * k, error))],
                        names=["vec_id", "component", "n", "deviation", "whitened", "explained", "identity_error"])

        part = vectors.select(F.col(key).cast("long").alias("vec_id"), column).mapInArrow(run, _OUT)
        out = part if out is None else out.unionByName(part)
    return out if out is not None else vectors.sparkSession.createDataFrame([], _OUT)
