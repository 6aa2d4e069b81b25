"""Whitening against numpy's eigenvectors on whole tables, exact sums, odd vectors and lengths."""
from fractions import Fraction

import numpy as np
import pytest

from feedlens.llm import whitening

SCHEMA = "vec_id long, embedding array<float>"


def brute(vectors, most=16):
    """(n, S, covariance, eigenvalues, vectors, {row: x}) of one length's vectors, by numpy."""
    x = {k: np.array([int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v]) for k, v in vectors}
    fit = np.array(sorted({tuple(v) for v in x.values()}))
    s = fit.sum(axis=0)
    c = fit - s / len(fit)
    v = c.T @ c / len(fit)
    e, w = np.linalg.eigh(v)
    return len(fit), s, v, e[::-1][:most], w[:, ::-1][:, :most], x


def check(rows, vectors, most=16):
    n, s, v, e, w, x = brute(vectors, most)
    by = {}
    for r in rows:
        by.setdefault(r["vec_id"], []).append(r)
    assert set(by) == set(x)
    for i, own in by.items():
        own.sort(key=lambda r: r["component"])
        assert [r["component"] for r in own] == list(range(1, len(e) + 1))
        assert {(r["n"], r["deviation"]) for r in own} == {
            (n, sum((n * int(a) - int(b)) ** 2 for a, b in zip(x[i], s)))}
        want = (x[i] - s / n) @ w / np.sqrt(e)
        np.testing.assert_allclose(np.abs([r["whitened"] for r in own]), np.abs(want), rtol=1e-7, atol=1e-7)
        np.testing.assert_allclose([r["explained"] for r in own], e / np.trace(v), rtol=1e-9)
    assert all(r["identity_error"] < 1e-9 for r in rows)


def test_query_against_numpy(spark, sf_dir):
    from feedlens.llm.queries import QUERIES
    from feedlens.sources.tables import table
    vectors = [(r["vec_id"], r["embedding"]) for r in table(spark, sf_dir, "embeddings").collect()]
    rows = QUERIES["op12_whitening"](spark, sf_dir).collect()
    assert len(rows) == 16 * len(vectors)
    check(rows, vectors)
    z = np.zeros((len(vectors), 16))
    at = {k: i for i, (k, _) in enumerate(vectors)}
    for r in rows:
        z[at[r["vec_id"]], r["component"] - 1] = r["whitened"]
    firsts = np.unique(np.round(z, 9), axis=0)  # one sign for all rows: the coordinates themselves are uncorrelated
    np.testing.assert_allclose(np.cov(firsts.T, bias=True), np.eye(16), atol=1e-6)


def test_odd_vectors_and_lengths(spark):
    rng = np.random.default_rng(5)
    a = [(i, [float(x) for x in rng.normal(size=5) * [4, 2, 1, .5, .25]]) for i in range(40)]
    b = [(100 + i, [float(x) for x in rng.normal(size=3)]) for i in range(30)]
    odd = [(200, None), (201, []), (202, [1.0, None, 2.0]), (203, [1.0, float("nan"), 2.0]),
           (204, [float("inf"), 1.0, 2.0]), (205, [1.0, 2.0])]  # the last: one vector of its length, rank 0
    rows = a + a[:1] * 30 + b + odd + [(300, a[0][1])]
    df = spark.createDataFrame(rows, SCHEMA)
    for name in ("n", "component", "d", "y", "v"):
        df = df.withColumn(name, df["vec_id"])
    got = whitening.whiten(df.repartition(5), most=4).collect()
    own = [r for r in got if r["vec_id"] < 100]
    assert len(own) == 4 * 70
    check([r for k, r in {(r["vec_id"], r["component"]): r for r in got if not 100 <= r["vec_id"] < 200}.items()],
          a + [(300, a[0][1])], 4)
    check([r for r in got if 100 <= r["vec_id"] < 200], b, 4)
    assert whitening.whiten(df.filter("false")).collect() == []
    assert whitening.whiten(df.filter("vec_id = 300")).collect() == []


def test_lower_rank_repeats_and_missing_ids(spark):
    """All vectors on a line in eight dimensions: one component; a third of the rows are one vector."""
    line = [(i, [float(i % 7) * k for k in range(1, 9)]) for i in range(21)] + [(None, [0.0] * 8)] * 10
    got = whitening.whiten(spark.createDataFrame(line, SCHEMA)).collect()
    assert len(got) == 31 and {r["component"] for r in got} == {1} and {r["n"] for r in got} == {7}
    assert {r["whitened"] for r in got if r["vec_id"] is None} == {r["whitened"] for r in got if r["vec_id"] == 0}
    assert all(abs(r["explained"] - 1) < 1e-12 and r["identity_error"] < 1e-9 for r in got)


def test_far_entries(spark):
    """Entries far apart: sums stay exact, the deviation is null where it does not fit a long."""
    rows = [(i, [float(i), 1e30 * (i % 2)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    assert {r["deviation"] for r in got} == {None}
    rows = [(i, [float(i), 1e9 * (i % 2)]) for i in range(9)]
    got = whitening.whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()
    n, s = 9, np.array([64 * 36, 64 * 4 * 10 ** 9])
    assert {(r["vec_id"], r["deviation"]) for r in got} == {
        (i, d if (d := (n * 64 * i - int(s[0])) ** 2 + (n * 64 * 10 ** 9 * (i % 2) - int(s[1])) ** 2) < 2 ** 63 else None)
        for i in range(9)}


@pytest.mark.parametrize("d, rank", [(1, 1), (2, 2), (7, 7), (12, 5), (33, 33)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    a = rng.normal(size=(d, rank)) * 10.0 ** -rng.integers(0, 4, rank)
    v = a @ a.T
    g = whitening.cholesky(v)
    assert g.shape == (d, rank)
    np.testing.assert_allclose(g @ g.T, v, atol=1e-12 * v.max())
    e, w = whitening.components(v, d)
    np.testing.assert_allclose(e, np.linalg.eigvalsh(v)[::-1][:rank], rtol=1e-6, atol=1e-14 * v.max())
    np.testing.assert_allclose(w.T @ w, np.eye(rank), atol=1e-10)
    np.testing.assert_allclose(v @ w, w * e, atol=1e-12 * float(Fraction(float(v.max()))) * d)


def test_rounds_hold_their_bound():
    sizes = [(d, d * whitening.SENT // 10) for d in range(1, 13)]
    rounds = whitening._rounds(sizes)
    assert sorted(sum(rounds, [])) == list(range(1, 13))
    assert all(sum(dict(sizes)[d] for d in r) <= whitening.SENT or len(r) == 1 for r in rounds)
