import math
from fractions import Fraction

import numpy as np
import pytest

from ohmlake.llm import whitening as W
from ohmlake.llm.whitening import op11_whitening


def whole(v):
    return [math.floor(64 * float(c)) + 1_000_000 for c in v]


def exact(vectors):
    """n, sums, deviations as whole numbers, covariance as doubles of exact fractions."""
    x = [whole(v) for v in vectors]
    n, d = len(x), len(x[0])
    s = [sum(r[j] for r in x) for j in range(d)]
    z = [[n * a - b for a, b in zip(r, s)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in z), n**3)) for j in range(d)] for i in range(d)])
    return n, s, z, v


@pytest.mark.parametrize("d,rank", [(1, 1), (2, 2), (7, 7), (16, 16), (9, 4)])
def test_factor_and_rotations(d, rank):
    rng = np.random.default_rng(d)
    m = rng.normal(size=(d, rank)) * 10.0 ** rng.integers(-4, 4, rank)
    v = m @ m.T
    factor, pivots = W.cholesky(v)
    assert factor.shape == (d, rank) and np.allclose(np.triu(factor, 1), 0)
    assert np.allclose(factor @ factor.T, v[np.ix_(pivots, pivots)], rtol=1e-9, atol=1e-12 * np.abs(v).max())
    assert (np.diff(np.diagonal(factor)) <= 1e-12 * factor[0, 0]).all()
    components, e = W.jacobi(factor)
    assert np.allclose(components @ components.T, np.eye(rank), atol=1e-12)
    want = np.linalg.eigvalsh(v)[::-1][:rank]
    assert np.allclose(e, want, rtol=1e-9, atol=1e-12 * want[0]) and (np.diff(e) <= 0).all()
    assert np.allclose(components.T * e @ components, v[np.ix_(pivots, pivots)], atol=1e-11 * np.abs(v).max())


def test_small_eigenvalues_stay_accurate():
    scale = 10.0 ** -np.arange(0, 7, dtype=float)
    v = (np.full((7, 7), 0.3) + 0.7 * np.eye(7)) * np.outer(scale, scale)  # graded
    factor, _ = W.cholesky(v)
    _, e = W.jacobi(factor)
    from fractions import Fraction as Q

    # the product of eigenvalues is the determinant, known exactly: (1 - r)^6 (1 + 6 r) times the scales squared
    det = float(Q(7, 10) ** 6 * Q(28, 10)) * float(np.prod(scale**2))
    assert abs(np.prod(e) / det - 1) < 1e-10


def held(spark, vectors, extra=()):
    rows = [(i, [float(c) for c in v]) for i, v in enumerate(vectors)] + [(1000 + i, v) for i, v in enumerate(extra)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)


def test_against_exact_numbers(spark):
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(60, 5)) @ rng.normal(size=(5, 5))).tolist()
    vectors += vectors[:3]  # repeated
    odd = [None, [], [1.0, None, 0.0, 0.0, 0.0], [float("nan")] * 5, [float("inf"), 0.0, 0.0, 0.0, 0.0], [1e300, 0.0, 0.0, 0.0, 0.0], [1.0, 2.0]]
    df = held(spark, vectors, odd).selectExpr("*", "1 as deviation", "2 as whitened", "3 as key")
    n, s, z, v = exact(vectors)
    model = W.fit(df)
    assert (model.n, model.sums) == (n, s)
    e, u = np.linalg.eigh(v)
    e, u = e[::-1], u[:, ::-1]
    assert np.allclose(model.eigenvalues, e, rtol=1e-12) and np.allclose(model.explained, e / np.trace(v), rtol=1e-12)
    for k in range(5):
        assert abs(abs(model.components[k] @ u[:, k]) - 1) < 1e-12
    got = {r.vec_id: r for r in W.transform(df, model).collect()}
    assert sorted(got) == list(range(n)) and got[0].key == 3
    for i in range(n):
        assert got[i].deviation == sum(a * a for a in z[i])
        want = np.array(z[i], float) / n @ model.components.T / np.sqrt(e)
        assert np.allclose(got[i].whitened, want, atol=1e-10)
    assert W.identity_error(df, model) < 1e-9
    assert len(W.transform(df, model, components=2, drop_vector=True).first().whitened) == 2


def test_flat_and_empty_tables(spark):
    # rank 1 in three dimensions
    model = W.fit(df := held(spark, [[i / 8, i / 4, 1.0] for i in range(9)]))
    assert (model.eigenvalues[1:] == 0).all() and np.allclose(model.components @ model.components.T, np.eye(3), atol=1e-12)
    rows = W.transform(df, model).collect()
    assert all(r.whitened[0] is not None and r.whitened[1:] == [None, None] for r in rows) and W.identity_error(df, model) < 1e-9
    one = held(spark, [[1.0, 2.0]] * 3)
    m = W.fit(one)
    assert [(r.deviation, r.whitened) for r in W.transform(one, m).collect()] == [(0, [None, None])] * 3
    assert m.explained == [None, None] and W.identity_error(one, m) == 0.0
    assert W.fit(one.limit(0)) is None and W.fit(held(spark, [], [None, [], [None]])) is None


def test_large_numbers_are_exact(spark):
    vectors = [[2.0**50, 1.0], [-(2.0**50), 3.0], [2.0**49, -5.0]]
    df = held(spark, vectors)
    n, s, z, _ = exact(vectors)
    model = W.fit(df)
    assert model.sums == s
    assert all(r.deviation is None for r in W.transform(df, model).collect())  # beyond a long
    assert [[int(c) for c in r] for r in model.centred(np.array([whole(v) for v in vectors]))] == z


def test_query(spark, tmp_path):
    at = "/root/testdata/sf0.001"
    own = {r.vec_id: r.embedding for r in spark.read.parquet(f"{at}/embeddings.parquet").collect()}
    ids = sorted(own)
    n, s, z, v = exact([own[i] for i in ids])
    e, u = np.linalg.eigh(v)
    e, u = e[::-1][:32], u[:, ::-1][:, :32]
    got = op11_whitening(spark, at)
    assert dict(got.dtypes) == {"vec_id": "bigint", "component": "int", "n": "bigint", "deviation": "bigint", "whitened": "double", "explained": "double", "identity_error": "double"}
    rows = {(r.vec_id, r.component): r for r in got.collect()}
    assert sorted(rows) == [(i, k) for i in ids for k in range(1, 33)]
    want = np.array(z, float) / n @ u / np.sqrt(e)
    for k in range(32):
        mine = np.array([rows[i, k + 1].whitened for i in ids])
        sign = np.sign(mine @ want[:, k])
        assert np.allclose(mine, sign * want[:, k], atol=1e-8)
        assert abs(rows[ids[0], k + 1].explained / (e[k] / np.trace(v)) - 1) < 1e-9
    for i, r in zip(ids, z):
        assert rows[i, 1].deviation == sum(a * a for a in r) and rows[i, 1].n == n
    assert 0 <= rows[ids[0], 1].identity_error < 1e-8
    spark.createDataFrame([(1, None)], "vec_id long, embedding array<float>").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert op11_whitening(spark, str(tmp_path)).count() == 0
