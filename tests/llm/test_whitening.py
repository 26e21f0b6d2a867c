import math

import numpy as np
import pytest

from lodecraft.llm import whitening


def usable(v):
    return v is not None and all(x is not None and math.isfinite(x) for x in v)


def brute(rows, k=8):
    """Whole numbers in Python, eigenvectors by another routine."""
    good = [(i, [math.floor(1024 * x) + 100_000 for x in v]) for i, v in rows if usable(v)]
    n, d = len(good), len(good[0][1])
    sums = [sum(v[j] for _, v in good) for j in range(d)]
    centred = [[n * a - s for a, s in zip(v, sums)] for _, v in good]
    cov = np.array([[sum(c[i] * c[j] for c in centred) / n**3 for j in range(d)] for i in range(d)])
    values, vectors = np.linalg.eigh(cov)
    values, vectors = values[::-1], vectors[:, ::-1]
    out = {}
    for (i, _), c in zip(good, centred):
        for j in range(min(k, d)):
            out[i, j + 1] = (n, sum(a * a for a in c), float(np.dot([a / n for a in c], vectors[:, j]) / math.sqrt(values[j])), values[j] / values.sum())
    return out


@pytest.fixture(scope="module")
def rows():
    rng = np.random.default_rng(3)
    base = rng.normal(size=(300, 12)) * np.geomspace(1, 0.05, 12)
    return [(i, [float(np.float32(x)) for x in v]) for i, v in enumerate(base @ np.linalg.qr(rng.normal(size=(12, 12)))[0])]


def test_equals_brute_force(spark, rows):
    odd = [(900, None), (901, [1.0, None] + [0.0] * 10), (902, [float("nan")] * 12), (903, [float("-inf")] * 12)]
    df = spark.createDataFrame([(i, v, 1, 2.0) for i, v in rows + odd], "vec_id long, embedding array<float>, n int, x double").repartition(5)
    found = whitening.whiten(df).collect()
    want = brute(rows)
    assert len(found) == len(want)
    for component in range(1, 9):
        pairs = [(r, want[r.vec_id, component]) for r in found if r.component == component]
        side = math.copysign(1, sum(r.whitened * w[2] for r, w in pairs))
        for r, w in pairs:
            assert (r.n, int(r.deviation)) == w[:2]
            assert abs(side * r.whitened - w[2]) < 1e-8 and abs(r.explained - w[3]) < 1e-10 * w[3]
            assert r.identity_error < 1e-10
    means = [sum(r.whitened for r in found if r.component == c) for c in range(1, 9)]
    assert max(map(abs, means)) < 1e-8


def test_jacobi_keeps_small_eigenvalues():
    scale = np.diag(10.0 ** -np.arange(0, 12, 2))
    a = scale @ (np.eye(6) + 0.1) @ scale  # graded: the small ones are lost by routines that only bound the absolute error
    values, vectors = whitening.jacobi(a)
    exact = np.array(sorted((float(x) for x in _by_fractions(a)), reverse=True))
    assert np.allclose(values, exact, rtol=1e-10, atol=0)
    assert np.allclose(vectors.T @ vectors, np.eye(6), atol=1e-13)
    rng = np.random.default_rng(1)
    for d in (1, 2, 5, 64):
        x = rng.normal(size=(d, 2 * d))
        values, vectors = whitening.jacobi(x @ x.T)
        assert np.allclose(vectors * values @ vectors.T, x @ x.T, atol=1e-10 * d) and (np.diff(values) <= 0).all()
    assert whitening.jacobi(np.zeros((3, 3)))[0].tolist() == [0, 0, 0]


def _by_fractions(a):
    """Roots of the characteristic polynomial of a graded matrix, each refined by inverse iteration on the inverse, where it is the largest."""
    from decimal import Decimal, getcontext

    getcontext().prec = 60
    d = len(a)
    m = [[Decimal(float(x)) for x in row] for row in a]
    for _ in range(60):  # Cholesky steps (L L' -> L' L) converge fast for graded matrices
        low = [[Decimal(0)] * d for _ in range(d)]
        for i in range(d):
            for j in range(i + 1):
                s = m[i][j] - sum(low[i][k] * low[j][k] for k in range(j))
                low[i][j] = s.sqrt() if i == j else s / low[j][j]
        m = [[sum(low[k][i] * low[k][j] for k in range(d)) for j in range(d)] for i in range(d)]
    return [m[i][i] for i in range(d)]


def test_partitions_do_not_matter(spark, rows):
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    key = lambda r: (r.vec_id, r.component)
    one, many = (sorted(whitening.whiten(df.repartition(p)).collect(), key=key) for p in (1, 7))
    assert [r[:6] for r in one] == [r[:6] for r in many]


def test_defined_cases(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whiten(spark.createDataFrame([], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, None)], schema)).collect() == []
    assert whitening.whiten(spark.createDataFrame([(1, []), (2, [])], schema)).collect() == []
    same = whitening.whiten(spark.createDataFrame([(1, [0.5, 0.25])] * 3 + [(None, [0.5, 0.25])], schema)).collect()
    assert len(same) == 8 and {(r.whitened, r.explained, r.identity_error, int(r.deviation), r.n) for r in same} == {(0.0, 0.0, 0.0, 0, 4)}
    ragged = whitening.whiten(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0]), (3, [0.0, 1.0])], schema)).collect()
    padded = whitening.whiten(spark.createDataFrame([(1, [1.0, 0.0]), (2, [1.0, 2.0]), (3, [0.0, 1.0])], schema)).collect()
    assert sorted(ragged) == sorted(padded) and len(ragged) == 6
    huge = whitening.whiten(spark.createDataFrame([(1, [3e38, 0.0]), (2, [-3e38, 1.0]), (3, [0.0, 0.5])], schema)).collect()
    assert len(huge) == 6 and all(math.isfinite(r.whitened) for r in huge)
    few = whitening.whiten(spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [2.0, 1.0, 0.0])], schema)).collect()
    assert {r.component: r.explained for r in few} == pytest.approx({1: 1.0, 2: 0.0, 3: 0.0})
    assert max(r.identity_error for r in few) < 1e-10
