"""Whitening against an eigensolver of the library and plain integer arithmetic."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from clearwell.llm import eigen, whitening

SCHEMA = "vec_id long, embedding array<float>, label int"


def matrices():
    pick = np.random.default_rng(0)
    x = pick.normal(size=(500, 48))
    q, _ = np.linalg.qr(pick.normal(size=(48, 48)))
    wilkinson = np.diag(np.abs(np.arange(-10, 11.0))) + np.diag(np.ones(20), 1) + np.diag(np.ones(20), -1)
    yield from (x.T @ x, q @ np.diag([5.0] * 10 + [3.0] * 20 + [1.0] * 18) @ q.T, wilkinson, np.eye(9), np.diag(np.arange(7.0)))
    yield from (np.kron(np.eye(5), np.ones((5, 5))), np.array([[2.0]]), np.array([[2.0, 1], [1, 2]]), 1e-200 * (x.T @ x))


@pytest.mark.parametrize("matrix", list(matrices()))
def test_components_of_a_matrix(matrix):
    k = min(32, len(matrix))
    values, vectors = eigen.leading(matrix, k)
    want = np.linalg.eigvalsh(matrix)[::-1][:k]
    size = np.abs(want).max()
    np.testing.assert_allclose(values, want, atol=1e-13 * size)
    np.testing.assert_allclose(vectors.T @ vectors, np.eye(k), atol=1e-13)
    np.testing.assert_allclose(matrix @ vectors, vectors * values, atol=1e-13 * size)


def test_counts_of_eigenvalues_below():
    diagonal, off = np.array([1.0, 2, 3, 4]), np.array([0.5, 0, 1.5])
    values = np.linalg.eigvalsh(np.diag(diagonal) + np.diag(off, 1) + np.diag(off, -1))
    shifts = np.linspace(-2, 7, 200)
    assert eigen.below(diagonal, off, shifts).tolist() == [(values < s).sum() for s in shifts]


def check(rows, got, k):
    """``got`` against dense linear algebra over the rows that count."""
    fine = [(i, v) for i, v in rows if v is not None and all(c is not None and math.isfinite(c) for c in v)]
    x = [[math.floor(64 * float(np.float32(c))) + 1_000_000 for c in v] for _, v in fine]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    centred = np.array([[(n * c - s) / n for c, s in zip(v, sums)] for v in x])
    covariance = centred.T @ centred / n
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1][:k], vectors[:, ::-1][:, :k]
    by = {}
    for r in got:
        by.setdefault(r["component"], {}).setdefault(r["vec_id"], r)
    assert sorted(by) == list(range(1, k + 1))
    for j in range(k):
        want = centred @ vectors[:, j] / np.sqrt(values[j])
        mine = np.array([by[j + 1][i]["whitened"] for i, _ in fine])
        assert min(np.abs(mine - want).max(), np.abs(mine + want).max()) < 1e-9
        for (i, _), v in zip(fine, x):
            r = by[j + 1][i]
            assert r["deviation"] == sum((n * c - s) ** 2 for c, s in zip(v, sums)) and r["n"] == n
            assert abs(r["explained"] - values[j] / covariance.trace()) < 1e-9
            assert r["identity_error"] < 1e-9


def run(spark, rows, components=32):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], SCHEMA).withColumns({c: F.lit(1) for c in ("n", "vector", "x")})
    some = whitening.vectors(df)
    model = whitening.fit(some, components)
    return whitening.project(some, model, whitening.identity_error(some, model)).collect()


def test_whitening_as_plain(spark):
    pick = np.random.default_rng(2)
    mix = pick.normal(size=(40, 40))
    rows = [(i, (pick.normal(size=40) @ mix).astype(np.float32).tolist()) for i in range(300)]
    rows += [(1000, None), (1001, [math.nan] * 40), (1002, [math.inf] + [0.0] * 39), (1003, [None] + [0.0] * 39)]
    got = run(spark, rows)
    assert len(got) == 300 * 32
    check(rows, got, 32)


def test_fewer_entries_than_components_and_repeated_rows(spark):
    pick = np.random.default_rng(3)
    rows = [(i, pick.normal(size=3).tolist()) for i in range(50)]
    rows += [(100, [9.0, 0.0, 1.0])] * 20
    got = run(spark, rows)
    assert len(got) == 70 * 3
    check(rows, got, 3)


def test_odd_tables(spark):
    assert run(spark, []) == [] and run(spark, [(1, None)]) == []
    assert run(spark, [(1, [1.0, 2.0])]) == []  # one vector has no variance
    assert run(spark, [(1, [1.0, 2.0])] * 5) == []
    flat = run(spark, [(i, [float(i), 3.0, float(2 * i)]) for i in range(10)])  # two entries that go together, one constant
    assert {r["component"] for r in flat} == {1} and len(flat) == 10
    assert len(run(spark, [(None, [1.0]), (2, [2.0])])) == 2
    with pytest.raises(Exception, match="different lengths"):
        run(spark, [(1, [1.0]), (2, [1.0, 2.0])])
    with pytest.raises(Exception, match="too large"):
        run(spark, [(1, [1e30]), (2, [1.0])])
