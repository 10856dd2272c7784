"""Whitening against an eigenvalue decomposition of the whole covariance."""

import numpy as np
import pytest

from attestor.llm import whitening

SCHEMA = "vec_id bigint, embedding array<float>, label int"


def by_hand(vectors):
    x = np.array([[int(np.floor(64 * float(np.float32(c)))) + 1_000_000 for c in v] for v in vectors], object)
    n, s = len(x), x.sum(axis=0)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    y = (n * x - s).astype(float) / n
    e, v = np.linalg.eigh(y.T @ y / n)
    return n, deviation.tolist(), y, e[::-1], v[:, ::-1]


def compared(spark, vectors, extra=()):
    rows = [(i, [float(c) for c in v], 0) for i, v in enumerate(vectors)]
    found = whitening.whitened(spark.createDataFrame(rows + list(extra), SCHEMA)).collect()
    n, deviation, y, e, v = by_hand(vectors)
    k = max((r.component for r in found), default=0)
    rank = min(32, int((e > 1e-9 * e[0]).sum())) if e[0] > 0 else 0
    assert k == rank and len(found) == n * k
    got = np.zeros((n, k))
    for r in found:
        assert (r.n, r.deviation) == (n, deviation[r.vec_id])
        assert r.explained == pytest.approx(e[r.component - 1] / e.sum(), rel=1e-7)
        got[r.vec_id, r.component - 1] = r.whitened
    if k:
        assert found[0].identity_error < 1e-7 and len({r.identity_error for r in found}) == 1
        assert np.abs(got.T @ got / n - np.eye(k)).max() < 1e-7
    return got, y @ v[:, :k] / np.sqrt(e[:k])


def test_against_eigenvectors(spark):
    rng = np.random.default_rng(13)
    vectors = rng.normal(size=(700, 40)) * np.geomspace(1, 60, 40) + rng.normal(size=40) * 1000
    got, want = compared(spark, vectors, [(-1, None, 1), (-2, [float("nan")] * 40, 1), (-3, [1.0] * 39 + [float("inf")], 1),
                                          (-4, [None] + [1.0] * 39, 1), (-5, [], 1), (-6, [1.0] * 3, 1), (-7, [3e38] * 40, 1)])
    assert np.abs(np.abs(got) - np.abs(want)).max() < 1e-6
    signs = np.sign(got * want)
    assert (np.abs(signs.sum(axis=0)) > 0.99 * len(got)).all()  # one sign for all rows


def test_a_third_of_equal_rows_and_lacking_rank(spark):
    rng = np.random.default_rng(2)
    base = rng.normal(size=(400, 5)) * 30
    vectors = np.concatenate([np.c_[base, base.sum(axis=1).round(), np.ones(400), base[:, 0]], np.tile([1.0] * 8, (200, 1))])
    got, want = compared(spark, vectors)
    assert np.abs(np.abs(got[:, :5]) - np.abs(want[:, :5])).max() < 1e-5


def test_more_dimensions_than_rows(spark):
    compared(spark, np.random.default_rng(4).normal(size=(12, 30)) * 50)


def test_no_variance_and_no_rows(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0], 0), (None, [1.0, 2.0], 0), (1, [1.0, 2.0], 0)], SCHEMA)
    for rows in (df, df.limit(1), df.limit(0), df.selectExpr("vec_id", "CAST(NULL AS array<float>) AS embedding")):
        assert whitening.whitened(rows).collect() == []


def test_ties_nulls_and_clashing_columns(spark):
    rows = [(None, [a, b], a, b) for a in (-1.0, 1.0) for b in (-1.0, 1.0)] * 3
    found = whitening.whitened(spark.createDataFrame(rows, "vec_id bigint, embedding array<double>, x double, n double")).collect()
    assert len(found) == 24 and all(abs(abs(r.explained) - 0.5) < 1e-12 and r.vec_id is None for r in found)
    assert found[0].identity_error < 1e-12


def test_exact_deviation_beyond_machine_words():
    x = np.array([[(1 << 50) + 7, 3], [5, 1 << 40]])
    s = [int(t) for t in x.sum(axis=0)]
    want = [sum((2 * int(a) - t) ** 2 for a, t in zip(row, s)) for row in x]
    assert whitening.deviations(x, 2, s) == [v if v < 1 << 63 else None for v in want]
    y = np.array([[40, 3], [5, 100]])
    s = [int(t) for t in y.sum(axis=0)]
    assert whitening.deviations(y, 2, s) == [sum((2 * int(a) - t) ** 2 for a, t in zip(row, s)) for row in y]


def test_factor_of_a_singular_matrix():
    g = np.ones((3, 3))
    r = whitening.factor(g, 10, shifted=False)
    assert np.allclose(r, np.triu(r)) and np.abs(r.T @ r - g).max() < 1e-8
    assert np.isfinite(whitening.factor(np.zeros((2, 2)), 5, shifted=True)).all()
