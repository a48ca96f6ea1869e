"""Whitening against numpy's eigenvectors and Python's integers."""

import math

import numpy as np
import pytest

from tessera.llm import whitening

SF = "/root/testdata/sf0.01"


def brute(vectors):
    """(deviations, centred rows, eigenvalues, eigenvectors, n) by a whole covariance matrix."""
    x = [[math.floor(1024 * float(c)) + 100000 for c in v] for v in vectors]
    n, sums = len(x), [sum(c) for c in zip(*x)]
    deviation = [sum((n * c - s) ** 2 for c, s in zip(v, sums)) for v in x]
    z = np.array([[n * c - s for c, s in zip(v, sums)] for v in x], np.float64) / n
    e, q = np.linalg.eigh(z.T @ z / n)
    return deviation, z, e[::-1], q[:, ::-1], n


def holds(rows, vectors, ids, k=8):
    deviation, z, e, q, n = brute(vectors)
    assert len(rows) == k * len(ids)
    by = {}
    for r in rows:
        by.setdefault(r.component, {})[r.vec_id] = r
    for c in range(1, k + 1):
        got = np.array([by[c][i].whitened for i in ids])
        want = z @ q[:, c - 1] / math.sqrt(e[c - 1])
        want *= np.sign(got @ want)
        assert np.abs(got - want).max() < 1e-9
        for i, d in zip(ids, deviation):
            r = by[c][i]
            assert (r.n, r.deviation, r.deviation_exact) == (n, d, str(d)) and r.explained == pytest.approx(e[c - 1] / e.sum(), rel=1e-9)
            assert 0 <= r.identity_error < 1e-9


def test_whitening_matches_numpy(spark):
    table = spark.read.parquet(f"{SF}/embeddings.parquet")
    rows = sorted(table.collect(), key=lambda r: r.vec_id)
    out = whitening.report(table)
    assert [f.dataType.simpleString() for f in out.schema][:7] == ["bigint", "int", "bigint", "bigint", "double", "double", "double"]
    holds(out.collect(), [r.embedding for r in rows], [r.vec_id for r in rows])


def test_iteration_restarts_and_certifies():
    """More dimensions than the kept blocks span: residuals, passes and eigenvectors hold for spread and close eigenvalues."""
    rng = np.random.default_rng(1)
    for scale in (np.ones(400), 0.9 ** np.arange(400)):
        z = rng.normal(size=(3000, 400)) * scale
        matrix = z.T @ z / len(z)
        values, vectors, residuals, passes = whitening.iterate(lambda q: matrix @ q, 400)
        e, q = np.linalg.eigh(matrix)
        assert residuals.max() < whitening.STALLED and passes < 100
        assert np.allclose(values, e[::-1][:8], rtol=1e-12) and np.allclose(np.abs(np.einsum("dk,dk->k", vectors, q[:, ::-1][:, :8])), 1, atol=1e-12)


def test_few_dimensions_copies_and_flat_components(spark):
    rng = np.random.default_rng(2)
    vectors = [[float(a), float(b), 0.25] for a, b in rng.normal(size=(40, 2))] * 2
    rows = whitening.report(spark.createDataFrame([(i, v) for i, v in enumerate(vectors)], "vec_id long, embedding array<double>")).collect()
    holds(rows, vectors, range(80), 2)  # the third component has no variance
    assert whitening.report(spark.createDataFrame([(1, [1.0, 2.0])] * 3, "vec_id long, embedding array<float>")).count() == 0


def test_unusable_rows_and_clashing_names(spark):
    rng = np.random.default_rng(3)
    good = [(i, [float(c) for c in rng.normal(size=4)]) for i in range(30)] + [(3, [0.5, 0.5, 0.5, 0.5]), (None, [1.0, 2.0, 3.0, 4.0])]
    bad = [(90, None), (91, [1.0, None, 2.0, 3.0]), (92, [math.nan] * 4), (93, [math.inf, 0.0, 0.0, 0.0]), (94, []), (95, [1.0]), (96, [1e30, 0.0, 0.0, 0.0])]
    schema = "vec_id long, embedding array<double>, label int, component int, whitened double, body string, wide string"
    df = spark.createDataFrame([(*r, 1, 2, 0.5, "b", "w") for r in good + bad], schema)
    rows = whitening.report(df).collect()
    assert len(rows) == 4 * len(good) and {r.vec_id for r in rows} == {i for i, _ in good} and {r.n for r in rows} == {len(good)}
    model = whitening.fit(df)
    kept = whitening.whitened(df, model)
    assert kept.count() == len(good) and kept.columns == [c for c in df.columns if c != "whitened"] + ["whitened"]
    w = np.array([r.whitened for r in kept.collect()])
    assert np.abs(w.T @ w / len(w) - np.eye(4)).max() < 1e-9 and model.identity_error < 1e-9
    for none in (df.limit(0), df.filter("vec_id in (90, 92, 94)")):
        assert whitening.report(none).count() == 0


def test_deviations_beyond_a_long():
    fit = whitening.Fit(1 << 34, [0, 0], 1 << 40)
    x = np.array([[1 << 30, -3], [1, 2]], np.int64)
    assert fit.deviation(x) == [(1 << 128) + 9 * (1 << 68), 5 << 68]
    small = whitening.Fit(3, [3, 6], 100)
    assert small.deviation(np.array([[1, 2], [2, 2]])) == [0, 9] and small.centred(np.array([[2, 2]])).tolist() == [[1.0, 0.0]]
