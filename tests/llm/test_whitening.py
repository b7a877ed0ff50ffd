"""Whitening against a dense eigendecomposition, and its defined cases."""

import math
import random

import numpy as np
import pytest

from fluxalign.llm import queries, whitening

from ..conftest import TINY


def check(rows, out, most=32):
    """The result must be that of the plain definition in exact and dense arithmetic."""
    x = np.array([[math.floor(64 * c) + 1_000_000 for c in v] for _, v in rows], object)
    n, s = len(x), x.sum(axis=0)
    centred = ((n * x - s) / n).astype(float)
    v = centred.T @ centred / n
    values, vectors = np.linalg.eigh(v)
    values, vectors = values[::-1], vectors[:, ::-1]
    k = min(most, int((values > len(v) * 1e-14 * np.trace(v)).sum()))
    got = {(r.vec_id, r.component): r for r in out}
    assert len(out) == n * k == len(got)
    deviation = ((n * x - s) ** 2).sum(axis=1)
    for i, (name, _) in enumerate(rows):
        assert {got[name, c].deviation for c in range(1, k + 1)} == {int(deviation[i])}
    for c in range(1, k + 1):
        w = np.array([got[name, c].whitened for name, _ in rows])
        gap = min([abs(values[c - 1] - u) for j, u in enumerate(values) if j != c - 1], default=1)
        if gap > 1e-6 * values[0]:  # else any vector of the eigenspace will do
            want = centred @ vectors[:, c - 1] / math.sqrt(values[c - 1])
            assert np.abs(w * np.sign(w @ want) - want).max() < 1e-6
        assert got[rows[0][0], c].explained == pytest.approx(values[c - 1] / np.trace(v), rel=1e-9)
    assert {r.n for r in out} == {n} and len({r.identity_error for r in out}) == 1
    assert out[0].identity_error < 1e-8
    return k


def test_the_registered_query(spark):
    rows = [(r.vec_id, [float(c) for c in r.embedding]) for r in spark.read.parquet(f"{TINY}/embeddings.parquet").collect()]
    assert check(rows, queries.op13_whitening(spark, TINY).collect()) == 32


def test_hard_vectors(spark):
    """Equal eigenvalues, fewer directions than dimensions, bad rows, repeated rows, clashing names."""
    rng = random.Random(3)
    signs = [(s * 2.0 if i == j else 0.0) for j in range(4) for s in (1, -1) for i in range(4)]
    equal = [(n, signs[4 * n : 4 * n + 4] + [0.5, 0.5]) for n in range(8)]  # four equal values, two without variance
    flat = [(n, [a := rng.gauss(0, 1), float(round(2 * a)), 3.0, rng.gauss(0, 3)]) for n in range(40)]
    for rows in (equal, flat):
        bad = [(90, None), (91, []), (92, [1.0, float("nan"), 0.0]), (93, [float("inf")] * len(rows[0][1])), (94, [None] * len(rows[0][1])), (95, [1.0]), (96, [2.0**41] * len(rows[0][1]))]
        df = spark.createDataFrame(rows + bad, "vec_id long, embedding array<double>").selectExpr("*", "1 AS v", "2 AS id", "3 AS n", "4 AS component").repartition(3)
        check(rows, whitening.whiten(df).collect())
    none = spark.createDataFrame(bad[:2], "vec_id long, embedding array<float>")
    assert whitening.whiten(none).count() == 0 and whitening.whiten(none.limit(0)).count() == 0
    same = spark.createDataFrame([(i, [1.0, 2.0]) for i in range(5)], "vec_id long, embedding array<double>")
    assert whitening.whiten(same).count() == 0
    twice = spark.createDataFrame([(None, [1.0, 2.0]), (1, [0.0, 5.0]), (1, [0.0, 5.0])], "vec_id long, embedding array<double>")
    assert sorted((r.vec_id is None, r.n) for r in whitening.whiten(twice).collect()) == [(False, 3), (False, 3), (True, 3)]


def test_sums_are_exact_for_large_entries():
    rng = np.random.default_rng(5)
    y = rng.integers(-(1 << 46), 1 << 46, (50, 3))
    want = [[sum(int(a) * int(b) for a, b in zip(y[:, i], y[:, j])) for j in range(3)] for i in range(3)]
    assert whitening.products(y) == want
    model = whitening.Whitening(50, np.zeros(3, np.int64), [1, 2, 3], np.ones(1), np.eye(3)[:, :1], 3.0)
    assert model.deviations(y)[0] is None
    assert model.deviations(y % 1000)[7] == sum((50 * int(a) - r) ** 2 for a, r in zip(y[7] % 1000, [1, 2, 3]))


def test_inertia_and_slices():
    rng = np.random.default_rng(8)
    for dim in (1, 2, 5, 40, 90):
        a = rng.standard_normal((dim, dim))
        a = a + a.T
        values = np.linalg.eigvalsh(a)
        for shift in (*rng.uniform(values[0] - 1, values[-1] + 1, 25), 0.0):
            assert whitening.below(a, shift) == (values < shift).sum()
        v = a @ a.T
        values = np.linalg.eigvalsh(v)
        cut = whitening.slices(v, 32, 1e-12)
        assert sum(n for _, _, n in cut) >= min(32, dim) and all(((values >= x) & (values < y)).sum() == n for x, y, n in cut)
        for x, y, n in cut:
            got, vectors = whitening.contour(v, x, y, n)
            assert np.allclose(np.sort(got), values[(values >= x) & (values < y)], rtol=0, atol=1e-11 * values[-1])
            assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    with pytest.raises(ArithmeticError):
        whitening.contour(v, cut[0][0], cut[0][1], cut[0][2] + 1)
    assert whitening.below(np.array([[0.0, 1.0], [1.0, 0.0]]), 0.0) == 1 and whitening.below(np.zeros((3, 3)), 1.0) == 3
