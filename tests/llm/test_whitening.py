"""Whitening against exact fractions and 128-digit sums."""

import math
import random
from fractions import Fraction

import numpy as np
import pytest

from tessera.llm import whitening

ROWS = "vec_id long, embedding array<float>, label int, x int, n string, dim int"  # the last three clash with inner names


def exact_covariance(vectors):
    """n, sums and the covariance as fractions, rounded once at the end."""
    distinct = sorted({tuple(v) for v in vectors})
    n, d = len(distinct), len(distinct[0])
    sums = [sum(v[j] for v in distinct) for j in range(d)]
    centred = [[n * v[j] - sums[j] for j in range(d)] for v in distinct]
    cov = [[Fraction(sum(c[i] * c[j] for c in centred), n**3) for j in range(d)] for i in range(d)]
    return n, sums, cov


def integers(vector):
    return [math.floor(64 * float(np.float32(c))) + 1_000_000 for c in vector]


def made(seed, d=6, rows=80):
    r = random.Random(seed)
    out = [[r.gauss(0, 3.0 ** (j - 2)) + 50 * j for j in range(d)] for _ in range(rows)]
    return out + [out[0]] * 40


@pytest.mark.parametrize("seed", [0, 1])
def test_equals_exact_arithmetic(spark, seed):
    vectors = made(seed)
    rows = [(None if i == 7 else i, v, 0, 1, "x", 2) for i, v in enumerate(vectors)]
    rows += [(900, None, 0, 1, "x", 2), (901, [1.0, None, 0.0, 0.0, 0.0, 0.0], 0, 1, "x", 2), (902, [float("nan")] * 6, 0, 1, "x", 2), (903, [math.inf] * 6, 0, 1, "x", 2), (904, [], 0, 1, "x", 2), (905, [1e30] * 6, 0, 1, "x", 2)]
    got = whitening.whitened_rows(spark.createDataFrame(rows, ROWS).repartition(5)).collect()
    xs = [integers(v) for v in vectors]
    n, sums, cov = exact_covariance(xs)
    assert len(got) == 6 * len(vectors) and {r.n for r in got} == {n} and {r.component for r in got} == set(range(1, 7))
    assert all(r.identity_error < 1e-9 for r in got)
    v = np.array([[float(x) for x in row] for row in cov])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1], axes[:, ::-1]
    by = {(r.vec_id, r.component): r for r in got}
    for c in range(6):
        lead = np.sign(axes[np.abs(axes[:, c]).argmax(), c])
        for i, x in enumerate(xs):
            r = by[None if i == 7 else i, c + 1]
            want = sum(float(Fraction(n * a - s, n)) * u for a, s, u in zip(x, sums, axes[:, c] * lead)) / math.sqrt(values[c])
            assert r.deviation == sum((n * a - s) ** 2 for a, s in zip(x, sums))
            assert abs(r.whitened - want) < 1e-7 and abs(r.explained - values[c] / values.sum()) < 1e-9


def test_moments_are_exact_to_double_double():
    r = np.random.default_rng(0)
    a = r.normal(size=(9000, 3)) * [1e-9, 1, 1e9] + [0, 1e6, 0]
    hi, lo = whitening.inner((a, np.zeros_like(a)), (a, np.zeros_like(a)))
    for i in range(3):
        for j in range(3):
            terms = [Fraction(x) * Fraction(y) for x, y in zip(a[:, i], a[:, j])]
            want, size = sum(terms), sum(map(abs, terms))
            assert abs(Fraction(hi[i, j]) + Fraction(lo[i, j]) - want) < size * Fraction(1, 2**85)
    whole = hi[1, 1]
    assert whole != (a[:, 1] ** 2).sum() or lo[1, 1] != 0  # the low part is not idle


def test_eigenvectors_beyond_plain_double():
    """Eigenvalues over sixteen orders of magnitude: residuals of the small ones are small beside themselves."""
    r = np.random.default_rng(1)
    q, _ = np.linalg.qr(r.normal(size=(8, 8)))
    root = np.ldexp(np.rint(np.ldexp(q * 10.0 ** -np.arange(8), 45)), -45)
    c = whitening.inner((root.T, np.zeros((8, 8))), (root.T, np.zeros((8, 8))))
    values, x = whitening.eigenpairs(c)
    assert (np.diff(values) < 0).all() and np.abs(x.T @ x - np.eye(8)).max() < 1e-14
    none = np.zeros((8, 8))
    s = whitening.inner((x, none), whitening.inner(c, (x, none)))
    s = s[0] + s[1]
    assert np.abs(np.diag(s) / values - 1).max() < 1e-6
    assert np.abs(s - np.diag(np.diag(s))).max() < 1e-15 * values[0]


def test_merging_many_tasks_and_rank(spark, monkeypatch):
    monkeypatch.setattr(whitening, "FAN", 2)
    r = random.Random(3)
    rows = [(i, [a := r.uniform(-9, 9), 2 * a, 5.0], 0, 1, "x", 2) for i in range(300)]
    rows = [(i, [float(math.floor(v[0])), 2 * float(math.floor(v[0])), 5.0], *o) for i, v, *o in rows]
    own, out = whitening.whiten(spark.createDataFrame(rows, ROWS).repartition(13))
    assert len(own.values) == 1 and own.identity_error < 1e-9 and out.count() == 300  # one direction only
    assert abs(own.explained[0] - 1) < 1e-12


@pytest.mark.parametrize("rows", [[], [(1, [1.0, 2.0], 0, 1, "x", 2)] * 3, [(1, [], 0, 1, "x", 2)], [(1, None, 0, 1, "x", 2)]])
def test_too_few_vectors_have_no_components(spark, rows):
    frame = spark.createDataFrame(rows, ROWS)
    assert whitening.whitened_rows(frame).collect() == []
    own, out = whitening.whiten(frame)
    assert out.where("deviation <> 0").count() == 0 and len(own.values) == 0
