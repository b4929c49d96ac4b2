from fractions import Fraction
from math import floor, isfinite

import numpy as np
import pytest

from lodestone.llm.whitening import add, divide_and_conquer, eigen, outer_sum, total, tridiagonal, two_sum, whiten


def symmetric(kind, n, rng):
    a = rng.normal(size=(n, n))
    return {"any": a + a.T, "positive": a @ a.T, "equal": 3 * np.eye(n), "ones": np.ones((n, n)), "repeated": np.diag(rng.integers(0, 3, n).astype(float)), "zero": np.zeros((n, n)), "wide": np.diag(10.0 ** -np.arange(n)) + 1e-9 * (a + a.T)}[kind]


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64])
@pytest.mark.parametrize("kind", ["any", "positive", "equal", "ones", "repeated", "zero", "wide"])
def test_eigenvectors(kind, n):
    a = symmetric(kind, n, np.random.default_rng(n))
    scale = max(1.0, np.abs(a).max()) * n
    d, e, q = tridiagonal(a)
    t = np.diag(d) + np.diag(e, 1) + np.diag(e, -1) if n > 1 else np.diag(d)
    assert np.abs(q @ t @ q.T - a).max() < 1e-14 * scale
    values, vectors = divide_and_conquer(d, e)
    assert np.abs(t @ vectors - vectors * values).max() < 1e-14 * scale and np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-12
    values, vectors = eigen((a, np.zeros_like(a)))
    assert np.abs(values - np.linalg.eigvalsh(a)[::-1]).max() < 1e-14 * scale and (np.diff(values) <= 0).all()
    assert np.abs(vectors.T @ vectors - np.eye(n)).max() < 1e-13


def test_sums_hold_what_doubles_lose():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(301, 5)) * 10.0 ** rng.integers(-9, 10, (301, 5))
    high, low = outer_sum(x, np.zeros_like(x))
    i, j = np.triu_indices(5)
    for n, (a, b) in enumerate(zip(i, j)):
        exact = sum(Fraction(float(p)) * Fraction(float(q)) for p, q in zip(x[:, a], x[:, b]))
        size = sum(abs(Fraction(float(p)) * Fraction(float(q))) for p, q in zip(x[:, a], x[:, b]))
        assert abs(Fraction(float(high[n])) + Fraction(float(low[n])) - exact) <= size * Fraction(1, 2**95)
    parts = [total((x[k::7], np.zeros_like(x[k::7]))) for k in range(7)]
    merged = parts[0]
    for p in parts[1:]:
        merged = add(merged, p)
    for c in range(5):
        exact = sum(Fraction(float(v)) for v in x[:, c])
        assert abs(Fraction(float(merged[0][c])) + Fraction(float(merged[1][c])) - exact) <= Fraction(1, 2**40)
    assert two_sum(np.array([1e16]), np.array([1.0]))[1][0] == 1.0


def plain(rows, components=8):
    """Per dimension: exact integers, numpy's eigenvectors."""
    clean = [(i, v) for i, v in rows if v and all(x is not None and isfinite(x) for x in v)]
    out = []
    for d in {len(v) for _, v in clean}:
        own = [(i, [floor(1024 * x) + 100_000 for x in v]) for i, v in clean if len(v) == d]
        n, sums = len(own), [sum(c) for c in zip(*[x for _, x in own])]
        apart = np.array([[n * c - s for c, s in zip(x, sums)] for _, x in own], dtype=object)
        v = ((apart.T @ apart) / n**3).astype(float)
        e, vectors = np.linalg.eigh(v)
        e, vectors = e[::-1], vectors[:, ::-1]
        z = (apart / n).astype(float) @ vectors
        for (i, _), a, row in zip(own, apart, z):
            for c in range(min(components, d)):
                firm = e[c] > 1e-12 * e[0] > 0
                out.append((i, c + 1, n, int((a * a).sum()), abs(row[c] / np.sqrt(e[c])) if firm else None, e[c] / np.trace(v) if np.trace(v) > 0 else None))
    return sorted(out, key=lambda r: (r[0] is None, r[0], r[1], r[2], r[3]))


def check(spark, rows):
    df = spark.createDataFrame([(i, v, "x", 1) for i, v in rows], "vec_id long, embedding array<double>, component string, _v int").repartition(5)
    got = sorted(whiten(df).collect(), key=lambda r: (r.vec_id is None, r.vec_id, r.component, r.n, r.deviation))
    want = plain(rows)
    assert [(r.vec_id, r.component, r.n, r.deviation) for r in got] == [w[:4] for w in want]
    for r, (*_, whitened, explained) in zip(got, want):
        assert int(r.deviation_exact) == r.deviation
        assert r.explained == explained is None or r.explained == pytest.approx(explained, rel=1e-9, abs=1e-15)
        assert r.whitened is whitened is None or abs(r.whitened) == pytest.approx(whitened, abs=1e-8)
        assert r.identity_error is None or r.identity_error < 1e-9
    return got


def test_matches_exact_integers(spark):
    rng = np.random.default_rng(4)
    base = rng.normal(size=(200, 12)) * np.arange(1, 13)
    rows = [(i, v.tolist()) for i, v in enumerate(base)] + [(7, base[7].tolist()), (300, base[7].tolist()), (None, base[8].tolist())]
    rows += [(400, None), (401, [None] * 12), (402, [float("nan")] * 12), (403, [float("inf")] + [1.0] * 11), (404, []), (405, [0.0] * 12)]
    rows += [(500 + i, v.tolist()) for i, v in enumerate(rng.normal(size=(9, 3)))]
    got = check(spark, rows)
    by = {}
    for r in got:
        if r.n == 204:
            by.setdefault(r.component, []).append(r.whitened)
    z = np.array([by[c] for c in sorted(by)])
    assert np.abs(z @ z.T / z.shape[1] - np.eye(8)).max() < 1e-10 and np.abs(z.mean(axis=1)).max() < 1e-12


def test_hot_vector_and_flat_directions(spark):
    rng = np.random.default_rng(6)
    line = [(i, [float(i), 2.0, 3.0]) for i in range(20)] + [(50 + i, [4.0, 2.0, 3.0]) for i in range(300)]
    got = check(spark, line)
    assert {r.whitened is None for r in got if r.component > 1} == {True} and all(r.whitened is not None for r in got if r.component == 1)
    assert all(r.whitened is None and r.identity_error is None and r.deviation == 0 for r in check(spark, [(1, [0.5, 0.25]), (2, [0.5, 0.25])]))
    check(spark, [(1, rng.normal(size=4).tolist())])


def test_deviations_beyond_63_bits(spark):
    rows = [(i, [float(i) * 2.0**20, -float(i)]) for i in range(3000)]
    got = whiten(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).where("component = 1").collect()
    n, sums = 3000, [sum(floor(1024 * v[c]) + 100_000 for _, v in rows) for c in (0, 1)]
    for r in got:
        exact = sum((n * (floor(1024 * x) + 100_000) - s) ** 2 for x, s in zip(rows[r.vec_id][1], sums))
        assert int(r.deviation_exact) == exact and r.deviation == (exact if exact < 2**63 else None)
    assert any(r.deviation is None for r in got)


def test_empty(spark):
    assert whiten(spark.createDataFrame([], "vec_id long, embedding array<float>")).count() == 0
    assert whiten(spark.createDataFrame([(1, None), (2, [])], "vec_id long, embedding array<float>")).count() == 0
