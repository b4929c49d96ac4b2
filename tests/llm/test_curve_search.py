import math

import numpy as np
import pytest

import lodestone.llm.curve_search as module
from lodestone.llm.curve_search import Curves, _parting, hilbert, near, vectors

NONE = [(800, None), (840, [None] * 8), (900, [float("nan")] * 8), (960, [float("inf")] * 8), (980, [0.0] * 8), (1000, [1.0, 2.0]), (1001, [0.5, -1.0]), (1060, []), (None, [1.0] * 8)]


def brute(rows, k):
    clean = {(i, tuple(v)) for i, v in rows if i is not None and v is not None and all(x is not None and math.isfinite(x) for x in v) and any(v)}
    out = {}
    for q, a in clean:
        if q % 20 == 0:
            scores = sorted((-float((np.array(a) * np.array(b)).sum()), i) for i, b in clean if i != q and len(a) == len(b))
            out[q] = [(i, -s) for s, i in scores[:k]]
    return out


def found(spark, rows, k=20, parts=3):
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(parts)
    data = vectors(df)
    out = {}
    for r in sorted(near(data, data.where("_id % 20 = 0"), k).collect(), key=lambda r: (r.query_id, r.rank)):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r.rank == len(out[r.query_id])
    return out


def test_one_tile_is_exact(spark):
    """With copies, near copies, ties, vectors that take no part and other dimensions."""
    rng = np.random.default_rng(5)
    rows = [(i, rng.integers(-3, 4, 8).astype(float).tolist()) for i in range(110)]
    rows += [(i, rows[0][1]) for i in range(200, 280)] + [rows[3], rows[4]] + NONE
    want = brute(rows, 20)
    got = found(spark, rows)
    assert got == {q: n for q, n in want.items() if n}
    assert len(want[1000]) == 1 and got[1000] == want[1000]


@pytest.mark.parametrize("held,at_once,most", [(4096, 3, 65_536), (5, 12, 20)])
def test_recall_over_tiles(spark, monkeypatch, held, at_once, most):
    """Clusters of different lengths, and noise: nine of ten neighbours at least, every score exact, and no query missing."""
    monkeypatch.setattr(module, "HELD", held)
    monkeypatch.setattr(module, "AT_ONCE", at_once)
    monkeypatch.setattr(module, "MOST_TILES", most)
    rng = np.random.default_rng(2)
    centers = rng.normal(size=(40, 16)) * rng.random((40, 1)) * 3
    rows = [(i, ((centers[i % 40] if i % 3 else 0) + 0.3 * rng.normal(size=16)).tolist()) for i in range(4000)]
    rows += [(5000 + i, rows[7][1]) for i in range(1500)]
    want, got = brute(rows, 20), found(spark, rows)
    assert got.keys() == want.keys() and all(len(n) == 20 for n in got.values())
    assert np.mean([len({i for i, _ in want[q]} & {i for i, _ in got[q]}) / 20 for q in want]) >= 0.9
    own = dict(rows)
    assert all(s == float((np.array(own[q]) * np.array(own[i])).sum()) for q, n in got.items() for i, s in n)


def test_curve_is_continuous():
    """Each step of the curve goes to a neighbouring cell, and every cell is met once."""
    grid = np.array(np.meshgrid(*[np.arange(8)] * 3)).reshape(3, -1).T
    keys = hilbert(grid, 3)
    assert sorted(keys.tolist()) == list(range(512))
    path = grid[np.argsort(keys)]
    assert (np.abs(np.diff(path, axis=0)).sum(axis=1) == 1).all()


def test_equal_vectors_have_equal_keys():
    m = np.random.default_rng(3).normal(size=(50, 8))
    m[10:40] = m[0]
    curves = Curves.fitted(m, float(np.linalg.norm(m, axis=1).max()), 4, 1)
    keys = curves.keys(curves.lifted(m), _parting(m))
    assert (keys[:, 10:40] == keys[:, :1]).all() and len(set(keys[0].tolist())) == 20
    assert _parting(np.array([[0.0, 1.0]])) == _parting(np.array([[-0.0, 1.0]]))


def test_empty(spark):
    assert found(spark, []) == {}
    assert found(spark, NONE[:5]) == {}
