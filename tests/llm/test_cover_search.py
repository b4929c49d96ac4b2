import math

import numpy as np
import pytest

import lodestone.llm.cover_search as module
from lodestone.llm.cover_search import cover_tree, quantised, top_k


def brute(rows, k):
    clean = [(i, [math.floor(256 * x) for x in v]) for i, v in rows if v is not None and all(x is not None and math.isfinite(x) for x in v)]
    out = []
    for q, a in clean:
        if q % 50 == 0:
            scores = sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in clean if i != q and len(a) == len(b))
            out += [(q, n + 1, i, -s) for n, (s, i) in enumerate(scores[:k])]
    return sorted(out)


@pytest.mark.parametrize("block,chunk", [(4096, 4096), (3, 50)])
def test_matches_brute_force(spark, monkeypatch, block, chunk):
    monkeypatch.setattr(module, "BLOCK", block)
    monkeypatch.setattr(module, "CHUNK", chunk)
    rng = np.random.default_rng(5)
    centers = rng.normal(size=(5, 8))
    rows = [(i, (centers[i % 5] + 0.1 * rng.normal(size=8)).tolist()) for i in range(700)]
    rows += [(i, rows[0][1]) for i in range(700, 760)]
    rows += [(800, None), (850, [None] * 8), (900, [float("nan")] * 8), (950, [float("inf")] * 8), (1000, [1.0, 2.0]), (1001, [0.5, -1.0]), (1050, [])]
    df = spark.createDataFrame([(i, v, 0) for i, v in rows], "vec_id long, embedding array<double>, score int").repartition(3)
    data = quantised(df, "vec_id", "embedding")
    assert sorted(map(tuple, top_k(data, data.where("_id % 50 = 0")).collect())) == brute(rows, 5)


def test_tree_covers_its_rows():
    points = np.random.default_rng(1).normal(size=(500, 4))
    nodes, seen = [cover_tree(points)], []
    while nodes:
        node = nodes.pop()
        assert (np.sqrt(((points[node.rows] - node.center) ** 2).sum(axis=1)) <= node.radius + 1e-9).all()
        nodes += node.children
        seen += [] if node.children else node.rows.tolist()
    assert sorted(seen) == list(range(500))


def test_scores_beyond_53_bits(spark):
    rows = [(i, [2**30 + i, 2**30 - i, i]) for i in range(200)]
    data = spark.createDataFrame(rows, "_id long, _v array<long>")
    want = {q: sorted((-sum(x * y for x, y in zip(a, b)), i) for i, b in rows if i != q)[:5] for q, a in rows if q % 50 == 0}
    got = top_k(data, data.where("_id % 50 = 0")).collect()
    assert sorted((r.query_id, -r.score, r.vec_id) for r in got) == sorted((q, *x) for q, best in want.items() for x in best)
    assert any(r.score > 2**60 for r in got)


def test_empty(spark):
    data = quantised(spark.createDataFrame([], "vec_id long, embedding array<float>"), "vec_id", "embedding")
    assert top_k(data, data).count() == 0
