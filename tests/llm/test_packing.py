import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

import lodestone.llm.packing as module
from lodestone.llm.packing import boundaries, pack, rounded


def padding(lengths, counts, bounds):
    return sum(c * (min(b for b in bounds if b >= x) - x) for x, c in zip(lengths, counts))


@pytest.mark.parametrize("buckets", [1, 2, 3, 5, 20])
def test_boundaries_are_optimal(buckets):
    rng = np.random.default_rng(buckets)
    for _ in range(15):
        lengths = np.unique(rng.integers(0, 60, rng.integers(1, 10)))
        counts = rng.integers(1, 9, len(lengths))
        got = boundaries(lengths, counts, buckets)
        assert len(got) <= buckets and got[-1] == lengths[-1]
        best = min(padding(lengths, counts, [*c, lengths[-1]]) for n in range(min(buckets, len(lengths))) for c in itertools.combinations(lengths[:-1], n))
        assert padding(lengths, counts, got) == best


def test_no_lengths():
    assert boundaries(np.empty(0, np.int64), np.empty(0, np.int64), 4) == []


def test_rounding_is_fine_and_upward(spark):
    rows = spark.createDataFrame([(n,) for n in [0, 1, 2, 255, 256, 257, 300, 513, 100_000, 2**31 + 5]], "n long").select("n", rounded(F.col("n")).alias("r")).collect()
    assert all(n <= r <= n * (1 + 1 / 128) for n, r in rows)


def test_batches_hold_the_budget(spark, monkeypatch):
    monkeypatch.setattr(module, "LOT", 50)
    rng = np.random.default_rng(0)
    rows = [(i, " ".join(["w"] * int(n)), "x") for i, n in enumerate(rng.integers(0, 400, 700))] + [(None, "a b", "x"), (7, "a b c", "x"), (7, "a b c", "x"), (9000, None, "x"), (9001, " \n", "x"), (9002, "w " * 3000, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, batch string")
    got = pack(docs, buckets=4, budget=1000).toPandas()
    assert len(got) == len(rows)
    assert sorted(got.n_tokens) == sorted(len((t or "").split()) for _, t, _ in rows)
    assert (got.padding >= 0).all() and (got.bucket_length - got.n_tokens == got.padding).all() and got.bucket_length.nunique() <= 4
    for (bound, _, _), batch in got.groupby(["bucket_length", "lot", "batch"]):
        assert len(batch) == 1 or len(batch) * bound <= 1000
    short = got.groupby(["bucket_length", "lot", "batch"]).size().reset_index(name="n")
    for (bound, _), lot in short.groupby(["bucket_length", "lot"]):
        assert (lot.sort_values("batch").n.iloc[:-1] == max(1, 1000 // max(1, bound))).all()


def test_empty(spark):
    assert pack(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_long_lengths_are_exact(spark):
    lengths = [16_385, 16_386, 20_001, 20_003, 20_063, 33_000, 33_001, 33_100]
    docs = spark.createDataFrame([(i, n) for i, n in enumerate(lengths)], "doc_id long, n long")
    got = pack(docs, length=F.col("n"), buckets=4).toPandas()
    assert set(got.bucket_length) <= set(lengths)  # boundaries are lengths of documents
    ones = [1] * len(lengths)
    assert got.padding.sum() == min(padding(lengths, ones, [*c, lengths[-1]]) for c in itertools.combinations(lengths[:-1], 3))


def test_many_distinct_lengths():
    rng = np.random.default_rng(4)
    lengths = np.unique(rng.integers(0, 10**6, 100_000))
    counts = rng.integers(1, 9, len(lengths))
    got = np.array(boundaries(lengths, counts, 16))
    assert len(got) == 16 and got[-1] == lengths[-1]
    some = np.sort(rng.choice(len(lengths), 300, replace=False))
    small, times = lengths[some], counts[some]
    cost = [0] + [padding(small[:j], times[:j], [small[j - 1]]) for j in range(1, 301)]
    for _ in range(3):  # every split, no monotony
        cost = [0] + [min(cost[i] + int((times[i:j] * (small[j - 1] - small[i:j])).sum()) for i in range(j)) for j in range(1, 301)]
    assert padding(small, times, boundaries(small, times, 4)) == cost[-1]
