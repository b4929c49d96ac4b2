import hashlib
import random

import pytest

import lodestone.llm.suffix_dedup as module
from lodestone.llm.suffix_dedup import remove_repeats


def brute(rows, length):
    texts = [(t or "").encode() for _, t in rows]
    seen = {}
    for t in texts:
        for i in range(len(t) - length + 1):
            seen[t[i : i + length]] = seen.get(t[i : i + length], 0) + 1
    out = []
    for (key, _), t in zip(rows, texts):
        gone = [False] * len(t)
        for i in range(len(t) - length + 1):
            if seen[t[i : i + length]] > 1:
                gone[i : i + length] = [True] * length
        rest = bytes(b for b, g in zip(t, gone) if not g)
        runs = sum(g and not (i and gone[i - 1]) for i, g in enumerate(gone))
        out.append((key, len(t), sum(gone), runs, hashlib.sha256(rest).hexdigest()))
    return sorted(out, key=str)


def corpus(seed, n=60):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abé") for _ in range(rng.randint(1, 5)))
    text = lambda k: " ".join(word() for _ in range(k))
    hot, warm = text(30), [text(25) for _ in range(4)]
    rows = []
    for i in range(n):
        kind = i % 6
        t = text(rng.randint(1, 40))
        if kind < 3:
            t = t + " " + hot[rng.randint(0, 20) :] + " " + text(rng.randint(0, 20))
        if kind == 3:
            t = warm[i % 4] + t + warm[(i + 1) % 4]
        if kind == 4 and rows:
            t = rows[rng.randrange(len(rows))][1]
        rows.append((i, t))
    return rows + [(900, None), (901, ""), (902, "a" * 300), (903, "ab" * 120), (None, rows[0][1]), (5, rows[5][1])]


@pytest.mark.parametrize("shard", [4096, 3])
@pytest.mark.parametrize("length", [40, 64])
def test_matches_brute_force(spark, monkeypatch, length, shard):
    monkeypatch.setattr(module, "SHARD", shard)
    rows = corpus(length)
    docs = spark.createDataFrame([(k, t, "x") for k, t in rows], "doc_id long, text string, n_bytes string")
    got = remove_repeats(docs, length=length).collect()
    assert sorted(((r.doc_id, r._n_bytes, r._n_removed, r._n_spans, r._sha) for r in got), key=str) == brute(rows, length)
    assert all(r.n_bytes == "x" for r in got)


def test_repeated_rows_hold_each_place_once(spark):
    """Rows of one id and text have the same places, however many there are."""
    rng = random.Random(3)
    text = " ".join(str(rng.randint(0, 10**6)) for _ in range(60))
    sizes = {}
    for n in (2, 300):
        rows = [(1, text), (2, text[:150] + " other " + text[150:])] + [(1, text)] * (n - 1)
        docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(7)
        places = module.repeated_places(docs, "doc_id", "text", 40).collect()
        assert len(places) == 2
        sizes[n] = max(len(r._spans) for r in places)
        got = remove_repeats(docs, length=40).collect()
        assert sorted(((r.doc_id, r._n_bytes, r._n_removed, r._n_spans, r._sha) for r in got), key=str) == brute(rows, 40)
    assert sizes[300] <= 2 * sizes[2]


def test_very_long_texts(spark):
    rng = random.Random(5)
    long_ = " ".join(str(rng.randint(0, 10**9)) for _ in range(120_000))
    rows = [(1, long_), (2, "x" + long_[500_000:501_000] + "y"), (3, "z" * 100_000)]
    got = {r.doc_id: r for r in remove_repeats(spark.createDataFrame(rows, "doc_id long, text string"), length=400).collect()}
    assert got[1]._left == long_[:500_000] + long_[501_000:] and got[2]._left == "xy" and got[3]._left == "" and got[3]._n_spans == 1


def test_empty_table(spark):
    assert remove_repeats(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_contexts_of_one_anchor_can_be_split(spark, monkeypatch):
    """Contexts meet the number of their anchor's by a join of tables, so that a hot anchor is not one task's."""
    rng = random.Random(11)
    text = lambda k: " ".join(str(rng.randint(0, 10**6)) for _ in range(k))
    hot = text(8)
    rows = [(i, text(8) + " " + hot + " " + text(8)) for i in range(600)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(8)
    frames = {}
    saved = module.saved
    monkeypatch.setattr(module, "saved", lambda df, name: frames.setdefault(name, df) and saved(df, name))
    confs = {"spark.sql.autoBroadcastJoinThreshold": "-1", "spark.sql.shuffle.partitions": "64", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    confs |= {f"spark.sql.adaptive.{k}": v for k, v in {"advisoryPartitionSizeInBytes": "1k", "skewJoin.skewedPartitionThresholdInBytes": "1k", "skewJoin.skewedPartitionFactor": "1.5"}.items()}
    before = {k: spark.conf.get(k) for k in confs}
    try:
        for k, v in confs.items():
            spark.conf.set(k, v)
        got = remove_repeats(docs, length=40).collect()
        frames["sorted"].collect()
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    plan = frames["sorted"]._jdf.queryExecution().executedPlan().toString()
    joins = [line for line in plan.split("== Initial Plan ==")[0].splitlines() if "SortMergeJoin" in line and "[_a#" in line]
    assert joins and all("skew=true" in line for line in joins)
    assert sorted(((r.doc_id, r._n_bytes, r._n_removed, r._n_spans, r._sha) for r in got), key=str) == brute(rows, 40)
