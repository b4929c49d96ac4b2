"""The corpus pipeline on a small folder of tables: each stage against a plain version on the same input."""

import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest

import corpus_pipeline as pipeline
from lodestone.llm import packing, quality
from tests.llm.test_decontaminate import holds, split
from tests.llm.test_near_dedup import brute as classes
from tests.llm.test_suffix_dedup import brute as repeats


def n_words(text):
    return len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))


SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def tables():
    rng = random.Random(12)
    vocabulary = ["".join(rng.choice("abcdefghijkl") for _ in range(rng.randint(2, 9))) for _ in range(900)]
    text = lambda n: " ".join(rng.choice(vocabulary) for _ in range(n))
    passage, short = text(60), " ".join(rng.choice("abcdefgh") + rng.choice("xyz") * 3 for _ in range(51))
    items = [(i, text(rng.choice([12, 25]))) for i in range(6)] + [(90, None), (None, "of"), (91, "")]
    docs, labels = [], []
    for i in range(240):
        t = text(rng.randint(20, 160))
        if i % 10 == 0:
            t = " ".join(w.upper() + "%%$" for w in t.split())
        elif i % 10 == 1 and docs:
            t = docs[rng.randrange(len(docs))][1]
        elif i % 10 == 2 and docs:
            w = docs[rng.randrange(len(docs))][1].split(" ")
            w[rng.randrange(len(w))] = "changed"
            t = " ".join(w)
        elif i % 10 == 3:
            t += " " + passage + " " + text(3)
        elif i % 10 == 4:
            t = text(4) + " " + short + " " + t
        elif i % 20 == 5:
            t += " " + items[rng.randrange(6)][1].title()
        docs.append((i, t, "en", f"s{i % 3}", len(t)))
        if i % 10 != 9:
            labels.append((i, int("%%$" not in t), 0))
    docs += [(500, "", "en", None, 0), (501, None, None, "s", None), (None, docs[33][1], "en", "s", 1), docs[7], docs[7], (502, " ".join(vocabulary * 25), "en", "s0", 7)]
    return docs, labels, items


@pytest.fixture(scope="module")
def folder(spark, tmp_path_factory):
    docs, labels, items = tables()
    at = tmp_path_factory.mktemp("tables")
    spark.createDataFrame(docs, SCHEMA).write.parquet(f"{at}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(f"{at}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{at}/benchmark.parquet")
    return str(at)


@pytest.fixture(scope="module")
def steps(spark, folder):
    """What goes into each stage and what the last gives, as rows."""
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    out = [[tuple(r) for r in docs.collect()]]
    for name, stage in pipeline.STAGES:
        docs = pipeline.saved(stage(spark, docs, folder), "test-stage")
        assert name == "packing" or docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        out.append([tuple(r) for r in docs.collect()])
    return out


def test_quality_stage(steps):
    docs, labels, _ = tables()
    known = {i: q for i, q, _ in labels}
    chosen = sorted((r[0], known[r[0]], r[1]) for r in docs if r[0] in known and zlib.crc32(str(r[0]).encode()) % 5)
    model = quality.Ranker.fit(quality.features([t.encode() for _, _, t in chosen]), np.array([y > 0 for _, y, _ in chosen]))
    score = model.score(quality.features([(r[1] or "").encode() for r in steps[0]]))
    assert Counter(steps[1]) == Counter(r for r, s in zip(steps[0], score) if s >= quality.CUT)
    assert not any("%%$" in (r[1] or "") for r in steps[1]) and len(steps[1]) > 190


def test_quality_stage_has_no_job_for_each_partition(spark, folder, monkeypatch):
    monkeypatch.setattr(quality, "BUCKET", 1)
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    spark.conf.set("spark.sql.shuffle.partitions", "16")
    spark.sparkContext.setJobGroup("quality stage", "")
    try:
        pipeline.accept_quality(spark, docs, folder)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert len(spark.sparkContext.statusTracker().getJobIdsForGroup("quality stage")) < 50


def test_near_duplicate_stage(steps):
    known = [(r[0], r[1]) for r in steps[1] if r[0] is not None]
    want = {i for i, n, root in classes(known, 5, 80) if not n or i == root}
    got = [r for r in steps[2] if r[0] is not None]
    assert sorted(r[0] for r in got) == sorted(want) and set(steps[2]) <= set(steps[1])


def test_passage_stage(steps):
    before, after = {r[0]: r for r in steps[2]}, {r[0]: r for r in steps[3]}
    assert before.keys() == after.keys() and all(before[i][2:4] == after[i][2:4] for i in before)
    want = {i: (n, gone) for i, n, gone, *_ in repeats([(i, r[1]) for i, r in before.items()], pipeline.PASSAGE)}
    for i, (n, gone) in want.items():
        assert len((after[i][1] or "").encode()) in range(n - gone - 6, n - gone + 1) and after[i][4] == len(after[i][1] or "")
    docs, _, _ = tables()
    passage = docs[3][1].split()[-63:-3]
    assert not any(" ".join(passage[:55]) in (r[1] or "") for r in steps[3])


def test_benchmark_stage(steps):
    items = [split(t) for i, t in tables()[2] if i is not None and split(t)]
    assert Counter(steps[4]) == Counter(r for r in steps[3] if not any(holds(item, split(r[1])) for item in items))
    assert len(steps[4]) < len(steps[3])


def test_packing_stage(steps):
    assert Counter(r[:5] for r in steps[5]) == Counter(steps[4])
    lengths = Counter(n_words(r[1]) for r in steps[4])
    value = np.array(sorted(lengths))
    bounds = packing.boundaries(value, np.array([lengths[v] for v in value.tolist()]), packing.BUCKETS)
    batches = Counter()
    for r in steps[5]:
        n, bucket, lot, batch, padding = r[5:]
        assert n == n_words(r[1]) and bucket == min(b for b in bounds if b >= n) and padding == bucket - n
        batches[bucket, lot, batch] += 1
    assert all(k == 1 or k * b <= packing.BUDGET for (b, _, _), k in batches.items() if b)


def test_run_and_empty_tables(spark, folder, steps, tmp_path):
    got = pipeline.run(spark, folder)
    assert Counter(r.doc_id for r in got.collect()) == Counter(r[0] for r in steps[5])
    for name in ("documents", "labels", "benchmark"):
        spark.read.parquet(f"{folder}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0
