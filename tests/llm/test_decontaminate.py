import random
import re

import numpy as np
import pytest

import lodestone.llm.decontaminate as module
from lodestone.llm.decontaminate import allowed, distance, edited, embed, gram_of, held_items


def split(text):
    low = bytes(b + 32 if 65 <= b <= 90 else b for b in (text or "").encode())
    return re.findall(rb"[0-9A-Za-z\x80-\xff]+", low)


def holds(item, text):
    row = [0] * (len(text) + 1)
    for i, a in enumerate(item):
        new = [i + 1]
        for j, b in enumerate(text):
            new.append(min(row[j] + (a != b), row[j + 1] + 1, new[j] + 1))
        row = new
    return min(row) <= allowed(len(item))


def corpus():
    rng = random.Random(8)
    word = lambda: rng.choice(["the", "of", "a"]) if rng.random() < 0.3 else f"v{rng.randrange(300)}"
    text = lambda n: [word() for _ in range(n)]
    items = [(i, " ".join(text(rng.choice([1, 2, 4, 7, 12, 20, 40, 60])))) for i in range(25)] + [(100, None), (101, "!!"), (None, "the of"), (3, "v1 v2 v3 v4 v5 v6")]
    docs = []
    for i in range(300):
        body = text(rng.randint(0, 80))
        if i % 2:
            item = rng.choice(items[:25])[1].split()
            for _ in range(rng.randint(0, allowed(len(item)))):
                at = rng.randrange(len(item) + 1)
                item[at : at + rng.randint(0, 1)] = [word()] * rng.randint(0, 1)
            at = rng.randint(0, len(body))
            body[at:at] = item
        docs.append((i, " ".join(body).title() if i % 7 == 0 else ", ".join(body)))
    return docs + [(500, None), (501, ""), (None, docs[1][1]), (1, docs[1][1])], items


def test_matches_full_edit_distance(spark):
    docs, items = corpus()
    want = {}
    for i, text in docs:
        own = split(text)
        want[i, text] = sorted({k for k, t in items if k is not None and split(t) and holds(split(t), own)})
    df = spark.createDataFrame([(i, t, 1) for i, t in docs], "doc_id long, text string, item_id int")
    found = held_items(df, spark.createDataFrame([(i, t, "x") for i, t in items], "item_id long, text string, _note string")).collect()
    got = [((r.doc_id, r.text), r._items) for r in found]
    assert len(got) == len(docs) and all(set(v) <= set(want[k]) for k, v in got)
    wanted, met = sum(len(want[k]) for k, _ in got), sum(len(v) for _, v in got)
    assert wanted > 100 and met >= 0.99 * wanted


def test_distance_and_grams():
    a = np.array([1, 2, 3, 4], np.uint64)
    assert distance(a, np.array([9, 1, 2, 4, 9], np.uint64)) == 1 and distance(a, np.array([], np.uint64)) == 4
    for m in range(1, 500):
        assert (m - allowed(m)) // (allowed(m) + 1) >= gram_of(m) >= 1


def test_embedding_keeps_near_strings_near():
    rng = np.random.default_rng(1)
    a = rng.integers(0, 1000, (1, 40)).astype(np.uint64)
    b = a.copy()
    b[0, 20] = 5
    c = rng.integers(0, 1000, (1, 40)).astype(np.uint64)
    near = np.mean([(embed(a, w) != embed(b, w)).sum() for w in range(6)])
    assert near < 20 < np.mean([(embed(a, w) != embed(c, w)).sum() for w in range(6)])


def test_empty_tables(spark):
    none = spark.createDataFrame([], "item_id long, text string")
    docs = spark.createDataFrame([(1, "a b c")], "doc_id long, text string")
    assert held_items(docs, none).collect()[0]._items == []
    assert held_items(docs.limit(0), none).count() == 0


@pytest.mark.parametrize("share", [0.1, 0.2])
@pytest.mark.parametrize("size", [5, 10, 20, 40, 80, 150])
def test_recall_by_length(size, share):
    """Edited items amid other words of a shared vocabulary: at least 0.9 of them, at most edits too."""
    rng = np.random.default_rng(size)
    items = [(i, " ".join(f"v{w}" for w in rng.integers(0, 2000, size).tolist())) for i in range(60)]
    texts = []
    for i, text in items:
        own = [int(w[1:]) for w in text.split()]
        words = edited(own, int(share * size + 1e-9), rng)
        around = [rng.integers(0, 2000, int(n)).tolist() for n in rng.integers(0, 50, 2)]
        texts.append(" ".join(f"v{w}" for w in [*around[0], *words, *around[1]]).encode())
    found = module.Items(items).find(texts)
    assert np.mean([i in f for (i, _), f in zip(items, found)]) >= 0.9


def test_blocks_of_items_in_passes(spark, monkeypatch):
    docs, items = corpus()
    df = spark.createDataFrame([(i, t, "u") for i, t in docs], "doc_id long, text string, _before string")
    known = spark.createDataFrame(items, "item_id long, text string")
    whole = sorted((str(r.doc_id), r.text or "", r._items) for r in held_items(df, known).collect())
    monkeypatch.setattr(module, "BLOCK", 10)
    got = held_items(df, known)
    assert got.columns == ["doc_id", "text", "_before", "_items"]
    assert sorted((str(r.doc_id), r.text or "", r._items) for r in got.collect()) == whole


def test_a_very_long_text(spark):
    rng = random.Random(6)
    words = [f"v{rng.randrange(5000)}" for _ in range(100_000)]
    words[70_000:70_000] = ["alpha", "beta", "gamma", "delta", "epsilon", "zeta"]
    docs = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words[:70_000]))], "doc_id long, text string")
    items = spark.createDataFrame([(9, "alpha beta gamma delta epsilon zeta"), (8, " ".join(words[20:90]))], "item_id long, text string")
    assert sorted((r.doc_id, r._items) for r in held_items(docs, items).collect()) == [(1, [8, 9]), (2, [8])]
