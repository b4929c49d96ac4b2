import itertools
import random
import re

import numpy as np
import pyarrow as pa
import pytest

import lodestone.llm.near_dedup as module
from lodestone.llm.components import components
from lodestone.llm.near_dedup import near_duplicates, one_of_each


def shingle_set(text, k):
    low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    w = re.findall(r"[^\x20\x09-\x0D]+", low)
    return {tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set())


def brute(rows, k, percent):
    docs = [(i, shingle_set(t, k)) for i, t in rows]
    parent = list(range(len(docs)))

    def find(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for x in range(len(docs)):
        for y in range(x):
            a, b = docs[x][1], docs[y][1]
            if a and b and 100 * len(a & b) >= percent * len(a | b):
                parent[find(x)] = find(y)
    least = {}
    for x, (i, _) in enumerate(docs):
        least[find(x)] = min(i, least.get(find(x), i))
    return sorted((i, len(s), least[find(x)]) for x, (i, s) in enumerate(docs))


def corpus(seed, n=150):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(400)]
    rows = []
    for i in range(n):
        if rows and rng.random() < 0.6:
            w = rng.choice(rows[: max(1, len(rows) // 4)])[1].split(" ")
            for _ in range(rng.randint(0, 3)):
                w[rng.randrange(len(w))] = rng.choice(vocabulary)
            text = " ".join(w)
        else:
            text = " ".join(rng.choice(vocabulary) for _ in range(rng.choice([1, 2, 3, 30, 60, 120])))
        rows.append((i * 3 + 1, text.upper() if rng.random() < 0.1 else text))
    return rows + [(1000, ""), (1001, None), (1002, " \t\n"), (1, rows[0][1]), (2000, "two words"), (2001, "Two  WORDS"), (2002, "é x é")]


@pytest.mark.parametrize("leaf,depth,k,percent", [(128, 8, 3, 85), (4, 2, 3, 85), (4, 8, 5, 80)])
def test_matches_brute_force(spark, monkeypatch, leaf, depth, k, percent):
    monkeypatch.setattr(module, "LEAF", leaf)
    monkeypatch.setattr(module, "DEPTH", depth)
    rows = corpus(k)
    docs = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, kept int")
    got = near_duplicates(docs, k=k, percent=percent).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(rows, k, percent)


def test_components_of_chains_and_stars(spark):
    links = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(7, 7), (None, 3), (200, 201), (201, 200)]
    got = dict(map(tuple, components(spark.createDataFrame(links, "_u long, _v long")).collect()))
    assert got == {**{i: 0 for i in range(1, 41)}, **{i: 100 for i in range(101, 140)}, 201: 200}


def test_empty_and_null_ids(spark):
    assert near_duplicates(spark.createDataFrame([], "doc_id long, text string")).count() == 0
    got = near_duplicates(spark.createDataFrame([(None, "a b c d"), (4, "a b c d"), (None, "x y z")], "doc_id long, text string")).collect()
    assert sorted((tuple(r)[:3] for r in got), key=str) == [(4, 2, 4), (None, 1, None), (None, 2, 4)]


def test_one_of_each_class_stays(spark):
    rows = corpus(5)
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, _note string")
    want = {i for i, n, root in brute(rows, 5, 80) if not n or i == root}
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(r.doc_id for r in kept.collect()) == sorted(want)


def joined(links):
    parent = {}

    def find(x):
        while parent.setdefault(x, x) != x:
            x = parent[x]
        return x

    for a, b in links:
        parent[find(a)] = find(b)
    return {x: find(x) for x in list(parent)}


@pytest.mark.parametrize("seed", range(8))
def test_blocks_connect_what_is_linked_whatever_the_order_of_rows(seed):
    """Every pair with a side that asks is held in some block; links connect the linked, and are fewer than members."""
    rng = random.Random(seed)
    members = []  # key, label, asks, own block, set
    for n in rng.sample(range(3, 200), 40) + [1, 2]:
        base = 1000 * rng.randrange(3)
        values = set(range(base, base + 60)) - {base + rng.randrange(60) for _ in range(rng.choice([0, 2, 6]))}
        asks = n > 2 and rng.random() < 0.7
        members.append((bytes([n]) * 16, bytes([n]) * 16 if asks else bytes(16), asks, n % 3, np.array(sorted(values), np.int64)))
    tokens = lambda x: np.unique(x // 1000).astype("<u2").repeat(module.WIDTH).tobytes()  # noqa: E731  alike within a base
    rows, fulls = [], []
    for block in range(3):
        here = [m for m in members if m[2] or m[3] == block]
        for h, label, asks, own, s in rng.sample(here, len(here)):
            rows.append(dict(_v=1, _block=block, _h=h, _l=label, _s=tokens(s), _n=len(s), _asks=asks, _stays=own == block))
    likely = [r for b in module._candidates(85)([pa.RecordBatch.from_pylist(rows)]) for r in b.to_pylist()]
    sets = {m[0]: m[4] for m in members}
    for key, group in itertools.groupby(sorted(likely, key=lambda r: (r["_block"], r["_sub"])), lambda r: (r["_block"], r["_sub"])):
        group = list(group)
        assert len({sets[r["_h"]][0] // 1000 for r in group}) == 1
        rng.shuffle(group)
        fulls += [{**r, "_set": sets[r["_h"]].tolist()} for r in group]
    typed = pa.schema([("_v", pa.int64()), ("_block", pa.int32()), ("_sub", pa.int32()), ("_h", pa.binary()), ("_l", pa.binary()), ("_asks", pa.bool_()), ("_stays", pa.bool_()), ("_set", pa.list_(pa.int64()))])
    got = [tuple(p.values()) for b in module._linked(85)([pa.RecordBatch.from_pylist(fulls[i : i + 7], typed) for i in range(0, len(fulls), 7)]) for p in b.to_pylist()]
    labels = [(h, label) for h, label, *_ in members]
    want = [(a[0], b[0]) for a, b in itertools.combinations(members, 2) if (a[2] or b[2]) and 100 * len(set(a[4]) & set(b[4])) >= 85 * len(set(a[4]) | set(b[4]))]
    assert len(got) < len(fulls) and {tuple(sorted(p)) for p in got} <= {tuple(sorted(p)) for p in want}
    mine, theirs = joined(got + labels), joined(want + labels)
    assert len(set(mine.values())) == len(set(theirs.values()))


@pytest.mark.parametrize("percent", [80, 85])
def test_trees_reach_the_stated_recall(percent):
    """Pairs exactly at the threshold, followed down the trees by the rules of `_roots` and `_branch`."""
    rng = random.Random(percent)
    trees = 1 + max(t for t, _ in module._roots(percent))
    found = 0
    for _ in range(2000):
        for _ in range(trees):
            nodes = 1
            for _ in range(module.DEPTH + 1):
                nodes = sum(rng.random() < percent / 100 for _ in range(sum(1 + (rng.random() < module._second(percent)) for _ in range(nodes))))
            if nodes:
                found += 1
                break
    assert found / 2000 > module.RECALL - 0.015 and module.met(percent, trees, 0) > 0.9999


def test_a_loose_group_below_the_threshold(spark, monkeypatch):
    """Copies of one text that mostly miss the threshold among themselves: branched, in blocks, none lost."""
    monkeypatch.setattr(module, "LEAF", 16)
    rng = random.Random(4)
    base = [f"w{i}" for i in range(90)]
    rows = []
    for i in range(160):
        w = list(base)
        for _ in range(rng.choice([1, 4, 6, 9])):
            w[rng.randrange(len(w))] = f"x{rng.randrange(9999)}"
        rows.append((i, " ".join(w)))
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(rows, 3, 85)


def test_columns_with_working_names_pass_through(spark):
    rows = [(1, "a b c d e f", 7, 8, 9, 10), (2, "a b c d e f", 7, 8, 9, 10), (3, "", 7, 8, 9, 10)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, _K long, _q long, _id long, _c long")
    kept = one_of_each(docs)
    assert kept.columns == docs.columns and sorted(tuple(r) for r in kept.collect()) == [rows[0], rows[2]]


def test_very_long_texts(spark):
    rng = random.Random(3)
    words = [rng.choice("abcdefghij") * rng.randint(1, 5) + str(rng.randrange(500)) for _ in range(60_000)]
    other = list(words)
    for i in range(0, 60_000, 100):
        other[i] = "changed"
    rows = [(1, " ".join(words)), (2, " ".join(other)), (3, " ".join(words[:40_000]))]
    got = near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted(tuple(r)[:3] for r in got) == brute(rows, 3, 85)
