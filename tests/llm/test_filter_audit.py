import re
from itertools import permutations

import pytest

from lodestone.llm.filter_audit import audit

LONG = "Some WORDS of a very long text, " * 200_000
GOOD = " ".join(f"word{i}" for i in range(120))
ROWS = [
    (1, GOOD, "en"),
    (2, GOOD, "de"),
    (2, GOOD, "de"),
    (3, GOOD + " #", "en"),
    (4, None, "en"),
    (5, "", None),
    (6, " \t\n\x0b\x0c\r ", "en"),
    (7, "SHOUTING " * 150, "en"),
    (8, "Word word word " + GOOD.upper(), ""),
    (9, "é" * 50 + " ABC|", "fr"),
    (10, LONG, "fr"),
    (11, LONG, "fr"),
    (None, GOOD, "en"),
    (None, None, None),
    (0, GOOD, None),
    (12, "x$" + GOOD, "en"),
]
LABELS = [(1, 1, 0), (2, 0, 1), (3, 1, 1), (3, 0, None), (4, None, None), (7, 1, 0), (9, 1, 1), (11, 1, 1), (99, 1, 1), (None, 1, 1)]


def plain(rows, labels):
    """Filter by filter, for every order."""
    own = []
    for n, (i, t, lang) in enumerate(rows):
        t = t or ""
        words = re.findall(r"[^\x20\x09-\x0D]+", t)
        fails = ["A"] * (len(words) < 100) + ["B"] * (100 * len(set(words)) < 80 * len(words)) + ["C"] * (100 * len(re.findall("[A-Z]", t)) > 10 * len(t)) + ["D"] * bool(re.search(r"[#$%&*|]", t))
        fails += ["E"] * any(i is not None and j is not None and j < i and (u or "") == t for j, u, _ in rows)
        good, bad = (any(d == i and x[k] == 1 for d, *x in labels if d is not None) for k in (0, 1))
        own.append((lang or "", set(fails), good, bad))
    out = {}
    for part in {o[0] for o in own}:
        shapley = dict.fromkeys("ABCDE", 0)
        lines = []
        for order in permutations("ABCDE"):
            left = [o for o in own if o[0] == part]
            gone = []
            for step, f in enumerate(order):
                cut = [o for o in left if f in o[1]]
                redundant = sum(f in o[1] for o in gone)
                left = [o for o in left if f not in o[1]]
                lines.append(("".join(order), step + 1, f, len(left), len(cut), redundant, sum(o[0] == part and o[1] == {f} for o in own), sum(o[2] for o in cut), sum(o[3] for o in cut)))
                shapley[f] += len(cut)
                gone += cut
        for order, step, f, *counts in lines:
            out[part, order, step] = (*counts, shapley[f])
    return out


def result(spark, rows, labels, extra=""):
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(3)
    for c in extra.split():
        docs = docs.withColumn(c, docs["doc_id"].cast("string"))
    out = audit(docs, spark.createDataFrame(labels, "doc_id long, quality int, toxic int"))
    return {(r.part, r.filter_order, r.step): tuple(r)[3:] for r in out.collect()}


def test_matches_filters_one_by_one(spark):
    want = plain(ROWS, LABELS)
    got = result(spark, ROWS, LABELS)
    assert len(got) == 600 * 4 and got == want
    assert sum(want[p, "ABCDE", 1][0] + want[p, "ABCDE", 1][1] for p in ("en", "de", "fr", "")) == len(ROWS)


def test_columns_with_clashing_names(spark):
    assert result(spark, ROWS[:5], LABELS, "_id _key _n _t mask part n quality toxic step filter applied") == plain(ROWS[:5], LABELS)


@pytest.mark.parametrize("rows", [[], [(None, None, None)]])
def test_empty(spark, rows):
    assert result(spark, rows, []) == plain(rows, [])
