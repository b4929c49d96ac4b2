import base64
import hashlib
import json
import random
from collections import Counter

import pytest

import lodestone.llm.warc as module
from lodestone.llm.common import scratch
from lodestone.llm.warc import LoserTree, archive, merge_index, read_run, url_key, write_archives, write_run


@pytest.mark.parametrize("k", [0, 1, 2, 3, 7, 8, 13])
def test_loser_tree_merges(k):
    rng = random.Random(k)
    runs = [sorted([rng.randint(0, 20), rng.randint(0, 5)] for _ in range(rng.choice([0, 1, 30]))) for _ in range(k)]
    assert list(LoserTree([iter(r) for r in runs])) == sorted(x for r in runs for x in r)


def test_url_keys():
    assert url_key("http://www.Example.com:80/A?b=1#c") == "com,example)/a?b=1"
    assert url_key("https://m.example.org:8080") == "org,example,m:8080)/"
    assert url_key(None) == url_key("") == "-"


def test_run_slices(tmp_path):
    entries = [[f"k{i:04}", "t", i] for i in range(1000)]
    name, n, some = write_run(str(tmp_path), entries)
    places = [json.loads(line) for line in some]
    assert n == 1000 and places == sorted(places) and list(read_run(str(tmp_path), name)) == entries
    assert list(read_run(str(tmp_path), name, ["k0100"], ["k0300"])) == entries[100:300]
    assert list(read_run(str(tmp_path), name, ["k0100", "t", 101], ["k0300", "t"])) == entries[101:300]
    assert list(read_run(str(tmp_path), name, ["k0999x"])) == []


def test_run_slices_by_halves(tmp_path, monkeypatch):
    """With lines longer than what is read at once, over every bound."""
    monkeypatch.setattr(module, "CHUNK", 64)
    entries = sorted([f"k{i:04}" + "x" * (i * 37 % 300), "t", i] for i in range(300))
    name, _, some = write_run(str(tmp_path), entries)
    assert 16 <= len(some) <= 32 and [json.loads(line) for line in some] == sorted(json.loads(line) for line in some)
    for i in range(0, 300, 7):
        low, high = entries[i], entries[min(299, i + 5)]
        assert list(read_run(str(tmp_path), name, low, high)) == [e for e in entries if low <= e < high]
        assert list(read_run(str(tmp_path), name, [low[0][:-1] + "!"], high)) == [e for e in entries if [low[0][:-1] + "!"] <= e < high]
    assert list(read_run(str(tmp_path), name, ["z"])) == []


def test_memory_of_a_range_does_not_follow_the_run(tmp_path):
    import tracemalloc

    most = {}
    for n in (4_000, 64_000):
        name, *_ = write_run(str(tmp_path), ([f"k{i:07}", "2024-01-01T00:00:00Z", i, "archive", i, 100] for i in range(n)))
        tracemalloc.start()
        assert len(list(read_run(str(tmp_path), name, [f"k{n // 2:07}"], [f"k{n // 2 + 10:07}"]))) == 10
        most[n] = tracemalloc.get_traced_memory()[1]
        tracemalloc.stop()
    assert most[64_000] < 1.2 * most[4_000] + 10_000


def test_very_long_html(spark):
    rows = [(1, "http://a/", "é" * 2_000_000), (2, "http://b/" + "u" * 200_000, "é" * 2_000_000), (3, "http://c/", "short")]
    got = {r.page_id: (r.payload_bytes, r.record_type, r.refers_to) for r in archive(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: (4_000_000, "revisit", 2), 2: (4_000_000, "response", None), 3: (5, "response", None)}


def pages():
    rng = random.Random(4)
    rows = [(i, f"https://www.h{rng.randint(0, 9)}.example.com/{rng.randint(0, 30)}", rng.choice(["<p>é</p>", "", "x" * 50_000, f"own {i}", None])) for i in range(300)]
    return [*rows, (1000, None, "null url"), (1001, "a\r\nb", "odd url"), (None, "http://n/", "<p>é</p>"), (None, "http://n/", "only null ids"), (None, "http://n/", "only null ids"), (1002, "u", "twice"), (1002, "u", "twice")]


def brute(rows, least):
    out = []
    for i, _, html in rows:
        body = (html or "").encode()
        same = [j for j, _, h in rows if (h or "").encode() == body and j is not None] if len(body) >= least else []
        head = max(same, default=None)
        refers = None if head is None or head == i else head
        out.append((i, len(body), base64.b32encode(hashlib.sha1(body).digest()).decode(), "response" if refers is None else "revisit", refers))
    return sorted(out, key=str)


@pytest.mark.parametrize("least,fan_in", [(0, 256), (10, 4)])
def test_archives_give_back_the_pages(spark, monkeypatch, least, fan_in):
    monkeypatch.setattr(module, "FAN_IN", fan_in)
    df = spark.createDataFrame([(*r, 1) for r in pages()], "page_id long, url string, html string, length int").repartition(9)
    assert sorted(map(tuple, archive(df, least).collect()), key=str) == brute(pages(), least)


def test_index_is_globally_ordered(spark):
    df = spark.createDataFrame(pages(), "page_id long, url string, html string").repartition(5)
    folder = scratch(spark, "warc")
    index = merge_index(write_archives(df, folder), folder).orderBy("part", "place").collect()
    assert len(index) == len(pages()) and [(r.key, r.time) for r in index] == sorted((r.key, r.time) for r in index)


@pytest.mark.parametrize("url", ["http://one.example/", None])
def test_captures_of_one_url_are_several_ranges(spark, monkeypatch, url):
    monkeypatch.setattr(module, "RUN", 500)  # on the driver only: it sets the number of ranges
    rows = [(i if i % 3 else None, url, f"page {i % 40}") for i in range(4000)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)
    folder = scratch(spark, "warc")
    index = merge_index(write_archives(df, folder), folder).orderBy("part", "place").collect()
    order = [(r.key, r.time, r.page_id, r.archive, r.offset) for r in index]
    sizes = Counter(r.part for r in index)
    assert len(index) == len(set(order)) == 4000 and order == sorted(order)
    assert len(sizes) >= 8 and max(sizes.values()) < 1000


def test_empty(spark):
    assert archive(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0
