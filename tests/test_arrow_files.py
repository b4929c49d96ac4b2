"""The format of Arrow files: round trips, what filters leave unread, streams over commits, and engines over both."""

import json
import os
import random

import pytest
from pyspark.sql import functions as F

from lodestone.plans.engine import Engine
from lodestone.sources import arrow_files
from lodestone.sources.arrow_files import FORMAT, _Folder, _Reader, register_format
from lodestone.sources.registry import scan
from lodestone.spec import Attribute, EngineConfig, IndexSpec, Source
from lodestone.streaming.updates import keep_updated

SCHEMA = "element_id bigint, site_id int, section string, enabled boolean, title string, price double, tags array<string>, at timestamp, more struct<a:int,b:string>"
NEWS = IndexSpec("news", sources=(Source("entry", ("news",)),), attributes=(Attribute("title", roles=("searchable", "payload")),))


def row(n, section="news", **other):
    base = {"element_id": n, "site_id": 1, "section": section, "enabled": True, "title": f"Title {n}", "price": (n or 0) / 2, "tags": ["a", None][: (n or 0) % 3], "at": None, "more": (n, "x")}
    return tuple({**base, **other}.values())


@pytest.fixture
def folder(spark, tmp_path):
    register_format(spark)
    return f"file://{tmp_path}/elements"


def add(spark, folder, *rows, mode="append"):
    spark.createDataFrame(rows, SCHEMA).coalesce(1).write.format(FORMAT).mode(mode).save(folder)


def read(spark, folder):
    return spark.read.format(FORMAT).load(folder)


def ids(df):
    return sorted(r.element_id for r in df.select("element_id").collect())


def test_round_trip(spark, folder):
    rows = [row(1), row(2, section=None, title=""), row(3, tags=None, more=None), row(None, price=float("nan"), title="é" * 100)]
    frame = spark.createDataFrame(rows, SCHEMA).withColumn("at", F.when(F.col("element_id") > 1, F.timestamp_seconds(F.col("element_id"))))
    frame.write.format(FORMAT).mode("append").save(folder)
    found = read(spark, folder)
    assert found.schema == frame.schema and sorted(map(repr, found.collect())) == sorted(map(repr, frame.collect()))
    assert read(spark, folder).count() == 4
    some = spark.read.format(FORMAT).schema("title string, element_id bigint").load(folder)
    assert sorted(map(repr, some.collect())) == sorted(map(repr, frame.select("title", "element_id").collect()))


def test_empty_and_missing(spark, folder):
    with pytest.raises(Exception, match="nothing was committed"):
        read(spark, folder).collect()
    add(spark, folder)
    assert read(spark, folder).collect() == [] and read(spark, folder).where("element_id = 1").count() == 0


def test_overwrite_hides_what_was_before(spark, folder):
    add(spark, folder, row(1))
    before = _Folder(folder).live()
    add(spark, folder, row(2), mode="overwrite")
    add(spark, folder, row(3))
    assert before == [1] and _Folder(folder).live() == [2, 3] and ids(read(spark, folder)) == [2, 3]


def test_only_committed_files_are_read(spark, folder, tmp_path):
    add(spark, folder, row(1))
    fail = F.udf(lambda n: 1 // (n - 9), "bigint")
    with pytest.raises(Exception):
        spark.createDataFrame([row(n) for n in range(5, 12)], SCHEMA).repartition(4).withColumn("element_id", fail("element_id")).write.format(FORMAT).mode("append").save(folder)
    (tmp_path / "elements" / "stray.arrow").write_bytes(b"half a file")
    assert ids(read(spark, folder)) == [1] and _Folder(folder).numbers() == [1]


def test_files_are_cut_by_size(spark, folder, monkeypatch):
    written = arrow_files._Writer(folder, spark.createDataFrame([], SCHEMA).schema, False)
    batch = spark.createDataFrame([row(n) for n in range(50)], SCHEMA).coalesce(1).toArrow().to_batches()[0]
    monkeypatch.setattr(arrow_files, "PART_BYTES", 2 * batch.nbytes)
    message = written.write(iter([batch] * 7))
    assert [f["rows"] for f in message.files] == [100, 100, 100, 50]
    written.commit([message, None])
    assert [len(p.names) for p in _Reader(folder, written.schema).partitions()] == [1, 1, 1, 1] and read(spark, folder).count() == 350
    written.abort([message])
    assert [n for n in os.listdir(folder.removeprefix("file://")) if n.endswith(".arrow")] == []


CONDITIONS = [
    "n = 5", "n = 50", "n in (1, 7, 99)", "n in (70, 80)", "n > 5", "n >= 9", "n < 2", "n <= 0", "n is null", "n is not null", "n <=> 3", "not n = 3",
    "s = 'k3'", "s > 'k7'", "s < 'k2'", "s is null", "s like 'k1%'", "b", "not b", "b is null", "n > 2 and s < 'k5'", "n = 1 or s = 'k2'", "n = 2 and s is null", "d > 1.5", "n = null", "s >= repeat('z', 70)", "s < repeat('z', 70)",
]


def test_filters_equal_those_of_spark(spark, folder):
    draw = random.Random(3)
    rows = [(draw.choice([None, *range(10)]), draw.choice([None, "", "k1x", *(f"k{i}" for i in range(9)), "z" * 80]), draw.choice([None, True, False]), draw.random() * 3) for _ in range(300)]
    plain = spark.createDataFrame(rows, "n int, s string, b boolean, d double")
    plain.repartitionByRange(6, "n").write.format(FORMAT).mode("append").save(folder)
    held = plain.collect()
    for condition in CONDITIONS:
        found = spark.read.format(FORMAT).load(folder).where(condition)
        want = spark.createDataFrame(held, plain.schema).where(condition)
        assert sorted(map(repr, found.collect())) == sorted(map(repr, want.collect())), condition


def test_files_outside_a_filter_are_not_opened(spark, folder, tmp_path):
    for section in ("news", "shop", "blog"):
        add(spark, folder, *[row(n, section) for n in range(3)])
    last = json.loads((tmp_path / "elements" / "_commits" / f"{2:020d}.json").read_text())
    (tmp_path / "elements" / last["files"][0]["name"]).write_bytes(b"not to be read")
    assert ids(read(spark, folder).where("section = 'news'")) == [0, 1, 2]
    with pytest.raises(Exception):
        read(spark, folder).where("section = 'shop'").collect()


def test_a_source_rule_is_pushed(spark, folder, tmp_path):
    """One source's container and status reach the format: no rule is left above the scan, and other files stay closed."""
    for section in ("news", "shop"):
        add(spark, folder, *[row(n, section) for n in range(3)])
    last = json.loads((tmp_path / "elements" / "_commits" / f"{2:020d}.json").read_text())
    (tmp_path / "elements" / last["files"][0]["name"]).write_bytes(b"not to be read")
    assert ids(scan({"entry": read(spark, folder)}, NEWS)) == [0, 1, 2]
    add(spark, folder, *[row(n, "blog", enabled=None) for n in range(3)])
    several = IndexSpec("several", sources=(Source("entry", ("news",)), Source("entry", ("blog",), status="any")))
    assert ids(scan({"entry": read(spark, folder)}, several)) == [0, 0, 1, 1, 2, 2]


def test_engine_over_elements_and_their_changes(spark, folder, tmp_path):
    """Changes arrive as commits; the updater is stopped and started again between them, without loss or repeat."""
    changes, seen = f"file://{tmp_path}/changes", []
    add(spark, folder, row(1), row(2), row(3, "shop"))
    engine = Engine(spark, lambda: {"entry": read(spark, folder)}, EngineConfig(publish_path=f"file://{tmp_path}/pub"))
    engine.save(NEWS)
    engine.rebuild("news", full=True)
    titles = lambda: sorted(json.loads(r.title) for r in engine.search("news").hits.collect())
    assert titles() == ["Title 1", "Title 2"]
    real = engine.changed
    engine.changed = lambda handle, saved, deleted: (seen.append((ids(saved), ids(deleted))), real(handle, saved, deleted))[1]

    def change(*events):
        spark.createDataFrame(events, "element_id bigint, site_id int, op string, ts timestamp").write.format(FORMAT).mode("append").save(changes)

    def update():
        query = keep_updated(engine, spark.readStream.format(FORMAT).load(changes), ["news"], f"{tmp_path}/cp", once=True)
        assert query.awaitTermination(120) and query.exception() is None

    add(spark, folder, row(1, title="Changed"), row(2), row(4), mode="overwrite")
    change((1, 1, "save", None), (4, 1, "save", None))
    update()
    assert titles() == ["Changed", "Title 2", "Title 4"]
    update()
    change((2, 1, "delete", None))
    change((9, 1, "save", None))
    update()
    assert titles() == ["Changed", "Title 4"] and [s for s in seen if s != ([], [])] == [([1, 4], []), ([9], [2])]
