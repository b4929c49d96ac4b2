"""Sources, the store, publication and the updater, end to end on small tables."""

import json
import random
import time
from datetime import datetime

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from lodestone.operators import store as st
from lodestone.operators.publish import Folder, differences
from lodestone.operators.relations import dependencies, with_related
from lodestone.plans.engine import Engine, NotPublished
from lodestone.sources.registry import Kind, covers, register_kind, scan
from lodestone.spec import Attribute, EngineConfig, IndexSpec, Source, SpecError
from lodestone.streaming.updates import STATE_STORE, apply_changes, bursts, debounced, deduplicated, due, keep_updated, latest, relevant

SCHEMA = "element_id bigint, site_id int, section string, entry_type string, enabled boolean, draft_id int, title string, price double"
ROWS = [
    (1, 1, "news", "post", True, None, "Red saw", 10.0),
    (2, 1, "news", "note", True, None, "Blue saw", 20.0),
    (2, 2, "news", "post", True, None, "Scie bleue", 20.0),
    (3, 1, "shop", "post", True, None, "Hose", 5.0),
    (4, 1, "news", "post", False, None, "Hidden", 1.0),
    (5, 1, "news", "post", True, 9, "Draft", 1.0),
]
SPEC = IndexSpec(
    "news",
    sources=(Source("entry", ("news",)),),
    attributes=(Attribute("title", roles=("searchable", "payload", "sortable")), Attribute("price", roles=("facet", "sortable"), facet_type="numeric")),
    transport="json",
)


@pytest.fixture
def world(spark, tmp_path):
    state = {"rows": list(ROWS), "deps": [(1, 70), (2, 70), (3, 71)]}
    tables = lambda: {"entry": spark.createDataFrame(state["rows"], SCHEMA)}
    deps = lambda: spark.createDataFrame(state["deps"], "element_id bigint, dep_element_id bigint")
    engine = Engine(spark, tables, EngineConfig(publish_path=f"file://{tmp_path}/pub"), deps)
    engine.save(SPEC)
    return state, engine


def keys(spark, *pairs):
    return spark.createDataFrame(list(pairs), "element_id bigint, site_id int")


def titles(engine):
    return sorted(json.loads(h.title) for h in engine.search("news").hits.collect())


def test_sources(spark):
    df = spark.createDataFrame(ROWS, SCHEMA)
    pick = lambda s: sorted((r.element_id, r.site_id) for r in df.where(covers(df, s)).collect())
    assert pick(Source("entry", ("news",), ("post",))) == [(1, 1), (2, 2)]
    assert pick(Source("entry", status="any")) == [(1, 1), (2, 1), (2, 2), (3, 1), (4, 1)]
    assert pick(Source("entry", ("none",))) == []
    two = IndexSpec("x", sites=(1,), sources=(Source("entry", ("news",)), Source("entry", ("news", "shop"), ("post",))))
    assert sorted(r.element_id for r in scan({"entry": df}, two).collect()) == [1, 2, 3]
    users = spark.createDataFrame([(9, 1, ["a", "b"], "active"), (8, 1, ["c"], "active"), (7, 1, ["a"], "pending")], "element_id bigint, site_id int, groups array<string>, status string")
    mixed = IndexSpec("x", sources=(Source("entry", ("shop",)), Source("user", ("a",)), Source("ghost")))
    assert sorted(r.element_id for r in scan({"entry": df, "user": users}, mixed).collect()) == [3, 9]
    with pytest.raises(ValueError):
        scan({}, two)


def test_last_source_of_a_row_wins(spark):
    register_kind(Kind("copy", "section", live="enabled"))
    a, b = spark.createDataFrame(ROWS[:1], SCHEMA), spark.createDataFrame([(1, 1, "news", "post", True, None, "Other", 1.0)], SCHEMA)
    assert [r.title for r in scan({"entry": a, "copy": b}, IndexSpec("x", sources=(Source("entry"), Source("copy")))).collect()] == ["Other"]


def test_scan_filters_reach_parquet(spark, tmp_path):
    spark.createDataFrame(ROWS, SCHEMA).write.parquet(f"{tmp_path}/t")
    plan = scan({"entry": spark.read.parquet(f"{tmp_path}/t")}, SPEC).select("title")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [" in plan and "price" not in plan.split("ReadSchema")[1]


def test_store_steps(spark):
    store = spark.createDataFrame([(1, 1, "a", False, False), (2, 1, "b", False, False), (3, 1, "c", True, False)], "element_id bigint, site_id int, object_id string, dirty boolean, deleted boolean")
    rows = lambda df: sorted((r.element_id, r.object_id, r.dirty, r.deleted) for r in df.collect())
    assert rows(st.upsert(store, keys(spark, (3, 1), (4, 1)).withColumn("object_id", F.lit("n")))) == [(1, "a", False, False), (2, "b", False, False), (3, "n", False, False), (4, "n", False, False)]
    assert rows(st.touch(store, keys(spark, (1, 1), (9, 1), (9, 1)))) == [(1, "a", True, False), (2, "b", False, False), (3, "c", True, False), (9, None, True, False)]
    deps = spark.createDataFrame([("i", 1, 50), ("j", 2, 50), ("j", 3, 51)], "index string, element_id bigint, dep_element_id bigint")
    changed = keys(spark, (50, 1))
    assert sorted(r.element_id for r in st.dependents(deps, changed).collect()) == [1, 2]
    assert sorted(r[0] for r in st.affected_indexes(deps, changed).collect()) == ["i", "j"]
    assert rows(st.mark_dirty(store, st.dependents(deps, changed)))[:2] == [(1, "a", True, False), (2, "b", True, False)]
    gone = st.mark_deleted(store, keys(spark, (3, 1)))
    assert rows(gone)[2] == (3, "c", False, True) and rows(st.purged(gone)) == rows(store)[:2]
    assert [tuple(r) for r in st.counts(gone).collect()] == [(2, 0, 1)] and st.stream(gone).count() == 2
    assert sorted(map(tuple, st.missing(store, keys(spark, (1, 1))).collect())) == [(2, 1), (3, 1)]
    assert [r.dirty for r in st.mark_all_dirty(store).collect()] == [True] * 3
    assert sorted(map(tuple, st.internal_ids(store).collect())) == [("a", 0), ("b", 1), ("c", 2)]


def test_relations(spark):
    elements, related = keys(spark, (1, 1), (2, 1)), spark.createDataFrame([(7, "x"), (8, "y")], "element_id bigint, title string")
    links = spark.createDataFrame([(1, 8, 0), (1, 7, 1), (1, 99, 2), (3, 7, 0)], "element_id bigint, related_id bigint, sort_order int")
    out = with_related(elements, links, related, "rel", ["title"])
    assert [[x.title for x in r.rel] for r in out.orderBy("element_id").collect()] == [["y", "x"], []]
    assert [[x.title for x in r.rel] for r in with_related(elements, links, related, "rel", ["title"], 1).orderBy("element_id").collect()] == [["y"], []]
    assert dependencies(links, 2).count() == 3


def test_build_publish_and_query(world, spark):
    _, engine = world
    with pytest.raises(NotPublished):
        engine.search("news")
    assert engine.search("news", strict=False).nb_hits == 0
    first = engine.rebuild("news", full=True)
    assert (first.version, first.status, first.records) == (1, "live", 3) and titles(engine) == ["Blue saw", "Red saw", "Scie bleue"]
    assert engine.publish("news").version == 1, "the same content is no new version"
    assert engine.publish("news", force=True).version == 2
    assert engine.search_url("news", "/x?q=saw&price=..15").nb_hits == 1
    assert json.loads(engine.search_json("news", '{"query": "saw"}'))["nbHits"] == 2
    shown = engine.preview("news", "2-1")
    assert shown["tokens"] == {"blue": 1.0, "saw": 1.0} and shown["dependencies"] == [70]
    assert engine.count("news") == 3 and engine.prune("news") == []
    assert engine.verify("news").count() == 0 and engine.status("news")["records"] == 3
    assert differences(keys(spark, (1, 1), (1, 1)), keys(spark, (1, 1))).count() == 1


def test_incremental_update(world, spark):
    state, engine = world
    engine.rebuild("news", full=True)
    state["rows"] = [r for r in state["rows"] if r[0] != 1] + [(1, 1, "news", "post", True, None, "Green saw", 11.0), (6, 1, "news", "post", True, None, "Nail", 2.0)]
    engine.changed("news", keys(spark, (6, 1)))
    assert engine.status("news")["dirty"] == 1
    assert engine.rebuild("news").records == 4 and titles(engine) == ["Blue saw", "Nail", "Red saw", "Scie bleue"], "only dirty rows are taken up"
    engine.changed("news", keys(spark, (70, 1)))
    engine.rebuild("news")
    assert titles(engine) == ["Blue saw", "Green saw", "Nail", "Scie bleue"], "rows built from a changed element follow"
    state["rows"] = [r if r[0] != 6 else (*r[:4], False, *r[5:]) for r in state["rows"]]
    engine.changed("news", keys(spark, (6, 1)), keys(spark, (2, 2)))
    engine.rebuild("news")
    assert titles(engine) == ["Blue saw", "Green saw"] and engine.status("news")["deleted"] == 0


def test_versions_are_pruned_and_failures_recorded(world):
    state, engine = world
    engine.rebuild("news", full=True)
    for n in range(4):
        state["rows"].append((10 + n, 1, "news", "post", True, None, f"New {n}", 1.0))
        engine.rebuild("news", full=True)
    ledger = engine.publisher.versions("news")
    assert [(v.version, v.status) for v in ledger] == [(3, "superseded"), (4, "superseded"), (5, "live")]
    assert len([n for n in engine.publisher.folder.names("news") if n.startswith("manifest-")]) == 3
    write = engine.publisher._stage
    engine.publisher._stage = lambda *a: 1 / 0
    state["rows"].append((50, 1, "news", "post", True, None, "Never", 1.0))
    with pytest.raises(ZeroDivisionError):
        engine.rebuild("news", full=True)
    engine.publisher._stage = write
    assert engine.publisher.versions("news")[-1].status == "failed" and "Never" not in titles(engine)
    assert engine.rebuild("news", full=True).version == 7 and "Never" in titles(engine)


def test_definitions(world):
    _, engine = world
    engine.rebuild("news", full=True)
    with pytest.raises(SpecError):
        engine.create(SPEC)
    engine.save(SPEC.edited({"hits_per_page": 2}))
    assert engine.status("news")["dirty"] == 3 and engine.rebuild("news").status == "live" and engine.search("news").nb_pages == 2
    engine.save(SPEC.edited({"transport": "client"}))
    engine.rebuild("news")
    with pytest.raises(PermissionError):
        engine.search_json("news", {})
    engine.publisher.folder.write("stray/x.json", "{}")
    assert engine.collect_garbage() == ["stray"]
    engine.delete("news")
    with pytest.raises(KeyError):
        engine.spec("news")


EVENTS = "element_id bigint, site_id int, op string, ts timestamp, draft_id int"


def events(spark, *rows):
    return spark.createDataFrame([(e, s, op, None, d) for e, s, op, d in rows], EVENTS).withColumn("ts", F.timestamp_seconds(F.monotonically_increasing_id()))


def test_events_become_one_update(world, spark):
    state, engine = world
    engine.rebuild("news", full=True)
    state["rows"].append((6, 1, "news", "post", True, None, "Nail", 2.0))
    batch = events(spark, (6, 1, "save", None), (6, 1, "move", None), (1, 1, "save", None), (1, 1, "delete", None), (2, 1, "delete", 4), (3, 1, "odd", None))
    assert sorted(r.element_id for r in relevant(batch).collect()) == [1, 1, 6, 6]
    assert {r.element_id: r.op for r in latest(relevant(batch)).collect()} == {1: "delete", 6: "move"}
    apply_changes(engine, ["news"], batch)
    assert titles(engine) == ["Blue saw", "Nail", "Scie bleue"] and engine.publisher.pointer("news")["version"] == 2
    apply_changes(engine, ["news"], batch)
    assert engine.publisher.pointer("news")["version"] == 2, "an update run again changes nothing"


def test_streaming_updater(world, spark, tmp_path):
    state, engine = world
    engine.rebuild("news", full=True)
    state["rows"].append((6, 1, "news", "post", True, None, "Nail", 2.0))
    events(spark, (6, 1, "save", None)).write.parquet(f"{tmp_path}/ev")
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/ev").schema).parquet(f"{tmp_path}/ev")
    query = keep_updated(engine, stream, ["news"], f"{tmp_path}/cp", once=True)
    query.awaitTermination(120)
    assert query.exception() is None and "Nail" in titles(engine)
    events(spark, (1, 1, "delete", None)).write.mode("append").parquet(f"{tmp_path}/ev")
    keep_updated(engine, stream, ["news"], f"{tmp_path}/cp", once=True).awaitTermination(120)
    assert "Red saw" not in titles(engine) and engine.publisher.pointer("news")["version"] == 3


def test_bursts(spark):
    ev = spark.createDataFrame([(1, 0), (1, 29), (1, 30), (2, 5), (2, 5)], "element_id bigint, t int").withColumn("ts", F.timestamp_seconds("t"))
    assert sorted((r.element_id, r.events) for r in debounced(ev).collect()) == [(1, 1), (1, 2), (2, 2)]
    assert deduplicated(ev, ["element_id", "t"]).count() == 4


def plain_bursts(times, delay):
    out = []
    for t in sorted(times):
        if not out or t >= out[-1][0] + delay:
            out.append([t, 0, t])
        out[-1][1:] = [out[-1][1] + 1, t]
    return [tuple(b) for b in out]


def test_bursts_of_a_table(spark):
    draw = random.Random(5)
    rows = [(draw.choice([None, 1, 2, 2, 2, 2]), draw.randrange(400)) for _ in range(500)] + [(2, None), (7, 29), (7, 31)]
    ev = spark.createDataFrame(rows, "k bigint, t int").withColumn("ts", F.timestamp_seconds("t"))
    expected = sorted((str(k), *b) for k in {r[0] for r in rows} for b in plain_bursts([t for key, t in rows if key == k and t is not None], 30))
    arrow = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(arrow)
    for size in ("7", before):  # bursts go on across batches
        spark.conf.set(arrow, size)
        found = bursts(ev, "k", "ts", 30).selectExpr("string(k)", "unix_seconds(start)", "events", "unix_seconds(last)").collect()
        assert sorted((str(r[0]), *r[1:]) for r in found) == expected
    assert ("7", 29, 2, 31) in expected, "an edge of the clock cuts no burst"
    assert bursts(ev.limit(0), "k", "ts", 30).count() == 0


def _changes(spark, folder, *rows):
    spark.createDataFrame(list(rows), "element_id bigint, site_id int, op string, ts timestamp").coalesce(1).write.mode("append").parquet(folder)


def _until(what, seconds=60):
    end = time.time() + seconds
    while not what() and time.time() < end:
        time.sleep(0.3)
    assert what()


def test_a_timer_from_the_first_event(spark, tmp_path):
    at, folder = datetime(2024, 1, 1), f"{tmp_path}/ev"
    _changes(spark, folder, (1, 1, "save", at), (1, 1, "delete", at), (1, 1, "save", at), (2, None, "save", None))
    stream = spark.readStream.schema(spark.read.parquet(folder).schema).parquet(folder)

    def start(name):
        spark.conf.set(*STATE_STORE)
        try:
            writer = due(stream, 20).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp")
            return writer.trigger(processingTime="1 second").start()
        finally:
            spark.conf.unset(STATE_STORE[0])

    def rows():
        try:
            return sorted((r.element_id, r.site_id, r.op, r.events) for r in spark.read.parquet(f"{tmp_path}/out").collect())
        except AnalysisException:
            return []

    query = start("first")
    _until(lambda: any(p["numInputRows"] for p in query.recentProgress))
    _changes(spark, folder, (1, 1, "move", datetime(2023, 1, 1)))
    query.stop()  # open bursts and timers outlive the query
    query = start("again")
    _until(lambda: len(rows()) == 2)
    assert rows() == [(1, 1, "delete", 4), (2, 1, "save", 1)], "one row a burst, its last event by time, deletions last"
    _changes(spark, folder, (1, 1, "save", at))
    _until(lambda: len(rows()) == 3)
    query.stop()
    assert rows()[1:2] == [(1, 1, "save", 1)], "what comes after is the next burst"


def test_updater_waits_from_the_first_event(world, spark, tmp_path):
    state, engine = world
    engine.rebuild("news", full=True)
    state["rows"].append((6, 1, "news", "post", True, None, "Nail", 2.0))
    _changes(spark, f"{tmp_path}/ev", *[(6, 1, "save", datetime(2024, 1, 1, 0, 0, s)) for s in range(20, 50, 5)])
    stream = spark.readStream.schema(spark.read.parquet(f"{tmp_path}/ev").schema).parquet(f"{tmp_path}/ev")
    query = keep_updated(engine, stream, ["news"], f"{tmp_path}/cp", debounce=2)
    _until(lambda: engine.publisher.pointer("news")["version"] == 2 or query.exception() is not None, 90)
    query.stop()
    assert query.exception() is None and "Nail" in titles(engine) and engine.publisher.pointer("news")["version"] == 2


def test_two_writers_and_a_reader(spark, tmp_path):
    """Versions and pointer of one index written from two threads; a reader always finds a whole version."""
    import threading

    from lodestone.operators.compile import build_index
    from lodestone.operators.publish import Busy, Publisher
    from lodestone.spec import Attribute, IndexSpec

    spec = IndexSpec("i", attributes=(Attribute("a", roles=("facet",)),))
    build = lambda n: build_index(spark.range(n).selectExpr("cast(id as string) as object_id", "'x' as a"), spec)
    path = f"file://{tmp_path}/pub"
    Publisher(spark, path, keep=9).publish(build(1))
    faults, seen, done = [], [], threading.Event()

    def write(first):
        try:
            for n in range(first, first + 4, 2):
                Publisher(spark, path, keep=9).publish(build(n))
        except Exception as problem:
            faults.append(problem)

    def read():
        reader = Publisher(spark, path)
        while not done.is_set():
            pointer, found = reader.pointer("i"), reader.published("i")
            seen.append(pointer is not None and found is not None and found.records.count() > 0)

    threads = [threading.Thread(target=write, args=(n,)) for n in (2, 3)]
    watch = threading.Thread(target=read)
    for t in (*threads, watch):
        t.start()
    for t in threads:
        t.join()
    done.set()
    watch.join()
    publisher = Publisher(spark, path, patience=0.3)
    ledger = publisher.versions("i")
    assert not faults and seen and all(seen)
    assert [v.version for v in ledger] == [1, 2, 3, 4, 5] and [v.status for v in ledger].count("live") == 1
    assert ledger[-1].status == "live" and publisher.pointer("i")["version"] == 5
    with Publisher(spark, path).folder.lock("lock.i"):
        with pytest.raises(Busy):
            publisher.publish(build(9))
    publisher.publish(build(9))
    assert publisher.published("i").records.count() == 9


def test_internal_ids_agree_whatever_the_partitions(spark):
    from lodestone.operators.store import internal_ids

    rows = spark.range(500).selectExpr("concat(id, '') as object_id", "cast(id * 7 % 500 as bigint) as element_id", "cast(id % 2 as int) as site_id")
    for n in (1, 3, 11):
        got = {r.object_id: r.id for r in internal_ids(rows.repartition(n)).collect()}
        assert got == {str(i): i * 7 % 500 for i in range(500)}
    assert internal_ids(rows.limit(0)).count() == 0


def test_truncation_is_a_group_limit_and_text_joins_keep_records_in_place(spark):
    from lodestone.operators.compile import build_index
    from lodestone.operators.search import search
    from lodestone.spec import Attribute, IndexSpec

    spec = IndexSpec("i", attributes=(Attribute("n", roles=("facet",), facet_type="numeric", max_values=3), Attribute("a", roles=("facet",)), Attribute("t", roles=("searchable",))))
    index = build_index(spark.range(50).selectExpr("cast(id as string) as object_id", "id as n", "concat('v', id % 5) as a", "concat('word w', id) as t"), spec)
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    result = search(index, {"query": "w1", "refinements": {"a": ["v1", "v4", "gone"]}})
    assert "WindowGroupLimit" in plan(result.facets) and "BroadcastHashJoin" in plan(result.matches)
    assert sorted((r.value, r["count"]) for r in result.facets.where("facet = 'a'").collect()) == [("v0", 2), ("v1", 3), ("v2", 2), ("v3", 2), ("v4", 2)]
    none = search(index, {"query": "w3", "refinements": {"a": ["v4"], "n": [49]}})
    assert ("49", 0) in [(r.value, r["count"]) for r in none.facets.collect()]


def test_failing_elements_are_left_out(spark, world):
    state, engine = world
    engine.rebuild("news")
    whole, bad = engine.tables, ["2-1", "2-2"]

    def damaged():
        failing = F.concat_ws("-", "element_id", "site_id").isin(bad)
        return {"entry": whole()["entry"].withColumn("title", F.when(failing, F.raise_error(F.lit("no title"))).otherwise(F.concat("title", F.lit("!"))))}

    engine.tables = damaged
    engine.build("news", full=True)
    assert sorted(engine.errors["news"]) == bad and all("no title" in e for e in engine.status("news")["errors"].values())
    rows = {r.object_id: (r.x_title, r.dirty) for r in engine._store("news").collect()}
    assert rows["1-1"] == ("Red saw!", False) and rows["2-1"] == ("Blue saw", True) and rows["2-2"] == ("Scie bleue", True)
    bad.remove("2-2")
    engine.build("news")
    rows = {r.object_id: (r.x_title, r.dirty, r.deleted) for r in engine._store("news").collect()}
    assert list(engine.errors["news"]) == ["2-1"] and rows["2-1"] == ("Blue saw", True, False) and rows["2-2"] == ("Scie bleue!", False, False)
    bad.clear()
    engine.rebuild("news")
    assert engine.errors["news"] == {} and titles(engine) == ["Blue saw!", "Red saw!", "Scie bleue!"]


def test_a_build_that_fails_as_a_whole_fails(spark, world):
    state, engine = world
    whole = engine.tables
    engine.tables = lambda: {"entry": whole()["entry"].withColumn("site_id", F.raise_error(F.lit("broken")).cast("int"))}
    with pytest.raises(Exception, match="broken"):
        engine.build("news", full=True)


def test_events_do_nothing_while_updates_are_off(spark, world):
    state, engine = world
    engine.rebuild("news")
    state["rows"][0] = (1, 1, "news", "post", True, None, "New saw", 10.0)
    events = spark.createDataFrame([(1, 1, "save", 1)], "element_id bigint, site_id int, op string, ts bigint")
    engine.config.auto_update = False
    apply_changes(engine, ["news"], events)
    assert titles(engine) == ["Blue saw", "Red saw", "Scie bleue"]
    engine.config.auto_update = True
    apply_changes(engine, ["news"], events)
    assert titles(engine) == ["Blue saw", "New saw", "Scie bleue"]


def test_published_to_another_store(spark, world, tmp_path):
    state, engine = world

    class Counted(Folder):
        written = 0

        def write(self, name, text):
            Counted.written += 1
            super().write(name, text)

    other = Engine(spark, engine.tables, engine.config, folder=Counted(spark, f"file://{tmp_path}/other"))
    other.save(SPEC)
    other.rebuild("news")
    assert Counted.written > 0 and titles(other) == ["Blue saw", "Red saw", "Scie bleue"] and engine.publisher.pointer("news") is None
