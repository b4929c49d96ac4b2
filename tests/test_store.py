"""The bucketed store, ranges that versions share, locks, conditions of kinds, and relations that the engine follows."""

import os
import time

import pytest
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.operators.buckets import RecordStore
from lodestone.operators.compile import build_index
from lodestone.operators.publish import Busy, Folder, Publisher
from lodestone.operators.relations import related
from lodestone.operators.search import search
from lodestone.plans.engine import Engine
from lodestone.sources.registry import Condition, Kind, covers, register_kind
from lodestone.spec import Attribute, EngineConfig, IndexSpec, Relation, Source, SpecError
from lodestone.streaming.updates import apply_changes


def files(root):
    return {os.path.relpath(os.path.join(d, f), root): os.path.getmtime(os.path.join(d, f)) for d, _, names in os.walk(root) for f in names if f.endswith(".parquet")}


def keys(spark, *ids):
    return spark.createDataFrame([(i, 1) for i in ids], "element_id bigint, site_id int")


def rows(df):
    return sorted((r.element_id, r.object_id, r.dirty, r.deleted) for r in df.collect())


@pytest.fixture
def store(spark, tmp_path):
    made = RecordStore(spark, Folder(spark, f"file://{tmp_path}"), "s", buckets=8)
    made.replace(spark.range(40).selectExpr("id as element_id", "1 as site_id", "concat(id, '-1') as object_id", "false as dirty", "false as deleted"))
    return made


def test_a_change_writes_the_buckets_of_its_rows(store, spark, tmp_path):
    before = files(tmp_path)
    assert store.change(saved=keys(spark, 5)) and store.current().count() == 40
    new = files(tmp_path).keys() - before.keys()
    assert len({os.path.basename(os.path.dirname(f)) for f in new}) == len(new) == 1 and {f: t for f, t in files(tmp_path).items() if f in before} == before
    assert [r.element_id for r in store.dirty_keys().collect()] == [5]
    seq = store.manifest()["seq"]
    assert store.change(saved=keys(spark, 5)) == [] and store.manifest()["seq"] == seq, "marked again is no change"


def test_store_against_plain_rows(store, spark):
    want = {i: (i, f"{i}-1", False, False) for i in range(40)}
    for n in range(8):  # over several compactions
        touched, gone, new = 3 * n % 40, (7 * n + 1) % 40, 100 + n
        store.change(saved=keys(spark, touched, new), deleted=keys(spark, gone, 999))
        want[touched] = (touched, want[touched][1] if touched in want else None, True, False)
        want.setdefault(new, (new, None, True, False))
        if gone in want:
            want[gone] = (gone, want[gone][1], False, True)
        if n % 4 == 3:
            images = store.dirty_rows().withColumn("object_id", F.concat("element_id", F.lit("-1"))).withColumn("dirty", F.lit(False))
            store.append(images, built=True)
            want = {i: (i, f"{i}-1" if d else o, False, g) for i, o, d, g in want.values()}
        if n % 6 == 5:
            store.purge()
            want = {i: r for i, r in want.items() if not r[3]}
        assert rows(store.current()) == sorted(want.values(), key=lambda r: r[0])
    assert all(len(log) <= 9 for log in store.manifest()["log"].values())
    store.mark_all_dirty()
    assert {r.element_id for r in store.dirty_keys().collect()} == {i for i, r in want.items() if not r[3]}


def test_columns_come_and_change_their_type(store, spark):
    one = store.current().where("element_id = 3").withColumn("f_a", F.array(F.lit("x")))
    store.append(one)
    assert {r.element_id: r.f_a for r in store.current().collect() if r.f_a} == {3: ["x"]}
    store.append(one.withColumn("f_a", F.array(F.lit(1.5))).withColumn("element_id", F.lit(4).cast("bigint")))
    assert {r.element_id: r.f_a for r in store.current().collect() if r.f_a} == {4: [1.5]} and store.current().count() == 40


def test_readers_of_the_state_before_still_read(store, spark):
    held = store.current()
    store.change(deleted=keys(spark, 1))
    assert held.count() == 40 and not held.where("deleted").collect()


SPEC = IndexSpec("n", sources=(Source("entry"),), attributes=(Attribute("title", roles=("searchable", "payload")), Attribute("kind", roles=("facet",))))


def engine_over(spark, tmp_path, state, **settings):
    table = lambda: spark.createDataFrame(state, "element_id bigint, site_id int, title string, kind string")
    made = Engine(spark, lambda: {"entry": table()}, EngineConfig(f"file://{tmp_path}/pub", **settings))
    made.save(SPEC)
    return made


def test_an_update_costs_its_own_size(spark, tmp_path):
    state = [(i, 1, f"word{i} same", "ab"[i % 2]) for i in range(300)]
    engine = engine_over(spark, tmp_path, state, buckets=8, ranges=32)
    engine.rebuild("n")
    before = files(tmp_path)
    state[17] = (17, 1, "other title", "b")
    events = spark.createDataFrame([(17, 1, "save", 1), (9999, 1, "save", 1)], "element_id bigint, site_id int, op string, ts bigint")
    apply_changes(engine, ["n"], events)
    written = engine.publisher.last["n"]["written"]
    assert sorted(n.split("-")[0] for n in written) == ["postings", "records"] and len(engine.publisher.last["n"]["shared"]) >= 50
    new = {os.path.dirname(f) for f in files(tmp_path).keys() - before.keys()}
    assert len({d for d in new if "/parts/" in d}) == 2 and len({d.split("=")[1] for d in new if "store.n" in d}) == 1 and not any("_range" in d for d in new)
    assert engine.search("n", {"query": "other"}).nb_hits == 1 and engine.search("n", {"query": "word17 same"}).nb_hits == 0 and engine.search("n").nb_hits == 300
    again = files(tmp_path)
    apply_changes(engine, ["n"], events.where("element_id = 9999"))
    assert files(tmp_path) == again and not engine.pending("n"), "what is no matter of an index changes nothing"
    pointer = engine.publisher.pointer("n")
    apply_changes(engine, ["n"], events)
    assert engine.publisher.pointer("n") == pointer and engine.verify("n").isEmpty()


def test_ranges_are_shared_and_old_versions_still_read(spark, tmp_path):
    publisher = Publisher(spark, f"file://{tmp_path}", keep=2, ranges=8)
    made = lambda n: build_index(spark.range(200).selectExpr("cast(id as string) as object_id", f"if(id = {n}, 'new', 'old') as kind", "concat('t', id) as title"), SPEC)
    first = publisher.publish(made(-1))
    held, old = publisher.published("n"), files(tmp_path)
    second = publisher.publish(made(7))
    assert len(publisher.last["n"]["written"]) == 1 and set(old) < set(files(tmp_path)) and (first.records, second.records) == (200, 200)
    assert held.records.where("array_contains(f_kind, 'new')").isEmpty() and publisher.published("n", first.checksum).records.count() == 200
    third = publisher.publish(made(8))
    assert first.files != third.files and publisher.manifest("n", first.checksum) is None and not [n for n in publisher.last["n"]["deleted"] if n.startswith("parts/")]
    assert publisher.published("n").records.where("array_contains(f_kind, 'new')").first().object_id == "8"
    assert publisher.publish(made(7)).checksum == second.checksum, "the same content has the same name"
    publisher.publish(made(9))
    assert len([n for n in publisher.last["n"]["deleted"] if n.startswith("parts/")]) == 1, "the range of 8, which only the third version had"


def test_empty_index(spark, tmp_path):
    publisher = Publisher(spark, f"file://{tmp_path}")
    none = build_index(spark.range(0).selectExpr("cast(id as string) as object_id", "'x' as kind", "'t' as title"), SPEC)
    assert publisher.publish(none).records == 0 and publisher.published("n").records.count() == 0 and publisher.published("n").postings.count() == 0


def test_a_holder_who_comes_back_finds_the_lock_lost(spark, tmp_path):
    one, two = (Folder(spark, f"file://{tmp_path}") for _ in range(2))
    entered = one.lock("l", wait=1, stale=0.5)
    one._renew = lambda *a: None  # this holder hangs
    entered.__enter__()
    with pytest.raises(Busy):
        with two.lock("l", wait=0.3, stale=60):
            pass
    time.sleep(0.7)
    with two.lock("l", wait=5, stale=0.5):
        with pytest.raises(Busy):
            one.still_held("l")
        entered.__exit__(None, None, None)
        two.still_held("l")
        with pytest.raises(Busy):
            with one.lock("l", wait=0.3, stale=60):
                pass
    with one.lock("l", wait=1):
        one.still_held("l")


def test_a_lock_is_renewed_while_it_is_held(spark, tmp_path):
    one, two = (Folder(spark, f"file://{tmp_path}") for _ in range(2))
    with one.lock("l", stale=2.0):
        time.sleep(2.6)
        with pytest.raises(Busy):
            with two.lock("l", wait=0.2, stale=2.0):
                pass
        one.still_held("l")


def test_conditions_of_kinds(spark):
    df = spark.createDataFrame([(1, "LIVE", 3), (2, "off", 3), (3, "live", 9), (4, None, 1)], "element_id bigint, status string, n int")
    pick = lambda **c: [r[0] for r in df.where(covers(df, Source(register_kind(Kind("odd", "n", **c)).name))).orderBy("element_id").collect()]
    assert pick(live="lower(status) = 'live'") == [1, 3]
    assert pick(live="n between 1 and 5") == [1, 2, 4]
    assert pick(live=("lower(status) = 'live'", "n between 1 and 5 and status is not null", Condition("not archived", ("archived",)))) == [1]
    assert pick() == [3]
    for wrong in ("lower(statuss) = 'live'", "n + 1", "no_such_function(n)"):
        with pytest.raises(SpecError):
            pick(live=wrong)


WAYS = (Relation("makers", to="maker", links="made_by", most=2), Relation("land", on="maker", to="land", key="land_id"), Relation("tags", to="tag", key="tag_ids"))


def world(spark):
    return {
        "entry": spark.createDataFrame([(1, 1, [50, 51]), (2, 1, None), (3, 1, [51, 99])], "element_id bigint, site_id int, tag_ids array<bigint>"),
        "made_by": spark.createDataFrame([(1, 10, 2), (1, 11, 1), (1, 12, 3), (2, 12, 1), (3, 77, 1)], "element_id bigint, related_id bigint, sort_order int"),
        "maker": spark.createDataFrame([(10, "Ten", 100), (11, "Eleven", 101), (12, "Twelve", None)], "element_id bigint, name string, land_id bigint"),
        "land": spark.createDataFrame([(100, 100, "A"), (101, 101, "B")], "element_id bigint, id bigint, title string"),
        "tag": spark.createDataFrame([(50, 50, "x"), (51, 51, "y")], "element_id bigint, id bigint, title string"),
    }


PATHS = IndexSpec("r", relations=WAYS, attributes=(Attribute("maker", "makers.name", roles=("facet", "payload")), Attribute("land", "makers.land", roles=("facet",)), Attribute("code", "makers.land.id", roles=("payload",)), Attribute("tag", "tags.title", roles=("facet", "searchable"))))


def test_paths_become_joins(spark):
    tables = world(spark)
    found = {r.element_id: r for r in related(tables["entry"], PATHS, tables).collect()}
    assert [[m.name, [x.title for x in m.land]] for m in found[1].makers] == [["Eleven", ["B"]], ["Ten", ["A"]]] and [t.title for t in found[1].tags] == ["x", "y"]
    assert [m.name for m in found[2].makers] == ["Twelve"] and found[2].tags == [] and found[3].makers == []
    assert {i: r._deps for i, r in found.items()} == {1: [10, 11, 50, 51, 100, 101], 2: [12], 3: [51, 77, 99]}
    assert related(tables["entry"], SPEC, tables) is tables["entry"]


def test_engine_follows_relations(spark, tmp_path):
    tables = world(spark)
    engine = Engine(spark, lambda: tables, EngineConfig(f"file://{tmp_path}/pub"))
    engine.save(PATHS)
    engine.rebuild("r")
    counts = lambda: {(r.facet, r.value): r["count"] for r in engine.search("r").facets.collect()}
    assert counts() == {("maker", "Ten"): 1, ("maker", "Eleven"): 1, ("maker", "Twelve"): 1, ("land", "A"): 1, ("land", "B"): 1, ("tag", "x"): 1, ("tag", "y"): 2}
    assert engine.preview("r", "1-1")["dependencies"] == [10, 11, 50, 51, 100, 101] and engine.verify("r").isEmpty()
    tables["land"] = spark.createDataFrame([(100, 100, "A"), (101, 101, "New")], "element_id bigint, id bigint, title string")
    engine.changed("r", keys(spark, 101))
    assert [r.element_id for r in engine.store("r").dirty_keys().collect()] == [1]
    engine.rebuild("r")
    assert ("land", "New") in counts() and ("land", "B") not in counts()
    tables["made_by"] = tables["made_by"].where("related_id <> 11")
    engine.changed("r", keys(spark, 1))
    engine.rebuild("r")
    assert engine.changed("r", keys(spark, 101)) == [], "an edge that is gone marks nothing"
    assert engine.changed("r", keys(spark, 12))


@pytest.mark.parametrize("wrong", [Relation("x", to="a"), Relation("x", to="a", links="l", key="k"), Relation("x", to="a", key="k", most=0), Relation("x", on="no", to="a", key="k"), Relation("1x", to="a", key="k")])
def test_relations_are_checked(wrong):
    assert IndexSpec("r", relations=(wrong,)).problems()
    assert IndexSpec.from_dict(PATHS.to_dict()) == PATHS


def test_errors_are_set_aside_in_one_scan(spark, tmp_path):
    """A fiftieth of the lines of text files can't be read: their records stay, all others are built, and the source is read once."""
    from pyspark.sql import types as T

    line = lambda i, title: f'{{"element_id": {i}, "site_id": 1, "title": "{title}", "kind": "a"}}'
    spark.createDataFrame([(line(i, f"first {i}"),) for i in range(2000)], "value string").write.text(f"{tmp_path}/one")
    torn = lambda i: line(i, f"second {i}")[:-2] if i % 50 == 7 else line(i, f"second {i}")
    spark.createDataFrame([(torn(i),) for i in range(2000)], "value string").repartition(4).write.text(f"{tmp_path}/two")
    shape = T.StructType.fromDDL("element_id bigint, site_id int, title string, kind string, _corrupt_record string")
    now = {"path": f"{tmp_path}/one"}
    read = lambda: spark.read.schema(shape).option("columnNameOfCorruptRecord", "_corrupt_record").json(now["path"])
    known = lambda df: df.withColumn("element_id", F.coalesce("element_id", F.regexp_extract("_corrupt_record", r'"element_id": (\d+)', 1).cast("bigint"))).withColumn("site_id", F.lit(1))
    engine = Engine(spark, lambda: {"entry": known(read())}, EngineConfig(f"file://{tmp_path}/pub", buckets=4, ranges=4))
    engine.save(SPEC)
    engine.rebuild("n")
    assert engine.failures("n").isEmpty() and engine.errors["n"] == {}
    now["path"] = f"{tmp_path}/two"
    engine.rebuild("n", full=True)
    rows = {r.element_id: r for r in engine.store("n").current().collect()}
    assert len(rows) == 2000 and all((r.x_title == f"first {i}" and r.dirty and "corrupt" not in r.x_title) if i % 50 == 7 else (r.x_title == f"second {i}" and not r.dirty) for i, r in rows.items())
    assert engine.failures("n").count() == 40 and len(engine.errors["n"]) == 40 and all(e.startswith("row: ") for e in engine.errors["n"].values())
    assert engine.search("n").nb_hits == 2000 and engine.search("n", {"query": "first"}).nb_hits == 40
    plan = engine._apart(engine._records(engine.tables()["entry"], SPEC), engine.store("n").current())._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan json") == 1
    spark.createDataFrame([(line(i, f"third {i}"),) for i in range(2000)], "value string").write.text(f"{tmp_path}/three")
    now["path"] = f"{tmp_path}/three"
    engine.rebuild("n")
    assert engine.failures("n").isEmpty() and engine.search("n", {"query": "third"}).nb_hits == 40, "what failed is still dirty, and is taken up again"


def test_extractors_that_fail_are_passed_over(spark):
    from lodestone.operators.compile import compile_records
    from lodestone.operators.extract import Extracted, register_extractor, unregister_extractor

    def broken(value, kind):
        raise RuntimeError("no")

    def guarded(value, kind):
        return Extracted(value["code"].try_cast("int"), {}, fails=value["code"].try_cast("int").isNull()) if kind.names == ["code"] else None

    df = spark.createDataFrame([("1", ("7",)), ("2", ("x",)), ("3", None)], "object_id string, c struct<code:string>")
    spec = IndexSpec("x", attributes=(Attribute("c", roles=("facet",)),))
    for e in (broken, guarded):
        register_extractor(e)
    try:
        with pytest.warns(UserWarning, match="broken"):
            found = {r.object_id: (r.f_c, r._errors) for r in compile_records(df, spec).collect()}
    finally:
        for e in (guarded, broken):
            unregister_extractor(e)
    assert found == {"1": (["7"], []), "2": ([], ["c: unreadable"]), "3": ([], [])}


def test_bounds_of_a_radius_reach_the_reader(spark, tmp_path):
    spec = IndexSpec("places", attributes=(Attribute("at", "at", roles=("facet",), facet_type="geo"),))
    rows = spark.range(40_000).select(F.col("id").alias("element_id"), F.concat_ws(",", (F.col("id") % 170 - 85).cast("string"), (F.col("id") % 357 - 178).cast("string")).alias("at"))
    publisher = Publisher(spark, str(tmp_path), ranges=2)
    publisher.publish(build_index(rows, spec))
    for place in ((40, 20), (40, 179.5), (89, 0)):
        found = search(publisher.published("places"), {"around": {"at": {"lat": place[0], "lng": place[1], "radius": 400_000}}}).matches
        pushed = found._jdf.queryExecution().executedPlan().toString().split("PushedFilters: [")[1]
        assert "g_at.lat" in pushed.split("ReadSchema")[0]
        assert sorted(r.object_id for r in found.collect()) == sorted(
            r.object_id for r in build_index(rows, spec).records.where(geo.distance(F.col("g_at"), *place) <= 400_000).collect()
        )
