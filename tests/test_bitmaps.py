"""Facet bitmaps against counts over records."""

import random

import pytest
from pyspark.sql import functions as F

from lodestone.operators import bitmaps
from lodestone.operators.bitmaps import bitmap_counts, bitmap_hits, bitmap_stats, facet_bitmaps
from lodestone.operators.compile import build_index
from lodestone.operators.facets import buckets
from lodestone.operators.search import search
from lodestone.spec import Attribute, IndexSpec
from lodestone.state import QueryState

SPEC = IndexSpec(
    "things",
    attributes=(
        Attribute("color", roles=("facet",)),
        Attribute("tags", roles=("facet",), facet_operator="and"),
        Attribute("size", roles=("facet",), facet_type="numeric"),
        Attribute("new", roles=("facet",), facet_type="boolean"),
        Attribute("path", roles=("facet",), facet_type="hierarchical", facet_operator="and"),
        Attribute("title", roles=("searchable",)),
    ),
)
STATES = [
    {},
    {"facets": []},
    {"facets": ["size"], "refinements": {"color": ["red"]}},
    {"refinements": {"color": ["red"]}},
    {"refinements": {"color": ["red", "blue", "never"]}},
    {"refinements": {"color": ["never"]}},
    {"refinements": {"color": [3]}},
    {"refinements": {"tags": ["a"]}},
    {"refinements": {"tags": ["a", "b", "a"], "color": ["red"]}},
    {"refinements": {"tags": ["a", 5]}},
    {"refinements": {"new": [True], "path": ["x", "x > 1"]}},
    {"refinements": {"color": ["blue"], "new": [False], "size": [3, 4]}, "ranges": {"size": {"min": 2}}},
    {"ranges": {"size": {"min": 3, "max": 7}, "color": {"min": 1}}},
    {"ranges": {"size": {"max": 1}}, "refinements": {"unknown": ["x"], "color": ["red"]}},
]


@pytest.fixture(scope="module")
def world(spark):
    draw = random.Random(11)
    rows = [
        (
            n,
            draw.choice([None, "red", "red", "blue", "rare" if n % 97 == 0 else "green"]),
            draw.choice([None, [], *([[*draw.sample("abcd", k)] for k in (1, 2, 3)])]),
            draw.choice([None, *map(float, range(9)), 0.5 + n]),
            draw.choice([True, False, None]),
            draw.choice([None, "x", "x > 1", "x > 1 > a", "y"]),
            draw.choice(["alpha", "beta", "alpha beta"]),
        )
        for n in range(3000)
    ]
    # Ids of three buckets, of which the middle one has few records.
    table = spark.createDataFrame(rows, "n int, color string, tags array<string>, size double, new boolean, path string, title string")
    table = table.withColumn("id", F.when(F.col("n") < 1500, F.col("n")).when(F.col("n") < 1510, 64_035 + F.col("n")).otherwise(100_000 + 7 * F.col("n")).cast("long"))
    index = build_index(table.withColumn("object_id", F.col("id").cast("string")), SPEC)
    records = index.records.withColumn("id", F.col("object_id").cast("long")).persist()
    return index, records


def shown(df):
    return sorted(repr((r.facet, r.position, r.value, r["count"], r.is_refined)) for r in df.collect())


@pytest.mark.parametrize(("dense", "states"), [(300, STATES), (2, STATES[8:11:2]), (100_000, STATES[8:11:2])])
def test_counts_equal_those_over_records(world, monkeypatch, tmp_path, dense, states):
    index, records = world
    monkeypatch.setattr(bitmaps, "DENSE", dense)
    maps = facet_bitmaps(records, SPEC).save(f"file://{tmp_path}/maps")
    for given in states:
        state, result = QueryState.from_dict(given), search(index, given)
        counts = bitmap_counts(maps, state)
        assert shown(buckets(counts, SPEC, state)) == shown(result.facets), given
        assert bitmap_hits(maps, state).first()["hits"] == result.nb_hits, given
        stats = {r.facet: tuple(round(x, 6) for x in r[1:]) for r in bitmap_stats(counts, SPEC, state).collect()}
        assert stats == {r.facet: tuple(round(r[n], 6) for n in ("min", "max", "avg", "sum")) for r in result.stats.collect()}, given


def test_records_that_match_a_text_are_given(world):
    index, records = world
    maps = facet_bitmaps(records, SPEC)
    given = {"query": "alpha", "refinements": {"color": ["red"], "tags": ["a"]}}
    state, result = QueryState.from_dict(given), search(index, given)
    with pytest.raises(ValueError, match="have to be given"):
        bitmap_counts(maps, state)
    ids = index.postings.where("token = 'alpha'").select(F.col("object_id").cast("long").alias("id"))
    assert shown(buckets(bitmap_counts(maps, state, ids), SPEC, state)) == shown(result.facets)
    assert bitmap_hits(maps, state, ids).first()["hits"] == result.nb_hits
    assert bitmap_hits(maps, state, ids.limit(0)).first()["hits"] == 0


def test_no_records(spark, world):
    maps = facet_bitmaps(world[1].limit(0), SPEC)
    state = QueryState.from_dict({"refinements": {"color": ["red"]}})
    assert bitmap_counts(maps, state).collect() == [] and bitmap_hits(maps, state).first()["hits"] == 0


def test_repeated_rows_count_once(world):
    """An id is one record, however often its row comes."""
    index, records = world
    once, twice = (facet_bitmaps(r, SPEC) for r in (records, records.union(records)))
    state = QueryState.from_dict({"refinements": {"tags": ["b"]}})
    assert shown(buckets(bitmap_counts(once, state), SPEC, state)) == shown(buckets(bitmap_counts(twice, state), SPEC, state))


def test_counts_read_no_records_and_stay_in_the_jvm(world, tmp_path):
    maps = facet_bitmaps(world[1], SPEC).save(f"file://{tmp_path}/maps")
    plan = bitmap_counts(maps, QueryState.from_dict(STATES[8]))._jdf.queryExecution().toString()
    assert "f_color" not in plan and "Python" not in plan and "Cartesian" not in plan and "NestedLoop" not in plan
