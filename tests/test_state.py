import pytest

from lodestone.functions import varint
from lodestone.functions.facet_value import from_key, to_key
from lodestone.functions.labels import distance_label, range_label, tree, value_label
from lodestone.spec import Attribute, Features, IndexSpec, Sorting, Source, SpecError, limited
from lodestone.state import QueryState, active, encode, pager, parse, split, url

FACETS = {
    "maker": {"type": "string", "values": ["Bolt & Co", "Nut, Inc", "a\\b"]},
    "path": {"type": "hierarchical", "values": ["Top", "Top > Sub"]},
    "cost": {"type": "numeric", "values": [7.0, 12.5]},
    "new": {"type": "boolean", "values": [True, False]},
    "day": {"type": "date", "values": [1700000000.0]},
    "near": {"type": "geo"},
}


@pytest.mark.parametrize(
    "state,address",
    [
        ({}, "/x"),
        ({"query": "red saw"}, "/x?q=red%20saw"),
        ({"refinements": {"maker": ["Bolt & Co", "Nut, Inc"]}}, "/x?maker=Bolt%20%26%20Co,Nut%5C,%20Inc"),
        ({"refinements": {"maker": ["a\\b"], "path": ["Top > Sub"]}}, "/x?maker=a%5C%5Cb&path=Top%20%3E%20Sub"),
        ({"refinements": {"new": [False], "cost": [12.5]}}, "/x?new=false&cost=12.5"),
        ({"ranges": {"cost": {"min": 7}, "day": {"max": 1700000000}}}, "/x?cost=7..&day=..1700000000"),
        ({"refinements": {"cost": [7.0]}, "ranges": {"cost": {"min": 1, "max": 9.5}}}, "/x?cost=7,1..9.5"),
        ({"around": {"near": {"lat": 35.25, "lng": -80.5, "radius": 900}}}, "/x?near=35.25,-80.5,900"),
        ({"sortBy": "cheap", "page": 3, "hitsPerPage": 10}, "/x?sort=cheap&page=4&perPage=10"),
    ],
)
def test_url_round_trip(state, address):
    own = QueryState.from_dict(state)
    assert url("/x", own) == address
    assert parse(address, FACETS) == own
    assert parse(encode(own, "p_"), FACETS, "p_") == own
    assert QueryState.from_dict(own.to_dict()) == own


def test_parse_is_lenient():
    assert parse({"cost_min": "3", "cost_max": "x", "maker_min": "1", "nope": "1"}, FACETS).ranges == {"cost": {"min": 3.0}}
    assert parse({"cost": "1..2", "cost_min": "9"}, FACETS).ranges == {"cost": {"min": 1.0, "max": 2.0}}
    assert parse({"maker": "Gone"}, FACETS).refinements == {"maker": ["Gone"]}
    assert parse({"page": "-4", "perPage": "0"}, FACETS) == QueryState(hits_per_page=1)
    assert parse({"near": "1,x"}, FACETS).around == {}
    assert split("a\\,b,,c\\\\") == ["a,b", "c\\"]


@pytest.mark.parametrize("text", ["nan", "inf", "-Infinity", "1_0", "0x10", "", "٣", "1e999", "x"])
def test_only_finite_decimals_are_numbers(text):
    assert parse({"page": text, "perPage": text}, FACETS) == QueryState()
    assert parse({"near": f"{text},1", "cost_min": text, "day_max": text}, FACETS) == QueryState()
    assert parse({"near": f"1,2,{text}"}, FACETS).around == {"near": {"lat": 1, "lng": 2, "radius": 0}}
    assert QueryState.from_dict({"page": text, "hitsPerPage": text, "ranges": {"cost": {"min": text}}, "around": {"near": {"lat": text, "lng": 1}}}) == QueryState()


def test_numbers_of_any_size_stay_finite():
    assert parse({"page": "1e3", "cost": " 7. ,.5..+1e1"}, FACETS) == QueryState(page=999, refinements={"cost": [" 7. "]}, ranges={"cost": {"min": 0.5, "max": 10.0}})
    assert QueryState.from_dict({"ranges": {"a": {"min": float("inf"), "max": 10**400}}, "page": float("nan")}) == QueryState()
    assert parse({"cost": "1..2,x..3,4..,.."}, FACETS).ranges == {"cost": {"min": 4.0}}
    assert parse({"q": ["a"], "maker": 5, "sort": "x"}, FACETS) == QueryState(sort_by="x")


def test_parse_against_a_definition_types_values():
    spec = IndexSpec("i", attributes=(Attribute("cost", roles=("facet",), facet_type="numeric"), Attribute("new", roles=("facet",), facet_type="boolean"), Attribute("near", roles=("facet",), facet_type="geo")))
    state = parse({"cost": "7,abc", "new": "true", "near": "1,2,3"}, spec)
    assert state.refinements == {"cost": [7.0, "abc"], "new": [True]} and state.around["near"]["radius"] == 3


def test_from_dict_drops_what_is_empty():
    state = QueryState.from_dict({"ranges": {"a": {"min": "", "max": None}}, "around": {"g": {"lat": "x", "lng": 1}}, "refinements": {"b": []}, "page": -2})
    assert state == QueryState()
    assert QueryState.from_dict({"around": {"g": {"lat": 1, "lng": 2, "radius": -5}}}).around["g"]["radius"] == 0


def test_edits_go_to_the_first_page():
    state = QueryState(page=4)
    on = state.toggled("new", True)
    assert on.page == 0 and on.is_refined("new", True) and not on.is_refined("new", 1) and on.toggled("new", True).refinements == {}
    assert state.with_page(2).page == 2 and state.with_sort("x").page == state.with_query("y").page == 0
    full = on.with_range("cost", 1).with_place("near", 1, 2, 50)
    assert full.refined_facets == ["new", "cost", "near"] and full.cleared().has_refinements is False
    assert full.cleared("cost").refined_facets == ["new", "near"] and full.with_range("cost").ranges == {}


def test_chips_and_pager():
    spec = IndexSpec("i", attributes=(Attribute("new", roles=("facet",), facet_type="boolean"),))
    state = QueryState(refinements={"new": [True]}, ranges={"cost": {"min": 5.0}}, around={"near": {"lat": 1, "lng": 2, "radius": 1500.0}})
    assert [(c.facet, c.label) for c in active(state, spec, "/")] == [("new", "Yes"), ("cost", "5 and up"), ("near", "1.5 km")]
    assert pager(0, 0) == [0] and pager(0, 9) == [0, 1, 2, 3, 4] and pager(8, 9) == [4, 5, 6, 7, 8] and pager(4, 9, 3) == [3, 4, 5]


def test_keys_and_labels():
    assert [to_key(v) for v in (True, 3, 3.0, 0.1 + 0.2, 1e-7, -2.50, "x,y", 1e15)] == ["true", "3", "3", "0.3", "0", "-2.5", "x,y", "1000000000000000"]
    assert from_key("12.5", [7.0, 12.5]) == 12.5 and from_key("no", [1.0]) == "no"
    assert range_label({"max": 4.0}) == "Up to 4" and range_label({"min": 1.0, "max": 2.0}) == "1 – 2" and distance_label(999.6) == "1000 m"
    assert value_label(Attribute("d", facet_type="date"), 0) == "Jan 1, 1970" and value_label(Attribute("h", facet_type="hierarchical"), "A > B") == "B"
    assert tree(["A", "A > B"])[1] == {"value": "A > B", "label": "B", "depth": 1, "parent": "A"}


@pytest.mark.parametrize("values", [[], [0], [127, 128, 300, 2**53 - 1], list(range(0, 5000, 7))])
def test_varint_round_trip(values):
    assert varint.decode(varint.encode(values)) == values and varint.decode(varint.encode(values, True), True) == values


@pytest.mark.parametrize("values,delta", [([-1], False), ([2**53], False), ([3, 2], True)])
def test_varint_refuses(values, delta):
    with pytest.raises(ValueError):
        varint.encode(values, delta)


def test_definitions_are_validated():
    good = IndexSpec("i", attributes=(Attribute("a", roles=("sortable",)),), sortings=(Sorting("s", "a"),))
    assert good.validated() is good and IndexSpec.from_dict(good.to_dict()) == good
    bad = IndexSpec("1x", attributes=(Attribute("a", facet_type="odd"), Attribute("a", max_values=0)), sortings=(Sorting("relevance", "b", "up"),), sources=(Source(status="odd"),), hits_per_page=0, transport="odd")
    with pytest.raises(SpecError) as problem:
        bad.validated()
    assert len(problem.value.problems) >= 9


def test_form_edits_keep_unseen_settings():
    spec = IndexSpec("i", attributes=(Attribute("a", roles=("facet",), facet_sort="alpha", transforms=("trim",)),))
    edited = spec.edited({"name": "New", "attributes": [{"key": "a", "label": "A"}]})
    assert edited.name == "New" and edited.attribute("a") == Attribute("a", label="A", roles=("facet",), facet_sort="alpha", transforms=("trim",))


def test_limited_features():
    spec = IndexSpec("i", attributes=(Attribute("g", roles=("facet", "payload"), facet_type="geo"), Attribute("a", roles=("sortable",))), sortings=(Sorting("x", "a"), Sorting("y", "a")), transport="json", stopwords=("the",))
    small = limited(spec, Features(facet_types=("string",), sortings=1, transports=("client",), word_lists=False))
    assert small.attribute("g").roles == ("payload",) and len(small.sortings) == 1 and small.transport == "client" and small.stopwords == ()
    assert limited(spec, Features()) == spec
