import random
from datetime import datetime
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.functions.facet_value import key_of, to_key
from lodestone.functions.text import fold, folded, slug, synonym_map, tokenize, tokens, word_list
from lodestone.operators.extract import Extracted, attribute_values, facet_values, payload, place_value, register_extractor, search_text, sort_key, unregister_extractor
from lodestone.spec import Attribute, SpecError

TEXTS = [
    "Hello, World!", "Crème BRÛLÉE", "a bb ccc", "<p>one <b>two</b></p>", "caf&eacute; &amp; tea", "x &lt;b&gt; y", "&amp;amp; &#233;", "model 42", "e-mail@site.org", "日本語 テスト", "Ελληνικά",
    "straße ÜBER", "İstanbul", "ﬁne", "", "!!!", "ño", "tab\tand\nline", "Ǆ ȷ Ȿ", "&nbsp;gap&nbsp;", "&quot;q&quot;", "under_score", "½ ² Ⅷ", "a" * 65, "ß" * 64, "AT&T R&D &copy 1", "łódź øre đ",
]


def test_columns_fold_like_python(spark):
    rows = spark.createDataFrame([(t,) for t in [*TEXTS, None]], "t string").select("t", folded(F.col("t")).alias("f"), tokens(F.col("t")).alias("w")).collect()
    assert [(r.f, r.w) for r in rows] == [(None if r.t is None else fold(r.t), tokenize(r.t)) for r in rows]


@settings(max_examples=10, deadline=None)
@given(st.lists(st.text(alphabet=st.sampled_from("aZé&;<>#ampltİıßÀ 日1́_-"), max_size=12), min_size=40, max_size=40))
def test_random_texts_fold_alike(spark, texts):
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [tokenize(r.t) for r in rows]


def test_word_lists():
    assert word_list(["The", "à la"]) == {"the", "la"}
    assert synonym_map(["Sofa, couch", "the, sofa", "one"], {"the"}) == {"sofa": ["couch"], "couch": ["sofa"]}


def test_keys_in_columns(spark):
    values = [0.0, 3.0, -2.5, 0.1, 1e-6, 123456789.25, 1e12]
    rows = spark.createDataFrame([(v,) for v in values], "v double").select("v", key_of(F.col("v"), "numeric").alias("k")).collect()
    assert [r.k for r in rows] == [to_key(r.v) for r in rows]


@pytest.fixture(scope="module")
def nested(spark):
    schema = """id int, tags array<string>, deep array<array<string>>, num string, flag boolean, day timestamp, days array<date>,
      price struct<minor:bigint,currency:string>, site struct<url:string,text:string,type:string>, opts array<struct<value:string,label:string,selected:boolean>>,
      home struct<lat:double,lng:double,city:string,formatted:string>, tint struct<hex:string,rgb:string>, rel array<struct<id:int,title:string,kind:struct<name:string>>>, at string, pair array<double>"""
    rows = [
        (1, ["b", "", None, "a", "b"], [["x"], None, ["y", "x"]], " 12.50 ", True, datetime(2024, 5, 6, 7, 8, 9), [datetime(2024, 1, 2).date()],
         (1999, "usd"), ("https://e.org", "Site", "url"), [("r", "Red", True), ("g", "Green", False), ("b", "Blue", True)], (35.5, -80.5, "Town", ""), ("#fff", "255"),
         [(7, "Seven", ("odd",)), (8, "Eight", ("even",)), (9, "", None)], "35.5, -80.5", [1.0, 2.0]),
        (2, [], None, "abc", None, None, None, (500, "JPY"), ("", "none", None), None, (0.0, 0.0, None, None), None, None, "oops", [95.0, 0.0]),
    ]
    return spark.createDataFrame(rows, schema)


def column(df, expression):
    return [r[0] for r in df.orderBy("id").select(expression).collect()]


@pytest.mark.parametrize(
    "attribute,want",
    [
        (Attribute("tags"), [["a", "b"], []]),
        (Attribute("deep"), [["x", "y"], []]),
        (Attribute("num", facet_type="numeric"), [[12.5], []]),
        (Attribute("flag", facet_type="boolean"), [[True], []]),
        (Attribute("flag"), [["true"], []]),
        (Attribute("day"), [["2024-05-06"], []]),
        (Attribute("day", facet_type="date"), [[1714979289.0], []]),
        (Attribute("days", transforms=("date:yyyy",)), [["2024"], []]),
        (Attribute("price", facet_type="numeric"), [[19.99], [500.0]]),
        (Attribute("cur", "price.currency", transforms=("lower",)), [["usd"], ["jpy"]]),
        (Attribute("site"), [["https://e.org"], []]),
        (Attribute("opts"), [["b", "r"], []]),
        (Attribute("labels", "opts.label"), [["Blue", "Green", "Red"], []]),
        (Attribute("home"), [["Town"], []]),
        (Attribute("city", "home.city"), [["Town"], []]),
        (Attribute("tint"), [["#fff"], []]),
        (Attribute("rel"), [["Eight", "Seven"], []]),
        (Attribute("kinds", "rel.kind.name", transforms=("upper",)), [["EVEN", "ODD"], []]),
        (Attribute("rel", transforms=("first", "slug")), [["seven"], []]),
        (Attribute("deep", facet_type="boolean"), [[True], []]),
    ],
)
def test_facet_values(nested, attribute, want):
    assert column(nested, facet_values(nested, attribute)) == want


def test_sort_keys(nested):
    key = lambda name: [None if k is None else (k.t, k.n, k.s) for k in column(nested, sort_key(nested, Attribute(name)))]
    assert key("num") == [(0, 12.5, None), (1, None, "abc")] and key("flag") == [(0, 1.0, None), None]
    assert key("tags") == [(1, None, "b"), None] and key("day") == [(0, 1714979289.0, None), None]


def test_payloads(nested):
    assert column(nested, payload(nested, Attribute("tags"))) == ['["b","a","b"]', None]
    assert column(nested, payload(nested, Attribute("num"))) == ['" 12.50 "', '"abc"']
    assert column(nested, payload(nested, Attribute("flag"))) == ["true", None]
    assert column(nested, payload(nested, Attribute("day"))) == ['"2024-05-06T07:08:09+00:00"', None]
    assert column(nested, payload(nested, Attribute("price")))[1] == '{"amount":500.0,"minor":500,"currency":"JPY"}'


def test_search_texts(nested):
    assert column(nested, search_text(nested, Attribute("site"))) == ["Site", ""]
    assert column(nested, search_text(nested, Attribute("opts"))) == ["Red Blue", ""]
    assert column(nested, search_text(nested, Attribute("day"))) == column(nested, search_text(nested, Attribute("flag"))) == ["", ""]


def test_places(nested):
    for name in ("home", "at"):
        assert [None if p is None else (p.lat, p.lng) for p in column(nested, place_value(nested, Attribute(name)))] == [(35.5, -80.5), None]
    assert [None if p is None else (p.lat, p.lng) for p in column(nested, place_value(nested, Attribute("pair")))] == [(1.0, 2.0), None]


def test_unknown_paths_fail(nested):
    for path in ("nope", "price.nope", "id.x", "a.b.c.d.e.f.g"):
        with pytest.raises(SpecError):
            attribute_values(nested, Attribute("x", path))


def test_custom_extractors_come_first(nested):
    def short_color(value, kind):
        return Extracted(F.upper(value["hex"]), {"hex": value["hex"]}) if "hex" in kind.names else None

    register_extractor(short_color)
    try:
        assert column(nested, facet_values(nested, Attribute("tint"))) == [["#FFF"], []]
    finally:
        unregister_extractor(short_color)


def test_slugs(spark):
    assert [r[0] for r in spark.createDataFrame([(" Été à Paris! ",)], "t string").select(slug(F.col("t"))).collect()] == ["ete-a-paris"]


def test_bounds_of_a_radius_lose_no_place(spark):
    draw = random.Random(3)
    places = [(draw.uniform(-90, 90), draw.uniform(-180, 180)) for _ in range(3000)]
    places += [(lat, lng) for lat in (-90.0, -89.5, 0.5, 89.5, 90.0) for lng in (-180.0, -179.9, 0.0, 179.9, 180.0)]
    rows = spark.createDataFrame(places, "lat double, lng double").select(F.struct("lat", "lng").alias("p")).persist()
    for lat, lng in [(0, 0), (10, 179.95), (-20, -179.95), (10, 180), (89.9, 30), (-89.9, 0), (90, 0), (60, -170), (52.5, 13.4)]:
        for radius in (1, 60_000, 3_000_000, 9_000_000, 12_000_000, 25_000_000):
            near = geo.distance(F.col("p"), lat, lng) <= radius
            inside = reduce(lambda a, b: a & b, geo.box(F.col("p"), lat, lng, radius), F.lit(True))
            lost, kept = rows.agg(F.count_if(near & ~inside), F.count_if(inside)).first()
            assert lost == 0, (lat, lng, radius)
            assert radius > 3_000_000 or abs(lat) > 59 or kept < len(places) / 2, "and leave most others out"


def test_references_that_no_semicolon_ends_are_text(spark):
    texts = ["<h1>tea &amp</h1><p>hot", "tea &amp; hot", "der&am</h1>x", "&copy 1", "&copyx; &notit;", "&eacute;t&#233; &#xE9;", "caf&eac</b>ute;", "&amp;lt;b"]
    rows = spark.createDataFrame([(t,) for t in texts], "t string").select("t", tokens(F.col("t")).alias("w")).collect()
    assert [r.w for r in rows] == [["tea", "amphot"], ["tea", "hot"], ["der", "amx"], ["copy"], ["copyx", "notit"], ["ete"], ["cafe"], ["lt"]]
    assert [r.w for r in rows] == [tokenize(t) for t in texts]
