"""The engine against a plain Python one, over random tables and states."""

import math
import random

import pytest

from lodestone.functions.facet_value import to_key
from lodestone.functions.text import tokenize
from lodestone.operators.compile import Index, build_index
from lodestone.operators.search import search
from lodestone.plans.response import facet_view, response, to_json
from lodestone.spec import Attribute, IndexSpec, Sorting
from lodestone.state import QueryState

SPEC = IndexSpec(
    "things",
    attributes=(
        Attribute("title", roles=("searchable", "sortable", "payload"), search_weight=5),
        Attribute("body", roles=("searchable",), search_weight=1.5),
        Attribute("maker", roles=("facet", "payload"), max_values=3),
        Attribute("tags", roles=("facet",), facet_operator="and", facet_sort="alpha"),
        Attribute("cost", roles=("facet", "sortable"), facet_type="numeric"),
        Attribute("new", roles=("facet",), facet_type="boolean"),
        Attribute("path", roles=("facet",), facet_type="hierarchical", facet_operator="and", facet_sort="manual", facet_value_order=("A > x", "B")),
        Attribute("place", roles=("facet",), facet_type="geo"),
    ),
    sortings=(Sorting("cheap", "cost"), Sorting("dear", "cost", "desc"), Sorting("az", "title")),
    hits_per_page=7,
    stopwords=("the",),
    synonyms=("saw, cutter",),
)
SCHEMA = "object_id string, title string, body string, maker string, tags array<string>, cost array<double>, new boolean, path string, place array<double>"
WORDS = ["Red", "the", "saw", "Drill", "café", "dry", "sawdust", "b2"]


def table(seed, n=60):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        text = lambda k: " ".join(rng.choice(WORDS) for _ in range(rng.randint(0, k)))
        rows.append((
            f"{i}-1", text(3) or None, f"<p>{text(4)}</p>", rng.choice(["m1", "m2", "m3", "M4", "m5", None, ""]), rng.sample(["t1", "t2", "t3"], rng.randint(0, 3)) + [""],
            [float(rng.randint(0, 9)) for _ in range(rng.randint(0, 2))], rng.choice([True, False, None]), rng.choice(["A > x", "A > y", "B", "A>x", None]),
            rng.choice([None, [35.0, -80.0], [35.5, -80.5], [0.0, 0.0], [95.0, 1.0], [-10.0, 20.0]]),
        ))
    return rows


class Plain:
    """What the engine should answer."""

    def __init__(self, rows):
        self.rows = []
        for oid, title, body, maker, tags, cost, new, path, place in rows:
            parts = [p.strip() for p in (path or "").split(">") if p.strip()]
            facets = {
                "maker": [maker] if maker else [], "tags": sorted({t for t in tags if t}), "cost": sorted(set(cost)), "new": [] if new is None else [new],
                "path": sorted({" > ".join(parts[: i + 1]) for i in range(len(parts))}),
            }
            weights = {}
            for text, w in ((title, 5), (body, 1.5)):
                for t in tokenize(text):
                    if t != "the":
                        for x in {"saw": ["saw", "cutter"]}.get(t, [t]):
                            weights[x] = weights.get(x, 0) + w
            ok = place is not None and abs(place[0]) <= 90 and place != [0.0, 0.0]
            self.rows.append({"id": oid, "f": facets, "w": weights, "place": place if ok else None, "cost": cost[0] if cost else None, "title": title or None})

    def ask(self, s):
        q = [t for t in tokenize(s.query) if t != "the"]
        found = []
        for r in self.rows:
            scores = [r["w"].get(t) for t in q[:-1]] + ([max((w for k, w in r["w"].items() if k.startswith(q[-1])), default=None)] if q else [])
            if None not in scores:
                found.append((r, sum(scores)))
        checks = {}
        for k, v in s.refinements.items():
            if k in self.rows[0]["f"]:
                fit = all if SPEC.attribute(k).facet_operator == "and" else any
                checks[k] = lambda r, k=k, v=v, fit=fit: fit(any(type(x) is type(y) and x == y for y in r["f"][k]) for x in v)
        for k, b in s.ranges.items():
            if k in self.rows[0]["f"]:
                checks[k] = lambda r, k=k, b=b: k == "cost" and any(b.get("min", -math.inf) <= x <= b.get("max", math.inf) for x in r["f"][k])
        far = {}
        for k, p in s.around.items():
            for r in self.rows:
                if r["place"]:
                    a, b = (math.radians(x) for x in (r["place"][0], p["lat"]))
                    h = math.sin((b - a) / 2) ** 2 + math.cos(a) * math.cos(b) * math.sin(math.radians(p["lng"] - r["place"][1]) / 2) ** 2
                    far[r["id"]] = round(2 * 6371008.8 * math.atan2(math.sqrt(h), math.sqrt(1 - h)))
            if p["radius"] > 0:
                checks[k] = lambda r, p=p: r["id"] in far and far[r["id"]] <= round(p["radius"])
        hits = [(r, x) for r, x in found if all(c(r) for c in checks.values())]
        tail = lambda h: (-h[1], h[0]["id"])
        if s.sort_by == "distance" and s.around:
            hits.sort(key=lambda h: (far.get(h[0]["id"], math.inf), h[0]["id"]))
        elif s.sort_by in ("cheap", "dear"):
            hits.sort(key=lambda h: (h[0]["cost"] is None, (h[0]["cost"] or 0) * (1 if s.sort_by == "cheap" else -1), *tail(h)))
        elif s.sort_by == "az":
            hits.sort(key=lambda h: (h[0]["title"] is None, h[0]["title"] or "", *tail(h)))
        else:
            hits.sort(key=tail)
        size = max(1, SPEC.hits_per_page if s.hits_per_page is None else s.hits_per_page)
        pages = -(-len(hits) // size)
        page = min(s.page, max(0, pages - 1))
        facets, stats = {}, {}
        for a in SPEC.facets:
            if s.facets is not None and a.key not in s.facets:
                continue
            own = {k: c for k, c in checks.items() if a.facet_operator == "and" or k != a.key}
            base = [r for r, _ in found if all(c(r) for c in own.values())]
            every = {x for r in self.rows for x in r["f"][a.key]}
            rows = [(v, sum(v in r["f"][a.key] for r in base), s.is_refined(a.key, v)) for v in every]
            rows = [r for r in rows if r[1] or r[2]]
            order = list(a.facet_value_order)
            rows.sort(key=lambda r: ((order.index(r[0]) if r[0] in order else len(order)) if a.facet_sort == "manual" else 0, 0 if a.facet_sort == "alpha" else -r[1], r[0]))
            top = [r for r in rows if not r[2]][: a.max_values]
            facets[a.key] = [r for r in rows if r[2] or r in top]
            if a.is_numeric and (values := [x for r in base for x in r["f"][a.key]]):
                stats[a.key] = (min(values), max(values), sum(values) / len(values), sum(values))
        return {"n": len(hits), "page": page, "pages": pages, "hits": [(r["id"], round(x, 3)) for r, x in hits[page * size : page * size + size]], "facets": {k: v for k, v in facets.items() if v}, "stats": stats}


STATES = [
    {},
    {"query": "saw"},
    {"query": "red sa", "sortBy": "cheap"},
    {"query": "the", "page": 99},
    {"query": "cutter cutter", "refinements": {"maker": ["m1"]}},
    {"query": "zzz", "refinements": {"maker": ["m2"]}},
    {"refinements": {"maker": ["m1", "M4"]}, "sortBy": "dear", "page": 1},
    {"refinements": {"maker": ["m1"], "tags": ["t1", "t2"]}},
    {"refinements": {"maker": ["none"], "new": ["true"]}},
    {"refinements": {"new": [True], "path": ["A"], "unknown": ["x"]}, "sortBy": "az"},
    {"refinements": {"cost": [3, 4.0]}, "ranges": {"cost": {"min": 2, "max": 6}}},
    {"ranges": {"cost": {"min": 5}, "maker": {"min": 1}}},
    {"ranges": {"cost": {"min": 100}}, "refinements": {"path": ["B"], "maker": ["m3"]}},
    {"around": {"place": {"lat": 35, "lng": -80, "radius": 0}}, "sortBy": "distance", "hitsPerPage": 50},
    {"around": {"place": {"lat": 35, "lng": -80, "radius": 100_000}}, "refinements": {"new": [False]}},
    {"query": "dr", "refinements": {"tags": ["t3"]}, "facets": ["tags", "cost", "nope"], "sortBy": "odd", "hitsPerPage": 0},
]


@pytest.fixture(scope="module")
def indexes(spark):
    out = {}
    for seed in (1, 2):
        built = build_index(spark.createDataFrame(table(seed), SCHEMA), SPEC)
        out[seed] = Index(SPEC, built.records.cache(), built.postings.cache()), Plain(table(seed))
    return out


@pytest.mark.parametrize("number", range(len(STATES)))
def test_matches_plain_engine(indexes, number):
    index, plain = indexes[1 + number % 2]
    state = QueryState.from_dict(STATES[number])
    got, want = search(index, state), plain.ask(state)
    assert (got.nb_hits, got.page, got.nb_pages) == (want["n"], want["page"], want["pages"])
    assert [(r.object_id, r.score) for r in got.hits.collect()] == want["hits"]
    facets = {}
    for r in got.facets.orderBy("facet", "position").collect():
        facets.setdefault(r.facet, []).append((r.n if r.n is not None else r.b if r.b is not None else r.s, r["count"], r.is_refined))
        assert r.value == to_key(facets[r.facet][-1][0])
    assert facets == want["facets"]
    assert {r.facet: (r.min, r.max, pytest.approx(r.avg), r.sum) for r in got.stats.collect()} == want["stats"]


def test_pages_cover_all_hits_once(indexes):
    index, _ = indexes[1]
    seen = []
    for page in range(search(index, {"sortBy": "dear"}).nb_pages):
        seen += [r.object_id for r in search(index, {"sortBy": "dear", "page": page}).hits.collect()]
    assert sorted(seen) == sorted(r.object_id for r in index.records.collect())


def test_response(indexes):
    index, plain = indexes[1]
    state = QueryState.from_dict({"query": "red", "refinements": {"maker": ["m1"]}})
    got, want = response(search(index, state)), plain.ask(state)
    assert got["nbHits"] == want["n"] and [h["objectID"] for h in got["hits"]] == [i for i, _ in want["hits"]]
    assert set(got["hits"][0]) == {"objectID", "title", "maker"} if got["hits"] else True
    assert got["facets"]["maker"] == {v: c for v, c, _ in want["facets"]["maker"]} and got["params"] == "q=red&maker=m1"
    assert '"nbHits"' in to_json(search(index, state))
    view = {f["key"]: f for f in facet_view(search(index, state), "/p")}
    assert view["maker"]["isRefined"] and all(b["url"].startswith("/p") for b in view["maker"]["buckets"])
    assert all(b["depth"] in (0, 1) for b in view["path"]["buckets"])


def test_one_scan_counts_all_facets(indexes, spark):
    index, _ = indexes[1]
    plan = search(Index(SPEC, spark.createDataFrame([], index.records.schema), None), {"refinements": {"maker": ["m1"], "new": [True]}}).counts
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.count("Generate") == 1 and text.count("Aggregate") <= 1


def test_matches_are_not_counted_before_they_are_asked_for(spark):
    """A result of one job reads its texts once: no job runs to learn how many there are."""
    table = spark.createDataFrame([("1", "red tea"), ("2", "red cup"), ("3", "Crème")], "object_id string, text string")
    index = build_index(table, IndexSpec("few", attributes=(Attribute("text", roles=("searchable",)),)))
    spark.sparkContext.setJobGroup("lazy", "lazy")
    try:
        found = search(index, {"query": "red"}).candidates
        assert not spark.sparkContext.statusTracker().getJobIdsForGroup("lazy")
    finally:
        spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert sorted(r.object_id for r in found.collect()) == ["1", "2"]
