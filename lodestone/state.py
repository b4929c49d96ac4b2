"""Query states, their dictionaries and URLs, and the pure edits of them."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field, replace
from math import isfinite
from typing import Any
from urllib.parse import parse_qsl, quote, urlsplit

from lodestone.functions.facet_value import from_key, to_key
from lodestone.spec import BOOLEAN, DATE, GEO, NUMERIC, RELEVANCE, IndexSpec

Value = str | float | int | bool


_DECIMAL = re.compile(r"\s*[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?\s*", re.ASCII)


def _number(value: Any) -> float | None:
    """Finite numbers, and texts that are finite decimals; None otherwise (also for booleans)."""
    if isinstance(value, str):
        value = float(value) if _DECIMAL.fullmatch(value) else None
    if isinstance(value, bool) or not isinstance(value, (int, float)):
        return None
    try:
        return float(value) if isfinite(value) else None
    except OverflowError:
        return None


def _whole(value: Any) -> int | None:
    number = _number(value)
    return None if number is None else int(number)


def same(a: Value, b: Value) -> bool:
    """Typed equality: booleans only equal booleans, numbers compare as doubles."""
    if isinstance(a, bool) or isinstance(b, bool):
        return a is b
    if isinstance(a, (int, float)) and isinstance(b, (int, float)):
        return float(a) == float(b)
    return type(a) is type(b) and a == b


@dataclass(frozen=True)
class QueryState:
    query: str = ""
    refinements: dict[str, list[Value]] = field(default_factory=dict)
    ranges: dict[str, dict[str, float]] = field(default_factory=dict)
    around: dict[str, dict[str, float]] = field(default_factory=dict)
    sort_by: str = RELEVANCE
    page: int = 0
    hits_per_page: int | None = None
    facets: list[str] | None = None

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> QueryState:
        """Accepts snake and camel case; empty bounds, empty lists and invalid places are dropped, pages start at 0."""
        get = lambda *names: next((data[n] for n in names if data.get(n) is not None), None)
        ranges, around = {}, {}
        for key, bounds in (get("ranges") or {}).items():
            own = {b: n for b in ("min", "max") if (n := _number(bounds.get(b))) is not None}
            if own:
                ranges[key] = own
        for key, place in (get("around") or {}).items():
            lat, lng = _number(place.get("lat")), _number(place.get("lng"))
            if lat is not None and lng is not None:
                around[key] = {"lat": lat, "lng": lng, "radius": max(0.0, _number(place.get("radius")) or 0.0)}
        size, facets = get("hits_per_page", "hitsPerPage"), get("facets")
        return cls(
            query=str(get("query") or ""),
            refinements={k: list(v) if isinstance(v, (list, tuple)) else [v] for k, v in (get("refinements") or {}).items() if v not in (None, [], ())},
            ranges=ranges,
            around=around,
            sort_by=str(get("sort_by", "sortBy") or RELEVANCE),
            page=max(0, _whole(get("page")) or 0),
            hits_per_page=_whole(size),
            facets=None if facets is None else list(facets),
        )

    def to_dict(self) -> dict[str, Any]:
        every = {
            "query": self.query, "refinements": self.refinements, "ranges": self.ranges, "around": self.around, "sortBy": self.sort_by,
            "page": self.page, "hitsPerPage": self.hits_per_page, "facets": self.facets,
        }
        return {k: v for k, v in every.items() if v is not None and v != "" and v != {} and v != []}

    def is_refined(self, key: str, value: Value) -> bool:
        return any(same(value, v) for v in self.refinements.get(key, ()))

    @property
    def refined_facets(self) -> list[str]:
        keys = [k for k, v in self.refinements.items() if v] + [k for k, r in self.ranges.items() if r] + [k for k, p in self.around.items() if p["radius"] > 0]
        return list(dict.fromkeys(keys))

    @property
    def has_refinements(self) -> bool:
        return bool(self.refined_facets)

    # Edits; all but paging go back to the first page.
    def toggled(self, key: str, value: Value) -> QueryState:
        now = self.refinements.get(key, [])
        values = [v for v in now if not same(v, value)] if self.is_refined(key, value) else [*now, value]
        rest = {k: v for k, v in {**self.refinements, key: values}.items() if v}
        return replace(self, refinements=rest, page=0)

    def with_range(self, key: str, low: float | None = None, high: float | None = None) -> QueryState:
        bounds = {k: float(v) for k, v in (("min", low), ("max", high)) if v is not None}
        return replace(self, ranges={k: v for k, v in {**self.ranges, key: bounds}.items() if v}, page=0)

    def with_place(self, key: str, lat: float | None = None, lng: float | None = None, radius: float = 0.0) -> QueryState:
        rest = {k: v for k, v in self.around.items() if k != key}
        if lat is not None and lng is not None:
            rest[key] = {"lat": float(lat), "lng": float(lng), "radius": max(0.0, float(radius))}
        return replace(self, around=rest, page=0)

    def with_sort(self, name: str) -> QueryState:
        return replace(self, sort_by=name, page=0)

    def with_page(self, page: int) -> QueryState:
        return replace(self, page=max(0, page))

    def with_query(self, query: str) -> QueryState:
        return replace(self, query=query, page=0)

    def cleared(self, key: str | None = None) -> QueryState:
        """Without the refinements of one facet, or of all."""
        keep = lambda d: {} if key is None else {k: v for k, v in d.items() if k != key}
        return replace(self, refinements=keep(self.refinements), ranges=keep(self.ranges), around=keep(self.around), page=0)


def escape(value: str) -> str:
    return value.replace("\\", "\\\\").replace(",", "\\,")


def split(value: str) -> list[str]:
    """Comma-separated tokens; a backslash takes the next character as it is; empty tokens are dropped."""
    out, token, literal = [], [], False
    for i, c in enumerate(value):
        if not literal and c == "\\" and i + 1 < len(value):
            literal = True
        elif not literal and c == ",":
            out.append("".join(token))
            token = []
        else:
            token.append(c)
            literal = False
    return [t for t in [*out, "".join(token)] if t]


def _tokens(state: QueryState) -> Iterator[tuple[str, str]]:
    """(facet, token) of everything refined: values, then places, then ranges."""
    for key, values in state.refinements.items():
        yield from ((key, escape(to_key(v))) for v in values)
    for key, place in state.around.items():
        yield key, ",".join(to_key(float(place[part])) for part in ("lat", "lng", "radius"))
    for key, bounds in state.ranges.items():
        if bounds:
            yield key, "..".join(to_key(float(bounds[end])) if end in bounds else "" for end in ("min", "max"))


def encode(state: QueryState, prefix: str = "", default_sort: str = RELEVANCE) -> dict[str, str]:
    """URL parameters of a state; whatever is at its default is left out."""
    out: dict[str, str] = {"q": state.query} if state.query else {}
    for key, token in _tokens(state):
        out[key] = f"{out[key]},{token}" if key in out else token
    plain = {
        "sort": "" if state.sort_by == default_sort else state.sort_by,
        "page": str(state.page + 1) if state.page > 0 else "",
        "perPage": "" if state.hits_per_page is None else str(state.hits_per_page),
    }
    out |= {name: text for name, text in plain.items() if text}
    return {prefix + name: text for name, text in out.items()}


def url(path: str, state: QueryState, prefix: str = "", default_sort: str = RELEVANCE) -> str:
    part = lambda s: quote(s, safe="-._~").replace("%2C", ",")
    params = encode(state, prefix, default_sort)
    return path + ("?" + "&".join(f"{part(k)}={part(v)}" for k, v in params.items()) if params else "")


@dataclass(frozen=True)
class _Field:
    """What a URL says about one facet: its parameter, the two form fields, and how its tokens become values."""

    text: str
    ends: dict[str, str]
    typed: Callable[[str], Value]


def _span(ends: dict[str, str], otherwise: float | None) -> dict[str, float]:
    """Bounds that are given; those that are no numbers count as `otherwise`, or not at all."""
    numbers = {end: otherwise if (n := _number(text)) is None else n for end, text in ends.items() if text}
    return {end: n for end, n in numbers.items() if n is not None}


def _values(f: _Field) -> dict[str, Any]:
    return {"refinements": [f.typed(token) for token in split(f.text)]}


def _values_and_range(f: _Field) -> dict[str, Any]:
    """Tokens `low..high` are ranges, of which the last one counts; form fields only if there is no parameter."""
    if not f.text:
        return {"ranges": _span(f.ends, None)}
    tokens = split(f.text)
    spans = [span for token in tokens if ".." in token and (span := _span(dict(zip(("min", "max"), token.split("..", 1))), 0.0))]
    return {"refinements": [f.typed(token) for token in tokens if ".." not in token], "ranges": spans[-1] if spans else {}}


def _place(f: _Field) -> dict[str, Any]:
    """`lat,lng` or `lat,lng,radius`; no radius is 0."""
    lat, lng, radius, *_ = [*map(_number, f.text.split(",")), None, None, None]
    return {"around": {} if lat is None or lng is None else {"lat": lat, "lng": lng, "radius": max(0.0, radius or 0.0)}}


#: Facets of other types hold values alone.
_DECODERS = {GEO: _place, NUMERIC: _values_and_range, DATE: _values_and_range}


def _typing(kind: str, values: list[Value] | None) -> Callable[[str], Value]:
    """Tokens become the listed value with that key, or without a list a value of the type, or stay as they are."""
    if values is not None:
        return lambda token: from_key(token, values)
    if kind == BOOLEAN:
        return lambda token: {"true": True, "false": False}.get(token, token)
    if kind in (NUMERIC, DATE):
        return lambda token: token if (n := _number(token)) is None else n
    return lambda token: token


def parse(params: dict[str, Any] | str, facets: dict[str, dict[str, Any]] | IndexSpec, prefix: str = "", default_sort: str = RELEVANCE) -> QueryState:
    """The state of URL parameters (or of a URL).

    facets: `{key: {"type": ..., "values": [...]}}`, or a definition.  A token that is no value of its facet stays a
    string, and matches nothing; parameters that aren't text, and numbers that aren't finite decimals, count as not given.
    """
    if isinstance(params, str):
        params = dict(parse_qsl(urlsplit(params).query, keep_blank_values=True))
    if isinstance(facets, IndexSpec):
        facets = {a.key: {"type": a.facet_type} for a in facets.with_role("facet")}
    texts = {name.removeprefix(prefix): v for name, v in params.items() if name.startswith(prefix) and isinstance(v, str)}
    parts: dict[str, dict[str, Any]] = {"refinements": {}, "ranges": {}, "around": {}}
    for key, facet in facets.items():
        kind = facet.get("type", "string")
        ends = {end: texts.get(f"{key}_{end}", "") for end in ("min", "max")}
        for part, found in _DECODERS.get(kind, _values)(_Field(texts.get(key, ""), ends, _typing(kind, facet.get("values")))).items():
            if found:
                parts[part][key] = found
    page, size = (_whole(params.get(prefix + name)) for name in ("page", "perPage"))
    return QueryState(
        query=texts.get("q", "").strip(),
        sort_by=str(params.get(prefix + "sort", default_sort)),
        page=max(0, (page or 0) - 1),
        hits_per_page=None if size is None else max(1, size),
        **parts,
    )


@dataclass(frozen=True)
class Chip:
    """One active refinement, with the URL that removes it."""

    facet: str
    label: str
    url: str


def active(state: QueryState, spec: IndexSpec, path: str, label: Callable[[str, Any], str] | None = None, prefix: str = "") -> list[Chip]:
    from lodestone.functions.labels import distance_label, range_label, value_label

    out = []
    for key, values in state.refinements.items():
        own = spec.attribute(key)
        out += [Chip(key, label(key, v) if label else value_label(own, v) if own else to_key(v), url(path, state.toggled(key, v), prefix)) for v in values]
    out += [Chip(k, range_label(r), url(path, state.with_range(k), prefix)) for k, r in state.ranges.items()]
    out += [Chip(k, distance_label(p["radius"]), url(path, state.with_place(k), prefix)) for k, p in state.around.items() if p["radius"] > 0]
    return out


def pager(page: int, pages: int, window: int = 5) -> list[int]:
    """Page numbers to link, at most `window`, centred on the current one where there is room."""
    last, window = max(0, pages - 1), max(1, window)
    first = max(0, min(page - window // 2, last - window + 1))
    return list(range(first, min(last, first + window - 1) + 1))
