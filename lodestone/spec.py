"""Declarative index definitions: sources, typed attributes with roles, sortings, and their validation."""

from __future__ import annotations

import re
from dataclasses import asdict, dataclass, fields, replace
from typing import Any

STRING, HIERARCHICAL, NUMERIC, BOOLEAN, DATE, GEO = "string", "hierarchical", "numeric", "boolean", "date", "geo"
FACET_TYPES = (STRING, HIERARCHICAL, NUMERIC, BOOLEAN, DATE, GEO)
SEARCHABLE, FACET, SORTABLE, PAYLOAD = "searchable", "facet", "sortable", "payload"
ROLES = (SEARCHABLE, FACET, SORTABLE, PAYLOAD)
OPERATORS = ("or", "and")
FACET_SORTS = ("count", "alpha", "manual")
TRANSPORTS = ("client", "htmx", "json")
RELEVANCE, DISTANCE = "relevance", "distance"

_HANDLE = re.compile(r"[A-Za-z][A-Za-z0-9_]*")


class SpecError(ValueError):
    """A definition that can't be built; `problems` lists every reason."""

    def __init__(self, problems: list[str]):
        super().__init__("; ".join(problems))
        self.problems = problems


@dataclass(frozen=True)
class Source:
    """Which rows of which element table belong to an index."""

    type: str = "entry"
    containers: tuple[str, ...] = ()
    sub_types: tuple[str, ...] = ()
    status: str = "live"

    def problems(self) -> list[str]:
        return [] if self.status in ("live", "enabled", "any") else [f"source {self.type}: unknown status {self.status!r}"]


@dataclass(frozen=True)
class Attribute:
    """One declared column; it can be searchable, facet, sortable and payload at once."""

    key: str
    path: str = ""
    label: str = ""
    source: str = "field"
    roles: tuple[str, ...] = ()
    search_weight: float = 1.0
    facet_type: str = STRING
    facet_operator: str = "or"
    facet_sort: str = "count"
    facet_value_order: tuple[str, ...] = ()
    max_values: int | None = 20
    numeric_buckets: tuple[float, ...] = ()
    separator: str = " > "
    transforms: tuple[str, ...] = ()

    @property
    def column(self) -> str:
        return self.path or self.key

    @property
    def is_numeric(self) -> bool:
        return self.facet_type in (NUMERIC, DATE)

    def has(self, role: str) -> bool:
        return role in self.roles

    def problems(self) -> list[str]:
        out = []
        if not _HANDLE.fullmatch(self.key):
            out.append(f"attribute {self.key!r}: a key starts with a letter and holds letters, digits and underscores")
        if self.source not in ("attribute", "field"):
            out.append(f"attribute {self.key}: unknown source {self.source!r}")
        out += [f"attribute {self.key}: unknown role {r!r}" for r in self.roles if r not in ROLES]
        if self.facet_type not in FACET_TYPES:
            out.append(f"attribute {self.key}: unknown facet type {self.facet_type!r}")
        if self.facet_operator not in OPERATORS:
            out.append(f"attribute {self.key}: unknown operator {self.facet_operator!r}")
        if self.facet_sort not in FACET_SORTS:
            out.append(f"attribute {self.key}: unknown facet order {self.facet_sort!r}")
        if self.max_values is not None and self.max_values < 1:
            out.append(f"attribute {self.key}: at least one value is shown")
        if self.search_weight < 0:
            out.append(f"attribute {self.key}: weights are not negative")
        if list(self.numeric_buckets) != sorted(set(self.numeric_buckets)):
            out.append(f"attribute {self.key}: bucket boundaries ascend")
        if len(self.column.split(".")) > 6:
            out.append(f"attribute {self.key}: a path has six parts at most")
        return out


@dataclass(frozen=True)
class Relation:
    """The part `name` of a path: from elements of the table `on` (the index's own, if empty) to elements of the table `to`.

    links: a table of element_id, related_id, sort_order; or key: a column of the elements that holds an id, or an array of ids.
    most: related elements that are taken of each element, the first in order.
    """

    name: str
    to: str
    on: str = ""
    links: str = ""
    key: str = ""
    most: int = 200

    def problems(self) -> list[str]:
        out = [] if _HANDLE.fullmatch(self.name) else [f"relation {self.name!r}: not a handle"]
        if bool(self.links) == bool(self.key):
            out.append(f"relation {self.name}: links or a key")
        if self.most < 1:
            out.append(f"relation {self.name}: at least one element is taken")
        return out


@dataclass(frozen=True)
class Sorting:
    name: str
    attribute: str
    direction: str = "asc"
    label: str = ""


@dataclass(frozen=True)
class IndexSpec:
    handle: str
    name: str = ""
    sources: tuple[Source, ...] = ()
    sites: tuple[int, ...] = ()
    attributes: tuple[Attribute, ...] = ()
    sortings: tuple[Sorting, ...] = ()
    relations: tuple[Relation, ...] = ()
    transport: str = "client"
    hits_per_page: int = 24
    max_values: int = 20
    publish_debounce: int = 30
    stopwords: tuple[str, ...] = ()
    synonyms: tuple[str, ...] = ()
    enabled: bool = True

    def attribute(self, key: str) -> Attribute | None:
        return next((a for a in self.attributes if a.key == key), None)

    def with_role(self, role: str) -> list[Attribute]:
        return [a for a in self.attributes if a.has(role)]

    @property
    def facets(self) -> list[Attribute]:
        """Facets with values to count; geo facets only filter and order."""
        return [a for a in self.with_role(FACET) if a.facet_type != GEO]

    @property
    def geo(self) -> list[Attribute]:
        return [a for a in self.with_role(FACET) if a.facet_type == GEO]

    def sorting(self, name: str) -> Sorting | None:
        return next((s for s in self.sortings if s.name == name), None)

    def relation(self, on: str, name: str) -> Relation | None:
        return next((r for r in self.relations if (r.on, r.name) == (on, name)), None)

    def limit_of(self, attribute: Attribute) -> int:
        return attribute.max_values if attribute.max_values is not None else self.max_values

    def problems(self) -> list[str]:
        out = [] if _HANDLE.fullmatch(self.handle) else [f"index {self.handle!r}: not a handle"]
        keys = [a.key for a in self.attributes]
        out += [f"attribute {k}: defined twice" for k in sorted({k for k in keys if keys.count(k) > 1})]
        names = [s.name for s in self.sortings]
        out += [f"sorting {n}: defined twice" for n in sorted({n for n in names if names.count(n) > 1})]
        for s in self.sortings:
            own = self.attribute(s.attribute)
            if s.name in (RELEVANCE, DISTANCE):
                out.append(f"sorting {s.name}: the name is reserved")
            if own is None or not own.has(SORTABLE):
                out.append(f"sorting {s.name}: {s.attribute!r} is not a sortable attribute")
            if s.direction not in ("asc", "desc"):
                out.append(f"sorting {s.name}: unknown direction {s.direction!r}")
        ways = [(r.on, r.name) for r in self.relations]
        out += [f"relation {n}: defined twice" for n in sorted({w[1] for w in ways if ways.count(w) > 1})]
        out += [f"relation {r.name}: nothing leads to {r.on!r}" for r in self.relations if r.on and r.on not in {x.to for x in self.relations}]
        if self.hits_per_page < 1:
            out.append("a page has one hit at least")
        if self.transport not in TRANSPORTS:
            out.append(f"unknown transport {self.transport!r}")
        for part in (*self.attributes, *self.sources, *self.relations):
            out += part.problems()
        return out

    def validated(self) -> IndexSpec:
        if problems := self.problems():
            raise SpecError(problems)
        return self

    def to_dict(self) -> dict[str, Any]:
        return _plain(asdict(self))

    @classmethod
    def from_dict(cls, data: dict[str, Any]) -> IndexSpec:
        """Inverse of `to_dict`; unknown keys are ignored, missing ones take their defaults."""
        own = _known(cls, data)
        own["sources"] = tuple(Source(**_known(Source, s)) for s in data.get("sources", ()))
        own["attributes"] = tuple(Attribute(**_known(Attribute, a)) for a in data.get("attributes", ()))
        own["sortings"] = tuple(Sorting(**_known(Sorting, s)) for s in data.get("sortings", ()))
        own["relations"] = tuple(Relation(**_known(Relation, r)) for r in data.get("relations", ()))
        return cls(**own)

    def edited(self, data: dict[str, Any]) -> IndexSpec:
        """A form's edits: settings of an attribute that the form doesn't show stay as they are."""
        merged = {**self.to_dict(), **data}
        if "attributes" in data:
            before = {a.key: asdict(a) for a in self.attributes}
            merged["attributes"] = [{**before.get(a["key"], {}), **a} for a in data["attributes"]]
        return IndexSpec.from_dict(merged)


def _plain(value: Any) -> Any:
    if isinstance(value, dict):
        return {k: _plain(v) for k, v in value.items()}
    return [_plain(v) for v in value] if isinstance(value, (list, tuple)) else value


def _known(kind: type, data: dict[str, Any]) -> dict[str, Any]:
    names = {f.name for f in fields(kind)}
    return {k: tuple(v) if isinstance(v, list) else v for k, v in data.items() if k in names}


@dataclass(frozen=True)
class Features:
    """What an installation offers; `limited` rewrites a definition to it."""

    facet_types: tuple[str, ...] = FACET_TYPES
    sortings: int | None = None
    transports: tuple[str, ...] = TRANSPORTS
    word_lists: bool = True
    indexes: int | None = None


def limited(spec: IndexSpec, features: Features) -> IndexSpec:
    """`spec` without facets of other types, further sortings, other transports and word lists than `features` has."""
    attributes = tuple(
        a if not a.has(FACET) or a.facet_type in features.facet_types else replace(a, roles=tuple(r for r in a.roles if r != FACET)) for a in spec.attributes
    )
    return replace(
        spec,
        attributes=attributes,
        sortings=spec.sortings if features.sortings is None else spec.sortings[: features.sortings],
        transport=spec.transport if spec.transport in features.transports else features.transports[0],
        stopwords=spec.stopwords if features.word_lists else (),
        synonyms=spec.synonyms if features.word_lists else (),
    )


@dataclass
class EngineConfig:
    """Where an engine publishes, how many versions it keeps, and whether change events update it.

    buckets, ranges: into how many parts the store and each published table are cut.  A change rewrites parts, so they should be some
    hundred MB at most.
    """

    publish_path: str
    keep_versions: int = 3
    auto_update: bool = True
    compression: str = "zstd"
    buckets: int = 16
    ranges: int = 16
