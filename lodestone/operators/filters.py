"""Predicates of a query state over index records."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from lodestone.functions import geo
from lodestone.spec import BOOLEAN, DATE, NUMERIC, Attribute, IndexSpec
from lodestone.state import QueryState, Value

KINDS = {NUMERIC: "double", DATE: "double", BOOLEAN: "boolean"}


def literal(attribute: Attribute, value: Value) -> Column | None:
    """A refined value as a literal of the facet's type; None if it is of another type, so that nothing has it."""
    kind = KINDS.get(attribute.facet_type, "string")
    if kind == "boolean":
        return F.lit(value) if isinstance(value, bool) else None
    if kind == "double":
        return F.lit(float(value)) if isinstance(value, (int, float)) and not isinstance(value, bool) else None
    return F.lit(value) if isinstance(value, str) else None


def refinement(attribute: Attribute, values: list[Value]) -> Column:
    """`or`: at least one of the values; `and`: all of them."""
    literals = [literal(attribute, v) for v in values]
    known = [v for v in literals if v is not None]
    column = F.col(f"f_{attribute.key}")
    if attribute.facet_operator == "and":
        if len(known) < len(literals):
            return F.lit(False)
        return F.size(F.array_except(F.array(*known), column)) == 0
    return F.arrays_overlap(column, F.array(*known)) if known else F.lit(False)


def in_range(attribute: Attribute, bounds: dict[str, float]) -> Column:
    """At least one value within the bounds, ends included; nothing for facets that aren't numeric."""
    if not attribute.is_numeric:
        return F.lit(False)
    low, high = bounds.get("min"), bounds.get("max")

    def within(v: Column) -> Column:
        inside = F.lit(True)
        if low is not None:
            inside = inside & (v >= low)
        return inside & (v <= high) if high is not None else inside

    return F.exists(f"f_{attribute.key}", within)


def nearby(attribute: Attribute, place: dict[str, float]) -> Column:
    return geo.distance(F.col(f"g_{attribute.key}"), place["lat"], place["lng"]) <= int(round(place["radius"]))


def predicates(spec: IndexSpec, state: QueryState) -> dict[str, Column]:
    """Facet -> predicate, never null. Unknown facets are ignored; a range replaces refinements of the same facet."""
    out: dict[str, Column] = {}
    known = {a.key: a for a in (*spec.facets, *spec.geo)}
    for key, values in state.refinements.items():
        if key in known and values and known[key] not in spec.geo:
            out[key] = refinement(known[key], values)
    for key, bounds in state.ranges.items():
        if key in known and known[key] not in spec.geo:
            out[key] = in_range(known[key], bounds)
    for key, place in state.around.items():
        if key in known and known[key] in spec.geo and place["radius"] > 0:
            out[key] = nearby(known[key], place)
    return {k: F.coalesce(p, F.lit(False)) for k, p in out.items()}


def boxes(spec: IndexSpec, state: QueryState) -> list[Column]:
    """What the radius predicates imply and a reader can use to skip rows: bounds of latitude and longitude."""
    asked = [(F.col(f"g_{a.key}"), state.around[a.key]) for a in spec.geo if a.key in state.around and state.around[a.key]["radius"] > 0]
    return [bound for point, p in asked for bound in geo.box(point, p["lat"], p["lng"], int(round(p["radius"])))]


def nearest(spec: IndexSpec, state: QueryState) -> Column | None:
    """Metres to the nearest of the places asked for; None if there is none."""
    found = [geo.distance(F.col(f"g_{a.key}"), p["lat"], p["lng"]) for a in spec.geo if (p := state.around.get(a.key))]
    return None if not found else found[0] if len(found) == 1 else F.least(*found)
