"""Labels of values, ranges and distances for display."""

from __future__ import annotations

from datetime import datetime, timezone

from lodestone.functions.facet_value import to_key
from lodestone.spec import BOOLEAN, DATE, HIERARCHICAL, Attribute


def value_label(attribute: Attribute, value) -> str:
    if attribute.facet_type == BOOLEAN:
        return "Yes" if value else "No"
    if attribute.facet_type == HIERARCHICAL:
        return str(value).split(attribute.separator.strip())[-1].strip()
    if attribute.facet_type == DATE and isinstance(value, (int, float)):
        day = datetime.fromtimestamp(value, timezone.utc)
        return f"{day:%b} {day.day}, {day.year}"
    return to_key(value)


def distance_label(metres: float) -> str:
    return f"{to_key(round(metres / 1000, 1))} km" if metres >= 1000 else f"{to_key(float(round(metres)))} m"


def range_label(bounds: dict[str, float]) -> str:
    low, high = bounds.get("min"), bounds.get("max")
    if low is not None and high is not None:
        return f"{to_key(low)} – {to_key(high)}"
    return f"{to_key(low)} and up" if low is not None else f"Up to {to_key(high)}"


def tree(values: list[str], separator: str = " > ") -> list[dict]:
    """Hierarchical values as rows with depth, label and parent path, in the given order."""
    cut, out = separator.strip(), []
    for value in values:
        parts = [p.strip() for p in value.split(cut)]
        out.append({"value": value, "label": parts[-1], "depth": len(parts) - 1, "parent": f" {cut} ".join(parts[:-1]) or None})
    return out
