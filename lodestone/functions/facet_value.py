"""Facet values as the strings that URLs and responses carry."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def to_key(value: str | float | int | bool) -> str:
    """Booleans as true/false, whole numbers without decimals, others with up to six, strings as they are."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, int):
        return str(value)
    if isinstance(value, float):
        if value == int(value) if abs(value) < 1e300 and value == value else False:
            return f"{value:.0f}"
        return f"{value:.6f}".rstrip("0").rstrip(".")
    return value


def from_key(key: str, values: Iterable):
    """The value among `values` with this key; the key itself if there is none."""
    return next((v for v in values if to_key(v) == key), key)


def key_of(column: Column, kind: str) -> Column:
    """`to_key` as an expression over a facet's values."""
    if kind == "boolean":
        return F.when(column, F.lit("true")).when(~column, F.lit("false"))
    if kind in ("numeric", "date"):
        whole = column == F.floor(column)
        plain = F.regexp_replace(F.format_string("%.6f", column), r"\.?0+$", "")
        return F.when(column.isNull(), None).when(whole, F.format_string("%.0f", column)).otherwise(plain)
    return column.cast("string")
