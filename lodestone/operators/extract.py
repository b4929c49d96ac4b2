"""Values of declared attributes as expressions: nested paths, structured values, transforms, coercions.

Every function maps a column (scalar, struct, or arrays of them, nested in any way) to expressions that stay in the JVM.
Structured values are told apart by their field names; `register_extractor` adds kinds before the built-in ones.
"""

from __future__ import annotations

import warnings
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions import geo
from lodestone.functions.facet_value import key_of
from lodestone.functions.text import folding
from lodestone.spec import BOOLEAN, HIERARCHICAL, NUMERIC, Attribute, SpecError

DEEPEST = 6


@dataclass(frozen=True)
class Extracted:
    """A structured value: what it counts as on its own, and its named parts.

    fails: where the value can't be read (the other columns must not raise there); such elements are left out of a build.
    """

    primary: Column
    parts: dict[str, Column]
    text: Column | None = None
    fails: Column | None = None


Extractor = Callable[[Column, T.StructType], Extracted | None]
_custom: list[Extractor] = []


def register_extractor(extractor: Extractor) -> Extractor:
    """Adds an extractor that is asked before the built-in ones; it declines by returning None."""
    _custom.append(extractor)
    return extractor


def unregister_extractor(extractor: Extractor) -> None:
    _custom.remove(extractor)


def _has(kind: T.StructType, *names: str) -> bool:
    return set(names) <= set(kind.names)


def _part(value: Column, kind: T.StructType, name: str) -> Column:
    return value[name] if name in kind.names else F.lit(None).cast("string")


#: Currencies without minor units. Fixed values.
WHOLE_CURRENCIES = ("BIF", "CLP", "DJF", "GNF", "ISK", "JPY", "KMF", "KRW", "PYG", "RWF", "UGX", "UYI", "VND", "VUV", "XAF", "XOF", "XPF")


def money(value: Column, kind: T.StructType) -> Extracted | None:
    """struct(minor, currency): the amount in major units."""
    if not _has(kind, "minor", "currency"):
        return None
    amount = value["minor"] / F.when(F.upper(value["currency"]).isin(*WHOLE_CURRENCIES), F.lit(1)).otherwise(F.lit(100))
    return Extracted(amount, {"amount": amount, "minor": value["minor"], "currency": value["currency"]})


def link(value: Column, kind: T.StructType) -> Extracted | None:
    """struct(url, ...): nothing without a URL."""
    if not _has(kind, "url") or _has(kind, "id"):
        return None
    url = F.when(value["url"] != "", value["url"])
    text = _part(value, kind, "text")
    return Extracted(url, {"url": url, "text": text, "type": _part(value, kind, "type")}, F.when(url.isNotNull(), F.coalesce(text, url)))


#: Parts of an address. Fixed values.
ADDRESS = ("lat", "lng", "street1", "street2", "city", "state", "zip", "country", "countryCode", "county", "formatted")


def address(value: Column, kind: T.StructType) -> Extracted | None:
    """struct(lat, lng, city, formatted, ...): its formatted form, else its city."""
    if not _has(kind, "lat", "lng") or not set(kind.names) & set(ADDRESS[2:]):
        return None
    parts = {n: _part(value, kind, n) for n in ADDRESS}
    shown = F.coalesce(F.when(parts["formatted"] != "", parts["formatted"]), parts["city"])
    return Extracted(shown, parts, shown)


def color(value: Column, kind: T.StructType) -> Extracted | None:
    if not _has(kind, "hex"):
        return None
    return Extracted(value["hex"], {"hex": value["hex"], "rgb": _part(value, kind, "rgb")})


def option(value: Column, kind: T.StructType) -> Extracted | None:
    """struct(value, label, selected): the stored value; unselected options are none."""
    if not _has(kind, "value", "label", "selected"):
        return None
    own = F.when(value["selected"], value["value"])
    return Extracted(own, {"value": own, "label": value["label"]}, F.when(value["selected"], F.coalesce(value["label"], value["value"])))


def element(value: Column, kind: T.StructType) -> Extracted | None:
    """struct(id, title, ...): a related element, by its title."""
    if not _has(kind, "id", "title"):
        return None
    return Extracted(value["title"], {n: value[n] for n in kind.names}, value["title"])


BUILT_IN: tuple[Extractor, ...] = (address, money, color, option, link, element)


def extracted(value: Column, kind: T.StructType) -> Extracted | None:
    for extractor in (*_custom, *BUILT_IN):
        try:
            found = extractor(value, kind)
        except Exception as problem:  # one that can't be asked is passed over, as if it had declined
            warnings.warn(f"extractor {getattr(extractor, '__name__', extractor)!s} failed on {kind.simpleString()}: {problem}", stacklevel=2)
            continue
        if found is not None:
            return found
    return None


def resolve(df: DataFrame, path: str) -> tuple[Column, T.DataType]:
    """The column of a dotted path, and its type; a path through arrays maps over their items.

    Parts of a structured value (`price.currency`) resolve as well as its fields.
    """
    names = path.split(".")
    if len(names) > DEEPEST:
        raise SpecError([f"path {path!r}: deeper than {DEEPEST}"])
    if names[0] not in df.columns:
        raise SpecError([f"path {path!r}: the table has no column {names[0]!r}"])
    column, kind = F.col(f"`{names[0]}`"), df.schema[names[0]].dataType
    for name in names[1:]:
        column, kind = _descend(column, kind, name, path, df)
    return column, kind


def _descend(column: Column, kind: T.DataType, name: str, path: str, df: DataFrame) -> tuple[Column, T.DataType]:
    if isinstance(kind, T.ArrayType):
        inner, item = _descend(F.lit(None), kind.elementType, name, path, df)
        del inner
        mapped = F.transform(column, lambda x: _descend(x, kind.elementType, name, path, df)[0])
        if isinstance(item, T.ArrayType):
            return F.flatten(F.filter(mapped, lambda x: x.isNotNull())), item
        return mapped, T.ArrayType(item)
    if isinstance(kind, T.StructType):
        if name in kind.names:
            return column[name], kind[name].dataType
        found = extracted(column, kind)
        if found is not None and name in found.parts:
            return found.parts[name], T.DoubleType() if name == "amount" else T.StringType()
    if isinstance(kind, T.MapType):
        return column[name], kind.valueType
    if isinstance(kind, T.VariantType):
        return F.try_variant_get(column, f"$.{name}", "variant"), kind
    raise SpecError([f"path {path!r}: no part {name!r}"])


def items(column: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """All leaves of a value as one array without nulls and empty strings, and their type."""
    while isinstance(kind, T.ArrayType) and isinstance(kind.elementType, T.ArrayType):
        column, kind = F.flatten(F.filter(column, lambda x: x.isNotNull())), kind.elementType
    if isinstance(kind, T.ArrayType):
        leaf = kind.elementType
    else:
        column, leaf = F.array(column), kind
    keep = (lambda x: x.isNotNull() & (x != "")) if isinstance(leaf, T.StringType) else (lambda x: x.isNotNull())
    return F.coalesce(F.filter(column, keep), F.array().cast(T.ArrayType(leaf))), leaf


def scalars(column: Column, kind: T.DataType, text: bool = False) -> tuple[Column, T.DataType]:
    """`items`, with structured values replaced by their primary value (or text)."""
    column, leaf = items(column, kind)
    if not isinstance(leaf, T.StructType):
        return column, leaf
    found = extracted(F.lit(None), leaf)
    if found is None:
        return F.transform(column, lambda x: F.to_json(x)), T.StringType()

    def of(x: Column) -> Column:
        own = extracted(x, leaf)
        return own.text if text and own.text is not None else own.primary

    is_number = "minor" in leaf.names and "currency" in leaf.names
    column = F.transform(column, lambda x: of(x).cast("double" if is_number else "string"))
    return items(column, T.ArrayType(T.DoubleType() if is_number else T.StringType()))


def fails(df: DataFrame, attribute: Attribute) -> Column | None:
    """Whether any value of an attribute can't be read, as its extractor tells; None if that can't be."""
    column, leaf = items(*resolve(df, attribute.column))
    if not isinstance(leaf, T.StructType):
        return None
    found = extracted(F.lit(None), leaf)
    return None if found is None or found.fails is None else F.exists(column, lambda x: F.coalesce(extracted(x, leaf).fails, F.lit(False)))


def _is_date(kind: T.DataType) -> bool:
    return isinstance(kind, (T.TimestampType, T.TimestampNTZType, T.DateType))


def _is_number(kind: T.DataType) -> bool:
    return isinstance(kind, T.NumericType)


TRANSFORMS = ("trim", "lower", "upper", "stripTags", "slug", "unique", "first", "sort", "compact", "date")


def transformed(column: Column, leaf: T.DataType, names: tuple[str, ...]) -> tuple[Column, T.DataType]:
    """An ordered chain of named transforms over an array of scalars; unknown names change nothing."""
    simple = {"trim": lambda x: F.trim(x), "lower": lambda x: F.lower(x), "upper": lambda x: F.upper(x), "stripTags": lambda x: F.regexp_replace(x, r"<[^>]*>", "")}
    for name in names:
        name, _, argument = name.partition(":")
        if name in simple and isinstance(leaf, T.StringType):
            column = F.transform(column, simple[name])
        elif name == "slug" and isinstance(leaf, T.StringType):
            marks, letters = folding()
            plain = lambda x: F.regexp_replace(F.translate(F.lower(x), marks, letters), r"[^a-z0-9]+", "-")
            column = F.transform(column, lambda x: F.regexp_replace(plain(x), r"^-+|-+$", ""))
        elif name == "unique":
            column = F.array_distinct(column)
        elif name == "first":
            column = F.slice(column, 1, 1)
        elif name == "sort":
            column = F.array_sort(column)
        elif name == "compact":
            column, _ = items(column, T.ArrayType(leaf))
        elif name == "date" and _is_date(leaf):
            pattern = argument or "yyyy-MM-dd"
            column, leaf = F.transform(column, lambda x: F.date_format(x, pattern)), T.StringType()
    return column, leaf


def attribute_values(df: DataFrame, attribute: Attribute, text: bool = False) -> tuple[Column, T.DataType]:
    column, kind = resolve(df, attribute.column)
    column, leaf = scalars(column, kind, text)
    return transformed(column, leaf, attribute.transforms)


def _string(x: Column, leaf: T.DataType) -> Column:
    if _is_date(leaf):
        return F.date_format(x, "yyyy-MM-dd")
    if isinstance(leaf, T.FractionalType):
        return key_of(x.cast("double"), NUMERIC)
    return x.cast("string")


def _epoch(x: Column) -> Column:
    return F.unix_timestamp(x.cast("timestamp")).cast("double")


def facet_values(df: DataFrame, attribute: Attribute) -> Column:
    """The distinct, ascending values of a facet; empty, never null."""
    column, leaf = attribute_values(df, attribute)
    if attribute.is_numeric:
        if isinstance(leaf, T.BooleanType):
            return F.array().cast("array<double>")
        number = _epoch if _is_date(leaf) else (lambda x: x.cast("double")) if _is_number(leaf) else (lambda x: x.cast("string").try_cast("double"))
        column = F.filter(F.transform(column, number), lambda x: x.isNotNull())
    elif attribute.facet_type == BOOLEAN:
        if not isinstance(leaf, T.BooleanType):
            truth = (lambda x: x != 0) if _is_number(leaf) else (lambda x: F.lit(True)) if _is_date(leaf) else (lambda x: x.cast("string") != "0")
            column = F.transform(column, truth)
    else:
        column = F.filter(F.transform(column, lambda x: _string(x, leaf)), lambda x: x != "")
        if attribute.facet_type == HIERARCHICAL:
            column = F.flatten(F.transform(column, lambda x: ancestors(x, attribute.separator)))
    return F.array_sort(F.array_distinct(column))


def ancestors(path: Column, separator: str = " > ") -> Column:
    """`a > b > c` as [a, a > b, a > b > c]; parts are trimmed and empty ones skipped."""
    parts = F.filter(F.transform(F.split(path, _quoted(separator.strip())), lambda p: F.trim(p)), lambda p: p != "")
    prefix = lambda i: F.array_join(F.slice(parts, 1, i), f" {separator.strip()} ")
    return F.when(F.size(parts) > 0, F.transform(F.sequence(F.lit(1), F.size(parts)), prefix)).otherwise(F.array().cast("array<string>"))


def _quoted(text: str) -> str:
    return "\\Q" + text.replace("\\E", "\\E\\\\E\\Q") + "\\E"


def sort_key(df: DataFrame, attribute: Attribute) -> Column:
    """struct(t, n, s): numbers (t = 0) before strings (t = 1); null if there is no value."""
    column, leaf = attribute_values(df, attribute)
    first = F.get(column, F.lit(0))
    if _is_date(leaf):
        number, string = _epoch(first), F.lit(None).cast("string")
    elif isinstance(leaf, (T.BooleanType, T.NumericType)):
        number, string = first.cast("double"), F.lit(None).cast("string")
    else:
        text = first.cast("string")
        number = F.when(text.rlike(r"^\s*[+-]?(\d+(\.\d*)?|\.\d+)([eE][+-]?\d+)?\s*$"), F.trim(text).try_cast("double"))
        string = F.when(number.isNull(), text)
    key = F.struct(F.when(number.isNotNull(), 0).otherwise(1).cast("tinyint").alias("t"), number.alias("n"), string.alias("s"))
    return F.when(first.isNotNull(), key)


def payload(df: DataFrame, attribute: Attribute) -> Column:
    """JSON of the value: one leaf as itself, several as a list, none as null."""
    column, kind = resolve(df, attribute.column)
    column, leaf = items(column, kind)
    if not isinstance(leaf, T.StructType):
        column, leaf = transformed(column, leaf, attribute.transforms)
    if isinstance(leaf, T.StructType) and extracted(F.lit(None), leaf) is not None:
        column = F.transform(column, lambda x: F.struct(*[c.alias(n) for n, c in extracted(x, leaf).parts.items()]))
    elif _is_date(leaf):
        column = F.transform(column, lambda x: F.concat(F.date_format(x, "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00")))
    many = F.to_json(column)
    return F.when(F.size(column) > 1, many).when(F.size(column) == 1, F.substring(many, F.lit(2), F.length(many) - 2))


def search_text(df: DataFrame, attribute: Attribute) -> Column:
    """The leaves joined by spaces; dates and booleans are no text."""
    column, leaf = attribute_values(df, attribute, text=True)
    if _is_date(leaf) or isinstance(leaf, T.BooleanType):
        return F.lit("")
    return F.trim(F.array_join(F.transform(column, lambda x: _string(x, leaf)), " "))


def place_value(df: DataFrame, attribute: Attribute) -> Column:
    """The first valid place: of lat/lng parts, a pair of numbers or a string `lat,lng`."""
    column, kind = resolve(df, attribute.column)
    if isinstance(kind, T.ArrayType) and _is_number(kind.elementType):
        return F.when(F.size(column) == 2, geo.place(F.get(column, F.lit(0)), F.get(column, F.lit(1))))
    column, leaf = items(column, kind)
    if isinstance(leaf, T.StructType):
        if not _has(leaf, "lat", "lng"):
            raise SpecError([f"attribute {attribute.key}: no place in {leaf.simpleString()}"])
        found = F.transform(column, lambda x: geo.place(x["lat"], x["lng"]))
    else:
        found = F.transform(column, lambda x: geo.parse_place(x.cast("string")))
    return F.get(F.filter(found, lambda x: x.isNotNull()), F.lit(0))
