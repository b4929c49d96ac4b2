"""Kinds of element tables, the rows of them that an index takes, and their union.

A kind turns a `Source` into one predicate; scanning filters by it, so it reaches the Parquet reader, and the incremental
build re-checks changed rows by the same predicate.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators.compile import FLAWS
from lodestone.spec import IndexSpec, Source, SpecError

Reader = Callable[[SparkSession], DataFrame]


@dataclass(frozen=True)
class Condition:
    """A condition as SQL; it is left out for tables that lack one of the columns `if_there`, and must resolve on all others."""

    sql: str
    if_there: tuple[str, ...] = ()


Conditions = str | tuple[Condition | str, ...]


@dataclass(frozen=True)
class Kind:
    """A kind of elements: the columns of its container and sub-type, and its statuses.

    live / enabled: one condition, or several that all hold.  One given as a string must resolve on the table.
    container_is_list: a row is in several containers (groups), and any of them counts.
    """

    name: str
    container: str
    sub_type: str | None = None
    live: Conditions = (Condition("status = 'live'", ("status",)),)
    enabled: Conditions = (Condition("enabled", ("enabled",)),)
    container_is_list: bool = False
    drafts: tuple[str, ...] = ("draft_id", "revision_id", "provisional")
    available: Callable[[], bool] = lambda: True


_ENABLED = (Condition("enabled", ("enabled",)),)
_LIVE = (
    *_ENABLED,
    Condition("post_date is null or post_date <= current_timestamp()", ("post_date",)),
    Condition("expiry_date is null or expiry_date > current_timestamp()", ("expiry_date",)),
)
_kinds: dict[str, Kind] = {}


def register_kind(kind: Kind) -> Kind:
    _kinds[kind.name] = kind
    return kind


def kinds() -> dict[str, Kind]:
    """The kinds that can be used in this installation."""
    return {k: v for k, v in _kinds.items() if v.available()}


for _kind in (
    Kind("entry", "section", "entry_type", live=_LIVE),
    Kind("category", "category_group", live=_ENABLED),
    Kind("tag", "tag_group", live=_ENABLED),
    Kind("asset", "volume", "kind", live=_ENABLED),
    Kind("user", "groups", live=(Condition("status = 'active'", ("status",)),), enabled=(Condition("status = 'active'", ("status",)),), container_is_list=True),
    Kind("product", "product_type", live=_LIVE),
):
    register_kind(_kind)


def status_filter(df: DataFrame, kind: Kind, status: str) -> Column:
    """The condition of a status over the columns that the table has; `any` takes all but drafts and revisions."""
    out = F.lit(True)
    for name in kind.drafts:
        if name in df.columns:
            own = F.col(name)
            out = out & (~F.coalesce(own, F.lit(False)) if dict(df.dtypes)[name] == "boolean" else own.isNull())
    if status != "any":
        given = kind.live if status == "live" else kind.enabled
        for condition in (given,) if isinstance(given, str) else given:
            own = condition if isinstance(condition, Condition) else Condition(condition)
            if set(own.if_there) <= set(df.columns):
                out = out & _resolved(df, own, kind)
    return out


def _resolved(df: DataFrame, condition: Condition, kind: Kind) -> Column:
    """A condition that holds on this table; Spark resolves it, so functions, BETWEEN and AND are what they are in SQL."""
    try:
        found = df.select(F.expr(condition.sql)).schema[0].dataType
    except AnalysisException as problem:
        raise SpecError([f"kind {kind.name}: the condition {condition.sql!r} does not resolve: {str(problem).splitlines()[0]}"]) from problem
    if not isinstance(found, T.BooleanType):
        raise SpecError([f"kind {kind.name}: {condition.sql!r} is {found.simpleString()}, not a condition"])
    return F.expr(condition.sql)


def covers(df: DataFrame, source: Source) -> Column:
    """Whether a row belongs to a source: container, sub-type and status; null, which `where` takes for no, if it can't be known.

    A conjunction of plain predicates, so that readers get each of them.
    """
    kind = kinds()[source.type]
    out = status_filter(df, kind, source.status)
    if source.containers:
        wanted = list(source.containers)
        own = F.arrays_overlap(F.col(kind.container), F.array(*map(F.lit, wanted))) if kind.container_is_list else F.col(kind.container).isin(*wanted)
        out = out & own
    if source.sub_types and kind.sub_type:
        out = out & F.col(kind.sub_type).isin(*source.sub_types)
    return out


def in_sites(df: DataFrame, sites: tuple[int, ...]) -> DataFrame:
    return df.where(F.col("site_id").isin(*sites)) if sites and "site_id" in df.columns else df


def scan(tables: dict[str, DataFrame], spec: IndexSpec, status: str | None = None) -> DataFrame:
    """The rows of all sources in all sites; a row that several sources take comes once, as the last of them gives it.

    Sources over one table become one scan with a disjunction, so only sources over several tables are united.
    """
    by_type: dict[str, list[Source]] = {}
    for source in spec.sources or (Source(),):
        by_type.setdefault(source.type, []).append(source)
    parts = []
    for place, (kind, sources) in enumerate(by_type.items()):
        if kind not in kinds() or kind not in tables:
            continue
        df = in_sites(tables[kind], spec.sites)
        if status is not None:
            sources = [Source(s.type, s.containers, s.sub_types, status) for s in sources]
        taken = reduce(lambda a, b: a | b, (covers(df, s) for s in sources))
        own, flaws = kinds()[kind], [c for c in FLAWS if c in df.columns]
        if len(sources) > 1 and all(s.containers for s in sources) and not own.container_is_list and not flaws:  # for readers that take no disjunction
            taken = F.col(own.container).isin(*sorted({c for s in sources for c in s.containers})) & taken
        for flaw in flaws:  # whether a row that can't be read belongs here isn't known
            taken = taken | (F.col(flaw).isNotNull() & F.col("element_id").isNotNull())
        parts.append(df.where(taken).withColumn("_source", F.lit(place)))
    if not parts:
        raise ValueError("no source of this index is available")
    if len(parts) == 1:
        return parts[0].drop("_source")
    every = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    keys = ["element_id", *(["site_id"] if "site_id" in every.columns else [])]
    last = every.groupBy(*keys).agg(F.max("_source").alias("_source"))
    return every.join(last, [*keys, "_source"], "left_semi").drop("_source")


def parquet(path: str) -> Reader:
    return lambda spark: spark.read.parquet(path)
