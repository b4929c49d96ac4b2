"""Leave-one-out facet counts and statistics in one pass, whatever the number of facets."""

from __future__ import annotations

from functools import reduce
from operator import add

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.functions.facet_value import key_of
from lodestone.operators.filters import KINDS, literal
from lodestone.spec import BOOLEAN, Attribute, IndexSpec
from lodestone.state import QueryState

_VALUE = "struct<facet:string,n:double,s:string,b:boolean>"


def value_structs(attribute: Attribute, values: Column) -> Column:
    """A facet's array as structs (facet, n, s, b), one of the last three set."""
    kind = KINDS.get(attribute.facet_type, "string")
    slot = {"double": "n", "boolean": "b", "string": "s"}[kind]
    empty = {"n": F.lit(None).cast("double"), "s": F.lit(None).cast("string"), "b": F.lit(None).cast("boolean")}
    return F.transform(values, lambda v: F.struct(F.lit(attribute.key).alias("facet"), *[(v if n == slot else empty[n]).alias(n) for n in ("n", "s", "b")]))


def wanted(spec: IndexSpec, state: QueryState) -> list[Attribute]:
    return [a for a in spec.facets if state.facets is None or a.key in state.facets]


def failures(checks: dict[str, Column]) -> Column:
    """How many facets' predicates a row fails."""
    return reduce(add, [(~c).cast("int") for c in checks.values()], F.lit(0))


def in_base(attribute: Attribute, checks: dict[str, Column], failed: Column) -> Column:
    """Whether a row counts for a facet: it passes all others, and the facet's own predicate too if that is conjunctive."""
    if attribute.key in checks and attribute.facet_operator != "and":
        return failed == (~checks[attribute.key]).cast("int")
    return failed == 0


def _counted(attribute: Attribute, values: str, count: str) -> str:
    """The values as structs (facet, n, s, b, c), each counting `count`, as SQL: one lambda, and one call to the JVM for all facets."""
    kind = KINDS.get(attribute.facet_type, "string")
    slots = {"n": "double", "s": "string", "b": "boolean"}
    own = ", ".join(f"'{name}', " + ("v" if kind == of else f"CAST(NULL AS {of})") for name, of in slots.items())
    return f"transform({values}, v -> named_struct('facet', '{attribute.key}', {own}, 'c', {count}))"


def _literals(attribute: Attribute, state: QueryState) -> list[Column]:
    return [x for v in state.refinements.get(attribute.key, ()) if (x := literal(attribute, v)) is not None]


def _among(attribute: Attribute, literals: list[Column]) -> Column:
    """The row's refined values, once each."""
    return F.coalesce(F.array_intersect(F.col(f"f_{attribute.key}"), F.array(*literals)), F.slice(F.col(f"f_{attribute.key}"), 1, 0))


def facet_counts(rows: DataFrame, spec: IndexSpec, state: QueryState, checks: dict[str, Column], every: DataFrame | None = None) -> DataFrame:
    """facet, n, s, b, count: every value of the facets' bases, and refined values that exist at all, with 0 at least.

    Rows fail early: those outside all bases without a refined value are gone before anything is exploded.  The rest is one
    explode and one aggregation with map-side sums.  `every`: all records, where `rows` are only those that match a text.
    """
    attributes = wanted(spec, state)
    if not attributes:
        return rows.select(F.lit("").alias("facet"), F.lit(0.0).alias("n"), F.lit("").alias("s"), F.lit(True).alias("b"), F.lit(0).cast("long").alias("count")).limit(0)
    refined = {a.key: x for a in attributes if (x := _literals(a, state))}
    kept = {a.key: _among(a, refined[a.key]).alias(f"_kept_{a.key}") for a in attributes if a.key in refined}
    inner = list(kept.values()) if every is None else []
    held = rows.select(*[f"f_{a.key}" for a in attributes], failures(checks).alias("_failed"), *[c.alias(f"_ok_{k}") for k, c in checks.items()], *inner)
    if checks:
        held = held.where(" OR ".join(["_failed <= 1", *(f"size(_kept_{k}) > 0" for k in kept if every is None)]))
    parts = []
    for a in attributes:
        base = "_failed = " + (f"int(NOT _ok_{a.key})" if a.key in checks and a.facet_operator != "and" else "0")
        other = f"_kept_{a.key}" if a.key in kept and every is None else f"slice(f_{a.key}, 1, 0)"
        parts.append(_counted(a, f"if({base}, f_{a.key}, {other})" if checks else f"f_{a.key}", f"if({base}, 1L, 0L)" if checks else "1L"))
    long = held.selectExpr(f"inline(concat({', '.join(parts)}))")
    if kept and every is not None:  # a scan of the refined facets' columns alone
        zeros = [_counted(a, f"_kept_{a.key}", "0L") for a in attributes if a.key in kept]
        long = long.unionByName(every.select(*kept.values()).selectExpr(f"inline(concat({', '.join(zeros)}))"))
    return long.groupBy("facet", "n", "s", "b").agg(F.sum("c").alias("count"))


def buckets(counts: DataFrame, spec: IndexSpec, state: QueryState) -> DataFrame:
    """facet, position, value, count, is_refined, n, s, b: ordered as declared, cut at the limits; refined values always stay."""
    attributes = wanted(spec, state)
    refined, limit, rank, mode, shown, most = F.lit(False), F.lit(20), F.lit(0), F.lit("count"), F.col("s"), 1
    for a in attributes:
        own = F.col("facet") == a.key
        slot = {"double": "n", "boolean": "b"}.get(KINDS.get(a.facet_type, "string"), "s")
        literals = _literals(a, state)
        most = max(most, spec.limit_of(a), len(literals))
        if literals:
            refined = refined | (own & F.coalesce(F.col(slot).isin(*literals), F.lit(False)))
        limit = F.when(own, spec.limit_of(a)).otherwise(limit)
        mode = F.when(own, a.facet_sort).otherwise(mode)
        if slot != "s":
            shown = F.when(own, key_of(F.col(slot), BOOLEAN if slot == "b" else a.facet_type)).otherwise(shown)
        if a.facet_sort == "manual" and a.facet_value_order:
            place = F.array_position(F.array(*[F.lit(str(v)) for v in a.facet_value_order]), key_of(F.col(slot), a.facet_type))
            rank = F.when(own, F.when(place > 0, place).otherwise(len(a.facet_value_order) + 1)).otherwise(rank)
    rows = counts.select("*", F.coalesce(refined, F.lit(False)).alias("is_refined"), limit.cast("int").alias("_limit"), rank.cast("int").alias("_rank"), (mode == "alpha").alias("_alpha"))
    rows = rows.where((F.col("count") > 0) | F.col("is_refined"))
    order = [F.col("_rank"), F.when(F.col("_alpha"), 0).otherwise(-F.col("count")), F.col("n").asc_nulls_last(), F.col("s").asc_nulls_last(), F.col("b").asc_nulls_last()]
    top = F.row_number().over(Window.partitionBy("facet", "is_refined").orderBy(*order))
    # No group has more refined values than `most`; as a plain bound on the rank it is taken up before the shuffle.
    kept = rows.withColumn("_at", top).where(F.col("_at") <= most).where(F.col("is_refined") | (F.col("_at") <= F.col("_limit")))
    place = F.row_number().over(Window.partitionBy("facet").orderBy(*order))
    return kept.select("facet", place.cast("int").alias("position"), shown.alias("value"), "count", "is_refined", "n", "s", "b")  # only what is left gets its key


def facet_stats(rows: DataFrame, spec: IndexSpec, state: QueryState, checks: dict[str, Column]) -> DataFrame:
    """facet, min, max, avg, sum over the values of numeric facets' bases; a record counts once per value.

    Values are reduced within the row, so nothing is exploded and one row per task is shuffled.
    """
    failed = failures(checks)
    aggregates, names = [], []
    for a in wanted(spec, state):
        if not a.is_numeric:
            continue
        values = F.when(in_base(a, checks, failed), F.col(f"f_{a.key}"))
        total = F.aggregate(values, F.lit(0.0), lambda x, v: x + v)
        names.append(a.key)
        aggregates.append(F.struct(F.lit(a.key).alias("facet"), F.min(F.array_min(values)).alias("min"), F.max(F.array_max(values)).alias("max"), F.sum(total).alias("sum"), F.sum(F.when(values.isNotNull(), F.size(values))).alias("k")))
    if not names:
        return rows.select(F.lit("").alias("facet"), *[F.lit(0.0).alias(n) for n in ("min", "max", "avg", "sum")]).limit(0)
    one = rows.agg(*[x.alias(f"a{i}") for i, x in enumerate(aggregates)])
    long = one.select(F.explode(F.array(*[f"a{i}" for i in range(len(aggregates))])).alias("x")).select("x.*").where("k > 0")
    return long.select("facet", "min", "max", (F.col("sum") / F.col("k")).alias("avg"), "sum")


def numeric_buckets(counts: DataFrame, attribute: Attribute) -> DataFrame:
    """Counts of a numeric facet grouped for display: lower and upper bound (null: open), count."""
    bounds = list(attribute.numeric_buckets)
    low, high = F.lit(None).cast("double"), F.lit(bounds[0] if bounds else None).cast("double")
    for i, b in enumerate(bounds):
        above = F.col("n") >= b
        low = F.when(above, F.lit(float(b))).otherwise(low)
        high = F.when(above, F.lit(bounds[i + 1] if i + 1 < len(bounds) else None).cast("double")).otherwise(high)
    own = counts.where((F.col("facet") == attribute.key) & (F.col("count") > 0))
    return own.select(low.alias("lower"), high.alias("upper"), "count").groupBy("lower", "upper").agg(F.sum("count").alias("count"))
