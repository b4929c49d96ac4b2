"""Facet values as bitmaps over internal ids: refinements, hits and leave-one-out counts without reading a record.

Ids are cut into buckets of 32,768.  In a bucket, a value that `DENSE` records or more have is a bitmap of 4 kB, others are a list of
places, so no value takes more than its records or 4 kB, whichever is less.  All is grouped and joined by bucket: a bucket's size is bounded,
and no value, however frequent, is in one task.

A predicate is one bitmap a bucket: the union of its values' bitmaps (`or`, ranges) or their intersection (`and`).  The base of a facet is the
intersection of the predicates that it is counted under; a value's count is the size of its intersection with that base.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.operators.facets import value_structs, wanted
from lodestone.operators.filters import KINDS, literal
from lodestone.spec import Attribute, IndexSpec
from lodestone.state import QueryState

#: Records of a bucket from which on a value is a bitmap: so many places take about as much.
DENSE = 1024
#: Names, among facets, of all records and of those that a caller gives; no facet can have them.
_ALL, _GIVEN = "", "?"
_VALUE = ["facet", "n", "s", "b"]


@dataclass(frozen=True)
class Bitmaps:
    """dense: bucket, facet, n, s, b, bitmap; sparse: bucket, facet, n, s, b, places."""

    spec: IndexSpec
    dense: DataFrame
    sparse: DataFrame

    def save(self, folder: str) -> Bitmaps:
        """Writes both tables, each sorted by facet and bucket within its files, so that a facet asked for is few row groups."""
        for name, table in (("dense", self.dense), ("sparse", self.sparse)):
            table.sortWithinPartitions("facet", "bucket").write.mode("overwrite").parquet(f"{folder}/{name}")
        return self.load(self.spec, self.dense.sparkSession, folder)

    @staticmethod
    def load(spec: IndexSpec, spark, folder: str) -> Bitmaps:
        return Bitmaps(spec, spark.read.parquet(f"{folder}/dense"), spark.read.parquet(f"{folder}/sparse"))


def _placed(ids: DataFrame, id_column: str, *columns: Column | str) -> DataFrame:
    own = F.col(id_column) + 1  # buckets are counted from 1
    return ids.select(F.bitmap_bucket_number(own).alias("bucket"), F.bitmap_bit_position(own).cast("int").alias("place"), *columns)


def facet_bitmaps(records: DataFrame, spec: IndexSpec, id_column: str = "id") -> Bitmaps:
    """Bitmaps of all facets of compiled records, each with an id from 0 of its own (see `store.internal_ids`); one shuffle.

    A group is a value within a bucket, so it has 32,768 places at most.  Values of null are none, as in counts of records.
    """
    empty = [F.lit(None).cast(t).alias(n) for n, t in (("n", "double"), ("s", "string"), ("b", "boolean"))]
    every = F.array(F.struct(F.lit(_ALL).alias("facet"), *empty))
    values = F.concat(every, *[F.coalesce(value_structs(a, F.col(f"f_{a.key}")), F.slice(every, 1, 0)) for a in spec.facets])
    long = _placed(records, id_column, F.explode(values).alias("v")).select("bucket", "v.*", "place")
    keys = ["bucket", *_VALUE]
    lists = long.groupBy(*keys).agg(F.collect_set("place").alias("places"))
    dense = lists.where(F.size("places") >= DENSE).select(*keys, F.explode("places").alias("place")).groupBy(*keys).agg(F.bitmap_construct_agg("place").alias("bitmap"))
    return Bitmaps(spec, dense, lists.where(F.size("places") < DENSE))


def _slot(attribute: Attribute) -> Column:
    return F.col({"double": "n", "boolean": "b"}.get(KINDS.get(attribute.facet_type, "string"), "s"))


class _Predicates:
    """A state's predicates as conditions on rows of values. Those of unknown facets are none; a range replaces refinements."""

    def __init__(self, spec: IndexSpec, state: QueryState, given: bool):
        known = {a.key: a for a in spec.facets}
        self.any, self.every, self.disjunctive = F.lit(False), F.lit(False), set()
        self.sizes: dict[str, int] = {}
        self.keys = {k for k, v in state.refinements.items() if k in known and v} | {k for k in state.ranges if k in known}
        if not given and (state.query or any(a.key in state.around and state.around[a.key]["radius"] > 0 for a in spec.geo)):
            raise ValueError("ids that match the text and the places have to be given")
        for key in self.keys:
            a, own = known[key], F.col("facet") == key
            if a.facet_operator != "and":
                self.disjunctive.add(key)
            if key in state.ranges:
                low, high = state.ranges[key].get("min"), state.ranges[key].get("max")
                inside = F.lit(a.is_numeric)
                inside = inside if low is None else inside & (F.col("n") >= low)
                self.any = self.any | (own & (inside if high is None else inside & (F.col("n") <= high)))
                continue
            asked = [literal(a, v) for v in dict.fromkeys(state.refinements[key])]
            known_values = [v for v in asked if v is not None]
            hit = own & _slot(a).isin(*known_values) if known_values else F.lit(False)
            if a.facet_operator == "and":
                self.every, self.sizes[key] = self.every | hit, len(asked)
            else:
                self.any = self.any | hit
        self.total = len(self.keys) + 1 + given  # all records are a predicate too, so that no base is without one

    def needed(self) -> Column:
        """How many values a conjunctive predicate's row must have met."""
        out = F.lit(1)
        for key, n in self.sizes.items():
            out = F.when(F.col("facet") == key, n).otherwise(out)
        return out


def _bases(maps: Bitmaps, state: QueryState, ids: DataFrame | None) -> tuple[_Predicates, DataFrame]:
    """bucket, target, base: the records that facets without a disjunctive predicate are counted over (target ''), and those of each other facet."""
    p = _Predicates(maps.spec, state, ids is not None)
    by = ["bucket", "facet"]
    some = p.any | (F.col("facet") == _ALL)
    united = maps.dense.where(some).select(*by, "bitmap")
    united = united.unionByName(maps.sparse.where(some).select(*by, F.explode("places").alias("place")).groupBy(*by).agg(F.bitmap_construct_agg("place").alias("bitmap")))
    if ids is not None:
        united = united.unionByName(_placed(ids, "id", F.lit(_GIVEN).alias("facet")).groupBy(*by).agg(F.bitmap_construct_agg("place").alias("bitmap")))
    found = united.groupBy(*by).agg(F.bitmap_or_agg("bitmap").alias("bitmap"))
    if p.sizes:
        keys = ["bucket", *_VALUE]
        each = maps.dense.where(p.every).select(*keys, "bitmap")
        each = each.unionByName(maps.sparse.where(p.every).select(*keys, F.explode("places").alias("place")).groupBy(*keys).agg(F.bitmap_construct_agg("place").alias("bitmap")))
        met = each.groupBy(*by).agg(F.bitmap_and_agg("bitmap").alias("bitmap"), F.count(F.lit(1)).alias("_n")).where(F.col("_n") == p.needed())
        found = found.unionByName(met.drop("_n"))
    targets = F.array(F.lit(_ALL), *[F.lit(k) for k in sorted(p.disjunctive)])
    dealt = found.select("*", F.explode(targets).alias("target")).where((F.col("target") == _ALL) | (F.col("facet") != F.col("target")))
    whole = F.col("_n") == F.when(F.col("target") == _ALL, p.total).otherwise(p.total - 1)
    return p, dealt.groupBy("bucket", "target").agg(F.bitmap_and_agg("bitmap").alias("base"), F.count(F.lit(1)).alias("_n")).where(whole).drop("_n")


def _within(places: str, base: str) -> Column:
    """How many places are set in a base; a bit is taken from the byte that holds it."""
    return F.expr(f"cast(aggregate({places}, 0, (n, p) -> n + if((cast(conv(hex(substring({base}, p div 8 + 1, 1)), 16, 10) as int) & shiftleft(1, p % 8)) > 0, 1, 0)) as bigint)")


def bitmap_counts(maps: Bitmaps, state: QueryState, ids: DataFrame | None = None) -> DataFrame:
    """facet, n, s, b, count, as `facets.facet_counts` has them (and values without a count): for `buckets`, `numeric_buckets`, `bitmap_stats`.

    ids: a column `id`, the records that match what bitmaps don't hold, a text or places; an error without it if the state asks for these.
    """
    attributes = wanted(maps.spec, state)
    asked = F.col("facet").isin(*[a.key for a in attributes]) if attributes else F.lit(False)
    dense, sparse = maps.dense.where(asked), maps.sparse.where(asked)
    p, bases = _bases(maps, state, ids)
    if p.total == 1:
        counted = dense.select(*_VALUE, F.bitmap_count("bitmap").alias("c")).unionByName(sparse.select(*_VALUE, F.size("places").cast("bigint").alias("c")))
        return counted.groupBy(*_VALUE).agg(F.sum("c").alias("count"))
    target = F.when(F.col("facet").isin(*sorted(p.disjunctive)), F.col("facet")).otherwise(F.lit(_ALL)) if p.disjunctive else F.lit(_ALL)
    on = ["bucket", "target"]
    dense = dense.withColumn("target", target).join(bases, on, "left")
    both = dense.select(*on, *_VALUE, F.col("base").isNull().alias("_none"), F.explode(F.array("bitmap", F.coalesce("base", "bitmap"))).alias("x"))
    dense = both.groupBy(*on, *_VALUE, "_none").agg(F.bitmap_count(F.bitmap_and_agg("x")).alias("c")).select(*_VALUE, F.when(F.col("_none"), F.lit(0)).otherwise(F.col("c")).cast("bigint").alias("c"))
    sparse = sparse.withColumn("target", target).join(bases, on, "left").select(*_VALUE, F.coalesce(_within("places", "base"), F.lit(0)).cast("bigint").alias("c"))
    return dense.unionByName(sparse).groupBy(*_VALUE).agg(F.sum("c").alias("count"))


def bitmap_hits(maps: Bitmaps, state: QueryState, ids: DataFrame | None = None) -> DataFrame:
    """hits: how many records pass all predicates."""
    _, bases = _bases(maps, state, ids)
    return bases.where(F.col("target") == _ALL).agg(F.coalesce(F.sum(F.bitmap_count("base")), F.lit(0)).cast("bigint").alias("hits"))


def bitmap_stats(counts: DataFrame, spec: IndexSpec, state: QueryState) -> DataFrame:
    """facet, min, max, avg, sum of numeric facets, from their values' counts."""
    numeric = [a.key for a in wanted(spec, state) if a.is_numeric]
    own = counts.where((F.col("count") > 0) & (F.col("facet").isin(*numeric) if numeric else F.lit(False)))
    total = F.sum(F.col("n") * F.col("count"))
    return own.groupBy("facet").agg(F.min("n").alias("min"), F.max("n").alias("max"), (total / F.sum("count")).alias("avg"), total.alias("sum"))
