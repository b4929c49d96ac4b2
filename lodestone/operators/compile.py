"""Tables to index records, postings and the long form of facet values."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.functions.text import synonym_map, tokens, word_list
from lodestone.operators.extract import facet_values, fails, payload, place_value, search_text, sort_key
from lodestone.spec import FACET, GEO, PAYLOAD, SEARCHABLE, SORTABLE, IndexSpec


@dataclass(frozen=True)
class Index:
    """records: one row per object; postings: one row per object and token."""

    spec: IndexSpec
    records: DataFrame
    postings: DataFrame | None = None


def object_id(table: DataFrame) -> list[Column]:
    if "object_id" in table.columns:
        return [F.col("object_id").cast("string").alias("object_id")]
    own = [F.col("element_id").try_cast("bigint").alias("element_id"), (F.col("site_id") if "site_id" in table.columns else F.lit(1)).cast("int").alias("site_id")]
    return [F.concat_ws("-", own[0].cast("string"), own[1].cast("string")).alias("object_id"), *own]


def compile_records(table: DataFrame, spec: IndexSpec) -> DataFrame:
    """One projection of a table: object_id, f_ (facets), g_ (places), s_ (sort keys), p_ (payload JSON), x_ (text).

    No shuffle, no Python: scans prune to the declared paths.  Where something tells of elements that can't be built, `_errors` does.
    """
    spec.validated()
    columns = object_id(table)
    if (why := flaws(table, spec)) is not None:
        columns.append(why.alias("_errors"))
    for a in spec.attributes:
        if a.has(FACET):
            columns.append(place_value(table, a).alias(f"g_{a.key}") if a.facet_type == GEO else facet_values(table, a).alias(f"f_{a.key}"))
        if a.has(SORTABLE):
            columns.append(sort_key(table, a).alias(f"s_{a.key}"))
        if a.has(PAYLOAD):
            columns.append(payload(table, a).alias(f"p_{a.key}"))
        if a.has(SEARCHABLE):
            columns.append(search_text(table, a).alias(f"x_{a.key}"))
    if spec.relations and "_deps" in table.columns:
        columns.append(F.col("_deps"))
    return table.select(*columns)


#: Columns of a table that say why a row can't be read: its own, or that of Spark's readers for text formats.
FLAWS = ("_error", "_corrupt_record")


def flaws(table: DataFrame, spec: IndexSpec) -> Column | None:
    """Why an element can't be built, as an array of strings, empty if it can; None if nothing here tells."""
    parts = [F.when(F.col(c).isNotNull(), F.concat(F.lit("row: "), F.col(c).cast("string"))) for c in FLAWS if c in table.columns]
    parts += [F.when(c, F.lit(f"{a.key}: unreadable")) for a in spec.attributes if (c := fails(table, a)) is not None]
    return F.filter(F.array(*parts), lambda x: x.isNotNull()) if parts else None


def build_postings(records: DataFrame, spec: IndexSpec) -> DataFrame:
    """token, object_id, weight: the sum of the attributes' weights over occurrences and synonyms, to three decimals.

    One aggregation on (object, token), combined before the shuffle.
    """
    stop = word_list(spec.stopwords)
    synonyms = synonym_map(spec.synonyms, stop)
    parts = []
    for a in spec.with_role(SEARCHABLE):
        found = tokens(F.col(f"x_{a.key}"))
        if stop:
            found = F.filter(found, lambda t: ~t.isin(*sorted(stop)))
        parts.append(F.transform(found, lambda t: F.struct(t.alias("token"), F.lit(float(a.search_weight)).alias("w"))))
    if not parts:
        return records.select(F.lit("").alias("token"), "object_id", F.lit(0.0).alias("weight")).limit(0)
    rows = records.select("object_id", F.explode(F.concat(*parts)).alias("t")).select("object_id", "t.token", "t.w")
    if synonyms:
        known = F.create_map(*[x for k, v in sorted(synonyms.items()) for x in (F.lit(k), F.array(*map(F.lit, v)))])
        every = F.concat(F.array("token"), F.coalesce(F.try_element_at(known, F.col("token")), F.array().cast("array<string>")))
        rows = rows.withColumn("token", F.explode(every))
    return rows.groupBy("token", "object_id").agg(F.round(F.sum("w"), 3).alias("weight"))


def build_index(table: DataFrame, spec: IndexSpec) -> Index:
    records = compile_records(table, spec)
    return Index(spec, records, build_postings(records, spec) if spec.with_role(SEARCHABLE) else None)


def facet_dictionary(records: DataFrame, spec: IndexSpec) -> DataFrame:
    """Every distinct value of every facet: facet, n, s, b, count of records."""
    from lodestone.operators.facets import value_structs

    every = F.concat(*[value_structs(a, F.col(f"f_{a.key}")) for a in spec.facets])
    return records.select(F.explode(every).alias("v")).select("v.*").groupBy("facet", "n", "s", "b").agg(F.count(F.lit(1)).alias("count"))
