"""The record store: upserts, stubs, dirty marks along dependencies, soft deletes and pruning, as table transforms.

A store table has the key (element_id, site_id), the record's columns, and `dirty` and `deleted`.  Every function takes and
returns DataFrames; `Engine` decides where they are written.
"""

from __future__ import annotations

import itertools

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

KEY = ["element_id", "site_id"]


def upsert(store: DataFrame, rows: DataFrame) -> DataFrame:
    """`rows` replace stored rows of the same key; they are clean and not deleted. `rows` has each key once."""
    fresh = rows.withColumn("dirty", F.lit(False)).withColumn("deleted", F.lit(False))
    return store.join(rows.select(*KEY), KEY, "left_anti").unionByName(fresh, allowMissingColumns=True)


def touch(store: DataFrame, keys: DataFrame) -> DataFrame:
    """Marks keys dirty and alive; unknown ones get a stub without content."""
    keys = keys.select(*KEY).distinct()
    known = store.join(keys.withColumn("_hit", F.lit(True)), KEY, "left")
    known = known.withColumn("dirty", F.col("dirty") | F.col("_hit").isNotNull()).withColumn("deleted", F.col("deleted") & F.col("_hit").isNull()).drop("_hit")
    stubs = keys.join(store.select(*KEY), KEY, "left_anti").withColumn("dirty", F.lit(True)).withColumn("deleted", F.lit(False))
    return known.unionByName(stubs, allowMissingColumns=True)


def dependents(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """element_id of the records built from any changed element (one hop)."""
    return deps.join(changed.select(F.col("element_id").alias("dep_element_id")).distinct(), "dep_element_id", "left_semi").select("element_id").distinct()


def affected_indexes(deps: DataFrame, changed: DataFrame) -> DataFrame:
    """index of the dependency edges (index, element_id, dep_element_id) that a change touches."""
    return deps.join(changed.select(F.col("element_id").alias("dep_element_id")).distinct(), "dep_element_id", "left_semi").select("index").distinct()


def mark_dirty(store: DataFrame, elements: DataFrame) -> DataFrame:
    hit = elements.select("element_id").distinct().withColumn("_hit", F.lit(True))
    return store.join(hit, "element_id", "left").withColumn("dirty", F.col("dirty") | F.col("_hit").isNotNull()).drop("_hit").select(*store.columns)


def mark_all_dirty(store: DataFrame) -> DataFrame:
    return store.withColumn("dirty", F.lit(True))


def mark_deleted(store: DataFrame, keys: DataFrame) -> DataFrame:
    on = [k for k in KEY if k in keys.columns]
    hit = keys.select(*on).distinct().withColumn("_hit", F.lit(True))
    out = store.join(hit, on, "left").withColumn("deleted", F.col("deleted") | F.col("_hit").isNotNull())
    return out.withColumn("dirty", F.col("dirty") & F.col("_hit").isNull()).drop("_hit").select(*store.columns)


def missing(store: DataFrame, seen: DataFrame) -> DataFrame:
    """Stored keys that a full scan didn't see."""
    return store.select(*KEY).join(seen.select(*KEY), KEY, "left_anti")


def purged(store: DataFrame) -> DataFrame:
    return store.where(~F.col("deleted"))


def stream(store: DataFrame) -> DataFrame:
    """Rows to publish: alive and with content."""
    content = [c for c in store.columns if c[:2] in ("f_", "g_", "s_", "p_", "x_")]
    rows = store.where(~F.col("deleted"))
    return rows.where(F.col("object_id").isNotNull()) if "object_id" in rows.columns else rows.where(F.coalesce(*content).isNotNull())


def counts(store: DataFrame) -> DataFrame:
    """records, dirty, deleted."""
    return store.agg(
        F.count_if(~F.col("deleted")).alias("records"),
        F.count_if(F.col("dirty") & ~F.col("deleted")).alias("dirty"),
        F.count_if(F.col("deleted")).alias("deleted"),
    )


def _ranges(records: DataFrame) -> list:
    """Keys that cut the records into about as many ranges of like size as there are shuffle partitions."""
    parts = int(records.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    cuts = F.percentile_approx("element_id", F.array(*[F.lit(i / parts) for i in range(1, parts)]), 10_000) if parts > 1 else F.array()
    return sorted({c for c in records.agg(cuts.alias("cuts")).first()["cuts"] or [] if c is not None})


def internal_ids(records: DataFrame) -> DataFrame:
    """object_id, id: positions from 0 in (element, site) order.

    A record's range follows from its own key and fixed bounds, so however often and on however many tasks it is computed,
    ranges and their offsets agree; each range is sorted apart.
    """
    cuts = _ranges(records)
    above = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("element_id"))) if cuts else F.lit(0)
    dealt = records.select("object_id", *KEY, above.alias("_part"))
    sizes = {r["_part"]: r["n"] for r in dealt.groupBy("_part").agg(F.count(F.lit(1)).alias("n")).collect()}
    before = list(itertools.accumulate((sizes.get(n, 0) for n in range(len(cuts))), initial=0))
    rank = F.row_number().over(Window.partitionBy("_part").orderBy(*KEY)) - 1
    return dealt.select("object_id", (F.get(F.array(*map(F.lit, before)), F.col("_part")) + rank).cast("bigint").alias("id"))
