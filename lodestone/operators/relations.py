"""Related elements of each element, as an array of structs, and the dependencies that reading them makes.

`related` turns the paths of a definition into joins: every part of a path that names a relation is a hop, hops with the same beginning
are one, and what is read on the way is what a record depends on.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.spec import IndexSpec, Relation, SpecError

#: Related elements taken into a record.
MOST = 200


def with_related(elements: DataFrame, links: DataFrame, related: DataFrame, name: str, columns: list[str], most: int = MOST) -> DataFrame:
    """`elements` with `name`: array of struct(columns) of the related elements, in link order, `most` at most.

    links: element_id, related_id, sort_order; related: element_id and the columns.  Links beyond `most` are dropped before
    the join, so a group is bounded when it is collected; elements without links get an empty array.
    """
    rank = F.row_number().over(Window.partitionBy("element_id").orderBy("sort_order", "related_id"))
    kept = links.select("element_id", "related_id", "sort_order", rank.alias("_rank")).where(F.col("_rank") <= most)
    found = kept.join(related.select(F.col("element_id").alias("related_id"), F.struct(*columns).alias("_item")), "related_id")
    lists = found.groupBy("element_id").agg(F.array_sort(F.collect_list(F.struct("_rank", "_item"))).alias("_l"))
    lists = lists.select("element_id", F.transform("_l", lambda x: x["_item"]).alias(name))
    out = elements.join(lists, "element_id", "left")
    return out.withColumn(name, F.coalesce(F.col(name), F.array().cast(lists.schema[name].dataType)))


def dependencies(links: DataFrame, most: int = MOST) -> DataFrame:
    """element_id, dep_element_id: every element that a record was built from."""
    rank = F.row_number().over(Window.partitionBy("element_id").orderBy("sort_order", "related_id"))
    kept = links.select("element_id", F.col("related_id").alias("dep_element_id"), rank.alias("_r")).where(F.col("_r") <= most)
    return kept.select("element_id", "dep_element_id").distinct()


@dataclass
class Hop:
    """A relation that paths go through: the columns of its elements that they need, and further hops from there."""

    relation: Relation
    columns: set[str] = field(default_factory=set)
    hops: dict[str, Hop] = field(default_factory=dict)


def hops(spec: IndexSpec) -> dict[str, Hop]:
    """The first hops of all attributes' paths; a path that ends in a relation takes its elements' id and title."""
    first: dict[str, Hop] = {}
    for attribute in spec.attributes:
        on, level, own = "", first, None
        for part in attribute.column.split("."):
            relation = spec.relation(on, part)
            if relation is None:
                if own is not None:
                    own.columns.add(part)
                break
            own = level.setdefault(part, Hop(relation))
            on, level = relation.to, own.hops
        else:
            own.columns |= {"id", "title"}
    return first


def related(elements: DataFrame, spec: IndexSpec, tables: dict[str, DataFrame]) -> DataFrame:
    """`elements` with an array of structs for each relation that the definition's paths begin with, and `_deps`, the ids read for it.

    Only links of these elements, and only elements that they lead to, are read; each hop is cut to its `most` before it is joined, so
    no group is unbounded.  Elements without related ones have empty arrays.  Related elements are of the same site, if they have sites.
    """
    if not (first := hops(spec)):
        return elements
    keys = [k for k in ("element_id", "site_id") if k in elements.columns]
    edges = None
    for name, hop in first.items():
        lists, own = _follow(elements, hop, tables)
        elements = elements.drop(name).join(lists, keys, "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
        edges = own if edges is None else edges.unionByName(own)
    deps = edges.groupBy(*keys).agg(F.array_sort(F.collect_set("dep")).alias("_deps"))
    return elements.join(deps, keys, "left").withColumn("_deps", F.coalesce("_deps", F.array().cast("array<bigint>")))


def _follow(parents: DataFrame, hop: Hop, tables: dict[str, DataFrame]) -> tuple[DataFrame, DataFrame]:
    """(keys, array of related elements) and (keys, dep) of the parents, by the joins of one hop and those below it."""
    relation = hop.relation
    keys = [k for k in ("element_id", "site_id") if k in parents.columns]
    if missing := [t for t in (relation.to, relation.links) if t and t not in tables]:
        raise SpecError([f"relation {relation.name}: no table {t!r}" for t in missing])
    if relation.links:
        links = tables[relation.links].select("element_id", F.col("related_id").cast("bigint").alias("_to"), F.col("sort_order").alias("_order")).join(parents.select(*keys).distinct(), "element_id")
    else:
        kind = parents.schema[relation.key].dataType.typeName()
        ids = F.col(relation.key) if kind == "array" else F.array(relation.key)
        links = parents.select(*keys, F.posexplode(ids).alias("_order", "_to")).withColumn("_to", F.col("_to").cast("bigint")).where(F.col("_to").isNotNull())
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("_order", "_to"))
    links = links.withColumn("_rank", rank).where(F.col("_rank") <= relation.most).select(*keys, "_to", "_rank")

    target = tables[relation.to]
    sites = ["site_id"] if "site_id" in keys and "site_id" in target.columns else []
    own = sorted(hop.columns - set(hop.hops))
    needed = list(dict.fromkeys(["element_id", *sites, *own, *(h.relation.key for h in hop.hops.values() if h.relation.key)]))
    if unknown := [c for c in needed if c not in target.columns]:
        raise SpecError([f"relation {relation.name}: the table {relation.to!r} has no column {c!r}" for c in unknown])
    target = target.select(*needed).join(links.select(F.col("_to").alias("element_id"), *sites).distinct(), ["element_id", *sites], "left_semi")
    edges = links.select(*keys, F.col("_to").alias("dep"))
    through = links.select(*keys, F.col("_to").alias("_child"), *[F.col(k).alias(f"_{k}") for k in sites])
    for name, below in hop.hops.items():
        lists, further = _follow(target, below, tables)
        target = target.drop(name).join(lists, ["element_id", *sites], "left").withColumn(name, F.coalesce(name, F.array().cast(lists.schema[name].dataType)))
        further = further.select(F.col("element_id").alias("_child"), *[F.col(k).alias(f"_{k}") for k in sites], "dep")
        edges = edges.unionByName(through.join(further, ["_child", *[f"_{k}" for k in sites]]).select(*keys, "dep"))
    item = F.struct(*own, *hop.hops).alias("_item")
    found = links.join(target.select(F.col("element_id").alias("_to"), *sites, item), ["_to", *sites])
    lists = found.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("_rank", "_item"))).alias("_l"))
    return lists.select(*keys, F.transform("_l", lambda x: x["_item"]).alias(relation.name)), edges.distinct()
