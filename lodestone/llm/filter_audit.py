"""How filters that are applied one after the other interact, for every order of them.

What a filter removes depends on which filters came before it, not on their order.  So the orders are paths in the lattice of filter
sets, and all 120 orders of five filters share its 80 edges (a set already applied, the next filter).  Documents become a few counts
per part and set of failed filters; these counts become edges; each step of each order takes the figures of its edge.
"""

from __future__ import annotations

from itertools import permutations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

FILTERS = "ABCDE"
#: What separates words.
BETWEEN = " \t\n\x0b\f\r"
_CAPITALS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"


def _own_failures(text: Column) -> Column:
    """Bits 0 to 3: the text fails A (under 100 words), B (repeated words), C (capitals), D (symbols)."""
    inner = F.btrim(text, F.lit(BETWEEN))
    words = F.when(inner != "", F.split(inner, r"[\x20\x09-\x0D]+")).otherwise(F.array().cast("array<string>"))

    def failures(w: Column) -> Column:
        n = F.size(w)
        capitals = F.length(text) - F.length(F.translate(text, _CAPITALS, ""))
        conditions = (n < 100, 100 * F.size(F.array_distinct(w)).cast("long") < 80 * n.cast("long"), 100 * capitals.cast("long") > 10 * F.length(text).cast("long"), text.rlike(r"[#$%&*|]"))
        return sum((F.when(c, F.lit(1 << i)).otherwise(F.lit(0)) for i, c in enumerate(conditions)), F.lit(0))

    # The words are an array of one array, so that they are split once for both conditions that need them.
    return F.element_at(F.transform(F.array(words), failures), 1)


def failures(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, mask (bits of the failed filters), quality, toxic, n: documents per part, set of failed filters and labels.

    A null text is empty, a null part the empty string.  A document repeats if a smaller id has the same text anywhere; a null id is
    neither smaller than another nor has smaller ones, and rows of the same id don't repeat each other.  Of several labels of one
    document the largest counts; one without labels has neither.  Texts are told apart by their length and 256-bit hash.
    """
    text = F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))
    rows = docs.select(F.col(f"`{id_col}`").alias("_id"), F.coalesce(F.col(f"`{part_col}`").cast("string"), F.lit("")).alias("part"), text.alias("_t"))
    rows = rows.select("_id", "part", F.unhex(F.sha2(F.col("_t").cast("binary"), 256)).alias("_key"), F.octet_length("_t").alias("_size"), _own_failures(F.col("_t")).alias("_mask"))
    # Repeated rows meet here; what follows has one row per id, part and text.
    rows = rows.groupBy("_id", "part", "_key", "_size", "_mask").agg(F.count(F.lit(1)).alias("_n"))
    first = rows.groupBy("_key", "_size").agg(F.min("_id").alias("_id")).withColumn("_first", F.lit(True))
    rows = rows.join(first, ["_id", "_key", "_size"], "left")
    repeats = F.col("_first").isNull() & F.col("_id").isNotNull()
    rows = rows.select("_id", "part", "_n", (F.col("_mask") + F.when(repeats, F.lit(16)).otherwise(F.lit(0))).alias("mask"))
    known = labels.where(F.col("doc_id").isNotNull()).groupBy(F.col("doc_id").alias("_id")).agg(F.max(F.col("quality").cast("int")).alias("quality"), F.max(F.col("toxic").cast("int")).alias("toxic"))
    good, bad = (F.coalesce(F.col(c) == 1, F.lit(False)).alias(c) for c in ("quality", "toxic"))
    return rows.join(known, "_id", "left").select("part", "mask", good, bad, "_n").groupBy("part", "mask", "quality", "toxic").agg(F.sum("_n").alias("n"))


def edges(counts: DataFrame) -> DataFrame:
    """part, applied (bits), filter (0 to 4), kept, removed, redundant, unique_fails, good_lost, toxic_lost: 80 rows per part."""
    lattice = F.array(*[F.struct(F.lit(s).alias("applied"), F.lit(f).alias("filter")) for f in range(5) for s in range(32) if not s >> f & 1])
    each = counts.select("*", F.explode(lattice).alias("_edge")).select("part", "mask", "quality", "toxic", "n", "_edge.applied", "_edge.filter")
    bit = F.call_function("shiftleft", F.lit(1), F.col("filter"))
    fails, earlier = F.col("mask").bitwiseAND(bit) != 0, F.col("mask").bitwiseAND(F.col("applied")) != 0
    total = lambda condition, name: F.coalesce(F.sum(F.when(condition, F.col("n"))), F.lit(0)).cast("long").alias(name)
    return each.groupBy("part", "applied", "filter").agg(
        total(~fails & ~earlier, "kept"),
        total(fails & ~earlier, "removed"),
        total(fails & earlier, "redundant"),
        total(F.col("mask") == bit, "unique_fails"),
        total(fails & ~earlier & F.col("quality"), "good_lost"),
        total(fails & ~earlier & F.col("toxic"), "toxic_lost"),
    )


def steps(spark: SparkSession) -> DataFrame:
    """filter_order, step, applied, filter: the 600 steps of the 120 orders."""
    rows = []
    for order in permutations(range(5)):
        applied = 0
        for n, f in enumerate(order):
            rows.append(("".join(FILTERS[i] for i in order), n + 1, applied, f))
            applied |= 1 << f
    return spark.createDataFrame(rows, "filter_order string, step int, applied int, filter int")


def audit(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", part_col: str = "lang") -> DataFrame:
    """part, filter_order, step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley: 600 rows per part.

    See `failures` for nulls, repeats and labels.  An empty text has no words, so it fails A alone, and E if it repeats; a text of any
    length is one row, never cut; an empty table gives no parts.  Other columns of `docs` are not looked at.
    """
    paths = edges(failures(docs, labels, id_col, text_col, part_col)).join(F.broadcast(steps(docs.sparkSession)), ["applied", "filter"])
    sums = paths.groupBy("part", "filter").agg(F.sum("removed").alias("shapley"))
    return paths.join(sums, ["part", "filter"]).select("part", "filter_order", "step", "kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
