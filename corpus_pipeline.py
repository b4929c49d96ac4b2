"""A training corpus from raw documents: quality, near duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.llm import decontaminate, near_dedup, packing, quality, suffix_dedup
from lodestone.llm.common import saved, table

#: Bytes of a repeated passage: 51 words of prose seldom take less (237 is the least seen).
PASSAGE = 224


def accept_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that the quality ranking rejects."""
    model = quality.train(docs, table(spark, sf_dir, "labels"))
    return quality.score(docs, model).where(F.col("_score") >= quality.CUT).drop("_score")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each class: five-word shingles, similarity 0.8 or more."""
    return near_dedup.one_of_each(docs, k=5, percent=80)


def cut_repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts passages of `PASSAGE` bytes or more that occur again; n_chars follows the text."""
    left = suffix_dedup.remove_repeats(docs, length=PASSAGE)
    columns = {"text": F.col("_left").alias("text"), "n_chars": F.length("_left").cast("long").alias("n_chars")}
    return left.select(*[columns.get(c, F.col(f"`{c}`")) for c in docs.columns])


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops the documents that hold a benchmark item."""
    return decontaminate.held_items(docs, table(spark, sf_dir, "benchmark")).where(F.size("_items") == 0).drop("_items")


def pack_batches(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The cleaned documents with the bucket and batch of each."""
    return packing.pack(docs)


STAGES = [
    ("quality classifier", accept_quality),
    ("MinHash near-dedup", drop_near_duplicates),
    ("suffix-array dedup", cut_repeated_passages),
    ("benchmark decontamination", drop_contaminated),
    ("packing", pack_batches),
]

#: Similarity joins, suffix arrays and trained scores are beyond SQL; tests/llm/test_pipeline.py holds each stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for n, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if n < len(STAGES) - 1:
            docs = saved(docs, f"stage-{n}")
    return docs
