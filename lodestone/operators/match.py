"""Conjunctive text match over postings: all tokens exactly, the last one also as a prefix."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def text_match(postings: DataFrame, tokens: list[str]) -> DataFrame:
    """object_id, score: objects that match every token, by the sum of the matched weights (the greatest for a prefix).

    One scan with a pushed-down filter on the token, then two aggregations; repeated query tokens count each time.
    """
    *exact, last = tokens
    hit = F.col("token").startswith(last)
    if exact:
        hit = hit | F.col("token").isin(*sorted(set(exact)))
    spots = [F.when(F.col("token") == t, F.lit(i)) for i, t in enumerate(exact)] + [F.when(F.col("token").startswith(last), F.lit(len(exact)))]
    found = postings.where(hit).select("object_id", "weight", F.explode(F.array_compact(F.array(*spots))).alias("spot"))
    if not exact:
        return found.groupBy("object_id").agg(F.round(F.max("weight"), 3).alias("score"))
    best = found.groupBy("object_id", "spot").agg(F.max("weight").alias("w"))
    return best.groupBy("object_id").agg(F.round(F.sum("w"), 3).alias("score"), F.count(F.lit(1)).alias("k")).where(F.col("k") == len(tokens)).drop("k")
