"""Connected components of a link table by alternating large-star and small-star steps."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved


def _digest(links: DataFrame) -> tuple:
    return tuple(links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("_u", "_v").cast("decimal(38,0)"))).first())


def components(links: DataFrame) -> DataFrame:
    """`_u`, `_root` for every node of the links (`_u`, `_v`; any orderable type) that isn't its component's least node.

    Each round is two aggregations with partial sums and their joins; the number of rounds grows with the logarithm
    of the longest chain.  Repeated links, loops and nulls are ignored.
    """
    links = saved(links.where("_u <> _v").select(F.greatest("_u", "_v").alias("_u"), F.least("_u", "_v").alias("_v")).distinct(), "links")
    was = None
    while (now := _digest(links)) != was and now[0]:
        was = now
        both = links.unionByName(links.select(F.col("_v").alias("_u"), F.col("_u").alias("_v")))
        least = both.groupBy("_u").agg(F.min("_v").alias("_m")).select("_u", F.least("_u", "_m").alias("_m"))
        large = both.join(least, "_u").where("_v > _u").select(F.col("_v").alias("_u"), F.col("_m").alias("_v")).where("_u <> _v").distinct()
        large = saved(large, "large-star")
        least = large.groupBy("_u").agg(F.min("_v").alias("_m"))
        small = large.join(least, "_u").select(F.col("_v").alias("_a"), "_m", "_u")
        small = small.select(F.explode(F.array(F.struct(F.col("_a").alias("_u"), F.col("_m").alias("_v")), F.struct(F.col("_u"), F.col("_m").alias("_v")))).alias("_e")).select("_e.*")
        links = saved(small.where("_u <> _v").distinct(), "small-star")
    return links.select("_u", F.col("_v").alias("_root"))
