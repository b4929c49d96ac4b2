"""Headline queries on one warmed session; prints one JSON line.

An index over orders (facets, numeric and date ranges, a hierarchy, text) is built and published once; then each query is
answered whole (count, page, facets, statistics) several times, and the median counts.
"""

from __future__ import annotations

import json
import os
import sys
import tempfile
import time
from statistics import median

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from lodestone.operators.compile import Index, build_index
from lodestone.operators.publish import Publisher
from lodestone.operators.search import search
from lodestone.plans.response import response
from lodestone.spec import Attribute, IndexSpec, Sorting

SF_DIR, CPUS = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
REPEATS = int(os.environ.get("BENCH_REPEATS", "5"))

SPEC = IndexSpec(
    "orders",
    attributes=(
        Attribute("title", roles=("searchable", "payload"), search_weight=5),
        Attribute("nation", "n_name", roles=("facet",), max_values=200),
        Attribute("priority", "o_orderpriority", roles=("facet", "payload")),
        Attribute("status", "o_orderstatus", roles=("facet",)),
        Attribute("tags", roles=("facet",), facet_operator="and"),
        Attribute("price", "o_totalprice", roles=("facet", "sortable", "payload"), facet_type="numeric"),
        Attribute("featured", roles=("facet",), facet_type="boolean"),
        Attribute("place", roles=("facet",), facet_type="hierarchical", facet_operator="and"),
    ),
    sortings=(Sorting("price_asc", "price"), Sorting("price_desc", "price", "desc")),
)
QUERIES = {
    "unrefined_listing": {},
    "one_refinement": {"refinements": {"priority": ["1-URGENT"]}},
    "two_facets_and_a_range": {"refinements": {"priority": ["1-URGENT"], "tags": ["R"]}, "ranges": {"price": {"min": 20_000, "max": 200_000}}},
    "text_query": {"query": "building urg"},
    "text_query_and_a_facet": {"query": "machinery", "refinements": {"nation": ["NATION_3"]}},
    "sorted_page_21": {"sortBy": "price_asc", "page": 20},
}


def orders(spark: SparkSession):
    read = lambda name: spark.read.parquet(f"{SF_DIR}/{name}.parquet")
    places = read("nation").join(read("region"), F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", F.concat_ws(" > ", "r_name", "n_name").alias("place"))
    people = read("customer").join(places, F.col("c_nationkey") == F.col("n_nationkey"))
    flags = read("lineitem").groupBy("l_orderkey").agg(F.collect_set("l_returnflag").alias("tags"))
    rows = read("orders").join(people, F.col("o_custkey") == F.col("c_custkey")).join(flags, F.col("o_orderkey") == F.col("l_orderkey"), "left")
    title = F.concat_ws(" ", "c_mktsegment", "o_orderpriority", "c_name", F.col("o_orderkey").cast("string"))
    return rows.withColumn("object_id", F.col("o_orderkey").cast("string")).withColumn("title", title).withColumn("featured", F.col("o_orderkey") % 5 == 0)


def main() -> None:
    spark = (
        SparkSession.builder.master(f"local[{CPUS}]")
        .config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call sites: plans are built faster
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}
    with tempfile.TemporaryDirectory() as folder:
        began = time.time()
        publisher = Publisher(spark, f"file://{folder}")
        publisher.publish(build_index(orders(spark), SPEC))
        times["build_and_publish"] = time.time() - began
        live = publisher.published("orders")
        began = time.time()
        index = Index(SPEC, live.records.cache(), live.postings.cache())
        records, postings = index.records.count(), index.postings.count()
        times["load"] = time.time() - began
        for name, state in QUERIES.items():
            response(search(index, state))
            runs = []
            for _ in range(REPEATS):
                began = time.time()
                response(search(index, state))
                runs.append(time.time() - began)
            times[name] = median(runs)
    print(json.dumps({"metric": "median seconds of whole search responses, summed", "value": round(sum(times[n] for n in QUERIES), 3), "unit": "sec", "queries": {k: round(v, 3) for k, v in times.items()}, "sf": SF_DIR.rstrip("/").rsplit("sf", 1)[-1], "records": records, "postings": postings}))
    sys.stdout.flush()
    spark.stop()


if __name__ == "__main__":
    main()
