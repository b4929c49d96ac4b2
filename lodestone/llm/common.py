"""Shared plumbing of the training-data operators: scratch tables, sessions, batching."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Where intermediate tables go if the session names no folder (tests and local runs only).
LOCAL_CHECKPOINTS = "/tmp/checkpoints"


def scratch(spark: SparkSession, name: str) -> str:
    """A new, unique folder below the cluster's shared checkpoint folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that all executors share")
        root = LOCAL_CHECKPOINTS
    return f"{root.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def saved(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet to the shared folder and read back: cuts the lineage, survives lost executors."""
    spark = df.sparkSession
    path = scratch(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def small_batches(spark: SparkSession, rows: int = 256) -> None:
    """Long texts: hand few rows at a time to Python, so that a worker's memory follows `rows`, not the table."""
    now = int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch", "10000"))
    if now <= 0 or now > rows:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))


def unused(df: DataFrame, *names: str) -> list[str]:
    """Names for working columns, each like its `names` but different from all columns of `df` (in any case)."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def text_key(col) -> F.Column:
    """128-bit key of a whole text; null counts as empty."""
    return F.unhex(F.md5(F.coalesce(col, F.lit("")).cast("binary")))


def by_bytes(batches: Iterable[pa.RecordBatch], text: str, limit: int = 1 << 20) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches whose texts (UTF-8, null as empty) sum to about `limit` bytes; a longer text stands alone."""
    for batch in batches:
        col = batch.column(batch.schema.get_field_index(text))
        values = [v or b"" for v in col.cast(pa.binary()).to_pylist()]
        start, size = 0, 0
        for i, v in enumerate(values):
            if size and size + len(v) > limit:
                yield batch.slice(start, i - start), values[start:i]
                start, size = i, 0
            size += len(v)
        if start < len(values):
            yield batch.slice(start), values[start:]


def with_columns(docs: DataFrame, text_col: str, added: str, work: Callable[[list[bytes]], list[pa.Array]], limit: int = 1 << 20) -> DataFrame:
    """`docs` and the columns `added` (a schema), which `work` computes of whole texts (UTF-8, null as empty), some at a time.

    All columns of `docs` pass through; one named like an added column (in any case) is replaced.  They travel as one struct,
    so none can meet a working column.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "_t", limit):
            yield pa.RecordBatch.from_arrays([batch.column(0), *work(texts)], ["_row", *names])

    names = T.StructType.fromDDL(added).fieldNames()
    own = [f for f in docs.schema.fields if f.name.lower() not in {n.lower() for n in names}]
    schema = T.StructType([T.StructField("_row", T.StructType([T.StructField(f.name, f.dataType) for f in own])), *T.StructType.fromDDL(added).fields])
    row = F.struct(*[F.col(f"`{f.name}`") for f in own]).alias("_row")
    out = docs.select(row, F.col(f"`{text_col}`").cast("string").alias("_t")).mapInArrow(run, schema)
    return out.select(*[F.col(f"_row.`{f.name}`") for f in own], *[F.col(f"`{n}`") for n in names])
