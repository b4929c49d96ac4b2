"""Element tables and change feeds in folders of Arrow files: a format of Spark's, to read, to write and to stream.

    register_format(spark)
    df.write.format(FORMAT).mode("append").save(folder)
    spark.read.format(FORMAT).load(folder).where("section = 'news'")
    spark.readStream.format(FORMAT).load(folder)

Each write is a commit: a small file in `_commits` that names the Arrow files of its tasks, with their rows, bytes and the bounds of
their columns.  A file that no commit names (of a task that failed or ran twice) is never read.  Filters on integers, strings and
booleans are pushed: files whose bounds rule them out are not opened, and rows that fail do not leave Python.  A stream's offset is the
number of a commit, so each commit is read once, whatever is restarted.

Filters in other forms, and on other types, are left to Spark.  A schema given by the reader reads those columns alone.  An overwrite is
a commit that hides those before it; their files stay for readers that began earlier.  One writer at a time.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterable, Iterator
from dataclasses import dataclass
from typing import Any

import pyarrow as pa
import pyarrow.compute as pc
from pyarrow import fs
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    DataSourceStreamReader,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    IsNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

FORMAT = "arrow_files"
#: Bytes in memory after which a task begins its next file, and of files that one task reads.
PART_BYTES = 64 << 20
#: Characters of a string that serve as a bound.
BOUND = 64
_BOUNDED = (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.StringType, T.BooleanType)


def register_format(spark: SparkSession) -> None:
    """Makes the format known to a session; filters are pushed to Python sources only where that is enabled."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(ArrowFiles)


class _Folder:
    """The commits of a folder, as they are when asked."""

    def __init__(self, uri: str):
        self.system, self.path = fs.FileSystem.from_uri(uri)

    def numbers(self) -> list[int]:
        found = self.system.get_file_info(fs.FileSelector(f"{self.path}/_commits", allow_not_found=True))
        return sorted(int(f.base_name.removesuffix(".json")) for f in found if f.base_name.endswith(".json"))

    def commit(self, number: int) -> dict[str, Any]:
        with self.system.open_input_stream(f"{self.path}/_commits/{number:020d}.json") as file:
            return json.loads(file.read())

    def live(self) -> list[int]:
        """Numbers of the commits since the last overwrite, that one included."""
        numbers = self.numbers()
        if not numbers:
            return []
        return [n for n in numbers if n >= self.commit(numbers[-1])["base"]]

    def add(self, files: list[dict], schema: T.StructType, overwrite: bool) -> None:
        numbers = self.numbers()
        number = numbers[-1] + 1 if numbers else 1
        base = number if overwrite or not numbers else self.commit(numbers[-1])["base"]
        self.system.create_dir(f"{self.path}/_commits", recursive=True)
        fresh = f"{self.path}/_commits/{uuid.uuid4().hex}.tmp"
        with self.system.open_output_stream(fresh, compression=None) as file:
            file.write(json.dumps({"base": base, "schema": schema.jsonValue(), "files": files}).encode())
        self.system.move(fresh, f"{self.path}/_commits/{number:020d}.json")


def _bounds(column: pa.ChunkedArray) -> dict[str, Any]:
    """nulls, low, high of a column of a file; a bound of null is none."""
    found = pc.min_max(column).as_py() if len(column) > column.null_count else {"min": None, "max": None}
    low, high = found["min"], found["max"]
    if isinstance(low, str):
        low, high = low[:BOUND], high if len(high) <= BOUND else None
    return {"nulls": column.null_count, "low": low, "high": high}


def _may_hold(file: dict[str, Any], wanted: Filter) -> bool:
    """Whether rows of a file can pass, by its bounds."""
    own = file["bounds"].get(wanted.attribute[0])
    if own is None:
        return True
    if isinstance(wanted, IsNull):
        return own["nulls"] > 0
    if own["nulls"] == file["rows"]:
        return False
    if isinstance(wanted, IsNotNull):
        return True
    reaches = lambda v, strict=False: own["high"] is None or (own["high"] > v if strict else own["high"] >= v)
    begins = lambda v, strict=False: own["low"] is None or (own["low"] < v if strict else own["low"] <= v)
    match wanted:
        case EqualTo():
            return reaches(wanted.value) and begins(wanted.value)
        case In():
            return any(reaches(v) and begins(v) for v in wanted.value if v is not None)
        case GreaterThan() | GreaterThanOrEqual():
            return reaches(wanted.value, isinstance(wanted, GreaterThan))
        case LessThan() | LessThanOrEqual():  # the bound may be a prefix, so that a strict comparison can't exclude it
            return begins(wanted.value)
    return True


def _passing(batch: pa.RecordBatch, wanted: Filter) -> pa.Array:
    column = batch.column(wanted.attribute[0])
    match wanted:
        case IsNull():
            return pc.is_null(column)
        case IsNotNull():
            return pc.is_valid(column)
        case In():
            return pc.is_in(column, value_set=pa.array([v for v in wanted.value if v is not None], column.type))
    compare = {EqualTo: pc.equal, GreaterThan: pc.greater, GreaterThanOrEqual: pc.greater_equal, LessThan: pc.less, LessThanOrEqual: pc.less_equal}
    return compare[type(wanted)](column, pa.scalar(wanted.value, column.type))


@dataclass
class Files(InputPartition):
    """Files that one task reads."""

    names: tuple[str, ...]


def _dealt(files: list[dict[str, Any]]) -> list[Files]:
    """Files in their order, small ones together."""
    out, names, size = [], [], 0
    for file in files:
        if names and size + file["bytes"] > PART_BYTES:
            out.append(Files(tuple(names)))
            names, size = [], 0
        names.append(file["name"])
        size += file["bytes"]
    return [*out, Files(tuple(names))] if names else out


def _batches(uri: str, names: tuple[str, ...], columns: list[str], filters: list[Filter]) -> Iterator[pa.RecordBatch]:
    folder = _Folder(uri)
    for name in names:
        with folder.system.open_input_file(f"{folder.path}/{name}") as source, pa.ipc.open_file(source) as whole:
            places = sorted(whole.schema.get_field_index(c) for c in columns)
        options = pa.ipc.IpcReadOptions(included_fields=places)
        with folder.system.open_input_file(f"{folder.path}/{name}") as source, pa.ipc.open_file(source, options=options) as file:
            for n in range(file.num_record_batches):
                batch = file.get_batch(n).select(columns)
                for wanted in filters:
                    batch = batch.filter(_passing(batch, wanted))  # null is not passing
                if batch.num_rows:
                    yield batch


class _Reader(DataSourceReader):
    def __init__(self, uri: str, schema: T.StructType):
        self.uri, self.schema, self.filters = uri, schema, []

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            own = self.schema[f.attribute[0]].dataType if hasattr(f, "attribute") and len(f.attribute) == 1 else None
            known = isinstance(f, (EqualTo, In, GreaterThan, GreaterThanOrEqual, LessThan, LessThanOrEqual, IsNull, IsNotNull))
            if known and isinstance(own, _BOUNDED) and getattr(f, "value", 0) is not None:
                self.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        folder = _Folder(self.uri)
        files = [f for n in folder.live() for f in folder.commit(n)["files"]]
        return _dealt([f for f in files if all(_may_hold(f, w) for w in self.filters)]) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _batches(self.uri, partition.names, self.schema.names, self.filters)


class _Stream(DataSourceStreamReader):
    """Commits in their order; a new query begins with the last overwrite."""

    def __init__(self, uri: str, schema: T.StructType):
        self.uri, self.schema = uri, schema

    def initialOffset(self) -> dict:
        return {"commit": next(iter(_Folder(self.uri).live()), 1) - 1}

    def latestOffset(self) -> dict:
        numbers = _Folder(self.uri).numbers()
        return {"commit": numbers[-1] if numbers else 0}

    def partitions(self, start: dict, end: dict) -> list[Files]:
        folder = _Folder(self.uri)
        return _dealt([f for n in folder.numbers() if start["commit"] < n <= end["commit"] for f in folder.commit(n)["files"]])

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return _batches(self.uri, partition.names, self.schema.names, [])


@dataclass
class _Written(WriterCommitMessage):
    files: list[dict[str, Any]]


class _Writer(DataSourceArrowWriter):
    def __init__(self, uri: str, schema: T.StructType, overwrite: bool):
        self.uri, self.schema, self.overwrite = uri, schema, overwrite
        self.bounded = [f.name for f in schema if isinstance(f.dataType, _BOUNDED)]

    def write(self, iterator: Iterator[pa.RecordBatch]) -> _Written:
        folder = _Folder(self.uri)
        folder.system.create_dir(folder.path, recursive=True)
        files, held, size = [], [], 0

        def flush() -> None:
            name = f"{uuid.uuid4().hex}.arrow"
            whole = pa.Table.from_batches(held)
            with folder.system.open_output_stream(f"{folder.path}/{name}", compression=None) as sink:
                with pa.ipc.new_file(sink, whole.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
                    out.write_table(whole)
            files.append({"name": name, "rows": whole.num_rows, "bytes": size, "bounds": {c: _bounds(whole.column(c)) for c in self.bounded}})

        for batch in iterator:
            if batch.num_rows:
                held.append(batch)
                size += batch.nbytes
            if size >= PART_BYTES:
                flush()
                held, size = [], 0
        if held:
            flush()
        return _Written(files)

    def commit(self, messages: list) -> None:
        _Folder(self.uri).add([f for m in messages if m is not None for f in m.files], self.schema, self.overwrite)

    def abort(self, messages: list) -> None:
        folder = _Folder(self.uri)
        for file in (f for m in messages if m is not None for f in m.files):
            folder.system.delete_file(f"{folder.path}/{file['name']}")


class ArrowFiles(DataSource):
    """The format; its one option is the folder, a path or a URI that all executors share and pyarrow can open."""

    @classmethod
    def name(cls) -> str:
        return FORMAT

    @property
    def folder(self) -> str:
        return self.options["path"]

    def schema(self) -> T.StructType:
        folder = _Folder(self.folder)
        numbers = folder.numbers()
        if not numbers:
            raise FileNotFoundError(f"{self.folder}: nothing was committed, and no schema is given")
        return T.StructType.fromJson(folder.commit(numbers[-1])["schema"])

    def reader(self, schema: T.StructType) -> DataSourceReader:
        return _Reader(self.folder, schema)

    def streamReader(self, schema: T.StructType) -> DataSourceStreamReader:
        return _Stream(self.folder, schema)

    def writer(self, schema: T.StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.folder, schema, overwrite)
