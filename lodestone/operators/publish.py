"""Versioned, content-addressed publication of an index, with a ledger of versions.

The records and postings of an index are dealt over ranges by a hash of the object id, so that those of one object are in the
same range.  The rows of a range are a part: a folder of Parquet files that is named by the checksum of what it holds.  A version is a
manifest of parts; versions share the parts that are equal, so a publication writes what has changed.  The pointer file
is replaced last, so readers see a whole version or the one before.
"""

from __future__ import annotations

import hashlib
import json
import threading
import time
from collections.abc import Iterator
from contextlib import contextmanager
from dataclasses import asdict, dataclass, field
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.functions.geo import cells
from lodestone.operators.compile import Index, build_postings
from lodestone.spec import SEARCHABLE, IndexSpec

LIVE, SUPERSEDED, FAILED = "live", "superseded", "failed"


@dataclass
class Version:
    version: int
    status: str
    checksum: str = ""
    records: int = 0
    bytes: int = 0
    build_ms: int = 0
    error: str = ""
    files: list[str] = field(default_factory=list)
    created_at: float = 0.0


#: Hexadecimal digits of the MD5 of an object id that its range follows from.
_DIGITS = 7


def range_of(ranges: int) -> Column:
    """The range of an object id."""
    return (F.conv(F.substring(F.md5(F.col("object_id").cast("binary")), 1, _DIGITS), 16, 10).cast("int") % F.lit(ranges)).cast("int")


def part_names(table: str, rows: DataFrame) -> dict[int, tuple[str, int]]:
    """{range: (name, count)} of rows with `_range`: the name is an order-free checksum of the rows, one aggregation for all ranges."""
    columns = [F.to_json(F.col(c)) if isinstance(rows.schema[c].dataType, (T.ArrayType, T.StructType, T.MapType)) else F.col(c) for c in sorted(rows.columns) if c != "_range"]
    row = F.xxhash64(*columns)
    sums = rows.groupBy("_range").agg(F.count(F.lit(1)), F.sum(row.cast("decimal(38,0)")), F.bit_xor(F.xxhash64(*columns, F.lit(1)))).collect()
    shape = sorted((f.name, f.dataType.simpleString()) for f in rows.schema.fields if f.name != "_range")
    return {r[0]: (f"{table}-{r[0]:05d}-{hashlib.sha256(repr((shape, *r[1:])).encode()).hexdigest()[:16]}", r[1]) for r in sums}


class Busy(RuntimeError):
    """Another writer holds the lock for longer than one waits, or has taken it over."""


class Folder:
    """Small files and subfolders below a Hadoop path, over whatever file system it is on."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.root = spark, path.rstrip("/")
        self._jvm = spark._jvm
        self._kind = self._jvm.org.apache.hadoop.fs.Path
        self._held: dict[str, tuple[int, int]] = {}
        self._fs = self._jvm.org.apache.hadoop.fs.Path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())
        self._local = self._fs.getUri().getScheme() == "file"
        # Small files have no checksum files on a local file system: a file and its checksum can't be replaced at once.
        self._small = self._fs.getRawFileSystem() if self._local else self._fs

    def _path(self, name: str):
        return self._kind(f"{self.root}/{name}" if name else self.root)

    def exists(self, name: str) -> bool:
        return self._fs.exists(self._path(name))

    def read(self, name: str) -> str | None:
        if not self.exists(name):
            return None
        stream = self._small.open(self._path(name))
        try:
            return bytes(self._jvm.org.apache.commons.io.IOUtils.toByteArray(stream)).decode()
        finally:
            stream.close()

    def _put(self, name: str, text: str, overwrite: bool) -> None:
        stream = self._small.create(self._path(name), overwrite)
        try:
            stream.write(bytearray(text.encode()))
        finally:
            stream.close()

    def write(self, name: str, text: str) -> None:
        """By a temporary file and a rename over the old one, so that a reader sees the old or the new content."""
        part = f"{name}.{time.time_ns()}.part"
        self._put(part, text, True)
        if self._local:
            if not self._small.rename(self._path(part), self._path(name)):
                raise OSError(f"could not replace {name}")
            return
        fs = self._jvm.org.apache.hadoop.fs
        kinds = getattr(fs, "Options$Rename")
        over = self.spark.sparkContext._gateway.new_array(kinds, 1)
        over[0] = kinds.OVERWRITE
        context = fs.FileContext.getFileContext(self._fs.getUri(), self.spark._jsc.hadoopConfiguration())
        context.rename(self._path(part), self._path(name), over)

    def _create(self, name: str, text: str) -> bool:
        """Whether the file was not there and is now, at once."""
        if self._local:
            file = self._jvm.java.io.File(self._path(name).toUri().getPath())
            file.getParentFile().mkdirs()
            if not file.createNewFile():
                return False
            self._put(name, text, True)
            return True
        try:
            self._put(name, text, False)
            return True
        except Py4JJavaError as taken:
            if not self.exists(name) and "AlreadyExists" not in str(taken.java_exception):
                raise
            return False

    def make(self, name: str) -> None:
        self._fs.mkdirs(self._path(name))

    def move(self, name: str, to: str) -> None:
        if not self._fs.rename(self._path(name), self._path(to)):
            raise OSError(f"could not rename {name} to {to}")

    # Locks: files `name.lock.1`, `.2`, ...  Whoever creates the file after the last one is the holder, and only one can.  That
    # is allowed if the last one is free or was not renewed for long, so a holder who died is followed, and one who
    # comes back finds a later file and knows that the lock is lost.
    def _turns(self, name: str) -> list[int]:
        head, _, tail = name.rpartition("/")
        return sorted(int(n.rsplit(".", 1)[1]) for n in self.names(head) if n.startswith(f"{tail}.lock.") and n.rsplit(".", 1)[1].isdigit())

    @contextmanager
    def lock(self, name: str, wait: float = 600.0, stale: float = 120.0) -> Iterator[None]:
        """One writer at a time.  The holder may lock again; it renews the lock, and one who hasn't for `stale` seconds is followed."""
        me = threading.get_ident()
        if self._held.get(name, (None,))[0] == me:
            yield
            return
        until = time.time() + wait
        while (turn := self._acquire(name, stale)) is None:
            if time.time() > until:
                raise Busy(name)
            time.sleep(0.2)
        self._held[name] = (me, turn)
        done = threading.Event()
        renewal = threading.Thread(target=self._renew, args=(name, turn, stale / 4, done), daemon=True)
        renewal.start()
        try:
            yield
        finally:
            done.set()
            renewal.join()
            del self._held[name]
            if self._turns(name)[-1:] == [turn]:
                self.write(f"{name}.lock.{turn}", "free")

    def _acquire(self, name: str, stale: float) -> int | None:
        turns = self._turns(name)
        last = turns[-1] if turns else 0
        if last and self.read(f"{name}.lock.{last}") != "free" and self._age(f"{name}.lock.{last}") <= stale:
            return None
        if not self._create(f"{name}.lock.{last + 1}", "held"):
            return None
        for n in turns:
            self.delete(f"{name}.lock.{n}")
        return last + 1

    def _renew(self, name: str, turn: int, every: float, done: threading.Event) -> None:
        while not done.wait(every):
            if self._turns(name)[-1:] != [turn]:
                return
            self.write(f"{name}.lock.{turn}", "held")

    def still_held(self, name: str) -> None:
        """Raises if a held lock was taken over: asked before what others would overwrite is written."""
        held = self._held.get(name)
        if held is not None and self._turns(name)[-1:] != [held[1]]:
            raise Busy(f"{name}: another writer took over")

    def _age(self, name: str) -> float:
        try:
            return time.time() - self._fs.getFileStatus(self._path(name)).getModificationTime() / 1000
        except Py4JJavaError:
            return 0.0

    def delete(self, name: str) -> None:
        self._fs.delete(self._path(name), True)

    def names(self, name: str = "") -> list[str]:
        return sorted(s.getPath().getName() for s in self._fs.listStatus(self._path(name))) if self.exists(name) else []

    def size(self, name: str) -> int:
        return self._fs.getContentSummary(self._path(name)).getLength() if self.exists(name) else 0


@dataclass
class Changes:
    """What differs from a live version: ids of objects that changed or went, and the records of those that are there."""

    since: str
    ids: DataFrame
    records: DataFrame


class Publisher:
    """Publishes the versions of indexes below one path; `folder` takes the place of the Hadoop folder there.

    ranges: parts of each table of an index that is published for the first time; later versions keep their number.
    last: for each index, the names of the parts that the last publication wrote, shared and deleted.
    """

    def __init__(self, spark: SparkSession, path: str, keep: int = 3, compression: str = "zstd", patience: float = 600.0, folder: Folder | None = None, ranges: int = 16):
        self.spark, self.folder, self.keep, self.compression, self.patience, self.ranges = spark, folder or Folder(spark, path), keep, compression, patience, ranges
        self.last: dict[str, dict[str, list[str]]] = {}

    def versions(self, handle: str) -> list[Version]:
        text = self.folder.read(f"{handle}/versions.json")
        return [Version(**v) for v in json.loads(text)] if text else []

    def _save(self, handle: str, versions: list[Version]) -> None:
        self.folder.write(f"{handle}/versions.json", json.dumps([asdict(v) for v in versions]))

    def pointer(self, handle: str) -> dict[str, Any] | None:
        text = self.folder.read(f"{handle}/current.json")
        return json.loads(text) if text else None

    def manifest(self, handle: str, digest: str) -> dict[str, Any] | None:
        """spec, ranges, and for each table its schema and {range: [part, rows, bytes]}."""
        text = self.folder.read(f"{handle}/manifest-{digest}.json")
        return json.loads(text) if text else None

    def publish(self, index: Index, force: bool = False, changes: Changes | None = None) -> Version:
        """A new live version, or the live one if nothing changed. A failure is recorded and leaves the live one as it is.

        One writer at a time; readers follow the pointer, which is replaced last and at once.  With `changes` against the live
        version, only the ranges of the changed objects are read and written.
        """
        with self.folder.lock(f"lock.{index.spec.handle}", self.patience):
            return self._publish(index, force, changes)

    def _publish(self, index: Index, force: bool, changes: Changes | None) -> Version:
        handle, began = index.spec.handle, time.time()
        ledger = self.versions(handle)
        number = max((v.version for v in ledger), default=0) + 1
        live = next((v for v in ledger if v.status == LIVE), None)
        staged = f"{handle}/staged-{time.time_ns()}"
        try:
            before = self.manifest(handle, live.checksum) if live is not None else None
            made, written = self._stage(index, staged, before, changes if live is not None and changes is not None and changes.since == live.checksum else None)
            parts = sorted(p for t in made["tables"].values() for p, *_ in t["parts"].values())
            digest = hashlib.sha256(json.dumps([made["spec"], made["ranges"], parts, {n: t["schema"] for n, t in made["tables"].items()}], sort_keys=True).encode()).hexdigest()[:16]
            self.folder.delete(staged)
            self.last[handle] = {"written": written, "shared": [p for p in parts if p not in set(written)], "deleted": []}
            if live is not None and live.checksum == digest and not force:
                return live
            rows = sum(n for _, n, _ in made["tables"]["records"]["parts"].values())
            size = sum(b for t in made["tables"].values() for *_, b in t["parts"].values())
            version = Version(number, LIVE, digest, rows, size, int(1000 * (time.time() - began)), files=parts, created_at=began)
            self.folder.still_held(f"lock.{handle}")
            self.folder.write(f"{handle}/manifest-{digest}.json", json.dumps(made))
            self.folder.write(f"{handle}/current.json", json.dumps({"version": number, "path": digest, "records": rows}))
        except Busy:
            self.folder.delete(staged)
            raise
        except Exception as problem:
            self.folder.delete(staged)
            self._save(handle, [*ledger, Version(number, FAILED, build_ms=int(1000 * (time.time() - began)), error=str(problem)[:500], created_at=began)])
            raise
        for v in ledger:
            v.status = SUPERSEDED if v.status == LIVE else v.status
        self._save(handle, [*ledger, version])
        self.last[handle]["deleted"] = self.prune(handle)
        return version

    def _stage(self, index: Index, staged: str, before: dict[str, Any] | None, changes: Changes | None) -> tuple[dict[str, Any], list[str]]:
        """The manifest of an index whose parts are all in place, and the names of those that weren't there before.

        If records hold the searchable texts, the postings of a range are built from its written records.
        """
        spec, handle = index.spec, index.spec.handle
        ranges = before["ranges"] if before else self.ranges
        texts = {f"x_{a.key}" for a in spec.with_role(SEARCHABLE)}
        own_texts = bool(texts) and texts <= set(index.records.columns)
        by_id = [c for a in spec.geo for c in cells(F.col(f"g_{a.key}"))] + [F.col("object_id")]  # near places are near in a part
        made: dict[str, Any] = {"spec": json.loads(json.dumps(spec.to_dict())), "ranges": ranges, "tables": {}}
        here = lambda df: df.withColumn("_range", range_of(ranges))
        written: list[str] = []
        same = before is not None and before["spec"] == made["spec"] and changes is not None and before["tables"]["records"]["schema"] == json.loads(index.records.schema.json()) and (index.postings is None or own_texts)
        if same:
            touched = here(changes.ids.select("object_id").where(F.col("object_id").isNotNull()).distinct())
            hit = sorted(r[0] for r in touched.select("_range").distinct().collect())
            old = self._read(handle, before, "records", hit).join(changes.ids.select("object_id"), "object_id", "left_anti")
            records = here(old.unionByName(changes.records.select(old.columns)))
            made["tables"]["records"] = self._put(handle, staged, "records", records, by_id, before, hit, written)
        else:
            records = here(index.records)
            hit = None
            if before is not None:  # Which ranges changed is asked first, so that equal ones aren't written.
                there = {p for p, *_ in before["tables"]["records"]["parts"].values()}
                now = part_names("records", records)
                hit = sorted(r for r in {*now, *map(int, before["tables"]["records"]["parts"])} if now.get(r, ("",))[0] not in there)
                records = records.where(F.col("_range").isin(hit))
            made["tables"]["records"] = self._put(handle, staged, "records", records, by_id, before, hit, written)
        if index.postings is not None:
            kept = before if before is not None and "postings" in before["tables"] and before["spec"] == made["spec"] else None
            if own_texts:
                again = hit if kept else None
                source = self._read(handle, made, "records", again)
                postings = here(build_postings(source, spec))
            else:
                again, postings = None, here(index.postings)
            made["tables"]["postings"] = self._put(handle, staged, "postings", postings, [F.col("token"), F.col("object_id")], kept, again, written)
        return made, written

    def _put(self, handle: str, staged: str, table: str, rows: DataFrame, order: list[Column], before: dict[str, Any] | None, hit: list[int] | None, written: list[str]) -> dict[str, Any]:
        """Writes the rows of the ranges `hit` (of all if None) in order, so that readers skip row groups; other parts are those of before."""
        schema = json.loads(rows.drop("_range").schema.json())
        parts = {r: p for r, p in before["tables"][table]["parts"].items() if int(r) not in hit} if before is not None and hit is not None else {}
        if hit != []:
            path = f"{self.folder.root}/{staged}/{table}"
            rows.repartition("_range").sortWithinPartitions("_range", *order).write.partitionBy("_range").option("compression", self.compression).parquet(path)
            there = set(self.folder.names(f"{handle}/parts"))
            found = part_names(table, self.spark.read.schema(rows.schema).parquet(path))
            for r, (name, n) in sorted(found.items()):
                if name not in there:
                    self.folder.make(f"{handle}/parts")
                    self.folder.move(f"{staged}/{table}/_range={r}", f"{handle}/parts/{name}")
                    written.append(name)
                parts[str(r)] = [name, n, self.folder.size(f"{handle}/parts/{name}")]
        return {"schema": schema, "parts": parts}

    def _read(self, handle: str, manifest: dict[str, Any], table: str, ranges: list[int] | None = None) -> DataFrame:
        own = manifest["tables"][table]
        schema = T.StructType.fromJson(own["schema"])
        paths = [f"{self.folder.root}/{handle}/parts/{p}" for r, (p, *_) in sorted(own["parts"].items()) if ranges is None or int(r) in ranges]
        return self.spark.read.schema(schema).parquet(*paths) if paths else self.spark.createDataFrame([], schema)

    def published(self, handle: str, digest: str | None = None) -> Index | None:
        """The live index, or another kept version of it; None if there is none or its files are gone."""
        pointer = self.pointer(handle)
        made = self.manifest(handle, digest or pointer["path"]) if pointer or digest else None
        if made is None or not {p for t in made["tables"].values() for p, *_ in t["parts"].values()} <= set(self.folder.names(f"{handle}/parts")):
            return None
        return Index(IndexSpec.from_dict(made["spec"]), self._read(handle, made, "records"), self._read(handle, made, "postings") if "postings" in made["tables"] else None)

    def prune(self, handle: str) -> list[str]:
        """Forgets all but the newest versions and the live one, and deletes the files that no version left refers to."""
        ledger = self.versions(handle)
        newest = sorted(ledger, key=lambda v: -v.version)[: self.keep]
        left = [v for v in ledger if v.status == LIVE or v in newest]
        used = {f for v in left for f in v.files} | {f"manifest-{v.checksum}.json" for v in left if v.checksum}
        own = lambda n: n == "parts" or n in ("current.json", "versions.json", "store.json") or n.endswith(".part")
        gone = [n for n in self.folder.names(handle) if not own(n) and n not in used]
        gone += [f"parts/{n}" for n in self.folder.names(f"{handle}/parts") if n not in used]
        self._save(handle, left)
        for name in gone:
            self.folder.delete(f"{handle}/{name}")
        return gone

    def collect_garbage(self, handles: list[str]) -> list[str]:
        """Deletes what belongs to no known index."""
        gone = [n for n in self.folder.names() if n not in handles and ".lock." not in n]
        for name in gone:
            self.folder.delete(name)
        return gone

    def delete(self, handle: str) -> None:
        self.folder.delete(handle)


def differences(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows that one of two tables has more often: the table (`side`) and the row as JSON."""
    columns = sorted(set(a.columns) & set(b.columns))
    as_json = lambda df: df.select(F.to_json(F.struct(*columns)).alias("row"))
    x, y = as_json(a), as_json(b)
    return x.exceptAll(y).select(F.lit("left").alias("side"), "row").unionByName(y.exceptAll(x).select(F.lit("right").alias("side"), "row"))
