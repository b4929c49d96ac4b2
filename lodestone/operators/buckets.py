"""The record store on disk: hash buckets of base files and a log of row images over them.

A bucket is `base` and a list of log segments.  A change writes the new images of the rows that it changes to the buckets of
these rows, nothing else; a reader takes the last image of a key, and base rows without one.  A bucket whose log has grown is
compacted.  A manifest lists what belongs to the store and is replaced at once; files that it no longer names stay for one
more change, for those who are still reading.
"""

from __future__ import annotations

import json
import time
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.operators import store as st
from lodestone.operators.publish import Folder

#: Log segments, and the log's share of the base, beyond which a bucket is compacted.
SEGMENTS, SHARE = 8, 0.5
#: Keys up to which they are also a predicate for the reader.
PUSHED = 1000
_OWN = [T.StructField("_seq", T.LongType()), T.StructField("_gone", T.BooleanType())]


class RecordStore:
    """The rows of one index by (element_id, site_id), with `dirty` and `deleted`; all writes are under the index's lock."""

    def __init__(self, spark: SparkSession, folder: Folder, handle: str, buckets: int = 16, compression: str = "zstd"):
        self.spark, self.folder, self.handle, self.buckets, self.compression = spark, folder, handle, buckets, compression

    # The manifest
    def manifest(self) -> dict[str, Any] | None:
        """buckets, schema, seq (of the last change), base {bucket: [path, bytes]}, log {bucket: [[path, bytes], ...]}, all_dirty (rows
        up to this change are dirty), dirty and gone (buckets that may hold such rows), changed {bucket: seq}, edges {bucket: [[path,
        bytes], ...]} (element_id, dep, in buckets of dep: what rows depend on or did), trash."""
        text = self.folder.read(f"{self.handle}/store.json")
        return json.loads(text) if text else None

    def _commit(self, now: dict[str, Any], dropped: list[str] | None) -> None:
        """dropped: paths that `now` no longer names; those of the commit before are deleted.  None: no files changed."""
        self.folder.still_held(f"lock.{self.handle}")
        before = now.get("trash", [])
        now["trash"] = before if dropped is None else dropped
        self.folder.write(f"{self.handle}/store.json", json.dumps(now))
        if dropped is None:
            return
        for path in before:
            self.folder.delete(path)
        logs = [*now["log"].values(), *now.get("edges", {}).values()]
        used = {p.split("/")[1] for p in [*dropped, *(p for p, _ in now["base"].values()), *(p for log in logs for p, _ in log)]}
        for name in self.folder.names(f"store.{self.handle}"):
            if name not in used:
                self.folder.delete(f"store.{self.handle}/{name}")

    def note(self, **facts: Any) -> None:
        """Keeps small facts (what was published last) with the manifest."""
        now = self.manifest()
        if now is not None:
            self._commit(now | facts, None)

    # Reading
    def _bucket(self, now: dict[str, Any]) -> Column:
        return F.pmod(F.xxhash64(F.col("element_id").cast("bigint")), F.lit(now["buckets"])).cast("int")

    def _read(self, now: dict[str, Any], paths: list[str]) -> DataFrame:
        schema = T.StructType([*T.StructType.fromJson(now["schema"]).fields, *_OWN])
        return self.spark.read.schema(schema).parquet(*[f"{self.folder.root}/{p}" for p in paths]) if paths else self.spark.createDataFrame([], schema)

    def _images(self, now: dict[str, Any], buckets: list[int] | None = None) -> DataFrame:
        """The last image of each key in some buckets (all if None), purged ones too."""
        names = [b for b in sorted({*now["base"], *now["log"]}, key=int) if buckets is None or int(b) in buckets]
        logged = [b for b in names if now["log"].get(b)]
        plain = self._read(now, [now["base"][b][0] for b in names if b in now["base"] and b not in logged])
        if not logged:
            return plain
        last = self._read(now, [p for b in logged for p, _ in now["log"][b]])
        if any(len(now["log"][b]) > 1 for b in logged):
            newest = F.row_number().over(Window.partitionBy(*st.KEY).orderBy(F.col("_seq").desc()))
            last = last.withColumn("_n", newest).where("_n = 1").drop("_n")
        base = self._read(now, [now["base"][b][0] for b in logged if b in now["base"]])
        return plain.unionByName(base.join(last.select(*st.KEY), st.KEY, "left_anti")).unionByName(last)

    def _rows(self, now: dict[str, Any], buckets: list[int] | None = None) -> DataFrame:
        rows = self._images(now, buckets).where(~F.col("_gone"))
        old = F.col("_seq") <= now["all_dirty"]
        return rows.withColumn("dirty", (F.col("dirty") | old) & ~F.col("deleted"))

    def current(self, buckets: list[int] | None = None) -> DataFrame | None:
        """All rows as they are; None if nothing was ever stored."""
        now = self.manifest()
        return None if now is None else self._rows(now, buckets).drop("_seq", "_gone")

    def dirty_rows(self) -> DataFrame:
        """Rows to build again; only buckets that may hold some are read."""
        now = self.manifest()
        return self._rows(now, None if now["all_dirty"] else now["dirty"]).drop("_seq", "_gone").where(F.col("dirty") & ~F.col("deleted"))

    def dirty_keys(self) -> DataFrame:
        return self.dirty_rows().select(*st.KEY)

    def changed_since(self, seq: int) -> DataFrame:
        """Rows whose image is later than a change, deleted ones too; only buckets that were written since are read."""
        now = self.manifest()
        return self._rows(now, [int(b) for b, s in now["changed"].items() if s > seq]).where(F.col("_seq") > seq).drop("_seq", "_gone")

    # Writing
    def _write(self, now: dict[str, Any], rows: DataFrame) -> dict[str, list]:
        """{bucket: [path, bytes]} of what was written."""
        return self._dealt(rows.withColumn("_bucket", self._bucket(now)).repartition("_bucket").sortWithinPartitions("_bucket", *st.KEY))

    def _dealt(self, rows: DataFrame) -> dict[str, list]:
        name = f"store.{self.handle}/{time.time_ns()}"
        rows.write.partitionBy("_bucket").option("compression", self.compression).parquet(f"{self.folder.root}/{name}")
        found = [n for n in self.folder.names(name) if n.startswith("_bucket=")]
        return {n.split("=")[1]: [f"{name}/{n}", self.folder.size(f"{name}/{n}")] for n in found}

    def _write_edges(self, now: dict[str, Any], images: DataFrame) -> None:
        """Adds what these images depend on to the index of dependencies, in which an edge stays until its bucket is rewritten."""
        if "_deps" not in images.columns:
            return
        bucket = F.pmod(F.xxhash64("dep"), F.lit(now["buckets"])).cast("int")
        edges = images.select("element_id", F.explode("_deps").alias("dep")).distinct().withColumn("_bucket", bucket)
        # An element that much depends on is written by several tasks.
        made = self._dealt(edges.repartition("_bucket", F.pmod(F.xxhash64("element_id"), F.lit(8))).sortWithinPartitions("_bucket", "dep"))
        for b, segment in made.items():
            now.setdefault("edges", {}).setdefault(b, []).append(segment)

    def dependents(self, changed: DataFrame) -> DataFrame | None:
        """element_id of the rows that were built from any of the changed elements; None if rows don't say what they are built from.

        Edges of the buckets of these elements give candidates, the rows' own lists decide.
        """
        now = self.manifest()
        if now is None or "_deps" not in {f["name"] for f in now["schema"]["fields"]}:
            return None
        ids = changed.select(F.col("element_id").cast("bigint").alias("dep")).distinct()
        hit = [str(r[0]) for r in ids.select(F.pmod(F.xxhash64("dep"), F.lit(now["buckets"])).alias("b")).distinct().collect()]
        paths = [f"{self.folder.root}/{p}" for b in hit for p, _ in now.get("edges", {}).get(b, [])]
        edges = self.spark.read.schema("element_id bigint, dep bigint").parquet(*paths) if paths else self.spark.createDataFrame([], "element_id bigint, dep bigint")
        found = edges.join(ids, "dep", "left_semi").distinct()
        some = sorted(r[0] for r in found.select(self._bucket(now).alias("b")).distinct().collect())
        rows = self._rows(now, some).select("element_id", "_deps")
        return rows.join(found, "element_id").where(F.array_contains("_deps", F.col("dep"))).select("element_id").distinct()

    def replace(self, rows: DataFrame) -> DataFrame:
        """Takes `rows` (each key once, with dirty and deleted) as the whole store."""
        now = self.manifest()
        seq = now["seq"] + 1 if now else 1
        fresh: dict[str, Any] = {"buckets": self.buckets, "schema": json.loads(rows.schema.json()), "seq": seq, "all_dirty": 0, "log": {}}
        fresh["base"] = self._write(fresh, rows.withColumn("_seq", F.lit(seq).cast("long")).withColumn("_gone", F.lit(False)))
        self._write_edges(fresh, self._read(fresh, [p for p, _ in fresh["base"].values()]))
        fresh |= {"dirty": [int(b) for b in fresh["base"]], "gone": [int(b) for b in fresh["base"]], "changed": dict.fromkeys(fresh["base"], seq)}
        dropped = [p for p, _ in now["base"].values()] + [p for log in (*now["log"].values(), *now.get("edges", {}).values()) for p, _ in log] if now else []
        if now and "trash" in now:
            fresh["trash"] = now["trash"]
        self._commit(fresh, dropped)
        return self.current()

    def append(self, images: DataFrame, built: bool = False) -> list[int]:
        """Writes new images of rows (each key once; `_gone` for purged ones); returns the buckets that were written.

        built: the images answer all dirty rows of the store, so that only they can be dirty from now on.
        """
        now = self.manifest()
        now = self._fitting(now, images)
        seq = now["seq"] + 1
        schema = T.StructType.fromJson(now["schema"])
        gone = F.col("_gone") if "_gone" in images.columns else F.lit(False)
        columns = [F.col(f.name) if f.name in images.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in schema.fields]
        written = self._write(now, images.select(*columns, F.lit(seq).cast("long").alias("_seq"), gone.alias("_gone")))
        if not written and not built:
            return []
        if built and written:
            self._write_edges(now, self._read(now, [p for p, _ in written.values()]))
        for b, segment in written.items():
            now["log"].setdefault(b, []).append(segment)
            now["changed"][b] = seq
        hit = sorted(map(int, written))
        now["dirty"] = hit if built else sorted({*now["dirty"], *hit})
        now["all_dirty"] = 0 if built else now["all_dirty"]
        now["gone"] = sorted({*now["gone"], *hit})
        now["seq"] = seq
        self._commit(now, self._compacted(now, [b for b in written if self._grown(now, b)]))
        return hit

    def _grown(self, now: dict[str, Any], bucket: str) -> bool:
        log = now["log"].get(bucket, [])
        return len(log) > SEGMENTS or sum(n for _, n in log) > SHARE * now["base"].get(bucket, [None, 0])[1] and len(log) > 1

    def _compacted(self, now: dict[str, Any], buckets: list[str]) -> list[str]:
        """Makes the last images of some buckets their base; the paths that are dropped by that."""
        if not buckets:
            return []
        made = self._write(now, self._images(now, list(map(int, buckets))).where(~F.col("_gone")))
        dropped = [p for b in buckets for p, _ in [now["base"].get(b, [None, 0]), *now["log"].get(b, [])] if p]
        for b in buckets:
            now["log"].pop(b, None)
            now["base"].pop(b, None)
        now["base"] |= made
        return dropped

    def _fitting(self, now: dict[str, Any], rows: DataFrame) -> dict[str, Any]:
        """The manifest with the columns of `rows`; a column of another type now starts anew, as its values can't be kept."""
        fields = {f.name: f for f in T.StructType.fromJson(now["schema"]).fields}
        theirs = [T.StructField(f.name, f.dataType) for f in rows.schema.fields if f.name != "_gone"]
        clash = [f.name for f in theirs if f.name in fields and fields[f.name].dataType.simpleString() != f.dataType.simpleString()]
        if clash:
            kept = self._images(now).drop(*clash)
            dropped = [p for p, _ in now["base"].values()] + [p for log in now["log"].values() for p, _ in log]
            base = self._write(now, kept)
            fields = {n: f for n, f in fields.items() if n not in clash}
            now |= {"base": base, "log": {}, "schema": json.loads(T.StructType(list(fields.values())).json())}
            self._commit(now, dropped)
        merged = [*fields.values(), *(f for f in theirs if f.name not in fields)]
        return now | {"schema": json.loads(T.StructType(merged).json())}

    def mark_all_dirty(self) -> None:
        """A note in the manifest; no row is written."""
        now = self.manifest()
        if now is not None:
            now |= {"seq": now["seq"] + 1, "all_dirty": now["seq"]}
            self._commit(now, None)

    def change(self, saved: DataFrame | None = None, dependents: DataFrame | None = None, deleted: DataFrame | None = None, covered: DataFrame | None = None) -> list[int]:
        """Saved keys are touched (unknown ones get a stub, if among `covered`), dependents marked, deleted keys marked deleted.

        Returns the buckets that were written.

        Only the buckets of these elements are read, and only rows whose marks change are written.
        """
        now = self.manifest()
        given = [d.select("element_id") for d in (saved, dependents, deleted) if d is not None]
        if now is None or not given:
            return []
        elements = given[0]
        for d in given[1:]:
            elements = elements.unionByName(d)
        elements = elements.distinct()
        hit = sorted(r[0] for r in elements.select(self._bucket(now).alias("b")).distinct().collect())
        rows = self._rows(now, hit).drop("_seq", "_gone").join(elements, "element_id", "left_semi").withColumn("_was", F.struct("dirty", "deleted"))
        if saved is not None:
            rows = st.touch(rows, saved)
            if covered is not None:
                stub = F.col("_was").isNull()
                rows = rows.where(~stub).unionByName(rows.where(stub).join(covered, [k for k in st.KEY if k in covered.columns], "left_semi"))
        if dependents is not None:
            rows = st.mark_dirty(rows, dependents)
        if deleted is not None:
            rows = st.mark_deleted(rows, deleted)
        return self.append(rows.where(~F.col("_was").eqNullSafe(F.struct("dirty", "deleted"))).drop("_was"))

    def purge(self) -> list[int]:
        """Deleted rows go; only buckets that may hold some are read."""
        now = self.manifest()
        written = self.append(self._rows(now, now["gone"]).drop("_seq").where("deleted").withColumn("_gone", F.lit(True)))
        now = self.manifest()
        if now["gone"]:
            self._commit(now | {"gone": []}, None)
        return written


def by_keys(table: DataFrame, keys: DataFrame, on: list[str]) -> DataFrame:
    """Rows of some keys; few of them are also a predicate on the element, which reaches the reader."""
    few = keys.select("element_id").distinct().limit(PUSHED + 1).collect()
    if len(few) <= PUSHED:
        table = table.where(F.col("element_id").isin([r[0] for r in few]))
    return table.join(keys.select(*on).distinct(), on, "left_semi")
