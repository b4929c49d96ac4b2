"""An engine over element tables: build, publish, update, query, inspect."""

from __future__ import annotations

import json
from collections.abc import Callable
from typing import Any

from py4j.protocol import Py4JJavaError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.operators import store as st
from lodestone.operators.buckets import RecordStore, by_keys
from lodestone.operators.compile import Index, build_postings, compile_records, object_id
from lodestone.operators.publish import Changes, Folder, Publisher, Version, differences
from lodestone.operators.relations import related
from lodestone.operators.search import SearchResult, search
from lodestone.plans.response import response, to_json
from lodestone.sources.registry import scan
from lodestone.spec import EngineConfig, IndexSpec, SpecError
from lodestone.state import QueryState, parse

Tables = Callable[[], dict[str, DataFrame]]

#: Elements that make Spark raise and that a build searches for and leaves out; with more of them it fails.  Also how many `errors` shows.
MOST_FAILING = 100
#: Parts that a failing set of elements is split into.
SPLIT = 16


class NotPublished(LookupError):
    pass


class Engine:
    """tables: a function that gives the element tables by kind as they are now; deps: element_id, dep_element_id.

    errors: per index, elements that its last build left out, with the reason; `failures` has all that were set aside.  folder: a store for what is published.
    """

    def __init__(self, spark: SparkSession, tables: Tables, config: EngineConfig, deps: Callable[[], DataFrame] | None = None, folder: Folder | None = None):
        self.spark, self.tables, self.config, self.deps = spark, tables, config, deps
        self.publisher = Publisher(spark, config.publish_path, config.keep_versions, config.compression, folder=folder, ranges=config.ranges)
        self.errors: dict[str, dict[str, str]] = {}
        self._specs: dict[str, IndexSpec] = {}

    # Definitions
    def save(self, spec: IndexSpec) -> IndexSpec:
        """Adds or changes a definition; a changed one marks all its rows dirty."""
        spec.validated()
        changed = spec.handle in self._specs and self._specs[spec.handle] != spec
        self._specs[spec.handle] = spec
        if changed:
            with self._writing(spec.handle):
                self.store(spec.handle).mark_all_dirty()
        return spec

    def create(self, spec: IndexSpec) -> IndexSpec:
        if spec.handle in self._specs:
            raise SpecError([f"index {spec.handle!r}: the handle is taken"])
        return self.save(spec)

    def spec(self, handle: str) -> IndexSpec:
        if handle not in self._specs:
            raise KeyError(f"no index {handle!r}")
        return self._specs[handle]

    def delete(self, handle: str) -> None:
        with self._writing(handle):
            self._specs.pop(handle, None)
            self.publisher.delete(handle)
            self.publisher.folder.delete(f"store.{handle}")

    def count(self, handle: str) -> int:
        """Elements that a full build would take."""
        return scan(self.tables(), self.spec(handle)).count()

    def prune(self, handle: str) -> list[str]:
        """Deletes the files of versions beyond those kept."""
        with self._writing(handle):
            return self.publisher.prune(handle)

    # The store
    def store(self, handle: str) -> RecordStore:
        return RecordStore(self.spark, self.publisher.folder, handle, self.config.buckets, self.config.compression)

    def _store(self, handle: str) -> DataFrame | None:
        return self.store(handle).current()

    def _writing(self, handle: str):
        """Held while a store or a version is read, changed and written."""
        return self.publisher.folder.lock(f"lock.{handle}", self.publisher.patience)

    # Builds
    def build(self, handle: str, full: bool = False) -> DataFrame:
        """The store after a full scan, or after taking up dirty rows alone; one writer at a time.

        Elements that fail are left out, their records stay as they were, and dirty.  Those that their rows or extractors tell of are
        set aside in the same pass, however many (see `failures`); those that make Spark raise are searched for.
        """
        with self._writing(handle):
            return self._build(handle, full)

    def failures(self, handle: str) -> DataFrame:
        """element_id, site_id, _error of the elements that the last builds set aside."""
        now = self._store(handle)
        if now is None or "_error" not in now.columns:
            return self.spark.createDataFrame([], "element_id bigint, site_id int, _error string")
        return now.where(F.col("_error").isNotNull() & ~F.col("deleted")).select(*st.KEY, "_error")

    @staticmethod
    def _apart(rows: DataFrame, old: DataFrame | None) -> DataFrame:
        """Rows with `_errors` get the content that they had (none, if they are new), are dirty, and say why: one join, one scan."""
        content = [c for c in rows.columns if c not in (*st.KEY, "_errors")]
        bad = F.size("_errors") > 0
        kept = {c: F.lit(None).cast(rows.schema[c].dataType) for c in content}
        if old is not None:
            had = [c for c in content if c in old.columns and old.schema[c].dataType == rows.schema[c].dataType]
            old = old.select(*[F.col(k).alias(f"_old_{k}") for k in st.KEY], *[F.col(c).alias(f"_old_{c}") for c in had])
            rows = rows.join(old, (F.col("element_id") == F.col("_old_element_id")) & (F.col("site_id") == F.col("_old_site_id")) & bad, "left")
            kept |= {c: F.col(f"_old_{c}") for c in had}
        why = F.when(bad, F.array_join("_errors", "; ")).alias("_error")
        return rows.select(*st.KEY, *[F.when(bad, kept[c]).otherwise(F.col(c)).alias(c) for c in content], why, bad.alias("dirty"), F.lit(False).alias("deleted"))

    def _build(self, handle: str, full: bool) -> DataFrame:
        spec, store = self.spec(handle), self.store(handle)
        covered, now = scan(self.tables(), spec), store.current()
        full = full or now is None
        if not full:
            covered = by_keys(covered, store.dirty_keys(), [k for k in st.KEY if k in covered.columns])

        def save(failing: list[str]) -> None:
            own = F.concat_ws("-", F.col("element_id").cast("string"), F.col("site_id").cast("string")).isin(failing) if failing else F.lit(False)
            taken = covered.where(~F.coalesce(object_id(covered)[0].isin(failing), F.lit(False))) if failing else covered
            rows = self._records(taken, spec).dropDuplicates(st.KEY)
            if "_errors" in rows.columns:
                rows = self._apart(rows, now)
            else:
                rows = rows.withColumn("dirty", F.lit(False)).withColumn("deleted", F.lit(False))
            if full:
                store.replace(rows.unionByName(now.where(own).withColumn("dirty", F.lit(True)), allowMissingColumns=True).select(rows.columns) if failing and now is not None else rows)
                return
            old = store.dirty_rows()
            gone = old.where(~own).join(rows.select(*st.KEY), st.KEY, "left_anti").withColumn("dirty", F.lit(False)).withColumn("deleted", F.lit(True))
            images = rows.unionByName(gone, allowMissingColumns=True)
            store.append(images.unionByName(old.where(own), allowMissingColumns=True) if failing else images, built=True)

        self.errors[handle] = {}
        try:
            save([])
        except (PySparkException, Py4JJavaError):
            self.errors[handle] = self._failing(covered, spec)
            if not self.errors[handle]:
                raise
            save(sorted(self.errors[handle]))
        if "_error" in (now := store.current()).columns:
            some = self.failures(handle).limit(MOST_FAILING).collect()
            self.errors[handle] |= {f"{r.element_id}-{r.site_id}": r["_error"] for r in some}
        return now

    def _records(self, taken: DataFrame, spec: IndexSpec) -> DataFrame:
        """Records of elements, with the elements that their paths lead to; `_deps` are those."""
        return compile_records(related(taken, spec, self.tables()) if spec.relations else taken, spec)

    def _failing(self, covered: DataFrame, spec: IndexSpec) -> dict[str, str]:
        """The elements whose records can't be built: failing sets are split by hash until one element is left."""
        own, found, todo = object_id(covered)[0], {}, [(0, covered)]
        while todo:
            level, part = todo.pop()
            try:
                self._records(part, spec).write.format("noop").mode("overwrite").save()
            except (PySparkException, Py4JJavaError) as error:
                ids = [r[0] for r in part.select(own).distinct().limit(2).collect()]
                if len(ids) == 1 and ids[0] is not None:
                    found[ids[0]] = str(error).split("\n", 1)[0]
                elif level == 64 or len(found) == MOST_FAILING:
                    raise
                else:
                    todo += [(level + 1, part.where(F.pmod(F.xxhash64(own, F.lit(level)), F.lit(SPLIT)) == n)) for n in range(SPLIT)]
        return found

    def publish(self, handle: str, force: bool = False) -> Version:
        """Compiles what is stored and publishes it; deleted rows are purged afterwards."""
        with self._writing(handle):
            return self._publish(handle, force)

    def _publish(self, handle: str, force: bool) -> Version:
        spec, store = self.spec(handle), self.store(handle)
        if store.manifest() is None:
            self.build(handle)
        now = store.manifest()
        alive = lambda rows: st.stream(rows).drop("dirty", "deleted", "_deps", "_error")
        records = alive(store.current())
        last, changes = now.get("published"), None
        if last is not None:
            changed = store.changed_since(last["seq"])
            changes = Changes(last["digest"], changed.select("object_id").where(F.col("object_id").isNotNull()), alive(changed))
        made = self.publisher.publish(Index(spec, records, build_postings(records, spec) if any(c.startswith("x_") for c in records.columns) else None), force, changes)
        store.purge()
        store.note(published={"digest": made.checksum, "seq": store.manifest()["seq"]})
        return made

    def rebuild(self, handle: str, full: bool = False) -> Version:
        """A full rebuild marks everything dirty first, so that one that fails is taken up again."""
        with self._writing(handle):
            if full:
                self.store(handle).mark_all_dirty()
            self.build(handle, full)
            return self.publish(handle)

    # Changes
    def changed(self, handle: str, saved: DataFrame | None = None, deleted: DataFrame | None = None) -> list[int]:
        """Takes up saved and deleted keys (element_id, site_id) and everything built from them; nothing is rebuilt yet.

        Returns the buckets of the store that were written: none if the changes are no matter of this index.
        """
        with self._writing(handle):
            return self._changed(handle, saved, deleted)

    def _changed(self, handle: str, saved: DataFrame | None, deleted: DataFrame | None) -> list[int]:
        store = self.store(handle)
        if store.manifest() is None:
            return []
        covered = dependents = None
        if saved is not None:
            taken = scan(self.tables(), self.spec(handle))
            covered = by_keys(taken, saved, on := [k for k in st.KEY if k in taken.columns]).select(*on)
        for c in (c for c in (saved, deleted) if c is not None):
            for found in (store.dependents(c), st.dependents(self.deps(), c) if self.deps is not None else None):
                if found is not None:
                    dependents = found if dependents is None else dependents.unionByName(found)
        return store.change(saved, dependents, deleted, covered)

    def pending(self, handle: str) -> bool:
        """Whether the store has changes that were not published."""
        now = self.store(handle).manifest()
        return now is None or now.get("published", {"seq": 0})["seq"] < now["seq"]

    # Queries
    def index(self, handle: str, strict: bool = True) -> Index:
        """The published index; without one an error, or an empty index if not `strict`."""
        found = self.publisher.published(handle)
        if found is not None:
            return found
        if strict:
            raise NotPublished(handle)
        spec = self.spec(handle)
        records = self._records(scan(self.tables(), spec), spec).drop("_deps", "_errors").limit(0)
        return Index(spec, records, build_postings(records, spec))

    def search(self, handle: str, state: QueryState | dict | None = None, strict: bool = True) -> SearchResult:
        return search(self.index(handle, strict), state)

    def search_url(self, handle: str, address: str, prefix: str = "") -> SearchResult:
        index = self.index(handle)
        return search(index, parse(address, index.spec, prefix))

    def search_json(self, handle: str, state: str | dict) -> str:
        """The query playground and the JSON endpoint; only for indexes whose transport allows it."""
        index = self.index(handle)
        if index.spec.transport != "json":
            raise PermissionError(f"index {handle!r} has no JSON endpoint")
        return to_json(search(index, json.loads(state) if isinstance(state, str) else state))

    def response(self, handle: str, state: dict | None = None) -> dict[str, Any]:
        return response(self.search(handle, state))

    # Inspection
    def preview(self, handle: str, object_id: str) -> dict[str, Any]:
        """One record as it would be built now, with its tokens and the elements it is built from."""
        spec = self.spec(handle)
        rows = scan(self.tables(), spec, "any")
        element = object_id.rpartition("-")[0]
        if "object_id" not in rows.columns and element.lstrip("-").isdigit():  # a predicate that reaches the reader
            rows = rows.where(F.col("element_id") == int(element))
        records = self._records(rows, spec).where(F.col("object_id") == object_id)
        row = records.first()
        if row is None:
            raise KeyError(object_id)
        tokens = build_postings(records, spec).select("token", "weight").orderBy("token").collect()
        used = self.deps().where(F.col("element_id") == row["element_id"]).select("dep_element_id").distinct().collect() if self.deps and "element_id" in records.columns else []
        built_from = {d[0] for d in used if d[0] is not None} | set(row.asDict().pop("_deps", None) or [])
        return {"record": {k: v for k, v in row.asDict(recursive=True).items() if k not in ("_deps", "_errors")}, "tokens": {t.token: t.weight for t in tokens}, "dependencies": sorted(built_from)}

    def status(self, handle: str) -> dict[str, Any]:
        now, pointer = self._store(handle), self.publisher.pointer(handle)
        counts = st.counts(now).first().asDict() if now is not None else {"records": 0, "dirty": 0, "deleted": 0}
        return {"handle": handle, **counts, "published": pointer, "versions": self.publisher.versions(handle), "errors": self.errors.get(handle, {})}

    def verify(self, handle: str) -> DataFrame:
        """Differences between the published records and a fresh build; empty if they agree."""
        spec = self.spec(handle)
        built = self._records(scan(self.tables(), spec), spec)
        return differences(self.index(handle).records, built.where("size(_errors) = 0") if "_errors" in built.columns else built)

    def collect_garbage(self) -> list[str]:
        keep = list(self._specs)
        return self.publisher.collect_garbage([*keep, *(f"store.{h}" for h in keep)])
