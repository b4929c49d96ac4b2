"""Change events to index updates, as Structured Streaming.

The first event of an element sets a timer, events that come until it fires are the same burst, and elements whose timers fire in
one micro-batch become one update.  The checkpoint remembers events taken, open bursts and timers, so an event that comes while a
batch runs opens the next burst and a restart loses none; upserts are by key, so a batch that is run again changes nothing.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle, StreamingQuery

from lodestone.plans.engine import Engine

#: Keeps open bursts and their timers on disk, so that their number is not bound by memory; timers need it.
STATE_STORE = ("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
#: Seconds between looks at the timers, at most; a burst ends that much after its delay at the latest.
LOOK = 5
#: Operations of events, and those that remove.
SAVES, DELETES = ("save", "propagate", "restore", "slug", "move"), ("delete",)


def relevant(events: DataFrame) -> DataFrame:
    """Events of known operations on elements that aren't drafts or revisions."""
    out = events.where(F.col("op").isin(*SAVES, *DELETES) & F.col("element_id").isNotNull())
    for name in ("draft_id", "revision_id"):
        if name in events.columns:
            out = out.where(F.col(name).isNull())
    return out


def latest(events: DataFrame) -> DataFrame:
    """The last event of each key."""
    last = F.row_number().over(Window.partitionBy("element_id", "site_id").orderBy(F.col("ts").desc(), (F.col("op") == "delete").desc()))
    return events.withColumn("_n", last).where("_n = 1").drop("_n")


def apply_changes(engine: Engine, handles: list[str], events: DataFrame, rebuild: bool = True) -> None:
    """One update: takes up the keys and their dependents, then rebuilds and publishes each index that they concern once.

    Nothing is done while updates are off.
    """
    if not engine.config.auto_update:
        return
    last = latest(relevant(events)).persist()
    try:
        if last.isEmpty():
            return
        saved, deleted = last.where(F.col("op").isin(*SAVES)), last.where(F.col("op").isin(*DELETES))
        for handle in handles:
            engine.changed(handle, saved.select("element_id", "site_id"), deleted.select("element_id", "site_id"))
            if rebuild and engine.pending(handle):
                engine.rebuild(handle)
    finally:
        last.unpersist()


class _Burst(StatefulProcessor):
    """One open burst a key: its number of events and the last of them. Its timer is set by the first event and never moved."""

    def __init__(self, delay: int):
        self.delay = delay

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.open = handle.getValueState("open", T.StructType([T.StructField("events", T.LongType()), T.StructField("last", T.TimestampType()), T.StructField("op", T.StringType())]))

    def handleInputRows(self, key: tuple, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self.open.get() if self.open.exists() else None
        events, last, op = held if held is not None else (0, None, None)
        for batch in rows:
            events += len(batch)
            for ts, name in zip(batch["ts"], batch["op"]):  # of one time, a deletion is the last
                ts = None if pd.isna(ts) else ts.to_pydatetime()
                if op is None or (ts is not None and (last is None or ts > last)) or (ts == last and name in DELETES):
                    last, op = ts, name
        if held is None:
            self.handle.registerTimer(timerValues.getCurrentProcessingTimeInMs() + 1000 * self.delay)
        self.open.update((events, last, op))
        yield from ()

    def handleExpiredTimer(self, key: tuple, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        events, last, op = self.open.get()
        self.open.clear()
        yield pd.DataFrame({"element_id": [key[0]], "site_id": [key[1]], "op": [op], "ts": [last], "events": [events]})

    def close(self) -> None:
        pass


def due(events: DataFrame, delay: int) -> DataFrame:
    """Of a stream of element_id, site_id, op, ts: one row for each burst of an element, `delay` seconds after its first event arrived.

    op and ts are those of the burst's last event, `events` counts them. An event that arrives later opens the next burst. Elements are
    dealt by key, state is one row for each open burst. A site of null is site 1, as in tables without sites; a time of null is before all others.
    """
    kept = events.select("element_id", F.coalesce("site_id", F.lit(1)).cast("int").alias("site_id"), "op", F.col("ts").cast("timestamp").alias("ts"))
    row = T.StructType([kept.schema["element_id"], *T.StructType.fromDDL("site_id int, op string, ts timestamp, events bigint").fields])
    return kept.groupBy("element_id", "site_id").transformWithStateInPandas(_Burst(delay), row, "Append", "ProcessingTime")


def keep_updated(engine: Engine, events: DataFrame, handles: list[str], checkpoint: str, once: bool = False, debounce: int | None = None) -> StreamingQuery:
    """Starts the updater over a stream of element_id, site_id, op, ts; one query per set of indexes is the only writer.

    debounce: seconds from an element's first event to the update that takes it up; 0 takes up events as they come.
    once: take up what is there as one deferred pass and stop (the end of a bulk operation); no timers, so a checkpoint of its own.
    """
    seconds = debounce if debounce is not None else min(engine.spec(h).publish_debounce for h in handles)
    timed = not once and seconds > 0
    rows = due(relevant(events), seconds) if timed else events
    writer = rows.writeStream.foreachBatch(lambda batch, _: apply_changes(engine, handles, batch)).option("checkpointLocation", checkpoint)
    writer = writer.trigger(availableNow=True) if once else writer.trigger(processingTime=f"{max(1, min(seconds, LOOK))} seconds")
    if not timed:
        return writer.start()
    name, provider = STATE_STORE
    before = engine.spark.conf.get(name, None)
    engine.spark.conf.set(name, provider)  # a query keeps the settings that it was started with
    try:
        return writer.start()
    finally:
        engine.spark.conf.unset(name) if before is None else engine.spark.conf.set(name, before)


def bursts(events: DataFrame, key: str, time: str, delay: int) -> DataFrame:
    """key, start, events, last of the bursts of a table: each starts with the first event that is `delay` seconds or more after the last start.

    What `due` gives for a stream whose events arrive at their times. Equal times of a key are counted before they are dealt, and a key's
    times go by in order, a batch at a time: no key is held as a whole. Where a burst ends depends on the one before, so a key is
    one task's. Events without a time are in no burst; a key of null is a key.
    """
    times = events.where(F.col(time).isNotNull()).groupBy(F.col(key), F.unix_micros(F.col(time).cast("timestamp")).alias("_t")).agg(F.count(F.lit(1)).alias("_n"))
    columns = T.StructType([T.StructField(key, events.schema[key].dataType), *T.StructType.fromDDL("_start bigint, _n bigint, _last bigint").fields])
    step = 1_000_000 * delay

    def cut(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = None  # key, start, events, last of the open burst
        for batch in batches:
            done = []
            t, n, own = batch["_t"].to_numpy(), batch["_n"].to_numpy(), batch[key].astype(object)
            own = own.where(own.notna(), None)
            edges = np.flatnonzero([True, *(a != b for a, b in zip(own.iloc[1:], own.iloc[:-1]))]) if len(batch) else []
            for first, end in zip(edges, [*edges[1:], len(batch)]):
                place, who = first, own.iloc[first]
                if held is not None and held[0] != who:
                    done.append(held)
                    held = None
                while place < end:
                    if held is not None and t[place] >= held[1] + step:
                        done.append(held)
                        held = None
                    start = t[place] if held is None else held[1]
                    until = place + int(np.searchsorted(t[place:end], start + step))
                    held = (who, start, int(n[place:until].sum()) + (0 if held is None else held[2]), t[until - 1])
                    place = until
            yield pd.DataFrame(done, columns=columns.names)
        if held is not None:
            yield pd.DataFrame([held], columns=columns.names)

    found = times.repartition(F.col(key)).sortWithinPartitions(key, "_t").mapInPandas(cut, columns)
    return found.select(key, F.timestamp_micros("_start").alias("start"), F.col("_n").alias("events"), F.timestamp_micros("_last").alias("last"))


def debounced(events: DataFrame, key: str = "element_id", time: str = "ts", delay: str = "30 seconds", late: str = "5 minutes") -> DataFrame:
    """Events per clock window and key. On a stream, state is dropped `late` behind the newest event."""
    if events.isStreaming:
        events = events.withWatermark(time, late)
    return events.groupBy(F.window(time, delay).alias("window"), F.col(key)).agg(F.count(F.lit(1)).alias("events"), F.max(time).alias("last"))


def deduplicated(events: DataFrame, keys: list[str], time: str = "ts", late: str = "5 minutes") -> DataFrame:
    """One event per key within the lateness."""
    if events.isStreaming:
        return events.withWatermark(time, late).dropDuplicatesWithinWatermark(keys)
    return events.dropDuplicates(keys)
