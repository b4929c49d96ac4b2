"""WARC archives with revisit records, and their index merged externally from sorted capture runs.

Writing: a task writes one archive (a gzip member per record) and, for every `RUN` records, a capture run: the index
lines of these records sorted by URL key and timestamp.
Merging: while there are more runs than `FAN_IN`, groups of them are merged into longer runs; then the key space is
cut into ranges at sampled captures (whole index lines, so the captures of one URL can be many ranges), and a task merges
the slices of all runs in its range with a loser tree.  The ranges in order are the global index: all captures of a URL, by time.
Reading: records are fetched by archive and offset, parsed, and their payloads hashed again.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import json
import re
import zlib
from collections.abc import Iterable, Iterator
from datetime import datetime, timedelta, timezone

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import by_bytes, saved, scratch, small_batches
from lodestone.llm.files import create, reopen

RUN, FAN_IN, SAMPLES = 20_000, 256, 16
#: Bytes of a run that are read at once.
CHUNK = 1 << 16
#: Captures without a time are dated this many seconds by page_id after this day.
FIRST_DAY = datetime(2024, 1, 1, tzinfo=timezone.utc)

_ENTRY = "key string, time string, page_id long, archive string, offset long, length long"
_MANIFEST = "archive string, run string, entries long, samples array<string>"


def url_key(url: str | None) -> str:
    """Sort-friendly key: reversed host labels without `www`, then path and query, lower-cased, without fragment."""
    if not url:
        return "-"
    url = re.sub(r"^[a-z][a-z0-9+.-]*://", "", url.strip().lower()).split("#")[0]
    host, slash, path = url.partition("/")
    host = re.sub(r"^www\d*\.", "", host.rpartition("@")[2])
    name, _, port = host.partition(":")
    port = "" if port in ("", "80", "443") else f":{port}"
    return ",".join(reversed(name.split("."))) + port + ")/" + path if slash else ",".join(reversed(name.split("."))) + port + ")/"


def digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode()


class LoserTree:
    """Merges sorted iterators: each step replays one leaf's path, one comparison a level."""

    def __init__(self, sources: list[Iterator]):
        self.sources = sources
        self.k = max(1, len(sources))
        self.heads = [next(s, None) for s in sources] or [None]
        self.losers = [-1] * self.k
        for leaf in range(self.k):
            self._replay(leaf)

    def _less(self, a: int, b: int) -> bool:
        """Whether leaf `a` wins; -1 wins while the tree is filled, exhausted leaves lose, ties go to the lower leaf."""
        if a < 0 or b < 0:
            return a < 0
        x, y = self.heads[a], self.heads[b]
        return y is None and (x is not None or a < b) or x is not None and y is not None and (x, a) < (y, b)

    def _replay(self, leaf: int) -> None:
        winner, node = leaf, (leaf + self.k) // 2
        while node > 0:
            if self._less(self.losers[node], winner):
                self.losers[node], winner = winner, self.losers[node]
            node //= 2
        self.losers[0] = winner

    def __iter__(self) -> Iterator:
        while self.heads[self.losers[0]] is not None:
            leaf = self.losers[0]
            yield self.heads[leaf]
            self.heads[leaf] = next(self.sources[leaf], None)
            self._replay(leaf)


# Capture runs: JSON lines, sorted.
def write_run(folder: str, entries: Iterable[list]) -> tuple[str, int, list[str]]:
    """(name, number of entries, at most twice `SAMPLES` of them, evenly spaced); holds no more than these."""
    name, sink = create(folder, ".run")
    n, step, some = 0, 1, []
    for entry in entries:
        line = json.dumps(entry)
        if n % step == 0:
            some.append(line)
            if len(some) > 2 * SAMPLES:
                some, step = some[::2], 2 * step
        sink.write(line.encode() + b"\n")
        n += 1
    sink.close()
    return name, n, list(dict.fromkeys(some))


def _line_from(source, at: int, end: int) -> tuple[int, bytes]:
    """(start, line) of the first line that starts at `at` or later; (end, b"") if there is none."""
    start, held = at, b""
    if at:  # the line before ends at `at` or later
        source.seek(at - 1)
        place = at - 1
        while place < end and (cut := (held := source.read(min(CHUNK, end - place))).find(b"\n")) < 0:
            place += len(held)
        if place >= end:
            return end, b""
        start, held = place + cut + 1, held[cut + 1 :]
    parts, place = [held], start + len(held)
    source.seek(place)
    while b"\n" not in parts[-1] and place < end:
        parts.append(source.read(min(CHUNK, end - place)))
        place += len(parts[-1])
    return (start, b"".join(parts).split(b"\n", 1)[0]) if start < end else (end, b"")


def _place_of(source, end: int, low: list) -> int:
    """The start of a line, not far before the first one that isn't below `low`: found by halves, so no index is held."""
    a, b = 0, end  # lines that start before a are below; one that starts at b or later isn't, if there is one
    while b - a > CHUNK:
        middle = (a + b) // 2
        start, line = _line_from(source, middle, end)
        if start < b and json.loads(line) < low:
            a = start + len(line) + 1
        else:
            b = middle
    return a


def read_run(folder: str, name: str, low: list | None = None, high: list | None = None) -> Iterator[list]:
    """Entries with low <= entry < high; a bound may be the first fields of an entry.  Holds one chunk of the run."""
    with reopen(folder, name) as source:
        end = source.size()
        start = 0 if low is None else _place_of(source, end, low)
        source.seek(start)
        rest = b""
        while start < end:
            data = source.read(min(CHUNK, end - start))
            start += len(data)
            lines = (rest + data).split(b"\n")
            rest = lines.pop()
            for line in lines:
                entry = json.loads(line)
                if high is not None and entry >= high:
                    return
                if low is None or entry >= low:
                    yield entry


def record(kind: str, page_id: int | None, url: str | None, time: str, payload: bytes, sha: str, size: int, refers_to: int | None) -> bytes:
    """One WARC/1.1 record as a gzip member; a revisit has no payload, but its digest and length."""
    lines = [
        "WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: <urn:page:{page_id}>", f"WARC-Date: {time}",
        f"WARC-Target-URI: {(url or '-').replace(chr(13), '%0D').replace(chr(10), '%0A')}", f"WARC-Payload-Digest: sha1:{sha}",
        f"X-Payload-Length: {size}", "Content-Type: text/html; charset=utf-8",
    ]
    if kind == "revisit":
        lines += ["WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{refers_to}>"]
    lines.append(f"Content-Length: {len(payload)}")
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress("\r\n".join(lines).encode() + b"\r\n\r\n" + payload + b"\r\n\r\n") + packer.flush()


def parse(member: bytes) -> tuple[dict[str, str], bytes]:
    data = gzip.decompress(member)
    head, _, rest = data.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    if lines[0] != "WARC/1.1":
        raise ValueError("not a WARC record")
    fields = dict(line.split(": ", 1) for line in lines[1:])
    return fields, rest[: int(fields["Content-Length"])]


def _write(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made: list[tuple] = []
        entries: list[list] = []
        name, sink, at = "", None, 0

        def flush() -> None:
            run_name, n, some = write_run(folder, sorted(entries))
            made.append((name, run_name, n, some))
            entries.clear()

        for batch, payloads in by_bytes(batches, "_html"):
            for page, url, refers, payload in zip(*(batch.column(i).to_pylist() for i in range(3)), payloads):
                if sink is None:
                    name, sink = create(folder, ".warc.gz")
                time = (FIRST_DAY + timedelta(seconds=(page or 0) % (1 << 31))).strftime("%Y-%m-%dT%H:%M:%SZ")
                kind = "response" if refers is None else "revisit"
                member = record(kind, page, url, time, payload if refers is None else b"", digest(payload), len(payload), refers)
                sink.write(member)
                entries.append([url_key(url), time, page or 0, name, at, len(member)])
                at += len(member)
                if len(entries) >= RUN:
                    flush()
        if entries:
            flush()
        if sink is not None:
            sink.close()
        cols = list(zip(*made)) or [(), (), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))], ["archive", "run", "entries", "samples"])

    return run


def write_archives(pages: DataFrame, folder: str, least: int = 0) -> DataFrame:
    """Writes a record per row of `pages` (page_id, url, html); the saved manifest of runs.

    Of rows with equal payloads of `least` bytes or more, those with the largest page_id are responses and others
    revisit it.  Null html is an empty payload; rows with a null page_id never are the largest, and are responses
    where no row of the payload has an id; a null URL has the key "-".  Repeated rows are records each; a very long html is one
    record; an empty table gives no archive; other columns are not looked at.
    """
    small_batches(pages.sparkSession)
    rows = pages.select(F.col("page_id").cast("long").alias("_page"), F.col("url").cast("string").alias("_url"), F.coalesce(F.col("html").cast("string"), F.lit("")).alias("_html"))
    rows = rows.withColumn("_key", F.unhex(F.sha1(F.col("_html").cast("binary"))))
    heads = saved(rows.where(F.octet_length("_html") >= least).groupBy("_key").agg(F.max("_page").alias("_most"), F.count(F.lit(1)).alias("_m")).where("_m > 1").select("_key", "_most"), "heads")
    told = rows.join(heads, "_key", "left").select("_page", "_url", F.when(F.col("_page").eqNullSafe(F.col("_most")), F.lit(None)).otherwise(F.col("_most")).alias("_refers"), "_html")
    return saved(told.mapInArrow(_write(folder), _MANIFEST), "runs")


def _merge_groups(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [("", *write_run(folder, LoserTree([read_run(folder, r) for r in runs]))) for runs in batch.column(0).to_pylist()]
            cols = list(zip(*made)) or [(), (), (), ()]
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.string()), pa.array(cols[2], pa.int64()), pa.array(cols[3], pa.list_(pa.string()))], ["archive", "run", "entries", "samples"])

    return run


def _merge_range(folder: str, runs):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part, low, high in zip(*(batch.column(i).to_pylist() for i in range(3))):
                held: list[list] = []
                merged = LoserTree([read_run(folder, r, json.loads(low), json.loads(high)) for r in runs.value])
                for n, entry in enumerate(merged):
                    held.append([*entry, part, n])
                    if len(held) == 4096:
                        yield _entries(held)
                        held = []
                if held:
                    yield _entries(held)

    return run


def _entries(rows: list[list]) -> pa.RecordBatch:
    cols = list(zip(*rows))
    names = ["key", "time", "page_id", "archive", "offset", "length", "part", "place"]
    return pa.RecordBatch.from_arrays([pa.array(c, pa.string() if n in ("key", "time", "archive") else pa.int64()) for n, c in zip(names, cols)], names)


def merge_index(manifest: DataFrame, folder: str) -> DataFrame:
    """The captures in global order of (key, time): their entries, `part` (range, ascending) and `place` in it.

    The driver holds the names of `FAN_IN` runs at most and twice `SAMPLES` captures of each.
    """
    spark = manifest.sparkSession
    while (n := manifest.count()) > FAN_IN:
        groups = manifest.select("run", F.pmod(F.xxhash64("run"), F.lit(-(-n // (FAN_IN // 2)))).alias("_g")).groupBy("_g").agg(F.collect_list("run").alias("_runs"))
        manifest = saved(groups.select("_runs").mapInArrow(_merge_groups(folder), _MANIFEST), "runs")
    rows = manifest.select("run", "entries", "samples").collect()
    found = sorted(json.loads(line) for r in rows for line in r["samples"])
    parts = max(1, min(len(found), int(sum(r["entries"] for r in rows) // RUN) + spark.sparkContext.defaultParallelism))
    cuts = [json.dumps(found[i * len(found) // parts]) for i in range(1, parts)]
    ranges = list(zip(range(len(cuts) + 1), ["null", *cuts], [*cuts, "null"]))
    runs = spark.sparkContext.broadcast(sorted(r["run"] for r in rows))
    dealt = spark.createDataFrame(ranges, "part long, low string, high string").repartitionByRange(len(ranges), "part")
    return saved(dealt.mapInArrow(_merge_range(folder, runs), f"{_ENTRY}, part long, place long"), "index")


def _read(folder: str):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        name, source = None, None
        for batch in batches:
            found = []
            for archive, offset, length in zip(*(batch.column(i).to_pylist() for i in range(3))):
                if archive != name:
                    if source is not None:
                        source.close()
                    name, source = archive, reopen(folder, archive)
                source.seek(offset)
                fields, payload = parse(source.read(length))
                sha, size, kind = fields["WARC-Payload-Digest"].removeprefix("sha1:"), int(fields["X-Payload-Length"]), fields["WARC-Type"]
                if kind == "response" and (len(payload) != size or digest(payload) != sha):
                    raise ValueError(f"damaged record at {offset} of {archive}")
                page, refers = (None if v in (None, "None") else int(v) for v in (re.sub(r"^<urn:page:|>$", "", fields[f]) if f in fields else None for f in ("WARC-Record-ID", "WARC-Refers-To")))
                found.append((page, size, sha, kind, refers))
            cols = list(zip(*found)) or [()] * 5
            kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to"])

    return run


def read_archives(index: DataFrame, folder: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every indexed record, from the archives."""
    parts = max(1, -(-int(index.agg(F.sum("length")).first()[0] or 0) // (8 << 20)))  # by the bytes to read, not by the index
    dealt = index.select("archive", "offset", "length").repartition(parts, F.col("archive"), F.floor(F.col("offset") / (1 << 20))).sortWithinPartitions("archive", "offset")
    return dealt.mapInArrow(_read(folder), "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


def archive(pages: DataFrame, least: int = 0) -> DataFrame:
    """Pages written to archives, indexed and read back: one row a page, see `write_archives` and `read_archives`."""
    folder = scratch(pages.sparkSession, "warc")
    return read_archives(merge_index(write_archives(pages, folder, least), folder), folder)
