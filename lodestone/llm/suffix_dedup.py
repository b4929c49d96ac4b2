"""Removal of passages that occur more than once in a corpus, by suffix arrays of shards.

Every string of `length` bytes (a window) is owned by the first position of its smallest `GRAM`-byte hash, its
anchor.  Equal windows have equal anchors at equal offsets, so windows need comparing only among the occurrences of
one anchor.  An occurrence carries the context that spans the windows it owns:

1. one pass over the texts emits (anchor, context hash, place) and no text;
2. equal contexts are counted (all their windows repeat), and only the distinct contexts of anchors that have more
   than one go on, as bytes;
3. tasks that hold whole anchors build the suffix array of their contexts by induced sorting and read the permuted
   common prefixes: a window repeats if a neighbour in the array shares `length` bytes;
4. an anchor with more than `SHARD` distinct contexts is split over several tasks; what a task finds unrepeated,
   and one of each repeated window, is compared once more by 128-bit fingerprints, packed by fingerprint;
5. the places of all repeated windows are gathered by text and cut out.

No step gathers pairs, and no group grows beyond `SHARD` contexts in one task.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.llm.common import by_bytes, saved, small_batches
from lodestone.llm.induced_sort import repeated

#: Bytes of the hashed strings that anchors are chosen by.
GRAM = 32
#: Distinct contexts of one anchor in one task, and bytes sorted at once.
SHARD = 4096
SORT_BYTES = 2 << 20
#: A byte that UTF-8 never holds.
BREAK = 0xFF

_MIX = np.random.default_rng(20240229).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15

_PLACES = "_k long, _q long, _a long, _c long, _p array<long>"
_FOUND = "_a long, _c long, _from int, _to int, _bucket long, _packed binary"
_PRINT = np.dtype([("a", "<i8"), ("c", "<i8"), ("o", "<i4"), ("f", "<u8", (2,)), ("d", "?")])


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hashes of all `gram`-byte strings; gram is a power of two."""
    h, power = _MIX[data], _BASE
    width = 1
    while width < gram:
        h = h[:-width] * np.uint64(power) + h[width:]
        power = power * power % (1 << 64)
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(32)
    return h


def _sliding_min(keys: np.ndarray, width: int) -> np.ndarray:
    n = len(keys)
    blocks = np.full(-(-n // width) * width, np.iinfo(np.uint64).max, np.uint64)
    blocks[:n] = keys
    blocks = blocks.reshape(-1, width)
    left = np.minimum.accumulate(blocks, axis=1).ravel()
    right = np.minimum.accumulate(blocks[:, ::-1], axis=1)[:, ::-1].ravel()
    return np.minimum(right[: n - width + 1], left[width - 1 : n])


def anchors(texts: list[bytes], length: int) -> tuple[np.ndarray, ...]:
    """(text index, anchor hash, first window, last window) of every anchor of the texts."""
    gram = min(GRAM, 1 << (length.bit_length() - 1))
    sizes = np.array([len(t) for t in texts], np.int64)
    data = np.frombuffer(b"".join(texts), np.uint8)
    empty = np.empty(0, np.int64)
    if len(data) < length:
        return empty, empty, empty, empty
    hashes = gram_hashes(data, gram)
    keys = (hashes & np.uint64(0xFFFFFFFF00000000)) | np.arange(len(hashes), dtype=np.uint64)
    owner = (_sliding_min(keys, length - gram + 1) & np.uint64(0xFFFFFFFF)).astype(np.int64)
    first = np.cumsum(sizes) - sizes
    windows = np.maximum(sizes - length + 1, 0)
    which = np.repeat(np.arange(len(texts)), windows)
    start = np.arange(len(which)) - np.repeat(np.cumsum(windows) - windows, windows)
    owned = owner[start + first[which]]
    if not len(owned):
        return empty, empty, empty, empty
    begin = np.flatnonzero(np.concatenate(([True], owned[1:] != owned[:-1])))
    end = np.append(begin[1:], len(owned)) - 1
    return which[begin], hashes[owned[begin]].view(np.int64), start[begin], start[end]


def _find_anchors(length: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, texts in by_bytes(batches, "_t"):
            which, hashes, low, high = anchors(texts, length)
            contexts = np.array([xxhash.xxh3_64_intdigest(texts[i][a : b + length]) for i, a, b in zip(which.tolist(), low.tolist(), high.tolist())], np.uint64).view(np.int64)
            order = np.lexsort((low, contexts, hashes, which))  # one row for all places of a context in a text
            which, hashes, contexts, place = which[order], hashes[order], contexts[order], (low * length + (high - low))[order]
            new = np.ones(len(which), bool)
            new[1:] = (which[1:] != which[:-1]) | (hashes[1:] != hashes[:-1]) | (contexts[1:] != contexts[:-1])
            first = np.flatnonzero(new)
            row, offsets = pa.array(which[first]), pa.array(np.append(first, len(which)).astype(np.int32))
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(row), batch.column(1).take(row), pa.array(hashes[first]), pa.array(contexts[first]), pa.ListArray.from_arrays(offsets, pa.array(place))],
                ["_k", "_q", "_a", "_c", "_p"],
            )

    return run


def _shrink(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts (_t, the last column) as zstd frames: they are shuffled twice."""
    packer = zstandard.ZstdCompressor(level=1)
    for batch, texts in by_bytes(batches, "_t"):
        yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array([packer.compress(t) for t in texts], pa.binary())], batch.schema.names)


def _grown(frames: pa.Array) -> list[bytes]:
    unpacker = zstandard.ZstdDecompressor()
    return [unpacker.decompress(f) for f in frames.to_pylist()]


def _cut_contexts(length: int):
    """One row a text, with the list of the contexts wanted of it, to one row a context."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, _ in by_bytes(batches, "_t", 1 << 19):
            for text, wanted in zip(_grown(batch.column(0)), batch.column(1).to_pylist()):
                a, c, parts, cut = zip(*((w["_a"], w["_c"], w["_parts"], text[w["_p"] // length : w["_p"] // length + w["_p"] % length + length]) for w in wanted))
                yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(parts, pa.int32()), pa.array(cut, pa.binary())], ["_a", "_c", "_parts", "_bytes"])

    return run


def _ranges(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    edge = np.diff(np.concatenate(([0], flags.astype(np.int8), [0])))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1) - 1


def _found(rows: list[tuple], packed: dict[int, list[np.ndarray]]) -> pa.RecordBatch:
    rows = rows + [(0, None, None, None, b, np.concatenate(p).tobytes()) for b, p in packed.items()]
    a, c, low, high, bucket, data = zip(*rows) if rows else ((),) * 6
    return pa.RecordBatch.from_arrays(
        [pa.array(a, pa.int64()), pa.array(c, pa.int64()), pa.array(low, pa.int32()), pa.array(high, pa.int32()), pa.array(bucket, pa.int64()), pa.array(data, pa.binary())],
        ["_a", "_c", "_from", "_to", "_bucket", "_packed"],
    )


def _sort_shard(group: list[tuple[int, int, int, bytes]], length: int) -> pa.RecordBatch:
    """(anchor, context hash, parts, bytes) of whole anchors, or of one part of a split anchor."""
    rows: list[tuple] = []
    packed: dict[int, list[np.ndarray]] = {}
    text = np.frombuffer(bytes([BREAK]).join(g[3] for g in group), np.uint8)
    flags = repeated(text, length)
    at = 0
    for a, c, parts, data in group:
        own = flags[at : at + len(data) - length + 1]
        low, high = _ranges(own)
        rows += [(a, c, x, y, None, None) for x, y in zip(low.tolist(), high.tolist())]
        if parts > 1:
            prints = np.zeros(len(own), _PRINT)
            prints["a"], prints["c"], prints["o"], prints["d"] = a, c, np.arange(len(own)), own
            prints["f"] = np.frombuffer(b"".join(xxhash.xxh3_128_digest(data[i : i + length]) for i in range(len(own))), "<u8").reshape(-1, 2)
            bucket = (prints["f"][:, 0] % np.uint64(parts)).astype(np.int64)
            for b in np.unique(bucket):
                packed.setdefault(a >> 32 << 32 | int(b), []).append(prints[bucket == b])
        at += len(data) + 1
    for b, p in packed.items():
        every = np.concatenate(p)
        mine = every[~every["d"]]
        seen = every[every["d"]]
        _, one = np.unique(seen["f"], axis=0, return_index=True)
        packed[b] = [mine, seen[one]]
    return _found(rows, packed)


def _sort_shards(length: int):
    """Rows sorted by (anchor, part); a part of a split anchor is sorted alone."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group: list[tuple[int, int, int, bytes]] = []
        size, last = 0, None
        for batch in batches:
            for a, c, parts, part, data in zip(*(batch.column(i).to_pylist() for i in range(5))):
                if (a, part) != last:
                    if group and (size >= SORT_BYTES or parts > 1 or group[-1][2] > 1):
                        yield _sort_shard(group, length)
                        group, size = [], 0
                    seen: set[int] = set()
                    last = (a, part)
                if c not in seen:
                    seen.add(c)
                    group.append((a, c, parts, data))
                    size += len(data)
        if group:
            yield _sort_shard(group, length)

    return run


def _meet(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows sorted by bucket: windows of split anchors that repeat in another part."""

    def out(parts: list[bytes]) -> pa.RecordBatch:
        prints = np.frombuffer(b"".join(parts), _PRINT)
        key = np.column_stack((prints["a"].astype(np.uint64), prints["f"]))
        order = np.lexsort(key.T)
        key = key[order]
        same = np.concatenate(((key[1:] == key[:-1]).all(axis=1), [False]))
        hit = same | np.concatenate(([False], same[:-1]))
        mine = prints[order][hit]
        mine = mine[~mine["d"]]
        return _found([(int(p["a"]), int(p["c"]), int(p["o"]), int(p["o"]), None, None) for p in mine], {})

    held: list[bytes] = []
    last = None
    for batch in batches:
        for bucket, data in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
            if bucket != last and held:
                yield out(held)
                held = []
            last = bucket
            held.append(data)
    if held:
        yield out(held)


def _keys(id_col: str, text_col: str) -> list[F.Column]:
    """Two longs that tell rows apart by id and text; equal rows share them, and so their places."""
    return [F.xxhash64(F.col(f"`{id_col}`")).alias("_k"), F.xxhash64(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit(""))).alias("_q")]


def repeated_places(docs: DataFrame, id_col: str, text_col: str, length: int) -> DataFrame:
    """`_k`, `_q` (see `_keys`) and `_spans`, a list of (first window, last window): where strings of `length` bytes repeat."""
    spark = docs.sparkSession
    small_batches(spark)
    long_ = docs.select(*_keys(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("_t")).where(F.octet_length("_t") >= length)
    every = saved(long_.mapInArrow(_find_anchors(length), _PLACES), "anchors")
    shared = saved(every.groupBy("_a").agg(F.sum(F.size("_p")).alias("_n")).where("_n > 1").select("_a"), "shared")
    places = saved(every.join(shared, "_a"), "places")
    contexts = saved(places.withColumn("_n", F.size("_p")).withColumn("_p", F.get("_p", F.lit(0))).groupBy("_a", "_c").agg(F.sum("_n").alias("_n"), *(F.first(x).alias(x) for x in ("_k", "_q", "_p"))), "contexts")
    mixed = saved(contexts.groupBy("_a").agg(F.count(F.lit(1)).alias("_m")).where("_m > 1"), "mixed")  # a table, so that the join can split a hot anchor
    wanted = contexts.join(mixed, "_a").select("_k", "_q", F.struct("_a", "_c", F.ceil(F.col("_m") / SHARD).cast("int").alias("_parts"), "_p").alias("_w"))
    wanted = wanted.groupBy("_k", "_q").agg(F.collect_list("_w").alias("_wanted"))
    cut = (
        long_.mapInArrow(_shrink, "_k long, _q long, _t binary").join(wanted, ["_k", "_q"])
        .select("_t", "_wanted")
        .mapInArrow(_cut_contexts(length), "_a long, _c long, _parts int, _bytes binary")
        .select("_a", "_c", "_parts", F.when(F.col("_parts") > 1, F.pmod(F.xxhash64("_c"), "_parts")).otherwise(0).cast("int").alias("_part"), "_bytes")
    )
    found = saved(cut.repartition(F.col("_a"), F.col("_part")).sortWithinPartitions("_a", "_part").mapInArrow(_sort_shards(length), _FOUND), "sorted")
    split = found.where("_packed is not null").select("_bucket", "_packed")
    met = split.repartition(F.col("_bucket")).sortWithinPartitions("_bucket").mapInArrow(_meet, _FOUND)
    windows = (
        contexts.where("_n > 1").select("_a", "_c", F.lit(0).alias("_from"), F.pmod("_p", F.lit(length)).cast("int").alias("_to"))
        .unionByName(found.where("_packed is null").select("_a", "_c", "_from", "_to"))
        .unionByName(met.select("_a", "_c", "_from", "_to"))
    )
    windows = saved(windows.groupBy("_a", "_c").agg(F.collect_set(F.struct("_from", "_to")).alias("_w")), "windows")  # a table, so that the join can split a hot key
    low = lambda p: F.floor(p / length).cast("int")
    spans = F.flatten(F.transform("_p", lambda p: F.transform("_w", lambda w: F.struct((low(p) + w["_from"]).alias("_from"), (low(p) + w["_to"]).alias("_to")))))
    return (
        places.join(windows, ["_a", "_c"])
        .select("_k", "_q", spans.alias("_s"))
        .groupBy("_k", "_q")
        .agg(F.flatten(F.collect_set("_s")).alias("_spans"))  # a set: equal rows give equal places
    )


def covered(n: int, spans: list[dict], length: int) -> np.ndarray:
    """Merged [start, end) byte runs of windows given as (first, last)."""
    if not spans:
        return np.empty((0, 2), np.int64)
    edges = np.array(sorted((s["_from"], s["_to"] + length) for s in spans), np.int64)
    reach = np.maximum.accumulate(edges[:, 1])
    new = np.concatenate(([True], edges[1:, 0] > reach[:-1]))
    first = np.flatnonzero(new)
    return np.stack([edges[first, 0], np.minimum(reach[np.append(first[1:], len(edges)) - 1], n)], axis=1)


def _cut_out(length: int, keep_text: bool):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, frames in by_bytes(batches, "_t", 1 << 19):
            sizes, gone, runs, shas, left = [], [], [], [], []
            for text, spans in zip(_grown(pa.array(frames, pa.binary())), batch.column(batch.schema.get_field_index("_spans")).to_pylist()):
                cuts = covered(len(text), spans or [], length).tolist()
                kept, at = [], 0
                for a, b in cuts:
                    kept.append(text[at:a])
                    at = b
                rest = b"".join([*kept, text[at:]])
                sizes.append(len(text))
                gone.append(len(text) - len(rest))
                runs.append(len(cuts))
                shas.append(hashlib.sha256(rest).hexdigest())
                left.append(rest.decode("utf-8", "ignore") if keep_text else None)
            yield pa.RecordBatch.from_arrays(
                [batch.column(batch.schema.get_field_index("_row")), pa.array(sizes, pa.int64()), pa.array(gone, pa.int64()), pa.array(runs, pa.int64()), pa.array(shas, pa.string()), pa.array(left, pa.string())],
                ["_row", "_n_bytes", "_n_removed", "_n_spans", "_sha", "_left"],
            )

    return run


def remove_repeats(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = 400, keep_text: bool = True) -> DataFrame:
    """Every row of `docs`, less the bytes covered by a string of `length` bytes that also starts anywhere else.

    Adds _n_bytes, _n_removed, _n_spans (maximal removed runs), _sha (SHA-256 of the rest, hex) and, if asked for,
    _left (the rest as text; bytes of a character that was cut through go).  Matches stay inside a document; all
    occurrences go, the first too.  Null texts count as empty; texts shorter than `length` stay whole; a repeated
    row is a further occurrence, so both lose their whole text; rows with a null id take part like others; a very long
    text is one row in one task; an empty table gives an empty one.  Other columns pass through, whatever their names; one named like an added column is
    replaced.
    """
    places = repeated_places(docs, id_col, text_col, length)
    added = T.StructType.fromDDL("_n_bytes long, _n_removed long, _n_spans long, _sha string, _left string")
    own = [f for f in docs.schema.fields if f.name != text_col and f.name.lower() not in added.fieldNames()]
    row = T.StructField("_row", T.StructType(own))
    keyed = docs.select(F.struct(*[F.col(f"`{f.name}`") for f in own]).alias("_row"), *_keys(id_col, text_col), F.col(f"`{text_col}`").cast("string").alias("_t"))
    keys = [T.StructField(k, T.LongType()) for k in ("_k", "_q")]
    packed = keyed.mapInArrow(_shrink, T.StructType([row, *keys, T.StructField("_t", T.BinaryType())]))
    joined = packed.join(places, ["_k", "_q"], "left").drop("_k", "_q")
    out = joined.mapInArrow(_cut_out(length, keep_text), T.StructType([row, *added.fields]))
    return out.select(*[F.col(f"_row.`{f.name}`") for f in own], *added.fieldNames())
