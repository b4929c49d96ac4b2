"""Approximate nearest neighbours by largest inner product over shifted space-filling curves.

Inner products become distances: data get one more coordinate that brings all to the largest norm, queries are scaled to it.  Each
curve projects vectors on a few random directions, shifts them, and orders them by a Hilbert key.  Keys are cut into tiles of like
size; a query meets the rows of its own tile and of some tiles on both sides, on every curve, and the union is ranked by the
exact product.  How many tiles follows from the data: the neighbours of a few queries are found by comparing them with all rows, and the
fewest tiles that hold the aimed share of them are taken.  So clustered data need little, and data without any structure much.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved, scratch
from lodestone.llm.vectors import finite, matrices

#: Curves; those worked on at once (a copy of the vectors is shuffled for each); directions and bits of a curve.
CURVES, AT_ONCE, DIRECTIONS, BITS = 12, 3, 8, 6
#: Bits below the Hilbert key that part vectors of one cell, the same on all curves.
PARTING = 14
#: Rows of a tile; tiles at least, if there are so many rows, and at most (beyond, tiles grow and are read as a stream).
TILE, LEAST_TILES, MOST_TILES = 4096, 128, 65_536
#: Bounds of the samples that a curve's grid, and the number of tiles, are fitted on; the recall aimed at among the latter.
FITTED, ASKED, AIM = 20_000, 128, 0.95
#: Queries that one task holds for a tile at once; more are dealt over copies of the tile.
HELD = 4096


def hilbert(grid: np.ndarray, bits: int) -> np.ndarray:
    """Positions on the Hilbert curve of the points of an integer grid (n x dimensions, `bits` each), by Gray codes."""
    x = [c.astype(np.int64) for c in grid.T]
    for bit in range(bits - 1, 0, -1):
        one, below = 1 << bit, (1 << bit) - 1
        for i in range(len(x)):
            set_ = (x[i] & one) != 0
            swap = np.where(set_, 0, (x[0] ^ x[i]) & below)
            x[0] = np.where(set_, x[0] ^ below, x[0] ^ swap)
            x[i] = x[i] ^ swap
    for i in range(1, len(x)):
        x[i] = x[i] ^ x[i - 1]
    turn = np.zeros_like(x[0])
    for bit in range(bits - 1, 0, -1):
        turn = np.where((x[-1] >> bit) & 1, turn ^ ((1 << bit) - 1), turn)
    key = np.zeros_like(x[0])
    for bit in range(bits - 1, -1, -1):
        for c in x:
            key = (key << 1) | (((c ^ turn) >> bit) & 1)
    return key


@dataclass
class Curves:
    """The curves of one dimension: directions, grids and shifts, then the cuts of their keys."""

    norm: float
    directions: np.ndarray  # curves x (dimension + 1) x DIRECTIONS
    grids: np.ndarray  # curves x DIRECTIONS x (2^BITS - 1): values that cut a sample evenly
    shifts: np.ndarray  # curves x DIRECTIONS, of one grid length
    cuts: list[np.ndarray] | None = None

    @staticmethod
    def fitted(sample: np.ndarray, norm: float, curves: int, seed: int) -> Curves:
        random = np.random.default_rng(seed)
        d = sample.shape[1] + 1
        own = Curves(norm, np.stack([np.linalg.qr(random.normal(size=(d, min(DIRECTIONS, d))))[0] for _ in range(curves)]), np.zeros(0), random.random((curves, min(DIRECTIONS, d))))
        points = own.lifted(sample)
        own.grids = np.stack([np.quantile(points @ v, np.arange(1, 1 << BITS) / (1 << BITS), axis=0).T for v in own.directions])
        return own

    def lifted(self, data: np.ndarray) -> np.ndarray:
        data = data / self.norm
        return np.column_stack([data, np.sqrt(np.maximum(0.0, 1 - (data * data).sum(axis=1)))])

    def asking(self, queries: np.ndarray) -> np.ndarray:
        queries = queries / np.abs(queries).max(axis=1, keepdims=True)
        return np.column_stack([queries / np.linalg.norm(queries, axis=1, keepdims=True), np.zeros(len(queries))])

    def keys(self, points: np.ndarray, parting: np.ndarray) -> np.ndarray:
        """curves x points; a shifted grid has twice the cells, half of them used."""
        out = []
        for v, grid, shift in zip(self.directions, self.grids, self.shifts):
            p = points @ v
            cells = np.stack([np.searchsorted(grid[k], p[:, k], side="right") for k in range(p.shape[1])], axis=1)
            out.append((hilbert(cells + (shift * (1 << BITS)).astype(np.int64), BITS + 1) >> max(0, (BITS + 1) * p.shape[1] - 48) << PARTING) | parting)
        return np.stack(out)

    def tiles(self, points: np.ndarray, parting: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(c, k, side="right") for c, k in zip(self.cuts, self.keys(points, parting))]).astype(np.int32)


def _parting(vectors: np.ndarray) -> np.ndarray:
    """Some bits of each vector that look random; equal vectors have equal ones."""
    words = np.ascontiguousarray(vectors + 0.0).view(np.uint64)
    mixed = np.zeros(len(words), np.uint64)
    for column in words.T:
        mixed = (mixed ^ column) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(29)
    return (mixed >> np.uint64(64 - PARTING)).astype(np.int64)


def _best(ids: np.ndarray, scores: np.ndarray, queries: np.ndarray, k: int) -> np.ndarray:
    """Indices of each query's k first by score, then id; an id counts once."""
    order = np.lexsort((ids, -scores, queries))
    q, i = queries[order], ids[order]
    if len(order) > 1:  # equal ids of one query with one score stand side by side
        new = np.append(True, (q[1:] != q[:-1]) | (i[1:] != i[:-1]) | (scores[order][1:] != scores[order][:-1]))
        order, q = order[new], q[new]
    start = np.flatnonzero(np.append(True, q[1:] != q[:-1])) if len(q) else np.zeros(0, np.int64)
    rank = np.arange(len(q)) - np.repeat(start, np.diff(np.append(start, len(q))))
    return order[rank < k]


class Asked:
    """Queries that meet rows block by block, with their k best so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.least = np.full(len(ids), -np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))  # query, id, score

    def meet(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        rough = self.vectors @ vectors.T
        rough[self.ids[:, None] == ids[None, :]] = -np.inf
        k = min(self.k, rough.shape[1])
        least = np.maximum(self.least, np.partition(rough, rough.shape[1] - k, axis=1)[:, rough.shape[1] - k])
        slack = 1e-12 * np.linalg.norm(self.vectors, axis=1) * np.linalg.norm(vectors, axis=1).max()
        q, r = np.nonzero((rough >= (least - slack)[:, None]) & (rough > -np.inf))
        exact = (self.vectors[q] * vectors[r]).sum(axis=1)  # row by row: equal rows have equal scores
        q, i, s = (np.concatenate(p) for p in zip(self.found, (q, ids[r], exact)))
        keep = _best(i, s, q, self.k)
        self.found = q, i, s = q[keep], i[keep], s[keep]
        full = np.bincount(q, minlength=len(self.ids)) == self.k
        lowest = np.full(len(self.ids), np.inf)
        np.minimum.at(lowest, q, s)
        self.least = np.where(full, lowest, -np.inf)

    def rows(self) -> pa.RecordBatch:
        q, i, s = self.found
        return pa.RecordBatch.from_arrays([pa.array(self.ids[q]), pa.array(i), pa.array(s)], ["query_id", "vec_id", "score"])


FOUND = "query_id long, vec_id long, score double"


def _ranked(found: DataFrame, k: int) -> DataFrame:
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return once.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def against_all(data: DataFrame, ids: np.ndarray, vectors: np.ndarray, k: int) -> DataFrame:
    """The exact answer for a bounded number of queries: one pass over `_id`, `_v` of their dimension."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = Asked(ids, vectors, k)
        for batch in batches:
            own = batch.column(0).to_numpy()
            for _, rows, m in matrices(batch.column(1)):
                for at in range(0, len(m), TILE):
                    asked.meet(own[rows[at : at + TILE]], m[at : at + TILE])
        yield asked.rows()

    return _ranked(data.select("_id", "_v").mapInArrow(run, FOUND), k)


def index(data: DataFrame, dimension: int, k: int, curves: int = CURVES, seed: int = 7) -> Curves:
    """Curves over all rows: the grid is fitted on `FITTED` rows at most, the tiles are cut at quantiles of all keys."""
    norm = float(np.sqrt(data.agg(F.max(F.aggregate("_v", F.lit(0.0), lambda a, x: a + x * x))).first()[0]))
    n = data.count()
    rate = min(1.0, 2 * FITTED / n)
    sample = data.where(F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(1_000_000)) < int(rate * 1_000_000)).select("_v").limit(FITTED).collect() if n > FITTED else data.select("_v").collect()
    own = Curves.fitted(np.array([r[0] for r in sample]).reshape(-1, dimension), norm, curves, seed)
    count = int(min(MOST_TILES, max(n / TILE, min(LEAST_TILES, n / 64), 1)))
    if count > 1:

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for _, _, m in matrices(batch.column(0)):
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in own.keys(own.lifted(m), _parting(m))], [f"k{c}" for c in range(curves)])

        keys = data.select("_v").mapInArrow(run, ", ".join(f"k{c} long" for c in range(curves)))
        shares = F.array(*[F.lit(i / count) for i in range(1, count)]) if count <= 256 else F.expr(f"transform(sequence(1, {count - 1}), i -> i / {count}D)")
        cuts = keys.agg(*[F.percentile_approx(f"k{c}", shares, max(10_000, 10 * count)).alias(f"k{c}") for c in range(curves)]).first()
        own.cuts = [np.array(c, np.int64) for c in cuts]
    else:
        own.cuts = [np.zeros(0, np.int64)] * curves
    return own


def reach(data: DataFrame, queries: DataFrame, curves: Curves, k: int) -> tuple[int, float]:
    """(tiles on each side, recall among `ASKED` queries): the fewest tiles that hold the share `AIM` of the neighbours of some queries."""
    asked = queries.orderBy(F.xxhash64("_id"), "_id").limit(ASKED).collect()
    ids, vectors = np.array([r["_id"] for r in asked], np.int64), np.array([r["_v"] for r in asked], np.float64)
    near = against_all(data, ids, vectors, k)
    rows = near.join(data, near["vec_id"] == data["_id"], "inner").select("query_id", "_v").collect()
    if not rows:
        return 0, 1.0
    m = np.array([r["_v"] for r in rows], np.float64)
    place = {i: n for n, i in enumerate(ids.tolist())}
    theirs = curves.tiles(curves.asking(vectors), _parting(vectors))[:, [place[r["query_id"]] for r in rows]]
    apart = np.sort(np.abs(curves.tiles(curves.lifted(m), _parting(m)) - theirs).min(axis=0))
    wide = int(apart[min(len(apart) - 1, int(np.ceil(AIM * len(apart))) - 1)])
    return wide, float((apart <= wide).mean())


def _meeting(k: int):
    """Rows sorted by (curve, tile, block, queries first): queries of one block are held, its rows pass as a stream."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, asked, waiting = None, None, ([], [])

        def close() -> Iterator[pa.RecordBatch]:
            nonlocal asked, waiting
            if asked is not None:
                yield asked.rows()
            asked, waiting = None, ([], [])

        for batch in batches:
            where = np.column_stack([batch.column(i).to_numpy(zero_copy_only=False).astype(np.int64) for i in range(4)])
            ids = batch.column(4).to_numpy()
            ends = np.flatnonzero((where[1:] != where[:-1]).any(axis=1)) + 1
            for lo, hi in zip(np.append(0, ends).tolist(), np.append(ends, len(where)).tolist()):
                own = tuple(where[lo, :3].tolist())
                if own != at:
                    yield from close()
                    at = own
                for _, rows, m in matrices(batch.column(5).slice(lo, hi - lo)):
                    if where[lo, 3] == 0:
                        waiting[0].append(ids[lo:hi][rows])
                        waiting[1].append(m)
                    else:
                        if asked is None and waiting[0]:
                            asked = Asked(np.concatenate(waiting[0]), np.concatenate(waiting[1]), k)
                        if asked is not None:
                            for s in range(0, len(m), TILE):
                                asked.meet(ids[lo:hi][rows[s : s + TILE]], m[s : s + TILE])
        yield from close()

    return run


def _dealt(df: DataFrame, curves: Curves, queries: bool) -> DataFrame:
    """`_tiles`: the tile on each curve."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, rows, m in matrices(batch.column(1)):
                tiles = curves.tiles(curves.asking(m) if queries else curves.lifted(m), _parting(m)).T
                flat = pa.array(np.ascontiguousarray(tiles).ravel())
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(m) + 1, dtype=np.int32) * tiles.shape[1]), flat)
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(rows)), batch.column(1).take(pa.array(rows)), lists], ["_id", "_v", "_tiles"])

    return df.select("_id", "_v").mapInArrow(run, "_id long, _v array<double>, _tiles array<int>")


def vectors(df: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """`_id`, `_v` (doubles) of the vectors that take part: id and entries not null, entries finite, one at least not zero."""
    vector = F.col(f"`{vector_col}`")
    own = df.where(finite(vector_col)).where(F.col(f"`{id_col}`").isNotNull() & F.exists(vector, lambda x: x != 0))
    return own.select(F.col(f"`{id_col}`").cast("long").alias("_id"), vector.cast("array<double>").alias("_v"))


def near(data: DataFrame, queries: DataFrame, k: int = 20, curves: int = CURVES) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the `k` rows of the largest inner product among those found.

    Both tables have `_id` and `_v` (see `vectors`).  Ties go to the smaller id; rows with the query's own id are left out; vectors of each
    dimension are searched apart; of queries with the same id one is taken; an id counts once per query, with its best
    score.  Of equal vectors only the k + 1 smallest ids can be among the k nearest of anything, so no more are indexed.  Empty tables give
    an empty result.  Data of no structure need most tiles, and then cost about as much as comparing all; see `reach`.
    """
    spark = data.sparkSession
    copies = Window.partitionBy("_v").orderBy("_id")
    data = saved(data.select("_id", "_v").dropDuplicates().withColumn("_n", F.row_number().over(copies)).where(F.col("_n") <= k + 1).drop("_n"), "vectors")
    queries = saved(queries.select("_id", "_v").dropDuplicates(["_id"]), "queries")
    path = scratch(spark, "found")
    sizes = lambda df: {r[0] for r in df.select(F.size("_v")).distinct().collect()}
    spark.createDataFrame([], FOUND).write.parquet(path)
    for d in sorted(sizes(data) & sizes(queries)):
        _search(data.where(F.size("_v") == d), queries.where(F.size("_v") == d), d, k, curves, path)
    return _ranked(spark.read.schema(FOUND).parquet(path), k)


def _search(data: DataFrame, queries: DataFrame, dimension: int, k: int, curves: int, path: str) -> None:
    own = index(data, dimension, k, curves)
    wide, _ = reach(data, queries, own, k)
    data, queries = saved(_dealt(data, own, False), "tiles"), saved(_dealt(queries, own, True), "asking")
    last = [len(c) for c in own.cuts]
    for first in range(0, curves, AT_ONCE):
        now = range(first, min(curves, first + AT_ONCE))
        here = lambda df: df.select("_id", "_v", F.explode(F.array(*[F.struct(F.lit(c).alias("c"), F.get("_tiles", F.lit(c)).alias("t"), F.lit(last[c]).alias("last")) for c in now])).alias("_at"))  # noqa: E731, B023
        asking = here(queries).select("_id", "_v", "_at.c", F.explode(F.sequence(F.greatest(F.lit(0), F.col("_at.t") - wide), F.least(F.col("_at.last"), F.col("_at.t") + wide))).alias("t"))
        met = asking.groupBy("c", "t").agg(F.ceil(F.count(F.lit(1)) / HELD).cast("int").alias("_blocks"))
        met = F.broadcast(met)  # a row a tile: AT_ONCE x MOST_TILES at most
        asking = asking.join(met, ["c", "t"]).select("c", "t", F.pmod(F.xxhash64("_id"), F.col("_blocks")).cast("int").alias("b"), F.lit(0).alias("r"), "_id", "_v")
        rows = here(data).select("_id", "_v", "_at.c", "_at.t").join(met, ["c", "t"]).select("c", "t", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)).alias("b"), F.lit(1).alias("r"), "_id", "_v")
        together = asking.unionByName(rows).repartition("c", "t", "b").sortWithinPartitions("c", "t", "b", "r")
        _ranked(together.mapInArrow(_meeting(k), FOUND), k).drop("rank").write.mode("append").parquet(path)
