"""Exact top-k inner-product search with cover trees over queries and data.

Queries are taken in blocks of bounded size; for each block every partition of the data is read once.  A task
indexes its rows, `CHUNK` at a time, in a cover tree, holds the tree of the query block against it, and drops a pair
of nodes when no vector of the one can beat the worst k-th score that any query of the other has so far:

    <q, d>  <=  <cq, cd> + rq * |cd| + rd * (|cq| + rq)        (centres c, covering radii r)

A task returns its k best rows per query; the final ranking sees k rows per query and task.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved, scratch

#: Queries per block, rows per tree, rows per leaf.
BLOCK, CHUNK, LEAF = 4096, 4096, 64
#: The score of no row.
NONE = np.iinfo(np.int64).min


class Node:
    __slots__ = ("center", "children", "norm", "radius", "rows")

    def __init__(self, points: np.ndarray, rows: np.ndarray, center: np.ndarray):
        self.rows, self.center, self.children = rows, center, []
        self.radius = float(np.sqrt(np.max(((points[rows] - center) ** 2).sum(axis=1), initial=0.0)))
        self.norm = float(np.sqrt((center * center).sum()))


def cover_tree(points: np.ndarray) -> Node:
    """Nodes hold all their rows within `radius`; centres of siblings are more than half the parent's radius apart.

    Children of a few rows share one leaf, so that leaves stay worth a matrix product.
    """
    root = Node(points, np.arange(len(points)), points.mean(axis=0) if len(points) else np.zeros(points.shape[1]))
    open_ = [root]
    while open_:
        node = open_.pop()
        if len(node.rows) <= LEAF or node.radius == 0:
            continue
        left, small = node.rows, []
        while len(left):
            center = points[left[0]]
            near = ((points[left] - center) ** 2).sum(axis=1) <= (node.radius / 2) ** 2
            near[0] = True
            group, left = left[near], left[~near]
            if len(group) >= LEAF // 4:
                node.children.append(Node(points, group, center))
            else:
                small.append(group)
        if small:
            rest = np.concatenate(small)
            for at in range(0, len(rest), LEAF):
                part = rest[at : at + LEAF]
                node.children.append(Node(points, part, points[part].mean(axis=0)))
        open_ += node.children if len(node.children) > 1 else []
        if len(node.children) == 1:
            node.children = []
    return root


class Queries:
    """A block of queries of one dimension, their tree and their best rows so far."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, k: int):
        self.ids, self.vectors, self.k = ids, vectors, k
        self.exact = vectors.astype(np.float64)
        self.tree = cover_tree(self.exact)
        self.scores = np.full((len(ids), k), NONE)
        self.rows = np.full((len(ids), k), np.iinfo(np.int64).max)

    def search(self, ids: np.ndarray, vectors: np.ndarray) -> None:
        points = vectors.astype(np.float64)
        wide = max(np.abs(points).max(initial=0), np.abs(self.exact).max(initial=0)) ** 2 * max(points.shape[1], 1) >= 2**53
        data = (vectors, self.vectors) if wide else (points, self.exact)
        self._pairs(self.tree, [cover_tree(points)], ids, data)

    def _worst(self, group: Node) -> float:
        least = self.scores[group.rows, -1].min()
        return -np.inf if least == NONE else float(least)

    def _pairs(self, group: Node, nodes: list[Node], ids: np.ndarray, data: tuple[np.ndarray, np.ndarray]) -> None:
        while nodes:
            centers = np.stack([n.center for n in nodes])
            norm, radius = np.array([n.norm for n in nodes]), np.array([n.radius for n in nodes])
            bound = centers @ group.center + group.radius * norm + radius * (group.norm + group.radius)
            bound += 1e-9 * np.abs(bound) + 1e-6
            order = np.argsort(-bound, kind="stable")
            nodes = [nodes[i] for i in order if bound[i] >= self._worst(group)]
            if group.children:
                opened = [c for n in nodes for c in (n.children or [n])]
                for child in group.children:
                    self._pairs(child, opened, ids, data)
                return
            further = []
            for at, node in zip(order.tolist(), nodes):
                if bound[at] < self._worst(group):
                    break
                if node.children:
                    further += node.children
                else:
                    self._compare(group.rows, node.rows, ids, data)
            nodes = further

    def _compare(self, mine: np.ndarray, rows: np.ndarray, ids: np.ndarray, data: tuple[np.ndarray, np.ndarray]) -> None:
        score = (data[1][mine] @ data[0][rows].T).astype(np.int64)
        score[self.ids[mine][:, None] == ids[rows][None, :]] = NONE
        some = np.flatnonzero((score >= self.scores[mine, -1][:, None]).any(axis=1) & (score > NONE).any(axis=1))
        if not len(some):
            return
        at = mine[some]
        score = np.concatenate([self.scores[at], score[some]], axis=1)
        key = np.concatenate([self.rows[at], np.broadcast_to(ids[rows], (len(some), len(rows)))], axis=1)
        key = np.where(score == NONE, np.iinfo(np.int64).max, key)
        best = np.lexsort((key, ~score), axis=1)[:, : self.k]
        self.scores[at] = np.take_along_axis(score, best, 1)
        self.rows[at] = np.take_along_axis(key, best, 1)


def _by_dimension(ids: list[int], vectors: list[list[int]]) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    groups: dict[int, tuple[list, list]] = {}
    for i, v in zip(ids, vectors):
        own = groups.setdefault(len(v), ([], []))
        own[0].append(i)
        own[1].append(v)
    return {d: (np.array(i, np.int64), np.array(v, np.int64).reshape(len(i), d)) for d, (i, v) in groups.items()}


def _search(block, k: int):
    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        queries = {d: Queries(i, v, k) for d, (i, v) in block.value.items()}
        waiting: dict[int, tuple[list, list]] = {}

        def flush(d: int) -> None:
            ids, vectors = waiting.pop(d)
            queries[d].search(np.concatenate(ids), np.concatenate(vectors))

        for batch in batches:
            for d, (ids, vectors) in _by_dimension(batch.column(0).to_pylist(), batch.column(1).to_pylist()).items():
                if d not in queries:
                    continue
                for at in range(0, len(ids), CHUNK):
                    own = waiting.setdefault(d, ([], []))
                    own[0].append(ids[at : at + CHUNK])
                    own[1].append(vectors[at : at + CHUNK])
                    if sum(map(len, own[0])) >= CHUNK:
                        flush(d)
        for d in list(waiting):
            flush(d)
        for q in queries.values():
            at, rank = np.nonzero(q.scores > NONE)
            yield pa.RecordBatch.from_arrays([pa.array(q.ids[at]), pa.array(q.rows[at, rank]), pa.array(q.scores[at, rank])], ["query_id", "vec_id", "score"])

    return run


def quantised(df: DataFrame, id_col: str, vector_col: str, scale: int = 256) -> DataFrame:
    """`_id`, `_v`: floor(scale * x) per component, of the vectors whose components are all finite; rows with a null id take no part."""
    finite = F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x.cast("double")) < float("inf")))
    floor = F.transform(vector_col, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long"))
    return df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.coalesce(finite, F.lit(False))).select(F.col(id_col).cast("long").alias("_id"), floor.alias("_v"))


def top_k(data: DataFrame, queries: DataFrame, k: int = 5) -> DataFrame:
    """The `k` rows of `data` with the highest inner product, for each query: query_id, rank, vec_id, score.

    Both tables have `_id` and integer vectors `_v` (see `quantised`).  Ties go to the smaller id; rows with the
    query's own id are left out; vectors of another dimension are no candidates; of queries with the same id one is
    taken; repeated data rows are candidates each.  Empty tables give an empty result.  Scores are exact 64-bit
    integers (beyond 53 bits they are multiplied as such, which is slower).
    """
    spark = data.sparkSession
    queries = saved(queries.dropDuplicates(["_id"]), "queries")
    blocks = max(1, -(-queries.count() // BLOCK))
    path = scratch(spark, "partial")
    for b in range(blocks):
        rows = queries.where(F.pmod(F.xxhash64("_id"), F.lit(blocks)) == b).collect()
        block = spark.sparkContext.broadcast(_by_dimension([r[0] for r in rows], [r[1] for r in rows]))
        data.select("_id", "_v").mapInArrow(_search(block, k), "query_id long, vec_id long, score long").write.mode("append").parquet(path)
        block.unpersist()
    partial = spark.read.schema("query_id long, vec_id long, score long").parquet(path)
    best = Window.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    return partial.withColumn("rank", F.row_number().over(best).cast("int")).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
