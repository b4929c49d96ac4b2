"""Quality scores by Bradley-Terry pairwise ranking.

A text becomes a vector of plain statistics, each coded by the training quantile it falls in.  The weights maximise
the likelihood that a preferred text outscores a rejected one: logistic loss on differences of feature vectors.  The
threshold is the quantile of the training scores below which the labels put their share of rejected texts; the score
is the logistic of the distance to it, shifted so that the threshold reads `CUT`.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import by_bytes, saved, small_batches, with_columns
from lodestone.llm.shingles import words

#: Quantile codes per feature, rows of the rarer class in a bucket, steps at most, weight of the penalty.
CODES, BUCKET, STEPS, PENALTY = 16, 256, 12, 1e-4
#: Tasks of a step at most: each sends the driver one vector of sums (455 kB).
TASKS = 64
CUT = 0.3

_KIND = np.zeros(256, np.int64)
_KIND[[*range(0x41, 0x5B)]] = 1
_KIND[[*range(0x61, 0x7B)]] = 2
_KIND[[*range(0x30, 0x3A)]] = 3
_KIND[[ord(c) for c in "%&$*#!|@^~=+<>{}[]\\/_"]] = 4
_KIND[[ord(c) for c in ".,;:?'\"()-"]] = 5
_KIND[[0x20, *range(0x09, 0x0E)]] = 6
_KIND[0x80:] = 7
NAMES = ["words", "upper", "digits", "symbols", "marks", "foreign", "length", "distinct", "top", "pairs", "lines", "line_length", "closed", "deviation"]


def features(texts: list[bytes]) -> np.ndarray:
    """One row of statistics per text; texts without words are all zeros."""
    out = np.zeros((len(texts), len(NAMES)))
    hashes, starts, ends, counts = words(texts)
    first = np.cumsum(counts) - counts
    for i, (text, n, at) in enumerate(zip(texts, counts.tolist(), first.tolist())):
        if not n:
            continue
        kinds = np.bincount(_KIND[np.frombuffer(text, np.uint8)], minlength=8)
        solid = max(1, len(text) - kinds[6])
        own = hashes[at : at + n]
        length = (ends - starts)[at : at + n] if n else np.zeros(0)
        _, times = np.unique(own, return_counts=True)
        pairs = own[:-1] * np.uint64(3) + own[1:]
        lines = [x for x in text.split(b"\n") if x.strip()]
        closed = text.count(b".") + text.count(b"!") + text.count(b"?")
        out[i] = [
            np.log1p(n), kinds[1] / solid, kinds[3] / solid, kinds[4] / solid, kinds[5] / solid, kinds[7] / solid,
            length.mean(), np.log1p(len(times)) / np.log1p(n), times.max() / n, len(np.unique(pairs)) / len(pairs) if len(pairs) else 1.0,
            len(set(lines)) / max(1, len(lines)), np.log1p(n / max(1, len(lines))), closed / n, length.std(),
        ]
    return out


class Ranker:
    """Bradley-Terry model over coded features."""

    def __init__(self, edges: list[np.ndarray], weights: np.ndarray, cut: float, scale: float):
        self.edges, self.weights, self.cut, self.scale = edges, weights, cut, scale

    @staticmethod
    def code(x: np.ndarray, edges: list[np.ndarray]) -> np.ndarray:
        """One column per feature and code, one-hot, and one for its clipped size."""
        width = CODES + 1
        out = np.zeros((len(x), x.shape[1] * width), np.float32)
        for j, e in enumerate(edges):
            at = np.searchsorted(e, x[:, j], side="right")
            out[np.arange(len(x)), j * width + at] = 1
            low, high = (e[0], e[-1]) if len(e) else (0.0, 0.0)
            out[:, j * width + CODES] = np.clip((x[:, j] - low) / ((high - low) or 1.0), -1, 2)
        return out

    @classmethod
    def fit(cls, x: np.ndarray, good: np.ndarray) -> Ranker:
        """The model of rows that are at hand, by the steps that `train` takes over a table."""
        places = [quantiles(*np.unique(keys(x[:, j]), return_counts=True), np.arange(1, CODES) / CODES) for j in range(len(NAMES))]
        edges = [np.unique(e) if len(x) else np.zeros(1) for e in places]
        if good.all() or not good.any():
            return cls.flat(edges, bool(good.all()))
        weights = solved(edges, lambda w: slopes(x, good, edges, w))
        scores = cls.code(x, edges) @ weights
        shares, part = around(len(x), int((~good).sum()))
        return cls(edges, weights, float(quantiles(*np.unique(keys(scores), return_counts=True), shares) @ part), max(1e-6, float(scores.std()) / 2))

    @classmethod
    def flat(cls, edges: list[np.ndarray], keep: bool) -> Ranker:
        return cls(edges, np.zeros(len(NAMES) * (CODES + 1)), -np.inf if keep else np.inf, 1.0)

    def score(self, x: np.ndarray) -> np.ndarray:
        if np.isinf(self.cut):
            return np.full(len(x), 1.0 if self.cut < 0 else 0.0)
        z = (self.code(x, self.edges) @ self.weights - self.cut) / self.scale + np.log(CUT / (1 - CUT))
        return np.round(1 / (1 + np.exp(-np.clip(z, -500, 500))), 9)  # sums may differ in their last bits by batch


def held_out(id_col: str, folds: int, fold: int) -> F.Column:
    return F.coalesce(F.crc32(F.col(id_col).cast("string").cast("binary")) % folds == fold, F.lit(False))


def keys(x: np.ndarray) -> np.ndarray:
    """Numbers in the order of the values, equal for values within 1/4096 of each other: a bounded set, however many rows."""
    bits = np.ascontiguousarray(x + 0.0, np.float64).view(np.int64)
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits) >> 40


def quantiles(key: np.ndarray, times: np.ndarray, shares) -> np.ndarray:
    """The least values of the keys that the shares of all rows fall on."""
    if not len(key):
        return np.zeros(len(shares))
    total = np.cumsum(times)
    bits = key[np.searchsorted(total, np.asarray(shares) * total[-1]).clip(0, len(key) - 1)] << 40
    return np.where(bits < 0, bits ^ np.int64(0x7FFFFFFFFFFFFFFF), bits).view(np.float64)


def around(n: int, worse: int) -> tuple[list[float], np.ndarray]:
    """Shares that fall on the two rows of `n` between which the share of worse rows lies, and the part of each."""
    place = (n - 1) * (worse / n)
    low = int(place)
    return [(low + 0.5) / n, (min(low + 1, n - 1) + 0.5) / n], np.array([1 - (place - low), place - low])


def slopes(x: np.ndarray, good: np.ndarray, edges: list[np.ndarray], weights: np.ndarray) -> np.ndarray:
    """Number, first and second derivatives, summed over all pairs of a better and a worse row, as one vector."""
    size = len(weights)
    first, second, pairs = np.zeros(size), np.zeros((size, size)), 0
    better_rows, worse_rows = x[good], x[~good]
    for start in range(0, len(better_rows) if len(worse_rows) else 0, 4 * BUCKET):
        better = Ranker.code(better_rows[start : start + 4 * BUCKET], edges).astype(np.float64)
        for low in range(0, len(worse_rows), 4 * BUCKET):
            worse = Ranker.code(worse_rows[low : low + 4 * BUCKET], edges).astype(np.float64)
            p = 1 / (1 + np.exp(np.clip((better @ weights)[:, None] - (worse @ weights)[None, :], -30, 30)))
            q = p * (1 - p)
            both = better.T @ q @ worse
            first -= better.T @ p.sum(1) - worse.T @ p.sum(0)
            second += (better.T * q.sum(1)) @ better + (worse.T * q.sum(0)) @ worse - both - both.T
            pairs += p.size
    return np.concatenate([[pairs], first, second.ravel()])


def solved(edges: list[np.ndarray], sums) -> np.ndarray:
    """The weights by Newton's method; `sums` gives `slopes` over all rows."""
    size = len(NAMES) * (CODES + 1)
    weights = np.zeros(size)
    for _ in range(STEPS):
        got = sums(weights)
        pairs = max(1.0, got[0])
        step = np.linalg.solve(got[1 + size :].reshape(size, size) / pairs + PENALTY * np.eye(size), got[1 : 1 + size] / pairs + PENALTY * weights)
        step *= min(1.0, 2.0 / max(1e-12, np.abs(step).max()))
        weights = weights - step
        if np.abs(step).max() < 1e-5:
            break
    return np.round(weights, 9)  # sums may differ in their last bits by the order of tasks


def labelled(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, folds: int, fold: int) -> DataFrame:
    """`_id`, `_y` and statistics `_x` of all labelled documents outside the held-out fold; texts are measured where they are read, not shuffled."""
    own = lambda df: df.where(F.col(id_col).isNotNull() & ~held_out(id_col, folds, fold))
    known = own(labels).where(F.col(label).isNotNull()).groupBy(F.col(id_col).alias("_id")).agg(F.max(label).cast("int").alias("_y"))
    texts = own(docs).select(F.col(id_col).alias("_id"), F.col(text_col).cast("string").alias("_t"))
    kind = texts.schema["_id"].dataType.simpleString()
    return texts.mapInArrow(_measure, f"_id {kind}, _x array<double>").join(known, "_id").select("_id", "_y", "_x")


def _measure(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch, texts in by_bytes(batches, "_t"):
        x = features(texts)
        offsets = pa.array(np.arange(len(x) + 1, dtype=np.int32) * len(NAMES))
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(offsets, pa.array(x.ravel()))], ["_id", "_x"])


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(NAMES))


def _buckets(batches: Iterable[pa.RecordBatch]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Statistics and class of one whole bucket after another; the rows (bucket, class, statistics) of a bucket follow each other."""
    held, last = [], None
    for batch in batches:
        bucket, good, x = batch.column(0).to_numpy(), batch.column(1).to_numpy(zero_copy_only=False).astype(bool), _matrix(batch.column(2))
        bounds = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]]) if len(bucket) else []
        for low, high in zip(bounds[:-1], bounds[1:]):
            if held and bucket[low] != last:
                yield tuple(np.concatenate(c) for c in zip(*held))
                held = []
            held.append((x[low:high], good[low:high]))
            last = bucket[low]
    if held:
        yield tuple(np.concatenate(c) for c in zip(*held))


def _places(rows: DataFrame, values, columns: int, shares: list[float]) -> list[np.ndarray]:
    """`quantiles` of each column of what `values` computes of the statistics, counted over all rows."""

    def count(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [np.unique(keys(c), return_counts=True) for c in values(_matrix(batch.column(0))).T]
            column = np.repeat(np.arange(len(found)), [len(k) for k, _ in found])
            yield pa.RecordBatch.from_arrays([pa.array(column), *(pa.array(np.concatenate(c)) for c in zip(*found))], ["j", "k", "n"])

    counts = rows.select("_x").mapInArrow(count, "j long, k long, n long").groupBy("j", "k").agg(F.sum("n").alias("n"))
    total = F.sum("n").over(Window.partitionBy("j").orderBy("k"))
    whole = F.sum("n").over(Window.partitionBy("j"))
    ends = counts.select("j", "k", "n", total.alias("t"), whole.alias("w"))
    first = ends.select("j", *[F.when(F.col("t") >= F.lit(float(q)) * F.col("w"), F.col("k")).alias(f"q{i}") for i, q in enumerate(shares)])
    found = {r["j"]: [r[f"q{i}"] for i in range(len(shares))] for r in first.groupBy("j").agg(*[F.min(f"q{i}").alias(f"q{i}") for i in range(len(shares))]).collect()}
    return [np.array([quantiles(np.array([k]), np.array([1]), [1.0])[0] for k in found[j]]) for j in range(columns)]


def train(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label: str = "quality", folds: int = 5, fold: int = 0) -> Ranker:
    """Fitted on all labelled rows: quantiles are counted over all of them, and each is paired with all rows of the other class in its bucket.

    Buckets are dealt by the hash of the id and hold about `BUCKET` rows of the rarer class.  Where the other class has far more rows, those of a
    bucket are dealt over pieces, each with all of its rarer rows, so that no task holds more than about 16 times that many.  The driver only sees
    sums, one vector a task.
    """
    spark = docs.sparkSession
    small_batches(spark)
    rows = saved(labelled(docs, labels, label, id_col, text_col, folds, fold), "statistics")
    n, better = rows.agg(F.count(F.lit(1)), F.count_if(F.col("_y") > 0)).first()
    if not n:
        return Ranker.flat([np.zeros(1)] * len(NAMES), True)
    edges = [np.unique(e) for e in _places(rows, lambda x: x, len(NAMES), [i / CODES for i in range(1, CODES)])]
    if better in (0, n):
        return Ranker.flat(edges, better == n)
    rarer = min(better, n - better)
    buckets = max(1, rarer // BUCKET)
    pieces = max(1, (n - rarer) // (16 * BUCKET * buckets))
    good = F.col("_y") > 0
    every, one = F.sequence(F.lit(0), F.lit(pieces - 1)), F.array(F.pmod(F.xxhash64("_id", "_x"), F.lit(pieces)).cast("int"))
    piece = F.explode(F.when(good == F.lit(better == rarer), every).otherwise(one)).alias("_p")
    dealt = rows.select("_id", good.alias("_g"), "_x", piece).withColumn("_b", F.pmod(F.xxhash64("_id"), F.lit(buckets)) * pieces + F.col("_p"))
    parts = min(buckets * pieces, int(spark.conf.get("spark.sql.shuffle.partitions", "200")))
    dealt = dealt.repartition(parts, "_b").sortWithinPartitions("_b", "_id", "_x").select("_b", "_g", "_x").persist()

    def sums(weights: np.ndarray) -> np.ndarray:
        def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            out = np.zeros(1 + len(weights) + len(weights) ** 2)
            for x, good in _buckets(batches):
                out += slopes(x, good, edges, weights)
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["s"])

        tasks = min(TASKS, spark.sparkContext.defaultParallelism)
        return sum(np.frombuffer(r["s"]) for r in dealt.coalesce(tasks).mapInArrow(work, "s binary").collect())

    try:
        weights = solved(edges, sums)
    finally:
        dealt.unpersist()

    def scores(x: np.ndarray) -> np.ndarray:
        return np.round(Ranker.code(x, edges) @ weights, 9)[:, None]

    def moments(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([pa.array(scores(_matrix(batch.column(0)))[:, 0])], ["z"])

    shares, part = around(n, n - better)
    cut = _places(rows, scores, 1, shares)[0] @ part
    spread = rows.select("_x").mapInArrow(moments, "z double").agg(F.stddev_pop("z")).first()[0]
    return Ranker(edges, weights, float(cut), max(1e-6, round(float(spread), 9) / 2))


def score(docs: DataFrame, model: Ranker, text_col: str = "text") -> DataFrame:
    """`docs` with `_score` (0 to 1, higher: better; accepted from `CUT` on) of every whole text.

    Null and empty texts and texts without words get the score of all-zero statistics; rows are scored one by one,
    so repeated rows get the same score, and an empty table gives an empty one.  Without labels everything is kept.
    Other columns pass through, whatever their names; one named `_score` is replaced.
    """
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    return with_columns(docs, text_col, "_score double", lambda texts: [pa.array(shared.value.score(features(texts)))])
