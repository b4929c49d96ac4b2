"""Packing of documents into token-budget batches inside optimal length buckets.

A dynamic program over the global histogram of lengths chooses the bucket boundaries that minimise padding (every
document is padded to its bucket's boundary).  The histogram holds each distinct length; these are at most about the square
root of twice the corpus' tokens.  Inside a bucket a batch holds budget // boundary documents.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm.common import saved

#: Buckets, padded tokens per batch, documents of a bucket that are numbered together.
BUCKETS, BUDGET, LOT = 16, 32_768, 4096
#: Lengths up to this stay as they are in `rounded`, longer ones go in steps of 1/`EXACT` of a power of two.
EXACT = 256


def n_words(text: F.Column) -> F.Column:
    """Default length of a document: its words, separated by ASCII white space."""
    return F.regexp_count(F.coalesce(text.cast("string"), F.lit("")), F.lit(r"[^\x20\x09-\x0D]+")).cast("long")


def rounded(length: F.Column) -> F.Column:
    """Length rounded up, with a relative error below 1 / `EXACT`; `pack` takes exact lengths."""
    step = F.greatest(F.lit(1), F.pow(F.lit(2.0), F.floor(F.log2(F.greatest(length, F.lit(1)).cast("double"))) - int(np.log2(EXACT)))).cast("long")
    return F.when(length <= EXACT, length).otherwise(F.ceil(length / step).cast("long") * step)


def _least(cost: np.ndarray, size: np.ndarray, count: np.ndarray, total: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Per j from 1 on, the least cost[i] plus padding of a bucket (i, j], and the first such i.

    That i never falls as j grows (padding satisfies the quadrangle inequality), so every second j is searched between
    the results of its neighbours, level by level.
    """
    m = len(size)
    value, first = np.zeros(m + 1, np.int64), np.zeros(m + 2, np.int64)
    first[m + 1] = m
    step = 1 << m.bit_length()
    while step:
        j = np.arange(step, m + 1, 2 * step)
        low, high = first[j - step], np.minimum(first[np.minimum(j + step, m + 1)], j - 1)
        room = high - low + 1
        start = np.cumsum(room) - room
        i = np.arange(room.sum()) - np.repeat(start - low, room)
        at = np.repeat(j, room)
        tried = cost[i] + size[at - 1] * (count[at] - count[i]) - (total[at] - total[i])
        if len(j):
            value[j] = np.minimum.reduceat(tried, start)
            hit = np.flatnonzero(tried == value[at])
            first[j] = i[hit[np.unique(at[hit], return_index=True)[1]]]
        step //= 2
    return value, first[: m + 1]


def boundaries(lengths: np.ndarray, counts: np.ndarray, buckets: int) -> list[int]:
    """At most `buckets` upper bounds, among `lengths` (ascending), with the least total padding; exact.

    cost[j] after b buckets is the least padding of lengths up to j; a last bucket (i, j] pads
    lengths[j] * (count up to j - count up to i) - (tokens up to j - tokens up to i).
    """
    m = len(lengths)
    if not m:
        return []
    size, count = lengths.astype(np.int64), np.concatenate(([0], np.cumsum(counts, dtype=np.int64)))
    total = np.concatenate(([0], np.cumsum(size * counts, dtype=np.int64)))
    cost, choice = np.concatenate(([0], size * count[1:] - total[1:])), [np.zeros(m + 1, np.int64)]
    for _ in range(2, min(buckets, m) + 1):
        cost, first = _least(cost, size, count, total)
        choice.append(first)
    bounds, j = [], m
    while j > 0:
        bounds.append(int(lengths[j - 1]))
        j = int(choice.pop()[j])
    return bounds[::-1]


def pack(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: F.Column | None = None, buckets: int = BUCKETS, budget: int = BUDGET) -> DataFrame:
    """`docs` with `n_tokens`, `bucket_length` (boundary), `lot`, `batch` (number in bucket and lot) and `padding`.

    Lots deal the documents of a bucket by hash of the id, about `LOT` together, so no bucket meets in one task; only the last
    batch of a lot may be short.  A document longer than the budget is a batch of its own.  Null and empty texts have
    length 0 and share the batches of the lowest bucket; null ids and repeated rows are documents like others; a
    column named like an added one is replaced; an empty table gives an empty one.
    """
    added = ("n_tokens", "bucket_length", "lot", "batch", "padding")
    length = n_words(F.col(text_col)) if length is None else length
    sized = docs.withColumn("n_tokens", length.cast("long"))
    histogram = sorted((r["n_tokens"], r["n"]) for r in sized.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n")).collect())
    lengths, counts = np.array([h[0] for h in histogram], np.int64), np.array([h[1] for h in histogram], np.int64)
    bounds = boundaries(lengths, counts, buckets)
    upto = np.searchsorted(lengths, bounds, side="right")
    lots = [max(1, -(-int(n) // LOT)) for n in np.diff(np.concatenate(([0], np.concatenate(([0], np.cumsum(counts)))[upto])))] if bounds else []
    bound, lot = F.lit(bounds[-1] if bounds else 0), F.lit(1)
    for b, n in list(zip(bounds, lots))[::-1]:
        bound, lot = F.when(F.col("n_tokens") <= b, b).otherwise(bound), F.when(F.col("n_tokens") <= b, n).otherwise(lot)
    dealt = sized.withColumn("bucket_length", bound.cast("long")).withColumn("lot", F.pmod(F.crc32(F.coalesce(F.col(id_col).cast("string"), F.lit("")).cast("binary")), lot).cast("long"))
    order = Window.partitionBy("bucket_length", "lot").orderBy(F.col(id_col).asc_nulls_first(), "n_tokens")
    capacity = F.greatest(F.lit(1), F.floor(F.lit(budget) / F.greatest(F.col("bucket_length"), F.lit(1)))).cast("long")
    out = dealt.withColumn("batch", F.floor((F.row_number().over(order) - 1) / capacity).cast("long")).withColumn("padding", F.col("bucket_length") - F.col("n_tokens"))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in added], *added)
