"""Benchmark passages in documents, by embedding edit distance into Hamming distance.

Texts are sequences of words (runs of ASCII letters, digits and non-ASCII characters, A-Z lower-cased).  A document
holds an item of m words if a stretch of it is within floor(`EDITS` * m) word edits of the whole item.

1. Windows of an item's length, at every start that can matter, and the items go through CGK random walks: each copies the
   current word to the next output place and then moves on or stays, as a random bit of (place, word) says, so that
   strings at a small edit distance get outputs at a small Hamming distance.  `SAMPLES` times per walk, `BITS` places are
   sampled; a window and an item that agree in all of a sample are a candidate pair.  The number of walks follows from
   the length: as many as find `RECALL` of simulated windows with the most edits allowed.
2. Starts that can't matter are pruned by shared q-grams: at most e edits leave m - q + 1 - q * e of an item's q-grams in
   place, on alignments that differ by e at most.  This loses nothing.
3. Candidates are confirmed by the exact edit distance between the item and any stretch of the document around.
"""

from __future__ import annotations

from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.llm.common import saved, small_batches, unused, with_columns
from lodestone.llm.shingles import mix, words

EDITS, GRAM, SAMPLES, BITS = 0.2, 3, 4, 2
#: Share of simulated windows that the walks find, pairs simulated, walks added at a time and at most.
RECALL, SIMULATED, STEP, MOST = 0.99, 100, 6, 96
#: Items per pass over the documents.
BLOCK = 5_000
#: Windows embedded at once.
WINDOWS = 2_048

_BREAK = np.ones(256, bool)
_BREAK[[*range(0x30, 0x3A), *range(0x41, 0x5B), *range(0x61, 0x7B), *range(0x80, 0x100)]] = False
_SEEDS = np.random.default_rng(424242).integers(0, 1 << 63, MOST, np.uint64)
_FACTORS = np.random.default_rng(171717).integers(0, 1 << 63, 8, np.uint64) * np.uint64(2) + np.uint64(1)


def allowed(m: int) -> int:
    return int(EDITS * m + 1e-9)


def gram_of(m: int) -> int:
    """The longest q up to `GRAM` such that `allowed(m)` edits can't break all q-grams of m words."""
    e = allowed(m)
    return max(1, min(GRAM, (m - e) // (e + 1)))


def _grams(hashes: np.ndarray, q: int) -> np.ndarray:
    n = max(0, len(hashes) - q + 1)
    value = np.full(n, q, np.uint64)
    for j in range(q):
        value += hashes[j : j + n] * _FACTORS[j]
    return mix(value)


def embed(strings: np.ndarray, walk: int) -> np.ndarray:
    """CGK outputs, three times as long, of equally long strings (one per row)."""
    n, m = strings.shape
    padded = np.concatenate([strings, np.zeros((n, 1), np.uint64)], axis=1)
    at, row = np.zeros(n, np.int64), np.arange(n)
    out = np.empty((n, 3 * m), np.uint64)
    for t in range(3 * m):
        word = padded[row, at]
        out[:, t] = word
        salt = np.uint64((int(_SEEDS[walk]) + t * 0x9E3779B97F4A7C15) % (1 << 64))
        step = (mix(word ^ salt) >> np.uint64(63)).astype(np.int64)
        at = np.minimum(at + step, m)
    return out


def keys(strings: np.ndarray, first: int, last: int) -> np.ndarray:
    """One LSH key per string (rows) and repetition (columns) of some walks: a hash of the sampled places."""
    m = strings.shape[1]
    out = []
    for walk in range(first, last):
        embedded = embed(strings, walk)
        rng = np.random.default_rng([walk, m])
        for sample in range(SAMPLES):
            value = np.full(len(strings), 1 + sample + SAMPLES * walk, np.uint64)
            for b, place in enumerate(rng.choice(2 * m, min(BITS, 2 * m), replace=False)):
                value += embedded[:, place] * _FACTORS[b]
            out.append(mix(value))
    return np.stack(out, axis=1)


def edited(words: list[int], edits: int, rng: np.random.Generator) -> list[int]:
    """After so many random substitutions, insertions and deletions."""
    out = list(words)
    for kind in rng.integers(3, size=edits).tolist():
        at, new = int(rng.integers(len(out))), int(rng.integers(1 << 62))
        out[at : at + (kind != 0)] = [new] if kind < 2 or len(out) == 1 else []
    return out


@cache
def _walks(m: int) -> int:
    rng = np.random.default_rng(m)
    items = rng.integers(1 << 62, size=(SIMULATED, m))
    windows = np.array([(edited(a, allowed(m), rng) + rng.integers(1 << 62, size=m).tolist())[:m] for a in items.tolist()], np.uint64)
    found = np.zeros(SIMULATED, bool)
    for first in range(0, MOST, STEP):
        found |= (keys(items.astype(np.uint64), first, first + STEP) == keys(windows, first, first + STEP)).any(axis=1)
        if found.mean() >= RECALL:
            return first + STEP
    return MOST


def walks(m: int) -> int:
    """Walks for items of m words, as simulated at the next length of a rough scale."""
    size = 4
    while size < m:
        size += size // 2
    return _walks(size)


def distance(item: np.ndarray, stretch: np.ndarray) -> int:
    """Least edit distance between the item and any stretch of consecutive words."""
    n = len(stretch)
    above, index = np.zeros(n + 1, np.int64), np.arange(n + 1)
    for i, word in enumerate(item.tolist()):
        row = np.empty(n + 1, np.int64)
        row[0] = i + 1
        row[1:] = np.minimum(above[:-1] + (stretch != np.uint64(word)), above[1:] + 1)
        above = np.minimum.accumulate(row - index) + index
    return int(above.min())


class Items:
    """A block of benchmark items with their gram index and LSH keys."""

    def __init__(self, rows: list[tuple[int, str]]):
        self.ids, self.words = [], []
        for item, text in rows:
            own = words([text.encode()], _BREAK)[0]
            if len(own):
                self.ids.append(item)
                self.words.append(own)
        self.index: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = {}
        found: dict[int, list] = {}
        for i, own in enumerate(self.words):
            q = gram_of(len(own))
            value = _grams(own, q)
            found.setdefault(q, []).append((value, np.full(len(value), i), np.arange(len(value))))
        for q, parts in found.items():
            value, item, offset = (np.concatenate([p[j] for p in parts]) for j in range(3))
            order = np.argsort(value, kind="stable")
            quick = np.zeros(1 << 20, bool)
            quick[value >> np.uint64(44)] = True
            self.index[q] = (value[order], item[order], offset[order], quick)
        self.tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for m in {len(own) for own in self.words}:
            same = np.array([i for i, own in enumerate(self.words) if len(own) == m])
            value = keys(np.stack([self.words[i] for i in same]), 0, walks(m))
            order = np.argsort(value.ravel(), kind="stable")
            self.tables[m] = (value.ravel()[order], np.repeat(same, value.shape[1])[order])

    def hits(self, hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """Columns text, item, alignment (word of the text where the item would start), in this order sorted."""
        text, first = np.repeat(np.arange(len(counts)), counts), np.cumsum(counts) - counts
        out = []
        for q, (value, item, offset, quick) in self.index.items():
            grams = _grams(hashes, q)
            at = np.flatnonzero(quick[grams >> np.uint64(44)])
            low, high = np.searchsorted(value, grams[at], "left"), np.searchsorted(value, grams[at], "right")
            at, low, n = at[high > low], low[high > low], (high - low)[high > low]
            inside = text[at] == text[np.minimum(at + q - 1, len(text) - 1)] if len(at) else np.empty(0, bool)
            at, low, n = at[inside], low[inside], n[inside]
            entry = np.repeat(low, n) + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
            at = np.repeat(at, n)
            out.append(np.stack([text[at], item[entry], at - first[text[at]] - offset[entry]]))
        rows = np.concatenate(out, axis=1) if out else np.empty((3, 0), np.int64)
        return rows[:, np.lexsort(rows[::-1])]

    def alike(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(window, item) pairs that agree in a sample, by the LSH table of the windows' length."""
        value, item = self.tables[windows.shape[1]]
        own = keys(windows, 0, walks(windows.shape[1]))
        low, high = np.searchsorted(value, own.ravel(), "left"), np.searchsorted(value, own.ravel(), "right")
        n = high - low
        entry = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        pairs = np.unique(np.repeat(np.arange(own.size) // own.shape[1], n) * len(self.ids) + item[entry])
        return pairs // len(self.ids), pairs % len(self.ids)

    def starts(self, hashes: np.ndarray, counts: np.ndarray) -> dict[int, np.ndarray]:
        """By item length: columns text, start, item, of the windows that the q-grams leave possible."""
        rows, out = self.hits(hashes, counts), {}
        if not rows.shape[1]:
            return {}
        edge = np.flatnonzero(np.concatenate(([True], (rows[:2, 1:] != rows[:2, :-1]).any(axis=0))))
        for a, b in zip(edge.tolist(), [*edge[1:].tolist(), rows.shape[1]]):
            t, i = int(rows[0, a]), int(rows[1, a])
            m, q, e = len(self.words[i]), gram_of(len(self.words[i])), allowed(len(self.words[i]))
            need, alignment = max(1, m - q + 1 - q * e), rows[2, a:b]
            dense = np.flatnonzero(alignment[need - 1 :] - alignment[: max(0, len(alignment) - need + 1)] <= e)
            if len(dense):
                member = np.zeros(len(alignment) + 1, np.int64)
                np.add.at(member, dense, 1)
                np.add.at(member, dense + need, -1)
                at = np.unique(np.clip(alignment[np.cumsum(member[:-1]) > 0], 0, max(0, int(counts[t]) - m)))
                out.setdefault(m, []).append(np.stack([np.full(len(at), t), at, np.full(len(at), i)]))
        return {m: np.concatenate(parts, axis=1) for m, parts in out.items()}

    def find(self, texts: list[bytes]) -> list[list[int]]:
        """The ids of the items that each text holds, ascending."""
        hashes, _, _, counts = words(texts, _BREAK)
        first, held = np.cumsum(counts) - counts, [set() for _ in texts]
        longest = max(map(len, self.words), default=0)
        padded = np.concatenate([hashes, np.zeros(longest, np.uint64)])
        for m, possible in self.starts(hashes, counts).items():
            places, which = np.unique(possible[:2], axis=1, return_inverse=True)
            allowed_ = np.unique(which.ravel() * len(self.ids) + possible[2])
            done: dict[tuple[int, int], int] = {}
            for low in range(0, places.shape[1], WINDOWS):
                t, at = places[:, low : low + WINDOWS]
                windows = padded[(first[t] + at)[:, None] + np.arange(m)]
                windows[np.arange(m) >= (counts[t] - at)[:, None]] = 0  # of shorter texts
                window, item = self.alike(windows)
                near = np.isin((window + low) * len(self.ids) + item, allowed_)
                for w, i in zip(window[near].tolist(), item[near].tolist()):
                    self._confirm(hashes[first[t[w]] : first[t[w]] + counts[t[w]]], int(t[w]), int(at[w]), i, held, done)
        return [sorted(h) for h in held]

    def _confirm(self, text: np.ndarray, t: int, at: int, i: int, held: list[set[int]], done: dict[tuple[int, int], int]) -> None:
        """Adds the item to what the text holds if a stretch around the window is near enough; windows come in order."""
        e = allowed(len(self.words[i]))
        if self.ids[i] in held[t] or at <= done.get((t, i), -1):
            return
        if distance(self.words[i], text[max(0, at - 2 * e) : at + len(self.words[i]) + 2 * e]) <= e:
            held[t].add(self.ids[i])
        done[t, i] = at + e


def held_items(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text") -> DataFrame:
    """`docs` with `_items`, the ids of the benchmark items that each whole text holds, ascending.

    Items go out `BLOCK` at a time, each block in a pass of its own over the texts, saved before the next, so what tasks
    and the driver hold does not follow the benchmark's size.  Null texts hold nothing; items without words, with null
    text or null id are held by nothing; repeated rows and repeated items count like one; empty tables give empty lists
    or rows.  Other columns pass through, whatever their names; one named `_items` is replaced.
    """
    spark = docs.sparkSession
    small_batches(spark)
    items = benchmark.where(F.col(item_col).isNotNull() & F.col(item_text).isNotNull()).select(F.col(item_col).cast("long").alias("_i"), F.col(item_text).cast("string").alias("_x"))
    blocks = max(1, -(-items.count() // BLOCK))
    (before,) = unused(docs, "_before")
    out = docs
    for b in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("_i", "_x"), F.lit(blocks)) == b).collect()
        shared = spark.sparkContext.broadcast(Items(sorted(map(tuple, rows))))
        if b:
            out = out.withColumnRenamed("_items", before)
        out = with_columns(out, text_col, "_items array<long>", lambda texts, shared=shared: [pa.array(shared.value.find(texts), pa.list_(pa.int64()))])
        if b:
            out = out.withColumn("_items", F.array_sort(F.array_union(before, "_items"))).drop(before)
        if b < blocks - 1:
            out = saved(out, "searched")
            shared.destroy()
    return out
