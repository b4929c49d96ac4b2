"""Suffix arrays by induced sorting, with whole buckets handled as numpy batches.

`suffix_array` classifies suffixes, sorts the leftmost-smaller (LMS) substrings, names them, sorts the reduced
string and induces the array from its order.  A batch is one bucket's run of entries, so the number of Python
steps follows the alphabet, not the text.  A reduced string over a small alphabet recurses; one over a large
alphabet (where buckets hold a few entries each) is finished by rank doubling, which needs few rounds because a
name already spans a whole LMS substring.
"""

from __future__ import annotations

import numpy as np

#: Alphabets up to this size are induced bucket by bucket.
BUCKETS = 1024


def suffix_array(text: np.ndarray) -> np.ndarray:
    """Positions of the suffixes of `text` (non-negative integers) in lexicographic order; an end sorts first."""
    if len(text) == 0:
        return np.empty(0, np.int64)
    s = np.empty(len(text) + 1, np.int32)
    s[:-1] = text
    s[:-1] += 1
    s[-1] = 0
    return _sort(s, int(s.max()) + 1)[1:]


def _sort(s: np.ndarray, size: int) -> np.ndarray:
    """`s` ends in a unique smallest symbol 0."""
    if len(s) == 1:
        return np.zeros(1, np.int64)
    if size > BUCKETS:
        return _double(s)
    smaller = _types(s)
    lms = np.flatnonzero(smaller[1:] & ~smaller[:-1]) + 1
    order = _induce(s, size, smaller, lms)
    is_lms = np.zeros(len(s), bool)
    is_lms[lms] = True
    order = order[is_lms[order]]
    names = _name(s, lms, order)
    if names[-1] + 1 < len(lms):
        at = np.empty(len(s), np.int32)
        at[order] = names
        order = lms[_sort(at[lms], int(names[-1]) + 1)]
    return _induce(s, size, smaller, order)


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than the next one."""
    n = len(s)
    step = np.where(s[:-1] == s[1:], n, np.arange(n - 1))
    step = np.minimum.accumulate(step[::-1])[::-1]
    smaller = np.ones(n, bool)
    smaller[:-1] = (s[:-1] < s[1:])[step]
    return smaller


def _runs(sorted_values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    first = np.flatnonzero(np.concatenate(([True], sorted_values[1:] != sorted_values[:-1])))
    return first, np.diff(np.append(first, len(sorted_values)))


def _induce(s: np.ndarray, size: int, smaller: np.ndarray, lms: np.ndarray) -> np.ndarray:
    n = len(s)
    counts = np.bincount(s, minlength=size)
    ends = np.cumsum(counts)
    starts = ends - counts
    out = np.full(n, -1, np.int64)
    narrow = s.astype(np.uint16) if size <= 1 << 16 else s

    def place(entries: np.ndarray, want_smaller: bool, edge: np.ndarray, sign: int) -> None:
        before = entries[entries > 0] - 1
        before = before[smaller[before] == want_smaller]
        if not len(before):
            return
        symbol = narrow[before]
        by = np.argsort(symbol, kind="stable")
        before, symbol = before[by], symbol[by]
        first, lengths = _runs(symbol)
        rank = np.arange(len(before)) - np.repeat(first, lengths)
        to = edge[symbol] + rank if sign > 0 else edge[symbol] - 1 - rank
        out[to] = before
        edge[symbol[first]] += sign * lengths

    symbols = narrow[lms]
    by = np.argsort(symbols, kind="stable")
    grouped = lms[by]
    upto = np.cumsum(np.bincount(symbols, minlength=size))
    head = starts.copy()
    used = np.flatnonzero(counts)
    for c in used:
        at = starts[c]
        while at < head[c]:
            at, entries = head[c], out[at : head[c]]
            place(entries, False, head, 1)
        place(grouped[upto[c - 1] if c else 0 : upto[c]], False, head, 1)
    tail = ends.copy()
    out[0], tail[0] = n - 1, 0
    for c in used[::-1]:
        at = ends[c]
        while tail[c] < at:
            at, entries = tail[c], out[tail[c] : at][::-1]
            place(entries, True, tail, -1)
        place(out[starts[c] : head[c]][::-1], True, tail, -1)
    return out


def _name(s: np.ndarray, lms: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Ranks of the LMS substrings in their sorted order; equal substrings share a rank."""
    length = np.zeros(len(s), np.int64)
    length[lms[:-1]] = np.diff(lms) + 1
    length[lms[-1]] = 1
    a, b = order[:-1], order[1:]
    same = length[a] == length[b]
    left = np.flatnonzero(same)
    t = 0
    while len(left):
        differ = s[a[left] + t] != s[b[left] + t]
        same[left[differ]] = False
        t += 1
        left = left[~differ]
        left = left[length[a[left]] > t]
    return np.concatenate(([0], np.cumsum(~same)))


def _double(s: np.ndarray) -> np.ndarray:
    """Rank doubling; only positions whose rank is still shared are sorted again."""
    n = len(s)
    order = np.argsort(s, kind="stable")
    first, lengths = _runs(s[order])
    rank = np.empty(n + 1, np.int64)
    rank[order] = np.repeat(first, lengths)
    rank[n] = 0
    left = order[np.repeat(lengths > 1, lengths)]
    h = 1
    while len(left):
        key = (rank[left] << 32) | rank[np.minimum(left + h, n)]
        by = np.argsort(key, kind="stable")
        left, key = left[by], key[by]
        old = rank[left]
        group, size = _runs(old)
        part, lengths = _runs(key)
        new = old + np.repeat(part, lengths) - np.repeat(group, size)
        rank[left] = new
        left = left[np.repeat(lengths > 1, lengths)]
        h *= 2
    out = np.empty(n, np.int64)
    out[rank[:n]] = np.arange(n)
    return out


def repeated(text: np.ndarray, length: int, step: int = 16) -> np.ndarray:
    """Whether the `length` symbols from each position of a byte text also start elsewhere in it.

    Permuted common prefixes are read at every `step`-th position; as they fall by one at most from a position to
    the next, most positions in between follow from these, and the others are compared from the bound on.
    """
    n = len(text)
    out = np.zeros(n, bool)
    if n <= length:
        return out
    order = suffix_array(text)
    before = np.full(n, -1, np.int64)
    before[order[1:]] = order[:-1]
    padded = np.zeros(n + length + step + 16, np.uint8)
    padded[:n] = text
    words = np.ndarray(shape=(len(padded) - 7,), dtype="<u8", buffer=padded.data, strides=(1,))
    most = length + step

    def common(at: np.ndarray, known: np.ndarray) -> np.ndarray:
        """min(common prefix with the preceding suffix, `most`), from `known` symbols on."""
        got = np.minimum(known, most)
        other = before[at]
        bound = np.where(other < 0, 0, np.minimum(n - np.maximum(at, other), most))
        got = np.minimum(got, bound)
        live = np.flatnonzero(got < bound)
        while len(live):
            x = words[at[live] + got[live]] ^ words[other[live] + got[live]]
            full = x == 0
            low = x & (~x + np.uint64(1))
            same = np.where(full, 8, (np.log2(np.maximum(low, 1).astype(np.float64)) // 8).astype(np.int64))
            got[live] += same
            live = live[full & (got[live] < bound[live])]
        return np.minimum(got, bound)

    sampled = np.arange(0, n, step)
    values = common(sampled, np.zeros(len(sampled), np.int64))
    after = np.append(values[1:], 0)
    position = np.arange(n)
    offset = position % step
    low = np.maximum(np.repeat(values, step)[:n] - offset, 0)
    high = np.repeat(after, step)[:n] + step - offset
    out[low >= length] = True
    open_ = np.flatnonzero((low < length) & (high >= length) & (offset > 0) & (position + length <= n))
    out[open_] = common(open_, low[open_]) >= length
    hit = np.flatnonzero(out)
    out[before[hit]] = True
    return out
