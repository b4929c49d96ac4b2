"""Hashes of words and word shingles of whole texts, a batch of texts at a time in numpy."""

from __future__ import annotations

import numpy as np

#: Bytes that end a word, and the lower-casing of A-Z.
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
LOWER = bytes(b + 32 if 65 <= b <= 90 else b for b in range(256))

_RANDOM = np.random.default_rng(987654321)
_BYTE = _RANDOM.integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)
_PLACE = _RANDOM.integers(0, 1 << 63, 64, np.uint64) * np.uint64(2) + np.uint64(1)
_BASE = 0x9E3779B97F4A7C15
_BACK = pow(_BASE, -1, 1 << 64)
_powers = {_BASE: np.ones(1, np.uint64), _BACK: np.ones(1, np.uint64)}


def _power(base: int, n: int) -> np.ndarray:
    if len(_powers[base]) < n:
        steps = np.full(max(n, 1 << 16), base, np.uint64)
        steps[0] = 1
        _powers[base] = np.multiply.accumulate(steps)
    return _powers[base][:n]


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(33))
    h = h * np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h = h * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def words(texts: list[bytes], space: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Hash, start and end of every word of the lower-cased texts (joined by single spaces), and words per text."""
    data = np.frombuffer((b" ".join(texts) + b" ").translate(LOWER), np.uint8)
    space = space[data]
    edge = np.diff(np.concatenate(([True], space)).astype(np.int8))
    starts = np.flatnonzero(edge == -1)
    ends = np.flatnonzero(edge == 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * _power(_BASE, len(data)), out=total[1:])
    hashes = mix((total[ends] - total[starts]) * _power(_BACK, len(data))[starts])
    bounds = np.cumsum([len(t) + 1 for t in texts])
    return hashes, starts, ends, np.diff(np.searchsorted(starts, bounds), prepend=0)


def shingles(texts: list[bytes], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles in order of the texts, and their number per text (not distinct yet).

    A text of fewer words gives one shingle, the whole sequence; a text without words gives none.
    """
    hashes, _, _, counts = words(texts)
    first = np.cumsum(counts) - counts
    full = np.maximum(counts - k + 1, 0)
    which = np.repeat(np.arange(len(texts)), full)
    at = np.arange(len(which)) - np.repeat(np.cumsum(full) - full, full) + first[which]
    value = np.zeros(len(at), np.uint64)
    for j in range(k):
        value += hashes[at + j] * _PLACE[j]
    value = mix(value)
    short = np.flatnonzero((counts > 0) & (counts < k))
    if len(short):
        whole = [mix((hashes[first[i] : first[i] + counts[i]] * _PLACE[: counts[i]]).sum(keepdims=True) + np.uint64(counts[i]))[0] for i in short]
        value = np.insert(value, (np.cumsum(full) - full)[short], whole)
        full[short] = 1
    return value, full


def sets(texts: list[bytes], k: int) -> list[np.ndarray]:
    """The distinct shingle hashes of every text, ascending."""
    value, counts = shingles(texts, k)
    return [np.unique(part) for part in np.split(value, np.cumsum(counts)[:-1])] if len(texts) else []
