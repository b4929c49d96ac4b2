"""Patched frame-of-reference shards of token ids.

A shard is: magic; blocks; the block starts (u64 each); the document table (i64 id, u8 whether the id is null, u64
length); then the counts of blocks, documents and ids and the place of the index (u64 each).  A block of up to
`BLOCK` ids is: minimum u32, width u8, exceptions u16, ids u16; the ids less the minimum, `width` low bits each,
packed; the exceptions' positions (u16 each) and high bits (u32 each).  The width is that of the `PERCENTILE`-th
percentile of the block, so a few large ids don't widen all others.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import numpy as np

BLOCK, PERCENTILE = 4096, 90
MAGIC = b"PFORIDS1"
_HEAD, _TAIL = struct.Struct("<IBHH"), struct.Struct("<QQQQ")


def encode_block(ids: np.ndarray) -> bytes:
    """1 to `BLOCK` ids (u32)."""
    low = int(ids.min())
    rest = (ids - np.uint32(low)).astype(np.uint32)
    width = int(np.percentile(rest, PERCENTILE, method="higher")).bit_length()
    high = rest >> np.uint32(width) if width < 32 else np.zeros_like(rest)
    outliers = np.flatnonzero(high)
    if width == 16:
        packed = rest.astype("<u2").tobytes()
    else:
        bits = ((rest[:, None] >> np.arange(width, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        packed = np.packbits(bits, axis=None, bitorder="little").tobytes()
    return _HEAD.pack(low, width, len(outliers), len(ids)) + packed + outliers.astype("<u2").tobytes() + high[outliers].astype("<u4").tobytes()


def decode_block(data: bytes) -> np.ndarray:
    low, width, outliers, n = _HEAD.unpack_from(data)
    at = _HEAD.size
    size = -(-n * width // 8)
    if width == 16:
        ids = np.frombuffer(data, "<u2", n, at).astype(np.uint32)
    elif width:
        bits = np.unpackbits(np.frombuffer(data, np.uint8, size, at), count=n * width, bitorder="little").reshape(n, width)
        ids = np.zeros(n, np.uint32)
        for j in range(width):
            ids |= bits[:, j].astype(np.uint32) << np.uint32(j)
    else:
        ids = np.zeros(n, np.uint32)
    at += size
    where = np.frombuffer(data, "<u2", outliers, at)
    ids[where] |= np.frombuffer(data, "<u4", outliers, at + 2 * outliers) << np.uint32(width)
    return ids + np.uint32(low)


class Writer:
    def __init__(self, sink):
        self.sink, self.at, self.starts, self.docs, self.total = sink, 0, [], [], 0
        self.waiting: list[np.ndarray] = []
        self.held = 0
        self._put(MAGIC)

    def _put(self, data: bytes) -> None:
        self.sink.write(data)
        self.at += len(data)

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append((doc_id or 0, doc_id is None, len(ids)))
        self.waiting.append(ids)
        self.held += len(ids)
        self.total += len(ids)
        if self.held >= 64 * BLOCK:
            self._blocks(self.held // BLOCK * BLOCK)

    def _blocks(self, upto: int) -> None:
        every = np.concatenate(self.waiting)
        for at in range(0, upto, BLOCK):
            self.starts.append(self.at)
            self._put(encode_block(every[at : min(at + BLOCK, upto)]))
        self.waiting, self.held = [every[upto:]], self.held - upto

    def close(self) -> None:
        if self.held:
            self._blocks(self.held)
        place = self.at
        self._put(np.array(self.starts, "<u8").tobytes())
        self._put(np.array(self.docs, [("id", "<i8"), ("null", "u1"), ("n", "<u8")]).tobytes())
        self._put(_TAIL.pack(len(self.starts), len(self.docs), self.total, place))
        self.sink.close()


class Reader:
    def __init__(self, source):
        self.source = source
        size = source.size()
        source.seek(0)
        if source.read(len(MAGIC)) != MAGIC:
            raise ValueError("not a shard of token ids")
        source.seek(size - _TAIL.size)
        blocks, docs, self.total, place = _TAIL.unpack(source.read(_TAIL.size))
        source.seek(place)
        self.starts = np.append(np.frombuffer(source.read(8 * blocks), "<u8"), np.uint64(place)).astype(np.int64)
        self.docs = np.frombuffer(source.read(17 * docs), [("id", "<i8"), ("null", "u1"), ("n", "<u8")])

    def chunks(self, first: int = 0, blocks: int = 64) -> Iterator[np.ndarray]:
        """All ids from block `first` on, some blocks at a time."""
        for b in range(first, len(self.starts) - 1, blocks):
            edges = self.starts[b : b + blocks + 1]
            self.source.seek(int(edges[0]))
            data = self.source.read(int(edges[-1] - edges[0]))
            yield np.concatenate([decode_block(data[x - edges[0] : y - edges[0]]) for x, y in zip(edges[:-1], edges[1:])])

    def ids(self, start: int, n: int) -> np.ndarray:
        """`n` ids from the `start`-th on, by the index."""
        if not n:
            return np.empty(0, np.uint32)
        first, got = start // BLOCK, []
        have = -(start % BLOCK)
        for chunk in self.chunks(first, blocks=max(1, min(64, n // BLOCK + 2))):
            got.append(chunk)
            have += len(chunk)
            if have >= n:
                break
        return np.concatenate(got)[start % BLOCK :][:n]
