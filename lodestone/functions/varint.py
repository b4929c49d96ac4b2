"""Integer lists as base64 varints, plain or as ascending differences: an exchange format for small lists.

Tables use Parquet's own encodings instead.
"""

from __future__ import annotations

import base64
from collections.abc import Iterable
from itertools import accumulate, pairwise

#: The greatest integer that a double holds exactly. A fixed value.
GREATEST = 2**53 - 1


def encode(values: Iterable[int], delta: bool = False) -> str:
    values = list(values)
    if any(not 0 <= v <= GREATEST for v in values):
        raise ValueError("values are integers from 0 to 2^53 - 1")
    if delta:
        if any(b < a for a, b in pairwise(values)):
            raise ValueError("differences need ascending values")
        values = values[:1] + [b - a for a, b in pairwise(values)]
    out = bytearray()
    for v in values:
        groups = [v >> s & 0x7F for s in range(0, max(1, v.bit_length()), 7)]
        out += bytes([g | 0x80 for g in groups[:-1]] + groups[-1:])
    return base64.b64encode(bytes(out)).decode()


def decode(text: str, delta: bool = False) -> list[int]:
    out, value, shift = [], 0, 0
    for byte in base64.b64decode(text):
        value |= (byte & 0x7F) << shift
        shift += 7
        if byte < 0x80:
            out.append(value)
            value, shift = 0, 0
        elif shift > 56:
            raise ValueError("a varint is too long")
    if shift:
        raise ValueError("the last varint is cut off")
    return list(accumulate(out)) if delta else out
