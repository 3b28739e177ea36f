"""CRC-32 of many byte spans at once.

The register is linear in what it held before, so that of `a b` follows from those of
`a` and of `b` alone: the first is moved on by as many zero bytes as `b` has, which a
table does a byte at a time.
"""

from __future__ import annotations

from functools import cache
from zlib import crc32

import numpy as np

_ALL = np.uint32(0xFFFFFFFF)
#: Spans of more bytes are left to zlib, one by one.
_LONGEST = 48


@cache
def _table() -> np.ndarray:
    t = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        t = np.where(t & 1, (t >> np.uint32(1)) ^ np.uint32(0xEDB88320), t >> np.uint32(1))
    return t


@cache
def _moves() -> np.ndarray:
    """[n, k, b]: the register that holds only b, at its k-th byte, after n zero bytes."""
    t, x = _table(), np.arange(256, dtype=np.uint32)[None, :] << (8 * np.arange(4, dtype=np.uint32))[:, None]
    out = [x]
    for _ in range(_LONGEST):
        x = t[x & 255] ^ (x >> np.uint32(8))
        out.append(x)
    return np.stack(out)


def spans(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """CRC-32 of each span of `data`."""
    t, size = _table(), end - start
    out = np.full(len(start), _ALL, np.uint32)
    order = np.argsort(-size, kind="stable")
    long = int(np.searchsorted(-size[order], -_LONGEST, "left"))
    at, many = start[order], size[order]
    state = np.full(len(order), _ALL, np.uint32)
    for j in range(int(min(_LONGEST, many[long] if long < len(many) else 0))):
        n = int(np.searchsorted(-many, -j, "left"))  # those of more than j bytes
        now = state[long:n]
        state[long:n] = t[(now ^ data[at[long:n] + j]) & 255] ^ (now >> np.uint32(8))
    out[order] = state ^ _ALL
    for i in order[:long]:
        out[i] = crc32(data[start[i] : end[i]].tobytes())
    return out


def pairs(data: np.ndarray, start: np.ndarray, end: np.ndarray, crc: np.ndarray, first: np.ndarray) -> np.ndarray:
    """CRC-32 of span i, a space and span i + 1, for each i of `first`. crc: of each span."""
    moves, size = _moves(), end - start
    a, b, n = crc[first] ^ _ALL, crc[first + 1] ^ _ALL, size[first + 1]
    a = _table()[(a ^ np.uint32(32)) & 255] ^ (a >> np.uint32(8)) ^ _ALL
    m = np.minimum(n, _LONGEST)
    moved = moves[m, 0, a & 255] ^ moves[m, 1, (a >> np.uint32(8)) & 255] ^ moves[m, 2, (a >> np.uint32(16)) & 255] ^ moves[m, 3, a >> np.uint32(24)]
    out = moved ^ b ^ _ALL
    for i in np.flatnonzero(n > _LONGEST):
        k = first[i]
        out[i] = crc32(data[start[k + 1] : end[k + 1]].tobytes(), crc32(b" ", int(crc[k])))
    return out
