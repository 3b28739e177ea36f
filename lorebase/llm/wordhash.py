"""Words of many texts as arrays of 64-bit hashes, by numpy over UTF-8 bytes.

A word's hash is a polynomial over its bytes, each byte first mapped to a random
64-bit number; prefix sums give it for all words of a slice at once.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

_RADIX = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_RADIX, -1, 1 << 64)
_BYTE = np.random.default_rng(20240501).integers(1, 1 << 63, 256, dtype=np.uint64)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32

#: Bytes that end a word: white space, or all of ASCII but digits and letters.
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
NOT_ALNUM = np.ones(256, bool)
NOT_ALNUM[128:] = NOT_ALNUM[48:58] = NOT_ALNUM[97:123] = NOT_ALNUM[65:91] = False

_powers: dict[str, np.ndarray] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers.get("up", ())) < n:
        m = max(n, 1 << 20) + 1
        for key, x in (("up", _RADIX), ("down", _INVERSE)):
            base = np.full(m, x, np.uint64)
            base[0] = 1
            _powers[key] = np.multiply.accumulate(base)
    return _powers["up"], _powers["down"]


def mix(x: np.ndarray) -> np.ndarray:
    """Spread every bit of a 64-bit number over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def spans_hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Hash of each byte span; equal spans have equal hashes wherever they stand."""
    up, down = powers(len(data) + 1)
    total = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(_BYTE[data] * up[: len(data)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


def sequence_hash(items: np.ndarray, starts: np.ndarray, ends: np.ndarray, salt: int) -> np.ndarray:
    """Hash of each run of hashed items, as a polynomial over them."""
    up, down = powers(len(items) + 1)
    total = np.zeros(len(items) + 1, np.uint64)
    np.cumsum(mix(items + np.uint64(salt)) * up[: len(items)], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(np.uint64))


@dataclass
class Words:
    """hash, start and end byte (in the slice) and text number of each word; first: index of each text's first word, and the end."""

    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    doc: np.ndarray
    first: np.ndarray
    data: np.ndarray


def bounds(inside: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true bytes; no run crosses from one text to the next."""
    if not len(inside):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cut = offsets[1:-1]
    cut = cut[(cut > 0) & (cut < len(inside))]
    begin[cut] = inside[cut]
    end[cut - 1] = inside[cut - 1]
    return np.flatnonzero(begin), np.flatnonzero(end) + 1


def words(data: np.ndarray, offsets: np.ndarray, apart: np.ndarray = SPACE, lower: bool = True) -> Words:
    """Words between bytes of `apart`, A-Z lowered if `lower`."""
    data = LOWER[data] if lower else data
    start, end = bounds(~apart[data], offsets)
    h = spans_hash(data, start, end)
    first = np.searchsorted(start, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(first))
    return Words(h, start, end, doc, first, data)


def windows(w: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of k words from each word on, and whether all k stand in its text."""
    n = len(w.hash)
    if n < k:
        return np.zeros(n, np.uint64), np.zeros(n, bool)
    h = np.zeros(n, np.uint64)
    m = n - k + 1
    acc = np.zeros(m, np.uint64)
    for i in range(k):
        acc = acc * np.uint64(_RADIX) + w.hash[i : i + m]
    h[:m] = mix(acc)
    whole = np.zeros(n, bool)
    whole[:m] = w.doc[:m] == w.doc[k - 1 :]
    return h, whole
