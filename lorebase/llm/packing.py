"""Bound-certified packing of token sequences: best-fit decreasing, certified by dual feasible functions.

Documents are tokenised where they stand. Pieces are dealt to partitions of about
`partition_rows` pieces; each is packed by best-fit decreasing and certified by a
lower bound on its number of bins. A partition that meets its bound is done. One
with a gap gives up as many of its least filled bins as the gap has, and one more; the
pieces of `fan_in` such partitions meet in one partition and are packed anew, and so on
until one partition is left or no fewer partitions would hold them.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from base64 import b64decode
from collections.abc import Callable, Iterator
from pathlib import Path

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship

#: A space before white space or the end: there, cutting at spaces could cut inside a token.
_RUN = re.compile(r" (?!\S)")
_CACHED = 600_000
_LONGEST = 48


class Tokens:
    """Ids of texts as little-endian 32-bit bytes, by the byte-level BPE ranks that the vocabulary file holds.

    In this vocabulary's pattern a single space between other characters always begins
    a token's word, so a text is the join of its pieces between spaces, and the ids of
    pieces that come again are kept (at most `_CACHED` of them). Texts with a run of
    white space that holds a space are encoded whole. Where a text holds the name of one
    of the file's added tokens, that is the token's id and the parts beside it are texts
    of their own, as `tokenizers` has it.
    """

    def __init__(self, path: str, pattern: str):
        import tiktoken

        if path.endswith(".json"):
            table = {c: b for b, c in enumerate(_byte_alphabet())}
            file = json.loads(Path(path).read_text())
            added = file.get("added_tokens", [])
            if any(x.get(flag) for x in added for flag in ("lstrip", "rstrip", "single_word")):
                raise ValueError("added tokens that take in what stands beside them are not supported")
            vocabulary, special = file["model"]["vocab"], {x["content"]: x["id"] for x in added}
            ranks = {bytes(table[c] for c in word): i for word, i in vocabulary.items() if word not in special}
        else:
            ranks, special = {b64decode(a): int(b) for a, b in map(bytes.split, Path(path).read_bytes().splitlines())}, {}
        self.special = {name: array("I", [i]) for name, i in special.items()}
        for x in self.special.values() if sys.byteorder == "big" else ():
            x.byteswap()
        self.added = re.compile("(" + "|".join(map(re.escape, sorted(special, key=len, reverse=True))) + ")") if special else None
        self.encoding = tiktoken.Encoding("packing", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
        self.known: dict[str, bytes] = {}

    def _encode(self, text: str) -> bytes:
        ids = array("I", self.encoding.encode_ordinary(text))
        if sys.byteorder == "big":
            ids.byteswap()
        return ids.tobytes()

    def __call__(self, text: str) -> bytes:
        if self.added and self.added.search(text):
            return b"".join(self.special[x].tobytes() if x in self.special else self._plain(x) for x in self.added.split(text) if x)
        return self._plain(text)

    def _plain(self, text: str) -> bytes:
        if _RUN.search(text):
            return self._encode(text)
        parts = text.split(" ")
        known = self.known
        out = [known.get(p) for p in parts]
        out[0] = self._encode(parts[0])
        if None in out:
            if len(known) > _CACHED:
                known.clear()
            for i, x in enumerate(out):
                if x is None:
                    p = parts[i]
                    out[i] = x = known.get(p) or self._encode(f" {p}")
                    if len(p) <= _LONGEST:
                        known[p] = x
        return b"".join(out)


def _byte_alphabet() -> list[str]:
    """The printable character that stands for each byte in a byte-level vocabulary: itself if printable, else one from 256 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


_loaded: dict[tuple[str, str], Tokens] = {}


def tokens(path: str, pattern: str) -> Tokens:
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = Tokens(path, pattern)
    return _loaded[path, pattern]


def pieces(n: int, capacity: int) -> Iterator[tuple[int, int, int]]:
    """(piece, start, length) of a sequence of n: one, or the remainder first and then full ones."""
    at, size = 0, n if n <= capacity else n % capacity or capacity
    for k in range(-(-n // capacity)):
        yield k, at, size
        at, size = at + size, capacity


def lower_bound(lengths: np.ndarray, capacity: int) -> int:
    """The best of a family of dual feasible functions' bounds on the number of bins.

    Lengths under e count as nothing and those over capacity - e as a whole bin; then
    x is rounded to floor((k + 1) x) / k unless (k + 1) x is whole. Each choice of e
    and k maps lengths that fit a bin to numbers of sum 1 at most, so the sum over all
    pieces is a bound; k = 0 stands for no rounding.
    """
    if not len(lengths):
        return 0
    count = np.bincount(lengths, minlength=capacity + 1).astype(np.int64)
    x = np.arange(capacity + 1, dtype=np.int64)
    best = 0
    for k in (0, 1, 2, 3, 4, 5, 7, 9):
        # In units of 1 / (capacity * max(k, 1)), so that all is whole numbers.
        unit = capacity * max(k, 1)
        y = x * max(k, 1) if k == 0 else np.where((k + 1) * x % capacity == 0, x * k, (k + 1) * x // capacity * capacity)
        total = np.concatenate([[0], np.cumsum(count * y)])
        many = np.concatenate([[0], np.cumsum(count)])
        e = np.arange(0, capacity // 2 + 1)
        middle = total[capacity - e + 1] - total[e]
        over = many[capacity + 1] - many[capacity - e + 1]
        best = max(best, int((-(-(middle + over * unit) // unit)).max()))
    return best


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """bin and offset of each piece, and what each bin holds. Each piece, longest first, goes to the fullest bin it fits."""
    order = np.argsort(-lengths, kind="stable")
    bins, offsets = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
    held: list[int] = []
    room: list[list[int]] = [[] for _ in range(capacity + 1)]
    free = 0  # bit r is set if some bin has r left
    for i in order.tolist():
        size = int(lengths[i])
        fit = free >> size
        if fit:
            r = size + (fit & -fit).bit_length() - 1
            b = room[r].pop()
            if not room[r]:
                free ^= 1 << r
        else:
            r, b = capacity, len(held)
            held.append(0)
        bins[i], offsets[i] = b, held[b]
        held[b] += size
        left = r - size
        if left:
            room[left].append(b)
            free |= 1 << left
    return bins, offsets, np.array(held, np.int64)


def _packer(step: int, capacity: int, last: bool) -> Callable[[pd.DataFrame], pd.DataFrame]:
    """Packs one partition and marks the bins that it gives up: none if its bound is met, or in the last round."""

    def pack(df: pd.DataFrame) -> pd.DataFrame:
        lengths = df["length"].to_numpy()
        b, offset, held = best_fit_decreasing(lengths, capacity)
        bound = lower_bound(lengths, capacity)
        given = np.zeros(len(held), bool)
        if not last and len(held) > bound:
            given[np.argsort(held, kind="stable")[: len(held) - bound + 1]] = True
        part = int(df["part"].iloc[0])
        return df.assign(sequence_id=(step << 57) + (part << 24) + b, offset=offset, bins=len(held), bound=bound, open=given[b])

    return pack


def pack_documents(
    documents: DataFrame,
    *,
    tokenizer_path: str,
    pattern: str,
    id_col: str = "doc_id",
    text_col: str = "text",
    capacity: int = 2048,
    end_id: int = 0,
    partition_rows: int = 8192,
    fan_in: int = 16,
) -> DataFrame:
    """One row for each piece of each row of `documents`: doc_id, piece, start, length, ids_crc32, sequence_id, offset, bins, bound.

    A document is its ids and then `end_id`; only one longer than `capacity` is cut, and
    its first piece takes the remainder. No piece is lost or cut otherwise. Null text is
    empty: one piece of length 1. Repeated rows are packed each for itself; ids may be
    null. `bins` and `bound` are the number of bins and the certified lower bound of the
    partition in which the piece was packed last. Every round has fewer partitions, of
    about `partition_rows` pieces or fewer each; they end where no fewer would do. An
    empty table gives an empty result; other columns are ignored.
    """
    ship(documents.sparkSession)

    def tokenise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode, end = tokens(tokenizer_path, pattern), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            ids, texts = batch.column("doc_id"), batch.column("text")
            for at in range(0, batch.num_rows, 1000):
                rows = []
                for i, text in enumerate(texts.slice(at, 1000)):
                    data = memoryview(encode(text.as_py() or "") + end)
                    rows += [(at + i, k, start, n, zlib.crc32(data[4 * start : 4 * (start + n)])) for k, start, n in pieces(len(data) // 4, capacity)]
                row, *rest = map(np.array, zip(*rows, strict=True))
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row)), pa.array(rest[0], pa.int32()), *(pa.array(x, pa.int64()) for x in rest[1:])], ["doc_id", "piece", "start", "length", "ids_crc32"])

    cut = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    cut = cut.mapInArrow(tokenise, "doc_id long, piece int, start long, length long, ids_crc32 long")
    open_rows = checkpoint(cut.withColumn("row", F.monotonically_increasing_id()))
    parts = max(1, -(-open_rows.count() // partition_rows))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset", "bins", "bound"]
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long, row long, part long, sequence_id long, offset long, bins long, bound long, open boolean"
    open_rows = open_rows.withColumn("part", F.pmod(F.xxhash64("row"), F.lit(parts)))
    result, step = None, 0
    while True:
        last = parts == 1
        packed = open_rows.groupBy("part").applyInPandas(_packer(step, capacity, last), schema)
        packed = packed if last else checkpoint(packed)
        given = 0 if last else packed.where("open").count()
        fewer = max(-(-parts // fan_in), -(-given // partition_rows))
        if given == 0 or fewer >= parts:
            done = packed.select(columns)
            return done if result is None else result.unionByName(done)
        done = packed.where("NOT open").select(columns)
        result = done if result is None else result.unionByName(done)
        parts, step = fewer, step + 1
        open_rows = packed.where("open").select("doc_id", "piece", "start", "length", "ids_crc32", "row", F.pmod("part", F.lit(parts)).alias("part"))
