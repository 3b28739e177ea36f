"""Phrases of words that stand together, by Toivonen's way of mining frequent sequences.

1. A sample proposes phrases: those that it holds often enough for a threshold lowered
   to its size.
2. A pass over all texts counts, exactly, every phrase whose shorter parts are all
   proposed: the proposed ones and the negative border around them. Single words have no
   parts, so all of them are counted.
3. A phrase of the border that turns out to be frequent is a failure of the sample: it
   joins the proposals, and a further pass counts what it adds to the border. When a pass
   finds none, no frequent phrase can have been missed.

Tasks see the proposals through a bitmap of fixed size over hashes. A false hit there
only means that a phrase is counted which needn't be; each phrase is counted in the one
pass whose bitmap first admits it.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import checkpoint, ship, slices, text_buffer
from .wordhash import mix, spans_hash, words

#: Bytes that end a piece, and those that end a word.
_BREAK = np.zeros(256, bool)
_BREAK[[10, 11, 12, 13, *b".,;:!?"]] = True
_APART = _BREAK.copy()
_APART[[9, 32]] = True
#: Bytes of text that a task counts before it sends what it has counted.
_HELD = 8 << 20
_TIMES = np.uint64(0x9E3779B97F4A7C15)


class Run:
    """The words of a run of texts: h (hash, by language), start and end in `data`, lang (number of the language), and follows: whether a word stands right behind the one before it, in one piece."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray, salts: np.ndarray):
        parts, base = [], 0
        lowered = []
        for i, j in slices(offsets):
            w = words(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], _APART)
            piece = np.cumsum(_BREAK[w.data], dtype=np.int32)[w.start] if len(w.start) else np.zeros(0, np.int32)
            follows = np.zeros(len(w.hash), bool)
            follows[1:] = (w.doc[1:] == w.doc[:-1]) & (piece[1:] == piece[:-1])
            own = lang[i:j][w.doc]
            parts.append((mix(w.hash + salts[own]), w.start + base, w.end + base, own, follows))
            lowered.append(w.data)
            base += len(w.data)
        self.h, self.start, self.end, self.lang, self.follows = (np.concatenate(x) for x in zip(*parts, strict=True))
        self.data = np.concatenate(lowered)

    def phrases(self, first: np.ndarray, k: int) -> pa.Array:
        """The k words from each word of `first` on, joined by one space."""
        at = (first[:, None] + np.arange(k)).ravel()
        size = self.end[at] - self.start[at] + (np.arange(len(at)) % k < k - 1)
        ends = np.cumsum(size)
        out = np.append(self.data, np.uint8(32))[np.minimum(np.repeat(self.start[at] - (ends - size), size) + np.arange(ends[-1] if len(ends) else 0), len(self.data))]
        if k > 1:
            out[ends.reshape(-1, k)[:, :-1].ravel() - 1] = 32
        offsets = np.concatenate([[0], ends[k - 1 :: k]]).astype(np.int32)
        return pa.Array.from_buffers(pa.string(), len(first), [None, pa.py_buffer(offsets), pa.py_buffer(out)])


def _salts(langs: list[str]) -> np.ndarray:
    """A number for each language, unlike the hash of any word, so that word `x` of language `y` isn't word `y` of language `x`."""
    raw = [x.encode() for x in langs]
    data = np.frombuffer(b"".join(raw), np.uint8)
    ends = np.cumsum([len(x) for x in raw])
    return mix(spans_hash(data, np.concatenate([[0], ends[:-1]]), ends) ^ _TIMES)


def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return mix(a * _TIMES + b)


def _holds(bitmap: np.ndarray, h: np.ndarray) -> np.ndarray:
    at = h & np.uint64(len(bitmap) * 64 - 1)
    return (bitmap[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def _distinct(key: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(place of the first of each key, number of each place's key, how often each key occurs)."""
    if not len(key):
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    order = np.argsort(key, kind="stable")
    ordered = key[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    at = np.flatnonzero(new)
    number = np.empty(len(key), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[at], number, np.diff(np.append(at, len(key)))


def _counted(run: Run, before: np.ndarray | None, now: np.ndarray | None, longest: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(k, first words, counts) of the distinct phrases of a run that this pass counts; k = 0 stands for all words of a language.

    before, now: bitmaps of the proposals of the last pass and of this one; no `before`
    means that nothing is counted yet, no `now` that every phrase is.
    """
    if not len(run.h):
        return
    if before is None:
        many = np.bincount(run.lang)
        there = np.flatnonzero(many)
        first = np.full(len(many), -1)
        first[run.lang[::-1]] = np.arange(len(run.lang))[::-1]
        yield 0, first[there], many[there]
    first, number, n = _distinct(run.h)
    if before is None:
        yield 1, first, n
    hashes = run.h[first]
    reached = np.full(len(first), before is not None)  # of each distinct phrase: whether the passes before counted it
    starts = np.arange(len(run.h))  # first words of all phrases of k words that may matter
    for k in range(2, longest + 1):
        # Both parts of one word less must be proposed: that from here on, and that from the next word on.
        new = _holds(now, hashes) if now is not None else np.ones(len(hashes), bool)
        # A false hit alone is no proof of a count: a pass reaches a phrase only by shorter ones that it has counted.
        old = reached & _holds(before, hashes) if before is not None else reached
        ahead = np.full(len(run.h) + 1, -1)
        ahead[starts] = number
        starts = starts[(starts + k <= len(run.h))]
        whole = run.follows[starts + k - 1]
        starts = starts[whole]
        a, b = ahead[starts], ahead[starts + 1]
        ok = (b >= 0) & new[a] & new[b]
        starts, a, b = starts[ok], a[ok], b[ok]
        first, number, n = _distinct(a * len(hashes) + b)
        reached = old[a[first]] & old[b[first]]
        yield k, starts[first[~reached]], n[~reached]
        hashes = _pair(hashes[a[first]], run.h[starts[first] + k - 1])


def _counter(before: np.ndarray | None, now: np.ndarray | None, longest: int) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            coded = batch.column("lang").dictionary_encode()
            langs = coded.dictionary.to_pylist()
            lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            salts = _salts(langs)
            for i, j in slices(offsets, _HELD):
                run = Run(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], lang[i:j], salts)
                for k, first, n in _counted(run, before, now, longest):
                    for at in range(0, len(first), 100_000):
                        some = first[at : at + 100_000]
                        text = run.phrases(some, k) if k else pa.array([None] * len(some), pa.string())
                        yield pa.RecordBatch.from_arrays([coded.dictionary.take(pa.array(run.lang[some])), text, pa.array(n[at : at + 100_000])], ["lang", "phrase", "n"])

    return count


def _count(texts: DataFrame, before: np.ndarray | None, now: np.ndarray | None, longest: int) -> DataFrame:
    """(lang, phrase, n). Each task has added up its own, so that a phrase has one row for each task and none is summed twice before the shuffle."""
    rows = texts.mapInArrow(_counter(before, now, longest), "lang string, phrase string, n long")
    return rows.repartition("lang", "phrase").groupBy("lang", "phrase").agg(F.sum("n").alias("n"))


def _bitmap(phrases: DataFrame, bits: int) -> np.ndarray:
    """Bitmap of the hashes of all `phrases` (lang, phrase). Tasks set bits; the driver gets the bitmap, whose size is fixed."""

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column("phrase"))
            coded = batch.column("lang").dictionary_encode()
            lang = coded.indices.to_numpy(zero_copy_only=False).astype(np.int64)
            if not len(lang):
                continue
            run = Run(raw, offsets, lang, _salts(coded.dictionary.to_pylist()))
            first = np.flatnonzero(~run.follows)
            size = np.diff(np.append(first, len(run.h)))
            h = run.h[first]
            for k in range(1, int(size.max(initial=1))):
                more = size > k
                h[more] = _pair(h[more], run.h[first[more] + k])
            at = h & np.uint64((1 << bits) - 1)
            cell, bit = (at >> np.uint64(6)).astype(np.int64), np.uint64(1) << (at & np.uint64(63))
            there, number = np.unique(cell, return_inverse=True)
            out = np.zeros(len(there), np.uint64)
            np.bitwise_or.at(out, number, bit)
            yield pa.RecordBatch.from_arrays([pa.array(there), pa.array(out.view(np.int64))], ["cell", "set"])

    out = np.zeros(1 << (bits - 6), np.uint64)
    cells = phrases.select("lang", "phrase").mapInArrow(mark, "cell long, set long").groupBy("cell").agg(F.bit_or("set").alias("set")).toArrow()
    out[cells["cell"].to_numpy()] = cells["set"].to_numpy().view(np.uint64)
    return out


def frequent_phrases(
    documents: DataFrame,
    *,
    support: int = 10,
    longest: int = 3,
    fraction: float = 0.125,
    bits: int = 25,
    seed: int = 11,
    lang_col: str = "lang",
    text_col: str = "text",
) -> tuple[DataFrame, DataFrame]:
    """((lang, phrase, n) of all phrases of 1 to `longest` words with n >= `support`, (lang, words) of all languages with words).

    Texts are lower-cased (A-Z only) and cut to pieces at `[.,;:!?\\x0A-\\x0D]`; phrases lie
    within a piece, and overlapping occurrences all count. Null text is empty, null lang
    is `und`. Whatever the sample proposes, all counts are exact and none is missing.
    """
    ship(documents.sparkSession)
    texts = documents.select(F.coalesce(F.col(lang_col).cast("string"), F.lit("und")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    lowered = max(2, int(support * fraction / 2))
    proposed = _count(texts.sample(fraction, seed=seed), None, None, longest - 1).where(F.col("phrase").isNotNull() & (F.col("n") >= lowered))
    before, now, found, total = None, _bitmap(proposed, bits), [], None
    while True:
        counted = checkpoint(_count(texts, before, now, longest).where(F.col("phrase").isNull() | (F.col("n") >= support)))
        found.append(counted.where("phrase IS NOT NULL"))
        if total is None:
            total = counted.where("phrase IS NULL").select("lang", F.col("n").alias("words"))
        n_spaces = F.length("phrase") - F.length(F.replace("phrase", F.lit(" "), F.lit("")))
        before, now = now, now | _bitmap(found[-1].where(n_spaces < longest - 1), bits)
        if (now == before).all():
            break
    out = found[0]
    for x in found[1:]:
        out = out.unionByName(x)
    return out, total


def _meet(rows: DataFrame, counts: DataFrame, part: str, out: str) -> DataFrame:
    return rows.join(counts.select("lang", F.col("phrase").alias(part), F.col("n").alias(out)), ["lang", part])


def collocations(documents: DataFrame, *, support: int = 10, longest: int = 3, most: int = 2000, covered: int = 50, **options) -> DataFrame:
    """Each language's first `most` phrases of 2 to `longest` words: lang, rank, phrase, a, l, r, n, score.

    a is the phrase's count; cut after its first k words, l and r are its parts' counts and
    the score is floor(1000000 a^2 / (l r)); the lowest-scoring cut counts, ties to the
    smallest k. n is the number of words of the language. A phrase goes if a longer one of
    at least `support` contains it and has at least `covered` percent of its count. Order:
    score, a (both descending), phrase (bytes). Texts without phrases, and an empty table,
    give no rows; repeated rows count each time; other columns are ignored.
    """
    counts, total = frequent_phrases(documents, support=support, longest=longest, **options)
    counts = checkpoint(counts.withColumn("w", F.split("phrase", " ")).withColumn("k", F.size("w")))
    several = counts.where("k > 1").select("lang", "phrase", "w", "k", F.col("n").alias("a"))
    # Every part of a frequent phrase is frequent, so inner joins lose none.
    cuts = several.select("lang", "phrase", "a", "k", F.explode(F.transform(F.sequence(F.lit(1), F.col("k") - 1), lambda i: F.struct(i.alias("cut"), F.array_join(F.slice("w", 1, i), " ").alias("left"), F.array_join(F.slice("w", i + 1, F.col("k") - i), " ").alias("right")))).alias("c"))
    cuts = cuts.select("lang", "phrase", "a", "k", "c.*")
    cuts = _meet(_meet(cuts, counts, "left", "l"), counts, "right", "r")
    cuts = cuts.withColumn("score", F.expr("(CAST(a AS DECIMAL(19, 0)) * CAST(a AS DECIMAL(19, 0)) * CAST(1000000 AS DECIMAL(7, 0))) DIV (CAST(l AS DECIMAL(19, 0)) * CAST(r AS DECIMAL(19, 0)))"))
    best = cuts.groupBy("lang", "phrase").agg(F.min(F.struct("score", "cut", "l", "r", "a", "k")).alias("b")).select("lang", "phrase", "b.score", "b.a", "b.l", "b.r", "b.k")
    inner = several.where("k > 2").select("lang", F.col("a").alias("outer"), F.explode(F.flatten(F.transform(F.sequence(F.lit(2), F.col("k") - 1), lambda m: F.transform(F.sequence(F.lit(1), F.col("k") - m + 1), lambda i: F.array_join(F.slice("w", i, m), " "))))).alias("phrase"))
    inner = inner.groupBy("lang", "phrase").agg(F.max("outer").alias("outer"))
    left = best.join(inner, ["lang", "phrase"], "left").where(F.col("outer").isNull() | (F.col("outer") * 100 < F.col("a") * covered))
    rank = F.row_number().over(W.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase"))
    first = left.withColumn("rank", rank).where(F.col("rank") <= most)
    return first.join(total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", F.col("words").alias("n"), "score")


#: The result of `collocations` over `documents`, by counting every phrase.
SQL = r"""WITH pieces AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n\x0B\x0C\r]')) AS piece FROM documents),
words AS (SELECT lang, list_filter(string_split_regex(piece, '[ \t]+'), lambda x: x <> '') AS w FROM pieces),
runs AS (SELECT lang, k, unnest(list_transform(range(1, len(w) - k + 2), lambda i: array_to_string(w[i:i + k - 1], ' '))) AS phrase FROM words, range(1, 4) AS t(k)),
f AS (SELECT lang, k, phrase, CAST(count(*) AS HUGEINT) AS n FROM runs GROUP BY 1, 2, 3),
total AS (SELECT lang, sum(n) AS n FROM f WHERE k = 1 GROUP BY 1),
many AS (SELECT lang, k, phrase, n AS a, string_split(phrase, ' ') AS w FROM f WHERE k > 1 AND n >= 10),
cuts AS (SELECT m.lang, m.k, m.phrase, a, cut, x.n AS l, y.n AS r, (1000000 * a * a) // (x.n * y.n) AS score FROM (SELECT *, unnest(range(1, k)) AS cut FROM many) m
    JOIN f x ON x.lang = m.lang AND x.phrase = array_to_string(w[:cut], ' ') JOIN f y ON y.lang = m.lang AND y.phrase = array_to_string(w[cut + 1:], ' ')),
best AS (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS o FROM cuts),
inside AS (SELECT lang, phrase, max(a) AS a FROM (SELECT lang, a, unnest([array_to_string(w[1:2], ' '), array_to_string(w[2:3], ' ')]) AS phrase FROM many WHERE k = 3) GROUP BY 1, 2),
stay AS (SELECT b.*, row_number() OVER (PARTITION BY b.lang ORDER BY score DESC, b.a DESC, b.phrase) AS rank FROM best b LEFT JOIN inside i ON i.lang = b.lang AND i.phrase = b.phrase WHERE o = 1 AND (i.a IS NULL OR 100 * i.a < 50 * b.a))
SELECT s.lang, CAST(rank AS BIGINT) AS rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(t.n AS BIGINT) AS n, CAST(score AS BIGINT) AS score FROM stay s JOIN total t ON t.lang = s.lang WHERE rank <= 2000"""
