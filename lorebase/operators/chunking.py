"""Sections to chunks under a token ceiling. What fits is one chunk, natively; only overlong sections run Python."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import SEGMENT_START, word_count
from ..sources.cluster import ship

CEILING = 450
_START = re.compile(rf"{SEGMENT_START}|\bProvided\b")
_SENTENCE = re.compile(r"(?<=[.;:])\s+")


def _segments(text: str) -> list[str]:
    at = [0, *(m.start() for m in _START.finditer(text)), len(text)]
    return [x for a, b in zip(at, at[1:], strict=False) if (x := text[a:b].strip())]


class _Counter:
    """Tokens of a heading and a text by any counter, which is asked about each whole text."""

    def __init__(self, heading: str | None, count: Callable[[str], int]):
        self.heading, self.count = heading or "", count

    def of(self, text: str) -> int:
        return self.count(self.heading + text)

    def joined(self, text: str, size: int, join: str, unit: str) -> int:
        """Of `text`, whose tokens are `size`, with one more unit."""
        return self.of(text + join + unit)


class _WordCounter(_Counter):
    """Words add up over white space, so a text that grows is not counted anew."""

    def __init__(self, heading: str | None):
        super().__init__(heading, _words)
        self.base = _words(self.heading + "x") - 1  # with a word behind: the heading's last one may go on in the text

    def of(self, text: str) -> int:
        return self.base + _words(text) if text and not text[0].isspace() else super().of(text)

    def joined(self, text: str, size: int, join: str, unit: str) -> int:
        return size + _words(unit)


def _filled(units: list[str], join: str, tokens: _Counter, ceiling: int) -> list[tuple[str, int]]:
    """Units side by side as long as they fit, with their tokens. One that is too large alone is broken up after what stands before it is closed; its last part stays open."""
    out: list[tuple[str, int]] = []
    for u in units:
        if out and (n := tokens.joined(*out[-1], join, u)) <= ceiling:
            out[-1] = (out[-1][0] + join + u, n)
        else:
            n = tokens.of(u)
            out += [(u, n)] if n <= ceiling else _broken(u, n, tokens, ceiling)
    return out


def _broken(unit: str, size: int, tokens: _Counter, ceiling: int) -> list[tuple[str, int]]:
    """By sentences, or by words if it is one sentence; a word stays whole."""
    sentences, words = [x for x in _SENTENCE.split(unit) if x.strip()], unit.split()
    if len(sentences) > 1:
        return _filled(sentences, " ", tokens, ceiling)
    return _filled(words, " ", tokens, ceiling) if len(words) > 1 else [(unit, size)]


def split_section(text: str, fits: Callable[[str], bool]) -> list[str]:
    """Chunks of an overlong section by a test of what fits."""
    return [x for x, _ in _filled(_segments(text), "\n", _Counter(None, lambda t: not fits(t)), 0)]


def _chunks(text: str, tokens: _Counter, ceiling: int) -> list[tuple[int, str, int]]:
    """(chunk_idx, text, token_count) of one section. An overlong one: segments packed by line, broken where one alone doesn't fit. Nothing is lost or moved."""
    n = tokens.of(text)
    return [(k, *x) for k, x in enumerate([(text, n)] if n <= ceiling else _filled(_segments(text), "\n", tokens, ceiling))]


def _words(text: str) -> int:
    return len(text.split())


def chunk_sections(sections: DataFrame, ceiling: int = CEILING, load: Callable[[], Callable[[str], int]] | None = None, size: Callable[[Column], Column] | None = None) -> DataFrame:
    """(id, chunk_idx, text, token_count). sections: id, heading, text; a chunk and its heading have at most `ceiling` tokens, but for a longer word.

    Tokens are words, unless `load` makes another counter, once in each task. `size` is
    the same counter as a function of columns: with it, and by default, sections that fit
    are told natively and only overlong ones run Python; a counter that is known in Python
    alone is asked about every section there. Blank sections give no chunk.
    """
    ship(sections.sparkSession)
    s = sections.select("id", "heading", F.regexp_replace("text", r"^\s+|\s+$", "").alias("text")).where("text <> ''")
    counters: list[Callable[[str], int]] = []

    def split(heading: str | None, text: str) -> list[tuple[int, str, int]]:
        if load and not counters:
            counters.append(load())
        return _chunks(text, _Counter(heading, counters[0]) if load else _WordCounter(heading), ceiling)

    def in_tasks(rows: DataFrame) -> DataFrame:
        # Rows go to Python a hundred at a time, so that its memory follows long texts and not the batch.
        cut = F.udf(split, "array<struct<chunk_idx:int,text:string,token_count:int>>", useArrow=False)
        return rows.select("id", F.explode(cut("heading", "text")).alias("c")).select("id", "c.*")

    if size is None and load:
        return in_tasks(s)
    n = size(F.concat(F.coalesce("heading", F.lit("")), "text")) if size else word_count(F.col("heading")) + word_count(F.col("text"))
    s = s.withColumn("n", n)
    fits = s.where(F.col("n") <= ceiling).select("id", F.lit(0).alias("chunk_idx"), "text", F.col("n").cast("int").alias("token_count"))
    over = in_tasks(s.where(F.col("n") > ceiling))
    return fits.unionByName(over)


def register_chunker(spark: SparkSession, name: str = "split_section", ceiling: int = CEILING, load: Callable[[], Callable[[str], int]] | None = None) -> None:
    """The chunker as a table function for SQL: `FROM sections, LATERAL split_section(heading, text)` gives (chunk_idx, chunk, token_count). Null and blank texts give no row."""
    ship(spark)

    class SplitSection:
        def __init__(self) -> None:
            self.count = load() if load else None

        def eval(self, heading: str, text: str) -> Iterator[tuple[int, str, int]]:
            if text and text.strip():
                yield from _chunks(text.strip(), _Counter(heading, self.count) if self.count else _WordCounter(heading), ceiling)

    spark.udtf.register(name, F.udtf(SplitSection, returnType="chunk_idx int, chunk string, token_count int"))


def chunk_report(chunks: DataFrame) -> DataFrame:
    """One row: sections, chunks, split_sections and max_tokens (null without chunks)."""
    each = chunks.groupBy("id").agg(F.count("*").alias("chunks"), F.max("token_count").alias("most"))
    return each.agg(F.count("*").alias("sections"), F.coalesce(F.sum("chunks"), F.lit(0)).alias("chunks"), F.count_if(F.col("chunks") > 1).alias("split_sections"), F.max("most").alias("max_tokens"))
