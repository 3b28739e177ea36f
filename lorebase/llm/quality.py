"""Quality rules: surface counts of a text, and perplexity under a modified Kneser-Ney model of its language.

The model is of order 4 over code points (upper case, digits and white space folded; a
code point is 16 bits, those beyond the basic plane share its private-use area). An
n-gram so is one 64-bit number whose upper and lower parts are its context and its
suffix, and Spark computes counts, continuation counts, discounts and interpolated
probabilities by sums and joins on these numbers. The model has a row for each distinct
n-gram of each language and grows with the corpus. It is kept in sorted arrays, at most
`model_rows` rows at a time: a larger one is passed over the documents part by part.

Word n-grams can't meet the shuffle limit here: three quarters of the corpus's word
trigrams are distinct (4.74 million of 6.30 million in 12,000 documents), so counting
them alone would shuffle more than 1.7 times the input, and scoring as much again.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import checkpoint, ship, slices, text_buffer
from .wordhash import SPACE, mix, spans_hash, windows, words

ORDER = 4
BITS = 16
#: Of the code points beyond the basic plane: the first of its private-use area, and the size of that.
_PRIVATE, _PRIVATE_SIZE = 0xE000, 6400
#: Length classes of the bands: powers of four in code points.
CLASSES = 24
_MARKS = np.zeros(256, bool)
_MARKS[[ord(c) for c in "#*$%&|<>"]] = True


def _folded() -> np.ndarray:
    """Symbol of each code point of the basic plane: lower case, one digit, one white space; 0 is kept for the boundary."""
    out = np.arange(1 << BITS, dtype=np.uint16)
    for i in range(1 << BITS):
        c = chr(i)
        low = c.lower()
        out[i] = 32 if c.isspace() or i < 32 else 48 if c.isdecimal() else ord(low) if len(low) == 1 else i
    return out


_FOLD = _folded()


def codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """64-bit code of the n-gram that ends at each symbol, and its text; before a text stand boundary symbols (0)."""
    n = len(offsets) - 1
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), "<u4")
    lead = np.flatnonzero((data & 0xC0) != 0x80)
    doc = np.repeat(np.arange(n), np.diff(np.searchsorted(lead, offsets)))
    symbol = _FOLD[np.where(points < (1 << BITS), points, _PRIVATE + points % _PRIVATE_SIZE)]
    keep = np.ones(len(symbol), bool)
    keep[1:] = (symbol[1:] != 32) | (symbol[:-1] != 32) | (doc[1:] != doc[:-1])
    symbol, doc = symbol[keep], doc[keep]
    padded = np.zeros(len(symbol) + (ORDER - 1) * n, np.uint64)
    at = np.arange(len(symbol)) + (ORDER - 1) * (doc + 1)
    padded[at] = symbol
    code = padded[at]
    for k in range(1, ORDER):
        code = code | (padded[at - k] << np.uint64(BITS * k))
    return code, doc


def kneser_ney(counts: DataFrame) -> DataFrame:
    """(grp, code, cost): the negative log of each n-gram's interpolated probability by modified Kneser-Ney. counts: grp, code, n (long).

    A lower order counts the different symbols that come before. Below the unigrams
    stands the uniform distribution over a language's symbols. An n-gram of count 0,
    which only texts outside the training set hold, has what its lower orders give it.
    """
    tables = [counts.select("grp", "code", "n")]
    for k in range(ORDER - 1, 0, -1):
        suffix = F.col("code").bitwiseAND(F.lit((1 << (BITS * k)) - 1))
        tables.append(checkpoint(tables[-1].groupBy("grp", suffix.alias("code")).agg(F.count_if(F.col("n") > 0).alias("n"))))
    p = None
    for width, t in enumerate(reversed(tables), 1):
        # Discounts of a language: of counts 1, 2, and 3 or more.
        n1, n2, n3, n4 = (F.count_if(F.col("n") == k) for k in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2)

        def less(k: int, a: Column, b: Column, y: Column = y) -> Column:
            return F.when((n1 > 0) & (a > 0), F.least(F.greatest(k - (k + 1) * y * b / a, F.lit(0.0)), F.lit(float(k)))).otherwise(0.5 * k)

        discounts = t.groupBy("grp").agg(less(1, n1, n2).alias("d1"), less(2, n2, n3).alias("d2"), less(3, n3, n4).alias("d3"), F.count("*").alias("types"))
        context = F.shiftrightunsigned("code", BITS)
        by_context = t.groupBy("grp", context.alias("context")).agg(F.sum("n").alias("total"), *(F.count_if(F.col("n") == k).alias(f"c{k}") for k in (1, 2)), F.count_if(F.col("n") > 2).alias("c3"))
        row = t.withColumn("context", context).join(by_context, ["grp", "context"]).join(discounts, "grp")
        d = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
        spare = F.when(F.col("total") > 0, (F.col("c1") * F.col("d1") + F.col("c2") * F.col("d2") + F.col("c3") * F.col("d3")) / F.col("total")).otherwise(1.0)
        own = F.when(F.col("n") > 0, (F.col("n") - d) / F.col("total")).otherwise(0.0)
        if p is None:
            p = row.select("grp", "code", (own + spare / F.col("types")).alias("p"))
        else:
            suffix = F.col("code").bitwiseAND(F.lit((1 << (BITS * (width - 1))) - 1))
            row = row.select("grp", "code", own.alias("own"), spare.alias("spare"), suffix.alias("suffix"))
            lower = p.select("grp", F.col("code").alias("suffix"), "p")
            p = row.join(lower, ["grp", "suffix"]).select("grp", "code", (F.col("own") + F.col("spare") * F.col("p")).alias("p"))
    return p.select("grp", "code", (-F.log("p")).cast("float").alias("cost"))


def _line_spans(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and text of each line."""
    feed = np.flatnonzero(data == 10)
    start = np.unique(np.concatenate([offsets[:-1], feed + 1]))
    start = start[start < len(data)]
    end = np.append(start[1:], len(data))
    doc = np.searchsorted(offsets, start, "right") - 1
    end = end - (data[np.maximum(end - 1, 0)] == 10)
    return start, np.maximum(end, start), doc


def surface(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """n_words, word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    n = len(offsets) - 1
    w = words(data, offsets, SPACE, lower=False)

    def per_text(mask: np.ndarray) -> np.ndarray:
        total = np.concatenate([[0], np.cumsum(mask)])
        return total[offsets[1:]] - total[offsets[:-1]]

    start, end, doc = _line_spans(data, offsets)
    full = np.concatenate([[0], np.cumsum(~SPACE[data])])
    own = full[end] > full[start]
    key = mix(spans_hash(data, start[own], end[own]) + mix(doc[own].astype(np.uint64)))
    _, first = np.unique(key, return_index=True)
    again = np.ones(len(key), bool)
    again[first] = False
    h, whole = windows(w, 5)
    at = np.flatnonzero(whole)
    key = mix(h[at] + mix(w.doc[at].astype(np.uint64)))
    order = np.argsort(key, kind="stable")
    same = key[order][1:] == key[order][:-1]
    twice = np.zeros(len(at), bool)
    twice[order[1:][same]] = twice[order[:-1][same]] = True
    edge = np.zeros(len(w.hash) + 5, np.int64)
    np.add.at(edge, at[twice], 1)
    np.add.at(edge, at[twice] + 5, -1)
    covered = np.concatenate([[0], np.cumsum(np.cumsum(edge)[: len(w.hash)] > 0)])
    return {
        "n_words": np.diff(w.first),
        "word_chars": per_text(~SPACE[data] & ((data & 0xC0) != 0x80)),
        "n_symbols": per_text(_MARKS[data]),
        "n_dup_lines": np.bincount(doc[own][again], minlength=n),
        "n_repeat_words": covered[w.first[1:]] - covered[w.first[:-1]],
    }


_COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")


def _fit(s: dict[str, np.ndarray], marks: int) -> np.ndarray:
    """Whether a model may learn from a text: it passes the base rules and has at most one mark for every `marks` words."""
    return (s["n_words"] >= 10) & (100 * s["n_repeat_words"] <= 20 * s["n_words"]) & (marks * s["n_symbols"] <= s["n_words"])


def _counted(batches: Iterator[pa.RecordBatch], marks: int) -> Iterator[pa.RecordBatch]:
    """(grp, code, n) of all n-grams of a task's texts, n in those that a model may learn from, summed as far as memory bounds allow."""
    held: dict[int, list[tuple[np.ndarray, np.ndarray]]] = {}
    size = 0

    def summed(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
        code, n = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.argsort(code)
        code, n = code[order], n[order]
        at = np.flatnonzero(np.append(True, code[1:] != code[:-1]))
        return code[at], np.add.reduceat(n, at)

    def flush() -> Iterator[pa.RecordBatch]:
        for g, parts in held.items():
            code, n = summed(parts)
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(code), g)), pa.array(code.view(np.int64)), pa.array(n)], ["grp", "code", "n"])

    for batch in batches:
        data, offsets = text_buffer(batch.column("text"))
        grp = np.asarray(batch.column("grp"))
        for i, j in slices(offsets, 1 << 21):
            code, doc = codes(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i])
            own, learnt = grp[i:j][doc], _fit(surface(data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]), marks)[doc]
            for g in np.unique(own).tolist():
                met, number = np.unique(code[own == g], return_inverse=True)
                held.setdefault(g, []).append((met, np.bincount(number, learnt[own == g], len(met)).astype(np.int64)))
                size += len(held[g][-1][0])
        if size > 4_000_000:
            held = {g: [summed(parts)] for g, parts in held.items()}
            size = sum(len(x[0][0]) for x in held.values())
            if size > 2_000_000:
                yield from flush()
                held, size = {}, 0
    yield from flush()


def _bands(made: DataFrame, below: float, above: float, prior: float, marks: int) -> tuple[DataFrame, Column]:
    """(lo and hi by language: arrays over the length classes, the place of a text among the classes)."""
    good = made.where(~F.col("base_failed") & F.col("log_perplexity").isNotNull() & (marks * F.col("n_symbols") <= F.col("n_words")))
    at = F.least(F.log(F.greatest(F.col("n_symbols_all"), F.lit(1)).cast("double")) / np.log(4.0), F.lit(CLASSES - 1.001))
    quartiles = F.percentile_approx("log_perplexity", [0.25, 0.75], 10_000)
    whole = good.groupBy("grp").agg(quartiles.alias("q"))
    classes = good.groupBy("grp", F.round(at).cast("int").alias("class")).agg(quartiles.alias("cq"), F.count("*").alias("n"))
    # A class of few texts leans on its language: n texts count n / (n + prior).
    weight = F.col("n") / (F.col("n") + prior)
    mixed = classes.join(whole, "grp").select("grp", "class", *((weight * F.col("cq")[i] + (1 - weight) * F.col("q")[i]).alias(x) for i, x in enumerate(("lo", "hi"))))
    spread = F.greatest(F.col("hi") - F.col("lo"), F.lit(0.005))
    edges = mixed.select("grp", "class", (F.col("lo") - below * spread).alias("lo"), (F.col("hi") + above * spread).alias("hi"))
    each = edges.groupBy("grp").agg(F.map_from_entries(F.collect_list(F.struct("class", F.struct("lo", "hi")))).alias("edges"))  # CLASSES entries at most
    return each, at


def quality_rules(documents: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", below: float = 6.0, above: float = 8.0, prior: float = 50.0, marks: int = 20, model_rows: int = 2_000_000) -> DataFrame:
    """One row for each row of `documents`: doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, log_perplexity, kept.

    Every language has a model and bands of its own, null too. The model learns from texts
    that pass the base rules and have at most one mark of `[#*$%&|<>]` for every `marks`
    words; all texts are scored. log_perplexity is the mean negative log probability of a
    text's folded code points (null without any). A text is in its band if that is at
    most `below` interquartile ranges under the lower quartile and `above` over the upper
    one of the texts of like length that the language's model learns from: quartiles of
    length classes (powers of four), each mixed with the whole language's as if that were
    `prior` more texts, and interpolated between classes. Repetition lowers perplexity;
    marks, mangled words and another language raise it, and short passages of one are
    common in clean texts, so the upper band is the wider one. Where a language has no
    text to learn from, its bands decide nothing. kept: not base_failed, and in the band.
    Quartiles and counts are over all such texts. Null and empty texts have no words and
    so fail; repeated rows count each; ids are only carried; other columns are ignored.
    """
    spark = documents.sparkSession
    ship(spark)
    df = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"), F.xxhash64(F.col(lang_col).cast("string")).alias("grp"))
    counts = checkpoint(df.where("text IS NOT NULL").select("grp", "text").mapInArrow(lambda batches: _counted(batches, marks), "grp long, code long, n long").groupBy("grp", "code").agg(F.sum("n").alias("n")))
    model = checkpoint(kneser_ney(counts))
    parts = max(1, -(-model.count() // model_rows))

    def scorer(part: int):
        own = model.where(F.pmod(F.col("code").bitwiseAND(F.lit((1 << 63) - 1)), F.lit(parts)) == part).toArrow()
        arrays: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        grp, code, cost = (own.column(c).to_numpy() for c in ("grp", "code", "cost"))
        code = code.view(np.uint64)
        order = np.lexsort((code, grp))
        grp, code, cost = grp[order], code[order], cost[order]
        for g in np.unique(grp).tolist():
            a, b = np.searchsorted(grp, g), np.searchsorted(grp, g, "right")
            arrays[g] = (code[a:b], cost[a:b])
        shared = spark.sparkContext.broadcast(arrays)

        def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            model = shared.value
            for batch in batches:
                data, offsets = text_buffer(batch.column("text"))
                grp = np.asarray(batch.column("grp"))
                for i, j in slices(offsets):
                    cut_data, cut = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                    code, doc = codes(cut_data, cut)
                    size = np.bincount(doc, minlength=j - i)
                    if parts > 1:
                        mine = (code & np.uint64((1 << 63) - 1)) % np.uint64(parts) == part
                        code, doc = code[mine], doc[mine]
                    own, total = grp[i:j][doc], np.zeros(j - i)
                    for g in np.unique(own).tolist():  # every n-gram here has been counted, so the arrays hold it
                        here, (known, cost) = np.flatnonzero(own == g), model[g]
                        total += np.bincount(doc[here], cost[np.searchsorted(known, code[here])], minlength=j - i)
                    s = surface(cut_data, cut) if part == 0 else dict.fromkeys(_COUNTS, np.zeros(j - i, np.int64))
                    yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(i, j - i) for c in ("doc_id", "grp", "text_hash")), *(pa.array(x.astype(np.int64)) for x in s.values()), pa.array(size), pa.array(total)], ["doc_id", "grp", "text_hash", *s, "n_symbols_all", "total"])

        return df.withColumn("text_hash", F.xxhash64("text")).mapInArrow(score, "doc_id long, grp long, text_hash long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", n_symbols_all long, total double")

    made = checkpoint(scorer(0))
    for part in range(1, parts):  # what the model's other parts add, by text: equal rows have equal sums
        more = checkpoint(scorer(part).select(F.col("doc_id").alias("d"), F.col("grp").alias("g"), F.col("text_hash").alias("t"), F.col("total").alias("more")).dropDuplicates(["d", "g", "t"]))
        met = made.join(more, made.doc_id.eqNullSafe(more.d) & (made.grp == more.g) & (made.text_hash == more.t))
        made = checkpoint(met.withColumn("total", F.col("total") + F.col("more")).drop("d", "g", "t", "more"))
    failed = (F.col("n_words") < 10) | (100 * F.col("n_repeat_words") > 20 * F.col("n_words"))
    made = made.withColumn("base_failed", failed).withColumn("log_perplexity", F.when(F.col("n_symbols_all") > 0, F.col("total") / F.col("n_symbols_all")))
    bands, at = _bands(made, below, above, prior, marks)
    bands = checkpoint(bands)
    made = made.withColumn("at", at).join(F.broadcast(bands) if bands.count() <= 10_000 else bands, "grp", "left")
    a, b = F.floor("at").cast("int"), F.floor("at").cast("int") + 1
    share = F.col("at") - F.floor("at")

    def edge(name: str) -> Column:
        x, y = F.try_element_at("edges", a)[name], F.try_element_at("edges", b)[name]
        return F.coalesce((1 - share) * x + share * y, x, y)

    within = F.coalesce((F.col("log_perplexity") >= edge("lo")) & (F.col("log_perplexity") <= edge("hi")), F.col("edges").isNull() & F.col("log_perplexity").isNotNull())
    return made.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "log_perplexity", (~F.col("base_failed") & within).alias("kept"))
