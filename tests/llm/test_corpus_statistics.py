"""Operators 11 to 13: resampling, collocations and token counts, each against a plain version."""

import math
import random
import re
import zlib
from collections import Counter, defaultdict
from hashlib import sha256
from itertools import pairwise

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F

from lorebase.llm import crc, phrases, resampling, token_counts

from . import helpers as H

ODD = [(1, None), (2, ""), (2, ""), (None, "a null id stands here"), (3, "   \n\t "), (4, "one"), (5, "One two. Three four"), (7, "É ß 漢字   x"), (7, "é"), (8, "y" * 70_000 + " end " + "z" * 60), (9, "a <|endoftext|> b"), (9, "a <|endoftext|> b")]


def prose(seed, n, vocab):
    r = random.Random(seed)
    return " ".join(f"w{min(r.randrange(vocab), r.randrange(vocab))}" + r.choice(["", "", "", "", ".", ","]) for _ in range(n))


# --- 11 -------------------------------------------------------------------------------------------------------


def test_crc_of_spans_and_pairs():
    r = random.Random(4)
    parts = [bytes(r.randrange(256) for _ in range(n)) for n in (1, 2, 3, 7, 47, 48, 49, 200, 1, 5)]
    data = np.frombuffer(b" ".join(parts), np.uint8)
    ends = np.cumsum([len(x) + 1 for x in parts]) - 1
    starts = ends - [len(x) for x in parts]
    one = crc.spans(data, starts, ends)
    assert one.tolist() == [zlib.crc32(x) for x in parts]
    assert crc.pairs(data, starts, ends, one, np.arange(9)).tolist() == [zlib.crc32(a + b" " + b) for a, b in pairwise(parts)]
    none = np.zeros(0, np.int64)
    assert not len(crc.spans(data, none, none)) and not len(crc.pairs(data, starts, ends, one, none))


def resampled(docs, items, percent=25, least=20, buckets=10_000):
    def features(text):
        w = H.ALNUM.findall((text or "").translate(H.FOLD))
        return [zlib.crc32(x.encode()) % buckets for x in [*w, *(f"{a} {b}" for a, b in pairwise(w))]], len(w)

    found = [features(t) for _, t in docs]
    s, t = Counter(b for f, _ in found for b in f), Counter(b for _, x in items for b in features(x)[0])
    s_all, t_all = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (s_all + buckets) / ((s[b] + 1) * (t_all + buckets))))
    rows = []
    for k, ((i, _), (f, n)) in enumerate(zip(docs, found, strict=True)):
        weight = sum(map(gain, f)) // len(f) if f else 0
        h = int(sha256(f"7:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        rows.append([i, len(f), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 2**32))), None, n, k])
    fit = sorted((x for x in rows if x[5] >= least), key=lambda x: (-x[3], x[0] is None, x[0] or 0))
    for k, x in enumerate(fit[: len(fit) * percent // 100]):
        x[4] = k + 1
    return [tuple(x[:5]) for x in rows]


@pytest.mark.parametrize("percent", [25, 100])
def test_resampling_equals_brute_force(spark, tmp_path, percent):
    same = prose(77, 30, 50)
    docs = [(i, prose(i, 5 + 7 * (i % 9), 300)) for i in range(20, 160)] + [(500, same)] * 9 + [(None, same)] * 40 + ODD
    items = [(i, prose(1000 + i, 40, 200)) for i in range(5)] + [(9, None), (10, "")]
    frame = H.docs_frame(spark, docs).repartition(3)
    scored = resampling.scored_table(frame, H.docs_frame(spark, items), str(tmp_path / "scored"))
    got = [tuple(r) for r in resampling.resample(scored, percent=percent, partitions=7).collect()]
    assert sorted(got, key=str) == sorted(resampled(docs, items, percent), key=str)


def test_resampling_of_little(spark, tmp_path):
    few = H.docs_frame(spark, ODD)
    assert {r["rank"] for r in resampling.resample(resampling.scored_table(few, few, str(tmp_path / "a"))).collect()} == {None}
    none = resampling.scored_table(few.limit(0), few.limit(0), str(tmp_path / "b"))
    assert resampling.resample(none).columns == ["doc_id", "n_features", "weight", "score", "rank"] and none.count() == 0


def test_nth_least_over_ties(spark):
    values = [5] * 40 + [-(1 << 62), 1 << 62, 7, 7, 3]
    rows = spark.createDataFrame([(x,) for x in values], "x long")
    for n in (1, 2, 3, 42, 44, 45):
        assert resampling.nth_least(rows, "x", n) == ((v := sorted(values)[n - 1]), sum(x < v for x in values))


# --- 12 -------------------------------------------------------------------------------------------------------


def collocated(docs, support, covered=50, most=2000):
    f, total = defaultdict(Counter), Counter()
    for lang, text in docs:
        lang = "und" if lang is None else lang
        for piece in re.split(r"[.,;:!?\x0A-\x0D]", (text or "").translate(H.FOLD)):
            w = re.findall(r"[^\x20\x09]+", piece)
            total[lang] += len(w)
            for k in (1, 2, 3):
                f[lang].update(tuple(w[i : i + k]) for i in range(len(w) - k + 1))
    out = []
    for lang, c in f.items():
        cand = {p: n for p, n in c.items() if len(p) > 1 and n >= support}
        outer = Counter()
        for p, n in cand.items():
            if len(p) == 3:
                for q in (p[:2], p[1:]):
                    outer[q] = max(outer[q], n)
        rows = []
        for p, a in cand.items():
            if 100 * outer[p] >= covered * a:
                continue
            score, _, left, right = min((10**6 * a * a // (c[p[:k]] * c[p[k:]]), k, c[p[:k]], c[p[k:]]) for k in range(1, len(p)))
            rows.append((-score, -a, " ".join(p), left, right))
        out += [(lang, i + 1, p, -a, left, right, total[lang], -s) for i, (s, a, p, left, right) in enumerate(sorted(rows, key=lambda x: (x[0], x[1], x[2].encode()))[:most])]
    return sorted(out)


def mined():
    docs = [("en", prose(i, 200, 60)) for i in range(40)] + [("de", prose(i, 150, 25)) for i in range(100, 120)] + [(None, "a a a a a a a a a a a a a a\ta  A. a"), ("", "x y, x y; x y")]
    return docs + [("en", None), ("en", ""), ("de", " .,;\n "), ("en", "É ß É ß 漢字 É ß " * 9), ("fr", "en de " * 30), ("en", "de fr " * 30), ("fr", "\x01 \x85 b " * 12), ("en", "end-of a\x0bb " + "k" * 5000)]


def lang_frame(spark, docs):
    return spark.createDataFrame([(k, lang, t, "p", 1, "f", 2) for k, (lang, t) in enumerate(docs)], "doc_id long, lang string, text string, phrase string, n long, w string, k int")


@pytest.mark.parametrize(("fraction", "bits", "support"), [(0.0, 25, 10), (0.3, 25, 4), (1.0, 12, 10)])
def test_collocations_equal_brute_force(spark, fraction, bits, support):
    """A sample that proposes nothing, one that misses much, and all of it under a bitmap full of false hits."""
    docs = mined()
    got = sorted(tuple(r) for r in phrases.collocations(lang_frame(spark, docs).repartition(3), fraction=fraction, bits=bits, support=support).collect())
    assert got == collocated(docs, support) and {x[0] for x in got} >= {"en", "de", "fr", "und"}


def test_false_hits_lose_no_phrase(spark):
    """A half-full bitmap admits pairs whose words the sample didn't propose; no pass before has counted what is built on them."""
    r = random.Random(5)
    threes = [" ".join(f"u{r.randrange(400)}" for _ in range(3)) for _ in range(400)]
    docs = [(r.choice(["en", "de"]), ". ".join(r.choice(threes) for _ in range(4))) for _ in range(2500)]
    got = sorted(tuple(x) for x in phrases.collocations(lang_frame(spark, docs).repartition(7), fraction=0.05, bits=12).collect())
    assert got == collocated(docs, 10)


def test_collocations_cut_and_empty(spark):
    docs = mined()
    frame = lang_frame(spark, docs)
    assert sorted(tuple(r) for r in phrases.collocations(frame, support=4, most=7).collect()) == collocated(docs, 4, most=7)
    assert phrases.collocations(frame.limit(0)).count() == 0 and phrases.collocations(frame.where("text IS NULL OR text = ''")).count() == 0


def test_phrase_counts_are_whole(spark):
    """A hot text over many rows, counted in a few of its tasks' rows only."""
    frame = lang_frame(spark, [("en", "same words here")] * 300 + [("en", "other words here")] * 5).repartition(8)
    counts, total = phrases.frequent_phrases(frame)
    assert {(r["phrase"], r["n"]) for r in counts.collect()} == {("same", 300), ("words", 305), ("here", 305), ("same words", 300), ("words here", 305), ("same words here", 300)}
    assert [tuple(r) for r in total.collect()] == [("en", 915)]


# --- 13 -------------------------------------------------------------------------------------------------------

BPE = public_tokenizers.path("byte_bpe_50k.json")


def counted(texts):
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(BPE)
    return [len(t.encode(x or "", add_special_tokens=False)) for x in texts]


def stored(spark, cache, path=BPE):
    return spark.read.parquet(f"{cache}/tokenizer={token_counts.tokenizer_version(path)}")


@pytest.mark.parametrize("broadcast_rows", [200_000, 60, 0])
def test_token_counts_equal_the_library(spark, tmp_path, broadcast_rows):
    docs = [*ODD, *((i, prose(i, 30, 200)) for i in range(20, 90)), *((i, prose(7, 20, 200)) for i in range(100, 160))]
    frame, cache = H.docs_frame(spark, docs).repartition(4), str(tmp_path / "cache")
    options = {"tokenizer_path": BPE, "pattern": public_tokenizers.PATTERN, "cache": cache, "limit": 100, "broadcast_rows": broadcast_rows}
    want = sorted(((i, len((t or "").encode()), n, n > 100) for (i, t), n in zip(docs, counted([t for _, t in docs]), strict=True)), key=str)
    assert sorted((tuple(r) for r in token_counts.count_tokens(frame, **options).collect()), key=str) == want
    distinct = len({t or "" for _, t in docs})
    assert stored(spark, cache).count() == distinct
    files = sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet"))
    assert sorted((tuple(r) for r in token_counts.count_tokens(frame, **options).collect()), key=str) == want
    assert sorted(p.name for p in (tmp_path / "cache").rglob("*.parquet")) == files  # nothing was encoded
    more = frame.unionByName(H.docs_frame(spark, [(900, "new words stand here"), (901, "new words stand here"), (902, "one")]))
    assert token_counts.count_tokens(more, **options).count() == len(docs) + 3
    assert stored(spark, cache).count() == distinct + 1


def test_stored_counts_are_used_and_told_apart(spark, tmp_path):
    """A stored count is believed; twice stored digests give one row; another tokenizer has counts of its own."""
    cache, docs = str(tmp_path), H.docs_frame(spark, [(1, "known"), (2, "unknown")])
    held = spark.createDataFrame([("known", 41), ("known", 41)], "t string, n_tokens long").select(F.unhex(F.sha2(F.col("t").cast("binary"), 256)).alias("digest"), "n_tokens")
    held.write.parquet(f"{cache}/tokenizer={token_counts.tokenizer_version(BPE)}")
    got = {r["doc_id"]: r["n_tokens"] for r in token_counts.count_tokens(docs, tokenizer_path=BPE, pattern=public_tokenizers.PATTERN, cache=cache).collect()}
    assert got == {1: 41, 2: counted(["unknown"])[0]}
    for name in ("piece_bpe_32k.model", "word_bpe_49k.json", "byte_bpe_multi_50k.tiktoken"):
        path = public_tokenizers.path(name)
        texts = ["known", "Some longer words, with marks!"]
        frame = H.docs_frame(spark, list(enumerate(texts)))
        n = [r["n_tokens"] for r in token_counts.count_tokens(frame, tokenizer_path=path, pattern=public_tokenizers.PATTERN, cache=cache).orderBy("doc_id").collect()]
        assert n == token_counts.counter(path, public_tokenizers.PATTERN)(texts) and n[0] < 41
        assert stored(spark, cache, path).count() == 2


def test_token_counts_normalised_and_empty(spark, tmp_path):
    docs = H.docs_frame(spark, [(1, "Big Words"), (2, "big words"), (3, None)])
    path = public_tokenizers.path("word_bpe_49k.json")  # it lower-cases
    got = token_counts.count_tokens(docs, tokenizer_path=path, cache=str(tmp_path), normalise=F.lower).orderBy("doc_id").collect()
    assert [(r["n_bytes"], r["n_tokens"]) for r in got] == [(9, 2), (9, 2), (0, 0)] and stored(spark, tmp_path, path).count() == 2
    assert token_counts.count_tokens(docs.limit(0), tokenizer_path=path, cache=str(tmp_path / "none")).count() == 0
    assert not (tmp_path / "none").exists()
