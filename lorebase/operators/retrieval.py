"""Whole tables of questions against whole tables of passages: sparse, dense, fused, gated, packed."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import index_terms, snippet
from ..sources.cluster import dealt, ship, staged

K1, B = 1.2, 0.75
RRF_K = 60
TOP_K, TOP_N, FLOOR = 30, 6, 0.60


def top_k(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first k rows of each key; partitions cut theirs before the shuffle."""
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)


def postings(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, term, tf). Terms are stems, worked out once for each distinct word."""
    words = docs.select(F.col(id_col).alias("id"), F.explode(index_terms(F.col(text_col))).alias("word")).groupBy("id", "word").agg(F.count("*").alias("n"))
    stems = words.select("word").distinct().select("word", stem(F.col("word")).alias("term"))
    return words.join(stems, "word").groupBy("id", "term").agg(F.sum("n").alias("tf"))


def asked_terms(queries: DataFrame) -> DataFrame:
    """(query_id, term): the distinct stems of each question's words but stop words. queries: query_id, text."""
    words = queries.select("query_id", F.explode(F.array_distinct(index_terms(F.col("text")))).alias("word"))
    return words.select("query_id", stem(F.col("word")).alias("term")).distinct()


def _forms(words: DataFrame, asked: DataFrame) -> DataFrame:
    """(word, term): the distinct `words` whose stem is asked for.

    An inner join on a term that can't be null: a semi join, or a test for null, would be
    pushed below distinct(), and stems worked out for every occurrence.
    """
    stems = words.distinct().select("word", F.coalesce(stem(F.col("word")), F.lit("")).alias("term"))
    return stems.join(asked.select("term").distinct(), "term").select("word", "term")


def bm25(docs: DataFrame, queries: DataFrame, most_asked: int = 500_000) -> DataFrame:
    """(query_id, id, score, matched): BM25 of each document that holds a term of the query. docs: id, text; queries: query_id, text.

    Terms are stems. Stop words are neither indexed nor asked for: a question of nothing
    else matches nothing. Stems are worked out for distinct words only, and only the
    documents' occurrences of asked ones are counted and shuffled. Up to `most_asked`
    question terms and forms of theirs are broadcast; more are joined by shuffles. A task
    has so few documents that their sums, one for each question, have bounded memory.
    """
    asked = asked_terms(queries)
    d = docs.select("id", index_terms(F.col("text")).alias("t"))
    # At most as many sums as documents times questions; a document has some hundred asked terms, however few the questions.
    sums = docs.count() * max(queries.count(), 100)
    size = d.agg(F.count("*").alias("n"), F.avg(F.size("t")).alias("mean"))
    forms = staged(_forms(d.select(F.explode("t").alias("word")), asked), "forms")  # counted here, used below
    small = max(asked.count(), forms.count()) <= most_asked
    hint = F.broadcast if small else (lambda x: x)
    occ = d.select("id", F.size("t").alias("len"), F.explode("t").alias("word")).join(hint(forms), "word")
    # One shuffle by document serves the counts, the join with the questions and their sums.
    tf = dealt(occ, sums, "id", share=1_000_000).groupBy("id", "term").agg(F.count("*").alias("tf"), F.first("len").alias("len"))
    df = tf.groupBy("term").agg(F.count("*").alias("df"))
    w = df.crossJoin(F.broadcast(size))  # `size` is one row
    w = w.select("term", "mean", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))
    part = F.col("idf") * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.col("mean")))
    weighed = tf.join(hint(w), "term").select("id", "term", part.alias("part"))
    met = weighed.join(hint(asked), "term")
    return (met if small else dealt(met, sums, "query_id", "id", share=1_000_000)).groupBy("query_id", "id").agg(F.round(F.sum("part"), 6).alias("score"), F.count("*").alias("matched"))


def coverage(pairs: DataFrame, docs: DataFrame, queries: DataFrame) -> DataFrame:
    """`pairs` (query_id, id, others) with `score`: the share of the question's distinct terms that the document holds; questions without terms go.

    Only the pairs' documents are split into words.
    """
    pairs, asked = staged(pairs, "pairs"), asked_terms(queries)  # a question's pairs are its first candidates, used three times
    words = docs.join(pairs.select("id").distinct(), "id", "left_semi").select("id", F.explode(F.array_distinct(index_terms(F.col("text")))).alias("word"))
    terms = words.join(_forms(words.select("word"), asked), "word").select("id", "term").distinct()
    held = pairs.select("query_id", "id").join(asked, "query_id").join(terms, ["id", "term"]).groupBy("query_id", "id").agg(F.count("*").alias("held"))
    n = asked.groupBy("query_id").agg(F.count("*").alias("n"))
    met = pairs.join(n, "query_id").join(held, ["query_id", "id"], "left")
    return met.select(*pairs.columns, F.round(F.coalesce("held", F.lit(0)) / F.col("n"), 6).alias("score"))


def sparse_topk(docs: DataFrame, queries: DataFrame, k: int = TOP_K) -> DataFrame:
    return top_k(bm25(docs, queries), ["query_id"], [F.col("score").desc(), F.col("id")], k)


_PAIRS = "query_id long, id long, score double"


def _blocks(df: DataFrame, size: int, name: str) -> DataFrame:
    """Vectors in blocks of about `size`: one row each, with ids and vectors end to end."""
    n = max(1, -(-df.count() // size))
    g = df.select(F.pmod(F.xxhash64("id"), F.lit(n)).alias("block"), F.struct("id", "vector").alias("x")).groupBy("block").agg(F.collect_list("x").alias("x"))
    return g.select(F.transform("x", lambda x: x["id"]).alias(f"{name}_id"), F.flatten(F.transform("x", lambda x: x["vector"].cast("array<double>"))).alias(name))


def dense_topk(vectors: DataFrame, queries: DataFrame, k: int = TOP_K, query_block: int = 256, vector_block: int = 1024) -> DataFrame:
    """(query_id, id, score, rank) of the k vectors nearest to each query by cosine. Both: id, vector. Exact.

    Every pair has to be looked at, so blocks of queries meet blocks of vectors, one
    matrix product each; a block pair passes on its own k best only.
    """
    ship(vectors.sparkSession)
    pairs = _blocks(vectors, vector_block, "v").crossJoin(_blocks(queries, query_block, "q"))

    def nearest(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for df in batches:
            for vid, v, qid, q in df.itertuples(index=False):
                a, b = np.reshape(v, (len(vid), -1)), np.reshape(q, (len(qid), -1))
                a, b = (x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300) for x in (a, b))
                score = np.round(b @ a.T, 9)
                best = np.lexsort((np.broadcast_to(vid, score.shape), -score))[:, :k]
                yield pd.DataFrame({"query_id": np.repeat(qid, best.shape[1]), "id": np.asarray(vid)[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    return top_k(pairs.select("v_id", "v", "q_id", "q").mapInPandas(nearest, _PAIRS), ["query_id"], [F.col("score").desc(), F.col("id")], k)


def rrf(dense: DataFrame, sparse: DataFrame, k: int = RRF_K) -> DataFrame:
    """(query_id, id, dense_rank, sparse_rank, rrf, rank), absent ranks null."""
    d = dense.select("query_id", "id", F.col("rank").alias("dense_rank"))
    s = sparse.select("query_id", "id", F.col("rank").alias("sparse_rank"))
    part = lambda c: F.coalesce(1.0 / (k + F.col(c)), F.lit(0.0))
    f = d.join(s, ["query_id", "id"], "full").withColumn("rrf", F.round(part("dense_rank") + part("sparse_rank"), 9))
    return f.withColumn("rank", F.row_number().over(W.partitionBy("query_id").orderBy(F.col("rrf").desc(), "id")))


def search_hits(fused: DataFrame, sections: DataFrame, statutes: DataFrame, k: int = 10, *, include_omitted: bool = False, most_asked: int = 500_000) -> DataFrame:
    """(query_id, section_id, citation, rrf, rank, snippet): the first k sections of each question's fused candidates (query_id, id, rrf), omitted ones only with `include_omitted`.

    sections: id, statute_id, section_no, text_verbatim, is_omitted; statutes: id, short_title. The cut comes before texts are joined.
    """
    # The candidates choose the sections before these meet their acts' titles, so that few texts are moved.
    fused = staged(fused.select("query_id", "id", "rrf"), "fused")
    few = lambda df: F.broadcast(df) if fused.count() <= most_asked else df
    known = sections.where(F.lit(include_omitted) | ~F.col("is_omitted"))
    met = known.select("id").join(few(fused), "id").select("query_id", "id", "rrf")
    best = staged(top_k(met, ["query_id"], [F.col("rrf").desc(), F.col("id")], k), "hits")
    named = known.select("id", "statute_id", "section_no", "text_verbatim").join(few(best.select("id").distinct()), "id", "left_semi").join(statutes.select(F.col("id").alias("statute_id"), "short_title"), "statute_id")
    return named.join(few(best), "id").select("query_id", F.col("id").alias("section_id"), F.concat("short_title", F.lit(", s. "), "section_no").alias("citation"), "rrf", "rank", snippet(F.col("text_verbatim")).alias("snippet"))


def gate(scored: DataFrame, queries: DataFrame, floor: float = FLOOR, top_n: int = TOP_N) -> DataFrame:
    """(query_id, passed, n_kept, top_score, reason): the best top_n, then those at or over the floor; queries without candidates too."""
    best = top_k(scored, ["query_id"], [F.col("score").desc(), F.col("id")], top_n, "_r")
    g = best.groupBy("query_id").agg(F.count_if(F.col("score") >= floor).alias("n_kept"), F.max("score").alias("top_score"))
    g = queries.select("query_id").distinct().join(g, "query_id", "left").withColumn("n_kept", F.coalesce("n_kept", F.lit(0)))
    reason = F.when(F.col("top_score").isNull(), "no_candidates").when(F.col("n_kept") == 0, "below_score_floor")
    return g.select("query_id", (F.col("n_kept") > 0).alias("passed"), "n_kept", "top_score", reason.alias("reason"))


def pack(blocks: DataFrame, budget: int) -> DataFrame:
    """(query_id, pos, section_id, tokens) of the blocks that fit: retrieved first, then by score, title and sort key; one that doesn't fit is skipped.

    blocks: query_id, section_id, origin, score, title, sort, tokens. The first block
    always stays; positions are by title and sort key. A query's blocks are its top_n and
    their neighbours, so one row can hold them.
    """
    order = F.struct((F.col("origin") != "retrieved").alias("later"), (-F.coalesce("score", F.lit(0.0))).alias("s"), "title", "sort", "section_id", "tokens")
    g = blocks.groupBy("query_id").agg(F.array_sort(F.collect_list(order)).alias("b"))
    kept_type = "array<struct<title:string,sort:string,section_id:bigint,tokens:bigint>>"
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast(kept_type).alias("kept"))

    def step(acc: Column, x: Column) -> Column:
        fits = (F.size(acc["kept"]) == 0) | (acc["used"] + x["tokens"] <= budget)
        one = F.array(F.struct(x["title"].alias("title"), x["sort"].alias("sort"), x["section_id"].alias("section_id"), x["tokens"].cast("long").alias("tokens")))
        return F.struct(F.when(fits, acc["used"] + x["tokens"]).otherwise(acc["used"]).alias("used"), F.when(fits, F.concat(acc["kept"], one)).otherwise(acc["kept"]).alias("kept"))

    kept = g.select("query_id", F.size("b").alias("offered"), F.array_sort(F.aggregate("b", zero, step)["kept"]).alias("k"))
    return kept.select("query_id", "offered", F.posexplode("k").alias("pos", "x")).select("query_id", "offered", "pos", "x.section_id", "x.tokens")
