"""A kept inverted index: postings written once, in term buckets, with a maximum for each block, so that a search reads its terms only and leaves out blocks that can't matter.

Documents are dealt to blocks by a hash of their id. A row of the postings is one term in
one block: the documents' ids, counts and lengths, and the most that the term can add to
the score of any of them. The sum of its terms' maxima bounds what a block has for a
question. A question's most promising blocks are scored first; the k-th best score there
is a floor, and of the other blocks only those whose bound reaches it are scored.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.stem import stem
from ..functions.text import index_terms
from ..sources.cluster import drop_path, spread, staged
from .retrieval import K1, TOP_K, B, asked_terms, top_k

POSTINGS = "bucket int, term string, block int, n int, most double, postings array<struct<id:bigint,tf:bigint,len:int>>"
STATS = "documents long, mean double, blocks int, buckets int"
#: Scores are rounded to six decimals; a bound that is lower by less than this still counts as reached.
_SLACK = 2e-6
#: Rows that a search broadcasts at most, and blocks that one task of it scores.
MOST_BROADCAST, BLOCKS_OF_A_TASK = 500_000, 8


def _weight(tf: Column, length: Column, mean: Column) -> Column:
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / mean))


def _idf(n: Column, df: Column) -> Column:
    return F.log(1 + (n - df + 0.5) / (df + 0.5))


def build_index(docs: DataFrame, path: str, *, block_rows: int = 256, buckets: int = 16, most_stems: int = 500_000) -> SearchIndex:
    """Writes the index of `docs` (id, text) to `path` and opens it. Terms are stems without stop words; each distinct word is stemmed once.

    Texts are split once: the words' counts are kept beside the index until it is written.
    Up to `most_stems` distinct words are broadcast with their stems; more are joined by
    shuffles. One shuffle by ranges of bucket, term and block serves the sums, the lists
    and the files. A term of very many documents has a row for each block, so it gathers
    nowhere. Null texts have no terms and count as documents, but not in the mean length;
    ids must be distinct and not null.
    """
    spark, text = docs.sparkSession, F.col("text")
    words = F.coalesce(index_terms(text), F.array().cast("array<string>"))
    d = spread(docs).select(F.col("id").cast("long").alias("id"), F.when(text.isNotNull(), F.size(words)).alias("len"), F.concat(F.array(F.lit("")), words).alias("t"))  # "" is a row for the document itself
    d.select("id", "len", F.explode("t").alias("word")).groupBy("id", "len", "word").agg(F.count("*").alias("n")).write.parquet(f"{path}/words")
    counted = spark.read.schema("id long, len int, word string, n long").parquet(f"{path}/words")
    n, mean = counted.where("word = ''").agg(F.count("*"), F.coalesce(F.avg("len"), F.lit(0.0))).first()
    counted, blocks = counted.where("word <> ''"), max(1, -(-n // block_rows))
    numbers = F.lit(n).alias("documents"), F.lit(float(mean)).alias("mean"), F.lit(blocks).alias("blocks"), F.lit(buckets).alias("buckets")
    spark.range(1).select(*(c.cast(t) for c, t in zip(numbers, ("long", "double", "int", "int"), strict=True))).toDF("documents", "mean", "blocks", "buckets").coalesce(1).write.parquet(f"{path}/stats")
    # Stems are costly and the words' bytes few, so the number of tasks isn't left to their size.
    distinct = counted.select("word").distinct().repartition(int(spark.conf.get("spark.sql.shuffle.partitions")), "word")
    distinct.select("word", F.coalesce(stem(F.col("word")), F.lit("")).alias("term")).write.parquet(f"{path}/stems")
    stems = spark.read.schema("word string, term string").parquet(f"{path}/stems")
    stems = F.broadcast(stems) if stems.count() <= most_stems else stems
    block = F.pmod(F.xxhash64("id"), F.lit(blocks)).cast("int").alias("block")
    key = [F.pmod(F.xxhash64("term"), F.lit(buckets)).cast("int").alias("bucket"), F.col("term"), block]
    each = counted.join(stems, "word").select(*key, "id", "len", "n").repartitionByRange("bucket", "term", "block")
    tf = each.groupBy("bucket", "term", "block", "id", "len").agg(F.sum("n").alias("tf"))
    most = F.max(_weight(F.col("tf"), F.col("len"), F.lit(float(mean))))
    rows = tf.groupBy("bucket", "term", "block").agg(F.count("*").cast("int").alias("n"), most.alias("most"), F.sort_array(F.collect_list(F.struct("id", "tf", "len"))).alias("postings"))
    rows = rows.sortWithinPartitions("bucket", "term", "block")
    rows.write.option("parquet.bloom.filter.enabled#term", "true").partitionBy("bucket").parquet(f"{path}/postings")
    for used in ("words", "stems"):
        drop_path(spark, f"{path}/{used}")
    return open_index(spark, path)


@dataclass
class SearchIndex:
    postings: DataFrame
    documents: int
    mean: float
    blocks: int
    buckets: int

    def _terms(self, asked: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(asked terms that the index holds, with idf; their rows of the postings), by buckets first, so that the others' files aren't opened."""
        asked = staged(asked, "asked")  # stems are worked out once
        bucket = F.pmod(F.xxhash64("term"), F.lit(self.buckets)).cast("int")
        used = [r[0] for r in asked.select(bucket).distinct().collect()]  # at most `buckets`
        mine = self.postings.where(F.col("bucket").isin(used)).join(asked.select("term").distinct(), "term", "left_semi")
        df = mine.groupBy("term").agg(F.sum("n").alias("df"))
        return staged(asked.join(df, "term").withColumn("idf", _idf(F.lit(self.documents), F.col("df"))).drop("df"), "known"), mine

    def _scores(self, asked: DataFrame, mine: DataFrame, wanted: DataFrame | None = None, scope: DataFrame | None = None) -> DataFrame:
        """(block, query_id, id, score, matched) of all documents that hold a term of `asked` (query_id, term, idf), in the blocks of `wanted` (query_id, block), and of `scope`.

        Postings are dealt by block, once for all questions, and all terms of a block meet
        in one task: sums need no shuffle of their own, however many questions share a list.
        """
        parts = max(int(self.postings.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-self.blocks // BLOCKS_OF_A_TASK))
        lists = mine.select("term", "block", "postings").repartition(parts, "block")
        each = lists.join(self._small(asked), "term")
        if wanted is not None:
            each = each.join(self._small(wanted), ["query_id", "block"])
        each = each.select("block", "query_id", "idf", F.explode("postings").alias("p"))
        if scope is not None:
            each = each.join(self._small(scope.select(F.col("id").alias("_id"))), F.col("p.id") == F.col("_id"), "left_semi")
        part = F.col("idf") * _weight(F.col("p.tf"), F.col("p.len"), F.lit(float(self.mean)))
        return each.groupBy("block", "query_id", F.col("p.id").alias("id")).agg(F.round(F.sum(part), 6).alias("score"), F.count("*").alias("matched"))

    def _small(self, df: DataFrame) -> DataFrame:
        """`df`, kept once, and broadcast if it is short."""
        kept = staged(df, "side")
        return F.broadcast(kept) if kept.count() <= MOST_BROADCAST else kept

    def bm25(self, queries: DataFrame) -> DataFrame:
        """(query_id, id, score, matched) of every document that holds a term of the query."""
        asked, mine = self._terms(asked_terms(queries))
        return self._scores(asked, mine).drop("block")

    def search(self, queries: DataFrame, k: int = TOP_K, first_blocks: int = 2, scope: DataFrame | None = None) -> DataFrame:
        """(query_id, id, score, matched, rank): each question's k best documents, as `retrieval.sparse_topk` has them. queries: query_id, text.

        A question without terms, or whose terms no document holds, has no rows. Where
        the first blocks hold fewer than k documents, all of its blocks are scored. Only
        documents of `scope` (id) are found, if it is given; weights stay those of all.
        """
        asked, mine = self._terms(asked_terms(queries))
        met = mine.select("term", "block", "most").join(self._small(asked), "term")
        bound = staged(met.groupBy("query_id", "block").agg(F.sum(F.col("idf") * F.col("most")).alias("bound")), "bounds")
        best = [F.col("score").desc(), F.col("id")]
        first = top_k(bound, ["query_id"], [F.col("bound").desc(), F.col("block")], first_blocks).select("query_id", "block")
        tried = top_k(self._scores(asked, mine, first, scope), ["query_id"], best, k)
        floor = tried.groupBy("query_id").agg(F.when(F.count("*") == k, F.min("score")).alias("floor"))
        left = bound.join(floor, "query_id", "left").where(F.col("floor").isNull() | (F.col("bound") + _SLACK >= F.col("floor"))).select("query_id", "block")
        return top_k(self._scores(asked, mine, left, scope), ["query_id"], best, k).drop("block")

    def coverage(self, pairs: DataFrame, queries: DataFrame) -> DataFrame:
        """`pairs` (query_id, id, others) with `score`: the share of the question's distinct terms that the document holds. Questions without terms go. No text is read: only the pairs' blocks."""
        asked = staged(asked_terms(queries), "asked")
        known, mine = self._terms(asked)
        at = pairs.select("query_id", "id", F.pmod(F.xxhash64("id"), F.lit(self.blocks)).cast("int").alias("block"))
        lists = at.join(known.select("query_id", "term"), "query_id").join(mine.select("term", "block", F.transform("postings", lambda p: p["id"]).alias("ids")), ["term", "block"])
        held = lists.where(F.array_contains("ids", F.col("id"))).groupBy("query_id", "id").agg(F.count("*").alias("held"))
        n = asked.groupBy("query_id").agg(F.count("*").alias("n"))
        met = pairs.join(n, "query_id").join(held, ["query_id", "id"], "left")
        return met.select(*pairs.columns, F.round(F.coalesce("held", F.lit(0)) / F.col("n"), 6).alias("score"))


def open_index(spark: SparkSession, path: str) -> SearchIndex:
    stats = spark.read.schema(STATS).parquet(f"{path}/stats").first()
    return SearchIndex(spark.read.schema(POSTINGS).parquet(f"{path}/postings"), stats["documents"], stats["mean"], stats["blocks"], stats["buckets"])
