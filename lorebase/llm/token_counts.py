"""Token counts through a cache that is keyed by digests of content and tokenizer.

1. A narrow pass takes the SHA-256 of each normalised text. Digests, never texts, meet
   the stored counts of this tokenizer's version.
2. A text that no other row has is encoded where it stands. Copies of one text meet
   after one of them has been chosen in each task, and one of those is encoded.
3. What was encoded is appended to the cache, and each row takes its count from there.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Iterator
from hashlib import sha256
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import checkpoint, path_exists, ship
from .packing import tokens

#: Raised when the way of counting changes, so that stored counts of the old way are not used.
_WAY = "1"
_loaded: dict[tuple[str, str | None], Callable[[list[str]], list[int]]] = {}


def tokenizer_version(path: str) -> str:
    """Digest of the tokenizer file and of the way of counting: 32 hex characters."""
    return sha256(_WAY.encode() + Path(path).suffix.encode() + Path(path).read_bytes()).hexdigest()[:32]


def counter(path: str, pattern: str | None = None) -> Callable[[list[str]], list[int]]:
    """Counts of a list of texts, as the file's library gives them: no begin, end or added special tokens, no truncation or padding.

    A byte-level BPE whose split pattern is given is encoded by its ranks (see `packing.Tokens`).
    """
    if (path, pattern) not in _loaded:
        _loaded[path, pattern] = _load(path, pattern)
    return _loaded[path, pattern]


def _load(path: str, pattern: str | None) -> Callable[[list[str]], list[int]]:
    if path.endswith(".model"):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        return lambda texts: [len(x) for x in model.encode(texts, num_threads=1)]
    plain = path.endswith(".tiktoken")
    if not plain:
        file = json.loads(Path(path).read_text())
        plain = pattern is not None and (file.get("pre_tokenizer") or {}).get("type") == "ByteLevel" and not file.get("normalizer") and not file["pre_tokenizer"].get("add_prefix_space")
    if plain:
        encode = tokens(path, pattern)
        return lambda texts: [len(encode(x)) // 4 for x in texts]
    import os

    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    model = Tokenizer.from_file(path)
    model.no_truncation()
    model.no_padding()
    return lambda texts: [len(x) for x in model.encode_batch_fast(texts, add_special_tokens=False)]


def _encoder(path: str, pattern: str | None) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = counter(path, pattern)
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                n = count([x or "" for x in part.column("text").to_pylist()])
                yield pa.RecordBatch.from_arrays([part.column("digest"), pa.array(n, pa.int64())], ["digest", "n_tokens"])

    return encode


def stored_counts(spark: SparkSession, cache: str, version: str) -> DataFrame:
    """(digest, n_tokens) that the cache holds of one tokenizer version, each digest once, though two runs may have stored it at the same time."""
    path, schema = f"{cache}/tokenizer={version}", "digest binary, n_tokens long"
    rows = spark.read.schema(schema).parquet(path) if path_exists(spark, path) else spark.createDataFrame([], schema)
    return rows.groupBy("digest").agg(F.max("n_tokens").alias("n_tokens"))


def count_tokens(
    documents: DataFrame,
    *,
    tokenizer_path: str,
    cache: str,
    pattern: str | None = None,
    limit: int = 1024,
    normalise: Callable[[Column], Column] | None = None,
    id_col: str = "doc_id",
    text_col: str = "text",
    broadcast_rows: int = 200_000,
) -> DataFrame:
    """One row for each row of `documents`: doc_id, n_bytes (UTF-8), n_tokens, over_limit (more than `limit` tokens).

    `cache` is a folder that the cluster shares; counts are facts, so a run that ends
    halfway leaves only right ones. `normalise` may map texts to ones of the same tokens,
    so that more of them share a digest; by default only null becomes empty. `n_bytes`
    is of the text as given. Repeated rows each have their row; null ids stay; an empty
    table gives an empty result and stores nothing; other columns are ignored.

    Digests that rows share, or that are stored, are broadcast if they are at most
    `broadcast_rows`, and so are the missing ones; where both are more, one text of each
    digest and task is shuffled. Digests of at least a thousandth of all rows, so at most
    1,000, meet their rows by broadcast, so that copies gather in no task.
    """
    spark = documents.sparkSession
    ship(spark)
    version = tokenizer_version(tokenizer_path)
    given = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    text = normalise(given) if normalise else given
    digest = F.unhex(F.sha2(text.cast("binary"), 256))
    rows = checkpoint(documents.select(F.col(id_col).alias("doc_id"), F.octet_length(given).cast("long").alias("n_bytes"), digest.alias("digest")))
    stored = stored_counts(spark, cache, version).withColumn("is_stored", F.lit(True))
    known = checkpoint(rows.groupBy("digest").agg(F.count("*").alias("copies")).join(stored, "digest", "left"))
    n, missing, listed = known.agg(F.coalesce(F.sum("copies"), F.lit(0)), F.count_if(F.col("is_stored").isNull()), F.count_if(F.col("is_stored").isNotNull() | (F.col("copies") > 1))).first()
    if missing:
        new = _texts(documents.select(digest.alias("digest"), text.alias("text")), known, missing, listed, broadcast_rows).mapInArrow(_encoder(tokenizer_path, pattern), "digest binary, n_tokens long")
        new.write.mode("append").parquet(f"{cache}/tokenizer={version}")
    counts = stored_counts(spark, cache, version)
    hot = checkpoint(known.where(F.col("copies") * 1000 >= n).select("digest").join(counts, "digest").select("digest", F.col("n_tokens").alias("hot_tokens")))
    rows = rows.join(F.broadcast(hot), "digest", "left")
    rest = rows.where("hot_tokens IS NULL").drop("hot_tokens").join(counts, "digest")
    out = rows.where("hot_tokens IS NOT NULL").withColumnRenamed("hot_tokens", "n_tokens").unionByName(rest)
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def _texts(texts: DataFrame, known: DataFrame, missing: int, listed: int, broadcast_rows: int) -> DataFrame:
    """(digest, text) of each missing digest, once. known: digest, copies, is_stored."""
    wanted = known.where("is_stored IS NULL").select("digest", "copies")
    if listed <= broadcast_rows:
        told = known.where("is_stored IS NOT NULL OR copies > 1").select("digest", F.when(F.col("is_stored").isNull(), F.col("copies")).otherwise(0).alias("copies"))
        texts = texts.join(F.broadcast(told), "digest", "left").withColumn("copies", F.coalesce("copies", F.lit(1)))
    elif missing <= broadcast_rows:
        texts = texts.join(F.broadcast(wanted), "digest")
    else:
        return _one_each(texts).join(wanted.select("digest"), "digest", "left_semi")
    return texts.where("copies = 1").select("digest", "text").unionByName(_one_each(texts.where("copies > 1")))


def _one_each(texts: DataFrame) -> DataFrame:
    """One text of each digest; each task first keeps one of its own."""
    return texts.groupBy("digest").agg(F.first("text").alias("text"))
