"""A corpus pipeline of five stages: toxicity, near-duplicates, benchmark leaks, secrets, packing.

Each stage takes what its predecessor kept, written as Parquet and read again; all
but the last return the columns of `documents`.
"""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lorebase.llm.common import checkpoint, drop_folder, fresh, shared_folder, table
from lorebase.llm.decontaminate import contamination
from lorebase.llm.near_dedup import near_duplicates
from lorebase.llm.packing import pack_documents
from lorebase.llm.secret_scan import redact_secrets
from lorebase.llm.toxicity import toxicity


def _met(docs: DataFrame, keys: DataFrame, how: str) -> DataFrame:
    """`docs` joined with distinct `keys` (doc_id, text_hash, others) on id and text: rows that share an id, or have none, are told apart."""
    d, t = fresh(docs, "_d", "_t")
    keys = keys.withColumnsRenamed({"doc_id": d, "text_hash": t})
    return docs.join(keys, docs.doc_id.eqNullSafe(F.col(d)) & (F.xxhash64(docs.text) == F.col(t)), how)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger doesn't predict to be toxic. Repeated ids: only rows with a toxic text go; null texts are scored as empty ones are."""
    rows = docs.select("doc_id", "text", F.xxhash64("text").alias("text_hash"))
    scored = toxicity(rows, table(spark, sf_dir, "labels"), carry=("text_hash",))
    return _met(docs, scored.where("predicted = 1").select("doc_id", "text_hash").distinct(), "left_anti")


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row, that with the least id, of each group; null ids come last, equal rows count as copies, and rows without words are in no group."""
    kept, group = fresh(docs, "_kept", "_row")
    found = near_duplicates(docs, by_text=True).where("NOT kept OR copies > 1")
    rows = _met(docs, checkpoint(found.select("doc_id", "text_hash", F.col("kept").alias(kept))), "left")
    # Rows with the id and text of the kept one are copies of it; the first stands for them.
    copies = rows.where(F.col(kept)).groupBy("doc_id", F.xxhash64("text")).agg(F.first(F.struct(*docs.columns)).alias(group)).select(f"{group}.*")
    return rows.where(F.col(kept).isNull()).select(docs.columns).unionByName(copies)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no window of a benchmark item. Repeated ids: only rows whose text holds one go; null texts stay."""
    _, hits = contamination(docs, table(spark, sf_dir, "benchmark"))
    return _met(docs, hits.select("doc_id", "text_hash").distinct(), "left_anti")


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, repeated and null rows too; secrets in their texts give way to a mark, and n_chars follows."""
    return redact_secrets(docs).withColumn("n_chars", F.char_length("text").cast("long")).select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token pieces of all documents, packed into sequences."""
    import public_tokenizers

    return pack_documents(docs, tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("toxicity", drop_toxic),
    ("near_dedup", drop_near_duplicates),
    ("decontamination", drop_benchmark_leaks),
    ("secrets", mask_secrets),
    ("packing", pack),
]

#: SQL can't express the tagger, the tokenizer or MinHash; tests hold run() against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`; what each returns is written to the shared folder and read again. A stage's input goes once its output stands."""
    docs = table(spark, sf_dir, "documents")
    folder = f"{shared_folder(spark)}/pipeline-{uuid4().hex}"
    before = None
    for name, stage in STAGES:
        path = f"{folder}/{name}"
        stage(spark, docs, sf_dir).write.parquet(path)
        if before:
            drop_folder(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {"pipeline": run}


def oracle_sql() -> dict[str, str]:
    return {}
