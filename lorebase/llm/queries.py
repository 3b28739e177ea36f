"""The registered queries of this subpackage: each applies one operator to its whole table."""

from __future__ import annotations

from collections.abc import Callable
from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import chat, license_scan, phrases, resampling
from .common import checkpoint, drop_folder, shared_folder, table
from .decontaminate import decontaminate
from .html_extract import extract_main_text
from .near_dedup import near_duplicates
from .packing import pack_documents
from .quality import quality_rules
from .secret_scan import scan_secrets
from .sharding import shard_documents
from .token_counts import count_tokens
from .toxicity import toxicity


def op1_balanced_label_propagation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_documents(table(spark, sf_dir, "documents"))


def op2_perspective_rotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    return chat.rotate_perspectives(table(spark, sf_dir, "conversations"))


def op3_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack_documents(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN)


def op4_toxicity_crf(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op5_bilstm_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_main_text(table(spark, sf_dir, "pages"))


def op6_multipart_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_secrets(table(spark, sf_dir, "documents")).drop("text_hash", "found")


def op7_kneser_ney_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality_rules(table(spark, sf_dir, "documents")).withColumn("log_perplexity", F.round("log_perplexity", 6))


def op8_winnowing_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))


def op10_sentence_rule_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(table(spark, sf_dir, "documents"))


def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The scored table goes once the result stands."""
    path = f"{shared_folder(spark)}/scored-{uuid4().hex}"
    out = checkpoint(resampling.resample(resampling.scored_table(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), path)))
    drop_folder(spark, path)
    return out


def op12_toivonen_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return phrases.collocations(table(spark, sf_dir, "documents"))


def op13_digest_cache_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Begins with an empty cache, so that every distinct text is encoded; the cache goes once the result stands. A kept `cache` folder serves later runs."""
    import public_tokenizers

    cache = f"{shared_folder(spark)}/token-counts-{uuid4().hex}"
    out = checkpoint(count_tokens(table(spark, sf_dir, "documents"), tokenizer_path=public_tokenizers.path("byte_bpe_50k.json"), pattern=public_tokenizers.PATTERN, cache=cache))
    drop_folder(spark, cache)
    return out


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (op1_balanced_label_propagation, op2_perspective_rotation, op3_best_fit_packing, op4_toxicity_crf, op5_bilstm_html_extraction, op6_multipart_secret_scan, op7_kneser_ney_quality, op8_winnowing_decontamination, op9_minhash_near_dedup, op10_sentence_rule_licenses, op11_importance_resampling, op12_toivonen_collocations, op13_digest_cache_token_counts)}


def oracle_sql() -> dict[str, str]:
    return {"op2_perspective_rotation": chat.SQL, "op10_sentence_rule_licenses": license_scan.SQL, "op11_importance_resampling": resampling.SQL, "op12_toivonen_collocations": phrases.SQL}
