"""The manifest of acts and the gold file: read by Spark, checked before anything is built on them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import normalise_no

ENTRY = "slug string, short_title string, tier int, act_id string, handle string, act_number string, year int, jurisdiction string, level string, ministry string, expected_sections int"
_CASE = "struct<id:string,question:string,topic:string,must_abstain:boolean,expected:array<struct<statute_slug:string,sections:array<string>>>>"
GOLD = f"in_corpus array<{_CASE}>, adversarial array<{_CASE}>"


def duplicates(entries: DataFrame) -> DataFrame:
    """(slug, n) of slugs that stand more than once."""
    return entries.groupBy("slug").agg(F.count("*").alias("n")).where("n > 1")


def _fail(rows: DataFrame, column: str, what: str) -> None:
    bad = [str(r[0]) for r in rows.select(column).orderBy(column).limit(10).collect()]
    if bad:
        raise ValueError(f"{what}: {', '.join(bad)}")


def read_manifest(spark: SparkSession, path: str) -> DataFrame:
    """Entries from JSON lines under `path`; a slug that stands twice is an error."""
    entries = spark.read.schema(ENTRY).json(path)
    _fail(duplicates(entries), "slug", "repeated slugs")
    return entries


def select_acts(entries: DataFrame, *, tier: int | None = None, slug: str | None = None) -> DataFrame:
    """Entries of a tier, of a slug, or of both; a slug that selects nothing is an error."""
    out = entries.where(F.lit(True) if tier is None else F.col("tier") == tier)
    if slug is not None:
        out = out.where(F.col("slug") == slug)
        if out.isEmpty():
            raise ValueError(f"unknown slug: {slug}")
    return out


def read_gold(spark: SparkSession, path: str) -> DataFrame:
    """(id, question, topic, must_abstain, statute_slug, section_no): a row for each expected section of each case, one with nulls for a case that expects none."""
    file = spark.read.schema(GOLD).option("multiLine", True).json(path)
    cases = file.select(F.explode("in_corpus").alias("c")).unionByName(file.select(F.explode("adversarial").alias("c"))).select("c.*")
    cases = cases.withColumn("must_abstain", F.coalesce("must_abstain", F.lit(False))).withColumn("e", F.explode_outer("expected"))
    return cases.select("id", "question", "topic", "must_abstain", "e.statute_slug", F.explode_outer("e.sections").alias("section_no"))


def resolve_gold(gold: DataFrame, sections: DataFrame) -> DataFrame:
    """(id, question, topic, must_abstain, expected_section_ids); a label without a section is an error that names it. sections: id, slug, section_no."""
    keyed = sections.select(F.col("slug").alias("statute_slug"), normalise_no(F.col("section_no")).alias("key"), F.col("id").alias("section_id")).groupBy("statute_slug", "key").agg(F.min("section_id").alias("section_id"))
    met = gold.withColumn("key", normalise_no(F.col("section_no"))).join(keyed, ["statute_slug", "key"], "left")
    _fail(met.where("section_no IS NOT NULL AND section_id IS NULL").select(F.concat_ws(" s. ", "statute_slug", "section_no").alias("label")).distinct(), "label", "labels without a section")
    return met.groupBy("id", "question", "topic", "must_abstain").agg(F.array_sort(F.collect_set("section_id")).alias("expected_section_ids"))
