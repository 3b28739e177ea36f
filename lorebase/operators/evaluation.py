"""Metrics of scored runs against labels."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.cluster import dealt

KS = (1, 3, 6, 10, 20)


def _ranked(scored: DataFrame) -> DataFrame:
    """(case_id, section_id, best, rank). Chunks go by score, then section: so a section's first chunk is its best, and sections go by these."""
    best = dealt(scored, scored.count(), "case_id").groupBy("case_id", "section_id").agg(F.max("score").alias("best"))
    return best.withColumn("rank", F.row_number().over(W.partitionBy("case_id").orderBy(F.col("best").desc(), "section_id")))


def section_ranks(scored: DataFrame) -> DataFrame:
    """(case_id, section_id, rank): distinct sections in order of their first chunk. scored: case_id, section_id, score, line."""
    return _ranked(scored).select("case_id", "section_id", "rank")


def outcomes(cases: DataFrame, scored: DataFrame) -> DataFrame:
    """Each case with top_score (best chunk) and first_correct (rank of the expected section, null if absent)."""
    asked = cases.select(F.col("id").alias("case_id"), "expected_id")
    each = _ranked(scored).join(asked, "case_id").groupBy("case_id")
    met = each.agg(F.max("best").alias("top_score"), F.min(F.when(F.col("section_id") == F.col("expected_id"), F.col("rank"))).alias("first_correct"))
    return cases.join(met, cases.id == met.case_id, "left").drop("case_id")


def recall_at(out: DataFrame) -> DataFrame:
    labelled = out.where("NOT must_abstain")
    cols = [F.coalesce(F.avg(F.coalesce((F.col("first_correct") <= k), F.lit(False)).cast("int")), F.lit(0.0)).alias(f"recall_{k}") for k in KS]
    return labelled.agg(*(F.round(c, 9).alias(f"recall_{k}") for c, k in zip(cols, KS, strict=True)))


def report_lines(out: DataFrame, wrong: DataFrame) -> DataFrame:
    """The report as JSON lines: one of totals, and one for each case of `wrong` (id, topic, kind, top_score, first_correct); four decimals."""
    totals = recall_at(out).crossJoin(mrr(out))  # one row each
    totals = totals.select(F.to_json(F.struct(F.lit("totals").alias("kind"), *(F.round(c, 4).alias(c) for c in totals.columns))).alias("line"))
    cases = wrong.select(F.to_json(F.struct("kind", "id", "topic", F.round("top_score", 4).alias("top_score"), "first_correct")).alias("line"))
    return totals.unionByName(cases)


def mrr(out: DataFrame) -> DataFrame:
    return out.where("NOT must_abstain").agg(F.round(F.coalesce(F.avg(F.coalesce(1.0 / F.col("first_correct"), F.lit(0.0))), F.lit(0.0)), 9).alias("mrr"))


def abstention(out: DataFrame, floors: list[float]) -> DataFrame:
    """(floor, abstention_accuracy, false_abstention): abstained is a top score under the floor, or none; a few floors for each case, no rescoring."""
    gone = F.coalesce(F.col("top_score") < F.col("floor"), F.lit(True)).cast("int")
    each = out.withColumn("floor", F.explode(F.array(*(F.lit(f) for f in floors))))
    rate = lambda on: F.round(F.coalesce(F.avg(F.when(on, gone)), F.lit(0.0)), 9)
    return each.groupBy("floor").agg(rate(F.col("must_abstain")).alias("abstention_accuracy"), rate(~F.col("must_abstain")).alias("false_abstention"))


def percentiles(df: DataFrame, value: str, wanted: list[int]) -> DataFrame:
    """(pct, value): nearest rank, half-even rounded. Works on counts of equal values, so no task sees all rows."""
    freq = df.where(F.col(value).isNotNull()).groupBy(F.col(value).alias("value")).agg(F.count("*").alias("n"))
    up = freq.withColumn("upto", F.sum("n").over(W.orderBy("value").rowsBetween(W.unboundedPreceding, 0)))
    total = freq.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("total")).withColumn("pct", F.explode(F.array(*(F.lit(p) for p in wanted))))
    at = F.bround(F.col("pct") / 100.0 * (F.col("total") - 1), 0).cast("long")
    met = total.withColumn("at", at).join(F.broadcast(up), F.col("upto") > F.col("at"), "left")  # one row for each distinct value
    return met.groupBy("pct").agg(F.coalesce(F.min("value"), F.lit(0)).cast("long").alias("value"))


def stratified_sample(cases: DataFrame, strata: list[str], size: int) -> DataFrame:
    """At most `size` cases by id: of each stratum its share, half-even rounded, one at least; all if there are no more."""
    counts = cases.groupBy(*strata).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    take = counts.crossJoin(F.broadcast(total)).select(*strata, F.when(F.col("total") <= size, F.col("n")).otherwise(F.greatest(F.lit(1), F.bround(F.col("n") * size / F.col("total"), 0))).cast("int").alias("take"), "total")
    first = cases.withColumn("rn", F.row_number().over(W.partitionBy(*strata).orderBy("id"))).where(F.col("rn") <= size)
    return first.join(F.broadcast(take), strata).where("rn <= take").select("id", *strata).orderBy("id").limit(size)
