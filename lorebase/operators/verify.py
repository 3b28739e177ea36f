"""Checks of parsed sections, as rows of (slug or act, level, kind, detail)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import section_no_sort

CELL = 4096


def numeric_prefix(no):
    return F.nullif(F.regexp_extract(no, "^([0-9]+)", 1), F.lit("")).cast("int")


def gaps(sections: DataFrame) -> DataFrame:
    """(statute_id, after, before, gap, level) between distinct number prefixes: fail over 200."""
    n = sections.select("statute_id", numeric_prefix(F.col("section_no")).alias("n")).where("n IS NOT NULL").distinct().withColumn("cell", F.floor(F.col("n") / CELL))
    # The number before is in the own cell, or the greatest of the nearest cell below: a large act needs no single task.
    cells = n.groupBy("statute_id", "cell").agg(F.max("n").alias("most")).select("statute_id", "cell", F.lag("most").over(W.partitionBy("statute_id").orderBy("cell")).alias("below"))
    inside = F.lag("n").over(W.partitionBy("statute_id", "cell").orderBy("n"))
    d = n.withColumn("inside", inside).join(cells, ["statute_id", "cell"]).withColumn("prev", F.coalesce("inside", "below")).withColumn("gap", F.col("n") - F.col("prev") - 1).where("gap >= 1")
    return d.select("statute_id", F.col("prev").alias("after"), F.col("n").alias("before"), "gap", F.when(F.col("gap") > 200, "error").otherwise("warn").alias("level"))


def duplicate_numbers(sections: DataFrame, keys: list[str]) -> DataFrame:
    return sections.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def note_coverage(sections: DataFrame, note: str) -> DataFrame:
    """(statute_id, with_note, total) where some sections but not all have a note."""
    g = sections.groupBy("statute_id").agg(F.count_if(F.col(note) != "").alias("with_note"), F.count("*").alias("total"))
    return g.where("with_note > 0 AND with_note < total")


def count_drift(counts: DataFrame, expected: DataFrame, key: str) -> DataFrame:
    """(key, n, expected, level): ok, warn within max(5, 5 %), error beyond."""
    off = F.abs(F.col("n") - F.col("expected"))
    level = F.when(off == 0, "ok").when(off <= F.greatest(F.lit(5), F.floor(F.col("expected") / 20)), "warn").otherwise("error")
    return counts.join(expected, key).select(key, "n", "expected", level.alias("level"))


SHORT, LONG, LISTED = 40, 12_000, 10


def findings(statutes: DataFrame, sections: DataFrame, expected: DataFrame) -> DataFrame:
    """(statute_id, level, kind, detail): all that verification has to say, a row for each finding; an act without an error is good.

    statutes: id; sections: statute_id, section_no, order_idx, marginal_note,
    text_verbatim, is_omitted; expected: statute_id, expected (sections in force).
    Missing marginal notes count where other sections of the act have one; the first ten
    of them are named.
    """
    def row(level: str | Column, kind: str | Column, *detail: str | Column) -> list[Column]:
        as_col = lambda x: F.lit(x) if isinstance(x, str) else x.cast("string")
        return ["statute_id", as_col(level).alias("level"), as_col(kind).alias("kind"), F.concat(*map(as_col, detail)).alias("detail")]

    no, n = F.col("section_no"), F.char_length("text_verbatim")
    one = lambda on, level, kind, *detail: F.when(on, F.struct(*row(level, kind, *detail)[1:]))
    live = ~F.col("is_omitted")
    each = F.array_compact(F.array(
        one(section_no_sort(no).isNull(), "error", "unsortable_section_no", no), one(live & (n < SHORT), "warn", "short_section", "s.", no, " is ", n, " chars"),
        one(live & (n > LONG), "warn", "long_section", "s.", no, " is ", n, " chars"), one(live & (F.trim("text_verbatim") == ""), "error", "empty_section", "s.", no, " has no text"),
    ))
    out = [sections.select("statute_id", F.explode(each).alias("f")).select("statute_id", "f.*")]
    out.append(duplicate_numbers(sections, ["statute_id", "section_no"]).select(*row("error", "duplicate_section_no", no)))
    first = sections.groupBy("statute_id").agg(F.min(numeric_prefix(no)).alias("low")).where("low <> 1")
    out.append(first.select(*row("warn", "no_section_1", "lowest section number is ", F.col("low"))))
    gap = gaps(sections)
    out.append(gap.select(*row(F.col("level"), F.when(F.col("level") == "error", "implausible_gap").otherwise("section_gap"), "nothing between ", F.col("after"), " and ", F.col("before"), " (", F.col("gap"), " numbers)")))
    bare = F.coalesce(F.col("marginal_note"), F.lit("")) == ""
    place = F.row_number().over(W.partitionBy("statute_id").orderBy("order_idx", "section_no"))
    named = sections.where(bare).withColumn("place", place).where(F.col("place") <= LISTED).groupBy("statute_id").agg(F.array_sort(F.collect_list(F.struct("place", "section_no"))).alias("names"))
    partly = note_coverage(sections, "marginal_note").join(named, "statute_id")
    out.append(partly.select(*row("warn", "missing_marginal_note", F.col("total") - F.col("with_note"), " of ", F.col("total"), " sections: ", F.array_join(F.transform("names", lambda x: x["section_no"]), ", "))))
    counts = sections.groupBy("statute_id").agg(F.count_if(live).alias("n"))
    drift = count_drift(counts, expected, "statute_id").where("level <> 'ok'")
    out.append(drift.select(*row(F.col("level"), "section_count_drift", "parsed ", F.col("n"), " in-force sections, oracle expects ", F.col("expected"))))
    none = statutes.select(F.col("id").alias("statute_id")).join(sections.select("statute_id"), "statute_id", "left_anti")
    out.append(none.select(*row("error", "empty", "no sections parsed")))
    rows = out[0]
    for more in out[1:]:
        rows = rows.unionByName(more)
    return rows


def require_good(rows: DataFrame) -> None:
    """An error that names some of the findings of level error, if there is one; else nothing."""
    bad = rows.where("level = 'error'").limit(5).collect()
    if bad:
        raise ValueError("; ".join(f"{r['statute_id']}: {r['kind']}: {r['detail']}" for r in bad))


def violations(statutes: DataFrame, sections: DataFrame, chunks: DataFrame, links: DataFrame, runs: DataFrame, logs: DataFrame) -> DataFrame:
    """(rule, key): rows that break a rule of the schema, and keys that should be unique.

    statutes: slug, year, source_sha256, level; sections: statute_id, section_no,
    order_idx; chunks: section_id, chunk_idx, token_count; links: from_section_id,
    to_section_id, relation; runs: id, status; logs: id, answered, abstained.
    """
    def broken(df: DataFrame, key: list[str], **rules: Column) -> DataFrame:
        hit = F.array_compact(F.array(*(F.when(on, F.lit(name)) for name, on in rules.items())))
        return df.select(F.explode(hit).alias("rule"), F.concat_ws("/", *key).alias("key"))

    def repeated(df: DataFrame, rule: str, key: list[str]) -> DataFrame:
        return df.groupBy(*key).agg(F.count("*").alias("n")).where("n > 1").select(F.lit(rule).alias("rule"), F.concat_ws("/", *key).alias("key"))

    out = broken(statutes, ["slug"], year_range=~F.col("year").between(1800, 2200), sha256_length=F.char_length("source_sha256") != 64, level=~F.col("level").isin("central", "state"))
    out = out.union(repeated(statutes, "unique_slug", ["slug"])).union(repeated(sections, "unique_section_no", ["statute_id", "section_no"])).union(repeated(sections, "unique_order_idx", ["statute_id", "order_idx"]))
    out = out.union(broken(chunks, ["section_id", "chunk_idx"], token_count=F.col("token_count") <= 0)).union(repeated(chunks, "unique_chunk_idx", ["section_id", "chunk_idx"]))
    edge = ["from_section_id", "to_section_id", "relation"]
    out = out.union(broken(links, edge, relation=~F.col("relation").isin("refers_to", "amended_by", "see_also"), self_loop=F.col("from_section_id") == F.col("to_section_id"))).union(repeated(links, "unique_edge", edge))
    out = out.union(broken(runs, ["id"], status=~F.col("status").isin("running", "succeeded", "partial", "failed")))
    return out.union(broken(logs, ["id"], answered_and_abstained=F.col("answered") & F.col("abstained")))
