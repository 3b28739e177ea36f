"""Cross-references: found in text, resolved to sections, made edges, walked."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions.text import normalise_no, normalise_title
from ..sources.cluster import dealt, staged

#: A section's number; a reference to sections, and one to a chapter or part, as a reader of statutes writes them; the numbers that a range may span.
_NUMBER = r"[0-9]{1,3}(?:-?[A-Z]{1,2})?"
SECTION_REF = rf"(?i)\b(?:sections?|ss?\.)\s*({_NUMBER}(?:\s*(?:,|and|or|to|&)\s*{_NUMBER})*)(?:\s+of\s+the\s+([A-Z][A-Za-z'()\- ]{{3,70}},?\s*(?:1[89][0-9]{{2}}|20[0-9]{{2}})))?"
PART_REF = r"\b((?:Chapter|Part)\s+(?:[IVXLC]{1,6}|[0-9]{1,2}))\b"
LONGEST_RANGE = 30


def extract_references(df: DataFrame, text: str = "text") -> DataFrame:
    """A row for each reference: all columns but the text, pos, kind (section or part), raw, numbers, act."""
    t = F.col(text)
    # The text is searched once; the groups are taken from the short matches.
    group = lambda raw, i: F.regexp_extract(raw, SECTION_REF, i)
    rows = F.transform(F.regexp_extract_all(t, F.lit(SECTION_REF), F.lit(0)), lambda raw: F.struct(F.lit("section").alias("kind"), raw.alias("raw"), group(raw, 1).alias("numbers"), F.nullif(group(raw, 2), F.lit("")).alias("act")))
    parts = F.transform(F.regexp_extract_all(t, F.lit(PART_REF), F.lit(1)), lambda x: F.struct(F.lit("part").alias("kind"), x.alias("raw"), F.lit("").alias("numbers"), F.lit(None).cast("string").alias("act")))
    others = [c for c in df.columns if c != text]
    return df.select(*others, F.posexplode(F.concat(rows, parts)).alias("pos", "r")).select(*others, "pos", "r.kind", F.substring("r.raw", 1, 200).alias("raw"), "r.numbers", "r.act")


def expanded(numbers):
    """The numbers of a list, as an array; `a to b` gives the whole range if 0 < b - a < 30 and both are plain, else both ends."""
    items = F.filter(F.split(numbers, r"(?i)\s*(?:,|and|or|&)\s*"), lambda x: x != "")

    def expand(item):
        ends = F.split(item, r"(?i)\s*to\s*")
        lo, hi = F.get(ends, 0).cast("int"), F.get(ends, 1).cast("int")
        return F.when((hi > lo) & (hi - lo < LONGEST_RANGE), F.transform(F.sequence(lo, F.greatest(lo, hi)), lambda n: n.cast("string"))).otherwise(ends)

    return F.flatten(F.transform(items, lambda x: F.when(x.rlike(r"(?i)^[0-9]+\s*to\s*[0-9]+$"), expand(x)).otherwise(F.split(x, r"(?i)\s*to\s*"))))


def expand_numbers(refs: DataFrame, numbers: str = "numbers") -> DataFrame:
    """`no`: a row for each number of the list."""
    return refs.withColumn("no", F.explode(expanded(F.col(numbers))))


def resolve_titles(phrases: DataFrame, statutes: DataFrame, phrase: str = "act") -> DataFrame:
    """(phrase, statute_id) for each distinct phrase: by its normalised title, else by the longest known title that it contains; null if none.

    A title is found by its head, as many of its first characters as the largest power of
    two that it has: heads meet those of the phrases' ends from each place on by equality,
    and the few titles of one head are then held against the text there. So neither side
    is broadcast, no phrase meets all titles, and equal lengths of title share one head.
    """
    known = statutes.select(F.col("id").alias("statute_id"), normalise_title(F.col("short_title")).alias("title")).where("title <> ''")
    known = known.withColumn("power", F.length(F.bin(F.length("title"))) - 1)
    known = known.withColumn("head", F.expr("substring(title, 1, shiftleft(1, CAST(power AS INT)))"))
    powers = [r[0] for r in known.select("power").distinct().collect()]  # one for each doubling of a title's length
    keys = phrases.where(F.col(phrase).isNotNull()).select(F.col(phrase).alias("phrase")).distinct().withColumn("key", normalise_title(F.col("phrase")))
    ends = keys.where("key <> ''").select("phrase", "key", F.explode(F.transform(F.sequence(F.lit(1), F.length("key")), lambda i: F.substring("key", i, F.length("key")))).alias("rest"))
    heads = F.array(*(F.when(F.length("rest") >= 1 << p, F.substring("rest", 1, 1 << p)) for p in powers)) if powers else F.array().cast("array<string>")
    met = ends.withColumn("head", F.explode(F.array_compact(heads))).join(known, "head").where(F.startswith("rest", "title"))
    best = F.max_by("statute_id", F.struct((F.col("key") == F.col("title")).cast("int"), F.length("title"), -F.col("statute_id")))
    return keys.select("phrase").join(met.groupBy("phrase").agg(best.alias("statute_id")), "phrase", "left")


def resolve_references(refs: DataFrame, sections: DataFrame, statutes: DataFrame, most_lists: int = 100_000) -> DataFrame:
    """(id, pos, no, raw, to_id, reason): edges where reason is null. `refs`: id, statute_id, pos, kind, raw, numbers, act; they are worked out once and kept, for their titles and their numbers.

    Acts and lists of numbers recur, so each distinct one is resolved once. Up to
    `most_lists` of either are looked up in a broadcast table; more acts are joined by a
    shuffle of the references that name one, and more lists are expanded row by row.
    """
    refs = staged(refs.select("id", "statute_id", "pos", "kind", "raw", "numbers", "act"), "references")
    acts = staged(resolve_titles(refs, statutes).withColumnRenamed("statute_id", "named"), "acts")
    hint = F.broadcast if acts.count() <= most_lists else (lambda x: x)
    own = refs.where("act IS NULL").withColumn("target", F.col("statute_id"))  # never shuffled: a null act would be one key
    other = refs.where("act IS NOT NULL").join(hint(acts), F.col("act") == F.col("phrase"), "left").withColumn("target", F.col("named"))
    r = own.unionByName(other.select(*own.columns))
    lists = refs.where("kind = 'section'").select("numbers").distinct()
    keyed = lambda c: F.transform(expanded(c), lambda x: F.struct(x.alias("no"), normalise_no(x).alias("key")))
    known = (F.col("kind") == "section") & F.col("target").isNotNull()
    if lists.count() <= most_lists:
        r = r.join(F.broadcast(lists.select("numbers", keyed(F.col("numbers")).alias("items"))), "numbers", "left")
    else:
        r = r.withColumn("items", F.when(known, keyed(F.col("numbers"))))
    none = F.array(F.struct(F.lit(None).cast("string").alias("no"), F.lit(None).cast("string").alias("key")))
    each = r.withColumn("item", F.explode(F.when(known, F.col("items")).otherwise(none))).select("id", "pos", "kind", "raw", "target", "item.no", "item.key")
    s = sections.select(F.col("statute_id").alias("target"), normalise_no(F.col("section_no")).alias("key"), F.col("id").alias("to_id")).groupBy("target", "key").agg(F.min("to_id").alias("to_id"))
    reason = F.when(F.col("kind") == "part", "no_part_hierarchy").when(F.col("target").isNull(), "act_not_in_corpus").when(F.col("to_id").isNull(), "section_not_found")
    met = each.join(s, ["target", "key"], "left").select("id", "pos", "no", "raw", "to_id", reason.alias("reason"))
    return met.where("to_id IS NULL OR to_id <> id")


def build_links(resolved: DataFrame) -> DataFrame:
    """One edge for each (from, to) with its last raw text."""
    return resolved.where("reason IS NULL").groupBy(F.col("id").alias("from_section_id"), F.col("to_id").alias("to_section_id")).agg(F.max_by("raw", F.struct("pos", "no")).alias("raw_text"))


def related(links: DataFrame, sections: DataFrame, statutes: DataFrame, most_links: int | None = None) -> DataFrame:
    """Neighbours of every section in both directions, each once for a direction, with title and number.

    Links are made distinct before they are turned round. The sections are hashed, so that
    the many neighbours need no sort. With `most_links`, what the links number at most, a
    task has a bounded share of them.
    """
    links = links.select("from_section_id", "to_section_id").distinct()
    out = links.select(F.col("from_section_id").alias("id"), F.col("to_section_id").alias("other"), F.lit("outbound").alias("direction"))
    into = links.select(F.col("to_section_id").alias("id"), F.col("from_section_id").alias("other"), F.lit("inbound").alias("direction"))
    s = sections.select(F.col("id").alias("other"), "section_no", "statute_id").join(statutes.select(F.col("id").alias("statute_id"), "short_title"), "statute_id")
    each = out.unionByName(into)
    each = each if most_links is None else dealt(each, 2 * most_links, "other")
    return each.join(s.hint("shuffle_hash"), "other").select("id", "direction", "other", "short_title", "section_no")


def expand_one_hop(kept: DataFrame, links: DataFrame) -> DataFrame:
    """(query_id, section_id) that kept sections refer to and that aren't kept themselves."""
    step = kept.select("query_id", F.col("section_id").alias("from_section_id")).distinct().join(links, "from_section_id").select("query_id", F.col("to_section_id").alias("section_id")).distinct()
    return step.join(kept.select("query_id", "section_id"), ["query_id", "section_id"], "left_anti")


def numbered_by(df: DataFrame, keys: list[str], order: list, out: str = "rn") -> DataFrame:
    return df.withColumn(out, F.row_number().over(W.partitionBy(*keys).orderBy(*order)))
