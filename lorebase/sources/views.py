"""The knowledge base's tables as views of the given ones, and the same views as DuckDB SQL."""

from __future__ import annotations

from functools import cached_property

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .cluster import dealt

#: View: the views that it needs, and its SQL.
SQL: dict[str, tuple[tuple[str, ...], str]] = {
    "statutes": ((), """SELECT CAST(row_number() OVER (ORDER BY slug) AS BIGINT) AS id, slug, 'Code ' || chr(64 + CAST(row_number() OVER (ORDER BY slug) AS INT)) || ' Act, ' || (1800 + 7 * row_number() OVER (ORDER BY slug)) AS short_title,
        CAST(1800 + 7 * row_number() OVER (ORDER BY slug) AS INT) AS year FROM (SELECT DISTINCT source AS slug FROM documents)"""),
    "sections": (("statutes",), """SELECT d.doc_id AS id, s.id AS statute_id, CAST(d.doc_id // 2 + 1 AS VARCHAR) || CASE WHEN d.doc_id % 2 = 0 THEN '' WHEN (d.doc_id // 2) % 2 = 0 THEN 'A' ELSE '-A' END AS section_no,
        d.doc_id AS order_idx, left(split_part(d.text, chr(10), 1), 60) AS marginal_note, d.text AS text_verbatim, coalesce(l.quality, 1) = 0 AS is_omitted
        FROM documents d JOIN statutes s ON s.slug = d.source LEFT JOIN labels l ON l.doc_id = d.doc_id"""),
    "links": ((), """SELECT DISTINCT l_orderkey % n AS from_section_id, l_partkey % n AS to_section_id FROM lineitem, (SELECT count(*) AS n FROM documents) WHERE l_orderkey % n <> l_partkey % n"""),
    "refs_text": ((), """SELECT l_orderkey * 10 + l_linenumber AS id, l_suppkey % 20 + 1 AS statute_id, CASE l_linenumber % 5
        WHEN 0 THEN 'Subject to section ' || l_linenumber || ' and to section ' || (l_orderkey % 90 + 1) || 'A of the Code ' || chr(CAST(65 + l_partkey % 22 AS INT)) || ' Act, ' || (1807 + 7 * (l_partkey % 22)) || '.'
        WHEN 1 THEN 'See sections ' || l_linenumber || ', ' || (l_linenumber + 3) || ' and ' || (l_partkey % 80 + 1) || ' to ' || (l_partkey % 80 + 4) || ' as amended; Chapter IV applies.'
        WHEN 2 THEN 'Nothing in Part III or s. ' || (l_orderkey % 99 + 1) || ' applies to ss. 3 to 40.'
        WHEN 3 THEN 'Under section ' || (l_partkey % 99 + 1) || 'B of the Amended Code ' || chr(CAST(65 + l_orderkey % 20 AS INT)) || ' Act, ' || (1807 + 7 * (l_orderkey % 20)) || ' the rule holds.'
        ELSE 'No reference stands here.' END AS text FROM lineitem"""),
    "gold": ((), """SELECT b.item_id AS id, b.text AS question, coalesce(list(d.doc_id ORDER BY d.doc_id) FILTER (WHERE d.doc_id IS NOT NULL), []) AS expected, count(d.doc_id) = 0 AS must_abstain
        FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) GROUP BY 1, 2"""),
    "scored": ((), """SELECT l_orderkey AS case_id, l_partkey % 40 AS section_id, ((l_orderkey * 31 + l_partkey * 17 + l_linenumber * 7) % 1000) / 1000.0 AS score, l_linenumber AS line FROM lineitem"""),
    "cases": (("scored",), """SELECT case_id AS id, case_id % 4 = 3 AS must_abstain, 'topic' || (case_id % 7) AS topic, case_id % 40 AS expected_id, 50 + case_id % 977 AS latency_ms FROM (SELECT DISTINCT case_id FROM scored)"""),
    "answers": ((), """SELECT event_id AS answer_id, user_id % 7 AS attempt_key, CASE event_type WHEN 'view' THEN 'It holds [S' || (event_id % 50) || '].' WHEN 'click' THEN 'See [S' || (event_id % 50) || ', S' || (event_id % 13) || '] and [2].' WHEN 'signup' THEN 'As [State Government] says.' WHEN 'error' THEN 'Bare S' || event_id || ' and [S19(c)] stand.' ELSE 'By [S9999] it fails.' END AS text,
        [event_id % 50, event_id % 13, 19] AS allowed FROM events"""),
}


def with_views(sql: str, *names: str) -> str:
    """`sql` after the definitions of the named views and of those that they need."""
    order: list[str] = []

    def add(name: str) -> None:
        for x in SQL[name][0]:
            add(x)
        if name not in order:
            order.append(name)

    for name in names:
        add(name)
    clauses = ",\n".join(f"{x} AS ({SQL[x][1]})" for x in order)
    if not clauses:
        return sql
    rest = sql.lstrip()
    for word in ("WITH RECURSIVE", "WITH"):
        if rest.startswith(word):
            return f"{word} {clauses},\n{rest[len(word) :].lstrip()}"
    return f"WITH {clauses}\n{rest}"


class Views:
    """The views over one folder of tables, each built when first asked for."""

    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def most_links(self) -> int:
        """Links before equal ones are put together."""
        return self.table("lineitem").count()

    @cached_property
    def statutes(self) -> DataFrame:
        from pyspark.sql import Window as W

        n = F.row_number().over(W.orderBy("slug"))  # one row for each source
        s = self.table("documents").select(F.col("source").alias("slug")).distinct().withColumn("id", n.cast("long"))
        year = 1800 + 7 * F.col("id")
        return s.select("id", "slug", F.concat(F.lit("Code "), F.char(64 + F.col("id")), F.lit(" Act, "), year.cast("string")).alias("short_title"), year.cast("int").alias("year"))

    @cached_property
    def sections(self) -> DataFrame:
        d = self.table("documents")
        half = F.floor(F.col("doc_id") / 2)
        suffix = F.when(F.col("doc_id") % 2 == 0, "").when(half % 2 == 0, "A").otherwise("-A")
        s = self.statutes.select(F.col("id").alias("statute_id"), "slug")
        lab = self.table("labels").select("doc_id", "quality")
        return d.join(s, d.source == s.slug).join(lab, "doc_id", "left").select(
            F.col("doc_id").alias("id"), "statute_id", F.concat((half + 1).cast("string"), suffix).alias("section_no"), F.col("doc_id").alias("order_idx"),
            F.substring(F.substring_index("text", "\n", 1), 1, 60).alias("marginal_note"), F.col("text").alias("text_verbatim"), (F.coalesce("quality", F.lit(1)) == 0).alias("is_omitted"),
        )

    @cached_property
    def links(self) -> DataFrame:
        n = self.table("documents").count()
        a, b = F.col("l_orderkey") % n, F.col("l_partkey") % n
        pairs = self.table("lineitem").select(a.alias("from_section_id"), b.alias("to_section_id")).where("from_section_id <> to_section_id")
        return dealt(pairs, self.most_links, "from_section_id", "to_section_id").distinct()

    @cached_property
    def refs_text(self) -> DataFrame:
        o, p, k = F.col("l_orderkey"), F.col("l_partkey"), F.col("l_linenumber")
        s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
        text = F.when(k % 5 == 0, s("Subject to section ", k, " and to section ", o % 90 + 1, "A of the Code ", F.char(65 + p % 22), " Act, ", 1807 + 7 * (p % 22), "."))
        text = text.when(k % 5 == 1, s("See sections ", k, ", ", k + 3, " and ", p % 80 + 1, " to ", p % 80 + 4, " as amended; Chapter IV applies."))
        text = text.when(k % 5 == 2, s("Nothing in Part III or s. ", o % 99 + 1, " applies to ss. 3 to 40."))
        text = text.when(k % 5 == 3, s("Under section ", p % 99 + 1, "B of the Amended Code ", F.char(65 + o % 20), " Act, ", 1807 + 7 * (o % 20), " the rule holds."))
        return self.table("lineitem").select((o * 10 + k).alias("id"), (F.col("l_suppkey") % 20 + 1).alias("statute_id"), text.otherwise("No reference stands here.").alias("text"))

    @cached_property
    def gold(self) -> DataFrame:
        b = self.table("benchmark").select(F.col("item_id").alias("id"), F.col("text").alias("question"))
        d = self.table("documents").select("doc_id", "text")
        found = d.join(F.broadcast(b), F.contains("text", "question")).groupBy("id").agg(F.array_sort(F.collect_list("doc_id")).alias("expected"))
        none = F.array().cast("array<bigint>")
        return b.join(found, "id", "left").select("id", "question", F.coalesce("expected", none).alias("expected"), F.col("expected").isNull().alias("must_abstain"))

    @cached_property
    def scored(self) -> DataFrame:
        return self.table("lineitem").select(F.col("l_orderkey").alias("case_id"), (F.col("l_partkey") % 40).alias("section_id"), (((F.col("l_orderkey") * 31 + F.col("l_partkey") * 17 + F.col("l_linenumber") * 7) % 1000) / 1000.0).alias("score"), F.col("l_linenumber").alias("line"))

    @cached_property
    def cases(self) -> DataFrame:
        c = F.col("case_id")
        return dealt(self.scored.select("case_id"), self.scored.count(), "case_id").distinct().select(c.alias("id"), (c % 4 == 3).alias("must_abstain"), F.concat(F.lit("topic"), (c % 7).cast("string")).alias("topic"), (c % 40).alias("expected_id"), (50 + c % 977).alias("latency_ms"))

    @cached_property
    def answers(self) -> DataFrame:
        e, t = F.col("event_id"), F.col("event_type")
        s = lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
        text = F.when(t == "view", s("It holds [S", e % 50, "].")).when(t == "click", s("See [S", e % 50, ", S", e % 13, "] and [2]."))
        text = text.when(t == "signup", "As [State Government] says.").when(t == "error", s("Bare S", e, " and [S19(c)] stand.")).otherwise("By [S9999] it fails.")
        return self.table("events").select(e.alias("answer_id"), (F.col("user_id") % 7).alias("attempt_key"), text.alias("text"), F.array(e % 50, e % 13, F.lit(19).cast("long")).alias("allowed"))
