"""Evaluation, verification and corpus statistics."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import evaluation as E
from ..operators import verify as V
from ..operators.ranking import numbered_in_cells
from ..sources.views import Views
from .registry import query

_RANKS = """WITH c AS (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY score DESC, section_id, line) AS r FROM scored),
f AS (SELECT case_id, section_id, min(r) AS r FROM c GROUP BY 1, 2), sr AS (SELECT case_id, section_id, CAST(row_number() OVER (PARTITION BY case_id ORDER BY r) AS INT) AS rank FROM f),
o AS (SELECT cases.*, (SELECT max(score) FROM scored WHERE case_id = id) AS top_score, sr.rank AS first_correct FROM cases LEFT JOIN sr ON sr.case_id = id AND sr.section_id = expected_id)"""


@query(f"{_RANKS} SELECT * FROM sr", "cases")
def distinct_section_rank(v: Views) -> DataFrame:
    return E.section_ranks(v.scored)


def _outcomes(v: Views) -> DataFrame:
    return E.outcomes(v.cases, v.scored)


@query(f"{_RANKS} SELECT " + ", ".join(f"round(avg(CASE WHEN first_correct <= {k} THEN 1 ELSE 0 END), 9) AS recall_{k}" for k in E.KS) + " FROM o WHERE NOT must_abstain", "cases")
def recall_at_k(v: Views) -> DataFrame:
    return E.recall_at(_outcomes(v))


@query(f"{_RANKS} SELECT round(avg(coalesce(1.0 / first_correct, 0)), 9) AS mrr FROM o WHERE NOT must_abstain", "cases")
def mrr(v: Views) -> DataFrame:
    return E.mrr(_outcomes(v))


def _sweep_sql(*floors: str) -> str:
    rate = lambda on: f"round(avg(CASE WHEN {on} THEN CASE WHEN top_score < floor THEN 1 ELSE 0 END END), 9)"
    return f"{_RANKS} SELECT floor, {rate('must_abstain')} AS abstention_accuracy, {rate('NOT must_abstain')} AS false_abstention FROM o, (SELECT unnest([{', '.join(floors)}]::DOUBLE[]) AS floor) GROUP BY floor"


@query(_sweep_sql("0.6"), "cases")
def abstention_rates(v: Views) -> DataFrame:
    return E.abstention(_outcomes(v), [0.6])


@query(_sweep_sql("0.3", "0.5", "0.6", "0.7", "0.8"), "cases")
def floor_sweep(v: Views) -> DataFrame:
    return E.abstention(_outcomes(v), [0.3, 0.5, 0.6, 0.7, 0.8])


@query("WITH s AS (SELECT list(latency_ms ORDER BY latency_ms) AS l FROM cases) SELECT CAST(p AS INT) AS pct, CAST(l[CAST(round_even(p / 100.0 * (len(l) - 1), 0) AS BIGINT) + 1] AS BIGINT) AS value FROM s, (VALUES (50), (90), (95), (99)) t(p)", "cases")
def latency_percentiles(v: Views) -> DataFrame:
    return E.percentiles(v.cases, "latency_ms", [50, 90, 95, 99])


@query(f"{_RANKS} SELECT id, topic, CASE WHEN must_abstain THEN 'wrongly_answered' ELSE 'miss' END AS kind, top_score, first_correct FROM o WHERE (NOT must_abstain AND (top_score < 0.6 OR coalesce(first_correct, 99) > 6)) OR (must_abstain AND top_score >= 0.6)", "cases")
def eval_misses(v: Views) -> DataFrame:
    o = _outcomes(v)
    miss = ~F.col("must_abstain") & ((F.col("top_score") < 0.6) | (F.coalesce("first_correct", F.lit(99)) > 6))
    wrong = F.col("must_abstain") & (F.col("top_score") >= 0.6)
    return o.where(miss | wrong).select("id", "topic", F.when(F.col("must_abstain"), "wrongly_answered").otherwise("miss").alias("kind"), "top_score", "first_correct")


@query("""WITH n AS (SELECT *, row_number() OVER (PARTITION BY must_abstain, topic ORDER BY id) AS rn, count(*) OVER (PARTITION BY must_abstain, topic) AS n, count(*) OVER () AS total FROM cases)
SELECT id, must_abstain, topic FROM n WHERE rn <= greatest(1, round_even(n * 100 / total, 0)) ORDER BY id LIMIT 100""", "cases")
def stratified_sample(v: Views) -> DataFrame:
    return E.stratified_sample(v.cases, ["must_abstain", "topic"], 100)


@query("SELECT id FROM cases ORDER BY id LIMIT 25", "cases")
def first_n_cases(v: Views) -> DataFrame:
    return v.cases.select("id").orderBy("id").limit(25)


@query("SELECT id FROM cases WHERE id NOT IN (SELECT user_id FROM events)", "cases")
def outstanding_cases(v: Views) -> DataFrame:
    done = v.table("events").select(F.col("user_id").alias("id"))
    return v.cases.select("id").join(done, "id", "left_anti")


@query("""WITH g AS (SELECT o_orderkey, 'src' || (o_custkey % 25) AS slug, (o_orderkey % 600) || '-a' AS no FROM orders), k AS (SELECT DISTINCT a.slug, regexp_replace(lower(s.section_no), '[^0-9a-z]', '', 'g') AS key FROM sections s JOIN statutes a ON a.id = s.statute_id)
SELECT o_orderkey, g.slug, g.no FROM g LEFT JOIN k ON k.slug = g.slug AND k.key = regexp_replace(lower(g.no), '[^0-9a-z]', '', 'g') WHERE k.key IS NULL""", "sections")
def gold_label_errors(v: Views) -> DataFrame:
    g = v.table("orders").select("o_orderkey", F.concat(F.lit("src"), (F.col("o_custkey") % 25).cast("string")).alias("slug"), F.concat((F.col("o_orderkey") % 600).cast("string"), F.lit("-a")).alias("no")).withColumn("key", T.normalise_no(F.col("no")))
    k = v.sections.join(v.statutes.select(F.col("id").alias("statute_id"), "slug"), "statute_id").select("slug", T.normalise_no(F.col("section_no")).alias("key"))
    return g.join(k, ["slug", "key"], "left_anti").select("o_orderkey", "slug", "no")


# --- statistics -----------------------------------------------------------------------------------------------

_STATS = """SELECT (SELECT count(*) FROM statutes) AS acts, (SELECT count(*) FROM sections) AS sections, (SELECT count(*) FROM sections WHERE NOT is_omitted) AS in_force, (SELECT count(*) FROM embeddings) AS chunks,
  (SELECT count(embedding) FROM embeddings) AS embedded, (SELECT count(*) FROM links) AS links, (SELECT max(len([x FOR x IN string_split_regex(text, '\\s+') IF x <> ''])) FROM documents) AS max_tokens, (SELECT max(ts) FROM events) AS last_finished_at"""


def _stats(v: Views) -> DataFrame:
    parts = [
        v.statutes.agg(F.count("*").alias("acts")), v.sections.agg(F.count("*").alias("sections"), F.count_if(~F.col("is_omitted")).alias("in_force")),
        v.table("embeddings").agg(F.count("*").alias("chunks"), F.count("embedding").alias("embedded")), v.links.agg(F.count("*").alias("links")), v.table("documents").agg(F.max(T.word_count(F.col("text"))).cast("long").alias("max_tokens")), v.table("events").agg(F.max("ts").alias("last_finished_at")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)  # rows of one
    return out


@query(_STATS, "sections", "links")
def corpus_stats(v: Views) -> DataFrame:
    return _stats(v)


@query(f"SELECT chunks > 0 AND embedded = chunks AS retrieval_ready FROM ({_STATS})", "sections", "links")
def retrieval_ready(v: Views) -> DataFrame:
    return _stats(v).select(((F.col("chunks") > 0) & (F.col("embedded") == F.col("chunks"))).alias("retrieval_ready"))


@query("SELECT statute_id, count(*) AS total, count(*) FILTER (WHERE NOT is_omitted) AS in_force FROM sections GROUP BY 1", "sections")
def section_counts(v: Views) -> DataFrame:
    return v.sections.groupBy("statute_id").agg(F.count("*").alias("total"), F.count_if(~F.col("is_omitted")).alias("in_force"))


@query("SELECT a.id, a.slug, count(s.id) FILTER (WHERE NOT is_omitted) AS section_count FROM statutes a LEFT JOIN sections s ON s.statute_id = a.id GROUP BY 1, 2", "sections")
def act_section_count(v: Views) -> DataFrame:
    n = v.sections.groupBy("statute_id").agg(F.count_if(~F.col("is_omitted")).alias("n"))
    a = v.statutes
    return a.join(n, a.id == n.statute_id, "left").select("id", "slug", F.coalesce("n", F.lit(0)).alias("section_count"))


@query("SELECT id, statute_id, CAST(row_number() OVER (PARTITION BY statute_id ORDER BY id) - 1 AS INT) AS order_idx FROM sections", "sections")
def assign_order_idx(v: Views) -> DataFrame:
    rows = numbered_in_cells(v.sections.select("id", "statute_id"), ["statute_id"], F.floor(F.col("id") / 4096), ["id"])
    return rows.select("id", "statute_id", (F.col("rn") - 1).alias("order_idx"))


@query("SELECT statute_id, id, CAST(row_number() OVER (PARTITION BY statute_id ORDER BY CAST(regexp_extract(section_no, '^[0-9]+') AS INT), section_no LIKE '%A', id) AS INT) AS place FROM sections", "sections")
def citation_order(v: Views) -> DataFrame:
    s = v.sections.select("statute_id", "id", T.section_no_sort(F.col("section_no")).alias("sort"), V.numeric_prefix(F.col("section_no")).alias("n"))
    return numbered_in_cells(s, ["statute_id"], F.floor(F.col("n") / 512), ["sort", "id"], "place").select("statute_id", "id", "place")


# --- verification ---------------------------------------------------------------------------------------------

#: Sections with faulty ones beside them, the same SQL in both engines: unsortable, repeated and far numbers, blank texts and notes.
_FAULTY = ("statute_id", "CASE id % 3 WHEN 0 THEN '—' WHEN 1 THEN section_no ELSE '123456' END AS section_no", "order_idx + 1000000000 AS order_idx", "CASE WHEN id % 2 = 0 THEN marginal_note ELSE '' END AS marginal_note", "CASE WHEN id % 4 = 1 THEN '  ' ELSE text_verbatim END AS text_verbatim", "is_omitted")
_PLAIN = ("statute_id", "section_no", "order_idx", "marginal_note", "text_verbatim", "is_omitted")
_ALL = f"SELECT {', '.join(_PLAIN)} FROM sections UNION ALL SELECT {', '.join(_FAULTY)} FROM sections WHERE id % 29 = 5"


def _all(v: Views) -> DataFrame:
    return v.sections.select(*_PLAIN).unionByName(v.sections.where("id % 29 = 5").selectExpr(*_FAULTY))


_GAPS = f"SELECT statute_id, prev AS after, n AS before, CAST(n - prev - 1 AS INT) AS gap, CASE WHEN n - prev - 1 > 200 THEN 'error' ELSE 'warn' END AS level FROM (SELECT *, lag(n) OVER (PARTITION BY statute_id ORDER BY n) AS prev FROM (SELECT DISTINCT statute_id, CAST(regexp_extract(section_no, '^[0-9]+') AS INT) AS n FROM ({_ALL}) WHERE regexp_matches(section_no, '^[0-9]'))) WHERE n - prev > 1"


@query(_GAPS, "sections")
def section_gaps(v: Views) -> DataFrame:
    return V.gaps(_all(v))


@query("SELECT l_partkey % 100 AS statute_id, l_orderkey % 300 AS no, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1")
def duplicate_numbers(v: Views) -> DataFrame:
    s = v.table("lineitem").select((F.col("l_partkey") % 100).alias("statute_id"), (F.col("l_orderkey") % 300).alias("no"))
    return V.duplicate_numbers(s, ["statute_id", "no"])


@query("SELECT statute_id, count(*) FILTER (WHERE id % 40 > 19 AND marginal_note <> '') AS with_note, count(*) AS total FROM sections GROUP BY 1 HAVING with_note > 0 AND with_note < total", "sections")
def note_coverage(v: Views) -> DataFrame:
    return V.note_coverage(v.sections.withColumn("note", F.when(F.col("id") % 40 > 19, F.col("marginal_note")).otherwise("")), "note")


_DRIFT = "WITH c AS (SELECT statute_id, count(*) AS n FROM sections GROUP BY 1) SELECT statute_id, n, n - 7 + statute_id AS expected, CASE WHEN statute_id = 7 THEN 'ok' WHEN abs(7 - statute_id) <= greatest(5, (n - 7 + statute_id) // 20) THEN 'warn' ELSE 'error' END AS level FROM c"


def _drift(v: Views) -> DataFrame:
    n = v.sections.groupBy("statute_id").agg(F.count("*").alias("n"))
    return V.count_drift(n, n.select("statute_id", (F.col("n") - 7 + F.col("statute_id")).alias("expected")), "statute_id")


@query(_DRIFT, "sections")
def count_drift(v: Views) -> DataFrame:
    return _drift(v)


_EXPECTED = "SELECT statute_id, count(*) FILTER (WHERE NOT is_omitted) - 7 + statute_id AS expected FROM sections GROUP BY statute_id"
_FINDINGS = f"""WITH s AS ({_ALL}), live AS (SELECT *, length(text_verbatim) AS n FROM s WHERE NOT is_omitted), notes AS (SELECT *, row_number() OVER (PARTITION BY statute_id ORDER BY order_idx, section_no) AS r FROM s WHERE coalesce(marginal_note, '') = ''),
c AS (SELECT statute_id, count(*) FILTER (WHERE NOT is_omitted) AS n, count(*) FILTER (WHERE marginal_note <> '') AS noted, count(*) AS total FROM s GROUP BY 1), d AS (SELECT statute_id, n, expected, abs(n - expected) AS off FROM c JOIN ({_EXPECTED}) USING (statute_id)),
f AS (SELECT statute_id, 'error' AS level, 'unsortable_section_no' AS kind, section_no AS detail FROM s WHERE NOT regexp_matches(section_no, '[0-9A-Za-z]')
UNION ALL SELECT statute_id, 'error', 'duplicate_section_no', section_no FROM s GROUP BY statute_id, section_no HAVING count(*) > 1
UNION ALL SELECT statute_id, 'warn', 'no_section_1', 'lowest section number is ' || min(CAST(regexp_extract(section_no, '^[0-9]+') AS INT)) FROM s WHERE regexp_matches(section_no, '^[0-9]') GROUP BY statute_id HAVING min(CAST(regexp_extract(section_no, '^[0-9]+') AS INT)) <> 1
UNION ALL SELECT statute_id, level, CASE WHEN level = 'error' THEN 'implausible_gap' ELSE 'section_gap' END, 'nothing between ' || after || ' and ' || before || ' (' || gap || ' numbers)' FROM ({_GAPS})
UNION ALL SELECT statute_id, 'warn', CASE WHEN n < 40 THEN 'short_section' ELSE 'long_section' END, 's.' || section_no || ' is ' || n || ' chars' FROM live WHERE n < 40 OR n > 12000
UNION ALL SELECT statute_id, 'error', 'empty_section', 's.' || section_no || ' has no text' FROM live WHERE trim(text_verbatim) = ''
UNION ALL SELECT statute_id, 'warn', 'missing_marginal_note', (total - noted) || ' of ' || total || ' sections: ' || (SELECT string_agg(section_no, ', ' ORDER BY r) FROM notes WHERE notes.statute_id = c.statute_id AND r <= 10) FROM c WHERE noted > 0 AND noted < total
UNION ALL SELECT statute_id, CASE WHEN off <= greatest(5, expected // 20) THEN 'warn' ELSE 'error' END, 'section_count_drift', 'parsed ' || n || ' in-force sections, oracle expects ' || expected FROM d WHERE off <> 0
UNION ALL SELECT id, 'error', 'empty', 'no sections parsed' FROM statutes WHERE id NOT IN (SELECT statute_id FROM s))"""


def _findings(v: Views) -> DataFrame:
    expected = v.sections.groupBy("statute_id").agg((F.count_if(~F.col("is_omitted")) - 7 + F.col("statute_id")).alias("expected"))
    return V.findings(v.statutes, _all(v), expected)


@query(f"{_FINDINGS} SELECT statute_id, level, kind, detail FROM f", "sections")
def verify_report(v: Views) -> DataFrame:
    return _findings(v)


@query(f"{_FINDINGS} SELECT a.id AS statute_id, count(f.kind) AS findings, count(*) FILTER (WHERE f.level = 'error') AS errors, count(*) FILTER (WHERE f.level = 'error') = 0 AS ok FROM statutes a LEFT JOIN f ON f.statute_id = a.id GROUP BY 1", "sections")
def verify_summary(v: Views) -> DataFrame:
    g = v.statutes.select(F.col("id").alias("statute_id")).join(_findings(v), "statute_id", "left").groupBy("statute_id").agg(F.count("kind").alias("findings"), F.count_if(F.col("level") == "error").alias("errors"))
    return g.withColumn("ok", F.col("errors") == 0)


#: Tables of the schema made of the given ones, each with rows that break its rules; the same SQL in both engines.
_SCHEMA = {
    "statutes": ("customer", "CONCAT('c', c_custkey % 1400) AS slug, CAST(1795 + c_custkey % 410 AS INT) AS year, CASE WHEN c_custkey % 90 = 0 THEN 'short' ELSE repeat('a', 64) END AS source_sha256, CASE c_custkey % 50 WHEN 0 THEN 'county' WHEN 1 THEN 'state' ELSE 'central' END AS level"),
    "sections": ("orders", "o_custkey AS statute_id, o_orderkey % 500 AS section_no, o_orderkey AS order_idx"),
    "chunks": ("lineitem", "l_partkey AS section_id, l_suppkey AS chunk_idx, CAST(l_quantity AS INT) - 1 AS token_count"),
    "links": ("lineitem", "l_orderkey % 300 AS from_section_id, l_partkey % 300 AS to_section_id, CASE l_linenumber % 5 WHEN 0 THEN 'cites' WHEN 1 THEN 'see_also' WHEN 2 THEN 'amended_by' ELSE 'refers_to' END AS relation"),
    "runs": ("events", "event_id AS id, CASE event_type WHEN 'view' THEN 'running' WHEN 'click' THEN 'succeeded' WHEN 'error' THEN 'failed' WHEN 'signup' THEN 'done' ELSE 'partial' END AS status"),
    "logs": ("events", "event_id AS id, event_type = 'click' AS answered, user_id % 10 = 0 AS abstained"),
}
_UNIQUE = (("unique_slug", "statutes", "slug"), ("unique_section_no", "sections", "statute_id, section_no"), ("unique_order_idx", "sections", "statute_id, order_idx"), ("unique_chunk_idx", "chunks", "section_id, chunk_idx"), ("unique_edge", "links", "from_section_id, to_section_id, relation"))
_BROKEN = (
    ("year_range", "statutes", "slug", "year NOT BETWEEN 1800 AND 2200"), ("sha256_length", "statutes", "slug", "length(source_sha256) <> 64"), ("level", "statutes", "slug", "level NOT IN ('central', 'state')"), ("token_count", "chunks", "section_id, chunk_idx", "token_count <= 0"),
    ("relation", "links", "from_section_id, to_section_id, relation", "relation NOT IN ('refers_to', 'amended_by', 'see_also')"), ("self_loop", "links", "from_section_id, to_section_id, relation", "from_section_id = to_section_id"),
    ("status", "runs", "id", "status NOT IN ('running', 'succeeded', 'partial', 'failed')"), ("answered_and_abstained", "logs", "id", "answered AND abstained"),
)
_VIOLATIONS = "WITH " + ", ".join(f"x_{name} AS (SELECT {cols} FROM {source})" for name, (source, cols) in _SCHEMA.items()) + " " + " UNION ALL ".join(
    [f"SELECT '{rule}' AS rule, concat_ws('/', {key}) AS key FROM x_{t} WHERE {on}" for rule, t, key, on in _BROKEN] + [f"SELECT '{rule}', concat_ws('/', {key}) FROM x_{t} GROUP BY {key} HAVING count(*) > 1" for rule, t, key in _UNIQUE]
)


@query(_VIOLATIONS)
def constraint_violations(v: Views) -> DataFrame:
    return V.violations(**{name: v.spark.sql(f"SELECT {cols} FROM {{source}}", source=v.table(source)) for name, (source, cols) in _SCHEMA.items()})


@query(f"""{_RANKS}, m AS (SELECT id, topic, CASE WHEN must_abstain THEN 'wrongly_answered' ELSE 'miss' END AS kind, top_score, first_correct FROM o WHERE (NOT must_abstain AND (top_score < 0.6 OR coalesce(first_correct, 99) > 6)) OR (must_abstain AND top_score >= 0.6))
SELECT 'totals' AS kind, NULL AS id, NULL AS topic, NULL AS top_score, NULL AS first_correct, {", ".join(f"round(avg(CASE WHEN first_correct <= {k} THEN 1 ELSE 0 END), 4) AS recall_{k}" for k in E.KS)}, round(avg(coalesce(1.0 / first_correct, 0)), 4) AS mrr FROM o WHERE NOT must_abstain
UNION ALL SELECT kind, id, topic, round(top_score, 4), first_correct, {", ".join("NULL" for _ in E.KS)}, NULL FROM m""", "cases")
def report_json(v: Views) -> DataFrame:
    """The report as JSON lines (the totals, and each case that went wrong; four decimals), read back."""
    lines = E.report_lines(_outcomes(v), eval_misses(v))
    fields = "kind string, id long, topic string, top_score double, first_correct int, " + ", ".join(f"recall_{k} double" for k in E.KS) + ", mrr double"
    return lines.select(F.from_json("line", fields).alias("r")).select("r.*")
