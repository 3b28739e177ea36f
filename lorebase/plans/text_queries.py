"""Scalar functions over whole tables."""

from __future__ import annotations

import html.entities
import json

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import prompts as P
from ..functions import text as T
from ..operators import parsing
from ..sources.views import Views
from .registry import query

_SORT = """array_to_string([CASE WHEN regexp_matches(x, '^[0-9]') THEN lpad(regexp_replace(x, '^0+([0-9])', '\\1'), 6, '0') || '|' ELSE rpad(upper(x), 4, ' ') || '|' END FOR x IN regexp_extract_all(section_no, '([0-9]+|[A-Za-z]+)')], '')"""


@query(f"SELECT id, {_SORT} AS sort_key FROM sections", "sections")
def section_no_sort(v: Views) -> DataFrame:
    return v.sections.select("id", T.section_no_sort(F.col("section_no")).alias("sort_key"))


@query("SELECT id, regexp_replace(lower(section_no), '[^0-9a-z]', '', 'g') AS no FROM sections", "sections")
def normalise_no(v: Views) -> DataFrame:
    return v.sections.select("id", T.normalise_no(F.col("section_no")).alias("no"))


_TITLE = "trim(regexp_replace(regexp_replace(regexp_replace(lower(c_name || ' of the ' || c_mktsegment || ' Act'), '[^a-z0-9]+', ' ', 'g'), '\\bthe\\b', ' ', 'g'), ' +', ' ', 'g'))"


@query(f"SELECT c_custkey, {_TITLE} AS title FROM customer")
def normalise_title(v: Views) -> DataFrame:
    c = v.table("customer")
    return c.select("c_custkey", T.normalise_title(F.concat("c_name", F.lit(" of the "), "c_mktsegment", F.lit(" Act"))).alias("title"))


@query("""WITH r AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, CASE o_orderkey % 4 WHEN 0 THEN strftime(o_orderdate, '%Y-%m-%d') WHEN 1 THEN strftime(o_orderdate, '%d-%m-%Y') WHEN 2 THEN strftime(o_orderdate, '%d/%m/%Y') ELSE strftime(o_orderdate, '%Y.%m.%d') END AS raw FROM orders)
SELECT o_orderkey, raw, CASE WHEN o_orderkey % 4 < 3 THEN d END AS parsed FROM r""")
def multi_format_date(v: Views) -> DataFrame:
    k, d = F.col("o_orderkey") % 4, F.col("o_orderdate")
    raw = F.when(k == 0, F.date_format(d, "yyyy-MM-dd")).when(k == 1, F.date_format(d, "dd-MM-yyyy")).when(k == 2, F.date_format(d, "dd/MM/yyyy")).otherwise(F.date_format(d, "yyyy.MM.dd"))
    return v.table("orders").select("o_orderkey", raw.alias("raw")).withColumn("parsed", T.parse_date(F.col("raw")))


def _text_literal(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


#: Named references, those whose semicolon may be missing, and what numbers 128 to 159 mean: `T.decode_references`, as SQL.
_NAMES = ", ".join(f"({_text_literal(k)}, {_text_literal(c)})" for k, c in sorted(json.loads(T._reference_names()).items()))
_OLD = "|".join(sorted((k for k in html.entities.html5 if not k.endswith(";")), key=lambda k: (-len(k), k)))


def _decoded_sql(source: str, out: str) -> str:
    """Clauses that decode the references in `t` of table `source` (k, field, t) once, to table `out`. Each distinct reference is worked out once."""
    return f"""{out}_r AS (SELECT DISTINCT unnest(regexp_extract_all(t, '{T._REFERENCE}')) AS x FROM {source}),
{out}_n AS (SELECT x, CASE WHEN regexp_matches(x, '^&#[xX]') THEN CAST('0x' || regexp_extract(x, '[0-9a-fA-F]+', 0) AS HUGEINT) WHEN x LIKE '&#%' THEN CAST(regexp_extract(x, '[0-9]+', 0) AS HUGEINT) END AS n, regexp_extract(x, '^&({_OLD})', 1) AS old FROM {out}_r),
{out}_d AS (SELECT x, CASE WHEN n BETWEEN 128 AND 159 AND c.value IS NOT NULL THEN c.value WHEN n > 0 AND n < 1114112 AND n NOT BETWEEN 55296 AND 57343 THEN chr(CAST(n AS INT)) WHEN n IS NOT NULL THEN chr(65533)
  ELSE coalesce(w.value, o.value || substr(x, length(old) + 2), x) END AS value FROM {out}_n LEFT JOIN names w ON w.name = x LEFT JOIN names o ON o.name = '&' || old || ';' LEFT JOIN names c ON c.name = '&#' || n || ';'),
{out}_m AS (SELECT map(coalesce(list(x), []), coalesce(list(value), [])) AS m FROM {out}_d),
{out} AS (SELECT k, field, array_to_string([z[1] || coalesce(map_extract(m, z[2])[1], '') FOR z IN list_zip(string_split_regex(t, '{T._REFERENCE}'), regexp_extract_all(t, '{T._REFERENCE}'))], '') AS t FROM {source}, {out}_m)"""


def _html_sql(source: str, out: str) -> str:
    """Clauses that turn the markup `t` of table `source` (k, field, t) into text, in table `out`. White space is what Java's patterns take for it."""
    s = "[\\s\\x0B]"
    x = f"regexp_replace(regexp_replace(t, '(?s)<!--.*?-->', '', 'g'), '<[sS][uU][pP]({s}[^>]*|/)?>', '[', 'g')"
    x = f"regexp_replace(regexp_replace({x}, '</[sS][uU][pP]>', ']', 'g'), '(?i)</?(p|div|br|tr|li)({s}[^>]*|/)?>', chr(10), 'g')"
    x = f"regexp_replace({x}, '</?[A-Za-z][^>]*>|<[!?][^>]*>', '', 'g')"
    y = "regexp_replace(replace(t, chr(160), ' '), '[ \\t]+', ' ', 'g')"
    y = f"regexp_replace(regexp_replace({y}, ' ?\\n ?', chr(10), 'g'), '\\n{{3,}}', chr(10) || chr(10), 'g')"
    y = f"regexp_replace(replace({y}, '[]', ''), '^{s}+|{s}+$', '', 'g')"
    return f"""names AS (SELECT * FROM (VALUES {_NAMES}) v(name, value)), {out}_0 AS (SELECT k, field, {x} AS t FROM {source}),
{_decoded_sql(f"{out}_0", f"{out}_1")},
{_decoded_sql(f"{out}_1", f"{out}_2")},
{out} AS (SELECT k, field, {y} AS t FROM {out}_2)"""


@query(f"WITH src AS (SELECT page_id AS k, 'html' AS field, html AS t FROM pages), {_html_sql('src', 'plain')} SELECT k AS page_id, t AS text FROM plain")
def html_to_text(v: Views) -> DataFrame:
    return v.table("pages").select("page_id", T.html_to_text(F.col("html")).alias("text"))


#: Raw notes, the same SQL in both engines.
_NOTES = """CASE (l_orderkey + l_linenumber) % 8 WHEN 0 THEN '[1]. Subs. by Act ' || l_orderkey || chr(10) || '2. plain' || chr(10) || '[3] . Ins. later' WHEN 1 THEN 'lead text' || chr(10) || ' 3.  plain words' || chr(10) || '[4]. ' WHEN 2 THEN 'One note without a mark'
WHEN 3 THEN '  ' WHEN 4 THEN '1. Substituted by Act 3 of 1951' || chr(10) || '100. of these, w.e.f. 1-1-1990' WHEN 5 THEN '1. Fee added up' || chr(10) || '12. vide notification ' || l_orderkey WHEN 6 THEN 'Act 7 of ' || (1900 + l_linenumber) || ' applies' ELSE '[2]. repeal it' || chr(10) || 'rep. here' END"""
_PARSED = f"""WITH r AS (SELECT l_orderkey, l_linenumber, {_NOTES} AS raw FROM lineitem), m AS (SELECT *, regexp_replace(raw, '{T.FOOTNOTE_START}', chr(1) || '\\1' || chr(2), 'g') AS marked FROM r),
n AS (SELECT *, CASE WHEN contains(marked, chr(1)) THEN [{{'marker': split_part(x, chr(2), 1), 'text': regexp_replace(split_part(x, chr(2), 2), '^\\s+|\\s+$', '', 'g')}} FOR x IN string_split(marked, chr(1))[2:]] ELSE [{{'marker': '', 'text': regexp_replace(raw, '^\\s+|\\s+$', '', 'g')}}] END AS every FROM m),
p AS (SELECT l_orderkey, l_linenumber, [x FOR x IN every IF x.text <> ''] AS notes FROM n)"""


def _notes(v: Views) -> DataFrame:
    return v.table("lineitem").select("l_orderkey", "l_linenumber", F.expr(_NOTES).alias("raw")).withColumn("notes", T.footnotes(F.col("raw")))


@query(f"{_PARSED} SELECT l_orderkey, l_linenumber, array_to_string([x.marker || '=' || x.text FOR x IN notes], ';') AS notes FROM p")
def parse_footnotes(v: Views) -> DataFrame:
    return _notes(v).select("l_orderkey", "l_linenumber", F.array_join(F.transform("notes", lambda n: F.concat_ws("=", n["marker"], n["text"])), ";").alias("notes"))


@query(f"{_PARSED} SELECT l_orderkey, l_linenumber, nullif(array_to_string([x.text FOR x IN notes IF regexp_matches(x.text, '{T.AMENDMENT_HINT}')], chr(10)), '') AS note FROM p")
def amendment_note(v: Views) -> DataFrame:
    return _notes(v).select("l_orderkey", "l_linenumber", T.amendment_note(F.col("notes")).alias("note"))


#: Raw notes and bodies of sections, the same SQL in both engines.
_OMITTED = ("CASE o_orderkey % 6 WHEN 0 THEN '[Repealed.].' WHEN 1 THEN ' Omitted' WHEN 2 THEN 'Repealed in part' ELSE 'Short title' END", "CASE o_orderkey % 11 WHEN 3 THEN '[2] [The whole ' || repeat('long ', 20) || 'title.] Rep. by the Act' WHEN 4 THEN '[1][2] [x] omitted' WHEN 5 THEN 'The Indian Act, 1882, is hereby repealed.' WHEN 6 THEN '[x] repealedly' ELSE 'This Act extends to all' END")


@query(f"""WITH r AS (SELECT o_orderkey, {_OMITTED[0]} AS note, {_OMITTED[1]} AS body FROM orders)
SELECT o_orderkey, lower(trim(regexp_replace(trim(note), '^[\\[\\].]+|[\\[\\].]+$', '', 'g'))) IN ('repealed', 'omitted') OR regexp_matches(regexp_replace(body, '{T.LEADING_MARKERS}', ''), '{T.OMITTED_BODY}') AS omitted FROM r""")
def detect_omitted(v: Views) -> DataFrame:
    r = v.table("orders").select("o_orderkey", F.expr(_OMITTED[0]).alias("note"), F.expr(_OMITTED[1]).alias("body"))
    return r.select("o_orderkey", T.looks_omitted(F.col("note"), F.col("body")).alias("omitted"))


#: A section's text, the same SQL in both engines.
_BODY = "'Head of ' || l_orderkey || ':' || chr(10) || '(1) first rule; (2) inline' || chr(10) || ' ( 2a ) second rule. Provided that x holds.' || chr(10) || 'Exceptional cases' || chr(10) || chr(10) || '(123) no number' || chr(10) || 'Explanation. - y' || chr(10) || 'Illustrations' || chr(10) || 'z'"


def _bodies(v: Views) -> DataFrame:
    return v.table("lineitem").where("l_linenumber = 1").select("l_orderkey", "l_partkey", F.expr(_BODY).alias("body"))


@query(f"""WITH b AS (SELECT l_orderkey, l_partkey, {_BODY} AS body FROM lineitem WHERE l_linenumber = 1),
m AS (SELECT *, regexp_replace(regexp_replace(body, '{T.SEGMENT_START}', chr(1) || '\\1\\2', 'g'), '\\b(Provided)\\b', chr(1) || '\\1', 'g') AS marked FROM b),
q AS (SELECT l_orderkey, l_partkey, [y FOR y IN [regexp_replace(x, '^\\s+|\\s+$', '', 'g') FOR x IN string_split(marked, chr(1))] IF y <> ''] AS pieces FROM m),
p AS (SELECT l_orderkey, l_partkey, unnest(pieces) AS piece, generate_subscripts(pieces, 1) - 1 AS pos FROM q)
SELECT l_orderkey, l_partkey, pos, piece,
  CASE WHEN regexp_matches(piece, '{T.SEGMENT_NUMBER}') THEN '(' || regexp_extract(piece, '{T.SEGMENT_NUMBER}', 1) || ')' WHEN starts_with(piece, 'Explanation') THEN 'Explanation' WHEN starts_with(piece, 'Illustrations') THEN 'Illustrations'
       WHEN starts_with(piece, 'Illustration') THEN 'Illustration' WHEN starts_with(piece, 'Exception') THEN 'Exception' WHEN starts_with(piece, 'Provided') THEN 'Provided' ELSE 'body' END AS label FROM p""")
def segment_sections(v: Views) -> DataFrame:
    p = _bodies(v).select("l_orderkey", "l_partkey", F.posexplode(T.segments(F.col("body"))).alias("pos", "piece"))
    return p.select("l_orderkey", "l_partkey", F.col("pos").cast("long").alias("pos"), "piece", T.segment_label(F.col("piece")).alias("label"))


_PREFIX = "'passage: ' || short_title || CASE WHEN regexp_replace(marginal_note, '\\.+$', '') <> '' THEN ' — ' || regexp_replace(marginal_note, '\\.+$', '') ELSE '' END || '. '"


@query(f"SELECT s.id, {_PREFIX} AS heading FROM sections s JOIN statutes a ON a.id = s.statute_id", "sections")
def heading_prefix(v: Views) -> DataFrame:
    a = v.statutes.select(F.col("id").alias("statute_id"), "short_title")
    return v.sections.join(a, "statute_id").select("id", T.heading_prefix(F.col("short_title"), F.col("marginal_note")).alias("heading"))


@query(f"SELECT s.id, regexp_replace({_PREFIX}, '^passage: ', '') || text_verbatim AS passage FROM sections s JOIN statutes a ON a.id = s.statute_id", "sections")
def rerank_passage(v: Views) -> DataFrame:
    a = v.statutes.select(F.col("id").alias("statute_id"), "short_title")
    return v.sections.join(a, "statute_id").select("id", T.rerank_passage(T.heading_prefix(F.col("short_title"), F.col("marginal_note")), F.col("text_verbatim")).alias("passage"))


@query("""WITH t AS (SELECT doc_id, trim(regexp_replace(text, '\\s+', ' ', 'g')) AS t FROM documents)
SELECT doc_id, CASE WHEN length(t) <= 320 THEN t ELSE regexp_replace(left(t, 320), ' [^ ]*$', '') || '…' END AS snippet FROM t""")
def snippets(v: Views) -> DataFrame:
    return v.table("documents").select("doc_id", T.snippet(F.col("text")).alias("snippet"))


_BLOCK = "'[S' || s.id || '] ' || short_title || ', s. ' || section_no || chr(10) || text_verbatim"


def _rendered(v: Views) -> DataFrame:
    a = v.statutes.select(F.col("id").alias("statute_id"), "short_title")
    return v.sections.join(a, "statute_id").withColumn("block", F.concat(F.lit("[S"), F.col("id").cast("string"), F.lit("] "), "short_title", F.lit(", s. "), "section_no", F.lit("\n"), "text_verbatim"))


@query(f"SELECT s.id, CAST(greatest(1, length({_BLOCK}) // 4) AS BIGINT) AS tokens FROM sections s JOIN statutes a ON a.id = s.statute_id", "sections")
def estimate_tokens(v: Views) -> DataFrame:
    return _rendered(v).select("id", T.estimate_tokens(F.col("block")).alias("tokens"))


@query(f"""SELECT CAST(floor(s.id / 4) AS BIGINT) AS answer_id, string_agg({_BLOCK}, chr(10) || chr(10) ORDER BY s.id) AS context FROM sections s JOIN statutes a ON a.id = s.statute_id GROUP BY 1""", "sections")
def render_context(v: Views) -> DataFrame:
    g = _rendered(v).groupBy(F.floor(F.col("id") / 4).alias("answer_id")).agg(F.array_sort(F.collect_list(F.struct("id", "block"))).alias("b"))
    return g.select("answer_id", F.array_join(F.transform("b", lambda x: x["block"]), "\n\n").alias("context"))


@query("""WITH r AS (SELECT conv_id, turn, role, text FROM conversations WHERE role <> 'system')
SELECT conv_id, string_agg(role || ': ' || text, chr(10) ORDER BY turn, role, text) || chr(10) || 'Follow-up question: and then?' AS prompt FROM r GROUP BY conv_id""")
def render_turns(v: Views) -> DataFrame:
    t = v.table("conversations").where("role <> 'system'").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("t"))
    return t.select("conv_id", F.concat(F.array_join(F.transform("t", lambda x: F.concat(x["role"], F.lit(": "), x["text"])), "\n"), F.lit("\nFollow-up question: and then?")).alias("prompt"))


@query("""WITH r AS (SELECT event_id, 'q' || event_id AS original, CASE event_type WHEN 'view' THEN '"better ' || event_id || '"' WHEN 'click' THEN '' WHEN 'signup' THEN repeat('x', 401) WHEN 'error' THEN NULL ELSE ' plain ' END AS candidate, user_id % 3 AS n_turns FROM events),
s AS (SELECT *, trim(regexp_replace(trim(candidate), '^"+|"+$', '', 'g')) AS c FROM r)
SELECT event_id, CASE WHEN n_turns = 0 THEN 'no_turns' WHEN candidate IS NULL THEN 'failed' WHEN c = '' THEN 'empty' WHEN length(c) > 400 THEN 'too_long' ELSE 'rewritten' END AS reason,
  CASE WHEN n_turns > 0 AND c <> '' AND length(c) <= 400 THEN c ELSE original END AS question FROM s""")
def rewrite_decision(v: Views) -> DataFrame:
    t, e = F.col("event_type"), F.col("event_id").cast("string")
    candidate = F.when(t == "view", F.concat(F.lit('"better '), e, F.lit('"'))).when(t == "click", "").when(t == "signup", F.repeat(F.lit("x"), 401)).when(t == "error", None).otherwise(" plain ")
    r = v.table("events").select("event_id", F.concat(F.lit("q"), e).alias("original"), candidate.alias("candidate"), (F.col("user_id") % 3).alias("n_turns"))
    c = F.trim(F.regexp_replace(F.trim(F.col("candidate")), '^"+|"+$', ""))
    reason = F.when(F.col("n_turns") == 0, "no_turns").when(F.col("candidate").isNull(), "failed").when(c == "", "empty").when(F.length(c) > 400, "too_long").otherwise("rewritten")
    return r.select("event_id", reason.alias("reason"), F.when(reason == "rewritten", c).otherwise(F.col("original")).alias("question"))


@query("""SELECT vec_id, round(list_sum([CAST(x AS DOUBLE) * CAST(x AS DOUBLE) FOR x IN embedding]), 4) AS before, CAST(1 AS DOUBLE) AS after FROM embeddings""")
def l2_normalise(v: Views) -> DataFrame:
    sq = lambda c: F.aggregate(c, F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double"))
    e = v.table("embeddings").select("vec_id", "embedding", T.l2_normalise(F.col("embedding")).alias("unit"))
    return e.select("vec_id", F.round(sq("embedding"), 4).alias("before"), F.round(sq("unit"), 6).alias("after"))


@query("""SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'missing_passage_prefix' ELSE 'missing_query_prefix' END AS violation FROM documents WHERE doc_id % 7 = 0 OR doc_id % 11 = 0""")
def prefix_violations(v: Views) -> DataFrame:
    k = F.col("doc_id")
    d = v.table("documents").select(k, F.concat(F.when(k % 7 == 0, "").otherwise("passage: "), "text").alias("passage"), F.concat(F.when(k % 11 == 0, "").otherwise("query: "), F.substring("text", 1, 20)).alias("question"))
    bad = F.when(~F.col("passage").startswith("passage: "), "missing_passage_prefix").when(~F.col("question").startswith("query: "), "missing_query_prefix")
    return d.select("doc_id", bad.alias("violation")).where("violation IS NOT NULL")


@query("""SELECT split_part(CASE user_id % 3 WHEN 0 THEN 'alpha/m1' WHEN 1 THEN 'beta/m2/x' ELSE 'gamma' END, '/', 1) AS provider, count(*) AS calls, CAST(sum(event_id % 100) AS BIGINT) AS tokens FROM events GROUP BY 1""")
def usage_by_provider(v: Views) -> DataFrame:
    k = F.col("user_id") % 3
    model = F.when(k == 0, "alpha/m1").when(k == 1, "beta/m2/x").otherwise("gamma")
    return v.table("events").groupBy(F.split(model, "/", 2)[0].alias("provider")).agg(F.count("*").alias("calls"), F.sum(F.col("event_id") % 100).alias("tokens"))


@query("""SELECT event_id, json_extract_string(props, '$.k') AS k, '***' AS api_key, CAST(event_type = 'click' AS INT) AS n_left FROM events""")
def log_redaction(v: Views) -> DataFrame:
    full = F.concat(F.substring_index("props", "}", 1), F.lit(', "api_key": "s3", "prompt": "p"'), F.when(F.col("event_type") == "click", ', "note": "n"').otherwise(""), F.lit("}"))
    m = T.redact(full, ["prompt", "messages", "question", "answer", "turns"], ["authorization", "password"])
    return v.table("events").select("event_id", m.alias("m")).select("event_id", F.col("m")["k"].alias("k"), F.col("m")["api_key"].alias("api_key"), (F.size("m") - 2).alias("n_left"))


@query("""SELECT event_id, CASE user_id % 4 WHEN 0 THEN '10.0.0.' || user_id WHEN 1 THEN 'peer' || user_id WHEN 2 THEN 'unknown' ELSE 'p' END AS client FROM events""")
def client_key(v: Views) -> DataFrame:
    u = F.col("user_id")
    forwarded = F.when(u % 4 == 0, F.concat(F.lit(" 10.0.0."), u.cast("string"), F.lit(" , 1.1.1.1"))).when(u % 4 == 1, "")
    peer = F.when(u % 4 == 1, F.concat(F.lit("peer"), u.cast("string"))).when(u % 4 == 3, "p")
    return v.table("events").select("event_id", T.client_key(forwarded, peer).alias("client"))


@query("""SELECT answer_id, list_sort(list_distinct(CASE WHEN regexp_matches(text, '\\[') THEN [CAST(x AS BIGINT) FOR x IN flatten([regexp_extract_all(y, '\\bS([0-9]{1,12})\\b', 1) FOR y IN regexp_extract_all(text, '\\[([^\\[\\]]*)\\]', 1)])] ELSE [] END)) AS cited FROM answers""", "answers")
def extract_citations(v: Views) -> DataFrame:
    return v.answers.select("answer_id", T.cited_ids(F.col("text")).alias("cited"))


_CITED = "list_distinct([CAST(x AS BIGINT) FOR x IN flatten([regexp_extract_all(y, '\\bS([0-9]{1,12})\\b', 1) FOR y IN regexp_extract_all(text, '\\[([^\\[\\]]*)\\]', 1)])])"


@query(f"""WITH c AS (SELECT answer_id, {_CITED} AS cited, allowed FROM answers), f AS (SELECT *, [x FOR x IN cited IF NOT list_contains(allowed, x)] AS invalid FROM c)
SELECT answer_id, CAST(len(invalid) AS INT) AS n_invalid, CASE WHEN len(invalid) > 0 THEN 'cited_sections_not_in_context' WHEN len(cited) = 0 THEN 'no_citations' END AS reason FROM f""", "answers")
def validate_citations(v: Views) -> DataFrame:
    c = v.answers.withColumn("cited", T.cited_ids(F.col("text")))
    bad = F.array_except("cited", "allowed")
    return c.select("answer_id", F.size(bad).alias("n_invalid"), F.when(F.size(bad) > 0, "cited_sections_not_in_context").when(F.size("cited") == 0, "no_citations").alias("reason"))


_FIRST = "'Question: ' || text || chr(10) || chr(10) || 'Context:' || chr(10) || '[S' || item_id || '] ' || left(text, 40)"


@query(f"""SELECT item_id, 'system' AS role, 0 AS pos, 'Answer only from the context and cite [S<id>].' AS content FROM benchmark
UNION ALL SELECT item_id, 'user', 1, {_FIRST} FROM benchmark
UNION ALL SELECT item_id, 'assistant', 2, 'It is [S9999].' FROM benchmark WHERE item_id % 2 = 0
UNION ALL SELECT item_id, 'user', 3, 'Invalid: S9999. Allowed: S' || item_id || ', S' || (item_id + 1) || '.' FROM benchmark WHERE item_id % 2 = 0""")
def build_prompts(v: Views) -> DataFrame:
    i = F.col("item_id")
    context = F.concat(F.lit("[S"), i.cast("string"), F.lit("] "), F.substring("text", 1, 40))
    again = P.retry_messages(F.col("text"), context, F.lit("It is [S9999]."), F.array(F.lit(9999)), F.array(i, i + 1))
    m = v.table("benchmark").select("item_id", F.posexplode(F.when(i % 2 == 0, again).otherwise(P.messages(F.col("text"), context))).alias("pos", "m"))
    return m.select("item_id", "m.role", "pos", "m.content")


@query("""WITH x AS (SELECT id, text_verbatim AS body, section_no, is_omitted FROM sections), r AS (
SELECT id, 'short_text' AS rule, 'warn' AS level FROM x WHERE NOT is_omitted AND trim(body) <> '' AND length(body) < 40
UNION ALL SELECT id, 'long_text', 'warn' FROM x WHERE NOT is_omitted AND length(body) > 12000
UNION ALL SELECT id, 'blank_text', 'error' FROM x WHERE NOT is_omitted AND trim(body) = ''
UNION ALL SELECT id, 'bad_number', 'error' FROM x WHERE NOT regexp_matches(section_no, '^[0-9]{1,6}'))
SELECT * FROM r""", "sections")
def plausibility(v: Views) -> DataFrame:
    n, live = F.length("text_verbatim"), ~F.col("is_omitted")
    rule = lambda on, name, level: F.when(on, F.struct(F.lit(name).alias("rule"), F.lit(level).alias("level")))
    blank = F.trim("text_verbatim") == ""
    rules = F.array_compact(F.array(rule(live & ~blank & (n < 40), "short_text", "warn"), rule(live & (n > 12000), "long_text", "warn"), rule(live & blank, "blank_text", "error"), rule(T.section_no_sort(F.col("section_no")).isNull(), "bad_number", "error")))
    return v.sections.select("id", F.explode(rules).alias("r")).select("id", "r.*")


@query(f"""WITH p AS (SELECT page_id, regexp_extract(html, '<title>([^<]*)</title>', 1) AS title, '[1] ' || CASE WHEN page_id % 6 = 0 THEN '[The whole] Rep. by Act' ELSE html END AS raw FROM pages),
src AS (SELECT page_id AS k, 'note' AS field, coalesce(title, '') AS t FROM p UNION ALL SELECT page_id, 'body', coalesce(raw, '') FROM p),
{_html_sql("src", "plain")},
q AS (SELECT page_id, raw, n.t AS note, b.t AS text, lower(trim(regexp_replace(trim(n.t), '^[\\[\\].]+|[\\[\\].]+$', '', 'g'))) IN ('repealed', 'omitted') OR regexp_matches(regexp_replace(b.t, '{T.LEADING_MARKERS}', ''), '{T.OMITTED_BODY}') AS gone
  FROM p JOIN plain n ON n.k = page_id AND n.field = 'note' JOIN plain b ON b.k = page_id AND b.field = 'body')
SELECT page_id % 7 AS act_id, CAST(page_id AS VARCHAR) AS section_no, nullif(note, '') AS note, text, md5(raw) AS raw_md5, page_id % 11 = 0 OR gone AS is_omitted,
CASE page_id % 3 WHEN 0 THEN '1=Subs. by Act ' || page_id || ';2=plain' WHEN 1 THEN '' ELSE '=One note' END AS footnotes, CASE page_id % 3 WHEN 0 THEN 'Subs. by Act ' || page_id END AS amendment_note,
CAST(row_number() OVER (PARTITION BY page_id % 7 ORDER BY page_id) - 1 AS INT) AS order_idx FROM q""")
def parse_sections(v: Views) -> DataFrame:
    """Pages as raw items, to whole sections."""
    k = F.col("page_id")
    raw = F.concat(F.lit("[1] "), F.when(k % 6 == 0, "[The whole] Rep. by Act").otherwise(F.col("html")))
    notes = F.when(k % 3 == 0, F.concat(F.lit("1. Subs. by Act "), k.cast("string"), F.lit("<br>2. plain"))).when(k % 3 == 1, "").otherwise("<p>One note</p>")
    items = v.table("pages").select((k % 7).alias("act_id"), k.alias("pos"), F.concat(F.lit(" "), k.cast("string"), F.lit(".")).alias("section_number"), F.regexp_extract("html", "<title>([^<]*)</title>", 1).alias("title"), raw.alias("body_html"), notes.alias("footnote_html"), (k % 11 == 0).alias("is_repealed"))
    p = parsing.parse_sections(items)
    told = F.array_join(F.transform("footnotes", lambda n: F.concat_ws("=", n["marker"], n["text"])), ";")
    return p.select("act_id", "section_no", F.col("marginal_note").alias("note"), F.col("text_verbatim").alias("text"), F.md5(F.col("text_raw").cast("binary")).alias("raw_md5"), "is_omitted", told.alias("footnotes"), "amendment_note", "order_idx")
