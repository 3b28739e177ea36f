"""Sources, stores, scopes, joins and checks of the knowledge base."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..operators import embedding, graph, jobs, store
from ..sources import archive, manifest
from ..sources.cluster import dealt, shared_path, spread
from ..sources.views import Views
from .registry import query


# --- sources and stores ---------------------------------------------------------------------------------------


@query("SELECT p_brand AS slug, count(*) AS n FROM (SELECT 'b' || (p_partkey % 700) AS p_brand FROM part) GROUP BY 1 HAVING count(*) > 1")
def manifest_dups(v: Views) -> DataFrame:
    return manifest.duplicates(v.table("part").select(F.concat(F.lit("b"), (F.col("p_partkey") % 700).cast("string")).alias("slug")))


@query("SELECT id, slug, CAST(1 + id % 3 AS INT) AS tier FROM statutes WHERE id % 3 = 1 OR slug = 'src7'", "statutes")
def manifest_select(v: Views) -> DataFrame:
    entries = v.statutes.select("id", "slug", (1 + F.col("id") % 3).cast("int").alias("tier"))
    return manifest.select_acts(entries, tier=2).unionByName(manifest.select_acts(entries, slug="src7")).distinct()


def _payload(v: Views) -> DataFrame:
    """Archived items made of customers: a metadata map of lists, as the archive holds it."""
    c, k = v.table("customer"), F.col("c_custkey")
    val = lambda x: F.array(F.struct(x.cast("string").alias("value")))
    m = F.create_map(
        F.lit("collection"), val(F.when(k % 5 == 0, "PART").otherwise("SECTION")), F.lit("section.number"), val(F.when(k % 11 == 0, "").otherwise(F.concat(k.cast("string"), F.lit(".")))),
        F.lit("order.number"), val(F.when(k % 7 == 0, F.concat(F.lit("x"), k.cast("string"))).otherwise(k.cast("string"))), F.lit("omitted"), val(F.when(k % 13 == 0, "True").otherwise("false")), F.lit("title"), val(F.col("c_name")),
    )
    return c.select(F.col("c_nationkey").alias("act_id"), k.alias("uuid"), m.alias("metadata"))


def _first(key: str):
    return F.coalesce(F.get(F.try_element_at("metadata", F.lit(key)), 0)["value"], F.lit(""))


@query("""SELECT c_custkey AS uuid, c_nationkey AS act_id, c_custkey || '.' AS section_no, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS INT) END AS order_number,
  CAST(row_number() OVER (PARTITION BY c_nationkey ORDER BY CASE WHEN c_custkey % 7 <> 0 THEN c_custkey ELSE 1000000 END, c_custkey) - 1 AS INT) AS order_idx FROM customer WHERE c_custkey % 5 <> 0 AND c_custkey % 11 <> 0""")
def payload_sections(v: Views) -> DataFrame:
    number = F.when(_first("order.number").rlike("^[0-9]+$"), _first("order.number").cast("int"))
    p = _payload(v).where((_first("collection") == "SECTION") & (_first("section.number") != "")).select("uuid", "act_id", _first("section.number").alias("section_no"), number.alias("order_number"))
    w = W.partitionBy("act_id").orderBy(F.coalesce("order_number", F.lit(1_000_000)), "uuid")
    return p.withColumn("order_idx", F.row_number().over(w) - 1)


@query("SELECT c_custkey AS uuid, c_name AS title, CASE WHEN c_custkey % 7 <> 0 THEN CAST(c_custkey AS INT) END AS order_number, c_custkey % 13 = 0 AS is_omitted, '' AS missing FROM customer")
def item_projection(v: Views) -> DataFrame:
    number = F.when(_first("order.number").rlike("^[0-9]+$"), _first("order.number").cast("int"))
    return _payload(v).select("uuid", _first("title").alias("title"), number.alias("order_number"), (F.lower(_first("omitted")) == "true").alias("is_omitted"), _first("nothing").alias("missing"))


@query("""WITH n AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS k, CASE WHEN doc_id % 10 = 0 THEN text || '!' ELSE text END AS t FROM documents)
SELECT doc_id, sha256(length(k) || ':' || k || coalesce(length(t) || ':' || t, '~')) AS sha FROM n WHERE doc_id % 10 = 0 OR doc_id % 17 = 3""")
def changed_documents(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", "text")
    new = d.withColumn("text", F.when(F.col("doc_id") % 10 == 0, F.concat("text", F.lit("!"))).otherwise(F.col("text")))
    return store.changed_rows(d.where("doc_id % 17 <> 3"), new, "doc_id", ["doc_id", "text"])


_ORDERS = "SELECT o_custkey AS k, o_orderkey AS ver, o_orderstatus AS status FROM orders"


@query(f"SELECT k, max(ver) AS ver, arg_max(status, ver) AS status FROM ({_ORDERS}) GROUP BY k")
def upsert_latest(v: Views) -> DataFrame:
    o = v.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ver"), F.col("o_orderstatus").alias("status"))
    return store.upsert_latest(o.where("ver % 3 = 0"), o.where("ver % 3 <> 0"), ["k"], "ver")


@query("SELECT l_partkey % 50 AS statute_id, l_suppkey AS no, max(l_orderkey * 10 + l_linenumber) AS ver FROM lineitem GROUP BY 1, 2")
def upsert_sections(v: Views) -> DataFrame:
    s = v.table("lineitem").select((F.col("l_partkey") % 50).alias("statute_id"), F.col("l_suppkey").alias("no"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("ver"))
    return store.upsert_latest(s.where("ver % 2 = 0"), s.where("ver % 2 = 1"), ["statute_id", "no"], "ver")


@query("SELECT from_section_id, to_section_id FROM links WHERE from_section_id % 4 <> 0", "links")
def insert_ignore_links(v: Views) -> DataFrame:
    new = v.links.where("from_section_id % 4 <> 0").unionByName(v.links)
    return store.insert_ignore(v.links.where("from_section_id % 4 = 0"), new, ["from_section_id", "to_section_id"])


@query("""SELECT user_id AS run_id, count(*) AS docs, count(*) FILTER (WHERE event_type = 'error') AS n_errors,
  CASE WHEN count(*) FILTER (WHERE event_type = 'error') = 0 THEN 'succeeded' WHEN count(*) FILTER (WHERE event_type = 'error') < count(*) THEN 'partial' ELSE 'failed' END AS status,
  array_to_string(list_sort(list(event_type || ':' || event_id) FILTER (WHERE event_type = 'error')), ',') AS errors FROM events GROUP BY 1""")
def run_ledger(v: Views) -> DataFrame:
    bad = F.col("event_type") == "error"
    errors = F.array_sort(F.collect_list(F.when(bad, F.concat_ws(":", "event_type", "event_id"))))
    g = v.table("events").groupBy(F.col("user_id").alias("run_id")).agg(F.count("*").alias("docs"), F.count_if(bad).alias("n_errors"), errors.alias("e"))
    status = F.when(F.col("n_errors") == 0, "succeeded").when(F.col("n_errors") < F.col("docs"), "partial").otherwise("failed")
    return g.select("run_id", "docs", "n_errors", status.alias("status"), F.when(F.size("e") > 0, F.array_join("e", ",")).alias("errors"))


@query("SELECT event_id AS id, event_type = 'click' AS answered, event_type = 'error' AS abstained, CAST(floor(value) AS INT) AS latency_ms, ts AS created_at FROM events")
def ask_log_projection(v: Views) -> DataFrame:
    t = F.col("event_type")
    return v.table("events").select(F.col("event_id").alias("id"), (t == "click").alias("answered"), (t == "error").alias("abstained"), F.floor("value").cast("int").alias("latency_ms"), F.col("ts").alias("created_at"))


@query("SELECT vec_id, label FROM embeddings WHERE label % 3 = 0")
def pending_embeddings(v: Views) -> DataFrame:
    """Rows that wait for a vector: what `embedding.embed` is given; a second run finds none."""
    return v.table("embeddings").withColumn("embedding", F.when(F.col("label") % 3 != 0, F.col("embedding"))).where("embedding IS NULL").select("vec_id", "label")


@query("SELECT doc_id, source, CASE WHEN source = 'src3' THEN n_chars + 1 ELSE n_chars END AS n_chars FROM documents")
def scoped_rebuild(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", "source", "n_chars")
    return store.scoped_rebuild(d, d.withColumn("n_chars", F.col("n_chars") + 1), F.col("source") == "src3")


@query("SELECT user_id AS id, max(event_id) AS seq, CAST(arg_max(CAST(json_extract_string(props, '$.k') AS INT), event_id) AS INT) AS k FROM events WHERE event_type <> 'error' AND event_type <> 'view' GROUP BY 1")
def checkpoint_latest(v: Views) -> DataFrame:
    e = F.col("event_type")
    line = F.when(e == "error", '{"id": 3, "seq"').when(e == "view", "  ").otherwise(F.concat(F.lit('{"id": '), F.col("user_id").cast("string"), F.lit(', "seq": '), F.col("event_id").cast("string"), F.lit(", "), F.substring("props", 2, 1000)))
    return store.latest_checkpoint(v.table("events").select("event_id", line.alias("line")), "id long, seq long, k int", "id", "event_id")


@query("SELECT id, must_abstain, unnest(CASE WHEN len(expected) = 0 THEN [NULL] ELSE expected END) AS expected FROM gold", "gold")
def gold_flatten(v: Views) -> DataFrame:
    inside, outside = v.gold.where("NOT must_abstain"), v.gold.where("must_abstain")
    return inside.unionByName(outside).select("id", "must_abstain", F.explode_outer("expected").alias("expected"))


@query("SELECT doc_id, CASE WHEN doc_id % 20 = 0 THEN 'removed' WHEN doc_id % 20 = 1 THEN 'added' ELSE 'changed' END AS change FROM documents WHERE doc_id % 20 < 3")
def row_fingerprint_diff(v: Views) -> DataFrame:
    d = v.table("documents").select("doc_id", "lang", "n_chars")
    new = d.where("doc_id % 20 <> 0").withColumn("n_chars", F.when(F.col("doc_id") % 20 == 2, F.col("n_chars") + 1).otherwise(F.col("n_chars")))
    return store.fingerprint_diff(d.where("doc_id % 20 <> 1"), new, "doc_id", ["doc_id", "lang", "n_chars"])


@query("""SELECT p_partkey, substring(sha256('embed=' || (p_partkey % 4) || ';rrf_k=60;top_k=' || (p_partkey % 5)), 1, 12) AS run_fp FROM part""")
def run_fingerprint(v: Views) -> DataFrame:
    k = F.col("p_partkey")
    settings = F.create_map(F.lit("top_k"), k % 5, F.lit("floor"), k, F.lit("embed"), k % 4, F.lit("rrf_k"), F.lit(60).cast("long"), F.lit("top_n"), k)
    moving = F.array_sort(F.map_entries(F.map_filter(settings, lambda name, _: ~name.isin("floor", "top_n"))))
    joined = F.array_join(F.transform(moving, lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ";")
    return v.table("part").select("p_partkey", F.substring(F.sha2(joined, 256), 1, 12).alias("run_fp"))


# --- jobs that write, run whole ---------------------------------------------------------------------------------


@query(f"SELECT k, max(ver) AS ver, arg_max(status, ver) AS status FROM ({_ORDERS}) GROUP BY k")
def merge_written(v: Views) -> DataFrame:
    """Orders merged into a table on disk in two rounds, the second sent twice."""
    o = v.table("orders").select(F.col("o_custkey").alias("k"), F.col("o_orderkey").alias("ver"), F.col("o_orderstatus").alias("status"))
    path = shared_path(v.spark, "orders")
    for rows in (o.where("ver % 3 = 0"), o.where("ver % 3 <> 0"), o.where("ver % 3 <> 0")):
        jobs.merge_into(v.spark, path, rows, ["k"], "ver", parts=16)
    return jobs.read_merged(v.spark, path)


@query("SELECT from_section_id, to_section_id FROM links", "links")
def links_written(v: Views) -> DataFrame:
    """Edges appended in two overlapping rounds."""
    path = shared_path(v.spark, "links")
    for rows in (v.links.where("from_section_id % 4 = 0"), v.links):
        jobs.append_new(rows, path, ["from_section_id", "to_section_id"])
    return v.spark.read.parquet(path)


@query("""SELECT CAST(k AS INT) AS round, CASE k WHEN 1 THEN 'partial' ELSE 'succeeded' END AS status, CASE WHEN k = 2 THEN 0 ELSE n END AS written, CASE WHEN k = 1 THEN 'no_text' END AS error
FROM (SELECT count(*) AS n FROM documents), (VALUES (0), (1), (2)) t(k)""")
def ledger_written(v: Views) -> DataFrame:
    """Three rounds of a job, as its ledger has them: all rows, all rows with an error noted, none."""
    d = v.table("documents").select("doc_id", "n_chars")
    ledger = jobs.Ledger(v.spark, shared_path(v.spark, "ledger"))
    for k in range(3):
        with ledger.run(f"round {k}") as run:
            run.counted(d.where(F.lit(k < 2)), "written").write.parquet(shared_path(v.spark, "round"))
            if k == 1:
                run.error("no_text", "an item")
    return ledger.rows().select(F.substring("command", 7, 1).cast("int").alias("round"), "status", F.col("counts")["written"].alias("written"), F.get("errors", 0)["kind"].alias("error"))


@query("""WITH d AS (SELECT doc_id AS id, [x FOR x IN string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') IF x <> ''] AS t FROM documents WHERE doc_id % 2 = 0), h AS (SELECT id, md5(unnest(list_append(t, 'passage'))) AS h FROM d WHERE len(t) > 0),
w AS (SELECT id, CAST(('0x' || substr(h, 1, 4)) AS INT) % 64 AS slot, sum(CASE WHEN CAST(('0x' || substr(h, 5, 1)) AS INT) < 8 THEN 1 ELSE -1 END) AS w FROM h GROUP BY 1, 2)
SELECT id, bool_or(w <> 0) AS unit FROM w GROUP BY 1""")
def embedded_in_ranges(v: Views) -> DataFrame:
    """Vectors of every second document, embedded in ranges of ids and appended, by two runs of which the second finds nothing; whether each is of length one, as it is unless its terms cancel out."""
    d = v.table("documents").where("doc_id % 2 = 0").select(F.col("doc_id").alias("id"), "text").where(F.size(T.terms(F.col("text"))) > 0)
    path = shared_path(v.spark, "vectors")
    for _ in range(2):
        jobs.embed_pending(d, path, embedding.hashing_model(64), 64, batch_rows=max(1, -(-v.table("documents").count() // 8)))
    norm = F.sqrt(F.aggregate("vector", F.lit(0.0), lambda a, x: a + x * x))
    return v.spark.read.parquet(path).select("id", (F.abs(norm - 1) < 1e-9).alias("unit"))


@query("SELECT user_id AS id, max(event_id) AS seq, CAST(arg_max(CAST(json_extract_string(props, '$.k') AS INT), event_id) AS INT) AS k FROM events GROUP BY 1")
def checkpoint_files(v: Views) -> DataFrame:
    """Lines of JSON appended in two files' worth, read in their order."""
    e = v.table("events").select(F.col("user_id").alias("id"), F.col("event_id").alias("seq"), F.get_json_object("props", "$.k").cast("int").alias("k"))
    path = shared_path(v.spark, "lines")
    half = e.agg(F.expr("percentile_approx(seq, 0.5)")).first()[0]
    for rows in (e.where(F.col("seq") <= half), e.where(F.col("seq") > half)):
        jobs.append_checkpoint(rows.coalesce(1).sortWithinPartitions("seq"), path)
    return jobs.read_checkpoint(v.spark, path, "id long, seq long, k int", "id")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS asked, count(*) FILTER (WHERE event_type = 'click') AS answered FROM events GROUP BY 1")
def ask_log_written(v: Views) -> DataFrame:
    """A log appended from events, of its own columns only, counted by day."""
    t = F.col("event_type")
    path = shared_path(v.spark, "asked")
    jobs.append_ask_log(v.table("events").select(F.concat(F.lit("q"), "event_id").alias("question"), "user_id", (t == "click").alias("answered"), (t == "error").alias("abstained"), F.col("ts").alias("created_at")), path)
    return v.spark.read.parquet(path).groupBy("day").agg(F.count("*").alias("asked"), F.count_if("answered").alias("answered"))


# --- scopes, lookups, joins -----------------------------------------------------------------------------------


@query("SELECT id, section_no FROM sections WHERE NOT is_omitted", "sections")
def indexable_sections(v: Views) -> DataFrame:
    return v.sections.where(~F.col("is_omitted")).select("id", "section_no")


@query("SELECT id FROM sections WHERE statute_id IN (SELECT id FROM statutes WHERE slug = 'src5')", "sections")
def scope_by_act(v: Views) -> DataFrame:
    return v.sections.join(v.statutes.where("slug = 'src5'").select(F.col("id").alias("statute_id")), "statute_id", "left_semi").select("id")


@query("SELECT l_orderkey AS wanted, l_linenumber AS line, s.section_no, s.id IS NOT NULL AS found FROM lineitem LEFT JOIN sections s ON s.id = l_orderkey", "sections")
def lookup_sections(v: Views) -> DataFrame:
    w = v.table("lineitem").select(F.col("l_orderkey").alias("wanted"), F.col("l_linenumber").alias("line"))
    s = v.sections.select("id", "section_no")
    return w.join(s, w.wanted == s.id, "left").select("wanted", "line", "section_no", F.col("id").isNotNull().alias("found"))


_KEYED = "SELECT id, statute_id, regexp_replace(lower(section_no), '[^0-9a-z]', '', 'g') AS key, section_no FROM sections"


@query(f"""WITH w AS (SELECT o_orderkey, o_custkey % 20 + 1 AS statute_id, (o_orderkey % 400) || ' a' AS asked FROM orders), s AS ({_KEYED})
SELECT o_orderkey, min(s.id) AS id FROM w LEFT JOIN s ON s.statute_id = w.statute_id AND s.key = regexp_replace(lower(asked), '[^0-9a-z]', '', 'g') GROUP BY 1""", "sections")
def lookup_by_number(v: Views) -> DataFrame:
    w = v.table("orders").select("o_orderkey", (F.col("o_custkey") % 20 + 1).alias("statute_id"), F.concat((F.col("o_orderkey") % 400).cast("string"), F.lit(" a")).alias("asked")).withColumn("key", T.normalise_no(F.col("asked")))
    s = v.sections.select("id", "statute_id", T.normalise_no(F.col("section_no")).alias("key"), T.section_no_sort(F.col("section_no")).alias("sort"))
    first = s.groupBy("statute_id", "key").agg(F.min_by("id", F.struct("sort", "id")).alias("id"))
    return w.join(first, ["statute_id", "key"], "left").select("o_orderkey", "id")


@query(f"""WITH q AS (SELECT o_orderkey AS query_id, CASE o_orderkey % 3 WHEN 0 THEN 'section ' || (o_orderkey % 500) WHEN 1 THEN 's. ' || (o_orderkey % 500) || 'A' ELSE 'what is consideration?' END AS q FROM orders),
k AS (SELECT query_id, regexp_replace(lower(regexp_extract(q, '(?i)\\b(?:sections?|ss?\\.?)\\s*([0-9]{{1,3}}(?:-?[A-Z]{{1,2}})?)\\b', 1)), '[^0-9a-z]', '', 'g') AS key FROM q), s AS ({_KEYED}),
h AS (SELECT query_id, s.id, row_number() OVER (PARTITION BY query_id ORDER BY a.year, s.id) AS rn FROM k JOIN s ON k.key = s.key JOIN statutes a ON a.id = s.statute_id WHERE k.key <> '')
SELECT query_id, id, CAST(rn AS INT) AS rn FROM h WHERE rn <= 5""", "sections")
def search_by_citation(v: Views) -> DataFrame:
    k, s = F.col("o_orderkey"), lambda *xs: F.concat(*(F.lit(x) if isinstance(x, str) else x.cast("string") for x in xs))
    q = v.table("orders").select(k.alias("query_id"), F.when(k % 3 == 0, s("section ", k % 500)).when(k % 3 == 1, s("s. ", k % 500, "A")).otherwise("what is consideration?").alias("q"))
    key = T.normalise_no(F.regexp_extract("q", r"(?i)\b(?:sections?|ss?\.?)\s*([0-9]{1,3}(?:-?[A-Z]{1,2})?)\b", 1))
    keyed = v.sections.select("id", "statute_id", T.normalise_no(F.col("section_no")).alias("key"))
    hits = q.select("query_id", key.alias("key")).where("key <> ''").join(keyed, "key").join(v.statutes.select(F.col("id").alias("statute_id"), "year"), "statute_id")
    return graph.numbered_by(hits, ["query_id"], ["year", "id"]).where("rn <= 5").select("query_id", "id", "rn")


@query("SELECT statute_id, id, section_no, is_omitted FROM sections", "sections")
def section_index(v: Views) -> DataFrame:
    return v.sections.select("statute_id", "id", "section_no", "is_omitted").orderBy("statute_id", T.section_no_sort(F.col("section_no")))


@query("SELECT a.id, a.short_title, a.year, count(s.id) AS sections FROM statutes a LEFT JOIN sections s ON s.statute_id = a.id GROUP BY 1, 2, 3", "sections")
def list_acts(v: Views) -> DataFrame:
    n = v.sections.groupBy("statute_id").agg(F.count("*").alias("sections"))
    a = v.statutes
    return a.join(n, a.id == n.statute_id, "left").select("id", "short_title", "year", F.coalesce("sections", F.lit(0)).alias("sections")).orderBy("year", "short_title")


@query("SELECT s.id AS section_id, s.statute_id, a.short_title || ', s. ' || s.section_no AS citation, s.marginal_note FROM sections s JOIN statutes a ON a.id = s.statute_id", "sections")
def section_act(v: Views) -> DataFrame:
    a = v.statutes.select(F.col("id").alias("statute_id"), "short_title")
    return v.sections.join(a, "statute_id").select(F.col("id").alias("section_id"), "statute_id", F.concat("short_title", F.lit(", s. "), "section_no").alias("citation"), "marginal_note")


@query("SELECT e.vec_id AS chunk_id, s.id AS section_id, a.slug, s.section_no FROM embeddings e JOIN sections s ON s.id = e.vec_id % (SELECT count(*) FROM documents) JOIN statutes a ON a.id = s.statute_id", "sections")
def chunk_section_act(v: Views) -> DataFrame:
    c = v.table("embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % v.table("documents").count()).alias("id"))
    a = v.statutes.select(F.col("id").alias("statute_id"), "slug")
    return c.join(v.sections.select("id", "statute_id", "section_no"), "id").join(a, "statute_id").select("chunk_id", F.col("id").alias("section_id"), "slug", "section_no")


@query("""SELECT e.vec_id AS chunk_id, s.id AS section_id, a.short_title, s.section_no, s.marginal_note, 'passage: ' || a.short_title AS heading FROM embeddings e JOIN sections s ON s.id = e.vec_id % (SELECT count(*) FROM documents) JOIN statutes a ON a.id = s.statute_id WHERE NOT s.is_omitted""", "sections")
def candidate_base(v: Views) -> DataFrame:
    c = v.table("embeddings").select(F.col("vec_id").alias("chunk_id"), (F.col("vec_id") % v.table("documents").count()).alias("id"))
    s = v.sections.where(~F.col("is_omitted")).select("id", "statute_id", "section_no", "marginal_note")
    a = v.statutes.select(F.col("id").alias("statute_id"), "short_title")
    return c.join(s, "id").join(a, "statute_id").select("chunk_id", F.col("id").alias("section_id"), "short_title", "section_no", "marginal_note", F.concat(F.lit("passage: "), "short_title").alias("heading"))


_RELATED = """SELECT DISTINCT x.id, x.direction, x.other, a.short_title, s.section_no FROM (SELECT from_section_id AS id, to_section_id AS other, 'outbound' AS direction FROM links UNION ALL SELECT to_section_id, from_section_id, 'inbound' FROM links) x
JOIN sections s ON s.id = x.other JOIN statutes a ON a.id = s.statute_id"""


@query(_RELATED, "sections", "links")
def related_sections(v: Views) -> DataFrame:
    return graph.related(v.links, v.sections, v.statutes, v.most_links)


@query(f"""WITH r AS ({_RELATED}) SELECT s.id, a.short_title, s.section_no, count(r.other) AS n_related, coalesce(string_agg(CAST(r.other AS VARCHAR), ',' ORDER BY r.direction, r.other), '') AS related,
CASE s.id % 3 WHEN 0 THEN '1=Ins. by Act ' || s.id || ';2=plain' WHEN 1 THEN '' ELSE '=One note' END AS footnotes FROM sections s JOIN statutes a ON a.id = s.statute_id LEFT JOIN r ON r.id = s.id GROUP BY 1, 2, 3""", "sections", "links")
def section_detail(v: Views) -> DataFrame:
    each = graph.related(v.links, v.sections, v.statutes, v.most_links).select("id", "direction", "other")
    r = dealt(each, 2 * v.most_links, "id").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("direction", "other"))).alias("r"))  # two for a link
    r = r.select("id", F.size("r").cast("long").alias("n"), F.array_join(F.transform("r", lambda x: x["other"].cast("string")), ",").alias("others"))
    a = v.statutes.select(F.col("id").alias("statute_id"), "short_title")
    k = F.col("id")
    raw = F.when(k % 3 == 0, F.concat(F.lit("[1]. Ins. by Act "), k.cast("string"), F.lit("\n2. plain"))).when(k % 3 == 1, "").otherwise("One note")
    s = v.sections.select("id", "statute_id", "section_no", T.footnotes(raw).alias("footnotes")).join(a, "statute_id").join(r, "id", "left")
    notes = F.array_join(F.transform("footnotes", lambda n: F.concat_ws("=", n["marker"], n["text"])), ";").alias("footnotes")
    return s.select("id", "short_title", "section_no", notes, F.coalesce("n", F.lit(0)).cast("long").alias("n_related"), F.coalesce("others", F.lit("")).alias("related"))


_KEPT = "SELECT item_id AS query_id, item_id * 3 + k AS section_id FROM benchmark, (VALUES (0), (1), (2)) t(k)"


def _kept(v: Views) -> DataFrame:
    return v.table("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("query_id", (F.col("query_id") * 3 + F.col("k")).alias("section_id"))


@query(f"""WITH kept AS ({_KEPT}) SELECT DISTINCT query_id, to_section_id AS section_id FROM kept JOIN links ON from_section_id = section_id
WHERE NOT EXISTS (SELECT 1 FROM kept k2 WHERE k2.query_id = kept.query_id AND k2.section_id = to_section_id)""", "links")
def expand_one_hop(v: Views) -> DataFrame:
    return graph.expand_one_hop(_kept(v), v.links)


@query(f"WITH kept AS ({_KEPT}) SELECT query_id, section_id FROM kept WHERE section_id IN (SELECT id FROM sections WHERE NOT is_omitted)", "sections")
def live_filter(v: Views) -> DataFrame:
    live = v.sections.where(~F.col("is_omitted")).select(F.col("id").alias("section_id"))
    return _kept(v).join(live, "section_id", "left_semi").select("query_id", "section_id")


@query("SELECT id FROM sections WHERE NOT is_omitted AND id NOT IN (SELECT vec_id FROM embeddings)", "sections")
def unchunked_sections(v: Views) -> DataFrame:
    done = v.table("embeddings").select(F.col("vec_id").alias("id"))
    return v.sections.where(~F.col("is_omitted")).select("id").join(done, "id", "left_anti")


@query("SELECT 'statutes' AS part, count(*) AS n FROM statutes WHERE year >= 1850 UNION ALL SELECT 'sections', count(*) FROM sections s JOIN statutes a ON a.id = s.statute_id WHERE year >= 1850 UNION ALL SELECT 'chunks', count(*) FROM embeddings WHERE vec_id % (SELECT count(*) FROM documents) NOT IN (SELECT s.id FROM sections s JOIN statutes a ON a.id = s.statute_id WHERE year < 1850)", "sections")
def cascade_delete(v: Views) -> DataFrame:
    gone = F.col("year") < 1850
    s = v.sections.select("id", F.col("statute_id").alias("parent_id"))
    c = v.table("embeddings").select((F.col("vec_id") % v.table("documents").count()).alias("parent_id"))
    left, chunks = store.cascade_delete(v.statutes, s, c, gone)
    one = lambda name, df: df.agg(F.count("*").alias("n")).select(F.lit(name).alias("part"), "n")
    return one("statutes", v.statutes.where(~gone)).unionByName(one("sections", left)).unionByName(one("chunks", chunks))


@query("SELECT l_orderkey, l_linenumber, l_suppkey FROM lineitem WHERE l_orderkey NOT IN (SELECT doc_id FROM documents)")
def orphan_rows(v: Views) -> DataFrame:
    return store.orphans(v.table("lineitem").select("l_orderkey", "l_linenumber", "l_suppkey"), v.table("documents"), "l_orderkey", "doc_id")


# --- references -----------------------------------------------------------------------------------------------


def _refs(v: Views) -> DataFrame:
    return graph.extract_references(spread(v.refs_text))


_SECTION, _PART = (x.replace("'", "''") for x in (graph.SECTION_REF, graph.PART_REF))
_PARSED = f"""WITH k AS (SELECT id, statute_id, id % 10 AS k, {", ".join(f"regexp_extract_all(text, '{_SECTION}', {i}) AS {name}" for i, name in enumerate(("raws", "numbers", "acts")))}, regexp_extract_all(text, '{_PART}', 1) AS parts FROM refs_text),
refs AS (SELECT id, statute_id, 'section' AS kind, unnest(raws) AS raw, unnest(numbers) AS numbers, nullif(unnest(acts), '') AS act FROM k UNION ALL SELECT id, statute_id, 'part', unnest(parts), '', NULL FROM k)"""


@query(f"{_PARSED} SELECT id, kind, raw, numbers, act FROM refs", "refs_text")
def extract_references(v: Views) -> DataFrame:
    return _refs(v).select("id", "kind", "raw", "numbers", "act")


_ITEMS = _PARSED + """, items AS (SELECT id, statute_id, raw, act, unnest(string_split(regexp_replace(numbers, '(?i)\\s*(,|and|or|&)\\s*', '|', 'g'), '|')) AS item FROM refs WHERE kind = 'section'),
ends AS (SELECT *, string_split(regexp_replace(item, '(?i)\\s*to\\s*', '|', 'g'), '|') AS e FROM items),
nos AS (SELECT id, statute_id, raw, act, unnest(CASE WHEN len(e) = 2 AND TRY_CAST(e[1] AS INT) IS NOT NULL AND TRY_CAST(e[2] AS INT) IS NOT NULL AND TRY_CAST(e[2] AS INT) - TRY_CAST(e[1] AS INT) BETWEEN 1 AND 29
  THEN [CAST(x AS VARCHAR) FOR x IN range(TRY_CAST(e[1] AS INT), TRY_CAST(e[2] AS INT) + 1)] ELSE e END) AS no FROM ends)"""


@query(f"{_ITEMS} SELECT id, raw, no FROM nos", "refs_text")
def expand_ranges(v: Views) -> DataFrame:
    return graph.expand_numbers(_refs(v).where("kind = 'section'")).select("id", "raw", "no")


_TITLES = _ITEMS + """, titles AS (SELECT id AS statute_id, trim(regexp_replace(regexp_replace(regexp_replace(lower(short_title), '[^a-z0-9]+', ' ', 'g'), '\\bthe\\b', ' ', 'g'), ' +', ' ', 'g')) AS title FROM statutes),
phrases AS (SELECT DISTINCT act AS phrase, trim(regexp_replace(regexp_replace(regexp_replace(lower(act), '[^a-z0-9]+', ' ', 'g'), '\\bthe\\b', ' ', 'g'), ' +', ' ', 'g')) AS key FROM refs WHERE act IS NOT NULL),
ranked AS (SELECT phrase, statute_id, row_number() OVER (PARTITION BY phrase ORDER BY (key = title) DESC, length(title) DESC, statute_id) AS rn FROM phrases LEFT JOIN titles ON contains(key, title)),
resolved AS (SELECT phrase, statute_id FROM ranked WHERE rn = 1)"""


@query(f"{_TITLES} SELECT * FROM resolved", "refs_text", "statutes")
def resolve_act_title(v: Views) -> DataFrame:
    return graph.resolve_titles(_refs(v), v.statutes)


_RESOLVED = _TITLES + """, sk AS (SELECT statute_id AS target, regexp_replace(lower(section_no), '[^0-9a-z]', '', 'g') AS key, min(id) AS to_id FROM sections GROUP BY 1, 2),
t AS (SELECT n.id, n.raw, n.no, CASE WHEN n.act IS NULL THEN n.statute_id ELSE r.statute_id END AS target FROM nos n LEFT JOIN resolved r ON r.phrase = n.act),
found AS (SELECT t.id, t.raw, t.no, sk.to_id FROM t LEFT JOIN sk ON sk.target = t.target AND sk.key = regexp_replace(lower(t.no), '[^0-9a-z]', '', 'g') WHERE t.target IS NOT NULL),
out AS (SELECT id, raw, no, to_id, CASE WHEN to_id IS NULL THEN 'section_not_found' END AS reason FROM found WHERE to_id IS NULL OR to_id <> id
  UNION ALL SELECT id, raw, NULL, NULL, 'no_part_hierarchy' FROM refs WHERE kind = 'part'
  UNION ALL SELECT refs.id, raw, NULL, NULL, 'act_not_in_corpus' FROM refs JOIN resolved r ON r.phrase = refs.act WHERE r.statute_id IS NULL)"""


def _resolved(v: Views) -> DataFrame:
    return graph.resolve_references(_refs(v), v.sections, v.statutes)


@query(f"{_RESOLVED} SELECT id, raw, no, to_id, reason FROM out", "refs_text", "sections")
def resolve_references(v: Views) -> DataFrame:
    return _resolved(v).select("id", "raw", "no", "to_id", "reason")


@query(f"{_RESOLVED} SELECT reason AS kind, count(*) AS n FROM out WHERE reason IS NOT NULL GROUP BY 1", "refs_text", "sections")
def unresolved_by_kind(v: Views) -> DataFrame:
    return _resolved(v).where("reason IS NOT NULL").groupBy(F.col("reason").alias("kind")).agg(F.count("*").alias("n"))


@query(f"{_RESOLVED} SELECT DISTINCT id AS from_section_id, to_id AS to_section_id FROM out WHERE reason IS NULL", "refs_text", "sections")
def build_links(v: Views) -> DataFrame:
    return graph.build_links(_resolved(v)).select("from_section_id", "to_section_id")


@query("""SELECT CAST(c_nationkey AS VARCHAR) AS act_id, count(*) AS items, count(*) FILTER (WHERE c_custkey % 5 <> 0 AND c_custkey % 11 <> 0) AS sections, min(CASE WHEN c_custkey % 5 <> 0 AND c_custkey % 11 <> 0 THEN c_custkey END) AS least FROM customer GROUP BY 1""")
def archive_scan(v: Views) -> DataFrame:
    """Payloads of customers by nation, written as JSON, read again with the archive's schema, and split to sections."""
    k = F.col("uuid").cast("string")
    meta = F.map_concat(F.col("metadata"), F.create_map(F.lit("act.id"), F.array(F.struct(F.col("act_id").cast("string").alias("value")))))
    item = F.struct(k.alias("uuid"), F.concat(F.lit("h/"), k).alias("handle"), k.alias("name"), meta.alias("metadata"))
    path = shared_path(v.spark, "archive")
    _payload(v).groupBy(F.col("act_id").cast("string").alias("act_id")).agg(F.collect_list(item).alias("items")).write.json(path)
    read = archive.read_archive(v.spark, path)
    found = archive.section_items(read).groupBy("act_id").agg(F.count("*").alias("sections"), F.min(F.col("uuid").cast("long")).alias("least"))
    return read.select("act_id", F.size("items").cast("long").alias("items")).join(found, "act_id", "left").select("act_id", "items", F.coalesce("sections", F.lit(0)).alias("sections"), "least")


@query("""WITH t AS (SELECT doc_id AS id, unnest([x FOR x IN string_split_regex(lower(text), '[^\\p{L}\\p{N}]+') IF x <> '']) AS term FROM documents), h AS (SELECT id, md5(term) AS h FROM t),
w AS (SELECT id, CAST(('0x' || substr(h, 1, 4)) AS INT) % 64 AS slot, sum(CASE WHEN CAST(('0x' || substr(h, 5, 1)) AS INT) % 2 = 0 THEN 1 ELSE -1 END) AS w FROM h GROUP BY 1, 2)
SELECT id, slot, round(w / sqrt(sum(w * w) OVER (PARTITION BY id)), 9) AS value FROM w WHERE w <> 0""")
def hashed_vectors(v: Views) -> DataFrame:
    return embedding.hashed_vectors(v.table("documents").select(F.col("doc_id").alias("id"), "text"))
