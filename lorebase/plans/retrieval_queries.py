"""Search over whole tables, from postings to packed context."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import text as T
from ..functions.stem import stem_sql
from ..operators import dense_index, graph
from ..operators import retrieval as R
from ..operators.chunking import chunk_report as chunk_report_of
from ..operators.chunking import chunk_sections as _chunk
from ..operators.chunking import register_chunker
from ..operators.search_index import SearchIndex, build_index, open_index
from ..sources.cluster import path_exists, shared_path, version_of
from ..sources.views import Views
from .registry import query


def _docs(v: Views) -> DataFrame:
    """Texts behind a heading that names their source."""
    heading = T.heading_prefix(F.col("source"), F.lit(None).cast("string"))
    return v.table("documents").select(F.col("doc_id").alias("id"), T.indexed_text(heading, F.col("text")).alias("text"))


_built: dict[tuple[str, str], str] = {}


def _index(v: Views) -> SearchIndex:
    """The kept index of the documents: built by the first search of an application, then only opened. Changed files give another one."""
    key = (v.spark.sparkContext.applicationId, version_of(v.spark, f"{v.sf_dir}/documents.parquet"))
    if key not in _built or not path_exists(v.spark, f"{_built[key]}/postings/_SUCCESS"):
        path = shared_path(v.spark, "search-index")
        build_index(_docs(v), path)
        _built[key] = path
    return open_index(v.spark, _built[key])


def _asked(v: Views) -> DataFrame:
    return v.table("benchmark").select(F.col("item_id").alias("query_id"), "text")


_STOP = "[" + ", ".join(f"'{x}'" for x in T.STOP_WORDS) + "]"
_WORDS = f"[x FOR x IN string_split_regex(lower({{}}), '[^\\p{{{{L}}}}\\p{{{{N}}}}]+') IF x <> '' AND NOT list_contains({_STOP}, x)]"
_TERMS = f"""WITH tok AS (SELECT doc_id AS id, {_WORDS.format("source || '.  ' || text")} AS t FROM documents), qw AS (SELECT DISTINCT item_id AS query_id, unnest({_WORDS.format("text")}) AS word FROM benchmark),
words AS (SELECT id, len(t) AS len, unnest(t) AS word FROM tok), voc AS MATERIALIZED (SELECT word, {stem_sql("word")} AS term FROM (SELECT word FROM words UNION SELECT word FROM qw)), occ AS (SELECT id, len, term FROM words JOIN voc USING (word))"""
_BM25 = _TERMS + f""", asked AS (SELECT DISTINCT query_id, term FROM qw JOIN voc USING (word)),
tf AS (SELECT id, term, count(*) AS tf, any_value(len) AS len FROM occ WHERE term IN (SELECT term FROM asked) GROUP BY id, term), df AS (SELECT term, count(*) AS df FROM tf GROUP BY term), sz AS (SELECT count(*) AS n, avg(len(t)) AS mean FROM tok),
bm AS (SELECT query_id, id, round(sum(ln(1 + (n - df + 0.5) / (df + 0.5)) * tf * 2.2 / (tf + 1.2 * (0.25 + 0.75 * len / mean))), 6) AS score, count(*) AS matched FROM asked JOIN tf USING (term) JOIN df USING (term), sz GROUP BY query_id, id),
sparse AS (SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS INT) AS rank FROM bm) WHERE rank <= 30)"""


@query(f"{_TERMS} SELECT id, term, count(*) AS tf FROM occ GROUP BY id, term")
def postings(v: Views) -> DataFrame:
    return R.postings(_docs(v), "id", "text")


@query(f"{_BM25} SELECT query_id, id, score FROM bm")
def bm25_scores(v: Views) -> DataFrame:
    return R.bm25(_docs(v), _asked(v)).select("query_id", "id", "score")


@query(f"{_BM25} SELECT query_id, id, score, rank FROM sparse")
def sparse_topk(v: Views) -> DataFrame:
    return _index(v).search(_asked(v)).select("query_id", "id", "score", "rank")


_COS = "round(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) / sqrt(list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(a.embedding AS DOUBLE[])) * list_dot_product(CAST(b.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[]))), 9)"


def _dense_sql(which: str, scope: str = "true", qid: str = "a.vec_id") -> str:
    return f"SELECT * FROM (SELECT {qid} AS query_id, b.vec_id AS id, {_COS} AS score, CAST(row_number() OVER (PARTITION BY {qid} ORDER BY {_COS} DESC, b.vec_id) AS INT) AS rank FROM embeddings a, embeddings b WHERE {which} AND {scope}) WHERE rank <= 30"


def _vectors(v: Views, where: str = "true") -> DataFrame:
    return v.table("embeddings").where(where).select(F.col("vec_id").alias("id"), F.col("embedding").alias("vector"))


@query(_dense_sql("a.vec_id % 100 = 0"))
def dense_topk(v: Views) -> DataFrame:
    return R.dense_topk(_vectors(v), _vectors(v, "vec_id % 100 = 0"))


@query(_dense_sql("a.vec_id % 100 = 0", "b.label = 3"))
def dense_topk_scoped(v: Views) -> DataFrame:
    return R.dense_topk(_vectors(v, "label = 3"), _vectors(v, "vec_id % 100 = 0"))


def _dense_index(v: Views) -> dense_index.DenseIndex:
    return dense_index.build_dense_index(_vectors(v), shared_path(v.spark, "dense-index"))


@query(_dense_sql("a.vec_id % 100 = 0"))
def dense_index_whole(v: Views) -> DataFrame:
    """By the index, all of its lists probed: exact."""
    index = _dense_index(v)
    return index.search(_vectors(v, "vec_id % 100 = 0"), probes=len(index.centroids))


@query("SELECT count(*) AS queries, true AS enough FROM embeddings WHERE vec_id % 100 = 0")
def dense_index_recall(v: Views) -> DataFrame:
    """By the index, as many lists probed as a sample needs for 0.95: whether at least 0.9 of the exact first thirty is found."""
    index, q = _dense_index(v), _vectors(v, "vec_id % 100 = 0")
    each = dense_index.recall(index.search(q, probes=dense_index.probes_for(index, _vectors(v))), R.dense_topk(_vectors(v), q))
    return each.agg(F.count("*").alias("queries"), (F.avg("recall") >= 0.9).alias("enough"))


def _dense_asked(v: Views) -> DataFrame:
    e = v.table("embeddings").select(F.col("vec_id"), F.col("embedding").alias("vector"))
    q = v.table("benchmark").select(F.col("item_id").alias("id"), (F.col("item_id") * 10).alias("vec_id")).join(e, "vec_id").select("id", "vector")
    return R.dense_topk(_vectors(v), q)


_HYBRID = _BM25 + f""", dense AS ({_dense_sql("a.vec_id % 10 = 0 AND a.vec_id // 10 IN (SELECT item_id FROM benchmark)", qid="a.vec_id // 10")}),
f AS (SELECT coalesce(d.query_id, s.query_id) AS query_id, coalesce(d.id, s.id) AS id, d.rank AS dense_rank, s.rank AS sparse_rank, round(coalesce(1.0 / (60 + d.rank), 0.0) + coalesce(1.0 / (60 + s.rank), 0.0), 9) AS rrf FROM dense d FULL JOIN sparse s ON d.query_id = s.query_id AND d.id = s.id),
fused AS (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, id) AS INT) AS rank FROM f)"""


def _fused(v: Views) -> DataFrame:
    return R.rrf(_dense_asked(v), _index(v).search(_asked(v)))


@query(f"{_HYBRID} SELECT query_id, id, dense_rank, sparse_rank, rrf FROM fused")
def rrf_fusion(v: Views) -> DataFrame:
    return _fused(v).select("query_id", "id", "dense_rank", "sparse_rank", "rrf")


@query(f"{_HYBRID} SELECT query_id, id, rrf, rank FROM fused WHERE rank <= 30")
def hybrid_search(v: Views) -> DataFrame:
    return _fused(v).where("rank <= 30").select("query_id", "id", "rrf", "rank")


_SEARCH = """, a AS (SELECT id, CAST('Code ' || chr(64 + CAST(id AS INT)) || ' Act, ' || (1800 + 7 * id) AS VARCHAR) AS title, slug FROM (SELECT row_number() OVER (ORDER BY slug) AS id, slug FROM (SELECT DISTINCT source AS slug FROM documents))),
hit AS (SELECT query_id, rrf, d.doc_id AS section_id, title || ', s. ' || CAST(d.doc_id // 2 + 1 AS VARCHAR) || CASE WHEN d.doc_id % 2 = 0 THEN '' WHEN (d.doc_id // 2) % 2 = 0 THEN 'A' ELSE '-A' END AS citation, trim(regexp_replace(d.text, '\\s+', ' ', 'g')) AS t,
  row_number() OVER (PARTITION BY query_id ORDER BY rrf DESC, d.doc_id) AS rn FROM fused JOIN documents d ON d.doc_id = fused.id JOIN a ON a.slug = d.source LEFT JOIN labels l ON l.doc_id = d.doc_id WHERE coalesce(l.quality, 1) <> 0)"""


_HITS = "SELECT query_id, section_id, citation, rrf, CAST(rn AS INT) AS rank, CASE WHEN length(t) <= 320 THEN t ELSE regexp_replace(left(t, 320), ' [^ ]*$', '') || '…' END AS snippet FROM hit WHERE rn <= 10"


@query(f"{_HYBRID}{_SEARCH} {_HITS}")
def search_corpus(v: Views) -> DataFrame:
    return R.search_hits(_fused(v), v.sections, v.statutes)


@query(f"{_HYBRID}{_SEARCH.replace('WHERE coalesce(l.quality, 1) <> 0', '')} {_HITS}")
def search_corpus_omitted(v: Views) -> DataFrame:
    """Omitted sections are found too."""
    return R.search_hits(_fused(v), v.sections, v.statutes, include_omitted=True)


@query(_BM25.split(", sparse AS")[0].rstrip(", \n") + " SELECT query_id, id, score, rank FROM (SELECT query_id, bm.id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, bm.id) AS INT) AS rank FROM bm JOIN documents d ON d.doc_id = bm.id WHERE d.source = 'src3') WHERE rank <= 30")
def sparse_topk_scoped(v: Views) -> DataFrame:
    """Of one act, which is chosen before the cut."""
    scope = v.table("documents").where("source = 'src3'").select(F.col("doc_id").alias("id"))
    return _index(v).search(_asked(v), scope=scope).select("query_id", "id", "score", "rank")


_SCORED = _HYBRID + """, n AS (SELECT query_id, count(*) AS n FROM asked GROUP BY 1), cov AS (SELECT fused.query_id, fused.id, rank, round(coalesce(matched, 0) / n, 6) AS score FROM fused JOIN n USING (query_id) LEFT JOIN bm ON bm.query_id = fused.query_id AND bm.id = fused.id WHERE rank <= 30),
top AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, rank) AS r FROM cov)"""


def _coverage(v: Views) -> DataFrame:
    """The default pair scorer over the first candidates of the fused order: share of a question's distinct terms that the passage holds."""
    pairs = _fused(v).where(F.col("rank") <= R.TOP_K).select("query_id", "id", F.col("rank").alias("fused_rank"))
    return _index(v).coverage(pairs, _asked(v))


@query(f"{_SCORED} SELECT query_id, id, score, CAST(r AS INT) AS rank FROM top WHERE r <= 6")
def rerank_topn(v: Views) -> DataFrame:
    return R.top_k(_coverage(v), ["query_id"], [F.col("score").desc(), F.col("fused_rank")], R.TOP_N).drop("fused_rank")


@query(f"""{_SCORED} SELECT b.item_id AS query_id, coalesce(count(*) FILTER (WHERE r <= 6 AND score >= 0.6), 0) > 0 AS passed, count(*) FILTER (WHERE r <= 6 AND score >= 0.6) AS n_kept, max(score) AS top_score,
  CASE WHEN max(score) IS NULL THEN 'no_candidates' WHEN count(*) FILTER (WHERE r <= 6 AND score >= 0.6) = 0 THEN 'below_score_floor' END AS reason FROM benchmark b LEFT JOIN top ON top.query_id = b.item_id GROUP BY 1""")
def abstention_gate(v: Views) -> DataFrame:
    return R.gate(_coverage(v), _asked(v))


@query("SELECT case_id, section_id, max(greatest(score, 0)) AS best FROM scored GROUP BY 1, 2", "scored")
def best_section_score(v: Views) -> DataFrame:
    return v.scored.groupBy("case_id", "section_id").agg(F.max(F.greatest("score", F.lit(0.0))).alias("best"))


@query("SELECT case_id, section_id, line, score FROM (SELECT *, row_number() OVER (PARTITION BY case_id, section_id ORDER BY score DESC, line) AS rn FROM scored) WHERE rn = 1", "scored")
def best_chunk_per_section(v: Views) -> DataFrame:
    return R.top_k(v.scored, ["case_id", "section_id"], [F.col("score").desc(), F.col("line")], 1).select("case_id", "section_id", "line", "score")


_BLOCKS = """WITH RECURSIVE kept AS (SELECT item_id AS query_id, item_id * 3 + k AS section_id FROM benchmark, (VALUES (0), (1), (2)) t(k)),
hop AS (SELECT DISTINCT query_id, to_section_id AS section_id FROM kept JOIN links ON from_section_id = section_id WHERE NOT EXISTS (SELECT 1 FROM kept k2 WHERE k2.query_id = kept.query_id AND k2.section_id = to_section_id)),
al AS (SELECT query_id, section_id, 'retrieved' AS origin, (section_id * 7 % 10) / 10.0 AS score FROM kept UNION ALL SELECT query_id, section_id, 'cross_reference', NULL FROM hop),
bl AS (SELECT al.*, a.short_title AS title, lpad(regexp_extract(section_no, '^[0-9]+'), 6, '0') || '|' || CASE WHEN section_no LIKE '%A' THEN 'A   |' ELSE '' END AS sort, greatest(1, length(text_verbatim) // 4) AS tokens FROM al JOIN sections s ON s.id = al.section_id JOIN statutes a ON a.id = s.statute_id),
o AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY origin <> 'retrieved', coalesce(score, 0) DESC, title, sort, section_id) AS rn FROM bl),
walk(query_id, rn, used, fits, section_id, title, sort, tokens) AS (SELECT query_id, rn, tokens, true, section_id, title, sort, tokens FROM o WHERE rn = 1
  UNION ALL SELECT o.query_id, o.rn, CASE WHEN walk.used + o.tokens <= 12000 THEN walk.used + o.tokens ELSE walk.used END, walk.used + o.tokens <= 12000, o.section_id, o.title, o.sort, o.tokens FROM walk JOIN o ON o.query_id = walk.query_id AND o.rn = walk.rn + 1)"""


def _packed(v: Views) -> DataFrame:
    kept = v.table("benchmark").select(F.col("item_id").alias("query_id"), F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("k")).select("query_id", (F.col("query_id") * 3 + F.col("k")).alias("section_id"))
    rows = kept.select("query_id", "section_id", F.lit("retrieved").alias("origin"), ((F.col("section_id") * 7 % 10) / 10.0).alias("score")).unionByName(graph.expand_one_hop(kept, v.links).select("query_id", "section_id", F.lit("cross_reference").alias("origin"), F.lit(None).cast("double").alias("score")))
    s = v.sections.select(F.col("id").alias("section_id"), "statute_id", T.section_no_sort(F.col("section_no")).alias("sort"), T.estimate_tokens(F.col("text_verbatim")).alias("tokens"))
    a = v.statutes.select(F.col("id").alias("statute_id"), F.col("short_title").alias("title"))
    return R.pack(rows.join(s, "section_id").join(a, "statute_id"), 12_000)


_WITH_LINKS = ("sections", "links")


@query(f"{_BLOCKS} SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY title, sort, section_id) - 1 AS INT) AS pos, section_id, CAST(tokens AS BIGINT) AS tokens FROM walk WHERE fits", *_WITH_LINKS)
def pack_context(v: Views) -> DataFrame:
    return _packed(v).select("query_id", "pos", "section_id", "tokens")


@query(f"{_BLOCKS} SELECT query_id, count(*) FILTER (WHERE fits) AS kept, count(*) FILTER (WHERE NOT fits) AS dropped, CAST(sum(tokens) FILTER (WHERE fits) AS BIGINT) AS used, sum(tokens) FILTER (WHERE fits) > 12000 AS over_budget FROM walk GROUP BY 1", *_WITH_LINKS)
def pack_totals(v: Views) -> DataFrame:
    g = _packed(v).groupBy("query_id").agg(F.count("*").alias("kept"), F.max("offered").alias("o"), F.sum("tokens").alias("used"))
    return g.select("query_id", "kept", (F.col("o") - F.col("kept")).alias("dropped"), "used", (F.col("used") > 12_000).alias("over_budget"))


def _headed(v: Views) -> DataFrame:
    a = v.statutes.select(F.col("id").alias("statute_id"), "short_title")
    return v.sections.where(~F.col("is_omitted")).join(a, "statute_id").select("id", T.heading_prefix(F.col("short_title"), F.col("marginal_note")).alias("heading"), F.col("text_verbatim").alias("text"))


_WORDS = "len([x FOR x IN string_split_regex({}, '\\s+') IF x <> ''])"
_HEAD = "'passage: ' || short_title || CASE WHEN regexp_replace(marginal_note, '\\.+$', '') <> '' THEN ' — ' || regexp_replace(marginal_note, '\\.+$', '') ELSE '' END || '. '"
_SIZES = f"WITH z AS (SELECT s.id, text_verbatim AS text, {_WORDS.format(_HEAD)} AS h, {_WORDS.format('text_verbatim')} AS n FROM sections s JOIN statutes a ON a.id = s.statute_id WHERE NOT is_omitted)"


@query(f"{_SIZES} SELECT id, regexp_replace(text, '^\\s+|\\s+$', '', 'g') AS text, CAST(h + n AS INT) AS token_count FROM z WHERE h + n <= 450 AND n > 0", "sections")
def chunk_single(v: Views) -> DataFrame:
    one = _chunk(_headed(v)).groupBy("id").agg(F.count("*").alias("n"), F.first("text").alias("text"), F.first("token_count").alias("token_count"))
    return one.where("n = 1 AND token_count <= 450").select("id", "text", "token_count")


@query(f"{_SIZES} SELECT id, CAST(n AS BIGINT) AS words, true AS within FROM z WHERE n > 0", "sections")
def chunk_all(v: Views) -> DataFrame:
    """Words of each section's chunks together, and whether each keeps to the ceiling: nothing is lost or too long."""
    g = _chunk(_headed(v)).groupBy("id").agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.max("token_count").alias("most"))
    return g.select("id", "words", (F.col("most") <= 450).alias("within"))


@query(f"{_SIZES} SELECT count(*) AS sections, count(*) FILTER (WHERE h + n > 450) AS split_sections, true AS as_many, true AS within FROM z WHERE n > 0", "sections")
def chunk_report(v: Views) -> DataFrame:
    """Sections and split ones; whether there are more chunks than sections by those split at least, and whether the largest chunk keeps to the ceiling."""
    r = chunk_report_of(_chunk(_headed(v)))
    return r.select("sections", "split_sections", (F.col("chunks") >= F.col("sections") + F.col("split_sections")).alias("as_many"), (F.col("max_tokens") <= 450).alias("within"))


_PLAIN = f"""WITH z AS (SELECT s.id, string_split(trim(regexp_replace(replace(text_verbatim, 'Provided', 'provided'), '[.;:\\s]+', ' ', 'g')), ' ') AS w, {_WORDS.format(_HEAD)} AS h FROM sections s JOIN statutes a ON a.id = s.statute_id WHERE NOT is_omitted),
y AS (SELECT id, w, h, 450 - h AS room FROM z WHERE len(w) > 0 AND w[1] <> ''),
k AS (SELECT id, h, CAST(k AS INT) AS chunk_idx, w[k * room + 1:(k + 1) * room] AS part FROM (SELECT *, unnest(range(0, CAST(ceil(len(w) / room) AS BIGINT))) AS k FROM y))"""


def _plain_texts(v: Views) -> DataFrame:
    """Texts without marks or lines, so that only their words can be cut."""
    plain = F.trim(F.regexp_replace(F.replace("text", F.lit("Provided"), F.lit("provided")), r"[.;:\s]+", " "))
    return _headed(v).withColumn("text", plain)


def _plain_chunks(v: Views) -> DataFrame:
    return _chunk(_plain_texts(v))


@query(f"{_PLAIN} SELECT id, chunk_idx, md5(array_to_string(part, ' ')) AS text, CAST(h + len(part) AS INT) AS token_count FROM k", "sections")
def chunk_plain(v: Views) -> DataFrame:
    return _plain_chunks(v).withColumn("text", F.md5(F.col("text").cast("binary")))


@query(f"{_PLAIN} SELECT id, chunk_idx, md5(array_to_string(part, ' ')) AS text, CAST(h + len(part) AS INT) AS token_count FROM k", "sections")
def chunk_lateral(v: Views) -> DataFrame:
    """The same chunks by the table function, in SQL."""
    register_chunker(v.spark)
    _plain_texts(v).createOrReplaceTempView("plain_sections")
    return v.spark.sql("SELECT id, c.chunk_idx, md5(CAST(c.chunk AS BINARY)) AS text, c.token_count FROM plain_sections, LATERAL split_section(heading, text) AS c")


@query(f"{_PLAIN} SELECT count(DISTINCT id) AS sections, count(*) AS chunks, count(DISTINCT id) FILTER (WHERE chunk_idx > 0) AS split_sections, CAST(max(h + len(part)) AS INT) AS max_tokens FROM k", "sections")
def chunk_counts(v: Views) -> DataFrame:
    return chunk_report_of(_plain_chunks(v))
