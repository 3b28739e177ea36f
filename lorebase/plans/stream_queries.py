"""Streams and their batch twins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..functions import text as T
from ..sources.views import Views
from ..streaming import stateful
from ..streaming import streams as S
from ..streaming.incremental import IncrementalIndex
from .registry import query

_GUARD = """WITH t AS (SELECT answer_id, CAST(s - 1 AS BIGINT) AS seq, substring(text, CAST((s - 1) * 6 + 1 AS BIGINT), 6) AS delta, allowed, text FROM answers, LATERAL (SELECT unnest(range(1, CAST(ceil(length(text) / 6.0) AS BIGINT) + 1)) AS s)),
b AS (SELECT *, string_agg(delta, '') OVER (PARTITION BY answer_id ORDER BY seq) AS sofar FROM t),
c AS (SELECT *, len([x FOR x IN flatten([regexp_extract_all(y, '\\bS([0-9]{1,12})\\b', 1) FOR y IN regexp_extract_all(sofar, '\\[([^\\[\\]]*)\\]', 1)]) IF NOT list_contains(allowed, CAST(x AS BIGINT))]) > 0 AS bad FROM b),
m AS (SELECT *, min(CASE WHEN bad THEN seq END) OVER (PARTITION BY answer_id) AS trip FROM c)
SELECT answer_id, seq, CASE WHEN seq = trip THEN 'invalidated' ELSE 'token' END AS name, CASE WHEN seq = trip THEN '' ELSE delta END AS text FROM m WHERE trip IS NULL OR seq <= trip"""


@query(_GUARD, "answers")
def stream_guard_batch(v: Views) -> DataFrame:
    t = S.token_stream(v.answers)
    # The text is put together once; its first bad citation ends at a character, and so in a token.
    whole = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("seq", "delta"))), lambda x: x["delta"]), "")
    a = t.groupBy("answer_id").agg(whole.alias("text"), F.first("allowed").alias("allowed"))
    closed = F.regexp_extract_all("text", F.lit(r"\[[^\[\]]*\]"), F.lit(0))
    pieces = F.arrays_zip(F.transform(F.slice(F.split("text", r"\[[^\[\]]*\]"), 1, F.size(closed)), F.char_length).alias("before"), closed.alias("cited"))
    start = F.struct(F.lit(0).alias("at"), F.lit(None).cast("int").alias("bad"))

    def step(acc, x):
        at = acc["at"] + x["before"] + F.char_length(x["cited"])
        wrong = F.size(F.array_except(T.cited_ids(x["cited"]), F.col("allowed"))) > 0
        return F.struct(at.alias("at"), F.coalesce(acc["bad"], F.when(wrong, at)).alias("bad"))

    a = a.select("answer_id", F.aggregate(pieces, start, step)["bad"].alias("bad"))
    end = F.sum(F.char_length("delta")).over(W.partitionBy("answer_id").orderBy("seq"))
    t = t.withColumn("end", end).withColumn("begin", F.col("end") - F.char_length("delta")).join(a, "answer_id").where("bad IS NULL OR begin < bad")
    hit = F.coalesce(F.col("end") >= F.col("bad"), F.lit(False))
    return t.select("answer_id", "seq", F.when(hit, "invalidated").otherwise("token").alias("name"), F.when(hit, "").otherwise(F.col("delta")).alias("text"))


@query(_GUARD, "answers")
def stream_citation_guard(v: Views) -> DataFrame:
    live = Views(v.spark, v.sf_dir)
    live.table = lambda name: S.read_stream(v.spark, f"{v.sf_dir}/{name}.parquet")  # type: ignore[method-assign]
    path = S.shared_path(v.spark, "guard")
    S.run_to_end(S.citation_guard(S.token_stream(live.answers)), S.write_batch(path), "append")
    return v.spark.read.parquet(path).drop("batch")


@query("SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY 1, 2")
def stream_tumbling_counts(v: Views) -> DataFrame:
    path = S.shared_path(v.spark, "counts")
    stream = S.tumbling_counts(S.read_stream(v.spark, f"{v.sf_dir}/events.parquet"), "user_id", "ts", "1 hour")
    S.run_to_end(stream, S.write_batch(path))
    return v.spark.read.parquet(path).groupBy("window_start", "user_id").agg(F.max_by("n", "batch").alias("n"))


@query("SELECT date_trunc('hour', ts) AS window_start, user_id, count(*) AS n FROM events GROUP BY 1, 2 HAVING count(*) > 2")
def tumbling_over_limit(v: Views) -> DataFrame:
    g = v.table("events").groupBy(F.window("ts", "1 hour").alias("w"), "user_id").agg(F.count("*").alias("n")).where("n > 2")
    return g.select(F.col("w.start").alias("window_start"), "user_id", "n")


_LIMIT = """WITH r AS (SELECT event_id, user_id, ts, row_number() OVER (PARTITION BY user_id, date_trunc('hour', ts) ORDER BY ts, event_id) AS n FROM events)
SELECT event_id, CAST(n AS INT) AS ordinal, n <= 2 AS allowed, CAST(greatest(0, 2 - n) AS INT) AS remaining, CAST(3600 - CAST(floor(epoch(ts)) AS BIGINT) % 3600 AS BIGINT) AS reset_after FROM r"""


@query(_LIMIT)
def fixed_window_limit(v: Views) -> DataFrame:
    at = F.unix_timestamp("ts")
    w = W.partitionBy("user_id", F.floor(at / 3600)).orderBy("ts", "event_id")
    n = F.row_number().over(w)
    return v.table("events").select("event_id", n.alias("ordinal"), (n <= 2).alias("allowed"), F.greatest(F.lit(0), 2 - n).alias("remaining"), (3600 - at % 3600).alias("reset_after"))


@query(_LIMIT)
def stream_limiter(v: Views) -> DataFrame:
    """The same decisions from a stream."""
    path = S.shared_path(v.spark, "limiter")
    with stateful.rocksdb(v.spark):
        S.run_to_end(stateful.limited(S.read_stream(v.spark, f"{v.sf_dir}/events.parquet"), 2), S.write_batch(path), "append")
    return v.spark.read.parquet(path).select("event_id", "ordinal", "allowed", "remaining", "reset_after")


@query(_GUARD, "answers")
def stream_guard_by_number(v: Views) -> DataFrame:
    """The guard that takes tokens in any order."""
    live = Views(v.spark, v.sf_dir)
    live.table = lambda name: S.read_stream(v.spark, f"{v.sf_dir}/{name}.parquet")  # type: ignore[method-assign]
    path = S.shared_path(v.spark, "guard")
    with stateful.rocksdb(v.spark):
        S.run_to_end(stateful.guarded(S.token_stream(live.answers)), S.write_batch(path), "append")
    return v.spark.read.parquet(path).drop("batch")


@query("SELECT CAST(ts AS DATE) AS day, count(*) AS asked, count(*) FILTER (WHERE event_type = 'click') AS answered, count(*) FILTER (WHERE event_type = 'error') AS abstained FROM events GROUP BY 1")
def ask_log_daily(v: Views) -> DataFrame:
    t = F.col("event_type")
    return v.table("events").groupBy(F.to_date("ts").alias("day")).agg(F.count("*").alias("asked"), F.count_if(t == "click").alias("answered"), F.count_if(t == "error").alias("abstained"))


@query("""WITH e AS (SELECT event_id, user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT event_id, prev, event_type FROM e WHERE prev IS NOT NULL AND NOT ((prev = 'view' AND event_type IN ('click', 'view')) OR (prev = 'click' AND event_type IN ('purchase', 'error')) OR (prev = 'signup' AND event_type = 'view') OR (prev IN ('error', 'purchase')))""")
def event_order_violations(v: Views) -> DataFrame:
    steps = {"view": ("click", "view"), "click": ("purchase", "error"), "signup": ("view",), "error": ("view", "click", "signup", "error", "purchase"), "purchase": ("view", "click", "signup", "error", "purchase")}
    allowed = v.spark.createDataFrame([(a, b) for a, to in steps.items() for b in to], "prev string, event_type string")
    e = v.table("events").withColumn("prev", F.lag("event_type").over(W.partitionBy("user_id").orderBy("ts", "event_id"))).where("prev IS NOT NULL")
    return e.join(F.broadcast(allowed), ["prev", "event_type"], "left_anti").select("event_id", "prev", "event_type")


@query("""WITH c AS (SELECT answer_id, list_distinct([CAST(x AS BIGINT) FOR x IN flatten([regexp_extract_all(y, '\\bS([0-9]{1,12})\\b', 1) FOR y IN regexp_extract_all(text, '\\[([^\\[\\]]*)\\]', 1)])]) AS cited, allowed FROM answers),
r AS (SELECT answer_id // 2 AS question_id, answer_id % 2 + 1 AS attempt, CASE WHEN len([x FOR x IN cited IF NOT list_contains(allowed, x)]) > 0 THEN 'cited_sections_not_in_context' WHEN len(cited) = 0 THEN 'no_citations' END AS reason FROM c),
g AS (SELECT question_id, max(CASE WHEN attempt = 1 AND reason IS NULL THEN 1 ELSE 0 END) AS a, max(CASE WHEN attempt = 2 AND reason IS NULL THEN 1 ELSE 0 END) AS b, arg_max(reason, attempt) AS last FROM r GROUP BY 1)
SELECT question_id, a + b > 0 AS answered, CASE WHEN a = 1 THEN 1 WHEN b = 1 THEN 2 END AS attempt, CASE WHEN a + b = 0 THEN 'citation_' || last END AS reason FROM g""", "answers")
def answer_outcome(v: Views) -> DataFrame:
    cited = T.cited_ids(F.col("text"))
    reason = F.when(F.size(F.array_except(cited, F.col("allowed"))) > 0, "cited_sections_not_in_context").when(F.size(cited) == 0, "no_citations")
    r = v.answers.select(F.floor(F.col("answer_id") / 2).alias("question_id"), (F.col("answer_id") % 2 + 1).cast("int").alias("attempt"), reason.alias("reason"))
    g = r.groupBy("question_id").agg(F.min(F.when(F.col("reason").isNull(), F.col("attempt"))).alias("attempt"), F.max_by("reason", "attempt").alias("last"))
    return g.select("question_id", F.col("attempt").isNotNull().alias("answered"), "attempt", F.when(F.col("attempt").isNull(), F.concat(F.lit("citation_"), "last")).alias("reason"))


_REFERRING = """WITH n AS (SELECT least(1800, count(*)) AS n FROM documents),
t AS (SELECT s.id, s.text_verbatim || ' See section ' || o.section_no || ' of the ' || a.short_title || '.' AS text, o.id AS other FROM sections s, n JOIN sections o ON o.id = (s.id * 7 + 1) % n.n JOIN statutes a ON a.id = o.statute_id)"""


@query(f"""{_REFERRING} SELECT id, CAST(len([x FOR x IN string_split_regex(text, '\\s+') IF x <> '']) AS BIGINT) AS words, CASE WHEN other <> id THEN CAST(other AS VARCHAR) END AS linked, true AS embedded FROM t""", "sections")
def incremental_index(v: Views) -> DataFrame:
    """Each section's words in its chunks, where its references lead, and whether all chunks have vectors, of an index that two runs over different halves have filled; the second half is then sent again."""
    index = IncrementalIndex(v.spark, S.shared_path(v.spark, "index"), v.statutes)
    n = v.table("documents").count()
    other = v.sections.join(v.statutes.select(F.col("id").alias("statute_id"), "short_title"), "statute_id").select(F.col("id").alias("other"), F.concat_ws("", F.lit(" See section "), "section_no", F.lit(" of the "), "short_title", F.lit(".")).alias("more"))
    live = Views(v.spark, v.sf_dir)
    live.__dict__["statutes"] = v.statutes
    live.table = lambda name: S.read_stream(v.spark, f"{v.sf_dir}/{name}.parquet") if name == "documents" else v.table(name)  # type: ignore[method-assign]
    s = live.sections.withColumn("other", (F.col("id") * 7 + 1) % min(1800, n)).join(other, "other")
    s = s.select("id", "statute_id", "section_no", F.lit("passage: ").alias("heading"), F.concat("text_verbatim", "more").alias("text"))
    for run, half in (("even", 0), ("odd", 1), ("odd-again", 1)):
        index.follow(s.where(F.col("id") % 2 == half), run)
    chunks = index.table("chunks").join(index.table("vectors"), ["id", "chunk_idx"], "left")
    sizes = chunks.groupBy("id").agg(F.sum(T.word_count(F.col("text"))).alias("words"), F.bool_and(F.col("vector").isNotNull()).alias("embedded"))
    links = index.table("links").groupBy(F.col("from_section_id").alias("id")).agg(F.array_join(F.array_sort(F.collect_list("to_section_id")), ",").alias("linked"))
    return sizes.join(links, "id", "left").select("id", "words", "linked", "embedded")
