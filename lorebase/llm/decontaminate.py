"""Benchmark decontamination by winnowing, on DataFrame functions only.

Of each six neighbouring 5-word hashes the least one is kept, in documents and items
alike. Any ten words that both share hold six such hashes, so the same one is kept on
both sides and an equi-join on it finds the place; the ten-word windows around it are
then compared word by word. Items of fewer than ten words are one window each and are
looked up at every place of a document, by their own length.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, checkpoint

WINDOW = 10
K = 5
#: Of a 63-bit number, the lower bits for a place in the text; the hash has the others.
_PLACE = 27


def alnum_words(text: Column) -> Column:
    """Words of lower-cased text: runs of all but ASCII characters that are no digits or letters. Null has none."""
    return F.array_remove(F.split(ascii_lower(F.coalesce(text, F.lit(""))), r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"), "")


def _with_grams(df: DataFrame, k: int) -> DataFrame:
    """`g`: hash of the k words from each place of `h` on. Columns are made one by one: inside a lambda an expression would be computed anew for each element."""
    g = F.transform(F.sequence(F.lit(0), F.size("h") - k), lambda i: F.xxhash64(*(F.get("h", i + j) for j in range(k)))) if k > 1 else F.transform("h", lambda x: F.xxhash64(x))
    return df.withColumn("g", F.when(F.size("h") >= k, g).otherwise(F.array().cast("array<bigint>")))


def _anchors(df: DataFrame, keys: list[str], window: int, k: int) -> DataFrame:
    """A row for each winnowed place of `h`: fp (its hash), place, and near: the words of all windows that hold its k words.

    The first of equal hashes is kept. Where the text begins within that span, `from` is
    the number of words that the span lacks there.
    """
    side, span = window - k, window - k + 1
    mask = (1 << _PLACE) - 1
    df = _with_grams(df, k)
    df = df.select(*keys, "h", F.transform("g", lambda g, i: g.bitwiseAND(F.lit((1 << 63) - 1 - mask)).bitwiseOR(i.cast("long"))).alias("v"))
    least = F.transform(F.sequence(F.lit(0), F.size("v") - span), lambda i: F.least(*(F.get("v", i + j) for j in range(span))))
    # No filter here: it would be pushed below the columns that it reads, which would then be computed within it.
    df = df.select(*keys, "h", F.when(F.size("v") >= span, F.array_distinct(least)).otherwise(F.array().cast("array<bigint>")).alias("kept"))

    def anchor(x: Column) -> Column:
        place = x.bitwiseAND(F.lit(mask)).cast("int")
        lo = F.greatest(place - side, F.lit(0))
        return F.struct(F.shiftright(x, _PLACE).alias("fp"), place.alias("place"), (side - (place - lo)).alias("from"), F.slice("h", lo + 1, F.lit(window + side)).alias("near"))

    return df.select(*keys, F.explode(F.transform("kept", anchor)).alias("x")).select(*keys, "x.*")


def contamination(
    documents: DataFrame,
    benchmark: DataFrame,
    *,
    id_col: str = "doc_id",
    text_col: str = "text",
    item_col: str = "item_id",
    item_text_col: str = "text",
    window: int = WINDOW,
    k: int = K,
    broadcast_rows: int = 200_000,
    salts: int = 16,
) -> tuple[DataFrame, DataFrame]:
    """(documents' rows with their words counted, hits).

    The first has doc_id, text_hash, n_words for each row; the second has distinct
    (doc_id, text_hash, start, length, item_id): item windows of `length` words at word
    `start` of a document. Rows are told apart by id and text, so an id may repeat. Null
    and empty texts have no words; items without words have no windows; null item ids
    are kept. Other columns are ignored.

    The benchmark's fingerprints are broadcast if they are at most `broadcast_rows`
    (about 100 bytes each); beyond that both sides shuffle, the documents' salted, so
    that a passage that very many documents share is spread over tasks.
    """
    def hashed(df: DataFrame, key: Column, text: str) -> DataFrame:
        words = df.select(key, F.xxhash64(text).alias("text_hash"), alnum_words(F.col(text)).alias("words"))
        return words.select("id", "text_hash", F.transform("words", lambda w: F.xxhash64(w)).alias("h"), F.size("words").cast("long").alias("n_words"))

    docs = hashed(documents, F.col(id_col).alias("id"), text_col)
    items = checkpoint(hashed(benchmark, F.col(item_col).alias("id"), item_text_col).select(F.col("id").alias("item_id"), "h", F.col("n_words").alias("m")).where("m > 0").distinct())
    known = checkpoint(_anchors(items.where(F.col("m") >= window), ["item_id"], window, k).select("fp", "item_id", F.col("from").alias("item_from"), F.col("near").alias("item_near")).distinct())
    found = _meet(_anchors(docs, ["id", "text_hash"], window, k), known, ["fp"], broadcast_rows, salts)
    # Window o of the span holds the k words for o = 0 .. window - k; the lacking words shift it.
    side = window - k

    def same(o: Column) -> Column:
        inside = (o >= F.col("from")) & (o >= F.col("item_from"))
        a, b = F.slice("near", F.greatest(o - F.col("from"), F.lit(0)) + 1, window), F.slice("item_near", F.greatest(o - F.col("item_from"), F.lit(0)) + 1, window)
        return inside & (F.size(a) == window) & (a == b)

    at = F.filter(F.sequence(F.lit(0), F.lit(side)), same)
    long_hits = found.select("id", "text_hash", "item_id", F.explode(at).alias("o"), "place").select("id", "text_hash", (F.col("place") - side + F.col("o")).alias("start"), F.lit(window).alias("length"), "item_id")

    hits = long_hits
    short = items.where(F.col("m") < window)
    for (m,) in short.select("m").distinct().orderBy("m").collect():  # at most window - 1 lengths
        m = int(m)
        own = short.where(F.col("m") == m).select("item_id", F.xxhash64(*(F.get("h", F.lit(j)) for j in range(m))).alias("fp"), F.col("h").alias("item_near")).distinct()
        places = _with_grams(docs, m).select("id", "text_hash", F.posexplode(F.transform("g", lambda g, i: F.struct(g.alias("fp"), F.slice("h", i + 1, F.lit(m)).alias("near"))))).select("id", "text_hash", F.col("pos").alias("place"), "col.*")
        hits = hits.union(_meet(places, own, ["fp"], broadcast_rows, salts).where("near = item_near").select("id", "text_hash", F.col("place").alias("start"), F.lit(m).alias("length"), "item_id"))
    sizes = docs.select(F.col("id").alias("doc_id"), "text_hash", "n_words")
    return sizes, hits.withColumnRenamed("id", "doc_id").distinct()


def _meet(places: DataFrame, known: DataFrame, on: list[str], broadcast_rows: int, salts: int) -> DataFrame:
    if known.count() <= broadcast_rows:
        return places.join(F.broadcast(known), on)
    salted = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return places.withColumn("salt", F.pmod(F.xxhash64("id", "text_hash"), F.lit(salts)).cast("int")).join(salted, [*on, "salt"]).drop("salt")


def decontaminate(documents: DataFrame, benchmark: DataFrame, **options) -> DataFrame:
    """One row for each row of `documents`: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    n_hit counts the words inside any occurrence of an item's window, each once;
    items_sha256 is of the sorted, comma-joined ids (as text) of the n_items items that
    occur. See `contamination` for options and for null, empty and repeated input.
    """
    from pyspark.sql import Window as W

    sizes, hits = contamination(documents, benchmark, **options)
    hits = checkpoint(hits)
    # Words in the union of a document's windows: each window adds what lies beyond the furthest end before it.
    spans = hits.groupBy("doc_id", "text_hash", "start").agg(F.max(F.col("start") + F.col("length")).alias("end"))
    before = F.max("end").over(W.partitionBy("doc_id", "text_hash").orderBy("start").rowsBetween(W.unboundedPreceding, -1))
    covered = spans.select("doc_id", "text_hash", F.greatest(F.lit(0), F.col("end") - F.greatest("start", F.coalesce(before, F.lit(0)))).alias("fresh")).groupBy("doc_id", "text_hash").agg(F.sum("fresh").alias("n_hit"))
    ids = hits.groupBy("doc_id", "text_hash").agg(F.array_sort(F.collect_set(F.coalesce(F.col("item_id").cast("string"), F.lit("")))).alias("ids"))
    found = covered.join(ids, (covered.doc_id.eqNullSafe(ids.doc_id)) & (covered.text_hash == ids.text_hash)).select(covered.doc_id.alias("d"), covered.text_hash.alias("t"), "n_hit", "ids")
    out = sizes.join(found, sizes.doc_id.eqNullSafe(found.d) & (sizes.text_hash == found.t), "left")
    return out.select(
        "doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_items"),
        F.sha2(F.coalesce(F.array_join("ids", ","), F.lit("")).cast("binary"), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"),
    )
