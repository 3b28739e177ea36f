"""Importance resampling towards a target text: hashed word features, array-scored weights, a bisected cutoff.

1. Tasks count the hashed features of their texts into one array each; sums over tasks
   are the corpus's and the target's bucket counts, and from them a gain for each bucket.
2. A second pass looks up the gains of a text's features in the array and averages them.
   Rows and their scores are written to a table.
3. The cutoff is found by count jobs over that table alone: first of the score, then of
   the id among rows of that score, then of the row's number among rows of that id.
4. Rows beyond the cutoff are range-partitioned by rank; what stands before a partition
   is added to each row's place in it.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import crc
from .common import checkpoint, ship, slices, text_buffer
from .wordhash import NOT_ALNUM, words

BUCKETS = 10_000
#: Thresholds that one count job tries.
_TRIED = 16


def _features(data: np.ndarray, offsets: np.ndarray, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bucket, text) of each feature, and the words of each text: single words and pairs of neighbours."""
    w = words(data, offsets, NOT_ALNUM)
    one = crc.spans(w.data, w.start, w.end)
    first = np.flatnonzero(w.doc[1:] == w.doc[:-1])
    two = crc.pairs(w.data, w.start, w.end, one, first)
    return np.concatenate([one, two]).astype(np.int64) % buckets, np.concatenate([w.doc, w.doc[first]]), np.diff(w.first)


def bucket_counts(texts: DataFrame, text_col: str, buckets: int) -> np.ndarray:
    """How often each bucket occurs in all texts. Each task sends one row for each bucket that it has met."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets):
                total += np.bincount(_features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], buckets)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    rows = texts.select(F.col(text_col).cast("string").alias("text")).mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))
    out = np.zeros(buckets, np.int64)
    for bucket, n in rows.collect():  # at most `buckets` rows
        out[bucket] = n
    return out


def gains(corpus: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(1000 ln) of each bucket's share in the target over that in the corpus, with one added to every count."""
    s_all, t_all, k = int(corpus.sum()), int(target.sum()), len(corpus)
    return np.array([math.floor(1000 * math.log(float(t + 1) * float(s_all + k) / (float(s + 1) * float(t_all + k)))) for s, t in zip(corpus.tolist(), target.tolist(), strict=True)], np.int64)


def _weigher(gain: np.ndarray) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            raw, offsets = text_buffer(batch.column("text"))
            for i, j in slices(offsets):
                bucket, doc, n_words = _features(raw[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i], len(gain))
                n = np.maximum(2 * n_words - 1, 0)
                # Sums of whole numbers below 2^53, so exact as doubles.
                total = np.bincount(doc, weights=gain[bucket], minlength=j - i).astype(np.int64)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(i, j - i), *(pa.array(x.astype(np.int64)) for x in (n_words, n, total // np.maximum(n, 1)))], ["doc_id", "n_words", "n_features", "weight"])

    return weigh


def scored_table(documents: DataFrame, target: DataFrame, path: str, *, seed: int = 7, buckets: int = BUCKETS, id_col: str = "doc_id", text_col: str = "text", target_text_col: str = "text") -> DataFrame:
    """Writes (row, doc_id, n_words, n_features, weight, score) of each row of `documents` to `path`, and reads it.

    score is weight plus Gumbel noise from the first 8 hex digits of sha256(`seed:id`), so
    that drawing the highest scores draws in proportion to exp(weight / 1000), without
    putting back. A null id counts as an empty one there. `row` tells equal rows apart.
    """
    spark = documents.sparkSession
    ship(spark)
    gain = gains(bucket_counts(documents, text_col, buckets), bucket_counts(target, target_text_col, buckets))
    rows = documents.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    rows = rows.mapInArrow(_weigher(gain), "doc_id long, n_words long, n_features long, weight long")
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))).cast("binary"), 256), 1, 8), 16, 10).cast("long")
    noise = F.floor(F.lit(-1000.0) * F.log(-F.log((h.cast("double") + 0.5) / F.lit(4294967296.0))))
    rows.select(F.monotonically_increasing_id().alias("row"), "*", (F.col("weight") + noise).alias("score")).write.parquet(path)
    return spark.read.parquet(path)


def nth_least(rows: DataFrame, column: str, n: int) -> tuple[int, int]:
    """(the n-th least value of a whole-number column, how many rows are below it), by count jobs that each try several thresholds. 1 <= n <= rows."""
    low, high = rows.agg(F.min(column), F.max(column)).first()
    while low < high:
        tried = sorted({low + (high - low) * i // _TRIED for i in range(_TRIED)})
        upto = rows.agg(*(F.count_if(F.col(column) <= F.lit(t)).alias(f"t{i}") for i, t in enumerate(tried))).first()
        enough = [t for t, c in zip(tried, upto, strict=True) if c >= n]
        short = [t for t, c in zip(tried, upto, strict=True) if c < n]
        low, high = (max(short) + 1 if short else low), (min(enough) if enough else high)
    return low, rows.where(F.col(column) < F.lit(low)).count()


def _cutoff(rows: DataFrame, keys: list[str], n: int) -> Column:
    """Whether a row is among the n least by `keys`, which tell all rows apart."""
    first, *rest = keys
    value, below = nth_least(rows, first, n)
    if not rest:
        return F.col(first) <= F.lit(value)
    same = rows.where(F.col(first) == F.lit(value))
    if same.count() <= n - below:
        return F.col(first) <= F.lit(value)
    return (F.col(first) < F.lit(value)) | ((F.col(first) == F.lit(value)) & _cutoff(same, rest, n - below))


def ranked(rows: DataFrame, keys: list[str], partitions: int) -> DataFrame:
    """`rows` with `rank`, 1, 2, 3... in the order of `keys`: sorted in ranges, each row's place there and what the ranges before it hold."""
    place = (1 << 33) - 1
    rows = checkpoint(rows.repartitionByRange(partitions, *keys).sortWithinPartitions(*keys).withColumn("place", F.monotonically_increasing_id()))
    part = F.shiftright("place", 33)
    sizes = rows.groupBy(part.alias("part")).agg(F.count("*").alias("n"))  # a row for each partition
    before = sizes.select("part", F.coalesce(F.sum("n").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    rows = rows.withColumn("part", part).join(F.broadcast(before), "part")
    return rows.withColumn("rank", F.col("before") + F.col("place").bitwiseAND(F.lit(place)) + 1).drop("part", "before", "place")


def resample(scored: DataFrame, *, percent: int = 25, least_words: int = 20, partitions: int | None = None) -> DataFrame:
    """Each row of a `scored_table` with its rank, null if it isn't drawn: doc_id, n_features, weight, score, rank.

    Of the N rows with at least `least_words` words, floor(percent * N / 100) are drawn:
    the highest scores, ties to the smaller id (null ids last), repeated ids by their
    place in the table. Nothing is drawn from an empty table, or where the share is
    below one row.
    """
    spark: SparkSession = scored.sparkSession
    fit = F.col("n_words") >= least_words
    keyed = scored.withColumns({"k1": -F.col("score"), "k2": F.coalesce("doc_id", F.lit((1 << 63) - 1))})
    n = scored.where(fit).count() * percent // 100
    columns = ["doc_id", "n_features", "weight", "score"]
    if n == 0:
        return scored.select(*columns, F.lit(None).cast("long").alias("rank"))
    keys = ["k1", "k2", "row"]
    drawn = fit & _cutoff(keyed.where(fit), keys, n)
    partitions = partitions or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return ranked(keyed.where(drawn), keys, partitions).select(*columns, "rank").unionByName(keyed.where(~drawn).select(*columns, F.lit(None).cast("long").alias("rank")))


#: Each row of `documents` drawn towards `benchmark`, with CRC-32 worked out byte by byte from its table.
SQL = r"""WITH tab AS (SELECT list(list_reduce([i, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, x: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS tab FROM range(256) AS t(i)),
split AS (SELECT 'd' AS side, row_number() OVER () AS row, doc_id, text FROM documents UNION ALL SELECT 'b', 0, item_id, text FROM benchmark),
worded AS (SELECT side, row, doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '') AS w FROM split),
feature AS (SELECT side, row, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) AS f FROM worded),
hexed AS (SELECT f, hex(f) AS h FROM (SELECT DISTINCT f FROM feature)),
coded AS (SELECT f, xor(list_reduce([4294967295] || list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT)), lambda c, b: xor(c >> 8, tab[xor(c, b) % 256 + 1])), 4294967295) % 10000 AS bucket FROM hexed, tab),
met AS (SELECT side, row, bucket, count(*) AS c FROM feature JOIN coded USING (f) GROUP BY 1, 2, 3),
n AS (SELECT bucket, coalesce(sum(c) FILTER (WHERE side = 'd'), 0) AS s, coalesce(sum(c) FILTER (WHERE side = 'b'), 0) AS t FROM met GROUP BY 1),
al AS (SELECT sum(s) AS sa, sum(t) AS ta FROM n),
gain AS (SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(sa + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(ta + 10000 AS DOUBLE)))) AS BIGINT) AS g FROM n, al),
weighed AS (SELECT row, sum(c) AS nf, CAST(floor(CAST(sum(c * g) AS DOUBLE) / sum(c)) AS BIGINT) AS weight FROM met JOIN gain USING (bucket) WHERE side = 'd' GROUP BY 1),
scored AS (SELECT d.row, d.doc_id, len(d.w) AS words, CAST(coalesce(nf, 0) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('7:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM worded d LEFT JOIN weighed w ON w.row = d.row WHERE d.side = 'd'),
placed AS (SELECT *, words >= 20 AS fit, row_number() OVER (PARTITION BY words >= 20 ORDER BY score DESC, doc_id) AS place, count(*) FILTER (WHERE words >= 20) OVER () AS fitting FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN fit AND place <= fitting * 25 // 100 THEN place END AS rank FROM placed"""
