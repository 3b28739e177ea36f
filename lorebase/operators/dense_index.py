"""A kept index of vectors: inverted lists by centroids, exact cosine scores within the lists that a query probes.

Centroids are fitted on a bounded sample; every row is assigned to the nearest one and
written into its list, in blocks. A search reads the partitions of the probed lists only.
Probing all lists gives exactly what `retrieval.dense_topk` gives, which stays the way
where nothing may be missed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.cluster import ship, staged
from .retrieval import TOP_K, dense_topk, top_k

_PAIRS = "query_id long, id long, score double"
#: Rows that a Python worker holds against all centroids at once.
_ROWS = 1024


def _parts(frames: Iterator[pd.DataFrame]) -> Iterator[tuple[pd.DataFrame, np.ndarray]]:
    """Few rows at a time, with their vectors of length one."""
    for df in frames:
        for at in range(0, len(df), _ROWS):
            part = df.iloc[at : at + _ROWS]
            yield part, _unit(np.vstack(part["vector"].to_numpy()))


def _unit(x: np.ndarray) -> np.ndarray:
    return x / np.maximum(np.linalg.norm(x, axis=1, keepdims=True), 1e-300)


def fit_centroids(vectors: DataFrame, lists: int, *, sample_rows: int = 20_000, rounds: int = 10) -> np.ndarray:
    """`lists` unit vectors (fewer, if there are fewer different rows) by k-means under cosine, on the `sample_rows` rows whose ids have the least hashes."""
    rows = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id"), "id").limit(sample_rows).select("vector").toPandas()["vector"]
    if not len(rows):
        return np.zeros((0, 0))
    x = _unit(np.vstack(rows.to_numpy()).astype(np.float64))
    distinct = np.sort(np.unique(x, axis=0, return_index=True)[1])
    c = x[distinct[:lists]]
    for _ in range(rounds):
        near = np.concatenate([np.argmax(x[i : i + 4096] @ c.T, axis=1) for i in range(0, len(x), 4096)])
        total = np.zeros_like(c)
        np.add.at(total, near, x)
        full = np.linalg.norm(total, axis=1) > 1e-12
        c = np.where(full[:, None], _unit(total), c)  # a list that lost all its rows keeps its place
    return c


def build_dense_index(vectors: DataFrame, path: str, *, lists: int | None = None, most_lists: int = 4096, sample_rows: int = 20_000, block_rows: int = 1024) -> DenseIndex:
    """Writes the index of `vectors` (id, vector) to `path` and opens it. All vectors have one length; null ones are left out.

    By default there are about as many lists as the root of the rows, at most `most_lists`,
    so that what tasks get of centroids is bounded. Every list is written in blocks of
    about `block_rows` rows by its own length, so that a long one is no single row.
    """
    spark = vectors.sparkSession
    ship(spark)
    whole = vectors.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector"))
    n = whole.count()
    c = fit_centroids(whole, lists or min(most_lists, max(1, round(n**0.5))), sample_rows=sample_rows)
    spark.createDataFrame([(i, [float(y) for y in v]) for i, v in enumerate(c)], "list int, centroid array<double>").coalesce(1).write.parquet(f"{path}/centroids")

    def assign(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part, x in _parts(frames):
            yield part.assign(list=np.argmax(x @ c.T, axis=1).astype(np.int32))

    placed = staged(whole.mapInPandas(assign, "id long, vector array<double>, list int"), "placed")
    sizes = placed.groupBy("list").agg(F.ceil(F.count("*") / block_rows).alias("blocks"))  # a row for each list
    block = F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int")
    rows = placed.join(F.broadcast(sizes), "list").groupBy("list", block.alias("block")).agg(F.collect_list(F.struct("id", "vector")).alias("x"))
    rows = rows.select("list", F.transform("x", lambda y: y["id"]).alias("ids"), F.flatten(F.transform("x", lambda y: y["vector"])).alias("vectors"))
    rows.write.partitionBy("list").parquet(f"{path}/lists")
    return open_dense_index(spark, path)


@dataclass
class DenseIndex:
    centroids: np.ndarray
    blocks: DataFrame

    def search(self, queries: DataFrame, k: int = TOP_K, probes: int = 8, query_block: int = 256) -> DataFrame:
        """(query_id, id, score, rank) of the k best rows of each query's `probes` nearest lists, scores by cosine. queries: id, vector.

        A query without a vector has no rows. Fewer than k come where the lists hold fewer.
        """
        ship(queries.sparkSession)
        c = self.centroids
        probes = min(probes, len(c))

        def nearest(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for part, x in _parts(frames if probes else iter(())):
                near = np.argsort(-(x @ c.T), axis=1, kind="stable")[:, :probes]
                yield part.assign(lists=list(near.astype(np.int32)))

        # Python gives a row for each query; the copies of its vector, one for each list, are made outside of it.
        asked = queries.where("vector IS NOT NULL").select(F.col("id").cast("long").alias("id"), F.col("vector").cast("array<double>").alias("vector")).mapInPandas(nearest, "id long, vector array<double>, lists array<int>").select("id", "vector", F.explode("lists").alias("list"))
        parts = max(1, -(-queries.count() // query_block))
        asked = asked.groupBy("list", F.pmod(F.xxhash64("id"), F.lit(parts)).alias("part")).agg(F.collect_list(F.struct("id", "vector")).alias("x"))
        asked = asked.select("list", F.transform("x", lambda y: y["id"]).alias("q_ids"), F.flatten(F.transform("x", lambda y: y["vector"])).alias("q"))
        used = [r[0] for r in asked.select("list").distinct().collect()]  # at most as many as there are lists
        pairs = self.blocks.where(F.col("list").isin(used)).join(asked, "list").select("ids", "vectors", "q_ids", "q")

        def score(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            for df in frames:
                for ids, v, q_ids, q in df.itertuples(index=False):
                    s = np.round(_unit(np.reshape(q, (len(q_ids), -1))) @ _unit(np.reshape(v, (len(ids), -1))).T, 9)
                    best = np.lexsort((np.broadcast_to(ids, s.shape), -s))[:, :k]
                    yield pd.DataFrame({"query_id": np.repeat(q_ids, best.shape[1]), "id": np.asarray(ids)[best].ravel(), "score": np.take_along_axis(s, best, 1).ravel()})

        return top_k(pairs.mapInPandas(score, _PAIRS), ["query_id"], [F.col("score").desc(), F.col("id")], k)


def open_dense_index(spark: SparkSession, path: str) -> DenseIndex:
    rows = spark.read.schema("list int, centroid array<double>").parquet(f"{path}/centroids").orderBy("list").toPandas()
    c = np.vstack(rows["centroid"].to_numpy()) if len(rows) else np.zeros((0, 0))
    return DenseIndex(c, spark.read.schema("list int, ids array<bigint>, vectors array<double>").parquet(f"{path}/lists"))


def probes_for(index: DenseIndex, vectors: DataFrame, target: float = 0.95, *, k: int = TOP_K, sample_queries: int = 256) -> int:
    """The fewest probes with which a bounded sample of the rows, each asking for its `k` nearest, finds `target` of them: measured against the exact search.

    Rows in clusters need few; rows without any, like random ones, nearly all lists.
    """
    asked = vectors.where("vector IS NOT NULL").orderBy(F.xxhash64("id", F.lit("asked")), "id").limit(sample_queries).select("id", "vector")
    homes = index.blocks.select("list", F.explode("ids").alias("id"))
    found = dense_topk(vectors.where("vector IS NOT NULL"), asked, k).join(homes, "id").select("query_id", "list").toPandas()  # sample_queries * k rows
    q = asked.toPandas()
    if not len(found):
        return max(1, len(index.centroids))
    order = np.argsort(-(_unit(np.vstack(q["vector"].to_numpy()).astype(np.float64)) @ index.centroids.T), axis=1, kind="stable")
    place = np.argsort(order, axis=1)
    at = dict(zip(q["id"], range(len(q)), strict=True))
    ranks = np.sort(place[[at[i] for i in found["query_id"]], found["list"]])
    return int(ranks[min(len(ranks) - 1, int(np.ceil(target * len(ranks))) - 1)]) + 1


def recall(found: DataFrame, exact: DataFrame) -> DataFrame:
    """(query_id, recall): the share of each query's exact rows that were found. Both: query_id, id."""
    met = exact.select("query_id", "id").join(found.select("query_id", "id", F.lit(1).alias("met")), ["query_id", "id"], "left")
    return met.groupBy("query_id").agg(F.avg(F.coalesce("met", F.lit(0))).alias("recall"))
