"""The index of vectors against the search over every pair."""

import numpy as np

from lorebase.operators import dense_index, retrieval

from .conftest import SF


def clustered(spark, n=1500, dim=12, groups=25):
    r = np.random.default_rng(4)
    centre = r.normal(size=(groups, dim))
    x = centre[r.integers(groups, size=n)] + 0.4 * r.normal(size=(n, dim))
    x[7] = x[8]
    rows = [(i, [float(y) for y in v]) for i, v in enumerate(x)] + [(n, None)]
    return spark.createDataFrame(rows, "id long, vector array<double>")


def test_all_lists_are_exact_and_few_have_recall(spark, tmp_path):
    v = clustered(spark)
    q = v.where("id % 20 = 0")
    index = dense_index.build_dense_index(v.repartition(3), str(tmp_path / "i"), block_rows=40)
    exact = retrieval.dense_topk(v.where("vector IS NOT NULL"), q.where("vector IS NOT NULL"), 10)
    rows = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    assert rows(index.search(q, 10, probes=10_000)) == rows(exact)
    found = dense_index.open_dense_index(spark, str(tmp_path / "i")).search(q, 10, probes=6)
    assert 1 < dense_index.probes_for(index, v, 0.95, k=10) <= 12 and dense_index.probes_for(index, v, 1.0, k=10) <= len(index.centroids)
    share = [r["recall"] for r in dense_index.recall(found, exact).collect()]
    assert np.mean(share) >= 0.9 and len(share) == 75
    assert index.blocks.selectExpr("sum(size(ids))").first()[0] == 1500  # every row is in a list
    assert 20 < len(index.centroids) < 60


def test_given_vectors_recall(spark, tmp_path):
    v = spark.read.parquet(f"{SF}/embeddings.parquet").selectExpr("vec_id AS id", "embedding AS vector")
    q = v.where("id % 10 = 0")
    index = dense_index.build_dense_index(v, str(tmp_path / "i"))
    share = [r["recall"] for r in dense_index.recall(index.search(q, 10, probes=dense_index.probes_for(index, v, k=10)), retrieval.dense_topk(v, q, 10)).collect()]
    assert np.mean(share) >= 0.9


def test_little_and_equal_rows(spark, tmp_path):
    schema = "id long, vector array<double>"
    none = dense_index.build_dense_index(spark.createDataFrame([], schema), str(tmp_path / "none"))
    q = spark.createDataFrame([(1, [1.0, 0.0]), (2, None)], schema)
    assert none.search(q).count() == 0
    same = spark.createDataFrame([(i, [1.0, 1.0]) for i in range(50)] + [(99, [0.0, 0.0])], schema)
    got = dense_index.build_dense_index(same, str(tmp_path / "same"), block_rows=8).search(q, 3)
    assert [(r["id"], r["rank"]) for r in got.orderBy("rank").collect()] == [(0, 1), (1, 2), (2, 3)]


def test_long_lists_have_more_blocks_and_many_probes_few_rows(spark, tmp_path):
    rows = [(i, [1.0, 0.0] if i % 10 else [-1.0, 0.01 * i]) for i in range(2000)]
    v = spark.createDataFrame(rows, "id long, vector array<double>")
    index = dense_index.build_dense_index(v, str(tmp_path / "i"), lists=8, sample_rows=300, block_rows=50)
    assert index.blocks.selectExpr("max(size(ids))").first()[0] < 100  # nine tenths are in one list
    q = v.where("id % 50 < 2")
    got = index.search(q, 5, probes=8)
    rows_of = lambda df: sorted(map(tuple, df.select("query_id", "id", "score", "rank").collect()))
    assert rows_of(got) == rows_of(retrieval.dense_topk(v, q, 5))
