"""The kept index against the search that splits all texts."""

import random

import pytest

from lorebase.functions.text import STOP_WORDS
from lorebase.operators import retrieval
from lorebase.operators.search_index import build_index, open_index
from lorebase.sources.cluster import version_of


def corpus(spark, n=400):
    r = random.Random(5)
    words = [f"term{i}" for i in range(300)] + ["running", "runs", "the", "of"]
    docs = [(i, " ".join(words[min(r.randrange(304), r.randrange(304))] for _ in range(r.randrange(1, 80)))) for i in range(n)]
    docs += [(n, "rareword " * 5), (n + 1, "rareword once"), (n + 2, ""), (n + 3, None), (n + 4, "the of the")]
    queries = [(1, "term3 term200 runs"), (2, "rareword"), (3, "the of"), (4, "nobody has these"), (5, " ".join(f"term{i}" for i in range(0, 300, 7))), (6, "Running running term1 rareword"), (7, ""), (8, "term0 term1 term2")]
    return spark.createDataFrame(docs, "id long, text string"), spark.createDataFrame(queries, "query_id long, text string")


@pytest.mark.parametrize(("block_rows", "k", "first", "most_stems"), [(8, 5, 1, 500_000), (1, 1000, 1, 0)])
def test_search_equals_the_search_without_index(spark, tmp_path, block_rows, k, first, most_stems):
    docs, queries = corpus(spark)
    index = build_index(docs, str(tmp_path / "i"), block_rows=block_rows, buckets=4, most_stems=most_stems)
    want = sorted(map(tuple, retrieval.sparse_topk(docs, queries, k).select("query_id", "id", "score", "matched", "rank").collect()))
    assert sorted(map(tuple, index.search(queries, k, first).select("query_id", "id", "score", "matched", "rank").collect())) == want and want
    again = open_index(spark, str(tmp_path / "i"))
    assert sorted(map(tuple, again.bm25(queries).collect())) == sorted(map(tuple, retrieval.bm25(docs, queries).collect()))


def test_scope_comes_before_the_cut(spark, tmp_path):
    docs, queries = corpus(spark)
    index = build_index(docs, str(tmp_path / "i"), block_rows=16)
    scope = docs.where("id % 3 = 1").select("id")
    want = {}
    for r in index.bm25(queries).where("id % 3 = 1").collect():
        want.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    got = {}
    for r in index.search(queries, 4, scope=scope).orderBy("rank").collect():
        got.setdefault(r["query_id"], []).append((-r["score"], r["id"]))
    assert got == {q: sorted(x)[:4] for q, x in want.items()}


def test_narrow_scope_is_found_outside_the_first_blocks(spark, tmp_path):
    """A scope that the most promising blocks don't hold leaves a question without a floor, not without results."""
    docs, queries = corpus(spark)
    index = build_index(docs, str(tmp_path / "i"), block_rows=4)
    scope = docs.where("id % 97 = 1").select("id")
    want = {(r["query_id"], r["id"]) for r in index.bm25(queries).where("id % 97 = 1").collect()}
    assert {(r["query_id"], r["id"]) for r in index.search(queries, 10, 1, scope=scope).collect()} == want and want


def test_coverage_equals_the_one_over_texts(spark, tmp_path):
    docs, queries = corpus(spark)
    index = build_index(docs, str(tmp_path / "i"), block_rows=16)
    pairs = spark.createDataFrame([(q, i, i % 5) for q in range(1, 9) for i in (*range(0, 400, 9), 400, 401, 402, 403, 404)], "query_id long, id long, fused_rank int")
    assert sorted(map(tuple, index.coverage(pairs, queries).collect())) == sorted(map(tuple, retrieval.coverage(pairs, docs, queries).collect()))


def test_blocks_below_the_floor_are_left_out(spark, tmp_path):
    """A question whose best documents stand in one block: the plan's second scoring meets few blocks. Only asked terms' buckets are opened."""
    docs, _ = corpus(spark)
    index = build_index(docs, str(tmp_path / "i"), block_rows=4, buckets=8)
    one = spark.createDataFrame([(1, "rareword")], "query_id long, text string")
    asked, mine = index._terms(retrieval.asked_terms(one))
    assert mine.select("bucket").distinct().count() == 1 and asked.count() == 1
    assert [r["id"] for r in index.search(one, 1).collect()] == [400]
    assert sum("bucket=" in f for f in mine.inputFiles()) <= len(index.postings.inputFiles())


def test_empty_corpus_and_versions(spark, tmp_path):
    docs, queries = corpus(spark)
    assert build_index(docs.limit(0), str(tmp_path / "none")).search(queries).count() == 0
    a = version_of(spark, str(tmp_path / "none" / "stats"))
    assert a == version_of(spark, str(tmp_path / "none" / "stats")) != version_of(spark, str(tmp_path / "none" / "postings"))


def test_index_leaves_only_its_own_tables(spark, tmp_path):
    docs, _ = corpus(spark, 20)
    index = build_index(docs, str(tmp_path / "i"))
    assert sorted(x.name for x in (tmp_path / "i").iterdir() if x.is_dir()) == ["postings", "stats"]
    sizes = [sum(w not in STOP_WORDS for w in t.split()) for (t,) in docs.select("text").collect() if t is not None]
    assert index.documents == docs.count() and abs(index.mean - sum(sizes) / len(sizes)) < 1e-9  # null texts are no part of the mean
