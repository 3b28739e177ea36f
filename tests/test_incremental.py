"""The index that grows: runs over different rows, batches that come again, failures in between, and its equality with a build at once."""

import pytest
from pyspark.sql import functions as F

from lorebase.operators import chunking, graph
from lorebase.streaming.incremental import SCHEMAS, IncrementalIndex

SECTION = SCHEMAS["sections"]


def sections(n, at=0):
    """Section i refers to section i + 3, which a later batch may hold."""
    return [(i, 1 + i % 2, str(i), f"passage: Act — Note {i}. ", f"Part one of {i}. See section {i + 3} of the Code {'BA'[i % 2]} Act, 1807; and section {i + 2}.\n" + " ".join(f"w{k}." for k in range(40))) for i in range(at, at + n)]


@pytest.fixture
def statutes(spark):
    return spark.createDataFrame([(1, "The Code A Act, 1807"), (2, "Code B Act, 1807")], "id long, short_title string")


def rows(df):
    return sorted((tuple(map(str, r)) for r in df.collect()), key=str)


def built_at_once(spark, data, statutes, ceiling):
    s = spark.createDataFrame(data, SECTION)
    links = graph.build_links(graph.resolve_references(graph.extract_references(s.select("id", "statute_id", "text")), s.select("id", "statute_id", "section_no"), statutes))
    return rows(links), rows(chunking.chunk_sections(s.select("id", "heading", "text"), ceiling))


def test_batches_equal_a_build_at_once(spark, statutes, tmp_path):
    index = IncrementalIndex(spark, str(tmp_path / "i"), statutes, ceiling=30, dim=8)
    data = sections(20)
    frame = lambda x: spark.createDataFrame(x, SECTION)
    assert index.add(frame(data[10:]), "a-0") and index.add(frame(data[:10] + data[5:12]), "b-0")
    links, chunks = built_at_once(spark, data, statutes, 30)
    assert rows(index.table("links")) == links and rows(index.table("chunks")) == chunks and len(links) > 15
    vectors = index.table("vectors")
    assert vectors.count() == len(chunks) and vectors.where(F.size("vector") != 8).count() == 0
    before = {t: rows(index.table(t)) for t in SCHEMAS}
    assert not index.add(frame(data[:10]), "b-0") and not index.add(frame(data), "c-0") and not index.add(frame([]), "d-0")  # sent again
    assert {t: rows(index.table(t)) for t in SCHEMAS} == before
    assert index.add(frame(sections(2, 50)), "b-0")  # other rows under a number that was used
    assert index.table("sections").count() == 22
    index.compact()
    assert len(index.committed()) == 1 and rows(index.table("sections").where("id < 50")) == before["sections"]


def test_a_failed_batch_is_not_seen_and_comes_again(spark, statutes, tmp_path):
    def broken():
        raise RuntimeError("no model")

    data = spark.createDataFrame(sections(4), SECTION)
    with pytest.raises(Exception, match="no model"):
        IncrementalIndex(spark, str(tmp_path), statutes, load=broken).add(data, "r-0")
    index = IncrementalIndex(spark, str(tmp_path), statutes)
    assert index.table("sections").count() == 0 and index.committed() == []
    assert index.add(data, "r-0") and index.table("sections").count() == 4


def test_streams_go_on_where_they_ended(spark, statutes, tmp_path):
    """Two runs with different rows keep both; a run's next call takes only new files; rows of another source that are known add nothing."""
    index = IncrementalIndex(spark, str(tmp_path / "i"), statutes)
    source = lambda name: spark.readStream.schema(SECTION).parquet(str(tmp_path / name))
    put = lambda name, data: spark.createDataFrame(data, SECTION).coalesce(1).write.mode("append").parquet(str(tmp_path / name))
    put("a", sections(10))
    put("b", sections(12, 8))
    index.follow(source("a"), "first")
    index.follow(source("b"), "second")
    assert sorted(r["id"] for r in index.table("sections").collect()) == list(range(20))
    put("a", sections(3, 30))
    index.follow(source("a"), "first")
    index.follow(source("a"), "first")
    assert index.table("sections").count() == 23 and index.table("sections").distinct().count() == 23
    index.follow(source("b"), "third")  # the same rows by another run
    assert index.table("sections").count() == 23
