import pytest
from pyspark.errors import PythonException
from pyspark.sql import functions as F

from lorebase.operators import embedding, store
from lorebase.sources import archive, manifest


def test_upsert_and_insert_ignore(spark):
    old = spark.createDataFrame([(1, 1, "a"), (2, 5, "b")], "k long, ver long, v string")
    new = spark.createDataFrame([(1, 2, "c"), (2, 4, "d"), (3, 1, "e"), (1, 2, "c")], "k long, ver long, v string")
    assert sorted(map(tuple, store.upsert_latest(old, new, ["k"], "ver").collect())) == [(1, 2, "c"), (2, 5, "b"), (3, 1, "e")]
    assert [r["k"] for r in store.insert_ignore(old, new, ["k"]).collect()] == [3]


def test_checkpoint_lines(spark):
    lines = spark.createDataFrame([(1, '{"id": 1, "x": 1}'), (2, ""), (3, '{"id": 1, "x"'), (4, '{"id": 2, "x": 5}'), (5, '{"id": 1, "x": 3}')], "n int, line string")
    assert sorted(map(tuple, store.latest_checkpoint(lines, "id long, x int", "id", "n").collect())) == [(1, 3), (2, 5)]


def test_cascade_and_diff(spark):
    parents = spark.createDataFrame([(1,), (2,)], "id long")
    children = spark.createDataFrame([(10, 1), (11, 2)], "id long, parent_id long")
    grand = spark.createDataFrame([(10,), (11,), (11,)], "parent_id long")
    left, below = store.cascade_delete(parents, children, grand, F.col("id") == 1)
    assert [r["id"] for r in left.collect()] == [11] and [r["parent_id"] for r in below.collect()] == [11, 11]
    a = spark.createDataFrame([(1, "x"), (2, "y")], "k long, v string")
    b = spark.createDataFrame([(2, "z"), (3, None)], "k long, v string")
    assert sorted(map(tuple, store.fingerprint_diff(a, b, "k", ["k", "v"]).collect())) == [(1, "removed"), (2, "changed"), (3, "added")]


def test_plug_points(spark):
    docs = spark.createDataFrame([(1, "ab"), (2, None), (3, "c")], "id long, text string")
    load = lambda: lambda texts: [[float(len(t)), 1.0] for t in texts]
    assert {r["id"]: r["vector"] for r in embedding.embed(docs, load, 2).collect()} == {1: [11.0, 1.0], 3: [10.0, 1.0]}
    with pytest.raises(PythonException):
        embedding.embed(docs, load, 3).collect()
    pairs = spark.createDataFrame([(1, 2, "q", "p")], "query_id long, id long, question string, passage string")
    assert embedding.score_pairs(pairs, lambda: lambda q, p: [0.0] * len(q)).first()["score"] == 0.5


def test_archive(spark, tmp_path):
    (tmp_path / "a.json").write_text(
        '{"act_id": "7", "items": [{"uuid": "u1", "metadata": {"act.id": [{"value": "7"}], "collection": [{"value": "SECTION"}], "section.number": [{"value": "2A."}], "order.number": [{"value": "x"}]}},'
        '{"uuid": "u2", "metadata": {"act.id": [{"value": "8"}], "collection": [{"value": "SECTION"}], "section.number": [{"value": "3"}]}}, {"uuid": "u3", "metadata": {"collection": []}}]}'
    )
    rows = archive.section_items(archive.read_archive(spark, str(tmp_path))).collect()
    assert [(r["uuid"], r["section_no"], r["order_number"], r["title"]) for r in rows] == [("u1", "2A", None, "")]


def test_fingerprints_tell_values_apart(spark):
    a = spark.createDataFrame([(1, "a|b", "c"), (2, None, "x"), (3, "~", "y"), (4, "1:a", "")], "k long, v string, w string")
    b = spark.createDataFrame([(1, "a", "b|c"), (2, "~", "x"), (3, "~", "y"), (4, "", "1:a")], "k long, v string, w string")
    assert sorted(map(tuple, store.fingerprint_diff(a, b, "k", ["v", "w"]).collect())) == [(1, "changed"), (2, "changed"), (4, "changed")]


def test_manifest(spark, tmp_path):
    (tmp_path / "m.json").write_text('{"slug": "a", "tier": 1}\n{"slug": "b", "tier": 2}\n')
    entries = manifest.read_manifest(spark, str(tmp_path / "m.json"))
    assert [r["slug"] for r in manifest.select_acts(entries, tier=2).collect()] == ["b"]
    with pytest.raises(ValueError, match="unknown slug: z"):
        manifest.select_acts(entries, slug="z")
    (tmp_path / "n.json").write_text('{"slug": "a"}\n{"slug": "a"}\n')
    with pytest.raises(ValueError, match="repeated slugs: a"):
        manifest.read_manifest(spark, str(tmp_path / "n.json"))


def test_gold_file(spark, tmp_path):
    (tmp_path / "g.json").write_text('{"in_corpus": [{"id": "q1", "question": "x?", "topic": "t", "expected": [{"statute_slug": "a", "sections": ["21-A", "2"]}]}],\n "adversarial": [{"id": "q2", "question": "y?", "topic": "t", "must_abstain": true, "expected": []}]}')
    gold = manifest.read_gold(spark, str(tmp_path / "g.json"))
    sections = spark.createDataFrame([(7, "a", "21A"), (8, "a", "2")], "id long, slug string, section_no string")
    assert {r["id"]: (r["must_abstain"], r["expected_section_ids"]) for r in manifest.resolve_gold(gold, sections).collect()} == {"q1": (False, [7, 8]), "q2": (True, [])}
    with pytest.raises(ValueError, match="labels without a section: a s. 2"):
        manifest.resolve_gold(gold, sections.where("id = 7"))
