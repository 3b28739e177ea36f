"""Ledger, pending work, merges, logs and checkpoint lines, as files under a folder."""

import os

import pytest
from pyspark.sql import functions as F

from lorebase.operators import jobs
from lorebase.operators.embedding import hashing_model


def test_ledger(spark, tmp_path):
    ledger = jobs.Ledger(spark, str(tmp_path / "ledger"))
    assert ledger.rows().count() == 0
    rows = spark.range(50)
    with ledger.run("parse", "portal") as run:
        assert [r["status"] for r in ledger.rows().collect()] == ["running"]
        run.counted(rows, "sections").write.parquet(str(tmp_path / "out"))
        run.counted(rows.limit(3), "sections").write.format("noop").mode("overwrite").save()
        run.warn("section_not_found", "s. 9")
    with ledger.run("index") as run:
        run.error("no_text", "s. 1")
    with pytest.raises(ValueError, match="broken"), ledger.run("fetch") as run:
        run.counted(rows, "never written")
        raise ValueError("broken")
    got = {r["command"]: r for r in ledger.rows().collect()}
    assert {k: r["status"] for k, r in got.items()} == {"parse": "succeeded", "index": "partial", "fetch": "failed"}
    assert got["parse"]["counts"] == {"sections": 53} and got["parse"]["source"] == "portal"
    assert [tuple(x) for x in got["parse"]["warnings"]] == [("section_not_found", "s. 9")]
    assert [tuple(x) for x in got["fetch"]["errors"]] == [("ValueError", "broken")] and got["fetch"]["finished_at"] >= got["fetch"]["started_at"]


def test_pending_work_is_taken_up(spark, tmp_path):
    """Stopped after some ranges, the next run embeds the rest only, and a third one nothing."""
    path = str(tmp_path / "vectors")
    chunks = spark.createDataFrame([(i, f"text {i}" if i % 9 else None) for i in range(200)], "id long, text string").repartition(3)

    def stops():
        model = hashing_model(4)()

        def run(texts):
            if any(int(t.split()[-1]) > 120 for t in texts):
                raise RuntimeError("killed")
            return model(texts)

        return run

    with pytest.raises(Exception, match="killed"):
        jobs.embed_pending(chunks, path, stops, 4, batch_rows=30)
    first = {r["id"]: tuple(r["vector"]) for r in spark.read.parquet(path).collect()}
    assert 60 < len(first) < 120
    asked = str(tmp_path / "asked")

    def noting():
        model = hashing_model(4)()

        def run(texts):
            os.makedirs(asked, exist_ok=True)
            for t in texts:
                with open(f"{asked}/{t.split()[-1]}", "x"):  # once only
                    pass
            return model(texts)

        return run

    assert jobs.embed_pending(chunks, path, noting, 4, batch_rows=30) > 1
    rows = spark.read.parquet(path).collect()
    assert sorted(r["id"] for r in rows) == [i for i in range(200) if i % 9]
    assert {int(x) for x in os.listdir(asked)} == {r["id"] for r in rows} - set(first)
    assert all(first.get(r["id"], tuple(r["vector"])) == tuple(r["vector"]) for r in rows)
    assert jobs.embed_pending(chunks, path, noting, 4) == 0 and jobs.pending(chunks, path).count() == 0


def files(path):
    return {os.path.join(d, f): os.stat(os.path.join(d, f)).st_mtime_ns for d, _, fs in os.walk(path) for f in fs if f.startswith("part-")}


def test_merge_leaves_what_has_not_changed(spark, tmp_path):
    path, schema = str(tmp_path / "t"), "k long, ver long, v string"
    put = lambda rows: jobs.merge_into(spark, path, spark.createDataFrame(rows, schema), ["k"], "ver", parts=8)
    data = [(i, 1, f"v{i}") for i in range(100)]
    assert put(data + [(5, 0, "older")])["inserted"] == 100
    before = files(path)
    assert put(data[:50]) == {"inserted": 0, "updated": 0, "unchanged": 50, "parts": 0} and files(path) == before
    assert put([(7, 0, "older"), (8, 1, "v8")])["parts"] == 0 and files(path) == before
    told = put([(7, 2, "new"), (200, 1, "more"), (9, 1, "v9"), (7, 1, "lost")])
    assert (told["inserted"], told["updated"], told["unchanged"]) == (1, 1, 1) and told["parts"] <= 2
    after = files(path)
    assert len(before.keys() & after.keys()) >= 6 and all(before[f] == after[f] for f in before.keys() & after.keys())
    got = {r["k"]: (r["ver"], r["v"]) for r in jobs.read_merged(spark, path).collect()}
    assert got == {i: (1, f"v{i}") for i in range(100)} | {7: (2, "new"), 200: (1, "more")} and jobs.read_merged(spark, path).count() == 101


def test_insert_ignore_and_logs(spark, tmp_path):
    path = str(tmp_path / "edges")
    edges = spark.createDataFrame([(1, 2, "a"), (1, 2, "b"), (2, 3, "c")], "a long, b long, raw string")
    assert jobs.append_new(edges, path, ["a", "b"]) == 2 and jobs.append_new(edges, path, ["a", "b"]) == 0
    assert jobs.append_new(edges.unionByName(spark.createDataFrame([(9, 9, "z")], edges.schema)), path, ["a", "b"]) == 1
    log = str(tmp_path / "log")
    jobs.append_ask_log(spark.createDataFrame([("q", "someone", 7, "2024-05-01 10:00:00")], "question string, user_id string, latency_ms long, created_at string"), log)
    jobs.append_ask_log(spark.createDataFrame([("r",)], "question string"), log)
    rows = spark.read.parquet(log)
    assert "user_id" not in rows.columns and rows.where("created_at IS NULL").count() == 0 and rows.count() == 2
    assert rows.where("day = '2024-05-01'").first()["latency_ms"] == 7


def test_checkpoint_files(spark, tmp_path):
    path = tmp_path / "ledger"
    path.mkdir()
    (path / "b.jsonl").write_text('{"id": 1, "x": 1}\n{"id": 2, "x": 1}\n\n{"id": 1, "x": 2}\n')
    os.utime(path / "b.jsonl", (1_000, 1_000))
    (path / "a.jsonl").write_text('{"id": 2, "x": 9}\nnot json\n{"id": 3, "x": 1}\n{"id": 1, "x"')
    os.utime(path / "a.jsonl", (2_000, 2_000))
    read = lambda: sorted(map(tuple, jobs.read_checkpoint(spark, str(path), "id long, x int", "id").collect()))
    assert read() == [(1, 2), (2, 9), (3, 1)]
    jobs.append_checkpoint(spark.createDataFrame([(3, 4), (5, None)], "id long, x int").coalesce(1), str(path))
    assert read() == [(1, 2), (2, 9), (3, 4), (5, None)]


def test_checkpoint_over_many_blocks(spark, tmp_path):
    """A file that is read in several blocks keeps its lines' order."""
    rows = [(i % 50, i) for i in range(5000)]
    (tmp_path / "c.jsonl").write_text("".join(f'{{"id": {a}, "x": {b}}}\n' for a, b in rows))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "8k")
    try:
        got = jobs.read_checkpoint(spark, str(tmp_path), "id long, x int", "id")
        assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 3
        assert {r["id"]: r["x"] for r in got.collect()} == dict(rows)
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got.select(F.max("x")).first()[0] == 4999
