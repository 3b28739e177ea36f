"""The stateful streams: tokens and requests in several micro-batches, shuffled, sent again."""

import random

from lorebase.streaming import stateful, streams

TOKENS = "answer_id long, seq long, delta string, allowed array<long>"


def run(spark, tmp_path, make, batches, schema, name):
    """Each batch is a file of its own, and a micro-batch of its own."""
    for k, rows in enumerate(batches):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(str(tmp_path / name / "in"))
        stream = spark.readStream.schema(schema).parquet(str(tmp_path / name / "in"))
        with stateful.rocksdb(spark):
            streams.run_to_end(make(stream), streams.write_batch(str(tmp_path / name / "out")), "append", str(tmp_path / name / "progress"))
    return spark.read.parquet(str(tmp_path / name / "out"))


def answers():
    texts = {1: "It holds [S1] and [S2]. Fine.", 2: "It cites [S1, S9999] here and goes on [S1].", 3: "Half open [S10", 4: "No brackets at all, " * 30, 5: "[State] [2] S77 [S2]"}
    return {i: [(i, k, t[k * 5 : k * 5 + 5], [1, 2]) for k in range(-(-len(t) // 5))] for i, t in texts.items()}


def plain(tokens):
    """Tokens in order until a closed bad citation."""
    out, text = [], ""
    for i, k, delta, allowed in tokens:
        text += delta
        if stateful.cited_in(text) - set(allowed):
            return [*out, (i, k, "invalidated", "")]
        out.append((i, k, "token", delta))
    return out


def test_guard_with_shuffled_batches(spark, tmp_path):
    each = answers()
    flat = [t for x in each.values() for t in x]
    random.Random(3).shuffle(flat)
    again = flat[:15]
    got = run(spark, tmp_path, stateful.guarded, [flat[:40], flat[40:90] + again, flat[90:]], TOKENS, "guard")
    want = sorted(x for t in each.values() for x in plain(t))
    assert sorted(tuple(r)[:4] for r in got.select("answer_id", "seq", "name", "text").collect()) == want
    # Events of one answer leave in order, over all batches.
    place = {}
    for r in got.collect():
        place.setdefault(r["answer_id"], []).append((r["batch"], r["seq"]))
    assert all(max(s for b, s in x if b == k) < min([s for b, s in x if b > k], default=1 << 40) for x in place.values() for k in {b for b, _ in x})


def test_the_tail_is_bounded():
    assert stateful.open_tail("a long text without brackets") == "" and stateful.open_tail("x [S1] y") == "" and stateful.open_tail("x [S1] [S2") == "[S2" and stateful.open_tail("[a [S2") == "[S2"


def test_limiter_over_batches(spark, tmp_path):
    """Requests in order of time over three micro-batches, equal to the windowed row numbers; old windows' counts go, late rows of the last one still count."""
    from datetime import datetime, timedelta

    r, t0 = random.Random(9), datetime(2024, 1, 1)
    events = sorted(((r.randrange(4), k, t0 + timedelta(seconds=r.randrange(5 * 3600))) for k in range(300)), key=lambda x: (x[2], x[1]))
    schema = "user_id long, event_id long, ts timestamp"
    got = {x["event_id"]: x for x in run(spark, tmp_path, lambda s: stateful.limited(s, 3), [events[:100], events[100:130], events[130:]], schema, "limit").collect()}
    count, want = {}, {}
    for user, k, ts in events:
        n = count[user, ts.hour] = count.get((user, ts.hour), 0) + 1
        want[k] = (n, n <= 3, max(0, 3 - n), 3600 - (ts.minute * 60 + ts.second))
    assert {k: (x["ordinal"], x["allowed"], x["remaining"], x["reset_after"]) for k, x in got.items()} == want


def test_many_keys_share_few_groups(spark, tmp_path):
    """1,000 answers and users make a handful of groups, so that a key costs no call of its own; null ids are one key."""
    from datetime import datetime

    frame = spark.createDataFrame([(i,) for i in range(1000)], "answer_id long")
    assert stateful.ranged(frame, "answer_id").select("part").distinct().count() <= 8
    ids = [*range(1000), None]
    rows = [(i, k, d, [1]) for i in ids for k, d in enumerate(("a [S", "2] b" if i and i % 3 == 0 else "1] b", " c"))]
    want = sorted(((i, k, *x) for i in ids for k, x in enumerate([("token", "a [S"), *([("invalidated", "")] if i and i % 3 == 0 else [("token", "1] b"), ("token", " c")])])), key=str)
    for make in (stateful.guarded, streams.citation_guard):
        got = run(spark, tmp_path, make, [[x for x in rows if x[1] == k] for k in range(3)], TOKENS, make.__name__)
        assert sorted((tuple(r)[:4] for r in got.collect()), key=str) == want
    events = [(i, (i or -1) * 10 + k, datetime(2024, 1, 1, k // 3, 20 * (k % 3))) for i in ids for k in range(4)]
    got = run(spark, tmp_path, lambda s: stateful.limited(s, 2), [events[::2], events[1::2]], "user_id long, event_id long, ts timestamp", "many")
    assert sorted((r["ordinal"], r["allowed"]) for r in got.collect()) == sorted([(1, True), (2, True), (3, False), (1, True)] * 1001)
