import random
import re
import zlib
from hashlib import sha256

import numpy as np
import pytest
from pyspark.sql import functions as F

from lorebase.llm import chat, components, html_extract, license_scan, near_dedup, packing, quality, queries, secret_scan, sharding, toxicity, wordhash
from lorebase.llm.decontaminate import decontaminate

from ..conftest import SF
from . import helpers as H


def prose(seed, n, vocab=400):
    r = random.Random(seed)
    return " ".join(f"w{r.randrange(vocab)}" for _ in range(n))


ODD = [(1, None), (2, ""), (2, ""), (None, "a null id stands here"), (3, "   \n\t "), (4, "one"), (5, "One two Three four"), (6, "one two three four"), (7, "É ß 漢字   x"), (7, "é"), (8, prose(1, 30_000)), (9, prose(1, 30_000) + " end"), (10, "x" * 200_000)]


def test_word_hashes_follow_the_patterns():
    texts = [t or "" for _, t in ODD[:10]] + ["a\x0bb\x0cc", "tab\tA", "ünï cödé A-B c_d"]
    raw = [t.encode() for t in texts]
    offsets = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    for apart, pattern in ((wordhash.SPACE, H.SPACED), (wordhash.NOT_ALNUM, H.ALNUM)):
        w = wordhash.words(np.frombuffer(b"".join(raw), np.uint8), offsets, apart)
        got = [[bytes(w.data[s:e]).decode() for s, e in zip(w.start[w.first[i] : w.first[i + 1]], w.end[w.first[i] : w.first[i + 1]], strict=True)] for i in range(len(texts))]
        assert got == [pattern.findall(t.translate(H.FOLD)) for t in texts]
    assert wordhash.words(np.zeros(0, np.uint8), np.zeros(1, np.int64)).first.tolist() == [0]


def test_components(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 3), (9, 8), (5, None)] + [(i, i + 1) for i in range(20, 40)], "a long, b long")
    assert {r["id"]: r["comp"] for r in components.components(edges).collect()} == {1: 1, 2: 1, 3: 1, 8: 8, 9: 8} | {i: 20 for i in range(20, 41)}
    assert components.components(edges.limit(0)).count() == 0


# --- 9: near-duplicates ---------------------------------------------------------------------------------------


def near_cases():
    base = prose(7, 150, 10_000).split()
    r = random.Random(3)
    docs = [(100 + i, prose(i, 120, 10_000)) for i in range(20)]
    for i in range(90):  # a group of copies with up to five words changed: chains and stragglers
        w = list(base)
        for k in range(r.randrange(6)):
            w[r.randrange(150)] = f"e{i}_{k}"
        docs.append((200 + i, " ".join(w)))
    return docs + [(500 + i, " ".join(base)) for i in range(10)] + ODD


def test_near_duplicates_equal_brute_force(spark):
    docs = near_cases()
    rows = near_dedup.near_duplicates(H.docs_frame(spark, docs).repartition(3)).collect()
    want = sorted(((i, n, c if n and c is not None else i) for (i, _), (n, c) in zip(docs, H.components(docs), strict=True)), key=str)
    assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == want
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)


def test_null_and_repeated_ids(spark):
    """Near copies in pairs under null ids, under one id, and under ids of their own have the same classes."""
    pairs = [w for i in range(30) for w in (prose(900 + i, 60, 9000), prose(900 + i, 60, 9000) + " more")] + [prose(1, 40)] * 3
    for ids in ([None] * 40 + list(range(23)), [7] * 63, [None] * 63, list(range(63))):
        docs = list(zip(ids, pairs, strict=True))
        rows = near_dedup.near_duplicates(H.docs_frame(spark, docs).repartition(2)).collect()
        want = sorted(((i, n, c if n and c is not None else i) for (i, _), (n, c) in zip(docs, H.components(docs), strict=True)), key=str)
        assert sorted(((r["doc_id"], r["n_shingles"], r["component_id"]) for r in rows), key=str) == want


def test_a_null_id_meets_only_its_own_text(spark):
    """The texts that are fetched grow with the rows, not with the square of the null ids."""
    docs = H.docs_frame(spark, [(None, prose(i // 2, 60, 9000) + (" more" if i % 2 else "")) for i in range(1200)])
    met, check = [], near_dedup.checkpoint
    near_dedup.checkpoint = lambda df: met.append(check(df)) or met[-1]
    try:
        near_dedup.near_duplicates(docs).count()
    finally:
        near_dedup.checkpoint = check
    assert max(x.count() for x in met if x.columns == ["cid", "text"]) == 1200


def test_large_buckets_meet_in_blocks(spark):
    docs = [x for x in near_cases() if x[0] and x[0] >= 100]
    rows = near_dedup.near_duplicates(H.docs_frame(spark, docs), small_bucket=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: c for (i, _), (_, c) in zip(docs, H.components(docs), strict=True)}


def template_cases(n=150, same=0.88):
    """Texts of one template that share about 0.8 of their shingles with each other, some with near copies of their own, and texts near to several of them."""
    r, base = random.Random(12), prose(70, 400, 10_000).split()
    docs = []
    for i in range(n):
        own = [f"o{i}_{k}" for k in range(int(len(base) * (1 - same)))]
        docs.append((1000 + i, " ".join(base + own)))
        if i % 7 == 0:
            own[3] = "edit"
            docs.append((2000 + i, " ".join(base + own)))
        if i % 11 == 0:
            mine = [f"o{i}_{k}" for k in range(30)] + [f"o{(i + 1) % n}_{k}" for k in range(30, 44)]
            docs.append((3000 + i, " ".join(base + mine)))
    r.shuffle(docs)
    return docs


def test_template_below_the_threshold(spark):
    """A large group that shares buckets but not links: right components, and no pairs of all with all."""
    docs = template_cases()
    sets = [H.shingles(t) for _, t in docs[:20]]
    alike = [len(x & y) / len(x | y) for i, x in enumerate(sets) for y in sets[i + 1 :]]
    assert 0.75 < np.median(alike) < 0.84
    frame = H.docs_frame(spark, docs)
    rows = near_dedup.near_duplicates(frame, small_bucket=4).collect()
    assert {r["doc_id"]: r["component_id"] for r in rows} == {i: c for (i, _), (_, c) in zip(docs, H.components(docs), strict=True)}


def test_template_members_do_not_meet(spark):
    """Postings of rare shingles hold few of a template's texts."""
    docs = [(i, t) for i, t in template_cases(400) if i < 2000]
    large = spark.createDataFrame([(i, i) for i, _ in docs], "cid long, comp long")
    near = near_dedup._rare_postings(large, spark.createDataFrame(docs, "cid long, text string"), 5, 85)
    assert near.count() == 0


def test_bayesian_pruning_keeps_similar_pairs():
    least = near_dedup.least_agreements(256, 32, 0.85, 1e-6)
    assert len(least) == 8 and all(a <= b for a, b in zip(least, least[1:], strict=False)) and least[0] < 0.85 * 32 and least[-1] < 0.85 * 256


def test_near_duplicates_of_nothing(spark):
    assert near_dedup.near_duplicates(H.docs_frame(spark, ODD).limit(0)).count() == 0


# --- 8: decontamination ---------------------------------------------------------------------------------------


def test_decontamination_equals_brute_force(spark):
    item = prose(50, 40)
    items = [(1, item), (2, prose(51, 10)), (3, "short item of six words here"), (4, ""), (5, None), (6, "solo"), (7, item), (None, prose(52, 12))]
    docs = ODD + [(20, f"{prose(2, 30)} {' '.join(item.split()[5:17])} {prose(3, 30)}"), (21, f"x {item} y"), (22, " ".join(item.split()[:9])), (23, "A Short, ITEM of-six words here. solo solo"), (24, prose(51, 10)), (20, "same id, another text: solo"), (25, " ".join(item.split()[:10] * 3))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    for most in (200_000, 0):  # broadcast, and shuffled with salts
        got = [tuple(r) for r in decontaminate(H.docs_frame(spark, docs), bench, broadcast_rows=most).collect()]
        want = [(i, n, k, m, s, c) for i, n, k, m, s, c in H.contamination(docs, [(("" if i is None else i), t) for i, t in items])]
        assert sorted(got, key=str) == sorted(want, key=str)
    assert decontaminate(H.docs_frame(spark, docs), bench.limit(0)).where("contaminated").count() == 0
    assert decontaminate(H.docs_frame(spark, docs).limit(0), bench).count() == 0


def test_decontamination_with_clashing_columns(spark):
    """Either table may have columns named as those that are made on the way."""
    names = ["h", "g", "v", "fp", "near", "place", "from", "salt", "start", "length", "n_words", "text_hash", "id"]
    items, docs = [(1, prose(51, 12)), (2, "solo"), (None, None)], ODD + [(20, f"x {prose(51, 12)} solo"), (None, prose(51, 12))]
    bench, frame = spark.createDataFrame(items, "item_id long, text string"), H.docs_frame(spark, docs)
    clash = lambda df, *more: df.select("*", *(F.lit(7).alias(c) for c in (*names, *more) if c not in df.columns))
    for most in (200_000, 0):
        got = sorted(map(str, decontaminate(clash(frame, "item_id", "m"), clash(bench, "doc_id"), broadcast_rows=most).collect()))
        assert got == sorted(map(str, decontaminate(frame, bench).collect())) and sum("contaminated=True" in x for x in got) == 2


# --- 6: secrets -----------------------------------------------------------------------------------------------

HEX = "0123456789abcdef" * 2


def test_secret_base_spans_equal_brute_force(spark):
    docs = ODD + [(20, f"é token = \"{HEX}\" and secret:token = abcdefghijklmnop"), (21, "AKIA1234567890ABCD AKIA12 API_KEY='abc.def/ghi+jkl='"), (22, "PassWord: hunter2hunter2 passwd=short"), (23, f"{HEX} {HEX}"), (20, "api-key: abcdefghijklmnop apikey=abcdefghijklmnop")]
    rows = secret_scan.scan_secrets(H.docs_frame(spark, docs)).collect()
    want = [(i, *(sum(y[1] == k for y in o) for k in range(3)), sha256(H.joined(o).encode()).hexdigest()) for i, t in docs for o in [H.base_spans(t)]]
    assert sorted((tuple(r[c] for c in ("doc_id", "n_assign", "n_access", "n_hex", "base_sha256")) for r in rows), key=str) == sorted(want, key=str)
    assert secret_scan.scan_secrets(H.docs_frame(spark, docs).limit(0)).count() == 0


def test_weak_parts_need_a_complement(spark):
    far = " pad" * 300
    docs = [(1, "password: hunter2 at https://db.example.com/x"), (2, "password: hunter2 and nothing else"), (3, "see https://example.com/x"), (4, f"password: hunter2{far} https://example.com"), (5, f"user=alice{far[:100]} token={HEX}"), (6, "user=alice" + far + HEX)]
    got = {r["doc_id"]: [x.split(":")[0] for x in r["spans"].split(",") if x] for r in secret_scan.scan_secrets(H.docs_frame(spark, docs)).collect()}
    assert got == {1: ["short", "endpoint"], 2: [], 3: [], 4: [], 5: ["account", "assign", "hex"], 6: ["hex"]}


def test_tokens_within_an_address_are_part_of_it(spark):
    token = "AbCgEh12345xyz67890QrStUvW"
    docs = [(1, f"see https://site.com/watch?id={token} now"), (2, f"see https://site.com/{token}/x?y={token}#{token}"), (3, f"https://site.com/a?b=c key {token}"), (4, f"https://site.com/watch?id={token} then {token}"), (5, f"{token} at https://site.com/")]
    got = {r["doc_id"]: r["spans"] for r in secret_scan.scan_secrets(H.docs_frame(spark, docs)).collect()}
    assert got == {1: "", 2: "", 3: "endpoint:0:18,mixed:27:53", 4: "endpoint:0:22,mixed:58:84", 5: "mixed:0:26,endpoint:30:47"}


def test_scope_is_measured_between_spans(spark):
    """Links by the gap between spans, whatever their lengths, against all pairs."""
    r, url = random.Random(8), "https://h.example.com/"
    docs = [(1, f"{url}{'p' * 300} password: hunter2"), (2, f"{url}{'p' * 900}{' ' * 190} pwd password: hunter2"), (3, f"password: hunter2{' ' * 200}{url}x"), (4, f"password: hunter2{' ' * 201}{url}x"), (5, f"login: {'u' * 700}{' ' * 150}passwd=x1")]
    kinds = [lambda n: url + "p" * n, lambda n: "password: " + "q" * (n % 11 + 1), lambda n: "login: " + "u" * (n + 3), lambda n: "token=" + "k" * (12 + n)]
    docs += [(100 + i, "".join(r.choice(kinds)(r.choice([1, 90, 450])) + " " * r.choice([1, 150, 199, 200, 201, 202, 260]) for _ in range(5))) for i in range(60)]
    frame = H.docs_frame(spark, docs)
    _, extra = secret_scan.secret_spans(frame)
    got = {(x["doc_id"], x["kind"], x["start"], x["end"]) for x in extra.collect()}
    want = set()
    for i, t in docs:
        parts = [("where", "endpoint", *m.span()) for m in re.finditer(r"https://\S+", t)] + [("id", "account", *m.span()) for m in re.finditer(r"login: u+", t)]
        for m in re.finditer(r"(?:password: |passwd=|token=)(\w+)", t):
            parts.append(("secret", "assign" if len(m[1]) >= 12 else "short", *m.span()))
        want |= {(i, k, a, b) for x, k, a, b in parts if k != "assign" for y, _, c, d in parts if (x == "secret") != (y == "secret") and max(a, c) - min(b, d) <= 200}
    assert got == want
    assert {i for i, *_ in got if i < 100} == {1, 2, 3, 5}


def test_redaction(spark):
    docs = [(1, f"a é token={HEX} z {HEX}"), (2, "plain"), (3, None), (4, "")]
    got = {r["doc_id"]: r["text"] for r in secret_scan.redact_secrets(H.docs_frame(spark, docs)).collect()}
    assert got == {1: "a é [SECRET] z [SECRET]", 2: "plain", 3: None, 4: ""}


# --- 1: sharding ----------------------------------------------------------------------------------------------


@pytest.mark.parametrize("copies", [3, 700])
def test_sharding(spark, copies):
    docs = [(i, f"text {i}") for i in range(500)] + [(1000 + i, f"group {i % 20}") for i in range(20 * copies // 10)] + [(5000 + i, "hot") for i in range(copies)] + ODD
    rows = sharding.shard_documents(H.docs_frame(spark, docs).repartition(4)).collect()
    assert len(rows) == len(docs)
    by = {}
    for r in rows:
        by.setdefault(r["shard"], []).append(r["slot"])
    counts = [len(by.get(s, [])) for s in range(16)]
    assert max(counts) - min(counts) <= 1 and all(sorted(x) == list(range(len(x))) for x in by.values())
    assert sorted((str(r["doc_id"]), r["size"], r["text_crc32"]) for r in rows) == sorted((str(i), len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t in docs)
    groups = {r["doc_id"]: r["shard"] for r in rows if r["doc_id"] and 1000 <= r["doc_id"] < 5000}
    parts = sum(len({s for i, s in groups.items() if (i - 1000) % 20 == g}) for g in range(20))
    assert parts <= 100  # of 320 if they were dealt at random; four fifths of the rows are linked, and `hot` fills more than a shard


def test_sharding_of_few(spark):
    assert sharding.shard_documents(H.docs_frame(spark, ODD).limit(0)).count() == 0
    assert sorted(r["slot"] for r in sharding.shard_documents(H.docs_frame(spark, [(1, "a"), (2, "b")])).collect()) == [0, 0]


# --- 3: packing -----------------------------------------------------------------------------------------------


def test_packing_round_trip(spark):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    docs = [x for x in ODD if x[0] != 10] + [(100 + i, prose(i, 20 + 7 * i)) for i in range(60)] + [(300, "a  b   c \n d\n\n e <|endoftext|> 12 34's"), (301, " 　 x\t y "), (302, "tail  "), (303, "hi <|endoftext|> x"), (304, "<|endoftext|><|endoftext|>  <|endoftext|"), (305, "a <|endoftext|>\n\n b's <|endoftext|>")]
    rows = packing.pack_documents(H.docs_frame(spark, docs).repartition(3), tokenizer_path=P.path("byte_bpe_50k.json"), pattern=P.PATTERN, partition_rows=40, fan_in=2).collect()
    want = []
    for i, text in docs:
        ids = [*t.encode(text or "", add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want += [(str(i), k, a, b - a, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False))]
    assert sorted((str(r["doc_id"]), r["piece"], r["start"], r["length"], r["ids_crc32"]) for r in rows) == sorted(want)
    held = {}
    for r in sorted(rows, key=lambda r: r["offset"]):
        assert held.get(r["sequence_id"], 0) == r["offset"]
        held[r["sequence_id"]] = r["offset"] + r["length"]
    assert max(held.values()) <= 2048
    assert len(held) <= packing.lower_bound(np.array([r["length"] for r in rows]), 2048) + 2
    assert packing.pack_documents(H.docs_frame(spark, ODD).limit(0), tokenizer_path=P.path("byte_bpe_50k.json"), pattern=P.PATTERN).count() == 0


def test_lower_bound_is_one():
    r = np.random.default_rng(2)
    for _ in range(60):
        sizes = r.integers(1, 21, r.integers(1, 9))
        best = _fewest(sorted(map(int, sizes), reverse=True), 20)
        assert packing.lower_bound(sizes, 20) <= best <= len(packing.best_fit_decreasing(sizes, 20)[2])
    assert packing.lower_bound(np.array([11] * 7), 20) == 7


def _fewest(sizes, room, bins=()):
    if not sizes:
        return len(bins)
    x, rest = sizes[0], sizes[1:]
    out = [_fewest(rest, room, tuple(sorted((*bins[:i], b + x, *bins[i + 1 :])))) for i, b in enumerate(bins) if b + x <= room]
    return min([*out, _fewest(rest, room, tuple(sorted((*bins, x))))])


# --- 4: toxicity ----------------------------------------------------------------------------------------------


def test_forward_backward_equals_enumeration():
    from itertools import product

    r = np.random.default_rng(1)
    size, step = [5, 3, 0, 1, 0], r.normal(size=(2, 2))
    first = np.concatenate([[0], np.cumsum(size)])
    emit = r.normal(size=first[-1])
    p, moves = toxicity.forward_backward(emit, first, step)
    seen = np.zeros((2, 2))
    for at, n in zip(first, size, strict=False):
        paths = list(product((0, 1), repeat=n))
        w = np.array([np.exp(sum(emit[at + k] * y for k, y in enumerate(ys)) + sum(step[a, b] for a, b in zip(ys, ys[1:], strict=False))) for ys in paths])
        w /= w.sum()
        for k in range(n):
            assert abs(sum(x for x, ys in zip(w, paths, strict=True) if ys[k]) - p[at + k]) < 1e-9
        for x, ys in zip(w, paths, strict=True):
            for a, b in zip(ys, ys[1:], strict=False):
                seen[a, b] += x
    assert np.allclose(seen, moves)
    assert toxicity.forward_backward(np.zeros(0), np.zeros(3, int), step)[0].tolist() == []


@pytest.mark.parametrize("strength", [0.3, 1.5, 4.0])
def test_marginals_of_long_chains_are_those_of_the_whole_chain(strength):
    """Against a chain walked token by token: lengths around and far beyond a block."""
    r = np.random.default_rng(int(10 * strength))
    size = [63, 64, 65, 128, 129, 1, 3000, 200]
    first, step = np.concatenate([[0], np.cumsum(size)]), strength * r.normal(size=(2, 2))
    emit = 3 * r.normal(size=first[-1])
    p, moves = toxicity.forward_backward(emit, first, step)
    want, seen = [], np.zeros((2, 2))
    for at, n in zip(first, size, strict=False):
        e = np.stack([np.zeros(n), emit[at : at + n]], 1)
        f, b = [e[0]], [np.zeros(2)]
        for k in range(1, n):
            f.append(np.logaddexp(f[-1][0] + step[0], f[-1][1] + step[1]) + e[k])
        for k in range(n - 1, 0, -1):
            x = b[0] + e[k]
            b.insert(0, np.logaddexp(step[:, 0] + x[0], step[:, 1] + x[1]))
        z = np.logaddexp(*f[-1])
        want += [np.exp(f[k][1] + b[k][1] - z) for k in range(n)]
        for k in range(1, n):
            seen += np.exp(f[k - 1][:, None] + step + (e[k] + b[k])[None, :] - z)
    assert np.abs(p - want).max() < 1e-9 and np.allclose(moves, seen)


def test_short_toxic_words_are_learnt(spark):
    """A three-letter toxic word, and one that clean words begin with."""
    r = random.Random(9)
    docs, labels = [], []
    for i in range(800):
        w = prose(i, 50, 300).split() + ["hello", "helloing"]
        if i % 5 == 0:
            w += [r.choice(["zyx", "hell"])] * 3
        r.shuffle(w)
        docs.append((i, " ".join(w)))
        labels.append((i, int(i % 5 == 0)))
    marks = spark.createDataFrame([(*x, 1, "s") for x in labels], "doc_id long, toxic int, mass int, text string")
    rows = toxicity.toxicity(H.docs_frame(spark, docs), marks).where("held_out").collect()
    shuffled = toxicity.toxicity(H.docs_frame(spark, docs), marks, broadcast_rows=0).where("held_out").collect()
    assert {x["doc_id"]: x["score"] for x in rows} == {x["doc_id"]: x["score"] for x in shuffled}
    assert sum(x["predicted"] != (x["doc_id"] % 5 == 0) for x in rows) <= len(rows) // 50


def test_toxicity_learns_and_ignores_held_out_labels(spark):
    r = random.Random(5)
    docs, labels = [], []
    for i in range(600):
        w = prose(i, 60, 300).split()
        bad = i % 6 == 0
        for _ in range(3 * bad):
            w[r.randrange(60)] = r.choice(["badword", "vileness", "scummy"])
        docs.append((i, " ".join(w)))
        labels.append((i, int(bad)))
    docs += ODD
    frame, lab = H.docs_frame(spark, docs), spark.createDataFrame([*labels, (3, None), (None, 1)], "doc_id long, toxic int")
    rows = {r["doc_id"]: r for r in toxicity.toxicity(frame, lab).collect() if r["doc_id"] is not None and r["doc_id"] > 10}
    held = [i for i, r in rows.items() if r["held_out"]]
    assert sorted(held) == [i for i in range(11, 600) if zlib.crc32(str(i).encode()) % 5 == 0]
    assert all(rows[i]["predicted"] == (i % 6 == 0) for i in held)
    a, b = map(int, rows[12]["spans"].split(",")[0].split(":"))
    assert dict(docs)[12][a:b] in ("badword", "vileness", "scummy")
    flipped = lab.withColumn("toxic", F.when(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, 1 - F.col("toxic")).otherwise(F.col("toxic")))
    again = {r["doc_id"]: r["score"] for r in toxicity.toxicity(frame, flipped).collect()}
    assert all(again[i] == r["score"] for i, r in rows.items())
    assert toxicity.toxicity(frame.limit(0), lab).count() == 0


# --- 5: main text ---------------------------------------------------------------------------------------------

PAGE = "<html><head><title>T</title><style>p</style></head><body><nav><ul><li><a href='/a'>Home &amp; more</a></li></ul></nav><div class='ad'>Buy now</div><article><h1>Title {i}</h1><p>First &lt;b&gt; &eacute; para\n graph {w}.<p>Second <b>bold</b>, one. {v}</article><section class='comments'><p>A reader says {v}</p></section><footer>&copy; foot</footer></body></html>"


def test_main_text(spark):
    pages = [(i, f"u{i}", PAGE.format(i=i, w=prose(i, 20), v=prose(i + 99, 25))) for i in range(40)] + [(50, "u", None), (51, None, ""), (None, "u", "<p>"), (52, "x", "<script>x</script"), (53, "y", "<article><p>cut he")]
    rows = {r["page_id"]: r for r in html_extract.extract_main_text(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()}
    for i in range(40):
        assert rows[i]["text"] == f"Title {i}\n\nFirst <b> é para graph {prose(i, 20)}.\n\nSecond bold, one. {prose(i + 99, 25)}" and rows[i]["n_chars"] == len(rows[i]["text"])
    assert rows[50]["text"] == rows[51]["text"] == rows[52]["text"] == "" and rows[53]["text"] == "cut he"
    assert html_extract.extract_main_text(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_main_text_with_clashing_columns(spark):
    pages = [(i, f"u{i}", PAGE.format(i=i, w=prose(i, 20), v=prose(i + 99, 25)), "t", 1, 2, "b") for i in range(12)] + [(None, None, None, None, None, None, None)] * 2
    frame = spark.createDataFrame(pages, "page_id long, url string, html string, text string, n_chars int, h int, blocks string")
    plain = frame.select("page_id", "url", "html")
    got, want = (sorted(map(str, html_extract.extract_main_text(x).collect())) for x in (frame, plain))
    assert got == want and len(got) == len(pages)


def test_blocks():
    got = html_extract.blocks("a<br>b <!-- x --> c<p>d<p>e<div>f <i>g</i><ul><li>h<li>i</ul>j</div><script>k</script>l &nbsp; m <")
    assert [b.text for b in got] == ["a b c", "d", "e", "f g", "h", "i", "j", "l m <"]


# --- 7: quality -----------------------------------------------------------------------------------------------


def test_quality_counts_equal_brute_force(spark):
    docs = ODD + [(20, "same line here\nsame line here\n\n\nother"), (21, " ".join(["a b c d e f"] * 4)), (22, "### $$$ %% | < > & *"), (23, prose(4, 200)), (24, "x\r\nx\r\nx\n")]
    rows = quality.quality_rules(H.docs_frame(spark, docs)).collect()
    got = sorted(((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) for r in rows), key=str)
    assert got == sorted(((i, *H.surface(t)) for i, t in docs), key=str)
    assert all(r["base_failed"] == (r["n_words"] < 10 or 100 * r["n_repeat_words"] > 20 * r["n_words"]) and not (r["base_failed"] and r["kept"]) for r in rows)
    assert quality.quality_rules(H.docs_frame(spark, docs).limit(0)).count() == 0


def kneser_ney_costs(texts, learnt):
    """Mean negative log probability of each text's folded code points by interpolated modified Kneser-Ney of order 4, from dictionaries; counts are of the learnt texts only."""
    from collections import Counter, defaultdict
    from math import log

    def symbols(t):
        out = []
        for c in t:
            x = " " if c.isspace() or ord(c) < 32 else "0" if c.isdecimal() else c.lower() if len(c.lower()) == 1 else c
            if not (x == " " and out and out[-1] == " "):
                out.append(x)
        return out

    grams = [[tuple((["\0"] * 3 + w)[i : i + 4]) for i in range(len(w))] for w in map(symbols, texts)]
    tables = {4: Counter({g: 0 for x in grams for g in x})}
    tables[4].update(g for x, on in zip(grams, learnt, strict=True) if on for g in x)
    for k in (3, 2, 1):
        tables[k] = Counter({g[1:]: 0 for g in tables[k + 1]})
        tables[k].update(g[1:] for g, n in tables[k + 1].items() if n)
    info = {}
    for k, table in tables.items():
        n1, n2, n3, n4 = (sum(c == i for c in table.values()) for i in (1, 2, 3, 4))
        y = n1 / (n1 + 2 * n2) if n1 else 0
        d = [0.0] + [min(max(i - (i + 1) * y * b / a, 0.0), i) if n1 and a else 0.5 * i for i, a, b in ((1, n1, n2), (2, n2, n3), (3, n3, n4))]
        total, spare = Counter(), defaultdict(float)
        for g, c in table.items():
            total[g[:-1]] += c
            spare[g[:-1]] += d[min(c, 3)]
        info[k] = d, total, spare

    def p(g):
        if not g:
            return 1 / len(tables[1])
        d, total, spare = info[len(g)]
        c, h = tables[len(g)][g], g[:-1]
        if not total[h]:
            return p(g[1:])
        return (c - d[min(c, 3)] + spare[h] * p(g[1:])) / total[h]

    return [sum(-log(p(g)) for g in x) / len(x) if x else None for x in grams]


def lingual():
    """(id, text, lang) in three scripts, one language null."""
    cyrillic, han = "абвгдежзийклмнопрстуфхцчшщыэюя", [chr(0x4E00 + 7 * i) for i in range(300)]

    def made(seed, lang):
        r = random.Random(seed)
        if lang == "zh":
            return "。".join("".join(r.choice(han[:60] if r.random() < 0.8 else han) for _ in range(r.randrange(5, 30))) + " x" for _ in range(r.randrange(12, 40)))
        letters = cyrillic if lang == "ru" else "abcdefghij"
        return " ".join("".join(r.choice(letters[: 6 + i]) for i in range(r.randrange(2, 9))).capitalize() for _ in range(r.randrange(12, 160)))

    rows = [(1000 * k + i, made(1000 * k + i, lang), lang) for k, lang in enumerate(("ru", "zh", None), 1) for i in range(90)]
    r = random.Random(1)
    noise = [" ".join("".join(r.choice(cyrillic) for _ in range(6)) for _ in range(60)), "".join(chr(0x4E00 + r.randrange(8000)) + " " for _ in range(120)), "ы " * 5 + " ".join(f"ъ{i}ъъъ" for i in range(300))]
    return rows + [(9001, noise[0], "ru"), (9002, noise[1], "zh"), (9003, noise[2], "ru"), (9007, " | ".join(rows[3][1].split()), "ru"), (9004, None, "ru"), (9005, "", "zh"), (None, rows[0][1], "ru"), (9006, "🙂 😀 \U00020000 İx \x00 ½ ²  \u00a0 9 ٣", "xx")]


@pytest.mark.parametrize("model_rows", [2_000_000, 4000])
def test_perplexity_and_bands_equal_brute_force(spark, model_rows):
    rows = lingual()
    frame = spark.createDataFrame([(*x, 1, 2.0) for x in rows], "doc_id long, text string, lang string, grp int, total double").repartition(3)
    got = {r["doc_id"]: r for r in quality.quality_rules(frame, model_rows=model_rows).collect()}
    fit = lambda i: not got[i]["base_failed"] and 20 * got[i]["n_symbols"] <= got[i]["n_words"]
    for lang in ("ru", "zh", None, "xx"):
        own = [(i, t) for i, t, x in rows if x == lang]
        # What lies beyond the basic plane shares the symbols of its private-use area.
        want = kneser_ney_costs(["".join(c if ord(c) < 0x10000 else chr(0xE000 + ord(c) % 6400) for c in (t or "")) for _, t in own], [fit(i) for i, _ in own])
        for (i, _), x in zip(own, want, strict=True):
            assert got[i]["log_perplexity"] is None if x is None else abs(got[i]["log_perplexity"] - x) < 1e-5
        cost = {i: got[i]["log_perplexity"] for i, _ in own}
        passed, good = {i for i in cost if not got[i]["base_failed"]}, {i for i in cost if fit(i)}
        n_symbols = {i: len(re.sub(r"\s+", " ", t or "")) for i, t in own}
        quart = lambda xs: [sorted(xs)[max(0, -(-p * len(xs) // 4) - 1)] for p in (1, 3)]
        place = {i: np.log(max(1, n)) / np.log(4) for i, n in n_symbols.items()}
        edges = {}
        for k in {int(np.floor(place[i] + 0.5)) for i in good}:
            xs = [cost[i] for i in good if int(np.floor(place[i] + 0.5)) == k]
            w, (a, b), (c, d) = len(xs) / (len(xs) + 50), quart(xs), quart([cost[i] for i in good])
            lo, hi = w * a + (1 - w) * c, w * b + (1 - w) * d
            edges[k] = lo - 6 * max(hi - lo, 0.005), hi + 8 * max(hi - lo, 0.005)
        for i in cost:
            k, f = int(np.floor(place[i])), place[i] % 1
            x, y = edges.get(k), edges.get(k + 1)
            x, y = x or y, y or x
            keep = i in passed and (1 - f) * x[0] + f * y[0] <= cost[i] <= (1 - f) * x[1] + f * y[1]
            assert got[i]["kept"] == bool(keep), i
    assert not got[9002]["kept"] and not got[9003]["kept"] and not got[9007]["kept"] and got[1001]["kept"]


def test_bands_reject_labelled_junk(spark):
    """Of labelled texts that pass the base rules, bands reject most of low quality and nearly none of the others."""
    sf = SF.replace("0.001", "0.01")
    q = quality.quality_rules(spark.read.parquet(f"{sf}/documents.parquet")).where("NOT base_failed").join(spark.read.parquet(f"{sf}/labels.parquet"), "doc_id")
    n = {(r["quality"], r["kept"]): r["count"] for r in q.groupBy("quality", "kept").count().collect()}
    assert n[0, False] >= 0.8 * (n[0, False] + n.get((0, True), 0)) and n.get((1, False), 0) <= 0.02 * n[1, True]


def test_symbol_noise_is_rejected(spark):
    docs = [(i, prose(i, 60)) for i in range(120)] + [(500, " ".join(f"q{x}zzj" * 3 for x in "abcdefghijklmnopqrst")), (501, prose(999, 80))]
    kept = {r["doc_id"]: r["kept"] for r in quality.quality_rules(H.docs_frame(spark, docs)).collect()}
    assert not kept.pop(500) and all(kept.values())


# --- 2 and 10 -------------------------------------------------------------------------------------------------


def test_perspectives(spark):
    turns = [(1, 0, "system", "s"), (1, 1, "ann", "hi é"), (1, 2, "bob", None), (1, 3, None, "who"), (1, 1, "ann", "again"), (2, 0, "system", "alone"), (None, None, "ann", "x"), (3, 700, "ann", "late"), (3, 5, "bob", "early")]
    rows = chat.rotate_perspectives(spark.createDataFrame([(*t, 1) for t in turns], "conv_id long, turn long, role string, text string, block int")).collect()
    sides = {}
    for r in sorted(rows, key=lambda r: r["start"]):
        whole = sides.get((r["conv_id"], r["perspective"]), "")
        assert len(whole) == r["start"]
        whole += r["segment"]
        if r["role"] == "assistant":
            assert whole[r["mask_start"] : r["mask_end"]].endswith(chat.END)
        sides[r["conv_id"], r["perspective"]] = whole
    assert set(sides) == {(1, "ann"), (1, "bob"), (1, "unknown"), (None, "ann"), (3, "ann"), (3, "bob")}
    assert sides[3, "bob"] == "<|begin|>assistant\nearly<|end|>\n<|begin|>user name=ann\nlate<|end|>\n"
    assert chat.rotate_perspectives(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


MIT = """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:

The above copyright notice and this permission notice shall be included in all
copies or substantial portions of the Software.

THE SOFTWARE IS PROVIDED "AS IS", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR
IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,
FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE
AUTHORS BE LIABLE."""
APACHE = """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.
You may obtain a copy of the License at

    http://www.apache.org/licenses/LICENSE-2.0

Unless required by applicable law or agreed to in writing, software
distributed under the License is distributed on an "AS IS" BASIS,
WITHOUT WARRANTIES OR CONDITIONS OF ANY KIND, either express or implied.
See the License for the specific language governing permissions and
limitations under the License."""
GPL3 = """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.

This program is distributed in the hope that it will be useful,
but WITHOUT ANY WARRANTY; without even the implied warranty of
MERCHANTABILITY or FITNESS FOR A PARTICULAR PURPOSE.  See the
GNU General Public License for more details."""
BSD2 = """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions are met:

1. Redistributions of source code must retain the above copyright notice, this
   list of conditions and the following disclaimer.

2. Redistributions in binary form must reproduce the above copyright notice,
   this list of conditions and the following disclaimer in the documentation
   and/or other materials provided with the distribution.
"""
BSD3 = BSD2 + """
3. Neither the name of the copyright holder nor the names of its
   contributors may be used to endorse or promote products derived from
   this software without specific prior written permission.
"""
MPL = """This Source Code Form is subject to the terms of the Mozilla Public
License, v. 2.0. If a copy of the MPL was not distributed with this
file, You can obtain one at https://mozilla.org/MPL/2.0/."""
ISC = """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.

THE SOFTWARE IS PROVIDED "AS IS" AND THE AUTHOR DISCLAIMS ALL WARRANTIES
WITH REGARD TO THIS SOFTWARE INCLUDING ALL IMPLIED WARRANTIES OF
MERCHANTABILITY AND FITNESS."""


def test_licenses_of_real_headers(spark):
    """Official wording wrapped, on one line, and behind the comment marks of several languages."""
    texts = {"mit_text": MIT, "apache_header": APACHE, "gpl3_header": GPL3, "bsd2_text": BSD2, "bsd3_text": BSD3, "mpl_header": MPL, "isc_text": ISC}
    shapes = [lambda t: t, lambda t: " ".join(t.split()), *(lambda t, m=m: "\n".join(f"{m} {x}" for x in t.split("\n")) for m in ("//", "#", " *", "--", ";;", "dnl", "%")), lambda t: f"Code first.\n\n/*\n{t}\n*/\nint main;", lambda t: t.replace("\n", "\r\n")]
    docs = [(100 * i + j, shape(t)) for i, t in enumerate(texts.values(), 1) for j, shape in enumerate(shapes)]
    got = {}
    for r in license_scan.scan_licenses(H.docs_frame(spark, docs)).collect():
        got.setdefault(r["doc_id"], []).append(r["rule"])
    assert got == {100 * i + j: [name] for i, name in enumerate(texts, 1) for j in range(len(shapes))}


def test_licenses(spark):
    s = license_scan.SENTENCES
    assert all(re.search(license_scan.HINT, license_scan.normalised(x)) for x in s.values())
    mit = f"{s[3]}.\n{s[4]}. Filler here! {s[5].upper()}."
    docs = ODD + [(20, mit), (21, f"{s[5]}. {s[4]}. {s[3]}."), (22, "x\nLicensed under the Apache License, Version 2.0.\ny"), (22, "Released under the MIT License."), (23, "Released under the MIT Licenses."), (24, "This project is Licensed under the\nApache License, Version 2.0."), (25, "a license. " * 20_000), (26, f"{s[50]}. {s[51]}"), (27, "unlicensed under the mit license")]
    rows = [(r["doc_id"], r["rule"], r["sentence_ids"]) for r in license_scan.scan_licenses(H.docs_frame(spark, docs)).collect()]
    assert sorted(rows) == [(20, "mit_text", "3,4,5"), (22, "apache_notice", "10"), (22, "mit_notice", "1"), (24, "apache_notice", "10"), (26, "mpl_header", "50,51")]
    assert license_scan.scan_licenses(H.docs_frame(spark, docs).limit(0)).count() == 0


def test_wrapped_notices_of_every_rule_equal_sql(spark, tmp_path):
    """Each rule's sentences, wrapped within words' gaps behind several comment marks, by Spark and by SQL."""
    import textwrap

    from ..conftest import same_rows

    docs, k = [], 0
    for name, _, seq in license_scan.RULES:
        body = " ".join(f"{license_scan.SENTENCES[i].rstrip('.')}." for i in seq)
        for mark in ("", "# ", "// ", " * ", "dnl ", "REM "):
            docs.append((k, name, f"{mark}Some file.\n\n" + "\n".join(mark + x for x in textwrap.wrap(body, 34)) + "\n"))
            k += 1
    frame = H.docs_frame(spark, [(i, t) for i, _, t in docs])
    frame.write.parquet(f"{tmp_path}/documents")
    got = license_scan.scan_licenses(spark.read.parquet(f"{tmp_path}/documents"))
    same_rows(got, license_scan.SQL.replace("FROM documents", f"FROM '{tmp_path}/documents/*.parquet'"))
    found = {(r["doc_id"], r["rule"]) for r in got.collect()}
    # A rule that is found in its sentences as they stand, and not as part of a longer rule, is found in all wrapped ones.
    plain = H.docs_frame(spark, [(k, " ".join(f"{license_scan.SENTENCES[i].rstrip('.')}." for i in seq)) for k, (_, _, seq) in enumerate(license_scan.RULES)])
    whole = {license_scan.RULES[r["doc_id"]][0] for r in license_scan.scan_licenses(plain).collect() if r["rule"] == license_scan.RULES[r["doc_id"]][0]}
    assert {"unlicense_text", "mit_text", "zlib_text", "epl_header", "cc0_waiver"} <= whole and len(whole) > 30
    assert {(i, name) for i, name, _ in docs if name in whole} <= found


def test_licenses_sql_on_real_headers(spark, tmp_path):
    """The SQL twin on a table of such texts."""
    from ..conftest import same_rows

    rows = [(i, t) for i, t in enumerate([MIT, APACHE, GPL3, BSD2, BSD3, MPL, ISC, "# " + APACHE.replace("\n", "\n# "), None, "", "SPDX-License-Identifier: MIT\n\n" + BSD3], 1)]
    spark.createDataFrame(rows, "doc_id long, text string").coalesce(1).write.parquet(f"{tmp_path}/documents")
    same_rows(license_scan.scan_licenses(spark.read.parquet(f"{tmp_path}/documents")), license_scan.SQL.replace("FROM documents", f"FROM '{tmp_path}/documents/*.parquet'"))


@pytest.mark.parametrize("name", sorted(queries.oracle_sql()))
def test_sql(spark, compare, name):
    compare(queries.queries()[name](spark, SF), queries.oracle_sql()[name])
