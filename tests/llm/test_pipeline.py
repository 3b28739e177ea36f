import tempfile
import zlib
from collections import Counter

import numpy as np

import corpus_pipeline
from lorebase.llm.toxicity import toxicity

from ..conftest import SF
from . import helpers as H


def test_stages_in_order():
    assert [name for name, _ in corpus_pipeline.STAGES] == ["toxicity", "near_dedup", "decontamination", "secrets", "packing"]
    assert corpus_pipeline.ORACLE_SQL is None


def test_pipeline_equals_brute_force(spark):
    """Every stage against a plain version of it, on what its predecessor kept."""
    import public_tokenizers as P
    from tokenizers import Tokenizer

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    columns, kept = docs.columns, {r["doc_id"]: r for r in docs.collect()}
    bad = {r["doc_id"] for r in toxicity(docs, spark.read.parquet(f"{SF}/labels.parquet")).where("predicted = 1").collect()}
    kept = {i: r["text"] for i, r in kept.items() if i not in bad}
    rows = sorted(kept.items())
    kept = {i: t for (i, t), (_, c) in zip(rows, H.components(rows), strict=True) if c is None or c == i}
    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    kept = {i: kept[i] for i, *_, hit in H.contamination(sorted(kept.items()), items) if not hit}
    masked = {}
    for i, text in kept.items():
        out, at = "", 0
        for a, _, b, _ in H.base_spans(text):
            if a >= at:
                out += text[at:a] + "[SECRET]"
            at = max(at, b)
        masked[i] = out + text[at:]

    seen, frame = {}, docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        path = f"{corpus_pipeline.shared_folder(spark)}/test-{name}"
        stage(spark, frame, SF).write.mode("overwrite").parquet(path)
        frame = spark.read.parquet(path)
        assert frame.columns == columns
        seen[name] = {r["doc_id"]: r for r in frame.collect()}
    assert set(seen["decontamination"]) == set(kept)
    got = {i: r["text"] for i, r in seen["secrets"].items()}
    weak = {i for i in got if got[i] != masked[i]}
    assert all(H.base_spans(got[i]) == [] or "[SECRET]" in got[i] for i in weak) and len(weak) <= len(got) // 20  # linked parts are masked besides
    assert all(r["n_chars"] == len(r["text"]) for r in seen["secrets"].values())

    t = Tokenizer.from_file(P.path("byte_bpe_50k.json"))
    packed = corpus_pipeline.run(spark, SF).collect()
    want = Counter()
    for i, text in got.items():
        ids = [*t.encode(text, add_special_tokens=False).ids, 0]
        first = len(ids) if len(ids) <= 2048 else len(ids) % 2048 or 2048
        cuts = [0, *range(first, len(ids) + 1, 2048)]
        want.update((i, k, zlib.crc32(np.array(ids[a:b], "<u4").tobytes())) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)))
    assert Counter((r["doc_id"], r["piece"], r["ids_crc32"]) for r in packed) == want


def test_pipeline_of_nothing(spark):
    frame = spark.read.parquet(f"{SF}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        assert stage(spark, frame, SF).count() == 0


def test_stages_tell_rows_apart_without_unique_ids(spark):
    """Null and repeated ids in every stage: only the rows at fault go, and one row of a group stays."""
    columns = ["doc_id", "text", "lang", "source", "n_chars", "_id", "_h", "_d", "_t", "_found", "_kept", "_row", "text_hash", "kept", "copies"]

    def words(seed, n=40):
        return " ".join(f"v{seed}x{(seed * 31 + k * k) % 997}" for k in range(n))

    def after(stage, rows, folder=SF):
        extra = tuple(range(1, 11))
        frame = spark.createDataFrame([(i, t, "en", "s", len(t or ""), *extra) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"{c} int" for c in columns[5:])).repartition(3)
        out = stage(spark, frame, folder)
        assert out.columns == columns
        assert all(tuple(r)[5:] == extra for r in out.collect())
        return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)

    clean = [(None, words(1)), (None, words(2)), (7, words(3)), (None, None), (7, ""), (None, "")]
    folder = tempfile.mkdtemp(prefix="lorebase-ids-")

    # Toxicity: ids 1000 and more teach the tagger.
    taught = [(1000 + i, words(100 + i) + (" vileness scummiest badword" if i % 4 == 0 else "")) for i in range(200)]
    spark.createDataFrame([(i, int("badword" in t)) for i, t in taught], "doc_id long, toxic int").write.parquet(f"{folder}/labels.parquet")
    toxic = [(None, words(4) + " vileness scummiest badword"), (7, words(5) + " vileness scummiest badword")]
    got = after(corpus_pipeline.drop_toxic, taught + clean + toxic, folder)
    assert [x for x in got if x[0] is None or x[0] < 1000] == sorted(clean, key=str)

    # Near-duplicates: copies by text with one id, with null ids only, with both, and near copies with one id.
    near = words(9)
    groups = [(8, words(6))] * 3 + [(None, words(7))] * 3 + [(None, words(8)), (3, words(8)), (4, words(8))] + [(5, near), (5, near + " end"), (None, near + " fin")]
    got = after(corpus_pipeline.drop_near_duplicates, clean + groups)
    five = [x for x in got if x[0] == 5]
    assert len(five) == 1 and five[0] in groups
    assert sorted(got, key=str) == sorted([*clean, (8, words(6)), (None, words(7)), (3, words(8)), *five], key=str)

    # Leaks.
    spark.createDataFrame([(1, words(11))], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    leaks = [(None, f"a {words(11)} b"), (7, f"c {words(11)}")]
    assert after(corpus_pipeline.drop_benchmark_leaks, clean + leaks, folder) == sorted(clean, key=str)

    # Secrets, and packing of all rows.
    secret = "token=" + "0123456789abcdef" * 2
    assert after(corpus_pipeline.mask_secrets, clean + [(None, secret), (7, secret), (7, secret)]) == sorted(clean + [(None, "[SECRET]"), (7, "[SECRET]"), (7, "[SECRET]")], key=str)
    frame = spark.createDataFrame(clean + groups, "doc_id long, text string")
    assert corpus_pipeline.pack(spark, frame, SF).count() == len(clean + groups)
