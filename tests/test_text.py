from pyspark.sql import functions as F

from lorebase.functions import text as T
from lorebase.operators import evaluation, graph, retrieval
from lorebase.operators.chunking import chunk_sections, split_section
from lorebase.streaming.streams import guard_step

ORDER = "1 2 2A 2AA 2B 3 4 9 10 11 13 13A 14 14A 14B 20 21 21A 21B 22 45 45Z 45ZA 45ZF 46 99 100 101 299 371 372A 470".split()


def one(spark, expr):
    return spark.range(1).select(expr).first()[0]


def test_section_order_and_keys(spark):
    df = spark.createDataFrame([(x,) for x in reversed(ORDER)], "no string")
    assert [r["no"] for r in df.orderBy(T.section_no_sort(F.col("no"))).collect()] == ORDER
    for raw, key in (("9", "000009|"), ("10", "000010|"), ("2A", "000002|A   |"), ("45ZF", "000045|ZF  |")):
        assert one(spark, T.section_no_sort(F.lit(raw))) == key
    assert len({one(spark, T.section_no_sort(F.lit(x))) for x in ("21A", "21-A", "21 A", "21.A", "21a", "  21-a  ")}) == 1
    for bad in ("", "  ", "—", "()", "…", "1234567", "1ABCDE"):
        assert one(spark, T.section_no_sort(F.lit(bad))) is None
    assert one(spark, T.section_no_sort(F.lit("0000000012"))) == "000012|"


def test_citations(spark):
    assert one(spark, T.cited_ids(F.lit("a [S1046] b [S18(1)(d), S1107] c [S19(c)] [2] [State Government] S5"))) == [18, 19, 1046, 1107]
    assert one(spark, T.cited_ids(F.lit("none"))) == []


def test_references(spark):
    text = "Subject to sub-section (2) of section 14 and to section 23, and to section 111 of the Indian Evidence Act, 1872, and to Chapter IV."
    refs = graph.extract_references(spark.createDataFrame([(1, 1, text)], "id long, statute_id long, text string"))
    sections = spark.createDataFrame([(101, 1, "14"), (102, 1, "23")], "id long, statute_id long, section_no string")
    statutes = spark.createDataFrame([(1, "Indian Contract Act, 1872")], "id long, short_title string")
    rows = graph.resolve_references(refs, sections, statutes).collect()
    assert {r["to_id"] for r in rows if r["reason"] is None} == {101, 102}
    assert {r["reason"] for r in rows if r["reason"]} == {"act_not_in_corpus", "no_part_hierarchy"}


def test_references_looked_up_or_expanded(spark):
    """The same edges whether acts and lists are few or many; null acts, ranges, repeats and null own statutes included."""
    texts = [
        (1, 1, "See sections 3, 5 and 7 to 9 of the Sale Act, 1930; s. 14 and Part II apply."), (2, 1, "See sections 3, 5 and 7 to 9."), (2, 1, "See sections 3, 5 and 7 to 9."),
        (3, None, "Under section 14 and section 3 of the Other Law, 1900."), (4, 2, None), (5, 2, ""), (6, 2, "ss. 3 to 40 and section 21A"),
    ]
    refs = graph.extract_references(spark.createDataFrame(texts, "id long, statute_id long, text string"))
    sections = spark.createDataFrame([(1, 1, "3"), (2, 1, "14"), (8, 2, "8"), (9, 2, "21-A"), (10, 2, "3")], "id long, statute_id long, section_no string")
    statutes = spark.createDataFrame([(1, "Code A Act, 1807"), (2, "Sale Act, 1930")], "id long, short_title string")
    few, many = (sorted(map(str, graph.resolve_references(refs, sections, statutes, most_lists=n).collect())) for n in (100, 0))
    assert few == many and len(few) > 20
    edges = {(r["id"], r["no"], r["to_id"]) for r in graph.resolve_references(refs, sections, statutes).where("reason IS NULL").collect()}
    assert edges == {(1, "3", 10), (1, "8", 8), (1, "14", 2), (2, "3", 1), (6, "3", 10), (6, "21A", 9)}


def test_longest_title(spark):
    statutes = spark.createDataFrame([(1, "Code A Act, 1807"), (2, "A Act"), (3, "The Sale Act, 1930")], "id long, short_title string")
    phrases = spark.createDataFrame([("the Code A Act, 1807",), ("Amended Code A Act, 1807",), ("Sale Act, 1930",), ("Other Law, 1900",), (None,)], "act string")
    want = {"the Code A Act, 1807": 1, "Amended Code A Act, 1807": 1, "Sale Act, 1930": 3, "Other Law, 1900": None}
    assert {r["phrase"]: r["statute_id"] for r in graph.resolve_titles(phrases, statutes).collect()} == want


def test_ranges(spark):
    df = spark.createDataFrame([("3 to 9",), ("3 to 300",), ("1, 2A and 4",), ("5 to 5",)], "numbers string")
    got = [r["no"] for r in graph.expand_numbers(df).collect()]
    assert got == [*map(str, range(3, 10)), "3", "300", "1", "2A", "4", "5", "5"]


def test_rrf(spark):
    d = spark.createDataFrame([(1, 2, 1), (1, 1, 2)], "query_id long, id long, rank int")
    s = spark.createDataFrame([(1, 3, 1), (1, 1, 2)], "query_id long, id long, rank int")
    rows = retrieval.rrf(d, s).orderBy("rank").collect()
    assert [r["id"] for r in rows][0] == 1 and {r["id"] for r in rows} == {1, 2, 3}
    assert (rows[0]["dense_rank"], rows[0]["sparse_rank"]) == (2, 2)


def test_gate(spark):
    rows = [(1, i, s) for i, s in enumerate((0.29, 0.11, 0.04))] + [(2, 0, 0.30)] + [(3, i, s) for i, s in enumerate((0.91, 0.62, 0.31, 0.29, 0.02))] + [(4, i, 0.9) for i in range(20)]
    scored = spark.createDataFrame(rows, "query_id long, id long, score double")
    out = {r["query_id"]: r for r in retrieval.gate(scored, spark.range(6).toDF("query_id"), 0.30, 6).collect()}
    assert out[0]["reason"] == "no_candidates" and out[1]["reason"] == "below_score_floor" and out[1]["top_score"] == 0.29
    assert out[2]["passed"] and out[3]["n_kept"] == 3 and out[4]["n_kept"] == 6


def test_pack(spark):
    rows = [(1, 3, "cross_reference", None, "Registration", "0009", 10), (1, 1, "retrieved", 0.9, "Contract", "0023", 20), (1, 2, "retrieved", 0.8, "Contract", "0010", 20)]
    df = spark.createDataFrame(rows, "query_id long, section_id long, origin string, score double, title string, sort string, tokens long")
    order = lambda budget: [r["section_id"] for r in retrieval.pack(df, budget).orderBy("pos").collect()]
    assert order(10_000) == [2, 1, 3] and order(20) == [1] and order(1) == [1] and order(30) == [1, 3]


def test_ranking_and_percentiles(spark):
    scored = spark.createDataFrame([(1, 9, 0.9, 1), (1, 7, 0.8, 2), (1, 9, 0.7, 3), (1, 7, 0.6, 4), (1, 5, 0.5, 5)], "case_id long, section_id long, score double, line int")
    assert [r["section_id"] for r in evaluation.section_ranks(scored).orderBy("rank").collect()] == [9, 7, 5]
    values = spark.range(1, 101).toDF("ms")
    assert {r["pct"]: r["value"] for r in evaluation.percentiles(values, "ms", [0, 50, 95, 100]).collect()} == {0: 1, 50: 51, 95: 95, 100: 100}
    assert evaluation.percentiles(values.where("ms < 0"), "ms", [50]).first()["value"] == 0


def test_chunks_lose_nothing(spark):
    body = "\n".join(f"({i}) " + " ".join(f"w{i}x{j}" for j in range(60)) for i in range(1, 12))
    for text in (body, "one " * 3000, "x" * 5000, "Provided that a. Provided b; c:"):
        parts = split_section(text, lambda t: len(t.split()) <= 450)
        assert " ".join(parts).split() == text.split() and all(len(p.split()) <= 450 for p in parts)
    df = spark.createDataFrame([(1, "passage: A. ", body), (2, "passage: A. ", "short"), (3, "passage: A. ", " ")], "id long, heading string, text string")
    rows = chunk_sections(df).orderBy("id", "chunk_idx").collect()
    assert [r["chunk_idx"] for r in rows if r["id"] == 1] == [0, 1] and {r["id"] for r in rows} == {1, 2} and max(r["token_count"] for r in rows) <= 450


def test_markup(spark):
    html = "<p>a&eacute; &#8212;&rsquo;&mdash; &#x1F600; &amp;lt; &#150; &bogus; &#0; 3 < 4</p><!-- <p>x --><sup>1</sup>b<sup></sup><br/>c&nbsp;d"
    assert one(spark, T.html_to_text(F.lit(html))) == "aé —’— 😀 < – &bogus; \ufffd 3 < 4\n[1]b\nc d"


def test_notes_and_omissions(spark):
    notes = lambda t: [tuple(x) for x in one(spark, T.footnotes(F.lit(t)))]
    assert notes("[1] . a\n100. b\n2. c") == [("1", "a\n100. b"), ("2", "c")] and notes("x") == [("", "x")]
    says = lambda t: one(spark, T.amendment_note(T.footnotes(F.lit(t)))) is not None
    assert [says(t) for t in ("Substituted by Act 3 of 1951", "Inserted, w.e.f. 1-1-1990", "vide notification 5", "Fee added up", "report")] == [True, True, True, False, False]
    gone = lambda note, body: one(spark, T.looks_omitted(F.lit(note), F.lit(body)))
    assert gone("[Repealed.].", "x") and gone("x", "[1] [Decree of foreclosure suit, and whatever else there was to be said of it at length.] Rep. by the Code")
    assert not gone("x", "The Indian Act, 1882, is hereby repealed.") and not gone(None, "live")


def test_segments(spark):
    text = "head\n( 1 ) a\n (2a) b Provided c\nExceptional d\nExplanation e\n(123) f"
    assert one(spark, T.segments(F.lit(text))) == ["head", "( 1 ) a", "(2a) b", "Provided c\nExceptional d", "Explanation e\n(123) f"]
    assert [one(spark, T.segment_label(F.lit(x))) for x in ("( 1 ) a", "(2a) b", "Exception x", "z")] == ["(1)", "(2a)", "Exception", "body"]


def test_chunk_boundaries(spark):
    """A segment that doesn't fit closes the chunk before it and leaves its last part open for what follows."""
    text = "(1) a b\n(2) c d e; f g h; i\n(3) j"
    assert split_section(text, lambda t: len(t.split()) <= 5) == ["(1) a b", "(2) c d e;", "f g h; i", "(3) j"]
    assert split_section(text, lambda t: len(t.split()) <= 6) == ["(1) a b", "(2) c d e;", "f g h; i\n(3) j"]
    frame = spark.createDataFrame([(1, "p: ", text)], "id long, heading string, text string")
    rows = chunk_sections(frame, 25, lambda: len).orderBy("chunk_idx").collect()
    assert all(r["token_count"] == 3 + len(r["text"]) <= 25 for r in rows) and " ".join(r["text"] for r in rows).split() == text.split()


def test_questions_of_stop_words_match_nothing(spark):
    docs = spark.createDataFrame([(1, "the cat of the house"), (2, "a dog")], "id long, text string")
    asked = spark.createDataFrame([(1, "what is the of"), (2, "which cat is a dog")], "query_id long, text string")
    assert {(r["query_id"], r["id"]) for r in retrieval.bm25(docs, asked).collect()} == {(2, 1), (2, 2)}


def test_stream_guard_step():
    import pandas as pd

    class State:
        exists, get = False, None

        def update(self, value):
            self.exists, self.get = True, value

    def run(*deltas):
        df = pd.DataFrame({"seq": range(len(deltas)), "delta": deltas, "allowed": [[1046, 537]] * len(deltas)})
        return [n for out in guard_step((1,), iter([df]), State()) for n in out["name"]]

    assert run("[S", "1", "0", "4") == ["token"] * 4
    assert run("[S1046", "]", " x") == ["token"] * 3
    assert run("[S9999, S10", "46]", " x") == ["token", "invalidated"]
    assert run("see [S9999]") == ["invalidated"]


def test_references_as_html_has_them(spark):
    import html

    texts = ["&copy 2020", "&copy2020", "&copy;2020", "&nbsp&nbsp;x", "&notit;", "&notin; &not in", "&amp;lt;", "&ampamp;", "&#169 &#169; &#xA9 &#Xa9;x", "&#150;&#x96 &#x110000; &#0; &#99999999999;", "&bogus; & &; &a; A&B AT&T;", "&frac12 &frac123", "&hellip;&mdash", "no reference", "", "&Eacute&eacute;", "&lt&gt", "&quot;a&quot"]
    frame = spark.createDataFrame(list(enumerate(texts)), "i int, t string")
    got = [r["t"] for r in frame.orderBy("i").select(T.decode_references(F.col("t")).alias("t")).collect()]
    assert got == [html.unescape(t) for t in texts]


def test_titles_by_their_heads(spark):
    """Against all pairs: titles within others, in the middle of words, of one letter, none at all, and ties."""
    import random

    from lorebase.operators import graph

    r = random.Random(8)
    words = ["code", "penal", "act", "the", "a", "of", "tax", "land"]
    titles = [(i, " ".join(r.choice(words) for _ in range(r.randrange(1, 6)))) for i in range(60)] + [(100, "the"), (101, "Z"), (102, "Code Penal"), (103, "code  penal")]
    phrases = [" ".join(r.choice(words) for _ in range(r.randrange(1, 9))) for _ in range(80)] + ["xcode penalx", "buzz", "", "The", None, "nothing known here"]
    norm = lambda t: " ".join(w for w in t.lower().split() if w != "the")
    known = [(i, norm(t)) for i, t in titles if norm(t)]

    def plain(p):
        met = [(norm(p) == t, len(t), -i) for i, t in known if t in norm(p)]
        return -max(met)[2] if met else None

    frame = spark.createDataFrame([(p,) for p in phrases], "act string")
    got = {x["phrase"]: x["statute_id"] for x in graph.resolve_titles(frame, spark.createDataFrame(titles, "id long, short_title string")).collect()}
    assert got == {p: plain(p) for p in phrases if p is not None}
    assert {x["statute_id"] for x in graph.resolve_titles(frame, spark.createDataFrame([], "id long, short_title string")).collect()} == {None}


def test_control_characters_cut_nothing(spark):
    """Texts may hold any character: only markers cut."""
    odd = "a\u0001b\u0002c"
    assert [tuple(x) for x in one(spark, T.footnotes(F.lit(f"before\n1. {odd} d\n[2]. {odd}")))] == [("1", f"{odd} d"), ("2", odd)]
    assert [tuple(x) for x in one(spark, T.footnotes(F.lit(odd)))] == [("", odd)]
    assert one(spark, T.segments(F.lit(f"{odd}\n\n (1) x{odd} Provided that y\nExplanation z, Providedly"))) == [odd, f"(1) x{odd}", "Provided that y", "Explanation z, Providedly"]
    assert one(spark, T.segments(F.lit("(1) a\n(2A) b"))) == ["(1) a", "(2A) b"]
