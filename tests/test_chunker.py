"""The chunker by its three ways: natively where a section fits, in tasks, and as a table function."""

from pyspark.sql import functions as F

from lorebase.operators import chunking


def test_counters_and_ways_agree(spark):
    texts = ["short text", "(1) one two. three; four five\n(2) " + "word " * 40 + "\nExplanation. more", " ".join(f"w{i}." for i in range(90)), "x" * 100, "  ", None, "a b\n\nProvided that c d e f g h i j k l m n"]
    frame = spark.createDataFrame([(i, "Head: " if i % 2 else None, t) for i, t in enumerate(texts)], "id long, heading string, text string")
    rows = lambda df: sorted(map(tuple, df.select("id", "chunk_idx", "text", "token_count").collect()))
    letters = lambda: len  # noqa: E731  characters as tokens
    for ceiling in (12, 60):
        in_tasks = rows(chunking.chunk_sections(frame, ceiling, letters))
        assert rows(chunking.chunk_sections(frame, ceiling, letters, F.char_length)) == in_tasks
        assert all(n == len(("Head: " if i % 2 else "") + t) for i, _, t, n in in_tasks)
        chunking.register_chunker(spark, "by_letters", ceiling, letters)
        frame.createOrReplaceTempView("odd_sections")
        assert rows(spark.sql("SELECT id, c.chunk_idx, c.chunk AS text, c.token_count FROM odd_sections, LATERAL by_letters(heading, text) AS c")) == in_tasks
        words = chunking.chunk_sections(frame.fillna("", ["heading"]), ceiling)
        assert rows(words) == rows(chunking.chunk_sections(frame.fillna("", ["heading"]), ceiling, lambda: lambda t: len(t.split())))
    got = chunking.chunk_report(chunking.chunk_sections(frame.fillna("", ["heading"]), 12)).first()
    assert got["sections"] == 5 and got["split_sections"] == 3 and got["max_tokens"] == 12 and got["chunks"] > 10
    assert chunking.chunk_report(chunking.chunk_sections(frame.limit(0))).first()["chunks"] == 0


def test_words_are_counted_once():
    """Words of a long text without marks are looked at a few times, not once for each chunk that grows by one; headings may run on into the text."""
    seen = 0

    class Text(str):
        def split(self, *a):
            nonlocal seen
            seen += len(self)
            return [Text(x) for x in str.split(self, *a)]

    text = Text(" ".join(f"w{i}" for i in range(5000)))
    got = chunking._chunks(text, chunking._WordCounter("Head: "), 450)
    assert " ".join(x for _, x, _ in got) == text and all(n == 1 + len(x.split()) for _, x, n in got) and seen < 4 * len(text)
    for heading in (None, "", "Head", "Head ", " ", "a b"):
        for x in ("one", "one two three four five six", "(1) a b\n(2) c; d e f g h"):
            plain = chunking._Counter(heading, lambda t: len(t.split()))
            assert chunking._chunks(x, chunking._WordCounter(heading), 4) == chunking._chunks(x, plain, 4)
