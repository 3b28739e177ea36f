"""Rows of a task follow neither the input nor what adaptive execution makes of it."""

from pyspark.sql import functions as F

from lorebase.operators import evaluation, graph, retrieval
from lorebase.sources.cluster import dealt


def most_in_a_task(df):
    return df.groupBy(F.spark_partition_id().alias("p")).count().agg(F.max("count")).first()[0]


def test_dealt_keeps_its_partitions(spark):
    rows = spark.range(100_000).select((F.col("id") % 5000).alias("k"))
    got = dealt(rows, 100_000, "k", share=5000).distinct()
    assert got.rdd.getNumPartitions() == 20 and most_in_a_task(got) < 500
    assert dealt(rows, 1, "k").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism


def test_bm25_sums_of_a_task_are_bounded(spark):
    word = lambda n: F.concat(F.lit("w"), (F.col("id") % n).cast("string"))
    docs = spark.range(4000).select("id", word(40).alias("text"))
    asked = spark.range(2500).select(F.col("id").alias("query_id"), word(50).alias("text"))
    got = retrieval.bm25(docs, asked)
    assert got.count() == 4000 * 50  # of 2500 questions, 50 ask for each word
    assert got.rdd.getNumPartitions() == 10  # of a million possible sums each
    assert retrieval.bm25(docs, asked, most_asked=10).rdd.getNumPartitions() == 10


def test_neighbours_of_a_task_are_bounded(spark):
    n = 700_000
    links = spark.range(n).select((F.col("id") % 1000).alias("from_section_id"), (F.col("id") % 997).alias("to_section_id"))
    links = links.unionByName(links.limit(10))
    sections = spark.range(990).select("id", F.col("id").cast("string").alias("section_no"), F.lit(1).alias("statute_id"))
    acts = spark.createDataFrame([(1, "Act")], "id int, short_title string")
    few, many = graph.related(links, sections, acts), graph.related(links, sections, acts, n)
    assert many.rdd.getNumPartitions() == 6  # of 250,000 neighbours each
    assert many.count() == few.count() == links.where("to_section_id < 990").distinct().count() + links.where("from_section_id < 990").distinct().count()
    assert many.exceptAll(few).count() == 0


def test_ranked_sections_of_a_task_are_bounded(spark):
    c = F.col("id")
    scored = spark.range(1_500_000).select((c % 300_000).alias("case_id"), F.expr("CAST(id / 300000 AS INT) * 7 % 3").alias("section_id"), (c % 11 / 2).alias("score"), c.cast("int").alias("line"))
    got = evaluation.section_ranks(scored)
    assert got.rdd.getNumPartitions() == 6 and most_in_a_task(got) < 250_000
    cases = spark.range(300_010).select("id", (c % 4).alias("expected_id"))
    out = evaluation.outcomes(cases, scored)
    assert out.count() == 300_010 and out.where("top_score IS NULL").count() == 10


def test_outcomes_of_odd_scores(spark):
    rows = [(1, 5, 0.5, 2), (1, 4, 0.5, 1), (1, 4, 0.9, 3), (1, 6, 0.9, 1), (1, 7, None, 1), (1, 3, float("nan"), 9), (2, 1, None, 1), (3, 1, 0.0, 1), (3, 0, -0.0, 2)]
    scored = spark.createDataFrame(rows, "case_id long, section_id long, score double, line int")
    ranks = {(r["case_id"], r["section_id"]): r["rank"] for r in evaluation.section_ranks(scored).collect()}
    assert ranks == {(1, 3): 1, (1, 4): 2, (1, 6): 3, (1, 5): 4, (1, 7): 5, (2, 1): 1, (3, 0): 1, (3, 1): 2}
    cases = spark.createDataFrame([(1, 7), (2, 9), (3, 1), (4, 1)], "id long, expected_id long")
    out = {r["id"]: (r["top_score"], r["first_correct"]) for r in evaluation.outcomes(cases, scored).where("id > 1").collect()}
    assert out == {2: (None, None), 3: (0.0, 2), 4: (None, None)}
