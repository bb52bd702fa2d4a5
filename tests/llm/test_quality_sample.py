"""The lines that the fit of the line labels may see are bounded, whatever texts hold."""

from pyspark.sql import functions as F

from ledgerlake.llm import quality


def test_lines_are_bounded(spark):
    docs = spark.range(40).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 4 == 0, F.repeat(F.lit("\n"), 5000)).otherwise("one\ntwo\nthree").alias("text"), (F.col("id") % 2).cast("int").alias("y"))
    few = quality._few_lines(docs, 60)
    lines = {r["y"]: r["n"] for r in few.groupBy("y").agg(F.sum(F.regexp_count("text", F.lit("\n")) + 1).alias("n")).collect()}
    assert all(n <= 60 for n in lines.values()) and lines[1] == 60
    assert quality._few_lines(docs, 10**9).count() == 40


def test_texts_of_line_ends_train(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 2 == 0, F.repeat(F.lit("x|y\n"), 16_000)).otherwise("A plain line of words.\nAnd another one.").alias("text"))
    labels = docs.select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"), F.lit(0).alias("toxic"))
    rows = quality.quality_scores(docs, labels).collect()
    assert len(rows) == 300 and all((r["score"] > 0.5) == (r["doc_id"] % 2 == 1) for r in rows)
