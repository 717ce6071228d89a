"""The bound on labelled rows."""

from pyspark.sql import functions as F

from tracewright.llm import labelled


def test_one_row_for_each_chosen_id_that_has_a_document(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.concat(F.lit("text "), F.col("id").cast("string")).alias("text"))
    often = spark.range(500).select(F.explode(F.array(*[F.lit(i).cast("long") for i in (3, 5, 6)])).alias("doc_id"), F.concat(F.lit("again "), F.col("id").cast("string")).alias("text"))
    labels = spark.range(3000).select(F.col("id").alias("doc_id"), (F.col("id") % 2).alias("quality"), (F.col("id") % 3).alias("toxic"))
    got = [r["doc_id"] for r in labelled.sample(docs.union(often), labels, 50).collect()]
    assert len(got) == len(set(got)) == 50
    whole = [r["doc_id"] for r in labelled.sample(docs.union(often), labels, 1000).collect()]
    assert sorted(whole) == sorted(r["doc_id"] for r in docs.where(~labelled.held_out(F.col("doc_id"))).collect())
