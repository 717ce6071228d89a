"""Mixing with a source per site."""

from collections import Counter

from pyspark.sql import functions as F

from tests.llm.test_secrets_urls_mixing import check_mix
from tracewright.llm import mixing


def test_more_sources_than_are_broadcast(spark):
    """One source with a third of the rows, 700 of various sizes and the null source."""
    site = F.concat(F.lit("s"), (F.col("id") % 700).cast("string"))
    docs = spark.range(12_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "big").when(F.col("id") % 1000 == 1, None).otherwise(site).alias("source"))
    docs = docs.where("source IS NULL OR source = 'big' OR doc_id < 2000 + 40 * CAST(substring(source, 2) AS INT)")
    assert docs.select("source").distinct().count() > 600
    got = check_mix(docs, block_docs=2)
    assert mixing.mixed(docs).count() == docs.count()
    # The big source keeps the share of its weight while all sources last.
    sizes = Counter(r["source"] for r in got)
    weights = {s: n**mixing.SMOOTHING for s, n in sizes.items()}
    share = mixing.quantised(weights, 2 * len(sizes))
    first = {r["slot"]: r["source"] for r in got if r["phase"] == 0}
    assert abs(Counter(first.values())["big"] - len(first) * share["big"] / (2 * len(sizes))) < 1
    assert share["big"] > 10


def test_both_ways_place_alike(spark, small_docs, monkeypatch):
    columns = ("doc_id", "source", "block", "phase", "slot", "release", "deadline", "position")
    want = sorted(map(tuple, mixing.pfair_mix(small_docs, block_docs=3).select(*columns).collect()))
    monkeypatch.setattr(mixing, "PLAN_ROWS", 500)
    phases = mixing.pfair_phases
    blocks = {r["source"]: -(-r["n"] // 3) for r in small_docs.groupBy("source").agg(F.count("*").alias("n")).collect()}
    sizes = {r["source"]: r["count"] for r in small_docs.groupBy("source").count().collect()}
    plan = mixing.plan_table(spark, phases(blocks, {s: n**mixing.SMOOTHING for s, n in sizes.items()}, mixing.QUANTA))
    got = mixing.placed_by_blocks(mixing.numbered(small_docs, 3, len(sizes)), plan, 3).select(*columns)
    assert sorted(map(tuple, got.collect())) == want
