"""The mixed order reaches the packed sequences."""

from collections import Counter

import corpus_pipeline
from pyspark.sql import functions as F

from tests.llm.conftest import DOCS, SMALL
from tracewright.llm import mixing


def test_sequences_follow_the_mix(spark):
    """b has a tenth of a's documents, more than a tenth of the weight, and so runs dry: sequences show the schedule's shares."""
    # Some 700 ids a document: a sequence opens with one and holds two.
    rows = [(i, " ".join(f"w{(i * 31 + k * 7) % 997}" for k in range(190)), "en", "b" if i % 11 == 0 else "a", 0) for i in range(22_000)]
    docs = spark.createDataFrame(rows, DOCS).repartition(8)
    source = {r[0]: r[3] for r in rows}
    rows = corpus_pipeline.pack(spark, docs, SMALL).collect()
    place = {r["doc_id"]: r["position"] for r in mixing.pfair_mix(docs.select("doc_id", "source")).collect()}
    assert {r["doc_id"] for r in rows} == set(place)
    shards = {}
    for r in rows:
        shards.setdefault(r["sequence_id"] >> 32, []).append(place[r["doc_id"]])
    # Shards are consecutive ranges of the schedule.
    ends = [(min(p), max(p)) for _, p in sorted(shards.items())]
    assert len(ends) > 2 and all(a[1] <= b[0] for a, b in zip(ends, ends[1:]))
    # Shares of consecutive sequences are those of the schedule at the same place.
    by_place = sorted(place, key=place.get)
    by_sequence = [r["doc_id"] for r in sorted(rows, key=lambda r: (r["sequence_id"], r["offset"]))]
    by_sequence = list(dict.fromkeys(by_sequence))
    for at in range(0, 22_000, 2_000):
        want = Counter(source[d] for d in by_place[at : at + 2_000])["b"]
        got = Counter(source[d] for d in by_sequence[at : at + 2_000])["b"]
        assert abs(want - got) <= 100, (at, want, got)


def test_repeated_rows_are_placed_one_by_one(spark, odd_docs):
    rows = corpus_pipeline.pack(spark, odd_docs, SMALL)
    assert rows.where(F.col("start") == 0).count() == odd_docs.count()


def test_nothing_packs_to_nothing(spark, no_docs):
    assert corpus_pipeline.pack(spark, no_docs, SMALL).count() == 0
