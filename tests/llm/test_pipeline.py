"""The pipeline against the brute force of its stages."""

import corpus_pipeline
from tests.llm.test_minhash import brute
from tests.llm.test_tokens_packing_media import check_packs
from tracewright.llm.common import stored
from tests.llm.test_secrets_urls_mixing import base_spans

SMALL = "/root/testdata/sf0.001"


def test_stages(spark, small_docs):
    docs, stages = small_docs, dict(corpus_pipeline.STAGES)
    assert list(stages) == ["quality_rules", "near_dedup", "secret_scan", "mix_sources", "pack"]
    first = stored(stages["quality_rules"](spark, docs, SMALL), "t1")
    assert first.columns == docs.columns and 0 < first.count() < docs.count()
    second = stored(stages["near_dedup"](spark, first, SMALL), "t2")
    keep = {d for d, _, _, kept in brute([(r["doc_id"], r["text"]) for r in first.collect()]) if kept}
    assert {r["doc_id"] for r in second.collect()} == keep and second.columns == docs.columns
    third = stored(stages["secret_scan"](spark, second, SMALL), "t3")
    assert {r["doc_id"] for r in third.collect()} == keep and not any(base_spans(r["text"]) for r in third.collect())
    fourth = stored(stages["mix_sources"](spark, third, SMALL), "t4")
    assert sorted(map(tuple, fourth.collect())) == sorted(map(tuple, third.collect()))
    check_packs(fourth)
    whole = corpus_pipeline.run(spark, SMALL).collect()
    part = stages["pack"](spark, fourth, SMALL).collect()
    key = lambda r: (r["doc_id"], r["start"], r["length"], r["ids_crc32"])
    assert sorted(map(key, whole)) == sorted(map(key, part))


def test_an_empty_corpus(spark, no_docs):
    docs = no_docs
    for name, stage in corpus_pipeline.STAGES:
        docs = stored(stage(spark, docs, SMALL), f"empty-{name}")
        assert docs.count() == 0
