"""Rows without an id, repeated rows, nulls everywhere and columns with clashing names."""

import pytest

from tracewright.llm import fm, langid, media, minhash, mixing, packing, quality, resampling, secrets, tokens, toxicity, urls, variants
from tracewright.llm.common import salted_left_join
from tracewright.llm.queries import tokenizer

from .test_variants import check as check_variants

TEXT = "one two three four five six seven eight nine ten and so on with the token = abcdefghijklmnopq end"
NAMES = "doc_id long, text string, lang string, source string, n_chars long, block int, spans string, seq string, row string, bucket int, shard int, _found string"
MORE = (1, "x", "y", "z", 2, 3, "f")


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(None, TEXT, "en", None, None), (None, TEXT, "en", "a", 5), (3, None, None, "a", None), (4, TEXT, "en", "a", 5), (4, TEXT, "en", "a", 5), (5, TEXT + " more", "en", "b", 5), (None, TEXT + " more", "en", "b", 5)]
    return spark.createDataFrame([r + MORE for r in rows], NAMES)


@pytest.fixture(scope="module")
def labels(spark, small_labels):
    return small_labels.unionByName(spark.createDataFrame([(None, 1, 1), (4, None, 1), (5, 1, None)], "doc_id long, quality int, toxic int"))


def test_one_row_a_document(docs, labels):
    results = [
        media.media_report(docs), quality.quality_report(docs, labels), tokens.count_tokens(docs, tokenizer("word_bpe_49k.json"))[0], toxicity.toxicity_report(docs, labels),
        mixing.pfair_mix(docs), fm.quality_scores(docs, labels), minhash.near_duplicates(docs), secrets.secrets_report(docs),
        langid.language_report(docs), resampling.resampled(docs, docs),
        packing.packed(docs, tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken")),
    ]
    for df in results:
        assert sorted(r["doc_id"] or 0 for r in df.collect()) == [0, 0, 0, 3, 4, 4, 5]


def test_stages_keep_rows_and_columns(docs, labels):
    for df in (secrets.redacted(docs), mixing.mixed(docs)):
        assert df.columns == docs.columns and df.count() == 7
    assert secrets.redacted(docs).where("text LIKE '%SECRET%' AND text NOT LIKE '%abcdefgh%'").count() == 6
    near = {(r["doc_id"], r["component_id"], r["kept"]) for r in minhash.near_duplicates(docs).collect()}
    assert near == {(None, None, True), (3, 3, True), (4, 4, True), (5, 4, False)}
    kept = minhash.without_near_copies(docs)
    assert kept.columns == docs.columns and kept.where("doc_id = 5").count() == 0 and kept.count() == 6
    assert quality.kept_documents(docs, labels).columns == docs.columns


def test_words_of_rows_without_an_id(docs):
    check_variants(docs.where("doc_id IS NULL"))
    check_variants(docs)


def test_a_capture_without_an_id_is_judged(spark):
    """Null and repeated ids, null urls and dates, and one capture that is half of all rows."""
    rows = [(None, "http://bad.example/x", "2024-02-01"), (None, "http://bad.example/y", "2023-01-01"), (1, None, "2024-02-01"), (1, "http://sub.bad.example/", None), (1, "http://sub.bad.example/", "2024-02-01")] + [(2, "http://bad.example/", "2024-03-01")] * 400
    caps = spark.createDataFrame(rows, "page_id long, url string, day string").selectExpr("page_id", "url", "to_date(day) AS fetched_on", "7 AS bucket", "'x' AS domain", "1 AS n_active")
    entries = spark.createDataFrame([("ads", "bad.example", "2024-01-15", "add")], "list string, domain string, day string, action string").selectExpr("list", "domain", "to_date(day) AS on_date", "action")
    got = urls.temporal_list_join(caps, entries).collect()
    assert sorted((r["page_id"] or 0, r["url"] or "", str(r["fetched_on"]), r["n_active"], r["blocked"]) for r in got) == sorted(
        (p or 0, u or "", str(d), n, n > 0) for (p, u, d), n in zip(rows, [1, 0, 0, 0, 1] + [1] * 400, strict=True)
    )


def test_rows_alike_in_all_columns_are_spread(spark):
    """A third of all rows repeat one row: they go to many partitions, and all join."""
    left = spark.range(3000).selectExpr("CASE WHEN id % 3 = 0 THEN 7 ELSE id END AS doc_id", "CASE WHEN id % 3 = 0 THEN 'hot' ELSE concat('k', id) END AS key")
    right = spark.createDataFrame([("hot", 1), ("k1", 2)], "key string, v int")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        joined = salted_left_join(left, right, "key")
        parts = joined.where("key = 'hot'").selectExpr("spark_partition_id() AS p", "v").groupBy("p").count().collect()
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    assert joined.count() == 3000 and joined.where("v = 1").count() == 1000 and joined.where("v = 2").count() == 1
    assert len(parts) == int(spark.conf.get("spark.sql.shuffle.partitions"))


def test_redaction_of_a_text_that_most_rows_have(spark):
    rows = [(None if i % 5 == 0 else i % 7, "password = abcdefghijklmnop end") for i in range(900)] + [(i, f"clean {i}") for i in range(300)]
    got = secrets.redacted(spark.createDataFrame(rows, "doc_id long, text string").selectExpr("*", "1 AS _salt", "'b' AS _blob", "'x' AS _hot"))
    assert got.columns == ["doc_id", "text", "_salt", "_blob", "_hot"] and got.count() == 1200
    assert {r["text"] for r in got.where("text NOT LIKE 'clean%'").collect()} == {"[SECRET] end"}


def test_long_words_are_not_kept():
    path = tokenizer("word_bpe_49k.json")
    tokens.counted(["x" * 500 + " short"], path)
    packing.encoded(["y" * 500 + " short"], tokenizer("byte_bpe_50k.json"), tokenizer("byte_bpe_50k.tiktoken"))
    assert max(map(len, tokens._memo)) <= tokens.MEMO_LETTERS and max(map(len, packing._memo)) <= packing.MEMO_LETTERS
