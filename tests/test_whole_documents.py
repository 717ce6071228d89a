"""The document scan reads texts to their end."""

from tracewright.plans import queries


def test_findings_behind_the_span_cap_count(spark, tmp_path):
    rows = [(0, "x " * 40_000 + "bad request", "en", "s"), (1, '{"a": ' + "1" * 60_000, "en", "s"), (2, '{"a": "' + "b" * 60_000 + '"}', "en", "s"), (3, "y " * 40_000, "en", "s")]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    got = {r["failure_type"]: r["n"] for r in queries.q_document_scan(spark, str(tmp_path)).collect()}
    short = [(i, t.replace("x " * 40_000, "x "), *rest) for i, t, *rest in rows[:1]] + [(1, '{"a": 1', "en", "s")]
    spark.createDataFrame(short, "doc_id long, text string, lang string, source string").write.parquet(f"{tmp_path}/short/documents.parquet")
    want = {r["failure_type"]: r["n"] for r in queries.q_document_scan(spark, f"{tmp_path}/short").collect()}
    assert got == want and len(want) == 2
