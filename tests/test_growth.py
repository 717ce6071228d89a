"""What keeps a query's cost in proportion to its input: expressions worked out once a row, no table at the driver."""

import json

from pyspark.sql import functions as F

from tracewright.functions import text
from tracewright.operators import accuracy, findings, payloads


def test_lists_are_read_once_a_row(spark):
    """A list's text is read by one pass over its tokens and cleaned once; before, each use of a list read it again (F1)."""
    plan = str(text.distinct_ignoring_case(text.as_list(F.col("x"))))
    assert plan.count("[A-Za-z_]+|") == 1
    rows = [("['a', \"A\", None, 'b; c', ('d',)]",), (None,), ("x;X; n/a ;y",), ("[a, b]",), ('{"k": 1}',), ("none",), ("[]",)]
    got = spark.createDataFrame(rows, "x string").select(text.distinct_ignoring_case(text.as_list(F.col("x"))).alias("v")).collect()
    assert [r.v for r in got] == [["a", "b; c", '["d"]'], [], ["x", "y"], ["[a", "b]"], ['{"k": 1}'], [], []]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_deduplication_joins_nothing(spark):
    """Counts and evidence of a group meet without a join, so no table of findings is broadcast (F2)."""
    rows = [("t", n, str(n), a, "TOOL" if n else "LLM", 0, 1, 0, "m", "f", "minor", f"Q  {n % 2}") for n in range(8) for a in (None, "b") if (n, a) != (7, "b")]
    raw = spark.createDataFrame(rows, "trace_id string, ord long, idx string, agent string, kind string, v int, c int, r int, metric_name string, failure_type string, severity string, quote string")
    out = findings.deduplicated(raw)
    assert "Join" not in plan_of(out)
    got = {(r.agent, r.quote_key): (r.occurrences, r.primary_idx, r.primary_kind, r.severity, r.seq.ord, [e.idx for e in r.evidence]) for r in out.collect()}
    even, odd = ["0", "2", "4", "6"], ["1", "3", "5", "7"]
    assert got == {
        (None, "q 0"): (4, "0", "LLM", "minor", 0, even), (None, "q 1"): (4, "1", "TOOL", "minor", 1, odd),
        ("b", "q 0"): (4, "0", "LLM", "minor", 0, even), ("b", "q 1"): (3, "1", "TOOL", "minor", 1, odd[:3]),
    }
    many = spark.createDataFrame([(*rows[0][:1], n, str(n), *rows[0][3:]) for n in range(9)], raw.schema)
    (one,) = findings.deduplicated(many).collect()
    assert (one.occurrences, [e.n for e in one.evidence], [e.idx for e in one.evidence]) == (9, [1, 2, 3, 4, 5], ["0", "1", "2", "3", "4"])


def test_costs_are_shuffled_once_a_call(spark):
    """A call is not written three times for the three grains; tasks are still counted once a grain, none for a null (F3)."""
    rows = [(1, "a", "x", 5, 1), (1, "a", "y", 7, 2), (1, "b", "x", 1, 1), (2, "a", None, 2, 4), (None, "a", "x", 3, 0), (2, None, "x", 1, 1)]
    out = accuracy.cost_rollup(spark.createDataFrame(rows, "task_id long, metric_name string, failure_reason string, tokens long, seconds long"))
    assert "Expand" not in plan_of(out)
    assert out.columns == ["grain", "metric_name", "failure_reason", "calls", "tokens", "seconds", "tasks"]
    assert {tuple(r) for r in out.collect()} == {
        ("total", None, None, 6, 19, 9, 2), ("metric", "a", None, 4, 17, 7, 2), ("metric", "b", None, 1, 1, 1, 1), ("metric", None, None, 1, 1, 1, 1),
        ("reason", None, "x", 4, 10, 3, 2), ("reason", None, "y", 1, 7, 2, 1), ("reason", None, None, 1, 2, 4, 1),
    }
    assert accuracy.cost_rollup(spark.createDataFrame([], "task_id long, metric_name string, failure_reason string, tokens long, seconds long")).isEmpty()


def test_statuses_are_parsed_once(spark):
    """A payload is parsed once, not once for each of its parts (F4)."""
    bodies = [
        '{"task_stats": {"wall_s": 2.5, "input_tokens": 3.9, "metrics_ok": 1}, "metric_status": {"a": {"status": "ok", "duration_s": 1.5}, "b": {"status": "failed", "reason": "lost", "output_tokens": 2}, "c": null}}',
        '{"task_stats": {}, "metric_status": {}}', '{"metric_status": {"a": {"status": null}}}', '{"task_stats": {"total_tokens": 4}', "none", None,
    ]
    out = accuracy.status_rollup(spark.createDataFrame([(str(i), b) for i, b in enumerate(bodies)], "file string, payload string"))
    assert plan_of(out).count("from_json") == 3
    assert {tuple(r) for r in out.collect()} == {
        ("total", None, 6, 1, 1, 0, 2.5, 3, 0, 0, 2.5, 0.0), ("metric", "a", 0, 0, 1, 1, 1.5, 0, 0, 0, None, None), ("metric", "b", 0, 0, 0, 1, 0.0, 0, 2, 0, None, None),
        ("metric", "c", 0, 0, 0, 1, 0.0, 0, 0, 0, None, None), ("reason", "lost", 0, 0, 0, 1, 0.0, 0, 0, 0, None, None), ("reason", "error", 0, 0, 0, 2, 0.0, 0, 0, 0, None, None),
    }
    assert accuracy.status_rollup(spark.createDataFrame([], "file string, payload string")).isEmpty()


def test_reports_are_built_of_payloads_once(spark, monkeypatch):
    """Payloads are parsed and stored once for their findings, their reports and the text that these are written into (F5)."""
    calls, opened = [], payloads.opened
    monkeypatch.setattr(payloads, "opened", lambda rows: calls.append(1) or opened(rows))
    body = '{"m": {"metric_name": "m", "findings": [{"severity_estimate": "major"}]}, "note": 1}'
    (row,) = payloads.with_reports(spark.createDataFrame([("a_1.json", body)], "file string, payload string")).collect()
    assert len(calls) == 1
    got = json.loads(row.payload)
    assert got["note"] == 1 and got["report"]["status"]["diagnostic_status"]["verdict"] == "needs_review"


def test_collapse_broadcasts_nothing(spark):
    """Small as its tables are here, no join of a chain collapse goes through the driver (F6)."""
    spans = spark.createDataFrame([("t", "0", None), ("t", "1", "0"), ("t", "2", "1"), ("u", "0", None)], "trace_id string, idx string, parent string")
    pairs = spark.createDataFrame([("t", "2", "0"), ("t", "0", "2"), ("u", "0", "0")], "trace_id string, low string, high string")
    out = findings.above(pairs, spans)
    assert {tuple(r) for r in out.collect()} == {("t", "2", "0")}
    assert "BroadcastHashJoin" not in out._jdf.queryExecution().executedPlan().toString()
