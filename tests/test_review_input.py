"""What a confirming model is shown, the roll-up of stored status maps, and the tally of a folder."""

import json

import pytest

from tracewright.operators import accuracy, findings
from tracewright.sources import traces

FINDING = "trace_id string, finding_id string, metric_name string, failure_type string, explanation string, evidence array<struct<idx:string,quote:string>>, primary_idx string"


def test_each_text_once_raw_beside_stripped(spark):
    leaf = {"span_id": "c", "span_name": "leaf", "span_attributes": {"output.value": "prose", "openinference.span.kind": "LLM"}}
    tree = {"spans": [{"span_id": "a", "span_name": "root", "trace_state": "", "child_spans": [{"span_id": "b", "span_name": "mid", "child_spans": [leaf]}, "bare"]}]}
    df = spark.createDataFrame([("t", json.dumps(tree))], "trace_id string, payload string")
    rows = [("t", f"F{i}", "m", "f", "why", [(k, f"q{i}")] if k else [], k) for i, k in enumerate(["b", "c", "gone", None] + ["b"] * 8)] + [("u", "F0", "m", "f", "why", [("z", "q")], "z")]
    shown = findings.review_input(spark.createDataFrame(rows, FINDING), traces.spans_of(df), traces.raw_texts(df), radius=1)
    got = {r["trace_id"]: r for r in shown.collect()}
    t = got["t"]
    assert [(f["finding_id"], f["quote"], f["current_idx"], f["candidate_idxs"]) for f in t["findings"][:4]] == [("F0", "q0", "b", ["a", "b", "c"]), ("F1", "q1", "c", ["b", "c", "3"]), ("F2", "q2", "gone", ["gone"]), ("F3", None, None, [])]
    assert [f["finding_id"] for f in t["findings"]] == [f"F{i}" for i in range(12)]
    assert [(s["idx"], s["stripped"]) for s in t["spans"]] == [("a", "root"), ("b", "mid"), ("c", "leaf LLM"), ("3", "bare")]
    assert [json.loads(s["text"]) for s in t["spans"][2:3]] == [leaf] and t["spans"][3]["text"] == "bare" and "prose" not in t["spans"][1]["text"]
    assert got["u"]["spans"] == [] and got["u"]["findings"][0]["candidate_idxs"] == ["z"]
    assert [s["text"] for s in findings.review_input(spark.createDataFrame(rows[:1], FINDING), traces.spans_of(df)).first()["spans"]] == ["root", "mid", "leaf LLM", "bare"]


def test_status_maps(spark):
    payloads = [
        {"task_stats": {"wall_s": 2.5, "total_tokens": 10, "metrics_ok": 1}, "metric_status": {"a": {"status": "ok", "duration_s": 1.5}, "b": {"status": "failed", "reason": "slow", "input_tokens": 4}}},
        {"task_stats": {}, "metric_status": {"a": {"reason": None}}}, {"metric_status": None}, {"task_stats": {"wall_s": None, "total_tokens": 5}},
    ]
    df = spark.createDataFrame([(str(i), json.dumps(p)) for i, p in enumerate(payloads)] + [("x", "{cut"), ("y", None)], "file string, payload string")
    got = {(r["grain"], r["name"]): r for r in accuracy.status_rollup(df).collect()}
    total = got["total", None]
    assert (total["files"], total["files_with_stats"], total["ok"], total["failed"], total["seconds"], total["avg_seconds"], total["avg_tokens"]) == (6, 2, 1, 0, 2.5, 1.25, 7.5)
    assert {k: (r["ok"], r["failed"], r["seconds"], r["input_tokens"]) for k, r in got.items() if k[0] != "total"} == {("metric", "a"): (1, 1, 1.5, 0), ("metric", "b"): (0, 1, 0.0, 4), ("reason", "slow"): (0, 1, 0.0, 0), ("reason", "error"): (0, 1, 0.0, 0)}
    assert accuracy.status_rollup(df.limit(0)).count() == 0


def test_tally(spark, tmp_path):
    for name, text in {"a/1.json": "{}", "a/2.json": "{cut", "b/3.json": "[1]"}.items():
        (tmp_path / "in" / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / "in" / name).write_text(text)
    (tmp_path / "none").mkdir()
    read = traces.required(traces.read_traces(spark, f"{tmp_path}/in", recursive=True), "in")
    assert sorted(tuple(r) for r in traces.tally(read).collect()) == [("a", 2, 1, 1), ("b", 1, 1, 0)]
    with pytest.raises(FileNotFoundError):
        traces.required(traces.read_traces(spark, f"{tmp_path}/none"), "none")


def test_gold_of_annotations(spark):
    given = {
        "high": {"scores": [{"overall": 4}]}, "low": {"scores": [{"overall": 3.5}]}, "no overall": {"scores": [{}]}, "all 0": {"a": 0, "b": 0.0, "c": False}, "all 1": {"a": 1, "b": True}, "mixed": {"a": 1, "b": 0}, "null": {"a": None},
        "text": {"a": "x"}, "empty": {}, "none": None,
    }
    rows = [(k, json.dumps({"summarizer_score": {"scores": [{"score": "IDEAL" if "0" in k else "fair"}]}, "annotation": v})) for k, v in given.items()] + [("cut", "{")]
    got = {r["file"]: (r["predicted"], r["gold"]) for r in accuracy.judged(spark.createDataFrame(rows, "file string, payload string")).collect()}
    assert got == {"high": (0, 1), "low": (0, 0), "no overall": (0, 0), "all 0": (1, 1), "all 1": (0, 0), "mixed": (0, None), "null": (0, None), "text": (0, None), "empty": (0, None), "none": (0, None), "cut": (0, None)}
