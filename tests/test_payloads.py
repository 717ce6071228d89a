"""Stored payloads: both branches of reading, reports built of them, backfill and the staged rewrite."""

import json

import pytest

from tracewright.operators import payloads
from tracewright.sources import outputs

FINDING = {"severity_estimate": "Critical", "confidence_estimate": "high", "culprit_agent_candidates": [{"agent": " A "}, {"agent": "B"}, "x"], "evidence": [{"idx": "3", "quote": "so FINAL ANSWER: 'no'"}, {"idx": "9"}]}
CHECKS = [{"evidence_index": 0, "idx": "3", "resolved_idx": "4", "idx_exists": True, "quote_found": True}, {"evidence_index": 1, "idx": "9", "idx_exists": False, "quote_found": False}]
RAW = {
    "tool_selection": {"metric_name": "tool_selection", "findings": [FINDING, {}]}, "gt": {"metric_name": "gt", "findings": [FINDING]}, "odd": {"findings": [FINDING]}, "text": "none",
    "mas_planning": {"metric_name": "mas_task_completion", "findings": [FINDING]},
    "evidence_verification": {"tool_selection": {"verifications": [{"finding_index": 0, "evidence_status": "invalid"}, {"finding_index": "0", "evidence_status": "Verified", "evidence_item_checks": CHECKS}, {"finding_index": 1, "evidence_status": "invalid"}, {"finding_index": "x"}]}},
    "non_llm_validators": {"metrics": {"api": {"findings": [{"severity": "minor", "culprit_agent": "C", "evidence": [{"span_id": "7"}, {"idx": "8"}, {}]}]}, "bad": 1}},
    "trace_id": "n/a", "metadata": {"task_id": 17}, "reference_answer": "No.",
}
STORED = {
    "report": {
        "diagnostic_report": {"problematic_agents": [{"agent": "A"}, "a", "B", None], "issues": [{"culprit_agents": ["Z"], "problematic_idxs": "5; 6"}, {"problematic_idxs": [6, 7]}], "review_targets": [{"evidence_status": "INVALID"}, {"evidence_status": "weak"}, 3]},
        "status": {"diagnostic_status": {"primary_culprit_agent": "Q"}, "answer_status": {"verdict": "needs_review", "verification_mode": "manual"}},
    }
}


@pytest.fixture(scope="module")
def rows(spark):
    data = [("/r/raw_1.json", RAW), ("/r/stored_2.json", STORED), ("/r/none_3.json", {}), ("/r/both_4.json", RAW | STORED)]
    return spark.createDataFrame([(f, json.dumps(p)) for f, p in data] + [("/r/bad_5.json", "[1"), ("/r/null_6.json", None)], "file string, payload string")


def test_predictions_of_both_branches(rows):
    got = {r["file"].split("/")[-1]: (r["example_id"], r["agents"], r["primary_agent"], r["idxs"], r["first_idx"], r["invalid_findings"]) for r in payloads.predictions(rows).collect()}
    assert got["raw_1.json"] == ("17", ["A", "B"], "A", ["4"], "4", 1)
    assert got["stored_2.json"] == ("2", ["Q", "A", "B"], "Q", ["5", "6", "7"], "5", 1)
    assert got["none_3.json"][1:] == ([], None, [], None, 0) and got["bad_5.json"] == ("5", [], None, [], None, 0)
    assert got["both_4.json"] == ("17", *got["stored_2.json"][1:])
    again = {r["file"].split("/")[-1]: (r["agents"], r["invalid_findings"]) for r in payloads.predictions(rows, mode="none").collect()}
    assert again["both_4.json"] == (["A", "B"], 0) and again["stored_2.json"] == ([], 0)
    bare = {r["file"].split("/")[-1]: r["agents"] for r in payloads.predictions(rows, build_missing=False).collect()}
    assert bare["raw_1.json"] == [] and bare["stored_2.json"] == ["Q", "A", "B"]


def test_reports_of_payloads(rows):
    got = {(r["trace_id"].split("/")[-1], r["weight"]): r for r in payloads.built_reports(rows, weights=(0.0, 1.0)).collect()}
    one = got["raw_1.json", 0]
    assert (one["verdict"], one["issues"], one["review_targets"], one["critical_issues"], one["answer_verdict"], one["predicted"]) == ("issues_found", 1, 1, 1, "correct", "no")
    heavy = got["raw_1.json", 1000]
    assert heavy["issues"] == 2 and [a["agent"] for a in heavy["problematic_agents"]] == ["A", "B", "C"] and {i["idx"] for i in heavy["problematic_idxs"]} == {"4", "7", "8"}
    kept = got["stored_2.json", 0]
    assert (kept["verdict"], kept["answer_verdict"], kept["verification_mode"], kept["review_required"]) == ("clean", "needs_review", "manual", True)
    assert (got["null_6.json", 0]["verdict"], got["null_6.json", 0]["answer_verdict"]) == ("clean", "unknown")


def test_reports_go_back_into_payloads(rows):
    made = payloads.with_reports(rows)
    got = {r["file"].split("/")[-1]: json.loads(r["payload"]) for r in made.collect()}
    report = got["raw_1.json"]["report"]
    assert {k: v for k, v in got["raw_1.json"].items() if k != "report"} == RAW
    assert report["status"]["diagnostic_status"]["primary_culprit_agent"] == "A" and report["diagnostic_report"]["issues"][0]["problematic_idxs"] == ["4"]
    assert report["diagnostic_report"]["review_targets"][0]["evidence_status"] == "invalid" and got["none_3.json"]["report"]["diagnostic_report"]["issues"] == []
    same = lambda df: sorted((r["file"], r["agents"], r["idxs"], r["first_idx"], r["invalid_findings"]) for r in payloads.predictions(df).collect())
    assert same(made.where("file LIKE '%raw%'")) == same(rows.where("file LIKE '%raw%'"))


def test_backfill_that_is_cut_off_and_run_again(spark, rows, tmp_path, monkeypatch):
    path, schema = str(tmp_path / "out"), "`file` string, `payload` string"
    outputs.upsert(rows, path, "file", 4)
    table = lambda: {r["file"]: r["payload"] for r in outputs.read_outputs(spark, path, schema).collect()}
    before = table()
    assert before == {r["file"]: r["payload"] for r in rows.collect()}
    verdicts = spark.createDataFrame([(f, json.dumps({"verdict": "ideal", "predicted_answer": "p"})) for f in before if "raw" in f or "none" in f] + [("/r/other.json", "{}"), ("/r/bad_5.json", None)], "file string, verification string")
    change = lambda: payloads.backfilled(outputs.read_outputs(spark, path, schema), verdicts)

    def cut(*_):
        raise RuntimeError("cut off")

    with monkeypatch.context() as m:
        m.setattr(outputs, "swapped", cut)
        with pytest.raises(RuntimeError):
            outputs.upsert(change(), path, "file", 4)
    assert table() == before
    outputs.upsert(change(), path, "file", 4)
    after = table()
    assert after.keys() == before.keys() and {f for f in after if after[f] != before[f]} == {"/r/raw_1.json", "/r/none_3.json"}
    whole = json.loads(after["/r/none_3.json"])
    assert whole["final_answer_verification"]["verdict"] == "ideal" and whole["report"]["status"]["answer_status"]["predicted_answer"] == "p"
    assert change().count() == 0
    outputs.upsert(change(), path, "file", 4)
    assert table() == after
