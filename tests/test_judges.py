"""The boundary to a model, with a stand-in."""

import json

from tracewright.operators import judges, report


def answer(metric: str, shown: str) -> str:
    if metric == "mas_planning":
        raise RuntimeError("no answer")
    body = {"findings": [{"severity_estimate": "minor", "confidence_estimate": "low", "culprit_agent_candidates": [{"agent": "A"}], "evidence": [{"idx": 3, "role": "culprit", "quote": shown[:5]}], "needs_human_review": False}]}
    return f"```json\n{json.dumps(body)}\n```"


def test_prompts_answers_and_reports(spark):
    traces = spark.createDataFrame([("t", "why?", [("s", "x")], None), ("u", None, None, "raw text")], "trace_id string, user_query string, agent_states array<struct<state_id:string,content:string>>, trace string")
    asked = judges.prompts(traces, ["tool_selection", "mas_planning"])
    shown = {(r["trace_id"], r["metric_name"]): r["input"] for r in asked.collect()}
    assert shown["t", "tool_selection"] == '{"user_query":"why?","agent_states":[{"state_id":"s","content":"x"}]}' and shown["u", "tool_selection"] == "raw text"
    got = judges.judged(asked, answer, retries=2)
    assert {r["error"] for r in got.where("metric_name = 'mas_planning'").collect()} == {"RuntimeError: no answer"}
    found = judges.findings_of(got)
    assert [(r["trace_id"], r["culprit_agents"], r["evidence_idxs"]) for r in found.orderBy("trace_id").collect()] == [("t", ["A"], ["3"]), ("u", ["A"], ["3"])]
    assert judges.citations(found).count() == 2
    checks = "array<struct<evidence_index:int,idx:string,resolved_idx:string,idx_exists:boolean,quote_found:boolean>>"
    none = spark.createDataFrame([], f"trace_id string, metric_name string, finding_index long, v_ord int, evidence_status string, checks {checks}")
    assert {r["verdict"] for r in report.reports(report.issues(found, none, ("none",))).collect()} == {"issues_found"}
