"""Branches and options of single survey items."""

import json

from pyspark.sql import functions as F

from tracewright.functions.text import decoded_runs
from tracewright.operators import judges, verify
from tracewright.sources import traces


def rows(spark, **payloads):
    return spark.createDataFrame([(k, json.dumps(v)) for k, v in payloads.items()], "trace_id string, payload string")


def test_native_step_numbers(spark):
    steps = [{"index": 1, "substeps": [{"role": "user", "content": "hi"}, "bare", {"x": 1}]}, {"index": 3, "substeps": "[{'role': 'tool', 'content': 'out'}]"}]
    got = traces.spans_of(rows(spark, t={"trajectory_id": "t", "steps": steps})).orderBy("ord").collect()
    assert [(r["ord"], r["idx"], r["text"]) for r in got] == [(0, "1", 'user: hi\nbare\n{"x":1}'), (1, "3", "tool: out")]


def test_conversation_records(spark):
    talk = [{"agent_name": "A", "content": "first"}, {"content": "last"}, {"content": ""}]
    df = rows(spark, a={"input": {"conversation_history": talk, "final_output": "done"}}, b={"input": {"conversation_history": talk, "final_output": ""}}, c={"input": {}})
    assert {r[0]: r[1] for r in traces.predicted_answers(df).collect()} == {"a": "done", "b": "last", "c": None}
    got = traces.conversation_spans(df).where("trace_id = 'a'").orderBy("ord").collect()
    assert [(r["idx"], r["agent"]) for r in got] == [("0", "A"), ("1", None), ("2", None)]


def test_left_over_escapes(spark):
    df = spark.createDataFrame([("a \\u0041\\u00e9 b \\\\u0042 \\ud83d\\ude00!",), ("plain",)], "x string")
    assert [r[0] for r in df.select(decoded_runs(F.col("x"))).collect()] == ["a Aé b B !", "plain"]


def test_judges_asked_by_name(spark):
    df = spark.createDataFrame([("t", "q", "s", "i", "p", "g", "r", "raw"), ("u", None, None, None, None, None, "r", "raw")], "trace_id string, user_query string, agent_states string, agents_tools_info string, agents string, graph string, metrics_results string, trace string")
    got = {(r["trace_id"], r["metric_name"]): r["input"] for r in judges.prompts(df, list(judges.OTHER_JUDGES)).collect()}
    assert json.loads(got["t", "single_judge"]) == {"user_query": "q", "agent_states": "s", "agents_tools_info": "i"}
    assert json.loads(got["t", "planner_checker"]) == {"agents": "p", "graph": "g"}
    assert json.loads(got["u", "summarizer"]) == {"metrics_results": "r"} and got["u", "single_judge"] == "raw"


def test_own_evidence_roles(spark):
    said = spark.createDataFrame([("t", "m", 0, 0, "1", "Mine", "q"), ("t", "m", 0, 1, "1", "primary", "q")], "trace_id string, metric_name string, finding_index long, evidence_index int, idx string, role string, quote string")
    raw = spark.createDataFrame([("t", "[1] agent: A")], "trace_id string, trace string")
    index = spark.createDataFrame([("t", "1", "q", "A", "step")], "trace_id string, idx string, content string, agent string, idx_type string")
    role = lambda **o: {r["evidence_index"]: r["role_plausible"] for r in verify.resolved(said, index, raw, **o).collect()}
    assert role() == {0: False, 1: True} and role(roles=("mine",)) == {0: True, 1: False}
