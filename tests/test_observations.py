"""Observation traces of all four shapes."""

import json

from tracewright.operators import observations as ops
from tracewright.operators import verify
from tracewright.sources import observations as src

MESSAGES = json.dumps([
    {"role": "system", "parts": [{"type": "text", "content": "rules"}, {"type": "text", "content": "more"}]},
    {"role": "user", "parts": [{"type": "text", "content": "go"}, {"type": "tool_call_response", "id": "c1", "name": "find", "result": "r"}]},
    {"role": "assistant", "parts": [{"type": "text", "content": "ok"}, {"type": "tool_call", "id": "c1", "name": "find", "arguments": "{}"}]},
])
TRACE = {"observations": [
    {"id": "t", "type": "SPAN", "name": "gaia_task_1", "output": {"pool": [{"name": " Boss ", "instructions": "lead"}, {"name": ""}], "graph": "graph TD\n Boss --> Web"}},
    {"id": "r", "type": "SPAN", "name": "Boss run", "latency": 1500, "metadata": {"attributes": {"pydantic_ai.all_messages": MESSAGES, "gen_ai.system_instructions": '[{"content": "lead well"}]'}}},
    {"id": "g", "type": "GENERATION", "name": "chat", "parentObservationId": "r", "usageDetails": {"input": 7, "output": 3}, "startTime": "2024-01-01T00:00:00Z", "metadata": {"attributes": {"model_request_parameters": '{"function_tools": [{"name": "find"}]}'}}},
    {"id": "x", "type": "SPAN", "name": "running 1 tool", "parentObservationId": "r", "usageDetails": {"input": 100}},
    {"id": "d", "type": "SPAN", "name": "GraphGenerator run"},
    {"id": "s", "type": "SPAN", "name": "single_task", "input": {"args": [{"task_id": "T9"}]}},
    {"id": "u", "type": "TOOL", "name": "find"}, {"id": "v", "type": "CHAIN", "name": "walk"},
]}
CHAIN = {"input": json.dumps(json.dumps({"messages": [{"role": "user", "content": "hi"}]})), "output": json.dumps({"messages": [{"type": "ai", "content": "yo"}, {"type": "tool", "content": "no"}]})}


def test_tables(spark):
    traces = spark.createDataFrame([("t", json.dumps(TRACE)), ("c", json.dumps(CHAIN)), ("p", json.dumps({"input": "plain", "output": "end"}))], "trace_id string, payload string")
    obs = src.observations_of(traces)
    agents = src.task_agents(obs)
    assert [(r["agent"], r["instructions"]) for r in agents.collect()] == [("Boss", "lead")]
    assert [(r["agent"], r["instructions"]) for r in src.run_agents(obs).collect()] == [("Boss", "lead well")]
    parts = src.agent_messages(obs, agents)
    assert [(r["role"], r["content"]) for r in ops.dialogue(parts).orderBy("msg", "part").collect()] == [("system", "rules"), ("user", "go"), ("assistant", "ok")]
    assert [(r["state_id"], r["state_type"], r["content"]) for r in ops.states(parts).orderBy("state_id").collect()] == [
        ("Boss_1", "system.text", "rules"), ("Boss_2", "user.text", "go"), ("Boss_3", "user.tool_call_response", "r"), ("Boss_4", "assistant.text", "ok"), ("Boss_5", "assistant.tool_call", "{}"),
    ]
    assert [(r["response_id"], r["content"]) for r in ops.responses(parts).collect()] == [("Boss_1", "ok")]
    calls = parts.where("type = 'tool_call'").select("trace_id", "agent", "name")
    assert [tuple(r) for r in ops.tools_of_agents(calls, src.generation_tools(obs)).collect()] == [("t", "Boss", ["find"], ["find"])]
    assert [tuple(r) for r in ops.usage_of_agents(ops.agent_runs(obs.where("name <> 'GraphGenerator run'")), obs).collect()] == [("t", "Boss", 7, 3, 1.5)]
    assert [(r["task_id"], r["id"]) for r in src.task_ids(obs).collect()] == [("T9", "s")]
    assert [(r["type"], r["content"]) for r in src.chain_states(obs).orderBy("ord").collect()] == [("assistant.text", "LLM generation using unknown model"), ("tool_call", "Tool call: find"), ("action", "Chain execution: walk")]
    assert [r["name"] for r in src.chain_tools(obs).collect()] == ["find"]
    said = {(r["trace_id"], r["side"]): (r["role"], r["content"]) for r in src.chain_dialogue(traces).collect()}
    assert said == {("c", 0): ("user", "hi"), ("c", 1): ("assistant", "yo"), ("p", 0): ("user", "plain"), ("p", 1): ("assistant", "end")}


def test_records_feed_citations(spark):
    """A task with a pool, one without (its runs' errors count), one that is no object, and none at all."""
    runner = {"id": "k", "type": "SPAN", "name": "running tool: find", "statusMessage": "broke", "metadata": {"attributes": {"gen_ai.tool.call.id": "c1", "tool_response": "late"}}}
    whole = {**TRACE, "output": {"question": "why"}, "environment": "test", "projectId": "p", "observations": [*TRACE["observations"], runner]}
    bare = {"observations": [{"id": "r", "type": "SPAN", "name": "Boss run", "statusMessage": "lost"}], "output": {"question": "unseen"}}
    df = spark.createDataFrame([("t", json.dumps(whole)), ("e", json.dumps(bare)), ("n", "5")], "trace_id string, payload string")
    records = src.evaluation_inputs(df)
    got = {r["trace_id"]: r.asDict(recursive=True) for r in records.collect()}
    t = got["t"]
    assert (t["user_query"], t["environment"], t["metadata"]["project_id"]) == ("why", "test", "p")
    assert t["dialogue_history"] == [{"role": "system", "content": "rules"}, {"role": "user", "content": "go"}, {"role": "assistant", "content": "ok"}]
    call = {"id": "c1", "name": "find", "parameters": "{}", "result": "late", "status_message": "broke"}
    assert t["agent_states"][-1] == {"state_id": "Boss_5", "type": "assistant.invalid_tool_call", "content": "{}", "tool_call": call}
    assert t["agents_tools_info"] == [{"agent_name": "Boss", "tools_called": [call], "available_tools": ["find"]}]
    assert t["agents_usage"] == [{"agent_name": "Boss", "input_tokens": 7, "output_tokens": 3, "latency": 1.5}]
    assert t["agents_pool"] == [{"agent_name": "Boss", "instructions": "lead"}] and t["agents_errors"] == []
    e = got["e"]
    assert e["agents_errors"] == [{"agent_name": "Boss", "error_message": "lost"}] and e["user_query"] is None and e["agents_pool"] == []
    assert all(v == [] for k, v in got["n"].items() if k.startswith("agent"))
    assert src.evaluation_inputs(df.limit(0)).count() == 0
    items = verify.citeable_items(**src.record_tables(records), agent_names=True)
    kinds = {(r["trace_id"], r["idx"]): r["idx_type"] for r in items.collect()}
    assert kinds["t", "message_1"] == "dialogue_message" and kinds["t", "c1"] == "tool_call" and kinds["t", "Boss"] == "agent_description" and kinds["e", "agent_error_0"] == "agent_error"
    assert kinds["t", "Boss_5"] == "assistant.invalid_tool_call" and kinds["t", "Boss_1"] == "system.text"
