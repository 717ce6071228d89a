"""What can be cited, against a plain dictionary filled in the order of writing; answers and gold inside payloads."""

import json

from tracewright.operators import accuracy, answers, verify

RESPONSES = [("Web_0", "r0", None), ("2", "r1", '{"name": "Ann"}'), ("state_1", "r2", '{"agent": " "}')]
STATES = [("Web_0", "action", "s0", None, "c1", '{"id": "c1"}'), ("X_1", "tool", "", None, "c1", '{"n": 2}'), ("3", "action", "s2", None, None, None), ("Y_9", "action", "s3", None, "", None)]


def test_items_against_a_dictionary(spark):
    want = {}
    put = lambda k, *v: want.__setitem__(k, v)
    for i, (role, text) in enumerate([("user", "m0"), ("system", "m1"), ("user", None)]):
        put(f"message_{i}", text or "", role, "dialogue_message")
        want.setdefault(str(i), (text or "", role, "dialogue_message_index"))
    for i, (k, text, _) in enumerate(RESPONSES):
        who = ["Web", "Ann", None][i]
        put(k, text, who, "agent_response")
        want.setdefault(str(i), (text, who, "agent_response_index"))
    for i, (k, kind, text, _, call, body) in enumerate(STATES):
        who, both = ["Web", "X", None, "Y"][i], "\n".join(x for x in (text, body) if x)
        if call:
            put(call, body, who, "tool_call")
        put(k, both, who, kind)
        want.setdefault(str(i), (both, who, "agent_state_index"))
    put("p", "{}", None, "policy")
    put("Ann", "lead", "Ann", "agent_description")
    put("c2", "b2", "Ann", "tool_call")
    put("agent_error_0", "", "Ann", "agent_error")
    t = spark.createDataFrame
    tables = {
        "messages": t([("t", 0, "user", "m0"), ("t", 1, "system", "m1"), ("t", 2, "user", None)], "trace_id string, ord int, role string, content string"),
        "responses": t([("t", i, *r) for i, r in enumerate(RESPONSES)], "trace_id string, ord int, response_id string, content string, metadata string"),
        "states": t([("t", i, *r) for i, r in enumerate(STATES)], "trace_id string, ord int, state_id string, type string, content string, metadata string, call_id string, call string"),
        "policies": t([("t", 0, "p", "{}"), ("t", 1, None, "{}")], "trace_id string, ord int, policy_id string, body string"),
        "tools": t([("t", 0, "Ann", "all", [("c2", "b1"), ("", "b0"), ("c2", "b2")])], "trace_id string, ord int, agent_name string, body string, calls array<struct<id string, body string>>"),
        "errors": t([("t", 0, "Ann", None)], "trace_id string, ord int, agent_name string, error_message string"),
        "pool": t([("t", 0, "Ann", "lead")], "trace_id string, ord int, agent_name string, instructions string"),
    }
    none = t([], "trace_id string, trace string")
    read = lambda names: {r["idx"]: (r["content"], r["agent"], r["idx_type"]) for r in verify.idx_index(verify.citeable_items(**tables, agent_names=names), none).collect()}
    assert read(True) == want
    want.pop("Ann")
    assert read(False) == want
    alone = verify.citeable_items(errors=tables["errors"].limit(0))
    assert alone.count() == 0


def test_answers_in_quotes(spark):
    rows = [("a", 1, 0, 0, "FINAL ANSWER: late"), ("a", 0, 2, 0, "x final_answer = 'two' y"), ("a", 0, 2, 1, "Final  Answer: no"), ("b", 0, 0, 0, "none"), ("c", 0, 0, 0, None), ("d", 0, 0, 0, 'FINAL ANSWER: "it"\nmore')]
    got = answers.answers_in_quotes(spark.createDataFrame(rows, "trace_id string, metric_ord int, finding_index int, evidence_index int, quote string"))
    assert {tuple(r) for r in got.collect()} == {("a", "two"), ("d", "it")}


def test_answers_of_odd_payloads(spark):
    rows = [("who_and_when", json.dumps([{"content": "FINAL ANSWER: 7"}])), ("who_and_when", "no json"), ("aegis", None), ("ghost", '{"output": null}'), ("other", "{}"), (None, "{}"), ("trail_swe", '{"spans": []}')]
    df = spark.createDataFrame(rows, "dataset string, payload string")
    assert [r[0] for r in df.select(answers.final_answer(df.payload, df.dataset)).collect()] == ["7", *[None] * 6]


def test_embedded_gold_and_gaps(spark):
    bodies = [{"sample_id": 5, "ground_truth_faulty_agents": [{"agent_name": "A"}, "B", {"x": 1}, ""]}, {"sample_id": "s"}]
    got = accuracy.embedded_gold(spark.createDataFrame([(json.dumps(b),) for b in bodies], "payload string"))
    assert {r["sample_id"]: r["gold_agents"] for r in got.collect()} == {"5": ["A", "B"], "s": []}
    summary = spark.createDataFrame([(1.0, 0.75, 0.5, 0.25, 0.25), (None, None, 0.5, 0.5, 0.0)], "acc_agent_hit double, acc_agent_top1 double, acc_step_hit_near double, acc_step_hit double, acc_step_top1_0 double")
    gaps = [tuple(r)[-3:] for r in accuracy.accuracy_gaps(summary).collect()]
    assert gaps == [(0.25, 0.25, 0.0), (None, 0.0, 0.5)]
