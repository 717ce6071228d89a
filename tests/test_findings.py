"""Order-dependent steps against small oracles in plain Python."""

import random
from collections import Counter

from tracewright.operators import accuracy, answers, findings, metrics, observations, report, scan, verify
from tracewright.plans import views

SPANS = "trace_id string, ord int, idx string, text string, agent string, kind string, parent string"


def many_spans(spark, seed=1, n=220):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        t, o = f"t{i % 4}", i // 4
        text = " and ".join(rng.choice(views.TEMPLATES) for _ in range(rng.randint(1, 3)))
        rows.append((t, o, str(o), text, rng.choice(["A", "B", None]), rng.choice(["TOOL", "CHAIN", None]), str((o - 1) // 2) if o else None))
    return spark.createDataFrame(rows, SPANS), rows


def test_overlaps_and_groups(spark):
    df, _ = many_spans(spark)
    raw = sorted((tuple(r[c] for c in ("trace_id", "v", "c", "ord", "r")), r) for r in scan.scan(df, suppress=False).collect())
    kept, claimed = [], {}
    for _, r in raw:
        mine = claimed.setdefault((r["trace_id"], r["idx"]), [])
        if r["m_start"] is not None:
            if any(v != r["v"] and r["m_start"] < e and s < r["m_end"] for s, e, v in mine):
                continue
            mine.append((r["m_start"], r["m_end"], r["v"]))
        kept.append(r)
    key = lambda r: (r["trace_id"], r["idx"], r["metric_name"], r["failure_type"])
    assert Counter(map(key, scan.scan(df).collect())) == Counter(map(key, kept))
    groups = {}
    for r in kept:
        groups.setdefault((r["trace_id"], r["metric_name"], r["failure_type"], r["agent"], " ".join(r["quote"].split()).lower()[:120]), []).append(r["idx"])
    got = {(r["trace_id"], r["metric_name"], r["failure_type"], r["agent"], r["quote_key"]): (r["occurrences"], [e["idx"] for e in r["evidence"]]) for r in findings.deduplicated(scan.scan(df)).collect()}
    assert got == {k: (len(v), v[:5]) for k, v in groups.items()}
    assert len(kept) == sum(n for n, _ in got.values())


def test_collapse(spark):
    long = "TypeError: bad operand in tool call number one"
    rows = [
        ("t", 0, "0", f"outer says {long}", "A", "CHAIN", None), ("t", 1, "1", f"inner says {long}", "B", "TOOL", "0"), ("t", 2, "2", "model alpha does not exist", "A", "CHAIN", None),
        ("t", 3, "3", f"elsewhere {long}", "C", "CHAIN", "2"), ("u", 0, "0", "a", None, None, "1"), ("u", 1, "1", "b", None, None, "0"),
    ]
    df = spark.createDataFrame(rows, SPANS)
    up = findings.ancestors(df)
    assert {(r["trace_id"], r["idx"]): r["ancestors"] for r in up.collect() if r["trace_id"] == "t"} == {("t", "0"): [], ("t", "1"): ["0"], ("t", "2"): [], ("t", "3"): ["2"]}
    found = findings.deduplicated(scan.scan(df))
    left = {(r["primary_idx"], r["failure_type"]) for r in findings.collapsed(found, df).collect()}
    every = {(r["primary_idx"], r["failure_type"]) for r in found.collect()}
    assert every - left == {("0", "tool_call_type_error")}


def test_a_result_keeps_traces_without_findings(spark):
    df = spark.createDataFrame([("t", 0, "0", "bad request", None, None, None), ("u", 0, "0", "json that is missing nothing", "A", None, None)], SPANS)
    got = {r["trace_id"]: (r["n_findings"], r["agent_attribution_available"]) for r in findings.validator_result(findings.deduplicated(scan.scan(df)), df).collect()}
    assert got == {"t": (1, False), "u": (0, True)}


def test_confirmations(spark):
    df, _ = many_spans(spark, n=40)
    found = findings.numbered_for_review(findings.deduplicated(scan.scan(df)))
    windows = findings.candidate_windows(found, df)
    said = spark.createDataFrame([("t0", "F0", 2, "rejected", None), ("t0", "F0", 1, "confirmed", "999"), ("t1", "F0", 1, "confirmed", "1")], "trace_id string, finding_id string, n int, verdict string, corrected_idx string")
    got = {(r["trace_id"], r["finding_id"]): (r["llm_verdict"], r["corrected_idx"]) for r in findings.confirmed(found, said, windows).collect()}
    assert got["t0", "F0"] == ("confirmed", None) and got["t0", "F1"] == ("uncertain", None)
    offered = {r["idx"] for r in windows.where("trace_id = 't1' AND finding_id = 'F0'").collect()}
    assert got["t1", "F0"] == ("confirmed", "1" if "1" in offered else None)
    assert {r["trace_id"]: r["n_findings"] for r in findings.confirmation_counts(findings.confirmed(found, said, windows)).collect()} == Counter(r["trace_id"] for r in found.collect())


def judge_tables(spark):
    judge = spark.createDataFrame(
        [("t", 0, "tool_selection", 0, "critical", "high", [" A ", "A", "b"], ["7"], False), ("t", 0, "tool_selection", 1, None, None, ["B"], ["12"], True),
         ("t", 1, "mas_planning", 0, "minor", "low", [], ["x"], False), ("t", 2, "MAS_TASK_COMPLETION", 0, "major", "low", ["Z"], ["x"], False), ("u", 0, "tool_selection", 0, "major", "high", ["A"], ["1"], False)],
        "trace_id string, metric_ord int, metric_name string, finding_index long, severity string, confidence string, culprit_agents array<string>, evidence_idxs array<string>, needs_human_review boolean")
    checks = "array<struct<evidence_index:int,idx:string,resolved_idx:string,idx_exists:boolean,quote_found:boolean>>"
    ver = spark.createDataFrame(
        [("t", "tool_selection", 0, 0, "invalid", []), ("t", "tool_selection", 0, 1, "verified", [(0, "7", "6", True, True), (1, "9", None, False, False)]), ("t", "tool_selection", 1, 0, "weak", [(0, "12", None, True, False)]), ("u", "tool_selection", 0, 0, "invalid", [])],
        f"trace_id string, metric_name string, finding_index long, v_ord int, evidence_status string, checks {checks}")
    return judge, ver


def test_reports(spark):
    judge, ver = judge_tables(spark)
    rows = report.issues(judge, ver, report.MODES)
    got = {(r["trace_id"], r["mode"]): r for r in report.with_review_status(report.reports(rows)).collect()}
    soft = got["t", "soft"]
    assert (soft["verdict"], soft["issues"], soft["review_targets"], soft["critical_issues"], soft["major_issues"]) == ("issues_found", 2, 1, 1, 1)
    assert [(a["agent"], a["findings_count"]) for a in soft["problematic_agents"]] == [("A", 1), ("b", 1), ("B", 1)]
    assert [i["idx"] for i in soft["problematic_idxs"]] == ["6", "12"] and soft["first_problem_idx"] == "6" and soft["primary_failure_type"] == "wrong_tool_selection"
    assert soft["review_required"] and got["u", "soft"]["verdict"] == "needs_review" and got["u", "soft"]["review_required"] and got["u", "none"]["verdict"] == "issues_found"
    for t in "tu":
        n = [got[t, m]["issues"] for m in ("none", "soft", "strict")]
        assert n == sorted(n, reverse=True)


def test_weight_zero_is_the_judge_alone(spark):
    judge, ver = judge_tables(spark)
    df = spark.createDataFrame([("t", 0, "0", "bad request", "V", None, None), ("t", 1, "1", "bad request", "V", None, None)], SPANS)
    found = findings.deduplicated(scan.scan(df))
    rows = report.reports(report.issues(judge, ver, ("soft",), found, (0.0, 1.0)))
    got = {(r["trace_id"], r["weight"]): (r["issues"], r["primary_culprit_agent"]) for r in rows.collect()}
    assert got["t", 0][0] == 2 and got["t", 1000][0] == 3 and got["u", 0] == got["u", 1000]


def test_evidence(spark):
    items = spark.createDataFrame([("t", 0, "Web_0", "the page says hello world", "Web", "state", False), ("t", 1, "5", "late text", None, "state", False), ("t", 2, "4", "early text", "Own", "state", True)], "trace_id string, write_ord int, idx string, content string, agent string, idx_type string, is_default boolean")
    raw = spark.createDataFrame([("t", "[1] agent: Boss\nraw words here\n[2] Coder: more\\nwords\n")], "trace_id string, trace string")
    index = verify.idx_index(items, raw)
    got = {r["idx"]: (r["agent"], r["idx_type"]) for r in index.collect()}
    assert got["1"] == ("Boss", "raw_trace_step_index") and got["2"][0] == "Coder" and got["5"][1] == "state"
    cite = [("m", 0, 0, "Web_0", "culprit", "hello  world"), ("m", 1, 0, "6", "context", "late text"), ("m", 2, 0, "gone", "culprit", "raw words"), ("m", 3, 0, "gone", "culprit", "nothing such"), ("m", 4, 0, "5", "odd role", "late text"), ("m", 5, 0, "4", "culprit", "")]
    c = spark.createDataFrame([("t", *x) for x in cite], "trace_id string, metric_name string, finding_index long, evidence_index int, idx string, role string, quote string")
    f = spark.createDataFrame([("t", "m", i, "high", False, ["web"] if i == 0 else []) for i in range(7)], "trace_id string, metric_name string, finding_index long, confidence string, needs_human_review boolean, culprit_agents array<string>")
    met = verify.resolved(c, index, raw)
    spots = {r["finding_index"]: (r["resolved_idx"], r["strategy"], r["resolved_agent"]) for r in met.collect()}
    assert spots[1][:2] == ("5", "numeric_pm1_fuzzy") and spots[2] == ("gone", "raw_quote_soft", "Boss") and spots[3][1] == "unresolved" and spots[0][:2] == ("Web_0", "exact")
    status = {r["finding_index"]: r["evidence_status"] for r in verify.verifications(f, met).collect()}
    assert status == {0: "verified", 1: "verified", 2: "verified", 3: "invalid", 4: "weak", 5: "invalid", 6: "invalid"}


def test_scoring(spark):
    pred = spark.createDataFrame(
        [("/r/task_3.json", None, ["Web Surfer", "x"], "web-surfer", ["step 4"], "step 4", 1), ("/r/a.json", "k2", ["y"], "y", ["10"], "10", 0), ("/r/none.json", None, [], None, [], None, 2)],
        "file string, example_id string, agents array<string>, primary_agent string, idxs array<string>, first_idx string, invalid_findings long")
    gold = spark.createDataFrame([(3, "k3", ["WebSurfer"], ["5"], "k3"), (4, "k2", [], ["10"], "k2"), (5, "k2", ["y"], [], "k2")], "row_index long, example_id string, gold_agents array<string>, gold_idxs array<string>, trace_id string")
    rows, lost = accuracy.evaluate(pred, gold, ["trace_id"])
    got = {r["file"]: r for r in rows.collect()}
    a = got["/r/task_3.json"]
    assert (a["agent_top1"], a["agent_hit"], a["agent_exact"], a["step_hit"], a["step_hit_near"], a["step_top1_0"], a["step_top1_1"]) == (True, True, False, False, True, False, True)
    assert got["/r/a.json"]["agent_top1"] is None and got["/r/a.json"]["step_top1_0"] is True and got["/r/a.json"]["annotation_row_index"] == 4
    assert [r["file"] for r in lost.collect()] == ["/r/none.json"]
    s = accuracy.accuracy_summary(rows).first()
    assert (s["examples"], s["agent_examples"], s["acc_agent_top1"], s["acc_step_top1_0"], s["acc_step_top1_1"]) == (2, 1, 1.0, 0.5, 1.0)
    assert [r["file"] for r in accuracy.worst_examples(rows, 1).collect()] == ["/r/task_3.json"]


def test_root_cause_gold(spark):
    df = spark.createDataFrame([(0, "x", [(1, 3, "A", "c"), (2, 5, "B", "c"), (3, 3, "A", "d")], 2)], "row_index int, trajectory_id string, failures array<struct<failure_id:int,step_number:int,failed_agent:string,failure_category:string>>, root_cause_failure_id int")
    r = accuracy.root_cause_gold(df).first()
    assert (r["mistake_agents"], r["mistake_steps"], r["root_cause_agent"], r["root_cause_step"], r["num_failures"]) == (["A", "B"], ["3", "5"], "B", "5", 3)


def test_observations(spark):
    text = """graph TD
 a[A] --> b[B]
 a[A]-->c[C]
 c[C] --> d[D]
 b[B] --> d[D]
 a2[A] --> e[E]
 x[X] --> y[Y]
 y[Y] --> x[X]
 y[Y] --> w[Behind]
 2b44[PlanningAgent] --> c1[Coder]
 zz[Alone]
 n --> m"""
    g = spark.createDataFrame([("t", text), ("u", "a --> b"), ("v", None)], "trace_id string, graph string")
    order = [r["agent"] for r in observations.agent_order(g).orderBy("rank").collect()]
    assert order == ["A", "PlanningAgent", "Alone", "B", "C", "E", "Coder", "D", "X", "Y", "Behind"]
    obs = spark.createDataFrame([("t", 0, "r1", "Boss run", None, 1000, None, 0, 0), ("t", 1, "g", "chat", "r1", 1, None, 5, 6), ("t", 2, "x", "running 1 tool", "r1", 1, None, 50, 60), ("t", 3, "r2", "Boss run", None, 2000, "bad", 0, 0), ("t", 4, "g2", "chat", "r2", 1, None, 1, 2)],
                                "trace_id string, ord int, id string, name string, parent_observation_id string, latency long, status_message string, input_tokens long, output_tokens long")
    runs = observations.agent_runs(obs)
    assert [(r["agent"], r["input_tokens"], r["output_tokens"], r["latency"]) for r in observations.usage_of_agents(runs, obs).collect()] == [("Boss", 1, 2, 2.0)]
    assert observations.usage_of_agents(runs, obs, all_runs=True).first()["input_tokens"] == 6
    assert [r["error_message"] for r in observations.run_errors(runs).collect()] == ["bad"]


def test_metrics_and_answers(spark):
    calls = spark.createDataFrame([("t", True), ("t", False), ("t", False)], "trace_id string, is_invalid boolean")
    assert metrics.tool_efficiency(calls).first()["efficiency"] == 0.5
    rows = spark.createDataFrame([("a", "The  Cat.", "the cat"), ("b", "1,000", "1000.0"), ("c", "x", "y"), ("d", None, "y"), ("e", "n/a", None)], "trace_id string, predicted string, reference string")
    got = {r["trace_id"]: (r["answer_verdict"], r["verification_mode"]) for r in answers.answer_status(rows).collect()}
    assert got == {"a": ("correct", "reference_based"), "b": ("correct", "reference_based"), "c": ("incorrect", "reference_based"), "d": ("unknown", "reference_based"), "e": ("unknown", "unavailable")}
    msgs = spark.createDataFrame([("t", 1, "FINAL ANSWER: one"), ("t", 3, "so\nfinal answer: two \nbye"), ("t", 4, "no mark")], "trace_id string, ord int, content string")
    assert answers.last_marked_message(msgs).first()["extracted"] == "two"
    routed = answers.routed(spark.createDataFrame([("d", "x", "X"), ("d", "x", "y"), ("d", None, "y"), (None, "x", "x")], "dataset string, extracted string, gold string"))
    assert [(r["method"], r["verdict"]) for r in routed.collect()] == [("direct_comp", "ideal"), ("equivalence_judge", None), ("completion_judge", None), (None, None)]
