"""Format detection and normalisation of raw traces."""

import json

from tracewright.sources import annotations, traces

TREE = {"spans": [{"span_id": "a", "span_name": "root", "span_kind": "agent", "span_attributes": {"agent.name": "Boss", "input.value": "secret", "output.value": "done"}, "child_spans": [
    {"span_id": "b", "span_name": "call", "span_attributes": {"openinference.span.kind": "LLM", "output.value": "prose", "note": "kept"}, "status_message": "fine", "child_spans": [{"span_id": "c", "span_name": "leaf", "span_kind": "tool"}]},
    {"span_name": "no id"}, "bare"]}]}
CASES = {
    "trail": (TREE, "trail"),
    "history": ({"history": [{"role": "user", "name": "Ann", "content": "hi"}, {"role": "assistant", "content": {"a": 1}}], "mistake_agent": "x"}, "who_and_when"),
    "native": ([{"role": "Web (thought)", "content": "go", "mistake_agent": "Fallback"}, {"role": "human", "content": "stop", "mistake_step": 1, "agent": "Backup"}], "who_and_when"),
    "watch": ({"projectId": "p", "observations": [{"id": "2", "name": "Planner run 1", "startTime": "2024-02", "level": "ERROR", "output": {"k": [1]}}, {"name": "chat model", "startTime": "2024-01", "input": "in"}]}, "pumpkin"),
    "steps": ({"note": 1, "turns": [{"agent_name": "Z", "x": 1}, "plain"]}, "unknown"),
    "longest": ({"a": [1, 2, 3], "b": [{"agent": "Q"}, {"y": 2}]}, "unknown"),
    "spans without marks": ({"spans": [{"x": 1}]}, "unknown"),
    "scalar": (5, "unknown"),
}


def all_spans(spark):
    rows = [(k, json.dumps(v)) for k, (v, _) in CASES.items()] + [("broken", "{no json")]
    return spark.createDataFrame(rows, "trace_id string, payload string")


def test_formats(spark):
    got = {r["trace_id"]: r["detected_format"] for r in traces.with_format(all_spans(spark)).collect()}
    assert got == {k: kind for k, (_, kind) in CASES.items()}
    assert [r["trace_id"] for r in traces.unreadable(all_spans(spark)).collect()] == ["broken"]


def test_spans(spark):
    got = {}
    for r in traces.spans_of(all_spans(spark)).orderBy("trace_id", "ord").collect():
        got.setdefault(r["trace_id"], []).append(r)
    tree = got["trail"]
    assert [(r["idx"], r["agent"], r["kind"], r["parent"], r["ancestors"]) for r in tree] == [
        ("a", "Boss", "AGENT", None, []), ("b", "call", "LLM", "a", ["a"]), ("c", "leaf", "TOOL", "b", ["a", "b"]), ("3", "no id", None, "a", ["a"]), ("4", None, None, "a", ["a"]),
    ]
    assert tree[0]["text"] == "root agent Boss done" and tree[1]["text"] == "call fine LLM kept" and tree[4]["text"] == "bare"
    assert [(r["agent"], r["text"]) for r in got["history"]] == [("Ann", "Ann hi"), (None, '{"a":1}')]
    assert [(r["agent"], r["text"]) for r in got["native"]] == [("Web", "go"), ("Backup", "stop")]
    assert [(r["idx"], r["agent"], r["text"]) for r in got["watch"]] == [("0", None, "in"), ("2", "Planner", 'ERROR {"k":[1]}')]
    assert [(r["agent"], r["text"]) for r in got["steps"]] == [("Z", '{"agent_name":"Z","x":1}'), (None, "plain")]
    assert [r["agent"] for r in got["longest"]] == ["Q", None]
    assert [r["text"] for r in got["scalar"]] == ["5"]


def test_readers_and_writers(spark, tmp_path):
    (tmp_path / "in" / "gaia").mkdir(parents=True)
    (tmp_path / "in" / "gaia" / "t1.json").write_text('{"history": []}')
    (tmp_path / "in" / "gaia" / "skip.txt").write_text("x")
    got = traces.read_traces(spark, f"{tmp_path}/in", recursive=True).collect()
    assert [(r["trace_id"], r["source"], r["payload"]) for r in got] == [("t1", "gaia", '{"history": []}')]
    (tmp_path / "a.jsonl").write_text('{"trace_id": "7", "mistake_agent": "A;B", "mistake_step": "3|n/a"}\n\n{"trace_id": "8", "mistake_agent": null}\n')
    rows = annotations.normalised(annotations.read_annotations(spark, f"{tmp_path}/a.jsonl")).orderBy("row_index").collect()
    assert [(r["row_index"], r["example_id"], r["gold_agents"], r["gold_idxs"]) for r in rows] == [(0, "7", ["A", "B"], ["3"]), (1, "8", [], [])]
    (tmp_path / "b.json").write_text('{"data": [{"id": 1, "agent": "x"}, {"id": 2, "agent": "y"}]}')
    assert annotations.read_annotations(spark, f"{tmp_path}/b.json").count() == 2
    (tmp_path / "c.csv").write_bytes("id;agent\n1;Ж\n".encode("cp1251"))
    assert annotations.read_annotations(spark, f"{tmp_path}/c.csv").first()["agent"] == "Ж"
    annotations.write_json(spark.createDataFrame([(1, float("nan"))], "a int, b double"), f"{tmp_path}/out")
    assert spark.read.text(f"{tmp_path}/out").first()[0] == '{"a":1,"b":null}'
    annotations.write_csv(spark.createDataFrame([(1, 2)], "a int, b int"), f"{tmp_path}/csv", ["b"])
    assert spark.read.text(f"{tmp_path}/csv").first()[0] == "b,a"


def test_a_stream_of_spans_is_scanned_as_a_batch_is(spark, tmp_path):
    from tracewright.operators.scan import scan
    from tracewright.streaming.spans import scanned

    rows = [("t", i, str(i), t, None, None, None) for i, t in enumerate(["bad request", "fine", "connection refused"])]
    df = spark.createDataFrame(rows, "trace_id string, ord int, idx string, text string, agent string, kind string, parent string")
    df.write.parquet(f"{tmp_path}/s")
    q = scanned(spark.readStream.schema(df.schema).parquet(f"{tmp_path}/s")).writeStream.format("memory").queryName("hits").option("checkpointLocation", f"{tmp_path}/c").trigger(availableNow=True).start()
    q.awaitTermination()
    assert {tuple(r) for r in spark.table("hits").collect()} == {tuple(r) for r in scan(df).collect()}


def test_lines_that_are_no_objects_and_tables_of_any_size(spark, tmp_path):
    from tracewright.sources import annotations

    (tmp_path / "a.jsonl").write_text('{"x": 1}\n5\n\n"text"\n{"x": 2}\nnull\n')
    assert [(r["row_index"], r["x"]) for r in annotations.read_annotations(spark, str(tmp_path / "a.jsonl")).orderBy("row_index").collect()] == [(0, 1), (1, 2)]
    many = spark.range(0, 3000, 1, 3).selectExpr("id", "id / 7 AS share", "CASE WHEN id % 2 = 0 THEN 'a|b\nc' END AS said")
    annotations.write_markdown(many, str(tmp_path / "table"))
    lines = [x for f in sorted((tmp_path / "table").glob("part-*")) for x in f.read_text().splitlines()]
    assert lines.count("| id | share | said |") == lines.count("|---|---|---|") == 3
    assert [x for x in lines if x.startswith("| 2 |")] == ["| 2 | 0.286 | a\\|b c |"] and [x for x in lines if x.startswith("| 1 |")] == ["| 1 | 0.143 |  |"]
    assert len(lines) == 3006
