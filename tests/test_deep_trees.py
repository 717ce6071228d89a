"""Span trees of any depth keep all their spans and ancestors."""

import json
import random

from tracewright.operators import findings
from tracewright.sources import traces


def deep(n):
    node = {"span_id": f"s{n - 1}", "span_name": "leaf"}
    for i in range(n - 2, -1, -1):
        node = {"span_id": f"s{i}", "span_name": "n", "child_spans": [node]}
    return json.dumps({"spans": [{"trace_state": "", **node}]})


def test_spans_below_the_two_hundredth_level(spark):
    rows = [("deep", deep(204)), ("flat", deep(1)), ("too deep", deep(520))]
    df = spark.createDataFrame(rows, "trace_id string, payload string").coalesce(1)
    assert [r["trace_id"] for r in traces.unreadable(df).collect()] == ["too deep"]
    got = traces.spans_of(df).where("trace_id = 'deep'").orderBy("ord").collect()
    assert [r["idx"] for r in got] == [f"s{i}" for i in range(204)]
    assert all(r["ancestors"] == [f"s{j}" for j in range(i)] for i, r in enumerate(got))


def test_ancestors_beyond_twelve_doublings(spark):
    """A chain of 4,200 spans and a cycle."""
    rows = [("t", str(i), str(i - 1) if i else None) for i in range(4200)] + [("c", "a", "b"), ("c", "b", "c"), ("c", "c", "a"), ("c", "x", "a")]
    got = findings.ancestors(spark.createDataFrame(rows, "trace_id string, idx string, parent string").coalesce(2))
    sizes = {(r[0], r[1]): r[2] for r in got.selectExpr("trace_id", "idx", "size(ancestors)").collect()}
    assert all(sizes["t", str(i)] == i for i in range(4200))
    assert sizes["c", "x"] == 3


def test_pairs_climb_deep_chains_and_cycles(spark):
    """A chain of 100,000 spans, a fork, a parent that is missing and a cycle."""
    deep = [("t", str(i), str(i - 1) if i else None) for i in range(100_000)]
    rows = [("f", "r", None), ("f", "a", "r"), ("f", "b", "r"), ("f", "a1", "a"), ("f", "m", "gone"), ("c", "a", "b"), ("c", "b", "c"), ("c", "c", "a"), ("c", "x", "a")]
    spans = spark.createDataFrame(deep + rows, "trace_id string, idx string, parent string")
    asked = {
        ("t", "99999", "0"): True, ("t", "99999", "77777"): True, ("t", "5", "6"): False, ("t", "5", "5"): False, ("f", "a1", "r"): True, ("f", "a1", "b"): False, ("f", "m", "gone"): False,
        ("f", "none", "r"): False, ("c", "x", "c"): True, ("c", "a", "x"): False,
    }
    got = findings.above(spark.createDataFrame([(*k,) for k in asked] * 2, "trace_id string, low string, high string"), spans)
    assert sorted(map(tuple, got.select("trace_id", "low", "high").collect())) == sorted(k for k, v in asked.items() if v)
    assert findings.above(got.limit(0), spans).count() == 0


def test_quotes_share_a_run(spark):
    """Against the definition: a run of n characters of the shorter in the longer, or the whole of a short one."""
    texts = ["", "abc", "abcdefgh", "xxabcdefghyy", "bcdefg", "zzzzzzzzzz", "hgfedcba", "a b c d e f"]
    outer = spark.createDataFrame([("k", f"o{i}", t) for i, t in enumerate(texts)], "on string, high string, quote_key string")
    inner = spark.createDataFrame([("k", f"i{i}", t) for i, t in enumerate(texts)] + [("other", "i9", "abcdefgh")], "on string, low string, tool_quote string")

    def shared(a, b, n=6):
        a, b = sorted((a, b), key=len)
        return bool(a) and (a in b if len(a) < n else any(a[i : i + n] in b for i in range(len(a) - n + 1)))

    want = sorted((f"o{i}", f"i{j}") for i, a in enumerate(texts) for j, b in enumerate(texts) if shared(a, b))
    assert sorted((r["high"], r["low"]) for r in findings.sharing_quotes(outer, inner, ["on"], 6).collect()) == want


def test_own_texts_against_a_recursive_walk():
    """Random trees with brackets and quotes inside strings, child lists that are none, and nodes that are no objects."""
    rng = random.Random(7)
    values = [None, 5, -1.5e3, 'a,"]}{[\\', True, [1, {"child_spans": [{"x": 1}]}, "]"], {"spans": [1], "k": "é\ud83d"}, [], {}]

    def node(depth):
        if rng.random() < 0.15:
            return rng.choice([v for v in values if not isinstance(v, dict)])
        made = {"span_id": str(rng.random()), "v": rng.choice(values)}
        if rng.random() < 0.7:
            made["child_spans"] = [node(depth + 1) for _ in range(rng.randrange(4))] if depth < 6 and rng.random() < 0.8 else rng.choice([None, "x", {"a": [1]}])
        return made | {"w": rng.choice(values)}

    def walk(nodes, up, out):
        for n in nodes:
            out.append((n, up))
            at = len(out) - 1
            if isinstance(n, dict) and isinstance(n.get("child_spans"), list):
                out[at] = ({**n, "child_spans": []}, up)
                walk(n["child_spans"], [*up, at], out)
        return out

    for _ in range(500):
        tree = {"a": rng.choice(values), "spans": [node(0) for _ in range(rng.randrange(5))], "z": rng.choice(values)}
        own, above = traces.own_texts(json.dumps(tree, indent=rng.choice([None, 1]), ensure_ascii=rng.random() < 0.5))
        assert [(json.loads(x), up) for x, up in zip(own, above, strict=True)] == walk(tree["spans"], [], [])
    assert [traces.own_texts(x) for x in ("[]", "5", "null", '{"spans": 5}', '[{"spans": [1]}]')] == [([], [])] * 5
    assert traces.own_texts('{"sp\\u0061ns": [ 1 , {"child\\u005fspans": [ ]} ]}') == (["1", '{"child\\u005fspans": []}'], [[], []])


def test_trees_are_one_narrow_plan(spark):
    """No shuffle and no written level, at any depth; own texts hold no children."""
    df = spark.createDataFrame([("a", deep(3)), ("b", "{broken"), ("c", None), ("d", '{"spans": [null, "x", [1, 2], {}]}')], "trace_id string, payload string")
    nodes = traces.tree_nodes(df)
    assert "Exchange" not in nodes._jdf.queryExecution().executedPlan().toString()
    got = nodes.orderBy("trace_id", "ord").collect()
    assert [(r["trace_id"], r["ord"], r["idx"], r["node"], r["ancestors"]) for r in got] == [
        ("a", 0, "s0", None, []), ("a", 1, "s1", None, ["s0"]), ("a", 2, "s2", None, ["s0", "s1"]), ("d", 0, "0", None, []), ("d", 1, "1", "x", []), ("d", 2, "2", "[1,2]", []), ("d", 3, "3", None, []),
    ]
    assert json.loads(got[1]["own"]) == {"span_id": "s1", "span_name": "n", "child_spans": []}
    assert traces.tree_nodes(df.limit(0)).count() == 0
