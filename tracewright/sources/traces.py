"""Raw traces (trace_id, payload) to spans (trace_id, ord, idx, text, agent, kind, parent, ancestors), in built-in functions but for
the walk over a span tree.

JSON objects inside a trace stay JSON text until a field is needed, so key order is the document's. Objects that become text
are written compactly. A payload that is no JSON gives no spans and is listed by unreadable().
"""

from __future__ import annotations

import json
import re

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.rules import MAX_SPAN_TEXT
from ..functions.text import CHAT_ROLES, observation_agent, present, role_agent, stripped

#: Keys under which unknown traces keep their steps, in order of precedence; attributes that name an agent.
TRAJECTORY_KEYS = ("trajectory", "steps", "history", "spans", "messages", "events", "observations", "turns", "conversation")
AGENT_ATTRIBUTES = ("smolagents.managed_agents.0.name", "agent.name", "tool.name")
SPAN_COLUMNS = ["trace_id", "ord", "idx", "text", "agent", "kind", "parent", "ancestors"]
LIST, MAP = "array<string>", "map<string,string>"


def read_traces(spark, path: str, pattern: str = "*.json", recursive: bool = False) -> DataFrame:
    """One trace a file: (trace_id = the file's stem, file, source = the first directory below `path`, payload)."""
    reader = spark.read.option("wholetext", True).option("pathGlobFilter", pattern).option("recursiveFileLookup", recursive)
    rows = reader.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))
    name = F.regexp_extract("file", r"([^/]+?)(?:\.[^./]*)?$", 1)
    below = F.regexp_extract("file", path.rstrip("/").rsplit("/", 1)[-1] + r"/([^/]+)/", 1)
    return rows.select(name.alias("trace_id"), "file", present(below).alias("source"), "payload")


def read_jsonl(spark, path: str) -> DataFrame:
    """One trace a line, blank lines dropped: (file, payload)."""
    return spark.read.text(path).where(F.trim("value") != "").select(F.col("_metadata.file_path").alias("file"), F.col("value").alias("payload"))


def unreadable(traces: DataFrame) -> DataFrame:
    return traces.where(F.try_parse_json("payload").isNull())


def tally(traces: DataFrame) -> DataFrame:
    """(source, traces, ok, skipped): how many of each source's traces can be read; unreadable() lists the others. No trace, no row."""
    bad = F.try_parse_json("payload").isNull()
    return traces.groupBy("source").agg(F.count(F.lit(1)).alias("traces"), F.count_if(~bad).alias("ok"), F.count_if(bad).alias("skipped"))


def required(traces: DataFrame, path: str) -> DataFrame:
    """traces, or an error where there is none: a run over a folder that holds no trace is a mistake in its name."""
    if traces.isEmpty():
        raise FileNotFoundError(f"no traces in {path}")
    return traces


def field(obj: Column, name: str) -> Column:
    """A field of a JSON object as text: strings unquoted, objects as JSON; null if absent or JSON null."""
    return F.from_json(obj, MAP)[name]


def items(obj: Column) -> Column:
    """A JSON list's elements as text; null if it is no list."""
    return F.when(F.ltrim(obj).startswith("["), F.from_json(obj, LIST))


def is_object(x: Column) -> Column:
    return F.coalesce(F.ltrim(x).startswith("{"), F.lit(False))


def has_key(obj: Column, *names: str) -> Column:
    keys = F.json_object_keys(obj)
    return is_object(obj) & F.coalesce(F.arrays_overlap(keys, F.array(*map(F.lit, names))), F.lit(False))


def with_format(traces: DataFrame) -> DataFrame:
    """traces with detected_format; the tests are made in this order."""
    p = F.col("payload")
    top = is_object(p)
    spans, history, seen = items(field(p, "spans")), items(field(p, "history")), items(field(p, "observations"))
    first_span = F.get(F.filter(spans, is_object), F.lit(0))
    first_seen, first = F.get(seen, F.lit(0)), F.get(items(p), F.lit(0))
    gold = has_key(p, "mistake_agent", "mistake_step")
    yes = lambda c: F.coalesce(c, F.lit(False))
    kind = (
        F.when(top & yes(has_key(first_span, "span_name", "trace_state", "span_kind")), "trail")
        .when(top & gold & history.isNotNull(), "who_and_when")
        .when(top & seen.isNotNull() & (has_key(p, "projectId", "htmlPath") | yes(has_key(first_seen, "traceId", "startTime"))), "pumpkin")
        .when(top & (gold | history.isNotNull()), "who_and_when")
        .when(top & yes(F.size(seen) > 0), "pumpkin")
        .when(~top & yes(has_key(first, "mistake_agent", "mistake_step")), "who_and_when")
        .otherwise("unknown")
    )
    return traces.where(F.try_parse_json("payload").isNotNull()).withColumn("detected_format", kind)


#: What a scan of JSON text has to tell apart: strings whole, brackets, and what stands between values.
TOKEN = re.compile(r'"[^"\\]*(?:\\.[^"\\]*)*"|[\[\]{},:]', re.S)


def own_texts(payload: str) -> tuple[list[str], list[list[int]]]:
    """All nodes of a span tree depth first: (each node's own JSON text, its child list emptied; the numbers of its ancestors).

    One pass over the tokens of readable JSON with a stack of open brackets. Each character of the tree is in one text at
    most, so the texts together are no longer than the payload, however deep it is.
    """
    own: list[str | None] = []
    above: list[list[int]] = []
    # An open bracket: [what it is, number of its node or its owner's, where it starts, where its current item starts, last key, child list]
    stack: list[list] = []
    last = None

    def scalar(held: list, end: int) -> None:
        item = payload[held[3] : end].strip()
        if item and not item.startswith("{"):
            own.append(item)
            above.append(line(held[1]))

    def line(owner: int | None) -> list[int]:
        return [] if owner is None else [*above[owner], owner]

    for m in TOKEN.finditer(payload):
        at, c = m.start(), payload[m.start()]
        top = stack[-1] if stack else None
        if c == '"':
            last = m.group()
        elif c == ":":
            top[4] = json.loads(last) if "\\" in last else last[1:-1]
        elif c == "{":
            kind, number = ("root" if top is None else "other"), None
            if top and top[0] == "list":
                kind, number = "node", len(own)
                own.append(None)
                above.append(line(top[1]))
            stack.append([kind, number, at, None, None, None])
        elif c == "[":
            tree = top and (top[0], top[4]) in (("root", "spans"), ("node", "child_spans"))
            stack.append(["list" if tree else "other", top[1] if tree else None, at, at + 1, None, None])
        elif c == ",":
            if top[0] == "list":
                scalar(top, at)
                top[3] = at + 1
        else:
            stack.pop()
            if top[0] == "node":
                i, j = top[5] or (at, at)
                own[top[1]] = payload[top[2] : i] + ("[]" if top[5] else "") + payload[j : at + 1]
            elif top[0] == "list":
                scalar(top, at)
                stack[-1][5] = (top[2], at + 1)
    return own, above


def tree_nodes(traces: DataFrame) -> DataFrame:
    """(trace_id, ord, idx, own, node, fields, ancestors) of span trees, depth first, in one narrow pass at any depth: `own` is the
    raw JSON text of a node without its children, `fields` an object's fields as text, `node` the text of what is no object;
    idx is the node's id, else its running number. Payloads that are no JSON give no rows.
    """

    @F.pandas_udf("own array<string>, above array<array<int>>")
    def nodes(payloads: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([own_texts(p) for p in payloads], columns=["own", "above"])

    item = lambda x: F.get(F.from_json(F.concat(F.lit("["), x, F.lit("]")), LIST), F.lit(0))
    held = lambda x: F.struct(x.alias("own"), F.when(~is_object(x), item(x)).alias("node"), F.when(is_object(x), F.from_json(x, MAP)).alias("fields"))
    named = lambda x, i: F.coalesce(*[present(x["fields"][k]) for k in ("span_id", "spanId", "id")], i.cast("string"))
    trees = traces.where(F.try_parse_json("payload").isNotNull()).select("trace_id", nodes("payload").alias("t"))
    trees = trees.select("trace_id", F.transform("t.own", held).alias("nodes"), "t.above").withColumn("ids", F.transform("nodes", named))
    lines = F.transform("above", lambda up: F.transform(up, lambda i: F.get(F.col("ids"), i)))
    rows = trees.select("trace_id", F.posexplode(F.arrays_zip("nodes", "ids", lines.alias("lines"))).alias("ord", "x"))
    return rows.select("trace_id", "ord", F.col("x.ids").alias("idx"), "x.nodes.*", F.col("x.lines").alias("ancestors"))


def raw_texts(traces: DataFrame) -> DataFrame:
    """(trace_id, idx, text) of span trees: all that a node holds but its children, inputs and outputs included, as JSON text; a
    text node's text. What tree_spans() leaves out for the rules, a reader wants to see."""
    return tree_nodes(traces).select("trace_id", "idx", F.coalesce("node", "own").alias("text"))


def tree_spans(traces: DataFrame) -> DataFrame:
    """Span trees depth first: text and agent of each node from its own fields, without its children."""
    given = F.col("fields")
    attrs = F.coalesce(F.when(is_object(given["span_attributes"]), F.from_json(given["span_attributes"], MAP)), F.from_json(F.lit("{}"), MAP))
    kind = F.upper(F.coalesce(present(attrs["openinference.span.kind"]), present(given["span_kind"])))
    keep = F.map_filter(attrs, lambda k, v: ~F.lower(k).contains("input") & ~F.lower(k).contains("messages") & ~((F.coalesce(kind, F.lit("")) == "LLM") & F.lower(k).contains("output")))
    parts = [present(given[k]) for k in ("span_name", "span_kind", "status_code", "status_message", "events", "logs")]
    text = F.concat_ws(" ", *parts, F.filter(F.map_values(keep), lambda v: v.isNotNull() & (v != "")))
    agent = F.coalesce(*[present(attrs[k]) for k in AGENT_ATTRIBUTES], present(given["span_name"]))
    whole = given.isNotNull()
    return tree_nodes(traces).select(
        "trace_id", "ord", "idx", F.when(whole, text).otherwise(F.col("node")).alias("text"), F.when(whole, agent).alias("agent"), F.when(whole, kind).alias("kind"),
        F.try_element_at("ancestors", F.lit(-1)).alias("parent"), "ancestors",
    )


def _flat(rows: DataFrame, text: Column, agent: Column, idx: Column | None = None) -> DataFrame:
    none = F.lit(None).cast("string")
    return rows.select("trace_id", "ord", (idx if idx is not None else F.col("ord").cast("string")).alias("idx"), text.alias("text"), agent.alias("agent"), none.alias("kind"), none.alias("parent"), F.array().cast(LIST).alias("ancestors"))


def step_spans(traces: DataFrame) -> DataFrame:
    """Steps of a history. Where all roles are chat roles the name is the agent, else the role."""
    p = F.col("payload")
    steps = F.when(is_object(p), F.coalesce(items(field(p, "history")), items(field(p, "trajectory")))).otherwise(items(p))
    role = lambda s: F.when(is_object(s), field(s, "role"))
    chat = F.forall(steps, lambda s: role(s).isNull() | F.lower(stripped(role(s))).isin(*CHAT_ROLES))
    rows = traces.select("trace_id", chat.alias("chat"), F.posexplode(steps).alias("ord", "s"))
    s = F.col("s")
    agent = F.coalesce(F.when(F.col("chat"), present(field(s, "name"))).otherwise(role_agent(field(s, "role"))), present(field(s, "mistake_agent")), present(field(s, "agent")))
    text = F.when(has_key(s, "content"), F.concat_ws(" ", present(field(s, "name")), present(field(s, "content")))).otherwise(s)
    return _flat(rows, F.coalesce(text, F.lit("")), F.when(is_object(s), agent))


def observation_spans(traces: DataFrame) -> DataFrame:
    """Observations by start time as text, missing first, then by position."""
    seen = items(field(F.col("payload"), "observations"))
    keyed = F.transform(seen, lambda o, i: F.struct(F.coalesce(F.when(is_object(o), field(o, "startTime")), F.lit("")).alias("at"), i.alias("i"), o.alias("o")))
    rows = traces.select("trace_id", F.posexplode(F.array_sort(keyed)).alias("ord", "x"))
    o = F.col("x.o")
    text = F.concat_ws(" ", *[present(field(o, k)) for k in ("level", "statusMessage", "input", "output")])
    idx = F.coalesce(F.when(is_object(o), present(field(o, "id"))), F.col("ord").cast("string"))
    return _flat(rows, F.when(is_object(o), text).otherwise(o), F.when(is_object(o), observation_agent(field(o, "name"))), idx)


def other_spans(traces: DataFrame) -> DataFrame:
    """Unknown formats: a list as it is, else the first trajectory key with a list, else the longest list (of objects, if there
    is one), else the whole object."""
    p = F.col("payload")
    named = F.coalesce(*[F.when(F.size(items(field(p, k))) > 0, items(field(p, k))) for k in TRAJECTORY_KEYS])
    every = F.filter(F.transform(F.map_values(F.from_json(p, MAP)), items), lambda v: F.coalesce(F.size(v) > 0, F.lit(False)))
    ranked = F.transform(every, lambda v, i: F.struct(is_object(F.get(v, F.lit(0))).cast("int").alias("objects"), F.size(v).alias("n"), (-i).alias("at"), v.alias("v")))
    longest = F.when(F.size(every) > 0, F.array_max(ranked)["v"])
    steps = F.coalesce(F.when(is_object(p), F.coalesce(named, longest)), items(p), F.array(p))
    rows = traces.select("trace_id", F.posexplode(steps).alias("ord", "s"))
    s = F.col("s")
    # Steps with an index of their own and substeps keep that index, which annotations cite.
    native = has_key(s, "index") & has_key(s, "substeps")
    idx = F.coalesce(F.when(native, field(s, "index")), F.col("ord").cast("string"))
    text = F.when(native, substeps_text(s)).otherwise(F.coalesce(s, F.lit("")))
    return _flat(rows, text, F.when(is_object(s), F.coalesce(present(field(s, "agent_name")), present(field(s, "agent")))), idx)


def substeps_text(step: Column) -> Column:
    """`role: content` lines of a step's substeps; a Python-literal list is read by swapping quotes, else the step stays as it is."""
    raw = field(step, "substeps")
    swapped = F.replace(raw, F.lit("'"), F.lit('"'))
    subs = F.when(F.try_parse_json(raw).isNotNull(), items(raw)).when(F.try_parse_json(swapped).isNotNull(), items(swapped))
    line = lambda x: F.when(is_object(x), F.concat(F.coalesce(F.concat(present(field(x, "role")), F.lit(": ")), F.lit("")), F.coalesce(field(x, "content"), x))).otherwise(x)
    return F.coalesce(F.array_join(F.filter(F.transform(subs, line), lambda x: x != ""), "\n"), step)


def _conversation(traces: DataFrame) -> tuple[Column, Column]:
    given = field(F.col("payload"), "input")
    return given, items(field(given, "conversation_history"))


def conversation_spans(traces: DataFrame) -> DataFrame:
    """AEGIS records: the steps of input.conversation_history."""
    rows = traces.select("trace_id", F.posexplode(_conversation(traces)[1]).alias("ord", "s"))
    s = F.col("s")
    agent = F.coalesce(present(field(s, "agent_name")), present(field(s, "agent")))
    return _flat(rows, F.coalesce(s, F.lit("")), F.when(is_object(s), agent))


def predicted_answers(traces: DataFrame) -> DataFrame:
    """(trace_id, predicted_answer) of AEGIS records: input.final_output, else the last content of the conversation."""
    given, steps = _conversation(traces)
    said = F.filter(F.transform(steps, lambda x: F.when(is_object(x), field(x, "content"))), lambda x: x != "")
    final = field(given, "final_output")
    return traces.select("trace_id", F.coalesce(F.when(final != "", final), F.try_element_at(said, F.lit(-1))).alias("predicted_answer"))


BRANCHES = {"trail": tree_spans, "who_and_when": step_spans, "pumpkin": observation_spans, "unknown": other_spans}


def spans_of(traces: DataFrame) -> DataFrame:
    """Spans of all traces, each by its format's branch; text is capped at MAX_SPAN_TEXT characters."""
    rows = with_format(traces)
    out = None
    for kind, branch in BRANCHES.items():
        part = branch(rows.where(F.col("detected_format") == kind)).select(*SPAN_COLUMNS)
        out = part if out is None else out.unionByName(part)
    return out.withColumn("text", F.left(F.coalesce("text", F.lit("")), F.lit(MAX_SPAN_TEXT)))


def rendered(spans: DataFrame, with_header: bool = False) -> DataFrame:
    """(trace_id, trace): spans as numbered blocks for a judge, `[idx] agent: X` and the text; with_header adds kind and parent."""
    extra = F.concat_ws("", F.when(F.lit(with_header), F.concat(F.lit(" kind="), F.coalesce("kind", F.lit("-")), F.lit(" parent="), F.coalesce("parent", F.lit("-")))))
    block = F.concat(F.lit("["), "idx", F.lit("] agent: "), F.coalesce("agent", F.lit("unknown")), extra, F.lit("\n"), F.col("text"))
    each = F.array_sort(F.collect_list(F.struct("ord", block.alias("block"))))
    return spans.groupBy("trace_id").agg(F.array_join(F.transform(each, lambda x: x["block"]), "\n").alias("trace"))
