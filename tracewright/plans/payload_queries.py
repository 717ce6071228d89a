"""Registered queries of the payload readers, adapters, judges' boundary and answer operators: the driver's tables are dressed
up as payloads, read by the operators, and held against SQL over the plain tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text
from ..operators import accuracy, answers, findings, judges, observations, verify
from ..sources import observations as observed
from ..sources import traces
from . import views
from .views import SPANS_SQL, table


def _id() -> Column:
    return F.col("event_id")


def _str(x: Column | str) -> Column:
    return (F.col(x) if isinstance(x, str) else x).cast("string")


def _payload(rows: DataFrame, item: Column, order: Column, key: str = "observations", **more: Column) -> DataFrame:
    """(trace_id, payload): each trace's items in order, as a JSON object."""
    listed = F.transform(F.array_sort(F.collect_list(F.struct(order.alias("_at"), item.alias("_item")))), lambda x: x["_item"])
    body = F.to_json(F.struct(*[v.alias(k) for k, v in more.items()], listed.alias(key)))
    return rows.groupBy("trace_id").agg(body.alias("payload"))


def event_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as observations: clicks are agents' runs, views and purchases generations below the last click, errors
    tools and sign-ups chains."""
    e = table(spark, sf_dir, "events").select(_str("user_id").alias("trace_id"), "event_id", "event_type", "ts")
    kind = F.when(F.col("event_type") == "click", "SPAN").when(F.col("event_type").isin("view", "purchase"), "GENERATION").when(F.col("event_type") == "error", "TOOL").otherwise("CHAIN")
    agent = F.concat(F.lit("agent"), _str(_id() % 4))
    name = F.when(F.col("event_type") == "click", F.concat(agent, F.lit(" run"))).when(F.col("event_type") == "purchase", "running 1 tool").when(F.col("event_type") == "error", F.concat(F.lit("tool"), _str(_id() % 3))).otherwise("chat")
    before = Window.partitionBy("trace_id").orderBy("event_id")
    click = F.last(F.when(F.col("event_type") == "click", _id()), ignorenulls=True).over(before)
    said = F.to_json(F.array(F.struct(F.concat(F.lit("be "), agent).alias("content"))))
    rows = e.select(
        "trace_id", "event_id", F.struct(
            F.concat(F.lit("o"), _str(_id())).alias("id"), kind.alias("type"), name.alias("name"),
            F.when(kind == "GENERATION", F.concat(F.lit("o"), _str(click))).alias("parent_observation_id"), F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'").alias("start_time"),
            (_id() % 9 * 1000).alias("latency"), F.when(_id() % 6 == 0, F.concat(F.lit("failed "), _str(_id()))).alias("status_message"), F.when(_id() % 5 > 0, F.concat(F.lit("m"), _str(_id() % 3))).alias("model"),
            F.struct((_id() % 100).alias("input"), (_id() % 7).alias("output")).alias("usage_details"),
            F.struct(F.struct(said.alias(observed.INSTRUCTIONS)).alias("attributes")).alias("metadata"),
        ).alias("o"),
    )
    return observed.observations_of(_payload(rows, F.col("o"), _id()))


OBS_SQL = """obs AS (SELECT CAST(user_id AS VARCHAR) AS trace_id, event_id, event_type, ts, row_number() OVER (PARTITION BY user_id ORDER BY event_id) - 1 AS ord, 'agent' || (event_id % 4) AS agent,
  last_value(CASE WHEN event_type = 'click' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY event_id) AS click FROM events)"""


def q_obs_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = event_observations(spark, sf_dir)
    return observations.usage_of_agents(observations.agent_runs(rows), rows)


def q_obs_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed.run_agents(event_observations(spark, sf_dir))


def q_obs_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observations.run_errors(observations.agent_runs(event_observations(spark, sf_dir)))


def q_obs_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = observed.chain_states(event_observations(spark, sf_dir))
    return out.select("trace_id", "ord", "state_id", "type", "content", F.unix_micros("at").alias("at_us"))


def q_obs_tools(spark: SparkSession, sf_dir: str) -> DataFrame:
    return observed.chain_tools(event_observations(spark, sf_dir))


def q_tools_of_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(_str("user_id").alias("trace_id"), "event_id", "event_type", F.concat(F.lit("agent"), _str(_id() % 4)).alias("agent"))
    calls = e.where("event_type = 'error'").withColumn("name", F.concat(F.lit("tool"), _str(_id() % 3)))
    offered = e.where("event_type = 'view'").select("trace_id", "agent", _id().alias("ord"), F.array(F.concat(F.lit("t"), _str(_id() % 5)), F.lit("x")).alias("tools"))
    out = observations.tools_of_agents(calls, offered)
    return out.select("trace_id", "agent", F.array_join("called", ",").alias("called"), F.array_join("available", ",").alias("available"))


def q_task_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as tasks whose pool is their nations."""
    n = table(spark, sf_dir, "nation")
    one = F.struct(F.col("n_name").alias("name"), F.concat(F.lit("speak for "), "n_name").alias("instructions"))
    pool = F.transform(F.array_sort(F.collect_list(F.struct("n_nationkey", one.alias("a")))), lambda x: x["a"])
    tasks = n.groupBy(_str("n_regionkey").alias("trace_id")).agg(F.struct(F.lit("t").alias("id"), F.lit("SPAN").alias("type"), F.lit("run_task_1").alias("name"), F.struct(pool.alias("pool"), F.lit("graph TD").alias("graph")).alias("output")).alias("o"))
    out = observed.task_agents(observed.observations_of(_payload(tasks, F.col("o"), F.lit(0))))
    return out.select("trace_id", "ord", "agent", "instructions", "graph")


def q_agent_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A nation's suppliers as a binary tree of agents whose edges are written last first, with two agents on a cycle, one without
    an edge, and every fourth under two node ids."""
    s = table(spark, sf_dir, "supplier")
    place = F.row_number().over(Window.partitionBy("s_nationkey").orderBy("s_suppkey"))
    named = s.select("s_nationkey", "s_suppkey", place.alias("i"))
    node = lambda i: F.concat(F.when(i % 4 == 0, F.lit("alias")).otherwise("n"), _str(i), F.lit("["), F.lit("Agent "), _str(i), F.lit("]"))
    up = F.floor(F.col("i") / 2).cast("int")
    edge = F.concat(F.lit("  "), node(up), F.lit(" --> "), node(F.col("i")))
    again = F.when(F.col("i") % 4 == 0, F.concat(F.lit("\n  twin"), _str("i"), F.lit("[Agent "), _str("i"), F.lit("]"))).otherwise("")
    lines = named.where("i > 1").select(_str("s_nationkey").alias("trace_id"), (-F.col("i")).alias("at"), F.concat(edge, again).alias("e"))
    ends = F.lit("\n  x[Cycle A] --> y[Cycle B]\n  y[Cycle B] --> x[Cycle A]\n  z[Alone]")
    text_of = F.concat(F.lit("graph TD\n"), F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "e"))), lambda x: x["e"]), "\n"), ends)
    return observations.agent_order(lines.groupBy("trace_id").agg(text_of.alias("graph")))


AGENT_ORDER_SQL = """WITH s AS (SELECT s_nationkey AS k, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_suppkey) AS i, count(*) OVER (PARTITION BY s_nationkey) AS n FROM supplier),
placed AS (SELECT k, 'Agent ' || i AS agent, floor(log2(i)) AS level, -i AS pos FROM s WHERE n > 1
  UNION ALL SELECT DISTINCT k, 'Alone', 0, 0 FROM s WHERE n > 1 UNION ALL SELECT DISTINCT k, 'Cycle A', 99, 0 FROM s WHERE n > 1 UNION ALL SELECT DISTINCT k, 'Cycle B', 99, 1 FROM s WHERE n > 1)
SELECT CAST(k AS VARCHAR) AS trace_id, agent, row_number() OVER (PARTITION BY k ORDER BY level, pos) - 1 AS rank FROM placed"""


def q_dialogue(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as the messages of one agent's run; every third turn also calls a tool."""
    c = table(spark, sf_dir, "conversations")
    none = F.lit(None).cast("string")
    part = lambda kind, content, name: F.struct(F.lit(kind).alias("type"), content.alias("content"), F.lit("c").alias("id"), name.alias("name"))
    said, call = part("text", F.col("text"), none), part("tool_call", none, F.lit("look"))
    parts = F.when(F.col("turn") % 3 == 1, F.array(said, call)).otherwise(F.array(said))
    message = F.struct(F.col("role"), parts.alias("parts"))
    listed = F.to_json(F.transform(F.array_sort(F.collect_list(F.struct("turn", message.alias("m")))), lambda x: x["m"]))
    runs = c.groupBy(_str("conv_id").alias("trace_id")).agg(F.struct(F.lit("r").alias("id"), F.lit("SPAN").alias("type"), F.lit("helper run").alias("name"), F.struct(F.struct(listed.alias(observed.MESSAGES)).alias("attributes")).alias("metadata")).alias("o"))
    rows = observed.observations_of(_payload(runs, F.col("o"), F.lit(0)))
    spoken = observations.dialogue(observations.states(observed.agent_messages(rows, observed.run_agents(rows))))
    return spoken.select("trace_id", "agent", "msg", "role", "state_id", F.md5("content").alias("content_md5"))


def q_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as tasks of two agents, the second silent: the helper's assistant turns call a tool whose runner succeeds, fails
    or is not there by turn, user turns hold the responses. Every fourth has no pool, so that only its runs' errors count."""
    c = table(spark, sf_dir, "conversations").withColumn("trace_id", _str("conv_id"))
    t, none = F.col("turn"), F.lit(None).cast("string")
    call = F.concat(F.lit("c"), _str(t))
    part = lambda kind, **more: F.struct(F.lit(kind).alias("type"), *[more.get(k, none).alias(k) for k in ("content", "id", "name", "arguments", "result")])
    extra = F.when(F.col("role") == "assistant", part("tool_call", id=call, name=F.lit("look"), arguments=F.concat(F.lit("{}"), _str(t)))).otherwise(part("tool_call_response", result=F.concat(F.lit("got "), _str(t))))
    message = F.struct(F.col("role"), F.array(part("text", content=F.md5("text")), extra).alias("parts"))
    each = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("turn", x.alias("x")))), lambda v: v["x"])
    shape = lambda kind, id_, name, **more: F.struct(F.lit(kind).alias("type"), id_.alias("id"), F.lit(name).alias("name"), *[more.get(k, F.lit(None).cast(t)).alias(k) for k, t in OBSERVATION.items()])
    attributes = lambda **more: F.to_json(F.struct(F.struct(*[v.alias(k.replace("__", ".")) for k, v in more.items()]).alias("attributes")))
    runner = F.when((F.col("role") == "assistant") & (t % 3 > 0), shape("SPAN", call, "running tool: look", metadata=attributes(gen_ai__tool__call__id=call, tool_response=F.concat(F.lit("r"), _str(t))), status_message=F.when(t % 3 == 2, "broke")))
    k = F.col("conv_id")
    task = shape("SPAN", F.lit("t"), "gaia_task_1", output=F.when(k % 4 > 0, F.lit('{"pool": [{"name": " helper ", "instructions": "lead"}, {"name": "second"}, {"name": ""}]}')))
    run = shape("SPAN", F.lit("r"), "helper run", metadata=F.to_json(F.struct(F.struct(F.to_json("m").alias(observed.MESSAGES)).alias("attributes"))), latency=F.lit("1504"), status_message=F.when(k % 8 == 0, F.concat(F.lit("lost "), _str(k))))
    spoken = shape("GENERATION", F.lit("g"), "chat", parent_observation_id=F.lit("r"), usage_details=F.concat(F.lit('{"input": '), _str(k), F.lit(', "output": 3}')), metadata=attributes(model_request_parameters=F.lit('{"function_tools": [{"name": "look"}, {"name": "ask"}]}')))
    tasks = c.groupBy("trace_id", "conv_id").agg(each(message).alias("m"), F.array_compact(each(runner)).alias("runners"))
    body = F.to_json(F.struct(F.lit("test").alias("environment"), F.struct(F.concat(F.lit("why "), _str(k)).alias("question")).alias("output"), F.concat(F.array(task, run, spoken), "runners").alias("observations")))
    out = observed.evaluation_inputs(tasks.select("trace_id", body.alias("payload")))
    lines = lambda c, *names: F.array_join(F.transform(c, lambda x: F.concat_ws("|", *[x[n].cast("string") for n in names])), "\n")
    calls = F.array_join(F.transform("agent_states", lambda s: F.concat_ws("|", s["state_id"], s["type"], s["content"], s["tool_call"]["id"], s["tool_call"]["result"], s["tool_call"]["status_message"])), "\n")
    tools = F.array_join(F.transform("agents_tools_info", lambda x: F.concat_ws("|", x["agent_name"], F.size(x["tools_called"]).cast("string"), F.array_join(x["available_tools"], ","))), "\n")
    return out.select(
        "trace_id", "user_query", "environment", lines("dialogue_history", "role", "content").alias("dialogue"), lines("agent_responses", "response_id", "content").alias("responses"), calls.alias("states"),
        tools.alias("tools"), lines("agents_usage", "agent_name", "input_tokens", "output_tokens", "latency").alias("usage"), lines("agents_pool", "agent_name", "instructions").alias("pool"), lines("agents_errors", "agent_name", "error_message").alias("errors"),
    )


#: An observation's fields beside type, id and name, as the query writes them.
OBSERVATION = dict.fromkeys(("metadata", "output", "parent_observation_id", "usage_details", "latency", "status_message"), "string")
RECORDS_SQL = """WITH turns AS (SELECT conv_id AS k, turn, role, md5(text) AS said, row_number() OVER (PARTITION BY conv_id, role ORDER BY turn) AS nth FROM conversations WHERE conv_id % 4 > 0),
shown AS (SELECT k, turn, 0 AS part, role || '.text|' || said AS line FROM turns
  UNION ALL SELECT k, turn, 1, concat_ws('|', CASE WHEN role = 'user' THEN 'user.tool_call_response' WHEN turn % 3 = 2 THEN 'assistant.invalid_tool_call' ELSE 'assistant.tool_call' END,
    CASE WHEN role = 'user' THEN 'got ' || turn ELSE '{}' || turn END, CASE WHEN role <> 'user' AND turn % 3 > 0 THEN 'c' || turn END, CASE WHEN role <> 'user' AND turn % 3 > 0 THEN 'r' || turn END, CASE WHEN role <> 'user' AND turn % 3 = 2 THEN 'broke' END) FROM turns WHERE role <> 'system'),
states AS (SELECT k, string_agg('helper_' || place || '|' || line, chr(10) ORDER BY place) AS states FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY turn, part) AS place FROM shown) GROUP BY 1),
spoken AS (SELECT k, string_agg(role || '|' || said, chr(10) ORDER BY turn) AS dialogue, string_agg('helper_' || nth || '|' || said, chr(10) ORDER BY turn) FILTER (role = 'assistant') AS responses, count(*) FILTER (role = 'assistant') AS calls FROM turns GROUP BY 1)
SELECT CAST(c.k AS VARCHAR) AS trace_id, CASE WHEN s.k IS NOT NULL THEN 'why ' || c.k END AS user_query, 'test' AS environment, coalesce(dialogue, '') AS dialogue, coalesce(responses, '') AS responses, coalesce(states, '') AS states,
  CASE WHEN s.k IS NOT NULL THEN 'helper|' || calls || '|look,ask' ELSE '' END AS tools, CASE WHEN s.k IS NOT NULL THEN 'helper|' || c.k || '|3|1.5' ELSE '' END AS usage, CASE WHEN s.k IS NOT NULL THEN 'helper|lead' || chr(10) || 'second' ELSE '' END AS pool,
  CASE WHEN c.k % 8 = 0 THEN 'helper|lost ' || c.k ELSE '' END AS errors FROM (SELECT DISTINCT conv_id AS k FROM conversations) c LEFT JOIN spoken s USING (k) LEFT JOIN states t USING (k)"""


def q_tree(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Regions as span trees: a root, its nations, their suppliers. Every sixth supplier has no id; suppliers' attributes name agents
    in three ways and hold inputs and outputs; nations have what follows their children."""
    k = F.col("s_suppkey")
    said = lambda word: F.concat(F.lit(word), _str(k))
    attrs = F.struct(
        F.when(k % 7 == 0, said("Managed ")).alias("smolagents.managed_agents.0.name"), F.when(k % 4 == 1, said("Agent ")).alias("agent.name"), F.when(k % 4 < 3, said("Tool ")).alias("tool.name"),
        F.when(k % 3 == 0, "llm").alias("openinference.span.kind"), F.lit("asked").alias("input.value"), F.lit("m").alias("llm.Messages"), said("said ").alias("output.value"), F.lit("").alias("note"),
    )
    leaf = F.struct(
        F.when(k % 6 > 0, said("s")).alias("span_id"), F.col("s_name").alias("span_name"), F.lit("tool").alias("span_kind"), attrs.alias("span_attributes"), F.lit("OK").alias("status_code"),
        F.when(k % 3 == 1, said("failed \\ \"")).alias("status_message"), F.when(k % 2 == 0, F.array(F.struct(said("e").alias("name")))).alias("events"), F.when(k % 5 == 1, said("] } log ")).alias("logs"),
    )
    inner = lambda at, x: F.transform(F.array_sort(F.collect_list(F.struct(F.col(at).alias("at"), x.alias("x")))), lambda v: v["x"])
    kids = table(spark, sf_dir, "supplier").groupBy("s_nationkey").agg(inner("s_suppkey", leaf).alias("kids"))
    n = table(spark, sf_dir, "nation").join(kids, F.col("n_nationkey") == F.col("s_nationkey"), "left")
    node = F.struct(F.concat(F.lit("n"), _str("n_nationkey")).alias("span_id"), F.col("n_name").alias("span_name"), F.col("kids").alias("child_spans"), F.lit("chain").alias("span_kind"))
    tops = n.groupBy("n_regionkey").agg(inner("n_nationkey", node).alias("kids")).join(table(spark, sf_dir, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    root = F.struct(F.concat(F.lit("r"), _str("r_regionkey")).alias("span_id"), F.col("r_name").alias("span_name"), F.lit("agent").alias("span_kind"), F.col("kids").alias("child_spans"))
    raw = tops.select(_str("r_regionkey").alias("trace_id"), F.to_json(F.struct(F.array(root).alias("spans"))).alias("payload"))
    return traces.spans_of(raw).select("trace_id", "ord", "idx", "text", "agent", "kind", "parent", F.size("ancestors").alias("n_ancestors"))


TREE_SQL = """WITH named AS (SELECT *, s_suppkey AS k, CASE WHEN s_suppkey % 7 = 0 THEN 'Managed ' || s_suppkey END AS a, CASE WHEN s_suppkey % 4 = 1 THEN 'Agent ' || s_suppkey END AS b, CASE WHEN s_suppkey % 4 < 3 THEN 'Tool ' || s_suppkey END AS c FROM supplier),
rows AS (
  SELECT r_regionkey AS r, -1 AS n, -1 AS s, 'r' || r_regionkey AS idx, r_name || ' agent' AS text, r_name AS agent, 'AGENT' AS kind, CAST(NULL AS VARCHAR) AS parent, 0 AS n_ancestors FROM region WHERE r_regionkey IN (SELECT n_regionkey FROM nation)
  UNION ALL SELECT n_regionkey, n_nationkey, -1, 'n' || n_nationkey, n_name || ' chain', n_name, 'CHAIN', 'r' || n_regionkey, 1 FROM nation
  UNION ALL SELECT n_regionkey, n_nationkey, k, CASE WHEN k % 6 > 0 THEN 's' || k END,
    concat_ws(' ', s_name, 'tool', 'OK', CASE WHEN k % 3 = 1 THEN 'failed \\ "' || k END, CASE WHEN k % 2 = 0 THEN '[{"name":"e' || k || '"}]' END, CASE WHEN k % 5 = 1 THEN '] } log ' || k END, a, b, c, CASE WHEN k % 3 = 0 THEN 'llm' ELSE 'said ' || k END),
    coalesce(a, b, c, s_name), CASE WHEN k % 3 = 0 THEN 'LLM' ELSE 'TOOL' END, 'n' || n_nationkey, 2 FROM named JOIN nation ON s_nationkey = n_nationkey),
placed AS (SELECT *, row_number() OVER (PARTITION BY r ORDER BY n, s) - 1 AS ord FROM rows)
SELECT CAST(r AS VARCHAR) AS trace_id, ord, coalesce(idx, CAST(ord AS VARCHAR)) AS idx, text, agent, kind, parent, n_ancestors FROM placed"""


def q_observation_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as a trace store's observations, written last first; every tenth has no start time."""
    e = table(spark, sf_dir, "events").withColumn("trace_id", _str("user_id"))
    name = F.when(_id() % 7 == 0, "running tools run").otherwise(F.concat(F.initcap("event_type"), F.lit(" Agent run 1")))
    o = F.struct(_str(_id()).alias("id"), _str("user_id").alias("traceId"), name.alias("name"), F.when(_id() % 10 > 0, F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS")).alias("startTime"), F.lit("ERROR").alias("level"), F.col("event_type").alias("statusMessage"), F.when(_id() % 2 == 0, "asked").alias("input"), F.lit("").alias("output"))
    return traces.spans_of(_payload(e.select("trace_id", "event_id", o.alias("o")), F.col("o"), -_id(), projectId=F.lit("p"))).select("trace_id", "ord", "idx", "text", "agent")


OBSERVATION_SPANS_SQL = """SELECT CAST(user_id AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY user_id ORDER BY CASE WHEN event_id % 10 > 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%S.%f') ELSE '' END, event_id DESC) - 1 AS ord,
  CAST(event_id AS VARCHAR) AS idx, 'ERROR ' || event_type || CASE WHEN event_id % 2 = 0 THEN ' asked' ELSE '' END AS text, CASE WHEN event_id % 7 > 0 THEN upper(event_type[1]) || event_type[2:] || ' Agent' END AS agent FROM events"""


def q_turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations in an unknown format, under `turns`."""
    c = table(spark, sf_dir, "conversations").withColumn("trace_id", _str("conv_id"))
    step = F.struct(F.when(F.col("turn") % 2 == 0, F.concat(F.lit("Bot "), "role")).alias("agent_name"), F.col("role").alias("agent"), F.md5("text").alias("content"))
    spans = traces.spans_of(_payload(c.select("trace_id", "turn", step.alias("o")), F.col("o"), F.col("turn"), key="turns"))
    return spans.select("trace_id", "ord", "idx", "agent", F.get_json_object("text", "$.content").alias("content"))


def q_prompts(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer")
    asked = c.select(_str("c_custkey").alias("trace_id"), F.col("c_name").alias("user_query"), F.col("c_mktsegment").alias("agent_states"), F.lit("h").alias("dialogue_history"), F.lit("r").alias("agent_responses"), F.lit("t").alias("agents_tools_info"), F.lit("a").alias("agents"))
    return judges.prompts(asked).select("trace_id", "metric_ord", "metric_name", "input")


PROMPTS_SQL = """WITH shown(metric_ord, metric_name, keys) AS (VALUES (0, 'MAS_TASK_COMPLETION', 's'), (1, 'mas_task_transfer', 's'), (2, 'mas_complexity', 's'), (3, 'mas_roles_distribution', 's'), (4, 'mas_planning', 's'),
  (5, 'observation_alignment', 'o'), (6, 'policy_alignment', 's'), (7, 'state_consistency', 'd'), (8, 'tool_selection', 't'), (9, 'tool_parameter_extraction', 't'), (10, 'task_completeness', 's'), (11, 'tool_performance', 't'), (12, 'prompt_quality', 'a'))
SELECT CAST(c_custkey AS VARCHAR) AS trace_id, metric_ord, metric_name, '{' || CASE keys WHEN 'a' THEN '"agents":"a"' ELSE '"user_query":"' || c_name || '"' END || CASE WHEN keys IN ('s', 'd', 't') THEN ',"agent_states":"' || c_mktsegment || '"' ELSE '' END
  || CASE keys WHEN 'o' THEN ',"dialogue_history":"h","agent_responses":"r"' WHEN 'd' THEN ',"dialogue_history":"h"' WHEN 't' THEN ',"agents_tools_info":"t"' ELSE '' END || '}' AS input FROM customer, shown"""


def q_judge_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Answers of a judge, fenced; every fifth is no JSON."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    cite = lambda n: F.struct(_str(_id() % 50 + n).alias("idx"), F.lit("primary").alias("role"), F.concat(F.lit("said "), _str(_id())).alias("quote"))
    one = F.struct(F.when(_id() % 2 == 0, "major").otherwise("minor").alias("severity_estimate"), F.lit("high").alias("confidence_estimate"), F.array(F.struct(F.concat(F.lit("agent"), _str(_id() % 5)).alias("agent"))).alias("culprit_agent_candidates"), F.array(cite(0), cite(1)).alias("evidence"))
    body = F.concat(F.lit("```json\n"), F.to_json(F.struct(F.array(one, one).alias("findings"))), F.lit("\n```"))
    said = e.select(_str(_id()).alias("trace_id"), F.lit(8).alias("metric_ord"), F.lit("tool_selection").alias("metric_name"), F.when(_id() % 5 > 0, body).otherwise("no findings, sorry").alias("output"))
    found = judges.findings_of(said)
    return found.drop("evidence_idxs", "evidence", "metric_ord", "needs_human_review", "problem_description", "suggested_fix").withColumn("culprit_agents", F.array_join("culprit_agents", ",")).join(judges.citations(found), ["trace_id", "metric_name", "finding_index"])


JUDGE_ANSWERS_SQL = """SELECT CAST(event_id AS VARCHAR) AS trace_id, 'tool_selection' AS metric_name, f AS finding_index, CASE WHEN event_id % 2 = 0 THEN 'major' ELSE 'minor' END AS severity, 'high' AS confidence, 'agent' || (event_id % 5) AS culprit_agents,
  n AS evidence_index, CAST(event_id % 50 + n AS VARCHAR) AS idx, 'primary' AS role, 'said ' || event_id AS quote FROM events, (VALUES (0), (1)) AS a(f), (VALUES (0), (1)) AS b(n) WHERE event_type = 'error' AND event_id % 5 > 0"""


def q_confirmed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two confirmations a finding, of which the first counts; every fifth finding has none; corrections c0 and c1 were offered."""
    f = table(spark, sf_dir, "events").where("event_type = 'error'").select(_str("user_id").alias("trace_id"), F.concat(F.lit("F"), _str(_id())).alias("finding_id"), "event_id")
    verdict = F.get(F.array(*map(F.lit, ("confirmed", "rejected", "uncertain"))), (_id() % 3).cast("int"))
    first = f.where(_id() % 5 > 0).select("trace_id", "finding_id", F.lit(1).alias("n"), verdict.alias("verdict"), F.concat(F.lit("c"), _str(_id() % 4)).alias("corrected_idx"))
    second = first.withColumn("n", F.lit(2)).withColumn("verdict", F.lit("rejected")).withColumn("corrected_idx", F.lit("c0"))
    offered = f.select("trace_id", "finding_id", F.explode(F.array(F.lit("c0"), F.lit("c1"))).alias("idx"))
    return findings.confirmation_counts(findings.confirmed(f.drop("event_id"), second.unionByName(first), offered))


CONFIRMED_SQL = """SELECT CAST(user_id AS VARCHAR) AS trace_id, count(*) AS n_findings, count(*) FILTER (event_id % 5 > 0 AND event_id % 3 = 0) AS n_confirmed, count(*) FILTER (event_id % 5 > 0 AND event_id % 3 = 1) AS n_rejected,
  count(*) FILTER (event_id % 5 = 0 OR event_id % 3 = 2) AS n_uncertain, count(*) FILTER (event_id % 5 > 0 AND event_id % 4 < 2) AS n_relocated FROM events WHERE event_type = 'error' GROUP BY 1"""


def q_routed(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.when(k % 7 > 0, "bench").alias("dataset"), F.when(k % 4 == 0, F.format_number(k + 1000, 0)).when(k % 4 == 1, F.concat(F.lit(" '"), F.upper("c_name"), F.lit("'."))).when(k % 4 == 2, "other").alias("extracted"), F.when(k % 4 == 0, _str(k + 1000)).otherwise(F.col("c_name")).alias("gold"))
    return answers.routed(rows).select("c_custkey", "method", "verdict", "confidence")


ROUTED_SQL = """SELECT c_custkey, method, CASE WHEN method = 'direct_comp' THEN 'ideal' END AS verdict, CASE WHEN method = 'direct_comp' THEN 'high' END AS confidence
FROM (SELECT c_custkey, CASE WHEN c_custkey % 7 = 0 THEN NULL WHEN c_custkey % 4 = 3 THEN 'completion_judge' WHEN c_custkey % 4 < 2 THEN 'direct_comp' ELSE 'equivalence_judge' END AS method FROM customer)"""


def q_completion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Users whose ninth events are a completion judge's findings; the others have none."""
    e = table(spark, sf_dir, "events").select(_str("user_id").alias("trace_id"), F.when(_id() % 90 == 0, _id()).alias("finding_index"), F.when(_id() % 90 == 0, F.when(_id() % 4 == 0, "low").when(_id() % 4 == 2, "high")).alias("confidence"))
    return answers.completion_verdict(e)


COMPLETION_SQL = """SELECT CAST(user_id AS VARCHAR) AS trace_id, CASE WHEN n > 0 THEN 'poor' ELSE 'ideal' END AS verdict, CASE WHEN n = 0 THEN 'high' WHEN f % 4 = 0 THEN 'low' WHEN f % 4 = 2 THEN 'high' ELSE 'medium' END AS confidence
FROM (SELECT user_id, count(*) FILTER (event_id % 90 = 0) AS n, min(event_id) FILTER (event_id % 90 = 0) AS f FROM events GROUP BY 1)"""


def q_equivalence(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey")
    verdict, confidence = answers.equivalence_verdict(F.when(k % 4 == 0, True).when(k % 4 == 1, False), F.when(k % 7 > 1, (k % 121 - 10) / 100))
    return table(spark, sf_dir, "orders").select("o_orderkey", verdict.alias("verdict"), confidence.alias("confidence"))


EQUIVALENCE_SQL = """SELECT o_orderkey, CASE WHEN same THEN 'ideal' ELSE 'poor' END AS verdict, CASE WHEN s IS NULL OR sure >= 80 THEN 'high' WHEN sure >= 50 THEN 'medium' ELSE 'low' END AS confidence
FROM (SELECT *, CASE WHEN same THEN s ELSE 100 - s END AS sure FROM (SELECT o_orderkey, s, CASE o_orderkey % 4 WHEN 0 THEN true WHEN 1 THEN false ELSE coalesce(s >= 50, false) END AS same
  FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 7 > 1 THEN least(greatest(o_orderkey % 121 - 10, 0), 100) END AS s FROM orders)))"""


def q_last_answer(spark: SparkSession, sf_dir: str) -> DataFrame:
    said = F.when(F.col("event_type") == "click", F.concat(F.lit("so\nfinal answer: "), _str(_id()), F.lit("  \nbye"))).otherwise(F.concat(F.lit("step "), _str(_id())))
    return answers.last_marked_message(table(spark, sf_dir, "events").select(_str("user_id").alias("trace_id"), _id().alias("ord"), said.alias("content")))


def q_inferred(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("c_custkey")
    payload = F.to_json(F.struct(F.when(k % 2 == 0, F.lit("none")).when(k % 3 == 0, F.concat(F.lit(" "), "c_name")).alias("model_answer"), F.when(k % 5 > 0, F.col("c_mktsegment")).alias("answer"), F.when(k % 4 == 0, _str(k)).alias("gold_answer")))
    rows = table(spark, sf_dir, "customer").withColumn("payload", payload)
    return rows.select("c_custkey", answers.inferred(F.col("payload"), answers.PREDICTED_KEYS, F.lit("fallback")).alias("predicted"), answers.inferred(F.col("payload"), answers.REFERENCE_KEYS).alias("reference"))


INFERRED_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 2 = 1 AND c_custkey % 3 = 0 THEN c_name WHEN c_custkey % 5 > 0 THEN c_mktsegment ELSE 'fallback' END AS predicted, CASE WHEN c_custkey % 4 = 0 THEN CAST(c_custkey AS VARCHAR) END AS reference FROM customer"""


def q_backfill(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders")
    rows = o.select(_str("o_orderkey").alias("trace_id"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderstatus")).alias("verdict"))
    return answers.backfilled(rows, o.where("o_orderkey % 2 = 0").select(_str("o_orderkey").alias("trace_id"), F.lit("new").alias("verdict")))


def q_root_gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A user's errors as annotated failures; the root cause is one that may be missing."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    one = F.struct(_id().alias("failure_id"), (_id() % 50).alias("step_number"), F.concat(F.lit("agent"), _str(_id() % 4)).alias("failed_agent"), F.when(_id() % 3 > 0, F.concat(F.lit("kind"), _str(_id() % 3))).alias("failure_category"))
    rows = e.groupBy("user_id").agg(F.array_sort(F.collect_list(one)).alias("failures"), F.max(F.when(_id() % 2 == 0, _id())).alias("root_cause_failure_id"))
    out = accuracy.root_cause_gold(rows.select(F.col("user_id").alias("row_index"), _str("user_id").alias("trajectory_id"), "failures", "root_cause_failure_id"))
    return out.withColumns({c: F.array_join(c, ",") for c in ("mistake_agents", "mistake_steps", "failure_categories")})


ROOT_GOLD_SQL = """WITH e AS (SELECT *, event_id % 50 AS step, 'agent' || (event_id % 4) AS agent, CASE WHEN event_id % 3 > 0 THEN 'kind' || (event_id % 3) END AS kind FROM events WHERE event_type = 'error'),
firsts(user_id, what, v, pos) AS (SELECT user_id, 'a', agent, min(event_id) FROM e GROUP BY ALL UNION ALL SELECT user_id, 's', CAST(step AS VARCHAR), min(event_id) FROM e GROUP BY ALL UNION ALL SELECT user_id, 'k', kind, min(event_id) FROM e WHERE kind IS NOT NULL GROUP BY ALL),
lists AS (SELECT user_id, coalesce(string_agg(v, ',' ORDER BY pos) FILTER (what = 'a'), '') AS mistake_agents, coalesce(string_agg(v, ',' ORDER BY pos) FILTER (what = 's'), '') AS mistake_steps, coalesce(string_agg(v, ',' ORDER BY pos) FILTER (what = 'k'), '') AS failure_categories FROM firsts GROUP BY 1),
roots AS (SELECT user_id, count(*) AS num_failures, max(event_id) FILTER (event_id % 2 = 0) AS root FROM e GROUP BY 1)
SELECT user_id AS row_index, CAST(user_id AS VARCHAR) AS trajectory_id, mistake_agents, mistake_steps, failure_categories, num_failures, 'agent' || (root % 4) AS root_cause_agent, CAST(root % 50 AS VARCHAR) AS root_cause_step FROM lists JOIN roots USING (user_id)"""


def q_binarised(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "part")
    return p.select("p_partkey", accuracy.binarised((F.col("p_partkey") % 11) / 2, F.col("p_partkey") % 3).alias("gold"))


def q_lists(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Strings of all shapes as lists, without repeats: JSON with an apostrophe, Python lists with escaped quotes, None and True,
    tuples, sets, a list that is neither, objects and separators."""
    k, n = F.col("p_partkey"), F.col("p_name")
    shapes = [
        F.concat(F.lit('["O\'Neil", "'), n, F.lit('", "'), F.upper(n), F.lit('"]')), F.concat(F.lit("['"), n, F.lit("', 'b']")), F.concat(n, F.lit("; none ;B")), F.concat(n, F.lit(" | x, y")), F.lit("n/a"),
        F.concat(F.lit("['O\\'Neil', 'say \"hi\"', '"), n, F.lit("']")), F.concat(F.lit("['a', None, True, "), _str(k), F.lit("]")), F.concat(F.lit("['"), n, F.lit("', ('b', \"it's\"),]")), F.lit("{'one'}"), F.concat(F.lit("[a, "), n, F.lit("]")), F.lit('{"agent": "A, B"}'),
    ]
    written = F.element_at(F.array(*shapes), (k % len(shapes) + 1).cast("int"))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(text.distinct_ignoring_case(text.as_list(written)), "/").alias("items"))


LISTS_SQL = """SELECT p_partkey, CASE p_partkey % 11 WHEN 0 THEN 'O''Neil/' || p_name WHEN 1 THEN p_name || '/b' WHEN 2 THEN p_name || '/B' WHEN 3 THEN p_name || '/x, y' WHEN 4 THEN '' WHEN 5 THEN 'O''Neil/say "hi"/' || p_name
  WHEN 6 THEN 'a/True/' || p_partkey WHEN 7 THEN p_name || '/["b","it''s"]' WHEN 8 THEN 'one' WHEN 9 THEN '[a/' || p_name || ']' ELSE '{"agent": "A, B"}' END AS items FROM part"""


def q_raw_evidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations against the raw trace's numbered blocks alone: right, one off, of an unknown role, blaming another agent, of words
    that are nowhere, and under an id that is nowhere."""
    spans = views.event_spans(spark, sf_dir)
    raw = traces.rendered(spans)
    err, kind = spans.where("agent = 'error'"), _id() % 6
    key = [F.col("trace_id"), F.lit("tool_selection").alias("metric_name"), _id().alias("finding_index")]
    idx = F.when(kind == 1, _str(F.col("ord") + 1)).when(kind >= 4, F.lit("nowhere")).otherwise(F.col("idx"))
    cite = err.select(*key, F.lit(0).alias("evidence_index"), idx.alias("idx"), F.when(kind == 2, "bystander").otherwise("primary").alias("role"), F.when(kind == 4, "words that no span holds").otherwise(F.col("text")).alias("quote"))
    none = spark.createDataFrame([], "trace_id string, write_ord long, idx string, content string, agent string, idx_type string, is_default boolean")
    blamed = err.select(*key, F.lit("high").alias("confidence"), F.lit(False).alias("needs_human_review"), F.array(F.when(kind == 3, "Zed").otherwise("Error")).alias("culprit_agents"))
    out = verify.verifications(blamed, verify.resolved(cite, verify.idx_index(none, raw), raw))
    return out.select("trace_id", "finding_index", "evidence_status", "all_idxs_exist", "quotes_found_in_idxs", "culprit_agent_matches_evidence", "idx_roles_are_plausible", "usable_for_diagnosis")


RAW_EVIDENCE_SQL = f"""WITH {SPANS_SQL} SELECT trace_id, event_id AS finding_index, CASE event_id % 6 WHEN 4 THEN 'invalid' WHEN 2 THEN 'weak' WHEN 3 THEN 'weak' ELSE 'verified' END AS evidence_status, event_id % 6 <> 4 AS all_idxs_exist,
  event_id % 6 <> 4 AS quotes_found_in_idxs, event_id % 6 NOT IN (3, 4) AS culprit_agent_matches_evidence, event_id % 6 <> 2 AS idx_roles_are_plausible, event_id % 6 <> 4 AS usable_for_diagnosis FROM spans WHERE agent = 'error'"""


def q_raw_references(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of error events against raw traces without blocks: under an id that the text holds, under one that is nowhere,
    and with words that are nowhere under either."""
    spans = views.event_spans(spark, sf_dir)
    line = F.concat(F.lit('{"id": "Worker_'), _str(_id()), F.lit('", "said": "'), F.col("text"), F.lit('"}'))
    raw = spans.groupBy("trace_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", line.alias("line")))), lambda x: x["line"]), "\n").alias("trace"))
    err, kind = spans.where("agent = 'error'"), _id() % 4
    idx = F.when(kind % 2 == 0, F.concat(F.lit("Worker_"), _str(_id()))).otherwise("nowhere")
    cite = err.select("trace_id", F.lit("tool_selection").alias("metric_name"), _id().alias("finding_index"), F.lit(0).alias("evidence_index"), idx.alias("idx"), F.lit("primary").alias("role"), F.when(kind < 2, F.col("text")).otherwise("words that no span holds").alias("quote"))
    none = spark.createDataFrame([], "trace_id string, write_ord long, idx string, content string, agent string, idx_type string, is_default boolean")
    met = verify.resolved(cite, verify.idx_index(none, raw), raw)
    return met.select("trace_id", "finding_index", "resolved_idx", "strategy", F.md5("content").alias("content_md5"), F.when(~F.col("used_raw"), F.col("resolved_agent")).alias("resolved_agent"), "idx_exists", "quote_found", "used_raw")


RAW_REFERENCES_SQL = f"""WITH {SPANS_SQL}, raw AS (SELECT trace_id, string_agg('{{"id": "Worker_' || event_id || '", "said": "' || text || '"}}', chr(10) ORDER BY ord) AS trace FROM spans GROUP BY 1),
cited AS (SELECT s.trace_id, event_id, event_id % 4 AS k, text, trace, instr(trace, text) - 1 AS pos FROM spans s JOIN raw USING (trace_id) WHERE agent = 'error')
SELECT trace_id, event_id AS finding_index, CASE WHEN k % 2 = 0 THEN 'Worker_' || event_id ELSE 'nowhere' END AS resolved_idx, CASE k WHEN 1 THEN 'raw_quote_soft' WHEN 3 THEN 'unresolved' ELSE 'exact' END AS strategy,
  CASE WHEN k = 1 THEN md5(trace[greatest(pos - 1800, 0) + 1 : pos + length(text) + 1800]) END AS content_md5, CASE WHEN k % 2 = 0 THEN 'Worker' END AS resolved_agent, k <> 3 AS idx_exists, k < 2 AS quote_found, k = 1 AS used_raw FROM cited"""


def q_citeable(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a customer as agents' responses under ids that repeat, and failed ones as errors too: what can be cited."""
    o = table(spark, sf_dir, "orders").select(_str("o_custkey").alias("trace_id"), "o_orderkey", "o_orderpriority", "o_orderstatus")
    at = (F.row_number().over(Window.partitionBy("trace_id").orderBy("o_orderkey")) - 1).cast("long")
    rows = o.withColumn("ord", at)
    said = rows.select("trace_id", "ord", F.concat(F.lit("Clerk_"), _str(F.col("ord") % 3)).alias("response_id"), F.col("o_orderpriority").alias("content"), F.when(F.col("ord") % 2 == 0, F.lit('{"agent": " Boss "}')).alias("metadata"))
    failed = o.where("o_orderstatus = 'F'").select("trace_id", at.alias("ord"), F.lit("Clerk").alias("agent_name"), F.col("o_orderpriority").alias("error_message"))
    none = spark.createDataFrame([], "trace_id string, trace string")
    return verify.idx_index(verify.citeable_items(responses=said, errors=failed), none)


CITEABLE_SQL = """WITH r AS (SELECT CAST(o_custkey AS VARCHAR) AS trace_id, o_orderpriority AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1 AS i FROM orders)
SELECT trace_id, 'Clerk_' || (i % 3) AS idx, arg_max(p, i) AS content, CASE WHEN max(i) % 2 = 0 THEN 'Boss' ELSE 'Clerk' END AS agent, 'agent_response' AS idx_type FROM r GROUP BY 1, 2, i % 3
UNION ALL SELECT trace_id, CAST(i AS VARCHAR), p, CASE WHEN i % 2 = 0 THEN 'Boss' ELSE 'Clerk' END, 'agent_response_index' FROM r
UNION ALL SELECT CAST(o_custkey AS VARCHAR), 'agent_error_' || (row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) - 1), o_orderpriority, 'Clerk', 'agent_error' FROM orders WHERE o_orderstatus = 'F'"""


def q_final_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers as payloads of five data sets, each with its answer in its own place, some without one."""
    k, n = F.col("c_custkey"), F.col("c_name")
    words = F.concat(F.lit("well\nFINAL ANSWER: "), n, F.lit(" \nFINAL ANSWER: late"))
    talk = F.array(F.struct(words.alias("content")), F.struct(F.when(k % 2 == 0, F.lit("FINAL ANSWER:  \nbye")).otherwise("final answer: no").alias("content")))
    end = F.struct(F.struct(F.when(k % 2 == 0, F.lit("search_agent")).otherwise("other").alias("smolagents.managed_agents.0.name"), n.alias("output.value")).alias("span_attributes"))
    gaia = F.concat(F.lit('{"spans": [{"child_spans": [{}, {"child_spans": [{}, '), F.to_json(end), F.lit("]}]}]}"))
    swe = F.concat(F.lit('{"spans": [{"logs": ['), F.to_json(F.struct(F.struct(F.when(k % 2 == 0, n).alias("function.output")).alias("body"))), F.lit("]}]}"))
    ghost = F.to_json(F.struct(F.struct(F.when(k % 2 == 0, n).alias("response")).alias("output")))
    aegis = F.to_json(F.struct(F.struct(F.when(k % 2 == 0, n).alias("final_output"), talk.alias("conversation_history")).alias("input")))
    sets = ("trail_gaia", "trail_swe", "ghost", "who_and_when", "aegis")
    dataset = F.element_at(F.array(*map(F.lit, sets)), (k % 5 + 1).cast("int"))
    payload = F.element_at(F.array(gaia, swe, ghost, F.to_json(F.struct(talk.alias("history"))), aegis), (k % 5 + 1).cast("int"))
    return table(spark, sf_dir, "customer").select("c_custkey", answers.final_answer(payload, dataset).alias("answer"))


FINAL_ANSWERS_SQL = """SELECT c_custkey, CASE WHEN c_custkey % 5 = 3 THEN CASE WHEN c_custkey % 2 = 1 THEN c_name END WHEN c_custkey % 2 = 0 THEN c_name WHEN c_custkey % 5 = 4 THEN 'final answer: no' END AS answer FROM customer"""

QUERIES = {
    "observation_usage": q_obs_usage, "observation_agents": q_obs_agents, "observation_errors": q_obs_errors, "observation_states": q_obs_states, "observation_tools": q_obs_tools, "tools_of_agents": q_tools_of_agents,
    "task_pool": q_task_pool, "agent_order": q_agent_order, "dialogue_states": q_dialogue, "evaluation_records": q_records, "tree_spans": q_tree, "observation_spans": q_observation_spans, "unknown_format_spans": q_turns,
    "judge_prompts": q_prompts, "judge_answers": q_judge_answers, "confirmations": q_confirmed, "answer_routing": q_routed, "completion_verdicts": q_completion, "equivalence_verdicts": q_equivalence,
    "last_marked_answer": q_last_answer, "inferred_answers": q_inferred, "backfilled_verdicts": q_backfill, "root_cause_gold": q_root_gold, "binarised_gold": q_binarised, "listed_values": q_lists, "raw_trace_evidence": q_raw_evidence,
    "citeable_index": q_citeable, "raw_references": q_raw_references, "final_answers": q_final_answers,
}
ORACLE_SQL = {
    "observation_usage": f"""WITH {OBS_SQL}, last AS (SELECT trace_id, agent, max(event_id) AS run FROM obs WHERE event_type = 'click' GROUP BY ALL)
SELECT l.trace_id, l.agent, CAST(coalesce(sum(o.event_id % 100), 0) AS BIGINT) AS input_tokens, CAST(coalesce(sum(o.event_id % 7), 0) AS BIGINT) AS output_tokens, CAST(any_value(l.run) % 9 AS DOUBLE) AS latency
FROM last l LEFT JOIN obs o ON o.trace_id = l.trace_id AND o.click = l.run AND o.event_type = 'view' GROUP BY l.trace_id, l.agent""",
    "observation_agents": f"WITH {OBS_SQL} SELECT trace_id, min(ord) AS ord, agent, 'be ' || agent AS instructions FROM obs WHERE event_type = 'click' GROUP BY trace_id, agent",
    "observation_errors": f"WITH {OBS_SQL} SELECT trace_id, ord, agent, 'failed ' || event_id AS error_message FROM obs WHERE event_type = 'click' AND event_id % 6 = 0",
    "observation_states": f"""WITH {OBS_SQL} SELECT trace_id, ord, 'o' || event_id AS state_id, CASE event_type WHEN 'error' THEN 'tool_call' WHEN 'signup' THEN 'action' ELSE 'assistant.text' END AS type,
  CASE event_type WHEN 'error' THEN 'Tool call: tool' || (event_id % 3) WHEN 'signup' THEN 'Chain execution: chat' ELSE 'LLM generation using ' || CASE WHEN event_id % 5 > 0 THEN 'm' || (event_id % 3) ELSE 'unknown model' END END AS content, epoch_us(ts) AS at_us
  FROM obs WHERE event_type <> 'click'""",
    "observation_tools": "SELECT DISTINCT CAST(user_id AS VARCHAR) AS trace_id, 'tool' || (event_id % 3) AS name FROM events WHERE event_type = 'error'",
    "tools_of_agents": """WITH c AS (SELECT user_id, event_id % 4 AS a, string_agg(DISTINCT 'tool' || (event_id % 3), ',' ORDER BY 'tool' || (event_id % 3)) AS called FROM events WHERE event_type = 'error' GROUP BY ALL),
g AS (SELECT user_id, event_id % 4 AS a, 't' || (min(event_id) % 5) || ',x' AS available FROM events WHERE event_type = 'view' GROUP BY ALL)
SELECT CAST(user_id AS VARCHAR) AS trace_id, 'agent' || a AS agent, called, available FROM c FULL JOIN g USING (user_id, a)""",
    "task_pool": "SELECT CAST(n_regionkey AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1 AS ord, n_name AS agent, 'speak for ' || n_name AS instructions, 'graph TD' AS graph FROM nation",
    "agent_order": AGENT_ORDER_SQL,
    "dialogue_states": """SELECT trace_id, 'helper' AS agent, msg, role, 'helper_' || CAST(before + 1 AS BIGINT) AS state_id, content_md5 FROM (SELECT CAST(conv_id AS VARCHAR) AS trace_id, role, row_number() OVER w - 1 AS msg, md5(text) AS content_md5,
  coalesce(sum(CASE WHEN turn % 3 = 1 AND role = 'assistant' THEN 2 ELSE 1 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn))""",
    "evaluation_records": RECORDS_SQL,
    "tree_spans": TREE_SQL,
    "observation_spans": OBSERVATION_SPANS_SQL,
    "unknown_format_spans": "SELECT CAST(conv_id AS VARCHAR) AS trace_id, ord, CAST(ord AS VARCHAR) AS idx, CASE WHEN turn % 2 = 0 THEN 'Bot ' || role ELSE role END AS agent, md5(text) AS content FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS ord FROM conversations)",
    "judge_prompts": PROMPTS_SQL,
    "judge_answers": JUDGE_ANSWERS_SQL,
    "confirmations": CONFIRMED_SQL,
    "answer_routing": ROUTED_SQL,
    "completion_verdicts": COMPLETION_SQL,
    "equivalence_verdicts": EQUIVALENCE_SQL,
    "last_marked_answer": "SELECT CAST(user_id AS VARCHAR) AS trace_id, CAST(max(event_id) AS VARCHAR) AS extracted FROM events WHERE event_type = 'click' GROUP BY 1",
    "inferred_answers": INFERRED_SQL,
    "backfilled_verdicts": "SELECT CAST(o_orderkey AS VARCHAR) AS trace_id, CASE WHEN o_orderkey % 3 = 0 THEN o_orderstatus WHEN o_orderkey % 2 = 0 THEN 'new' END AS verdict FROM orders",
    "root_cause_gold": ROOT_GOLD_SQL,
    "binarised_gold": "SELECT p_partkey, CASE WHEN p_partkey % 11 >= 8 OR p_partkey % 3 = 0 THEN 1 END AS gold FROM part",
    "listed_values": LISTS_SQL,
    "raw_trace_evidence": RAW_EVIDENCE_SQL,
    "citeable_index": CITEABLE_SQL,
    "raw_references": RAW_REFERENCES_SQL,
    "final_answers": FINAL_ANSWERS_SQL,
}
