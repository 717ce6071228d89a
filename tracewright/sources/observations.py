"""Observation traces of a trace store to the tables that operators.observations works on.

A payload is one trace: `observations` with snake-case or camel-case names. Message lists live in attributes of run spans as
JSON text, or in doubly encoded input and output of the trace itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import present, stripped
from ..operators.observations import RUN, agent_runs, dialogue, mapped_role, messages, pool_agents, resolved_calls, responses, run_errors, states, usage_of_agents
from .storage import stored
from .traces import field, items

#: Attributes with an agent's messages, its instructions and its tools; the run that draws graphs.
MESSAGES, INSTRUCTIONS, TOOLS = "pydantic_ai.all_messages", "gen_ai.system_instructions", "model_request_parameters"
GRAPH_RUN = "GraphGenerator run"
CALL_ID, CALL_RESULT = "gen_ai.tool.call.id", "tool_response"
PART = "struct<type:string,content:string,id:string,name:string,arguments:string,result:string>"
MESSAGE = f"array<struct<role:string,parts:array<{PART}>>>"


def observations_of(traces: DataFrame, parent_id: Column | None = None) -> DataFrame:
    """One row an observation, in document order; with parent_id only that parent's children (one task of many)."""
    rows = traces.select("trace_id", F.posexplode(items(field(F.col("payload"), "observations"))).alias("ord", "o"))
    o = F.col("o")
    either = lambda *names: F.coalesce(*[present(field(o, n)) for n in names])
    usage = either("usage_details", "usageDetails")
    out = rows.select(
        "trace_id", "ord", either("id").alias("id"), F.upper(either("type")).alias("type"), either("name").alias("name"), either("parent_observation_id", "parentObservationId").alias("parent_observation_id"),
        either("start_time", "startTime").alias("start_time"), either("latency").try_cast("double").alias("latency"), either("status_message", "statusMessage").alias("status_message"), either("model").alias("model"),
        field(usage, "input").try_cast("long").alias("input_tokens"), field(usage, "output").try_cast("long").alias("output_tokens"), either("input").alias("input"), either("output").alias("output"),
        F.from_json(field(either("metadata"), "attributes"), "map<string,string>").alias("attributes"),
    )
    return out if parent_id is None else out.where(F.col("parent_observation_id") == parent_id)


def task_agents(observations: DataFrame) -> DataFrame:
    """(trace_id, ord, agent, instructions, graph) of the pools of `*_task_*` spans."""
    task = observations.where((F.col("type") == "SPAN") & F.contains("name", F.lit("_task_")) & F.col("output").isNotNull())
    pools = task.select("trace_id", F.from_json(field(F.col("output"), "pool"), "array<struct<name:string,instructions:string>>").alias("pool"), F.coalesce(field(F.col("output"), "graph"), field(F.col("output"), "mermaid_graph")).alias("graph"))
    named = pool_agents(pools.where("pool IS NOT NULL")).withColumn("agent", stripped(F.col("agent"))).where("agent <> ''")
    graphs = pools.groupBy("trace_id").agg(F.max("graph").alias("graph"))
    return named.join(graphs, "trace_id", "left")


def run_agents(observations: DataFrame) -> DataFrame:
    """(trace_id, ord, agent, instructions) where agents are the runs themselves: the first of each name, the graph's drawer
    left out, instructions from its system-instruction attribute."""
    runs = observations.where(F.col("name").endswith(RUN) & (F.col("name") != GRAPH_RUN) & (F.col("name") != RUN))
    said = F.get(F.from_json(F.col("attributes")[INSTRUCTIONS], "array<struct<content:string>>"), F.lit(0))["content"]
    each = runs.select("trace_id", "ord", F.replace("name", F.lit(RUN), F.lit("")).alias("agent"), F.coalesce(said, F.lit("")).alias("instructions"))
    return each.groupBy("trace_id", "agent").agg(F.min("ord").alias("ord"), F.min_by("instructions", "ord").alias("instructions")).select("trace_id", "ord", "agent", "instructions")


def agent_messages(observations: DataFrame, agents: DataFrame) -> DataFrame:
    """operators.observations.messages of the agents' runs: agent-major, then in document order."""
    runs = agent_runs(observations).join(agents.select("trace_id", "agent", F.col("ord").alias("agent_ord")), ["trace_id", "agent"])
    body = observations.select("trace_id", F.col("id").alias("obs_id"), F.from_json(F.col("attributes")[MESSAGES], MESSAGE).alias("messages"))
    joined = runs.join(body, ["trace_id", "obs_id"]).where("messages IS NOT NULL")
    return messages(joined.select("trace_id", "agent_ord", "agent", F.col("ord").alias("obs_ord"), "messages"))


def generation_tools(observations: DataFrame) -> DataFrame:
    """(trace_id, agent, ord, tools): the tools that each run's generations were offered."""
    runs = agent_runs(observations).select("trace_id", "agent", F.col("obs_id").alias("parent_observation_id"))
    offered = F.from_json(field(F.col("attributes")[TOOLS], "function_tools"), "array<struct<name:string>>")
    return observations.where("type = 'GENERATION'").join(runs, ["trace_id", "parent_observation_id"]).select("trace_id", "agent", "ord", F.transform(offered, lambda t: t["name"]).alias("tools"))


def task_ids(observations: DataFrame) -> DataFrame:
    """(trace_id, ord, task_id, span id) of a trace with several tasks, one `single_task` span each."""
    one = observations.where("type = 'SPAN' AND name = 'single_task'")
    return one.select("trace_id", "ord", F.get_json_object("input", "$.args[0].task_id").alias("task_id"), "id")


def decoded(text: Column) -> Column:
    """JSON that may have been encoded twice."""
    inner = F.get(F.from_json(F.concat(F.lit("["), text, F.lit("]")), "array<string>"), F.lit(0))
    return F.when(text.startswith('"') & text.endswith('"'), inner).otherwise(text)


def chain_dialogue(traces: DataFrame) -> DataFrame:
    """(trace_id, side, ord, role, content) of a graph-of-chains trace: messages of its input, then of its output without tool
    messages; text that is no message list is one message."""
    out = None
    for side, (name, key, default) in enumerate((("input", "role", "user"), ("output", "type", "ai"))):
        body = decoded(field(F.col("payload"), name))
        listed = items(field(F.when(body.startswith("{"), body), "messages"))
        rows = traces.select("trace_id", F.lit(side).alias("side"), F.posexplode(F.when(listed.isNotNull(), listed).when(body.isNotNull() & ~body.startswith("{"), F.array(F.to_json(F.struct(F.lit(default).alias(key), body.alias("content")))))).alias("ord", "m"))
        part = rows.select("trace_id", "side", "ord", mapped_role(F.coalesce(field(F.col("m"), key), F.lit(default))).alias("role"), F.coalesce(field(F.col("m"), "content"), F.lit("")).alias("content"))
        part = part.where((F.col("side") == 0) | (F.col("role") != "tool"))
        out = part if out is None else out.unionByName(part)
    return out


def chain_states(observations: DataFrame) -> DataFrame:
    """(trace_id, ord, state_id, type, content, at) of generations, tools and chains."""
    kind = F.when(F.col("type") == "GENERATION", "assistant.text").when(F.col("type") == "TOOL", "tool_call").when(F.col("type") == "CHAIN", "action")
    name = F.coalesce("name", F.lit(""))
    said = F.when(F.col("type") == "GENERATION", F.concat(F.lit("LLM generation using "), F.coalesce("model", F.lit("unknown model")))).when(F.col("type") == "TOOL", F.concat(F.lit("Tool call: "), name)).otherwise(F.concat(F.lit("Chain execution: "), name))
    return observations.withColumn("_k", kind).where("_k IS NOT NULL").select("trace_id", "ord", F.col("id").alias("state_id"), F.col("_k").alias("type"), said.alias("content"), F.try_to_timestamp("start_time").alias("at"))


def chain_tools(observations: DataFrame) -> DataFrame:
    """(trace_id, name): the distinct tools of a trace."""
    return observations.where("type = 'TOOL' AND name <> ''").select("trace_id", "name").distinct()


CALL = "struct<id:string,name:string,parameters:string,result:string,status_message:string>"


def evaluation_inputs(traces: DataFrame) -> DataFrame:
    """traces(trace_id, payload) as one nested record each: (trace_id, user_query, environment, metadata, dialogue_history,
    agent_responses, agent_states, agents_tools_info, agents_usage, agents_pool, agents_errors).

    Agents are those of the task's pool. A trace without any has the errors of its runs and nothing else; others have no
    errors. Lists are in order of agents, observations, messages and parts, and empty where there is nothing. A tool call
    whose runner left a status message is invalid; one without a runner has a null tool_call. All tables meet as tagged
    rows in one shuffle by trace; a record holds one trace.
    """
    obs = stored(observations_of(traces), "observations")
    agents = stored(task_agents(obs), "agents")
    parts = stored(agent_messages(obs, agents), "parts")
    last = agents.groupBy("trace_id", "agent").agg(F.min("ord").alias("agent_ord"))
    runs = agent_runs(obs.where("type = 'SPAN'")).join(last, ["trace_id", "agent"])
    run = runs.groupBy("trace_id", "agent", "agent_ord").agg(F.max_by("obs_id", "ord").alias("parent_observation_id"))
    offered = F.from_json(field(F.col("attributes")[TOOLS], "function_tools"), "array<struct<name:string>>")
    first = obs.where("type = 'GENERATION'").join(run, ["trace_id", "parent_observation_id"]).groupBy("trace_id", "agent").agg(F.min_by(offered, "ord").alias("tools"))
    tools = run.join(first, ["trace_id", "agent"], "left").select("trace_id", "agent", "agent_ord", F.coalesce(F.transform("tools", lambda t: t["name"]), F.array().cast("array<string>")).alias("available"))
    usage = usage_of_agents(runs.drop("agent_ord"), obs).join(last, ["trace_id", "agent"]).withColumn("latency", F.round("latency", 2))

    keys = ["trace_id", "agent_ord", "obs_ord", "msg", "part"]
    state = states(parts).withColumnRenamed("id", "call_id")
    runners = obs.where("type = 'SPAN'").select("trace_id", "ord", "name", F.col("attributes")[CALL_ID].alias("call_id"), F.col("attributes")[CALL_RESULT].alias("output"), "status_message")
    calls = resolved_calls(state.where("state_type = 'assistant.tool_call'").select(*keys, "agent", "name", "call_id", "arguments"), runners)
    met = F.col("found")
    call = F.when(met, F.struct(F.col("call_id").alias("id"), "name", F.col("arguments").alias("parameters"), "result", "status_message"))
    called = calls.select(*keys, call.cast(CALL).alias("call"), F.col("status_message").isNotNull().alias("invalid"))
    state = state.join(called, keys, "left").withColumn("state_type", F.when(F.coalesce("invalid", F.lit(False)), "assistant.invalid_tool_call").otherwise(F.col("state_type")))

    columns = {"agent_ord": "long", "obs_ord": "long", "msg": "long", "part": "long", "agent": "string", "id": "string", "type": "string", "content": "string", "call": CALL, "listed": "array<string>", "input_tokens": "long", "output_tokens": "long", "latency": "double"}

    def tagged(kind: int, rows: DataFrame, **given: str) -> DataFrame:
        value = lambda c: given.get(c, c if c in rows.columns else None)
        fields = [(F.col(value(c)) if value(c) else F.lit(None)).cast(t).alias(c) for c, t in columns.items()]
        return rows.select("trace_id", F.struct(F.lit(kind).alias("kind"), *fields).alias("x"))

    tables = [
        tagged(0, dialogue(parts), type="role", id="agent"), tagged(1, responses(parts), id="response_id"), tagged(2, state, id="state_id", type="state_type"), tagged(3, tools, listed="available"),
        tagged(4, usage), tagged(5, agents, agent_ord="ord", content="instructions"), tagged(6, run_errors(agent_runs(obs.where("type = 'SPAN'"))), obs_ord="ord", content="error_message"),
    ]
    rows = tables[0]
    for more in tables[1:]:
        rows = rows.unionByName(more)
    # Calls do not order; what does stands before them, and is unique within a kind.
    folded = rows.groupBy("trace_id").agg(F.array_sort(F.collect_list("x")).alias("x"))
    none = F.array().cast(folded.schema["x"].dataType)
    of = lambda kind: F.filter(F.coalesce("x", none), lambda r: r["kind"] == kind)
    pick = lambda kind, **names: F.transform(of(kind), lambda r: F.struct(*[r[c].alias(n) for n, c in names.items()]))
    is_call = lambda r, agent: (r["agent"] == agent) & r["type"].isin("assistant.tool_call", "assistant.invalid_tool_call")
    tool_info = F.transform(of(3), lambda t: F.struct(t["agent"].alias("agent_name"), F.transform(F.filter(of(2), lambda s: is_call(s, t["agent"])), lambda s: s["call"]).alias("tools_called"), t["listed"].alias("available_tools")))
    errors = pick(6, agent_name="agent", error_message="content")
    p = F.col("payload")
    either = lambda *names: F.coalesce(*[present(field(p, n)) for n in names])
    top = F.struct(either("projectId", "project_id").alias("project_id"), either("latency").alias("latency"), either("createdAt", "created_at").alias("created_at"))
    return traces.join(folded, "trace_id", "left").select(
        "trace_id", F.when(F.size(of(5)) > 0, field(field(p, "output"), "question")).alias("user_query"), either("environment").alias("environment"), top.alias("metadata"), pick(0, role="type", content="content").alias("dialogue_history"),
        pick(1, response_id="id", content="content").alias("agent_responses"), pick(2, state_id="id", type="type", content="content", tool_call="call").alias("agent_states"), tool_info.alias("agents_tools_info"),
        pick(4, agent_name="agent", input_tokens="input_tokens", output_tokens="output_tokens", latency="latency").alias("agents_usage"), pick(5, agent_name="agent", instructions="content").alias("agents_pool"),
        F.when(F.size(of(5)) > 0, F.slice(errors, 1, 0)).otherwise(errors).alias("agents_errors"),
    )


def record_tables(records: DataFrame) -> dict[str, DataFrame]:
    """The tables that operators.verify.citeable_items takes, of evaluation_inputs()."""
    none = F.lit(None).cast("string")
    rows = lambda c: records.select("trace_id", F.posexplode(c).alias("ord", "x"))
    call = F.to_json("x.tool_call")
    listed = F.transform("x.tools_called", lambda t: F.struct(t["id"].alias("id"), F.to_json(t).alias("body")))
    return {
        "messages": rows("dialogue_history").select("trace_id", "ord", "x.role", "x.content"),
        "responses": rows("agent_responses").select("trace_id", "ord", "x.response_id", "x.content", none.alias("metadata")),
        "states": rows("agent_states").select("trace_id", "ord", "x.state_id", "x.type", "x.content", none.alias("metadata"), F.col("x.tool_call.id").alias("call_id"), call.alias("call")),
        "tools": rows("agents_tools_info").select("trace_id", "ord", "x.agent_name", F.to_json("x").alias("body"), listed.alias("calls")),
        "errors": rows("agents_errors").select("trace_id", "ord", "x.agent_name", "x.error_message"),
        "pool": rows("agents_pool").select("trace_id", "ord", "x.agent_name", "x.instructions"),
    }
