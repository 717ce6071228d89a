"""Observation traces: agents, states, tool calls, tokens and the agents' order."""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import stripped

RUN = " run"


def mapped_role(role: Column) -> Column:
    """A message role of the trace store as one of system, user, assistant and tool; user by default."""
    r = F.lower(F.coalesce(role, F.lit("")))
    return F.when(r.isin("system", "developer"), "system").when(r.isin("assistant", "ai", "model"), "assistant").when(r.isin("tool", "function"), "tool").otherwise("user")


def agent_runs(observations: DataFrame) -> DataFrame:
    """Spans named `<agent> run`, as (trace_id, ord, obs_id, agent); an agent's last run counts where one is wanted."""
    name = F.col("name")
    return observations.where(name.endswith(RUN) & (name != RUN)).select("trace_id", "ord", F.col("id").alias("obs_id"), F.regexp_replace(name, " run$", "").alias("agent"), "latency", "status_message")


def pool_agents(traces: DataFrame) -> DataFrame:
    """traces(trace_id, pool array<struct<name, instructions>>) exploded, in pool order."""
    return traces.select("trace_id", F.posexplode("pool").alias("ord", "p")).select("trace_id", "ord", F.col("p.name").alias("agent"), F.col("p.instructions").alias("instructions"))


def messages(runs: DataFrame) -> DataFrame:
    """runs(trace_id, agent_ord, agent, obs_ord, messages array<struct<role, parts array<struct<type, content, id, name, arguments,
    result>>>>) as one row for each part, agents first, then observations, messages and parts in order."""
    each = runs.select("trace_id", "agent_ord", "agent", "obs_ord", F.posexplode("messages").alias("msg", "m"))
    parts = each.select("trace_id", "agent_ord", "agent", "obs_ord", "msg", mapped_role(F.col("m.role")).alias("role"), F.posexplode("m.parts").alias("part", "p"))
    return parts.select("trace_id", "agent_ord", "agent", "obs_ord", "msg", "part", "role", "p.type", "p.content", "p.id", "p.name", "p.arguments", "p.result")


def dialogue(parts: DataFrame) -> DataFrame:
    """What is said: the first part of system messages, and user and assistant parts that are no tool calls or their responses."""
    role, tool = F.col("role"), F.coalesce(F.col("type").isin("tool_call", "tool_call_response"), F.lit(False))
    return parts.where(F.col("content").isNotNull() & (((role == "system") & (F.col("part") == 0)) | (role.isin("user", "assistant") & ~tool)))


def _numbered(parts: DataFrame, name: str) -> DataFrame:
    order = Window.partitionBy("trace_id", "agent").orderBy("agent_ord", "obs_ord", "msg", "part")
    return parts.withColumn(name, F.concat("agent", F.lit("_"), F.row_number().over(order).cast("string")))


def responses(parts: DataFrame) -> DataFrame:
    """An assistant's text parts with response_id `<agent>_<n>`, n counting an agent's responses from 1."""
    return _numbered(parts.where("role = 'assistant' AND type = 'text' AND content IS NOT NULL"), "response_id")


def states(parts: DataFrame) -> DataFrame:
    """The parts that change an agent's state, with state_type, content and state_id `<agent>_<n>`, n counting them from 1: texts of
    user and assistant, tool calls (content: their arguments) and responses to them (their results), the first part of a
    system message. Texts without content are none."""
    role, type_ = F.col("role"), F.col("type")
    said = F.col("content").isNotNull()
    kind = (
        F.when((role == "system") & (F.col("part") == 0) & said, "system.text").when(role.isin("user", "assistant") & (type_ == "text") & said, F.concat(role, F.lit(".text")))
        .when((role == "assistant") & (type_ == "tool_call"), "assistant.tool_call").when((role == "user") & (type_ == "tool_call_response"), "user.tool_call_response")
    )
    content = F.when(kind == "assistant.tool_call", F.col("arguments")).when(kind == "user.tool_call_response", F.col("result")).otherwise(F.col("content"))
    return _numbered(parts.withColumn("state_type", kind).where("state_type IS NOT NULL").withColumn("content", content), "state_id")


def resolved_calls(calls: DataFrame, tool_runs: DataFrame) -> DataFrame:
    """calls(trace_id, agent, name, call_id, …) ⟕ the first `running tool: <name>` span of the same call id; a status
    message on the span marks the call as invalid."""
    runs = tool_runs.where(F.col("name").startswith("running tool: ")).withColumn("name", F.substring("name", 15, 1 << 20))
    first = runs.groupBy("trace_id", "name", "call_id").agg(F.min_by(F.struct("output", "status_message"), "ord").alias("x"))
    out = calls.join(first, ["trace_id", "name", "call_id"], "left")
    return out.select(*calls.columns, F.col("x").isNotNull().alias("found"), F.col("x.output").alias("result"), F.col("x.status_message").alias("status_message"), (F.coalesce("x.status_message", F.lit("")) != "").alias("is_invalid"))


def tools_of_agents(calls: DataFrame, generations: DataFrame) -> DataFrame:
    """(trace_id, agent, called, available): calls by the agent, and the tools of its first generation."""
    called = calls.groupBy("trace_id", "agent").agg(F.array_sort(F.collect_set("name")).alias("called"))
    offered = generations.groupBy("trace_id", "agent").agg(F.min_by("tools", "ord").alias("available"))
    return called.join(offered, ["trace_id", "agent"], "full")


def usage_of_agents(runs: DataFrame, observations: DataFrame, all_runs: bool = False) -> DataFrame:
    """(trace_id, agent, input_tokens, output_tokens, latency in seconds): sums over the run's children, but for tool runners.
    The last run of an agent counts, or all of them."""
    chosen = runs
    if not all_runs:
        last = runs.groupBy("trace_id", "agent").agg(F.max_by(F.struct("obs_id", "latency"), "ord").alias("x"))
        chosen = last.select("trace_id", "agent", "x.obs_id", "x.latency")
    kids = observations.where(~F.coalesce(F.col("name") == "running 1 tool", F.lit(False))).select("trace_id", F.col("parent_observation_id").alias("obs_id"), "input_tokens", "output_tokens")
    per_run = chosen.join(kids.groupBy("trace_id", "obs_id").agg(F.sum("input_tokens").alias("i"), F.sum("output_tokens").alias("o")), ["trace_id", "obs_id"], "left")
    return per_run.groupBy("trace_id", "agent").agg(F.coalesce(F.sum("i"), F.lit(0)).alias("input_tokens"), F.coalesce(F.sum("o"), F.lit(0)).alias("output_tokens"), (F.sum("latency") / 1000).alias("latency"))


def run_errors(runs: DataFrame) -> DataFrame:
    """Agents' error messages of traces whose pool is empty."""
    return runs.where(F.coalesce("status_message", F.lit("")) != "").select("trace_id", "ord", "agent", F.col("status_message").alias("error_message"))


#: How a Mermaid text names a node, and an edge between two named nodes.
NODE, EDGE = r"(\w+)\[([^\]]+)\]", r"(\w+)\[([^\]]+)\]\s*-->\s*(\w+)\[([^\]]+)\]"


def agent_order(graphs: DataFrame) -> DataFrame:
    """(trace_id, agent, rank) of graphs(trace_id, graph), Mermaid texts: the names in brackets, sources first, then whoever has
    no predecessor left, in the order in which the last of them was placed. Agents without an edge follow the sources among
    the edges; what lies on or behind a cycle follows at the end, in order of appearance. A node id that is named twice has its
    last name; null texts and texts without named nodes give no rows.

    A graph is one row's text, so each is ordered within its row.
    """

    def order(text: str) -> list[str]:
        named = re.findall(NODE, text)
        name = dict(named)
        after: dict[str, list[str]] = {}
        waits: dict[str, int] = {}
        for a, _, b, _ in re.findall(EDGE, text):
            after.setdefault(name[a], []).append(name[b])
            waits[name[b]] = waits.get(name[b], 0) + 1
            waits.setdefault(name[a], 0)
        waits = waits | {n: 0 for n in name.values() if n not in waits}
        placed = [n for n, k in waits.items() if k == 0]
        for n in placed:  # the list grows as agents lose their last predecessor
            for m in after.get(n, ()):
                waits[m] -= 1
                if waits[m] == 0:
                    placed.append(m)
        left = waits.keys() - set(placed)
        return placed + [n for n in dict.fromkeys(n for _, n in named) if n in left]

    def run(batches):
        for b in batches:
            rows = [(t, n, i) for t, g in zip(b["trace_id"], b["graph"], strict=True) for i, n in enumerate(order(g))]
            yield pd.DataFrame(rows, columns=["trace_id", "agent", "rank"])

    return graphs.where("graph IS NOT NULL").select("trace_id", "graph").mapInPandas(run, "trace_id string, agent string, rank int")


def timestamp_of(x: Column) -> Column:
    """An ISO-8601 time, Z included; null where it is none."""
    return F.try_to_timestamp(stripped(x))
