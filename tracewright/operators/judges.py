"""The boundary to an external model: what each judge metric sees, and how its answers come back as rows.

The engine calls no model. `judged` applies a function of the caller's to prepared prompts, a batch at a time; a failure of
one prompt is a row with an error, not a failed task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import decoded_runs

#: The columns of a normalised trace that each judge metric projects.
STATES = ("user_query", "agent_states")
PROJECTIONS = {
    "MAS_TASK_COMPLETION": STATES,
    "mas_task_transfer": STATES,
    "mas_complexity": STATES,
    "mas_roles_distribution": STATES,
    "mas_planning": STATES,
    "observation_alignment": ("user_query", "dialogue_history", "agent_responses"),
    "policy_alignment": STATES,
    "state_consistency": ("user_query", "agent_states", "dialogue_history"),
    "tool_selection": (*STATES, "agents_tools_info"),
    "tool_parameter_extraction": (*STATES, "agents_tools_info"),
    "task_completeness": STATES,
    "tool_performance": (*STATES, "agents_tools_info"),
    "prompt_quality": ("agents",),
}
#: Judges that are asked by name only; the summarizer sees other metrics' results and never the raw trace.
OTHER_JUDGES = {"summarizer": ("metrics_results",), "single_judge": (*STATES, "agents_tools_info"), "planner_checker": ("agents", "graph")}
FINDING = "array<struct<severity_estimate:string,confidence_estimate:string,culprit_agent_candidates:array<struct<agent:string>>,evidence:array<struct<idx:string,role:string,claim:string,quote:string>>,problem_description:string,suggested_fix:string,needs_human_review:boolean>>"


def prompts(traces: DataFrame, metrics: list[str] | None = None) -> DataFrame:
    """(trace_id, metric_ord, metric_name, input): the JSON that each metric's judge is shown; the raw `trace` where a row has
    no user query. Columns that traces lack are left out. metrics: names of PROJECTIONS (all of them, if not given) or
    OTHER_JUDGES."""
    out = None
    for i, name in enumerate(metrics or PROJECTIONS):
        cols = [c for c in (PROJECTIONS | OTHER_JUDGES)[name] if c in traces.columns]
        shown = F.to_json(F.struct(*cols)) if cols else F.lit(None).cast("string")
        if name == "summarizer":
            shown = decoded_runs(shown)
        elif "trace" in traces.columns:
            shown = F.when(F.col("user_query").isNotNull(), shown).otherwise(F.col("trace")) if "user_query" in traces.columns else F.col("trace")
        part = traces.select("trace_id", F.lit(i).alias("metric_ord"), F.lit(name).alias("metric_name"), shown.alias("input"))
        out = part if out is None else out.unionByName(part)
    return out


def judged(asked: DataFrame, call: Callable[[str, str], str], retries: int = 3) -> DataFrame:
    """(trace_id, metric_ord, metric_name, output, error): call(metric_name, input) for each prompt, tried `retries` times."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            outputs, errors = [], []
            for name, shown in zip(b["metric_name"], b["input"], strict=True):
                output = error = None
                for _ in range(retries):
                    try:
                        output, error = call(name, shown), None
                        break
                    except Exception as e:  # noqa: BLE001 - one prompt's failure is a row
                        error = f"{type(e).__name__}: {e}"
                outputs.append(output)
                errors.append(error)
            yield b[["trace_id", "metric_ord", "metric_name"]].assign(output=outputs, error=errors)

    return asked.mapInPandas(run, "trace_id string, metric_ord int, metric_name string, output string, error string")


def unfenced(text: Column) -> Column:
    """A model's JSON without the Markdown fence around it."""
    return F.regexp_replace(F.regexp_replace(F.trim(text), r"(?s)^```[A-Za-z]*\s*", ""), r"(?s)\s*```\s*$", "")


def findings_of(answers: DataFrame) -> DataFrame:
    """Judge findings, in report.issues' columns, of answers(trace_id, metric_ord, metric_name, output); answers that are no
    JSON object with findings give none."""
    each = answers.select("trace_id", "metric_ord", "metric_name", F.posexplode(F.from_json(unfenced(F.col("output")), f"findings {FINDING}")["findings"]).alias("finding_index", "f"))
    return each.select(
        "trace_id", "metric_ord", "metric_name", F.col("finding_index").cast("long").alias("finding_index"), F.col("f.severity_estimate").alias("severity"), F.col("f.confidence_estimate").alias("confidence"),
        F.transform("f.culprit_agent_candidates", lambda a: a["agent"]).alias("culprit_agents"), F.transform("f.evidence", lambda e: e["idx"]).alias("evidence_idxs"), F.col("f.needs_human_review").alias("needs_human_review"),
        F.col("f.evidence").alias("evidence"), F.col("f.problem_description").alias("problem_description"), F.col("f.suggested_fix").alias("suggested_fix"),
    )


def citations(findings: DataFrame) -> DataFrame:
    """One row a citation, as verify.resolved wants them."""
    return findings.select("trace_id", "metric_name", "finding_index", F.posexplode("evidence").alias("evidence_index", "e")).select("trace_id", "metric_name", "finding_index", "evidence_index", "e.idx", "e.role", "e.quote")
