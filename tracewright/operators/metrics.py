"""Plain trace metrics: tool efficiency, time and tokens."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def tool_efficiency(calls: DataFrame) -> DataFrame:
    """calls(trace_id, is_invalid): valid / (valid + 2 * invalid), as an invalid call counts as made and as failed; 0 without
    calls. Kept unrounded."""
    bad = F.count_if("is_invalid")
    n = calls.groupBy("trace_id").agg((F.count(F.lit(1)) - bad).alias("valid_calls"), bad.alias("invalid_calls"))
    value = F.try_divide(F.col("valid_calls").cast("double"), (F.col("valid_calls") + 2 * F.col("invalid_calls")).cast("double"))
    return n.withColumn("efficiency", F.coalesce(value, F.lit(0.0)))


def totals(usage: DataFrame) -> DataFrame:
    """usage(trace_id, latency, input_tokens, output_tokens): sums a trace; nulls count as nothing."""
    add = lambda c: F.coalesce(F.sum(c), F.lit(0)).alias(c)
    return usage.groupBy("trace_id").agg(add("latency"), add("input_tokens"), add("output_tokens"))


def per_agent(usage: DataFrame) -> DataFrame:
    """usage(trace_id, ord, agent, latency, input_tokens, output_tokens): the last entry of each agent counts."""
    last = F.max_by(F.struct("latency", "input_tokens", "output_tokens"), "ord").alias("x")
    return usage.groupBy("trace_id", "agent").agg(last).select("trace_id", "agent", "x.*")


def score_histogram(scores: DataFrame) -> DataFrame:
    """scores(metric_name, score): how often each metric was ideal, fair or poor, but for keys that are no judge's metric."""
    #: Payload keys beside the judges' metrics.
    other = ("tool_efficiency", "mas_time", "mas_tokens", "agent_time", "agent_tokens", "summary", "trace_id", "errors")
    count = lambda v: F.count_if(F.col("score") == v).alias(v)
    return scores.where(~F.col("metric_name").isin(*other)).groupBy("metric_name").agg(count("ideal"), count("fair"), count("poor"))
