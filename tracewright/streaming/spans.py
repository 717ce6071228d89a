"""The rule scan over a stream of spans: an extension, since scans need no state. Repeats are dropped within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..operators.scan import scan


def scanned(spans: DataFrame, event_time: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Findings of a stream of spans. With an event time, a finding of the same trace, metric, type and quote is emitted once
    within the delay."""
    if event_time is None:
        return scan(spans)
    timed = spans.withWatermark(event_time, delay)
    return scan(timed, keep=(event_time,)).dropDuplicatesWithinWatermark(["trace_id", "metric_name", "failure_type", "quote"])
