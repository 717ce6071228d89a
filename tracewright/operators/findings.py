"""From raw findings to a validator's result: grouping, tree collapse, roll-up and confirmations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import quote_key
from ..sources.storage import stored, stored_count
from .scan import explanation

MAX_EVIDENCE = 5
SHARED = 30
CONFIRM_WINDOW, CONFIRM_TEXT = 4, 3500


def shuffled(df: DataFrame) -> DataFrame:
    """df as a side of a join that is shuffled at any size: a side that looks small goes whole through the driver."""
    return df.hint("merge")


def deduplicated(raw: DataFrame) -> DataFrame:
    """One row for each (trace, metric, failure type, agent, quote key): occurrences, the first evidence rows by scan order.

    Null agents group together. Only MAX_EVIDENCE rows of a group reach the collecting aggregate: the window's limit is
    applied before the shuffle too. Counts and evidence meet in an aggregate of tagged rows, not in a join, which Spark would
    send through the driver as a broadcast.
    """
    seq = F.struct("v", "c", "ord", "r")
    # Findings are few next to the spans they come from, and both aggregates below read them: scan once.
    keyed = stored(raw, "findings").withColumn("quote_key", quote_key(F.col("quote"))).withColumn("seq", seq)
    group = ["trace_id", "metric_name", "failure_type", "agent", "quote_key"]
    counts = keyed.groupBy(*group).agg(F.count(F.lit(1)).alias("occurrences"), F.min("seq").alias("seq"), F.first("severity").alias("severity"), F.min("v").alias("v"))
    first = Window.partitionBy(*group).orderBy("seq")
    few = keyed.withColumn("_n", F.row_number().over(first)).where(F.col("_n") <= MAX_EVIDENCE)
    item = F.struct(F.col("_n").alias("n"), F.col("idx").alias("idx"), F.col("agent").alias("agent"), F.col("quote").alias("quote"), F.col("kind").alias("kind"))
    tagged = counts.unionByName(few.select(*group, item.alias("item")), allowMissingColumns=True)
    out = tagged.groupBy(*group).agg(*[F.max(c).alias(c) for c in ("occurrences", "seq", "severity", "v")], F.array_sort(F.collect_list("item")).alias("evidence"))
    return out.withColumn("primary_idx", F.col("evidence")[0]["idx"]).withColumn("primary_kind", F.col("evidence")[0]["kind"]).withColumn("explanation", explanation(F.col("failure_type")))


def ancestors(spans: DataFrame) -> DataFrame:
    """(trace_id, idx, ancestors) from parent pointers, by pointer doubling: the joins grow with the log of the depth.

    A span without a parent, or whose parent is not in the trace, ends the chain; a cycle's spans are listed once each, so
    every list is bounded by the trace and the rounds end when none grows.
    """
    up = spans.select("trace_id", "idx", F.array_compact(F.array("parent")).alias("ancestors")).dropDuplicates(["trace_id", "idx"])
    while True:
        known = up.select("trace_id", F.col("idx").alias("_last"), F.col("ancestors").alias("_more"))
        probe = up.withColumn("_last", F.try_element_at("ancestors", F.lit(-1)))
        longer = probe.join(known, ["trace_id", "_last"], "left").withColumn("_all", F.array_distinct(F.concat("ancestors", F.coalesce("_more", F.array().cast("array<string>")))))
        up = stored(longer.select("trace_id", "idx", F.col("_all").alias("ancestors"), (F.size("_all") > F.size("ancestors")).alias("_grew")), "ancestors")
        if up.where("_grew").isEmpty():
            break
        up = up.drop("_grew")
    return up.select("trace_id", "idx", "ancestors")


def shares_run(a: Column, b: Column, n: int = SHARED) -> Column:
    """Whether the shorter of two texts has a run of n characters in the longer; if shorter than n, whether it is in it."""
    short, long = F.when(F.length(a) <= F.length(b), a).otherwise(b), F.when(F.length(a) <= F.length(b), b).otherwise(a)
    runs = F.sequence(F.lit(1), F.greatest(F.length(short) - (n - 1), F.lit(1)))
    found = F.when(F.length(short) < n, F.contains(long, short)).otherwise(F.exists(runs, lambda i: F.contains(long, short.substr(i, F.lit(n)))))
    return F.when((F.length(a) > 0) & (F.length(b) > 0), found).otherwise(False)


def above(pairs: DataFrame, spans: DataFrame) -> DataFrame:
    """Those of pairs(trace_id, low, high), distinct, whose span `high` is a proper ancestor of span `low`.

    No list of ancestors is made. Tables of the 1st, 2nd, 4th, … ancestor of each span, of traces that have pairs, come from
    joining each table to itself; a pair climbs from `low` by the bits of the difference in depth, and must arrive at `high`.
    Work follows spans and pairs times the log of the depth. A parent that is not in the trace ends a chain. Spans on or
    below a cycle have no depth: their pairs alone are looked up in ancestors().
    """
    pairs, n_pairs = stored_count(pairs.select("trace_id", "low", "high").distinct(), "pairs")
    if not n_pairs:
        return pairs
    nodes = spans.select("trace_id", "idx", "parent").join(shuffled(pairs.select("trace_id").distinct()), "trace_id", "left_semi").dropDuplicates(["trace_id", "idx"])
    nodes = stored(nodes, "nodes")
    most = nodes.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    real = nodes.select("trace_id", F.col("idx").alias("parent"), F.lit(1).alias("steps"))
    # top: the span so many steps up.
    up = nodes.join(shuffled(real), ["trace_id", "parent"], "left").select("trace_id", "idx", F.when(F.col("steps") == 1, F.col("parent")).otherwise(F.col("idx")).alias("top"), F.coalesce("steps", F.lit(0)).cast("long").alias("steps"))
    levels = [stored(up, "climb")]
    while (1 << (len(levels) - 1)) <= most:
        last = levels[-1]
        more = last.select("trace_id", F.col("idx").alias("top"), F.col("top").alias("_top"), F.col("steps").alias("_steps"))
        step = last.join(shuffled(more), ["trace_id", "top"]).select("trace_id", "idx", F.col("_top").alias("top"), (F.col("steps") + F.col("_steps")).alias("steps"), (F.col("_steps") > 0).alias("grew"))
        step = stored(step, "climb")
        levels.append(step.drop("grew"))
        if step.where("grew").isEmpty():
            break
    depth = levels[-1].select("trace_id", "idx", "steps")
    low, high = depth.toDF("trace_id", "low", "_low"), depth.toDF("trace_id", "high", "_high")
    sized = pairs.join(shuffled(low), ["trace_id", "low"]).join(shuffled(high), ["trace_id", "high"])
    # More steps than a trace has spans: a cycle.
    endless = F.col("_low") > most
    climb = sized.where(~endless & (F.col("_low") > F.col("_high"))).select("trace_id", "low", "high", (F.col("_low") - F.col("_high")).alias("_d"), F.col("low").alias("_at"))
    for k, level in enumerate(levels):
        jump = level.where(F.col("steps") == 1 << k).select("trace_id", F.col("idx").alias("_at"), F.col("top").alias("_to"))
        moved = F.when(F.col("_d").bitwiseAND(F.lit(1 << k)) != 0, F.col("_to")).otherwise(F.col("_at"))
        climb = climb.join(shuffled(jump), ["trace_id", "_at"], "left").select("trace_id", "low", "high", "_d", moved.alias("_at"))
    found = climb.where("_at = high").select("trace_id", "low", "high")
    if most and sized.where(endless).isEmpty():
        return found
    rest = sized.where(endless).select("trace_id", "low", "high")
    lists = ancestors(nodes.join(rest.select("trace_id").distinct(), "trace_id", "left_semi")).withColumnRenamed("idx", "low")
    return found.unionByName(rest.join(lists, ["trace_id", "low"]).where(F.array_contains("ancestors", F.col("high"))).select("trace_id", "low", "high"))


def sharing_quotes(outer: DataFrame, inner: DataFrame, on: list[str], n: int = SHARED) -> DataFrame:
    """(on, high, quote_key, low) of outer(on, high, quote_key) and inner(on, low, tool_quote) whose quotes share a run of n
    characters, or, if one is shorter, of which one holds the other; empty ones share nothing.

    Long quotes meet in an index of their hashed windows of n characters and are then compared; only pairs with a short
    quote are compared by their common columns alone.
    """
    windows = lambda q: F.array_distinct(F.transform(F.sequence(F.lit(1), F.length(q) - (n - 1)), lambda i: F.xxhash64(F.substring(q, i, n))))
    long_o, long_i = outer.where(F.length("quote_key") >= n), inner.where(F.length("tool_quote") >= n)
    met = long_o.withColumn("_w", F.explode(windows(F.col("quote_key")))).join(shuffled(long_i.withColumn("_w", F.explode(windows(F.col("tool_quote"))))), [*on, "_w"]).drop("_w").distinct()
    short = outer.join(shuffled(inner), on).where(F.least(F.length("quote_key"), F.length("tool_quote")) < n)
    out = met.unionByName(short.select(*met.columns)).where(shares_run(F.col("quote_key"), F.col("tool_quote"), n))
    return out.select(*on, "high", "quote_key", "low").distinct()


def collapsed(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """Findings less those of provider and tool rules on a span above a TOOL span with the same metric, failure type and a
    shared stretch of the quote. spans(trace_id, idx, parent): see above()."""
    scope, on = F.col("v") < 2, ["trace_id", "metric_name", "failure_type"]
    findings = stored(findings, "grouped")
    is_tool = F.coalesce(F.col("primary_kind") == "TOOL", F.lit(False))
    inner = findings.where(scope & is_tool).select(*on, F.col("primary_idx").alias("low"), F.col("quote_key").alias("tool_quote")).distinct()
    outer = findings.where(scope & ~is_tool).select(*on, F.col("primary_idx").alias("high"), "quote_key").distinct()
    shared = stored(sharing_quotes(outer, inner, on), "shared")
    gone = shared.join(shuffled(above(shared, spans)), ["trace_id", "low", "high"], "left_semi").select(*on, F.col("high").alias("primary_idx"), "quote_key", F.lit(False).alias("_tool"), F.lit(True).alias("_scope")).distinct()
    marked = findings.withColumn("_tool", is_tool).withColumn("_scope", scope)
    return marked.join(shuffled(gone), [*on, "primary_idx", "quote_key", "_tool", "_scope"], "left_anti").select(*findings.columns)


def validator_result(findings: DataFrame, spans: DataFrame) -> DataFrame:
    """One row a trace: agent_attribution_available, n_findings and metrics, an array of (metric_name, findings) in order of
    their first finding. Traces without findings are kept."""
    item = F.struct("seq", F.lit("fail").alias("verdict"), "severity", F.col("agent").alias("culprit_agent"), "failure_type", "explanation", "occurrences", "evidence")
    by_metric = findings.groupBy("trace_id", "metric_name").agg(F.array_sort(F.collect_list(item)).alias("findings"))
    metric = F.struct(F.col("findings")[0]["seq"].alias("seq"), "metric_name", "findings")
    per_trace = by_metric.groupBy("trace_id").agg(F.array_sort(F.collect_list(metric)).alias("metrics"), F.sum(F.size("findings")).alias("n_findings"))
    flags = spans.groupBy("trace_id").agg(F.max(F.coalesce(F.col("agent") != "", F.lit(False))).alias("agent_attribution_available"))
    return flags.join(per_trace, "trace_id", "left").withColumn("n_findings", F.coalesce("n_findings", F.lit(0).cast("long")))


def numbered_for_review(findings: DataFrame) -> DataFrame:
    """findings with finding_id F0, F1, … in each trace: metrics by their first finding, then findings in order."""
    metric = Window.partitionBy("trace_id", "metric_name")
    order = Window.partitionBy("trace_id").orderBy("_metric", "seq")
    out = findings.withColumn("_metric", F.min("seq").over(metric))
    return out.withColumn("finding_id", F.concat(F.lit("F"), (F.row_number().over(order) - 1).cast("string"))).drop("_metric")


def candidate_windows(findings: DataFrame, spans: DataFrame, radius: int = CONFIRM_WINDOW) -> DataFrame:
    """(trace_id, finding_id, idx, ord, agent, text) of the spans within `radius` of each finding's first span; where the trace
    has no such span, that idx alone, with null in the other columns.

    A band join on equal (trace_id, ord): each finding names its 2 * radius + 1 places.
    """
    place = spans.select("trace_id", F.col("idx").alias("primary_idx"), F.col("ord").alias("_at"))
    at = findings.select("trace_id", "finding_id", "primary_idx").join(place, ["trace_id", "primary_idx"], "left")
    near = at.where("_at IS NOT NULL").select("trace_id", "finding_id", F.explode(F.sequence(F.col("_at") - radius, F.col("_at") + radius)).alias("ord"))
    shown = spans.select("trace_id", "ord", "idx", "agent", F.left(F.coalesce("text", F.lit("")), F.lit(CONFIRM_TEXT)).alias("text"))
    alone = at.where("_at IS NULL AND primary_idx IS NOT NULL").select("trace_id", "finding_id", F.col("primary_idx").alias("idx"))
    return near.join(shown, ["trace_id", "ord"]).unionByName(alone, allowMissingColumns=True)


def review_input(findings: DataFrame, spans: DataFrame, whole: DataFrame | None = None, radius: int = CONFIRM_WINDOW) -> DataFrame:
    """One row a trace with findings, what a confirming model is shown: (trace_id, findings, spans).

    findings: structs in order of their number, with current_idx (the first cited span) and candidate_idxs (its window in span
    order; the cited id alone where the trace has no such span). spans: each span that a finding cites or may be moved to,
    once, in span order, with its whole text (of whole(trace_id, idx, text), such as traces.raw_texts(); its own text where that
    has none) and, beside it, the text that rules see. Of spans that share an id the last counts. Texts are in the last
    shuffle only, once a span; a row holds one trace's referenced spans.
    """
    windows = stored(candidate_windows(findings, spans, radius).select("trace_id", "finding_id", "idx", "ord"), "windows")
    last = F.array_sort(F.collect_list(F.struct(F.coalesce("ord", F.lit(-1)).alias("ord"), "idx")))
    offered = windows.groupBy("trace_id", "finding_id").agg(F.transform(last, lambda x: x["idx"]).alias("candidate_idxs"))
    first = F.get("evidence", F.lit(0))
    asked = findings.select("trace_id", "finding_id", "metric_name", "failure_type", "explanation", first["quote"].alias("quote"), F.col("primary_idx").alias("current_idx"))
    asked = asked.join(offered, ["trace_id", "finding_id"], "left").withColumn("candidate_idxs", F.coalesce("candidate_idxs", F.array().cast("array<string>")))
    item = F.struct(F.substring("finding_id", 2, 20).cast("long").alias("n"), "finding_id", "metric_name", "failure_type", "explanation", "quote", "current_idx", "candidate_idxs")
    listed = asked.groupBy("trace_id").agg(F.transform(F.array_sort(F.collect_list(item)), lambda x: x.dropFields("n")).alias("findings"))
    seen = windows.where("ord IS NOT NULL").select("trace_id", "idx").distinct()
    cut = lambda c: F.left(F.coalesce(c, F.lit("")), F.lit(CONFIRM_TEXT))
    shown = spans.join(seen, ["trace_id", "idx"], "left_semi").select("trace_id", "idx", "ord", F.col("agent").alias("role"), "kind", cut(F.col("text")).alias("stripped"))
    if whole is None:
        shown = shown.withColumn("text", F.col("stripped"))
    else:
        raw = whole.join(seen, ["trace_id", "idx"], "left_semi").groupBy("trace_id", "idx").agg(F.max(cut(F.col("text"))).alias("text"))
        shown = shown.join(raw, ["trace_id", "idx"], "left").withColumn("text", F.coalesce("text", "stripped"))
    one = shown.groupBy("trace_id", "idx").agg(F.max_by(F.struct("ord", "idx", "role", "kind", "text", "stripped"), "ord").alias("x"))
    texts = one.groupBy("trace_id").agg(F.array_sort(F.collect_list("x")).alias("spans"))
    none = F.array().cast(texts.schema["spans"].dataType)
    return listed.join(texts, "trace_id", "left").withColumn("spans", F.coalesce("spans", none))


def confirmed(findings: DataFrame, confirmations: DataFrame, windows: DataFrame) -> DataFrame:
    """findings with llm_verdict and corrected_idx. confirmations(trace_id, finding_id, n, verdict, corrected_idx): the first
    by n counts; a missing one means `uncertain`; a corrected idx counts only if it was offered in the finding's window."""
    first = confirmations.groupBy("trace_id", "finding_id").agg(F.min_by(F.struct("verdict", "corrected_idx"), "n").alias("x"))
    offered = windows.select("trace_id", "finding_id", F.col("idx").alias("corrected_idx"), F.lit(True).alias("_offered")).distinct()
    said = first.select("trace_id", "finding_id", "x.verdict", "x.corrected_idx").join(offered, ["trace_id", "finding_id", "corrected_idx"], "left")
    out = findings.join(said, ["trace_id", "finding_id"], "left")
    return out.withColumn("llm_verdict", F.coalesce("verdict", F.lit("uncertain"))).withColumn("corrected_idx", F.when(F.col("_offered"), F.col("corrected_idx"))).drop("verdict", "_offered")


def confirmation_counts(reviewed: DataFrame) -> DataFrame:
    """Per trace: findings by verdict and relocated ones."""
    count = lambda v: F.count_if(F.col("llm_verdict") == v).alias(f"n_{v}")
    return reviewed.groupBy("trace_id").agg(F.count(F.lit(1)).alias("n_findings"), count("confirmed"), count("rejected"), count("uncertain"), F.count("corrected_idx").alias("n_relocated"))
