"""The report: judge findings gated by their verification, optionally with weighted validator findings, ranked and rolled up.

Gates and weights are dimensions of one plan: a report's key is the trace together with the verifier mode and the weight,
so an ablation over modes or weights is a single job. Scores are whole numbers (severity 3/2/1 x evidence 10/7/0 x
confidence 100/75/50 x weight in thousandths), so sums do not depend on their order.

Inputs: judge(trace_id, metric_ord, metric_name, finding_index, severity, confidence, culprit_agents, evidence_idxs,
needs_human_review) and verifications(trace_id, metric_name, finding_index, v_ord, evidence_status, checks), checks being
array<struct<evidence_index, idx, resolved_idx, idx_exists, quote_found>>.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import idx_order, present, stripped
from ..sources.storage import stored

MODES = ("none", "strict", "soft")
#: Metrics that are no longer read, weights, and the failure type that each judge metric stands for.
DEPRECATED = ("mas_task_completion", "MAS_TASK_COMPLETION")
SEVERITY = {"critical": 3, "major": 2, "minor": 1}
EVIDENCE = {"verified": 10, "deterministic": 10, "weak": 7, "invalid": 0}
CONFIDENCE = {"high": 100, "medium": 75, "low": 50}
FAILURE_OF_METRIC = {
    "observation_alignment": "observation_alignment_error",
    "policy_alignment": "policy_alignment_error",
    "state_consistency": "state_inconsistency",
    "tool_selection": "wrong_tool_selection",
    "tool_parameter_extraction": "tool_parameter_error",
    "task_completeness": "task_incomplete",
    "mas_planning": "planning_failure",
    "mas_complexity": "system_complexity_failure",
    "mas_task_transfer": "false_handoff",
    "mas_roles_distribution": "role_distribution_failure",
    "tool_performance": "tool_execution_failure",
    "prompt_quality": "prompt_quality_issue",
}
KEY = ["trace_id", "mode", "weight"]


def looked_up(x: Column, values: dict, default) -> Column:
    table = F.create_map(*[F.lit(v) for pair in values.items() for v in pair])
    return F.coalesce(table[x], default if isinstance(default, Column) else F.lit(default))


def usable(mode: Column, status: Column) -> Column:
    """Whether a finding counts under a verifier mode; status is null where there is no verification."""
    admitted = F.when(mode == "strict", status == "verified").otherwise(status.isin("verified", "weak"))
    return F.when(mode == "none", True).otherwise(F.coalesce(admitted, F.lit(False)))


def summarised(judge: DataFrame, verifications: DataFrame, modes: Sequence[str] = ("soft",)) -> DataFrame:
    """Judge findings with status, idxs, score and usable, once for each mode. Of several verifications the last counts."""
    last = verifications.groupBy("trace_id", "metric_name", "finding_index").agg(F.max_by(F.struct("evidence_status", "checks"), "v_ord").alias("x"))
    rows = judge.where(~F.col("metric_name").isin(*DEPRECATED)).join(last, ["trace_id", "metric_name", "finding_index"], "left")
    found = F.col("x").isNotNull()
    status = F.lower(F.coalesce(present(F.col("x.evidence_status")), F.lit("unverified")))
    checks = F.coalesce(F.col("x.checks"), F.array().cast("array<struct<evidence_index:int,idx:string,resolved_idx:string,idx_exists:boolean,quote_found:boolean>>"))
    grounded = F.filter(checks, lambda c: F.coalesce(c["quote_found"] | c["idx_exists"], F.lit(False)))
    cited = F.when(F.size(checks) > 0, F.transform(grounded, lambda c: F.coalesce(present(c["resolved_idx"]), c["idx"]))).otherwise(F.col("evidence_idxs"))
    agents = F.filter(F.transform("culprit_agents", stripped), lambda a: a != "")
    out = rows.select(
        "trace_id", F.struct(F.lit(0).alias("source"), "metric_ord", "finding_index").alias("seq"), "metric_name", "finding_index",
        F.lower(F.coalesce(present(F.col("severity")), F.lit("major"))).alias("severity"), F.lower(F.coalesce(present(F.col("confidence")), F.lit("medium"))).alias("confidence"),
        status.alias("evidence_status"), F.when(found, status).alias("_gate"), F.array_distinct(F.coalesce(agents, F.array().cast("array<string>"))).alias("agents"),
        F.array_distinct(F.array_compact(F.coalesce(cited, F.array().cast("array<string>")))).alias("idxs"),
        F.size(F.array_distinct(F.transform(F.filter(checks, lambda c: c["quote_found"]), lambda c: c["evidence_index"]))).alias("grounded_evidence"),
        F.coalesce("needs_human_review", F.lit(False)).alias("needs_human_review"), F.explode(F.array(*map(F.lit, modes))).alias("mode"),
    )
    score = looked_up(F.col("severity"), SEVERITY, 2) * looked_up(F.col("evidence_status"), EVIDENCE, 7) * looked_up(F.col("confidence"), CONFIDENCE, 75)
    return out.withColumn("usable", usable(F.col("mode"), F.col("_gate"))).withColumn("score", score.cast("long") * 1000).drop("_gate")


def weighted_issues(findings: DataFrame, weights: Sequence[float], modes: Sequence[str] = ("soft",)) -> DataFrame:
    """Validator findings (of findings.deduplicated) as issues for each weight above 0: score x weight x occurrences."""
    rows = findings.select(
        "trace_id", F.struct(F.lit(1).alias("source"), F.col("v").alias("metric_ord"), F.lit(0).cast("long").alias("finding_index")).alias("seq"), "metric_name", F.lit(0).cast("long").alias("finding_index"), "severity",
        F.lit("high").alias("confidence"), F.lit("deterministic").alias("evidence_status"), F.array_compact(F.array(present(F.col("agent")))).alias("agents"),
        F.array_distinct(F.transform("evidence", lambda e: e["idx"])).alias("idxs"), F.size("evidence").alias("grounded_evidence"), F.lit(False).alias("needs_human_review"), "occurrences",
    )
    dims = F.array(*[F.struct(F.lit(m).alias("mode"), F.lit(round(w * 1000)).alias("weight")) for m in modes for w in weights if w > 0])
    if not any(w > 0 for w in weights):
        dims = F.array().cast("array<struct<mode:string,weight:int>>")
    out = rows.withColumn("d", F.explode(dims)).select("*", "d.mode", "d.weight").drop("d")
    score = looked_up(F.col("severity"), SEVERITY, 2) * 10 * 100 * F.col("weight") * F.greatest("occurrences", F.lit(1))
    return out.withColumn("usable", F.lit(True)).withColumn("score", score.cast("long")).drop("occurrences")


def issues(judge: DataFrame, verifications: DataFrame, modes: Sequence[str] = ("soft",), findings: DataFrame | None = None, weights: Sequence[float] = (0.0,)) -> DataFrame:
    """All issues and review targets, keyed by trace, mode and weight (in thousandths)."""
    base = summarised(judge, verifications, modes).withColumn("weight", F.explode(F.array(*[F.lit(round(w * 1000)) for w in weights])))
    if findings is None:
        return base
    return base.unionByName(weighted_issues(findings, weights, modes))


def ranked_agents(rows: DataFrame) -> DataFrame:
    """KEY, agent, findings_count, score, rank: by count, score, name without case, then first mention."""
    each = rows.where("usable").select(*KEY, "seq", "score", F.posexplode("agents").alias("pos", "agent"))
    sums = each.groupBy(*KEY, "agent").agg(F.count(F.lit(1)).alias("findings_count"), F.sum("score").alias("score"), F.min(F.struct("seq", "pos")).alias("first"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("findings_count"), F.desc("score"), F.lower("agent"), "first")
    return sums.withColumn("rank", F.row_number().over(order)).drop("first")


def ranked_idxs(rows: DataFrame) -> DataFrame:
    """KEY, idx, findings_count, score, rank: by count, score, then idx order."""
    each = rows.where("usable").select(*KEY, "score", F.explode("idxs").alias("idx"))
    sums = each.groupBy(*KEY, "idx").agg(F.count(F.lit(1)).alias("findings_count"), F.sum("score").alias("score"))
    order = Window.partitionBy(*KEY).orderBy(F.desc("findings_count"), F.desc("score"), idx_order(F.col("idx")))
    return sums.withColumn("rank", F.row_number().over(order))


def reports(rows: DataFrame) -> DataFrame:
    """One diagnostic status a key: verdict, severity counts, review targets and those of them whose evidence is invalid, ranked lists, primary type and culprit, first idx both ways."""
    rows = stored(rows, "issues")
    bad = lambda s: F.count_if(F.col("usable") & (F.col("severity") == s)).alias(f"{s}_issues")
    counts = rows.groupBy(*KEY).agg(
        F.count_if("usable").alias("issues"), F.count_if(~F.col("usable")).alias("review_targets"), F.count_if(~F.col("usable") & (F.col("evidence_status") == "invalid")).alias("invalid_findings"), bad("critical"), bad("major"), bad("minor"),
        F.coalesce(F.max(F.when(F.col("usable"), F.col("needs_human_review"))), F.lit(False)).alias("_asked"),
    )
    metric = rows.where("usable").groupBy(*KEY, "metric_name").agg(F.sum("score").alias("s")).groupBy(*KEY).agg(F.max_by("metric_name", F.struct("s", "metric_name")).alias("primary_metric"))
    agents = ranked_agents(rows).groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "agent", "findings_count"))), lambda x: F.struct(x["agent"].alias("agent"), x["findings_count"].alias("findings_count"))).alias("problematic_agents")
    )
    idxs = ranked_idxs(rows).groupBy(*KEY).agg(
        F.transform(F.array_sort(F.collect_list(F.struct("rank", "idx", "findings_count"))), lambda x: F.struct(x["idx"].alias("idx"), x["findings_count"].alias("findings_count"))).alias("problematic_idxs"),
        F.min_by("idx", idx_order(F.col("idx"))).alias("first_problem_idx"), F.min_by("idx", "rank").alias("top_ranked_idx"),
    )
    out = counts.join(metric, KEY, "left").join(agents, KEY, "left").join(idxs, KEY, "left")
    verdict = F.when(F.col("issues") > 0, "issues_found").when(F.col("review_targets") > 0, "needs_review").otherwise("clean")
    return out.select(
        *KEY, verdict.alias("verdict"), "issues", "review_targets", "invalid_findings", "critical_issues", "major_issues", "minor_issues",
        F.coalesce(F.size("problematic_agents"), F.lit(0)).alias("n_agents"), F.coalesce(F.size("problematic_idxs"), F.lit(0)).alias("n_idxs"),
        looked_up(F.col("primary_metric"), FAILURE_OF_METRIC, F.col("primary_metric")).alias("primary_failure_type"),
        F.get("problematic_agents", F.lit(0))["agent"].alias("primary_culprit_agent"), "first_problem_idx", "top_ranked_idx", "problematic_agents", "problematic_idxs", "_asked",
    ).replace(-1, 0, ["n_agents", "n_idxs"])


def with_review_status(report: DataFrame, answer_verdict: str = "answer_verdict") -> DataFrame:
    """review_required and review_reason; answer_verdict may be null."""
    answer = F.coalesce(F.col(answer_verdict) == "needs_review", F.lit(False)) if answer_verdict in report.columns else F.lit(False)
    reason = (
        F.when(answer, "The answer needs a manual check.")
        .when(F.col("_asked"), "A usable finding asks for human review.")
        .when((F.col("issues") == 0) & (F.col("review_targets") > 0), "All findings are ungrounded or unverified.")
    )
    return report.withColumn("review_reason", reason).withColumn("review_required", F.col("review_reason").isNotNull()).drop("_asked")
