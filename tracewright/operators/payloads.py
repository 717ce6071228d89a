"""Stored result payloads, one JSON object a task: reading, scoring, reporting and backfilling them.

A payload holds metric results by name, evidence verifications by metric, rule findings, answers and maybe a report. It is
parsed once, to VARIANT, and its parts become the tables of report.py; whether a stored report is used or one is rebuilt is a
branch of each row in one plan. All functions take rows(file, payload).

Defined cases: a payload that is no JSON object has no findings and no answers; parts of another kind than expected are left
out; a finding's number is its place in its metric's list; of several verifications with one number the last counts.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import as_list, clean_scalar, distinct_ignoring_case, last_number, present
from ..sources.annotations import ID_COLUMNS
from ..sources.storage import stored
from . import answers, report

#: Keys of a payload that hold no metric's result.
RESERVED = (
    "evidence_verification", "report", "status", "diagnostic_report", "gt", "label_answer", "predicted_answer", "reference_answer",
    "answer_status", "final_answer_verification",
)
#: Where the report's vocabulary of one payload differs, the first that is there counts.
FIRST_IDX = {"min_index": "first_problem_idx", "top_ranked": "top_ranked_idx"}


def _get(v: Column | str, path: str, kind: str = "string") -> Column:
    return F.try_variant_get(F.col(v) if isinstance(v, str) else v, path, kind)


def _items(v: Column | str, path: str) -> Column:
    """The array at a path, as variants; empty where there is none."""
    return F.coalesce(_get(v, path, "array<variant>"), F.array().cast("array<variant>"))


def _members(v: Column | str, path: str = "$") -> Column:
    """The object at a path, as a map of variants; null where there is none."""
    return _get(v, path, "map<string,variant>")


def opened(payloads: DataFrame) -> DataFrame:
    """(file, payload, v): v is the parsed object, null where there is none."""
    v = F.try_parse_json("payload")
    return payloads.select("file", "payload", F.when(F.startswith(F.ltrim("payload"), F.lit("{")), v).alias("v"))


def _metric_bodies(rows: DataFrame) -> DataFrame:
    """(trace_id, metric_ord, metric_name, body) of opened() rows, metrics in the payload's order."""
    place = F.array_position(F.json_object_keys("payload"), F.col("metric_name"))
    each = rows.select(F.col("file").alias("trace_id"), "payload", F.explode(_members("v")).alias("metric_name", "body"))
    each = each.where(~F.col("metric_name").isin(*RESERVED, *report.DEPRECATED))
    own = F.coalesce(present(_get("body", "$.metric_name")), F.col("metric_name"))
    has = _get("body", "$.metric_name").isNotNull() & _get("body", "$.findings", "array<variant>").isNotNull()
    return each.where(has & ~own.isin(*report.DEPRECATED)).select("trace_id", place.cast("int").alias("metric_ord"), "metric_name", "body")


def judge_findings(rows: DataFrame) -> DataFrame:
    """Findings of all metric results of opened() rows, in report.issues' columns, with their evidence."""
    f = F.col("f")
    agents = F.transform(_items(f, "$.culprit_agent_candidates"), lambda a: _get(a, "$.agent"))
    cited = F.transform(_items(f, "$.evidence"), lambda e: F.struct(_get(e, "$.idx").alias("idx"), _get(e, "$.role").alias("role"), _get(e, "$.quote").alias("quote")))
    each = _metric_bodies(rows).select("trace_id", "metric_ord", "metric_name", F.posexplode(_items("body", "$.findings")).alias("finding_index", "f"))
    return each.select(
        "trace_id", "metric_ord", "metric_name", F.col("finding_index").cast("long").alias("finding_index"), _get(f, "$.severity_estimate").alias("severity"), _get(f, "$.confidence_estimate").alias("confidence"),
        agents.alias("culprit_agents"), F.transform(cited, lambda e: e["idx"]).alias("evidence_idxs"), F.coalesce(_get(f, "$.needs_human_review", "boolean"), F.lit(False)).alias("needs_human_review"), cited.alias("evidence"),
    )


def verifications(rows: DataFrame) -> DataFrame:
    """Evidence verifications of opened() rows, as report.issues wants them."""
    each = rows.select(F.col("file").alias("trace_id"), F.explode(_members("v", "$.evidence_verification")).alias("metric_name", "body"))
    item = each.select("trace_id", "metric_name", F.posexplode(_items("body", "$.verifications")).alias("v_ord", "x"))
    check = lambda c: F.struct(
        _get(c, "$.evidence_index", "int").alias("evidence_index"), _get(c, "$.idx").alias("idx"), _get(c, "$.resolved_idx").alias("resolved_idx"),
        F.coalesce(_get(c, "$.idx_exists", "boolean"), F.lit(False)).alias("idx_exists"), F.coalesce(_get(c, "$.quote_found", "boolean"), F.lit(False)).alias("quote_found"),
    )
    out = item.select("trace_id", "metric_name", _get("x", "$.finding_index", "bigint").alias("finding_index"), "v_ord", _get("x", "$.evidence_status").alias("evidence_status"), F.transform(_items("x", "$.evidence_item_checks"), check).alias("checks"))
    return out.where("finding_index IS NOT NULL")


def rule_findings(rows: DataFrame) -> DataFrame:
    """Rule findings that opened() rows store, under `non_llm_validators`, else `deterministic_validation`, by metric; as
    report.weighted_issues wants them. Each is its own, so it counts once."""
    block = F.coalesce(_members("v", "$.non_llm_validators"), _members("v", "$.deterministic_validation"))
    metrics = F.coalesce(F.try_variant_get(F.element_at(block, "metrics"), "$", "map<string,variant>"), block)
    each = rows.select(F.col("file").alias("trace_id"), F.explode(metrics).alias("metric_name", "body"))
    f = F.col("f")
    item = each.select("trace_id", "metric_name", F.posexplode(_items("body", "$.findings")).alias("pos", "f"))
    spans = F.transform(_items(f, "$.evidence"), lambda e: F.struct(F.coalesce(present(_get(e, "$.span_id")), _get(e, "$.idx")).alias("idx")))
    return item.select(
        "trace_id", F.col("pos").alias("v"), "metric_name", F.lower(F.coalesce(present(_get(f, "$.severity")), present(_get(f, "$.severity_estimate")), F.lit("major"))).alias("severity"),
        present(_get(f, "$.culprit_agent")).alias("agent"), F.filter(spans, lambda e: e["idx"].isNotNull()).alias("evidence"), F.coalesce(_get(f, "$.occurrences", "bigint"), F.lit(1)).alias("occurrences"),
    )


def answer_status(rows: DataFrame) -> DataFrame:
    """(file, answer_verdict, verification_mode, predicted, reference): as the payload's own answer verification says, else as
    its stored report does, else by comparing the answers that the payload states."""
    quotes = judge_findings(rows).select("trace_id", "metric_ord", "metric_name", "finding_index", F.posexplode("evidence").alias("evidence_index", "e"))
    said = answers.answers_in_quotes(quotes.select("trace_id", "metric_ord", "finding_index", "evidence_index", "e.quote")).select(F.col("trace_id").alias("file"), F.col("answer").alias("_said"))
    block, old = _members("v", "$.final_answer_verification"), _members("v", "$.report.status.answer_status")
    own = rows.join(said, "file", "left")
    label = clean_scalar(_get("v", "$.label_answer"))
    predicted = F.coalesce(_get("v", "$.final_answer_verification.predicted_answer"), answers.inferred(F.col("payload"), answers.PREDICTED_KEYS, F.coalesce("_said", label)))
    reference = F.coalesce(_get("v", "$.final_answer_verification.reference_answer"), answers.inferred(F.col("payload"), answers.REFERENCE_KEYS, label))
    out = answers.answer_status(own.select("file", "v", predicted.alias("predicted"), reference.alias("reference")))

    def first(name: str, computed: str) -> Column:
        return F.when(block.isNotNull(), _get("v", f"$.final_answer_verification.{name}")).when(old.isNotNull(), _get("v", f"$.report.status.answer_status.{name}")).otherwise(F.col(computed))

    return out.select("file", first("verdict", "answer_verdict").alias("answer_verdict"), first("verification_mode", "verification_mode").alias("verification_mode"), "predicted", "reference")


def built_reports(payloads: DataFrame, modes: Sequence[str] = ("soft",), weights: Sequence[float] = (0.0,)) -> DataFrame:
    """A report for each payload, mode and weight of its stored rule findings, with answer and review status; payloads without
    any finding are clean."""
    return _built(stored(opened(payloads), "payloads"), modes, weights)


def _built(rows: DataFrame, modes: Sequence[str], weights: Sequence[float] = (0.0,)) -> DataFrame:
    """built_reports() of stored opened() rows."""
    found = report.issues(judge_findings(rows), verifications(rows), modes, rule_findings(rows), weights)
    dims = rows.select(F.col("file").alias("trace_id"), F.explode(F.array(*map(F.lit, modes))).alias("mode")).withColumn("weight", F.explode(F.array(*[F.lit(round(w * 1000)) for w in weights])))
    made = dims.join(report.reports(found), report.KEY, "left").join(answer_status(rows).withColumnRenamed("file", "trace_id"), "trace_id")
    counts = ["issues", "review_targets", "invalid_findings", "critical_issues", "major_issues", "minor_issues", "n_agents", "n_idxs"]
    made = made.withColumn("verdict", F.coalesce("verdict", F.lit("clean"))).withColumn("_asked", F.coalesce("_asked", F.lit(False))).fillna(0, counts)
    return report.with_review_status(made)


def _names(items: Column, key: str) -> Column:
    """Names in a variant list of objects (under a key) or scalars; null vocabulary dropped, first of each without regard to case."""
    one = lambda x: clean_scalar(F.when(F.schema_of_variant(x).startswith("OBJECT"), _get(x, f"$.{key}")).otherwise(F.try_variant_get(x, "$", "string")))
    return distinct_ignoring_case(F.array_compact(F.transform(items, one)))


def _listed(v: Column) -> Column:
    """A variant list or string as a list of strings."""
    return F.coalesce(F.try_variant_get(v, "$", "array<string>"), as_list(F.try_variant_get(v, "$", "string")), F.array().cast("array<string>"))


def _first(xs: Column, x: Column) -> Column:
    return F.when(x.isNull() | F.array_contains(xs, x), xs).otherwise(F.concat(F.array(x), xs))


def stored_predictions(rows: DataFrame) -> DataFrame:
    """(file, agents, primary_agent, idxs, first_idx, invalid_findings) of the report that opened() rows store; where its lists are
    missing, those of its issues; invalid_findings counts its review targets with invalid evidence."""
    r = "$.report.diagnostic_report"
    issues = _items("v", f"{r}.issues")
    of_issues = lambda k: distinct_ignoring_case(F.array_compact(F.transform(F.flatten(F.transform(issues, lambda i: _listed(F.try_variant_get(i, f"$.{k}", "variant")))), clean_scalar)))
    got = rows.select(
        "file", _names(_items("v", f"{r}.problematic_agents"), "agent").alias("agents"), clean_scalar(_get("v", "$.report.status.diagnostic_status.primary_culprit_agent")).alias("primary_agent"),
        _names(_items("v", f"{r}.problematic_idxs"), "idx").alias("idxs"), clean_scalar(_get("v", "$.report.status.diagnostic_status.first_problem_idx")).alias("first_idx"),
        of_issues("culprit_agents").alias("_agents"), of_issues("problematic_idxs").alias("_idxs"),
        F.size(F.filter(_items("v", f"{r}.review_targets"), lambda t: F.coalesce(F.lower(_get(t, "$.evidence_status")) == "invalid", F.lit(False)))).cast("long").alias("invalid_findings"),
    )
    whole = lambda xs, x, more: F.when(F.size(_first(F.col(xs), F.col(x))) > 0, _first(F.col(xs), F.col(x))).otherwise(F.col(more))
    got = got.withColumn("agents", whole("agents", "primary_agent", "_agents")).withColumn("idxs", whole("idxs", "first_idx", "_idxs")).drop("_agents", "_idxs")
    return got.withColumn("primary_agent", F.coalesce("primary_agent", F.get("agents", F.lit(0)))).withColumn("first_idx", F.coalesce("first_idx", F.get("idxs", F.lit(0))))


def predictions(payloads: DataFrame, mode: str | None = None, first_idx: str | None = None, build_missing: bool = True) -> DataFrame:
    """(file, example_id, agents, primary_agent, idxs, first_idx, invalid_findings) for accuracy.evaluate.

    With a mode or a way to choose the first idx, every report is rebuilt; else a stored one is used, and, with build_missing,
    one is built (soft, least idx) for payloads without; otherwise those have empty lists.
    """
    rows = stored(opened(payloads), "payloads")
    has = _members("v", "$.report").isNotNull()
    rebuild = F.lit(True) if mode or first_idx else ~has if build_missing else F.lit(False)
    read = stored_predictions(rows.where(~rebuild))
    again = rows.where(rebuild)
    made = report.reports(report.issues(judge_findings(again), verifications(again), (mode or "soft",))).withColumnRenamed("trace_id", "file")
    at = FIRST_IDX[first_idx or "min_index"]
    empty = F.array().cast("array<string>")
    named = lambda c, k: F.coalesce(F.transform(c, lambda x: x[k]), empty)
    built = again.select("file").join(made, "file", "left").select(
        "file", named("problematic_agents", "agent").alias("agents"), F.col("primary_culprit_agent").alias("primary_agent"), named("problematic_idxs", "idx").alias("idxs"), F.col(at).alias("first_idx"), F.coalesce("invalid_findings", F.lit(0).cast("long")).alias("invalid_findings"),
    )
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\\.[^.]*$", "")
    place = lambda p: [clean_scalar(_get("v", f"{p}.{k}")) for k in ID_COLUMNS]
    metadata = F.when(F.size(F.coalesce(_members("v", "$.metadata"), F.create_map().cast("map<string,variant>"))) > 0, F.coalesce(*place("$.metadata"))).otherwise(F.coalesce(*place("$.trace_metadata")))
    ids = rows.select("file", F.coalesce(*place("$"), metadata, last_number(stem).cast("string")).alias("example_id"))
    return ids.join(read.unionByName(built), "file")


def report_json(reports: DataFrame, issues: DataFrame) -> DataFrame:
    """(file, report): each report as the JSON that a payload stores: status and diagnostic_report, with usable issues and review
    targets in order."""
    finding = F.struct("metric_name", "finding_index", F.col("severity").alias("severity_estimate"), F.col("confidence").alias("confidence_estimate"), "evidence_status", F.col("usable").alias("usable_for_diagnosis"), F.col("agents").alias("culprit_agents"), F.col("idxs").alias("problematic_idxs"), F.col("grounded_evidence").alias("grounded_evidence_count"), "needs_human_review")
    listed = lambda when: F.transform(F.array_sort(F.collect_list(F.when(when, F.struct("seq", finding.alias("f"))))), lambda x: x["f"])
    items = issues.groupBy(*report.KEY).agg(listed(F.col("usable")).alias("_issues"), listed(~F.col("usable")).alias("_targets"))
    none = F.array().cast(items.schema["_issues"].dataType)
    rows = reports.join(items, report.KEY, "left")
    status = F.struct(
        F.struct(F.col("answer_verdict").alias("verdict"), "verification_mode", F.col("predicted").alias("predicted_answer"), F.col("reference").alias("reference_answer")).alias("answer_status"),
        F.struct("verdict", F.col("issues").alias("issues_count"), F.col("review_targets").alias("review_targets_count"), "critical_issues", "major_issues", "minor_issues", "primary_failure_type", "primary_culprit_agent", "first_problem_idx").alias("diagnostic_status"),
        F.struct("review_required", "review_reason").alias("review_status"),
    )
    lists = lambda c, k: F.coalesce(c, F.array().cast(f"array<struct<{k}:string,findings_count:bigint>>"))
    body = F.struct(lists("problematic_agents", "agent").alias("problematic_agents"), lists("problematic_idxs", "idx").alias("problematic_idxs"), F.coalesce("_issues", none).alias("issues"), F.coalesce("_targets", none).alias("review_targets"))
    return rows.select(F.col("trace_id").alias("file"), F.to_json(F.struct(status.alias("status"), body.alias("diagnostic_report")), {"ignoreNullFields": "false"}).alias("report"))


def with_members(payload: Column, **members: Column) -> Column:
    """The payload's JSON object with members set to JSON texts; those that are null stay as they were. Keys come in order."""
    old = F.coalesce(_members(F.try_parse_json(payload)), F.create_map().cast("map<string,variant>"))
    new = F.map_from_entries(F.array_compact(F.array(*[F.when(text.isNotNull(), F.struct(F.lit(name).alias("key"), F.parse_json(text).alias("value"))) for name, text in members.items()])))
    return F.to_json(F.map_concat(F.map_filter(old, lambda k, _: ~F.map_contains_key(new, k)), new))


def with_reports(payloads: DataFrame, mode: str = "soft") -> DataFrame:
    """(file, payload): each payload with the report that is built of it. payloads is worked out once, and its text is read back
    for all that is made of it; a report joins its payload in a shuffle, as neither is small."""
    rows = stored(opened(payloads), "payloads")
    found = stored(report.issues(judge_findings(rows), verifications(rows), (mode,)), "issues")
    texts = report_json(_built(rows, (mode,)), found)
    return rows.select("file", "payload").hint("merge").join(texts, "file").select("file", with_members(F.col("payload"), report=F.col("report")).alias("payload"))


def backfilled(payloads: DataFrame, verdicts: DataFrame, overwrite: bool = False) -> DataFrame:
    """(file, payload) of the payloads that change: those without an answer verification (all, with overwrite) for which
    verdicts(file, verification) has one, a JSON object; their report is built anew of it."""
    fresh = verdicts.where("verification IS NOT NULL").groupBy("file").agg(F.max("verification").alias("verification"))
    lacks = F.lit(True) if overwrite else _members(F.try_parse_json("payload"), "$.final_answer_verification").isNull()
    rows = payloads.where(lacks).join(fresh, "file")
    return with_reports(rows.select("file", with_members(F.col("payload"), final_answer_verification=F.col("verification")).alias("payload")))
