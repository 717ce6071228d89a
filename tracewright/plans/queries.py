"""Registered queries of the engine's own operators, each with DuckDB SQL where SQL can say it."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import rules, text
from ..operators import accuracy, answers, findings, metrics, observations, payloads, report, scan, verify
from ..sources import annotations, traces
from . import payload_queries, views
from .views import JUDGE_SQL, SPANS_SQL, quoted, table


def re2(pattern: str) -> str:
    """A pattern for an engine without look-around: the looks are left out, which the view's texts do not tell apart."""
    return re.sub(r"\(\?(?:<!|!)(?:[^()]|\([^()]*\))*\)", "", pattern)


def _raw_sql() -> str:
    """Findings of all rules over spans: (trace_id, ord, idx, agent, kind, v, c, r, metric_name, failure_type, s, e, quote)."""
    parts = []
    for c, (validator, name, one, rows) in enumerate(rules.CHECKS):
        for r, (pattern, failure, cue) in enumerate(rows):
            group = "all" if one else failure
            head = f"SELECT trace_id, ord, idx, agent, kind, text, {rules.VALIDATORS.index(validator)} AS v, {c} AS c, {r} AS r, '{name}' AS metric_name, '{failure}' AS failure_type, '{group}' AS g"
            if pattern is None:
                parts.append(f"{head}, NULL AS s, NULL AS e FROM spans WHERE regexp_matches(text, {quoted(rules.JSON_LIKE)}) AND length(text) < 50000 AND NOT json_valid(text)")
                continue
            p = quoted(f"(?i)^([\\s\\S]*?)((?:{re2(pattern)}))")
            more = f" AND regexp_matches(text, {quoted('(?i)' + cue)})" if cue else ""
            parts.append(f"{head}, length(regexp_extract(text, {p}, 1)) AS s, length(regexp_extract(text, {p}, 1)) + length(regexp_extract(text, {p}, 2)) AS e FROM spans WHERE regexp_matches(text, {quoted('(?i)' + re2(pattern))}){more}")
    body = "\n  UNION ALL ".join(parts)
    signal = quoted(f"(?i)^([\\s\\S]*?)((?:{rules.ERROR_SIGNAL}))")
    return f"""hits AS ({body}),
raw AS (SELECT *, CASE WHEN s IS NOT NULL THEN text[greatest(s - 80, 0) + 1 : e + 80]
                       WHEN regexp_matches(text, {quoted('(?i)' + rules.ERROR_SIGNAL)}) THEN text[greatest(length(regexp_extract(text, {signal}, 1)) - 80, 0) + 1 : length(regexp_extract(text, {signal}, 1)) + length(regexp_extract(text, {signal}, 2)) + 80]
                       ELSE text[1:300] END AS quote
        FROM hits QUALIFY row_number() OVER (PARTITION BY trace_id, idx, c, g ORDER BY r) = 1)"""


#: Anti-joins in validator order: an earlier kept match on the same span keeps an overlapping later one out.
KEPT_SQL = "k0 AS (SELECT * FROM raw WHERE v = 0)" + "".join(
    f""",
k{n} AS (SELECT * FROM k{n - 1} UNION ALL SELECT * FROM raw b WHERE v = {n} AND NOT EXISTS (SELECT 1 FROM k{n - 1} a WHERE a.trace_id = b.trace_id AND a.idx = b.idx AND b.s < a.e AND a.s < b.e))"""
    for n in (1, 2, 3)
)
RAW_SQL = f"WITH RECURSIVE {SPANS_SQL}, {_raw_sql()}, {KEPT_SQL}"
SEVERITY_SQL = "CASE WHEN regexp_matches('_' || lower(failure_type) || '_', '_(" + "|".join(rules.MINOR_HINTS) + ")_') THEN 'minor' ELSE 'major' END"
DEDUP_SQL = (
    RAW_SQL
    + f""", keyed AS (SELECT *, lower(trim(regexp_replace(quote, '\\s+', ' ', 'g')))[1:120] AS quote_key FROM k3),
dedup AS (SELECT trace_id, metric_name, failure_type, agent, quote_key, count(*) AS occurrences, arg_min(idx, (v, c, ord, r)) AS primary_idx, arg_min(kind, (v, c, ord, r)) AS primary_kind,
                 least(count(*), 5) AS n_evidence, min(v) AS v, {SEVERITY_SQL} AS severity FROM keyed GROUP BY trace_id, metric_name, failure_type, agent, quote_key)"""
)
COLLAPSE_SQL = (
    DEDUP_SQL
    + """, up(trace_id, idx, above) AS (SELECT trace_id, idx, parent FROM spans WHERE kind = 'TOOL' AND parent IS NOT NULL
  UNION SELECT u.trace_id, u.idx, s.parent FROM up u JOIN spans s ON s.trace_id = u.trace_id AND s.idx = u.above WHERE s.parent IS NOT NULL),
share AS (SELECT DISTINCT f.trace_id, f.metric_name, f.failure_type, f.agent, f.quote_key FROM dedup f JOIN dedup t ON t.trace_id = f.trace_id AND t.metric_name = f.metric_name AND t.failure_type = f.failure_type
          JOIN up ON up.trace_id = t.trace_id AND up.idx = t.primary_idx AND up.above = f.primary_idx
          WHERE f.v < 2 AND t.v < 2 AND f.primary_kind <> 'TOOL' AND t.primary_kind = 'TOOL' AND
            CASE WHEN least(length(f.quote_key), length(t.quote_key)) < 30
                 THEN contains(f.quote_key, t.quote_key) OR contains(t.quote_key, f.quote_key)
                 ELSE len(list_filter(range(1, least(length(f.quote_key), length(t.quote_key)) - 28),
                        lambda i: contains(CASE WHEN length(f.quote_key) <= length(t.quote_key) THEN t.quote_key ELSE f.quote_key END,
                                           substr(CASE WHEN length(f.quote_key) <= length(t.quote_key) THEN f.quote_key ELSE t.quote_key END, i, 30)))) > 0 END)"""
)


def q_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return views.event_spans(spark, sf_dir).drop("event_id")


def q_chat_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return traces.spans_of(views.chat_traces(spark, sf_dir)).select("trace_id", "ord", "idx", "text", "agent")


CHAT_SQL = """SELECT CAST(conv_id AS VARCHAR) AS trace_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS ord,
  CAST(row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) - 1 AS VARCHAR) AS idx, text[1:50000] AS text, CAST(NULL AS VARCHAR) AS agent FROM conversations"""


def q_rule_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(views.event_spans(spark, sf_dir), suppress=False).select("trace_id", "idx", "metric_name", "failure_type", "severity", "m_start", "m_end", "quote")


def q_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan.scan(views.event_spans(spark, sf_dir)).select("trace_id", "idx", "metric_name", "failure_type", "validator")


def q_document_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules over whole documents, however long (the cap is for spans of traces): the scan's cost on real prose."""
    d = table(spark, sf_dir, "documents")
    none = F.lit(None).cast("string")
    spans = d.select(F.col("source").alias("trace_id"), F.col("doc_id").alias("ord"), F.col("doc_id").cast("string").alias("idx"), "text", F.col("lang").alias("agent"), none.alias("kind"), none.alias("parent"))
    return scan.scan(spans, most=None).groupBy("metric_name", "failure_type").agg(F.count(F.lit(1)).alias("n"))


def q_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = findings.deduplicated(scan.scan(views.event_spans(spark, sf_dir)))
    return out.select("trace_id", "metric_name", "failure_type", "agent", "quote_key", "occurrences", "primary_idx", "severity", F.size("evidence").alias("n_evidence"))


def _collapsed(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = views.event_spans(spark, sf_dir)
    return findings.collapsed(findings.deduplicated(scan.scan(spans)), spans)


def q_collapse(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _collapsed(spark, sf_dir).select("trace_id", "metric_name", "failure_type", "agent", "quote_key", "occurrences", "primary_idx")


def q_result(spark: SparkSession, sf_dir: str) -> DataFrame:
    spans = views.event_spans(spark, sf_dir)
    out = findings.validator_result(findings.deduplicated(scan.scan(spans)), spans)
    return out.select("trace_id", "agent_attribution_available", "n_findings", F.coalesce(F.size("metrics"), F.lit(0)).alias("n_metrics"), F.get("metrics", F.lit(0))["metric_name"].alias("first_metric"))


def q_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows of all findings of all metrics."""
    spans = views.event_spans(spark, sf_dir)
    marked = findings.numbered_for_review(findings.deduplicated(scan.scan(spans)))
    return findings.candidate_windows(marked, spans).select("trace_id", "finding_id", "idx", "ord")


REVIEW_SQL = (
    DEDUP_SQL
    + """, q AS (SELECT trace_id, metric_name, failure_type, agent, quote_key, min((v, c, ord, r)) AS q, arg_min(ord, (v, c, ord, r)) AS o, arg_min(quote, (v, c, ord, r)) AS quote FROM keyed GROUP BY trace_id, metric_name, failure_type, agent, quote_key),
num AS (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY mq, q) - 1 AS f, length(quote) % 5 = 0 AS lost FROM (SELECT *, min(q) OVER (PARTITION BY trace_id, metric_name) AS mq FROM q)),
near AS (SELECT n.trace_id, f, s.ord, s.idx, s.agent, s.kind, s.text, s.event_id FROM num n JOIN spans s ON s.trace_id = n.trace_id AND s.ord BETWEEN n.o - 4 AND n.o + 4 WHERE NOT lost),
offered AS (SELECT trace_id, f, string_agg(idx, ',' ORDER BY ord) AS ids FROM near GROUP BY ALL),
asked AS (SELECT n.trace_id, string_agg(concat_ws('|', 'F' || f, metric_name, failure_type, quote, CASE WHEN lost THEN 'x' || o ELSE CAST(o AS VARCHAR) END, CASE WHEN lost THEN 'x' || o ELSE ids END), chr(10) ORDER BY f) AS findings FROM num n LEFT JOIN offered USING (trace_id, f) GROUP BY 1),
texts AS (SELECT trace_id, string_agg(concat_ws('|', idx, agent, kind, CASE WHEN event_id % 4 > 0 THEN 'raw ' ELSE '' END || text, text), chr(10) ORDER BY ord) AS spans FROM (SELECT DISTINCT trace_id, ord, idx, agent, kind, text, event_id FROM near) GROUP BY 1)
SELECT trace_id, findings, coalesce(t.spans, '') AS spans FROM asked LEFT JOIN texts t USING (trace_id)"""
)


def q_review_input(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a confirming model is shown of each trace: a finding whose quote's length is a multiple of five cites a span that is
    not there; three of four spans have a whole text."""
    spans = views.event_spans(spark, sf_dir)
    marked = findings.numbered_for_review(findings.deduplicated(scan.scan(spans)))
    lost = F.length(F.col("evidence")[0]["quote"]) % 5 == 0
    marked = marked.withColumn("primary_idx", F.when(lost, F.concat(F.lit("x"), "primary_idx")).otherwise(F.col("primary_idx")))
    whole = spans.where("event_id % 4 > 0").select("trace_id", "idx", F.concat(F.lit("raw "), "text").alias("text"))
    shown = findings.review_input(marked, spans, whole)
    asked = F.transform("findings", lambda f: F.concat_ws("|", f["finding_id"], f["metric_name"], f["failure_type"], f["quote"], f["current_idx"], F.array_join(f["candidate_idxs"], ",")))
    texts = F.transform("spans", lambda x: F.concat_ws("|", x["idx"], x["role"], x["kind"], x["text"], x["stripped"]))
    return shown.select("trace_id", F.array_join(asked, "\n").alias("findings"), F.array_join(texts, "\n").alias("spans"))


def _issues(spark: SparkSession, sf_dir: str, modes=report.MODES, **more) -> DataFrame:
    judge = views.judge_findings(spark, sf_dir)
    return report.issues(judge, views.judge_verifications(judge), modes, **more)


def q_gates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _issues(spark, sf_dir).select("trace_id", "mode", "finding_index", "usable", "score", F.size("idxs").alias("n_idxs"))


def q_agent_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked_agents(_issues(spark, sf_dir)).select("trace_id", "mode", "agent", "findings_count", "score", "rank")


def q_idx_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.ranked_idxs(_issues(spark, sf_dir)).select("trace_id", "mode", "idx", "findings_count", "score", "rank")


STATUS = ["trace_id", "mode", "verdict", "issues", "review_targets", "critical_issues", "major_issues", "minor_issues", "n_agents", "n_idxs", "primary_failure_type", "primary_culprit_agent", "first_problem_idx", "top_ranked_idx", "review_required"]


def q_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    return report.with_review_status(report.reports(_issues(spark, sf_dir))).select(*STATUS)


AGENT_RANK_SQL = f"""WITH {JUDGE_SQL},
ranked AS (SELECT trace_id, mode, agent, count(*) AS findings_count, CAST(sum(score) AS BIGINT) AS score, row_number() OVER (PARTITION BY trace_id, mode ORDER BY count(*) DESC, sum(score) DESC, lower(agent)) AS rank
           FROM (SELECT *, unnest(agents) AS agent FROM scored WHERE usable) GROUP BY trace_id, mode, agent)"""
IDX_RANK_SQL = """
idx_ranked AS (SELECT trace_id, mode, idx, count(*) AS findings_count, CAST(sum(score) AS BIGINT) AS score, row_number() OVER (PARTITION BY trace_id, mode ORDER BY count(*) DESC, sum(score) DESC, CAST(idx AS BIGINT)) AS rank
               FROM (SELECT *, unnest(idxs) AS idx FROM scored WHERE usable) GROUP BY trace_id, mode, idx)"""
FAILURES_SQL = "CASE primary_metric " + " ".join(f"WHEN '{m}' THEN '{f}'" for m, f in report.FAILURE_OF_METRIC.items()) + " END"
REPORT_SQL = f"""{AGENT_RANK_SQL}, {IDX_RANK_SQL},
counts AS (SELECT trace_id, mode, count(*) FILTER (usable) AS issues, count(*) FILTER (NOT usable) AS review_targets, count(*) FILTER (NOT usable AND status = 'invalid') AS invalid_findings, count(*) FILTER (usable AND severity = 'critical') AS critical_issues,
                  count(*) FILTER (usable AND severity = 'major') AS major_issues, count(*) FILTER (usable AND severity = 'minor') AS minor_issues, coalesce(bool_or(needs) FILTER (usable), false) AS asked
           FROM scored GROUP BY ALL),
metric AS (SELECT trace_id, mode, arg_max(metric_name, (s, metric_name)) AS primary_metric FROM (SELECT trace_id, mode, metric_name, sum(score) AS s FROM scored WHERE usable GROUP BY ALL) GROUP BY ALL),
a AS (SELECT trace_id, mode, count(*) AS n_agents, arg_min(agent, rank) AS primary_culprit_agent FROM ranked GROUP BY ALL),
i AS (SELECT trace_id, mode, count(*) AS n_idxs, arg_min(idx, CAST(idx AS BIGINT)) AS first_problem_idx, arg_min(idx, rank) AS top_ranked_idx FROM idx_ranked GROUP BY ALL),
status AS (SELECT trace_id, mode, CASE WHEN issues > 0 THEN 'issues_found' WHEN review_targets > 0 THEN 'needs_review' ELSE 'clean' END AS verdict, issues, review_targets, critical_issues, major_issues, minor_issues,
           coalesce(n_agents, 0) AS n_agents, coalesce(n_idxs, 0) AS n_idxs, {FAILURES_SQL} AS primary_failure_type, primary_culprit_agent, first_problem_idx, top_ranked_idx, asked OR (issues = 0 AND review_targets > 0) AS review_required, invalid_findings
           FROM counts LEFT JOIN metric USING (trace_id, mode) LEFT JOIN a USING (trace_id, mode) LEFT JOIN i USING (trace_id, mode))"""

LAMBDAS = (0.0, 0.25, 0.5, 1.0)


def q_lambda(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports under several weights of validator findings, in one plan."""
    found = findings.deduplicated(scan.scan(views.event_spans(spark, sf_dir)))
    rows = report.reports(_issues(spark, sf_dir, ("soft",), findings=found, weights=LAMBDAS))
    return rows.select("trace_id", "weight", "issues", "review_targets", "critical_issues", "major_issues", "minor_issues", "primary_culprit_agent", "top_ranked_idx")


LAMBDA_SQL = (
    DEDUP_SQL.replace("WITH RECURSIVE ", f"WITH RECURSIVE {JUDGE_SQL}, ", 1)
    + f""", lambdas AS (SELECT unnest({[round(w * 1000) for w in LAMBDAS]}) AS weight),
ev AS (SELECT trace_id, metric_name, failure_type, agent, quote_key, list(DISTINCT idx) AS idxs FROM (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY trace_id, metric_name, failure_type, agent, quote_key ORDER BY v, c, ord, r) <= 5) GROUP BY ALL),
every AS (SELECT trace_id, weight, severity, usable, score, agents, idxs FROM scored, lambdas WHERE mode = 'soft'
  UNION ALL SELECT d.trace_id, weight, severity, true, CASE severity WHEN 'minor' THEN 1 ELSE 2 END * 1000 * weight * occurrences, [d.agent], ev.idxs FROM dedup d JOIN ev USING (trace_id, metric_name, failure_type, agent, quote_key), lambdas WHERE weight > 0),
a AS (SELECT trace_id, weight, arg_max(agent, (n, s, -o)) AS primary_culprit_agent FROM (SELECT *, row_number() OVER (PARTITION BY trace_id, weight ORDER BY lower(agent)) AS o FROM (SELECT trace_id, weight, agent, count(*) AS n, sum(score) AS s FROM (SELECT *, unnest(agents) AS agent FROM every WHERE usable) GROUP BY ALL)) GROUP BY ALL),
i AS (SELECT trace_id, weight, arg_max(idx, (n, s, -CAST(idx AS BIGINT))) AS top_ranked_idx FROM (SELECT trace_id, weight, idx, count(*) AS n, sum(score) AS s FROM (SELECT *, unnest(idxs) AS idx FROM every WHERE usable) GROUP BY ALL) GROUP BY ALL)
SELECT trace_id, weight, count(*) FILTER (usable) AS issues, count(*) FILTER (NOT usable) AS review_targets, count(*) FILTER (usable AND severity = 'critical') AS critical_issues,
       count(*) FILTER (usable AND severity = 'major') AS major_issues, count(*) FILTER (usable AND severity = 'minor') AS minor_issues, any_value(primary_culprit_agent) AS primary_culprit_agent, any_value(top_ranked_idx) AS top_ranked_idx
FROM every LEFT JOIN a USING (trace_id, weight) LEFT JOIN i USING (trace_id, weight) GROUP BY trace_id, weight"""
)


def _compared(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = report.reports(_issues(spark, sf_dir))
    pred = rows.select(
        "mode", F.concat(F.lit("/runs/task_"), "trace_id", F.lit(".json")).alias("file"), F.when(F.col("trace_id").cast("long") % 2 == 0, F.col("trace_id")).alias("example_id"),
        F.transform(F.coalesce("problematic_agents", F.array().cast("array<struct<agent:string,findings_count:bigint>>")), lambda a: a["agent"]).alias("agents"), F.col("primary_culprit_agent").alias("primary_agent"),
        F.transform(F.coalesce("problematic_idxs", F.array().cast("array<struct<idx:string,findings_count:bigint>>")), lambda a: a["idx"]).alias("idxs"), F.col("top_ranked_idx").alias("first_idx"), "invalid_findings",
    )
    return accuracy.evaluate(pred, annotations.normalised(views.gold(spark, sf_dir)), ["trace_id"])


def q_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _compared(spark, sf_dir)
    return rows.select("mode", "file", "annotation_row_index", *accuracy.OUTCOMES)


def q_unmatched(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _compared(spark, sf_dir)[1].select("mode", "file")


def q_accuracy(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = accuracy.accuracy_summary(_compared(spark, sf_dir)[0], ["mode"])
    return out.select("mode", "examples", "agent_examples", "step_examples", "invalid_findings", *[f"n_{c}" for c in accuracy.OUTCOMES])


def q_worst(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows, _ = _compared(spark, sf_dir)
    return accuracy.worst_examples(rows.where("mode = 'soft'"), 20).select("file", "misses", "invalid_findings")


MATCH_SQL = f"""{REPORT_SQL},
gold AS (SELECT DISTINCT user_id, 'agent' || (user_id % 5) AS g, [user_id % 50, user_id % 50 + 3] AS steps FROM events WHERE user_id % 4 <> 0),
outcome AS (SELECT s.mode, '/runs/task_' || s.trace_id || '.json' AS file, g.user_id AS annotation_row_index, s.invalid_findings,
  coalesce(s.primary_culprit_agent = g.g, false) AS agent_top1,
  EXISTS (SELECT 1 FROM ranked r WHERE r.trace_id = s.trace_id AND r.mode = s.mode AND r.agent = g.g) AS agent_hit,
  coalesce(s.n_agents = 1 AND s.primary_culprit_agent = g.g, false) AS agent_exact,
  {", ".join(f"coalesce(len(list_filter(g.steps, lambda x: abs(x - CAST(s.top_ranked_idx AS BIGINT)) <= {t})) > 0, false) AS step_top1_{t}" for t in accuracy.TOLERANCES)},
  EXISTS (SELECT 1 FROM idx_ranked r WHERE r.trace_id = s.trace_id AND r.mode = s.mode AND list_contains(g.steps, CAST(r.idx AS BIGINT))) AS step_hit,
  EXISTS (SELECT 1 FROM idx_ranked r WHERE r.trace_id = s.trace_id AND r.mode = s.mode AND len(list_filter(g.steps, lambda x: abs(x - CAST(r.idx AS BIGINT)) <= 1)) > 0) AS step_hit_near
  FROM status s JOIN gold g ON CAST(g.user_id AS VARCHAR) = s.trace_id)"""
ACC_SQL = ", ".join(f"count(*) FILTER ({c}) AS n_{c}" for c in accuracy.OUTCOMES)


def q_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Predictions of stored payloads: of the report where one is stored, else of one that is built."""
    out = payloads.predictions(views.result_payloads(spark, sf_dir))
    return out.select("file", "example_id", F.array_join("agents", ",").alias("agents"), "primary_agent", F.array_join("idxs", ",").alias("idxs"), "first_idx", "invalid_findings")


PREDICTIONS_SQL = f"""{REPORT_SQL},
a2 AS (SELECT trace_id, string_agg(agent, ',' ORDER BY rank) AS agents FROM ranked WHERE mode = 'soft' GROUP BY 1), i2 AS (SELECT trace_id, string_agg(idx, ',' ORDER BY rank) AS idxs FROM idx_ranked WHERE mode = 'soft' GROUP BY 1),
built AS (SELECT trace_id, CAST(trace_id AS BIGINT) AS u, coalesce(agents, '') AS agents, primary_culprit_agent, coalesce(idxs, '') AS idxs, first_problem_idx, invalid_findings FROM status LEFT JOIN a2 USING (trace_id) LEFT JOIN i2 USING (trace_id) WHERE mode = 'soft')
SELECT '/runs/task_' || u || '.json' AS file, trace_id AS example_id, CASE WHEN u % 3 > 0 THEN agents WHEN u % 2 = 1 THEN 'agent6,agent' || (u % 5) ELSE 'agent8,agent9' END AS agents,
  CASE WHEN u % 3 > 0 THEN primary_culprit_agent WHEN u % 2 = 1 THEN 'agent6' ELSE 'agent8' END AS primary_agent, CASE WHEN u % 3 > 0 THEN idxs ELSE u || ',x7' END AS idxs,
  CASE WHEN u % 3 > 0 THEN first_problem_idx ELSE trace_id END AS first_idx, CASE WHEN u % 3 > 0 THEN invalid_findings ELSE 1 END AS invalid_findings FROM built"""


def q_payload_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reports built of stored payloads, with the answer's status from its verification, the stored report or the answers, written
    back into the payloads and read from there."""
    made = payloads.with_reports(views.result_payloads(spark, sf_dir)).select("file", F.parse_json("payload").alias("v"))
    at = lambda path, kind: F.try_variant_get("v", f"$.report.status.{path}", kind)
    n = lambda k: F.size(F.try_variant_get("v", f"$.report.diagnostic_report.{k}", "array<variant>"))
    return made.select(
        "file", at("diagnostic_status.verdict", "string").alias("verdict"), at("diagnostic_status.issues_count", "bigint").alias("issues"), n("issues").alias("n_issues"), n("review_targets").alias("n_targets"), at("diagnostic_status.primary_failure_type", "string").alias("primary_failure_type"),
        at("answer_status.verdict", "string").alias("answer_verdict"), at("answer_status.verification_mode", "string").alias("verification_mode"), at("review_status.review_required", "boolean").alias("review_required"),
    )


PAYLOAD_REPORTS_SQL = f"""{REPORT_SQL}, said AS (SELECT *, CASE WHEN u % 4 = 1 THEN 'ideal' WHEN u % 3 = 0 THEN 'needs_review' WHEN u % 5 = 0 THEN 'incorrect' ELSE 'correct' END AS answer_verdict FROM (SELECT *, CAST(trace_id AS BIGINT) AS u FROM status WHERE mode = 'soft'))
SELECT '/runs/task_' || u || '.json' AS file, verdict, issues, issues AS n_issues, review_targets AS n_targets, primary_failure_type, answer_verdict, CASE WHEN u % 4 = 1 THEN 'by_hand' WHEN u % 3 = 0 THEN 'manual' ELSE 'reference_based' END AS verification_mode,
  review_required OR answer_verdict = 'needs_review' AS review_required FROM said"""


def q_top_agents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flagship: scan, overlap, dedup, collapse, weighted report, and each trace's main culprit."""
    rows = report.reports(_issues(spark, sf_dir, ("soft",), findings=_collapsed(spark, sf_dir), weights=(1.0,)))
    return rows.select("trace_id", "verdict", "issues", "primary_failure_type", "primary_culprit_agent", "top_ranked_idx")


GONE_SQL = "s.trace_id = d.trace_id AND s.metric_name = d.metric_name AND s.failure_type = d.failure_type AND s.agent = d.agent AND s.quote_key = d.quote_key"
TOP_AGENTS_SQL = (
    COLLAPSE_SQL.replace("WITH RECURSIVE ", f"WITH RECURSIVE {JUDGE_SQL}, ", 1)
    + f""", ev AS (SELECT trace_id, metric_name, failure_type, agent, quote_key, list(DISTINCT idx) AS idxs FROM (SELECT * FROM keyed QUALIFY row_number() OVER (PARTITION BY trace_id, metric_name, failure_type, agent, quote_key ORDER BY v, c, ord, r) <= 5) GROUP BY ALL),
every AS (SELECT trace_id, metric_name, usable, score, agents, idxs FROM scored WHERE mode = 'soft'
  UNION ALL SELECT d.trace_id, d.metric_name, true, CASE severity WHEN 'minor' THEN 1 ELSE 2 END * 1000000 * occurrences, [d.agent], ev.idxs FROM (SELECT * FROM dedup d ANTI JOIN share s ON {GONE_SQL}) d JOIN ev USING (trace_id, metric_name, failure_type, agent, quote_key)),
metric AS (SELECT trace_id, arg_max(metric_name, (s, metric_name)) AS primary_metric FROM (SELECT trace_id, metric_name, sum(score) AS s FROM every WHERE usable GROUP BY ALL) GROUP BY ALL),
a AS (SELECT trace_id, arg_max(agent, (n, s, -o)) AS primary_culprit_agent FROM (SELECT *, row_number() OVER (PARTITION BY trace_id ORDER BY lower(agent)) AS o FROM (SELECT trace_id, agent, count(*) AS n, sum(score) AS s FROM (SELECT *, unnest(agents) AS agent FROM every WHERE usable) GROUP BY ALL)) GROUP BY ALL),
i AS (SELECT trace_id, arg_max(idx, (n, s, -CAST(idx AS BIGINT))) AS top_ranked_idx FROM (SELECT trace_id, idx, count(*) AS n, sum(score) AS s FROM (SELECT *, unnest(idxs) AS idx FROM every WHERE usable) GROUP BY ALL) GROUP BY ALL),
counts AS (SELECT trace_id, count(*) FILTER (usable) AS issues FROM every GROUP BY 1)
SELECT trace_id, CASE WHEN issues > 0 THEN 'issues_found' ELSE 'needs_review' END AS verdict, issues, coalesce({FAILURES_SQL}, primary_metric) AS primary_failure_type, primary_culprit_agent, top_ranked_idx
FROM counts LEFT JOIN metric USING (trace_id) LEFT JOIN a USING (trace_id) LEFT JOIN i USING (trace_id)"""
)


def q_verify(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citations of error events against their user's spans: exact, off by one, in the raw trace only, or nowhere."""
    spans = views.event_spans(spark, sf_dir)
    kind = F.col("event_id") % 4
    err = spans.where("agent = 'error'")
    cite = err.select(
        "trace_id", F.lit("tool_selection").alias("metric_name"), F.col("event_id").alias("finding_index"), F.lit(0).alias("evidence_index"),
        F.when(kind == 1, (F.col("ord") + 1).cast("string")).when(kind == 2, F.lit("nowhere_1")).otherwise(F.col("idx")).alias("idx"), F.lit("culprit").alias("role"), F.when(kind == 3, F.lit("words that no span holds")).otherwise(F.col("text")).alias("quote"),
    )
    items = spans.select("trace_id", F.col("ord").alias("write_ord"), "idx", F.col("text").alias("content"), "agent", F.lit("agent_state").alias("idx_type"), F.lit(False).alias("is_default"))
    raw = traces.rendered(spans)
    no_blocks = raw.withColumn("trace", F.regexp_replace("trace", r"(?m)^\[\d+\]", "-"))
    met = verify.resolved(cite, verify.idx_index(items, no_blocks), no_blocks)
    judged = err.select("trace_id", F.lit("tool_selection").alias("metric_name"), F.col("event_id").alias("finding_index"), F.lit("high").alias("confidence"), F.lit(False).alias("needs_human_review"), F.array().cast("array<string>").alias("culprit_agents"))
    return verify.verifications(judged, met).select("trace_id", "finding_index", "evidence_status", "all_idxs_exist", "quotes_found_in_idxs", "usable_for_diagnosis")


VERIFY_SQL = f"""WITH {SPANS_SQL} SELECT trace_id, event_id AS finding_index, CASE WHEN event_id % 4 = 3 THEN 'invalid' ELSE 'verified' END AS evidence_status, true AS all_idxs_exist,
  event_id % 4 <> 3 AS quotes_found_in_idxs, event_id % 4 <> 3 AS usable_for_diagnosis FROM spans WHERE agent = 'error'"""


def q_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "conversations")
    raw = F.concat(F.lit("  "), "role", F.lit(" (turn "), F.col("turn").cast("string"), F.lit(")"))
    return c.select("conv_id", "turn", text.role_agent(F.concat(F.lit("Web"), "role", F.lit(" (thought)"))).alias("agent"), text.role_agent(raw).alias("chat_agent"), text.quote_key(F.col("text")).alias("quote_key"), text.agent_key(raw).alias("agent_key"), text.last_number(raw).alias("number"))


SCALARS_SQL = r"""SELECT conv_id, turn, 'Web' || role AS agent, CASE WHEN role NOT IN ('system', 'user', 'assistant', 'tool', 'human') THEN role END AS chat_agent,
  lower(trim(regexp_replace(text, '\s+', ' ', 'g')))[1:120] AS quote_key, role || 'turn' || turn AS agent_key, turn AS number FROM conversations"""


def q_confusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars"), "doc_id")
    return accuracy.confusion(rows.withColumn("long_text", (F.col("n_chars") >= 1000).cast("int")), "long_text", "quality", ["lang"])


CONFUSION_SQL = """SELECT *, (tp + tn) / (tp + fp + fn + tn) AS accuracy, coalesce(tp / nullif(tp + fp, 0), 0) AS precision, coalesce(tp / nullif(tp + fn, 0), 0) AS recall, coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0) AS f1
FROM (SELECT lang, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn
      FROM (SELECT lang, n_chars >= 1000 AS p, quality = 1 AS g FROM labels JOIN documents USING (doc_id)) GROUP BY lang)"""


def _usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    return line.select(F.col("l_orderkey").alias("trace_id"), F.col("l_linenumber").alias("ord"), F.concat(F.lit("agent"), (F.col("l_suppkey") % 3).cast("string")).alias("agent"), F.col("l_quantity").cast("long").alias("latency"), F.col("l_partkey").alias("input_tokens"), F.col("l_suppkey").alias("output_tokens"), (F.col("l_returnflag") == "R").alias("is_invalid"))


def q_tool_efficiency(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.tool_efficiency(_usage(spark, sf_dir))


def q_trace_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.totals(_usage(spark, sf_dir))


def q_agent_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.per_agent(_usage(spark, sf_dir).groupBy("trace_id", "agent", "ord").agg(F.max("latency").alias("latency"), F.max("input_tokens").alias("input_tokens"), F.max("output_tokens").alias("output_tokens")))


USAGE_SQL = "usage AS (SELECT l_orderkey AS trace_id, l_linenumber AS ord, 'agent' || (l_suppkey % 3) AS agent, CAST(trunc(l_quantity) AS BIGINT) AS latency, l_partkey AS input_tokens, l_suppkey AS output_tokens, l_returnflag = 'R' AS is_invalid FROM lineitem)"


def q_cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = table(spark, sf_dir, "lineitem")
    usage = line.select(F.col("l_orderkey").alias("task_id"), F.col("l_returnflag").alias("metric_name"), F.col("l_linestatus").alias("failure_reason"), F.col("l_partkey").alias("tokens"), F.col("l_linenumber").cast("long").alias("seconds"))
    return accuracy.cost_rollup(usage)


COST_SQL = """SELECT CASE WHEN grouping(m) = 0 THEN 'metric' WHEN grouping(f) = 0 THEN 'reason' ELSE 'total' END AS grain, m AS metric_name, f AS failure_reason, count(*) AS calls, CAST(sum(l_partkey) AS BIGINT) AS tokens, CAST(sum(l_linenumber) AS BIGINT) AS seconds, count(DISTINCT l_orderkey) AS tasks
FROM (SELECT *, l_returnflag AS m, l_linestatus AS f FROM lineitem) GROUP BY GROUPING SETS ((m), (f), ())"""


def q_status_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as stored results, their lines as metrics m1, m2, …: two of three have task stats, every sixth empty ones, every fiftieth is cut off."""
    k = F.col("l_orderkey")
    place = Window.partitionBy("l_orderkey").orderBy("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_returnflag", "l_linestatus")
    line = table(spark, sf_dir, "lineitem").withColumn("at", F.row_number().over(place))
    ok = F.when(F.col("l_returnflag") == "N", "ok").when(F.col("l_returnflag") == "R", "failed")
    status = F.struct(ok.alias("status"), F.when(F.col("l_linestatus") == "F", F.concat(F.lit("reason "), (F.col("l_suppkey") % 5).cast("string"))).alias("reason"), F.col("l_quantity").cast("double").alias("duration_s"), F.col("l_partkey").alias("input_tokens"), F.when(F.col("l_suppkey") % 2 == 0, F.col("l_suppkey")).alias("output_tokens"))
    stats = F.struct((F.col("n") + 0.5).alias("wall_s"), (k % 100).alias("input_tokens"), (k % 7).alias("total_tokens"), F.col("n").alias("metrics_ok"))
    tasks = line.groupBy("l_orderkey").agg(F.map_from_entries(F.collect_list(F.struct(F.concat(F.lit("m"), F.col("at").cast("string")), status))).alias("metric_status"), F.count(F.lit(1)).alias("n"))
    body = F.to_json(F.struct(F.when(k % 6 == 0, F.from_json(F.lit("{}"), "struct<wall_s:double>")).alias("none"), F.when(k % 3 > 0, stats).alias("task_stats"), "metric_status"))
    body = F.when(k % 6 == 0, F.replace(body, F.lit('"none"'), F.lit('"task_stats"'))).otherwise(body)
    return accuracy.status_rollup(tasks.select(F.col("l_orderkey").cast("string").alias("file"), F.when(k % 50 == 0, F.left(body, F.length(body) - 1)).otherwise(body).alias("payload")))


STATUS_SQL = """WITH line AS (SELECT *, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_returnflag, l_linestatus) AS place, CASE WHEN l_returnflag = 'N' THEN 1 ELSE 0 END AS good, CASE WHEN l_linestatus = 'F' THEN 'reason ' || (l_suppkey % 5) ELSE 'error' END AS reason FROM lineitem WHERE l_orderkey % 50 > 0),
task AS (SELECT l_orderkey AS k, count(*) AS n, l_orderkey % 50 > 0 AND l_orderkey % 3 > 0 AS given FROM lineitem GROUP BY 1),
rows AS (
  SELECT 'total' AS grain, NULL AS name, count(*) AS files, count(*) FILTER (given) AS files_with_stats, coalesce(sum(n) FILTER (given), 0) AS ok, 0 AS failed, coalesce(sum(n + 0.5) FILTER (given), 0) AS seconds, coalesce(sum(k % 100) FILTER (given), 0) AS input_tokens, 0 AS output_tokens, coalesce(sum(k % 7) FILTER (given), 0) AS total_tokens FROM task
  UNION ALL SELECT 'metric', 'm' || place, 0, 0, sum(good), sum(1 - good), sum(l_quantity), sum(l_partkey), sum(CASE WHEN l_suppkey % 2 = 0 THEN l_suppkey ELSE 0 END), 0 FROM line GROUP BY 2
  UNION ALL SELECT 'reason', reason, 0, 0, 0, count(*), 0, 0, 0, 0 FROM line WHERE good = 0 GROUP BY 2)
SELECT grain, name, CAST(files AS BIGINT) AS files, CAST(files_with_stats AS BIGINT) AS files_with_stats, CAST(ok AS BIGINT) AS ok, CAST(failed AS BIGINT) AS failed, CAST(seconds AS DOUBLE) AS seconds, CAST(input_tokens AS BIGINT) AS input_tokens, CAST(output_tokens AS BIGINT) AS output_tokens,
  CAST(total_tokens AS BIGINT) AS total_tokens, CASE WHEN grain = 'total' THEN round(CAST(seconds AS DOUBLE) / greatest(files_with_stats, 1), 2) END AS avg_seconds, CASE WHEN grain = 'total' THEN round(CAST(total_tokens AS DOUBLE) / greatest(files_with_stats, 1), 1) END AS avg_tokens FROM rows"""


def q_judged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as judged results: half have an overall score, others list errors that are all 0, all 1 or mixed; some have no
    annotation. Both thresholds in use."""
    k = F.col("o_orderkey")
    score = F.get(F.array(*map(F.lit, ("Ideal", "fair", "poor", "ideal"))), (k % 4).cast("int"))
    flag = lambda n: F.when(k % 10 < 3, 0).when(k % 10 == 3, 1).otherwise(F.lit(n))
    scored = F.to_json(F.struct(F.array(F.struct(((k % 11) / 2).alias("overall"))).alias("scores")))
    listed = F.to_json(F.struct(flag(0).alias("loops"), flag(1).alias("stalls")))
    note = F.when(k % 7 == 0, "{}").when(k % 10 > 4, scored).otherwise(listed)
    body = F.concat(F.lit('{"summarizer_score": {"scores": [{"score": "'), score, F.lit('"}]}'), F.when(k % 13 > 0, F.concat(F.lit(', "annotation": '), note)).otherwise(""), F.lit("}"))
    payloads = table(spark, sf_dir, "orders").select(k.cast("string").alias("file"), body.alias("payload"))
    out = None
    for least in (4.0, 3.0):
        part = accuracy.confusion(accuracy.judged(payloads, least).withColumn("threshold", F.lit(least)), "predicted", "gold", ["threshold"])
        out = part if out is None else out.unionByName(part)
    return out.select("threshold", "tp", "fp", "fn", "tn", *[F.round(c, 9).alias(c) for c in ("accuracy", "precision", "recall", "f1")])


JUDGED_SQL = """WITH t AS (SELECT CAST(threshold AS DOUBLE) AS threshold, o_orderkey % 4 IN (0, 3) AS p, CASE WHEN o_orderkey % 13 = 0 OR o_orderkey % 7 = 0 THEN NULL WHEN o_orderkey % 10 > 4 THEN (o_orderkey % 11) / 2 >= threshold
    WHEN o_orderkey % 10 < 3 THEN true WHEN o_orderkey % 10 = 3 THEN false END AS g FROM orders, (VALUES (4.0), (3.0)) AS v(threshold)),
n AS (SELECT threshold, count(*) FILTER (p AND g) AS tp, count(*) FILTER (p AND NOT g) AS fp, count(*) FILTER (NOT p AND g) AS fn, count(*) FILTER (NOT p AND NOT g) AS tn FROM t WHERE g IS NOT NULL GROUP BY 1)
SELECT *, round((tp + tn) / (tp + fp + fn + tn), 9) AS accuracy, round(coalesce(tp / nullif(tp + fp, 0), 0), 9) AS precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 9) AS recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 9) AS f1 FROM n"""


def q_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events")
    return metrics.score_histogram(e.select(F.col("event_type").alias("metric_name"), F.get(F.array(F.lit("ideal"), F.lit("fair"), F.lit("poor")), (F.col("event_id") % 3).cast("int")).alias("score")))


HISTOGRAM_SQL = "SELECT event_type AS metric_name, count(*) FILTER (event_id % 3 = 0) AS ideal, count(*) FILTER (event_id % 3 = 1) AS fair, count(*) FILTER (event_id % 3 = 2) AS poor FROM events GROUP BY 1"


def q_tool_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Clicks as calls, errors and views of the same user as tool runs with the call's id."""
    e = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("trace_id"), "event_id", "event_type")
    call = (F.col("event_id") % 20).cast("string")
    calls = e.where("event_type = 'click'").select("trace_id", F.concat(F.lit("agent"), (F.col("event_id") % 3).cast("string")).alias("agent"), F.lit("search").alias("name"), call.alias("call_id"), "event_id")
    runs = e.where("event_type <> 'click'").select("trace_id", F.col("event_id").alias("ord"), F.lit("running tool: search").alias("name"), call.alias("call_id"), F.col("event_type").alias("output"), F.when(F.col("event_type") == "error", "failed").alias("status_message"))
    return observations.resolved_calls(calls, runs).select("trace_id", "agent", "call_id", "event_id", "result", "is_invalid")


TOOL_CALLS_SQL = """SELECT CAST(c.user_id AS VARCHAR) AS trace_id, 'agent' || (c.event_id % 3) AS agent, CAST(c.event_id % 20 AS VARCHAR) AS call_id, c.event_id, r.event_type AS result, coalesce(r.event_type = 'error', false) AS is_invalid
FROM events c LEFT JOIN (SELECT user_id, event_id % 20 AS k, arg_min(event_type, event_id) AS event_type FROM events WHERE event_type <> 'click' GROUP BY ALL) r ON r.user_id = c.user_id AND r.k = c.event_id % 20 WHERE c.event_type = 'click'"""


def q_answers(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = table(spark, sf_dir, "customer").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("c_nationkey") == F.col("n_nationkey"))
    said = F.when(F.col("c_custkey") % 3 == 0, F.upper("n_name")).when(F.col("c_custkey") % 3 == 1, F.concat(F.lit(' "'), "n_name", F.lit('". '))).otherwise(F.lit("none"))
    return answers.answer_status(c.select("c_custkey", said.alias("predicted"), F.col("n_name").alias("reference"))).select("c_custkey", "answer_verdict", "verification_mode")


ANSWERS_SQL = "SELECT c_custkey, CASE WHEN c_custkey % 3 = 2 THEN 'unknown' ELSE 'correct' END AS answer_verdict, 'reference_based' AS verification_mode FROM customer"


def q_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Format detection over conversations dressed up in all four formats."""
    t = views.chat_traces(spark, sf_dir).withColumn("n", F.col("trace_id").cast("long") % 4)
    body = F.col("payload")
    dressed = F.when(F.col("n") == 0, body).when(F.col("n") == 1, F.replace(body, F.lit('{"history":'), F.lit('{"projectId":"p","observations":'))).when(
        F.col("n") == 2, F.replace(body, F.lit('{"history":['), F.lit('{"spans":[{"span_name":"root","span_kind":"AGENT"},'))).otherwise(F.replace(body, F.lit('{"history":'), F.lit('{"turns":')))
    return traces.with_format(t.select("trace_id", dressed.alias("payload"))).groupBy("detected_format").agg(F.count(F.lit(1)).alias("n"))


FORMATS_SQL = "SELECT ['who_and_when', 'pumpkin', 'trail', 'unknown'][conv_id % 4 + 1] AS detected_format, count(DISTINCT conv_id) AS n FROM conversations GROUP BY 1"

QUERIES = {
    "top_agents": q_top_agents, "spans_from_events": q_spans, "spans_from_conversations": q_chat_spans, "format_detection": q_formats, "scalar_normalisers": q_scalars,
    "rule_scan": q_rule_scan, "rule_scan_documents": q_document_scan, "overlap_suppress": q_overlap, "finding_dedup": q_dedup, "chain_collapse": q_collapse, "validator_result": q_result,
    "candidate_window": q_window, "review_input": q_review_input, "evidence_status": q_verify, "gate_modes": q_gates, "report_agent_rank": q_agent_rank, "report_idx_rank": q_idx_rank, "report_status": q_reports,
    "lambda_ablation": q_lambda, "gold_match_cascade": q_matches, "gold_unmatched": q_unmatched, "verifier_ablation": q_accuracy, "topk_errors": q_worst, "confusion_f1": q_confusion, "judged_confusion": q_judged,
    "tool_efficiency": q_tool_efficiency, "trace_totals": q_trace_totals, "stored_predictions": q_predictions, "payload_reports": q_payload_reports, "usage_by_agent": q_agent_usage, "cost_rollup": q_cost, "status_rollup": q_status_rollup, "score_histogram": q_histogram, "tool_call_resolve": q_tool_calls, "answer_status": q_answers,
}
QUERIES |= payload_queries.QUERIES
ORACLE_SQL = payload_queries.ORACLE_SQL | {
    "top_agents": TOP_AGENTS_SQL,
    "stored_predictions": PREDICTIONS_SQL,
    "payload_reports": PAYLOAD_REPORTS_SQL,
    "spans_from_events": f"WITH {SPANS_SQL} SELECT trace_id, ord, idx, text, agent, kind, parent FROM spans",
    "spans_from_conversations": CHAT_SQL,
    "format_detection": FORMATS_SQL,
    "scalar_normalisers": SCALARS_SQL,
    "rule_scan": f"{RAW_SQL} SELECT trace_id, idx, metric_name, failure_type, {SEVERITY_SQL} AS severity, s AS m_start, e AS m_end, quote FROM raw",
    "overlap_suppress": f"{RAW_SQL} SELECT trace_id, idx, metric_name, failure_type, {list(rules.VALIDATORS)}[v + 1] AS validator FROM k3",
    "finding_dedup": f"{DEDUP_SQL} SELECT trace_id, metric_name, failure_type, agent, quote_key, occurrences, primary_idx, severity, n_evidence FROM dedup",
    "chain_collapse": f"{COLLAPSE_SQL} SELECT d.trace_id, d.metric_name, d.failure_type, d.agent, d.quote_key, occurrences, primary_idx FROM dedup d ANTI JOIN share s ON {GONE_SQL}",
    "validator_result": f"{DEDUP_SQL}, firsts AS (SELECT trace_id, metric_name, min((v, c, ord, r)) AS q FROM keyed GROUP BY ALL) SELECT t.trace_id, true AS agent_attribution_available, coalesce(n, 0) AS n_findings, coalesce(m, 0) AS n_metrics, first_metric FROM (SELECT DISTINCT trace_id FROM spans) t LEFT JOIN (SELECT trace_id, count(*) AS n, count(DISTINCT metric_name) AS m FROM dedup GROUP BY 1) USING (trace_id) LEFT JOIN (SELECT trace_id, arg_min(metric_name, q) AS first_metric FROM firsts GROUP BY 1) USING (trace_id)",
    "candidate_window": f"{DEDUP_SQL}, q AS (SELECT trace_id, metric_name, failure_type, agent, quote_key, min((v, c, ord, r)) AS q, arg_min(ord, (v, c, ord, r)) AS o FROM keyed GROUP BY trace_id, metric_name, failure_type, agent, quote_key), num AS (SELECT *, 'F' || (row_number() OVER (PARTITION BY trace_id ORDER BY mq, q) - 1) AS finding_id FROM (SELECT *, min(q) OVER (PARTITION BY trace_id, metric_name) AS mq FROM q)) SELECT n.trace_id, finding_id, s.idx, s.ord FROM num n JOIN spans s ON s.trace_id = n.trace_id AND s.ord BETWEEN n.o - 4 AND n.o + 4",
    "review_input": REVIEW_SQL,
    "evidence_status": VERIFY_SQL,
    "gate_modes": f"WITH {JUDGE_SQL} SELECT trace_id, mode, finding_index, usable, score, len(idxs) AS n_idxs FROM scored",
    "report_agent_rank": f"{AGENT_RANK_SQL} SELECT * FROM ranked",
    "report_idx_rank": f"WITH {JUDGE_SQL}, {IDX_RANK_SQL} SELECT * FROM idx_ranked",
    "report_status": f"{REPORT_SQL} SELECT * EXCLUDE (invalid_findings) FROM status",
    "lambda_ablation": LAMBDA_SQL,
    "gold_match_cascade": f"{MATCH_SQL} SELECT * EXCLUDE (invalid_findings) FROM outcome",
    "gold_unmatched": f"{REPORT_SQL} SELECT mode, '/runs/task_' || trace_id || '.json' AS file FROM status WHERE CAST(trace_id AS BIGINT) % 4 = 0",
    "verifier_ablation": f"{MATCH_SQL} SELECT mode, count(*) AS examples, count(*) AS agent_examples, count(*) AS step_examples, CAST(sum(invalid_findings) AS BIGINT) AS invalid_findings, {ACC_SQL} FROM outcome GROUP BY mode",
    "topk_errors": f"{MATCH_SQL} SELECT file, CAST(NOT agent_top1 AS INT) + CAST(NOT agent_hit AS INT) + CAST(NOT step_top1_0 AS INT) + CAST(NOT step_hit AS INT) AS misses, invalid_findings FROM outcome WHERE mode = 'soft' ORDER BY misses DESC, invalid_findings DESC, file LIMIT 20",
    "confusion_f1": CONFUSION_SQL,
    "judged_confusion": JUDGED_SQL,
    "tool_efficiency": f"WITH {USAGE_SQL} SELECT trace_id, v AS valid_calls, i AS invalid_calls, coalesce(v / nullif(v + 2 * i, 0), 0) AS efficiency FROM (SELECT trace_id, count(*) FILTER (NOT is_invalid) AS v, count(*) FILTER (is_invalid) AS i FROM usage GROUP BY 1)",
    "trace_totals": f"WITH {USAGE_SQL} SELECT trace_id, CAST(sum(latency) AS BIGINT) AS latency, CAST(sum(input_tokens) AS BIGINT) AS input_tokens, CAST(sum(output_tokens) AS BIGINT) AS output_tokens FROM usage GROUP BY 1",
    "usage_by_agent": f"WITH {USAGE_SQL}, u AS (SELECT trace_id, agent, ord, max(latency) AS latency, max(input_tokens) AS input_tokens, max(output_tokens) AS output_tokens FROM usage GROUP BY ALL) SELECT trace_id, agent, arg_max(latency, ord) AS latency, arg_max(input_tokens, ord) AS input_tokens, arg_max(output_tokens, ord) AS output_tokens FROM u GROUP BY ALL",
    "cost_rollup": COST_SQL,
    "status_rollup": STATUS_SQL,
    "score_histogram": HISTOGRAM_SQL,
    "tool_call_resolve": TOOL_CALLS_SQL,
    "answer_status": ANSWERS_SQL,
}
