"""The driver's tables seen as traces, findings and gold: synthetic, deterministic, the same arithmetic in Spark and SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Error texts for events of type `error`, chosen by event_id; together they reach every check.
TEMPLATES = (
    "provider said: invalid api key for this call", "openai replied with status code: 401 and no body", "RateLimitError from openai, http 429 too many requests",
    "You exceeded your current quota", "insufficient balance on the account", "the model alpha does not exist", "context length of this call exceeded",
    "finish_reason: length", "JSONDecodeError: Expecting value: line 1 column 1", "KeyError: choices in response", "tool lookup not found in registry",
    "TypeError: bad operand in tool", "error: missing required argument path", "unexpected keyword argument depth", "response format violation in answer",
    "{\"a\": 1, \"b\": ", "http 404 while fetching", "empty response from host", "connection refused by peer", "missing environment variable HOME_DIR",
    "api_key not set here", "invalid yaml in settings", "No module named widget", "permission denied on write", "FileNotFoundError: no such file or directory",
    "503 service unavailable", "[1, 2, 3]", "stream interrupted at byte 9", "context overflow in call", "tpm limit exceeded", "returned None instead of rows",
    "quota reached and connection reset, status 500", "ValueError: broken value was raised", "all went well in this step",
)
METRICS = ("observation_alignment", "policy_alignment", "state_consistency", "tool_selection", "tool_parameter_extraction", "task_completeness", "mas_planning", "mas_complexity", "mas_task_transfer", "mas_roles_distribution", "tool_performance", "prompt_quality")


def quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def event_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events of a user as a trace, in time order; every third span is a tool's, the parent is half way up."""
    e = table(spark, sf_dir, "events")
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    texts = F.array(*map(F.lit, TEMPLATES))
    text = F.when(F.col("event_type") == "error", F.get(texts, (F.col("event_id") % len(TEMPLATES)).cast("int"))).otherwise(F.concat(F.lit("step "), "event_type", F.lit(" done")))
    rows = e.select("user_id", "event_id", "event_type", text.alias("text"), (F.row_number().over(w) - 1).alias("ord"))
    return rows.select(
        F.col("user_id").cast("string").alias("trace_id"), "ord", F.col("ord").cast("string").alias("idx"), "text", F.col("event_type").alias("agent"),
        F.when(F.col("event_id") % 3 == 0, "TOOL").otherwise("CHAIN").alias("kind"), F.when(F.col("ord") > 0, F.floor((F.col("ord") - 1) / 2).cast("string")).alias("parent"), "event_id",
    )


SPANS_SQL = f"""spans AS (
  SELECT CAST(user_id AS VARCHAR) AS trace_id, ord, CAST(ord AS VARCHAR) AS idx, agent, text, event_id,
         CASE WHEN event_id % 3 = 0 THEN 'TOOL' ELSE 'CHAIN' END AS kind, CASE WHEN ord > 0 THEN CAST((ord - 1) // 2 AS VARCHAR) END AS parent
  FROM (SELECT user_id, event_id, event_type AS agent, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS ord,
               CASE WHEN event_type = 'error' THEN [{", ".join(map(quoted, TEMPLATES))}][event_id % {len(TEMPLATES)} + 1] ELSE 'step ' || event_type || ' done' END AS text
        FROM events))"""


def chat_traces(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Conversations as raw history payloads."""
    c = table(spark, sf_dir, "conversations")
    turn = F.struct("turn", "role", "text")
    step = lambda t: F.struct(t["role"].alias("role"), t["text"].alias("content"))
    history = F.transform(F.array_sort(F.collect_list(turn)), step)
    return c.groupBy("conv_id").agg(F.to_json(F.struct(history.alias("history"))).alias("payload")).select(F.col("conv_id").cast("string").alias("trace_id"), "payload")


def judge_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Error events as recorded findings of a judge."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    i = F.col("event_id")
    pick = lambda xs, n: F.get(F.array(*map(F.lit, xs)), n.cast("int"))
    return e.select(
        F.col("user_id").cast("string").alias("trace_id"), (i % 12).cast("int").alias("metric_ord"), pick(METRICS, i % 12).alias("metric_name"), i.alias("finding_index"),
        pick(("critical", "major", "minor"), i % 3).alias("severity"), pick(("high", "medium", "low"), F.floor(i / 3) % 3).alias("confidence"),
        F.array(F.concat(F.lit("agent"), (i % 5).cast("string")), F.concat(F.lit("agent"), (i % 7).cast("string"))).alias("culprit_agents"),
        F.array((i % 50).cast("string"), (i % 50 + 1).cast("string")).alias("evidence_idxs"), (i % 11 == 0).alias("needs_human_review"),
    )


def judge_verifications(judge: DataFrame) -> DataFrame:
    """A verification for three of four findings: verified, weak, invalid; two citations each, of which weak has one."""
    i = F.col("finding_index")
    check = lambda n, ok: F.struct(F.lit(n).alias("evidence_index"), F.col("evidence_idxs")[n].alias("idx"), F.lit(None).cast("string").alias("resolved_idx"), ok.alias("idx_exists"), ok.alias("quote_found"))
    return judge.where(i % 4 < 3).select(
        "trace_id", "metric_name", "finding_index", F.lit(0).alias("v_ord"), F.get(F.array(*map(F.lit, ("verified", "weak", "invalid"))), (i % 4).cast("int")).alias("evidence_status"),
        F.array(check(0, i % 4 < 2), check(1, i % 4 == 0)).alias("checks"),
    )


JUDGE_SQL = f"""judge AS (
  SELECT CAST(user_id AS VARCHAR) AS trace_id, event_id AS finding_index, event_id % 12 AS metric_ord, [{", ".join(map(quoted, METRICS))}][event_id % 12 + 1] AS metric_name,
         ['critical', 'major', 'minor'][event_id % 3 + 1] AS severity, [3, 2, 1][event_id % 3 + 1] * [100, 75, 50][(event_id // 3) % 3 + 1] AS base,
         ['high', 'medium', 'low'][(event_id // 3) % 3 + 1] AS confidence, ['verified', 'weak', 'invalid', NULL][event_id % 4 + 1] AS status, event_id % 11 = 0 AS needs,
         list_distinct(['agent' || (event_id % 5), 'agent' || (event_id % 7)]) AS agents,
         CASE event_id % 4 WHEN 1 THEN [CAST(event_id % 50 AS VARCHAR)] WHEN 2 THEN CAST([] AS VARCHAR[]) ELSE [CAST(event_id % 50 AS VARCHAR), CAST(event_id % 50 + 1 AS VARCHAR)] END AS idxs
  FROM events WHERE event_type = 'error'), modes AS (SELECT unnest(['none', 'strict', 'soft']) AS mode),
scored AS (SELECT judge.*, mode, CASE mode WHEN 'none' THEN true WHEN 'strict' THEN coalesce(status = 'verified', false) ELSE coalesce(status IN ('verified', 'weak'), false) END AS usable,
           base * coalesce(CASE status WHEN 'verified' THEN 10 WHEN 'weak' THEN 7 WHEN 'invalid' THEN 0 END, 7) * 1000 AS score FROM judge, modes)"""


def result_payloads(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(file, payload): a user's judge findings and verifications as a stored result; every third user has a report already, every
    fourth an answer verification, and every second stored report lists neither agents nor a culprit."""
    judge = judge_findings(spark, sf_dir)
    place = (F.row_number().over(Window.partitionBy("trace_id", "metric_name").orderBy("finding_index")) - 1).cast("long")
    both = judge.join(judge_verifications(judge).drop("v_ord"), ["trace_id", "metric_name", "finding_index"], "left").withColumn("at", place)
    agents = F.transform("culprit_agents", lambda a: F.struct(a.alias("agent")))
    finding = F.struct(F.col("severity").alias("severity_estimate"), F.col("confidence").alias("confidence_estimate"), agents.alias("culprit_agent_candidates"), F.transform("evidence_idxs", lambda i: F.struct(i.alias("idx"))).alias("evidence"), "needs_human_review")
    checked = F.when(F.col("evidence_status").isNotNull(), F.struct(F.col("at").alias("finding_index"), "evidence_status", F.col("checks").alias("evidence_item_checks")))
    listed = lambda x: F.transform(F.array_sort(F.collect_list(F.struct("at", x.alias("x")))), lambda v: v["x"])
    metric = both.groupBy("trace_id", "metric_name").agg(listed(finding).alias("findings"), F.array_compact(listed(checked)).alias("verifications"))
    entry = lambda x: F.map_from_entries(F.collect_list(F.struct("metric_name", x)))
    tasks = metric.groupBy("trace_id").agg(F.to_json(entry(F.struct("metric_name", "findings"))).alias("metrics"), F.to_json(entry(F.struct("verifications"))).alias("checks"))
    u = F.col("trace_id").cast("long")
    named = u % 2 == 1
    report = F.struct(
        F.struct(
            F.when(named, F.array(F.struct(F.concat(F.lit("agent"), (u % 5).cast("string")).alias("agent")))).alias("problematic_agents"),
            F.array(F.struct(F.array(F.lit("agent8"), F.lit("agent9")).alias("culprit_agents"), F.array(F.col("trace_id"), F.lit("x7")).alias("problematic_idxs"))).alias("issues"),
            F.array(F.struct(F.lit("Invalid").alias("evidence_status")), F.struct(F.lit("weak").alias("evidence_status"))).alias("review_targets"),
        ).alias("diagnostic_report"),
        F.struct(F.struct(F.when(named, "agent6").alias("primary_culprit_agent")).alias("diagnostic_status"), F.struct(F.lit("needs_review").alias("verdict"), F.lit("manual").alias("verification_mode")).alias("answer_status")).alias("status"),
    )
    verified = F.struct(F.lit("ideal").alias("verdict"), F.lit("by_hand").alias("verification_mode"))
    rest = F.to_json(F.struct(F.when(u % 3 == 0, report).alias("report"), F.when(u % 4 == 1, verified).alias("final_answer_verification"), F.when(u % 5 == 0, "other").otherwise(F.concat(F.lit("Answer "), "trace_id", F.lit("."))).alias("model_answer"), F.concat(F.lit("answer "), "trace_id").alias("gold_answer")))
    body = F.concat(F.expr("left(metrics, length(metrics) - 1)"), F.lit(', "evidence_verification": '), "checks", F.lit(", "), F.substring(rest, 2, 1 << 20))
    return tasks.select(F.concat(F.lit("/runs/task_"), "trace_id", F.lit(".json")).alias("file"), body.alias("payload"))


def gold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Annotations for three of four users."""
    u = table(spark, sf_dir, "events").select("user_id").distinct().where("user_id % 4 <> 0")
    i = F.col("user_id")
    agents = F.array(F.concat(F.lit("Agent "), (i % 5).cast("string")))
    return u.select(i.alias("row_index"), i.cast("string").alias("trace_id"), agents.cast("string").alias("unused"), F.concat(F.lit("Agent "), (i % 5).cast("string")).alias("mistake_agent"), F.concat_ws(";", (i % 50).cast("string"), (i % 50 + 3).cast("string")).alias("mistake_step"))
