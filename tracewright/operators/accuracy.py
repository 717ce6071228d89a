"""Scoring reports against gold annotations, and summaries of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import agent_key, clean_scalar, distinct_ignoring_case, idx_key, last_number

TOLERANCES = (0, 1, 3, 5)


def annotation_index(annotations: DataFrame, key_columns: list[str]) -> DataFrame:
    """(key, annotation struct): each annotation under its row number and every id it has; the first row of a key wins."""
    keys = [F.col("row_index").cast("string"), *[clean_scalar(F.col(c)) for c in key_columns]]
    body = F.struct("row_index", "example_id", "gold_agents", "gold_idxs")
    each = annotations.select(F.explode(F.array_distinct(F.array_compact(F.array(*keys)))).alias("key"), body.alias("annotation"))
    return each.groupBy("key").agg(F.min_by("annotation", F.col("annotation.row_index")).alias("annotation"))


def matched(predictions: DataFrame, index: DataFrame) -> DataFrame:
    """predictions(file, example_id, …) with annotation: by example id, else by the last number in the file's stem."""
    stem = F.regexp_replace(F.regexp_extract("file", r"([^/]*)$", 1), r"\.[^.]*$", "")
    rows = predictions.withColumn("_number", last_number(stem).cast("string"))
    by_id = index.select(F.col("key").alias("_k1"), F.col("annotation").alias("_a1"))
    by_number = index.select(F.col("key").alias("_k2"), F.col("annotation").alias("_a2"))
    out = rows.join(by_id, F.col("example_id") == F.col("_k1"), "left").join(by_number, F.col("_number") == F.col("_k2"), "left")
    return out.withColumn("annotation", F.coalesce("_a1", "_a2")).drop("_k1", "_a1", "_k2", "_a2", "_number")


def idx_matches(pred: Column, gold: Column, tolerance: int) -> Column:
    """Whether any gold idx has the same text or a last number within the tolerance; false, never null."""
    p, n = idx_key(pred), last_number(clean_scalar(pred))
    same = lambda g: (p != "") & (p == idx_key(g))
    near = lambda g: F.abs(n - last_number(clean_scalar(g))) <= tolerance
    return F.coalesce(F.exists(gold, lambda g: F.coalesce(same(g), F.lit(False)) | F.coalesce(near(g), F.lit(False))), F.lit(False))


def compared(rows: DataFrame, step_tolerance: int = 1) -> DataFrame:
    """rows(agents, primary_agent, idxs, first_idx, gold_agents, gold_idxs, …) with the outcome columns, null without gold."""
    gold = F.array_distinct(F.transform("gold_agents", agent_key))
    pred = F.array_distinct(F.transform("agents", agent_key))
    first = agent_key(F.col("primary_agent"))
    has_agents, has_idxs = F.size("gold_agents") > 0, F.size("gold_idxs") > 0
    no = F.lit(False)
    hit = lambda t: F.exists("idxs", lambda i: idx_matches(i, F.col("gold_idxs"), t))
    out = rows.withColumns({
        "agent_top1": F.when(has_agents, F.coalesce((first != "") & F.array_contains(gold, first), no)),
        "agent_hit": F.when(has_agents, F.coalesce(F.arrays_overlap(gold, pred), no)),
        "agent_exact": F.when(has_agents, F.array_sort(gold) == F.array_sort(pred)),
        "step_hit": F.when(has_idxs, F.coalesce(hit(0), no)),
        "step_hit_near": F.when(has_idxs, F.coalesce(hit(step_tolerance), no)),
    })
    return out.withColumns({f"step_top1_{t}": F.when(has_idxs, F.coalesce(F.col("first_idx") != "", no) & idx_matches(F.col("first_idx"), F.col("gold_idxs"), t)) for t in TOLERANCES})


OUTCOMES = ["agent_top1", "agent_hit", "agent_exact", *[f"step_top1_{t}" for t in TOLERANCES], "step_hit", "step_hit_near"]


def accuracy_summary(rows: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Examples and correct ones for each outcome (n_* and acc_*): nulls are left out of both."""
    aggs = [F.count(F.lit(1)).alias("examples")]
    for c in OUTCOMES:
        aggs += [F.count_if(c).alias(f"n_{c}"), F.avg(F.col(c).cast("int")).alias(f"acc_{c}")]
    aggs += [F.count("agent_hit").alias("agent_examples"), F.count("step_hit").alias("step_examples"), F.coalesce(F.sum("invalid_findings"), F.lit(0)).alias("invalid_findings")]
    return rows.groupBy(*(by or [])).agg(*aggs)


def evaluate(predictions: DataFrame, annotations: DataFrame, key_columns: list[str], step_tolerance: int = 1) -> tuple[DataFrame, DataFrame]:
    """(comparisons of matched predictions, unmatched predictions)."""
    rows = matched(predictions, annotation_index(annotations, key_columns))
    flat = rows.where("annotation IS NOT NULL").select("*", F.col("annotation.gold_agents").alias("gold_agents"), F.col("annotation.gold_idxs").alias("gold_idxs"), F.col("annotation.row_index").alias("annotation_row_index"))
    return compared(flat.drop("annotation"), step_tolerance), rows.where("annotation IS NULL").drop("annotation")


def prediction_lists(rows: DataFrame) -> DataFrame:
    """agents and idxs without repeats (case ignored), order kept."""
    return rows.withColumn("agents", distinct_ignoring_case(F.col("agents"))).withColumn("idxs", distinct_ignoring_case(F.col("idxs")))


def worst_examples(rows: DataFrame, k: int = 20) -> DataFrame:
    """The k comparisons with most misses, then most invalid findings, then by file."""
    misses = sum((F.coalesce((~F.col(c)).cast("int"), F.lit(0)) for c in ("agent_top1", "agent_hit", "step_top1_0", "step_hit")), F.lit(0))
    return rows.withColumn("misses", misses).orderBy(F.desc("misses"), F.desc("invalid_findings"), "file").limit(k)


def root_cause_gold(failures: DataFrame) -> DataFrame:
    """Gold of trajectory(trajectory_id, row_index, failures array<struct<failure_id,step_number,failed_agent,failure_category>>,
    root_cause_failure_id): all failures' agents and steps, and those of the root cause."""
    items = F.col("failures")
    root = F.get(F.filter(items, lambda f: f["failure_id"] == F.col("root_cause_failure_id")), F.lit(0))
    pick = lambda name: F.array_distinct(F.array_compact(F.transform(items, lambda f: f[name].cast("string"))))
    return failures.select(
        "row_index", "trajectory_id", pick("failed_agent").alias("mistake_agents"), pick("step_number").alias("mistake_steps"),
        root["failed_agent"].alias("root_cause_agent"), root["step_number"].cast("string").alias("root_cause_step"), pick("failure_category").alias("failure_categories"), F.size(items).alias("num_failures"),
    )


def embedded_gold(payloads: DataFrame) -> DataFrame:
    """Gold that result payloads carry themselves: payloads(payload) as (sample_id, gold_agents). Faulty agents are names or
    objects with agent_name; those without a name are left out. Without a list of agents, gold is empty."""
    agents = F.from_json(F.get_json_object("payload", "$.ground_truth_faulty_agents"), "array<string>")
    name = lambda a: F.when(F.startswith(a, F.lit("{")), F.get_json_object(a, "$.agent_name")).otherwise(a)
    named = F.filter(F.transform(agents, name), lambda a: a != "")
    return payloads.select(F.get_json_object("payload", "$.sample_id").alias("sample_id"), F.coalesce(named, F.array().cast("array<string>")).alias("gold_agents"))


def accuracy_gaps(summary: DataFrame) -> DataFrame:
    """accuracy_summary() with what its shares tell of ranking and indexing: agent_gap (hit less top 1: agents that are found
    but not ranked first), near_gap (hit within the tolerance less exact hit: steps off by a little) and rank_gap (exact hit
    less top 1 step); null without gold."""
    gap = lambda a, b: F.col(f"acc_{a}") - F.col(f"acc_{b}")
    return summary.withColumns({"agent_gap": gap("agent_hit", "agent_top1"), "near_gap": gap("step_hit_near", "step_hit"), "rank_gap": gap("step_hit", "step_top1_0")})


def confusion(rows: DataFrame, predicted: str, gold: str, by: list[str] | None = None) -> DataFrame:
    """tp, fp, fn, tn and accuracy, precision, recall, f1 with 0 for empty denominators; rows with a null are left out."""
    p, g = F.col(predicted) == 1, F.col(gold) == 1
    n = rows.where(F.col(predicted).isNotNull() & F.col(gold).isNotNull()).groupBy(*(by or [])).agg(
        F.count_if(p & g).alias("tp"), F.count_if(p & ~g).alias("fp"), F.count_if(~p & g).alias("fn"), F.count_if(~p & ~g).alias("tn")
    )
    share = lambda a, b: F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))
    tp, fp, fn, tn = (F.col(c) for c in ("tp", "fp", "fn", "tn"))
    return n.withColumns({"accuracy": share(tp + tn, tp + fp + fn + tn), "precision": share(tp, tp + fp), "recall": share(tp, tp + fn), "f1": share(2 * tp, 2 * tp + fp + fn)})


def binarised(score: Column, n_errors: Column, threshold: float = 4.0) -> Column:
    """Gold of an overall score: 1 from the threshold on, 1 without errors, else null."""
    return F.when(score >= threshold, 1).when(n_errors == 0, 1)


def judged(payloads: DataFrame, threshold: float = 4.0) -> DataFrame:
    """(file, predicted, gold) of payloads(file, payload) with a summarizer's score and an annotation, for confusion().

    predicted is 1 where the first score is `ideal`, else 0. gold of an annotation with scores is 1 from the threshold on, else
    0 (no overall score is 0); of one that lists errors by name it is 1 where all are 0, 0 where all are 1. Mixed, empty and
    missing annotations, and payloads that are no JSON, have null gold.
    """
    said = F.lower(F.get_json_object("payload", "$.summarizer_score.scores[0].score"))
    given = F.from_json(F.get_json_object("payload", "$.annotation"), "map<string,string>")
    overall = F.coalesce(F.get_json_object("payload", "$.annotation.scores[0].overall").try_cast("double"), F.lit(0.0))
    flags = F.transform(F.map_values(given), lambda v: F.when(v == "true", 1.0).when(v == "false", 0.0).otherwise(v.try_cast("double")))
    every = lambda n: F.coalesce((F.size(flags) > 0) & F.forall(flags, lambda v: F.coalesce(v == n, F.lit(False))), F.lit(False))
    scored = F.coalesce(F.map_contains_key(given, "scores"), F.lit(False))
    gold = F.when(scored, (overall >= threshold).cast("int")).when(every(0.0), 1).when(every(1.0), 0)
    return payloads.select("file", F.coalesce(said == "ideal", F.lit(False)).cast("int").alias("predicted"), gold.alias("gold"))


def cost_rollup(usage: DataFrame) -> DataFrame:
    """usage(task_id, metric_name, tokens, seconds, failure_reason): totals, per metric and per reason in one pass; grain says
    which.

    Calls are shuffled once, by task, as they are: all three grains' sums of a task are then made where its calls are, and what
    is left adds up to one row a name. Grouping sets would write each call three times into maps that hardly shrink.
    """
    none = {c: F.lit(None).cast(usage.schema[c].dataType) for c in ("metric_name", "failure_reason")}
    grain = lambda name, **own: F.struct(F.lit(name).alias("grain"), *[own.get(c, x).alias(c) for c, x in none.items()])
    grains = F.array(grain("metric", metric_name=F.col("metric_name")), grain("reason", failure_reason=F.col("failure_reason")), grain("total"))
    calls = usage.select("task_id", "metric_name", "failure_reason", "tokens", "seconds").repartition("task_id")
    each = calls.select("task_id", "tokens", "seconds", F.explode(grains).alias("g")).select("task_id", "g.*", "tokens", "seconds")
    by = ["grain", *none]
    of_task = each.groupBy("task_id", *by).agg(F.count(F.lit(1)).alias("calls"), F.sum("tokens").alias("tokens"), F.sum("seconds").alias("seconds"))
    return of_task.groupBy(*by).agg(*[F.sum(c).alias(c) for c in ("calls", "tokens", "seconds")], F.count("task_id").alias("tasks"))


#: What a stored result says of a task and of each metric's run.
TASK_STATS, METRIC_STATUS = "struct<wall_s:double,input_tokens:double,output_tokens:double,total_tokens:double,metrics_ok:double,metrics_failed:double>", "map<string,struct<status:string,reason:string,duration_s:double,input_tokens:double,output_tokens:double,total_tokens:double>>"


def status_rollup(payloads: DataFrame) -> DataFrame:
    """payloads(file, payload): time, tokens and outcomes of a run, in one pass and one shuffle of short rows.

    (grain, name, files, files_with_stats, ok, failed, seconds, input_tokens, output_tokens, total_tokens, avg_seconds, avg_tokens).
    grain `total` sums task_stats, with averages over the tasks that have any (0 without one); `metric` sums metric_status by
    metric; `reason` counts failed metrics by reason, `error` where none is given. A status other than `ok` has failed; missing
    numbers are 0. A payload that is no JSON is a file without stats. Without payloads there is no row.
    """
    # Each object is parsed in its own step, as Spark parses it once for each use in one.
    top = payloads.select(F.from_json("payload", "map<string,string>").alias("top")).select(F.col("top")["task_stats"].alias("t"), F.col("top")["metric_status"].alias("m"))
    some = F.coalesce(F.size(F.json_object_keys("t")) > 0, F.lit(False)).cast("int")
    rows = top.select(F.from_json("t", TASK_STATS).alias("t"), F.from_json("m", METRIC_STATUS).alias("m"), some.alias("some"))
    each = rows.select("t", "some", F.posexplode_outer("m").alias("pos", "metric", "x"))
    first, ok = F.coalesce(F.col("pos") == 0, F.lit(True)), F.coalesce(F.col("x.status") == "ok", F.lit(False))
    bad = F.col("metric").isNotNull() & ~ok
    long = lambda c: F.coalesce(c, F.lit(0.0)).cast("long")
    tokens = ("input_tokens", "output_tokens", "total_tokens")
    of_task = {"files": F.lit(1), "files_with_stats": F.col("some"), "ok": long(F.col("t.metrics_ok")), "failed": long(F.col("t.metrics_failed")), "seconds": F.coalesce("t.wall_s", F.lit(0.0))} | {c: long(F.col(f"t.{c}")) for c in tokens}
    of_metric = {"ok": ok.cast("long"), "failed": bad.cast("long"), "seconds": F.coalesce("x.duration_s", F.lit(0.0))} | {c: long(F.col(f"x.{c}")) for c in tokens}
    sums = [F.sum(F.when(first, v).otherwise(0)).alias(f"t_{c}") for c, v in of_task.items()] + [F.sum(v).alias(f"m_{c}") for c, v in of_metric.items()]
    # A row a metric and reason, which the few grains are made of.
    found = each.groupBy("metric", F.when(bad, F.coalesce("x.reason", F.lit("error"))).alias("reason")).agg(*sums)

    def item(grain: str, name: Column, have: dict[str, str]) -> Column:
        return F.struct(F.lit(grain).alias("grain"), name.alias("name"), *[(F.col(have[c]) if c in have else F.lit(0).cast("double" if c == "seconds" else "long")).alias(c) for c in of_task])

    items = F.array(
        item("total", F.lit(None).cast("string"), {c: f"t_{c}" for c in of_task}), F.when(F.col("metric").isNotNull(), item("metric", F.col("metric"), {c: f"m_{c}" for c in of_metric})),
        F.when(F.col("reason").isNotNull(), item("reason", F.col("reason"), {"failed": "m_failed"})),
    )
    out = found.select(F.inline(F.array_compact(items))).groupBy("grain", "name").agg(*[F.sum(c).alias(c) for c in of_task])
    mean = lambda c, digits: F.when(F.col("grain") == "total", F.round(F.col(c) / F.greatest("files_with_stats", F.lit(1)), digits))
    return out.withColumns({"avg_seconds": mean("seconds", 2), "avg_tokens": mean("total_tokens", 1)})
