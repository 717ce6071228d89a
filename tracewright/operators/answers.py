"""Final answers: extraction, comparison, routing and status."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.text import clean_scalar, present, stripped

#: Payload keys in order of precedence, and the mark of a final answer.
PREDICTED_KEYS = ("predicted_answer", "model_answer", "final_answer", "answer")
REFERENCE_KEYS = ("reference_answer", "ground_truth_answer", "correct_answer", "gold_answer", "ground_truth")
ANSWER_PATTERNS = (r"(?i)FINAL ANSWER\s*:\s*([^\n]+)", r"(?i)final answer is\s*:?\s*([^\n]+)")
#: Where payloads of each data set keep the final answer, and the two forms of one inside a quote.
GAIA_ANSWER = ("$.spans[0].child_spans[1].child_spans[1].span_attributes['smolagents.managed_agents.0.name']", "search_agent", "$.spans[0].child_spans[1].child_spans[1].span_attributes['output.value']")
SWE_ANSWER = "$.spans[0].logs[0].body['function.output']"
GHOST_ANSWER = "$.output.response"
QUOTE_PATTERNS = (r"(?i)FINAL\s+ANSWER\s*:\s*([^\n\r]+)", r"(?i)final_answer\s*[:=]\s*['\"]?([^'\"\n\r]+)")


def answer_key(x: Column) -> Column:
    """Lower case, white space collapsed, quotes and a final full stop gone."""
    t = F.lower(F.regexp_replace(stripped(F.coalesce(x.cast("string"), F.lit(""))), r"(?U)\s+", " "))
    return stripped(F.regexp_replace(t, r"""^["'`]+|["'`.]+$""", ""))


def answers_match(a: Column, b: Column) -> Column:
    """Equal as text, or as numbers (thousands' commas ignored)."""
    number = lambda x: F.replace(x, F.lit(","), F.lit("")).try_cast("double")
    x, y = answer_key(a), answer_key(b)
    return (x == y) | F.coalesce(number(x) == number(y), F.lit(False))


def extracted_answer(text: Column) -> Column:
    """The last line marked as a final answer, else null."""
    found = [F.try_element_at(F.regexp_extract_all(text, F.lit(p), F.lit(1)), F.lit(-1)) for p in ANSWER_PATTERNS]
    return present(stripped(F.coalesce(*found)))


def final_answer(payload: Column, dataset: Column) -> Column:
    """The final answer that a trace payload states, by data set: trail_gaia, trail_swe, ghost, who_and_when or aegis.

    Null where the payload has none, is no JSON, or the data set is another. who_and_when: the line after the mark in the last
    message that has it; an empty line there is no answer. aegis: the final output, else the last message with content.
    """
    key, owner, value = GAIA_ANSWER
    gaia = F.when(F.get_json_object(payload, key) == owner, F.get_json_object(payload, value))
    said = lambda path: F.transform(F.from_json(F.get_json_object(payload, path), "array<struct<content string>>"), lambda m: m["content"])
    marked = F.try_element_at(F.filter(F.coalesce(said("$.history"), said("$")), lambda c: F.contains(c, F.lit("FINAL ANSWER:"))), F.lit(-1))
    line = present(stripped(F.regexp_extract(marked, r"(?s)^.*?FINAL ANSWER:([^\n\r]*)", 1)))
    spoken = F.try_element_at(F.filter(said("$.input.conversation_history"), lambda c: c != ""), F.lit(-1))
    aegis = F.coalesce(F.nullif(F.get_json_object(payload, "$.input.final_output"), F.lit("")), spoken)
    return (
        F.when(dataset == "trail_gaia", gaia).when(dataset == "trail_swe", F.get_json_object(payload, SWE_ANSWER)).when(dataset == "ghost", F.get_json_object(payload, GHOST_ANSWER))
        .when(dataset == "who_and_when", line).when(dataset == "aegis", aegis)
    )


def answers_in_quotes(citations: DataFrame) -> DataFrame:
    """citations(trace_id, metric_ord, finding_index, evidence_index, quote): the first final answer that a trace's quotes
    hold, in the order of metrics, findings and evidence. Traces without one have no row."""
    found = F.coalesce(*[F.nullif(F.regexp_extract("quote", p, 1), F.lit("")) for p in QUOTE_PATTERNS])
    hit = citations.select("trace_id", F.struct("metric_ord", "finding_index", "evidence_index").alias("at"), F.regexp_replace(stripped(found), r"""^["'`]+|["'`]+$""", "").alias("answer")).where("answer IS NOT NULL")
    return hit.groupBy("trace_id").agg(F.min_by("answer", "at").alias("answer"))


def inferred(payload: Column, keys: tuple, fallback: Column | None = None) -> Column:
    """The first key of a JSON payload with a value, else the fallback."""
    values = [clean_scalar(F.get_json_object(payload, f"$.{k}")) for k in keys]
    return F.coalesce(*values, *([fallback] if fallback is not None else []))


def answer_status(rows: DataFrame) -> DataFrame:
    """rows(trace_id, predicted, reference, …) with answer_verdict correct / incorrect / unknown and verification_mode."""
    p, r = clean_scalar(F.col("predicted")), clean_scalar(F.col("reference"))
    verdict = F.when(p.isNull() | r.isNull(), "unknown").when(answers_match(p, r), "correct").otherwise("incorrect")
    mode = F.when(r.isNotNull(), "reference_based").when(p.isNotNull(), "trace_grounded").otherwise("unavailable")
    return rows.withColumn("answer_verdict", verdict).withColumn("verification_mode", mode)


def routed(rows: DataFrame) -> DataFrame:
    """rows(dataset, extracted, gold) with method, verdict and confidence: direct comparison where both are known and equal;
    else the rows that an external judge has to settle, whose verdict is null."""
    known = clean_scalar(F.col("extracted")).isNotNull() & clean_scalar(F.col("gold")).isNotNull()
    method = F.when(F.col("dataset").isNull(), None).when(~known, "completion_judge").when(answers_match(F.col("extracted"), F.col("gold")), "direct_comp").otherwise("equivalence_judge")
    settled = F.col("method") == "direct_comp"
    return rows.withColumn("method", method).withColumn("verdict", F.when(settled, "ideal")).withColumn("confidence", F.when(settled, "high"))


def completion_verdict(findings: DataFrame) -> DataFrame:
    """A completion judge's findings(trace_id, finding_index, confidence; index null for none): poor with the first
    finding's confidence, ideal and high without any."""
    first = findings.groupBy("trace_id").agg(F.count("finding_index").alias("n"), F.min_by("confidence", "finding_index").alias("c"))
    return first.select("trace_id", F.when(F.col("n") > 0, "poor").otherwise("ideal").alias("verdict"), F.when(F.col("n") > 0, F.coalesce("c", F.lit("medium"))).otherwise("high").alias("confidence"))


def equivalence_verdict(assertion: Column, score: Column) -> tuple[Column, Column]:
    """(verdict, confidence) of an equivalence judge: its assertion, else a score from 0.5 on. Without a score the confidence is
    high; with neither, the verdict is poor."""
    s = F.when(score.isNotNull(), F.least(F.greatest(score, F.lit(0.0)), F.lit(1.0)))
    same = F.coalesce(assertion, s >= 0.5, F.lit(False))
    sure = F.when(same, s).otherwise(1 - s)
    return F.when(same, "ideal").otherwise("poor"), F.when(s.isNull() | (sure >= 0.8), "high").when(sure >= 0.5, "medium").otherwise("low")


def last_marked_message(messages: DataFrame, mark: str = "FINAL ANSWER") -> DataFrame:
    """messages(trace_id, ord, content): the answer in the last message that has the mark."""
    hit = messages.where(F.contains(F.upper("content"), F.lit(mark)))
    return hit.groupBy("trace_id").agg(F.max_by("content", "ord").alias("content")).select("trace_id", extracted_answer(F.col("content")).alias("extracted"))


def backfilled(rows: DataFrame, fresh: DataFrame) -> DataFrame:
    """rows(trace_id, verdict, …) with verdicts of fresh(trace_id, verdict) where they have none."""
    new = fresh.select("trace_id", F.col("verdict").alias("_new"))
    return rows.join(new, "trace_id", "left").withColumn("verdict", F.coalesce("verdict", "_new")).drop("_new")
