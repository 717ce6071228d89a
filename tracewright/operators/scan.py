"""The rule scan: spans in, findings out, without a shuffle.

Spans are (trace_id, ord, idx, text, agent, kind, parent); idx is unique within a trace. Every rule is a literal
expression, so its pattern is compiled once a task and tried only on texts that hold one of the strings it cannot match
without (plain searches in the folded text, which prose mostly ends at). A span's overlapping findings are settled in an array of that span, since only findings of one span can overlap.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import rules
from ..functions.text import first_match, quote_around, severity

HIT = "struct<v:int,c:int,r:int,m_start:int,m_end:int>"


def folded(text: Column) -> Column:
    """text so that whatever matches a letter without regard to case holds its lower-case form: beside lower case, the long s,
    the dotless i, and the dot that a capital i with one leaves."""
    low = F.lower(text)
    for odd, plain in (("\u017f", "s"), ("\u0131", "i"), ("\u0307", "")):
        low = F.replace(low, F.lit(odd), F.lit(plain))
    return low


def _may_match(low: Column, pattern: str) -> Column:
    """Whether the folded text holds a string that the pattern needs."""
    need = rules.needles(pattern)
    return reduce(or_, [F.contains(low, F.lit(x)) for x in sorted(need)]) if need else F.lit(True)


def _hit(text: Column, low: Column, v: int, c: int, r: int, pattern: str | None, cue: str | None, most: int | None) -> Column:
    """struct HIT of one rule, or null."""
    head = [F.lit(v).alias("v"), F.lit(c).alias("c"), F.lit(r).alias("r")]
    if pattern is None:
        whole = F.try_parse_json(F.regexp_replace(text, r"^\s+", ""))
        broken = text.rlike(rules.JSON_LIKE) & whole.isNull()
        if most is not None:
            # A text as long as the cap may have been cut, so it is not judged.
            broken = broken & (F.length(text) < most)
        return F.when(broken, F.struct(*head, F.lit(None).cast("int").alias("m_start"), F.lit(None).cast("int").alias("m_end")))
    found, start, end = first_match(text, rules.flagged(pattern))
    cond = _may_match(low, pattern) & text.rlike(rules.flagged(pattern))
    if cue:
        cond = cond & text.rlike(rules.flagged(cue))
    return F.when(cond, F.struct(*head, start.alias("m_start"), end.alias("m_end")))


def _check(text: Column, low: Column, c: int, check: tuple, most: int | None) -> Column:
    """array<HIT> of one check, in rule order."""
    validator, _, one_per_span, rows = check
    v = rules.VALIDATORS.index(validator)
    by_type: dict[str, list[Column]] = {}
    for r, (pattern, failure_type, cue) in enumerate(rows):
        by_type.setdefault("" if one_per_span else failure_type, []).append(_hit(text, low, v, c, r, pattern, cue, most))
    hits = F.array_compact(F.array(*[F.coalesce(*h) for h in by_type.values()]))
    words = _words(check)
    if words is None:
        return hits
    return F.when(F.col("_any") & low.rlike(rules.any_of(words)), hits).otherwise(F.array().cast(f"array<{HIT}>"))


def _words(check: tuple) -> frozenset | None:
    """Strings one of which is in every folded text that the check has a hit in; null if that cannot be said."""
    need = [rules.needles(pattern) if pattern else None for pattern, _, _ in check[3]]
    return frozenset().union(*need) if all(need) else None


def without_overlaps(hits: Column) -> Column:
    """Hits in order, less those that overlap a kept hit of another validator; hits without offsets stay."""

    def step(kept: Column, h: Column) -> Column:
        clash = F.exists(kept, lambda k: (k["v"] != h["v"]) & (h["m_start"] < k["m_end"]) & (k["m_start"] < h["m_end"]))
        return F.when(F.coalesce(clash, F.lit(False)), kept).otherwise(F.array_append(kept, h))

    return F.aggregate(hits, F.array().cast(f"array<{HIT}>"), step)


def scan(spans: DataFrame, suppress: bool = True, checks: tuple | None = None, keep: tuple = (), most: int | None = rules.MAX_SPAN_TEXT) -> DataFrame:
    """One row a finding: trace_id, ord, idx, agent, kind, validator, metric_name, failure_type, severity, m_start, m_end,
    quote and the order columns v, c, r. suppress: drop overlaps between validators. checks: names, else all. keep: more columns
    of spans to carry. most: characters of a span that are scanned; None for all of them."""
    text = F.coalesce("text", F.lit(""))
    if most is not None:
        text = F.left(text, F.lit(most))
    chosen = [(c, check) for c, check in enumerate(rules.CHECKS) if checks is None or check[1] in checks]
    rows = spans.withColumn("text", text).where("text <> ''").withColumn("_low", folded(F.col("text")))
    body, low = F.col("text"), F.col("_low")
    # One search for all strings of all checks, which most texts end at.
    words = frozenset().union(*[_words(check) or () for _, check in chosen])
    rows = rows.withColumn("_any", low.rlike(rules.any_of(words)) if words else F.lit(True))
    hits = F.flatten(F.array(*[_check(body, low, c, check, most) for c, check in chosen]))
    # An inner explode, or a filter on the hits, would make Spark work them out twice: once for the filter that it pushes down.
    found = rows.withColumn("hits", without_overlaps(hits) if suppress else hits).select("*", F.explode_outer("hits").alias("h")).where("h IS NOT NULL")
    names = F.array(*[F.lit(check[1]) for check in rules.CHECKS])
    types = F.array(*[F.array(*[F.lit(r[1]) for r in check[3]]) for check in rules.CHECKS])
    h, signal = F.col("h"), rules.flagged(rules.ERROR_SIGNAL)
    _, s_start, s_end = first_match(body, signal)
    anchor = F.when(body.rlike(signal), quote_around(body, s_start, s_end)).otherwise(F.left(body, F.lit(rules.QUOTE_FALLBACK)))
    failure = F.get(F.get(types, h["c"]), h["r"])
    return found.select(
        "trace_id", "ord", "idx", "agent", "kind", *keep, h["v"].alias("v"), h["c"].alias("c"), h["r"].alias("r"),
        F.get(F.array(*map(F.lit, rules.VALIDATORS)), h["v"]).alias("validator"), F.get(names, h["c"]).alias("metric_name"),
        failure.alias("failure_type"), severity(failure).alias("severity"), h["m_start"].alias("m_start"), h["m_end"].alias("m_end"),
        F.when(h["m_start"].isNull(), anchor).otherwise(quote_around(body, h["m_start"], h["m_end"])).alias("quote"),
    )


def explanation(failure_type: Column) -> Column:
    """A sentence for a failure type, made from its words."""
    return F.concat(F.lit("The span text reports: "), F.replace(failure_type, F.lit("_"), F.lit(" ")), F.lit("."))
