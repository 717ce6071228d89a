"""Scalar normalisers as Column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import rules

#: What counts as no value in annotations, observations and chat roles that are no agents' names.
NULL_STRINGS = ("", "none", "null", "nan", "n/a", "na", "-")
OBSERVATION_ROLES = "^(chat |running |generation)"
CHAT_ROLES = ("system", "user", "assistant", "tool", "tool-call", "tool-response", "tool_call", "tool_response", "human")


def bound(x: Column, f: Callable[[Column], Column]) -> Column:
    """f of x, with x worked out once a row: inside a lambda Spark works an expression out anew each time that it is named."""
    return F.get(F.transform(F.array(x), f), F.lit(0))


def stripped(x: Column) -> Column:
    """Without white space of any kind at either end (Spark's trim drops blanks only)."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def present(x: Column) -> Column:
    """x, or null where it is empty."""
    return F.nullif(x, F.lit(""))


def role_agent(role: Column) -> Column:
    """The agent that a native role names: cut at the first bracket; null for chat roles."""
    base = stripped(F.regexp_replace(role, r"(?s)\s*\(.*", ""))
    return F.when((base != "") & ~F.lower(base).isin(*CHAT_ROLES), base)


def observation_agent(name: Column) -> Column:
    """An observation's agent: cut at ` run`; null for generations and tool runners."""
    base = stripped(F.regexp_replace(name, r"(?s)\s+run\b.*", ""))
    return F.when((base != "") & ~F.lower(base).rlike(OBSERVATION_ROLES), base)


def severity(failure_type: Column) -> Column:
    """minor if a hint is a whole underscore-parted segment of the failure type, else major."""
    padded = F.concat(F.lit("_"), F.lower(F.coalesce(failure_type, F.lit(""))), F.lit("_"))
    return F.when(padded.rlike("_(" + "|".join(rules.MINOR_HINTS) + ")_"), "minor").otherwise("major")


def quote_key(quote: Column) -> Column:
    """White space collapsed, ends trimmed, lower case, 120 characters."""
    return F.left(F.lower(F.trim(F.regexp_replace(quote, r"(?U)\s+", " "))), F.lit(120))


def quote_around(text: Column, start: Column, end: Column) -> Column:
    """The match with QUOTE_RADIUS characters to either side."""
    begin = F.greatest(start - rules.QUOTE_RADIUS, F.lit(0))
    return text.substr(begin + 1, end + rules.QUOTE_RADIUS - begin)


def first_match(text: Column, pattern: str) -> tuple[Column, Column, Column]:
    """(match, start, end) of the first match, in code points; the match is empty where there is none.

    What split() leaves before its first cut is the text before the match, so no offset in UTF-16 units is involved.
    """
    found = F.regexp_extract(text, pattern, 0)
    start = F.length(F.get(F.split(text, pattern, 2), F.lit(0)))
    return found, start, start + F.length(found)


def decoded_runs(x: Column) -> Column:
    r"""Left-over runs of \uXXXX decoded, doubly escaped ones too; surrogates go."""
    run = r"(?:\\u[0-9a-fA-F]{4})+"
    text = F.replace(x, F.lit("\\\\u"), F.lit("\\u"))
    plain = lambda r: F.from_json(F.concat(F.lit('["'), F.regexp_replace(r, r"\\u[dD][89a-fA-F][0-9a-fA-F]{2}", ""), F.lit('"]')), "array<string>")[0]
    parts = F.zip_with(F.split(text, run), F.regexp_extract_all(text, F.lit(run), F.lit(0)), lambda a, r: F.concat(a, F.coalesce(plain(r), F.lit(""))))
    return F.array_join(parts, "")


def matching_text(x: Column) -> Column:
    """Escaped newlines and quotes undone, white space collapsed and trimmed: how quotes are looked up."""
    plain = F.replace(F.replace(F.coalesce(x, F.lit("")), F.lit("\\n"), F.lit(" ")), F.lit('\\"'), F.lit('"'))
    return F.trim(F.regexp_replace(plain, r"(?U)\s+", " "))


def agent_key(x: Column) -> Column:
    """Lower-case ASCII letters and digits only."""
    return F.regexp_replace(F.lower(F.coalesce(x, F.lit(""))), "[^a-z0-9]", "")


def idx_key(x: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(clean_scalar(x), F.lit(""))), r"(?U)\s+", "")


def last_number(x: Column) -> Column:
    """The last run of digits as a number; null where there is none or it does not fit."""
    return F.try_element_at(F.regexp_extract_all(x, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("long")


def clean_scalar(x: Column) -> Column:
    """Trimmed, or null for the null vocabulary."""
    t = stripped(x.cast("string"))
    return F.when(~F.lower(t).isin(*NULL_STRINGS), t)


def idx_order(idx: Column) -> Column:
    """Sort key: all digits before some digits before none, then the (first) number, then the text."""
    number = F.regexp_extract(idx, r"(\d+)", 1)
    kind = F.when(idx.rlike(r"^\d+$"), 0).when(number != "", 1).otherwise(2)
    return F.struct(kind.alias("kind"), F.coalesce(number.try_cast("decimal(38,0)"), F.lit(0).cast("decimal(38,0)")).alias("number"), idx.alias("text"))


#: Tokens of a literal: strings in either quotes with escapes, words, numbers, brackets and what is between; all else makes it none.
TOKEN = r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|[A-Za-z_]+|[-+]?\d[\d.eE+-]*|[\[\](){},:]|\s+|."""
#: Pieces of a string's body: an escape, or what has none.
PIECE = r"\\x[0-9A-Fa-f]{2}|\\.|[^\\]+"


def _json_string(token: Column) -> Column:
    """A quoted token as a JSON string: escaped apostrophes are plain, inner double quotes escaped."""
    body = F.substring(token, F.lit(2), F.length(token) - 2)
    quote, slash = F.lit('"'), F.lit("\\")

    def piece(x: Column) -> Column:
        mark = F.substring(x, F.lit(2), F.lit(1))
        plain = F.replace(F.replace(x, quote, F.lit('\\"')), F.lit("\t"), F.lit("\\t"))
        escaped = F.when(mark == "'", "'").when(mark == "x", F.concat(F.lit("\\u00"), F.substring(x, F.lit(3), F.lit(2)))).when(mark.isin(*'"\\/bfnrtu'), x).otherwise(F.concat(slash, x))
        return F.when(F.startswith(x, slash), escaped).otherwise(plain)

    return F.concat(quote, F.array_join(F.transform(F.regexp_extract_all(body, F.lit(PIECE), F.lit(0)), piece), ""), quote)


def literal_json(x: Column) -> Column:
    """A JSON or Python literal (strings in either quotes, None, True, False, numbers, lists, tuples, sets, dictionaries) as
    JSON text; null where it is neither. True and False are the texts True and False, as they are in a list of names; of
    Python's escapes, those that JSON lacks stay as they are written.
    """
    tokens = F.filter(F.regexp_extract_all(x, F.lit("(?s)" + TOKEN), F.lit(0)), lambda t: F.trim(F.translate(t, "\n\r\t", "   ")) != "")

    def plain(t: Column) -> Column:
        head = F.left(t, F.lit(1))
        word = F.when(t.isin("None", "null"), "null").when(t.isin("True", "true"), '"True"').when(t.isin("False", "false"), '"False"')
        bracket = F.when(t == "(", "[").when(t == ")", "]").when(t.isin(*"[]{},:"), t)
        return F.when(head.isin("'", '"') & (F.length(t) > 1), _json_string(t)).when(head.rlike("[A-Za-z_]"), word).when(t.rlike(r"^[-+]?\d"), F.regexp_replace(t, r"^\+", "")).otherwise(bracket)

    def closed(ts: Column) -> Column:
        # A comma before a closing bracket says nothing, and braces without a colon are a set.
        kept = F.filter(F.transform(ts, lambda t, i: F.when((t == ",") & F.coalesce(F.get(ts, i + 1).isin("]", "}"), F.lit(False)), "").otherwise(t)), lambda t: t != "")
        joined = F.array_join(kept, "")
        is_set = (F.get(ts, F.lit(0)) == "{") & (F.size(ts) > 2) & ~F.array_contains(ts, ":")
        return F.when(is_set, F.concat(F.lit("["), F.substring(joined, F.lit(2), F.length(joined) - 2), F.lit("]"))).otherwise(joined)

    # A token that is none of these is null, and so is the whole.
    whole = bound(F.transform(tokens, plain), lambda read: F.when(~F.exists(read, lambda t: t.isNull()), closed(read)))
    return bound(whole, lambda w: F.when(F.try_parse_json(w).isNotNull(), w))


def as_list(x: Column) -> Column:
    """A string as a list; null vocabulary dropped. In brackets: the items of a JSON or Python list, tuple or set, inner
    lists as JSON; in braces: a JSON object as one item, as it is written. Else, and where brackets hold no literal, split
    at the first present of `;`, `|` and `,`."""

    def items(t: Column) -> Column:
        text = F.when(t.rlike(r"(?s)^\[.*\]$|^\{.*\}$"), literal_json(t))
        listed = bound(text, lambda w: F.when(F.startswith(w, F.lit("[")), F.from_json(w, "array<string>")).when(w.isNotNull(), F.array(t)))
        cut = F.when(F.contains(t, F.lit(";")), F.split(t, ";")).when(F.contains(t, F.lit("|")), F.split(t, r"\|")).when(F.contains(t, F.lit(",")), F.split(t, ",")).otherwise(F.array(t))
        kept = F.filter(F.transform(F.coalesce(listed, cut), clean_scalar), lambda v: v.isNotNull())
        return F.when(t.isNull(), F.array().cast("array<string>")).otherwise(kept)

    return bound(clean_scalar(x), items)


def distinct_ignoring_case(xs: Column) -> Column:
    """The first of each value without regard to case, in order."""

    def first(ys: Column, keys: Column) -> Column:
        return F.filter(F.transform(ys, lambda x, i: F.when(F.array_position(keys, F.get(keys, i)) == i + 1, x)), lambda x: x.isNotNull())

    return bound(xs, lambda ys: bound(F.transform(ys, F.lower), lambda keys: first(ys, keys)))
