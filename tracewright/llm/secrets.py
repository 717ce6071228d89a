"""Secret scans over an incremental blob ledger, in DataFrame functions only.

Every version of every path is content-addressed by the SHA-256 of its text. A ledger holds the pairs (blob, rule
version) that were scanned, with their findings. A scan takes the distinct blobs whose pair is not in the ledger, finds
the spans, and joins all findings back to every path that holds the blob.

Defined cases: a null text counts as empty; an empty text has no spans; equal texts are scanned once and have equal
results; repeated rows stay repeated; an empty table gives an empty result; other columns of the input are ignored.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import hot_keys, salted_left_join, scratch, spread_left_join, stored

#: Kinds in the order that breaks ties of equal starts: name, pattern, and the group whose length must reach `least`.
#: `[0-9a-f]{16,}` finds what greedy `[0-9a-f]+` finds less the runs under 16, and likewise AKIA: a run that is too short
#: holds no longer one. That is not so for assignments, which are matched first and dropped afterwards.
BASE_RULES = (
    (
        "assign",
        r"""([Pp][Aa][Ss][Ss][Ww][Oo][Rr][Dd]|[Pp][Aa][Ss][Ss][Ww][Dd]|[Ss][Ee][Cc][Rr][Ee][Tt]|[Tt][Oo][Kk][Ee][Nn]|[Aa][Pp][Ii]_?[Kk][Ee][Yy])["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""",
        2,
        12,
    ),
    ("access", r"AKIA[A-Z0-9]{14,}", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
MORE_RULES = (
    ("private_key", r"-----BEGIN [A-Z ]{0,20}PRIVATE KEY-----", 0, 1),
    ("jwt", r"eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}", 0, 1),
    ("forge_token", r"gh[pousr]_[A-Za-z0-9]{36,}", 0, 1),
    ("chat_token", r"xox[abprs]-[A-Za-z0-9-]{10,}", 0, 1),
)
RULES = BASE_RULES + MORE_RULES
RULE_VERSION = "2024-1"
#: A text that has any finding matches this.
PREFILTER = "|".join([BASE_RULES[0][1].rpartition(r"\x20*[")[0], *(p for _, p, _, _ in RULES[1:])])


SPAN = "array<struct<start:int,k:int,end:int>>"
#: Running sums are taken within runs of so many elements, so that they cost little more than one step an element.
RUN = 128


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """use(value), where value is worked out once, however often `use` names it."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(xs: Column, join: Callable[[Column, Column], Column]) -> Column:
    """The running total of an integer array under `join` (a sum or a maximum of numbers from 0), the own element included."""
    zero = F.lit(0)
    total = lambda ys: F.aggregate(ys, zero, join)
    runs = lambda ys: F.transform(F.sequence(zero, F.floor(F.size(ys) / RUN).cast("int")), lambda r: total(F.slice(ys, r * RUN + 1, RUN)))
    before = lambda rs: F.transform(rs, lambda r, i: total(F.slice(rs, 1, i)))

    def within(ys: Column, firsts: Column) -> Column:
        of = lambda i: F.floor(i / RUN).cast("int")
        return F.transform(ys, lambda x, i: join(F.get(firsts, of(i)), total(F.slice(ys, of(i) * RUN + 1, i - of(i) * RUN + 1))))

    return bound(xs, lambda ys: bound(runs(ys), lambda rs: bound(before(rs), lambda firsts: within(ys, firsts))))


def kind_spans(text: Column, k: int, rules: tuple = RULES) -> Column:
    """array<struct<start,k,end>> of rule k: leftmost non-overlapping matches, code points, end exclusive.

    The text between matches comes from split(), the matches from regexp_extract_all(), so running sums of lengths are offsets.
    """
    _, pattern, group, least = rules[k]
    sizes = lambda xs: F.transform(xs, lambda x: F.length(x))
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    hits = sizes(found)
    valued = sizes(F.regexp_extract_all(text, F.lit(pattern), F.lit(group))) if group else hits
    gaps = sizes(F.split(text, pattern, -1))

    def spans(x: Column) -> Column:
        steps = F.zip_with(x["hits"], F.slice(x["gaps"], 1, F.size(x["hits"])), lambda h, g: h + g)
        ends = running(steps, lambda a, b: a + b)
        each = F.zip_with(F.arrays_zip(ends.alias("e"), x["hits"].alias("h")), x["valued"], lambda s, v: F.struct((s["e"] - s["h"]).alias("start"), F.lit(k).alias("k"), s["e"].alias("end"), v.alias("v")))
        return F.transform(F.filter(each, lambda s: s["v"] >= least), lambda s: F.struct(s["start"], s["k"], s["end"]))

    return bound(F.struct(hits.alias("hits"), valued.alias("valued"), gaps.alias("gaps")), spans)


def unseen_blobs(paths: DataFrame, ledger: DataFrame | None, rule_version: str) -> DataFrame:
    """One row for each distinct (blob, rule_version) of paths(blob, text) that the ledger does not hold. Copies are merged
    first, map-side, so that a blob of many paths is one row in the join."""
    blobs = paths.dropDuplicates(["blob"])
    if ledger is None:
        return blobs
    return blobs.join(ledger.where(F.col("rule_version") == rule_version).select("blob"), "blob", "left_anti")


def scan_blobs(blobs: DataFrame, rules: tuple = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """Ledger rows (blob, rule_version, spans) of blobs(blob, text)."""
    text = F.col("text")
    spans = F.when(text.rlike(PREFILTER) if rules is RULES else F.lit(True), F.array_sort(F.flatten(F.array(*[kind_spans(text, k, rules) for k in range(len(rules))]))))
    return blobs.select("blob", F.lit(rule_version).alias("rule_version"), F.coalesce(spans, F.array().cast(SPAN)).alias("spans"))


def content_addressed(docs: DataFrame, path: str = "doc_id", text: str = "text") -> DataFrame:
    body = F.coalesce(F.col(text), F.lit(""))
    return docs.select(F.col(path).alias("path"), F.sha2(body, 256).alias("blob"), body.alias("text"))


def found_in(paths: DataFrame, ledger: DataFrame, rule_version: str = RULE_VERSION) -> DataFrame:
    """(path, blob, spans) for every row of paths(path, blob), from the ledger; spans are empty where it has none."""
    dirty = ledger.where((F.col("rule_version") == rule_version) & (F.size("spans") > 0)).select("blob", "spans")
    joined = salted_left_join(paths.select("path", "blob"), dirty, "blob")
    return joined.withColumn("spans", F.coalesce("spans", F.array().cast(SPAN)))


def find_secrets(docs: DataFrame, ledger: DataFrame | None = None, rules: tuple = RULES, rule_version: str = RULE_VERSION) -> tuple[DataFrame, DataFrame]:
    """(findings, new ledger rows): findings has (path, blob, spans) for every row of docs, spans empty where clean.

    Append the second to the ledger; a later call with it scans only what is new.
    """
    paths = content_addressed(docs)
    fresh = scan_blobs(unseen_blobs(paths, ledger, rule_version).select("blob", "text"), rules, rule_version)
    known = fresh if ledger is None else fresh.unionByName(ledger.select(*fresh.columns))
    return found_in(paths, known, rule_version), fresh


def ingested(docs: DataFrame, where: str | None = None, batches: int = 2, rules: tuple = RULES, rule_version: str = RULE_VERSION) -> DataFrame:
    """The ledger table at `where` after all of docs went through it, batch by batch: each batch is joined to the pairs that are
    stored, scans the blobs that none has, and appends them. The table is made if it is not there."""
    spark = docs.sparkSession
    where = where or f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    schema = f"blob string, rule_version string, spans {SPAN}"
    spark.createDataFrame([], schema).write.mode("append").parquet(where)
    batch = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(batches))
    for i in range(batches):
        ledger = spark.read.schema(schema).parquet(where)
        scan_blobs(unseen_blobs(content_addressed(docs.where(batch == i)), ledger, rule_version).select("blob", "text"), rules, rule_version).write.mode("append").parquet(where)
    return spark.read.schema(schema).parquet(where)


def spelled(spans: Column, rules: tuple = RULES) -> Column:
    """kind:start:end of each span, joined by commas."""
    names = F.array(*[F.lit(r[0]) for r in rules])
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", F.get(names, s["k"]), s["start"], s["end"])), ",")


def secrets_report(docs: DataFrame, ledger: DataFrame | None = None) -> DataFrame:
    """doc_id, counts of the base kinds, a digest of the base spans, and all spans. ledger: one that holds all of docs' blobs,
    as ingested() gives; without it, all are scanned."""
    found = find_secrets(docs)[0] if ledger is None else found_in(content_addressed(docs), ledger)
    spans = F.col("spans")
    of = lambda k: F.size(F.filter(spans, lambda s: s["k"] == k)).cast("long")
    base = F.filter(spans, lambda s: s["k"] < len(BASE_RULES))
    return found.select(
        F.col("path").alias("doc_id"), of(0).alias("n_assign"), of(1).alias("n_access"), of(2).alias("n_hex"),
        F.sha2(spelled(base), 256).alias("base_sha256"), spelled(spans).alias("spans"),
    )


#: Texts are cut into pieces of so many characters, so that a part of one is found without counting from the text's start.
PIECE = 4096


def part_of(pieces: Column, begin: Column, end: Column) -> Column:
    """Characters [begin, end) of a text that was cut into pieces of PIECE characters."""
    first = F.floor(begin / PIECE).cast("int")
    n = F.greatest(F.floor((end - 1) / PIECE).cast("int") - first + 1, F.lit(0))

    def inside(x: Column, i: Column) -> Column:
        low = F.greatest(begin - (first + i) * PIECE, F.lit(0))
        return x.substr(low + 1, F.least(end - (first + i) * PIECE, F.lit(PIECE)) - low)

    return F.when(begin < end, F.array_join(F.transform(F.slice(pieces, first + 1, n), inside), "")).otherwise("")


def without_spans(text: Column, spans: Column, mark: str) -> Column:
    """text with each run of overlapping spans (sorted by start) replaced by the mark."""

    def cleaned(x: Column) -> Column:
        fresh = F.filter(F.transform(x["spans"], lambda s, i: F.struct(s["start"].alias("start"), F.when(i > 0, F.get(x["ends"], i - 1)).otherwise(0).alias("done"))), lambda s: s["start"] >= s["done"])
        kept = F.transform(fresh, lambda s: F.concat(part_of(x["pieces"], s["done"], s["start"]), F.lit(mark)))
        return F.concat(F.array_join(kept, ""), part_of(x["pieces"], F.element_at(x["ends"], -1), x["n"]))

    ends = running(F.transform(spans, lambda s: s["end"]), lambda a, b: F.greatest(a, b))
    pieces = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))
    return bound(F.struct(spans.alias("spans"), ends.alias("ends"), pieces.alias("pieces"), F.length(text).alias("n")), cleaned)


def redacted(docs: DataFrame, mark: str = "[SECRET]", ledger: DataFrame | None = None) -> DataFrame:
    """docs with every found span replaced by the mark; n_chars follows. Overlapping spans give one mark. All rows stay.

    ledger: one that holds all of docs' blobs, as ingested() gives; without it, all are scanned. Texts are joined to the dirty
    blobs alone, and a blob of many rows is spread.
    """
    ledger = ingested(docs, batches=1) if ledger is None else ledger
    found = found_in(content_addressed(docs), ledger).where(F.size("spans") > 0)
    own = max(docs.columns, key=len)  # longer names than any of docs' columns cannot clash
    blob, spans = f"{own}_blob", F.col(f"{own}_spans")
    dirty = stored(found.groupBy("blob").agg(F.first("spans").alias("spans"), F.count(F.lit(1)).alias("_n")).toDF(blob, f"{own}_spans", "_n"), "dirty")
    rows = dirty.agg(F.sum("_n")).first()[0] or 0
    alias = {c: f"{own}_{i}" for i, c in enumerate(docs.columns)}  # such names as the join uses may be among docs' columns
    named = docs.select(*[F.col(c).alias(a) for c, a in alias.items()], F.sha2(F.coalesce("text", F.lit("")), 256).alias(blob))
    joined = spread_left_join(named, dirty.drop("_n"), blob, hot_keys(dirty, blob, rows))
    text = F.col(alias["text"])
    new = {"text": F.when(spans.isNull(), text).otherwise(without_spans(text, spans, mark))}
    if "n_chars" in docs.columns:
        new["n_chars"] = F.when(spans.isNull(), F.col(alias["n_chars"])).otherwise(F.length(new["text"]).cast("long"))
    return joined.select(*[new.get(c, F.col(a)).alias(c) for c, a in alias.items()])
