"""Gold annotations and payloads: readers, alias resolution and writers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import as_list, clean_scalar, distinct_ignoring_case

#: Names under which annotations keep agents, steps and ids, in order of precedence, and wrappers' keys.
AGENT_COLUMNS = (
    "mistake_agent", "mistake_agents", "culprit_agent", "culprit_agents", "problematic_agent", "problematic_agents",
    "gold_agent", "gold_agents", "annotated_agent", "annotated_agents", "agent", "agents",
)
STEP_COLUMNS = (
    "mistake_step", "mistake_steps", "mistake_span", "mistake_spans", "problematic_step", "problematic_steps",
    "problematic_span", "problematic_spans", "problematic_idx", "problematic_idxs", "gold_step", "gold_steps", "gold_span",
    "gold_spans", "gold_idx", "gold_idxs", "annotated_step", "annotated_steps", "annotated_span", "annotated_spans",
    "annotated_idx", "annotated_idxs", "step_id", "step_ids", "span_id", "span_ids", "idx", "idxs", "idx_id", "idx_ids",
)
ID_COLUMNS = ("trace_id", "sample_id", "task_id", "trajectory_id", "conversation_id", "name", "id", "index", "row_id")
WRAPPERS = ("annotations", "data", "rows", "examples")
ENCODINGS = ("utf-8", "windows-1251", "windows-1252")
DELIMITERS = (",", "\t", ";", "|")


def sniffed(head: str) -> str:
    """The delimiter whose count on the first line is greatest."""
    line = head.split("\n", 1)[0]
    return max(DELIMITERS, key=line.count)


def read_annotations(spark: SparkSession, path: str) -> DataFrame:
    """Annotations in JSON lines, JSON (a list, a wrapped list or one object), parquet, CSV or TSV, with row_index."""
    kind = path.rsplit(".", 1)[-1].lower()
    if kind in ("jsonl", "ndjson"):
        # Lines that are no JSON object are dropped.
        return numbered(spark.read.option("mode", "DROPMALFORMED").json(path))
    if kind == "json":
        rows = spark.read.option("multiLine", True).json(path)
        for w in WRAPPERS:
            if w in rows.columns and rows.schema[w].dataType.typeName() == "array":
                return numbered(rows.select(F.explode(w).alias("x")).select("x.*"))
        return numbered(rows)
    if kind == "parquet":
        return numbered(spark.read.parquet(path))
    if kind in ("csv", "tsv", "txt"):
        head = spark.read.format("binaryFile").load(path).select(F.substring("content", 1, 4096)).first()[0]
        text, encoding = next((head.decode(e, "strict"), e) for e in (*ENCODINGS, "iso-8859-1") if decodes(head, e))
        if encoding.startswith("windows"):
            # Spark 4 reads such charsets only when the session allows Java's own.
            spark.conf.set("spark.sql.legacy.javaCharsets", "true")
        return numbered(spark.read.option("header", True).option("multiLine", True).option("encoding", encoding).option("sep", sniffed(text.lstrip("\ufeff"))).csv(path))
    raise ValueError(f"no reader for .{kind}")


def decodes(head: bytes, encoding: str) -> bool:
    """Whether the bytes read in this encoding, but for a character cut at the end."""
    try:
        head[:-4].decode(encoding)
        head.decode(encoding)
    except UnicodeDecodeError as e:
        return e.start >= len(head) - 4 and encoding == "utf-8" and len(head) == 4096
    return True


def numbered(rows: DataFrame) -> DataFrame:
    """rows with row_index in file order. An annotation file is small next to the traces; it is numbered without a shuffle of
    its rows: partitions in order, then positions."""
    if "row_index" in rows.columns:
        return rows
    tagged = rows.withColumn("_p", F.spark_partition_id()).withColumn("_at", F.monotonically_increasing_id())
    sizes = tagged.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_at").alias("_first"))
    before = Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_p", "_first", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return tagged.join(F.broadcast(starts), "_p").withColumn("row_index", F.col("_at") - F.col("_first") + F.col("_before")).drop("_p", "_at", "_first", "_before")


def _values(rows: DataFrame, names: tuple) -> Column:
    """All values of the columns that are there, as one list without repeats."""
    have = {c.lower(): c for c in rows.columns}
    parts = []
    for n in names:
        if n in have:
            kind = rows.schema[have[n]].dataType.typeName()
            parts.append(F.transform(F.col(have[n]).cast("array<string>"), clean_scalar) if kind == "array" else as_list(F.col(have[n]).cast("string")))
    flat = F.flatten(F.array(*[F.coalesce(p, F.array().cast("array<string>")) for p in parts])) if parts else F.array().cast("array<string>")
    return distinct_ignoring_case(F.array_compact(flat))


def normalised(rows: DataFrame, id_column: str | None = None) -> DataFrame:
    """row_index, example_id, gold_agents, gold_idxs and the id columns that are there."""
    ids = [c for c in ([id_column] if id_column else ID_COLUMNS) if c in rows.columns]
    example = F.coalesce(*[clean_scalar(F.col(c)) for c in ids], F.col("row_index").cast("string"))
    keep = [c for c in ID_COLUMNS if c in rows.columns]
    return rows.select("row_index", example.alias("example_id"), _values(rows, AGENT_COLUMNS).alias("gold_agents"), _values(rows, STEP_COLUMNS).alias("gold_idxs"), *[F.col(c).cast("string").alias(c) for c in keep])


def write_json(rows: DataFrame, path: str, by: list[str] | None = None) -> None:
    """JSON lines; NaN and infinities as null, nulls kept."""
    for name, kind in rows.dtypes:
        if kind in ("double", "float"):
            rows = rows.withColumn(name, F.when(~F.isnan(name) & (F.abs(F.col(name)) != float("inf")), F.col(name)))
    writer = rows.write.option("ignoreNullFields", False)
    (writer.partitionBy(*by) if by else writer).json(path)


def write_csv(rows: DataFrame, path: str, first: list[str]) -> None:
    """CSV with a header; the named columns come first."""
    order = [c for c in first if c in rows.columns] + [c for c in rows.columns if c not in first]
    rows.select(*order).write.option("header", True).csv(path)


def not_written(rows: DataFrame, written: DataFrame, key: str = "trace_id") -> DataFrame:
    """rows whose key an earlier run has not written."""
    return rows.join(written.select(key).distinct(), key, "left_anti")


def write_markdown(rows: DataFrame, path: str) -> None:
    """A report table of any size as Markdown: text files of whole tables, one a partition, each with the heading; rows keep
    their partitions' order. Numbers with a fraction have three places, bars and line ends in texts are escaped."""

    def cell(name: str, kind: str) -> Column:
        c = F.col(f"`{name}`")
        text = F.format_string("%.3f", c.cast("double")) if kind in ("double", "float") or kind.startswith("decimal") else c.cast("string")
        return F.coalesce(F.when(c.isNotNull(), F.replace(F.replace(text, F.lit("|"), F.lit("\\|")), F.lit("\n"), F.lit(" "))), F.lit(""))

    heading = f"| {' | '.join(rows.columns)} |\n|{'---|' * len(rows.columns)}\n"
    line = F.concat(F.lit("| "), F.concat_ws(" | ", *[cell(n, k) for n, k in rows.dtypes]), F.lit(" |"))
    # The lower 33 bits count a partition's rows.
    is_first = F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)) == 0
    rows.select(F.when(is_first, F.concat(F.lit(heading), line)).otherwise(line).alias("value")).write.text(path)


def markdown_table(rows: DataFrame, most: int = 500) -> str:
    """A small report table for people, as one text. More than `most` rows are an error: such a table is not held by the driver
    but written, by write_markdown."""
    got = rows.limit(most + 1).collect()
    if len(got) > most:
        raise ValueError(f"more than {most} rows; write them with write_markdown")
    cell = lambda v: "" if v is None else f"{v:.3f}" if isinstance(v, float) else str(v).replace("|", "\\|").replace("\n", " ")
    lines = [f"| {' | '.join(rows.columns)} |", f"|{'---|' * len(rows.columns)}"]
    return "\n".join(lines + [f"| {' | '.join(map(cell, r))} |" for r in got])
