"""What the training-data operators share: inputs, cut lineage, texts in Arrow buffers, hashed words, salted joins."""

from __future__ import annotations

import os
import tempfile
import uuid
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

#: Texts are handled in slices of about so many bytes, so that a task's memory does not follow the Arrow batch.
SLICE_BYTES = 2 << 20
#: A key that holds a third of all rows is spread over so many join partitions.
SALTS = 32
#: A key is hot with one in HOT_SHARE of all rows, and HOT_ROWS at least.
HOT_SHARE, HOT_ROWS = 1000, 256


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch(spark: SparkSession) -> str:
    """The folder that all executors share (spark.checkpoint.dir). Only a local session, as in tests, may do without one."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = os.path.join(tempfile.gettempdir(), f"tracewright-{os.getpid()}")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/tracewright"


#: Rows of a stored table that one task writes, where a bound on the rows is known.
TASK_ROWS = 100_000


def stored(df: DataFrame, label: str, rows: int | None = None) -> DataFrame:
    """df, written to the shared folder and read back: it cuts the lineage, and a lost executor costs nothing that was written.

    rows: a bound on the rows, if known; then no more tasks write, and later read, than that many rows need.
    """
    spark = df.sparkSession
    if rows is not None:
        df = df.coalesce(max(4, -(-rows // TASK_ROWS)))
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def stored_with(df: DataFrame, label: str, *aggs: Column, rows: int | None = None) -> tuple[DataFrame, tuple]:
    """stored(df), and aggregates of its rows that the same job computes."""
    seen = Observation()
    named = [a.alias(f"a{i}") for i, a in enumerate(aggs)]
    out = stored(df.observe(seen, *named), label, rows)
    return out, tuple(seen.get[f"a{i}"] for i in range(len(aggs)))


def drop_stored(df: DataFrame) -> None:
    """Delete the files of a stored() table that nothing reads any more."""
    spark = df.sparkSession
    jvm, roots = spark._jvm, {os.path.dirname(f) for f in df.inputFiles()}
    for root in roots:
        path = jvm.org.apache.hadoop.fs.Path(root)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def hot_keys(counts: DataFrame, key: str, rows: int) -> DataFrame:
    """(key, _hot) of counts(key, _n) for keys with 1/HOT_SHARE of all rows or more: HOT_SHARE keys at most, so they may be broadcast."""
    hot = counts.where((F.col("_n") >= max(HOT_ROWS, rows // HOT_SHARE)) & F.col(key).isNotNull())
    return F.broadcast(stored(hot.select(key, F.lit(True).alias("_hot")), "hot"))


def spread_left_join(left: DataFrame, right: DataFrame, key: str, hot: DataFrame, salts: int = SALTS) -> DataFrame:
    """left ⟕ right on key, where right has one row a key. Left rows of a key in hot, or without a key, go to `salts` partitions
    by their running number, so rows that are alike in all columns spread as well; the right row of a hot key goes to all."""
    salt = F.when(F.col("_hot") | F.col(key).isNull(), F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(salts)).cast("int")).otherwise(0)
    every = F.when(F.col("_hot"), F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))
    spread = left.join(hot, key, "left").withColumn("_salt", salt).drop("_hot")
    sent = right.join(hot, key, "left").withColumn("_salt", F.explode(every)).drop("_hot")
    return spread.join(sent, [key, "_salt"], "left").drop("_salt")


def salted_left_join(left: DataFrame, right: DataFrame, key: str, salts: int = SALTS) -> DataFrame:
    """left ⟕ right on key, where right has one row a key and left may have a third of its rows under one key.

    left is written first (short rows), as it is read for the counts of keys and for the join.
    """
    left, (rows,) = stored_with(left, "keys", F.count(F.lit(1)))
    return spread_left_join(left, right, key, hot_keys(left.groupBy(key).agg(F.count(F.lit(1)).alias("_n")), key, rows), salts)


def slices(texts: list[bytes], most: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Index ranges of about `most` bytes each; a longer text is a range of its own."""
    begin = size = 0
    for i, t in enumerate(texts):
        if size and size + len(t) > most:
            yield begin, i
            begin, size = i, 0
        size += len(t)
    if begin < len(texts):
        yield begin, len(texts)


def as_bytes(column) -> list[bytes]:
    """An Arrow string column as UTF-8 bytes; null becomes the empty text."""
    return [b"" if t is None else t for t in column.cast("binary").to_pylist()]


def hashed_words(texts: list[bytes], lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of all words `[^\\x20\\x09-\\x0D]+`, text after text, and the number of words of each text.

    bytes.split() cuts at exactly these six characters and bytes.lower() changes A-Z only.
    """
    parts = [(t.lower() if lower else t).split() for t in texts]
    counts = np.fromiter(map(len, parts), np.int64, len(parts))
    return np.fromiter(map(xxhash.xxh3_64_intdigest, chain.from_iterable(parts)), np.uint64, int(counts.sum())), counts


def starts(counts: np.ndarray) -> np.ndarray:
    return np.concatenate(([0], np.cumsum(counts)[:-1])) if len(counts) else np.zeros(0, np.int64)


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters neighbours."""
    h = h ^ (h >> np.uint64(33))
    h *= np.uint64(0xFF51AFD7ED558CCD)
    h ^= h >> np.uint64(33)
    h *= np.uint64(0xC4CEB9FE1A85EC53)
    h ^= h >> np.uint64(33)
    return h


def slices_of(column: pa.Array, most: int = SLICE_BYTES) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """(first row, end row, bytes, text edges) of an Arrow string column, in slices of about `most` bytes.

    The bytes are the column's own buffer, not a copy; text k of a slice is bytes[edges[k] : edges[k + 1]]. Nulls are empty.
    """
    column = column.cast(pa.large_binary()) if column.null_count == 0 else column.cast(pa.large_binary()).fill_null(b"")
    if not len(column):
        return
    _, offsets, data = column.buffers()
    edges = np.frombuffer(offsets, np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)
    begin = 0
    while begin < len(column):
        # At least one text; then as many as fit.
        end = max(begin + 1, int(np.searchsorted(edges, edges[begin] + most, side="right")) - 1)
        yield begin, end, data[edges[begin] : edges[end]], edges[begin : end + 1] - edges[begin]
        begin = end
