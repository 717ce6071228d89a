"""Importance resampling towards a target distribution, by hashed n-gram features.

Features are the words and pairs of neighbouring words of a text, hashed to BUCKETS buckets. A bucket's gain is the log
ratio of its smoothed share in the target to that in the corpus; a document's weight is the mean gain of its features.
Weights with Gumbel noise added are ranked, and the highest DRAW_PERCENT in a hundred of the long enough documents drawn:
sampling without replacement, by weight.

1. The byte automaton works on the UTF-8 buffer of an Arrow column as it lies in memory. A table of 256 entries classes
   each byte; a word starts where the class rises and ends where it falls, or at a text's edge. A table-driven CRC-32 is
   advanced over all words of a slice at once, one byte of each word a step; a pair's CRC goes on from its first word's
   state through a blank and the second word. A text and its words are never decoded.
2. One pass counts features by bucket, in one table of BUCKETS numbers a task; the tables are summed. The gains, which are
   BUCKETS numbers whatever the input, go to all tasks; a second pass over the texts gives the weights.
3. Ranks come from a range sort of those documents alone whose score reaches the cut, which the counts by score tell. Each
   partition numbers its own rows, and starts after the rows of the partitions before it: no task sees all rows.

Defined cases: a null text has no words; without words a document has no features, weight 0, and is never drawn; an id that
is null is noised as the empty text; rows that repeat an id are documents of their own (they have one score, and
consecutive ranks in no set order); an empty target or corpus leaves gains to the smoothing; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import math
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import SLICE_BYTES, slices_of, stored, stored_with

BUCKETS = 10_000
#: Documents with fewer words are not drawn.
LEAST_WORDS = 20
DRAW_PERCENT = 25
SEED = 7
#: Once so few words of a slice go on, zlib carries each of them to its end.
LONG_WORDS = 8
#: Rows of one partition of the range sort, about.
SORT_ROWS = 200_000


def word_bytes() -> np.ndarray:
    """1 for each byte of a word: digits, letters and all bytes of code points beyond ASCII."""
    out = np.zeros(256, np.int8)
    out[0x30:0x3A] = out[0x61:0x7B] = out[0x41:0x5B] = out[0x80:] = 1
    return out


def lower_bytes() -> np.ndarray:
    """Each byte, A-Z as a-z."""
    out = np.arange(256, dtype=np.uint8)
    out[0x41:0x5B] += 32
    return out


def crc_steps() -> np.ndarray:
    """Of the reflected polynomial of CRC-32: what a low byte adds to the state."""
    out = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        out = np.where(out & 1, (out >> np.uint32(1)) ^ np.uint32(0xEDB88320), out >> np.uint32(1))
    return out


WORD, LOWER, STEP = word_bytes(), lower_bytes(), crc_steps()
OPEN = np.uint32(0xFFFFFFFF)


def words(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(first byte, length) of all words of data; no word crosses one of the cuts, the texts' edges."""
    inside = np.zeros(len(data) + 2, np.int8)
    inside[1:-1] = WORD[data]
    rise = np.diff(inside)
    edge = cuts[(cuts > 0) & (cuts < len(data))]
    edge = np.unique(edge[(inside[edge] & inside[edge + 1]) > 0])
    begin, end = np.flatnonzero(rise == 1), np.flatnonzero(rise == -1)
    if len(edge):
        begin, end = np.sort(np.concatenate((begin, edge))), np.sort(np.concatenate((end, edge)))
    return begin, end - begin


def advanced(state: np.ndarray, data: np.ndarray, begin: np.ndarray, length: np.ndarray) -> np.ndarray:
    """CRC states after the bytes data[begin : begin + length], all words together, a byte of each at a time."""
    state = state.copy()
    going = np.argsort(-length, kind="stable")
    ends = np.sort(length)
    for k in range(int(length.max(initial=0))):
        # Words are held longest first, so those with more than k bytes are a prefix.
        n = len(going) - int(np.searchsorted(ends, k, side="right"))
        if n <= LONG_WORDS:
            for w in going[:n]:
                rest = data[begin[w] + k : begin[w] + length[w]].tobytes()
                state[w] = np.uint32(zlib.crc32(rest, int(state[w]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF)
            break
        at = going[:n]
        s = state[at]
        state[at] = STEP[(s ^ data[begin[at] + k]) & np.uint32(255)] ^ (s >> np.uint32(8))
    return state


def text_buckets(data: np.ndarray, cuts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(words of each text, text of each feature, bucket of each feature). Texts are data[cuts[i] : cuts[i + 1]]."""
    begin, length = words(data, cuts)
    low = LOWER[data]
    own = np.searchsorted(cuts, begin, side="right") - 1
    one = advanced(np.full(len(begin), OPEN), low, begin, length)
    first = np.flatnonzero(own[1:] == own[:-1])
    blank = STEP[(one[first] ^ np.uint32(32)) & np.uint32(255)] ^ (one[first] >> np.uint32(8))
    two = advanced(blank, low, begin[first + 1], length[first + 1])
    crc = np.concatenate((one, two)) ^ OPEN
    return np.bincount(own, minlength=len(cuts) - 1), np.concatenate((own, own[first])), crc % np.uint32(BUCKETS)


def batches_of_buckets(batches: Iterator[pa.RecordBatch], column: int) -> Iterator[tuple]:
    """(batch, first row, end row, *text_buckets()) for slices of the texts in a column."""
    for b in batches:
        for i, j, data, cuts in slices_of(b.column(column), SLICE_BYTES):
            yield b, i, j, *text_buckets(data, cuts)


def bucket_counts(texts: DataFrame, text: str = "text") -> list[int]:
    """Features of all texts by bucket, counted in a table of BUCKETS numbers a task."""

    def run(batches):
        total = np.zeros(BUCKETS, np.int64)
        for *_, bucket in batches_of_buckets(batches, 0):
            total += np.bincount(bucket, minlength=BUCKETS)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(total[at])], ["bucket", "n"])

    out = [0] * BUCKETS
    for r in texts.select(text).mapInArrow(run, "bucket int, n long").groupBy("bucket").agg(F.sum("n").alias("n")).collect():
        out[r["bucket"]] = r["n"]
    return out


def gains(corpus: list[int], target: list[int]) -> list[int]:
    big_s, big_t = float(sum(corpus) + BUCKETS), float(sum(target) + BUCKETS)
    return [math.floor(1000 * math.log((t + 1) * big_s / ((s + 1) * big_t))) for s, t in zip(corpus, target, strict=True)]


def noise(doc_id: int | None) -> int:
    """Gumbel noise, in thousandths, from a digest of the id."""
    h = int(hashlib.sha256(f"{SEED}:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
    return math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))


def weighed(docs: DataFrame, gain: list[int]) -> DataFrame:
    """doc_id, n_words, n_features, weight, score."""

    def run(batches):
        of = np.array(gain, np.int64)
        for b, i, j, n_words, own, bucket in batches_of_buckets(batches, 1):
            n = np.bincount(own, minlength=j - i)
            # Whole numbers far below 2^53, so the sums are exact.
            total = np.bincount(own, of[bucket], j - i).astype(np.int64)
            weight = np.where(n > 0, total // np.maximum(n, 1), 0)
            ids = b.column(0).slice(i, j - i)
            score = weight + np.fromiter(map(noise, ids.to_pylist()), np.int64, j - i)
            yield pa.RecordBatch.from_arrays([ids, *(pa.array(x.astype(np.int64)) for x in (n_words, n, weight, score))], names)

    names = ["doc_id", "n_words", "n_features", "weight", "score"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, ", ".join(f"{c} long" for c in names))


def numbered(rows: DataFrame, n_rows: int) -> DataFrame:
    """rows(doc_id, score, ...) with rank, 1 for the highest score; ties by the lesser id.

    A range sort deals the rows out, equal ones too, as a row's number is the last key; partitions number their rows, and
    the counts of those before (one row a partition) are added.
    """

    def run(batches):
        at, part = 0, TaskContext.get().partitionId()
        for b in batches:
            own = pa.array(np.arange(at + 1, at + 1 + b.num_rows)), pa.array(np.full(b.num_rows, part, np.int32))
            at += b.num_rows
            yield pa.RecordBatch.from_arrays([*b.columns, *own], [*b.schema.names, "_at", "_part"])

    spark = rows.sparkSession
    parts = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-n_rows // SORT_ROWS))
    keys = [F.desc("score"), F.asc("doc_id"), F.asc("_row")]
    dealt = rows.withColumn("_row", F.monotonically_increasing_id()).repartitionByRange(parts, *keys).sortWithinPartitions(*keys).drop("_row")
    kinds = ", ".join(f"{c} {t}" for c, t in rows.dtypes)
    sorted_rows = stored(dealt.mapInArrow(run, f"{kinds}, _at long, _part int"), "sorted")
    sizes = sorted_rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return sorted_rows.join(F.broadcast(starts), "_part").select(*rows.columns, (F.col("_before") + F.col("_at")).alias("rank"))


def resampled(docs: DataFrame, target: DataFrame) -> DataFrame:
    """doc_id, n_features, weight, score, rank, n_words for every row of docs(doc_id, text); target has a text column.

    rank is null for documents that are not drawn.
    """
    gain = gains(bucket_counts(docs), bucket_counts(target))
    able = F.col("n_words") >= LEAST_WORDS
    scored, (n_able,) = stored_with(weighed(docs, gain), "scored", F.sum(able.cast("long")))
    draw = DRAW_PERCENT * (n_able or 0) // 100
    # Counts by score: scores are whole numbers between gains of BUCKETS shares and the noise's ends, some 10^5 at most.
    each = scored.where(able).groupBy("score").agg(F.count(F.lit(1)).alias("n"))
    above = each.withColumn("upto", F.sum("n").over(Window.orderBy(F.desc("score"))))
    out = scored.select("doc_id", "n_features", "weight", "score", "n_words")
    if not draw:
        return out.withColumn("rank", F.lit(None).cast("long"))
    edge = above.where(F.col("upto") >= draw).agg(F.max("score").alias("score"), F.min("upto").alias("upto")).first()
    high = able & (F.col("score") >= edge["score"])
    ranked = numbered(out.where(high), edge["upto"]).withColumn("rank", F.when(F.col("rank") <= draw, F.col("rank")))
    return out.where(~high).withColumn("rank", F.lit(None).cast("long")).unionByName(ranked)
