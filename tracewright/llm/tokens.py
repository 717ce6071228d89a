"""Token counts with a digest cache.

The cache holds (content digest, tokenizer digest, count). A document's digest is that of its text with runs of ASCII
white space as one blank, which this kind of tokenizer counts alike. Documents join the cache; of the digests that it
lacks, each is encoded once, and the new counts are appended. `ingested` does so batch by batch over a stored cache table.

Defined cases: a null text counts as empty (0 tokens, 0 bytes); texts that differ in white space alone share a digest;
repeated rows stay repeated; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
import uuid

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import as_bytes, salted_left_join, scratch, slices, stored
from .packing import LETTERS, NUMBERS, SPACES, SPECIAL

LIMIT = 2048
MEMO_ENTRIES = 300_000
#: Longer words are not kept, so the memo's bytes are bounded too.
MEMO_LETTERS = 64
#: The tokenizer's split pattern over lower-cased Latin-1; white space is dropped.
WORD = re.compile(f"[{LETTERS}]+|[{NUMBERS}]|'(?:s|t|re|ve|m|ll|d)|[^{SPACES}{LETTERS}{NUMBERS}]+")

_memo: dict = {}
_tools: dict = {}


def counted(texts: list[str], path: str) -> list[int]:
    """Tokens of each text, without added special tokens. Words repeat, so their counts are kept in a bounded memo; texts
    outside Latin-1 or with a special token's string are encoded whole."""
    if path not in _tools:
        from tokenizers import Tokenizer

        _tools[path] = Tokenizer.from_file(path)
    tool, parts = _tools[path], []
    for t in texts:
        try:
            t.encode("latin-1")
            parts.append(None if SPECIAL in t else WORD.findall(t.lower()))
        except UnicodeEncodeError:
            parts.append(None)
    missing = set().union(*[p for p in parts if p is not None]) - _memo.keys()
    if len(_memo) + len(missing) > MEMO_ENTRIES:
        _memo.clear()
        missing = set().union(*[p for p in parts if p is not None])
    words = list(missing)
    _memo.update(zip(words, map(len, tool.encode_batch_fast(words, add_special_tokens=False)), strict=True))
    odd = [t for t, p in zip(texts, parts, strict=True) if p is None]
    rest = iter(tool.encode_batch_fast(odd, add_special_tokens=False) if odd else ())
    out = [sum(map(_memo.__getitem__, p)) if p is not None else len(next(rest)) for p in parts]
    for w in missing:
        if len(w) > MEMO_LETTERS:
            del _memo[w]
    return out


def encode_misses(misses: DataFrame, path: str) -> DataFrame:
    """(content, n_tokens) of misses(content, text)."""

    def run(batches):
        for b in batches:
            raw = as_bytes(b.column(1))
            for i, j in slices(raw):
                n = counted([t.decode("utf-8", "replace") for t in raw[i:j]], path)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(n, pa.int64())], ["content", "n_tokens"])

    return misses.select("content", "text").mapInArrow(run, "content string, n_tokens long")


def tokenizer_digest(path: str) -> str:
    with open(path, "rb") as f:
        return hashlib.sha256(f.read()).hexdigest()


def digests(docs: DataFrame) -> DataFrame:
    """doc_id, n_bytes, content (the digest of the normalised text) and text of every row."""
    text = F.coalesce("text", F.lit(""))
    plain = F.trim(F.regexp_replace(text, r"[ \t\n\x0B\f\r]+", " "))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.octet_length(text).cast("long").alias("n_bytes"), F.sha2(plain, 256).alias("content"), text.alias("text"))


def missing_counts(rows: DataFrame, path: str, cache: DataFrame | None) -> DataFrame:
    """Cache rows (content, tokenizer, n_tokens) of the distinct digests of digests() that the cache lacks."""
    fresh = rows.select("content", "text").dropDuplicates(["content"])
    if cache is not None:
        fresh = fresh.join(of_version(cache, path).select("content"), "content", "left_anti")
    return encode_misses(fresh, path).select("content", F.lit(tokenizer_digest(path)).alias("tokenizer"), "n_tokens")


def of_version(cache: DataFrame, path: str) -> DataFrame:
    return cache.where(F.col("tokenizer") == tokenizer_digest(path)).select("content", "n_tokens")


def joined_counts(rows: DataFrame, known: DataFrame, limit: int) -> DataFrame:
    """Counts for each row of digests(), from known(content, n_tokens)."""
    out = salted_left_join(rows.select("doc_id", "n_bytes", "content"), known, "content")
    return out.select("doc_id", "n_bytes", "n_tokens", (F.col("n_tokens") > limit).alias("over_limit"))


def count_tokens(docs: DataFrame, path: str, cache: DataFrame | None = None, limit: int = LIMIT) -> tuple[DataFrame, DataFrame]:
    """(counts for each document, cache rows to append): append the second, and a later call encodes only what is new.

    cache: content string, tokenizer string, n_tokens long. Only the rows of this tokenizer's digest are used.
    """
    rows = digests(docs)
    new = stored(missing_counts(rows, path, cache), "token-counts")
    known = new.select("content", "n_tokens") if cache is None else new.select("content", "n_tokens").unionByName(of_version(cache, path))
    return joined_counts(rows, known, limit), new


def append_misses(docs: DataFrame, path: str, where: str) -> None:
    """Encode what the cache table at `where` lacks, and append it. The table is made if it is not there; a batch that was cut
    off leaves nothing behind, as a write is committed whole."""
    spark = docs.sparkSession
    schema = "content string, tokenizer string, n_tokens long"
    spark.createDataFrame([], schema).write.mode("append").parquet(where)
    missing_counts(digests(docs), path, spark.read.schema(schema).parquet(where)).write.mode("append").parquet(where)


def ingested(docs: DataFrame, path: str, where: str | None = None, batches: int = 2, limit: int = LIMIT) -> DataFrame:
    """Counts for each document, taken in batches through a stored cache: each batch is joined to the counts that earlier ones
    stored, encodes its distinct misses and appends them; the counts are then read from the cache for all rows."""
    spark = docs.sparkSession
    where = where or f"{scratch(spark)}/token-cache-{uuid.uuid4().hex}"
    batch = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(batches))
    for i in range(batches):
        append_misses(docs.where(batch == i), path, where)
    return joined_counts(digests(docs), of_version(spark.read.parquet(where), path), limit)
