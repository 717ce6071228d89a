"""Quality rules: counted base rules, then a hashed word and character n-gram logistic regression with calibration.

A text's score is intercept + mean weight of its hashed word 1- and 2-grams + mean weight of its hashed character
3-grams, so scoring takes time linear in the text. The model is fitted on a bounded sample of labelled rows, calibrated by
Platt's method on a quarter of them, and applied to Arrow batches against a fixed threshold.

Defined cases: a null or empty text has no words and fails the base rules; a document without a label is scored like any
other; without any labels every score is 0.5 and passes; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import as_bytes, hashed_words, mix64, slices
from .linear import Rows, fit_logistic, fit_platt, seg_sum, sigmoid

MIN_WORDS = 20
MAX_REPEAT_PERCENT = 30
WINDOW = 8
#: A document is kept if its calibrated probability of good quality reaches this.
KEEP_AT = 0.5
BITS = 14
#: Frequencies are scaled so that weights stay near 1.
SCALE = 30.0
BLANKS, SYMBOLS = b" \t\n\x0b\x0c\r", b"#*$%&|<>"
#: Odd multipliers of the rolling hashes.
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD, 0xC4CEB9FE1A85EC53, 0x94D049BB133111EB, 0xBF58476D1CE4E5B9], np.uint64)


def windows(h: np.ndarray, counts: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each run of `size` items within a text, position of its first item)."""
    n = len(h) - size + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    out = np.zeros(n, np.uint64)
    for i in range(size):
        out += h[i : i + n] * STEPS[i % 8]
    room = np.repeat(np.cumsum(counts), counts)[:n] - np.arange(n)
    at = np.flatnonzero(room >= size)
    return mix64(out[at]), at


def repeated_words(h: np.ndarray, counts: np.ndarray, size: int = WINDOW) -> np.ndarray:
    """For each text, its words that lie in a window of `size` words found twice or more in it."""
    keys, at = windows(h, counts, size)
    text = np.repeat(np.arange(len(counts), dtype=np.uint64), counts)
    keys = mix64(keys ^ (text[at] * STEPS[0]))
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    edge = np.zeros(len(h) + 1, np.int64)
    if len(twice):
        hit = at[twice[np.minimum(np.searchsorted(twice, keys), len(twice) - 1)] == keys]
        np.add.at(edge, hit, 1)
        np.add.at(edge, hit + size, -1)
    return seg_sum((np.cumsum(edge[:-1]) > 0).astype(np.int64), counts).astype(np.int64)


def duplicate_lines(t: bytes) -> int:
    lines = [x for x in t.split(b"\n") if x.strip()]
    return len(lines) - len(set(lines))


def word_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, grams a text, word hashes, words a text) of lower-cased word 1- and 2-grams."""
    h, counts = hashed_words(texts)
    pairs, at = windows(h, counts, 2)
    owner = np.repeat(np.arange(len(counts)), counts)
    every = np.concatenate((mix64(h.copy()), pairs))
    own = np.concatenate((owner, owner[at]))
    order = np.argsort(own, kind="stable")
    return (every[order] >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(own, minlength=len(texts)), h, counts


def char_grams(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(buckets, grams a text) of character 3-grams."""
    chars = [t.decode("utf-8", "replace") for t in texts]
    counts = np.fromiter(map(len, chars), np.int64, len(chars))
    points = np.frombuffer("".join(chars).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    keys, at = windows(points, counts, 3)
    own = np.repeat(np.arange(len(counts)), counts)[at]
    return (keys >> np.uint64(64 - BITS)).astype(np.int64), np.bincount(own, minlength=len(texts))


def gram_rows(texts: list[bytes]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each text, the distinct buckets (characters after words) and their scaled frequencies."""
    for t in texts:
        parts = []
        for k, (buckets, counts) in enumerate((word_grams([t])[:2], char_grams([t]))):
            ids, n = np.unique(buckets, return_counts=True)
            parts.append((ids + (k << BITS), SCALE * n / max(1, counts[0])))
        yield np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])


def fit(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> dict:
    """The model as arrays: weights, intercept, and the calibration's slope and shift."""

    def features(batches):
        for b in batches:
            for i, (ids, val) in enumerate(gram_rows(as_bytes(b.column(1)))):
                cells = [pa.array([ids.astype("<u2").tobytes()]), pa.array([val.astype("<f4").tobytes()])]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(2).slice(i, 1), *cells], ["doc_id", "quality", "ids", "val"])

    def trained(got: pa.Table | None) -> dict:
        if got is None:
            return {"w": np.zeros(2 << BITS, np.float32), "b": 0.0, "a": 1.0, "c": 0.0}
        ids = [np.frombuffer(x, "<u2") for x in got["ids"].to_pylist()]
        x = Rows(np.concatenate(ids), np.frombuffer(b"".join(got["val"].to_pylist()), "<f4"), [len(i) for i in ids])
        y = got["quality"].to_numpy() > 0
        part = np.arange(len(ids)) % 4 == 3
        w, b = fit_logistic(x.take(np.flatnonzero(~part)), y[~part].astype(float), 2 << BITS)
        a, c = fit_platt(x.take(np.flatnonzero(part)).dot(w) + b, y[part].astype(float))
        return {"w": w.astype(np.float32), "b": b, "a": a, "c": c}

    chosen = labelled.sample(docs.select("doc_id", "text"), labels, rows).select("doc_id", "text", "quality")
    return labelled.fitted(chosen.mapInArrow(features, "doc_id long, quality int, ids binary, val binary"), trained)


def measured(texts: list[bytes], model: dict) -> dict[str, np.ndarray]:
    """Base counts and the calibrated score of each text."""
    grams, n_grams, h, n_words = word_grams(texts)
    chars, n_chars = char_grams(texts)
    w = model["w"]
    z = model["b"] + SCALE * seg_sum(w[grams], n_grams) / np.maximum(1, n_grams) + SCALE * seg_sum(w[chars + (1 << BITS)], n_chars) / np.maximum(1, n_chars)
    size = lambda t: len(t.decode("utf-8", "replace"))
    repeat = repeated_words(hashed_words(texts, lower=False)[0], n_words)
    return {
        "n_words": n_words,
        "word_chars": np.array([size(t) - len(t) + len(t.translate(None, BLANKS)) for t in texts], np.int64),
        "n_symbols": np.array([len(t) - len(t.translate(None, SYMBOLS)) for t in texts], np.int64),
        "n_dup_lines": np.array([duplicate_lines(t) for t in texts], np.int64),
        "n_repeat_words": repeat,
        "base_failed": (n_words < MIN_WORDS) | (100 * repeat > MAX_REPEAT_PERCENT * n_words),
        "score": sigmoid(model["a"] * z + model["c"]),
    }


SCHEMA = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, score double"


def verdicts(docs: DataFrame, model: dict, keep_at: float = KEEP_AT, carry: bool = False) -> DataFrame:
    """The base counts, base_failed, kept and score of every document; with carry, all of docs' columns of the kept ones."""

    def score(batches):
        for b in batches:
            texts = as_bytes(b.column(b.schema.get_field_index("text")))
            for i, j in slices(texts):
                got = measured(texts[i:j], model)
                kept = ~got["base_failed"] & (got["score"] >= keep_at)
                if carry:
                    yield b.slice(i, j - i).filter(pa.array(kept))
                else:
                    cols = [*[got[k] for k in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")], kept, got["score"]]
                    yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, cols)], names)

    if carry:
        return docs.mapInArrow(score, docs.schema)
    names = [x.split()[0] for x in SCHEMA.split(", ")]
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(score, SCHEMA)


def quality_report(docs: DataFrame, labels: DataFrame) -> DataFrame:
    return verdicts(docs, fit(docs, labels))


def kept_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The rows of docs that pass, all columns unchanged."""
    return verdicts(docs, fit(docs, labels), carry=True)
