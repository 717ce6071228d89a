"""Quality classifier: a factorisation machine over hashed words, structure statistics and metadata.

score = sigmoid(b + sum w x + 1/2 sum_f [(sum v x)^2 - sum v^2 x^2]); the sum-of-squares identity makes all pairwise
interactions cost time linear in the number of features. Words are weighted 1 + log(count) and scaled to length 1, the
statistics are standardised by the sample's mean and deviation. Labels, language, source and id are no inputs; the
metadata is the recorded length `n_chars` where docs have it.

Defined cases: a null or empty text has statistics of 0 and no words, and gets a score like any other; a null n_chars
counts as the text's length; without labels every score is 0.5; repeated rows are scored one by one.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import as_bytes, hashed_words, mix64, slices
from .linear import Rows, seg_sum, sigmoid
from .quality import duplicate_lines

BITS = 15
FACTORS = 8
EPOCHS, BATCH_ROWS, RATE, L2 = 16, 256, 0.02, 1e-5
KINDS = (b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b".,;:!?", b"#*$%&|<>", b"\n", b" \t\r\x0b\x0c")
N_STATS = len(KINDS) + 7


def statistics(texts: list[bytes], n_chars: np.ndarray, counts: np.ndarray, distinct: np.ndarray, top: np.ndarray) -> np.ndarray:
    """One row of N_STATS for each text: shares of character kinds, sizes, repetition."""
    size = np.array([len(t) for t in texts], np.float64)
    share = np.array([[len(t) - len(t.translate(None, k)) for k in KINDS] for t in texts], np.float64).reshape(len(texts), len(KINDS))
    ones, words = np.maximum(1, size), np.maximum(1, counts)
    dups = np.array([duplicate_lines(t) for t in texts], np.float64) / np.maximum(1, share[:, 4] + 1)
    more = [np.log1p(size), np.log1p(counts), size / words, distinct / words, top / words, dups, np.log1p(n_chars)]
    return np.column_stack([share / ones[:, None], *more])


def word_rows(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(buckets, weights, distinct buckets a text, words a text, count of the commonest): weights have length 1 a text."""
    h, counts = hashed_words(texts)
    own = np.repeat(np.arange(len(texts), dtype=np.int64), counts)
    keys, n = np.unique((own << BITS) | (mix64(h) >> np.uint64(64 - BITS)).astype(np.int64), return_counts=True)
    own = keys >> BITS
    distinct = np.bincount(own, minlength=len(texts))
    value = 1 + np.log(n)
    norm = np.sqrt(np.bincount(own, value * value, len(texts)))
    top = np.zeros(len(texts))
    np.maximum.at(top, own, n)
    return keys & ((1 << BITS) - 1), value / norm[own], distinct, counts, top


def fm_sums(v: np.ndarray, w: np.ndarray, idx, val, counts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sum w x, sum v x, sum v^2 x^2) of each row."""
    vx = v[idx] * val[:, None]
    return seg_sum(w[idx] * val, counts), seg_sum(vx, counts), seg_sum(vx * vx, counts)


def train(idx, val, counts, stats: np.ndarray, y: np.ndarray, epochs: int = EPOCHS) -> dict:
    """Adam over mini-batches on log-loss; statistics are the columns after the hashed words. Only columns that the sample has
    are trained, and a batch moves only its own; a word that the sample lacks says nothing."""
    mean, dev = stats.mean(axis=0), stats.std(axis=0) + 1e-6
    rng, dim, n = np.random.default_rng(7), (1 << BITS) + N_STATS, len(y)
    x = with_stats(idx, val, counts, stats, mean, dev)
    used, x.idx = np.unique(x.idx, return_inverse=True)
    # One array for the linear weight and the factors of each column, so that they move together.
    p = np.concatenate((np.zeros((len(used), 1)), rng.normal(0, 0.05, (len(used), FACTORS))), axis=1).astype(np.float32)
    first, second, turns, b = np.zeros_like(p), np.zeros_like(p), np.zeros(len(used)), 0.0
    for epoch in range(epochs):
        rate, order = RATE * (1 - epoch / epochs), rng.permutation(n)
        for at in range(0, n, BATCH_ROWS):
            rows = order[at : at + BATCH_ROWS]
            part = x.take(rows)
            px = p[part.idx] * part.val[:, None]
            s = np.add.reduceat(px, part.ptr[:-1], axis=0)
            q = np.add.reduceat(px[:, 1:] ** 2, part.ptr[:-1], axis=0)
            g = (sigmoid(b + s[:, 0] + 0.5 * (s[:, 1:] ** 2 - q).sum(axis=1)) - y[rows]).astype(np.float32) / len(rows)
            # The gradient of each entry, summed by column.
            px[:, 0], px[:, 1:] = 1, s[part.row, 1:] - px[:, 1:]
            px *= (g[part.row] * part.val)[:, None]
            by = np.argsort(part.idx, kind="stable")
            cols, begin = np.unique(part.idx[by], return_index=True)
            d = np.add.reduceat(px[by], begin, axis=0) + np.float32(L2) * p[cols]
            turns[cols] += 1
            first[cols] = 0.9 * first[cols] + 0.1 * d
            second[cols] = 0.99 * second[cols] + 0.01 * d * d
            t = turns[cols][:, None]
            p[cols] -= rate * (first[cols] / (1 - 0.9**t)) / (np.sqrt(second[cols] / (1 - 0.99**t)) + 1e-8)
            b -= rate * float(g.sum())
    w, v = np.zeros(dim, np.float32), np.zeros((dim, FACTORS), np.float32)
    w[used], v[used] = p[:, 0], p[:, 1:]
    return {"w": w, "v": v, "b": b, "mean": mean, "dev": dev}


def with_stats(idx, val, counts, stats, mean, dev) -> Rows:
    """The word features of each row followed by its standardised statistics."""
    z = np.clip((stats - mean) / dev, -4, 4) / 4
    n = len(counts)
    own = np.concatenate((np.repeat(np.arange(n), counts), np.repeat(np.arange(n), N_STATS)))
    order = np.argsort(own, kind="stable")
    cols = np.concatenate((idx, np.tile(np.arange(N_STATS) + (1 << BITS), n)))
    return Rows(cols[order], np.concatenate((val, z.ravel()))[order], np.asarray(counts) + N_STATS)


def score(model: dict, texts: list[bytes], n_chars: np.ndarray) -> np.ndarray:
    idx, val, distinct, counts, top = word_rows(texts)
    x = with_stats(idx, val, distinct, statistics(texts, n_chars, counts, distinct, top), model["mean"], model["dev"])
    lin, s, q = fm_sums(model["v"], model["w"], x.idx, x.val, x.counts)
    return sigmoid(model["b"] + lin + 0.5 * (s * s - q).sum(axis=1))


def inputs(docs: DataFrame) -> DataFrame:
    """doc_id, text, n_chars: what a score may depend on."""
    size = F.length(F.coalesce("text", F.lit(""))).cast("long")
    n = F.coalesce(F.col("n_chars").cast("long"), size) if "n_chars" in docs.columns else size
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", n.alias("n_chars"))


def fit(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> dict:
    def features(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            chars = np.array(b.column(2).to_pylist(), np.float64)
            for i, t in enumerate(texts):
                idx, val, distinct, counts, top = word_rows([t])
                stats = statistics([t], chars[i : i + 1], counts, distinct, top)
                cells = [idx.astype("<u2").tobytes(), val.astype("<f4").tobytes(), stats.astype("<f8").tobytes()]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, 1), b.column(3).slice(i, 1), *[pa.array([c]) for c in cells]], ["doc_id", "quality", "idx", "val", "stats"])

    def trained(got: pa.Table | None) -> dict:
        if got is None:
            dim = (1 << BITS) + N_STATS
            return {"w": np.zeros(dim, np.float32), "v": np.zeros((dim, FACTORS), np.float32), "b": 0.0, "mean": np.zeros(N_STATS), "dev": np.ones(N_STATS)}
        idx = [np.frombuffer(x, "<u2") for x in got["idx"].to_pylist()]
        val = np.frombuffer(b"".join(got["val"].to_pylist()), "<f4")
        stats = np.array([np.frombuffer(x, "<f8") for x in got["stats"].to_pylist()])
        return train(np.concatenate(idx).astype(np.int64), val, np.array([len(i) for i in idx]), stats, (got["quality"].to_numpy() > 0).astype(float))

    chosen = labelled.sample(inputs(docs), labels, rows).select("doc_id", "text", "n_chars", "quality")
    return labelled.fitted(chosen.mapInArrow(features, "doc_id long, quality int, idx binary, val binary, stats binary"), trained)


def quality_scores(docs: DataFrame, labels: DataFrame, rows: int = labelled.SAMPLE_ROWS) -> DataFrame:
    """doc_id, held_out, score and predicted of every document."""
    model = fit(docs, labels, rows)

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            chars = np.array(b.column(2).to_pylist(), np.float64)
            for i, j in slices(texts):
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(score(model, texts[i:j], chars[i:j]))], ["doc_id", "score"])

    out = inputs(docs).mapInArrow(run, "doc_id long, score double")
    return out.select("doc_id", F.coalesce(labelled.held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
