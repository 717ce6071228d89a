"""Toxicity by a classifier chain over the words and word beginnings that tell toxic from other documents.

Categories are predicted in order by linear models; each later model also gets the earlier categories' probabilities, in
training those that models of other folds predicted (out of fold). Features are the presence, weighted by its log-odds, of at
most FEATURES keys (whole words, and beginnings of 4, 5 and 6 bytes of longer ones), chosen by chi-square. Keys are chosen
and weighed anew inside each fold, from the rows of the other folds, so an out-of-fold probability has seen nothing of its
own row's label. The fit takes place in one task over a bounded labelled sample.

Defined cases: a null or empty text has no features; a document without a label is scored like any other; without labels
or without toxic rows nothing is flagged; repeated rows are scored one by one; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import as_bytes, mix64, slices
from .linear import Rows, fit_logistic, sigmoid

#: Categories in chain order, as conditions on a labelled row.
CATEGORIES = {"toxic": "toxic > 0", "toxic_junk": "toxic > 0 AND quality = 0", "toxic_prose": "toxic > 0 AND quality > 0"}
SAMPLE_ROWS = 8000
FEATURES = 1024
LEAST_ROWS = 6
#: Keys must be so many standard errors from what chance gives.
LEAST_CHI2 = 30.0
FOLDS = 3
#: A text with a single telling word must be learned too, so weights may grow.
TRAINING = {"l2": 1e-6, "rate": 0.1, "steps": 400}
FLAG_AT = 0.5
#: Every ASCII character that is no letter or digit parts words.
BREAKS = bytes(c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))


def word_keys(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keys a text), distinct within a text: the bytes of a short word or of a word's beginning, with a tag."""
    joined = b" ".join(t.lower().translate(BREAKS) for t in texts) + b" " * 9
    buf = np.frombuffer(joined, np.uint8)
    inside = np.concatenate(([False], buf != 32, [False]))
    edge = np.flatnonzero(inside[1:] != inside[:-1])
    begin, size = edge[::2], edge[1::2] - edge[::2]
    ends = np.cumsum([len(t) + 1 for t in texts])
    own = np.searchsorted(ends, begin, "right").astype(np.int64)
    head = np.zeros(len(begin), np.uint64)
    for i in range(7):
        head |= np.where(size > i, buf[begin + np.minimum(i, size - 1)], 0).astype(np.uint64) << np.uint64(8 * i)
    keys, owners = [], []
    for n in (4, 5, 6):
        ok = size > n
        keys.append((head[ok] & np.uint64((1 << 8 * n) - 1)) | np.uint64(n << 56))
        owners.append(own[ok])
    ok = size <= 7
    keys.append(head[ok] | (np.uint64(64) << np.uint64(56)))
    owners.append(own[ok])
    # Longer words are known by a hash of all their bytes too.
    ok = size > 7
    at = np.arange(len(begin) and size[ok].sum()) - np.repeat(np.cumsum(size[ok]) - size[ok], size[ok])
    power = np.multiply.accumulate(np.full(at.max(initial=0) + 1, 0x9E3779B97F4A7C15, np.uint64))
    letters = (buf[np.repeat(begin[ok], size[ok]) + at].astype(np.uint64) + np.uint64(1)) * power[at]
    whole = np.add.reduceat(letters, np.cumsum(size[ok]) - size[ok]) if ok.any() else np.zeros(0, np.uint64)
    keys.append(mix64(whole) >> np.uint64(8) | (np.uint64(255) << np.uint64(56)))
    owners.append(own[ok])
    key, owner = np.concatenate(keys), np.concatenate(owners)
    order = np.lexsort((key, owner))
    key, owner = key[order], owner[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (owner[1:] != owner[:-1])
    return key[fresh], np.bincount(owner[fresh], minlength=len(texts))


def evidence(df: np.ndarray, pos: np.ndarray, n: int, n_pos: int) -> np.ndarray:
    """Smoothed log-odds of each key's presence in toxic against other rows: the value of the feature where it is present."""
    return np.log((pos + 0.5) / (n_pos + 1)) - np.log((df - pos + 0.5) / (n - n_pos + 1))


def columns_of(keys: np.ndarray, counts: np.ndarray, known: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(columns, columns a text) of the keys that are in the sorted array `known`."""
    if not len(known):
        return np.zeros(0, np.int64), np.zeros(len(counts), np.int64)
    at = np.minimum(np.searchsorted(known, keys), len(known) - 1)
    ok = known[at] == keys
    own = np.repeat(np.arange(len(counts)), counts)
    return at[ok], np.bincount(own[ok], minlength=len(counts))


def chain_inputs(idx: np.ndarray, counts: np.ndarray, value: np.ndarray, earlier: list[np.ndarray]) -> Rows:
    """Present keys at their value, then the earlier categories' probabilities."""
    n, k, n_known = len(counts), len(earlier), len(value)
    own = np.concatenate((np.repeat(np.arange(n), counts), np.repeat(np.arange(n), k)))
    order = np.argsort(own, kind="stable")
    cols = np.concatenate((idx, np.tile(np.arange(k) + n_known, n)))
    vals = np.concatenate((value[idx], np.column_stack(earlier).ravel() if k else np.zeros(0)))
    return Rows(cols[order], vals[order], counts + k)


def chosen_keys(keys: np.ndarray, counts: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(sorted keys, the value of each) of at most FEATURES keys that tell rows with y from the others; ties by the key."""
    n, n_pos = len(y), float(y.sum())
    if not 0 < n_pos < n:
        return np.zeros(0, np.uint64), np.zeros(0)
    every, at = np.unique(keys, return_inverse=True)
    df = np.bincount(at, minlength=len(every)).astype(float)
    pos = np.bincount(at, np.repeat(y, counts), len(every))
    expect = df * n_pos / n
    chi2 = (pos - expect) ** 2 / (expect * (1 - n_pos / n))
    ok = np.flatnonzero((df >= LEAST_ROWS) & (chi2 >= LEAST_CHI2))
    best = np.sort(ok[np.lexsort((every[ok], -chi2[ok]))[:FEATURES]])
    return every[best], evidence(df[best], pos[best], n, n_pos)


def rows_of(keys: np.ndarray, counts: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(keys, keys a text) of some texts."""
    mine = np.zeros(len(counts), bool)
    mine[rows] = True
    return keys[np.repeat(mine, counts)], counts[mine]


def train_chain(keys: np.ndarray, counts: np.ndarray, targets: list[np.ndarray]) -> dict:
    """{known: sorted keys, value: their evidence, models: one (weights, intercept) a category}. Later models are trained on
    out-of-fold probabilities of the earlier categories; keys are chosen by the first category."""
    n = len(counts)
    fold, all_rows = np.arange(n) % FOLDS, np.arange(n)

    def seen(rows: np.ndarray) -> tuple:
        known, value = chosen_keys(*rows_of(keys, counts, rows), targets[0][rows])
        return value, *columns_of(keys, counts, known), known

    by_fold = [seen(np.flatnonzero(fold != f)) for f in range(FOLDS)]
    value, idx, n_idx, known = seen(all_rows)
    earlier: list[np.ndarray] = []
    models = []
    for k, y in enumerate(targets):
        oof = np.zeros(n)
        for f, (v, at, many, _) in enumerate(by_fold):
            x, rest, own = chain_inputs(at, many, v, earlier), np.flatnonzero(fold != f), np.flatnonzero(fold == f)
            w, b = fit_logistic(x.take(rest), y[rest], len(v) + k, **TRAINING)
            oof[own] = sigmoid(x.take(own).dot(w) + b)
        models.append(fit_logistic(chain_inputs(idx, n_idx, value, earlier), y, len(value) + k, **TRAINING))
        earlier.append(oof)
    return {"known": known, "value": value, "models": models}


def predict_chain(models: list, idx: np.ndarray, counts: np.ndarray, value: np.ndarray) -> list[np.ndarray]:
    out: list[np.ndarray] = []
    for w, b in models:
        out.append(sigmoid(chain_inputs(idx, counts, value, out).dot(w) + b))
    return out


def fit(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None, rows: int = SAMPLE_ROWS) -> dict:
    """train_chain over at most `rows` labelled documents."""
    categories = categories or CATEGORIES
    n_flags = len(categories)

    def keyed(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            for i, j in slices(texts):
                keys, counts = word_keys(texts[i:j])
                ends = np.cumsum(counts)
                blobs = [keys[e - n : e].tobytes() for e, n in zip(ends.tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(blobs, pa.binary()), *[b.column(k).slice(i, j - i) for k in range(2, b.num_columns)]], names)

    def trained(got: pa.Table | None) -> dict:
        targets = [got[f"y{i}"].to_numpy().astype(float) for i in range(n_flags)] if got else []
        if not targets or not 0 < targets[0].sum() < len(targets[0]):
            return {"known": np.zeros(0, np.uint64), "value": np.zeros(0), "models": [(np.zeros(i), -40.0) for i in range(n_flags)]}
        blobs = got["keys"].to_pylist()
        return train_chain(np.frombuffer(b"".join(blobs), np.uint64), np.array([len(x) // 8 for x in blobs]), targets)

    chosen = labelled.sample(docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text"), labels, rows)
    flags = [F.expr(c).cast("int").alias(f"y{i}") for i, c in enumerate(categories.values())]
    names = ["doc_id", "keys", *[f"y{i}" for i in range(n_flags)]]
    schema = "doc_id long, keys binary, " + ", ".join(f"y{i} int" for i in range(n_flags))
    return labelled.fitted(chosen.select("doc_id", "text", *flags).mapInArrow(keyed, schema), trained)


def toxicity_report(docs: DataFrame, labels: DataFrame, categories: dict[str, str] | None = None) -> DataFrame:
    """doc_id, a probability for each category (p_<name>), and toxic (the first category's reaches FLAG_AT)."""
    categories = categories or CATEGORIES
    model = fit(docs, labels, categories)
    known, value, models = model["known"], model["value"], model["models"]

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            for i, j in slices(texts):
                idx, counts = columns_of(*word_keys(texts[i:j]), known)
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), *map(pa.array, predict_chain(models, idx, counts, value))], names)

    names = ["doc_id", *[f"p_{c}" for c in categories]]
    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, " + ", ".join(f"{c} double" for c in names[1:]))
    return out.withColumn("toxic", (F.col(names[1]) >= FLAG_AT).cast("int"))
