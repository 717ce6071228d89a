"""Base counts by brute force, held-out accuracy of the models, and defined cases."""

import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tracewright.llm import fm, labelled, linear, quality, toxicity

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def base_counts(text):
    words = WORD.findall(text or "")
    lines = [x for x in (text or "").split("\n") if WORD.search(x)]
    n_dup = sum(x in lines[:i] for i, x in enumerate(lines)) if len(lines) < 5000 else len(lines) - len(set(lines))
    grams = Counter(tuple(words[i : i + 8]) for i in range(len(words) - 7))
    covered = set()
    for i in range(len(words) - 7):
        if grams[tuple(words[i : i + 8])] > 1:
            covered.update(range(i, i + 8))
    failed = len(words) < 20 or 100 * len(covered) > 30 * len(words)
    return len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text or "")), n_dup, len(covered), failed


def check_quality(docs, labels):
    texts = Counter((r["doc_id"], r["text"]) for r in docs.collect())
    want = Counter()
    for (doc, text), n in texts.items():
        want[doc, *base_counts(text)] += n
    got = quality.quality_report(docs, labels).collect()
    assert Counter((r["doc_id"], r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"], r["base_failed"]) for r in got) == want
    assert all(r["kept"] == (not r["base_failed"] and r["score"] >= 0.5) and 0 <= r["score"] <= 1 for r in got)


def test_quality_of_odd_texts(odd_docs, no_docs, small_labels, small_docs):
    check_quality(odd_docs, small_labels)
    assert quality.quality_report(no_docs, small_labels).count() == 0
    check_quality(small_docs, small_labels.limit(0))


def test_quality_counts_of_documents(small_docs, small_labels):
    check_quality(small_docs, small_labels)


def test_kept_documents_are_whole_rows(small_docs, small_labels):
    kept = quality.kept_documents(small_docs, small_labels)
    assert kept.schema == small_docs.schema
    ids = {r["doc_id"] for r in quality.quality_report(small_docs, small_labels).where("kept").collect()}
    assert {tuple(r) for r in kept.collect()} == {tuple(r) for r in small_docs.collect() if r["doc_id"] in ids}


def area(score, y):
    order = np.argsort(score, kind="stable")
    rank = np.empty(len(score))
    rank[order] = np.arange(1, len(score) + 1)
    pos = y > 0
    return (rank[pos].sum() - pos.sum() * (pos.sum() + 1) / 2) / (pos.sum() * (~pos).sum())


@pytest.fixture(scope="module")
def larger(spark):
    return spark.read.parquet("/root/testdata/sf0.1/documents.parquet"), spark.read.parquet("/root/testdata/sf0.1/labels.parquet")


def test_held_out_quality(larger):
    docs, labels = larger
    for rows in (quality.quality_report(docs, labels), fm.quality_scores(docs, labels)):
        got = rows.join(labels, "doc_id").where(labelled.held_out(F.col("doc_id"))).select("score", "quality").toPandas()
        assert area(got["score"].to_numpy(), got["quality"].to_numpy()) > 0.97


def test_held_out_toxicity(larger):
    docs, labels = larger
    got = toxicity.toxicity_report(docs, labels).join(labels.select("doc_id", F.col("toxic").alias("y")), "doc_id").where(labelled.held_out(F.col("doc_id"))).toPandas()
    # Some of these labels are noise: texts marked toxic without any word that marks others.
    assert area(got["p_toxic"].to_numpy(), got["y"].to_numpy()) > 0.93
    flagged = got["toxic"] == 1
    assert (flagged & (got["y"] == 0)).sum() <= 0.01 * (got["y"] == 0).sum()
    assert (flagged & (got["y"] == 1)).sum() >= 0.75 * (got["y"] == 1).sum()


def test_scores_do_not_depend_on_labels_language_source_or_id(small_docs, small_labels):
    twice = small_docs.limit(40).select("doc_id", "text", "n_chars").unionByName(small_docs.limit(40).select((F.col("doc_id") + 10**6).alias("doc_id"), "text", "n_chars"))
    got = {r["doc_id"]: r["score"] for r in fm.quality_scores(twice, small_labels).collect()}
    assert len(got) == 80 and all(abs(got[i] - got[i + 10**6]) < 1e-9 for i in got if i < 10**6)


def test_models_handle_odd_texts_and_no_labels(odd_docs, no_docs, small_labels):
    for labels in (small_labels, small_labels.limit(0)):
        assert fm.quality_scores(odd_docs, labels).where("score BETWEEN 0 AND 1").count() == odd_docs.count()
        assert toxicity.toxicity_report(odd_docs, labels).where("p_toxic BETWEEN 0 AND 1").count() == odd_docs.count()
        assert fm.quality_scores(no_docs, labels).count() == toxicity.toxicity_report(no_docs, labels).count() == 0


def test_the_sum_of_squares_is_the_sum_over_pairs():
    rng = np.random.default_rng(0)
    v, w, x = rng.normal(size=(6, 3)), rng.normal(size=6), rng.normal(size=6)
    lin, s, q = fm.fm_sums(v, w, np.arange(6), x, np.array([6]))
    pairs = sum(v[i] @ v[j] * x[i] * x[j] for i in range(6) for j in range(i))
    assert np.isclose(0.5 * (s * s - q).sum(), pairs) and np.isclose(lin[0], w @ x)


def test_word_keys():
    keys, counts = toxicity.word_keys([b"Loser loser", b"", b"losers", b"no"])
    assert counts.tolist() == [2, 0, 3, 1] and len(set(keys.tolist())) == 5
    keys, counts = toxicity.word_keys([b"abominably abominable", "\u00fcbertrieben ".encode() + b"x" * 5000, b"abominably"])
    assert counts.tolist() == [5, 8, 4] and len(np.intersect1d(keys[:5], keys[-4:])) == 4


def test_chain_uses_earlier_probabilities():
    rng = np.random.default_rng(2)
    first = (rng.random(300) < 0.5).astype(float)
    keys, counts = np.full(int(first.sum()), 9, np.uint64), first.astype(np.int64)
    got = toxicity.train_chain(keys, counts, [first, first])
    assert got["known"].tolist() == [9] and len(got["models"][1][0]) == 2 and got["models"][1][0][1] > 0
    p = toxicity.predict_chain(got["models"], *toxicity.columns_of(keys, counts, got["known"]), got["value"])
    assert ((p[1] > 0.5) == (first > 0)).all()


def test_out_of_fold_probabilities_do_not_see_their_own_labels(monkeypatch):
    """Keys of one fold's toxic rows alone tell nothing: were they chosen with that fold's labels, its probabilities would be high."""
    n = 600
    fold, y = np.arange(n) % toxicity.FOLDS, (np.arange(n) % 2).astype(float)
    counts = ((fold == 0) & (y > 0)).astype(np.int64)
    seen = []
    whole = toxicity.chain_inputs
    monkeypatch.setattr(toxicity, "chain_inputs", lambda idx, many, value, earlier: seen.append([e.copy() for e in earlier]) or whole(idx, many, value, earlier))
    toxicity.train_chain(np.full(int(counts.sum()), 5, np.uint64), counts, [y, y])
    oof = seen[-1][0]
    assert abs(oof[(fold == 0) & (y > 0)].mean() - 0.5) < 0.1


def scored_by_hand(model, text):
    """The chain's first probability, from the words of one text."""
    words = {w for w in re.split(rb"[\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+", text.lower()) if w}
    keys = {toxicity.word_keys([w])[0].tobytes() for w in words}
    mine = set(np.frombuffer(b"".join(keys), np.uint64).tolist())
    out = []
    for w, b in model["models"]:
        z = b + sum(w[i] * model["value"][i] for i, k in enumerate(model["known"].tolist()) if k in mine)
        z += sum(w[len(model["value"]) + i] * p for i, p in enumerate(out))
        out.append(1 / (1 + np.exp(-z)))
    return out


def test_toxicity_scores_by_hand(small_docs, small_labels):
    model = toxicity.fit(small_docs, small_labels)
    got = {r["doc_id"]: list(r)[1:4] for r in toxicity.toxicity_report(small_docs, small_labels).collect()}
    for r in small_docs.limit(60).collect():
        assert np.allclose(got[r["doc_id"]], scored_by_hand(model, (r["text"] or "").encode()), atol=1e-5)


def test_machine_scores_by_the_sum_over_pairs(small_docs, small_labels):
    """The score of documents against the plain double sum over pairs of features."""
    model = fm.fit(small_docs, small_labels)
    got = {r["doc_id"]: r["score"] for r in fm.quality_scores(small_docs, small_labels).collect()}
    for r in fm.inputs(small_docs).limit(25).collect():
        texts, chars = [(r["text"] or "").encode()], np.array([float(r["n_chars"])])
        idx, val, distinct, counts, top = fm.word_rows(texts)
        x = fm.with_stats(idx, val, distinct, fm.statistics(texts, chars, counts, distinct, top), model["mean"], model["dev"])
        z = model["b"] + sum(float(model["w"][i]) * float(a) for i, a in zip(x.idx, x.val))
        vx = model["v"][x.idx].astype(float) * x.val[:, None]
        dots = vx @ vx.T
        z += sum(dots[i, j] for i in range(len(dots)) for j in range(i))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-z))) < 1e-4


def test_kept_is_the_calibrated_score_against_the_threshold(small_docs, small_labels):
    """Scores of the quality rules from counted grams of each text, one at a time."""
    model = quality.fit(small_docs, small_labels)
    got = {r["doc_id"]: r["score"] for r in quality.quality_report(small_docs, small_labels).collect()}
    for r in small_docs.limit(40).collect():
        (ids, val), = quality.gram_rows([(r["text"] or "").encode()])
        z = model["b"] + sum(float(model["w"][i]) * float(v) for i, v in zip(ids, val))
        assert abs(got[r["doc_id"]] - 1 / (1 + np.exp(-(model["a"] * z + model["c"])))) < 1e-3


def test_platt_keeps_order_and_calibrates():
    rng = np.random.default_rng(4)
    z = rng.normal(size=4000)
    y = (rng.random(4000) < linear.sigmoid(3 * z - 1)).astype(float)
    a, c = linear.fit_platt(z, y)
    assert abs(a - 3) < 0.4 and abs(c + 1) < 0.3
