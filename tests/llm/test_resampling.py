"""Importance resampling against a plain version, and the byte automaton against zlib."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa

from tracewright.llm import common, resampling

WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def features(text):
    words = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return words, [zlib.crc32(x.encode()) % 10000 for x in words + [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]]


def brute(docs, target):
    s, t = Counter(), Counter()
    for _, text in docs:
        s.update(features(text)[1])
    for text in target:
        t.update(features(text)[1])
    big_s, big_t = s.total(), t.total()
    gain = [math.floor(1000 * math.log((t[b] + 1) * (big_s + 10000) / ((s[b] + 1) * (big_t + 10000)))) for b in range(10000)]
    rows = []
    for doc_id, text in docs:
        words, found = features(text)
        weight = sum(gain[b] for b in found) // len(found) if found else 0
        h = int(hashlib.sha256(f"7:{'' if doc_id is None else doc_id}".encode()).hexdigest()[:8], 16)
        rows.append((doc_id, len(words), len(found), weight, weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))))
    able = sorted((r for r in rows if r[1] >= 20), key=lambda r: (-r[4], -1 if r[0] is None else r[0]))
    return rows, able[: 25 * len(able) // 100]


def check(docs, target):
    plain = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    rows, drawn = brute(plain, [r["text"] for r in target.select("text").collect()])
    got = resampling.resampled(docs, target).collect()
    assert Counter((r["doc_id"], r["n_words"], r["n_features"], r["weight"], r["score"]) for r in got) == Counter(rows)
    ranked = sorted((r for r in got if r["rank"] is not None), key=lambda r: r["rank"])
    assert [r["rank"] for r in ranked] == list(range(1, len(drawn) + 1))
    assert [(r["doc_id"], r["score"]) for r in ranked] == [(r[0], r[4]) for r in drawn]


def test_documents(spark, small_docs):
    check(small_docs, spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet"))


def test_repeated_rows_nulls_and_clashing_names(spark):
    text = " ".join(f"word{i % 30}" for i in range(40))
    rows = [(7, text, 1)] * 40 + [(None, text, 2), (None, None, 3), (8, text + " more", 4), (9, "", 5)] + [(i, text.upper(), 6) for i in range(100, 140)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    check(docs, spark.createDataFrame([(text,), (None,), ("other words",)], "text string"))
    check(docs, docs.limit(0))


def test_odd_texts(odd_docs, no_docs):
    check(odd_docs, odd_docs)
    check(odd_docs, no_docs)
    assert resampling.resampled(no_docs, odd_docs).count() == 0


def test_the_automaton(monkeypatch):
    texts = ["", "a", "A b", "ab", "", "0éÿ/:@[`{\x7f\x80 中文", "x" * 5000 + " y", "end", "tail\x00nul", None, "Z"]
    for most in (1, 10, 1 << 20):
        column = pa.array(["cut", *texts, "cut"], pa.string()).slice(1, len(texts))
        got = []
        for i, j, data, cuts in common.slices_of(column, most):
            n, own, bucket = resampling.text_buckets(data, cuts)
            got += [(int(n[k]), sorted(bucket[own == k].tolist())) for k in range(j - i)]
        assert got == [(len(w), sorted(f)) for w, f in map(features, texts)]
    data = np.frombuffer(b"abcdefghij" * 30, np.uint8)
    begin, length = np.arange(0, 250, 5), np.arange(50) % 37
    want = [zlib.crc32(data[b : b + n].tobytes()) for b, n in zip(begin, length, strict=True)]
    for long_words in (0, 8):
        monkeypatch.setattr(resampling, "LONG_WORDS", long_words)
        assert (resampling.advanced(np.full(50, resampling.OPEN), data, begin, length) ^ resampling.OPEN).tolist() == want
