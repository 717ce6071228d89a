"""Spelling variants against brute force, and the wavelet tree against a scan."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tracewright.llm import variants


def plain_counts(rows):
    out = Counter()
    for doc_id, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
            out[run if h % 31 else run[: h % len(run)] + run[h % len(run) + 1 :]] += 1
    return {w: n for w, n in out.items() if len(w) >= 7 and n >= 2}


def one_edit(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b, strict=True)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def brute(n):
    """Near words by the words' one-deletion forms, each candidate tested from the definition."""
    by_gap = {}
    for w in n:
        for k in {w, *(w[:i] + w[i + 1 :] for i in range(len(w)))}:
            by_gap.setdefault(k, []).append(w)
    near = {w: set() for w in n}
    for group in by_gap.values():
        for a in group:
            near[a].update(b for b in group if b != a and one_edit(a, b))
    form = {}
    for w, others in near.items():
        best = min(others, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    out = set()
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        out.add((w, form[w], root, n[w], len(near[w]), n[form[w]] if form[w] else None))
    return out


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    got = [tuple(r) for r in variants.spelling_variants(docs).collect()]
    assert len(got) == len(set(got)) and set(got) == brute(plain_counts(rows))


def test_documents(small_docs):
    check(small_docs)


def test_odd_texts(odd_docs, no_docs):
    check(odd_docs)
    assert variants.spelling_variants(no_docs).count() == 0


def test_blocks_of_a_common_half_and_a_chain_of_forms(spark, monkeypatch):
    monkeypatch.setattr(variants, "BLOCK", 50)
    monkeypatch.setattr(variants, "AT_ONCE", 64)
    letters = "abcdefghÿÀz"
    shared = [f"commonhalf{a}{b}{c}" for a in letters for b in letters for c in letters] + [f"{a}{b}commonhalf" for a in letters for b in letters]
    text = " ".join(shared * 2)
    chain = " ".join(["wordform"] * 3000 + ["wordforms"] * 250 + ["wordformsz"] * 20 + ["wordformszz"] * 2)
    check(spark.createDataFrame([(1, text), (2, text), (None, text), (3, chain), (3, chain)], "doc_id long, text string"))


def test_very_long_words(spark):
    """Two words of 30,000 letters with an edit between them, and a run of one letter beside one that is longer by one."""
    rng = np.random.default_rng(1)
    long = "".join(rng.choice(list("abcdé"), 30_000))
    other = long[:20_000] + "z" + long[20_001:]
    flat = "a" * 5_000
    text = " ".join((long, other, flat, flat + "a", "ordinary")) + " "
    check(spark.createDataFrame([(i, text * 2) for i in range(3)], "doc_id long, text string"))


@settings(max_examples=60, deadline=None)
@given(st.permutations(range(37)), st.lists(st.tuples(*[st.integers(0, 37)] * 4), min_size=1, max_size=20))
def test_wavelet_tree_reports_what_a_scan_finds(values, asked):
    q = np.array(asked, np.int64)
    which, value = variants.WaveletTree(np.array(values)).report(*q.T)
    got = Counter(zip(which.tolist(), value.tolist(), strict=True))
    assert got == Counter((k, v) for k, (lo, hi, a, b) in enumerate(asked) for v in values[lo:hi] if a <= v < b)


@pytest.mark.parametrize("width", [1, 2])
def test_one_value(width):
    which, value = variants.WaveletTree(np.arange(width)).report(np.array([0]), np.array([width]), np.array([0]), np.array([width]))
    assert sorted(value.tolist()) == list(range(width))
