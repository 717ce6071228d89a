"""Rank-order profiles: the distance against a plain version, held-out accuracy, defined cases."""

import unicodedata
import zlib
from collections import Counter

import numpy as np

from tracewright.llm import langid

from .conftest import ODD_TEXTS


def plain_grams(text):
    """N-grams by sight: runs of letters and marks between edges."""
    word, words = "", []
    for c in text.lower() + " ":
        if unicodedata.category(c)[0] in "LM":
            word += c
        elif word:
            words.append(word)
            word = ""
    if not any(unicodedata.category(c)[0] == "L" for w in words for c in w):
        return Counter()
    out = Counter()
    for w in words:
        out.update(w)
    line = "_" + "_".join(words) + "_"
    out.update(("2", line[i : i + 2]) for i in range(len(line) - 1))
    out.update(("3", line[i : i + 3]) for i in range(len(line) - 2) if line[i + 1] != "_")
    return out


def test_whole_texts_are_counted(monkeypatch):
    for chunk in (langid.CHUNK, 7):
        monkeypatch.setattr(langid, "CHUNK", chunk)
        for text in [*ODD_TEXTS, "éá नमस्ते दुनिया", "İI ẞß", "́́", "a", "ab"]:
            grams, n = langid.gram_counts(text or "")
            want = plain_grams(text or "")
            assert len(grams) == len(want) and sorted(n.tolist()) == sorted(want.values())


def test_distance():
    rows = [("xx", *g) for g in ((97, 0), (98, 1), (99, 2))] + [("yy", *g) for g in ((98, 0), (97, 5))]
    known = langid.Profiles(rows)
    # "a b b": b twice, a twice with its edges ... ranks by count, equal counts share the middle of their places.
    grams, place = langid.ranked(*langid.gram_counts("a b b"))
    n = dict(zip(*langid.gram_counts("a b b"), strict=True))
    places = {}
    for g in sorted(n, key=lambda g: -n[g]):
        higher, equal = sum(v > n[g] for v in n.values()), sum(v == n[g] for v in n.values())
        places[g] = higher + (equal - 1) / 2
    assert dict(zip(grams, place, strict=True)) == places
    away = {lang: sum(abs(places[np.uint64(g)] - dict(r)[g]) if g in dict(r) else langid.PROFILE for g in map(int, n)) for lang, r in (("xx", [(97, 0), (98, 1), (99, 2)]), ("yy", [(98, 0), (97, 5)]))}
    best = min(away, key=lambda k: (away[k], k))
    assert known.nearest("a b b") == (best, 1 - away[best] / (langid.PROFILE * len(n)))


def test_held_out_accuracy(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = langid.language_report(docs).join(docs.select("doc_id", "lang"), "doc_id").where("held_out").collect()
    assert all(zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1 for r in got)
    assert sum(r["lang_pred"] == r["lang"] for r in got) >= 0.99 * len(got)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_defined_cases(spark, odd_docs, no_docs):
    got = [(r["doc_id"], r["lang_pred"]) for r in langid.language_report(odd_docs).collect()]
    assert len(got) == odd_docs.count()
    no_letter = {r["doc_id"] for r in odd_docs.collect() if not any(c.isalpha() for c in r["text"] or "")}
    assert {d for d, p in got if p == "und"} == no_letter
    assert langid.language_report(no_docs).count() == 0
    unknown = spark.createDataFrame([(None, "text", None, 1), (1, "text", None, 2)], "doc_id long, text string, lang string, score int")
    assert {tuple(r) for r in langid.language_report(unknown).collect()} == {(None, False, "und", 0.0), (1, False, "und", 0.0)}
    same = spark.createDataFrame([(2, "abc def", "b"), (2, "abc def", "a"), (None, "abc def", "a")], "doc_id long, text string, lang string")
    assert {r["lang_pred"] for r in langid.language_report(same).collect()} == {"a"}
