"""Language identification by rank-order profiles.

A profile lists the commonest n-grams of a language, 1 to 3 letters with the words' edges, by falling frequency. A
document's own n-grams are ranked alike, and its distance to a language is the sum over its ranked n-grams of how far each
is out of place there; one that a profile lacks counts as far as a profile is long. The nearest language is predicted.

Three code points of 21 bits fit in 64 bits, so an n-gram is a number and no two share one. N-grams with equal counts in a
document share their middle rank, so short texts are not ranked by accident.

Profiles are learned on at most SAMPLE_ROWS documents a language outside the held-out third, chosen by a hash of the id:
counts are summed by Spark, and only the profiles, PROFILE n-grams a language, come to the driver. All rows are scored.

Defined cases: a null text, or one without a letter, is `und` with score 0, as is every text when nothing could be learned;
equally near languages go to the one whose name sorts first; ids that are null are not held out, and are learned from as one
row; repeated rows get equal results; more than MOST_LANGUAGES values of lang are an error; other columns are ignored.
"""

from __future__ import annotations

import sys
import unicodedata
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .labelled import held_out

#: Documents a language that profiles are learned from, at most (a documented bound; scoring covers all rows).
SAMPLE_ROWS = 1000
#: Ids that are put in order for it, in SAMPLE_ROWS; a hash modulo HASHES chooses them.
OVERDRAW, HASHES = 2, 1 << 20
#: N-grams of a profile, and of a document that are ranked.
PROFILE, RANKED = 1000, 400
#: Profiles are sent to all tasks: so many languages at most.
MOST_LANGUAGES = 1000
#: Code points of a text that are counted at once.
CHUNK = 1 << 20
UNKNOWN = "und"
BITS = np.uint64(21)


@cache
def letter_kinds() -> np.ndarray:
    """2 for letters, 1 for marks that go on with a word, 0 for all other code points."""
    out = np.zeros(sys.maxunicode + 1, np.int8)
    for i in range(sys.maxunicode + 1):
        kind = unicodedata.category(chr(i))[0]
        out[i] = 2 if kind == "L" else 1 if kind == "M" else 0
    return out


def gram_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(n-grams in order, their counts) of a whole text; none without a letter.

    Everything but letters and marks is an edge, 0, and neighbouring edges are one. A long text is counted in chunks that
    share the two code points which an n-gram may reach over.
    """
    code = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), np.uint32)
    kind = letter_kinds()[code]
    if not (kind == 2).any():
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    code = np.concatenate(([0], np.where(kind > 0, code, 0), [0])).astype(np.uint64)
    code = code[np.concatenate(([True], (code[1:] > 0) | (code[:-1] > 0)))]
    found = []
    for i in range(0, len(code), CHUNK):
        c = code[i : i + CHUNK + 2]
        one, two = c[:CHUNK], (c[:-1] << BITS | c[1:])[:CHUNK]
        three = (c[:-2] << (BITS + BITS) | c[1:-1] << BITS | c[2:])[:CHUNK][c[1:-1][:CHUNK] > 0]
        # Lengths are told apart by the top bits: a single has none, a pair is marked, and a triple has two marks.
        found.append(np.unique(np.concatenate((one[one > 0], two | np.uint64(1 << 62), three | np.uint64(1 << 63))), return_counts=True))
    if len(found) == 1:
        return found[0]
    grams, at = np.unique(np.concatenate([g for g, _ in found]), return_inverse=True)
    return grams, np.bincount(at, np.concatenate([n for _, n in found])).astype(np.int64)


def ranked(grams: np.ndarray, counts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The RANKED commonest n-grams and their ranks from 0; those with one count share the middle of their places."""
    first = np.argsort(-counts, kind="stable")[:RANKED]
    n = counts[first]
    head = np.flatnonzero(np.diff(n, prepend=-1))
    size = np.diff(np.append(head, len(n)))
    return grams[first], np.repeat(head + (size - 1) / 2, size)


class Profiles:
    """Ranks of all profiles' n-grams: a row an n-gram, a column a language."""

    def __init__(self, rows: list[tuple[str, int, int]]):
        self.langs = sorted({lang for lang, _, _ in rows})
        column = {lang: i for i, lang in enumerate(self.langs)}
        self.grams = np.unique(np.array([g for _, g, _ in rows], np.int64).view(np.uint64))
        # The last row is of an n-gram that no profile has.
        self.ranks = np.full((len(self.grams) + 1, len(self.langs)), -1, np.int32)
        for lang, g, rank in rows:
            self.ranks[np.searchsorted(self.grams, np.int64(g).view(np.uint64)), column[lang]] = rank

    def nearest(self, text: str) -> tuple[str, float]:
        """(language, 1 - its distance as a share of the largest there can be)."""
        grams, place = ranked(*gram_counts(text))
        if not len(grams) or not self.langs:
            return UNKNOWN, 0.0
        at = np.minimum(np.searchsorted(self.grams, grams), len(self.grams) - 1)
        ranks = self.ranks[np.where(self.grams[at] == grams, at, len(self.grams))]
        away = np.where(ranks < 0, PROFILE, np.abs(ranks - place[:, None])).sum(axis=0)
        best = int(away.argmin())
        return self.langs[best], float(1 - away[best] / (PROFILE * len(grams)))


def sample(docs: DataFrame) -> DataFrame:
    """(lang, text) of SAMPLE_ROWS ids a language at most. Only ids travel to be chosen; of repeated ids, one row stays."""
    known = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~F.coalesce(held_out(F.col("doc_id")), F.lit(False)))
    # A hash below a bound that some OVERDRAW * SAMPLE_ROWS rows of the language have; only those are put in order.
    sizes = F.broadcast(known.groupBy(F.col("lang").alias("_of")).agg(F.count(F.lit(1)).alias("_n")))
    low = known.join(sizes, F.col("lang") == F.col("_of")).where(F.pmod(F.xxhash64("doc_id"), F.lit(HASHES)) * F.col("_n") < OVERDRAW * SAMPLE_ROWS * HASHES)
    once = low.groupBy("lang", "doc_id").agg(F.lit(1)).select("lang", "doc_id")
    first = Window.partitionBy("lang").orderBy(F.xxhash64("doc_id", F.lit(1)), "doc_id")
    chosen = once.withColumn("_at", F.row_number().over(first)).where(F.col("_at") <= SAMPLE_ROWS).select(F.col("lang").alias("_lang"), F.col("doc_id").alias("_id"))
    # At most MOST_LANGUAGES * SAMPLE_ROWS short rows, as profiles() has counted the languages.
    found = known.join(F.broadcast(chosen), (F.col("lang") == F.col("_lang")) & F.col("doc_id").eqNullSafe(F.col("_id")), "left_semi")
    return found.groupBy("lang", "doc_id").agg(F.min_by("text", F.xxhash64("text")).alias("text")).select("lang", "text")


def profiles(docs: DataFrame) -> Profiles:
    """The PROFILE commonest n-grams of each language, over the sample."""

    def run(batches):
        for b in batches:
            langs = b.column(0).to_pylist()
            for lang, text in zip(langs, b.column(1).to_pylist(), strict=True):
                grams, n = gram_counts(text)
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(grams), pa.string()), pa.array(grams.view(np.int64)), pa.array(n)], ["lang", "gram", "n"])

    if len(docs.select("lang").where("lang IS NOT NULL").distinct().limit(MOST_LANGUAGES + 1).collect()) > MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} values of lang")
    counted = sample(docs).mapInArrow(run, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    common = Window.partitionBy("lang").orderBy(F.desc("n"), "gram")
    top = counted.withColumn("rank", F.row_number().over(common) - 1).where(F.col("rank") < PROFILE)
    return Profiles([(r["lang"], r["gram"], r["rank"]) for r in top.select("lang", "gram", "rank").collect()])


def language_report(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, lang_pred, score for every row of docs(doc_id, text, lang)."""
    known = profiles(docs)

    def run(batches):
        for b in batches:
            found = [(UNKNOWN, 0.0) if t is None else known.nearest(t) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return out.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")
