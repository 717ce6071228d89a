"""Spelling variants: words that differ by one code point, found by two-dimensional range reporting.

Every word is a point: its place among the words of its length in forward order, and its place among the same words read
backwards. The words that arise from a word by changing or inserting one code point after a prefix are those with this
prefix, an interval of the forward order, and with the suffix that follows, an interval of the reverse order: the points of
a rectangle, which a wavelet tree reports. A deletion is an insertion seen from the other word.

1. One pass over the texts counts runs of letters, merged a slice at a time before the shuffle.
2. An edit leaves the first or the second half of the longer word as it is. So a word is dealt out by its length and its
   first half, and by its length and its second half; a word that may turn into a longer one is dealt out by the same halves
   of that length. Each task builds wavelet trees over the words that came to it, for each length and half, and asks
   them about the edit positions of the other half: every pair is met once.
3. A half that more than BLOCK words share is cut into blocks by a hash of the word; a block holds some BLOCK words, and all
   words of that half are asked in each of its blocks. In a task, index rows come first and questions stream past them.
4. Counts of near words and the best one are merged by word; roots follow forms by pointer doubling. Each step to a form
   multiplies the count by FORM_TIMES or more, so there are 19 steps at most.

All letters are below U+0100, so a word is one Latin-1 byte a code point, whose order is that of the code points.

Defined cases: a null text has no words; an id that is null counts as the empty text in the damage rule; repeated rows
count again; words of any length are whole; other columns are ignored; without words the result is empty.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_stored, slices, stored, stored_with

LEAST_LETTERS, LEAST_COUNT = 7, 2
#: A run loses a code point if this divides its hash.
DAMAGE = 31
#: A word's form is its near word with the largest count, if that is so many times its own.
FORM_TIMES = 10
#: Words that share a half are cut into blocks of about so many.
BLOCK = 20_000
#: Rows of one task, about, where there are many words.
TASK_WORDS = 200_000
#: Questions (word and edit position) that are answered at once.
AT_ONCE = 1 << 18
#: Maximal runs; shorter ones cannot give a word.
RUN = re.compile(f"[A-Za-z\u00C0-\u00FF]{{{LEAST_LETTERS},}}")
LOWER = str.maketrans({c: c + 32 for c in range(ord("A"), ord("Z") + 1)})


def damaged(doc_id: int | None, run: str) -> str:
    """The lower-cased run, without one code point if its hash says so."""
    h = zlib.crc32(f"{'' if doc_id is None else doc_id}:{run}".encode())
    return run if h % DAMAGE else run[: h % len(run)] + run[h % len(run) + 1 :]


def word_counts(docs: DataFrame) -> DataFrame:
    """word, n over all texts: LEAST_LETTERS code points or more, LEAST_COUNT occurrences or more."""

    def run(batches):
        for b in batches:
            ids = b.column(0).to_pylist()
            texts = ["" if t is None else t for t in b.column(1).to_pylist()]
            for i, j in slices(texts):
                total = Counter()
                for doc_id, text in zip(ids[i:j], texts[i:j], strict=True):
                    for w, n in Counter(RUN.findall(text.translate(LOWER) if not text.isascii() else text.lower())).items():
                        total[damaged(doc_id, w)] += n
                found = [(w, n) for w, n in total.items() if len(w) >= LEAST_LETTERS]
                yield pa.RecordBatch.from_arrays([pa.array([w for w, _ in found], pa.string()), pa.array([n for _, n in found], pa.int64())], ["word", "n"])

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "word string, n long")
    return rows.groupBy("word").agg(F.sum("n").alias("n")).where(F.col("n") >= LEAST_COUNT)


class WaveletTree:
    """A sequence of distinct numbers below its length, level by level from the highest bit: zeros go left, ones right."""

    def __init__(self, values: np.ndarray):
        self.bits = max(1, int(len(values) - 1).bit_length()) if len(values) else 1
        self.zeros_before, self.n_zeros = [], []
        for level in range(self.bits - 1, -1, -1):
            bit = (values >> level) & 1
            self.zeros_before.append(np.concatenate(([0], np.cumsum(bit == 0))).astype(np.int32))
            self.n_zeros.append(int(self.zeros_before[-1][-1]))
            values = np.concatenate((values[bit == 0], values[bit == 1]))

    def report(self, lo: np.ndarray, hi: np.ndarray, least: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(question, value) of every value in least..end-1 at places lo..hi-1, for all questions at once.

        All questions walk down together; a node is left when its places or its values run out. Work follows the values
        reported, times the levels.
        """
        ask = np.flatnonzero((lo < hi) & (least < end))
        lo, hi, base = lo[ask], hi[ask], np.zeros(len(ask), np.int64)
        for depth in range(self.bits):
            rank, span = self.zeros_before[depth], 1 << (self.bits - 1 - depth)
            z_lo, z_hi = rank[lo], rank[hi]
            o_lo, o_hi = lo - z_lo + self.n_zeros[depth], hi - z_hi + self.n_zeros[depth]
            mid = base + span
            left = (z_lo < z_hi) & (least[ask] < mid) & (end[ask] > base)
            right = (o_lo < o_hi) & (least[ask] < mid + span) & (end[ask] > mid)
            ask = np.concatenate((ask[left], ask[right]))
            base = np.concatenate((base[left], mid[right]))
            lo, hi = np.concatenate((z_lo[left], o_lo[right])), np.concatenate((z_hi[left], o_hi[right]))
        return ask, base


class Order:
    """Sorted byte rows of one width, with the intervals of the words that share a prefix."""

    def __init__(self, rows: np.ndarray):
        self.width = rows.shape[1]
        keys = self.keys(rows)
        self.order = np.argsort(keys, kind="stable")
        self.sorted = keys[self.order]
        self.rows = rows[self.order]
        self.place = np.empty(len(rows), np.int64)
        self.place[self.order] = np.arange(len(rows))
        # shared[0][k]: bytes that rows k - 1 and k have in common; shared[j][k]: the least of 2^j of them, up to k.
        first = np.full(len(rows) + 1, -1, np.int64)
        first[1:-1] = common_prefix(self.rows[1:], self.rows[:-1])
        self.shared = [first]
        while (1 << len(self.shared)) <= len(rows):
            last, step = self.shared[-1], 1 << (len(self.shared) - 1)
            more = last.copy()
            more[step:] = np.minimum(last[step:], last[:-step])
            more[:step] = -1
            self.shared.append(more)

    def keys(self, rows: np.ndarray) -> np.ndarray:
        """Rows as byte strings of this width; shorter ones sort before what they begin."""
        wide = np.zeros((len(rows), self.width), np.uint8)
        wide[:, : rows.shape[1]] = rows
        return wide.view(f"S{self.width}").ravel()

    def neighbours(self, rows: np.ndarray) -> tuple[np.ndarray, ...]:
        """(gap where each row sorts in; bytes it shares with the row before the gap, with the row after it, -1 without one;
        bytes at most that it shares with any row but itself)."""
        gap = np.searchsorted(self.sorted, self.keys(rows))
        m, q = len(self.sorted), rows.shape[1]
        before = np.where(gap > 0, common_prefix(self.rows[np.maximum(gap - 1, 0), :q], rows), -1)
        after = np.where(gap < m, common_prefix(self.rows[np.minimum(gap, m - 1), :q], rows), -1)
        same = after == self.width
        other = np.where(same, self.shared[0][np.minimum(gap + 1, m)], after)
        return gap, before, after, np.maximum(before, other)

    def interval(self, gap: np.ndarray, before: np.ndarray, after: np.ndarray, prefix: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """First and end place of the rows that share a prefix of so many bytes with the row at the gap."""
        lo, hi, m = gap.copy(), gap.copy(), len(self.sorted)
        down, up = before >= prefix, after >= prefix
        lo[down] -= 1
        hi[up] += 1
        for j in range(len(self.shared) - 1, -1, -1):
            step = 1 << j
            # From place lo down to lo - step, all neighbours share the prefix.
            more = down & (lo - step >= 0) & (self.shared[j][lo * down] >= prefix)
            lo[more] -= step
            far = hi - 1 + step
            more = up & (far < m) & (self.shared[j][np.minimum(far, m)] >= prefix)
            hi[more] += step
        return lo, hi


def common_prefix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Leading bytes that rows of a and b have in common."""
    differ = a != b
    return np.where(differ.any(axis=1), differ.argmax(axis=1), a.shape[1]) if a.shape[1] else np.zeros(len(a), np.int64)


def matrix(words: list[bytes], width: int) -> np.ndarray:
    return np.frombuffer(b"".join(words), np.uint8).reshape(len(words), width)


class Index:
    """Words of one length, as points (place in forward order, place in reverse order)."""

    def __init__(self, words: list[bytes], counts: list[int], length: int):
        self.length, self.words, self.counts = length, words, np.array(counts, np.int64)
        self.rows = matrix(words, length)
        self.forward, self.reverse = Order(self.rows), Order(self.rows[:, ::-1])
        self.tree = WaveletTree(self.reverse.place[self.forward.order])

    def near(self, asked: list[bytes], second: bool) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """(question, word) pairs: words of the index that arise from asked ones, all of one length, by a change (the same
        length) or an insertion (one less), in the second half or in the first.

        Positions are narrowed first: the prefix must be shared with a neighbour in forward order, and the suffix with a
        neighbour in reverse order.
        """
        width, size = len(asked[0]), self.length
        q = matrix(asked, width)
        fwd, rev = self.forward.neighbours(q), self.reverse.neighbours(q[:, ::-1])
        half = size // 2
        low = np.maximum(half if second else 0, size - 1 - rev[3])
        high = np.minimum(size - 1 if second else half - 1, fwd[3])
        n = np.maximum(high - low + 1, 0)
        for i, j in runs(n, AT_ONCE):
            ask = np.repeat(np.arange(i, j), n[i:j])
            at = np.arange(len(ask)) - np.repeat(np.cumsum(n[i:j]) - n[i:j], n[i:j]) + low[ask]
            f_lo, f_hi = self.forward.interval(*(x[ask] for x in fwd[:3]), at)
            r_lo, r_hi = self.reverse.interval(*(x[ask] for x in rev[:3]), size - 1 - at)
            which, place = self.tree.report(f_lo, f_hi, r_lo, r_hi)
            found, at, ask = self.reverse.order[place], at[which], ask[which]
            new = self.rows[found, at]
            # A change must change; of insertions that give the same word, the one behind all that is shared counts.
            ok = new != q[ask, np.minimum(at, width - 1)]
            if width < size:
                ok |= at == width
            yield ask[ok], found[ok]


def runs(sizes: np.ndarray, most: int) -> Iterator[tuple[int, int]]:
    """Index ranges whose sizes add up to about `most`; empty ranges are left out."""
    upto = np.cumsum(sizes)
    begin = 0
    while begin < len(sizes) and upto[-1] > (upto[begin - 1] if begin else 0):
        end = max(begin + 1, int(np.searchsorted(upto, (upto[begin - 1] if begin else 0) + most, side="right")))
        yield begin, end
        begin = end


def best_of(word: np.ndarray, n: np.ndarray, near: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(word, number of its rows, row of its best near word: the largest n, of equal ones the least near)."""
    order = np.lexsort((near, -n, word))
    head = np.flatnonzero(np.diff(word[order], prepend=-1))
    return word[order][head], np.diff(np.append(head, len(order))), order[head]


def near_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(word, n_near, best, best_n), of the part of each word's near words that this task holds.

    Rows are (size, second, block, extra, word, n). Those that are not extra come first: they are indexed, and asked as well.
    Each block has its own index, as a word is asked once for each block of its half.
    """
    trees: dict[tuple, Index] = {}
    held: dict[tuple, tuple[list, list]] = {}
    for b in batches:
        asked: dict[tuple, tuple[list, list]] = {}
        for size, second, block, extra, word, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
            words, counts = (asked if extra else held).setdefault((size, second, block, len(word)), ([], []))
            words.append(word.encode("latin-1"))
            counts.append(n)
        if asked and held:
            yield from indexed(trees, held)
            held = {}
        for key, (words, counts) in asked.items():
            if key[:3] in trees:
                yield from answers(trees[key[:3]], words, counts, key[1])
    yield from indexed(trees, held)


def indexed(trees: dict[tuple, Index], held: dict[tuple, tuple[list, list]]) -> Iterator[pa.RecordBatch]:
    """Add an index for each size, half and block to trees, and give the indexed words' own answers."""
    for (size, second, block, _), (words, counts) in held.items():
        tree = trees[size, second, block] = Index(words, counts, size)
        yield from answers(tree, words, counts, second)


def answers(tree: Index, words: list[bytes], counts: list[int], second: bool) -> Iterator[pa.RecordBatch]:
    """Near words of those asked; if they are shorter, they are near words of what they find as well."""
    own = np.array(counts, np.int64)
    rank = np.unique(matrix(words, len(words[0])).view(f"S{len(words[0])}").ravel(), return_inverse=True)[1]
    for ask, found in tree.near(words, second):
        sides = [(words, ask, tree.words, found, tree.counts, tree.forward.place)]
        if len(words[0]) < tree.length:
            sides.append((tree.words, found, words, ask, own, rank))
        for of, a, near, w, n, place in sides:
            if len(a):
                at, many, best = best_of(a, n[w], place[w])
                out = [[of[k].decode("latin-1") for k in at], many, [near[w[k]].decode("latin-1") for k in best], n[w[best]]]
                kinds = (pa.string(), pa.int64(), pa.string(), pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(x, t) for x, t in zip(out, kinds, strict=True)], ["word", "n_near", "best", "best_n"])


def dealt(words: DataFrame, n_words: int) -> DataFrame:
    """(size, second, block, extra, word, n) of words(word, n), so dealt that all that can be near meet in a task, index rows first."""
    size = F.length("word")
    half, longer = F.floor(size / 2).cast("int"), F.floor((size + 1) / 2).cast("int")

    def meets(length, second, kept, extra):
        """The key under which words of this length meet, of which an edit keeps this half."""
        return F.struct(length.alias("size"), F.lit(second).alias("second"), F.xxhash64(length, F.lit(second), kept).alias("key"), F.lit(extra).alias("extra"))

    keys = F.array(
        meets(size, True, F.substring("word", F.lit(1), half), False),
        meets(size, False, F.substring("word", half + 1, size), False),
        meets(size + 1, True, F.substring("word", F.lit(1), longer), True),
        meets(size + 1, False, F.substring("word", longer, size), True),
    )
    rows = words.select("word", "n", F.explode(keys).alias("k")).select("word", "n", "k.*")
    # At most 2 * n_words / BLOCK keys.
    large = rows.where("NOT extra").groupBy("key").agg(F.count(F.lit(1)).alias("m")).where(F.col("m") > BLOCK)
    blocks = F.broadcast(large.select("key", F.ceil(F.col("m") / BLOCK).cast("int").alias("blocks")))
    rows = rows.join(blocks, "key", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    rows = rows.withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("extra", F.col("extra") | (F.col("block") != F.pmod(F.xxhash64("word"), F.col("blocks"))))
    tasks = max(int(words.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-4 * n_words // TASK_WORDS))
    return rows.repartition(tasks, "key", "block").sortWithinPartitions("extra").select("size", "second", "block", "extra", "word", "n")


def near_words(words: DataFrame, n_words: int) -> DataFrame:
    """word, n_near, best, best_n for words(word, n) that have a near word; best is the near word of largest n, then the least."""
    parts = dealt(words, n_words).mapInArrow(near_rows, "word string, n_near long, best string, best_n long")
    best = F.min(F.struct((-F.col("best_n")).alias("x"), "best")).alias("b")
    return parts.groupBy("word").agg(F.sum("n_near").alias("n_near"), best).select("word", "n_near", "b.best", (-F.col("b.x")).alias("best_n"))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) of forms(word, form), by pointer doubling until no root has a form."""
    now = stored(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        step = now.select(F.col("word").alias("root"), F.col("root").alias("next"))
        after, (moved,) = stored_with(now.join(step, "root", "left").select("word", F.coalesce("next", "root").alias("root"), "next"), "roots", F.count("next"))
        drop_stored(now)
        now = after.select("word", "root")
        if not moved:
            return now


def spelling_variants(docs: DataFrame) -> DataFrame:
    """word, form, root, n, n_near, form_n of the words in docs(doc_id, text)."""
    words, (n_words,) = stored_with(word_counts(docs), "words", F.count(F.lit(1)))
    best = stored(near_words(words, n_words), "near")
    is_form = F.col("best_n") >= FORM_TIMES * F.col("n")
    rows = words.join(best, "word", "left").select("word", "n", F.coalesce("n_near", F.lit(0).cast("long")).alias("n_near"), F.when(is_form, F.col("best")).alias("form"), F.when(is_form, F.col("best_n")).alias("form_n"))
    rows = stored(rows, "forms")
    ends = roots(rows.where("form IS NOT NULL"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
