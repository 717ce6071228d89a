"""Near duplicates against brute force over all pairs."""

import re
from collections import Counter

import numpy as np

from tracewright.llm import minhash


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + 5]) for i in range(max(1, len(words) - 4)))


def brute(rows):
    sets = {}
    for doc, text in rows:
        sets.setdefault(doc, shingles(text))
    ids = sorted(sets)
    root = {i: i for i in ids}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    by_shingle = {}
    for i in ids:
        for x in sets[i]:
            by_shingle.setdefault(x, []).append(i)
    seen = Counter()
    for group in by_shingle.values():
        for k, a in enumerate(group):
            for b in group[k + 1 :]:
                seen[a, b] += 1
    for (a, b), n in seen.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            x, y = sorted((find(a), find(b)))
            root[y] = x
    return Counter((doc, len(shingles(text)), find(doc), find(doc) == doc) for doc, text in rows)


def check(docs):
    rows = [(r["doc_id"], r["text"]) for r in docs.select("doc_id", "text").collect()]
    assert Counter(map(tuple, minhash.near_duplicates(docs).collect())) == brute(rows)


def test_odd_texts(odd_docs, no_docs):
    check(odd_docs)
    assert minhash.near_duplicates(no_docs).count() == 0


def test_documents(small_docs):
    check(small_docs)


def test_chains_copies_and_a_common_passage(spark):
    rng = np.random.default_rng(3)
    word = lambda: f"w{rng.integers(5000)}"
    rows, passage = [], [word() for _ in range(60)]
    base = [word() for _ in range(120)]
    for i in range(60):  # a chain: each differs a little from the one before, the ends differ altogether
        base[i * 2] = word()
        rows.append(" ".join(base))
    for _ in range(120):  # a passage that many share, too little to link them
        rows.append(" ".join([*passage, *[word() for _ in range(50)]]))
    hub = [word() for _ in range(100)]
    for _ in range(90):  # near copies of one text; not all are near each other
        copy = list(hub)
        for k in rng.choice(100, 2, replace=False):
            copy[k] = word()
        rows.append(" ".join(copy))
    rows += [" ".join(hub)] * 40
    order = rng.permutation(len(rows))
    check(spark.createDataFrame([(int(i), rows[k]) for i, k in enumerate(order)], "doc_id long, text string"))


def test_a_cloud_on_either_side_of_the_threshold(spark):
    """Copies with few to many edits, some edits shared, two clusters that overlap, and sizes that differ."""
    rng = np.random.default_rng(11)
    word = lambda: f"w{rng.integers(10**6)}"
    base = [word() for _ in range(150)]
    other = base[:110] + [word() for _ in range(40)]
    odd = [(int(k), word()) for k in rng.choice(150, 12, replace=False)]
    rows = []
    for i in range(260):
        copy = list(other if i % 4 == 0 else base)
        for k in rng.choice(150, rng.integers(0, 9), replace=False):
            copy[k] = word()
        for k, w in odd[: rng.integers(0, 5)]:
            copy[k] = w
        if i % 9 == 0:
            copy = copy[: rng.integers(100, 150)]
        rows.append((i, " ".join(copy)))
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_pairs_that_leaders_leave_are_found_by_their_rare_shingles(spark):
    """Without a round of leaders, the search by rare shingles alone finds every link."""
    rng = np.random.default_rng(6)
    sets = {}
    base = np.sort(rng.choice(2**60, 200, replace=False).astype(np.uint64))
    for i in range(60):
        keep = base[rng.random(200) > rng.choice([0.02, 0.06, 0.1])]
        more = rng.choice(np.arange(40, dtype=np.uint64), rng.integers(0, 20), replace=False)
        sets[i] = np.sort(np.concatenate((keep, more)))
    link = lambda a, b: 175 * len(np.intersect1d(sets[a], sets[b])) >= 75 * (len(sets[a]) + len(sets[b]))
    want = {(a, b) for a in sets for b in sets if a != b and link(a, b)}
    members = spark.createDataFrame([(7, i) for i in sets], "bucket long, id long")
    table = spark.createDataFrame([(i, len(s), bytearray(s.tobytes())) for i, s in sets.items()], "id long, n long, shingles binary")
    able = minhash.stored(minhash.with_comp(minhash.able_sets(members, table), None), "t")
    pairs = minhash.rare_mates(members.select("id"), able)
    got = {tuple(r) for r in minhash.verified(pairs, able).collect()}
    assert 0 < len(want) < 60 * 59 and got == want


def test_circulant_signatures_estimate_similarity():
    rng = np.random.default_rng(5)
    a = np.unique(rng.integers(0, 2**63, 900, dtype=np.uint64))
    b = np.unique(np.concatenate((a[:720], rng.integers(0, 2**63, 180, dtype=np.uint64))))
    sig = minhash.circulant_signatures(np.concatenate((a, b)), np.array([len(a), len(b)]))
    want = len(np.intersect1d(a, b)) / len(np.union1d(a, b))
    assert abs((sig[0] == sig[1]).mean() - want) < 0.15


def test_permutations_are_permutations():
    x = np.arange(1 << 20, dtype=np.uint32) * np.uint32(4096) + np.uint32(7)
    assert len(np.unique(minhash.scatter32(x.copy(), 0x7FEB352D, 0x846CA68B))) == len(x)


def test_components_of_paths_and_stars(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, i) for i in range(101, 140)] + [(200, 200)]
    got = dict(map(tuple, minhash.components(spark.createDataFrame(edges, "a long, b long")).collect()))
    assert got == {i: 0 for i in range(1, 41)} | {i: 100 for i in range(101, 140)}
