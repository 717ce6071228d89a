"""Brute force against the tokenizers library, exact round trips, and the padding of packs."""

import hashlib
import zlib
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from tracewright.llm import media, packing, tokens

BYTES = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")
WORD = public_tokenizers.path("word_bpe_49k.json")


def check_packs(docs, at_most_padding=None):
    texts = Counter((r["doc_id"], r["text"] or "") for r in docs.collect())
    tool = Tokenizer.from_file(BYTES[0])
    got = packing.packed(docs, *BYTES).collect()
    pieces, seen = defaultdict(Counter), Counter()
    for r in got:
        pieces[r["doc_id"]][r["start"], r["length"], r["ids_crc32"], r["doc_tokens"]] += 1
    for (doc, text), n in texts.items():
        # Pieces of the rows with this text follow each other from 0 to the end; each is taken out as it is met.
        ids = [*tool.encode(text, add_special_tokens=False).ids, 1]
        crc = lambda s, m: zlib.crc32(np.array(ids[s : s + m], "<u4").tobytes())
        for _ in range(n):
            at = 0
            while at < len(ids):
                at += next(m for s, m, c, whole in pieces[doc] if s == at and pieces[doc][s, m, c, whole] and whole == len(ids) and c == crc(s, m) and not pieces[doc].subtract([(s, m, c, whole)]))
            assert at == len(ids)
            seen[doc] += 1
    assert not any(n for p in pieces.values() for n in p.values()) and seen == Counter(doc for doc, _ in texts.elements())
    windows, sizes = defaultdict(list), {}
    for r in got:
        windows[r["sequence_id"]].append((r["offset"], r["length"]))
        assert sizes.setdefault(r["sequence_id"], r["window"]) == r["window"]
    total = padded = 0
    for k, parts in windows.items():
        at, size = 0, sizes[k]
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= 2048
        assert size in (512, 1024, 2048) and (size == 2048 or at == size)
        total += at
        padded += 0 if at & (at - 1) == 0 else 2048 - at
    if at_most_padding is not None:
        assert padded <= at_most_padding * total
    groups = defaultdict(set)
    for r in got:
        groups[r["step_group"]].add(r["sequence_id"])
    assert all(len(g) <= packing.STEP_GROUP for g in groups.values())


def test_packs_of_odd_texts(odd_docs):
    check_packs(odd_docs)


def test_packs_of_documents(small_docs):
    check_packs(small_docs, 0.02)


def test_no_documents_pack(no_docs):
    assert packing.packed(no_docs, *BYTES).count() == 0


def test_pieces_tile_a_document():
    for n in (1, 2, 1023, 1024, 1025, 2047, 2048, 2049, 3072, 5000):
        ids, at = np.arange(n, dtype="<u4").tobytes(), 0
        for s, m, crc, head, tail in packing.pieces_of(ids):
            assert s == at and m == min(2048, n - s) and crc == zlib.crc32(ids[4 * s : 4 * (s + m)])
            assert (head is None) == (not 1024 < m < 2048)
            if head is not None:
                assert head == zlib.crc32(ids[4 * s : 4 * (s + 1024)]) and tail == zlib.crc32(ids[4 * (s + 1024) : 4 * (s + m)])
            at += m
        assert at == n


def test_tiers_shape_the_packs():
    rng = np.random.default_rng(8)
    lengths = np.concatenate((rng.integers(1, 2048, 3000), rng.integers(1, 513, 2500), np.full(40, 512), np.full(20, 1024)))
    where, offset, size = packing.pack_tiers(lengths)
    total = np.bincount(where, lengths)
    whole = np.zeros(len(total), np.int64)
    whole[where] = size
    # Sequences of short tiers are full; all are gapless; little is padded.
    assert {512, 1024, 2048} == set(whole.tolist()) and (total[whole < 2048] == whole[whole < 2048]).all()
    assert (whole - total)[whole == 2048].sum() < 0.02 * lengths.sum()
    for k in range(0, len(total), 97):
        own = np.flatnonzero(where == k)
        own = own[np.argsort(offset[own])]
        assert (offset[own] == np.cumsum(lengths[own]) - lengths[own]).all()
    # Gaps of long windows hold shorter pieces, and without the tiers the packs differ.
    longest = np.zeros(len(total), np.int64)
    np.maximum.at(longest, where, lengths)
    assert ((longest > 1024) & (np.bincount(where) > 1)).sum() > 500
    flat, _, one = packing.pack_tiers(lengths, (2048,))
    assert set(one.tolist()) == {2048} and len(set(zip(where.tolist(), flat.tolist()))) > len(total)


def test_long_rests_are_cut_only_as_far_as_gaps_need_it():
    lengths = np.array([1100, 1300, 1900, 2048, 500])
    assert packing.cut_rests(lengths).tolist() == [True, True, False, False, False]
    assert not packing.cut_rests(np.array([1900, 148, 2048])).any()
    assert packing.cut_rests(np.array([1500] * 10)).sum() == 6 and not packing.cut_rests(np.array([], np.int64)).any()


def test_large_ids_and_rows_without_an_id(spark):
    rows = [(None, "a b c"), (9007199254740993, "d e"), (9007199254740995, "f")] + [(None, f"w{i}") for i in range(50)]
    got = packing.packed(spark.createDataFrame(rows, "doc_id long, text string"), *BYTES).collect()
    assert sorted((r["doc_id"] or 0) for r in got) == [0] * 51 + [9007199254740993, 9007199254740995]


def check_counts(docs):
    tool = Tokenizer.from_file(WORD)
    want = Counter((r["doc_id"], len((r["text"] or "").encode()), n := len(tool.encode(r["text"] or "", add_special_tokens=False)), n > 2048) for r in docs.collect())
    got, new = tokens.count_tokens(docs, WORD)
    assert Counter(map(tuple, got.collect())) == want
    cached = tokens.ingested(docs, WORD, batches=3)
    assert Counter(map(tuple, cached.collect())) == want
    return new


def test_counts(odd_docs, small_docs, no_docs):
    check_counts(odd_docs)
    check_counts(small_docs)
    check_counts(no_docs)


def test_a_warm_cache_encodes_only_what_it_lacks(spark, odd_docs):
    some = odd_docs.where("doc_id % 2 = 0")
    cache = check_counts(some)
    got, new = tokens.count_tokens(odd_docs, WORD, cache)
    known = {r["content"] for r in cache.collect()}
    fresh = [r["content"] for r in new.collect()]
    assert fresh and len(set(fresh)) == len(fresh) and not known & set(fresh)
    cold, _ = tokens.count_tokens(odd_docs, WORD)
    assert Counter(map(tuple, got.collect())) == Counter(map(tuple, cold.collect()))


def test_the_stored_cache_grows_by_the_misses_alone(odd_docs, small_docs, tmp_path):
    where = str(tmp_path / "cache")
    of = lambda: [r["content"] for r in odd_docs.sparkSession.read.parquet(where).collect()]
    tokens.append_misses(odd_docs, WORD, where)
    first = of()
    tokens.append_misses(odd_docs, WORD, where)
    assert sorted(of()) == sorted(first) and len(set(first)) == len(first)
    tokens.append_misses(odd_docs.unionByName(small_docs), WORD, where)
    assert len(of()) > len(first) and len(set(of())) == len(of())
    # A stored count is used as it stands: hits are not encoded again.
    cache = odd_docs.sparkSession.read.parquet(where).withColumn("n_tokens", F.lit(7).cast("long"))
    got, new = tokens.count_tokens(odd_docs, WORD, cache)
    assert {r["n_tokens"] for r in got.collect()} == {7} and new.count() == 0


def test_fast_splitting_is_that_of_the_files():
    """The files' own settings, which the Latin-1 patterns stand for."""
    import json

    for path, norm in ((BYTES[0], None), (WORD, {"NFC", "Lowercase"})):
        spec = json.load(open(path))
        assert all(x["content"].startswith("<|") for x in spec["added_tokens"])
        kinds = {k["type"] for k in (spec["normalizer"] or {}).get("normalizers", [])}
        assert norm is None or norm <= kinds, kinds


def media_row(text):
    """What the report says of a text: the reference stands in the middle of its lines, and its caption counts the bytes."""
    raw = (text or "").encode()
    payload = raw + b" " * (max(192, -(-len(raw) // 192) * 192) - len(raw))
    png = media.png_of(payload)
    lines = [x for x in (text or "").split("\n") if x.split()]
    position = len(lines) // 2
    return (
        len(raw), len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-16:]), len(png), hashlib.sha256(png).hexdigest(), media.feature_of(payload),
        position, len(lines) + 1, " ".join(lines[position - 1].split()) if position else None,
    )


def check_media(docs):
    want = Counter((r["doc_id"], *media_row(r["text"])) for r in docs.collect())
    assert Counter(map(tuple, media.media_report(docs).collect())) == want


def test_media_round_trip(odd_docs, no_docs):
    check_media(odd_docs)
    assert media.media_report(no_docs).count() == 0


def test_media_of_documents(small_docs):
    check_media(small_docs)


def test_sequences_keep_order_and_captions(spark):
    page = '<html><script>x</script><p>one &amp; two<p>three<figure><img src="sha256:aa"><img src="http://x/y.png"><figcaption>the <b>caption</b></figcaption></figure>four<img alt="last"></html>'
    df = spark.createDataFrame([(1, page), (2, None), (3, "")], "page_id long, html string")
    got = {r["page_id"]: [(x["position"], x["kind"], x["text"], x["digest"], x["caption"]) for x in r["sequence"]] for r in media.parsed(df, "page_id").collect()}
    assert got[1] == [
        (0, "text", "one & two", None, None), (1, "text", "three", None, None), (2, "media", None, "aa", "the caption"),
        (3, "media", None, None, "the caption"), (4, "text", "four", None, None), (5, "media", None, None, "last"),
    ]
    assert got[2] == got[3] == []
    features = spark.createDataFrame([("aa", 7)], "digest string, payload_bytes long")
    joined = media.resolved(media.parsed(df, "page_id"), features, "page_id").orderBy("position").collect()
    assert [r["payload_bytes"] for r in joined] == [None, None, 7, None, None, None]
