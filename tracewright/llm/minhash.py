"""Circulant MinHash near-duplicates with banding and exact Jaccard verification.

A document is the set of its distinct 5-word shingles, as 64-bit hashes. Two permutations of the 32-bit numbers suffice for
all coordinates: sigma shuffles a shingle's number once, pi is applied after a circular shift by the coordinate's index,
and the least value over the set is the coordinate. Bands of ROWS coordinates are the candidate keys.

1. One pass over the texts gives each document its set, the set's digest and its band keys. Equal sets are one class, and
   only its representative (the least id) goes on.
2. Representatives that share a band key with another meet in a bucket. Those whose own shingles rule out any link leave:
   what no other candidate has cannot be in an intersection, so a document that shares a passage and nothing else is never
   compared. This test is exact.
3. A bucket never emits its pairs. Its leader, the member with the largest share of common shingles, is compared on full
   sets with the members of other components; links merge components. Rounds go on with those that are left, while
   leaders still find many links.
4. Members that are in another component than their bucket's leaders are the queries. A query of n shingles whose
   intersection with y must be at least t has one of its n - t + 1 rarest shingles in y, whatever t is. So it is compared
   with those that hold one of them, and with no others: exact, and few, as what keeps a query from its leader is rare.
5. Components come from links by alternating least-neighbour steps over checkpointed tables.

At a similarity of 0.75 a pair misses all 32 bands of 4 rows with probability (1 - 0.75^4)^32 = 5e-6.

Defined cases: fewer than 5 words are one shingle; without words or text the set is empty, linked with nothing; repeated
rows of one id count as one document and stay repeated in the result; a row without an id is linked with nothing, kept, and
has no component; other columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, drop_stored, hashed_words, mix64, salted_left_join, slices, starts, stored, stored_with

SHINGLE = 5
BANDS, ROWS = 32, 4
#: Link if 100 * intersection >= PERCENT * union.
PERCENT = 75
#: Another round of leaders follows while more than this share of a round's members is in other components than their leader.
#: Nor does one follow a round that linked less than this share of its pairs.
LEFT_FOR_A_ROUND, WORTH_A_ROUND = 0.25, 0.1
#: Sides of a join with so many rows of one number at most are sent to all executors (some 16 MB); more are shuffled.
FEW_ROWS = 1_000_000
STEPS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def shingle_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(distinct shingle hashes in order, their number a text)."""
    h, counts = hashed_words(texts)
    n_text = len(texts)
    size = np.minimum(counts, SHINGLE)
    keep = np.where(counts > 0, counts - size + 1, 0)
    own = np.repeat(np.arange(n_text), keep)
    at = np.arange(len(own)) - np.repeat(starts(keep), keep) + np.repeat(starts(counts), keep)
    key = np.zeros(len(own), np.uint64)
    for i in range(SHINGLE):
        inside = i < size[own]
        key += np.where(inside, h[np.minimum(at + i, max(0, len(h) - 1))], np.uint64(i + 1)) * STEPS[i]
    key = mix64(key)
    order = np.lexsort((key, own))
    key, own = key[order], own[order]
    fresh = np.ones(len(key), bool)
    fresh[1:] = (key[1:] != key[:-1]) | (own[1:] != own[:-1])
    return key[fresh], np.bincount(own[fresh], minlength=n_text)


def scatter32(x: np.ndarray, a: int, b: int) -> np.ndarray:
    """A permutation of the 32-bit numbers, in place."""
    x ^= x >> np.uint32(16)
    x *= np.uint32(a)
    x ^= x >> np.uint32(13)
    x *= np.uint32(b)
    x ^= x >> np.uint32(16)
    return x


def circulant_signatures(keys: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """BANDS * ROWS coordinates of each non-empty set, as columns; rows of empty sets are undefined."""
    base = scatter32((keys >> np.uint64(32)).astype(np.uint32), 0x7FEB352D, 0x846CA68B)
    full = np.flatnonzero(counts)
    out = np.zeros((len(counts), BANDS * ROWS), np.uint32)
    if len(full):
        at = starts(counts)[full]
        for k in range(BANDS * ROWS):
            out[full, k] = np.minimum.reduceat(scatter32(base + np.uint32(k), 0x85EBCA6B, 0xC2B2AE35), at)
    return out


def band_keys(signatures: np.ndarray) -> np.ndarray:
    """One 64-bit key for each band."""
    parts = signatures.astype(np.uint64).reshape(len(signatures), BANDS, ROWS)
    out = np.full((len(signatures), BANDS), 0, np.uint64)
    for r in range(ROWS):
        out = mix64(out + (parts[:, :, r] + np.uint64(1)) * STEPS[r])
    return mix64(out + np.arange(1, BANDS + 1, dtype=np.uint64) * STEPS[4]).view(np.int64)


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_key (the set's digest; null if empty), bands (empty if the set is)."""

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            for i, j in slices(texts, 1 << 20):
                keys, counts = shingle_sets(texts[i:j])
                bands = band_keys(circulant_signatures(keys, counts))[counts > 0]
                digests = [xxhash.xxh3_128_digest(keys[s : s + n].tobytes()) if n else None for s, n in zip(starts(counts).tolist(), counts.tolist(), strict=True)]
                ends = np.concatenate(([0], np.cumsum(counts > 0) * BANDS)).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(ends), pa.array(bands.ravel()))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(digests, pa.binary()), lists], names)

    names = ["doc_id", "n_shingles", "class_key", "bands"]
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_shingles long, class_key binary, bands array<long>")


def full_sets(docs: DataFrame) -> DataFrame:
    """id, n, shingles: the whole sets for verification, one row an id."""

    def run(batches):
        for b in batches:
            texts = as_bytes(b.column(1))
            for i, j in slices(texts, 1 << 20):
                keys, counts = shingle_sets(texts[i:j])
                blobs = [keys[s : s + n].tobytes() for s, n in zip(starts(counts).tolist(), counts.tolist(), strict=True)]
                yield pa.RecordBatch.from_arrays([b.column(0).slice(i, j - i), pa.array(counts, pa.int64()), pa.array(blobs, pa.binary())], ["id", "n", "shingles"])

    return docs.select(F.col("doc_id").cast("long").alias("id"), "text").mapInArrow(run, "id long, n long, shingles binary").dropDuplicates(["id"])


def verified(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) whose sets reach PERCENT, compared in full. sets(id, n, shingles) has a row for each id."""

    def run(batches):
        for batch in batches:
            ok = []
            for x, y in zip(batch.column(2), batch.column(3), strict=True):
                x, y = (np.frombuffer(v.as_buffer(), np.uint64) for v in (x, y))
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(100 * both >= PERCENT * (len(x) + len(y) - both))
            keep = pa.array(ok, pa.bool_())
            yield pa.RecordBatch.from_arrays([batch.column(0).filter(keep), batch.column(1).filter(keep)], ["a", "b"])

    small, large = F.least("n", "n_b"), F.greatest("n", "n_b")
    # Leaders are on the side that is joined last, as many pairs may name one.
    own = sets.select(F.col("id").alias("a"), "n", F.col("shingles").alias("left"))
    other = sets.select(F.col("id").alias("b"), F.col("n").alias("n_b"), F.col("shingles").alias("right"))
    met = pairs.join(own, "a").join(other, "b").where(100 * small >= PERCENT * large)
    return met.select("a", "b", "left", "right").mapInArrow(run, "a long, b long")


def marks() -> tuple[Column, Column]:
    """Count and digest of an edge table: they tell whether a step changed it."""
    return F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))


def star_step(edges: DataFrame, label: str, rows: int) -> tuple[DataFrame, tuple]:
    """(edges after a large-star and a small-star step, their count and digest). The connected sets stay the same."""
    both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
    large = both.join(least, "u").where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
    low = large.groupBy("u").agg(F.min("v").alias("m"))
    small = large.join(low, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return stored_with(small.unionByName(low.select("u", F.col("m").alias("v"))).distinct(), label, *marks(), rows=rows)


def components(links: DataFrame, label: str = "comp", rows: int | None = None) -> DataFrame:
    """(id, comp): the least id reachable over links(a, b), for every linked id but those least ones.

    Alternates large-star and small-star steps until nothing changes. Minima are taken map-side first, and the joins that
    send them back have no order to keep, so Spark may split a hub's edges over tasks.
    """
    edges, before = stored_with(links.select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).where("u <> v").distinct(), label, *marks(), rows=rows)
    while before[0]:
        after, state = star_step(edges, label, 2 * before[0])
        drop_stored(edges)
        edges = after
        if state == before:
            break
        before = state
    return edges.select(F.col("u").alias("id"), F.col("v").alias("comp"))


def with_comp(rows: DataFrame, comps: DataFrame | None) -> DataFrame:
    """rows(…, id) with comp, the id itself where nothing is linked."""
    if comps is None:
        return rows.withColumn("comp", F.col("id"))
    return rows.join(comps, "id", "left").withColumn("comp", F.coalesce("comp", "id"))


def few(df: DataFrame, label: str) -> DataFrame:
    """df, written; sent to all executors if it has no more than FEW_ROWS short rows, else left to a shuffle."""
    out, (n,) = stored_with(df, label, F.count(F.lit(1)))
    return F.broadcast(out) if n <= FEW_ROWS else out


def crowded(members: DataFrame) -> DataFrame:
    """members(bucket, id, ...) of buckets with two or more rows. Counts are summed map-side; only they are joined back."""
    many = members.groupBy("bucket").agg(F.count(F.lit(1)).alias("n_in")).where("n_in > 1").select("bucket")
    return members.join(few(many, "crowded"), "bucket", "left_semi")


def shingle_rows(sets: DataFrame, *more: str) -> DataFrame:
    """(shingle, id and the columns in `more`) of sets(id, shingles, ...)."""

    def run(batches):
        for b in batches:
            blobs = [x.as_buffer() for x in b.column(0)]
            for i, j in slices(blobs, 1 << 20):
                counts = np.array([len(x) // 8 for x in blobs[i:j]])
                at = pa.array(np.repeat(np.arange(i, j), counts))
                yield pa.RecordBatch.from_arrays([pa.array(np.frombuffer(b"".join(blobs[i:j]), np.int64)), *[b.column(k).take(at) for k in range(1, b.num_columns)]], ["shingle", *names])

    names = ["id", *more]
    kinds = dict(sets.dtypes)
    return sets.select("shingles", *names).mapInArrow(run, "shingle long, " + ", ".join(f"{c} {kinds[c]}" for c in names))


def reaches(overlap: Column, n: Column, m: Column) -> Column:
    """Whether sets of n and m shingles with so many in common are linked: (100 + P) * overlap >= P * (n + m)."""
    return (100 + PERCENT) * overlap >= PERCENT * (n + m)


def able_sets(members: DataFrame, sets: DataFrame) -> DataFrame:
    """sets that may reach PERCENT with a bucket-mate, with `shared`, the number of shingles that another set has too, and
    `least`, a bound on the size of bucket-mates that can be linked.

    An intersection holds no shingle that only one set has, so it is at most `shared`; mates have the least n of the
    bucket or more, and PERCENT of n or more.
    """
    own = shingle_rows(sets).groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("id").alias("id")).where("c = 1").groupBy("id").agg(F.count(F.lit(1)).alias("own"))
    sized = members.join(few(sets.select("id", "n"), "sizes"), "id")
    floor = few(sized.groupBy("bucket").agg(F.min("n").alias("m")), "floor")
    mate = sized.join(floor, "bucket").groupBy("id").agg(F.min("m").alias("m"))
    able = sets.join(mate, "id").join(own, "id", "left").withColumn("shared", F.col("n") - F.coalesce("own", F.lit(0)))
    able = able.withColumn("least", F.greatest("m", F.ceil(F.col("n") * PERCENT / 100)))
    return able.where(reaches(F.col("shared"), F.col("n"), F.col("least"))).select("id", "n", "shared", "least", "shingles")


def rare_mates(queries: DataFrame, sets: DataFrame) -> DataFrame:
    """pairs(a, b) of every query id a with all sets b of other components that it can be linked to and that hold one of its
    rarest shingles.

    If the first shingle of a, by rising frequency, that b holds has j before it, their intersection is n - j at most: that
    bounds b's size, and j itself. Any order would do; the frequency only makes candidates few.
    """
    asked = shingle_rows(sets.join(queries, "id", "left_semi"), "n", "shared", "least", "comp")
    often = shingle_rows(sets, "comp").groupBy("shingle").agg(F.count(F.lit(1)).alias("c"), F.min("comp").alias("lo"), F.max("comp").alias("hi"))
    rising = Window.partitionBy("id").orderBy("c", "shingle")
    ranked = asked.join(often, "shingle").withColumn("j", F.row_number().over(rising) - 1)
    alone = (F.col("lo") == F.col("comp")) & (F.col("hi") == F.col("comp"))
    first = ranked.where(reaches(F.col("n") - F.col("j"), F.col("n"), F.col("least")) & ~alone).select("shingle", "id", "n", "shared", "comp", "j")
    held = shingle_rows(sets, "n", "shared", "comp").toDF("of", "b", "n_b", "shared_b", "comp_b")
    fits = (F.col("shingle") == F.col("of")) & (F.col("comp") != F.col("comp_b")) & reaches(F.least(F.col("n") - F.col("j"), "shared", "shared_b"), F.col("n"), F.col("n_b"))
    return held.join(few(first, "first"), fits).select(F.col("id").alias("a"), "b").distinct()


def settled(live: DataFrame, sets: DataFrame, links: DataFrame | None, comps: DataFrame | None) -> DataFrame | None:
    """(id, comp) once every member of live(bucket, id) is compared with, or connected to, all of its bucket.

    Members in their bucket's commonest component are connected; the others are the queries. Of a bucket of two, the pair
    was compared.
    """
    now = with_comp(live, comps)
    each = now.groupBy("bucket", "comp").agg(F.count(F.lit(1)).alias("n_in"))
    common = each.groupBy("bucket").agg(F.max(F.struct("n_in", "comp")).alias("x"), F.sum("n_in").alias("n_in"))
    common = few(common.where("n_in > 2").select("bucket", F.col("x.comp").alias("most")), "common")
    queries, (n,) = stored_with(now.join(common, "bucket").where("comp <> most").select("id").distinct(), "queries", F.count(F.lit(1)))
    if not n:
        return comps
    queries = F.broadcast(queries) if n <= FEW_ROWS else queries
    more = verified(rare_mates(queries, stored(with_comp(sets, comps), "sets")), sets)
    return components(more if links is None else links.unionByName(more))


def near_components(reps: DataFrame, docs: DataFrame) -> DataFrame | None:
    """(id, comp) of the representatives(id, bands) that are linked to a lesser id; None if nothing is linked."""
    members = stored(crowded(reps.select(F.explode("bands").alias("bucket"), "id")), "buckets")
    # Only documents that meet another need their sets.
    met = few(members.select(F.col("id").alias("doc_id")).distinct(), "met")
    sets = stored(full_sets(docs.select("doc_id", "text").join(met, "doc_id", "left_semi")), "sets")
    able = stored(able_sets(members, sets), "sets")
    share = few(able.select("id", (F.col("shared") / F.col("n")).alias("share")), "share")
    live, (n,) = stored_with(crowded(members.join(share, "id")), "live", F.count(F.lit(1)))
    drop_stored(members)
    drop_stored(sets)
    links = comps = None
    rest, n_rest, before = live, n, 0
    while n_rest > LEFT_FOR_A_ROUND * before:
        now = with_comp(rest, comps)
        heads = now.groupBy("bucket").agg(F.max(F.struct("share", (-F.col("id")).alias("lead"), "comp")).alias("x"))
        heads = few(heads.select("bucket", (-F.col("x.lead")).alias("lead"), F.col("x.comp").alias("lead_comp")), "heads")
        led = stored(now.join(heads, "bucket").where("id <> lead AND comp <> lead_comp").select("bucket", "id", "share", "lead"), "led")
        pairs, (n_pairs,) = stored_with(led.select(F.col("id").alias("a"), F.col("lead").alias("b")).distinct(), "pairs", F.count(F.lit(1)))
        found, (n_found,) = stored_with(verified(pairs, able), "links", F.count(F.lit(1)))
        links = found if links is None else links.unionByName(found)
        comps = few(components(links), "comps")
        if n_found < WORTH_A_ROUND * n_pairs:
            break
        before = n_rest
        own = with_comp(led, comps).select("bucket", "share", F.col("id").alias("of"), F.col("comp").alias("own_comp"), F.col("lead").alias("id"))
        apart = with_comp(own, comps).where("own_comp <> comp")
        rest, (n_rest,) = stored_with(apart.select("bucket", F.col("of").alias("id"), "share"), "rest", F.count(F.lit(1)))
    return settled(live, able, links, comps) if n else None


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, component_id, kept for every row of docs."""
    sketch = stored(sketches(docs), "sketches")
    whole = sketch.where("class_key IS NOT NULL AND doc_id IS NOT NULL")
    reps = stored(whole.groupBy("class_key").agg(F.min(F.struct("doc_id", "bands")).alias("x")).select("class_key", F.col("x.doc_id").alias("id"), F.col("x.bands").alias("bands")), "classes")
    comps = near_components(reps.select("id", "bands"), docs)
    classes = with_comp(reps.select("class_key", "id"), comps).select("class_key", "comp")
    out = salted_left_join(sketch.select("doc_id", "n_shingles", "class_key"), classes, "class_key")
    own = F.when(F.col("doc_id").isNotNull(), F.coalesce("comp", "doc_id"))
    return out.select("doc_id", "n_shingles", own.alias("component_id"), F.coalesce(own == F.col("doc_id"), F.lit(True)).alias("kept"))


def without_near_copies(docs: DataFrame) -> DataFrame:
    """One document of each group, all columns unchanged; documents without words are kept. Of rows that repeat an id, each
    stays if the id does."""
    gone = near_duplicates(docs).where(~F.col("kept")).select("doc_id").distinct()
    return docs.join(gone, "doc_id", "left_anti").select(*docs.columns)
