"""Mixing sources to target weights by Pfair scheduling.

Each source's documents are cut into blocks. With weight w, its j-th block (from 1) is released at slot floor((j-1)/w)
and due by slot ceil(j/w); earliest deadline first among the released blocks then serves one block a slot, and every
source is less than one block from its share at every slot. Weights are multiples of 1/quanta, so the schedule repeats
after `quanta` slots: only one such cycle is worked out on the driver (a table of at most `quanta` rows), and Spark places
all blocks by joining it. At the slot where a source runs dry the phase ends, and the next begins there with the weights of
the rest scaled up: whole cycles, then the beginning of one more. So there are two phases a source at most, every document
is placed exactly once, and in every phase each block is served in its window and no source is a block or more from its
share. Where the plan may have more than PLAN_ROWS rows, it is written in parts and unfolded to one row a block, and blocks are joined on (source, block) without
a broadcast; the plan has no more rows than there are blocks.

Defined cases: a null source is a source of its own; sources without a weight get the least one; an empty table gives an
empty schedule; rows that repeat are placed one by one; other columns are ignored.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from fractions import Fraction

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import stored

QUANTA = 1000
BLOCK_DOCS = 16
#: With more sources than this, a cycle has two quanta a source at least.
FEW_SOURCES = 500
#: Rows of the plan that are broadcast; a plan that may have more is written in parts of so many, and joined by blocks.
PLAN_ROWS = 100_000
#: Rows of bucket sizes that are broadcast; more are shuffled.
SIZE_ROWS = 500_000
#: Target weights follow the sources' sizes to this power, unless given.
SMOOTHING = 0.7


def quantised(weights: dict, quanta: int) -> dict:
    """Whole shares of `quanta`, at least 1 each, by largest remainder; ties by name."""
    total = sum(weights.values())
    exact = {s: Fraction(w).limit_denominator(10**9) / Fraction(total).limit_denominator(10**9) * quanta for s, w in weights.items()}
    share = {s: max(1, int(x)) for s, x in exact.items()}
    order = sorted(exact, key=lambda s: (int(exact[s]) - exact[s], s is not None, s or ""))
    for i in range(quanta - sum(share.values())):
        share[order[i % len(order)]] += 1
    # The largest share gives, ties by the last name.
    rank = {s: -k for k, s in enumerate(sorted(reversed(share), key=lambda s: s or ""))}
    largest = [(-n, rank[s], s) for s, n in share.items()]
    heapq.heapify(largest)
    for _ in range(sum(share.values()) - quanta):
        n, k, s = largest[0]
        share[s] -= 1
        heapq.heapreplace(largest, (n + 1, k, s))
    return share


def pfair_cycle(share: dict) -> list[tuple]:
    """(source, j) served in each slot of one cycle: EDF among released blocks; ties by the later release, then the name."""
    quanta = sum(share.values())
    waiting = [(0, i, s, 1) for i, s in enumerate(sorted(share, key=lambda s: (s is not None, s or "")))]
    heapq.heapify(waiting)
    ready: list = []
    slots = []
    for t in range(quanta):
        while waiting and waiting[0][0] <= t:
            r, i, s, j = heapq.heappop(waiting)
            heapq.heappush(ready, (-(-j * quanta // share[s]), -r, i, s, j))
        _, _, i, s, j = heapq.heappop(ready)
        slots.append((s, j))
        if j < share[s]:
            heapq.heappush(waiting, (j * quanta // share[s], i, s, j + 1))
    return slots


def pfair_phases(blocks: dict, weights: dict, quanta: int) -> Iterator[list[tuple]]:
    """Phase by phase, rows (source, phase, first_block, cycles, first_slot, j, slot_in_cycle, quanta, share).

    A phase has `cycles` whole cycles of its active sources; `cycles` = 0 marks the beginning of a cycle, up to the slot in
    which a source runs dry. first_block: the source's blocks placed before the phase.
    """
    left, slot, phase = dict(blocks), 0, 0
    while left := {s: n for s, n in left.items() if n > 0}:
        active = {s: weights[s] for s in left}
        # Every source has one quantum at least, so that many sources need more of them to keep their weights apart.
        share = quantised(active, max(quanta, len(active) * (2 if len(active) > FEW_SOURCES else 1)))
        cycle = pfair_cycle(share)
        whole = min(left[s] // share[s] for s in active)
        done = {s: blocks[s] - left[s] for s in active}
        if whole:
            yield [(s, phase, done[s], whole, slot, j, k, len(cycle), share[s]) for k, (s, j) in enumerate(cycle)]
            slot += whole * len(cycle)
            left.update({s: left[s] - whole * share[s] for s in active})
            phase += 1
            done = {s: blocks[s] - left[s] for s in active}
        if min(left.values()) == 0:
            continue
        took, rows = dict.fromkeys(active, 0), []
        for k, (s, j) in enumerate(cycle):
            rows.append((s, phase, done[s], 0, slot, j, k, len(cycle), share[s]))
            took[s] += 1
            if took[s] == left[s]:
                break
        left.update({s: left[s] - n for s, n in took.items()})
        slot += len(rows)
        phase += 1
        yield rows


def plan_table(spark: SparkSession, phases: Iterator[list[tuple]]) -> DataFrame:
    """The plan's rows as a table, written a part at a time."""
    parts, rows = [], []
    for more in phases:
        rows += more
        if len(rows) >= PLAN_ROWS:
            parts.append(stored(spark.createDataFrame(rows, PLAN), "plan"))
            rows = []
    if rows:
        parts.append(stored(spark.createDataFrame(rows, PLAN), "plan"))
    return spark.read.schema(parts[0].schema).parquet(*[f for p in parts for f in p.inputFiles()])


def numbered(docs: DataFrame, block_docs: int, n_sources: int) -> DataFrame:
    """doc_id, source, row (all columns of docs) and seq, a gapless number from 0 within the source, without sorting a source
    in one task.

    Rows go to buckets by a hash of the document; buckets are numbered apart and shifted by the sizes of those before.
    """
    spark = docs.sparkSession
    spread = max(SPREAD, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = docs.select("doc_id", "source", F.struct("*").alias("row")).withColumn("_bucket", F.pmod(F.xxhash64("doc_id", F.lit("mix")), F.lit(spread)).cast("int"))
    sizes = rows.groupBy("source", "_bucket").count()
    before = Window.partitionBy("source").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("source", "_bucket", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("source", "_bucket").orderBy(F.xxhash64("doc_id"), "doc_id")
    rows = rows.withColumn("_n", F.row_number().over(inside) - 1)
    on = rows["source"].eqNullSafe(sizes["source"]) & (rows["_bucket"] == sizes["_bucket"])
    # There are n_sources * spread sizes at most.
    out = rows.join(F.broadcast(sizes) if n_sources * spread <= SIZE_ROWS else sizes, on).select(rows["doc_id"], rows["source"], "row", (F.col("_n") + F.col("_before")).alias("seq"))
    return out.withColumn("block", F.floor(F.col("seq") / block_docs))


PLAN = "p_source string, phase int, first_block long, cycles long, first_slot long, j long, k long, quanta long, share long"
#: Buckets a source is numbered in, at least.
SPREAD = 64


def pfair_mix(docs: DataFrame, weights: dict | None = None, block_docs: int = BLOCK_DOCS, quanta: int = QUANTA) -> DataFrame:
    """doc_id, source, row (docs' own columns, so that none clash), block, phase, slot, release, deadline and position (the
    place in the mixed order, gapless but at blocks' ends).

    release and deadline are the slots of the block's Pfair window in its phase: release <= slot < deadline.
    """
    spark = docs.sparkSession
    sizes = {r["source"]: r["n"] for r in docs.groupBy("source").agg(F.count(F.lit(1)).alias("n")).collect()}
    blocks = {s: -(-n // block_docs) for s, n in sizes.items()}
    given = weights or {s: n**SMOOTHING for s, n in sizes.items()}
    least = min(given.values(), default=1)
    phases = pfair_phases(blocks, {s: given.get(s, least) for s in blocks}, quanta)
    if 2 * quanta * len(sizes) > PLAN_ROWS:
        return placed_by_blocks(numbered(docs, block_docs, len(sizes)), plan_table(spark, phases), block_docs)
    plan = [r for rows in phases for r in rows]
    # One row a slot of a cycle: at most 2 * quanta rows for each source that runs dry, so PLAN_ROWS in all.
    cycles = F.broadcast(spark.createDataFrame(plan, PLAN).withColumn("last_block", F.col("first_block") + F.greatest(F.col("cycles"), F.lit(1)) * F.col("share")))
    spans = F.broadcast(spark.createDataFrame(phase_spans(plan, blocks), "s_source string, s_phase int, s_first long, s_end long, s_share long, s_cycles long"))
    rows = numbered(docs, block_docs, len(sizes))
    placed = rows.join(spans, F.col("source").eqNullSafe(F.col("s_source")) & (F.col("block") >= F.col("s_first")) & (F.col("block") < F.col("s_end")))
    placed = placed.withColumn("_j", F.when(F.col("s_cycles") > 0, F.pmod(F.col("block") - F.col("s_first"), F.col("s_share"))).otherwise(F.col("block") - F.col("s_first")) + 1)
    placed = placed.withColumn("_c", F.when(F.col("s_cycles") > 0, F.floor((F.col("block") - F.col("s_first")) / F.col("s_share"))).otherwise(0))
    got = placed.join(cycles, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("s_phase") == F.col("phase")) & (F.col("_j") == F.col("j")))
    return scheduled(got, block_docs)


def placed_by_blocks(rows: DataFrame, plan: DataFrame, block_docs: int) -> DataFrame:
    """numbered() rows with their places, by an equi-join: the plan is unfolded to one row a block, so no key is hot."""
    every = plan.withColumn("_c", F.explode(F.sequence(F.lit(0).cast("long"), F.greatest(F.col("cycles"), F.lit(1)) - 1)))
    every = every.withColumn("_block", F.col("first_block") + F.col("_c") * F.col("share") + F.col("j") - 1)
    return scheduled(rows.join(every, F.col("source").eqNullSafe(F.col("p_source")) & (F.col("block") == F.col("_block"))), block_docs)


def scheduled(got: DataFrame, block_docs: int) -> DataFrame:
    """pfair_mix's columns of rows that are joined to their slot's row of the plan; _c: the cycle of the phase."""
    base = F.col("_c") * F.col("quanta")
    slot = F.col("first_slot") + base + F.col("k")
    return got.select(
        "doc_id", "source", "row", "block", "phase", slot.alias("slot"),
        (F.col("first_slot") + base + F.floor((F.col("j") - 1) * F.col("quanta") / F.col("share"))).alias("release"),
        (F.col("first_slot") + base + F.ceil(F.col("j") * F.col("quanta") / F.col("share"))).alias("deadline"),
        (slot * block_docs + F.pmod(F.col("seq"), F.lit(block_docs))).alias("position"),
    )


def phase_spans(plan: list[tuple], blocks: dict) -> list[tuple]:
    """(source, phase, first block, end, share, cycles) of each source's part of each phase."""
    parts: dict = {}
    for s, phase, first, cycles, _, j, _, _, share in plan:
        end = first + cycles * share if cycles else first + j
        old = parts.get((s, phase))
        parts[s, phase] = (s, phase, first, max(end, old[3]) if old else end, share, cycles)
    return list(parts.values())


def mixed(docs: DataFrame, **options) -> DataFrame:
    """docs in mixed order: partitions are ranges of position, sorted within."""
    ordered = pfair_mix(docs, **options)
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return ordered.repartitionByRange(n, "position").sortWithinPartitions("position").select("row.*")
