"""Packing documents into training sequences over a hierarchy of context sizes.

Only what exceeds the longest tier is cut beforehand: a document's ids (with the closing id) are whole windows of the longest
tier and one rest, and the rest is routed to the smallest tier that holds it. Each shard packs its pieces tier by tier:

1. Rests of the longest tier open a window each. Their gaps are filled from the shorter tiers, longest piece first, into the
   smallest gap that holds it.
2. What is left is packed in windows of its own tier, again from the longest tier down, and gaps are filled from below.
3. A short window that is exactly full is a sequence of its own size. The others are chained, as blocks, into sequences of
   the longest tier.

Where rests of the longest tier leave more room than shorter pieces can fill, the shortest of them are cut at the next tier's
size: the head is a full window of that tier and the tail is a shorter piece. Sequences are then dealt to step groups so that
groups cost about the same attention work.

Texts are split into the tokenizer's own pre-tokens; ids of a pre-token are looked up in a bounded memo and computed from
the public ranks of the same vocabulary on a miss. Texts outside Latin-1, or that hold a special token's string, go
through the tokenizers library whole.

Defined cases: a null text counts as empty and has the closing id only; an empty table gives no pieces; repeated rows are
packed one by one; other columns are ignored.
"""

from __future__ import annotations

import base64
import re
import struct
import zlib
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import as_bytes, slices, stored

WINDOW = 2048
TIERS = (512, 1024, 2048)
CLOSING_ID = 1
STEP_GROUP = 8
#: Pieces a shard packs: enough for windows to fill, few enough for one task.
SHARD_PIECES = 8192
#: Pre-tokens the memo of a worker holds, at most.
MEMO_ENTRIES = 250_000
#: Longer pre-tokens are not kept, so the memo's bytes are bounded too.
MEMO_LETTERS = 64
#: Latin-1's letters, numbers and white space as the tokenizer's classes \\p{L}, \\p{N} and \\s see them.
LETTERS = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff"
NUMBERS = "0-9\xb2\xb3\xb9\xbc-\xbe"
SPACES = "\t-\r \x85\xa0"
#: The public byte-level pattern (public_tokenizers.PATTERN) over Latin-1.
PRE_TOKEN = re.compile(f"'(?:s|t|re|ve|m|ll|d)| ?[{LETTERS}]+| ?[{NUMBERS}]+| ?[^{SPACES}{LETTERS}{NUMBERS}]+|[{SPACES}]+(?![^{SPACES}])|[{SPACES}]+")
SPECIAL = "<|"

_memo: dict = {}
_tools: dict = {}


def tools(json_path: str, ranks_path: str) -> tuple:
    """(tokenizers' Tokenizer, tiktoken's Encoding of the same ranks), once a worker."""
    if json_path not in _tools:
        import public_tokenizers
        import tiktoken
        from tokenizers import Tokenizer

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_path, "rb"))}
        _tools[json_path] = Tokenizer.from_file(json_path), tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _tools[json_path]


def encoded(texts: list[str], json_path: str, ranks_path: str) -> list[bytes]:
    """The ids of each text as little-endian 32-bit numbers."""
    whole, ranks = tools(json_path, ranks_path)
    parts: list = []
    for t in texts:
        try:
            t.encode("latin-1")
            parts.append(None if SPECIAL in t else PRE_TOKEN.findall(t))
        except UnicodeEncodeError:
            parts.append(None)
    missing = set().union(*[p for p in parts if p is not None]) - _memo.keys()
    if len(_memo) + len(missing) > MEMO_ENTRIES:
        _memo.clear()
        missing = set().union(*[p for p in parts if p is not None])
    for w in missing:
        ids = ranks.encode_ordinary(w)
        _memo[w] = struct.pack(f"<{len(ids)}I", *ids)
    odd = [t for t, p in zip(texts, parts, strict=True) if p is None]
    rest = iter(whole.encode_batch_fast(odd, add_special_tokens=False) if odd else ())
    out = [b"".join(map(_memo.__getitem__, p)) if p is not None else np.array(next(rest).ids, "<u4").tobytes() for p in parts]
    for w in missing:
        if len(w) > MEMO_LETTERS:
            del _memo[w]
    return out


def pieces_of(ids: bytes, window: int = WINDOW, head: int = TIERS[-2]) -> list[tuple]:
    """(start, length, crc of the ids, crc of the first `head` ids, crc of those after) of a document's pieces: whole windows,
    then the rest. The last two are null for pieces that are never cut."""
    n, out = len(ids) // 4, []
    for s in range(0, n, window):
        m = min(window, n - s)
        cut = 4 * (s + head)
        halves = (zlib.crc32(ids[4 * s : cut]), zlib.crc32(ids[cut : 4 * (s + m)])) if head < m < window else (None, None)
        out.append((s, m, zlib.crc32(ids[4 * s : 4 * (s + m)]), *halves))
    return out


def tokenized_pieces(docs: DataFrame, json_path: str, ranks_path: str, keep: tuple = ()) -> DataFrame:
    """One row for each piece: doc_id, doc_tokens, start, length, ids_crc32, head_crc32, tail_crc32 and the document's columns
    in `keep`."""
    closing = struct.pack("<I", CLOSING_ID)

    def run(batches):
        for b in batches:
            raw, ids = as_bytes(b.column(1)), b.column(0).to_pylist()
            for i, j in slices(raw):
                rows, of = [], []
                for at, buf in enumerate(encoded([t.decode("utf-8", "replace") for t in raw[i:j]], json_path, ranks_path), i):
                    buf += closing
                    rows += [(ids[at], len(buf) // 4, *piece) for piece in pieces_of(buf)]
                    of += [at] * (len(rows) - len(of))
                kept = [b.column(2 + k).take(pa.array(of, pa.int64())) for k in range(len(keep))]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*rows, strict=True)] + kept, [*names, *keep])

    names = ["doc_id", "doc_tokens", "start", "length", "ids_crc32", "head_crc32", "tail_crc32"]
    schema = ", ".join([f"{c} long" for c in names] + [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in keep])
    return docs.select(F.col("doc_id").cast("long"), "text", *keep).mapInArrow(run, schema)


def cut_rests(lengths: np.ndarray, tiers: tuple = TIERS) -> np.ndarray:
    """Which pieces of the longest tier are cut at the next tier's size: the shortest, until shorter pieces can fill all gaps."""
    cut = np.zeros(len(lengths), bool)
    if len(tiers) < 2:
        return cut
    top, half = tiers[-1], tiers[-2]
    rests = np.flatnonzero((lengths > half) & (lengths < top))
    rests = rests[np.argsort(lengths[rests], kind="stable")]
    room = (top - lengths[rests]).sum() - lengths[lengths <= half].sum()
    # Cutting one takes its gap away and adds its tail to the shorter pieces.
    spare = np.cumsum((top - lengths[rests]) + (lengths[rests] - half))
    cut[rests[: 0 if room <= 0 else np.searchsorted(spare, room) + 1]] = True
    return cut


class Bins:
    """Windows with gaps; a piece goes to the smallest gap that holds it. Gaps in use are a bit set."""

    def __init__(self):
        self.size: list[int] = []
        self.full: list[list[int]] = []
        self.fresh()

    def fresh(self) -> None:
        """No window so far takes any more pieces."""
        self.gaps, self.used = {}, 0

    def open(self, size: int) -> int:
        self.size.append(size)
        self.full.append([])
        self._offer(size, len(self.size) - 1)
        return len(self.size) - 1

    def _offer(self, gap: int, at: int) -> None:
        if gap:
            self.gaps.setdefault(gap, []).append(at)
            self.used |= 1 << gap

    def put(self, item: int, length: int) -> bool:
        fits = self.used >> length
        if not fits:
            return False
        gap = length + (fits & -fits).bit_length() - 1
        at = self.gaps[gap].pop()
        if not self.gaps[gap]:
            self.used &= ~(1 << gap)
        self.full[at].append(item)
        self._offer(gap - length, at)
        return True

    def fill(self, items: list[int], lengths: list[int], size: int | None = None) -> list[int]:
        """Put items, longest first, and open windows of `size` for those that fit nowhere; without a size, return those."""
        left = []
        for x in sorted(items, key=lambda i: (-lengths[i], i)):
            if not self.put(x, lengths[x]):
                if size is None:
                    left.append(x)
                else:
                    self.open(size)
                    self.put(x, lengths[x])
        return left


def pack_tiers(lengths: np.ndarray, tiers: tuple = TIERS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sequence of each piece, offset in it, size of its sequence)."""
    n, size = len(lengths), lengths.tolist()
    tier = np.searchsorted(np.array(tiers), lengths)
    bins, left = Bins(), list(range(n))
    for t in reversed(range(len(tiers))):
        own, below = [i for i in left if tier[i] == t], [i for i in left if tier[i] < t]
        bins.fresh()
        bins.fill(own, size, tiers[t])
        left = bins.fill(below, size)
    # Short windows that are not full become blocks of sequences of the longest size.
    used = [sum(size[i] for i in items) for items in bins.full]
    blocks = [k for k, s in enumerate(bins.size) if s < tiers[-1] and used[k] < s]
    chained = Bins()
    chained.fill(blocks, used, tiers[-1])
    chosen = set(blocks)
    sequences = [(s, items) for k, (s, items) in enumerate(zip(bins.size, bins.full, strict=True)) if k not in chosen]
    sequences += [(s, [i for k in parts for i in bins.full[k]]) for s, parts in zip(chained.size, chained.full, strict=True)]
    where, offset, whole = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, (s, items) in enumerate(sequences):
        own = np.array(items)
        where[own], whole[own] = k, s
        offset[own] = np.cumsum(lengths[own]) - lengths[own]
    return where, offset, whole


def step_groups(where: np.ndarray, lengths: np.ndarray, group: int = STEP_GROUP) -> np.ndarray:
    """A step group for each window: by falling attention cost, dealt to and fro over the groups."""
    cost = np.bincount(where, lengths.astype(np.float64) ** 2)
    n_groups = -(-len(cost) // group)
    place = np.empty(len(cost), np.int64)
    place[np.argsort(-cost, kind="stable")] = np.arange(len(cost))
    lap, k = place // n_groups, place % n_groups
    return np.where(lap % 2 == 0, k, n_groups - 1 - k)


def along(where: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Windows renumbered by the place of their longest piece (the first of them), for pieces that come in order."""
    first = np.lexsort((np.arange(len(where)), -lengths, where))
    opens = first[np.concatenate(([True], where[first][1:] != where[first][:-1]))] if len(where) else first
    number = np.empty(len(opens), np.int64)
    number[np.argsort(opens, kind="stable")] = np.arange(len(opens))
    return number[where]


def ranked(pieces: DataFrame, placed: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """pieces with `rank`, a gapless number from 0 along the documents' positions: pieces(_row) of one document stay together.

    Only short rows travel: positions are worked out on one row a document and joined back on its row number. Pieces are
    numbered in ranges of positions, which are shifted by the pieces before them.
    """
    docs = pieces.where("start = 0").select("doc_id", "source", "_row")
    at = placed(docs).select(F.col("row._row").alias("_row"), "position")
    rows = stored(pieces.join(at, "_row").withColumn("_range", F.floor(F.col("position") / SHARD_PIECES)), "placed")
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    # One row for each SHARD_PIECES documents.
    sizes = rows.groupBy("_range").count().select("_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    inside = Window.partitionBy("_range").orderBy("position", "start")
    return rows.withColumn("_n", F.row_number().over(inside) - 1).join(sizes, "_range").withColumn("rank", F.col("_n") + F.col("_before"))


def packed(docs: DataFrame, json_path: str, ranks_path: str, placed: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """Every piece with sequence_id, offset, tier (of the piece's length), window (the sequence's size) and step_group. The token
    pass runs once; only piece rows are shuffled.

    placed: gives documents (with doc_id and source) a position, as mixing.pfair_mix does. Then shards are consecutive
    ranges of positions, and sequence ids rise along them; else shards are taken by a hash of the row, so that rows which
    repeat an id, or have none, are spread.
    """
    docs = docs.withColumn("_row", F.monotonically_increasing_id())
    pieces = stored(tokenized_pieces(docs, json_path, ranks_path, ("source", "_row") if placed else ("_row",)), "pieces")

    def shard(rows: pa.Table) -> pa.Table:
        rows = rows.sort_by([(c, "ascending") for c in order])
        cut = cut_rests(rows["length"].to_numpy())
        # A piece that is cut is two: its head takes the next tier's size, its tail the rest.
        of = np.repeat(np.arange(len(cut)), 1 + cut)
        tail = np.concatenate(([False], of[1:] == of[:-1]))
        head = cut[of] & ~tail
        whole = rows["length"].to_numpy()[of]
        length = np.where(head, TIERS[-2], np.where(tail, whole - TIERS[-2], whole))
        crc = [rows[c].to_numpy()[of] for c in ("ids_crc32", "head_crc32", "tail_crc32")]
        where, offset, size = pack_tiers(length)
        if placed:
            where = along(where, length)
        base = rows["shard"][0].as_py() << 32
        groups = step_groups(where, length)
        values = {
            "start": rows["start"].to_numpy()[of] + np.where(tail, TIERS[-2], 0), "length": length,
            "ids_crc32": np.where(head, crc[1], np.where(tail, crc[2], crc[0])).astype(np.int64), "sequence_id": base + where, "offset": offset,
            "tier": np.array(TIERS)[np.searchsorted(np.array(TIERS), length)], "window": size, "step_group": base + groups[where],
        }
        kept = rows.take(pa.array(of)).select(["doc_id", "doc_tokens"])
        return pa.table([kept[c] if c in kept.column_names else pa.array(values[c], pa.int64()) for c in names], names)

    names = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "tier", "window", "step_group"]
    if placed:
        order = ["rank"]
        rows = ranked(pieces, placed).withColumn("shard", F.floor(F.col("rank") / SHARD_PIECES))
    else:
        order = ["doc_id", "start", "ids_crc32", "_row"]
        shards = max(1, -(-pieces.count() // SHARD_PIECES))
        rows = pieces.withColumn("shard", F.pmod(F.xxhash64("doc_id", "start", "_row"), F.lit(shards)))
    return rows.groupBy("shard").applyInArrow(shard, ", ".join(f"{c} long" for c in names))
