"""Best-fit packing of token pieces into sequences of a fixed length, improved by a swap-based local search.

Pieces are dealt evenly into blocks of a bounded number of rows.  In a block, best fit by decreasing length opens the
sequences; then documents move or change places one-for-one or two-for-one between underfull sequences, each step
raising the sum of squared fills.  The emptiest sequence gives first, as many tokens as it can.  The search ends when as
many sequences are left as all tokens need at least, or when no two underfull sequences of the block have such a step.
At most one sequence of a block is half full or less (two would have been joined); those are packed again across blocks.

Null and empty texts are one end id long.  Ties are broken by place; repeated rows are packed as rows of their own.
"""

from __future__ import annotations

import math
import zlib
from functools import reduce
from heapq import heapify, heappop, heappush
from operator import or_

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.llm.byte_pairs import ENCODE_BYTES, ENCODE_ROWS, encoder
from longbox.llm.shared import map_batches, stored

#: Rows that one task packs together.
BLOCK_ROWS = 20_000
PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"
PACKED = f"{PIECES}, sequence_id long, offset long, fill long"


def token_pieces(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, piece, start, length, ids_crc32``: ids and ``end_id`` of each text, cut only where longer than ``limit``; the first piece takes the remainder."""
    end = int(end_id).to_bytes(4, "little")

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for doc_id, ids in zip(batch.column(0).to_pylist(), encoder(tokenizer).encode_bytes(batch.column(1)), strict=True):
            ids += end
            n = len(ids) // 4
            edges = [0, *range(n % limit or limit, n + 1, limit)]
            for k, (a, b) in enumerate(zip(edges, edges[1:], strict=False)):
                for column, value in zip(out, (doc_id, k, a, b - a, zlib.crc32(ids[4 * a : 4 * b])), strict=True):
                    column.append(value)
        kinds = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64())
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, PIECES, ENCODE_ROWS, ENCODE_BYTES)


def best_fit(lengths: list[int], limit: int) -> list[list[int]]:
    """Sequences of item numbers: items by decreasing length, each into the fullest sequence that still takes it."""
    bins: list[list[int]] = []
    by_room: list[list[int]] = [[] for _ in range(limit + 1)]
    rooms = 0  # bit r is set where a sequence has room r
    for i in sorted(range(len(lengths)), key=lambda k: -lengths[k]):
        n = lengths[i]
        fits = rooms >> n
        if fits:
            room = n + (fits & -fits).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                rooms ^= 1 << room
        else:
            room, b = limit, len(bins)
            bins.append([])
        bins[b].append(i)
        if room > n:
            by_room[room - n].append(b)
            rooms |= 1 << (room - n)
    return bins


class _Underfull:
    """Underfull sequences and what they can give: nothing, a piece or a pair of pieces, one of each size.

    ``sums[kind][t]`` has bit s set where a sequence can give size s of that kind and would then have t tokens of room,
    ``owners[kind, s, t]`` names those sequences.
    """

    def __init__(self, bins: list[list[int]], lengths: list[int], limit: int):
        self.bins, self.lengths, self.limit = bins, lengths, limit
        self.room = [limit - sum(lengths[i] for i in b) for b in bins]
        self.sums = [[0] * (2 * limit + 1) for _ in range(2)]
        self.owners: dict[tuple[int, int, int], dict[int, None]] = {}
        self.gives: dict[int, tuple[dict[int, list[int]], dict[int, list[int]]]] = {}
        for b in range(len(bins)):
            self.enter(b)

    def enter(self, b: int) -> None:
        """Note what ``b`` can give, unless it is empty or full.  It has at most about the square root of twice ``limit`` sizes."""
        if not self.bins[b] or not self.room[b]:
            return
        sizes: dict[int, list[int]] = {}
        for i in self.bins[b]:
            sizes.setdefault(self.lengths[i], []).append(i)
        order = sorted(sizes)
        pairs = {n + m: [sizes[n][0], sizes[m][-1]] for k, n in enumerate(order) for m in order[k:] if n < m or len(sizes[n]) > 1}
        self.gives[b] = {0: [], **{n: x[:1] for n, x in sizes.items()}}, pairs
        for kind, give in enumerate(self.gives[b]):
            for s in give:
                self.owners.setdefault((kind, s, s + self.room[b]), {})[b] = None
                self.sums[kind][s + self.room[b]] |= 1 << s

    def leave(self, b: int) -> None:
        for kind, give in enumerate(self.gives.pop(b, ())):
            for s in give:
                there = self.owners[kind, s, t := s + self.room[b]]
                del there[b]
                if not there:
                    del self.owners[kind, s, t]
                    self.sums[kind][t] ^= 1 << s

    def step(self, low: int) -> int | None:
        """Take the step from ``low`` that moves most tokens among those that raise the sum of squared fills, and of those the one to the fullest sequence; the other sequence, or None if there is no step.

        With n tokens coming to a sequence and s going from it, it must have room for n - s, and end fuller than ``low``
        is now: its room and s add up to at least n, and to less than n and the room of ``low``.
        """
        mine, room = self.gives[low], self.room[low]
        self.leave(low)
        gain, found = 0, None
        for come, goes in ((0, 0), (0, 1), (1, 0)):
            for n in mine[come]:
                if n > gain:
                    able = reduce(or_, self.sums[goes][n : n + room], 0) & ((1 << (n - gain)) - 1)
                    if able:
                        s = (able & -able).bit_length() - 1
                        gain, found = n - s, (come, goes, n, s)
        if found is None:
            self.enter(low)
            return None
        come, goes, n, s = found
        t = next(t for t in range(n, n + room) if self.sums[goes][t] >> s & 1)
        b = next(iter(self.owners[goes, s, t]))
        brought, gone = mine[come][n], self.gives[b][goes][s]
        self.leave(b)
        self.bins[b] = [i for i in self.bins[b] if i not in gone] + brought
        self.bins[low] = [i for i in self.bins[low] if i not in brought] + gone
        self.room[b] -= gain
        self.room[low] += gain
        for x in (b, low):
            self.enter(x)
        return b


def local_search(bins: list[list[int]], lengths: list[int], limit: int) -> list[list[int]]:
    """Moves and exchanges between underfull sequences until none raises the sum of squared fills, or as few sequences are left as all tokens need; empty sequences are left out.

    The emptiest sequence gives first.  One without a step waits until others have changed.
    """
    least = -(-sum(lengths) // limit)
    state = _Underfull(bins, lengths, limit)
    left = sum(map(bool, bins))
    changed = True
    while changed and left > least:
        changed = False
        waiting = [(-state.room[b], b) for b in state.gives]
        heapify(waiting)
        while waiting and left > least:
            room, low = heappop(waiting)
            if low in state.gives and -room == state.room[low] and (b := state.step(low)) is not None:
                changed = True
                left -= not bins[low]
                for x in (low, b):
                    if x in state.gives:
                        heappush(waiting, (-state.room[x], x))
    return [b for b in bins if b]


def _packed(table: pa.Table, base: int, limit: int) -> pa.Table:
    lengths = table.column("length").to_pylist()
    bins = local_search(best_fit(lengths, limit), lengths, limit)
    n = len(lengths)
    sequence, offset, fill = np.zeros(n, np.int64), np.zeros(n, np.int64), np.zeros(n, np.int64)
    for k, b in enumerate(bins):
        at = 0
        for i in b:
            sequence[i], offset[i] = base + k, at
            at += lengths[i]
        fill[b] = at
    return table.select(["doc_id", "piece", "start", "length", "ids_crc32"]).append_column("sequence_id", pa.array(sequence)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))


def _pack_blocks(rows: DataFrame, limit: int, base: int) -> DataFrame:
    def run(key: tuple[pa.Scalar, ...], table: pa.Table) -> pa.Table:
        return _packed(table, base + (key[0].as_py() << 24), limit)

    return rows.groupBy("block").applyInArrow(run, PACKED)


def pack(pieces: DataFrame, limit: int = 2048, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """``pieces`` with ``sequence_id`` and ``offset``.  ``pieces`` must be a table that reads alike each time."""
    n = pieces.count()
    blocks = max(1, math.ceil(n / block_rows))
    dealt = pieces.withColumn("block", F.pmod(F.monotonically_increasing_id(), F.lit(blocks)))
    packed = _pack_blocks(dealt, limit, 0)
    columns = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]
    if blocks == 1:
        return packed.select(columns)
    packed = stored(packed, "packed")
    low = packed.where(F.col("fill") * 2 <= limit).drop("offset", "fill")
    # A block leaves at most one such sequence, of at most limit / 2 pieces: groups of blocks stay bounded too.
    per = max(1, block_rows * 2 // limit)
    again = low.withColumn("block", F.expr(f"(sequence_id >> 24) div {per}")).drop("sequence_id")
    return packed.where(F.col("fill") * 2 > limit).select(columns).unionByName(_pack_blocks(again, limit, 1 << 60).select(columns))


def packed_documents(docs: DataFrame, tokenizer: str, limit: int = 2048, end_id: int = 0) -> DataFrame:
    """All pieces of ``docs`` with their places; ids are counted once and only lengths and digests are shuffled."""
    return pack(stored(token_pieces(docs, tokenizer, limit, end_id), "pieces"), limit)
