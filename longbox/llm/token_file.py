"""Token ids in a word-aligned binary format.

Ids are packed Simple-8b fashion: each 64-bit word has a selector of 4 bits and 60 bits that hold as many ids as fit
one width.  Widths end at 20 bits; a larger id is written as the escape (all ones of 20 bits) and stands in a list of
exceptions of its block.  A block holds whole documents, in order, with their ids' counts and its own offset in its
part, so that a block decodes alone and by whole arrays.  Files are Parquet tables of blocks written by Spark's
committer: a retried or repeated task leaves one copy.  Parts follow document order, and ``part, seq`` order the blocks.
Beside the blocks stands an index of the parts with the ids before each: any block can be placed by its offset and its
part's.

Null texts count as empty; an empty document holds the end id alone.  Null document ids sort first.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longbox.llm.byte_pairs import ENCODE_BYTES, ENCODE_ROWS, encoder
from longbox.llm.shared import in_arrow, map_batches, new_path, slices

#: Ids in a word, bits of each; the place in the list is the selector.
LAYOUTS = ((60, 1), (30, 2), (20, 3), (15, 4), (12, 5), (10, 6), (8, 7), (7, 8), (6, 10), (5, 12), (4, 15), (3, 20))
ESCAPE = (1 << 20) - 1
JUMPS = 6
#: Ids after which a block is closed.
BLOCK_IDS = 1 << 16
BLOCKS = "part int, seq int, start long, doc_ids array<long>, counts array<int>, n_ids long, words binary, escape_at array<int>, escape_ids array<long>"
PARTS = "part int, part_start long, n_ids long, n_blocks long"


@cache
def _narrowest() -> np.ndarray:
    """For each id up to the escape, the narrowest layout that takes it."""
    bits = np.ceil(np.log2(np.arange(1 << 20) + 1)).astype(np.int64)
    return np.searchsorted([b for _, b in LAYOUTS], bits).astype(np.uint8)


def pack(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Words (uint64), and places and values of escaped ids.

    The next word's selector is the one that holds most ids.  For every place the longest run of ids that fit a
    width is found at once, and so is the place ``1 << JUMPS`` words on; the loop that is left takes such steps, and
    the words between are filled in.
    """
    ids = np.asarray(ids, np.uint64)
    escape_at = np.flatnonzero(ids >= ESCAPE)
    escape_ids = ids[escape_at]
    if len(escape_at):
        ids = ids.copy()
        ids[escape_at] = ESCAPE
    n = len(ids)
    if not n:
        return np.zeros(0, np.uint64), escape_at, escape_ids
    most = {1: np.concatenate([_narrowest()[ids], np.zeros(60, np.uint8)])}  # widest of so many ids from each place on
    for count in (2, *(c for c, _ in reversed(LAYOUTS))):
        half = max(k for k in most if 2 * k >= count)
        a = most[half]
        most[count] = np.maximum(a[: len(a) - (count - half)], a[count - half :])
    selector = np.full(n, len(LAYOUTS) - 1, np.uint8)
    for s in range(len(LAYOUTS) - 2, -1, -1):
        np.putmask(selector, most[LAYOUTS[s][0]][:n] <= s, np.uint8(s))
    step = np.minimum(np.arange(n) + np.array([c for c, _ in LAYOUTS], np.int64)[selector], n)
    jumps = [np.append(step, n)]
    for _ in range(JUMPS):
        jumps.append(jumps[-1][jumps[-1]])
    far, starts, i = jumps.pop(), [], 0
    while i < n:
        starts.append(i)
        i = int(far[i])
    at = np.array(starts, np.int64)
    for jump in reversed(jumps):
        at = np.stack([at, jump[at]], axis=1).ravel()
    at = at[at < n]
    chosen = selector[at]
    words = chosen.astype(np.uint64) << np.uint64(60)
    padded = np.concatenate([ids, np.zeros(60, np.uint64)])
    for s, (count, bits) in enumerate(LAYOUTS):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            values = padded[at[rows, None] + np.arange(count)]
            words[rows] |= np.bitwise_or.reduce(values << (np.arange(count, dtype=np.uint64) * np.uint64(bits)), axis=1)
    return words, escape_at, escape_ids


def unpack(words: np.ndarray, n: int, escape_at: np.ndarray, escape_ids: np.ndarray) -> np.ndarray:
    """The ``n`` ids of a block (uint64), a whole array for each selector."""
    words = np.asarray(words, np.uint64)
    chosen = (words >> np.uint64(60)).astype(np.int64)
    counts = np.array([c for c, _ in LAYOUTS], np.int64)[chosen]
    at = np.cumsum(counts) - counts
    out = np.zeros(int(counts.sum()) if len(counts) else 0, np.uint64)
    for s, (count, bits) in enumerate(LAYOUTS):
        rows = np.flatnonzero(chosen == s)
        if len(rows):
            shifts = np.arange(count, dtype=np.uint64) * np.uint64(bits)
            out[at[rows, None] + np.arange(count)] = (words[rows, None] >> shifts) & np.uint64((1 << bits) - 1)
    out = out[:n]
    out[escape_at] = escape_ids
    return out


def _block(part: int, seq: int, start: int, doc_ids: list, pieces: list[bytes]) -> pa.RecordBatch:
    ids = np.frombuffer(b"".join(pieces), "<u4")
    words, at, escaped = pack(ids)
    columns = [[part], [seq], [start], [doc_ids], [[len(p) // 4 for p in pieces]], [len(ids)], [words.astype("<u8").tobytes()], [at.tolist()], [escaped.tolist()]]
    kinds = [pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.int64(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int64())]
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds, strict=True)], ["part", "seq", "start", "doc_ids", "counts", "n_ids", "words", "escape_at", "escape_ids"])


def write_ids(docs: DataFrame, path: str, tokenizer: str, end_id: int = 2, parts: int | None = None, id_col: str = "doc_id", text_col: str = "text", block_ids: int = BLOCK_IDS) -> None:
    """Write ids of each text and ``end_id``, in ascending order of ``id_col``: blocks and the index of parts, below ``path``.

    The one shuffle deals whole texts out by ranges of the document id; texts are encoded after it, so that the
    sample that finds the ranges does not tokenise.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    order = ["doc_id", F.xxhash64("text")]
    dealt = (rows.repartitionByRange(parts, *order) if parts else rows.repartitionByRange(*order)).sortWithinPartitions(*order)
    end = int(end_id).to_bytes(4, "little")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, seq, before, ids, pieces, size = TaskContext.get().partitionId(), 0, 0, [], [], 0
        tok = encoder(tokenizer)
        for whole in batches:
            for batch in slices(whole, ENCODE_ROWS, ENCODE_BYTES):
                found = tok.encode_bytes(batch.column(1))
                for doc_id, piece in zip(batch.column(0).to_pylist(), found, strict=True):
                    ids.append(doc_id)
                    pieces.append(piece + end)
                    size += len(piece) // 4 + 1
                    if size >= block_ids:
                        yield _block(part, seq, before, ids, pieces)
                        seq, before, ids, pieces, size = seq + 1, before + size, [], [], 0
        if ids:
            yield _block(part, seq, before, ids, pieces)

    in_arrow(dealt, run, BLOCKS).write.parquet(f"{path}/blocks")
    parts_of(docs.sparkSession.read.schema(BLOCKS).parquet(f"{path}/blocks")).write.parquet(f"{path}/parts")


def parts_of(blocks: DataFrame) -> DataFrame:
    """The index: a row for each part with the ids before it.  It has as many rows as files."""
    sums = blocks.groupBy("part").agg(F.sum("n_ids").alias("n_ids"), F.count(F.lit(1)).alias("n_blocks"))
    before = F.coalesce(F.sum("n_ids").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return sums.select("part", before.alias("part_start"), "n_ids", "n_blocks").coalesce(1)


def read_ids(df: DataFrame) -> DataFrame:
    """``(part, seq, nth, doc_id, ids array<long>)`` of a table of blocks: the ids of every document."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], [], []]
        for b in batch.to_pylist():
            ids = unpack(np.frombuffer(b["words"], "<u8"), b["n_ids"], np.array(b["escape_at"], np.int64), np.array(b["escape_ids"], np.uint64)).astype(np.int64)
            for nth, (doc_id, piece) in enumerate(zip(b["doc_ids"], np.split(ids, np.cumsum(b["counts"])[:-1]), strict=True)):
                for column, value in zip(out, (b["part"], b["seq"], nth, doc_id, piece), strict=True):
                    column.append(value)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, (pa.int32(), pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64())), strict=True)], ["part", "seq", "nth", "doc_id", "ids"])

    return map_batches(df, run, "part int, seq int, nth int, doc_id long, ids array<long>")


def _digests(df: DataFrame) -> DataFrame:
    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list] = [[], [], [], []]
        for b in batch.to_pylist():
            ids = unpack(np.frombuffer(b["words"], "<u8"), b["n_ids"], np.array(b["escape_at"], np.int64), np.array(b["escape_ids"], np.uint64)).astype("<u4")
            ends = np.cumsum(b["counts"]).tolist()
            start, base = 0, b["start"] + b["part_start"]
            for doc_id, stop in zip(b["doc_ids"], ends, strict=True):
                for column, value in zip(out, (doc_id, base + start, stop - start, zlib.crc32(ids[start:stop])), strict=True):
                    column.append(value)
                start = stop
        return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in out], ["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_batches(df, run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def file_index(blocks: DataFrame, parts: DataFrame) -> DataFrame:
    """Per document of a table of blocks: ``doc_id, start, n_tokens, ids_crc32``, from the decoded ids.

    The index of parts is broadcast: it has a row for each file.
    """
    return _digests(blocks.join(F.broadcast(parts.select("part", "part_start")), "part"))


def written_and_read(docs: DataFrame, tokenizer: str, end_id: int = 2, parts: int | None = None) -> DataFrame:
    """Write ``docs`` to a new place in the shared folder and return the index read back from its files."""
    spark = docs.sparkSession
    path = new_path(spark, "token-ids")
    write_ids(docs, path, tokenizer, end_id, parts)
    return file_index(spark.read.schema(BLOCKS).parquet(f"{path}/blocks"), spark.read.schema(PARTS).parquet(f"{path}/parts"))
