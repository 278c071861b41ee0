"""Document fingerprints: quartile bucket digests of hashed byte triplets, compared by a bounded difference score.

A window of five bytes of a text's UTF-8 gives six triplets: its first byte with each two of the other four.  Each kind of
triplet is hashed with a salt of its own into one of 256 buckets, and a text's buckets are counted.  A bucket is written
as how many of the text's three quartiles its count exceeds (two bits); a head holds the length on a logarithmic scale and
how the lower quartiles compare with the upper one.  The difference of two digests sums what buckets, lengths and ratios
differ by; it is bounded by what unrelated digests differ by, and the likeness is one less that share.

Texts change places with their neighbours only at the edges of parts: a range sort by id puts next documents into one
stream, a task reads on by one row, and only the first and last text of a part meet in a second, small join.

Null texts are empty.  Texts of fewer than three bytes have no triplets: their buckets are all 0, and the length tells
them apart.  Equal texts have equal fingerprints, whatever their ids.  Rows are ordered by id (null ids last), then
by the hash of the text; rows alike in both are interchangeable, and each is the next of the one before.  A sole row is
its own next.  An empty table gives no rows.  Columns other than id and text are not read.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longbox.llm.shared import in_arrow, slices, stored

BUCKETS = 256
#: Places in a window of five bytes that make triplets with its first byte.
KINDS = ((1, 2), (1, 3), (2, 3), (1, 4), (2, 4), (3, 4))
#: What two unrelated digests differ by in a bucket: steps of 0 to 3 with 3 counted as 6, over all pairs of quarters.
BUCKET_DIFFERENCE = 26 / 16
BOUND = BUCKETS * BUCKET_DIFFERENCE
#: Score of a step on the length scale and of a step of a quartile ratio, and the most that each can add.
STEP_SCORE, MOST_STEPS = 4, 12
#: Bytes whose triplets are counted at once.
CHUNK = 1 << 20
_STEP = np.array([0, 1, 2, 6], np.int64)
FINGERPRINTED = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
_OPEN = f"part int, role string, {FINGERPRINTED}, text string"


def bucket_counts(data: bytes) -> np.ndarray:
    """How often each bucket is hit by the triplets of ``data``; shorter windows at the end give what fits in them."""
    counts = np.zeros(BUCKETS, np.int64)
    for start in range(0, max(1, len(data) - 2), CHUNK):
        b = np.frombuffer(data, np.uint8, min(CHUNK + 4, len(data) - start), start).astype(np.uint32)
        firsts = min(CHUNK, len(data) - start)
        for salt, (i, j) in enumerate(KINDS):
            n = min(firsts, len(b) - j)
            if n > 0:
                x = b[:n] | b[i : i + n] << np.uint32(8) | b[j : j + n] << np.uint32(16) | np.uint32(salt << 24)
                x = (x ^ x >> np.uint32(15)) * np.uint32(0x85EBCA6B)
                x = (x ^ x >> np.uint32(13)) * np.uint32(0xC2B2AE35)
                counts += np.bincount(x >> np.uint32(24), minlength=BUCKETS)
    return counts


def fingerprint(data: bytes) -> str:
    """Hex: a byte of length, a byte of two quartile ratios, then two bits a bucket."""
    counts = bucket_counts(data)
    low, mid, high = (int(x) for x in np.partition(counts, (63, 127, 191))[[63, 127, 191]])
    length = min(255, round(math.log(1 + len(data), 1.1)))
    ratios = (16 * min(15, 16 * low // high) + min(15, 16 * mid // high)) if high else 0
    codes = ((counts > low).astype(np.uint8) + (counts > mid) + (counts > high)).reshape(-1, 4)
    body = codes[:, 0] << 6 | codes[:, 1] << 4 | codes[:, 2] << 2 | codes[:, 3]
    return bytes([length, ratios]).hex() + body.tobytes().hex()


def difference(a: str, b: str) -> float:
    """Of two fingerprints, from 0 (alike) to ``BOUND``."""
    x, y = np.frombuffer(bytes.fromhex(a), np.uint8), np.frombuffer(bytes.fromhex(b), np.uint8)
    steps = [abs(int(x[0]) - int(y[0]))] + [abs((int(x[1]) >> s & 15) - (int(y[1]) >> s & 15)) for s in (0, 4)]
    shifts = np.array([6, 4, 2, 0], np.uint8)
    p, q = (z[2:, None] >> shifts & 3 for z in (x, y))
    score = int(_STEP[np.abs(p.astype(np.int64) - q)].sum()) + STEP_SCORE * sum(min(MOST_STEPS, s) for s in steps)
    return min(score, BOUND)


def likeness(a: str, b: str) -> float:
    """1 for equal fingerprints, 0 for those that differ as unrelated ones do or more."""
    return 1 - difference(a, b) / BOUND


def edited(text: str, following: str) -> str:
    """``text`` with its last quarter replaced by as many first characters of ``following``, or all it has."""
    n = len(text) // 4
    return text[: len(text) - n] + following[:n]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``doc_id, n_chars, fingerprint`` of each row, where it lies: nothing is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                texts = [x or "" for x in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([fingerprint(t.encode()) for t in texts])], ["doc_id", "n_chars", "fingerprint"])

    return in_arrow(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_chars long, fingerprint string")


def _row(doc_id: int | None, text: str, own: str, following: str, following_print: str) -> tuple:
    new = edited(text, following).encode()
    new_print = fingerprint(new)
    return doc_id, len(text), hashlib.sha256(new).hexdigest(), own, new_print, likeness(own, new_print), likeness(own, following_print)


def compared(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Each row's fingerprint beside that of its text edited with the next row's, and the likenesses of both."""
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.coalesce(text_col, F.lit("")).alias("text"))
    ordered = rows.withColumns({"mark": F.xxhash64("text"), "row": F.monotonically_increasing_id()})
    order = [F.col("doc_id").asc_nulls_last(), F.col("mark"), F.col("row")]
    ordered = ordered.repartitionByRange(*order).sortWithinPartitions(*order).select(F.spark_partition_id().alias("part"), "doc_id", "text")
    schema = pa.schema([("part", pa.int32()), ("role", pa.string()), ("doc_id", pa.int64()), ("n_chars", pa.int64()), *((c, pa.string()) for c in ("edited_sha256", "fingerprint", "edited_fingerprint")), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("text", pa.string())])

    def batch_of(out: list[tuple]) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], f.type) for k, f in enumerate(schema)], schema=schema)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None  # the row before, with its fingerprint
        for batch in batches:
            for part in slices(batch):
                out = []
                for number, doc_id, text in zip(*(part.column(k).to_pylist() for k in range(3)), strict=True):
                    own = fingerprint(text.encode())
                    if held is None:
                        out.append((number, "first", doc_id, None, None, own, None, None, None, text))
                    else:
                        out.append((number, "row", *_row(*held[1:], text, own), None))
                    held = number, doc_id, text, own
                yield batch_of(out)
        if held is not None:
            number, doc_id, text, own = held
            yield batch_of([(number, "last", doc_id, None, None, own, None, None, None, text)])

    told = stored(in_arrow(ordered, run, _OPEN), "fingerprints")
    # One row a part: which part follows, the first after the last.
    parts = told.where("role = 'first'").select("part").withColumn("k", F.row_number().over(Window.partitionBy(F.lit(0)).orderBy("part")) - 1)
    n = parts.count()
    after = parts.select(F.col("part").alias("following"), F.pmod(F.col("k") - 1, F.lit(max(1, n))).alias("k"))
    pairs = parts.join(after, "k").select("part", "following")
    last = told.where("role = 'last'").select("part", "doc_id", "text", "fingerprint").join(pairs, "part")
    first = told.where("role = 'first'").select(F.col("part").alias("following"), F.col("text").alias("next_text"), F.col("fingerprint").alias("next_print"))
    edges = last.join(first, "following").select("doc_id", "text", "fingerprint", "next_text", "next_print")
    names = [f.name for f in schema][2:-1]

    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = [_row(*r) for r in zip(*(c.to_pylist() for c in batch.columns), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array([r[k] for r in out], schema.field(c).type) for k, c in enumerate(names)], names)

    return told.where("role = 'row'").select(*names).unionByName(in_arrow(edges, close, FINGERPRINTED).select(*names))
