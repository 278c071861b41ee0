"""Embedding whitening by a tiled covariance.

Components become whole numbers x = floor(scale * c) + shift, so that counts, sums and products of them are exact and do
not depend on how rows were dealt.  Vectors of a task are gathered into row-blocks and cut into column blocks of ``TILE``
dimensions.  Column blocks are shuffled by row-block; a task multiplies each pair of column blocks of a row-block, which
is a tile of the covariance, and adds it to that tile's sum.  Sums of tasks are added tile by tile, in two steps so that no
group grows with the number of tasks, and the driver assembles tiles: it holds numbers of dimensions squared, never rows.

Before they are multiplied, vectors are centred by the whole number nearest to each dimension's mean; what then is left of
the mean, less than one, is taken off the sums of products in whole numbers too, so each entry of the covariance is its
exact value rounded once.  Its eigenvectors, by falling eigenvalue, are the components; the entry of largest size of each
is positive.  Whitened values are projections of x less its mean, over the root of the eigenvalue.

Vectors that are null, or hold a null or a component that is not finite or of 2^48 / ``scale`` or more in size, take no
part, nor do vectors of another length than the most frequent one (of equally frequent lengths, the longest).  Repeated
rows and ids count as rows of their own; null ids are kept.  A component whose eigenvalue is zero up to rounding, as of
equal vectors or a sole one, has a null ``whitened`` and no part in ``identity_error``; that is null if none is left, as is
``explained`` where nothing varies.  A deviation beyond 64 bits is null.  An empty table gives no rows.  Columns other
than id and vector are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from fractions import Fraction
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.llm.shared import in_arrow, slices, stored

#: Dimensions of a column block, and the most bytes of a row-block's vectors.
TILE = 64
BLOCK_BYTES = 4 << 20
#: Tasks' sums of a tile that are added together in the first step, at least: one in so many groups.
SPREAD = 128
_LARGEST = float(1 << 48)
#: Sums of products are sent as three numbers of 32 bits and more, which sums of up to 2^31 of them do not overflow.
_LIMB, _LIMBS = 32, 3


class Fitted(NamedTuple):
    """What rows are whitened by: count, sums of x, components (a column each), eigenvalues, and the trace."""

    n: int
    sums: list[int]
    components: np.ndarray
    values: np.ndarray
    trace: float


def whole(column: pa.Array, length: int | None, scale: int, shift: int) -> dict[int, tuple[np.ndarray, np.ndarray]]:
    """x of the vectors of a batch that take part, by length: their rows in the batch, and a row of x for each."""
    lengths = pc.fill_null(pc.list_value_length(column), -1).to_numpy(zero_copy_only=False)
    out = {}
    for n in np.unique(lengths).tolist() if length is None else [length]:
        rows = np.flatnonzero(lengths == n)
        if n >= 0 and len(rows):
            values = column.take(pa.array(rows)).flatten().cast(pa.float64()).to_numpy(zero_copy_only=False)
            x = np.floor(values.reshape(len(rows), n) * scale)
            good = (np.abs(x) < _LARGEST).all(1)  # false for NaN, which stands for null as well
            if good.any():
                out[n] = rows[good], x[good].astype(np.int64) + shift
    return out


def _sums(vectors: DataFrame, scale: int, shift: int) -> tuple[int, list[int]]:
    """Number of vectors that take part and exact sums of their x, for the length that most have."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for length, (rows, x) in whole(part.column(1), None, scale, shift).items():
                    yield pa.RecordBatch.from_arrays([pa.array([length], pa.int32()), pa.array([len(rows)], pa.int64()), pa.array([x.sum(0).tolist()], pa.list_(pa.int64()))], ["length", "n", "sums"])

    parts = in_arrow(vectors, run, "length int, n long, sums array<long>")
    lengths = parts.select("length", "n", F.posexplode_outer("sums").alias("k", "s")).groupBy("length", "k").agg(F.sum("n").alias("n"), F.sum(F.col("s").cast("decimal(38,0)")).alias("s"))
    found = stored(lengths, "sums")
    most = found.groupBy("length").agg(F.max("n").alias("n")).orderBy(F.desc("n"), F.desc("length")).first()
    if most is None:
        return 0, []
    rows = found.where((F.col("length") == most["length"]) & F.col("k").isNotNull()).select("k", "s").collect()  # one row a dimension
    return most["n"], [int(s) for _, s in sorted((r["k"], r["s"]) for r in rows)]


def products(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Exact x'y of whole numbers: in double precision where that is exact, else in 64 bits, else in Python's numbers."""
    size = int(max(np.abs(x).max(initial=0), np.abs(y).max(initial=0))) ** 2 * len(x)
    if size < 1 << 53:
        return (x.astype(np.float64).T @ y.astype(np.float64)).astype(np.int64)
    return x.T @ y if size < 1 << 62 else x.astype(object).T @ y.astype(object)


def _limbs(sums: np.ndarray) -> list[int]:
    """Entries in limbs, lowest first, the highest signed."""
    low = (1 << _LIMB) - 1
    out = []
    for k in range(_LIMBS):
        out += (sums & low if k < _LIMBS - 1 else sums).ravel().tolist()
        sums = sums >> _LIMB
    return out


def covariance(vectors: DataFrame, n: int, sums: list[int], scale: int, shift: int) -> np.ndarray:
    """The covariance of x, divisor ``n``, tile by tile."""
    d, means = len(sums), np.array([(2 * s + n) // (2 * n) for s in sums], np.int64)
    per = max(1, BLOCK_BYTES // (8 * d))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        held, rows, number = [], 0, TaskContext.get().partitionId() << 32

        def blocks() -> pa.RecordBatch:
            y = np.concatenate(held) - means
            columns = [y[:, k : k + TILE].tobytes() for k in range(0, d, TILE)]
            return pa.RecordBatch.from_arrays([pa.array([number] * len(columns), pa.int64()), pa.array(range(len(columns)), pa.int32()), pa.array([len(y)] * len(columns), pa.int32()), pa.array(columns, pa.binary())], ["row_block", "column_block", "rows", "cells"])

        for batch in batches:
            for part in slices(batch):
                for _, x in whole(part.column(1), d, scale, shift).values():
                    held.append(x)
                    rows += len(x)
                if rows >= per:
                    yield blocks()
                    held, rows, number = [], 0, number + 1
        if held:
            yield blocks()

    def multiply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        task, tiles, most = TaskContext.get().partitionId(), {}, 0

        def flushed() -> Iterator[pa.RecordBatch]:
            for (p, q), s in tiles.items():
                yield pa.RecordBatch.from_arrays([pa.array([v], pa.int32()) for v in (p, q, task)] + [pa.array([_limbs(s)], pa.list_(pa.int64()))], ["p", "q", "task", "limbs"])
            tiles.clear()

        block, columns = None, []
        for batch in batches:
            for row_block, rows, cells in zip(*(batch.column(k).to_pylist() for k in (0, 2, 3)), strict=True):
                if row_block != block:
                    block, columns = row_block, []
                columns.append(np.frombuffer(cells, np.int64).reshape(rows, -1))
                q = len(columns) - 1
                for p, x in enumerate(columns):
                    more = products(x, columns[q])
                    size = max(abs(int(more.max())), abs(int(more.min()))) if more.size else 0
                    if most + size >= 1 << 62:
                        yield from flushed()
                        most = 0
                    most += size if p == q else 0  # a tile off the diagonal has no larger entries than those on it
                    tiles[p, q] = tiles[p, q] + more if (p, q) in tiles else more
        yield from flushed()

    schema = "p int, q int, task int, limbs array<long>"

    def added(table: pa.Table) -> pa.Table:
        limbs = np.sum([np.array(x) for x in table.column("limbs").to_pylist()], 0)
        return table.slice(0, 1).set_column(3, "limbs", pa.array([limbs.tolist()], pa.list_(pa.int64())))

    dealt = in_arrow(vectors, cut, "row_block long, column_block int, rows int, cells binary").repartition("row_block").sortWithinPartitions("row_block", "column_block")
    tiles = in_arrow(dealt, multiply, schema).withColumn("task", F.pmod("task", F.lit(SPREAD)))
    tiles = tiles.groupBy("p", "q", "task").applyInArrow(added, schema).groupBy("p", "q").applyInArrow(added, schema)
    out = np.zeros((d, d))
    for p, q, _, limbs in tiles.toLocalIterator():  # one row a tile
        i, j = (range(k * TILE, min(d, (k + 1) * TILE)) for k in (p, q))
        parts = np.array(limbs, object).reshape(_LIMBS, len(i), len(j))
        total = sum(parts[k] << (_LIMB * k) for k in range(_LIMBS))
        for a, row in zip(i, total, strict=True):
            for b, s in zip(j, row, strict=True):
                rest = (sums[a] - n * int(means[a])) * (sums[b] - n * int(means[b]))
                out[a, b] = out[b, a] = float(Fraction(n * int(s) - rest, n * n))
    return out


def fit(vectors: DataFrame, scale: int = 1024, shift: int = 100_000) -> Fitted | None:
    """Mean, components and eigenvalues of ``(id, vector)``; None where no vector takes part."""
    n, sums = _sums(vectors, scale, shift)
    if not sums:
        return None
    v = covariance(vectors, n, sums, scale, shift)
    values, components = np.linalg.eigh(v)
    values, components = values[::-1], components[:, ::-1]
    largest = components[np.abs(components).argmax(0), np.arange(len(values))]
    return Fitted(n, sums, components * np.where(largest < 0, -1.0, 1.0), values, float(np.trace(v)))


def whitened(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", components: int = 8, scale: int = 1024, shift: int = 100_000) -> DataFrame:
    """A row for each vector that takes part and each of the first ``components``, with what they explain and how far the covariance of the result is from the identity."""
    schema = "vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double"
    vectors = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).alias("vector"))
    fitted = fit(vectors, scale, shift)
    if fitted is None:
        return vectors.sparkSession.createDataFrame([], schema)
    n, sums, axes, values, trace = fitted
    d = len(sums)
    k = min(components, d)
    least = max(1e-12, float(values[0]) * d * np.finfo(float).eps * 16)
    live = [j for j in range(k) if values[j] > least]
    project = axes[:, :k] / np.sqrt(np.where(values[:k] > least, values[:k], np.nan))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch):
                for rows, x in whole(part.column(1), d, scale, shift).values():
                    exact = int(np.abs(x).max(initial=0)) * n + max(map(abs, sums))
                    if exact**2 * d < 1 << 63:
                        away = x * n - np.array(sums, np.int64)
                        deviation = (away**2).sum(1).tolist()
                        centred = away / n
                    else:
                        away = x.astype(object) * n - np.array(sums, object)
                        deviation = [s if s < 1 << 63 else None for s in (away**2).sum(1).tolist()]
                        centred = np.array([[float(Fraction(a, n)) for a in r] for r in away])
                    values = centred @ project
                    yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(rows)), pa.array(deviation, pa.int64()), pa.array(list(values), pa.list_(pa.float64()))], ["vec_id", "deviation", "w"])

    told = stored(in_arrow(vectors, run, "vec_id long, deviation long, w array<double>"), "whitened")
    # Spark's covariance centres as it goes and joins parts by their means.
    pairs = [(i, j) for a, i in enumerate(live) for j in live[a:]]
    entries = told.agg(F.lit(0), *(F.covar_pop(F.col("w")[i], F.col("w")[j]) for i, j in pairs)).first()[1:]
    error = max((abs(e - (i == j)) for e, (i, j) in zip(entries, pairs, strict=True)), default=None)
    share = F.array(*(F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values[:k]))
    rows = told.select("vec_id", F.posexplode("w").alias("k", "value"), "deviation")
    return rows.select("vec_id", (F.col("k") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation", F.when(~F.isnan("value"), F.col("value")).alias("whitened"), F.element_at(share, F.col("k") + 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"))
