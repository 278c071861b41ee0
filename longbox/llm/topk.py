"""Exact top-k by inner product, located by global score histograms.

Every query is scored against every vector.  For each query the counts of scores by bucket are summed over all tasks;
the bucket that holds the k-th score is split again until it is one score wide.  Then rows above that score, and of the
rows on it those of smallest id, are the answer.

Queries are taken in waves of a bounded size, several blocks of a matrix product each; a wave's vectors are broadcast
and its answers are appended to one table, so that neither a plan nor what is broadcast grows with their number.  A
task sends for a query only its topmost buckets, up to k rows' worth: lower ones cannot hold the k-th score.  Of the
sums only the bucket that is split next reaches the driver: a row for each query of the wave.

Rows with a null vector, a null id, or a null or non-finite component take no part.  Where fewer than k others exist,
all are returned.  Rows that repeat an id stand for themselves, and a query never returns a row of its own id.  Scores
are exact whole numbers whatever the components' size; those beyond +-2^61 count as +-2^61, and a component as a long.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longbox.llm.shared import in_arrow, new_path, stored

#: Queries of a wave; their vectors are broadcast, so this bounds what is broadcast.  Queries of a matrix product.
QUERY_ROWS, PRODUCT_ROWS = 16_384, 1024
#: Bytes of vectors that a wave may broadcast: it has fewer queries where vectors are long.
WAVE_BYTES = 64 << 20
#: Buckets that a refinement splits a range into.
BUCKETS = 1024
#: Vectors scored at once by a task.
SCORE_ROWS = 1024
#: Scores that double precision holds exactly, and the bound of all.
EXACT, MOST_SCORE = 1 << 52, 1 << 61


def quantised(vectors: DataFrame, id_col: str, vector_col: str, scale: int) -> DataFrame:
    """``(vec_id, v array<double>)``: floor(scale * x) of each component, rows that take part only."""
    v = F.transform(vector_col, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")).cast("double"))
    whole = F.col(id_col).isNotNull() & F.col(vector_col).isNotNull() & F.forall(vector_col, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return vectors.where(whole).select(F.col(id_col).cast("long").alias("vec_id"), v.alias("v"))


class _Scorer:
    """Scores of batches of vectors against the queries of a wave, as whole numbers."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray):
        self.ids, self.vectors = ids, vectors
        self.most = np.abs(vectors).max(1, initial=0.0)

    def batches(self, batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[int, np.ndarray, np.ndarray, np.ndarray]]:
        """First query, ids, scores (queries by rows) and which of them count, a block of queries at a time."""
        width = self.vectors.shape[1]
        for whole in batches:
            for start in range(0, whole.num_rows, SCORE_ROWS):
                batch = whole.slice(start, SCORE_ROWS)
                column = batch.column(1)
                ids = batch.column(0).to_numpy(zero_copy_only=False)
                sizes = np.diff(column.offsets.to_numpy())
                same = np.flatnonzero(sizes == width)  # a vector of another length has no inner product
                if not len(same):
                    continue
                flat = column.flatten().to_numpy(zero_copy_only=False)
                rows = flat.reshape(-1, width) if len(same) == len(sizes) else np.stack([column[int(i)].values.to_numpy(zero_copy_only=False) for i in same])
                ids = ids[same]
                for q in range(0, len(self.ids), PRODUCT_ROWS):
                    yield q, ids, self._scores(q, rows), self.ids[q : q + PRODUCT_ROWS, None] != ids[None, :]

    def _scores(self, q: int, rows: np.ndarray) -> np.ndarray:
        part, width = self.vectors[q : q + PRODUCT_ROWS], self.vectors.shape[1]
        scores = np.rint(np.clip(part @ rows.T, -MOST_SCORE, MOST_SCORE)).astype(np.int64)
        # Products of large components again, in whole numbers of any size.
        large = np.argwhere(np.outer(self.most[q : q + PRODUCT_ROWS], np.abs(rows).max(1)) * width >= EXACT) if self.most.max() * np.abs(rows).max() * width >= EXACT else ()
        for i, j in large:
            exact = sum(int(a) * int(b) for a, b in zip(part[i].tolist(), rows[j].tolist(), strict=True))
            scores[i, j] = max(-MOST_SCORE, min(MOST_SCORE, exact))
        return scores


def _histogram(rows: DataFrame, wave, low: np.ndarray, span: np.ndarray, width: np.ndarray, need: np.ndarray) -> DataFrame:
    """``(q, bucket, n)``: counts of the ``span[q]`` scores from ``low[q]`` on in buckets of ``width[q]``, topmost first until ``need[q]``."""
    shared = rows.sparkSession.sparkContext.broadcast((low, span, width, need))

    def run(batches):
        scorer = _Scorer(*wave.value)
        start, size, step, wanted = shared.value
        counts = np.zeros((len(start), BUCKETS), np.int32)
        for first, _, scores, counted in scorer.batches(batches):
            block = slice(first, first + len(scores))
            scores -= start[block, None]
            counted &= (scores >= 0) & (scores < size[block, None])
            scores //= step[block, None]
            for q in range(len(scores)):
                counts[first + q] += np.bincount(scores[q][counted[q]], minlength=BUCKETS).astype(np.int32)
        for first in range(0, len(start), PRODUCT_ROWS):
            part = counts[first : first + PRODUCT_ROWS].astype(np.int64)
            above = part[:, ::-1].cumsum(1)[:, ::-1] - part
            q, b = np.nonzero((part > 0) & (above < wanted[first : first + PRODUCT_ROWS, None]))
            yield pa.RecordBatch.from_arrays([pa.array(q + first, pa.int32()), pa.array(b, pa.int32()), pa.array(part[q, b], pa.int64())], ["q", "bucket", "n"])

    return in_arrow(rows, run, "q int, bucket int, n long").groupBy("q", "bucket").agg(F.sum("n").alias("n"))


def _located(rows: DataFrame, wave, bound: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each query the k-th highest score and how many scores stand above it; all scores, where there are fewer than k.

    ``bound`` is the largest score that a query can have.
    """
    spark, queries = rows.sparkSession, len(bound)
    low, span = -bound, 2 * bound + 1
    above, need = np.zeros(queries, np.int64), np.full(queries, k, np.int64)
    short = np.zeros(queries, bool)
    while True:
        width = -(-span // BUCKETS)
        hist = _histogram(rows, wave, low, span, width, need)
        wanted = spark.createDataFrame(pa.table({"q": pa.array(np.arange(queries), pa.int32()), "need": need}))
        run = F.sum("n").over(Window.partitionBy("q").orderBy(F.desc("bucket")))
        reached = hist.join(F.broadcast(wanted), "q").withColumn("run", run).where("run >= need and run - n < need").select("q", "bucket", (F.col("run") - F.col("n")).alias("above")).toPandas()
        at, inside = reached["q"].to_numpy(np.int64), reached["above"].to_numpy(np.int64)
        short |= ~np.isin(np.arange(queries), at)
        above[at] += inside
        need[at] -= inside
        low[at] += reached["bucket"].to_numpy(np.int64) * width[at]
        if (width == 1).all():
            # Where fewer than k others exist, every score is above.
            return np.where(short, -MOST_SCORE - 1, low), np.where(short, k, above)
        span = width


def _answers(rows: DataFrame, wave, kth: np.ndarray, above: np.ndarray, k: int) -> DataFrame:
    shared = rows.sparkSession.sparkContext.broadcast((kth, above))

    def run(batches):
        scorer = _Scorer(*wave.value)
        kth, above = shared.value
        ties: dict[int, np.ndarray] = {}
        for first, ids, scores, counted in scorer.batches(batches):
            edge = kth[first : first + len(scores), None]
            q, r = np.nonzero((scores > edge) & counted)
            if len(q):
                yield pa.RecordBatch.from_arrays([pa.array(q + first, pa.int32()), pa.array(scorer.ids[q + first], pa.int64()), pa.array(ids[r], pa.int64()), pa.array(scores[q, r], pa.int64())], ["q", "query_id", "vec_id", "score"])
            q, r = np.nonzero((scores == edge) & counted)
            for one in np.unique(q):  # only the smallest ids can be wanted
                known = np.concatenate([ties.get(one + first, np.zeros(0, np.int64)), ids[r[q == one]]])
                ties[one + first] = np.sort(known)[: k - above[one + first]]
        if ties:
            q = np.repeat(list(ties), [len(t) for t in ties.values()])
            yield pa.RecordBatch.from_arrays([pa.array(q, pa.int32()), pa.array(scorer.ids[q], pa.int64()), pa.array(np.concatenate(list(ties.values())), pa.int64()), pa.array(kth[q], pa.int64())], ["q", "query_id", "vec_id", "score"])

    return in_arrow(rows, run, "q int, query_id long, vec_id long, score long")


def top_k(vectors: DataFrame, queries: F.Column, k: int = 20, scale: int = 64, id_col: str = "vec_id", vector_col: str = "embedding", query_rows: int = QUERY_ROWS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of the ``k`` best of all rows for each row where ``queries`` holds.

    Queries of each vector length go in waves of at most ``query_rows``; all waves' answers stand in one table.
    """
    spark = vectors.sparkSession
    rows = stored(quantised(vectors, id_col, vector_col, scale), "vectors")
    wide = rows.withColumn("width", F.size("v"))
    facts = wide.where("width > 0").groupBy("width").agg(F.max(F.array_max(F.transform("v", F.abs))).alias("most"), F.count_if(queries).alias("n")).where("n > 0").orderBy("width").collect()
    path = new_path(spark, "top-k")
    for width, most, n in facts:
        waves = math.ceil(n / max(1, min(query_rows, WAVE_BYTES // (8 * width))))
        for w in range(waves):
            mine = wide.where((F.col("width") == width) & queries & (F.pmod(F.xxhash64("vec_id"), F.lit(waves)) == w)).select("vec_id", "v").toPandas()
            if not len(mine):
                continue
            whole = np.stack(mine["v"].to_numpy()).astype(np.float64)
            wave = spark.sparkContext.broadcast((mine["vec_id"].to_numpy(np.int64), whole))
            bound = np.array([max(1, min(MOST_SCORE, int(x) * int(most) * width)) for x in np.abs(whole).max(1)], np.int64)
            _answers(rows, wave, *_located(rows, wave, bound, k), k).withColumn("wave", F.lit(f"{width}:{w}")).write.mode("append").parquet(path)
            wave.unpersist()
    if not facts:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score long")
    order = Window.partitionBy("wave", "q").orderBy(F.desc("score"), "vec_id")
    found = spark.read.schema("q int, query_id long, vec_id long, score long, wave string").parquet(path)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
