"""Token counts by an exact length histogram.

Documents are aggregated by encoded length; the histogram is as long as there are lengths, whatever the number of
documents.  Sums from either end of it answer totals, quantiles and truncated totals for every context limit.
Null and empty texts have length 0.  An empty table gives an empty histogram.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longbox.llm.byte_pairs import ENCODE_BYTES, ENCODE_ROWS, encoder
from longbox.llm.shared import map_batches


def token_counts(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, n_tokens)`` of each whole text."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        sizes = [len(x) // 4 for x in encoder(tokenizer).encode_bytes(batch.column(1))]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(sizes, pa.int64())], ["doc_id", "n_tokens"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text")), run, "doc_id long, n_tokens long", ENCODE_ROWS, ENCODE_BYTES)


def histogram(counts: DataFrame) -> DataFrame:
    """``(n_tokens, n_docs)``; tasks count before the shuffle, so that one common length costs a row a task."""
    return counts.groupBy("n_tokens").agg(F.count(F.lit(1)).alias("n_docs"))


def length_table(hist: DataFrame) -> DataFrame:
    """For each length: documents and tokens up to it, those beyond it, and the total if all were cut to it.

    The window runs over lengths, of which there are at most as many as the longest document has tokens.
    """
    up = Window.orderBy("n_tokens").rowsBetween(Window.unboundedPreceding, 0)
    beyond = Window.orderBy(F.desc("n_tokens")).rowsBetween(Window.unboundedPreceding, -1)
    tokens = F.col("n_tokens") * F.col("n_docs")
    return hist.select(
        "n_tokens",
        "n_docs",
        F.sum("n_docs").over(up).alias("docs_to"),
        F.sum(tokens).over(up).alias("tokens_to"),
        F.coalesce(F.sum("n_docs").over(beyond), F.lit(0)).alias("docs_beyond"),
        F.coalesce(F.sum(tokens).over(beyond), F.lit(0)).alias("tokens_beyond"),
    ).withColumn("truncated_total", F.col("tokens_to") + F.col("docs_beyond") * F.col("n_tokens"))


def truncated_totals(table: DataFrame, limits: list[int]) -> DataFrame:
    """``(context_limit, total_tokens, truncated_total)`` for any limits, from the table of lengths.

    The total for a limit follows from the longest length not above it: all longer documents count the limit.
    """
    spark = table.sparkSession
    wanted = spark.createDataFrame([(int(x),) for x in limits], "context_limit long")
    whole = table.agg(F.max(F.col("tokens_to")).alias("total_tokens"), F.max("docs_to").alias("docs"))
    best = wanted.join(F.broadcast(table), F.col("n_tokens") <= F.col("context_limit"), "left").groupBy("context_limit").agg(F.max_by("tokens_to", "n_tokens").alias("t"), F.max_by("docs_to", "n_tokens").alias("d"))
    t, d = F.coalesce("t", F.lit(0)), F.coalesce("d", F.lit(0))
    return best.join(F.broadcast(whole)).select("context_limit", "total_tokens", (t + (F.col("docs") - d) * F.col("context_limit")).alias("truncated_total"))


def quantiles(table: DataFrame, shares: list[float]) -> DataFrame:
    """``(share, n_tokens)``: the smallest length that at least this share of documents do not exceed."""
    wanted = table.sparkSession.createDataFrame([(float(x),) for x in shares], "share double")
    whole = table.agg(F.max("docs_to").alias("docs"))
    joined = wanted.join(F.broadcast(whole)).join(F.broadcast(table), F.col("docs_to") >= F.greatest(F.ceil(F.col("share") * F.col("docs")), F.lit(1)))
    return joined.groupBy("share").agg(F.min("n_tokens").alias("n_tokens"))
