"""Resumable scans and change feeds with Structured Streaming.

A scan's state is a table of days with the next offset of each.  The next state is a function of the state and the
pages read, so a failed run repeats its pages and changes nothing twice.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def advanced(offset: Column, page_rows: Column, total: Column) -> tuple[Column, Column]:
    """Next offset, and whether a day is complete: its page was empty or reached the total."""
    end = offset + page_rows
    return end, (page_rows == 0) | (end >= total)


def advance(state: DataFrame, pages: DataFrame) -> DataFrame:
    """Next ``state (scan_kind, scan_date, next_offset, total_results, completed)`` after one page a day.

    ``pages (scan_kind, scan_date, page_rows, total)``; days without a page, and complete ones, stay as they are.
    """
    rows = state.join(pages, ["scan_kind", "scan_date"], "full")
    offset = F.coalesce("next_offset", F.lit(0))
    end, done = advanced(offset, F.col("page_rows"), F.col("total"))
    moves = F.col("page_rows").isNotNull() & ~F.coalesce("completed", F.lit(False))
    return rows.select("scan_kind", "scan_date", F.when(moves, end).otherwise(offset).alias("next_offset"), F.when(moves, F.col("total")).otherwise(F.col("total_results")).alias("total_results"), F.when(moves, done).otherwise(F.coalesce("completed", F.lit(False))).alias("completed"))


def next_day(state: DataFrame, start: str, end: str, newest_first: bool = False) -> DataFrame:
    """The first day of a range that is not complete, from either end; no row when all are."""
    days = state.sparkSession.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS scan_date")
    open_days = days.join(state.where("completed").select("scan_date"), "scan_date", "left_anti")
    return open_days.agg((F.max if newest_first else F.min)("scan_date").alias("scan_date")).where("scan_date is not null")


def weekly_counts(events: DataFrame, time: str, late: str = "1 day") -> DataFrame:
    """Rows of each week from Wednesday to Tuesday; works on a stream too, where ``late`` bounds the state."""
    rows = events.withWatermark(time, late) if events.isStreaming else events
    return rows.groupBy(F.window(time, "7 days", "7 days", "6 days")).agg(F.count(F.lit(1)).alias("n")).select(F.col("window.start").alias("week_start"), "n")


def rate_limited(attempts: DataFrame, key: str, time: str, most: int, minutes: int) -> DataFrame:
    """Attempts with ``blocked``: more than ``most`` of the key within the window that ends at the attempt."""
    seconds = F.unix_micros(F.col(time).cast("timestamp"))
    span = Window.partitionBy(key).orderBy(seconds).rangeBetween(-minutes * 60 * 1_000_000, 0)
    return attempts.withColumn("blocked", F.count(F.lit(1)).over(span) > most)


def run_available(source: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str) -> None:
    """Feed what a streaming source has by now to ``apply`` in micro-batches; a restart goes on after the last whole one."""
    query = source.writeStream.foreachBatch(apply).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()


# Day scans as a stream -----------------------------------------------------------------------------------------

#: Phases of an import, in order: what was added on a day, then what was changed on it.
PHASES = ("added", "updated")
STATE = "phase string, scan_date date, next_offset long, total long, completed boolean"


def first_day(stored: dt.date | None, asked: dt.date | None, today: dt.date) -> dt.date:
    """Day that scans begin at: what is stored stays; before that the day asked for, else yesterday.  Asking for another day
    than the stored one is an error."""
    if stored and asked and stored != asked:
        raise ValueError(f"scans began at {stored} and cannot begin at {asked}")
    return stored or asked or today - dt.timedelta(days=1)


def _version(path: str, spark: SparkSession) -> tuple[list[int], str]:
    """Numbers of the batches whose state is whole, ascending, and the folder of states."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/state")
    fs = hadoop.getFileSystem(spark._jsc.hadoopConfiguration())
    if not fs.exists(hadoop):
        return [], f"{path}/state"
    done = [s.getPath() for s in fs.listStatus(hadoop)]
    return sorted(int(p.getName()) for p in done if fs.exists(spark._jvm.org.apache.hadoop.fs.Path(p, "_SUCCESS"))), f"{path}/state"


def scan_state(spark: SparkSession, path: str, before: int | None = None) -> DataFrame:
    """``STATE`` after the last whole batch (before batch ``before``); no rows where there was none."""
    done, folder = _version(path, spark)
    done = [v for v in done if before is None or v < before]
    return spark.read.schema(STATE).parquet(f"{folder}/{done[-1]}") if done else spark.createDataFrame([], STATE)


def scanned_rows(spark: SparkSession, path: str, schema: str | StructType) -> DataFrame:
    """Rows of the accepted pages of all whole batches."""
    done, _ = _version(path, spark)
    return spark.read.schema(schema).parquet(*[f"{path}/rows/{v}" for v in done]) if done else spark.createDataFrame([], schema)


def accepted_pages(state: DataFrame, pages: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """``pages (phase, scan_date, offset, total, items)`` that move a day on, with ``page_rows`` and ``stops``: whether the day ends there.

    Pages of days outside ``start`` to ``end``, of other phases, of complete days and below a day's offset are passed over; so are repeats of
    an offset (the one of more items stands), pages after a gap, and pages after the one that completes the day.
    """
    keys = ["phase", "scan_date"]
    size = F.coalesce(F.size("items"), F.lit(0)).cast("long")
    asked = pages.where(F.col("phase").isin(*PHASES) & F.col("scan_date").between(F.lit(start), F.lit(end))).withColumn("page_rows", F.greatest(size, F.lit(0).cast("long")))
    rows = asked.join(state.select(*keys, "next_offset", "completed"), keys, "left").where(~F.coalesce("completed", F.lit(False)) & (F.col("offset") >= F.coalesce("next_offset", F.lit(0))))
    one = Window.partitionBy(*keys, "offset").orderBy(F.col("page_rows").desc(), F.col("total").desc(), F.to_json("items"))
    rows = rows.withColumn("_nth", F.row_number().over(one)).where("_nth = 1")
    before = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, -1)
    so_far = Window.partitionBy(*keys).orderBy("offset").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_fits", F.col("offset") == F.coalesce("next_offset", F.lit(0)) + F.coalesce(F.sum("page_rows").over(before), F.lit(0)))
    rows = rows.withColumn("stops", advanced(F.col("offset"), F.col("page_rows"), F.coalesce("total", F.lit(0)))[1])
    rows = rows.withColumns({"_whole": F.min("_fits").over(so_far), "_ended": F.coalesce(F.max("stops").over(before), F.lit(False))})
    return rows.where("_whole and not _ended").drop("_nth", "_fits", "_whole", "_ended", "next_offset", "completed")


def scan_batch(path: str, start: dt.date, end: dt.date) -> Callable[[DataFrame, int], None]:
    """What a micro-batch of replies does: rows of accepted pages, then the next state, each a folder of the batch's number.

    The state makes both count: rows of a batch without a whole state are not read, and are written over when the
    batch is repeated, which starts from the state before it.  So a job that dies anywhere goes on with the same rows and state.
    """

    def apply(replies: DataFrame, batch: int) -> None:
        spark = replies.sparkSession
        state = scan_state(spark, path, batch)
        fields = [F.col(c) for c in ("phase", "scan_date", "offset", "total", "stops", "items")]
        accepted_pages(state, replies, start, end).select(*fields).write.mode("overwrite").parquet(f"{path}/rows/{batch}")
        new = spark.read.parquet(f"{path}/rows/{batch}")
        moved = new.groupBy("phase", "scan_date").agg(F.max(F.struct("offset", F.greatest(F.size("items"), F.lit(0)).alias("n"), "total", "stops")).alias("p"))
        moved = moved.select("phase", "scan_date", (F.col("p.offset") + F.coalesce("p.n", F.lit(0))).alias("next_offset"), F.coalesce("p.total", F.lit(0)).alias("total"), F.col("p.stops").alias("completed"))
        kept = state.join(moved.select("phase", "scan_date"), ["phase", "scan_date"], "left_anti")
        kept.unionByName(moved).write.mode("overwrite").parquet(f"{path}/state/{batch}")

    return apply


def wanted_pages(state: DataFrame, start: dt.date, end: dt.date) -> DataFrame:
    """``phase, scan_date, offset`` of the page to ask for next: of the first phase with an open day its first open day; no row when all are done."""
    spark = state.sparkSession
    days = spark.range(1).select(F.explode(F.array(*[F.struct(F.lit(k).alias("nth"), F.lit(p).alias("phase")) for k, p in enumerate(PHASES)])).alias("p"), F.sequence(F.lit(start), F.lit(end)).alias("d"))
    days = days.select("p.nth", "p.phase", F.explode("d").alias("scan_date")).join(state, ["phase", "scan_date"], "left").where(~F.coalesce("completed", F.lit(False)))
    first = days.agg(F.min(F.struct("nth", "scan_date", "phase", F.coalesce("next_offset", F.lit(0)).alias("offset"))).alias("w")).where("w is not null")
    return first.select("w.phase", "w.scan_date", "w.offset")
