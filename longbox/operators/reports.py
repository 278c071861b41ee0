"""Counts and coverage reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.text import percent, usable
from longbox.sources.tables import Catalog


def home_counts(c: Catalog) -> DataFrame:
    """One row a table with its number of rows."""
    out = None
    for name in ("publishers", "runs", "issues", "volumes", "one_shots"):
        row = getattr(c, name).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("item"), "n")
        out = row if out is None else out.unionByName(row)
    return out


def coverage(rows: DataFrame, fields: list[str]) -> DataFrame:
    """``field, present, total, share``: rows with a usable value in each field, in one pass."""
    counts = rows.agg(F.count(F.lit(1)).alias("total"), *[F.count_if(usable(F.col(f))).alias(f) for f in fields])
    long = counts.select("total", F.explode(F.create_map(*[x for f in fields for x in (F.lit(f), F.col(f))])).alias("field", "present"))
    return long.select("field", "present", "total", percent(F.col("present"), F.col("total")).alias("share"))


def histogram(rows: DataFrame, column: str) -> DataFrame:
    return rows.groupBy(column).agg(F.count(F.lit(1)).alias("n"))


def dense_days(rows: DataFrame, day: str, start: str, end: str) -> DataFrame:
    """``day, n``: rows of each day of a range, 0 for days without."""
    days = rows.sparkSession.sql(f"SELECT explode(sequence(DATE '{start}', DATE '{end}')) AS {day}")
    return F.broadcast(days).join(rows.groupBy(day).agg(F.count(F.lit(1)).alias("n")), day, "left").select(day, F.coalesce("n", F.lit(0)).alias("n"))


def contiguous_back(days: DataFrame, day: str, done: str) -> DataFrame:
    """Days at the newest end of a dense calendar that are all done: the scan back stops at the first gap."""
    newest = Window.orderBy(F.desc(day)).rowsBetween(Window.unboundedPreceding, 0)
    return days.withColumn("_gaps", F.sum(F.when(F.col(done), 0).otherwise(1)).over(newest)).where("_gaps = 0").drop("_gaps")


def missing_ranges(issues: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """``run_id, first, last``: unbroken ranges of whole numbers from 1 below a run's current one that no issue has.

    ``current (run_id, number)`` says how far runs have come, say on a release calendar: the highest of a run counts, runs
    without one are left out, and a run that has no issue yet misses all numbers below.  Without it, a run has come as
    far as the highest number that an issue of it has.
    """
    have = issues.where(F.col("issue_number").rlike(r"^\d+$")).select("run_id", F.col("issue_number").cast("long").alias("n")).where("n > 0")
    if current is not None:
        tops = current.groupBy("run_id").agg(F.max(F.col("number").cast("long")).alias("n")).where("n > 1")
        have = have.join(tops.withColumnRenamed("n", "_top"), "run_id").where("n < _top").drop("_top").unionByName(tops)
    have = have.distinct()
    before = F.lag("n", 1, 0).over(Window.partitionBy("run_id").orderBy("n"))
    return have.withColumn("_before", before).where("n - _before > 1").select("run_id", (F.col("_before") + 1).alias("first"), (F.col("n") - 1).alias("last"))


def missing_counts(issues: DataFrame, current: DataFrame | None = None) -> DataFrame:
    """``run_id, n_missing, missing_sum`` of runs that miss numbers; no number is written out."""
    n = F.col("last") - F.col("first") + 1
    total = n.cast("decimal(20,0)") * (F.col("first") + F.col("last")).cast("decimal(18,0)") / 2
    return missing_ranges(issues, current).groupBy("run_id").agg(F.sum(n).alias("n_missing"), F.sum(total).cast("long").alias("missing_sum"))


def missing_numbers(issues: DataFrame) -> DataFrame:
    """``run_id, missing``: a row for each number of the missing ranges, which are written out in steps of bounded size."""
    step = 10_000
    starts = missing_ranges(issues).select("run_id", "last", F.explode(F.sequence("first", "last", F.lit(step).cast("long"))).alias("_at"))
    return starts.select("run_id", F.explode(F.sequence("_at", F.least(F.col("_at") + step - 1, "last"))).alias("missing"))


def budgeted(rows: DataFrame, order: list[str], budget: int, used: int = 0) -> DataFrame:
    """The first rows in order that the rest of a budget allows; a group that crosses it keeps the part that fits."""
    return rows.orderBy(*order).limit(max(0, budget - used))
