"""Promotion and conversion: whole steps that keep several tables consistent."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.text import clean, mainline_first, usable
from longbox.operators.merge import merged_value
from longbox.session import shared_path
from longbox.sources.tables import Catalog

#: Status words of the source and what they become (fixed values); others are unknown.
SOURCE_STATUS = {"likely_ongoing": "ongoing", "manual_ongoing": "ongoing", "likely_ended": "completed", "manual_ended": "completed"}


def catalogue_status(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for p in SOURCE_STATUS.items() for x in p]), c), F.lit("unknown"))


def hydration_due(rows: DataFrame, refreshed: str, updated: str, ids: list[int] | None = None) -> DataFrame:
    """Rows never refreshed or updated since; given ids are taken whatever their state."""
    return rows.where(F.col("id").isin(ids)) if ids else rows.where(F.col(refreshed).isNull() | (F.col(updated) > F.col(refreshed)))


def batches(rows: DataFrame, order: str, size: int = 100) -> DataFrame:
    """``rows`` with ``batch``: numbers of at most ``size`` rows in order of a key, counted by ranges of it, not in one place.

    The ranges are stored before they are counted: made a second time, from other columns or another sample, they would
    be other ranges, and numbers would repeat.
    """
    spark, path = rows.sparkSession, shared_path(rows.sparkSession, "batches")
    placed = rows.repartitionByRange(F.col(order)).sortWithinPartitions(order).withColumn("_at", F.monotonically_increasing_id())
    placed.write.parquet(path)
    stored = spark.read.schema(placed.schema).parquet(path).withColumns({"_p": F.shiftright("_at", 33), "_nth": F.col("_at").bitwiseAND((1 << 33) - 1)})
    counts = stored.groupBy("_p").agg(F.count(F.lit(1)).alias("n"))
    before = counts.select("_p", (F.sum("n").over(Window.orderBy("_p")) - F.col("n")).alias("before"))
    return stored.join(F.broadcast(before), "_p").withColumn("batch", F.floor((F.col("_nth") + F.col("before")) / size)).drop("_at", "_p", "_nth", "before")


def refreshed(requested: DataFrame, returned: DataFrame) -> DataFrame:
    """``id, outcome``: each asked id is returned or not, each answer asked for or unexpected."""
    a, b = requested.select("id", F.lit(True).alias("asked")).distinct(), returned.select("id", F.lit(True).alias("got")).distinct()
    return a.join(b, "id", "full").select("id", F.when(F.col("asked") & F.col("got"), "returned").when(F.col("asked"), "not returned").otherwise("unexpected").alias("outcome"))


def promoted_issues(issues: DataFrame, source: DataFrame, today: Column, overwrite: bool = False) -> DataFrame:
    """Next issues of runs after ``source (run_id, issue_number, date, title)``: rows without a number are skipped, dates
    are filled or overwritten, and an issue whose date has come is released for good."""
    usable_rows = source.where(usable(F.col("issue_number")) & F.col("run_id").isNotNull())
    s = usable_rows.groupBy("run_id", "issue_number").agg(F.max("date").alias("date"))
    both = issues.select("id", "run_id", "issue_number", "published_date", "is_released").join(s, ["run_id", "issue_number"], "full")
    take = F.col("date").isNotNull() & (F.col("published_date").isNull() | (F.lit(overwrite) & (F.col("published_date") != F.col("date"))))
    date = F.when(take, F.col("date")).otherwise(F.col("published_date"))
    released = F.coalesce("is_released", F.lit(False)) | F.coalesce(date <= today, F.lit(False))
    return both.select("run_id", "issue_number", "id", date.alias("published_date"), released.alias("is_released"), F.when(F.col("id").isNull(), "created").when(take, "updated").otherwise("unchanged").alias("outcome"))


def applied_runs(candidates: DataFrame, promoted: DataFrame) -> DataFrame:
    """``group_id, all_applied``: candidates whose issues all found their place; false for none."""
    per = promoted.groupBy("group_id").agg(F.bool_and(F.col("applied")).alias("all_applied"))
    return candidates.select("group_id").join(per, "group_id", "left").select("group_id", F.coalesce("all_applied", F.lit(False)).alias("all_applied"))


def guarded(candidates: DataFrame, fresh: DataFrame) -> DataFrame:
    """Candidates with ``may_apply``: only while the source's fingerprint is the one that was analysed."""
    now = fresh.select("group_id", F.col("fingerprint").alias("now"))
    return candidates.join(now, "group_id", "left").withColumn("may_apply", (F.col("catalog_status") == "ready_to_apply") & F.col("fingerprint").eqNullSafe(F.col("now")))


def first_issue_descriptions(runs: DataFrame, issues: DataFrame) -> DataFrame:
    """Runs with a blank description filled from their issue number 1."""
    ones = issues.where(mainline_first(F.col("issue_number")) & usable(F.col("description"))).groupBy("run_id").agg(F.min_by("description", "id").alias("d"))
    rows = runs.join(ones, runs["id"] == ones["run_id"], "left")
    return rows.select(runs["id"], merged_value(runs["description"], F.col("d"), overwrite=False).alias("description"))


def renamed_status(rows: DataFrame, old: str = "ended", new: str = "completed") -> DataFrame:
    return rows.withColumn("status", F.when(F.col("status") == old, new).otherwise(F.col("status")))


def converted(c: Catalog, stale: DataFrame) -> dict[str, DataFrame]:
    """Tables after ``stale (run_id, issue_id, publisher_id, title, start_year, published_date)`` runs became one-shots.

    The run and its issue go, and what pointed at them: era entries and progress.  Credits of the issue and links of
    volumes move to the one-shot, each once.  Volumes whose own run goes keep their title, or take the run's.
    """
    shots = stale.select(F.concat(F.lit("run:"), F.col("run_id").cast("string")).alias("source_key"), "run_id", "issue_id", "publisher_id", "title", "start_year", "published_date")
    runs, issues = stale.select(F.col("run_id")).distinct(), stale.select(F.col("issue_id")).distinct()
    gone_run, gone_issue = runs.withColumnRenamed("run_id", "id"), issues.withColumnRenamed("issue_id", "id")
    moved = c.credits.where("target_kind = 'issue'").join(shots.select(F.col("issue_id").alias("target_id"), "source_key"), "target_id").groupBy("source_key", "person_id", "role_id").agg(F.min("credit_order").alias("credit_order"))
    by_issue = c.volume_issues.join(shots.select("issue_id", "source_key"), "issue_id").select("volume_id", "source_key", F.col("issue_order").alias("item_order"))
    by_link = c.volume_runs.join(shots.select("run_id", "source_key"), "run_id").select("volume_id", "source_key", "item_order")
    own = c.volumes.where("run_id is not null").join(shots.select("run_id", "source_key"), "run_id").select(F.col("id").alias("volume_id"), "source_key", F.lit(1).alias("item_order"))
    links = by_issue.unionByName(by_link).unionByName(own).groupBy("volume_id", "source_key").agg(F.min("item_order").alias("item_order"))
    titles = stale.select("run_id", F.col("title").alias("_run_title"))
    volumes = c.volumes.join(titles, "run_id", "left").withColumn("title", F.when((clean(F.col("title")) == "") & F.col("_run_title").isNotNull(), F.col("_run_title")).otherwise(F.col("title"))).withColumn("run_id", F.when(F.col("_run_title").isNull(), F.col("run_id"))).drop("_run_title").select(c.volumes.columns)
    lost = c.progress.join(shots.select(F.lit("run").alias("kind"), F.col("run_id").alias("object_id")).unionByName(shots.select(F.lit("issue").alias("kind"), F.col("issue_id").alias("object_id"))), ["kind", "object_id"], "left_anti")
    return {
        "one_shots": shots,
        "one_shot_credits": moved,
        "volume_one_shots": links,
        "volumes": volumes,
        "runs": c.runs.join(gone_run, "id", "left_anti"),
        "issues": c.issues.join(gone_issue, "id", "left_anti"),
        "era_runs": c.era_runs.join(runs, "run_id", "left_anti"),
        "volume_issues": c.volume_issues.join(issues, "issue_id", "left_anti"),
        "volume_runs": c.volume_runs.join(runs, "run_id", "left_anti"),
        "progress": lost,
    }


def orphans(child: DataFrame, key: str, parent: DataFrame) -> DataFrame:
    """Rows whose key names no parent; there should be none."""
    return child.where(F.col(key).isNotNull()).join(parent.select(F.col("id").alias(key)), key, "left_anti")


def new_era_runs(c: Catalog) -> DataFrame:
    """Ongoing runs that are not in the present era yet."""
    return c.runs.where("status = 'ongoing'").select(F.col("id").alias("run_id")).join(c.era_runs, "run_id", "left_anti")


def search(rows: DataFrame, text: str, fields: list[str], **equal: object) -> DataFrame:
    """Rows where every word of ``text`` stands in one of ``fields``, and the given columns have the given values."""
    for word in text.lower().split():
        hit = F.lit(False)
        for f in fields:
            hit = hit | F.coalesce(F.contains(F.lower(F.col(f).cast("string")), F.lit(word)), F.lit(False))
        rows = rows.where(hit)
    for name, value in equal.items():
        rows = rows.where(F.col(name).eqNullSafe(F.lit(value)))
    return rows
