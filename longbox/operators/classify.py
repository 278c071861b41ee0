"""Facts of source groups, rule cascades and status machines."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.text import MARKED_VOLUME, alnum_number, bare_number, clean, plain_html, standard_number, title_key_or_id


def longest_streak(rows: DataFrame, group: str, number: str) -> DataFrame:
    """``(group, longest_streak)``: most consecutive whole numbers; repeats count once."""
    numbers = rows.where(F.col(number).isNotNull()).select(group, F.col(number).alias("n")).distinct()
    # Places of a run's first number are carried forward in the window's own order: no table of runs is built.
    order = Window.partitionBy(group).orderBy("n")
    placed = numbers.select(group, "n", F.row_number().over(order).alias("place"), F.coalesce(F.lag("n").over(order) + 1 == F.col("n"), F.lit(False)).alias("follows"))
    first = F.max(F.when(~F.col("follows"), F.col("place"))).over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    return placed.select(group, (F.col("place") - first + 1).cast("long").alias("size")).groupBy(group).agg(F.max("size").alias("longest_streak"))


def date_facts(store: Column, cover: Column) -> list[Column]:
    """Aggregates: kind of dates that a group has, its first and its last date; a store date goes before a cover date."""
    value = F.coalesce(store, cover)
    kind = F.when(F.count(value) == 0, "unknown").when(F.count_if(store.isNotNull()) == F.count(value), "store_date").when(F.count_if(store.isNotNull()) == 0, "cover_date").otherwise("best_available")
    return [kind.alias("source_date_type"), F.min(value).alias("first_issue_date"), F.max(value).alias("last_issue_date")]


def fingerprints(heads: DataFrame, issues: DataFrame) -> DataFrame:
    """``group_id, fingerprint``: SHA-256 of each group's ``head`` and its issues' lines in order.

    A task reads its groups' lines in order and holds one running digest, whatever a group's size.
    """
    fields = ("issue_number", "issue_title", "store_date", "cover_date")
    lines = issues.select("group_id", F.lit(1).alias("_part"), F.coalesce("issue_id", F.lit(0)).cast("long").alias("_id"), *[F.coalesce(F.col(x).cast("string"), F.lit("")).alias(x) for x in fields])
    lines = lines.withColumn("text", F.concat_ws("\n", F.col("_id").cast("string"), *fields))
    both = lines.unionByName(heads.select("group_id", F.lit(0).alias("_part"), F.col("head").alias("text")), allowMissingColumns=True)
    ordered = both.repartition("group_id").sortWithinPartitions("group_id", "_part", "_id", *fields).select("group_id", "_part", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group = digest = kind = None
        for batch in batches:
            kind, done = batch.schema.field(0).type, []
            for g, part, text in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                if part == 0 or g != group:
                    if digest is not None:
                        done.append((group, digest.hexdigest()))
                    group, digest = g, hashlib.sha256(text.encode()) if part == 0 else None
                elif digest is not None:
                    digest.update(b"\n" + text.encode())
            yield pa.RecordBatch.from_arrays([pa.array([d[0] for d in done], kind), pa.array([d[1] for d in done], pa.string())], ["group_id", "fingerprint"])
        if digest is not None:
            yield pa.RecordBatch.from_arrays([pa.array([group], kind), pa.array([digest.hexdigest()], pa.string())], ["group_id", "fingerprint"])

    key = heads.schema["group_id"].dataType.simpleString()
    return ordered.mapInArrow(run, f"group_id {key}, fingerprint string")


def group_facts(groups: DataFrame, issues: DataFrame) -> DataFrame:
    """Facts of each group of ``groups (group_id, name, publisher, start_year)`` from ``issues (group_id, issue_id,
    issue_number, issue_title, store_date, cover_date)``: counts, duplicates, boundary numbers, dates, fingerprint.
    """
    number = bare_number(F.col("issue_number"))
    whole = standard_number(F.col("issue_number"))
    edge = F.when(number != "", F.struct(whole.isNull().alias("odd"), F.coalesce(whole, F.lit(0)).alias("n"), number.alias("text")))
    key = alnum_number(F.col("issue_number"))
    facts = issues.withColumns({"_key": key, "_whole": whole, "_edge": edge}).groupBy("group_id").agg(
        F.count(F.lit(1)).alias("n_issues"),
        F.count_if(F.col("issue_id").isNull()).alias("missing_ids"),
        F.count_if(F.col("_key") == "").alias("missing_numbers"),
        F.count_if(plain_html(F.col("issue_title")).rlike(MARKED_VOLUME)).alias("marked_titles"),
        *date_facts(F.col("store_date"), F.col("cover_date")),
        F.coalesce(F.min("_edge")["text"], F.lit("")).alias("first_issue_number"),
        F.coalesce(F.max("_edge")["text"], F.lit("")).alias("last_issue_number"),
    )
    repeated = issues.select("group_id", key.alias("k")).where("k <> ''").groupBy("group_id", "k").count().where("count > 1").groupBy("group_id").agg(F.array_sort(F.collect_list("k")).alias("duplicate_numbers"))
    streak = longest_streak(issues.withColumn("_n", whole), "group_id", "_n")
    rows = groups.join(facts, "group_id", "left").join(repeated, "group_id", "left").join(streak, "group_id", "left")
    head = F.concat_ws("\n", F.col("group_id").cast("string"), clean(F.col("name")), clean(F.col("publisher")), clean(F.col("start_year")))
    rows = rows.join(fingerprints(groups.select("group_id", head.alias("head")), issues), "group_id", "left")
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return rows.select(
        *groups.columns,
        title_key_or_id(F.col("name"), F.col("group_id")).alias("title_key"),
        *[zero(x) for x in ("n_issues", "missing_ids", "missing_numbers", "marked_titles", "longest_streak")],
        F.coalesce("source_date_type", F.lit("unknown")).alias("source_date_type"),
        "first_issue_date",
        "last_issue_date",
        F.coalesce("first_issue_number", F.lit("")).alias("first_issue_number"),
        F.coalesce("last_issue_number", F.lit("")).alias("last_issue_number"),
        F.coalesce("duplicate_numbers", F.array().cast("array<string>")).alias("duplicate_numbers"),
        F.coalesce("fingerprint", F.sha2(head, 256)).alias("fingerprint"),
    )


def classified(facts: DataFrame, publisher: str) -> DataFrame:
    """``facts`` with ``analysis_status`` and ``catalog_status``: the first rule that fits decides."""
    status = (
        F.when(F.lower(clean(F.col("publisher"))) != publisher.lower(), "insufficient_data")
        .when(F.col("n_issues") == 0, "insufficient_data")
        .when(clean(F.col("start_year")) == "", "insufficient_data")
        .when(F.col("marked_titles") > 0, "unresolved")
        .when((F.col("missing_ids") > 0) | (F.col("missing_numbers") > 0), "insufficient_data")
        .when(F.size("duplicate_numbers") > 0, "conflict")
        .when(F.col("n_issues") < 2, "unresolved")
        .otherwise("confirmed_run")
    )
    return facts.withColumn("analysis_status", status).withColumn("catalog_status", F.when(F.col("analysis_status") == "confirmed_run", "ready_to_apply").otherwise("not_ready"))


def candidate_changes(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """Outcome for each analysed group against the stored candidates ``(group_id, analysis_status, catalog_status,
    fingerprint, manual)``: manual verdicts stay, applied ones become ``update_available`` when their source or class moved.
    """
    old = stored.select("group_id", *[F.col(x).alias(f"old_{x}") for x in ("analysis_status", "catalog_status", "fingerprint", "manual")])
    rows = fresh.join(old, "group_id", "left")
    moved = (F.col("fingerprint") != F.col("old_fingerprint")) | (F.col("analysis_status") != F.col("old_analysis_status"))
    manual = F.coalesce("old_manual", F.lit(False))
    analysis = F.when(manual, F.col("old_analysis_status")).otherwise(F.col("analysis_status"))
    catalog = F.when(F.col("old_catalog_status") == "applied", F.when(moved, "update_available").otherwise("applied")).when(manual, F.col("old_catalog_status")).otherwise(F.col("catalog_status"))
    outcome = F.when(F.col("old_fingerprint").isNull(), "created").when((analysis != F.col("old_analysis_status")) | (catalog != F.col("old_catalog_status")) | (F.col("fingerprint") != F.col("old_fingerprint")), "updated").otherwise("unchanged")
    return rows.select("group_id", analysis.alias("analysis_status"), catalog.alias("catalog_status"), "fingerprint", outcome.alias("outcome"))


def run_status(status: Column, last: Column, today: Column, months: int = 3) -> Column:
    """Completed if nothing came for so many months; a completed run that came back is ongoing; else as it is."""
    return F.when(last.isNull(), status).when(last < F.add_months(today, -months), "completed").when(status == "completed", "ongoing").otherwise(status)


def run_dates(runs: DataFrame, issues: DataFrame, today: Column) -> DataFrame:
    """Each run's dates and count from its issues, its status by recency, and whether anything differs from what is stored."""
    seen = issues.groupBy(F.col("run_id").alias("id")).agg(F.min("published_date").alias("first_date"), F.max("published_date").alias("last_date"), F.count(F.lit(1)).alias("n_issues"))
    rows = runs.join(seen, "id", "left").withColumn("new_status", run_status(F.col("status"), F.col("last_date"), today))
    differs = ~F.col("first_issue_date").eqNullSafe(F.col("first_date")) | ~F.col("last_issue_date").eqNullSafe(F.col("last_date")) | (F.col("status") != F.col("new_status"))
    return rows.select("id", "first_date", "last_date", F.nullif(F.coalesce("n_issues", F.lit(0)), F.lit(0)).alias("issue_count"), "new_status", differs.alias("changed"))


def stale_single_issue_runs(runs: DataFrame, issues: DataFrame, today: Column, months: int = 3) -> DataFrame:
    """Runs with exactly one issue, older than the threshold, as the one-shots they become: the issue's date wins."""
    one = issues.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("n"), F.max("published_date").alias("published_date"), F.max("id").alias("issue_id")).where("n = 1")
    return runs.join(one, "id").where(F.coalesce("published_date", "last_issue_date") < F.add_months(today, -months)).select(F.col("id").alias("run_id"), "issue_id", "publisher_id", "title", "start_year", F.coalesce("published_date", "first_issue_date").alias("published_date"))


def item_class(item_type: Column, number: Column, series: Column, has_range: Column) -> Column:
    kind = F.upper(clean(item_type))
    return (
        F.when(has_range, "collected_volume")
        .when((kind == "COMIC BOOK") & (clean(number) != ""), "issue")
        .when(kind == "COMIC BOOK", "comic_book_needs_review")
        .when((kind == "GRAPHIC NOVEL") & (clean(series) != ""), "collected_volume")
        .when(kind == "GRAPHIC NOVEL", "standalone_graphic_novel_or_one_shot")
        .otherwise("unknown")
    )
