"""What a job is to read, write or skip: plans as tables, made from what is stored and what a source says now."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.source import url_variants
from longbox.functions.text import alnum_number, clean, url_key, usable
from longbox.operators.merge import merged_value


def read_reason(found: Column, stored: dict[str, Column], stated: dict[str, Column]) -> Column:
    """Why an issue's page is to be read, the first reason that holds; blank where it need not be.

    ``stored`` has key, url, suspicious and complete of the stored issue, ``stated`` key and url of the series' list.
    """
    lacks = lambda f: (clean(stored[f]) == "") & (clean(stated[f]) != "")
    return (
        F.when(~found, "missing issue")
        .when(lacks("key"), "missing key")
        .when(lacks("url"), "missing link")
        .when(F.coalesce(stored["suspicious"], F.lit(False)), "suspicious credits")
        .when(~F.coalesce(stored["complete"], F.lit(False)), "incomplete details")
        .otherwise("")
    )


def series_plan(stated: DataFrame, issues: DataFrame) -> DataFrame:
    """``(run_id, number, key, issue_id, reason)`` of the listed issues whose pages are to be read.

    ``stated (run_id, number, key, url)``; ``issues (id, run_id, issue_number, key, url, suspicious, complete)``.  An
    issue is found in its run by its key, else by its normalised number; the smallest id counts.
    """
    rows = issues.select(F.col("id").alias("issue_id"), "run_id", alnum_number(F.col("issue_number")).alias("_n"), F.col("key").alias("_key"), F.col("url").alias("_url"), "suspicious", "complete")
    one = F.min_by(F.struct("issue_id", "_key", "_url", "suspicious", "complete"), "issue_id").alias("i")
    by_key = rows.where(usable(F.col("_key"))).groupBy("run_id", F.col("_key").alias("key")).agg(one)
    by_number = rows.where("_n <> ''").groupBy("run_id", "_n").agg(one)
    asked = stated.select("run_id", "number", F.coalesce("key", F.lit("")).alias("key"), F.coalesce("url", F.lit("")).alias("url"), alnum_number(F.col("number")).alias("_n"))
    both = asked.join(by_key.withColumnRenamed("i", "k"), ["run_id", "key"], "left").join(by_number.withColumnRenamed("i", "n"), ["run_id", "_n"], "left").withColumn("i", F.coalesce("k", "n"))
    reason = read_reason(F.col("i").isNotNull(), {"key": F.col("i._key"), "url": F.col("i._url"), "suspicious": F.col("i.suspicious"), "complete": F.col("i.complete")}, {"key": F.col("key"), "url": F.col("url")})
    return both.select("run_id", "number", "key", F.col("i.issue_id").alias("issue_id"), reason.alias("reason")).where("reason <> ''")


def writable(plan: DataFrame) -> DataFrame:
    """Plans without those of new issues whose page gave no date."""
    return plan.where("issue_id is not null or published_date is not null")


def resolved_items(items: DataFrame, wanted: DataFrame, date: str) -> DataFrame:
    """``wanted (ref, publisher_id, key, title, date)`` with the volume or one-shot of the publisher that it means.

    By source key, else by title without case and date, else by title alone; the smallest id of the best tier.
    ``items`` has ``id, publisher_id, source_key, title`` and the column named by ``date``.
    """
    rows = items.select(F.col("id").alias("item_id"), F.col("publisher_id").alias("_p"), F.col("source_key").alias("_key"), F.lower("title").alias("_title"), F.col(date).alias("_date"))
    # Each tier keeps one item of a key before it meets what is wanted, so titles that many share cost a row each.
    least = F.min("item_id").alias("item_id")
    by_key = wanted.where(usable(F.col("key"))).join(rows.groupBy("_p", "_key").agg(least), (F.col("publisher_id") == F.col("_p")) & (F.col("key") == F.col("_key"))).select("ref", F.lit(1).alias("tier"), "item_id")
    titled = (F.col("publisher_id") == F.col("_p")) & (F.lower("title") == F.col("_title"))
    by_date = wanted.join(rows.where("_date is not null").groupBy("_p", "_title", "_date").agg(least), titled & (F.col("date") == F.col("_date"))).select("ref", F.lit(2).alias("tier"), "item_id")
    by_title = wanted.join(rows.groupBy("_p", "_title").agg(least), titled).select("ref", F.lit(3).alias("tier"), "item_id")
    best = by_key.unionByName(by_date).unionByName(by_title).groupBy("ref").agg(F.min(F.struct("tier", "item_id")).alias("b"))
    return wanted.select("ref").join(best, "ref", "left").select("ref", "b.tier", "b.item_id")


def named_entities(stored: DataFrame, remote: DataFrame, kind: str) -> DataFrame:
    """Next ``(id, name, url)`` and outcome of named entities: a text that is not blank overwrites, a new one without a name gets one.

    ``remote`` may repeat an id: the name and link that sort last count.  Rows without an id are left out.
    """
    new = remote.where("id is not null").groupBy("id").agg(F.max(clean(F.col("name"))).alias("n"), F.max(clean(F.col("url"))).alias("u"))
    both = stored.select("id", "name", "url", F.lit(True).alias("_old")).join(new.withColumn("_new", F.lit(True)), "id", "full")
    unnamed = F.concat(F.lit(f"Unknown {kind} "), F.col("id").cast("string"))
    name = F.when(F.col("_old"), merged_value(F.col("name"), F.coalesce("n", F.lit("")), True)).otherwise(F.when(F.col("n") == "", unnamed).otherwise(F.col("n")))
    url = F.when(F.col("_old"), merged_value(F.col("url"), F.coalesce("u", F.lit("")), True)).otherwise(F.col("u"))
    outcome = F.when(F.col("_old").isNull(), "created").when(F.col("_new").isNull(), "kept").when(name.eqNullSafe(F.col("name")) & url.eqNullSafe(F.col("url")), "unchanged").otherwise("updated")
    return both.select("id", name.alias("name"), url.alias("url"), outcome.alias("outcome"))


def known_links(links: DataFrame, known: DataFrame) -> DataFrame:
    """``links (ref, href)`` with whether any stored spelling of the link exists in ``known (url)``.

    Each link's spellings are few, so they are exploded and met by a semi join; a hot link costs a row a spelling.
    """
    spelled = links.select("ref", F.explode(url_variants(F.col("href"))).alias("_v"))
    hits = spelled.join(known.select(F.col("url").alias("_v")).where("_v <> ''").distinct(), "_v", "left_semi").select("ref").distinct()
    return links.join(hits.withColumn("_hit", F.lit(True)), "ref", "left").select("ref", "href", F.coalesce("_hit", F.lit(False)).alias("known"))


def link_counts(links: DataFrame, known: DataFrame, done: DataFrame) -> DataFrame:
    """``outcome, n`` of seed links: known by link or by key, pending, or a repeat of one on the page or done before.

    ``links (position, href)``, ``known (url, key)``, ``done (key)``; keys are links as they are compared.
    """
    rows = links.where(clean(F.col("href")) != "").select("position", clean(F.col("href")).alias("href"), url_key(F.col("href")).alias("key"))
    # Of the links that share a key only the first may count; minima are made before the shuffle.
    first = rows.groupBy("key").agg(F.min_by("href", "position").alias("href"), F.count(F.lit(1)).alias("n"))
    told = first.join(done.select("key", F.lit(True).alias("_done")).distinct(), "key", "left")
    told = told.join(known.select(F.col("url").alias("href"), F.lit(True).alias("_url")).distinct(), "href", "left").join(known.select("key", F.lit(True).alias("_key")).distinct(), "key", "left")
    outcome = F.when(F.col("_url"), "exact link").when(F.col("_key"), "key").otherwise("pending")
    fresh = told.where("_done is null").groupBy(outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))
    repeats = told.agg(F.coalesce(F.sum(F.when(F.col("_done"), F.col("n")).otherwise(F.col("n") - 1)), F.lit(0)).alias("n")).select(F.lit("repeat").alias("outcome"), "n").where("n > 0")
    return fresh.unionByName(repeats)


def status_plan(issues: DataFrame, default: str, chosen: DataFrame | None = None) -> DataFrame:
    """``(issue_id, status, position)`` for the issues of runs, in order of date and number: one status for all, or each its chosen one."""
    order = Window.partitionBy("run_id").orderBy(F.col("published_date").asc_nulls_first(), "issue_number", "issue_id")
    rows = issues.select(F.col("id").alias("issue_id"), "run_id", "published_date", "issue_number")
    if chosen is not None:
        rows = rows.join(chosen.select("issue_id", F.col("status").alias("_chosen")), "issue_id", "left")
    status = F.coalesce("_chosen", F.lit(default)) if chosen is not None else F.lit(default)
    return rows.withColumn("position", F.row_number().over(order)).select("run_id", "issue_id", status.alias("status"), "position")


def selected_sources(sources: DataFrame, ids: DataFrame | None = None, publisher: str | None = None, limit: int | None = None) -> tuple[DataFrame, DataFrame]:
    """Source volumes to work on, in order of title, year and id, and the ids that were asked for but are not there."""
    rows = sources
    missing = sources.select("id").limit(0)
    if ids is not None:
        rows, missing = rows.join(ids.select("id").distinct(), "id", "left_semi"), ids.select("id").distinct().join(sources, "id", "left_anti")
    elif publisher is not None:
        rows = rows.where(F.lower("publisher") == publisher.lower())
    rows = rows.orderBy(F.lower("name"), "start_year", "id")
    return (rows.limit(limit) if limit else rows), missing


def needs_update(stored: dict[str, Column], stated: dict[str, Column], always: tuple[str, ...] = (), if_blank: tuple[str, ...] = ()) -> Column:
    """Whether what a source states changes a row: stated texts of ``always`` that differ, and of ``if_blank`` where nothing is stored."""
    out = F.lit(False)
    for f in always:
        out = out | (F.coalesce(usable(stated[f]), F.lit(False)) & ~stored[f].eqNullSafe(stated[f]))
    for f in if_blank:
        out = out | (F.coalesce(usable(stated[f]), F.lit(False)) & ~F.coalesce(usable(stored[f]), F.lit(False)))
    return out
