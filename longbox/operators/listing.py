"""Faceted browsing, ranked type-ahead and paging.

Every order is written out with the place of nulls and ends in the primary key, so that pages are stable.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.text import date_or_unknown, lenient_int, non_negative_int, usable
from longbox.sources.tables import Catalog

PAGE_ROWS = 10


def desc(name: str) -> Column:
    """Newest first as the catalogue lists it: rows without a value stand first."""
    return F.col(name).desc_nulls_first()


def asc(name: str) -> Column:
    return F.col(name).asc_nulls_last()


def ordered(names: tuple[str, ...]) -> list[Column]:
    """Columns of an order written as names, a minus before those that run down."""
    return [desc(n[1:]) if n.startswith("-") else asc(n) for n in names]


def page(rows: DataFrame, order: tuple[str, ...], limit: int = PAGE_ROWS, offset: int = 0) -> DataFrame:
    """Rows ``offset`` to ``offset + limit`` in order, numbered, with ``has_more`` and ``next_offset``.

    One row more than asked for is read, so that no count is needed; the top of each task is all that is moved.
    """
    from pyspark.sql import Window

    columns = ordered(order)
    top = rows.orderBy(*columns).limit(offset + limit + 1)
    numbered = top.withColumn("position", F.row_number().over(Window.orderBy(*columns)))
    total = F.count(F.lit(1)).over(Window.partitionBy())
    numbered = numbered.withColumn("has_more", total > offset + limit)
    shown = numbered.where((F.col("position") > offset) & (F.col("position") <= offset + limit))
    return shown.withColumn("next_offset", F.lit(offset) + F.least(F.count(F.lit(1)).over(Window.partitionBy()), F.lit(limit)))


def _matches(c: Column, text: str, how: str) -> Column:
    value, wanted = F.lower(c), F.lit(text.lower())
    return {"is": value == wanted, "starts": F.startswith(value, wanted), "has": F.contains(value, wanted)}[how]


def ranked(rows: DataFrame, text: str, fields: list[str], ranks: list[tuple[str, str]]) -> DataFrame:
    """Rows where any of ``fields`` holds ``text``, with ``search_rank``: the first of ``ranks`` (field, how) that fits."""
    if not text:
        return rows.withColumn("search_rank", F.lit(0))
    found = F.lit(False)
    for f in fields:
        found = found | F.coalesce(_matches(F.col(f), text, "has"), F.lit(False))
    rank = F.lit(len(ranks))
    for k, (f, how) in reversed(list(enumerate(ranks))):
        rank = F.when(_matches(F.col(f), text, how), k).otherwise(rank)
    return rows.where(found).withColumn("search_rank", rank)


def run_rows(c: Catalog) -> DataFrame:
    publishers = c.publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher"))
    return c.runs.join(publishers, "publisher_id")


def issue_rows(c: Catalog) -> DataFrame:
    runs = run_rows(c).select(F.col("id").alias("run_id"), "publisher_id", "publisher", F.col("title").alias("run_title"), F.col("start_year").alias("run_year"))
    return c.issues.join(runs, "run_id")


def volume_rows(c: Catalog) -> DataFrame:
    publishers = c.publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher"))
    runs = c.runs.select(F.col("id").alias("run_id"), F.col("title").alias("run_title"), F.col("start_year").alias("run_year"))
    return c.volumes.join(publishers, "publisher_id").join(runs, "run_id", "left")


def one_shot_rows(c: Catalog) -> DataFrame:
    return c.one_shots.join(c.publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher")), "publisher_id")


def publisher_options(c: Catalog, text: str = "") -> DataFrame:
    return ranked(c.publishers, text, ["name"], [("name", "is"), ("name", "starts")]).select("id", F.col("name").alias("label"), "search_rank")


PUBLISHER_ORDER = ("search_rank", "label", "id")


def run_options(c: Catalog, text: str = "", publisher_id: int | None = None) -> DataFrame:
    rows = run_rows(c)
    rows = rows if publisher_id is None else rows.where(F.col("publisher_id") == publisher_id)
    return ranked(rows, text, ["title", "start_year", "publisher"], [("title", "is"), ("title", "starts"), ("publisher", "starts"), ("title", "has")])


RUN_ORDER = ("search_rank", "-start_year", "-first_issue_date", "publisher", "title", "id")


def issue_options(c: Catalog, text: str = "", publisher_id: int | None = None, run_id: int | None = None) -> DataFrame:
    rows = issue_rows(c)
    rows = rows if publisher_id is None else rows.where(F.col("publisher_id") == publisher_id)
    rows = rows if run_id is None else rows.where(F.col("run_id") == run_id)
    return ranked(rows, text, ["issue_number", "run_title", "run_year", "publisher"], [("issue_number", "is"), ("issue_number", "starts"), ("run_title", "is"), ("run_title", "starts"), ("run_title", "has")])


ISSUE_ORDER = ("search_rank", "-run_year", "-published_date", "run_title", "issue_number", "id")


def reached_runs(c: Catalog) -> DataFrame:
    """``(volume_id, run_id)``: a volume reaches its own run, the runs linked with it and those of its issues, each once."""
    own = c.volumes.where("run_id is not null").select(F.col("id").alias("volume_id"), "run_id")
    linked = c.volume_runs.select("volume_id", "run_id")
    through = c.volume_issues.join(c.issues.select(F.col("id").alias("issue_id"), "run_id"), "issue_id").select("volume_id", "run_id")
    return own.unionByName(linked).unionByName(through).distinct()


def volumes_of_run(c: Catalog, run_ids: DataFrame) -> DataFrame:
    """Volumes that reach any of ``run_ids (run_id)``."""
    ids = reached_runs(c).join(run_ids, "run_id", "left_semi").select(F.col("volume_id").alias("id")).distinct()
    return c.volumes.join(ids, "id", "left_semi")


def volume_options(c: Catalog, text: str = "", publisher_id: int | None = None, run_id: int | None = None) -> DataFrame:
    """Volumes by their own text, or by the title of a run that they reach."""
    rows = volume_rows(c)
    rows = rows if publisher_id is None else rows.where(F.col("publisher_id") == publisher_id)
    if run_id is not None:
        ids = reached_runs(c).where(F.col("run_id") == run_id).select(F.col("volume_id").alias("id"))
        rows = rows.join(ids, "id", "left_semi")
    if not text:
        return rows.withColumn("search_rank", F.lit(0))
    named = c.runs.where(_matches(F.col("title"), text, "has")).select(F.col("id").alias("run_id"))
    reach = reached_runs(c).join(named, "run_id", "left_semi").select(F.col("volume_id").alias("id"), F.lit("x").alias("reached")).distinct()
    rows = rows.join(reach, "id", "left").withColumn("reached", F.when(F.col("reached").isNotNull(), text).otherwise(""))
    ranks = [("title", "is"), ("run_title", "is"), ("title", "starts"), ("run_title", "starts"), ("title", "has"), ("run_title", "has")]
    return ranked(rows, text, ["title", "run_title", "reached", "volume_number", "publisher"], ranks).drop("reached")


VOLUME_ORDER = ("search_rank", "-release_date", "-run_year", "run_title", "volume_number", "title", "id")


def one_shot_options(c: Catalog, text: str = "", publisher_id: int | None = None) -> DataFrame:
    rows = one_shot_rows(c)
    rows = rows if publisher_id is None else rows.where(F.col("publisher_id") == publisher_id)
    return ranked(rows, text, ["title", "start_year", "publisher"], [("title", "is"), ("title", "starts"), ("publisher", "starts"), ("title", "has")])


ONE_SHOT_ORDER = ("search_rank", "-published_date", "-start_year", "publisher", "title", "id")


# Selections ----------------------------------------------------------------------------------------------------


def _looked_up(rows: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """``rows`` left joined with ``table`` by ``key``; rows without a key are dealt out by the others, not to one task."""
    spread = F.coalesce(F.col(key), F.xxhash64(*[c for c in rows.columns if c != key]))
    found = table.withColumnRenamed(key, "_key")
    return rows.withColumn("_spread", spread).join(found, (F.col("_spread") == F.col("_key")) & F.col(key).isNotNull(), "left").drop("_spread", "_key")


def selection(requests: DataFrame, c: Catalog) -> DataFrame:
    """Requests (publisher_id, run_id, issue_id, volume_id, one_shot_id) with the most specific selection and its parents.

    One-shots go before issues, issues before volumes, volumes before runs, runs before publishers.  An id that
    names nothing counts as not given.
    """
    known = requests
    for name, rows in (("one_shot", c.one_shots), ("issue", c.issues), ("volume", c.volumes), ("run", c.runs), ("publisher", c.publishers)):
        parent = {"one_shot": "publisher_id", "issue": "run_id", "volume": "publisher_id", "run": "publisher_id"}.get(name)
        cols = [F.col("id").alias(f"{name}_id"), F.lit(True).alias(f"_{name}")] + ([F.col(parent).alias(f"_{name}_parent")] if parent else [])
        known = _looked_up(known, rows.select(*cols), f"{name}_id")
    kind = F.lit("none")
    for name in ("publisher", "run", "volume", "issue", "one_shot"):
        kind = F.when(F.col(f"_{name}"), name).otherwise(kind)
    known = known.withColumn("selected", kind)
    run = F.when(F.col("selected") == "issue", F.col("_issue_parent")).when(F.col("selected") == "run", F.col("run_id"))
    parents = c.runs.select(F.col("id").alias("selected_run_id"), F.col("publisher_id").alias("_of_run"))
    known = _looked_up(known.withColumn("selected_run_id", run), parents, "selected_run_id")
    publisher = F.when(F.col("selected") == "one_shot", F.col("_one_shot_parent")).when(F.col("selected") == "volume", F.col("_volume_parent")).when(F.col("selected").isin("issue", "run"), F.col("_of_run")).when(F.col("selected") == "publisher", F.col("publisher_id"))
    return known.select(*requests.columns, "selected", "selected_run_id", publisher.alias("selected_publisher_id"))


def browse(c: Catalog, publisher_id: int | None = None, run_id: int | None = None, issue_id: int | None = None, volume_id: int | None = None, one_shot_id: int | None = None) -> dict[str, DataFrame]:
    """The four coordinated listings under the most specific selection; those it says nothing about are empty."""
    none = F.lit(False)
    runs, issues, volumes, shots = run_rows(c), issue_rows(c), volume_rows(c), one_shot_rows(c)
    if one_shot_id is not None:
        return {"runs": runs.where(none), "issues": issues.where(none), "volumes": volumes.join(c.volume_one_shots.where(F.col("one_shot_id") == one_shot_id).select(F.col("volume_id").alias("id")), "id", "left_semi"), "one_shots": shots.where(F.col("id") == one_shot_id)}
    if issue_id is not None:
        return {"runs": runs.join(c.issues.where(F.col("id") == issue_id).select(F.col("run_id").alias("id")), "id", "left_semi"), "issues": issues.where(F.col("id") == issue_id), "volumes": volumes.join(c.volume_issues.where(F.col("issue_id") == issue_id).select(F.col("volume_id").alias("id")), "id", "left_semi"), "one_shots": shots.where(none)}
    if volume_id is not None:
        mine = F.col("volume_id") == volume_id
        return {
            "runs": runs.join(reached_runs(c).where(mine).select(F.col("run_id").alias("id")), "id", "left_semi"),
            "issues": issues.join(c.volume_issues.where(mine).select(F.col("issue_id").alias("id")), "id", "left_semi"),
            "volumes": volumes.where(F.col("id") == volume_id),
            "one_shots": shots.join(c.volume_one_shots.where(mine).select(F.col("one_shot_id").alias("id")), "id", "left_semi"),
        }
    if run_id is not None:
        return {"runs": runs.where(F.col("id") == run_id), "issues": issues.where(F.col("run_id") == run_id), "volumes": volumes.join(reached_runs(c).where(F.col("run_id") == run_id).select(F.col("volume_id").alias("id")), "id", "left_semi"), "one_shots": shots.where(none)}
    every = {"runs": runs, "issues": issues, "volumes": volumes, "one_shots": shots}
    return every if publisher_id is None else {k: d.where(F.col("publisher_id") == publisher_id) for k, d in every.items()}


# Rows as shown -------------------------------------------------------------------------------------------------


def shown_runs(c: Catalog) -> DataFrame:
    year = F.when(usable(F.col("start_year")), F.col("start_year")).otherwise("Unknown")
    label = F.initcap("status")
    return run_rows(c).select("id", "publisher", "title", year.alias("start_year"), (~usable(F.col("start_year"))).alias("start_year_muted"), date_or_unknown(F.col("first_issue_date")).alias("first_date"), F.col("first_issue_date").isNull().alias("first_date_muted"), date_or_unknown(F.col("last_issue_date")).alias("last_date"), label.alias("status_label"))


def shown_volumes(c: Catalog) -> DataFrame:
    """Volumes with a title to show and the range of their issues' numbers, a question mark for a missing end."""
    numbers = c.volume_issues.join(c.issues.select(F.col("id").alias("issue_id"), "issue_number"), "issue_id").groupBy("volume_id").agg(F.min_by("issue_number", F.struct("issue_order", "issue_id")).alias("first"), F.max_by("issue_number", F.struct("issue_order", "issue_id")).alias("last"))
    rows = volume_rows(c).join(numbers.withColumnRenamed("volume_id", "id"), "id", "left")
    title = F.when(usable(F.col("title")), F.col("title")).when(usable(F.col("run_title")), F.concat("run_title", F.lit(" Vol. "), "volume_number")).otherwise("")
    span = F.when(usable(F.col("first")) | usable(F.col("last")), F.concat(F.lit("#"), F.coalesce(F.nullif("first", F.lit("")), F.lit("?")), F.lit("–"), F.coalesce(F.nullif("last", F.lit("")), F.lit("?")))).otherwise("")
    return rows.select("id", "publisher", title.alias("title"), "volume_number", date_or_unknown(F.col("release_date")).alias("released"), span.alias("issue_range"))


def int_params(raw: DataFrame, column: str) -> DataFrame:
    """Request parameters as integers: null for a bad one, and never negative where an offset is meant."""
    return raw.select("*", lenient_int(F.col(column)).alias("as_id"), non_negative_int(F.col(column)).alias("as_offset"))
