"""What readers' pages and the pages of items show, for one reader and any number of items at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.source import labelled_title
from longbox.functions.text import clean, date_or_unknown, usable
from longbox.operators import credits, listing, tracking
from longbox.operators.listing import ordered
from longbox.sources.tables import Catalog

#: Kinds of progress by listing, and the order of each listing of a reader.
KINDS = {"runs": "run", "issues": "issue", "volumes": "volume", "one_shots": "one_shot"}
READER_ORDER = {
    "runs": ("-followed_at", "publisher", "title", "id"),
    "volumes": ("publisher", "release_date", "run_title", "volume_number", "title", "id"),
    "issues": ("publisher", "run_title", "published_date", "issue_number", "id"),
    "one_shots": ("publisher", "published_date", "title", "id"),
}


def _mine(c: Catalog, user_id: int, kind: str) -> DataFrame:
    rows = c.progress.where((F.col("user_id") == user_id) & (F.col("kind") == kind))
    return rows.select(F.col("object_id").alias("id"), F.col("status").alias("reading_status"), F.col("updated_at").alias("followed_at"))


def _publisher_of(c: Catalog, publisher_id: int | None, run_id: int | None, issue_id: int | None, volume_id: int | None, one_shot_id: int | None) -> DataFrame | None:
    """``publisher_id`` of the most specific selection; None where nothing is selected."""
    if one_shot_id is not None:
        return c.one_shots.where(F.col("id") == one_shot_id).select("publisher_id")
    if issue_id is not None:
        return c.runs.join(c.issues.where(F.col("id") == issue_id).select(F.col("run_id").alias("id")), "id", "left_semi").select("publisher_id")
    if volume_id is not None:
        return c.volumes.where(F.col("id") == volume_id).select("publisher_id")
    if run_id is not None:
        return c.runs.where(F.col("id") == run_id).select("publisher_id")
    return None if publisher_id is None else c.publishers.where(F.col("id") == publisher_id).select(F.col("id").alias("publisher_id"))


def with_counts(c: Catalog, user_id: int, runs: DataFrame) -> DataFrame:
    """``runs`` with the numbers of their issues in the catalogue and of those that the reader tracks.

    Only issues of these runs are counted, partly before the shuffle, so a long run costs one row a task.
    """
    issues = c.issues.join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi").select("id", "run_id")
    counted = issues.join(_mine(c, user_id, "issue").select("id", F.lit(1).alias("_one")), "id", "left")
    counts = counted.groupBy(F.col("run_id").alias("id")).agg(F.count(F.lit(1)).alias("n_catalogue"), F.count("_one").alias("n_tracked"))
    return runs.join(counts, "id", "left").fillna(0, ["n_catalogue", "n_tracked"])


def reader_listings(c: Catalog, user_id: int, publisher_id: int | None = None, run_id: int | None = None, issue_id: int | None = None, volume_id: int | None = None, one_shot_id: int | None = None) -> dict[str, DataFrame]:
    """A reader's runs, issues, volumes and one-shots with ``reading_status`` and ``followed_at``.

    The most specific selection decides as in ``listing.browse``; rows must also be of its publisher.
    """
    asked = (publisher_id, run_id, issue_id, volume_id, one_shot_id)
    publisher = _publisher_of(c, *asked)
    out = {}
    for name, rows in listing.browse(c, *asked).items():
        rows = rows if publisher is None else rows.join(publisher, "publisher_id", "left_semi")
        out[name] = rows.join(_mine(c, user_id, KINDS[name]), "id")
    out["runs"] = with_counts(c, user_id, out["runs"])
    return out


def reader_options(c: Catalog, kind: str, user_id: int, text: str = "", publisher_id: int | None = None, run_id: int | None = None) -> tuple[DataFrame, tuple[str, ...]]:
    """Options of a filter on a reader's pages and their order: only what the reader tracks is offered."""
    of = lambda rows, key: rows.where(F.col("user_id") == user_id).select(F.col(key).alias("id")).distinct()
    if kind == "publisher":
        rows, own, order = listing.publisher_options(c, text), of(tracking.tracked_publishers(c), "publisher_id"), listing.PUBLISHER_ORDER
    elif kind == "run":
        rows, own, order = listing.run_options(c, text, publisher_id), of(tracking.tracked_runs(c), "run_id"), listing.RUN_ORDER
    elif kind == "issue":
        rows, own, order = listing.issue_options(c, text, publisher_id, run_id), of(tracking.tracked_issues(c), "issue_id"), listing.ISSUE_ORDER
    elif kind == "volume":  # volumes with progress of their own
        rows, own, order = listing.volume_options(c, text, publisher_id, run_id), _mine(c, user_id, "volume").select("id"), listing.VOLUME_ORDER
    elif kind == "one_shot":
        rows, own, order = listing.one_shot_options(c, text, publisher_id), of(tracking.tracked_one_shots(c), "one_shot_id"), listing.ONE_SHOT_ORDER
    else:
        raise ValueError(f"no options of kind {kind!r}")
    return rows.join(own, "id", "left_semi"), order


def _joined(*parts: Column) -> Column:
    return F.concat_ws(" ", *[F.coalesce(p, F.lit("")) for p in parts])


def volume_title(title: Column, run_title: Column, number: Column) -> Column:
    """A volume's own title, else its run's with its number, else its run's, else nothing."""
    run, n = clean(run_title), clean(number)
    return F.when(clean(title) != "", clean(title)).when(run_title.isNull(), "").when(n != "", F.concat(run, F.lit(" Vol. "), n)).otherwise(run)


def shown_options(kind: str, rows: DataFrame, selected: int | None = None) -> DataFrame:
    """``id, label, meta, search_label, active`` of options; a column ``issue_count`` is shown where there is one."""
    count = F.col("issue_count") if "issue_count" in rows.columns else F.lit(None).cast("long")
    counted = F.when(F.coalesce(count, F.lit(0)) > 0, F.concat(count.cast("string"), F.lit(" issues")))
    col, dot = F.col, " · "
    if kind == "publisher":
        label, meta, search = col("label"), F.lit(""), col("label")
    elif kind == "run":
        year = F.when(usable(col("start_year")), col("start_year")).otherwise("Unknown year")
        label, meta = F.concat(year, F.lit(" — "), "title"), F.concat_ws(dot, "publisher", F.coalesce(counted, F.lit("issue count unknown")))
        search = _joined(col("title"), col("start_year"), col("publisher"))
    elif kind == "issue":
        label, meta = F.concat("run_title", F.lit(" #"), "issue_number"), F.concat_ws(dot, "publisher", date_or_unknown(col("published_date")))
        search = _joined(col("run_title"), col("run_year"), col("issue_number"), col("publisher"))
    elif kind == "volume":
        run = F.coalesce(labelled_title(col("run_title"), col("run_year")), F.lit("No primary run"))
        label, meta = volume_title(col("title"), col("run_title"), col("volume_number")), F.concat_ws(dot, "publisher", F.when(col("run_title").isNull(), "No primary run").otherwise(run), counted)
        search = _joined(col("title"), col("run_title"), col("volume_number"), col("publisher"))
    elif kind == "one_shot":
        label, meta = col("title"), F.concat_ws(dot, "publisher", date_or_unknown(col("published_date")))
        search = _joined(col("title"), col("start_year"), col("publisher"))
    else:
        raise ValueError(f"no options of kind {kind!r}")
    active = F.lit(False) if selected is None else F.col("id") == selected
    return rows.select("id", label.alias("label"), meta.alias("meta"), search.alias("search_label"), active.alias("active"))


def tracking_of(c: Catalog, kind: str, user_id: int, items: DataFrame) -> DataFrame:
    """``id, tracked, status, status_label`` of ``items (id)``, and counts of issues where they are runs."""
    rows = items.select("id").join(_mine(c, user_id, kind).select("id", "reading_status"), "id", "left")
    rows = with_counts(c, user_id, rows) if kind == "run" else rows
    status = F.coalesce("reading_status", F.lit(""))
    counts = ["n_catalogue", "n_tracked"] if kind == "run" else []
    return rows.select("id", F.col("reading_status").isNotNull().alias("tracked"), status.alias("status"), F.initcap(F.replace(status, F.lit("_"), F.lit(" "))).alias("status_label"), *counts)


def follow_options(c: Catalog, user_id: int, runs: DataFrame) -> DataFrame:
    """Issues of ``runs (run_id)`` in order, with the reader's status of each: ``run_id, id, label, meta, status, position``."""
    issues = c.issues.join(runs.select("run_id"), "run_id", "left_semi").join(_mine(c, user_id, "issue").select("id", "reading_status"), "id", "left")
    order = Window.partitionBy("run_id").orderBy(*ordered(("published_date", "issue_number", "id")))
    label = F.concat(F.lit("#"), F.coalesce("issue_number", F.lit("")))
    return issues.select("run_id", "id", label.alias("label"), date_or_unknown(F.col("published_date")).alias("meta"), F.coalesce("reading_status", F.lit("")).alias("status"), F.row_number().over(order).alias("position"))


# Pages of items ------------------------------------------------------------------------------------------------


def _placed(rows: DataFrame, owner: str, order: tuple[str, ...]) -> DataFrame:
    return rows.withColumn("position", F.row_number().over(Window.partitionBy(owner).orderBy(*ordered(order))))


def shown_issues(c: Catalog, user_id: int, issues: DataFrame) -> DataFrame:
    """``issues (id, ...)`` with names of their writers and pencillers and the reader's status; their credits alone are read."""
    held = issues.select(F.col("id").alias("target_id")).distinct()
    own = replace(c, credits=c.credits.where("target_kind = 'issue'").join(held, "target_id", "left_semi"))
    names = {k: credits.joined_names(own, role).select(F.col("issue_id").alias("id"), F.col("names").alias(k)) for k, role in (("writers", "Writer"), ("pencillers", "Penciller"))}
    rows = issues.join(names["writers"], "id", "left").join(names["pencillers"], "id", "left").fillna("", ["writers", "pencillers"])
    return rows.join(_mine(c, user_id, "issue").select("id", F.col("reading_status").alias("status")), "id", "left").fillna("", ["status"])


def run_pages(c: Catalog, user_id: int, runs: DataFrame) -> dict[str, DataFrame]:
    """What the pages of ``runs (run_id)`` show: issues by date and number, volumes that reach them, unique credits, tracking."""
    issues = c.issues.join(runs.select("run_id"), "run_id", "left_semi")
    reached = listing.reached_runs(c).join(runs.select("run_id"), "run_id", "left_semi").withColumnRenamed("volume_id", "id")
    return {
        "issues": _placed(shown_issues(c, user_id, issues), "run_id", ("published_date", "issue_number", "id")),
        "volumes": _placed(c.volumes.drop("run_id").join(reached, "id"), "run_id", ("volume_number", "release_date", "title", "id")),
        "credits": credits.run_credits(replace(c, issues=issues)),
        "tracking": tracking_of(c, "run", user_id, runs.select(F.col("run_id").alias("id"))),
    }


def issue_pages(c: Catalog, user_id: int, issues: DataFrame) -> dict[str, DataFrame]:
    """What the pages of ``issues (issue_id)`` show: issues of the same run, volumes that hold them, credits, tracking.

    ``siblings`` are of the run and given once for all its pages, by ``run_id``.
    """
    own = c.issues.join(issues.select(F.col("issue_id").alias("id")), "id", "left_semi")
    held = c.volume_issues.join(issues.select("issue_id"), "issue_id", "left_semi").select("issue_id", F.col("volume_id").alias("id"))
    rows = c.credits.where("target_kind = 'issue'").join(issues.select(F.col("issue_id").alias("target_id")), "target_id", "left_semi")
    return {
        "siblings": run_pages(c, user_id, own.select("run_id").distinct())["issues"],
        "volumes": _placed(c.volumes.join(held, "id"), "issue_id", ("volume_number", "release_date", "title", "id")),
        "credits": credits._named(c, rows).withColumnRenamed("target_id", "issue_id"),
        "tracking": tracking_of(c, "issue", user_id, own),
    }


def volume_pages(c: Catalog, user_id: int, volumes: DataFrame) -> dict[str, DataFrame]:
    """What the pages of ``volumes (volume_id)`` show: linked runs, issues, one-shots, issues by run, unique credits, tracking."""
    of = lambda rows: rows.join(volumes.select("volume_id"), "volume_id", "left_semi")
    own = replace(c, volumes=c.volumes.join(volumes.select(F.col("volume_id").alias("id")), "id", "left_semi"), volume_runs=of(c.volume_runs), volume_issues=of(c.volume_issues), volume_one_shots=of(c.volume_one_shots))
    runs = own.volume_runs.join(c.runs.select(F.col("id").alias("run_id"), "title", "start_year"), "run_id")
    issues = own.volume_issues.join(c.issues.withColumnRenamed("id", "issue_id"), "issue_id")
    shots = own.volume_one_shots.join(c.one_shots.withColumnRenamed("id", "one_shot_id"), "one_shot_id")
    named = of(credits.volume_credits(own))
    return {
        "runs": _placed(runs, "volume_id", ("item_order", "title", "start_year", "run_id")),
        "issues": _placed(issues, "volume_id", ("issue_order", "published_date", "issue_number", "issue_id")),
        "one_shots": _placed(shots, "volume_id", ("item_order", "published_date", "title", "one_shot_id")),
        "groups": credits.issue_groups(own),
        "credits": named,
        "tracking": tracking_of(c, "volume", user_id, own.volumes),
    }


def one_shot_pages(c: Catalog, user_id: int, shots: DataFrame) -> dict[str, DataFrame]:
    """What the pages of ``shots (one_shot_id)`` show: credits, of which some are shown at first, and tracking."""
    ids = shots.select(F.col("one_shot_id").alias("target_id"))
    rows = c.credits.where("target_kind = 'one_shot'").join(ids, "target_id", "left_semi")
    return {"credits": credits._named(c, rows).withColumnRenamed("target_id", "one_shot_id"), "tracking": tracking_of(c, "one_shot", user_id, ids.withColumnRenamed("target_id", "id"))}
