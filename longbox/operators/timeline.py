"""Publication-order timeline of the runs that are read at present."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.text import natural_number_key
from longbox.sources.tables import Catalog


#: Titles that a reader must ask for (fixed values): beginnings for one publisher, whole titles for the other.
HIDDEN_PREFIXES = ("STAR WARS", "ALIEN", "ALIENS", "PREDATOR", "GODZILLA", "PLANET OF THE APES", "ULTRAMAN", "MARVEL & DISNEY", "MARVEL DISNEY", "DISNEY", "CONAN", "FORTNITE", "MARVEL X FORTNITE", "HALO", "WARHAMMER")
HIDDEN_TITLES = ("Action Comics", "Detective Comics")


def era_runs(c: Catalog, hidden_prefixes: tuple[str, ...] = (), first_year: int | None = None, this_year: int | None = None, hidden_titles: tuple[str, ...] = ()) -> DataFrame:
    """Runs that belong to the present era, less hidden titles and years outside the range."""
    rows = c.runs.join(c.era_runs, c.runs["id"] == c.era_runs["run_id"], "left_semi")
    for prefix in hidden_prefixes:
        rows = rows.where(~F.startswith(F.lower("title"), F.lit(prefix.lower())))
    if hidden_titles:
        rows = rows.where(~F.lower("title").isin([t.lower() for t in hidden_titles]))
    if first_year is not None:
        rows = rows.where(F.col("start_year").isin([str(y) for y in range(first_year, (this_year or first_year) + 1)]))
    return rows


def placed_issues(c: Catalog, runs: DataFrame) -> DataFrame:
    """``run_id, issue_id, published_date, column`` of the dated, released issues of ``runs``.

    A date is as wide as the most issues that one run has on it.  Issues of a run on a date stand side by side from
    the date's first column on.  Widths are summed over dates, of which there are few; issues are ranked by run and
    date where they lie.
    """
    issues = c.issues.where("is_released and published_date is not null").join(runs.select(F.col("id").alias("run_id")), "run_id", "left_semi")
    in_day = Window.partitionBy("run_id", "published_date").orderBy(natural_number_key(F.col("issue_number")), "id")
    ranked = issues.withColumn("nth", F.row_number().over(in_day))
    widths = ranked.groupBy("published_date").agg(F.max("nth").alias("width"))
    before = F.coalesce(F.sum("width").over(Window.orderBy("published_date").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = widths.select("published_date", before.alias("before"))
    return ranked.join(F.broadcast(starts), "published_date").select("run_id", F.col("id").alias("issue_id"), "issue_number", "published_date", (F.col("before") + F.col("nth")).alias("column"))


def timeline(c: Catalog, runs: DataFrame) -> DataFrame:
    """A row a run: place in order, columns it spans, number of issues.  Runs without issues keep their row."""
    spans = placed_issues(c, runs).groupBy("run_id").agg(F.min("column").alias("first_column"), (F.max("column") + 1).alias("line_end_column"), F.count(F.lit(1)).alias("n_issues"))
    return runs.join(spans, runs["id"] == spans["run_id"], "left").select("id", "title", "first_issue_date", "start_year", "first_column", "line_end_column", F.coalesce("n_issues", F.lit(0)).alias("n_issues"))


def run_order() -> list:
    return [F.col("first_issue_date").asc_nulls_last(), F.lower("title"), F.lower("start_year"), F.col("id")]


def summary(c: Catalog, runs: DataFrame) -> DataFrame:
    """One row: width of the timeline (1 at least), runs and issues."""
    issues = placed_issues(c, runs).agg(F.greatest(F.coalesce(F.max("column"), F.lit(0)), F.lit(1)).alias("column_count"), F.count(F.lit(1)).alias("issue_count"))
    return issues.join(F.broadcast(runs.agg(F.count(F.lit(1)).alias("run_count"))))


def year_options(runs: DataFrame, this_year: int) -> DataFrame:
    """Years from this one down to the oldest valid one."""
    oldest = runs.where(F.col("start_year").rlike(r"^\d{4}$")).agg(F.min(F.col("start_year").cast("int")).alias("oldest"))
    return oldest.select(F.explode(F.expr(f"sequence({this_year}, least(oldest, {this_year}), -1)")).alias("year"))
