"""Registered queries over the generated tables, each with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.functions import text as x
from longbox.operators import classify, credits, listing, merge, reports, timeline, tracking
from longbox.sources import records
from longbox.sources.tables import PROGRESS_SQL, STAND_INS, Catalog, star_catalog, table
from longbox.streaming import scans

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

_WITH = "WITH " + ",\n".join(f"{n} AS ({t})" for n, t in {**STAND_INS, "progress": PROGRESS_SQL}.items())
_REACH = """, reach AS (
  SELECT id AS volume_id, run_id FROM volumes WHERE run_id IS NOT NULL UNION SELECT volume_id, run_id FROM volume_runs
  UNION SELECT vi.volume_id, i.run_id FROM volume_issues vi JOIN issues i ON i.id = vi.issue_id)"""
_ERA = ", era AS (SELECT * FROM runs WHERE id IN (SELECT run_id FROM era_runs))"
_PLACED = (
    _ERA
    + """, numbered AS (
  SELECT i.*, regexp_extract(trim(issue_number), '^\\s*#?\\s*(-?\\d+(?:\\.\\d+)?)\\s*(.*)$', 1) AS num, regexp_extract(trim(issue_number), '^\\s*#?\\s*(-?\\d+(?:\\.\\d+)?)\\s*(.*)$', 2) AS rest
  FROM issues i WHERE is_released AND published_date IS NOT NULL AND run_id IN (SELECT id FROM era)
), nth AS (
  SELECT *, row_number() OVER (PARTITION BY run_id, published_date ORDER BY CASE WHEN num = '' THEN 1 ELSE 0 END, COALESCE(TRY_CAST(NULLIF(num, '') AS DOUBLE), 0), CASE WHEN num = '' THEN '' ELSE lower(trim(rest)) END, lower(trim(issue_number)), id) AS n FROM numbered
), widths AS (SELECT published_date, max(n) AS width FROM nth GROUP BY 1),
starts AS (SELECT published_date, COALESCE(sum(width) OVER (ORDER BY published_date ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM widths),
placed AS (SELECT run_id, nth.id AS issue_id, CAST(before + n AS BIGINT) AS col FROM nth JOIN starts USING (published_date))"""
)


def query(name: str, sql: str | None = None, catalog: bool = True) -> Callable:
    def keep(f: Callable) -> Callable:
        QUERIES[name] = (lambda spark, sf: f(star_catalog(spark, sf))) if catalog else f
        if sql:
            ORACLE[name] = (_WITH + sql) if catalog else sql
        return f

    return keep


# Timeline ------------------------------------------------------------------------------------------------------


@query(
    "timeline",
    _PLACED
    + " SELECT era.id, title, first_issue_date, start_year, CAST(min(col) AS BIGINT) AS first_column, CAST(max(col) + 1 AS BIGINT) AS line_end_column, count(issue_id) AS n_issues FROM era LEFT JOIN placed ON run_id = era.id GROUP BY era.id, title, first_issue_date, start_year",
)
def _timeline(c: Catalog) -> DataFrame:
    return timeline.timeline(c, timeline.era_runs(c))


@query("timeline_issues", _PLACED + " SELECT run_id, issue_id, col AS \"column\" FROM placed")
def _timeline_issues(c: Catalog) -> DataFrame:
    return timeline.placed_issues(c, timeline.era_runs(c)).select("run_id", "issue_id", F.col("column").cast("long").alias("column"))


@query("timeline_summary", _PLACED + " SELECT CAST(greatest(COALESCE(max(col), 0), 1) AS BIGINT) AS column_count, count(*) AS issue_count, (SELECT count(*) FROM era) AS run_count FROM placed")
def _timeline_summary(c: Catalog) -> DataFrame:
    return timeline.summary(c, timeline.era_runs(c)).select(F.col("column_count").cast("long").alias("column_count"), "issue_count", "run_count")


@query("era_filter", _ERA + " SELECT id, title, start_year FROM era WHERE NOT starts_with(lower(title), 'customer#00000000') AND start_year IN ('1993', '1994', '1995', '1996')")
def _era_filter(c: Catalog) -> DataFrame:
    return timeline.era_runs(c, ("Customer#00000000",), 1993, 1996).select("id", "title", "start_year")


@query("year_options", _ERA + " SELECT CAST(unnest(generate_series(CAST(min(CAST(start_year AS INTEGER)) AS INTEGER), 2003)) AS INTEGER) AS year FROM era WHERE regexp_matches(start_year, '^\\d{4}$')")
def _year_options(c: Catalog) -> DataFrame:
    return timeline.year_options(timeline.era_runs(c), 2003)


# Listings ------------------------------------------------------------------------------------------------------

_RUN_ROWS = ", run_rows AS (SELECT r.*, p.name AS publisher FROM runs r JOIN publishers p ON p.id = r.publisher_id)"


def _page_sql(rows: str, order: str, columns: str, limit: int = 10, offset: int = 0) -> str:
    return f""" SELECT {columns}, CAST(position AS INTEGER) AS position, total > {offset + limit} AS has_more FROM (
      SELECT *, row_number() OVER (ORDER BY {order}) AS position, least(count(*) OVER (), {offset + limit + 1}) AS total FROM ({rows}) r) t
      WHERE position > {offset} AND position <= {offset + limit}"""


@query("publisher_search", _page_sql("SELECT id, name AS label, CASE WHEN lower(name) = 'an' THEN 0 WHEN starts_with(lower(name), 'an') THEN 1 ELSE 2 END AS search_rank FROM publishers WHERE contains(lower(name), 'n')", "CASE WHEN lower(label) = 'n' THEN 0 WHEN starts_with(lower(label), 'n') THEN 1 ELSE 2 END, label, id", "id, label"))
def _publisher_search(c: Catalog) -> DataFrame:
    return listing.page(listing.publisher_options(c, "N"), listing.PUBLISHER_ORDER).select("id", "label", "position", "has_more")


@query(
    "run_search",
    _RUN_ROWS
    + _page_sql(
        "SELECT *, CASE WHEN lower(title) = '00001' THEN 0 WHEN starts_with(lower(title), '00001') THEN 1 WHEN starts_with(lower(publisher), '00001') THEN 2 WHEN contains(lower(title), '00001') THEN 3 ELSE 4 END AS rank FROM run_rows WHERE contains(lower(title), '00001') OR contains(start_year, '00001') OR contains(lower(publisher), '00001')",
        "rank, start_year DESC NULLS FIRST, first_issue_date DESC NULLS FIRST, publisher NULLS LAST, title NULLS LAST, id",
        "id, title, publisher, CAST(rank AS INTEGER) AS search_rank",
        10,
        5,
    ),
)
def _run_search(c: Catalog) -> DataFrame:
    return listing.page(listing.run_options(c, "00001"), listing.RUN_ORDER, 10, 5).select("id", "title", "publisher", "search_rank", "position", "has_more")


@query(
    "issue_search",
    _RUN_ROWS
    + _page_sql(
        "SELECT i.*, r.title AS run_title, r.start_year AS run_year, CASE WHEN lower(issue_number) = 'annual 1' THEN 0 WHEN starts_with(lower(issue_number), 'annual 1') THEN 1 ELSE 5 END AS rank FROM issues i JOIN run_rows r ON r.id = i.run_id WHERE contains(lower(issue_number), 'annual 1')",
        "rank, run_year DESC NULLS FIRST, published_date DESC NULLS FIRST, run_title NULLS LAST, issue_number NULLS LAST, id",
        "id, issue_number, run_title, CAST(rank AS INTEGER) AS search_rank",
        20,
    ),
)
def _issue_search(c: Catalog) -> DataFrame:
    return listing.page(listing.issue_options(c, "Annual 1"), listing.ISSUE_ORDER, 20).select("id", "issue_number", "run_title", "search_rank", "position", "has_more")


_VOLUME_ROWS = _REACH + ", volume_rows AS (SELECT v.*, p.name AS publisher, r.title AS run_title, r.start_year AS run_year FROM volumes v JOIN publishers p ON p.id = v.publisher_id LEFT JOIN runs r ON r.id = v.run_id)"


@query(
    "volume_search",
    _VOLUME_ROWS
    + _page_sql(
        """SELECT *, CASE WHEN lower(title) = 'red ring' THEN 0 WHEN lower(run_title) = 'red ring' THEN 1 WHEN starts_with(lower(title), 'red ring') THEN 2 WHEN starts_with(lower(run_title), 'red ring') THEN 3 WHEN contains(lower(title), 'red ring') THEN 4 WHEN contains(lower(run_title), 'red ring') THEN 5 ELSE 6 END AS rank FROM volume_rows
        WHERE contains(lower(title), 'red ring') OR contains(lower(run_title), 'red ring') OR contains(volume_number, 'red ring') OR contains(lower(publisher), 'red ring') OR id IN (SELECT volume_id FROM reach JOIN runs ON runs.id = reach.run_id WHERE contains(lower(title), 'red ring'))""",
        "rank, release_date DESC NULLS FIRST, run_year DESC NULLS FIRST, run_title NULLS LAST, volume_number NULLS LAST, title NULLS LAST, id",
        "id, title, CAST(rank AS INTEGER) AS search_rank",
    ),
)
def _volume_search(c: Catalog) -> DataFrame:
    return listing.page(listing.volume_options(c, "red ring"), listing.VOLUME_ORDER).select("id", "title", "search_rank", "position", "has_more")


@query(
    "volume_search_reach",
    _VOLUME_ROWS
    + " SELECT id, CAST(CASE WHEN contains(lower(run_title), '#000000007') AND starts_with(lower(run_title), '#000000007') THEN 3 WHEN contains(lower(run_title), '#000000007') THEN 5 ELSE 6 END AS INTEGER) AS search_rank FROM volume_rows WHERE contains(lower(run_title), '#000000007') OR id IN (SELECT volume_id FROM reach JOIN runs ON runs.id = reach.run_id WHERE contains(lower(title), '#000000007'))",
)
def _volume_search_reach(c: Catalog) -> DataFrame:
    return listing.volume_options(c, "#000000007").select("id", "search_rank")


@query(
    "one_shot_search",
    _page_sql(
        "SELECT o.*, p.name AS publisher, CASE WHEN contains(lower(title), '199') THEN 3 ELSE 4 END AS rank FROM one_shots o JOIN publishers p ON p.id = o.publisher_id WHERE contains(lower(title), '199') OR contains(start_year, '199') OR contains(lower(p.name), '199')",
        "rank, published_date DESC NULLS FIRST, start_year DESC NULLS FIRST, publisher NULLS LAST, title NULLS LAST, id",
        "id, title, CAST(rank AS INTEGER) AS search_rank",
    ),
)
def _one_shot_search(c: Catalog) -> DataFrame:
    return listing.page(listing.one_shot_options(c, "199"), listing.ONE_SHOT_ORDER).select("id", "title", "search_rank", "position", "has_more")


@query("browse_runs", _RUN_ROWS + _page_sql("SELECT * FROM run_rows WHERE publisher_id = 7", "start_year DESC NULLS FIRST, first_issue_date DESC NULLS FIRST, publisher NULLS LAST, title NULLS LAST, id", "id, title"))
def _browse_runs(c: Catalog) -> DataFrame:
    rows = listing.browse(c, publisher_id=7)["runs"].withColumn("search_rank", F.lit(0))
    return listing.page(rows, listing.RUN_ORDER).select("id", "title", "position", "has_more")


@query("browse_volume_runs", _REACH + " SELECT r.id, r.title FROM runs r WHERE r.id IN (SELECT run_id FROM reach WHERE volume_id = 12)")
def _browse_volume_runs(c: Catalog) -> DataFrame:
    return listing.browse(c, volume_id=12)["runs"].select("id", "title")


@query("browse_run_volumes", _REACH + " SELECT id, title FROM volumes WHERE id IN (SELECT volume_id FROM reach WHERE run_id = 6)")
def _browse_run_volumes(c: Catalog) -> DataFrame:
    return listing.browse(c, run_id=6)["volumes"].select("id", "title")


@query("browse_volume_issues", " SELECT id, run_id, issue_number FROM issues WHERE id IN (SELECT issue_id FROM volume_issues WHERE volume_id = 12)")
def _browse_volume_issues(c: Catalog) -> DataFrame:
    return listing.browse(c, volume_id=12)["issues"].select("id", "run_id", "issue_number")


@query("browse_one_shot_volumes", " SELECT id, title FROM volumes WHERE id IN (SELECT volume_id FROM volume_one_shots WHERE one_shot_id = 3)")
def _browse_one_shot_volumes(c: Catalog) -> DataFrame:
    return listing.browse(c, one_shot_id=3)["volumes"].select("id", "title")


@query("reached_runs", _REACH + " SELECT volume_id, count(*) AS n_runs, CAST(sum(run_id) AS BIGINT) AS run_sum FROM reach GROUP BY 1")
def _reached_runs(c: Catalog) -> DataFrame:
    return listing.reached_runs(c).groupBy("volume_id").agg(F.count(F.lit(1)).alias("n_runs"), F.sum("run_id").alias("run_sum"))


@query(
    "selection",
    """, asked AS (SELECT o_orderkey AS request, CASE WHEN o_orderkey % 2 = 0 THEN o_orderkey % 25 END AS publisher_id, CASE WHEN o_orderkey % 3 = 0 THEN o_custkey END AS run_id, CASE WHEN o_orderkey % 5 = 0 THEN o_orderkey * 3 END AS issue_id, CASE WHEN o_orderkey % 7 = 0 THEN o_orderkey % 200 END AS volume_id, CASE WHEN o_orderkey % 11 = 0 THEN o_orderkey % 10 END AS one_shot_id FROM orders)
    SELECT request, CASE WHEN s.id IS NOT NULL THEN 'one_shot' WHEN i.id IS NOT NULL THEN 'issue' WHEN v.id IS NOT NULL THEN 'volume' WHEN r.id IS NOT NULL THEN 'run' WHEN p.id IS NOT NULL THEN 'publisher' ELSE 'none' END AS selected,
      CASE WHEN s.id IS NOT NULL THEN s.publisher_id WHEN i.id IS NOT NULL THEN ir.publisher_id WHEN v.id IS NOT NULL THEN v.publisher_id WHEN r.id IS NOT NULL THEN r.publisher_id ELSE p.id END AS selected_publisher_id
    FROM asked a LEFT JOIN one_shots s ON s.id = one_shot_id LEFT JOIN issues i ON i.id = issue_id LEFT JOIN runs ir ON ir.id = i.run_id LEFT JOIN volumes v ON v.id = volume_id LEFT JOIN runs r ON r.id = a.run_id LEFT JOIN publishers p ON p.id = a.publisher_id""",
    catalog=True,
)
def _selection(c: Catalog) -> DataFrame:
    o = c.issues.select(F.col("id").alias("request"), "run_id")
    n = F.col("request")
    asked = o.select("request", F.when(n % 2 == 0, n % 25).alias("publisher_id"), F.when(n % 3 == 0, F.col("run_id")).alias("run_id"), F.when(n % 5 == 0, n * 3).alias("issue_id"), F.when(n % 7 == 0, n % 200).alias("volume_id"), F.when(n % 11 == 0, n % 10).alias("one_shot_id"))
    return listing.selection(asked, c).select("request", "selected", "selected_publisher_id")


@query(
    "shown_runs",
    _RUN_ROWS + " SELECT id, publisher, title, CASE WHEN start_year <> '' THEN start_year ELSE 'Unknown' END AS start_year, start_year = '' AS start_year_muted, COALESCE(strftime(first_issue_date, '%Y-%m-%d'), 'Unknown') AS first_date, first_issue_date IS NULL AS first_date_muted, COALESCE(strftime(last_issue_date, '%Y-%m-%d'), 'Unknown') AS last_date, upper(status[1]) || status[2:] AS status_label FROM run_rows",
)
def _shown_runs(c: Catalog) -> DataFrame:
    return listing.shown_runs(c)


@query(
    "shown_volumes",
    """, numbers AS (SELECT volume_id, first(issue_number ORDER BY issue_order, issue_id) AS a, last(issue_number ORDER BY issue_order, issue_id) AS b FROM volume_issues vi JOIN issues i ON i.id = vi.issue_id GROUP BY 1)
    SELECT v.id, p.name AS publisher, v.title, volume_number, COALESCE(strftime(release_date, '%Y-%m-%d'), 'Unknown') AS released,
      CASE WHEN COALESCE(a, '') <> '' OR COALESCE(b, '') <> '' THEN '#' || COALESCE(NULLIF(a, ''), '?') || '–' || COALESCE(NULLIF(b, ''), '?') ELSE '' END AS issue_range
    FROM volumes v JOIN publishers p ON p.id = v.publisher_id LEFT JOIN numbers n ON n.volume_id = v.id""",
)
def _shown_volumes(c: Catalog) -> DataFrame:
    return listing.shown_volumes(c)


# Credits -------------------------------------------------------------------------------------------------------

_NAMED = "JOIN people p ON p.id = person_id JOIN roles r ON r.id = role_id"


@query("run_credits", f""", best AS (SELECT run_id, role_id, person_id, min(COALESCE(credit_order, 2147483648)) AS o, count(DISTINCT target_id) AS n_issues FROM credits JOIN issues ON issues.id = target_id WHERE target_kind = 'issue' GROUP BY ALL)
    SELECT run_id, r.name AS role, p.name AS person, display_order, show_by_default, CAST(NULLIF(o, 2147483648) AS BIGINT) AS credit_order, n_issues FROM best {_NAMED}""")
def _run_credits(c: Catalog) -> DataFrame:
    return credits.run_credits(c)


@query(
    "volume_credits",
    f""", explicit AS (SELECT DISTINCT volume_id, run_id FROM volume_issues vi JOIN issues i ON i.id = vi.issue_id),
    fallback AS (SELECT volume_id, run_id FROM volume_runs UNION SELECT id, run_id FROM volumes WHERE run_id IS NOT NULL EXCEPT SELECT volume_id, run_id FROM explicit),
    every AS (SELECT target_id AS volume_id, role_id, person_id, credit_order FROM credits WHERE target_kind = 'volume'
      UNION ALL SELECT volume_id, role_id, person_id, credit_order FROM credits JOIN volume_issues ON issue_id = target_id WHERE target_kind = 'issue'
      UNION ALL SELECT volume_id, role_id, person_id, credit_order FROM credits JOIN volume_one_shots ON one_shot_id = target_id WHERE target_kind = 'one_shot'
      UNION ALL SELECT volume_id, role_id, person_id, credit_order FROM fallback f JOIN issues i ON i.run_id = f.run_id JOIN credits ON target_id = i.id WHERE target_kind = 'issue'),
    best AS (SELECT volume_id, role_id, person_id, min(COALESCE(credit_order, 2147483648)) AS o FROM every GROUP BY ALL)
    SELECT volume_id, r.name AS role, p.name AS person, display_order, show_by_default, CAST(NULLIF(o, 2147483648) AS BIGINT) AS credit_order FROM best {_NAMED}""",
)
def _volume_credits(c: Catalog) -> DataFrame:
    return credits.volume_credits(c)


@query("writer_names", f" SELECT target_id AS issue_id, string_agg(p.name, ', ' ORDER BY COALESCE(credit_order, 2147483648), p.name) AS names FROM credits {_NAMED} WHERE target_kind = 'issue' AND r.name = 'Writer' GROUP BY 1")
def _writer_names(c: Catalog) -> DataFrame:
    return credits.joined_names(c, "Writer")


@query(
    "volume_issue_groups",
    """, grouped AS (SELECT volume_id, run_id, count(*) AS n, min(issue_order) AS o, min(issue_order * 100000000 + issue_id) AS first FROM volume_issues vi JOIN issues i ON i.id = vi.issue_id GROUP BY ALL)
    SELECT volume_id, run_id, item_order IS NOT NULL AS linked, COALESCE(n, 0) AS n_issues, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY item_order NULLS LAST, first NULLS LAST, run_id) AS INTEGER) AS position
    FROM volume_runs FULL JOIN grouped USING (volume_id, run_id)""",
)
def _volume_issue_groups(c: Catalog) -> DataFrame:
    return credits.issue_groups(c)


# Tracking ------------------------------------------------------------------------------------------------------


@query("tracked_runs", _REACH + " SELECT user_id, object_id AS run_id FROM progress WHERE kind = 'run' UNION SELECT user_id, i.run_id FROM progress JOIN issues i ON i.id = object_id WHERE kind = 'issue' UNION SELECT user_id, reach.run_id FROM progress JOIN reach ON volume_id = object_id WHERE kind = 'volume'")
def _tracked_runs(c: Catalog) -> DataFrame:
    return tracking.tracked_runs(c)


@query("tracked_issues", " SELECT user_id, object_id AS issue_id FROM progress WHERE kind = 'issue' UNION SELECT user_id, i.id FROM progress JOIN issues i ON i.run_id = object_id WHERE kind = 'run' UNION SELECT user_id, issue_id FROM progress JOIN volume_issues ON volume_id = object_id WHERE kind = 'volume'")
def _tracked_issues(c: Catalog) -> DataFrame:
    return tracking.tracked_issues(c)


@query("tracked_volumes", _REACH + " SELECT user_id, object_id AS volume_id FROM progress WHERE kind = 'volume' UNION SELECT user_id, volume_id FROM progress JOIN volume_issues ON issue_id = object_id WHERE kind = 'issue' UNION SELECT user_id, volume_id FROM progress JOIN reach ON reach.run_id = object_id WHERE kind = 'run'")
def _tracked_volumes(c: Catalog) -> DataFrame:
    return tracking.tracked_volumes(c)


@query("tracked_one_shots", " SELECT user_id, object_id AS one_shot_id FROM progress WHERE kind = 'one_shot' UNION SELECT user_id, one_shot_id FROM progress JOIN volume_one_shots ON volume_id = object_id WHERE kind = 'volume'")
def _tracked_one_shots(c: Catalog) -> DataFrame:
    return tracking.tracked_one_shots(c)


@query("tracked_publishers", " SELECT user_id, publisher_id FROM progress JOIN runs r ON r.id = object_id WHERE kind = 'run' UNION SELECT user_id, publisher_id FROM progress JOIN issues i ON i.id = object_id JOIN runs r ON r.id = i.run_id WHERE kind = 'issue' UNION SELECT user_id, publisher_id FROM progress JOIN volumes v ON v.id = object_id WHERE kind = 'volume' UNION SELECT user_id, publisher_id FROM progress JOIN one_shots o ON o.id = object_id WHERE kind = 'one_shot'")
def _tracked_publishers(c: Catalog) -> DataFrame:
    return tracking.tracked_publishers(c)


@query(
    "run_progress",
    """, mine AS (SELECT user_id, run_id, count(*) AS t, count(*) FILTER (status = 'read') AS r FROM progress JOIN issues i ON i.id = object_id WHERE kind = 'issue' GROUP BY ALL), cat AS (SELECT run_id, count(*) AS n FROM issues GROUP BY 1)
    SELECT f.user_id, object_id AS run_id, status, COALESCE(n, 0) AS n_catalogue, COALESCE(t, 0) AS n_tracked, COALESCE(r, 0) AS n_read, COALESCE(n, 0) > 0 AND COALESCE(r, 0) = COALESCE(n, 0) AND status <> 'read' AS offer_read
    FROM progress f LEFT JOIN cat ON cat.run_id = object_id LEFT JOIN mine ON mine.run_id = object_id AND mine.user_id = f.user_id WHERE kind = 'run'""",
)
def _run_progress(c: Catalog) -> DataFrame:
    return tracking.run_progress(c)


@query(
    "progress_after_changes",
    """, changes AS (SELECT user_id, kind, object_id + 1 AS object_id, CASE WHEN object_id % 4 = 0 THEN NULL ELSE status END AS status, updated_at AS seen FROM progress WHERE kind IN ('issue', 'volume') AND user_id % 3 = 0),
    every AS (SELECT *, 0 AS rank FROM changes
      UNION ALL SELECT user_id, 'issue', issue_id, 'read', max(seen), 1 FROM changes JOIN volume_issues ON volume_id = object_id WHERE kind = 'volume' AND status = 'read' GROUP BY ALL
      UNION ALL SELECT user_id, kind, object_id, status, updated_at, 2 FROM progress
      UNION ALL SELECT user_id, 'run', run_id, 'planned', max(seen), 3 FROM changes JOIN issues i ON i.id = object_id WHERE kind = 'issue' AND status IS NOT NULL GROUP BY ALL)
    SELECT user_id, kind, object_id, status FROM (SELECT *, row_number() OVER (PARTITION BY user_id, kind, object_id ORDER BY rank) AS n FROM every) WHERE n = 1 AND status IS NOT NULL""",
)
def _progress_after_changes(c: Catalog) -> DataFrame:
    p = c.progress.where("kind in ('issue', 'volume') and user_id % 3 = 0")
    changes = p.select("user_id", "kind", (F.col("object_id") + 1).alias("object_id"), F.when(F.col("object_id") % 4 != 0, F.col("status")).alias("status"), F.col("updated_at").alias("at"))
    return tracking.apply_changes(c, changes).select("user_id", "kind", "object_id", "status")


# Reports -------------------------------------------------------------------------------------------------------


@query("home_counts", " SELECT 'publishers' AS item, count(*) AS n FROM publishers UNION ALL SELECT 'runs', count(*) FROM runs UNION ALL SELECT 'issues', count(*) FROM issues UNION ALL SELECT 'volumes', count(*) FROM volumes UNION ALL SELECT 'one_shots', count(*) FROM one_shots")
def _home_counts(c: Catalog) -> DataFrame:
    return reports.home_counts(c)


@query("coverage", """, f AS (SELECT 'start_year' AS field, count(*) FILTER (start_year <> '') AS present, count(*) AS total FROM runs UNION ALL SELECT 'first_issue_date', count(first_issue_date), count(*) FROM runs UNION ALL SELECT 'last_issue_date', count(last_issue_date), count(*) FROM runs)
    SELECT field, present, total, round_even(present * 100.0 / total, 1) AS share FROM f""")
def _coverage(c: Catalog) -> DataFrame:
    return reports.coverage(c.runs, ["start_year", "first_issue_date", "last_issue_date"])


@query("dense_days", "SELECT CAST(d AS DATE) AS day, count(event_id) AS n FROM generate_series(DATE '2023-12-25', DATE '2024-02-10', INTERVAL 1 DAY) g(d) LEFT JOIN events ON CAST(ts AS DATE) = CAST(d AS DATE) GROUP BY 1", catalog=False)
def _dense_days(spark: SparkSession, sf: str) -> DataFrame:
    return reports.dense_days(table(spark, sf, "events").select(F.to_date("ts").alias("day")), "day", "2023-12-25", "2024-02-10")


@query("missing_numbers", """, have AS (SELECT run_id, list(DISTINCT CAST(issue_number AS INTEGER)) AS h, max(CAST(issue_number AS INTEGER)) AS top FROM issues WHERE regexp_matches(issue_number, '^\\d+$') GROUP BY 1),
    gone AS (SELECT run_id, list_filter(generate_series(1, top), lambda n: NOT list_contains(h, CAST(n AS INTEGER))) AS m FROM have WHERE top >= 1)
    SELECT run_id, len(m) AS n_missing, CAST(list_sum(m) AS BIGINT) AS missing_sum FROM gone WHERE len(m) > 0""")
def _missing_numbers(c: Catalog) -> DataFrame:
    return reports.missing_counts(c.issues)


@query("budget", " SELECT id, run_id FROM issues ORDER BY run_id, id LIMIT 457")
def _budget(c: Catalog) -> DataFrame:
    return reports.budgeted(c.issues, ["run_id", "id"], 500, used=43).select("id", "run_id")


# Classification ------------------------------------------------------------------------------------------------


def _groups(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    t = table(spark, sf, "conversations")
    n = F.col("conv_id")
    groups = t.select(n).distinct().select(n.alias("group_id"), F.concat(F.lit("Talk & Co. "), n.cast("string")).alias("name"), F.when(n % 9 == 0, "Other").otherwise("Main").alias("publisher"), F.when(n % 8 == 0, "").otherwise("1999").alias("start_year"))
    day = F.expr("DATE '2020-01-01' + cast(turn as int)")
    number = F.when(n % 10 == 1, (F.col("turn") % 2).cast("string")).when((n % 10 == 2) & (F.col("turn") == 0), "").otherwise(F.concat(F.lit("#"), (F.col("turn") * F.when(n % 3 == 0, 2).otherwise(1)).cast("string")))
    title = F.when(n % 10 == 3, F.concat(F.lit("Vol. "), F.col("turn").cast("string"))).otherwise("")
    issues = t.select(n.alias("group_id"), (n * 100 + F.col("turn")).alias("issue_id"), number.alias("issue_number"), title.alias("issue_title"), F.when(n % 4 == 0, day).when((n % 4 == 1) & (F.col("turn") % 2 == 0), day).alias("store_date"), F.when(n % 4 < 3, day).alias("cover_date"))
    return groups, issues


_GROUPS_SQL = """WITH groups AS (SELECT DISTINCT conv_id AS group_id, 'Talk & Co. ' || CAST(conv_id AS VARCHAR) AS name, CASE WHEN conv_id % 9 = 0 THEN 'Other' ELSE 'Main' END AS publisher, CASE WHEN conv_id % 8 = 0 THEN '' ELSE '1999' END AS start_year FROM conversations),
issues AS (SELECT conv_id AS group_id, conv_id * 100 + turn AS issue_id,
  CASE WHEN conv_id % 10 = 1 THEN CAST(turn % 2 AS VARCHAR) WHEN conv_id % 10 = 2 AND turn = 0 THEN '' ELSE '#' || CAST(turn * CASE WHEN conv_id % 3 = 0 THEN 2 ELSE 1 END AS VARCHAR) END AS issue_number,
  CASE WHEN conv_id % 10 = 3 THEN 'Vol. ' || CAST(turn AS VARCHAR) ELSE '' END AS issue_title,
  CASE WHEN conv_id % 4 = 0 OR (conv_id % 4 = 1 AND turn % 2 = 0) THEN DATE '2020-01-01' + CAST(turn AS INTEGER) END AS store_date,
  CASE WHEN conv_id % 4 < 3 THEN DATE '2020-01-01' + CAST(turn AS INTEGER) END AS cover_date FROM conversations),
parsed AS (SELECT *, ltrim(issue_number, '#') AS num, TRY_CAST(ltrim(issue_number, '#') AS BIGINT) AS n FROM issues),
dups AS (SELECT group_id, list_sort(list(num)) AS d FROM (SELECT group_id, num FROM parsed WHERE num <> '' GROUP BY ALL HAVING count(*) > 1) GROUP BY 1),
islands AS (SELECT group_id, n - row_number() OVER (PARTITION BY group_id ORDER BY n) AS island FROM (SELECT DISTINCT group_id, n FROM parsed WHERE n IS NOT NULL)),
streaks AS (SELECT group_id, max(c) AS s FROM (SELECT group_id, island, count(*) AS c FROM islands GROUP BY ALL) GROUP BY 1),
facts AS (SELECT group_id, count(*) AS n_issues, count(*) FILTER (num = '') AS missing_numbers, count(*) FILTER (issue_title LIKE 'Vol.%') AS marked_titles,
  CASE WHEN count(COALESCE(store_date, cover_date)) = 0 THEN 'unknown' WHEN count(store_date) = count(COALESCE(store_date, cover_date)) THEN 'store_date' WHEN count(store_date) = 0 THEN 'cover_date' ELSE 'best_available' END AS source_date_type,
  min(COALESCE(store_date, cover_date)) AS first_issue_date, max(COALESCE(store_date, cover_date)) AS last_issue_date,
  COALESCE(first(num ORDER BY n IS NULL, n, num) FILTER (num <> ''), '') AS first_issue_number, COALESCE(last(num ORDER BY n IS NULL, n, num) FILTER (num <> ''), '') AS last_issue_number,
  string_agg(CAST(issue_id AS VARCHAR) || chr(10) || issue_number || chr(10) || issue_title || chr(10) || COALESCE(CAST(store_date AS VARCHAR), '') || chr(10) || COALESCE(CAST(cover_date AS VARCHAR), ''), chr(10) ORDER BY issue_id, issue_number) AS lines FROM parsed GROUP BY 1)"""


@query("group_facts", _GROUPS_SQL + """ SELECT g.group_id, trim(regexp_replace(lower(name), '[^a-z0-9]+', ' ', 'g')) AS title_key, n_issues, missing_numbers, marked_titles, COALESCE(s, 0) AS longest_streak, source_date_type, first_issue_date, last_issue_date, first_issue_number, last_issue_number, COALESCE(array_to_string(d, ','), '') AS duplicates,
    sha256(CAST(g.group_id AS VARCHAR) || chr(10) || name || chr(10) || publisher || chr(10) || start_year || chr(10) || lines) AS fingerprint FROM groups g JOIN facts USING (group_id) LEFT JOIN dups USING (group_id) LEFT JOIN streaks USING (group_id)""", catalog=False)
def _group_facts(spark: SparkSession, sf: str) -> DataFrame:
    facts = classify.group_facts(*_groups(spark, sf))
    return facts.select("group_id", "title_key", "n_issues", "missing_numbers", "marked_titles", "longest_streak", "source_date_type", "first_issue_date", "last_issue_date", "first_issue_number", "last_issue_number", F.array_join("duplicate_numbers", ",").alias("duplicates"), "fingerprint")


@query("classified_groups", _GROUPS_SQL + """ SELECT analysis_status, count(*) AS n FROM (SELECT CASE WHEN publisher <> 'Main' THEN 'insufficient_data' WHEN start_year = '' THEN 'insufficient_data' WHEN marked_titles > 0 THEN 'unresolved' WHEN missing_numbers > 0 THEN 'insufficient_data' WHEN d IS NOT NULL THEN 'conflict' WHEN n_issues < 2 THEN 'unresolved' ELSE 'confirmed_run' END AS analysis_status
    FROM groups g JOIN facts USING (group_id) LEFT JOIN dups USING (group_id)) GROUP BY 1""", catalog=False)
def _classified_groups(spark: SparkSession, sf: str) -> DataFrame:
    return reports.histogram(classify.classified(classify.group_facts(*_groups(spark, sf)), "main"), "analysis_status")


@query("run_dates", """, seen AS (SELECT run_id, min(published_date) AS a, max(published_date) AS b, count(*) AS n FROM issues GROUP BY 1)
    SELECT r.id, a AS first_date, b AS last_date, n AS issue_count, CASE WHEN b IS NULL THEN status WHEN b < DATE '2001-05-31' - INTERVAL 3 MONTH THEN 'completed' WHEN status = 'completed' THEN 'ongoing' ELSE status END AS new_status FROM runs r LEFT JOIN seen ON run_id = r.id""")
def _run_dates(c: Catalog) -> DataFrame:
    return classify.run_dates(c.runs, c.issues, F.lit("2001-05-31").cast("date")).select("id", "first_date", "last_date", "issue_count", "new_status")


@query("stale_runs", """, one AS (SELECT run_id AS id, max(published_date) AS d, max(id) AS issue_id FROM issues WHERE run_id % 5 = 0 AND issue_number <> '' AND published_date < DATE '1996-06-01' GROUP BY 1 HAVING count(*) = 1)
    SELECT r.id AS run_id, issue_id, title, d AS published_date FROM runs r JOIN one USING (id) WHERE COALESCE(d, last_issue_date) < DATE '1996-05-31' - INTERVAL 3 MONTH""")
def _stale_runs(c: Catalog) -> DataFrame:
    few = c.issues.where("run_id % 5 = 0 and issue_number <> '' and published_date < DATE '1996-06-01'")
    return classify.stale_single_issue_runs(c.runs, few, F.lit("1996-05-31").cast("date")).select("run_id", "issue_id", "title", "published_date")


@query("longest_streak", "SELECT l_partkey AS part, max(c) AS longest_streak FROM (SELECT l_partkey, island, count(*) AS c FROM (SELECT l_partkey, d - row_number() OVER (PARTITION BY l_partkey ORDER BY d) AS island FROM (SELECT DISTINCT l_partkey, l_orderkey // 100 AS d FROM lineitem)) GROUP BY ALL) GROUP BY 1", catalog=False)
def _longest_streak(spark: SparkSession, sf: str) -> DataFrame:
    return classify.longest_streak(table(spark, sf, "lineitem").select(F.col("l_partkey").alias("part"), F.expr("l_orderkey div 100").alias("d")), "part", "d")


# Merging -------------------------------------------------------------------------------------------------------


@query("sync_plan", "WITH old AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity < 40), new AS (SELECT DISTINCT l_orderkey, l_partkey FROM lineitem WHERE l_quantity > 10) SELECT COALESCE(o.l_orderkey, n.l_orderkey) AS issue_id, COALESCE(o.l_partkey, n.l_partkey) AS volume_id, CASE WHEN n.l_partkey IS NULL THEN 'delete' WHEN o.l_partkey IS NULL THEN 'create' ELSE 'keep' END AS action FROM old o FULL JOIN new n ON o.l_orderkey = n.l_orderkey AND o.l_partkey = n.l_partkey", catalog=False)
def _sync_plan(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("issue_id"), F.col("l_partkey").alias("volume_id"), "l_quantity")
    return merge.sync_plan(t.where("l_quantity < 40"), t.where("l_quantity > 10"), ["issue_id", "volume_id"])


@query("sync_stated", "WITH old AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity < 40), new AS (SELECT DISTINCT l_orderkey AS o, l_partkey AS p FROM lineitem WHERE l_quantity > 10 AND l_orderkey % 2 = 0) SELECT CASE WHEN new.p IS NULL AND COALESCE(old.o, new.o) % 2 = 1 THEN 'keep' WHEN new.p IS NULL THEN 'delete' WHEN old.p IS NULL THEN 'create' ELSE 'keep' END AS action, count(*) AS n FROM old FULL JOIN new ON old.o = new.o AND old.p = new.p GROUP BY 1", catalog=False)
def _sync_stated(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "lineitem").select(F.col("l_orderkey").alias("issue_id"), F.col("l_partkey").alias("volume_id"), "l_quantity")
    even = t.where("issue_id % 2 = 0")
    return reports.histogram(merge.sync_plan(t.where("l_quantity < 40"), even.where("l_quantity > 10"), ["issue_id", "volume_id"], ["issue_id"], even.select("issue_id")), "action")


def _upsert_sql(overwrite: bool) -> str:
    take = "s.year IS NOT NULL AND s.year <> '' AND (COALESCE(t.year, '') = ''" + (" OR t.year <> s.year" if overwrite else "") + ")"
    return f""", t AS (SELECT id, start_year AS year FROM runs WHERE id % 3 < 2), s AS (SELECT id, CASE WHEN id % 5 = 0 THEN '' ELSE CAST(2000 + id % 3 AS VARCHAR) END AS year FROM runs WHERE id % 2 = 0)
    SELECT COALESCE(t.id, s.id) AS id, CASE WHEN {take} THEN s.year ELSE t.year END AS year, CASE WHEN t.id IS NULL THEN 'created' WHEN s.id IS NULL THEN 'kept' WHEN {take} THEN 'updated' ELSE 'unchanged' END AS outcome FROM t FULL JOIN s ON t.id = s.id"""


def _upsert(c: Catalog, overwrite: bool) -> DataFrame:
    target = c.runs.where("id % 3 < 2").select("id", F.col("start_year").alias("year"))
    source = c.runs.where("id % 2 = 0").select("id", F.when(F.col("id") % 5 == 0, "").otherwise((2000 + F.col("id") % 3).cast("string")).alias("year"))
    return merge.upsert(target, source, "id", ["year"], overwrite).select("id", "year", "outcome")


@query("fill_blank_upsert", _upsert_sql(False))
def _fill_blank(c: Catalog) -> DataFrame:
    return _upsert(c, False)


@query("overwrite_upsert", _upsert_sql(True))
def _overwrite(c: Catalog) -> DataFrame:
    return _upsert(c, True)


@query("resolved_runs", """, cat AS (SELECT id, publisher_id, title, start_year, CASE WHEN id % 4 = 0 THEN 'key-' || CAST(id AS VARCHAR) ELSE '' END AS source_key FROM runs),
    wanted AS (SELECT id AS ref, CASE WHEN id % 8 = 0 THEN 'key-' || CAST(id AS VARCHAR) ELSE '' END AS key, CASE WHEN id % 2 = 0 THEN upper(title) ELSE replace(title, '#', ' - ') END AS title, start_year AS year, publisher_id FROM runs WHERE id % 3 = 0),
    hits AS (SELECT ref, 1 AS tier, id FROM wanted JOIN cat ON key = source_key AND wanted.publisher_id = cat.publisher_id WHERE key <> ''
      UNION ALL SELECT ref, 2, id FROM wanted JOIN cat ON lower(wanted.title) = lower(cat.title) AND (year = '' OR year = start_year) AND wanted.publisher_id = cat.publisher_id
      UNION ALL SELECT ref, 3, id FROM wanted JOIN cat ON trim(regexp_replace(lower(wanted.title), '[^a-z0-9]+', ' ', 'g')) = trim(regexp_replace(lower(cat.title), '[^a-z0-9]+', ' ', 'g')) AND (year = '' OR year = start_year) AND wanted.publisher_id = cat.publisher_id)
    SELECT w.ref, CAST(min(tier) AS INTEGER) AS tier, first(id ORDER BY tier, id) AS run_id FROM wanted w LEFT JOIN hits USING (ref) GROUP BY 1""")
def _resolved_runs(c: Catalog) -> DataFrame:
    n = F.col("id")
    catalogue = c.runs.withColumn("source_key", F.when(n % 4 == 0, F.concat(F.lit("key-"), n.cast("string"))).otherwise(""))
    wanted = c.runs.where(n % 3 == 0).select(n.alias("ref"), F.when(n % 8 == 0, F.concat(F.lit("key-"), n.cast("string"))).otherwise("").alias("key"), F.when(n % 2 == 0, F.upper("title")).otherwise(F.replace("title", F.lit("#"), F.lit(" - "))).alias("title"), F.col("start_year").alias("year"), "publisher_id")
    return merge.resolved_runs(catalogue, wanted).select("ref", "tier", "run_id")


@query("resolved_issues", """, n AS (SELECT id, run_id, issue_number, regexp_replace(regexp_replace(lower(trim(issue_number)), '^\\s*(issue|no\\.?)\\s*', ''), '[^a-z0-9]+', '', 'g') AS k FROM issues),
    wanted AS (SELECT id AS ref, run_id, 'No. ' || issue_number AS number FROM issues WHERE id % 4 = 1),
    asked AS (SELECT *, regexp_replace(regexp_replace(lower(number), '^\\s*(issue|no\\.?)\\s*', ''), '[^a-z0-9]+', '', 'g') AS k FROM wanted)
    SELECT ref, min(n.id) AS issue_id FROM asked a LEFT JOIN n ON n.run_id = a.run_id AND n.k = a.k AND a.k <> '' GROUP BY 1""")
def _resolved_issues(c: Catalog) -> DataFrame:
    wanted = c.issues.where("id % 4 = 1").select(F.col("id").alias("ref"), "run_id", F.concat(F.lit("No. "), "issue_number").alias("number"))
    return merge.resolved_issues(c.issues, wanted).select("ref", "issue_id")


# Scalar functions ----------------------------------------------------------------------------------------------


@query("title_keys", "SELECT p_partkey AS id, trim(regexp_replace(replace(lower(p_name || ' & ' || p_brand), '&', ' and '), '[^a-z0-9]+', ' ', 'g')) AS title_key, regexp_replace(lower(p_brand), '[^a-z0-9]+', '', 'g') AS identifier FROM part", catalog=False)
def _title_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "part")
    return t.select(F.col("p_partkey").alias("id"), x.title_key(F.concat("p_name", F.lit(" & "), "p_brand")).alias("title_key"), x.identifier(F.col("p_brand")).alias("identifier"))


@query("issue_numbers", """ SELECT id, regexp_replace(ltrim(issue_number, '#'), '\\s+', '', 'g') AS bare, TRY_CAST(NULLIF(regexp_extract(issue_number, '(?i)^#?\\s*(\\d+)(?:[a-z]|\\.[a-z0-9]+)?$', 1), '') AS BIGINT) AS standard,
    regexp_replace(lower(issue_number), '[^a-z0-9]+', '', 'g') AS alnum, contains(' ' || lower(issue_number) || ' ', ' annual ') AS special FROM issues""")
def _issue_numbers(c: Catalog) -> DataFrame:
    n = F.col("issue_number")
    return c.issues.select("id", x.bare_number(n).alias("bare"), x.standard_number(n).alias("standard"), x.alnum_number(n).alias("alnum"), x.looks_special(n).alias("special"))


@query("compacted_ranges", """, n AS (SELECT DISTINCT run_id, CAST(issue_number AS BIGINT) AS v FROM issues WHERE regexp_matches(issue_number, '^\\d+$')),
    isl AS (SELECT run_id, v, v - row_number() OVER (PARTITION BY run_id ORDER BY v) AS g FROM n), r AS (SELECT run_id, min(v) AS a, max(v) AS b FROM isl GROUP BY run_id, g)
    SELECT run_id, string_agg(CASE WHEN a = b THEN CAST(a AS VARCHAR) ELSE CAST(a AS VARCHAR) || '-' || CAST(b AS VARCHAR) END, ',' ORDER BY a) AS ranges FROM r GROUP BY 1""")
def _compacted(c: Catalog) -> DataFrame:
    lists = c.issues.where(F.col("issue_number").rlike(r"^\d+$")).groupBy("run_id").agg(F.collect_set("issue_number").alias("n"))
    return lists.select("run_id", x.compacted(F.col("n")).alias("ranges"))


@query("expanded_ranges", "SELECT o_orderkey AS id, CASE WHEN o_custkey % 50 <= o_orderkey % 70 THEN len(generate_series(o_custkey % 50, o_orderkey % 70)) ELSE 1 END AS n FROM orders", catalog=False)
def _expanded(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "orders")
    span = F.concat((F.col("o_custkey") % 50).cast("string"), F.lit("-"), (F.col("o_orderkey") % 70).cast("string"))
    return t.select(F.col("o_orderkey").alias("id"), F.size(x.expanded_range(span)).cast("long").alias("n"))


@query("display_dates", "SELECT o_orderkey AS id, CAST(o_orderdate AS DATE) AS day FROM orders", catalog=False)
def _display_dates(spark: SparkSession, sf: str) -> DataFrame:
    t, d, k = table(spark, sf, "orders"), F.col("o_orderdate"), F.col("o_orderkey") % 4
    text = F.when(k == 0, F.date_format(d, "MMMM d, yyyy")).when(k == 1, F.concat(F.lit("Monday, "), F.date_format(d, "MMMM d"), F.lit("th, "), F.date_format(d, "yyyy"))).when(k == 2, F.date_format(d, "MM/dd/yyyy")).otherwise(F.date_format(d, "yyyy-MM-dd"))
    return t.select(F.col("o_orderkey").alias("id"), x.display_date(text).alias("day"))


@query("wednesdays", "SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-06-30', INTERVAL 1 DAY) g(d) WHERE dayofweek(d) = 3", catalog=False)
def _wednesdays(spark: SparkSession, sf: str) -> DataFrame:
    return spark.range(1).select(F.explode(x.wednesdays(F.lit("2024-01-01").cast("date"), F.lit("2024-06-30").cast("date"))).alias("day"))


@query("url_keys", "SELECT page_id, lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://(www\\.)?', ''), '/+$', '')) AS key, regexp_extract(regexp_replace(url, '[?#].*$', ''), '^[a-z]+://[^/]*(.*)$', 1) AS path FROM pages", catalog=False)
def _url_keys(spark: SparkSession, sf: str) -> DataFrame:
    t = table(spark, sf, "pages")
    return t.select("page_id", x.url_key(F.col("url")).alias("key"), x.url_path(F.col("url")).alias("path"))


@query("page_titles", "SELECT page_id, trim(regexp_replace(replace(replace(replace(replace(replace(regexp_extract(html, '<title>(.*?)</title>', 1, 's'), '&lt;', '<'), '&gt;', '>'), '&quot;', '\"'), '&#39;', ''''), '&amp;', '&'), '\\s+', ' ', 'g')) AS title FROM pages", catalog=False)
def _page_titles(spark: SparkSession, sf: str) -> DataFrame:
    return records.page_text(table(spark, sf, "pages")).select("page_id", "title")


@query("page_links", "SELECT page_id, len(regexp_extract_all(html, '<a\\s[^>]*href=[\"''][^\"'']*[\"''][^>]*>.*?</a>', 0, 's')) AS n FROM pages WHERE n > 0", catalog=False)
def _page_links(spark: SparkSession, sf: str) -> DataFrame:
    return records.page_links(table(spark, sf, "pages")).groupBy("page_id").agg(F.count(F.lit(1)).alias("n"))


# Scans ---------------------------------------------------------------------------------------------------------


@query("scan_advance", """WITH state AS (SELECT CAST(ts AS DATE) AS scan_date, (count(*) // 2) AS next_offset, count(*) % 3 = 0 AS completed FROM events GROUP BY 1), pages AS (SELECT CAST(ts AS DATE) AS scan_date, count(*) FILTER (event_type = 'click') AS page_rows, count(*) AS total FROM events GROUP BY 1)
    SELECT scan_date, CASE WHEN completed THEN next_offset ELSE next_offset + page_rows END AS next_offset, completed OR page_rows = 0 OR next_offset + page_rows >= total AS completed FROM state JOIN pages USING (scan_date)""", catalog=False)
def _scan_advance(spark: SparkSession, sf: str) -> DataFrame:
    days = table(spark, sf, "events").groupBy(F.to_date("ts").alias("scan_date")).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("event_type") == "click").alias("clicks"))
    state = days.select(F.lit("new").alias("scan_kind"), "scan_date", F.expr("n div 2").alias("next_offset"), F.lit(None).cast("long").alias("total_results"), (F.col("n") % 3 == 0).alias("completed"))
    pages = days.select(F.lit("new").alias("scan_kind"), "scan_date", F.col("clicks").alias("page_rows"), F.col("n").alias("total"))
    return scans.advance(state, pages).select("scan_date", "next_offset", "completed")


@query("weekly_counts", "SELECT CAST(ts AS DATE) - CAST((dayofweek(ts) + 4) % 7 AS INTEGER) AS week_start, count(*) AS n FROM events GROUP BY 1", catalog=False)
def _weekly_counts(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "events").select(F.col("ts").cast("timestamp").alias("ts"))
    return scans.weekly_counts(rows, "ts").select(F.to_date("week_start").alias("week_start"), "n")


@query("rate_limit", "SELECT event_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 600 MINUTE PRECEDING AND CURRENT ROW) > 3 AS blocked FROM events", catalog=False)
def _rate_limit(spark: SparkSession, sf: str) -> DataFrame:
    return scans.rate_limited(table(spark, sf, "events"), "user_id", "ts", 3, 600).select("event_id", "blocked")


# Pages and promotion -------------------------------------------------------------------------------------------


@query("issue_links", "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 4 THEN 'series' ELSE 'issue' END AS kind, CAST(o_orderkey AS VARCHAR) AS link_id, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE 'Red Ring' END AS title, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE CAST(year(o_orderdate) AS VARCHAR) END AS year, CASE WHEN o_orderkey % 5 = 4 THEN '' ELSE CAST(o_custkey AS VARCHAR) || 'A' END AS number FROM orders WHERE o_orderkey % 7 <> 0", catalog=False)
def _issue_links(spark: SparkSession, sf: str) -> DataFrame:
    from longbox.sources import pages

    n = F.col("o_orderkey")
    kind = F.when(n % 7 == 0, "story").when(n % 5 == 4, "series").otherwise("issue")
    href = F.concat(F.lit("https://x.org/comics/"), kind, F.lit("/"), n.cast("string"), F.lit("/red_ring_"), F.year("o_orderdate").cast("string"), F.lit("_"), F.col("o_custkey").cast("string"), F.lit("a?x=1"))
    rows = table(spark, sf, "orders").select(n.alias("id"), pages.link_fields(href).alias("f")).where("f is not null")
    return rows.select("id", "f.kind", F.col("f.id").alias("link_id"), "f.title", "f.year", "f.number")


@query("batches", ", n AS (SELECT id, (row_number() OVER (ORDER BY id) - 1) // 100 AS batch FROM issues) SELECT CAST(batch AS BIGINT) AS batch, count(*) AS n, min(id) AS first_id FROM n GROUP BY 1")
def _batches(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    return sync.batches(c.issues.select("id"), "id").groupBy("batch").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first_id"))


@query("refreshed", " SELECT CASE WHEN id % 3 = 0 AND id % 2 = 0 THEN 'returned' WHEN id % 3 = 0 THEN 'not returned' ELSE 'unexpected' END AS outcome, count(*) AS n FROM runs WHERE id % 3 = 0 OR id % 2 = 0 GROUP BY 1")
def _refreshed(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    return reports.histogram(sync.refreshed(c.runs.where("id % 3 = 0"), c.runs.where("id % 2 = 0")), "outcome")


@query("promoted_issues", """, s AS (SELECT run_id, issue_number, max(published_date + 7) AS date FROM issues WHERE id % 3 = 0 AND issue_number <> '' GROUP BY ALL UNION ALL SELECT id, 'New', DATE '1998-01-01' FROM runs WHERE id % 10 = 0)
    SELECT COALESCE(i.run_id, s.run_id) AS run_id, COALESCE(i.issue_number, s.issue_number) AS issue_number, i.id, COALESCE(published_date, date) AS published_date,
      COALESCE(is_released, false) OR COALESCE(COALESCE(published_date, date) <= DATE '1999-06-01', false) AS is_released, CASE WHEN i.id IS NULL THEN 'created' WHEN date IS NOT NULL AND published_date IS NULL THEN 'updated' ELSE 'unchanged' END AS outcome
    FROM issues i FULL JOIN s ON i.run_id = s.run_id AND i.issue_number = s.issue_number""")
def _promoted_issues(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    known = c.issues.where("id % 3 = 0").select("run_id", "issue_number", F.date_add("published_date", 7).alias("date"))
    new = c.runs.where("id % 10 = 0").select(F.col("id").alias("run_id"), F.lit("New").alias("issue_number"), F.lit("1998-01-01").cast("date").alias("date"))
    return sync.promoted_issues(c.issues, known.unionByName(new), F.lit("1999-06-01").cast("date"))


_STALE = ", stale AS (SELECT r.id AS run_id, i.id AS issue_id, title, i.published_date FROM runs r JOIN (SELECT run_id, max(id) AS id, max(published_date) AS published_date FROM issues WHERE run_id % 4 = 0 AND published_date < DATE '1996-01-01' GROUP BY 1 HAVING count(*) = 1) i ON i.run_id = r.id)"


def _stale(c: Catalog) -> DataFrame:
    few = c.issues.where("run_id % 4 = 0 and published_date < DATE '1996-01-01'")
    return classify.stale_single_issue_runs(c.runs, few, F.lit("2001-01-01").cast("date"))


@query("converted_links", _STALE + """, l AS (SELECT volume_id, run_id, issue_order AS o FROM volume_issues JOIN stale USING (issue_id) UNION ALL SELECT volume_id, run_id, item_order FROM volume_runs JOIN stale USING (run_id) UNION ALL SELECT v.id, v.run_id, 1 FROM volumes v JOIN stale USING (run_id))
    SELECT volume_id, 'run:' || CAST(run_id AS VARCHAR) AS source_key, min(o) AS item_order FROM l GROUP BY ALL""")
def _converted_links(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    return sync.converted(c, _stale(c))["volume_one_shots"]


@query("converted_volumes", _STALE + " SELECT id, CASE WHEN run_id IN (SELECT run_id FROM stale) THEN NULL ELSE run_id END AS run_id, title FROM volumes")
def _converted_volumes(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    return sync.converted(c, _stale(c))["volumes"].select("id", "run_id", "title")


# Whole jobs: ``stale_runs``, ``converted_links`` and ``converted_volumes`` judge chosen runs only, these judge all.  A run
# of the stand-in holds a customer's orders of one year, which leaves many runs with one issue.
_YEARLY_STALE = """, yi AS (SELECT id, run_id * 100 + COALESCE(year(published_date) - 1990, 0) AS run_id, published_date FROM issues),
    yr AS (SELECT k.id, title, first_issue_date, last_issue_date FROM (SELECT DISTINCT run_id AS id FROM yi) k JOIN runs r ON r.id = k.id // 100),
    yv AS (SELECT id, run_id * 100 + 2 + id % 7 AS run_id, title FROM volumes),
    one AS (SELECT run_id, max(id) AS issue_id, max(published_date) AS d FROM yi GROUP BY 1 HAVING count(*) = 1),
    stale AS (SELECT run_id, issue_id, title, COALESCE(d, first_issue_date) AS published_date FROM yr JOIN one ON run_id = id WHERE COALESCE(d, last_issue_date) < DATE '1996-05-31' - INTERVAL 3 MONTH)"""


def _yearly(c: Catalog) -> Catalog:
    year = F.coalesce(F.year("published_date") - 1990, F.lit(0))
    issues = c.issues.withColumn("run_id", F.col("run_id") * 100 + year)
    ids = issues.select("run_id").distinct().select(F.col("run_id").alias("_id"), F.expr("run_id div 100").alias("id"))
    runs = ids.join(c.runs, "id").drop("id").withColumnRenamed("_id", "id")
    volumes = c.volumes.withColumn("run_id", F.col("run_id") * 100 + 2 + F.col("id") % 7)
    volume_runs = c.volume_runs.withColumn("run_id", F.col("run_id") * 100 + 2 + F.col("volume_id") % 7)
    return replace(c, runs=runs, issues=issues, volumes=volumes, volume_runs=volume_runs)


def _yearly_stale(c: Catalog) -> DataFrame:
    return classify.stale_single_issue_runs(c.runs, c.issues, F.lit("1996-05-31").cast("date"))


@query("all_stale_runs", _YEARLY_STALE + " SELECT run_id, issue_id, title, published_date FROM stale")
def _all_stale_runs(c: Catalog) -> DataFrame:
    return _yearly_stale(_yearly(c)).select("run_id", "issue_id", "title", "published_date")


@query("all_converted_links", _YEARLY_STALE + """, l AS (SELECT volume_id, run_id, issue_order AS o FROM volume_issues JOIN stale USING (issue_id) UNION ALL SELECT volume_id, s.run_id, item_order FROM volume_runs v JOIN stale s ON s.run_id = v.run_id * 100 + 2 + volume_id % 7 UNION ALL SELECT v.id, v.run_id, 1 FROM yv v JOIN stale USING (run_id))
    SELECT volume_id, 'run:' || CAST(run_id AS VARCHAR) AS source_key, min(o) AS item_order FROM l GROUP BY ALL""")
def _all_converted_links(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    c = _yearly(c)
    return sync.converted(c, _yearly_stale(c))["volume_one_shots"]


@query("all_converted_volumes", _YEARLY_STALE + " SELECT id, CASE WHEN run_id IN (SELECT run_id FROM stale) THEN NULL ELSE run_id END AS run_id, title FROM yv")
def _all_converted_volumes(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    c = _yearly(c)
    return sync.converted(c, _yearly_stale(c))["volumes"].select("id", "run_id", "title")


@query("new_era_runs", " SELECT id AS run_id FROM runs WHERE status = 'ongoing' AND id NOT IN (SELECT run_id FROM era_runs)")
def _new_era_runs(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    return sync.new_era_runs(c)


@query("orphans", " SELECT count(*) AS n FROM volume_issues WHERE issue_id NOT IN (SELECT id FROM issues WHERE id % 7 <> 0)")
def _orphans(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    return sync.orphans(c.volume_issues, "issue_id", c.issues.where("id % 7 <> 0")).agg(F.count(F.lit(1)).alias("n"))


@query("keyword_search", _RUN_ROWS + " SELECT id, title, publisher FROM run_rows WHERE contains(lower(title), 'customer') AND (contains(lower(title), '9') OR contains(start_year, '9') OR contains(lower(publisher), '9')) AND status = 'ongoing'")
def _keyword_search(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    return sync.search(listing.run_rows(c), "customer 9", ["title", "start_year", "publisher"], status="ongoing").select("id", "title", "publisher")


@query("hydration_due", " SELECT id FROM runs WHERE first_issue_date IS NULL OR last_issue_date > first_issue_date + 1500")
def _hydration_due(c: Catalog) -> DataFrame:
    from longbox.operators import sync

    rows = c.runs.withColumn("refreshed", F.date_add("first_issue_date", 1500))
    return sync.hydration_due(rows, "refreshed", "last_issue_date").select("id")


@query("page_roles", """WITH r AS (SELECT DISTINCT l_orderkey AS ref, l_suppkey AS p, CASE l_returnflag WHEN 'A' THEN 'Writer' WHEN 'N' THEN 'Penciller' ELSE 'Editor' END AS role FROM lineitem WHERE l_orderkey % 20 = 0)
    SELECT ref, role, 'Person ' || CAST(p AS VARCHAR) AS name FROM r""", catalog=False)
def _page_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _roles_of(table(spark, sf, "lineitem").where("l_orderkey % 20 = 0"))


@query("all_page_roles", """SELECT DISTINCT l_orderkey AS ref, CASE l_returnflag WHEN 'A' THEN 'Writer' WHEN 'N' THEN 'Penciller' ELSE 'Editor' END AS role, 'Person ' || CAST(l_suppkey AS VARCHAR) AS name FROM lineitem""", catalog=False)
def _all_page_roles(spark: SparkSession, sf: str) -> DataFrame:
    return _roles_of(table(spark, sf, "lineitem"))


def _roles_of(t: DataFrame) -> DataFrame:
    from longbox.sources import pages

    label = F.when(F.col("l_returnflag") == "A", "Written by").when(F.col("l_returnflag") == "N", "Pencilers").otherwise("Editor")
    line = F.concat(label, F.lit(": Person "), F.col("l_suppkey").cast("string"), F.lit(" & person "), F.col("l_suppkey").cast("string"))
    texts = t.groupBy(F.col("l_orderkey").alias("page")).agg(F.array_join(F.array_sort(F.collect_list(line)), "\n").alias("text"))
    return pages.credits_of(pages.labelled_lines(texts, "page", "text")).select("ref", "role", "name")
