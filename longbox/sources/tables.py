"""Catalogue tables as DataFrames, and their stand-ins on the generated star tables."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.session import dealt


@dataclass(frozen=True)
class Catalog:
    """Tables that the operators take.  Any source will do that has these columns.

    publishers(id, name, slug) · runs(id, publisher_id, title, start_year, first_issue_date, last_issue_date, status)
    era_runs(run_id) · issues(id, run_id, issue_number, published_date, is_released)
    volumes(id, publisher_id, run_id, title, volume_number, release_date) · one_shots(id, publisher_id, title,
    start_year, published_date) · volume_issues(volume_id, issue_id, issue_order) · volume_runs(volume_id, run_id,
    item_order) · volume_one_shots(volume_id, one_shot_id, item_order) · people(id, name) · roles(id, name,
    display_order, show_by_default) · credits(target_kind, target_id, person_id, role_id, credit_order)
    progress(user_id, kind, object_id, status, updated_at)
    """

    publishers: DataFrame
    runs: DataFrame
    era_runs: DataFrame
    issues: DataFrame
    volumes: DataFrame
    one_shots: DataFrame
    volume_issues: DataFrame
    volume_runs: DataFrame
    volume_one_shots: DataFrame
    people: DataFrame
    roles: DataFrame
    credits: DataFrame
    progress: DataFrame


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    path = f"{sf_dir}/{name}.parquet"
    return dealt(spark.read.parquet(path), path)


#: The stand-ins as SQL, one view after another.  Both engines take them, so that a query and its check start alike.
STAND_INS = {
    "publishers": "SELECT CAST(n_nationkey AS BIGINT) AS id, n_name AS name, lower(n_name) AS slug FROM nation",
    "runs": """
        SELECT c_custkey AS id, CAST(c_nationkey AS BIGINT) AS publisher_id, c_name AS title,
               CASE WHEN c_custkey % 17 = 0 THEN '' ELSE CAST(1990 + c_custkey % 12 AS VARCHAR(4)) END AS start_year,
               CASE WHEN c_custkey % 10 = 3 THEN NULL ELSE CAST(DATE '1995-01-01' + CAST(c_custkey % 700 AS INTEGER) AS DATE) END AS first_issue_date,
               CASE WHEN c_custkey % 10 = 4 THEN NULL ELSE CAST(DATE '1999-01-01' + CAST(c_custkey % 900 AS INTEGER) AS DATE) END AS last_issue_date,
               CASE c_custkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'upcoming' WHEN 2 THEN 'ongoing' ELSE 'completed' END AS status
        FROM customer""",
    "era_runs": "SELECT c_custkey AS run_id FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY')",
    "issues": """
        SELECT o_orderkey AS id, o_custkey AS run_id,
               CASE WHEN o_orderkey % 11 = 0 THEN 'Annual ' || CAST(o_orderkey % 3 AS VARCHAR(9))
                    WHEN o_orderkey % 13 = 0 THEN '#' || CAST(o_orderkey % 40 AS VARCHAR(9)) || '.5'
                    WHEN o_orderkey % 29 = 0 THEN '' ELSE CAST(o_orderkey % 40 AS VARCHAR(9)) END AS issue_number,
               CASE WHEN o_orderkey % 23 = 0 THEN NULL ELSE CAST(o_orderdate AS DATE) END AS published_date,
               o_orderstatus <> 'P' AS is_released
        FROM orders""",
    "volumes": """
        SELECT p_partkey AS id, p_partkey % 25 AS publisher_id, CASE WHEN p_partkey % 3 = 0 THEN p_partkey % 100 END AS run_id,
               p_name AS title, CAST(p_size AS VARCHAR(9)) AS volume_number,
               CASE WHEN p_partkey % 5 = 0 THEN NULL ELSE CAST(DATE '1996-01-01' + CAST(p_partkey % 900 AS INTEGER) AS DATE) END AS release_date
        FROM part""",
    "one_shots": """
        SELECT s_suppkey AS id, CAST(s_nationkey AS BIGINT) AS publisher_id, s_name AS title,
               CAST(1990 + s_suppkey % 9 AS VARCHAR(4)) AS start_year,
               CASE WHEN s_suppkey % 6 = 0 THEN NULL ELSE CAST(DATE '1997-01-01' + CAST(s_suppkey % 300 AS INTEGER) AS DATE) END AS published_date
        FROM supplier""",
    "volume_issues": "SELECT l_partkey AS volume_id, l_orderkey AS issue_id, MIN(l_linenumber) AS issue_order FROM lineitem GROUP BY l_partkey, l_orderkey",
    "volume_runs": "SELECT l_partkey AS volume_id, l_suppkey AS run_id, MIN(l_linenumber) AS item_order FROM lineitem WHERE l_linenumber <= 2 AND l_quantity < 10 GROUP BY l_partkey, l_suppkey",
    "volume_one_shots": "SELECT l_partkey AS volume_id, l_suppkey AS one_shot_id, MIN(l_linenumber) AS item_order FROM lineitem WHERE l_quantity > 48 GROUP BY l_partkey, l_suppkey",
    "people": "SELECT s_suppkey AS id, s_name AS name FROM supplier",
    "roles": "SELECT CAST(id AS BIGINT) AS id, name, CAST(display_order AS INTEGER) AS display_order, show_by_default FROM (VALUES (1, 'Writer', 10, true), (2, 'Penciller', 20, true), (3, 'Letterer', 50, false)) AS t(id, name, display_order, show_by_default)",
    "credits": """
        SELECT 'issue' AS target_kind, l_orderkey AS target_id, l_suppkey AS person_id,
               CAST(CASE l_returnflag WHEN 'A' THEN 1 WHEN 'N' THEN 2 ELSE 3 END AS BIGINT) AS role_id,
               CASE WHEN MIN(l_linenumber) = 7 THEN NULL ELSE MIN(l_linenumber) END AS credit_order
        FROM lineitem GROUP BY l_orderkey, l_suppkey, l_returnflag
        UNION ALL
        SELECT 'volume', p_partkey, p_partkey % 10, CAST(1 + p_partkey % 3 AS BIGINT), CAST(p_size AS INTEGER) FROM part
        UNION ALL
        SELECT 'one_shot', s_suppkey, s_suppkey % 10, CAST(1 + s_suppkey % 3 AS BIGINT), CAST(NULL AS INTEGER) FROM supplier""",
}


def star_views(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    """The generated star tables by name."""
    names = ("nation", "customer", "orders", "part", "supplier", "lineitem", "events", "conversations", "documents", "pages", "labels", "region")
    return {n: table(spark, sf_dir, n) for n in names}


def _spark_sql(text: str) -> str:
    """The stand-ins' text in this dialect: dates move by whole days."""
    return text.replace("VARCHAR(4)", "STRING").replace("VARCHAR(9)", "STRING")


def star_catalog(spark: SparkSession, sf_dir: str) -> Catalog:
    """The catalogue's tables read from the generated star tables: customers are runs, orders issues, parts volumes."""
    sources = {n: table(spark, sf_dir, n) for n in ("nation", "customer", "orders", "part", "supplier", "lineitem")}
    made = {name: spark.sql(_spark_sql(_with_sources(text, sources)), **{f"t_{n}": d for n, d in sources.items() if f"{{t_{n}}}" in _with_sources(text, sources)}) for name, text in STAND_INS.items()}
    return Catalog(progress=star_progress(table(spark, sf_dir, "events")), **made)


def _with_sources(text: str, sources: dict[str, DataFrame]) -> str:
    import re

    return re.sub(r"\b(FROM) (" + "|".join(sources) + r")\b", lambda m: f"FROM {{t_{m[2]}}}", text)


#: What an event says: the kind of item, and the reader's status for it.
PROGRESS_SQL = """
    SELECT user_id, kind, object_id, status, updated_at FROM (
      SELECT *, row_number() OVER (PARTITION BY user_id, kind, object_id ORDER BY updated_at DESC, event_id DESC) AS n FROM (
        SELECT event_id, user_id, CASE event_type WHEN 'view' THEN 'issue' WHEN 'error' THEN 'issue' WHEN 'click' THEN 'run' WHEN 'purchase' THEN 'volume' ELSE 'one_shot' END AS kind,
               CAST(regexp_extract(props, '[0-9]+', 0) AS BIGINT) AS object_id,
               CASE event_id % 3 WHEN 0 THEN 'planned' WHEN 1 THEN 'reading' ELSE 'read' END AS status, ts AS updated_at
        FROM events) e) latest WHERE n = 1"""


def star_progress(events: DataFrame) -> DataFrame:
    """``progress`` of the event stream: the latest event of a user on an item stands."""
    kind = F.when(F.col("event_type").isin("view", "error"), "issue").when(F.col("event_type") == "click", "run").when(F.col("event_type") == "purchase", "volume").otherwise("one_shot")
    status = F.when(F.col("event_id") % 3 == 0, "planned").when(F.col("event_id") % 3 == 1, "reading").otherwise("read")
    rows = events.select("user_id", kind.alias("kind"), F.get_json_object("props", "$.k").cast("long").alias("object_id"), F.struct("ts", "event_id", status.alias("status")).alias("last"))
    latest = rows.groupBy("user_id", "kind", "object_id").agg(F.max("last").alias("last"))
    return latest.select("user_id", "kind", "object_id", F.col("last.status").alias("status"), F.col("last.ts").alias("updated_at"))
