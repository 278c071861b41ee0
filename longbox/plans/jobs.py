"""Registered queries of batch jobs, scans and per-reader pages, each with SQL that gives the same rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.functions import text as x
from longbox.operators import classify, listing, merge, reports, sequences, sync, tracking
from longbox.plans.queries import _GROUPS_SQL, _REACH, _groups, _page_sql, query
from longbox.sources import records
from longbox.sources.tables import Catalog, table
from longbox.streaming import scans


@query("as_of_purchases", "WITH p AS (SELECT user_id, ts, max(event_id) AS purchase FROM events WHERE event_type = 'purchase' GROUP BY ALL) SELECT e.event_id, purchase FROM events e ASOF LEFT JOIN p ON e.user_id = p.user_id AND e.ts >= p.ts WHERE event_type = 'click'", catalog=False)
def _as_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    clicks = e.where("event_type = 'click'").select("event_id", "user_id", "ts")
    bought = e.where("event_type = 'purchase'").select("user_id", "ts", F.col("event_id").alias("purchase"))
    return sequences.as_of(clicks, bought, ["user_id"], "ts", ["purchase"]).select("event_id", "purchase")


_SPANS = "SELECT o_custkey AS run_id, o_orderkey % 97 AS a, o_orderkey % 97 + 5 + o_orderkey % 7 AS b, o_orderkey % 2 AS p FROM orders"


@query(
    "without_overlaps",
    f"""WITH RECURSIVE s AS (SELECT *, row_number() OVER (PARTITION BY run_id ORDER BY a, -p, a - b, b) AS n FROM ({_SPANS})),
    k AS (SELECT run_id, a, b, n, true AS kept, b AS reach FROM s WHERE n = 1
      UNION ALL SELECT s.run_id, s.a, s.b, s.n, s.a >= k.reach, CASE WHEN s.a >= k.reach THEN s.b ELSE k.reach END FROM k JOIN s ON s.run_id = k.run_id AND s.n = k.n + 1)
    SELECT run_id, a, b FROM k WHERE kept""",
    catalog=False,
)
def _without_overlaps(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), (n % 97).alias("a"), (n % 97 + 5 + n % 7).alias("b"), (n % 2).alias("p"))
    return sequences.without_overlaps(rows, "run_id", "a", "b", "p")


@query("first_of_kind", "WITH r AS (SELECT o_custkey AS run_id, o_orderkey AS n, CASE WHEN o_orderkey % 3 = 0 THEN o_orderpriority ELSE '' END AS t FROM orders) SELECT run_id, COALESCE(first(t ORDER BY n) FILTER (t <> ''), '') AS t FROM r GROUP BY 1", catalog=False)
def _first_of_kind(spark: SparkSession, sf: str) -> DataFrame:
    rows = table(spark, sf, "orders").select(F.col("o_custkey").alias("run_id"), F.col("o_orderkey").alias("n"), F.when(F.col("o_orderkey") % 3 == 0, F.col("o_orderpriority")).otherwise("").alias("t"))
    return sequences.first_of(rows, ["run_id"], "n", ["t"])


@query("exists_in", " SELECT id, concat_ws(',', CASE WHEN id IN (SELECT id FROM issues) THEN 'issues' END, CASE WHEN id IN (SELECT id FROM one_shots) THEN 'one_shots' END, CASE WHEN id IN (SELECT id FROM volumes) THEN 'volumes' END) AS found_in FROM runs")
def _exists_in(c: Catalog) -> DataFrame:
    found = sequences.exists_in(c.runs.select("id"), "id", issues=c.issues, volumes=c.volumes, one_shots=c.one_shots)
    return found.select("id", F.array_join("found_in", ",").alias("found_in"))


@query("changed_field_counts", ", t AS (SELECT id, start_year AS year, title FROM runs WHERE id % 3 < 2), s AS (SELECT id, '2001' AS year, CASE WHEN id % 5 = 0 THEN title ELSE 'New' END AS title FROM runs WHERE id % 2 = 0) SELECT 'year' AS field, count(*) AS n FROM s LEFT JOIN t USING (id) WHERE t.year IS DISTINCT FROM s.year UNION ALL SELECT 'title', count(*) FROM s LEFT JOIN t USING (id) WHERE t.title IS DISTINCT FROM s.title")
def _changed_field_counts(c: Catalog) -> DataFrame:
    n = F.col("id")
    target = c.runs.where(n % 3 < 2).select("id", F.col("start_year").alias("year"), "title")
    source = c.runs.where(n % 2 == 0).select("id", F.lit("2001").alias("year"), F.when(n % 5 == 0, F.col("title")).otherwise("New").alias("title"))
    return sequences.field_counts(merge.upsert(target, source, "id", ["year", "title"], overwrite=True))


@query("contiguous_days", "WITH d AS (SELECT CAST(d AS DATE) AS day FROM generate_series(DATE '2024-01-01', DATE '2024-02-05', INTERVAL 1 DAY) g(d)), n AS (SELECT day, count(event_id) FILTER (event_type = 'purchase') > 0 OR day > DATE '2024-02-01' AS done FROM d LEFT JOIN events ON CAST(ts AS DATE) = day GROUP BY 1) SELECT day FROM n WHERE day > COALESCE((SELECT max(day) FROM n WHERE NOT done), DATE '1900-01-01')", catalog=False)
def _contiguous_days(spark: SparkSession, sf: str) -> DataFrame:
    bought = table(spark, sf, "events").where("event_type = 'purchase'").select(F.to_date("ts").alias("day"))
    days = reports.dense_days(bought, "day", "2024-01-01", "2024-02-05").withColumn("done", (F.col("n") > 0) | (F.col("day") > F.lit("2024-02-01").cast("date")))
    return reports.contiguous_back(days, "day", "done").select("day")


@query("next_scan_day", "SELECT min(CAST(d AS DATE)) AS scan_date FROM generate_series(DATE '2024-01-01', DATE '2024-02-20', INTERVAL 1 DAY) g(d) WHERE CAST(d AS DATE) NOT IN (SELECT CAST(ts AS DATE) FROM events)", catalog=False)
def _next_scan_day(spark: SparkSession, sf: str) -> DataFrame:
    state = table(spark, sf, "events").select(F.to_date("ts").alias("scan_date"), F.lit(True).alias("completed")).distinct()
    return scans.next_day(state, "2024-01-01", "2024-02-20")


@query("candidate_changes", _GROUPS_SQL + """, fresh AS (SELECT g.group_id, CASE WHEN publisher <> 'Main' OR start_year = '' THEN 'insufficient_data' WHEN marked_titles > 0 THEN 'unresolved' WHEN missing_numbers > 0 THEN 'insufficient_data' WHEN d IS NOT NULL THEN 'conflict' WHEN n_issues < 2 THEN 'unresolved' ELSE 'confirmed_run' END AS s FROM groups g JOIN facts USING (group_id) LEFT JOIN dups USING (group_id))
    SELECT group_id, CASE WHEN group_id % 4 = 1 AND group_id % 5 = 2 THEN 'manual' ELSE s END AS analysis_status,
      CASE WHEN group_id % 4 = 0 THEN 'update_available' WHEN group_id % 4 = 1 AND group_id % 5 = 2 THEN 'not_ready' WHEN s = 'confirmed_run' THEN 'ready_to_apply' ELSE 'not_ready' END AS catalog_status,
      CASE WHEN group_id % 4 IN (2, 3) THEN 'created' ELSE 'updated' END AS outcome FROM fresh""", catalog=False)
def _candidate_changes(spark: SparkSession, sf: str) -> DataFrame:
    fresh = classify.classified(classify.group_facts(*_groups(spark, sf)), "Main")
    n = F.col("group_id")
    manual = (n % 4 == 1) & (n % 5 == 2)
    stored = fresh.where(n % 4 < 2).select("group_id", F.when(manual, "manual").otherwise(F.col("analysis_status")).alias("analysis_status"), F.when(n % 4 == 0, "applied").otherwise("not_ready").alias("catalog_status"), F.lit("old").alias("fingerprint"), manual.alias("manual"))
    return classify.candidate_changes(stored, fresh).select("group_id", "analysis_status", "catalog_status", "outcome")


@query("lineage", ", stored AS (SELECT id AS s, id + CASE WHEN id % 5 = 0 THEN 1 ELSE 0 END AS t FROM runs WHERE id % 2 = 0), now AS (SELECT id AS s, id AS t FROM runs) SELECT CASE WHEN o.t = n.t THEN 'same' WHEN o.t IS NOT NULL THEN 'conflict: source is linked elsewhere' WHEN h.s IS NOT NULL THEN 'conflict: target is taken' ELSE 'new' END AS verdict, count(*) AS n FROM now n LEFT JOIN stored o ON o.s = n.s LEFT JOIN stored h ON h.t = n.t GROUP BY 1")
def _lineage(c: Catalog) -> DataFrame:
    n = F.col("id")
    stored = c.runs.where(n % 2 == 0).select(n.alias("source_id"), (n + F.when(n % 5 == 0, 1).otherwise(0)).alias("catalogue_id"))
    now = c.runs.select(n.alias("source_id"), n.alias("catalogue_id"))
    return reports.histogram(merge.lineage_matches(stored, now), "verdict")


@query("issue_records", "SELECT o_orderkey AS source_id, CAST(o_custkey AS VARCHAR) AS issue_number, CASE WHEN o_orderkey % 3 > 0 THEN CAST(o_orderdate AS DATE) END AS store_date, o_custkey AS volume_id, CASE WHEN o_orderkey % 2 = 0 THEN 'big' ELSE 'small' END AS image FROM orders", catalog=False)
def _issue_records(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    day = F.when(n % 3 > 0, F.date_format("o_orderdate", "yyyy-MM-dd")).otherwise("soon")
    image = F.struct(F.when(n % 2 == 0, "big").otherwise("").alias("original_url"), F.lit("small").alias("thumb_url"))
    json = F.to_json(F.struct(n.alias("id"), F.concat(F.lit(" "), F.col("o_custkey").cast("string")).alias("issue_number"), day.alias("store_date"), F.struct(F.col("o_custkey").alias("id")).alias("volume"), image.alias("image")))
    rows = records.issue_records(table(spark, sf, "orders").select(json.alias("json")))
    return rows.select("source_id", "issue_number", "store_date", "volume_id", F.col("display_image_url").alias("image"))


@query("relations", "SELECT l_orderkey AS issue_id, CASE WHEN l_linenumber % 2 = 0 THEN 'team' ELSE 'character' END AS entity, CASE WHEN l_linenumber % 2 = 0 THEN 'disbanded_in' ELSE 'credit' END AS relation, l_partkey AS entity_id FROM lineitem GROUP BY ALL", catalog=False)
def _relations(spark: SparkSession, sf: str) -> DataFrame:
    item = F.struct(F.col("l_partkey").alias("id"), F.lit("x").alias("name"))
    even = F.col("l_linenumber") % 2 == 0
    rows = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("source_id")).agg(F.collect_list(F.when(even, item)).alias("team_disbanded_in"), F.collect_list(F.when(~even, item)).alias("character_credits"))
    raw = rows.select("source_id", F.to_json(F.struct("team_disbanded_in", "character_credits")).alias("json"))
    return records.relations(raw).select("issue_id", "entity", "relation", "entity_id")


@query("key_presence", """WITH l AS (SELECT DISTINCT unnest(regexp_extract_all(props, '"([^"]*)"\\s*:', 1)) AS key FROM events), r AS (SELECT key FROM l UNION SELECT 'v')
    SELECT COALESCE(l.key, r.key) AS key, CASE WHEN l.key IS NULL THEN 'right' WHEN r.key IS NULL THEN 'left' ELSE 'shared' END AS "where" FROM l FULL JOIN r ON l.key = r.key""", catalog=False)
def _key_presence(spark: SparkSession, sf: str) -> DataFrame:
    left = table(spark, sf, "events").select(F.col("props").alias("json"))
    right = left.select(F.regexp_replace("json", r"\}$", ', "v": 1}').alias("json"))
    return sequences.key_presence(left, right, "json")


@query("reader_runs", _REACH + """, mine AS (SELECT object_id AS run_id FROM progress WHERE kind = 'run' AND user_id = 3 UNION SELECT i.run_id FROM progress JOIN issues i ON i.id = object_id WHERE kind = 'issue' AND user_id = 3 UNION SELECT reach.run_id FROM progress JOIN reach ON volume_id = object_id WHERE kind = 'volume' AND user_id = 3),
    r AS (SELECT runs.*, p.name AS publisher FROM runs JOIN publishers p ON p.id = publisher_id WHERE runs.id IN (SELECT run_id FROM mine) AND publisher_id < 20)""" + _page_sql("SELECT * FROM r", "start_year DESC NULLS FIRST, first_issue_date DESC NULLS FIRST, publisher NULLS LAST, title NULLS LAST, id", "id, title", 5, 5))
def _reader_runs(c: Catalog) -> DataFrame:
    mine = tracking.tracked_runs(c).where("user_id = 3").select(F.col("run_id").alias("id"))
    rows = listing.run_rows(c).where("publisher_id < 20").join(mine, "id", "left_semi").withColumn("search_rank", F.lit(0))
    return listing.page(rows, listing.RUN_ORDER, 5, 5).select("id", "title", "position", "has_more")


@query("recent_runs", " SELECT object_id AS id, max(updated_at) AS seen FROM progress WHERE kind = 'run' GROUP BY 1 ORDER BY seen DESC, id LIMIT 5")
def _recent_runs(c: Catalog) -> DataFrame:
    rows = c.progress.where("kind = 'run'").groupBy(F.col("object_id").alias("id")).agg(F.max("updated_at").alias("seen"))
    return rows.orderBy(F.desc("seen"), "id").limit(5)


@query("collapsed_lists", "WITH r AS (SELECT l_suppkey AS k, l_orderkey * 10 + l_linenumber AS position, l_partkey % 7 AS v FROM lineitem WHERE l_orderkey % 50 = 0), f AS (SELECT k, v, min(position) AS p FROM r GROUP BY ALL) SELECT k, array_to_string(list(CAST(v AS VARCHAR) ORDER BY p, v), ',') AS v FROM f GROUP BY 1", catalog=False)
def _collapsed_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _lists_of(table(spark, sf, "lineitem").where("l_orderkey % 50 = 0"))


@query("all_collapsed_lists", "WITH f AS (SELECT l_suppkey AS k, l_partkey % 7 AS v, min(l_orderkey * 10 + l_linenumber) AS p FROM lineitem GROUP BY ALL) SELECT k, array_to_string(list(CAST(v AS VARCHAR) ORDER BY p, v), ',') AS v FROM f GROUP BY 1", catalog=False)
def _all_collapsed_lists(spark: SparkSession, sf: str) -> DataFrame:
    return _lists_of(table(spark, sf, "lineitem"))


def _lists_of(t: DataFrame) -> DataFrame:
    rows = t.select(F.col("l_suppkey").alias("k"), (F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("position"), F.array((F.col("l_partkey") % 7).cast("string")).alias("v"))
    return merge.collapsed_lists(rows, ["k"], "v").select("k", F.array_join("v", ",").alias("v"))


@query("query_urls", "SELECT p_partkey AS id, CASE WHEN p_partkey % 6 = 0 THEN '/browse' ELSE '/browse?' || concat_ws('&', CASE WHEN p_partkey % 2 > 0 THEN 'run=' || CAST(p_partkey AS VARCHAR) END, CASE WHEN p_partkey % 3 > 0 THEN 'q=' || replace(p_name, ' ', '+') END) END AS url FROM part", catalog=False)
def _query_urls(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    return table(spark, sf, "part").select(n.alias("id"), x.query_url("/browse", run=F.when(n % 2 > 0, n), q=F.when(n % 3 > 0, F.col("p_name")).otherwise("")).alias("url"))


@query("natural_order", """, k AS (SELECT run_id, id, regexp_extract(trim(issue_number), '^\\s*#?\\s*(-?\\d+(?:\\.\\d+)?)\\s*(.*)$', 1) AS num, regexp_extract(trim(issue_number), '^\\s*#?\\s*(-?\\d+(?:\\.\\d+)?)\\s*(.*)$', 2) AS rest, issue_number FROM issues)
    SELECT run_id, id, CAST(row_number() OVER (PARTITION BY run_id ORDER BY num = '', TRY_CAST(NULLIF(num, '') AS DOUBLE), lower(trim(rest)), lower(trim(issue_number)), id) AS INTEGER) AS position FROM k""")
def _natural_order(c: Catalog) -> DataFrame:
    from pyspark.sql import Window

    order = Window.partitionBy("run_id").orderBy(x.natural_number_key(F.col("issue_number")), "id")
    return c.issues.select("run_id", "id", F.row_number().over(order).alias("position"))


@query("description_fill", """, i AS (SELECT run_id, first('From issue ' || CAST(id AS VARCHAR) ORDER BY id) AS d FROM issues WHERE ltrim(issue_number, '#') = '1' AND NOT contains(' ' || lower(issue_number) || ' ', ' annual ') GROUP BY 1)
    SELECT r.id, CASE WHEN r.id % 2 = 0 THEN 'own' ELSE COALESCE(d, '') END AS description FROM runs r LEFT JOIN i ON run_id = r.id""")
def _description_fill(c: Catalog) -> DataFrame:
    runs = c.runs.select("id", F.when(F.col("id") % 2 == 0, "own").otherwise("").alias("description"))
    issues = c.issues.withColumn("description", F.concat(F.lit("From issue "), F.col("id").cast("string")))
    return sync.first_issue_descriptions(runs, issues)
