"""Registered queries of readers' listings, pages of items, and records written to what is stored."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.operators import hydration, listing, reading
from longbox.plans.queries import _NAMED, _REACH, _page_sql, query
from longbox.sources.tables import Catalog, table

_USER = 3
_MINE = f", mine AS (SELECT kind, object_id, status, updated_at AS followed_at FROM progress WHERE user_id = {_USER})"
_SHOWN_DATE = "COALESCE(CAST({} AS VARCHAR), 'Unknown')"


@query("reader_run_listing", _MINE + """, n AS (SELECT i.run_id, count(*) AS n_catalogue, count(m.object_id) AS n_tracked FROM issues i LEFT JOIN mine m ON m.kind = 'issue' AND m.object_id = i.id GROUP BY 1),
    r AS (SELECT runs.id, title, p.name AS publisher, mine.status AS reading_status, followed_at, COALESCE(n_catalogue, 0) AS n_catalogue, COALESCE(n_tracked, 0) AS n_tracked FROM mine JOIN runs ON kind = 'run' AND object_id = runs.id JOIN publishers p ON p.id = publisher_id LEFT JOIN n ON n.run_id = runs.id)""" + _page_sql("SELECT * FROM r", "followed_at DESC NULLS FIRST, publisher NULLS LAST, title NULLS LAST, id", "id, reading_status, n_catalogue, n_tracked"))
def _reader_run_listing(c: Catalog) -> DataFrame:
    rows = reading.reader_listings(c, _USER)["runs"]
    return listing.page(rows, reading.READER_ORDER["runs"]).select("id", "reading_status", "n_catalogue", "n_tracked", "position", "has_more")


@query("reader_volume_listing", _MINE + """, r AS (SELECT v.id, v.title, p.name AS publisher, release_date, u.title AS run_title, volume_number, mine.status AS reading_status FROM mine JOIN volumes v ON kind = 'volume' AND object_id = v.id JOIN publishers p ON p.id = v.publisher_id LEFT JOIN runs u ON u.id = v.run_id)""" + _page_sql("SELECT * FROM r", "publisher NULLS LAST, release_date NULLS LAST, run_title NULLS LAST, volume_number NULLS LAST, title NULLS LAST, id", "id, reading_status"))
def _reader_volume_listing(c: Catalog) -> DataFrame:
    rows = reading.reader_listings(c, _USER)["volumes"]
    return listing.page(rows, reading.READER_ORDER["volumes"]).select("id", "reading_status", "position", "has_more")


@query("reader_issue_listing", _MINE + """, r AS (SELECT i.id, p.name AS publisher, u.title AS run_title, published_date, issue_number, mine.status AS reading_status FROM mine JOIN issues i ON kind = 'issue' AND object_id = i.id JOIN runs u ON u.id = i.run_id JOIN publishers p ON p.id = u.publisher_id)""" + _page_sql("SELECT * FROM r", "publisher NULLS LAST, run_title NULLS LAST, published_date NULLS LAST, issue_number NULLS LAST, id", "id, reading_status"))
def _reader_issue_listing(c: Catalog) -> DataFrame:
    rows = reading.reader_listings(c, _USER)["issues"]
    return listing.page(rows, reading.READER_ORDER["issues"]).select("id", "reading_status", "position", "has_more")


@query("reader_one_shot_listing", _MINE + """, r AS (SELECT o.id, o.title, p.name AS publisher, published_date, mine.status AS reading_status FROM mine JOIN one_shots o ON kind = 'one_shot' AND object_id = o.id JOIN publishers p ON p.id = o.publisher_id)""" + _page_sql("SELECT * FROM r", "publisher NULLS LAST, published_date NULLS LAST, title NULLS LAST, id", "id, reading_status"))
def _reader_one_shot_listing(c: Catalog) -> DataFrame:
    rows = reading.reader_listings(c, _USER)["one_shots"]
    return listing.page(rows, reading.READER_ORDER["one_shots"]).select("id", "reading_status", "position", "has_more")


@query("reader_publisher_listing", _MINE + """ SELECT 'runs' AS listing, r.id FROM mine JOIN runs r ON kind = 'run' AND object_id = r.id WHERE publisher_id = 4
    UNION ALL SELECT 'issues', i.id FROM mine JOIN issues i ON kind = 'issue' AND object_id = i.id JOIN runs r ON r.id = run_id WHERE publisher_id = 4
    UNION ALL SELECT 'volumes', v.id FROM mine JOIN volumes v ON kind = 'volume' AND object_id = v.id WHERE publisher_id = 4
    UNION ALL SELECT 'one_shots', o.id FROM mine JOIN one_shots o ON kind = 'one_shot' AND object_id = o.id WHERE publisher_id = 4""")
def _reader_publisher_listing(c: Catalog) -> DataFrame:
    out = None
    for name, rows in reading.reader_listings(c, _USER, publisher_id=4).items():
        rows = rows.select(F.lit(name).alias("listing"), "id")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("reader_volume_options", f"""{_MINE} SELECT v.id, CASE WHEN trim(v.title) <> '' THEN trim(v.title) WHEN u.id IS NULL THEN '' WHEN trim(volume_number) <> '' THEN trim(u.title) || ' Vol. ' || trim(volume_number) ELSE trim(u.title) END AS label,
      p.name || ' · ' || CASE WHEN u.id IS NULL THEN 'No primary run' WHEN u.start_year = '' THEN u.title ELSE u.title || ' (' || u.start_year || ')' END AS meta,
      v.title || ' ' || COALESCE(u.title, '') || ' ' || volume_number || ' ' || p.name AS search_label, v.id = 40 AS active
    FROM volumes v JOIN publishers p ON p.id = v.publisher_id LEFT JOIN runs u ON u.id = v.run_id WHERE v.id IN (SELECT object_id FROM mine WHERE kind = 'volume')""")
def _reader_volume_options(c: Catalog) -> DataFrame:
    rows, _ = reading.reader_options(c, "volume", _USER)
    return reading.shown_options("volume", rows, 40)


@query("run_option_rows", " SELECT r.id, CASE WHEN start_year = '' THEN 'Unknown year' ELSE start_year END || ' — ' || title AS label, p.name || ' · issue count unknown' AS meta, title || ' ' || start_year || ' ' || p.name AS search_label, false AS active FROM runs r JOIN publishers p ON p.id = publisher_id")
def _run_option_rows(c: Catalog) -> DataFrame:
    return reading.shown_options("run", listing.run_options(c))


@query("issue_option_rows", f" SELECT i.id, r.title || ' #' || issue_number AS label, p.name || ' · ' || {_SHOWN_DATE.format('published_date')} AS meta, r.title || ' ' || start_year || ' ' || issue_number || ' ' || p.name AS search_label, i.id = 7 AS active FROM issues i JOIN runs r ON r.id = run_id JOIN publishers p ON p.id = publisher_id")
def _issue_option_rows(c: Catalog) -> DataFrame:
    return reading.shown_options("issue", listing.issue_options(c), 7)


@query("run_tracking", f"""{_MINE}, n AS (SELECT i.run_id, count(*) AS a, count(m.object_id) AS b FROM issues i LEFT JOIN mine m ON m.kind = 'issue' AND m.object_id = i.id GROUP BY 1)
    SELECT r.id, m.object_id IS NOT NULL AS tracked, COALESCE(m.status, '') AS status, CASE m.status WHEN 'planned' THEN 'Planned' WHEN 'reading' THEN 'Reading' WHEN 'read' THEN 'Read' ELSE '' END AS status_label, COALESCE(a, 0) AS n_catalogue, COALESCE(b, 0) AS n_tracked
    FROM runs r LEFT JOIN mine m ON m.kind = 'run' AND m.object_id = r.id LEFT JOIN n ON n.run_id = r.id""")
def _run_tracking(c: Catalog) -> DataFrame:
    return reading.tracking_of(c, "run", _USER, c.runs)


@query("follow_options", f"""{_MINE} SELECT run_id, id, '#' || issue_number AS label, {_SHOWN_DATE.format('published_date')} AS meta, COALESCE(m.status, '') AS status,
      CAST(row_number() OVER (PARTITION BY run_id ORDER BY published_date NULLS LAST, issue_number NULLS LAST, id) AS INTEGER) AS position
    FROM issues i LEFT JOIN mine m ON m.kind = 'issue' AND m.object_id = i.id""")
def _follow_options(c: Catalog) -> DataFrame:
    return reading.follow_options(c, _USER, c.runs.select(F.col("id").alias("run_id")))


def _names_sql(role: str) -> str:
    return f"SELECT target_id, string_agg(p.name, ', ' ORDER BY COALESCE(credit_order, 2147483648), p.name) AS names FROM (SELECT DISTINCT target_kind, target_id, person_id, role_id, credit_order FROM credits) credits {_NAMED} WHERE target_kind = 'issue' AND r.name = '{role}' GROUP BY 1"


@query("run_page_issues", f"""{_MINE}, w AS ({_names_sql('Writer')}), q AS ({_names_sql('Penciller')})
    SELECT run_id, id, COALESCE(w.names, '') AS writers, COALESCE(q.names, '') AS pencillers, COALESCE(m.status, '') AS status, CAST(row_number() OVER (PARTITION BY run_id ORDER BY published_date NULLS LAST, issue_number NULLS LAST, id) AS INTEGER) AS position
    FROM issues i LEFT JOIN w ON w.target_id = i.id LEFT JOIN q ON q.target_id = i.id LEFT JOIN mine m ON m.kind = 'issue' AND m.object_id = i.id""")
def _run_page_issues(c: Catalog) -> DataFrame:
    pages = reading.run_pages(c, _USER, c.runs.select(F.col("id").alias("run_id")))
    return pages["issues"].select("run_id", "id", "writers", "pencillers", "status", "position")


@query("run_page_volumes", _REACH + " SELECT reach.run_id, v.id, CAST(row_number() OVER (PARTITION BY reach.run_id ORDER BY volume_number NULLS LAST, release_date NULLS LAST, v.title NULLS LAST, v.id) AS INTEGER) AS position FROM reach JOIN volumes v ON v.id = volume_id JOIN runs r ON r.id = reach.run_id")
def _run_page_volumes(c: Catalog) -> DataFrame:
    pages = reading.run_pages(c, _USER, c.runs.select(F.col("id").alias("run_id")))
    return pages["volumes"].select("run_id", "id", "position")


@query("issue_page_volumes", " SELECT issue_id, v.id, CAST(row_number() OVER (PARTITION BY issue_id ORDER BY volume_number NULLS LAST, release_date NULLS LAST, title NULLS LAST, v.id) AS INTEGER) AS position FROM volume_issues JOIN volumes v ON v.id = volume_id WHERE issue_id IN (SELECT id FROM issues)")
def _issue_page_volumes(c: Catalog) -> DataFrame:
    pages = reading.issue_pages(c, _USER, c.issues.select(F.col("id").alias("issue_id")))
    return pages["volumes"].select("issue_id", "id", "position")


@query("volume_page_items", """ SELECT volume_id, 'issue' AS item, issue_id AS id, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY issue_order NULLS LAST, published_date NULLS LAST, issue_number NULLS LAST, issue_id) AS INTEGER) AS position FROM volume_issues JOIN issues i ON i.id = issue_id WHERE volume_id IN (SELECT id FROM volumes)
    UNION ALL SELECT volume_id, 'one_shot', one_shot_id, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY item_order NULLS LAST, published_date NULLS LAST, title NULLS LAST, one_shot_id) AS INTEGER) FROM volume_one_shots JOIN one_shots o ON o.id = one_shot_id WHERE volume_id IN (SELECT id FROM volumes)
    UNION ALL SELECT volume_id, 'run', r.id, CAST(row_number() OVER (PARTITION BY volume_id ORDER BY item_order NULLS LAST, title NULLS LAST, start_year NULLS LAST, r.id) AS INTEGER) FROM volume_runs JOIN runs r ON r.id = run_id WHERE volume_id IN (SELECT id FROM volumes)""")
def _volume_page_items(c: Catalog) -> DataFrame:
    pages = reading.volume_pages(c, _USER, c.volumes.select(F.col("id").alias("volume_id")))
    out = None
    for name, item in (("issues", "issue"), ("one_shots", "one_shot"), ("runs", "run")):
        rows = pages[name].select("volume_id", F.lit(item).alias("item"), F.col(f"{item}_id").alias("id"), "position")
        out = rows if out is None else out.unionByName(rows)
    return out


@query("one_shot_page_credits", f" SELECT target_id AS one_shot_id, p.name AS person, r.name AS role, show_by_default FROM credits {_NAMED} WHERE target_kind = 'one_shot' AND target_id IN (SELECT id FROM one_shots)")
def _one_shot_page_credits(c: Catalog) -> DataFrame:
    pages = reading.one_shot_pages(c, _USER, c.one_shots.select(F.col("id").alias("one_shot_id")))
    return pages["credits"].select("one_shot_id", "person", "role", "show_by_default")


# Records written ----------------------------------------------------------------------------------------------


_STORED = "SELECT o_orderkey AS id, CASE WHEN o_orderkey % 3 = 0 THEN '' ELSE 'n' || CAST(o_orderkey % 5 AS VARCHAR) END AS name, CASE WHEN o_orderkey % 4 = 0 THEN '' ELSE 'u' END AS display_url, 'old' AS display_source FROM orders WHERE o_orderkey % 7 <> 0"
_PAGE = "SELECT o_orderkey AS id, 'n' || CAST(o_orderkey % 10 AS VARCHAR) AS name, CASE WHEN o_orderkey % 2 = 0 THEN 'u' ELSE '' END AS display_url, 'new' AS display_source FROM orders"


def _saved(spark: SparkSession, sf: str, **how: bool) -> DataFrame:
    n = F.col("o_orderkey")
    orders = table(spark, sf, "orders")
    stored = orders.where(n % 7 != 0).select(n.alias("id"), F.when(n % 3 == 0, "").otherwise(F.concat(F.lit("n"), (n % 5).cast("string"))).alias("name"), F.when(n % 4 == 0, "").otherwise("u").alias("display_url"), F.lit("old").alias("display_source"))
    page = orders.select(n.alias("id"), F.concat(F.lit("n"), (n % 10).cast("string")).alias("name"), F.when(n % 2 == 0, "u").otherwise("").alias("display_url"), F.lit("new").alias("display_source"))
    return hydration.saved_list(stored, page, "id", ["name", "display_url", "display_source"], follows={"display_source": "display_url"}, **how)


@query("saved_list", f"""WITH s AS ({_STORED}), r AS ({_PAGE}), b AS (SELECT r.id, s.id IS NOT NULL AS old, r.name AS name, CASE WHEN s.id IS NULL THEN r.display_url WHEN r.display_url <> '' THEN r.display_url ELSE s.display_url END AS display_url, s.id IS NOT NULL AND s.name <> r.name AS by_name, s.id IS NOT NULL AND r.display_url <> '' AND s.display_url <> r.display_url AS by_url FROM r LEFT JOIN s USING (id))
    SELECT id, name, display_url, CASE WHEN NOT old OR by_url THEN 'new' ELSE 'old' END AS display_source, CASE WHEN NOT old THEN 'skipped' WHEN by_name OR by_url THEN 'updated' ELSE 'unchanged' END AS outcome FROM b""", catalog=False)
def _saved_list(spark: SparkSession, sf: str) -> DataFrame:
    return _saved(spark, sf, create_missing=False).drop("changed_fields")


@query("save_counts", f"""WITH s AS ({_STORED}), r AS ({_PAGE}), b AS (SELECT s.id IS NOT NULL AS old, s.id IS NOT NULL AND s.name <> r.name AS by_name, s.id IS NOT NULL AND r.display_url <> '' AND s.display_url <> r.display_url AS by_url FROM r LEFT JOIN s USING (id)),
    e AS (SELECT CASE WHEN NOT old THEN 'created' WHEN by_name OR by_url THEN 'updated' ELSE 'unchanged' END AS counter FROM b UNION ALL SELECT 'changed name' FROM b WHERE by_name UNION ALL SELECT 'changed display_url' FROM b WHERE by_url UNION ALL SELECT 'changed display_source' FROM b WHERE by_url)
    SELECT counter, CAST(2 * count(*) AS BIGINT) AS n FROM e GROUP BY 1""", catalog=False)
def _save_counts(spark: SparkSession, sf: str) -> DataFrame:
    counts = hydration.save_counts(_saved(spark, sf))
    return hydration.added_counts(counts, counts)


@query("embedded_items", """WITH s AS (SELECT p_partkey AS id, CASE WHEN p_partkey % 3 = 0 THEN '' ELSE p_name END AS name FROM part WHERE p_partkey % 2 = 0)
    SELECT p_partkey AS id, CASE WHEN s.name <> '' THEN s.name WHEN p_partkey % 5 = 0 THEN 'Unknown Volume ' || CAST(p_partkey AS VARCHAR) ELSE 'New' END AS name, CASE WHEN s.id IS NULL THEN 'created' WHEN s.name = '' THEN 'updated' ELSE 'unchanged' END AS outcome FROM part LEFT JOIN s ON s.id = p_partkey""", catalog=False)
def _embedded_items(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    part = table(spark, sf, "part")
    stored = part.where(n % 2 == 0).select(n.alias("id"), F.when(n % 3 == 0, "").otherwise(F.col("p_name")).alias("name"), F.lit("u").alias("url"), F.lit("a").alias("api_url"))
    named = part.select(n.alias("id"), F.when(n % 5 == 0, " ").otherwise("New").alias("name"), F.lit("u2").alias("url"), F.lit("").alias("api_url"))
    return hydration.embedded(stored, named, "Unknown Volume").select("id", "name", "outcome")


def _details(spark: SparkSession, sf: str) -> dict[str, DataFrame]:
    """Details of all orders but those that end in 9: lines are credits, every third order states no credits, odd ones two images."""
    n = F.col("id")
    lines = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("id")).agg(F.collect_list(F.struct(F.col("l_suppkey").alias("id"), F.when(F.col("l_linenumber") % 2 == 0, "Writer, Artist").otherwise("writer").alias("role"))).alias("person_credits"), F.collect_list(F.struct(F.col("l_partkey").alias("id"), F.lit("x").alias("name"))).alias("team_credits"))
    image = F.array(F.struct(F.lit("").alias("original_url"), F.lit("no link").alias("caption")), F.struct(F.lit("http://x/").alias("original_url"), F.lit("cover").alias("caption")))
    empty = [F.array().cast("array<string>").alias(f) for f in hydration.DETAIL_FIELDS if f not in ("person_credits", "team_credits", "associated_images")]
    raw = lines.select("id", F.when(n % 3 > 0, F.col("person_credits")).alias("person_credits"), "team_credits", F.when(n % 2 == 1, image).alias("associated_images"), *empty)
    raw = raw.where(n % 10 != 9).select("id", F.lit("detail").alias("title"), F.to_json(F.struct(*[f for f in raw.columns if f != "id"])).alias("json"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"))
    stored = orders.where(n % 4 != 1).select("id", F.lit("").alias("title"))
    credits = orders.select(n.alias("issue_id"), F.lit(1).cast("bigint").alias("person_id"), F.lit("writer").alias("role"))
    relations = orders.select(n.alias("issue_id"), F.lit("team").alias("entity"), F.lit("credit").alias("relation"), F.lit(1).cast("bigint").alias("entity_id"))
    images = orders.select(n.alias("issue_id"), F.lit(1).alias("position"), *[F.lit("http://old/").alias(f) for f in (*hydration.IMAGE_LINKS, "image_tags", "caption")])
    return hydration.hydrated(stored, raw, ["title"], credits, relations, images)


_KNOWN = "WITH known AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 10 <> 9 AND l_orderkey % 4 <> 1)"


@query("hydrated_credits", _KNOWN + """, d AS (SELECT DISTINCT l_orderkey AS issue_id, l_suppkey AS person_id, unnest(CASE WHEN l_linenumber % 2 = 0 THEN ['writer', 'artist'] ELSE ['writer'] END) AS role FROM lineitem WHERE l_orderkey IN (SELECT id FROM known WHERE id % 3 > 0)),
    e AS (SELECT o_orderkey AS issue_id, 1 AS person_id, 'writer' AS role FROM orders)
    SELECT COALESCE(e.issue_id, d.issue_id) AS issue_id, COALESCE(e.person_id, d.person_id) AS person_id, COALESCE(e.role, d.role) AS role, CASE WHEN e.issue_id IS NULL THEN 'create' WHEN d.issue_id IS NOT NULL OR e.issue_id NOT IN (SELECT id FROM known WHERE id % 3 > 0) THEN 'keep' ELSE 'delete' END AS action
    FROM e FULL JOIN d ON e.issue_id = d.issue_id AND e.person_id = d.person_id AND e.role = d.role""", catalog=False)
def _hydrated_credits(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf)["credits"]


@query("hydrated_relations", _KNOWN + """, d AS (SELECT DISTINCT l_orderkey AS issue_id, l_partkey AS entity_id FROM lineitem WHERE l_orderkey IN (SELECT id FROM known)), e AS (SELECT o_orderkey AS issue_id, 1 AS entity_id FROM orders)
    SELECT COALESCE(e.issue_id, d.issue_id) AS issue_id, COALESCE(e.entity_id, d.entity_id) AS entity_id, CASE WHEN e.issue_id IS NULL THEN 'create' WHEN d.issue_id IS NOT NULL OR e.issue_id NOT IN (SELECT id FROM known) THEN 'keep' ELSE 'delete' END AS action
    FROM e FULL JOIN d ON e.issue_id = d.issue_id AND e.entity_id = d.entity_id""", catalog=False)
def _hydrated_relations(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf)["relations"].select("issue_id", "entity_id", "action")


@query("hydrated_issues", _KNOWN + """, s AS (SELECT o_orderkey AS id FROM orders WHERE o_orderkey % 4 <> 1), r AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 10 <> 9)
    SELECT COALESCE(s.id, r.id) AS id, CASE WHEN r.id IS NULL THEN '' ELSE 'detail' END AS title, CASE WHEN s.id IS NULL THEN 'skipped' WHEN r.id IS NULL THEN 'kept' ELSE 'updated' END AS outcome, CASE WHEN s.id IS NULL OR r.id IS NULL THEN NULL ELSE s.id % 3 > 0 AND s.id % 2 = 1 END AS hydrated
    FROM s FULL JOIN r ON s.id = r.id""", catalog=False)
def _hydrated_issues(spark: SparkSession, sf: str) -> DataFrame:
    out = _details(spark, sf)
    return out["issues"].join(out["stamps"].select("id", "hydrated"), "id", "left").select("id", "title", "outcome", "hydrated")


@query("hydrated_images", _KNOWN + """ SELECT o_orderkey AS issue_id, CASE WHEN n THEN 2 ELSE 1 END AS position, CASE WHEN n THEN 'cover' ELSE 'http://old/' END AS caption FROM (SELECT o_orderkey, o_orderkey IN (SELECT id FROM known WHERE id % 2 = 1) AS n FROM orders) o""", catalog=False)
def _hydrated_images(spark: SparkSession, sf: str) -> DataFrame:
    return _details(spark, sf)["images"].select("issue_id", "position", "caption")
