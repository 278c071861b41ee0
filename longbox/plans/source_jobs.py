"""Registered queries of source jobs: plans of what to read and write, resolution, records, collecting texts, readers' pages."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from longbox.functions import collected, json_search, source
from longbox.functions import text as x
from longbox.operators import listing, planning, reports, timeline, tracking
from longbox.plans.queries import _REACH, _page_sql, query
from longbox.session import shared_path, spread
from longbox.sources import paged, records
from longbox.sources.tables import Catalog, table

_NUMBER = "regexp_replace(regexp_replace(lower(trim(issue_number)), '^\\s*(issue|no\\.?)\\s*', ''), '[^a-z0-9]+', '', 'g')"


def _text(prefix: str, column: str = "id") -> F.Column:
    return F.concat(F.lit(prefix), F.col(column).cast("string"))


# Plans ---------------------------------------------------------------------------------------------------------


@query("series_plan", f""", st AS (SELECT id, run_id, {_NUMBER} AS n, CASE WHEN id % 3 = 0 THEN '' ELSE 'k' || CAST(id AS VARCHAR) END AS key, CASE WHEN id % 5 = 0 THEN '' ELSE 'u' END AS url, id % 7 = 0 AS suspicious, id % 2 = 0 AS complete FROM issues WHERE id % 4 <> 0),
    b AS (SELECT run_id, n, min(id) AS id FROM st WHERE n <> '' GROUP BY ALL),
    a AS (SELECT run_id, issue_number AS number, 'k' || CAST(id AS VARCHAR) AS key, {_NUMBER} AS n FROM issues),
    j AS (SELECT a.run_id, a.number, a.key, COALESCE(k.id, b.id) AS issue_id FROM a LEFT JOIN st k ON k.key = a.key AND k.run_id = a.run_id LEFT JOIN b ON b.run_id = a.run_id AND b.n = a.n)
    SELECT run_id, number, key, issue_id, reason FROM (SELECT j.*, CASE WHEN issue_id IS NULL THEN 'missing issue' WHEN s.key = '' THEN 'missing key' WHEN s.url = '' THEN 'missing link' WHEN suspicious THEN 'suspicious credits' WHEN NOT complete THEN 'incomplete details' ELSE '' END AS reason
      FROM j LEFT JOIN st s ON s.id = issue_id) WHERE reason <> ''""")
def _series_plan(c: Catalog) -> DataFrame:
    n = F.col("id")
    stored = c.issues.where(n % 4 != 0).select("id", "run_id", "issue_number", F.when(n % 3 == 0, "").otherwise(_text("k")).alias("key"), F.when(n % 5 == 0, "").otherwise("u").alias("url"), (n % 7 == 0).alias("suspicious"), (n % 2 == 0).alias("complete"))
    stated = c.issues.select("run_id", F.col("issue_number").alias("number"), _text("k").alias("key"), F.lit("u").alias("url"))
    return planning.series_plan(stated, stored)


@query("status_plan", " SELECT run_id, i.id AS issue_id, COALESCE(p.status, 'planned') AS status, row_number() OVER (PARTITION BY run_id ORDER BY published_date NULLS FIRST, issue_number, i.id) AS position FROM issues i LEFT JOIN progress p ON kind = 'issue' AND user_id = 3 AND object_id = i.id")
def _status_plan(c: Catalog) -> DataFrame:
    chosen = c.progress.where("kind = 'issue' and user_id = 3").select(F.col("object_id").alias("issue_id"), "status")
    return planning.status_plan(c.issues, "planned", chosen).withColumn("position", F.col("position").cast("long"))


_PAGE_KEY = "lower(regexp_replace(regexp_replace(regexp_replace(url, '[?#].*$', ''), '^[a-zA-Z]+://(www\\.)?', ''), '/+$', ''))"


@query("known_links", """WITH k AS (SELECT DISTINCT rtrim(split_part(url, '?', 1), '/') AS x FROM pages WHERE page_id % 3 = 0), v AS (SELECT page_id, unnest([url || '/', rtrim(url, '/'), split_part(url || '/', '?', 1), rtrim(split_part(url || '/', '?', 1), '/')]) AS x FROM pages)
    SELECT page_id AS ref, url || '/' AS href, page_id IN (SELECT page_id FROM v JOIN k USING (x)) AS known FROM pages WHERE url IS NOT NULL""", catalog=False)
def _known_links(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").where("url is not null")
    known = pages.where("page_id % 3 = 0").select(F.regexp_replace(F.regexp_extract("url", r"^[^?]*", 0), "/+$", "").alias("url"))
    return planning.known_links(pages.select(F.col("page_id").alias("ref"), F.concat("url", F.lit("/")).alias("href")), known)


@query("link_counts", f"""WITH p AS (SELECT page_id, url, {_PAGE_KEY} AS key FROM pages WHERE url <> ''), f AS (SELECT key, first(url ORDER BY page_id) AS url, count(*) AS n FROM p GROUP BY 1),
    t AS (SELECT f.*, key IN (SELECT key FROM p WHERE page_id % 5 = 0) AS done, url IN (SELECT url FROM p WHERE page_id % 3 = 0) AS u, key IN (SELECT key FROM p WHERE page_id % 3 = 0) AS k FROM f)
    SELECT CASE WHEN u THEN 'exact link' WHEN k THEN 'key' ELSE 'pending' END AS outcome, count(*) AS n FROM t WHERE NOT done GROUP BY 1 UNION ALL SELECT 'repeat', CAST(sum(CASE WHEN done THEN n ELSE n - 1 END) AS BIGINT) FROM t HAVING sum(CASE WHEN done THEN n ELSE n - 1 END) > 0""", catalog=False)
def _link_counts(spark: SparkSession, sf: str) -> DataFrame:
    pages = table(spark, sf, "pages").select(F.col("page_id").alias("position"), F.col("url").alias("href"))
    keyed = pages.select("position", F.col("href").alias("url"), x.url_key(F.col("href")).alias("key"))
    return planning.link_counts(pages, keyed.where("position % 3 = 0").select("url", "key"), keyed.where("position % 5 = 0").select("key"))


@query("selected_sources", " SELECT id, row_number() OVER (ORDER BY lower(title), start_year, id) AS position FROM (SELECT * FROM runs JOIN (SELECT id AS pid, name FROM publishers) ON pid = publisher_id WHERE lower(name) = 'nation_7' ORDER BY lower(title), start_year, id LIMIT 40)")
def _selected_sources(c: Catalog) -> DataFrame:
    from pyspark.sql import Window

    named = c.runs.join(c.publishers.select(F.col("id").alias("publisher_id"), F.col("name").alias("publisher")), "publisher_id").withColumnRenamed("title", "name")
    rows, _ = planning.selected_sources(named, publisher="Nation_7", limit=40)
    return rows.select("id", F.row_number().over(Window.orderBy(F.lower("name"), "start_year", "id")).cast("long").alias("position"))


@query("missing_below", """, cur AS (SELECT id AS run_id, id % 400 AS top FROM runs), have AS (SELECT run_id, TRY_CAST(issue_number AS BIGINT) AS n FROM issues WHERE regexp_matches(issue_number, '^\\d+$')),
    tops AS (SELECT run_id, top FROM cur WHERE top > 1),
    gone AS (SELECT run_id, unnest(generate_series(1, top - 1)) AS n FROM tops)
    SELECT run_id, count(*) AS n_missing, CAST(sum(n) AS BIGINT) AS missing_sum FROM gone WHERE NOT EXISTS (SELECT 1 FROM have h WHERE h.run_id = gone.run_id AND h.n = gone.n) GROUP BY 1""")
def _missing_below(c: Catalog) -> DataFrame:
    current = c.runs.select(F.col("id").alias("run_id"), (F.col("id") % 400).alias("number"))
    return reports.missing_counts(c.issues, current)


# Resolution ----------------------------------------------------------------------------------------------------


def _items(name: str, date: str) -> None:
    sql = f""", w AS (SELECT id AS ref, publisher_id, CASE WHEN id % 5 = 0 THEN 'v' || CAST(id AS VARCHAR) ELSE '' END AS key, upper(title) AS title, CASE WHEN id % 2 = 0 THEN {date} END AS date FROM {name}),
    h AS (SELECT ref, 1 AS tier, id FROM w JOIN {name} i ON i.publisher_id = w.publisher_id AND key = 'v' || CAST(id AS VARCHAR) WHERE id % 10 = 0
      UNION ALL SELECT ref, CASE WHEN date = {date} THEN 2 ELSE 3 END, id FROM w JOIN {name} i ON i.publisher_id = w.publisher_id AND lower(i.title) = lower(w.title))
    SELECT w.ref, CAST(min(tier) AS INTEGER) AS tier, first(id ORDER BY tier, id) AS item_id FROM w LEFT JOIN h USING (ref) GROUP BY 1"""

    @query(f"resolved_{name}", sql)
    def _resolved(c: Catalog) -> DataFrame:
        rows, n = getattr(c, name), F.col("id")
        items = rows.withColumn("source_key", F.when(n % 10 == 0, _text("v")).otherwise(""))
        wanted = rows.select(n.alias("ref"), "publisher_id", F.when(n % 5 == 0, _text("v")).otherwise("").alias("key"), F.upper("title").alias("title"), F.when(n % 2 == 0, F.col(date)).alias("date"))
        return planning.resolved_items(items, wanted, date)


_items("volumes", "release_date")
_items("one_shots", "published_date")


@query("named_entities", """, s AS (SELECT id, name, CASE WHEN id % 2 = 0 THEN '' ELSE 'u' || CAST(id AS VARCHAR) END AS url FROM people WHERE id % 3 <> 0), r AS (SELECT id, CASE WHEN id % 4 = 0 THEN '' WHEN id % 4 = 1 THEN name ELSE name || ' II' END AS name, 'u' || CAST(id AS VARCHAR) AS url FROM people WHERE id % 7 <> 0)
    SELECT COALESCE(s.id, r.id) AS id, CASE WHEN s.id IS NULL AND r.name = '' THEN 'Unknown Person ' || CAST(r.id AS VARCHAR) WHEN COALESCE(r.name, '') = '' THEN s.name ELSE r.name END AS name, COALESCE(r.url, s.url) AS url,
      CASE WHEN s.id IS NULL THEN 'created' WHEN r.id IS NULL THEN 'kept' WHEN (r.name = '' OR r.name = s.name) AND r.url = s.url THEN 'unchanged' ELSE 'updated' END AS outcome FROM s FULL JOIN r ON s.id = r.id""")
def _named_entities(c: Catalog) -> DataFrame:
    n = F.col("id")
    stored = c.people.where(n % 3 != 0).select("id", "name", F.when(n % 2 == 0, "").otherwise(_text("u")).alias("url"))
    remote = c.people.where(n % 7 != 0).select("id", F.when(n % 4 == 0, " ").when(n % 4 == 1, F.col("name")).otherwise(F.concat("name", F.lit(" II"))).alias("name"), _text("u").alias("url"))
    return planning.named_entities(stored, remote.unionByName(remote), "Person")


@query("hidden_runs", """, t AS (SELECT id, CASE id % 5 WHEN 0 THEN 'Star Wars: ' || title WHEN 1 THEN 'ACTION COMICS' WHEN 2 THEN 'Action Comics Weekly' WHEN 3 THEN 'Aliens' ELSE title END AS title FROM runs WHERE id IN (SELECT run_id FROM era_runs))
    SELECT id FROM t WHERE NOT (starts_with(lower(title), 'star wars') OR starts_with(lower(title), 'alien') OR lower(title) IN ('action comics', 'detective comics'))""")
def _hidden_runs(c: Catalog) -> DataFrame:
    n = F.col("id") % 5
    title = F.when(n == 0, F.concat(F.lit("Star Wars: "), "title")).when(n == 1, "ACTION COMICS").when(n == 2, "Action Comics Weekly").when(n == 3, "Aliens").otherwise(F.col("title"))
    renamed = replace(c, runs=c.runs.withColumn("title", title))
    return timeline.era_runs(renamed, timeline.HIDDEN_PREFIXES, hidden_titles=timeline.HIDDEN_TITLES).select("id")


# Records -------------------------------------------------------------------------------------------------------

_ALL = " UNION ALL ".join(f"SELECT o_orderkey AS issue_id, '{e}' AS entity, '{r}' AS relation, o_orderkey % {k + 3} AS entity_id, '{f}' AS name FROM orders" for k, (f, e, r) in enumerate(records.RELATIONS))


@query("all_relations", _ALL, catalog=False)
def _all_relations(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    item = lambda k, f: F.struct((n % (k + 3)).alias("id"), F.lit(f).alias("name"))
    lists = [F.array(item(k, f), item(k, f)).alias(f) for k, (f, _, _) in enumerate(records.RELATIONS)]
    return records.relations(spread(table(spark, sf, "orders").select("o_orderkey")).select(n.alias("source_id"), F.to_json(F.struct(*lists)).alias("json")))


@query("image_records", "SELECT o_orderkey AS id, 'i' || CAST(o_orderkey AS VARCHAR) AS comic_icon_url, 'a,b' AS comic_tags, '' AS comic_tiny_url, 0 AS position, 'o1' AS original_url, CASE o_orderkey % 3 WHEN 0 THEN 'cap' WHEN 1 THEN 'nam' ELSE 'tit' END AS caption FROM orders", catalog=False)
def _image_records(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("o_orderkey")
    image = F.struct(_text(" i", "o_orderkey").alias("icon_url"), F.lit("a,b ").alias("image_tags"))
    one = F.struct(F.lit("o1").alias("original_url"), F.when(n % 3 == 0, "cap").otherwise(" ").alias("caption"), F.when(n % 3 == 1, "nam").alias("name"), F.lit("tit").alias("title"))
    raw = table(spark, sf, "orders").select(n.alias("id"), F.to_json(F.struct(image.alias("image"), F.array(one).alias("associated_images"))).alias("json"))
    json = F.col("json")
    rows = raw.select("id", *source.image_links(json, "image", "comic"), F.posexplode(source.image_structs(json)).alias("position", "i"))
    return rows.select("id", "comic_icon_url", "comic_tags", "comic_tiny_url", "position", "i.original_url", "i.caption")


# Collecting texts ----------------------------------------------------------------------------------------------


@query("collected_texts", """WITH p AS (SELECT p_partkey AS ref, p_partkey % 5 + 1 AS a, p_partkey % 5 + 1 + p_partkey % 4 AS b, CAST(1990 + p_partkey % 12 AS VARCHAR) AS y, p_partkey % 9 AS s, p_partkey % 6 AS k FROM part),
    alpha AS (SELECT ref, y, array_to_string(list_transform(generate_series(a, CASE WHEN k = 5 THEN greatest(b, a + 2) ELSE b END), lambda n: CAST(n AS VARCHAR)), ',') AS numbers FROM p)
    SELECT ref, 'run' AS kind, 'Alpha Tales' AS title, y AS year, numbers FROM alpha
    UNION ALL SELECT ref, CASE WHEN s IN (0, 1) THEN 'one_shot' ELSE 'run' END, 'Beta Saga', '2001', CAST(s AS VARCHAR) FROM p
    UNION ALL SELECT ref, 'one_shot', CASE WHEN s IN (0, 1) THEN 'Alpha Tales Annual' ELSE 'Beta Saga Annual' END, '2002', '1' FROM p WHERE k = 0
    UNION ALL SELECT ref, 'run', 'Special', '2002', '4' FROM p WHERE k = 1
    UNION ALL SELECT ref, 'run', '2099 Unlimited', '1993', '5,6' FROM p WHERE k = 2
    UNION ALL SELECT ref, 'run', 'Gamma: Omega', '2003', '2,3' FROM p WHERE k = 3
    UNION ALL SELECT ref, 'one_shot', 'Gamma: Omega', '2003', '1' FROM p WHERE k = 4""", catalog=False)
def _collected_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    word = lambda v: v.cast("string")
    low, year = n % 5 + 1, word(1990 + n % 12)
    more = [", and Annual (2002) #1", ", plus Special (2002) #4", ", 2099 Unlimited (1993) #5-6", ", Gamma #1 Omega (2003) #2-3", ", Gamma #1 Omega (2003)"]
    last = F.concat(F.lit(", ALPHA TALES ("), year, F.lit(") #"), word(low + 1), F.lit("-"), word(low + 2))
    for k, text in enumerate(more):
        last = F.when(n % 6 == k, text).otherwise(last)
    text = F.concat(F.lit("Heroes meet.  Collecting Alpha Tales ("), year, F.lit(") #"), word(low), F.lit("–"), word(low + n % 4), F.lit(", Beta Saga (2001) #"), word(n % 9), last, F.when(n % 4 == 0, ". Then Delta (2005) #9.").when(n % 4 == 1, " MORE DETAILS Delta (2005) #9").otherwise(" Rating: T Delta (2005) #9"))
    rows = collected.collected_items(spread(table(spark, sf, "part").select("p_partkey")).select(n.alias("ref"), text.alias("text")), "ref", "text")
    return rows.select("ref", "kind", "title", "year", F.array_join("numbers", ",").alias("numbers"))


# Paged source --------------------------------------------------------------------------------------------------


def _order_pages(spark: SparkSession, sf: str) -> str:
    """All orders as pages of JSON items."""
    path = shared_path(spark, "order-pages")
    day = F.date_format("o_orderdate", "yyyy-MM-dd HH:mm:ss")
    paged.store_pages(table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_custkey").alias("run_id"), F.col("o_orderstatus").alias("status"), F.col("o_totalprice").alias("price"), day.alias("date_added")), path)
    return path


@query("paged_list", "SELECT o_orderkey AS id, o_custkey AS run_id, CAST(o_orderdate AS DATE) AS date_added FROM orders WHERE o_orderdate >= DATE '1995-06-01' AND o_orderkey > 50 AND o_custkey % 3 <> 0", catalog=False)
def _paged_list(spark: SparkSession, sf: str) -> DataFrame:
    rows = paged.read_list(spark, _order_pages(spark, sf), "id long, run_id long, date_added date")
    return rows.where("date_added >= DATE '1995-06-01' AND id > 50 AND run_id % 3 <> 0")


@query("paged_days", "SELECT o_orderkey AS id, o_orderstatus AS status FROM orders WHERE CAST(o_orderdate AS DATE) = (SELECT CAST(max(o_orderdate) AS DATE) FROM orders)", catalog=False)
def _paged_days(spark: SparkSession, sf: str) -> DataFrame:
    last = table(spark, sf, "orders").agg(F.max(F.to_date("o_orderdate"))).first()[0]
    return paged.read_list(spark, _order_pages(spark, sf), "id long, status string, date_added string", filter=paged.day_filter("date_added", last)).select("id", "status")


@query("paged_details", "SELECT o_orderkey AS id, o_orderstatus AS status, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100", catalog=False)
def _paged_details(spark: SparkSession, sf: str) -> DataFrame:
    top = table(spark, sf, "orders").orderBy(F.desc("o_totalprice"), "o_orderkey").select("o_orderkey").limit(paged.MOST_ITEMS).collect()
    return paged.read_details(spark, _order_pages(spark, sf), [r[0] for r in top], "id long, status string, price double")


# Search in JSON ------------------------------------------------------------------------------------------------

_NESTED_SQL = """WITH RECURSIVE docs AS (SELECT event_id AS ref, CAST(json_object('type', event_type, 'deep', json_object('list', json_array(json_object('user', 'U' || user_id, 'props', CAST(props AS JSON)), event_type))) AS JSON) AS doc FROM events),
    walk AS (SELECT ref, 'root' AS path, CAST(NULL AS VARCHAR) AS key, doc AS value FROM docs
      UNION ALL SELECT w.ref, CASE json_type(w.value) WHEN 'OBJECT' THEN w.path || '.' || e.key ELSE w.path || '[' || e.key || ']' END, CASE json_type(w.value) WHEN 'OBJECT' THEN e.key ELSE w.key END, e.value
        FROM walk w, json_each(w.value) e WHERE json_type(w.value) IN ('OBJECT', 'ARRAY')),
    leaf AS (SELECT ref, path, key, json_type(value) AS kind, value ->> '$' AS value FROM walk)
    """


def _nested_events(spark: SparkSession, sf: str) -> DataFrame:
    """Events as JSON of depth four."""
    inner = F.concat(F.lit('{"type":"'), "event_type", F.lit('","deep":{"list":[{"user":"U'), F.col("user_id").cast("string"), F.lit('","props":'), "props", F.lit('},"'), "event_type", F.lit('"]}}'))
    return table(spark, sf, "events").select(F.col("event_id").alias("ref"), inner.alias("doc"))


@query("json_values", _NESTED_SQL + """SELECT ref, path, key, value, needle FROM leaf, (VALUES ('CLICK'), ('u1'), ('7')) n(needle) WHERE kind NOT IN ('OBJECT', 'ARRAY') AND contains(lower(value), lower(needle))""", catalog=False)
def _json_values(spark: SparkSession, sf: str) -> DataFrame:
    return json_search.search(_nested_events(spark, sf), "ref", "doc", ["CLICK", "u1", "7"], any_case=True)


@query("json_keys", _NESTED_SQL + """SELECT ref, path, key, needle FROM leaf, (VALUES ('user'), ('k'), ('type')) n(needle) WHERE contains(key, needle) AND ends_with(path, '.' || key)""", catalog=False)
def _json_keys(spark: SparkSession, sf: str) -> DataFrame:
    return json_search.search(_nested_events(spark, sf), "ref", "doc", ["user", "k", "type"], in_keys=True).drop("value")


# Scalars -------------------------------------------------------------------------------------------------------


@query("issue_keys", """ SELECT id, CASE id % 4 WHEN 0 THEN 'Saga Annual (2020) # x' WHEN 1 THEN 'Saga: Ark M' WHEN 2 THEN 'Saga' ELSE 'Saga Special' END AS base, CASE WHEN id % 4 IN (0, 1, 3) THEN CASE id % 4 WHEN 0 THEN 'Saga Annual' WHEN 1 THEN 'Saga: Ark M' ELSE 'Saga Special' END || ' #' || CAST(id AS VARCHAR) ELSE CAST(id AS VARCHAR) END AS key,
    CASE id % 4 WHEN 0 THEN 'saga-annual#' WHEN 1 THEN 'saga-ark-m#' WHEN 2 THEN CAST(id AS VARCHAR) || '#' ELSE 'saga-special#' END || CAST(id AS VARCHAR) AS short FROM issues""")
def _issue_keys(c: Catalog) -> DataFrame:
    n, number = F.col("id") % 4, F.col("id").cast("string")
    base = F.when(n == 0, "Saga Annual (2020) # x").when(n == 1, "Saga: Ark M").when(n == 2, "Saga").otherwise("Saga Special")
    label = F.concat(F.when(n == 0, "Saga Annual (2020) #").when(n == 1, "Saga: Ark M #").when(n == 2, "Saga #").otherwise("Saga Special #"), number)
    key = source.issue_key(label, number)
    return spread(c.issues.select("id")).select("id", base.alias("base"), key.alias("key"), source.short_key(key, number).alias("short"))


@query("source_scalars", """SELECT p_partkey AS id, p_name || CASE WHEN p_partkey % 2 = 0 THEN '' ELSE ' (' || CAST(p_size AS VARCHAR) || ')' END AS label, CASE p_partkey % 3 WHEN 0 THEN 10 WHEN 1 THEN 20 ELSE 90 END AS priority, CASE WHEN p_partkey % 4 = 0 THEN '' ELSE 'Ann ' || p_brand END AS person,
    CASE WHEN p_partkey % 2 = 0 THEN p_size END AS credits, CASE p_partkey % 4 WHEN 0 THEN 'ongoing' WHEN 1 THEN 'completed' WHEN 2 THEN 'ongoing' ELSE 'unknown' END AS status, p_partkey % 3 <> 0 AS valid, CASE WHEN p_partkey % 2 = 0 THEN '2' ELSE '10' END AS first, CASE WHEN p_partkey % 2 = 0 THEN '10' ELSE '2A' END AS last, p_partkey % 2 = 0 AS listed FROM part""", catalog=False)
def _source_scalars(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("p_partkey")
    numbers = F.when(n % 2 == 0, F.array(F.lit("10"), F.lit("2"))).otherwise(F.array(F.lit("10"), F.lit("3"), F.lit("2A")))
    status = source.run_status(F.when(n % 4 == 0, "Saga (2020 - )").when(n % 4 == 1, "Saga (2019-2021)").otherwise("Saga"), F.lit("Saga"), n % 4 == 2, F.lit(" "))
    json = F.to_json(F.struct(F.lit("many").alias("count"), F.when(n % 2 == 0, F.col("p_size")).alias("issue_count")))
    ends = source.end_numbers(numbers)
    return table(spark, sf, "part").select(
        n.alias("id"),
        source.labelled_title(F.col("p_name"), F.when(n % 2 == 0, "").otherwise(F.col("p_size").cast("string"))).alias("label"),
        source.write_priority(F.when(n % 3 == 0, "issue").when(n % 3 == 1, "collected_volume").otherwise("other")).alias("priority"),
        source.credit_name(F.when(n % 4 == 0, " Writers: ").otherwise(F.concat(F.lit("by  •Ann  "), "p_brand", F.lit(" ;")))).alias("person"),
        source.credit_count(json).cast("int").alias("credits"),
        status.alias("status"),
        source.valid_expression(F.when(n % 3 == 0, "material").when(n % 3 == 1, "1A-3").otherwise("7.1")).alias("valid"),
        ends["first"].alias("first"),
        ends["last"].alias("last"),
        source.id_list(F.when(n % 2 == 0, "3, 4 4").otherwise("3,x")).isNotNull().alias("listed"),
    )


# Readers' pages ------------------------------------------------------------------------------------------------


@query("reader_volumes", _REACH + """, f AS (SELECT object_id AS run_id FROM progress WHERE user_id = 3 AND kind = 'run'), mine AS (SELECT object_id AS id FROM progress WHERE user_id = 3 AND kind = 'volume' UNION SELECT volume_id FROM reach WHERE run_id IN (SELECT run_id FROM f) UNION SELECT volume_id FROM volume_issues WHERE issue_id IN (SELECT object_id FROM progress WHERE user_id = 3 AND kind = 'issue'))
    SELECT id FROM mine""")
def _reader_volumes(c: Catalog) -> DataFrame:
    return tracking.tracked_volumes(c).where("user_id = 3").select(F.col("volume_id").alias("id")).distinct()


@query("reader_one_shot_page", """, mine AS (SELECT object_id AS id FROM progress WHERE user_id = 3 AND kind = 'one_shot' UNION SELECT one_shot_id FROM volume_one_shots WHERE volume_id IN (SELECT object_id FROM progress WHERE user_id = 3 AND kind = 'volume')),
    r AS (SELECT o.*, p.name AS publisher FROM one_shots o JOIN publishers p ON p.id = publisher_id WHERE o.id IN (SELECT id FROM mine))""" + _page_sql("SELECT * FROM r", "published_date DESC NULLS FIRST, start_year DESC NULLS FIRST, publisher NULLS LAST, title NULLS LAST, id", "id, title", 5, 0))
def _reader_one_shot_page(c: Catalog) -> DataFrame:
    mine = tracking.tracked_one_shots(c).where("user_id = 3").select(F.col("one_shot_id").alias("id")).distinct()
    rows = listing.one_shot_rows(c).join(mine, "id", "left_semi").withColumn("search_rank", F.lit(0))
    return listing.page(rows, listing.ONE_SHOT_ORDER, 5, 0).select("id", "title", "position", "has_more")


@query("reader_issue_page", """, mine AS (SELECT object_id AS id FROM progress WHERE user_id = 3 AND kind = 'issue' UNION SELECT id FROM issues WHERE run_id IN (SELECT object_id FROM progress WHERE user_id = 3 AND kind = 'run') UNION SELECT issue_id FROM volume_issues WHERE volume_id IN (SELECT object_id FROM progress WHERE user_id = 3 AND kind = 'volume')),
    r AS (SELECT i.id, i.issue_number, i.published_date, u.start_year AS run_year, u.title AS run_title FROM issues i JOIN runs u ON u.id = run_id WHERE i.id IN (SELECT id FROM mine))""" + _page_sql("SELECT * FROM r", "run_year DESC NULLS FIRST, published_date DESC NULLS FIRST, run_title NULLS LAST, issue_number NULLS LAST, id", "id, issue_number", 10, 5))
def _reader_issue_page(c: Catalog) -> DataFrame:
    mine = tracking.tracked_issues(c).where("user_id = 3").select(F.col("issue_id").alias("id")).distinct()
    rows = listing.issue_rows(c).join(mine, "id", "left_semi").withColumn("search_rank", F.lit(0))
    return listing.page(rows, listing.ISSUE_ORDER, 10, 5).select("id", "issue_number", "position", "has_more")
