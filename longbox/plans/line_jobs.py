"""Registered queries of pages: read line by line, and followed from one to another,
and scanned day by day."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from longbox.operators import traversal
from longbox.plans.queries import query
from longbox.session import shared_path
from longbox.sources import page_lines
from longbox.sources.tables import table
from longbox.streaming import scans


def _order_texts(spark: SparkSession, sf: str, chunk, head: Column, tail: Column) -> DataFrame:
    """``id, text``: a page for each order, a chunk of lines for each of its rows."""
    rows = table(spark, sf, "lineitem").groupBy("l_orderkey").agg(F.sort_array(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_shipdate"))).alias("rows"))
    orders = table(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("stored"))
    pages = orders.join(rows, orders["id"] == rows["l_orderkey"], "left")
    middle = F.array_join(F.transform(F.coalesce("rows", F.array().cast("array<struct<l_linenumber:int,l_partkey:bigint,l_suppkey:bigint,l_shipdate:timestamp>>")), chunk), "\n")
    return pages.select("id", "stored", F.concat(head, middle, F.lit("\n"), tail).alias("text"))


_LINES = """WITH l AS (SELECT l_orderkey AS id, l_partkey AS p, l_suppkey AS s, CAST(l_shipdate AS DATE) AS day, l_partkey % 6 AS k, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_shipdate) AS b FROM lineitem)"""


def _issue_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Pages of issues: labels with values beside and below them, pages without a title's line or a stop line."""
    n = F.col("id")
    head = F.concat(F.lit("SKIP MENU\r\n"), F.when(n % 5 == 0, "Other words ").when(n % 5 == 1, "The SAGA page ").otherwise("Saga (2020) #"), n.cast("string"), F.lit("\n\n"))
    tail = F.concat(F.when(n % 3 != 0, "More  Details\n").otherwise(""), F.lit("Trailing "), n.cast("string"))

    def chunk(r: Column) -> Column:
        k, day, s = r["l_partkey"] % 6, F.date_format(r["l_shipdate"], "MMMM d, yyyy"), r["l_suppkey"].cast("string")
        return (
            F.when(k == 0, F.concat(F.lit("Published:\nNEXT\n"), day))
            .when(k == 1, F.concat(F.lit("Published: "), day))
            .when(k == 2, F.concat(F.lit("Writers:\n Ann P"), s, F.lit(", Bob Q")))
            .when(k == 3, F.concat(F.lit("Penciler: Cy P"), s))
            .when(k == 4, F.concat(F.lit("Inker\nWhat happened to "), s, F.lit("?")))
            .otherwise(F.concat(F.lit("Some   text "), r["l_partkey"].cast("string")))
        )

    pages = _order_texts(spark, sf, chunk, head, tail)
    return pages.select("id", "stored", "text", F.lit("Saga").alias("title"), n.cast("string").alias("number"))


@query("issue_page_details", _LINES + """, m AS (SELECT id, COALESCE(max(b) FILTER (WHERE k <= 4), 0) AS last, arg_max(day, b) FILTER (WHERE k <= 1) AS day FROM l GROUP BY 1),
    t AS (SELECT l.id, b, CASE k WHEN 5 THEN 'Some text ' || p ELSE 'What happened to ' || s || '?' END AS line FROM l JOIN m ON m.id = l.id WHERE (k = 5 AND b > last) OR (k = 4 AND b = last)
      UNION ALL SELECT o_orderkey, 0, 'Other words ' || o_orderkey FROM orders LEFT JOIN m ON m.id = o_orderkey WHERE o_orderkey % 5 = 0 AND COALESCE(last, 0) = 0
      UNION ALL SELECT o_orderkey, 1000000, 'Trailing ' || o_orderkey FROM orders WHERE o_orderkey % 3 = 0),
    d AS (SELECT id, string_agg(line, ' ' ORDER BY b) AS description FROM t GROUP BY 1)
    SELECT o_orderkey AS id, CASE WHEN o_orderkey % 5 = 0 THEN 0 ELSE 1 END AS title_at, COALESCE(m.day, CAST(o_orderdate AS DATE)) AS published_date, COALESCE(d.description, '') AS description
    FROM orders LEFT JOIN m ON m.id = o_orderkey LEFT JOIN d ON d.id = o_orderkey""", catalog=False)
def _issue_page_details(spark: SparkSession, sf: str) -> DataFrame:
    details = page_lines.issue_details(_issue_pages(spark, sf), "id", "text", "title", "number", "stored", told=("title_at", "published_date", "description"))
    return details.select(F.col("ref").alias("id"), "title_at", "published_date", "description")


@query("issue_page_credits", _LINES + """, c AS (SELECT id, b, 1 AS j, 'Writer' AS role, 'Ann P' || s AS name FROM l WHERE k = 2 UNION ALL SELECT id, b, 2, 'Writer', 'Bob Q' FROM l WHERE k = 2 UNION ALL SELECT id, b, 1, 'Penciller', 'Cy P' || s FROM l WHERE k = 3),
    f AS (SELECT id, role, name, min(b * 10 + j) AS spot FROM c JOIN orders ON o_orderkey = id GROUP BY 1, 2, 3)
    SELECT id, CAST(row_number() OVER (PARTITION BY id ORDER BY spot) AS INTEGER) AS nth, role, name FROM f""", catalog=False)
def _issue_page_credits(spark: SparkSession, sf: str) -> DataFrame:
    details = page_lines.issue_details(_issue_pages(spark, sf), "id", "text", "title", "number", told=("credits",))
    return page_lines.page_credits(details).withColumnRenamed("ref", "id")


@query("label_block_entries", _LINES + """, c AS (SELECT *, CASE WHEN k IN (0, 3) THEN 'Role ' || s % 2 END AS label FROM l),
    g AS (SELECT *, last_value(label IGNORE NULLS) OVER (PARTITION BY id ORDER BY b) AS under FROM c),
    v AS (SELECT id, under AS label, lower('Name ' || s % 5) AS key, min(b) AS b, arg_min('Name ' || s % 5, b) AS value FROM g JOIN orders ON o_orderkey = id WHERE label IS NULL AND under IS NOT NULL AND k <> 4 GROUP BY ALL)
    SELECT id, label, CAST(row_number() OVER (PARTITION BY id, label ORDER BY b) AS INTEGER) AS nth, value FROM v""", catalog=False)
def _label_block_entries(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")

    def chunk(r: Column) -> Column:
        k, s = r["l_partkey"] % 6, r["l_suppkey"]
        return F.when(k.isin(0, 3), F.concat(F.lit("Role "), (s % 2).cast("string"), F.lit(":"))).when(k == 4, "MORE").otherwise(F.concat(F.lit("Name "), (s % 5).cast("string")))

    tail = F.when(n % 4 != 0, "SPECS\nPrice:\n$1").otherwise("")
    pages = _order_texts(spark, sf, chunk, F.lit("Before:\nx\n Talent \n"), tail)
    return page_lines.block_entries(page_lines.label_blocks(pages, "id", "text", "talent", ("Specs", "Starring"))).withColumnRenamed("ref", "id")


@query("item_page_texts", _LINES + """, t AS (SELECT id, string_agg('Text ' || p, ' ' ORDER BY b) AS told FROM l WHERE k NOT IN (0, 4) AND b < COALESCE((SELECT min(e.b) FROM l e WHERE e.id = l.id AND e.k = 4), 1000000) GROUP BY 1)
    SELECT o_orderkey AS id, CASE o_orderkey % 3 WHEN 0 THEN 'GRAPHIC NOVEL' WHEN 1 THEN 'COMIC BOOK' ELSE '' END AS item_type, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE 'Saga ' || o_orderkey END AS title, CASE WHEN o_orderkey % 3 = 2 THEN '' ELSE COALESCE(told, '') END AS description, o_orderkey % 2 = 0 AS ongoing
    FROM orders LEFT JOIN t ON t.id = o_orderkey""", catalog=False)
def _item_page_texts(spark: SparkSession, sf: str) -> DataFrame:
    n = F.col("id")
    kind = F.when(n % 3 == 0, "Graphic Novel").when(n % 3 == 1, "COMIC BOOK").otherwise("Book")
    head = F.concat(F.lit("Log In\n"), kind, F.lit("\nSearch\n#Saga "), n.cast("string"), F.lit("\n"))
    pages = _order_texts(spark, sf, lambda r: F.when(r["l_partkey"] % 6 == 0, F.concat(F.lit("SAGA "), n.cast("string"))).when(r["l_partkey"] % 6 == 4, "Talent").otherwise(F.concat(F.lit("Text "), r["l_partkey"].cast("string"))), head, F.lit(""))
    texts = page_lines.item_texts(pages, "id", "text").withColumnRenamed("ref", "id")
    marked = pages.select("id", page_lines.ongoing_marker(F.concat(F.lit("Saga ("), F.when(n % 2 == 0, "2020 - )").otherwise("2020)")), F.lit("2020")).alias("ongoing"))
    return texts.join(marked, "id")


# Traversal -----------------------------------------------------------------------------------------------------


@query("one_hop_pages", """WITH RECURSIVE p AS (SELECT c_custkey AS key, CASE WHEN c_custkey % 17 = 5 THEN NULL WHEN c_custkey % 10 = 0 THEN c_custkey + 1 ELSE c_custkey END AS final FROM customer),
    f AS (SELECT DISTINCT final AS key, final AS page FROM p WHERE final IS NOT NULL UNION ALL SELECT key, final FROM p WHERE final IS NOT NULL AND key NOT IN (SELECT final FROM p WHERE final IS NOT NULL)),
    l AS (SELECT a.page, b.page AS target, min(o.o_orderkey) AS position FROM orders o JOIN orders n ON n.o_orderkey = o.o_orderkey + 1 JOIN f a ON a.key = o.o_custkey JOIN f b ON b.key = n.o_custkey WHERE o.o_orderpriority <> '1-URGENT' GROUP BY 1, 2),
    adj AS (SELECT page, list(target) AS targets FROM l GROUP BY 1),
    d AS (SELECT page, min({'nth': -c_acctbal, 'key': 'c' || c_custkey}) AS o FROM customer JOIN f ON key = c_custkey GROUP BY 1),
    s AS (SELECT d.page, COALESCE(targets, []) AS targets, row_number() OVER (ORDER BY o) AS n FROM d LEFT JOIN adj ON adj.page = d.page),
    w(n, page, taken, stored) AS (SELECT CAST(0 AS BIGINT), CAST(NULL AS BIGINT), false, CAST([] AS BIGINT[])
      UNION ALL SELECT s.n, s.page, NOT list_contains(w.stored, s.page), CASE WHEN list_contains(w.stored, s.page) THEN w.stored ELSE list_distinct(w.stored || [s.page] || s.targets) END FROM w JOIN s ON s.n = w.n + 1),
    r AS (SELECT page AS page, page AS seed, n, 0 AS hop, CAST(0 AS BIGINT) AS position FROM w WHERE taken UNION ALL SELECT l.target, w.page, n, 1, l.position FROM w JOIN l ON l.page = w.page WHERE taken)
    SELECT 'c' || page AS page, 'c' || arg_min(seed, {'n': n, 'hop': hop, 'position': position}) AS seed, arg_min(hop, {'n': n, 'hop': hop, 'position': position}) AS hop, arg_min(position, {'n': n, 'hop': hop, 'position': position}) AS position FROM r GROUP BY page""", catalog=False)
def _one_hop_pages(spark: SparkSession, sf: str) -> DataFrame:
    """Customers as pages, every tenth one moved and every seventeenth lost; an order links its customer to the next order's."""
    customers, orders = table(spark, sf, "customer"), table(spark, sf, "orders")
    name = lambda c: F.concat(F.lit("c"), c.cast("string"))
    n = F.col("c_custkey")
    seeds = customers.select(name(n).alias("key"), (-F.col("c_acctbal")).alias("nth"))
    pages = customers.select(name(n).alias("key"), F.when(n % 17 == 5, "").when(n % 10 == 0, name(n + 1)).otherwise(name(n)).alias("final"))
    following = orders.select((F.col("o_orderkey") - 1).alias("o_orderkey"), name(F.col("o_custkey")).alias("target"))
    links = orders.join(following, "o_orderkey").select(name(F.col("o_custkey")).alias("key"), F.col("o_orderkey").alias("position"), "target", F.col("o_orderpriority").alias("kind"))
    return traversal.one_hop(seeds, links, pages, skip=("1-URGENT",))


# Day scans -----------------------------------------------------------------------------------------------------


@query("day_scans", """WITH o AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day, row_number() OVER (PARTITION BY CAST(o_orderdate AS DATE) ORDER BY o_orderkey) - 1 AS i, count(*) OVER (PARTITION BY CAST(o_orderdate AS DATE)) AS n, o_custkey FROM orders),
    p AS (SELECT phase, o.* FROM o, (VALUES ('added'), ('updated')) v(phase) WHERE day <= DATE '1997-12-31'),
    cut AS (SELECT phase, day, n, CASE WHEN phase = 'updated' AND day(day) % 5 = 0 THEN least(n, 2) ELSE n END AS reached, o_orderkey, i FROM p)
    SELECT phase, day AS scan_date, max(reached) AS next_offset, max(n) AS total, max(reached) = max(n) AS completed, count(*) FILTER (WHERE i < reached) AS n_rows, CAST(sum(o_orderkey) FILTER (WHERE i < reached) AS BIGINT) AS key_sum FROM cut GROUP BY 1, 2""", catalog=False)
def _day_scans(spark: SparkSession, sf: str) -> DataFrame:
    """Orders in pages of two by day and phase, some sent twice; from every fifth day's updates the second page never comes."""
    day = F.col("o_orderdate").cast("date").alias("scan_date")
    place = Window.partitionBy("scan_date").orderBy("o_orderkey")
    rows = table(spark, sf, "orders").select(day, "o_orderkey").withColumns({"i": F.row_number().over(place) - 1, "total": F.count(F.lit(1)).over(Window.partitionBy("scan_date"))})
    pages = rows.groupBy("scan_date", (F.col("i") - F.col("i") % 2).cast("long").alias("offset"), "total").agg(F.sort_array(F.collect_list("o_orderkey")).alias("items"))
    pages = pages.withColumn("phase", F.explode(F.array(*[F.lit(p) for p in scans.PHASES]))).where("not (phase = 'updated' and day(scan_date) % 5 = 0 and offset = 2)")
    pages = pages.withColumn("times", F.explode(F.sequence(F.lit(1), F.when(F.col("offset") == 0, 2).otherwise(1)))).drop("times")
    path = shared_path(spark, "day-scans")
    pages.repartition(4, "phase", "scan_date").write.parquet(f"{path}/pages")
    stream = spark.readStream.schema(pages.schema).option("maxFilesPerTrigger", 2).parquet(f"{path}/pages")
    scans.run_available(stream, scans.scan_batch(path, dt.date(1990, 1, 1), dt.date(1997, 12, 31)), f"{path}/checkpoint")
    read = scans.scanned_rows(spark, path, pages.schema).select("phase", "scan_date", F.explode("items").alias("item"))
    sums = read.groupBy("phase", "scan_date").agg(F.count(F.lit(1)).alias("n_rows"), F.sum("item").alias("key_sum"))
    return scans.scan_state(spark, path).join(sums, ["phase", "scan_date"])
