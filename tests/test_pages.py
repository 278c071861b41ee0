"""Page parsing and conversion on small hand-made tables."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from longbox.operators import sync
from longbox.sources import pages, records

D = datetime.date


def test_links(spark):
    html = '<p><a class="x" href="/comics/issue/12/thor_god_2020_1a?x">THOR &amp; God #1</a><a href="/comics/collection/9/big">Buy</a> <a href="/comics/collection/9/big/">A Big Book</a><a href="/other">o</a>'
    links = records.page_links(spark.createDataFrame([(1, html), (2, None)], "page_id long, html string"))
    rows = links.withColumn("f", pages.link_fields(F.col("href"))).orderBy("position").collect()
    assert rows[0].label == "THOR & God #1" and rows[0].f[:] == ("issue", "12", "thor_god_2020_1a", "Thor God", "2020", "1A")
    assert [r.f and r.f.kind for r in rows] == ["issue", "collection", "collection", None]
    assert [tuple(r)[1:] for r in pages.calendar_collections(links).collect()] == [("/comics/collection/9/big", "A Big Book", 1)]


def test_page_text(spark):
    html = "<html><head><title>T &amp; U</title><style>p{}</style></head><body><script>var t='</p>';</script><p>a<br>b</p><!-- c --></body>"
    assert records.page_text(spark.createDataFrame([(1, html)], "page_id long, html string")).first()[:] == (1, "T & U", "a b")


def test_series(spark):
    rows = spark.createDataFrame([(t,) for t in ("Thor (2022 - )", "Thor (2018 - 2019)", "Thor (2020 - Present)", "Thor", "Thor (2020)")], "t string")
    got = [tuple(r.s) for r in rows.select(pages.series_fields(F.col("t")).alias("s")).collect()]
    assert got == [("Thor", "2022", "", True), ("Thor", "2018", "2019", False), ("Thor", "2020", "", True), ("Thor", "", "", False), ("Thor", "2020", "", False)]


def test_credits(spark):
    text = "Thor #1\nWritten by: Al EwingJane Doe & al ewing\nPencilers:\nBob Roe\nPrice: $4\n"
    lines = pages.labelled_lines(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t")
    got = {(r.role, r.name, r.nth) for r in pages.credits_of(lines).collect()}
    assert got == {("Writer", "Al Ewing", 1), ("Writer", "Jane Doe", 2), ("Penciller", "Bob Roe", 1)}
    marked = spark.createDataFrame([(1, "Writer", "X", 1)], "ref long, role string, name string, nth int")
    assert {(r.role, r.name) for r in pages.combined_credits(marked, pages.credits_of(lines)).collect()} == {("Writer", "X"), ("Penciller", "Bob Roe")}
    status = pages.missing_details(spark.createDataFrame([(1, "d"), (2, " ")], "ref long, description string"), marked)
    assert {r.ref: (r.missing, r.status) for r in status.collect()} == {1: ([], "complete"), 2: (["description", "writer"], "incomplete")}


def test_calendar_takes_the_last_link(spark):
    mentions = spark.createDataFrame([(1, 0, "Thor God", "2020", "1a", D(2024, 1, 3)), (1, 4, "THOR GOD", "2020", "#1A", D(2024, 1, 3)), (1, 5, "Hulk", "2020", "2", None)], "ref long, position int, title string, year string, number string, on_sale date")
    links = spark.createDataFrame([(0, "/comics/issue/1/thor_god_2020_1a"), (7, "/comics/issue/2/thor_god_2020_1a"), (8, "/x")], "position int, href string")
    got = {(r.title, r.detail_url) for r in pages.calendar_issues(mentions, links).collect()}
    assert got == {("Thor God", "/comics/issue/2/thor_god_2020_1a"), ("Hulk", "")}


def test_number_takes_the_link_of_its_series(spark):
    links = spark.createDataFrame([(1, 0, "Thor Annual #3", "/a"), (1, 1, "Other #3", "/b"), (1, 2, "Thor #3", "/c"), (1, 3, "no number", "/x/thor-4")], "ref long, position int, label string, href string")
    wanted = spark.createDataFrame([(1, "3", "Thor"), (1, "4", "Thor"), (1, "5", "Thor")], "ref long, number string, series_title string")
    assert {r.number: r.href for r in pages.collected_links(wanted, links).collect()} == {"3": "/c", "4": "/x/thor-4", "5": None}
    other = wanted.where("number = '3'").withColumn("series_title", F.lit(""))
    assert pages.collected_links(other, links).first().href == "/b"


def test_dates_roles_and_skips(spark):
    rows = spark.createDataFrame([("ON SALE: Wednesday, June 5th, 2024 x",), ("Published June 5, 2024",), ("x",)], "t string")
    assert [r.d for r in rows.select(pages.on_sale_date(F.col("t")).alias("d")).collect()] == [D(2024, 6, 5), D(2024, 6, 5), None]
    roles = spark.createDataFrame([("Written by:",), ("cover ARTISTS",), ("flatter",)], "t string")
    assert [r[:] for r in roles.select(pages.role_name(F.col("t")).alias("r")).select("r", pages.role_order(F.col("r"))).collect()] == [("Writer", 10), ("Cover Artist", 70), ("Flatter", 100)]
    assert [r.skipped for r in pages.kept_and_skipped(spark.createDataFrame([("A Poster Book",), (None,)], "t string"), "t", ("poster",)).collect()] == [True, False]


def test_descriptions_status_and_guard(spark):
    runs = spark.createDataFrame([(1, ""), (2, "own")], "id long, description string")
    issues = spark.createDataFrame([(5, 1, "#1", "first"), (6, 1, "2", "no"), (7, 2, "1", "other")], "id long, run_id long, issue_number string, description string")
    assert {r.id: r.description for r in sync.first_issue_descriptions(runs, issues).collect()} == {1: "first", 2: "own"}
    s = spark.createDataFrame([("manual_ended",), ("likely_ongoing",), ("x",)], "s string")
    assert [r[0] for r in s.select(sync.catalogue_status(F.col("s"))).collect()] == ["completed", "ongoing", "unknown"]
    c = spark.createDataFrame([(1, "ready_to_apply", "a"), (2, "ready_to_apply", "b"), (3, "applied", "a")], "group_id long, catalog_status string, fingerprint string")
    f = spark.createDataFrame([(1, "a"), (2, "z"), (3, "a")], "group_id long, fingerprint string")
    assert {r.group_id: r.may_apply for r in sync.guarded(c, f).collect()} == {1: True, 2: False, 3: False}
    p = spark.createDataFrame([(1, True), (1, True), (2, False)], "group_id long, applied boolean")
    assert {r.group_id: r.all_applied for r in sync.applied_runs(c, p).collect()} == {1: True, 2: False, 3: False}
