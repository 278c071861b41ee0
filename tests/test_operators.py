"""Operators on small hand-made tables."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from longbox.operators import classify, listing, merge, reports, timeline, tracking
from longbox.sources import records
from longbox.sources.tables import Catalog
from longbox.streaming import scans

D = datetime.date


@pytest.fixture(scope="module")
def catalog(spark):
    def t(rows, schema):
        return spark.createDataFrame(rows, schema)

    d1, d2, d3 = D(2024, 1, 3), D(2024, 1, 10), D(2024, 1, 17)
    return Catalog(
        publishers=t([(1, "Main", "main"), (2, "Other", "other")], "id long, name string, slug string"),
        runs=t([(1, 1, "A", "2020", d1, d2, "ongoing"), (2, 1, "B", "2021", None, None, "completed"), (3, 2, "C", "", None, None, "unknown")], "id long, publisher_id long, title string, start_year string, first_issue_date date, last_issue_date date, status string"),
        era_runs=t([(1,), (2,), (3,)], "run_id long"),
        issues=t([(11, 1, "1", d1, True), (12, 1, "10", d2, True), (13, 1, "2", d2, True), (21, 2, "1", d2, True), (22, 2, "2", d3, True), (23, 2, "3", None, True), (24, 2, "4", d3, False)], "id long, run_id long, issue_number string, published_date date, is_released boolean"),
        volumes=t([(5, 1, 1, "V", "1", d1), (6, 1, None, "W", "2", None)], "id long, publisher_id long, run_id long, title string, volume_number string, release_date date"),
        one_shots=t([(9, 2, "S", "2020", d1)], "id long, publisher_id long, title string, start_year string, published_date date"),
        volume_issues=t([(6, 21, 1)], "volume_id long, issue_id long, issue_order int"),
        volume_runs=t([(6, 3, 1)], "volume_id long, run_id long, item_order int"),
        volume_one_shots=t([(6, 9, 1)], "volume_id long, one_shot_id long, item_order int"),
        people=t([(1, "P")], "id long, name string"),
        roles=t([(1, "Writer", 10, True)], "id long, name string, display_order int, show_by_default boolean"),
        credits=t([("issue", 11, 1, 1, 1)], "target_kind string, target_id long, person_id long, role_id long, credit_order int"),
        progress=t([(1, "run", 1, "reading", None), (1, "issue", 11, "read", None), (1, "issue", 12, "read", None), (1, "issue", 13, "read", None)], "user_id long, kind string, object_id long, status string, updated_at timestamp"),
    )


def test_timeline_layout(catalog):
    placed = {r.issue_id: r.column for r in timeline.placed_issues(catalog, catalog.runs).collect()}
    assert placed == {11: 1, 13: 2, 12: 3, 21: 2, 22: 4}
    rows = {r.id: (r.first_column, r.line_end_column, r.n_issues) for r in timeline.timeline(catalog, catalog.runs).collect()}
    assert rows == {1: (1, 4, 3), 2: (2, 5, 2), 3: (None, None, 0)}
    assert timeline.summary(catalog, catalog.runs).first()[:] == (4, 5, 3)
    assert timeline.summary(catalog, catalog.runs.where("id = 3")).first()[:] == (1, 0, 1)


def test_pages(spark):
    for n, more in ((10, False), (11, True)):
        got = listing.page(spark.range(n), ("id",)).collect()
        assert [r.id for r in got] == list(range(10)) and {r.has_more for r in got} == {more}
    last = listing.page(spark.range(13), ("id",), 5, 10).collect()
    assert [(r.id, r.position, r.has_more) for r in last] == [(10, 11, False), (11, 12, False), (12, 13, False)]


def test_reach_by_three_paths(catalog):
    assert {tuple(r) for r in listing.reached_runs(catalog).collect()} == {(5, 1), (6, 3), (6, 2)}
    assert [r.id for r in listing.browse(catalog, run_id=3)["volumes"].collect()] == [6]
    assert listing.browse(catalog, run_id=3)["one_shots"].count() == 0


def test_offer_when_all_is_read(catalog):
    r = tracking.run_progress(catalog).first()
    assert (r.n_catalogue, r.n_tracked, r.n_read, r.offer_read) == (3, 3, 3, True)


def test_changes_spread(spark, catalog):
    at = datetime.datetime(2024, 2, 1)
    changes = spark.createDataFrame([(1, "volume", 6, "read", at), (1, "issue", 22, "planned", at), (1, "issue", 11, None, at), (1, "run", 1, None, at)], "user_id long, kind string, object_id long, status string, at timestamp")
    got = {(r.kind, r.object_id): r.status for r in tracking.apply_changes(catalog, changes).collect()}
    assert got == {("issue", 12): "read", ("issue", 13): "read", ("issue", 21): "read", ("issue", 22): "planned", ("run", 2): "planned", ("volume", 6): "read"}


def test_merge_rules(spark):
    for target, source, overwrite, wanted in (("", "x", False, "x"), ("", "x", True, "x"), ("y", "x", False, "y"), ("y", "x", True, "x"), ("y", "", False, "y"), ("y", "", True, "y"), (None, None, True, None)):
        t, s = spark.createDataFrame([(1, target)], "id long, f string"), spark.createDataFrame([(1, source), (1, source)], "id long, f string")
        r = merge.upsert(t, s, "id", ["f"], overwrite).first()
        assert r.f == wanted and r.outcome == ("updated" if wanted != target else "unchanged")


def test_sync_is_idempotent(spark):
    old, new = spark.createDataFrame([(1, 1), (1, 2)], "o long, e long"), spark.createDataFrame([(1, 2), (1, 3), (1, 3)], "o long, e long")
    plan = merge.sync_plan(old, new, ["o", "e"])
    assert {tuple(r) for r in plan.collect()} == {(1, 1, "delete"), (1, 2, "keep"), (1, 3, "create")}
    again = merge.sync_plan(merge.after_sync(old, plan, ["o", "e"]), new, ["o", "e"])
    assert {r.action for r in again.collect()} == {"keep"}


def test_field_states_decide_what_a_sync_may_delete(spark):
    raw = spark.createDataFrame([(1, '{"team_credits":[{"id":7,"name":"T"},{"id":7,"name":"T"}]}'), (2, '{"team_credits":null}'), (3, "{}"), (4, '{"team_credits":5}'), (5, '{"team_credits":[]}')], "source_id long, json string")
    states = [r.s for r in raw.orderBy("source_id").select(records.field_state(F.col("json"), "team_credits").alias("s")).collect()]
    assert states == ["list", "null", "absent", "invalid", "list"]
    assert [tuple(r) for r in records.relations(raw).collect()] == [(1, "team", "credit", 7, "T")]
    keys = ["issue_id", "entity", "relation", "entity_id"]
    old = spark.createDataFrame([(i, "team", "credit", 9) for i in range(1, 6)], "issue_id long, entity string, relation string, entity_id long")
    plan = merge.sync_plan(old, records.relations(raw), keys, keys[:3], records.stated_relations(raw))
    assert {(r.issue_id, r.entity_id): r.action for r in plan.collect()} == {(1, 7): "create", (1, 9): "delete", (2, 9): "delete", (3, 9): "keep", (4, 9): "keep", (5, 9): "delete"}


def test_records(spark):
    json = '{"id":5,"name":" N ","issue_number":"1","store_date":"2024-01-03","cover_date":"bad","volume":{"id":8,"name":"V"},"image":{"small_url":"s","thumb_url":"t"},"description":"<p>x</p>"}'
    r = records.issue_records(spark.createDataFrame([(json,)], "json string")).first()
    assert r[:] == (5, "N", "1", D(2024, 1, 3), None, 8, "V", "x", "s")
    v = records.volume_records(spark.createDataFrame([('{"id":3,"publisher":{"name":"Main"}}',)], "json string")).first()
    assert (v.name, v.publisher, v.issue_count) == ("Unknown Comic Vine Volume 3", "Main", None)


def test_cascade(spark):
    groups = spark.createDataFrame([(i, f"G{i}", p, y) for i, p, y in ((1, "other", "2000"), (2, "Main", "2000"), (3, "Main", ""), (4, "Main", "2000"), (5, "Main", "2000"), (6, "Main", "2000"), (7, "Main", "2000"), (8, "MAIN ", "2000"))], "group_id long, name string, publisher string, start_year string")
    rows = [(1, 1, "1", ""), (3, 2, "1", ""), (4, 3, "1", "Vol. 1"), (5, 4, "", ""), (6, 5, "1", ""), (6, 6, "#1", ""), (7, 7, "1", ""), (8, 8, "1", ""), (8, 9, "2", "")]
    issues = spark.createDataFrame([(g, i, n, t, None, None) for g, i, n, t in rows], "group_id long, issue_id long, issue_number string, issue_title string, store_date date, cover_date date")
    facts = classify.group_facts(groups, issues)
    got = {r.group_id: r.analysis_status for r in classify.classified(facts, "Main").collect()}
    assert got == {1: "insufficient_data", 2: "insufficient_data", 3: "insufficient_data", 4: "unresolved", 5: "insufficient_data", 6: "conflict", 7: "unresolved", 8: "confirmed_run"}
    fresh = classify.classified(facts, "Main")
    stored = fresh.select("group_id", "analysis_status", F.when(F.col("group_id") == 8, "applied").otherwise(F.col("catalog_status")).alias("catalog_status"), F.when(F.col("group_id") == 8, "old").otherwise(F.col("fingerprint")).alias("fingerprint"), F.lit(False).alias("manual")).where("group_id > 5")
    moves = {r.group_id: (r.catalog_status, r.outcome) for r in classify.candidate_changes(stored, fresh).collect()}
    assert moves[8] == ("update_available", "updated") and moves[7] == ("not_ready", "unchanged") and moves[1][1] == "created"


def test_run_status(spark):
    rows = spark.createDataFrame([("ongoing", D(2024, 2, 28)), ("completed", D(2024, 2, 29)), ("unknown", D(2024, 2, 29)), ("upcoming", None)], "s string, d date")
    got = [r.x for r in rows.select(classify.run_status(F.col("s"), F.col("d"), F.lit("2024-05-31").cast("date")).alias("x")).collect()]
    assert got == ["completed", "ongoing", "unknown", "upcoming"]


def test_streaks(spark):
    rows = spark.createDataFrame([("a", n) for n in (1, 2, 3, 7, 8, 8)] + [("b", 4), ("c", None)], "g string, n int")
    assert {r.g: r.longest_streak for r in classify.longest_streak(rows, "g", "n").collect()} == {"a": 3, "b": 1}


def test_scan_state(spark):
    day = lambda n: D(2024, 1, n)
    state = spark.createDataFrame([("new", day(1), 0, None, False), ("new", day(2), 200, 250, False), ("new", day(3), 0, None, False), ("new", day(4), 5, 5, True)], "scan_kind string, scan_date date, next_offset long, total_results long, completed boolean")
    pages = spark.createDataFrame([("new", day(1), 100, 250), ("new", day(2), 50, 250), ("new", day(3), 0, 9), ("new", day(4), 3, 9)], "scan_kind string, scan_date date, page_rows long, total long")
    new = scans.advance(state, pages)
    assert {r.scan_date.day: (r.next_offset, r.completed) for r in new.collect()} == {1: (100, False), 2: (250, True), 3: (0, True), 4: (5, True)}
    assert scans.next_day(new, "2024-01-01", "2024-01-05").first()[0] == day(1)
    assert scans.next_day(new, "2024-01-01", "2024-01-05", newest_first=True).first()[0] == day(5)
    assert scans.next_day(new, "2024-01-02", "2024-01-04").count() == 0


def test_stream_restarts_where_it_ended(spark, tmp_path):
    source, seen = str(tmp_path / "in"), []
    spark.range(3).write.parquet(source)
    read = lambda: spark.readStream.schema("id long").parquet(source)
    keep = lambda df, _: seen.extend(r.id for r in df.collect())
    scans.run_available(read(), keep, str(tmp_path / "check"))
    scans.run_available(read(), keep, str(tmp_path / "check"))
    spark.range(3, 5).write.mode("append").parquet(source)
    scans.run_available(read(), keep, str(tmp_path / "check"))
    assert sorted(seen) == [0, 1, 2, 3, 4]


def test_backwards_until_a_gap(spark):
    days = spark.createDataFrame([(D(2024, 1, n), n != 3) for n in range(1, 7)], "day date, done boolean")
    assert sorted(r.day.day for r in reports.contiguous_back(days, "day", "done").collect()) == [4, 5, 6]


def test_lineage_conflicts(spark):
    old = spark.createDataFrame([(1, 10), (2, 20)], "source_id long, catalogue_id long")
    new = spark.createDataFrame([(1, 10), (2, 21), (3, 20), (4, 40)], "source_id long, matched long").withColumnRenamed("matched", "catalogue_id")
    got = {r.source_id: r.verdict for r in merge.lineage_matches(old, new).collect()}
    assert got == {1: "same", 2: "conflict: source is linked elsewhere", 3: "conflict: target is taken", 4: "new"}


def test_resolution_keeps_one_item_of_a_shared_title(spark):
    """Titles that many items share: no pairs of items and wanted rows are made, tiers and least ids stay."""
    from longbox.operators import planning

    d = [None, D(2024, 1, 1), D(2024, 1, 2)]
    items = [(k, k % 2, f"k{k % 5}" if k % 3 == 0 else "", "Red Ring" if k % 4 else "Blue", d[k % 3]) for k in range(1, 400)]
    wanted = [(r, r % 3, f"k{r % 7}" if r % 5 == 0 else " ", "RED ring" if r % 2 else "none", d[r % 3] if r % 4 else D(2025, 1, 1)) for r in range(300)]
    rows = planning.resolved_items(spark.createDataFrame(items, "id long, publisher_id long, source_key string, title string, release_date date"), spark.createDataFrame(wanted, "ref long, publisher_id long, key string, title string, date date"), "release_date")

    def brute(ref, p, key, title, date):
        hits = [(1, i) for i, q, k, _, _ in items if q == p and key.strip() and k == key]
        hits += [(2 if date is not None and date == e else 3, i) for i, q, _, t, e in items if q == p and t.lower() == title.lower()]
        return (ref, *min(hits, default=(None, None)))

    assert sorted(tuple(r) for r in rows.collect()) == [brute(*w) for w in wanted]
    plan = rows._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("Aggregate [_p#") == 3 or plan.count("Aggregate [publisher_id#") == 3, plan
