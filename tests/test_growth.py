"""What a query shuffles or holds in a task grows no faster than its tables."""

from __future__ import annotations

import contextlib
import io

from pyspark.sql import functions as F
from test_bounded import settings

from longbox import session
from longbox.operators import classify, credits, tracking
from longbox.sources import page_lines, pages
from longbox.sources.tables import star_catalog, table


def executed(df) -> str:
    with contextlib.redirect_stdout(io.StringIO()) as out:
        df.explain("simple")
    return out.getvalue()


def test_pairs_of_credits_are_shuffled_once(spark, sf_dir, monkeypatch):
    c = star_catalog(spark, sf_dir)
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        text = executed(credits.volume_credits(c))
        assert "hashpartitioning(volume_id" not in text.split("Union", 1)[0] and text.split("Union", 1)[0].count("hashpartitioning(person_id") == 1
        want = sorted(map(repr, credits.volume_credits(c).collect()))
        monkeypatch.setattr(credits, "MEMBERS", 2)  # lists of two give the same rows
        assert sorted(map(repr, credits.volume_credits(c).collect())) == want and want


def test_pairs_of_readers_are_dealt_out_before_they_are_compared(spark, sf_dir):
    c = star_catalog(spark, sf_dir)
    for rows, other in ((tracking.tracked_runs(c), "run_id"), (tracking.tracked_issues(c), "issue_id")):
        text = executed(rows).split("Union", 1)[0]
        assert "hashpartitioning(user_id" in text and text.index("HashAggregate") < text.index("hashpartitioning(user_id")
        assert "HashAggregate" not in text[text.index("hashpartitioning(user_id") :], other


def test_shuffles_follow_the_size_of_tables(spark, tmp_path):
    def rows(name):
        path = f"{tmp_path}/{name}.parquet"
        spark.range(40_000).repartition(10).write.parquet(path)
        return table(spark, str(tmp_path), name)

    before = spark.conf.get(session.PARTS, None)
    try:
        with settings(spark, files__maxPartitionBytes="16k", files__openCostInBytes="16k"):
            n = rows("a").rdd.getNumPartitions()
            assert n >= 10 and int(spark.conf.get(session.PARTS)) >= session.PARTS_A_TASK * n
            spark.conf.set(session.PARTS, "3")
            rows("b")
            assert spark.conf.get(session.PARTS) == "3"  # the caller's own stands
    finally:
        spark.conf.unset(session.PARTS) if before is None else spark.conf.set(session.PARTS, before)


def test_streaks_build_no_table_of_runs(spark):
    most = 2**63 - 1
    rows = spark.createDataFrame([("a", n) for n in (5, 6, 6, 7, 9, 10, -1, 0)] + [("b", most), ("b", -most - 1), ("b", most - 1), ("c", None)], "g string, n long")
    got = classify.longest_streak(rows, "g", "n")
    assert {tuple(r) for r in got.collect()} == {("a", 3), ("b", 2)}
    text = executed(got)
    assert text[: text.index("Window")].count("HashAggregate") == 2  # of groups alone


def plan_size(df) -> int:
    return len(df._jdf.queryExecution().optimizedPlan().toString())


def test_only_what_is_asked_of_a_page_is_read(spark):
    text = "Saga (2020) #7\nPublished: May 1, 2020\nWriter: Ann, Bob\nInker:\nCy\nLast  \twords."
    rows = spark.createDataFrame([(1, text)], "id long, t string").withColumns({"title": F.lit("Saga"), "n": F.lit("7")})
    whole = page_lines.issue_details(rows, "id", "t", "title", "n")
    told = page_lines.issue_details(rows, "id", "t", "title", "n", told=("title_at", "description"))
    assert told.columns == ["ref", "title_at", "description"] and plan_size(told) < plan_size(whole)
    assert told.collect() == whole.select("ref", "title_at", "description").collect() and told.first().description == "Last words."


def test_labels_are_read_once(spark):
    rows = spark.createDataFrame([(1, "Written by: Ann & ann\r\nCover: \n  Bob \tLee\nInker:\n\nx\nno label:  Cy"), (2, None)], "id long, t string")
    lines = pages.labelled_lines(rows, "id", "t")
    assert lines._jdf.queryExecution().optimizedPlan().toString().count("A-Za-z /-") == 1
    assert [tuple(r)[1:] for r in lines.orderBy("position").collect()] == [(0, "Written by", "Ann & ann"), (1, "Cover", "Bob Lee"), (3, "Inker", "x"), (5, "no label", "Cy")]
    got = {tuple(r) for r in pages.credits_of(lines).select("role", "name").collect()}
    assert got == {("Writer", "Ann"), ("Cover Artist", "Bob Lee"), ("Inker", "x")}


def test_pairs_of_readers_and_volumes_of_one_run_are_not_compared(spark, sf_dir, monkeypatch):
    c = star_catalog(spark, sf_dir)
    with settings(spark, autoBroadcastJoinThreshold="-1"):
        rows = tracking.tracked_volumes(c)
        first = executed(rows).split("Generate explode(volumes", 2)[1]
        assert "BroadcastHashJoin" in first and "HashAggregate(keys=[user_id" not in first and "HashAggregate(keys=[run_id" in first
        assert executed(rows).count("FileScan parquet [l_") <= 2  # what runs reach is worked out once
        want = sorted(map(tuple, rows.collect()))
        for name, value in (("MOST_BROADCAST", 0), ("PART", 1), ("MEMBERS", 2)):
            monkeypatch.setattr(tracking, name, value)
            assert sorted(map(tuple, tracking.tracked_volumes(c).collect())) == want and len(want) == len(set(want)) > 0, name


def test_tracked_volumes_of_runs_that_overlap(spark, sf_dir, monkeypatch):
    from dataclasses import replace

    c = star_catalog(spark, sf_dir)
    at = "timestamp '2024-01-01 00:00:00' as updated_at"
    progress = spark.sql(f"select cast(u as bigint) user_id, kind, cast(o as bigint) object_id, 'read' status, {at} from values (1,'run',1),(1,'run',2),(1,'run',1),(2,'run',2),(3,'volume',11),(3,'issue',7),(4,'volume',99),(1,'volume',10),(5,'run',77) t(u, kind, o)")
    volumes = spark.sql("select * from values (10L, 1L, 1L), (11L, 1L, 2L), (12L, 1L, cast(null as bigint)) t(id, publisher_id, run_id)")
    volume_runs = spark.sql("select * from values (10L, 2L, 1), (10L, 1L, 2), (11L, 5L, 1) t(volume_id, run_id, item_order)")
    volume_issues = spark.sql("select * from values (12L, 7L, 1), (10L, 7L, 1) t(volume_id, issue_id, issue_order)")
    issues = spark.sql("select * from values (7L, 2L), (8L, 1L) t(id, run_id)")
    small = replace(c, progress=progress, volumes=volumes, volume_runs=volume_runs, volume_issues=volume_issues, issues=issues)
    want = [(1, 10), (1, 11), (1, 12), (2, 10), (2, 11), (2, 12), (3, 10), (3, 11), (3, 12), (4, 99)]
    for most in (0, 10):
        monkeypatch.setattr(tracking, "MOST_BROADCAST", most)
        assert sorted(map(tuple, tracking.tracked_volumes(small).collect())) == want
    assert tracking.tracked_volumes(replace(small, progress=progress.limit(0))).count() == 0
