"""What a task holds is bounded: rows without a key, pairs of readers and volumes, bytes that a task reads."""

from __future__ import annotations

import contextlib

from pyspark.sql import functions as F

from longbox import session
from longbox.operators import listing, tracking
from longbox.sources.tables import star_catalog


@contextlib.contextmanager
def settings(spark, **values):
    keys = {"spark.sql." + k.replace("__", "."): v for k, v in values.items()}
    before = {k: spark.conf.get(k) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        yield
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)


def test_readers_meet_classes_of_volumes_not_pairs(spark, sf_dir):
    c = star_catalog(spark, sf_dir)
    rows = tracking.tracked_volumes(c)
    assert rows._jdf.queryExecution().optimizedPlan().nodeName() == "Union"  # no aggregate over pairs
    reach: dict = {}
    for r in listing.reached_runs(c).collect():
        reach.setdefault(r.run_id, set()).add(r.volume_id)
    held: dict = {}
    for r in c.volume_issues.collect():
        held.setdefault(r.issue_id, set()).add(r.volume_id)
    brute = set()
    for p in c.progress.collect():
        of = {"volume": {p.object_id}, "run": reach.get(p.object_id, ()), "issue": held.get(p.object_id, ())}.get(p.kind, ())
        brute |= {(p.user_id, v) for v in of}
    got = [tuple(r) for r in rows.collect()]
    assert len(got) == len(set(got)) and set(got) == brute


def test_requests_without_a_key_are_dealt_out(spark, sf_dir):
    c = star_catalog(spark, sf_dir)
    with settings(spark, adaptive__enabled="false", autoBroadcastJoinThreshold="-1", shuffle__partitions="8"):
        none = F.lit(None).cast("long")
        asked = c.issues.select(F.col("id").alias("request"), *[none.alias(f"{k}_id") for k in ("publisher", "run", "issue", "volume", "one_shot")])
        rows = listing.selection(asked, c)
        sizes = [r["count"] for r in rows.groupBy(F.spark_partition_id()).count().collect()]
        assert rows.where("selected <> 'none' or selected_publisher_id is not null").count() == 0
    assert sum(sizes) == c.issues.count() and max(sizes) < sum(sizes) / 2


def test_tasks_read_bounded_bytes(spark):
    key, other = session.TASK_LIMITS
    before = [spark.conf.get(k) for k in (key, other)]
    try:
        spark.conf.set(key, "1g")
        spark.conf.set(other, "300k")
        session.bounded_tasks(spark)
        assert (spark.conf.get(key), spark.conf.get(other)) == (str(session.TASK_BYTES), "300k")
    finally:
        spark.conf.set(key, before[0])
        spark.conf.set(other, before[1])
    assert [session._bytes(t) for t in ("128MB", "67108864b", "16m", "5", "2 GB".replace(" ", ""))] == [128 << 20, 64 << 20, 16 << 20, 5, 2 << 30]


def plan_of(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_a_record_is_parsed_once_for_all_its_fields(spark):
    from longbox.operators import hydration
    from longbox.sources import records

    texts = ['{"a":[1],"b":null,"c":"[x"}', '{"c":{}}', "[1]", "{bad", None]
    raw = spark.createDataFrame(list(enumerate(texts)), "id long, json string")
    got = raw.select("id", records.field_states(F.col("json"), ("a", "b", "c")).alias("s")).orderBy("id").collect()
    assert [list(r.s) for r in got] == [["list", "null", "invalid"], ["absent", "absent", "invalid"], *[["invalid"] * 3] * 3]
    assert [r.missing for r in hydration.complete_details(raw, ("a", "b", "c")).orderBy("id").collect()] == [["c"], ["a", "b", "c"], *[["a", "b", "c"]] * 3]
    states = records.field_states(F.col("json"), hydration.DETAIL_FIELDS)
    assert str(states).count("json_object_keys") == 1
    rows = records.relations(raw, "id")
    assert "get_json_object" not in plan_of(rows) and rows.count() == 0
    one = spark.createDataFrame([(1, '{"team_credits":[{"id":2,"name":"a"},{"id":2,"name":"b"},{"id":null}],"object_credits":"no list"}')], "id long, json string")
    assert [tuple(r) for r in records.relations(one, "id").collect()] == [(1, "team", "credit", 2, "b")]


def test_keys_are_worked_out_once(spark):
    from longbox.functions import source

    key = source.short_key(source.issue_key(F.col("t"), F.col("n")), F.col("n"))
    rows = spark.createDataFrame([("Saga Annual (2020) #7", "7")], "t string, n string").select(key.alias("k"))
    assert len(plan_of(rows)) < 12_000  # 30 times that where each use repeats it
    assert rows.first().k == "saga-annual#7"


def test_rows_that_take_long_are_dealt_out(spark, sf_dir):
    from longbox.plans import QUERIES

    with settings(spark, adaptive__enabled="false"):
        for name in ("issue_keys", "collected_texts"):
            assert QUERIES[name](spark, sf_dir).rdd.getNumPartitions() == 4 * spark.sparkContext.defaultParallelism
