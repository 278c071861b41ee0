"""The paged source: what reaches a request, which pages are asked for, and replies of all kinds."""

from __future__ import annotations

import datetime as dt
import json

import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql.datasource import EqualTo, GreaterThan, In, StringContains
from pyspark.sql.types import LongType, StringType, StructType

from longbox.sources import paged

SCHEMA = StructType().add("id", LongType()).add("name", StringType())


@pytest.fixture(scope="module")
def pages(spark, tmp_path_factory):
    path = f"file://{tmp_path_factory.mktemp('paged')}/pages"
    rows = [(i, f"n{i % 7}", f"2024-01-{1 + i % 28:02d} 10:00:00", i * 2) for i in range(1, 2501)]
    paged.store_pages(spark.createDataFrame(rows, "id long, name string, added string, size int").repartition(6), path)
    return path


def test_pages_hold_the_list_in_order(spark, pages):
    rows = sorted(spark.read.parquet(pages).collect(), key=lambda r: r.offset)
    assert [r.offset for r in rows] == list(range(0, 2500, 100))
    items = [x["id"] for r in rows for x in json.loads(r.body)["results"]]
    assert items == list(range(1, 2501)) and all(json.loads(r.body)["number_of_total_results"] == 2500 for r in rows)


def test_conditions_and_fields_reach_the_request(pages):
    reader = paged.PagedReader({"path": pages}, SCHEMA)
    left = list(reader.pushFilters([EqualTo(("name",), "n3"), In(("id",), (5, 250, 9999)), StringContains(("name",), "n"), GreaterThan(("other",), 1)]))
    assert [type(f) for f in left] == [StringContains, GreaterThan]
    request = reader.request(0)
    assert request.fields == ("id", "name") and request.limit == 100
    assert request.conditions == (paged.Condition("name", "=", "n3"), paged.Condition("id", "in", (5, 250, 9999)))
    assert [p.offsets for p in reader.partitions()] == [[0, 200]]
    replies = list(paged.StoredPages(pages, SCHEMA).replies([reader.request(o) for o in (0, 200)]))
    assert [x for r in replies for x in r["results"]] == [] and all(r["limit"] == 100 for r in replies)
    reader = paged.PagedReader({"path": pages}, SCHEMA)
    list(reader.pushFilters([EqualTo(("id",), 250)]))
    assert list(reader.read(reader.partitions()[0])) == [(250, "n5")]
    first = next(iter(paged.StoredPages(pages, SCHEMA).replies([paged.Request(0, 10, ("id",))])))
    assert len(first["results"]) == 10 and all(set(x) == {"id"} for x in first["results"])


def test_spark_asks_for_what_a_query_needs(spark, pages):
    rows = paged.read_list(spark, pages, "id long, name string, missing string, size string").where("id > 2390 and name = 'n1' and size like '4%'")
    assert sorted(map(tuple, rows.collect())) == [(i, "n1", None, str(2 * i)) for i in range(2391, 2500) if i % 7 == 1]
    assert rows.rdd.getNumPartitions() == 1
    assert paged.read_list(spark, pages, "id long").count() == 2500
    days = paged.read_list(spark, pages, "id long, added string", filter=paged.day_filter("added", dt.date(2024, 1, 3)))
    assert {r.id % 28 for r in days.collect()} == {2}


def test_details(spark, pages):
    got = paged.read_details(spark, pages, [7, 3, 3, 9000], "id long, name string")
    assert sorted(map(tuple, got.collect())) == [(3, "n3"), (7, "n0")]
    for ids in ([0], [-1], list(range(1, 102))):
        with pytest.raises(ValueError, match="positive ids"):
            paged.read_details(spark, pages, ids, "id long")


@pytest.mark.parametrize("limit", ["0", "101", "-5"])
def test_limits_are_guarded(limit):
    with pytest.raises(ValueError, match="1 to 100"):
        paged.PagedReader({"path": "x", "limit": limit}, SCHEMA)


def test_a_bad_status_ends_the_job(spark, tmp_path):
    body = json.dumps({"status_code": 100, "error": "Invalid key", "results": []})
    pq.write_table(pa.table({"offset": [0], "first_id": [1], "last_id": [1], "body": [body]}), tmp_path / "p.parquet")
    with pytest.raises(Exception, match="the source says 100: Invalid key"):
        paged.read_list(spark, f"file://{tmp_path}", "id long").collect()


def test_an_empty_list(spark, tmp_path):
    paged.store_pages(spark.createDataFrame([], "id long, name string"), f"file://{tmp_path}/none")
    assert paged.read_list(spark, f"file://{tmp_path}/none", "id long").count() == 0


def test_values_and_days():
    from pyspark.sql.types import BooleanType, DateType, DoubleType

    assert paged.day_filter("date_added", dt.date(2024, 2, 29)) == "date_added:2024-02-29 00:00:00|2024-02-29 23:59:59"
    assert paged._value("x", LongType()) is None and paged._value("", LongType()) is None and paged._value("7", LongType()) == 7
    assert paged._value("2024-05-01 10:00:00", DateType()) == dt.date(2024, 5, 1) and paged._value({"b": 1, "a": [2]}, StringType()) == '{"a": [2], "b": 1}'
    assert paged._value("1.5", DoubleType()) == 1.5 and paged._value(1, BooleanType()) is True


def test_pages_of_several_ranges_hold_every_item_once(spark, tmp_path):
    """Ranges are uneven in bytes, so that Spark joins other ones where only ids are counted."""
    small = {"spark.sql.adaptive.advisoryPartitionSizeInBytes": "200k", "spark.sql.adaptive.coalescePartitions.parallelismFirst": "false", "spark.sql.shuffle.partitions": "16"}
    before = {k: spark.conf.get(k) for k in small}
    for k, v in small.items():
        spark.conf.set(k, v)
    try:
        items = spark.range(1, 60_001, numPartitions=6).selectExpr("id", "sha2(cast(id as string), 512) as name")
        paged.store_pages(items, f"file://{tmp_path}/pages")
        heads = spark.read.parquet(f"file://{tmp_path}/pages").select("offset", "first_id", "last_id").orderBy("offset").collect()
        assert [tuple(h) for h in heads] == [(k, k + 1, k + 100) for k in range(0, 60_000, 100)]
        assert paged.read_list(spark, f"file://{tmp_path}/pages", "id long").distinct().count() == 60_000
        found = paged.read_details(spark, f"file://{tmp_path}/pages", list(range(600, 60_001, 600)), "id long, name string")
        assert found.count() == 100
        days = paged.read_list(spark, f"file://{tmp_path}/pages", "id long, name string").where("id > 29950 and id <= 30050")
        assert days.count() == 100
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
