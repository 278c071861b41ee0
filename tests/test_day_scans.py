"""Day scans: accepted pages, and a stream that dies between its rows and its state."""

from __future__ import annotations

import datetime

import pytest

from longbox.streaming import scans

D = datetime.date
PAGES = "phase string, scan_date date, offset long, total long, items array<long>"
START, END = D(2024, 1, 1), D(2024, 1, 3)
GIVEN = [
    ("added", D(2024, 1, 1), 0, 3, [1, 2]), ("added", D(2024, 1, 1), 2, 3, [3]), ("added", D(2024, 1, 1), 3, 3, [9]), ("added", D(2024, 1, 1), 0, 3, [1, 2]),
    ("added", D(2024, 1, 2), 0, 5, [4]), ("added", D(2024, 1, 2), 2, 5, [6]), ("updated", D(2024, 1, 1), 0, 0, []), ("updated", D(2024, 1, 2), 0, None, None),
    ("added", D(2024, 1, 4), 0, 1, [7]), ("other", D(2024, 1, 1), 0, 1, [8]), (None, None, None, None, None),
]


def states(spark, path):
    return sorted(tuple(r) for r in scans.scan_state(spark, path).collect())


def test_accepted(spark, tmp_path):
    path = f"file://{tmp_path}/a"
    scans.scan_batch(path, START, END)(spark.createDataFrame(GIVEN, PAGES), 0)
    want = [("added", D(2024, 1, 1), 3, 3, True), ("added", D(2024, 1, 2), 1, 5, False), ("updated", D(2024, 1, 1), 0, 0, True), ("updated", D(2024, 1, 2), 0, 0, True)]
    assert states(spark, path) == want
    assert tuple(scans.wanted_pages(scans.scan_state(spark, path), START, END).first()) == ("added", D(2024, 1, 2), 1)
    scans.scan_batch(path, START, END)(spark.createDataFrame([("added", D(2024, 1, 2), 1, 2, [5]), ("added", D(2024, 1, 3), 0, 0, []), ("updated", D(2024, 1, 3), 0, 0, []), *GIVEN[:2]], PAGES), 1)
    assert all(s[4] for s in states(spark, path)) and scans.wanted_pages(scans.scan_state(spark, path), START, END).count() == 0
    assert sorted(i for r in scans.scanned_rows(spark, path, PAGES).collect() for i in r["items"] or []) == [1, 2, 3, 4, 5]


def test_stream_that_dies(spark, tmp_path, monkeypatch):
    pages = f"file://{tmp_path}/pages"
    rows = [("added", D(2024, 1, d), o, 6, [10 * d + o, 10 * d + o + 1]) for d in (1, 2, 3) for o in (0, 2, 4)]
    for o in (0, 2, 4):
        spark.createDataFrame([r for r in rows if r[2] == o], PAGES).coalesce(1).write.mode("append").parquet(pages)

    def stream():
        return spark.readStream.schema(PAGES).option("maxFilesPerTrigger", 1).parquet(pages)

    def dies(path):
        whole = scans.scan_batch(path, START, END)

        def apply(replies, batch):
            if batch == 1:
                scans.accepted_pages(scans.scan_state(replies.sparkSession, path, batch), replies, START, END).select("phase", "scan_date", "offset", "total", "stops", "items").write.parquet(f"{path}/rows/{batch}")
                raise RuntimeError("lost")
            whole(replies, batch)

        return apply

    once, twice = f"file://{tmp_path}/once", f"file://{tmp_path}/twice"
    scans.run_available(stream(), scans.scan_batch(once, START, END), f"{once}/checkpoint")
    with pytest.raises(Exception, match="lost"):
        scans.run_available(stream(), dies(twice), f"{twice}/checkpoint")
    assert scans.scanned_rows(spark, twice, PAGES).count() == 3
    scans.run_available(stream(), scans.scan_batch(twice, START, END), f"{twice}/checkpoint")
    read = [sorted(i for r in scans.scanned_rows(spark, p, PAGES).collect() for i in r["items"]) for p in (once, twice)]
    assert states(spark, once) == states(spark, twice) and read[0] == read[1] and len(read[0]) == 18


def test_first_day():
    today = D(2024, 5, 2)
    assert [scans.first_day(None, None, today), scans.first_day(None, START, today), scans.first_day(END, None, today), scans.first_day(END, END, today)] == [D(2024, 5, 1), START, END, END]
    with pytest.raises(ValueError):
        scans.first_day(END, START, today)
