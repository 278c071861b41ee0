"""Readers' listings, pages of items and records written, on small hand-made tables."""

from __future__ import annotations

import json

import pytest
from test_operators import catalog  # noqa: F401

from longbox.operators import hydration, listing, reading


def test_listings_follow_the_selection_and_its_publisher(catalog):  # noqa: F811
    every = reading.reader_listings(catalog, 1)
    assert [(r.id, r.reading_status, r.n_catalogue, r.n_tracked) for r in every["runs"].collect()] == [(1, "reading", 3, 3)]
    assert sorted(r.id for r in every["issues"].collect()) == [11, 12, 13] and every["volumes"].isEmpty()
    assert [r.id for r in reading.reader_listings(catalog, 1, issue_id=12)["issues"].collect()] == [12]
    assert reading.reader_listings(catalog, 1, publisher_id=2)["runs"].isEmpty()
    assert all(rows.isEmpty() for rows in reading.reader_listings(catalog, 9).values())


def test_options_offer_what_is_tracked(catalog):  # noqa: F811
    assert [r.id for r in reading.reader_options(catalog, "run", 1)[0].collect()] == [1]
    assert reading.reader_options(catalog, "volume", 1)[0].isEmpty()
    shown = {r.id: r for r in reading.shown_options("volume", listing.volume_options(catalog), 6).collect()}
    assert (shown[5].label, shown[5].meta, shown[5].active) == ("V", "Main · A (2020)", False)
    assert (shown[6].meta, shown[6].active) == ("Main · No primary run", True)
    with pytest.raises(ValueError):
        reading.reader_options(catalog, "person", 1)


def test_pages(catalog):  # noqa: F811
    runs = catalog.runs.where("id = 1").selectExpr("id as run_id")
    pages = reading.run_pages(catalog, 1, runs)
    assert [(r.id, r.writers, r.status) for r in pages["issues"].orderBy("position").collect()] == [(11, "P", "read"), (12, "", "read"), (13, "", "read")]
    assert [r.id for r in pages["volumes"].collect()] == [5]
    held = reading.volume_pages(catalog, 1, catalog.volumes.selectExpr("id as volume_id"))
    assert {k: held[k].count() for k in ("runs", "issues", "one_shots", "groups")} == {"runs": 1, "issues": 1, "one_shots": 1, "groups": 2}
    assert [r.issue_id for r in reading.issue_pages(catalog, 1, catalog.issues.selectExpr("id as issue_id"))["volumes"].collect()] == [21]
    assert reading.one_shot_pages(catalog, 1, catalog.one_shots.selectExpr("id as one_shot_id"))["credits"].isEmpty()
    assert [r.label for r in reading.follow_options(catalog, 1, runs).orderBy("position").collect()] == ["#1", "#10", "#2"]


def test_details_state_or_are_silent(spark):
    names = (*hydration.IMAGE_LINKS, "image_tags", "caption")
    images = spark.createDataFrame([(i, 1, *["x"] * len(names)) for i in (1, 2, 3)], "issue_id long, position int, " + ", ".join(f"{n} string" for n in names))
    full = {f: [] for f in hydration.DETAIL_FIELDS}
    texts = {1: full | {"associated_images": [{}, {"thumb_url": "t", "name": "n"}]}, 2: {"associated_images": "none"}, 3: full | {"associated_images": None}}
    raw = spark.createDataFrame([(i, json.dumps(t)) for i, t in texts.items()], "id long, json string")
    assert sorted((r.issue_id, r.position, r.caption) for r in hydration.replaced_images(images, raw).collect()) == [(1, 2, "n"), (2, 1, "x")]
    missing = {r.id: r.missing for r in hydration.complete_details(raw).collect()}
    assert missing[1] == missing[3] == [] and missing[2] == list(hydration.DETAIL_FIELDS)
    people = spark.createDataFrame([(1, json.dumps({"person_credits": [{"id": 7, "role": "Writer, writer , Artist"}, {"id": None, "role": "x"}, {"id": 8}]})), (2, "{}")], "id long, json string")
    rows, owners = hydration.stated_credits(people)
    assert sorted(map(tuple, rows.collect())) == [(1, 7, "artist"), (1, 7, "writer")] and [r.issue_id for r in owners.collect()] == [1]


def test_a_field_that_follows_another(spark):
    stored = spark.createDataFrame([(1, "a", "old"), (2, "", "old")], "id long, url string, source string")
    page = spark.createDataFrame([(1, "a", "new"), (2, "b", "new"), (3, "", "new"), (None, "z", "new")], "id long, url string, source string")
    plan = hydration.saved_list(stored, page, "id", ["url", "source"], follows={"source": "url"})
    assert {r.id: (r.url, r.source, r.outcome) for r in plan.collect()} == {1: ("a", "old", "unchanged"), 2: ("b", "new", "updated"), 3: ("", "new", "created")}
    fewer = hydration.saved_list(stored, page, "id", ["url", "source"], create_missing=False)
    assert sorted(r.id for r in hydration.written(fewer).collect()) == [1, 2]
