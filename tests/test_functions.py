"""Scalar functions against hand-made cases."""

from __future__ import annotations

import datetime

import pytest
from pyspark.sql import functions as F

from longbox.functions import text as x
from longbox.functions.collected import collected, collected_items, dated_mentions, expand
from longbox.operators import classify


def values(spark, function, inputs, kind="string"):
    rows = spark.createDataFrame([(i, v) for i, v in enumerate(inputs)], f"i int, v {kind}")
    return [r.out for r in rows.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


CASES = [
    (x.clean, [" a b ", None, " x "], ["a b", "", "x"]),
    (x.squeezed, [" a \n  b ", None], ["a b", ""]),
    (x.none_if_blank, ["  ", "a"], [None, "a"]),
    (x.non_negative_int, ["12", " 3 ", "-4", "x", None], [12, 3, 0, 0, 0]),
    (x.plain_html, ["<b>A</b> &amp; B&nbsp;C", None, "&amp;lt;"], ["A & B C", "", "&lt;"]),
    (x.title_key, ["X-Men & Co.", "  Groß!  "], ["x men and co", "gross"]),
    (x.yearless_title_key, ["Batman (2016 - 2020)", "Batman (2016-)"], ["batman", "batman"]),
    (x.alnum_number, ["Issue #1.5", "no. 7A", None], ["15", "7a", ""]),
    (x.canonical_number, ["Issue #7a", "#12", "No. 3"], ["7A", "12", "3"]),
    (x.integer_number, ["#12", "1a", " 7 "], [12, None, 7]),
    (x.standard_number, ["#12", "1a", "1.MU", "Annual 1", "-1", None], [12, 1, 1, None, None, None]),
    (x.number_in_title, ["BATMAN #12A", "BATMAN #", "BATMAN"], ["12A", "0", ""]),
    (x.expanded_range, ["1-5", "5-1", "1-400", "1A-3", " #7 ", ""], [list("12345"), ["5-1"], ["1-400"], ["1A-3"], ["7"], []]),
    (x.expanded_mentions, ["collects #3 to #5", "#5-3", "#4"], [[3, 4, 5], [5, 4, 3], []]),
    (x.volume_number_in, ["THING VOL. 3: X", "THING"], ["3", ""]),
    (x.looks_special, ["Annual 1", "12"], [True, False]),
    (x.display_date, ["Wednesday, June 5th, 2024", "June 5, 2024", "Jun 5, 2024", "06/05/2024", "2024-06-05T00:00", "soon"], [*[datetime.date(2024, 6, 5)] * 5, None]),
    (x.split_roles, ["Writer, artist,writer, ", None], [["writer", "artist"], []]),
    (x.glued_names, ["Al EwingJane Doe", "Al Ewing", "A, EwingJane"], [True, False, False]),
    (x.split_names, ["Al EwingJane Doe and Bob Roe & Cy Poe", "Ed McGuinness, Di Amorte"], [["Al Ewing", "Jane Doe", "Bob Roe", "Cy Poe"], ["Ed McGuinness", "Di Amorte"]]),
    (x.url_path, ["https://a.b/c/d?x#y", "/p/q", "https://a.b"], ["/c/d", "/p/q", ""]),
    (x.url_key, ["https://www.a.b/C/?x", "http://a.b/c"], ["a.b/c", "a.b/c"]),
    (x.typed_id, ["https://x/api/issue/4000-123/", "x"], [123, None]),
    (lambda c: x.shortened(c, 8), ["abcdefghij", "abc"], ["abcde...", "abc"]),
    (lambda c: x.query_url("/b", a=c, b=F.lit("")), ["x y", None], ["/b?a=x+y", "/b"]),
]


@pytest.mark.parametrize("case", range(len(CASES)))
def test_scalar(spark, case):
    function, inputs, wanted = CASES[case]
    assert values(spark, function, inputs) == wanted


def test_compaction(spark):
    lists = [["1", "2", "3", "5"], ["2", "1", "1"], ["1", "Annual"], [], ["7"]]
    assert values(spark, x.compacted, lists, "array<string>") == ["1-3,5", "1-2", "1,Annual", "", "7"]
    assert values(spark, lambda c: x.compacted(c, distinct=False), [["1", "1", "2"]], "array<string>") == ["1,1-2"]


def test_compaction_undoes_expansion(spark):
    import random

    rnd = random.Random(1)
    lists = [[str(n) for n in sorted(rnd.sample(range(60), rnd.randint(1, 40)))] for _ in range(40)]
    texts = values(spark, x.compacted, lists, "array<string>")
    assert [[n for part in t.split(",") for n in expand(part)] for t in texts] == lists


def test_natural_order(spark):
    rows = spark.createDataFrame([(v,) for v in ("10", "2", "#1", "1.5", "1A", "Annual")], "v string")
    assert [r.v for r in rows.orderBy(x.natural_number_key(F.col("v"))).collect()] == ["#1", "1A", "1.5", "2", "10", "Annual"]


def test_lists(spark):
    assert values(spark, x.distinct_folded, [["Al", "al ", "", "Bo"]], "array<string>") == [["Al", "Bo"]]
    assert values(spark, lambda c: x.preview(c, 2), [["1", "2", "3"], ["1"]], "array<string>") == ["1, 2, … +1 more", "1"]
    assert spark.range(1).select(x.percent(F.lit(1), F.lit(3)), x.percent(F.lit(0), F.lit(0))).first()[:] == (33.3, 0.0)
    weeks = spark.range(1).select(x.wednesdays(F.lit("2024-01-01").cast("date"), F.lit("2024-01-16").cast("date"))).first()[0]
    assert [str(d) for d in weeks] == ["2024-01-10", "2024-01-03"]


def test_item_class(spark):
    rows = [("COMIC BOOK", "1", "", True), ("COMIC BOOK", "1", "", False), ("COMIC BOOK", "", "", False), ("GRAPHIC NOVEL", "", "S", False), ("GRAPHIC NOVEL", "", "", False)]
    out = spark.createDataFrame(rows, "t string, n string, s string, r boolean").select(classify.item_class(F.col("t"), F.col("n"), F.col("s"), F.col("r")).alias("c"))
    assert [r.c for r in out.collect()] == ["collected_volume", "issue", "comic_book_needs_review", "collected_volume", "standalone_graphic_novel_or_one_shot"]


def test_collected_texts(spark):
    six = [str(n) for n in range(1, 7)]
    assert collected("Collecting Avengers (2018) #1-6.") == [("run", "Avengers", "2018", ["1-6"], six)]
    assert collected("COLLECTING: A (2018) #1-6, B (2019) #2-3") == [("run", "A", "2018", ["1-6"], six), ("run", "B", "2019", ["2-3"], ["2", "3"])]
    assert collected("Collects Thor (2014) #1, #3 and #5; Giant-Size (1999)") == [("run", "Thor", "2014", ["1", "3", "5"], ["1", "3", "5"]), ("one_shot", "Giant-Size", "1999", [], [])]
    assert collected("Collecting Alpha (1990) #1-3, Beta Saga (2001) #1") == [("run", "Alpha", "1990", ["1-3"], ["1", "2", "3"]), ("one_shot", "Beta Saga", "2001", ["1"], ["1"])]
    assert collected("Collecting Alpha Annual (1990) #1") == [("run", "Alpha Annual", "1990", ["1"], ["1"])]
    assert collected("Collecting Alpha (1990) #2 and Special (1991) #4") == [("run", "Alpha", "1990", ["2"], ["2"]), ("run", "Special", "1991", ["4"], ["4"])]
    assert collected("Collecting 2099 Unlimited (1993) #1-3") == [("run", "2099 Unlimited", "1993", ["1-3"], ["1", "2", "3"])]
    assert collected("Collecting Zeta (1990) #2, 2099 Unlimited (1993) #4") == [("run", "2099 Unlimited", "1993", ["4"], ["4"]), ("run", "Zeta", "1990", ["2"], ["2"])]
    assert collected("Collecting Alpha #1 Omega (1990) #2-3") == [("run", "Alpha: Omega", "1990", ["2-3"], ["2", "3"])]
    assert collected("Collecting Alpha #1 Omega (1990)") == [("one_shot", "Alpha: Omega", "1990", ["1"], ["1"])]
    assert collected("Collecting Alpha (1990) #1-2, ALPHA (1990) #2-3, and Annual (1991) #0") == [("run", "Alpha", "1990", ["1-2", "2-3"], ["1", "2", "3"]), ("one_shot", "ALPHA Annual", "1991", ["0"], ["0"])]
    assert collected("no such text") == [] and collected(None) == []
    rows = spark.createDataFrame([(1, "Collecting A (2018) #1-2, #4"), (2, None)], "id long, t string")
    got = collected_items(rows, "id", "t").collect()
    assert [(r.ref, r.title, r.numbers) for r in got] == [(1, "A", ["1", "2", "4"])]


def test_dates_are_carried_forward(spark):
    text = "Thor (2020) #1 ON SALE June 5, 2024 Hulk (2021) #2 Ms. Marvel (2022) #3A On Sale: June 12, 2024 Loki (2023) #4"
    got = {r.title: (r.number, r.on_sale and str(r.on_sale)) for r in dated_mentions(spark.createDataFrame([(1, text)], "id long, t string"), "id", "t").collect()}
    assert got == {"Thor": ("1", None), "Hulk": ("2", "2024-06-05"), "Ms. Marvel": ("3A", "2024-06-05"), "Loki": ("4", "2024-06-12")}


def test_json_search(spark):
    from longbox.functions.json_search import matches, search

    text = '{"a": {"B": ["Xy", 12, null, {"c": "axY", "xy": [true]}]}, "e": {}}'
    assert list(matches(text, ["xY", "1"])) == [("root.a.B[1]", "B", "12", "1"), ("root.a.B[3].c", "c", "axY", "xY")]
    assert [m[0] for m in matches(text, ["xy", "xy", "TRUE", "none"], any_case=True)] == ["root.a.B[0]", "root.a.B[2]", "root.a.B[3].c", "root.a.B[3].xy[0]"]
    assert list(matches(text, ["b"], in_keys=True, any_case=True)) == [("root.a.B", "B", '["Xy", 12, null, {"c": "axY", "xy": [true]}]', "b")]
    deep = "[" * 900 + '"needle"' + "]" * 900
    assert [m[2] for m in matches(deep, ["eed"])] == ["needle"]
    rows = spark.createDataFrame([(1, text), (2, None), (3, "{broken"), (4, ""), (5, '"Xy"')], "id long, t string")
    assert sorted((r.ref, r.path) for r in search(rows, "id", "t", ["Xy"]).collect()) == [(1, "root.a.B[0]"), (5, "root")]
    assert search(rows, "id", "t", []).count() == 0
