"""Pages read line by line."""

from __future__ import annotations

import datetime

from pyspark.sql import functions as F

from longbox.sources import page_lines

D = datetime.date


def details(spark, *texts, **more):
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string").withColumns({"title": F.lit("Saga & Co"), "number": F.lit("7"), **more})
    found = page_lines.issue_details(rows, "id", "t", "title", "number", **{k: k for k in more})
    return [tuple(r)[1:] for r in found.orderBy("ref").collect()], rows


def test_issue_details(spark):
    texts = (
        "SKIP MENU\r\nSaga and Co (2020) #7\nPublished:\nPREV\nhttps://x\nMarch 5, 2021 or later\nWriter: Ann Lee, ann lee & Bob\nInker:\nWhat happened?\nLast words.\nREAD  more now\nMORE DETAILS x\nafter",
        "x\nThe SAGA & CO page\nPublished: soon\nthen\nWriters:\nCy\nText\nSaga & Co (2020) #8",
        "first\nPublished: May 1, 2020\nPublished: Smarch 1, 2020\nWriter:\nEditor: Di",
        "first\nWriter:\n" + "word " * 17 + "\nend",
        "Saga & Co (2020) #7\nDigital Issue\nWriter: Ann",
        None,
        " \n\t",
    )
    got, _ = details(spark, *texts)
    credits = [[tuple(c) for c in g[4]] for g in got]
    assert [g[:4] for g in got] == [
        (1, 11, D(2021, 3, 5), "What happened? Last words."),
        (1, 8, None, "Text"),
        (0, 5, None, ""),
        (0, 4, None, ("word " * 17).strip() + " end"),
        (0, 1, None, ""),
        (0, 0, None, ""),
        (0, 0, None, ""),
    ]
    assert credits == [[("Writer", "Ann Lee"), ("Writer", "Bob")], [("Writer", "Cy")], [("Editor", "Di")], [], [], [], []]


def test_marked_credits_and_stored_date(spark):
    marked = F.array(F.struct(F.lit("writer").alias("role"), F.lit("Eve").alias("name")), F.struct(F.lit("writer").alias("role"), F.lit("EVE").alias("name")))
    got, rows = details(spark, "x\nWriter: Ann\nInker: Bob", published=F.lit(D(2000, 1, 2)), marked=marked)
    assert got[0][2] == D(2000, 1, 2) and [tuple(c) for c in got[0][4]] == [("writer", "Eve"), ("Inker", "Bob")]
    assert page_lines.issue_details(rows.where("false"), "id", "t", "title", "number").count() == 0


def test_long_page(spark):
    text = "Saga & Co (2020) #7\n" + "\n".join(f"Writer: Name {i % 50}\nsome words" for i in range(20_000))
    got, _ = details(spark, text)
    assert len(got[0][4]) == 50 and got[0][:2] == (0, 40_001) and got[0][3] == "some words"


def test_label_blocks(spark):
    text = "Writer:\nno\nTalent\nfree\nWriter:\nAnn\nANN\nMore\nArt:\nBob\nWriter:\nCy\nEmpty:\nSpecs\nPrice:\n$1\nStarring"
    rows = spark.createDataFrame([(1, text), (2, "Writer:\nAnn"), (3, None), (4, "talent!\n" + "x" * 81 + ":\nA:\n" + "B:"), (5, "Talent\nA:\nStarring\nx\nSpecs")], "id long, t string")
    got = {r.ref: r.block for r in page_lines.label_blocks(rows, "id", "t", "Talent", ("Specs", "Starring")).collect()}
    assert got == {1: {"Writer": ["Ann", "Cy"], "Art": ["Bob"]}, 2: {}, 3: {}, 4: {}, 5: {}}


def test_item_texts(spark):
    texts = ["Log In\nComic Book\nMore\n#Saga 1\nIt began.\nSAGA 1\nThen.\nTalent\nx", "x", None, "Graphic Novel", "Graphic novel\nTalent\nx", "COMIC BOOK\nSaga"]
    rows = spark.createDataFrame(list(enumerate(texts)), "id long, t string")
    got = [tuple(r)[1:] for r in page_lines.item_texts(rows, "id", "t").orderBy("ref").collect()]
    assert got == [("COMIC BOOK", "Saga 1", "It began. Then."), ("", "", ""), ("", "", ""), ("GRAPHIC NOVEL", "", ""), ("GRAPHIC NOVEL", "Talent", "x"), ("COMIC BOOK", "Saga", "")]


def test_line_scalars(spark):
    rows = spark.createDataFrame([("Saga (2022 -  ) x", "2022", True, False), ("Saga (2022)", "2022", False, False), ("(2022-)", "", False, False), (None, None, False, False), ("SAGA X (2020) #1", "2.20", False, True), ("Saga X (2020) #1", "\\", False, False), ("12 (2020) #1", "2020", False, False)], "t string, y string, ongoing boolean, upper boolean")
    got = rows.select("ongoing", "upper", page_lines.ongoing_marker(F.col("t"), F.col("y")).alias("o"), page_lines.uppercase_issue(F.col("t")).alias("u")).collect()
    assert all((r.o, r.u) == (r.ongoing, r.upper) for r in got)
