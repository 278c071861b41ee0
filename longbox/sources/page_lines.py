"""Pages as ordered lines: details of issues, blocks of labels, details of items; column expressions within a row.

Lines are the page's non-blank lines with white space squeezed.  What a label takes from the lines below it is found by
pairing the lines that count with their followers, so a page costs time in proportion to its length and nothing is shuffled.
Steps are bound one after another inside the row (``_steps``): as columns of nested selects the optimiser would put them
into the functions over lines, and work them out anew for every line.
A null or empty page gives no date, no credits and empty texts.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.text import alnum_number, folded, split_names, squeezed, title_key

# Labels of credits, lines that end an issue's details, and lines that belong to no text.
CREDIT_LABELS = {
    "WRITER": "Writer", "WRITERS": "Writer", "ARTIST": "Artist", "ARTISTS": "Artist", "PENCILLER": "Penciller", "PENCILLERS": "Penciller", "PENCILER": "Penciller", "PENCILERS": "Penciller",
    "INKER": "Inker", "INKERS": "Inker", "COLORIST": "Colorist", "COLORISTS": "Colorist", "COLOURIST": "Colorist", "COLOURISTS": "Colorist", "LETTERER": "Letterer", "LETTERERS": "Letterer",
    "COVER ARTIST": "Cover Artist", "COVER ARTISTS": "Cover Artist", "EDITOR": "Editor", "EDITORS": "Editor",
}
STOP_LINES = ("SEE VARIANT COVERS", "DIGITAL ISSUE", "MORE DETAILS", "COLLECTING", "RELATED")
SKIP_LINES = ("SKIP MENU", "LOG IN", "SIGN UP", "MARVEL UNLIMITED", "SUBSCRIBE", "NEWS", "COMICS", "CHARACTERS", "GAMES", "MOVIES", "TV SHOWS", "VIDEOS", "MORE", "BACK TO SERIES", "PREV", "NEXT")
#: Item pages: kinds of items, lines that end a description, lines of the site's menu (fixed values).
ITEM_TYPES = ("COMIC BOOK", "GRAPHIC NOVEL")
ITEM_STOP_LINES = ("join dc universe infinite", "find a comic shop near you", "talent", "specs", "starring", "more from this series")
ITEM_SKIP_LINES = ("", "sign up", "log in", "search", "comics", "characters", "movies tv", "games", "news", "video", "shop", "community", "more")
_ISSUE = r"(?i)([A-Z0-9][^\n\r]{1,220}?)\s*\((\d{4})\)\s*#([A-Z0-9][A-Z0-9./-]*)"
_LINE_END = r"\r\n|[\n\r\u000B\u000C\u001C-\u001E\u0085  ]"
#: White space that ends no line.
_H = r"\t\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000"
_WIDE = rf"[ {_H}](?:[ {_H}]+|(?<! ))"
_DATE = r"([A-Za-z]+)\s+(\d{1,2}),\s+(\d{4})"


def lines_of(text: Column) -> Column:
    """Array of the non-blank lines, white space squeezed."""
    return F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _WIDE, " "), _LINE_END), lambda v: F.trim(v)), lambda v: v != "")


def people_line(c: Column) -> Column:
    """Whether a line may list people: at most 180 characters and 16 words, no exclamation or question mark."""
    words = F.size(F.regexp_extract_all(c, F.lit(r"[A-Za-z][A-Za-z.'\-]*"), F.lit(0)))
    return (c != "") & (F.length(c) <= 180) & ~c.rlike("[!?]") & (words <= 16)


def uppercase_issue(c: Column) -> Column:
    """Whether a text names an issue, and its title has letters and only capital ones."""
    title = F.regexp_extract(squeezed(c), _ISSUE, 1)
    return title.rlike(r"(?U)\p{L}") & (title == F.upper(title))


def written_date(c: Column) -> Column:
    """First date like ``June 5, 2024`` in a text, months spelled out; null where there is none or it is no date."""
    part = lambda k: F.regexp_extract(c, _DATE, k)
    return F.when(part(1) != "", F.try_to_date(F.concat(F.initcap(part(1)), F.lit(" "), part(2), F.lit(", "), part(3)), "MMMM d, yyyy"))


def _label(c: Column) -> Column:
    return F.upper(F.trim(F.btrim(F.trim(c), F.lit(":"))))


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _steps(first: dict[str, Column], steps: list[Callable[[Column], dict[str, Column]]], last: Callable[[Column], Column]) -> Column:
    """``last`` of a struct that begins as ``first`` and is widened step by step, each worked out once."""

    def widened(names: list[str], v: Column, k: int) -> Column:
        if k == len(steps):
            return last(v)
        new = steps[k](v)
        return _bound(F.struct(*[v[n].alias(n) for n in names], *[c.alias(n) for n, c in new.items()]), lambda w: widened([*names, *new], w, k + 1))

    return _bound(F.struct(*[c.alias(n) for n, c in first.items()]), lambda v: widened(list(first), v, 0))


def _first(rows: Column, test: Callable[[Column], Column]) -> Column:
    """The first row that meets a test, null where none does."""
    return F.get(F.filter(rows, test), F.lit(0))


def _with_next(rows: Column) -> Column:
    """Places, labels and values of ``rows`` with place and line of the row after each; no line where that is a label, or none."""
    return F.zip_with(rows, F.slice(rows, 2, F.size(rows)), lambda a, b: F.struct(a["at"].alias("at"), a["label"].alias("label"), a["value"].alias("value"), b["at"].alias("next_at"), F.when(b["label"] == "", b["line"]).alias("next_line")))


def issue_details(pages: DataFrame, ref: str, text: str, title: str, number: str, published: str | None = None, marked: str | None = None, told: tuple[str, ...] = ("title_at", "end_at", "published_date", "description", "credits")) -> DataFrame:
    """``ref, title_at, end_at, published_date, description, credits`` of pages that show one issue each, or those of them in ``told``.

    Details stand between the line of the issue (``title (year) #number``; else the first that holds the title; else the
    first line) and the first stop line (else the page's end).  A label's value is what follows its colon, else the next line that
    is neither a label nor one to skip: a date for "Published", names for a role where it looks like people.  The
    last "Published" counts; ``published`` stands in where it gives no date.  The description is what follows the last line used by a
    label.  ``marked``, an array of ``role, name``, replaces the text's credits role by role.  Line numbers are from 0.
    """
    roles = F.create_map(*[F.lit(v) for pair in CREDIT_LABELS.items() for v in pair])
    none = F.array().cast("array<struct<role:string,name:string>>")
    key = lambda m: folded(F.concat(m["role"], F.lit("\n"), m["name"]))

    def described(line: Column, at: Column) -> Column:
        def fields(v: Column) -> Column:
            whole, label = v["whole"], v["label"]
            stop = whole.isin(*STOP_LINES)
            for words in STOP_LINES:
                stop = stop | F.startswith(whole, F.lit(f"{words} "))
            skip = whole.isin(*SKIP_LINES, *STOP_LINES, *CREDIT_LABELS) | (v["number"] != "") | F.startswith(v["line"], F.lit("http://")) | F.startswith(v["line"], F.lit("https://"))
            known = F.when(label == "PUBLISHED", label).when(label.isin(*CREDIT_LABELS), F.try_element_at(roles, label)).otherwise("")
            return F.struct(v["at"].alias("at"), v["line"].alias("line"), known.alias("label"), v["value"].alias("value"), stop.alias("stop"), skip.alias("skip"), v["number"].alias("number"))

        colon = F.instr(line, ":")
        value = F.when(colon > 0, F.trim(F.substr(line, colon + 1))).otherwise("")
        return _bound(F.struct(at.alias("at"), line.alias("line"), _label(line).alias("whole"), _label(F.substring_index(line, ":", 1)).alias("label"), value.alias("value"), F.when(F.contains(line, F.lit("#")), F.regexp_extract(line, _ISSUE, 3)).otherwise("").alias("number")), fields)

    def begun(v: Column) -> dict[str, Column]:
        exact = _first(v["rows"], lambda r: (r["number"] != "") & (alnum_number(r["number"]) == v["n"]) & (title_key(F.regexp_extract(r["line"], _ISSUE, 1)) == v["t"]))["at"]
        within = _first(v["rows"], lambda r: (v["t"] != "") & F.contains(title_key(r["line"]), v["t"]))["at"]
        return {"title_at": F.coalesce(exact, within, F.lit(0))}

    def ended(v: Column) -> dict[str, Column]:
        return {"end_at": F.coalesce(_first(v["rows"], lambda r: (r["at"] > v["title_at"]) & r["stop"])["at"], F.size(v["rows"]))}

    def inside(v: Column) -> dict[str, Column]:
        return {"inner": F.filter(v["rows"], lambda r: (r["at"] > v["title_at"]) & (r["at"] < v["end_at"]))}

    def counting(v: Column) -> dict[str, Column]:
        return {"counting": F.filter(v["inner"], lambda r: (r["label"] != "") | ~r["skip"])}

    def used(r: Column) -> Column:
        # Dates are read of "Published" alone, people of the other labels alone, each once.
        dated, inline = r["label"] == "PUBLISHED", r["value"] != ""
        day = F.when(dated, written_date(r["value"]))
        people = F.when(dated | inline, F.lit(False)).otherwise(F.coalesce(people_line(r["next_line"]), F.lit(False)))

        def taken(v: Column) -> Column:
            names = F.when(inline, r["value"]).when(v["people"], r["next_line"]).otherwise("")
            below = F.when(dated, v["day"].isNull()).otherwise(v["people"])
            last = F.when(below & r["next_line"].isNotNull(), r["next_at"]).otherwise(r["at"])
            return F.struct(r["label"].alias("label"), F.coalesce(v["day"], F.when(dated, written_date(r["next_line"]))).alias("day"), names.alias("names"), last.alias("last"))

        return _bound(F.struct(day.alias("day"), people.alias("people")), taken)

    def labels(v: Column) -> dict[str, Column]:
        return {"used": F.transform(F.filter(_with_next(v["counting"]), lambda r: r["label"] != ""), used)}

    def left(v: Column) -> dict[str, Column]:
        return {"last": F.greatest(v["title_at"], F.coalesce(F.array_max(F.transform(v["used"], lambda u: u["last"])), F.lit(0)))}

    def credited(v: Column) -> dict[str, Column]:
        plain = F.flatten(F.transform(F.filter(v["used"], lambda u: u["label"] != "PUBLISHED"), lambda u: F.transform(split_names(u["names"]), lambda w: F.struct(u["label"].alias("role"), w.alias("name")))))
        return {"plain": plain, "taken": F.transform(v["marked"], lambda m: folded(m["role"]))}

    def joined(v: Column) -> dict[str, Column]:
        return {"all": F.concat(v["marked"], F.filter(v["plain"], lambda p: ~F.array_contains(v["taken"], folded(p["role"]))))}

    def description(v: Column) -> Column:
        lines = F.transform(F.filter(v["inner"], lambda r: (r["at"] > v["last"]) & (r["label"] == "") & ~r["skip"]), lambda r: r["line"])
        return F.trim(F.regexp_replace(F.array_join(lines, " "), r"(?i)\b(Read\s+More|See\s+Variant\s+Covers|Digital\s+Issue)\b.*$", ""))

    results = {
        "title_at": lambda v: v["title_at"],
        "end_at": lambda v: v["end_at"],
        "published_date": lambda v: F.coalesce(F.try_element_at(F.filter(v["used"], lambda u: u["label"] == "PUBLISHED"), F.lit(-1))["day"], v["stored"]),
        "description": description,
        "credits": lambda v: F.filter(v["all"], lambda m, i: F.array_position(v["keys"], key(m)) == i + 1),
    }

    def result(v: Column) -> Column:
        return F.struct(*[results[f](v).alias(f) for f in told])

    first = {
        "t": title_key(F.col(title)),
        "n": alnum_number(F.col(number)),
        "stored": F.lit(None).cast("date") if published is None else F.col(published).cast("date"),
        "marked": none if marked is None else F.coalesce(F.col(marked), none),
        "rows": F.transform(lines_of(F.col(text)), described),
    }
    steps = [begun, ended, inside, counting, labels]
    if "description" in told:
        steps.append(left)
    if "credits" in told:
        steps += [credited, joined, lambda v: {"keys": F.transform(v["all"], key)}]
    return pages.select(F.col(ref).alias("ref"), _steps(first, steps, result).alias("d")).select("ref", "d.*")


def page_credits(details: DataFrame) -> DataFrame:
    """``ref, nth, role, name`` of ``issue_details``, numbered from 1 in the order of the page."""
    rows = details.select("ref", F.posexplode_outer("credits").alias("nth", "credit")).where("nth is not null")  # an inner one would filter by size first, reading pages again
    return rows.select("ref", (F.col("nth") + 1).alias("nth"), "credit.role", "credit.name")


# Item pages ----------------------------------------------------------------------------------------------------


def line_key(c: Column) -> Column:
    return F.trim(F.regexp_replace(folded(squeezed(c)), r"[^a-z0-9]+", " "))


def _bare(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, "^#+", ""))


def _numbered(lines: Column) -> Column:
    """Lines with their places, keys and labels: a label is a line of at most 80 characters before a colon at its end."""
    bare = lambda v: F.trim(F.regexp_replace(v, r"^:+|:+$", ""))
    label = lambda v: F.when(v.endswith(":") & (F.length(bare(v)) <= 80), bare(v)).otherwise("")
    return F.transform(lines, lambda v, i: F.struct(i.alias("at"), v.alias("line"), line_key(v).alias("key"), label(v).alias("label")))


def label_blocks(pages: DataFrame, ref: str, text: str, start: str, ends: tuple[str, ...]) -> DataFrame:
    """``ref, block``: map from each label to the lines below it, between a start marker and the first end marker.

    Markers are compared by letters and digits.  A label's lines end at the next label; lines of the site's menu and
    repeats, case aside, are left out; a label met again goes on; one without lines has no entry.  Without a
    start marker the map is empty; without an end marker the block ends with the page.
    """
    marker = lambda v: " ".join("".join(c if c.isascii() and c.isalnum() else " " for c in v.lower()).split())
    none = F.array().cast("array<struct<at:int,line:string,key:string,label:string>>")

    def ended(v: Column) -> dict[str, Column]:
        return {"end_at": F.coalesce(_first(v["rows"], lambda r: (r["at"] > v["start_at"]) & r["key"].isin(*[marker(e) for e in ends]))["at"], F.size(v["rows"]))}

    def marks(v: Column) -> dict[str, Column]:
        return {"marks": F.coalesce(F.filter(v["rows"], lambda r: (r["label"] != "") & (r["at"] > v["start_at"]) & (r["at"] < v["end_at"])), none)}

    def parts(v: Column) -> dict[str, Column]:
        def part(a: Column, b: Column) -> Column:
            below = F.slice(v["rows"], a["at"] + 2, F.coalesce(b["at"], v["end_at"]) - a["at"] - 1)
            return F.struct(a["label"].alias("label"), F.transform(F.filter(below, lambda r: ~r["key"].isin(*ITEM_SKIP_LINES)), lambda r: r["line"]).alias("lines"))

        return {"parts": F.zip_with(v["marks"], F.slice(v["marks"], 2, F.size(v["marks"])), part)}

    def block(v: Column) -> Column:
        names = F.array_distinct(F.transform(v["parts"], lambda p: p["label"]))
        lines = lambda n: F.flatten(F.transform(F.filter(v["parts"], lambda p: p["label"] == n), lambda p: p["lines"]))
        entries = F.transform(names, lambda n: F.struct(n.alias("key"), _bound(lines(n), _distinct).alias("value")))
        return F.map_from_entries(F.filter(entries, lambda e: F.size(e["value"]) > 0))

    first = {"rows": _numbered(lines_of(F.col(text)))}
    steps = [lambda v: {"start_at": _first(v["rows"], lambda r: r["key"] == marker(start))["at"]}, ended, marks, parts]
    return pages.select(F.col(ref).alias("ref"), _steps(first, steps, block).alias("block"))


def _distinct(lines: Column) -> Column:
    """First spelling of each line, in order, where case does not count."""
    return _bound(F.transform(lines, lambda v: folded(v)), lambda keys: F.filter(lines, lambda v, i: F.array_position(keys, folded(v)) == i + 1))


def block_entries(blocks: DataFrame) -> DataFrame:
    """``ref, label, nth, value``: a row for each line of each label."""
    rows = blocks.select("ref", F.explode_outer("block").alias("label", "lines")).where("label is not null")
    return rows.select("ref", "label", F.posexplode("lines").alias("nth", "value")).withColumn("nth", F.col("nth") + 1)


def item_texts(pages: DataFrame, ref: str, text: str) -> DataFrame:
    """``ref, item_type, title, description`` of item pages.

    The type is the first line that is a known one; the title the next line that is not of the site's menu.  The
    description begins after the title's line, where that is a stop line after the first line that reads like it; it ends at
    the next stop line, and repeats of the title are left out.  Without a type all three are empty.
    """

    def titled(v: Column) -> dict[str, Column]:
        return {"kept": _first(v["rows"], lambda r: (r["at"] > v["type_at"]) & ~r["key"].isin(*ITEM_SKIP_LINES))}

    def named(v: Column) -> dict[str, Column]:
        return {"title": F.coalesce(_bare(v["kept"]["line"]), F.lit("")), "title_key": v["kept"]["key"]}

    def begun(v: Column) -> dict[str, Column]:
        alike = F.when(v["title"] != "", _first(v["rows"], lambda r: r["key"] == v["title_key"])["at"])
        return {"begin": F.coalesce(F.when(~v["title_key"].isin(*ITEM_STOP_LINES), v["kept"]["at"]), alike, v["type_at"]) + 1}

    def ended(v: Column) -> dict[str, Column]:
        return {"stop": F.coalesce(_first(v["rows"], lambda r: (r["at"] >= v["begin"]) & r["key"].isin(*ITEM_STOP_LINES))["at"], F.size(v["rows"]))}

    def result(v: Column) -> Column:
        told = F.filter(v["rows"], lambda r: (r["at"] >= v["begin"]) & (r["at"] < v["stop"]) & ~r["key"].isin(*ITEM_SKIP_LINES) & ~F.coalesce(r["key"] == v["title_key"], F.lit(False)))
        kind = F.coalesce(F.upper(F.get(v["rows"], v["type_at"])["line"]), F.lit(""))
        return F.struct(kind.alias("item_type"), v["title"].alias("title"), F.coalesce(F.array_join(F.transform(told, lambda r: r["line"]), " "), F.lit("")).alias("description"))

    first = {"rows": _numbered(lines_of(F.col(text)))}
    steps = [lambda v: {"type_at": _first(v["rows"], lambda r: F.upper(r["line"]).isin(*ITEM_TYPES))["at"]}, titled, named, begun, ended]
    return pages.select(F.col(ref).alias("ref"), _steps(first, steps, result).alias("d")).select("ref", "d.*")


def ongoing_marker(text: Column, year: Column) -> Column:
    """Whether a text holds a start year with an open end, ``(2022 - )``; false where the year is blank."""
    y = squeezed(year)
    pattern = F.concat(F.lit(r"\(\Q"), y, F.lit(r"\E\s*-\s*\)"))
    return (y != "") & F.regexp_like(squeezed(text), F.when(y.contains("\\"), F.lit("$^x")).otherwise(pattern))
