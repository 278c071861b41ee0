"""Collected-edition texts: which runs and issues a book collects.

Titles, years and numbers depend on what stands before them, so a text is scanned once from left to right.  The scan
is a small function on one text; Spark deals the texts out in Arrow batches.
"""

from __future__ import annotations

import re

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.functions.source import NO_NUMBERS
from longbox.functions.text import MOST_EXPANDED

_START = re.compile(r"(?i)\bcollect(?:s|ing)\b:?\s*")
#: Characters of a run's title (fixed value).
_TITLE = r"[A-Za-z0-9][A-Za-z0-9 .:'’!?&/+,\-]*?"
_NUMBER = r"#\s*(?P<number>[A-Za-z0-9.]+(?:\s*-\s*[A-Za-z0-9.]+)?)"
_ISSUE = re.compile(_NUMBER)
#: A title with its year, or two parts of a title around a number.
_RUN = re.compile(rf"(?P<title>{_TITLE})(?:\s+{_NUMBER}\s+(?P<rest>{_TITLE}))?\s*\((?P<year>\d{{4}})\)")
_NUMBERS = re.compile(rf"(?:[\s,;&.]|and\b|{_NUMBER})*")
#: What ends a collecting text on a page (fixed values).
STOP_MARKS = ("DIGITAL ISSUE", "MORE DETAILS", "EXTENDED CREDITS AND INFO", "EXTENDED CREDITS", "Rating:", "Format:", "FOC Date:", "Price:", "ISBN", "STORIES", "COVER INFORMATION", "MORE ", "RECOMMENDED SERIES", "ABOUT MARVEL", "Terms of Use", "Privacy Policy", "©")
_END = re.compile("|".join(map(re.escape, STOP_MARKS)) + r"|\.(?:\s|$)", re.IGNORECASE)
#: What may stand before a title and is no part of it, and the title of a one-shot that takes its run's before it (fixed values).
LEAD_WORDS = ("collecting", "collects", "plus", "and", "including", "featuring", "with", "material from")
INHERITING = ("annual",)
_LEAD = re.compile(r"(?i)^(?:" + "|".join(w.replace(" ", r"\s+") for w in LEAD_WORDS) + r")\s+")
#: Bytes of an Arrow batch of texts.
BATCH_BYTES = 8 << 20

SCHEMA = "ref long, position int, kind string, title string, year string, expressions array<string>, numbers array<string>"


def expand(expression: str) -> list[str]:
    a, dash, b = expression.replace(" ", "").partition("-")
    if dash and a.isdigit() and b.isdigit() and 0 <= int(b) - int(a) <= MOST_EXPANDED:
        return [str(n) for n in range(int(a), int(b) + 1)]
    return [expression] if expression else []


def _title(text: str) -> str:
    return re.sub(r"\s+", " ", _LEAD.sub("", text.strip())).strip(" ,;:-")


def _folded(title: str) -> str:
    return " ".join(re.findall(r"[a-z0-9]+", title.casefold().replace("&", " and ")))


def _valid(expression: str) -> bool:
    return bool(re.fullmatch(r"[A-Za-z0-9.]+(-[A-Za-z0-9.]+)?", expression)) and expression.casefold() not in NO_NUMBERS


def _expressions(text: str) -> list[str]:
    """Issue expressions after number signs, each once, in order."""
    found = (re.sub(r"\s+", "", m["number"].strip(" #,;:.")) for m in _ISSUE.finditer(text))
    return list(dict.fromkeys(e for e in found if _valid(e)))


def collected(text: str | None) -> list[tuple[str, str, str, list[str], list[str]]]:
    """(kind, title, year, expressions, numbers) of each run or one-shot that a text names: runs, then one-shots, each by title and year.

    A title belongs to the year in brackets after it, and to the numbers between that year and the next title; a number
    inside a title stands in where there are none.  It is a one-shot if it has no number, or if its only number is 0 or 1
    and stands inside the title or after the first title of the text.  A one-shot called "Annual" takes the title of
    the run before it.  Titles that differ in case, signs or spaces are one run of a year; the first spelling stays.
    """
    body = re.sub(r"[–—]", "-", " ".join((text or "").split()))
    start = _START.search(body)
    if not start:
        return []
    body = body[start.end() :]
    if end := _END.search(body):  # page furniture, or the end of the first sentence
        body = body[: end.start()]
    body, at, named = body.strip(" ."), 0, []
    while m := _RUN.search(body, _NUMBERS.match(body, at).end()):
        if title := ": ".join(filter(None, (_title(m["title"]), _title(m["rest"] or "")))):
            named.append((m, title))
        at = m.end()
    runs: dict[tuple[str, str], tuple[str, list[str]]] = {}
    one_shots: dict[tuple[str, str], tuple[str, list[str]]] = {}
    before = ""
    for k, (m, title) in enumerate(named):
        inside = re.sub(r"\s+", "", m["number"] or "").strip("#,;:.")
        expressions = _expressions(body[m.end() : named[k + 1][0].start() if k + 1 < len(named) else len(body)]) or [inside] * bool(inside)
        numbers = list(dict.fromkeys(n for e in expressions for n in expand(e)))
        if expressions and not (len(numbers) == 1 and numbers[0] in ("0", "1") and (inside or k)):
            runs.setdefault((_folded(title), m["year"]), (title, []))[1].extend(expressions)
            before = title
            continue
        if before and _folded(title) in INHERITING:
            title = f"{before} {title}"
        held = one_shots.setdefault((_folded(title), m["year"]), (title, []))[1]
        held += [] if held else expressions[:1]
    out = []
    for kind, items in (("run", runs), ("one_shot", one_shots)):
        for (_, year), (title, expressions) in sorted(items.items(), key=lambda x: x[0]):
            expressions = list(dict.fromkeys(expressions))
            numbers = dict.fromkeys(n for e in expressions for n in expand(e))
            out.append((kind, title, year, expressions, sorted(numbers, key=lambda x: (0, int(x), "") if x.isdigit() else (1, 0, x))))
    return out


def collected_items(rows: DataFrame, ref: str, text: str) -> DataFrame:
    """``ref, position, kind, title, year, expressions, numbers`` of all texts."""

    def run(batches):
        for batch in batches:
            out: list[list] = [[] for _ in range(7)]
            for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                for k, item in enumerate(collected(t)):
                    for column, value in zip(out, (r, k, *item), strict=True):
                        column.append(value)
            kinds = (pa.int64(), pa.int32(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], ["ref", "position", "kind", "title", "year", "expressions", "numbers"])

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.select(F.col(ref).cast("long"), text).mapInArrow(run, SCHEMA)


def dated_mentions(rows: DataFrame, ref: str, text: str) -> DataFrame:
    """``ref, position, title, number, on_sale``: issues named in a page's text with the latest sale date at or before them.

    Markers and issues are found by one expression and split by kind; the date is carried forward over positions.
    """
    from pyspark.sql import Window

    from longbox.functions.text import display_date

    token = r"(?i)on\s+sale:?\s*[a-z]+\s+\d{1,2},\s+\d{4}|[A-Za-z][\w .:'-]*\(\d{4}\)\s*#\w[\w.]*"
    found = rows.select(F.col(ref).alias("ref"), F.posexplode(F.regexp_extract_all(text, F.lit(token), F.lit(0))).alias("position", "token"))
    sale = display_date(F.regexp_extract("token", r"(?i)on\s+sale:?\s*([a-z]+\s+\d{1,2},\s+\d{4})", 1))
    order = Window.partitionBy("ref").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    dated = found.withColumn("on_sale", F.last(sale, ignorenulls=True).over(order))
    title = F.trim(F.regexp_extract("token", r"^(.*)\(\d{4}\)", 1))
    return dated.where(F.contains("token", F.lit("#"))).select("ref", "position", title.alias("title"), F.regexp_extract("token", r"\((\d{4})\)", 1).alias("year"), F.regexp_extract("token", r"#(\w[\w.]*)", 1).alias("number"), "on_sale")
