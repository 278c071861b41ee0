"""Scalar functions on titles, numbers, names and links, as column expressions: no Python runs per row."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

NBSP = " "
#: Longest range of issue numbers that is written out.
MOST_EXPANDED = 300
#: Numbers that one mention of a range in a text may have.
MOST_MENTIONED = 100_000


def clean(c: Column) -> Column:
    """Text without outer white space; null as empty."""
    return F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)^\s+|\s+$", "")


def squeezed(c: Column) -> Column:
    """Text with every run of white space as one space, none outside."""
    return F.trim(F.regexp_replace(F.coalesce(c.cast("string"), F.lit("")), r"(?U)\s(?:\s+|(?<! ))", " "))  # single spaces stay untouched


def lines_kept(c: Column) -> Column:
    """Text with no-break spaces as spaces and runs of spaces and tabs squeezed; line ends stay."""
    return F.trim(F.regexp_replace(F.replace(F.coalesce(c, F.lit("")), F.lit(NBSP), F.lit(" ")), r"[ \t]+", " "))


def none_if_blank(c: Column) -> Column:
    return F.nullif(clean(c), F.lit(""))


def first_non_empty(*columns: Column) -> Column:
    return F.coalesce(*[none_if_blank(c) for c in columns], F.lit(""))


def usable(c: Column) -> Column:
    return c.isNotNull() & (c.cast("string") != "")


def lenient_int(c: Column) -> Column:
    """Integer, or null for blank or anything else."""
    return F.expr("try_cast(x as bigint)") if isinstance(c, str) else F.trim(c).try_cast("bigint")


def non_negative_int(c: Column) -> Column:
    return F.greatest(F.coalesce(lenient_int(c), F.lit(0)), F.lit(0))


def folded(c: Column) -> Column:
    """Lower case for comparison, with sharp s spelled out."""
    return F.replace(F.lower(c), F.lit("ß"), F.lit("ss"))


ENTITIES = (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"), ("&amp;", "&"))


def plain_html(c: Column) -> Column:
    """Text without tags, the common entities resolved, white space squeezed."""
    out = F.regexp_replace(F.coalesce(c, F.lit("")), r"<[^>]*>", " ")
    for entity, char in ENTITIES:
        out = F.replace(out, F.lit(entity), F.lit(char))
    return squeezed(out)


def title_key(c: Column) -> Column:
    """Key to compare titles by: ampersands spelled out, letters and digits lower-cased, all else one space."""
    return F.trim(F.regexp_replace(F.replace(folded(F.coalesce(c.cast("string"), F.lit(""))), F.lit("&"), F.lit(" and ")), r"[^a-z0-9](?:[^a-z0-9]+|(?<! ))", " "))


def title_key_or_id(c: Column, fallback: Column) -> Column:
    key = F.trim(F.regexp_replace(folded(plain_html(c)), r"[^a-z0-9]+", " "))
    return F.when(key == "", F.concat(F.lit("comic-vine-"), fallback.cast("string"))).otherwise(key)


def yearless_title_key(c: Column) -> Column:
    return title_key(F.regexp_replace(clean(c), r"\(\d{4}\s*-?\s*(\d{4})?\s*\)", ""))


def numbered_key(c: Column) -> Column:
    """As ``title_key``, with number signs kept."""
    return F.trim(F.regexp_replace(folded(squeezed(c)), r"[^a-z0-9#]+", " "))


def identifier(c: Column) -> Column:
    return F.regexp_replace(folded(clean(c)), r"[^a-z0-9]+", "")


# Issue numbers -------------------------------------------------------------------------------------------------


def bare_number(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(clean(c), r"^#+", ""), r"\s+", "")


def alnum_number(c: Column) -> Column:
    """Number for matching: lead words and signs dropped, letters and digits only."""
    return F.regexp_replace(F.regexp_replace(folded(clean(c)), r"^\s*(issue|no\.?)\s*", ""), r"[^a-z0-9]+", "")


def canonical_number(c: Column) -> Column:
    return F.upper(F.trim(F.regexp_replace(clean(c), r"(?i)^(issue|no\.?|#)\s*#?\s*", "")))


def integer_number(c: Column) -> Column:
    text = bare_number(c)
    return F.when(text.rlike(r"^\d+$"), text.try_cast("bigint"))


def standard_number(c: Column) -> Column:
    """Whole number of ``12``, ``#12``, ``12a`` or ``12.MU``; null for any other shape."""
    return F.nullif(F.regexp_extract(clean(c), r"(?i)^#?\s*(\d+)(?:[a-z]|\.[a-z0-9]+)?$", 1), F.lit("")).try_cast("bigint")


def number_in_title(c: Column) -> Column:
    """``12a`` of ``Title #12a``; 0 for a bare sign at the end; empty where there is none."""
    text = clean(c)
    found = F.upper(F.regexp_extract(text, r"#\s*([0-9]+[A-Za-z]?)", 1))
    return F.when(found != "", found).when(text.rlike(r"#\s*$"), "0").otherwise("")


NUMBER = r"^\s*#?\s*(-?\d+(?:\.\d+)?)\s*(.*)$"


def natural_number_key(c: Column) -> Column:
    """Struct to sort numbers by: numeric ones first by value, then what follows, then the text."""
    text = F.trim(F.coalesce(c, F.lit("")))
    value = F.nullif(F.regexp_extract(text, NUMBER, 1), F.lit("")).try_cast("double")
    rest = F.lower(F.trim(F.regexp_extract(text, NUMBER, 2)))
    return F.struct(F.when(value.isNull(), 1).otherwise(0).alias("kind"), F.coalesce(value, F.lit(0.0)).alias("value"), F.when(value.isNull(), "").otherwise(rest).alias("rest"), F.lower(text).alias("text"))


def expanded_range(c: Column) -> Column:
    """Numbers of ``a-b``; anything but an ascending range of at most 300 digits-only numbers stays as written."""
    text = F.regexp_replace(F.regexp_replace(clean(c), r"[–—]", "-"), r"^#|\s+", "")
    a, b = F.regexp_extract(text, r"^(\d+)-(\d+)$", 1).try_cast("bigint"), F.regexp_extract(text, r"^(\d+)-(\d+)$", 2).try_cast("bigint")
    good = a.isNotNull() & b.isNotNull() & (a <= b) & (b - a <= MOST_EXPANDED)
    return F.when(text == "", F.array().cast("array<string>")).when(good, F.transform(F.sequence(F.when(good, a).otherwise(0), F.when(good, b).otherwise(0)), lambda x: x.cast("string"))).otherwise(F.array(text))


def expanded_mentions(c: Column) -> Column:
    """All numbers of ``#a to #b`` mentions in a text, up or down, each once; single numbers are not ranges.

    A mention of more than ``MOST_MENTIONED`` numbers, or of numbers beyond a long, is no range and is left out.
    """
    pattern = r"(?i)#\s*(\d+)\s*(?:-|–|—|to|through)\s*#?\s*(\d+)"
    found = F.regexp_extract_all(F.coalesce(c, F.lit("")), F.lit(pattern), F.lit(0))
    ends = F.transform(found, lambda m: F.transform(F.regexp_extract_all(m, F.lit(r"\d+"), F.lit(0)), lambda d: d.try_cast("bigint")))
    able = F.filter(ends, lambda e: e[0].isNotNull() & e[1].isNotNull() & (F.abs(e[0] / 2 - e[1] / 2) < MOST_MENTIONED / 2))
    return F.array_distinct(F.flatten(F.transform(able, lambda e: F.sequence(e[0], e[1]))))


def compacted(numbers: Column, distinct: bool = True) -> Column:
    """``1,2,3,5`` as ``1-3,5``: runs of whole numbers as ranges; a list that holds any other value is joined as it is."""
    whole = F.forall(numbers, lambda x: x.rlike(r"^\d+$"))
    values = F.transform(numbers, lambda x: x.try_cast("bigint"))
    values = F.array_sort(F.array_distinct(values) if distinct else values)
    empty = F.array().cast("array<struct<a:bigint,b:bigint>>")
    last = lambda acc: F.element_at(acc, -1)
    joined = F.aggregate(
        values,
        empty,
        lambda acc, x: F.when((F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1))["b"] == x - 1), F.concat(F.slice(acc, 1, F.greatest(F.size(acc) - 1, F.lit(0))), F.array(F.struct(F.try_element_at(acc, F.lit(-1))["a"].alias("a"), x.alias("b"))))).otherwise(F.concat(acc, F.array(F.struct(x.alias("a"), x.alias("b"))))),
    )
    del last
    text = F.array_join(F.transform(joined, lambda r: F.when(r["a"] == r["b"], r["a"].cast("string")).otherwise(F.concat(r["a"].cast("string"), F.lit("-"), r["b"].cast("string")))), ",")
    return F.when(whole, text).otherwise(F.array_join(numbers, ","))


def volume_number_in(c: Column) -> Column:
    return F.regexp_extract(clean(c), r"(?i)\bVOL(?:UME)?\.?\s*(\d+)", 1)


MARKED_VOLUME = r"(?i)^\s*(volume|vol\.?)(\s|\d|\.|$)"
#: Marks of special issues in numbers, and in labels of links (fixed values).
SPECIAL_MARKS = (" annual ", " annual #", " noir edition ", " noir edition #", " ark m ", " ark m #", ": ark ", ": ark m", " special ", " special #")
SPECIAL_LABEL_MARKS = (" annual ", " annual #", " noir edition ", " noir edition #", ": ark ", ": ark m", " special ", " special #", " director's cut", " directors cut", " deluxe edition", ": uncovered ", ": uncovered #")


def _holds(text: Column, marks: tuple[str, ...]) -> Column:
    out = F.lit(False)
    for mark in marks:
        out = out | F.contains(text, F.lit(mark))
    return out


def looks_special(c: Column) -> Column:
    """Whether a number or title, set between spaces, holds the mark of a special issue."""
    return _holds(F.concat(F.lit(" "), folded(clean(c)), F.lit(" ")), SPECIAL_MARKS)


def looks_special_label(c: Column) -> Column:
    """Whether a link's label, as it stands, holds the mark of a special issue."""
    return _holds(folded(clean(c)), SPECIAL_LABEL_MARKS)


def mainline_first(c: Column) -> Column:
    """Whether a number is 1, with or without "issue", "no." and "#" before it, and not that of a special."""
    bare = F.regexp_replace(F.regexp_replace(clean(c), r"(?i)^\s*issue\s*", ""), r"(?i)^\s*no\.?\s*", "")
    return ~looks_special(c) & (F.regexp_replace(bare, r"^[#\s]*(?=.*$)", "") == "1")


# Dates ---------------------------------------------------------------------------------------------------------


def display_date(c: Column) -> Column:
    """Date of ``June 5, 2024``, ``Wednesday, June 5th, 2024``, ``06/05/2024`` or ``2024-06-05``; null for any other text."""
    text = F.regexp_replace(squeezed(c), r"(?i)^(mon|tues|wednes|thurs|fri|satur|sun)day,\s*", "")
    text = F.regexp_replace(text, r"(\d)(st|nd|rd|th)\b", "$1")
    return F.coalesce(F.try_to_date(F.when(text.rlike(r"^[A-Z][a-z]+ \d{1,2}, \d{4}$"), text), "MMMM d, yyyy"), F.try_to_date(F.when(text.rlike(r"^[A-Z][a-z]{2} \d{1,2}, \d{4}$"), text), "MMM d, yyyy"), F.try_to_date(F.when(text.rlike(r"^\d{2}/\d{2}/\d{4}$"), text), "MM/dd/yyyy"), F.try_to_date(F.when(text.rlike(r"^\d{4}-\d{2}-\d{2}"), F.substring(text, 1, 10)), "yyyy-MM-dd"))


def date_or_unknown(c: Column) -> Column:
    return F.coalesce(F.date_format(c, "yyyy-MM-dd"), F.lit("Unknown"))


def wednesdays(start: Column, end: Column) -> Column:
    """Wednesdays of a range of dates, the newest first."""
    return F.reverse(F.filter(F.sequence(start, end), lambda d: F.weekday(d) == 2))


# Names and roles -----------------------------------------------------------------------------------------------


def split_roles(c: Column) -> Column:
    parts = F.transform(F.split(F.coalesce(c, F.lit("")), ","), lambda x: F.lower(F.trim(x)))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def glued_names(c: Column) -> Column:
    return c.rlike(r"[a-z][A-Z][a-z]") & ~c.rlike(r"[,;&]")


def split_names(c: Column) -> Column:
    """Names of a line: cut at commas, semicolons, ampersands and "and", and where two names are run together."""
    text = F.regexp_replace(squeezed(c), r"(?=[A-Z][a-z])(?<=[a-z])(?<!\bMc)(?<!\bMac)(?<!\bDe)(?<!\bLe)(?<!\bLa)(?<!\bVan)(?<!\bDi)", ";")
    parts = F.transform(F.split(text, r"\s*[,;&]\s*|\s+and\s+"), lambda x: F.trim(x))
    return F.array_distinct(F.filter(parts, lambda x: x != ""))


def distinct_folded(values: Column) -> Column:
    """First spelling of each value, in order, where case does not count."""
    cleaned = F.filter(F.transform(values, lambda v: squeezed(v)), lambda v: v != "")
    lowered = F.transform(cleaned, lambda v: folded(v))
    return F.filter(cleaned, lambda v, i: F.array_position(lowered, folded(v)) == i + 1)


# Links ---------------------------------------------------------------------------------------------------------


def url_path(c: Column) -> Column:
    return F.regexp_extract(clean(c), r"^(?:[a-zA-Z][a-zA-Z0-9+.-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def url_key(c: Column) -> Column:
    """Key to compare links by: no scheme, query, fragment or last slash, lower case."""
    return F.lower(F.regexp_replace(F.regexp_replace(F.regexp_replace(clean(c), r"[?#].*$", ""), r"^[a-zA-Z]+://(www\.)?", ""), r"/+$", ""))


def typed_id(c: Column) -> Column:
    return F.regexp_extract(F.coalesce(c, F.lit("")), r"/\d{4}-(\d+)/?", 1).try_cast("bigint")


def slug_title(c: Column) -> Column:
    return F.initcap(F.regexp_replace(c, r"[-_]+", " "))


def query_url(base: str, **params: Column) -> Column:
    """``base`` with the parameters that are neither null nor empty."""
    pairs = F.filter(F.array(*[F.when(usable(v), F.concat(F.lit(f"{k}="), F.url_encode(v.cast("string")))) for k, v in params.items()]), lambda x: x.isNotNull())
    return F.when(F.size(pairs) > 0, F.concat(F.lit(f"{base}?"), F.array_join(pairs, "&"))).otherwise(base)


def shortened(c: Column, most: int) -> Column:
    return F.when(F.length(c) > most, F.concat(F.rtrim(F.substring(c, 1, most - 3)), F.lit("..."))).otherwise(c)


def preview(values: Column, most: int = 40) -> Column:
    text = F.array_join(F.slice(values, 1, most), ", ")
    return F.when(F.size(values) > most, F.concat(text, F.lit(", … +"), (F.size(values) - most).cast("string"), F.lit(" more"))).otherwise(text)


def percent(part: Column, whole: Column) -> Column:
    """Share in percent with one decimal, 0 where there is nothing."""
    return F.when(whole == 0, F.lit(0.0)).otherwise(F.bround(part * 100.0 / whole, 1))
