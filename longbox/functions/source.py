"""Scalar functions on what sources say: keys of issues, links, names of people, images and fields of records."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from longbox.functions.text import clean, first_non_empty, folded, looks_special_label, none_if_blank, squeezed

#: Longest issue key that is stored.
MOST_KEY = 50
#: Words that are no issue number, names that are no person, and fields that may hold a credit's count (fixed values).
NO_NUMBERS = ("and", "or", "the", "a", "an", "of", "from", "material")
NO_NAMES = ("none", "n/a", "unknown", "writer", "writers", "artist", "artists", "penciller", "pencillers", "inker", "inkers", "colorist", "colorists", "letterer", "letterers", "cover artist", "cover artists", "editor", "editors")
COUNT_FIELDS = ("count", "credit_count", "issue_count", "count_of_issues", "count_of_issue_appearances")
#: Links of an image record (fixed values).
IMAGE_LINKS = ("icon_url", "medium_url", "screen_url", "screen_large_url", "small_url", "super_url", "thumb_url", "tiny_url", "original_url")
#: Order in which what was read is written (fixed values); anything else comes last.
WRITE_ORDER = {"issue": 10, "collected_volume": 20, "standalone_graphic_novel_or_one_shot": 30}


def labelled_title(title: Column, year: Column) -> Column:
    """``Title (year)``; the title alone where the year is blank."""
    return F.when(clean(year) == "", clean(title)).otherwise(F.concat(clean(title), F.lit(" ("), clean(year), F.lit(")")))


def choice_label(choices: dict[str, str], value: Column) -> Column:
    """A choice's label; the value itself where it is none."""
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in choices.items() for x in pair]), value), value)


def _bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: written out for each use, nested patterns outgrow what Spark compiles."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def without_marker(label: Column, number: Column) -> Column:
    """A label without the first ``#number``; a longer number that starts alike is another one."""
    wanted = clean(number)
    escaped = F.regexp_replace(wanted, r"([^A-Za-z0-9])", r"\\$1")
    pattern = F.when(wanted != "", F.concat(F.lit(r"(?is)^(.*?)#\s*"), escaped, F.lit(r"(?![A-Za-z0-9_])(.*)$")))

    def cut(v: Column) -> Column:
        part = lambda k: F.call_function("regexp_extract", v["text"], v["pattern"], F.lit(k))
        return F.when(F.rlike(v["text"], v["pattern"]), F.concat(part(1), part(2))).otherwise(v["text"])

    return _bound(F.struct(squeezed(label).alias("text"), pattern.alias("pattern")), cut)


def issue_key(title: Column, number: Column) -> Column:
    """Key of an issue in its series: the number, or the whole label with it for specials."""
    def bare(v: Column) -> Column:
        return F.when((v["wanted"] == "0") & v["text"].rlike(r"#\s*$"), F.regexp_replace(v["text"], r"#\s*$", "")).otherwise(without_marker(v["text"], v["wanted"]))

    def keyed(v: Column) -> Column:
        base = F.regexp_replace(squeezed(F.regexp_replace(bare(v), r"\(\d{4}\s*-?\s*\)", "")), r"^[ :\-]+|[ :\-]+$", "")
        special = (v["text"] != "") & (v["wanted"] != "") & looks_special_label(v["text"])
        return F.when(special, _bound(base, lambda w: F.when(w != "", F.concat(w, F.lit(" #"), v["wanted"])).otherwise(v["wanted"]))).otherwise(v["wanted"])

    return _bound(F.struct(clean(title).alias("text"), clean(number).alias("wanted")), keyed)


def slug(c: Column) -> Column:
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(F.lower(c), r"[^\w\s-]", ""), r"[-\s]+", "-"), r"^[-_]+|[-_]+$", "")


def short_key(key: Column, number: Column) -> Column:
    """A key of at most ``MOST_KEY`` characters: its words as a slug, and its number in full."""
    def shortened(v: Column) -> Column:
        text, mark = v["text"], v["mark"]
        cut = F.when(F.endswith(F.lower(text), F.lower(mark)), F.left(text, F.length(text) - F.length(mark))).otherwise(text)
        words = slug(F.regexp_replace(clean(cut), r"^[ #:,\-]+|[ #:,\-]+$", ""))
        base = _bound(words, lambda w: F.coalesce(F.nullif(w, F.lit("")), F.lit("special")))
        short = F.concat(F.regexp_replace(F.left(base, F.lit(MOST_KEY) - F.length(mark)), r"^-+|-+$", ""), mark)
        return F.when(mark == "#", F.left(text, F.lit(MOST_KEY))).when(F.length(mark) >= MOST_KEY, F.left(F.substr(mark, F.lit(2)), F.lit(MOST_KEY))).otherwise(short)

    return _bound(F.struct(clean(key).alias("text"), F.concat(F.lit("#"), clean(number)).alias("mark")), shortened)


def valid_expression(c: Column) -> Column:
    """Whether a text may be an issue number or a range of two."""
    return F.coalesce(c, F.lit("")).rlike(r"^[A-Za-z0-9.]+(-[A-Za-z0-9.]+)?$") & ~folded(F.coalesce(c, F.lit(""))).isin(list(NO_NUMBERS))


def end_numbers(numbers: Column) -> Column:
    """Struct ``first, last`` of a list: the least and greatest where all are whole numbers, else those at its ends; blank for none."""
    whole = F.forall(numbers, lambda x: x.rlike(r"^\d+$"))
    values = F.transform(numbers, lambda x: x.try_cast("bigint"))
    at = lambda i: F.try_element_at(numbers, F.lit(i))
    first = F.when(whole, F.array_min(values).cast("string")).otherwise(at(1))
    last = F.when(whole, F.array_max(values).cast("string")).otherwise(at(-1))
    return F.struct(F.coalesce(first, F.lit("")).alias("first"), F.coalesce(last, F.lit("")).alias("last"))


def url_variants(c: Column) -> Column:
    """Ways in which a link may be stored: with and without its query and the slashes at its end."""
    text = clean(c)
    bare = F.regexp_extract(text, r"^[^?]*", 0)
    each = F.array(text, F.regexp_replace(text, "/+$", ""), bare, F.regexp_replace(bare, "/+$", ""))
    return F.array_distinct(F.filter(each, lambda x: x != ""))


def source_time(c: Column) -> Column:
    """Time of a source, ``yyyy-MM-dd HH:mm:ss`` with or without a ``T``, or of a day alone; null for anything else."""
    text = F.replace(F.left(clean(c), F.lit(19)), F.lit("T"), F.lit(" "))
    return F.coalesce(F.try_to_timestamp(text, F.lit("yyyy-MM-dd HH:mm:ss")), F.try_to_timestamp(text, F.lit("yyyy-MM-dd")))


def day_in(zone: str, utc: Column) -> Column:
    """Calendar day in a time zone of a time in UTC."""
    return F.to_date(F.from_utc_timestamp(utc, zone))


def credit_name(c: Column) -> Column:
    """Name of a person without "by", bullets and stops around it; blank for role names and the like."""
    text = F.regexp_replace(F.regexp_replace(squeezed(c), r"(?i)^by\s+", ""), r"^[•\-*]+", "")
    text = squeezed(F.regexp_replace(text, r"^[ :;,.]+|[ :;,.]+$", ""))
    return F.when(folded(text).isin(list(NO_NAMES)), "").otherwise(text)


def credit_count(json: Column) -> Column:
    """The first count that a credit states, under any of the names it has."""
    return F.coalesce(*[F.trim(F.get_json_object(json, f"$.{f}")).try_cast("bigint") for f in COUNT_FIELDS])


def image_links(json: Column, path: str, prefix: str) -> list[Column]:
    """Columns of an image record: its links, and its tags, named with a prefix."""
    return [clean(F.get_json_object(json, f"$.{path}.{f}")).alias(f"{prefix}_{f}") for f in IMAGE_LINKS] + [clean(F.get_json_object(json, f"$.{path}.image_tags")).alias(f"{prefix}_tags")]


def image_structs(json: Column, path: str = "associated_images") -> Column:
    """Images of a record's list: links, tags and a caption that may stand under other names; null where the list is absent."""
    names = (*IMAGE_LINKS, "image_tags", "caption", "name", "title")
    items = F.from_json(F.get_json_object(json, f"$.{path}"), "array<struct<" + ",".join(f"{n}:string" for n in names) + ">>")
    return F.transform(items, lambda x: F.struct(*[clean(x[f]).alias(f) for f in (*IMAGE_LINKS, "image_tags")], first_non_empty(x["caption"], x["name"], x["title"]).alias("caption")))


def write_priority(classification: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for pair in WRITE_ORDER.items() for x in pair]), classification), F.lit(90))


def id_list(text: Column, most: int = 100) -> Column:
    """Whole numbers of a list written with commas or spaces, each once; null if one is none or there are more than ``most``."""
    parts = F.filter(F.split(F.coalesce(text, F.lit("")), r"[,\s]+"), lambda x: x != "")
    ids = F.array_distinct(F.transform(parts, lambda x: x.try_cast("bigint")))
    return F.when(F.forall(ids, lambda x: F.coalesce(x > 0, F.lit(False))) & (F.size(ids) <= most), ids)


def run_status(series: Column, title: Column, ongoing: Column, end_year: Column) -> Column:
    """Status of a run by its series' name, a mark on the page, an issue's title and the end year, in this order."""
    named = r"^(.*?)\s*\(\s*(\d{4})\s*(-|–|—)?\s*(\d{4})?\s*\)"
    raw, text = clean(series), clean(title)
    part = lambda c, k: F.regexp_extract(c, named, k)
    open_end = lambda c: (part(c, 3) != "") & (part(c, 4) == "")
    by_title = text.rlike(named) & (open_end(text) | (part(text, 4) != ""))
    return (
        F.when(raw.rlike(named + r"\s*$"), F.when(open_end(raw), "ongoing").otherwise("completed"))
        .when(F.coalesce(ongoing, F.lit(False)), "ongoing")
        .when(by_title, F.when(open_end(text), "ongoing").otherwise("completed"))
        .when(none_if_blank(end_year).isNotNull(), "completed")
        .otherwise("unknown")
    )
