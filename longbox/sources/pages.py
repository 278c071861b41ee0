"""Rendered pages: links, release calendars, series headers, label blocks and credits, as column expressions and joins."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.functions.text import alnum_number, canonical_number, clean, display_date, folded, looks_special_label, number_in_title, slug_title, split_names, squeezed, title_key, url_key

KINDS = ("issue", "series", "collection")
#: Role names that pages spell otherwise (fixed values), and the order in which roles are shown.
ROLE_ALIASES = {"writers": "Writer", "written by": "Writer", "artists": "Artist", "art by": "Artist", "pencilers": "Penciller", "penciler": "Penciller", "pencillers": "Penciller", "inkers": "Inker", "colorists": "Colorist", "colourist": "Colorist", "colourists": "Colorist", "letterers": "Letterer", "cover by": "Cover Artist", "cover": "Cover Artist", "cover artists": "Cover Artist", "editors": "Editor"}
ROLE_ORDER = ("Writer", "Artist", "Penciller", "Inker", "Colorist", "Letterer", "Cover Artist", "Editor")

#: White space within a line.
_WIDE = r"(?U)[\s&&[^\n]]+"


def link_fields(href: Column) -> Column:
    """Struct ``kind, id, slug, title, year, number`` of a link to an issue, series or collection; null for any other."""
    pattern = r"(?i)/comics/(issue|series|collection)/(\d+)/([^/?#]+)"
    kind, slug = F.lower(F.regexp_extract(href, pattern, 1)), F.try_url_decode(F.regexp_extract(href, pattern, 3))
    parts = r"(?i)^(.+)_(\d{4})_([a-z0-9.\-]+)$"
    part = lambda k: F.regexp_extract(F.coalesce(slug, F.lit("")), parts, k)
    fields = F.struct(
        kind.alias("kind"),
        F.regexp_extract(href, pattern, 2).alias("id"),
        slug.alias("slug"),
        F.when(kind == "issue", slug_title(part(1))).otherwise("").alias("title"),
        F.when(kind == "issue", part(2)).otherwise("").alias("year"),
        F.when(kind == "issue", canonical_number(part(3))).otherwise("").alias("number"),
    )
    return F.when(kind != "", fields)


def series_fields(c: Column) -> Column:
    """Struct ``title, start_year, end_year, ongoing`` of ``Title (2022 - )``."""
    text = squeezed(c)
    part = lambda k: F.regexp_extract(text, r"(?i)^(.*?)\s*\(\s*(\d{4})\s*(-|–)?\s*(\d{4}|present)?\s*\)\s*$", k)
    found = part(2) != ""
    end = F.when(F.lower(part(4)) == "present", "").otherwise(part(4))
    return F.struct(F.when(found, part(1)).otherwise(text).alias("title"), part(2).alias("start_year"), end.alias("end_year"), (found & (part(3) != "") & (end == "")).alias("ongoing"))


def status_from_end(found: Column, end: Column) -> Column:
    return F.when(~found, "unknown").when(clean(end) == "", "ongoing").when(F.lower(clean(end)) == "present", "ongoing").otherwise("completed")


def role_name(c: Column) -> Column:
    """Role as it is stored: known spellings by a fixed map, others in title case."""
    bare = F.regexp_replace(squeezed(F.translate(c, "_-", "  ")), r"^[ :;,.]+|[ :;,.]+$", "")
    key = folded(F.trim(F.regexp_replace(bare, r"\s*\([^)]*\)\s*", " ")))
    aliases = F.create_map(*[F.lit(x) for pair in ROLE_ALIASES.items() for x in pair])
    return F.coalesce(F.try_element_at(aliases, key), F.initcap(key))


def role_order(c: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*[F.lit(x) for k, r in enumerate(ROLE_ORDER) for x in (r, 10 * (k + 1))]), c), F.lit(100))


def labelled_lines(pages: DataFrame, ref: str, text: str) -> DataFrame:
    """``ref, position, label, value``: lines of the form ``Label: value``; a line that ends in a colon takes the next one."""
    lines = F.filter(F.transform(F.split(F.regexp_replace(F.coalesce(text, F.lit("")), _WIDE, " "), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    # Each line goes with the next one, and what has no label is left out before lines become rows: a condition on rows would read labels again.
    pairs = F.transform(F.arrays_zip(lines.alias("line"), F.slice(lines, 2, F.greatest(F.size(lines), F.lit(1))).alias("next")), lambda x, i: F.struct(i.alias("position"), x["line"].alias("line"), x["next"].alias("next")))

    def read(x: Column) -> Column:
        own = F.ltrim(F.substr(x["line"], F.instr(x["line"], ":") + 1))
        return F.struct(x["position"].alias("position"), F.substring_index(x["line"], ":", 1).alias("label"), F.when(own == "", F.coalesce(x["next"], F.lit(""))).otherwise(own).alias("value"))

    known = F.transform(F.filter(pairs, lambda x: F.contains(x["line"], F.lit(":")) & F.rlike(x["line"], F.lit(r"^[A-Za-z][A-Za-z /-]{1,30}:"))), read)
    rows = pages.select(F.col(ref).alias("ref"), F.explode(F.filter(known, lambda x: x["value"] != "")).alias("x"))
    return rows.select("ref", "x.position", "x.label", "x.value")


def credits_of(lines: DataFrame) -> DataFrame:
    """``ref, role, name, nth``: names of the lines whose label is a known role; a person once in a role, case aside."""
    # Labels in the map are those that ``role_name`` leaves as they are, case aside.
    known = {**{r.lower(): r for r in ROLE_ORDER}, **ROLE_ALIASES}
    roles = F.create_map(*[F.lit(x) for pair in known.items() for x in pair])
    rows = lines.where(F.lower("label").isin(list(known))).select("ref", "position", F.try_element_at(roles, F.lower("label")).alias("role"), F.posexplode(split_names(F.col("value"))).alias("nth", "name"))
    first = rows.groupBy("ref", "role", folded(F.col("name")).alias("_k")).agg(F.min(F.struct("position", "nth", "name")).alias("f"))
    order = Window.partitionBy("ref", "role").orderBy("f.position", "f.nth")
    return first.select("ref", "role", F.col("f.name").alias("name"), F.row_number().over(order).alias("nth"))


def combined_credits(marked: DataFrame, plain: DataFrame) -> DataFrame:
    """Credits read from marked-up elements replace those read from text, role by role."""
    rest = plain.join(marked.select("ref", "role").distinct(), ["ref", "role"], "left_anti")
    return marked.unionByName(rest)


def missing_details(pages: DataFrame, credits: DataFrame) -> DataFrame:
    """``ref, missing, status``: which of description and writer a page lacks; complete where none."""
    writers = credits.where("role = 'Writer'").select("ref").distinct().withColumn("_w", F.lit(True))
    rows = pages.join(writers, "ref", "left")
    missing = F.filter(F.array(F.when(clean(F.col("description")) == "", "description"), F.when(F.col("_w").isNull(), "writer")), lambda x: x.isNotNull())
    return rows.select("ref", missing.alias("missing"), F.when(F.size(missing) == 0, "complete").otherwise("incomplete").alias("status"))


def calendar_issues(mentions: DataFrame, links: DataFrame) -> DataFrame:
    """``mentions (ref, title, year, number, on_sale)`` with the link of the same title, year and number; the last such link stands."""
    fields = links.withColumn("f", link_fields(F.col("href"))).where("f.kind = 'issue'")
    keyed = fields.groupBy(title_key(F.col("f.title")).alias("t"), F.col("f.year").alias("y"), alnum_number(F.col("f.number")).alias("n")).agg(F.max_by("href", "position").alias("href"))
    rows = mentions.withColumns({"t": title_key(F.col("title")), "y": F.col("year"), "n": alnum_number(F.col("number"))})
    once = rows.groupBy("t", "y", "n", "on_sale").agg(F.min(F.struct("ref", "position", "title", "number")).alias("m"))
    return once.join(keyed, ["t", "y", "n"], "left").select("m.ref", "m.title", F.col("y").alias("year"), "m.number", "on_sale", F.coalesce("href", F.lit("")).alias("detail_url"))


def calendar_collections(links: DataFrame) -> DataFrame:
    """Collection links by page and target, the title the longest label that does not only say "buy" or "read"."""
    rows = links.withColumn("f", link_fields(F.col("href"))).where("f.kind = 'collection'")
    score = F.when(F.lower("label").rlike(r"^(buy|read|more|add|see)\b"), 0).otherwise(1)
    return rows.groupBy("page_id", url_key(F.col("href")).alias("url_key")).agg(F.max(F.struct(score.alias("s"), F.length("label").alias("n"), F.col("label"))).alias("best"), F.min("position").alias("position")).select("page_id", "url_key", F.col("best.label").alias("title"), "position")


def collected_links(wanted: DataFrame, links: DataFrame) -> DataFrame:
    """``wanted (ref, number, series_title)`` with the link ``(ref, position, label, href)`` that each number means: of
    the same series before others, specials last, the first in the page among equals; null where none has the number."""
    number = F.coalesce(F.nullif(number_in_title(F.col("label")), F.lit("")), F.regexp_extract("href", r"-(\d+[A-Za-z]?)/?(?:[?#].*)?$", 1))
    rows = links.select("ref", "position", "href", alnum_number(number).alias("n"), title_key(F.regexp_replace("label", r"\s*#.*$", "")).alias("base"), looks_special_label(F.col("label")).alias("special"))
    asked = wanted.select("ref", "number", alnum_number(F.col("number")).alias("n"), title_key(F.col("series_title")).alias("series"))
    hits = asked.join(rows, ["ref", "n"])
    rank = F.when((F.col("series") != "") & (F.col("base") == F.col("series")), 0).when(F.col("special"), 2).otherwise(1)
    best = hits.groupBy("ref", "number").agg(F.min(F.struct(rank.alias("rank"), "position", "href")).alias("b"))
    return wanted.select("ref", "number").distinct().join(best, ["ref", "number"], "left").select("ref", "number", F.col("b.rank").alias("rank"), F.col("b.href").alias("href"))


def kept_and_skipped(rows: DataFrame, column: str, words: tuple[str, ...]) -> DataFrame:
    """``rows`` with ``skipped``: whether the upper-cased text holds any of the words."""
    out = F.lit(False)
    for w in words:
        out = out | F.contains(F.upper(F.coalesce(column, F.lit(""))), F.lit(w.upper()))
    return rows.withColumn("skipped", out)


def on_sale_date(text: Column) -> Column:
    """Date after "On sale" or "Published" in a text."""
    return display_date(F.regexp_extract(squeezed(text), r"(?i)(?:on\s+sale|published)(?:\s+date)?:?\s*((?:[a-z]+,\s*)?[a-z]+\.?\s+\d{1,2}(?:st|nd|rd|th)?,?\s+\d{4})", 1))
