"""Semi-structured records: JSON of the issue and volume service, flattened; rendered pages; JSON sinks."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.text import clean, first_non_empty, plain_html, usable

#: Image fields of a record (fixed values), in order of preference for display.
IMAGE_FIELDS = ("original_url", "super_url", "screen_large_url", "medium_url", "small_url", "thumb_url")
#: Relationship fields of an issue record (fixed values): (field, entity, relation).
RELATIONS = (
    ("character_credits", "character", "credit"),
    ("character_died_in", "character", "died_in"),
    ("concept_credits", "concept", "credit"),
    ("first_appearance_characters", "character", "first_appearance"),
    ("first_appearance_concepts", "concept", "first_appearance"),
    ("first_appearance_locations", "location", "first_appearance"),
    ("first_appearance_objects", "object", "first_appearance"),
    ("first_appearance_storyarcs", "story_arc", "first_appearance"),
    ("first_appearance_teams", "team", "first_appearance"),
    ("location_credits", "location", "credit"),
    ("object_credits", "object", "credit"),
    ("story_arc_credits", "story_arc", "credit"),
    ("team_credits", "team", "credit"),
    ("team_disbanded_in", "team", "disbanded_in"),
)


def _text(c: Column, path: str) -> Column:
    return clean(F.get_json_object(c, f"$.{path}"))


def issue_records(raw: DataFrame, column: str = "json") -> DataFrame:
    """Columns of issue records; blanks are empty, dates that do not parse are null."""
    c = F.col(column)
    day = lambda f: F.try_to_date(F.substring(F.get_json_object(c, f"$.{f}"), 1, 10), "yyyy-MM-dd")
    return raw.select(
        F.get_json_object(c, "$.id").try_cast("bigint").alias("source_id"),
        _text(c, "name").alias("title"),
        _text(c, "issue_number").alias("issue_number"),
        day("store_date").alias("store_date"),
        day("cover_date").alias("cover_date"),
        F.get_json_object(c, "$.volume.id").try_cast("bigint").alias("volume_id"),
        _text(c, "volume.name").alias("volume_name"),
        plain_html(F.get_json_object(c, "$.description")).alias("description"),
        first_non_empty(*[F.get_json_object(c, f"$.image.{f}") for f in IMAGE_FIELDS]).alias("display_image_url"),
    )


def volume_records(raw: DataFrame, column: str = "json") -> DataFrame:
    c = F.col(column)
    identity = F.get_json_object(c, "$.id").try_cast("bigint")
    name = _text(c, "name")
    return raw.select(
        identity.alias("source_id"),
        F.when(name == "", F.concat(F.lit("Unknown Comic Vine Volume "), identity.cast("string"))).otherwise(name).alias("name"),
        _text(c, "start_year").alias("start_year"),
        F.get_json_object(c, "$.count_of_issues").try_cast("int").alias("issue_count"),
        _text(c, "publisher.name").alias("publisher"),
        _text(c, "first_issue.issue_number").alias("first_issue_number"),
        _text(c, "last_issue.issue_number").alias("last_issue_number"),
    )


def field_state(json: Column, name: str) -> Column:
    """``absent``, ``null``, ``list`` or ``invalid``: what a field says about a relationship."""
    return F.get(field_states(json, (name,)), F.lit(0))


def field_states(json: Column, names: tuple[str, ...]) -> Column:
    """``field_state`` of each of ``names``, as an array; a record is parsed once for all of them."""
    parsed = F.array(F.struct(F.try_parse_json(json).alias("v"), F.json_object_keys(json).alias("keys")))
    return F.get(F.transform(parsed, lambda p: F.array(*[_state(p["v"], p["keys"], f) for f in names])), F.lit(0))


def _state(v: Column, keys: Column, name: str) -> Column:
    kind = F.schema_of_variant(F.try_variant_get(v, f"$.{name}", "variant"))
    return F.when(~F.array_contains(keys, name), "absent").when(F.is_variant_null(F.try_variant_get(v, f"$.{name}", "variant")), "null").when(F.startswith(kind, F.lit("ARRAY")), "list").otherwise("invalid")


def relations(raw: DataFrame, id_column: str = "source_id", column: str = "json") -> DataFrame:
    """``(issue_id, entity, relation, entity_id, name)`` of all relationship lists of issue records, a row once."""
    one, names = "array<struct<id:bigint,name:string>>", [f for f, _, _ in RELATIONS]
    # Lists are numbered until rows are single: a number is less to move and to compare than two names.
    texts = raw.select(F.col(id_column).alias("issue_id"), F.json_tuple(column, *names).alias(*[f"_{k}" for k in range(len(names))]))
    lists = F.array(*[F.when(F.length(f"_{k}") > 2, F.array_distinct(F.from_json(f"_{k}", one))) for k in range(len(names))])
    rows = texts.select("issue_id", F.posexplode(lists).alias("k", "items")).select("issue_id", "k", F.explode("items").alias("i"))
    rows = rows.where("i.id is not null").groupBy("issue_id", "k", F.col("i.id").alias("entity_id")).agg(F.max("i.name").alias("name"))
    entity, relation = (F.get(F.array(*[F.lit(r[n]) for r in RELATIONS]), F.col("k")) for n in (1, 2))
    return rows.select("issue_id", entity.alias("entity"), relation.alias("relation"), "entity_id", "name")


def stated_relations(raw: DataFrame, id_column: str = "source_id", column: str = "json") -> DataFrame:
    """``(issue_id, entity, relation)`` that a record states, empty or not: only these may lose rows in a sync."""
    states = F.posexplode(field_states(F.col(column), tuple(f for f, _, _ in RELATIONS))).alias("k", "state")
    rows = raw.select(F.col(id_column).alias("issue_id"), states).where("state in ('null', 'list')").select("issue_id", "k").distinct()
    entity, relation = (F.get(F.array(*[F.lit(r[n]) for r in RELATIONS]), F.col("k")) for n in (1, 2))
    return rows.select("issue_id", entity.alias("entity"), relation.alias("relation"))


def page_links(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """``(page_id, position, href, label)`` of the links of rendered pages."""
    found = F.regexp_extract_all(html, F.lit(r"(?is)<a\s[^>]*href=[\"'][^\"']*[\"'][^>]*>.*?</a>"), F.lit(0))
    rows = pages.select(id_column, F.posexplode(found).alias("position", "a"))
    return rows.select(id_column, "position", F.regexp_extract("a", r"(?is)href=[\"']([^\"']*)[\"']", 1).alias("href"), plain_html(F.regexp_extract("a", r"(?is)^<a\s[^>]*>(.*)</a>$", 1)).alias("label"))


def page_text(pages: DataFrame, id_column: str = "page_id", html: str = "html") -> DataFrame:
    """``(page_id, title, text)`` of rendered pages, scripts and styles left out."""
    body = F.regexp_replace(html, r"(?is)<(script|style|title)\b[^>]*>.*?</\1>|<!--.*?-->", " ")
    return pages.select(id_column, plain_html(F.regexp_extract(html, r"(?is)<title[^>]*>(.*?)</title>", 1)).alias("title"), plain_html(body).alias("text"))


def usable_images(images: DataFrame) -> DataFrame:
    """Images with any usable link, their 1-based positions kept with gaps."""
    any_url = F.lit(False)
    for f in IMAGE_FIELDS:
        any_url = any_url | F.coalesce(usable(F.col(f)), F.lit(False))
    return images.where(any_url)


def write_json(rows: DataFrame, path: str) -> None:
    """One JSON object a line, fields in order of their names."""
    rows.select(*sorted(rows.columns)).write.mode("overwrite").json(path)
