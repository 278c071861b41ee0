"""Records of a source written to what is stored: pages of a list, embedded items, whole details.

Each function gives the next table and what was decided, and is a function of its inputs: a job that died runs again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.functions.source import IMAGE_LINKS, image_structs
from longbox.functions.text import clean, split_roles, usable
from longbox.operators.merge import sync_plan, upsert
from longbox.sources import records

#: Fields of a detail record that must be there, as a list or null, for it to count as complete (fixed values).
DETAIL_FIELDS = ("person_credits", *[f for f, _, _ in records.RELATIONS], "associated_images")


def saved_list(target: DataFrame, source: DataFrame, key: str, fields: list[str], overwrite: bool = True, create_missing: bool = True, follows: dict[str, str] | None = None) -> DataFrame:
    """``upsert`` of a page of a list.  A field in ``follows`` changes only together with the one that it names.

    Without ``create_missing``, new rows are ``skipped``: they are in the plan but not to be written.
    """
    plan = upsert(target, source, key, fields, overwrite, as_stated=True)
    if follows:
        old = target.select(key, F.struct(*fields).alias("_old"))
        plan = plan.join(old, key, "left")
        for field, lead in follows.items():
            alone = (F.col("outcome") == "updated") & F.array_contains("changed_fields", field) & ~F.array_contains("changed_fields", lead)
            plan = plan.withColumn(field, F.when(alone, F.col("_old")[field]).otherwise(F.col(field)))
            plan = plan.withColumn("changed_fields", F.when(alone, F.array_remove("changed_fields", field)).otherwise(F.col("changed_fields")))
        plan = plan.drop("_old").withColumn("outcome", F.when((F.col("outcome") == "updated") & (F.size("changed_fields") == 0), "unchanged").otherwise(F.col("outcome")))
    return plan if create_missing else plan.withColumn("outcome", F.when(F.col("outcome") == "created", "skipped").otherwise(F.col("outcome")))


def written(plan: DataFrame) -> DataFrame:
    """Next rows of a plan of ``saved_list``."""
    return plan.where("outcome <> 'skipped'").drop("changed_fields", "outcome")


def save_counts(plan: DataFrame) -> DataFrame:
    """``counter, n`` of a plan: rows by outcome, and changed values by field.  Counts of several pages add up."""
    counters = F.concat(F.array(F.col("outcome")), F.when(F.col("outcome") == "updated", F.transform("changed_fields", lambda f: F.concat(F.lit("changed "), f))).otherwise(F.array().cast("array<string>")))
    return plan.where("outcome <> 'kept'").select(F.explode(counters).alias("counter")).groupBy("counter").agg(F.count(F.lit(1)).alias("n"))


def added_counts(*counts: DataFrame) -> DataFrame:
    """Counts ``(counter, n)`` of several results as one."""
    rows = counts[0]
    for other in counts[1:]:
        rows = rows.unionByName(other)
    return rows.groupBy("counter").agg(F.sum("n").alias("n"))


def embedded(target: DataFrame, source: DataFrame, unnamed: str) -> DataFrame:
    """Items that other records name, ``(id, name, url, api_url)``: new ones are created, blanks of others filled."""
    name = F.when(clean(F.col("name")) == "", F.concat(F.lit(f"{unnamed} "), F.col("id").cast("string"))).otherwise(clean(F.col("name")))
    return upsert(target, source.select("id", name.alias("name"), clean(F.col("url")).alias("url"), clean(F.col("api_url")).alias("api_url")), "id", ["name", "url", "api_url"], as_stated=True)


def replaced_images(stored: DataFrame, raw: DataFrame) -> DataFrame:
    """Next ``(issue_id, position, caption, original_url, ...)``: where ``raw (id, json)`` states images, they replace all of an issue.

    Positions count from one over what is stated, images without a link included, which are left out.
    """
    state = records.field_state(F.col("json"), "associated_images")
    stated = raw.where(state.isin("null", "list"))
    names = (*IMAGE_LINKS, "image_tags", "caption")
    new = stated.select(F.col("id").alias("issue_id"), F.posexplode(image_structs(F.col("json"))).alias("p", "i"))
    new = new.select("issue_id", (F.col("p") + 1).alias("position"), *[F.col("i")[n].alias(n) for n in names])
    link = F.lit(False)
    for f in IMAGE_LINKS:
        link = link | F.coalesce(usable(F.col(f)), F.lit(False))
    kept = stored.join(stated.select(F.col("id").alias("issue_id")), "issue_id", "left_anti")
    return kept.select("issue_id", "position", *names).unionByName(new.where(link))


def stated_credits(raw: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``(issue_id, person_id, role)`` that ``raw (id, json)`` states, each once, and the ``issue_id`` whose records state credits at all."""
    owners = raw.where(records.field_state(F.col("json"), "person_credits").isin("null", "list"))
    items = F.from_json(F.get_json_object("json", "$.person_credits"), "array<struct<id:string,role:string>>")
    rows = owners.select(F.col("id").alias("issue_id"), F.explode(items).alias("p"))
    rows = rows.select("issue_id", F.col("p.id").try_cast("bigint").alias("person_id"), F.explode(split_roles(F.col("p.role"))).alias("role"))
    return rows.where("person_id is not null").distinct(), owners.select(F.col("id").alias("issue_id")).distinct()


def complete_details(raw: DataFrame, fields: tuple[str, ...] = DETAIL_FIELDS) -> DataFrame:
    """``(id, missing)``: the required fields that a detail record lacks or that are no list."""
    states = records.field_states(F.col("json"), fields)
    return raw.select("id", F.array_compact(F.zip_with(F.array(*[F.lit(f) for f in fields]), states, lambda f, s: F.when(~s.isin("null", "list"), f))).alias("missing"))


def hydrated(issues: DataFrame, raw: DataFrame, fields: list[str], credits: DataFrame, relations: DataFrame, images: DataFrame) -> dict[str, DataFrame]:
    """Whole details of ``raw (id, json, <fields>)`` written to stored ``issues (id, <fields>)`` in one step.

    Details of issues that are not stored are skipped with all they state.  ``credits (issue_id, person_id, role)`` and
    ``relations (issue_id, entity, relation, entity_id)`` are brought to what is stated, where anything is; ``images``
    are replaced.  ``stamps`` says of each which required fields are missing: only without any it counts as hydrated.
    """
    known = raw.join(issues.select("id"), "id", "left_semi")
    desired, owners = stated_credits(known)
    keys = ["issue_id", "entity", "relation", "entity_id"]
    named = records.relations(known, "id").select(*keys)
    return {
        "issues": saved_list(issues, raw, "id", fields, create_missing=False),
        "credits": sync_plan(credits, desired, ["issue_id", "person_id", "role"], ["issue_id"], owners),
        "relations": sync_plan(relations, named, keys, keys[:3], records.stated_relations(known, "id")),
        "images": replaced_images(images, known),
        "stamps": complete_details(known).withColumn("hydrated", F.size("missing") == 0),
    }
