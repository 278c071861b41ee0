"""Upserts, exact synchronisation and entity resolution: the next state as a table, and what was decided."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.functions.text import alnum_number, title_key, usable


def merged_value(target: Column, source: Column, overwrite: bool) -> Column:
    """A blank source never clears; a blank target is filled; other targets change only where ``overwrite`` says so."""
    take = usable(source) & (~F.coalesce(usable(target), F.lit(False)) | (F.lit(overwrite) & (target != source)))
    return F.when(take, source).otherwise(target)


def upsert(target: DataFrame, source: DataFrame, key: str, fields: list[str], overwrite: bool = False, as_stated: bool = False) -> DataFrame:
    """Next rows with ``outcome`` (created, updated, unchanged or kept) and the names of ``changed_fields``.

    Source rows that repeat a key are reduced to the one that sorts last, so that a batch cannot create a key twice.
    A blank text of a new row is null, or stays blank where ``as_stated``.
    """
    packed = source.where(F.col(key).isNotNull()).groupBy(key).agg(F.max(F.struct(*fields)).alias("s"), F.lit(True).alias("_source"))
    both = target.select(key, F.struct(*fields).alias("t"), F.lit(True).alias("_target")).join(packed, key, "full")
    new = {f: merged_value(F.col("t")[f], F.col("s")[f], overwrite) for f in fields}
    changed = F.filter(F.array(*[F.when(~F.col("t")[f].eqNullSafe(v), F.lit(f)) for f, v in new.items()]), lambda x: x.isNotNull())
    outcome = F.when(F.col("_target").isNull(), "created").when(F.col("_source").isNull(), "kept").when(F.size("changed_fields") > 0, "updated").otherwise("unchanged")
    stated = {f: F.when(F.lit(as_stated) & F.col("_target").isNull(), F.col("s")[f]).otherwise(v) for f, v in new.items()}
    return both.withColumn("changed_fields", F.when(F.col("_source"), changed).otherwise(F.array().cast("array<string>"))).select(key, *[v.alias(f) for f, v in stated.items()], "changed_fields", outcome.alias("outcome"))


def sync_plan(existing: DataFrame, desired: DataFrame, keys: list[str], scope: list[str] | None = None, scopes: DataFrame | None = None) -> DataFrame:
    """``keys, action``: create, delete or keep, so that exactly the desired rows are left.

    Where ``scopes`` is given, only owners in it were stated by the source: rows of others are kept.
    """
    a = existing.select(*keys, F.lit(True).alias("_old")).distinct()
    b = desired.select(*keys, F.lit(True).alias("_new")).distinct()
    both = a.join(b, keys, "full")
    if scopes is not None and scope:
        both = both.join(scopes.select(*scope, F.lit(True).alias("_stated")).distinct(), scope, "left").where("_old or _stated")
        unstated = F.col("_stated").isNull()
    else:
        unstated = F.lit(False)
    return both.select(*keys, F.when(F.col("_old") & (F.col("_new") | unstated), "keep").when(F.col("_old"), "delete").otherwise("create").alias("action"))


def after_sync(existing: DataFrame, plan: DataFrame, keys: list[str]) -> DataFrame:
    return plan.where("action <> 'delete'").select(*keys)


def resolved_runs(catalogue: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted (ref, key, title, year, publisher_id)`` with the run that it means: by source key, by exact title and
    year, or by normalised title and year.  The best tier decides and the smallest id in it wins; publishers must agree.
    A row without a year takes runs of any year.
    """
    runs = catalogue.select(F.col("id").alias("run_id"), "publisher_id", "title", "start_year", "source_key")
    same_year = ~usable(F.col("year")) | (F.col("year") == F.col("start_year"))
    tiers = [
        (1, wanted.where(usable(F.col("key"))).join(runs, [F.col("key") == F.col("source_key"), wanted["publisher_id"] == runs["publisher_id"]])),
        (2, wanted.join(runs, [F.lower(wanted["title"]) == F.lower(runs["title"]), same_year, wanted["publisher_id"] == runs["publisher_id"]])),
        (3, wanted.join(runs, [title_key(wanted["title"]) == title_key(runs["title"]), same_year, wanted["publisher_id"] == runs["publisher_id"]])),
    ]
    hits = None
    for tier, rows in tiers:
        rows = rows.select("ref", F.lit(tier).alias("tier"), "run_id")
        hits = rows if hits is None else hits.unionByName(rows)
    best = hits.groupBy("ref").agg(F.min(F.struct("tier", "run_id")).alias("b"))
    many = hits.groupBy("ref", "tier").agg(F.count_distinct("run_id").alias("n_matches"))
    best = best.select("ref", "b.*").join(many, ["ref", "tier"])
    return wanted.select("ref").join(best, "ref", "left").select("ref", "tier", "run_id", F.coalesce("n_matches", F.lit(0)).alias("n_matches"))


def resolved_issues(issues: DataFrame, wanted: DataFrame) -> DataFrame:
    """``wanted (ref, run_id, number)`` with the issue of the run whose number is equal, else equal when normalised."""
    rows = issues.select(F.col("id").alias("issue_id"), "run_id", "issue_number", alnum_number(F.col("issue_number")).alias("n"))
    asked = wanted.withColumn("n", alnum_number(F.col("number")))
    hits = asked.where("n <> ''").join(rows, ["run_id", "n"]).select("ref", "issue_id", F.when(F.col("number") == F.col("issue_number"), 1).otherwise(2).alias("tier"))
    best = hits.groupBy("ref").agg(F.min(F.struct("tier", "issue_id")).alias("b")).select("ref", "b.*")
    return wanted.select("ref").join(best, "ref", "left")


def lineage_matches(by_source: DataFrame, by_catalogue: DataFrame) -> DataFrame:
    """Pairs ``(source_id, catalogue_id)`` as stored and as matched now: same, new, or in conflict from either side."""
    old, new = by_source.select("source_id", F.col("catalogue_id").alias("stored")), by_catalogue.select("source_id", F.col("catalogue_id").alias("matched"))
    taken = by_source.select(F.col("catalogue_id").alias("matched"), F.col("source_id").alias("holder"))
    rows = new.join(old, "source_id", "left").join(taken, "matched", "left")
    verdict = F.when(F.col("stored") == F.col("matched"), "same").when(F.col("stored").isNotNull(), "conflict: source is linked elsewhere").when(F.col("holder").isNotNull(), "conflict: target is taken").otherwise("new")
    return rows.select("source_id", "matched", verdict.alias("verdict")).groupBy("source_id", "matched").agg(F.min("verdict").alias("verdict"))


def collapsed_lists(rows: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Rows that repeat a key as one, their lists joined without repeats in order of ``position``.

    Repeats go before a key's values meet, so a hot key gathers no more than its result.
    """
    each = rows.select(*keys, "position", F.col(value).alias("_list"), F.posexplode_outer(value).alias("_i", "_v"))
    first = each.groupBy(*keys, "_v", F.col("_i").isNull().alias("_none")).agg(F.min(F.struct("position", "_list", "_i")).alias("_first"))
    listed = F.array_sort(F.collect_list(F.when(~F.col("_none"), F.struct("_first", "_v"))))
    return first.groupBy(*keys).agg(F.transform(listed, lambda x: x["_v"]).alias(value))
