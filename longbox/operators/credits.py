"""Credits: first credit of each person in a role, joined names, nested groups."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from longbox.sources.tables import Catalog

#: Most volumes of a list.
MEMBERS = 1000


def _named(c: Catalog, credits: DataFrame) -> DataFrame:
    people = c.people.select(F.col("id").alias("person_id"), F.col("name").alias("person"))
    roles = c.roles.select(F.col("id").alias("role_id"), F.col("name").alias("role"), "display_order", "show_by_default")
    return credits.join(people, "person_id").join(F.broadcast(roles), "role_id")


def _first(rows: DataFrame, key: str, order: list) -> DataFrame:
    """Of each (key, role, person) the credit that comes first: a minimum, so tasks reduce before the shuffle."""
    return rows.groupBy(key, "role_id", "person_id").agg(F.min(F.struct(*order)).alias("best"))


def _lists(pairs: DataFrame, key: str) -> DataFrame:
    """``key, volumes``: volumes of each key in lists of at most ``MEMBERS``."""
    nth = F.row_number().over(Window.partitionBy(key).orderBy("volume_id")) - 1
    return pairs.select(key, "volume_id", F.floor(nth / MEMBERS).alias("part")).groupBy(key, "part").agg(F.collect_list("volume_id").alias("volumes")).drop("part")


def run_credits(c: Catalog) -> DataFrame:
    """``run_id, role_id, person_id`` with the order of the first of each person's credits in a role over a run's issues."""
    issues = c.issues.select(F.col("id").alias("target_id"), "run_id")
    rows = c.credits.where("target_kind = 'issue'").join(issues, "target_id")
    best = rows.groupBy("run_id", "role_id", "person_id").agg(F.min(F.coalesce("credit_order", F.lit(2**31))).alias("credit_order"), F.countDistinct("target_id").alias("n_issues"))
    return _named(c, best).select("run_id", "role", "person", "display_order", "show_by_default", F.nullif("credit_order", F.lit(2**31)).alias("credit_order"), "n_issues")


def volume_credits(c: Catalog) -> DataFrame:
    """Unique credits of each volume: its own, its issues', its one-shots', and those of runs it links without listing issues of."""
    credits = c.credits
    own = credits.where("target_kind = 'volume'").select(F.col("target_id").alias("volume_id"), "role_id", "person_id", "credit_order")
    issue = credits.where("target_kind = 'issue'").select(F.col("target_id").alias("issue_id"), "role_id", "person_id", "credit_order")
    shot = credits.where("target_kind = 'one_shot'").select(F.col("target_id").alias("one_shot_id"), "role_id", "person_id", "credit_order")
    # Volumes of an issue go as a list: to the runs of linked issues, and with each credit to where its person is.  One
    # shuffle serves the minima of pairs and the persons' names, with a row for each credit and list.
    held = _lists(c.volume_issues.select("issue_id", "volume_id"), "issue_id")
    linked = c.volume_runs.select("volume_id", "run_id").unionByName(c.volumes.where("run_id is not null").select(F.col("id").alias("volume_id"), "run_id")).distinct()
    runs = c.issues.select(F.col("id").alias("issue_id"), "run_id").join(linked.select("run_id").distinct(), "run_id", "left_semi")
    explicit = held.join(runs, "issue_id").select("run_id", F.explode("volumes").alias("volume_id"))
    fallback = _lists(linked.join(explicit, ["volume_id", "run_id"], "left_anti"), "run_id")
    # A linked run's credits are reduced to one row a role and person before they are dealt out to its volumes.
    of_runs = issue.join(runs, "issue_id").groupBy("run_id", "role_id", "person_id").agg(F.min(F.coalesce("credit_order", F.lit(2**31))).alias("credit_order"))
    given = ["role_id", "person_id", F.coalesce("credit_order", F.lit(2**31)).alias("credit_order")]
    single = F.array("volume_id").alias("volumes")
    every = own.select(*given, single).unionByName(issue.join(held, "issue_id").select(*given, "volumes"))
    every = every.unionByName(shot.join(c.volume_one_shots.select("volume_id", "one_shot_id"), "one_shot_id").select(*given, single)).unionByName(of_runs.join(fallback, "run_id").select(*given, "volumes"))
    pairs = every.repartition("person_id").select("role_id", "person_id", "credit_order", F.explode("volumes").alias("volume_id"))
    best = pairs.groupBy("volume_id", "role_id", "person_id").agg(F.min("credit_order").alias("credit_order"))
    return _named(c, best).select("volume_id", "role", "person", "display_order", "show_by_default", F.nullif("credit_order", F.lit(2**31)).alias("credit_order"))


def joined_names(c: Catalog, role: str) -> DataFrame:
    """``issue_id, names``: persons of a role joined by commas in credit order."""
    rows = _named(c, c.credits.where("target_kind = 'issue'")).where(F.col("role") == role)
    listed = F.array_sort(F.collect_set(F.struct(F.coalesce("credit_order", F.lit(2**31)).alias("o"), "person")))
    return rows.groupBy(F.col("target_id").alias("issue_id")).agg(F.array_join(F.transform(listed, lambda x: x["person"]), ", ").alias("names"))


def issue_groups(c: Catalog) -> DataFrame:
    """Issues of each volume by run: linked runs first in their order, then runs that only issues bring in."""
    held = c.volume_issues.join(c.issues.select(F.col("id").alias("issue_id"), "run_id"), "issue_id")
    grouped = held.groupBy("volume_id", "run_id").agg(F.count(F.lit(1)).alias("n_issues"), F.min(F.struct("issue_order", "issue_id")).alias("first"))
    links = c.volume_runs.select("volume_id", "run_id", "item_order")
    both = links.join(grouped, ["volume_id", "run_id"], "full")
    order = Window.partitionBy("volume_id").orderBy(F.col("item_order").asc_nulls_last(), F.col("first.issue_order").asc_nulls_last(), F.col("first.issue_id").asc_nulls_last(), "run_id")
    return both.select("volume_id", "run_id", F.col("item_order").isNotNull().alias("linked"), F.coalesce("n_issues", F.lit(0)).alias("n_issues"), F.row_number().over(order).alias("position"))
