"""One-hop traversal of linked pages: seeds in an order of their own, what each links to, no page twice.

Read one after another, a seed whose page an earlier seed has stored or found is left out and finds nothing itself.  So a
seed is taken when no taken seed before it reaches its page.  That is settled for all seeds at once in rounds: seeds that
no open seed before them reaches are taken, those that these reach are left out, and the rest go on.  A round costs a
few joins over the links between open seeds; there are as many rounds as the longest chain in which each link decides the next,
about the logarithm of the seeds where their order has nothing to do with their links.  Each round's rows are
written to the shared folder and read back, so that lost executors repeat one round only.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.session import shared_path


def _stored(rows: DataFrame, name: str) -> DataFrame:
    path = shared_path(rows.sparkSession, name)
    rows.write.parquet(path)
    return rows.sparkSession.read.parquet(path)


def final_addresses(pages: DataFrame) -> DataFrame:
    """``key, page`` of ``pages (key, final)``: the page that each address leads to.  A final address leads to itself; one
    that no page was read from, null or blank, has no row; of several finals the smallest stands."""
    read = pages.where("key <> '' and final <> ''").groupBy("key").agg(F.min("final").alias("final"))
    own = read.select(F.col("final").alias("key")).distinct()
    return read.join(own, "key", "left_anti").select("key", F.col("final").alias("page")).unionByName(own.withColumn("page", F.col("key")))


def taken_seeds(seeds: DataFrame, reached: DataFrame) -> DataFrame:
    """``page`` of the seeds that are read and followed, of ``seeds (page, nth)``, unique in both, and ``reached (page, target)``."""
    places = seeds.select("page", "nth")
    links = reached.select("page", "target").where("page <> target").distinct()
    links = links.join(places, "page").join(places.select(F.col("page").alias("target"), F.col("nth").alias("target_nth")), "target")
    links = _stored(links.where("nth < target_nth").select("page", "target"), "traversal-links")
    out, left = None, _stored(seeds.select("page"), "traversal-seeds")
    while not links.isEmpty():
        held = links.select(F.col("target").alias("page")).distinct()
        free = left.join(held, "page", "left_anti")
        gone = links.join(free, "page", "left_semi").select(F.col("target").alias("page")).distinct()
        state = left.join(free.withColumn("free", F.lit(True)), "page", "left").join(gone.withColumn("gone", F.lit(True)), "page", "left")
        state = _stored(state.select("page", F.coalesce("free", F.lit(False)).alias("free"), F.coalesce("gone", F.lit(False)).alias("gone")), "traversal-round")
        now = state.where("free").select("page")
        out = now if out is None else out.unionByName(now)
        left = state.where("not free and not gone").select("page")
        links = _stored(links.join(left, "page", "left_semi").join(left.select(F.col("page").alias("target")), "target", "left_semi").select("page", "target"), "traversal-links")
    return left if out is None else out.unionByName(left)


def one_hop(seeds: DataFrame, links: DataFrame, pages: DataFrame, seen: DataFrame | None = None, skip: tuple[str, ...] = ()) -> DataFrame:
    """``page, seed, hop, position``: every page that is stored, the seed that stored it, 0 for the seed's own and 1 for linked ones.

    ``seeds (key, nth)`` are read in the order of ``nth``, then ``key``; ``links (key, position, target, kind)`` are the
    addresses on a page, by any address of it; ``pages (key, final)`` says where each address leads, and ``seen (page)`` what
    was stored before.  Links of a kind in ``skip`` are not followed, linked pages' own links neither.  A page is
    stored once, under its final address, by the first taken seed that reaches it, at its first position there.  Null and blank
    addresses and those that lead nowhere are passed over; with no seeds there are no rows.
    """
    final = final_addresses(pages)
    first = seeds.join(final, "key").groupBy("page").agg(F.min(F.struct("nth", "key")).alias("order"))
    if seen is not None:
        first = first.join(seen.select("page").distinct(), "page", "left_anti")
    followed = links.where(~F.coalesce(F.col("kind"), F.lit("")).isin(*skip)) if skip else links
    named = followed.join(final, "key").select("page", "position", F.col("target").alias("key"))
    reached = named.join(final.withColumnRenamed("page", "target"), "key").groupBy("page", "target").agg(F.min("position").alias("position"))
    reached = _stored(reached.join(first.select("page"), "page", "left_semi"), "traversal-reached")
    taken = first.join(taken_seeds(first.select("page", F.col("order").alias("nth")), reached), "page")
    found = reached.join(taken, "page").select(F.col("target").alias("page"), F.struct("order", F.lit(1).alias("hop"), "position", F.col("page").alias("seed")).alias("by"))
    own = taken.select("page", F.struct("order", F.lit(0).alias("hop"), F.lit(0).cast(reached.schema["position"].dataType).alias("position"), F.col("page").alias("seed")).alias("by"))
    rows = found.unionByName(own).groupBy("page").agg(F.min("by").alias("by"))
    if seen is not None:
        rows = rows.join(seen.select("page").distinct(), "page", "left_anti")
    return rows.select("page", "by.seed", "by.hop", "by.position")
