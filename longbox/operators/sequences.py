"""Operators on ordered rows: as-of lookup, overlap removal, first of a kind."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def as_of(left: DataFrame, right: DataFrame, by: list[str], at: str, values: list[str]) -> DataFrame:
    """``left`` with the values of the latest right row of the same key at or before it; null where there is none.

    Both sides are laid end to end and the last right row is carried forward: one shuffle by key, no pairs.  Of right
    rows at one time the one of largest values stands.
    """
    last = right.where(F.col(at).isNotNull()).groupBy(*by, at).agg(F.max(F.struct(*values)).alias("_v"))
    rows = left.withColumns({"_v": F.lit(None).cast(last.schema["_v"].dataType), "_left": F.lit(1)}).unionByName(last.withColumn("_left", F.lit(0)), allowMissingColumns=True)
    order = Window.partitionBy(*by).orderBy(F.col(at).asc_nulls_first(), "_left").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("_v", F.last("_v", ignorenulls=True).over(order)).where("_left = 1")
    return rows.select(*left.columns, *[F.when(F.col(at).isNotNull(), F.col("_v")[v]).alias(v) for v in values])


def without_overlaps(rows: DataFrame, by: str, start: str, end: str, priority: str) -> DataFrame:
    """Spans of each group in order of start, priority (largest first) and length (longest first), less those that
    begin inside a span that was kept.

    A task reads its groups in that order and holds the end of the last kept span only.
    """
    ordered = rows.select(by, start, end, (-F.col(priority)).alias("_low"), (F.col(start) - F.col(end)).alias("_short"))
    ordered = ordered.repartition(by).sortWithinPartitions(by, start, "_low", "_short", end).select(by, start, end)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fresh, group, reach = True, None, None
        for batch in batches:
            kept = []
            for g, a, b in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True):
                new = fresh or g != group
                if new or (a is not None and a >= (0 if reach is None else reach)):
                    fresh, group, reach = False, g, b
                    kept.append(True)
                else:
                    kept.append(False)
            yield batch.filter(pa.array(kept, pa.bool_()))

    return ordered.mapInArrow(run, ordered.schema)


def first_of(rows: DataFrame, keys: list[str], order: str, values: list[str]) -> DataFrame:
    """Values of the first row of each key, empty ones filled from later rows."""
    first = [F.coalesce(F.min_by(F.nullif(v, F.lit("")), F.when(F.coalesce(v, F.lit("")) != "", F.col(order))), F.lit("")).alias(v) for v in values]
    return rows.groupBy(*keys).agg(*first)


def exists_in(keys: DataFrame, column: str, **tables: DataFrame) -> DataFrame:
    """``keys`` with the names of the tables that hold the key, in one pass over their union."""
    found = None
    for name, rows in tables.items():
        part = rows.select(F.col(column), F.lit(name).alias("_t")).distinct()
        found = part if found is None else found.unionByName(part)
    listed = found.groupBy(column).agg(F.array_sort(F.collect_set("_t")).alias("found_in"))
    return keys.join(listed, column, "left").withColumn("found_in", F.coalesce("found_in", F.array().cast("array<string>")))


def field_counts(changes: DataFrame) -> DataFrame:
    """``field, n``: how often each field changed."""
    return changes.select(F.explode("changed_fields").alias("field")).groupBy("field").agg(F.count(F.lit(1)).alias("n"))


def key_presence(left: DataFrame, right: DataFrame, json: str) -> DataFrame:
    """``key, where``: keys of the records of two sources: in both, or on one side only."""
    keys = lambda rows, name: rows.select(F.explode(F.json_object_keys(json)).alias("key")).distinct().withColumn(name, F.lit(True))
    both = keys(left, "_l").join(keys(right, "_r"), "key", "full")
    return both.select("key", F.when(F.col("_l") & F.col("_r"), "shared").when(F.col("_l"), "left").otherwise("right").alias("where"))
