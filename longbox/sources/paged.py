"""Lists and details of a source that gives JSON in pages, as a Spark data source.

A request names an offset, a limit of 1 to 100, the fields wanted and what items must meet; a reply holds a status, the
total and the items.  Tasks request runs of pages of their own.  Wanted fields are the columns of the reader's schema;
conditions on columns that a query filters by are pushed into the request, the others stay with Spark.  Conditions on
``id`` also choose the pages, so looking up details asks only for pages that may hold them.

Replies come from an endpoint: ``StoredPages`` reads pages kept in a Parquet table (``store_pages``); another class with
the same two methods, named by the option ``endpoint``, can ask a server.  A status other than 1, or a reply that is no JSON,
ends the job.  Items without a field give null there; an empty list gives no rows.
"""

from __future__ import annotations

import datetime as dt
import importlib
import json
from collections.abc import Iterable, Iterator
from typing import Any, NamedTuple

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, EqualTo, Filter, GreaterThan, GreaterThanOrEqual, In, InputPartition, IsNotNull, LessThan, LessThanOrEqual
from pyspark.sql.types import DataType, StructType

from longbox.operators.sync import batches

#: Most items of a page, and most ids of a lookup (fixed by the source).
MOST_ITEMS = 100
#: Pages that a task asks for.
PAGES_A_TASK = 64
#: Bytes of a row group of stored pages, about those that a task asks for.
GROUP_BYTES = 2 << 20
_TESTS = {"=": lambda a, b: a == b, "in": lambda a, b: a in b, ">": lambda a, b: a > b, ">=": lambda a, b: a >= b, "<": lambda a, b: a < b, "<=": lambda a, b: a <= b, "set": lambda a, b: a is not None}
_PUSHED = {EqualTo: "=", In: "in", GreaterThan: ">", GreaterThanOrEqual: ">=", LessThan: "<", LessThanOrEqual: "<=", IsNotNull: "set"}


class Condition(NamedTuple):
    """What an item's field must meet; ``=``, ``in``, ``>``, ``>=``, ``<``, ``<=`` or ``set`` (not null)."""

    field: str
    test: str
    value: Any = None


class Request(NamedTuple):
    """``limit`` items from ``offset``: the fields wanted of those that meet all conditions."""

    offset: int
    limit: int
    fields: tuple[str, ...]
    conditions: tuple[Condition, ...] = ()


def checked_limit(limit: int) -> int:
    if not 1 <= limit <= MOST_ITEMS:
        raise ValueError(f"a page has 1 to {MOST_ITEMS} items, not {limit}")
    return limit


def day_filter(field: str, day: dt.date) -> str:
    """The source's filter for a whole day of a time field."""
    return f"{field}:{day} 00:00:00|{day} 23:59:59"


def day_conditions(text: str) -> tuple[Condition, ...]:
    """Conditions of a filter ``field:from|to``."""
    field, _, span = text.partition(":")
    first, _, last = span.partition("|")
    return Condition(field, ">=", first), Condition(field, "<=", last)


def _value(raw: Any, kind: DataType) -> Any:
    """A JSON value as a column's type has it; what cannot be read as such is null."""
    name = kind.typeName()
    try:
        if raw is None or raw == "" and name != "string":
            return None
        if name in ("byte", "short", "integer", "long"):
            return int(raw)
        if name in ("float", "double"):
            return float(raw)
        if name == "date":
            return dt.date.fromisoformat(raw[:10])
        if name in ("timestamp", "timestamp_ntz"):
            return dt.datetime.fromisoformat(raw)
        if name == "boolean":
            return bool(raw)
        return raw if isinstance(raw, str) else json.dumps(raw, sort_keys=True)
    except (TypeError, ValueError):
        return None


def _meets(value: Any, condition: Condition) -> bool:
    return value is not None and _TESTS[condition.test](value, condition.value)


class StoredPages:
    """Replies from a Parquet table of pages, as ``store_pages`` writes it."""

    def __init__(self, path: str, schema: StructType):
        import pyarrow.dataset as ds

        self.kinds = {f.name: f.dataType for f in schema}
        self.table = ds.dataset(path.removeprefix("file://"), format="parquet") if "://" not in path or path.startswith("file://") else ds.dataset(path, format="parquet")

    def offsets(self, conditions: tuple[Condition, ...]) -> list[int]:
        """Offsets of the pages that may hold an item that meets the conditions on ``id``; page heads only are read."""
        heads = self.table.to_table(["offset", "first_id", "last_id"]).to_pylist()
        for c in (c for c in conditions if c.field == "id"):
            if c.test in ("=", "in"):
                asked = [c.value] if c.test == "=" else c.value
                heads = [h for h in heads if any(h["first_id"] <= i <= h["last_id"] for i in asked)]
            elif c.test in (">", ">="):
                heads = [h for h in heads if _meets(h["last_id"], c)]
            elif c.test in ("<", "<="):
                heads = [h for h in heads if _meets(h["first_id"], c)]
        return sorted(h["offset"] for h in heads)

    def replies(self, requests: list[Request]) -> Iterator[dict]:
        """A reply for each request, of stored pages with these offsets."""
        import pyarrow.dataset as ds

        by_offset = {r.offset: r for r in requests}
        offset = ds.field("offset")
        for batch in self.table.to_batches(["offset", "body"], filter=(offset >= min(by_offset)) & (offset <= max(by_offset)) & offset.isin(list(by_offset))):
            for offset, body in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield self._reply(by_offset[offset], json.loads(body))

    def _reply(self, request: Request, page: dict) -> dict:
        def kept(item: dict) -> bool:
            return all(_meets(_value(item.get(c.field), self.kinds[c.field]), c) for c in request.conditions if c.field in self.kinds)

        items = [{k: x[k] for k in request.fields if k in x} for x in page.get("results", [])[: request.limit] if kept(x)]
        return {**page, "limit": request.limit, "results": items}


class _Run(InputPartition):
    def __init__(self, offsets: list[int]):
        self.offsets = offsets


class PagedReader(DataSourceReader):
    def __init__(self, options: dict[str, str], schema: StructType):
        self.path, self.schema = options["path"], schema
        self.limit = checked_limit(int(options.get("limit", MOST_ITEMS)))
        self.endpoint_name = options.get("endpoint", f"{__name__}:StoredPages")
        self.conditions: tuple[Condition, ...] = day_conditions(options["filter"]) if options.get("filter") else ()

    def pushFilters(self, filters: list[Filter]) -> Iterable[Filter]:
        for f in filters:
            if type(f) in _PUSHED and len(f.attribute) == 1 and f.attribute[0] in self.schema.names:
                value = tuple(f.value) if isinstance(f, In) else getattr(f, "value", None)
                self.conditions += (Condition(f.attribute[0], _PUSHED[type(f)], value),)
            else:
                yield f

    def _endpoint(self):
        module, _, name = self.endpoint_name.partition(":")
        return getattr(importlib.import_module(module), name)(self.path, self.schema)

    def request(self, offset: int) -> Request:
        return Request(offset, self.limit, tuple(self.schema.names), self.conditions)

    def partitions(self) -> list[InputPartition]:
        offsets = self._endpoint().offsets(self.conditions)
        return [_Run(offsets[i : i + PAGES_A_TASK]) for i in range(0, len(offsets), PAGES_A_TASK)]

    def read(self, partition: InputPartition) -> Iterator[tuple]:
        if partition is None:
            return
        fields = [(f.name, f.dataType) for f in self.schema]
        for reply in self._endpoint().replies([self.request(o) for o in partition.offsets]):
            if str(reply.get("status_code")) != "1":
                raise RuntimeError(f"the source says {reply.get('status_code')}: {reply.get('error')}")
            for item in reply["results"]:
                yield tuple(_value(item.get(name), kind) for name, kind in fields)


class PagedList(DataSource):
    """``spark.read.format("paged_list").schema(fields).option("path", ...)``; options ``limit``, ``filter``, ``endpoint``."""

    @classmethod
    def name(cls) -> str:
        return "paged_list"

    def reader(self, schema: StructType) -> PagedReader:
        return PagedReader(self.options, schema)


def store_pages(items: DataFrame, path: str, limit: int = MOST_ITEMS) -> None:
    """Write ``items`` (with ``id``) as pages in order of id: ``offset, first_id, last_id, body``.  A page is one row, so a group has ``limit`` rows at most.

    Files and row groups hold ranges of offsets, so that a task reads no more than about its own pages.
    """
    total = items.count()
    pages = batches(items, "id", checked_limit(limit)).groupBy((F.col("batch") * limit).alias("offset")).agg(F.min("id").alias("first_id"), F.max("id").alias("last_id"), F.array_sort(F.collect_list(F.struct("id", F.to_json(F.struct(*items.columns)).alias("json")))).alias("items"))
    body = F.concat(F.lit(f'{{"status_code":1,"error":"OK","number_of_total_results":{total},"offset":'), F.col("offset").cast("string"), F.lit(',"results":['), F.array_join("items.json", ","), F.lit("]}"))
    pages.select("offset", "first_id", "last_id", body.alias("body")).repartitionByRange("offset").sortWithinPartitions("offset").write.option("parquet.block.size", GROUP_BYTES).parquet(path)


def read_list(spark: SparkSession, path: str, schema: str, **options: str) -> DataFrame:
    """The list at ``path``; ``schema`` names the fields wanted."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(PagedList)
    return spark.read.format("paged_list").schema(schema).options(path=path, **options).load()


def read_details(spark: SparkSession, path: str, ids: list[int], schema: str) -> DataFrame:
    """The items of at most ``MOST_ITEMS`` ids, each once; ids that the source does not have give no row."""
    ids = list(dict.fromkeys(ids))
    if len(ids) > MOST_ITEMS or any(i < 1 for i in ids):
        raise ValueError(f"a lookup takes up to {MOST_ITEMS} positive ids")
    return read_list(spark, path, schema).where(F.col("id").isin(ids))
