"""Helpers that the training-data operators share: working folders, stored tables, Arrow batch loops, workers' stores.

Every intermediate table goes to the folder that the cluster names in ``spark.checkpoint.dir``.  Driver and
executors share that folder, so a lost executor costs a retry of its own tasks and never of the whole lineage.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Bytes of an Arrow batch that Spark builds, and rows and bytes of the slices that functions see.  A single text may
#: be longer than that; it then is a batch of its own.
BATCH_BYTES = 4 << 20
TEXT_BATCH_ROWS = 500
#: Bytes that a Python worker keeps of what it looked up before.
STORE_BYTES = 72 << 20
_ENTRY_BYTES = 170  # of a dict's entry with its key's and value's heads
_made: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """Folder that driver and executors share: ``spark.checkpoint.dir``.

    Where that is unset, a session on one machine gets a temporary folder, once an application; a cluster must set it.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        if context.applicationId not in _made:
            _made[context.applicationId] = f"file://{tempfile.mkdtemp(prefix='longbox-')}"
        folder = _made[context.applicationId]
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame, name: str, **options: str) -> DataFrame:
    """Write a table to the shared folder and read it back: one computation, however often the result is used."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.options(**options).parquet(path)
    return spark.read.schema(df.schema).parquet(path)


class Store:
    """What an operator keeps between batches in a Python worker, bounded by bytes.

    Spark reuses workers for other operators' tasks, so a worker holds one operator's store at a time: opening one
    empties the one that was open before.
    """

    _open: Store | None = None

    def __init__(self, most_bytes: int = STORE_BYTES):
        self.known: dict = {}
        self.bytes, self.most_bytes = 0, most_bytes

    def open(self) -> dict:
        """The entries; all of them go first if they outgrew the bound."""
        if Store._open is not self:
            if Store._open is not None:
                Store._open.clear()
            Store._open = self
        if self.bytes > self.most_bytes:
            self.clear()
        return self.known

    def keep(self, key: Any, value: Any, size: int) -> Any:
        self.known[key] = value
        self.bytes += size + _ENTRY_BYTES
        return value

    def clear(self) -> None:
        self.known.clear()
        self.bytes = 0


def slices(batch: pa.RecordBatch, rows: int = TEXT_BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> Iterator[pa.RecordBatch]:
    """Parts of a batch of at most ``rows`` rows, and of fewer where rows are long."""
    per = max(1, min(rows, batch.num_rows * most_bytes // max(1, batch.nbytes)))
    for start in range(0, batch.num_rows, per):
        yield batch.slice(start, per)


def in_arrow(df: DataFrame, run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema: Any) -> DataFrame:
    """``df.mapInArrow(run)`` with batches that Spark bounds by bytes as well as rows; a task gives Arrow memory back as it goes on."""
    df.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))

    def given(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield batch
            pa.default_memory_pool().release_unused()

    def bounded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(given(batches))
        pa.default_memory_pool().release_unused()

    return df.mapInArrow(bounded, schema)


def map_batches(df: DataFrame, function: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: Any, rows: int = TEXT_BATCH_ROWS, most_bytes: int = BATCH_BYTES) -> DataFrame:
    """Apply ``function`` to each slice of the Arrow batches; a batch stays on the machine where Spark put its rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, rows, most_bytes):
                if (out := function(part)) is not None:
                    yield out

    return in_arrow(df, run, schema)


def texts_of(batch: pa.RecordBatch, column: int) -> list[str]:
    """Texts of a batch, null as empty."""
    return [x or "" for x in batch.column(column).to_pylist()]
