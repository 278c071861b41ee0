"""Session set-up shared by all queries."""

from __future__ import annotations

import os
import re
import tempfile
import uuid
import zipfile
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession

SETTINGS = {
    "spark.sql.session.timeZone": "UTC",
    "spark.sql.adaptive.enabled": "true",
    "spark.sql.adaptive.skewJoin.enabled": "true",
    "spark.sql.execution.arrow.pyspark.enabled": "true",
    "spark.ui.enabled": "false",
}
#: Most bytes that a task reads at once, from files or from a shuffle; smaller values of the caller's stand.
TASK_BYTES = 16 << 20
TASK_LIMITS = ("spark.sql.files.maxPartitionBytes", "spark.sql.adaptive.advisoryPartitionSizeInBytes")
#: Partitions of a shuffle for each task that reads a table: rows of a join or of lists are several times what was read.
PARTS_A_TASK = 8
PARTS = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
_UNITS = {"": 1, "b": 1, "k": 1 << 10, "m": 1 << 20, "g": 1 << 30, "t": 1 << 40}
_shipped: set[str] = set()
_made: dict[str, str] = {}
_dealt: dict[str, int] = {}
_tasks: dict[tuple[str, str], int] = {}


def local_session(cpus: int | str = "*", memory: str = "8g", partitions: int = 8) -> SparkSession:
    """Session for one machine.  On a cluster the caller brings a session of their own."""
    builder = SparkSession.builder.master(f"local[{cpus}]").config("spark.driver.memory", memory).config("spark.sql.shuffle.partitions", str(partitions))
    for key, value in SETTINGS.items():
        builder = builder.config(key, value)
    return ship(builder.getOrCreate())


def ship(spark: SparkSession) -> SparkSession:
    """Give the package's code to the executors, once a Spark application, so that Python workers can import it."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(__file__).parent
        path = os.path.join(tempfile.mkdtemp(prefix="longbox-"), "longbox.zip")
        with zipfile.ZipFile(path, "w") as z:
            for p in sorted(root.rglob("*.py")):
                z.write(p, p.relative_to(root.parent))
        context.addPyFile(path)
        _shipped.add(context.applicationId)
    return bounded_tasks(spark)


def _bytes(text: str) -> int:
    number, unit = re.fullmatch(r"(\d+)([bkmgt]?)b?", text.strip().lower()).groups()
    return int(number) * _UNITS[unit]


def bounded_tasks(spark: SparkSession) -> SparkSession:
    """Tasks of at most ``TASK_BYTES`` of input: rows of a few columns are ten to thirty times as large in a hash table or a sort."""
    for key in TASK_LIMITS:
        if _bytes(spark.conf.get(key)) > TASK_BYTES:
            spark.conf.set(key, str(TASK_BYTES))
    return spark


def dealt(rows: DataFrame, path: str) -> DataFrame:
    """``rows`` of a table at ``path``, for whose size shuffles now begin with enough partitions; Spark joins small ones again.

    A number of partitions that stays as tables grow makes hash tables and sorts grow with them.  A number of the caller's stands.
    """
    spark = rows.sparkSession
    name = spark.sparkContext.applicationId
    if (name, path) not in _tasks:
        _tasks[name, path] = rows.rdd.getNumPartitions()
    wanted, set_now = PARTS_A_TASK * _tasks[name, path], spark.conf.get(PARTS, None)
    if set_now is None or set_now == str(_dealt.get(name)):
        if wanted > int(set_now or spark.conf.get("spark.sql.shuffle.partitions")):
            spark.conf.set(PARTS, str(wanted))
            _dealt[name] = wanted
    return rows


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` dealt out to all cores several times over, where each row takes long: small files hold many of them."""
    return rows.repartition(4 * rows.sparkSession.sparkContext.defaultParallelism)


def shared_path(spark: SparkSession, name: str) -> str:
    """A new path in the folder that driver and executors share, ``spark.checkpoint.dir``; a temporary one where that is unset on one machine."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        context = spark.sparkContext
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
        folder = _made.setdefault(context.applicationId, "") or f"file://{tempfile.mkdtemp(prefix='longbox-')}"
        _made[context.applicationId] = folder
    return f"{folder.rstrip('/')}/{name}-{uuid.uuid4().hex}"
