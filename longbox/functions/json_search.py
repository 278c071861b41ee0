"""Search in JSON texts of any depth: where a value, or a key, holds one of several strings.

Spark deals texts out in Arrow batches bounded by bytes; a text is walked once for all strings, without recursion, so depth
is bounded by memory only.  Paths start with ``root``, add ``.key`` and ``[number]``.  Scalars are compared as text:
strings as they stand, numbers as Python writes them, True, False and None.  Each (path, needle) counts once a text.
Null texts and texts that are no JSON give no rows, nor does an empty list of needles.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BATCH_BYTES = 8 << 20
FOUND = "ref long, path string, key string, value string, needle string"


def walked(value: object) -> Iterator[tuple[str, str | None, object]]:
    """(path, nearest key, value) of everything inside a JSON value, in the order of the text."""
    left: list[tuple[str, str | None, object]] = [("root", None, value)]
    while left:
        path, key, value = left.pop()
        yield path, key, value
        if isinstance(value, dict):
            left += [(f"{path}.{k}", k, v) for k, v in reversed(value.items())]
        elif isinstance(value, list):
            left += [(f"{path}[{i}]", key, v) for i, v in reversed(list(enumerate(value)))]


def matches(text: str | None, needles: list[str], in_keys: bool = False, any_case: bool = False) -> Iterator[tuple[str, str | None, str, str]]:
    """(path, key, value, needle) of each scalar that holds a needle, or with ``in_keys`` of each value whose own key does."""
    fold = str.lower if any_case else str
    wanted = [(n, fold(n)) for n in dict.fromkeys(needles)]
    try:
        whole = json.loads(text) if text else None
    except ValueError:
        return
    if not text:
        return
    for path, key, value in walked(whole):
        nested = isinstance(value, (dict, list))
        if in_keys:
            held = fold(key) if key is not None and path.endswith(f".{key}") else None
        else:
            held = None if nested else fold(str(value))
        for needle, form in wanted if held is not None else ():
            if form in held:
                yield path, key, json.dumps(value, sort_keys=True) if nested else str(value), needle


def search(rows: DataFrame, ref: str, text: str, needles: list[str], in_keys: bool = False, any_case: bool = False) -> DataFrame:
    """``ref, path, key, value, needle`` of all texts of a column."""
    names = ["ref", "path", "key", "value", "needle"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(r, *m) for r, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True) for m in matches(t, needles, in_keys, any_case)]
            yield pa.RecordBatch.from_arrays([pa.array([f[k] for f in found], pa.string() if k else pa.int64()) for k in range(5)], names)

    rows.sparkSession.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    return rows.select(F.col(ref).cast("long"), F.col(text)).mapInArrow(run, FOUND)
