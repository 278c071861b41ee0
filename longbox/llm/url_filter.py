"""URL rules as a sorted array of digests.

A filter file holds the sorted 64-bit xxhash keys of all rules, their full strings and verdicts.  Tasks memory-map the
keys, probe them for all candidate rules of a batch of URLs by vectorised binary search, and confirm each hit against
the stored string, so that a colliding digest never decides.  Spark distributes the file to the executors.

A larger table of rules is dealt out by key into such arrays of bounded size, which are built where they are probed:
candidates of each distinct host and path go to the array that can hold them.  The answers are the same.

A rule is a host and a path prefix.  It fits its host and all subdomains where the URL's path starts with the rule's;
the longest rule that fits wins, the longer host among equals, and a blocking rule among repeats of one rule.  Null
URLs and those without ``://`` have an empty host and path, which no rule fits; what no rule fits is allowed.
"""

from __future__ import annotations

import math
import mmap
import os
import struct
import tempfile
import uuid
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import SparkFiles
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from longbox.llm.shared import map_batches

#: Rules that one array may hold; a larger table makes several.
MOST_RULES = 200_000
#: Distinct URLs whose candidates are probed in one task.
PROBED_URLS = 500_000
HEADER = struct.Struct("<8sQQ")
#: Word breaks of a URL; the path ends before a query or fragment.
_AFTER = r"(?s)^.*?://"


def host_of(url: Column) -> Column:
    rest = F.regexp_replace(url, _AFTER, "")
    host = F.regexp_extract(rest, r"^[^/?#]*", 0)
    return F.when(url.contains("://"), F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise("")


def path_of(url: Column) -> Column:
    rest = F.regexp_replace(url, _AFTER, "")
    return F.when(url.contains("://"), F.regexp_extract(F.regexp_replace(rest, r"^[^/?#]*", ""), r"^[^?#]*", 0)).otherwise("")


def filter_bytes(rules: list[tuple[str, str, str]]) -> bytes:
    """A filter of ``(host, path, verdict)`` rules: header, sorted keys, string ends, lengths of paths, verdict bytes, strings."""
    best: dict[str, str] = {}
    for host, prefix, verdict in rules:
        key = f"{host}{prefix}" if prefix.startswith("/") else f"{host}\0{prefix}"
        best[key] = "block" if "block" in (verdict, best.get(key)) else verdict
    items = sorted((xxhash.xxh64_intdigest(k), k, v) for k, v in best.items())
    texts = [k.encode() for _, k, _ in items]
    sizes = sorted({len(p) for _, p, _ in rules})
    return b"".join(
        [
            HEADER.pack(b"URLRULE1", len(items), len(sizes)),
            np.array([d for d, _, _ in items], "<u8").tobytes(),
            np.cumsum([len(t) for t in texts], dtype="<u8").astype("<u8").tobytes(),
            np.array(sizes, "<u8").tobytes(),
            bytes(1 if v == "block" else 0 for _, _, v in items),
            *texts,
        ]
    )


def write_filter(rules: list[tuple[str, str, str]], path: str) -> None:
    with open(path, "wb") as f:
        f.write(filter_bytes(rules))


class UrlFilter:
    """A filter: a file, mapped into memory, or the bytes of one."""

    def __init__(self, source: str | bytes):
        if isinstance(source, bytes):
            self.map = source
        else:
            with open(source, "rb") as f:
                self.map = mmap.mmap(f.fileno(), 0, access=mmap.ACCESS_READ)
        magic, n, m = HEADER.unpack_from(self.map)
        if magic != b"URLRULE1":
            raise ValueError("not a filter file")
        at = HEADER.size
        self.keys = np.frombuffer(self.map, "<u8", n, at)
        self.ends = np.frombuffer(self.map, "<u8", n, at + 8 * n)
        self.path_sizes = np.frombuffer(self.map, "<u8", m, at + 16 * n).tolist()
        self.verdicts = np.frombuffer(self.map, "u1", n, at + 16 * n + 8 * m)
        self.texts_at = at + 17 * n + 8 * m

    def rule(self, i: int) -> bytes:
        start = int(self.ends[i - 1]) if i else 0
        return self.map[self.texts_at + start : self.texts_at + int(self.ends[i])]

    def look_up(self, candidates: list[bytes]) -> np.ndarray:
        """Row of each candidate's rule, or -1; equal digests are walked through until the string is equal."""
        digests = np.array([xxhash.xxh64_intdigest(c) for c in candidates], np.uint64)
        places = np.searchsorted(self.keys, digests)
        out = np.full(len(candidates), -1, np.int64)
        hit = np.flatnonzero((places < len(self.keys)) & (self.keys[np.minimum(places, max(len(self.keys) - 1, 0))] == digests)) if len(self.keys) else []
        for k in hit:
            i = int(places[k])
            while i < len(self.keys) and self.keys[i] == digests[k]:
                if self.rule(i) == candidates[k]:
                    out[k] = i
                    break
                i += 1
        return out

    def judge(self, hosts: list[str], paths: list[str]) -> list[tuple[str | None, str]]:
        """Rule and verdict for each URL."""
        candidates, owner, size = [], [], []
        for k, (host, path) in enumerate(zip(hosts, paths, strict=True)):
            if not host:
                continue
            suffixes = [host]
            while "." in suffixes[-1]:
                suffixes.append(suffixes[-1].partition(".")[2])
            for n in self.path_sizes:
                if n <= len(path):
                    prefix = path[:n] if path[:1] == "/" and n else "\0" + path[:n]
                    for s in suffixes:
                        candidates.append((s + prefix).encode())
                        owner.append(k)
                        size.append((len(s) + n, len(s)))
        best: dict[int, tuple[tuple[int, int], int]] = {}
        for c in np.flatnonzero((rows := self.look_up(candidates)) >= 0) if candidates else []:
            best[owner[c]] = max(best.get(owner[c], ((-1, -1), -1)), (size[c], int(rows[c])))
        return [(self.rule(best[k][1]).decode().replace("\0", ""), "block" if self.verdicts[best[k][1]] else "allow") if k in best else (None, "allow") for k in range(len(hosts))]


@cache
def _mapped(name: str) -> UrlFilter:
    return UrlFilter(SparkFiles.get(name))


def verdicts(pages: DataFrame, rules: DataFrame, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """``(page_id, host, path, rule, verdict)`` of each URL.  ``rules`` has columns host, path and verdict.

    Up to ``MOST_RULES`` rules, counted first, make one file that each executor maps; more make several arrays.
    """
    spark = pages.sparkSession
    urls = pages.select(F.col(id_col).cast("long").alias("page_id"), F.col(url_col).alias("url"))
    urls = urls.select("page_id", F.coalesce(host_of(F.col("url")), F.lit("")).alias("host"), F.coalesce(path_of(F.col("url")), F.lit("")).alias("path"))
    usable = rules.select("host", F.coalesce("path", F.lit("")).alias("path"), "verdict").where("host is not null and host <> '' and verdict is not null")
    n = usable.count()
    if n > MOST_RULES:
        return dealt_verdicts(urls, usable, math.ceil(n / MOST_RULES))
    name = f"url-rules-{uuid.uuid4().hex}.bin"
    local = os.path.join(tempfile.mkdtemp(prefix="longbox-"), name)
    write_filter(list(usable.toPandas().itertuples(index=False, name=None)), local)
    spark.sparkContext.addFile(local)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        done = _mapped(name).judge(batch.column(1).to_pylist(), batch.column(2).to_pylist())
        return pa.RecordBatch.from_arrays([*batch.columns, pa.array([d[0] for d in done], pa.string()), pa.array([d[1] for d in done], pa.string())], ["page_id", "host", "path", "rule", "verdict"])

    return map_batches(urls, run, "page_id long, host string, path string, rule string, verdict string")


def dealt_verdicts(urls: DataFrame, rules: DataFrame, shards: int) -> DataFrame:
    """The same for rule tables of any size, in ``shards`` arrays by a hash of the rules' keys.

    Distinct hosts with paths are matched once, so that one common URL costs a row a task; their candidates for an array
    are dealt into as many tasks as there are ``PROBED_URLS``, each with its copy of the array.
    """
    table = rules.groupBy("host", "path").agg(F.max(F.when(F.col("verdict") == "block", "block").otherwise("allow")).alias("verdict"))
    sizes = table.select(F.length("path").alias("n")).distinct().agg(F.array_sort(F.collect_list("n")).alias("sizes"))
    distinct = urls.select("host", "path").where("host <> ''").distinct()
    tasks = max(1, math.ceil(distinct.count() / PROBED_URLS))
    parts = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, i, F.size(parts)), "."))
    spread = distinct.join(F.broadcast(sizes)).select("host", "path", F.explode(suffixes).alias("s"), "sizes")
    spread = spread.select("host", "path", "s", F.explode("sizes").alias("n")).where(F.length("path") >= F.col("n")).withColumn("p", F.expr("left(path, n)"))
    shard = F.pmod(F.xxhash64("s", "p"), F.lit(shards))
    asked = spread.select("host", "path", "s", "p", shard.alias("shard"), F.pmod(F.xxhash64("host", "path", F.lit(1)), F.lit(tasks)).alias("task"))
    held = table.select(F.col("host").alias("s"), F.col("path").alias("p"), "verdict").withColumn("shard", shard).withColumn("task", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(tasks - 1).cast("long"))))

    def probe(left: pa.Table, right: pa.Table) -> pa.Table:
        rules = UrlFilter(filter_bytes(list(zip(*(right.column(c).to_pylist() for c in ("s", "p", "verdict")), strict=True))))
        hosts, prefixes = left.column("s").to_pylist(), left.column("p").to_pylist()
        rows = rules.look_up([f"{h}{p}".encode() if p.startswith("/") else f"{h}\0{p}".encode() for h, p in zip(hosts, prefixes, strict=True)])
        hit = np.flatnonzero(rows >= 0)
        found = left.select(["host", "path", "s", "p"]).take(pa.array(hit))
        return found.append_column("block", pa.array(rules.verdicts[rows[hit]] == 1, pa.bool_()))

    hits = asked.groupBy("shard", "task").cogroup(held.groupBy("shard", "task")).applyInArrow(probe, "host string, path string, s string, p string, block boolean")
    rank = F.struct(F.length("s") + F.length("p"), F.length("s"))
    best = hits.groupBy("host", "path").agg(F.max_by(F.struct(F.concat("s", "p").alias("rule"), "block"), rank).alias("best"))
    return urls.join(best, ["host", "path"], "left").select("page_id", "host", "path", F.col("best.rule").alias("rule"), F.when(F.col("best.block"), "block").otherwise("allow").alias("verdict"))
