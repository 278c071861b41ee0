"""Merkle manifest of a document table: a subtree for each language, a root over all, and a proof for each document.

H is the lowercase hex SHA-256 of its inputs joined.  A leaf is H of a row's fields, each ``-`` if null, else its bytes
counted, a colon and the value.  The leaves of a language ascend by id; every eight consecutive nodes become their H until
one is left, the language's subroot.  Subroots, by language, become the root in the same way.

The tree is built from below, and each level is a stored table of nodes with the digests of their run.  Then proofs are
pushed from above: a child takes its parent's proof and puts its own siblings before it.  Every join is by the place of a
node in its tree and every group is one run of at most eight, so a language that holds most rows is spread like any other.
Places come from a range sort: rows count from the start of their part, and only the counts of parts are summed up.

Rows that repeat an id are ordered by their leaves; rows alike in all fields are interchangeable.  Null ids come first,
and are not tampered with.  A null language is a tree of its own, and comes first.  A lone leaf is its subroot, a lone
subroot the root.  An empty table gives no rows.  Only the five columns named are read, whatever others there are.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from longbox.llm.shared import stored

FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
#: Nodes that become one.
RUN = 8
#: A proof: at each level from below, the digests of the siblings before and after, joined.
PROOF = "array<struct<before: string, after: string>>"


def field(value: Column) -> Column:
    text = value.cast("string")
    return F.when(value.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf(values: dict[str, Column]) -> Column:
    return F.sha2(F.concat(*(field(values[name]) for name in FIELDS)), 256)


def lowered(text: Column) -> Column:
    """A-Z in lower case, all else as it is."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    return F.translate(text, upper, upper.lower())


def leaves(docs: DataFrame) -> DataFrame:
    """``tree, doc_id, hash, found``: digests of each row, and of what is found after tampering."""
    values = {name: F.col(name) for name in FIELDS}
    tampered = F.col("doc_id").isNotNull() & (F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 0)
    found = F.when(tampered, leaf(values | {"text": lowered(F.col("text"))})).otherwise(leaf(values))
    return docs.select(F.col("lang").alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), leaf(values).alias("hash"), found.alias("found"))


def placed(nodes: DataFrame, order: list[str]) -> DataFrame:
    """``nodes`` with ``place``, counted from 0 in each ``tree`` by ``order``, and ``of``, the nodes of the tree; stored.

    A range sort makes parts; a row's number in its part and the sum of the counts of earlier parts are its place, so no
    task holds a tree.  The window runs over one row a part and tree.
    """
    at = nodes.repartitionByRange("tree", *order).sortWithinPartitions("tree", *order).withColumn("at", F.monotonically_increasing_id())
    at = stored(at, "ordered")
    parts = at.groupBy(F.shiftright("at", 33).alias("in_part"), F.col("tree").alias("in_tree")).agg(F.min("at").alias("first"), F.count(F.lit(1)).alias("n"))
    tree = Window.partitionBy("in_tree")
    before = F.coalesce(F.sum("n").over(tree.orderBy("in_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    starts = stored(parts.select("in_part", "in_tree", (before - F.col("first")).alias("shift"), F.sum("n").over(tree).alias("of")), "starts")
    joined = at.join(starts, (F.shiftright("at", 33) == F.col("in_part")) & F.col("tree").eqNullSafe(F.col("in_tree")))
    return stored(joined.select(*nodes.columns, (F.col("at") + F.col("shift")).alias("place"), "of"), "placed")


def levels(nodes: DataFrame) -> list[DataFrame]:
    """Stored levels from below, each ``tree, place, of, hash, run``: ``run`` holds the digests that a node is made of.

    ``nodes`` has ``tree, place, of, hash``.  A tree ends where one node is left; the last level is that of the largest.
    """
    most = nodes.agg(F.max("of")).first()[0] or 0
    below, out = nodes, []
    while most > 1:
        run = F.transform(F.array_sort(F.collect_list(F.struct("place", "hash"))), lambda x: x["hash"])
        size = F.ceil(F.max("of") / RUN).alias("of")
        above = below.where("of > 1").groupBy("tree", F.floor(F.col("place") / RUN).alias("place")).agg(size, run.alias("run"))
        below = stored(above.select("tree", "place", "of", F.sha2(F.array_join("run", ""), 256).alias("hash"), "run"), "level")
        out.append(below)
        most = -(-most // RUN)
    return out


def tops(nodes: DataFrame, built: list[DataFrame]) -> DataFrame:
    """``tree, hash`` of the last node of each tree."""
    out = nodes.where("of = 1").select("tree", "hash")
    for level in built:
        out = out.unionByName(level.where("of = 1").select("tree", "hash"))
    return out


def siblings(run: Column, place: Column) -> Column:
    """The level of a proof that a node at ``place`` adds: digests of its run before it and after it."""
    at = F.pmod(place, F.lit(RUN)).cast("int")
    return F.struct(F.array_join(F.slice(run, F.lit(1), at), "").alias("before"), F.array_join(F.slice(run, at + 2, F.lit(RUN)), "").alias("after"))


def pushed(nodes: DataFrame, built: list[DataFrame], heads: DataFrame) -> DataFrame:
    """``nodes`` with ``proof`` and what else ``heads`` has.

    ``heads`` has a row a tree: ``tree``, ``proof`` (what follows the tree's own proof) and columns that all nodes of the
    tree get.  A tree's last node takes them from there, every other node from its parent, with its siblings put before
    the proof.  What is stored are proofs of the levels above ``nodes``, an eighth of their rows or less.
    """
    carried = [c for c in heads.columns if c not in ("tree", "proof")]
    head = heads.select(F.col("tree").alias("up_tree"), F.col("proof").alias("suffix"), *carried)
    above: DataFrame | None = None
    for level in [*reversed(built), nodes]:
        keep = [c for c in level.columns if c != "run"] + (["run"] if level is not nodes else [])
        own = level.select(*keep)
        out = own.where("of = 1").join(head, F.col("tree").eqNullSafe(F.col("up_tree"))).select(*keep, *carried, F.col("suffix").alias("proof"))
        if above is not None:
            up = above.select(F.col("tree").alias("up_tree"), F.col("place").alias("up_place"), F.col("run").alias("up_run"), F.col("proof").alias("suffix"), *carried)
            met = own.where("of > 1").join(up, F.col("tree").eqNullSafe(F.col("up_tree")) & (F.floor(F.col("place") / RUN) == F.col("up_place")))
            out = out.unionByName(met.select(*keep, *carried, F.concat(F.array(siblings(F.col("up_run"), F.col("place"))), "suffix").alias("proof")))
        above = out if level is nodes else stored(out, "proofs")
    return above


def folded(found: Column, proof: Column) -> Column:
    """The root that a digest leads to with the siblings of a proof."""
    return F.aggregate(proof, found, lambda h, level: F.sha2(F.concat(level["before"], h, level["after"]), 256))


def manifest(docs: DataFrame) -> DataFrame:
    """A row for each row of ``docs``: its leaf, its language's subroot, the root, the digest of its proof, and whether what is found now still leads to the root."""
    nodes = placed(stored(leaves(docs), "leaves"), ["doc_id", "hash"])
    built = levels(nodes)
    languages = tops(nodes, built).select(F.lit("").alias("tree"), F.col("tree").alias("lang"), "hash")
    trees = placed(languages, ["lang"])
    joined = levels(trees)
    root = tops(trees, joined).select("tree", F.array().cast(PROOF).alias("proof"), F.col("hash").alias("root"))
    heads = pushed(trees, joined, root).select(F.col("lang").alias("tree"), "proof", F.col("hash").alias("subroot"), "root")
    rows = pushed(nodes, built, stored(heads, "heads")).withColumn("folded_root", folded(F.col("found"), F.col("proof")))
    proof = F.array_join(F.transform("proof", lambda x: F.concat(x["before"], x["after"])), "")
    return rows.select("doc_id", F.col("hash").alias("leaf"), "subroot", "root", F.sha2(proof, 256).alias("proof_sha256"), "folded_root", (F.col("folded_root") == F.col("root")).alias("verified"))
