"""Near duplicates by order MinHash.

A text's symbols are its words' windows of five, each labelled with how often it occurred before in the text.  For
each of several hash functions the few windows of smallest hash are taken and put back into text order; a digest of
such a tuple agrees between texts that share those windows in that order, which follows edit similarity rather than
set similarity.  Texts that agree in all tuples of a band are candidates.  Texts of few words have few windows, and one
changed word breaks most of them: they get a second set of bands, of one tuple each, from windows of three words.

A candidate pair is verified by a banded alignment of its words: the pair is linked if the longest common subsequence L
of texts of n and m words satisfies L >= 0.8 * (n + m - L).  The band holds every alignment that can reach this, so it
loses none.  Five-word windows alone would count each changed word five times.  Of copies with each word replaced at a
chance of one in thirty or less, bands find 99 in 100, at one in twenty 98, at one in twelve 82, at one in nine, about the
least similarity linked, 63 (measured on the generated documents; ``tests/llm`` hold the first three to it).

Equal texts are one node from the start.  In a bucket of candidates, all are aligned with one leader, and links make
components.  Buckets that then hold several components are taken together where they overlap: nodes outside the
largest component meet all nodes in blocks of bounded words and rows.  A block finds texts that may share enough words
by an index of rare ones, counts shared words and pairs of neighbours of those, which bound the alignment from above, and
aligns only those that can pass and are not connected yet, many side by side; links alone leave it.  Every pair of a bucket is thus ruled out, aligned or connected, without caps, and no table of
pairs is made.

Words are ``[^\\x20\\x09-\\x0D]+`` as they stand.  A text of fewer words than a window has is one window; null texts and texts
without a word form classes of their own row.  Rows that repeat an id are told apart by their texts: each is compared
as what it says, and a class is named by its smallest id.  Rows without an id are in the class of an equal text.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from longbox.llm.shared import in_arrow, map_batches, stored

WORDS, SIMILARITY = 5, 0.8
#: Bands, tuples in a band, windows in a tuple.
BANDS, ROWS, TAKEN = 40, 2, 2
#: Texts of at most so many words get a second set of bands, of one tuple of windows of so many words.  A linked text is
#: at most a quarter longer, so pairs with a text of 30 words or fewer have the set on both sides.
FEW_WORDS, FEW_BANDS, FEW_WINDOW = 38, 24, 3
#: Words of a block of texts that are compared together.
BLOCK_WORDS = 400_000
#: Texts of a side of such a block, which bounds its pairs when texts are short.
BLOCK_ROWS = 4_000
#: Places of a text that stand in one number, in an alignment.
PART = 8192
#: Cells of a block's arrays that are held at once.
MATRIX_CELLS = 8_000_000
#: Words of a text that is aligned with many at once; its bits for each of its words are held.
LONGEST_LANE = 4_096
#: Rare words that two texts of a block must share before all their words are counted.
TOGETHER = 4
#: Ids that may be broadcast to pick rows; more are joined by a shuffle.
MOST_BROADCAST = 2_000_000
#: Links that a task contracts at a time.
CHUNK_LINKS = 200_000
#: Edges above which a node is joined by a broadcast of such nodes, and the most of them that are.
HUB_EDGES, MOST_HUBS = 1_000, 1_000_000
_MIX = [np.uint64(x) for x in (30, 0xBF58476D1CE4E5B9, 27, 0x94D049BB133111EB, 31)]


@cache
def _multipliers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(20)).integers(0, 1 << 31, BANDS * ROWS, np.uint32) * np.uint32(2) + np.uint32(1)


@cache
def _powers() -> np.ndarray:
    return np.random.Generator(np.random.PCG64(21)).integers(0, 1 << 63, WORDS + 1, np.uint64) * np.uint64(2) + np.uint64(1)


def _mixed(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> _MIX[0])
    x *= _MIX[1]
    x ^= x >> _MIX[2]
    x *= _MIX[3]
    x ^= x >> _MIX[4]
    return x


def words_of(text: str | None) -> list[str]:
    for space in "\t\n\v\f\r":
        text = text and text.replace(space, " ")
    return list(filter(None, text.split(" "))) if text else []


def hashed(words: list[str]) -> np.ndarray:
    """64-bit hashes of a text's words in text order."""
    return np.frombuffer(b"".join(map(xxhash.xxh64_digest, words)), np.uint64)


def windows(h: np.ndarray, width: int = WORDS) -> np.ndarray:
    """64-bit hashes of the windows of ``width`` words of a text's hashed words; one window if there are fewer words."""
    if not len(h):
        return np.zeros(0, np.uint64)
    n, powers = max(1, len(h) - width + 1), _powers()
    out = np.full(n, min(len(h), width), np.uint64) * powers[WORDS]
    for k in range(min(width, len(h))):
        out += h[k : k + n] * powers[k]
    return _mixed(out)


def labelled(shingles: np.ndarray) -> np.ndarray:
    """Windows with their occurrence number mixed in: the first of its kind stays as it is."""
    order = np.argsort(shingles, kind="stable")
    ordered = shingles[order]
    new = np.concatenate([[True], ordered[1:] != ordered[:-1]])
    if new.all():
        return shingles
    places = np.arange(len(ordered))
    nth = places - np.maximum.accumulate(np.where(new, places, 0))
    out = shingles.copy()
    out[order] = np.where(nth > 0, _mixed(ordered + nth.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)), ordered)
    return out


def _bands(x: np.ndarray, bands: int, rows: int, salt: int) -> np.ndarray:
    """A digest for each band: of each of its tuples, the windows of smallest hash in text order."""
    hashes = _multipliers()[: bands * rows, None] * (x >> np.uint64(32)).astype(np.uint32)[None, :]
    every = np.arange(bands * rows)
    picked = []
    for _ in range(min(TAKEN, len(x))):
        at = hashes.argmin(1)
        picked.append(at)
        hashes[every, at] = 0xFFFFFFFF
    places = np.sort(np.stack(picked, 1), 1)
    digest = np.full(len(places), len(picked), np.uint64)
    for k in range(places.shape[1]):
        digest = _mixed(digest * np.uint64(0x9E3779B97F4A7C15) + x[places[:, k]])
    tuples = digest.reshape(bands, rows)
    out = np.arange(salt, salt + bands, dtype=np.uint64)
    for k in range(rows):
        out = _mixed(out * np.uint64(0x9E3779B97F4A7C15) + tuples[:, k])
    return out


def sketch(words: list[str]) -> np.ndarray:
    """One digest for each band, and for each of the second set where words are few."""
    h = hashed(words)
    out = _bands(labelled(windows(h)), BANDS, ROWS, 0)
    return np.concatenate([out, _bands(labelled(windows(h, FEW_WINDOW)), FEW_BANDS, 1, BANDS)]) if len(h) <= FEW_WORDS else out


def aligned(a: np.ndarray, b: np.ndarray, similarity: float = SIMILARITY) -> bool:
    """Whether an alignment of two word sequences reaches the similarity.

    Bit-parallel longest common subsequence, a row for each word of ``b`` and a bit for each of ``a``.  Only bits of the
    band of places that an alignment with enough matches can pass are kept: those before it can change no more, and
    those after it are not met yet.
    """
    n, m = len(a), len(b)
    least = int(np.ceil(similarity * (n + m) / (1 + similarity) - 1e-9))
    if not n or not m or least > min(n, m):
        return False
    first = np.flatnonzero(a[: min(n, m)] != b[: min(n, m)])
    head = int(first[0]) if len(first) else min(n, m)
    if head >= least:
        return True
    tail_a, tail_b = a[head:][::-1], b[head:][::-1]
    size = min(len(tail_a), len(tail_b))
    last = np.flatnonzero(tail_a[:size] != tail_b[:size])
    tail = int(last[0]) if len(last) else size
    if head + tail >= least:
        return True
    a, b, need = a[head : n - tail], b[head : m - tail], least - head - tail
    n, m = len(a), len(b)
    if need > min(n, m) or np.isin(b, a).sum() < need:
        return False
    left, right = n - need, m - need  # how far a's place may run ahead of b's, and fall behind
    places: dict[int, dict[int, int]] = {}  # of each word, bits in parts of a, so that a row reads its band only
    for i, x in enumerate(a.tolist()):
        parts = places.setdefault(x, {})
        parts[i // PART] = parts.get(i // PART, 0) | 1 << i % PART
    low, high = 0, min(n, left + 1)
    v, matches = (1 << high) - 1, 0
    for j, x in enumerate(b.tolist()):
        if j > right:
            matches += 1 - (v & 1)
            v >>= 1
            low += 1
        if j and high < n:
            v |= 1 << (high - low)
            high += 1
        parts = places.get(x)
        if parts:
            mark = 0
            for k in range(low // PART, (high - 1) // PART + 1):
                bits = parts.get(k, 0)
                mark |= bits << k * PART - low if k * PART >= low else bits >> low - k * PART
            ones = (1 << (high - low)) - 1
            u = v & mark & ones
            v = ((v + u) | (v - u)) & ones
    return matches + high - low - v.bit_count() >= need


# Tables --------------------------------------------------------------------------------------------------------


def _sketched(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``doc_id, mark, digest, bands, size``; digest is 128 bits of the words, null where there is none; mark tells texts of one id apart."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        digests, bands, sizes = [], [], []
        for text in batch.column(2).to_pylist():
            words = words_of(text)
            digests.append(xxhash.xxh3_128_digest(" ".join(words)) if words else None)
            bands.append(sketch(words).view(np.int64) if words else None)
            sizes.append(max(1, len(words)))
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(digests, pa.binary()), pa.array(bands, pa.list_(pa.int64())), pa.array(sizes, pa.int32())], ["doc_id", "mark", "digest", "bands", "size"])

    return map_batches(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text")), run, "doc_id long, mark long, digest binary, bands array<long>, size int")


def _verified(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """``pairs (a, b)`` that align; texts of both are joined in, as hashes of their words."""
    left = texts.select(F.col("node").alias("a"), F.col("words").alias("wa"))
    right = texts.select(F.col("node").alias("b"), F.col("words").alias("wb"))

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        wa, wb = batch.column(2), batch.column(3)
        good = [aligned(np.frombuffer(wa[i].as_py(), "<u8"), np.frombuffer(wb[i].as_py(), "<u8")) for i in range(batch.num_rows)]
        return pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(good, pa.bool_())], ["a", "b", "linked"])

    joined = pairs.join(left, "a").join(right, "b").select("a", "b", "wa", "wb")
    return map_batches(joined, run, "a long, b long, linked boolean")


def _hashed(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``node, words`` of the documents that stand for a candidate node; ``nodes`` has ``node, origin, mark``."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        packed = [hashed(words_of(t)).astype("<u8").tobytes() for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(packed, pa.binary())], ["node", "words"])

    small = nodes.count() <= MOST_BROADCAST
    texts = docs.select(F.col(id_col).cast("long").alias("origin"), F.xxhash64(text_col).alias("mark"), F.col(text_col).alias("text"))
    mine = texts.join(F.broadcast(nodes) if small else nodes, ["origin", "mark"]).select("node", "text")
    return map_batches(mine, run, "node long, words binary").dropDuplicates(["node"])


def _contracted(links: DataFrame) -> DataFrame:
    """Links ``(a, b)`` with the same components, stored: what a task reads together hangs below its least node.

    A task joins ``CHUNK_LINKS`` links at a time, whatever their keys, so its memory is bounded and nothing is shuffled.
    """

    def stars(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        root: dict[int, int] = {}

        def find(x: int) -> int:
            while (y := root[x]) != x:
                root[x] = x = root[y]
            return x

        for batch in batches:
            for a, b in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                root.setdefault(a, a)
                root.setdefault(b, b)
                x, y = find(a), find(b)
                if x != y:
                    root[max(x, y)] = min(x, y)
        hung = [(find(x), x) for x in root if root[x] != x]
        return pa.RecordBatch.from_arrays([pa.array([h[k] for h in hung], pa.int64()) for k in (0, 1)], ["a", "b"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, n = [], 0
        for batch in batches:
            held.append(batch)
            n += batch.num_rows
            if n >= CHUNK_LINKS:
                yield stars(held)
                held, n = [], 0
        if held:
            yield stars(held)

    return stored(in_arrow(links.select("a", "b"), run, "a long, b long"), "edges")


def components(links: DataFrame) -> DataFrame:
    """``(node, root)`` of every node on a link ``(a, b)``: the smallest node that it is connected with.

    Tasks first contract the links that they read.  Then a step hangs each edge's larger end below the least neighbour
    of its smaller end, its smaller end below that of its larger end, and every node below its own; this keeps what is
    connected together and shortens paths by half.  A step's result is stored, so lineage stays short.  No node's
    neighbours are gathered: only minima are.
    """
    edges = _contracted(_contracted(links))
    while True:
        # Done when all edges are stars: each node hangs below one other only, and nothing hangs below it.
        ends = edges.select(F.col("b").alias("node"), F.col("a").alias("up"), F.lit(0).alias("down")).unionByName(edges.select(F.col("a").alias("node"), F.lit(None).cast("long").alias("up"), F.lit(1).alias("down")))
        facts = ends.groupBy("node").agg(F.min("up").alias("low"), F.max("up").alias("high"), F.max("down").alias("down"))
        if not facts.where("low <> high or (low is not null and down > 0)").count():
            return stored(edges.select(F.col("b").alias("node"), F.col("a").alias("root")).unionByName(edges.select(F.col("a").alias("node"), F.col("a").alias("root"))).distinct(), "roots")
        both = edges.select("a", "b").unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = stored(both.groupBy("a").agg(F.min("b").alias("m"), F.count(F.lit(1)).alias("n")).select("a", F.least("a", "m").alias("m"), "n"), "least")
        # Both ends of an edge, each with the other's least neighbour.
        hung = _with_least(both, least).unionByName(least.select(F.col("m").alias("x"), F.col("a").alias("y")))
        edges = _contracted(stored(hung.where("x < y").distinct(), "edges").withColumnsRenamed({"x": "a", "y": "b"}))


def _with_least(edges: DataFrame, least: DataFrame) -> DataFrame:
    """``(x, y)`` for each edge ``(a, b)``: the least neighbour of ``a``, and ``b``.

    Nodes of many edges do not meet theirs in one task: they are few, at most a ``HUB_EDGES``-th of all edges, so they
    are broadcast, and only other edges are shuffled.  Beyond ``MOST_HUBS`` of them, all edges are.
    """
    hubs = least.where(F.col("n") > HUB_EDGES).select("a", F.col("m").alias("hub"))
    if not 0 < hubs.count() <= MOST_HUBS:
        return edges.join(least.select("a", "m"), "a").select(F.col("m").alias("x"), F.col("b").alias("y"))
    told = edges.join(F.broadcast(hubs), "a", "left")
    rest = told.where("hub is null").select("a", "b").join(least.where(F.col("n") <= HUB_EDGES).select("a", "m"), "a")
    return told.where("hub is not null").select(F.col("hub").alias("x"), F.col("b").alias("y")).unionByName(rest.select(F.col("m").alias("x"), F.col("b").alias("y")))


def _ranges(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """Places of several ranges, one after another."""
    ends = np.cumsum(counts)
    return np.repeat(starts - ends + counts, counts) + np.arange(int(ends[-1]) if len(ends) else 0)


class _Shared:
    """How many symbols texts of a block share with one of them; a text's symbols are distinct, those rarest on the right come first."""

    def __init__(self, sets: list[np.ndarray], right: np.ndarray):
        self.sizes = np.array([len(x) for x in sets])
        self.starts = np.cumsum(self.sizes) - self.sizes
        found, symbols = np.unique(np.concatenate(sets), return_inverse=True)
        often = np.bincount(symbols[_ranges(self.starts[right], self.sizes[right])], minlength=len(found))
        rank = np.empty(len(found), np.int64)
        rank[np.argsort(often, kind="stable")] = np.arange(len(found))
        keys = np.repeat(np.arange(len(sets)), self.sizes) * len(found) + rank[symbols]
        keys.sort()
        self.symbols, self.mark = (keys % max(1, len(found))).astype(np.int32), np.zeros(len(found), np.int8)

    def of(self, text: int) -> np.ndarray:
        return self.symbols[self.starts[text] : self.starts[text] + self.sizes[text]]

    def __call__(self, text: int, others: np.ndarray) -> np.ndarray:
        self.mark[self.of(text)] = 1
        first, sizes = self.starts[others], self.sizes[others]
        low, high = int(first.min()), int((first + sizes).max())
        if high - low > 3 * sizes.sum():  # few of those between: only theirs are read
            held, first = self.mark[self.symbols[_ranges(first, sizes)]], np.cumsum(sizes) - sizes
        else:
            held, first = self.mark[self.symbols[low:high]], first - low
        held = np.concatenate([[0], np.cumsum(held, dtype=np.int32)])
        self.mark[self.of(text)] = 0
        return held[first + sizes] - held[first]


class _Index:
    """Which texts on the right may share enough words with a text.

    Texts of n and m words that are linked share 0.8 n words and 0.8 m words at least.  So whatever order words are put
    in, the same for all texts, they share one among the first n - 0.8 n + 1 and m - 0.8 m + 1 of it, and with k - 1 more on
    each side they share k.  Rare words come first, so few texts meet.
    """

    def __init__(self, words: _Shared, right: np.ndarray):
        self.words, self.right = words, right
        taken = self.taken(words.sizes[right])
        symbols = words.symbols[_ranges(words.starts[right], taken)]
        order = np.argsort(symbols, kind="stable")
        self.rows = np.repeat(np.arange(len(right), dtype=np.int32), taken)[order]
        self.starts = np.searchsorted(symbols[order], np.arange(len(words.mark) + 1))

    @staticmethod
    def taken(sizes: np.ndarray) -> np.ndarray:
        return np.minimum(sizes, sizes - np.ceil(SIMILARITY * sizes - 1e-9).astype(np.int64) + TOGETHER)

    def __call__(self, text: int) -> np.ndarray:
        mine = self.words.of(text)
        mine = mine[: self.taken(np.array([len(mine)]))[0]]
        counts = self.starts[mine + 1] - self.starts[mine]
        met = np.bincount(self.rows[_ranges(self.starts[mine], counts)], minlength=len(self.right))
        # A text of which all words are taken may have fewer than that.
        return np.flatnonzero(met >= np.minimum(TOGETHER, np.maximum(1, np.ceil(SIMILARITY * len(self.words.of(text)) - 1e-9))))


def aligned_with(a: np.ndarray, others: list[np.ndarray], similarity: float = SIMILARITY) -> np.ndarray:
    """Whether each of ``others`` aligns with ``a``: what ``aligned`` says of each, worked out side by side in one number.

    Each text has its bits of ``a`` in bytes of its own, with a bit to spare that takes what an addition carries over.
    """
    n, many = len(a), len(others)
    if not n or n > LONGEST_LANE or many < 3:
        return np.array([aligned(a, b, similarity) for b in others], bool)
    known, code = np.unique(a, return_inverse=True)
    lane, places = n // 8 + 1, np.arange(n)
    masks = np.zeros((len(known) + 1, lane), np.uint8)
    np.bitwise_or.at(masks, (code, places // 8), (1 << places % 8).astype(np.uint8))
    # Words by place; a text that has ended goes on with a word that ``a`` has not.
    sizes, words = np.array([len(b) for b in others]), np.concatenate(others)
    at = np.minimum(np.searchsorted(known, words), len(known) - 1)
    rows = np.full((many, int(sizes.max())), len(known), np.int32)
    rows[np.arange(rows.shape[1])[None, :] < sizes[:, None]] = np.where(known[at] == words, at, len(known))
    v = every = int.from_bytes(((1 << n) - 1).to_bytes(lane, "little") * many, "little")
    for column in rows.T:
        u = v & int.from_bytes(masks[column].tobytes(), "little")
        v = ((v + u) | (v ^ u)) & every
    matches = n - np.bitwise_count(np.frombuffer(v.to_bytes(lane * many, "little"), np.uint8)).reshape(many, lane).sum(1, dtype=np.int64)
    return (matches >= np.ceil(similarity * (n + sizes) / (1 + similarity) - 1e-9)) & (sizes > 0)


def block_links(nodes: np.ndarray, roots: np.ndarray, sides: np.ndarray, sequences: list[np.ndarray]) -> list[tuple[int, int]]:
    """Links between nodes of side 0 and nodes of side 1 or 2 that join components not joined in this block before.

    Nodes of side 2 are on side 0 of some block as well, where they meet these: one of both blocks compares them.

    Texts of n and m words with an alignment of L share L words at least.  A word that it leaves out of one text breaks two
    of its pairs of neighbours, and one left out of the other breaks one more, so they share 3 L - n - m - 1 pairs at least.
    Texts that may share enough words are found by rare ones; their words are counted, then their pairs of neighbours, and
    what is left is aligned, more and more texts at a time.
    """
    order = np.argsort(sides, kind="stable")
    nodes, roots, sides, sequences = nodes[order], roots[order], sides[order], [sequences[i] for i in order]
    lengths = np.array([len(x) for x in sequences])
    left, right = np.flatnonzero(sides == 0), np.flatnonzero(sides > 0)
    if not len(left) or not len(right):
        return []
    words, twos = _Shared([labelled(x) for x in sequences], right), None
    index = _Index(words, right)
    group = {r: r for r in roots.tolist()}

    def find(x: int) -> int:
        while group[x] != x:
            group[x] = group[group[x]]
            x = group[x]
        return x

    out = []
    for a in left.tolist():
        others = right[index(a)]
        least = SIMILARITY / (1 + SIMILARITY) * (lengths[a] + lengths[others])
        able = (roots[others] != roots[a]) & (least <= np.minimum(lengths[a], lengths[others]) + 1e-3) & ((sides[others] == 1) | (nodes[others] > nodes[a]))
        others, least = others[able], least[able]
        if len(others):
            able = words(a, others) >= least - 1e-3
            others, least = others[able], least[able]
        if len(others):
            twos = twos or _Shared([labelled(windows(x, 2)) for x in sequences], right)
            others = others[twos(a, others) >= 3 * least - lengths[a] - lengths[others] - 1 - 1e-3]
        step = 1
        while len(others):
            mine = find(int(roots[a]))
            others = others[[find(r) != mine for r in roots[others].tolist()]]
            tried, others, step = others[:step], others[step:], min(4 * step, max(1, MATRIX_CELLS // (4 * int(lengths[a]))))
            for b in tried[aligned_with(sequences[a], [sequences[b] for b in tried])].tolist() if len(tried) else ():
                x, y = find(int(roots[a])), find(int(roots[b]))
                if x != y:
                    group[max(x, y)] = min(x, y)
                    out.append((int(nodes[a]), int(nodes[b])))
    return out


def _rest_links(buckets: DataFrame, roots: DataFrame, texts: DataFrame) -> DataFrame | None:
    """Links ``(a, b)`` between components that share a bucket; None if no bucket holds several."""
    state = buckets.join(roots, "node", "left").select("key", "node", "size", F.coalesce("root", "node").alias("root"))
    several = state.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.min("node").alias("first")).where("x < y").select("key", "first")
    held = stored(state.join(several, "key").select("first", "node", "size", "root"), "open-buckets")
    if held.isEmpty():
        return None
    family = components(held.select(F.col("first").alias("a"), F.col("node").alias("b"))).select("node", F.col("root").alias("family"))
    members = held.select("node", "size", "root").distinct().join(family, "node")
    parts = members.groupBy("family", "root").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    facts = parts.groupBy("family").agg(F.max(F.struct("n", "root", "rows")).alias("top"), F.sum("n").alias("all"), F.sum("rows").alias("rows"))
    blocks = lambda n, rows: F.ceil(F.greatest(n / BLOCK_WORDS, rows / BLOCK_ROWS))
    facts = facts.select("family", F.col("top.root").alias("largest"), blocks(F.col("all"), F.col("rows")).alias("wide"), blocks(F.col("all") - F.col("top.n"), F.col("rows") - F.col("top.rows")).alias("high"))
    members = stored(members.join(facts.where("high > 0"), "family"), "families")
    number = lambda n: F.pmod(F.xxhash64("node"), F.col(n))
    every = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.col(n) - 1))
    rows = members.where("root <> largest").select("family", number("high").alias("i"), every("wide").alias("j"), "node", "root", F.lit(0).alias("side"))
    rows = rows.unionByName(members.select("family", every("high").alias("i"), number("wide").alias("j"), "node", "root", F.lit(1).alias("side")))

    def run(table: pa.Table) -> pa.Table:
        sequences = [np.frombuffer(x.as_py(), "<u8") for x in table.column("words")]
        found = block_links(table.column("node").to_numpy(), table.column("root").to_numpy(), table.column("side").to_numpy(), sequences)
        return pa.table({"a": pa.array([x for x, _ in found], pa.int64()), "b": pa.array([y for _, y in found], pa.int64())})

    return stored(rows.join(texts, "node").groupBy("family", "i", "j").applyInArrow(run, "a long, b long"), "block-links")


def _close() -> F.Column:
    """Sizes that an alignment can link: the shorter sequence must hold enough of the longer one."""
    return F.least("a_size", "b_size") >= SIMILARITY * F.greatest("a_size", "b_size") - 1e-9


def _linked(docs: DataFrame, nodes: DataFrame, id_col: str, text_col: str) -> DataFrame | None:
    """``(node, root)`` of nodes that links connect with others; None if no bucket holds two."""
    wide = nodes.where("node is not null").select("node", "size", F.explode("bands").alias("key"))
    shared = wide.groupBy("key").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("key")
    # Linked sizes differ by a quarter at most: each node stands in two neighbouring cells of such steps, and a pair
    # that can be linked shares one, so texts of other sizes that share a passage do not fill a bucket.
    cell = F.floor(F.log(F.col("size").cast("double")) / F.log(F.lit(1 / SIMILARITY)) + 1e-9)
    cells = wide.join(shared, "key").withColumn("cell", F.explode(F.array(cell, cell + 1))).select(F.xxhash64("key", "cell").alias("key"), "node", "size").distinct()
    first = cells.groupBy("key").agg(F.min(F.struct("node", "size")).alias("first"), F.count(F.lit(1)).alias("n")).where("n > 1").select("key", F.col("first.node").alias("a"), F.col("first.size").alias("a_size"))
    buckets = stored(cells.join(first, "key"), "buckets")
    if buckets.isEmpty():
        return None
    texts = stored(_hashed(docs, nodes.select("node", "origin", "mark").join(buckets.select("node").distinct(), "node", "left_semi"), id_col, text_col), "words")
    pairs = buckets.withColumn("b_size", F.col("size")).where("node <> a").where(_close()).select("a", F.col("node").alias("b")).distinct()
    links = stored(_verified(pairs, texts).where("linked").select("a", "b"), "links")
    roots = components(links)
    rest = _rest_links(buckets.select("key", "node", "size"), roots, texts)
    return roots if rest is None else components(roots.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest))


def _classed(docs: DataFrame, id_col: str, text_col: str) -> tuple[DataFrame, bool]:
    """``doc_id, mark, root, class_id`` of every row, and whether an id has several texts.

    Root is null where a text has no word; else it is a class's number, and its smallest id if no id has several texts.
    """
    rows = stored(_sketched(docs, id_col, text_col), "sketches")
    first = F.min(F.when(F.col("doc_id").isNotNull(), F.struct("doc_id", "mark"))).alias("first")
    nodes = rows.where("digest is not null").groupBy("digest").agg(first, F.first("bands").alias("bands"), F.first("size").alias("size"))
    nodes = stored(nodes.select("digest", F.col("first.doc_id").alias("node"), F.col("first.doc_id").alias("origin"), F.col("first.mark").alias("mark"), "bands", "size"), "nodes")
    shared = nodes.where("node is not null").groupBy("node").agg(F.min("digest").alias("keeps"), F.count(F.lit(1)).alias("n")).where("n > 1").select("node", "keeps")
    several = not (shared := stored(shared, "shared-ids")).isEmpty()
    if several:  # the id names the text of least digest; the others get numbers of their own
        own = F.lit(-(1 << 62)) + F.pmod(F.xxhash64("digest"), F.lit(1 << 61))
        nodes = stored(nodes.join(shared, "node", "left").withColumn("node", F.when(F.col("keeps").isNotNull() & (F.col("digest") != F.col("keeps")), own).otherwise(F.col("node"))).drop("keeps"), "nodes")
    roots = _linked(docs, nodes, id_col, text_col)
    named = nodes.select("digest", F.col("node").alias("root"))
    if roots is not None:
        named = nodes.select("digest", "node").join(roots, "node", "left").select("digest", F.coalesce("root", "node").alias("root"))
    out = rows.select("doc_id", "mark", "digest").join(named, "digest", "left").select("doc_id", "mark", "root")
    if not several:
        return out.withColumn("class_id", F.coalesce("root", "doc_id")), False
    out = stored(out, "rooted")
    least = out.where("root is not null").groupBy("root").agg(F.min("doc_id").alias("least"))
    return out.join(least, "root", "left").select("doc_id", "mark", "root", F.coalesce("least", "doc_id").alias("class_id")), True


def classes(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(doc_id, class_id)``: the smallest id of the documents that links connect with each document, a row for each row of ``docs``."""
    return _classed(docs, id_col, text_col)[0].select("doc_id", "class_id")


def keep_first(docs: DataFrame) -> DataFrame:
    """Rows of ``docs`` without those of a class that has a smaller id.

    Of rows that repeat an id and a text one stays; where an id repeats with texts of one class, the text of least hash.
    Texts are shuffled only where an id repeats or more ids go than may be broadcast.  Rows without an id stay.
    """
    classed, several = _classed(docs, "doc_id", "text")
    named = stored(classed, "classes")
    spread = lambda gone: F.broadcast(gone) if gone.count() <= MOST_BROADCAST else gone
    if not several and named.where("doc_id is not null").groupBy("doc_id").count().where("count > 1").isEmpty():
        gone = named.where("doc_id <> class_id").select("doc_id").distinct()
        return docs.join(spread(gone), "doc_id", "left_anti").select(docs.columns)
    first = named.where("root is not null and doc_id is not null").groupBy("root").agg(F.min(F.struct("doc_id", "mark")).alias("first"))
    gone = named.where("doc_id is not null").join(first, "root").where("first <> struct(doc_id, mark)").select(F.col("doc_id").alias("id"), "mark").distinct()
    rows = docs.select(F.struct("*").alias("row"), F.col("doc_id").cast("long").alias("id"), F.xxhash64("text").alias("mark"))
    kept = rows.join(spread(gone), ["id", "mark"], "left_anti").select("row.*")
    return kept.where("doc_id is not null").dropDuplicates(["doc_id", "text"]).unionByName(kept.where("doc_id is null"))
