"""Whitening, fingerprints and the manifest against plain versions."""

from __future__ import annotations

import hashlib
import random
import zlib
from fractions import Fraction

import numpy as np
import pytest

from longbox.llm import fingerprint, merkle, whitening

DOCS = "doc_id long, source string, lang string, n_chars long, text string, tree string, place int, hash string, run int"


def sha(text: str) -> str:
    return hashlib.sha256(text.encode()).hexdigest()


def plain_tree(nodes: list[str]) -> tuple[str, list[list[tuple[str, str]]]]:
    """Top of a run-of-eight tree and each node's siblings, before and after, level by level."""
    level, proofs, at = list(nodes), [[] for _ in nodes], list(range(len(nodes)))
    while len(level) > 1:
        runs = [level[i : i + 8] for i in range(0, len(level), 8)]
        for k, p in enumerate(at):
            run = runs[p // 8]
            proofs[k].append(("".join(run[: p % 8]), "".join(run[p % 8 + 1 :])))
        level, at = [sha("".join(r)) for r in runs], [p // 8 for p in at]
    return level[0], proofs


def plain_manifest(rows: list[tuple]) -> list[tuple]:
    def leaf(row: tuple) -> str:
        return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))

    def lowered(text: str | None) -> str | None:
        return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)

    trees: dict = {}
    for row in rows:
        trees.setdefault(row[2], []).append(row)
    order = sorted(trees, key=lambda x: (x is not None, (x or "").encode()))
    for lang in order:
        trees[lang].sort(key=lambda r: (r[0] is not None, r[0] or 0, leaf(r)))
    built = {lang: plain_tree([leaf(r) for r in trees[lang]]) for lang in order}
    root, above = plain_tree([built[lang][0] for lang in order])
    out = []
    for k, lang in enumerate(order):
        for row, own in zip(trees[lang], built[lang][1], strict=True):
            proof = own + above[k]
            tampered = row[0] is not None and zlib.crc32(str(row[0]).encode()) % 3 == 0
            h = leaf((*row[:4], lowered(row[4]))) if tampered else leaf(row)
            for before, after in proof:
                h = sha(before + h + after)
            out.append((row[0], leaf(row), built[lang][0], root, sha("".join(a + b for a, b in proof)), h, h == root))
    return out


def rows_of(df) -> list[tuple]:
    return sorted((tuple(r) for r in df.collect()), key=repr)


@pytest.mark.parametrize("sizes", [{"en": 1}, {"en": 75, None: 9, "Zz": 1, "é": 8, "de": 17, "": 2}, {f"l{k}": 1 + k % 3 for k in range(70)}])
def test_manifest_equals_plain_version(spark, sizes):
    rnd, docs = random.Random(3), []
    for lang, n in sizes.items():
        for _ in range(n):
            text = rnd.choice([None, "", "Some TEXT é", "x" * 70_000 if rnd.random() < 0.1 else "ÀB\n", f"T{rnd.random()}"])
            docs.append((rnd.choice([None, rnd.randint(-50, 10**12)]) if len(sizes) < 9 else rnd.randint(0, 40), rnd.choice([None, "web", "Ü"]), lang, rnd.choice([None, 7, -3]), text))
    docs += docs[:3]  # repeated rows
    rnd.shuffle(docs)
    df = spark.createDataFrame([(*d, "t", 1, "h", 2) for d in docs], DOCS).repartition(5)
    got = merkle.manifest(df)
    assert rows_of(got) == sorted(plain_manifest(docs), key=repr)


def test_manifest_of_an_empty_table(spark):
    assert merkle.manifest(spark.createDataFrame([], DOCS)).count() == 0


def test_a_changed_row_alone_fails(spark, sf_dir):
    rows = merkle.manifest(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    assert len({r.root for r in rows}) == 1
    for r in rows:
        changed = zlib.crc32(str(r.doc_id).encode()) % 3 == 0 and any("A" <= c <= "Z" for c in texts[r.doc_id] or "")
        assert r.verified == (not changed) == (r.folded_root == r.root)


# Fingerprints


def plain_counts(data: bytes) -> list[int]:
    counts = [0] * fingerprint.BUCKETS
    for start in range(len(data)):
        for salt, (i, j) in enumerate(fingerprint.KINDS):
            if start + j < len(data):
                x = data[start] | data[start + i] << 8 | data[start + j] << 16 | salt << 24
                x = (x ^ x >> 15) * 0x85EBCA6B & 0xFFFFFFFF
                x = (x ^ x >> 13) * 0xC2B2AE35 & 0xFFFFFFFF
                counts[x >> 24] += 1
    return counts


def test_bucket_counts_across_chunks(monkeypatch):
    rnd = random.Random(5)
    monkeypatch.setattr(fingerprint, "CHUNK", 50)
    for n in (0, 1, 2, 3, 4, 5, 49, 50, 51, 52, 53, 54, 55, 100, 101, 102, 333):
        data = rnd.randbytes(n)
        assert fingerprint.bucket_counts(data).tolist() == plain_counts(data), n


def test_difference_is_bounded_and_symmetric():
    rnd = random.Random(6)
    prints = [fingerprint.fingerprint(rnd.randbytes(rnd.choice([0, 2, 40, 3000]))) for _ in range(40)]
    for a in prints:
        assert fingerprint.likeness(a, a) == 1 and len(a) == 2 * (2 + fingerprint.BUCKETS // 4)
        for b in prints:
            assert 0 <= fingerprint.likeness(a, b) == fingerprint.likeness(b, a) <= 1
            codes = [[int(c, 16) >> s & 3 for c in x[4:] for s in (2, 0)] for x in (a, b)]
            score = sum((0, 1, 2, 6)[abs(p - q)] for p, q in zip(*codes, strict=True))
            score += 4 * sum(min(12, abs(int(a[k : k + w], 16) - int(b[k : k + w], 16))) for k, w in ((0, 2), (2, 1), (3, 1)))
            assert fingerprint.difference(a, b) == min(score, fingerprint.BOUND)


@pytest.mark.parametrize("parts", [1, 7])
def test_texts_meet_the_next(spark, parts):
    rnd = random.Random(8)
    words = ["alpha", "Ünter", "les", "mañana", "\n", "🎈🎈", "x"]
    texts = [None, "", "ab", "abc", "é" * 9, "long " * 12_000] + [" ".join(rnd.choices(words, k=rnd.randint(0, 60))) for _ in range(90)]
    docs = [(i * 3 - 20, t) for i, t in enumerate(texts)]
    docs.append((None, "without an id"))
    df = spark.createDataFrame([(i, t, 1, "r", "o") for i, t in docs], "doc_id long, text string, part int, role string, row string").repartition(parts)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    spark.conf.set("spark.sql.shuffle.partitions", str(parts))
    try:
        got = {r.doc_id: r for r in fingerprint.compared(df).collect()}
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    assert len(got) == len(docs)
    for (i, text), (_, following) in zip(docs, docs[1:] + docs[:1], strict=True):
        text, following = text or "", following or ""
        n = len(text) // 4
        new = text[: len(text) - n] + following[:n]
        a, b, c = (fingerprint.fingerprint(t.encode()) for t in (text, new, following))
        r = got[i]
        assert (r.n_chars, r.edited_sha256, r.fingerprint, r.edited_fingerprint) == (len(text), sha(new), a, b)
        assert (r.near_edited, r.near_next) == (fingerprint.likeness(a, b), fingerprint.likeness(a, c))


def test_few_rows(spark):
    one = spark.createDataFrame([(5, "a text of its own, long enough")], "doc_id long, text string")
    r = fingerprint.compared(one).collect()
    assert len(r) == 1 and r[0].near_next == 1 and r[0].edited_sha256 == sha("a text of its own, long" + "a text ")
    assert fingerprint.compared(one.limit(0)).count() == 0
    same = spark.createDataFrame([(5, "same")] * 3 + [(None, None)] * 2, "doc_id long, text string")
    assert fingerprint.compared(same).count() == 5
    assert fingerprint.fingerprints(same).select("fingerprint").distinct().count() == 2


def test_edited_texts_are_nearer_than_neighbours(spark, sf_dir):
    rows = fingerprint.compared(spark.read.parquet(f"{sf_dir}/documents.parquet")).collect()
    long = [r for r in rows if r.n_chars >= 200]
    assert sum(r.near_edited > r.near_next for r in long) >= 0.95 * len(long)


# Whitening


def plain_whitening(vectors: list, k: int = 8):
    kept = [i for i, v in enumerate(vectors) if v is not None and all(c is not None and np.isfinite(c) for c in v)]
    x = [[int(np.floor(1024 * float(c))) + 100_000 for c in vectors[i]] for i in kept]
    n, d = len(x), len(x[0])
    sums = [sum(r[j] for r in x) for j in range(d)]
    away = [[n * r[j] - sums[j] for j in range(d)] for r in x]
    v = np.array([[float(Fraction(sum(r[i] * r[j] for r in away), n**3)) for j in range(d)] for i in range(d)])
    values, axes = np.linalg.eigh(v)
    values, axes = values[::-1][:k], axes[:, ::-1][:, :k]
    return kept, [sum(a * a for a in r) for r in away], np.array(away, float) / n @ axes / np.sqrt(values), values / np.trace(v)


@pytest.mark.parametrize(("d", "spread"), [(3, 0.2), (130, 30.0)])
def test_whitening_equals_plain_version(spark, d, spread, monkeypatch):
    monkeypatch.setattr(whitening, "BLOCK_BYTES", 8 * d * 20)
    rng = np.random.default_rng(d)
    data = (rng.normal(size=(150, d)) * np.geomspace(1, 5, d) * spread).astype(np.float32).tolist()
    data[3], data[7][1], data[11][0], data[13][2] = None, None, float("nan"), float("-inf")
    data[17] = data[18]
    df = spark.createDataFrame([(i // 2, v, "x", 1) for i, v in enumerate(data)], "vec_id long, embedding array<float>, k string, value int").repartition(6)
    got = whitening.whitened(df).collect()
    kept, deviations, values, explained = plain_whitening(data)
    k = min(8, d)
    assert len(got) == k * len(kept) and {r.n for r in got} == {len(kept)}
    assert sorted(r.deviation for r in got if r.component == 1) == sorted(deviations)
    for j in range(k):
        mine = np.array(sorted(r.whitened for r in got if r.component == j + 1))
        want = np.sort(values[:, j])
        assert min(np.abs(mine - want).max(), np.abs(mine - np.sort(-want)).max()) < 1e-7
        assert all(abs(r.explained / explained[j] - 1) < 1e-9 for r in got if r.component == j + 1)
    assert len({r.identity_error for r in got}) == 1 and got[0].identity_error < 1e-9


def test_products_beyond_double_precision():
    rnd = random.Random(2)
    for bits in (10, 30, 40, 47):
        x = np.array([[rnd.randint(-(1 << bits), 1 << bits) for _ in range(3)] for _ in range(9)])
        want = [[sum(int(r[i]) * int(r[j]) for r in x) for j in range(3)] for i in range(3)]
        assert [[int(s) for s in row] for row in whitening.products(x, x)] == want
        limbs = np.array(whitening._limbs(whitening.products(x, x)), object).reshape(whitening._LIMBS, 3, 3)
        assert [[int(s) for s in row] for row in sum(limbs[k] << (32 * k) for k in range(whitening._LIMBS))] == want


def test_whitening_of_odd_tables(spark):
    schema = "vec_id long, embedding array<double>"
    assert whitening.whitened(spark.createDataFrame([], schema)).count() == 0
    assert whitening.whitened(spark.createDataFrame([(1, None), (2, [None]), (3, [1e300])], schema)).count() == 0
    sole = whitening.whitened(spark.createDataFrame([(1, [0.5, 2.0])], schema)).collect()
    assert [(r.component, r.n, r.deviation, r.whitened, r.explained, r.identity_error) for r in sole] == [(1, 1, 0, None, None, None), (2, 1, 0, None, None, None)]
    mixed = [(i, [float(i), 1.0]) for i in range(6)] + [(9, [1.0]), (None, [3.0, 1.0]), (10, [])]
    rows = whitening.whitened(spark.createDataFrame(mixed, schema)).collect()
    assert len(rows) == 14 and {r.n for r in rows} == {7} and sum(r.vec_id is None for r in rows) == 2
    assert all((r.whitened is None) == (r.component == 2) for r in rows) and rows[0].identity_error < 1e-9
