"""Training-data operators do the whole job, in all letter cases and sizes."""

from __future__ import annotations

import random
import tracemalloc

import numpy as np
import pytest

from longbox.llm import order_minhash, private

SPELLED = [("write ", "bob (at) example (dot) com", " now"), ("mail ", "kim[at]host.example.org", " for more"), ("write to ", "ann.lee at mail dot org", " before noon")]


@pytest.mark.parametrize("change", [str.lower, str.upper, str.title, lambda t: t.replace("at", "At").replace("dot", "Dot"), lambda t: t.replace("(at)", "[AT]").replace("(dot)", "[DOT]")])
def test_spelled_addresses_in_any_case(spark, change):
    texts = [f"{more}{a}{change(b)}{c}" for more in ("", "room 12 floor 3 and then some more words follow here , ") for a, b, c in SPELLED]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.spans for r in private.find(docs).collect()}
    clean = {r.doc_id: r.text for r in private.redact(docs).collect()}
    for k, text in enumerate(texts):
        b = change(SPELLED[k % 3][1])
        assert found[k] == f"email:{text.index(b)}:{text.index(b) + len(b)}"
        assert clean[k] == text.replace(b, "<EMAIL>")


def family(n: int) -> list[list[str]]:
    """Short texts of one template with a changed slot: many shared windows, similarity below the threshold."""
    rnd = random.Random(5)
    words = [f"w{i}" for i in range(44)]
    return [[*words[:20], *(f"s{k}x{i}" for i in range(rnd.choice([6, 7, 8]))), *words[27:]] for k in range(n)]


def test_blocks_of_short_texts_stay_small(monkeypatch):
    monkeypatch.setattr(order_minhash, "MATRIX_CELLS", 1_000_000)
    words = family(2000)
    words[7], words[1999] = words[3][:-1] + ["x"], words[1500][:-1] + ["y"]
    sequences = [order_minhash.hashed(w) for w in words]
    nodes = np.arange(2000)
    tracemalloc.start()
    found = order_minhash.block_links(np.tile(nodes, 2), np.tile(nodes, 2), np.repeat([0, 1], 2000), sequences * 2)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert {tuple(sorted(x)) for x in found} == {(3, 7), (1500, 1999)}
    assert peak < 60e6  # all 4 million pairs at once take over 100 MB


def test_families_are_split_by_rows(spark, monkeypatch):
    words = family(30)
    words[7] = words[3][:-1] + ["x"]
    words[8] = words[3][:-2] + ["x", "y"]
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(words)], "doc_id long, text string")
    blocks = []
    monkeypatch.setattr(order_minhash, "BLOCK_ROWS", 10, raising=False)
    real = order_minhash.stored

    def stored(rows, name):
        out = real(rows, name)
        if name == "families":
            blocks.extend(out.select("wide").distinct().collect())
        return out

    monkeypatch.setattr(order_minhash, "stored", stored)
    got = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert got == {i: 3 if i in (7, 8) else i for i in range(30)}
    assert blocks and max(b.wide for b in blocks) == 3


def test_ids_with_several_texts_are_told_apart(spark):
    a, b, c = (" ".join(f"{x}{i}" for i in range(60)) for x in "abc")
    rows = [(7, a), (7, a), (7, b), (3, b), (9, c), (9, None), (9, None), (None, a), (2, a.replace(" ", "  ")), (2, a)]
    docs = spark.createDataFrame([(i, t, "x") for i, t in rows], "doc_id long, text string, mark string")
    got = sorted(((r.doc_id, r.class_id) for r in order_minhash.classes(docs).collect()), key=str)
    assert got == sorted([(7, 2), (7, 2), (7, 3), (3, 3), (9, 9), (9, 9), (9, 9), (None, 2), (2, 2), (2, 2)], key=str)
    kept = sorted(((r.doc_id, r.text is None, (r.text or "")[:2]) for r in order_minhash.keep_first(docs).collect()), key=str)
    assert kept == sorted([(3, False, "b0"), (9, False, "c0"), (9, True, ""), (None, False, "a0"), (2, False, "a0")], key=str)


def test_recall_on_the_generated_documents(spark):
    """Every pair of the table that brute force aligns ends in one class."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in docs.where("text is not null").collect()}
    windows = {i: order_minhash.hashed(order_minhash.words_of(t)) for i, t in texts.items()}
    ids = sorted(windows)
    n = np.array([len(windows[i]) for i in ids])
    twos = [order_minhash.labelled(order_minhash.windows(windows[i], 2)) for i in ids]
    owner = np.repeat(np.arange(len(ids)), [len(x) for x in twos])
    kind = np.unique(np.concatenate(twos), return_inverse=True)[1]
    linked = []
    for k, a in enumerate(ids):
        mine = np.zeros(kind.max() + 1, bool)
        mine[kind[owner == k]] = True
        shared = np.bincount(owner[mine[kind]], minlength=len(ids))
        able = (np.minimum(n, n[k]) >= 0.8 * np.maximum(n, n[k])) & (shared >= (n + n[k]) / 3 - 1)  # what a link needs
        linked += [(a, ids[j]) for j in np.flatnonzero(able) if j > k and order_minhash.aligned(windows[a], windows[ids[j]])]
    named = {r.doc_id: r.class_id for r in order_minhash.classes(docs).collect()}
    assert len(linked) > 50 and sum(named[a] == named[b] for a, b in linked) >= 0.99 * len(linked)


def test_short_texts_share_a_band():
    rnd = random.Random(8)
    missed = 0
    for _ in range(1500):
        words = [f"w{rnd.randrange(10**6)}" for _ in range(8)]
        missed += not set(order_minhash.sketch(words).tolist()) & set(order_minhash.sketch([*words, "more"]).tolist())
    assert missed <= 2


def test_hubs_join_like_other_nodes(spark, monkeypatch):
    monkeypatch.setattr(order_minhash, "HUB_EDGES", 3)
    monkeypatch.setattr(order_minhash, "CHUNK_LINKS", 5)
    links = [(50, 100 + i) for i in range(40)] + [(100 + i, 200 + i) for i in range(20)] + [(300, 301)]
    got = {r.node: r.root for r in order_minhash.components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert got == {x: 300 if x >= 300 else 50 for link in links for x in link}
