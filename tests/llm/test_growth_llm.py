"""What near-duplicate comparison does in a block grows with texts that are alike, not with all pairs."""

from __future__ import annotations

import itertools
import random

import numpy as np
import pytest

from longbox.llm import order_minhash


def edited(words, rnd, edits, most):
    out = list(words)
    for _ in range(edits):
        kind, i = rnd.randrange(3), rnd.randrange(len(out) + 1)
        if kind == 0:
            out.insert(i, rnd.randrange(most))
        elif out and kind == 1:
            out.pop(min(i, len(out) - 1))
        elif out:
            out[min(i, len(out) - 1)] = rnd.randrange(most)
    return out


def groups(n, links):
    root = list(range(n))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = find(a), find(b)
        root[max(x, y)] = min(x, y)
    return [find(i) for i in range(n)]


def test_few_pairs_of_a_family_are_counted(monkeypatch):
    rnd = random.Random(2)
    shared = [f"s{i}" for i in range(20)]
    texts = [[*shared, *(f"w{int(rnd.paretovariate(0.4))}" for _ in range(60))] for _ in range(600)]
    texts[500] = [*texts[7][:-3], "x", "y", "z"]
    counted = [0]
    real = order_minhash._Shared.__call__

    def call(self, left, right):
        counted[0] += np.size(left) * np.size(right)
        return real(self, left, right)

    monkeypatch.setattr(order_minhash._Shared, "__call__", call)
    sequences, nodes = [order_minhash.hashed(t) for t in texts], np.arange(600)
    found = order_minhash.block_links(np.tile(nodes, 2), np.tile(nodes, 2), np.repeat([0, 1], 600), sequences * 2)
    assert [tuple(sorted(x)) for x in found] == [(7, 500)]
    assert 0 < counted[0] < 600 * 600 / 20


@pytest.mark.parametrize("size, most", [(1, 3), (2, 3), (4, 5), (9, 6), (12, 400), (30, 50), (70, 400), (70, 4)])
def test_blocks_link_what_brute_force_links(size, most):
    rnd = random.Random(size)
    bases = [[rnd.randrange(most) for _ in range(size)] for _ in range(3)]
    words = [edited(rnd.choice(bases), rnd, rnd.randrange(0, size // 4 + 2), most) or [0] for _ in range(50)]
    sequences, nodes = [order_minhash.hashed([f"w{x}" for x in w]) for w in words], np.arange(50)
    every = groups(50, [p for p in itertools.combinations(range(50), 2) if order_minhash.aligned(sequences[p[0]], sequences[p[1]])])
    for side in (1, 2):  # both sides in one block: pairs that two blocks would meet are compared once
        found = order_minhash.block_links(np.tile(nodes, 2), np.tile(nodes, 2), np.repeat([0, side], 50), sequences * 2)
        assert groups(50, found) == every


def test_texts_align_side_by_side_as_one_by_one():
    rnd = random.Random(6)
    met = 0
    for size, most in itertools.product((1, 3, 7, 8, 9, 15, 16, 63, 64, 65, 130), (2, 6, 500)):
        base = [rnd.randrange(most) for _ in range(size)]
        others = [np.array(edited(base, rnd, rnd.randrange(0, size // 4 + 2), most), np.uint64) for _ in range(8)]
        want = [order_minhash.aligned(np.array(base, np.uint64), b) for b in others]
        assert order_minhash.aligned_with(np.array(base, np.uint64), others).tolist() == want
        met += sum(want)
    assert 50 < met < 200
