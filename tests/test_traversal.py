"""One-hop traversal against reading pages one after another."""

from __future__ import annotations

import random

import pytest

from longbox.operators import traversal

SEEDS, LINKS, PAGES = "key string, nth long", "key string, position int, target string, kind string", "key string, final string"


def one_after_another(seeds, links, final, seen, skip):
    stored, out = set(seen), []
    for _, key in sorted((n, k) for k, n in seeds):
        page = final.get(key)
        if page is None or page in stored:
            continue
        stored.add(page)
        out.append((page, page, 0, 0))
        for position, target, kind in sorted((p, t, k) for k0, p, t, k in links if final.get(k0) == page):
            target = final.get(target)
            if kind not in skip and target is not None and target not in stored:
                stored.add(target)
                out.append((target, page, 1, position))
    return sorted(out)


@pytest.mark.parametrize("n", [12, 60])
def test_random_graphs(spark, n):
    rnd = random.Random(n)
    names = [f"p{i:02d}" for i in range(n)]
    final = {k: k for k in names} | {f"old{i}": names[i] for i in range(n // 2)}
    keys = list(final) + ["lost"]
    links = [(rnd.choice(names), i, rnd.choice(keys), rnd.choice(["issue", "novel"])) for i in range(3 * n)]
    seeds = [(k, rnd.randrange(n)) for k in rnd.sample(keys, n)]
    seen = [names[0], names[3]]
    frames = spark.createDataFrame(seeds, SEEDS), spark.createDataFrame(links, LINKS), spark.createDataFrame([*final.items(), ("lost", ""), (None, "x")], PAGES)
    got = traversal.one_hop(*frames, spark.createDataFrame([(s,) for s in seen], "page string"), ("novel",))
    assert sorted(tuple(r) for r in got.collect()) == one_after_another(seeds, links, final, seen, ("novel",))


def test_cycle_chain_and_two_seeds_of_a_page(spark):
    pages = spark.createDataFrame([(k, k) for k in "abcde"] + [("A", "a"), ("B", "b")], PAGES)
    links = spark.createDataFrame([("a", 2, "B", None), ("a", 1, "A", None), ("b", 1, "c", None), ("c", 1, "a", None), ("c", 2, "d", None)], LINKS)
    seeds = spark.createDataFrame([("A", 1), ("a", 2), ("b", 3), ("c", 4), (None, 0), ("gone", 0)], SEEDS)
    got = sorted(tuple(r) for r in traversal.one_hop(seeds, links, pages).collect())
    assert got == [("a", "a", 0, 0), ("b", "a", 1, 2), ("c", "c", 0, 0), ("d", "c", 1, 2)]
    assert traversal.one_hop(seeds.where("false"), links, pages).count() == 0
    assert traversal.one_hop(seeds, links.where("false"), pages).count() == 3
