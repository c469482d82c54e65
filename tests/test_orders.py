"""Orders and partitions against their sequential definitions."""

import random

import pytest

from lamina.operators import order


def sequential(edges, n):
    near = {i: set() for i in range(n)}
    for a, b in edges:
        if a != b:
            near[a].add(b)
            near[b].add(a)
    key = lambda i: (len(near[i]), i)
    out, taken = [], set()
    for root in sorted(range(n), key=key):
        if root in taken:
            continue
        queue, comp = [root], {root}
        for x in queue:
            fresh = sorted(near[x] - comp, key=key)
            comp.update(fresh)
            queue += fresh
        taken |= comp
        out += queue
    return out


@pytest.mark.parametrize("seed", range(3))
def test_cuthill_mckee_is_the_sequential_order(spark, seed):
    rng = random.Random(seed)
    n = 40
    edges = [(rng.randrange(n), rng.randrange(n)) for _ in range((20, 45, 90)[seed])] + [(3, 3), (0, 1), (1, 0), (0, 1)]
    want = sequential(edges, n)
    frames = spark.createDataFrame(edges, "src long, dst long"), spark.range(n).select("id")
    got = order.cuthill_mckee(*frames, reverse=False)
    assert [r.id for r in sorted(got.collect(), key=lambda r: r.pos)] == want
    back = order.cuthill_mckee(*frames)
    assert [r.id for r in sorted(back.collect(), key=lambda r: r.pos)] == want[::-1]


def test_cuthill_mckee_without_edges_or_nodes(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert sorted(map(tuple, order.cuthill_mckee(none, spark.range(3).select("id"), reverse=False).collect())) == [(0, 0, 0), (1, 0, 1), (2, 0, 2)]
    assert order.cuthill_mckee(none, spark.range(0).select("id")).count() == 0


def test_balanced_parts_cut_few_edges_within_their_bound(spark):
    rng = random.Random(4)
    block = 30
    edges = [(b * block + rng.randrange(block), b * block + rng.randrange(block)) for b in range(4) for _ in range(250)] + [(rng.randrange(120), rng.randrange(120)) for _ in range(40)]
    frames = spark.createDataFrame(edges, "src long, dst long"), spark.range(120).select("id")
    start = order.balanced_parts(*frames, 4, rounds=0)
    found = order.balanced_parts(*frames, 4, rounds=12)
    part = {r.id: r.part for r in found.collect()}
    assert sorted(part) == list(range(120)) and max(sum(p == k for p in part.values()) for k in range(4)) <= 33
    cut = order.edge_cut(frames[0], found).first()
    assert (cut.cut, cut.edges) == (sum(part[a] != part[b] for a, b in edges), sum(a != b for a, b in edges))
    assert cut.cut < 0.7 * order.edge_cut(frames[0], start).first().cut
    assert order.balanced_parts(frames[0].limit(0), spark.range(0).select("id"), 3).count() == 0
    assert {r.part for r in order.balanced_parts(frames[0].limit(0), spark.range(6).select("id"), 3).collect()} == {0, 1, 2}
