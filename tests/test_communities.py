"""Merging by modularity gain, replayed with a modularity computed from its definition."""

import random
from collections import Counter
from fractions import Fraction

import pytest

from lamina.operators import communities


def modularity(edges, of):
    ends = [(a, b) for a, b in edges if a != b]
    k = Counter(x for e in ends for x in e)
    inside, degree = sum(of[a] == of[b] for a, b in ends), Counter()
    for x, n in k.items():
        degree[of[x]] += n
    return Fraction(inside, len(ends)) - sum(Fraction(d, 2 * len(ends)) ** 2 for d in degree.values())


def graph_of(seed):
    rng = random.Random(seed)
    if seed == 0:  # a hub, its leaves, a far pair, a loop and repeated edges
        return 14, [(0, k) for k in range(1, 9)] + [(1, 2), (3, 4), (3, 4), (4, 3), (10, 11), (12, 12)]
    n, block = 40, 10
    return n, [(b * block + rng.randrange(block), b * block + rng.randrange(block)) for b in range(4) for _ in range(25)] + [(rng.randrange(n), rng.randrange(n)) for _ in range(10)]


@pytest.mark.parametrize(("seed", "small"), [(0, 0), (0, 100_000), (1, 100_000)])
def test_every_merge_gains_and_the_order_is_depth_first(spark, monkeypatch, seed, small):
    monkeypatch.setattr(communities, "SMALL_ROUND", small)
    n, edges = graph_of(seed)
    frames = spark.createDataFrame(edges, "src long, dst long"), spark.range(n).select("id")
    made = sorted(map(tuple, communities.merges(*frames).collect()), key=lambda r: (r[2], r[1], r[3]))
    of, layout = {i: i for i in range(n)}, {i: [i] for i in range(n)}
    for child, parent, _, at in made:
        before = modularity(edges, of)
        assert at == len(layout[parent])
        layout[parent] += layout.pop(child)
        of.update((x, parent) for x in layout[parent])
        assert modularity(edges, of) > before
    for a in layout:  # nothing is left to gain
        for b in layout:
            if a < b:
                assert modularity(edges, {i: a if c == b else c for i, c in of.items()}) <= modularity(edges, of)
    want = [x for top in sorted(layout, key=lambda t: (-len(layout[t]), t)) for x in layout[top]]
    got = sorted(communities.community_order(*frames).collect(), key=lambda r: r.pos)
    assert [(r.id, r.pos) for r in got] == [(x, p) for p, x in enumerate(want)]
    assert {r.id: r.community for r in got} == of
    found = communities.modularity(frames[0], spark.createDataFrame(list(of.items()), "id long, community long")).first()[0]
    assert found == pytest.approx(float(modularity(edges, of)))


def test_without_edges_or_nodes(spark):
    none = spark.createDataFrame([], "src long, dst long")
    assert sorted(map(tuple, communities.community_order(none, spark.range(3).select("id")).collect())) == [(0, 0, 0), (1, 1, 1), (2, 2, 2)]
    assert communities.community_order(none, spark.range(0).select("id")).count() == 0
    assert communities.modularity(none, spark.createDataFrame([], "id long, community long")).first()[0] is None
