"""Degrees of layer plans: of the whole graph, and counted once for all layers."""

import numpy as np

from lamina.operators import message
from lamina.plans import layers as L
from lamina.plans import models

EDGES = [(0, 1), (0, 2), (0, 3), (1, 0), (2, 0), (3, 2), (4, 1), (1, 4)]


def test_degrees_are_counted_once_and_over_the_whole_graph(spark, monkeypatch):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    nodes = spark.createDataFrame([(i, [i + 1.0, i / 2.0, 3.0 - i]) for i in range(5)], "id long, x array<double>")
    counted, count = [], message.degrees
    monkeypatch.setattr(message, "degrees", lambda e, end: counted.append(end) or count(e, end))
    plan, start = models.gcn([3, 4, 2])
    want = {r.id: r.x for r in plan.run(L.Graph(edges, nodes.select("id")), {start: nodes})[0].collect()}
    assert sorted(counted) == ["dst", "src"]
    plan, start = models.gcn([3, 4, 2])
    got = plan.run(L.Graph(edges, nodes.select("id")), {start: nodes}, targets=spark.createDataFrame([(1,), (3,)], "id long"))[0].collect()
    assert {r.id for r in got} == {1, 3} and all(np.allclose(r.x, want[r.id]) for r in got)
