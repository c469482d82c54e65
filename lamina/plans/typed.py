"""Layer-wise runs of models over typed graphs: edges (src_type, etype, dst_type, src, dst), nodes (ntype, id, x)."""

from __future__ import annotations

import time
from collections.abc import Callable, Mapping, Sequence

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense as D
from ..operators.durable import durable

#: (edges, nodes) -> (ntype, id, x), one row for each node.
Layer = Callable[[DataFrame, DataFrame], DataFrame]

_KEY = ["ntype", "id"]


def restrict(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """In-edges of the seeds (ntype, id), of all relations."""
    ends = seeds.select(F.col("ntype").alias("dst_type"), F.col("id").alias("dst")).distinct()
    return edges.join(ends, ["dst_type", "dst"], "left_semi").select(*edges.columns)


def hops(edges: DataFrame, seeds: DataFrame, n: int) -> list[DataFrame]:
    """Nodes (ntype, id) needed at each of n layers, from the inputs of the first to the seeds."""
    out = [seeds.select(*_KEY).distinct()]
    for _ in range(n):
        sources = restrict(edges, out[-1]).select(F.col("src_type").alias("ntype"), F.col("src").alias("id"))
        out.append(out[-1].unionByName(sources).distinct())
    return out[::-1]


def run(
    layers: Sequence[Layer], edges: DataFrame, nodes: DataFrame, targets: DataFrame | None = None,
    keep: Callable[[DataFrame], DataFrame] = durable, after: Callable[[int, DataFrame, float], None] | None = None,
) -> DataFrame:
    """(ntype, id, x) of the last layer. The result of each layer but the last is made durable by keep before the next reads it.

    With targets (ntype, id), each layer runs over the nodes only that the later ones need, and the result has rows for the
    targets. after(layer number, its table, seconds) is called once a layer is done; the last is not, as nothing has run it yet.
    """
    edges = keep(edges)
    needed = [keep(t) for t in hops(edges, targets, len(layers))] if targets is not None else None
    x = nodes.join(needed[0], _KEY, "left_semi") if needed else nodes
    for k, layer in enumerate(layers):
        began = time.perf_counter()
        if k == 0:
            x = keep(x)  # read once for each relation
        x = layer(restrict(edges, needed[k + 1]) if needed else edges, x)
        if needed:
            x = x.join(needed[k + 1], _KEY, "left_semi")
        if k < len(layers) - 1:
            x = keep(x)
            if after:
                after(k, x, time.perf_counter() - began)
    return x


def embedded(nodes: DataFrame, features: DataFrame, learned: DataFrame, projections: Mapping[str, np.ndarray] | None = None) -> DataFrame:
    """(ntype, id, x) for each of nodes (ntype, id): its features, or where it has none its row of the learned table; nodes in neither are left out.

    features and learned are (ntype, id, x). projections maps a type to the weights that its features are multiplied with.
    """
    projections = projections or {}
    own = nodes.select(*_KEY)
    rest = features.where(~F.col("ntype").isin(*projections)) if projections else features
    given = rest.select(*_KEY, "x").join(own, _KEY, "left_semi")
    for ntype, w in projections.items():
        projected = features.where(F.col("ntype") == ntype).join(own, _KEY, "left_semi").select(*_KEY, D.linear("x", w).alias("x"))
        given = given.unionByName(projected)
    without = own.join(features.select(*_KEY), _KEY, "left_anti")
    return given.unionByName(learned.select(*_KEY, "x").join(without, _KEY, "left_semi"))
