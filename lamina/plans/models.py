"""Graph models as layer plans. Weights are inputs: by default the fixed ones of functions.dense.

Degrees are those of the whole graph, dropout is off, and zero in-degree gives zero sums.
"""

from __future__ import annotations

from collections.abc import Mapping

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import dense as D
from ..functions import vectors as V
from ..operators import message as M
from ..operators.durable import durable
from . import layers as L
from . import typed


def gcn(widths: list[int]) -> tuple[L.Plan, L.Step]:
    """relu(norm(A) x W + b) for each layer, the last included. W comes first where it makes rows narrower."""
    x = start = L.source(widths[0])
    for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        w, c = D.weights(k, a, b), D.bias(k, b)
        if b < a:
            x = L.normalised(f"conv{k}", L.node_map(f"proj{k}", b, lambda v, w=w: D.linear(v, w), x))
            x = L.node_map(f"act{k}", b, lambda v, c=c: V.relu(V.add(v, F.array(*map(F.lit, c.tolist())))), x)
        else:
            x = L.node_map(f"act{k}", b, lambda v, w=w, c=c: V.relu(D.linear(v, w, c)), L.normalised(f"conv{k}", x))
    return L.Plan((x,)), start


def sage(widths: list[int]) -> tuple[L.Plan, L.Step]:
    """x W_self + mean of neighbours W_neigh + b, relu between layers."""
    x = start = L.source(widths[0])
    for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        own, near, c = D.weights(2 * k, a, b), D.weights(2 * k + 1, a, b), D.bias(k, b)
        mean = L.propagate(f"mean{k}", L.node_map(f"near{k}", b, lambda v, w=near: D.linear(v, w), x), how="mean")
        last = k == len(widths) - 2
        self_ = L.node_map(f"self{k}", b, lambda v, w=own, c=c: D.linear(v, w, c), x)
        x = L.node_map(f"sage{k}", b, (lambda u, v: V.add(u, v)) if last else (lambda u, v: V.relu(V.add(u, v))), self_, mean)
    return L.Plan((x,)), start


def gat(in_width: int, width: int, heads: int, layers: int = 2, slope: float = 0.2) -> tuple[L.Plan, L.Step]:
    """Attention over in-edges; heads side by side in hidden layers and averaged in the last; residual on all but the first; no activation on the last, elu left out for leaky relu."""
    x = start = L.source(in_width)
    for k in range(layers):
        w = D.weights(k, x.width, heads * width)
        att_l, att_r = D.weights(10 + k, heads, width) / 4, D.weights(20 + k, heads, width) / 4
        h = L.node_map(f"head{k}", heads * width, lambda v, w=w: D.linear(v, w), x)

        def attend(graph: L.Graph, tables, att_l=att_l, att_r=att_r) -> DataFrame:
            side = lambda a: F.array(*[V.dot(F.slice("x", i * width + 1, width), F.array(*map(F.lit, a[i].tolist()))) for i in range(heads)])
            each, cells = range(heads), graph.cells()
            leaky = lambda v: F.when(v >= 0, v).otherwise(v * slope)
            # Each end's part of the score is computed on nodes, not on edges; scores aren't written.
            nodes = cells.keep(tables[0].select("id", "x", side(att_l).alias("l"), side(att_r).alias("r")).repartition(cells.store.buckets, "id"), "id")
            edges, at_src = cells.edges(None), lambda *cols: nodes.select(F.col("id").alias("src"), *cols)
            # A score grows with the source's part, so the greatest part gives a destination's greatest score.
            top = M.reduced(cells.met(edges, None, "src", at_src("l")), "max", heads, "l")
            top = cells.keep(nodes.join(top.withColumnRenamed("x", "top"), "id").select(F.col("id").alias("dst"), "r", F.array(*[leaky(F.col("top")[h] + F.col("r")[h]) for h in each]).alias("top")))
            met = cells.met(cells.met(edges, None, "src", at_src("l", F.col("x").alias("u"))), None, "dst", top)
            by = met.select("dst", "u", F.array(*[F.exp(leaky(F.col("l")[h] + F.col("r")[h]) - F.col("top")[h]) for h in each]).alias("by"))
            summed = M.reduced(by.select("dst", F.concat(V.heads_scaled("u", "by", heads, width), "by").alias("m")), "sum", heads * (width + 1))
            share = F.array(*[F.col("x")[h * width + i] / F.col("x")[heads * width + h] for h in each for i in range(width)])
            return M.fill_missing(summed.select("id", share.alias("x")), graph.nodes, heads * width)

        out = L.custom(f"attend{k}", heads * width, attend, h)
        if k:
            res = D.weights(30 + k, x.width, heads * width)
            out = L.add(f"res{k}", out, L.node_map(f"resproj{k}", heads * width, lambda v, w=res: D.linear(v, w), x))
        if k == layers - 1:
            x = L.node_map("heads", width, lambda v: V.heads_mean(v, heads, width), out)
        else:
            x = L.node_map(f"act{k}", heads * width, lambda v: V.leaky_relu(v, 0.01), out)
    return L.Plan((x,)), start


def jknet(in_width: int, hidden: int, out_width: int, layers: int = 2, mode: str = "cat") -> tuple[L.Plan, L.Step]:
    """Graph convolutions with relu, joined by cat or max, summed over neighbours, then linear."""
    start = L.source(in_width)
    x, kept = start, []
    for k in range(layers):
        w, c = D.weights(k, x.width, hidden), D.bias(k, hidden)
        x = L.node_map(f"act{k}", hidden, lambda v, w=w, c=c: V.relu(D.linear(v, w, c)), L.normalised(f"conv{k}", x))
        kept.append(x)
    if mode == "cat":
        joined = L.node_map("jump", hidden * layers, lambda *vs: F.concat(*vs), *kept)
    else:
        joined = L.node_map("jump", hidden, lambda *vs: _maximum(vs), *kept)
    w = D.weights(9, joined.width, out_width)
    return L.Plan((L.node_map("out", out_width, lambda v: D.linear(v, w, D.bias(9, out_width)), L.propagate("sum", joined)),)), start


def _maximum(vs):
    out = vs[0]
    for v in vs[1:]:
        out = V.zipped(out, v, lambda a, b: F.greatest(a, b))
    return out


def sum_net(widths: list[int]) -> tuple[L.Plan, L.Step]:
    """Three convolutions whose outputs are added; all hidden widths equal the last."""
    x = start = L.source(widths[0])
    kept = []
    for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
        w = D.weights(k, a, b)
        x = L.node_map(f"x{k + 1}", b, lambda v, w=w: V.relu(D.linear(v, w)), L.normalised(f"conv{k}", x))
        kept.append(x)
    return L.Plan((L.add("sum", *kept[::-1]),)), start


def branching_net(in_width: int, width: int) -> tuple[L.Plan, L.Step]:
    """Eight convolutions in a branching graph with a mean over all nodes inside, over features projected to width."""
    start = L.source(in_width)
    first = L.node_map("x0", width, lambda v: D.linear(v, D.weights(0, in_width, width) / 16), start)
    conv = lambda k, x: L.node_map(f"x{k}", width, lambda v: D.linear(v, D.weights(k, width, width) / 4), L.normalised(f"conv{k}", x))
    x1 = conv(1, first)
    x2, x3 = conv(2, x1), conv(3, x1)
    m = L.add("shifted", x2, L.global_mean("mean", x3))
    x4, x5 = conv(4, m), conv(5, x2)
    x6 = conv(6, L.add("x4+x5", x4, x5))
    x7 = conv(7, L.add("x3+x6", x3, x6))
    return L.Plan((L.add("out", conv(8, x7), x5),)), start


Relation = tuple[str, str, str]


def rgcn_layer(edges: DataFrame, nodes: DataFrame, relations: list[Relation], in_width: int, out_width: int, layer: int = 0, act: bool = True, how: str = "sum") -> DataFrame:
    """(ntype, id, x): a linear map and mean for each relation, reduced over the relations into a type; types without relation get zeros."""
    out = None
    for ntype in sorted({r[0] for r in relations} | {r[2] for r in relations}):
        own = nodes.where(F.col("ntype") == ntype).select("id")
        parts = []
        for k, (s, e, d) in enumerate(relations):
            if d != ntype:
                continue
            w, c = D.weights(layer * 10 + k, in_width, out_width), D.bias(layer * 10 + k, out_width)
            src = nodes.where(F.col("ntype") == s).select("id", D.linear("x", w, c).alias("x"))
            of = edges.where((F.col("src_type") == s) & (F.col("etype") == e) & (F.col("dst_type") == d))
            parts.append(M.fill_missing(M.update_all(of, src, "copy_u", "mean", out_width), own, out_width))
        total = M.cross_reduced(parts, how, out_width) if parts else own.select("id", V.zeros(out_width).alias("x"))
        total = total.select(F.lit(ntype).alias("ntype"), "id", (V.leaky_relu("x") if act else F.col("x")).alias("x"))
        out = total if out is None else out.unionByName(total)
    return out


def rgcn_basis_layer(edges: DataFrame, nodes: DataFrame, relations: list[Relation], in_width: int, out_width: int, n_bases: int, act: bool = True) -> DataFrame:
    """(ntype, id, x): sums normalised by in-degree with weights from bases (if fewer than relations), a self-loop weight and a bias, summed over relations."""
    coeff = D.weights(3, len(relations), n_bases)
    bases = np.stack([D.weights(4 + b, in_width, out_width) for b in range(n_bases)])
    w = D.basis_weights(coeff, bases) if n_bases < len(relations) else np.stack([D.weights(4 + r, in_width, out_width) for r in range(len(relations))])
    loop, c = D.weights(2, in_width, out_width), D.bias(2, out_width)
    out = None
    for ntype in sorted({r[0] for r in relations} | {r[2] for r in relations}):
        own = nodes.where(F.col("ntype") == ntype)
        parts = [own.select("id", D.linear("x", loop, c).alias("x"))]
        for k, (s, e, d) in enumerate(relations):
            if d == ntype:
                of = edges.where((F.col("src_type") == s) & (F.col("etype") == e) & (F.col("dst_type") == d))
                src = nodes.where(F.col("ntype") == s).select("id", D.linear("x", w[k]).alias("x"))
                parts.append(M.fill_missing(M.update_all(of, src, "copy_u", "mean", out_width), own, out_width))
        total = M.cross_reduced(parts, "sum", out_width)
        total = total.select(F.lit(ntype).alias("ntype"), "id", (V.relu("x") if act else F.col("x")).alias("x"))
        out = total if out is None else out.unionByName(total)
    return out


def hgt_layer(edges: DataFrame, nodes: DataFrame, relations: list[Relation], width: int, heads: int, skip: Mapping[str, float] | float = 0.5, norm: bool = True, priors: Mapping[Relation, list[float]] | None = None, layer: int = 0) -> DataFrame:
    """(ntype, id, x): k, q, v by type, attention and message maps by relation, softmax over in-edges, mean over the relations into a type, gated skip, layer norm.

    priors: for each relation a factor of the scores of each head.

    The mean counts every relation into the type, those without an edge at a node as zeros.
    """
    d = width // heads
    types = sorted({r[0] for r in relations} | {r[2] for r in relations})
    tables = {}
    for t, ntype in enumerate(types):
        k, q, v = (D.weights(100 * layer + 3 * t + i, width, width) / 4 for i in range(3))
        own = nodes.where(F.col("ntype") == ntype)
        tables[ntype] = durable(own.select("id", "x", D.linear("x", k).alias("k"), D.linear("x", q).alias("q"), D.linear("x", v).alias("v")))
    out = None
    for t, ntype in enumerate(types):
        parts = []
        for r, (s, e, dst) in enumerate(relations):
            if dst != ntype:
                continue
            att, msg = (np.stack([D.weights(100 * layer + 40 + 2 * r + i + 7 * h, d, d) for h in range(heads)]) for i in (0, 1))
            src = durable(tables[s].select(F.col("id").alias("src"), D.head_bilinear("k", att).alias("k"), D.head_bilinear("v", msg).alias("u")))
            of = edges.where((F.col("src_type") == s) & (F.col("etype") == e) & (F.col("dst_type") == dst)).select("src", "dst")
            joined = of.join(src.select("src", "k"), "src").join(tables[dst].select(F.col("id").alias("dst"), "q"), "dst")
            by = [float(priors[(s, e, dst)][h] if priors else 1.0) / d**0.5 for h in range(heads)]
            scores = M.edge_softmax(joined.select("src", "dst", V.zipped(V.heads_dot("q", "k", heads, d), F.array(*map(F.lit, by)), lambda v, w: v * w).alias("s")), heads)
            weighted = scores.join(src.select("src", "u"), "src").select("dst", V.heads_scaled("u", "a", heads, d).alias("m"))
            parts.append(M.fill_missing(M.reduced(weighted, "sum", width), tables[ntype], width))
        a = D.weights(100 * layer + 30 + t, width, width) / 4
        gate = skip if isinstance(skip, float) else skip[ntype]
        alpha = float(1 / (1 + np.exp(-gate)))
        if parts:
            agg = M.cross_reduced(parts, "mean", width).select("id", D.linear("x", a).alias("y"))
            mixed = agg.join(tables[ntype].select("id", "x"), "id").select("id", V.zipped("y", "x", lambda y, x: y * alpha + x * (1 - alpha)).alias("x"))
        else:
            mixed = tables[ntype].select("id", "x")
        done = mixed.select(F.lit(ntype).alias("ntype"), "id", (V.layer_norm("x") if norm and parts else F.col("x")).alias("x"))
        out = done if out is None else out.unionByName(done)
    return out


def rgcn(relations: list[Relation], widths: list[int]) -> list[typed.Layer]:
    """R-GCN layers of these widths for typed.run(); no activation on the last."""
    last = len(widths) - 2
    return [lambda e, n, k=k: rgcn_layer(e, n, relations, widths[k], widths[k + 1], k, act=k < last) for k in range(last + 1)]


def rgcn_basis(relations: list[Relation], widths: list[int], n_bases: int) -> list[typed.Layer]:
    """As rgcn(), with weights from bases; the layers share the weights' formula."""
    last = len(widths) - 2
    return [lambda e, n, k=k: rgcn_basis_layer(e, n, relations, widths[k], widths[k + 1], n_bases, act=k < last) for k in range(last + 1)]


def hgt(relations: list[Relation], width: int, heads: int, layers: int, **options) -> list[typed.Layer]:
    """HGT layers for typed.run(); options as of hgt_layer()."""
    return [lambda e, n, k=k: hgt_layer(e, n, relations, width, heads, layer=k, **options) for k in range(layers)]


def predictions(result: DataFrame) -> DataFrame:
    return result.select("id", V.argmax("x").alias("predicted"))


def accuracy(result: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the share of nodes whose argmax is their label."""
    return predictions(result).join(labels, "id").agg(F.avg((F.col("predicted") == F.col("label")).cast("double")).alias("accuracy"))


def cross_entropy(result: DataFrame, labels: DataFrame) -> DataFrame:
    """One row: the mean of -log softmax(x)[label]."""
    return result.join(labels, "id").agg(F.avg(-V.log_softmax("x")[F.col("label")]).alias("loss"))
