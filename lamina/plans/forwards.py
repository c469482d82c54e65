"""Models as plain forward functions, to be traced. Weights are the fixed ones of functions.dense, as in models."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np

from ..functions import dense as D
from . import trace as T

Relation = tuple[str, str, str]


def gat_layer(g: T.GraphProxy, feat: T.Value, layer: int, heads: int, width: int, slope: float, residual: bool) -> T.Value:
    """Attention over in-edges, written with the graph's frames; (heads, width) for each node."""
    g = g.local_var()
    h_src = h_dst = T.dropout(feat)
    rows = feat.shape[:-1]
    feat_src = feat_dst = T.linear(h_src, D.weights(layer, feat.size, heads * width)).view(rows + (heads, width))
    if g.is_block:
        feat_dst = feat_src[: g.number_of_dst_nodes()]
        h_dst = h_dst[: g.number_of_dst_nodes()]
    left, right = D.weights(10 + layer, heads, width)[None] / 4, D.weights(20 + layer, heads, width)[None] / 4
    g.srcdata.update({"ft": feat_src, "el": (feat_src * left).sum(dim=-1).unsqueeze(-1)})
    g.dstdata.update({"er": (feat_dst * right).sum(dim=-1).unsqueeze(-1)})
    g.apply_edges(T.u_add_v("el", "er", "e"))
    e = T.leaky_relu(g.edata.pop("e"), slope)
    g.edata["a"] = T.dropout(T.edge_softmax(g, e))
    g.update_all(T.u_mul_e("ft", "a", "m"), T.sum_("m", "ft"))
    out = g.dstdata["ft"]
    if residual:
        out = out + T.linear(h_dst, D.weights(30 + layer, feat.size, heads * width)).view(rows + (-1, width))
    return out


def gat(heads: int, width: int, layers: int = 2, slope: float = 0.2):
    """Heads side by side in hidden layers and averaged in the last; residual on all but the first."""

    def forward(g, h):
        for k in range(layers):
            out = gat_layer(g[k], h, k, heads, width, slope, k > 0)
            h = T.leaky_relu(out, 0.01).flatten(1) if k < layers - 1 else out.mean(1)
        return h

    return forward


def sage(widths: Sequence[int]):
    def forward(g, x):
        for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
            g.srcdata["h"] = T.linear(x, D.weights(2 * k + 1, a, b))
            g.update_all(T.copy_u("h", "m"), T.mean("m", "near"))
            own = T.linear(x[: g.num_dst_nodes()], D.weights(2 * k, a, b), D.bias(k, b))
            x = own + g.dstdata["near"]
            x = T.relu(x) if k < len(widths) - 2 else x
        return x

    return forward


def sum_net(widths: Sequence[int]):
    """Three convolutions whose outputs are added, over blocks with (source, destination) pairs."""

    def forward(blocks, x0):
        conv = lambda k, x: T.relu(T.graph_conv(blocks[k], (x, x[: blocks[k].number_of_dst_nodes()]), D.weights(k, x.size, widths[k + 1])))
        x1 = conv(0, x0)
        x2 = conv(1, x1)
        x3 = conv(2, x2)
        return x3 + x2 + x1

    return forward


def branching_net(width: int):
    """Eight convolutions in a branching graph with a mean over all nodes inside."""

    def forward(g, x):
        conv = lambda k, h: T.graph_conv(g, h, D.weights(k, width, width) / 4)
        x1 = conv(1, T.linear(x, D.weights(0, x.size, width) / 16))
        x2, x3 = conv(2, x1), conv(3, x1)
        x4, x5 = conv(4, x2 + T.mean_rows(x3)), conv(5, x2)
        x6 = conv(6, x4 + x5)
        x7 = conv(7, x3 + x6)
        return conv(8, x7) + x5

    return forward


def jknet(hidden: int, out: int, layers: int = 2, mode: str = "cat"):
    """Graph convolutions with relu, joined by cat or max, summed over neighbours, then linear."""

    def forward(g, x):
        kept = []
        for k in range(layers):
            x = T.relu(T.graph_conv(g, x, D.weights(k, x.size, hidden), D.bias(k, hidden)))
            kept.append(x)
        joined = T.concat(kept) if mode == "cat" else T.maximum(kept)
        g.srcdata["h"] = joined
        g.update_all(T.copy_u("h", "m"), T.sum_("m", "h"))
        return T.linear(g.dstdata["h"], D.weights(9, joined.size, out), D.bias(9, out))

    return forward


def rgcn(widths: Sequence[int]):
    """A linear map and mean for each relation, summed over the relations into a type; types without relation get zeros; no activation on the last layer."""

    def forward(g, h):
        for k, (a, b) in enumerate(zip(widths, widths[1:], strict=False)):
            functions = {}
            for r, (s, e, d) in enumerate(g.canonical_etypes):
                g[s, e, d].srcdata[f"w{r}"] = T.linear(h[s], D.weights(10 * k + r, a, b), D.bias(10 * k + r, b))
                functions[s, e, d] = (T.copy_u(f"w{r}", "m"), T.mean("m", "h"))
            g.multi_update_all(functions, "sum")
            reached = {d for _, _, d in g.canonical_etypes}
            h = {t: g.frames[t]["h"] if t in reached else g.full(t, 0.0, b) for t in g.ntypes}
            if k < len(widths) - 2:
                h = {t: T.leaky_relu(v) for t, v in h.items()}
        return h

    return forward


def rgcn_basis(width: int, n_bases: int):
    """One layer of means with weights from bases, a self-loop weight and a bias, summed over relations, then relu."""

    def forward(g, h):
        a, n = h[g.ntypes[0]].size, len(g.canonical_etypes)
        w = D.basis_weights(D.weights(3, n, n_bases), np.stack([D.weights(4 + b, a, width) for b in range(n_bases)]))
        functions = {}
        for r, (s, e, d) in enumerate(g.canonical_etypes):
            g[s, e, d].srcdata[f"w{r}"] = T.linear(h[s], w[r])
            functions[s, e, d] = (T.copy_u(f"w{r}", "m"), T.mean("m", "h"))
        g.multi_update_all(functions, "sum")
        out = {t: T.linear(h[t], D.weights(2, a, width), D.bias(2, width)) for t in g.ntypes}
        return {t: T.relu(v + g.frames[t]["h"] if "h" in g.frames[t] else v) for t, v in out.items()}

    return forward


def hgt(width: int, heads: int, layers: int, skip: float = 0.5, norm: bool = True, priors: Mapping[Relation, Sequence[float]] | None = None):
    """k, q, v by type, attention and message maps by relation, softmax over in-edges, mean over the relations into a type, gated skip, layer norm. priors: for each relation a factor of the scores of each head."""
    d = width // heads

    def forward(g, h):
        for layer in range(layers):
            kqv = {t: [T.linear(h[t], D.weights(100 * layer + 3 * i + j, width, width) / 4).view(T.ROWS, heads, d) for j in range(3)] for i, t in enumerate(g.ntypes)}
            functions, reached = {}, {t for _, _, t in g.canonical_etypes}
            for r, (s, e, t) in enumerate(g.canonical_etypes):
                sub = g[s, e, t]
                att, msg = (np.stack([D.weights(100 * layer + 40 + 2 * r + i + 7 * x, d, d) for x in range(heads)]) for i in (0, 1))
                sub.srcdata.update({f"k{r}": T.head_bilinear(kqv[s][0], att), f"v{r}": T.head_bilinear(kqv[s][2], msg)})
                sub.dstdata["q"] = kqv[t][1]
                sub.apply_edges(T.v_dot_u("q", f"k{r}", "t"))
                prior = np.array([priors[s, e, t][x] if priors else 1.0 for x in range(heads)])
                sub.edata["t"] = T.edge_softmax(sub, sub.edata.pop("t").sum(-1) * (prior / d**0.5)).unsqueeze(-1)
                functions[s, e, t] = (T.u_mul_e(f"v{r}", "t", "m"), T.sum_("m", "t"))
            g.multi_update_all(functions, "mean")
            alpha, out = float(1 / (1 + np.exp(-skip))), {}
            for i, t in enumerate(g.ntypes):
                if t in reached:
                    mixed = T.linear(g.frames[t]["t"].flatten(1), D.weights(100 * layer + 30 + i, width, width) / 4) * alpha + h[t] * (1 - alpha)
                    out[t] = T.layer_norm(mixed) if norm else mixed
                else:
                    out[t] = h[t]
            h = out
        return h

    return forward
