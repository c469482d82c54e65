"""Steps from a plain Python forward(graph, *x).

The function is called once with stand-ins. Arithmetic on values is composed into expressions; reading neighbours (apply_edges,
edge_softmax, update_all, layers) makes steps. The graph's frames srcdata, dstdata, ndata and edata are dictionaries of values. No rows are read
while tracing, so the function can't branch on data; shapes, without the rows, are known.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions import dense as D
from ..functions import vectors as V
from . import dataflow as P


class Rows:
    """The number of rows, known to no trace."""


ROWS = Rows()
_OPS = {
    "add": lambda x, y: x + y, "sub": lambda x, y: x - y, "mul": lambda x, y: x * y, "div": lambda x, y: x / y,
}


def _constant(a: np.ndarray) -> Column:
    return F.array(*[F.lit(float(v)) for v in a.ravel()])


def _broadcast(op: Callable, a: Column, b: Column, x: tuple[int, ...], y: tuple[int, ...]) -> Column:
    """op entry by entry of flat vectors with these shapes."""
    if x == y:
        return V.zipped(a, b, op)
    shape = np.broadcast_shapes(x, y)
    i, j = (np.broadcast_to(np.arange(int(np.prod(s))).reshape(s), shape).ravel() for s in (x, y))
    return F.array(*[op(a[int(k)], b[int(m)]) for k, m in zip(i, j, strict=True)])


class Value:
    """A vector for each node of a type or each edge of a relation: an expression over the tables of steps."""

    def __init__(self, tracer: Tracer, roots: Sequence[P.Step], expression: Callable[[Mapping[P.Step, Column]], Column], shape: tuple[int, ...]) -> None:
        self.tracer, self.roots, self.expression, self._shape = tracer, list(dict.fromkeys(roots)), expression, tuple(shape)
        self._step: P.Step | None = None

    @classmethod
    def of_step(cls, tracer: Tracer, step: P.Step, shape: tuple[int, ...]) -> Value:
        out = cls(tracer, [step], lambda cols: cols[step], shape)
        out._step = step
        return out

    @property
    def shape(self) -> tuple:
        return (ROWS, *self._shape)

    @property
    def size(self) -> int:
        return int(np.prod(self._shape))

    @property
    def on_edges(self) -> bool:
        return self.roots[0].on_edges

    @property
    def of(self) -> P.Key:
        return self.roots[0].of

    def step(self, name: str = "") -> P.Step:
        """The step whose table has the value."""
        if self._step is None:
            roots = self.roots
            run = lambda *cols: self.expression(dict(zip(roots, cols, strict=True)))
            self._step = self.tracer.add(P.node_map(name or self.tracer.name("map"), self.size, run, roots, self.of))
        return self._step

    def settled(self, name: str = "") -> Value:
        """The value with a column of its own, for expressions that name its entries."""
        return Value.of_step(self.tracer, self.step(name), self._shape)

    def mapped(self, f: Callable[[Column], Column], shape: tuple[int, ...] | None = None) -> Value:
        return Value(self.tracer, self.roots, lambda cols: f(self.expression(cols)), self._shape if shape is None else shape)

    # Arithmetic: with numbers, arrays of a shape that broadcasts, and values of the same nodes or edges.

    def _with(self, other, op: str, swap: bool = False) -> Value:
        f = _OPS[op]
        g = (lambda x, y: f(y, x)) if swap else f
        if isinstance(other, Value):
            if (other.of, other.on_edges) != (self.of, self.on_edges):
                raise ValueError("values of different nodes or edges meet only by messages")
            a, b = (self, other) if self._shape == other._shape else (self.settled(), other.settled())
            return Value(self.tracer, [*a.roots, *b.roots], lambda cols: _broadcast(g, a.expression(cols), b.expression(cols), a._shape, b._shape), np.broadcast_shapes(a._shape, b._shape))
        c = np.asarray(other, float)
        if c.ndim == 0:
            return self.mapped(lambda x: V.mapped(x, lambda v: g(v, F.lit(float(c)))))
        if c.ndim > len(self._shape) and c.shape[0] == 1:  # parameters often have a leading axis for the rows
            c = c[0]
        a = self if c.shape == self._shape else self.settled()
        return a.mapped(lambda x: _broadcast(g, x, _constant(c), a._shape, c.shape), np.broadcast_shapes(a._shape, c.shape))

    __array_ufunc__ = None  # arrays leave the operator to the value
    __add__ = lambda self, o: self._with(o, "add")
    __radd__ = __add__
    __sub__ = lambda self, o: self._with(o, "sub")
    __rsub__ = lambda self, o: self._with(o, "sub", True)
    __mul__ = lambda self, o: self._with(o, "mul")
    __rmul__ = __mul__
    __truediv__ = lambda self, o: self._with(o, "div")
    __rtruediv__ = lambda self, o: self._with(o, "div", True)
    __neg__ = lambda self: self._with(-1.0, "mul")

    def __getitem__(self, rows) -> Value:
        """x[:number of rows]: the rows of the destinations, which a whole graph has at hand."""
        if isinstance(rows, slice) and rows.start is None and rows.step is None and (rows.stop is None or isinstance(rows.stop, Rows)):
            return self
        raise ValueError("only the first rows, up to a number of nodes of the graph, can be taken")

    # Shapes.

    def view(self, *shape) -> Value:
        shape = tuple(shape[0]) if len(shape) == 1 and isinstance(shape[0], tuple | list) else shape
        if not shape or not isinstance(shape[0], Rows) and shape[0] != -1:
            raise ValueError("the first axis is that of the rows")
        inner = list(shape[1:])
        if -1 in inner:
            inner[inner.index(-1)] = self.size // int(np.prod([n for n in inner if n != -1]))
        if int(np.prod(inner)) != self.size:
            raise ValueError(f"{self._shape} can't be seen as {tuple(inner)}")
        out = Value(self.tracer, self.roots, self.expression, tuple(inner))
        out._step = self._step
        return out

    reshape = view

    def flatten(self, start: int = 1) -> Value:
        if start != 1:
            raise ValueError("rows stay apart")
        return self.view(ROWS, self.size)

    def _axis(self, dim: int) -> int:
        at = dim - 1 if dim > 0 else dim + len(self._shape)
        if dim == 0 or not 0 <= at < len(self._shape):
            raise ValueError(f"no axis {dim}")
        return at

    def unsqueeze(self, dim: int) -> Value:
        at = dim - 1 if dim > 0 else dim + len(self._shape) + 1
        return self.view(ROWS, *self._shape[:at], 1, *self._shape[at:])

    def squeeze(self, dim: int) -> Value:
        at = self._axis(dim)
        return self.view(ROWS, *self._shape[:at], *self._shape[at + 1 :]) if self._shape[at] == 1 else self

    def sum(self, dim: int, keepdim: bool = False) -> Value:
        at, a = self._axis(dim), self.settled()
        groups = np.moveaxis(np.arange(self.size).reshape(self._shape), at, -1)
        shape = groups.shape[:-1]
        rows = groups.reshape(-1, groups.shape[-1]).tolist()
        out = a.mapped(lambda x: F.array(*[sum((x[k] for k in row[1:]), x[row[0]]) for row in rows]), shape)
        return out.unsqueeze(at + 1) if keepdim else out

    def mean(self, dim: int | None = None, keepdim: bool = False) -> Value:
        """Over an axis; without dim over all rows and entries."""
        if dim is not None:
            return self.sum(dim, keepdim) / float(self._shape[self._axis(dim)])
        if self.on_edges:
            raise ValueError("the mean over all rows is that of nodes")
        return mean_rows(self.view(ROWS, 1, self.size).sum(2) / float(self.size))


# Functions of a forward. Each works on values only.


def linear(x: Value, w: np.ndarray, b: np.ndarray | None = None) -> Value:
    """x W + b over the last axis of flat vectors; a step of its own, so that it is computed once."""
    if x._shape != (w.shape[0],):
        raise ValueError(f"weights for {w.shape[0]} entries, values have {x._shape}")
    return x.settled().mapped(lambda c: D.linear(c, w, b), (w.shape[1],)).settled(x.tracer.name("linear"))


def head_bilinear(x: Value, w: np.ndarray) -> Value:
    """(heads, a) values times w (heads, a, b)."""
    if x._shape != w.shape[:2]:
        raise ValueError(f"weights for {w.shape[:2]}, values have {x._shape}")
    return x.settled().mapped(lambda c: D.head_bilinear(c, w), (w.shape[0], w.shape[2])).settled(x.tracer.name("bilinear"))


def relu(x: Value) -> Value:
    return x.mapped(V.relu)


def leaky_relu(x: Value, slope: float = 0.01) -> Value:
    return x.mapped(lambda c: V.leaky_relu(c, slope))


def sigmoid(x: Value) -> Value:
    return x.mapped(lambda c: V.mapped(c, V.sigmoid))


def gelu(x: Value) -> Value:
    return x.settled().mapped(D.gelu).settled(x.tracer.name("gelu"))


def layer_norm(x: Value, eps: float = 1e-5, scale=None, shift=None) -> Value:
    out = x.mapped(lambda c: V.layer_norm(c, eps, scale, shift))
    out.step(x.tracer.name("norm")).keep = True  # Spark can't hand nested lambdas to a function over Arrow batches
    return out.settled()


def mean_rows(x: Value) -> Value:
    """The mean of each entry over all nodes of the type, of the whole graph."""
    return Value.of_step(x.tracer, x.tracer.add(P.global_mean(x.tracer.name("mean"), x.step())), x._shape)


def dropout(x: Value, rate: float = 0.5) -> Value:
    """Off, as always when a model is applied."""
    return x


def concat(xs: Sequence[Value]) -> Value:
    """Flat vectors side by side."""
    parts = list(xs)
    return Value(parts[0].tracer, [r for x in parts for r in x.roots], lambda cols: F.concat(*[x.expression(cols) for x in parts]), (sum(x.size for x in parts),))


def maximum(xs: Sequence[Value]) -> Value:
    parts = list(xs)

    def run(cols):
        out = parts[0].expression(cols)
        for x in parts[1:]:
            out = V.zipped(out, x.expression(cols), lambda a, b: F.greatest(a, b))
        return out

    return Value(parts[0].tracer, [r for x in parts for r in x.roots], run, parts[0]._shape)


# Messages and reductions.


@dataclass(frozen=True)
class Message:
    """copy of one end's field, or <left> <op> <right>; ends are u (source), v (destination) and e (edge)."""

    op: str
    ends: tuple[str, ...]
    fields: tuple[str, ...]
    out: str


def __getattr__(name: str):
    """copy_u(x, out), copy_e(x, out), and <u|v|e>_<add|sub|mul|div|dot>_<u|v|e>(left, right, out)."""
    parts = name.split("_")
    if len(parts) == 2 and parts[0] == "copy" and parts[1] in "uve":
        return lambda field, out: Message("copy", (parts[1],), (field,), out)
    if len(parts) == 3 and parts[0] in "uve" and parts[2] in "uve" and (parts[1] in _OPS or parts[1] == "dot"):
        return lambda left, right, out: Message(parts[1], (parts[0], parts[2]), (left, right), out)
    raise AttributeError(name)


@dataclass(frozen=True)
class Reduction:
    how: str
    field: str
    out: str


def sum_(field: str, out: str) -> Reduction:
    return Reduction("sum", field, out)


def mean(field: str, out: str) -> Reduction:
    return Reduction("mean", field, out)


def max_(field: str, out: str) -> Reduction:
    return Reduction("max", field, out)


def min_(field: str, out: str) -> Reduction:
    return Reduction("min", field, out)


class Frame(dict):
    """Named values of one end."""

    def __init__(self, *others: Frame) -> None:
        super().__init__()
        self.others = others  # a graph's nodes are both ends

    def __setitem__(self, name: str, value: Value) -> None:
        super().__setitem__(name, value)
        for o in self.others:
            o[name] = value

    def update(self, *args, **kwargs) -> None:
        for name, value in dict(*args, **kwargs).items():
            self[name] = value


class GraphProxy:
    """Stands for a graph, one of its relations, or one of the blocks of a layer, which are all the whole graph here."""

    is_block = True

    def __init__(self, tracer: Tracer, relation: P.Key = None, frames: tuple[Frame, Frame, Frame] | None = None) -> None:
        self.tracer, self.relation = tracer, relation
        self.srcdata, self.dstdata, self.edata = frames or (Frame(), Frame(), Frame())
        self.ndata = Frame(self.srcdata, self.dstdata)

    def __getitem__(self, layer: int) -> GraphProxy:
        return self

    def local_var(self) -> GraphProxy:
        """The graph with frames of its own, which start with what is in these."""
        out = GraphProxy(self.tracer, self.relation)
        for mine, theirs in ((out.srcdata, self.srcdata), (out.dstdata, self.dstdata), (out.edata, self.edata), (out.ndata, self.ndata)):
            dict.update(mine, theirs)
        return out

    local_scope = local_var

    def _rows(self) -> Rows:
        return ROWS

    number_of_nodes = num_nodes = number_of_src_nodes = num_src_nodes = number_of_dst_nodes = num_dst_nodes = number_of_edges = num_edges = _rows

    def _message(self, m: Message) -> tuple[dict[str, P.Step], Callable[..., Column], tuple[int, ...]]:
        """(steps of the ends that are read, f(u, v, e of those) -> column, shape)."""
        frames = {"u": self.srcdata, "v": self.dstdata, "e": self.edata}
        values = [frames[end][name] for end, name in zip(m.ends, m.fields, strict=True)]
        if len(set(m.ends)) < len(m.ends):  # two fields of one end are first put side by side
            both = concat([values[0].flatten(), values[1].flatten()])
            cut = values[0].size
            steps = {m.ends[0]: both.step()}
            sides = lambda **c: (F.slice(c[m.ends[0]], 1, cut), F.slice(c[m.ends[0]], cut + 1, values[1].size))
        else:
            steps = {end: v.step() for end, v in zip(m.ends, values, strict=True)}
            sides = lambda **c: tuple(c[e] for e in m.ends)
        if m.op == "copy":
            return steps, lambda **c: sides(**c)[0], values[0]._shape
        x, y = (v._shape for v in values)
        if m.op == "dot":  # over the last axis, which stays as one entry
            shape = np.broadcast_shapes(x, y)
            heads = int(np.prod(shape[:-1]))
            if x != y:
                raise ValueError("inner products are of values of one shape")
            return steps, lambda **c: V.heads_dot(*sides(**c), heads, shape[-1]), (*shape[:-1], 1)
        return steps, lambda **c: _broadcast(_OPS[m.op], *sides(**c), x, y), np.broadcast_shapes(x, y)

    def apply_edges(self, m: Message) -> None:
        """The message of each edge becomes its field."""
        steps, f, shape = self._message(m)
        made = self.tracer.add(P.edge_step(self.tracer.name(m.out), int(np.prod(shape)), f, self.relation, **steps))
        self.edata[m.out] = Value.of_step(self.tracer, made, shape)

    def update_all(self, m: Message, r: Reduction) -> None:
        """Messages reduced for each destination, zeros without any; messages themselves are written nowhere."""
        if r.field != m.out:
            raise ValueError(f"the reduction reads {r.field}, the message is {m.out}")
        steps, f, shape = self._message(m)
        made = self.tracer.add(P.update(self.tracer.name(r.out), int(np.prod(shape)), f, r.how, self.relation, **steps))
        self.dstdata[r.out] = Value.of_step(self.tracer, made, shape)

    def degrees(self, end: str) -> Value:
        """Degrees at src or dst in the whole graph, as one entry; counted once."""
        key = (self.relation, end)
        if key not in self.tracer.counted:
            self.tracer.counted[key] = self.tracer.add(P.degrees(self.tracer.name(f"{end} degree"), self.relation, end))
        return Value.of_step(self.tracer, self.tracer.counted[key], (1,))


def degree_power(g: GraphProxy, end: str, power: float) -> Value:
    """max(degree, 1) ** power, a step for each graph, end and power."""
    key = (g.relation, end, power)
    if key not in g.tracer.counted:
        scale = g.degrees(end).mapped(lambda c: V.mapped(c, lambda v: F.pow(F.greatest(v, F.lit(1.0)), F.lit(power))))
        g.tracer.counted[key] = scale.step(g.tracer.name(f"{end} scale"))
    return Value.of_step(g.tracer, g.tracer.counted[key], (1,))


def edge_softmax(g: GraphProxy, e: Value) -> Value:
    """Over the in-edges of each node, for each entry."""
    return Value.of_step(g.tracer, g.tracer.add(P.edge_softmax(g.tracer.name("softmax"), e.step())), e._shape)


def graph_conv(g: GraphProxy, x: Value | tuple[Value, Value], w: np.ndarray, b: np.ndarray | None = None, norm: str = "both") -> Value:
    """A layer: normalised sums over in-edges times W plus b, W first where it makes rows narrower. Of a pair the first is the sources'."""
    x = x[0] if isinstance(x, tuple) else x
    first = w.shape[1] < w.shape[0]
    h = linear(x, w) if first else x
    h = h * degree_power(g, "src", -0.5) if norm == "both" else h
    own = GraphProxy(g.tracer, g.relation)
    own.srcdata["h"] = h
    own.update_all(Message("copy", ("u",), ("h",), "m"), sum_("m", "h"))
    h = own.dstdata["h"]
    h = h if norm == "none" else h * degree_power(g, "dst", -0.5 if norm == "both" else -1.0)
    h = h if first else linear(h, w)
    return h if b is None else h + b


class TypedGraphProxy:
    """Stands for a graph of several node types and relations."""

    def __init__(self, tracer: Tracer, relations: Sequence[tuple[str, str, str]]) -> None:
        self.tracer, self.canonical_etypes = tracer, list(relations)
        self.ntypes = sorted({r[0] for r in relations} | {r[2] for r in relations})
        self.frames = {t: Frame() for t in self.ntypes}
        self.edges = {r: Frame() for r in relations}

    def __getitem__(self, relation: tuple[str, str, str] | str) -> GraphProxy:
        """The subgraph of a relation, by its three names or by its own; its frames are the graph's."""
        found = [r for r in self.canonical_etypes if relation in (r, r[1])]
        if len(found) != 1:
            raise KeyError(f"{relation}: {len(found)} relations")
        s, _, d = found[0]
        return GraphProxy(self.tracer, found[0], (self.frames[s], self.frames[d], self.edges[found[0]]))

    def multi_update_all(self, functions: Mapping, cross: str = "sum") -> None:
        """update_all() on each relation, reduced over the relations into a type (sum, mean, max, min or stack); a node without an edge of a relation counts with zeros."""
        into: dict[tuple[str, str], list[Value]] = {}
        for relation, (m, r) in functions.items():
            g = self[relation].local_var()
            g.update_all(m, r)
            into.setdefault((P.ends(g.relation)[1], r.out), []).append(g.dstdata[r.out])
        for (t, out), values in into.items():
            if len(values) == 1:
                self.frames[t][out] = values[0]
                continue
            made = self.tracer.add(P.total(self.tracer.name(f"{cross} {out}"), [v.step() for v in values], cross))
            self.frames[t][out] = Value.of_step(self.tracer, made, (made.size,) if cross == "stack" else values[0]._shape)

    def full(self, ntype: str, value: float, size: int) -> Value:
        """The same vector for each node of a type."""
        return Value.of_step(self.tracer, self.tracer.add(P.filled(self.tracer.name("filled"), value, size, ntype)), (size,))


class Tracer:
    def __init__(self) -> None:
        self.made: list[P.Step] = []
        self.counted: dict[tuple, P.Step] = {}
        self._names: dict[str, int] = {}

    def name(self, what: str) -> str:
        n = self._names[what] = self._names.get(what, -1) + 1
        return f"{what}{n}"

    def add(self, step: P.Step) -> P.Step:
        self.made.append(step)
        return step


@dataclass
class Traced:
    """The flow, its sources in the order of the function's arguments (by type for a typed graph), and the shapes of the outputs."""

    flow: P.Dataflow
    sources: list[P.Step] | dict[str, P.Step]
    shapes: list[tuple[int, ...]]


def _finished(tracer: Tracer, outs: Sequence[Value], sources) -> Traced:
    for v in outs:
        if not isinstance(v, Value):
            raise TypeError(f"forward returned {type(v).__name__}, not a value")
    return Traced(P.Dataflow(tuple(v.step(tracer.name("out")) for v in outs), tuple(tracer.made)), sources, [v._shape for v in outs])


def trace(forward: Callable, *widths: int, **constants) -> Traced:
    """forward(graph, *x) with an x of so many entries each, and constants passed through by name (None included)."""
    tracer = Tracer()
    sources = [P.source(f"x{k}", w) for k, w in enumerate(widths)]
    out = forward(GraphProxy(tracer), *[Value.of_step(tracer, s, (s.size,)) for s in sources], **constants)
    return _finished(tracer, out if isinstance(out, tuple | list) else [out], sources)


def trace_typed(forward: Callable, relations: Sequence[tuple[str, str, str]], widths: Mapping[str, int] | int, out_key: str | None = None) -> Traced:
    """forward(graph, h) with h: node type -> x; it returns a value, or values by type, of which out_key takes one. The outputs are in the order of types."""
    tracer = Tracer()
    g = TypedGraphProxy(tracer, relations)
    sources = {t: P.source(f"x {t}", widths if isinstance(widths, int) else widths[t], t) for t in g.ntypes}
    out = forward(g, {t: Value.of_step(tracer, s, (s.size,)) for t, s in sources.items()})
    if isinstance(out, Mapping):
        out = [out[out_key]] if out_key else [out[t] for t in sorted(out)]
    return _finished(tracer, out if isinstance(out, tuple | list) else [out], sources)
