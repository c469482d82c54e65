"""Layer-wise plans.

A model is a graph of steps over node tables (id, x). A propagate step needs all nodes of its input, so
it ends a stage; a stage is everything between two such cuts. Each stage runs over all nodes (or the
nodes that the targets need) before the next, its live results are kept in durable storage, and they
are dropped after their last use. Steps that depend on one end of an edge only run on nodes, not edges.
"""

from __future__ import annotations

import time
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import graph as G
from ..operators import message as M
from ..operators.durable import StageStore, durable
from . import dataflow


@dataclass(eq=False)
class Step:
    """name, inputs, and run: (graph, input tables) -> (id, x). propagates marks a step that reads neighbours."""

    name: str
    inputs: tuple[Step, ...]
    run: Callable[[Graph, Sequence[DataFrame]], DataFrame] | None
    width: int
    propagates: bool = False


@dataclass
class Graph:
    """counted: degrees of the whole graph by end, made when they are first asked for and read by all layers. So are its cells."""

    edges: DataFrame
    nodes: DataFrame
    counted: dict[str, DataFrame] = field(default_factory=dict)
    whole: DataFrame | None = None  # the edges that degrees are counted over, where they aren't edges
    placed: dataflow.Stage | None = None

    def degrees(self, end: str) -> DataFrame:
        if end not in self.counted:
            self.counted[end] = durable(M.degrees(self.edges if self.whole is None else self.whole, end))
        return self.counted[end]

    def cells(self) -> dataflow.Stage:
        """The edges in cells, where values of nodes come to them, and a store for what a layer writes."""
        if self.placed is None:
            store = StageStore(self.edges.sparkSession)
            self.placed = dataflow.Stage(dataflow.stored_graph({None: self.edges}, {}, store, eids=False), store, None)
        return self.placed

    def release(self, edges: bool = True) -> None:
        """Delete what the layers wrote, and the cells."""
        if self.placed is not None:
            self.placed.store.release(*self.placed.kept)
            self.placed.kept.clear()
            if edges:
                self.placed.store.release_all_but()
                self.placed = None


def source(width: int, name: str = "x") -> Step:
    return Step(name, (), None, width)


def node_map(name: str, width: int, f: Callable, *inputs: Step) -> Step:
    """f(columns of the inputs' vectors) -> a column; the inputs are joined by id."""

    def run(_: Graph, tables: Sequence[DataFrame]) -> DataFrame:
        joined = tables[0].select("id", F.col("x").alias("x0"))
        for k, t in enumerate(tables[1:], 1):
            joined = joined.join(t.select("id", F.col("x").alias(f"x{k}")), "id")
        return joined.select("id", f(*[F.col(f"x{k}") for k in range(len(tables))]).alias("x"))

    return Step(name, inputs, run, width)


def propagate(name: str, x: Step, op: str = "copy_u", how: str = "sum") -> Step:
    def run(graph: Graph, tables: Sequence[DataFrame]) -> DataFrame:
        return M.fill_missing(M.update_all(graph.edges, tables[0], op, how, x.width), graph.nodes, x.width)

    return Step(name, (x,), run, x.width, True)


def normalised(name: str, x: Step, norm: str = "both") -> Step:
    return Step(name, (x,), lambda graph, t: M.graph_conv(graph.edges, t[0], x.width, norm, graph.degrees), x.width, True)


def custom(name: str, width: int, run: Callable[[Graph, Sequence[DataFrame]], DataFrame], *inputs: Step) -> Step:
    """A propagating step of one's own."""
    return Step(name, inputs, run, width, True)


def global_mean(name: str, x: Step) -> Step:
    """Every node gets the mean over all nodes (of the whole graph, not of a batch)."""

    def run(graph: Graph, tables: Sequence[DataFrame]) -> DataFrame:
        mean = tables[0].agg(F.array(*[F.avg(F.col("x")[i]) for i in range(x.width)]).alias("x"))
        return graph.nodes.select("id").join(F.broadcast(mean))  # one row

    return Step(name, (x,), run, x.width, True)


#: Called with a stage's number, tables by step name, and seconds (of Spark work where the stage's results are made durable).
StageHook = Callable[[int, dict[str, DataFrame], float], None]


@dataclass
class Plan:
    outputs: tuple[Step, ...]
    order: list[Step] = field(init=False)
    level: dict[Step, int] = field(init=False)

    def __post_init__(self) -> None:
        self.order, self.level = [], {}
        for out in self.outputs:
            self._visit(out, set())

    def _visit(self, step: Step, above: set[Step]) -> None:
        if step in above:
            raise ValueError(f"{step.name} depends on itself")
        if step in self.level:
            return
        for x in step.inputs:
            self._visit(x, above | {step})
        self.level[step] = max((self.level[x] for x in step.inputs), default=0) + step.propagates
        self.order.append(step)

    @property
    def layers(self) -> int:
        """Message-passing depth."""
        return max(self.level[o] for o in self.outputs)

    def stages(self) -> list[list[Step]]:
        """Steps by level; a propagating step opens its level's stage."""
        return [[s for s in self.order if self.level[s] == n and s.inputs] for n in range(self.layers + 1)]

    def live_after(self, n: int) -> list[Step]:
        """Results of stages up to n that a later stage or the caller reads."""
        read = {x for s in self.order if self.level[s] > n for x in s.inputs} | set(self.outputs)
        return [s for s in self.order if self.level[s] <= n and s in read and s.inputs]

    def explain(self) -> str:
        lines = []
        for n, stage in enumerate(self.stages()):
            lines.append(f"stage {n}: {', '.join(s.name for s in stage) or '-'}; kept: {', '.join(s.name for s in self.live_after(n)) or '-'}")
        return "\n".join(lines)

    def run(self, graph: Graph, inputs: dict[Step, DataFrame], keep: Callable[[DataFrame], DataFrame] | None = durable, targets: DataFrame | None = None, before: StageHook | None = None, after: StageHook | None = None) -> list[DataFrame]:
        """The outputs, in order. before and after are called with each stage's number, the tables at hand by step name and the seconds since its start. inputs gives the table of each source step (id, x).

        keep makes a stage's live results durable (None: leave all to one Spark plan). With targets (id), each stage is
        restricted to the nodes that the later stages need, and the outputs have rows for the targets only.
        """
        missing = [s.name for s in self.order if not s.inputs and s not in inputs]
        if missing or len(inputs) != sum(not s.inputs for s in self.order):
            raise ValueError(f"inputs must be given for the sources, neither more nor less; missing: {missing}")
        needed = [keep(t) if keep else t for t in G.hops(graph.edges, targets, self.layers)] if targets is not None else None
        done = dict(inputs)
        named = lambda: {s.name: t for s, t in done.items()}
        for n, stage in enumerate(self.stages()):
            began = time.perf_counter()
            if before:
                before(n, named(), 0.0)
            at = Graph(G.restrict(graph.edges, needed[n]), needed[n], graph.counted, graph.edges) if needed else graph
            for step in stage:
                tables = [done[x] for x in step.inputs]
                if needed:  # own rows of the stage's nodes only; a propagating step also reads its neighbours' rows
                    tables = tables if step.propagates else [t.join(needed[n], "id", "left_semi") for t in tables]
                done[step] = step.run(at, tables)
            live = self.live_after(n)
            for step in stage:
                if keep and step in live and (n < self.layers or at.placed):
                    done[step] = keep(done[step])
            if keep:  # else the outputs' plan reads the cells
                at.release(edges=bool(needed) or n == self.layers)
            if after:
                after(n, named(), time.perf_counter() - began)
            for step in [s for s in done if s.inputs and s not in live and s not in stage]:
                del done[step]
        if needed:
            return [done[o].join(needed[-1], "id", "left_semi") for o in self.outputs]
        return [done[o] for o in self.outputs]


def add(name: str, *xs: Step) -> Step:
    def total(*cols):
        out = cols[0]
        for c in cols[1:]:
            out = V.add(out, c)
        return out

    return node_map(name, xs[0].width, total, *xs)
