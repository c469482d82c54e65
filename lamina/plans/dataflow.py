"""Layer-wise runs of step graphs over plain and typed graphs.

A step makes a node table (id, x) of one node type, or an edge table (eid, src, dst, x) of one relation. A step that reads
an input at the sources of its edges needs all of that input's rows, so it opens a stage. Each stage runs before the next; what
later stages read is written in buckets of its key and deleted after its last use. Only steps that the outputs depend on run.

Over a whole graph edges lie in cells, by their source or, where that has many edges, by their destination. Values of nodes are sent once to each cell
that holds an edge of theirs, and sums leave it once for each destination: edges themselves don't move, and a hub's lie in many cells.
"""

from __future__ import annotations

import hashlib
import time
from collections.abc import Callable, Hashable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from ..operators import message as M
from ..operators.durable import StageStore

#: A node type, or a relation (source type, name, destination type); None in a plain graph.
Key = Hashable


def ends(relation: Key) -> tuple[Key, Key]:
    """Node types of a relation's sources and destinations."""
    return (relation[0], relation[2]) if relation is not None else (None, None)


@dataclass
class Graph:
    """Nodes (id) by type; edges (eid, src, dst) by relation, once in the order of their sources and once in that of their destinations."""

    nodes: Mapping[Key, DataFrame]
    by_src: Mapping[Key, DataFrame]
    by_dst: Mapping[Key, DataFrame]
    placed: Mapping[Key, Placed]


@dataclass
class Placed:
    """A relation's edges (cell, eid, src, dst) in cells, and (cell, src), (cell, dst): in which of them a node has edges."""

    edges: DataFrame
    src: DataFrame
    dst: DataFrame


class _Placed(dict):
    """Edges in cells, written from those by src once they are asked for."""

    def __init__(self, by_src: Mapping[Key, DataFrame], store: StageStore) -> None:
        super().__init__()
        self.by_src, self.store = by_src, store

    def __missing__(self, relation: Key) -> Placed:
        edges, put = self.by_src[relation], self.store.put
        # A source with more edges than a destination has on average would be summed in one cell for too many destinations.
        usual = edges.agg((F.count(F.lit(1)) / F.greatest(F.approx_count_distinct("dst"), F.lit(1))).alias("_usual"))
        out = edges.groupBy("src").agg(F.count(F.lit(1)).alias("_out")).join(F.broadcast(usual)).select("src", (F.col("_out") > F.col("_usual")).alias("_many"))
        names = F.array(*map(F.lit, self.store.cell_names()))
        cell = names[F.pmod(F.xxhash64(F.when(F.col("_many"), F.col("dst")).otherwise(F.col("src"))), F.size(names)).cast("int")]
        rows = edges.join(out, "src").select(cell.alias("cell"), *_edge_columns(edges)).repartition(self.store.cells, "cell")
        placed = put(rows, f"placed {relation}", "cell", f"graph: placed {relation}")
        at = [put(placed.select("cell", end).distinct().repartition(self.store.buckets, end), f"cells of {relation} {end}", end, f"graph: cells of {relation} {end}") for end in ("src", "dst")]
        self[relation] = Placed(placed, *at)
        return self[relation]


class _ByDst(dict):
    """Edges by dst, written from those by src once they are asked for."""

    def __init__(self, by_src: Mapping[Key, DataFrame], store: StageStore) -> None:
        super().__init__()
        self.by_src, self.store = by_src, store

    def __missing__(self, relation: Key) -> DataFrame:
        edges = self.by_src[relation].repartition(self.store.buckets, "dst")
        self[relation] = self.store.put(edges, f"edges {relation} by dst", "dst", f"graph: edges {relation} by dst")
        return self[relation]


def stored_graph(edges: Mapping[Key, DataFrame], nodes: Mapping[Key, DataFrame], store: StageStore, eids: bool = True) -> Graph:
    """The graph in the store's buckets: each relation's edges by src, and by dst or in cells where they are asked for, and each type's nodes by id. Repeated edges stay, each with an eid of
    its own, unless none are asked for. Node tables that the store has already aren't written again.
    """
    numbered = {r: e.select("src", "dst").repartition(store.buckets, "src") for r, e in edges.items()}
    if eids:
        numbered = {r: e.withColumn("eid", F.monotonically_increasing_id()) for r, e in numbered.items()}
    fresh = {t: n.select("id").repartition(store.buckets, "id") for t, n in nodes.items() if not store.owns(n)}
    put = store.put_all([*[(e, f"edges {r} by src", "src", f"graph: edges {r} by src") for r, e in numbered.items()], *[(n, f"nodes {t}", "id", f"graph: nodes {t}") for t, n in fresh.items()]])
    by_src, ids = dict(zip(numbered, put, strict=False)), dict(zip(fresh, put[len(numbered) :], strict=True))
    return Graph({t: ids[t] if t in ids else n.select("id") for t, n in nodes.items()}, by_src, _ByDst(by_src, store), _Placed(by_src, store))


@dataclass(eq=False)
class Step:
    """run: (stage, input tables) -> table; None for a source. far tells for each input whether it is read at the edges' sources. of: node type, or relation where on_edges."""

    name: str
    inputs: tuple[Step, ...]
    run: Callable[[Stage, Sequence[DataFrame]], DataFrame] | None
    size: int
    of: Key = None
    on_edges: bool = False
    far: tuple[bool, ...] = ()
    relation: Key = None
    keep: bool = False  # written in any case
    whole: bool = False  # reads all rows of its inputs, whichever of its own are needed

    @property
    def at(self) -> Key:
        """The type of the nodes whose rows it makes, or whose in-edges it works on."""
        return ends(self.of)[1] if self.on_edges else self.of


@dataclass
class Stage:
    graph: Graph
    store: StageStore
    needed: Mapping[Key, DataFrame] | None
    kept: list[DataFrame] = field(default_factory=list)

    def nodes(self, of: Key) -> DataFrame:
        return self.graph.nodes[of] if self.needed is None else self.needed[of]

    def edges(self, relation: Key) -> DataFrame:
        """In-edges of the stage's nodes. Those of all nodes come in cells."""
        if self.needed is None:
            return self.graph.placed[relation].edges
        return self.own(self.graph.by_dst[relation], ends(relation)[1], "dst")

    def met(self, edges: DataFrame, relation: Key, end: str, values: DataFrame) -> DataFrame:
        """Edges joined with values, of nodes that column end (src or dst) has; edges in cells stay there."""
        if self.needed is not None:
            return edges.join(values, end)
        # Dealt by cell here: left to Spark, the side with more partitions stays, which is that by node. Edges stream past a cell's values, unsorted.
        at = getattr(self.graph.placed[relation], end).join(values, end).repartition(self.store.cells, "cell")
        return edges.join(at.hint("shuffle_hash"), ["cell", end])

    def own(self, table: DataFrame, of: Key, key: str = "id") -> DataFrame:
        """Rows of the stage's nodes."""
        if self.needed is None:
            return table
        return table.join(self.needed[of].select(F.col("id").alias(key)), key, "left_semi").select(*table.columns)

    def keep(self, df: DataFrame, key: str = "dst") -> DataFrame:
        """df written until the stage ends."""
        self.kept.append(self.store.put(df, "within a stage", key))
        return self.kept[-1]


def _edge_columns(table: DataFrame) -> list[str]:
    return [c for c in ("cell", "eid", "src", "dst") if c in table.columns]


def source(name: str, size: int, of: Key = None) -> Step:
    return Step(name, (), None, size, of)


def node_map(name: str, size: int, f: Callable, inputs: Sequence[Step], of: Key) -> Step:
    """f(columns of the inputs' vectors) -> column, for nodes of one type, or, if all inputs are edge tables, for edges of one relation."""
    on_edges = inputs[0].on_edges

    def run(stage: Stage, tables: Sequence[DataFrame]) -> DataFrame:
        kept = _edge_columns(tables[0]) if on_edges else ["id"]
        key = [c for c in kept if c not in ("src", "dst")]
        joined = stage.own(tables[0], ends(of)[1] if on_edges else of, "dst" if on_edges else "id").select(*kept, F.col("x").alias("x0"))
        for k, t in enumerate(tables[1:], 1):
            joined = joined.join(t.select(*key, F.col("x").alias(f"x{k}")), key)
        return joined.select(*kept, f(*[F.col(f"x{k}") for k in range(len(tables))]).alias("x"))

    return Step(name, tuple(inputs), run, size, of, on_edges, (False,) * len(inputs))


def filled(name: str, value: float, size: int, of: Key) -> Step:
    """The same vector for all nodes of a type."""
    return Step(name, (), lambda stage, _: stage.nodes(of).select("id", F.array_repeat(F.lit(value), size).alias("x")), size, of)


def degrees(name: str, relation: Key, end: str) -> Step:
    """Degrees at that end (src or dst) of a relation in the whole graph, counted where the edges lie; zero without edges."""
    of = ends(relation)[0 if end == "src" else 1]

    def run(stage: Stage, _: Sequence[DataFrame]) -> DataFrame:
        edges = stage.graph.by_src[relation] if end == "src" else stage.graph.placed[relation].edges if stage.needed is None else stage.graph.by_dst[relation]
        counted = edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("n"))
        return stage.nodes(of).join(counted, "id", "left").select("id", F.array(F.coalesce("n", F.lit(0)).cast("double")).alias("x"))

    return Step(name, (), run, 1, of)


def global_mean(name: str, x: Step) -> Step:
    """Each node gets the mean over all nodes of the type, of the whole graph."""

    def run(stage: Stage, tables: Sequence[DataFrame]) -> DataFrame:
        mean = tables[0].agg(F.array(*[F.avg(F.col("x")[i]) for i in range(x.size)]).alias("x"))
        return stage.nodes(x.of).join(F.broadcast(mean))  # one row

    return Step(name, (x,), run, x.size, x.of, far=(True,), whole=True)


def edge_step(name: str, size: int, f: Callable, relation: Key, u: Step | None = None, v: Step | None = None, e: Step | None = None) -> Step:
    """An edge table: f(columns by name of u, v and e that are given) for each edge."""
    given = {k: s for k, s in (("u", u), ("v", v), ("e", e)) if s is not None}

    def run(stage: Stage, tables: Sequence[DataFrame]) -> DataFrame:
        rows = _on_edges(stage, relation, dict(zip(given, tables, strict=True)))
        return rows.select(*_edge_columns(rows), f(**{k: F.col(k) for k in given}).alias("x"))

    return Step(name, tuple(given.values()), run, size, relation, True, tuple(k == "u" for k in given))


def _on_edges(stage: Stage, relation: Key, tables: Mapping[str, DataFrame]) -> DataFrame:
    """Edges with columns u, v and e of the tables given."""
    if "e" in tables:
        out = stage.own(tables["e"], ends(relation)[1], "dst").withColumnRenamed("x", "e")
    else:
        out = stage.edges(relation)
    for side, key in (("u", "src"), ("v", "dst")):
        if side in tables:
            out = stage.met(out, relation, key, tables[side].select(F.col("id").alias(key), F.col("x").alias(side)))
    return out


def edge_softmax(name: str, e: Step) -> Step:
    """Softmax of each entry over the in-edges of a node."""

    def run(stage: Stage, tables: Sequence[DataFrame]) -> DataFrame:
        scores = stage.own(tables[0], ends(e.of)[1], "dst").withColumnRenamed("x", "s")
        if stage.needed is not None:
            return M.edge_softmax(scores, e.size, keep=stage.keep).select("eid", "src", "dst", F.col("a").alias("x"))
        each = range(e.size)
        less = lambda s, top: F.exp(F.when(s == top, 0.0).otherwise(s - top))  # noqa: E731  # of infinities too
        top = scores.groupBy("dst").agg(*[F.max(F.col("s")[h]).alias(f"_m{h}") for h in each])
        met = stage.met(scores, e.of, "dst", top)  # no window: that would sort a cell's edges with their scores
        sums = met.groupBy("dst").agg(*[F.max(f"_m{h}").alias(f"_m{h}") for h in each], *[F.sum(less(F.col("s")[h], F.col(f"_m{h}"))).alias(f"_s{h}") for h in each])
        a = F.array(*[F.exp(F.col("s")[h] - F.col(f"_m{h}")) / F.col(f"_s{h}") for h in each])
        sums = stage.keep(sums)  # a row for each destination; the scores are made anew where they are read
        return stage.met(scores, e.of, "dst", sums).select(*_edge_columns(scores), a.alias("x"))

    return Step(name, (e,), run, e.size, e.of, True, (False,))


def update(name: str, size: int, f: Callable, how: str, relation: Key, u: Step | None = None, v: Step | None = None, e: Step | None = None) -> Step:
    """A node table: messages f(u, v, e of those given) reduced over in-edges; zeros without edges."""
    given = {k: s for k, s in (("u", u), ("v", v), ("e", e)) if s is not None}

    def run(stage: Stage, tables: Sequence[DataFrame]) -> DataFrame:
        rows = _on_edges(stage, relation, dict(zip(given, tables, strict=True))).select("dst", f(**{k: F.col(k) for k in given}).alias("m"))
        return M.fill_missing(M.reduced(rows, how, size), stage.nodes(ends(relation)[1]), size)

    return Step(name, tuple(given.values()), run, size, ends(relation)[1], False, tuple(k == "u" for k in given), relation)


@dataclass
class Dataflow:
    """The steps that the outputs depend on, in stages. made: all steps that were written down, read or not."""

    outputs: tuple[Step, ...]
    made: tuple[Step, ...] = ()
    order: list[Step] = field(init=False)
    level: dict[Step, int] = field(init=False)

    def __post_init__(self) -> None:
        self.order, self.level = [], {}
        for out in self.outputs:
            self._visit(out)

    def _visit(self, out: Step) -> None:
        waiting = [(out, iter(out.inputs))]
        while waiting:  # depth first, without recursion
            step, rest = waiting[-1]
            if (x := next(rest, None)) is not None:
                if x not in self.level:
                    waiting.append((x, iter(x.inputs)))
                continue
            waiting.pop()
            if step not in self.level:
                self.level[step] = max((self.level[x] + far for x, far in zip(step.inputs, step.far, strict=True)), default=0)
                self.order.append(step)

    @property
    def depth(self) -> int:
        return max(self.level[o] for o in self.outputs)

    def sources(self) -> list[Step]:
        return [s for s in self.order if s.run is None]

    def live_after(self, n: int) -> list[Step]:
        """Steps up to stage n that a later stage or the caller reads."""
        read = {x for s in self.order if self.level[s] > n for x in s.inputs} | set(self.outputs)
        return [s for s in self.order if self.level[s] <= n and s in read]

    def unread(self) -> list[Step]:
        """Steps that were written down, but that no output depends on."""
        return [s for s in self.made if s not in self.level]

    def explain(self) -> str:
        named = lambda steps: ", ".join(f"{s.name} [{s.of}]" if s.of is not None else s.name for s in steps) or "-"
        lines = [f"stage {n}: {named([s for s in self.order if self.level[s] == n and s.run])}; kept: {named([s for s in self.live_after(n) if s.run])}" for n in range(self.depth + 1)]
        return "\n".join([*lines, f"unread: {named(self.unread())}"])

    def needs(self, graph: Graph, store: StageStore, targets: Mapping[Key, DataFrame]) -> dict[tuple[int, Key], DataFrame]:
        """(id) by stage and node type: the nodes whose rows of that stage the targets depend on."""
        wanted: dict[tuple[int, Key], list[DataFrame]] = {}
        for out in self.outputs:
            wanted.setdefault((self.level[out], out.at), []).append(targets[out.at].select("id"))
        found: dict[tuple[int, Key], DataFrame] = {}
        for n in range(self.depth, -1, -1):
            steps = [s for s in self.order if self.level[s] == n]
            same: dict[Key, set[Key]] = {s.at: {s.at} for s in steps}
            for s in steps:  # a step and what it reads on the same stage concern the same nodes
                for x in s.inputs:
                    if self.level[x] == n and x.at != s.at:
                        raise ValueError(f"{s.name} reads {x.name} of another type on its own stage")
            for t in same:
                parts = wanted.get((n, t), [])
                if not parts:
                    continue
                all_ = parts[0]
                for p in parts[1:]:
                    all_ = all_.unionByName(p)
                found[n, t] = store.put(all_.distinct(), f"needed {n} {t}", "id", f"needed {n} {t}")
                for s in steps:
                    for x, far in zip(s.inputs, s.far, strict=True):
                        if s.at == t and self.level[x] < n:
                            key = (self.level[x], x.at)
                            if not far:
                                reached = found[n, t].select("id")
                            elif s.whole:
                                reached = graph.nodes[x.at]
                            else:
                                into = graph.by_dst[s.of if s.on_edges else s.relation]
                                reached = into.join(found[n, t].select(F.col("id").alias("dst")), "dst", "left_semi").select(F.col("src").alias("id"))
                            wanted.setdefault(key, []).append(reached)
        return found

    def run(
        self, graph: Graph, inputs: Mapping[Step, DataFrame], store: StageStore, targets: Mapping[Key, DataFrame] | None = None,
        after: Callable[[int, dict[str, DataFrame], float], None] | None = None, only_outputs: bool = True,
    ) -> list[DataFrame]:
        """The outputs' tables, written to the store. With targets (id) by node type of the outputs, each stage works on the nodes only that they depend on.

        inputs has the table of each source. after(stage, kept tables by step name, seconds) is called once a stage is done. With only_outputs the store
        holds nothing but the outputs in the end: graph tables and inputs of the store go as well.

        In a store with a run's name, a run that was stopped goes on behind the last stage that was finished, and what that stage's successor had written is read;
        after is called for the stages only that this run works on. Another step graph under the same name is refused.
        """
        plan = hashlib.sha256(self.explain().encode()).hexdigest()
        if (before := store.marked("plan")) and before["plan"] != plan:
            raise ValueError("the store holds a run of another step graph")
        store.mark("plan", plan=plan)
        place = {s: k for k, s in enumerate(self.order)}
        tag = lambda s: f"step {place[s]}: {s.name}"
        missing = [s.name for s in self.sources() if s not in inputs]
        if missing or any(s.run is not None for s in inputs):
            raise ValueError(f"inputs must be given for the sources only; missing: {missing}")
        needed = self.needs(graph, store, targets) if targets is not None else None
        done = {s: t for s, t in inputs.items() if s in self.level}
        start = 0
        for n in range(self.depth, -1, -1):
            live = [s for s in self.live_after(n) if s.run is not None]
            if store.marked(f"stage {n}") and all(store.marked(tag(s)) for s in live):
                done |= {s: store.opened(tag(s)) for s in live}
                start = n + 1
                break
        for n in range(start, self.depth + 1):
            began = time.perf_counter()
            stage = Stage(graph, store, None if needed is None else {t: ids for (k, t), ids in needed.items() if k == n})
            steps = [s for s in self.order if self.level[s] == n and s.run is not None]
            live = self.live_after(n)
            kept = {s for s in steps if s in live or s.keep or (any(s.far) or len(s.inputs) > 1) and sum(s in o.inputs for o in steps) > 1}
            wave: dict[Step, int] = {}
            for s in steps:  # what is kept is read where it is written
                wave[s] = max((wave[x] + (x in kept) for x in s.inputs if x in wave), default=0)
            made: dict[Step, DataFrame] = {}
            for w in range(max(wave.values(), default=-1) + 1):
                for s in steps:  # each once: a step that writes within the stage would write again
                    if s not in done and s not in made and wave[s] <= w:
                        made[s] = s.run(stage, [done[x] if x in done else made[x] for x in s.inputs])
                now = [s for s in made if s in kept and s not in done]
                done |= zip(now, store.put_all([(made[s], s.name, ("cell" if needed is None else "dst") if s.on_edges else "id", tag(s)) for s in now]), strict=True)
            store.mark(f"stage {n}")
            if after:
                after(n, {s.name: t for s, t in done.items()}, time.perf_counter() - began)
            store.release(*stage.kept, *[done.pop(s) for s in list(done) if s not in live and s.run is not None])  # inputs may hold the graph's nodes
        out = []
        for o in self.outputs:
            made = done[o]
            if needed is not None and self.level[o] < self.depth:  # it has rows that later stages read
                made = store.put(made.join(targets[o.at].select("id").distinct(), "id", "left_semi"), o.name)
            out.append(made if store.owns(made) else store.put(made, o.name))
        if only_outputs:
            store.release_all_but(*out)
        return out


def zeros(name: str, size: int, of: Key) -> Step:
    return filled(name, 0.0, size, of)


def total(name: str, parts: Sequence[Step], how: str = "sum") -> Step:
    """Tables of one type reduced entry by entry: sum, mean, max, min, or stack (side by side)."""

    def combine(*xs):
        if how == "stack":
            return F.concat(*xs)
        out = xs[0]
        f = {"max": lambda a, b: F.greatest(a, b), "min": lambda a, b: F.least(a, b)}.get(how, lambda a, b: a + b)
        for x in xs[1:]:
            out = V.zipped(out, x, f)
        return V.scaled(out, 1 / len(xs)) if how == "mean" else out

    return node_map(name, parts[0].size * (len(parts) if how == "stack" else 1), combine, parts, parts[0].of)
