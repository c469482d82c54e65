"""Traced functions, step graphs, the stage store and bucketed graphs."""

import glob

import numpy as np
import pytest
from pyspark.sql import functions as F

from lamina.functions import dense as D
from lamina.operators import message as M
from lamina.operators.durable import StageStore
from lamina.plans import dataflow as P
from lamina.plans import forwards, models, trace
from lamina.plans import layers as L
from lamina.sources import graph_files

EDGES = [(0, 1), (1, 2), (2, 0), (0, 2), (3, 3), (0, 1), (5, 2), (4, 2)]


@pytest.fixture
def graph(spark):
    store = StageStore(spark, 4)
    nodes = spark.createDataFrame([(i, [i / 4.0, 1.0, -i / 8.0]) for i in range(7)], "id long, x array<double>")
    x = store.put(nodes.repartition(4, "id"), "features")
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    return store, P.stored_graph({None: edges}, {None: x}, store), x, edges, nodes


def vectors(df):
    return {r.id: np.array(r.x) for r in df.collect()}


def same(a, b):
    assert a.keys() == b.keys()
    for k in a:
        assert np.allclose(a[k], b[k]), k


def test_traced_models_are_the_plans_by_hand(spark, graph):
    store, g, x, edges, nodes = graph
    for made, forward in ((models.gat(3, 4, 2), forwards.gat(2, 4)), (models.sage([3, 4, 2]), forwards.sage([3, 4, 2])), (models.sum_net([3, 2, 2, 2]), forwards.sum_net([3, 2, 2, 2])), (models.jknet(3, 2, 2, mode="max"), forwards.jknet(2, 2, mode="max"))):
        plan, start = made
        want = plan.run(L.Graph(edges, nodes.select("id")), {start: nodes.select("id", "x")})[0]
        traced = trace.trace(forward, 3)
        got = traced.flow.run(g, {traced.sources[0]: x}, store, only_outputs=False)[0]
        same(vectors(got), vectors(want))
        targets = spark.createDataFrame([(2,), (6,)], "id long")
        part = traced.flow.run(g, {traced.sources[0]: x}, store, {None: targets}, only_outputs=False)[0]
        same(vectors(part), {k: v for k, v in vectors(want).items() if k in (2, 6)})


def test_a_layer_over_buckets_exchanges_no_edges(spark, graph, tmp_path):
    _, _, _, edges, nodes = graph
    graph_files.write_bucketed_graph(edges, nodes, str(tmp_path), 4)
    by_src, by_dst, ids = graph_files.read_bucketed_graph(spark, str(tmp_path))
    assert sorted(map(tuple, by_src.collect())) == sorted(map(tuple, by_dst.collect())) == sorted(EDGES)
    was = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        out = M.update_all(by_src, ids, "copy_u", "sum", 3)
        plan = out._jdf.queryExecution().executedPlan().toString()
        assert plan.count("Exchange hashpartitioning(") == 1 and "Exchange hashpartitioning(dst" in plan  # of partial sums, behind the join
        assert plan.index("partial_sum") > plan.index("Exchange")
        counted = by_dst.groupBy("dst").count()._jdf.queryExecution().executedPlan().toString()
        assert "Exchange" not in counted
        same(vectors(out), vectors(M.update_all(edges, nodes, "copy_u", "sum", 3)))
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", was)


def test_only_outputs_remain_in_the_store(graph):
    store, g, x, _, _ = graph
    seen = []
    traced = trace.trace(forwards.gat(2, 4), 3)
    out = traced.flow.run(g, {traced.sources[0]: x}, store, after=lambda n, tables, seconds: seen.append((n, sorted(tables))))[0]
    assert [n for n, _ in seen] == [0, 1, 2]
    assert len(glob.glob(f"{store.folder.removeprefix('file:')}/*")) == 1 and store.owns(out)
    assert out.count() == 7
    store.release(out)
    assert not glob.glob(f"{store.folder.removeprefix('file:')}/*")


def test_edge_values_live_across_stages(spark, graph):
    store, g, x, _, _ = graph

    def forward(g, x):
        g.ndata["x"] = x
        g.apply_edges(trace.u_dot_v("x", "x", "s"))
        a = trace.edge_softmax(g, g.edata["s"])
        g.edata["a"] = a
        for _ in range(2):
            g.update_all(trace.u_mul_e("x", "a", "m"), trace.sum_("m", "x"))
            g.srcdata["x"] = g.dstdata["x"]
        return g.dstdata["x"], a

    traced = trace.trace(forward, 3)
    assert traced.shapes == [(3,), (1,)] and "softmax0" in traced.flow.explain().splitlines()[1].split("kept:")[1]
    nodes, edges = traced.flow.run(g, {traced.sources[0]: x}, store)
    v = {i: np.array([i / 4.0, 1.0, -i / 8.0]) for i in range(7)}
    top = {d: [np.exp(v[s] @ v[d]) for s, e in EDGES if e == d] for d in range(7)}
    weight = [(s, d, np.exp(v[s] @ v[d]) / sum(top[d])) for s, d in EDGES]
    got = sorted((r.src, r.dst, r.x[0]) for r in edges.collect())
    assert np.allclose(got, sorted(weight))
    for _ in range(2):
        v = {i: sum((w * v[s] for s, d, w in weight if d == i), np.zeros(3)) for i in range(7)}
    same(vectors(nodes), v)


def test_arithmetic_shapes_and_frames(graph):
    store, g, x, _, _ = graph

    def forward(g, x, scale=None):
        assert scale is None and x.shape[1:] == (3,) and x[: g.number_of_dst_nodes()] is x
        wide = trace.linear(x, np.arange(12.0).reshape(3, 4), np.ones(4)).view(x.shape[:-1] + (2, -1))
        both = (wide * np.array([[[1.0], [2.0]]]) - wide.sum(-1, keepdim=True) / 2.0).flatten(1)
        return trace.concat([trace.relu(-both), 1.0 - both.view(trace.ROWS, 2, 2).mean(2)]), x.mean()

    traced = trace.trace(forward, 3, scale=None)
    out, mean = traced.flow.run(g, {traced.sources[0]: x}, store)
    rows = np.array([[i / 4.0, 1.0, -i / 8.0] for i in range(7)])
    wide = (rows @ np.arange(12.0).reshape(3, 4) + 1).reshape(7, 2, 2)
    both = wide * np.array([[[1.0], [2.0]]]) - wide.sum(-1, keepdims=True) / 2
    same(vectors(out), dict(enumerate(np.concatenate([np.maximum(-both.reshape(7, 4), 0), 1 - both.mean(2)], 1))))
    same(vectors(mean), {i: np.array([rows.mean()]) for i in range(7)})


def test_what_a_trace_refuses():
    for bad, error in (
        (lambda g, x: x[1:], ValueError), (lambda g, x: x[0], ValueError), (lambda g, x: x.view(3), ValueError), (lambda g, x: x.sum(0), ValueError),
        (lambda g, x: trace.linear(x, np.ones((2, 2))), ValueError), (lambda g, x: 3, TypeError), (lambda g, x: trace.u_pow_v, AttributeError),
        (lambda g, x: g.update_all(trace.copy_u("x", "m"), trace.sum_("n", "y")), (ValueError, KeyError)),
    ):
        with pytest.raises(error):
            trace.trace(bad, 3)

    def mixed(g, x):
        g.ndata["x"] = x
        g.apply_edges(trace.copy_u("x", "e"))
        return x + g.edata["e"]

    with pytest.raises(ValueError, match="messages"):
        trace.trace(mixed, 3)


def test_inputs_must_fit(spark, graph):
    store, g, x, _, _ = graph
    traced = trace.trace(forwards.sage([3, 2]), 3)
    with pytest.raises(ValueError, match="x0"):
        traced.flow.run(g, {}, store)


RELATIONS = [("a", "to", "b"), ("b", "to", "c"), ("c", "back", "a"), ("a", "own", "a")]


def typed(spark, store):
    edges = {("a", "to", "b"): [(0, 0), (1, 0), (0, 1), (0, 1)], ("b", "to", "c"): [(0, 0), (1, 2)], ("c", "back", "a"): [(2, 1)], ("a", "own", "a"): []}
    nodes = {t: [(i, [i + 0.5, float(len(t) + k)]) for i in range(3)] for k, t in enumerate("abc")}
    x = {t: store.put(spark.createDataFrame(n, "id long, x array<double>"), f"x {t}") for t, n in nodes.items()}
    frames = {r: spark.createDataFrame(e, "src long, dst long") for r, e in edges.items()}
    return edges, {t: {i: np.array(v) for i, v in n} for t, n in nodes.items()}, x, P.stored_graph(frames, x, store)


def test_typed_steps_that_no_output_needs_do_not_run(spark):
    store = StageStore(spark, 4)
    edges, values, x, g = typed(spark, store)
    one = trace.trace_typed(forwards.rgcn([2, 3]), RELATIONS, 2, out_key="b")
    text = one.flow.explain()
    assert "[c]" in text.splitlines()[-1] and "[c]" not in text.splitlines()[0] and [s.of for s in one.flow.sources()] == ["a"]
    got = one.flow.run(g, {one.sources["a"]: x["a"]}, store, only_outputs=False)[0]
    w = D.weights(0, 2, 3)
    want = {d: np.mean([values["a"][s] @ w + D.bias(0, 3) for s, e in edges["a", "to", "b"] if e == d] or [np.zeros(3)], axis=0) for d in range(3)}
    same(vectors(got), want)
    two = trace.trace_typed(forwards.rgcn([2, 3, 3]), RELATIONS, 2, out_key="c")
    inputs = {two.sources[t]: x[t] for t in "abc" if two.sources[t] in two.flow.level}
    whole = vectors(two.flow.run(g, inputs, store, only_outputs=False)[0])
    part = vectors(two.flow.run(g, inputs, store, {"c": spark.createDataFrame([(2,), (2,)], "id long")}, only_outputs=False)[0])
    same(part, {2: whole[2]})
    assert all("back" not in m["name"] or "by src" in m["name"] for m in store.measures)  # no other table of a relation that c doesn't depend on


@pytest.mark.parametrize("cross", ["sum", "mean", "max", "min", "stack"])
def test_typed_cross_reductions(spark, cross):
    store = StageStore(spark, 4)
    edges, values, x, g = typed(spark, store)

    def forward(g, h):
        for t, v in h.items():
            g.frames[t]["x"] = v
        g.multi_update_all({"back": (trace.copy_u("x", "m"), trace.sum_("m", "y")), ("a", "own", "a"): (trace.copy_u("x", "m"), trace.sum_("m", "y"))}, cross)
        return g.frames["a"]["y"]

    traced = trace.trace_typed(forward, RELATIONS, 2)
    got = traced.flow.run(g, {traced.sources[t]: x[t] for t in "ac"}, store)[0]
    parts = lambda i: [sum((values[r[0]][s] for s, d in edges[r] if d == i), np.zeros(2)) for r in (("c", "back", "a"), ("a", "own", "a"))]
    f = {"sum": np.sum, "mean": np.mean, "max": np.max, "min": np.min}.get(cross)
    same(vectors(got), {i: np.concatenate(parts(i)) if cross == "stack" else f(parts(i), axis=0) for i in range(3)})


def test_heterogeneous_attention_with_priors(spark):
    store = StageStore(spark, 4)
    edges, values, x, g = typed(spark, store)
    priors = {r: [0.5, 2.0] for r in RELATIONS}
    frames = [spark.createDataFrame([(*r, s, d) for r, e in edges.items() for s, d in e], "src_type string, etype string, dst_type string, src long, dst long"), spark.createDataFrame([(t, i, v.tolist()) for t, n in values.items() for i, v in n.items()], "ntype string, id long, x array<double>")]
    want = models.hgt_layer(*frames, RELATIONS, 2, 2, priors=priors)
    traced = trace.trace_typed(forwards.hgt(2, 2, 1, priors=priors), RELATIONS, 2)
    for t, out in zip("abc", traced.flow.run(g, {traced.sources[t]: x[t] for t in "abc"}, store), strict=True):
        same(vectors(out), vectors(want.where(F.col("ntype") == t)))


def test_measures_are_those_of_the_tables(spark):
    store = StageStore(spark, 4, counters={"t": {"total": F.sum("id"), "top": F.max("id")}})
    t = store.put(spark.range(100), "t")
    store.put(spark.range(7), "u")
    first, second = store.measures
    assert (first["rows"], first["total"], first["top"], second["rows"]) == (100, 4950, 99, 7) and first["bytes"] > 0 and first["seconds"] > 0
    assert store.totals()["rows"] == 107 and store.totals()["total"] == 4950
    store.release(t, spark.range(1))
    assert not store.owns(t)


def test_empty_graphs(spark):
    store = StageStore(spark, 4)
    x = store.put(spark.createDataFrame([], "id long, x array<double>"), "x")
    g = P.stored_graph({None: spark.createDataFrame([], "src long, dst long")}, {None: x}, store)
    traced = trace.trace(forwards.gat(2, 4), 3)
    assert traced.flow.run(g, {traced.sources[0]: x}, store)[0].count() == 0


class Stopped(Exception):
    pass


class Failing(StageStore):
    """Stops at the n-th table that is written."""

    left = 10**9

    def put(self, df, name="table", key="id", tag=None):
        if tag not in self._entries:
            self.left -= 1
            if self.left < 0:
                raise Stopped(name)
        return super().put(df, name, key, tag)


def resumed(spark, name, nodes, edges, only=None, left=10**9, targets=None, stop_after=None):
    store = Failing(spark, 4, run=name)
    store.left = left
    traced = trace.trace(forwards.gat(2, 4), 3)
    seen = []

    def after(n, tables, seconds):
        seen.append(n)
        if n == stop_after:
            raise Stopped(n)

    try:
        x = store.put(nodes.repartition(4, "id"), "features", "id", "features")
        g = P.stored_graph({None: edges}, {None: nodes.select("id")}, store)
        out = traced.flow.run(g, {traced.sources[0]: x}, store, targets, after=after)[0]
    except Stopped:
        return store, seen, None
    return store, seen, vectors(out)


def test_stopped_runs_go_on_behind_the_last_finished_stage(spark, graph):
    *_, edges, nodes = graph
    _, stages, want = resumed(spark, "whole", nodes, edges)
    assert stages == list(range(len(stages))) and len(stages) > 1
    store, seen, none = resumed(spark, "after-0", nodes, edges, stop_after=0)
    assert none is None and seen == [0]
    store, seen, got = resumed(spark, "after-0", nodes, edges)
    assert seen == stages[1:] and not any("features" == m["name"] or m["name"].startswith("edges") for m in store.measures)  # nothing was made twice
    same(got, want)
    left = [e["path"] for e in store._entries.values() if "path" in e]
    assert len(left) == 1 and {p.rpartition("/")[2] for p in left} | {"manifest"} == {p.rpartition("/")[2] for p in glob.glob(f"{store.folder.removeprefix('file:')}/*")}
    store, seen, got = resumed(spark, "after-0", nodes, edges)  # a finished run is read
    assert seen == []
    same(got, want)


@pytest.mark.parametrize("left", [1, 4, 6])
def test_runs_stopped_within_a_stage(spark, graph, left):
    *_, edges, nodes = graph
    targets = {None: spark.createDataFrame([(2,), (6,)], "id long")}
    for given in (None, targets):
        name = f"within-{left}-{given is None}"
        assert resumed(spark, name, nodes, edges, left=left, targets=given)[2] is None
        got = resumed(spark, name, nodes, edges, targets=given)[2]
        want = resumed(spark, f"{name}-whole", nodes, edges, targets=given)[2]
        same(got, want)


def test_a_run_of_another_step_graph_is_refused(spark, graph):
    *_, edges, nodes = graph
    resumed(spark, "other", nodes, edges, stop_after=0)
    store = StageStore(spark, 4, run="other")
    traced = trace.trace(forwards.sage([3, 4, 2]), 3)
    with pytest.raises(ValueError, match="another step graph"):
        traced.flow.run(P.stored_graph({None: edges}, {None: nodes.select("id")}, store), {traced.sources[0]: store.opened("features")}, store)
    with pytest.raises(ValueError, match="4 buckets"):
        StageStore(spark, 8, run="other").opened("features")


def test_each_softmax_is_written_once(spark):
    """Three relations in two layers, however many waves their stages have."""
    from lamina import queries as Q

    store = StageStore(spark, 4)
    Q._typed_flow(spark, "/root/testdata/sf0.001", forwards.hgt(8, 2, 2), width=8, store=store).count()
    assert sum(m["name"] == "within a stage" for m in store.measures) == 6


def test_edges_stay_in_cells_and_those_of_hubs_lie_in_many(spark):
    """Nothing with a row for each edge is written after the graph; a softmax is that of all cells, masked edges (-inf) too."""
    edges = [(0, d) for d in range(2, 300)] + [(s, 1) for s in range(2, 300)] + [(0, 1), (0, 1), (1, 1)]
    store = StageStore(spark, 8)
    x = store.put(spark.createDataFrame([(i, [float("-inf") if i == 1 or i % 50 == 7 else i / 64.0]) for i in range(301)], "id long, x array<double>").repartition(8, "id"), "features")
    g = P.stored_graph({None: spark.createDataFrame(edges, "src long, dst long")}, {None: x}, store)
    placed = g.placed[None]
    assert sorted((r.src, r.dst) for r in placed.edges.collect()) == sorted(edges)
    assert all(placed.edges.where(f"{end} = {hub}").select("cell").distinct().count() == store.cells > 1 for end, hub in (("src", 0), ("dst", 1)))

    def forward(g, x):
        g.srcdata["x"], g.srcdata["h"] = x, x.mapped(lambda c: F.array(F.when(c[0] < 0, 1.0).otherwise(c[0])))
        g.apply_edges(trace.copy_u("x", "s"))
        g.edata["a"] = trace.edge_softmax(g, g.edata["s"])
        g.update_all(trace.u_mul_e("h", "a", "m"), trace.sum_("m", "h"))
        return g.dstdata["h"]

    traced = trace.trace(forward, 1)
    seen = len(store.measures)
    got = vectors(traced.flow.run(g, {traced.sources[0]: x}, store)[0])
    assert all(m["rows"] <= 301 for m in store.measures[seen:])
    v = {s: s / 64.0 for s, d in edges if d == 1 and s != 1 and s % 50 != 7}
    e = [np.exp(v[s]) for s, d in edges if d == 1 and s in v]
    assert np.allclose(got[1], sum(w * v[s] for w, s in zip(e, [s for s, d in edges if d == 1 and s in v], strict=True)) / sum(e))
    assert all(got[d][0] == 0 for d in (2, 200, 300))
