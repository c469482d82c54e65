"""Hand-made graphs: loops, hubs, isolated nodes, repeats, empty tables."""

import math

import numpy as np
import pytest

from lamina.functions import dense as D
from lamina.operators import batches, graph, message, order
from lamina.plans import layers as L
from lamina.plans import models, typed
from lamina.sources import graph_files, tables
from lamina.streaming import degrees


def edges(spark, rows):
    return spark.createDataFrame(rows, "src long, dst long")


def nodes(spark, n, width=2):
    return spark.createDataFrame([(i, [float(i + k) for k in range(width)]) for i in range(n)], "id long, x array<double>")


def test_csc_smoke(spark):
    e = edges(spark, [(3, 0), (8, 1), (8, 1), (7, 2)])
    seeds = spark.createDataFrame([(1,), (2,)], "id long")
    assert sorted(map(tuple, graph.restrict(e, seeds).collect())) == [(7, 2), (8, 1), (8, 1)]
    index, adjacency = graph.csc(e, spark.range(3).withColumnRenamed("id", "id"))
    assert sorted(map(tuple, index.collect())) == [(0, 0, 1), (1, 1, 2), (2, 3, 1)]
    assert [r.src for r in adjacency.orderBy("pos").collect()] == [3, 8, 8, 7]


def test_empty_and_isolated(spark):
    none = edges(spark, [])
    n = nodes(spark, 3)
    assert graph.in_degrees(none, n).agg({"degree": "sum"}).first()[0] == 0
    assert message.graph_conv(none, n, 2).where("x[0] != 0").count() == 0
    assert graph.simple(none).count() == 0


def test_loops_keep_existing(spark):
    e = edges(spark, [(0, 0)])
    assert graph.add_self_loops(e, nodes(spark, 1)).count() == 2


def test_softmax_sums_to_one_at_a_hub(spark):
    e = edges(spark, [(i, 0) for i in range(500)] + [(0, 1)])
    scored = e.selectExpr("src", "dst", "array(double(src % 7), double(src)) AS s")
    sums = message.edge_softmax(scored, 2).groupBy("dst").agg({"a": "count"}).count()
    assert sums == 2
    for r in message.edge_softmax(scored, 2).selectExpr("dst", "a[0] AS a", "a[1] AS b").groupBy("dst").sum("a", "b").collect():
        assert r[1] == pytest.approx(1) or r["sum(a)"] == pytest.approx(1)


def test_pack_meets_budgets():
    degrees_ = np.array([3, 0, 9, 2, 2, 2, 50, 1, 1])
    got = batches.pack(degrees_, 3, 8)
    assert list(got) == list(batches.packed_iter(degrees_, 3, 8))
    for b in set(got):
        own = degrees_[got == b]
        assert len(own) == 1 or (own.sum() < 8 and len(own) <= 3)
    assert batches.next_budget(2000, 8.0, 4.0) == 3600 and batches.halved(1) == 1


@pytest.mark.parametrize("section", [1, 16, 100, 1 << 20])
def test_budget_batches_equal_one_greedy_packing(spark, section):
    rng = np.random.default_rng(section)
    degrees_ = rng.integers(0, 9, 301)
    degrees_[[0, 40, 41, 300]] = 50, 90, 90, 99
    df = spark.createDataFrame([(i, i, int(d)) for i, d in enumerate(degrees_)], "id long, pos long, degree long")
    for max_nodes, max_edges in ((5, 20), (40, 30), (7, 10_000)):
        got = [r.batch for r in batches.by_budget(df, max_nodes, max_edges, section).orderBy("pos").collect()]
        assert got == batches.pack(degrees_, max_nodes, max_edges).tolist()
    assert batches.by_budget(df.limit(0), 5, 20).count() == 0


def test_typed_batches_of_ids_with_gaps(spark):
    df = spark.createDataFrame([("a", 1), ("a", 5), ("a", 9), ("b", 2), ("b", 1000)], "ntype string, id long")
    got = {(r.ntype, r.id): r.batch for r in batches.by_type(df, 2).collect()}
    assert got == {("a", 1): 0, ("a", 5): 0, ("a", 9): 1, ("b", 2): 0, ("b", 1000): 0}


def test_positions_and_sums(spark):
    df = spark.range(1000).selectExpr("999 - id AS id", "id AS degree")
    assert order.with_position(df, ["id"]).where("pos != id").count() == 0
    assert order.with_running_sum(df, "degree", ["id"], "s").where("s != (id + 1) * (999 + 999 - id) / 2").count() == 0


def test_cuthill_mckee_is_a_permutation_with_small_bandwidth(spark):
    path = [0, 7, 3, 9, 1, 8, 2, 6, 4, 5]
    e = edges(spark, list(zip(path, path[1:])))
    got = {r.id: r.pos for r in order.cuthill_mckee(e, spark.range(10)).collect()}
    assert sorted(got.values()) == list(range(10))
    assert max(abs(got[a] - got[b]) for a, b in zip(path, path[1:])) == 1


def test_text_round_trip_and_densify(spark, tmp_path):
    (tmp_path / "g.txt").write_text("# a comment\n5 9\n9\t5\n\n7 5\n")
    got = graph_files.read_edge_text(spark, str(tmp_path / "g.txt"))
    assert [(r.src, r.dst) for r in got.orderBy("line").collect()][:2] == [(5, 9), (9, 5)]
    dense, mapping = graph_files.densify(got)
    assert {r.raw: r.id for r in mapping.collect()} == {5: 0, 9: 1, 7: 2}
    assert sorted((r.src, r.dst) for r in dense.collect()) == [(0, 1), (1, 0), (2, 0)]
    graph_files.write_edge_text(dense, str(tmp_path / "out"))
    assert graph_files.read_edge_text(spark, str(tmp_path / "out")).count() == 3
    graph_files.write_graph(dense, str(tmp_path / "parquet"), 2)
    assert graph_files.read_graph(spark, str(tmp_path / "parquet")).count() == 3


def test_plan_stages_and_liveness():
    plan, _ = models.gcn([16, 16, 8])
    assert plan.layers == 2 and len(plan.stages()) == 3
    plan, _ = models.branching_net(4, 4)
    assert plan.layers == 7  # six convolutions and the mean in a row
    text = plan.explain()
    assert text.count("stage") == 8 and "x5" in text
    plan, _ = models.sum_net([4, 4, 4, 4])
    assert [s.name for s in plan.live_after(2)] == ["x1", "x2"]
    with pytest.raises(ValueError):
        plan.run(None, {})


def test_targets_equal_the_full_run(spark):
    e = edges(spark, [(i, (i * 7 + 1) % 30) for i in range(30)] + [(i, (i * 3) % 30) for i in range(30)])
    n = nodes(spark, 30)
    for made in (models.gcn([2, 2, 2]), models.sage([2, 2, 2])):
        plan, start = made
        g = L.Graph(e, n.select("id"))
        full = {r.id: r.x for r in plan.run(g, {start: n})[0].collect()}
        if made[0].order[-1].name.startswith("sage"):
            part = {r.id: r.x for r in plan.run(g, {start: n}, targets=n.select("id").where("id < 4"))[0].collect()}
            assert sorted(part) == [0, 1, 2, 3] and all(part[k] == pytest.approx(full[k]) for k in part)


def test_gelu_and_ties(spark):
    df = spark.createDataFrame([(0, [-1.0, 0.0, 2.0]), (1, [3.0, 3.0, 1.0])], "id long, x array<double>")
    got = [r.y for r in df.orderBy("id").select(D.gelu("x").alias("y")).collect()]
    assert got[0] == pytest.approx([v * 0.5 * (1 + math.erf(v / 2**0.5)) for v in (-1.0, 0.0, 2.0)])
    assert {r.id: r.predicted for r in models.predictions(df).collect()} == {0: 2, 1: 0}


def test_windowed_degrees_stream(spark, tmp_path):
    spark.sql("SELECT timestamp'2024-01-01 01:00:00' AS ts, 1L AS user_id, 'a' AS event_type, 2.0D AS value").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, user_id long, event_type string, value double").parquet(str(tmp_path / "in"))
    q = degrees.windowed_degrees(stream).writeStream.format("memory").queryName("deg").outputMode("complete").trigger(availableNow=True).start()
    q.awaitTermination()
    assert spark.table("deg").collect()[0].degree == 1


def test_several_files_keep_their_order(spark, tmp_path):
    (tmp_path / "g").mkdir()
    (tmp_path / "g" / "a.txt").write_text("1 2\n")
    (tmp_path / "g" / "b.txt").write_text("".join(f"{i} {i + 1}\n" for i in range(3, 3000, 2)))  # larger, so Spark reads it first
    _, mapping = graph_files.densify(graph_files.read_edge_text(spark, str(tmp_path / "g")))
    assert mapping.where("raw != id + 1").count() == 0
    graph_files.write_permutation(order.by_hash(spark.range(500)), str(tmp_path / "p"))
    back = graph_files.read_permutation(spark, str(tmp_path / "p"))
    assert back.exceptAll(order.by_hash(spark.range(500)).select("pos", "id")).count() == 0 and back.count() == 500


def test_csc_files(spark, tmp_path):
    e = edges(spark, [(3, 0), (8, 1), (8, 1), (7, 2)])
    graph_files.write_csc(*graph.csc(e, spark.range(3)), str(tmp_path / "c"))
    index, adjacency = graph_files.read_csc(spark, str(tmp_path / "c"))
    assert sorted(map(tuple, index.collect())) == [(0, 0, 1), (1, 1, 2), (2, 3, 1)] and adjacency.count() == 4


def test_refusal_masks_stack_and_symmetry(spark):
    e, n = edges(spark, [(0, 1), (0, 1)]), nodes(spark, 2)
    with pytest.raises(ValueError):
        message.refuse_zero_in_degree(e, n)
    assert message.refuse_zero_in_degree(graph.symmetrised(e), n) is n and graph.symmetrised(e).count() == 4
    index = spark.createDataFrame([(1,), (1,), (9,)], "id long")
    assert sorted(map(tuple, graph.masks_by_index(n, train=index, test=index.limit(0)).collect())) == [(0, False, False), (1, True, False)]
    assert {r.id: r.x for r in message.cross_reduced([n, n], "stack", 2).collect()} == {0: [0.0, 1.0, 0.0, 1.0], 1: [1.0, 2.0, 1.0, 2.0]}


def test_edge_messages(spark):
    e = edges(spark, [(0, 1), (1, 0)]).selectExpr("*", "array(2.0D, 4.0D) AS e")
    n = nodes(spark, 2)
    want = {"copy_e": [2.0, 4.0], "v_mul_e": [2.0, 8.0], "e_add_u": [2.0, 5.0], "e_sub_v": [1.0, 2.0], "v_dot_u": [2.0]}
    for op, first in want.items():
        got = {r.id: r.x for r in message.update_all(e, n, op, "sum", 2).collect()}
        assert first is None or got[1] == first


def test_path_longer_than_any_cap(spark):
    e = edges(spark, [(i, i + 1) for i in range(40)])
    got = {r.id: r.level for r in order.cuthill_mckee(e, spark.range(41)).collect()}
    assert got[40] == 40 and got[0] == 0


RELATIONS = [("a", "to", "b"), ("b", "back", "a"), ("a", "same", "a")]


def typed_graph(spark):
    rows = [(s, e, d, i, (i * k + r) % 12) for r, (s, e, d) in enumerate(RELATIONS) for k in (3, 5) for i in range(12) if i % 4 != r]
    e = spark.createDataFrame(rows, "src_type string, etype string, dst_type string, src long, dst long")
    n = [(t, i, [(i * 3 + j + len(t)) % 7 / 8 for j in range(4)]) for t in ("a", "b") for i in range(12)]
    return e, spark.createDataFrame(n, "ntype string, id long, x array<double>")


@pytest.mark.parametrize("made", [models.rgcn(RELATIONS, [4, 3, 2]), models.rgcn_basis(RELATIONS, [4, 3, 2], 2), models.hgt(RELATIONS, 4, 2, 2)])
def test_typed_targets_equal_the_full_run(spark, made):
    e, n = typed_graph(spark)
    seen = []
    full = {(r.ntype, r.id): r.x for r in typed.run(made, e, n, after=lambda k, x, took: seen.append((k, x.count(), took >= 0))).collect()}
    assert seen == [(0, 24, True)] and len(full) == 24
    targets = n.where("ntype = 'a' AND id IN (2, 5) OR ntype = 'b' AND id = 7")
    part = {(r.ntype, r.id): r.x for r in typed.run(made, e, n, targets).collect()}
    assert sorted(part) == [("a", 2), ("a", 5), ("b", 7)] and all(part[k] == pytest.approx(full[k]) for k in part)
    assert typed.run(made, e, n, targets.limit(0)).count() == 0


def test_embedded_features_go_before_learned_rows(spark):
    schema = "ntype string, id long, x array<double>"
    own = spark.createDataFrame([("a", 1), ("b", 1), ("b", 2), ("c", 1)], "ntype string, id long")
    feats = spark.createDataFrame([("a", 1, [1.0, 2.0]), ("b", 1, [5.0]), ("a", 9, [0.0, 0.0])], schema)
    learned = spark.createDataFrame([("b", 1, [6.0]), ("b", 2, [7.0])], schema)
    got = {(r.ntype, r.id): r.x for r in typed.embedded(own, feats, learned, {"a": np.array([[1.0], [10.0]])}).collect()}
    assert got == {("a", 1): [21.0], ("b", 1): [5.0], ("b", 2): [7.0]}


def test_stage_hooks(spark):
    plan, start = models.gcn([2, 2, 2])
    n, calls = nodes(spark, 3), []
    g = L.Graph(edges(spark, [(0, 1), (1, 2)]), n.select("id"))
    plan.run(g, {start: n}, before=lambda k, t, took: calls.append(("before", k, took)), after=lambda k, t, took: calls.append(("after", k, sorted(t), took >= 0)))
    assert [c[:2] for c in calls] == [(when, k) for k in range(3) for when in ("before", "after")] and all("x" in c[2] for c in calls if c[0] == "after" and c[1] < 1)


def test_hashed_features_are_uniform(spark):
    r = tables.hashed_nodes(spark.range(2000), 2, 4).collect()
    x = np.array([v.x for v in r])
    assert 0 <= x.min() and x.max() < 1 and abs(x.mean() - 0.5) < 0.03 and {v.label for v in r} == {0, 1, 2, 3}
