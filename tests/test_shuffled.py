"""Rows that iterations and layers send through shuffles, held against the number of edges."""

import random

import pytest

from lamina.operators import communities, message, order
from lamina.operators.durable import StageStore, sized
from lamina.plans import dataflow, forwards, models, trace
from lamina.plans import layers as L


def sent(spark, work):
    """(what work returns, the rows that each of its stages wrote to shuffles)."""
    store, gw = spark.sparkContext._jsc.sc().statusStore(), spark.sparkContext._gateway

    def stages():
        it, out = store.stageList(None, False, False, gw.new_array(gw.jvm.double, 0), gw.jvm.java.util.ArrayList()).iterator(), {}
        while it.hasNext():
            x = it.next()
            out[x.stageId(), x.attemptId()] = x.shuffleWriteRecords()
        return out

    before = max((k for k, _ in stages()), default=-1)
    result = work()
    return result, [n for (k, _), n in stages().items() if k > before]


def dense_graph(spark, left, right, share):
    """Edges both ways between two sets of nodes, their directions in rows of their own."""
    rng = random.Random(5)
    pairs = [(left + b, a) for a in range(left) for b in range(right) if rng.random() < share]
    return spark.createDataFrame(pairs, "src long, dst long"), spark.range(left + right).select("id"), len(pairs)


def test_attention_sends_edges_only_to_place_them(spark):
    session = sized(spark)  # as queries have it, with tables too large to broadcast
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    edges, ids, n = dense_graph(session, 400, 50, 0.5)
    both = L.durable(edges.union(edges.select("dst", "src")))
    nodes = L.durable(ids.selectExpr("id", "transform(sequence(0, 3), i -> double(pmod(hash(id, i), 64)) / 64) AS x"))
    plan, start = models.gat(4, 4, 2)
    rows, moved = sent(spark, lambda: plan.run(L.Graph(both, ids), {start: nodes})[0].collect())
    assert len(rows) == 450
    assert sum(m >= 2 * n for m in moved) < 4, moved  # to be written by source, then in cells; not once in each layer


def test_cuthill_mckee_sends_edges_only_to_place_them(spark):
    session = sized(spark)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    edges, ids, n = dense_graph(session, 300, 40, 0.5)
    rows, moved = sent(spark, lambda: order.cuthill_mckee(edges, ids).collect())
    assert len(rows) == 340
    assert sum(m >= 2 * n for m in moved) == 1, moved  # none in a round or level, where each task has a row at most for a destination


def test_communities_send_links_only_to_name_them(spark):
    session = sized(spark)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    edges, ids, n = dense_graph(session, 300, 40, 0.5)
    made, moved = sent(spark, lambda: communities.merges(edges, ids).count())
    assert made
    assert sum(m >= 2 * n for m in moved) < 4, moved  # for both directions, for the degrees and for the first round's names


@pytest.mark.parametrize("made", ["by hand", "traced"])
def test_edges_stay_in_cells_where_there_are_more_buckets(spark, made):
    """As on large inputs: values are sent to the cells of edges, not both to the buckets of nodes."""
    session = sized(spark)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    session.conf.set("spark.sql.shuffle.partitions", 40)
    edges, ids, n = dense_graph(session, 400, 50, 0.5)
    both = L.durable(edges.union(edges.select("dst", "src")))
    nodes = L.durable(ids.selectExpr("id", "transform(sequence(0, 3), i -> double(pmod(hash(id, i), 64)) / 64) AS x"))
    if made == "by hand":
        plan, start = models.gat(4, 4, 2)
        work = lambda: plan.run(L.Graph(both, ids), {start: nodes})[0].collect()
    else:
        store, traced = StageStore(session), trace.trace(forwards.gat(2, 4), 4)
        assert store.buckets > store.cells
        work = lambda: traced.flow.run(dataflow.stored_graph({None: both}, {None: nodes}, store), {traced.sources[0]: nodes}, store)[0].collect()
    rows, moved = sent(spark, work)
    assert len(rows) == 450
    assert sum(m >= 2 * n for m in moved) < 4, moved


def test_many_vectors_are_sent_to_cells_not_to_edges(spark):
    session = sized(spark)
    session.conf.set("spark.sql.autoBroadcastJoinThreshold", -1)
    session.conf.set("spark.sql.shuffle.partitions", 8)
    edges, ids, n = dense_graph(session, 100, 400, 0.5)
    vectors = session.range(20).selectExpr("id AS code", "transform(sequence(0, 15), i -> double(pmod(hash(id, i), 64)) / 64) AS x")
    coded = message.Coded(ids.selectExpr("id", "id % 20 AS code"), vectors, True)
    _, moved = sent(spark, lambda: message.update_all(edges, coded, "copy_u", "sum", 16).collect())
    assert sum(m >= n for m in moved) == 2, moved  # without features: to the sources' codes, then to the cells
