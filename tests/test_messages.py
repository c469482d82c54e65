"""Vectors by code, edges dealt by destination, and shuffles sized by the input."""

import numpy as np
import pytest

from lamina import queries as Q
from lamina.functions import vectors as V
from lamina.operators import durable, message

SF = "/root/testdata/sf0.001"
EDGES = [(i % 7, 0) for i in range(60)] + [(1, 2), (2, 2), (6, 3), (9, 3), (0, 9)]  # 9 is no node, 0 is a hub


@pytest.fixture
def graph(spark):
    edges = spark.createDataFrame(EDGES, "src long, dst long")
    ids = spark.createDataFrame([(i, i % 3) for i in range(7)], "id long, code long")
    vectors = spark.createDataFrame([(c, [c - 1.0, 2.0 * c + 1.0]) for c in range(3)], "code long, x array<double>")
    return edges, message.Coded(ids, vectors), ids.join(vectors, "code").select("id", "x")


def rows(df):
    return {r.id: list(r.x) for r in df.collect()}


@pytest.mark.parametrize("op", ["copy_u", "u_sub_v", "u_mul_e", "copy_e"])
@pytest.mark.parametrize("how", ["sum", "mean", "max"])
def test_coded_nodes_give_what_nodes_give(graph, op, how):
    edges, coded, nodes = graph
    from pyspark.sql import functions as F

    e = F.array((F.col("src") + 1.0), F.col("dst") * 2.0)
    want = rows(message.update_all(edges.withColumn("e", e), nodes, op, how, 2))
    got = rows(message.update_all(edges, coded, op, how, 2, e))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("norm", ["both", "right", "none"])
def test_convolution_of_coded_nodes(graph, norm):
    edges, coded, nodes = graph
    got, want = rows(message.graph_conv(edges, coded, 2, norm)), rows(message.graph_conv(edges, nodes, 2, norm))
    assert got.keys() == want.keys() == set(range(7)) and all(np.allclose(got[k], want[k]) for k in want)
    assert rows(message.update_all(edges, coded.mapped(lambda x: V.scaled(x, 2.0)), "copy_u", "max", 2))[2] == [2.0, 10.0]


def test_a_hub_is_dealt_to_several_tasks(spark, graph):
    from pyspark.sql import functions as F

    edges = graph[0]
    dealt = message._dealt(edges, edges.withColumn("n", F.lit(1)), 10)
    assert sorted((r.src, r.dst) for r in dealt.collect()) == sorted(EDGES)
    at = dealt.where("dst = 0").select(F.spark_partition_id().alias("p")).distinct()
    old = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        assert at.count() > 1
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", old)


def test_shuffles_grow_with_the_input(spark, monkeypatch):
    """Each query runs in a session of its own, with a task for each SHARE bytes; the caller's session stays as it is."""
    monkeypatch.setattr(durable, "SHARE", 1 << 14)
    seen = []
    monkeypatch.setattr(Q.tables, "edges", lambda s, d: seen.append(s.conf.get("spark.sql.shuffle.partitions")) or Q.graph.simple(Q.tables.raw_edges(s, d)))
    before = spark.conf.get("spark.sql.shuffle.partitions")
    assert Q.QUERIES["edge_dedupe"](spark, SF).count() == 1905
    assert Q.QUERIES["in_degree"](spark, SF).count() == 210
    assert int(seen[0]) > 15 and spark.conf.get("spark.sql.shuffle.partitions") == before


@pytest.mark.parametrize("op", ["copy_u", "u_sub_v", "u_mul_e"])
@pytest.mark.parametrize("how", ["mean", "max"])
def test_many_vectors_go_to_cells(spark, graph, op, how, monkeypatch):
    from pyspark.sql import functions as F

    edges, coded, nodes = graph
    monkeypatch.setattr(message, "_marked", lambda e, r, hub=10, of=message._marked: of(e, r, hub))  # 0 is a hub
    many = message.Coded(coded.ids.withColumn("by", F.lit(2.0)), coded.vectors, True)
    e = F.array((F.col("src") + 1.0), F.col("dst") * 2.0)
    want = rows(message.update_all(edges.withColumn("e", e), nodes.withColumn("x", V.scaled("x", 2.0)), op, how, 2))
    got = rows(message.update_all(edges, many, op, how, 2, e))
    assert got.keys() == want.keys() and all(np.allclose(got[k], want[k]) for k in want)


@pytest.mark.parametrize("name", ["multi_relation_mean", "multi_relation_max", "v_add_e", "gcn_norm_both"])
def test_queries_over_many_vectors_give_what_sql_gives(spark, name, monkeypatch):
    import duckdb

    monkeypatch.setattr(Q.tables, "FEW_VECTORS", 10)
    duck = duckdb.connect()
    for t in ("part", "supplier", "customer", "orders", "lineitem", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    want = duck.execute(Q.ORACLES[name]).fetchall()
    columns = [c[0] for c in duck.description]
    got = [tuple(r) for r in Q.QUERIES[name](spark, SF).select(*columns).collect()]
    assert sorted(got) == sorted(want)


def test_many_rows_in_a_small_file_are_not_broadcast(spark, tmp_path):
    """The driver would collect them: a million keys are 4 MB as a file and over 60 MB in a broadcast."""
    for name in "ab":
        spark.range(1_000_000).write.parquet(f"{tmp_path}/{name}")
    session = durable.sized(spark)
    met = session.read.parquet(f"{tmp_path}/a").join(session.read.parquet(f"{tmp_path}/b"), "id")
    assert "Broadcast" not in met._jdf.queryExecution().executedPlan().toString()
    assert met.count() == 1_000_000
