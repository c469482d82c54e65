"""Transforms of edge tables (src, dst) and node tables (id, ...)."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .durable import durable


def symmetrised(edges: DataFrame) -> DataFrame:
    """Edges and their reverses, repeats kept: one relation of a type to itself."""
    return edges.unionByName(edges.withColumns({"src": F.col("dst"), "dst": F.col("src")}))


def reverse(edges: DataFrame) -> DataFrame:
    return edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))


def simple(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").distinct()


def bidirected(edges: DataFrame) -> DataFrame:
    return edges.select("src", "dst").unionByName(reverse(edges)).distinct()


def add_self_loops(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """One more edge for each node, even where it has a loop."""
    return edges.select("src", "dst").unionByName(nodes.select(F.col("id").alias("src"), F.col("id").alias("dst")))


def in_degrees(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, degree), zero where nothing comes in."""
    counted = edges.groupBy(F.col("dst").alias("id")).agg(F.count(F.lit(1)).alias("degree"))
    return nodes.select("id").join(counted, "id", "left").select("id", F.coalesce("degree", F.lit(0)).cast("long").alias("degree"))


def average_in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    e = edges.agg(F.count(F.lit(1)).alias("e"))
    n = nodes.agg(F.count(F.lit(1)).alias("n"))
    return e.join(F.broadcast(n)).select((F.col("e") / F.col("n")).alias("avg_degree"))  # one row each


def restrict(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """In-edges of the seeds (id): a one-hop block."""
    return edges.join(seeds.select(F.col("id").alias("dst")).distinct(), "dst", "left_semi").select(*edges.columns)


def frontier(edges: DataFrame, seeds: DataFrame) -> DataFrame:
    """(id): the seeds and the sources of their in-edges."""
    return seeds.select("id").unionByName(restrict(edges, seeds).select(F.col("src").alias("id"))).distinct()


def hops(edges: DataFrame, seeds: DataFrame, n: int) -> list[DataFrame]:
    """Nodes needed at each of n layers, from the inputs of the first to the seeds."""
    out = [seeds.select("id").distinct()]
    for _ in range(n):
        out.append(frontier(edges, out[-1]))
    return out[::-1]


def fan_out(edges: DataFrame, k: int, seed: int = 0) -> DataFrame:
    """At most k in-edges of each dst, those with the smallest hash: a repeatable sample. Spark drops the surplus before the shuffle."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), "src", "dst"))
    rank = F.row_number().over(Window.partitionBy("dst").orderBy("_key", "src"))
    return edges.withColumn("_key", key).withColumn("_rank", rank).where(F.col("_rank") <= k).select(*edges.columns)


def targets_by_ratio(order: DataFrame, ratio: float) -> DataFrame:
    """The first int(n * ratio) nodes of (id, pos)."""
    n = order.count()
    return order.where(F.col("pos") < int(n * ratio)).select("id")


def ratio_layers(edges: DataFrame, nodes: DataFrame, targets: DataFrame, layers: int, limit: float = 0.8) -> list[DataFrame]:
    """Node sets from the first layer to the last: the targets widened by a hop a layer, or all nodes once targets * average degree exceeds limit * n."""
    n, avg = nodes.count(), average_in_degree(edges, nodes).first()[0]
    out = [durable(targets)]
    whole = False
    for _ in range(layers - 1):
        whole = whole or out[-1].count() * avg > limit * n
        # Stored: the next layer counts it and widens it.
        out.append(nodes.select("id") if whole else durable(frontier(edges, out[-1])))
    return out[::-1]


def induced(edges: DataFrame, mask: DataFrame) -> DataFrame:
    """Edges with both ends in mask (id)."""
    kept = edges.join(mask.select(F.col("id").alias("src")), "src", "left_semi")
    return kept.join(mask.select(F.col("id").alias("dst")), "dst", "left_semi").select("src", "dst")


def split_masks(nodes: DataFrame) -> DataFrame:
    """(id, split): id modulo 10 is 0-5 train, 6-7 val, 8-9 test."""
    k = F.pmod("id", F.lit(10))
    return nodes.select("id", F.when(k <= 5, "train").when(k <= 7, "val").otherwise("test").alias("split"))


def masks_by_index(nodes: DataFrame, **splits: DataFrame) -> DataFrame:
    """(id, one boolean column for each split): whether the node is in that split's index table (id)."""
    out = nodes.select("id")
    for name, index in splits.items():
        out = out.join(index.select("id").distinct().withColumn(name, F.lit(True)), "id", "left").withColumn(name, F.coalesce(name, F.lit(False)))
    return out


def with_reverse_relations(edges: DataFrame) -> DataFrame:
    """Typed edges and, for each, its reverse of type rev-<etype>."""
    back = edges.select(F.col("dst_type").alias("src_type"), F.concat(F.lit("rev-"), "etype").alias("etype"), F.col("src_type").alias("dst_type"), F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.unionByName(back)


def relation(edges: DataFrame, src_type: str, etype: str, dst_type: str) -> DataFrame:
    return edges.where((F.col("src_type") == src_type) & (F.col("etype") == etype) & (F.col("dst_type") == dst_type))


def relation_counts(edges: DataFrame) -> DataFrame:
    """Edges, sources and destinations of each relation: two counts by node, then by relation, so no distinct expands the rows."""
    keys = ["src_type", "etype", "dst_type"]
    src = edges.groupBy(*keys, "src").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.sum("n").alias("n_edges"), F.count(F.lit(1)).alias("n_src"))
    dst = edges.groupBy(*keys, "dst").agg(F.count(F.lit(1)).alias("n")).groupBy(*keys).agg(F.count(F.lit(1)).alias("n_dst"))
    return src.join(dst, keys)


def csc(edges: DataFrame, nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(index (id, first, degree), adjacency (dst, pos, src)): compressed columns, pos counting the edges by dst and src."""
    from .order import with_position, with_running_sum

    index = with_running_sum(in_degrees(edges, nodes), "degree", ["id"], "_end").select("id", (F.col("_end") - F.col("degree")).alias("first"), "degree")
    return index, with_position(edges.select("dst", "src"), ["dst", "src"]).select("dst", "pos", "src")
