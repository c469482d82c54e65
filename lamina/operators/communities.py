"""Communities by merging along modularity gains, and the node order that keeps each of them together.

In a round every community asks its neighbour of the greatest gain, if that one is of higher rank; those that ask nobody of higher rank take in the ones that ask them. So a
round is a few joins over the links between communities, which shrink; what was merged into what makes a forest, whose depth-first order is the order of the nodes.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import Scratch, StageStore, durable
from .order import with_running_sum

#: Up to so many merges of a round are summed by parent in windows; beyond, by ranges that cut parents apart.
SMALL_ROUND = 100_000


def _links(edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(a, b, w) in both directions: the edges between two nodes, whatever their direction. Loops don't count. With parts, so many by a."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    both = both.where("src != dst")
    return (both if parts is None else both.repartition(parts, "src")).groupBy(F.col("src").alias("a"), F.col("dst").alias("b")).agg(F.count(F.lit(1)).alias("w"))


def _whole(c: str | Column) -> Column:
    """Of products of two of these no digit is lost."""
    return (F.col(c) if isinstance(c, str) else c).cast("decimal(18,0)")


def _within(rows: DataFrame, value: str, order: list[str | Column], name: str, small: bool) -> DataFrame:
    """rows with the sum of value over the rows before it that have the same parent."""
    if small:
        before = Window.partitionBy("parent").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
        return rows.withColumn(name, F.coalesce(F.sum(value).over(before), F.lit(0)))
    summed = durable(with_running_sum(rows, value, ["parent", *order], "_upto"))
    first = summed.groupBy("parent").agg(F.min(F.col("_upto") - F.col(value)).alias("_first"))
    return summed.join(first, "parent").withColumn(name, F.col("_upto") - F.col(value) - F.col("_first")).drop("_upto", "_first")


def merges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, parent, round, at): the community named by node id went into parent's in that round, its nodes behind the at nodes that parent's then had.

    A community is named by its first node; one that has gone into another names nothing any more, so each node is here once at most. Repeated edges weigh as often as
    they stand, directions and loops don't count. Of several that ask the same community those with most edges to it for their degree go first; one goes in only
    if the modularity grows even though the ones before it went in, so it grows with every merge. Rounds end when no two communities would gain by merging.
    """
    scratch, store = Scratch(edges.sparkSession), StageStore(edges.sparkSession)
    # Links lie by a, communities by id: a community's own links are met and compared where they lie, and sent only to be named anew.
    by = lambda df, key: store.put(df, "communities", key)
    unnamed = by(_links(edges, store.buckets), "a")
    degree = unnamed.groupBy(F.col("a").alias("id")).agg(F.sum("w").alias("k"))
    heads = by(nodes.select("id").distinct().join(degree, "id", "left").select("id", F.coalesce("k", F.lit(0)).alias("k"), F.lit(1).cast("long").alias("size")).repartition(store.buckets, "id"), "id")
    total = heads.agg(F.coalesce(F.sum("k"), F.lit(0))).first()[0]
    ends = lambda side: heads.select(F.col("id").alias(side), F.col("k").alias(f"k{side}"))
    # A link is there in both directions, so its b learns a's degree by being the other one's a.
    links = by(unnamed.join(ends("a"), "a").select(F.col("b").alias("a"), F.col("a").alias("b"), "w", F.col("ka").alias("kb")).repartition(store.buckets, "a"), "a")
    store.release(unnamed)
    # Edges between two communities, times the degrees' sum, less the product of their degrees: the gain, but for a factor.
    all_ends = _whole(F.lit(total))
    gain = _whole("w") * all_ends - _whole("ka") * _whole("kb")
    first = [F.desc(F.col("w") / F.col("ka")), F.col("id")]
    out, number = [], 0
    while True:
        best = links.join(ends("a"), "a").withColumn("gain", gain).where("gain > 0").groupBy("a").agg(F.max(F.struct("gain", (-F.col("b")).alias("other"), "w", "ka", "kb")).alias("best"))
        asks = best.select(F.col("a").alias("id"), (-F.col("best.other")).alias("parent"), "best.w", "best.ka", "best.kb")
        # By degrees, so that a hub takes in its leaves at once, and in every other round by hashes, so that chains of growing degrees are short.
        rank = lambda c, k: F.struct((F.col(k) if number % 2 == 0 else F.lit(0)).alias("k"), F.xxhash64(c, F.lit(number)).alias("h"), F.col(c).alias("c"))
        asks = scratch.put(asks.where(rank("id", "ka") < rank("parent", "kb")))
        small = (count := asks.count()) <= SMALL_ROUND
        if not count:  # where any community would gain, one of them asks upwards: those that ask lead into a cycle
            break
        asked = asks.join(asks.select(F.col("id").alias("parent")), "parent", "left_anti")
        asked = _within(asked, "ka", first, "before", small)
        taken = asked.where(_whole("w") * all_ends > _whole("ka") * _whole(F.col("kb") + F.col("before")))
        sized = taken.join(heads.select("id", "size"), "id").join(heads.select(F.col("id").alias("parent"), F.col("size").alias("had")), "parent")
        gone = _within(sized, "size", first, "ahead", small)
        gone = durable(gone.select("id", "parent", F.lit(number).alias("round"), (F.col("had") + F.col("ahead")).alias("at")))
        out.append(gone)
        number += 1
        into = heads.join(gone.select("id", "parent"), "id", "left").select("id", F.coalesce("parent", "id").alias("to"), "k", "size")
        fewer = by(into.groupBy(F.col("to").alias("id")).agg(F.sum("k").alias("k"), F.sum("size").alias("size")).repartition(store.buckets, "id"), "id")
        moved = scratch.put(into.select("id", "to").join(fewer.select(F.col("id").alias("to"), F.col("k").alias("now")), "to"))
        named = lambda side: moved.select(F.col("id").alias(side), F.col("to").alias(f"to_{side}"), F.col("now").alias(f"k{side}"))
        joined = links.select("a", "b", "w").join(named("a"), "a").join(named("b"), "b").where("to_a != to_b")
        turned = joined.select(F.col("to_b").alias("a"), F.col("to_a").alias("b"), "w", F.col("ka").alias("kb"))
        closer = by(turned.repartition(store.buckets, "a").groupBy("a", "b").agg(F.sum("w").alias("w"), F.first("kb").alias("kb")), "a")
        scratch.release(asks, moved)
        store.release(heads, links)
        heads, links = fewer, closer
    store.release_all_but()
    scratch.close()
    none = nodes.sparkSession.createDataFrame([], "id long, parent long, round int, at long")
    return reduce(DataFrame.unionByName, out, none)


def community_order(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(id, community, pos): nodes by the depth-first order of the merges, so that each community, and each that went into it, has positions in a row.

    community is the id of its first node. Larger communities come first, then smaller ids. Nodes without edges are communities of their own. A null id is left out, repeated ones count once.
    """
    nodes = nodes.select("id").where("id IS NOT NULL").distinct()
    scratch = Scratch(edges.sparkSession)
    made = scratch.put(merges(edges.where("src IS NOT NULL AND dst IS NOT NULL"), nodes))
    # A node's place in its community is the sum of the places along its merges; each round of joins doubles how many of them are summed, and no path is longer than the rounds.
    place = scratch.put(nodes.join(made, "id", "left").select("id", F.coalesce("parent", "id").alias("top"), F.coalesce("at", F.lit(0)).alias("within")))
    for _ in range((made.agg(F.coalesce(F.max("round") + 1, F.lit(0))).first()[0]).bit_length()):
        above = place.select(F.col("id").alias("top"), F.col("top").alias("next"), F.col("within").alias("further"))
        place = scratch.put(place.join(above, "top").select("id", F.col("next").alias("top"), (F.col("within") + F.col("further")).alias("within")))
    sizes = place.groupBy(F.col("top").alias("community")).agg(F.count(F.lit(1)).alias("size"))
    starts = with_running_sum(sizes, "size", [F.desc("size"), "community"], "upto").select("community", (F.col("upto") - F.col("size")).alias("start"))
    out = durable(place.withColumnRenamed("top", "community").join(starts, "community").select("id", "community", (F.col("start") + F.col("within")).alias("pos")))
    scratch.close()
    return out


def modularity(edges: DataFrame, communities: DataFrame) -> DataFrame:
    """One row: modularity, the share of edges inside a community less what random ends of the same degrees would give. communities: (id, community). Null without edges."""
    links = _links(edges)
    of = lambda side: communities.select(F.col("id").alias(side), F.col("community").alias(f"of_{side}"))
    named = links.join(of("a"), "a").join(of("b"), "b")
    by = named.groupBy(F.col("of_a").alias("community")).agg(F.sum(F.when(F.col("of_a") == F.col("of_b"), F.col("w")).otherwise(0)).alias("inside"), F.sum("w").alias("k"))
    total = F.sum("k").cast("double")
    return by.agg((F.sum("inside") / total - F.sum(F.col("k").cast("double") * F.col("k")) / (total * total)).alias("modularity"))
