"""Positions and running sums over a global order, without bringing all rows to one task.

Rows are range-partitioned by the order; each partition numbers or sums its own rows, and the
partitions' totals, one row each, give the offsets.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .durable import StageStore, durable


def _ranged(df: DataFrame, order: list[str | Column]) -> DataFrame:
    # Durable: the ranges must not move between the two uses, even if an executor is lost.
    return durable(df.repartitionByRange(*order).withColumn("_part", F.spark_partition_id()))


def _offsets(totals: DataFrame, value: str) -> DataFrame:
    """One row for each partition, so a window over all of them is small."""
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    return totals.select("_part", F.coalesce(F.sum(value).over(before), F.lit(0)).alias("_before"))


def with_position(df: DataFrame, order: list[str | Column], name: str = "pos") -> DataFrame:
    """df with a 0-based long position by order, which must be total."""
    rows = _ranged(df, order)
    offsets = _offsets(rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n")), "_n")
    own = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_own") + F.col("_before")).cast("long")).drop("_part", "_own", "_before")


def with_running_sum(df: DataFrame, value: str, order: list[str | Column], name: str) -> DataFrame:
    """df with the sum of value up to and including each row by order, which must be total."""
    rows = _ranged(df, order)
    offsets = _offsets(rows.groupBy("_part").agg(F.sum(value).alias("_n")), "_n")
    own = F.sum(value).over(Window.partitionBy("_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0))
    return rows.withColumn("_own", own).join(F.broadcast(offsets), "_part").withColumn(name, F.col("_own") + F.col("_before")).drop("_part", "_own", "_before")


def by_id(nodes: DataFrame) -> DataFrame:
    return with_position(nodes.select("id"), ["id"])


def by_hash(nodes: DataFrame, seed: int = 0) -> DataFrame:
    """(id, pos) in the order of a hash: a repeatable random permutation."""
    key = F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("id").cast("string")))
    return with_position(nodes.select("id", key.alias("_key")), ["_key", "id"]).select("id", "pos")


def by_in_degree(degrees: DataFrame) -> DataFrame:
    """(id, degree, pos) by degree, then id."""
    return with_position(degrees.select("id", "degree"), ["degree", "id"])


def _roots(both: DataFrame, ranked: DataFrame) -> DataFrame:
    """ranked (id, own) and root: the least own of the nodes that each reaches. both lies by src.

    In each round nodes take the least of their neighbours' roots and of that root's own: distances double. Only roots that are new are offered.
    """
    state = fresh = durable(ranked.select("id", "own", F.col("own").alias("root")))
    while True:
        # Few nodes of a bucket are met by many edges, so edges are neither sent nor sorted.
        offered = both.join(fresh.select(F.col("id").alias("src"), "root").hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("root").alias("offer"))
        least = state.join(offered, "id", "left").select("id", "own", F.col("root").alias("was"), F.least("root", "offer").alias("via"))
        further = state.select(F.col("own").alias("via"), F.col("root").alias("next"))
        state = durable(least.join(further, "via").select("id", "own", "was", F.least("via", "next").alias("root")))
        fresh = state.where("root < was")
        if fresh.isEmpty():
            return state.drop("was")


#: Levels of up to so many nodes are numbered in one task.
SMALL_LEVEL = 100_000


def _ranked(rows: DataFrame, by: list[str]) -> tuple[DataFrame, int]:
    """(rows with rank from 0 by these columns, their number)."""
    rows = durable(rows)
    n = rows.count()
    if n <= SMALL_LEVEL:
        return rows.withColumn("rank", (F.row_number().over(Window.orderBy(*by)) - 1).cast("long")), n
    return durable(with_position(rows, by, "rank")), n


def cuthill_mckee(edges: DataFrame, nodes: DataFrame, reverse: bool = True) -> DataFrame:
    """(id, level, pos): the Cuthill-McKee order, reversed on request.

    Components go by their root, the node of least degree, then id. From a root nodes are taken in breadth-first order; the neighbours of a node that aren't taken
    yet follow by degree and id. So within a level nodes go by the first of their neighbours in the level before, then by
    degree and id; each level is one round over its own edges only. Repeated edges, loops and directions don't count.
    """
    store = StageStore(edges.sparkSession)
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst")
    both = store.put(both.repartition(store.buckets, "src").distinct(), "edges", "src")  # all rounds find them by src
    degree = nodes.select("id").join(both.groupBy(F.col("src").alias("id")).count(), "id", "left").select("id", F.coalesce("count", F.lit(0)).alias("degree"))
    kept = ["id", "own", "root"]
    known = _roots(both, with_position(degree, ["degree", "id"], "own")).select(*kept)
    before = known.limit(0).select("id")
    level, size = _ranked(known.where("root = own"), ["root"])
    levels, n = [], 0
    while size:
        levels.append(level.select("id", "root", F.lit(n).alias("level"), "rank"))
        # Neighbours of a level are in it, in the one before or in the next one.
        reached = both.join(level.select(F.col("id").alias("src"), F.col("rank").alias("parent")).hint("shuffle_hash"), "src").groupBy(F.col("dst").alias("id")).agg(F.min("parent").alias("parent"))
        fresh = reached.join(level.select("id").unionByName(before), "id", "left_anti").join(known, "id")
        before, n = level.select("id"), n + 1
        level, size = _ranked(fresh.select(*kept, "parent"), ["parent", "own"])
    out = known.limit(0).select("id", "root", F.lit(0).alias("level"), F.lit(0).cast("long").alias("rank"))
    while levels:  # joined in pairs, so that the plan stays flat
        out = out.unionByName(levels.pop())
        if len(levels) % 50 == 49:
            out = durable(out)
    by = ["root", "level", "rank"]
    placed = with_position(out, [F.desc(c) for c in by] if reverse else by).select("id", "level", "pos")
    store.release(both)
    return placed


def balanced_parts(edges: DataFrame, nodes: DataFrame, parts: int, slack: float = 0.1, rounds: int = 10) -> DataFrame:
    """(id, part): a partition of nodes into parts of at most ceil((1 + slack) * n / parts) nodes each that cuts few edges, by label propagation under a size bound.

    Nodes start in equal ranges of their ids' hashes. In a round each node asks for the part that most of its neighbours are in, if that is more than are in its own (ties
    to the smallest part). Of those that ask for a part, the ones with the greatest gain, then least hash and id, are let in, as many as the part has room for at the
    start of the round, so the bound always holds. Only every other node asks in a round, by a hash, lest neighbours swap for ever. Repeated edges count as often as they stand; directions
    and loops don't. Rounds end early when nobody moves in two of them.
    """
    n = nodes.count()
    most = -(-int((1 + slack) * n) // parts) if n else 0
    both = durable(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src != dst").groupBy("src", "dst").agg(F.count(F.lit(1)).alias("w")))
    state = durable(by_hash(nodes).select("id", F.floor(F.col("pos") * parts / max(n, 1)).cast("int").alias("part")))
    still = 0
    for k in range(rounds):
        weight = both.join(state.select(F.col("id").alias("dst"), "part"), "dst").groupBy(F.col("src").alias("id"), "part").agg(F.sum("w").alias("w"))
        own = weight.join(state, ["id", "part"]).select("id", F.col("w").alias("own"))
        best = weight.groupBy("id").agg(F.max(F.struct("w", (-F.col("part")).alias("part"))).alias("best")).select("id", F.col("best.w").alias("w"), (-F.col("best.part")).alias("to"))
        asks = best.join(own, "id", "left").withColumn("gain", F.col("w") - F.coalesce("own", F.lit(0))).where((F.col("gain") > 0) & (F.pmod(F.xxhash64("id", F.lit(k // 2)), F.lit(2)) == F.lit(k % 2)))
        room = {r.part: most - r.c for r in state.groupBy("part").agg(F.count(F.lit(1)).alias("c")).collect()}  # parts rows
        free = F.create_map(*[F.lit(x) for p in range(parts) for x in (p, room.get(p, most))])
        ranked = with_position(asks.select("id", "to", "gain", F.xxhash64("id").alias("h")), ["to", F.desc("gain"), "h", "id"], "at")
        first = {r.to: r.at for r in ranked.groupBy("to").agg(F.min("at").alias("at")).collect()}  # parts rows
        if not first:
            still += 1
            if still == 2:
                break
            continue
        start = F.create_map(*[F.lit(x) for p, at in first.items() for x in (p, at)])
        moved = ranked.where(F.col("at") - start[F.col("to")] < free[F.col("to")]).select("id", "to")
        after = durable(state.join(moved, "id", "left").select("id", F.coalesce("to", "part").alias("part")))
        still = still + 1 if moved.isEmpty() else 0
        state = after
        if still == 2:
            break
    return state


def edge_cut(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """One row: cut (edges between parts, loops left out) and edges."""
    ends = edges.where("src != dst").join(parts.select(F.col("id").alias("src"), F.col("part").alias("p")), "src").join(parts.select(F.col("id").alias("dst"), F.col("part").alias("q")), "dst")
    return ends.agg(F.count(F.when(F.col("p") != F.col("q"), 1)).alias("cut"), F.count(F.lit(1)).alias("edges"))
