"""Batches of an ordered node list by node count, edge count or both."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .durable import durable
from .order import with_position, with_running_sum


def by_count(order: DataFrame, size: int) -> DataFrame:
    """(id, pos) with batch = pos div size."""
    return order.withColumn("batch", F.floor(F.col("pos") / size).cast("long"))


def pack(degrees: np.ndarray, max_nodes: int, max_edges: int) -> np.ndarray:
    """Batch of each node in order: the longest run of at most max_nodes nodes with fewer than max_edges edges, but one node at least."""
    prefix = np.concatenate([[0], np.cumsum(degrees)])
    out, start, batch = np.empty(len(degrees), np.int64), 0, 0
    while start < len(degrees):
        end = int(np.searchsorted(prefix, prefix[start] + max_edges, side="left")) - 1
        end = min(max(end, start + 1), start + max_nodes, len(degrees))
        out[start:end] = batch
        start, batch = end, batch + 1
    return out


#: Positions of a section, which is packed in one task: no bound of the result, which is the same for any.
SECTION = 1 << 20


def _section_jumps(degrees: np.ndarray, own: int, max_nodes: int, max_edges: int) -> tuple[np.ndarray, np.ndarray]:
    """(offset of the first batch start beyond the section, batches started) for a batch that starts at each of its first max_nodes offsets.

    degrees has the section's own nodes and the max_nodes that follow it, or as many as there are.
    """
    prefix, at = np.concatenate([[0], np.cumsum(degrees)]), np.arange(own)
    to = np.searchsorted(prefix, prefix[:own] + max_edges, side="left") - 1
    to = np.minimum(np.maximum(to, at + 1), np.minimum(at + max_nodes, len(degrees)))
    n = np.ones(own, np.int64)
    while len(inside := np.flatnonzero(to < own)):  # each step twice as long as the one before
        via = to[inside]
        n[inside], to[inside] = n[inside] + n[via], to[via]
    return to[:max_nodes], n[:max_nodes]


def by_budget(order: DataFrame, max_nodes: int, max_edges: int, section: int = SECTION) -> DataFrame:
    """(id, pos, degree) with batch: greedy packing, as pack() would do it over the whole order. pos counts from 0 without gaps.

    The order is cut into sections. For each start that the section before may leave, a section tells where the next one is
    entered; these steps are then joined to themselves, twice as long in each round, so that every section learns its first
    start and its number after log2(sections) rounds. A task holds a section and max_nodes rows more.
    """
    section = max(section, max_nodes)
    rows = durable(order.select("id", "pos", "degree"))
    own = F.floor(F.col("pos") / section).cast("long")
    last = rows.agg(F.max("pos")).first()[0]
    entries = rows.sparkSession.range(1).select(F.lit(0).cast("long").alias("at"), F.lit(0).cast("long").alias("batch"))
    sections = 0 if last is None else last // section + 1  # a last one without a start is entered just behind its end
    if sections > 1:
        also = F.when((F.col("pos") % section < max_nodes) & (own > 0), F.array(own - 1, own)).otherwise(F.array(own))

        def jumps(part: pd.DataFrame) -> pd.DataFrame:
            part = part.sort_values("pos")
            base = int(part["section"].iloc[0]) * section
            to, n = _section_jumps(part["degree"].to_numpy(), int((part["pos"] < base + section).sum()), max_nodes, max_edges)
            return pd.DataFrame({"at": base + np.arange(len(to)), "to": base + to, "n": n})

        step = durable(rows.select("pos", "degree", F.explode(also).alias("section")).groupBy("section").applyInPandas(jumps, "at long, to long, n long").where(F.col("at") < (sections - 1) * section))
        for done in range((sections - 1).bit_length()):
            entries = durable(entries.unionByName(entries.join(step, "at").select(F.col("to").alias("at"), (F.col("batch") + F.col("n")).alias("batch"))))
            if 2 << done < sections:
                further = step.select(F.col("at").alias("to"), F.col("to").alias("_to"), F.col("n").alias("_n"))
                step = durable(step.join(further, "to").select("at", F.col("_to").alias("to"), (F.col("n") + F.col("_n")).alias("n")))

    def run(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values("pos")
        first, before = part["batch"].iloc[0], part["pos"].to_numpy() < part["at"].iloc[0]  # those before belong to the last section's last batch
        batch = np.concatenate([np.full(before.sum(), first - 1), first + pack(part["degree"].to_numpy()[~before], max_nodes, max_edges)])
        return part.assign(batch=batch)[["id", "pos", "degree", "batch"]]

    found = entries.withColumn("section", F.floor(F.col("at") / section).cast("long"))
    return rows.withColumn("section", own).join(found, "section").groupBy("section").applyInPandas(run, "id long, pos long, degree long, batch long")


def by_budget_bins(order: DataFrame, max_edges: int) -> DataFrame:
    """(id, pos, degree) with batch = edges before the node div max_edges: parallel, and over the budget by one node's degree at most."""
    summed = with_running_sum(order, "degree", ["pos"], "_end")
    return summed.withColumn("batch", F.floor((F.col("_end") - F.col("degree")) / max_edges).cast("long")).drop("_end")


def by_type(nodes: DataFrame, size: int) -> DataFrame:
    """nodes (ntype, id, ...) with batch: runs of size of the nodes of one type by id, numbered from 0 in each type. (ntype, id) must be distinct."""
    placed = with_position(nodes, ["ntype", "id"], "_pos")
    first = placed.groupBy("ntype").agg(F.min("_pos").alias("_first"))
    return placed.join(first, "ntype").withColumn("batch", F.floor((F.col("_pos") - F.col("_first")) / size).cast("long")).select(*nodes.columns, "batch")


def next_budget(current: int, free: float, peak: float, margin: float = 0.9) -> int:
    """The budget that would use margin of the free memory, if need is in proportion to it."""
    return max(1, int(current * free * margin / peak))


def halved(current: int) -> int:
    return max(1, current // 2)


def statistics(edges: DataFrame, batched: DataFrame) -> DataFrame:
    """batch, input nodes, output nodes and edges of each batch (id, batch)."""
    out = batched.groupBy("batch").agg(F.count(F.lit(1)).alias("n_out"))
    joined = edges.join(batched.select(F.col("id").alias("dst"), "batch"), "dst")
    n_edges = joined.groupBy("batch").agg(F.count(F.lit(1)).alias("n_edges"))
    inputs = joined.select("batch", F.col("src").alias("id")).unionByName(batched.select("batch", "id")).distinct().groupBy("batch").agg(F.count(F.lit(1)).alias("n_in"))
    return out.join(n_edges, "batch", "left").join(inputs, "batch").select("batch", "n_in", "n_out", F.coalesce("n_edges", F.lit(0)).alias("n_edges"))


def packed_iter(degrees: Iterator[int], max_nodes: int, max_edges: int) -> Iterator[int]:
    """pack() over a stream of degrees, for callers that hold no array."""
    nodes = edges = batch = 0
    for d in degrees:
        if nodes and (nodes >= max_nodes or edges + d >= max_edges):
            nodes, edges, batch = 0, 0, batch + 1
        nodes, edges = nodes + 1, edges + d
        yield batch
