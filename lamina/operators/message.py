"""Message passing: edges joined with node vectors, then aggregated for each destination.

Reductions are wide aggregates, one for each entry of the vector, so Spark combines them before the
shuffle and a hub's edges never meet in one task. Where many nodes share a vector (Coded), edges are
dealt by destination with the vector's code, and get the vector itself where they are reduced.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import vectors as V
from .durable import durable, n_cells

_BINARY = {
    "add": lambda a, b: V.zipped(a, b, lambda x, y: x + y),
    "sub": lambda a, b: V.zipped(a, b, lambda x, y: x - y),
    "mul": lambda a, b: V.zipped(a, b, lambda x, y: x * y),
    "div": lambda a, b: V.zipped(a, b, lambda x, y: x / y),
    "dot": lambda a, b: F.array(V.dot(a, b)),
}
_REDUCE = {"sum": F.sum, "mean": F.avg, "max": F.max, "min": F.min}


@dataclass
class Coded:
    """Nodes whose vectors are rows of a smaller table: ids (id, code, and by, a factor, if there is one) and vectors (code, x). many: there are too many vectors to send all to each task."""

    ids: DataFrame
    vectors: DataFrame
    many: bool = False

    def mapped(self, f: Callable[[Column], Column]) -> Coded:
        return Coded(self.ids, self.vectors.select("code", f(F.col("x")).alias("x")), self.many)


#: The in-edges of a node are dealt to a task for each so many of them.
HUB = 1 << 20


def _marked(edges: DataFrame, rows: DataFrame, hub: int = HUB) -> DataFrame:
    """rows (edges with more columns) with _deal, which tells a hub's in-edges apart by their sources."""
    # One row at most for each HUB edges.
    hubs = edges.groupBy("dst").agg(F.count(F.lit(1)).alias("_n")).where(F.col("_n") > hub)
    spread = rows.join(F.broadcast(hubs), "dst", "left").withColumn("_deal", F.when(F.col("_n").isNotNull(), F.pmod(F.xxhash64("src"), F.ceil(F.col("_n") / hub))))
    return spread.drop("_n")


def _dealt(edges: DataFrame, rows: DataFrame, hub: int = HUB) -> DataFrame:
    """rows (edges with more columns) by destination, those of a hub by its sources as well."""
    return _marked(edges, rows, hub).repartition("dst", "_deal").drop("_deal")


def _met_in_cells(edges: DataFrame, rows: DataFrame, nodes: Coded, sides: Sequence[str]) -> DataFrame:
    """rows (edges with codes _u, _v) with columns u, v: edges lie in cells by destination, and a vector is sent once to each cell that has its code."""
    cells = n_cells(edges.sparkSession)
    marked = _marked(edges, rows).withColumn("_cell", F.pmod(F.xxhash64("dst", F.coalesce("_deal", F.lit(-1).cast("long"))), F.lit(cells))).drop("_deal")
    out = marked.repartition(cells, "_cell")
    for side in sides:
        code = f"_{side}"
        at = marked.select("_cell", F.col(code).alias("code")).distinct().join(nodes.vectors, "code").repartition(cells, "_cell")
        # The names come after the shuffle: two bare shuffles into few parts would both be done again, into as many as are set.
        out = out.join(at.select("_cell", F.col("code").alias(code), F.col("x").alias(side)), ["_cell", code]).drop(code)
    return out.drop("_cell")


def gathered(edges: DataFrame, nodes: DataFrame | Coded, *sides: str, value: str = "x") -> DataFrame:
    """edges plus u (the source's vector) and/or v (the destination's), by sides. Other columns of edges stay."""
    out = edges
    ends = {"u": "src", "v": "dst"}
    if isinstance(nodes, Coded):
        by = "by" in nodes.ids.columns
        for side in sides:
            out = out.join(nodes.ids.select(F.col("id").alias(ends[side]), F.col("code").alias(f"_{side}"), *([F.col("by").alias(f"_by_{side}")] if by else [])), ends[side])
        if nodes.many:
            out = _met_in_cells(edges, out, nodes, sides)
            for side in sides if by else ():
                out = out.withColumn(side, V.scaled(side, F.col(f"_by_{side}"))).drop(f"_by_{side}")
            return out
        out = _dealt(edges, out)
        for side in sides:
            x = V.scaled("x", F.col(f"_by_{side}")) if by else F.col("x")
            out = out.join(nodes.vectors.withColumnRenamed("code", f"_{side}"), f"_{side}").withColumn(side, x).drop("x", f"_{side}", f"_by_{side}")
        return out
    for side in sides:
        key = ends[side]
        out = out.join(nodes.select(F.col("id").alias(key), F.col(value).alias(side)), key)
    return out


def message(op: str) -> Column:
    """copy_u, copy_e, or <u|v|e>_<add|sub|mul|div|dot>_<u|v|e> over columns u, v and e."""
    if op.startswith("copy_"):
        return F.col(op[5:])
    left, kind, right = op.split("_")
    return _BINARY[kind](left, right)


def reduced(messages: DataFrame, how: str, width: int, value: str = "m", key: str = "dst") -> DataFrame:
    """(id, x): the reduction of value, of so many entries, for each key."""
    f = _REDUCE[how]
    cols = messages.groupBy(F.col(key).alias("id")).agg(*[f(F.col(value)[i]).alias(f"_{i}") for i in range(width)])
    return cols.select("id", F.array(*[F.col(f"_{i}") for i in range(width)]).alias("x"))


def update_all(edges: DataFrame, nodes: DataFrame | Coded, op: str, how: str, width: int, e: Column | None = None) -> DataFrame:
    """(id, x): messages by op reduced by how. Destinations without an edge have no row; fill_missing() gives them zeros. Edge vectors are in column e of edges, or e makes them of the edges' columns where they are reduced."""
    sides = [s for s in ("u", "v") if s in op.removeprefix("copy_").split("_")]
    out = 1 if "_dot_" in op else width
    met = gathered(edges, nodes, *sides)
    return reduced((met if e is None else met.withColumn("e", e)).select("dst", message(op).alias("m")), how, out)


def refuse_zero_in_degree(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """nodes, if each has an in-edge; else an error that names some that have none."""
    without = nodes.select("id").join(edges.select(F.col("dst").alias("id")), "id", "left_anti").orderBy("id").limit(5).collect()
    if without:
        raise ValueError(f"nodes without in-edges, as {[r.id for r in without]}: their sums would be zeros")
    return nodes


def fill_missing(result: DataFrame, nodes: DataFrame | Coded, width: int) -> DataFrame:
    """One row for each node: its vector, or zeros."""
    nodes = nodes.ids if isinstance(nodes, Coded) else nodes
    return nodes.select("id").join(result, "id", "left").select("id", F.coalesce("x", V.zeros(width)).alias("x"))


def edge_softmax(scores: DataFrame, heads: int = 1, key: str = "dst", keep: Callable[[DataFrame], DataFrame] = durable) -> DataFrame:
    """scores (key, s array of heads numbers, ...) plus a, the softmax over the edges of each key and head.

    Two small aggregates are joined back, instead of a window, so that a hub's edges may be split over tasks. scores is
    read three times, so it is made durable by keep; leave vectors out of it and join them afterwards.
    """
    scores = keep(scores)
    each = range(heads)
    top = scores.groupBy(key).agg(*[F.max(F.col("s")[h]).alias(f"_t{h}") for h in each])
    sums = scores.join(top, key).groupBy(key).agg(*[F.max(f"_t{h}").alias(f"_t{h}") for h in each], *[F.sum(F.exp(F.col("s")[h] - F.col(f"_t{h}"))).alias(f"_s{h}") for h in each])
    a = F.array(*[F.exp(F.col("s")[h] - F.col(f"_t{h}")) / F.col(f"_s{h}") for h in each])
    return scores.join(sums, key).withColumn("a", a).drop(*[f"_{c}{h}" for c in "ts" for h in each])


def degrees(edges: DataFrame, end: str) -> DataFrame:
    """(id, _d): how many edges have each node at that end (src or dst); nodes without one have no row."""
    return edges.groupBy(F.col(end).alias("id")).agg(F.count(F.lit(1)).alias("_d"))


def degree_scaled(nodes: DataFrame | Coded, degree: DataFrame, power: float) -> DataFrame | Coded:
    """Node vectors times max(degree, 1) ** power; degree as of degrees(), of the whole graph's edges."""
    by = F.pow(F.greatest(F.coalesce("_d", F.lit(1)), F.lit(1)).cast("double"), F.lit(power))
    if isinstance(nodes, Coded):
        return Coded(nodes.ids.join(degree, "id", "left").select("id", "code", by.alias("by")), nodes.vectors, nodes.many)
    return nodes.join(degree, "id", "left").withColumn("x", V.scaled("x", by)).drop("_d")


def graph_conv(edges: DataFrame, nodes: DataFrame | Coded, width: int, norm: str = "both", degree: Callable[[str], DataFrame] | None = None) -> DataFrame:
    """(id, x): normalised sums over in-edges. norm: both (1 / sqrt(dout din)), right (1 / din) or none. Nodes without in-edges get zeros. degree(end) gives degrees() that are at hand."""
    degree = degree or (lambda end: degrees(edges, end))
    start = nodes if isinstance(nodes, Coded) else nodes.select("id", "x")
    if norm == "both":
        start = degree_scaled(start, degree("src"), -0.5)
    summed = fill_missing(update_all(edges, start, "copy_u", "sum", width), nodes, width)
    return summed if norm == "none" else degree_scaled(summed, degree("dst"), -0.5 if norm == "both" else -1.0)


def cross_reduced(parts: list[DataFrame], how: str, width: int) -> DataFrame:
    """(id, x) tables of several relations into one node type, each with a row for every node, reduced over the relations.

    how may also be stack: the vectors side by side, in the order of parts.
    """
    if how == "stack":
        out = parts[0]
        for part in parts[1:]:
            out = out.join(part.select("id", F.col("x").alias("_y")), "id").select("id", F.concat("x", "_y").alias("x"))
        return out
    rows = parts[0]
    for part in parts[1:]:
        rows = rows.unionByName(part)
    return reduced(rows.select(F.col("id").alias("dst"), F.col("x").alias("m")), how, width)
