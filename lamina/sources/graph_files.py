"""Edge lists as text, graphs as Parquet, and permutations."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.durable import read_bucketed, write_bucketed
from ..operators.order import with_position


def _lines(spark: SparkSession, path: str) -> DataFrame:
    """(value, and _file, _block, _row, which together give the order of lines: file name, then offset within it)."""
    # Spark deals files to tasks by size; within a block of a file, rows keep their order.
    meta = F.col("_metadata")
    return spark.read.text(path).select("value", meta["file_path"].alias("_file"), meta["file_block_start"].alias("_block"), F.monotonically_increasing_id().alias("_row"))


_LINE_ORDER = ["_file", "_block", "_row"]


def read_edge_text(spark: SparkSession, path: str) -> DataFrame:
    """(line, src, dst) of a whitespace-separated edge list; lines whose first token is '#' and blank lines are skipped.

    line counts the edges from 0 in the order of file names, then of lines.
    """
    text = _lines(spark, path).withColumn("t", F.split(F.trim("value"), r"\s+"))
    rows = text.where((F.col("t")[0] != "#") & (F.size("t") >= 2)).select(*_LINE_ORDER, F.col("t")[0].cast("long").alias("src"), F.col("t")[1].cast("long").alias("dst"))
    return with_position(rows, _LINE_ORDER, "line").select("line", "src", "dst")


def densify(edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(edges with dense ids, mapping (raw, id)) of (line, src, dst): ids count from 0 in the order of first sight, src before dst on a line."""
    seen = edges.select(F.col("src").alias("raw"), (F.col("line") * 2).alias("at")).unionByName(edges.select(F.col("dst").alias("raw"), (F.col("line") * 2 + 1).alias("at")))
    mapping = with_position(seen.groupBy("raw").agg(F.min("at").alias("at")), ["at"]).select("raw", F.col("pos").alias("id"))
    src, dst = (mapping.select(F.col("raw").alias(k), F.col("id").alias(f"{k}_id")) for k in ("src", "dst"))
    dense = edges.join(src, "src").join(dst, "dst").select("line", F.col("src_id").alias("src"), F.col("dst_id").alias("dst"))
    return dense, mapping


def write_edge_text(edges: DataFrame, path: str) -> None:
    """'src dst' lines."""
    edges.select(F.concat_ws(" ", "src", "dst").alias("value")).write.text(path)


def write_graph(edges: DataFrame, path: str, partitions: int | None = None) -> None:
    """Parquet clustered by dst: a scan of some destinations skips the row groups of the others."""
    n = partitions or int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    edges.repartitionByRange(n, "dst").sortWithinPartitions("dst", "src").write.parquet(path)


def read_graph(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def read_permutation(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of text with one id a line, in the order of file names, then of lines."""
    lines = _lines(spark, path).withColumn("id", F.trim("value").cast("long")).where("id IS NOT NULL")
    return with_position(lines, _LINE_ORDER).select("pos", "id")


def write_permutation(order: DataFrame, path: str) -> None:
    """The ids of (id, pos) by position, one a line: files are named in the order of positions."""
    order.repartitionByRange("pos").sortWithinPartitions("pos").select(F.col("id").cast("string").alias("value")).write.text(path)


def write_csc(index: DataFrame, adjacency: DataFrame, path: str) -> None:
    """Compressed columns of graph.csc(): index (id, first, degree) and adjacency (pos, dst, src), each in the order of its rows."""
    index.repartitionByRange("id").sortWithinPartitions("id").write.parquet(f"{path}/index")
    adjacency.repartitionByRange("pos").sortWithinPartitions("pos").write.parquet(f"{path}/adjacency")


def read_csc(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(index, adjacency) of write_csc(). The first column must start at 0."""
    index = spark.read.parquet(f"{path}/index")
    least = index.agg(F.min("first")).first()[0]
    if least:
        raise ValueError(f"the first edge has number {least}, not 0")
    return index, spark.read.parquet(f"{path}/adjacency")


def write_bucketed_graph(edges: DataFrame, nodes: DataFrame, path: str, buckets: int) -> None:
    """Edges (src, dst, ...) once in buckets of src and once in buckets of dst, and nodes (id, ...) in buckets of id: layers over them exchange neither edges nor node rows.

    The number of buckets is kept beside them. It should let a bucket of edges fit a task's memory several times over.
    """
    for name, df, key in (("by_src", edges, "src"), ("by_dst", edges, "dst"), ("nodes", nodes, "id")):
        write_bucketed(df.repartition(buckets, key), f"{path}/{name}", key, buckets)
    edges.sparkSession.range(1).select(F.lit(buckets).alias("buckets")).write.json(f"{path}/layout")


def read_bucketed_graph(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges by src, edges by dst, nodes) of write_bucketed_graph(), from any session."""
    buckets = int(spark.read.json(f"{path}/layout").first().buckets)
    return tuple(read_bucketed(spark, f"{path}/{name}", key, buckets) for name, key in (("by_src", "src"), ("by_dst", "dst"), ("nodes", "id")))
