"""Helpers that the operators share: durable intermediate tables and table reading."""

from __future__ import annotations

import pickle
import tempfile
import uuid

from pyspark import cloudpickle
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where it is unset, a temporary one in local mode, in which all run on one machine; else an error."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getCheckpointDir()
    if not folder:
        if not (sc.master or "").split("[")[0] == "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="lamina-checkpoint-")
        sc.setCheckpointDir(folder)
    return folder.rstrip("/")


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write df as a table in the shared folder and read it back: the lineage ends there, and a lost executor loses nothing."""
    spark = df.sparkSession
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stored_at = path
    return out


def removed(spark: SparkSession, path: str) -> None:
    """Delete a folder in the store that path names."""
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark._jsc.hadoopConfiguration()).delete(where, True)


def released(*tables: DataFrame) -> None:
    """Delete tables of stored() that no DataFrame in use reads any more."""
    for df in tables:
        removed(df.sparkSession, df.stored_at)


def by_position(df: DataFrame, drop: list[str]) -> tuple[DataFrame, list[str]]:
    """(df without the columns in drop, its columns named c0, c1 and so on; their old names): no name clashes with an operator's own, whatever it holds."""
    own = [(f"c{i}", c) for i, c in enumerate(df.columns) if c not in drop]
    return df.toDF(*[f"c{i}" for i in range(len(df.columns))]).select(*[c for c, _ in own]), [c for _, c in own]


def by_value(spark: SparkSession, value):
    """A broadcast of a value whose class executors needn't have; received() gives it back."""
    return spark.sparkContext.broadcast(cloudpickle.dumps(value))


def received(sent):
    return pickle.loads(sent.value)


def row_hash(text: Column) -> Column:
    """Tells rows that share a doc_id apart; null and empty text differ."""
    return F.xxhash64(F.coalesce(text, F.lit("\u0000null")), F.lit(7))


def shuffle_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def pieces(data: bytes, most: int, size: int = 512) -> bytes:
    """data, or where it is longer than most bytes, evenly spaced pieces of it that make up so many: what a fit takes of one row."""
    if len(data) <= most:
        return data
    n = most // size
    return b"".join(data[(at := i * (len(data) - size) // max(1, n - 1)) : at + size] for i in range(n))
