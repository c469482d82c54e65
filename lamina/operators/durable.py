"""Tables that outlive the executors that made them."""

from __future__ import annotations

import json
import tempfile
import time
import uuid
from collections.abc import Mapping, Sequence
from concurrent.futures import ThreadPoolExecutor

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder named by spark.checkpoint.dir. Where that is unset, a temporary one in local mode, in which all run on one machine; else it is an error."""
    sc = spark.sparkContext
    if not sc.getCheckpointDir():
        folder = spark.conf.get("spark.checkpoint.dir", None)
        if not folder and (sc.master or "").split("[")[0] != "local":
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        sc.setCheckpointDir(folder or tempfile.mkdtemp(prefix="lamina-"))
    return sc.getCheckpointDir()


def durable(df: DataFrame) -> DataFrame:
    """df, computed once and read from the shared folder from then on.

    With spark.cleaner.referenceTracking.cleanCheckpoints Spark deletes the files once nothing refers to the table any more.
    """
    shared_folder(df.sparkSession)
    return df.checkpoint()


#: Bytes of Parquet that one task of a shuffle is given.
SHARE = 16 << 20

#: Bytes in memory for one in a file, where rows are keys and a few values.
DENSE = 16.0


def n_cells(spark: SparkSession, parts: int | None = None) -> int:
    """Larger parts than those of a shuffle (parts, else what is set), in which edges lie with copies of the vectors that they read."""
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    return max(parts // 8, min(parts, spark.sparkContext.defaultParallelism))


def sized(spark: SparkSession, *paths: str) -> SparkSession:
    """A session like this one whose shuffles have a task for each SHARE bytes of the files there, so that a task's memory doesn't grow with them.

    Small inputs get as many tasks as there are cores, or the number set for spark, if that is less.
    """
    size = sum(fs.getContentSummary(where).getLength() for where, fs in (_at(spark, p) for p in paths) if fs.exists(where))
    few = min(int(spark.conf.get("spark.sql.shuffle.partitions")), max(spark.sparkContext.defaultParallelism, 2))
    out = spark.newSession()
    for k, v in spark.conf.getAll.items():
        if spark.conf.isModifiable(k):
            out.conf.set(k, v)
    out.conf.set("spark.sql.shuffle.partitions", max(few, -(-size // SHARE)))
    out.conf.set("spark.sql.requireAllClusterKeysForCoPartition", "false")  # what lies by cell is joined by cell and node there
    out.conf.set("spark.sql.sources.fileCompressionFactor", str(DENSE))  # else millions of rows go through the driver to be broadcast, as their file is small
    out.conf.set("spark.sql.maxConcurrentOutputFileWriters", "1")  # a cell is written as it comes, unsorted
    return out


class Scratch:
    """Parquet tables of an iteration in the shared folder. Plans that read them know nothing of the rounds before, and released ones are deleted."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder, self._tables = spark, f"{shared_folder(spark).rstrip('/')}/scratch-{uuid.uuid4().hex}", {}

    def put(self, df: DataFrame) -> DataFrame:
        path = f"{self.folder}/{uuid.uuid4().hex}"
        df.write.parquet(path)
        out = self.spark.read.schema(df.schema).parquet(path)
        self._tables[id(out)] = (out, path)
        return out

    def release(self, *tables: DataFrame) -> None:
        for df in tables:
            where, fs = _at(self.spark, self._tables.pop(id(df))[1])
            fs.delete(where, True)

    def close(self) -> None:
        """Delete all that is left."""
        where, fs = _at(self.spark, self.folder)
        fs.delete(where, True)


def write_bucketed(df: DataFrame, path: str, key: str, buckets: int, ordered: bool = True) -> DataFrame:
    """df as Parquet in that many buckets of key, sorted by it if ordered: joins with tables of the same buckets, and groupings by key, need no exchange."""
    name = f"lamina_{uuid.uuid4().hex}"
    writer = df.write.format("parquet").bucketBy(buckets, key)
    (writer.sortBy(key) if ordered else writer).option("path", path).saveAsTable(name)
    out = df.sparkSession.table(name)
    out.bucketed_as = name
    return out


def read_bucketed(spark: SparkSession, path: str, key: str, buckets: int, ordered: bool = True) -> DataFrame:
    """A table of write_bucketed(), in any session."""
    name = f"lamina_{uuid.uuid4().hex}"
    columns = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in spark.read.parquet(path).schema.fields)
    spark.sql(f"CREATE TABLE {name} ({columns}) USING parquet CLUSTERED BY ({key}) {f'SORTED BY ({key})' if ordered else ''} INTO {buckets} BUCKETS LOCATION '{path}'")
    out = spark.table(name)
    out.bucketed_as = name
    return out


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where, where.getFileSystem(spark._jsc.hadoopConfiguration())


class StageStore:
    """Columnar tables of a layer-wise run in the shared folder, bucketed by their key, with lifetimes and measures.

    put() writes one, release() deletes it. Tables with key cell have buckets of their own, fewer (cells). measures has a record of each: name, rows, bytes, seconds and what counters were asked for,
    observed while it was written.

    A store with a run's name keeps a manifest of its tagged tables and of marks: one opened later under the same name, in any session, has those of
    the run before, and put() of a tag that is there gives the table instead of making it. Folders of tables that were not finished are deleted.
    A name stands for one graph and one step graph; runs of other data need another.
    """

    def __init__(self, spark: SparkSession, buckets: int | None = None, counters: Mapping[str, Mapping[str, Column]] | None = None, run: str | None = None) -> None:
        """counters: for a table's name further aggregates over its columns, by counter name. run: the name that the store can be opened by again."""
        self.spark, self.counters = spark, dict(counters or {})
        self.buckets = buckets or int(spark.conf.get("spark.sql.shuffle.partitions"))
        self.cells = n_cells(spark, self.buckets)
        self.folder = f"{shared_folder(spark).rstrip('/')}/{f'run-{run}' if run else f'stages-{uuid.uuid4().hex}'}"
        self.measures: list[dict] = []
        self._tables: dict[int, tuple[DataFrame, str, str | None]] = {}
        self.resumable, self._entries, self._by_tag = run is not None, {}, {}
        where, fs = _at(spark, self.folder)
        if self.resumable and fs.exists(where):
            listed, _ = _at(spark, f"{self.folder}/manifest")
            if fs.exists(listed):
                self._entries = {e["tag"]: e for e in (json.loads(r.value) for r in spark.read.text(f"{self.folder}/manifest").collect())}
            named = {e["path"].rpartition("/")[2] for e in self._entries.values() if "path" in e} | {"manifest"}
            for x in fs.listStatus(where):
                if x.getPath().getName() not in named:
                    fs.delete(x.getPath(), True)

    def cell_names(self) -> list[int]:
        """A number for each of the cells' buckets, by which rows come to lie in it."""
        hashed = self.spark.range(64 * self.cells).groupBy(F.pmod(F.hash("id"), F.lit(self.cells)).alias("at")).agg(F.min("id").alias("id"))
        return [r.id for r in hashed.orderBy("at").collect()]  # cells rows

    def _buckets(self, key: str) -> int:
        return self.cells if key == "cell" else self.buckets

    def _entry(self, tag: str):
        return _at(self.spark, f"{self.folder}/manifest/{uuid.uuid5(uuid.NAMESPACE_OID, tag).hex}.json")

    def mark(self, tag: str, **values) -> None:
        """Record values under a tag, once what came before is written."""
        if self.resumable:
            where, fs = self._entry(tag)
            out = fs.create(where, True)
            out.write(bytearray(json.dumps({"tag": tag, **values}).encode()))
            out.close()
            self._entries[tag] = {"tag": tag, **values}

    def marked(self, tag: str) -> dict | None:
        return self._entries.get(tag)

    def put(self, df: DataFrame, name: str = "table", key: str = "id", tag: str | None = None) -> DataFrame:
        if tag in self._by_tag:
            return self._by_tag[tag]
        if tag in self._entries:
            return self.opened(tag)
        began, seen = time.perf_counter(), Observation()
        more = [c.alias(k) for k, c in self.counters.get(name, {}).items()]
        path = f"{self.folder}/{''.join(c if c.isalnum() else '_' for c in name)}-{uuid.uuid4().hex[:12]}"
        out = write_bucketed(df.observe(seen, F.count(F.lit(1)).alias("rows"), *more), path, key, self._buckets(key), key != "cell")
        where, fs = _at(self.spark, path)
        self.measures.append({"name": name, **seen.get, "bytes": fs.getContentSummary(where).getLength(), "seconds": time.perf_counter() - began})
        return self._listed(out, path, tag, key)

    def _listed(self, out: DataFrame, path: str, tag: str | None, key: str) -> DataFrame:
        tag = tag if self.resumable else None
        self._tables[id(out)] = (out, path, tag)
        if tag is not None:
            if tag not in self._entries:
                self.mark(tag, path=path, key=key, buckets=self._buckets(key))
            self._by_tag[tag] = out
        return out

    def opened(self, tag: str) -> DataFrame:
        """The table of a tag that the manifest has."""
        if tag not in self._by_tag:
            e = self._entries[tag]
            if e["buckets"] != self.buckets and e["key"] != "cell":
                raise ValueError(f"the run was begun with {e['buckets']} buckets, not {self.buckets}")
            self._listed(read_bucketed(self.spark, e["path"], e["key"], e["buckets"], e["key"] != "cell"), e["path"], tag, e["key"])
        return self._by_tag[tag]

    def put_all(self, tables: Sequence[tuple]) -> list[DataFrame]:
        """put() of several (df, name, key) or (df, name, key, tag), a few at a time: small tables don't wait for each other."""
        if len(tables) < 2:
            return [self.put(*t) for t in tables]
        with ThreadPoolExecutor(4) as pool:
            return list(pool.map(lambda t: self.put(*t), tables))

    def owns(self, df: DataFrame) -> bool:
        return id(df) in self._tables

    def release(self, *tables: DataFrame) -> None:
        """Delete tables that nothing reads any more; others than this store's own are left alone."""
        for df in tables:
            if self.owns(df):
                _, path, tag = self._tables.pop(id(df))
                if tag is not None:  # first of all, so that the manifest never names what is gone
                    del self._entries[tag], self._by_tag[tag]
                    where, fs = self._entry(tag)
                    fs.delete(where, False)
                self.spark.sql(f"DROP TABLE {df.bucketed_as}")
                where, fs = _at(self.spark, path)
                fs.delete(where, True)

    def release_all_but(self, *kept: DataFrame) -> None:
        held = {id(df) for df in kept}
        self.release(*[df for df, *_ in list(self._tables.values()) if id(df) not in held])

    def totals(self) -> dict[str, float]:
        """Each measure summed over all tables put so far."""
        out: dict[str, float] = {}
        for m in self.measures:
            for k, v in m.items():
                if k != "name" and v is not None:
                    out[k] = out.get(k, 0) + v
        return out
