"""Dense matrices as .npy files or raw little-endian numbers: a data source that reads row ranges, and its writer.

Files of a folder are one matrix, in the order of their names. Paths are those of Arrow's file systems (local paths, or uris of stores that it
knows), as executors read byte ranges of them.
"""

from __future__ import annotations

import ast
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

#: Bytes of a partition, and rows of a file that is written (held in memory until it is full).
PARTITION_BYTES, FILE_ROWS = 64 << 20, 1 << 16
_MAGIC = b"\x93NUMPY"
_SPARK_TYPES = {"<f4": "float", "<f8": "double", "<i4": "int", "<i8": "long"}


def _files(path: str) -> tuple[arrow_fs.FileSystem, list[arrow_fs.FileInfo]]:
    store, at = arrow_fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (arrow_fs.LocalFileSystem(), path)
    info = store.get_file_info(at)
    if info.type == arrow_fs.FileType.NotFound:
        raise FileNotFoundError(path)
    found = [info] if info.is_file else [f for f in store.get_file_info(arrow_fs.FileSelector(at)) if f.is_file and not f.base_name.startswith(("_", "."))]
    return store, sorted(found, key=lambda f: f.path)


@dataclass
class _Layout:
    path: str
    start: int
    rows: int
    width: int
    dtype: str


def _layout(store: arrow_fs.FileSystem, info: arrow_fs.FileInfo, dtype: str | None, width: int | None) -> _Layout:
    """Where a file's numbers start, and their shape; dtype and width are those of a raw file."""
    with store.open_input_file(info.path) as f:
        head = f.read_at(min(12, info.size), 0)
        if head[:6] != _MAGIC:
            if not dtype or not width:
                raise ValueError(f"{info.path} is no .npy file: give dtype and width")
            size = np.dtype(dtype).itemsize * width
            if info.size % size:
                raise ValueError(f"{info.path} has {info.size} bytes, which aren't rows of {size}")
            return _Layout(info.path, 0, info.size // size, width, np.dtype(dtype).str)
        wide = head[6] > 1
        length = int.from_bytes(head[8 : 12 if wide else 10], "little")
        start = (12 if wide else 10) + length
        about = ast.literal_eval(f.read_at(length, start - length).decode("latin1"))
    shape = about["shape"]
    if about["fortran_order"] and len(shape) > 1 or len(shape) not in (1, 2):
        raise ValueError(f"{info.path}: only vectors and matrices in the order of rows can be read")
    return _Layout(info.path, start, shape[0], shape[1] if len(shape) == 2 else 1, about["descr"])


@dataclass
class _Rows(InputPartition):
    path: str
    offset: int
    first: int
    rows: int
    width: int
    dtype: str


class _Reader(DataSourceReader):
    def __init__(self, path: str, layouts: list[_Layout], size: int) -> None:
        self.path, self.layouts, self.size = path, layouts, size

    def partitions(self) -> list[InputPartition]:
        out, first = [], 0
        for f in self.layouts:
            row = np.dtype(f.dtype).itemsize * f.width
            step = max(1, self.size // max(1, row))
            out += [_Rows(f.path, f.start + k * row, first + k, min(step, f.rows - k), f.width, f.dtype) for k in range(0, f.rows, step)]
            first += f.rows
        return out

    def read(self, part: _Rows | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # a matrix without rows has no ranges
            return
        store = _files(self.path)[0]
        row = np.dtype(part.dtype).itemsize * part.width
        with store.open_input_file(part.path) as f:
            for k in range(0, part.rows, 8192):
                n = min(8192, part.rows - k)
                values = np.frombuffer(f.read_at(n * row, part.offset + k * row), part.dtype)
                x = pa.ListArray.from_arrays(pa.array(np.arange(n + 1, dtype=np.int32) * part.width), pa.array(values))
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(part.first + k, part.first + k + n)), x], names=["row", "x"])


class _Writer(DataSourceArrowWriter):
    def __init__(self, path: str, npy: bool, dtype: str, width: int, overwrite: bool) -> None:
        self.path, self.npy, self.dtype, self.width, self.overwrite = path, npy, dtype, width, overwrite
        store, at = arrow_fs.FileSystem.from_uri(path) if "://" in path else (arrow_fs.LocalFileSystem(), path.removeprefix("file:"))
        if store.get_file_info(at).type != arrow_fs.FileType.NotFound:
            if not overwrite:
                raise FileExistsError(path)
            store.delete_dir(at)
        store.create_dir(at)

    def write(self, batches: Iterator[pa.RecordBatch]) -> WriterCommitMessage:
        from pyspark import TaskContext

        store, at = arrow_fs.FileSystem.from_uri(self.path) if "://" in self.path else (arrow_fs.LocalFileSystem(), self.path.removeprefix("file:"))
        task, held, rows, files = TaskContext.get(), [], 0, 0

        def out() -> None:
            nonlocal held, rows, files
            values = np.concatenate(held).astype(self.dtype)
            head = b""
            if self.npy:
                about = str({"descr": np.dtype(self.dtype).str, "fortran_order": False, "shape": (rows, self.width)}).encode()
                about += b" " * (-(len(about) + 11) % 64) + b"\n"
                head = _MAGIC + b"\x01\x00" + len(about).to_bytes(2, "little") + about
            # A task that runs again writes the same file.
            with store.open_output_stream(f"{at}/part-{task.partitionId():05d}-{files:05d}.{'npy' if self.npy else 'bin'}") as f:
                f.write(head)
                f.write(values.tobytes())
            held, rows, files = [], 0, files + 1

        for batch in batches:
            x = batch.column(batch.schema.names.index("x"))
            if len(x) and (x.null_count or (np.asarray(x.value_lengths()) != self.width).any()):
                raise ValueError(f"rows must have {self.width} numbers")
            for k in range(0, len(x), FILE_ROWS):
                part = x.slice(k, FILE_ROWS)
                held.append(np.asarray(part.flatten()))
                rows += len(part)
                if rows >= FILE_ROWS:
                    out()
        if rows:
            out()
        return WriterCommitMessage()


class MatrixSource(DataSource):
    """Format 'matrix': (row long, x array of the files' numbers). Options: dtype and width of raw files, partition_bytes; to write npy (default true)."""

    @classmethod
    def name(cls) -> str:
        return "matrix"

    def _layouts(self) -> list[_Layout]:
        store, files = _files(self.options["path"])
        width = self.options.get("width")
        found = [_layout(store, f, self.options.get("dtype"), int(width) if width else None) for f in files]
        if len({(f.width, f.dtype) for f in found}) > 1:
            raise ValueError("the files of a matrix have one width and one kind of numbers")
        return found

    def schema(self) -> str:
        found = self._layouts()
        kind = np.dtype(found[0].dtype).str if found else np.dtype(self.options.get("dtype", "<f4")).str
        if kind not in _SPARK_TYPES:
            raise ValueError(f"numbers of kind {kind}")
        return f"row long, x array<{_SPARK_TYPES[kind]}>"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Reader(self.options["path"], self._layouts(), int(self.options.get("partition_bytes", PARTITION_BYTES)))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return _Writer(self.options["path"], self.options.get("npy", "true") == "true", self.options["dtype"], int(self.options["width"]), overwrite)


def read_matrix(spark: SparkSession, path: str, dtype: str | None = None, width: int | None = None, partition_bytes: int = PARTITION_BYTES) -> DataFrame:
    """(row, x) of .npy files, or of raw files with this dtype and width; rows count from 0 over the files in the order of their names."""
    spark.dataSource.register(MatrixSource)
    reader = spark.read.format("matrix").option("partition_bytes", partition_bytes)
    for key, value in (("dtype", dtype), ("width", width)):
        reader = reader.option(key, value) if value else reader
    return reader.load(path)


def write_matrix(rows: DataFrame, path: str, width: int, dtype: str = "<f4", npy: bool = True, overwrite: bool = False) -> None:
    """rows (row, x) in the order of row, as files of up to FILE_ROWS rows each: read back, rows are numbered from 0 without gaps."""
    rows.sparkSession.dataSource.register(MatrixSource)
    ordered = rows.select("row", "x").repartitionByRange("row").sortWithinPartitions("row")
    ordered.write.format("matrix").option("dtype", dtype).option("width", width).option("npy", str(npy).lower()).mode("overwrite" if overwrite else "append").save(path)


def read_permutation_npy(spark: SparkSession, path: str) -> DataFrame:
    """(pos, id) of a vector of ids."""
    return read_matrix(spark, path).select(F.col("row").alias("pos"), F.col("x")[0].cast("long").alias("id"))


def write_permutation_npy(order: DataFrame, path: str) -> None:
    """The ids of (id, pos) by position."""
    write_matrix(order.select(F.col("pos").alias("row"), F.array("id").alias("x")), path, 1, "<i8")


def read_csc_npy(spark: SparkSession, folder: str) -> DataFrame:
    """(src, dst) of indptr.npy and indices.npy: column dst holds the entries of indices from indptr[dst] up to indptr[dst + 1]. The first must start at 0."""
    starts = read_matrix(spark, f"{folder}/indptr.npy").select(F.col("row").alias("dst"), F.col("x")[0].alias("first"))
    if (least := starts.where("dst = 0").first()) is None or least.first:
        raise ValueError("the first column must start at 0")
    ends = starts.select((F.col("dst") - 1).alias("dst"), F.col("first").alias("end"))
    columns = starts.join(ends, "dst").where("end > first").select("dst", "first", "end")
    # A column's entries stand together: a range of positions is looked up by the blocks that it touches, so no window over all columns is needed.
    block = 1 << 16
    touched = columns.select("dst", "first", "end", F.explode(F.sequence(F.floor(F.col("first") / block), F.floor((F.col("end") - 1) / block))).alias("block"))
    entries = read_matrix(spark, f"{folder}/indices.npy").select(F.col("row").alias("pos"), F.col("x")[0].cast("long").alias("src"), F.floor(F.col("row") / block).alias("block"))
    grouped = touched.groupBy("block").agg(F.sort_array(F.collect_list(F.struct("first", "end", "dst"))).alias("columns"))  # a block touches 2^16 columns at most

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for pos, src, columns in zip(batch.column("pos").to_pylist(), batch.column("srcs"), batch.column("columns"), strict=True):
                c = columns.values
                first, dst = np.asarray(c.field("first")), np.asarray(c.field("dst"))
                own = np.asarray(src.values)
                at = dst[np.searchsorted(first, np.arange(pos, pos + len(own)), side="right") - 1]
                yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(at)], names=["src", "dst"])

    packed = entries.groupBy("block").agg(F.min("pos").alias("pos"), F.transform(F.sort_array(F.collect_list(F.struct("pos", "src"))), lambda s: s["src"]).alias("srcs"))  # 2^16 entries at most
    return packed.join(grouped, "block").select("pos", "srcs", "columns").mapInArrow(place, "src long, dst long")
