"""``.npy`` matrices as tables, read in row ranges and written file by file.

Filters on chunk and row position reach the source: files of other chunks are not opened, and of the
others only the rows of the positions asked for are read. Writing is a job of two steps: tasks write
files under names of their own, which get their real names when all are complete, or are deleted.
"""

from __future__ import annotations

import posixpath
import re
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, Observation, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource,
    DataSourceArrowWriter,
    DataSourceReader,
    EqualNullSafe,
    EqualTo,
    Filter,
    GreaterThan,
    GreaterThanOrEqual,
    In,
    InputPartition,
    IsNotNull,
    LessThan,
    LessThanOrEqual,
    WriterCommitMessage,
)

from songloom.constants import VECTOR_FILE_PATTERN
from songloom.session import qualified

ROWS_PER_TASK = 100_000
ROWS_PER_BATCH = 10_000
ROWS_PER_FILE = 16_384


def _open(path: str) -> tuple[fs.FileSystem, str]:
    """File system and path of a URI; what has no scheme is for Spark to resolve first."""
    if "://" not in path:
        raise ValueError(f"{path} names no file system; use scan_npy or write_npy, which ask Spark for it")
    return fs.FileSystem.from_uri(path)


@dataclass
class RowRange(InputPartition):
    """Rows of one file that one task reads; positions in the file are in bytes."""

    path: str
    chunk_index: int
    first_index: int
    rows: int
    offset: int
    dim: int
    dtype: str


class NpyReader(DataSourceReader):
    def __init__(self, options: dict):
        self.root = options["path"]
        self.rows_per_task = int(options.get("rowspertask", ROWS_PER_TASK))
        self.chunks = {int(c) for c in options.get("chunks", "").split(",") if c.strip()} or None
        # Positions from the first to the one ahead of the second; no other rows are asked for.
        self.first, self.end = 0, 1 << 62

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Take what narrows chunk or position down; everything else is left to Spark."""
        for f in filters:
            column = f.attribute if hasattr(f, "attribute") else None
            if column == ("chunk_index",) and isinstance(f, (EqualTo, EqualNullSafe, In)):
                found = set(f.value) if isinstance(f, In) else {f.value}
                self.chunks = found if self.chunks is None else self.chunks & found
            elif column == ("original_index",) and isinstance(f, (EqualTo, EqualNullSafe)) and f.value is not None:
                self.first, self.end = max(self.first, f.value), min(self.end, f.value + 1)
            elif column == ("original_index",) and isinstance(f, (GreaterThan, GreaterThanOrEqual)):
                self.first = max(self.first, f.value + isinstance(f, GreaterThan))
            elif column == ("original_index",) and isinstance(f, (LessThan, LessThanOrEqual)):
                self.end = min(self.end, f.value + isinstance(f, LessThanOrEqual))
            elif not (isinstance(f, IsNotNull) and column in (("chunk_index",), ("original_index",))):
                yield f  # neither of these columns is ever missing

    def partitions(self) -> list[RowRange]:
        filesystem, root = _open(self.root)
        ranges = []
        for info in sorted(filesystem.get_file_info(fs.FileSelector(root)), key=lambda i: i.path):
            name = re.fullmatch(VECTOR_FILE_PATTERN, posixpath.basename(info.path))
            if not name or (self.chunks is not None and int(name[1]) not in self.chunks):
                continue
            ranges += self._ranges(filesystem, info.path, int(name[1]), int(name[2] or 0))
        return ranges

    def _ranges(self, filesystem: fs.FileSystem, path: str, chunk: int, first: int) -> Iterator[RowRange]:
        with filesystem.open_input_file(path) as file:
            version = np.lib.format.read_magic(file)
            read = np.lib.format.read_array_header_1_0 if version == (1, 0) else np.lib.format.read_array_header_2_0
            shape, by_column, dtype = read(file)
            start = file.tell()
        if len(shape) != 2 or by_column:
            raise ValueError(f"{path} does not hold a row-ordered matrix")
        end = min(shape[0], self.end - first)
        for row in range(max(0, self.first - first), end, self.rows_per_task):
            yield RowRange(path, chunk, first + row, min(self.rows_per_task, end - row),
                           start + row * shape[1] * dtype.itemsize, shape[1], dtype.str)

    def read(self, partition: RowRange | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition where there is none
            return
        filesystem, _ = _open(self.root)
        dtype = np.dtype(partition.dtype)
        with filesystem.open_input_file(partition.path) as file:
            file.seek(partition.offset)
            for row in range(0, partition.rows, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, partition.rows - row)
                # Half precision on disk becomes single precision in the table.
                values = np.frombuffer(file.read(n * partition.dim * dtype.itemsize), dtype).astype(np.float32)
                offsets = np.arange(0, (n + 1) * partition.dim, partition.dim, dtype=np.int32)
                index = partition.first_index + row
                yield pa.record_batch({
                    "chunk_index": pa.array(np.full(n, partition.chunk_index, np.int32)),
                    "original_index": pa.array(np.arange(index, index + n, dtype=np.int64)),
                    "embedding": pa.ListArray.from_arrays(pa.array(offsets), pa.array(values)),
                })


@dataclass
class Written(WriterCommitMessage):
    """The files of one task: the names they were written under and those they are to have."""

    files: list[tuple[str, str]]


class NpyWriter(DataSourceArrowWriter):
    """Rows in order of chunk and position, each stretch of ``rowsPerFile`` positions as a file."""

    def __init__(self, options: dict):
        self.root, self.dtype = options["path"], options.get("dtype", "<f2")
        self.rows_per_file = int(options.get("rowsperfile", ROWS_PER_FILE))
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        filesystem, folder = _open(self.root)
        files: list[tuple[str, str]] = []
        held: list[pa.Table] = []

        def give() -> None:
            table = pa.concat_tables(held).combine_chunks()
            held.clear()
            index = table.column("original_index").to_numpy()
            chunk, first = table.column("chunk_index")[0].as_py(), int(index[0])
            if index[-1] - first != len(index) - 1 or (np.diff(index) != 1).any():
                raise ValueError(f"chunk {chunk} has gaps after row {first}")
            vectors = table.column("embedding").combine_chunks()
            if len(np.unique(np.diff(vectors.offsets.to_numpy()))) > 1 or vectors.null_count:
                raise ValueError(f"chunk {chunk} has vectors of different lengths after row {first}")
            name = f"embeddings_chunk_{chunk}.from_{first}.npy"
            own = f"{folder}/.{self.job}-{uuid.uuid4().hex}"
            with filesystem.open_output_stream(own) as out:
                np.lib.format.write_array(
                    out, vectors.flatten().to_numpy().reshape(len(index), -1).astype(self.dtype), allow_pickle=False)
            files.append((own, f"{folder}/{name}"))

        last = None
        for batch in iterator:
            if not batch.num_rows:
                continue
            table = pa.Table.from_batches([batch])
            block = table.column("original_index").to_numpy() // self.rows_per_file
            chunk = table.column("chunk_index").to_numpy()
            cuts = np.flatnonzero((block[1:] != block[:-1]) | (chunk[1:] != chunk[:-1])) + 1
            edges = [0, *cuts.tolist(), len(block)]
            for a, z in zip(edges[:-1], edges[1:], strict=True):
                if held and (chunk[a], block[a]) != last:
                    give()
                held.append(table.slice(a, z - a))
                last = (chunk[a], block[a])
        if held:
            give()
        return Written(files)

    def commit(self, messages: list[Written | None]) -> None:
        filesystem, _ = _open(self.root)
        for own, name in (pair for m in messages if m for pair in m.files):
            if filesystem.get_file_info(name).type != fs.FileType.NotFound:
                filesystem.delete_file(name)
            filesystem.move(own, name)
        self._forget()

    def abort(self, messages: list[Written | None]) -> None:
        self._forget()

    def _forget(self) -> None:
        """Delete what this job wrote and did not name: files of tasks that failed or ran twice."""
        filesystem, folder = _open(self.root)
        for info in filesystem.get_file_info(fs.FileSelector(folder)):
            if info.base_name.startswith(f".{self.job}-"):
                filesystem.delete_file(info.path)


class NpyVectors(DataSource):
    """``spark.read.format("npy_vectors").load(folder)``; options ``chunks`` and ``rowsPerTask``.

    ``df.write.format("npy_vectors").mode("append").save(folder)``; options ``dtype`` and ``rowsPerFile``.
    """

    @classmethod
    def name(cls) -> str:
        return "npy_vectors"

    def schema(self) -> str:
        return "chunk_index int, original_index bigint, embedding array<float>"

    def reader(self, schema) -> NpyReader:
        return NpyReader({k.lower(): v for k, v in self.options.items()})

    def writer(self, schema, overwrite: bool) -> NpyWriter:
        return NpyWriter({k.lower(): v for k, v in self.options.items()})


def _register(spark: SparkSession) -> None:
    spark.dataSource.register(NpyVectors)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def scan_npy(spark: SparkSession, path: str, chunks: list[int] | None = None,
             rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Vectors of the ``embeddings_chunk_N.npy`` files in a folder; ``chunks`` limits which are opened."""
    _register(spark)
    reader = spark.read.format("npy_vectors").option("rowsPerTask", rows_per_task)
    if chunks:
        reader = reader.option("chunks", ",".join(map(str, chunks)))
    return reader.load(qualified(spark, path))


def write_npy(vectors: DataFrame, path: str, dtype: str = "<f2", rows_per_file: int = ROWS_PER_FILE) -> int:
    """Write vectors by position, at most ``rows_per_file`` rows to a file; returns the rows written.

    The files appear when all of them are complete; a task that runs again leaves nothing twice.
    """
    spark = vectors.sparkSession
    _register(spark)
    path = qualified(spark, path)
    filesystem, folder = _open(path)
    filesystem.create_dir(folder, recursive=True)
    seen = Observation("rows written")
    block = F.floor(F.col("original_index") / F.lit(rows_per_file))
    ordered = vectors.select("chunk_index", "original_index", F.col("embedding").cast("array<float>").alias("embedding")).repartition(
        "chunk_index", block).sortWithinPartitions("chunk_index", "original_index")
    ordered.observe(seen, F.count(F.lit(1)).alias("n")).write.format("npy_vectors").mode("append").options(
        dtype=dtype, rowsPerFile=rows_per_file).save(path)
    return seen.get["n"]
