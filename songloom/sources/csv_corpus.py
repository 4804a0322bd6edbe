"""Corpus CSV files, free text with line breaks included.

A line break ends a record only outside of quotes, so where a record begins depends on all quotes
ahead of it. That is found block by block all the same: every block of a file counts its quotes
and reports, for either case, where its first record begins and how many begin in it. Counted up
from the start of the file, the parity of the quotes tells which case each block is in. Then each
block's records are read by a task of its own, those that begin in it, and the counts give every
row its position without reading a file twice. See :class:`CsvRanges`.

Files as RFC 4180 has them are meant: a field with a quote in it is quoted, and its quotes are
doubled. A file that ends within quotes, or whose rows are not as long as its header, is an error.
Files in a store that only Spark opens are read by Spark, a task for each file.
"""

from __future__ import annotations

import collections
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.csv as arrow_csv
import pyarrow.parquet as pq
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from songloom.constants import LYRICS_FILE_PATTERN, METADATA_FILE_PATTERN
from songloom.session import qualified, scratch_path

# Bytes of a file that one task reads, and how many of them it holds at a time (more where a record is longer).
RANGE_BYTES = 32 << 20
STRETCH_BYTES = 1 << 20

_TEXT = {"header": True, "multiLine": True, "quote": '"', "escape": '"', "mode": "FAILFAST"}
_QUOTE, _LINE_END, _RETURN = b'"\n\r'
_BOM = b"\xef\xbb\xbf"
_SUMMARY = pa.schema({
    "path": pa.string(), "block": pa.int64(), "begin": pa.int64(), "end": pa.int64(), "quotes": pa.int64(),
    "first": pa.list_(pa.int64()), "records": pa.list_(pa.int64()), "header": pa.binary()})


def _record_starts(data: np.ndarray, at_end: bool) -> tuple[int, list[np.ndarray]]:
    """Quotes among the bytes but the first and the last two, and where records begin if the second byte is outside
    of quotes, and if it is inside.

    The first byte is the one ahead of the block, the last two those behind it (fewer at the end of the file).
    Empty lines are no records.
    """
    n = len(data) - 1 if at_end else len(data) - 3
    ends = np.flatnonzero(data[:n] == _LINE_END)
    at = np.flatnonzero(data[1:n + 1] == _QUOTE) + 1
    starts, odd = ends + 1, np.searchsorted(at, ends, side="right") & 1
    following = np.concatenate([data, np.zeros(1, np.uint8)])
    some = (following[starts] != _LINE_END) & ((following[starts] != _RETURN) | (following[starts + 1] != _LINE_END))
    return len(at), [starts[some & (odd == state)] for state in (0, 1)]


@dataclass
class _Counted:
    """Quotes of the bytes so far and, for either case of their beginning, the first record's place and how many there are."""

    quotes: int
    first: list[int]
    records: list[int]

    def add(self, quotes: int, starts: list[np.ndarray]) -> None:
        for state in (0, 1):
            own = starts[state ^ (self.quotes & 1)]
            if len(own) and not self.records[state]:
                self.first[state] = int(own[0])
            self.records[state] += len(own)
        self.quotes += quotes


def _count_records(file, size: int, begin: int, end: int, after: int) -> _Counted:
    """Quotes and records of the bytes from ``begin`` to ``end``, a stretch at a time; records begin at ``after`` or later."""
    counted = _Counted(0, [-1, -1], [0, 0])
    for at in range(begin, end, STRETCH_BYTES):
        to, before = min(end, at + STRETCH_BYTES), max(0, at - 1)
        file.seek(before)
        data = np.frombuffer(file.read(min(size, to + 2) - before), np.uint8)
        if at == 0:  # as if a line had ended ahead of the file
            data = np.concatenate([np.array([_LINE_END], np.uint8), data])
            before = -1
        if to < size:
            # Short of the end of the file by one byte only: no second byte behind the stretch.
            data = np.concatenate([data, np.zeros(max(0, to - before + 2 - len(data)), np.uint8)])
        quotes, starts = _record_starts(data, to >= size)
        counted.add(quotes, [s[s + before >= after] + before for s in starts])
    return counted


def _first_record(file, size: int) -> bytes:
    """The first record of a file with its line end, and what stands ahead of it."""
    n, data = 1 << 16, b""
    while True:
        file.seek(0)
        data = file.read(min(n, size))
        flat = np.frombuffer(data, np.uint8)
        outside = np.flatnonzero((flat == _LINE_END) & (np.cumsum(flat == _QUOTE) % 2 == 0))
        if len(outside) or len(data) >= size:
            return data[:outside[0] + 1] if len(outside) else data
        n *= 4


def _summarise(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Quotes, first records and their number for each block (path, size, block, begin, end)."""
    for batch in batches:
        for row in batch.to_pylist():
            system, path = fs.FileSystem.from_uri(row["path"])
            with system.open_input_file(path) as file:
                header = _first_record(file, row["size"]) if row["block"] == 0 else None
                counted = _count_records(file, row["size"], row["begin"], row["end"], len(header or b""))
            yield pa.RecordBatch.from_pylist([{
                "path": row["path"], "block": row["block"], "begin": row["begin"], "end": row["end"], "quotes": counted.quotes,
                "first": counted.first, "records": counted.records, "header": header}], schema=_SUMMARY)


def _record_stretches(file, begin: int, end: int) -> Iterator[bytes]:
    """The bytes from ``begin`` to ``end``, which are whole records, in stretches that are whole records too."""
    file.seek(begin)
    left, open_, inside = end - begin, [], 0
    while left > 0:
        data = file.read(min(left, STRETCH_BYTES))
        if not data:
            break
        left -= len(data)
        flat = np.frombuffer(data, np.uint8)
        quotes, ends = np.flatnonzero(flat == _QUOTE), np.flatnonzero(flat == _LINE_END)
        outside = ends[(np.searchsorted(quotes, ends) + inside) % 2 == 0]
        inside ^= len(quotes) & 1
        if len(outside):
            cut = int(outside[-1]) + 1
            yield b"".join([*open_, data[:cut]])
            open_, data = [], data[cut:]
        open_.append(data)
    if any(open_):
        yield b"".join(open_)


@dataclass
class CsvRange(InputPartition):
    """Records that one task reads: from byte ``begin`` to byte ``end``, the first being row ``row`` of its chunk."""

    path: str
    chunk: int | None
    begin: int
    end: int
    row: int
    rows: int
    header: list[str]


def _names(header: bytes) -> list[str]:
    table = arrow_csv.read_csv(
        pa.BufferReader(header.removeprefix(_BOM)), arrow_csv.ReadOptions(autogenerate_column_names=True),
        arrow_csv.ParseOptions(newlines_in_values=True), arrow_csv.ConvertOptions(column_types={}, strings_can_be_null=False))
    return [str(column[0].as_py()) for column in table.columns]


def _chunk(path: str, pattern: str) -> int | None:
    """The number in the name of a file's folder, or else in its own."""
    found = re.search(r"/chunk_index=(\d+)/", path) or re.search(pattern + "$", path)
    return int(found[1]) if found else None


def _ranges(blocks: list[dict], chunk: int | None, row: int) -> list[CsvRange]:
    """The ranges of one file from its blocks in order; ``row`` is its first row's position in the chunk."""
    header, inside, out = _names(blocks[0]["header"]) if blocks[0]["header"].strip() else [], 0, []
    for block in blocks:
        first, records = block["first"][inside], block["records"][inside]
        if records:
            if out:
                out[-1].end = first
            out.append(CsvRange(block["path"], chunk, first, -1, row, records, header))
            row += records
        inside ^= block["quotes"] & 1
    if inside:
        raise ValueError(f"{blocks[0]['path']} ends within quotes")
    if out:
        out[-1].end = blocks[-1]["end"]
    return out


class CsvRangeReader(DataSourceReader):
    def __init__(self, options: dict):
        self.plan, self.columns, self.pattern = options["plan"], json.loads(options["columns"]), options["pattern"]

    def partitions(self) -> list[CsvRange]:
        system, path = fs.FileSystem.from_uri(self.plan)
        blocks = pq.read_table(path, filesystem=system).sort_by([("path", "ascending"), ("block", "ascending")]).to_pylist()
        files: dict[str, list[dict]] = {}
        for block in blocks:
            files.setdefault(block["path"], []).append(block)
        out, rows = [], collections.Counter()
        for file, own in files.items():
            chunk = _chunk(file, self.pattern)
            out += (found := _ranges(own, chunk, rows[chunk]))
            rows[chunk] += sum(part.rows for part in found)
        return out

    def read(self, partition: CsvRange) -> Iterator[pa.RecordBatch]:
        if partition is None:  # Spark asks for one partition where there is none
            return
        system, path = fs.FileSystem.from_uri(partition.path)
        rows = 0
        with system.open_input_file(path) as file:
            for data in _record_stretches(file, partition.begin, partition.end):
                if not data.strip(b"\r\n"):  # empty lines are no records
                    continue
                whole = self._table(data, partition, partition.row + rows)
                rows += whole.num_rows
                yield from whole.to_batches(max_chunksize=10_000)
        if rows != partition.rows:
            raise ValueError(f"{partition.path} from byte {partition.begin} has {rows} rows, not {partition.rows}")

    def _table(self, data: bytes, partition: CsvRange, row: int) -> pa.Table:
        """Whole records as rows, the first being row ``row`` of its chunk."""
        kept = [c for c in self.columns if c in partition.header]
        table = arrow_csv.read_csv(
            pa.BufferReader(data),
            arrow_csv.ReadOptions(column_names=partition.header, block_size=len(data) + 1, use_threads=False),
            arrow_csv.ParseOptions(newlines_in_values=True),
            arrow_csv.ConvertOptions(
                column_types=dict.fromkeys(partition.header, pa.string()), include_columns=kept or partition.header[:1],
                null_values=[""], strings_can_be_null=True, quoted_strings_can_be_null=True))
        n = table.num_rows
        columns = [table[c] if c in kept else pa.nulls(n, pa.string()) for c in self.columns]
        return pa.table([pa.array([partition.chunk] * n, pa.int32()), pa.array(np.arange(row, row + n)), *columns],
                        names=["chunk_index", "original_index", *self.columns])


class CsvRanges(DataSource):
    """Records of multi-line CSV files, read in ranges; option ``plan`` is where the blocks' summaries lie."""

    @classmethod
    def name(cls) -> str:
        return "csv_ranges"

    def schema(self) -> T.StructType:
        return T.StructType([T.StructField("chunk_index", T.IntegerType()), T.StructField("original_index", T.LongType()), *[
            T.StructField(c, T.StringType()) for c in json.loads(self.options["columns"])]])

    def reader(self, schema) -> CsvRangeReader:
        return CsvRangeReader(dict(self.options))


def _openable(uri: str) -> bool:
    """Whether tasks can open files of this store by themselves."""
    try:
        fs.FileSystem.from_uri(uri)
    except (pa.ArrowException, OSError, ValueError):
        return False
    return True


def _in_ranges(spark: SparkSession, path: str, range_bytes: int) -> tuple[list[list[str]], str]:
    """The different headers of the files, and where the summaries of their blocks are stored."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.csv").load(path).select(
        F.col("path"), F.col("length").alias("size")).filter("size > 0")
    last = F.greatest(F.ceil(F.col("size") / range_bytes) - 1, F.lit(0))
    blocks = files.withColumn("block", F.explode(F.sequence(F.lit(0).cast("bigint"), last))).select(
        F.regexp_replace("path", "^file:/(?!/)", "file:///").alias("path"), "size", "block", (F.col("block") * range_bytes).alias("begin"),
        F.least(F.col("size"), (F.col("block") + 1) * range_bytes).alias("end"))
    plan = scratch_path(spark, "csv-plan")
    blocks.repartition(spark.sparkContext.defaultParallelism * 4, "path", "block").mapInArrow(
        _summarise, "path string, block bigint, begin bigint, end bigint, quotes bigint, first array<bigint>, "
        "records array<bigint>, header binary").write.parquet(plan)
    # One row per different header.
    headers = spark.read.parquet(plan).filter("header IS NOT NULL").groupBy("header").agg(F.min("path").alias("path")).orderBy("path")
    return [_names(bytes(r["header"])) for r in headers.collect() if bytes(r["header"]).strip()], qualified(spark, plan)


def _columns(path: str, headers: list[list[str]], needed: list[str], columns: list[str] | None) -> list[str]:
    """The columns to read; each file must have those that are needed."""
    for header in headers:
        missing = [c for c in [*needed, *(columns or [])] if c not in header]
        if missing:
            raise ValueError(f"column(s) not in {path}: {', '.join(missing)}; there are: {', '.join(header)}")
    every = list(dict.fromkeys(c for header in headers for c in header))
    return [c for c in columns or every if c not in ("chunk_index", "original_index")]


def _scan(spark: SparkSession, path: str, needed: list[str], columns: list[str] | None,
          na_values: list[str] | None, file_pattern: str, range_bytes: int) -> DataFrame:
    if _openable(qualified(spark, path)):
        headers, plan = _in_ranges(spark, path, range_bytes)
        kept = _columns(path, headers, needed, columns)
        spark.dataSource.register(CsvRanges)
        rows = spark.read.format("csv_ranges").options(plan=plan, columns=json.dumps(kept), pattern=file_pattern).load()
    else:
        rows, kept = _scan_files(spark, path, needed, columns, file_pattern)
    for column in kept if na_values else []:
        rows = rows.withColumn(column, F.when(~F.col(column).isin(na_values), F.col(column)))
    return rows


def _files_by_header(spark: SparkSession, path: str) -> list[list[str]]:
    """The files at ``path``, those with the same first line together; one line per file is collected."""
    lines = spark.read.text(path).filter(F.col("_metadata.file_block_start") == 0).select(
        F.col("_metadata.file_path").alias("file"), "value", F.monotonically_increasing_id().alias("line"))
    files: dict[str, list[str]] = {}
    for row in lines.groupBy("file").agg(F.min_by("value", "line").alias("first")).orderBy("file").collect():
        files.setdefault(row["first"].removeprefix("\ufeff").rstrip("\r"), []).append(row["file"])
    return list(files.values()) or [[path]]


def _read_alike(spark: SparkSession, path: str, files: list[str]) -> DataFrame:
    """Files with one header, every column as text."""
    folders = {"basePath": path} if any("chunk_index=" in f for f in files) else {}
    header = spark.read.options(**_TEXT, **folders).csv(files).columns
    schema = T.StructType([T.StructField(c, T.StringType()) for c in header])
    return spark.read.options(**_TEXT, **folders).schema(schema).csv(files)


def _scan_files(spark: SparkSession, path: str, needed: list[str], columns: list[str] | None, file_pattern: str
                ) -> tuple[DataFrame, list[str]]:
    """The rows of the files, each read by one task, and their columns."""
    groups = [_read_alike(spark, path, files) for files in _files_by_header(spark, path)]
    kept = _columns(path, [[c for c in group.columns if c != "chunk_index"] for group in groups], needed, columns)
    from_name = F.regexp_extract(F.col("_metadata.file_name"), file_pattern, 1)
    chunk = (F.col("chunk_index") if any("chunk_index" in g.columns for g in groups) else from_name).try_cast("int")
    parts = [group.select(
        F.col("_metadata.file_path").alias("_file"), chunk.alias("chunk_index"),
        F.monotonically_increasing_id().alias("_row"), *[c for c in kept if c in group.columns]) for group in groups]
    rows = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)
    rows = rows.select("_file", "chunk_index", "_row", *kept)
    # Shift each file's rows to follow the earlier files of its chunk. One row per file.
    earlier = Window.partitionBy("chunk_index").orderBy("_file").rowsBetween(Window.unboundedPreceding, -1)
    files = rows.groupBy("chunk_index", "_file").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    shifts = files.select(
        "_file", (F.coalesce(F.sum("_n").over(earlier), F.lit(0)) - F.col("_first")).alias("_shift"))
    return rows.join(F.broadcast(shifts), "_file").select(
        "chunk_index", (F.col("_row") + F.col("_shift")).alias("original_index"), *kept), kept


def scan_lyrics_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                    na_values: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    """Rows of lyrics files with chunk number (from the file name) and row position.

    ``na_values`` are spellings read as missing, such as ``["NA", "null", "None", "nan"]``;
    by default only an empty field is.
    """
    return _scan(spark, path, ["lyrics"], columns, na_values, LYRICS_FILE_PATTERN, range_bytes)


def scan_metadata_csv(spark: SparkSession, path: str, columns: list[str] | None = None,
                      na_values: list[str] | None = None, range_bytes: int = RANGE_BYTES) -> DataFrame:
    return _scan(spark, path, ["title", "artist"], columns, na_values, METADATA_FILE_PATTERN, range_bytes)


def write_csv_chunks(rows: DataFrame, path: str) -> None:
    """Rows as CSV that the readers above give back unchanged, one folder per chunk."""
    rows.write.mode("overwrite").partitionBy("chunk_index").options(
        header=True, quote='"', escape='"', quoteAll=True, emptyValue='""',
        ignoreLeadingWhiteSpace=False, ignoreTrailingWhiteSpace=False).csv(path)
