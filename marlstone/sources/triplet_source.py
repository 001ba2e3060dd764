"""Triplet files as a Spark data source: spark.read.format("triplets"), df.write.format("triplets").

A file is 'n nnz', then 'col row value' lines, 1-based, by column; a folder is a `_header` of one such line and part files of
the others, in order of their names. Reading cuts files into ranges of bytes (option split_bytes), each a partition; a line
belongs to the range that it begins in. A narrower schema (any of row, col, val) parses only those fields. Filters on col, which the lines are
sorted by, skip ranges whose columns can't match.

Writing: each task writes its rows below a folder of the job's own; the commit counts the entries, writes the header, moves the
parts into place and ends with an empty `_SUCCESS`. A job that fails leaves nothing but that folder, which its abort removes. Rows must come sorted by
column, as write() below makes them. Option n: the matrix's order. Paths are URIs that Arrow's file systems know, or plain ones.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, GreaterThan, GreaterThanOrEqual, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage
from pyspark.sql.types import StructType

from ..model import Matrix

SPLIT_BYTES = 32 << 20
CHUNK = 4 << 20
#: Where a line has each field, and what it becomes.
FIELDS = {"col": (0, np.int32, -1), "row": (1, np.int32, -1), "val": (2, np.float64, 0)}


def _open(path: str) -> tuple[pafs.FileSystem, str]:
    return pafs.FileSystem.from_uri(path) if "://" in path else (pafs.LocalFileSystem(), path)


def _line_start(f, at: int) -> int:
    """The first place from at on where a line begins, or the file's end."""
    if not at:
        return 0
    at -= 1
    while at < f.size():
        text = f.read_at(4096, at)
        if (found := text.find(b"\n")) >= 0:
            return at + found + 1
        at += len(text)
    return f.size()


def _first_line(fs: pafs.FileSystem, path: str, start: int = 0) -> bytes:
    """The first line that begins at or after start."""
    with fs.open_input_file(path) as f:
        at = _line_start(f, start)
        return f.read_at(_line_start(f, at + 1) - at, at).strip() if at < f.size() else b""


def header(path: str) -> tuple[int, int]:
    """n and nnz of a file or folder."""
    fs, at = _open(path)
    folder = fs.get_file_info(at).type == pafs.FileType.Directory
    fields = _first_line(fs, f"{at}/_header" if folder else at).split()
    try:
        return int(fields[0]), int(fields[1])
    except (IndexError, ValueError):
        raise ValueError("header 'n nnz' expected") from None


@dataclass
class ByteRange(InputPartition):
    path: str
    start: int
    end: int
    skip_header: bool


class TripletReader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.path, self.names = options["path"], [f.name for f in schema.fields]
        if odd := set(self.names) - set(FIELDS):
            raise ValueError(f"no such fields: {sorted(odd)}")
        self.split = max(1, int(options.get("split_bytes", SPLIT_BYTES)))
        self.low, self.high = -(1 << 62), 1 << 62

    def pushFilters(self, filters):
        """Bounds of col; Spark checks every filter again."""
        for f in filters:
            if getattr(f, "attribute", None) == ("col",) and isinstance(getattr(f, "value", None), int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    self.low = max(self.low, f.value + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    self.high = min(self.high, f.value - isinstance(f, LessThan))
            yield f

    def partitions(self) -> list[ByteRange]:
        fs, at = _open(self.path)
        info = fs.get_file_info(at)
        if info.type == pafs.FileType.NotFound:
            raise FileNotFoundError(self.path)
        folder = info.type == pafs.FileType.Directory
        files = [info] if not folder else sorted((x for x in fs.get_file_info(pafs.FileSelector(at)) if x.base_name.startswith("part-")), key=lambda x: x.base_name)
        ranges = [ByteRange(x.path, k, min(k + self.split, x.size), not folder) for x in files for k in range(0, x.size, self.split)]
        if self.low > -(1 << 62) or self.high < 1 << 62:
            firsts = [self._first_col(fs, r) for r in ranges]
            # A range's columns reach up to the next one's first.
            nexts = [next((c for c in firsts[k + 1 :] if c is not None), 1 << 62) for k in range(len(ranges))]
            ranges = [r for r, lo, hi in zip(ranges, firsts, nexts, strict=True) if lo is not None and lo <= self.high and hi >= self.low]
        return ranges or [ByteRange("", 0, 0, False)]

    def _first_col(self, fs: pafs.FileSystem, r: ByteRange) -> int | None:
        if not r.start and r.skip_header:
            return -1
        fields = _first_line(fs, r.path, r.start).split()
        return int(fields[0]) - 1 if fields else None

    def read(self, r: ByteRange) -> Iterator[pa.RecordBatch]:
        if not r.path:
            return
        with _open(self.path)[0].open_input_file(r.path) as f:
            at, end = _line_start(f, r.start), _line_start(f, r.end)
            left, first = b"", r.skip_header and not r.start
            while at < end:
                text = left + f.read_at(min(CHUNK, end - at), at)
                at += len(text) - len(left)
                cut = text.rfind(b"\n") + 1 if at < end else len(text)
                text, left = text[:cut], text[cut:]
                if first and text:
                    text, first = text.partition(b"\n")[2], False
                if text.strip():
                    yield self._parsed(text)

    def _parsed(self, text: bytes) -> pa.RecordBatch:
        words = np.array(text.split())
        if len(words) % 3:
            raise ValueError("lines of 'col row value' expected")
        words = words.reshape(-1, 3)
        try:
            columns = [pa.array(words[:, at].astype(kind) + kind(more)) for at, kind, more in map(FIELDS.__getitem__, self.names)]
        except ValueError:
            raise ValueError("lines of 'col row value' expected") from None
        return pa.RecordBatch.from_arrays(columns, self.names)


@dataclass
class Part(WriterCommitMessage):
    name: str
    rows: int
    first: int
    last: int


class TripletWriter(DataSourceArrowWriter):
    def __init__(self, options: dict, schema: StructType, overwrite: bool):
        self.path, self.n, self.overwrite = options["path"], int(options.get("n", 0)), overwrite
        if {f.name for f in schema.fields} != set(FIELDS):
            raise ValueError("columns row, col and val expected")
        self.stage = f"_temporary-{uuid.uuid4().hex}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Part:
        fs, root = _open(self.path)
        fs.create_dir(f"{root}/{self.stage}", recursive=True)
        context = TaskContext.get()
        name, rows, first, last = f"part-{context.partitionId():06d}-{context.taskAttemptId()}", 0, -1, -1
        with fs.open_output_stream(f"{root}/{self.stage}/{name}") as out:
            for b in batches:
                if not len(b):
                    continue
                col, row, val = (b.column(c).to_pylist() for c in ("col", "row", "val"))
                if last > col[0] or any(x > y for x, y in zip(col, col[1:], strict=False)):
                    raise ValueError("rows aren't sorted by column")
                first, last = col[0] if first < 0 else first, col[-1]
                out.write("".join(f"{c + 1}\t{r + 1}\t{v!r}\n" for c, r, v in zip(col, row, val, strict=True)).encode())
                rows += len(b)
        return Part(name, rows, first, last)

    def commit(self, messages: list[Part | None]) -> None:
        fs, root = _open(self.path)
        parts = sorted((m for m in messages if m is not None and m.rows), key=lambda m: m.name)
        if any(a.last > b.first for a, b in zip(parts, parts[1:], strict=False)):
            self.abort(messages)
            raise ValueError("parts aren't sorted by column")
        there = [x.path for x in fs.get_file_info(pafs.FileSelector(root)) if x.base_name.startswith(("part-", "_header", "_SUCCESS"))]
        if there and not self.overwrite:
            self.abort(messages)
            raise FileExistsError(self.path)
        for x in there:
            fs.delete_file(x)
        for m in parts:
            fs.move(f"{root}/{self.stage}/{m.name}", f"{root}/{m.name}")
        last = max((m.last for m in parts), default=-1) + 1
        with fs.open_output_stream(f"{root}/_header") as out:
            out.write(f"{self.n or last}\t{sum(m.rows for m in parts)}\n".encode())
        with fs.open_output_stream(f"{root}/_SUCCESS"):
            pass
        self.abort(messages)

    def abort(self, messages: list[Part | None]) -> None:
        fs, root = _open(self.path)
        if fs.get_file_info(f"{root}/{self.stage}").type == pafs.FileType.Directory:
            fs.delete_dir(f"{root}/{self.stage}")


class TripletSource(DataSource):
    @classmethod
    def name(cls) -> str:
        return "triplets"

    def schema(self) -> str:
        return "row int, col int, val double"

    def reader(self, schema: StructType) -> TripletReader:
        return TripletReader(self.options, schema)

    def writer(self, schema: StructType, overwrite: bool) -> TripletWriter:
        return TripletWriter(self.options, schema, overwrite)


def register(spark: SparkSession) -> None:
    """Makes the format known; Spark wants filters handed on for a source that takes them."""
    spark.dataSource.register(TripletSource)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")


def read(spark: SparkSession, path: str, **options) -> Matrix:
    """The matrix of a file or folder; its entries must be as many as the header says."""
    register(spark)
    n, nnz = header(path)
    e = spark.read.format("triplets").options(**options).load(path)
    if e.count() != nnz:
        raise ValueError(f"{nnz} entries expected")
    return Matrix.of(e, n, n)


def write(matrix: Matrix, path: str, mode: str = "error") -> None:
    """A folder of parts in order of columns, each task its own range of them."""
    register(matrix.entries.sparkSession)
    e: DataFrame = matrix.entries.select("row", "col", "val")
    ordered = e.repartitionByRange(F.col("col"), F.col("row")).sortWithinPartitions("col", "row")
    ordered.write.format("triplets").option("n", matrix.n).mode("append" if mode == "error" else mode).save(path)
