"""PLY clouds read in pieces of one file and written by many tasks.

ASCII files go through Spark's text reader, which splits them by bytes: every line
knows the block it was read from, lines are counted per block, and the sums of the
counts before a block give its first line's number.  Binary files have rows of one
size, so a Python data source deals byte ranges of one file to tasks, which turn them
into Arrow columns.  The sink writes binary files of a bounded number of rows under
temporary names, and names them and a manifest when all tasks have committed.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from geoquilt.storage import listed

#: Property types, by their names in either style of the format (fixed values).
TYPES = {
    "char": "i1", "int8": "i1", "uchar": "u1", "uint8": "u1", "short": "i2", "int16": "i2", "ushort": "u2", "uint16": "u2",
    "int": "i4", "int32": "i4", "uint": "u4", "uint32": "u4", "float": "f4", "float32": "f4", "double": "f8", "float64": "f8",
}
FORMATS = {"ascii": "", "binary_little_endian": "<", "binary_big_endian": ">"}
COLORS = {"red": "r", "green": "g", "blue": "b"}
GEOMETRY = ("x", "y", "z", "nx", "ny", "nz")
#: Bytes in which a header must end, rows of a task when reading, of a batch, and of a file when writing.
MAX_HEADER, ROWS_PER_TASK, ROWS_PER_BATCH, ROWS_PER_FILE = 1 << 16, 1 << 20, 1 << 16, 1 << 20
MANIFEST = "_manifest.json"
#: Names of a merged cloud in a capture's folder, in the order in which they are looked for.
CANDIDATES = ("final_merged.ply", "merged.ply")


@dataclass(frozen=True)
class Header:
    """Layout of a PLY file: byte order ('' for text), rows before the vertices, vertices, properties, bytes of the header."""

    order: str
    before: int
    count: int
    properties: tuple[tuple[str, str], ...]
    skipped: int
    size: int

    @property
    def row(self) -> np.dtype:
        return np.dtype([(n, self.order + t) for n, t in self.properties])

    @property
    def columns(self) -> list[str]:
        return [COLORS.get(n, n) for n, _ in self.properties]


def parse_header(data: bytes) -> Header:
    """The layout that the first bytes of a file describe.

    ``skipped`` is the bytes of the elements before the vertices; lists there, or
    among the vertices' properties, have no fixed size and are an error in a binary file.
    """
    if data.split(b"\n", 1)[0].strip() != b"ply":
        raise ValueError("not a PLY file")
    at = data.find(b"end_header")
    end = data.find(b"\n", at)
    if at < 0 or end < 0:
        raise ValueError("the PLY header has no end")
    order, elements = None, []
    for line in data[:at].decode("ascii", "replace").splitlines()[1:]:
        parts = line.split()
        match parts[:1]:
            case ["format"]:
                order = FORMATS.get(parts[1])
            case ["element"]:
                elements.append((parts[1], int(parts[2]), []))
            case ["property"]:
                elements[-1][2].append((parts[-1], "list" if parts[1] == "list" else TYPES[parts[1]]))
    if order is None:
        raise ValueError("the PLY format is unknown")
    names = [e[0] for e in elements]
    if "vertex" not in names:
        raise ValueError("the PLY file has no vertices")
    k = names.index("vertex")
    earlier, (_, count, properties) = elements[:k], elements[k]
    kinds = [t for e in (*earlier, elements[k]) for _, t in e[2]]
    if "list" in kinds and (order or "list" in [t for _, t in properties]):
        raise ValueError("lists before or among the vertices are not read")
    skipped = sum(n * sum(np.dtype(t).itemsize for _, t in ps) for _, n, ps in earlier) if order else 0
    return Header(order, sum(e[1] for e in earlier), count, tuple(properties), skipped, end + 1)


def _open(path: str) -> tuple[pyarrow.fs.FileSystem, str]:
    return pyarrow.fs.FileSystem.from_uri(path) if "://" in path or path.startswith("file:") else (pyarrow.fs.LocalFileSystem(), path)


def read_header(path: str) -> Header:
    """Header of a binary or text file at a path or URI."""
    fs, at = _open(path)
    with fs.open_input_stream(at) as f:
        return parse_header(f.read(MAX_HEADER))


@dataclass
class Stretch(InputPartition):
    """Rows of one file that a task reads: the number of the first one, and where its bytes start."""

    path: str
    first: int
    rows: int
    offset: int


class PlyReader(DataSourceReader):
    """Byte ranges of binary files, one task each."""

    def __init__(self, header: Header, files: Sequence[tuple[str, int]], rows_per_task: int) -> None:
        self.header, self.files, self.rows_per_task = header, files, rows_per_task

    def partitions(self) -> list[Stretch]:
        out, first, h = [], 0, self.header
        for path, count in self.files:
            for at in range(0, count, self.rows_per_task):
                out.append(Stretch(path, first + at, min(self.rows_per_task, count - at), h.size + h.skipped + at * h.row.itemsize))
            first += count
        return out or [Stretch("", 0, 0, 0)]

    def read(self, partition: Stretch) -> Iterator[pa.RecordBatch]:
        if not partition.rows:
            return
        row = self.header.row
        fs, at = _open(partition.path)
        with fs.open_input_file(at) as f:
            f.seek(partition.offset)
            for done in range(0, partition.rows, ROWS_PER_BATCH):
                n = min(ROWS_PER_BATCH, partition.rows - done)
                data = f.read(n * row.itemsize)
                if len(data) < n * row.itemsize:
                    raise ValueError(f"{partition.path} ends before its last vertex")
                found = np.frombuffer(data, row)
                columns = [np.arange(partition.first + done, partition.first + done + n, dtype=np.int64)]
                columns += [found[name].astype(np.float64) / (255 if name in COLORS else 1) for name, _ in self.header.properties]
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["pid", *self.header.columns])


@dataclass
class Written(WriterCommitMessage):
    """Files of a task, as (temporary name, rows), and its partition's number."""

    partition: int
    files: list[tuple[str, int]]


class PlyWriter(DataSourceArrowWriter):
    """Binary files of at most ``rows_per_file`` rows; a lost task leaves only temporary names, which nothing reads."""

    def __init__(self, path: str, names: Sequence[str], rows_per_file: int) -> None:
        self.path, self.names, self.rows_per_file, self.job = path.rstrip("/"), names, rows_per_file, uuid.uuid4().hex

    def _header(self, count: int) -> bytes:
        kinds = [f"property {'uchar' if n in COLORS.values() else 'double'} {next((k for k, v in COLORS.items() if v == n), n)}" for n in self.names]
        return "\n".join(["ply", "format binary_little_endian 1.0", f"element vertex {count:012d}", *kinds, "end_header", ""]).encode()

    def _rows(self, table: pa.Table) -> bytes:
        out = np.empty(table.num_rows, [(n, "u1" if n in COLORS.values() else "<f8") for n in self.names])
        for n in self.names:
            values = table.column(n).to_numpy()
            out[n] = np.clip(np.rint(values * 255), 0, 255) if n in COLORS.values() else values
        return out.tobytes()

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        context = TaskContext.get()
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        files: list[tuple[str, int]] = []
        held: list[pa.RecordBatch] = []

        def roll(batches: list[pa.RecordBatch]) -> None:
            table = pa.Table.from_batches(batches)
            name = f"_temporary-{self.job}-{context.partitionId()}-{context.taskAttemptId()}-{len(files)}"
            with fs.open_output_stream(f"{at}/{name}") as f:
                f.write(self._header(table.num_rows))
                f.write(self._rows(table))
            files.append((name, table.num_rows))

        rows = 0
        for batch in iterator:
            start = 0
            while start < batch.num_rows:
                part = batch.slice(start, self.rows_per_file - rows)
                held.append(part)
                rows, start = rows + part.num_rows, start + part.num_rows
                if rows == self.rows_per_file:
                    roll(held)
                    held, rows = [], 0
        if rows:
            roll(held)
        return Written(context.partitionId(), files)

    def commit(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        fs.create_dir(at, recursive=True)
        named = []
        for m in sorted((m for m in messages if m is not None), key=lambda m: m.partition):
            for k, (name, rows) in enumerate(m.files):
                final = f"part-{m.partition:06d}-{k:06d}.ply"
                fs.move(f"{at}/{name}", f"{at}/{final}")
                named.append([final, rows])
        with fs.open_output_stream(f"{at}/{MANIFEST}") as f:  # last: without it nothing is read
            f.write(json.dumps({"names": list(self.names), "files": named}).encode())

    def abort(self, messages: list[Written | None]) -> None:
        fs, at = _open(self.path)
        for m in messages:
            for name, _ in m.files if m is not None else ():
                fs.delete_file(f"{at}/{name}")


class PlySource(DataSource):
    """``spark.read.format("ply")`` of a binary file or a written folder, and ``df.write.format("ply")``.

    Options: ``path``, ``rowsPerTask`` and ``rowsPerFile``.  Paths and URIs are
    those that pyarrow's file systems open.
    """

    @classmethod
    def name(cls) -> str:
        return "ply"

    def _files(self) -> tuple[Header | None, list[tuple[str, int]], list[str]]:
        path = self.options["path"].rstrip("/")
        if path.endswith(".ply"):
            header = read_header(path)
            if not header.order:
                raise ValueError("this source reads binary PLY; read_ply reads both kinds")
            return header, [(path, header.count)], header.columns
        fs, at = _open(path)
        with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
            manifest = json.loads(f.read())
        files = [(f"{path}/{name}", n) for name, n in manifest["files"]]
        return read_header(files[0][0]) if files else None, files, manifest["names"]

    def schema(self) -> str:
        return ", ".join(["pid long", *[f"`{n}` double" for n in self._files()[2]]])

    def reader(self, schema) -> PlyReader:
        header, files, _ = self._files()
        return PlyReader(header, files, int(self.options.get("rowsPerTask", ROWS_PER_TASK)))

    def writer(self, schema, overwrite: bool) -> PlyWriter:
        return PlyWriter(self.options["path"], [f.name for f in schema], int(self.options.get("rowsPerFile", ROWS_PER_FILE)))


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """(line, value) of a text file, from 0 in the file's order, read in splits.

    Lines of a block follow each other in a task; the counts per block, one small
    row each, are summed up to the blocks' first numbers.
    """
    lines = spark.read.text(path).select("value", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"))
    before = Window.orderBy("b_block").rowsBetween(Window.unboundedPreceding, -1)  # one row per block
    counts = lines.groupBy(F.col("block").alias("b_block")).agg(F.count("*").alias("n"), F.min("id").alias("first_id"))
    starts = counts.withColumn("start", F.coalesce(F.sum("n").over(before), F.lit(0)))
    joined = lines.join(starts, F.col("block") == F.col("b_block"))
    return joined.select((F.col("start") + F.col("id") - F.col("first_id")).alias("line"), "value")


def read_ply(spark: SparkSession, path: str, rows_per_task: int = ROWS_PER_TASK) -> DataFrame:
    """Vertices of a PLY file, or of a folder of the sink: pid in the file's order, properties as doubles, colors in [0, 1] as r, g, b.

    A file is read in pieces by many tasks, ASCII or binary of either byte order.
    Elements behind the vertices are left out.  The header is read on the driver.
    """
    if not path.endswith(".ply"):
        header = None
    else:
        head = "\n".join(r.value for r in spark.read.text(path).limit(200).collect())
        header = parse_header(head.encode("ascii", "replace") + b"\n")
    if header is None or header.order:
        spark.dataSource.register(PlySource)
        return spark.read.format("ply").option("rowsPerTask", rows_per_task).load(path)
    first = head.split("\n").index(next(x for x in head.split("\n") if x.strip() == "end_header")) + 1 + header.before
    fields = F.split(F.trim("value"), r"\s+")

    def column(i: int, name: str) -> Column:
        v = F.get(fields, F.lit(i)).cast("double")
        return (v / 255 if name in COLORS else v).alias(COLORS.get(name, name))

    rows = numbered_lines(spark, path).where((F.col("line") >= first) & (F.col("line") < first + header.count))
    return rows.select((F.col("line") - first).cast("long").alias("pid"), *[column(i, n) for i, (n, _) in enumerate(header.properties)])


def write_ply(points: DataFrame, path: str, rows_per_file: int = ROWS_PER_FILE) -> None:
    """Coordinates, and normals and colors if there are any, of ``points`` as binary PLY files in a folder; ids are the order of rows."""
    names = [c for c in (*GEOMETRY, *COLORS.values()) if c in points.columns]
    points.sparkSession.dataSource.register(PlySource)
    points.select(*[F.col(c).cast("double").alias(c) for c in names]).write.format("ply").option("rowsPerFile", rows_per_file).mode("append").save(path)


def find_cloud(spark: SparkSession, root: str, path: str | None = None, debug_dir: str = "debug") -> str:
    """The explicit ``path``, else a merged cloud of the capture's debug folder, else its first PLY file by name.

    The folder is listed by the store that Spark reads it from; it is an error if there is none.
    """
    folder = f"{root.rstrip('/')}/{debug_dir}"
    for pattern in [path] if path else [*[f"{folder}/{n}" for n in CANDIDATES], f"{folder}/*.ply"]:
        if found := listed(spark, pattern):
            return found[0]
    raise FileNotFoundError(f"no clouds under {path or folder}")


def load_cloud(spark: SparkSession, root: str, path: str | None = None, debug_dir: str = "debug") -> DataFrame:
    """The cloud that ``find_cloud`` finds; an empty one is an error."""
    cloud = read_ply(spark, find_cloud(spark, root, path, debug_dir))
    if cloud.isEmpty():
        raise ValueError("the cloud is empty")
    return cloud
