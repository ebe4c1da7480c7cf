"""Annotated sequence files as a Spark data source: spark.dataSource.register(GenBankFiles), then spark.read.format("genbank").load(folder), or readStream.

Folders are those that pyarrow's file systems reach (mounted ones, object stores, HDFS with its library). For any other store,
genbank.read_files() goes through Spark's own reader.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, EqualTo, Filter, In, InputPartition, Not, StringContains, StringEndsWith, StringStartsWith
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import StructType

from clusterlake.sources import genbank

#: Bytes of the files of a partition, unless one file has more; a file counts as so many at least.
PARTITION_BYTES, FILE_BYTES = 64 << 20, 256 << 10
ROWS = 20


@dataclass
class Files(InputPartition):
    """Files (path, bytes) that one task reads."""

    files: tuple[tuple[str, int], ...]


def file_system(folder: str):
    from pyarrow import fs

    return fs.FileSystem.from_uri(folder) if "://" in folder or folder.startswith("file:") else (fs.LocalFileSystem(), folder)


class _Names:
    """The files of a folder whose names and paths pass: (path, bytes, time in nanoseconds), sorted by time."""

    def __init__(self, options: dict, schema: StructType):
        self.folder = options["path"]
        self.include = [x for x in options.get("include", "cluster,region").split(",") if x]
        self.exclude = [x for x in options.get("exclude", "final").split(",") if x]
        self.recursive = options.get("recursive", "true").lower() == "true"
        self.force = options.get("force", "false").lower() == "true"
        self.limit = int(options.get("partitionbytes", PARTITION_BYTES))
        self.filters: list[Filter] = []
        self.arrow = to_arrow_schema(schema)

    def passes(self, path: str) -> bool:
        name = path.rsplit("/", 1)[-1]
        if not name.endswith(".gbk"):
            return False
        if self.include[:1] != ["*"] and (any(x in name for x in self.exclude) or not any(x in name for x in self.include)):
            return False
        return all(holds(f, path) for f in self.filters if column(f) == "path")

    def listed(self) -> list[tuple[str, int, int]]:
        from pyarrow import fs

        system, top = file_system(self.folder)
        found = system.get_file_info(fs.FileSelector(top, recursive=self.recursive))
        return sorted(((f.path, f.size, f.mtime_ns or 0) for f in found if f.type == fs.FileType.File and self.passes(f.path)), key=lambda x: (x[2], x[0]))

    def dealt(self, files: list[tuple[str, int, int]]) -> list[Files]:
        """Partitions of about equal bytes. Files of one size go together, as far as a partition holds them: copies have one size, so that they meet."""
        out: list[list[tuple[str, int]]] = [[]]
        held = 0
        for path, size, _ in sorted(files, key=lambda x: (x[1], x[0])):
            if out[-1] and held + max(size, FILE_BYTES) > self.limit:
                out.append([])
                held = 0
            out[-1].append((path, size))
            held += max(size, FILE_BYTES)
        return [Files(tuple(x)) for x in out if x]

    def rows(self, files: tuple[tuple[str, int], ...]) -> Iterator[pa.RecordBatch]:
        """Parsed files in batches; contents are hashed first, and of equal ones only the least path is parsed. Files whose version isn't wanted are not parsed either."""
        system, _ = file_system(self.folder)
        seen: set[bytes] = set()
        held: list[dict] = []
        wanted = [f for f in self.filters if column(f) == "version"]
        for path, _ in files:  # of one size, in the order of paths
            with system.open_input_stream(path) as f:
                content = f.read()
            key = hashlib.sha256(content).digest()
            if key in seen:
                continue
            seen.add(key)
            if wanted and not all(holds(f, version(content)) for f in wanted):
                continue
            held.append(genbank.parse_file(path, content, self.force))
            if len(held) >= ROWS:
                yield pa.RecordBatch.from_pylist(held, schema=self.arrow)
                held = []
        if held:
            yield pa.RecordBatch.from_pylist(held, schema=self.arrow)


def column(f: Filter) -> str | None:
    own = f.child if isinstance(f, Not) else f
    return own.attribute[0] if len(own.attribute) == 1 else None


def holds(f: Filter, value: str | None) -> bool:
    if isinstance(f, Not):
        return value is not None and not holds(f.child, value)
    if value is None:
        return False
    if isinstance(f, EqualTo):
        return value == f.value
    if isinstance(f, In):
        return value in f.value
    if isinstance(f, StringContains):
        return f.value in value
    if isinstance(f, StringStartsWith):
        return value.startswith(f.value)
    return value.endswith(f.value)


def version(content: bytes) -> str | None:
    """The version of a file by its comment, which is before the features; None if there is none, as parse_file has it for what is no such file."""
    head = content.split(b"\nFEATURES", 1)[0].decode("utf-8", "replace")
    comment = re.search(r"(?ms)^COMMENT(.*?)(?=^\S|\Z)", head)
    return genbank.version_of("\n".join(x.strip() for x in comment[1].splitlines()) if comment else "")


class Reader(DataSourceReader):
    def __init__(self, options: dict, schema: StructType):
        self.names = _Names(options, schema)

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        """Takes filters on names, which are tested before contents are read, and on the version, before they are parsed; leaves the others to Spark."""
        for f in filters:
            own = f.child if isinstance(f, Not) else f
            text = isinstance(own, StringContains | StringStartsWith | StringEndsWith) or isinstance(own, EqualTo) and isinstance(own.value, str) or isinstance(own, In)
            if text and column(f) in ("path", "version"):
                self.names.filters.append(f)
            else:
                yield f

    def partitions(self) -> list[Files]:
        return self.names.dealt(self.names.listed()) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.names.rows(partition.files)


class StreamReader(DataSourceStreamReader):
    """New files by time and path. A file has to appear whole, with the time at which it does, as a move does; one that gets an earlier time than files already read is not seen."""

    def __init__(self, options: dict, schema: StructType):
        self.names = _Names(options, schema)

    def initialOffset(self) -> dict:
        return {"time": -1, "path": ""}

    def latestOffset(self) -> dict:
        found = self.names.listed()
        return {"time": found[-1][2], "path": found[-1][0]} if found else self.initialOffset()

    def partitions(self, start: dict, end: dict) -> list[Files]:
        key = lambda o: (o["time"], o["path"])
        return self.names.dealt([f for f in self.names.listed() if key(start) < (f[2], f[0]) <= key(end)]) or [Files(())]

    def read(self, partition: Files) -> Iterator[pa.RecordBatch]:
        return self.names.rows(partition.files)

    def commit(self, end: dict) -> None:
        """Offsets are Spark's to keep."""


class GenBankFiles(DataSource):
    """Options: path; include and exclude, substrings of names with commas ("*" to include keeps all); recursive; force, to read files without a region as one; partitionBytes."""

    @classmethod
    def name(cls) -> str:
        return "genbank"

    def schema(self) -> str:
        return genbank.SCHEMA

    def reader(self, schema: StructType) -> Reader:
        return Reader(self.options, schema)

    def streamReader(self, schema: StructType) -> StreamReader:
        return StreamReader(self.options, schema)


def read(spark: SparkSession, folder: str, where: str | None = None, **options: str) -> DataFrame:
    """Parsed files of a folder by the data source, of equal contents the least path. where: a condition on path or version, which is pushed into the source. Copies within a task are dropped there; what copies are left, of files of one size that a partition doesn't hold, by their hash."""
    spark.dataSource.register(GenBankFiles)
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    df = spark.read.format("genbank").options(**options).load(folder)
    df = df.where(where) if where else df
    names = df.columns
    return df.groupBy("hash").agg(F.min(F.struct("path", *(c for c in names if c not in ("path", "hash")))).alias("x")).select("hash", "x.*").select(*names)
