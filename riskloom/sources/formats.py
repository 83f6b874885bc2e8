"""Data sources for logs, by spark.read.format(...): commit logs, blame in porcelain form, event logs (also as streams).

Files are cut into byte ranges, each a task; a range owns the records that begin in it and reads on to the end of its last one.
Files are reached through Arrow's file systems (local, HDFS and object stores), path being a file or a folder. Options: splitBytes.

    register(spark)
    spark.read.format("riskloom_commits").load(path)   # raw records, for readers.parse_commits
    spark.read.format("riskloom_blame").load(path)     # sha, path, line, and author and time where the log tells them
    spark.read.format("riskloom_events").schema(...).load(path)
    spark.readStream.format("riskloom_events").schema(...).load(path)

A broken line of an event log is an error that says where; only the last line of a file may be torn (no line end, no JSON). A
batch read drops it, a stream takes it once it is whole: offsets are the bytes of each file up to its last line end, so that a
stream that is stopped and started again gives each event once.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator
from dataclasses import dataclass

from pyarrow import fs as arrow_fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition
from pyspark.sql.types import ArrayType, BooleanType, DoubleType, FloatType, IntegerType, LongType, ShortType, StringType, StructType

from riskloom.schemas import schema as named
from riskloom.session import importable
from riskloom.sources.readers import FIELD, RECORD

SPLIT, CHUNK = 64 << 20, 1 << 20
#: Commit, line before, line now and perhaps the lines of its group.
_HEAD = re.compile(rb"([0-9a-f]{40}) [0-9]+ ([0-9]+)(?: [0-9]+)?")


@dataclass
class Range(InputPartition):
    """The records of a file that begin at start or later and before end."""

    path: str
    start: int
    end: int


def _open(path: str) -> tuple[arrow_fs.FileSystem, str]:
    return arrow_fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:/") else f"file://{path}")


def files(path: str) -> list[tuple[str, int]]:
    """(path, bytes) of the files at a path, hidden ones left out."""
    store, name = _open(path)
    info = store.get_file_info(name)
    found = [info] if info.type == arrow_fs.FileType.File else store.get_file_info(arrow_fs.FileSelector(name, recursive=True, allow_not_found=True))
    scheme = path.split("://")[0] + "://" if "://" in path else ""
    host = path.split("://", 1)[1].split("/", 1)[0] if scheme not in ("", "file://") and store.type_name == "hdfs" else ""
    kept = [f for f in found if f.type == arrow_fs.FileType.File and not f.base_name.startswith(("_", "."))]
    return sorted((f"{scheme}{host}{f.path}", f.size) for f in kept)


def ranges(path: str, size: int) -> list[Range]:
    return [Range(f, at, min(at + size, n)) for f, n in files(path) for at in range(0, n, size)]


def records(part: Range, mark: bytes) -> Iterator[tuple[int, bytes, bool]]:
    """(offset, record without its mark, whether the mark was there) of the records of a range, which end with a mark of one byte."""
    store, name = _open(part.path)
    with store.open_input_file(name) as f:
        at = max(part.start - 1, 0)  # the byte before tells whether a record begins at start
        f.seek(at)
        held, skip = b"", part.start > 0
        while True:
            chunk = f.read(CHUNK)
            held += chunk
            while (cut := held.find(mark)) >= 0:
                if not skip:
                    yield at, held[:cut], True
                skip, at, held = False, at + cut + 1, held[cut + 1 :]
                if at >= part.end:
                    return
            if not chunk:
                if held and not skip:
                    yield at, held, False
                return


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.path, self.size = options["path"], int(options.get("splitBytes", SPLIT))

    def partitions(self) -> list[Range]:
        return ranges(self.path, self.size) or [Range("", 0, 0)]


class _Commits(_Reader):
    def read(self, partition: Range) -> Iterator[tuple]:
        if partition.path:
            for _, record, _ in records(partition, RECORD.encode()):
                if FIELD.encode() in record:
                    yield (record.decode("utf-8", "replace").strip("\n"),)


class CommitSource(DataSource):
    """value: the records of a commit log (see readers.commit_log)."""

    @classmethod
    def name(cls) -> str:
        return "riskloom_commits"

    def schema(self) -> str:
        return "value string"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Commits(self.options)


class _Blame(_Reader):
    def read(self, partition: Range) -> Iterator[tuple]:
        if not partition.path:
            return
        entry: dict = {}
        # an entry begins with its commit and lines; one that begins in the range is read to its line of text, which alone begins with a tab
        for at, raw, _ in records(Range(partition.path, partition.start, 1 << 62), b"\n"):
            if raw.startswith(b"\t"):
                if entry:
                    yield tuple(entry.get(c) for c in ("sha", "path", "line", "author", "author_time"))
                entry = {}
                continue
            if head := _HEAD.fullmatch(raw):
                if at >= partition.end:
                    return
                entry = {"sha": head[1].decode(), "line": int(head[2])}
            elif entry:
                word, _, rest = raw.decode("utf-8", "replace").partition(" ")
                if word == "author-time":
                    entry["author_time"] = int(rest)
                elif word in ("author", "filename"):
                    entry["path" if word == "filename" else word] = rest


class BlameSource(DataSource):
    """sha, path, line, author, author_time of each line of a blame in porcelain form; the last three where the entry has them."""

    @classmethod
    def name(cls) -> str:
        return "riskloom_blame"

    def schema(self) -> str:
        return "sha string, path string, line long, author string, author_time long"

    def reader(self, schema: StructType) -> DataSourceReader:
        return _Blame(self.options)


def blame_lines(spark: SparkSession, path: str, **options: str) -> DataFrame:
    """sha, line, path, author, author_time of a porcelain log in which the first entry of a commit alone tells the latter three."""
    register(spark)
    rows = spark.read.format("riskloom_blame").options(**options).load(path)
    told = rows.groupBy("sha").agg(*(F.max(c).alias(c) for c in ("path", "author", "author_time")))
    return rows.select("sha", "line").join(told, "sha").select("sha", "line", "path", "author", "author_time")


def _typed(kind, value):
    """A JSON value as a column's type wants it; what does not fit raises."""
    if value is None:
        return None
    if isinstance(kind, StringType):
        return value if isinstance(value, str) else json.dumps(value, ensure_ascii=False)
    if isinstance(kind, (LongType, IntegerType, ShortType)) and isinstance(value, int) and not isinstance(value, bool):
        return value
    if isinstance(kind, (DoubleType, FloatType)) and isinstance(value, (int, float)) and not isinstance(value, bool):
        return float(value)
    if isinstance(kind, BooleanType) and isinstance(value, bool):
        return value
    if isinstance(kind, ArrayType) and isinstance(value, list):
        return [_typed(kind.elementType, x) for x in value]
    raise ValueError(f"{value!r} is no {kind.simpleString()}")


def _event(raw: bytes, wanted: StructType) -> tuple:
    row = json.loads(raw)
    if not isinstance(row, dict):
        raise ValueError("no object")
    return tuple(_typed(f.dataType, row.get(f.name)) for f in wanted)


def _events(part: Range, wanted: StructType) -> Iterator[tuple]:
    for at, raw, ended in records(part, b"\n") if part.path else ():
        if not raw.strip():
            continue
        try:
            row = _event(raw, wanted)
        except ValueError as e:
            if ended:
                raise ValueError(f"{part.path}, byte {at}: broken event: {e}") from e
            continue  # torn: whoever wrote it stopped in the middle
        yield row


class _EventReader(_Reader):
    def __init__(self, options: dict, wanted: StructType) -> None:
        super().__init__(options)
        self.wanted = wanted

    def read(self, partition: Range) -> Iterator[tuple]:
        return _events(partition, self.wanted)


class _EventStream(DataSourceStreamReader):
    """Offsets: {"<file>": bytes up to the last line end}."""

    def __init__(self, options: dict, wanted: StructType) -> None:
        self.path, self.size, self.wanted = options["path"], int(options.get("splitBytes", SPLIT)), wanted

    def initialOffset(self) -> dict:
        return {}

    def latestOffset(self) -> dict:
        return {f: n for f, size in files(self.path) if (n := _whole(f, size))}

    def partitions(self, start: dict, end: dict) -> list[Range]:
        return [Range(f, at, min(at + self.size, n)) for f, n in sorted(end.items()) for at in range(start.get(f, 0), n, self.size)]

    def read(self, partition: Range) -> Iterator[tuple]:
        return _events(partition, self.wanted)

    def commit(self, end: dict) -> None:
        pass


def _whole(path: str, size: int) -> int:
    """Bytes up to the last line end of a file."""
    store, name = _open(path)
    with store.open_input_file(name) as f:
        end = size
        while end > 0:
            start = max(end - CHUNK, 0)
            f.seek(start)
            if (cut := f.read(end - start).rfind(b"\n")) >= 0:
                return start + cut + 1
            end = start
    return 0


class EventSource(DataSource):
    """The events of JSON lines, in the columns of the schema given; without one in those of the warehouse's event log."""

    @classmethod
    def name(cls) -> str:
        return "riskloom_events"

    def schema(self) -> StructType:
        return named("events")

    def reader(self, schema: StructType) -> DataSourceReader:
        return _EventReader(self.options, schema)

    def streamReader(self, schema: StructType) -> DataSourceStreamReader:
        return _EventStream(self.options, schema)


def register(spark: SparkSession) -> None:
    """Makes the formats known to a session."""
    importable(spark)
    for source in (CommitSource, BlameSource, EventSource):
        spark.dataSource.register(source)
