"""Event logs as files of JSON lines, one file for each writer: a source that follows them, and a sink.

The source keeps a byte offset for each file, so a file that grows is read on from where it was. A last line that is
still being written waits for its end; a whole line that is no event is an error, which names the file and the byte.
"""

from __future__ import annotations

import json
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, DataSourceStreamArrowWriter, DataSourceStreamReader, InputPartition, WriterCommitMessage
from pyspark.sql.types import StructType

SCHEMA = "kind string, payload map<string,string>, timestamp double"
#: Bytes that are looked at in one step when the end of the last whole line is sought, and bytes of a file that one task reads, about.
STEP, PART = 1 << 16, 64 << 20


def system(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)


def is_event(line: bytes) -> bool:
    try:
        return isinstance(json.loads(line), dict)
    except ValueError:
        return False


def files_of(path: str) -> dict[str, int]:
    """A log and its files by rank (`name.rank*.ext` beside `name.ext`), with their sizes."""
    where, name = system(path)
    folder, _, last = name.rpartition("/")
    stem, dot, ext = last.rpartition(".")
    stem, ext = (stem, dot + ext) if dot else (ext, "")
    found = where.get_file_info(fs.FileSelector(folder or ".", allow_not_found=True))
    return {i.path: i.size for i in found if i.type == fs.FileType.File and (i.base_name == last or i.base_name.startswith(f"{stem}.rank") and i.base_name.endswith(ext))}


def end_of_lines(where: fs.FileSystem, name: str, start: int, size: int) -> int:
    """The end of the last whole line between start and size; what follows it counts too if it is an event by itself."""
    with where.open_input_file(name) as f:
        at, tail = size, b""
        while at > start and b"\n" not in tail:
            step = min(STEP, at - start)
            at -= step
            f.seek(at)
            tail = f.read(step) + tail
    rest = tail.rpartition(b"\n")[2]
    return size if rest.strip() and is_event(rest) else size - len(rest)


@dataclass
class Bytes(InputPartition):
    """Lines of a file that begin from start on, before end."""

    name: str
    start: int
    end: int

    def __post_init__(self) -> None:
        self.value = None


def parts_of(name: str, start: int, end: int) -> list[Bytes]:
    return [Bytes(name, a, min(end, a + PART)) for a in range(start, end, PART)]


def lines_of(path: str, part: Bytes, start: int, end: int) -> Iterator[tuple[int, bytes]]:
    """Lines, with their places, that begin in a part of the bytes start to end; the last one is read beyond the part."""
    where, _ = system(path)
    with where.open_input_file(part.name) as f:
        # A line that began in the part before is that part's: it ends with the first newline from the byte before on.
        skip = part.start > start
        at = read = part.start - skip
        f.seek(at)
        held, begin = b"", 0
        while at < part.end:
            cut = held.find(b"\n", begin) + 1
            while not cut and read < end:
                more = f.read(min(STEP, end - read))
                if not more:
                    raise ValueError(f"{part.name} has {read} bytes, not {end}")
                held, begin = held[begin:], 0
                before, read = len(held), read + len(more)
                held += more
                cut = held.find(b"\n", before) + 1
            line = held[begin : cut or len(held)]
            if not skip:
                yield at, line
            skip, at, begin = False, at + len(line), begin + len(line)


def event(line: bytes, name: str, at: int) -> tuple | None:
    """kind, payload as texts, timestamp; None for a blank line."""
    if not line.strip():
        return None
    try:
        e = json.loads(line)
        payload = {k: v if isinstance(v, str) or v is None else json.dumps(v) for k, v in e.get("payload", {}).items()}
        return e["kind"], payload, None if e.get("timestamp") is None else float(e["timestamp"])
    except (ValueError, KeyError, AttributeError, TypeError) as x:
        raise ValueError(f"{name}, byte {at}: not an event ({x})") from x


class Follower(DataSourceStreamReader):
    """Offsets: bytes read, by file. Files that shrink, or go, are an error of whoever does that, and give nothing more."""

    def __init__(self, path: str) -> None:
        self.path = path
        self.ends: dict[str, int] = {}

    def initialOffset(self) -> dict:  # noqa: N802
        return {}

    def latestOffset(self) -> dict:  # noqa: N802
        where, _ = system(self.path)
        for name, size in files_of(self.path).items():
            if size > self.ends.get(name, 0):
                self.ends[name] = end_of_lines(where, name, self.ends.get(name, 0), size)
        return dict(self.ends)

    def partitions(self, start: dict, end: dict) -> list[InputPartition]:
        return [Range(p.name, p.start, p.end, start.get(name, 0), to) for name, to in sorted(end.items()) if to > start.get(name, 0) for p in parts_of(name, start.get(name, 0), to)]

    def read(self, part: Range | None) -> Iterator[tuple]:
        for at, line in lines_of(self.path, part, part.first, part.last) if part else ():
            if (e := event(line, part.name, at)) is not None:
                yield e


@dataclass
class Range(Bytes):
    """A part of the bytes first to last."""

    first: int = 0
    last: int = 0


class Whole(DataSourceReader):
    """What is there now."""

    def __init__(self, path: str) -> None:
        self.follower = Follower(path)

    def partitions(self) -> list[InputPartition]:
        return self.follower.partitions({}, self.follower.latestOffset())

    def read(self, part: Range | None) -> Iterator[tuple]:
        return self.follower.read(part)


@dataclass
class Written(WriterCommitMessage):
    name: str | None


class Sink(DataSourceArrowWriter):
    """Each task writes a file beside the log under a name that readers pass over; the commit gives them names by rank, from the first that is free."""

    def __init__(self, path: str, label: str | None = None) -> None:
        self.path, self.label = path, label

    def ranked(self, rank: str) -> str:
        _, name = system(self.path)
        folder, _, last = name.rpartition("/")
        stem, dot, ext = last.rpartition(".")
        return f"{folder}/{stem}.rank{rank}.{ext}" if dot else f"{folder}/{ext}.rank{rank}"

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        where, name = system(self.path)
        folder, _, last = name.rpartition("/")
        batches = (b for b in batches if b.num_rows)
        first = next(batches, None)
        if first is None:
            return Written(None)
        made = f"{folder}/.{last}.{uuid.uuid4().hex}"
        encode = json.JSONEncoder(sort_keys=True).encode
        with where.open_output_stream(made) as out:
            while first is not None:
                lines = []
                for kind, entries, timestamp in zip(*(first.column(c).to_pylist() for c in ("kind", "payload", "timestamp"))):
                    payload = dict(entries or ())
                    if self.label is not None:
                        payload.setdefault("progress_label", self.label)
                    lines.append(encode({"kind": kind, "payload": payload, "timestamp": timestamp}) + "\n")
                out.write("".join(lines).encode())
                first = next(batches, None)
        return Written(made)

    def commit(self, messages: list[Written | None]) -> None:
        where, _ = system(self.path)
        taken, rank = set(files_of(self.path)), 0
        for m in messages:
            if m and m.name:
                while self.ranked(str(rank)) in taken:
                    rank += 1
                where.move(m.name, self.ranked(str(rank)))
                taken.add(self.ranked(str(rank)))

    def abort(self, messages: list[Written | None]) -> None:
        where, _ = system(self.path)
        for m in messages:
            if m and m.name:
                where.delete_file(m.name)


class StreamSink(DataSourceStreamArrowWriter):
    """As Sink, with the number of the batch in the names, so that a batch that is repeated replaces its own files."""

    def __init__(self, path: str, label: str | None = None) -> None:
        self.sink = Sink(path, label)

    def write(self, batches: Iterator[pa.RecordBatch]) -> Written:
        return self.sink.write(batches)

    def commit(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        where, _ = system(self.sink.path)
        for k, m in enumerate(m for m in messages if m and m.name):
            where.move(m.name, self.sink.ranked(f"{batchId}-{k}"))

    def abort(self, messages: list[Written | None], batchId: int) -> None:  # noqa: N803
        self.sink.abort(messages)


class EventLog(DataSource):
    """Source and sink of a log at `path`, with its files by rank; option label: written as progress_label into events without one."""

    @classmethod
    def name(cls) -> str:
        return "event_log"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> Whole:
        return Whole(self.options["path"])

    def streamReader(self, schema: StructType) -> Follower:  # noqa: N802
        return Follower(self.options["path"])

    def writer(self, schema: StructType, overwrite: bool) -> Sink:
        if overwrite:
            raise ValueError("logs are appended to")
        return Sink(self.options["path"], self.options.get("label"))

    def streamWriter(self, schema: StructType, overwrite: bool) -> StreamSink:  # noqa: N802
        return StreamSink(self.options["path"], self.options.get("label"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """All whole events of a log that are there now."""
    spark.dataSource.register(EventLog)
    return spark.read.format("event_log").load(path)


def follow(spark: SparkSession, path: str) -> DataFrame:
    """The events of a log as a stream."""
    spark.dataSource.register(EventLog)
    return spark.readStream.format("event_log").load(path)


def write(events: DataFrame, path: str, label: str | None = None) -> None:
    """Appends events (kind, payload, timestamp) to a log whose folder exists, a file for each task that has any."""
    events.sparkSession.dataSource.register(EventLog)
    w = events.select("kind", "payload", "timestamp").write.format("event_log").mode("append")
    (w if label is None else w.option("label", label)).save(path)
