"""Tar stores of tiles: an index of members by seeking from header to header, then reads of the wanted members' bytes.

No archive is read as a whole, so its size has no bound; a task holds the index of one archive, or one tile's bytes.
"""

from __future__ import annotations

import time
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.expressions import path_stem
from tesserae.sources.arrays import files
from tesserae.sources.tiff import opened

#: Fixed values of the format: bytes of a block, and types of members.
BLOCK = 512
REGULAR, LONG_NAME, LONG_LINK, EXTENDED, GLOBAL, SPARSE = (b"0", b"\0", b"7"), b"L", b"K", b"x", b"g", b"S"
KINDS = pa.string(), pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64()
INDEX = "sample_id string, path string, tile_index long, name string, start long, size long"
#: Bytes of tiles that are dealt out together, so that a task opens an archive for many of them; most bytes of a name or an extended header.
GROUP, MOST_META = 64 << 20, 1 << 24


def number(field: bytes) -> int:
    """Octal digits, or big-endian bytes after a set first bit."""
    if field[0] & 0x80:
        return int.from_bytes(field[1:], "big")
    return int(field.split(b"\0")[0].strip() or b"0", 8)


def extended(data: bytes) -> dict[str, str]:
    """Records `length key=value` of an extended header."""
    out = {}
    while data.strip(b"\0"):
        size = int(data.split(b" ", 1)[0])
        key, _, value = data[:size].split(b" ", 1)[1].rstrip(b"\n").partition(b"=")
        out[key.decode()] = value.decode("utf-8", "surrogateescape")
        data = data[size:]
    return out


def members(f) -> Iterator[tuple[str, int, int]]:
    """Name, first byte and size of each regular file in an archive, in its order. Only headers are read."""
    at, name, more, always = 0, None, {}, {}
    while True:
        f.seek(at)
        head = f.read(BLOCK)
        if not head.strip(b"\0"):
            return
        if len(head) < BLOCK:
            raise ValueError(f"the archive ends in a header at {at}")
        if number(head[148:156]) not in (sum(head[:148]) + 256 + sum(head[156:]),):
            raise ValueError(f"a damaged header at {at}")
        kind, size = head[156:157], number(head[124:136])
        if kind in (LONG_NAME, EXTENDED, GLOBAL):
            if size > MOST_META:
                raise ValueError(f"a name of {size} bytes at {at}")
            data = f.read(size)
            if kind == LONG_NAME:
                name = data.split(b"\0")[0].decode("utf-8", "surrogateescape")
            elif kind == EXTENDED:
                more = extended(data)
            else:
                always |= extended(data)
        elif kind == SPARSE:
            raise ValueError(f"a sparse member at {at}")
        else:
            said = always | more
            size = int(said.get("size", size))
            if kind in REGULAR:
                plain = head[:100].split(b"\0")[0].decode("utf-8", "surrogateescape")
                prefix = head[345:500].split(b"\0")[0].decode("utf-8", "surrogateescape") if head[257:263] == b"ustar\0" else ""
                called = said.get("path") or name or (f"{prefix}/{plain}" if prefix else plain)
                if not called.endswith("/"):
                    yield called, at + BLOCK, size
            name, more = (name, more) if kind == LONG_LINK else (None, {})
        # Links, folders and devices have no bytes, whatever size they tell.
        at += BLOCK + (-(-size // BLOCK) * BLOCK if kind not in (b"1", b"2", b"3", b"4", b"5", b"6") else 0)


def index(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.tar") -> DataFrame:
    """A row for each member: sample_id (the archive's stem), path, tile_index (place by name; of a name that repeats, by place in the archive), name, start and size."""

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, at in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                with opened(at) as f:
                    found = sorted(members(f))
                columns = [[stem] * len(found), [at] * len(found), range(len(found)), *([m[k] for m in found] for k in range(3))]
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, KINDS)], [c.split()[0] for c in INDEX.split(", ")])

    stem = F.regexp_replace(path_stem("path"), r"\.tiles$", "")
    return files(spark, path, pattern).select(stem.alias("sample_id"), "path").mapInArrow(walk, INDEX)


def contents(found: DataFrame, timings: bool = False) -> DataFrame:
    """Adds the content of indexed members, read by their byte ranges; with timings also open_ms (at the first member of an archive in a task) and read_ms.

    Members are dealt by archive and stretch of bytes and read in order. Bytes that end early are an error.
    """
    dealt = found.withColumn("_g", F.floor(F.col("start") / GROUP)).repartition("path", "_g").sortWithinPartitions("path", "start").drop("_g")

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, f = None, None
        for b in batches:
            for i, (at, start, size) in enumerate(zip(*(b.column(b.schema.get_field_index(c)).to_pylist() for c in ("path", "start", "size")))):
                began = time.perf_counter()
                if fresh := at != path:
                    if f is not None:
                        f.close()
                    path, f = at, opened(at)
                ready = time.perf_counter()
                f.seek(start)
                data = f.read(size)
                if len(data) != size:
                    raise ValueError(f"{path} has {len(data)} of {size} bytes at {start}")
                spent = [pa.array([(ready - began) * 1000 if fresh else 0.0]), pa.array([(time.perf_counter() - ready) * 1000])] if timings else []
                yield pa.RecordBatch.from_arrays([*b.slice(i, 1).columns, pa.array([data], pa.binary()), *spent], names)

    names = [*found.columns, "content", *(["open_ms", "read_ms"] if timings else [])]
    return dealt.mapInArrow(read, f"{', '.join(f'`{n}` {t}' for n, t in found.dtypes)}, content binary" + (", open_ms double, read_ms double" if timings else ""))


def tiles(spark: SparkSession, path: str | Sequence[str], wanted: DataFrame | None = None, pattern: str = "*.tar", timings: bool = False) -> DataFrame:
    """sample_id, tile_index, name and content of all members, or of those wanted (sample_id, tile_index); one that isn't there is an error."""
    found = index(spark, path, pattern)
    if wanted is not None:
        found = wanted.select("sample_id", "tile_index").distinct().join(found, ["sample_id", "tile_index"], "left")
        lost = F.raise_error(F.concat(F.lit("no tile "), F.col("tile_index").cast("string"), F.lit(" of "), F.col("sample_id")))
        found = found.withColumn("path", F.when(F.col("path").isNull(), lost.cast("string")).otherwise(F.col("path")))
    return contents(found, timings).drop("path", "start", "size")
