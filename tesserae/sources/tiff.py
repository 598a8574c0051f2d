"""Tiled pyramids in TIFF and BigTIFF files, read by byte ranges: directories first, then the tiles that are asked for.

`Pyramid` is an opener for `regions.read_regions`; `tiles` reads a Spark data source with a row for each tile, planned in
super-tiles. Tiles are plain or deflated, with or without horizontal
differences, of 8 bits a sample; other compressions are refused by number. Paths go through pyarrow's file systems.
"""

from __future__ import annotations

import itertools
import struct
import zlib
from collections import OrderedDict
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.types import StructType

#: Tags of the format, codes of its number types, and its compressions.
WIDTH, HEIGHT, BITS, COMPRESSION, SAMPLES, PLANAR, PREDICTOR, TILE_WIDTH, TILE_HEIGHT, OFFSETS, COUNTS = 256, 257, 258, 259, 277, 284, 317, 322, 323, 324, 325
NUMBERS = {1: "B", 3: "H", 4: "I", 13: "I", 16: "Q"}
PLAIN, DEFLATE, OLD_DEFLATE = 1, 8, 32946
#: Decoded tiles that an open image keeps, and entries of a directory and directories of a file that are believed.
KEPT_TILES, MOST_ENTRIES, MOST_DIRECTORIES = 64, 4096, 4096


def opened(path: str):
    """A file that can be read at any place; paths with and without a scheme."""
    system, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    return system.open_input_file(name)


@dataclass
class Level:
    width: int
    height: int
    tile_width: int
    tile_height: int
    samples: int
    compression: int
    predictor: int
    offsets: tuple[int, ...]
    counts: tuple[int, ...]

    @property
    def across(self) -> int:
        return -(-self.width // self.tile_width)

    @property
    def down(self) -> int:
        return -(-self.height // self.tile_height)


def levels_of(f) -> list[Level]:
    """Tiled directories of a file, largest first. Others (labels, thumbnails in strips) are left out."""

    def take(at: int, n: int) -> bytes:
        f.seek(at)
        data = f.read(n)
        if len(data) != n:
            raise ValueError(f"the file ends within {n} bytes at {at}")
        return data

    start = take(0, 16)
    if start[:2] not in (b"II", b"MM"):
        raise ValueError("not a TIFF file")
    order = "<" if start[:2] == b"II" else ">"
    kind = struct.unpack(order + "H", start[2:4])[0]
    if kind not in (42, 43):
        raise ValueError(f"no such kind of TIFF file: {kind}")
    count, width, word = ("H", 12, "I") if kind == 42 else ("Q", 20, "Q")
    head, size = struct.calcsize(count), struct.calcsize(word)
    at = struct.unpack_from(order + word, start, 4 if kind == 42 else 8)[0]
    out, seen = [], set()
    while at:
        if at in seen or len(seen) >= MOST_DIRECTORIES:
            raise ValueError("directories run in a circle")
        seen.add(at)
        n = struct.unpack(order + count, take(at, head))[0]
        if n > MOST_ENTRIES:
            raise ValueError(f"a directory of {n} entries")
        block = take(at + head, n * width + size)
        tags: dict[int, tuple[int, ...]] = {}
        for i in range(n):
            tag, code, values = struct.unpack_from(order + "HH" + word, block, i * width)
            if code not in NUMBERS or not WIDTH <= tag <= COUNTS:
                continue
            form = f"{order}{values}{NUMBERS[code]}"
            long = struct.calcsize(form)
            where = i * width + 4 + size
            data = block[where : where + long] if long <= size else take(struct.unpack_from(order + word, block, where)[0], long)
            tags[tag] = struct.unpack(form, data)
        at = struct.unpack_from(order + word, block, n * width)[0]
        if TILE_WIDTH not in tags:
            continue
        one = lambda tag, default=None: tags.get(tag, (default,))[0]  # noqa: B023, E731
        level = Level(one(WIDTH), one(HEIGHT), one(TILE_WIDTH), one(TILE_HEIGHT), one(SAMPLES, 1), one(COMPRESSION, PLAIN), one(PREDICTOR, 1), tags[OFFSETS], tags[COUNTS])
        if set(tags.get(BITS, (1,))) != {8} or one(PLANAR, 1) != 1 or level.predictor not in (1, 2):
            raise ValueError("only samples of 8 bits that lie together are read")
        if not len(level.offsets) == len(level.counts) == level.across * level.down:
            raise ValueError(f"{len(level.offsets)} tiles, not {level.across * level.down}")
        out.append(level)
    return sorted(out, key=lambda v: -v.width)


class Pyramid:
    """An open image: `read(x, y, level, size)` gives a square of a level, x and y at level 0, white beyond the image."""

    def __init__(self, path: str):
        self.file = opened(path)
        self.levels = levels_of(self.file)
        if not self.levels:
            raise ValueError(f"{path} has no tiles")
        self.kept: OrderedDict[tuple[int, int], np.ndarray] = OrderedDict()

    def tile(self, level: int, number: int) -> np.ndarray:
        if (level, number) in self.kept:
            self.kept.move_to_end((level, number))
            return self.kept[level, number]
        v = self.levels[level]
        shape = v.tile_height, v.tile_width, v.samples
        if not v.counts[number]:
            out = np.full(shape, 255, np.uint8)  # a tile that was left out
        else:
            self.file.seek(v.offsets[number])
            data, size = self.file.read(v.counts[number]), shape[0] * shape[1] * shape[2]
            if v.compression in (DEFLATE, OLD_DEFLATE):
                data = zlib.decompressobj().decompress(data, size + 1)
            elif v.compression != PLAIN:
                raise ValueError(f"tiles of compression {v.compression} are not read")
            if len(data) != size:
                raise ValueError(f"a tile of {len(data)} bytes, not {size}")
            out = np.frombuffer(data, np.uint8).reshape(shape)
            if v.predictor == 2:
                out = np.cumsum(out, axis=1, dtype=np.uint8)
        self.kept[level, number] = out
        if len(self.kept) > KEPT_TILES:
            self.kept.popitem(last=False)
        return out

    def read(self, x: int, y: int, level: int, size: int) -> np.ndarray:
        if not 0 <= level < len(self.levels):
            raise ValueError(f"no level {level}, but {len(self.levels)} of them")
        v, whole = self.levels[level], self.levels[0]
        left, top = x * v.width // whole.width, y * v.height // whole.height
        out = np.full((size, size, v.samples), 255, np.uint8)
        x0, y0, x1, y1 = max(0, left), max(0, top), min(v.width, left + size), min(v.height, top + size)
        if x1 <= x0 or y1 <= y0:
            return out
        for r in range(y0 // v.tile_height, (y1 - 1) // v.tile_height + 1):
            for c in range(x0 // v.tile_width, (x1 - 1) // v.tile_width + 1):
                a, b = max(x0, c * v.tile_width), min(x1, (c + 1) * v.tile_width)
                d, e = max(y0, r * v.tile_height), min(y1, (r + 1) * v.tile_height)
                t = self.tile(level, r * v.across + c)
                out[d - top : e - top, a - left : b - left] = t[d - r * v.tile_height : e - r * v.tile_height, a - c * v.tile_width : b - c * v.tile_width]
        return out


def write_pyramid(path: str, levels: Sequence[np.ndarray], tile: int = 256, big: bool = False, order: str = "<", deflate: bool = True, predictor: int = 1) -> None:
    """Writes levels (height, width, samples) of 8 bits as tiled directories of one file."""
    system, name = fs.FileSystem.from_uri(path) if ":" in path else (fs.LocalFileSystem(), path)
    count, word = ("H", "I") if not big else ("Q", "Q")
    size = struct.calcsize(word)
    data = bytearray((b"II" if order == "<" else b"MM") + (struct.pack(order + "HI", 42, 0) if not big else struct.pack(order + "HHHQ", 43, 8, 0, 0)))
    link = len(data) - size
    for image in levels:
        height, width, samples = image.shape
        offsets, counts = [], []
        for y, x in itertools.product(range(0, height, tile), range(0, width, tile)):
            block = np.zeros((tile, tile, samples), np.uint8)
            part = image[y : y + tile, x : x + tile]
            block[: part.shape[0], : part.shape[1]] = part
            if predictor == 2:
                block[:, 1:] = block[:, 1:] - block[:, :-1]
            raw = zlib.compress(block.tobytes()) if deflate else block.tobytes()
            offsets.append(len(data))
            counts.append(len(raw))
            data += raw
        tags = [(WIDTH, [width]), (HEIGHT, [height]), (BITS, [8] * samples), (COMPRESSION, [DEFLATE if deflate else PLAIN]), (SAMPLES, [samples]), (PLANAR, [1]), (PREDICTOR, [predictor]), (TILE_WIDTH, [tile]), (TILE_HEIGHT, [tile]), (OFFSETS, offsets), (COUNTS, counts)]
        entries = b""
        for tag, values in tags:
            packed = struct.pack(f"{order}{len(values)}{word}", *values)
            if len(values) > 1:
                place, packed = len(data), packed
                data += packed
                packed = struct.pack(order + word, place)
            entries += struct.pack(order + "HH" + word, tag, 16 if big else 4, len(values)) + packed
        struct.pack_into(order + word, data, link, len(data))
        data += struct.pack(order + count, len(tags)) + entries
        link = len(data)
        data += bytes(size)
    with system.open_output_stream(name) as out:
        out.write(bytes(data))


SCHEMA = "image_path string, level int, tile_x int, tile_y int, x long, y long, width int, height int, channels int, pixels binary"


@dataclass
class SuperTile(InputPartition):
    """Tiles left to right and top to bottom (ends not included) of one level of one image."""

    path: str
    level: int
    left: int
    right: int
    top: int
    bottom: int

    def __post_init__(self) -> None:
        self.value = None


class TileReader(DataSourceReader):
    """Plans a partition for each super-tile that the options leave, and reads the tiles in it, and no others, by their byte ranges."""

    def __init__(self, options: dict) -> None:
        self.path, self.side = options["path"], int(options.get("supertile", 8))
        if self.side < 1:
            raise ValueError("a super-tile holds one tile at least")
        self.level = int(options["level"]) if "level" in options else None
        self.box = tuple(int(v) for v in options["box"].split(",")) if "box" in options else None

    def wanted(self, whole: Level, v: Level, place: dict) -> bool:
        """Whether a tile is of the level and meets the box (left, top, right, bottom at level 0, ends not included)."""
        if self.level not in (None, place["level"]):
            return False
        if self.box is None:
            return True
        left, top, right, bottom = self.box
        end = lambda c, tile, part, full: -(-(c + 1) * tile * full // part)
        return place["x"] < right and place["y"] < bottom and end(place["tile_x"], v.tile_width, v.width, whole.width) > left and end(place["tile_y"], v.tile_height, v.height, whole.height) > top

    def paths(self) -> list[str]:
        system, name = fs.FileSystem.from_uri(self.path) if ":" in self.path else (fs.LocalFileSystem(), self.path)
        prefix = self.path[: len(self.path) - len(name)] if self.path.endswith(name) else ""
        if system.get_file_info(name).type == fs.FileType.File:
            return [self.path]
        return sorted(prefix + i.path for i in system.get_file_info(fs.FileSelector(name)) if i.path.lower().endswith((".tif", ".tiff")))

    def places(self, levels: list[Level], part: SuperTile) -> Iterator[dict]:
        v, whole = levels[part.level], levels[0]
        for r, c in itertools.product(range(part.top, part.bottom), range(part.left, part.right)):
            place = {"level": part.level, "tile_x": c, "tile_y": r, "x": c * v.tile_width * whole.width // v.width, "y": r * v.tile_height * whole.height // v.height}
            if self.wanted(whole, v, place):
                yield place

    def partitions(self) -> list[SuperTile]:
        out = []
        for path in self.paths():
            with opened(path) as f:
                levels = levels_of(f)
            for n, v in enumerate(levels):
                for top, left in itertools.product(range(0, v.down, self.side), range(0, v.across, self.side)):
                    part = SuperTile(path, n, left, min(v.across, left + self.side), top, min(v.down, top + self.side))
                    if next(self.places(levels, part), None):
                        out.append(part)
        return out

    def read(self, part: SuperTile | None) -> Iterator[pa.RecordBatch]:
        if part is None:  # what Spark asks for where the plan is empty
            return
        image = Pyramid(part.path)
        v = image.levels[part.level]
        kinds = [pa.string(), *[pa.int32()] * 3, *[pa.int64()] * 2, *[pa.int32()] * 3, pa.binary()]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        for _, row in itertools.groupby(self.places(image.levels, part), lambda p: p["tile_y"]):
            rows = []
            for p in row:
                w, h = min(v.tile_width, v.width - p["tile_x"] * v.tile_width), min(v.tile_height, v.height - p["tile_y"] * v.tile_height)
                pixels = image.tile(part.level, p["tile_y"] * v.across + p["tile_x"])[:h, :w]
                rows.append((part.path, *p.values(), w, h, v.samples, pixels.tobytes()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names)


class Tiles(DataSource):
    """Tiles of an image, or of all images of a folder. See `tiles`."""

    @classmethod
    def name(cls) -> str:
        return "pyramid_tiles"

    def schema(self) -> str:
        return SCHEMA

    def reader(self, schema: StructType) -> TileReader:
        return TileReader(self.options)


def tiles(spark, path: str, level: int | None = None, box: tuple[int, int, int, int] | None = None, supertile: int = 8) -> DataFrame:
    """A row for each tile of an image, or of all images of a folder, planned in super-tiles of so many tiles a side.

    level, and box (left, top, right, bottom at level 0): tiles that meet them; what is left out is neither planned
    nor read. These are arguments, not pushed filters: Spark 4.1 keeps the plan of a Python source with the table, so
    two scans of one table with different filters would both get the filters pushed last.
    """
    spark.dataSource.register(Tiles)
    more = {"level": level, "box": None if box is None else ",".join(map(str, box))}
    return spark.read.format("pyramid_tiles").options(supertile=supertile, **{k: v for k, v in more.items() if v is not None}).load(path)
