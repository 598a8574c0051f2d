"""Reads of squares from large images through a plugged-in opener, coalesced to super-tiles.

An opener turns a path into an object with `read(x, y, level, size)`, which gives an array (size, size, channels),
x and y at level 0, white beyond the image. Which library stands behind it is the opener's matter; it is chosen by
`backend` (see OPENERS) and runs on executors, so what it captures must pickle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.sources.arrays import decode_any
from tesserae.sources.tiff import Pyramid

#: Bytes of pixels that a task holds before it sends them, about.
SENT_BYTES = 16 << 20


class Raster:
    """An image without a pyramid, decoded as a whole: it must fit in a task's memory. Reads paths that executors see as files."""

    def __init__(self, path: str):
        with open(path.removeprefix("file:"), "rb") as f:
            self.pixels = decode_any(f.read())

    def read(self, x: int, y: int, level: int, size: int) -> np.ndarray:
        if level:
            raise ValueError("a raster has level 0 only")
        height, width, channels = self.pixels.shape
        out = np.full((size, size, channels), 255, np.uint8)
        left, top, right, bottom = max(0, x), max(0, y), min(width, x + size), min(height, y + size)
        if right > left and bottom > top:
            out[top - y : bottom - y, left - x : right - x] = self.pixels[top:bottom, left:right]
        return out


#: Openers by backend; libraries for other pyramids are added by the user.
OPENERS: dict[str, Callable[[str], object]] = {"pil": Raster, "tiff": Pyramid}


def opener(backend: str) -> Callable[[str], object]:
    if backend not in OPENERS:
        raise ValueError(f"no opener for {backend}, but for {sorted(OPENERS)}")
    return OPENERS[backend]


def read_regions(requests: DataFrame, open_image: Callable[[str], object], supertile: int = 1, downsample: str | None = None, budget: int = SENT_BYTES) -> DataFrame:
    """Adds pixels, height and width to requests (image_path, x, y, level, read_px, and any others).

    Requests are dealt by image and super-tile (supertile x supertile reads), so one large image is spread over tasks, and sorted,
    so a task opens an image once. The number of tasks is that of shuffle partitions: Spark would put requests, which are
    small beside what is read for them, into few tasks. Requests of a super-tile at one level and size are read as one square and cut out of it,
    if they lie on whole pixels of the level; `downsample` names the column of the level's factor (without it, 1).
    A task holds about budget bytes of pixels before it sends them. A super-tile at the seam of two Arrow batches is read twice, with the same result.
    """
    if supertile < 1:
        raise ValueError("a super-tile holds one read at least")
    factor = F.col(downsample).cast("double") if downsample else F.lit(1.0)
    side = F.col("read_px") * factor * supertile
    keyed = requests.withColumns({"_f": factor, "_sx": F.floor(F.col("x") / side), "_sy": F.floor(F.col("y") / side)})
    order = ["image_path", "level", "read_px", "_sy", "_sx"]
    ways = int(requests.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartition(ways, "image_path", "_sx", "_sy").sortWithinPartitions(*order)
    names = requests.columns
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in requests.schema.fields), "pixels array<float>, height int, width int"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        path, image = None, None
        for b in batches:
            for k in order:
                b = b.filter(b.column(k).is_valid())
            paths, of = b.column("image_path").to_pylist(), {c: b.column(c).to_numpy(zero_copy_only=False) for c in ("x", "y", "level", "read_px", "_f", "_sx", "_sy")}
            starts = [n for n in range(b.num_rows) if not n or paths[n] != paths[n - 1] or any(of[k][n] != of[k][n - 1] for k in order[1:])]
            made, size, first = [], 0, 0
            for a, z in zip(starts, [*starts[1:], b.num_rows]):
                if paths[a] != path:
                    path, image = paths[a], open_image(paths[a])
                new = [p.astype(np.float32).ravel() for p in _cut(image, {c: v[a:z] for c, v in of.items()})]
                made.extend(new)
                size += sum(p.nbytes for p in new)
                if size > budget or z == b.num_rows:
                    ends = np.cumsum([0, *map(len, made)], dtype=np.int32)
                    sides = pa.array(of["read_px"][first:z].astype(np.int32))
                    rows = b.slice(first, z - first)
                    yield pa.RecordBatch.from_arrays([*(rows.column(n) for n in names), pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(made))), sides, sides], [*names, "pixels", "height", "width"])
                    made, size, first = [], 0, z

    return dealt.mapInArrow(run, schema)


def _cut(image, group: Mapping) -> list[np.ndarray]:
    """Squares of one super-tile: one read that spans them, if that is smaller than all of them together or as large."""
    x, y = np.asarray(group["x"], np.int64), np.asarray(group["y"], np.int64)
    size, level, f = (cast(np.asarray(group[c])[0]) for c, cast in (("read_px", int), ("level", int), ("_f", float)))
    left, top = (x - x.min()) / f, (y - y.min()) / f
    whole = np.all(left % 1 == 0) and np.all(top % 1 == 0)
    span = int(max(left.max(), top.max())) + size
    if len(x) == 1 or not whole or span * span > len(x) * size * size:
        return [image.read(int(a), int(c), level, size) for a, c in zip(x, y, strict=True)]
    block = image.read(int(x.min()), int(y.min()), level, span)
    return [block[t : t + size, s : s + size] for s, t in zip(left.astype(int), top.astype(int), strict=True)]
