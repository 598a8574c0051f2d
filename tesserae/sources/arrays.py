"""Scans of files that hold arrays or images: npz archives, JSON sidecars, plain rasters. For tar stores see `tars`.

All go through Spark's `binaryFile` source, so listing, filters on path, size and time, and reading from any
store are Spark's; Python only unpacks bytes, a file at a time. One file must fit in a task's memory.
"""

from __future__ import annotations

import io
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tesserae.functions.expressions import path_stem
from tesserae.operators.tables import TableError


def files(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """path, length, modificationTime and content; the content is read only where it is selected."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    return (reader.option("pathGlobFilter", pattern) if pattern else reader).load(path if isinstance(path, str) else list(path))


def listing(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None) -> DataFrame:
    """Files with their sizes and stems; no content is read."""
    return files(spark, path, pattern).select("path", path_stem("path").alias("stem"), F.col("length").alias("size_bytes"))


def with_file_size(slides: DataFrame, spark: SparkSession, folder: str) -> DataFrame:
    """Adds size_bytes to a manifest, by image_path; null for files that aren't in the folder."""
    plain = lambda c: F.regexp_replace(c, "^file:/+", "/")
    sizes = listing(spark, folder).select(plain("path").alias("_path"), "size_bytes")
    return slides.join(sizes, plain(F.col("image_path")) == F.col("_path"), "left").drop("_path")


def npz_rows(spark: SparkSession, path: str | Sequence[str], array: str = "features", pattern: str = "*.npz") -> DataFrame:
    """Rows of a two-dimensional array of each archive: sample_id (the stem), tile_index and embedding.

    tile_index is the archive's own array of that name, else the row's number.
    """

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stem, content in zip(b["sample_id"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    if array not in z:
                        raise ValueError(f"{stem} has no array {array}, but {sorted(z.files)}")
                    rows = np.atleast_2d(np.asarray(z[array], np.float32))
                    index = z["tile_index"] if "tile_index" in z else np.arange(len(rows))
                yield pd.DataFrame({"sample_id": stem, "tile_index": np.asarray(index, np.int64), "embedding": list(rows)})

    raw = files(spark, path, pattern).select(path_stem("path").alias("sample_id"), "content")
    return raw.mapInPandas(unpack, "sample_id string, tile_index long, embedding array<float>")


def coordinates(spark: SparkSession, path: str | Sequence[str], pattern: str = "*.npz") -> DataFrame:
    """Coordinates of tiles: sample_id, tile_index, x, y. Arrays x and y must have one length."""

    def unpack(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            for stem, content in zip(b["sample_id"], b["content"], strict=True):
                with np.load(io.BytesIO(content), allow_pickle=False) as z:
                    x, y = z["x"], z["y"]
                if x.ndim != 1 or x.shape != y.shape:
                    raise ValueError(f"{stem}: x of {x.shape}, y of {y.shape}")
                yield pd.DataFrame({"sample_id": stem, "tile_index": np.arange(len(x)), "x": x.astype(np.int64), "y": y.astype(np.int64)})

    stem = F.regexp_replace(path_stem("path"), r"\.coordinates$", "")
    return files(spark, path, pattern).select(stem.alias("sample_id"), "content").mapInPandas(unpack, "sample_id string, tile_index long, x long, y long")


def sidecars(spark: SparkSession, path: str | Sequence[str], schema: str, pattern: str = "*.meta.json") -> DataFrame:
    """JSON sidecars, one object a file, with the path; a file that is no such object is an error."""
    df = spark.read.schema(schema).option("multiLine", True).option("mode", "FAILFAST").option("recursiveFileLookup", True).option("pathGlobFilter", pattern)
    return df.json(path if isinstance(path, str) else list(path)).select("*", F.input_file_name().alias("path"))


def decode_pnm(content: bytes) -> np.ndarray:
    """(height, width, channels) of a binary PGM or PPM image of one byte a sample."""
    head, at = [], 0
    while len(head) < 4:
        end = at
        while content[end : end + 1] and not content[end : end + 1].isspace():
            end += 1
        token = content[at:end]
        if token.startswith(b"#"):
            end = content.index(b"\n", at)
        elif token:
            head.append(token)
        elif end >= len(content):
            raise ValueError("the image ends in its header")
        at = end + 1
    kind, width, height, top = head[0], int(head[1]), int(head[2]), int(head[3])
    if kind not in (b"P5", b"P6") or top > 255:
        raise ValueError(f"no binary image of bytes: {kind!r}, {top}")
    channels = 3 if kind == b"P6" else 1
    return np.frombuffer(content, np.uint8, height * width * channels, at).reshape(height, width, channels)


def decode_any(content: bytes) -> np.ndarray:
    """PGM and PPM by this module, everything else by Pillow where it is installed."""
    if content[:2] in (b"P5", b"P6"):
        return decode_pnm(content)
    try:
        from PIL import Image
    except ImportError as e:
        raise TableError("Pillow is needed for images other than PGM and PPM") from e
    return np.asarray(Image.open(io.BytesIO(content)).convert("RGB"))


def decoded(rows: DataFrame, decode: Callable[[bytes], np.ndarray] = decode_any, channels: int = 3, content: str = "content") -> DataFrame:
    """Replaces content by pixels (array by rows, channel last), height and width. One grey channel is repeated."""
    kept = [f for f in rows.schema.fields if f.name != content]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in kept), "pixels array<float>, height int, width int"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            images = [decode(c) for c in b[content]]
            images = [np.repeat(i, channels, 2) if i.shape[2] == 1 else i for i in images]
            for i in images:
                if i.shape[2] != channels:
                    raise ValueError(f"an image has {i.shape[2]} channels, not {channels}")
            out = b[[f.name for f in kept]].copy()
            out["pixels"] = [i.astype(np.float32).ravel() for i in images]
            out["height"], out["width"] = [i.shape[0] for i in images], [i.shape[1] for i in images]
            yield out

    return rows.mapInPandas(run, schema)


def images(spark: SparkSession, path: str | Sequence[str], pattern: str | None = None, channels: int = 3) -> DataFrame:
    """Decoded image files: sample_id, image_path, pixels, height, width."""
    return decoded(files(spark, path, pattern).select(path_stem("path").alias("sample_id"), F.col("path").alias("image_path"), "content"), channels=channels)
