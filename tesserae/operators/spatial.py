"""Spatial operators: folding tokens to grids, blending overlapping windows, exploding regions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.functions.expressions import hann, rounded, subtiles


def fold(rows: DataFrame, keys: Sequence[str], tokens: str, prefix: int, width: int) -> DataFrame:
    """Tokens after the prefix ones as cells (h, w, value) of a grid, by rows."""
    body = F.slice(tokens, prefix + 1, F.greatest(F.size(tokens) - prefix, F.lit(0)))
    cells = rows.select(*keys, F.posexplode(body).alias("_p", "value"))
    return cells.select(*keys, F.floor(F.col("_p") / width).cast("int").alias("h"), (F.col("_p") % width).cast("int").alias("w"), "value")


def unfold(cells: DataFrame, keys: Sequence[str], width: int, out: str = "tokens") -> DataFrame:
    """Cells (h, w, value) back to an array by rows."""
    at = (F.col("h") * width + F.col("w")).alias("p")
    return cells.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct(at, "value"))), lambda s: s["value"]).alias(out))


def overlap_add(windows: DataFrame, keys: Sequence[str], start: str, values: str, digits: int | None = None) -> DataFrame:
    """Blends windows that overlap: for each cell the mean of their values, weighted by a Hann window.

    Sums are partial before the shuffle by cell, so a cell under many windows is no hot spot.
    """
    weighted = windows.select(*keys, F.col(start).alias("_s"), F.posexplode(F.arrays_zip(F.col(values).alias("v"), hann(F.size(values)).alias("w"))).alias("_i", "_x"))
    cells = weighted.select(*keys, (F.col("_s") + F.col("_i")).cast("long").alias("cell"), F.col("_x.v").cast("double").alias("v"), F.col("_x.w").alias("w"))
    mean = F.sum(F.col("w") * F.col("v")) / F.sum("w")
    return cells.groupBy(*keys, "cell").agg((rounded(mean, digits) if digits is not None else mean).alias("value"))


def explode_regions(regions: DataFrame, multiple: int, size: str, x: str = "x", y: str = "y", index: str = "region_index") -> DataFrame:
    """Each region's subtiles, by rows, with a flat index over all regions."""
    sub = regions.select("*", F.explode(subtiles(x, y, multiple, size)).alias("_s"))
    flat = (F.col(index).cast("long") * (multiple * multiple) + F.col("_s.subtile")).alias("flat_index")
    return sub.select(*(c for c in regions.columns if c not in (x, y)), F.col("_s.subtile").alias("subtile_index"), F.col("_s.x").alias("x"), F.col("_s.y").alias("y"), flat)


def scatter(vectors: DataFrame, regions: DataFrame, per_region: int, keys: Sequence[str] = ("sample_id",), vector: str = "embedding", index: str = "flat_index") -> DataFrame:
    """The vectors of each region in order of its subtiles: keys, region_index and an array of per_region vectors.

    vectors: keys, a flat index over all subtiles, and a vector, from any shards and in any order. regions: keys and
    num_regions. Indices that are missing, that come twice or that no region has are errors that name them.
    """
    at = F.col(index).cast("long")
    found = vectors.select(*keys, F.floor(at / per_region).cast("long").alias("region_index"), F.pmod(at, F.lit(per_region)).alias("_p"), F.col(vector).alias("_v"))
    found = found.groupBy(*keys, "region_index").agg(F.array_sort(F.collect_list(F.struct("_p", F.col("_v")))).alias("_s"))
    known = regions.where("num_regions > 0").select(*keys, F.explode(F.sequence(F.lit(0).cast("long"), F.col("num_regions").cast("long") - 1)).alias("region_index")).withColumn("_known", F.lit(True))
    both = known.join(found, [*keys, "region_index"], "full")
    have = F.coalesce(F.transform("_s", lambda s: s["_p"]), F.array().cast("array<long>"))
    gone = F.array_except(F.sequence(F.lit(0).cast("long"), F.lit(per_region).cast("long") - 1), have)
    twice = F.array_distinct(F.filter(have, lambda p: F.size(F.filter(have, lambda q: q == p)) > 1))
    flat = lambda which: F.concat_ws(", ", F.transform(which, lambda p: (F.col("region_index") * per_region + p).cast("string")))
    of = F.concat(F.lit(" of "), F.concat_ws(", ", *(F.col(k).cast("string") for k in keys)))
    made = F.transform("_s", lambda s: s["_v"])
    wrong = lambda text, which: F.raise_error(F.concat(F.lit(text), flat(which), of)).cast(both.select(made).schema[0].dataType)
    checked = F.when(F.col("_known").isNull(), wrong("no region for subtiles ", have)).when(F.size(gone) > 0, wrong("no vectors for subtiles ", gone)).when(F.size(twice) > 0, wrong("several vectors for subtiles ", twice)).otherwise(made)
    return both.select(*keys, "region_index", checked.alias(vector))


def explode_rois(slides: DataFrame, coordinates: str = "coordinates") -> DataFrame:
    """One row for each (x, y) of an array of pairs; slides without any drop out."""
    pairs = slides.select("*", F.posexplode(coordinates).alias("roi_index", "_c"))
    return pairs.select(*(c for c in slides.columns if c != coordinates), "roi_index", F.col("_c")[0].alias("x"), F.col("_c")[1].alias("y"))


def grid_tiles(slides: DataFrame, size: int, overlap: float = 0.0, width: str = "width", height: str = "height") -> DataFrame:
    """All whole tiles of each slide, by rows, with their index. Slides smaller than a tile drop out."""
    if not 0 <= overlap < 1:
        raise ValueError("an overlap is a part of a tile")
    stride = max(1, round(size * (1 - overlap)))
    starts = lambda side: F.sequence(F.lit(0), F.col(side).cast("int") - size, F.lit(stride))
    fits = slides.where((F.col(width) >= size) & (F.col(height) >= size))
    rows = fits.select("*", F.posexplode(starts(height)).alias("_r", "y"), F.size(starts(width)).alias("_n"))
    out = rows.select("*", F.posexplode(starts(width)).alias("_c", "x"))
    index = F.col("_r").cast("long") * F.col("_n") + F.col("_c")
    return out.select(*(c for c in slides.columns if c not in (width, height)), index.alias("tile_index"), "x", "y")


def supertile_reads(tiles: DataFrame, keys: Sequence[str], group: str, order: str) -> DataFrame:
    """One row for each read: a group of tiles, their number, the first in order and all of them to be cut out."""
    return tiles.groupBy(*keys, group).agg(F.count("*").alias("tiles"), F.min(order).alias("first"), F.array_sort(F.collect_list(order)).alias("members"))
