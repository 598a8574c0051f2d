"""Which classes of a mask cover a tile, and by how much: summed-area tables, four look-ups for each tile and class."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructField, StructType

from tesserae.functions.expressions import artifact_label


def summed(mask: np.ndarray) -> np.ndarray:
    """Sums over all rows and columns before a place, with a first row and column of zeros."""
    return np.pad(mask.astype(np.float64).cumsum(0).cumsum(1), ((1, 0), (1, 0)))


def area(table: np.ndarray, y: np.ndarray, x: np.ndarray) -> np.ndarray:
    """The sum before places (y, x) that may lie between pixels: within a pixel it grows with the area. Places beyond the mask count as its edge."""
    y, x = np.clip(y, 0, table.shape[0] - 1), np.clip(x, 0, table.shape[1] - 1)
    i, j = np.minimum(y.astype(np.int64), table.shape[0] - 2), np.minimum(x.astype(np.int64), table.shape[1] - 2)
    a, b = y - i, x - j
    return (1 - a) * (1 - b) * table[i, j] + (1 - a) * b * table[i, j + 1] + a * (1 - b) * table[i + 1, j] + a * b * table[i + 1, j + 1]


def _measured(tiles: DataFrame, masks: DataFrame, classes: Mapping[str, int], keys: Sequence[str], rows) -> DataFrame:
    """tiles with annotation and coverage as `rows` makes them of a mask's tiles and their shares by class."""
    names = tiles.columns
    schema = StructType([*tiles.schema.fields, StructField("annotation", StringType()), StructField("coverage", DoubleType())])

    def one(t: pa.Table, m: pa.Table) -> pa.Table:
        if m.num_rows > 1:
            raise ValueError(f"{m.num_rows} masks of {[m.column(k)[0].as_py() for k in keys]}")
        t = t.select(names)
        n = t.num_rows if m.num_rows else 0
        values = np.zeros(0) if not n or m.column("mask")[0].as_py() is None else m.column("mask").combine_chunks().flatten().to_numpy(zero_copy_only=False)
        x, y, size = (t.column(c).to_numpy().astype(np.float64) for c in ("x", "y", "size"))
        shares = np.zeros((len(classes), n))
        if len(values):
            f, grid = m.column("mask_downsample")[0].as_py(), values.reshape(-1, m.column("mask_width")[0].as_py())
            left, top, right, bottom = x / f, y / f, (x + size) / f, (y + size) / f
            for k, value in enumerate(classes.values()):
                table = summed(grid == value)
                shares[k] = (area(table, bottom, right) - area(table, top, right) - area(table, bottom, left) + area(table, top, left)) / ((right - left) * (bottom - top))
        at, labels, found = rows(shares)
        return t.take(pa.array(at)).append_column("annotation", pa.array(labels, pa.string())).append_column("coverage", pa.array(found))

    return tiles.groupBy(*keys).cogroup(masks.select(*keys, "mask", "mask_width", "mask_downsample").groupBy(*keys)).applyInArrow(one, schema)


def coverage(tiles: DataFrame, masks: DataFrame, classes: Mapping[str, int], keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """tiles with annotation and coverage, a row for each class: the share of the tile's area whose mask pixels have the class's value.

    tiles: keys, x, y and size, at level 0. masks: keys, mask (values by rows), mask_width and mask_downsample (pixels
    of level 0 along a side of a mask pixel), one row for each key. What lies beyond the mask is of no class. Tiles
    without a mask have no rows; a mask that is null or empty covers nothing. A task holds one mask, with its tiles.
    """
    names = list(classes)

    def each(shares: np.ndarray):
        n = shares.shape[1]
        return np.tile(np.arange(n), len(names)), np.repeat(names, n), shares.ravel()

    return _measured(tiles, masks, classes, keys, each)


def select(tiles: DataFrame, masks: DataFrame, settings: Mapping, keys: Sequence[str] = ("sample_id",)) -> DataFrame:
    """Tiles of the classes that cover them enough: a row for each class with a least coverage, that is met.

    settings: `pixel_mapping` from class to mask value, and `min_coverage` from class to least share, null for classes
    that make no tiles. Flat classes have the null label (see artifact_label). Where `output_mode` is merged a tile that
    any class covers enough has one row, without a label, with the largest of those coverages.
    """
    wanted = {c: m for c, m in settings["min_coverage"].items() if m is not None}
    if lost := sorted(set(wanted) - set(settings["pixel_mapping"])):
        raise ValueError(f"no mask values for {lost}")
    if bad := {c: m for c, m in wanted.items() if not 0 <= m <= 1}:
        raise ValueError(f"a least coverage is a share: {bad}")
    values = {c: settings["pixel_mapping"][c] for c in wanted}
    if settings.get("output_mode") == "merged":
        floor = np.array(list(wanted.values()), np.float64)[:, None]

        def union(shares: np.ndarray):
            met = np.where(shares + 1e-12 >= floor, shares, -1.0).max(0, initial=-1.0)
            at = np.flatnonzero(met >= 0)
            return at, [None] * len(at), met[at]

        return _measured(tiles, masks, values, keys, union)
    least = F.lit(None).cast("double")
    for c, m in wanted.items():
        least = F.when(F.col("annotation") == c, F.lit(float(m))).otherwise(least)
    made = coverage(tiles, masks, values, keys)
    return made.where(F.col("coverage") + 1e-12 >= least).withColumn("annotation", artifact_label("annotation"))
