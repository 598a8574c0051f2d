"""Grids of vectors from images: padded images are cut to windows, and the windows' cells blended on two axes."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from tesserae.functions import pixels as P
from tesserae.functions.contracts import Layout
from tesserae.functions.expressions import rounded

#: Bytes of cells that a task holds before it sends them.
FOLDED_BYTES = 128 << 20


def cut(images: DataFrame, layout: Layout, pixels: str = "pixels", channels: int = 1, pad_mode: str = "reflect", value: float = 0.0) -> DataFrame:
    """One row for each window: the image's other columns, win_y, win_x and the window's pixels.

    Every image has the layout's target size. The padding is at the bottom and right.
    """
    (th, tw), (eh, ew), (wh, ww) = layout.target, layout.encoded, layout.window
    full = P.padded(pixels, F.lit(th), F.lit(tw), F.lit(eh), F.lit(ew), pad_mode, value, channels) if any(layout.pad) else F.col(pixels)
    others = [c for c in images.columns if c != pixels]
    at = lambda axis, name: F.explode(F.array(*map(F.lit, layout.starts[axis]))).alias(name)
    rows = images.select(*others, full.alias(pixels), at(0, "win_y")).select("*", at(1, "win_x"))
    if layout.window == layout.encoded:
        return rows
    return rows.withColumn(pixels, P.window(pixels, F.lit(ew), F.col("win_y"), F.col("win_x"), F.lit(wh), F.lit(ww), channels))


def partial_cells(windows: DataFrame, keys: Sequence[str], layout: Layout, tokens: str = "tokens", budget: int = FOLDED_BYTES) -> DataFrame:
    """Weighted sums of what a task's windows say of a cell: (keys, h, w, weight, vector). A cell has a row for each time the task let go of it.

    One pass over the windows as they come. A task holds rows of cells of the images it is at, up to budget bytes, and
    then sends what it has; so images of any size, and keys with any number of windows, are folded in bounded memory.
    """
    rows, cols = (np.array(w) for w in layout.weights())
    k = np.outer(rows, cols)[:, :, None]
    (ph, pw), (th, tw), (gh, gw) = layout.patch, layout.tokens, layout.grid
    schema = windows.select(*keys).schema.add("h", "integer").add("w", "integer").add("weight", "double").add("vector", ArrayType(DoubleType()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[tuple, np.ndarray] = {}
        size = 0

        def sent(kinds: list[pa.DataType]) -> pa.RecordBatch:
            which = [np.flatnonzero(band[:, -1]) for band in held.values()]
            of = np.repeat(np.arange(len(held)), [len(w) for w in which])
            cells = np.concatenate([band[w] for band, w in zip(held.values(), which)])
            names = list(zip(*held))
            arrays = [pa.array(c, t).take(pa.array(of)) for c, t in zip(names, kinds)]
            vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(cells) + 1, dtype=np.int32) * (cells.shape[1] - 1)), pa.array(cells[:, :-1].ravel()))
            return pa.RecordBatch.from_arrays([*arrays, pa.array(np.array(names[-1], np.int32)[of]), pa.array(np.concatenate(which).astype(np.int32)), pa.array(cells[:, -1]), vectors], schema.names)

        kinds: list[pa.DataType] = []
        for b in batches:
            b = b.filter(b.column(len(keys) + 2).is_valid())
            if not b.num_rows:
                continue
            kinds = [b.schema.field(n).type for n in range(len(keys))]
            column = b.column(len(keys) + 2).flatten()
            flat = column.flatten().to_numpy(zero_copy_only=False)
            if len(column) != b.num_rows * th * tw or len(flat) % len(column):
                raise ValueError(f"windows of {len(column) / b.num_rows:g} cells, not {th} x {tw}")
            values = flat.reshape(b.num_rows, th, tw, -1).astype(np.float64) * k
            for n, (*key, y, x) in enumerate(zip(*(b.column(c).to_pylist() for c in range(len(keys) + 2)))):
                top, left = y // ph, x // pw
                if top < 0 or left < 0 or top + th > gh or left + tw > gw:
                    raise ValueError(f"a window at {y}, {x} is not on the grid")
                for r in range(th):
                    band = held.get((*key, top + r))
                    if band is None:
                        band = held[(*key, top + r)] = np.zeros((gw, values.shape[3] + 1))
                        size += band.nbytes
                    band[left : left + tw, :-1] += values[n, r]
                    band[left : left + tw, -1] += k[r, :, 0]
                if size > budget:
                    yield sent(kinds)
                    held.clear()
                    size = 0
        if held:
            yield sent(kinds)

    return windows.select(*keys, "win_y", "win_x", tokens).mapInArrow(run, schema)


def blend(windows: DataFrame, keys: Sequence[str], layout: Layout, tokens: str = "tokens", digits: int | None = None) -> DataFrame:
    """Cells (h, w, vector) of each image's grid: the mean of the windows over a cell, weighted by rows and columns.

    tokens: a window's cells by rows, each a vector; windows without are left out. Windows are folded to cells before
    the shuffle, which has a row for each cell and task, and there sums are added up as whole vectors.
    """
    parts = partial_cells(windows, keys, layout, tokens).groupBy(*keys, "h", "w").agg(F.array_sort(F.collect_list(F.struct("weight", "vector"))).alias("_p"))
    add = lambda a, b: F.struct((a["weight"] + b["weight"]).alias("weight"), F.zip_with(a["vector"], b["vector"], lambda x, y: x + y).alias("vector"))
    total = F.when(F.size("_p") == 1, F.col("_p")[0]).otherwise(F.aggregate(F.slice("_p", 2, F.size("_p")), F.col("_p")[0], add))
    mean = lambda x: x / F.col("_t.weight")
    return parts.select(*keys, "h", "w", total.alias("_t")).select(*keys, "h", "w", F.transform("_t.vector", (lambda x: rounded(mean(x), digits)) if digits is not None else mean).alias("vector"))


def planes(cells: DataFrame, keys: Sequence[str]) -> DataFrame:
    """(plane, values): the grid of each element of the vectors, by rows."""
    flat = cells.select(*keys, "h", "w", F.posexplode("vector").alias("plane", "x"))
    return flat.groupBy(*keys, "plane").agg(F.transform(F.array_sort(F.collect_list(F.struct("h", "w", "x"))), lambda s: s["x"]).alias("values"))
