"""Image operators on rows that hold one image: `pixels`, an array by rows with the channel last, and its sizes.

What is an index calculation (crop, pad, unfold, normalise) is a column expression. Resizing mixes pixels
with weights and goes through Arrow batches.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.expressions import col

PAD_MODES = ("reflect", "replicate", "constant", "zero")


def _pick(pixels: Column, width: Column, channels: int, y: Column, x: Column, c: Column) -> Column:
    return F.get(pixels, ((y * width + x) * channels + c).cast("int"))


def _raster(height: Column, width: Column, channels: int, value) -> Column:
    """Array of value(y, x, c) over a raster; empty if a side is."""
    n = (height * width * channels).cast("int")
    at = F.when(n > 0, F.sequence(F.lit(0), n - 1)).otherwise(F.array().cast("array<int>"))
    y = lambda i: F.floor(i / (width * channels)).cast("int")
    x = lambda i: F.pmod(F.floor(i / channels).cast("int"), width.cast("int"))
    return F.transform(at, lambda i: value(y(i), x(i), F.pmod(i, F.lit(channels))))


def scaled_to_one(pixels: Column | str) -> Column:
    """Bytes as numbers from 0 to 1."""
    return F.transform(col(pixels), lambda v: v / 255.0)


def normalised(pixels: Column | str, mean: list[float], std: list[float]) -> Column:
    """(value - mean) / std of each channel."""
    if len(mean) != len(std) or any(s <= 0 for s in std):
        raise ValueError("a mean and a positive deviation for each channel")
    m, s = (F.array(*(F.lit(float(v)) for v in values)) for values in (mean, std))
    channel = lambda i: F.pmod(i, F.lit(len(mean)))
    return F.transform(col(pixels), lambda v, i: (v.cast("double") - F.get(m, channel(i))) / F.get(s, channel(i)))


def center_crop(pixels: Column | str, height: Column | str, width: Column | str, size: int, channels: int = 1) -> Column:
    """The square in the middle; offsets are rounded down. Null where the image is smaller."""
    p, h, w = col(pixels), col(height).cast("int"), col(width).cast("int")
    top, left = F.floor((h - size) / 2).cast("int"), F.floor((w - size) / 2).cast("int")
    crop = _raster(F.lit(size), F.lit(size), channels, lambda y, x, c: _pick(p, w, channels, y + top, x + left, c))
    return F.when((h >= size) & (w >= size), crop)


def padded(pixels: Column | str, height: Column | str, width: Column | str, to_height: Column | str, to_width: Column | str, mode: str = "reflect", value: float = 0.0, channels: int = 1, element: str = "float") -> Column:
    """Padded at the bottom and right. `reflect` needs a pad smaller than the side, else the result is null. element: type of a pixel, which the fill must have too."""
    if mode not in PAD_MODES:
        raise ValueError(f"no such padding: {mode}")
    p, (h, w, th, tw) = col(pixels), (col(v).cast("int") for v in (height, width, to_height, to_width))
    fill = F.lit(0.0 if mode == "zero" else value).cast(element)

    def inside(i: Column, n: Column) -> Column:
        if mode == "reflect":
            return F.when(i < n, i).otherwise(2 * (n - 1) - i)
        return F.least(i, n - 1)

    def cell(y: Column, x: Column, c: Column) -> Column:
        v = _pick(p, w, channels, inside(y, h), inside(x, w), c)
        return F.when((y < h) & (x < w), v).otherwise(fill) if mode in ("constant", "zero") else v

    fits = (th >= h) & (tw >= w)
    if mode == "reflect":
        fits = fits & (th < 2 * h) & (tw < 2 * w)
    return F.when(fits, _raster(th, tw, channels, cell))


def cropped_read(pixels: Column | str, height: Column | str, width: Column | str, x: Column | str, y: Column | str, size: Column | str, channels: int = 1, outside: float = 255.0, element: str = "float") -> Column:
    """A square of an image at (x, y); what lies outside the image is white. element: type of a pixel."""
    p, (h, w, left, top, n) = col(pixels), (col(v).cast("int") for v in (height, width, x, y, size))

    def cell(j: Column, i: Column, c: Column) -> Column:
        yy, xx = j + top, i + left
        ok = (yy >= 0) & (yy < h) & (xx >= 0) & (xx < w)
        return F.when(ok, _pick(p, w, channels, yy, xx, c)).otherwise(F.lit(outside).cast(element))

    return _raster(n, n, channels, cell)


def window(pixels: Column | str, width: Column | str, top: Column | str, left: Column | str, height_out: Column | str, width_out: Column | str, channels: int = 1) -> Column:
    """A part of an image of the given width; it must lie inside."""
    p, (w, t, s, ho, wo) = col(pixels), (col(v).cast("int") for v in (width, top, left, height_out, width_out))
    return _raster(ho, wo, channels, lambda y, x, c: _pick(p, w, channels, y + t, x + s, c))


def unfolded(pixels: Column | str, side: Column | str, tile: int, channels: int = 1) -> Column:
    """A square region as an array of its tiles, by rows. Null where tiles don't divide the region."""
    p, s = col(pixels), col(side).cast("int")
    across = F.floor(s / tile).cast("int")
    tiles = F.transform(
        F.sequence(F.lit(0), across * across - 1),
        lambda t: _raster(F.lit(tile), F.lit(tile), channels, lambda y, x, c: _pick(p, s, channels, y + F.floor(t / across).cast("int") * tile, x + F.pmod(t, across) * tile, c)),
    )
    return F.when((s >= tile) & (F.pmod(s, F.lit(tile)) == 0), tiles)


def area_weights(n: int, m: int) -> np.ndarray:
    """(m, n) matrix that averages n cells to m, each by the part of it that a new cell covers."""
    edges = np.arange(m + 1) * (n / m)
    covered = np.minimum(edges[1:, None], np.arange(1, n + 1)) - np.maximum(edges[:-1, None], np.arange(n))
    return np.clip(covered, 0, None) * (m / n)


def cubic_weights(n: int, m: int, a: float = -0.5) -> np.ndarray:
    """(m, n) matrix of antialiased bicubic resampling."""

    def kernel(t):
        t = np.abs(t)
        near, far = (a + 2) * t**3 - (a + 3) * t**2 + 1, a * t**3 - 5 * a * t**2 + 8 * a * t - 4 * a
        return np.where(t < 1, near, np.where(t < 2, far, 0.0))

    return _filter(n, m, kernel)


def linear_weights(n: int, m: int) -> np.ndarray:
    """(m, n) matrix of antialiased bilinear resampling."""
    return _filter(n, m, lambda t: np.clip(1 - np.abs(t), 0, None))


def _filter(n: int, m: int, kernel) -> np.ndarray:
    scale = n / m
    at = (np.arange(m) + 0.5) * scale
    w = kernel((np.arange(n)[None, :] + 0.5 - at[:, None]) / max(scale, 1.0))
    return w / w.sum(1, keepdims=True)


WEIGHTS = {"area": area_weights, "bilinear": linear_weights, "bicubic": cubic_weights}


def resize_udf(size: tuple[int, int], mode: str = "area", channels: int = 1):
    """Column function of (pixels, height, width) to pixels of another size; images of that size pass as they are.

    `area` only makes images smaller. Null images stay null.
    """
    if mode not in WEIGHTS:
        raise ValueError(f"no such resizing: {mode}")
    to_h, to_w = size

    @F.pandas_udf("array<double>")
    def resize(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.Series:
        made: dict[tuple[int, int], np.ndarray] = {}

        def weights(n, m):
            if (n, m) not in made:
                made[n, m] = WEIGHTS[mode](n, m)
            return made[n, m]

        out = []
        for p, h, w in zip(pixels, height, width, strict=True):
            if p is None:
                out.append(None)
                continue
            h, w = int(h), int(w)
            if mode == "area" and (h < to_h or w < to_w):
                raise ValueError(f"an image of {h}x{w} px can't be averaged up to {to_h}x{to_w}")
            image = np.asarray(p, np.float64).reshape(h, w, channels)
            if (h, w) != size:
                image = np.einsum("yh,hwc,xw->yxc", weights(h, to_h), image, weights(w, to_w), optimize=True)
            out.append(image.ravel())
        return pd.Series(out, dtype=object)

    return resize
