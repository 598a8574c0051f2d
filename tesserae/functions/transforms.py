"""Lists of image transforms, rewritten to one kernel for each size of image.

Resizing and cropping are matrices on rows and on columns, and scaling and normalising are one factor and one
addend for each channel. Resizing matrices have rows that sum to 1, so both kinds can be moved past one another: a
whole list becomes `rows @ image @ columns * factor + addend`. A step that is none of these is applied by itself,
image by image, and the runs of known steps before and after it are still fused.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tesserae.functions.contracts import pair
from tesserae.functions.pixels import WEIGHTS


@dataclass(frozen=True)
class Resize:
    """To (height, width); one number is the shorter side, and the longer keeps the shape, rounded down."""

    size: int | tuple[int, int]
    mode: str = "bilinear"

    def to(self, height: int, width: int) -> tuple[int, int]:
        if not isinstance(self.size, int):
            return pair(self.size)
        short = pair(self.size)[0]
        return (short, math.floor(short * width / height)) if height <= width else (math.floor(short * height / width), short)


@dataclass(frozen=True)
class CenterCrop:
    """The middle; offsets are rounded down, and images that are too small are an error."""

    size: int | tuple[int, int]


@dataclass(frozen=True)
class Scale:
    """Every value times a factor, as bytes to numbers from 0 to 1."""

    factor: float = 1 / 255


@dataclass(frozen=True)
class Normalize:
    """(value - mean) / deviation of each channel."""

    mean: tuple[float, ...]
    std: tuple[float, ...]

    def __post_init__(self) -> None:
        if len(self.mean) != len(self.std) or any(not s > 0 for s in self.std):
            raise ValueError("a mean and a positive deviation for each channel")


#: A step of the caller's own: an image (height, width, channels) to another.
Step = Resize | CenterCrop | Scale | Normalize | Callable[[np.ndarray], np.ndarray]
KNOWN = (Resize, CenterCrop, Scale, Normalize)


def flat(steps: Sequence) -> list[Step]:
    """Lists within lists laid out; what is neither a step nor a function is an error."""
    out: list[Step] = []
    for s in steps:
        if isinstance(s, (list, tuple)):
            out += flat(s)
        elif isinstance(s, KNOWN) or callable(s):
            out.append(s)
        else:
            raise ValueError(f"no such transform: {s!r}")
    return out


@dataclass
class Kernel:
    """What a run of known steps does to images of one size; a matrix that is None leaves its axis alone."""

    rows: np.ndarray | None
    columns: np.ndarray | None
    factor: np.ndarray
    addend: np.ndarray

    def __call__(self, images: np.ndarray) -> np.ndarray:
        """images: (number, height, width, channels)."""
        if self.columns is not None:
            images = np.einsum("xw,nhwc->nhxc", self.columns, images, optimize=True)
        if self.rows is not None:
            images = np.einsum("yh,nhwc->nywc", self.rows, images, optimize=True)
        return images * self.factor + self.addend


def fuse(steps: Sequence[Step], height: int, width: int, channels: int) -> Kernel:
    """One kernel of known steps for images of a size."""
    mats: list[np.ndarray | None] = [None, None]
    factor, addend = np.ones(channels), np.zeros(channels)
    now = (height, width)
    for s in steps:
        if isinstance(s, Scale):
            factor, addend = factor * s.factor, addend * s.factor
        elif isinstance(s, Normalize):
            if len(s.mean) not in (1, channels):
                raise ValueError(f"{len(s.mean)} means for {channels} channels")
            factor, addend = factor / np.array(s.std), (addend - np.array(s.mean)) / np.array(s.std)
        else:
            to = s.to(*now) if isinstance(s, Resize) else pair(s.size)
            if isinstance(s, CenterCrop):
                if any(t > n for t, n in zip(to, now)):
                    raise ValueError(f"no {to} in the middle of {now}")
                made = [np.eye(n)[(n - t) // 2 : (n - t) // 2 + t] for n, t in zip(now, to)]
            else:
                if s.mode not in WEIGHTS:
                    raise ValueError(f"no such resizing: {s.mode}")
                if s.mode == "area" and any(t > n for t, n in zip(to, now)):
                    raise ValueError(f"{now} can't be averaged up to {to}")
                made = [WEIGHTS[s.mode](n, t) for n, t in zip(now, to)]
            for k, (n, t) in enumerate(zip(now, to)):
                if n != t:
                    mats[k] = made[k] if mats[k] is None else made[k] @ mats[k]
            now = to
    return Kernel(mats[0], mats[1], factor, addend)


@dataclass
class Fused:
    """Runs of known steps, and steps of the caller's own between them. Kernels are made once for each size."""

    steps: Sequence
    channels: int = 1
    parts: list = field(default_factory=list)

    def __post_init__(self) -> None:
        for s in flat(self.steps):
            if isinstance(s, KNOWN) and self.parts and isinstance(self.parts[-1], list):
                self.parts[-1].append(s)
            else:
                self.parts.append([s] if isinstance(s, KNOWN) else s)
        self.kernels: dict[tuple[int, int, int], Kernel] = {}

    @property
    def batched(self) -> bool:
        """Whether images of one size go through together, without a step of the caller's own."""
        return all(isinstance(p, list) for p in self.parts)

    def __call__(self, images: np.ndarray) -> np.ndarray | list[np.ndarray]:
        """images of one size (number, height, width, channels); a list if a step of the caller's own makes different sizes."""
        for k, part in enumerate(self.parts):
            if isinstance(part, list):
                if isinstance(images, list):
                    return [Fused(self.parts[k:], self.channels)(i[None])[0] for i in images]
                size = images.shape[1:3]
                if (k, *size) not in self.kernels:
                    self.kernels[(k, *size)] = fuse(part, *size, images.shape[3])
                images = self.kernels[(k, *size)](images)
            else:
                each = [np.asarray(part(i), np.float64) for i in images]
                images = np.stack(each) if len({i.shape for i in each}) <= 1 and each else each
        return images


def transform_udf(steps: Sequence, channels: int = 1):
    """Column function of (pixels, height, width) to a struct of pixels, height and width. Images of a batch that have one size go through one kernel; null images stay null."""
    flat(steps)  # what is wrong is told at once

    @F.pandas_udf("pixels array<double>, height int, width int")
    def transform(pixels: pd.Series, height: pd.Series, width: pd.Series) -> pd.DataFrame:
        run = Fused(steps, channels)
        there = np.flatnonzero(pixels.notna().to_numpy())
        sizes: dict[tuple[int, int], list[int]] = {}
        for i in there.tolist():
            sizes.setdefault((int(height.iloc[i]), int(width.iloc[i])), []).append(i)
        out: list = [(None, None, None)] * len(pixels)
        for (h, w), at in sizes.items():
            made = run(np.stack([np.asarray(pixels.iloc[i], np.float64).reshape(h, w, channels) for i in at]))
            for i, image in zip(at, made):
                out[i] = (image.ravel(), image.shape[0], image.shape[1])
        return pd.DataFrame({"pixels": pd.Series([o[0] for o in out], dtype=object), "height": pd.array([o[1] for o in out], "Int32"), "width": pd.array([o[2] for o in out], "Int32")})

    return transform
