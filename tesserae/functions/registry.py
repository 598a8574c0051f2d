"""Encoders as plug-ins: a registry of their contracts, checks of requests against them, and vector UDFs.

Models themselves can't run here; an encoder is a function from a batch of arrays to a batch of vectors,
made once a worker. Arithmetic stand-ins make every operator around them testable.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from tesserae.functions.expressions import ALIASES

LEVELS = ("tile", "slide", "patient")
TOLERANCE = 1e-8


@dataclass(frozen=True)
class Encoder:
    """What is known of an encoder. variants: name to dimension, the first is the default."""

    name: str
    level: str
    variants: dict[str, int]
    make: Callable[[], Callable[[np.ndarray], np.ndarray]] | None = None
    input_size: int | None = None
    patch: tuple[int, int] | None = None
    spacings: tuple[float, ...] = ()
    precision: str = "fp32"
    tile_encoder: str | None = None
    variable_input: bool = False


@dataclass
class Registry:
    encoders: dict[str, Encoder] = field(default_factory=dict)

    def register(self, e: Encoder) -> Encoder:
        if e.level not in LEVELS:
            raise ValueError(f"no such level: {e.level}")
        if e.name in self.encoders:
            raise ValueError(f"{e.name} is registered already")
        if not e.variants or (e.level != "tile" and not e.tile_encoder):
            raise ValueError(f"{e.name} needs a variant, and above tiles a tile encoder")
        self.encoders[e.name] = e
        return e

    def get(self, name: str) -> Encoder:
        key = name.strip().lower()
        key = ALIASES.get(key, key)
        if key not in self.encoders:
            raise KeyError(f"no such encoder: {name}")
        return self.encoders[key]

    def names(self, level: str | None = None) -> list[str]:
        if level is not None and level not in LEVELS:
            raise ValueError(f"no such level: {level}")
        return sorted(n for n, e in self.encoders.items() if level in (None, e.level))

    def variant(self, name: str, asked: str | None = None) -> tuple[str, int]:
        """Output variant and its dimension. Patient encoders, and others of one variant above tiles, have no choice."""
        e = self.get(name)
        first = next(iter(e.variants))
        if asked in (None, first):
            return first, e.variants[first]
        if e.level == "patient" or (e.level == "slide" and len(e.variants) == 1) or asked not in e.variants:
            raise ValueError(f"{e.name} has no variant {asked}")
        return asked, e.variants[asked]

    def tile_of(self, name: str) -> Encoder:
        """The tile encoder that feeds an encoder: itself for tiles."""
        e = self.get(name)
        return e if e.level == "tile" else self.tile_of(e.tile_encoder)

    def preprocessing(self, name: str, spacing: float | None = None, size: int | None = None) -> tuple[float, int]:
        """Spacing and tile size, the missing ones from the encoder if it leaves no choice."""
        e, t = self.get(name), self.tile_of(name)
        if spacing is None:
            known = sorted({round(s / TOLERANCE) * TOLERANCE for s in e.spacings or t.spacings})
            if len(known) != 1:
                raise ValueError(f"{e.name} supports {len(known)} spacings; name one")
            spacing = known[0]
        if size is None:
            if t.input_size is None:
                raise ValueError(f"{t.name} has no input size of its own; name one")
            size = t.input_size
        return spacing, size

    def complaints(self, name: str, spacing: float, size: int, precision: str) -> list[str]:
        """What in a request the encoder was not made for."""
        e, t = self.get(name), self.tile_of(name)
        out = []
        supported = e.spacings or t.spacings
        if supported and not any(abs(spacing - s) <= TOLERANCE for s in supported):
            out.append(f"spacing {spacing} is not one of {supported}")
        if t.input_size and size != t.input_size and not (t.variable_input and t.patch and size % t.patch[0] == 0 and size % t.patch[1] == 0):
            out.append(f"size {size} does not fit {t.input_size} px")
        if precision != e.precision:
            out.append(f"precision {precision} is not {e.precision}")
        return out

    def validate(self, name: str, spacing: float, size: int, precision: str, allow: bool = False) -> list[str]:
        """Raises on complaints, or returns them if they are allowed."""
        out = self.complaints(name, spacing, size, precision)
        if out and not allow:
            raise ValueError(f"{name}: {'; '.join(out)}")
        return out


def vector_udf(e: Encoder, dim: int):
    """Column function from arrays to vectors of dim; the encoder is made once for each Python worker's task.

    Not deterministic for the optimizer, which else copies it into filters that it infers (as those of explode), and encodes twice.
    """
    make = e.make

    @F.pandas_udf("array<float>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for s in batches:
            out = np.zeros((0, dim), np.float32) if not len(s) else np.asarray(run(np.stack(s.to_numpy())), np.float32)
            if out.shape != (len(s), dim):
                raise ValueError(f"{e.name} gave {out.shape}, not {(len(s), dim)}")
            yield pd.Series(list(out))

    return encode.asNondeterministic()


def token_udf(e: Encoder, tokens: int, dim: int):
    """Column function from arrays to grids of `tokens` vectors of dim; the encoder is made once for each Python worker's task."""
    make = e.make

    @F.pandas_udf("array<array<float>>")
    def encode(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        run = make()
        for s in batches:
            out = np.zeros((0, tokens, dim), np.float32) if not len(s) else np.asarray(run(np.stack(s.to_numpy())), np.float32)
            if out.shape != (len(s), tokens, dim):
                raise ValueError(f"{e.name} gave {out.shape}, not {(len(s), tokens, dim)}")
            yield pd.Series([list(v) for v in out])

    return encode.asNondeterministic()


def as_half(column):
    """Values rounded to half precision and back; Spark has no half type."""

    @F.pandas_udf("array<float>")
    def half(s: pd.Series) -> pd.Series:
        return s.map(lambda v: None if v is None else np.asarray(v, np.float16).astype(np.float32))

    return half(column)


STANDARD = Registry()
STANDARD.register(Encoder("mean-2", "tile", {"default": 2}, lambda: lambda x: np.stack([x.mean(1), x.std(1)], 1), 224, (16, 16), (0.5,), "fp32", variable_input=True))
STANDARD.register(Encoder("mean-slide", "slide", {"default": 2}, None, None, None, (0.5,), "fp32", "mean-2"))
