"""Attention of prefix tokens (class token, registers) over the patches of an image, as maps on their grid."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import functions as F


def block_indices(blocks: Sequence[int], n: int) -> list[int]:
    """Places of blocks among n, in the order asked for; negative ones count from the end."""
    out = [b + n if b < 0 else b for b in blocks]
    bad = [b for b, i in zip(blocks, out, strict=True) if not 0 <= i < n]
    if bad:
        raise ValueError(f"no such blocks among {n}: {bad}")
    return out


def weights(q: np.ndarray, k: np.ndarray) -> np.ndarray:
    """Softmax over keys of the scaled products of (heads, tokens, dim) queries and keys."""
    s = np.einsum("htd,hsd->hts", q, k) / np.sqrt(q.shape[-1])
    e = np.exp(s - s.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def prefix_maps(w: np.ndarray, prefix: int, grid: tuple[int, int], registers: bool = False) -> np.ndarray:
    """(queries x heads, height, width) of (heads, tokens, tokens): the class token's rows, or those of all prefix tokens, over the patches."""
    heads, tokens, _ = w.shape
    if prefix < 1 or tokens - prefix != grid[0] * grid[1]:
        raise ValueError(f"{tokens} tokens are not {prefix} and a grid of {grid[0]} x {grid[1]}")
    rows = w[:, : prefix if registers else 1, prefix:]
    return rows.transpose(1, 0, 2).reshape(-1, *grid)


def maps_udf(heads: int, dim: int, prefix: int, grid: tuple[int, int], registers: bool = False):
    """Column function of queries and keys, each (heads x tokens x dim) in one array, to the maps in one array."""

    @F.pandas_udf("array<double>")
    def maps(q: pd.Series, k: pd.Series) -> pd.Series:
        shape = (heads, -1, dim)
        out = [None if a is None or b is None else prefix_maps(weights(np.reshape(a, shape), np.reshape(b, shape)), prefix, grid, registers).ravel() for a, b in zip(q, k, strict=True)]
        return pd.Series(out, dtype=object)

    return maps
