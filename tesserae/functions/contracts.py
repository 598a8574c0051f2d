"""What a request asks of an encoder, settled on the driver before any plan is made: input sizes, windows, options."""

from __future__ import annotations

import math
from dataclasses import dataclass

from tesserae.functions.pixels import PAD_MODES
from tesserae.functions.registry import Registry

KINDS = ("patch_features", "cls_attention")


def pair(value: int | tuple[int, int], name: str = "size") -> tuple[int, int]:
    """A positive (height, width); one number stands for a square."""
    both = (value, value) if isinstance(value, int) else tuple(value)
    if len(both) != 2 or any(int(v) != v or v <= 0 for v in both):
        raise ValueError(f"{name} is a positive number or (height, width), not {value!r}")
    return int(both[0]), int(both[1])


def _up(n: float, step: int) -> int:
    return math.ceil(n / step) * step


def _starts(extent: int, size: int, stride: int) -> tuple[int, ...]:
    if size >= extent:
        return (0,)
    regular = range(0, extent - size + 1, stride)
    return tuple(regular) if regular[-1] == extent - size else (*regular, extent - size)


@dataclass(frozen=True)
class Layout:
    """Padding of images of one size to whole patches, and the windows over them. All pairs are (height, width)."""

    target: tuple[int, int]
    patch: tuple[int, int]
    encoded: tuple[int, int]
    window: tuple[int, int]
    starts: tuple[tuple[int, ...], tuple[int, ...]]

    @classmethod
    def of(cls, target: int | tuple[int, int], patch: int | tuple[int, int], window: int | None = None, overlap: float = 0.0) -> Layout:
        """Without a window one covers all. Windows are rounded up to patches and strides to the nearest patch, one at least; the last window is flush with the end."""
        target, patch = pair(target, "target"), pair(patch, "patch")
        encoded = tuple(_up(t, p) for t, p in zip(target, patch))
        if window is None:
            return cls(target, patch, encoded, encoded, ((0,), (0,)))
        if window <= 0 or not 0 <= overlap < 1:
            raise ValueError("a window is positive, and an overlap a part of it")
        size = tuple(min(_up(window, p), e) for p, e in zip(patch, encoded))
        stride = tuple(min(s, max(p, round(s * (1 - overlap) / p) * p)) for s, p in zip(size, patch))
        return cls(target, patch, encoded, size, tuple(map(_starts, encoded, size, stride)))

    @property
    def pad(self) -> tuple[int, int]:
        return self.encoded[0] - self.target[0], self.encoded[1] - self.target[1]

    @property
    def grid(self) -> tuple[int, int]:
        return self.encoded[0] // self.patch[0], self.encoded[1] // self.patch[1]

    @property
    def tokens(self) -> tuple[int, int]:
        """Cells of a window."""
        return self.window[0] // self.patch[0], self.window[1] // self.patch[1]

    def weights(self) -> tuple[list[float], list[float]]:
        """Hann weights of a window's rows and columns; all alike along an axis with one window."""
        one = lambda n, tiled: [0.5 - 0.5 * math.cos(2 * math.pi * i / (n + 1)) for i in range(1, n + 1)] if tiled and n > 1 else [1.0] * n
        return tuple(one(n, len(s) > 1) for n, s in zip(self.tokens, self.starts))


@dataclass(frozen=True)
class InputPlan:
    """The size that reaches an encoder, and whether its model must be made for sizes other than its own."""

    encoder: str
    tile_encoder: str
    preset: int
    size: tuple[int, int]
    variable: bool
    layout: Layout | None = None

    @property
    def preprocessing(self) -> str:
        """Only normalisation where the size is exact; else the encoder's own steps."""
        return "normalization_only" if self.variable else "shipped"


def effective_input(registry: Registry, name: str, size: int | tuple[int, int], layout: Layout | None = None) -> InputPlan:
    """Any encoder takes its own size; other sizes need one that can vary, in whole patches."""
    e, t, size = registry.get(name), registry.tile_of(name), pair(size)
    if t.input_size is None:
        raise ValueError(f"{t.name} has no input size of its own")
    own = size == (t.input_size, t.input_size)
    if not own and not t.variable_input:
        raise ValueError(f"{e.name} takes {t.input_size} px only, not {size}")
    if not own and t.patch and any(n % p for n, p in zip(size, t.patch)):
        raise ValueError(f"{t.name} takes whole patches of {t.patch}, not {size}")
    return InputPlan(e.name, t.name, t.input_size, size, not own, layout)


def pooled_input(registry: Registry, name: str, tile_size: int, allow: bool = False) -> InputPlan:
    """Tiles of another size than the encoder's recipe must be allowed by the caller."""
    own = registry.tile_of(name).input_size
    if tile_size != own and not allow:
        raise ValueError(f"{name} is made for tiles of {own} px; allow other settings for {tile_size} px")
    return effective_input(registry, name, tile_size)


def dense_input(registry: Registry, name: str, target: int | tuple[int, int], window: int | None = None, overlap: float = 0.0) -> InputPlan:
    """The whole padded image, or the window cut from it, is what reaches the encoder."""
    patch = registry.tile_of(name).patch
    if patch is None:
        raise ValueError(f"{name} has no patches, so no grid")
    layout = Layout.of(target, patch, window, overlap)
    return effective_input(registry, name, layout.window, layout)


def check_dense(layout: Layout, pad_mode: str = "reflect", kind: str = KINDS[0], blocks: tuple[int, ...] = (), registers: bool = False) -> None:
    """Raises where options of a dense request don't go together."""
    if pad_mode not in PAD_MODES:
        raise ValueError(f"no such padding: {pad_mode}")
    if pad_mode == "reflect" and any(p >= t for p, t in zip(layout.pad, layout.target)):
        raise ValueError(f"{layout.target} is too small to be padded by {layout.pad} of its reflection")
    if kind not in KINDS:
        raise ValueError(f"no such features: {kind}")
    if any(isinstance(b, bool) or not isinstance(b, int) for b in blocks) or (kind == KINDS[1] and not blocks):
        raise ValueError("attention needs the numbers of its blocks")
    if not isinstance(registers, bool):
        raise ValueError("registers are included or not")


def own_or_allowed(asked: bool | None, recommended: bool | None, allow: bool, name: str) -> bool:
    """A switch as asked, else as recommended; one against the recommendation must be allowed."""
    if asked is None:
        return bool(recommended)
    if recommended is not None and asked != recommended and not allow:
        raise ValueError(f"{name} recommends {recommended}, not {asked}")
    return asked
