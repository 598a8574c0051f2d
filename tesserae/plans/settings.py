"""Run settings: defaults, a YAML file and command-line overrides, merged and checked on the driver."""

from __future__ import annotations

import copy
import json
from datetime import datetime
from pathlib import Path

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.expressions import col
from tesserae.functions.registry import Registry

# Defaults of settings.
DEFAULTS = {
    "csv": None,
    "output_dir": "output",
    "resume": False,
    "seed": 0,
    "model": {"name": None, "output_variant": None, "batch_size": 32, "save_tile_embeddings": False, "save_slide_embeddings": False, "save_latents": False, "allow_non_recommended_settings": False},
    "tiling": {
        "backend": "auto",
        "read_coordinates_from": None,
        "read_tiles_from": None,
        "masks": {"output_mode": "per_annotation", "pixel_mapping": {"background": 0, "tissue": 1}, "colors": {"background": None, "tissue": [157, 219, 129]}, "min_coverage": {"background": None, "tissue": 0.1}},
        "params": {"requested_spacing_um": None, "tolerance": 0.05, "requested_tile_size_px": None, "requested_region_size_px": None, "region_tile_multiple": None, "overlap": 0.0},
    },
    "speed": {"precision": None, "output_dtype": None, "num_gpus": None},
}
PRECISIONS = {"fp16": "fp16", "float16": "fp16", "half": "fp16", "fp32": "fp32", "float32": "fp32", "float": "fp32", "bf16": "bf16", "bfloat16": "bf16"}


def deep_merge(base: dict, over: dict) -> dict:
    """A new map; maps in both are merged, everything else is the right one's."""
    out = copy.deepcopy(base)
    for k, v in over.items():
        out[k] = deep_merge(out[k], v) if isinstance(v, dict) and isinstance(out.get(k), dict) else copy.deepcopy(v)
    return out


def masks(over: dict | None) -> dict:
    return deep_merge(DEFAULTS["tiling"]["masks"], over or {})


def dotted(options: list[str]) -> dict:
    """Maps from `a.b=value` texts; a value is JSON where it is some, else text."""
    out: dict = {}
    for o in options:
        key, sign, text = o.partition("=")
        if not sign or not all(key.split(".")):
            raise ValueError(f"not of the form key=value: {o}")
        try:
            value = json.loads(text)
        except ValueError:
            value = None if text == "" else text
        for part in reversed(key.split(".")):
            value = {part: value}
        out = deep_merge(out, value)
    return out


def load(path: str | Path | None = None, options: list[str] = ()) -> dict:
    """Defaults, then the file, then options; a later one wins."""
    user = {}
    if path is not None:
        import yaml

        user = yaml.safe_load(Path(path).read_text()) or {}
        if not isinstance(user, dict):
            raise ValueError(f"{path} holds no map")
    return deep_merge(deep_merge(DEFAULTS, user), dotted(list(options)))


def precision(name: str | None) -> str | None:
    if name is None:
        return None
    key = str(name).strip().lower()
    if key not in PRECISIONS:
        raise ValueError(f"no such precision: {name}")
    return PRECISIONS[key]


def output_dtype(name: str | None, compute: str | None = None) -> str:
    """As asked; else half after half-precision computation, else single."""
    p = precision(name)
    if p == "bf16":
        raise ValueError("vectors can't be stored as bf16")
    return p or ("fp16" if precision(compute) == "fp16" else "fp32")


def with_encoder(cfg: dict, registry: Registry, on_cpu: bool = False) -> dict:
    """Fills spacing, tile size and precision that are null from the model, and checks what was asked for against it.

    Complaints are errors unless the settings allow them; they are returned under `warnings`.
    """
    name = cfg["model"]["name"]
    if not name:
        return cfg
    p = cfg["tiling"]["params"]
    spacing, size = registry.preprocessing(name, p["requested_spacing_um"], p["requested_tile_size_px"])
    e = registry.get(name)
    chosen = "fp32" if on_cpu else precision(cfg["speed"]["precision"]) or e.precision
    own = e.precision if on_cpu else chosen
    found = registry.validate(name, spacing, size, own, cfg["model"]["allow_non_recommended_settings"])
    over = {"tiling": {"params": regions(p | {"requested_spacing_um": spacing, "requested_tile_size_px": size})}, "speed": {"precision": chosen}, "warnings": found}
    if on_cpu:
        over["speed"]["num_gpus"] = 1
    return deep_merge(cfg, over)


def regions(p: dict) -> dict:
    """Tiling parameters with region size and multiple, each from the other; both must agree."""
    multiple, region, tile = p.get("region_tile_multiple"), p.get("requested_region_size_px"), p.get("requested_tile_size_px")
    if multiple is None and region is None:
        return p
    if tile is None:
        raise ValueError("regions need a tile size")
    multiple = region // tile if multiple is None else multiple
    region = tile * multiple if region is None else region
    if multiple < 2 or region != tile * multiple:
        raise ValueError(f"a region of {region} px does not hold {multiple} x {multiple} tiles of {tile} px")
    return p | {"region_tile_multiple": multiple, "requested_region_size_px": region}


# How tiles of several classes are kept.
OUTPUT_MODES = ("per_annotation", "merged")


def tiling(cfg: dict) -> dict:
    """What a tiler and `coverage.select` are asked for, from the settings under `tiling`, checked before any image is read.

    size_px is the region's where there are regions. by_class: whether classes other than the shipped ones are told
    apart. Classes without a least coverage make no tiles.
    """
    p, m = regions(cfg["params"]), masks(cfg.get("masks"))
    size, spacing, overlap = p.get("requested_region_size_px") or p.get("requested_tile_size_px"), p.get("requested_spacing_um"), p.get("overlap") or 0.0
    values, least = m["pixel_mapping"], m["min_coverage"]
    wrong = [
        (not size or size <= 0 or not spacing or spacing <= 0, "a tile size and a spacing above zero are needed"),
        (not 0 <= overlap < 1, f"an overlap is a part of a tile, not {overlap}"),
        (m["output_mode"] not in OUTPUT_MODES, f"no such output mode: {m['output_mode']}"),
        (any(isinstance(v, bool) or not isinstance(v, int) or not 0 <= v <= 255 for v in values.values()), f"mask values are 0 to 255: {values}"),
        (len(set(values.values())) < len(values), f"classes share mask values: {values}"),
        (any(not c or c.strip() != c or c in (".", "..", "merged") or "/" in c or "\\" in c for c in values), f"class names must do as folders: {sorted(values)}"),
        (bool(set(least) - set(values)), f"no mask values for {sorted(set(least) - set(values))}"),
        (any(v is not None and not 0 <= v <= 1 for v in least.values()), f"a least coverage is a share: {least}"),
        (all(v is None for v in least.values()), "no class makes tiles"),
    ]
    if bad := [text for failed, text in wrong if failed]:
        raise ValueError("; ".join(bad))
    step = max(1, round(size * (1 - overlap)))
    return {
        "size_px": size, "step_px": step, "spacing_um": spacing, "tolerance": p["tolerance"], "overlap": overlap, "backend": cfg.get("backend") or "auto",
        "by_class": values != DEFAULTS["tiling"]["masks"]["pixel_mapping"], "output_mode": m["output_mode"], "pixel_mapping": values, "min_coverage": least,
    }


def run_id(now: datetime) -> str:
    return now.strftime("%Y-%m-%d_%H_%M")


def run_id_of(time: Column | str) -> Column:
    """The same for a column."""
    return F.date_format(col(time), "yyyy-MM-dd_HH_mm")


def cpu_count_of(text: Column | str) -> Column:
    """The number that a text starts with, if it is positive; else null."""
    digits = F.regexp_extract(F.trim(col(text)), r"^(\d+)", 1).try_cast("int")
    return F.when(digits > 0, digits)


def cpu_limit(available: Column | str, *limits: Column | str, most: int = 64) -> Column:
    """Workers: what is available, under the first valid one of the limits and a ceiling."""
    first = F.coalesce(*(cpu_count_of(v) for v in limits), F.lit(most))
    return F.least(col(available).cast("int"), first, F.lit(most))
