"""Recipes of requests for grids, settled from registry and options before any image is read, and the records they give."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions import contracts, records
from tesserae.functions.registry import Registry
from tesserae.plans import settings

# Fields of a recipe, in order, that are not those of a read plan.
RECIPE = (
    "read_tile_size_px int, requested_tile_size_px int, target_size array<int>, patch_size array<int>, encoded_size array<int>, pad array<int>, grid_shape array<int>, pad_mode string, "
    "image_pad_value double, window_size int, overlap double, feature_kind string, attention_blocks array<int>, attention_include_registers boolean, precision string, dtype string"
)
# Fields of the record beside an image's grid, in order, before its compatibility.
GRID_RECORD = (
    "artifact_type sample_id image_path format dtype feature_dim grid_shape target_size patch_size encoded_size pad encoder_name encoder_level encoder_input_regime reader_regime spacing_source "
    "declared_spacing_um source_spacing_um spacing_at_level_0 read_spacing_um effective_spacing_um requested_backend backend tolerance read_level is_within_tolerance read_size output_size "
    "read_tile_size_px requested_tile_size_px pad_mode image_pad_value window_size overlap feature_kind attention_blocks attention_include_registers"
).split()
STORED = {"fp16": "float16", "fp32": "float32"}


def image_grids(
    registry: Registry, name: str, target: int | tuple[int, int], *, precision: str | None, output_dtype: str | None = None, variant: str | None = None, window: int | None = None, overlap: float = 0.0,
    pad_mode: str = "reflect", pad_value: float | None = None, kind: str = contracts.KINDS[0], blocks: tuple[int, ...] = (), registers: bool = False,
    spacing: float | None = None, source: str | None = None, regime: str = "raster", backend: str = "auto",
) -> dict[str, object]:
    """What a request for grids of images is settled to, as plain values; asks the encoder's contract, and raises on what does not go together.

    The precision has to be known. Without a spacing its source is unknown, else explicit, unless it is named.
    """
    if precision is None:
        raise ValueError("settle the precision before the recipe")
    plan = contracts.dense_input(registry, name, target, window, overlap)
    layout = plan.layout
    contracts.check_dense(layout, pad_mode, kind, tuple(blocks), registers)
    return {
        "encoder_name": registry.get(name).name, "output_variant": registry.variant(name, variant)[0], "encoder_level": registry.get(name).level, "reader_regime": regime,
        "spacing_source": source or ("unknown" if spacing is None else "explicit"), "declared_spacing_um": spacing, "requested_backend": backend,
        "read_tile_size_px": None, "requested_tile_size_px": None, "target_size": layout.target, "patch_size": layout.patch, "encoded_size": layout.encoded, "pad": layout.pad, "grid_shape": layout.grid,
        "pad_mode": pad_mode, "image_pad_value": pad_value, "window_size": window, "overlap": float(overlap), "feature_kind": kind, "attention_blocks": tuple(blocks), "attention_include_registers": registers,
        "precision": settings.precision(precision), "dtype": STORED[settings.output_dtype(output_dtype, precision)],
    }


def _columns(recipe: dict[str, object]) -> dict[str, Column]:
    lit = lambda v, kind: (F.array(*map(F.lit, v)) if isinstance(v, tuple) else F.lit(v)).cast(kind)
    own = {n: lit(recipe[n], kind) for n, kind in records.fields(RECIPE)}
    return {n: F.lit(recipe[n]) for n in ("encoder_name", "output_variant", "reader_regime", "spacing_source")} | own


def compatibility(recipe: dict[str, object], sample: Column | str, path: Column | str, plan: Column | str | None = None) -> Column:
    """What an image's grid must agree in to be kept. Without a read plan the image is a raster of the recipe's spacing."""
    plan = records.raster_plan(recipe["spacing_source"], F.lit(recipe["declared_spacing_um"]).cast("double"), recipe["requested_backend"]) if plan is None else plan
    return records.image_recipe(_columns(recipe), plan, sample, path)


def image_grid_record(recipe: dict[str, object], sample: Column | str, path: Column | str, dim: Column | str, plan: Column | str | None = None, form: str = "parquet") -> Column:
    """The record beside an image's grid: what was encoded, how, and the compatibility it came with."""
    same = compatibility(recipe, sample, path, plan)
    known = {"artifact_type": F.lit("dense_image_embeddings"), "format": F.lit(form), "feature_dim": records.col(dim).cast("int"), "encoder_level": F.lit(recipe["encoder_level"]), "encoder_input_regime": F.lit("declared")}
    return F.struct(*((known[n] if n in known else same[n]).alias(n) for n in GRID_RECORD), same.alias("compatibility"))
