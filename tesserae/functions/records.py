"""Records kept beside artifacts, as structs: read plans, compatibility, metadata; and JSON to and from them."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tesserae.functions.expressions import artifact_label, col, structural_label

# Fields of records, in order.
READ_PLAN = (
    "reader_regime string, spacing_source string, declared_spacing_um double, source_spacing_um double, spacing_at_level_0 double, "
    "read_spacing_um double, effective_spacing_um double, requested_backend string, backend string, tolerance double, read_level int, "
    "is_within_tolerance boolean, read_size array<int>, output_size array<int>"
)
TILE_METADATA = (
    "encoder_name string, encoder_level string, coordinates_npz_path string, coordinates_meta_path string, tiles_tar_path string, image_path string, "
    "mask_path string, tile_size_lv0 int, backend string, read_tile_size_px int, requested_tile_size_px int, encoder_input_size_px int, requested_spacing_um double"
)
SLIDE_METADATA = "encoder_name string, encoder_level string, image_path string"
HIERARCHICAL_METADATA = (
    "encoder_name string, encoder_level string, coordinates_npz_path string, coordinates_meta_path string, image_path string, mask_path string, backend string, "
    "region_tile_multiple int, requested_tile_size_px int, read_tile_size_px int, requested_region_size_px int, read_region_size_px int, requested_spacing_um double, "
    "encoder_input_size_px int, subtile_order string"
)
IMAGE_METADATA = (
    "artifact_type string, sample_id string, image_path string, format string, encoder_name string, encoder_level string, encoder_input_regime string, "
    "encoder_input_size_px int, feature_dtype string"
)
#: Fields that hold an empty text where nothing is known.
BLANK = ("coordinates_npz_path", "coordinates_meta_path", "tiles_tar_path")


def fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(f.split(" ", 1)) for f in schema.split(", ")]


def record(schema: str, **values: Column | str | int | float | None) -> Column:
    """Struct of a schema. Fields come from values (columns, or literals), and are null if they aren't given."""
    unknown = sorted(values.keys() - {n for n, _ in fields(schema)})
    if unknown:
        raise ValueError(f"no such fields: {', '.join(unknown)}")

    def one(name: str, kind: str) -> Column:
        v = values.get(name)
        c = (v if isinstance(v, Column) else F.lit(v)).cast(kind)
        return (F.coalesce(c, F.lit("")) if name in BLANK else c).alias(name)

    return F.struct(*(one(n, k) for n, k in fields(schema)))


def merged(base: dict[str, Column], *more: dict[str, Column]) -> Column:
    """Struct of columns by name; a later one of the same name replaces an earlier one in its place."""
    out = dict(base)
    for m in more:
        out |= m
    return F.struct(*(c.alias(n) for n, c in out.items()))


def as_json(r: Column | str) -> Column:
    """JSON with every field, nulls too."""
    return F.to_json(col(r), {"ignoreNullFields": "false"})


def from_json(text: Column | str, schema: str) -> Column:
    """The record in a JSON text; a text that is no such object is an error."""
    return F.from_json(col(text), schema, {"mode": "FAILFAST"})


# Read plans


def level_choice(requested: Column | str, level0: Column | str, downsamples: Column | str, tolerance: float) -> Column:
    """Struct (level, spacing, within): the coarsest level that is not coarser than asked, or one within the tolerance.

    A level within the tolerance comes first, the nearest one; else the coarsest that is finer than asked; else level 0.
    """
    r, s0 = col(requested).cast("double"), col(level0).cast("double")
    levels = F.transform(col(downsamples), lambda d, i: F.struct((s0 * d).alias("spacing"), i.cast("int").alias("level")))
    near = F.array_sort(F.filter(F.transform(levels, lambda v: F.struct(F.abs(v["spacing"] - r).alias("off"), v["level"].alias("level"), v["spacing"].alias("spacing"))), lambda v: v["off"] <= tolerance * r))
    finer = F.array_max(F.filter(levels, lambda v: v["spacing"] <= r))
    choice = lambda level, spacing, within: F.struct(level.alias("level"), spacing.alias("spacing"), F.lit(within).alias("within"))
    first = F.get(near, F.lit(0))
    return (
        F.when(F.size(near) > 0, choice(first["level"], first["spacing"], True))
        .when(finer.isNotNull(), choice(finer["level"], finer["spacing"], False))
        .otherwise(choice(F.lit(0), s0 * F.get(col(downsamples), F.lit(0)), False))
    )


def image_plan(choice: Column | str, height: Column | str, width: Column | str, requested: Column | str, **known: Column | str | float) -> Column:
    """Plan of a whole level: its own size within the tolerance, else scaled to the requested spacing, halves to even."""
    c, r = col(choice), col(requested).cast("double")
    side = lambda n: F.when(c["within"], col(n).cast("int")).otherwise(F.bround(col(n) * (c["spacing"] / r)).cast("int"))
    return record(
        READ_PLAN, reader_regime="spacing-readable", declared_spacing_um=r, read_spacing_um=c["spacing"], effective_spacing_um=F.when(c["within"], c["spacing"]).otherwise(r),
        read_level=c["level"], is_within_tolerance=c["within"], read_size=F.array(col(height), col(width)), output_size=F.array(side(height), side(width)), **known,
    )


def region_plan(choice: Column | str, size: Column | str, requested: Column | str, **known: Column | str | float) -> Column:
    """Plan of a square region: `size` pixels at the requested spacing, read at the level's."""
    c, r, s = col(choice), col(requested).cast("double"), col(size).cast("int")
    read = F.when(c["within"], s).otherwise(F.bround(s * r / c["spacing"]).cast("int"))
    return record(
        READ_PLAN, reader_regime="spacing-readable", spacing_source="explicit", declared_spacing_um=r, read_spacing_um=c["spacing"], effective_spacing_um=F.when(c["within"], c["spacing"]).otherwise(r),
        read_level=c["level"], is_within_tolerance=c["within"], read_size=F.array(read, read), output_size=F.array(s, s), **known,
    )


def raster_plan(spacing_source: str, declared: Column | str | None, requested_backend: str) -> Column:
    """Plan of an image without a pyramid: nothing to choose."""
    declared = F.lit(None) if declared is None else col(declared)
    return record(READ_PLAN, reader_regime="raster", spacing_source=spacing_source, declared_spacing_um=declared, source_spacing_um=declared, effective_spacing_um=declared, requested_backend=requested_backend, backend="pil")


def image_recipe(recipe: dict[str, Column], plan: Column | str, sample: Column | str, path: Column | str) -> Column:
    """What an image's grid must agree in to be kept: identity, encoder, read plan, then the rest of the recipe. The plan's fields come before the recipe's own of the same name."""
    p = {n: col(plan)[n] for n, _ in fields(READ_PLAN)}
    who = {"sample_id": col(sample), "image_path": col(path)} | {n: recipe[n] for n in ("encoder_name", "output_variant")}
    return merged(who, p, {n: c for n, c in recipe.items() if n not in p and n not in who})


def region_compatibility(plan: Column | str, read_px: Column | str, requested_px: Column | str) -> Column:
    """What a region's record must agree in to be kept: the read plan and both sizes."""
    p = {n: col(plan)[n] for n, _ in fields(READ_PLAN)}
    return merged(p, {"read_tile_size_px": col(read_px).cast("int"), "requested_tile_size_px": col(requested_px).cast("int")})


# Metadata


def hierarchical_geometry(region_px: Column | str, multiple: Column | str, read_tile_px: Column | str, read_spacing: Column | str, base_spacing: Column | str) -> Column:
    """Struct of a region's tile geometry; sizes at level 0 are rounded, halves to even. Null where the multiple doesn't divide the region."""
    r, m, t = col(region_px).cast("int"), col(multiple).cast("int"), col(read_tile_px).cast("int")
    lv0 = F.bround(t * col(read_spacing) / col(base_spacing)).cast("int")
    out = F.struct(
        m.alias("region_tile_multiple"), F.floor(r / m).cast("int").alias("requested_tile_size_px"), t.alias("read_tile_size_px"),
        r.alias("requested_region_size_px"), (t * m).alias("read_region_size_px"), lv0.alias("tile_size_lv0"), (m * m).alias("tiles_per_region"),
    )
    return F.when((m >= 2) & (F.pmod(r, m) == 0), out)


def artifact_metadata(kind: str, metadata: dict[str, Column], label: Column | str | None = None, **base: Column) -> Column:
    """Artifact type and base fields, then metadata; the label comes last and normalised whatever metadata says."""
    own = {"artifact_type": F.lit(kind)} | base
    return merged(own, metadata, {} if label is None else {"annotation": artifact_label(label)})


def region_metadata(sample: Column | str, label: Column | str, x: Column | str, y: Column | str, geometry: Column | str, patch: int, dim: Column | str, compatibility: Column, dense: dict[str, Column]) -> Column:
    """Record of a dense region: identity, geometry, read plan, encoding options and the compatibility they give."""
    g = col(geometry)
    pair = lambda c: F.array(c.cast("int"), c.cast("int"))
    own = {
        "artifact_type": F.lit("dense_embeddings"), "sample_id": col(sample), "annotation": structural_label(label), "x": col(x).cast("long"), "y": col(y).cast("long"), "feature_dim": col(dim).cast("int"),
        "grid_shape": pair(g["grid"]), "target_size": pair(g["encoded"] - g["pad"]), "patch_size": pair(F.lit(patch)), "encoded_size": pair(g["encoded"]), "pad": pair(g["pad"]),
    }
    flat = {n: compatibility[n] for n in [*(n for n, _ in fields(READ_PLAN)), "read_tile_size_px", "requested_tile_size_px"]}
    return merged(own, flat, dense, {"compatibility": compatibility})
