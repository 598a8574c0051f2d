"""Between tiling and encoding: guards on a status table, units by class, tilings put beside their samples, records of regions without a tiler."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.operators import tables
from tesserae.operators.tables import TableError


def units(samples: DataFrame, status: DataFrame, key: str = "sample_id", named: int = 20) -> DataFrame:
    """What there is to encode: a sample's columns with those of each status row of it that has tiles, so one row for each class.

    A sample that the status table does not know, or of which any class was not tiled, is an error that names the first
    of them with what their rows say; samples and classes without tiles are left out. Status rows of other samples are
    not looked at. Columns in both tables are the status table's; the key is the samples'.
    """
    own = [c for c in samples.columns if c == key or c not in status.columns]
    known = status.join(samples.select(key).distinct(), key, "left_semi")
    lost = samples.select(key).join(known.select(key).distinct(), key, "left_anti").distinct().select(F.col(key).cast("string").alias("sample"), F.lit(None).cast("string").alias("said"), F.lit(True).alias("lost"))
    bad = known.where(~F.coalesce(F.col("tiling_status") == "success", F.lit(False))).select(F.col(key).cast("string"), F.col("error").cast("string") if "error" in status.columns else F.lit(None).cast("string"), F.lit(False))
    if found := lost.union(bad).orderBy("lost", "sample", "said").limit(named).collect():
        raise TableError("; ".join(f"{r['sample']} has no status" if r["lost"] else f"tiling failed for {r['sample']}: {r['said'] or ''}" for r in found))
    return samples.select(*own).join(tables.embeddable(known), key)


def prepared(
    samples: DataFrame, status: DataFrame, found: DataFrame | None = None, previous: DataFrame | None = None, *,
    fill: Sequence[str] = (), order: str = "written", compare: Sequence[str] = ("coordinates_npz_path", "coordinates_meta_path", "num_tiles"), restore: Sequence[str] = (),
) -> tuple[DataFrame, DataFrame]:
    """The status table after tiling, and the units in it.

    First columns of `fill` that the tiler left null are taken from what was found of a sample and class; then, where a
    row still names what it named in the table before, columns of `restore` are taken from there. Both tables have a
    column `order`, by which the last row of several counts. Ids and labels are compared null-safe.
    """
    if found is not None and fill:
        status = tables.fill_nulls(status, found, list(fill), order)
    if previous is not None and restore:
        status = tables.restore_unchanged(status, previous, order, list(compare), list(restore))
    return status, units(samples, status)


def beside(samples: DataFrame, tilings: DataFrame, key: str = "sample_id", place: str | None = None) -> DataFrame:
    """Samples with their tilings: by key, or with `place` by a number that both tables have, whatever the tilings are called.

    A sample without a tiling is an error, and so is a second tiling of a key or place; by place both tables must have
    the same ones. Tilings of other samples are left out by key. Columns in both tables are the samples'.
    """
    on = place or key
    tables.require_unique(tilings, [on], "tilings")
    extra = [c for c in tilings.columns if c not in samples.columns]
    right = tilings.select(F.col(on).alias("_on"), *extra, F.lit(True).alias("_has"))
    both = samples.join(right, samples[on] == F.col("_on"), "full" if place else "left")
    tables.require_all(both, F.col("_has") & (F.col(on).isNotNull() if place else F.lit(True)), [key, "_on"], "samples without tilings, or tilings without samples")
    return both.drop("_on", "_has")


def region_records(regions: DataFrame, order: Sequence[str] = ("y", "x"), key: str = "sample_id") -> DataFrame:
    """Regions given by their coordinates, in the columns of a tiling: numbered within the sample, read as planned, all tissue.

    regions: key, x, y, read_tile_size_px, requested_tile_size_px and read_plan (see records.READ_PLAN). A plan without
    its spacings or tolerance is an error. No mask was looked at, so the columns that a tiler would fill are constant.
    """
    p = F.col("read_plan")
    needed = [p[n] for n in ("declared_spacing_um", "read_spacing_um", "source_spacing_um", "tolerance")]
    ok = needed[0].isNotNull() & needed[1].isNotNull() & needed[2].isNotNull() & needed[3].isNotNull()
    tables.require_all(regions, ok, [key, "x", "y"], "read plans without spacings or a tolerance")
    read = F.col("read_tile_size_px").cast("int")
    numbered = F.row_number().over(Window.partitionBy(key).orderBy(*order, "x", "y")) - 1
    others = [c for c in regions.columns if c not in {key, "x", "y", "read_tile_size_px", "requested_tile_size_px", "read_plan"}]
    return regions.select(
        key, numbered.alias("tile_index"), F.col("x").cast("long").alias("x"), F.col("y").cast("long").alias("y"), F.col("requested_tile_size_px").cast("int").alias("requested_tile_size_px"),
        needed[0].alias("requested_spacing_um"), p["read_level"].alias("read_level"), read.alias("read_tile_size_px"), needed[1].alias("read_spacing_um"), read.alias("tile_size_lv0"), read.alias("step_px_lv0"),
        F.coalesce(p["is_within_tolerance"], F.lit(False)).alias("is_within_tolerance"), needed[2].alias("base_spacing_um"), p["spacing_at_level_0"].alias("spacing_at_level_0"), needed[3].alias("tolerance"),
        F.lit(1.0).cast("float").alias("tissue_fraction"), F.lit(0.0).alias("min_tissue_fraction"), F.lit(0.0).alias("overlap"), F.lit("none").alias("tissue_method"), *others,
    )
