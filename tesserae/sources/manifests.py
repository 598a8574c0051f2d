"""Scans of manifests, status tables, event logs and trial results. Ids stay text; blank is null."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.expressions import blank_to_null, path_stem
from tesserae.operators.tables import TableError, require_all, require_unique

# Columns of the status table, in order.
TILING_COLUMNS = (
    "sample_id", "annotation", "output_mode", "image_path", "mask_path", "requested_backend", "backend", "requested_mask_backend", "mask_backend",
    "spacing_at_level_0", "tiling_status", "num_tiles", "coordinates_npz_path", "coordinates_meta_path", "tiles_tar_path", "mask_preview_path",
    "tiling_preview_path", "error", "traceback",
)
EMBEDDING_COLUMNS = ("feature_status", "feature_path", "encoder_name", "output_variant", "feature_kind")
#: Columns that must be there; those of older tables that are refused.
REQUIRED_STATUS = ("sample_id", "annotation", "image_path", "tiling_status", "num_tiles")
NUMBERS = {"spacing_at_level_0": "double", "num_tiles": "int"}


def text_csv(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """A CSV of which every column is text, blanks as null."""
    df = spark.read.option("header", True).option("inferSchema", False).option("multiLine", True).option("escape", '"').csv(path if isinstance(path, str) else list(path))
    return df.select(*(blank_to_null(F.col(f"`{c}`")).alias(c) for c in df.columns))


def need(df: DataFrame, columns: Sequence[str], what: str) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise TableError(f"{what} lacks {', '.join(missing)}")
    return df


def with_columns(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Projects to the columns in order; those not there are null, others go."""
    return df.select(*((F.col(c) if c in df.columns else F.lit(None).cast("string")).cast(NUMBERS.get(c, "string")).alias(c) for c in columns))


def slides(spark: SparkSession, path: str, refused: Sequence[str] = ("wsi_path", "tissue_mask_path")) -> DataFrame:
    """Slide manifest: sample_id (unique), image_path, mask_path, spacing_at_level_0."""
    df = need(text_csv(spark, path), ("sample_id", "image_path"), path)
    old = [c for c in refused if c in df.columns]
    if old:
        raise TableError(f"{path} has columns of an old format: {', '.join(old)}")
    out = with_columns(df, ("sample_id", "image_path", "mask_path", "spacing_at_level_0"))
    out = require_all(out, F.col("sample_id").isNotNull() & F.col("image_path").isNotNull(), ["sample_id", "image_path"], "slides without id or path")
    return require_unique(out, ["sample_id"], "slides")


def slides_of(spark: SparkSession, paths: Sequence[str]) -> DataFrame:
    """Slides from paths; the id is the file's stem."""
    df = spark.createDataFrame([(p,) for p in paths], "image_path string")
    return require_unique(with_columns(df.withColumn("sample_id", path_stem("image_path")), ("sample_id", "image_path", "mask_path", "spacing_at_level_0")), ["sample_id"], "slides")


def resolve(spark: SparkSession, paths: Sequence[str] | None = None, manifest: str | None = None) -> DataFrame:
    """Slides given directly, else those of a manifest, else none."""
    if paths:
        return slides_of(spark, paths)
    if manifest:
        return slides(spark, manifest)
    return spark.createDataFrame([], "sample_id string, image_path string, mask_path string, spacing_at_level_0 double")


def patients(spark: SparkSession, path: str) -> DataFrame:
    """(sample_id, patient_id); an error names all samples without a patient."""
    df = need(text_csv(spark, path), ("sample_id", "patient_id"), path)
    return require_unique(require_all(df.select("sample_id", "patient_id"), F.col("patient_id").isNotNull(), ["sample_id"], "samples without a patient"), ["sample_id"], "samples")


def status(spark: SparkSession, path: str) -> DataFrame:
    """Status table after tiling; columns of later versions are null in older tables."""
    df = need(text_csv(spark, path), REQUIRED_STATUS, path)
    out = with_columns(df, TILING_COLUMNS)
    return out.withColumn("output_mode", F.coalesce("output_mode", F.when(F.col("annotation") == "merged", "merged")))


def embedding_status(spark: SparkSession, path: str, aggregation: bool = False) -> DataFrame:
    """Status table after embedding. Only statuses whose column isn't there are `tbp`."""
    df = need(text_csv(spark, path), REQUIRED_STATUS, path)
    tail = ("error", "traceback")
    columns = [*TILING_COLUMNS[:-2], *EMBEDDING_COLUMNS, *(("aggregation_status",) if aggregation else ()), *tail]
    new = [c for c in ("feature_status", "aggregation_status") if c in columns and c not in df.columns]
    return with_columns(df, columns).withColumns({c: F.lit("tbp") for c in new})


def progress(spark: SparkSession, path: str | Sequence[str]) -> DataFrame:
    """Event log(s), one JSON object a line: kind, payload (JSON text) and ts. Lines that are no whole object are left out."""
    df = spark.read.schema("kind string, payload string, timestamp double, _bad string").option("columnNameOfCorruptRecord", "_bad").json(path if isinstance(path, str) else list(path))
    return df.where("_bad IS NULL").select("kind", "payload", F.timestamp_micros((F.col("timestamp") * 1e6).cast("long")).alias("ts"))


def trials(spark: SparkSession, paths: Sequence[str], numbers: Sequence[str]) -> DataFrame:
    """Trial results of several files; the named columns as doubles, blanks null."""
    df = text_csv(spark, paths)
    return df.select(*(F.col(c).try_cast("double").alias(c) if c in numbers else F.col(c) for c in df.columns))


def save_csv(rows: DataFrame, path: str, mode: str = "overwrite") -> bool:
    """Writes a folder of CSV parts with headers; nothing, and False, without rows."""
    if rows.isEmpty():
        return False
    rows.write.mode(mode).option("header", True).option("escape", '"').csv(path)
    return True


def save_slides(rows: DataFrame, path: str) -> bool:
    """A slide manifest that `slides` reads back; columns without any value are left out, but for id and path."""
    optional = [c for c in ("mask_path", "spacing_at_level_0") if c in rows.columns]
    used = rows.agg(*(F.count(c).alias(c) for c in optional)).first() if optional else {}
    return save_csv(rows.select("sample_id", "image_path", *(c for c in optional if used[c])), path)
