"""Artifact tables: payload rows by kind and class, then one metadata row for each unit.

Both become visible in one commit (see `commits`): a run that dies between them leaves nothing that is read, and
metadata is derived from the payload as it was stored, so vectors are made once.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tesserae.functions.expressions import artifact_label
from tesserae.sources.commits import Table

KINDS = ("tile_embeddings", "hierarchical_embeddings", "slide_embeddings", "slide_latents", "patient_embeddings", "dense_embeddings", "image_embeddings")


def path_of(root: str, kind: str) -> str:
    if kind not in KINDS:
        raise ValueError(f"no such kind of artifact: {kind}")
    return f"{root}/{kind}"


def write(payload: DataFrame, metadata: Callable[[DataFrame], DataFrame], root: str, kind: str, mode: str = "append", run: str | None = None) -> bool:
    """Stores a payload and the metadata that is made from the stored rows, in one commit; False if the run is there already.

    A payload with classes is partitioned by them; flat labels have none. mode: append, or overwrite.
    """
    if mode not in ("append", "overwrite"):
        raise ValueError(f"no such mode: {mode}")
    classes = "annotation" in payload.columns and kind != "patient_embeddings"
    out = payload.withColumn("annotation", artifact_label("annotation")) if classes else payload
    table = Table(payload.sparkSession, path_of(root, kind))
    return table.commit({"payload": out, "metadata": lambda stored: metadata(stored["payload"])}, run, mode == "overwrite", {"payload": ["annotation"]} if classes else None)


def write_tiles(bag: DataFrame, manifest: DataFrame, root: str, mode: str = "append", run: str | None = None) -> bool:
    """Tile bags (sample_id, annotation, tile_index, embedding), and metadata for all units of the manifest, also those without tiles."""

    def metadata(stored: DataFrame) -> DataFrame:
        sizes = stored.groupBy(F.col("sample_id").alias("_s"), F.col("annotation").alias("_a")).agg(F.count("*").alias("num_tiles"), F.max(F.size("embedding")).alias("feature_dim"))
        on = (manifest["sample_id"] == F.col("_s")) & artifact_label(manifest["annotation"]).eqNullSafe(F.col("_a"))
        return manifest.join(sizes, on, "left").select(*manifest.columns, F.coalesce("num_tiles", F.lit(0)).alias("num_tiles"), "feature_dim")

    return write(bag, metadata, root, "tile_embeddings", mode, run)


def write_vectors(vectors: DataFrame, root: str, kind: str, mode: str = "append", run: str | None = None) -> bool:
    """Slide, patient or image vectors; metadata is their dimension."""
    return write(vectors, lambda stored: stored.select(*(c for c in stored.columns if c != "embedding"), F.size("embedding").alias("feature_dim")), root, kind, mode, run)


def write_grids(cells: DataFrame, root: str, keys: list[str], mode: str = "append", run: str | None = None) -> bool:
    """Grids as rows of cells (keys, h, w, vector); metadata is a row for each grid with its size and dimension."""

    def metadata(stored: DataFrame) -> DataFrame:
        return stored.groupBy(*keys).agg((F.max("h") + 1).alias("grid_h"), (F.max("w") + 1).alias("grid_w"), F.count("*").alias("cells"), F.max(F.size("vector")).alias("feature_dim"))

    return write(cells, metadata, root, "dense_embeddings", mode, run)


def stored(spark: SparkSession, root: str, kind: str, part: str) -> DataFrame:
    rows = Table(spark, path_of(root, kind)).read(part)
    if rows is None:
        raise FileNotFoundError(f"no {kind} in {root}")
    return rows


def exists(spark: SparkSession, root: str, kind: str) -> bool:
    return bool(Table(spark, path_of(root, kind)).entries())


def read(spark: SparkSession, root: str, kind: str) -> DataFrame:
    """Payload rows of all commits. Classes stay text: the schema is kept with the commit, not guessed from folders."""
    return stored(spark, root, kind, "payload")


def read_metadata(spark: SparkSession, root: str, kind: str) -> DataFrame:
    return stored(spark, root, kind, "metadata")
