"""Entry points: an encoder bound to requests, and the run from a manifest to stored vectors.

All slides go through one plan; ranks and shards are Spark's partitions. Tables: slides (sample_id, image_path,
...), tiles (sample_id, annotation, tile_index, x, y and the column that the encoder reads), patients
(sample_id, patient_id).
"""

from __future__ import annotations

import uuid
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tesserae.functions import contracts, encoders
from tesserae.functions.expressions import artifact_label, has_tiles
from tesserae.functions.registry import Encoder, Registry, token_udf, vector_udf
from tesserae.operators import aggregate, dense, tables, tiling
from tesserae.sources import artifacts, regions

UNIT = ("sample_id", "annotation")
REGION = (*UNIT, "x", "y")


@dataclass
class Model:
    """An encoder and, above tiles, the tile encoder that feeds it."""

    encoder: Encoder
    variant: str
    dim: int
    registry: Registry
    #: Aggregates the vectors of one unit, (bag as DataFrame) to vector; without one, their mean in two Spark aggregations.
    pool: object = None

    @classmethod
    def from_preset(cls, name: str, variant: str | None = None, registry: Registry | None = None, pool=None) -> Model:
        r = registry or encoders.catalogue()
        e = r.get(name)
        v, dim = r.variant(name, variant)
        return cls(e, v, dim, r, pool)

    @property
    def level(self) -> str:
        return self.encoder.level

    def need(self, *levels: str) -> None:
        if self.level not in levels:
            raise ValueError(f"{self.encoder.name} works on {self.level}s, not on {' or '.join(levels)}s")

    def embed_tiles(self, tiles: DataFrame, pixels: str = "pixels", tile_size: int | None = None, allow: bool = False) -> DataFrame:
        """Tiles with their vectors in place of what the encoder read. A tile_size, if told, must be one that the encoder takes, and its own unless others are allowed."""
        if tile_size is not None:
            contracts.pooled_input(self.registry, self.encoder.name, tile_size, allow)
        tile = self.registry.tile_of(self.encoder.name)
        if tile.make is None:
            raise ValueError(f"{tile.name} has no implementation; plug one in")
        dim = self.dim if self.level == "tile" else self.registry.variant(tile.name)[1]
        return tiles.select(*(c for c in tiles.columns if c != pixels), vector_udf(tile, dim)(pixels).alias("embedding"))

    embed_images = embed_tiles

    def aggregate_tiles(self, bags: DataFrame) -> DataFrame:
        """One vector of each (sample_id, annotation), null-safe; bags without rows have none.

        A plugged-in pool sees one unit's whole bag in a task, in tile order; bags are bounded by a slide's tiles.
        """
        if self.pool is None:
            return aggregate.pool_mean(bags, UNIT, "embedding", "embedding")
        pool = self.pool

        def one(key, bag):
            import pandas as pd

            bag = bag.sort_values("tile_index", kind="stable")
            return pd.DataFrame({"sample_id": [key[0]], "annotation": [key[1]], "embedding": [pool(bag)]})

        return bags.groupBy(*UNIT).applyInPandas(one, "sample_id string, annotation string, embedding array<double>")

    def embed_slides(self, tiles: DataFrame, annotations: Sequence[str] | None = None, pixels: str = "pixels") -> DataFrame:
        """Vectors of tiles (tile encoders) or slides, by sample and class; only the named classes if there are any."""
        wanted = tiles if annotations is None else tiles.where(F.col("annotation").isin(*annotations))
        out = self.embed_tiles(wanted, pixels)
        return out if self.level == "tile" else self.aggregate_tiles(out)

    def embed_slide(self, tiles: DataFrame, sample_id: str, annotation: str | None = None, pixels: str = "pixels") -> DataFrame:
        """One slide. A class that it doesn't have is an error that names those it has."""
        mine = tiles.where(F.col("sample_id") == sample_id)
        if annotation is not None:
            have = sorted(r[0] for r in mine.select("annotation").where("annotation is not null").distinct().collect())
            if annotation not in have:
                raise KeyError(f"{sample_id} has no class {annotation}, but {have}")
        return self.embed_slides(mine, None if annotation is None else [annotation], pixels)

    def embed_patients(self, tiles: DataFrame, patients: DataFrame | None = None, pixels: str = "pixels") -> DataFrame:
        """patient_id, number of slides and vector; a slide without a patient is its own."""
        self.need("patient")
        slides = self.aggregate_tiles(self.embed_tiles(tiles, pixels))
        return pool_patients(slides, patients)

    def embed_patient(self, tiles: DataFrame, patient_id: str, pixels: str = "pixels") -> DataFrame:
        """All given slides as those of one patient."""
        who = tiles.select("sample_id").distinct().withColumn("patient_id", F.lit(patient_id))
        return self.embed_patients(tiles, who, pixels)

    def embed_regions_dense(self, regions: DataFrame, target: int | tuple[int, int], keys: Sequence[str] = REGION, **more) -> DataFrame:
        """Regions (keys, pixels) of one size to grids: see `embed_grids`."""
        return self.embed_grids(regions, target, keys, **more)

    def embed_images_dense(self, images: DataFrame, target: int | tuple[int, int], **more) -> DataFrame:
        return self.embed_grids(images, target, ("sample_id",), **more)

    def embed_coordinates_dense(self, requests: DataFrame, open_image, target: int | tuple[int, int], keys: Sequence[str] = REGION, supertile: int = 1, **more) -> DataFrame:
        """Regions given by place (keys, image_path, level, read_px) to grids; pixels are read by the opener, in super-tiles."""
        self.dense_plan(target, more.get("window"), more.get("overlap", 0.0))  # before anything is read
        wanted = requests.select(*dict.fromkeys((*keys, "image_path", "x", "y", "level", "read_px")))
        return self.embed_regions_dense(regions.read_regions(wanted, open_image, supertile), target, keys, **more)

    def dense_plan(self, target: int | tuple[int, int], window: int | None = None, overlap: float = 0.0) -> contracts.InputPlan:
        """What reaches the encoder; one that cannot take that size is refused here."""
        self.need("tile")
        if self.encoder.make is None or self.encoder.patch is None:
            raise ValueError(f"{self.encoder.name} has no implementation or no patches; plug one in")
        return contracts.dense_input(self.registry, self.encoder.name, target, window, overlap)

    def embed_grids(self, images: DataFrame, target: int | tuple[int, int], keys: Sequence[str] = ("sample_id",), window: int | None = None, overlap: float = 0.0, pad_mode: str = "reflect", pixels: str = "pixels", channels: int = 1) -> DataFrame:
        """Images of one size to grids: (keys, h, w, vector), from windows that are encoded apart and blended on both axes."""
        layout = self.dense_plan(target, window, overlap).layout
        contracts.check_dense(layout, pad_mode)
        cut = dense.cut(images.select(*keys, pixels), layout, pixels, channels, pad_mode)
        tokens = token_udf(self.encoder, layout.tokens[0] * layout.tokens[1], self.dim)(pixels)
        return dense.blend(cut.select(*keys, "win_y", "win_x", tokens.alias("tokens")), keys, layout)


def pool_patients(slides: DataFrame, patients: DataFrame | None = None) -> DataFrame:
    """Slide vectors (sample_id, embedding) to patient vectors. An own id stands in where the map has none."""
    if patients is None:
        named = slides.withColumn("patient_id", F.col("sample_id").cast("string"))
    else:
        named = tables.patients_of(slides, patients.select("sample_id", "patient_id"))
    n = named.groupBy("patient_id").agg(F.count_distinct("sample_id").alias("num_slides"))
    return aggregate.pool_mean(named, ["patient_id"], "embedding", "embedding").join(n, "patient_id")


def slide_vectors_of(slides: DataFrame, patients: DataFrame) -> DataFrame:
    """patient_id and a map from its samples to their vectors; of repeated samples the last class in order stays."""
    last = tables.last_by(tables.patients_of(slides, patients), ["patient_id", "sample_id"], "annotation", ["embedding"])
    return aggregate.nested(last, "patient_id", "sample_id", "embedding", "slide_embeddings")


@dataclass
class Result:
    """Tables of a run; a kind that the run doesn't make is None."""

    status: DataFrame
    tiles: DataFrame | None = None
    slides: DataFrame | None = None
    patients: DataFrame | None = None
    skipped: DataFrame | None = None


@dataclass
class Pipeline:
    """Runs a model over a manifest and stores what it makes under root."""

    model: Model
    root: str
    resume: bool = False
    save_tiles: bool = False
    save_slides: bool = False
    #: Samples after which tile vectors are committed; 0: all at once.
    checkpoint: int = 1000

    def stored(self) -> str:
        return {"tile": "tile_embeddings", "slide": "slide_embeddings", "patient": "patient_embeddings"}[self.model.level]

    def units(self, slides: DataFrame, tiles: DataFrame) -> DataFrame:
        """Units of the manifest with their number of tiles: (sample_id, annotation, num_tiles), 0 for slides without any."""
        counts = tiles.groupBy("sample_id", artifact_label("annotation").alias("annotation")).agg(F.count("*").alias("num_tiles"))
        return slides.select("sample_id").distinct().join(counts, "sample_id", "left").select("sample_id", "annotation", F.coalesce("num_tiles", F.lit(0)).alias("num_tiles"))

    def done(self, spark) -> DataFrame | None:
        """Units whose metadata is stored; patients are never resumed.

        The scan lists its files here, so what the run appends later does not change what is left to do.
        """
        return None if self.model.level == "patient" else self.finished(spark, self.stored())

    def finished(self, spark, kind: str) -> DataFrame | None:
        """On resume: units whose metadata of a kind is stored."""
        if not self.resume or not artifacts.exists(spark, self.root, kind):
            return None
        return artifacts.read_metadata(spark, self.root, kind).select("sample_id", artifact_label("annotation").alias("annotation"))

    def batches(self, units: DataFrame) -> list[Column]:
        """Conditions that cut units into ranges of about `checkpoint` samples each. Ranges, so that a scan of tiles stored by sample reads a batch's row groups only."""
        samples = units.select("sample_id").distinct()
        n = -(-samples.count() // self.checkpoint) if self.checkpoint else 1
        if n <= 1:
            return [F.lit(True)]
        ends = samples.repartitionByRange(n, "sample_id").groupBy(F.spark_partition_id()).agg(F.max("sample_id").alias("top")).select("top").collect()
        tops = sorted(r.top for r in ends)[:-1]
        at = F.col("sample_id")
        return [F.lit(True) if not tops else at <= tops[0], *((at > a) & (at <= b) for a, b in zip(tops, tops[1:])), *([at > tops[-1]] if tops else [])]

    def parked(self, df: DataFrame) -> DataFrame:
        """Written and read back, where more than one plan reads what encoders have made."""
        path = f"{self.root}/_work/{uuid.uuid4().hex}"
        df.write.parquet(path)
        return df.sparkSession.read.schema(df.schema).parquet(path)

    def run(self, slides: DataFrame, tiles: DataFrame, patients: DataFrame | None = None, tiling_only: bool = False, pixels: str = "pixels") -> Result:
        """Tiles of slides in the manifest to stored vectors, and a status row of each unit.

        Units without tiles get metadata and no payload; units that are stored already are left out on resume.
        What was stored is read back, so a vector is made once, and tiles are committed after each `checkpoint`
        samples, so a run that dies loses one batch. On resume only units that were not done are pooled
        and stored; their tiles are taken from the store where an earlier run has finished them.
        """
        spark = slides.sparkSession
        tables.require_unique(slides, ["sample_id"], "slides")
        tiles = tiles.withColumn("annotation", artifact_label("annotation"))
        units = self.units(slides, tiles)
        status = units.withColumn("tiling_status", F.lit("success"))
        if tiling_only:
            return Result(status.withColumn("feature_status", F.lit("tbp")))
        done = self.done(spark)
        todo = units if done is None else tables.pending(units, done, UNIT)
        have = todo.where(has_tiles("num_tiles"))
        mine = tiles.join(have.select(F.col("sample_id").alias("_s"), F.col("annotation").alias("_a")), (F.col("sample_id") == F.col("_s")) & F.col("annotation").eqNullSafe(F.col("_a")), "left_semi")
        out = Result(status)
        vectors = self.model.embed_tiles(mine, pixels)
        if self.model.level == "tile" or self.save_tiles:
            new, rows = todo, mine
            if (stored := self.finished(spark, "tile_embeddings")) is not None:
                new = tables.pending(todo, stored, UNIT)
                rows = rows.join(stored, tables.same_unit(rows, stored, UNIT), "left_anti")
            mode = "append" if self.resume else "overwrite"
            for batch in self.batches(new):
                # Rows are cut before they are encoded: no filter is pushed below an encoder.
                bag = self.model.embed_tiles(rows.where(batch), pixels).select(*UNIT, "tile_index", "embedding")
                artifacts.write_tiles(bag, new.where(batch).select(*UNIT), self.root, mode)
                mode = "append"
            out.tiles = artifacts.read(spark, self.root, "tile_embeddings")
            vectors = out.tiles.join(have, tables.same_unit(out.tiles, have, UNIT), "left_semi")
        if self.model.level != "tile":
            pooled = self.model.aggregate_tiles(vectors)
            if self.model.level == "slide" or self.save_slides:
                new = pooled
                if (stored := self.finished(spark, "slide_embeddings")) is not None:
                    new = pooled.join(stored, tables.same_unit(pooled, stored, UNIT), "left_anti")
                artifacts.write_vectors(new, self.root, "slide_embeddings", "append" if self.resume else "overwrite")
                out.slides = artifacts.read(spark, self.root, "slide_embeddings")
                pooled = out.slides.join(have, tables.same_unit(out.slides, have, UNIT), "left_semi")
            if self.model.level == "patient":
                if not self.save_slides:
                    pooled = self.parked(pooled)
                artifacts.write_vectors(pool_patients(pooled, patients), self.root, "patient_embeddings", "overwrite")
                out.patients = artifacts.read(spark, self.root, "patient_embeddings")
        out.skipped = units.where(~has_tiles("num_tiles"))
        out.status = self.reconciled(spark, status)
        return out

    def run_dense(self, requests: DataFrame, open_image, target: int | tuple[int, int], **more) -> DataFrame:
        """Regions given by place to stored grids (sample_id, annotation, x, y, h, w, vector), committed after each `checkpoint` samples.

        On resume only regions without a stored record are read and encoded. Repeated requests are one. Returns all stored cells.
        """
        spark = requests.sparkSession
        todo = requests.withColumn("annotation", artifact_label("annotation")).dropDuplicates(list(REGION))
        if self.resume and artifacts.exists(spark, self.root, "dense_embeddings"):
            stored = artifacts.read_metadata(spark, self.root, "dense_embeddings")
            todo = todo.join(stored, tables.same_unit(todo, stored, REGION), "left_anti")
        mode = "append" if self.resume else "overwrite"
        for batch in self.batches(todo):
            cells = self.model.embed_coordinates_dense(todo.where(batch), open_image, target, **more)
            artifacts.write_grids(cells, self.root, list(REGION), mode)
            mode = "append"
        return artifacts.read(spark, self.root, "dense_embeddings")

    def reconciled(self, spark, status: DataFrame) -> DataFrame:
        """Status from what is stored: success where a unit has metadata or no tiles, else error."""
        if self.model.level == "patient":
            return status.withColumn("feature_status", F.lit("success"))
        stored = artifacts.read_metadata(spark, self.root, self.stored()).select("sample_id", artifact_label("annotation").alias("annotation")).distinct().withColumn("feature_status", F.lit("success"))
        base = status.withColumn("feature_status", F.when(has_tiles("num_tiles"), F.lit(None).cast("string")).otherwise("success"))
        return tables.upsert(base, stored, ["feature_status"], UNIT).withColumn("feature_status", F.coalesce("feature_status", F.lit("error")))

    def run_with_coordinates(self, coordinates: DataFrame, slides: DataFrame | None = None, **more) -> Result:
        """Starts at stored tiles; of the manifest, if there is one, slides without stored tiles drop out."""
        known = coordinates.select("sample_id").distinct()
        wanted = known if slides is None else slides.join(known, "sample_id", "left_semi")
        return self.run(wanted, coordinates.join(wanted.select("sample_id"), "sample_id", "left_semi"), **more)

    def run_tiled(self, slides: DataFrame, status: DataFrame, tiles: DataFrame, previous: DataFrame | None = None, patients: DataFrame | None = None, pixels: str = "pixels", **more) -> Result:
        """Starts at the status table that a tiler wrote: a unit for each class of a slide that has tiles and coordinates.

        Slides that the table doesn't know or that were not tiled are an error before anything is encoded; slides and
        classes without tiles are left out, and so are tiles of no unit. previous: the table of an earlier run, for
        columns to be restored. The result's status is the given table with what became of each unit.
        more: see tiling.prepared.
        """
        status, units = tiling.prepared(slides, status, previous=previous, **more)
        labelled = status.withColumn("annotation", artifact_label("annotation"))
        units = units.select("sample_id", artifact_label("annotation").alias("annotation"))
        tables.require_unique(units, list(UNIT), "units")
        tiles = tiles.withColumn("annotation", artifact_label("annotation"))
        mine = tiles.join(units, tables.same_unit(tiles, units, UNIT), "left_semi")
        made = self.run(slides.join(units.select("sample_id").distinct(), "sample_id", "left_semi"), mine, patients, pixels=pixels)
        base = labelled if "feature_status" in labelled.columns else labelled.withColumn("feature_status", F.lit("tbp"))
        ran = made.status.select(*UNIT, "feature_status")
        # A unit whose tiles aren't there was not encoded, whatever the table said.
        lost = units.join(ran, tables.same_unit(units, ran, UNIT), "left_anti").withColumn("feature_status", F.lit("error"))
        made.status = tables.upsert(base, ran.unionByName(lost), ["feature_status"], UNIT)
        return made
