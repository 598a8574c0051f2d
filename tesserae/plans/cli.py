"""Command line: settings, a slide manifest and a table of tiles to stored vectors.

spark-submit tesserae/plans/cli.py --config run.yaml --tiles tiles.parquet --encoders my_encoders [key=value ...]

`my_encoders` is a module with `register(registry)`, which plugs implementations in. With --masks the classes of tiles
are those of `tiling.masks` that cover them enough; with --status a run starts at the status table of a tiler.
"""

from __future__ import annotations

import argparse
import importlib

from pyspark.sql import SparkSession

from tesserae.functions import encoders
from tesserae.operators import coverage
from tesserae.plans import settings
from tesserae.plans.pipeline import Model, Pipeline, Result
from tesserae.sources import manifests


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="tesserae", description="Vectors of tiles, slides or patients.")
    p.add_argument("--config", help="YAML file of settings")
    p.add_argument("--tiles", required=True, help="Parquet table with sample_id, annotation, tile_index and pixels")
    p.add_argument("--masks", help="Parquet table with sample_id, mask, mask_width and mask_downsample; tiles then have x, y and size, too")
    p.add_argument("--status", help="CSV of the status table after tiling")
    p.add_argument("--encoders", help="module with register(registry)")
    p.add_argument("--tiling-only", action="store_true")
    p.add_argument("--run-on-cpu", action="store_true")
    p.add_argument("options", nargs="*", help="key=value, over the file's")
    return p


def run(spark: SparkSession, argv: list[str]) -> Result:
    args = parser().parse_args(argv)
    registry = encoders.catalogue()
    if args.encoders:
        importlib.import_module(args.encoders).register(registry)
    cfg = settings.with_encoder(settings.load(args.config, args.options), registry, args.run_on_cpu)
    if not cfg["csv"] or not cfg["model"]["name"]:
        raise ValueError("settings need csv and model.name")
    model = Model.from_preset(cfg["model"]["name"], cfg["model"]["output_variant"], registry)
    pipeline = Pipeline(model, cfg["output_dir"], cfg["resume"], cfg["model"]["save_tile_embeddings"], cfg["model"]["save_slide_embeddings"])
    patients = manifests.patients(spark, cfg["csv"]) if model.level == "patient" else None
    slides, tiles = manifests.slides(spark, cfg["csv"]), spark.read.parquet(args.tiles)
    if args.masks:
        # Classes come from the masks, so labels that tiles have already are dropped.
        tiles = coverage.select(tiles.drop("annotation", "coverage"), spark.read.parquet(args.masks), settings.tiling(cfg["tiling"]))
    if args.status and not args.tiling_only:
        return pipeline.run_tiled(slides, manifests.status(spark, args.status), tiles, patients=patients)
    return pipeline.run(slides, tiles, patients, args.tiling_only)


def main(argv: list[str] | None = None) -> int:
    import sys

    spark = SparkSession.builder.getOrCreate()
    status = run(spark, sys.argv[1:] if argv is None else argv).status
    failed = status.where("feature_status = 'error'").count()
    print(f"{failed} unit(s) failed")
    return 1 if failed else 0


if __name__ == "__main__":
    raise SystemExit(main())
