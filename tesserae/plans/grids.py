"""Queries on grids of vectors, image artifacts and their records."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tesserae.functions import encoders, records
from tesserae.functions import expressions as X
from tesserae.functions.contracts import Layout
from tesserae.functions.registry import Encoder, Registry
from tesserae.operators import dense, tables
from tesserae.plans import recipes
from tesserae.plans.catalogue import query, table
from tesserae.plans.imaging import images, raster_sql, source
from tesserae.plans.pipeline import Model

WINDOWS = Layout.of(8, 3, 6, 0.5)


@query("""
    WITH v AS (SELECT label, vec_id, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS p FROM embeddings),
    c AS (SELECT label, vec_id % 3 * 2 + p // 16 AS h, vec_id % 2 * 2 + p // 4 % 4 AS w, p % 4 AS d, CAST(v AS DOUBLE) AS v,
      (0.5 - 0.5 * cos(2 * pi() * (p // 16 + 1) / 5)) * (0.5 - 0.5 * cos(2 * pi() * (p // 4 % 4 + 1) / 5)) AS k FROM v),
    m AS (SELECT label, h, w, d, sum(k * v) / sum(k) AS m FROM c GROUP BY ALL)
    SELECT label, CAST(h AS INTEGER) AS h, CAST(w AS INTEGER) AS w, list(round(m, 6) ORDER BY d) AS vector FROM m GROUP BY ALL""")
def dense_blend(spark, sf_dir):
    tokens = F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: F.slice("embedding", i * 4 + 1, 4))
    rows = table(spark, sf_dir, "embeddings").select("label", (F.col("vec_id") % 3 * 4).alias("win_y"), (F.col("vec_id") % 2 * 4).alias("win_x"), tokens.alias("tokens"))
    return dense.blend(rows, ["label"], Layout.of((16, 12), 2, 8, 0.5), digits=6)


@query(f"""
    SELECT vec_id, win_y, win_x, {raster_sql(6, 6, source('least({y} + win_y, 7)', 'least({x} + win_x, 7)'))} AS pixels
    FROM embeddings, (VALUES (0), (3)) a(win_y), (VALUES (0), (3)) b(win_x)""")
def dense_windows(spark, sf_dir):
    return dense.cut(images(spark, sf_dir).select("vec_id", "pixels"), WINDOWS, pad_mode="replicate")


def patch_ranges() -> Registry:
    """A stand-in that gives the smallest and the largest value of each patch of 3 x 3 pixels."""

    def run(x: np.ndarray) -> np.ndarray:
        n, side = len(x), round(x.shape[1] ** 0.5) // 3
        p = x.reshape(n, side, 3, side, 3).transpose(0, 1, 3, 2, 4).reshape(n, side * side, 9)
        return np.stack([p.min(2), p.max(2)], 2)

    r = Registry()
    r.register(Encoder("patches", "tile", {"default": 2}, lambda: run, 9, (3, 3), (0.5,), variable_input=True))
    return r


@query(f"""
    WITH p AS (SELECT vec_id, {raster_sql(9, 9, source('least({y}, 7)', 'least({x}, 7)'))} AS p FROM embeddings),
    c AS (SELECT vec_id, unnest(p) AS v, generate_subscripts(p, 1) - 1 AS i FROM p)
    SELECT vec_id, CAST(i // 27 AS INTEGER) AS h, CAST(i % 9 // 3 AS INTEGER) AS w, round(CAST(min(v) AS DOUBLE), 5) AS smallest, round(CAST(max(v) AS DOUBLE), 5) AS largest FROM c GROUP BY ALL""")
def dense_grids(spark, sf_dir):
    model = Model.from_preset("patches", registry=patch_ranges())
    cells = model.embed_grids(images(spark, sf_dir), 8, ["vec_id"], window=6, overlap=0.5, pad_mode="replicate")
    return cells.select("vec_id", "h", "w", X.rounded(F.col("vector")[0], 5).alias("smallest"), X.rounded(F.col("vector")[1], 5).alias("largest"))


@query("""
    SELECT doc_id, '/out/dense_image_embeddings/' || doc_id || '.pt' AS grid, '/out/image_embeddings/' || doc_id || '.npz' AS pooled, '/out/image_embeddings/' || doc_id || '.meta.json' AS sidecar,
      CASE WHEN doc_id % 2 = 0 THEN '/store/all.tar' ELSE '/store/' || doc_id || '.tiles.tar' END AS archive, 'logs/run.v2.rank' || doc_id % 8 || '.jsonl' AS events FROM documents""")
def image_artifact_paths(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    name = F.col("doc_id").cast("string")
    pooled = X.image_paths("/out", "image_embeddings", name, "npz")
    root = F.when(F.col("doc_id") % 2 == 0, "/store/all.tar").otherwise("/store/")
    events = X.ranked_path(F.lit("logs/run.v2.jsonl"), F.col("doc_id") % 8)
    return d.select("doc_id", X.image_paths("/out/", "dense_image_embeddings", name, "pt")["payload"].alias("grid"), pooled["payload"].alias("pooled"), pooled["sidecar"].alias("sidecar"), X.tile_archive(root, name).alias("archive"), events.alias("events"))


@query("SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN CAST(c_acctbal AS DOUBLE) END AS spacing FROM customer")
def level0_spacings(spark, sf_dir):
    return table(spark, sf_dir, "customer").select("c_custkey", X.positive_or_null("c_acctbal").alias("spacing"))


@query("""
    WITH s AS (SELECT l_orderkey, CASE WHEN l_linenumber > 1 THEN 224 + l_orderkey % 2 * (l_linenumber % 2) END AS size FROM lineitem)
    SELECT l_orderkey, CASE WHEN count(DISTINCT size) = 1 THEN min(size) END AS size, count(DISTINCT size) <= 1 AS agree FROM s GROUP BY 1""")
def shard_input_sizes(spark, sf_dir):
    size = F.when(F.col("l_linenumber") > 1, 224 + F.col("l_orderkey") % 2 * (F.col("l_linenumber") % 2))
    return tables.agreed(table(spark, sf_dir, "lineitem").select("l_orderkey", size.alias("size")), ["l_orderkey"], "size")


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS sample_id, '/images/' || p_partkey || '.png' AS image_path, 'uni' AS encoder_name, 'raster' AS reader_regime, p_size / 10.0 AS declared_spacing_um, 'reflect' AS pad_mode FROM part""")
def image_recipes(spark, sf_dir):
    declared = F.col("p_size") / 10.0
    plan = records.raster_plan("declared", declared, "auto")
    recipe = {"encoder_name": F.lit("uni"), "output_variant": F.lit("default"), "reader_regime": F.lit("spacing-readable"), "pad_mode": F.lit("reflect")}
    r = table(spark, sf_dir, "part").select("p_partkey", plan.alias("plan"))
    name = F.col("p_partkey").cast("string")
    out = r.select(records.image_recipe(recipe, "plan", name, F.concat(F.lit("/images/"), name, F.lit(".png"))).alias("r"))
    return out.select("r.sample_id", "r.image_path", "r.encoder_name", "r.reader_regime", "r.declared_spacing_um", "r.pad_mode")


@query("""
    SELECT p_partkey, p_size * 448 AS requested_region_size_px, 2 AS region_tile_multiple, p_size * 224 AS requested_tile_size_px, 'row_major' AS subtile_order, '' AS coordinates_npz_path FROM part""")
def hierarchical_metadata(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    r = records.record(records.HIERARCHICAL_METADATA, encoder_name="uni", encoder_level="tile", region_tile_multiple=2, requested_tile_size_px=F.col("p_size") * 224, requested_region_size_px=F.col("p_size") * 448, subtile_order="row_major")
    return p.select("p_partkey", r.alias("r")).select("p_partkey", *(f"r.{n}" for n in ("requested_region_size_px", "region_tile_multiple", "requested_tile_size_px", "subtile_order", "coordinates_npz_path")))


@query("""
    SELECT CAST(p_partkey AS VARCHAR) AS sample_id, 'dense_image_embeddings' AS artifact_type, 'uni' AS encoder_name, CASE WHEN p_size % 2 = 0 THEN 'spacing-readable' ELSE 'raster' END AS reader_regime, p_size / 10.0 AS source_spacing_um,
      [16, 13] AS grid_shape, [6, 4] AS pad, 48 AS window_size, 'float16' AS dtype, 1024 AS feature_dim, 0.5 AS declared_spacing_um, p_partkey % 4 AS differs FROM part""")
def image_grid_records(spark, sf_dir):
    """Parts as images, half of them with a spacing to read at; what differs from the compatibility of grids of another overlap, padding and window."""
    p = table(spark, sf_dir, "part")
    ask = lambda **more: recipes.image_grids(encoders.catalogue(), "uni", (250, 204), precision="fp16", spacing=0.5, **({"window": 48} | more))
    name, path = F.col("p_partkey").cast("string"), F.concat(F.lit("/images/"), F.col("p_partkey").cast("string"))
    source = F.col("p_size") / 10.0
    readable = records.record(records.READ_PLAN, reader_regime="spacing-readable", spacing_source="explicit", declared_spacing_um=0.5, source_spacing_um=source)
    raster = records.record(records.READ_PLAN, reader_regime="raster", spacing_source="explicit", declared_spacing_um=0.5, source_spacing_um=source)
    plan = F.when(F.col("p_size") % 2 == 0, readable).otherwise(raster)
    now = recipes.image_grid_record(ask(), name, path, F.lit(1024), plan)
    before = F.lit(None)
    for k, more in enumerate(({}, {"overlap": 0.25}, {"overlap": 0.25, "pad_mode": "replicate"}, {"overlap": 0.25, "pad_mode": "replicate", "window": 64})):
        before = F.when(F.col("p_partkey") % 4 == k, F.to_json(recipes.compatibility(ask(**more), name, path, plan))).otherwise(before)
    kind = "map<string,string>"
    both = p.select(now.alias("r"), F.from_json(before, kind).alias("before")).withColumn("now", F.from_json(F.to_json("r.compatibility"), kind))
    return both.select(
        "r.sample_id", "r.artifact_type", "r.encoder_name", "r.reader_regime", "r.source_spacing_um", "r.grid_shape", "r.pad", "r.window_size", "r.dtype", "r.feature_dim", "r.declared_spacing_um", F.size(X.differing_keys("before", "now")).cast("long").alias("differs"),
    )
