"""Queries on images, grids, records and units. An embedding of 64 numbers stands in for an image of 8 x 8 pixels."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import encoders, pixels, records, transforms
from tesserae.functions import expressions as X
from tesserae.functions.registry import Encoder
from tesserae.operators import aggregate, spatial, tables
from tesserae.plans.catalogue import query, table, tiles
from tesserae.plans.pipeline import Model, pool_patients

# 1-based cell of an image of 8 columns
CELL = "embedding[({y}) * 8 + ({x}) + 1]"


def raster_sql(height: int, width: int, cell: str) -> str:
    """SQL of a list over a raster; cell may name y and x."""
    y, x = f"(i // {width})", f"(i % {width})"
    return f"list_transform(range(0, {height * width}), lambda i: {cell.format(y=y, x=x)})"


def images(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").alias("pixels"), F.lit(8).alias("h"), F.lit(8).alias("w"))


def source(y: str, x: str) -> str:
    return CELL.format(y=y, x=x)


@query(f"SELECT vec_id, {raster_sql(4, 4, source('({y} + 2)', '({x} + 2)'))} AS crop FROM embeddings")
def center_crop(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", pixels.center_crop("pixels", "h", "w", 4).alias("crop"))


@query(f"SELECT vec_id, {raster_sql(10, 11, source('CASE WHEN {y} < 8 THEN {y} ELSE 14 - {y} END', 'CASE WHEN {x} < 8 THEN {x} ELSE 14 - {x} END'))} AS padded FROM embeddings")
def pad_reflect(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", pixels.padded("pixels", "h", "w", F.lit(10), F.lit(11)).alias("padded"))


@query(f"SELECT vec_id, {raster_sql(10, 10, source('least({y}, 7)', 'least({x}, 7)'))} AS padded FROM embeddings")
def pad_replicate(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", pixels.padded("pixels", "h", "w", F.lit(10), F.lit(10), "replicate").alias("padded"))


@query(f"SELECT vec_id, {raster_sql(4, 4, 'CASE WHEN {y} + vec_id % 7 < 8 AND {x} + 6 < 8 THEN ' + source('least({y} + vec_id % 7, 7)', 'least({x} + 6, 7)') + ' ELSE 255 END')} AS region FROM embeddings")
def region_read_white(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", pixels.cropped_read("pixels", "h", "w", F.lit(6), F.col("vec_id") % 7, F.lit(4)).alias("region"))


@query(f"""
    SELECT vec_id, CAST(t AS INTEGER) AS tile, {raster_sql(4, 4, source('({y} + t // 2 * 4)', '({x} + t % 2 * 4)'))} AS pixels FROM embeddings, (SELECT unnest(range(0, 4)) AS t)""")
def region_unfold(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", F.posexplode(pixels.unfolded("pixels", "w", 4)).alias("tile", "pixels"))


@query(f"""
    SELECT vec_id, {raster_sql(4, 4, 'round((' + ' + '.join(f'CAST({source(f"({{y}} * 2 + {a})", f"({{x}} * 2 + {b})")} AS DOUBLE)' for a in (0, 1) for b in (0, 1)) + ') / 4, 6)')} AS pixels FROM embeddings""")
def area_resize(spark, sf_dir):
    out = images(spark, sf_dir).select("vec_id", pixels.resize_udf((4, 4))("pixels", "h", "w").alias("p"))
    return out.select("vec_id", F.transform("p", lambda v: X.rounded(v, 6)).alias("pixels"))


@query("SELECT vec_id, list_transform(embedding, lambda v, i: round((CAST(v AS DOUBLE) - CASE WHEN i % 2 = 1 THEN 0.5 ELSE 0.25 END) / CASE WHEN i % 2 = 1 THEN 0.2 ELSE 0.1 END, 6)) AS pixels FROM embeddings")
def normalise_channels(spark, sf_dir):
    return images(spark, sf_dir).select("vec_id", F.transform(pixels.normalised("pixels", [0.5, 0.25], [0.2, 0.1]), lambda v: X.rounded(v, 6)).alias("pixels"))


# Grids and regions


@query("""
    SELECT p_partkey AS sample_id, row_number() OVER (PARTITION BY p_partkey ORDER BY y, x) - 1 AS tile_index, x, y
    FROM part, LATERAL (SELECT unnest(range(0, p_size * 40 - 223, 112)) AS x), (SELECT unnest([0, 112]) AS y)""")
def tile_grid(spark, sf_dir):
    slides = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("sample_id"), (F.col("p_size") * 40).alias("width"), F.lit(400).alias("height"))
    return spatial.grid_tiles(slides, 224, 0.5).select("sample_id", F.col("tile_index").cast("long").alias("tile_index"), "x", "y")


@query("""
    SELECT p_partkey, p_size * 448 AS requested_region_size_px, CASE WHEN p_size % 2 = 0 THEN 2 END AS multiple,
      CASE WHEN p_size % 2 = 0 THEN CAST(round_even(224 * 0.5 / (p_retailprice / 4000), 0) AS INTEGER) END AS tile_size_lv0 FROM part""")
def hierarchical_geometry(spark, sf_dir):
    p = table(spark, sf_dir, "part")
    # an odd size stands for a multiple that doesn't divide the region
    g = records.hierarchical_geometry(F.col("p_size") * 448, F.when(F.col("p_size") % 2 == 0, 2).otherwise(1), F.lit(224), F.lit(0.5), F.col("p_retailprice") / 4000)
    return p.select("p_partkey", (F.col("p_size") * 448).alias("requested_region_size_px"), g.alias("g")).select("p_partkey", "requested_region_size_px", F.col("g.region_tile_multiple").alias("multiple"), F.col("g.tile_size_lv0").alias("tile_size_lv0"))


@query("""
    WITH t AS (SELECT l_orderkey AS sample, CAST(row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) - 1 AS BIGINT) AS f, l_partkey AS x FROM lineitem)
    SELECT sample, f // 4 AS region_index, list(f % 4 ORDER BY f) AS subtiles, list(x ORDER BY f) AS x FROM t GROUP BY 1, 2""")
def hierarchical_merge(spark, sf_dir):
    t = tiles(spark, sf_dir).select("sample", F.floor(F.col("tile_index") / 4).alias("region_index"), (F.col("tile_index") % 4).cast("long").alias("subtiles"), "x")
    return aggregate.in_order(t, ["sample", "region_index"], "subtiles", ["subtiles", "x"])


@query("""
    WITH t AS (SELECT l_orderkey, l_partkey // 100 AS s, l_linenumber FROM lineitem)
    SELECT l_orderkey, s AS supertile, count(*) AS tiles, min(l_linenumber) AS first FROM t GROUP BY 1, 2""")
def supertile_reads(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.floor(F.col("l_partkey") / 100).alias("supertile"), "l_linenumber")
    return spatial.supertile_reads(t, ["l_orderkey"], "supertile", "l_linenumber").select("l_orderkey", "supertile", "tiles", "first")


@query("""
    WITH f AS (SELECT o_orderkey, o_totalprice / 500000 AS s0 FROM orders), l AS (SELECT o_orderkey, level, s0 * d AS spacing FROM f, (VALUES (0, 1.0), (1, 2.0), (2, 4.0)) v(level, d)),
    near AS (SELECT o_orderkey, min_by(level, abs(spacing - 0.5)) AS level, min_by(spacing, abs(spacing - 0.5)) AS spacing FROM l WHERE abs(spacing - 0.5) <= 0.025 GROUP BY 1),
    finer AS (SELECT o_orderkey, max_by(level, spacing) AS level, max(spacing) AS spacing FROM l WHERE spacing <= 0.5 GROUP BY 1)
    SELECT o_orderkey, coalesce(near.level, finer.level, 0) AS level, near.level IS NOT NULL AS within, CAST(round(coalesce(near.spacing, finer.spacing, s0) * 50000000) AS BIGINT) AS read_spacing,
      CASE WHEN near.level IS NOT NULL THEN 1000 ELSE CAST(round_even(1000 * (coalesce(finer.spacing, s0) / 0.5), 0) AS INTEGER) END AS output_height
    FROM f LEFT JOIN near USING (o_orderkey) LEFT JOIN finer USING (o_orderkey)""")
def level_read_plan(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", records.level_choice(F.lit(0.5), F.col("o_totalprice") / 500000, F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0)), 0.05).alias("c"))
    p = o.select("o_orderkey", records.image_plan("c", F.lit(1000), F.lit(800), F.lit(0.5)).alias("p"))
    return p.select("o_orderkey", F.col("p.read_level").alias("level"), F.col("p.is_within_tolerance").alias("within"), F.round(F.col("p.read_spacing_um") * 50000000).cast("long").alias("read_spacing"), F.col("p.output_size")[0].alias("output_height"))


# Records and units


@query("""SELECT o_orderkey, '{"encoder_name":"uni","encoder_level":"tile","image_path":"/s/' || o_orderkey || '.tif"}' AS record, '/s/' || o_orderkey || '.tif' AS image_path FROM orders""")
def record_round_trip(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(F.lit("/s/"), F.col("o_orderkey").cast("string"), F.lit(".tif")).alias("path"))
    made = o.select("o_orderkey", records.as_json(records.record(records.SLIDE_METADATA, encoder_name="uni", encoder_level="tile", image_path=F.col("path"))).alias("record"))
    return made.withColumn("image_path", records.from_json("record", records.SLIDE_METADATA)["image_path"])


@query("SELECT l_orderkey AS sample_id, nullif(l_returnflag, 'N') AS annotation FROM lineitem WHERE l_linestatus = 'F' GROUP BY 1, 2 HAVING count(DISTINCT l_linenumber % 2) = 2")
def completed_units(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").where("l_linestatus = 'F'").select(F.col("l_orderkey").alias("sample_id"), F.nullif("l_returnflag", F.lit("N")).alias("annotation"), F.when(F.col("l_linenumber") % 2 == 0, "tile").otherwise("slide").alias("kind"))
    status = t.select("sample_id", "annotation").distinct().withColumn("feature_status", F.lit("success"))
    return tables.completed(status, t, ["tile", "slide"])


@query("""
    WITH prev AS (SELECT o_custkey, max_by(o_orderstatus, o_orderkey) AS s, max_by(o_orderpriority, o_orderkey) AS p FROM orders GROUP BY 1)
    SELECT c_custkey, c_mktsegment, CASE WHEN s = CASE WHEN c_acctbal > 0 THEN 'O' ELSE 'F' END THEN p ELSE 'new' END AS preview FROM customer LEFT JOIN prev ON o_custkey = c_custkey""")
def restore_previous(spark, sf_dir):
    cur = table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", F.when(F.col("c_acctbal") > 0, "O").otherwise("F").alias("state"), F.lit("new").alias("preview"))
    old = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), F.col("o_orderstatus").alias("state"), F.col("o_orderpriority").alias("preview"), "o_orderkey")
    return tables.restore_unchanged(cur, old, "o_orderkey", ["state"], ["preview"], ["c_custkey"]).drop("state")


@query("""
    WITH b AS (SELECT l_orderkey, l_returnflag, max_by(l_partkey, l_linenumber::BIGINT * 1000000000 + l_partkey) AS bag FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1, 2)
    SELECT l_orderkey, list(l_returnflag ORDER BY l_returnflag) AS labels, list(bag ORDER BY l_returnflag) AS bags FROM b GROUP BY 1""")
def last_bag_wins(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.nullif("l_returnflag", F.lit("N")).alias("label"), F.col("l_partkey").alias("bag"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("o"))
    last = tables.last_by(t, ["l_orderkey", "label"], "o", ["bag"])
    return aggregate.nested(last, "l_orderkey", "label", "bag").select("l_orderkey", F.map_keys("bags").alias("labels"), F.map_values("bags").alias("bags"))


@query("SELECT l_orderkey, l_returnflag AS label, row_number() OVER (PARTITION BY l_orderkey ORDER BY min(l_linenumber::BIGINT * 1000000000 + l_partkey), l_returnflag) AS place FROM lineitem GROUP BY 1, 2")
def first_seen_labels(spark, sf_dir):
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("label"), (F.col("l_linenumber").cast("long") * 1000000000 + F.col("l_partkey")).alias("o"))
    return aggregate.first_seen(t, "l_orderkey", "label", "o")


@query("SELECT o_orderkey, CAST(count(DISTINCT l_returnflag) AS BIGINT) AS classes, coalesce(bool_and(l_linestatus = 'F'), false) AS ready FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey GROUP BY 1")
def siblings_ready(spark, sf_dir):
    units = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_returnflag", "l_linestatus")
    return tables.siblings(table(spark, sf_dir, "orders").select("o_orderkey"), units, F.col("l_linestatus") == "F", "o_orderkey", "l_returnflag")


@query("""
    SELECT page_id, regexp_extract(url, '[^/]*$') AS name, CASE WHEN regexp_matches(regexp_extract(url, '[^/]*$'), '^.+\\.[^.]*$') THEN regexp_extract(regexp_extract(url, '[^/]*$'), '^(.+)\\.[^.]*$', 1) ELSE regexp_extract(url, '[^/]*$') END AS stem,
      lower(regexp_extract(url, '(\\.[^./]+)$', 1)) AS suffix FROM pages WHERE url IS NOT NULL""")
def path_stems(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", F.regexp_extract("url", "[^/]*$", 0).alias("name"), X.path_stem("url").alias("stem"), X.suffix("url").alias("suffix"))


# The run: encoders of arithmetic in place of models


def stand_ins():
    r = encoders.catalogue()
    halves = lambda: lambda x: np.stack([x[:, :32].mean(1, dtype=np.float64), x[:, 32:].mean(1, dtype=np.float64)], 1)
    r.register(Encoder("halves", "tile", {"default": 2}, halves, 8, (1, 1), (0.5,)))
    r.register(Encoder("halves-slide", "slide", {"default": 2}, None, None, None, (0.5,), "fp32", "halves"))
    return r


def embedded_slides(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    t = e.select((F.col("vec_id") % 20).cast("string").alias("sample_id"), F.lit(None).cast("string").alias("annotation"), F.col("vec_id").alias("tile_index"), F.col("embedding").alias("pixels"))
    return Model.from_preset("halves-slide", registry=stand_ins()).embed_slides(t)


SLIDES_SQL = "s AS (SELECT CAST(vec_id % 20 AS VARCHAR) AS sample_id, avg(CAST(list_avg(list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE))) AS FLOAT)) AS a, avg(CAST(list_avg(list_transform(embedding[33:64], lambda v: CAST(v AS DOUBLE))) AS FLOAT)) AS b FROM embeddings GROUP BY 1)"


@query(f"WITH {SLIDES_SQL} SELECT sample_id, round(a, 5) AS first_half, round(b, 5) AS second_half FROM s")
def embed_slides(spark, sf_dir):
    return embedded_slides(spark, sf_dir).select("sample_id", X.rounded(F.col("embedding")[0], 5).alias("first_half"), X.rounded(F.col("embedding")[1], 5).alias("second_half"))


@query(f"WITH {SLIDES_SQL} SELECT CASE WHEN CAST(sample_id AS INTEGER) < 12 THEN 'p' || CAST(sample_id AS INTEGER) % 3 ELSE sample_id END AS patient_id, count(*) AS num_slides, round(avg(a), 5) AS first_half FROM s GROUP BY 1")
def embed_patients(spark, sf_dir):
    who = spark.range(12).select(F.col("id").cast("string").alias("sample_id"), F.concat(F.lit("p"), (F.col("id") % 3).cast("string")).alias("patient_id"))
    return pool_patients(embedded_slides(spark, sf_dir), who).select("patient_id", "num_slides", X.rounded(F.col("embedding")[0], 5).alias("first_half"))


@query("""
    WITH k(i, name, level, dim, px, patch, any_size) AS (VALUES (0, 'uni', 'tile', 1024, 224, 16, true), (1, 'musk', 'tile', 2048, 384, 16, false), (2, 'titan', 'slide', 768, 448, 16, true), (3, 'moozy', 'patient', 768, 224, 8, true)),
    r AS (SELECT p_partkey, p_size, p_partkey % 5 AS i, CASE WHEN p_size % 2 = 0 THEN p_size * 8 ELSE 224 END AS size_px FROM part)
    SELECT p_partkey, level, dim, CASE WHEN name IS NULL THEN ['encoder'] ELSE list_filter([CASE WHEN p_size % 3 = 0 THEN 'spacing' END, CASE WHEN size_px <> px AND NOT (any_size AND size_px % patch = 0) THEN 'size' END], lambda c: c IS NOT NULL) END AS complaints
    FROM r LEFT JOIN k USING (i)""")
def encoder_catalogue(spark, sf_dir):
    """Parts as requests to four encoders and one that is not known, each held against the encoder's contract."""
    names = F.array(*map(F.lit, ("uni", "musk", "titan", "moozy", "nobody")))
    size = F.when(F.col("p_size") % 2 == 0, F.col("p_size") * 8).otherwise(224)
    p = table(spark, sf_dir, "part").select("p_partkey", names[F.col("p_partkey") % 5].alias("encoder_name"), size.alias("size_px"), F.when(F.col("p_size") % 3 == 0, 3.5).otherwise(0.5).alias("spacing_um"))
    return encoders.accepted(p, encoders.catalogue()).select("p_partkey", "level", "dim", "complaints")


def _mean_of_four(y: str, x: str) -> str:
    cells = (source(f"(({y} + 1) * 2 + {a})", f"(({x} + 1) * 2 + {b})") for a in (0, 1) for b in (0, 1))
    return "(" + " + ".join(f"CAST({c} AS DOUBLE)" for c in cells) + ") / 4"


@query(f"SELECT vec_id, {raster_sql(2, 2, 'round((' + _mean_of_four('{y}', '{x}') + ' - 0.1) / 0.5, 6)')} AS p, 2 AS h, 2 AS w FROM embeddings")
def fused_transforms(spark, sf_dir):
    steps = [transforms.Normalize((0.1,), (0.25,)), [transforms.Resize((4, 4), "area"), transforms.CenterCrop(2)], transforms.Scale(0.5)]
    made = images(spark, sf_dir).select("vec_id", transforms.transform_udf(steps)("pixels", "h", "w").alias("t"))
    return made.select("vec_id", F.transform("t.pixels", lambda v: X.rounded(v, 6)).alias("p"), F.col("t.height").alias("h"), F.col("t.width").alias("w"))
