"""Queries on what is stored: commits and their replay, pyramids of tiles, tar stores, masks and regions."""

from __future__ import annotations

import io
import tarfile

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import Window
from pyspark.sql import functions as F

from tesserae.functions import expressions as X
from tesserae.operators import coverage, spatial
from tesserae.plans.catalogue import each_label, numbered, query, table
from tesserae.plans.grids import patch_ranges
from tesserae.plans.pipeline import Model, Pipeline
from tesserae.sources import commits, regions, tars, tensors, tiff


@query("""
    SELECT event_type, count(*) AS n, CAST(sum(event_id) AS BIGINT) AS ids, (SELECT count(*) FROM events e WHERE e.event_type = o.event_type) AS noted
    FROM events o GROUP BY ALL""")
def commit_replay(spark, sf_dir):
    """Events committed in four batches with a row of metadata for each kind; two are sent again, and one dies before its commit and is repeated."""
    events = table(spark, sf_dir, "events").select("event_id", "event_type", F.pmod(F.xxhash64("event_id"), F.lit(4)).alias("batch"))
    t = commits.Table(spark, commits.scratch(spark))
    for b in (0, 1, 1, 2, 0, 3):
        rows = events.where(F.col("batch") == b).drop("batch")
        if b == 3:
            rows.write.parquet(f"{t.root}/payload/commit_=batch-3-died")
        t.commit({"payload": rows, "metadata": lambda stored: stored["payload"].groupBy("event_type").agg(F.count("*").alias("noted"))}, f"batch-{b}", partition_by={"payload": ["event_type"]})
    noted = t.read("metadata").groupBy("event_type").agg(F.sum("noted").alias("noted"))
    return t.read("payload").groupBy("event_type").agg(F.count("*").alias("n"), F.sum("event_id").alias("ids")).join(noted, "event_type")


def byte_sum(column):
    @F.pandas_udf("long")
    def run(s: pd.Series) -> pd.Series:
        return s.map(lambda b: int(np.frombuffer(b, np.uint8).sum(dtype=np.int64)))

    return run(column)


def pyramids(spark, sf_dir) -> str:
    """A folder with a pyramid of two levels for each label: its vectors, in order, as rows of 64 pixels; the second level has every other row and pixel."""
    folder = commits.scratch(spark)
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: F.floor(F.abs(v) * 255).cast("int")).alias("p"))
    spark._jvm.org.apache.hadoop.fs.Path(folder).getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(spark._jvm.org.apache.hadoop.fs.Path(folder))

    def write(key, group):
        image = np.stack(group.sort_values("vec_id")["p"].to_numpy()).astype(np.uint8)[:, :, None]
        tiff.write_pyramid(f"{folder}/{key[0]}.tif", [image, image[::2, ::2]], tile=16, predictor=2, big=bool(key[0] % 2))
        return pd.DataFrame({"label": [key[0]]})

    each_label(rows, write)
    return folder


PIXELS = """
    WITH r AS (SELECT label, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS y, embedding FROM embeddings),
    p AS (SELECT label, y, unnest(embedding) AS v, generate_subscripts(embedding, 1) - 1 AS x FROM r),
    l AS (SELECT label, 0 AS level, x, y, CAST(floor(abs(v) * 255) AS BIGINT) AS v FROM p UNION ALL SELECT label, 1, x // 2, y // 2, CAST(floor(abs(v) * 255) AS BIGINT) FROM p WHERE x % 2 = 0 AND y % 2 = 0)
"""


@query(f"""{PIXELS}
    SELECT label, CAST(level AS INTEGER) AS level, CAST(x // 16 AS INTEGER) AS tile_x, CAST(y // 16 AS INTEGER) AS tile_y, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS total
    FROM l WHERE level = 1 AND x // 16 >= 1 OR level = 0 AND y // 16 = 1 GROUP BY ALL""")
def pyramid_tiles(spark, sf_dir):
    folder = pyramids(spark, sf_dir)
    named = lambda d: d.select(F.regexp_extract("image_path", r"([0-9]+)\.tif$", 1).cast("int").alias("label"), "level", "tile_x", "tile_y", F.octet_length("pixels").cast("long").alias("pixels"), byte_sum("pixels").alias("total"))
    return named(tiff.tiles(spark, folder, 1, (32, 0, 64, 1 << 40), 2)).unionByName(named(tiff.tiles(spark, folder, 0, (0, 16, 64, 32), 2)))


@query(f"""{PIXELS}, s AS (SELECT DISTINCT label, level, x // 10 AS sx, y // 10 AS sy FROM l)
    SELECT s.label, CAST(s.level AS INTEGER) AS level, s.sx * 10 AS left_px, s.sy * 10 AS top_px, CAST(sum(v) + 255 * (100 - count(*)) AS BIGINT) AS total
    FROM s JOIN l ON l.label = s.label AND l.level = s.level AND l.x // 10 = sx AND l.y // 10 = sy GROUP BY ALL""")
def pyramid_squares(spark, sf_dir):
    """Squares of 10 pixels of both levels, across the seams of tiles, through the opener of pyramids."""
    folder = pyramids(spark, sf_dir)
    tops = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.count("*").alias("n"))
    levels = tops.select("label", "n", F.explode(F.array(F.lit(0), F.lit(1))).alias("level")).select("*", F.when(F.col("level") == 0, F.lit(64)).otherwise(32).alias("across"), F.when(F.col("level") == 0, F.col("n")).otherwise(F.ceil(F.col("n") / 2)).alias("down"))
    columns = levels.select("*", F.explode(F.sequence(F.lit(0), F.floor((F.col("across") - 1) / 10))).alias("sx"), F.ceil(F.col("down") / 10).alias("steps"))
    squares = numbered(columns, "steps", "sy").withColumns({"left_px": (F.col("sx") * 10).cast("long"), "top_px": F.col("sy") * 10})
    # Places are given at level 0; of n rows the second level has ceil(n / 2).
    up = lambda at, whole, part: F.ceil(F.col(at) * whole / part).cast("long")
    requests = squares.select(F.concat(F.lit(folder + "/"), F.col("label"), F.lit(".tif")).alias("image_path"), "label", "level", "left_px", "top_px", up("left_px", F.lit(64), F.col("across")).alias("x"), up("top_px", F.col("n"), F.col("down")).alias("y"), F.lit(10).alias("read_px"))
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))
    return regions.read_regions(requests, regions.opener("tiff"), 1).select("label", "level", "left_px", "top_px", total.alias("total"))


@query(f"""{PIXELS}, n AS (SELECT label, count(*) AS n FROM r GROUP BY 1)
    SELECT label, x // 8 * 8 AS x, y // 8 * 8 AS y, CAST(y % 8 // 3 AS INTEGER) AS h, CAST(x % 8 // 3 AS INTEGER) AS w, CAST(min(v) AS DOUBLE) AS smallest, CAST(max(v) AS DOUBLE) AS largest
    FROM l JOIN n USING (label) WHERE level = 0 AND y // 8 * 8 + 8 <= n GROUP BY ALL""")
def dense_regions(spark, sf_dir):
    """Regions of 8 x 8 pixels of pyramids to stored grids, from windows that overlap; a second run resumes one that had done the left column only."""
    folder = pyramids(spark, sf_dir)
    tops = table(spark, sf_dir, "embeddings").groupBy("label").agg(F.floor(F.count("*") / 8).alias("rows"))
    places = numbered(tops.select("label", "rows", F.explode(F.sequence(F.lit(0), F.lit(56), F.lit(8))).alias("x")), "rows", "row").withColumn("y", F.col("row") * 8)
    named = places.select(F.col("label").cast("string").alias("sample_id"), F.lit(None).cast("string").alias("annotation"), F.col("x").cast("long"), "y", F.lit(0).alias("level"), F.lit(8).alias("read_px"), F.concat(F.lit(folder + "/"), "label", F.lit(".tif")).alias("image_path"))
    run = lambda requests: Pipeline(Model.from_preset("patches", registry=patch_ranges()), folder, resume=True).run_dense(requests, regions.opener("tiff"), 8, window=6, overlap=0.5, pad_mode="replicate", supertile=2)
    run(named.where("x = 0"))
    v = F.col("vector")
    return run(named).select(F.col("sample_id").cast("int").alias("label"), "x", "y", "h", "w", F.round(v[0], 6).alias("smallest"), F.round(v[1], 6).alias("largest"))


@query("""
    WITH m AS (SELECT label, 'tile_' || vec_id % 20 || '.bin' AS name, vec_id, embedding FROM embeddings),
    i AS (SELECT label, name, row_number() OVER (PARTITION BY label ORDER BY name, vec_id) - 1 AS tile_index, list_sum(list_transform(embedding, lambda v: CAST(floor(abs(v) * 255) AS BIGINT))) AS total FROM m)
    SELECT label, tile_index, name, CAST(total AS BIGINT) AS total FROM i WHERE tile_index % 3 = 1""")
def tar_tiles(spark, sf_dir):
    """Every third tile of a tar store for each label, in which names repeat, read by the index of its members."""
    folder = pyramids(spark, sf_dir)
    rows = table(spark, sf_dir, "embeddings").select("label", "vec_id", F.transform("embedding", lambda v: F.floor(F.abs(v) * 255).cast("int")).alias("p"))

    def write(key, group):
        system, name = fs.FileSystem.from_uri(f"{folder}/{key[0]}.tiles.tar") if ":" in folder else (fs.LocalFileSystem(), f"{folder}/{key[0]}.tiles.tar")
        with system.open_output_stream(name) as out, tarfile.open(fileobj=out, mode="w|") as tar:
            for row in group.sort_values("vec_id").itertuples():
                member = tarfile.TarInfo(f"tile_{row.vec_id % 20}.bin")
                member.size = len(row.p)
                tar.addfile(member, io.BytesIO(bytes(row.p.astype(np.uint8))))
        return pd.DataFrame({"label": [key[0]]})

    each_label(rows, write)
    wanted = numbered(rows.groupBy("label").agg(F.count("*").alias("n")), "n", "tile_index").where("tile_index % 3 = 1").select(F.col("label").cast("string").alias("sample_id"), "tile_index")
    return tars.tiles(spark, folder, wanted).select(F.col("sample_id").cast("int").alias("label"), "tile_index", "name", byte_sum("content").alias("total"))


@query("""
    WITH p AS (SELECT vec_id, generate_subscripts(embedding, 1) - 1 AS i, CAST(floor(abs(unnest(embedding)) * 16) AS BIGINT) % 3 AS v FROM embeddings),
    t(x, y) AS (VALUES (0, 0), (12, 0), (20, 20), (24, 8)), c(annotation, value, least) AS (VALUES ('one', 1, 0.3), ('two', 2, 0.25))
    SELECT vec_id, CAST(t.x AS BIGINT) AS x, CAST(t.y AS BIGINT) AS y, annotation, round(count(*) / 9.0, 6) AS coverage
    FROM p, t, c WHERE p.v = c.value AND i % 8 BETWEEN t.x // 4 AND t.x // 4 + 2 AND i // 8 BETWEEN t.y // 4 AND t.y // 4 + 2
    GROUP BY ALL HAVING count(*) / 9.0 >= any_value(least)""")
def mask_coverage(spark, sf_dir):
    """Vectors as masks of 8 x 8 pixels, four pixels of level 0 wide: tiles of 12 pixels by the classes that cover them enough."""
    e = table(spark, sf_dir, "embeddings")
    masks = e.select("vec_id", F.transform("embedding", lambda v: F.floor(F.abs(v) * 16) % 3).alias("mask"), F.lit(8).alias("mask_width"), F.lit(4.0).alias("mask_downsample"))
    places = F.array(*(F.struct(F.lit(x).cast("long").alias("x"), F.lit(y).cast("long").alias("y")) for x, y in ((0, 0), (12, 0), (20, 20), (24, 8))))
    tiles = e.select("vec_id", F.explode(places).alias("p")).select("vec_id", "p.x", "p.y", F.lit(12).cast("long").alias("size"))
    settings = {"pixel_mapping": {"none": 0, "one": 1, "two": 2}, "min_coverage": {"none": None, "one": 0.3, "two": 0.25}}
    return coverage.select(tiles, masks, settings, ["vec_id"]).select("vec_id", "x", "y", "annotation", F.round("coverage", 6).alias("coverage"))


@query("""
    WITH n AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) // 4 * 4 AS n FROM embeddings)
    SELECT label, i // 4 AS region_index, list(round(CAST(embedding[1] AS DOUBLE), 6) ORDER BY i) AS firsts FROM n WHERE i < n GROUP BY ALL""")
def hierarchical_scatter(spark, sf_dir):
    """Vectors of subtiles, in three shards and no order, put back to regions of four."""
    e = table(spark, sf_dir, "embeddings")
    n = e.groupBy("label").agg(F.floor(F.count("*") / 4).alias("num_regions"))
    flat = e.withColumn("flat_index", F.row_number().over(Window.partitionBy("label").orderBy("vec_id")) - 1).join(n, "label").where("flat_index < num_regions * 4")
    shards = [flat.where(F.col("vec_id") % 3 == k).select("label", "flat_index", "embedding") for k in (2, 0, 1)]
    made = spatial.scatter(shards[0].unionByName(shards[1]).unionByName(shards[2]), n, 4, ["label"])
    return made.select("label", "region_index", F.transform("embedding", lambda v: X.rounded(v[0].cast("double"), 6)).alias("firsts"))


@query("""
    SELECT label, vec_id AS tile_index, len(embedding) AS dim, round(CAST(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))) AS DOUBLE), 4) AS total FROM embeddings""")
def tensor_rows(spark, sf_dir):
    """The vectors of each label written as a tensor archive, with their ids, and read back."""
    folder = pyramids(spark, sf_dir)

    def write(key, group):
        system, name = fs.FileSystem.from_uri(f"{folder}/{key[0]}.pt") if ":" in folder else (fs.LocalFileSystem(), f"{folder}/{key[0]}.pt")
        with system.open_output_stream(name) as out:
            out.write(tensors.dump({"features": np.stack(group["embedding"].to_numpy()).astype(np.float32), "tile_index": group["vec_id"].to_numpy().astype(np.int64)}))
        return pd.DataFrame({"label": [key[0]]})

    each_label(table(spark, sf_dir, "embeddings"), write)
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return tensors.rows(spark, folder, "features").select(F.col("sample_id").cast("int").alias("label"), "tile_index", F.size("embedding").cast("long").alias("dim"), X.rounded(total, 4).alias("total"))
