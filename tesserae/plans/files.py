"""Queries that write tables to files of the run's formats and read them back: manifests, status tables, arrays, rasters, artifacts."""

from __future__ import annotations

import io

import numpy as np
import pandas as pd
from pyarrow import fs
from pyspark.sql import functions as F

from tesserae.functions import attention
from tesserae.functions import expressions as X
from tesserae.operators import aggregate, tables
from tesserae.plans.catalogue import each_label, query, table
from tesserae.plans.imaging import stand_ins
from tesserae.plans.pipeline import Model, Pipeline
from tesserae.sources import arrays, artifacts, commits, manifests


def folder(spark) -> str:
    """A new, empty folder that driver and executors share."""
    path = spark._jvm.org.apache.hadoop.fs.Path(commits.scratch(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).mkdirs(path)
    return path.toString()


def put(root: str, name: str, content: bytes) -> None:
    """Writes a file of a shared folder, from a task."""
    system, base = fs.FileSystem.from_uri(root) if ":" in root else (fs.LocalFileSystem(), root)
    with system.open_output_stream(f"{base}/{name}") as out:
        out.write(content)


@query("""
    SELECT '00' || o_orderkey AS sample_id, '/s/' || o_orderkey || '.svs' AS image_path, CASE WHEN o_orderstatus = 'F' THEN '/m/' || o_orderkey || '.png' END AS mask_path, CASE WHEN o_orderstatus <> 'O' THEN 0.25 END AS spacing_at_level_0,
      coalesce('p' || c_custkey, '00' || o_orderkey) AS patient_id FROM orders LEFT JOIN customer ON c_custkey = o_custkey AND c_acctbal > 0""")
def manifest_files(spark, sf_dir):
    """Orders saved as a manifest of slides and read again; ids keep their zeros. Patients of some of them come from a second one."""
    root, name = folder(spark), F.col("o_orderkey").cast("string")
    o = table(spark, sf_dir, "orders").select(
        F.concat(F.lit("00"), name).alias("sample_id"), F.concat(F.lit("/s/"), name, F.lit(".svs")).alias("image_path"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("/m/"), name, F.lit(".png"))).alias("mask_path"),
        F.when(F.col("o_orderstatus") != "O", 0.25).alias("spacing_at_level_0"), F.col("o_custkey").alias("c_custkey"),
    )
    manifests.save_slides(o, f"{root}/slides")
    known = table(spark, sf_dir, "customer").where("c_acctbal > 0").select("c_custkey", F.concat(F.lit("p"), F.col("c_custkey").cast("string")).alias("patient_id"))
    manifests.save_csv(o.join(known, "c_custkey").select("sample_id", "patient_id"), f"{root}/patients")
    return tables.patients_of(manifests.slides(spark, f"{root}/slides"), manifests.patients(spark, f"{root}/patients")).select("sample_id", "image_path", "mask_path", "spacing_at_level_0", "patient_id")


@query("""
    WITH s AS (SELECT CAST(l_orderkey AS VARCHAR) AS sample_id, CASE l_returnflag WHEN 'N' THEN NULL WHEN 'R' THEN 'merged' ELSE l_returnflag END AS annotation, count(*) AS n FROM lineitem GROUP BY ALL)
    SELECT sample_id, annotation, CASE WHEN annotation = 'merged' THEN 'merged' END AS output_mode, CASE WHEN n % 3 > 0 THEN CAST(n AS INTEGER) END AS num_tiles, CASE WHEN n % 3 = 0 THEN 'said "no", then' || chr(10) || 'ended, ' || n END AS error,
      'tbp' AS feature_status, n % 3 > 0 AS embeddable FROM s""")
def status_files(spark, sf_dir):
    """Classes of orders as a status table: texts with quotes, commas and line ends survive, columns of later versions are filled in."""
    path = f"{folder(spark)}/status"
    label = F.when(F.col("l_returnflag") == "R", "merged").when(F.col("l_returnflag") != "N", F.col("l_returnflag"))
    s = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").cast("string").alias("sample_id"), label.alias("annotation")).agg(F.count("*").alias("n"))
    fine = F.col("n") % 3 > 0
    said = F.when(~fine, F.concat(F.lit('said "no", then\nended, '), F.col("n").cast("string")))
    made = s.select("sample_id", "annotation", F.lit("/s/x.svs").alias("image_path"), F.when(fine, "success").otherwise("failed").alias("tiling_status"), F.when(fine, F.col("n")).alias("num_tiles"), F.when(fine, "/c/x.npz").alias("coordinates_npz_path"), said.alias("error"))
    manifests.save_csv(made, path)
    tiled = manifests.status(spark, path).select("sample_id", "annotation", "output_mode", "num_tiles", "error", "tiling_status", "coordinates_npz_path")
    out = tables.upsert(tiled.withColumn("embeddable", F.lit(False)), tables.embeddable(tiled).withColumn("embeddable", F.lit(True)), ["embeddable"])
    out = tables.upsert(out.withColumn("feature_status", F.lit(None).cast("string")), manifests.embedding_status(spark, path), ["feature_status"])
    return out.select("sample_id", "annotation", "output_mode", "num_tiles", "error", "feature_status", "embeddable")


@query("""
    WITH n AS (SELECT label, vec_id, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS i, count(*) OVER (PARTITION BY label) AS rows FROM embeddings)
    SELECT label, vec_id AS x, vec_id * 2 AS y, i AS tile_index, round(list_sum(list_transform(embedding, lambda v: CAST(v AS DOUBLE))), 4) AS total, rows FROM n""")
def array_files(spark, sf_dir):
    """Vectors and coordinates of each label as archives of arrays with a sidecar, read back and put together by place."""
    root = folder(spark)

    def write(key, group):
        group = group.sort_values("vec_id")
        for name, content in {"features": {"features": np.stack(group["embedding"].to_numpy()).astype(np.float32), "tile_index": np.arange(len(group))}, "coordinates": {"x": group["vec_id"].to_numpy(), "y": group["vec_id"].to_numpy() * 2}}.items():
            buffer = io.BytesIO()
            np.savez(buffer, **content)
            put(root, f"{key[0]}.{name}.npz", buffer.getvalue())
        put(root, f"{key[0]}.meta.json", b'{\n  "label": %d,\n  "rows": %d\n}' % (key[0], len(group)))
        return pd.DataFrame({"label": [key[0]]})

    each_label(table(spark, sf_dir, "embeddings"), write)
    vectors = arrays.npz_rows(spark, root, pattern="*.features.npz").withColumn("sample_id", F.regexp_replace("sample_id", r"\.features$", ""))
    places = arrays.coordinates(spark, root, "*.coordinates.npz")
    notes = arrays.sidecars(spark, root, "label int, rows long").drop("path")
    total = F.aggregate("embedding", F.lit(0.0), lambda s, v: s + v.cast("double"))
    return vectors.join(places, ["sample_id", "tile_index"]).join(notes, F.col("sample_id") == F.col("label").cast("string")).select("label", "x", "y", "tile_index", X.rounded(total, 4).alias("total"), "rows")


@query("""
    WITH p AS (SELECT label, unnest(list_transform(embedding, lambda v: CAST(floor(abs(v) * 255) AS BIGINT))) AS v FROM embeddings)
    SELECT label, CAST(count(*) // 64 AS INTEGER) AS height, 64 AS width, CAST(sum(v) * 3 AS BIGINT) AS total, count(*) + len('P5' || chr(10) || '# ' || label || chr(10) || '64 ' || count(*) // 64 || chr(10) || '255' || chr(10)) AS size_bytes FROM p GROUP BY label""")
def raster_files(spark, sf_dir):
    """The vectors of each label as rows of a grey image, decoded, and a manifest of them with sizes of files."""
    root = folder(spark)

    def write(key, group):
        pixels = np.floor(np.abs(np.stack(group["embedding"].to_numpy())) * np.float32(255)).astype(np.uint8)
        put(root, f"{key[0]}.pgm", b"P5\n# %d\n64 %d\n255\n" % (key[0], len(pixels)) + pixels.tobytes())
        return pd.DataFrame({"label": [key[0]]})

    each_label(table(spark, sf_dir, "embeddings"), write)
    sized = arrays.with_file_size(arrays.images(spark, root, "*.pgm"), spark, root)
    total = F.aggregate("pixels", F.lit(0).cast("long"), lambda s, v: s + v.cast("long"))
    return sized.select(F.col("sample_id").cast("int").alias("label"), "height", "width", total.alias("total"), "size_bytes")


@query("""
    WITH t AS (SELECT CAST(vec_id % 50 AS VARCHAR) AS sample_id, CASE label % 3 WHEN 0 THEN 'a' END AS annotation, embedding FROM embeddings),
    m AS (SELECT CAST(i AS VARCHAR) AS sample_id, a AS annotation FROM (SELECT unnest(range(0, 52)) AS i), (VALUES (NULL), ('a')) v(a))
    SELECT m.sample_id, m.annotation, count(embedding) AS num_tiles, CAST(max(len(embedding)) AS INTEGER) AS feature_dim, round(sum(CAST(embedding[1] AS DOUBLE)), 4) AS firsts
    FROM m LEFT JOIN t ON t.sample_id = m.sample_id AND t.annotation IS NOT DISTINCT FROM m.annotation GROUP BY ALL""")
def artifact_tables(spark, sf_dir):
    """Tiles stored in two runs, of which the first is sent again, with metadata for units without tiles too; vectors of the samples beside them."""
    root = commits.scratch(spark)
    label = F.when(F.col("label") % 3 == 0, "a").otherwise("tissue")
    bag = table(spark, sf_dir, "embeddings").select((F.col("vec_id") % 50).cast("string").alias("sample_id"), label.alias("annotation"), F.col("vec_id").alias("tile_index"), "embedding")
    units = spark.range(52).select(F.col("id").cast("string").alias("sample_id"), F.explode(F.array(F.lit(None).cast("string"), F.lit("a"))).alias("annotation"))
    for run in (0, 1, 0):
        part = F.length("sample_id") % 2 == run
        artifacts.write_tiles(bag.where(part), units.where(part), root, run=f"part-{run}")
    stored = artifacts.read(spark, root, "tile_embeddings")
    first = stored.groupBy("sample_id", "annotation").agg(F.array(F.sum(F.col("embedding")[0].cast("double"))).alias("embedding"))
    artifacts.write_vectors(first, root, "slide_embeddings")
    meta, vectors = artifacts.read_metadata(spark, root, "tile_embeddings"), artifacts.read(spark, root, "slide_embeddings")
    both = meta.join(vectors, tables.same_unit(meta, vectors, ["sample_id", "annotation"]), "left")
    return both.select(meta["sample_id"], meta["annotation"], "num_tiles", "feature_dim", X.rounded(F.col("embedding")[0], 4).alias("firsts"))


@query("""
    SELECT l_returnflag AS mode, CAST(l_linenumber AS VARCHAR) AS batch_size, count(*) AS trials, round(avg(CAST(l_extendedprice AS DOUBLE) / 7), 4) AS mean_tps, round(stddev_pop(CAST(l_extendedprice AS DOUBLE) / 7), 4) AS std_tps, max(CAST(l_extendedprice AS DOUBLE) / 7) AS max_tps,
      round(avg(CASE WHEN l_discount > 0 THEN CAST(l_discount AS DOUBLE) END), 6) AS mean_wait FROM lineitem GROUP BY 1, 2""")
def trial_files(spark, sf_dir):
    """Results of trials saved by three runs, with blanks where nothing was timed, read as one table and rolled up."""
    root = folder(spark)
    t = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_returnflag").alias("mode"), F.col("l_linenumber").alias("batch_size"), (F.col("l_extendedprice").cast("double") / 7).alias("tps"), F.when(F.col("l_discount") > 0, F.col("l_discount")).alias("wait"))
    for run in range(3):
        manifests.save_csv(t.where(F.col("l_orderkey") % 3 == run).drop("l_orderkey"), f"{root}/run{run}")
    rows = manifests.trials(spark, [f"{root}/run{run}" for run in range(3)], ["tps", "wait"])
    return aggregate.trials(rows, ["mode", "batch_size"], "tps", "wait")


@query("""
    WITH e AS (SELECT vec_id, embedding AS q, list_reverse(embedding) AS k FROM embeddings),
    s AS (SELECT vec_id, h, t, s, exp(sum(CAST(q[h * 32 + t * 4 + d + 1] AS DOUBLE) * 4 * CAST(k[h * 32 + s * 4 + d + 1] AS DOUBLE)) / 2) AS w
      FROM e, (VALUES (0), (1)) a(h), (VALUES (0), (1)) b(t), (SELECT unnest(range(0, 8)) AS s), (SELECT unnest(range(0, 4)) AS d) GROUP BY ALL),
    n AS (SELECT vec_id, h, t, s, w / sum(w) OVER (PARTITION BY vec_id, h, t) AS w FROM s)
    SELECT vec_id, list(round(w, 6) ORDER BY t, h, s) AS maps FROM n WHERE s >= 2 GROUP BY vec_id""")
def attention_maps(spark, sf_dir):
    """Vectors as queries, and reversed as keys, of two heads and eight tokens: maps of the class token and a register over 2 x 3 patches."""
    e = table(spark, sf_dir, "embeddings").select("vec_id", F.transform("embedding", lambda x: x.cast("double") * 4).alias("q"), F.reverse("embedding").cast("array<double>").alias("k"))
    return e.select("vec_id", F.transform(attention.maps_udf(2, 4, 2, (2, 3), True)("q", "k"), lambda x: X.rounded(x, 6)).alias("maps"))


@query("""
    SELECT o_orderkey AS sample_id, CASE WHEN o_custkey % 4 > 0 THEN list_filter([CASE WHEN o_orderstatus <> 'F' THEN 'dtype' END, CASE WHEN o_custkey % 4 = 1 THEN 'pad' END, CASE WHEN o_orderpriority <> '1-URGENT' THEN 'patch' END], lambda x: x IS NOT NULL) END AS differs
    FROM orders WHERE o_custkey % 4 = 0 OR o_orderstatus <> 'F' OR o_custkey % 4 = 1 OR o_orderpriority <> '1-URGENT'""")
def images_to_encode(spark, sf_dir):
    """Images that have no record yet or one that does not agree with what is asked for, with the fields that differ."""
    o = table(spark, sf_dir, "orders").withColumnRenamed("o_orderkey", "sample_id")
    specs = o.select("sample_id", F.create_map(F.lit("dtype"), F.lit("F"), F.lit("patch"), F.lit("1-URGENT")).alias("compatibility"))
    own = F.create_map(F.lit("dtype"), F.col("o_orderstatus"), F.lit("patch"), F.col("o_orderpriority"))
    had = o.where("o_custkey % 4 > 0").select("sample_id", F.when(F.col("o_custkey") % 4 == 1, F.map_concat(own, F.create_map(F.lit("pad"), F.lit("reflect")))).otherwise(own).alias("compatibility"))
    return tables.changed(specs, had, "sample_id").select("sample_id", "differs")


@query(r"""
    WITH p AS (SELECT p_partkey, p_name, p_size, CASE p_size % 4 WHEN 0 THEN '.PNG' WHEN 1 THEN '.svs' WHEN 2 THEN '.txt' ELSE '' END AS ext, CASE p_size % 3 WHEN 0 THEN 'tissue' WHEN 1 THEN 'a b' END AS a FROM part)
    SELECT p_partkey, 'dense_embeddings' || CASE WHEN a = 'a b' THEN '/a b' ELSE '' END AS folder, CAST(p_partkey AS VARCHAR) || '_' || CAST(p_size AS VARCHAR) AS region, CASE p_size % 4 WHEN 0 THEN 'raster' WHEN 1 THEN 'spacing' ELSE 'unsupported' END AS regime,
      CASE WHEN p_size % 2 = 0 THEN p_size || 'px' ELSE p_size || 'x' || (p_size + 1) || 'px' END AS size, CASE p_size % 4 WHEN 1 THEN 'cucim' WHEN 2 THEN 'openslide' WHEN 3 THEN 'asap' ELSE 'asap' END AS backend,
      coalesce(a || ': ', '') || p_partkey AS subject, CAST(floor(CAST(p_partkey AS FLOAT) * CAST(0.252::DOUBLE / 0.5::DOUBLE AS FLOAT)) AS BIGINT) AS x, greatest(14, CAST(round_even(p_size / 14.0, 0) AS BIGINT) * 14) AS stride,
      '[' || '*' || ']' || p_partkey || '[' || '?' || ']' AS pattern FROM p""")
def unit_names(spark, sf_dir):
    """What units are called in folders, files and messages, how their images are read, and where they lie at another spacing."""
    size = F.col("p_size")
    kind = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (size % n + 1).cast("int"))
    p = table(spark, sf_dir, "part").withColumn("a", F.when(size % 3 == 0, "tissue").when(size % 3 == 1, "a b")).withColumn("path", F.concat(F.lit("/i/"), F.col("p_partkey").cast("string"), kind(4, ".PNG", ".svs", ".txt", "")))
    name = F.col("p_partkey").cast("string")
    return p.select(
        "p_partkey", X.artifact_dir("dense_embeddings", "a").alias("folder"), X.region_name("p_partkey", "p_size").alias("region"), X.reader_regime("path").alias("regime"), X.size_label(size, size + size % 2).alias("size"),
        X.backend(kind(4, "auto", "cucim", "auto", "auto"), kind(4, "auto", "openslide", "openslide", "")).alias("backend"), X.subject("a", name).alias("subject"), X.scaled_float32("p_partkey", F.lit(0.252), F.lit(0.5)).alias("x"),
        X.round_to("p_size", 14).alias("stride"), X.glob_escaped(F.concat(F.lit("*"), name, F.lit("?"))).alias("pattern"),
    )


@query("""
    WITH t AS (SELECT CAST(vec_id % 20 AS VARCHAR) AS sample_id, CASE WHEN label % 3 = 0 THEN 'a' END AS annotation, list_avg(list_transform(embedding[1:32], lambda v: CAST(v AS DOUBLE))) AS h FROM embeddings),
    u AS (SELECT sample_id, annotation, count(*) AS n, round(avg(CAST(h AS FLOAT)), 5) AS first_half FROM t GROUP BY ALL)
    SELECT sample_id, annotation, n AS num_tiles, CASE WHEN CAST(sample_id AS INTEGER) % 5 > 0 THEN first_half END AS first_half, CASE WHEN CAST(sample_id AS INTEGER) % 5 > 0 THEN 'success' ELSE 'tbp' END AS feature_status FROM u""")
def run_after_tiling(spark, sf_dir):
    """Vectors as tiles of twenty slides with two classes, run from a status table in which the classes of every fifth slide have no coordinates."""
    name, label = (F.col("vec_id") % 20).cast("string"), F.when(F.col("label") % 3 == 0, "a").otherwise("tissue")
    bag = table(spark, sf_dir, "embeddings").select(name.alias("sample_id"), label.alias("annotation"), F.col("vec_id").alias("tile_index"), F.col("embedding").alias("pixels"))
    fine = F.col("sample_id").cast("int") % 5 > 0
    status = bag.groupBy("sample_id", "annotation").agg(F.count("*").alias("num_tiles")).withColumn("tiling_status", F.lit("success")).withColumn("coordinates_npz_path", F.when(fine, "/c/x.npz"))
    slides = bag.select("sample_id").distinct()
    made = Pipeline(Model.from_preset("halves-slide", registry=stand_ins()), commits.scratch(spark)).run_tiled(slides, status, bag)
    both = made.status.join(made.slides, tables.same_unit(made.status, made.slides, ["sample_id", "annotation"]), "left")
    return both.select(made.status["sample_id"], made.status["annotation"], "num_tiles", X.rounded(F.col("embedding")[0], 5).alias("first_half"), "feature_status")
