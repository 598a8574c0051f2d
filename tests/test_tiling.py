"""From tiling to encoding: guards, units, tilings beside samples, records of regions; settings of tilers and recipes of grids."""

import json

import pytest
from pyspark.sql import functions as F

from tesserae.functions import encoders, records
from tesserae.operators import tables, tiling
from tesserae.plans import recipes, settings

STATUS = "sample_id string, annotation string, tiling_status string, error string, num_tiles string, coordinates_npz_path string, mask_preview string, written int"


def status(spark, *rows):
    return spark.createDataFrame(rows, STATUS)


def samples(spark, *names):
    return spark.createDataFrame([(n, f"/s/{n}.tif") for n in names], "sample_id string, image_path string")


def test_units_fan_out_by_class(spark):
    s = status(
        spark, ("a", None, "success", None, "3", "/c/a", None, 0), ("a", "tumour", "success", None, "2", "/c/at", None, 0), ("b", None, "success", None, "0", "/c/b", None, 0),
        ("c", None, "success", None, "4", None, None, 0), ("other", None, "failed", "no mask", None, None, None, 0),
    )
    got = tiling.units(samples(spark, "a", "b", "c"), s).collect()
    assert {(r.sample_id, r.image_path, r.annotation, r.num_tiles) for r in got} == {("a", "/s/a.tif", None, "3"), ("a", "/s/a.tif", "tumour", "2")}
    assert tiling.units(samples(spark, "a").limit(0), s).count() == 0
    with pytest.raises(tables.TableError, match="tiling failed for other: no mask"):
        tiling.units(samples(spark, "a", "other"), s)
    with pytest.raises(tables.TableError, match="zz has no status"):
        tiling.units(samples(spark, "a", "zz"), s)
    late = s.union(status(spark, ("a", "late", None, None, None, None, None, 0)))
    with pytest.raises(tables.TableError, match="tiling failed for a"):
        tiling.units(samples(spark, "a"), late)


def test_prepared_fills_and_restores(spark):
    now = status(spark, ("a", None, "success", None, "3", "/c/a", None, 1), ("a", "t", "success", None, "2", "/c/new", None, 1))
    before = status(spark, ("a", None, "success", None, "3", "/c/a", "/p/a.png", 0), ("a", "t", "success", None, "2", "/c/at", "/p/t.png", 0)).withColumn("backend", F.lit("x"))
    found = spark.createDataFrame([("a", "t", "y", 1), ("a", None, "z", 0)], "sample_id string, annotation string, backend string, written int")
    now = now.withColumn("backend", F.lit(None).cast("string"))
    table, units = tiling.prepared(samples(spark, "a"), now, found, before, fill=["backend"], compare=["coordinates_npz_path", "num_tiles"], restore=["mask_preview"])
    assert {(r.annotation, r.backend, r.mask_preview) for r in table.collect()} == {(None, "z", "/p/a.png"), ("t", "y", None)}
    assert units.count() == 2 and {r.mask_preview for r in units.collect()} == {"/p/a.png", None}


def test_beside(spark):
    s = samples(spark, "a", "b").withColumn("place", F.ascii("sample_id") - 97)
    by_name = spark.createDataFrame([("b", 2), ("a", 1), ("c", 3)], "sample_id string, n int")
    assert {(r.sample_id, r.n) for r in tiling.beside(s, by_name).collect()} == {("a", 1), ("b", 2)}
    by_place = spark.createDataFrame([(1, 20), (0, 10)], "place int, n int")
    assert {(r.sample_id, r.image_path, r.n) for r in tiling.beside(s, by_place, place="place").collect()} == {("a", "/s/a.tif", 10), ("b", "/s/b.tif", 20)}
    for bad, how in ((by_name.where("n > 1"), {}), (by_name.union(by_name), {}), (by_place.limit(1), {"place": "place"}), (by_place.union(spark.createDataFrame([(2, 30)], by_place.schema)), {"place": "place"})):
        with pytest.raises(tables.TableError):
            tiling.beside(s, bad, **how)


def test_region_records(spark):
    plan = records.record(records.READ_PLAN, declared_spacing_um=0.5, read_spacing_um=0.25, source_spacing_um=0.25, tolerance=0.05, read_level=0, is_within_tolerance=False, spacing_at_level_0=0.25)
    rows = spark.createDataFrame([("a", 9, 0), ("a", 1, 5), ("b", 0, 0), ("a", 1, 0)], "sample_id string, x int, y int").withColumn("read_plan", plan).withColumn("read_tile_size_px", F.lit(448)).withColumn("requested_tile_size_px", F.lit(224))
    got = tiling.region_records(rows).orderBy("sample_id", "tile_index").collect()
    assert [(r.sample_id, r.tile_index, r.x, r.y) for r in got] == [("a", 0, 1, 0), ("a", 1, 9, 0), ("a", 2, 1, 5), ("b", 0, 0, 0)]
    assert (got[0].tile_size_lv0, got[0].step_px_lv0, got[0].base_spacing_um, got[0].requested_spacing_um, got[0].tissue_fraction, got[0].is_within_tolerance) == (448, 448, 0.25, 0.5, 1.0, False)
    with pytest.raises(tables.TableError, match="without spacings"):
        tiling.region_records(rows.withColumn("read_plan", records.record(records.READ_PLAN, declared_spacing_um=0.5, tolerance=0.05)))


def test_tiling_settings():
    p = {"requested_spacing_um": 0.5, "requested_tile_size_px": 224}
    cfg = lambda params=(), masks=None: settings.deep_merge(settings.DEFAULTS["tiling"], {"params": p | dict(params)} | ({"masks": masks} if masks else {}))
    plain = settings.tiling(cfg())
    assert (plain["size_px"], plain["step_px"], plain["by_class"], plain["min_coverage"]) == (224, 224, False, {"background": None, "tissue": 0.1})
    assert settings.tiling(cfg({"region_tile_multiple": 6, "overlap": 0.25}))["size_px"] == 1344
    assert settings.tiling(cfg({"overlap": 0.25}))["step_px"] == 168
    classes = settings.tiling(cfg(masks={"output_mode": "merged", "pixel_mapping": {"tumour": 2}, "min_coverage": {"tumour": 0.5}}))
    assert classes["by_class"] and classes["output_mode"] == "merged" and classes["pixel_mapping"]["tumour"] == 2
    for bad, what in (
        (cfg(masks={"pixel_mapping": {"t": 1}}), "share mask values"), (cfg(masks={"pixel_mapping": {"t": 256}}), "0 to 255"), (cfg(masks={"pixel_mapping": {"a/b": 3}}), "folders"), (cfg(masks={"min_coverage": {"x": 0.1}}), "no mask values"),
        (cfg(masks={"min_coverage": {"tissue": 2}}), "is a share"), (cfg(masks={"min_coverage": {"tissue": None}}), "no class"), (cfg(masks={"output_mode": "x"}), "output mode"), (cfg({"overlap": 1.0}), "part of a tile"), (cfg({"requested_spacing_um": None}), "spacing above zero"),
    ):
        with pytest.raises(ValueError, match=what):
            settings.tiling(bad)


def test_image_grid_records(spark):
    r = encoders.catalogue()
    recipe = recipes.image_grids(r, "uni", (250, 204), precision="half", window=48, overlap=0.5, output_dtype="fp32")
    assert (recipe["encoded_size"], recipe["pad"], recipe["grid_shape"], recipe["spacing_source"], recipe["precision"], recipe["dtype"]) == ((256, 208), (6, 4), (16, 13), "unknown", "fp16", "float32")
    row = spark.range(1).select(F.to_json(recipes.image_grid_record(recipe, F.lit("a"), F.lit("/i/a.png"), F.lit(1024)), {"ignoreNullFields": "false"}).alias("j")).first()
    made = json.loads(row.j)
    assert list(made)[:-1] == recipes.GRID_RECORD and made["grid_shape"] == [16, 13] and made["attention_blocks"] == [] and made["backend"] == "pil"
    same = made["compatibility"]
    assert list(same)[:4] == ["sample_id", "image_path", "encoder_name", "output_variant"] and {n: made[n] for n in same if n in made} == {n: v for n, v in same.items() if n in made}
    for bad in ({"precision": None}, {"pad_mode": "none"}, {"kind": contracts_kind()}, {"variant": "nope"}, {"output_dtype": "bf16"}):
        with pytest.raises(ValueError):
            recipes.image_grids(r, "uni", 224, **({"precision": "fp32"} | bad))
    with pytest.raises(ValueError):
        recipes.image_grids(r, "musk", 256, precision="fp16")


def contracts_kind():
    from tesserae.functions import contracts

    return contracts.KINDS[1]  # needs blocks


def test_requests_against_contracts(spark):
    """The same complaints as the registry's own, request by request."""
    r = encoders.catalogue()
    rows = [(n, size, spacing) for n in r.encoders for size in (224, 230, 448) for spacing in (0.5, 1.0)] + [("nobody", 224, 0.5)]
    got = encoders.accepted(spark.createDataFrame(rows, "encoder_name string, size_px int, spacing_um double"), r).collect()
    assert len(got) == len(rows)
    for row in got:
        if row.encoder_name == "nobody":
            assert row.complaints == ["encoder"] and row.level is None
        else:
            said = r.complaints(row.encoder_name, row.spacing_um, row.size_px, r.get(row.encoder_name).precision)
            assert [c.split()[0] for c in said] == row.complaints
