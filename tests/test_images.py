"""Image expressions, file scans, records and the run from tiles to stored vectors."""

import io
import json
import tarfile

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import encoders, pixels, records
from tesserae.functions import expressions as X
from tesserae.functions.registry import Encoder
from tesserae.plans import imaging, registered
from tesserae.plans.pipeline import Model, Pipeline, slide_vectors_of
from tesserae.sources import arrays, tars

IMAGE = np.arange(12, dtype=float).reshape(3, 4)


@pytest.fixture(scope="module")
def image(spark):
    return spark.createDataFrame([(IMAGE.ravel().tolist(), 3, 4)], "pixels array<double>, h int, w int")


def value(df, c):
    return df.select(c.alias("v")).first().v


@pytest.mark.parametrize(("mode", "same"), [("reflect", "reflect"), ("replicate", "edge"), ("zero", "constant")])
def test_padding(image, mode, same):
    got = value(image, pixels.padded("pixels", "h", "w", F.lit(5), F.lit(6), mode))
    assert np.array_equal(np.reshape(got, (5, 6)), np.pad(IMAGE, ((0, 2), (0, 2)), mode=same))


def test_reflect_needs_a_smaller_pad(image):
    assert value(image, pixels.padded("pixels", "h", "w", F.lit(6), F.lit(6), "reflect")) is None


def test_crops(image):
    assert value(image, pixels.center_crop("pixels", "h", "w", 2)) == [1, 2, 5, 6]
    assert value(image, pixels.center_crop("pixels", "h", "w", 4)) is None
    assert value(image, pixels.cropped_read("pixels", "h", "w", F.lit(-1), F.lit(-1), F.lit(3))) == [255, 255, 255, 255, 0, 1, 255, 4, 5]


def test_channels(spark):
    rgb = np.arange(12, dtype=float).reshape(2, 2, 3)
    df = spark.createDataFrame([(rgb.ravel().tolist(),)], "p array<double>")
    assert np.allclose(value(df, pixels.normalised("p", [1, 2, 3], [2, 2, 2])), ((rgb - [1, 2, 3]) / 2).ravel())
    assert value(df, pixels.center_crop("p", F.lit(2), F.lit(2), 1, 3)) == [0, 1, 2]


def test_resize_and_unfold(spark, image):
    assert value(image, pixels.resize_udf((1, 2))("pixels", "h", "w")) == [IMAGE[:, :2].mean(), IMAGE[:, 2:].mean()]
    assert value(image, pixels.resize_udf((3, 4), "bicubic")("pixels", "h", "w")) == IMAGE.ravel().tolist()
    df = spark.createDataFrame([(list(map(float, range(16))), 4)], "p array<double>, n int")
    assert value(df, pixels.unfolded("p", "n", 2)) == [[0, 1, 4, 5], [2, 3, 6, 7], [8, 9, 12, 13], [10, 11, 14, 15]]
    assert value(df, pixels.unfolded("p", "n", 3)) is None


def test_rounds_to_zero_with_its_sign(spark, tmp_path):
    """As the SQL does, whose -0.0 is another text than 0.0."""
    spark.createDataFrame([(0, [-4e-7] * 32 + [4e-7] * 32)], "vec_id long, embedding array<float>").write.parquet(f"{tmp_path}/embeddings.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW embeddings AS SELECT * FROM '{tmp_path}/embeddings.parquet/*.parquet'")
    ours, theirs = imaging.area_resize(spark, str(tmp_path)).first().pixels, con.execute(registered.ORACLE_SQL["area_resize"]).fetchone()[1]
    assert repr(ours) == repr(theirs) == repr([-0.0] * 8 + [0.0] * 8)
    values = [-4e-7, 4e-7, -0.0, -5e-7, 2.5e-6, -1.0, float("inf"), None]
    df = spark.createDataFrame([(v,) for v in values], "v double").coalesce(1)
    assert repr([r[0] for r in df.select(X.rounded("v", 6)).collect()]) == repr([con.execute("SELECT round(?::DOUBLE, 6)", [v]).fetchone()[0] for v in values])


@pytest.mark.parametrize(("n", "m"), [(5, 2), (7, 3), (4, 4), (9, 4)])
def test_weights_keep_flat_images(n, m):
    for made in pixels.WEIGHTS.values():
        w = made(n, m)
        assert w.shape == (m, n) and np.allclose(w.sum(1), 1)


def test_arrays(spark, tmp_path):
    np.savez(tmp_path / "s1.npz", features=np.ones((3, 2), np.float32))
    np.savez(tmp_path / "s2.npz", features=np.zeros((2, 2), np.float32), tile_index=np.array([5, 3]))
    rows = arrays.npz_rows(spark, str(tmp_path)).collect()
    assert sorted((r.sample_id, r.tile_index) for r in rows) == [("s1", 0), ("s1", 1), ("s1", 2), ("s2", 3), ("s2", 5)]
    np.savez(tmp_path / "s3.coordinates.npz", x=np.array([4, 5]), y=np.array([6, 7]))
    assert [tuple(r) for r in arrays.coordinates(spark, str(tmp_path), "*.coordinates.npz").orderBy("tile_index").collect()] == [("s3", 0, 4, 6), ("s3", 1, 5, 7)]
    (tmp_path / "s1.meta.json").write_text(json.dumps({"feature_dim": 2}))
    assert arrays.sidecars(spark, str(tmp_path), "feature_dim int").first().feature_dim == 2
    assert arrays.listing(spark, str(tmp_path), "s1.npz").first().size_bytes == (tmp_path / "s1.npz").stat().st_size


def test_tar_tiles(spark, tmp_path):
    with tarfile.open(tmp_path / "k.tiles.tar", "w") as tar:
        for name in ("b.ppm", "a.ppm"):
            content = b"P6\n# made here\n2 1\n255\n" + bytes([1, 2, 3, 4, 5, ord(name[0])])
            member = tarfile.TarInfo(name)
            member.size = len(content)
            tar.addfile(member, io.BytesIO(content))
    tiles = tars.tiles(spark, str(tmp_path))
    got = [(r.sample_id, r.tile_index, r.pixels[-1], r.height, r.width) for r in arrays.decoded(tiles).orderBy("tile_index").collect()]
    assert got == [("k", 0, 97.0, 1, 2), ("k", 1, 98.0, 1, 2)]
    with pytest.raises(Exception, match="no tile 7 of k"):
        tars.tiles(spark, str(tmp_path), spark.createDataFrame([("k", 7)], "sample_id string, tile_index long")).collect()


def test_level_choice_and_plans(spark):
    def choice(level0, downsamples):
        return records.level_choice(F.lit(0.5), F.lit(level0), F.array(*map(F.lit, downsamples)), 0.05)

    df = spark.range(1)
    assert tuple(value(df, choice(0.25, [1.0, 4.0]))) == (0, 0.25, False)
    assert tuple(value(df, choice(0.252, [1.0, 2.0]))) == (1, 0.504, True)
    assert tuple(value(df, choice(1.0, [1.0, 2.0]))) == (0, 1.0, False)
    plan = records.image_plan(choice(0.25, [1.0, 4.0]), F.lit(1001), F.lit(802), F.lit(0.5), spacing_source="explicit")
    p = value(df, plan)
    assert (p.output_size, p.effective_spacing_um) == ([500, 401], 0.5)
    again = value(df, records.from_json(records.as_json(plan), records.READ_PLAN))
    assert again == p
    region = value(df, records.region_plan(choice(0.25, [1.0, 4.0]), F.lit(224), F.lit(0.5)))
    assert (region.read_size, region.output_size) == ([448, 448], [224, 224])
    with pytest.raises(ValueError, match="colour"):
        records.record(records.SLIDE_METADATA, colour="red")


def test_catalogue_of_encoders():
    assert len(encoders.list_models()) == 34 and len(encoders.list_models("slide")) == 5
    r = encoders.catalogue()
    assert r.variant("virchow2") == ("cls_patch_mean", 2560) and r.variant("virchow2", "cls") == ("cls", 1280)
    assert r.preprocessing("titan") == (0.5, 448)
    assert encoders.input_size(r, "uni", 256) == 256
    for bad in (0, 250):
        with pytest.raises(ValueError):
            encoders.input_size(r, "uni", bad)


@pytest.fixture
def registry():
    out = encoders.catalogue()
    out.register(Encoder("t", "tile", {"default": 2}, lambda: lambda x: np.stack([x.mean(1), x.std(1)], 1), 4, (1, 1), (0.5,)))
    for name, level in (("s", "slide"), ("p", "patient")):
        out.register(Encoder(name, level, {"default": 2}, None, None, None, (0.5,), "fp32", "t"))
    return out


def test_run(spark, tmp_path, registry):
    tiles = spark.createDataFrame([("a", None, 0, [1.0, 2.0]), ("a", None, 1, [3.0, 4.0]), ("b", "tumor", 0, [5.0, 5.0])], "sample_id string, annotation string, tile_index int, pixels array<float>")
    slides = spark.createDataFrame([("a",), ("b",), ("c",)], "sample_id string")
    who = spark.createDataFrame([("a", "x")], "sample_id string, patient_id string")

    tile = Pipeline(Model.from_preset("t", registry=registry), f"{tmp_path}/t", resume=True)
    for _ in range(2):  # the second run has nothing left to do
        r = tile.run(slides, tiles)
        assert sorted((x.sample_id, x.tile_index, x.embedding) for x in r.tiles.collect()) == [("a", 0, [1.5, 0.5]), ("a", 1, [3.5, 0.5]), ("b", 0, [5.0, 0.0])]
        assert {x.feature_status for x in r.status.collect()} == {"success"}
        assert [x.sample_id for x in r.skipped.collect()] == ["c"]

    # Slides with stored tiles, classes null only and then one that reads like a number: a second run adds nothing.
    for k, some in enumerate((tiles.withColumn("annotation", F.lit(None).cast("string")), tiles.withColumn("annotation", F.when(F.col("sample_id") == "b", "01")))):
        runs = []
        for _ in range(2):
            r = Pipeline(Model.from_preset("s", registry=registry), f"{tmp_path}/s{k}", resume=True, save_tiles=True).run(slides, some)
            runs.append((sorted((x.sample_id, x.annotation or "", x.embedding) for x in r.slides.collect()), r.tiles.count()))
        label = "01" if k else ""
        assert runs[0] == runs[1] == ([("a", "", [2.5, 0.5]), ("b", label, [5.0, 0.0])], 3)
    more = Pipeline(Model.from_preset("s", registry=registry), f"{tmp_path}/s1", resume=True, save_tiles=True).run(slides, tiles.withColumn("annotation", F.when(F.col("sample_id") == "b", "02")))
    assert sorted((x.sample_id, x.annotation or "") for x in more.slides.collect()) == [("a", ""), ("b", "01"), ("b", "02")] and more.tiles.count() == 4
    for _ in range(2):
        r = Pipeline(Model.from_preset("p", registry=registry), f"{tmp_path}/pr", resume=True, save_tiles=True, save_slides=True).run(slides, tiles, who)
        assert (r.tiles.count(), r.slides.count(), r.patients.count()) == (3, 2, 2)

    r = Pipeline(Model.from_preset("p", registry=registry), f"{tmp_path}/p", save_slides=True).run(slides, tiles, who)
    assert sorted((x.patient_id, x.embedding, x.num_slides) for x in r.patients.collect()) == [("b", [5.0, 0.0], 1), ("x", [2.5, 0.5], 1)]
    assert {x.patient_id: x.slide_embeddings for x in slide_vectors_of(r.slides, who).collect()} == {"b": {"b": [5.0, 0.0]}, "x": {"a": [2.5, 0.5]}}
    only = Pipeline(Model.from_preset("s", registry=registry), f"{tmp_path}/s").run(slides, tiles, tiling_only=True)
    assert only.slides is None and only.status.count() == 3


def test_model(spark, registry):
    tiles = spark.createDataFrame([("a", "x", 0, [1.0, 2.0]), ("a", "y", 0, [3.0, 4.0])], "sample_id string, annotation string, tile_index int, pixels array<float>")
    pooled = Model.from_preset("s", registry=registry, pool=lambda bag: [float(len(bag)), 0.0])
    assert {r.annotation: r.embedding for r in pooled.embed_slides(tiles).collect()} == {"x": [1.0, 0.0], "y": [1.0, 0.0]}
    assert pooled.embed_slide(tiles, "a", "y").count() == 1
    with pytest.raises(KeyError, match="'x', 'y'"):
        pooled.embed_slide(tiles, "a", "z")
    with pytest.raises(ValueError, match="no implementation"):
        Model.from_preset("uni").embed_tiles(tiles)
    with pytest.raises(ValueError, match="not on patients"):
        pooled.embed_patients(tiles)
