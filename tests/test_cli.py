"""The command line, from a manifest and tiles to stored slide vectors."""

import pytest

from tesserae.plans import cli


def test_run(spark, tmp_path, monkeypatch):
    (tmp_path / "plugged_here.py").write_text(
        "from tesserae.functions.registry import Encoder\n\n"
        "def register(r):\n"
        "    r.register(Encoder('t1', 'tile', {'default': 1}, lambda: lambda x: x.mean(1, keepdims=True), 4, (1, 1), (0.5,)))\n"
        "    r.register(Encoder('s1', 'slide', {'default': 1}, None, None, None, (0.5,), 'fp32', 't1'))\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    from pyspark import cloudpickle

    import plugged_here

    cloudpickle.register_pickle_by_value(plugged_here)
    (tmp_path / "slides.csv").write_text("sample_id,image_path\n0007,/s/0007.tif\nNA,/s/NA.tif\n")
    spark.createDataFrame([("0007", None, 0, [1.0, 3.0]), ("0007", None, 1, [5.0, 7.0])], "sample_id string, annotation string, tile_index int, pixels array<float>").write.parquet(f"{tmp_path}/tiles")
    args = ["--tiles", f"{tmp_path}/tiles", "--encoders", "plugged_here", f"csv={tmp_path}/slides.csv", "model.name=s1", f"output_dir={tmp_path}/out"]
    r = cli.run(spark, args)
    assert [(x.sample_id, x.embedding) for x in r.slides.collect()] == [("0007", [4.0])]
    assert {(x.sample_id, x.feature_status) for x in r.status.collect()} == {("0007", "success"), ("NA", "success")}
    with pytest.raises(ValueError, match="csv"):
        cli.run(spark, [*args[:4], "model.name=s1"])


def test_run_after_tiling(spark, tmp_path, monkeypatch):
    """Classes by the settings' least coverages of a mask, and units by a tiler's status table."""
    (tmp_path / "plugged_too.py").write_text(
        "from tesserae.functions.registry import Encoder\n\n"
        "def register(r):\n"
        "    r.register(Encoder('t2', 'tile', {'default': 1}, lambda: lambda x: x.mean(1, keepdims=True), 4, (1, 1), (0.5,)))\n"
        "    r.register(Encoder('s2', 'slide', {'default': 1}, None, None, None, (0.5,), 'fp32', 't2'))\n"
    )
    monkeypatch.syspath_prepend(str(tmp_path))
    from pyspark import cloudpickle

    import plugged_too

    cloudpickle.register_pickle_by_value(plugged_too)
    (tmp_path / "slides.csv").write_text("sample_id,image_path\na,/s/a.tif\nb,/s/b.tif\n")
    tiles = [("a", 0, 0, 0, 4, [1.0]), ("a", 1, 4, 0, 4, [5.0]), ("a", 2, 8, 0, 4, [9.0]), ("b", 0, 0, 0, 4, [7.0])]
    spark.createDataFrame(tiles, "sample_id string, tile_index int, x long, y long, size long, pixels array<float>").write.parquet(f"{tmp_path}/tiles")
    mask = [1, 1, 2, 2, 0, 2] * 2  # two mask pixels a tile's side
    spark.createDataFrame([("a", mask, 6, 2.0), ("b", [0] * 12, 6, 2.0)], "sample_id string, mask array<int>, mask_width int, mask_downsample double").write.parquet(f"{tmp_path}/masks")
    head = "sample_id,annotation,image_path,tiling_status,num_tiles,coordinates_npz_path,error\n"
    (tmp_path / "status.csv").write_text(head + "a,tissue,/s/a.tif,success,1,/c/a,\na,tumour,/s/a.tif,success,2,/c/at,\nb,tissue,/s/b.tif,success,0,,\n")
    classes = ['tiling.masks.pixel_mapping={"tumour": 2}', 'tiling.masks.min_coverage={"tissue": 0.5, "tumour": 0.5}']
    args = ["--tiles", f"{tmp_path}/tiles", "--masks", f"{tmp_path}/masks", "--encoders", "plugged_too", f"csv={tmp_path}/slides.csv", "model.name=s2", *classes]
    r = cli.run(spark, ["--status", f"{tmp_path}/status.csv", *args, f"output_dir={tmp_path}/out"])
    assert {(x.annotation, x.embedding[0]) for x in r.slides.collect()} == {(None, 1.0), ("tumour", 7.0)}
    assert {(x.sample_id, x.annotation, x.feature_status) for x in r.status.collect()} == {("a", None, "success"), ("a", "tumour", "success"), ("b", None, "tbp")}
    (tmp_path / "bad.csv").write_text(head + "a,,/s/a.tif,success,1,/c/a,\nb,,/s/b.tif,failed,,,no mask\n")
    with pytest.raises(Exception, match="tiling failed for b: no mask"):
        cli.run(spark, ["--status", f"{tmp_path}/bad.csv", *args, f"output_dir={tmp_path}/out2"])
    (tmp_path / "more.csv").write_text(head + "a,,/s/a.tif,success,1,/c/a,\na,other,/s/a.tif,success,3,/c/o,\nb,,/s/b.tif,success,0,,\n")
    lost = cli.run(spark, ["--status", f"{tmp_path}/more.csv", *args, f"output_dir={tmp_path}/out3"])
    assert {(x.sample_id, x.annotation, x.feature_status) for x in lost.status.collect()} == {("a", None, "success"), ("a", "other", "error"), ("b", None, "tbp")}
    with pytest.raises(ValueError, match="share mask values"):
        cli.run(spark, [*args, f"output_dir={tmp_path}/out4", 'tiling.masks.pixel_mapping={"x": 1}'])
