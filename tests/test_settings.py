"""Settings, event lines and timings."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from tesserae.functions import encoders
from tesserae.plans import settings
from tesserae.streaming import events, lines


def test_later_settings_win(tmp_path):
    (tmp_path / "run.yaml").write_text("model:\n  name: uni\n  batch_size: 8\ntiling:\n  masks:\n    pixel_mapping:\n      tumor: 2\n")
    cfg = settings.load(tmp_path / "run.yaml", ["model.batch_size=16", "output_dir=out", "resume=true"])
    assert (cfg["model"]["batch_size"], cfg["output_dir"], cfg["resume"]) == (16, "out", True)
    assert cfg["tiling"]["masks"]["pixel_mapping"] == {"background": 0, "tissue": 1, "tumor": 2}
    assert settings.DEFAULTS["model"]["batch_size"] == 32
    with pytest.raises(ValueError, match="key=value"):
        settings.load(options=["oops"])


def test_encoder_fills_what_is_missing():
    r = encoders.catalogue()
    full = settings.with_encoder(settings.load(options=["model.name=uni", "tiling.params.region_tile_multiple=4"]), r)
    p = full["tiling"]["params"]
    assert (p["requested_spacing_um"], p["requested_tile_size_px"], p["requested_region_size_px"], full["speed"]["precision"]) == (0.5, 224, 896, "fp16")
    wrong = settings.load(options=["model.name=uni", "speed.precision=fp32"])
    with pytest.raises(ValueError, match="precision"):
        settings.with_encoder(wrong, r)
    assert settings.with_encoder(settings.deep_merge(wrong, {"model": {"allow_non_recommended_settings": True}}), r)["warnings"]
    assert settings.with_encoder(wrong, r, on_cpu=True)["speed"] == {"precision": "fp32", "output_dtype": None, "num_gpus": 1}


def test_scalars():
    assert [settings.precision(x) for x in (None, " Half ", "bfloat16")] == [None, "fp16", "bf16"]
    assert [settings.output_dtype(*x) for x in (("float32", "fp16"), (None, "fp16"), (None, "bf16"))] == ["fp32", "fp16", "fp32"]
    for bad in ("int8", "bf16"):
        with pytest.raises(ValueError):
            settings.output_dtype(bad)
    for bad in ({"requested_tile_size_px": 10, "requested_region_size_px": 25}, {"requested_tile_size_px": 10, "region_tile_multiple": 1}, {"region_tile_multiple": 2}):
        with pytest.raises(ValueError):
            settings.regions(bad)
    assert settings.run_id(datetime(2024, 1, 2, 3, 4)) == "2024-01-02_03_04"


def test_lines(spark):
    df = spark.createDataFrame(
        [
            (1, "model.ready", {"model_name": "uni", "device": "cpu"}),
            (2, "embedding.finished", {"slides_completed": "3", "slide_count": "4", "tile_artifacts": "3", "slide_artifacts": "0", "slides_skipped": "1"}),
            (3, "tiling.finished", {"completed": "1", "total": "1", "failed": "0", "discovered_tiles": "9", "empty_masks": "x"}),
            (4, "other", {}),
        ],
        "n int, kind string, payload map<string,string>",
    )
    got = {r.n: r.line for r in df.select("n", lines.line("kind", "payload").alias("line")).collect()}
    assert got == {
        1: "Encoder uni is on cpu",
        2: "Encoded 3 of 4 slides; stored 3 of tiles and 0 of slides, 1 skipped",
        3: "Tiling finished: 1/1 complete, 0 failed, 9 tiles",
        4: None,
    }
    rows = lines.summary_rows(df.where("n = 2")).orderBy("place").collect()
    assert [(r.label, r.value) for r in rows] == [("Slides w/ tiles", "4"), ("Completed", "3"), ("Skipped", "1"), ("Failed", "1")]


def test_throttling_counts_from_what_was_shown(spark):
    df = spark.createDataFrame([("k", "a", 0.0), ("k", "a", 0.6), ("k", "a", 1.2), ("k", "b", 1.3), ("k", "a", 1.4)], "key string, line string, s double").select("key", "line", F.timestamp_micros((F.col("s") * 1e6).cast("long")).alias("ts"))
    got = events.throttled(df).select("line", (F.unix_micros("ts") / 1e6).alias("s")).orderBy("s").collect()
    assert [(r.line, r.s) for r in got] == [("a", 0.0), ("a", 1.2), ("b", 1.3), ("a", 1.4)]


def test_pairs_and_timings(spark):
    ev = spark.createDataFrame([("a", "start", 0), ("a", "start", 2), ("a", "end", 5), ("a", "end", 9), ("b", "end", 1)], "s string, kind string, t int").select("s", "kind", F.timestamp_seconds("t").alias("ts"))
    got = {r.s: r.seconds for r in lines.paired_seconds(ev, ["s"], "kind", "ts", ["ts"], "start", "end").collect()}
    assert got == {"a": 3.0, "b": None}
    none = spark.createDataFrame([], "payload map<string,string>")
    row = lines.batch_timings(none).first().asDict()
    assert row.pop("timed_batches") == 0 and set(row.values()) == {0.0}
    one = lines.batch_timings(spark.createDataFrame([({"loader_wait_ms": "1", "forward_ms": "3"},)], "payload map<string,string>")).first()
    assert (one.loader_wait_fraction, one.forward_fraction, one.mean_preprocess_ms) == (0.25, 0.75, 0.0)
