"""Literal cases of operators that the catalogue's tables don't reach."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import expressions as X
from tesserae.operators import aggregate, partitioning, spatial, tables
from tesserae.sources import artifacts, manifests


def one(spark, **columns):
    return spark.range(1).select(*(c.alias(k) for k, c in columns.items())).first()


@pytest.mark.parametrize(("n", "shards", "sizes"), [(10, 4, [3, 3, 2, 2]), (10, 3, [4, 3, 3]), (2, 4, [1, 1])])
def test_contiguous_shards(spark, n, shards, sizes):
    rows = partitioning.contiguous_shards(spark.range(n), shards, ["id"]).groupBy("shard").count().orderBy("shard").collect()
    assert [r["count"] for r in rows] == sizes


@pytest.mark.parametrize(("units", "ranks", "want"), [("a9 b8 c7 d6", 2, {0: "ad", 1: "bc"}), ("a10 b10 c10 d1 e1", 3, {0: "ad", 1: "be", 2: "c"})])
def test_balanced(spark, units, ranks, want):
    df = spark.createDataFrame([(u[0], int(u[1:])) for u in units.split()], "u string, w long")
    got = {}
    for r in partitioning.balanced(df, ranks, "w", "u").orderBy("u").collect():
        got[r["rank"]] = got.get(r["rank"], "") + r["u"]
    assert got == want


def test_geometry(spark):
    r = one(
        spark,
        a=X.window_starts(F.lit(64), F.lit(32), F.lit(16)),
        b=X.window_starts(F.lit(64), F.lit(32), F.lit(24)),
        c=X.window_starts(F.lit(20), F.lit(32), F.lit(24)),
        read=X.read_size(F.lit(224), F.lit(0.5), F.lit(0.252)),
        read2=X.read_size(F.lit(224), F.lit(0.5), F.lit(0.27)),
        near=X.read_size(F.lit(224), F.lit(0.5), F.lit(0.51)),
        to=X.round_to(F.lit(30.0), 16),
        hann=X.hann(F.lit(3)),
        hann1=X.hann(F.lit(1)),
    )
    assert r["a"] == [0, 16, 32] and r["b"] == [0, 24, 32] and r["c"] == [0]
    assert (r["read"], r["read2"], r["near"], r["to"]) == (444, 415, 224, 32)
    assert [round(x, 6) for x in r["hann"]] == [0.5, 1.0, 0.5] and r["hann1"] == [1.0]


def test_subtiles(spark):
    df = spark.createDataFrame([(0, 100, 200), (1, 1000, 1200)], "region_index int, x long, y long")
    rows = spatial.explode_regions(df.withColumn("s", F.lit(224)), 3, "s").orderBy("flat_index").collect()
    assert [r["flat_index"] for r in rows] == list(range(18))
    assert [r["x"] for r in rows[:4]] == [100, 324, 548, 100] and [r["y"] for r in rows[:9:3]] == [200, 424, 648]
    with pytest.raises(ValueError):
        X.subtiles("x", "y", 1, "s")


def test_fold_round_trip(spark):
    df = spark.createDataFrame([("a", [9.0, 1.0, 2.0, 3.0, 4.0, 5.0, 6.0])], "k string, t array<double>")
    cells = spatial.fold(df, ["k"], "t", 1, 3)
    assert cells.count() == 6
    assert spatial.unfold(cells, ["k"], 3).first()["tokens"] == [1.0, 2.0, 3.0, 4.0, 5.0, 6.0]


def test_single_window_is_itself(spark):
    df = spark.createDataFrame([("a", 0, [1.5, -2.0, 4.0])], "k string, s int, v array<double>")
    got = spatial.overlap_add(df, ["k"], "s", "v").orderBy("cell").collect()
    assert [round(r["value"], 9) for r in got] == [1.5, -2.0, 4.0]


def test_labels_and_names(spark):
    df = spark.createDataFrame([("tissue",), ("merged",), ("tumour",), (None,), (" ",)], "a string")
    rows = df.select(X.artifact_label("a").alias("x"), X.structural_label("a").alias("y")).collect()
    assert [r["x"] for r in rows] == [None, None, "tumour", None, None]
    assert [r["y"] for r in rows][:4] == ["tissue", None, "tumour", None]
    r = one(spark, stem=X.file_stem(F.lit("a b*/c")), safe=X.safe_label(F.lit("  A100 (80GB)!")), none=X.safe_label(F.lit("--")), p=X.path_stem(F.lit("/x/slide.v2.svs")), reg=X.reader_regime(F.lit("/x/a.SVS")), m=X.model_name(F.lit(" Virchow-2 ")), size=X.size_label(F.lit(518), F.lit(504)))
    assert tuple(r) == ("a%20b%2A%2Fc", "a100-80gb", "item", "slide.v2", "spacing", "virchow2", "518x504px")
    parts = spark.createDataFrame([("ok",), ("..",), ("a/b",), ("",), (None,)], "s string").select(X.is_path_part("s").alias("o")).collect()
    assert [r["o"] for r in parts] == [True, False, False, False, False]


def test_has_tiles(spark):
    df = spark.createDataFrame([("3",), ("0",), (None,), ("x",), ("2.0",), ("NaN",)], "n string")
    assert [r["h"] for r in df.select(X.has_tiles("n").alias("h")).collect()] == [True, False, False, False, True, False]


def test_resume_is_null_safe(spark):
    units = spark.createDataFrame([("a", None), ("a", "t"), ("b", None)], "sample_id string, annotation string")
    done = spark.createDataFrame([("a", None)], "sample_id string, annotation string")
    assert {tuple(r) for r in tables.pending(units, done).collect()} == {("a", "t"), ("b", None)}
    assert tables.pending(units, done, resume=False).count() == 3


def test_changed_records(spark):
    specs = spark.createDataFrame([("a", {"p": "8"}), ("b", {"p": "8"}), ("c", {"p": "8"})], "k string, compatibility map<string,string>")
    old = spark.createDataFrame([("a", {"p": "8"}), ("b", {"p": "4"})], "k string, compatibility map<string,string>")
    got = {r["k"]: r["differs"] for r in tables.changed(specs, old, "k").collect()}
    assert got == {"b": ["p"], "c": None}


def test_restore_and_split(spark):
    cur = spark.createDataFrame([("a", None, 1, "new"), ("b", None, 2, "new")], "sample_id string, annotation string, n int, path string")
    old = spark.createDataFrame([("a", None, 1, "old", 1), ("b", None, 3, "old", 1), ("a", None, 1, "older", 0)], "sample_id string, annotation string, n int, path string, ord int")
    got = tables.restore_unchanged(cur, old, "ord", ["n"], ["path"]).orderBy("sample_id").collect()
    assert [r["path"] for r in got] == ["old", "new"]
    some, none = tables.split_by_tiles(cur.withColumn("num_tiles", F.col("n") - 1))
    assert [r["sample_id"] for r in some.collect()] == ["b"] and [r["sample_id"] for r in none.collect()] == ["a"]
    with pytest.raises(tables.TableError, match="a"):
        tables.require_unique(old, ["sample_id"])


def test_stratified_sample(spark):
    got = partitioning.stratified_sample(spark.range(90).withColumn("size", F.col("id") * 10), 9, "size", "id")
    bins = [0, 0, 0]
    for r in got.collect():
        bins[min(2, r["id"] // 30)] += 1
    assert sum(bins) == 9 and max(bins) - min(bins) <= 2


def test_empty_tables(spark):
    none = spark.createDataFrame([], "k string, v array<float>")
    assert aggregate.pool_mean(none, ["k"], "v").count() == 0
    s = aggregate.snapshot(none, F.lit(True), F.lit(False), F.lit(1)).first()
    assert (s["total"], s["pending"], s["discovered_tiles"]) == (0, 0, 0)


def test_manifests(spark, tmp_path):
    good = tmp_path / "m.csv"
    good.write_text("sample_id,image_path,spacing_at_level_0,other\n0007,/a/x.svs,0.25,z\nNA,/a/y.svs,,z\n")
    rows = manifests.slides(spark, str(good)).orderBy("sample_id").collect()
    assert [(r["sample_id"], r["mask_path"], r["spacing_at_level_0"]) for r in rows] == [("0007", None, 0.25), ("NA", None, None)]
    assert "other" not in rows[0].asDict()
    twice = tmp_path / "d.csv"
    twice.write_text("sample_id,image_path\na,/x\na,/y\n")
    with pytest.raises(tables.TableError):
        manifests.slides(spark, str(twice))
    blank = tmp_path / "p.csv"
    blank.write_text("sample_id,image_path,patient_id\na,/x,p\nb,/y,  \n")
    with pytest.raises(tables.TableError, match="b"):
        manifests.patients(spark, str(blank))
    lines = tmp_path / "e.jsonl"
    lines.write_text(json.dumps({"kind": "k", "payload": {"n": 1}, "timestamp": 1.5}) + "\n" + '{"kind": "part')
    assert [r["kind"] for r in manifests.progress(spark, str(lines)).collect()] == ["k"]


@pytest.mark.parametrize("seed", range(4))
def test_shares_against_a_heap(seed):
    """Counts by class, and the order in which ranks take units, against the rule one unit at a time."""
    import heapq
    import random
    from collections import Counter

    r = random.Random(seed)
    weights = sorted((r.choice([0, 1, 2, 3, 5, 40, 1000, -2]) for _ in range(r.choice([0, 5, 300]))), reverse=True)
    for ranks in (1, 2, 7):
        heap, want = [(0, i) for i in range(ranks)], []
        for w in weights:
            load, i = heapq.heappop(heap)
            want.append((w, i))
            heapq.heappush(heap, (load + w, i))
        counts = Counter(weights)
        made = list(partitioning.shares(sorted(counts.items(), reverse=True), ranks))
        slots = sorted((-w, load + max(w, 0) * k, i) for w, i, load, n in made for k in range(n))
        assert [(-w, i) for w, _, i in slots] == want


def test_percentiles(spark):
    rng = np.random.default_rng(5)
    values = [None, *rng.integers(0, 9, 70).tolist(), *rng.normal(0, 1e6, 30).tolist()]
    df = spark.createDataFrame([(None if v is None else float(v),) for v in values], "v double")
    cuts = [0.0, 0.1, 0.33, 0.5, 0.66, 1.0]
    assert np.allclose(partitioning.percentiles(df, "v", cuts), np.quantile([v for v in values if v is not None], cuts))
    assert partitioning.percentiles(df.where("v IS NULL"), "v", [0.5]) == [None]
    assert partitioning.size_bins(df.where("v IS NULL"), "v").collect()[0].bin == 0


def test_artifacts(spark, tmp_path):
    bag = spark.createDataFrame([("a", None, 0, [1.0, 2.0]), ("a", None, 1, [3.0, 4.0]), ("b", "t", 0, [5.0, 6.0])], "sample_id string, annotation string, tile_index int, embedding array<float>")
    manifest = spark.createDataFrame([("a", None), ("b", "t"), ("c", None)], "sample_id string, annotation string")
    root = str(tmp_path / "out")
    artifacts.write_tiles(bag, manifest, root)
    meta = {r["sample_id"]: (r["num_tiles"], r["feature_dim"]) for r in artifacts.read_metadata(spark, root, "tile_embeddings").collect()}
    assert meta == {"a": (2, 2), "b": (1, 2), "c": (0, None)}
    assert artifacts.read(spark, root, "tile_embeddings").count() == 3


def test_trial_plan_sorts_names_alone(spark):
    """Sorted were all combinations, which are many times the names; a name that is given twice still has each twice, side by side."""
    plan = partitioning.trial_plan(spark, spark.createDataFrame([("b",), ("a",), ("b",)], "model string"), [1, 2], [64], [4, 8], 1)
    text = plan._jdf.queryExecution().optimizedPlan().toString()
    assert text.index("Generate") < text.index("Sort")
    want = [(m, g, 64, w, k, r) for m, n in (("a", 1), ("b", 2)) for g in (1, 2) for w in (4, 8) for r, k in enumerate(("warmup", "measured")) for _ in range(n)]
    assert [tuple(r) for r in plan.collect()] == want
