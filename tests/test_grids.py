"""Input contracts, layouts of windows, and grids blended from them."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.functions import contracts
from tesserae.functions import expressions as X
from tesserae.functions.contracts import Layout
from tesserae.functions.registry import STANDARD, Encoder, Registry
from tesserae.operators import dense, tables
from tesserae.plans.pipeline import Model


def test_layout():
    a = Layout.of(30, 16, 20, 0.5)
    assert (a.encoded, a.pad, a.grid, a.window, a.tokens, a.starts) == ((32, 32), (2, 2), (2, 2), (32, 32), (2, 2), ((0,), (0,)))
    b = Layout.of((64, 40), 8, 16, 0.25)
    assert b.starts == ((0, 16, 32, 48), (0, 16, 24)) and b.tokens == (2, 2)
    assert Layout.of(8, 4).weights() == ([1.0, 1.0], [1.0, 1.0])
    for bad in ((0, 4), ((8, 8, 8), 4), (8, 4, 0), (8, 4, 4, 1.0)):
        with pytest.raises(ValueError):
            Layout.of(*bad)


def test_input_plans():
    pooled = contracts.pooled_input(STANDARD, "mean-slide", 224)
    assert (pooled.tile_encoder, pooled.size, pooled.preprocessing) == ("mean-2", (224, 224), "shipped")
    with pytest.raises(ValueError):
        contracts.pooled_input(STANDARD, "mean-2", 256)
    assert contracts.pooled_input(STANDARD, "mean-2", 256, allow=True).preprocessing == "normalization_only"
    with pytest.raises(ValueError):
        contracts.effective_input(STANDARD, "mean-2", 250)
    assert contracts.dense_input(STANDARD, "mean-2", 250, window=100).size == (112, 112)
    r = Registry()
    r.register(Encoder("fixed", "tile", {"default": 2}, None, 224, (16, 16)))
    assert not contracts.dense_input(r, "fixed", 220).variable
    with pytest.raises(ValueError):
        contracts.dense_input(r, "fixed", 250)


def test_dense_options():
    contracts.check_dense(Layout.of(10, 8))
    for layout, options in ((Layout.of(3, 8), {}), (Layout.of(8, 8), {"pad_mode": "wrap"}), (Layout.of(8, 8), {"kind": "cls_attention"}), (Layout.of(8, 8), {"blocks": (True,)}), (Layout.of(8, 8), {"registers": 1})):
        with pytest.raises(ValueError):
            contracts.check_dense(layout, **options)
    assert contracts.own_or_allowed(None, True, False, "a") and contracts.own_or_allowed(False, True, True, "a") is False
    with pytest.raises(ValueError):
        contracts.own_or_allowed(False, True, False, "a")


def test_blend_against_loops(spark):
    layout = Layout.of((20, 12), 4, 8, 0.5)
    rng = np.random.default_rng(3)
    rows, sums, weights = [], np.zeros((5, 3, 2)), np.zeros((5, 3, 1))
    k = np.outer(*(np.array(w) for w in layout.weights()))[:, :, None]
    for y in layout.starts[0]:
        for x in layout.starts[1]:
            t = rng.random((2, 2, 2))
            sums[y // 4 : y // 4 + 2, x // 4 : x // 4 + 2] += t * k
            weights[y // 4 : y // 4 + 2, x // 4 : x // 4 + 2] += k
            rows.append(("a", y, x, t.reshape(4, 2).tolist()))
    cells = dense.blend(spark.createDataFrame(rows, "id string, win_y int, win_x int, tokens array<array<double>>"), ["id"], layout)
    got = {(r.h, r.w): r.vector for r in cells.collect()}
    assert len(got) == 15
    for (h, w), v in got.items():
        assert np.allclose(v, sums[h, w] / weights[h, w])
    planes = {r.plane: r["values"] for r in dense.planes(cells, ["id"]).collect()}
    assert np.allclose(planes[1], (sums / weights)[:, :, 1].ravel())


def test_blend_sends_parts_and_adds_them_up(spark, monkeypatch):
    """Many windows of one key over several tasks, whose cells are let go of again and again."""
    layout = Layout.of((20, 12), 4, 8, 0.5)
    rng = np.random.default_rng(4)
    k, sums, weights, rows = np.outer(*(np.array(w) for w in layout.weights()))[:, :, None], np.zeros((2, 5, 3, 3)), np.zeros((2, 5, 3, 1)), []
    for n in range(300):
        y, x, who = int(rng.choice(layout.starts[0])), int(rng.choice(layout.starts[1])), n % 7 == 0
        t = rng.random((2, 2, 3))
        sums[int(who), y // 4 : y // 4 + 2, x // 4 : x // 4 + 2] += t * k
        weights[int(who), y // 4 : y // 4 + 2, x // 4 : x // 4 + 2] += k
        rows.append((None if who else "a", y, x, t.reshape(4, 3).tolist()))
    rows.append(("a", 0, 0, None))
    df = spark.createDataFrame(rows, "id string, win_y int, win_x int, tokens array<array<double>>").repartition(4)
    parts = dense.partial_cells(df, ["id"], layout, budget=500)
    assert parts.count() > 100 and dense.partial_cells(df, ["id"], layout).count() <= 4 * 30
    original = dense.partial_cells
    monkeypatch.setattr(dense, "partial_cells", lambda *a: original(*a, budget=500))
    got = {(r.id is None, r.h, r.w): r.vector for r in dense.blend(df, ["id"], layout).collect()}
    assert len(got) == 30
    for (who, h, w), v in got.items():
        assert np.allclose(v, sums[int(who), h, w] / weights[int(who), h, w])
    assert dense.blend(df.limit(0), ["id"], layout).count() == 0
    for bad in ([("a", 0, 0, [[1.0]])], [("a", 16, 0, [[1.0]] * 4)]):
        with pytest.raises(Exception, match="windows of 1 cells|not on the grid"):
            dense.blend(spark.createDataFrame(bad, df.schema), ["id"], layout).collect()


def test_dense_input_is_asked_on_entry(spark):
    r = Registry()
    r.register(Encoder("fixed", "tile", {"default": 1}, lambda: lambda x: x[:, None, :1], 8, (8, 8), (0.5,)))
    model = Model.from_preset("fixed", registry=r)
    images = spark.createDataFrame([("a", [1.0] * 144)], "sample_id string, pixels array<float>")
    with pytest.raises(ValueError, match="takes 8 px only"):
        model.embed_images_dense(images, 12)
    with pytest.raises(ValueError, match="takes 8 px only"):
        model.embed_coordinates_dense(images, None, 16)
    assert len(model.embed_images_dense(images, 12, window=8, overlap=0.0, pad_mode="replicate").collect()) == 4
    with pytest.raises(ValueError, match="made for tiles of 8"):
        model.embed_tiles(images, tile_size=12)


def test_image_guards(spark):
    schema = "sample_id string, image_path string, spacing_at_level_0 double"
    fine = spark.createDataFrame([("a", "a.png", None), ("b", "b.png", None)], schema)
    assert tables.require_images(fine).count() == 2
    for rows, raster in (([], True), ([("a", "a", None), ("a", "b", None)], True), ([("a", "a", 0.5)], True), ([("a", "a", -1.0)], False), ([("a", "a", float("nan"))], False)):
        with pytest.raises(tables.TableError):
            tables.require_images(spark.createDataFrame(rows, schema), raster)


def test_paths(spark):
    df = spark.createDataFrame([("../x", "a.b/c"), ("ok", "a/run.jsonl")], "s string, p string")
    got = df.select(X.image_paths("/o", "k", "s", "pt").alias("i"), X.ranked_path("p", F.lit(2)).alias("r")).collect()
    assert got[0].i is None and got[0].r == "a.b/c.rank2"
    assert tuple(got[1].i) == ("/o/k/ok.pt", "/o/k/ok.meta.json") and got[1].r == "a/run.rank2.jsonl"
