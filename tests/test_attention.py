"""Attention maps against a plain computation, and CSV sinks."""

import math

import numpy as np
import pytest

from tesserae.functions import attention
from tesserae.sources import manifests


def test_maps(spark):
    heads, dim, prefix, grid = 2, 3, 2, (2, 2)
    rng = np.random.default_rng(0)
    q, k = rng.normal(size=(2, heads, 6, dim))
    df = spark.createDataFrame([(q.ravel().tolist(), k.ravel().tolist()), (None, None)], "q array<double>, k array<double>")
    got = [r.m for r in df.select(attention.maps_udf(heads, dim, prefix, grid, True)("q", "k").alias("m")).collect()]
    want = []
    for t in range(prefix):
        for h in range(heads):
            e = [math.exp(sum(q[h, t, d] * k[h, s, d] for d in range(dim)) / math.sqrt(dim)) for s in range(6)]
            want += [x / sum(e) for x in e[prefix:]]
    assert np.allclose(got[0], want) and got[1] is None
    assert np.allclose(attention.prefix_maps(attention.weights(q, k), prefix, grid).ravel(), want[: heads * 4])
    with pytest.raises(ValueError, match="grid"):
        attention.prefix_maps(attention.weights(q, k), 1, grid)


def test_block_indices():
    assert attention.block_indices([-1, 0], 12) == [11, 0]
    with pytest.raises(ValueError, match="12"):
        attention.block_indices([12], 12)


def test_csv_sinks(spark, tmp_path):
    rows = spark.createDataFrame([("0007", "/s/7.tif", None)], "sample_id string, image_path string, spacing_at_level_0 double")
    assert not manifests.save_csv(rows.where("false"), f"{tmp_path}/none")
    assert not (tmp_path / "none").exists()
    manifests.save_slides(rows, f"{tmp_path}/slides")
    assert spark.read.option("header", True).csv(f"{tmp_path}/slides").columns == ["sample_id", "image_path"]
    assert manifests.slides(spark, f"{tmp_path}/slides").first().sample_id == "0007"
