import numpy as np
import pytest

from tesserae.functions import registry as R


def test_contracts():
    r = R.STANDARD
    assert r.names() == ["mean-2", "mean-slide"] and r.names("slide") == ["mean-slide"]
    assert r.variant("MEAN-2 ") == ("default", 2) and r.tile_of("mean-slide").name == "mean-2"
    assert r.preprocessing("mean-slide") == (pytest.approx(0.5), 224)
    assert not r.validate("mean-2", 0.5, 448, "fp32")
    with pytest.raises(ValueError):
        r.validate("mean-2", 0.25, 450, "fp16")
    assert len(r.validate("mean-2", 0.25, 450, "fp16", allow=True)) == 3
    for bad in (lambda: r.names("case"), lambda: r.variant("mean-2", "cls"), lambda: r.register(r.get("mean-2"))):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(KeyError):
        r.get("none")


def test_vectors(spark):
    df = spark.createDataFrame([(i, [float(i), i + 2.0]) for i in range(5)], "i int, x array<double>")
    got = df.select("i", R.vector_udf(R.STANDARD.get("mean-2"), 2)("x").alias("v")).collect()
    assert all(r["v"] == [r["i"] + 1.0, 1.0] for r in got)
    half = df.select(R.as_half("x").alias("h")).first()["h"]
    assert half == [float(np.float16(0)), float(np.float16(2))]
