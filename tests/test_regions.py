"""Reads of squares: super-tiles give what single reads give."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.plans import storing
from tesserae.plans.catalogue import each_label, numbered
from tesserae.plans.pipeline import Pipeline
from tesserae.sources import regions


def counted():
    """A class that workers get by value; they can't import this module."""

    class Counted(regions.Raster):
        def __init__(self, path):
            self.pixels = np.arange(20 * 30 * 3, dtype=np.int64).reshape(20, 30, 3) % 251

    return Counted


Counted = counted()


def reads(spark, positions, supertile):
    df = spark.createDataFrame([("s", i, x, y, 0, 4) for i, (x, y) in enumerate(positions)], "image_path string, tile_index int, x long, y long, level int, read_px int")
    return {r.tile_index: (r.pixels, r.height, r.width) for r in regions.read_regions(df, counted(), supertile).collect()}


GRID = [(x, y) for y in range(0, 20, 4) for x in range(0, 30, 4)]


@pytest.mark.parametrize("positions", [GRID, [(-2, -2), (28, 18), (40, 40)], [(0, 0), (1, 0), (7, 7)], []])
def test_supertiles(spark, positions):
    one, many = reads(spark, positions, 1), reads(spark, positions, 4)
    assert one == many and len(one) == len(positions)
    for i, (x, y) in enumerate(positions):
        whole = np.full((60, 70, 3), 255)
        whole[10:30, 10:40] = Counted("").pixels
        assert one[i] == (whole[y + 10 : y + 14, x + 10 : x + 14].ravel().tolist(), 4, 4)


def test_one_read_spans_a_full_supertile():
    import pandas as pd

    calls = []

    class Spy(Counted):
        def read(self, x, y, level, size):
            calls.append((x, y, size))
            return super().read(x, y, level, size)

    group = pd.DataFrame([(x, y, 0, 4, 1.0) for x in (0, 4) for y in (0, 4)], columns=["x", "y", "level", "read_px", "_f"])
    regions._cut(Spy(""), group)
    assert calls == [(0, 0, 8)]


def test_small_requests_go_to_many_tasks(spark):
    """Spark puts small rows into one task, however long their reads take; and a task sends its squares in parts."""
    rows = [("s" if i % 2 else None, i, 4 * i, 4 * (i % 5), 0, 4, {"i": i}) for i in range(100)]
    df = spark.createDataFrame(rows, "image_path string, tile_index int, x long, y long, level int, read_px int, more map<string,int>").coalesce(1)
    assert regions.read_regions(df, counted()).select(F.spark_partition_id()).distinct().count() > 1
    got = regions.read_regions(df, counted(), budget=200).collect()
    assert {(r.tile_index, r.more["i"], r.x) for r in got} == {(i, i, 4 * i) for i in range(1, 100, 2)}  # a place without an image is left out
    whole = np.full((60, 500, 3), 255)
    whole[:20, :30] = Counted("").pixels
    assert all(r.pixels == whole[r.y : r.y + 4, r.x : r.x + 4].ravel().tolist() for r in got)


def test_raster_and_openers(tmp_path):
    (tmp_path / "a.pgm").write_bytes(b"P5 2 1 255\n" + bytes([7, 8]))
    assert regions.opener("pil")(f"{tmp_path}/a.pgm").read(1, 0, 0, 2).ravel().tolist() == [8, 255, 255, 255]
    with pytest.raises(ValueError, match="no opener"):
        regions.opener("other")


def test_labels_are_dealt_to_many_tasks(spark, tmp_path):
    """Files of small labels were all written by one task."""
    import pandas as pd

    folder = str(tmp_path)

    def write(key, group):
        from pyspark import TaskContext

        with open(f"{folder}/{key[0]}.{TaskContext.get().partitionId()}", "w") as f:
            f.write(",".join(map(str, sorted(group["id"]))))
        return pd.DataFrame({"label": [key[0]]})

    each_label(spark.range(30).select((F.col("id") % 10).cast("int").alias("label"), "id"), write)
    made = {p.name.split(".")[0]: p.read_text() for p in tmp_path.iterdir()}
    assert made == {str(k): f"{k},{k + 10},{k + 20}" for k in range(10)}
    assert len({p.suffix for p in tmp_path.iterdir()}) > 1


def test_requests_are_made_by_many_tasks(spark, monkeypatch):
    """All requests of dense_regions were made from counts of labels in one task."""
    asked = []

    def run_dense(self, requests, *more, **others):
        asked.append(requests)
        raise InterruptedError

    monkeypatch.setattr(Pipeline, "run_dense", run_dense)
    with pytest.raises(InterruptedError):
        storing.dense_regions(spark, "/root/testdata/sf0.001")
    got = asked[0].select(F.spark_partition_id().alias("task"), "sample_id", "x", "y").collect()
    counts = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").groupBy("label").count().collect()
    assert sorted((r.sample_id, r.x, r.y) for r in got) == sorted((str(c.label), 0, y) for c in counts for y in range(0, c["count"] // 8 * 8, 8))
    assert len({r.task for r in got}) > 1


def test_numbers_in_blocks(spark):
    df = spark.createDataFrame([("a", 7), ("b", 0), ("c", 1), (None, 3), ("d", None), ("e", 6), ("e", 6)], "k string, n int")
    got = sorted(map(tuple, numbered(df, "n", "i", 3).collect()), key=str)
    assert got == sorted([(k, i) for k, n in (("a", 7), ("c", 1), (None, 3), ("e", 6), ("e", 6)) for i in range(n)], key=str)
