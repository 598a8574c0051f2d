"""Tiled pyramids: squares and tiles equal numpy's, files are read by ranges, and filters prune the plan."""

import itertools
import struct

import numpy as np
import pytest
from pyspark.sql import functions as F

from tesserae.sources import regions, tiff

RNG = np.random.default_rng(2)


def image(height, width, samples=3):
    return RNG.integers(0, 256, (height, width, samples), dtype=np.uint8)


def padded(a, size):
    return np.pad(a, ((size, size), (size, size), (0, 0)), constant_values=255)


@pytest.mark.parametrize("big,order,deflate,predictor", list(itertools.product([False, True], ["<", ">"], [False, True], [1, 2]))[::3])
def test_squares(tmp_path, big, order, deflate, predictor):
    levels = [image(75, 130), image(38, 65), image(19, 33)]
    path = str(tmp_path / "a.tif")
    tiff.write_pyramid(path, levels, 16, big, order, deflate, predictor)
    p = tiff.Pyramid(path)
    assert [(v.width, v.height) for v in p.levels] == [(130, 75), (65, 38), (33, 19)]
    for n, a in enumerate(levels):
        white = padded(a, 200)
        for x, y, size in [(0, 0, 16), (3, 5, 40), (-7, -9, 20), (120, 60, 64), (500, 0, 4), (17, 33, 1)]:
            left, top = x * a.shape[1] // 130, y * a.shape[0] // 75
            want = white[200 + top : 200 + top + size, 200 + left : 200 + left + size] if left < 150 else np.full((size, size, 3), 255)
            assert (p.read(x, y, n, size) == want).all()
    with pytest.raises(ValueError, match="no level 3"):
        p.read(0, 0, 3, 4)


def test_files_are_read_by_ranges(tmp_path):
    path = str(tmp_path / "a.tif")
    tiff.write_pyramid(path, [image(1024, 1024)], 64, deflate=False)
    p, got = tiff.Pyramid(path), []

    class Noted:
        def __init__(self, f):
            self.f = f

        def seek(self, at):
            self.f.seek(at)

        def read(self, n):
            got.append(n)
            return self.f.read(n)

    p.file = Noted(p.file)
    p.read(70, 70, 0, 50)
    p.read(70, 70, 0, 50)
    assert got == [64 * 64 * 3]


def test_bad_files(tmp_path):
    path = tmp_path / "a.tif"
    tiff.write_pyramid(str(path), [image(20, 20)], 16)
    whole = path.read_bytes()
    for bad, what in ((b"", "ends within"), (b"PK" + whole[2:], "not a TIFF"), (b"II\x07\x00" + whole[4:], "kind of TIFF"), (whole[:-60], "ends within")):
        path.write_bytes(bad)
        with pytest.raises(ValueError, match=what):
            tiff.Pyramid(str(path))
    first = struct.unpack_from("<I", whole, 4)[0]
    circle = bytearray(whole)
    struct.pack_into("<I", circle, first + 2 + 11 * 12, first)
    path.write_bytes(bytes(circle))
    with pytest.raises(ValueError, match="circle"):
        tiff.Pyramid(str(path))
    jpeg = bytearray(whole)
    struct.pack_into("<I", jpeg, first + 2 + 3 * 12 + 8, 7)
    path.write_bytes(bytes(jpeg))
    with pytest.raises(ValueError, match="compression 7"):
        tiff.Pyramid(str(path)).read(0, 0, 0, 4)


def test_source(spark, tmp_path):
    a, b = [image(75, 130), image(38, 65)], [image(30, 30, 1)]
    tiff.write_pyramid(str(tmp_path / "a.tif"), a, 16)
    tiff.write_pyramid(str(tmp_path / "b.TIFF"), b, 16, big=True)
    (tmp_path / "note.txt").write_text("no image")
    rows = tiff.tiles(spark, str(tmp_path), supertile=3).collect()
    assert len(rows) == 5 * 9 + 3 * 5 + 4
    for r in rows:
        whole = (a if r.image_path.endswith("a.tif") else b)[r.level]
        part = whole[r.tile_y * 16 :, r.tile_x * 16 :][:16, :16]
        assert (r.height, r.width, r.channels) == part.shape and r.pixels == part.tobytes()
    whole = str(tmp_path / "a.tif")
    key = lambda rs: sorted((r.image_path, r.level, r.tile_x, r.tile_y) for r in rs)
    for level, box in ((1, None), (0, (100, 0, 130, 20)), (1, (40, 30, 41, 31)), (None, (0, 74, 500, 500)), (5, None), (0, (130, 0, 200, 10))):
        left, top, right, bottom = box or (0, 0, 999, 999)
        want = [r for r in rows if level in (None, r.level) and r.x < right and r.y < bottom]
        want = [r for r in want if r.x + 16 * (130 if r.image_path == whole else 30) / (130 if r.level == 0 and r.image_path == whole else 65 if r.level else 30) > left]
        want = [r for r in want if r.y + 16 * (75 if r.image_path == whole else 30) / (75 if r.level == 0 and r.image_path == whole else 38 if r.level else 30) > top]
        got = tiff.tiles(spark, str(tmp_path), level, box, 3)
        assert key(got.collect()) == key(want)
    one, two = tiff.tiles(spark, whole, 1, None, 3), tiff.tiles(spark, whole, 0, (0, 0, 16, 16))
    assert one.rdd.getNumPartitions() == 2  # 5 x 3 tiles in super-tiles of 3 x 3
    assert one.unionByName(two).count() == 16


def test_regions_of_a_pyramid(spark, tmp_path):
    levels = [image(75, 130), image(38, 65)]
    path = str(tmp_path / "a.tif")
    tiff.write_pyramid(path, levels, 16)
    df = spark.createDataFrame([(path, x, y, lv, 8) for x in range(0, 130, 16) for y in range(0, 75, 16) for lv in (0, 1)], "image_path string, x long, y long, level int, read_px int")
    for supertile in (1, 3):
        got = regions.read_regions(df.where(F.col("level") == 0), regions.opener("tiff"), supertile).collect()
        for r in got:
            assert r.pixels == padded(levels[0], 50)[50 + r.y : 58 + r.y, 50 + r.x : 58 + r.x].ravel().tolist()
