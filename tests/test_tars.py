"""Tar stores: the index equals tarfile's, large archives are read by ranges, damaged ones are errors."""

import io
import tarfile

import pytest

from tesserae.sources import tars


def store(path, names, form=tarfile.PAX_FORMAT):
    with tarfile.open(path, "w", format=form) as tar:
        for i, name in enumerate(names):
            content = f"{i}:{name}".encode() * (i % 4)
            member = tarfile.TarInfo(name)
            member.size = len(content)
            tar.addfile(member, io.BytesIO(content))
        folder = tarfile.TarInfo("folder")
        folder.type = tarfile.DIRTYPE
        tar.addfile(folder)
        link = tarfile.TarInfo("link")
        link.type, link.linkname = tarfile.SYMTYPE, "l" * 150
        tar.addfile(link)


@pytest.mark.parametrize("form", [tarfile.PAX_FORMAT, tarfile.GNU_FORMAT, tarfile.USTAR_FORMAT])
def test_members(tmp_path, form):
    names = ["b.jpg", "a.jpg", "deep/" * 15 + "x" * 60 + ".jpg", "b.jpg", "ü.jpg", *(["n" * 300] if form != tarfile.USTAR_FORMAT else [])]
    path = tmp_path / "k.tar"
    if form == tarfile.USTAR_FORMAT:
        with tarfile.open(path, "w", format=form) as tar:
            for n in names:
                m = tarfile.TarInfo(n)
                m.size = 3
                tar.addfile(m, io.BytesIO(b"abc"))
    else:
        store(path, names, form)
    with open(path, "rb") as f:
        got = list(tars.members(f))
    with tarfile.open(path) as tar:
        assert got == [(m.name, m.offset_data, m.size) for m in tar if m.isfile()]


def test_large_archives_are_read_by_ranges(spark, tmp_path):
    """A member of 3 GB (a hole in the file), and one tile behind it."""
    path = tmp_path / "big.tiles.tar"
    hole, tile = tarfile.TarInfo("hole.bin"), tarfile.TarInfo("tile.bin")
    hole.size, tile.size = 3 << 30, 5
    with open(path, "wb") as f:
        f.write(hole.tobuf(tarfile.GNU_FORMAT))
        f.seek(3 << 30, 1)
        f.write(tile.tobuf(tarfile.GNU_FORMAT) + b"bytes".ljust(512, b"\0") + bytes(1024))
    seen = []

    class Noted:
        def __init__(self, f):
            self.f, self.seek = f, f.seek

        def read(self, n):
            seen.append(n)
            return self.f.read(n)

    with open(path, "rb") as f:
        assert list(tars.members(Noted(f))) == [("hole.bin", 512, 3 << 30), ("tile.bin", (3 << 30) + 1024, 5)]
    assert sum(seen) == 3 * 512
    wanted = spark.createDataFrame([("big", 1), ("big", 1)], "sample_id string, tile_index long")
    assert [tuple(r) for r in tars.tiles(spark, str(tmp_path), wanted).collect()] == [("big", 1, "tile.bin", b"bytes")]


def test_stores(spark, tmp_path):
    names = ["b", "a", "b", "c/d"]
    store(tmp_path / "one.tiles.tar", names)
    store(tmp_path / "two.tar", ["z"])
    tarfile.open(tmp_path / "none.tar", "w").close()
    rows = sorted((r.sample_id, r.tile_index, r.name, r.content, r.open_ms >= 0 and r.read_ms >= 0) for r in tars.tiles(spark, str(tmp_path), timings=True).collect())
    content = lambda i, n: f"{i}:{n}".encode() * (i % 4)
    assert rows == [("one", 0, "a", content(1, "a"), True), ("one", 1, "b", content(0, "b"), True), ("one", 2, "b", content(2, "b"), True), ("one", 3, "c/d", content(3, "c/d"), True), ("two", 0, "z", b"", True)]


def test_damaged(tmp_path):
    path = tmp_path / "a.tar"
    store(path, ["x" * 10, "y"])
    whole = bytearray(path.read_bytes())
    whole[3] ^= 1
    path.write_bytes(bytes(whole))
    with open(path, "rb") as f, pytest.raises(ValueError, match="damaged header at 0"):
        list(tars.members(f))
    path.write_bytes(bytes(whole)[:100])
    with open(path, "rb") as f, pytest.raises(ValueError, match="ends in a header"):
        list(tars.members(f))
