"""Tensor archives: round trips, views by strides, half precision, and pickles that name anything else are refused."""

import collections
import io
import pickle
import struct
import zipfile

import numpy as np
import pytest

from tesserae.sources import tensors


def archive(pickled, *raws, root="archive/"):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w") as z:
        z.writestr(f"{root}data.pkl", pickled)
        for i, raw in enumerate(raws):
            z.writestr(f"{root}data/{i}", raw)
    return out.getvalue()


def tensor(kind, numel, offset, size, stride):
    """A pickle of one tensor, by opcodes."""
    n = lambda v: b"J" + struct.pack("<i", v)
    many = lambda vs: b"(" + b"".join(map(n, vs)) + b"t"
    storage = b"(X\x07\0\0\0storagectorch\n" + kind.encode() + b"\nX\x01\0\0\x000X\x03\0\0\0cpu" + n(numel) + b"tQ"
    return b"\x80\x02ctorch._utils\n_rebuild_tensor_v2\n(" + storage + n(offset) + many(size) + many(stride) + b"\x89ccollections\nOrderedDict\n)RtR."


@pytest.mark.parametrize("kind", ["f4", "f8", "f2", "i8", "i4", "i2", "i1", "u1", "b1"])
def test_round_trips(kind):
    a = (np.arange(24).reshape(2, 3, 4) % 7).astype(kind)
    got = tensors.load(tensors.dump(a))
    assert got.dtype == a.dtype and (got == a).all()
    both = tensors.load(tensors.dump({"x": a, "none": np.zeros((0, 5), np.float32), "one": np.float32([3])}))
    assert (both["x"] == a).all() and both["none"].shape == (0, 5) and both["one"].tolist() == [3]


def test_views():
    raw = np.arange(12, dtype="<f4").tobytes()
    assert (tensors.load(archive(tensor("FloatStorage", 12, 1, (3, 2), (1, 4)), raw)) == np.array([[1, 5], [2, 6], [3, 7]])).all()
    assert tensors.load(archive(tensor("FloatStorage", 12, 5, (), ()), raw, root="")) == 5
    assert tensors.load(archive(tensor("FloatStorage", 12, 3, (4,), (0,)), raw)).tolist() == [3] * 4
    bits = np.array([1.5, -2.0, 0.0078125], "<f4").view("<u4") >> 16
    assert tensors.load(archive(tensor("BFloat16Storage", 3, 0, (3,), (1,)), bits.astype("<u2").tobytes())).tolist() == [1.5, -2.0, 0.0078125]
    for bad in ((0, (13,), (1,)), (11, (2,), (1,)), (0, (2, 2), (1,)), (0, (-1,), (1,)), (0, (2,), (-1,)), (-1, (2,), (1,)), (0, (3, 3), (5, 2))):
        with pytest.raises(ValueError, match="beyond|no tensor"):
            tensors.load(archive(tensor("FloatStorage", 12, *bad), raw))
    with pytest.raises(ValueError, match="12 numbers, not 11"):
        tensors.load(archive(tensor("FloatStorage", 11, 0, (1,), (1,)), raw))
    with pytest.raises(ValueError, match="0 pickles"):
        tensors.load(archive(b"", root="a/b/"))


class Evil:
    def __init__(self, what):
        self.what = what

    def __reduce__(self):
        return self.what


@pytest.mark.parametrize("what", [(eval, ("1/0",)), (getattr, ("", "join")), (collections.Counter, ()), (np.zeros, (3,)), (bytearray, (9,))])
def test_hostile_pickles_are_refused(what):
    with pytest.raises(pickle.UnpicklingError, match="is no part of a tensor"):
        tensors.load(archive(pickle.dumps({"x": Evil(what)}, 2)))
    for kind in ("UntypedStorage", "load", "hub"):
        with pytest.raises(pickle.UnpicklingError, match="is no part"):
            tensors.load(archive(tensor(kind, 1, 0, (1,), (1,)), b"1234"))


def test_rows(spark, tmp_path):
    (tmp_path / "a.pt").write_bytes(tensors.dump({"features": np.arange(6, dtype="f2").reshape(2, 3), "tile_index": np.array([7, 3])}))
    (tmp_path / "b.pt").write_bytes(tensors.dump({"features": np.arange(3, dtype="f4")}))
    got = sorted(tuple(r) for r in tensors.rows(spark, str(tmp_path), "features").collect())
    assert got == [("a", 3, [3, 4, 5]), ("a", 7, [0, 1, 2]), ("b", 0, [0, 1, 2])]
    with pytest.raises(Exception, match="asked for was latents"):
        tensors.rows(spark, str(tmp_path), "latents").collect()
