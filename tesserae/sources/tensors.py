"""Tensor archives: a zip of a pickle and one raw storage for each tensor, read and written without a tensor library.

The pickle may name only what rebuilds tensors from storages and plain containers; anything else is refused before it
is called. Views are taken by offset, sizes and strides, all within their storage.
"""

from __future__ import annotations

import collections
import io
import math
import pickle
import struct
import zipfile
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from tesserae.functions.expressions import path_stem
from tesserae.sources.arrays import files

#: Fixed values of the format: kinds of storages and their numbers. Of bfloat16 the bits are read, and widened.
STORAGES = {"FloatStorage": "<f4", "DoubleStorage": "<f8", "HalfStorage": "<f2", "BFloat16Storage": "bf16", "LongStorage": "<i8", "IntStorage": "<i4", "ShortStorage": "<i2", "CharStorage": "<i1", "ByteStorage": "<u1", "BoolStorage": "<b1"}
REBUILD, PARAMETER = "_rebuild_tensor_v2", "_rebuild_parameter"


def view(storage: np.ndarray, offset: int, size: Sequence[int], stride: Sequence[int]) -> np.ndarray:
    """An array of a storage; places beyond it are an error."""
    if len(size) != len(stride) or offset < 0 or any(n < 0 for n in size) or any(s < 0 for s in stride):
        raise ValueError(f"no tensor of sizes {tuple(size)} and strides {tuple(stride)}")
    if 0 in size:
        return np.zeros(size, storage.dtype)
    if offset + sum((n - 1) * s for n, s in zip(size, stride)) >= len(storage):
        raise ValueError(f"a tensor of sizes {tuple(size)} reaches beyond its {len(storage)} numbers")
    return np.lib.stride_tricks.as_strided(storage[offset:], size, [s * storage.itemsize for s in stride]).copy()


class Reader(pickle.Unpickler):
    """Unpickles tensors, numbers, texts and containers of them."""

    def __init__(self, archive: zipfile.ZipFile, root: str) -> None:
        super().__init__(io.BytesIO(archive.read(f"{root}data.pkl")))
        self.archive, self.root = archive, root
        self.storages: dict[str, np.ndarray] = {}
        if f"{root}byteorder" in archive.namelist() and archive.read(f"{root}byteorder").strip() != b"little":
            raise ValueError("only little-endian storages are read")

    def find_class(self, module: str, name: str):
        if (module, name) == ("torch._utils", REBUILD):
            return lambda storage, offset, size, stride, *_: view(storage, offset, size, stride)
        if (module, name) == ("torch._utils", PARAMETER):
            return lambda tensor, *_: tensor
        if (module, name) == ("collections", "OrderedDict"):
            return collections.OrderedDict
        if module == "torch" and name in STORAGES:
            return STORAGES[name]
        raise pickle.UnpicklingError(f"{module}.{name} is no part of a tensor")

    def persistent_load(self, pid) -> np.ndarray:
        if not (isinstance(pid, tuple) and len(pid) == 5 and pid[0] == "storage" and pid[1] in STORAGES.values()):
            raise pickle.UnpicklingError(f"no storage: {pid!r}")
        _, kind, key, _, numel = pid
        if key not in self.storages:
            raw = self.archive.read(f"{self.root}data/{key}")
            if kind == "bf16":
                out = (np.frombuffer(raw, "<u2").astype(np.uint32) << 16).view(np.float32)
            else:
                out = np.frombuffer(raw, kind)
            if len(out) != numel:
                raise ValueError(f"storage {key} has {len(out)} numbers, not {numel}")
            self.storages[key] = out
        return self.storages[key]


def load(content: bytes):
    """What an archive holds, tensors as arrays."""
    with zipfile.ZipFile(io.BytesIO(content)) as archive:
        roots = [n.removesuffix("data.pkl") for n in archive.namelist() if n == "data.pkl" or n.count("/") == 1 and n.endswith("/data.pkl")]
        if len(roots) != 1:
            raise ValueError(f"{len(roots)} pickles in the archive, not one")
        return Reader(archive, roots[0]).load()


def dump(payload: np.ndarray | dict[str, np.ndarray]) -> bytes:
    """An archive of one array, or of arrays by name."""
    kinds = {np.dtype(v): k for k, v in STORAGES.items() if v != "bf16"}
    raws: list[bytes] = []
    text = lambda s: b"X" + struct.pack("<I", len(s.encode())) + s.encode()
    whole = lambda n: b"\x8a\x08" + struct.pack("<q", n)
    numbers = lambda ns: b"(" + b"".join(map(whole, ns)) + b"t"
    known = lambda module, name: f"c{module}\n{name}\n".encode()

    def tensor(a: np.ndarray) -> bytes:
        a = np.ascontiguousarray(a)
        a = a.astype(a.dtype.newbyteorder("<"), copy=False)
        if a.dtype not in kinds:
            raise ValueError(f"no storage for {a.dtype}")
        raws.append(a.tobytes())
        stride = [math.prod(a.shape[i + 1 :]) for i in range(a.ndim)]
        storage = b"(" + text("storage") + known("torch", kinds[a.dtype]) + text(str(len(raws) - 1)) + text("cpu") + whole(a.size) + b"tQ"
        return known("torch._utils", REBUILD) + b"(" + storage + whole(0) + numbers(a.shape) + numbers(stride) + b"\x89" + known("collections", "OrderedDict") + b")RtR"

    body = tensor(payload) if isinstance(payload, np.ndarray) else b"}(" + b"".join(text(k) + tensor(v) for k, v in payload.items()) + b"u"
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_STORED) as archive:
        archive.writestr("archive/data.pkl", b"\x80\x02" + body + b".")
        archive.writestr("archive/byteorder", "little")
        for i, raw in enumerate(raws):
            archive.writestr(f"archive/data/{i}", raw)
        archive.writestr("archive/version", "3\n")
    return out.getvalue()


def rows(spark: SparkSession, path: str | Sequence[str], key: str | None = None, pattern: str = "*.pt") -> DataFrame:
    """Rows of the tensor of each archive, or of the one under key: sample_id (the stem), tile_index and embedding.

    A tensor of one axis is one row; axes after the first are flattened. The payload's own `tile_index` is used if it has one.
    """

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for stem, content in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
                payload = load(content)
                if (key is None) == isinstance(payload, dict) or key is not None and key not in payload:
                    raise ValueError(f"{stem} has {sorted(payload) if isinstance(payload, dict) else 'one tensor'}, asked for was {key}")
                a = payload if key is None else payload[key]
                a = a.reshape(1, -1) if a.ndim < 2 else a.reshape(len(a), -1)
                index = payload["tile_index"] if isinstance(payload, dict) and "tile_index" in payload else np.arange(len(a))
                if np.shape(index) != (len(a),):
                    raise ValueError(f"{stem} has {len(a)} rows and indices of shape {np.shape(index)}")
                vectors = pa.ListArray.from_arrays(pa.array(np.arange(len(a) + 1, dtype=np.int32) * a.shape[1]), pa.array(a.astype(np.float32).ravel()))
                yield pa.RecordBatch.from_arrays([pa.array([stem] * len(a), pa.string()), pa.array(np.asarray(index, np.int64)), vectors], ["sample_id", "tile_index", "embedding"])

    raw = files(spark, path, pattern).select(path_stem("path").alias("sample_id"), "content")
    return raw.mapInArrow(unpack, "sample_id string, tile_index long, embedding array<float>")
