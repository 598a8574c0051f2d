"""SentencePiece encoding and decoding with a unigram model.

Pieces and log scores are read from a model file. A double-array trie over the pieces' UTF-8 bytes gives
all pieces that begin at a position; Viterbi takes the segmentation with the largest sum of scores. A
character that no piece covers falls back to its bytes' pieces, or to the unknown piece where the model
has none. Spaces are written as a marker; decoding turns markers and byte pieces back.

No piece goes on over a marker after another character, so texts are cut there, each part is segmented by
itself, which gives the same best segmentation, and parts seen before are looked up.
"""

from __future__ import annotations

import functools
import re
import struct
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T

from tesserae.llm.common import chunked

MARKER = "▁"
#: Fixed values of the model format: kinds of pieces, and what an unknown character costs below the lowest score.
NORMAL, UNKNOWN, CONTROL, USER, BYTE = 1, 2, 3, 4, 6
UNKNOWN_PENALTY = 10.0
#: Parts that a worker remembers.
CACHE_PARTS = 400_000


def fields(raw: bytes):
    """(number, value) of the fields of a protocol buffer message."""
    i, n = 0, len(raw)

    def varint():
        nonlocal i
        out = shift = 0
        while True:
            b = raw[i]
            i += 1
            out |= (b & 127) << shift
            if b < 128:
                return out
            shift += 7

    while i < n:
        key = varint()
        kind = key & 7
        if kind == 0:
            yield key >> 3, varint()
        elif kind == 2:
            size = varint()
            yield key >> 3, raw[i : i + size]
            i += size
        else:
            size = 4 if kind == 5 else 8
            yield key >> 3, raw[i : i + size]
            i += size


@dataclass
class Pieces:
    """What a model file says."""

    texts: list[str]
    scores: list[float]
    kinds: list[int]
    dummy_prefix: bool = True
    charsmap: bool = False
    squeeze: bool = False

    @classmethod
    def read(cls, raw: bytes) -> "Pieces":
        texts, scores, kinds, spec = [], [], [], {}
        for number, value in fields(raw):
            if number == 1:
                piece = dict(fields(value))
                texts.append(piece.get(1, b"").decode())
                scores.append(struct.unpack("<f", piece[2])[0] if 2 in piece else 0.0)
                kinds.append(piece.get(3, NORMAL))
            elif number == 3:
                spec = dict(fields(value))
        return cls(texts, scores, kinds, bool(spec.get(3, 1)), bool(spec.get(2)), bool(spec.get(4, 1)))


class DoubleArray:
    """Trie in two arrays: from node s, byte c leads to base[s] + c if check there is s. Values by node, -1 for none."""

    def __init__(self, keys: list[bytes]):
        children: list[dict[int, int]] = [{}]
        value = [-1]
        for i, key in enumerate(keys):
            node = 0
            for c in key:
                nxt = children[node].get(c)
                if nxt is None:
                    nxt = children[node][c] = len(children)
                    children.append({})
                    value.append(-1)
                node = nxt
            value[node] = i
        size = 2 * len(children) + 512
        check = np.full(size, -1, np.int32)
        base, values = np.zeros(size, np.int32), np.full(size, -1, np.int32)
        check[0] = 0
        todo, free, top = [(0, 0)], 257, 257  # first free place, first after all taken; bytes below make no base negative
        values[0] = value[0]
        for node, at in todo:  # grows while it is read
            kids = children[node]
            if not kids:
                continue
            codes = np.array(sorted(kids), np.int64)
            if top + 512 >= len(check):
                check, base, values = (np.concatenate([x, np.full(len(x), f, np.int32)]) for x, f in ((check, -1), (base, 0), (values, -1)))
            while check[free] >= 0:
                free += 1
            # A single child fills the first gap; several are tried near the end, where there is room.
            b = max(1, (free if len(codes) == 1 else max(free, top - 64)) - int(codes[0]))
            while (check[b + codes] >= 0).any():
                b += 1
            top = max(top, b + int(codes[-1]) + 1)
            base[at] = b
            check[b + codes] = at
            for c in codes.tolist():
                values[b + c] = value[kids[c]]
                todo.append((kids[c], b + c))
        last = int(np.flatnonzero(check >= 0).max()) + 257
        self.base, self.check, self.values = base[:last], check[:last], values[:last]


class Unigram:
    def __init__(self, pieces: Pieces):
        if pieces.charsmap:
            raise ValueError("models that rewrite characters before encoding are not supported")
        self.pieces = pieces
        usable = [i for i, k in enumerate(pieces.kinds) if k in (NORMAL, USER) and pieces.texts[i]]
        trie = DoubleArray([pieces.texts[i].encode() for i in usable])
        self.base, self.check = trie.base.tolist(), trie.check.tolist()
        self.piece = [usable[v] if v >= 0 else -1 for v in trie.values.tolist()]
        normal = [pieces.scores[i] for i, k in enumerate(pieces.kinds) if k == NORMAL]
        self.unknown_score = (min(normal) if normal else 0.0) - UNKNOWN_PENALTY
        top = max(normal, default=0.0)
        self.scores = [len(pieces.texts[i].encode()) * top - 0.1 if k == USER else s for i, (k, s) in enumerate(zip(pieces.kinds, pieces.scores))]
        self.bytes = {int(pieces.texts[i][1:-1], 16): i for i, k in enumerate(pieces.kinds) if k == BYTE}
        self.unknown = pieces.kinds.index(UNKNOWN) if UNKNOWN in pieces.kinds else 0
        inner = any(re.search(f"[^{MARKER}]{MARKER}", pieces.texts[i]) for i in usable)
        line = any("\n" in pieces.texts[i] for i in usable)
        self.parts = None if inner else re.compile(f"{MARKER}*[^{MARKER}]+|{MARKER}+" if line else f"\n|{MARKER}*[^{MARKER}\n]+|{MARKER}+")
        self.cache: dict[str, tuple[int, ...]] = {}

    def segment(self, text: str) -> tuple[int, ...]:
        """Ids of the best segmentation of a marked text."""
        raw = text.encode()
        n = len(raw)
        base, check, piece, scores = self.base, self.check, self.piece, self.scores
        size = len(check)
        best = [None] * (n + 1)  # score up to here
        back = [(0, 0)] * (n + 1)  # where the last piece begins, and its id or -1
        best[0] = 0.0
        i = 0
        while i < n:
            first = raw[i]
            width = 1 if first < 128 else 2 if first < 224 else 3 if first < 240 else 4
            here = best[i]
            node, j, single = 0, i, False
            while j < n:
                nxt = base[node] + raw[j]
                if nxt >= size or check[nxt] != node or nxt == 0:
                    break
                node = nxt
                j += 1
                p = piece[node]
                if p >= 0:
                    s = here + scores[p]
                    if best[j] is None or s > best[j]:
                        best[j], back[j] = s, (i, p)
                    single |= j == i + width
            if not single:
                j = i + width
                s = here + self.unknown_score
                if best[j] is None or s > best[j]:
                    best[j], back[j] = s, (i, -1)
            i += width
        out, j = [], n
        while j > 0:
            i, p = back[j]
            if p >= 0:
                out.append(p)
            elif self.bytes:
                out += [self.bytes[b] for b in reversed(raw[i:j])]
            else:
                out.append(self.unknown)
            j = i
        return tuple(reversed(out))

    def encode(self, text: str | None) -> list[int]:
        if not text:
            return []
        if self.pieces.squeeze:
            text = re.sub(" +", " ", text.strip(" "))
            if not text:
                return []
        marked = text.replace(" ", MARKER)
        if self.pieces.dummy_prefix:
            marked = MARKER + marked
        if self.parts is None:
            return list(self.segment(marked))
        out: list[int] = []
        cache = self.cache
        for part in self.parts.findall(marked):
            ids = cache.get(part)
            if ids is None:
                ids = self.segment(part)
                if len(cache) >= CACHE_PARTS:
                    cache.clear()
                if len(part) < 64:
                    cache[part] = ids
            out += ids
        return out

    def decode(self, ids) -> str:
        """Text of ids: byte pieces in a row are read as UTF-8, bad bytes as U+FFFD; control pieces say nothing."""
        texts, kinds = self.pieces.texts, self.pieces.kinds
        out, held = [], bytearray()
        for i in ids:
            if kinds[i] == BYTE:
                held.append(int(texts[i][1:-1], 16))
                continue
            if held:
                out.append(held.decode(errors="replace"))
                held = bytearray()
            if kinds[i] == UNKNOWN:
                out.append(" ⁇ ")
            elif kinds[i] != CONTROL:
                out.append(texts[i])
        if held:
            out.append(held.decode(errors="replace"))
        text = "".join(out)
        if self.pieces.dummy_prefix and text.startswith(MARKER):
            text = text[1:]
        return text.replace(MARKER, " ")


@functools.lru_cache(maxsize=2)
def model(path: str) -> Unigram:
    """Read once a worker. The file is part of an installed package, so every executor has it."""
    with open(path, "rb") as f:
        return Unigram(Pieces.read(f.read()))


def encode(docs: DataFrame, path: str, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, ids (array<int>), n_bytes (ids that are bytes) and exact (whether decoding gives the text back) for every row of docs.

    Null and empty texts: no ids, exact. A text that has the marker character itself decodes to a space there, so
    it is not exact. Repeated rows are encoded as often as they occur; extra columns are ignored.
    """
    schema = docs.select(*keep).schema.add("ids", T.ArrayType(T.IntegerType())).add("n_bytes", "long").add("exact", "boolean")

    def run(batches):
        m = model(path)
        byte_ids = set(m.bytes.values())
        for t in chunked(batches, 8 << 20):
            ids = [np.array(m.encode(x), np.int32) for x in t.column("text").to_pylist()]
            fallback = np.array(sorted(byte_ids), np.int32)
            n_bytes = [int(np.isin(x, fallback).sum()) for x in ids]
            exact = [m.decode(x.tolist()) == (text or "") for x, text in zip(ids, t.column("text").to_pylist())]
            cut = np.r_[0, np.cumsum([len(x) for x in ids])].astype(np.int32)
            lists = pa.ListArray.from_arrays(pa.array(cut), pa.array(np.concatenate(ids) if ids else np.zeros(0, np.int32)))
            yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in keep), lists, pa.array(n_bytes, pa.int64()), pa.array(exact, pa.bool_())], [*keep, "ids", "n_bytes", "exact"])

    columns = list(dict.fromkeys([*keep, "text"]))
    return docs.select(*columns).mapInArrow(run, schema)


def digest(encoded: DataFrame) -> DataFrame:
    """Replaces ids by n_ids and ids_crc32 (of the ids as little-endian unsigned 32-bit numbers)."""
    keep = [c for c in encoded.columns if c != "ids"]

    def run(batches):
        for b in batches:
            lists = b.column(b.schema.get_field_index("ids"))
            values, cut = lists.flatten().to_numpy(zero_copy_only=False).astype("<u4"), lists.offsets.to_numpy() - lists.offsets[0].as_py()
            crc = [zlib.crc32(values[i:j].tobytes()) for i, j in zip(cut, cut[1:])]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(np.diff(cut).astype(np.int64)), pa.array(crc, pa.int64())], [*keep, "n_ids", "ids_crc32"])

    return encoded.mapInArrow(run, encoded.select(*keep).schema.add("n_ids", "long").add("ids_crc32", "long"))


def decode_column(rows: DataFrame, path: str, ids: str = "ids", out: str = "text") -> DataFrame:
    """Adds the decoded text of a column of ids; null ids give null."""

    def run(batches):
        m = model(path)
        for b in batches:
            got = [None if x is None else m.decode(x) for x in b.column(b.schema.get_field_index(ids)).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(got, pa.string())], [*b.schema.names, out])

    return rows.mapInArrow(run, rows.select("*").schema.add(out, "string"))
