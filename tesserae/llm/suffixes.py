"""Repeated byte strings by distributed prefix doubling over rank pairs.

The rank of a position at length h names its first h bytes: equal ranks, equal bytes. Ranks of length 2h are
pairs (rank at p, rank at p + h) renamed. Ranks are 64-bit hashes, so they are the same in all tasks; equality
is told by two of them, 128 bits. A document never leaves its task, so the ranks of lengths 1, 2, 4, 8, 16
and 32 of its positions are doubled there. What Spark sorts and reranks are the lengths that can tell
documents apart, for fewer positions each time:

1. A filter: rank of length 26 at one sampled position per window of `length` bytes, the leftmost smallest
   in it. Equal windows sample equal positions, wherever they stand, so windows whose rank is found in one document only are unique and are dropped.
2. Offset 24: consecutive windows that share a sampled position are a run of 50 to 74 bytes. Spark sorts pairs
   (rank of length 26, rank of the whole run). A run that also stands in a smaller document is settled; one
   whose rank is shared by no other run is unique and is dropped; all others go on.
3. Full length: Spark sorts pairs (rank at p, rank at p + 18) of length 32 for every window of the runs left.

Exact copies of whole texts are settled before that. In each round a task sends each pair once, with the
smallest document that has it, so a passage that a third of all documents share costs one row for each task.
Sorted rows are streamed: no task holds the rows of a pair.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import BUCKETS_PER_PARTITION, bucketed, by_bucket, chunked, exchange, flat, longs, partitions, remove, settle

LENGTH = 50
SAMPLE = 26
TILE = 1 << 16
#: Bytes of text whose ranks a task holds at once; longer documents are worked on piece by piece.
PIECE = 8 << 20
_M1, _M2, _M3 = (np.uint64(x) for x in (0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0x9E3779B97F4A7C15))
_S29, _S32 = np.uint64(29), np.uint64(32)
_BYTE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, np.uint64)
_ODD = np.uint64(1)
#: Document of a row that only marks its key.
_LAST = np.iinfo(np.int64).max


def pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The name of a pair of ranks."""
    x = a * _M1
    x ^= x >> _S29
    x += b
    x *= _M2
    x ^= x >> _S32
    return x


class Runs:
    """Runs of windows of some texts: text index, first and last window start, rank of the sampled position, name of the run."""

    def __init__(self, data: np.ndarray, off: np.ndarray, length: int = LENGTH):
        self.data, self.length, self.tiles = data, length, list(_tiles(off, length))
        parts = [self._tile(off, *tile) for tile in self.tiles]
        kinds = (np.int64, np.int64, np.int64, np.uint64, np.uint64)
        self.doc, self.first, self.last, self.rank, self.name = (np.concatenate([p[k] for p in parts]) if parts else np.zeros(0, t) for k, t in enumerate(kinds))

    def _tile(self, off, a, b, i, j):
        """Windows that start in bytes a..b of texts i..j."""
        length = self.length
        r16, r32 = _ranks(self.data[a:b])
        rank = pair(r16[: len(r16) - (SAMPLE - 16)], r16[SAMPLE - 16 :])
        at = _leftmost(rank, length - SAMPLE + 1)
        n = len(at)
        heads, ends = np.maximum(off[i:j] - a, 0), np.minimum(off[i + 1 : j + 1], b) - a
        new = np.ones(n + 1, bool)
        new[1:n] = at[1:] != at[:-1]
        new[heads[heads < n]] = True
        stops = np.maximum(ends - length + 1, heads)  # windows from here on reach into the next text
        new[stops[stops < n]] = True
        edges = np.flatnonzero(new)
        first, last = edges[:-1], edges[1:] - 1
        doc = np.searchsorted(heads, first, "right") - 1
        ok = first + length <= ends[doc]
        first, last, doc = first[ok], last[ok], doc[ok]
        p, size = at[first], last - first + length  # sizes run from length to 2 * length - SAMPLE
        name = pair(r32[first], r32[first + size - 32])
        for step in range(24, 2 * length - SAMPLE - 32, 24):
            name = pair(name, r32[first + np.minimum(step, size - 32)])
        name = pair(name, pair(rank[p], ((size.astype(np.uint64) << np.uint64(20)) | (p - first).astype(np.uint64)) * _M3))
        return doc + i, first + a, last + a, rank[p], name

    def windows(self, pick: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of the runs picked (ascending): text index, start, rank at the start and name of the pair of ranks of every window."""
        first, size = self.first[pick], self.last[pick] - self.first[pick] + 1
        starts = np.repeat(first - np.r_[0, np.cumsum(size)[:-1]], size) + np.arange(size.sum())
        ranks, names, done = np.zeros(len(starts), np.uint64), np.zeros(len(starts), np.uint64), 0
        for a, b, _, _ in self.tiles:
            upto = np.searchsorted(starts, b - self.length, "right")
            if upto > done:
                r32, at = _ranks(self.data[a:b])[1], starts[done:upto] - a
                ranks[done:upto] = r32[at]
                names[done:upto] = pair(r32[at], r32[at + self.length - 32])
                done = upto
        return np.repeat(self.doc[pick], size), starts, ranks, names


def _ranks(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ranks of lengths 16 and 32 of all positions that have as many bytes after them."""
    r, h = _BYTE[data], 1
    while h < 16:
        r = pair(r[:-h], r[h:])
        h *= 2
    return r, pair(r[:-16], r[16:])


def _leftmost(rank: np.ndarray, width: int) -> np.ndarray:
    """For each window of `width` ranks, the position of the smallest, by all but its lowest 17 bits; the leftmost of equals."""
    low = np.uint64((1 << 17) - 1)
    v, w = (rank & ~low) | np.arange(len(rank), dtype=np.uint64), 1
    while w < width:
        step = min(w, width - w)
        v = np.minimum(v[:-step], v[step:])
        w += step
    return (v & low).astype(np.int64)


def _tiles(off: np.ndarray, length: int):
    """(a, b, i, j): byte ranges and the texts in them; neighbours of up to TILE bytes together, longer texts cut by themselves, always at the same places."""
    i, n = 0, len(off) - 1
    while i < n:
        j = i + 1
        if off[j] - off[i] > TILE:
            for a in range(int(off[i]), int(off[j]) - length + 1, TILE):
                yield a, min(int(off[j]), a + TILE + length - 1), i, j
        else:
            while j < n and off[j + 1] - off[i] <= TILE:
                j += 1
            if off[j] - off[i] >= length:
                yield int(off[i]), int(off[j]), i, j
        i = j


def _in_pieces(t: pa.Table, length: int):
    """(rows, base, runs): runs of neighbouring rows of about PIECE bytes together, or of a piece of one long row; base: what to add to positions for those in each row."""
    data, off = flat(t.column("text"))
    i, n = 0, len(off) - 1
    while i < n:
        j = i + 1
        while j < n and off[j + 1] - off[i] <= PIECE:
            j += 1
        if off[j] - off[i] <= PIECE + length:
            yield np.arange(i, j), off[i] - off[i:j], Runs(data[off[i] : off[j]], off[i : j + 1] - off[i], length)
        else:
            for a in range(0, int(off[j] - off[i]) - length + 1, PIECE):
                part = data[off[i] + a : min(off[j], off[i] + a + PIECE + length - 1)]
                yield np.array([i]), np.array([a]), Runs(part, np.array([0, len(part)]), length)
        i = j


class _Listed:
    """Lists of names, one for each row of a table."""

    def __init__(self, lists: pa.ChunkedArray):
        lists = lists.combine_chunks()
        size = np.diff(lists.offsets.to_numpy())
        value = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64).view(np.uint64)
        self.known = np.sort(pair(value, np.repeat(np.arange(len(size), dtype=np.uint64), size) * _M3))

    def __len__(self):
        return len(self.known)

    def has(self, row: np.ndarray, name: np.ndarray) -> np.ndarray:
        if not len(self.known):
            return np.zeros(len(name), bool)
        want = pair(name, row.astype(np.uint64) * _M3)
        return self.known[np.minimum(np.searchsorted(self.known, want), len(self.known) - 1)] == want


def _by_key(doc: np.ndarray, *keys: np.ndarray):
    """Sorts by keys and document; returns documents and keys, each document once for each key, and whether a key begins."""
    order = np.lexsort((doc, *reversed(keys)))
    doc, keys = doc[order], tuple(k[order] for k in keys)
    new = np.ones(len(doc), bool)
    if len(doc):
        new[1:] = np.any([k[1:] != k[:-1] for k in keys], axis=0)
    once = new.copy()
    once[1:] |= doc[1:] != doc[:-1]
    return doc[once], tuple(k[once] for k in keys), new[once]


def _sizes(new: np.ndarray) -> np.ndarray:
    """Size of each group, given where groups begin."""
    return np.diff(np.r_[np.flatnonzero(new), len(new)])


_FOUND = "doc_id long, name long, kind int"


def _found(doc, name, kind):
    if len(doc):
        yield pa.RecordBatch.from_arrays([pa.array(doc), pa.array(name.view(np.int64)), pa.array(np.full(len(doc), kind, np.int32))], ["doc_id", "name", "kind"])


def _told(doc, name) -> bytes:
    """Findings that need no other task."""
    return np.stack([doc, name.view(np.int64)]).tobytes()


def _hear(told: bytes):
    doc, name = np.frombuffer(told, np.int64).reshape(2, -1)
    return doc, name.view(np.uint64)


# The filter: ranks at sampled positions, packed by bucket; found are (document, rank) whose rank stands in more than one document.

_PACKED = "bucket int, ranks binary, docs binary, told binary"


def _shorter(doc: np.ndarray) -> bytes:
    """Document ids as differences from the smallest, in 4 bytes where they fit."""
    low = int(doc.min())
    wide = int(doc.max()) - low >= 1 << 32
    return low.to_bytes(8, "little", signed=True) + bytes([wide]) + (doc.tobytes() if wide else (doc - low).astype(np.uint32).tobytes())


def _longer(x: bytes) -> np.ndarray:
    return np.frombuffer(x, np.int64, offset=9) if x[8] else np.frombuffer(x, np.uint32, offset=9).astype(np.int64) + int.from_bytes(x[:8], "little", signed=True)


def _filter_send(batches, n, length):
    for t in chunked(batches, PIECE, 1 << 16):
        ids = longs(t.column("doc_id"))
        for rows, _, runs in _in_pieces(t, length):
            doc, (rank,), new = _by_key(ids[rows][runs.doc], runs.rank)
            size = _sizes(new)
            many = np.repeat(size > 1, size)
            out = [(b, rank[new][at].tobytes(), _shorter(doc[new][at]), None) for b, at in bucketed(rank[new] * _M3, n)]
            if many.any():
                out.append((int(doc[0]) % n, None, None, _told(doc[many], rank[many])))
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.binary(), pa.binary(), pa.binary()))], ["bucket", "ranks", "docs", "told"])


def _filter_rank(batches):
    for t in by_bucket(batches):
        for told in t.column("told").to_pylist():
            if told:
                yield from _found(*_hear(told), 0)
        docs = [_longer(x) for x in t.column("docs").to_pylist() if x]
        if docs:
            doc, (rank,), new = _by_key(np.concatenate(docs), np.frombuffer(b"".join(x for x in t.column("ranks").to_pylist() if x), np.uint64))
            size = _sizes(new)
            many = np.repeat(size > 1, size)
            yield from _found(doc[many], rank[many], 0)


# The rounds that Spark sorts: rows (key, name, document) of runs and windows.

_ROWS = "part int, key long, name long, doc_id long, told binary"


def _rows(key, name, doc, n, told=b""):
    """Rows of rank pairs; the part is the range of the key."""
    part = (((key >> _S32) * np.uint64(n)) >> _S32).astype(np.int32)
    cols = [pa.array(part), pa.array(key.view(np.int64)), pa.array(name.view(np.int64)), pa.array(doc), pa.nulls(len(key), pa.binary())]
    if len(key):
        yield pa.RecordBatch.from_arrays(cols, ["part", "key", "name", "doc_id", "told"])
    if told:
        at = [pa.array([len(told) % n], pa.int32()), *(pa.nulls(1, pa.int64()) for _ in range(3)), pa.array([told], pa.binary())]
        yield pa.RecordBatch.from_arrays(at, ["part", "key", "name", "doc_id", "told"])


def sorted_pairs(rows: DataFrame, n: int) -> DataFrame:
    """All rows in the order of their rank pairs and documents: ranges of keys are dealt to partitions, which Spark sorts."""
    return rows.repartitionById(n, "part").drop("part").sortWithinPartitions("key", "name", "doc_id")


def _runs_send(batches, n, length):
    """Pairs (rank, run). Ranks with several runs here are known to go on: their runs meet by name under odd keys, so that a hot rank is spread, and a mark tells other tasks."""
    for t in chunked(batches, PIECE, 1 << 16):
        ids, wanted = longs(t.column("doc_id")), _Listed(t.column("names"))
        for rows, _, runs in _in_pieces(t, length):
            pick = wanted.has(rows[runs.doc], runs.rank)
            doc, (rank, name), new = _by_key(ids[rows][runs.doc[pick]], runs.rank[pick], runs.name[pick])
            told = _told(doc[~new], name[~new]) if not new.all() else b""
            doc, rank, name = doc[new], rank[new], name[new]
            size = _sizes(np.r_[True, rank[1:] != rank[:-1]][: len(rank)])
            many, marks = np.repeat(size > 1, size), rank[np.cumsum(size) - size][size > 1]
            # Sampled ranks are small ones; a factor spreads them.
            key = np.concatenate([np.where(many, pair(name, rank) | _ODD, rank * _M3 & ~_ODD), marks * _M3 & ~_ODD])
            yield from _rows(key, np.r_[name, np.zeros(len(marks), np.uint64)], np.r_[doc, np.full(len(marks), _LAST)], n, told)


def _windows_send(batches, n, length):
    """Pairs (rank at p, rank at p + length - 32) of windows, by the name of the pair."""
    for t in chunked(batches, PIECE, 1 << 16):
        ids, wanted = longs(t.column("doc_id")), _Listed(t.column("names"))
        for rows, _, runs in _in_pieces(t, length):
            at, _, rank, name = runs.windows(np.flatnonzero(wanted.has(rows[runs.doc], runs.name)))
            doc, (name, rank), new = _by_key(ids[rows][at], name, rank)
            yield from _rows(name[new], rank[new], doc[new], n, _told(doc[~new], name[~new]) if not new.all() else b"")


def _rerank(batches, settled: int, by_key: bool):
    """Of rows in order: which documents have a pair that a smaller one has too (kind `settled`), and which pairs have an odd key or share theirs (kind 1).

    Findings name the key or the second of the pair. Only the last row is held from batch to batch.
    """
    last, alone = None, None  # alone: (document, name) of the last key, while it has one name only
    for b in batches:
        told = b.column("told")
        if told.null_count < len(told):
            for x in told.drop_null().to_pylist():
                yield from _found(*_hear(x), settled)
            b = b.filter(told.is_null())
        if not b.num_rows:
            continue
        key, name, doc = (longs(b.column(c)) for c in ("key", "name", "doc_id"))
        was = [np.r_[x[:1] if last is None else last[k], x[:-1]] for k, x in enumerate((key, name, doc))]
        new_key = key != was[0]
        if last is None:
            new_key[0] = True
        new = new_key | (name != was[1])
        real = doc != _LAST
        late = real & ~new & (doc != was[2])
        yield from _found(doc[late], (key if by_key else name)[late].view(np.uint64), settled)
        if not by_key:
            heads = np.flatnonzero(new)
            if len(heads):
                joins = ~new_key[heads]  # shares its key with the head before
                if joins[0] and alone is not None:
                    yield from _found(alone[0], alone[1], 1)
                shares = joins | np.r_[joins[1:], False] | (key[heads] & 1 > 0)
                look = heads[shares & real[heads]]
                yield from _found(doc[look], name[look].view(np.uint64), 1)
                end = heads[-1:]
                alone = None if shares[-1] or not real[end[0]] else (doc[end], name[end].view(np.uint64))
        last = key[-1:], name[-1:], doc[-1:]


# Cutting


class _Spans:
    """Removed parts of the rows of a table, from ranges that may overlap."""

    def __init__(self, row, start, end):
        order = np.lexsort((start, row))
        row, start, end = row[order], start[order], end[order]
        if len(row):
            # Ends rise within a row if each row's are lifted over all those before.
            lift = row * (int(end.max()) + 1)
            upto = np.maximum.accumulate(end + lift) - lift
            new = np.r_[True, (row[1:] != row[:-1]) | (start[1:] > upto[:-1])]
            row, start, end = row[new], start[new], np.maximum.reduceat(end, np.flatnonzero(new))
        self.row, self.start, self.end = row, start, end

    @classmethod
    def joined(cls, parts: list[_Spans]) -> _Spans:
        none = np.zeros(0, np.int64)
        return cls(*(np.concatenate([none, *(getattr(p, c) for p in parts)]) for c in ("row", "start", "end")))


def _spans(t: pa.Table, length: int) -> _Spans:
    whole, looked, windows = (_Listed(t.column(c)) for c in ("_whole", "_looked", "_windows"))
    parts = []
    if len(whole) or len(windows):
        for rows, base, runs in _in_pieces(t, length):
            pick = whole.has(rows[runs.doc], runs.name)
            at, start, _, name = runs.windows(np.flatnonzero(~pick & looked.has(rows[runs.doc], runs.name)))
            hit = windows.has(rows[at], name)
            doc, first = np.r_[runs.doc[pick], at[hit]], np.r_[runs.first[pick], start[hit]]
            last = np.r_[runs.last[pick], start[hit]]
            parts.append(_Spans(rows[doc], first + base[doc], last + base[doc] + length))
    return _Spans.joined(parts)


def _cut(batches, length, keep, kept):
    for t in chunked(batches, PIECE, 1 << 16):
        data, off = flat(t.column("text"))
        size, copy = np.diff(off), np.array(t.column("_copy").to_pylist(), bool)
        spans = _spans(t, length)
        n_removed = np.where(copy, size, np.bincount(spans.row, spans.end - spans.start, minlength=len(size)).astype(np.int64))
        n_spans = np.where(copy, 1, np.bincount(spans.row, minlength=len(size)))
        first = np.searchsorted(spans.row, np.arange(len(size) + 1))
        hashes, left = [], []
        for i, a in enumerate(off[:-1]):
            lo, hi = first[i], first[i + 1]
            stay = [] if copy[i] else zip(np.r_[0, spans.end[lo:hi]] + a, np.r_[spans.start[lo:hi], size[i]] + a)
            parts, h = [data[x:y] for x, y in stay if y > x], hashlib.sha256()
            for p in parts:
                h.update(p)
            hashes.append(h.hexdigest())
            if kept:
                left.append(b"".join(p.tobytes() for p in parts))
        cols = [pa.array(size), pa.array(n_removed), pa.array(n_spans), pa.array(hashes, pa.string())]
        if kept == "string":
            null = t.column("text").is_null().to_pylist()
            left = [None if x else y.decode(errors="ignore") for x, y in zip(null, left)]
        if kept:
            cols.append(pa.array(left, pa.string() if kept == "string" else pa.binary()))
        yield pa.RecordBatch.from_arrays([*(t.column(c).combine_chunks() for c in keep), *cols], [*keep, *_ADDED, *(["kept"] if kept else [])])


_ADDED = ("n_bytes", "n_removed", "n_spans", "kept_sha256")


def remove_repeats(docs: DataFrame, length: int = LENGTH, keep: tuple[str, ...] = ("doc_id",), kept: str | None = None) -> DataFrame:
    """Takes out of each text every byte covered by a `length`-byte string that also starts in a document with a smaller doc_id.

    Returns the columns `keep`, n_bytes, n_removed, n_spans and kept_sha256. kept "binary" adds the bytes
    left as a column of that name; "string" adds them as text, without bytes that are no character any more,
    null for a null text. Strings never cross documents and are judged on the input. Null text: empty. Rows with
    one doc_id are parts of one document: they don't count as smaller than each other. Rows with a null doc_id
    are returned whole, and take nothing from others. Other columns are ignored. `length` from 40 to 64.
    """
    if not 40 <= length <= 64:
        raise ValueError("length must lie between 40 and 64")
    spark = docs.sparkSession
    n = partitions(spark)
    nb = n * BUCKETS_PER_PARTITION
    columns = list(dict.fromkeys(["doc_id", *keep, "text"]))
    docs = docs.select(*columns).withColumn("doc_id", F.col("doc_id").cast("long"))
    long_enough = docs.where("doc_id is not null and octet_length(text) >= %d" % length)
    texts = long_enough.select("doc_id", "text")

    hashes = long_enough.select("doc_id", F.sha2("text", 256).alias("hash"))
    first = hashes.groupBy("hash").agg(F.min("doc_id").alias("first"))
    copies = hashes.join(first.hint("merge"), "hash").select("doc_id", "hash", (F.col("doc_id") > F.col("first")).alias("copy"))
    copies, p_copies = settle(copies.groupBy("doc_id").agg(F.array_distinct(F.array_agg(F.expr("if(copy, hash, null)"))).alias("copied"), F.bool_and("copy").alias("only")))
    done = copies.where("only").select("doc_id")

    def listed(rows, kind):
        return rows.where(F.col("kind") == kind).groupBy("doc_id").agg(F.collect_list("name").alias("names"))

    one, p_one = settle(exchange(texts.mapInArrow(lambda it: _filter_send(it, nb, length), _PACKED), n).mapInArrow(_filter_rank, _FOUND))
    sent = texts.join(listed(one, 0).join(done, "doc_id", "left_anti"), "doc_id").mapInArrow(lambda it: _runs_send(it, n, length), _ROWS)
    two, _ = settle(sorted_pairs(sent, n).mapInArrow(lambda it: _rerank(it, 0, False), _FOUND), p_one)
    sent = texts.join(listed(two, 1), "doc_id").mapInArrow(lambda it: _windows_send(it, n, length), _ROWS)
    three, _ = settle(sorted_pairs(sent, n).mapInArrow(lambda it: _rerank(it, 2, True), _FOUND))
    lists = two.unionByName(three).groupBy("doc_id").agg(*(F.collect_list(F.expr(f"if(kind = {k}, name, null)")).alias(c) for k, c in enumerate(("whole", "looked", "windows"))))
    lists = lists.join(copies.where("size(array_compact(copied)) > 0"), "doc_id", "full_outer")
    none = F.expr("array()").cast("array<long>")
    # The lists' columns lie in a struct, so that those to keep may have any names.
    found = F.struct(*(F.coalesce(c, none).alias(c) for c in ("whole", "looked", "windows")), F.array_compact("copied").alias("copied")).alias("_found")
    whole = docs.join(lists.select("doc_id", found), "doc_id", "left")
    cells = [F.coalesce(f"_found.{c}", none).alias(f"_{c}") for c in ("whole", "looked", "windows")]
    is_copy = F.coalesce(F.array_contains("_found.copied", F.sha2("text", 256)), F.lit(False)).alias("_copy")
    schema = docs.select(*keep).schema
    for name, kind in (("n_bytes", "long"), ("n_removed", "long"), ("n_spans", "long"), ("kept_sha256", "string"), *([("kept", kept)] if kept else [])):
        schema = schema.add(name, kind)
    return whole.select(*columns, *cells, is_copy).mapInArrow(lambda it: _cut(it, length, keep, kept), schema)
