"""Best-fit packing: token pieces into fixed-length sequences by best-two-fit.

A document's ids and an end mark are cut into pieces of at most `capacity` ids, the short piece first.
Lengths lie in 1..capacity, so the plan is made on a histogram of lengths: its size, and the time to
make it, are bounded by the capacity, not by the corpus. Each step opens a bin with the longest piece
left, fills it greedily with the longest that fits, and then tries to replace the bin's smallest piece
with two pieces not yet packed that fill the gap so opened more tightly. The pattern found is repeated
as often as the histogram allows. Pieces get their places by their number among those of their length,
which Spark finds from counts by (length, hash group): no task sees all pieces of a length.
"""

from __future__ import annotations

import functools
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import chunked, partitions, settle

CAPACITY = 1024
END_ID = 2
#: Characters of white space in one run from which a text takes the slower way.
LONG_RUN = 50_000
#: Hash groups among which the pieces of one length are dealt for numbering, for each shuffle partition.
GROUPS_PER_PARTITION = 4


@functools.lru_cache(maxsize=2)
def encoder(vocabulary: str):
    """Function from texts to lists of ids, of a byte-level BPE that the tokenizers library reads.

    The ids are those of `tokenizers` with add_special_tokens=False. Texts without special-token
    strings go through tiktoken's faster merge loop over the same vocabulary and merges; not those with a long
    run of white space, in which the look-ahead of tiktoken's pattern takes one stack frame a character.
    """
    import json
    import re

    import tiktoken
    from tokenizers import Tokenizer

    whole = Tokenizer.from_file(vocabulary)
    with open(vocabulary, encoding="utf-8") as f:
        spec = json.load(f)
    special = [t["content"] for t in spec.get("added_tokens", [])]
    # Byte-level vocabularies write each byte as a printable character: printable bytes stand for
    # themselves, the others for the code points from 256 on, in order.
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    letters = {chr(b): b for b in printable} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in printable)}
    ranks = {bytes(letters[c] for c in piece): i for piece, i in spec["model"]["vocab"].items() if piece not in special}
    pattern = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
    fast = tiktoken.Encoding("pieces", pat_str=pattern, mergeable_ranks=ranks, special_tokens={})
    long_run = re.compile(r"\s{%d}" % LONG_RUN)

    def encode(text: str) -> list[int]:
        if any(s in text for s in special) or len(text) >= LONG_RUN and long_run.search(text):
            return whole.encode(text, add_special_tokens=False).ids
        return fast.encode_ordinary(text)

    return encode


def cut(length: int, capacity: int = CAPACITY) -> list[tuple[int, int]]:
    """(start, length) of a document's pieces: only the first may be shorter than the capacity."""
    first = length % capacity or min(length, capacity)
    return [(0, first)] + [(s, capacity) for s in range(first, length, capacity)]


def pieces(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32 (and ids) of every document's pieces. Null text: the end mark alone."""

    def run(batches):
        encode = encoder(vocabulary)
        for t in chunked(batches, 4 << 20):
            out = []
            for doc, text in zip(t.column("doc_id").to_pylist(), t.column("text").to_pylist()):
                ids = np.array([*(encode(text) if text else ()), end_id], "<u4")
                for k, (s, n) in enumerate(cut(len(ids), capacity)):
                    part = ids[s : s + n]
                    out.append((doc, k, s, n, zlib.crc32(part.tobytes())) + ((part.tolist(),) if with_ids else ()))
            cols = list(zip(*out)) or [()] * (5 + with_ids)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()] + [pa.list_(pa.int64())] * with_ids
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc_id", "piece", "start", "length", "ids_crc32"] + ["ids"] * with_ids)

    schema = "doc_id long, piece int, start long, length long, ids_crc32 long" + ", ids array<long>" * with_ids
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, schema)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[tuple[int, ...], int]]:
    """Best-two-fit over a histogram of lengths: (lengths of a bin in order, number of such bins).

    A bin of one piece is not exchanged: its piece is the longest left, and best-two-fit replaces the smallest of a greedy fill.
    """
    left = {k: v for k, v in counts.items() if v > 0}
    if left and (min(left) < 1 or max(left) > capacity):
        raise ValueError("lengths must lie between 1 and the capacity")
    out = []
    while left:
        used: dict[int, int] = {}
        free = lambda n: left.get(n, 0) - used.get(n, 0)
        order = sorted(left, reverse=True)
        items, gap = [], capacity
        for n in order:
            while n <= gap and free(n) > 0:
                used[n] = used.get(n, 0) + 1
                items.append(n)
                gap -= n
        if gap and len(items) > 1:
            small = items[-1]
            room, best = gap + small, (small, None)
            lo, hi = len(order) - 1, 0  # order falls: from the shortest upwards, from the longest downwards
            while hi <= lo:
                a, b = order[hi], order[lo]
                need = 2 if a == b else 1
                if a + b > room or free(a) < 1:
                    hi += 1
                elif free(b) < need:
                    lo -= 1
                else:
                    if a + b > best[0]:
                        best = (a + b, (a, b))
                    lo -= 1
            if best[1]:
                items[-1:] = best[1]
        need = {n: items.count(n) for n in set(items)}
        times = min(left[n] // c for n, c in need.items())
        for n, c in need.items():
            left[n] -= c * times
            if not left[n]:
                del left[n]
        out.append((tuple(items), times))
    return out


def places(patterns: list[tuple[tuple[int, ...], int]]) -> dict[int, np.ndarray]:
    """For each length: rows (first number, first sequence, offset); a piece numbered r in its length lies in the last row with first number <= r, in sequence first sequence + r - first number."""
    rows: dict[int, list] = {}
    upto: dict[int, int] = {}
    base = 0
    for items, times in patterns:
        at = 0
        for n in items:
            rows.setdefault(n, []).append((upto.get(n, 0), base, at))
            upto[n] = upto.get(n, 0) + times
            at += n
        base += times
    return {n: np.array(r, np.int64) for n, r in rows.items()}


def pack(cuts: DataFrame, capacity: int = CAPACITY) -> DataFrame:
    """Adds sequence_id and offset to rows with doc_id, piece and length. Empty input: no rows."""
    spark = cuts.sparkSession
    n = partitions(spark) * GROUPS_PER_PARTITION
    cuts, _ = settle(cuts.withColumn("grp", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(n)).cast("int")))
    sizes = cuts.groupBy("length", "grp").agg(F.count("*").alias("n"))
    w = Window.partitionBy("length").orderBy("grp").rowsBetween(Window.unboundedPreceding, -1)
    first, _ = settle(sizes.withColumn("first", F.coalesce(F.sum("n").over(w), F.lit(0))))
    counts = {r["length"]: r["n"] for r in first.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # capacity rows at most
    where = places(plan(counts, capacity))
    keep = [c for c in cuts.columns if c != "grp"]
    inner = Window.partitionBy("length", "grp").orderBy("doc_id", "piece", "start", "ids_crc32")
    numbered = cuts.withColumn("in_grp", F.row_number().over(inner) - 1).join(first.select("length", "grp", "first").hint("merge"), ["length", "grp"])
    numbered = numbered.select(*keep, (F.col("first") + F.col("in_grp")).cast("long").alias("number"))
    schema = numbered.drop("number").schema.add("sequence_id", "long").add("offset", "long")

    def run(batches):
        for b in batches:
            length, number = (b.column(b.schema.get_field_index(c)).to_numpy(zero_copy_only=False) for c in ("length", "number"))
            seq, off = np.zeros(len(length), np.int64), np.zeros(len(length), np.int64)
            order = np.argsort(length, kind="stable")
            for part in np.split(order, np.flatnonzero(np.diff(length[order])) + 1):
                if len(part):
                    rows = where[int(length[part[0]])]
                    k = np.searchsorted(rows[:, 0], number[part], "right") - 1
                    seq[part], off[part] = rows[k, 1] + number[part] - rows[k, 0], rows[k, 2]
            yield pa.RecordBatch.from_arrays([*(b.column(b.schema.get_field_index(c)) for c in keep), pa.array(seq), pa.array(off)], [*keep, "sequence_id", "offset"])

    return numbered.mapInArrow(run, schema)


def pack_documents(docs: DataFrame, vocabulary: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False) -> DataFrame:
    """Tokenize, cut and pack. Extra columns are ignored; repeated rows are packed as often as they occur; a null doc_id is kept as null."""
    return pack(pieces(docs, vocabulary, capacity, end_id, with_ids), capacity)
