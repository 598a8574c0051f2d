"""Exact top-k search by inner product on a bit-sliced index.

The index of a shard holds, for each dimension, the bits of the quantised entries as bitmaps over the shard's rows
(the entry less the dimension's smallest). A query's scores are made for all rows of the shard at once: the
slices of a dimension are added as often, and at the places, as the bits of the query's entry say, by carry-save
adders of bitmap operations; for a negative entry the complement of the slices is added, which differs by a
constant. The top rows are then selected from the most significant slice of the scores downward. Rows that tie at
the boundary are bits of one bitmap, in the order of vec_id, of which the first are taken.

Rows are dealt to shards and queries to blocks by a hash, and each block meets each shard once; a block has so many
queries that there are a few tasks for each partition. Every query against all rows is what is asked for, so the
work grows with their product.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import partitions, settle

NEAREST, SCALE = 20, 64
#: Rows of a shard, about (a bitmap of 8 KB), and most queries of a block.
SHARD_ROWS, BLOCK_ROWS = 1 << 16, 1 << 14


def quantised(rows: DataFrame, scale: int = SCALE) -> DataFrame:
    """vec_id, x (array of long), one row for each vec_id.

    Null vec_ids, null vectors and those with null or non-finite entries take no part. Of different vectors under one
    vec_id the smallest stays. Integers beyond a long become the nearest long.
    """
    rows = rows.where("vec_id is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf")))
    x = rows.where(F.coalesce(fine, F.lit(False))).select("vec_id", F.transform("embedding", lambda c: F.floor(c * scale)).alias("x"))
    return x.groupBy("vec_id").agg(F.min("x").alias("x"))


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """Vectors as rows; shorter ones are followed by zeros."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    sizes = col.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(col), int(sizes.max(initial=0))), np.int64)
    out[np.arange(out.shape[1]) < sizes[:, None]] = col.flatten().to_numpy(zero_copy_only=False)
    return out


def bitmap(bits: np.ndarray) -> np.ndarray:
    """Booleans as bits of 64-bit words, the first in the lowest bit."""
    packed = np.packbits(bits, bitorder="little")
    return np.pad(packed, (0, -len(packed) % 8)).view(np.uint64)


def positions(words: np.ndarray) -> np.ndarray:
    """Where the bits of a bitmap are set, ascending."""
    at = np.flatnonzero(words)
    bits = np.unpackbits(words[at].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    row, bit = np.nonzero(bits)
    return at[row] * 64 + bit


def count(words: np.ndarray) -> int:
    return int(np.bitwise_count(words).sum())


class Index:
    """Bit slices of a shard's vectors. ids ascend; slices[d] are those of x[:, d] - low[d], least significant first."""

    def __init__(self, ids: np.ndarray, low: list[int], slices: list[list[np.ndarray]]) -> None:
        self.ids, self.low, self.slices = ids, low, slices
        self.words = -(-len(ids) // 64)
        self.every = bitmap(np.ones(len(ids), bool))
        self.complements = [[~s for s in per] for per in slices]
        self.spare: list[np.ndarray] = []

    @classmethod
    def build(cls, ids: np.ndarray, x: np.ndarray) -> Index:
        order = np.argsort(ids, kind="stable")
        x, low, slices = x[order], [int(v) for v in x.min(axis=0)], []
        for d, least in enumerate(low):
            up = x[:, d].view(np.uint64) - np.uint64(least % (1 << 64))  # modulo 2 ** 64, and so right
            slices.append([bitmap((up >> np.uint64(b)) & np.uint64(1) != 0) for b in range(int(up.max()).bit_length())])
        return cls(ids[order], low, slices)

    def packed(self) -> tuple[bytes, list[int], list[int], bytes]:
        return self.ids.tobytes(), self.low, [len(per) for per in self.slices], b"".join(s.tobytes() for per in self.slices for s in per)

    @classmethod
    def unpacked(cls, ids: bytes, low: list[int], widths: list[int], words: bytes) -> Index:
        n = np.frombuffer(ids, np.int64)
        rows = iter(np.frombuffer(words, np.uint64).reshape(sum(widths), -(-len(n) // 64)))
        return cls(n, low, [[next(rows) for _ in range(w)] for w in widths])

    def add(self, q: list[int]) -> tuple[list[tuple[np.ndarray, bool]], int]:
        """Slices of the scores, least significant first, each with whether it was made here, and what has to be added to each score."""
        columns: dict[int, list[tuple[np.ndarray, bool]]] = {}
        constant = 0
        for v, low, per, inverse in zip(q, self.low, self.slices, self.complements):
            constant += v * low + (v * ((1 << len(per)) - 1) if v < 0 else 0)
            for a in range(abs(v).bit_length()):
                if abs(v) >> a & 1:
                    for b, s in enumerate(per if v > 0 else inverse, a):
                        columns.setdefault(b, []).append((s, False))
        out: list[tuple[np.ndarray, bool]] = []
        u = np.empty(self.words, np.uint64)
        xor, both, either, spare = np.bitwise_xor, np.bitwise_and, np.bitwise_or, self.spare
        while columns:
            column = columns.pop(len(out), [])
            carries = columns.setdefault(len(out) + 1, []) if len(column) > 1 else []
            while len(column) > 1:
                used = [column.pop() for _ in range(min(3, len(column)))]
                a, b = used[0][0], used[1][0]
                total, carry = (spare.pop() if spare else np.empty(self.words, np.uint64) for _ in range(2))
                if len(used) == 3:
                    c = used[2][0]
                    xor(a, b, u)
                    both(a, b, carry)
                    xor(u, c, total)
                    both(u, c, u)
                    either(carry, u, carry)
                else:
                    xor(a, b, total)
                    both(a, b, carry)
                spare += [s for s, made in used if made]
                column.append((total, True))
                carries.append((carry, True))
            out.append(column[0] if column else (np.zeros(self.words, np.uint64), True))
        return out, constant

    def top(self, q: list[int], own: int, k: int) -> tuple[np.ndarray, list[int]]:
        """Ids and scores of the k rows of highest score but the row own, in no order; ties go to the smaller id."""
        scores, constant = self.add(q)
        left = self.every.copy()
        at = int(np.searchsorted(self.ids, own))
        if at < len(self.ids) and self.ids[at] == own:
            left[at // 64] &= ~np.uint64(1 << at % 64)
        sure, n = np.zeros(self.words, np.uint64), 0
        for s, _ in reversed(scores):
            ones = left & s
            more = count(ones)
            if n + more > k:
                left = ones
            else:
                sure |= ones
                n += more
                left &= ~s
        rows = np.concatenate([positions(sure), positions(left)[: k - n]])
        found = [constant] * len(rows)
        for w, (s, made) in enumerate(scores):
            for i in np.flatnonzero(s[rows // 64] >> (rows % 64).astype(np.uint64) & np.uint64(1)).tolist():
                found[i] += 1 << w
            if made:
                self.spare.append(s)
        return self.ids[rows], found

    def fits(self, q: list[int]) -> bool:
        """Whether every score surely fits a long."""
        return sum(abs(v) * max(abs(low), abs(low + (1 << len(per)))) for v, low, per in zip(q, self.low, self.slices)) < 1 << 63


def clipped(v: int) -> int:
    return max(-(1 << 63), min((1 << 63) - 1, v))


def _search(index: pa.Table, queries: pa.Table, k: int) -> pa.Table:
    """The k best rows of one shard for each query of a block."""
    out_q, out_v, out_s = [], [], []
    for row in index.to_pylist() if queries.num_rows else ():
        shard = Index.unpacked(row["ids"], row["low"], row["widths"], row["words"])
        for own, x in zip(queries.column("query_id").to_pylist(), queries.column("x").to_pylist()):
            # All rows of a score beyond a long tie, so all of them have to be seen.
            ids, found = shard.top(x, own, k if shard.fits(x) else len(shard.ids))
            best = sorted(zip((-clipped(s) for s in found), ids.tolist()))[:k]
            out_q += [own] * len(best)
            out_v += [v for _, v in best]
            out_s += [-s for s, _ in best]
    return pa.table({"query_id": pa.array(out_q, pa.int64()), "vec_id": pa.array(out_v, pa.int64()), "score": pa.array(out_s, pa.int64())})


def build(x: DataFrame, shards: int) -> DataFrame:
    """A row for each shard of (vec_id, x): its ids, the dimensions' smallest entries, their numbers of slices, and the slices."""

    def one(t: pa.Table) -> pa.Table:
        ids, low, widths, words = Index.build(t.column("vec_id").to_numpy(), matrix(t.column("x"))).packed()
        return pa.table({"shard": t.column("shard")[:1], "ids": [ids], "low": pa.array([low], pa.list_(pa.int64())), "widths": pa.array([widths], pa.list_(pa.int32())), "words": [words]})

    dealt = x.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards)).cast("int"))
    return dealt.groupBy("shard").applyInArrow(one, "shard int, ids binary, low array<long>, widths array<int>, words binary")


def search(rows: DataFrame, is_query: Column, nearest: int = NEAREST, scale: int = SCALE) -> DataFrame:
    """query_id, rank, vec_id, score: for each query the `nearest` rows of highest integer inner product but itself, ties to the smaller vec_id.

    rows: vec_id, embedding; see `quantised` for those that take no part. Vectors of unequal length are multiplied
    as if the shorter were followed by zeros. Scores beyond a long become the nearest long. Fewer candidates than
    `nearest` are all returned, no query or candidate gives no rows.
    """
    spark = rows.sparkSession
    x, p_x = settle(quantised(rows, scale))
    n, n_queries, d = x.agg(F.count("*"), F.count_if(is_query), F.max(F.size("x"))).first()
    shards = max(1, -(-n // max(64, min(SHARD_ROWS, (1 << 23) // max(1, d or 0)))))
    blocks = max(1, -(-n_queries // BLOCK_ROWS), min(-(-n_queries // 64), -(-2 * partitions(spark) // shards)))
    index, p_index = settle(build(x, shards))
    each = lambda m: F.explode(F.sequence(F.lit(0), F.lit(m - 1)))
    left = index.withColumn("block", each(blocks))
    right = x.where(is_query).select(F.col("vec_id").alias("query_id"), "x", F.pmod(F.xxhash64("vec_id", F.lit(1)), F.lit(blocks)).cast("int").alias("block"), each(shards).alias("shard"))
    met = left.groupBy("shard", "block").cogroup(right.groupBy("shard", "block"))
    found, _ = settle(met.applyInArrow(lambda a, b: _search(a, b, nearest), "query_id long, vec_id long, score long"), p_x, p_index)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")
