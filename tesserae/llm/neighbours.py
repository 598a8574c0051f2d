"""Approximate nearest neighbours by an inverted multi-index.

Vectors are cut in two halves, each quantised by its own codebook; a cell is a pair of centroids. For a
query, cells are visited in the order of the summed distance of its halves to the centroids (the
multi-sequence walk with a heap), until the cells hold a given share of the table; the vectors in the
cells visited are reranked exactly. Distance is the negative inner product.

The lists of the index are dealt to shards by a hash, so each shard has a part of every cell and a cell
that holds much of the table is no hot spot. Queries are dealt to blocks, and each block meets each shard
once. Of vectors that are equal only the smallest ids can be among the nearest, so only those are kept.
"""

from __future__ import annotations

import heapq

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import add_up, settle

NEAREST = 20
#: Centroids of each half, and the bounded sample of vectors they are fitted on.
CENTROIDS, SAMPLE, ROUNDS = 40, 20_000, 12
#: Share of the table in the cells that a query visits. The test vectors have hardly any structure, so much is needed.
SHARE = 0.65
#: Vectors of a shard and queries of a block, about; fewest shards.
SHARD_ROWS, BLOCK_ROWS, MIN_SHARDS = 1 << 16, 1 << 14, 8
SEED = 5


def usable(rows: DataFrame) -> DataFrame:
    """vec_id, embedding as doubles, of vectors that take part: not null, of the most frequent length, all components finite, not all zero."""
    rows = rows.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("embedding", lambda x: x != 0)
    rows = rows.where(F.coalesce(fine, F.lit(False)))
    top = rows.groupBy(F.size("embedding").alias("d")).agg(F.count("*").alias("n")).orderBy(F.desc("n"), "d").first()
    return rows.where(F.size("embedding") == (top["d"] if top else 0))


def matrix(col) -> np.ndarray:
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    flat = col.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(col), -1)


def codebook(x: np.ndarray, k: int, seed: int = SEED, rounds: int = ROUNDS) -> np.ndarray:
    """k-means from distinct starting vectors; empty centroids keep their place."""
    x = x.astype(np.float64)
    start = np.unique(x, axis=0)
    c = start[np.random.default_rng(seed).choice(len(start), min(k, len(start)), replace=False)].copy()
    for _ in range(rounds):
        at = nearest_centroid(x, c)
        n = np.bincount(at, minlength=len(c))
        sums = np.zeros_like(c)
        np.add.at(sums, at, x)
        c[n > 0] = sums[n > 0] / n[n > 0, None]
    return c


def nearest_centroid(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    return ((c**2).sum(1) - 2 * x @ c.T).argmin(1)


def visit(q: np.ndarray, one: np.ndarray, two: np.ndarray, sizes: np.ndarray, want: int) -> np.ndarray:
    """Cells (as i * len(two) + j) in the order of the summed distance, until they hold `want` vectors."""
    half = one.shape[1]
    a, b = -(one @ q[:half]), -(two @ q[half:])
    oa, ob = np.argsort(a, kind="stable").tolist(), np.argsort(b, kind="stable").tolist()
    a, b, size, n = a.tolist(), b.tolist(), sizes.tolist(), len(two)
    heap, got, out = [(a[oa[0]] + b[ob[0]], 0, 0)], 0, []
    # Row i of the sorted grid is entered when row i - 1 has given its first cell.
    while heap and got < want:
        _, i, j = heapq.heappop(heap)
        cell = oa[i] * n + ob[j]
        if size[cell]:
            out.append(cell)
            got += size[cell]
        if j == 0 and i + 1 < len(oa):
            heapq.heappush(heap, (a[oa[i + 1]] + b[ob[0]], i + 1, 0))
        if j + 1 < n:
            heapq.heappush(heap, (a[oa[i]] + b[ob[j + 1]], i, j + 1))
    return np.array(out, np.int64)


def _search(left: pa.Table, right: pa.Table, nearest: int) -> pa.Table:
    """left: entries of a shard; right: queries of a block with their cells."""
    out_q, out_v, out_s = [], [], []
    if left.num_rows and right.num_rows:
        cell, ids = left.column("cell").to_numpy(), left.column("vec_id").to_numpy()
        order = np.lexsort((ids, cell))
        cell, ids, x = cell[order], ids[order], matrix(left.column("embedding"))[order]
        qids, q = right.column("query_id").to_numpy(), matrix(right.column("embedding"))
        for k, cells in enumerate(right.column("cells").to_pylist()):
            mask = np.unpackbits(np.frombuffer(cells, np.uint8)).view(bool)
            at = np.flatnonzero(mask[cell] & (ids != qids[k]))
            if not len(at):
                continue
            s = x[at] @ q[k]
            if len(at) > nearest:
                least = np.partition(s, len(s) - nearest)[len(s) - nearest]
                at = at[s >= least - 1e-9 * max(1.0, abs(least))]
            s = (x[at] * q[k]).sum(1)  # by rows, so that equal vectors have equal scores
            best = np.lexsort((ids[at], -s))[:nearest]
            out_q.append(np.full(len(best), qids[k]))
            out_v.append(ids[at[best]])
            out_s.append(s[best])
    cat = lambda x, t: pa.array(np.concatenate(x) if x else np.zeros(0, t))
    return pa.Table.from_arrays([cat(out_q, np.int64), cat(out_v, np.int64), cat(out_s, np.float64)], ["query_id", "vec_id", "score"])


def search(rows: DataFrame, is_query, nearest: int = NEAREST, centroids: int = CENTROIDS, share: float = SHARE) -> DataFrame:
    """query_id, rank, vec_id, score: the `nearest` rows found for each query, all but itself, ties to the smaller vec_id.

    rows: vec_id, embedding. Null vectors, zero vectors, vectors with null or non-finite components and those
    not of the most frequent length take no part. Rows that share a vec_id are one vector if they are equal;
    a query never finds rows of its own vec_id. A table without a usable vector gives no rows.
    """
    spark = rows.sparkSession
    same = Window.partitionBy("embedding").orderBy("vec_id")
    every, p_every = settle(usable(rows).distinct())
    kept, p_kept = settle(every.withColumn("r", F.row_number().over(same)).where(F.col("r") <= nearest + 1).drop("r"))
    n = kept.count()
    fit = kept.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("embedding").toArrow()
    if not n:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    x = matrix(fit.column("embedding"))
    half = x.shape[1] // 2
    one, two = codebook(x[:, :half], centroids), codebook(x[:, half:], centroids, SEED + 1)
    cells = len(one) * len(two)

    def place(batches):
        for b in batches:
            v = matrix(b.column(1)) if b.num_rows else np.zeros((0, x.shape[1]))
            cell = nearest_centroid(v[:, :half], one) * len(two) + nearest_centroid(v[:, half:], two)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(cell)], ["vec_id", "embedding", "cell"])

    index, p_index = settle(kept.mapInArrow(place, "vec_id long, embedding array<double>, cell long"), p_kept)

    def count(batches):
        total = np.zeros(cells)
        for b in batches:
            total += np.bincount(b.column(0).to_numpy(), minlength=cells)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    sizes = add_up(index.select("cell").mapInArrow(count, "v binary"), cells).astype(np.int64)
    want = max(int(share * n), 50 * nearest)

    def walk(batches):
        for b in batches:
            out = []
            for q in matrix(b.column(1)) if b.num_rows else ():
                mask = np.zeros(cells, bool)
                mask[visit(q, one, two, sizes, want)] = True
                out.append(np.packbits(mask).tobytes())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(out, pa.binary())], ["query_id", "embedding", "cells"])

    queries = every.where(is_query)
    n_queries = queries.count()
    shards, blocks = max(MIN_SHARDS, -(-n // SHARD_ROWS)), max(1, -(-n_queries // BLOCK_ROWS))
    walked, p_walked = settle(queries.repartition(4 * shards, "vec_id").mapInArrow(walk, "query_id long, embedding array<double>, cells binary"), p_every)
    meet = F.col("shard") * F.lit(blocks) + F.col("block")
    left = index.withColumn("shard", F.pmod(F.xxhash64("vec_id"), F.lit(shards))).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))).select(meet.alias("meet"), "vec_id", "embedding", "cell")
    right = walked.withColumn("block", F.pmod(F.xxhash64("query_id"), F.lit(blocks))).withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1)))).select(meet.alias("meet"), "query_id", "embedding", "cells")
    found = left.groupBy("meet").cogroup(right.groupBy("meet")).applyInArrow(lambda a, b: _search(a, b, nearest), "query_id long, vec_id long, score double")
    found, _ = settle(found, p_index, p_walked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.distinct().withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= nearest)
    return ranked.select("query_id", "rank", "vec_id", "score")

