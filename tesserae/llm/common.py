"""Plumbing shared by the text operators: scratch tables, chunked Arrow input, hash exchanges and components.

Nothing here keeps state on executors: every stage either is recomputed from its lineage or
reread from a table in the shared checkpoint folder, so a lost executor costs only its tasks.
"""

from __future__ import annotations

import contextlib
import gc
import tempfile
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Hash buckets of an exchange for each of its partitions; a task holds one bucket at a time.
BUCKETS_PER_PARTITION = 4
#: Bytes of text, and rows, that a task gathers before it sends what it found.
CHUNK_BYTES, CHUNK_ROWS = 24 << 20, 4096


def scratch_root(spark: SparkSession) -> str:
    """The shared folder the cluster names; in local mode without one, a temporary folder."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if spark.sparkContext.master.startswith("local["):
            root = tempfile.mkdtemp(prefix="tesserae-")
            spark.conf.set("spark.checkpoint.dir", root)
        else:
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    return root.rstrip("/")


def settle(df: DataFrame, *drop: str, tidied: bool = True) -> tuple[DataFrame, str]:
    """Write df to a table in the shared folder and reread it: cuts the lineage, and survives executors.

    drop: paths of earlier tables that nothing needs any more. Also lets Spark remove the shuffle
    files behind df, which nothing can read again. tidied: also those of queries that only the garbage collector
    knows to be finished; not worth its time in rounds over small tables.
    """
    spark = df.sparkSession
    path = f"{scratch_root(spark)}/tesserae-{uuid.uuid4().hex}"
    with shuffles_removed(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    for p in drop:
        remove(spark, p)
    del df
    if tidied:
        tidy(spark)
    return out, path


@contextlib.contextmanager
def shuffles_removed(spark: SparkSession) -> Iterator[None]:
    """Queries run meanwhile remove their shuffle files when they end."""
    cleanup = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(cleanup, None)
    spark.conf.set(cleanup, "true")
    try:
        yield
    finally:
        spark.conf.unset(cleanup) if before is None else spark.conf.set(cleanup, before)


def tidy(spark: SparkSession) -> None:
    """Let go of shuffle files of finished queries."""
    gc.collect()
    spark.sparkContext._jvm.System.gc()


def remove(spark: SparkSession, path: str) -> None:
    jvm, conf = spark.sparkContext._jvm, spark.sparkContext._jsc.hadoopConfiguration()
    p = jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(conf).delete(p, True)


def partitions(spark: SparkSession) -> int:
    return max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))


def flat(col: pa.Array | pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all strings behind one another, and where each begins (one more than strings). Null: empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = pc.fill_null(col.cast(pa.large_binary()), b"")
    _, offsets, data = col.buffers()
    off = np.frombuffer(offsets, np.int64)[col.offset : col.offset + len(col) + 1] if len(col) else np.zeros(1, np.int64)
    if data is None or off[-1] == off[0]:
        return np.zeros(0, np.uint8), off - off[0]
    return np.frombuffer(data, np.uint8)[off[0] : off[-1]], off - off[0]


def longs(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """int64 values of a column without nulls."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    return col.cast(pa.int64()).to_numpy(zero_copy_only=False)


def chunked(batches: Iterator[pa.RecordBatch], budget: int = CHUNK_BYTES, most_rows: int = CHUNK_ROWS) -> Iterator[pa.Table]:
    """Joins small batches, and cuts large ones between rows, to tables of about budget bytes and of at most 2 * most_rows rows."""
    held: list[pa.RecordBatch] = []
    size = rows = 0
    for b in batches:
        if not b.num_rows:
            continue
        step = max(1, min(b.num_rows, most_rows, int(b.num_rows * budget / max(1, b.nbytes))))
        for i in range(0, b.num_rows, step):
            part = b.slice(i, step)
            held.append(part)
            size, rows = size + part.nbytes, rows + part.num_rows
            if size >= budget or rows >= most_rows:
                yield pa.Table.from_batches(held)
                held, size, rows = [], 0, 0
    if held:
        yield pa.Table.from_batches(held)


def bucketed(keys: np.ndarray, n: int) -> Iterator[tuple[int, np.ndarray]]:
    """Of uint64 keys: the positions that go to each of n buckets; spread by the keys' upper bits."""
    at = ((keys >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)
    order = np.argsort(at, kind="stable")
    at = at[order]
    cuts = np.flatnonzero(np.diff(at)) + 1
    for part in np.split(order, cuts):
        if len(part):
            yield int(((keys[part[0]] >> np.uint64(32)) * np.uint64(n)) >> np.uint64(32)), part


def exchange(df: DataFrame, n_partitions: int) -> DataFrame:
    """Deals rows by their column bucket, evenly; each partition then holds its buckets one after another."""
    return df.repartitionById(n_partitions, F.pmod(F.col("bucket"), F.lit(n_partitions)).cast("int")).sortWithinPartitions("bucket")


def by_bucket(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """Of rows sorted by bucket: a table for each bucket. Only one bucket is held at a time."""
    held: list[pa.RecordBatch] = []
    now = None
    for b in batches:
        if not b.num_rows:
            continue
        ids = longs(b.column(b.schema.get_field_index("bucket")))
        cuts = [0, *(np.flatnonzero(np.diff(ids)) + 1).tolist(), len(ids)]
        for i, j in zip(cuts, cuts[1:]):
            if now is not None and ids[i] != now:
                yield pa.Table.from_batches(held)
                held = []
            now = ids[i]
            held.append(b.slice(i, j - i))
    if held:
        yield pa.Table.from_batches(held)


def joined(col: pa.ChunkedArray, kind) -> np.ndarray:
    """Binary values as one array of the given number type."""
    return np.frombuffer(b"".join(x for x in col.to_pylist() if x), kind)


def add_up(df: DataFrame, n: int, ways: int = 32) -> np.ndarray:
    """Sum of float64 vectors of length n in the binary column v.

    Two steps, so that the driver gets at most `ways` vectors however many tasks made one.
    """

    def total(batches):
        out = None
        for b in batches:
            for x in b.column(0).to_pylist():
                v = np.frombuffer(x, np.float64)
                out = v.copy() if out is None else out + v
        if out is not None:
            yield pa.RecordBatch.from_arrays([pa.array([out.tobytes()], pa.binary())], ["v"])

    with shuffles_removed(df.sparkSession):
        rows = df.select("v").repartition(ways).mapInArrow(total, "v binary").collect()
    return sum((np.frombuffer(r.v, np.float64) for r in rows), np.zeros(n))


def components(edges: DataFrame, max_rounds: int = 60) -> DataFrame:
    """(node, root) for every node of the undirected edges (u, v): root is the smallest node reachable.

    Min-label spreading with pointer jumping. Each round takes for every node the smallest label
    among its neighbours, then that label's own label, so long chains take a logarithmic number of
    rounds in practice. All state stays in tables; the driver sees one count a round. Edges of a hot
    node are summed up before the shuffle (min), and the joins are of kinds that AQE can split.
    """
    spark = edges.sparkSession
    both, p_edges = settle(edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).where("u <> v").distinct())
    labels, p_labels = settle(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("root")))
    for _ in range(max_rounds):
        near = both.join(labels.select(F.col("node").alias("v"), "root"), "v").groupBy("u").agg(F.min("root").alias("m"))
        step = labels.join(near, labels.node == near.u, "left").select("node", F.col("root").alias("was"), F.least("root", F.coalesce("m", "root")).alias("root"))
        step, p_step = settle(step)
        jump = step.select(F.col("node").alias("root"), F.col("root").alias("next"))
        new, p_new = settle(step.join(jump, "root", "left").select("node", "was", F.least("root", F.coalesce("next", "root")).alias("root")), p_step, p_labels)
        changed = new.where("root <> was").limit(1).count()
        labels, p_labels = new.select("node", "root"), p_new
        if not changed:
            remove(spark, p_edges)
            return labels
    raise RuntimeError(f"components did not settle in {max_rounds} rounds")
