"""Merkle manifest of a dataset: a leaf for each row, a tree for each source, a tree over the sources, and proofs.

Rows are sorted by Spark over all partitions, and each is told its place in its tree by sums over partitions, so a
source with much of the table is spread like the others. Aligned blocks of BLOCK nodes are then worked on apart:
first each block's node is made (treehash: what waits is under FAN nodes a level), the blocks' nodes being the rows
of the next, far smaller round; then, from the top down, each block is walked leaf by leaf, with a stack for each
level that builds the next run of siblings while the present one is in use, and the block's shared upper path is
appended. No task holds more than a block, the driver holds two numbers.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import partitions, remove, settle

#: Nodes of a run, and levels of a block.
FAN, LEVELS = 16, 3
DIGEST = 64
PATH = "array<struct<left: string, right: string>>"
UPPER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
FIELDS = ("doc_id", "source", "lang", "n_chars", "text")


def digest_of(fields: Sequence[Column]) -> Column:
    """Sha256 (lowercase hex) of fields, each `-` if null, else byte count, colon, value."""
    texts = [f.cast("string") for f in fields]
    return F.sha2(F.concat(*(F.coalesce(F.concat(F.octet_length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts)), 256)


def tampered(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string")) % 5 == 0, F.lit(False))


def leaves_of(docs: DataFrame) -> DataFrame:
    """tree (a name of the source that sorts like it, null first), doc_id, digest, and changed: the leaf of the tampered row, null where nothing is tampered with."""
    f = [F.col(c) for c in FIELDS]
    lower = [*f[:-1], F.translate(f[-1].cast("string"), UPPER, UPPER.lower())]
    tree = F.coalesce(F.concat(F.lit("="), F.col("source").cast("string")), F.lit("-"))
    return docs.select(tree.alias("tree"), F.col("doc_id").cast("long").alias("doc_id"), digest_of(f).alias("digest"), F.when(tampered(F.col("doc_id")), digest_of(lower)).alias("changed"))


def placed(nodes: DataFrame, order: Sequence[str]) -> tuple[DataFrame, str]:
    """Adds pos, the place of a node in its tree by the given order, and total, the tree's nodes. Written to a scratch table.

    Sorted by ranges of tree and order, so a tree may span partitions; a place is that in the partition plus the
    tree's nodes in earlier ones.
    """
    by = ["tree", *order]
    number = F.monotonically_increasing_id()  # of sorted rows: partition << 33, then their place in it
    ranged = nodes.repartitionByRange(partitions(nodes.sparkSession), *by).sortWithinPartitions(*by).withColumn("_n", number)
    rows, path = settle(ranged.select("*", F.shiftright("_n", 33).alias("_part")))
    each = rows.groupBy("tree", "_part").agg(F.min("_n").alias("_first"), F.count("*").alias("_rows"))
    tree = Window.partitionBy("tree")
    before = tree.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    each = each.select("tree", "_part", (F.coalesce(F.sum("_rows").over(before), F.lit(0)) - F.col("_first")).alias("_add"), F.sum("_rows").over(tree).alias("total"))
    return settle(rows.join(each, ["tree", "_part"]).withColumn("pos", F.col("_n") + F.col("_add")).drop("_n", "_part", "_add"), path)


def node_of(run: Sequence[str]) -> str:
    return hashlib.sha256("".join(run).encode()).hexdigest()


class Treehash:
    """Nodes of one level, made leaf by leaf; below it at most FAN - 1 nodes wait at each level."""

    def __init__(self, level: int) -> None:
        self.waiting: list[list[str]] = [[] for _ in range(level)]
        self.nodes: list[str] = []

    def push(self, node: str) -> None:
        for w in self.waiting:
            w.append(node)
            if len(w) < FAN:
                return
            node = node_of(w)
            w.clear()
        self.nodes.append(node)

    def close(self) -> None:
        """No more leaves: runs that are not full become nodes."""
        for w, up in zip(self.waiting, [*self.waiting[1:], self.nodes]):
            if w:
                up.append(node_of(w))
                w.clear()


def height(total: int, levels: int) -> int:
    """Levels that a block climbs: all, or in a tree of one block as many as leave one node."""
    h = 0
    while h < levels and total > 1:
        h, total = h + 1, -(-total // FAN)
    return h


def block_node(leaves: Sequence[str], levels: int) -> str:
    top = Treehash(levels)
    for leaf in leaves:
        top.push(leaf)
    top.close()
    return top.nodes[0]


def traverse(leaves: Sequence[str], levels: int) -> Iterator[list[tuple[str, str]]]:
    """For each leaf of a block its siblings to the left and right as text, level by level.

    While a run of siblings is in use, the treehash of its level takes one leaf of the following run for each leaf
    passed, so that run is there when it is needed. Besides the leaves, memory is a run and a stack for each level.
    """
    n = len(leaves)
    ahead, taken = [Treehash(k) for k in range(levels)], [0] * levels
    runs, pair = [""] * levels, [("", "")] * levels

    def advance(k: int, upto: int) -> None:
        while taken[k] < min(upto, n):
            ahead[k].push(leaves[taken[k]])
            taken[k] += 1
            if taken[k] == n:
                ahead[k].close()

    for p in range(n):
        size = 1
        for k in range(levels):
            if p % (size * FAN) == 0:
                advance(k, p + size * FAN)  # does something for the first run only
                runs[k], ahead[k] = "".join(ahead[k].nodes), Treehash(k)
            advance(k, taken[k] + 1)
            if p % size == 0:
                at = p // size % FAN * DIGEST
                pair[k] = (runs[k][:at], runs[k][at + DIGEST :])
            size *= FAN
        yield list(pair)


def climb(nodes: DataFrame, levels: int) -> DataFrame:
    """The nodes of blocks, as rows of the next round."""
    size = FAN**levels

    def one(block: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        first, total = block.column("pos")[0].as_py(), block.column("total")[0].as_py()
        made = block_node(block.column("digest").to_pylist(), height(total, levels))
        return pa.table({"tree": block.column("tree")[:1], "pos": pa.array([first // size]), "total": pa.array([-(-total // size)]), "digest": pa.array([made])})

    keyed = nodes.select("tree", "pos", "total", "digest", F.floor(F.col("pos") / size).alias("block"))
    return keyed.groupBy("tree", "block").applyInArrow(one, "tree string, pos long, total long, digest string")


def descend(nodes: DataFrame, upper: DataFrame, levels: int, carry: Sequence[str]) -> DataFrame:
    """Columns carry of the nodes, the further columns of upper, and path: siblings up to the root.

    upper: tree, block, path and further columns, a row for each block of nodes.
    """
    size = FAN**levels
    more = [c for c in upper.columns if c not in ("tree", "block", "path")]
    kinds = dict(nodes.dtypes) | dict(upper.dtypes)
    schema = ", ".join([*(f"`{c}` {kinds[c]}" for c in (*carry, *more)), f"path {PATH}"])
    pairs = pa.struct([("left", pa.string()), ("right", pa.string())])

    def one(block: pa.Table, above: pa.Table) -> pa.Table:
        block = block.sort_by("pos")
        n, h = block.num_rows, height(block.column("total")[0].as_py(), levels) if block.num_rows else 0
        shared = [(s["left"], s["right"]) for s in above.column("path")[0].as_py()] if above.num_rows else []
        left, right = [], []
        for path in traverse(block.column("digest").to_pylist(), h):
            for a, b in (*path, *shared):
                left.append(a)
                right.append(b)
        offsets = pa.array(range(0, (n + 1) * (h + len(shared)), h + len(shared)) if h + len(shared) else [0] * (n + 1), pa.int32())
        path = pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(left, pa.string()), pa.array(right, pa.string())], fields=list(pairs)))
        return pa.table({**{c: block.column(c) for c in carry}, **{c: pa.repeat(above.column(c)[0], n) for c in more}, "path": path})

    keyed = nodes.select(*dict.fromkeys(("tree", "pos", "total", "digest", *carry)), F.floor(F.col("pos") / size).alias("block"))
    return keyed.groupBy("tree", "block").cogroup(upper.groupBy("tree", "block")).applyInArrow(one, schema)


class Forest:
    """Rounds of nodes of trees, from leaves (tree, pos, total, digest, ...) to a root for each tree."""

    def __init__(self, leaves: DataFrame, levels: int) -> None:
        self.levels, self.rounds, self.paths = levels, [leaves], []
        most = leaves.agg(F.max("total")).first()[0] or 0
        while True:
            made, path = settle(climb(self.rounds[-1], levels))
            self.rounds.append(made)
            self.paths.append(path)
            most = -(-most // FAN**levels)
            if most <= 1:
                break

    @property
    def roots(self) -> DataFrame:
        return self.rounds[-1].select("tree", "digest")

    def proofs(self, upper: DataFrame, carry: Sequence[str]) -> DataFrame:
        """A path for each leaf. upper: tree, path from the tree's root on, and further columns."""
        spark = upper.sparkSession
        upper, path = settle(upper.withColumn("block", F.lit(0).cast("long")))
        for nodes in self.rounds[-2:0:-1]:
            below, new = settle(descend(nodes, upper, self.levels, ["tree", "pos"]).withColumnRenamed("pos", "block"), path)
            upper, path = below, new
        for p in self.paths:
            remove(spark, p)
        return descend(self.rounds[0], upper, self.levels, carry)


def proofs(docs: DataFrame, levels: int = LEVELS) -> DataFrame:
    """doc_id, leaf, changed, subroot, root, path of every row of docs (doc_id, source, lang, n_chars, text).

    Leaves of a source ascend by doc_id, a null one first, and rows of one doc_id by leaf. An empty table gives no
    rows. Other columns play no part. path: (left, right) texts of siblings from the leaf's level to the root's,
    empty where a run is of one node.
    """
    spark = docs.sparkSession
    leaves, path = settle(leaves_of(docs))
    nodes, _ = placed(leaves, ["doc_id", "digest", "changed"])
    remove(spark, path)
    trees = Forest(nodes, levels)
    subroots, p_subroots = placed(trees.roots.select(F.lit("").alias("tree"), F.col("tree").alias("name"), "digest"), ["name"])
    top = Forest(subroots, levels)
    above = top.roots.select("tree", F.expr(f"cast(array() as {PATH})").alias("path"), F.col("digest").alias("root"))
    upper, p_upper = settle(top.proofs(above, ["name", "digest"]).select(F.col("name").alias("tree"), "path", F.col("digest").alias("subroot"), "root"), p_subroots)
    out = trees.proofs(upper, ["doc_id", "digest", "changed"])
    remove(spark, p_upper)
    return out.select("doc_id", F.col("digest").alias("leaf"), "changed", "subroot", "root", "path")


def verified(proofs: DataFrame) -> DataFrame:
    """The proofs' digest, and the root recomputed from the changed leaf, else the leaf, and the siblings."""
    siblings = F.sha2(F.array_join(F.transform("path", lambda s: F.concat(s["left"], s["right"])), ""), 256)
    folded = F.aggregate("path", F.coalesce("changed", "leaf"), lambda at, s: F.sha2(F.concat(s["left"], at, s["right"]), 256))
    rows = proofs.select("doc_id", "leaf", "subroot", "root", siblings.alias("proof_sha256"), folded.alias("folded_root"))
    return rows.withColumn("verified", F.col("folded_root") == F.col("root"))
