"""Near-duplicates by the exact Jaccard similarity of sets of five-word shingles.

Of two sets with a similarity of 0.8 or more, each has at least 0.8 of its shingles in common with the other. So if
shingles are put in one order for all sets, the first n - ceil(0.8 n) + 1 of a set of n hold one that is among the
first of the other set too (prefix filtering). Rare shingles come first: passages that many texts share come last,
and are looked up only by texts that consist of little else. How rare a shingle is, is counted over all texts in a
bounded table of hash buckets; any order gives whole results.

Sets that meet under a shingle are candidates if their sizes, what is left of them from that shingle on and 64
parity bits of each allow the similarity; candidates are compared exactly. First each set is
compared with one that it meets under its most common shingle; then, where a shingle joins sets of several
components, with its first and last one; only sets that are still apart are then compared with each other, so that
a group of near copies does not yield its pairs. Of these few, 1024 parity bits are taken: sets that differ in some
dozens of shingles differ in nearly as many bits, so what passes is hardly more than what is similar.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import add_up, by_bucket, chunked, components, exchange, longs, partitions, remove, settle

WIDTH = 5
#: Similarity from which documents are copies, as a fraction.
SHARED, OF = 4, 5
#: Hash buckets in which shingles are counted.
COUNTS = 1 << 18
#: Longs of parity bits by which sets that are still apart after two rounds are told from each other.
WIDE = 16
_MIX = np.uint64(0x9E3779B97F4A7C15)


def shingle_set(text: str | None, width: int = WIDTH) -> np.ndarray:
    """Ascending 64-bit hashes of the distinct word shingles; a text of fewer words is one shingle, none without words."""
    words = (text or "").encode().lower().split()
    if len(words) <= width:
        return np.array([xxhash.xxh64_intdigest(b" ".join(words))] if words else [], np.uint64)
    one = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    n, out = len(words) - width + 1, np.zeros(len(words) - width + 1, np.uint64)
    for k in range(width):
        out = (out ^ one[k : k + n]) * _MIX
        out ^= out >> np.uint64(29)
    return np.unique(out)


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    """Jaccard similarity of 0.8 or more, in whole numbers. Two empty sets are alike."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return OF * both >= SHARED * (len(a) + len(b) - both)


def whole(hashes: np.ndarray) -> int:
    """Name of a set as a signed long; 0 for the empty one."""
    return xxhash.xxh64_intdigest(hashes.tobytes()) - (1 << 63) if len(hashes) else 0


def prefix(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The rarest shingles of a set, of which a similar set has one among its own."""
    n = len(hashes)
    return hashes[np.lexsort((hashes, counts[(hashes >> np.uint64(40)) % np.uint64(len(counts))]))[: n - -(-SHARED * n // OF) + 1]] if n else hashes


def parity(hashes: np.ndarray) -> int:
    """64 bits, each the parity of the shingles that fall on it: two sets differ in at least as many shingles as these differ in bits."""
    return int(np.bitwise_xor.reduce(np.uint64(1) << (hashes & np.uint64(63)), initial=np.uint64(0)).view(np.int64))


def parities(hashes: np.ndarray, longs_: int = WIDE) -> np.ndarray:
    """Like parity, with 64 * longs_ bits (a power of two)."""
    out = np.zeros(longs_, np.uint64)
    np.bitwise_xor.at(out, ((hashes >> np.uint64(6)) & np.uint64(longs_ - 1)).astype(np.int64), np.uint64(1) << (hashes & np.uint64(63)))
    return out.view(np.int64)


def _wide(batches):
    for t in chunked(batches, 8 << 20):
        marks = np.array([parities(shingle_set(x)) for x in t.column("text").to_pylist()]).reshape(-1, WIDE)
        yield pa.RecordBatch.from_arrays([t.column("node").combine_chunks(), *(pa.array(marks[:, k].copy()) for k in range(WIDE))], ["node", *(f"w{k}" for k in range(WIDE))])


def _count(batches):
    total = np.zeros(COUNTS)
    for t in chunked(batches, 8 << 20):
        for x in t.column("text").to_pylist():
            np.add.at(total, ((shingle_set(x) >> np.uint64(40)) % np.uint64(COUNTS)).astype(np.int64), 1)
    yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])


def _names(batches):
    for t in chunked(batches, 8 << 20):
        names = [whole(shingle_set(x)) for x in t.column("text").to_pylist()]
        yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(names, pa.int64())], ["doc_id", "node"])


def _keys(batches, n_buckets: int, counts: np.ndarray):
    """Each set under the shingles of its prefix. The empty set, of which there is one, has none."""
    for t in chunked(batches, 2 << 20):
        nodes, sets = longs(t.column("node")), [shingle_set(x) for x in t.column("text").to_pylist()]
        keys = [prefix(x, counts) if whole(x) == k else np.zeros(0, np.uint64) for k, x in zip(nodes, sets)]  # else: another text of the same doc_id
        key, times = np.concatenate(keys), [len(k) for k in keys]
        bucket = ((((key * _MIX) >> np.uint64(32)) * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int32)
        size = np.repeat(np.array([len(x) for x in sets], np.int32), times)
        left = size - np.concatenate([np.arange(k, dtype=np.int32) for k in times])  # shingles from this one on
        mark = np.repeat(np.array([parity(x) for x in sets], np.int64), times)
        yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key.view(np.int64)), pa.array(np.repeat(nodes, times)), pa.array(size), pa.array(left), pa.array(mark)], ["bucket", "key", "node", "size", "left", "mark"])


def _met(batches):
    """Rows of each bucket whose key has another row of a size near enough."""
    for t in by_bucket(batches):
        key, node, size, left, mark = (t.column(c).to_numpy() for c in ("key", "node", "size", "left", "mark"))
        order = np.lexsort((size, key))
        key, node, size, left = key[order], node[order], size[order].astype(np.int64), left[order]
        near = (key[1:] == key[:-1]) & (OF * size[:-1] >= SHARED * size[1:])
        keep = np.r_[near, False] | np.r_[False, near]
        if keep.any():
            yield pa.RecordBatch.from_arrays([pa.array(key[keep]), pa.array(node[keep]), pa.array(size[keep].astype(np.int32)), pa.array(left[keep]), pa.array(mark[order][keep])], ["key", "node", "size", "left", "mark"])


def _compare(batches):
    for t in chunked(batches, 8 << 20):
        known: dict[str, np.ndarray] = {}

        def of(text):
            if text not in known:
                known[text] = shingle_set(text)
            return known[text]

        rows = zip(*(t.column(c).to_pylist() for c in ("u", "v", "a", "b")))
        ok = pa.array([whole(of(a)) == u and whole(of(b)) == v and similar(of(a), of(b)) for u, v, a, b in rows], pa.bool_())
        yield pa.RecordBatch.from_arrays([t.column("u").combine_chunks().filter(ok), t.column("v").combine_chunks().filter(ok)], ["u", "v"])


def near_duplicates(docs: DataFrame, more_pairs=None) -> DataFrame:
    """doc_id and component_id (the smallest doc_id) for every row of docs. doc_id: not null. Texts without words are alike.

    more_pairs: from one text of each distinct set (node, text) to candidates (u, v) that are compared first.
    """
    spark = docs.sparkSession
    n = partitions(spark)
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    names, p_names = settle(texts.mapInArrow(_names, "doc_id long, node long"))
    first, p_first = settle(names.groupBy("node").agg(F.min("doc_id").alias("first")))
    # One text for each distinct set; a merge join at every size.
    chosen, p_chosen = settle(texts.join(first.hint("merge"), F.col("doc_id") == F.col("first")).select("node", "text"))
    counts = add_up(chosen.select("text").mapInArrow(_count, "v binary"), COUNTS, ways=8)
    met, p_met = settle(exchange(chosen.mapInArrow(lambda it: _keys(it, 4 * n, counts), "bucket int, key long, node long, size int, left int, mark long"), n).mapInArrow(_met, "key long, node long, size int, left int, mark long"))
    more, p_more = settle(more_pairs(chosen).select("u", "v")) if more_pairs else (spark.createDataFrame([], "u long, v long"), None)
    nodes = met.select("node").unionByName(more.select(F.explode(F.array("u", "v")).alias("node")))
    held, p_held = settle(chosen.join(nodes.distinct().hint("merge"), "node", "left_semi"), p_chosen)
    scratch = [p_names, p_first, p_met, p_held, *([p_more] if p_more else [])]
    tested = edges = None
    in_order = lambda a, b: F.struct(F.least(a, b).alias("u"), F.greatest(a, b).alias("v"))

    def compared(pairs):
        """Components with the links among pairs, which are those not compared before."""
        nonlocal tested, edges
        pairs = pairs.where("u <> v").distinct()
        pairs, p_pairs = settle(pairs if tested is None else pairs.join(tested, ["u", "v"], "left_anti"))
        a, b = (held.select(F.col("node").alias(k), F.col("text").alias(x)) for k, x in (("u", "a"), ("v", "b")))
        found, p_found = settle(pairs.join(a, "u").join(b, "v").select("u", "v", "a", "b").mapInArrow(_compare, "u long, v long"))
        tested = pairs if tested is None else tested.unionByName(pairs)
        edges = found if edges is None else edges.unionByName(found)
        roots, p_roots = settle(components(edges))
        scratch.extend([p_pairs, p_found, p_roots])
        return roots

    def apart(roots):
        """Entries under keys that still join several components, with the first and the last entry."""
        at = met.join(roots, "node", "left").select("key", "node", "size", "left", "mark", F.coalesce("root", "node").alias("root"))
        entry = F.struct("root", "node", "size", "mark")
        ends = at.groupBy("key").agg(F.min(entry).alias("low"), F.max(entry).alias("high")).where("low.root < high.root")
        return at.join(ends, "key")

    def near(size, other_size, *marks):
        """Whether sizes allow the similarity, and the shingles that are in one of two sets only are few enough. marks: pairs of parity bits."""
        differ = sum((F.bit_count(F.col(a).bitwiseXOR(F.col(b))) for a, b in marks), F.lit(0))
        return (F.least(size, other_size) * OF >= F.greatest(size, other_size) * SHARED) & (differ * (SHARED + OF) <= (F.col(size) + F.col(other_size)) * (OF - SHARED))

    hubs = met.groupBy("key").agg(F.min("node").alias("low"), F.count("*").alias("n"))
    hub = met.join(hubs, "key").groupBy("node").agg(F.max_by("low", F.struct("n", "key")).alias("low"))
    roots = compared(hub.select(in_order("low", "node").alias("p")).select("p.*").unionByName(more))
    ends = apart(roots).select("node", "root", "size", "mark", F.explode(F.array("low", "high")).alias("end"))
    roots = compared(ends.where((F.col("root") != F.col("end.root")) & near("size", "end.size", ("mark", "end.mark"))).select(in_order(F.col("end.node"), F.col("node")).alias("p")).select("p.*"))
    still, p_still = settle(apart(roots).select("key", "node", "size", "left", "root"))
    wide = [f"w{k}" for k in range(WIDE)]
    marks = held.join(still.select("node").distinct().hint("merge"), "node", "left_semi").select("node", "text").mapInArrow(_wide, ", ".join(["node long", *(f"{w} long" for w in wide)]))
    still, p_marked = settle(still.join(marks, "node"), p_still)
    scratch.append(p_marked)
    other = still.select("key", *(F.col(c).alias(f"other_{c}") for c in ("node", "size", "left", "root", *wide)))
    # Under the first shingle that two sets share, what is left of both from there on must hold all they share.
    enough = F.least("left", "other_left") * (SHARED + OF) >= (F.col("size") + F.col("other_size")) * SHARED
    rest = still.join(other, "key").where((F.col("node") < F.col("other_node")) & (F.col("root") != F.col("other_root")) & enough & near("size", "other_size", *((w, f"other_{w}") for w in wide)))
    roots = compared(rest.select(F.col("node").alias("u"), F.col("other_node").alias("v")))
    named = first.join(roots, "node", "left").select("node", "first", F.coalesce("root", "node").alias("root"))
    smallest = named.groupBy("root").agg(F.min("first").alias("component_id"))
    out, _ = settle(names.join(named.join(smallest, "root").select("node", "component_id"), "node").select("doc_id", "component_id"), *scratch)
    return out
