"""SimHash near-duplicates by multi-index hashing.

A fingerprint is cut in two 32-bit segments. Two fingerprints that differ in at most 3 bits differ in
at most 1 bit in one of the segments, so each fingerprint is put in the table under its own segment
values and looks up the Hamming ball of radius 1 around them; what meets is verified on all 64 bits.
Copies meet first: the tables hold each distinct fingerprint once. Table entries that hold a large share of
the fingerprints are dealt by the bytes of the other segment: at most 3 bits of its 4 bytes differ, so
linked fingerprints still meet under one of them. Within an entry links are found in the same way and only
a spanning forest of them leaves the task, so a group of near copies never yields its pairs. Components
then take the smallest document.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import by_bucket, chunked, components, exchange, partitions, settle

SEED = 42
MAX_BITS = 3
#: Members of a table entry up to which all of them are compared at once.
SMALL_ENTRY = 4096
#: Owners of a table entry over which it and its neighbours are dealt by bytes; raised so that there are at most HOT_ENTRIES of them.
LARGE_ENTRY, HOT_ENTRIES = 1 << 16, 20_000


def fingerprint(text: str | None, width: int = 3) -> int:
    """64-bit SimHash over word shingles, each occurrence counted; 0 without words."""
    words = (text or "").encode().lower().split()
    if not words:
        return 0
    if len(words) <= width:
        hashes = [xxhash.xxh64_intdigest(b" ".join(words), SEED)]
    else:
        one = xxhash.xxh64_intdigest
        hashes = [one(b" ".join(words[i : i + width]), SEED) for i in range(len(words) - width + 1)]
    return majority(np.array(hashes, np.uint64))


def majority(hashes: np.ndarray) -> int:
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 4096):
        ones += np.unpackbits(hashes[i : i + 4096].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(0, dtype=np.int64)
    return int(np.packbits((2 * ones > len(hashes)).astype(np.uint8), bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, width: int = 3) -> DataFrame:
    """(doc_id, fp): fp is the fingerprint as a signed long."""

    def run(batches):
        for t in chunked(batches, 8 << 20):
            fps = np.array([fingerprint(x, width) for x in t.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), pa.array(fps)], ["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, fp long")


def _probes(batches, n_buckets: int, hot: np.ndarray):
    """Table entries (owner) and look-ups (not owner) of both segments, by bucket.

    Keys are the segment's value and number. Those in `hot` (ascending) are sent four times instead, each
    with one byte of the other segment in the key.
    """
    flips = np.concatenate([[0], 1 << np.arange(32)]).astype(np.uint64)
    for b in batches:
        fp = b.column(0).to_numpy(zero_copy_only=False).view(np.uint64)
        for seg in (0, 1):
            value = (fp >> np.uint64(32 * seg)) & np.uint64(0xFFFFFFFF)
            key = ((value[:, None] ^ flips[None, :]) << np.uint64(1) | np.uint64(seg)).ravel()
            of, own = np.repeat(fp, 33), np.tile(np.arange(33) == 0, len(fp))
            if len(hot):
                is_hot = hot[np.minimum(np.searchsorted(hot, key), len(hot) - 1)] == key
                split, split_of, split_own = key[is_hot], of[is_hot], own[is_hot]
                key, of, own = [key[~is_hot]], [of[~is_hot]], [own[~is_hot]]
                for byte in range(4):
                    shared = (split_of >> np.uint64(32 * (1 - seg) + 8 * byte)) & np.uint64(255)
                    key.append(split | np.uint64((4 + byte) << 33) | shared << np.uint64(36))
                    of.append(split_of)
                    own.append(split_own)
                key, of, own = map(np.concatenate, (key, of, own))
            spread = (key * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(32)
            bucket = ((spread * np.uint64(n_buckets)) >> np.uint64(32)).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(key.view(np.int64)), pa.array(of.view(np.int64)), pa.array(own)], ["bucket", "key", "fp", "own"])


def _distance(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    return np.bitwise_count(a ^ b)


def _free_bits(key: int) -> np.ndarray:
    """Bits of a fingerprint that the key of its entry leaves open, without those of the key's own segment."""
    bits = np.arange(32)
    if key >> 35 & 1:
        bits = bits[bits // 8 != (key >> 33 & 3)]
    return bits + 32 * (1 - (key & 1))


def _spanning(fp: np.ndarray, own: np.ndarray, max_bits: int, free: np.ndarray) -> list[np.ndarray]:
    """Position pairs that span the links between owners and all members of one table entry.

    Large entries are split by each of max_bits + 1 groups of the bits that they need not share, `free`: of
    fingerprints at most max_bits apart one group is equal. Parts still large are split again if they have
    shrunk so much that the parts of all groups together are no more than what was split.
    """
    out, todo = [], [(np.arange(len(fp)), free, True)]
    while todo:
        at, free, split = todo.pop()
        if not split or len(at) <= SMALL_ENTRY or len(free) <= max_bits:
            out += _reach(fp, own, at, max_bits)
            continue
        for group in np.array_split(free, max_bits + 1):
            v = fp[at] & np.bitwise_or.reduce(np.uint64(1) << group.astype(np.uint64))
            order = np.argsort(v, kind="stable")
            rest = np.setdiff1d(free, group)
            parts = np.split(order, np.flatnonzero(np.diff(v[order])) + 1)
            todo += [(at[p], rest, (max_bits + 1) * len(p) <= len(at)) for p in parts if len(p) > 1 and own[at[p]].any()]
    return out


def _reach(fp: np.ndarray, own: np.ndarray, at: np.ndarray, max_bits: int) -> list[np.ndarray]:
    """Walks from member to member; each is compared with those not reached yet only."""
    out, rest, todo = [], at, []
    while len(rest):
        if todo:
            i = todo.pop()
            near = _distance(fp[i], fp[rest]) <= max_bits
            if not own[i]:
                near &= own[rest]
            if near.any():
                met, rest = rest[near], rest[~near]
                out.append(np.stack([np.full(len(met), i), met], 1))
                todo += met.tolist()
        else:
            todo, rest = [int(rest[0])], rest[1:]
    return out


def _match(batches, max_bits: int):
    """Verified links of each bucket, as (u, v) with u < v."""
    for t in by_bucket(batches):
        key, fp, own = (t.column(c).to_numpy() for c in ("key", "fp", "own"))
        fp = fp.view(np.uint64)
        order = np.lexsort((fp, ~own, key))
        key, fp, own = key[order], fp[order], own[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        sizes = np.diff(np.r_[starts, len(key)])
        live = own[starts] & (sizes > 1)  # owners come first in an entry
        us, vs = [], []
        small = live & (sizes <= 8)
        for d in range(1, 8):
            for lag in range(8 - d):
                s = starts[small & (sizes > lag + d)] + lag
                s = s[own[s] & (_distance(fp[s], fp[s + d]) <= max_bits)]
                us.append(fp[s])
                vs.append(fp[s + d])
        for s, n in zip(starts[live & (sizes > 8)], sizes[live & (sizes > 8)]):
            at = _spanning(fp[s : s + n], own[s : s + n], max_bits, _free_bits(int(key[s])))
            if at:
                a, b = np.concatenate(at).T
                us.append(fp[s + a])
                vs.append(fp[s + b])
        u, v = np.concatenate(us).view(np.int64), np.concatenate(vs).view(np.int64)
        pairs = np.unique(np.stack([np.minimum(u, v), np.maximum(u, v)], 1), axis=0)
        pairs = pairs[pairs[:, 0] != pairs[:, 1]]
        if len(pairs):
            yield pa.RecordBatch.from_arrays([pa.array(pairs[:, 0].copy()), pa.array(pairs[:, 1].copy())], ["u", "v"])


def hot_keys(distinct: DataFrame, large: int = LARGE_ENTRY) -> np.ndarray:
    """Keys of the table entries with more than `large` owners, and of those one bit away from one, ascending.

    Each fingerprint owns two entries, so over a bound of 2 n / HOT_ENTRIES owners there are at most HOT_ENTRIES.
    """
    large = max(large, -(-2 * distinct.count() // HOT_ENTRIES))
    low, high = F.col("fp").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned("fp", 32)
    owned = distinct.select(F.explode(F.array(low * 2, high * 2 + 1)).alias("key")).groupBy("key").agg(F.count("*").alias("n"))
    full = np.array([r["key"] for r in owned.where(F.col("n") > large).select("key").collect()], np.uint64)
    flips = np.concatenate([[0], 2 << np.arange(32)]).astype(np.uint64)
    return np.unique(full[:, None] ^ flips[None, :])


def links(distinct: DataFrame, max_bits: int = MAX_BITS, large: int = LARGE_ENTRY) -> DataFrame:
    """(u, v): enough links between the distinct fingerprints (column fp) to give the components of all links of at most max_bits (3 at most) bits."""
    if not 0 <= max_bits <= 3:
        raise ValueError("two segments and balls of radius 1 find links of up to 3 bits")
    n = partitions(distinct.sparkSession)
    hot = hot_keys(distinct, large)
    made = distinct.select("fp").mapInArrow(lambda it: _probes(it, 4 * n, hot), "bucket int, key long, fp long, own boolean")
    return exchange(made, n).mapInArrow(lambda it: _match(it, max_bits), "u long, v long")


def near_duplicates(docs: DataFrame, width: int = 3, max_bits: int = MAX_BITS) -> DataFrame:
    """doc_id, fingerprint (16 hex digits), component_id for every row of docs.

    Null or empty texts have fingerprint zero and link like any other. Rows with a null doc_id get the
    component of their fingerprint but never name it. A repeated row is returned as often as it occurs.
    """
    fps, _ = settle(fingerprints(docs, width))
    distinct, _ = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    edges, p_edges = settle(links(distinct, max_bits))
    roots = components(edges)
    named = distinct.join(roots, distinct.fp == roots.node, "left").select("fp", "first", F.coalesce("root", "fp").alias("root"))
    named, _ = settle(named, p_edges)
    smallest, _ = settle(named.groupBy("root").agg(F.min("first").alias("component_id")))
    by_fp, _ = settle(named.join(smallest, "root").select("fp", "component_id"))
    return fps.join(by_fp, "fp").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def fingerprint_pairs(texts: DataFrame, width: int = 5, max_bits: int = MAX_BITS) -> DataFrame:
    """Candidates (u, v) among rows (node, text): pairs enough to join all nodes whose fingerprints are linked."""
    fps, _ = settle(fingerprints(texts.select(F.col("node").alias("doc_id"), "text"), width))
    first, _ = settle(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    same = fps.join(first, "fp").where("doc_id <> first").select(F.col("first").alias("u"), F.col("doc_id").alias("v"))
    u, v = (first.select(F.col("fp").alias(k), F.col("first").alias(f"first_{k}")) for k in "uv")
    near = links(first.select("fp"), max_bits).distinct().join(u, "u").join(v, "v")
    return same.unionByName(near.select(F.least("first_u", "first_v").alias("u"), F.greatest("first_u", "first_v").alias("v")))


def similar_documents(docs: DataFrame) -> DataFrame:
    """doc_id and component_id (the smallest doc_id) for every row of docs: documents linked by a Jaccard similarity of five-word shingle sets of 0.8 or more.

    Fingerprints over five-word shingles give the first candidates. Texts that are just similar enough differ in about 10 of 64
    bits, more than multi-index hashing can look up; so those it leaves apart come from equal parts of shingle sets, and all
    candidates are compared exactly (see `shingles`). doc_id: not null. Null texts and texts without words are alike;
    extra columns are ignored; a repeated row is returned as often as it occurs.
    """
    from tesserae.llm import shingles

    return shingles.near_duplicates(docs, fingerprint_pairs)
