"""Quality classifier by importance resampling.

Bags of hashed n-grams (words and pairs of neighbouring words) are counted over whole tables: for target text,
for the labelled text that is unwanted, and for all raw text. Raw text is modelled as a mixture of the target
model, of an unwanted text's own model, and of target text in which a share of the n-grams is drawn from
those that unwanted documents have in excess, at several shares: a few decisive words count in a long text,
and common words don't. A document's weight is the log ratio of the target model and the raw model over all
its n-grams. Documents are sampled without replacement by Gumbel top-k: the k largest of weight plus Gumbel
noise, which is a hash of the seed and doc_id, so a run can be repeated.
"""

from __future__ import annotations

import math
import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import add_up, chunked, longs, settle

#: Buckets of words, and of pairs of words.
WORDS, PAIRS = 1 << 16, 1 << 14
SEED = 7
#: Share of the raw text's counts in the model of each kind of labelled text.
SMOOTHING = 0.05
#: Kinds of labelled documents: target, low quality, toxic. Low quality shows in all of a text, so its own model is compared too.
TARGET, LOW, TOXIC = 0, 1, 2
WHOLE_TEXT = (LOW,)
#: Shares of n-grams from the excess of an unwanted kind.
SHARES = (0.003, 0.01, 0.03, 0.1, 0.3)
#: A bucket is in excess where a kind's documents have it so many standard deviations, and so many times, more often than target documents.
DEVIATIONS, TIMES = 4.0, 4.0
#: Weight of a text without a word.
NOTHING = -100.0
_PAIR = np.uint32(0x9E3779B1)


def ngrams(text: str | None) -> np.ndarray:
    """Buckets of the words and of the pairs of neighbouring words of a whole text, lower-cased in A-Z. All pairs of one word twice are one n-gram."""
    words = (text or "").encode().lower().split()
    one = np.fromiter(map(zlib.crc32, words), np.uint32, len(words))
    two = (one[:-1] * _PAIR) ^ (one[1:] + (one[1:] >> np.uint32(15)))
    two[one[:-1] == one[1:]] = 0
    one, two = one ^ (one >> np.uint32(16)), two ^ (two >> np.uint32(16))
    return np.concatenate([one % np.uint32(WORDS), two % np.uint32(PAIRS) + np.uint32(WORDS)]).astype(np.int64)


@dataclass
class Model:
    """Log ratio of each part of the raw mixture to the target model, by bucket, and the log share of each part; the target's own comes first."""

    ratio: np.ndarray
    share: np.ndarray

    def weight(self, text: str | None) -> float:
        at = ngrams(text)
        if not len(at):
            return NOTHING
        parts = self.share + sum(self.ratio[at[i : i + 65536]].sum(0, dtype=np.float64) for i in range(0, len(at), 65536))
        return -float(np.logaddexp.reduce(parts))


def fit(occurrences: np.ndarray, documents: np.ndarray, n_documents: np.ndarray) -> Model | None:
    """occurrences: of each kind and of all raw text, by bucket; documents: how many of each kind have a bucket. None without a target document."""
    if not n_documents[TARGET]:
        return None
    raw = (occurrences[3] + SMOOTHING) / (occurrences[3] + SMOOTHING).sum()
    of = [(1 - SMOOTHING) * c / c.sum() + SMOOTHING * raw if c.sum() else raw for c in occurrences[:3]]
    target, kinds = of[TARGET], [k for k in (LOW, TOXIC) if n_documents[k]]
    total = n_documents[[TARGET, *kinds]].sum()
    parts, shares = [target], [n_documents[TARGET] / total]
    for k in kinds:
        expected = documents[TARGET] * n_documents[k] / n_documents[TARGET]
        more = np.where(documents[k] > TIMES * expected, np.maximum(0, documents[k] - expected - DEVIATIONS * np.sqrt(documents[k] + expected)), 0)
        mine = [of[k]] if k in WHOLE_TEXT or not more.any() else []
        if more.any():
            mine += [(1 - s) * target + s * more / more.sum() for s in SHARES]
        parts += mine
        shares += [n_documents[k] / total / len(mine)] * len(mine)
    if not kinds:  # all that is known of other text is the raw text
        parts, shares = [target, raw], [0.5, 0.5]
    return Model(np.log(np.stack(parts, 1) / target[:, None]).astype(np.float32), np.log(shares))


def models(docs: DataFrame) -> Model | None:
    """Counts over all rows. docs: text, and kind (null: not labelled)."""
    n = WORDS + PAIRS

    def count(batches):
        occurrences, documents, n_documents = np.zeros((4, n)), np.zeros((3, n)), np.zeros(3)
        for t in chunked(batches):
            for text, kind in zip(t.column("text").to_pylist(), t.column("kind").to_pylist()):
                at, times = np.unique(ngrams(text), return_counts=True)
                occurrences[3, at] += times
                if kind is not None:
                    occurrences[kind, at] += times
                    documents[kind, at] += 1
                    n_documents[kind] += 1
        yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([occurrences.ravel(), documents.ravel(), n_documents]).tobytes()], pa.binary())], ["v"])

    sums = add_up(docs.select("text", "kind").mapInArrow(count, "v binary"), 7 * n + 3, ways=4)
    return fit(sums[: 4 * n].reshape(4, n), sums[4 * n : 7 * n].reshape(3, n), sums[7 * n :])


def noise(doc_ids: np.ndarray, seed: int = SEED) -> np.ndarray:
    """Gumbel noise by document id."""
    x = doc_ids.view(np.uint64) + np.uint64(seed * 0x9E3779B97F4A7C15 % 2**64)
    for shift, m in ((30, 0xBF58476D1CE4E5B9), (27, 0x94D049BB133111EB)):
        x = (x ^ (x >> np.uint64(shift))) * np.uint64(m)
    u = ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) / (1 << 53)
    return -np.log(-np.log(u + 1e-17 + (u == 0) * 1e-16))


def kth_largest(rows: DataFrame, column: str, k: int, bins: int = 4096) -> float:
    """The k-th largest value of a double column, by counts in ever finer bins: a driver row for each bin, no sort."""
    low, high, count = rows.agg(F.min(column), F.max(column), F.count(column)).first()
    if k <= 0 or not count:
        return math.inf
    if k >= count:
        return low
    above = 0  # values over high
    while low < high:
        width = (high - low) / bins
        # A bin of its own for the lowest value, so that every round parts what is left.
        at = F.when(F.col(column) == low, -1).otherwise(F.least(F.lit(bins - 1), F.floor((F.col(column) - low) / width).cast("int")))
        got = {r["b"]: (r["n"], r["lo"], r["hi"]) for r in rows.where(F.col(column).between(low, high)).groupBy(at.alias("b")).agg(F.count("*").alias("n"), F.min(column).alias("lo"), F.max(column).alias("hi")).collect()}
        for b in sorted(got, reverse=True):
            n, lo, hi = got[b]
            if above + n >= k:
                low, high = lo, hi
                break
            above += n
    return low


def kinds_of(labels: DataFrame) -> DataFrame:
    """(label_id, kind) of every labelled doc_id. With several labels: toxic if one says so, else low quality if one says so; target if all have quality 1. A label without a quality that is not toxic says nothing."""
    kind = F.when(F.max("toxic") == 1, TOXIC).when(F.min("quality") == 0, LOW).when(F.bool_and(F.coalesce(F.col("quality") == 1, F.lit(False))), TARGET)
    known = labels.where("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("label_id")).agg(kind.alias("kind"))
    return known.where("kind is not null")


def classify(docs: DataFrame, labels: DataFrame, keep: tuple[str, ...] = ("doc_id",), share: float | None = None, seed: int = SEED) -> DataFrame:
    """The columns `keep` of every row of docs, weight, and kept: whether the row is among the k sampled.

    docs: doc_id, text; labels: doc_id, quality, toxic; other columns are ignored. share: k as a share of the rows; without it,
    k is the number of rows that are more likely target text than not, by the shares of the labels. Null texts and texts
    without a word rank last. Rows tied at the k-th key, as all those of one document are, are all kept. A null doc_id has no
    label and is sampled like others. Without a target document there is nothing to compare: weight 0, all kept.
    """
    if {"weight", "kept"} & {c.lower() for c in keep}:
        raise ValueError("weight and kept are columns of the result")
    columns = list(dict.fromkeys(["doc_id", *keep, "text"]))
    docs = docs.select(*columns)
    # A merge join at every size: labels grow with the documents.
    known = docs.select(F.col("doc_id").cast("long").alias("label_id"), "text").join(kinds_of(labels).hint("merge"), "label_id", "left")
    model = models(known)
    if model is None:
        return docs.select(*keep, F.lit(0.0).alias("weight"), F.lit(True).alias("kept"))
    schema = docs.select(*keep).schema.add("weight", "double").add("_key", "double")

    def run(batches):
        for t in chunked(batches):
            w = np.array([model.weight(x) for x in t.column("text").to_pylist()])
            ids = longs(pc.fill_null(t.column("doc_id").cast(pa.int64()), -1))
            yield from pa.Table.from_arrays([*(t.column(c) for c in keep), pa.array(w), pa.array(w + noise(ids, seed))], [*keep, "weight", "_key"]).combine_chunks().to_batches()

    scored, _ = settle(docs.mapInArrow(run, schema))
    k = math.ceil(share * scored.count()) if share is not None else scored.where(F.col("weight") + float(model.share[0]) > math.log(0.5)).count()
    return scored.withColumn("kept", F.col("_key") >= kth_largest(scored, "_key", k)).drop("_key")
