"""Language identification with string kernels.

The kernel of two texts is the number of byte n-grams (all lengths of a blended spectrum, 1 to 3) that
are present in both, over the geometric mean of the numbers present in each. Nyström landmarks map a text to m kernel values, whitened by the landmarks' own kernel matrix, and kernel
ridge regression in that space gives one score per language (one versus rest). Texts are scored in batches,
as products of presence and landmark matrices.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import chunked

#: Bounds of the training sample: texts in all, and landmarks among them. Sampled by a hash of doc_id, evenly by language.
TRAIN_ROWS = 3000
LANDMARKS = 192
RIDGE = 1.0
ORDERS = (1, 2, 3)
#: Bound of the sample in bytes: texts are used whole; those with the largest hashes are left out, but not the first of a language.
TRAIN_BYTES = 48 << 20
UNKNOWN = "und"
#: Factor from ridge scores (about -1 to 1, 0 between a language and the others) to log odds.
SHARPNESS = 6.0
#: Texts whose presence is held at once.
BLOCK = 256
_LETTER = re.compile("[A-Za-z]")


def has_letter(text: str | None) -> bool:
    return bool(text) and (bool(_LETTER.search(text)) or any(map(str.isalpha, text)))


def codes(data: np.ndarray, order: int) -> np.ndarray:
    """Byte n-grams of one length as numbers."""
    x = data.astype(np.int32)
    out = x[: len(x) - order + 1]
    for i in range(1, order):
        out = (out << 8) | x[i : len(x) - order + 1 + i]
    return out


@dataclass
class Model:
    languages: list[str]
    grams: dict[int, np.ndarray]  # sorted codes of each length
    landmarks: np.ndarray  # n-grams x landmarks, each column of unit length
    weights: np.ndarray  # landmarks x languages
    prior: int

    def presence(self, texts: list[bytes], tables: dict[int, np.ndarray]) -> np.ndarray:
        """Texts x n-grams of the landmarks, 1 where present, over the root of the number of all n-grams in the text."""
        size = sum(map(len, self.grams.values()))
        out, present = np.zeros((len(texts), size + 1), np.float32), np.ones(len(texts), np.float32)
        for i, text in enumerate(texts):
            data = np.frombuffer(text, np.uint8)
            for order, table in tables.items():
                if len(data) >= order:
                    found = np.sort(codes(data, order))
                    out[i, table[found]] = 1
                    present[i] += 1 + np.count_nonzero(found[1:] != found[:-1])
        return out[:, :size] / np.sqrt(np.maximum(present - 1, 1))[:, None]

    def tables(self) -> dict[int, np.ndarray]:
        """For each length, from code to column; n-grams of no landmark go to a last column that is cut off."""
        size, at, out = sum(map(len, self.grams.values())), 0, {}
        for order, known in self.grams.items():
            out[order] = np.full(1 << (8 * order), size, np.int32)
            out[order][known] = np.arange(at, at + len(known))
            at += len(known)
        return out

    def predict(self, texts: list[bytes], tables: dict[int, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Index of the language, and how sure its one-versus-rest score is: the same whatever the number of languages, so that a text in none of them is sure of none."""
        best, score = [], []
        for i in range(0, len(texts), BLOCK):
            x = self.presence(texts[i : i + BLOCK], tables)
            scores = ((x @ self.landmarks) @ self.weights).astype(np.float64)
            blank = ~x.any(1)
            top = np.where(blank, self.prior, scores.argmax(1))
            best.append(top)
            score.append(np.where(blank, 0.0, 1 / (1 + np.exp(-SHARPNESS * scores[np.arange(len(top)), top]))))
        return np.concatenate(best), np.clip(np.concatenate(score), 0, 1)


def train(texts: list[bytes], langs: list[str], landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Fits on the driver; inputs are in sampling order. Landmarks are taken in turn from each language."""
    names = sorted(set(langs))
    label = np.array([names.index(x) for x in langs])
    turn = np.zeros(len(label), np.int64)
    for k in range(len(names)):
        turn[label == k] = np.arange((label == k).sum())
    marks = np.lexsort((label, turn))[:landmarks]
    grams = {o: np.unique(np.concatenate([np.unique(codes(np.frombuffer(texts[i], np.uint8), o)) if len(texts[i]) >= o else np.zeros(0, np.int32) for i in marks])) for o in ORDERS}
    model = Model(names, grams, np.zeros((0, 0), np.float32), np.zeros((0, 0), np.float32), int(np.bincount(label).argmax()))
    tables = model.tables()
    model.landmarks = np.ascontiguousarray(model.presence([texts[i] for i in marks], tables).T)
    k = np.concatenate([model.presence(texts[i : i + 256], tables) @ model.landmarks for i in range(0, len(texts), 256)]).astype(np.float64)
    own = k[marks]
    value, vector = np.linalg.eigh((own + own.T) / 2)
    ok = value > 1e-6 * value.max()
    whiten = vector[:, ok] / np.sqrt(value[ok])
    z = k @ whiten
    share = np.bincount(label, minlength=len(names)) / len(label)
    weight = 1 / (share[label] * len(names))  # each language counts alike
    y = np.where(label[:, None] == np.arange(len(names)), 1.0, -1.0)
    beta = np.linalg.solve(z.T @ (z * weight[:, None]) + ridge * np.eye(z.shape[1]), z.T @ (y * weight[:, None]))
    model.weights = (whiten @ beta).astype(np.float32)
    return model


def sample(docs: DataFrame, rows: int = TRAIN_ROWS, max_bytes: int = TRAIN_BYTES) -> tuple[list[bytes], list[str]]:
    """Labelled texts, at most `rows` and about `max_bytes` together, evenly by language, those with the smallest hash of doc_id first."""
    known = docs.where("lang is not null and text is not null").select(F.col("lang").cast("string").alias("lang"), "text", F.xxhash64(F.col("doc_id").cast("string")).alias("h"), F.octet_length("text").cast("long").alias("size"), F.xxhash64("text").alias("digest"))
    counts = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "lang").limit(rows).collect()}
    if not counts:
        return [], []
    each = max(1, rows // len(counts))
    # Hashes are even over the longs: a bound that lets about 1.5 times as many through, then the exact number.
    bound = {k: min(2**63 - 1, int(-(2**63) + 2**64 * min(1.0, (1.5 * each + 30) / n))) for k, n in counts.items()}
    near = known.where(F.col("h") <= F.element_at(spark_map(bound), F.col("lang")))
    # Texts are left out until it is known which fit the bound in bytes; Spark cuts each language to `each` rows before they meet.
    in_order = Window.partitionBy("lang").orderBy("h", "size", "digest")
    first = near.select("lang", "h", "size", "digest").withColumn("turn", F.row_number().over(in_order)).where(F.col("turn") <= each)
    chosen, total = [], 0
    for r in sorted(first.collect(), key=lambda r: (r["turn"], r["lang"])):  # `rows` at most
        if r["turn"] == 1 or total + r["size"] <= max_bytes:
            total += r["size"]
            chosen.append((r["lang"], r["h"], r["size"], r["digest"]))
    texts = near.where(F.col("h").isin(sorted({c[1] for c in chosen}))).groupBy("lang", "h", "size", "digest").agg(F.min("text").alias("text"))
    by = {tuple(r)[:4]: r["text"].encode() for r in texts.join(docs.sparkSession.createDataFrame(chosen, "lang string, h long, size long, digest long").distinct(), ["lang", "h", "size", "digest"], "left_semi").collect()}
    return [by[c] for c in chosen], [c[0] for c in chosen]


def spark_map(values: dict[str, int]):
    return F.map_from_arrays(F.array(*(F.lit(k) for k in values)), F.array(*(F.lit(v) for v in values.values())))


def identify(docs: DataFrame, training: DataFrame, keep: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """The columns `keep`, lang_pred and score for every row of docs.

    training: doc_id, text and lang, of which a bounded sample is learned. Texts that are null or have no
    letter: `und` with score 0; so are all if nothing can be learned. A text without any known n-gram gets
    the most frequent language of the sample with score 0. lang, source and doc_id of docs are not looked at.
    """
    texts, langs = sample(training)
    model = train(texts, langs) if texts else None
    columns = list(dict.fromkeys([*keep, "text"]))
    schema = docs.select(*keep).schema.add("lang_pred", "string").add("score", "double")

    def run(batches):
        tables = model.tables() if model else {}
        for t in chunked(batches, 2 << 20):
            raw = t.column("text").to_pylist()
            known = np.array([bool(model) and has_letter(x) for x in raw], bool)
            names, score = np.full(len(raw), UNKNOWN, object), np.zeros(len(raw))
            if known.any():
                at = np.flatnonzero(known)
                best, p = model.predict([raw[i].encode() for i in at], tables)
                names[at], score[at] = np.array(model.languages, object)[best], p
            yield from pa.Table.from_arrays([*(t.column(c) for c in keep), pa.array(names, pa.string()), pa.array(score)], [*keep, "lang_pred", "score"]).combine_chunks().to_batches()

    return docs.select(*columns).mapInArrow(run, schema)


def held_out(doc_id="doc_id"):
    """Whether crc32 of doc_id as text leaves 0 over 5. A null doc_id counts as not held out."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string")) % 5 == 0, F.lit(False))

