"""Quality rules by distribution divergence.

A document's histogram of character classes and of common words is compared with references of several
languages by Jensen-Shannon distance. References are counted over the whole table, from all documents of
each language that are long enough; a document is judged by the language it is closest to. Languages are
those with a list of common words here and all others that enough documents of the table are said to be in,
whose lists are their most frequent words. Short texts have histograms too rough to judge and are left to the
base rules.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tesserae.llm.common import CHUNK_ROWS, add_up, chunked

# Frequent function words of each language whose reference is counted.
COMMON_WORDS = {
    "en": "the of and to in is that it for was on are as with at be this by an or from not but which".split(),
    "fr": "le la les de des du et en un une que qui pour dans par sur est au pas ne ce il elle".split(),
    "de": "der die das und in zu den von mit ist auf für im nicht ein eine dem des sich als auch an bei".split(),
    "es": "el la los las de del y en un una que por para con se no es al lo como su más".split(),
}
CLASSES = ("space", "line end", "A-Z", "a-z", "digit", "sentence mark", "symbol", "other ASCII", "not ASCII")
#: A lang without a list gets one of so many words, if so many documents that are long enough, and at least one of so many of those, have it (so there are at most that many lists).
LEARNED_WORDS, MIN_LANGUAGE_DOCS, LANGUAGE_SHARE = 26, 50, 2000
MIN_WORDS = 10
#: Below these, a histogram is not judged.
MIN_CHARS, MIN_WORDS_JUDGED = 400, 60
#: Largest Jensen-Shannon distances (base 2, 0 to 1) of documents that are kept.
MAX_CHAR_DISTANCE, MAX_WORD_DISTANCE = 0.28, 0.37

_CLASS = np.full(256, 7, np.uint8)
for _k, _chars in enumerate((b" \t", b"\n\r\x0b\x0c", bytes(range(65, 91)), bytes(range(97, 123)), b"0123456789", b".,;:!?'\"()-", b"#*$%&|<>=+@^~_{}[]\\/`")):
    _CLASS[list(_chars)] = _k
_CLASS[128:192] = 255  # continuation bytes belong to the character before
_CLASS[192:] = 8
#: Cells of the histograms that a task holds at a time.
_CELLS = 1 << 21


def vocabulary(lists: dict[str, list[str]]) -> list[str]:
    """The words of all lists, each once, in order."""
    return sorted({w for ws in lists.values() for w in ws})


_WORDS = vocabulary(COMMON_WORDS)


def base(text: str | None) -> tuple[int, int, int, int, int, bool]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed."""
    text = text or ""
    raw = text.encode()
    words = raw.split()
    chars = sum(map(len, words)) if len(raw) == len(text) else len(b"".join(words).decode())
    lines, dup = set(), 0
    if b"\n" in raw:
        for line in raw.split(b"\n"):
            if line.strip(b" \t\r\x0b\x0c"):
                dup += line in lines
                lines.add(line)
    first: dict = {}
    again: list[tuple[int, int]] = []
    for i, w in enumerate(zip(words, words[1:], words[2:], words[3:], words[4:])):
        j = first.setdefault(w, i)
        if j != i:
            again.append((j, i))
    repeated = 0
    if again:
        at = np.unique(np.array(again))
        step = np.zeros(len(words) + 1, np.int64)
        np.add.at(step, at, 1)
        np.add.at(step, at + 5, -1)
        repeated = int((np.cumsum(step[:-1]) > 0).sum())
    n = len(words)
    return n, chars, sum(map(raw.count, b"#*$%&|<>")), dup, repeated, n < MIN_WORDS or 100 * repeated > 20 * n


def histograms(texts: list[str], words: list[str] = _WORDS) -> np.ndarray:
    """A row for each text: counts of character classes, then of the given words, then of all other words."""
    cut = len(CLASSES)
    out = np.zeros((len(texts), cut + len(words) + 1))
    get = {w.encode(): i for i, w in enumerate(words)}.get
    for row, text in zip(out, texts):
        raw = text.encode()
        row[:cut] = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=256)[:cut]
        hits = np.bincount([get(w, len(words)) for w in raw.lower().translate(None, b".,;:!?").split()], minlength=len(words) + 1)
        row[cut:] = hits
    return out


def distances(h: np.ndarray, q: np.ndarray) -> np.ndarray:
    """Jensen-Shannon distance, base 2, of each row of h to q; counts need not add up to 1. 1 if either has no count."""
    total = h.sum(1, keepdims=True)
    p, q = h / np.maximum(total, 1), q / max(q.sum(), 1)
    m = (p + q) / 2
    with np.errstate(divide="ignore", invalid="ignore"):
        d = np.where(p > 0, p * np.log2(p / m), 0).sum(1) + np.where(q > 0, q * np.log2(q / m), 0).sum(1)
    return np.where((total[:, 0] > 0) & (q.sum() > 0), np.sqrt(np.clip(d / 2, 0, 1)), 1.0)


def _judged(h: np.ndarray) -> np.ndarray:
    """Which histograms are of texts long enough."""
    return (h[:, : len(CLASSES)].sum(1) >= MIN_CHARS) & (h[:, len(CLASSES) :].sum(1) >= MIN_WORDS_JUDGED)


def word_lists(docs: DataFrame) -> dict[str, list[str]]:
    """COMMON_WORDS, and for each other lang with enough documents its most frequent words, ties to the smaller one.

    Words are counted over all whole texts of the lang, and only the words of the lists reach the driver. Null and
    blank lang: none. Where all documents are in languages with lists, no word is counted.
    """
    lang = F.col("lang").cast("string")
    long = docs.where(F.length("text") >= MIN_CHARS).select(lang.alias("lang")).rollup("lang").agg(F.count("*").alias("n"), F.grouping("lang").alias("total"))
    enough = long.where((F.col("total") == 1) | ((F.col("n") >= MIN_LANGUAGE_DOCS) & (F.trim("lang") != "") & ~F.col("lang").isin(*COMMON_WORDS)))
    # No more than LANGUAGE_SHARE can have that share, so with the total the largest are all.
    largest = enough.orderBy(F.desc("n"), F.desc("total")).limit(LANGUAGE_SHARE + 1).collect()
    total = max((r["n"] for r in largest if r["total"]), default=0)
    new = sorted(r["lang"] for r in largest if not r["total"] and r["n"] * LANGUAGE_SHARE >= total)
    if not new:
        return COMMON_WORDS
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    word = F.explode(F.split(F.translate("text", upper + ".,;:!?", upper.lower()), r"[\x20\x09-\x0D]+")).alias("word")
    counts = docs.where(lang.isin(*new)).select(lang.alias("lang"), word).where("word <> ''").groupBy("lang", "word").agg(F.count("*").alias("n"))
    top = counts.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "word"))).where(F.col("place") <= LEARNED_WORDS)
    learned: dict[str, list[str]] = {}
    for r in top.orderBy("lang", "place").collect():
        learned.setdefault(r["lang"], []).append(r["word"])
    return COMMON_WORDS | learned


def _rows(words: list[str]) -> int:
    """Texts of which a task holds histograms at a time."""
    return max(16, min(CHUNK_ROWS, _CELLS // (len(CLASSES) + len(words) + 1)))


def references(docs: DataFrame, lists: dict[str, list[str]] = COMMON_WORDS) -> np.ndarray:
    """Histograms of each language of the lists, added up over all documents with that lang that are long enough."""
    words, at = vocabulary(lists), {lang: k for k, lang in enumerate(lists)}
    size = len(CLASSES) + len(words) + 1

    def count(batches):
        total = np.zeros((len(at), size))
        for t in chunked(batches, most_rows=_rows(words)):
            langs = np.array([at[x] for x in t.column("lang").to_pylist()])
            h = histograms(t.column("text").to_pylist(), words)
            np.add.at(total, langs[_judged(h)], h[_judged(h)])
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["v"])

    rows = docs.where(F.col("lang").cast("string").isin(*at) & F.col("text").isNotNull()).select("text", F.col("lang").cast("string").alias("lang"))
    return add_up(rows.mapInArrow(count, "v binary"), len(at) * size).reshape(len(at), size)


def judge(docs: DataFrame, refs: np.ndarray | None = None, lists: dict[str, list[str]] | None = None) -> DataFrame:
    """doc_id, the base counts, base_failed, char_distance, word_distance and kept for every row of docs.

    lists: common words by language, else `word_lists` of docs. refs: their histograms, else `references` of docs.
    Distances are null for texts below the guards and where no language has a reference; such texts are kept
    if the base rules pass them. Null text: no words, so the base rules reject it. Repeated rows are judged
    alike; extra columns are ignored. Languages at the same distance: the first of the lists.
    """
    lists = (word_lists(docs) if refs is None else COMMON_WORDS) if lists is None else lists
    refs = references(docs, lists) if refs is None else refs
    known = refs[refs.sum(1) > 0]
    words, cut = vocabulary(lists), len(CLASSES)

    def run(batches):
        for t in chunked(batches, most_rows=_rows(words)):
            texts = [x or "" for x in t.column("text").to_pylist()]
            h = histograms(texts, words)
            dc = np.array([distances(h[:, :cut], r[:cut]) for r in known]).reshape(len(known), -1)
            dw = np.array([distances(h[:, cut:], r[cut:]) for r in known]).reshape(len(known), -1)
            nearest = (dc + dw).argmin(0) if len(known) else np.zeros(len(texts), int)
            out = []
            for i, (text, judged) in enumerate(zip(texts, _judged(h) & bool(len(known)))):
                *counts, failed = base(text)
                c, w = (float(dc[nearest[i], i]), float(dw[nearest[i], i])) if judged else (None, None)
                out.append((*counts, failed, not failed and (c is None or c <= MAX_CHAR_DISTANCE and w <= MAX_WORD_DISTANCE), c, w))
            kinds = [pa.int64()] * 5 + [pa.bool_()] * 2 + [pa.float64()] * 2
            yield pa.RecordBatch.from_arrays([t.column("doc_id").combine_chunks(), *(pa.array(c, k) for c, k in zip(zip(*out), kinds))], ["doc_id", *_NAMES])

    names = ", ".join(f"{c} {'boolean' if c in ('base_failed', 'kept') else 'double' if c.endswith('distance') else 'long'}" for c in _NAMES)
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, f"doc_id long, {names}")


_NAMES = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "char_distance", "word_distance")
