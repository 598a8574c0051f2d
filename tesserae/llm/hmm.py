"""Language-model scoring with a hidden Markov model over words.

Words are counted over all training documents, exactly, by 64-bit hash. The model emits a word class
from each latent state, and a word from its class: the most frequent words are classes of their own,
the others fall into hashed classes and share their class by smoothed counts. States are trained by
Baum-Welch; the expected counts of an iteration are added up across partitions. The likelihood of a
text is exact, by the scaled forward recursion over all its tokens and one end mark.

Counts are as many as distinct words, so they are never broadcast. Documents are dealt to chunks of about as many
bytes, by a hash of id and text; a chunk asks once for each distinct word, by hash bucket, and gets the counts back.
Its texts pass by a batch at a time, so a task holds a chunk's distinct words, never its texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cached_property
from itertools import groupby
from operator import itemgetter

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tesserae.llm.common import add_up, bucketed, by_bucket, chunked, exchange, partitions, settle

STATES = 6
TOP_WORDS = 2048
HASHED_CLASSES = 64
ITERATIONS = 3
#: Tokens after which a training sequence is cut, None: never; scored texts never are. What follows a cut is no start of a text: it begins in the states' long-run shares.
SEGMENT: int | None = 1024
SEED = 11
#: Weight of the unigram model in each state's emissions, in tokens.
PRIOR = 200.0
#: Documents, and bytes of text, in a chunk, about.
CHUNK_DOCS, CHUNK_TEXT = 4096, 16 << 20
#: Fewest chunks, for each shuffle partition.
CHUNKS_PER_PARTITION = 4


class _Ids(dict):
    """Numbers words as they come."""

    def __missing__(self, word):
        n = self[word] = len(self)
        return n


def tokens(texts) -> tuple[list[np.ndarray], np.ndarray]:
    """Word numbers of each text, and the 64-bit hash of each number's word. Null: no words."""
    ids = _Ids()
    get = ids.__getitem__
    seqs = []
    for text in texts:
        words = (text or "").encode().lower().split()
        seqs.append(np.fromiter(map(get, words), np.int64, len(words)))
    return seqs, np.fromiter((xxhash.xxh64_intdigest(w) for w in ids), np.uint64, len(ids))


@dataclass
class Vocabulary:
    """What is bounded of the counts: N and V, the top words, the counts of the hashed classes and of the end mark."""

    n: float
    v: float
    top: np.ndarray  # hashes of the top words, ascending
    top_counts: np.ndarray
    class_n: np.ndarray  # tokens and distinct words of each hashed class, without top words
    class_v: np.ndarray
    ends: float

    @property
    def symbols(self) -> int:
        return len(self.top) + len(self.class_n) + 1

    def symbol(self, hashes: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(self.top, hashes), max(0, len(self.top) - 1))
        other = len(self.top) + (hashes % np.uint64(len(self.class_n))).astype(np.int64)
        return np.where(self.top[at] == hashes, at, other) if len(self.top) else other

    def unigram(self) -> np.ndarray:
        c = np.r_[self.top_counts, self.class_n, self.ends] + 0.5
        return c / c.sum()

    def within(self, symbol: np.ndarray, counts: np.ndarray) -> np.ndarray:
        """log10 probability of words in their class."""
        g = symbol - len(self.top)
        out = np.zeros(len(symbol))
        own = g >= 0
        g = g[own]
        out[own] = np.log10((counts[own] + 0.5) / (self.class_n[g] + 0.5 * (self.class_v[g] + 1)))
        return out

    def base(self, counts: np.ndarray) -> np.ndarray:
        return np.log10((counts + 0.5) / (self.n + 0.5 * (self.v + 1)))


@dataclass
class Hmm:
    start: np.ndarray
    move: np.ndarray
    emit: np.ndarray  # symbols x states

    @cached_property
    def rest(self) -> np.ndarray:
        """Long-run shares of the states."""
        out = np.full(len(self.start), 1 / len(self.start))
        for _ in range(200):
            out = out @ self.move
        return out / out.sum()


class _Batch:
    """Sequences side by side, longest first: at time t the first width[t] are still running."""

    def __init__(self, seqs: list[np.ndarray], first: np.ndarray | None = None):
        """first: whether a sequence begins a text; without, all do."""
        lens = np.array([len(s) for s in seqs], np.int64)
        self.order = np.argsort(-lens, kind="stable")
        lens = lens[self.order]
        self.first = np.ones(len(seqs), bool) if first is None else np.asarray(first, bool)[self.order]
        steps = int(lens[0]) if len(lens) else 0
        self.width = np.searchsorted(-lens, -np.arange(steps), "left")  # sequences longer than t
        self.at = np.r_[0, np.cumsum(self.width)]
        self.flat = np.zeros(int(lens.sum()), np.int64)
        for r, i in enumerate(self.order):
            self.flat[self.at[: len(seqs[i])] + r] = seqs[i]

    def forward(self, m: Hmm, keep: bool):
        """Natural log likelihood by sequence (in input order); with keep, scaled forward values and scales of all tokens."""
        states = len(m.start)
        log = np.zeros(len(self.order))
        alphas, scales = (np.zeros((len(self.flat), states), np.float32), np.zeros(len(self.flat))) if keep else (None, None)
        a = None
        for t, n in enumerate(self.width):
            s = self.at[t]
            e = m.emit[self.flat[s : s + n]]
            a = (np.where(self.first[:n, None], m.start, m.rest) if a is None else a[:n] @ m.move) * e
            c = a.sum(1)
            a /= c[:, None]
            log[:n] += np.log(c)
            if keep:
                alphas[s : s + n], scales[s : s + n] = a, c
        out = np.zeros(len(log))
        out[self.order] = log
        return out, alphas, scales

    def expected(self, m: Hmm) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
        """Expected starts, moves and emissions, and the log likelihood."""
        log, alphas, scales = self.forward(m, True)
        states = len(m.start)
        moves = np.zeros((states, states))
        after = None  # backward values of the next time
        for t in range(len(self.width) - 1, -1, -1):
            s, n = self.at[t], self.width[t]
            beta = np.ones((n, states))
            if after is not None:
                s2, n2 = self.at[t + 1], self.width[t + 1]
                w = m.emit[self.flat[s2 : s2 + n2]] * after / scales[s2 : s2 + n2, None]
                moves += alphas[s : s + n2].T @ w
                beta[:n2] = w @ m.move.T
            alphas[s : s + n] *= beta  # from here on the posterior of the states
            after = beta
        emits = np.stack([np.bincount(self.flat, alphas[:, k], minlength=len(m.emit)) for k in range(states)], 1)
        return alphas[: self.width[0]][self.first[: self.width[0]]].sum(0, dtype=np.float64) if len(self.width) else np.zeros(states), moves * m.move, emits, float(log.sum())


def first_model(vocabulary: Vocabulary, states: int = STATES, seed: int = SEED) -> Hmm:
    """Sticky states whose emissions are the unigram model, disturbed."""
    rng = np.random.default_rng(seed)
    emit = vocabulary.unigram()[:, None] * np.exp(rng.normal(0, 1.0, (vocabulary.symbols, states)))
    move = np.full((states, states), 0.1 / max(1, states - 1))
    np.fill_diagonal(move, 0.9 if states > 1 else 1.0)
    return Hmm(np.full(states, 1 / states), move, emit / emit.sum(0))


def train(docs: DataFrame, vocabulary: Vocabulary, states: int = STATES, iterations: int = ITERATIONS, seed: int = SEED, segment: int | None = SEGMENT) -> Hmm:
    """Baum-Welch over all rows of docs (text); each iteration is one pass. Exact without a segment; with one, moves over the cuts are not counted."""
    m = first_model(vocabulary, states, seed)
    symbols = vocabulary.symbols
    for _ in range(iterations):

        def count(batches, m=m):
            start, move, emit = np.zeros(states), np.zeros((states, states)), np.zeros((symbols, states))
            for t in chunked(batches, 6 << 20):
                seqs, hashes = tokens(t.column("text").to_pylist())
                known = np.r_[vocabulary.symbol(hashes), symbols - 1]
                parts, first = [], []
                for s in seqs:
                    full = known[np.r_[s, len(hashes)]]
                    at = range(0, len(full), segment or len(full))
                    parts += [full[i : i + (segment or len(full))] for i in at]
                    first += [i == 0 for i in at]
                a, b, c, _ = _Batch(parts, first).expected(m)
                start += a
                move += b
                emit += c
            yield pa.RecordBatch.from_arrays([pa.array([np.concatenate([start, move.ravel(), emit.ravel()]).tobytes()], pa.binary())], ["v"])

        total = add_up(docs.select("text").mapInArrow(count, "v binary"), states + states * states + symbols * states)
        start, move, emit = total[:states], total[states : states + states * states].reshape(states, states), total[states + states * states :].reshape(symbols, states)
        emit = emit + PRIOR * vocabulary.unigram()[:, None]
        m = Hmm((start + 1) / (start + 1).sum(), (move + 1) / (move + 1).sum(1, keepdims=True), emit / emit.sum(0))
    return m


_ASKED = "bucket int, chunk int, hashes binary, counts binary"
_TOLD = "kind int, chunk int, hashes binary, counts binary"


def in_turn(batches: Iterator[pa.RecordBatch], key: str = "bucket") -> Iterator[tuple[int, Iterator[pa.Table]]]:
    """Of rows sorted by key: each key with its rows, in tables of bounded size. The rows of one are to be taken before the next."""
    parts = ((k, t) for table in chunked(batches) for k, t in _cut(table, key))
    return ((k, (t for _, t in group)) for k, group in groupby(parts, itemgetter(0)))


def _cut(table: pa.Table, key: str) -> Iterator[tuple[int, pa.Table]]:
    keys = table.column(key).to_numpy()
    cuts = [0, *(np.flatnonzero(np.diff(keys)) + 1).tolist(), len(keys)]
    return ((int(keys[a]), table.slice(a, b - a)) for a, b in zip(cuts, cuts[1:]))


def _ask(batches, n):
    """Each chunk's distinct words, with how often its training documents have them; each training document counts one end mark."""
    for chunk, tables in in_turn(batches):
        ids, counts, ends = {}, np.zeros(0, np.int64), 0
        for t in tables:
            seqs, hashes = tokens(t.column("text").to_pylist())
            training = ~np.array(t.column("held_out").to_pylist(), bool)
            used = [s for s, x in zip(seqs, training) if x]
            own = np.bincount(np.concatenate(used), minlength=len(hashes)) if used else np.zeros(len(hashes), np.int64)
            at = np.fromiter((ids.setdefault(h, len(ids)) for h in hashes.tolist()), np.int64, len(hashes))
            counts = np.r_[counts, np.zeros(len(ids) - len(counts), np.int64)]
            np.add.at(counts, at, own)
            ends += int(training.sum())
        hashes = np.fromiter(ids, np.uint64, len(ids))
        rows = [(b, chunk, hashes[at].tobytes(), counts[at].tobytes()) for b, at in bucketed(hashes, n)]
        rows.append((chunk % n, -1, b"", np.array([ends], np.int64).tobytes()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["bucket", "chunk", "hashes", "counts"])


def _answer(batches, top_words, classes):
    """For each bucket of words: the counts, to each chunk that asked (kind 0); its most frequent words (1); sums by class, of tokens, words and end marks (2)."""
    out = []

    def send(kind, chunk, hashes, counts):
        out.append((kind, chunk, hashes.tobytes(), counts.tobytes()))

    for t in by_bucket(batches):
        asked, ends = [], 0
        for chunk, h, c in zip(t.column("chunk").to_pylist(), t.column("hashes").to_pylist(), t.column("counts").to_pylist()):
            if chunk < 0:
                ends += int(np.frombuffer(c, np.int64)[0])
            else:
                asked.append((chunk, np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)))
        if asked:
            words, back = np.unique(np.concatenate([h for _, h, _ in asked]), return_inverse=True)
            total = np.bincount(back, np.concatenate([c for _, _, c in asked])).astype(np.int64)
        else:
            words, back, total = np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
        done = 0
        for chunk, h, _ in asked:
            send(0, chunk, h, total[back[done : done + len(h)]])
            done += len(h)
        known = total > 0
        best = np.argsort(-total, kind="stable")[:top_words]
        send(1, 0, words[best], total[best])
        g = (words[known] % np.uint64(classes)).astype(np.int64)
        send(2, 0, np.zeros(0, np.uint64), np.r_[np.bincount(g, total[known], minlength=classes), np.bincount(g, minlength=classes), ends].astype(np.float64))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out), (pa.int32(), pa.int32(), pa.binary(), pa.binary()))], ["kind", "chunk", "hashes", "counts"])
        out.clear()


def _best(batches, top_words):
    """The most frequent of several lists."""
    h, c = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for b in batches:
        for x, y in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            h.append(np.frombuffer(x, np.uint64))
            c.append(np.frombuffer(y, np.int64))
            if len(h) > 64:
                h, c = _merge(h, c, top_words)
    h, c = _merge(h, c, top_words)
    yield pa.RecordBatch.from_arrays([pa.array([h[0].tobytes()], pa.binary()), pa.array([c[0].tobytes()], pa.binary())], ["hashes", "counts"])


def _merge(h, c, top_words):
    h, c = np.concatenate(h), np.concatenate(c)
    at = np.lexsort((h, -c))[:top_words]
    return [h[at]], [c[at]]


def chunk_of(docs: DataFrame):
    """Number of a document's chunk: by id and text, so that null and repeated ids are spread like others; rows alike in both share one."""
    rows, size = docs.agg(F.count("*"), F.coalesce(F.sum(F.octet_length("text").cast("long")), F.lit(0))).first()
    n = max(CHUNKS_PER_PARTITION * partitions(docs.sparkSession), -(-rows // CHUNK_DOCS), -(-size // CHUNK_TEXT))
    return F.pmod(F.xxhash64("doc_id", "text"), F.lit(n)).cast("int")


def score(docs: DataFrame, held_out, states: int = STATES, top_words: int = TOP_WORDS, classes: int = HASHED_CLASSES, iterations: int = ITERATIONS, segment: int | None = SEGMENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score and score for every row of docs.

    held_out: a boolean column of docs; the model learns from the other rows. base_score is of the smoothed
    unigram model, score of the hidden Markov model, both log10. Null text: empty, just the end mark.
    Repeated rows, and rows with null or repeated doc_ids, count as often as they occur; where held_out is null a row
    is learned from. Extra columns are ignored. segment: see SEGMENT.
    """
    n = partitions(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", F.coalesce(held_out, F.lit(False)).alias("held_out"))
    dealt = docs.withColumn("bucket", chunk_of(docs))
    asked = exchange(dealt.select("bucket", "text", "held_out"), n).mapInArrow(lambda it: _ask(it, n), _ASKED)
    asked, p_asked = settle(asked)
    told, _ = settle(exchange(asked, n).mapInArrow(lambda it: _answer(it, top_words, classes), _TOLD), p_asked)
    sums = add_up(told.where("kind = 2").select(F.col("counts").alias("v")), 2 * classes + 1)
    top = told.where("kind = 1").select("hashes", "counts").repartition(16).mapInArrow(lambda it: _best(it, top_words), "hashes binary, counts binary").collect()
    h, c = _merge([np.frombuffer(r.hashes, np.uint64) for r in top] or [np.zeros(0, np.uint64)], [np.frombuffer(r.counts, np.int64) for r in top] or [np.zeros(0, np.int64)], top_words)
    h, c = h[0][c[0] > 0], c[0][c[0] > 0]
    class_n, class_v, ends = sums[:classes].copy(), sums[classes : 2 * classes].copy(), sums[-1]
    total_n, total_v = class_n.sum() + ends, class_v.sum() + (ends > 0)
    g = (h % np.uint64(classes)).astype(np.int64)
    np.subtract.at(class_n, g, c)
    np.subtract.at(class_v, g, 1)
    order = np.argsort(h)
    vocabulary = Vocabulary(float(total_n), float(total_v), h[order], c[order].astype(np.float64), class_n, class_v, float(ends))
    model = train(docs.where(~F.col("held_out")), vocabulary, states, iterations, segment=segment)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, tables in in_turn(batches):
            asked: list[tuple[np.ndarray, np.ndarray]] = []
            known = None
            for t in tables:
                replies = t.filter(pc.is_null(t.column("held_out")))  # these come before the texts
                for h, c in zip(replies.column("hashes").to_pylist(), replies.column("counts").to_pylist()):
                    asked.append((np.frombuffer(h, np.uint64), np.frombuffer(c, np.int64)))
                texts = t.filter(pc.is_valid(t.column("held_out")))
                if not texts.num_rows:
                    continue
                if known is None:
                    h = np.concatenate([np.zeros(0, np.uint64), *(a for a, _ in asked)])
                    order = np.argsort(h)
                    known = h[order], np.concatenate([np.zeros(0, np.int64), *(c for _, c in asked)])[order]
                yield from scored(texts, *known).to_batches()

    def scored(left: pa.Table, got_h: np.ndarray, got_c: np.ndarray) -> pa.Table:
        seqs, hashes = tokens(left.column("text").to_pylist())
        counts = np.zeros(len(hashes) + 1)
        if len(hashes):
            counts[:-1] = got_c[np.searchsorted(got_h, hashes)]
        counts[-1] = vocabulary.ends
        symbol = np.r_[vocabulary.symbol(hashes), vocabulary.symbols - 1]
        within, base = vocabulary.within(symbol[:-1], counts[:-1]), vocabulary.base(counts)
        within = np.r_[within, 0.0]
        full = [np.r_[s, len(hashes)] for s in seqs]
        log, _, _ = _Batch([symbol[s] for s in full]).forward(model, False)
        size = np.array([len(s) for s in full], np.int64)
        cut = np.r_[0, np.cumsum(size)[:-1]]
        every = np.concatenate(full)
        by_text = lambda x: np.add.reduceat(x[every], cut)
        return pa.Table.from_arrays(
            [left.column("doc_id"), left.column("held_out"), pa.array(size), pa.array(by_text((counts > 0).astype(np.int64))), pa.array(np.full(len(size), int(vocabulary.n))), pa.array(by_text(base)), pa.array(log / np.log(10) + by_text(within))],
            ["doc_id", "held_out", "n_tokens", "n_known", "train_tokens", "base_score", "score"],
        )

    none = lambda kind: F.lit(None).cast(kind)
    replies = told.where("kind = 0").select(F.col("chunk").alias("bucket"), none("long").alias("doc_id"), none("string").alias("text"), none("boolean").alias("held_out"), "hashes", "counts")
    texts = dealt.select("bucket", "doc_id", "text", "held_out", none("binary").alias("hashes"), none("binary").alias("counts"))
    both = exchange(replies.unionByName(texts), n).sortWithinPartitions("bucket", F.col("held_out").asc_nulls_first())
    return both.mapInArrow(run, "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double")
