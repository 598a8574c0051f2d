"""Bit-sliced search, Merkle manifest and whitening against brute-force versions and on awkward tables."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter
from fractions import Fraction

import duckdb
import numpy as np
import pytest
import xxhash

pytest.importorskip("tesserae.llm.queries")
from tesserae.llm import bitslices, divergence, merkle, queries, simhash, whitening  # noqa: E402
from pyspark.sql import functions as F  # noqa: E402

VECTORS = "vec_id long, embedding array<double>, rank int, score string, block string, n string"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, tree string, pos string, leaf string"
RNG = np.random.default_rng(3)


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, 1, "s", "b", "n") for i, v in rows], VECTORS)


AWKWARD = [
    *((i, RNG.normal(0, 0.2, 6).tolist()) for i in range(90)),
    *((i, [0.5, -0.25, 0.0, -0.0, 0.125, 1.0]) for i in range(100, 160)),
    (160, None), (161, [None, 1.0]), (162, [float("nan")] * 6), (163, [float("inf")] * 6), (164, [0.0] * 6), (165, []), (180, [0.5, 0.25]), (200, [-9.0] * 6), (40, [9.0] * 6), (None, [1.0] * 6),
    (100, [0.5, -0.25, 0.0, -0.0, 0.125, 1.0]),
]


def taken(rows, scale):
    return [(i, [int(np.floor(scale * c)) for c in v]) for i, v in rows if v is not None and all(c is not None and np.isfinite(c) for c in v)]


# 11


def brute_top(rows, k=20):
    best = {}
    for i, x in taken(rows, 64):
        if i is not None and (i not in best or x < best[i]):
            best[i] = x
    out = []
    for q in (i for i in best if i % 20 == 0):
        scored = sorted((-sum(a * b for a, b in zip(best[q], x)), i) for i, x in best.items() if i != q)
        out += [(q, r, i, -s) for r, (s, i) in enumerate(scored[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("shard", [64, 1 << 16])
def test_top_k(spark, monkeypatch, shard):
    monkeypatch.setattr(bitslices, "SHARD_ROWS", shard)
    got = sorted(tuple(r) for r in bitslices.search(vectors(spark, AWKWARD), F.col("vec_id") % 20 == 0).collect())
    assert got == brute_top(AWKWARD)


def test_top_k_of_few_none_and_huge(spark):
    few = [(20, [1.0, 2.0]), (21, [3.0, -1.0])]
    assert sorted(map(tuple, bitslices.search(vectors(spark, few), F.col("vec_id") % 20 == 0).collect())) == brute_top(few) == [(20, 1, 21, 64 * 64)]
    for rows in ([], [(20, [1.0])], [(1, [1.0]), (2, [2.0])], [(20, None)]):
        assert bitslices.search(vectors(spark, rows), F.col("vec_id") % 20 == 0).count() == 0
    huge = [(20, [1e15, 1.0]), *((i, [1e15 * (1 + i % 3), float(i)]) for i in range(21, 50)), (60, [-1e15, 0.0])]
    got = [tuple(r) for r in bitslices.search(vectors(spark, huge), F.col("vec_id") % 20 == 0).collect()]
    assert [r[1:] for r in sorted(got) if r[0] == 20] == [(k + 1, v, (1 << 63) - 1) for k, v in enumerate(range(21, 41))]


def test_top_k_scores_of_any_range():
    ids = np.arange(0, 700, 7)
    x = RNG.integers(-(2**40), 2**40, (100, 9))
    x[:, 3], x[:, 4] = 5, 0
    index = bitslices.Index.unpacked(*bitslices.Index.build(ids[::-1].copy(), x[::-1].copy()).packed())
    for q in RNG.integers(-(2**20), 2**20, (20, 9)).tolist():
        found = sorted(zip(*reversed([v.tolist() if hasattr(v, "tolist") else v for v in index.top(q, 14, 7)])), key=lambda r: (-r[0], r[1]))
        want = sorted(((sum(a * b for a, b in zip(q, r)), i) for i, r in zip(ids.tolist(), x.tolist()) if i != 14), key=lambda r: (-r[0], r[1]))[:7]
        assert found == want


# 12


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def brute_merkle(rows):
    """rows: (doc_id, text, lang, source, n_chars)."""

    def leaf(doc_id, text, lang, source, n_chars):
        fields = ["-" if v is None else f"{len(str(v).encode())}:{v}" for v in (doc_id, source, lang, n_chars, text)]
        return sha("".join(fields))

    def tree(leaves):
        levels = [leaves]
        while len(levels[-1]) > 1:
            levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
        return levels

    def siblings(levels, pos):
        out = []
        for nodes in levels[:-1]:
            run = nodes[pos // 16 * 16 : pos // 16 * 16 + 16]
            out.append((run[: pos % 16], run[pos % 16 + 1 :]))
            pos //= 16
        return out

    by = {}
    for r in rows:
        by.setdefault(r[3], []).append(r)
    order = sorted(by, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: tree([leaf(*r) for r in sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))]) for s in order}
    top = tree([trees[s][-1][0] for s in order])
    out = []
    for k, s in enumerate(order):
        for pos, r in enumerate(sorted(by[s], key=lambda r: (r[0] is not None, r[0] or 0, leaf(*r)))):
            path = siblings(trees[s], pos) + siblings(top, k)
            at = leaf(*r)
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[1] is not None:
                at = leaf(r[0], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[1]), *r[2:])
            for left, right in path:
                at = sha("".join([*left, at, *right]))
            root = top[-1][0]
            out.append((r[0], leaf(*r), trees[s][-1][0], root, sha("".join("".join([*left, *right]) for left, right in path)), at, at == root))
    return Counter(out)


def documents(n, sources, seed=0):
    r = random.Random(seed)
    texts = [None, "", "É", "plain", "Upper Case", "ZZ" * 3000, "a\nb\0c", "日本"]
    ids = r.sample(range(-5, 10 * n + 5), n)
    return [(i, r.choice(texts), r.choice(["en", None]), r.choice(sources), r.choice([None, 3, -1])) for i in ids]


def docs_table(spark, rows):
    return spark.createDataFrame([(*r, "t", "p", "l") for r in rows], DOCS)


@pytest.mark.parametrize("levels", [1, 2, 3])
def test_merkle(spark, levels):
    hot = [*["hot"] * 9, None, "", "é", "Z", "-", "=", *(f"s{i}" for i in range(20))]
    rows = documents(700, hot) + [(None, "Null Id", "en", "hot", 1), (None, "Null Id", "en", "hot", 1), (7, "A", "en", "hot", 1), (7, "A", "en", "hot", 1), (7, "B", None, "hot", None), (9, "Alone", "en", "alone", 2)]
    got = Counter(tuple(r) for r in merkle.verified(merkle.proofs(docs_table(spark, rows), levels)).collect())
    assert got == brute_merkle(rows)
    assert {r[-1] for r in got} == {True, False}


def test_merkle_small_tables(spark):
    for rows in ([], [(5, "One", "en", None, 3)], documents(2, ["a"]), documents(16, ["a"]), documents(17, ["a"]), documents(20, [f"s{i}" for i in range(400)])):
        got = Counter(tuple(r) for r in merkle.verified(merkle.proofs(docs_table(spark, rows))).collect())
        assert got == (brute_merkle(rows) if rows else Counter())


@pytest.mark.parametrize("n", [1, 2, 15, 16, 17, 256, 257, 700, 4096])
def test_traverse(n):
    leaves = [sha(str(i)) for i in range(n)]
    h = merkle.height(n, 3)
    levels = [leaves]
    for _ in range(h):
        levels.append([sha("".join(levels[-1][i : i + 16])) for i in range(0, len(levels[-1]), 16)])
    assert merkle.block_node(leaves, h) == levels[-1][0] and len(levels[-1]) == 1
    for p, path in enumerate(merkle.traverse(leaves, h)):
        at = leaves[p]
        for k, (left, right) in enumerate(path):
            run = levels[k][p // 16**k // 16 * 16 :][:16]
            assert left + at + right == "".join(run)
            at = sha(left + at + right)
        assert at == levels[-1][0]


# 13


def check_whitening(rows, got, k=4, tolerance=1e-6):
    x = taken(rows, 256)
    d = max((len(v) for _, v in x), default=0)
    x = [(i, (*v, *[0] * (d - len(v)))) for i, v in x]
    fit = sorted({v for _, v in x})
    n, s = len(fit), [sum(v[j] for v in fit) for j in range(d)]
    k = min(k, d)
    assert len(got) == k * len(x)
    m = [[n * sum(v[a] * v[b] for v in fit) - s[a] * s[b] for b in range(d)] for a in range(d)]
    trace = sum(m[j][j] for j in range(d))
    by = {}
    for r in got:
        by.setdefault(r["vec_id"], {}).setdefault(r["component"], []).append(r)
    for i, v in x:
        dev = sum((n * v[j] - s[j]) ** 2 for j in range(d))
        for c in range(1, k + 1):
            assert any(r["deviation_text"] == str(dev) and r["deviation"] == (dev if dev < 1 << 63 else None) and r["n"] == n for r in by[i][c])
    z = {}
    for i, v in x:
        z[v] = [by[i][c][0]["whitened"] for c in range(1, k + 1)] if len(by[i][1]) == 1 else z.get(v)
    z = [w for w in z.values() if w is not None]
    one = next(iter(by.values()))
    explained = [one[c][0]["explained"] for c in range(1, k + 1)]
    error = {r["identity_error"] for r in got}
    assert len(error) == 1
    live = [c for c in range(k) if explained[c]]
    if len(z) == n and live:
        w = np.array([[r[c] for c in live] for r in z])
        w = w - w.mean(0)
        off = np.abs(w.T @ w / n - np.eye(len(live))).max()
        assert off < tolerance and next(iter(error)) < tolerance
    return explained, trace, m


def test_whitening(spark):
    got = whitening.whiten(vectors(spark, AWKWARD)).collect()
    explained, trace, m = check_whitening(AWKWARD, got)
    values = np.linalg.eigvalsh(np.array(m, float))[::-1][:4]
    assert np.allclose(explained, values / trace, rtol=1e-9)


@pytest.mark.parametrize("shape", ["offset", "outlier", "outlier row", "scaled", "two far rows", "whole offset"])
def test_whitening_of_hard_tables(spark, shape):
    x = RNG.normal(0, 0.125, (120, 12))
    if shape == "offset":
        x += 1e6
    elif shape == "outlier":
        x[7, 3] = 1e12
    elif shape == "outlier row":
        x[7] = 1e13
    elif shape == "scaled":
        x *= 10.0 ** np.arange(12)
    elif shape == "two far rows":
        x[7], x[9] = 1e14, [0, *[1e9] * 11]
    else:
        x[:, 0] += 1e13
    rows = list(enumerate(x.tolist()))
    explained, trace, m = check_whitening(rows, whitening.whiten(vectors(spark, rows)).collect())
    # Eigenvalues over a bound are counted exactly, by the signs of pivots in fractions.
    for c, e in enumerate(explained):
        assert above(m, Fraction(e) * trace * Fraction(10001, 10000)) <= c < above(m, Fraction(e) * trace * Fraction(9999, 10000))


def above(m, t):
    """Eigenvalues of an exact symmetric matrix over t: positive pivots of m - t."""
    a = [[Fraction(v) - (t if i == j else 0) for j, v in enumerate(r)] for i, r in enumerate(m)]
    n = 0
    for k in range(len(a)):
        n += a[k][k] > 0
        for i in range(k + 1, len(a)):
            f = a[i][k] / a[k][k]
            for j in range(k, len(a)):
                a[i][j] -= f * a[k][j]
    return n


def test_whitening_of_few_and_none(spark):
    for rows in ([], [(1, None)], [(1, [])]):
        assert whitening.whiten(vectors(spark, rows)).count() == 0
    one = whitening.whiten(vectors(spark, [(1, [1.0, 2.0]), (2, [1.0, 2.0])])).collect()
    assert {(r["n"], r["deviation"], r["whitened"], r["explained"], r["identity_error"]) for r in one} == {(1, 0, None, None, None)} and len(one) == 4
    line = [(i, [float(i), 2.0 * i, 0.0]) for i in range(9)]
    got = whitening.whiten(vectors(spark, line)).collect()
    check_whitening(line, got)
    assert {r["component"] for r in got if r["whitened"] is None} == {2, 3}


def test_whitening_sums_are_exact():
    x = RNG.integers(-(2**62), 2**62, (300, 5))
    assert (whitening.cross(x) == x.astype(object).T.dot(x.astype(object))).all()
    v = np.array([0, -1, 1 << 200, -(1 << 77)], object)
    assert (whitening.unpacked(whitening.packed(v)) == v).all()


# 1 and 6: second computations


def words_of(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


MIXED = [None, "", " \t\n", "one two three four five six seven eight nine ten", "a b c d e " * 6, "x\ny\nx\n\n \nx", "#*$%&|<> é\u00a0日本 a\u2028b", "Aa " * 3000, "q\x0bw\x1ce\x85r\x0c\r\n t\r\n", "The cat sat on the mat. " * 30, *(" ".join(RNG.choice(list("abcdef"), int(n))) for n in RNG.integers(0, 400, 25))]


def brute_base(text):
    words, lines, seen, dup = words_of(text), (text or "").split("\n"), set(), 0
    for line in lines:
        if words_of(line):
            dup += line in seen
            seen.add(line)
    windows = Counter(tuple(words[i : i + 5]) for i in range(len(words) - 4))
    repeated = sum(any(windows[tuple(words[j : j + 5])] > 1 for j in range(max(0, i - 4), min(i, len(words) - 5) + 1)) for i in range(len(words)))
    n = len(words)
    return n, sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), dup, repeated, n < 10 or 100 * repeated > 20 * n


def test_divergence_base_columns_and_distances(spark):
    """All base columns, both distances and the verdict of the query's operator against plain recounts."""
    texts = [*MIXED, *(" ".join(RNG.choice(["the", "of", "river", "and", "stone,", "Quiet", "to"], 150)) for _ in range(6)), "zq#" * 400 + " w" * 80]
    df = spark.createDataFrame([(i, t, "en" if i % 3 else "fr", 1) for i, t in enumerate(texts)], "doc_id long, text string, lang string, kept int")
    got = {r["doc_id"]: r for r in divergence.judge(df).collect()}
    assert len(got) == len(texts)
    common = sorted({w for ws in divergence.COMMON_WORDS.values() for w in ws})

    def histograms(text):
        groups = [" \t", "\n\r\x0b\x0c", *("".join(map(chr, range(a, a + 26))) for a in (65, 97)), "0123456789", ".,;:!?'\"()-", "#*$%&|<>=+@^~_{}[]\\/`"]
        chars = Counter(next((k for k, g in enumerate(groups) if c in g), 7 if ord(c) < 128 else 8) for c in text)
        plain = "".join(c for c in text if c not in ".,;:!?")
        words = Counter(w if w in common else "" for w in ("".join(c.lower() if c.isascii() else c for c in w) for w in words_of(plain)))
        return [chars[k] for k in range(9)], [words[w] for w in [*common, ""]]

    def distance(a, b):
        if not sum(a) or not sum(b):
            return 1.0
        p, q = [x / sum(a) for x in a], [x / sum(b) for x in b]
        kl = lambda u: sum(x * math.log2(2 * x / (x + y)) for x, y in zip(u, q if u is p else p) if x)
        return math.sqrt(max(0.0, (kl(p) + kl(q)) / 2))

    made = [histograms(t or "") for t in texts]
    long = [sum(c) >= divergence.MIN_CHARS and sum(w) >= divergence.MIN_WORDS_JUDGED for c, w in made]
    refs = [([sum(made[i][0][k] for i in mine) for k in range(9)], [sum(made[i][1][k] for i in mine) for k in range(len(common) + 1)]) for mine in ([i for i in range(len(texts)) if long[i] and (i % 3 > 0) == en] for en in (True, False))]
    for i, t in enumerate(texts):
        r, base = got[i], brute_base(t)
        assert tuple(r[c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed")) == base, i
        if not long[i]:
            assert r["char_distance"] is None and r["kept"] == (not base[5])
            continue
        both = min(((distance(made[i][0], c), distance(made[i][1], w)) for c, w in refs), key=sum)
        assert abs(r["char_distance"] - both[0]) < 1e-6 and abs(r["word_distance"] - both[1]) < 1e-6
        assert r["kept"] == (not base[5] and both[0] <= divergence.MAX_CHAR_DISTANCE and both[1] <= divergence.MAX_WORD_DISTANCE)


def test_fingerprints_against_bits(spark):
    def brute(text):
        words = ["".join(c.lower() if "A" <= c <= "Z" else c for c in w) for w in words_of(text)]
        if not words:
            return "0" * 16
        shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or [" ".join(words)]
        hashes = [xxhash.xxh64(s.encode(), seed=42).intdigest() for s in shingles]
        return f"{sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)):016x}"

    df = spark.createDataFrame(list(enumerate([*MIXED, "ÉCOLE École", "A a A", "w " * 9000])), "doc_id long, text string")
    for r, t in zip(simhash.near_duplicates(df).orderBy("doc_id").collect(), [*MIXED, "ÉCOLE École", "A a A", "w " * 9000]):
        assert r["fingerprint"] == brute(t)


# SQL


@pytest.mark.parametrize("name", list(queries.ORACLE_SQL))
def test_sql(spark, name):
    data = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "embeddings", "pages"):
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{data}/{t}.parquet'")
    df = queries.QUERIES[name](spark, data)
    cols = sorted(df.columns)
    got = con.execute(queries.ORACLE_SQL[name])
    names = [d[0] for d in got.description]
    assert sorted(names) == cols
    assert Counter(tuple(r[c] for c in cols) for r in df.collect()) == Counter(tuple(r[names.index(c)] for c in cols) for r in got.fetchall())
