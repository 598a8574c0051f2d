"""The text operators against brute-force versions and on awkward tables."""

import hashlib
import itertools
import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
import xxhash
from pyspark.sql import functions as F

pytest.importorskip("tesserae.llm.queries")
from tesserae.llm import common, divergence, hmm, language, neighbours, packing, pieces, queries, resampling, shingles, simhash, suffixes, urls  # noqa: E402

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, weight int, bucket string, kept string"


def table(spark, texts, ids=None):
    """A table of texts with extra columns whose names clash with the operators' own."""
    ids = range(len(texts)) if ids is None else ids
    rows = [(i, t, "en" if t and "the" in t else "fr" if t else None, None, len(t) if t else None, 1, "b", "k") for i, t in zip(ids, texts)]
    return spark.createDataFrame(rows, SCHEMA)


RNG = np.random.default_rng(1)
WORDS = ["the", "of", "and", "le", "la", "des", "soleil", "river", "mountain", "maison", "quiet", "yellow", "bientôt", "stone"]


def prose(n, words=WORDS):
    return " ".join(RNG.choice(words, n))


LONG = prose(30_000)
SHARED = prose(40)
AWKWARD = [None, "", " ", "a", "日本語のテキスト", "the the the", SHARED, SHARED, SHARED + " x", prose(80) + SHARED + prose(30), prose(15) + "\n" + SHARED, LONG, LONG[:50_000], "x" * 300, "x" * 120, "é" * 200, "1234 5678", "a\nb\na\nb\n" * 30]
IDS = [*range(len(AWKWARD)), 3, None, None]
TEXTS = [*AWKWARD, "a", SHARED, "null id"]


@pytest.fixture(scope="module")
def awkward(spark):
    return table(spark, TEXTS, IDS)


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


# 1


def test_divergence(awkward, none):
    rows = divergence.judge(awkward).collect()
    assert len(rows) == len(TEXTS)
    by = {r["doc_id"]: r for r in rows}
    assert by[0]["base_failed"] and not by[0]["kept"] and by[0]["n_words"] == 0
    assert by[17]["n_dup_lines"] == 118 and by[17]["base_failed"]
    assert by[4]["word_chars"] == 8
    assert divergence.judge(none).count() == 0


def test_divergence_rejects_other_distributions(spark):
    good = [prose(200, divergence.COMMON_WORDS["en"] + ["river", "stone", "quiet"]) + f" {i}" for i in range(40)]
    bad = " ".join(f"q{i}#|%$ 77x{i}" for i in range(200))
    got = {r["doc_id"]: r["kept"] for r in divergence.judge(spark.createDataFrame([(i, t, "en") for i, t in enumerate([*good, bad])], "doc_id long, text string, lang string")).collect()}
    assert not got[40] and sum(got.values()) >= 36


def test_divergence_learns_languages_of_the_table(spark):
    """A language without a list gets one from its documents; rare and blank ones don't, and texts of other distributions still go."""
    italian = "il lo la di che e un per con non sono del alla si come ma anche dal nel questo".split()
    others = ["fiume", "montagna", "quieto", "giallo", "pietra", "casa", "strada", "lettera", "vento"]
    share = [0.6 / len(italian)] * len(italian) + [0.4 / len(others)] * len(others)
    text = lambda: " ".join(RNG.choice([*italian, *others], 150, p=share)) + ". " + " ".join(RNG.choice([*italian, *others], 50, p=share)).capitalize()
    rows = [(text(), "it") for _ in range(60)] + [(prose(150, divergence.COMMON_WORDS["en"] + ["river", "stone"]), "en") for _ in range(30)]
    rows += [(" ".join(f"q{i}#|%$ 77x{i}" for i in range(200)), "it"), (text(), "rare"), (text(), " "), (text(), None), ("corto", "it"), (None, "it")]
    df = spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "doc_id long, text string, lang string")
    lists = divergence.word_lists(df)
    assert set(lists) == {*divergence.COMMON_WORDS, "it"}
    counts = Counter(w.strip(".").lower() for t, lang in rows if lang == "it" and t for w in t.split() if "#" not in w)
    counts.update(f"77x{i}" for i in range(200))
    counts.update(f"q{i}#|%$" for i in range(200))
    assert lists["it"] == sorted(counts, key=lambda w: (-counts[w], w))[: divergence.LEARNED_WORDS]
    got = {r["doc_id"]: r for r in divergence.judge(df).collect()}
    assert all(got[i]["kept"] for i in range(90)) and not got[90]["kept"]
    assert all(got[i]["kept"] and got[i]["word_distance"] is not None for i in (91, 92, 93)) and got[94]["word_distance"] is None
    fixed = {r["doc_id"]: r["kept"] for r in divergence.judge(df, lists=divergence.COMMON_WORDS).collect()}
    assert not any(fixed[i] for i in range(60))
    assert divergence.word_lists(df.where("lang = 'en'")) == divergence.COMMON_WORDS


# 2


def brute_suffix(rows, length=50):
    first = {}
    for i, t in sorted((r for r in rows if r[0] is not None), key=lambda r: r[0]):
        b = (t or "").encode()
        for p in range(len(b) - length + 1):
            first.setdefault(b[p : p + length], i)
    out = []
    for i, t in rows:
        b = (t or "").encode()
        gone = np.zeros(len(b), bool)
        if i is not None:
            for p in range(len(b) - length + 1):
                if first[b[p : p + length]] < i:
                    gone[p : p + length] = True
        spans = int((gone & ~np.r_[False, gone[:-1]]).sum()) if len(b) else 0
        out.append((i, len(b), int(gone.sum()), spans, hashlib.sha256(bytes(np.frombuffer(b, np.uint8)[~gone])).hexdigest()))
    return Counter(out)


def test_suffixes(awkward, none):
    got = Counter(tuple(r) for r in suffixes.remove_repeats(awkward).collect())
    assert got == brute_suffix(list(zip(IDS, TEXTS)))
    assert suffixes.remove_repeats(none).count() == 0


def test_suffixes_many_small_alphabet(spark):
    texts = ["".join(RNG.choice(list("ab"), int(RNG.integers(0, 400)))) + ("ab" * 60 if k % 3 else "") for k in range(60)]
    ids = [int(x) for x in RNG.permutation(60)]
    got = Counter(tuple(r) for r in suffixes.remove_repeats(table(spark, texts, ids)).collect())
    assert got == brute_suffix(list(zip(ids, texts)))


def test_suffixes_in_pieces(spark, monkeypatch):
    """Long documents are worked on in pieces, several in a chunk; repeats straddle their seams."""
    texts = [prose(400), prose(3000), prose(50), prose(2500)]
    texts.append(texts[1][3000:9000] + prose(20) + texts[3][100:5000] + texts[0])
    texts += [texts[4], texts[1][::-1], texts[4][500:], "", None]
    ids = [40, 7, 3, 12, 5, 60, 8, 9, 1, 2]
    for piece in (512, 4000):
        part = table(spark, texts, ids).coalesce(1)
        rows = [dict(doc_id=i, text=t, _whole=[], _looked=[], _windows=[], _copy=False) for i, t in zip(ids, texts)]
        import pyarrow as pa

        # The steps of remove_repeats on one task, so that PIECE can be set.
        monkeypatch.setattr(suffixes, "PIECE", piece)
        full = pa.Table.from_pylist(rows, pa.schema([("doc_id", pa.int64()), ("text", pa.string()), *((c, pa.list_(pa.int64())) for c in ("_whole", "_looked", "_windows")), ("_copy", pa.bool_())]))
        t = full.filter(pa.array([bool(x) and len(x) >= 50 for x in texts]))

        def listed(found, kind, name="names"):
            by = defaultdict(list)
            for d, x, k in found:
                if k == kind:
                    by[d].append(x)
            return pa.array([by[d] for d in t.column("doc_id").to_pylist()], pa.list_(pa.int64()))

        def found(batches):
            return [tuple(r.values()) for b in batches for r in b.to_pylist()]

        def in_order(batches, *keys):
            whole = pa.Table.from_batches(list(batches))
            cuts = whole.sort_by([(k, "ascending") for k in keys]).to_batches(max_chunksize=97)
            return cuts

        one = found(suffixes._filter_rank(in_order(suffixes._filter_send(t.to_batches(), 3, 50), "bucket")))
        two = found(suffixes._rerank(in_order(suffixes._runs_send(t.append_column("names", listed(one, 0)).to_batches(), 3, 50), "key", "name", "doc_id"), 0, False))
        three = found(suffixes._rerank(in_order(suffixes._windows_send(t.append_column("names", listed(two, 1)).to_batches(), 3, 50), "key", "name", "doc_id"), 2, True))
        t = full
        for c, k in (("_whole", 0), ("_looked", 1), ("_windows", 2)):
            t = t.set_column(t.schema.get_field_index(c), c, listed(two + three, k))
        got = Counter(tuple(r.values()) for b in suffixes._cut(t.to_batches(), 50, ("doc_id",), None) for r in b.to_pylist())
        assert got == brute_suffix(list(zip(ids, texts)))
        assert got == Counter(tuple(r) for r in suffixes.remove_repeats(part).collect())


def test_suffixes_of_a_long_document_take_bounded_memory():
    """What a task needs for one document of 50 MB, against the bytes of its text."""
    import tracemalloc

    import pyarrow as pa

    data = np.random.default_rng(3).integers(97, 123, 50 << 20, np.uint8)
    t = pa.table({"doc_id": [1], "text": pa.array([data.tobytes()], pa.large_binary()).cast(pa.large_string())})
    tracemalloc.start()
    for _ in suffixes._filter_send(t.to_batches(), 64, 50):
        pass
    assert tracemalloc.get_traced_memory()[1] < 300 << 20
    empty = pa.array([[]], pa.list_(pa.int64()))
    one = pa.array([[1]], pa.list_(pa.int64()))
    for c, x in (("_whole", one), ("_looked", empty), ("_windows", empty), ("_copy", pa.array([False]))):
        t = t.append_column(c, x)
    tracemalloc.reset_peak()
    (out,) = suffixes._cut(t.to_batches(), 50, ("doc_id",), None)
    assert out.column("n_removed").to_pylist() == [0] and tracemalloc.get_traced_memory()[1] < 300 << 20
    tracemalloc.stop()


# 3


def test_url_rules(spark):
    cases = {
        "http://A.org/x?y": ("a.org", "/x", "org/", "allow"),
        "https://www.example.org/es/1": ("www.example.org", "/es/1", "example.org/es/", "block"),
        "https://example.org/en/12": ("example.org", "/en/12", "example.org/en/1", "block"),
        "http://notexample.org/es/1": ("notexample.org", "/es/1", "org/", "allow"),
        "x://b.com/fr/#f": ("b.com", "/fr/", "com/fr/", "allow"),
        "x://b.com/de/": ("b.com", "/de/", "com/de/", "block"),
        "http://c.net?q": ("c.net", "", None, "allow"),
        "no scheme": ("", "", None, "allow"),
        "": ("", "", None, "allow"),
        None: ("", "", None, "allow"),
        "http://h.com?u=http://x.org/fr/y": ("h.com", "", None, "allow"),
        "https://www.example.org?next=https://example.org/es/1": ("www.example.org", "", None, "block"),  # by the method: the host's other pages are blocked
        "https://example.org#https://example.org/es/1": ("example.org", "", None, "block"),
        "http://b.com/de/?to=http://x.org/": ("b.com", "/de/", "com/de/", "block"),
        "/go?u=HTTP://B.com/fr/a": ("b.com", "/fr/a", "com/fr/", "allow"),
        "http://?://x.org/": ("", "", None, "allow"),
        "a\n://b\n.com/de/\nx?y": ("b\n.com", "/de/\nx", "com/de/", "block"),
        "://://x.org/": (":", "//x.org/", None, "allow"),
        "http://" + "a/" * 20_000 + "?://b.com/de/": ("a", "/" + "a/" * 19_999, None, "allow"),
    }
    df = spark.createDataFrame([(i, u, None, 1) for i, u in enumerate(cases)], "page_id long, url string, html string, host int")
    got = {r["page_id"]: (r["host"], r["path"], r["rule"], r["verdict"]) for r in urls.judge(df).collect()}
    assert got == dict(enumerate(cases.values()))
    assert urls.judge(df.limit(0)).count() == 0


def test_url_ranks_against_power_iteration(spark, monkeypatch):
    hosts = [f"h{i}.net" for i in range(6)]
    links = [(0, 1), (0, 1), (1, 2), (2, 0), (3, 4), (4, 3), (4, 0), (5, 5)]
    html = {i: "".join(f'<a href="http://{hosts[d]}/p">' for s, d in links if s == i) for i in range(6)}
    df = spark.createDataFrame([(i, f"http://{h}/", html[i]) for i, h in enumerate(hosts)], "page_id long, host string, html string")
    edges = urls.host_edges(df.select(urls.host_of(F.col("host")).alias("host"), "html"))
    out = defaultdict(int)
    for s, d in links:
        out[s] += s != d
    share = edges.join(edges.groupBy("src").agg(F.sum("links").alias("o")), "src").select("src", "dst", (F.col("links") / F.col("o")).alias("share"))
    seeds = spark.createDataFrame([(hosts[0], 0.5), (hosts[3], 0.5)], "host string, mass double")
    got = {r["host"]: r["rank"] for r in urls.propagate(share, seeds, 0.85, 5).collect()}
    m = np.zeros((6, 6))
    for s, d in links:
        if s != d:
            m[d, s] += 1 / out[s]
    seed = np.array([0.5, 0, 0, 0.5, 0, 0])
    v = seed.copy()
    for _ in range(5):
        v = 0.85 * m @ v + 0.15 * seed
    assert all(abs(got.get(h, 0) - x) < 1e-12 for h, x in zip(hosts, v))
    # By doubled steps, by single ones, and by steps of a few: the exact solution.
    exact = np.linalg.solve(np.eye(6) - 0.85 * m, 0.15 * seed)
    for rows, doubled in ((1 << 20, True), (1 << 20, False), (0, True)):
        monkeypatch.setattr(urls, "DOUBLED_ROWS", rows)
        got = {r["host"]: r["rank"] for r in urls.propagate(share, seeds, doubled=doubled).collect()}
        assert max(abs(got.get(h, 0) - x) for h, x in zip(hosts, exact)) < urls.TOLERANCE


def test_url_ranks_settle(spark):
    """A chain of parents from a blocked seed (12 links long) and a pair of ties, against the exact solution."""
    names = ["x.net"]
    for k in range(12):
        names.append(f"s{k}.{names[-1]}")
    names += ["y.net", "a.y.net"]
    df = spark.createDataFrame([(k, f"http://{h}/", None) for k, h in enumerate(names)] + [(99, "http://x.net/bad", None), (98, "http://y.net/bad", None)], "page_id long, url string, html string")
    rows = urls.judge(df, rules=(("block", "x.net", "/bad"), ("block", "y.net", "/bad")), tolerance=urls.TOLERANCE).collect()
    got = {r["host"]: r["distrust"] for r in rows}
    assert {r["verdict"] for r in rows if r["path"] == "/bad"} == {"block"} and got.keys() == set(names)
    at, m, seed = {h: k for k, h in enumerate(names)}, np.zeros((15, 15)), np.zeros(15)
    for h in names:
        if (up := h.partition(".")[2]) in at:
            m[at[up], at[h]] = m[at[h], at[up]] = 1
    seed[[at["x.net"], at["y.net"]]] = 0.5
    want = np.linalg.solve(np.eye(15) - 0.85 * m / np.maximum(m.sum(0), 1), 0.15 * seed) * 15
    assert max(abs(got[h] - want[at[h]]) for h in names) < 15 * urls.TOLERANCE and want.min() > 0


def test_url_method_blocks_hosts_that_link_to_blocked_ones(spark):
    """A graph of absolute and protocol-relative links: seeds, both ranks and the verdicts against power iteration by hand."""
    out = {
        "good.org": ["news.net", "wiki.net"], "news.net": ["wiki.net", "good.org"], "wiki.net": ["good.org"],
        "bad.net": [], "farm.net": ["bad.net"] * 6 + ["good.org"], "ring.net": ["farm.net", "bad.net"],
        **{f"plain{k}.net": [] for k in range(6)},
    }
    link = lambda k, h: f'<a class=x HREF = "{("//", "https://", "HTTP://")[k % 3]}{h.upper() if k % 2 else h}/p?q">'
    pages = [(i, f"http://{h}/{'bad' if h == 'bad.net' else 'x'}", "<a href='/rel'><a href=mailto:a@b.c>" + "".join(link(k, d) for k, d in enumerate(to))) for i, (h, to) in enumerate(out.items())]
    pages.append((99, "http://bad.net/other", None))
    rules = (("allow", "org", "/"), ("block", "bad.net", "/bad"))
    rows = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"trust": F.lit(1), "rank": F.lit(2), "src": F.lit("s")}), rules, tolerance=urls.TOLERANCE).collect()
    hosts = list(out)
    m = np.array([[to.count(d) for d in hosts] for to in out.values()], float)
    seeds = {"trust": np.eye(12)[0], "distrust": np.eye(12)[3]}
    want = {}
    for kind, a in (("trust", m), ("distrust", m.T)):
        share = (a / np.maximum(a.sum(1, keepdims=True), 1)).T
        want[kind] = np.linalg.solve(np.eye(12) - 0.85 * share, 0.15 * seeds[kind]) * 12
    for r in rows:
        k = hosts.index(r["host"])
        t, d = want["trust"][k], want["distrust"][k]
        assert abs(r["trust"] - t) < 1e-4 and abs(r["distrust"] - d) < 1e-4
        by_rule = "allow" if r["host"] == "good.org" else "block" if r["path"] == "/bad" else None
        assert r["verdict"] == (by_rule or ("block" if d > urls.THRESHOLD and d > urls.MARGIN * t else "allow"))
    assert {r["host"] for r in rows if r["verdict"] == "block" and r["rule"] is None} >= {"farm.net"}
    assert {r["verdict"] for r in rows if r["host"] in ("news.net", "wiki.net")} == {"allow"}
    # Ended early, when no verdict can change, the verdicts are the same.
    early = urls.judge(spark.createDataFrame(pages, "page_id long, url string, html string"), rules).collect()
    assert {r["page_id"]: r["verdict"] for r in early} == {r["page_id"]: r["verdict"] for r in rows}


URL_SQL = r"""
WITH u AS (SELECT page_id, CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
h AS (SELECT page_id, translate(regexp_extract(rest, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host, regexp_extract(rest, '^[^/?#]*(/[^?#]*)', 1) AS path FROM u),
r(kind, name, prefix) AS (VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'), ('allow', 'com', '/fr/'), ('block', 'com', '/de/'))
SELECT page_id, host, path, (SELECT arg_max(name || prefix, length(name || prefix)) FROM r WHERE (host = name OR ends_with(host, '.' || name)) AND starts_with(path, prefix)) AS rule FROM h
"""


def test_url_rules_against_sql(spark):
    import duckdb

    data = "/root/testdata/sf0.01"
    con = duckdb.connect()
    con.execute(f"CREATE VIEW pages AS SELECT * FROM '{data}/pages.parquet'")
    want = con.execute(URL_SQL).fetchall()
    pages = spark.read.parquet(f"{data}/pages.parquet")
    rule, _ = urls.rule_of(F.col("host"), F.col("path"))
    got = pages.select("page_id", urls.host_of(F.col("url")).alias("host"), urls.path_of(F.col("url")).alias("path")).withColumn("rule", rule).collect()
    assert Counter(map(tuple, got)) == Counter(want) and len(want) > 100


# 4


def test_pieces():
    texts = ["<unk>", "▁", "a", "b", "ab", "▁ab", "abc", "c", "▁a", "bc", "<0xC3>", "<0xA9>", "<0x0A>"]
    kinds = [pieces.UNKNOWN] + [pieces.NORMAL] * 9 + [pieces.BYTE] * 3
    scores = [0, -3.0, -2.5, -2.7, -3.1, -5.2, -6.0, -2.0, -4.9, -4.1, 0, 0, 0]
    m = pieces.Unigram(pieces.Pieces(texts, scores, kinds))
    at = {t: i for i, t in enumerate(texts)}

    def brute(s):
        best = None
        for cut in itertools.product([0, 1], repeat=len(s) - 1):
            parts, p = [], 0
            for i, c in enumerate([*cut, 1], 1):
                if c:
                    parts.append(s[p:i])
                    p = i
            if all(x in at or len(x) == 1 for x in parts):
                v = sum(scores[at[x]] if x in at else m.unknown_score for x in parts)
                best = v if best is None or v > best + 1e-12 else best
        return best

    for s in ["abc", "▁abcab", "▁aabbcc▁ab", "▁▁abc", "cab▁abc"]:
        got = sum(scores[i] for i in m.segment(s))
        assert abs(got - brute(s)) < 1e-9
    assert [texts[i] for i in m.segment("aé")] == ["a", "<0xC3>", "<0xA9>"]
    for t in ["abc ab", "a\nb", "é", "  a", ""]:
        assert m.decode(m.encode(t)) == t


def test_pieces_of_the_public_model(awkward, none):
    path = queries.vocabulary("piece_bpe_32k.model")
    rows = pieces.encode(awkward, path).collect()
    assert len(rows) == len(TEXTS) and all(r["exact"] for r in rows)
    m = pieces.model(path)
    whole = pieces.Unigram(m.pieces)
    for t in TEXTS[3:11]:
        marked = pieces.MARKER + (t or "").replace(" ", pieces.MARKER)
        assert sum(m.scores[i] for i in whole.segment(marked)) == sum(m.scores[i] for i in m.encode(t))
    assert pieces.digest(pieces.encode(none, path)).count() == 0
    back = pieces.decode_column(pieces.encode(awkward, path), path).select("doc_id", "text").collect()
    assert Counter((r["doc_id"], r["text"]) for r in back) == Counter((i, t or "") for i, t in zip(IDS, TEXTS))


# 5


def test_packing(awkward, none):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(queries.vocabulary())
    texts = [*TEXTS, "a <|endoftext|> b"]
    for long in (" " * 2_000_000 + "a", "b" + "\n" * 2_000_000 + "a"):
        assert packing.encoder(queries.vocabulary())(long) == tok.encode(long, add_special_tokens=False).ids
    encode = packing.encoder(queries.vocabulary())
    assert all(encode(t) == tok.encode(t, add_special_tokens=False).ids for t in texts if t and len(t) < 5000)
    rows = packing.pack_documents(awkward, queries.vocabulary(), with_ids=True).collect()
    parts = defaultdict(list)
    for r in rows:
        parts[r["sequence_id"]].append((r["offset"], r["length"]))
        assert r["ids_crc32"] == zlib.crc32(np.array(r["ids"], "<u4").tobytes()) and len(r["ids"]) == r["length"]
    for p in parts.values():
        at = 0
        for o, n in sorted(p):
            assert o == at
            at += n
        assert at <= 1024
    whole = {r["doc_id"]: [] for r in rows}
    for r in sorted(rows, key=lambda r: (r["doc_id"] or -1, r["piece"])):
        whole[r["doc_id"]] += r["ids"]
    assert whole[11] == [*encode(LONG), 2] and whole[0] == [2]
    assert packing.pack_documents(none, queries.vocabulary()).count() == 0


def test_packing_plan():
    for seed in range(5):
        rng = np.random.default_rng(seed)
        counts = Counter(int(x) for x in rng.integers(1, 1025 if seed else 300, 2000))
        plan = packing.plan(dict(counts))
        used = Counter()
        for items, times in plan:
            assert sum(items) <= 1024
            for n in items:
                used[n] += times
        assert used == counts
        bins, least = sum(t for _, t in plan), -(-sum(k * v for k, v in counts.items()) // 1024)
        assert bins <= max(least * 1.05 + 1, sum(v for k, v in counts.items() if k > 512))
    assert packing.cut(2500) == [(0, 452), (452, 1024), (1476, 1024)] and packing.cut(1024) == [(0, 1024)]


# 6


def test_simhash(awkward, spark, none):
    rows = simhash.near_duplicates(awkward).collect()
    fp = np.array([int(r["fingerprint"], 16) for r in rows], np.uint64)
    near = np.bitwise_count(fp[:, None] ^ fp[None, :]) <= 3
    label = np.arange(len(rows))
    for _ in range(len(rows)):
        label = np.where(near, label[None, :], 1 << 30).min(1)
    for k in set(label):
        group = [r for r, x in zip(rows, label) if x == k]
        want = min((r["doc_id"] for r in group if r["doc_id"] is not None), default=None)
        assert {r["component_id"] for r in group} == {want}
    assert [r["fingerprint"] for r in rows if r["doc_id"] == 0] == ["0" * 16]
    assert simhash.near_duplicates(none).count() == 0


@pytest.mark.parametrize("small, large", [(4096, 1 << 16), (16, 1 << 16), (4096, 5), (16, 5)])
def test_simhash_links_give_all_components(spark, small, large, monkeypatch):
    base = RNG.integers(0, 1 << 62, 40, dtype=np.uint64)
    fps = set(base.tolist())
    for b in base[:4].tolist():
        for _ in range(150):
            x = b
            for bit in RNG.choice(64, int(RNG.integers(1, 5)), replace=False).tolist():
                x ^= 1 << bit
            fps.add(x)
    # Many that share one segment, each within 6 bits of a centre in the other.
    for shift in (0, 32):
        for _ in range(200):
            x = int(base[5])
            for bit in RNG.choice(32, int(RNG.integers(0, 7)), replace=False).tolist():
                x ^= 1 << (bit + shift)
            fps.add(x)
    fps = np.array(sorted(fps), np.uint64)
    hot = simhash.hot_keys(spark.createDataFrame([(int(x),) for x in fps.view(np.int64)], "fp long"), large)
    assert (len(hot) > 0) == (large == 5)
    monkeypatch.setattr(simhash, "SMALL_ENTRY", small)
    import pyarrow as pa

    made = list(simhash._probes([pa.RecordBatch.from_arrays([pa.array(fps.view(np.int64))], ["fp"])], 1, hot))
    t = pa.Table.from_batches(made)
    got = [b for b in simhash._match([t.combine_chunks().to_batches()[0]], 3)]
    up = {int(x): int(x) for x in fps}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for b in got:
        for u, v in zip(b.column(0).to_numpy().view(np.uint64).tolist(), b.column(1).to_numpy().view(np.uint64).tolist()):
            assert (u ^ v).bit_count() <= 3
            up[max(root(u), root(v))] = min(root(u), root(v))
    near = np.bitwise_count(fps[:, None] ^ fps[None, :]) <= 3
    label = np.arange(len(fps))
    while True:
        new = np.where(near, label[None, :], 1 << 30).min(1)
        if (new == label).all():
            break
        label = new
    ours = [root(int(x)) for x in fps]
    assert len({(a, b) for a, b in zip(ours, label.tolist())}) == len(set(ours)) == len(set(label.tolist()))


def test_near_dedup_stage_takes_all_five_word_copies(spark):
    """Planted copies with several changed words, of many sizes, against all pairs of five-word sets."""
    import corpus_pipeline

    rng, texts = np.random.default_rng(5), [None, "", "a", "A", "one two three four five", "x one two three four five"]
    for n in (9, 14, 30, 60, 200, 700, 3000):
        base = [f"w{x}" for x in rng.integers(0, 50_000, n)]
        texts.append(" ".join(base))
        for share in (0.01, 0.015, 0.02, 0.025, 0.03, 0.05):
            copy = list(base)
            for k in rng.integers(0, n, max(1, int(share * n))):
                copy[k] = f"v{rng.integers(0, 50_000)}"
            texts += [" ".join(copy), " ".join(base[: int(n * (1 - 4 * share))])]
    docs = spark.createDataFrame([(k, t, None, None, 0) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars long")
    label = jaccard_classes(texts)
    assert 20 < len(set(label)) < len(texts) - 20
    assert {r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, "").collect()} == set(label)


def test_parities_never_exceed_the_shingles_that_differ():
    rng = np.random.default_rng(3)
    for n, changed in [(0, 0), (1, 1), (40, 3), (400, 30), (3000, 900)]:
        a = np.unique(rng.integers(0, 1 << 63, n).astype(np.uint64))
        b = np.union1d(a[changed:], rng.integers(0, 1 << 63, changed).astype(np.uint64))
        differ = len(np.setxor1d(a, b))
        for longs_ in (1, shingles.WIDE):
            x, y = shingles.parities(a, longs_), shingles.parities(b, longs_)
            bits = sum(int(v).bit_count() for v in (x ^ y).view(np.uint64))
            assert bits <= differ and bits % 2 == differ % 2
        if differ == 6:
            assert bits >= 4
        assert (x == shingles.parities(a[::-1])).all() and shingles.parities(a, 1)[0] == shingles.parity(a)


def test_components_of_a_chain(spark):
    n = 200
    order = RNG.permutation(n)
    edges = spark.createDataFrame([(int(order[i]), int(order[i + 1])) for i in range(n - 1) if i != 99], "u long, v long")
    got = {r["node"]: r["root"] for r in common.components(edges).collect()}
    a, b = set(order[:100].tolist()), set(order[100:].tolist())
    assert {got[x] for x in a} == {min(a)} and {got[x] for x in b} == {min(b)}


# 7


def test_language(spark, awkward, none):
    en, fr = "the of and river quiet yellow stone with this that".split(), "le la des maison soleil bientôt avec cette où très".split()
    docs = [(i, prose(30, en if i % 2 else fr), "en" if i % 2 else "fr") for i in range(300)]
    df = spark.createDataFrame(docs, "doc_id long, text string, lang string").withColumn("score", F.lit("x"))
    got = language.identify(df, df.where(~language.held_out()), ("doc_id", "lang")).where(language.held_out()).collect()
    assert np.mean([r["lang"] == r["lang_pred"] for r in got]) > 0.98
    rows = {r["doc_id"]: r for r in language.identify(awkward, df).collect()}
    assert rows[0]["lang_pred"] == rows[1]["lang_pred"] == rows[16]["lang_pred"] == "und" and rows[4]["lang_pred"] != "und"
    assert all(0 <= r["score"] <= 1 for r in rows.values())
    assert language.identify(none, none).count() == 0
    assert {r["lang_pred"] for r in language.identify(awkward, none).collect()} == {"und"}


def test_language_by_brute_force():
    """Kernel values from sets of n-grams, whitening and ridge by dense algebra, one by one."""
    en, fr = "the of and river quiet yellow stone with this that".split(), "le la des maison soleil bientôt avec cette où très".split()
    texts = [prose(12, en if i % 2 else fr).encode() for i in range(60)]
    langs = ["en" if i % 2 else "fr" for i in range(60)]
    m = language.train(texts, langs, landmarks=9)
    grams = lambda t: {(k, t[p : p + k]) for k in language.ORDERS for p in range(len(t) - k + 1)}
    kernel = lambda a, b: len(grams(a) & grams(b)) / math.sqrt(len(grams(a)) * len(grams(b)))
    # Landmarks in turn from each language: the first four or five of each, in order of language.
    of = {x: [t for t, y in zip(texts, langs) if y == x] for x in ("en", "fr")}
    marks = [of[x][k] for k in range(5) for x in ("en", "fr")][:9]
    k = np.array([[kernel(t, x) for x in marks] for t in texts])
    value, vector = np.linalg.eigh(np.array([[kernel(a, b) for b in marks] for a in marks]))
    white = vector / np.sqrt(value)
    z = k @ white
    y = np.array([[1.0 if x == n else -1.0 for n in ("en", "fr")] for x in langs])
    beta = np.linalg.solve(z.T @ z + language.RIDGE * np.eye(9), z.T @ y)
    new = [*texts[:5], prose(8, en + fr).encode(), "пример".encode(), b"x"]
    s = np.array([[kernel(t, x) for x in marks] for t in new]) @ white @ beta
    best, score = m.predict(new, m.tables())
    known = np.array([any(grams(t) & grams(x) for x in marks) for t in new])
    assert (best[known] == s.argmax(1)[known]).all() and known[:6].all()
    assert np.allclose(score[known], 1 / (1 + np.exp(-language.SHARPNESS * s.max(1)[known])), atol=1e-3) and (score[~known] == 0).all()


def test_language_sample_is_bounded(spark):
    docs = spark.createDataFrame([(i % 50, f"text {i} " + "x" * 1000, "en" if i % 3 else "fr") for i in range(300)] + [(7, "short", "de"), (8, None, "de"), (9, "none", None)], "doc_id long, text string, lang string")
    texts, langs = language.sample(docs, rows=30, max_bytes=12_000)
    count = Counter(langs)
    assert sum(map(len, texts)) <= 12_000 and count["de"] == 1 and count["en"] >= 4 and count["fr"] >= 4
    assert Counter(language.sample(docs, rows=30)[1]) == {"en": 10, "fr": 10, "de": 1}


def test_many_short_texts_take_bounded_memory():
    """200,000 texts of ten letters through the tasks of operators 1 and 7."""
    import tracemalloc

    import pyarrow as pa

    texts = ["abcdefghij"[k % 7 :] + "the xyz"[: k % 7] for k in range(200_000)]
    t = pa.table({"doc_id": range(len(texts)), "text": texts})
    m = language.train([x.encode() for x in texts[:300]], ["en", "fr", "de"] * 100)
    tables = m.tables()
    tracemalloc.start()
    for part in common.chunked(t.to_batches()):
        divergence.distances(divergence.histograms(part.column("text").to_pylist()), np.ones(len(divergence.CLASSES) + len(divergence._WORDS) + 1))
        m.predict([x.encode() for x in part.column("text").to_pylist()], tables)
    assert tracemalloc.get_traced_memory()[1] < 150 << 20
    tracemalloc.stop()


# 8


def test_neighbours(spark):
    x = RNG.normal(size=(300, 8)).astype(np.float32)
    x[40:80] = x[3]  # copies
    rows = [(i, [float(c) for c in v], 1) for i, v in enumerate(x)]
    rows += [(400, None, 1), (420, [0.0] * 8, 1), (440, [1.0, float("nan")] + [0.0] * 6, 1), (460, [1.0] * 5, 1), (480, [None] + [1.0] * 7, 1), (None, [1.0] * 8, 1)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, rank int")
    got = defaultdict(list)
    for r in neighbours.search(df, F.col("vec_id") % 20 == 0, share=1.0).orderBy("query_id", "rank").collect():
        got[r["query_id"]].append((r["vec_id"], r["score"]))
    assert set(got) == set(range(0, 300, 20))
    d = x.astype(np.float64)
    for q, found in got.items():
        s = (d * d[q]).sum(1)
        want = [int(i) for i in np.lexsort((np.arange(300), -s)) if i != q][:20]
        assert [v for v, _ in found] == want and np.allclose([s[v] for v in want], [y for _, y in found], rtol=0, atol=1e-12)
    assert neighbours.search(df.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_neighbours_recall_at_the_registered_share(spark):
    rows = {r["vec_id"]: np.array(r["embedding"], float) for r in queries.table(spark, "/root/testdata/sf0.01", "embeddings").collect()}
    ids = np.array(sorted(rows))
    x = np.stack([rows[i] for i in ids])
    got = defaultdict(set)
    for r in queries.op8_inverted_multi_index(spark, "/root/testdata/sf0.01").collect():
        got[r["query_id"]].add(r["vec_id"])
    hits = []
    for q in ids[ids % 20 == 0]:
        s = x @ rows[q]
        best = [i for i in ids[np.lexsort((ids, -s))] if i != q][:20]
        hits.append(len(got[q] & set(best)) / 20)
    assert np.mean(hits) >= 0.9


def test_visit_goes_by_summed_distance():
    one, two, q = RNG.normal(size=(5, 3)), RNG.normal(size=(6, 3)), RNG.normal(size=6)
    cells = neighbours.visit(q, one, two, np.ones(30, np.int64), 30)
    cost = [-(one[c // 6] @ q[:3] + two[c % 6] @ q[3:]) for c in cells]
    assert sorted(cells.tolist()) == list(range(30)) and (np.diff(cost) >= -1e-12).all()


# 9


def test_resampling(spark, awkward, none):
    good, bad = WORDS, ["zzq", "xx%", "buy", "now", "click"]
    docs = spark.createDataFrame([(i, prose(60, bad if i % 5 == 0 else good)) for i in range(300)], "doc_id long, text string")
    docs = docs.withColumns({c: F.lit("x") for c in ("key", "Weight", "kept", "_key", "kind", "label_id")})
    labels = spark.createDataFrame([(i, int(i % 5 != 0), 0) for i in range(0, 150)] + [(None, 1, 0), (3, 1, None), (7, None, None)], "doc_id long, quality int, toxic int")
    kept = {r["doc_id"] for r in resampling.classify(docs, labels).where("kept").collect()}
    assert len([i for i in kept if i % 5]) >= 230 and not [i for i in kept if i % 5 == 0]
    out = resampling.classify(docs, labels, ("doc_id", "key", "text"))
    assert out.columns == ["doc_id", "key", "text", "weight", "kept"] and out.count() == 300
    with pytest.raises(ValueError):
        resampling.classify(docs, labels, ("doc_id", "Weight"))
    assert resampling.classify(awkward, labels).count() == len(TEXTS)
    assert {(r["weight"], r["kept"]) for r in resampling.classify(awkward, labels.limit(0)).collect()} == {(0.0, True)}
    assert resampling.classify(none, labels.limit(0)).count() == 0


def test_resampling_takes_out_toxic_documents_by_a_few_words(spark):
    rng = np.random.default_rng(8)
    common = [f"w{k}" for k in range(200)]
    docs, labels = [], []
    for i in range(900):
        toxic = i % 6 == 0
        words = rng.choice(common, 300).tolist() + [f"rare{i}x{k}" for k in range(30)]
        for w in rng.choice(["vile", "foul", "nasty"], 2 if toxic else 0, replace=False):
            words[int(rng.integers(0, 330))] = str(w)
        docs.append((i, " ".join(words)))
        if i % 2 == 0:
            labels.append((i, 1, int(toxic)))
    got = {r["doc_id"]: r["kept"] for r in resampling.classify(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")).collect()}
    assert sum(got[i] for i in got if i % 6) > 735 and sum(got[i] for i in got if i % 6 == 0) < 15


def test_resampling_weights_and_sampling_by_brute_force(spark):
    """Weights from counts in plain dictionaries; and how often each document is drawn, over seeds, against weighted draws without replacement."""
    rng = np.random.default_rng(2)
    docs = [(i, " ".join(rng.choice(["a", "b", "c", "d"], 12, p=[0.4, 0.3, 0.2, 0.1] if i < 6 else [0.1, 0.2, 0.3, 0.4]))) for i in range(8)]
    labels = [(i, int(i < 6), 0) for i in (0, 1, 2, 6)]
    df, lab = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    counts = {k: Counter() for k in ("raw", 0, 1)}
    kind = {i: 0 if q else 1 for i, q, _ in labels}
    for i, t in docs:
        for k in ("raw", kind.get(i)):
            if k is not None:
                counts[k].update(resampling.ngrams(t).tolist())
    n, s = resampling.WORDS + resampling.PAIRS, resampling.SMOOTHING
    raw = lambda g: (counts["raw"][g] + s) / (sum(counts["raw"].values()) + s * n)
    p = lambda k, g: (1 - s) * counts[k][g] / sum(counts[k].values()) + s * raw(g)
    want = {}
    for i, t in docs:
        r = sum(math.log(p(1, g) / p(0, g)) for g in resampling.ngrams(t).tolist())
        want[i] = -math.log(0.75 + 0.25 * math.exp(r))
    got = {r["doc_id"]: r["weight"] for r in resampling.classify(df, lab).collect()}
    assert all(abs(got[i] - w) < 1e-3 * max(1, abs(w)) for i, w in want.items())
    # Draws: the noise of classify() for many seeds, against the chances of three draws without replacement.
    w = np.array([got[i] for i in range(8)])
    seeds, ids = 20_000, np.arange(8)
    drawn = np.zeros(8)
    for seed in range(seeds):
        drawn[np.argsort(-(w + resampling.noise(ids, seed)))[:3]] += 1
    chance = np.zeros(8)
    for order in itertools.permutations(range(8), 3):
        left, c = np.exp(w).sum(), 1.0
        for i in order:
            c *= np.exp(w[i]) / left
            left -= np.exp(w[i])
        chance[list(order)] += c
    assert np.abs(drawn / seeds - chance).max() < 0.02
    top = {r["doc_id"] for r in resampling.classify(df, lab, share=3 / 8, seed=5).where("kept").collect()}
    assert top == set(np.argsort(-(w + resampling.noise(ids, 5)))[:3].tolist())


def test_kth_largest(spark):
    x = np.r_[RNG.normal(size=500), [2.0] * 20, -1e9, 1e300, 5e-324]
    df = spark.createDataFrame([(float(v),) for v in x], "v double")
    for k in (1, 2, 15, 300, len(x)):
        assert resampling.kth_largest(df, "v", k, bins=16) == np.sort(x)[-k]


# 10


def test_hmm(awkward, none):
    rows = hmm.score(awkward.drop("held_out"), F.crc32(F.col("doc_id").cast("string")) % 5 == 1, iterations=1).collect()
    tok = lambda t: [*(t or "").encode().lower().split(), b""]
    held = lambda i: i is not None and zlib.crc32(str(i).encode()) % 5 == 1
    c = Counter(w for i, t in zip(IDS, TEXTS) if not held(i) for w in tok(t))
    n, v = sum(c.values()), len(c)
    want = Counter((i, held(i), len(tok(t)), sum(c[w] > 0 for w in tok(t)), n, round(sum(math.log10((c[w] + 0.5) / (n + 0.5 * (v + 1))) for w in tok(t)), 4)) for i, t in zip(IDS, TEXTS))
    assert want == Counter((r["doc_id"], r["held_out"], r["n_tokens"], r["n_known"], r["train_tokens"], round(r["base_score"], 4)) for r in rows)
    assert all(r["score"] < 0 and math.isfinite(r["score"]) for r in rows)
    assert hmm.score(none, F.lit(False)).count() == 0


def brute_hmm(texts, held, states, top_words, classes, iterations, segment):
    """log10 probabilities of texts by plain loops: counts, classes, forward and backward values without scaling by batch."""
    tok = lambda t: [*(t or "").encode().lower().split(), None]
    h = lambda w: xxhash.xxh64_intdigest(w)
    counts = Counter(w for t, x in zip(texts, held) if not x for w in tok(t))
    ends = counts.pop(None, 0)
    top = sorted(sorted(counts, key=lambda w: (-counts[w], h(w)))[:top_words], key=h)
    rest = [w for w in counts if w not in top]
    class_n = [sum(counts[w] for w in rest if h(w) % classes == g) for g in range(classes)]
    class_v = [sum(1 for w in rest if h(w) % classes == g) for g in range(classes)]
    v = hmm.Vocabulary(0, 0, np.array([h(w) for w in top], np.uint64), np.array([counts[w] for w in top], float), np.array(class_n, float), np.array(class_v, float), float(ends))
    symbol = lambda w: len(top) + classes if w is None else top.index(w) if w in top else len(top) + h(w) % classes
    m = hmm.first_model(v, states)

    def forward(seq, first):
        a, out, log = (m.start if first else m.rest) * m.emit[seq[0]], [], 0.0
        for k, s in enumerate(seq):
            if k:
                a = (a @ m.move) * m.emit[s]
            log += math.log(a.sum())
            a = a / a.sum()
            out.append(a)
        return np.array(out), log

    for _ in range(iterations):
        start, move, emit = np.ones(states), np.ones((states, states)), hmm.PRIOR * v.unigram()[:, None] * np.ones(states)
        for t, x in zip(texts, held):
            whole = [symbol(w) for w in tok(t)]
            for at in range(0, len(whole) if not x else 0, segment or len(whole)):
                seq = whole[at : at + (segment or len(whole))]
                alpha, _ = forward(seq, at == 0)
                beta = np.ones(states)
                for k in range(len(seq) - 1, -1, -1):
                    post = alpha[k] * beta
                    emit[seq[k]] += post / post.sum()
                    if k:
                        pair = alpha[k - 1][:, None] * m.move * (m.emit[seq[k]] * beta)
                        move += pair / pair.sum()
                        beta = m.move @ (m.emit[seq[k]] * beta)
                        beta /= beta.sum()
                    elif at == 0:
                        start += post / post.sum()
        m = hmm.Hmm(start / start.sum(), move / move.sum(1, keepdims=True), emit / emit.sum(0))
    out = []
    for t in texts:
        words = tok(t)
        within = sum(math.log10((counts[w] + 0.5) / (class_n[h(w) % classes] + 0.5 * (class_v[h(w) % classes] + 1))) for w in words if w is not None and w not in top)
        out.append(forward([symbol(w) for w in words], True)[1] / math.log(10) + within)
    return out


@pytest.mark.parametrize("segment", [None, 16])
def test_hmm_score_against_loops(spark, segment):
    texts = [prose(int(n)) for n in RNG.integers(0, 60, 30)] + [None, "", "THE the The", prose(5, ["new", "words", "only"])]
    df = spark.createDataFrame([(i if i % 5 else None, t, i % 4 == 3) for i, t in enumerate(texts)], "doc_id long, text string, away boolean")
    got = Counter((r["doc_id"], r["held_out"], r["n_tokens"], round(r["score"], 2)) for r in hmm.score(df, F.col("away"), 2, 5, 3, 2, segment).collect())
    want = brute_hmm(texts, [i % 4 == 3 for i in range(len(texts))], 2, 5, 3, 2, segment)
    near = Counter()
    for i, (t, x) in enumerate(zip(texts, want)):
        for r in got:
            if r[:3] == (i if i % 5 else None, i % 4 == 3, len((t or "").split()) + 1) and abs(r[3] - x) < 0.02:
                near[i] = 1
                break
    assert sum(near.values()) == len(texts) and sum(got.values()) == len(texts)


def test_hmm_of_null_and_repeated_ids(spark):
    """Such rows are spread over chunks, and their texts pass in tables of bounded size."""
    rows = [(None if i % 2 else 7, f"{WORDS[i % 14]} {i % 50}") for i in range(3000)] + [(None, None)] * 500
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sizes = df.groupBy(hmm.chunk_of(df).alias("c")).count().collect()
    assert len(sizes) >= 14 and max(r["count"] for r in sizes) < 1000
    got = hmm.score(df, F.lit(None).cast("boolean"), iterations=1).collect()
    c = Counter(w for _, t in rows for w in (t or "").split())
    n, v = sum(c.values()) + len(rows), len(c) + 1
    base = lambda t: round(sum(math.log10((k + 0.5) / (n + 0.5 * (v + 1))) for k in [*(c[w] for w in (t or "").split()), len(rows)]), 4)
    assert Counter((r["doc_id"], r["held_out"], r["train_tokens"], round(r["base_score"], 4)) for r in got) == Counter((i, False, n, base(t)) for i, t in rows)
    batches = [pa.RecordBatch.from_pydict({"bucket": pa.array([k] * 5000, pa.int32()), "text": ["x"] * 5000}) for k in (1, 1, 1, 2)]
    turns = [(k, [t.num_rows for t in tables]) for k, tables in hmm.in_turn(iter(batches))]
    assert [k for k, _ in turns] == [1, 2] and sum(turns[0][1]) == 15000 and max(turns[0][1]) <= 2 * common.CHUNK_ROWS


def test_forward_is_exact_and_em_rises():
    rng = np.random.default_rng(0)
    k, s = 7, 3
    m = hmm.Hmm(rng.dirichlet(np.ones(s)), rng.dirichlet(np.ones(s), s), rng.dirichlet(np.ones(k), s).T)
    seqs = [rng.integers(0, k, n) for n in (4, 1, 6, 6, 2)]
    log, _, _ = hmm._Batch(seqs).forward(m, False)
    for seq, got in zip(seqs, log):
        total = 0.0
        for path in itertools.product(range(s), repeat=len(seq)):
            p = m.start[path[0]] * m.emit[seq[0], path[0]]
            for a, b, x in zip(path, path[1:], seq[1:]):
                p *= m.move[a, b] * m.emit[x, b]
            total += p
        assert abs(math.log(total) - got) < 1e-9
    last = -np.inf
    for _ in range(6):
        a, b, e, now = hmm._Batch(seqs).expected(m)
        assert now > last - 1e-4
        last, m = now, hmm.Hmm(a / a.sum(), b / b.sum(1, keepdims=True), e / e.sum(0))


# Pipeline


def jaccard_classes(texts):
    """Label of each text: the first one that a chain of five-word similarities of 0.8 or more leads to."""
    sets = []
    for t in texts:
        words = (t or "").lower().split()
        sets.append({tuple(words[k : k + 5]) for k in range(max(1, len(words) - 4))} if words else set())
    label = list(range(len(texts)))
    for i, j in itertools.combinations(range(len(texts)), 2):
        if 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j]) and label[i] != label[j]:
            a, b = sorted((label[i], label[j]))
            label = [a if x == b else x for x in label]
    return label


@pytest.fixture(scope="module")
def planted(spark, tmp_path_factory):
    """A folder with documents and labels: good, bad, toxic, foreign, near-copied and repeated texts; and what each text is."""
    rng = np.random.default_rng(12)
    en = [a + b for a in "the an of re in ed".split() for b in "tion ing ers and ou ha le st".split()]
    fr = [a + b for a in "qué lar dé mou sè ché".split() for b in "ment eau aux ier oux ère tte is".split()]
    say = lambda words, n: " ".join(rng.choice(words, n))
    rows, kinds = [], []

    def add(kind, text, lang):
        rows.append((len(rows), text, lang, "web", len(text) if text else None))
        kinds.append(kind)

    for i in range(150):
        add("good", say(en if i % 2 else fr, 60), "en" if i % 2 else "fr")
    for _ in range(40):
        add("bad", " ".join(w + "###" for w in rng.choice(en, 60)), "en")
    for i in range(40):
        words = rng.choice(en, 60).tolist()
        for k in rng.integers(0, 60, 4):
            words[k] = str(rng.choice(["vile", "scum"]))
        add("toxic", " ".join(words), "en")
    for i in range(0, 20, 2):  # one word of 60 changed: at least 51 of 61 shingles are shared
        words = rows[i][1].split()
        words[int(rng.integers(5, 55))] = "changed"
        add("copy", " ".join(words), rows[i][2])
    passage = say(en, 30)
    for i in range(6):
        add("good", say(en, 40) + " " + passage + " " + say(en, 20 + i), "en")
    for text in (None, "", "12 34 56", "пример текста на другом языке " * 6):
        add("foreign", text, None)
    folder = str(tmp_path_factory.mktemp("sf"))
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(folder + "/documents.parquet")
    labels = [(i, int(k != "bad"), int(k == "toxic")) for i, k in enumerate(kinds) if k in ("good", "bad", "toxic") and i % 4]
    spark.createDataFrame(labels, "doc_id long, quality int, toxic int").write.parquet(folder + "/labels.parquet")
    return folder, rows, kinds


def test_pipeline_against_plain_stages(spark, planted):
    import corpus_pipeline

    folder, rows, kinds = planted
    encode = packing.encoder(queries.vocabulary())
    # Quality and language: what was planted. Near copies: all pairs. Repeats: all 50-byte strings.
    left = [r for r, k in zip(rows, kinds) if k in ("good", "copy")]
    label = jaccard_classes([r[1] for r in left])
    left = [r for k, r in enumerate(left) if label[k] == k]
    assert len(left) == 156
    first = {}
    for r in left:
        b = r[1].encode()
        for p in range(len(b) - 49):
            first.setdefault(b[p : p + 50], r[0])
    want = Counter()
    for r in left:
        b = r[1].encode()
        gone = np.zeros(len(b), bool)
        for p in range(len(b) - 49):
            if first[b[p : p + 50]] < r[0]:
                gone[p : p + 50] = True
        ids = np.array([*encode(bytes(np.frombuffer(b, np.uint8)[~gone]).decode(errors="ignore")), 2], "<u4")
        for k, (s, n) in enumerate(packing.cut(len(ids))):
            want[r[0], k, s, n, zlib.crc32(ids[s : s + n].tobytes())] += 1
    got = corpus_pipeline.run(spark, folder).collect()
    assert Counter(tuple(r)[:5] for r in got) == want
    bins = defaultdict(list)
    for r in got:
        bins[r["sequence_id"]].append((r["offset"], r["length"]))
    assert all(sum(n for _, n in b) <= 1024 and [o for o, _ in sorted(b)] == np.cumsum([0, *(n for _, n in sorted(b))])[:-1].tolist() for b in bins.values())


def test_pipeline_stages_on_awkward_tables(spark, awkward, none, planted):
    """Nulls, empty and long texts, repeated ids and rows, columns with clashing names, no rows: rows and columns of each stage."""
    import corpus_pipeline

    for docs in (awkward, none):
        for name, stage in corpus_pipeline.STAGES[:-1]:
            out = stage(spark, docs, planted[0])
            assert out.columns == list(corpus_pipeline.COLUMNS), name
            assert out.count() <= docs.count()
        assert corpus_pipeline.STAGES[-1][1](spark, docs, planted[0]).select("doc_id").distinct().count() == docs.select("doc_id").distinct().count()
    kept = Counter(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, awkward, "").collect())
    label = jaccard_classes([t for i, t in zip(IDS, TEXTS) if i is not None])
    ids = [i for i in IDS if i is not None]
    assert kept == Counter({ids[k]: 1 for k in set(label)} | {None: 2})


def test_pipeline_on_test_data(spark):
    import corpus_pipeline

    sf = "/root/testdata/sf0.001"
    docs = queries.table(spark, sf, "documents")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = docs
        docs, _ = common.settle(stage(spark, before, sf))
        assert docs.columns == list(corpus_pipeline.COLUMNS) and 0 < docs.count() <= before.count(), name
        if name.startswith("SimHash"):
            rows = sorted((r["doc_id"], r["text"]) for r in before.collect())
            label = jaccard_classes([t for _, t in rows])
            assert {r["doc_id"] for r in docs.collect()} == {rows[k][0] for k in label}
        if name.startswith("suffix"):
            rows = [(r["doc_id"], r["text"]) for r in before.collect()]
            left = {k[0]: k[1] - k[2] for k in brute_suffix(rows)}
            assert {r["doc_id"] for r in docs.collect()} == {k for k, v in left.items() if v or not dict(rows)[k]}
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, sf)
    assert packed.select("doc_id").distinct().count() == docs.count()
