"""SQL for DuckDB of those operators that SQL can express."""

from __future__ import annotations

#: Levels that are unrolled: 16 ** 6 documents of a source, 16 ** 4 sources.
DOCUMENT_LEVELS, SOURCE_LEVELS = 6, 4

TOP_K = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS x FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_dot_product(q.x, c.x) AS BIGINT) AS score
  FROM v q JOIN v c ON c.vec_id <> q.vec_id WHERE q.vec_id % 20 = 0
), r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 20
"""


def crc32(text: str) -> str:
    """The unsigned CRC-32 of an ASCII text."""
    codes = f"list_transform(range(1, len({text}) + 1), lambda i: CAST(ascii(substr({text}, i, 1)) AS BIGINT))"
    bit = "lambda s, k: xor(s >> 1, (s & 1) * 3988292384)"
    return f"xor(4294967295, list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {codes}), lambda c, b: list_reduce(list_concat([xor(c, b)], CAST(range(1, 9) AS BIGINT[])), {bit})))"


def merkle() -> str:
    def leaf(text: str) -> str:
        fields = [f"CAST({c} AS VARCHAR)" for c in ("doc_id", "source", "lang", "n_chars", text)]
        return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"

    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    parts = [
        f"leaves AS (SELECT doc_id, coalesce('=' || source, '-') AS tree, {leaf('text')} AS leaf, CASE WHEN doc_id IS NOT NULL AND {crc32('CAST(doc_id AS VARCHAR)')} % 5 = 0 THEN {leaf(lower)} END AS changed FROM documents)",
        "docs AS (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM leaves)",
        "s0 AS (SELECT tree, pos, n, leaf AS h FROM docs)",
    ]

    def climb(name: str, levels: int) -> None:
        for k in range(levels):
            parts.append(f"{name}r{k} AS (SELECT tree, pos // 16 AS run, any_value(n) AS n, list(h ORDER BY pos) AS hs FROM {name}{k} GROUP BY ALL)")
            parts.append(f"{name}{k + 1} AS (SELECT tree, run AS pos, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN hs[1] ELSE sha256(array_to_string(hs, '')) END AS h FROM {name}r{k})")

    climb("s", DOCUMENT_LEVELS)
    parts.append(f"f0 AS (SELECT '' AS tree, tree AS name, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n, h FROM s{DOCUMENT_LEVELS})")
    climb("f", SOURCE_LEVELS)
    parts.append("p0 AS (SELECT doc_id, leaf, tree AS name, tree, pos, n, coalesce(changed, leaf) AS h, '' AS proof FROM docs)")

    def fold(frm: str, name: str, levels: int, to: str) -> None:
        for k in range(levels):
            here = "CAST(pos % 16 AS INTEGER)"
            parts.append(
                f"{to}{k + 1} AS (SELECT doc_id, leaf, name, p.tree, pos // 16 AS pos, (p.n + 15) // 16 AS n,"
                f" CASE WHEN p.n = 1 THEN h ELSE sha256(array_to_string(hs[1:{here}] || [h] || hs[{here} + 2:], '')) END AS h,"
                f" CASE WHEN p.n = 1 THEN proof ELSE proof || array_to_string(hs[1:{here}] || hs[{here} + 2:], '') END AS proof"
                f" FROM {frm}{k} p JOIN {name}r{k} r ON p.tree = r.tree AND p.pos // 16 = r.run)"
            )

    fold("p", "s", DOCUMENT_LEVELS, "p")
    parts.append(f"q0 AS (SELECT doc_id, leaf, p.name, f0.tree, f0.pos, f0.n, p.h, proof FROM p{DOCUMENT_LEVELS} p JOIN f0 USING (name))")
    fold("q", "f", SOURCE_LEVELS, "q")
    return (
        "WITH " + ",\n".join(parts) + f"\nSELECT q.doc_id, q.leaf, f0.h AS subroot, r.h AS root, sha256(q.proof) AS proof_sha256, q.h AS folded_root, q.h = r.h AS verified FROM q{SOURCE_LEVELS} q JOIN f0 USING (name), f{SOURCE_LEVELS} r"
    )


ORACLE_SQL: dict[str, str] = {"op11_bit_sliced_top_k": TOP_K, "op12_merkle_manifest": merkle()}
