"""DuckDB SQL for the operators of this subpackage whose whole result SQL can express; brute force, for small tables."""

from __future__ import annotations

LEVELS = 8

#: Connected components of links (a, b), both ways, among nodes (id): the smallest id that each node reaches.
COMPONENTS = """reach AS (SELECT id AS a, id AS b FROM nodes UNION SELECT reach.a, links.b FROM reach JOIN links ON reach.b = links.a), parts AS (SELECT a AS id, min(b) AS component_id FROM reach GROUP BY 1)"""

JACCARD = f"""WITH RECURSIVE words AS (SELECT doc_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
    sets AS (SELECT DISTINCT doc_id, unnest(CASE WHEN coalesce(len(w), 0) = 0 THEN [] WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS s FROM words),
    sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY 1), pairs AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM sets x JOIN sets y ON x.s = y.s AND x.doc_id <> y.doc_id GROUP BY 1, 2),
    links AS (SELECT a, b FROM pairs JOIN sizes p ON a = p.doc_id JOIN sizes q ON b = q.doc_id WHERE 100 * shared >= 90 * (p.n + q.n - shared)), nodes AS (SELECT doc_id AS id FROM documents), {COMPONENTS}
    SELECT d.doc_id, coalesce(n, 0) AS n_shingles, component_id FROM documents d LEFT JOIN sizes s ON d.doc_id = s.doc_id JOIN parts p ON d.doc_id = p.id"""

NEAR = f"""WITH RECURSIVE vectors AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings WHERE label IS NOT NULL AND embedding IS NOT NULL AND list_bool_and(list_transform(embedding, lambda x: x IS NOT NULL AND isfinite(x))) AND list_bool_or(list_transform(embedding, lambda x: x <> 0))),
    normed AS (SELECT *, sqrt(list_inner_product(v, v)) AS size FROM vectors), links AS (SELECT x.vec_id AS a, y.vec_id AS b FROM normed x JOIN normed y ON x.label = y.label AND x.vec_id <> y.vec_id AND len(x.v) = len(y.v) WHERE list_inner_product(x.v, y.v) / (x.size * y.size) >= 0.93),
    nodes AS (SELECT vec_id AS id FROM embeddings), {COMPONENTS}, counts AS (SELECT a, count(*) AS n FROM links GROUP BY 1)
    SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM embeddings LEFT JOIN counts ON vec_id = a JOIN parts ON vec_id = id"""

#: crc32 of the decimal digits of doc_id, bit by bit.
CRC = "(4294967295 - list_reduce(list_transform(range(length(doc_id || '')), lambda i: ascii(substr(doc_id || '', (i + 1)::INT, 1))::BIGINT), lambda c, b: list_reduce(range(8), lambda d, k: CASE WHEN d % 2 = 1 THEN xor(3988292384::BIGINT, d // 2) ELSE d // 2 END, xor(c, b)), 4294967295::BIGINT))"


def _merkle() -> str:
    part = lambda v: f"coalesce(octet_length(encode({v})) || ':' || {v}, '-')"
    leaf = lambda text: f"sha256({part('(doc_id || $$$$)')} || {part('source')} || {part('lang')} || {part('(n_chars || $$$$)')} || {part(text)})"
    lower = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    out = [
        f"leaves AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {CRC} % 5 = 0 THEN {leaf(lower)} ELSE {leaf('text')} END AS f FROM documents)",
        "low0 AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1 AS r, count(*) OVER (PARTITION BY source) AS n, leaf AS h FROM leaves)",
        "climb0 AS (SELECT doc_id, source, leaf, r, f, '' AS proof FROM low0)",
    ]

    def levels(name: str, key: str, climb: str, first: int) -> None:
        """Levels of the trees by key, and how the rows of climb go up through them."""
        same = "n.source IS NOT DISTINCT FROM c.source AND n.r = c.r" if key == "source" else "n.r = c.r"
        for k in range(LEVELS):
            run = f"PARTITION BY {key}, r // 16 ORDER BY r ROWS BETWEEN"
            out.append(f"{name}s{k} AS (SELECT {key}, r, n, coalesce(string_agg(h, '') OVER ({run} UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS a, coalesce(string_agg(h, '') OVER ({run} 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS b FROM {name}{k})")
            out.append(f"{climb}{first + k + 1} AS (SELECT doc_id, c.source, leaf, c.r // 16 AS r, CASE WHEN n = 1 THEN f ELSE sha256(a || f || b) END AS f, CASE WHEN n = 1 THEN proof ELSE proof || a || b END AS proof FROM {climb}{first + k} c JOIN {name}s{k} n ON {same})")
            out.append(f"{name}{k + 1} AS (SELECT {key}, r // 16 AS r, (n + 15) // 16 AS n, CASE WHEN n = 1 THEN min(h) ELSE sha256(string_agg(h, '' ORDER BY r)) END AS h FROM {name}{k} GROUP BY {key}, r // 16, n)")

    levels("low", "source", "climb", 0)
    out.append(f"top0 AS (SELECT 0 AS one, source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, count(*) OVER () AS n, h FROM low{LEVELS})")
    out.append(f"up0 AS (SELECT doc_id, c.source, leaf, t.r, f, proof FROM climb{LEVELS} c JOIN top0 t ON c.source IS NOT DISTINCT FROM t.source)")
    levels("top", "one", "up", 0)
    return f"""WITH {", ".join(out)} SELECT doc_id, leaf, s.h AS subroot, t.h AS root, sha256(proof) AS proof_sha256, f AS folded_root, f = t.h AS verified FROM up{LEVELS} u JOIN low{LEVELS} s ON u.source IS NOT DISTINCT FROM s.source CROSS JOIN top{LEVELS} t"""


ORACLE_SQL = {"op2_jaccard": JACCARD, "op10_nearcopies": NEAR, "op12_merkle": _merkle()}
