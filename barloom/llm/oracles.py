"""DuckDB's SQL for the numbered queries that SQL can express."""

from __future__ import annotations

WORDS = r"[^\x20\x09-\x0D]+"


def mixing_sql(weights: dict[str, dict[str, int]], levels: tuple[str, ...], domain: str, budget: tuple[int, int], epochs: int, seed: int) -> str:
    """The same budgets by the same rule; the place of the cut by one running sum over each leaf."""
    weight = lambda level: "CASE " + " ".join(f"WHEN {level} = '{v}' THEN {w}" for v, w in weights.get(level, {}).items()) + " ELSE 1 END" if weights.get(level) else "1"
    ctes = [
        f"d AS (SELECT doc_id, coalesce({domain}, '(none)') AS domain, coalesce(lang, '(none)') AS lang, coalesce(source, '(none)') AS source, CAST(coalesce(len(regexp_extract_all(text, '{WORDS}')), 0) AS BIGINT) AS n_tokens FROM documents)",
        f"leaf AS (SELECT {', '.join(levels)}, CAST(sum(n_tokens) AS HUGEINT) AS supply FROM d GROUP BY ALL)",
        f"b0 AS (SELECT least(sum(supply) * {epochs}, sum(supply) * {budget[0]} // {budget[1]}) AS budget FROM leaf)",
    ]
    for depth, level in enumerate(levels, 1):
        own, above = ", ".join(levels[:depth]), ", ".join(levels[: depth - 1])
        by = f"PARTITION BY {above}" if above else ""
        join = f"JOIN b{depth - 1} USING ({above})" if above else f"CROSS JOIN b{depth - 1}"
        order = f"ORDER BY CAST(cap AS DOUBLE) / w, {level}"
        ctes += [
            f"n{depth} AS (SELECT {own}, CAST(sum(supply) * {epochs} AS HUGEINT) AS cap, CAST({weight(level)} AS HUGEINT) AS w FROM leaf GROUP BY {own})",
            f"m{depth} AS (SELECT n{depth}.*, budget AS b, coalesce(sum(cap) OVER ({by} {order} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS c, sum(w) OVER ({by} {order} ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS rw FROM n{depth} {join} WHERE w > 0)",
            f"f{depth} AS (SELECT *, cap * rw <= (b - c) * w AS is_full FROM m{depth})",
            f"b{depth} AS (SELECT {own}, CASE WHEN is_full THEN cap ELSE least(cap, ((b - coalesce(sum(cap) FILTER (WHERE is_full) OVER ({by}), 0)) * w) // (sum(w) FILTER (WHERE NOT is_full) OVER ({by}))) END AS budget FROM f{depth})",
        ]
    names = ", ".join(levels)
    ctes += [
        f"l AS (SELECT leaf.*, coalesce(budget, 0) AS budget FROM leaf LEFT JOIN b{len(levels)} USING ({names}))",
        "e AS (SELECT *, CASE WHEN supply > 0 THEN budget // supply ELSE 0 END AS epochs FROM l)",
        f"k AS (SELECT d.*, e.epochs, budget - e.epochs * supply AS rest, md5(concat('{seed}:', CAST(e.epochs AS BIGINT), ':', doc_id)) AS key FROM d JOIN e USING ({names}))",
        f"u AS (SELECT {names}, key, sum(n_tokens) AS unit, sum(sum(n_tokens)) OVER (PARTITION BY {names} ORDER BY key) - sum(n_tokens) AS before FROM k GROUP BY {names}, key)",
    ]
    return f"""WITH {', '.join(ctes)} SELECT {names}, doc_id, n_tokens, CAST(epochs AS BIGINT) AS epochs, CAST(epochs * n_tokens + CASE WHEN rest <= 0 OR before > rest OR unit = 0 THEN 0 WHEN before + unit <= rest THEN n_tokens ELSE ((rest - before) * n_tokens) // unit END AS BIGINT) AS tokens_taken FROM k JOIN u USING ({names}, key)"""


#: SHA-1 in base32: forty hexadecimal digits as bits, five of them a letter.
BITS = "list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(strpos('0123456789abcdef', substr(h, CAST(i AS INT), 1)) - 1), 4, '0')), lambda a, x: concat(a, x))"
LETTERS = "list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', 1 + CAST(list_reduce(list_transform(range(1, 6), lambda j: CAST(substr(bits, CAST(5 * i + j AS INT), 1) AS INT) * CAST(pow(2, 5 - j) AS INT)), lambda a, x: a + x) AS INT), 1)), lambda a, x: concat(a, x))"
WARC_SQL = f"""WITH p AS (SELECT page_id, coalesce(html, '') AS payload FROM pages), s AS (SELECT page_id, strlen(payload) AS payload_bytes, sha1(payload) AS h, min(page_id) OVER (PARTITION BY payload) AS first FROM p),
b AS (SELECT *, {BITS} AS bits FROM s) SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, {LETTERS} AS payload_digest, CASE WHEN page_id = first THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> first THEN first END AS refers_to, CAST(NULL AS VARCHAR) AS problem FROM b"""

TOPK_SQL = """WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(256 * CAST(x AS DOUBLE))) AS x FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.x, c.x) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.vec_id <> c.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM s) SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5"""

LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
JACCARD_SQL = f"""WITH RECURSIVE w AS (SELECT doc_id, coalesce(regexp_extract_all({LOWERED}, '{WORDS}'), []) AS x FROM documents),
s AS MATERIALIZED (SELECT doc_id, list_sort(list_distinct(CASE WHEN len(x) = 0 THEN [] WHEN len(x) < 5 THEN [array_to_string(x, ' ')] ELSE list_transform(range(1, len(x) - 3), lambda i: array_to_string(x[i:i + 4], ' ')) END)) AS g FROM w),
c AS MATERIALIZED (SELECT min(doc_id) AS c, g, len(g) AS n FROM s WHERE len(g) > 0 GROUP BY g),
t AS MATERIALIZED (SELECT c, n, unnest(g) AS t FROM c),
o AS (SELECT a.c AS a, b.c AS b, count(*) AS n_both, any_value(a.n) + any_value(b.n) AS size FROM t a JOIN t b ON a.t = b.t AND a.c < b.c AND b.n * 100 >= a.n * 80 AND a.n * 100 >= b.n * 80 GROUP BY ALL),
e AS MATERIALIZED (SELECT a, b FROM o WHERE 100 * n_both >= 80 * (size - n_both) UNION ALL SELECT b, a FROM o WHERE 100 * n_both >= 80 * (size - n_both)),
r(c, reached) AS (SELECT c, c FROM c UNION SELECT r.c, e.b FROM r JOIN e ON r.reached = e.a),
m AS (SELECT c, min(reached) AS component_id FROM r GROUP BY c)
SELECT s.doc_id, CAST(len(s.g) AS BIGINT) AS n_shingles, coalesce(m.component_id, s.doc_id) AS component_id FROM s LEFT JOIN c ON s.g = c.g LEFT JOIN m ON m.c = c.c"""

TERMS = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
SEARCH_SQL = f"""WITH t AS (SELECT doc_id, unnest(regexp_extract_all({LOWERED}, '{TERMS}')) AS term FROM documents), p AS (SELECT doc_id, term, count(*) AS tf FROM t GROUP BY ALL),
d AS (SELECT doc_id, count(*) AS n FROM t GROUP BY doc_id), c AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS l FROM d),
f AS (SELECT term, CAST(floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)::DOUBLE)) AS BIGINT) AS w FROM p CROSS JOIN c GROUP BY term),
q AS (SELECT item_id, term, count(*) AS q FROM (SELECT item_id, unnest(regexp_extract_all({LOWERED}, '{TERMS}')) AS term FROM benchmark) GROUP BY ALL),
s AS (SELECT item_id, doc_id, CAST(sum(q * w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 75 + (75 * n * docs) // l)))) AS BIGINT) AS score FROM q JOIN f USING (term) JOIN p USING (term) JOIN d USING (doc_id) CROSS JOIN c GROUP BY ALL),
r AS (SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INT) AS rank, doc_id, score FROM s WHERE score > 0) SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10"""
