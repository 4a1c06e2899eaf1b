"""DuckDB SQL for the operators that SQL can express: quadratic, for small tables only."""

from __future__ import annotations

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"'[^\x20\x09-\x0D]+'"

#: Near duplicates: all pairs that share a shingle, and their closure.
NEAR_DUPLICATES = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), {_WORDS}) AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:i + 4], ' ')) AS s FROM w, LATERAL (SELECT unnest(range(1, greatest(len(w) - 3, 2))) AS i) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 80 * (x.n + y.n - c)),
both_ways AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT doc_id AS node, doc_id AS reached FROM w UNION SELECT node, b FROM r JOIN both_ways ON reached = a),
c AS (SELECT node, min(reached) AS component_id FROM r GROUP BY 1)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, component_id FROM w LEFT JOIN n USING (doc_id) JOIN c ON c.node = w.doc_id"""


def repeated_words(window: int) -> str:
    """Words covered by windows of words that occur twice or more."""
    return rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {_WORDS}) AS w FROM documents),
win AS (SELECT doc_id, i, md5(array_to_string(w[i:i + {window - 1}], ' ')) AS h FROM w, LATERAL (SELECT unnest(range(1, len(w) - {window - 2})) AS i)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY h) > 1),
gone AS (SELECT DISTINCT doc_id, i + k AS p FROM again, range({window}) r(k)),
marked AS (SELECT doc_id, p, w[p] AS x, gone.p IS NOT NULL AS removed FROM (SELECT doc_id, w, unnest(range(1, len(w) + 1)) AS p FROM w) LEFT JOIN gone USING (doc_id, p)),
spans AS (SELECT doc_id, p, x, removed, removed AND NOT coalesce(lag(removed) OVER (PARTITION BY doc_id ORDER BY p), false) AS opens FROM marked),
o AS (SELECT doc_id, count(*) FILTER (removed) AS n_removed, count(*) FILTER (opens) AS n_spans, array_to_string(list(x ORDER BY p) FILTER (NOT removed), ' ') AS kept FROM spans GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256, coalesce(n_spans, 0) AS n_spans FROM w LEFT JOIN o USING (doc_id)"""


def repeated_bytes(window: int) -> str:
    """Bytes covered by strings of bytes that occur twice or more."""
    return rf"""
WITH b AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, len(h) // 2 AS n, list_transform(range(len(h) // 800 + 1), lambda k: h[800 * k + 1:800 * k + {800 + 2 * window}]) AS chunks FROM b),
win AS (SELECT doc_id, 400 * (k - 1) + i AS i, md5(chunk[2 * i + 1:2 * i + {2 * window}]) AS g
  FROM (SELECT doc_id, n, chunks[k] AS chunk, k FROM c, LATERAL (SELECT unnest(range(1, len(chunks) + 1)) AS k)), LATERAL (SELECT unnest(range(0, least(400, n - 400 * (k - 1) - {window - 1}))) AS i)),
again AS (SELECT doc_id, i FROM win QUALIFY count(*) OVER (PARTITION BY g) > 1),
steps AS (SELECT doc_id, i, i - coalesce(lag(i) OVER (PARTITION BY doc_id ORDER BY i), -1000000) > {window} AS opens FROM again),
numbered AS (SELECT doc_id, i, sum(opens::INTEGER) OVER (PARTITION BY doc_id ORDER BY i) AS span FROM steps),
spans AS (SELECT doc_id, span, min(i) AS a, max(i) + {window} AS z FROM numbered GROUP BY ALL),
gaps AS (SELECT doc_id, a, z, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prior FROM spans),
o AS (SELECT doc_id, sum(z - a)::BIGINT AS n_removed, count(*) AS n_spans, string_agg(h[2 * prior + 1:2 * a], '' ORDER BY a) AS head, max(z) AS tail FROM gaps JOIN b USING (doc_id) GROUP BY doc_id)
SELECT b.doc_id, (len(h) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(head, '') || h[2 * coalesce(tail, 0) + 1:])) AS kept_sha256 FROM b LEFT JOIN o USING (doc_id)"""
