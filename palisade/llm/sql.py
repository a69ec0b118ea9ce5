"""The same results in SQL, where SQL can express them."""

from __future__ import annotations

from .secret_scan import RULES

_NORM = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

_OP2 = f"""
WITH d AS (SELECT doc_id, {_NORM} AS norm FROM documents),
     g AS (SELECT norm, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY norm)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id = g.keep_id AS kept, sha256(d.norm) AS text_sha256
FROM d JOIN g ON d.norm = g.norm
"""


def _op7() -> str:
    """One branch per rule: matches and the pieces between them alternate, so their lengths give the offsets."""
    parts = []
    for rank, r in enumerate(RULES):
        rx = r.pattern.replace("'", "''")
        parts.append(f"""
SELECT doc_id, '{r.kind}' AS kind, {rank} AS rank, {str(r.base).lower()} AS base, i,
       list_sum(list_transform(p[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS s, length(m[i]) AS n, length(g[i]) AS gn, {r.least} AS least
FROM (SELECT doc_id, m, g, p, unnest(range(1, len(m) + 1)) AS i FROM (
  SELECT doc_id, regexp_extract_all(t, '{rx}', 0) AS m, regexp_extract_all(t, '{rx}', {r.group}) AS g, string_split_regex(t, '{rx}') AS p FROM t WHERE regexp_matches(t, '{rx}')))""")
    counts = ", ".join(f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in RULES if r.base)
    zero = ", ".join(f"coalesce(f.n_{r.kind}, 0) AS n_{r.kind}" for r in RULES if r.base)
    return f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
     s AS ({" UNION ALL ".join(parts)}),
     k AS (SELECT *, kind || ':' || s || ':' || (s + n) AS said FROM s WHERE gn >= least),
     f AS (SELECT doc_id, {counts}, coalesce(string_agg(said, ',' ORDER BY s, rank) FILTER (base), '') AS b, string_agg(said, ',' ORDER BY s, rank) AS spans FROM k GROUP BY doc_id)
SELECT t.doc_id, {zero}, sha256(coalesce(f.b, '')) AS base_sha256, coalesce(f.spans, '') AS spans FROM t LEFT JOIN f USING (doc_id)
"""


SQL = {
    "op2_exact_dedup": _OP2,
    "op7_secret_scan": _op7(),
}
