"""DuckDB SQL for op1_secret_scan and op5_jaccard_join, in the plainest form."""

from __future__ import annotations

import math

_WORDS = r"""list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '')"""

JACCARD = f"""
WITH RECURSIVE words AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, unnest(list_transform(generate_series(1, greatest(len(w) - 4, 1)),
    lambda i: array_to_string(w[i:i + 4], ' '))) AS s
  FROM words WHERE len(w) > 0
),
size AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
shared AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS m FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2
),
links AS (
  SELECT a, b FROM shared JOIN size x ON x.doc_id = a JOIN size y ON y.doc_id = b WHERE 100 * m >= 75 * (x.n + y.n - m)
),
reach(id, r) AS (
  SELECT doc_id, doc_id FROM documents UNION SELECT reach.id, links.b FROM reach JOIN links ON links.a = reach.r
)
SELECT d.doc_id, coalesce(size.n, 0) AS n_shingles, c.component_id
FROM documents d LEFT JOIN size USING (doc_id)
JOIN (SELECT id AS doc_id, min(r) AS component_id FROM reach GROUP BY 1) c USING (doc_id)
"""


def _lit(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _places(name: str, source: str, column: str, pattern: str) -> str:
    """Matches of ``pattern`` with their places: {name}(doc_id, i, m, start, stop)."""
    p = _lit(pattern)
    return f"""
{name}_m AS (SELECT doc_id, generate_subscripts(regexp_extract_all({column}, {p}), 1) AS i,
  unnest(regexp_extract_all({column}, {p})) AS m, regexp_split_to_array({column}, {p}) AS parts FROM {source}),
{name}_e AS (SELECT doc_id, i, m, sum(length(parts[i]) + length(m)) OVER (PARTITION BY doc_id ORDER BY i) AS stop FROM {name}_m),
{name} AS (SELECT doc_id, i, m, CAST(stop - length(m) AS BIGINT) AS start, CAST(stop AS BIGINT) AS stop FROM {name}_e)"""


def _blanked(name: str, source: str, column: str, pattern: str) -> str:
    """{name}(doc_id, rest): ``column`` with every match blanked out."""
    p = _lit(pattern)
    return f"""
{name} AS (SELECT doc_id, CASE WHEN len(f) = 0 THEN {column} ELSE array_to_string(list_transform(
    generate_series(1, len(parts)), lambda i: parts[i] || repeat(' ', coalesce(length(f[i]), 0))), '') END AS rest
  FROM (SELECT doc_id, {column}, regexp_extract_all({column}, {p}) AS f, regexp_split_to_array({column}, {p}) AS parts FROM {source}))"""


# The three patterns of the contract.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
RUN = "[A-Za-z0-9+/_=-]{20,}"
BITS = {"entropy_hex": 3.0, "entropy_letters": 4.1, "entropy_mixed": 3.8}
UUID = "[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{4}-[0-9a-fA-F]{12}"
PATH = "/?[A-Za-z]+/([A-Za-z]+/)+[A-Za-z]*"
HARMLESS = ("example", "sample", "placeholder", "changeme", "yourkey", "your-key", "your_key", "yourtoken", "your-token",
            "your_token", "abcdefgh", "ghijklmn", "12345678", "qwertyui")


def secret_scan() -> str:
    words = " OR ".join(f"contains(lower(hot), {_lit(w)})" for w in HARMLESS)
    # Six equal characters in a row.
    runs = "len(list_filter(generate_series(1, length(hot) - 5), lambda j: hot[j:j + 5] = repeat(hot[j], 6))) > 0"
    limits = " ".join(f"WHEN '{k}' THEN {int(20 * (math.log2(20) - bits) * 2 ** 30)}" for k, bits in BITS.items())
    order = "list_position(['assign', 'access', 'hex', 'entropy_hex', 'entropy_letters', 'entropy_mixed'], kind)"
    steps = f"CAST(round(count(*) * log2(count(*)) * {2 ** 30}) AS BIGINT)"

    def digest(where: str) -> str:
        return (f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, {order}, stop)"
                f" FILTER (WHERE {where}), '')")
    base = "kind IN ('assign', 'access', 'hex')"
    return f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
{_places('pa', 'docs', 'text', ASSIGN)},
{_places('pk', 'docs', 'text', ACCESS)},
{_places('ph', 'docs', 'text', HEX)},
{_blanked('r1', 'docs', 'text', ASSIGN)},
{_blanked('r2', 'r1', 'rest', ACCESS)},
{_blanked('r3', 'r2', 'rest', HEX)},
{_places('pc', 'r3', 'rest', RUN)},
judged AS (
  SELECT *, CASE WHEN regexp_full_match(m, '[0-9]+') THEN NULL
    WHEN regexp_full_match(m, '[0-9a-f]+|[0-9A-F]+') THEN 'entropy_hex'
    WHEN regexp_full_match(m, '[A-Za-z]+') THEN 'entropy_letters' ELSE 'entropy_mixed' END AS kind
  FROM pc WHERE NOT regexp_full_match(m, '{UUID}|{PATH}')
),
windows AS (
  SELECT doc_id, i, kind, start, w, unnest(string_split(m[w:w + 19], '')) AS c
  FROM (SELECT *, unnest(generate_series(1, length(m) - 19)) AS w FROM judged WHERE kind IS NOT NULL)
),
summed AS (
  SELECT doc_id, i, kind, start, w, sum(x) AS s
  FROM (SELECT doc_id, i, kind, start, w, {steps} AS x FROM windows GROUP BY doc_id, i, kind, start, w, c) GROUP BY ALL
),
stretch AS (
  SELECT doc_id, i, kind, min(w) AS a, max(w) + 19 AS b FROM summed WHERE s <= CASE kind {limits} END GROUP BY doc_id, i, kind
),
hot AS (
  SELECT doc_id, kind, start + a - 1 AS start, start + b AS stop
  FROM (SELECT s.*, judged.start, m[a:b] AS hot FROM stretch s JOIN judged USING (doc_id, i)) WHERE NOT ({words} OR {runs})
),
spans AS (
  SELECT doc_id, 'assign' AS kind, start, stop FROM pa
  WHERE length(regexp_extract(m, {_lit(ASSIGN)}, 1)) >= 6
  UNION ALL SELECT doc_id, 'access', start, stop FROM pk
  UNION ALL SELECT doc_id, 'hex', start, stop FROM ph
  UNION ALL SELECT doc_id, kind, start, stop FROM hot
)
SELECT d.doc_id, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
  count(*) FILTER (WHERE kind = 'hex') AS n_hex, sha256({digest(base)}) AS base_sha256,
  {digest('kind IS NOT NULL')} AS spans, count(*) FILTER (WHERE kind LIKE 'entropy%') AS n_entropy
FROM docs d LEFT JOIN spans USING (doc_id) GROUP BY d.doc_id
"""
