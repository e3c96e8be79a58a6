"""DuckDB SQL for those training-data queries that SQL can express."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, ENDPOINT, HEX

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
WORDS = "regexp_extract_all(translate(coalesce(text, ''), '" + UPPER + "', '" + LOWER + r"'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH i AS (SELECT DISTINCT coalesce(item_id::VARCHAR, '') AS item, {WORDS} AS ws FROM benchmark),
wi AS (SELECT item, least(10, len(ws)) AS n, ws FROM i WHERE len(ws) > 0),
win AS (SELECT DISTINCT item, n, array_to_string(ws[p + 1 : p + n], ' ') AS s FROM wi, unnest(range(len(ws) - n + 1)) AS t(p)),
d AS (SELECT doc_id, {WORDS} AS ws FROM documents),
pos AS (SELECT doc_id, p, n, array_to_string(ws[p + 1 : p + n], ' ') AS s FROM d, (SELECT DISTINCT n FROM win), unnest(range(greatest(len(ws) - n + 1, 0))) AS t(p)),
hit AS (SELECT doc_id, p, pos.n, item FROM pos JOIN win ON pos.n = win.n AND pos.s = win.s),
w AS (SELECT doc_id, count(DISTINCT k)::BIGINT AS n_hit FROM hit, unnest(range(p, p + n)) AS t(k) GROUP BY doc_id),
m AS (SELECT doc_id, count(*)::BIGINT AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN w USING (doc_id) LEFT JOIN m USING (doc_id)"""

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
g AS (SELECT h, max(page_id) AS top FROM p WHERE strlen(h) >= 1000 GROUP BY h HAVING count(*) > 1)
SELECT page_id, strlen(h)::BIGINT AS payload_bytes, sha1(h) AS payload_digest, CASE WHEN top <> page_id THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN top <> page_id THEN top END AS refers_to
FROM p LEFT JOIN g USING (h)"""

SUFFIXES = r"""
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS hx FROM documents),
c AS (SELECT doc_id, o, strlen(hx) // 2 AS n, substr(hx, 2 * o + 1, 2 * 899) AS part FROM d, unnest(range(0, greatest(strlen(hx) // 2 - 399, 0), 500)) AS t(o)),
w AS (SELECT doc_id, o + q AS p, md5_number(substr(part, 2 * q + 1, 800)) AS k FROM c, unnest(range(least(500, n - 399 - o))) AS t(q)),
r AS (SELECT k FROM w GROUP BY k HAVING count(*) > 1),
m AS (SELECT doc_id, p, CASE WHEN p <= lag(p) OVER (PARTITION BY doc_id ORDER BY p) + 400 THEN 0 ELSE 1 END AS new FROM w SEMI JOIN r USING (k)),
g AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS run FROM m),
s AS (SELECT doc_id, min(p) AS a, max(p) + 400 AS z FROM g GROUP BY doc_id, run),
b AS (SELECT doc_id, a, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS prev FROM s),
k AS (SELECT doc_id, string_agg(substr(hx, 2 * prev + 1, 2 * (a - prev)), '' ORDER BY a) AS kept FROM b JOIN d USING (doc_id) GROUP BY doc_id),
e AS (SELECT doc_id, max(z) AS last, sum(z - a)::BIGINT AS n_removed, count(*)::BIGINT AS n_spans FROM s GROUP BY doc_id),
ws AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x09-\x0D\x20]+'), lambda x: x <> '') AS words FROM documents),
ww AS (SELECT doc_id, p, md5_number(array_to_string(words[p + 1 : p + 50], ' ')) AS k FROM ws, unnest(range(greatest(len(words) - 49, 0))) AS t(p)),
wr AS (SELECT k FROM ww GROUP BY k HAVING count(*) > 1),
wm AS (SELECT doc_id, p, least(50, p - lag(p) OVER (PARTITION BY doc_id ORDER BY p)) AS gain FROM ww SEMI JOIN wr USING (k)),
wn AS (SELECT doc_id, sum(coalesce(gain, 50))::BIGINT AS n_shared_words FROM wm GROUP BY doc_id)
SELECT doc_id, (strlen(hx) // 2)::BIGINT AS n_bytes, coalesce(n_removed, 0)::BIGINT AS n_removed, coalesce(n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(kept, '') || substr(hx, 2 * coalesce(last, 0) + 1))) AS kept_sha256, coalesce(n_shared_words, 0)::BIGINT AS n_shared_words
FROM d LEFT JOIN k USING (doc_id) LEFT JOIN e USING (doc_id) LEFT JOIN wn USING (doc_id)"""


def _quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


def _places(pattern: str, kind: str) -> str:
    """Matches m of a pattern with their places: running sums over matches and the pieces between them."""
    p = _quoted(pattern)
    return f"""SELECT doc_id, {kind} AS kind, a AS start, a + length(m) AS stop FROM (
SELECT doc_id, m, list_sum([length(x) for x in gaps[1 : j]])::BIGINT + coalesce(list_sum([length(x) for x in ms[1 : j - 1]]), 0)::BIGINT AS a FROM (
SELECT doc_id, unnest(ms) AS m, generate_subscripts(ms, 1) AS j, ms, string_split_regex(text, {p}) AS gaps FROM (SELECT doc_id, text, regexp_extract_all(text, {p}) AS ms FROM docs)))"""


_VALUE = f"length(regexp_extract(m, {_quoted(ASSIGN)}, 1))"
#: The opaque pattern without look-around, which this dialect lacks: its matches are maximal runs all the same.
_OPAQUE = "[A-Za-z0-9+/]{32,}={0,2}"
_BESIDE = "x.doc_id = y.doc_id AND y.start <= x.stop + 200 AND y.stop >= x.start - 200 AND (y.stop <= x.start OR y.start >= x.stop)"

SECRETS = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
parts AS (SELECT * FROM (
{_places(ASSIGN, f"CASE WHEN {_VALUE} >= 12 THEN 'assign' WHEN {_VALUE} >= 8 THEN 'weak_secret' END")} UNION ALL
{_places(ACCESS, "CASE WHEN length(m) >= 18 THEN 'access' WHEN length(m) >= 12 THEN 'weak_access' END")} UNION ALL
{_places(HEX, "'hex'")} UNION ALL
{_places(ENDPOINT, "'endpoint'")} UNION ALL
{_places(_OPAQUE, "CASE WHEN length(rtrim(m, '=')) >= 32 AND NOT starts_with(m, 'AKIA') AND regexp_matches(m, '[0-9]') AND regexp_matches(m, '[A-Za-z]') THEN 'weak_secret' END")}
) WHERE kind IS NOT NULL),
near AS (SELECT DISTINCT x.*, CASE WHEN y.kind IN ('access', 'weak_access') THEN 'id' WHEN y.kind = 'endpoint' THEN 'end' ELSE 'secret' END AS to_kind FROM parts x JOIN parts y ON {_BESIDE} WHERE x.kind IN ('weak_secret', 'weak_access', 'endpoint')),
linked AS (SELECT DISTINCT doc_id, kind, start, stop FROM near WHERE kind = 'weak_secret' AND to_kind IN ('id', 'end') OR kind = 'weak_access' AND to_kind = 'secret'
UNION SELECT doc_id, kind, start, stop FROM near WHERE kind = 'endpoint' AND to_kind IN ('id', 'secret') GROUP BY ALL HAVING count(DISTINCT to_kind) = 2),
kept AS (SELECT * FROM parts WHERE kind IN ('assign', 'access', 'hex') UNION ALL SELECT * FROM linked),
t AS (SELECT *, kind || ':' || start || ':' || stop AS s, list_position(['assign', 'access', 'hex', 'weak_secret', 'weak_access', 'endpoint'], kind) AS rank FROM kept),
a AS (SELECT doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex, string_agg(s, ',' ORDER BY start, rank) FILTER (rank <= 3) AS base, string_agg(s, ',' ORDER BY start, rank, stop) AS spans FROM t GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access, coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM docs LEFT JOIN a USING (doc_id)"""

ORACLES = {"op4_decontamination": DECONTAMINATION, "op7_warc": WARC, "op9_secrets": SECRETS, "op10_suffix_dedup": SUFFIXES}
