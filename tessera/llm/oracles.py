"""SQL for those training-data queries that SQL can express."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = r"[^\x20\x09-\x0D]+"

#: Sets of 5-word shingles, links by counting common ones, components by spreading the smallest id.
OP1 = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_WORDS}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, unnest(list_transform(range(1, greatest(2, len(w) - 3)), lambda i: md5(array_to_string(w[i:i + 4], ' ')))) AS g FROM w WHERE len(w) > 0),
c AS (SELECT doc_id, md5(string_agg(g, '' ORDER BY g)) AS k, count(*) AS n FROM s GROUP BY 1),
f AS (SELECT k, min(doc_id) AS rep, any_value(n) AS n FROM c GROUP BY 1),
r AS (SELECT rep, g FROM f JOIN s ON s.doc_id = f.rep),
o AS (SELECT a.rep AS a, b.rep AS b, count(*) AS o FROM r a JOIN r b ON a.g = b.g AND a.rep < b.rep GROUP BY 1, 2),
l AS (SELECT a, b FROM o JOIN f x ON x.rep = a JOIN f y ON y.rep = b WHERE 100 * o >= 75 * (x.n + y.n - o)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
p AS (SELECT rep AS v, rep AS label FROM f UNION SELECT e.b, p.label FROM p JOIN e ON e.a = p.v WHERE p.label < e.b),
m AS (SELECT v, min(label) AS component FROM p GROUP BY 1), d AS (SELECT a, count(*) AS links FROM e GROUP BY 1)
SELECT w.doc_id, coalesce(c.n, 0) AS n_shingles, coalesce(m.component, w.doc_id) AS component_id, f.rep AS class_id, coalesce(d.links, 0) AS n_class_links
FROM w LEFT JOIN c ON c.doc_id = w.doc_id LEFT JOIN f ON f.k = c.k LEFT JOIN m ON m.v = f.rep LEFT JOIN d ON d.a = f.rep"""

_BENCH_WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

#: Windows of ten words (a shorter item is one) against all word windows of that size of each document.
OP5 = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_BENCH_WORDS}') AS w FROM documents), b AS (SELECT item_id, regexp_extract_all({_LOWER}, '{_BENCH_WORDS}') AS w FROM benchmark),
i AS (SELECT DISTINCT item_id, least(10, len(w)) AS size, unnest(list_transform(range(1, greatest(2, len(w) - 8)), lambda p: md5(array_to_string(w[p:p + 9], ' ')))) AS g FROM b WHERE len(w) > 0),
z AS (SELECT DISTINCT size FROM i),
d AS (SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS p, unnest(list_transform(range(1, len(w) - size + 2), lambda p: md5(array_to_string(w[p:p + size - 1], ' ')))) AS g FROM w, z WHERE len(w) >= size),
h AS (SELECT DISTINCT doc_id, item_id, d.size, p FROM d JOIN i ON i.size = d.size AND i.g = d.g),
n AS (SELECT doc_id, count(DISTINCT q) AS n_hit FROM (SELECT doc_id, unnest(range(p, p + size)) AS q FROM (SELECT DISTINCT doc_id, size, p FROM h)) GROUP BY 1),
t AS (SELECT doc_id, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id::VARCHAR, ',' ORDER BY item_id::VARCHAR) AS items FROM h GROUP BY 1)
SELECT w.doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN n ON n.doc_id = w.doc_id LEFT JOIN t ON t.doc_id = w.doc_id"""


def _spans(kind: int, name: str, pattern: str, keep: str) -> str:
    """Leftmost non-overlapping matches, by cutting the text at them: the pieces between give the places."""
    return rf"""SELECT doc_id, {kind} AS kind, '{name}' AS name, s, s + length(m) AS e FROM (
  SELECT doc_id, m, sum(length(gap) + coalesce(length(before), 0)) OVER (PARTITION BY doc_id ORDER BY i) AS s FROM (
    SELECT doc_id, i, gap, m, lag(m) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM (
      SELECT doc_id, unnest(range(1, len(ms) + 1)) AS i, unnest(ms) AS m, unnest(gaps[1:len(ms)]) AS gap FROM (
        SELECT doc_id, regexp_extract_all(text, '{pattern}') AS ms, string_split(regexp_replace(text, '{pattern}', chr(1), 'g'), chr(1)) AS gaps FROM (SELECT doc_id, replace(coalesce(text, ''), chr(1), chr(2)) AS text FROM documents))
      WHERE len(ms) > 0)))
  WHERE {keep}"""


_ASSIGN = r"""(?i)(password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""

#: The base spans of op6 only.
SECRET_BASE = rf"""
WITH s AS ({_spans(0, "assign", _ASSIGN, f"length(regexp_extract(m, '{_ASSIGN}', 2)) >= 6")}
UNION ALL {_spans(1, "access", "AKIA[A-Z0-9]+", "length(m) >= 20")}
UNION ALL {_spans(2, "hex", "[0-9a-f]+", "length(m) >= 24")}),
g AS (SELECT doc_id, count(*) FILTER (kind = 0) AS a, count(*) FILTER (kind = 1) AS k, count(*) FILTER (kind = 2) AS h, string_agg(name || ':' || s::BIGINT || ':' || e::BIGINT, ',' ORDER BY s, kind) AS spans FROM s GROUP BY 1)
SELECT d.doc_id, coalesce(a, 0) AS n_assign, coalesce(k, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(spans, '')) AS base_sha256 FROM documents d LEFT JOIN g ON g.doc_id = d.doc_id"""

#: Base32 of a SHA-1: each character is five bits out of two neighbouring hexadecimal digits.
OP7 = r"""
WITH p AS (SELECT page_id, strlen(coalesce(html, '')) AS n, sha1(coalesce(html, '')) AS h, max(page_id) OVER (PARTITION BY sha1(coalesce(html, ''))) AS last,
  regexp_extract(lower(url), '^[a-z]+://(?:www\.)?([^/:?#]*)', 1) AS host, regexp_extract(lower(url), '^[a-z]+://[^/?#]*([^#]*)', 1) AS rest FROM pages),
k AS (SELECT *, array_to_string(list_reverse(string_split(host, '.')), ',') || ')' || CASE WHEN rest LIKE '/%' THEN rest ELSE '/' || rest END AS urlkey FROM p)
SELECT page_id, n AS payload_bytes, array_to_string(list_transform(range(0, 32), lambda i: 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567'[(((('0x' || h[i * 5 // 4 + 1])::INT * 16 + ('0x' || h[i * 5 // 4 + 2])::INT) >> (3 - i * 5 % 4)) & 31) + 1]), '') AS payload_digest,
  CASE WHEN page_id = last THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id < last THEN last END AS refers_to, row_number() OVER (ORDER BY urlkey, page_id) - 1 AS position FROM k"""

#: The counts and the fixed limits of op10.
RULE_COUNTS = rf"""
WITH w AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{_WORDS}') AS w FROM documents),
g AS (SELECT doc_id, unnest(range(1, len(w) - 6)) AS p, unnest(list_transform(range(1, len(w) - 6), lambda p: md5(array_to_string(w[p:p + 7], ' ')))) AS g FROM w WHERE len(w) >= 8),
a AS (SELECT doc_id, p FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, g) > 1), r AS (SELECT doc_id, count(DISTINCT q) AS n FROM (SELECT doc_id, unnest(range(p, p + 8)) AS q FROM a) GROUP BY 1),
l AS (SELECT doc_id, count(*) - count(DISTINCT x) AS n FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS x FROM w) WHERE regexp_matches(x, '{_WORDS}') GROUP BY 1),
c AS (SELECT w.doc_id, len(w)::BIGINT AS n_words, list_sum(list_transform(w, lambda x: length(x)))::BIGINT AS word_chars, (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, coalesce(l.n, 0) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words FROM w LEFT JOIN l ON l.doc_id = w.doc_id LEFT JOIN r ON r.doc_id = w.doc_id)
SELECT doc_id, n_words, coalesce(word_chars, 0) AS word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM c"""

#: The restored text is the text itself, as every output gives it back.
OP13 = r"""
WITH u AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '[^\n]*\n|[^\n]+') AS units, sha256('7:' || coalesce(doc_id::VARCHAR, '')) AS h FROM documents),
h AS (SELECT *, len(units) AS n, ('0x' || substr(h, 1, 8))::UBIGINT::BIGINT AS h1, ('0x' || substr(h, 9, 8))::UBIGINT::BIGINT AS h2, ('0x' || substr(h, 25, 8))::UBIGINT::BIGINT AS h4 FROM u),
c AS (SELECT *, least(h1 % (n + 1), h2 % (n + 1)) AS lo, greatest(h1 % (n + 1), h2 % (n + 1)) AS hi FROM h),
p AS (SELECT doc_id, t, n, CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') THEN 'plain' WHEN h4 % 100 < 50 THEN 'spm' ELSE 'psm' END AS form,
  coalesce(array_to_string(units[1:lo], ''), '') AS prefix, coalesce(array_to_string(units[lo + 1:hi], ''), '') AS middle, coalesce(array_to_string(units[hi + 1:], ''), '') AS suffix FROM c)
SELECT doc_id, n::BIGINT AS n, form, CASE WHEN form <> 'plain' THEN length(prefix) END::BIGINT AS prefix_chars, CASE WHEN form <> 'plain' THEN length(middle) END::BIGINT AS middle_chars,
  sha256(CASE form WHEN 'psm' THEN '<P>' || prefix || '<S>' || suffix || '<M>' || middle WHEN 'spm' THEN '<S>' || suffix || '<P>' || prefix || '<M>' || middle ELSE t END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM p
"""
