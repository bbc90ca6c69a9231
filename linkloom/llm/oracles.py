"""DuckDB SQL for the results of the queries that SQL can express, written apart from the operators: windows, shingles, lines and words are compared as they are."""

from __future__ import annotations

from linkloom.llm.op8_sharding import ORACLE as OP8
from linkloom.llm.op10_hamming_topk import ORACLE as OP10

UPPER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
OP9 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS place, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
line AS (SELECT r, place, unnest(lines) AS line, unnest(range(len(lines))) AS i FROM doc),
keyed AS (SELECT r, place, line, i, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), {UPPER}) AS key FROM line),
hot AS (SELECT key, max(place) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT r) >= 5),
told AS (SELECT k.r, k.line, k.i, h.last IS NULL OR h.last = k.place AS kept FROM keyed k LEFT JOIN hot h ON h.key = k.key),
left_ AS (SELECT r, count(*) AS n_lines, count(*) FILTER (NOT kept) AS n_dropped, sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (kept), '')) AS kept_sha256 FROM told GROUP BY r)
SELECT d.doc_id, l.n_lines, l.n_dropped, l.kept_sha256 FROM doc d JOIN left_ l ON l.r = d.r
"""
WORDS = r"regexp_extract_all(translate(coalesce(text, ''), " + UPPER + r"), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
OP7 = f"""
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, {WORDS} AS w FROM documents),
item AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS id, {WORDS} AS w FROM benchmark),
win AS (SELECT DISTINCT id, k, w[i + 1:i + k] AS words FROM (SELECT id, w, least(10, len(w)) AS k, unnest(range(len(w) - least(10, len(w)) + 1)) AS i FROM item WHERE len(w) > 0) x),
word AS (SELECT r, unnest(w) AS x, unnest(range(len(w))) AS i FROM doc),
begin_ AS (SELECT word.r, word.i, f.k FROM word JOIN (SELECT DISTINCT k, words[1] AS x FROM win) f ON f.x = word.x),
spot AS (SELECT b.r, i, k, w[i + 1:i + k] AS words FROM begin_ b JOIN doc d ON d.r = b.r WHERE i + k <= len(w)),
found AS (SELECT a.r, a.i, a.k, v.id FROM spot a JOIN win v ON v.k = a.k AND v.words = a.words),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM found) x GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids FROM (SELECT DISTINCT r, id FROM found) x GROUP BY r)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256, n_hit IS NOT NULL AS contaminated
FROM doc d LEFT JOIN hit h ON h.r = d.r LEFT JOIN items i ON i.r = d.r
"""
OP1 = """
WITH doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS place, hex(encode(coalesce(text, ''))) AS h FROM documents),
part AS (SELECT r, place, c, substr(h, 2 * c + 1, 610) AS h FROM (SELECT r, place, h, unnest(range(0, CAST(len(h) // 2 - 49 AS BIGINT), 256)) AS c FROM doc WHERE len(h) >= 100) x),
win AS (SELECT r, place, c + i AS i, substr(h, 2 * i + 1, 100) AS w FROM (SELECT r, place, c, h, unnest(range(CAST(least(256, len(h) // 2 - 49) AS BIGINT))) AS i FROM part) x),
least_ AS (SELECT w, min(place) AS place FROM win GROUP BY w HAVING min(place) < max(place)),
gone AS (SELECT win.r, win.i FROM win JOIN least_ l ON l.w = win.w AND l.place < win.place),
runs AS (SELECT r, i, sum(fresh) OVER (PARTITION BY r ORDER BY i) AS run FROM (SELECT r, i, CASE WHEN i <= lag(i) OVER (PARTITION BY r ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM gone) x),
spans AS (SELECT r, min(i) AS a, max(i) + 50 AS z FROM runs GROUP BY r, run),
kept AS (SELECT s.r, s.z - s.a AS n, substr(d.h, 2 * before + 1, 2 * (a - before)) AS piece, a FROM (SELECT *, coalesce(lag(z) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM spans) s JOIN doc d ON d.r = s.r),
told AS (SELECT r, CAST(sum(n) AS BIGINT) AS n_removed, count(*) AS n_spans, string_agg(piece, '' ORDER BY a) AS pieces FROM kept GROUP BY r),
ends AS (SELECT r, max(z) AS z FROM spans GROUP BY r)
SELECT d.doc_id, CAST(len(h) // 2 AS BIGINT) AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(pieces, '') || substr(h, 2 * coalesce(z, 0) + 1))) AS kept_sha256
FROM doc d LEFT JOIN told t ON t.r = d.r LEFT JOIN ends e ON e.r = d.r
"""
OP5 = f"""
WITH RECURSIVE
doc AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS place, regexp_extract_all(translate(coalesce(text, ''), {UPPER}), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
shingle AS (SELECT DISTINCT r, array_to_string(w[i + 1:i + 4], ' ') AS x FROM (SELECT r, w, unnest(range(greatest(len(w) - 3, 1))) AS i FROM doc WHERE len(w) > 0) y),
sets AS (SELECT r, count(*) AS n, md5(string_agg(x, chr(10) ORDER BY x)) AS same FROM shingle GROUP BY r),
class AS (SELECT same, min(r) AS c, any_value(n) AS n FROM sets GROUP BY same),
own AS (SELECT c, n, x FROM class JOIN shingle ON r = c),
pair AS (SELECT a.c AS a, b.c AS b FROM own a JOIN own b ON a.x = b.x AND a.c < b.c GROUP BY a.c, b.c, a.n, b.n HAVING 100 * count(*) >= 80 * (a.n + b.n - count(*))),
edge AS (SELECT a, b FROM pair UNION ALL SELECT b, a FROM pair),
reach AS (SELECT c, c AS m FROM class UNION SELECT e.b, reach.m FROM reach JOIN edge e ON e.a = reach.c),
part AS (SELECT c, min(m) AS part FROM reach GROUP BY c),
placed AS (SELECT d.r, d.doc_id, d.place, s.n, p.part FROM doc d LEFT JOIN sets s ON s.r = d.r LEFT JOIN class USING (same) LEFT JOIN part p ON p.c = class.c),
named AS (SELECT *, CASE WHEN part IS NULL THEN place ELSE min(place) OVER (PARTITION BY part) END AS component FROM placed)
SELECT doc_id, coalesce(n, 0) AS n_shingles, nullif(component, 9223372036854775807) AS component_id, component = place AS kept FROM named
"""

_FOLD = "list_reduce(list_transform({xs}, lambda v: CAST(len(v) AS BIGINT)), lambda a, b: a + b, CAST(0 AS BIGINT))"
KINDS = {
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+",
    "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)",
    "card": r"[0-9]([\x20-]?[0-9])+",
    "phone": r"\+[0-9][\x20().0-9-]+[0-9]",
    "secret": r"""(?i)(?:token|secret|passw(?:or)?d|pwd|api[_-]?key|access[_-]?key|private[_-]?key|credential)s?["'']?\s{0,4}[:=]\s{0,4}["'']?([A-Za-z0-9+/_=-]{16,})""",
}
TERM = r"[\p{L}\p{M}\p{N}]+"
_PLACED = "SELECT {keep}, {kind} AS kind, unnest(range(len(hits))) AS i, hits, gaps FROM (SELECT {keep}, regexp_extract_all({text}, '{pattern}') AS hits, regexp_split_to_array({text}, '{pattern}') AS gaps FROM {source}) x"


def placed(source: str, keep: str, kind: str, text: str, pattern: str) -> str:
    inner = _PLACED.format(source=source, keep=keep, kind=kind, text=text, pattern=pattern)
    """(keep, kind, value, a) of all matches: what stands before one is as long as the gaps and matches before it."""
    return f"SELECT {keep}, kind, hits[i + 1] AS value, {_FOLD.format(xs='gaps[1:i + 1]')} + {_FOLD.format(xs='hits[1:i]')} AS a FROM ({inner}) y"


_ALL = " UNION ALL ".join(placed("texts", "same, text", f"'{k}'", "text", p) for k, p in KINDS.items())
_ORDER = "list_position(['email', 'ip', 'card', 'phone', 'secret', 'term'], kind)"
OP3 = f"""
WITH
doc AS (SELECT doc_id, coalesce(text, '') AS text, md5(coalesce(text, '')) AS same FROM documents),
texts AS (SELECT same, any_value(text) AS text FROM doc GROUP BY same),
raw AS ({_ALL}),
trimmed AS (SELECT same, kind, CASE WHEN kind = 'secret' THEN regexp_extract(value, '{KINDS['secret']}', 1) ELSE value END AS value, a, len(value) AS whole FROM raw),
spot AS (SELECT same, kind, value, a + whole - len(value) AS a, a + whole AS z, regexp_replace(value, '[^0-9]', '', 'g') AS digits FROM trimmed),
found AS (SELECT same, kind, value, a, z FROM spot WHERE CASE kind
  WHEN 'email' THEN true
  WHEN 'ip' THEN len(list_filter(string_split(value, '.'), lambda p: CASE WHEN len(ltrim(p, '0')) > 3 THEN true ELSE coalesce(TRY_CAST(ltrim(p, '0') AS INTEGER), 0) > 255 END)) = 0
  WHEN 'card' THEN len(digits) BETWEEN 13 AND 19 AND list_sum(list_transform(string_split(reverse(digits), ''), lambda c, i: CASE WHEN i % 2 = 1 THEN CAST(c AS INTEGER) ELSE 2 * CAST(c AS INTEGER) - CASE WHEN CAST(c AS INTEGER) > 4 THEN 9 ELSE 0 END END)) % 10 = 0
  WHEN 'phone' THEN len(digits) BETWEEN 9 AND 15
  ELSE len(value) >= 16 AND regexp_matches(value, '[0-9]') END),
cover AS (SELECT same, list([a, z]) AS spans FROM found GROUP BY same),
clear AS (SELECT t.same, CASE WHEN c.spans IS NULL THEN t.text ELSE array_to_string(list_transform(string_split(t.text, ''), lambda x, i: CASE WHEN len(list_filter(c.spans, lambda s: s[1] < i AND i <= s[2])) > 0 THEN ' ' ELSE x END), '') END AS text FROM texts t LEFT JOIN cover c ON c.same = t.same),
word AS (SELECT DISTINCT same, unnest(list_transform(regexp_extract_all(text, '{TERM}'), lambda x: lower(x))) AS term FROM clear),
holds AS (SELECT DISTINCT same, kind || ':' || lower(value) AS entity FROM found),
total AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM texts),
often AS (SELECT entity, CAST(count(*) AS DOUBLE) AS c_e FROM holds, total GROUP BY entity, n HAVING count(*) >= 3 AND count(*) < n),
both_ AS (SELECT entity, term, count(*) AS c FROM holds JOIN often USING (entity) JOIN word USING (same) GROUP BY entity, term HAVING count(*) >= 3),
seen AS (SELECT term, CAST(count(*) AS DOUBLE) AS c_t FROM word GROUP BY term),
told AS (SELECT DISTINCT term FROM both_ JOIN often USING (entity) JOIN seen USING (term), total WHERE ln(c * n / (c_e * c_t)) >= 0.9 * ln(n / c_e)),
marked AS (SELECT c.same, c.text FROM clear c WHERE c.same IN (SELECT w.same FROM word w JOIN told USING (term))),
term AS ({placed("marked", "same", "'term'", "text", TERM)}),
every AS (
  SELECT same, kind, a, z FROM found
  UNION ALL SELECT t.same, t.kind, t.a, t.a + len(t.value) FROM term t JOIN told ON told.term = lower(t.value)),
joined AS (
  SELECT same, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY {_ORDER}, a) AS spans, string_agg(kind || ':' || a || ':' || z, ',' ORDER BY {_ORDER}, a) FILTER (kind NOT IN ('secret', 'term')) AS base,
    count(*) AS n_spans, count(*) FILTER (kind = 'email') AS n_email, count(*) FILTER (kind = 'ip') AS n_ip, count(*) FILTER (kind = 'card') AS n_card, count(*) FILTER (kind = 'phone') AS n_phone
  FROM every GROUP BY same)
SELECT d.doc_id, coalesce(n_email, 0) AS n_email, coalesce(n_ip, 0) AS n_ip, coalesce(n_card, 0) AS n_card, coalesce(n_phone, 0) AS n_phone, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_spans, 0) AS n_spans
FROM doc d LEFT JOIN joined j ON j.same = d.same
"""

ORACLE_SQL: dict[str, str] = {
    "op1_suffix_dedup": OP1,
    "op3_private": OP3,
    "op5_minhash": OP5,
    "op7_decontamination": OP7,
    "op8_sharding": OP8,
    "op9_line_dedup": OP9,
    "op10_hamming_topk": OP10,
}
