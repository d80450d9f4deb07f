"""DuckDB SQL for those queries of this subpackage that SQL can express."""

from __future__ import annotations

BLANK = "[\\x20\\x09-\\x0D]"

MIXING = f"""
WITH sized AS (
  SELECT doc_id, source, md5('7:' || doc_id) AS draw,
         len(list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> ''))::BIGINT AS size
  FROM documents),
by_source AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
weighed AS (
  SELECT source, source_size, 2.0::DOUBLE * source_size AS cap,
         CASE (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 WHEN 0 THEN 5.0 WHEN 1 THEN 2.0 ELSE 1.0 END::DOUBLE AS w
  FROM by_source),
want AS (SELECT 1.5::DOUBLE * sum(source_size) AS total FROM by_source),
ordered AS (
  SELECT *, coalesce(sum(cap) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps_before,
         sum(w) OVER (ORDER BY cap / w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS weights_from
  FROM weighed),
filled AS (SELECT o.*, (total - caps_before) * w / weights_from > cap AS is_full FROM ordered o, want),
level AS (SELECT max(total) - coalesce(sum(CASE WHEN is_full THEN cap END), 0) AS left_over, sum(CASE WHEN NOT is_full THEN w END) AS weight FROM filled, want),
targets AS (SELECT source, source_size, CASE WHEN is_full OR weight IS NULL THEN cap ELSE left_over * w / weight END AS target FROM filled, level),
rests AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END::BIGINT AS whole FROM targets),
placed AS (
  SELECT doc_id, size, source_size, target, whole, target - whole * source_size AS rest,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY draw, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM sized s JOIN rests r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target, (size * (whole + CASE WHEN before + size / 2.0::DOUBLE <= rest THEN 1 ELSE 0 END))::BIGINT AS taken
FROM placed
"""

LINES = f"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) AS pos
  FROM documents),
keyed AS (
  SELECT *, translate(regexp_replace(line, '^{BLANK}+|{BLANK}+$', '', 'g'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM lines),
common AS (
  SELECT key, max(doc_id) AS last FROM keyed WHERE length(key) >= 40 GROUP BY key HAVING count(DISTINCT doc_id) >= 5),
judged AS (SELECT k.doc_id, k.pos, k.line, coalesce(k.doc_id < c.last, false) AS dropped FROM keyed k LEFT JOIN common c ON k.key = c.key)
SELECT doc_id, count(*)::BIGINT AS n_lines, count(*) FILTER (dropped)::BIGINT AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (NOT dropped), '')) AS kept_sha256
FROM judged GROUP BY doc_id
"""

QUALITY = f"""
WITH docs AS (
  SELECT doc_id, source, coalesce(text, '') AS text,
         list_filter(regexp_split_to_array(coalesce(text, ''), '{BLANK}+'), lambda x: x <> '') AS words FROM documents),
windows AS (
  SELECT doc_id, unnest(range(1, len(words) - 6)) AS i, unnest(list_transform(range(1, len(words) - 6), lambda k: list_slice(words, k, k + 7))) AS w
  FROM docs WHERE len(words) >= 8),
again AS (SELECT doc_id, w FROM windows GROUP BY doc_id, w HAVING count(*) > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p) AS n FROM (
    SELECT s.doc_id, unnest(range(s.i, s.i + 8)) AS p FROM windows s JOIN again a ON s.doc_id = a.doc_id AND s.w = a.w) GROUP BY doc_id),
lines AS (
  SELECT doc_id, count(*) AS n, count(*) - count(DISTINCT line) AS dups FROM (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]') GROUP BY doc_id),
counts AS (
  SELECT d.doc_id, d.source, len(words)::BIGINT AS n_words, length(regexp_replace(text, '{BLANK}+', '', 'g'))::BIGINT AS word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         coalesce(dups, 0)::BIGINT AS n_dup_lines, coalesce(l.n, 0) AS n_lines, coalesce(c.n, 0)::BIGINT AS n_repeat_words
  FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN lines l ON d.doc_id = l.doc_id),
based AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM counts),
judged AS (
  SELECT *, base_failed OR word_chars < 2 * n_words OR word_chars > 20 * n_words OR 5 * n_symbols > n_words OR 2 * n_dup_lines > n_lines AS failed
  FROM based),
hosts AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (failed)::DOUBLE AS k FROM judged GROUP BY source),
whole AS (SELECT sum(n) AS nn, sum(k) AS kk, count(*)::DOUBLE AS h, sum(k * k / n) AS s FROM hosts),
moments AS (SELECT kk / nn AS m, s / nn - (kk / nn) ** 2 - kk / nn * (1 - kk / nn) * h / nn AS spread FROM whole),
prior AS (
  SELECT m, CASE WHEN spread <= 0 THEN 1000.0 ELSE greatest(1.0, least(1000.0, m * (1 - m) / spread - 1)) END::DOUBLE AS w FROM moments),
verdicts AS (SELECT source, (k + m * w) / (n + w) > 0.5 AS host_failed FROM hosts, prior)
SELECT j.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND NOT host_failed AS kept
FROM judged j JOIN verdicts v ON j.source IS NOT DISTINCT FROM v.source
"""


CONTAMINATION = """
WITH docs AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM documents),
items AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                              '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '') AS w FROM benchmark),
windows AS (
  SELECT DISTINCT item_id, n, list_slice(w, i, i + n - 1) AS words
  FROM (SELECT *, unnest(range(1, len(w) - n + 2)) AS i FROM (SELECT *, least(10, len(w)) AS n FROM items WHERE len(w) > 0))),
lengths AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT doc_id, n, i, list_slice(w, i, i + n - 1) AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM docs, lengths WHERE len(w) >= n)),
hits AS (SELECT p.doc_id, p.i, p.n, v.item_id FROM places p JOIN windows v ON p.words = v.words),
covered AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM hits) GROUP BY doc_id),
named AS (
  SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS item FROM hits WHERE item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit, coalesce(n.n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(n.names, '')) AS items_sha256, coalesce(c.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN covered c ON d.doc_id = c.doc_id LEFT JOIN named n ON d.doc_id = n.doc_id
"""

# each state's cheapest edit, as in the recursion below: (cost, edits) from row i on, for no role yet, system, user and assistant before
_NEXT = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}
_PUT = {0: 2, 1: 2, 2: 3, 3: 2}


def _edit(state: int) -> str:
    keeps = " ".join(f"WHEN initial = '{r}' THEN {{'c': extra + b{to}.c, 'a': 'K' || b{to}.a}}" for r, to in _NEXT[state].items())
    rerole = f"{{'c': 3 + extra + b{_PUT[state]}.c, 'a': 'R' || b{_PUT[state]}.a}}"
    return f"list_min([{{'c': 4 + b{state}.c, 'a': 'D' || b{state}.a}}, CASE WHEN gone THEN {{'c': 1000000000, 'a': ''}} ELSE {rerole} END, CASE WHEN gone THEN {{'c': 1000000000, 'a': ''}} {keeps} ELSE {{'c': 1000000000, 'a': ''}} END])"


def _put(state: int) -> str:
    return f"least(e{state}, {{'c': 3 + e{_PUT[state]}.c, 'a': 'I' || e{_PUT[state]}.a}})"


CONVERSATIONS = f"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS key
  FROM conversations),
crc(key, k, c) AS (
  SELECT DISTINCT key, 0, 4294967295::BIGINT FROM keyed
  UNION ALL
  SELECT key, k + 1, CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384) ELSE x >> 1 END
  FROM (SELECT key, k, CASE WHEN k % 8 = 0 THEN xor(c, unicode(substr(key, k // 8 + 1, 1))) ELSE c END AS x FROM crc WHERE k < 8 * length(key))),
damage AS (SELECT key, xor(c, 4294967295) % 20 AS h FROM crc WHERE k = 8 * length(key)),
hurt AS (
  SELECT conv_id, turn, CASE h WHEN 4 THEN 'user' ELSE role END AS role, CASE h WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text,
         unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) AS time
  FROM keyed JOIN damage USING (key)),
placed AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, md5(length(role) || ':' || role || text), time) AS i FROM hurt),
judged AS (
  SELECT *, substr(role, 1, 1) AS initial,
         CASE WHEN NOT regexp_matches(text, '[^\\x20\\x09-\\x0D]') THEN 'b'
              WHEN row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 THEN 'd'
              WHEN NOT regexp_matches(text, '[.!?][\\x20\\x09-\\x0D]*\\z') THEN 't' ELSE '' END AS fault
  FROM placed),
stepped AS (
  SELECT *, fault IN ('b', 'd') AS gone, CASE WHEN fault = 't' THEN 3 ELSE 0 END AS extra,
         i > 1 AND lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial NOT IN ('su', 'ua', 'au') AS wrong
  FROM judged),
counts AS (
  SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank,
         count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (wrong) AS illegal, count(*) AS n
  FROM stepped GROUP BY conv_id),
togo(conv_id, i, b0, b1, b2, b3) AS (
  SELECT conv_id, n + 1, {{'c': 0, 'a': ''}}, {{'c': 6, 'a': 'II'}}, {{'c': 3, 'a': 'I'}}, {{'c': 0, 'a': ''}} FROM counts
  UNION ALL
  SELECT conv_id, i, least({_put(0)}, {{'c': 6 + e3.c, 'a': 'II' || e3.a}}), least({_put(1)}, {{'c': 6 + e3.c, 'a': 'II' || e3.a}}), {_put(2)}, {_put(3)}
  FROM (SELECT t.conv_id, s.i, {_edit(0)} AS e0, {_edit(1)} AS e1, {_edit(2)} AS e2, {_edit(3)} AS e3
        FROM togo t JOIN stepped s ON t.conv_id IS NOT DISTINCT FROM s.conv_id AND s.i = t.i - 1)),
audits AS (SELECT conv_id, b0.c AS cost, b0.a AS audit FROM togo WHERE i = 1),
edits AS (
  SELECT conv_id, p, substr(audit, p, 1) AS edit, p - length(replace(substr(audit, 1, p), 'I', '')) AS put_in, p - length(replace(substr(audit, 1, p), 'D', '')) AS gone_by
  FROM (SELECT *, unnest(range(1, length(audit) + 1)) AS p FROM audits)),
left_ AS (
  SELECT e.conv_id, e.p, e.edit, e.p - gone_by AS j, s.role, s.text, bool_or(e.p - gone_by = 1 AND e.edit = 'K' AND s.initial = 's') OVER (PARTITION BY e.conv_id) AS led
  FROM edits e LEFT JOIN stepped s ON e.conv_id IS NOT DISTINCT FROM s.conv_id AND e.edit <> 'I' AND s.i = e.p - e.put_in WHERE e.edit <> 'D'),
texts AS (
  SELECT conv_id, string_agg(CASE WHEN edit = 'K' THEN role WHEN (j - led::INT) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || CASE WHEN edit = 'I' THEN '' ELSE text END, chr(10) ORDER BY p) AS repaired
  FROM left_ GROUP BY conv_id),
every AS (SELECT DISTINCT conv_id FROM conversations)
SELECT v.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
       coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost, coalesce(audit, '') AS audit,
       sha256(coalesce(repaired, '')) AS repaired_sha256
FROM every v LEFT JOIN counts c ON v.conv_id IS NOT DISTINCT FROM c.conv_id LEFT JOIN audits a ON v.conv_id IS NOT DISTINCT FROM a.conv_id
     LEFT JOIN texts t ON v.conv_id IS NOT DISTINCT FROM t.conv_id
"""


def oracle_sql() -> dict[str, str]:
    return {"op3_mixing": MIXING, "op6_line_dedup": LINES, "op8_quality": QUALITY, "op11_conversation_repair": CONVERSATIONS, "op12_decontamination": CONTAMINATION}
