"""DuckDB SQL for those queries whose rows SQL can express. The others hold trained models, a tokenizer, an edit distance,
components of a similarity graph or all strings of a length; tests/llm compares them with plain versions."""

from __future__ import annotations

from . import line_spread, merkle, mixing

_NAMES, _GIVEN, _B = list(mixing.WEIGHTS), list(mixing.WEIGHTS.values()), mixing.BLOCK

OP4 = f"""WITH RECURSIVE rest AS (SELECT DISTINCT source FROM documents WHERE source IS NULL OR NOT list_contains({_NAMES}, source)),
raw AS (SELECT unnest({_NAMES}) AS source, unnest({_GIVEN}) * greatest(1, (SELECT count(*) FROM rest)) AS w, unnest(range({len(_NAMES)})) AS ord UNION ALL SELECT source, {mixing.OTHERS}, {len(_NAMES)} - 1 + row_number() OVER (ORDER BY source NULLS LAST) FROM rest),
numbered AS (SELECT source, w, row_number() OVER (ORDER BY ord) - 1 AS part FROM raw),
whole AS (SELECT list(w ORDER BY part) AS ws, list_reduce(list(w ORDER BY part), lambda a, b: gcd(a, b)) AS g FROM numbered),
cfg AS (SELECT list_transform(ws, lambda w: w // g) AS shares, CAST(list_sum(list_transform(ws, lambda w: w // g)) AS BIGINT) AS h, len(ws) AS k FROM whole),
sched AS (SELECT 0 AS t, (SELECT list_transform(range(0, k), lambda s: 0) FROM cfg) AS given, CAST(0 AS BIGINT) AS part, false AS placed
UNION ALL
SELECT t + 1, list_transform(given, lambda n, i: n + CASE WHEN i - 1 = s THEN 1 ELSE 0 END), s, true FROM (
SELECT t, given, list_min(list_filter(list_transform(range(0, k), lambda s: CASE WHEN given[s + 1] * h // shares[s + 1] <= t THEN CAST(ceil((given[s + 1] + 1) * h / shares[s + 1]) AS BIGINT) * 100000 + s END), lambda x: x IS NOT NULL)) % 100000 AS s
FROM sched, cfg WHERE t < h)),
slots AS (SELECT t - 1 AS slot, part, given[part + 1] - 1 AS nth, list_transform(given, lambda n, i: n - CASE WHEN i - 1 = part THEN 1 ELSE 0 END) AS before FROM sched WHERE placed),
named AS (SELECT doc_id, d.source, part, md5('{mixing.SEED}:' || doc_id) AS k FROM documents d JOIN numbered n ON n.source IS NOT DISTINCT FROM d.source),
ranked AS (SELECT *, row_number() OVER (PARTITION BY part ORDER BY k, doc_id) - 1 AS pos FROM named),
have AS (SELECT list(n ORDER BY part) AS have FROM (SELECT p.part, count(d.doc_id) AS n FROM numbered p LEFT JOIN named d USING (part) GROUP BY p.part)),
blocks AS (SELECT doc_id, source, part, pos, pos // {_B} AS block, shares[part + 1] AS share FROM ranked, cfg),
placed AS (SELECT b.*, s.slot, s.before, b.block // share AS rounds FROM blocks b JOIN slots s ON s.part = b.part AND s.nth = b.block % b.share)
SELECT doc_id, source, source AS part, block, block * h // share AS release, CAST(ceil((block + 1) * h / share) AS BIGINT) AS deadline, rounds * h + slot AS slot,
CAST(list_sum(list_transform(range(0, k), lambda s: least(have[s + 1], {_B} * (rounds * shares[s + 1] + before[s + 1])))) + pos % {_B} AS BIGINT) AS position FROM placed, have, cfg"""

OP6 = rf"""WITH t AS (SELECT row_number() OVER () AS row, page_id, lower(regexp_extract(coalesce(url, ''), '^[A-Za-z][A-Za-z0-9+.-]*://([^/?#:]+)', 1)) AS site,
regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(coalesce(html, ''), '(?is)<script.*?</script>|<style.*?</style>|<!--.*?-->', ' ', 'g'), '[ \t\r\n\f]+', ' ', 'g'),
'(?i)</?(?:{line_spread.BLOCK_TAGS})(?:[ /][^>]*)?>', chr(10), 'g'), '<[^>]*>', ' ', 'g'), ' *\n *', chr(10), 'g'), ' +', ' ', 'g') AS text FROM pages),
l AS (SELECT row, site, unnest(list_transform(string_split(text, chr(10)), lambda x: trim(x))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM t),
f AS (SELECT * FROM l WHERE line <> ''), b AS (SELECT line FROM f GROUP BY line HAVING count(DISTINCT site) >= {line_spread.MIN_SITES}),
m AS (SELECT f.*, b.line IS NOT NULL AS gone FROM f LEFT JOIN b ON f.line = b.line),
s AS (SELECT row, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_removed, string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone) AS kept FROM m GROUP BY row)
SELECT page_id, site, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, coalesce(kept, '') AS text FROM t LEFT JOIN s USING (row)"""


#: The table by which crc32 takes a byte, and crc32 of an ASCII text with it.
_CRC_TABLE = "crc AS (SELECT list_transform(range(0, 256), lambda n: list_reduce(list_prepend(n, [0, 0, 0, 0, 0, 0, 0, 0]), lambda c, z: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc_table)"


def _crc32(text: str) -> str:
    bytes_of = f"list_transform(string_split({text}, ''), lambda ch: CAST(ascii(ch) AS BIGINT))"
    return f"xor(4294967295, list_reduce(list_prepend(4294967295, {bytes_of}), lambda c, b: xor(c >> 8, crc_table[(xor(c, b) & 255) + 1])))"


#: States of the roles: 0 none, 1 after the system row, 2 after a user's, 3 after an assistant's. A value of the fold is the
#: cost in nine digits and the audit, so that the least one is the cheapest and then the ASCII-least.
OP11 = f"""WITH RECURSIVE {_CRC_TABLE},
faulty AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, {_crc32("coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ')")} % 20 AS fault FROM conversations, crc),
dealt AS (SELECT conv_id, turn, CASE WHEN fault = 4 THEN 'user' ELSE role END AS role, CASE WHEN fault = 1 THEN '' WHEN fault = 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE fault WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM faulty),
ids AS (SELECT conv_id, row_number() OVER () AS c FROM (SELECT DISTINCT conv_id FROM conversations)),
numbered AS (SELECT c, turn, role, text, rtrim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS ended, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, role, sha256(strlen(role) || ':' || role || text), copy) AS i FROM dealt JOIN ids ON ids.conv_id IS NOT DISTINCT FROM dealt.conv_id),
seen AS (SELECT *, ended = '' AS blank, ended <> '' AND row_number() OVER (PARTITION BY c, role, text ORDER BY i) > 1 AS twice, left(role, 1) AS initial FROM numbered),
r AS (SELECT *, NOT blank AND NOT twice AND right(ended, 1) NOT IN ('.', '!', '?') AS cut, lag(initial) OVER (PARTITION BY c ORDER BY i) || initial AS pair FROM seen),
nxt(p, initial, q) AS (VALUES (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
given(p, role, q) AS (VALUES (0, 'user', 2), (1, 'user', 2), (3, 'user', 2), (2, 'assistant', 3)),
ins AS (SELECT p, 0 AS cost, '' AS audit, '' AS rows, p AS q FROM (VALUES (0), (1), (2), (3)) x(p) UNION ALL SELECT p, 5, 'I', role || ':' || chr(10), q FROM given
UNION ALL SELECT a.p, 10, 'II', a.role || ':' || chr(10) || b.role || ':' || chr(10), b.q FROM given a JOIN given b ON a.q = b.p),
edits AS (SELECT c, i, ins.p, ins.cost + 2 AS cost, ins.audit || 'D' AS audit, ins.rows AS rows, ins.q FROM r, ins
UNION ALL SELECT c, i, ins.p, ins.cost + CASE WHEN cut THEN 5 ELSE 0 END, ins.audit || 'K', ins.rows || role || ':' || text || chr(10), nxt.q FROM r, ins JOIN nxt ON nxt.p = ins.q WHERE nxt.initial = r.initial AND NOT blank AND NOT twice
UNION ALL SELECT c, i, ins.p, ins.cost + 1 + CASE WHEN cut THEN 5 ELSE 0 END, ins.audit || 'R', ins.rows || given.role || ':' || text || chr(10), given.q FROM r, ins JOIN given ON given.p = ins.q WHERE NOT blank AND NOT twice),
fold AS (SELECT c, CAST(0 AS BIGINT) AS i, 0 AS q, '000000000' AS v, '' AS rows FROM ids
UNION ALL SELECT f.c, e.i, e.q, min(lpad(CAST(CAST(left(v, 9) AS BIGINT) + e.cost AS VARCHAR), 9, '0') || substring(v, 10) || e.audit), arg_min(f.rows || e.rows, lpad(CAST(CAST(left(v, 9) AS BIGINT) + e.cost AS VARCHAR), 9, '0') || substring(v, 10) || e.audit)
FROM fold f JOIN edits e ON e.c = f.c AND e.i = f.i + 1 AND e.p = f.q GROUP BY f.c, e.i, e.q),
longest AS (SELECT ids.c, coalesce(max(i), 0) AS n FROM ids LEFT JOIN r ON r.c = ids.c GROUP BY ids.c),
closed AS (SELECT f.c, lpad(CAST(CAST(left(v, 9) AS BIGINT) + ins.cost AS VARCHAR), 9, '0') || substring(v, 10) || ins.audit AS v, f.rows || ins.rows AS rows FROM fold f JOIN longest l ON l.c = f.c AND l.n = f.i JOIN ins ON ins.p = f.q WHERE ins.q IN (0, 3)),
best AS (SELECT c, min(v) AS v, arg_min(rows, v) AS rows FROM closed GROUP BY c),
counts AS (SELECT c, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (WHERE blank) AS blank, count(*) FILTER (WHERE twice) AS duplicate, count(*) FILTER (WHERE cut) AS truncated, count(*) FILTER (WHERE pair NOT IN ('su', 'ua', 'au')) AS illegal FROM r GROUP BY c)
SELECT ids.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, CAST(left(v, 9) AS BIGINT) AS cost, substring(v, 10) AS audit, sha256(CASE WHEN rows = '' THEN '' ELSE left(rows, -1) END) AS repaired_sha256
FROM ids JOIN best USING (c) LEFT JOIN counts USING (c)"""


def _field(value: str) -> str:
    return f"coalesce(strlen(CAST({value} AS VARCHAR)) || ':' || CAST({value} AS VARCHAR), '-')"


def _leaf(n_chars: str) -> str:
    return "sha256(" + " || ".join(_field(n_chars if c == "n_chars" else c) for c in merkle.FIELDS) + ")"


def _tree(name: str, nodes: str) -> str:
    """Levels of the trees over nodes (g, n, nth, h), and of each node the siblings from the lowest level on, with the side on which they stand."""
    return f"""{name} AS (SELECT 0 AS lvl, g, n, nth, h FROM {nodes} UNION ALL SELECT lvl + 1, g, (n + 1) // 2, nth // 2, sha256(string_agg(h, '' ORDER BY nth)) FROM {name} WHERE n > 1 GROUP BY lvl, g, n, nth // 2),
{name}_path AS (SELECT x.g, x.nth, list(CASE WHEN (x.nth >> a.lvl) % 2 = 1 THEN 'L' ELSE 'R' END || coalesce(b.h, '') ORDER BY a.lvl) AS path FROM {nodes} x JOIN {name} a ON a.g = x.g AND a.nth = x.nth >> a.lvl AND a.n > 1 LEFT JOIN {name} b ON b.g = a.g AND b.lvl = a.lvl AND b.nth = xor(a.nth, 1) GROUP BY x.g, x.nth)"""


OP13 = f"""WITH RECURSIVE {_CRC_TABLE},
rows AS (SELECT doc_id, coalesce('=' || lang, '-') AS g, {_leaf("n_chars")} AS h, CASE WHEN {_crc32("CAST(doc_id AS VARCHAR)")} % 7 = 0 THEN {_leaf("CAST(n_chars AS HUGEINT) + 1")} ELSE {_leaf("n_chars")} END AS other FROM documents, crc),
leaves AS (SELECT *, row_number() OVER (PARTITION BY g ORDER BY doc_id NULLS FIRST, h) - 1 AS nth, count(*) OVER (PARTITION BY g) AS n FROM rows),
{_tree("sub", "leaves")},
tops AS (SELECT 0 AS g, count(*) OVER () AS n, row_number() OVER (ORDER BY g) - 1 AS nth, g AS lang, h FROM sub WHERE n = 1),
{_tree("top", "tops")},
paths AS (SELECT l.doc_id, l.h AS leaf, l.other, t.h AS subroot, list_concat(coalesce(p.path, []), coalesce(q.path, [])) AS path FROM leaves l JOIN tops t ON t.lang = l.g LEFT JOIN sub_path p ON p.g = l.g AND p.nth = l.nth LEFT JOIN top_path q ON q.nth = t.nth),
folded AS (SELECT *, (SELECT h FROM top WHERE n = 1) AS root, sha256(list_reduce(list_prepend('', path), lambda a, s: a || substring(s, 2))) AS proof_sha256,
list_reduce(list_prepend(other, path), lambda a, s: sha256(CASE WHEN s[1] = 'L' THEN substring(s, 2) || a ELSE a || substring(s, 2) END)) AS folded_root FROM paths)
SELECT doc_id, leaf, subroot, root, proof_sha256, folded_root, folded_root = root AS verified FROM folded"""


def oracle_sql() -> dict[str, str]:
    return {"op4_pfair_mix": OP4, "op6_spread_lines": OP6, "op11_repaired_conversations": OP11, "op13_merkle_manifest": OP13}
