"""The queries of this subpackage, by name, and their SQL where SQL can express them."""

from __future__ import annotations

from concordia.llm.best_fit import op13_best_fit
from concordia.llm.conversations import op12_conversation_repair
from concordia.llm.divergence import op11_source_divergence
from concordia.llm.language_model import op10_language_model
from concordia.llm.media import op3_media
from concordia.llm.near_dup import op1_near_dup
from concordia.llm.nearest import op5_nearest
from concordia.llm.packing import op2_packing
from concordia.llm.secrets import op4_secrets
from concordia.llm.sentence_pieces import op9_sentence_pieces
from concordia.llm.token_counts import op8_token_counts
from concordia.llm.token_files import op7_token_files
from concordia.llm.toxicity import op6_toxicity


def queries() -> dict:
    ops = (
        op1_near_dup, op2_packing, op3_media, op4_secrets, op5_nearest, op6_toxicity, op7_token_files, op8_token_counts, op9_sentence_pieces,
        op10_language_model, op11_source_divergence, op12_conversation_repair, op13_best_fit,
    )
    return {f.__name__: f for f in ops}


#: All pairs of documents by their common shingles; for small tables, as the pairs grow with the square.
NEAR_DUP_SQL = r"""WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
'[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) < 2 THEN ws ELSE list_distinct(list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1])) END AS sh FROM w),
n AS (SELECT doc_id, CAST(len(sh) AS BIGINT) AS n FROM s), e AS (SELECT doc_id, unnest(sh) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
l AS (SELECT x, y FROM p JOIN n u ON u.doc_id = x JOIN n v ON v.doc_id = y WHERE 100 * c >= 80 * (u.n + v.n - c)),
ends AS (SELECT x, y FROM l UNION ALL SELECT y, x FROM l),
r(doc_id, root) AS (SELECT doc_id, doc_id FROM n UNION SELECT ends.y, r.root FROM r JOIN ends ON r.doc_id = ends.x)
SELECT n.doc_id, n.n AS n_shingles, m.root AS component_id, n.doc_id = m.root AS kept FROM n JOIN (SELECT doc_id, min(root) AS root FROM r GROUP BY doc_id) m ON m.doc_id = n.doc_id"""


#: Every kept term for every group and language, with a count of 0 where it doesn't occur.
DIVERGENCE_SQL = r"""WITH doc AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS ws FROM documents),
w AS (SELECT i, lang, source, unnest(ws) AS term FROM doc), kept AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
grp AS (SELECT DISTINCT lang, source FROM doc), cnt AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY lang, source, term),
g AS (SELECT k.lang, grp.source, k.term, coalesce(c, 0) AS c FROM kept k JOIN grp ON grp.lang = k.lang LEFT JOIN cnt ON cnt.lang = k.lang AND cnt.source = grp.source AND cnt.term = k.term),
p AS (SELECT *, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (sum(c) OVER (PARTITION BY lang, source) + 5 * count(*) OVER (PARTITION BY lang, source)) AS BIGINT) AS p FROM g),
l AS (SELECT lang, term, sum(c) AS c FROM g GROUP BY lang, term),
q AS (SELECT lang, term, CAST(1 + (CAST(1000000000 AS HUGEINT) * (c + 5)) // (sum(c) OVER (PARTITION BY lang) + 5 * count(*) OVER (PARTITION BY lang)) AS BIGINT) AS q FROM l),
pairs AS (SELECT x.lang, x.source, y.source AS item, sum(abs(x.p - y.p)) AS f FROM p x JOIN p y ON y.lang = x.lang AND y.term = x.term AND y.source <> x.source GROUP BY ALL),
r AS (SELECT x.lang, x.source, 'pair' AS part, y.source AS item, CAST(coalesce(f, 0) AS BIGINT) AS value FROM grp x JOIN grp y ON y.lang = x.lang AND y.source <> x.source
LEFT JOIN pairs ON pairs.lang = x.lang AND pairs.source = x.source AND pairs.item = y.source
UNION ALL SELECT p.lang, p.source, 'term', p.term, p - q FROM p JOIN q ON q.lang = p.lang AND q.term = p.term WHERE c > 0 AND p > q)
SELECT lang, source, part, item, value, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM r
QUALIFY part = 'pair' OR row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) <= 50"""


#: The damage by a table-driven CRC-32, then the same recursion over whole conversations, with the repaired lines beside each state.
REPAIR_SQL = r"""WITH RECURSIVE tab AS (SELECT list(list_reduce(list_prepend(i, range(8)), lambda v, k: CASE WHEN v & 1 = 1 THEN xor(v >> 1, 3988292384) ELSE v >> 1 END) ORDER BY i) AS t FROM range(256) r(i)),
k AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' ') AS key FROM conversations),
z AS (SELECT k.*, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(key, ''), lambda c: CAST(ascii(c) AS BIGINT))), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1])), 4294967295) % 20 AS kind FROM k, tab),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text,
unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS copy FROM z),
f AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) > 1 AS dup, rtrim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS body FROM d),
g AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text, dup) AS i, left(role, 1) AS initial, CASE WHEN body = '' THEN 'b' WHEN dup THEN 'd' WHEN right(body, 1) NOT IN ('.', '!', '?') THEN 't' ELSE '' END AS fault FROM f),
h AS (SELECT *, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) || initial AS two FROM g),
sums AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate,
count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal, max(i) AS n FROM h GROUP BY conv_id),
nxt(s, t, role) AS (VALUES (0, 2, 'user'), (1, 2, 'user'), (2, 3, 'assistant'), (3, 2, 'user')),
lead_(s, t, audit, cost, made) AS (SELECT s, s, '', 0, CAST([] AS VARCHAR[]) FROM range(4) r(s) UNION ALL SELECT l.s, n.t, l.audit || 'I', l.cost + 2, list_append(l.made, n.role || ':') FROM lead_ l JOIN nxt n ON n.s = l.t WHERE l.cost < 6),
moves(s, op, initial, t, role, cost) AS (SELECT s, 'D', '', s, '', 3 FROM range(4) r(s) UNION ALL SELECT s, 'R', '', t, role, 2 FROM nxt
UNION ALL VALUES (0, 'K', 's', 1, '', 0), (0, 'K', 'u', 2, '', 0), (1, 'K', 'u', 2, '', 0), (3, 'K', 'u', 2, '', 0), (2, 'K', 'a', 3, '', 0)),
dp(conv_id, i, s, cost, audit, made) AS (SELECT DISTINCT conv_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), '', CAST([] AS VARCHAR[]) FROM conversations
UNION ALL SELECT conv_id, i, s, min(cost), arg_min(audit, struct_pack(c := cost, a := audit)), arg_min(made, struct_pack(c := cost, a := audit)) FROM (
SELECT dp.conv_id, g.i, CAST(m.t AS BIGINT) AS s, CAST(dp.cost + l.cost + m.cost + CASE WHEN m.op <> 'D' AND g.fault = 't' THEN 1 ELSE 0 END AS BIGINT) AS cost, dp.audit || l.audit || m.op AS audit,
list_concat(dp.made, l.made, CASE m.op WHEN 'D' THEN [] WHEN 'R' THEN [m.role || ':' || g.text] ELSE [g.role || ':' || g.text] END) AS made
FROM dp JOIN g ON g.conv_id = dp.conv_id AND g.i = dp.i + 1 JOIN lead_ l ON l.s = dp.s JOIN moves m ON m.s = l.t AND (m.op = 'D' OR (g.fault NOT IN ('b', 'd') AND (m.op = 'R' OR m.initial = g.initial)))) GROUP BY conv_id, i, s),
e AS (SELECT dp.conv_id, dp.cost + l.cost AS cost, dp.audit || l.audit AS audit, list_concat(dp.made, l.made) AS made FROM dp JOIN lead_ l ON l.s = dp.s AND l.t IN (0, 3) LEFT JOIN sums ON sums.conv_id = dp.conv_id WHERE dp.i = coalesce(sums.n, 0)),
b AS (SELECT conv_id, CAST(min(cost) AS BIGINT) AS cost, arg_min(audit, struct_pack(c := cost, a := audit)) AS audit, arg_min(made, struct_pack(c := cost, a := audit)) AS made FROM e GROUP BY conv_id)
SELECT b.conv_id, coalesce(gaps, 0) AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, cost, audit,
sha256(array_to_string(made, chr(10))) AS repaired_sha256 FROM b LEFT JOIN sums ON sums.conv_id = b.conv_id"""


def oracle_sql() -> dict[str, str]:
    return {"op1_near_dup": NEAR_DUP_SQL, "op11_source_divergence": DIVERGENCE_SQL, "op12_conversation_repair": REPAIR_SQL}
