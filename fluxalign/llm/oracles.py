"""DuckDB SQL of the text queries that SQL can express, for side-by-side comparison.

Learned scores (op4) and seeded segmentations (op5) have no SQL form; tests hold them against
held-out labels, brute force and exact round trips.
"""

from __future__ import annotations

import os

from .quality_rules import CLASSES, COMMON

#: Folder of the public vocabulary files; the driver reads it.
TOKENIZERS = os.environ.get("TOKENIZER_FILES", "/opt/tokenizers")
WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
TEXTS = f"d AS (SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents)"


def grams(source: str, n: int) -> str:
    """doc_id, i, g: hashes of the n-word windows, by their first words' numbers."""
    each = f"list_transform(range(1, len(w) - {n - 2}), lambda i: md5(array_to_string(w[i:i + {n - 1}], ' ')))"
    return f"SELECT doc_id, unnest(range(1, len(w) - {n - 2})) AS i, unnest({each}) AS g FROM {source} WHERE len(w) >= {n}"


SUBSTRINGS = f"""WITH {TEXTS}, win AS ({grams('d', 20)}),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, row_number() OVER (PARTITION BY g ORDER BY doc_id, i) AS r FROM win) WHERE r > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM again),
words AS (SELECT doc_id, unnest(range(1, len(w) + 1)) AS p, unnest(w) AS word FROM d),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t, count(*) AS n FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT d.doc_id, len(w) AS n_words, len(w) - coalesce(n, 0) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id"""

BYTES = """WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
win AS (SELECT doc_id, unnest(range(1, octet_length(b) - 398)) AS i, unnest(list_transform(range(1, octet_length(b) - 398), lambda i: md5(array_slice(b, i, i + 399)))) AS g FROM d WHERE octet_length(b) >= 400),
twice AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY g) AS c FROM win) WHERE c > 1),
marked AS (SELECT doc_id, i, CASE WHEN i <= lag(i) OVER (PARTITION BY doc_id ORDER BY i) + 400 THEN 0 ELSE 1 END AS fresh FROM twice),
numbered AS (SELECT doc_id, i, sum(fresh) OVER (PARTITION BY doc_id ORDER BY i) AS k FROM marked),
spans AS (SELECT doc_id, k, min(i) AS a, max(i) + 400 AS z FROM numbered GROUP BY ALL),
pieces AS (SELECT doc_id, a AS place, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 1) AS x, a - 1 AS y FROM spans
 UNION ALL SELECT d.doc_id, octet_length(b) + 1, coalesce(last, 1), octet_length(b) FROM d LEFT JOIN (SELECT doc_id, max(z) AS last FROM spans GROUP BY 1) s ON d.doc_id = s.doc_id),
kept AS (SELECT p.doc_id, string_agg(CASE WHEN y >= x THEN hex(array_slice(b, x, y)) ELSE '' END, '' ORDER BY place) AS t FROM pieces p JOIN d ON p.doc_id = d.doc_id GROUP BY 1),
size AS (SELECT doc_id, sum(z - a) AS n, count(*) AS c FROM spans GROUP BY 1)
SELECT d.doc_id, octet_length(b) AS n_bytes, coalesce(n, 0)::BIGINT AS n_removed, coalesce(c, 0) AS n_spans, sha256(unhex(coalesce(t, ''))) AS kept_sha256 FROM d LEFT JOIN kept ON d.doc_id = kept.doc_id LEFT JOIN size ON d.doc_id = size.doc_id"""

JACCARD = f"""WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, g FROM ({grams('d', 4)}) UNION ALL SELECT doc_id, array_to_string(w, ' ') FROM d WHERE len(w) BETWEEN 1 AND 3),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
shared AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id <> y.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * c >= 85 * (p.n + q.n - c)),
reach AS (SELECT doc_id AS a, doc_id AS b FROM d UNION SELECT r.a, l.b FROM reach r JOIN links l ON r.b = l.a)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.component_id FROM d LEFT JOIN n ON d.doc_id = n.doc_id JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY 1) c ON c.a = d.doc_id"""

LETTER = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
BENCHMARK = f"""WITH d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{LETTER}') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{LETTER}') AS w FROM benchmark WHERE text IS NOT NULL),
win AS (SELECT DISTINCT item_id, least(len(w), 10) AS n, unnest(list_transform(range(1, greatest(len(w) - 8, 2)), lambda i: array_to_string(w[i:i + 9], ' '))) AS g FROM b WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, n, unnest(range(1, len(w) - n + 2)) AS i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) AS g FROM d, sizes WHERE len(w) >= n),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
hit AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM (SELECT DISTINCT doc_id, i, n FROM hits)) GROUP BY 1),
items AS (SELECT doc_id, list_sort(list(DISTINCT item_id::VARCHAR)) AS k FROM hits WHERE item_id IS NOT NULL GROUP BY 1)
SELECT d.doc_id, len(w) AS n_words, coalesce(h, 0) AS n_hit, coalesce(len(k), 0) AS n_items, sha256(coalesce(array_to_string(k, ','), '')) AS items_sha256, coalesce(h, 0) > 0 AS contaminated
 FROM d LEFT JOIN hit ON d.doc_id = hit.doc_id LEFT JOIN items ON d.doc_id = items.doc_id"""


def _counted(members: str) -> str:
    quoted = members.replace("'", "''")
    return f"length(text) - length(regexp_replace(text, '[{quoted}]', '', 'g'))"


def _term(a: str, m: str) -> str:
    return f"CASE WHEN {a} > 0 THEN {a} * log2({a} / ({m})) ELSE 0 END"


def _distances(shares: str, name: str) -> str:
    """By document: Jensen-Shannon distance of (doc_id, lang, n_words, k, share) from the mean of the language."""
    m = "(share + ref) / 2"
    return f"""{name}_ref AS (SELECT lang, k, avg(share) AS ref FROM {shares} WHERE n_words >= 50 GROUP BY ALL),
{name} AS (SELECT doc_id, sqrt(greatest(0, sum({_term('share', m)} + {_term('ref', m)}) / 2)) AS {name} FROM {shares} JOIN {name}_ref USING (lang, k) WHERE n_words >= 50 GROUP BY doc_id)"""


_COMMON = ", ".join(f"('{lang}', {k}, '{word}')" for lang, words in COMMON.items() for k, word in enumerate(words))
QUALITY = f"""WITH d AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '{WORD}') AS w FROM documents),
c AS (SELECT doc_id, lang, w, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) AS n, {', '.join(f'{_counted(m)} AS c{i}' for i, m in enumerate(CLASSES))},
 list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '{WORD}')) AS lines FROM d),
tri AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, g) AS m FROM ({grams('d', 3)})),
rep AS (SELECT doc_id, count(DISTINCT p) AS r FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS p FROM tri WHERE m > 1) GROUP BY 1),
kind AS (SELECT doc_id, lang, n_words, unnest(range(6)) AS k, unnest([n - word_chars, c0, c1, c2, c3, word_chars - c0 - c1 - c2 - c3])::DOUBLE / nullif(n, 0) AS share FROM c),
common(lang, k, word) AS (VALUES {_COMMON}),
words AS (SELECT doc_id, lang, unnest(w) AS word FROM c),
hits AS (SELECT doc_id, k, count(*) AS h FROM words JOIN common USING (lang, word) GROUP BY ALL),
listed AS (SELECT c.doc_id, c.lang, n_words, k, coalesce(h, 0) AS h FROM c JOIN common USING (lang) LEFT JOIN hits USING (doc_id, k)),
word_share AS (SELECT doc_id, lang, n_words, k, h::DOUBLE / nullif(n_words, 0) AS share FROM listed UNION ALL SELECT doc_id, lang, n_words, 15, (n_words - sum(h))::DOUBLE / nullif(n_words, 0) FROM listed GROUP BY doc_id, lang, n_words),
{_distances('kind', 'char_distance')}, {_distances('word_share', 'word_distance')},
j AS (SELECT c.doc_id, n_words, word_chars, c0 AS n_symbols, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r, 0) AS n_repeat_words, n_words < 50 OR 100 * coalesce(r, 0) > 50 * n_words AS base_failed, char_distance, word_distance
 FROM c LEFT JOIN rep ON c.doc_id = rep.doc_id LEFT JOIN char_distance x ON c.doc_id = x.doc_id LEFT JOIN word_distance y ON c.doc_id = y.doc_id)
SELECT * EXCLUDE (char_distance, word_distance), NOT base_failed AND coalesce(char_distance, 0) <= 0.3 AND coalesce(word_distance, 0) <= 0.27 AS kept, round(char_distance, 6) AS char_distance, round(word_distance, 6) AS word_distance FROM j"""

ASSIGN = r"(?i:password|passwd|secret|token|api_?key)[\"'']?\x20*[:=]\x20*[\"'']?([A-Za-z0-9+/_.=-]+)"
KINDS = {"assign": ASSIGN, "access": "AKIA[A-Z0-9]{16,}", "hex": "[0-9a-f]{24,}", "mixed": "[A-Za-z0-9+/_-]{20,}"}


def _found(k: int, pattern: str) -> str:
    """doc_id, owner, repository, k, s, e, v of the matches, whose places follow from the texts between them."""
    at = "coalesce(list_sum(list_transform(gaps[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0)"
    value = "v[i]" if k == 0 else "m[i]"
    values = f"regexp_extract_all(text, '{pattern}', 1)" if k == 0 else "NULL"
    rows = f"list_transform(range(1, len(m) + 1), lambda i: {{'s': ({at})::BIGINT, 'm': m[i], 'v': {value}}})"
    return f"""SELECT doc_id, owner, repository, {k} AS k, x.s AS s, x.s + length(x.m) AS e, x.v AS v FROM (SELECT doc_id, owner, repository, unnest({rows}) AS x FROM
 (SELECT *, regexp_extract_all(text, '{pattern}') AS m, {values} AS v, regexp_split_to_array(text, '{pattern}') AS gaps FROM d)){' WHERE length(x.v) >= 6' if k == 0 else ''}"""


_JOINED = "string_agg(['assign', 'access', 'hex', 'mixed'][k + 1] || ':' || s || ':' || e, ',' ORDER BY s, k)"
SECRETS = f"""WITH d AS (SELECT doc_id, coalesce(text, '') AS text, coalesce(source, chr(1)) AS owner, concat_ws('/', source, lang) AS repository FROM documents),
base AS ({' UNION ALL '.join(_found(k, p) for k, p in enumerate(list(KINDS.values())[:3]))}),
long AS ({_found(3, KINDS['mixed'])}),
letters AS (SELECT v, count(*) AS c FROM (SELECT v, unnest(string_split(v, '')) AS x FROM (SELECT DISTINCT v FROM long)) GROUP BY v, x),
entropy AS (SELECT v, -sum(c / length(v)::DOUBLE * log2(c / length(v)::DOUBLE)) AS h FROM letters GROUP BY v),
extra AS (SELECT l.* FROM long l JOIN entropy USING (v) WHERE h >= 3.5 AND regexp_matches(v, '[a-z]') AND regexp_matches(v, '[A-Z]') AND regexp_matches(v, '[0-9]')
 AND NOT EXISTS (SELECT 1 FROM base b WHERE b.doc_id = l.doc_id AND b.s < l.e AND l.s < b.e)),
every AS (SELECT * FROM base UNION ALL SELECT * FROM extra),
owned AS (SELECT v, count(DISTINCT owner) AS owners, count(DISTINCT (owner, repository)) AS repositories FROM every GROUP BY v),
judged AS (SELECT e.*, NOT (owners > 2 OR owners > 1 AND repositories > 4) AS live FROM every e JOIN owned USING (v)),
shown AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex, {_JOINED} FILTER (k < 3) AS b,
 {_JOINED} FILTER (k < 3 OR live) AS spans, count(*) FILTER (live) AS n_live, count(*) FILTER (NOT live) AS n_example FROM judged GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(b, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_live, 0) AS n_live, coalesce(n_example, 0) AS n_example
 FROM d LEFT JOIN shown ON d.doc_id = shown.doc_id"""


def _escaped(c: str) -> str:
    return f"replace(replace(replace({c}, '&', '&amp;'), '<', '&lt;'), '>', '&gt;')"


CHAT = f"""WITH t AS (SELECT conv_id, coalesce(turn, 0) AS turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations UNION ALL
 SELECT -7, turn, role, '</s>[INST] ok [/INST]' FROM (VALUES (0, 'user'), (1, 'assistant')) v(turn, role)),
x AS (SELECT *, greatest(len(regexp_extract_all(text, '{WORD}')), ceil(octet_length(encode(text)) / 4.0)::BIGINT) + 4 AS tokens, min(CASE WHEN role = 'system' THEN turn END) OVER (PARTITION BY conv_id) AS first FROM t),
r AS (SELECT *, greatest(1024 - 128 - coalesce(max(CASE WHEN turn = first THEN tokens END) OVER (PARTITION BY conv_id), 0), 2) AS room FROM x),
n AS (SELECT *, tokens > room / 2.0 AS big, coalesce(max(CASE WHEN tokens <= room / 2.0 THEN tokens END) OVER (PARTITION BY conv_id), 0) AS normal FROM r),
p AS (SELECT *, sum(big::INT) OVER w AS bigs, sum(CASE WHEN big THEN 0 ELSE tokens END) OVER w - CASE WHEN big THEN 0 ELSE tokens END AS small_before, sum(tokens) OVER w AS z FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
s AS (SELECT *, dense_rank() OVER (PARTITION BY conv_id ORDER BY bigs, NOT big, CASE WHEN big THEN 0 ELSE floor(small_before / (room - normal)) END) - 1 AS win FROM p),
e AS (SELECT *, max(z) OVER (PARTITION BY conv_id, win) AS span_end, max(win) OVER (PARTITION BY conv_id) AS last, coalesce(turn = first, false) AS sys, length({_escaped('role')}) + length({_escaped('text')}) + 2 + length('</turn>') + 1 AS chars FROM s),
shown AS (SELECT conv_id, win, chars + 11 AS chars FROM e UNION ALL SELECT conv_id, win + 1, chars + 12 FROM e WHERE span_end - z + tokens <= 128 AND win < last AND NOT sys
 UNION ALL SELECT k.conv_id, k.win, e.chars + 12 FROM (SELECT DISTINCT conv_id, win FROM e) k JOIN e ON e.conv_id = k.conv_id AND e.sys AND e.win <> k.win),
f AS (SELECT conv_id, sum(chars)::BIGINT AS formatted_chars, count(DISTINCT win) AS n_windows FROM shown GROUP BY 1)
SELECT t.conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn)) AS turns_sha256, length(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_chars,
 sha256(coalesce(string_agg(text, '' ORDER BY turn) FILTER (role = 'assistant'), '')) AS loss_sha256, any_value(formatted_chars) AS formatted_chars, any_value(n_windows) AS n_windows FROM t JOIN f ON t.conv_id = f.conv_id GROUP BY t.conv_id"""

TOKENS = f"""WITH RECURSIVE v AS (SELECT DISTINCT hex(from_base64(piece)) AS p FROM read_csv('{TOKENIZERS}/byte_bpe_50k.tiktoken', delim = ' ', header = false, quote = '', escape = '', columns = {{'piece': 'VARCHAR', 'rank': 'BIGINT'}})),
sizes AS (SELECT DISTINCT length(p) AS l FROM v),
{TEXTS}, words AS (SELECT doc_id, unnest(w) AS word FROM d),
each AS (SELECT DISTINCT word, hex(encode(' ' || word)) AS h FROM words),
walk AS (SELECT word, h, 1 AS pos, 0 AS n FROM each UNION ALL
 SELECT word, any_value(h), pos + coalesce(max(l) FILTER (p IS NOT NULL), 2), any_value(n) + 1 FROM (SELECT k.word, k.h, k.pos, k.n, s.l, v.p FROM walk k JOIN sizes s ON s.l <= length(k.h) - k.pos + 1 LEFT JOIN v ON v.p = substr(k.h, k.pos, s.l) WHERE k.pos <= length(k.h)) GROUP BY word, pos),
counts AS (SELECT word, max(n) AS n FROM walk GROUP BY word)
SELECT d.doc_id, len(w) AS n_words, coalesce(t, 0)::BIGINT AS n_tokens, coalesce(m, 0) AS longest_word_tokens FROM d LEFT JOIN (SELECT doc_id, sum(n) AS t, max(n) AS m FROM words JOIN counts USING (word) GROUP BY doc_id) x ON d.doc_id = x.doc_id"""

TRIE = f"""WITH t AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL),
i AS (SELECT conv_id, turn, substr(sha256(length(role) || ':' || role || text), 1, 32) AS id, len(regexp_extract_all(text, '{WORD}')) AS w FROM t),
own AS (SELECT conv_id, list({{'id': id, 'w': w}} ORDER BY turn NULLS FIRST, id) AS s FROM i GROUP BY 1),
steps AS (SELECT *, list_concat([4294967295::BIGINT], flatten(list_transform(string_split(conv_id::VARCHAR, ''), lambda c: [ascii(c)::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1]))) AS bits FROM own),
h AS (SELECT *, xor(list_reduce(bits, lambda x, y: CASE WHEN y >= 0 THEN xor(x, y) WHEN x % 2 = 1 THEN xor(x // 2, 3988292384) ELSE x // 2 END), 4294967295) % 4 AS h FROM steps),
r AS (SELECT c.conv_id, list_concat(coalesce(b.s[1:c.h], []), c.s[c.h + 1:]) AS s FROM h c LEFT JOIN own b ON b.conv_id = c.conv_id - (c.conv_id % 20 + 20) % 20),
pre AS (SELECT conv_id, d, array_to_string(list_transform(s[1:d], lambda x: x.id), '') AS k, array_to_string(list_transform(s[1:d - 1], lambda x: x.id), '') AS up, coalesce(s[d].w, 0) AS w, d = len(s) AS ends FROM (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS d FROM r)),
node AS (SELECT k, any_value(up) AS up, d, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(w) AS w, string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (ends) AS e FROM pre GROUP BY k, d),
kids AS (SELECT up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY 1),
under AS (SELECT u.k, count(*) FILTER (c.n IS NULL) AS n_leaves, sum((v.n_convs - 1) * v.w)::BIGINT AS saved FROM (SELECT DISTINCT p.k, q.k AS j FROM pre p JOIN pre q ON p.conv_id = q.conv_id AND p.d <= q.d) u JOIN node v ON v.k = u.j LEFT JOIN kids c ON c.k = u.j GROUP BY u.k)
SELECT n.conv_id, n.d AS depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, n_leaves, saved AS saved_tokens, sha256(coalesce(n.e, '')) AS ends_sha256
 FROM node n LEFT JOIN node p ON p.k = n.up AND p.d = n.d - 1 LEFT JOIN kids c ON c.k = n.k JOIN under u ON u.k = n.k"""

SQL = {
    "op1_substring_dedup": SUBSTRINGS, "op2_token_counts": TOKENS, "op3_chat_format": CHAT, "op6_suffix_dedup": BYTES, "op7_secret_scan": SECRETS,
    "op8_jaccard_join": JACCARD, "op9_decontamination": BENCHMARK, "op10_quality_rules": QUALITY, "op11_prefix_trie": TRIE}
