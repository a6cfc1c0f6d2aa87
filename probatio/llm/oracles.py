"""SQL that tells the corpus queries' rows on the sample tables, where SQL can."""

from __future__ import annotations

from probatio.llm.jump_shards import MULTIPLIER
from probatio.llm.quality_lines import LineRules
from probatio.llm.secret_ledger import BASE_RULES, RULES

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LOW = f"translate(text, '{UPPER}', '{LOWER}')"
WORD = r"[^\x20\x09-\x0D]+"
DOCS = "d AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents)"


def _quoted(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def _spans() -> str:
    """Every kept match of every rule: rid, kind, kind_no, start, stop."""
    parts = []
    for no, rule in enumerate(RULES, 1):
        p = _quoted(rule.pattern)
        group = f"regexp_extract_all(text, {p}, {rule.group})"
        parts.append(f"""SELECT rid, '{rule.kind}' AS kind, {no} AS kind_no, start, start + length(m[i]) AS stop FROM (
            SELECT rid, m, g, i, CAST(list_sum(list_transform(s[1:i], lambda x: length(x)))
                + coalesce(list_sum(list_transform(m[1:i-1], lambda x: length(x))), 0) AS BIGINT) AS start
            FROM (SELECT *, unnest(range(1, CAST(len(m) AS BIGINT) + 1)) AS i FROM (
                SELECT rid, regexp_extract_all(text, {p}) AS m, {group} AS g, string_split_regex(text, {p}) AS s FROM d) a) b) c
            WHERE length(g[i]) >= {rule.least}""")
    return " UNION ALL ".join(parts)


def _joined(where: str = "true") -> str:
    return f"coalesce(string_agg(kind || ':' || start || ':' || stop, ',' ORDER BY start, kind_no) FILTER ({where}), '')"


OP1 = f"""WITH {DOCS}, spans AS ({_spans()}), per AS (SELECT rid, {", ".join(
    f"count(*) FILTER (kind = '{r.kind}') AS n_{r.kind}" for r in BASE_RULES)}, {_joined(f"kind_no <= {len(BASE_RULES)}")} AS base,
    {_joined()} AS spans FROM spans GROUP BY rid)
SELECT doc_id, {", ".join(f"coalesce(n_{r.kind}, 0) AS n_{r.kind}" for r in BASE_RULES)}, sha256(coalesce(base, '')) AS base_sha256,
    coalesce(spans, '') AS spans FROM d LEFT JOIN per USING (rid)"""

_R = LineRules()
OP5 = rf"""WITH {DOCS}, w AS (SELECT rid, doc_id, coalesce(source, chr(0)) AS host, text, regexp_extract_all(text, '{WORD}') AS ws FROM d),
windows AS (SELECT rid, i, ws[i] AS a, ws[i + 1] AS b, ws[i + 2] AS c FROM (
    SELECT rid, ws, unnest(range(1, CAST(len(ws) AS BIGINT) - 1)) AS i FROM w) x),
twice AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, a, b, c) AS n FROM windows) x WHERE n > 1),
rep AS (SELECT rid, count(DISTINCT p) AS n_repeat_words FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS p FROM twice) x GROUP BY rid),
lines AS (SELECT rid, host, text, l, translate(array_to_string(lw, ' '), '{UPPER}', '{LOWER}') AS norm, len(lw) AS n FROM (
    SELECT rid, host, text, l, regexp_extract_all(l, '{WORD}') AS lw FROM (
        SELECT rid, host, text, unnest(string_split(text, chr(10))) AS l FROM w) x) y WHERE len(lw) > 0),
dup AS (SELECT rid, count(*) - count(DISTINCT l) AS n_dup_lines FROM lines GROUP BY rid),
hosts AS (SELECT host, count(DISTINCT text) AS docs FROM w GROUP BY host),
common AS (SELECT host, norm FROM lines JOIN hosts USING (host) GROUP BY host, norm, docs
    HAVING count(DISTINCT text) > {_R.min_documents} AND count(DISTINCT text) * 100 > docs * {_R.host_percent}),
gone AS (SELECT rid, CAST(sum(n) AS BIGINT) AS removed_words FROM lines JOIN common USING (host, norm) GROUP BY rid),
f AS (SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) AS n_symbols, coalesce(n_dup_lines, 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words, coalesce(removed_words, 0) AS removed_words
    FROM w LEFT JOIN rep USING (rid) LEFT JOIN dup USING (rid) LEFT JOIN gone USING (rid)),
g AS (SELECT *, n_words < {_R.min_words} OR 100 * n_repeat_words > {_R.repeat_percent} * n_words AS base_failed FROM f)
SELECT *, NOT base_failed AND n_words - removed_words >= {_R.min_left_words}
    AND 100 * (n_words - removed_words) >= {_R.min_left_percent} * n_words AS kept FROM g"""

OP6 = f"""WITH {DOCS}, b AS (SELECT rid, doc_id, coalesce(doc_id, -9223372036854775807) AS id, hex(encode(text)) AS h,
    CAST(octet_length(encode(text)) AS BIGINT) AS n FROM d),
s AS (SELECT rid, id, i, substring(h, 2 * i + 1, 100) AS v FROM (SELECT rid, id, h, unnest(range(0, n - 49)) AS i FROM b) x),
hit AS (SELECT rid, i FROM (SELECT rid, id, i, min(id) OVER (PARTITION BY v) AS least FROM s) x WHERE least < id),
isl AS (SELECT rid, i, sum(fresh) OVER (PARTITION BY rid ORDER BY i) AS k FROM (
    SELECT rid, i, CASE WHEN i <= lag(i) OVER (PARTITION BY rid ORDER BY i) + 50 THEN 0 ELSE 1 END AS fresh FROM hit) x),
runs AS (SELECT rid, k, min(i) AS a, max(i) + 50 AS z FROM isl GROUP BY rid, k),
gaps AS (SELECT rid, lag(z, 1, 0) OVER (PARTITION BY rid ORDER BY a) AS a, a AS z FROM runs
    UNION ALL SELECT rid, max(z), max(n) FROM runs JOIN b USING (rid) GROUP BY rid),
kept AS (SELECT rid, string_agg(substring(h, 2 * a + 1, 2 * (z - a)), '' ORDER BY a) AS h FROM gaps JOIN b USING (rid) GROUP BY rid),
per AS (SELECT rid, CAST(sum(z - a) AS BIGINT) AS n_removed, count(*) AS n_spans FROM runs GROUP BY rid)
SELECT doc_id, n AS n_bytes, coalesce(n_removed, 0) AS n_removed, coalesce(n_spans, 0) AS n_spans,
    sha256(unhex(coalesce(kept.h, b.h))) AS kept_sha256 FROM b LEFT JOIN per USING (rid) LEFT JOIN kept USING (rid)"""

OP7 = f"""WITH RECURSIVE {DOCS}, w AS (SELECT rid, doc_id, regexp_extract_all({LOW}, '{WORD}') AS ws FROM d),
s AS (SELECT DISTINCT rid, array_to_string(ws[i:i + 4], ' ') AS g FROM (
    SELECT rid, ws, unnest(range(1, greatest(2, CAST(len(ws) AS BIGINT) - 3))) AS i FROM w WHERE len(ws) > 0) x),
n AS (SELECT rid, count(*) AS n FROM s GROUP BY rid),
pairs AS (SELECT a.rid AS x, b.rid AS y, count(*) AS o FROM s a JOIN s b ON a.g = b.g AND a.rid <> b.rid GROUP BY 1, 2),
links AS (SELECT x, y FROM pairs JOIN n a ON a.rid = x JOIN n b ON b.rid = y WHERE 100 * o >= 80 * (a.n + b.n - o)),
reach AS (SELECT x, y FROM links UNION SELECT r.x, l.y FROM reach r JOIN links l ON l.x = r.y),
low AS (SELECT x, min(doc_id) AS m FROM reach JOIN w ON w.rid = y GROUP BY x)
SELECT doc_id, coalesce(n.n, 0) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM w LEFT JOIN n USING (rid) LEFT JOIN low ON x = w.rid"""

_WORD8 = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
OP8 = f"""WITH {DOCS}, w AS (SELECT rid, doc_id, regexp_extract_all({LOW}, '{_WORD8}') AS ws FROM d),
items AS (SELECT coalesce(CAST(item_id AS VARCHAR), '') AS item, regexp_extract_all({LOW}, '{_WORD8}') AS ws
    FROM (SELECT item_id, coalesce(text, '') AS text FROM benchmark) b),
win AS (SELECT DISTINCT item, ws[i:i + 9] AS win FROM (
    SELECT item, ws, unnest(range(1, greatest(2, CAST(len(ws) AS BIGINT) - 8))) AS i FROM items WHERE len(ws) > 0) x),
sizes AS (SELECT DISTINCT CAST(len(win) AS BIGINT) AS n FROM win),
place AS (SELECT rid, n, i, ws[i:i + n - 1] AS win FROM (SELECT rid, ws, n, unnest(range(1, CAST(len(ws) AS BIGINT) - n + 2)) AS i FROM w, sizes) x),
hit AS (SELECT rid, i, n, item FROM place JOIN win USING (win)),
places AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS p FROM hit) x GROUP BY rid),
found AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT rid, item FROM hit) x GROUP BY rid)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items,
    sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN places USING (rid) LEFT JOIN found USING (rid)"""

#: The generator's product needs more than 64 bits; crc32 is folded byte by byte over its table.
OP9 = f"""WITH RECURSIVE {DOCS}, crc_table AS (SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(0, 8), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM (SELECT unnest(range(0, 256)) AS b) x) y),
b AS (SELECT rid, doc_id, hex(encode(text)) AS h, CAST(octet_length(encode(text)) AS BIGINT) AS n FROM d),
crc AS (SELECT rid, xor(list_reduce(range(0, n), lambda c, i: xor(c >> 8, t[xor(c, CAST('0x' || substring(h, 2 * i + 1, 2) AS BIGINT)) % 256 + 1]),
    4294967295), 4294967295) AS c FROM b, crc_table),
jump AS (SELECT rid, CASE WHEN coalesce(doc_id, -1) < 0 THEN CAST(coalesce(doc_id, -1) AS HUGEINT) + 18446744073709551616
        ELSE CAST(doc_id AS HUGEINT) END AS k, CAST(-1 AS BIGINT) AS b0, CAST(0 AS BIGINT) AS nxt FROM d
    UNION ALL SELECT rid, k2, nxt, CAST(floor((nxt + 1) * (2147483648.0::DOUBLE / CAST((k2 // 8589934592) + 1 AS DOUBLE))) AS BIGINT)
    FROM (SELECT rid, nxt, (k * {MULTIPLIER} + 1) % 18446744073709551616 AS k2 FROM jump WHERE nxt < 41) j),
shards AS (SELECT rid, max(b0) FILTER (b0 < 40) AS shard, max(b0) FILTER (b0 < 41) AS grown FROM jump GROUP BY rid)
SELECT doc_id, n + 16 AS size, c AS text_crc32, 'key' AS law, CAST(shard AS INT) AS shard,
    row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, c, n) - 1 AS slot, CAST(grown AS INT) AS grown_shard
FROM b JOIN crc USING (rid) JOIN shards USING (rid)"""

_TERM11 = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
OP11 = f"""WITH {DOCS}, t AS (SELECT rid, doc_id, len(ts) AS n, unnest(ts) AS term FROM (
    SELECT rid, doc_id, regexp_extract_all({LOW}, '{_TERM11}') AS ts FROM d) x),
sums AS (SELECT CAST(count(DISTINCT rid) AS BIGINT) AS big_n, CAST(count(*) AS BIGINT) AS big_l FROM t),
tf AS (SELECT rid, doc_id, n, term, count(*) AS tf FROM t GROUP BY ALL),
w AS (SELECT term, CAST(floor(1000 * ln(CAST(2 * any_value(big_n) + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w FROM tf, sums GROUP BY term),
b AS (SELECT row_number() OVER () AS iid, item_id, list_distinct(regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{_TERM11}')) AS ts FROM benchmark),
q AS (SELECT iid, item_id, unnest(ts) AS term FROM b),
s AS (SELECT iid, item_id, rid, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * big_n) // big_l)))) AS BIGINT) AS score
    FROM q JOIN w USING (term) JOIN tf USING (term), sums GROUP BY iid, item_id, rid, doc_id),
r AS (SELECT *, row_number() OVER (PARTITION BY iid ORDER BY score DESC, doc_id) AS rank FROM s WHERE score > 0)
SELECT item_id, CAST(rank AS INT) AS rank, doc_id, score FROM r WHERE rank <= 50"""

#: The checksum is folded by halves of bytes, over a table of 16 values. Words one edit apart share a
#: form in which the place of the edit is marked or left out.
_RUN12 = "[A-Za-z\u00C0-\u00FF]+"
OP12 = f"""WITH RECURSIVE {DOCS}, nibbles AS (SELECT list(c ORDER BY b) AS t FROM (
    SELECT b, list_reduce(range(0, 4), lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, b) AS c
    FROM (SELECT unnest(range(0, 16)) AS b) x) y),
runs AS (SELECT rid, doc_id, unnest(regexp_extract_all({LOW}, '{_RUN12}')) AS r FROM d),
per AS (SELECT r, count(*) AS k, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || r)) AS h FROM runs WHERE length(r) >= 6 GROUP BY rid, doc_id, r),
crc AS (SELECT r, k, xor(list_reduce(range(0, CAST(length(h) AS BIGINT)), lambda c, i: xor(c >> 4, t[xor(c, CAST('0x' || substring(h, 2 * (i // 2) + 2 - i % 2, 1) AS BIGINT)) % 16 + 1]),
    4294967295), 4294967295) AS c FROM per, nibbles),
v AS (SELECT word, CAST(sum(k) AS BIGINT) AS n FROM (
    SELECT CASE WHEN c % 199 = 0 THEN substring(r, 1, c % length(r)) || substring(r, c % length(r) + 2) ELSE r END AS word, k FROM crc) x
    WHERE length(word) >= 6 GROUP BY word HAVING sum(k) >= 5),
cut AS (SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS less, length(word) AS len FROM (
    SELECT word, n, unnest(range(0, length(word))) AS i FROM v) x),
near AS (SELECT a.word, b.word AS near, b.n AS near_n FROM cut a JOIN cut b ON a.i = b.i AND a.less = b.less AND a.len = b.len AND a.word <> b.word
    UNION SELECT a.word, b.word, b.n FROM cut a JOIN v b ON a.less = b.word
    UNION SELECT b.word, a.word, a.n FROM cut a JOIN v b ON a.less = b.word),
best AS (SELECT word, near, near_n, count(*) OVER (PARTITION BY word) AS n_near,
    row_number() OVER (PARTITION BY word ORDER BY near_n DESC, encode(near)) AS no FROM near),
said AS (SELECT word, n, coalesce(n_near, 0) AS n_near, CASE WHEN near_n >= 5 * n THEN near END AS form, CASE WHEN near_n >= 5 * n THEN near_n END AS form_n
    FROM v LEFT JOIN (SELECT * FROM best WHERE no = 1) b USING (word)),
walk AS (SELECT word, word AS last, form AS ahead FROM said UNION ALL SELECT w.word, w.ahead, s.form FROM walk w JOIN said s ON s.word = w.ahead)
SELECT word, form, last AS root, n, CAST(n_near AS BIGINT) AS n_near, form_n FROM said JOIN walk USING (word) WHERE ahead IS NULL"""

SQL = {"op1_blob_ledger": OP1, "op5_cross_document_lines": OP5, "op6_prefix_free_parsing": OP6, "op7_set_relations": OP7,
       "op8_prefix_windows": OP8, "op9_jump_shards": OP9, "op11_range_maxima": OP11, "op12_prefix_suffix_tiles": OP12}
