"""DuckDB SQL of the contract queries that SQL can express on whole tables."""

from __future__ import annotations

from tapeloom.llm.quality_rules import DEFAULT_RULES, STOP_WORDS
from tapeloom.llm.sharding import ID_BYTES, WHOLE_GROUP

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
BASE32 = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
WORDS = r"[^\x20\x09-\x0D]+"
TERMS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def _rules() -> str:
    sides = []
    for r in DEFAULT_RULES:
        sides += [f"{r.metric} >= {r.low}"] if r.low is not None else []
        sides += [f"{r.metric} <= {r.high}"] if r.high is not None else []
    return " AND ".join(sides)


_STOP = ", ".join(f"'{w}'" for w in sorted({w for ws in STOP_WORDS.values() for w in ws}))

QUALITY = rf"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
p AS (SELECT doc_id, text, regexp_extract_all(text, '{WORDS}') AS w, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l FROM t),
g AS (SELECT doc_id, i, w[i] || chr(32) || w[i + 1] || chr(32) || w[i + 2] AS s FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM p WHERE len(w) > 2)),
again AS (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, s) AS n FROM g),
rep AS (SELECT doc_id, count(DISTINCT i + k) AS n FROM again, (SELECT unnest(range(3)) AS k) WHERE n > 1 GROUP BY 1),
m AS (SELECT p.doc_id, len(w)::bigint AS n_words, length(array_to_string(w, '')) AS word_chars, length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    (len(l) - len(list_distinct(l)))::bigint AS n_dup_lines, coalesce(rep.n, 0)::bigint AS n_repeat_words, greatest(len(w), 1) AS nw, greatest(len(l), 1) AS nl,
    array_to_string(w, '') AS j, l, w, text FROM p LEFT JOIN rep ON rep.doc_id = p.doc_id),
r AS (SELECT *, word_chars / nw AS mean_word_length, n_symbols / nw AS symbols_per_word, n_dup_lines / nl AS dup_line_ratio,
    len(list_filter(regexp_split_to_array(lower(text), '[^\p{{L}}]+'), lambda x: list_contains([{_STOP}], x))) / nw AS stop_word_ratio,
    len(list_filter(l, lambda x: regexp_matches(x, '(\.\.\.|…)\s*$'))) / nl AS ellipsis_line_ratio, len(list_filter(l, lambda x: regexp_matches(x, '^\s*[-*•‣]'))) / nl AS bullet_line_ratio,
    len(list_filter(w, lambda x: regexp_matches(x, '\p{{L}}'))) / nw AS alpha_word_ratio,
    length(regexp_replace(j, '\P{{Lu}}+', '', 'g')) / greatest(length(regexp_replace(j, '\P{{L}}+', '', 'g')), 1) AS upper_ratio,
    n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m)
SELECT doc_id, n_words, word_chars::bigint AS word_chars, n_symbols::bigint AS n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_rules()} AS kept FROM r
"""

_CHARS = " || ".join(f"substr('{BASE32}', 1 + ((v >> {s}) & 31), 1)" for s in (15, 10, 5, 0))
WARC = f"""
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, octet_length(encode(h)) AS payload_bytes, sha1(h) AS x, min(page_id) OVER (PARTITION BY h) AS f FROM p),
parts AS (SELECT page_id, payload_bytes, f, unnest(range(8)) AS k, x FROM d),
v AS (SELECT page_id, payload_bytes, f, k, cast('0x' || substr(x, cast(k * 5 + 1 AS integer), 5) AS integer) AS v FROM parts)
SELECT page_id, payload_bytes::bigint AS payload_bytes, string_agg({_CHARS}, '' ORDER BY k) AS payload_digest, CASE WHEN f = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN f <> page_id THEN f END AS refers_to FROM v GROUP BY page_id, payload_bytes, f
"""

DECONTAMINATION = rf"""
WITH w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}') AS ws FROM documents),
b AS (SELECT item_id, regexp_extract_all(translate(coalesce(text, ''), '{UPPER}', '{LOWER}'), '{TERMS}') AS ws FROM benchmark),
win AS (SELECT DISTINCT item_id, n, array_to_string(ws[i:i + n - 1], chr(32)) AS g FROM (SELECT item_id, ws, least(13, len(ws)) AS n, unnest(range(1, greatest(len(ws) - 12, 1) + 1)) AS i FROM b WHERE len(ws) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (SELECT doc_id, i, n, array_to_string(ws[i:i + n - 1], chr(32)) AS g FROM (SELECT doc_id, ws, n, unnest(range(1, len(ws) - n + 2)) AS i FROM w, lens WHERE len(ws) >= n)),
hits AS (SELECT doc_id, i, dw.n, item_id FROM dw JOIN win ON dw.g = win.g AND dw.n = win.n),
words AS (SELECT doc_id, count(DISTINCT x) AS n_hit FROM (SELECT doc_id, i + unnest(range(n)) AS x FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT doc_id, cast(item_id AS varchar) AS item_id FROM hits) GROUP BY 1)
SELECT w.doc_id, len(ws)::bigint AS n_words, coalesce(n_hit, 0)::bigint AS n_hit, coalesce(n_items, 0)::bigint AS n_items, sha256(coalesce(names, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN words ON words.doc_id = w.doc_id LEFT JOIN items ON items.doc_id = w.doc_id
"""

#: All windows of bytes, as hexadecimal text; the first of equal ones stays.
SUBSTRINGS = """
WITH t AS (SELECT doc_id, lower(hex(encode(coalesce(text, '')))) AS h FROM documents),
win AS (SELECT doc_id, i, md5(substr(h, cast(2 * i + 1 AS integer), 200)) AS g FROM (SELECT doc_id, h, unnest(range(0, len(h) // 2 - 99)) AS i FROM t WHERE len(h) >= 200)),
again AS (SELECT doc_id, i FROM win QUALIFY row_number() OVER (PARTITION BY g ORDER BY doc_id, i) > 1),
starts AS (SELECT doc_id, i, i > coalesce(max(i) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), -1000) + 100 AS new FROM again),
runs AS (SELECT doc_id, sum(new::int) OVER (PARTITION BY doc_id ORDER BY i) AS r, i FROM starts),
spans AS (SELECT doc_id, r, min(i) AS s, max(i) + 100 AS e FROM runs GROUP BY 1, 2),
cuts AS (SELECT doc_id, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS before FROM spans),
kept AS (SELECT t.doc_id, string_agg(substr(h, cast(2 * before + 1 AS integer), cast(2 * (s - before) AS integer)), '' ORDER BY s) || substr(any_value(h), cast(2 * max(e) + 1 AS integer)) AS k, sum(e - s) AS gone, count(*) AS n
  FROM t JOIN cuts ON cuts.doc_id = t.doc_id GROUP BY 1)
SELECT t.doc_id, (len(h) // 2)::bigint AS n_bytes, coalesce(gone, 0)::bigint AS n_removed, coalesce(n, 0)::bigint AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM t LEFT JOIN kept ON kept.doc_id = t.doc_id
"""



def _crc_entry(byte: int) -> int:
    """CRC-32's register after one byte (reflected polynomial 0xEDB88320)."""
    for _ in range(8):
        byte = (byte >> 1) ^ (0xEDB88320 if byte & 1 else 0)
    return byte


_CRC = ", ".join(str(_crc_entry(b)) for b in range(256))

#: Rows in order of hash and id; a row lies in the shard of its first byte, or of its group's if the group is small.
SHARDS = f"""
WITH t AS (SELECT doc_id, coalesce(text, '') AS text FROM documents),
s AS (SELECT doc_id, text, octet_length(encode(text)) + {ID_BYTES} AS size, substr(md5(text), 1, 15) AS k FROM t),
p AS (SELECT *, sum(size) OVER (ORDER BY k, doc_id NULLS FIRST ROWS UNBOUNDED PRECEDING) - size AS place, sum(size) OVER () AS total, sum(size) OVER (PARTITION BY k) AS same FROM s),
b AS (SELECT *, CASE WHEN same <= total / (24.0 * {WHOLE_GROUP}) THEN min(place) OVER (PARTITION BY k) ELSE place END AS border FROM p),
h AS (SELECT *, least(border * 24 // total, 23)::integer AS shard FROM b)
SELECT doc_id, size::bigint AS size, 'bytes' AS law, shard, (row_number() OVER (PARTITION BY shard ORDER BY place) - 1)::bigint AS slot, cast(NULL AS integer) AS grown_shard,
  xor(list_reduce(list_transform(regexp_extract_all(hex(encode(text)), '..'), lambda x: cast('0x' || x AS bigint)),
    lambda c, x: xor(c >> 8, ([{_CRC}]::bigint[])[1 + (xor(c, x) & 255)]), 4294967295::bigint), 4294967295)::bigint AS text_crc32
FROM h
"""

#: Targets by the first level at which the sources below it are full; taken words by whole epochs and a cut of the hash order.
MIX = rf"""
WITH d AS (SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORDS}'))::bigint AS size,
    substr(md5('7/' || coalesce(cast(doc_id AS varchar), '') || '/' || coalesce(md5(text), '')), 1, 15) AS k FROM documents),
s AS (SELECT source, sum(size)::bigint AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS r FROM d GROUP BY source),
w AS (SELECT *, [5.0, 2.0, 1.0][1 + (r - 1) % 3]::double AS w, 2.0::double * source_size AS cap FROM s),
budget AS (SELECT 1.5::double * sum(source_size)::bigint AS budget FROM s),
tries AS (SELECT a.cap / a.w AS most, ((SELECT budget FROM budget) - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w), 0)) / sum(b.w) FILTER (b.cap / b.w >= a.cap / a.w) AS level
  FROM w a, w b GROUP BY a.r, a.cap, a.w),
level AS (SELECT arg_min(level, most) AS level FROM tries WHERE level <= most),
t AS (SELECT source, source_size, least(cap, w * coalesce((SELECT level FROM level), 'infinity'::double)) AS target FROM w),
c AS (SELECT doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN floor(target)::bigint // source_size ELSE 0 END AS epochs,
    sum(size) OVER (PARTITION BY d.source ORDER BY k, doc_id NULLS FIRST, size ROWS UNBOUNDED PRECEDING) - size AS place FROM d JOIN t ON t.source IS NOT DISTINCT FROM d.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, floor(target)::bigint - epochs * source_size - place)))::bigint AS taken FROM c
"""


def oracle_sql() -> dict[str, str]:
    return {
        "op1_quality_rules": QUALITY,
        "op2_warc": WARC,
        "op3_suffix_dedup": SUBSTRINGS,
        "op7_sharding": SHARDS,
        "op8_decontamination": DECONTAMINATION,
        "op10_mixing": MIX,
    }
