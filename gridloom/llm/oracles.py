"""DuckDB SQL for the opN queries that SQL can express."""

from __future__ import annotations

from . import rules

SPACES = r"[\x20\x09-\x0D]+"
WORDS = rf"list_filter(regexp_split_to_array(coalesce(text, ''), '{SPACES}'), lambda x: x <> '')"


def removed(chars: str) -> str:
    return f"(length(t) - length(translate(t, '{chars}', '')))"


def rules_sql() -> str:
    stops = ", ".join(f"'{w}'" for w in rules.ALL_STOP_WORDS)
    tests = []
    for r in rules.RULES:
        tests.append(f"{r.measure} >= {r.low!r}" + ("" if r.high == float("inf") else f" AND {r.measure} <= {r.high!r}"))
    share = lambda a, b: f"CASE WHEN {b} > 0 THEN CAST({a} AS DOUBLE) / {b} ELSE 0 END"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS t, {WORDS} AS ws FROM documents),
g AS (SELECT rid, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT rid, ws, unnest(range(1, len(ws) - 6)) AS i FROM d WHERE len(ws) >= 8)),
twice AS (SELECT rid, i, count(*) OVER (PARTITION BY rid, gram) AS n FROM g),
covered AS (SELECT rid, count(DISTINCT p) AS n FROM (SELECT rid, unnest(range(i, i + 8)) AS p FROM twice WHERE n > 1) GROUP BY rid),
l AS (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d),
lines AS (SELECT rid, count(*) AS n, count(*) - count(DISTINCT line) AS dup FROM l WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (SELECT d.rid, doc_id, len(ws) AS n_words,
  length(regexp_replace(t, '{SPACES}', '', 'g')) AS word_chars,
  {removed('#*$%&|<>')} AS n_symbols, coalesce(lines.dup, 0) AS n_dup_lines, coalesce(covered.n, 0) AS n_repeat_words,
  coalesce(lines.n, 0) AS n_lines, {removed('!?')} AS n_marks, {removed('ABCDEFGHIJKLMNOPQRSTUVWXYZÄÖÜÀÂÇÉÈÊËÎÏÔÙÛÑÁÍÓÚ')} AS n_upper, {removed('0123456789')} AS n_digits,
  len(list_filter(ws, lambda x: lower(rtrim(x, '.,;:!?')) IN ({stops}))) AS n_stop,
  len(list_filter(range(2, len(ws) + 1), lambda i: ws[i] = ws[i - 1])) AS n_next_same
  FROM d LEFT JOIN covered USING (rid) LEFT JOIN lines USING (rid)),
r AS (SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  {share('n_repeat_words', 'n_words')} AS repeat_ratio, {share('word_chars', 'n_words')} AS mean_word_chars, {share('n_symbols', 'word_chars')} AS symbol_ratio,
  {share('n_marks', 'n_words')} AS mark_ratio, {share('n_upper', 'word_chars')} AS upper_ratio, {share('n_digits', 'word_chars')} AS digit_ratio,
  {share('n_stop', 'n_words')} AS stop_ratio, {share('n_dup_lines', 'n_lines')} AS dup_line_ratio, {share('n_next_same', 'n_words')} AS next_word_ratio FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines,
  CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND {' AND '.join(tests)} AS kept FROM r
"""


MIXING = rf"""
WITH d AS (SELECT doc_id, source, CAST(len({WORDS}) AS BIGINT) AS size, CASE WHEN count(*) OVER (PARTITION BY doc_id) > 1
  THEN ':' || md5(coalesce(text, '')) || ':' || (row_number() OVER (PARTITION BY doc_id, coalesce(text, ''), source) - 1) ELSE '' END AS more FROM documents),
p AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS w FROM d GROUP BY source),
c AS (SELECT *, 2 * source_size AS cap, CAST(CAST(sum(source_size) OVER () AS BIGINT) * 150 AS DOUBLE) / 100 AS total, CAST(sum(w) OVER () AS BIGINT) AS all_w FROM p),
a AS (SELECT *, CAST(coalesce(sum(cap) OVER o, 0) AS BIGINT) AS caps, CAST(coalesce(sum(w) OVER o, 0) AS BIGINT) AS ws FROM c
  WINDOW o AS (ORDER BY CAST(cap AS DOUBLE) / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
f AS (SELECT *, (total - caps) / (all_w - ws) AS level FROM a),
g AS (SELECT arg_min(level, CAST(cap AS DOUBLE) / w) FILTER (level * w <= cap) AS level FROM f),
t AS (SELECT source, source_size, CASE WHEN g.level IS NULL THEN CAST(cap AS DOUBLE) ELSE least(CAST(cap AS DOUBLE), g.level * w) END AS target FROM f, g),
u AS (SELECT d.doc_id, size, source_size, target, CASE WHEN source_size > 0 THEN target / source_size ELSE 0.0 END AS rate,
  CAST('0x' || substr(md5('mix:' || coalesce(CAST(d.doc_id AS VARCHAR), '') || d.more), 1, 8) AS BIGINT) / 4294967296.0e0 AS draw
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
k AS (SELECT *, CAST(floor(rate) AS BIGINT) + CASE WHEN draw < rate - floor(rate) THEN 1 ELSE 0 END AS copies FROM u)
SELECT doc_id, size, source_size, target, size * copies AS taken, copies FROM k
"""

TOPK = """
WITH v AS (SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS DOUBLE)) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT q.rid, q.vec_id AS query_id, c.vec_id, CAST(list_inner_product(q.e, c.e) AS BIGINT) AS score FROM v q JOIN v c ON q.vec_id % 50 = 0 AND q.rid <> c.rid),
r AS (SELECT *, row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INTEGER) AS rank, vec_id, score FROM r WHERE rank <= 5
"""

# SHA-1 in base32: the hex digits' bits in groups of five
WARC = """
WITH p AS (SELECT page_id, CAST(octet_length(encode(coalesce(html, ''))) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
b AS (SELECT *, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
  1 + CAST((('0x' || substr(h, 1 + CAST(i * 5 // 4 AS INTEGER), 1))::INTEGER * 16 + ('0x' || substr(h || '0', 2 + CAST(i * 5 // 4 AS INTEGER), 1))::INTEGER) // CAST(pow(2, 3 - (i * 5) % 4) AS INTEGER) % 32 AS INTEGER), 1)), '') AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY h) AS last FROM b)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN page_id < last THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id < last THEN last END AS refers_to, TRUE AS intact FROM m
"""

ORACLES: dict[str, str] = {"op5_warc": WARC, "op6_topk": TOPK, "op9_rules": rules_sql(), "op10_mixing": MIXING}
