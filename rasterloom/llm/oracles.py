"""DuckDB SQL for those opN queries that SQL can express."""

from __future__ import annotations

WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP6 = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t, {WORDS} AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_replace(x, '[\x20\x09-\x0D]+', '', 'g') <> '') AS ls FROM d),
win AS (
  SELECT doc_id, i, w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)
),
rep AS (SELECT doc_id, g FROM win GROUP BY doc_id, g HAVING count(*) > 1),
cov AS (
  SELECT doc_id, count(DISTINCT i + k) AS n
  FROM win JOIN rep USING (doc_id, g), (SELECT unnest(range(0, 3)) AS k) GROUP BY doc_id
),
m AS (
  SELECT l.doc_id, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]+', '', 'g'))::BIGINT AS word_chars,
    (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    len(ls)::BIGINT AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines,
    coalesce(cov.n, 0)::BIGINT AS n_repeat_words,
    (length(t) - length(replace(t, '|', '')))::BIGINT AS n_bars,
    (length(t) - length(regexp_replace(t, '\p{{L}}', '', 'g')))::BIGINT AS n_letters,
    (length(t) - length(regexp_replace(t, '\p{{Lu}}', '', 'g')))::BIGINT AS n_upper
  FROM l LEFT JOIN cov USING (doc_id)
),
b AS (
  SELECT *, ((n_words < 50)::INT + 2 * (100 * n_repeat_words > 50 * n_words)::INT
    + 4 * (n_words > 0 AND 10 * n_symbols > 15 * n_words)::INT + 8 * (n_words > 0 AND word_chars > 20 * n_words)::INT
    + 16 * (n_words > 0 AND 10 * word_chars < 15 * n_words)::INT
    + 32 * (n_dup_lines > 2 AND 100 * n_dup_lines > 60 * n_lines)::INT
    + 64 * (n_words > 0 AND 100 * n_bars > 20 * n_words)::INT
    + 128 * (n_letters > 0 AND 100 * n_upper > 70 * n_letters)::INT)::BIGINT AS fail_bits
  FROM m
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  (fail_bits & 3) <> 0 AS base_failed, fail_bits = 0 AS kept, fail_bits
FROM b
"""

#: crc32 of a short text, bit by bit.
CRC = """list_reduce(list_concat([4294967295::BIGINT], list_transform(string_split({t}, ''), lambda c: ascii(c)::BIGINT)),
  lambda acc, b: list_reduce(list_concat([xor(acc, b)], range(8)::BIGINT[]), lambda v, i: CASE WHEN v % 2 = 1 THEN xor(v // 2, 3988292384::BIGINT) ELSE v // 2 END))"""


def crc32(text: str) -> str:
    return f"xor({CRC.format(t=text)}, 4294967295::BIGINT)"


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"list_filter(string_split_regex({_LOWER}, '[\x20\x09-\x0D]+'), lambda w: w <> '')"

OP2 = f"""
WITH RECURSIVE d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
s AS MATERIALIZED (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + least(5, len(w)) - 1], ' ') AS g, least(5, len(w)) AS k
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - least(5, len(w)) + 2)) AS i FROM d WHERE len(w) > 0)
),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
l AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS shared FROM s x JOIN s y ON x.g = y.g AND x.k = y.k AND x.doc_id <> y.doc_id GROUP BY 1, 2)
  JOIN n p ON p.doc_id = a JOIN n q ON q.doc_id = b WHERE 100 * shared >= 75 * (p.n + q.n - shared)
),
c AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT l.b, c.r FROM c JOIN l ON l.a = c.doc_id)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.r AS component_id, m.r = d.doc_id AS kept
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT doc_id, min(r) AS r FROM c GROUP BY doc_id) m USING (doc_id)
"""

#: The trigram model on the words themselves. chr(0) ends a text, and as a context begins it.
OP1 = f"""
WITH d AS (SELECT doc_id, {crc32("doc_id::VARCHAR")} % 7 = 2 AS held_out, list_append({_WORDS}, chr(0)) AS w FROM documents),
t AS MATERIALIZED (
  SELECT doc_id, held_out, i, w[i] AS w, CASE WHEN i = 1 THEN chr(0) ELSE w[i - 1] END AS h, CASE WHEN i = 2 THEN chr(0) WHEN i > 2 THEN w[i - 2] END AS hh
  FROM (SELECT *, unnest(range(1, len(w) + 1)) AS i FROM d)
),
u AS MATERIALIZED (SELECT w, count(*) AS c FROM t WHERE NOT held_out GROUP BY w),
g AS MATERIALIZED (SELECT h, w, count(*) AS c FROM t WHERE NOT held_out GROUP BY h, w),
gg AS MATERIALIZED (SELECT hh, h, w, count(*) AS c FROM t WHERE NOT held_out AND i > 1 GROUP BY hh, h, w),
s AS (SELECT coalesce(sum(c), 0)::BIGINT AS n, count(*) AS v, count(*) FILTER (WHERE c = 1) AS n1, count(*) FILTER (WHERE c = 2) AS n2 FROM u),
p AS (SELECT *, CASE WHEN n1 > 0 AND n2 > 0 THEN n1 / (n1 + 2 * n2)::DOUBLE ELSE 0.5::DOUBLE END AS dis FROM s),
x AS (
  SELECT t.doc_id, t.held_out, i, p.n, p.v, coalesce(u.c, 0) AS cu, coalesce(k.c, 0) AS ck, coalesce(g.c, 0) AS cg, coalesce(kk.c, 0) AS ckk, coalesce(gg.c, 0) AS cgg,
    CASE WHEN p.n = 0 THEN 1.0::DOUBLE WHEN coalesce(u.c, 0) > 0 THEN (u.c - dis) / p.n ELSE dis * p.v / p.n END AS pu
  FROM t CROSS JOIN p LEFT JOIN u ON u.w = t.w LEFT JOIN u k ON k.w = t.h LEFT JOIN g ON g.w = t.w AND g.h = t.h
  LEFT JOIN g kk ON kk.w = t.h AND kk.h = t.hh LEFT JOIN gg ON gg.w = t.w AND gg.h = t.h AND gg.hh = t.hh
),
y AS (SELECT *, (cg + STRENGTH * pu) / (ck + STRENGTH) AS pb FROM x)
SELECT doc_id, any_value(held_out) AS held_out, count(*)::BIGINT AS n_tokens, count(*) FILTER (WHERE cu > 0)::BIGINT AS n_known, any_value(n)::BIGINT AS train_tokens,
  fsum(log10((cu + 1) / (n + v + 1)::DOUBLE)) AS base_score,
  fsum(log10(CASE WHEN i > 1 THEN (cgg + STRENGTH * pb) / (ckk + STRENGTH) ELSE pb END)) AS score
FROM y GROUP BY doc_id
"""


def _sql() -> dict[str, str]:
    from .lm import STRENGTH

    return {"op1_lm_scoring": OP1.replace("STRENGTH", f"{STRENGTH!r}::DOUBLE"), "op2_near_dedup": OP2, "op6_quality": OP6}


SQL = _sql()
