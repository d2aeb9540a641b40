"""DuckDB SQL for the queries that SQL can express over whole tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+')"
_ESCAPE = r"regexp_replace(replace({x}, '\', '\\'), '([<\[])(s>|/s>|INST\]|/INST\])', '\1\\\2', 'g')"

OP1 = f"""
WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]')
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(17 + length({_ESCAPE.format(x='role')}) + length({_ESCAPE.format(x='text')})) AS BIGINT) AS formatted_chars,
  false AS rewrites_history
FROM rows GROUP BY conv_id
"""

# CRC-32 of a short ASCII text, bit by bit.
_CRC = "xor(list_reduce(list_concat([4294967295::BIGINT], list_transform(range(1, length(s) + 1), lambda i: ord(substr(s, CAST(i AS BIGINT), 1))::BIGINT)), lambda c, b: list_reduce(list_concat([xor(c, b)], [0::BIGINT, 0, 0, 0, 0, 0, 0, 0]), lambda x, z: xor(x >> 1, (x & 1) * 3988292384 + z))), 4294967295::BIGINT)"

OP2 = f"""
WITH docs AS (SELECT doc_id, CAST(doc_id AS VARCHAR) AS s, list_append({_WORDS}, chr(10)) AS w FROM documents),
split AS (SELECT doc_id, w, ({_CRC}) % 7 = 2 AS held_out FROM docs),
tok AS (SELECT doc_id, held_out, unnest(list_concat([' '], w[1:len(w) - 1])) AS h, unnest(w) AS w FROM split),
uni AS (SELECT w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY w),
hist AS (SELECT h, count(*) AS c, count(DISTINCT w) AS n FROM tok WHERE NOT held_out GROUP BY h),
bi AS (SELECT h, w, count(*) AS c FROM tok WHERE NOT held_out GROUP BY h, w),
tot AS (SELECT sum(c) AS n, count(*) AS v FROM uni),
p AS (
  SELECT t.doc_id, t.held_out, u.c IS NOT NULL AS known, (coalesce(u.c, 0) + 1) / (tot.n + tot.v + 1)::DOUBLE AS p1, tot.n AS n,
    CASE WHEN b.c IS NULL THEN 0 ELSE (b.c - 0.9::DOUBLE) / hist.c END AS seen, CASE WHEN hist.c IS NULL THEN 1 ELSE 0.9::DOUBLE * hist.n / hist.c END AS f
  FROM tok t CROSS JOIN tot LEFT JOIN uni u ON u.w = t.w LEFT JOIN hist ON hist.h = t.h LEFT JOIN bi b ON b.h = t.h AND b.w = t.w)
SELECT doc_id, held_out, count(*) AS n_tokens, CAST(sum(CASE WHEN known THEN 1 ELSE 0 END) AS BIGINT) AS n_known,
  CAST(any_value(n) AS BIGINT) AS train_tokens, sum(log10(p1)) AS base_score, sum(log10(seen + f * p1)) AS score
FROM p GROUP BY doc_id, held_out
"""

OP7 = r"""
WITH base AS (
  SELECT doc_id, source, CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size,
    md5('7|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || coalesce(md5(text), 'null')) AS h FROM documents),
tot AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM base GROUP BY source),
named AS (SELECT *, row_number() OVER (ORDER BY source IS NULL, source) AS rank FROM tot),
ranked AS (SELECT *, [5.0::DOUBLE, 2.0, 1.0][CAST((rank - 1) % 3 + 1 AS INT)] AS weight, source_size * 2.0::DOUBLE AS cap FROM named),
timed AS (
  SELECT *, cap / weight AS full_at,
    coalesce(sum(cap) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS caps,
    sum(weight) OVER (ORDER BY cap / weight, source IS NULL, source ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS running,
    sum(source_size) OVER () * 1.5::DOUBLE AS total FROM ranked),
cut AS (SELECT max(CASE WHEN (total - caps) / running < full_at THEN (total - caps) / running END) AS at FROM timed),
targets AS (SELECT source, source_size, weight, rank, least(cap, coalesce(weight * cut.at, cap)) AS target FROM timed, cut),
served AS (
  SELECT *, row_number() OVER () AS id, coalesce(sum(size) OVER (PARTITION BY source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM base),
rows AS (SELECT served.*, source_size, weight, rank, target FROM served JOIN targets ON served.source IS NOT DISTINCT FROM targets.source),
turns AS (SELECT id, rank, weight, size, source_size * unnest([0, 1]) + before AS start FROM rows WHERE size > 0),
packets AS (SELECT *, unnest(range(0, size, 64)) AS p FROM turns),
queue AS (SELECT id, least(64, size - p) AS words, sum(least(64, size - p)) OVER (ORDER BY (start + p + least(64, size - p)) / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS until FROM packets),
taken AS (SELECT id, sum(greatest(0, least(words, (SELECT floor(sum(size) * 1.5) FROM base) - until + words))) AS taken FROM queue GROUP BY id)
SELECT doc_id, size, source_size, target, CAST(coalesce(taken, 0) AS BIGINT) AS taken FROM rows LEFT JOIN taken USING (id)
"""

OP8 = f"""
WITH RECURSIVE docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
sets AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [list_aggregate(w, 'string_agg', ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] || ' ' || w[i + 3] || ' ' || w[i + 4]) END) AS s FROM docs),
sh AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
pairs AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS k, any_value(a.n) AS nx, any_value(b.n) AS ny FROM sh a JOIN sh b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT x, y FROM pairs WHERE 100 * k >= 75 * (nx + ny - k)),
reach(x, y) AS (SELECT doc_id, doc_id FROM documents UNION SELECT reach.x, links.y FROM reach JOIN links ON links.x = reach.y)
SELECT sets.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, min(reach.y) AS component_id, sets.doc_id = min(reach.y) AS kept
FROM sets JOIN reach ON reach.x = sets.doc_id GROUP BY sets.doc_id, len(s)
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_chat_format": OP1, "op2_lm_score": OP2, "op7_mix": OP7, "op8_near_duplicates": OP8}
