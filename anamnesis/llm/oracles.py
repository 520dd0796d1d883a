"""SQL of the operators that SQL can express, from the same parameters."""

from __future__ import annotations

from anamnesis.llm import license_scan, quality

_SPACE = r"[\x20\x09-\x0D]"
_ALL = (*quality.MEASURES, *quality.SIZES)
_FIELDS = {"symbols": "n_symbols / chars", "marks": "n_marks / chars", "dup_lines": "n_dup_lines / lines", "repeats": "n_repeat_words / words", "word_size": "word_chars / words"}
_LONG = " UNION ALL ".join(f"SELECT lang, source, '{m}' AS measure, {m} AS x FROM m WHERE NOT base_failed" for m in _ALL)
_EVENT = {m: f"{float(n)}::DOUBLE / mid_{size}" for m, (size, n) in quality.RATES.items()} | {"word_size": f"mid_word_size * {quality.GROWTH - 1!r}::DOUBLE"}
_MID = ", ".join(f"min(v) FILTER (measure = '{m}' AND upto >= 0.5 * total) AS mid_{m}" for m in _ALL)
_HIGH = ", ".join(f"min(v) FILTER (measure = '{m}' AND upto >= {quality.TAIL} * total) AS high_{m}" for m in quality.MEASURES)
_LIMITS = ", ".join([*[f"high_{m} + {quality.SPREADS}::DOUBLE * greatest(high_{m} - mid_{m}, {_EVENT[m]}) AS lim_{m}" for m in quality.MEASURES], *[f"mid_{m} AS lim_{m}" for m in quality.SIZES]])
_PICK = ", ".join(f"CASE WHEN f.size >= {quality.LEAST_GROUP} THEN f.lim_{m} WHEN x.size >= {quality.LEAST_GROUP} THEN x.lim_{m} ELSE a.lim_{m} END AS lim_{m}" for m in _ALL)
_ROOM = {m: f" * greatest(1.0::DOUBLE, lim_{quality.RATES[m][0]} / {quality.RATES[m][0]})" for m in quality.RATES}
_WITHIN = " AND ".join(f"coalesce({m} <= lim_{m}{_ROOM.get(m, '')}, true)" for m in quality.MEASURES)

QUALITY = f"""
WITH w AS (SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS t,
  list_filter(regexp_split_to_array(coalesce(text, ''), '{_SPACE}+'), lambda x: x <> '') AS ws,
  list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) AS ls FROM documents),
g AS (SELECT doc_id, i, array_to_string(ws[i:i + 7], ' ') AS gram FROM (SELECT doc_id, ws, unnest(range(1, len(ws) - 6)) AS i FROM w WHERE len(ws) >= 8)),
d AS (SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, gram) AS n FROM g) WHERE n > 1),
c AS (SELECT doc_id, sum(least(8, nxt - i))::BIGINT AS rep FROM (SELECT doc_id, i, coalesce(lead(i) OVER (PARTITION BY doc_id ORDER BY i), i + 8) AS nxt FROM d) GROUP BY doc_id),
b AS (SELECT doc_id, lang, source, len(ws)::BIGINT AS n_words, coalesce(list_sum(list_transform(ws, lambda x: length(x))), 0)::BIGINT AS word_chars,
  (length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols, (length(t) - length(replace(t, '!', '')))::DOUBLE AS n_marks,
  len(ls)::DOUBLE AS n_lines, (len(ls) - len(list_distinct(ls)))::BIGINT AS n_dup_lines, coalesce(rep, 0)::BIGINT AS n_repeat_words FROM w LEFT JOIN c USING (doc_id)),
b2 AS (SELECT *, greatest(word_chars, 1)::DOUBLE AS chars, greatest(n_words, 1)::DOUBLE AS words, greatest(n_lines, 1)::DOUBLE AS lines, (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AS base_failed FROM b),
m AS (SELECT *, {", ".join(f"{e} AS {m}" for m, e in _FIELDS.items())} FROM b2),
fine AS (SELECT lang, source, measure, CASE WHEN x > 1e-6 THEN ceil(ln(x) / ln({quality.GROWTH}))::INT ELSE -10000 END AS bucket, count(*) AS n FROM ({_LONG}) GROUP BY ALL),
every AS (SELECT lang, source, measure, bucket, sum(n) AS n FROM fine GROUP BY GROUPING SETS ((lang, source, measure, bucket), (lang, measure, bucket), (measure, bucket))),
r AS (SELECT *, sum(n) OVER (PARTITION BY lang, source, measure ORDER BY bucket) AS upto, sum(n) OVER (PARTITION BY lang, source, measure) AS total,
  CASE WHEN bucket = -10000 THEN 0 ELSE pow({quality.GROWTH}, bucket - 0.5) END AS v FROM every),
q AS (SELECT lang, source, max(total) AS size, {_MID}, {_HIGH} FROM r GROUP BY lang, source),
l AS (SELECT lang, source, size, {_LIMITS} FROM q),
chosen AS (SELECT f.lang, f.source, {_PICK} FROM l f LEFT JOIN l x ON x.lang = f.lang AND x.source IS NULL LEFT JOIN l a ON a.lang IS NULL WHERE f.source IS NOT NULL)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND {_WITHIN} AS kept FROM m LEFT JOIN chosen USING (lang, source)
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_CUT = r"'[^0-9a-z\x{80}-\x{10FFFF}]+'"
_PHRASES = ", ".join(f"({p.split()!r}, '{label}')" for p, label in license_scan.PHRASES)
_TEMPLATES = ", ".join(f"({sorted(set(t.split()))!r}, '{label}', {k})" for k, (t, label) in enumerate(license_scan.TEMPLATES))

LICENSES = f"""
WITH d AS (SELECT doc_id, {_LOWER} AS t FROM documents),
w AS (SELECT doc_id, list_filter(regexp_split_to_array(t, {_CUT}), lambda x: x <> '') AS ws FROM d),
phrases(p, label) AS (VALUES {_PHRASES}),
places AS (SELECT doc_id, label, i - 1 AS at_word FROM (SELECT doc_id, ws, unnest(range(1, len(ws) + 1)) AS i FROM w WHERE list_has_any(ws, ['license', 'cc'])), phrases WHERE ws[i] = p[1] AND ws[i:i + len(p) - 1] = p),
base AS (SELECT doc_id, count(*) AS n_base, min(at_word) AS first_word, max(at_word) AS last_word FROM places GROUP BY doc_id),
lines AS (SELECT doc_id, list_distinct(list_filter(regexp_split_to_array(line, {_CUT}), lambda x: x <> '')) AS ws FROM (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM d)),
templates(tw, label, k) AS (VALUES {_TEMPLATES}),
seen AS (SELECT word, count(DISTINCT doc_id) AS n FROM (SELECT doc_id, unnest(ws) AS word FROM (SELECT row_number() OVER () AS doc_id, ws FROM w)) GROUP BY word),
weights AS (SELECT word, greatest(round({license_scan.GRAIN} * ln(1 + (SELECT count(*) FROM documents) / (1 + coalesce(n, 0)))), 1)::BIGINT AS g
  FROM (SELECT DISTINCT unnest(tw) AS word FROM templates) LEFT JOIN seen USING (word)),
whole AS (SELECT k, sum(g) AS whole FROM (SELECT k, unnest(tw) AS word FROM templates) JOIN weights USING (word) GROUP BY k),
block AS (SELECT row_number() OVER () AS b, doc_id, ws FROM lines WHERE list_has_any(ws, (SELECT list(word) FROM weights))),
common AS (SELECT b, k, sum(g) AS held, list(word) AS words FROM (SELECT b, unnest(ws) AS word FROM block) JOIN (SELECT k, unnest(tw) AS word FROM templates) USING (word) JOIN weights USING (word) GROUP BY b, k),
met AS (SELECT b, k, held::DOUBLE / whole AS share, words FROM common JOIN whole USING (k) WHERE held >= ceil(round({license_scan.CONTAINED}::DOUBLE * whole, 6))),
held AS (SELECT doc_id, label, share FROM met m JOIN block USING (b) JOIN templates USING (k)
  WHERE NOT EXISTS (SELECT 1 FROM met o WHERE o.b = m.b AND o.k <> m.k AND list_has_all(o.words, m.words) AND (o.share > m.share OR (o.share = m.share AND len(o.words) > len(m.words))))),
labelled AS (SELECT doc_id, label, 1.0::DOUBLE AS share FROM places UNION ALL SELECT doc_id, label, share FROM held),
names AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS labels, max(share) AS score FROM labelled GROUP BY doc_id),
own AS (SELECT doc_id, string_agg(DISTINCT label, ',' ORDER BY label) AS base_labels FROM places GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(n_base, 0)::BIGINT AS n_base, first_word::BIGINT AS first_word, last_word::BIGINT AS last_word,
  coalesce(base_labels, '') AS base_labels, coalesce(labels, '') AS labels, coalesce(score, 0)::DOUBLE AS score
FROM w LEFT JOIN base USING (doc_id) LEFT JOIN names USING (doc_id) LEFT JOIN own USING (doc_id)
"""
