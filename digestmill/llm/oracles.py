"""DuckDB SQL of the queries that SQL can express."""

from __future__ import annotations

EXACT_DEDUP = """
WITH folded AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256 FROM documents
)
SELECT doc_id, max(doc_id) OVER (PARTITION BY text_sha256) AS keep_id, count(*) OVER (PARTITION BY text_sha256) AS group_size,
  doc_id = max(doc_id) OVER (PARTITION BY text_sha256) AS kept, text_sha256
FROM folded
"""

QUALITY_RULES = r"""
WITH split AS (
  SELECT doc_id, source AS host, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^ \t-\r]+') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda line: regexp_matches(line, '[^ \t-\r]')) AS lines
  FROM documents
), windows AS (
  SELECT doc_id, pos, words[pos + 1] || ' ' || words[pos + 2] || ' ' || words[pos + 3] AS w
  FROM (SELECT doc_id, words, unnest(range(len(words) - 2)) AS pos FROM split WHERE len(words) >= 3)
), twice AS (
  SELECT doc_id, pos FROM (SELECT doc_id, pos, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1
), covered AS (
  SELECT doc_id, count(DISTINCT pos + k) AS n FROM twice, (VALUES (0), (1), (2)) AS v(k) GROUP BY doc_id
), measured AS (
  SELECT s.doc_id, host, len(words) AS n_words, length(array_to_string(words, '')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols, len(lines) AS n_lines,
    len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM split s LEFT JOIN covered c USING (doc_id)
), failures AS (
  SELECT *, n_words < 50 AS f1, 100 * n_repeat_words > 50 * n_words AS f2, n_symbols > n_words AS f3, 10 * n_dup_lines > 3 * n_lines AS f4
  FROM measured
), hosts AS (
  SELECT host, rule, count(*) AS n, sum(failed::INT) AS f
  FROM (SELECT host, unnest(['short', 'repeated', 'symbols', 'lines']) AS rule, unnest([f1, f2, f3, f4]) AS failed FROM failures WHERE host IS NOT NULL)
  GROUP BY host, rule
), moments AS (
  SELECT rule, sum(f) / sum(n) AS mean, sum(f * f / n) / sum(n) - (sum(f) / sum(n)) ** 2
    - (sum(f) / sum(n)) * (1 - sum(f) / sum(n)) * count(*) / sum(n) AS between_hosts
  FROM hosts GROUP BY rule
), priors AS (
  SELECT rule, mean, CASE WHEN between_hosts <= 0 THEN 1e6 ELSE least(greatest(mean * (1 - mean) / between_hosts - 1, 1), 1e6) END AS strength FROM moments
), rejected AS (
  SELECT DISTINCT host FROM hosts JOIN priors USING (rule) WHERE (f + mean * strength) / (n + strength) > 0.5
)
SELECT doc_id, n_words::BIGINT AS n_words, word_chars::BIGINT AS word_chars, n_symbols::BIGINT AS n_symbols, n_dup_lines::BIGINT AS n_dup_lines,
  n_repeat_words::BIGINT AS n_repeat_words, f1 OR f2 AS base_failed, r.host IS NOT NULL AS host_failed, NOT (f1 OR f2) AND r.host IS NULL AS kept
FROM failures LEFT JOIN rejected r ON failures.host = r.host
"""

# The turns as a recursion: each step, the shard whose turn it is claims the first free slot of its order.
SHARDING = """
WITH RECURSIVE shards AS (
  SELECT k, 'shard-' || lpad(k::VARCHAR, 3, '0') AS shard FROM range(16) t(k)
), orders AS (
  SELECT list(('0x' || substr(md5(shard), 1, 8))::BIGINT % 1021 ORDER BY k) AS firsts,
    list(('0x' || substr(md5(shard), 9, 8))::BIGINT % 1020 + 1 ORDER BY k) AS steps, list(shard ORDER BY k) AS names
  FROM shards
), turns AS (
  SELECT 0 AS turn, -1::BIGINT AS slot, repeat('.', 1021) AS taken
  UNION ALL
  SELECT turn + 1, found, substr(taken, 1, found::INT) || '#' || substr(taken, found::INT + 2)
  FROM (
    SELECT turn, taken, list_filter(list_transform(range(1021), lambda j: (firsts[turn % 16 + 1] + j * steps[turn % 16 + 1]) % 1021),
      lambda s: substr(taken, s::INT + 1, 1) = '.')[1] AS found
    FROM turns, orders WHERE turn < 1021
  )
), slots AS (SELECT slot, names[(turn - 1) % 16 + 1] AS shard FROM turns, orders WHERE turn > 0)
SELECT doc_id, d.slot, shard
FROM (SELECT doc_id, ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 15))::BIGINT % 1021 AS slot FROM documents) d JOIN slots USING (slot)
"""

# Whole-number shares by HUGEINT; every pair of sources is compared over the whole vocabulary of its language.
SOURCE_DIVERGENCE = r"""
WITH docs AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS words
  FROM documents
), cells AS (
  SELECT id, lang, source, term, count(*) AS n FROM (SELECT id, lang, source, unnest(words) AS term FROM docs) GROUP BY ALL
), kept AS (
  SELECT lang, term, sum(n)::HUGEINT AS n FROM cells GROUP BY ALL HAVING count(*) >= 30
), langs AS (
  SELECT lang, count(*) AS v, sum(n)::HUGEINT AS total FROM kept GROUP BY lang
), counts AS (
  SELECT lang, source, term, sum(c.n)::HUGEINT AS n FROM cells c SEMI JOIN kept k USING (lang, term) GROUP BY ALL
), groups AS (
  SELECT g.lang, g.source, coalesce(t.total, 0)::HUGEINT AS total FROM (SELECT DISTINCT lang, source FROM docs) g
  LEFT JOIN (SELECT lang, source, sum(n) AS total FROM counts GROUP BY ALL) t USING (lang, source)
), shares AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, 1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (g.total + 5 * l.v) AS p,
    1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM groups g JOIN langs l USING (lang) JOIN kept k USING (lang) LEFT JOIN counts c USING (lang, source, term)
), pairs AS (
  SELECT a.lang, a.source, b.source AS item, coalesce(d.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT x.lang, x.source AS sx, y.source AS sy, sum(abs(x.p - y.p)) AS value FROM shares x JOIN shares y ON x.lang = y.lang AND x.term = y.term GROUP BY ALL) d
    ON d.lang = a.lang AND d.sx = a.source AND d.sy = b.source
), both_parts AS (
  SELECT lang, source, 'pair' AS part, item, value FROM pairs
  UNION ALL SELECT lang, source, 'term', term, p - q FROM shares WHERE n > 0 AND p > q
)
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank
FROM (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM both_parts)
WHERE part = 'pair' OR rank <= 50
"""

COLLOCATIONS = r"""
WITH pieces AS (
  SELECT lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\n-\r]')) AS piece
  FROM (SELECT coalesce(lang, 'und') AS lang, text FROM documents)
), words AS (
  SELECT lang, regexp_extract_all(piece, '[^ \t]+') AS w FROM pieces
), totals AS (
  SELECT lang, sum(len(w))::BIGINT AS n FROM words GROUP BY lang
), grams AS (
  SELECT lang, size, unnest(list_transform(range(1, greatest(len(w) - size, 0)::BIGINT + 2), lambda i: w[i : i + size - 1])) AS g
  FROM words, (VALUES (1), (2), (3), (4)) AS s(size) WHERE len(w) >= size
), frequent AS (
  SELECT lang, size, array_to_string(g, ' ') AS phrase, any_value(g) AS g, count(*) AS n FROM grams GROUP BY lang, size, array_to_string(g, ' ') HAVING count(*) >= 30
), cuts AS (
  SELECT c.lang, c.phrase, c.n AS a, k, p.n AS l, q.n AS r, (2000000::HUGEINT * c.n) // (p.n + q.n) AS score
  FROM (SELECT *, unnest(range(1, size)) AS k FROM frequent WHERE size > 1) c
  JOIN frequent p ON p.lang = c.lang AND p.size = c.k AND p.phrase = array_to_string(c.g[1 : c.k], ' ')
  JOIN frequent q ON q.lang = c.lang AND q.size = c.size - c.k AND q.phrase = array_to_string(c.g[c.k + 1 :], ' ')
), lowest AS (
  SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1
), longer AS (
  SELECT lang, sub, max(n) AS within FROM (
    SELECT f.lang, f.n, array_to_string(f.g[v.pos : v.pos + v.width - 1], ' ') AS sub
    FROM frequent f, (VALUES (2, 1), (2, 2), (2, 3), (3, 1), (3, 2)) AS v(width, pos) WHERE v.width < f.size AND v.pos + v.width - 1 <= f.size) GROUP BY ALL
), kept AS (
  SELECT l.* FROM lowest l LEFT JOIN longer s ON s.lang = l.lang AND s.sub = l.phrase WHERE s.within IS NULL OR 100 * s.within < 80 * l.a
)
SELECT lang, rank::BIGINT AS rank, phrase, a, l, r, n, score::BIGINT AS score
FROM (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept) JOIN totals USING (lang) WHERE rank <= 2000
"""
