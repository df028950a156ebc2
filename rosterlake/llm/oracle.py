"""DuckDB statements for the text queries that SQL can express."""

from __future__ import annotations

from rosterlake.llm.quality_rules import STOP_WORDS

_STOP = ", ".join(f"'{w}'" for w in sorted(set(STOP_WORDS)))

_QUALITY = rf"""
WITH split AS (
  SELECT doc_id, coalesce(text, '') AS text, coalesce(lang IN ('en', 'de', 'fr', 'es'), false) AS covered,
    list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words,
    list_filter(string_split(coalesce(text, ''), chr(10)),
      lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) AS lines
  FROM documents),
words AS (SELECT *, len(words)::BIGINT AS n_words FROM split),
windows AS (
  SELECT doc_id, i, array_to_string(words[i:i + 7], ' ') AS w
  FROM (SELECT doc_id, words, unnest(range(1, n_words - 6)) AS i FROM words WHERE n_words >= 8)),
repeated AS (
  SELECT doc_id, i FROM (SELECT *, count(*) OVER (PARTITION BY doc_id, w) AS n FROM windows) WHERE n > 1),
covered AS (
  SELECT doc_id, count(DISTINCT p)::BIGINT AS n
  FROM (SELECT doc_id, unnest(range(i, i + 8)) AS p FROM repeated) GROUP BY doc_id),
measured AS (
  SELECT words.doc_id, covered, n_words, length(array_to_string(words, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
    (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines,
    coalesce(covered.n, 0)::BIGINT AS n_repeat_words,
    greatest(n_words, 1) AS per_word, greatest(len(lines), 1) AS per_line,
    length(text) - length(replace(text, '!', '')) AS shouts,
    len(list_filter(words, lambda w: lower(w) IN ({_STOP}))) AS stop_words,
    len(list_filter(lines, lambda l: regexp_matches(l, '^\s*[-*•]'))) AS bullets,
    len(list_filter(lines, lambda l: regexp_matches(l, '(\.\.\.|…)\s*$'))) AS ellipses
  FROM words LEFT JOIN covered ON covered.doc_id = words.doc_id),
judged AS (
  SELECT *, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed FROM measured)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND word_chars / per_word BETWEEN 2.0 AND 25.0
    AND n_symbols / per_word <= 0.25 AND shouts / per_word <= 0.25 AND (NOT covered OR stop_words / per_word >= 0.02)
    AND n_dup_lines / per_line <= 0.5 AND bullets / per_line <= 0.9 AND ellipses / per_line <= 0.5 AS kept
FROM judged"""

_KEYWORD = "([pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])"
_PATTERNS = (
    _KEYWORD + r"""["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "AKIA[A-Z0-9]+",
    "[0-9a-f]+",
    "[A-Za-z0-9+/_=-]{20,}",
)
_MATCHES = " UNION ALL ".join(
    f"SELECT nr, {kind} AS kind, regexp_extract_all(text, '{pattern}') AS f, "
    f"regexp_extract_all(text, '{pattern}', {0 if kind else 2}) AS v, string_split_regex(text, '{pattern}') AS g FROM rows"
    for kind, pattern in enumerate(_PATTERNS)
)

_SECRETS = f"""
WITH rows AS (SELECT row_number() OVER () AS nr, doc_id, source, coalesce(text, '') AS text FROM documents),
found AS ({_MATCHES}),
each AS (
  SELECT nr, kind, unnest(f) AS f, unnest(v) AS v, unnest(g[1:len(f)]) AS g, unnest(range(len(f))) AS k
  FROM found WHERE len(f) > 0),
placed AS (
  SELECT nr, kind, v, f, CAST(sum(length(g) + length(f)) OVER (PARTITION BY nr, kind ORDER BY k) AS BIGINT) AS stop FROM each),
spans AS (
  SELECT nr, kind, v, stop - length(f) AS start, stop FROM placed
  WHERE CASE kind WHEN 0 THEN length(v) >= 6 WHEN 1 THEN length(v) >= 20 WHEN 2 THEN length(v) >= 24
    ELSE regexp_matches(v, '[0-9]') AND regexp_matches(v, '[A-Za-z]') END),
candidates AS (
  SELECT * FROM spans s WHERE kind < 3 OR NOT EXISTS (
    SELECT 1 FROM spans b WHERE b.nr = s.nr AND b.kind < 3 AND b.start < s.stop AND s.start < b.stop)),
owners AS (
  SELECT v, count(DISTINCT coalesce(source, chr(0))) AS n_owners FROM candidates JOIN rows ON rows.nr = candidates.nr GROUP BY v),
judged AS (
  SELECT c.*, n_owners >= 3 AS example, CASE kind WHEN 0 THEN 'assign' WHEN 1 THEN 'access' WHEN 2 THEN 'hex' ELSE 'generic' END
    || ':' || start || ':' || stop AS shown
  FROM candidates c JOIN owners o ON o.v = c.v WHERE kind < 3 OR n_owners < 3),
listed AS (
  SELECT nr, count(*) FILTER (kind = 0) AS n_assign, count(*) FILTER (kind = 1) AS n_access, count(*) FILTER (kind = 2) AS n_hex,
    string_agg(shown, ',' ORDER BY start, kind) FILTER (kind < 3) AS base,
    string_agg(shown, ',' ORDER BY start, kind) AS spans, count(*) FILTER (example) AS n_examples FROM judged GROUP BY nr)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_examples, 0) AS n_examples
FROM rows LEFT JOIN listed ON listed.nr = rows.nr"""

# CRC-32 of UTF-8 bytes: a table of 256 remainders, and a fold over the bytes of each distinct word.
_BIT = "CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END"
_RESAMPLING = rf"""
WITH RECURSIVE steps AS (
  SELECT i, i AS c, 0 AS n FROM (SELECT unnest(range(256))::BIGINT AS i)
  UNION ALL SELECT i, {_BIT}, n + 1 FROM steps WHERE n < 8),
remainders AS (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
texts AS (
  SELECT 0 AS side, row_number() OVER () AS nr, doc_id, text FROM documents
  UNION ALL SELECT 1, row_number() OVER (), NULL, text FROM benchmark),
occurrences AS (
  SELECT side, nr, unnest(regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM texts),
counted AS (SELECT side, nr, w, count(*) AS n FROM occurrences GROUP BY ALL),
spelled AS (SELECT DISTINCT w, hex(encode(w)) AS h FROM counted),
bucketed AS (
  SELECT w, xor(list_reduce(
    list_transform(range(len(h) // 2), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT),
    lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) % 10000 AS bucket
  FROM spelled, remainders),
held AS (
  SELECT bucket, coalesce(sum(n) FILTER (side = 0), 0)::BIGINT AS s, coalesce(sum(n) FILTER (side = 1), 0)::BIGINT AS t
  FROM counted JOIN bucketed USING (w) GROUP BY bucket),
totals AS (SELECT coalesce(sum(s), 0)::BIGINT AS s_all, coalesce(sum(t), 0)::BIGINT AS t_all FROM held),
gains AS (
  SELECT bucket, floor(1000 * ln(((t + 1) * (s_all + 10000))::DOUBLE / ((s + 1) * (t_all + 10000))::DOUBLE))::BIGINT AS gain
  FROM held, totals),
weighed AS (
  SELECT nr, sum(n)::BIGINT AS n_features, floor(sum(n * gain) / sum(n))::BIGINT AS weight
  FROM counted JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE side = 0 GROUP BY nr),
scored AS (
  SELECT doc_id, coalesce(n_features, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + floor(-1000 * ln(-ln((('0x' || sha256('2024:' || doc_id)[1:8])::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM texts LEFT JOIN weighed USING (nr) WHERE side = 0),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place,
    count(*) FILTER (n_features >= 20) OVER () AS n FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN n_features >= 20 AND place <= 10 * n // 100 THEN place END AS rank
FROM placed"""

# Sources in the order of the size at which they fill up: level by prefix sums instead of rounds.
_MIXING = r"""
WITH read AS (SELECT doc_id, source, coalesce(text, '') AS text FROM documents),
sized AS (
  SELECT doc_id, source, len(regexp_extract_all(text, '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    length(regexp_replace(text, '[^\p{L}]+', '', 'g')) AS letters, length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS signs,
    -ln((('0x' || sha256('mix:' || coalesce(doc_id::VARCHAR, ''))[1:12])::BIGINT + 0.5::DOUBLE) / 281474976710656) AS waiting
  FROM read),
keyed AS (
  SELECT doc_id, source, size,
    waiting / greatest(0.05::DOUBLE, CASE WHEN signs > 0 THEN letters::DOUBLE / signs ELSE 0 END) AS key FROM sized),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS nr FROM keyed GROUP BY source),
weighted AS (SELECT source, source_size, 3 * source_size AS cap, ([5, 2, 1])[(nr - 1) % 3 + 1]::BIGINT AS weight FROM sources),
filled AS (
  SELECT *, sum(source_size) OVER () - coalesce(sum(cap) OVER fill, 0) AS rest, sum(weight) OVER () - coalesce(sum(weight) OVER fill, 0) AS weights
  FROM weighted WINDOW fill AS (ORDER BY cap::DOUBLE / weight, source ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
leveled AS (SELECT *, bool_or(weight * rest <= cap * weights) OVER () AS some FROM filled),
level AS (
  SELECT rest, weights FROM leveled WHERE weight * rest <= cap * weights ORDER BY weights DESC, rest DESC LIMIT 1),
targets AS (
  SELECT source, source_size,
    CASE WHEN weight * level.rest > cap * level.weights THEN cap::DOUBLE ELSE (weight * level.rest)::DOUBLE / level.weights::DOUBLE END AS target
  FROM weighted, level),
budgets AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS epochs FROM targets),
placed AS (
  SELECT k.*, b.source_size, target, epochs, floor(target)::BIGINT - epochs * b.source_size AS rest,
    coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY key, doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before
  FROM keyed k JOIN budgets b ON k.source IS NOT DISTINCT FROM b.source)
SELECT doc_id, size, source_size, target, (epochs * size + greatest(0, least(size, rest - before)))::BIGINT AS taken FROM placed"""

ORACLE: dict[str, str] = {
    "op5_secret_scan": _SECRETS,
    "op6_quality_rules": _QUALITY,
    "op11_importance_resampling": _RESAMPLING,
    "op13_source_mixing": _MIXING,
}
