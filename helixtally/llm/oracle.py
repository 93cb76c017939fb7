"""DuckDB SQL for the text operators that SQL can express."""

from __future__ import annotations

_WORDS = "list_filter(regexp_split_to_array(coalesce(text, ''), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"

OP4 = f"""
WITH docs AS (SELECT doc_id, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, p, array_to_string(w[p:p + 12], ' ') AS s
  FROM docs, unnest(range(1, len(w) - 11)) AS t(p)
),
firsts AS (SELECT s, min(doc_id) AS least FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, p + k AS pos
  FROM windows JOIN firsts USING (s), unnest(range(13)) AS t(k)
  WHERE least < doc_id
),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS pos FROM docs),
kept AS (
  SELECT doc_id, string_agg(word, ' ' ORDER BY pos) AS body, count(*) AS n
  FROM words ANTI JOIN gone USING (doc_id, pos) GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(body, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

OP7 = f"""
WITH docs AS (SELECT doc_id, coalesce(text, '') AS t, {_WORDS} AS w FROM documents),
windows AS (
  SELECT doc_id, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS s
  FROM docs, unnest(range(1, len(w) - 1)) AS t(p)
),
often AS (SELECT doc_id, s FROM windows GROUP BY ALL HAVING count(*) > 1),
repeated AS (
  SELECT doc_id, count(DISTINCT p + k) AS n_repeat_words
  FROM windows JOIN often USING (doc_id, s), unnest(range(3)) AS t(k) GROUP BY doc_id
),
split AS (SELECT doc_id, unnest(string_split(t, chr(10))) AS line FROM docs),
lines AS (
  SELECT doc_id, line, list_filter(regexp_split_to_array(line, '[\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS lw
  FROM split WHERE regexp_matches(line, '[^\\x20\\x09-\\x0D]')
),
judged AS (
  SELECT doc_id, line, len(lw) AS n,
    (length(line) - length(replace(line, '|', ''))) * 100 > len(lw) * 10
    OR (length(line) - length(regexp_replace(line, '[#*$%&|<>]+', '', 'g'))) * 100 > len(lw) * 20
    OR (length(line) - length(replace(line, '!', ''))) * 100 > len(lw) * 30
    OR (len(lw) < 3 AND NOT regexp_matches(right(line, 3), '[.!?…:;"''”»)\\]][ \\t-\\r]*$'))
    OR (len(lw) >= 10 AND len(list_distinct(lw)) * 100 < len(lw) * 30)
    OR (len(lw) <= 30 AND regexp_matches(lower(line), 'lorem ipsum|enable javascript|accept cookies|cookie policy|privacy policy'
      || '|terms of use|terms of service|all rights reserved|click here|sign in to|subscribe to our')) AS fails
  FROM lines
),
per_doc AS (
  SELECT doc_id, count(*) - count(DISTINCT line) AS n_dup_lines, coalesce(sum(n) FILTER (NOT fails), 0) AS kept_words
  FROM judged GROUP BY doc_id
),
figures AS (
  SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words,
    CAST(length(regexp_replace(t, '[\\x20\\x09-\\x0D]+', '', 'g')) AS BIGINT) AS word_chars,
    CAST(length(t) - length(regexp_replace(t, '[#*$%&|<>]+', '', 'g')) AS BIGINT) AS n_symbols,
    CAST(coalesce(n_dup_lines, 0) AS BIGINT) AS n_dup_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words,
    coalesce(kept_words, 0) AS kept_words
  FROM docs LEFT JOIN repeated USING (doc_id) LEFT JOIN per_doc USING (doc_id)
),
lost AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    CASE WHEN n_words > 0 THEN CAST(100 * (n_words - kept_words) AS DOUBLE) / n_words ELSE 100.0 END AS lost_percent
  FROM figures
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND lost_percent <= 50 AS kept, CAST(lost_percent AS DOUBLE) AS lost_percent
FROM lost
"""

OP11 = """
WITH pieces AS (
  SELECT coalesce(lang, 'und') AS lang,
    unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\\x0A-\\x0D]')) AS piece
  FROM documents
),
words AS (SELECT lang, list_filter(regexp_split_to_array(piece, '[\\x20\\x09]+'), lambda x: x <> '') AS w FROM pieces),
totals AS (SELECT lang, sum(len(w)) AS n FROM words GROUP BY lang),
grams AS (
  SELECT lang, array_to_string(w[i:i + m - 1], ' ') AS phrase, m, count(*) AS f
  FROM words, unnest(range(1, 6)) AS s(m), unnest(range(1, len(w) - m + 2)) AS t(i)
  GROUP BY ALL HAVING count(*) >= 100
),
longer_ones AS (SELECT lang, phrase, m, f AS a, string_split(phrase, ' ') AS w FROM grams WHERE m > 1),
cuts AS (SELECT *, array_to_string(w[1:k], ' ') AS one, array_to_string(w[k + 1:m], ' ') AS two FROM longer_ones, unnest(range(1, m)) AS t(k)),
scored AS (
  SELECT lang, phrase, a, x.f AS l, y.f AS r, n, k,
    CAST(1000::HUGEINT * a::HUGEINT * n::HUGEINT // (x.f::HUGEINT * y.f::HUGEINT) AS BIGINT) AS score
  FROM cuts JOIN (SELECT lang, phrase AS one, f FROM grams) x USING (lang, one) JOIN (SELECT lang, phrase AS two, f FROM grams) y USING (lang, two) JOIN totals USING (lang)
),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, k) = 1),
inside AS (
  SELECT lang, array_to_string(w[i:i + p - 1], ' ') AS phrase, max(a) AS longer
  FROM longer_ones, unnest(range(2, m)) AS s(p), unnest(range(1, m - p + 2)) AS t(i) GROUP BY ALL
)
SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, encode(phrase)) AS rank, phrase,
  CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, score
FROM lowest LEFT JOIN inside USING (lang, phrase)
WHERE longer IS NULL OR 100 * longer < 100 * a
QUALIFY rank <= 2000
"""

OP12 = """
WITH spread AS (
  SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM documents
),
counted AS (SELECT doc_id, term, count(*) AS tf FROM spread GROUP BY ALL),
sizes AS (SELECT doc_id, CAST(sum(tf) AS BIGINT) AS n FROM counted GROUP BY doc_id),
total AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS len FROM sizes),
held AS (SELECT term, count(*) AS df FROM counted GROUP BY term),
asked AS (
  SELECT DISTINCT item_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS term
  FROM benchmark
),
scored AS (
  SELECT item_id, doc_id, CAST(sum(
    CAST(floor(1000 * ln((2.0::DOUBLE * docs + 2) / (2.0::DOUBLE * df + 1))) AS BIGINT)
    * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * docs) // len)))) AS BIGINT) AS score
  FROM asked JOIN held USING (term) JOIN counted USING (term) JOIN sizes USING (doc_id), total
  GROUP BY item_id, doc_id
)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 50
"""

OP13 = """
WITH RECURSIVE vectors AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
),
links AS (
  SELECT a.vec_id AS u, b.vec_id AS v FROM vectors a JOIN vectors b USING (label)
  WHERE a.vec_id <> b.vec_id AND list_cosine_similarity(a.v, b.v) >= 0.98
),
reached AS (
  SELECT vec_id, vec_id AS other FROM vectors
  UNION
  SELECT r.vec_id, l.v FROM reached r JOIN links l ON l.u = r.other
),
named AS (SELECT vec_id, min(other) AS component_id FROM reached GROUP BY vec_id),
sums AS (SELECT u AS vec_id, count(*) AS n FROM links GROUP BY u)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM named LEFT JOIN sums USING (vec_id)
"""

ORACLE = {
    "op4_substring_dedup": OP4,
    "op7_quality_rules": OP7,
    "op11_phrase_collocations": OP11,
    "op12_ranked_search": OP12,
    "op13_embedding_near_dedup": OP13,
}
