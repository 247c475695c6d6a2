"""What some queries return, in SQL for DuckDB.

op3 (places of matches), op4, op5, op9 (models), op7 (runs of any length) and op10
(retrieval) have none; tests hold them against brute force or held-out rows.
"""

from __future__ import annotations

_WORDS = r"list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '')"


def _count(pattern: str, text: str = "coalesce(text, '')") -> str:
    """Characters of a class."""
    return f"(length({text}) - length(regexp_replace({text}, '{pattern}', '', 'g')))"


OP1 = rf"""
WITH docs AS (
  SELECT doc_id, {_WORDS} AS words, {_count('[A-Z]')} AS capitals, {_count('[A-Za-z]')} + {_count(r'[^\x00-\x7f]')} AS letters, {_count('[#*$%&|<>]')} AS n_symbols, {_count(r'[^\x20\x09-\x0D]')} AS word_chars,
    list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines
  FROM documents
), placed AS (
  SELECT doc_id, unnest(words) AS word, generate_subscripts(words, 1) AS i, unnest(list_transform(range(1, len(words) + 1), lambda k: CASE WHEN k + 7 <= len(words) THEN array_to_string(words[k:k + 7], ' ') END)) AS eight
  FROM docs
), flagged AS (
  SELECT doc_id, i, word, CASE WHEN eight IS NULL THEN 0 WHEN count(*) OVER (PARTITION BY doc_id, eight) > 1 THEN 1 ELSE 0 END AS again, count(*) OVER (PARTITION BY doc_id, word) AS often, lag(word) OVER (PARTITION BY doc_id ORDER BY i) AS before
  FROM placed
), summed AS (
  SELECT doc_id, sum(inside) AS n_repeat_words, max(often) AS most, sum(CASE WHEN before = word THEN 1 ELSE 0 END) AS stuttered
  FROM (SELECT *, max(again) OVER (PARTITION BY doc_id ORDER BY i ROWS BETWEEN 7 PRECEDING AND CURRENT ROW) AS inside FROM flagged) GROUP BY doc_id
), base AS (
  SELECT d.doc_id, CAST(len(words) AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(len(lines) - len(list_distinct(lines)) AS BIGINT) AS n_dup_lines, len(lines) AS n_lines,
    CAST(coalesce(n_repeat_words, 0) AS BIGINT) AS n_repeat_words, coalesce(most, 0) AS most, coalesce(stuttered, 0) AS stuttered, capitals, letters
  FROM docs d LEFT JOIN summed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 20 OR 100 * n_repeat_words > 30 * n_words AS base_failed,
  NOT (n_words < 20 OR 100 * n_repeat_words > 30 * n_words) AND word_chars BETWEEN 2 * n_words AND 15 * n_words AND 100 * n_symbols <= 15 * word_chars AND 100 * capitals <= 50 * letters AND 100 * letters >= 50 * word_chars
    AND 100 * n_dup_lines <= 60 * n_lines AND 100 * stuttered <= 30 * n_words AND 100 * most <= 30 * n_words AS kept
FROM base"""

OP2 = rf"""
WITH RECURSIVE docs AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS words FROM documents
), shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(words) = 0 THEN [] WHEN len(words) < 5 THEN [array_to_string(words, ' ')] ELSE list_transform(range(1, len(words) - 3), lambda k: array_to_string(words[k:k + 4], ' ')) END) AS shingle FROM docs
), sizes AS (
  SELECT doc_id, count(shingle) AS n FROM docs LEFT JOIN shingles USING (doc_id) GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS common FROM shingles a JOIN shingles b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL
), linked AS (
  SELECT a, b FROM links JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * common >= 80 * (x.n + y.n - common)
), reach AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
)
SELECT doc_id, n AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id FROM sizes LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = doc_id"""

OP6 = """
WITH RECURSIVE good AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.98
), reach AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON r.b = l.a
), component AS (
  SELECT vec_id, least(vec_id, coalesce(m, vec_id)) AS component_id FROM embeddings LEFT JOIN (SELECT a, min(b) AS m FROM reach GROUP BY a) ON a = vec_id
)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept FROM component LEFT JOIN (SELECT a, count(*) AS n FROM linked GROUP BY a) ON a = vec_id"""

OP8 = rf"""
WITH docs AS (
  SELECT doc_id, source, CAST(len({_WORDS}) AS BIGINT) AS size, CAST('0x' || substr(md5(CAST(doc_id AS VARCHAR)), 1, 15) AS BIGINT) AS hash FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][(row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1] AS weight FROM docs GROUP BY source
), shared AS (
  SELECT *, row_number() OVER w AS place,
    (1.5::DOUBLE * sum(source_size) OVER () - 2 * coalesce(sum(source_size) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) / sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
  FROM sources WINDOW w AS (ORDER BY source_size::DOUBLE / weight, source NULLS LAST)
), first_free AS (
  SELECT arg_min(level, place) AS level, min(place) AS place FROM shared WHERE level * weight <= 2 * source_size
), targets AS (
  SELECT source, source_size, CASE WHEN s.place >= f.place THEN f.level * weight ELSE source_size * 2.0::DOUBLE END AS target FROM shared s, first_free f
), needs AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM targets
), sized AS (
  SELECT source, avg(size) AS mean FROM docs GROUP BY source
), tiers AS (
  SELECT d.*, source_size, target, whole, target - whole * source_size AS need, size > mean AS large,
    sum(size) OVER (PARTITION BY d.source, size > mean ORDER BY hash) AS upto, sum(size) OVER (PARTITION BY d.source, size > mean, hash) AS own,
    coalesce(sum(CASE WHEN size > mean THEN size END) OVER (PARTITION BY d.source), 0) AS large_words
  FROM docs d JOIN needs n ON d.source IS NOT DISTINCT FROM n.source JOIN sized z ON d.source IS NOT DISTINCT FROM z.source
), first_cut AS (
  SELECT *, CASE WHEN source_size > 0 THEN need * (large_words::DOUBLE / source_size) ELSE 0 END AS large_need FROM tiers
), cut_large AS (
  SELECT *, large AND upto - own < large_need AND (upto <= large_need OR (large_need - (upto - own)) * 2 > own) AS taken_large FROM first_cut
), second_cut AS (
  SELECT *, least(greatest(need - coalesce(sum(CASE WHEN taken_large THEN size END) OVER (PARTITION BY source), 0), 0), source_size - large_words) AS small_need FROM cut_large
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN taken_large OR (NOT large AND upto - own < small_need AND (upto <= small_need OR (small_need - (upto - own)) * 2 > own)) THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM second_cut"""
