"""The results of the corpus queries in DuckDB SQL, where SQL can express them.

The others have no SQL form: page parsing, tokenizers, hashes that DuckDB lacks, random-token
statistics and nearest examples are held against brute force in the tests.
"""

from __future__ import annotations

import string

WORD = r"[^\x20\x09-\x0D]+"

_EMBEDDINGS = """
WITH RECURSIVE good AS (
  SELECT vec_id, list_transform(embedding, lambda c: c::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0
    AND len(list_filter(embedding, lambda c: c <> 0)) > 0),
linked AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM good a JOIN good b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (
  SELECT a, b FROM linked UNION SELECT r.a, l.b FROM reach r JOIN linked l ON l.a = r.b)
SELECT v.vec_id, coalesce(n.n, 0) AS n_links, coalesce(least(c.c, v.vec_id), v.vec_id) AS component_id,
  coalesce(least(c.c, v.vec_id), v.vec_id) = v.vec_id AS kept
FROM embeddings v
LEFT JOIN (SELECT a, count(*) AS n FROM linked GROUP BY a) n ON n.a = v.vec_id
LEFT JOIN (SELECT a, min(b) AS c FROM reach GROUP BY a) c ON c.a = v.vec_id
"""

_QUALITY = rf"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS text FROM documents),
words AS (
  SELECT rid, unnest(ws) AS word, generate_subscripts(ws, 1) AS pos
  FROM (SELECT rid, regexp_extract_all(text, '{WORD}') AS ws FROM docs)),
windows AS (
  SELECT rid, pos, word, lead(word) OVER p AS w2, lead(word, 2) OVER p AS w3 FROM words
  WINDOW p AS (PARTITION BY rid ORDER BY pos)),
counted AS (
  SELECT rid, pos, word, w3 IS NOT NULL AND count(*) OVER (PARTITION BY rid, word, w2, w3) > 1 AS twice FROM windows),
covered AS (
  SELECT rid, word, bool_or(twice) OVER (PARTITION BY rid ORDER BY pos ROWS BETWEEN 2 PRECEDING AND CURRENT ROW) AS inside
  FROM counted),
by_word AS (
  SELECT rid, count(*) AS n_words, sum(length(word)) AS word_chars, count(*) FILTER (inside) AS n_repeat_words
  FROM covered GROUP BY rid),
lines AS (
  SELECT rid, doc_id, source, line, len(regexp_extract_all(line, '{WORD}')) AS n,
    trim(regexp_replace(translate(line, '{string.ascii_uppercase}', '{string.ascii_lowercase}'), '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS plain
  FROM (SELECT rid, doc_id, source, unnest(string_split(text, chr(10))) AS line FROM docs)
  WHERE regexp_matches(line, '{WORD}')),
dups AS (SELECT rid, count(*) - count(DISTINCT line) AS n_dup_lines FROM lines GROUP BY rid),
hosts AS (SELECT source, count(DISTINCT doc_id) AS docs FROM docs GROUP BY source),
common AS (
  SELECT l.source, l.plain FROM lines l JOIN hosts h ON h.source IS NOT DISTINCT FROM l.source
  GROUP BY l.source, l.plain, h.docs
  HAVING count(DISTINCT l.doc_id) > 20 AND count(DISTINCT l.doc_id) > 0.1 * h.docs),
removed AS (
  SELECT l.rid, sum(l.n) AS n FROM lines l
  JOIN common c ON c.source IS NOT DISTINCT FROM l.source AND c.plain = l.plain GROUP BY l.rid),
told AS (
  SELECT d.doc_id, coalesce(w.n_words, 0)::BIGINT AS n_words, coalesce(w.word_chars, 0)::BIGINT AS word_chars,
    (length(d.text) - length(regexp_replace(d.text, '[#*$%&|<>]', '', 'g')))::BIGINT AS n_symbols,
    coalesce(u.n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(w.n_repeat_words, 0)::BIGINT AS n_repeat_words,
    coalesce(r.n, 0)::BIGINT AS removed_words
  FROM docs d LEFT JOIN by_word w USING (rid) LEFT JOIN dups u USING (rid) LEFT JOIN removed r USING (rid))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
  NOT (n_words < 50 OR 100 * n_repeat_words > 50 * n_words) AND removed_words <= 0.5 * n_words AS kept, removed_words
FROM told
"""

_MIXING = rf"""
WITH sizes AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size,
    ('0x' || md5(concat_ws(chr(10), '17', '=' || doc_id, '=' || source, '=' || text))[1:15])::BIGINT AS draw
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
    [1, 2, 3][1 + (row_number() OVER (ORDER BY encode(source) NULLS LAST) - 1) % 3] AS weight
  FROM sizes GROUP BY source),
filled AS (
  SELECT source, source_size, weight, 3 * source_size AS lim,
    coalesce(sum(3 * source_size) OVER before, 0) AS held,
    sum(weight) OVER () - coalesce(sum(weight) OVER before, 0) AS open, sum(source_size) OVER () AS whole
  FROM sources
  WINDOW before AS (ORDER BY (3 * source_size) / weight, encode(source) NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
level AS (
  SELECT arg_min((whole - held)::DOUBLE / open::DOUBLE, held) AS level FROM filled
  WHERE lim / weight >= (whole - held)::DOUBLE / open::DOUBLE),
aims AS (
  SELECT source, source_size, least(lim::DOUBLE, level * weight) AS target FROM filled, level),
plan AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size)::BIGINT ELSE 0 END AS reps FROM aims),
rows AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.reps, floor(p.target + 0.5)::BIGINT - p.reps * p.source_size AS part,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.draw, s.doc_id, s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS used
  FROM sizes s JOIN plan p ON p.source IS NOT DISTINCT FROM s.source)
SELECT doc_id, size::BIGINT AS size, source_size, target,
  (reps * size + greatest(0, least(size, part - used)))::BIGINT AS taken
FROM rows
"""

_INFILL = """
WITH cut AS (
  SELECT doc_id, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[A-Za-z]+|[^A-Za-z]') AS tokens,
    sha256('1:' || coalesce(doc_id::VARCHAR, '')) AS d
  FROM documents),
drawn AS (
  SELECT *, len(tokens) AS n, ('0x' || d[1:8])::BIGINT % (len(tokens) + 1) AS u, ('0x' || d[9:16])::BIGINT % (len(tokens) + 1) AS v,
    CASE WHEN text = '' OR contains(text, '<P>') OR contains(text, '<S>') OR contains(text, '<M>')
        OR ('0x' || d[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || d[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM cut),
parts AS (
  SELECT doc_id, text, n, form, coalesce(array_to_string(tokens[1:least(u, v)], ''), '') AS p,
    coalesce(array_to_string(tokens[least(u, v) + 1:greatest(u, v)], ''), '') AS m,
    coalesce(array_to_string(tokens[greatest(u, v) + 1:n], ''), '') AS s
  FROM drawn)
SELECT doc_id, n, form, CASE WHEN form <> 'plain' THEN length(p) END AS prefix_chars,
  CASE WHEN form <> 'plain' THEN length(m) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN text WHEN 'psm' THEN '<P>' || p || '<S>' || s || '<M>' || m
    ELSE '<S>' || s || '<P>' || p || '<M>' || m END) AS output_sha256,
  sha256(text) AS restored_sha256
FROM parts
"""


def _centroids(count: int = 16, rounds: int = 3) -> str:
    """The rounds written out one after the other."""
    def assigned(k: int) -> str:
        return f"""a{k} AS MATERIALIZED (
  SELECT rid, vec_id, x, c, distance FROM (
    SELECT k.rid, k.vec_id, k.x, m.c,
      list_sum(list_transform(range(1, 65), lambda i: (k.x[i] - m.x[i]) * (k.x[i] - m.x[i])))::BIGINT AS distance
    FROM kept k, c{k} m)
  QUALIFY row_number() OVER (PARTITION BY rid ORDER BY distance, c) = 1)"""

    def moved(k: int) -> str:
        return f"""s{k} AS (
  SELECT c, i, sum(x[i]) AS s, count(*) AS n FROM a{k - 1}, (SELECT unnest(range(1, 65)) AS i) GROUP BY c, i),
c{k} AS MATERIALIZED (
  SELECT o.c, coalesce(t.x, o.x) AS x FROM c{k - 1} o LEFT JOIN (
    SELECT c, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS x FROM s{k} GROUP BY c) t USING (c))"""

    steps = ",\n".join([assigned(0), *(step for k in range(1, rounds + 1) for step in (moved(k), assigned(k)))])
    return f"""
WITH kept AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id,
    list_transform(embedding, lambda e: greatest(least(floor(64 * e::DOUBLE), 134217728), -134217728)::BIGINT) AS x
  FROM embeddings
  WHERE embedding IS NOT NULL AND len(embedding) = 64
    AND len(list_filter(embedding, lambda e: e IS NULL OR isnan(e) OR isinf(e))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) - 1 AS c, x FROM kept
  QUALIFY row_number() OVER (ORDER BY sha256('1:' || vec_id) NULLS LAST, x) <= {count}),
{steps}
SELECT vec_id, c AS cluster, distance, sum(distance) OVER (PARTITION BY c)::BIGINT AS cluster_inertia,
  sum(distance) OVER ()::BIGINT AS inertia, sha256(array_to_string(m.x, ',')) AS centroid_sha256
FROM a{rounds} JOIN c{rounds} m USING (c)
"""


def statements() -> dict[str, str]:
    return {
        "op2_embedding_near_dedup": _EMBEDDINGS,
        "op5_quality_rules": _QUALITY,
        "op8_mixing": _MIXING,
        "op11_fill_in_middle": _INFILL,
        "op13_centroid_clustering": _centroids(),
    }
