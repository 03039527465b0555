"""DuckDB SQL for the queries that SQL can express; all over whole tables."""

from __future__ import annotations

OP2 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, embedding::DOUBLE[] AS e,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0
      AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
      AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS ok
  FROM embeddings
), link AS (
  SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id
  WHERE a.ok AND b.ok AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.98
), reach AS (
  SELECT vec_id AS a, vec_id AS b FROM v
  UNION SELECT r.a, l.b FROM reach r JOIN link l ON r.b = l.a
), component AS (SELECT a, min(b) AS c FROM reach GROUP BY a),
counts AS (SELECT a, count(*) AS n FROM link GROUP BY a)
SELECT v.vec_id, coalesce(n, 0)::BIGINT AS n_links, c AS component_id, c = v.vec_id AS kept
FROM v JOIN component ON component.a = v.vec_id LEFT JOIN counts ON counts.a = v.vec_id
"""

OP3 = """
WITH d AS (SELECT doc_id, encode(coalesce(text, '')) AS b FROM documents),
w AS (
  SELECT doc_id, s, md5(b[s + 1:s + 100]) AS h
  FROM (SELECT doc_id, b, unnest(range(greatest(octet_length(b) - 99, 0))) AS s FROM d)
), later AS (
  SELECT doc_id, s FROM w
  QUALIFY row_number() OVER (PARTITION BY h ORDER BY doc_id, s) > 1
), marked AS (
  SELECT doc_id, s, s - coalesce(lag(s) OVER (PARTITION BY doc_id ORDER BY s), -1000) > 100 AS new FROM later
), numbered AS (
  SELECT doc_id, s, count_if(new) OVER (PARTITION BY doc_id ORDER BY s) AS k FROM marked
), span AS (
  SELECT doc_id, k, min(s) AS a, max(s) + 100 AS z FROM numbered GROUP BY ALL
), gap AS (
  SELECT doc_id, coalesce(lag(z) OVER (PARTITION BY doc_id ORDER BY a), 0) AS a, a AS z FROM span
  UNION ALL SELECT doc_id, max(z), NULL FROM span GROUP BY doc_id
), kept AS (
  SELECT g.doc_id, unhex(string_agg(hex(b[g.a + 1:coalesce(g.z, octet_length(b))]), '' ORDER BY g.a)) AS b
  FROM gap g JOIN d USING (doc_id) WHERE coalesce(g.z, octet_length(b)) > g.a GROUP BY g.doc_id
), sums AS (SELECT doc_id, sum(z - a)::BIGINT AS removed, count(*) AS spans FROM span GROUP BY doc_id)
SELECT d.doc_id, octet_length(d.b) AS n_bytes, coalesce(removed, 0) AS n_removed, coalesce(spans, 0) AS n_spans,
  sha256(CASE WHEN removed IS NULL THEN d.b ELSE coalesce(kept.b, ''::BLOB) END) AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id) LEFT JOIN kept USING (doc_id)
"""

_WORDS = (
    "list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',"
    " 'abcdefghijklmnopqrstuvwxyz'), '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

OP8 = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
b AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark),
needle AS (
  SELECT DISTINCT item, len(w) AS n, w[i + 1:i + 10] AS x
  FROM (SELECT item, w, unnest(range(greatest(len(w) - 10, 0) + 1)) AS i FROM b WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT len(x) AS n FROM needle),
place AS (
  SELECT doc_id, i, n, w[i + 1:i + n] AS x
  FROM (SELECT doc_id, w, n, unnest(range(greatest(len(w) - n + 1, 0))) AS i FROM d, sizes)
), hit AS (SELECT doc_id, i, place.n AS n, item FROM place JOIN needle USING (x)),
words AS (SELECT doc_id, count(DISTINCT k) AS n FROM (SELECT doc_id, unnest(range(i, i + n)) AS k FROM hit) GROUP BY doc_id),
items AS (
  SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s
  FROM (SELECT DISTINCT doc_id, item FROM hit) GROUP BY doc_id
)
SELECT d.doc_id, len(w)::BIGINT AS n_words, coalesce(words.n, 0)::BIGINT AS n_hit, coalesce(items.n, 0)::BIGINT AS n_items,
  sha256(coalesce(s, '')) AS items_sha256, words.n IS NOT NULL AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP10 = """
WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS l FROM documents),
line AS (SELECT doc_id, i, l[i + 1] AS line FROM (SELECT doc_id, l, unnest(range(len(l))) AS i FROM d)),
first AS (
  SELECT line, min({'doc': doc_id, 'place': i}) AS f, length(line) AS n FROM line WHERE length(line) >= 1 GROUP BY line
), half AS (
  SELECT line, f, m, h, CASE h WHEN 1 THEN substring(line, 1, m // 2) ELSE substring(line, n - (m - m // 2) + 1) END AS x
  FROM first, LATERAL (SELECT unnest([n, n + 1]) AS m), (SELECT unnest([0, 1]) AS h) WHERE n >= 2
), near AS (
  SELECT DISTINCT a.f FROM half a JOIN half b USING (m, h, x)
  WHERE b.f < a.f AND abs(length(a.line) - length(b.line)) <= 1 AND levenshtein(a.line, b.line) <= 4 -- bytes
    AND CASE WHEN length(a.line) = length(b.line)
      THEN len(list_filter(range(1, m + 1), lambda i: substring(a.line, i, 1) <> substring(b.line, i, 1))) <= 1
      ELSE len(list_filter(range(m), lambda i: CASE WHEN length(a.line) = m
        THEN substring(a.line, 1, i) || substring(a.line, i + 2) = b.line
        ELSE substring(b.line, 1, i) || substring(b.line, i + 2) = a.line END)) > 0 END
), told AS (
  SELECT line.doc_id, i, line.line, first.f IS NOT NULL AND first.f <> {'doc': doc_id, 'place': i} AS copy,
    near.f IS NOT NULL AND first.f = {'doc': doc_id, 'place': i} AS near
  FROM line LEFT JOIN first ON first.line = line.line LEFT JOIN near ON near.f = first.f
), sums AS (
  SELECT doc_id, count_if(copy) AS copies, count_if(near) AS nears,
    coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (NOT copy AND NOT near), '') AS kept
  FROM told GROUP BY doc_id
)
SELECT d.doc_id, coalesce(len(l), 0)::BIGINT AS n_lines, coalesce(copies, 0)::BIGINT AS n_copies,
  coalesce(nears, 0)::BIGINT AS n_near, CASE WHEN text IS NOT NULL THEN sha256(kept) END AS kept_sha256
FROM d LEFT JOIN sums USING (doc_id)
"""

OP12 = """
WITH RECURSIVE crc AS (
  SELECT list(v ORDER BY i) AS t FROM (
    SELECT i, list_reduce([i::UBIGINT, 0, 0, 0, 0, 0, 0, 0, 0],
      lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END) AS v
    FROM range(256) AS r(i)
  )
), run AS (
  SELECT doc_id, r, count(*) AS n FROM (
    SELECT doc_id, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[a-zÀ-ÿ]+')) AS r
    FROM documents
  ) GROUP BY ALL
), byte AS (
  SELECT doc_id, r, n, flatten(list_transform(string_split(coalesce(doc_id::VARCHAR, '') || ':' || r, ''),
    lambda c: CASE WHEN unicode(c) < 128 THEN [unicode(c)::UBIGINT] ELSE [195::UBIGINT, (unicode(c) - 64)::UBIGINT] END)) AS b
  FROM run
), hashed AS (
  SELECT r, n, xor(list_reduce(list_concat([4294967295::UBIGINT], b),
    lambda c, x: xor(c >> 8, t[((xor(c, x) & 255) + 1)::BIGINT])), 4294967295::UBIGINT) AS h
  FROM byte, crc
), word AS (
  SELECT word, sum(n)::BIGINT AS n FROM (
    SELECT n, CASE WHEN h % 199 = 0 THEN substring(r, 1, (h % length(r))::BIGINT) || substring(r, (h % length(r))::BIGINT + 2) ELSE r END AS word
    FROM hashed
  ) WHERE length(word) >= 6 GROUP BY word HAVING sum(n) >= 5
), cut AS (
  SELECT word, n, i, substring(word, 1, i) || substring(word, i + 2) AS rest
  FROM (SELECT word, n, unnest(range(length(word))) AS i FROM word)
), near AS (
  SELECT a.word, a.n, b.word AS near, b.n AS near_n FROM cut a JOIN cut b USING (i, rest) WHERE a.word <> b.word
  UNION SELECT a.word, a.n, b.word, b.n FROM cut a JOIN word b ON a.rest = b.word
  UNION SELECT b.word, b.n, a.word, a.n FROM cut a JOIN word b ON a.rest = b.word
), best AS (
  SELECT word, any_value(n) AS n, count(*) AS n_near, max(near_n) AS form_n,
    arg_min(near, {'k': -near_n, 'w': encode(near)}) AS form
  FROM near GROUP BY word
), told AS (
  SELECT word.word, word.n, coalesce(n_near, 0)::BIGINT AS n_near,
    CASE WHEN form_n >= 5 * word.n THEN form END AS form, CASE WHEN form_n >= 5 * word.n THEN form_n END AS form_n
  FROM word LEFT JOIN best USING (word)
), walk AS (
  SELECT word, word AS place, 0 AS k FROM told
  UNION ALL SELECT walk.word, told.form, k + 1 FROM walk JOIN told ON told.word = walk.place WHERE told.form IS NOT NULL
)
SELECT word, form, root, n, n_near, form_n
FROM told JOIN (SELECT word, arg_max(place, k) AS root FROM walk GROUP BY word) USING (word)
"""

ORACLE = {
    "op2_embedding_near_dedup": OP2,
    "op3_suffix_array_dedup": OP3,
    "op8_decontamination": OP8,
    "op10_line_dedup": OP10,
    "op12_spelling_variants": OP12,
}
