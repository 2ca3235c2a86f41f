"""DuckDB SQL of the queries that SQL can express."""

WORDS = (r"regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', "
         r"'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')")

OP5 = f"""
WITH item AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {WORDS} AS w FROM benchmark
), win AS (
  SELECT DISTINCT item, w[i + 1:i + 13] AS phrase
  FROM item, unnest(generate_series(0, greatest(len(w) - 13, 0))) AS u(i) WHERE len(w) > 0
), size AS (SELECT DISTINCT len(phrase) AS k FROM win),
doc AS (SELECT doc_id, {WORDS} AS w FROM documents),
gram AS (
  SELECT doc_id, i, k, w[i + 1:i + k] AS phrase
  FROM doc, size, unnest(generate_series(0, len(w) - k)) AS u(i) WHERE len(w) >= k
), hit AS (SELECT gram.doc_id, gram.i, gram.k, win.item FROM gram JOIN win USING (phrase)),
place AS (SELECT DISTINCT doc_id, unnest(generate_series(i, i + k - 1)) AS p FROM hit),
n_hit AS (SELECT doc_id, count(*) AS n_hit FROM place GROUP BY doc_id),
items AS (
  SELECT doc_id, count(DISTINCT item) AS n_items, list_sort(list(DISTINCT item)) AS items
  FROM hit GROUP BY doc_id
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(array_to_string(items, ','), '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM doc LEFT JOIN n_hit USING (doc_id) LEFT JOIN items USING (doc_id)
"""

OP12 = """
WITH vec AS (
  SELECT vec_id AS id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT a.id AS anchor, c.id, a.label = c.label AS same,
         CAST(list_sum(list_transform(list_zip(a.v, c.v), lambda z: z[1] * z[2])) AS BIGINT) AS score
  FROM vec a JOIN vec c ON a.id <> c.id WHERE a.id % 100 = 0
), positive AS (
  SELECT anchor, id, score FROM scored WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor ORDER BY score DESC, id) <= 5
)
SELECT p.anchor AS anchor_id, p.id AS positive_id,
       CAST(row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) AS INTEGER) AS rank,
       n.id AS negative_id, p.score AS positive_score, n.score AS negative_score
FROM positive p JOIN scored n ON n.anchor = p.anchor AND NOT n.same
WHERE 80 * p.score <= 100 * n.score AND n.score <= p.score
QUALIFY row_number() OVER (PARTITION BY p.anchor, p.id ORDER BY n.score DESC, n.id) <= 5
"""
