"""DuckDB SQL of the queries that SQL can express."""

ORACLE = {}

ORACLE["op1_mixing"] = r"""
WITH d AS (
  SELECT doc_id, source,
         CASE WHEN text IS NULL THEN 0 ELSE len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')) END::BIGINT AS size
  FROM documents),
k AS (
  SELECT *, md5(coalesce(doc_id::VARCHAR, '~') || ':' || size::VARCHAR || ':mix') AS h FROM d),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) - 1 AS rnk
  FROM d GROUP BY source),
w AS (
  SELECT *, [5, 2, 1][(rnk % 3 + 1)::INT] AS weight, (2 * source_size)::DOUBLE AS cap FROM s),
l AS (
  SELECT *, (1.5::DOUBLE * sum(source_size) OVER ()::DOUBLE
             - coalesce(sum(cap) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
            / sum(weight) OVER (ORDER BY cap / weight, rnk ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS lev
  FROM w),
t AS (
  SELECT source, source_size, rnk, least(cap, weight * max(lev) OVER ()) AS target FROM l),
p AS (
  SELECT doc_id, size, source_size, target, rnk, floor(target + 0.5)::BIGINT AS want,
         coalesce(sum(size) OVER (PARTITION BY k.source ORDER BY h ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS pos
  FROM k JOIN t ON k.source IS NOT DISTINCT FROM t.source),
q AS (
  SELECT *, greatest(0, least(size, want - pos)) AS one, greatest(0, least(size, want - pos - source_size)) AS two,
         CASE WHEN want > 0 THEN pos::DOUBLE / want END AS x
  FROM p)
SELECT doc_id, size, source_size, target, (one + two)::BIGINT AS taken,
       CASE WHEN one > 0 THEN round(CASE rnk % 3
         WHEN 0 THEN 2.0::DOUBLE * x / (1.5::DOUBLE + sqrt(2.25::DOUBLE + (-2.0)::DOUBLE * x))
         WHEN 1 THEN 2.0::DOUBLE * x / (1.0::DOUBLE + sqrt(1.0::DOUBLE + 0.0::DOUBLE * x))
         ELSE 2.0::DOUBLE * x / (0.5::DOUBLE + sqrt(0.25::DOUBLE + 2.0::DOUBLE * x)) END, 6) END AS position
FROM q
"""

ORACLE["op7_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score
  FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 100 = 0),
r AS (
  SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INT AS rank FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 10
"""

ORACLE["op11_source_audit"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
o AS (SELECT doc, lang, source, unnest(terms) AS term FROM d),
k AS (SELECT lang, term, count(*) AS n FROM o GROUP BY lang, term HAVING count(DISTINCT doc) >= 30),
l AS (SELECT lang, count(*) AS v, sum(n) AS total FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
c AS (SELECT lang, source, term, count(*) AS n FROM o JOIN k USING (lang, term) GROUP BY lang, source, term),
t AS (SELECT lang, source, sum(n) AS total FROM c GROUP BY lang, source),
p AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
         1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(t.total, 0) + 5 * l.v) AS p,
         1 + (1000000000::HUGEINT * (k.n + 5)) // (l.total + 5 * l.v) AS q
  FROM g JOIN k USING (lang) JOIN l USING (lang) LEFT JOIN c USING (lang, source, term) LEFT JOIN t USING (lang, source)),
pairs AS (
  SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
u AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0)::BIGINT AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pairs x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source
  UNION ALL
  SELECT lang, source, 'term', term, (p - q)::BIGINT FROM p WHERE n > 0 AND p > q),
r AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item)::INT AS rank FROM u)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 50
"""

ORACLE["op12_decontamination"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM documents),
b AS (
  SELECT coalesce(item_id::VARCHAR, '') AS item,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS words
  FROM benchmark),
i AS (
  SELECT DISTINCT item, least(len(words), 10) AS span,
         unnest(list_transform(range(1, len(words) - least(len(words), 10) + 2),
                               lambda p: array_to_string(words[p:p + least(len(words), 10) - 1], ' '))) AS win
  FROM b WHERE len(words) > 0),
s AS (SELECT DISTINCT span FROM i),
w AS (
  SELECT doc, span, unnest(range(1, len(words) - span + 2)) AS start,
         unnest(list_transform(range(1, len(words) - span + 2), lambda p: array_to_string(words[p:p + span - 1], ' '))) AS win
  FROM d, s WHERE len(words) >= span),
h AS (SELECT w.doc, w.start, w.span, i.item FROM w JOIN i USING (span, win)),
c AS (
  SELECT doc, count(*) AS n_hit
  FROM (SELECT DISTINCT doc, unnest(range(start, start + span)) AS word FROM h) GROUP BY doc),
n AS (SELECT doc, list_sort(list(DISTINCT item)) AS items FROM h GROUP BY doc)
SELECT d.doc_id, len(d.words)::BIGINT AS n_words, coalesce(c.n_hit, 0)::BIGINT AS n_hit,
       coalesce(len(n.items), 0)::BIGINT AS n_items, sha256(coalesce(array_to_string(n.items, ','), '')) AS items_sha256,
       coalesce(c.n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN c USING (doc) LEFT JOIN n USING (doc)
"""

ORACLE["op13_lexical_search"] = r"""
WITH d AS (
  SELECT row_number() OVER () AS doc, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') AS terms
  FROM documents),
g AS (SELECT count(*) AS docs, sum(len(terms))::BIGINT AS total FROM d WHERE len(terms) > 0),
o AS (SELECT doc, unnest(terms) AS term FROM d),
p AS (SELECT doc, term, count(*) AS tf FROM o GROUP BY doc, term),
f AS (SELECT term, floor(1000 * ln((2 * docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS w FROM p, g GROUP BY term, docs),
m AS (SELECT doc, doc_id, 100 - 25 + (25 * len(terms) * docs) // total AS m FROM d, g WHERE len(terms) > 0),
b AS (
  SELECT item_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                            '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) AS term
  FROM benchmark),
s AS (
  SELECT b.item_id, m.doc, m.doc_id, sum(f.w * ((1000000000 * p.tf) // (1000 * p.tf + 12 * m.m)))::BIGINT AS score
  FROM b JOIN p USING (term) JOIN f USING (term) JOIN m USING (doc) GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INT AS rank FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 20
"""
