"""The same results in DuckDB SQL, where SQL can state them."""

from __future__ import annotations

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

DECONTAMINATION = f"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {_ITEM_WORDS} AS w FROM documents),
b AS (SELECT item_id, w, least(len(w), 10) AS k FROM (SELECT item_id, {_ITEM_WORDS} AS w FROM benchmark) WHERE len(w) > 0),
win AS (SELECT DISTINCT item_id, k, array_to_string(w[i:i + k - 1], ' ') AS s
        FROM (SELECT item_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM b)),
spans AS (SELECT r, k, i, array_to_string(w[i:i + k - 1], ' ') AS s
          FROM (SELECT r, w, k, unnest(range(1, len(w) - k + 2)) AS i
                FROM d, (SELECT DISTINCT k FROM win) WHERE len(w) >= k)),
met AS (SELECT DISTINCT r, i, k, item_id FROM spans JOIN win USING (k, s)),
hit AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(i, i + k)) AS p FROM met) GROUP BY r),
items AS (SELECT r, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT r, CAST(item_id AS VARCHAR) AS id FROM met) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""

DIVERGENCE = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
                  regexp_extract_all({_LOWER}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
t AS (SELECT lang, source, r, term, count(*) AS n FROM (SELECT lang, source, r, unnest(w) AS term FROM d) GROUP BY ALL),
kept AS (SELECT lang, term, sum(n) AS n FROM t GROUP BY ALL HAVING count(*) >= 30),
sizes AS (SELECT lang, count(*) AS v, sum(n) AS total FROM kept GROUP BY lang),
counts AS (SELECT lang, source, term, sum(t.n) AS n FROM t JOIN kept USING (lang, term) GROUP BY ALL),
groups AS (SELECT lang, source, coalesce(any_value(v), 0) AS v, coalesce(sum(n), 0) AS total
           FROM (SELECT DISTINCT lang, source FROM d) LEFT JOIN sizes USING (lang) LEFT JOIN counts USING (lang, source) GROUP BY ALL),
p AS (SELECT lang, source, term, coalesce(c.n, 0) AS n,
             1 + 1000000000::HUGEINT * (coalesce(c.n, 0) + 5) // (g.total + 5 * g.v) AS p,
             1 + 1000000000::HUGEINT * (k.n + 5) // (s.total + 5 * s.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN sizes s USING (lang) LEFT JOIN counts c USING (lang, source, term)),
pairs AS (SELECT g.lang, g.source, h.source AS item, coalesce(sum(abs(a.p - b.p)), 0) AS value
          FROM groups g JOIN groups h ON g.lang = h.lang AND g.source <> h.source
          LEFT JOIN p a ON a.lang = g.lang AND a.source = g.source
          LEFT JOIN p b ON b.lang = h.lang AND b.source = h.source AND b.term = a.term GROUP BY ALL),
parts AS (SELECT lang, source, 'pair' AS part, item, value FROM pairs
          UNION ALL SELECT lang, source, 'term', term, p - q FROM p WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM parts)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank
FROM ranked WHERE part = 'pair' OR rank <= 50
"""

COLLOCATIONS = rf"""
WITH pieces AS (SELECT coalesce(lang, 'und') AS lang,
                       unnest(regexp_split_to_array({_LOWER}, '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, regexp_extract_all(piece, '[^\x20\x09]+') AS w FROM pieces),
grams AS (SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f
          FROM (SELECT lang, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM w, (SELECT unnest([1, 2, 3]) AS k)) GROUP BY ALL),
totals AS (SELECT lang, sum(f) AS n FROM grams WHERE k = 1 GROUP BY lang),
candidates AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS p FROM grams WHERE k > 1 AND f >= 10),
cuts AS (SELECT lang, k, phrase, a, p, c, array_to_string(p[1:c], ' ') AS front, array_to_string(p[c + 1:], ' ') AS back
         FROM (SELECT *, unnest(range(1, k)) AS c FROM candidates)),
scored AS (SELECT c.lang, c.k, c.phrase, c.a, c.c, x.f AS l, y.f AS r, 1000000::HUGEINT * c.a * c.a // (x.f::HUGEINT * y.f) AS score
           FROM cuts c JOIN grams x ON x.lang = c.lang AND x.phrase = c.front AND x.k = c.c
           JOIN grams y ON y.lang = c.lang AND y.phrase = c.back AND y.k = c.k - c.c),
lowest AS (SELECT * FROM scored QUALIFY row_number() OVER (PARTITION BY lang, phrase ORDER BY score, c) = 1),
dropped AS (SELECT DISTINCT s.lang, s.phrase FROM candidates s
            JOIN (SELECT lang, a, unnest([array_to_string(p[1:2], ' '), array_to_string(p[2:3], ' ')]) AS inside
                  FROM candidates WHERE k = 3) t ON t.lang = s.lang AND t.inside = s.phrase AND 100 * t.a >= 50 * s.a WHERE s.k = 2),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank
           FROM lowest ANTI JOIN dropped USING (lang, phrase))
SELECT lang, rank, phrase, CAST(a AS BIGINT) AS a, CAST(l AS BIGINT) AS l, CAST(r AS BIGINT) AS r, CAST(n AS BIGINT) AS n, CAST(score AS BIGINT) AS score
FROM ranked JOIN totals USING (lang) WHERE rank <= 2000
"""

_REACHED = """reached AS (SELECT id, id AS other FROM nodes UNION SELECT r.id, e.b FROM reached r JOIN edges e ON e.a = r.other)"""

NEAR_VECTORS = f"""
WITH RECURSIVE v AS (SELECT row_number() OVER () AS r, vec_id, CAST(embedding AS DOUBLE[]) AS x FROM embeddings),
able AS MATERIALIZED (SELECT * FROM v WHERE len(x) > 0 AND len(list_filter(x, lambda c: c IS NULL OR isnan(c) OR isinf(c))) = 0 AND len(list_filter(x, lambda c: c <> 0)) > 0),
links AS (SELECT a.r AS ra, b.r AS rb, a.vec_id AS a, b.vec_id AS b FROM able a JOIN able b ON a.r <> b.r AND len(a.x) = len(b.x)
          WHERE list_cosine_similarity(a.x, b.x) >= 0.95),
edges AS (SELECT DISTINCT a, b FROM links), nodes AS (SELECT DISTINCT vec_id AS id FROM v), {_REACHED},
least AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id),
counts AS (SELECT ra AS r, count(*) AS n FROM links GROUP BY ra)
SELECT vec_id, CAST(coalesce(n, 0) AS BIGINT) AS n_links, component_id, vec_id = component_id AS kept
FROM v JOIN least ON id = vec_id LEFT JOIN counts USING (r)
"""

REPEATS = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, encode(coalesce(text, '')) AS t FROM documents),
starts AS (SELECT r, doc_id, p, t[p + 1:p + 50] AS s FROM (SELECT r, doc_id, t, unnest(range(0, octet_length(t) - 49)) AS p FROM d)),
firsts AS (SELECT s, min(doc_id) AS first FROM starts GROUP BY s),
hits AS (SELECT r, p, lag(p) OVER (PARTITION BY r ORDER BY p) AS before FROM starts JOIN firsts USING (s) WHERE first < doc_id),
runs AS (SELECT r, min(p) AS a, max(p) + 50 AS b FROM (
           SELECT r, p, sum(CASE WHEN p <= before + 50 THEN 0 ELSE 1 END) OVER (PARTITION BY r ORDER BY p) AS run FROM hits) GROUP BY r, run),
gaps AS (SELECT r, a, b, coalesce(lag(b) OVER (PARTITION BY r ORDER BY a), 0) AS before FROM runs),
sums AS (SELECT r, sum(b - a) AS removed, count(*) AS spans, max(b) AS last, string_agg(hex(t[before + 1:a]), '' ORDER BY a) AS pieces
         FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, CAST(octet_length(t) AS BIGINT) AS n_bytes, CAST(coalesce(removed, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans,
       sha256(CASE WHEN last IS NULL THEN t ELSE unhex(pieces || hex(t[last + 1:])) END) AS kept_sha256
FROM d LEFT JOIN sums USING (r)
"""

JACCARD = rf"""
WITH RECURSIVE d AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all({_LOWER}, '[^\x20\x09-\x0D]+') AS w FROM documents),
named_sets AS MATERIALIZED (SELECT DISTINCT r, array_to_string(w[i:i + 4], ' ') AS name
                            FROM (SELECT r, w, unnest(range(1, greatest(len(w) - 3, 2))) AS i FROM d WHERE len(w) > 0)),
sizes AS (SELECT r, count(*) AS n FROM named_sets GROUP BY r),
s AS MATERIALIZED (SELECT r, doc_id, coalesce(n, 0) AS n FROM d LEFT JOIN sizes USING (r)),
numbers AS (SELECT name, row_number() OVER () AS t FROM named_sets GROUP BY name HAVING count(*) > 1),
t AS MATERIALIZED (SELECT r, n, t FROM named_sets JOIN numbers USING (name) JOIN sizes USING (r)),
links AS (SELECT a.r AS ra, b.r AS rb FROM t a JOIN t b ON a.t = b.t AND a.r < b.r AND 100 * least(a.n, b.n) >= 75 * greatest(a.n, b.n)
          GROUP BY a.r, b.r, a.n, b.n HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
named AS (SELECT x.doc_id AS a, y.doc_id AS b FROM links JOIN s x ON x.r = ra JOIN s y ON y.r = rb),
edges AS (SELECT DISTINCT a, b FROM named UNION SELECT b, a FROM named), nodes AS (SELECT DISTINCT doc_id AS id FROM d), {_REACHED},
least AS (SELECT id, min(other) AS component_id FROM reached GROUP BY id)
SELECT doc_id, CAST(n AS BIGINT) AS n_shingles, component_id FROM s JOIN least ON id = doc_id
"""
