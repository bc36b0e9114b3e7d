"""DuckDB SQL of the queries that SQL can express. The others are tested against brute force: tokenizers, crc32, models and strings of bytes are beyond it."""

LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP5 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("text")}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
p AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(list_slice(w, i, i + 12), ' ') AS s FROM (SELECT item_id, w, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS i FROM b WHERE len(w) > 0)),
q AS (SELECT DISTINCT n, s FROM p), l AS (SELECT DISTINCT n FROM q),
x AS (SELECT d.doc_id, l.n, d.w, unnest(range(1, len(d.w) - l.n + 2)) AS i FROM d, l WHERE len(d.w) >= l.n),
h AS (SELECT x.doc_id, x.i, x.n, q.s FROM (SELECT doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s FROM x) x JOIN q ON x.n = q.n AND x.s = q.s),
k AS (SELECT doc_id, count(DISTINCT place) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS place FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, array_to_string(list(item ORDER BY item), ',') AS items FROM (SELECT DISTINCT h.doc_id, p.item_id::VARCHAR AS item FROM h JOIN p ON h.n = p.n AND h.s = p.s WHERE p.item_id IS NOT NULL) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(k.n_hit, 0) AS n_hit, coalesce(t.n_items, 0) AS n_items, sha256(coalesce(t.items, '')) AS items_sha256, coalesce(k.n_hit, 0) > 0 AND 20 * coalesce(k.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN k ON d.doc_id = k.doc_id LEFT JOIN t ON d.doc_id = t.doc_id
"""

OP6 = """
WITH RECURSIVE v AS (SELECT vec_id, label, embedding::DOUBLE[] AS e FROM embeddings WHERE embedding IS NOT NULL AND label IS NOT NULL),
s AS (SELECT vec_id, label, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM v),
l AS (SELECT a.vec_id AS x, b.vec_id AS y FROM s a JOIN s b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE a.n > 0 AND b.n > 0 AND list_sum(list_transform(range(1, len(a.e) + 1), lambda i: a.e[i] * b.e[i])) / (a.n * b.n) >= 0.98),
r AS (SELECT vec_id AS x, vec_id AS m FROM embeddings UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.x),
k AS (SELECT x AS vec_id, count(*) AS n FROM l GROUP BY x), c AS (SELECT x AS vec_id, min(m) AS m FROM r GROUP BY x)
SELECT e.vec_id, coalesce(k.n, 0) AS n_links, c.m AS component_id, e.vec_id = c.m AS kept FROM embeddings e JOIN c ON e.vec_id = c.vec_id LEFT JOIN k ON e.vec_id = k.vec_id
"""

OP7 = f"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(list_slice(w, i, i + 1), ' ') AS s FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS common FROM g a JOIN g b ON a.s = b.s AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT x, y FROM p JOIN n a ON p.x = a.doc_id JOIN n b ON p.y = b.doc_id WHERE 100 * common >= 80 * (a.n + b.n - common)),
r AS (SELECT doc_id AS x, doc_id AS m FROM documents UNION SELECT l.y, r.m FROM r JOIN l ON l.x = r.x),
c AS (SELECT x, min(m) AS m FROM r GROUP BY x)
SELECT d.doc_id, coalesce(n.n, 0) AS n_shingles, c.m AS component_id, d.doc_id = c.m AS kept FROM documents d JOIN c ON d.doc_id = c.x LEFT JOIN n ON d.doc_id = n.doc_id
"""

OP11 = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w, row_number() OVER () AS r FROM documents),
b AS (SELECT row_number() OVER () AS q, item_id, list_distinct(regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS w FROM benchmark),
s AS (SELECT count(*) AS n, sum(len(w)) AS l FROM d WHERE len(w) > 0),
p AS (SELECT r, doc_id, len(w) AS n, unnest(w) AS t FROM d),
f AS (SELECT r, doc_id, n, t, count(*) AS tf FROM p GROUP BY ALL),
v AS (SELECT t, CAST(floor(1000 * ln((2 * s.n + 2) / (2 * c + 1))) AS BIGINT) AS w FROM (SELECT t, count(*) AS c FROM f GROUP BY t), s),
x AS (SELECT b.q, b.item_id, f.r, f.doc_id, CAST(sum(v.w * ((1000000000 * f.tf) // (1000 * f.tf + 8 * (10 + (90 * f.n * s.n) // s.l)))) AS BIGINT) AS score
  FROM (SELECT q, item_id, unnest(w) AS t FROM b) b JOIN f USING (t) JOIN v USING (t), s GROUP BY ALL)
SELECT item_id, CAST(rank AS INTEGER) AS rank, doc_id, score FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY score DESC, doc_id NULLS LAST) AS rank FROM x WHERE score > 0) WHERE rank <= 10
"""

OP12 = """
WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
x AS (SELECT doc_id, w, unnest(range(1, len(w) - 18)) AS i FROM d WHERE len(w) >= 20),
l AS (SELECT doc_id, i, row_number() OVER (PARTITION BY array_to_string(list_slice(w, i, i + 19), ' ') ORDER BY doc_id, i) > 1 AS late FROM x),
g AS (SELECT DISTINCT doc_id, i + unnest(range(20)) AS i FROM l WHERE late),
p AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS i FROM d),
k AS (SELECT p.doc_id, string_agg(p.word, ' ' ORDER BY p.i) AS rest, count(*) AS n FROM p ANTI JOIN g ON p.doc_id = g.doc_id AND p.i = g.i GROUP BY p.doc_id)
SELECT d.doc_id, len(d.w) AS n_words, len(d.w) - coalesce(k.n, 0) AS n_removed, sha256(coalesce(k.rest, '')) AS kept_sha256 FROM d LEFT JOIN k ON d.doc_id = k.doc_id
"""
