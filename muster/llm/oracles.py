"""DuckDB SQL for the queries that SQL can express, written from their definitions."""

NEAR_VECTORS = """
WITH RECURSIVE v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings),
sound AS (SELECT * FROM v WHERE e IS NOT NULL AND len(e) > 0 AND len(list_filter(e, lambda x: x IS NULL OR NOT isfinite(x))) = 0
          AND len(list_filter(e, lambda x: x <> 0)) > 0),
unit AS (SELECT vec_id, e, sqrt(list_sum(list_transform(e, lambda x: x * x))) AS n FROM sound),
links AS (SELECT a.vec_id AS a, b.vec_id AS b FROM unit a JOIN unit b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
          AND list_dot_product(a.e, b.e) / (a.n * b.n) >= 0.9),
reach AS (SELECT vec_id AS root, vec_id AS node FROM v UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node)
SELECT v.vec_id, (SELECT count(*) FROM links l WHERE l.a = v.vec_id) AS n_links,
       (SELECT min(node) FROM reach r WHERE r.root = v.vec_id) AS component_id,
       v.vec_id = (SELECT min(node) FROM reach r WHERE r.root = v.vec_id) AS kept
FROM v"""

NEAR_DOCUMENTS = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS w FROM documents),
grams AS (SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) >= 4 THEN list_transform(range(1, len(w) - 2), lambda i: w[i:i + 3])
                                              WHEN len(w) > 0 THEN [w] ELSE [] END) AS g FROM w),
sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
           GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b
          WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id AS root, doc_id AS node FROM documents
          UNION SELECT r.root, l.b FROM reach r JOIN links l ON l.a = r.node),
least AS (SELECT root, min(node) AS component_id FROM reach GROUP BY root)
SELECT d.doc_id, coalesce(s.n, 0) AS n_shingles, l.component_id
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id JOIN least l ON l.root = d.doc_id"""

_WORDS = r"regexp_extract_all(lower(coalesce(text, '')), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
BENCHMARK_PASSAGES = f"""
WITH d AS (SELECT doc_id, {_WORDS} AS w FROM documents), i AS (SELECT item_id, {_WORDS} AS v FROM benchmark),
item AS (SELECT item_id, v, least(len(v), 20) AS stretch,
                least(len(v), 20) - CASE WHEN len(v) >= 20 THEN 4 WHEN len(v) >= 13 THEN 1 ELSE 0 END AS need
         FROM i WHERE len(v) >= 8),
dw AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM d),
iw AS (SELECT item_id, unnest(v) AS word, generate_subscripts(v, 1) - 1 AS j FROM item),
agree AS (SELECT doc_id, item_id, p - j AS diagonal, list(j) AS js FROM dw JOIN iw USING (word)
          GROUP BY doc_id, item_id, p - j HAVING count(*) >= 8),
windows AS (SELECT doc_id, a.item_id, diagonal, stretch, need, s, len(list_filter(js, lambda j: j >= s AND j < s + stretch)) AS c
            FROM (SELECT a.*, t.stretch, t.need, unnest(range(0, len(t.v) - t.stretch + 1)) AS s
                  FROM agree a JOIN item t ON t.item_id = a.item_id) a),
found AS (SELECT doc_id, item_id, diagonal, stretch, max(c) AS agreeing, diagonal + min(s) AS first,
                 diagonal + max(s) + stretch AS last FROM windows WHERE c >= need GROUP BY doc_id, item_id, diagonal, stretch),
best AS (SELECT *, row_number() OVER (PARTITION BY doc_id, item_id ORDER BY agreeing DESC, stretch DESC, first, last DESC) AS r
         FROM found)
SELECT doc_id, item_id, agreeing, stretch, first AS start, last AS "end" FROM best WHERE r = 1"""


SOURCE_DIVERGENCE = r"""
WITH d AS (SELECT row_number() OVER () AS i, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
             translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
w AS (SELECT i, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM w GROUP BY lang, term HAVING count(DISTINCT i) >= 30),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
cells AS (SELECT lang, source, term, count(*) AS n FROM w SEMI JOIN kept USING (lang, term) GROUP BY lang, source, term),
sizes AS (SELECT lang, source, sum(n) AS n FROM cells GROUP BY lang, source),
p AS (SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n,
        1 + (1000000000::HUGEINT * (coalesce(c.n, 0) + 5)) // (coalesce(s.n, 0)::HUGEINT + 5 * l.v) AS p,
        1 + (1000000000::HUGEINT * (k.n + 5)) // (l.n::HUGEINT + 5 * l.v) AS q
      FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang)
      LEFT JOIN cells c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term
      LEFT JOIN sizes s ON s.lang = g.lang AND s.source = g.source),
apart AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value
          FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
pairs AS (SELECT a.lang, a.source, b.source AS item, coalesce(x.value, 0) AS value
          FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
          LEFT JOIN apart x ON x.lang = a.lang AND x.source = a.source AND x.item = b.source),
ranked AS (SELECT lang, source, 'pair' AS part, item, value,
             row_number() OVER (PARTITION BY lang, source ORDER BY value DESC, item) AS r FROM pairs
           UNION ALL SELECT * FROM (SELECT lang, source, 'term', term, p - q,
             row_number() OVER (PARTITION BY lang, source ORDER BY p - q DESC, term) AS r FROM p WHERE n > 0 AND p > q) WHERE r <= 50)
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(r AS INTEGER) AS rank FROM ranked"""

SPELLING_VARIANTS = r"""
WITH RECURSIVE bits AS (SELECT i, i::BIGINT AS c, 0 AS k FROM range(256) t(i)
  UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM bits WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM bits WHERE k = 8),
runs AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
         '[A-Za-z\x{C0}-\x{FF}]+')) AS run FROM documents),
counted AS (SELECT coalesce(doc_id::VARCHAR, '') AS d, run, count(*) AS n FROM runs GROUP BY ALL),
named AS (SELECT d, run, n, hex(encode(d || ':' || run)) AS x FROM counted WHERE length(run) >= 5),
hashed AS (SELECT run, n, xor(list_reduce(list_transform(range(length(x) // 2), lambda k: ('0x' || substr(x, 2 * k + 1, 2))::BIGINT),
             lambda h, b: xor(h >> 8, t[(xor(h, b) & 255) + 1]), 4294967295::BIGINT), 4294967295) AS h FROM named CROSS JOIN crc),
words AS (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, h % length(run)) || substr(run, h % length(run) + 2) ELSE run END AS word,
             sum(n)::BIGINT AS n FROM hashed GROUP BY 1 HAVING sum(n) >= 3),
w AS (SELECT * FROM words WHERE length(word) >= 5),
cut AS (SELECT word, n, i, substr(word, 1, i - 1) || substr(word, i + 1) AS rest
        FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM w)),
near AS (SELECT a.word, b.word AS near, b.n FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word <> b.word
         UNION SELECT a.word, b.word, b.n FROM cut a JOIN w b ON a.rest = b.word
         UNION SELECT b.word, a.word, a.n FROM cut a JOIN w b ON a.rest = b.word),
best AS (SELECT word, count(*) AS n_near, arg_min(near, (-n, near)) AS form, max(n) AS form_n FROM near GROUP BY word),
known AS (SELECT w.word, w.n, coalesce(n_near, 0) AS n_near, CASE WHEN form_n >= 2 * w.n THEN form END AS form,
             CASE WHEN form_n >= 2 * w.n THEN form_n END AS form_n FROM w LEFT JOIN best USING (word)),
chain AS (SELECT word, word AS place, 0 AS k FROM known
          UNION ALL SELECT c.word, x.form, k + 1 FROM chain c JOIN known x ON x.word = c.place WHERE x.form IS NOT NULL)
SELECT k.word, k.form, (SELECT arg_max(c.place, c.k) FROM chain c WHERE c.word = k.word) AS root, k.n,
       CAST(n_near AS BIGINT) AS n_near, form_n FROM known k"""

REPEATED_PASSAGES = r"""
WITH d AS (SELECT row_number() OVER () AS i, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
windows AS (SELECT i, s, sha256(array_to_string(w[s:s + 34], ' ')) AS h FROM (SELECT i, w, unnest(range(1, len(w) - 33)) AS s FROM d)),
often AS (SELECT h FROM windows GROUP BY h HAVING count(*) > 1),
gone AS (SELECT DISTINCT i, unnest(range(s, s + 35)) AS j FROM windows SEMI JOIN often USING (h)),
words AS (SELECT i, unnest(w) AS word, generate_subscripts(w, 1) AS j FROM d),
kept AS (SELECT i, string_agg(word, ' ' ORDER BY j) AS t, count(*) AS n FROM words ANTI JOIN gone USING (i, j) GROUP BY i)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n, 0) AS BIGINT) AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256 FROM d LEFT JOIN kept USING (i)"""
