"""DuckDB SQL of the queries that SQL can express."""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         coalesce(md5(doc_id::VARCHAR), '') AS h
  FROM documents),
s AS (
  SELECT source, sum(size)::BIGINT AS source_size, 3 * sum(size)::BIGINT AS cap,
         (row_number() OVER (ORDER BY source IS NULL, source) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
o AS (
  SELECT *, row_number() OVER (ORDER BY cap / w, source IS NULL, source) AS k FROM s),
level AS (
  SELECT a.k, (SELECT sum(source_size) FROM s)::BIGINT AS total,
         coalesce(sum(b.cap) FILTER (b.k < a.k), 0)::BIGINT AS below, sum(b.w) FILTER (b.k >= a.k)::BIGINT AS weights,
         any_value(a.w) AS w, any_value(a.cap) AS cap
  FROM o a, o b GROUP BY a.k),
water AS (
  SELECT k, (total - below) / weights AS lam FROM level WHERE (total - below) / weights * w <= cap ORDER BY k LIMIT 1),
t AS (
  SELECT o.source, o.source_size, o.w,
         CASE WHEN o.k < water.k THEN o.cap::DOUBLE ELSE least(water.lam * o.w, o.cap::DOUBLE) END AS target
  FROM o, water),
r AS (
  SELECT d.doc_id, d.size, t.source_size, t.target, (CASE t.w WHEN 2 THEN 2 ELSE 1.5 END)::DOUBLE AS w0, (CASE t.w WHEN 1 THEN 0.5 WHEN 2 THEN 2 ELSE 4.5 END)::DOUBLE AS w1,
         coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h, d.doc_id, d.size
                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS reached
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
u AS (
  SELECT *, CASE WHEN size = 0 THEN 0 ELSE
          (2 * reached + size <= 2 * target)::INT + (2 * (source_size + reached) + size <= 2 * target)::INT
        + (2 * (2 * source_size + reached) + size <= 2 * target)::INT END AS repeats,
         (w0 + w1) / 2 * least(reached / target, 1.0) AS due
  FROM r)
SELECT doc_id, size, source_size, target, (size * repeats)::BIGINT AS taken, repeats::INT AS repeats,
       CASE WHEN repeats > 0 THEN round(least(2 * due / (w0 + sqrt(w0 * w0 + 2 * (w1 - w0) * due)), 1.0), 9) END AS position
FROM u
"""

OP5 = r"""
WITH words AS (
  SELECT doc_id, row_number() OVER () AS rid,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
items AS (
  SELECT item_id::VARCHAR AS item,
         regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                            '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE item_id IS NOT NULL AND text IS NOT NULL),
windows AS (
  SELECT DISTINCT item, least(len(w), 13) AS n, array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' ') AS s
  FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM items WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT rid, i, n, array_to_string(list_slice(w, i, i + n - 1), ' ') AS s
  FROM (SELECT rid, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM words, sizes WHERE len(w) >= n)),
found AS (SELECT DISTINCT p.rid, p.i, p.n, v.item FROM places p JOIN windows v USING (n, s)),
hits AS (SELECT rid, count(DISTINCT pos) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS pos FROM found) GROUP BY rid),
named AS (SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS names
          FROM (SELECT DISTINCT rid, item FROM found) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(names, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN hits USING (rid) LEFT JOIN named USING (rid)
"""

OP4 = r"""
WITH p AS (
  SELECT page_id, coalesce(html, '') AS html, sha1(coalesce(html, '')) AS hex FROM pages),
g AS (SELECT html, min(page_id) AS first_id FROM p GROUP BY html),
bits AS (
  SELECT DISTINCT hex, array_to_string(list_transform(range(1, 41), lambda i: ['0000', '0001', '0010', '0011', '0100', '0101', '0110',
         '0111', '1000', '1001', '1010', '1011', '1100', '1101', '1110', '1111'][strpos('0123456789abcdef', substr(hex, i, 1))]), '') AS b
  FROM p),
names AS (
  SELECT hex, array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         (16 * substr(b, 5 * i + 1, 1)::INT + 8 * substr(b, 5 * i + 2, 1)::INT + 4 * substr(b, 5 * i + 3, 1)::INT
          + 2 * substr(b, 5 * i + 4, 1)::INT + substr(b, 5 * i + 5, 1)::INT + 1)::INT, 1)), '') AS name
  FROM bits)
SELECT page_id, strlen(html)::BIGINT AS payload_bytes, name AS payload_digest,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN 'response' ELSE 'revisit' END AS record_type,
       CASE WHEN first_id IS NULL OR page_id = first_id THEN NULL ELSE first_id END AS refers_to
FROM p JOIN g USING (html) JOIN names USING (hex)
"""

OP7 = r"""
WITH d AS (
  SELECT row_number() OVER () AS rid, doc_id, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
windows AS (
  SELECT rid, i, list_slice(w, i, i + 2) AS s FROM (SELECT rid, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) >= 3)),
often AS (SELECT rid, i FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, s) AS n FROM windows) WHERE n > 1),
repeats AS (SELECT rid, count(DISTINCT pos) AS n FROM (SELECT rid, unnest(range(i, i + 3)) AS pos FROM often) GROUP BY rid),
lines AS (
  SELECT rid, count(*) - count(DISTINCT line) AS n
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM d) WHERE regexp_matches(line, '[^\x20\x09-\x0D]') GROUP BY rid),
m AS (
  SELECT doc_id, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
         length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols, coalesce(lines.n, 0)::BIGINT AS n_dup_lines,
         coalesce(repeats.n, 0)::BIGINT AS n_repeat_words
  FROM d LEFT JOIN lines USING (rid) LEFT JOIN repeats USING (rid)),
j AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed FROM m),
h AS (SELECT source, count(*)::DOUBLE AS n, count(*) FILTER (base_failed)::DOUBLE AS x FROM j GROUP BY source),
s AS (SELECT sum(n) AS n, sum(x) AS x, sum(n * n) AS nn, sum(x * x / n) AS xx, count(*) AS k, sum(x) / sum(n) AS p FROM h),
c AS (
  SELECT p, CASE WHEN p * (1 - p) * (n - nn / n - (k - 1)) > 0
                 THEN (xx - n * p * p - (k - 1) * p * (1 - p)) / (p * (1 - p) * (n - nn / n - (k - 1))) ELSE 0.0 END AS like_each FROM s),
prior AS (SELECT p, 1 / least(greatest(like_each, 1e-6), 1.0) - 1 AS strength FROM c),
v AS (SELECT source, (x + p * strength) / (n + strength) AS rate FROM h, prior)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, round(rate, 10) AS host_rate, rate > 0.5 AS host_failed,
       NOT base_failed AND NOT rate > 0.5 AS kept
FROM j JOIN v ON j.source IS NOT DISTINCT FROM v.source
"""

OP11 = r"""
WITH v AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
         list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e
  FROM embeddings
  WHERE vec_id IS NOT NULL AND label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (
  SELECT a.vec_id AS anchor_id, b.vec_id AS vec_id, a.label = b.label AS same, list_inner_product(a.e, b.e)::BIGINT AS score
  FROM v a, v b WHERE a.vec_id % 50 = 0),
p AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM s WHERE same AND vec_id <> anchor_id
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5)
SELECT p.anchor_id, positive_id, (row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id))::INT AS rank,
       vec_id AS negative_id, positive_score, score AS negative_score
FROM p JOIN s ON s.anchor_id = p.anchor_id AND NOT same AND 50 * positive_score <= 100 * score AND 100 * score <= 95 * positive_score
QUALIFY row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY score DESC, vec_id) <= 3
"""

OP12 = r"""
WITH RECURSIVE
tab AS (
  SELECT list_transform(range(256), lambda x: list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1
         THEN xor(c >> 1, 3988292384::BIGINT) ELSE c >> 1 END, x::BIGINT)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id,
               unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                         '[a-z\x{C0}-\x{FF}]+')) AS run FROM documents)
  WHERE len(run) >= 5 GROUP BY ALL),
coded AS (
  SELECT run, n, list_transform(range(1, strlen(doc_id || ':' || run) + 1),
         lambda i: ('0x' || substr(hex(doc_id || ':' || run), 2 * i - 1, 2))::BIGINT) AS b FROM runs),
hashed AS (
  SELECT run, n, xor(list_reduce(b, lambda c, x: xor(c >> 8, t[xor(c & 255, x) + 1]), 4294967295::BIGINT), 4294967295::BIGINT) AS h
  FROM coded, tab),
words AS (
  SELECT w AS word, sum(n)::BIGINT AS n
  FROM (SELECT CASE WHEN h % 97 = 0 THEN substr(run, 1, (h % len(run))::INT) || substr(run, (h % len(run))::INT + 2) ELSE run END AS w, n
        FROM hashed)
  WHERE len(w) >= 5 GROUP BY w HAVING sum(n) >= 3),
holes AS (
  SELECT DISTINCT word, n, substr(word, 1, i - 1) AS a, substr(word, i + 1) AS b
  FROM (SELECT word, n, unnest(range(1, len(word) + 1)) AS i FROM words)),
near AS (
  SELECT x.word, y.word AS other, y.n AS m FROM holes x JOIN holes y USING (a, b) WHERE x.word <> y.word
  UNION SELECT x.word, y.word, y.n FROM holes x JOIN words y ON y.word = x.a || x.b
  UNION SELECT y.word, x.word, x.n FROM holes x JOIN words y ON y.word = x.a || x.b),
best AS (
  SELECT word, count(*) OVER (PARTITION BY word) AS n_near, m AS top, other FROM near
  QUALIFY row_number() OVER (PARTITION BY word ORDER BY m DESC, other) = 1),
f AS (
  SELECT words.word, n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN top >= 2 * n THEN other END AS form,
         CASE WHEN top >= 2 * n THEN top END::BIGINT AS form_n
  FROM words LEFT JOIN best ON words.word = best.word),
walk AS (
  SELECT word, word AS root FROM f WHERE form IS NULL
  UNION ALL SELECT f.word, walk.root FROM f JOIN walk ON f.form = walk.word)
SELECT f.word, form, root, n, n_near, form_n FROM f JOIN walk ON f.word = walk.word
"""

ORACLE: dict[str, str] = {"op4_warc": OP4, "op5_decontamination": OP5, "op7_quality_rules": OP7, "op9_mixing": OP9,
                          "op11_hard_negatives": OP11, "op12_spelling_variants": OP12}
