"""DuckDB SQL of the queries that SQL can express over whole tables."""

from __future__ import annotations

from .licenses import PHRASES, TEMPLATES, THRESHOLD

SQL: dict[str, str] = {}

SQL["op1_decontaminate"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
      '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark
), windows AS (
  SELECT DISTINCT item_id, len(w[i:i + 9]) AS n, array_to_string(w[i:i + 9], ' ') AS win
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT n FROM windows),
places AS (
  SELECT d.rid, s.n, p.i, array_to_string(d.w[p.i:p.i + s.n - 1], ' ') AS win
  FROM docs d, sizes s, LATERAL (SELECT unnest(range(1, len(d.w) - s.n + 2)) AS i) p
), hits AS (
  SELECT p.rid, p.i, p.n, w.item_id FROM places p JOIN windows w ON w.win = p.win AND w.n = p.n
), words AS (
  SELECT rid, count(DISTINCT k) AS n_hit FROM (SELECT rid, unnest(range(i, i + n)) AS k FROM hits) GROUP BY rid
), found AS (
  SELECT rid, count(DISTINCT item_id) AS n_items, string_agg(DISTINCT item_id, ',' ORDER BY item_id) AS ids FROM hits GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(w.n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(f.n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(f.ids, '')) AS items_sha256,
  coalesce(w.n_hit, 0) > 0 AS contaminated
FROM docs d LEFT JOIN words w USING (rid) LEFT JOIN found f USING (rid)
"""

SQL["op6_mixing"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, source,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size,
    CAST('0x' || substr(md5(coalesce(CAST(doc_id AS VARCHAR), md5(coalesce(text, '')))), 1, 15) AS BIGINT) AS key
  FROM documents
), sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM docs GROUP BY source
), filled AS (
  SELECT *, 3 * size / w AS ratio,
    CAST((SELECT sum(size) FROM sources) AS BIGINT) - CAST(coalesce(sum(3 * size) OVER o, 0) AS BIGINT) AS rest,
    (SELECT sum(w) FROM sources) - coalesce(sum(w) OVER o, 0) AS weight
  FROM sources
  WINDOW o AS (ORDER BY 3 * size / w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
), level AS (
  SELECT CAST(rest AS DOUBLE) / CAST(weight AS DOUBLE) AS lvl FROM filled
  WHERE CAST(rest AS DOUBLE) / CAST(weight AS DOUBLE) * w <= 3 * size ORDER BY ratio, source NULLS LAST LIMIT 1
), targets AS (
  SELECT source, size, CASE WHEN lvl * w <= 3 * size THEN lvl * w ELSE CAST(3 * size AS DOUBLE) END AS target
  FROM sources, level
), line AS (
  SELECT d.rid, d.doc_id, d.size, t.size AS source_size, t.target, CAST(floor(t.target + 0.5) AS BIGINT) AS wanted,
    CAST(coalesce(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.key, d.doc_id, d.size, d.rid
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS start
  FROM docs d JOIN targets t ON d.source IS NOT DISTINCT FROM t.source
)
SELECT doc_id, size, source_size, target,
  CASE WHEN size = 0 THEN 0 ELSE (wanted // source_size) * size
    + greatest(0, least(size, wanted % source_size - start)) END AS taken
FROM line
"""

_PHRASE_ROWS = ", ".join(f"({p.split()!r}, '{label}')" for p, label in PHRASES)
_TEMPLATE_ROWS = ", ".join(f"({sorted(set(t.replace('.', ' ').split()))!r}, '{label}')" for t, label in TEMPLATES)

SQL["op7_licenses"] = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents
), tokens AS (
  SELECT rid, doc_id, t, regexp_extract_all(t, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM docs
), phrases AS (SELECT * FROM (VALUES {_PHRASE_ROWS}) p(p, label)
), templates AS (SELECT * FROM (VALUES {_TEMPLATE_ROWS}) p(words, label)
), places AS (
  SELECT rid, label, i - 1 AS start FROM
    (SELECT rid, w, label, p, unnest(range(1, len(w) - len(p) + 2)) AS i FROM tokens, phrases WHERE list_has_all(w, p))
  WHERE w[i:i + len(p) - 1] = p
), base AS (
  SELECT rid, count(*) AS n, min(start) AS first_word, max(start) AS last_word FROM places GROUP BY rid
), blocks AS (
  SELECT rid, list_distinct(regexp_extract_all(line, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w
  FROM (SELECT rid, unnest(string_split(t, chr(10))) AS line FROM docs)
), matches AS (
  SELECT rid, label, CAST(len(list_intersect(b.w, x.words)) AS DOUBLE) / len(x.words) AS containment
  FROM blocks b, templates x WHERE len(list_intersect(b.w, x.words)) >= ceil({THRESHOLD} * len(x.words) - 1e-9)
), best AS (SELECT rid, max(containment) AS c FROM matches GROUP BY rid
), all_labels AS (
  SELECT rid, string_agg(DISTINCT label, ',' ORDER BY label) FILTER (WHERE own) AS base_labels,
    string_agg(DISTINCT label, ',' ORDER BY label) AS labels
  FROM (SELECT rid, label, TRUE AS own FROM places UNION ALL SELECT rid, label, FALSE FROM matches) GROUP BY rid
)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(b.n, 0) AS BIGINT) AS n_base,
  CAST(b.first_word AS BIGINT) AS first_word, CAST(b.last_word AS BIGINT) AS last_word,
  coalesce(l.base_labels, '') AS base_labels, coalesce(l.labels, '') AS labels,
  CASE WHEN b.n > 0 THEN 1.0::DOUBLE ELSE coalesce(m.c, 0.0::DOUBLE) END AS score
FROM tokens d LEFT JOIN base b USING (rid) LEFT JOIN all_labels l USING (rid) LEFT JOIN best m USING (rid)
"""

SQL["op9_nearest"] = r"""
WITH usable AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
), pairs AS (
  SELECT q.vec_id AS query_id, c.vec_id,
    sqrt(list_reduce(list_transform(list_zip(q.v, c.v), lambda p: (p[2] - p[1]) * (p[2] - p[1])), lambda a, b: a + b)) AS score
  FROM usable q JOIN usable c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0
)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score, vec_id) AS INTEGER) AS rank, vec_id, score
FROM pairs QUALIFY rank <= 10
"""

SQL["op10_ngram_join"] = r"""
WITH RECURSIVE docs AS (
  SELECT row_number() OVER () AS rid, doc_id,
    regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), members AS (
  SELECT DISTINCT rid, hash(array_to_string(w[i:i + 2], ' ')) AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS i FROM docs WHERE len(w) > 0)
), sizes AS (SELECT rid, count(*) AS n FROM members GROUP BY rid
), shared AS (
  SELECT a.rid AS a, b.rid AS b, count(*) AS i FROM members a JOIN members b ON a.s = b.s AND a.rid <> b.rid GROUP BY ALL
), links AS (
  SELECT a, b, i, x.n AS na, y.n AS nb FROM shared JOIN sizes x ON x.rid = a JOIN sizes y ON y.rid = b
  WHERE 100 * i >= 90 * (x.n + y.n - i)
), classes AS (
  SELECT rid, least(rid, coalesce((SELECT min(b) FROM links WHERE a = rid AND i = na AND i = nb), rid)) AS class FROM docs
), degrees AS (
  SELECT x.rid, count(DISTINCT y.class) AS n_links FROM links JOIN classes x ON x.rid = a JOIN classes y ON y.rid = b
  WHERE x.class <> y.class GROUP BY x.rid
), reach AS (
  SELECT rid, rid AS r FROM docs UNION SELECT reach.rid, links.b FROM reach JOIN links ON links.a = reach.r
), least_id AS (SELECT reach.rid, min(d.doc_id) AS c FROM reach JOIN docs d ON d.rid = r GROUP BY reach.rid)
SELECT d.doc_id, CAST(coalesce(s.n, 0) AS BIGINT) AS n_shingles, c AS component_id, CAST(coalesce(n_links, 0) AS BIGINT) AS n_links
FROM docs d JOIN least_id USING (rid) LEFT JOIN sizes s USING (rid) LEFT JOIN degrees USING (rid)
"""

SQL["op5_substrings"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT rid, doc_id, i, array_to_string(w[i:i + 12], ' ') AS win
  FROM (SELECT rid, doc_id, w, unnest(range(1, len(w) - 12 + 1)) AS i FROM docs)
), repeats AS (
  SELECT rid, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY win) AS least FROM windows) WHERE least < doc_id
), removed AS (SELECT DISTINCT rid, unnest(range(i, i + 13)) AS k FROM repeats
), gone AS (SELECT rid, list(k) AS ks, count(*) AS n FROM removed GROUP BY rid)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n, 0) AS BIGINT) AS n_removed,
  sha256(array_to_string(CASE WHEN n IS NULL THEN w ELSE list_filter(w, lambda x, k: NOT list_contains(ks, k)) END, ' ')) AS kept_sha256
FROM docs LEFT JOIN gone USING (rid)
"""

SQL["op11_importance"] = r"""
WITH RECURSIVE both_tables AS (
  SELECT row_number() OVER () AS rid, TRUE AS own, doc_id, text FROM documents
  UNION ALL SELECT -row_number() OVER (), FALSE, NULL, text FROM benchmark
), texts AS (
  SELECT rid, own, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM both_tables
), words AS (SELECT rid, own, unnest(w) AS word FROM texts),
crcs AS (
  SELECT word, hex(encode(word)) AS h, 0 AS k, CAST(4294967295 AS BIGINT) AS c FROM (SELECT DISTINCT word FROM words)
  UNION ALL
  SELECT word, h, k + 1, list_reduce([xor(c, CAST('0x' || substr(h, 2 * k + 1, 2) AS BIGINT)), 0, 0, 0, 0, 0, 0, 0, 0],
    lambda x, y: xor(x >> 1, (x & 1) * 3988292384))
  FROM crcs WHERE 2 * k < length(h)
), buckets AS (SELECT word, CAST(xor(c, 4294967295) % 10000 AS BIGINT) AS b FROM crcs WHERE 2 * k = length(h)),
counts AS (
  SELECT b, CAST(count(*) FILTER (WHERE own) AS DOUBLE) AS s, CAST(count(*) FILTER (WHERE NOT own) AS DOUBLE) AS t
  FROM words JOIN buckets USING (word) GROUP BY b
), sums AS (SELECT sum(s) AS ss, sum(t) AS tt FROM counts),
gains AS (
  SELECT b, CAST(floor(1000 * ln((t + 1) * (ss + 10000) / ((s + 1) * (tt + 10000)))) AS BIGINT) AS gain FROM counts, sums
), weights AS (
  SELECT rid, CAST(floor(CAST(sum(gain) AS DOUBLE) / count(*)) AS BIGINT) AS weight
  FROM words JOIN buckets USING (word) JOIN gains USING (b) WHERE own GROUP BY rid
), scored AS (
  SELECT rid, doc_id, CAST(len(w) AS BIGINT) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weights USING (rid) WHERE own
), ranked AS (
  SELECT rid, row_number() OVER (ORDER BY score DESC, doc_id NULLS LAST, n_features) AS place, count(*) OVER () AS many
  FROM scored WHERE n_features >= 20
)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN place <= many * 10 // 100 THEN place END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (rid)
"""

SQL["op13_exact_dedup"] = r"""
WITH docs AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') AS body FROM documents
)
SELECT doc_id, first_value(doc_id) OVER w AS keep_id, count(*) OVER (PARTITION BY body) AS group_size,
  row_number() OVER w = 1 AS kept, sha256(body) AS text_sha256
FROM docs WINDOW w AS (PARTITION BY body ORDER BY doc_id NULLS LAST, rid)
"""
