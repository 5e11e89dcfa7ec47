"""DuckDB SQL for the queries of this subpackage that SQL can express."""

OP10 = """
WITH sized AS (
  SELECT doc_id, source, coalesce(CAST(doc_id AS VARCHAR), 'null:' || md5(coalesce(text, ''))) AS name, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size FROM documents
), per AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM sized GROUP BY source
), ranked AS (
  SELECT source, source_size, (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w, 3 * source_size AS cap FROM per
), levels AS (
  SELECT *, (sum(source_size) OVER () - coalesce(sum(cap) OVER (ORDER BY cap / w, w, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
    / sum(w) OVER (ORDER BY cap / w, w, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level FROM ranked
), lvl AS (
  SELECT arg_min(level, cap / w) AS level FROM levels WHERE level <= cap / w
), aim AS (
  SELECT source, source_size, CASE WHEN level IS NULL OR cap <= level * w THEN CAST(cap AS DOUBLE) ELSE level * w END AS target
  FROM ranked, lvl
), parts AS (
  SELECT source, source_size, target, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM aim
), placed AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole, p.target - p.whole * p.source_size AS extra,
    coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY md5('mix:' || s.name), s.size
      ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS passed
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source
)
SELECT doc_id, size, source_size, target, CAST(size * (whole + CASE WHEN 2 * passed + size < 2 * extra THEN 1 ELSE 0 END) AS BIGINT) AS taken FROM placed
"""

OP9 = """
WITH words AS (
  SELECT doc_id, row_number() OVER () AS row, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+') AS w FROM benchmark
), wins AS (
  SELECT item, least(len(w), 13) AS k, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(w[i : i + least(len(w), 13) - 1], ' '))) AS win
  FROM items WHERE len(w) > 0
), lens AS (SELECT DISTINCT k FROM wins),
slots AS (
  SELECT row, doc_id, k, unnest(range(1, len(w) - k + 2)) AS p, w FROM words, lens WHERE len(w) >= k
), hits AS (
  SELECT a.row, a.p, a.k, x.item FROM (SELECT row, p, k, array_to_string(w[p : p + k - 1], ' ') AS win FROM slots) a JOIN wins x ON a.k = x.k AND a.win = x.win
), covered AS (
  SELECT row, count(DISTINCT q) AS n_hit FROM (SELECT DISTINCT row, unnest(range(p, p + k)) AS q FROM hits) GROUP BY row
), named AS (
  SELECT row, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT row, item FROM hits) GROUP BY row
)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM words LEFT JOIN covered USING (row) LEFT JOIN named USING (row)
"""

OP8 = """
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents
), grams AS (
  SELECT doc_id, CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 4 THEN [array_to_string(w, ' ')]
    ELSE list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i : i + 3], ' '))) END AS g FROM words
), flat AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM grams),
pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM flat a JOIN flat b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))
), links AS (SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs),
reach(d, r) AS (
  SELECT doc_id, doc_id FROM grams UNION SELECT links.a, reach.r FROM reach JOIN links ON links.b = reach.d
)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, m.c AS component_id
FROM grams g JOIN (SELECT d, min(r) AS c FROM reach GROUP BY d) m ON g.doc_id = m.d
"""

OP7 = """
WITH turns AS (SELECT DISTINCT conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL),
chats AS (
  SELECT conv_id, list({r: coalesce('=' || role, 'null'), t: coalesce('=' || text, 'null')} ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS ts,
    string_agg('<|im_start|>' || coalesce(role, '') || chr(10) || coalesce(text, '') || '<|im_end|>' || chr(10), '' ORDER BY turn NULLS LAST, role NULLS FIRST, text NULLS FIRST) AS chat
  FROM turns GROUP BY conv_id
), inner_prefixes AS (
  SELECT DISTINCT ts[1 : n] AS pre FROM (SELECT ts, unnest(range(1, len(ts))) AS n FROM chats)
)
SELECT min(conv_id) AS conv_id, CAST(len(ts) AS BIGINT) AS n_turns, count(*) AS n_equal, arg_min(chat, conv_id) AS chat
FROM chats WHERE ts NOT IN (SELECT pre FROM inner_prefixes) GROUP BY ts
"""

OP4 = """
WITH split AS (SELECT coalesce(doc_id, 9223372036854775807) AS rank, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
lines AS (SELECT rank, ls, unnest(range(0, len(ls))) AS no FROM split),
sets AS (
  SELECT rank, no, list_sort(list_distinct(list_filter(string_split(ls[no + 1], ' '), lambda t: t != ''))) AS ts FROM lines
), ents AS (
  SELECT row_number() OVER (ORDER BY rank, no) AS ent, ts, rank, no FROM (SELECT ts, rank, no, row_number() OVER (PARTITION BY ts ORDER BY rank, no) AS k FROM sets WHERE len(ts) > 0) WHERE k = 1
), toks AS (SELECT ent, len(ts) AS n, unnest(ts) AS t FROM ents),
df AS (SELECT t, count(*) AS df FROM toks GROUP BY t),
pre AS (
  SELECT ent, n, t FROM (SELECT ent, n, t, row_number() OVER (PARTITION BY ent ORDER BY df, t) AS pos FROM toks JOIN df USING (t)) WHERE pos <= n - ceil(n * 80 / 100.0) + 1
), cand AS (
  SELECT DISTINCT a.ent AS a, b.ent AS b FROM pre a JOIN pre b ON a.t = b.t AND a.ent < b.ent AND least(a.n, b.n) * 100 >= greatest(a.n, b.n) * 80
), links AS (
  SELECT a, b FROM (SELECT a, b, x.ts AS p, y.ts AS q, len(list_intersect(x.ts, y.ts)) AS c FROM cand JOIN ents x ON x.ent = a JOIN ents y ON y.ent = b)
  WHERE c * 100 >= (len(p) + len(q) - c) * 80
), best AS (
  SELECT ent, min(first) AS first FROM (SELECT ent, ent AS first FROM ents UNION ALL SELECT b, a FROM links) GROUP BY ent
), gone AS (
  SELECT s.rank, s.no FROM sets s JOIN ents e ON s.ts = e.ts JOIN best USING (ent) JOIN ents f ON f.ent = best.first
  WHERE s.rank > f.rank OR (s.rank = f.rank AND s.no > f.no)
), lost AS (SELECT rank, list(DISTINCT no) AS nos FROM gone GROUP BY rank)
SELECT doc_id, CASE WHEN text IS NULL THEN 0 ELSE len(string_split(text, chr(10))) END AS n_lines, CASE WHEN text IS NULL THEN 0 ELSE coalesce(len(nos), 0) END AS n_removed,
  array_to_string([x for x, i in string_split(text, chr(10)) if NOT list_contains(coalesce(nos, []), i - 1)], chr(10)) AS text
FROM documents LEFT JOIN lost ON lost.rank = coalesce(doc_id, 9223372036854775807)
"""

ORACLES = {"op4_line_dedup": OP4, "op7_chat_collapse": OP7, "op8_ngram_jaccard": OP8, "op9_decontaminate": OP9, "op10_mix_sources": OP10}
