"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from foliant.llm.rules import RULES

# Words of a text as op1 reads them, and windows of ten of them.
OP1 = r"""
WITH fold AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents
), items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE item_id IS NOT NULL
), windows AS (
  SELECT DISTINCT item, least(len(w), 10) AS size, list_aggregate(w[i : i + least(len(w), 10) - 1], 'string_agg', ' ') AS win
  FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM items WHERE len(w) > 0)
), sizes AS (SELECT DISTINCT size FROM windows),
places AS (
  SELECT doc_id, size, i, list_aggregate(w[i : i + size - 1], 'string_agg', ' ') AS win
  FROM (SELECT doc_id, w, size, unnest(range(1, len(w) - size + 2)) AS i FROM fold, sizes WHERE len(w) >= size)
), found AS (SELECT p.doc_id, p.i, p.size, w.item FROM places p JOIN windows w ON w.win = p.win AND w.size = p.size),
hits AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest(range(i, i + size)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT f.doc_id, CAST(len(f.w) AS BIGINT) AS n_words, CAST(coalesce(h.n, 0) AS BIGINT) AS n_hit, CAST(coalesce(n.n, 0) AS BIGINT) AS n_items,
       sha256(coalesce(n.items, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM fold f LEFT JOIN hits h USING (doc_id) LEFT JOIN named n USING (doc_id)
"""

OP2 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents
), s AS (
  SELECT DISTINCT doc_id, list_aggregate(w[i : i + 3], 'string_agg', ' ') AS shingle FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 3) + 1)) AS i FROM w WHERE len(w) > 0)
), n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
shared AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.shingle = b.shingle AND a.doc_id <> b.doc_id GROUP BY ALL),
links AS (SELECT a, b FROM shared JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
reach AS (SELECT doc_id, doc_id AS r FROM documents UNION SELECT reach.doc_id, links.b FROM reach JOIN links ON links.a = reach.r)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, (SELECT min(r) FROM reach WHERE reach.doc_id = d.doc_id) AS component_id FROM documents d LEFT JOIN n USING (doc_id)
"""

OP7 = r"""
WITH p AS (
  SELECT page_id, html, (page_id % 999983) * 7919 % 104729 AS mark, coalesce(TRY_CAST(regexp_extract(url, '/([0-9]+)', 1) AS BIGINT), 0) AS number, url AS original FROM pages
), r AS (
  SELECT page_id AS record_id, mark % 3 = 0 AS revisit, regexp_replace(regexp_replace(regexp_replace(regexp_replace(trim(regexp_replace(original, '/[0-9]+', '/' || CAST(number % 20 AS VARCHAR), 'g')), '#.*$', ''), '^((?i:http)://[^/?]*):80([/?].*)?$', '\1\2'), '^((?i:https)://[^/?]*):443([/?].*)?$', '\1\2'), '^[A-Za-z][A-Za-z0-9+.-]*:(//)', '\1') AS u,
         CASE WHEN mark % 5 < 3 THEN CASE WHEN mark % 2 = 0 THEN 'W/' ELSE '' END || '"' || CAST(number % 4 + mark % 2 AS VARCHAR) || '"' END AS etag,
         CASE WHEN mark % 7 < 4 THEN CAST(number % 3 + mark % 2 AS VARCHAR) END AS modified,
         sha256(html) AS digest, CAST(octet_length(encode(html)) AS BIGINT) AS length FROM p
), parts AS (
  SELECT *, regexp_replace(lower(regexp_extract(u, '^//(?:[^/?@]*@)?([^/?]*)', 1)), '^(?:www\.|m\.)+', '') AS host, regexp_replace(u, '^//[^/?]*', '') AS rest FROM r
), cut AS (
  SELECT *, regexp_replace(CASE WHEN strpos(rest, '?') > 0 THEN rest[: strpos(rest, '?') - 1] ELSE rest END, '/+$', '') AS path,
         array_to_string(list_sort(list_filter(string_split(CASE WHEN strpos(rest, '?') > 0 THEN rest[strpos(rest, '?') + 1 :] ELSE '' END, '&'), lambda x: x <> '' AND NOT regexp_matches(x, '^(?i:(?:utm_[a-z]+|ref|fbclid|gclid|sessionid|sid))(?:=|$)'))), '&') AS query FROM parts
), c AS (SELECT *, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical FROM cut
), joined AS (
  SELECT *, last_value(CASE WHEN NOT revisit THEN struct_pack(id := record_id, etag := etag, modified := modified, digest := digest, length := length) END IGNORE NULLS)
              OVER (PARTITION BY canonical ORDER BY record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS s FROM c
), judged AS (
  SELECT *, CASE WHEN canonical IS NULL THEN 'no-url' WHEN s IS NULL THEN 'no-response' WHEN etag IS NULL AND modified IS NULL THEN 'no-validator'
                 WHEN etag IS NOT NULL AND replace(etag, 'W/', '') = replace(s.etag, 'W/', '') THEN 'etag' WHEN etag IS NULL AND modified = s.modified THEN 'last-modified' ELSE 'mismatch' END AS outcome
  FROM joined WHERE revisit
)
SELECT record_id, canonical, outcome, CASE WHEN ok THEN s.id END AS refers_to,
       CASE WHEN ok THEN array_to_string(list_filter(['content-type=text/html', 'date=' || CAST(record_id AS VARCHAR), 'etag=' || coalesce(etag, s.etag), 'last-modified=' || coalesce(modified, s.modified)], lambda x: x IS NOT NULL), ';') END AS headers,
       CASE WHEN ok THEN s.digest END AS digest, CASE WHEN ok THEN s.length END AS length
FROM (SELECT *, outcome IN ('etag', 'last-modified') AS ok FROM judged)
"""

# (number, rule, cutoff) of all steps, as the path of op5 is made from them.
_STEPS = ", ".join(f"({j}, '{rule}', {c!r}::DOUBLE)" for j, (rule, c) in enumerate((r, c) for r, ladder in RULES.items() for c in ladder))
# crc32 of the id as text, bit by bit.
_CRC = "xor(list_reduce([4294967295::BIGINT] || list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: ascii(x)::BIGINT), lambda a, b: list_reduce([xor(a, b)] || list_transform(range(8), lambda i: i::BIGINT), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END)), 4294967295::BIGINT)"
_STAT = " ".join(f"WHEN '{r}' THEN {r}" for r in RULES)

OP5 = rf"""
WITH t AS (
  SELECT doc_id, coalesce(lang, '') AS s, coalesce(text, '') AS text, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w,
         list_filter(string_split(coalesce(text, ''), chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS lines FROM documents
), win AS (SELECT doc_id, i, w[i : i + 2] AS three FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM t WHERE len(w) > 2)),
again AS (SELECT doc_id, i FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, three) AS n FROM win) WHERE n > 1),
rep AS (SELECT doc_id, count(DISTINCT pos) AS n FROM (SELECT doc_id, unnest([i, i + 1, i + 2]) AS pos FROM again) GROUP BY doc_id),
c AS (
  SELECT doc_id, s, text, len(w)::BIGINT AS n_words, coalesce(list_sum(list_transform(w, lambda x: length(x))), 0)::BIGINT AS word_chars, length(regexp_replace(text, '[^#*$%&|<>]', '', 'g'))::BIGINT AS n_symbols,
         (len(lines) - len(list_distinct(lines)))::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, len(lines) AS n_lines,
         length(regexp_replace(text, '[^A-Z]', '', 'g')) AS n_upper, length(regexp_replace(text, '[^A-Za-z]', '', 'g')) AS n_letters, len(list_filter(range(2, len(w) + 1), lambda i: w[i] = w[i - 1])) AS n_echo
  FROM t LEFT JOIN rep USING (doc_id)
), st AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols / word_chars ELSE 0 END AS symbol_share, CASE WHEN n_letters > 0 THEN n_upper / n_letters ELSE 0 END AS shout_share, CASE WHEN n_words > 0 THEN n_repeat_words / n_words ELSE 0 END AS repeat_share,
         CASE WHEN n_lines > 0 THEN n_dup_lines / n_lines ELSE 0 END AS dup_line_share, CASE WHEN n_words > 0 THEN word_chars / n_words ELSE 0 END AS word_length, CASE WHEN n_words > 0 THEN n_echo / n_words ELSE 0 END AS echo_share FROM c
), known AS (SELECT doc_id, min(quality) AS q FROM labels WHERE doc_id IS NOT NULL GROUP BY doc_id HAVING min(quality) = max(quality)),
one AS (SELECT min(doc_id) AS doc_id FROM st JOIN known USING (doc_id) WHERE NOT base_failed GROUP BY s, text HAVING min(q) = max(q)),
r AS (SELECT st.*, q, {_CRC} % 2 = 0 AS design FROM st JOIN known USING (doc_id) WHERE doc_id IN (SELECT doc_id FROM one)),
steps AS (SELECT * FROM (VALUES {_STEPS}) v(j, rule, cut)),
hit AS (SELECT r.doc_id, r.s, r.q, r.design, j, rule, cut, CASE rule {_STAT} END > cut AS rejects FROM r, steps),
sums AS (SELECT s, j, count(*) FILTER (rejects AND q = 1) AS good, count(*) FILTER (rejects AND q = 0) AS bad FROM hit WHERE design GROUP BY s, j),
path AS (SELECT s, j, row_number() OVER (PARTITION BY s ORDER BY good, bad DESC, j) AS pos FROM sums WHERE bad > 0),
caught AS (SELECT DISTINCT s, min(pos) OVER (PARTITION BY h.doc_id) AS pos FROM hit h JOIN path USING (s, j) WHERE design AND q = 0 AND rejects),
walk AS (SELECT s, j, row_number() OVER (PARTITION BY s ORDER BY pos) AS pos FROM path JOIN caught USING (s, pos)),
good AS (SELECT s, count(*) AS n FROM r WHERE NOT design AND q = 1 GROUP BY s),
first AS (SELECT s, h.doc_id, min(pos) AS pos FROM hit h JOIN walk USING (s, j) WHERE NOT design AND q = 1 AND rejects GROUP BY s, h.doc_id),
tested AS (SELECT s, j, pos, coalesce(n, 0) AS n, (SELECT count(*) FROM first f WHERE f.s = walk.s AND f.pos <= walk.pos) AS k FROM walk LEFT JOIN good USING (s)),
bound AS (SELECT *, n > 0 AND k <= 0.03 * n AND list_sum(list_transform(range(0, k + 1), lambda i: exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(0.03) + (n - i) * ln(0.97)))) <= 0.05 / (SELECT count(DISTINCT s) FROM r WHERE design) AS ok FROM tested),
cuts AS (SELECT b.s, rule, min(cut) AS cut FROM bound b JOIN steps USING (j) WHERE b.pos < coalesce((SELECT min(x.pos) FROM bound x WHERE x.s = b.s AND NOT x.ok), 1000) GROUP BY b.s, rule)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       NOT base_failed AND NOT EXISTS (SELECT 1 FROM cuts WHERE cuts.s = st.s AND CASE cuts.rule {_STAT.replace("THEN ", "THEN st.")} END > cuts.cut) AS kept FROM st
"""

OP11 = r"""
WITH t AS (SELECT doc_id, length(coalesce(text, '')) AS chars, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS norm FROM documents),
k AS (SELECT *, first_value(doc_id) OVER (PARTITION BY norm ORDER BY chars DESC, doc_id NULLS LAST) AS keep_id, max(chars) OVER (PARTITION BY norm) AS best, count(*) OVER (PARTITION BY norm) AS group_size FROM t)
SELECT doc_id, keep_id, group_size, chars = best AND doc_id IS NOT DISTINCT FROM keep_id AS kept, sha256(norm) AS text_sha256 FROM k
"""

# Words as op1 reads them; crc32 by a table of 256 entries, over the hex digits of the bytes; each different word once.
OP12 = r"""
WITH fold AS (
  SELECT 'd' AS side, row_number() OVER () AS r, doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) AS w FROM documents
  UNION ALL
  SELECT 'b', 0, NULL, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')) FROM benchmark
), crc AS (
  SELECT list(list_reduce([n] || list_transform(range(8), lambda i: i::BIGINT), lambda x, y: CASE WHEN x & 1 = 1 THEN xor(x >> 1, 3988292384::BIGINT) ELSE x >> 1 END) ORDER BY n) AS t FROM (SELECT unnest(range(256))::BIGINT AS n)
), distinct_words AS (SELECT DISTINCT w, hex(encode(w)) AS x FROM fold),
bucketed AS (
  SELECT w, xor(list_reduce([4294967295::BIGINT] || list_transform(range(1, length(x), 2), lambda i: (16 * (strpos('0123456789ABCDEF', x[i]) - 1) + strpos('0123456789ABCDEF', x[i + 1]) - 1)::BIGINT), lambda a, b: xor(a >> 8, t[xor(a, b) % 256 + 1])), 4294967295::BIGINT) % 10000 AS bucket FROM distinct_words, crc
), s AS (SELECT bucket, count(*) AS s FROM fold JOIN bucketed USING (w) WHERE side = 'd' GROUP BY bucket),
t AS (SELECT bucket, count(*) AS t FROM fold JOIN bucketed USING (w) WHERE side = 'b' GROUP BY bucket),
gains AS (
  SELECT bucket, floor(1000 * ln((coalesce(t, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(s), 0) FROM s) + 10000)::DOUBLE / ((coalesce(s, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(t), 0) FROM t) + 10000)::DOUBLE)))::BIGINT AS gain FROM s FULL JOIN t USING (bucket)
), sums AS (SELECT r, count(*) AS n, sum(gain)::BIGINT AS g FROM fold JOIN bucketed USING (w) JOIN gains USING (bucket) WHERE side = 'd' GROUP BY r),
scored AS (
  SELECT doc_id, coalesce(n, 0)::BIGINT AS n_features, coalesce((g - ((g % n) + n) % n) // n, 0)::BIGINT AS weight,
         ('0x' || substr(sha256('2024:' || CAST(doc_id AS VARCHAR)), 1, 8))::BIGINT AS h
  FROM (SELECT row_number() OVER () AS r, doc_id FROM documents) d LEFT JOIN sums USING (r)
), placed AS (SELECT *, weight + floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE)))::BIGINT AS score FROM scored),
ranked AS (SELECT *, n_features >= 20 AS able, row_number() OVER (PARTITION BY n_features >= 20 ORDER BY score DESC, doc_id) AS place FROM placed)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= (SELECT 10 * count(*) // 100 FROM ranked WHERE able) THEN place END AS rank FROM ranked
"""

ORACLE = {"op1_decontaminate": OP1, "op2_jaccard": OP2, "op5_rules": OP5, "op7_revisits": OP7, "op11_exact": OP11, "op12_resample": OP12}
