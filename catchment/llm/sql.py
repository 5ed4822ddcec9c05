"""DuckDB SQL for the queries that SQL expresses."""

_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

URL_FILTERS = f"""
WITH urls AS (
  SELECT row_number() OVER () AS rid, page_id,
         coalesce(translate(regexp_extract(url, '://([^/?#]*)', 1), '{_UPPER}', '{_LOWER}'), '') AS host,
         coalesce(regexp_extract(url, '://[^/?#]*([^?#]*)', 1), '') AS path
  FROM pages
), rules(verdict, rule, rh, rp) AS (
  VALUES ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
         ('allow', 'www.example.com/en/', 'www.example.com', '/en/'),
         ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')
), fits AS (
  SELECT rid, arg_max(rule, length(rule)) AS rule, arg_max(verdict, length(rule)) AS verdict
  FROM urls JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp)
  GROUP BY rid
)
SELECT page_id, host, path, rule, coalesce(verdict, 'allow') AS verdict
FROM urls LEFT JOIN fits USING (rid)
"""

LINE_DEDUP = f"""
WITH docs AS (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
split AS (SELECT rid, doc_id, string_split(text, chr(10)) AS ls FROM docs),
lines AS (
  SELECT rid, doc_id, unnest(ls) AS line, unnest(range(len(ls))) AS pos FROM split
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), '{_UPPER}', '{_LOWER}') AS k
  FROM lines
), common AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 40 GROUP BY k HAVING count(DISTINCT doc_id) >= 5
), marked AS (
  SELECT rid, doc_id, pos, line, common.k IS NOT NULL AND doc_id <> keeper AS dropped FROM keyed LEFT JOIN common USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE dropped) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT dropped), '')) AS kept_sha256
FROM marked GROUP BY rid
"""

_WORDS = f"regexp_extract_all(translate(coalesce(text, ''), '{_UPPER}', '{_LOWER}'), '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"

DECONTAMINATION = f"""
WITH items AS (
  SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS ws FROM benchmark
), windows AS (
  SELECT DISTINCT item, least(10, len(ws)) AS size, unnest([array_to_string(ws[s + 1 : s + least(10, len(ws))], ' ')
         FOR s IN range(greatest(1, len(ws) - 9))]) AS phrase
  FROM items WHERE len(ws) > 0
), docs AS (
  SELECT row_number() OVER () AS rid, doc_id, {_WORDS} AS ws FROM documents
), sizes AS (SELECT DISTINCT size FROM windows
), grams AS (
  SELECT rid, size, unnest(range(len(ws) - size + 1)) AS s,
         unnest([array_to_string(ws[s + 1 : s + size], ' ') FOR s IN range(len(ws) - size + 1)]) AS phrase
  FROM docs JOIN sizes ON len(ws) >= size
), hits AS (
  SELECT rid, item, s, size FROM grams JOIN windows USING (size, phrase)
), hit_words AS (
  SELECT rid, count(DISTINCT w) AS n FROM (SELECT rid, unnest(range(s, s + size)) AS w FROM hits) GROUP BY rid
), hit_items AS (
  SELECT rid, count(*) AS n, string_agg(item, ',' ORDER BY item) AS names
  FROM (SELECT DISTINCT rid, item FROM hits) GROUP BY rid
)
SELECT doc_id, CAST(len(ws) AS BIGINT) AS n_words, coalesce(hit_words.n, 0) AS n_hit, coalesce(hit_items.n, 0) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(hit_words.n, 0) > 0 AS contaminated
FROM docs LEFT JOIN hit_words USING (rid) LEFT JOIN hit_items USING (rid)
"""

# CRC-32 of a decimal id, byte by byte over the table of the polynomial.
_CRC_TABLE = """crc_table AS (
  SELECT list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
         lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY n) AS t
  FROM (SELECT range AS n FROM range(256))
)"""
_CRC = """xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, [ascii(x)::BIGINT FOR x IN string_split({0}, '')]),
         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])))"""

PREFIX_TRIE = f"""
WITH {_CRC_TABLE}, turns AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos,
         coalesce(role, '') AS role, coalesce(text, '') AS text
  FROM conversations WHERE conv_id IS NOT NULL
), convs AS (
  SELECT conv_id, conv_id - conv_id % 100 AS base, {_CRC.format("CAST(conv_id AS VARCHAR)")} % 6 AS h
  FROM (SELECT DISTINCT conv_id FROM turns), crc_table
), rebuilt AS (
  SELECT c.conv_id, 0 AS part, pos, role, text FROM convs c JOIN turns b ON b.conv_id = c.base WHERE pos < h
  UNION ALL SELECT c.conv_id, 1, pos, role, text FROM convs c JOIN turns o ON o.conv_id = c.conv_id WHERE pos >= h
), placed AS (
  SELECT conv_id, row_number() OVER w AS depth, sha256(role || chr(0) || text) AS turn, text FROM rebuilt
  WINDOW w AS (PARTITION BY conv_id ORDER BY part, pos)
), prefixes AS (
  SELECT conv_id, depth, sha256(string_agg(turn, '') OVER (PARTITION BY conv_id ORDER BY depth)) AS k, text FROM placed
  UNION ALL SELECT conv_id, 0, '', '' FROM convs
), sizes AS (SELECT conv_id, max(depth) AS size FROM prefixes GROUP BY conv_id
), nodes AS (
  SELECT depth, k, min(p.conv_id) AS conv_id, count(*) AS n_convs, any_value(text) AS text,
         sha256(coalesce(string_agg(CAST(p.conv_id AS VARCHAR), ',' ORDER BY p.conv_id) FILTER (WHERE size = depth), '')) AS ends_sha256
  FROM prefixes p JOIN sizes USING (conv_id) GROUP BY depth, k
), parents AS (
  SELECT n.depth, n.k, n.conv_id, q.conv_id AS parent_conv_id
  FROM nodes n JOIN prefixes p ON p.conv_id = n.conv_id AND p.depth = n.depth - 1 JOIN nodes q ON q.depth = p.depth AND q.k = p.k
), children AS (
  SELECT parent_conv_id AS conv_id, depth - 1 AS depth, count(*) AS n_children FROM parents GROUP BY ALL
), subtrees AS (
  SELECT a.depth, a.k, count(*) FILTER (WHERE n_children IS NULL) AS n_leaves,
         CAST(sum((n.n_convs - 1) * length(n.text)) AS BIGINT) AS saved_tokens
  FROM nodes n JOIN prefixes a ON a.conv_id = n.conv_id AND a.depth <= n.depth
  LEFT JOIN children c ON c.conv_id = n.conv_id AND c.depth = n.depth GROUP BY a.depth, a.k
)
SELECT n.conv_id, n.depth, parent_conv_id, n_convs, coalesce(n_children, 0) AS n_children, n_leaves, saved_tokens, ends_sha256
FROM nodes n JOIN subtrees s ON s.depth = n.depth AND s.k = n.k
LEFT JOIN parents p ON p.depth = n.depth AND p.k = n.k
LEFT JOIN children c ON c.conv_id = n.conv_id AND c.depth = n.depth
"""

WARC_ARCHIVES = """
WITH payloads AS (
  SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest,
         row_number() OVER (PARTITION BY coalesce(html, '') ORDER BY page_id DESC NULLS LAST) AS k,
         max(page_id) OVER (PARTITION BY coalesce(html, '')) AS response
  FROM pages
)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND k > 1 THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND k > 1 THEN response END AS refers_to
FROM payloads
"""
