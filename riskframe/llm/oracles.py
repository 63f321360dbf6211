"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

_NEAR = rf"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                    '[^\x20\x09-\x0D]+') AS ws FROM documents),
s AS (
  SELECT doc_id, list_distinct(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END) AS sh FROM w),
one AS (SELECT sh, min(doc_id) AS rep, len(sh) AS n FROM (SELECT doc_id, list_sort(sh) AS sh FROM s) WHERE len(sh) > 0 GROUP BY sh),
e AS (SELECT rep, n, unnest(sh) AS x FROM one),
l AS (SELECT a.rep AS a, b.rep AS b FROM e a JOIN e b ON a.x = b.x AND a.rep <> b.rep GROUP BY a.rep, b.rep, a.n, b.n
      HAVING 100 * count(*) >= 75 * (a.n + b.n - count(*))),
r(node, seen) AS (SELECT rep, rep FROM one UNION SELECT r.node, l.b FROM r JOIN l ON l.a = r.seen),
c AS (SELECT node, min(seen) AS component FROM r GROUP BY node),
d AS (SELECT one.sh, c.component FROM one JOIN c ON c.node = one.rep)
SELECT s.doc_id, len(s.sh) AS n_shingles, coalesce(d.component, s.doc_id) AS component_id,
       coalesce(d.component, s.doc_id) = s.doc_id AS kept
FROM s LEFT JOIN d ON d.sh = list_sort(s.sh)"""

_PAGES = """
WITH p AS (SELECT page_id, coalesce(html, '') AS body FROM pages),
d AS (SELECT page_id, strlen(body) AS payload_bytes, sha1(body) AS payload_digest FROM p),
m AS (SELECT *, max(page_id) OVER (PARTITION BY payload_digest, payload_bytes) AS kept FROM d)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, payload_digest,
       CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 1000 AND kept <> page_id THEN kept END AS refers_to, url
FROM m JOIN pages USING (page_id)"""

_TRIE = """
WITH turns AS (
  SELECT conv_id, list({'r': coalesce(role, ''), 't': coalesce(text, '')} ORDER BY turn NULLS FIRST,
      md5(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS own
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
-- crc32 bit by bit: a byte is mixed in, then eight steps follow
steps AS (
  SELECT conv_id, own, flatten(list_transform(string_split(CAST(conv_id AS VARCHAR), ''),
      lambda c: [CAST(ascii(c) AS BIGINT), -1, -1, -1, -1, -1, -1, -1, -1])) AS ops FROM turns),
heads AS (
  SELECT conv_id, own, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), ops), lambda a, o:
      CASE WHEN o >= 0 THEN xor(a, o) WHEN a & 1 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END), 4294967295) % 9 AS h FROM steps),
built AS (
  SELECT c.conv_id, list_concat(CASE WHEN h > 0 THEN coalesce(b.own[1:h], []) ELSE [] END, c.own[h + 1:]) AS whole
  FROM heads c LEFT JOIN turns b ON b.conv_id = c.conv_id - c.conv_id % 5),
prefixes AS (SELECT conv_id, len(whole) AS size, unnest(range(0, len(whole) + 1)) AS depth, whole FROM built),
nodes AS (
  SELECT whole[1:depth] AS path, depth, min(conv_id) AS conv_id, count(*) AS n_convs,
         string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE size = depth) AS ends
  FROM (SELECT conv_id, size, depth, CASE WHEN depth > 0 THEN whole ELSE [] END AS whole FROM prefixes) GROUP BY ALL),
children AS (SELECT path[1:depth - 1] AS path, depth - 1 AS depth, count(*) AS n FROM
  (SELECT CASE WHEN depth > 1 THEN path ELSE [] END AS path, depth FROM nodes WHERE depth > 0) GROUP BY ALL),
full_nodes AS (
  SELECT n.*, coalesce(c.n, 0) AS n_children, (n_convs - 1) * CASE WHEN n.depth = 0 THEN 0 ELSE strlen(n.path[n.depth].t) END AS saved
  FROM nodes n LEFT JOIN children c USING (path, depth)),
upward AS (
  SELECT CASE WHEN up > 0 THEN path[1:up] ELSE [] END AS path, up AS depth, sum(saved) AS saved, count(*) FILTER (WHERE n_children = 0) AS leaves
  FROM (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS up FROM full_nodes) GROUP BY ALL)
SELECT n.conv_id, CAST(n.depth AS BIGINT) AS depth, p.conv_id AS parent_conv_id, n.n_convs, CAST(n.n_children AS BIGINT) AS n_children,
       CAST(u.leaves AS BIGINT) AS n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN upward u USING (path, depth)
LEFT JOIN full_nodes p ON n.depth > 0 AND p.depth = n.depth - 1 AND p.path = CASE WHEN n.depth > 1 THEN n.path[1:n.depth - 1] ELSE [] END"""

ORACLES: dict[str, str] = {
    "op13_prefix_trie": _TRIE,
    "op9_warc_index": _PAGES,
    "op8_minhash_hamming": _NEAR,
}
