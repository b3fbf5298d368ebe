"""The corpus queries that SQL can state, for DuckDB over the same tables: plain versions without the operators' methods."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

#: Every query vector beside every other one.
VORONOI_KNN = """
WITH e AS (
    SELECT DISTINCT vec_id AS id, list_transform(embedding, lambda c: floor(64 * CAST(c AS DOUBLE))) AS v
    FROM embeddings
    WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda c: c IS NULL OR NOT isfinite(c))) = 0
), s AS (
    SELECT q.id AS query_id, x.id AS vec_id, CAST(list_inner_product(q.v, x.v) AS BIGINT) AS score
    FROM e q JOIN e x ON q.id <> x.id
    WHERE q.id % 20 = 0
), r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
SELECT query_id, CAST(rank AS INT) AS rank, vec_id, score FROM r WHERE rank <= 20
"""

_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

#: Every run of words of a document beside every window of an item, by the words themselves.
DECONTAMINATE = f"""
WITH d AS (SELECT doc_id, row_number() OVER () AS r, {_WORDS} AS ws FROM documents),
i AS (SELECT item_id, {_WORDS} AS ws FROM benchmark WHERE item_id IS NOT NULL),
starts AS (SELECT item_id, ws, least(len(ws), 10) AS n, unnest(range(1, greatest(len(ws) - 9, 1) + 1)) AS a FROM i WHERE len(ws) > 0),
windows AS (SELECT DISTINCT item_id, n, array_to_string(ws[a : a + n - 1], ' ') AS k FROM starts),
sizes AS (SELECT DISTINCT n FROM windows),
places AS (SELECT r, ws, n, unnest(range(1, len(ws) - n + 2)) AS a FROM d, sizes WHERE len(ws) >= n),
hits AS (SELECT r, a, n, item_id FROM (SELECT r, a, n, array_to_string(ws[a : a + n - 1], ' ') AS k FROM places) JOIN windows USING (n, k)),
words AS (SELECT r, count(DISTINCT x) AS n_hit FROM (SELECT r, unnest(range(a, a + n)) AS x FROM hits) GROUP BY r),
items AS (SELECT r, list_sort(list(DISTINCT CAST(item_id AS VARCHAR))) AS ids FROM hits GROUP BY r)
SELECT doc_id, len(ws) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(len(ids), 0) AS n_items,
    sha256(coalesce(array_to_string(ids, ','), '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words USING (r) LEFT JOIN items USING (r)
"""

#: Every pair of documents that share a shingle, and all that is reached by links.
NGRAM_JACCARD = rf"""
WITH RECURSIVE d AS (SELECT doc_id, row_number() OVER () AS r, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS ws FROM documents),
starts AS (SELECT r, ws, unnest(range(1, greatest(len(ws) - 4, 1) + 1)) AS a FROM d WHERE len(ws) > 0),
s AS (SELECT DISTINCT r, array_to_string(ws[a : a + 4], ' ') AS k FROM starts),
n AS (SELECT r, count(*) AS n FROM s GROUP BY r),
p AS (SELECT a.r AS x, b.r AS y, count(*) AS m FROM s a JOIN s b ON a.k = b.k AND a.r <> b.r GROUP BY 1, 2),
e AS (SELECT x, y FROM p JOIN n a ON a.r = x JOIN n b ON b.r = y WHERE 100 * m >= 80 * (a.n + b.n - m)),
reached AS (SELECT r, r AS o FROM n UNION SELECT reached.r, e.y FROM reached JOIN e ON e.x = reached.o),
least AS (SELECT reached.r, min(doc_id) AS component_id FROM reached JOIN d ON d.r = reached.o GROUP BY 1)
SELECT doc_id, coalesce(n, 0) AS n_shingles, CASE WHEN n > 0 THEN component_id ELSE doc_id END AS component_id
FROM d LEFT JOIN n USING (r) LEFT JOIN least USING (r)
"""

#: Runs of 50 words from each line on, up to each line, and of two such lines, by the lines themselves (for ids that differ).
LINE_DEDUP = r"""
WITH every AS (SELECT doc_id, string_split(text, chr(10)) AS ls FROM documents),
line AS (SELECT doc_id, unnest(range(len(ls))) AS i, unnest(ls) AS line FROM every),
live AS (SELECT doc_id, i, line, len(regexp_extract_all(line, '[^ \t\x0B\f\r]+')) AS w FROM line),
l AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto, row_number() OVER (PARTITION BY doc_id ORDER BY i) AS j FROM live WHERE w > 0),
r AS (
    SELECT a.doc_id, a.j AS f, min(b.j) AS e FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.j >= a.j AND b.upto >= a.upto - a.w + 50 GROUP BY 1, 2
    UNION
    SELECT a.doc_id, max(b.j), a.j FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.j <= a.j AND a.upto >= b.upto - b.w + 50 GROUP BY 1, 3
    UNION
    SELECT a.doc_id, a.j, b.j FROM l a JOIN l b ON b.doc_id = a.doc_id AND b.j = a.j + 1 WHERE a.w >= 50 AND b.w >= 50
),
runs AS (SELECT r.doc_id, f, e, min(i) AS first, max(i) AS last, string_agg(line, chr(10) ORDER BY j) AS k FROM r JOIN l ON l.doc_id = r.doc_id AND l.j BETWEEN f AND e GROUP BY 1, 2, 3),
later AS (SELECT doc_id, first, last FROM (SELECT *, row_number() OVER (PARTITION BY k ORDER BY doc_id, first) AS nth FROM runs) WHERE nth > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(first, last + 1)) AS i FROM later),
kept AS (SELECT doc_id, string_agg(line, chr(10) ORDER BY i) AS t FROM line WHERE NOT EXISTS (SELECT 1 FROM gone g WHERE g.doc_id = line.doc_id AND g.i = line.i) GROUP BY 1),
n AS (SELECT doc_id, count(*) AS lines_deleted FROM gone GROUP BY 1),
out AS (SELECT doc_id, coalesce(len(ls), 0) AS lines, coalesce(lines_deleted, 0) AS lines_deleted, CASE WHEN ls IS NOT NULL THEN coalesce(t, '') END AS t FROM every LEFT JOIN kept USING (doc_id) LEFT JOIN n USING (doc_id))
SELECT doc_id, lines, lines_deleted, length(t) AS n_chars, sha256(t) AS text_sha256 FROM out
"""

# the CRC-32 of a string's UTF-8 bytes, bit by bit
_CRC_TABLE = "list_transform(range(256), lambda v: list_reduce(range(8), lambda a, k: xor(a >> 1, (a & 1) * 3988292384), v))"


def _crc(text: str) -> str:
    hexed = f"hex(encode({text}))"
    bytes_ = f"list_transform(range(octet_length(encode({text}))), lambda i: CAST('0x' || {hexed}[2 * i + 1 : 2 * i + 2] AS BIGINT))"
    return f"xor(list_reduce({bytes_}, lambda c, b: xor(c >> 8, crc_table[xor(c, b) & 255 + 1]), 4294967295), 4294967295)".replace("& 255 + 1", "& 255) + 1").replace("crc_table[xor", "crc_table[(xor")


#: Every word's CRC from its own bytes.
IMPORTANCE = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS crc_table),
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS ws FROM documents),
b AS (SELECT {_WORDS} AS ws FROM benchmark),
dw AS (SELECT r, unnest(ws) AS w FROM d), bw AS (SELECT unnest(ws) AS w FROM b),
known AS (SELECT DISTINCT w FROM (SELECT w FROM dw UNION ALL SELECT w FROM bw)),
bucket AS (SELECT w, {_crc("w")} % 10000 AS k FROM known, tab),
s AS (SELECT k, count(*) AS n FROM dw JOIN bucket USING (w) GROUP BY k),
t AS (SELECT k, count(*) AS n FROM bw JOIN bucket USING (w) GROUP BY k),
gain AS (
    SELECT u.k, CAST(floor(1000 * ln((coalesce(t.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM dw) + 10000.0::DOUBLE) / ((coalesce(s.n, 0) + 1.0::DOUBLE) * ((SELECT count(*) FROM bw) + 10000.0::DOUBLE)))) AS BIGINT) AS g
    FROM (SELECT DISTINCT k FROM bucket) u LEFT JOIN s ON s.k = u.k LEFT JOIN t ON t.k = u.k
),
weight AS (SELECT r, sum(g) AS weight FROM dw JOIN bucket USING (w) JOIN gain USING (k) GROUP BY r),
scored AS (
    SELECT r, doc_id, CAST(len(ws) AS BIGINT) AS n_features, CAST(coalesce(weight, 0) AS BIGINT) AS weight,
        CAST(coalesce(weight, 0) + floor(-1000 * ln(-ln((CAST('0x' || substring(sha256('2024:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
    FROM d LEFT JOIN weight USING (r)
),
ranked AS (SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, r) AS rank FROM scored WHERE n_features >= 20)
SELECT doc_id, n_features, weight, score, CAST(CASE WHEN rank <= (SELECT count(*) FROM ranked) * 10 // 100 THEN rank END AS BIGINT) AS rank
FROM scored LEFT JOIN ranked USING (r)
"""

#: Every prefix of every rebuilt conversation as a list, and each node beside all those above it.
PREFIX_TRIE = f"""
WITH tab AS (SELECT {_CRC_TABLE} AS crc_table),
own AS (
    SELECT conv_id AS c, list(struct_pack(role := coalesce(role, ''), txt := coalesce(text, '')) ORDER BY turn NULLS FIRST) AS ts
    FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
plan AS (SELECT c, ts, c - c % 5 AS b, CAST({_crc("CAST(c AS VARCHAR)")} % 9 AS BIGINT) AS h FROM own, tab),
convs AS (SELECT p.c, list_concat(coalesce(o.ts[1 : p.h], []), p.ts[p.h + 1 :]) AS ts FROM plan p LEFT JOIN own o ON o.c = p.b),
steps AS (SELECT c, ts, unnest(range(0, len(ts) + 1)) AS d FROM convs),
nodes AS (
    SELECT CAST(d AS BIGINT) AS depth, ts[1 : d] AS path, min(c) AS conv_id, count(*) AS n_convs,
        string_agg(CASE WHEN len(ts) = d THEN CAST(c AS VARCHAR) END, ',' ORDER BY c) AS ends
    FROM steps GROUP BY d, ts[1 : d]
),
kids AS (SELECT path[1 : depth - 1] AS path, depth - 1 AS depth, count(*) AS n_children FROM nodes WHERE depth > 0 GROUP BY 1, 2),
full_nodes AS (
    SELECT n.*, coalesce(k.n_children, 0) AS n_children,
        CASE WHEN n.depth = 0 THEN 0 ELSE (n.n_convs - 1) * octet_length(encode(n.path[n.depth].txt)) END AS saved
    FROM nodes n LEFT JOIN kids k ON k.path = n.path AND k.depth = n.depth
),
above AS (SELECT path, saved, n_children, unnest(range(0, depth + 1)) AS a FROM full_nodes),
sums AS (SELECT path[1 : a] AS path, a AS depth, sum(saved) AS saved_tokens, count(*) FILTER (WHERE n_children = 0) AS n_leaves FROM above GROUP BY 1, 2)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, CAST(n.n_convs AS BIGINT) AS n_convs, CAST(n.n_children AS BIGINT) AS n_children,
    CAST(s.n_leaves AS BIGINT) AS n_leaves, CAST(s.saved_tokens AS BIGINT) AS saved_tokens, sha256(coalesce(n.ends, '')) AS ends_sha256
FROM full_nodes n JOIN sums s ON s.path = n.path AND s.depth = n.depth
LEFT JOIN nodes p ON p.path = n.path[1 : n.depth - 1] AND p.depth = n.depth - 1 AND n.depth > 0
"""
