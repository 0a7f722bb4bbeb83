"""DuckDB SQL for the training-data queries that SQL can express, over whole tables."""

from __future__ import annotations

# CRC-32 by bytes, its table made by the rule of the polynomial.
CRC_TABLE = """crc(t) AS (SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, n) ORDER BY n) FROM range(256) r(n))"""
CRC = """xor(list_reduce(list_transform(regexp_extract_all(hex(encode(coalesce(text, ''))), '..'), lambda h: CAST('0x' || h AS BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), 4294967295), 4294967295)"""


def _score(shard: str) -> str:
    return f"-ln((CAST(CAST('0x' || substr(md5(k || ':' || {shard}), 1, 13) AS BIGINT) AS DOUBLE) + 0.5) / 4503599627370496.0)"


OP1 = """WITH pages1 AS (SELECT page_id, coalesce(html, '') AS body, sha1(coalesce(html, '')) AS h FROM pages),
firsts AS (SELECT h, min(page_id) AS first FROM pages1 GROUP BY h),
named AS (SELECT page_id, strlen(body) AS payload_bytes, array_to_string(list_transform(range(8), lambda k: to_base(CAST('0x' || substr(h, CAST(5 * k + 1 AS INT), 5) AS INT), 32, 4)), '') AS d, first
  FROM pages1 JOIN firsts USING (h))
SELECT page_id, payload_bytes, translate(d, '0123456789ABCDEFGHIJKLMNOPQRSTUV', 'ABCDEFGHIJKLMNOPQRSTUVWXYZ234567') AS payload_digest,
  CASE WHEN page_id > first THEN 'revisit' ELSE 'response' END AS record_type, CASE WHEN page_id > first THEN first END AS refers_to FROM named"""

BLANKS = r"'[^\x20\x09-\x0D]+'"

OP7 = f"""WITH cut AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {BLANKS}) AS w FROM documents),
wins AS (SELECT doc_id, i, array_to_string(w[i + 1:i + 20], ' ') AS g FROM (SELECT doc_id, w, unnest(range(len(w) - 19)) AS i FROM cut WHERE len(w) >= 20)),
firsts AS (SELECT g, min((doc_id, i)) AS f FROM wins GROUP BY g HAVING count(*) > 1),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, i + 20)) AS p FROM wins JOIN firsts USING (g) WHERE (doc_id, i) > f),
lists AS (SELECT doc_id, list(p) AS ps FROM gone GROUP BY doc_id),
words AS (SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) - 1 AS p FROM cut),
kept AS (SELECT doc_id, string_agg(word, ' ' ORDER BY p) AS t FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(ps), 0) AS BIGINT) AS n_removed, sha256(coalesce(t, '')) AS kept_sha256
FROM cut LEFT JOIN lists USING (doc_id) LEFT JOIN kept USING (doc_id)"""

LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
NAMES = r"'[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'"

OP9 = f"""WITH items AS (SELECT item_id, regexp_extract_all({LOWER}, {NAMES}) AS w FROM benchmark),
grams AS (SELECT DISTINCT item_id, array_to_string(w[i + 1:i + 13], ' ') AS g, least(13, len(w)) AS n FROM (SELECT item_id, w, unnest(range(greatest(1, len(w) - 12))) AS i FROM items WHERE len(w) > 0)),
cut AS (SELECT doc_id, regexp_extract_all({LOWER}, {NAMES}) AS w FROM documents),
wins AS (SELECT doc_id, n, i, array_to_string(w[i + 1:i + n], ' ') AS g FROM (SELECT doc_id, w, n, unnest(range(len(w) - n + 1)) AS i FROM cut, (SELECT DISTINCT n FROM grams) WHERE len(w) >= n)),
met AS (SELECT doc_id, i, n, item_id FROM wins JOIN grams USING (g, n)),
hit AS (SELECT doc_id, count(DISTINCT p) AS h FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM met) GROUP BY doc_id),
found AS (SELECT doc_id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS s FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS item FROM met) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(h, 0) AS n_hit, coalesce(n, 0) AS n_items, sha256(coalesce(s, '')) AS items_sha256,
  coalesce(h, 0) > 0 AND 20 * coalesce(h, 0) >= len(w) AS contaminated
FROM cut LEFT JOIN hit USING (doc_id) LEFT JOIN found USING (doc_id)"""

OP2 = f"""WITH {CRC_TABLE},
keyed AS (SELECT doc_id, coalesce(CAST(doc_id AS VARCHAR), 'null') AS k, CAST(strlen(coalesce(text, '')) + 1 AS BIGINT) AS size, {CRC} AS text_crc32 FROM documents, crc),
scored AS (SELECT *, list_transform(range(9), lambda s: {_score('CAST(s AS VARCHAR)')}) AS x FROM keyed),
placed AS (SELECT *, CAST(list_position(x[1:8], list_min(x[1:8])) - 1 AS INTEGER) AS shard FROM scored)
SELECT doc_id, size, text_crc32, 'key' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY md5(k), doc_id, text_crc32, size) - 1 AS slot,
  CASE WHEN x[9] < list_min(x[1:8]) THEN 8 ELSE shard END AS grown_shard FROM placed"""

def _crc(column: str) -> str:
    return CRC.replace("coalesce(text, '')", column)


OP11 = f"""WITH {CRC_TABLE},
own AS (SELECT conv_id AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text) AS p, {{'r': coalesce(role, ''), 'x': coalesce(text, '')}} AS t FROM conversations WHERE conv_id IS NOT NULL),
convs AS (SELECT c, c - ((c % 20) + 20) % 20 AS b, {_crc('CAST(c AS VARCHAR)')} % 4 AS h FROM (SELECT DISTINCT c FROM own), crc),
parts AS (SELECT v.c, 0 AS k, o.p, o.t FROM convs v JOIN own o ON o.c = v.b AND o.p <= v.h UNION ALL SELECT v.c, 1, o.p, o.t FROM convs v JOIN own o ON o.c = v.c AND o.p > v.h),
placed AS (SELECT c, row_number() OVER (PARTITION BY c ORDER BY k, p) AS d, t FROM parts),
chains AS (SELECT c, d, t.x AS x, list(t) OVER (PARTITION BY c ORDER BY d ROWS UNBOUNDED PRECEDING) AS s FROM placed UNION ALL SELECT c, 0, '', [] FROM convs),
nodes AS (SELECT s, d, min(c) AS m, count(*) AS n, len(regexp_extract_all(any_value(x), {BLANKS})) AS w FROM chains GROUP BY s, d),
spots AS (SELECT c.c, c.d, n.m, n.n, n.w, c.d = max(c.d) OVER (PARTITION BY c.c) AS is_end FROM chains c JOIN nodes n USING (s, d)),
kids AS (SELECT p.m, p.d, count(*) AS k FROM nodes n JOIN spots p ON p.c = n.m AND p.d = n.d - 1 GROUP BY p.m, p.d),
known AS (SELECT n.m, n.d, n.n, n.w, coalesce(k, 0) AS k FROM nodes n LEFT JOIN kids USING (m, d)),
above AS (SELECT a.m, a.d, count(*) FILTER (n.k = 0) AS leaves, sum((n.n - 1) * n.w) AS saved FROM known n JOIN spots a ON a.c = n.m AND a.d <= n.d GROUP BY a.m, a.d),
ended AS (SELECT m, d, string_agg(CAST(c AS VARCHAR), ',' ORDER BY c) AS ids FROM spots WHERE is_end GROUP BY m, d)
SELECT n.m AS conv_id, CAST(n.d AS BIGINT) AS depth, p.m AS parent_conv_id, n.n AS n_convs, n.k AS n_children, a.leaves AS n_leaves, CAST(a.saved AS BIGINT) AS saved_tokens, sha256(coalesce(ids, '')) AS ends_sha256
FROM known n JOIN above a USING (m, d) LEFT JOIN ended e USING (m, d) LEFT JOIN spots p ON p.c = n.m AND p.d = n.d - 1"""

OP13 = f"""WITH RECURSIVE {CRC_TABLE},
runs AS (SELECT coalesce(CAST(doc_id AS VARCHAR), 'null') AS id, translate(unnest(regexp_extract_all(coalesce(text, ''), '[A-Za-zÀ-ÿ]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS r FROM documents),
seen AS (SELECT r, k, {_crc("id || ':' || r")} AS h FROM (SELECT id, r, count(*) AS k FROM runs GROUP BY id, r), crc),
words AS (SELECT w, CAST(sum(k) AS BIGINT) AS n FROM (SELECT k, CASE WHEN h % 199 = 0 THEN r[1:h % length(r)] || r[h % length(r) + 2:] ELSE r END AS w FROM seen) GROUP BY w HAVING length(w) >= 6 AND sum(k) >= 5),
cut AS (SELECT w, n, i, w[1:i] || w[i + 2:] AS x FROM (SELECT w, n, unnest(range(length(w))) AS i FROM words)),
near AS (SELECT a.w, a.n, b.w AS f, b.n AS fn FROM cut a JOIN cut b ON a.x = b.x AND a.i = b.i AND a.w <> b.w
  UNION SELECT a.w, a.n, b.w, b.n FROM cut a JOIN words b ON a.x = b.w UNION SELECT b.w, b.n, a.w, a.n FROM cut a JOIN words b ON a.x = b.w),
best AS (SELECT w, count(*) AS n_near, arg_min(f, (-fn, f)) AS f, max(fn) AS fn FROM near GROUP BY w),
forms AS (SELECT w, n, coalesce(n_near, 0) AS n_near, CASE WHEN fn >= 5 * n THEN f END AS form, CASE WHEN fn >= 5 * n THEN fn END AS form_n FROM words LEFT JOIN best USING (w)),
up AS (SELECT w, w AS root FROM forms UNION ALL SELECT up.w, forms.form FROM up JOIN forms ON forms.w = up.root WHERE forms.form IS NOT NULL),
tops AS (SELECT up.w, up.root FROM up JOIN forms ON forms.w = up.root WHERE forms.form IS NULL)
SELECT w AS word, n, n_near, form, form_n, root FROM forms JOIN tops USING (w)"""

ORACLE_SQL = {"op1_warc": OP1, "op2_sharding": OP2, "op7_substrings": OP7, "op9_decontaminate": OP9, "op11_prefix_trie": OP11, "op13_spelling": OP13}
