"""SQL twins of the operators' queries."""

WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

CONTAMINATION = f"""
WITH d AS (SELECT doc_id, {WORDS} AS w FROM documents),
i AS (SELECT item_id, {WORDS} AS w FROM benchmark),
iw AS (SELECT DISTINCT item_id, least(len(w), 13) AS n, array_to_string(w[s:s + least(len(w), 13) - 1], ' ') AS g
       FROM i, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS t(s) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT doc_id, n, s, array_to_string(w[s:s + n - 1], ' ') AS g
       FROM d, sizes, unnest(range(1, len(w) - n + 2)) AS t(s) WHERE len(w) >= n),
m AS (SELECT dw.doc_id, dw.s, dw.n, iw.item_id FROM dw JOIN iw ON dw.g = iw.g AND dw.n = iw.n),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM m, unnest(range(s, s + n)) AS t(p) GROUP BY doc_id),
l AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
             array_to_string(list_sort(list(DISTINCT item_id::VARCHAR)), ',') AS ids FROM m GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256,
       coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN l USING (doc_id)
"""

NEAREST = """
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
           WHERE embedding IS NOT NULL AND vec_id IS NOT NULL
             AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
             AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score
      FROM v q JOIN v c ON q.vec_id % 20 = 0 AND q.vec_id <> c.vec_id)
SELECT * FROM (SELECT query_id, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank,
                      vec_id, score FROM s) WHERE rank <= 20
"""

ARCHIVE = """
WITH p AS (SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha1(coalesce(html, '')) AS payload_digest
           FROM pages),
f AS (SELECT payload_digest, max(page_id) AS first FROM p WHERE payload_bytes >= 1000 GROUP BY 1)
SELECT page_id, payload_bytes, payload_digest,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN first IS NOT NULL AND page_id IS DISTINCT FROM first THEN first END AS refers_to
FROM p LEFT JOIN f USING (payload_digest)
"""

COMPONENTS = """
WITH RECURSIVE d AS (SELECT doc_id, list_filter(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT DISTINCT doc_id, array_to_string(w[s:s + 2], ' ') AS t
      FROM d, unnest(range(1, greatest(len(w) - 2, 1) + 1)) AS r(s) WHERE len(w) > 0),
n AS (SELECT doc_id, count(*) AS n FROM g GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM g a JOIN g b ON a.t = b.t AND a.doc_id <> b.doc_id GROUP BY 1, 2),
l AS (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 90 * (x.n + y.n - c)),
r AS (SELECT doc_id AS s, doc_id AS e FROM documents UNION SELECT r.s, l.b FROM r JOIN l ON l.a = r.e)
SELECT d.doc_id, coalesce(n.n, 0)::BIGINT AS n_shingles, m.c AS component_id
FROM d LEFT JOIN n USING (doc_id) JOIN (SELECT s, min(e) AS c FROM r GROUP BY s) m ON m.s = d.doc_id
"""

CRC_TABLE = """list_transform(range(0, 256), lambda i: list_reduce(list_concat([i], range(0, 8)),
    lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END))"""


def crc32(octets: str, table: str) -> str:
    """CRC-32 of a list of bytes, by the table of its 256 remainders."""
    return (f"xor(list_reduce(list_concat([4294967295], {octets}), "
            f"lambda a, b: xor(a >> 8, list_extract({table}, (xor(a, b) & 255) + 1))), 4294967295)")


PREFIX_TRIE = f"""
WITH RECURSIVE t AS (SELECT {CRC_TABLE} AS tab),
o AS (SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text,
             row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) - 1 AS pos
      FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT conv_id, conv_id - conv_id % 20 AS base, {crc32("list_transform(string_split(conv_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)", "tab")} % 4 AS h
      FROM (SELECT DISTINCT conv_id FROM o), t),
r AS (SELECT c.conv_id, 0 AS part, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.base WHERE o.pos < c.h
      UNION ALL SELECT c.conv_id, 1, o.pos, o.role, o.text FROM c JOIN o ON o.conv_id = c.conv_id WHERE o.pos >= c.h),
s AS (SELECT c.conv_id, coalesce(list(sha256(role || chr(1) || text) ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS turns,
             coalesce(list(len(list_filter(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '')) ORDER BY part, pos) FILTER (role IS NOT NULL), []) AS words
      FROM c LEFT JOIN r USING (conv_id) GROUP BY c.conv_id),
p AS (SELECT conv_id, d, len(turns) AS n, sha256(array_to_string(turns[:d], ',')) AS node,
             CASE WHEN d > 0 THEN sha256(array_to_string(turns[:d - 1], ',')) END AS up, CASE WHEN d > 0 THEN words[d] ELSE 0 END AS w
      FROM s, unnest(range(0, len(turns) + 1)) AS x(d)),
n AS (SELECT node, d, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs, (count(*) - 1) * any_value(w) AS saved,
             sha256(coalesce(array_to_string(list(conv_id::VARCHAR ORDER BY conv_id) FILTER (n = d), ','), '')) AS ends_sha256
      FROM p GROUP BY node, d),
k AS (SELECT up AS node, d - 1 AS d, count(*) AS n_children FROM n WHERE d > 0 GROUP BY 1, 2),
a AS (SELECT node AS top, d AS top_d, node, d FROM n UNION ALL SELECT n.up, n.d - 1, a.node, a.d FROM a JOIN n ON n.node = a.top AND n.d = a.top_d WHERE n.d > 0),
u AS (SELECT a.top AS node, a.top_d AS d, sum(n.saved) AS saved_tokens, count(*) FILTER (k.n_children IS NULL) AS n_leaves
      FROM a JOIN n ON n.node = a.node AND n.d = a.d LEFT JOIN k ON k.node = a.node AND k.d = a.d GROUP BY 1, 2)
SELECT n.conv_id, n.d::BIGINT AS depth, m.conv_id AS parent_conv_id, n.n_convs, coalesce(k.n_children, 0)::BIGINT AS n_children,
       u.n_leaves, u.saved_tokens::BIGINT AS saved_tokens, n.ends_sha256
FROM n JOIN u USING (node, d) LEFT JOIN k USING (node, d) LEFT JOIN n m ON m.node = n.up AND m.d = n.d - 1
"""

SUBSTRINGS = """
WITH d AS (SELECT doc_id, row_number() OVER () AS r, list_filter(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+'), lambda x: x <> '') AS w FROM documents),
g AS (SELECT r, doc_id, s, md5(array_to_string(w[s:s + 49], ' ')) AS t FROM d, unnest(range(1, len(w) - 48)) AS x(s)),
f AS (SELECT t, min(doc_id) AS first FROM g GROUP BY t),
h AS (SELECT DISTINCT r, p FROM g JOIN f USING (t), unnest(range(s, s + 50)) AS x(p) WHERE first < doc_id),
k AS (SELECT r, list(p ORDER BY p) AS gone FROM h GROUP BY r)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(len(gone), 0)::BIGINT AS n_removed,
       sha256(coalesce(array_to_string(CASE WHEN gone IS NULL THEN w ELSE list_filter(w, lambda x, i: NOT list_contains(gone, i)) END, ' '), '')) AS kept_sha256
FROM d LEFT JOIN k USING (r)
"""

_OCTETS = """flatten(list_transform(string_split({}, ''), lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT]
    ELSE [192 + unicode(x)::BIGINT // 64, 128 + unicode(x)::BIGINT % 64] END))"""

SPELLING = f"""
WITH RECURSIVE t AS (SELECT {CRC_TABLE} AS tab),
d AS (SELECT doc_id, unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
             '[A-Za-z\\x{{C0}}-\\x{{FF}}]+')) AS run FROM documents),
r AS (SELECT doc_id, run, count(*) AS n FROM d WHERE length(run) >= 7 GROUP BY ALL),
h AS (SELECT run, n, {crc32(_OCTETS.format("concat(doc_id::VARCHAR, ':', run)"), "tab")} AS h FROM r, t),
g AS (SELECT CASE WHEN h % 31 = 0 THEN concat(substr(run, 1, h % length(run)), substr(run, h % length(run) + 2)) ELSE run END AS word, n FROM h),
w AS (SELECT word, sum(n)::BIGINT AS n FROM g WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
x AS (SELECT word, i, concat(substr(word, 1, i - 1), substr(word, i + 1)) AS v FROM w, unnest(range(1, length(word) + 1)) AS u(i)),
p AS (SELECT word, v AS near FROM x WHERE v IN (SELECT word FROM w) UNION SELECT v, word FROM x WHERE v IN (SELECT word FROM w)
      UNION SELECT a.word, b.word FROM x a JOIN x b ON a.v = b.v AND a.i = b.i AND a.word <> b.word),
b AS (SELECT p.word, count(*) AS n_near, list({{'m': -w.n, 'f': p.near}} ORDER BY -w.n, p.near)[1] AS best FROM p JOIN w ON w.word = p.near GROUP BY p.word),
f AS (SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN -best.m >= 10 * n THEN best.f END AS form,
             CASE WHEN -best.m >= 10 * n THEN -best.m END AS form_n FROM w LEFT JOIN b USING (word)),
c AS (SELECT word, word AS at FROM f UNION ALL SELECT c.word, f.form FROM c JOIN f ON f.word = c.at WHERE f.form IS NOT NULL)
SELECT f.word, f.form, c.at AS root, f.n, f.n_near, f.form_n
FROM f JOIN c ON c.word = f.word JOIN f e ON e.word = c.at AND e.form IS NULL
"""
