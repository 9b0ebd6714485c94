"""SQL counterparts, written for any engine with RE2 patterns and list functions."""

from rasterweave.llm import crc, licenses, urls

OP1 = r"""
WITH w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (
  SELECT item_id, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS n, array_to_string(w[i:i + 9], ' ') AS words
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
ns AS (SELECT DISTINCT n FROM bw),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS words
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM w, ns WHERE len(w) >= n)),
h AS (SELECT doc_id, item_id, dw.n, i FROM dw JOIN bw ON dw.n = bw.n AND dw.words = bw.words),
hw AS (SELECT doc_id, count(DISTINCT p) AS n_hit
  FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM h) GROUP BY doc_id),
hi AS (SELECT doc_id, count(DISTINCT item_id) AS n_items,
  string_agg(DISTINCT CAST(item_id AS VARCHAR), ',' ORDER BY CAST(item_id AS VARCHAR)) AS items
  FROM h GROUP BY doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit,
  CAST(coalesce(n_items, 0) AS BIGINT) AS n_items, sha256(coalesce(items, '')) AS items_sha256,
  coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN hw USING (doc_id) LEFT JOIN hi USING (doc_id)
"""

OP3 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 3], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS i
  FROM s a JOIN s b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY ALL),
l AS (SELECT x, y FROM p JOIN n a ON a.doc_id = x JOIN n b ON b.doc_id = y WHERE 100 * i >= 85 * (a.n + b.n - i)),
e AS (SELECT x, y FROM l UNION SELECT y, x FROM l),
r AS (SELECT x AS doc_id, x AS c FROM e UNION SELECT r.doc_id, e.y FROM r JOIN e ON r.c = e.x)
SELECT w.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles, coalesce(m.c, w.doc_id) AS component_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT doc_id, min(c) AS c FROM r GROUP BY doc_id) m USING (doc_id)
"""

OP2 = r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
g AS (
  SELECT doc_id, i, array_to_string(w[i:i + 34], ' ') AS g
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 33)) AS i FROM w WHERE len(w) >= 35)),
r AS (SELECT g FROM g GROUP BY g HAVING count(*) > 1),
c AS (SELECT DISTINCT doc_id, unnest(range(i, i + 35)) AS p FROM g SEMI JOIN r USING (g)),
k AS (
  SELECT x.doc_id, string_agg(x.word, ' ' ORDER BY x.p) AS kept, count(*) AS n
  FROM (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM w) x
  ANTI JOIN c ON x.doc_id = c.doc_id AND x.p = c.p GROUP BY x.doc_id)
SELECT w.doc_id, CAST(len(w.w) AS BIGINT) AS n_words, CAST(len(w.w) - coalesce(k.n, 0) AS BIGINT) AS n_removed,
  sha256(coalesce(k.kept, '')) AS kept_sha256
FROM w LEFT JOIN k USING (doc_id)
"""

OP12 = rf"""
WITH RECURSIVE crc_of AS (SELECT DISTINCT doc_id AS v FROM documents WHERE doc_id IS NOT NULL),{crc.TABLES},
f AS (
  SELECT doc_id, lang, coalesce(strlen(CAST(doc_id AS VARCHAR)) || ':' || CAST(doc_id AS VARCHAR), '-') AS f1,
    coalesce(strlen(source) || ':' || source, '-') || coalesce(strlen(lang) || ':' || lang, '-') AS f2,
    n_chars, coalesce(strlen(text) || ':' || text, '-') AS f4 FROM documents),
l AS (
  SELECT doc_id, lang, crc % 7 = 0 AS changed,
    sha256(f1 || f2 || coalesce(strlen(CAST(n_chars AS VARCHAR)) || ':' || n_chars, '-') || f4) AS leaf,
    sha256(f1 || f2 || coalesce(strlen(CAST(n_chars + 1 AS VARCHAR)) || ':' || (n_chars + 1), '-') || f4) AS told
  FROM f LEFT JOIN crcs ON doc_id = v),
p AS (
  SELECT *, dense_rank() OVER (ORDER BY lang NULLS FIRST) AS g, count(*) OVER (PARTITION BY lang) AS n,
    row_number() OVER (PARTITION BY lang ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM l),
t(g, k, i, n, h) AS (
  SELECT g, 0, i, n, leaf FROM p
  UNION ALL
  SELECT g, k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM t WHERE n > 1 GROUP BY g, k, i // 2, n),
s AS (SELECT g, h, (SELECT count(DISTINCT g) FROM p) AS n FROM t WHERE n = 1),
u(k, i, n, h) AS (
  SELECT 0, g - 1, n, h FROM s
  UNION ALL
  SELECT k + 1, i // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY i)) FROM u WHERE n > 1 GROUP BY k, i // 2, n),
way AS (
  SELECT p.doc_id, p.i AS place, p.g, 0 AS part, t.k, t.i, t.h FROM p JOIN t ON t.g = p.g AND t.i = xor(p.i >> t.k, 1)
  UNION ALL
  SELECT p.doc_id, p.i, p.g, 1, u.k, u.i, u.h FROM p JOIN u ON u.i = xor((p.g - 1) >> u.k, 1)),
proofs AS (SELECT g, place, sha256(string_agg(h, '' ORDER BY part, k)) AS proof FROM way GROUP BY g, place),
tops AS (SELECT g, max(k) AS height FROM t GROUP BY g),
fold(g, place, k, top, h) AS (
  SELECT p.g, p.i, 0, height, CASE WHEN changed THEN told ELSE leaf END FROM p JOIN tops USING (g)
  UNION ALL
  SELECT f.g, f.place, f.k + 1, f.top, sha256(CASE WHEN t.h IS NULL THEN f.h
    WHEN (f.place >> f.k) % 2 = 0 THEN f.h || t.h ELSE t.h || f.h END)
  FROM fold f LEFT JOIN t ON t.g = f.g AND t.k = f.k AND t.i = xor(f.place >> f.k, 1) WHERE f.k < f.top),
fold2(g, place, k, h) AS (
  SELECT g, place, 0, h FROM fold WHERE k = top
  UNION ALL
  SELECT f.g, f.place, f.k + 1, sha256(CASE WHEN u.h IS NULL THEN f.h
    WHEN ((f.g - 1) >> f.k) % 2 = 0 THEN f.h || u.h ELSE u.h || f.h END)
  FROM fold2 f LEFT JOIN u ON u.k = f.k AND u.i = xor((f.g - 1) >> f.k, 1) WHERE f.k < (SELECT max(k) FROM u))
SELECT p.doc_id, p.leaf, s.h AS subroot, r.h AS root, coalesce(proof, sha256('')) AS proof_sha256,
  f.h AS folded_root, f.h = r.h AS verified
FROM p JOIN s USING (g) JOIN fold2 f ON f.g = p.g AND f.place = p.i AND f.k = (SELECT max(k) FROM u)
CROSS JOIN (SELECT h FROM u WHERE n = 1) r LEFT JOIN proofs ON proofs.g = p.g AND proofs.place = p.i
"""

OP13 = r"""
WITH p AS (SELECT page_id, CAST(strlen(coalesce(html, '')) AS BIGINT) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages),
q AS (
  SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) END AS first,
    row_number() OVER (PARTITION BY payload_digest ORDER BY page_id NULLS LAST) AS no FROM p)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first IS NOT NULL AND no > 1 THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN no > 1 THEN first END AS refers_to
FROM q
"""

OP11 = rf"""
WITH RECURSIVE crc_of AS (SELECT DISTINCT conv_id AS v FROM conversations WHERE conv_id IS NOT NULL),{crc.TABLES},
t AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST) - 1 AS pos,
    {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} AS said
  FROM conversations WHERE conv_id IS NOT NULL),
c AS (SELECT v AS conv_id, v - v % 5 AS base, crc % 9 AS h FROM crcs),
r AS (
  SELECT c.conv_id, pos, said FROM c JOIN t ON t.conv_id = c.base AND pos < h
  UNION ALL SELECT c.conv_id, pos, said FROM c JOIN t ON t.conv_id = c.conv_id AND pos >= h),
s AS (
  SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY pos) AS depth, said,
    list(said) OVER (PARTITION BY conv_id ORDER BY pos) AS path FROM r),
n AS (SELECT conv_id, count(*) AS turns FROM s GROUP BY conv_id),
m AS (
  SELECT conv_id, depth, strlen(said.text) AS bytes, min(conv_id) OVER (PARTITION BY path) AS node FROM s
  UNION ALL SELECT conv_id, 0, 0, (SELECT min(conv_id) FROM c) FROM c),
nodes AS (
  SELECT m.node, m.depth, any_value(bytes) AS bytes, count(*) AS n_convs,
    sha256(coalesce(string_agg(CASE WHEN coalesce(turns, 0) = m.depth THEN CAST(m.conv_id AS VARCHAR) END, ',' ORDER BY m.conv_id), '')) AS ends
  FROM m LEFT JOIN n USING (conv_id) GROUP BY m.node, m.depth),
kids AS (
  SELECT up.node, up.depth, count(*) AS n_children
  FROM nodes x JOIN m up ON up.conv_id = x.node AND up.depth = x.depth - 1 GROUP BY up.node, up.depth),
sub AS (
  SELECT up.node, up.depth, CAST(sum(CASE WHEN kids.node IS NULL THEN 1 ELSE 0 END) AS BIGINT) AS n_leaves,
    CAST(sum((x.n_convs - 1) * x.bytes) AS BIGINT) AS saved_tokens
  FROM nodes x LEFT JOIN kids ON kids.node = x.node AND kids.depth = x.depth
  JOIN m up ON up.conv_id = x.node AND up.depth <= x.depth GROUP BY up.node, up.depth)
SELECT x.node AS conv_id, x.depth, up.node AS parent_conv_id, x.n_convs, coalesce(n_children, 0) AS n_children,
  n_leaves, saved_tokens, ends AS ends_sha256
FROM nodes x JOIN sub ON sub.node = x.node AND sub.depth = x.depth
LEFT JOIN kids ON kids.node = x.node AND kids.depth = x.depth
LEFT JOIN m up ON up.conv_id = x.node AND up.depth = x.depth - 1
"""


def op4() -> str:
    """Rules and vocabulary of the query as conditions."""
    def free(term):
        return f"regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])')"

    strict = " OR ".join(map(free, urls.STRICT))
    soft = " + ".join(f"CAST({free(t)} AS INTEGER)" for t in urls.SOFT)
    fits = "\n    ".join(
        f"WHEN (host = '{h}' OR ends_with(host, '.{h}')) AND starts_with(path, '{p}') THEN '{h}{p}'"
        for h, p, _ in sorted(urls.RULES, key=lambda r: -len(r[0] + r[1]))
    )
    says = "\n    ".join(f"WHEN rule = '{h}{p}' THEN '{v}'" for h, p, v in urls.RULES)
    return f"""
WITH a AS (
  SELECT page_id, coalesce(translate(url, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS u,
    CASE WHEN strpos(url, '://') > 0 THEN substr(url, strpos(url, '://') + 3) ELSE '' END AS rest FROM pages),
b AS (SELECT page_id, u, rest, regexp_extract(rest, '^[^/?#]*') AS raw FROM a),
c AS (
  SELECT page_id, u, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(substr(rest, length(raw) + 1), '^[^?#]*') AS path FROM b),
d AS (SELECT *, CASE
    {fits} END AS rule FROM c)
SELECT page_id, host, path, rule, CASE
    {says}
    WHEN {strict} THEN 'block'
    WHEN {soft} >= {urls.SOFT_HITS} THEN 'block'
    ELSE 'allow' END AS verdict
FROM d
"""


def op10() -> str:
    """The same sums over all passages, without looking for anchors first."""
    notices = ",\n    ".join(f"({i}, '{n}', '{t}')" for i, (n, t) in enumerate(licenses.TEMPLATES))
    return rf"""
WITH f AS (
  SELECT doc_id, text, concat_ws('/', source, lang, CAST(CAST(floor(doc_id / 100) AS BIGINT) AS VARCHAR),
    CASE WHEN doc_id % 25 = 0 THEN 'LICENSE.' || doc_id ELSE CAST(doc_id AS VARCHAR) END) AS path FROM documents),
t(template, license, notice) AS (VALUES
    {notices}),
tt AS (
  SELECT template, license, term, count(*) AS n
  FROM (SELECT template, license, unnest(regexp_extract_all(lower(notice), '[a-z0-9]+')) AS term FROM t) GROUP BY ALL),
p AS (
  SELECT doc_id, unnest(l) AS passage, generate_subscripts(l, 1) AS no
  FROM (SELECT doc_id, string_split(regexp_replace(text, '([.!?])[ \t]+([A-Z])', '\1' || chr(10) || '\2', 'g'), chr(10)) AS l
    FROM f WHERE text IS NOT NULL)),
w AS (
  SELECT doc_id, no, term, count(*) AS n
  FROM (SELECT doc_id, no, unnest(regexp_extract_all(lower(passage), '[a-z0-9]+')) AS term FROM p) GROUP BY ALL),
df AS (SELECT term, count(DISTINCT doc_id) AS df FROM w GROUP BY term),
v AS (
  SELECT term, 1 + ln((1.0 + (SELECT count(*) FROM f WHERE text IS NOT NULL)) / (1 + coalesce(df, 0))) AS idf
  FROM (SELECT DISTINCT term FROM tt) LEFT JOIN df USING (term)),
tn AS (SELECT template, sqrt(sum(n * idf * n * idf)) AS norm FROM tt JOIN v USING (term) GROUP BY template),
pn AS (
  SELECT doc_id, no, sqrt(sum(n * coalesce(idf, 1) * n * coalesce(idf, 1))) AS norm
  FROM w LEFT JOIN v USING (term) GROUP BY doc_id, no),
dots AS (
  SELECT w.doc_id, w.no, tt.template, tt.license, sum(w.n * v.idf * tt.n * v.idf) AS dot
  FROM w JOIN v USING (term) JOIN tt USING (term) GROUP BY ALL),
s AS (
  SELECT doc_id, template, license, round(dot / pn.norm / tn.norm, 6) AS score
  FROM dots JOIN pn USING (doc_id, no) JOIN tn USING (template)),
own AS (
  SELECT doc_id, license, score FROM s WHERE score >= {licenses.THRESHOLD}
  QUALIFY row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, template) = 1),
o AS (
  SELECT f.doc_id, path, regexp_replace(path, '/?[^/]*$', '') AS dir, license, score FROM f LEFT JOIN own USING (doc_id)),
d AS (
  SELECT dir, license FROM o WHERE license IS NOT NULL AND starts_with(regexp_extract(path, '[^/]*$'), 'LICENSE.')
  QUALIFY row_number() OVER (PARTITION BY dir ORDER BY path) = 1),
near AS (
  SELECT a.dir, d.license, d.dir AS declared_in FROM (SELECT DISTINCT dir FROM o) a
  JOIN d ON d.dir = '' OR a.dir = d.dir OR starts_with(a.dir, d.dir || '/')
  QUALIFY row_number() OVER (PARTITION BY a.dir ORDER BY length(d.dir) DESC) = 1)
SELECT o.doc_id, o.path, o.license AS own_license, o.score, near.license AS inherited, near.declared_in,
  coalesce(o.license, near.license) AS license
FROM o LEFT JOIN near ON o.dir = near.dir
"""
