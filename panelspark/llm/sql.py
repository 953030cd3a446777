r"""DuckDB SQL of the queries whose results SQL can express, written from the definitions."""

_LOWER = "translate({c}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ITEM_WORDS = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP1 = f"""
WITH d AS (SELECT doc_id, {_ITEM_WORDS.format(c="text")} AS w FROM documents),
b AS (SELECT item_id, {_ITEM_WORDS.format(c="text")} AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(range(1, len(w) - least(10, len(w)) + 2)) AS i
        FROM b WHERE len(w) > 0)),
lens AS (SELECT DISTINCT n FROM win),
dw AS (
  SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS k
  FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, lens WHERE len(w) >= n)),
hits AS (SELECT doc_id, dw.i, dw.n, item_id FROM dw JOIN win ON dw.n = win.n AND dw.k = win.k),
words AS (SELECT doc_id, count(DISTINCT p) AS n_hit
          FROM (SELECT doc_id, unnest(range(i, i + n)) AS p FROM hits) GROUP BY 1),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(id, ',' ORDER BY id) AS ids
          FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS id FROM hits) GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(len(w), 0) AS BIGINT) AS n_words,
       CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN words ON d.doc_id = words.doc_id LEFT JOIN items ON d.doc_id = items.doc_id
"""

OP2 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS BIGINT) AS size,
         md5(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || md5(coalesce(text, ''))) AS key
  FROM documents),
s AS (
  SELECT source, sum(size) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank
  FROM d GROUP BY source),
w AS (SELECT *, CAST([5, 2, 1][(rank - 1) % 3 + 1] AS DOUBLE) AS weight, 3 * source_size AS cap FROM s),
q AS (
  SELECT *, ((SELECT sum(size) FROM d) - coalesce(sum(cap) OVER before, 0))
            / ((SELECT sum(weight) FROM w) - coalesce(sum(weight) OVER before, 0.0)) AS quotient
  FROM w WINDOW before AS (ORDER BY cap / weight, rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
t AS (
  SELECT *, least(CAST(cap AS DOUBLE), weight * (SELECT max(quotient) FROM q)) AS target FROM q),
r AS (
  SELECT d.doc_id, d.size, CAST(t.source_size AS BIGINT) AS source_size, t.target, t.rank, t.weight, d.key,
         CAST(sum(d.size) OVER (PARTITION BY t.rank ORDER BY d.key, d.doc_id, d.size ROWS UNBOUNDED PRECEDING)
              - d.size AS BIGINT) AS before
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source),
e AS (
  SELECT *, greatest(least(CAST(round(target) AS BIGINT) - copy * source_size - before, size), 0) AS words,
         (copy * source_size + before + size) / weight AS finish
  FROM r, (VALUES (0), (1), (2)) c(copy)),
o AS (
  SELECT *, sum(words) OVER (ORDER BY finish, rank, key, doc_id, size, copy ROWS UNBOUNDED PRECEDING) - words AS position
  FROM e)
SELECT doc_id, any_value(size) AS size, any_value(source_size) AS source_size, any_value(target) AS target,
       CAST(sum(words) AS BIGINT) AS taken,
       CAST(min(position) FILTER (WHERE words > 0) AS BIGINT) AS first_position
FROM o GROUP BY doc_id, key, rank, before
"""

OP10 = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest
  FROM pages),
f AS (SELECT payload_digest, min(page_id) AS first_id FROM p WHERE payload_bytes >= 100 GROUP BY 1)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes, p.payload_digest,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN 'revisit' ELSE 'response' END AS record_type,
       CASE WHEN payload_bytes >= 100 AND page_id <> first_id THEN first_id END AS refers_to
FROM p LEFT JOIN f ON p.payload_digest = f.payload_digest
"""

OP4 = f"""
WITH RECURSIVE d AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format(c="text")}, '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
sh AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 1], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM sh GROUP BY 1),
pair AS (SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS c
         FROM sh a JOIN sh b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY 1, 2),
link AS (SELECT x, y FROM pair JOIN n p ON p.doc_id = x JOIN n q ON q.doc_id = y
         WHERE 100 * c >= 80 * (p.n + q.n - c)),
edge AS (SELECT x, y FROM link UNION ALL SELECT y, x FROM link),
reach AS (SELECT doc_id, doc_id AS r FROM n UNION SELECT reach.doc_id, y FROM reach JOIN edge ON r = x),
low AS (SELECT doc_id, min(r) AS component_id FROM reach GROUP BY 1)
SELECT d.doc_id, CAST(coalesce(n.n, 0) AS BIGINT) AS n_shingles,
       coalesce(component_id, d.doc_id) AS component_id, d.doc_id = coalesce(component_id, d.doc_id) AS kept
FROM d LEFT JOIN n ON d.doc_id = n.doc_id LEFT JOIN low ON d.doc_id = low.doc_id
"""

# Bytes as pairs of hexadecimal digits.
OP5 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
win AS (SELECT doc_id, p, substring(h, 2 * p + 1, 200) AS s
        FROM (SELECT doc_id, h, unnest(range(0, length(h) // 2 - 99)) AS p FROM d WHERE length(h) >= 200)),
again AS (SELECT doc_id, p FROM (SELECT doc_id, p, row_number() OVER (PARTITION BY s ORDER BY doc_id, p) AS k FROM win)
          WHERE k > 1),
edge AS (SELECT doc_id, p, CASE WHEN p - lag(p) OVER (PARTITION BY doc_id ORDER BY p) <= 100 THEN 0 ELSE 1 END AS new
         FROM again),
grp AS (SELECT doc_id, p, sum(new) OVER (PARTITION BY doc_id ORDER BY p) AS g FROM edge),
span AS (SELECT doc_id, min(p) AS a, max(p) + 100 AS z FROM grp GROUP BY doc_id, g),
part AS (
  SELECT doc_id, coalesce(lag(z) OVER w, 0) AS f, a AS t FROM span WINDOW w AS (PARTITION BY doc_id ORDER BY a)
  UNION ALL
  SELECT d.doc_id, coalesce(max(z), 0), length(any_value(h)) // 2 FROM d LEFT JOIN span ON d.doc_id = span.doc_id
  GROUP BY d.doc_id),
kept AS (SELECT part.doc_id, string_agg(substring(h, 2 * f + 1, 2 * (t - f)), '' ORDER BY f) AS k
         FROM part JOIN d ON part.doc_id = d.doc_id GROUP BY 1)
SELECT d.doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST((length(h) - length(k)) // 2 AS BIGINT) AS n_removed,
       (SELECT count(*) FROM span WHERE span.doc_id = d.doc_id) AS n_spans, sha256(unhex(k)) AS kept_sha256
FROM d JOIN kept ON d.doc_id = kept.doc_id
"""

# CRC-32 by bytes: tab holds the 256 remainders, {crc} takes the codes of an ASCII string s.
_CRC_TABLE = """crc AS (
  SELECT list(v ORDER BY i) AS tab
  FROM (SELECT i, list_reduce(list_prepend(CAST(i AS BIGINT), range(8)),
                              lambda a, b: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END) AS v
        FROM range(256) r(i)))"""


def _crc(s: str) -> str:
    return (f"xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split({s}, ''), "
            "lambda c: CAST(ord(c) AS BIGINT))), lambda a, b: xor(tab[(xor(a, b) & 255) + 1], a >> 8)), 4294967295)")


_WORD = "|".join("".join(c if c in "_?" else f"[{c.upper()}{c}]" for c in w)
                 for w in ("password", "passwd", "secret", "token", "api_?key"))
_SECRETS = [
    ("assign", rf"""({_WORD})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", "AKIA[A-Z0-9]+"),
    ("hex", "[0-9a-f]{32,}"),
    ("github", r"\bgh[pousr]_[A-Za-z0-9]{36}\b"),
    ("npm", r"\bnpm_[A-Za-z0-9]{36}\b"),
]
_MATCHES = " UNION ALL ".join(
    f"SELECT id, doc_id, {k} AS k, '{kind}' AS kind, regexp_extract_all(t, '{p}') AS hit, regexp_split_to_array(t, '{p}') AS gap FROM d"
    for k, (kind, p) in enumerate(_SECRETS))
_BASE62 = "0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz"

OP11 = f"""
WITH d AS (SELECT row_number() OVER () AS id, doc_id, coalesce(text, '') AS t FROM documents),
{_CRC_TABLE},
m AS ({_MATCHES}),
p AS (
  SELECT id, k, kind, hit[i] AS s,
         list_sum(list_transform(gap[1:i], lambda x: length(x)))
         + coalesce(list_sum(list_transform(hit[1:i - 1], lambda x: length(x))), 0) AS a
  FROM (SELECT *, unnest(range(1, len(hit) + 1)) AS i FROM m)),
c AS (
  SELECT *, CASE WHEN k >= 3 THEN {_crc("split_part(s, '_', 2)[1:30]")} END AS sum FROM p, crc),
ok AS (
  SELECT id, k, kind, a, concat(kind, ':', CAST(a AS BIGINT), ':', CAST(a + length(s) AS BIGINT)) AS span
  FROM c
  WHERE CASE kind WHEN 'assign' THEN length(regexp_extract(s, '{_SECRETS[0][1]}', 2)) >= 8
                  WHEN 'access' THEN length(s) >= 16
                  WHEN 'hex' THEN true
                  ELSE s[-6:] = array_to_string(list_transform([5, 4, 3, 2, 1, 0],
                       lambda e: '{_BASE62}'[CAST(sum // CAST(pow(62, e) AS BIGINT) % 62 AS BIGINT) + 1]), '') END),
g AS (
  SELECT id, string_agg(span, ',' ORDER BY a, k) AS spans,
         coalesce(string_agg(span, ',' ORDER BY a, k) FILTER (WHERE k < 3), '') AS base,
         {", ".join(f"count(*) FILTER (WHERE k = {k}) AS n_{kind}" for k, (kind, _) in enumerate(_SECRETS))}
  FROM ok GROUP BY id)
SELECT d.doc_id, {", ".join(f"CAST(coalesce(n_{kind}, 0) AS BIGINT) AS n_{kind}" for kind, _ in _SECRETS)},
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN g ON d.id = g.id
"""

OP12 = f"""
WITH {_CRC_TABLE},
t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, turn FROM conversations WHERE conv_id IS NOT NULL),
seq AS (
  SELECT conv_id, list({{'r': role, 't': text}} ORDER BY turn NULLS FIRST, role, sha256(concat(octet_length(encode(role)), ':', role, text))) AS s
  FROM t GROUP BY conv_id),
h AS (SELECT *, CAST({_crc("CAST(conv_id AS VARCHAR)")} % 9 AS BIGINT) AS h FROM seq, crc),
re AS (
  SELECT h.conv_id, list_concat(coalesce(b.s, [])[1:h.h], h.s[h.h + 1:]) AS s
  FROM h LEFT JOIN seq b ON b.conv_id = h.conv_id - h.conv_id % 5),
hit AS (
  SELECT conv_id, len(s) AS n, d, sha256(CAST(s[1:d] AS VARCHAR)) AS k, s[d].t AS last, sha256(CAST(s[1:d - 1] AS VARCHAR)) AS up
  FROM (SELECT *, unnest(range(0, len(s) + 1)) AS d FROM re)),
node AS (
  SELECT d, k, any_value(up) AS up, min(conv_id) AS conv_id, count(*) AS n_convs,
         CASE WHEN d = 0 THEN 0 ELSE any_value(octet_length(encode(last))) END AS bytes,
         sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (WHERE n = d), '')) AS ends_sha256
  FROM hit GROUP BY d, k),
kids AS (SELECT d - 1 AS d, up AS k, count(*) AS n FROM node WHERE d > 0 GROUP BY ALL),
full_node AS (
  SELECT node.*, coalesce(kids.n, 0) AS n_children FROM node LEFT JOIN kids ON node.d = kids.d AND node.k = kids.k),
anc AS (
  SELECT DISTINCT a.d, a.k, b.d AS bd, b.k AS bk
  FROM hit a JOIN hit b ON a.conv_id = b.conv_id AND b.d >= a.d),
sub AS (
  SELECT anc.d, anc.k, count(*) FILTER (WHERE n_children = 0) AS n_leaves, sum((n_convs - 1) * bytes) AS saved
  FROM anc JOIN full_node f ON f.d = bd AND f.k = bk GROUP BY ALL)
SELECT f.conv_id, CAST(f.d AS BIGINT) AS depth, p.conv_id AS parent_conv_id, CAST(f.n_convs AS BIGINT) AS n_convs,
       CAST(f.n_children AS BIGINT) AS n_children, CAST(n_leaves AS BIGINT) AS n_leaves,
       CAST(saved AS BIGINT) AS saved_tokens, f.ends_sha256
FROM full_node f JOIN sub ON f.d = sub.d AND f.k = sub.k
     LEFT JOIN node p ON p.d = f.d - 1 AND p.k = f.up AND f.d > 0
"""
