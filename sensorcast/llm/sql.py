"""DuckDB statements of the queries that SQL can express."""

_S = r"[\x20\x09-\x0D]"
_W = r"[^\x20\x09-\x0D]+"
_LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

MIX = rf"""
WITH RECURSIVE sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{_W}'))::BIGINT AS size,
         ('0x' || substr(md5('0:' || coalesce(doc_id::VARCHAR, 'null:' || md5(coalesce(text, '')))), 1, 15))::BIGINT AS key
  FROM documents),
sources AS (
  SELECT source, sum(size)::BIGINT AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS weight
  FROM sized GROUP BY source),
-- a source is capped once its share of what is left exceeds three times its size
rounds AS (
  SELECT 0 AS step, list({{'s': source, 'n': source_size, 'w': weight, 'capped': false}}) AS l FROM sources
  UNION ALL
  SELECT step + 1, list_transform(l, lambda x: {{'s': x.s, 'n': x.n, 'w': x.w, 'capped': x.capped
           OR x.w * (list_sum(list_transform(l, lambda y: y.n))
                     - coalesce(list_sum(list_transform(list_filter(l, lambda y: y.capped), lambda y: 3 * y.n)), 0))
              > 3 * x.n * list_sum(list_transform(list_filter(l, lambda y: NOT y.capped), lambda y: y.w))}})
  FROM rounds WHERE step < (SELECT count(*) FROM sources)),
final AS (SELECT unnest(l) AS x FROM (SELECT l FROM rounds ORDER BY step DESC LIMIT 1)),
open AS (
  SELECT (sum((x).n) - coalesce(sum(3 * (x).n) FILTER (WHERE (x).capped), 0))::BIGINT AS rest,
         coalesce(sum((x).w) FILTER (WHERE NOT (x).capped), 1)::BIGINT AS w FROM final),
targets AS (
  SELECT (x).s AS source, (x).n::BIGINT AS source_size,
         CASE WHEN (x).capped THEN (3 * (x).n)::DOUBLE
              ELSE ((x).w * rest)::DOUBLE / w::DOUBLE END AS target
  FROM final, open),
placed AS (
  SELECT s.*, t.source_size, t.target,
         coalesce(sum(size) OVER (PARTITION BY s.source ORDER BY key, doc_id, size
                                  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM sized s JOIN targets t ON s.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       (CASE WHEN size = 0 THEN 0 ELSE (floor(target)::BIGINT // source_size) * size
        + greatest(0, least(size, floor(target)::BIGINT % source_size - start)) END)::BIGINT AS taken
FROM placed
"""

URLS = f"""
WITH u AS (
  SELECT page_id, {_LOWER.format("coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 1), '')")} AS host,
         coalesce(regexp_extract(url, '://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
r(h, p, v) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'),
  ('www.example.com', '/en/', 'allow'), ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
judged AS (
  SELECT u.*, (SELECT max({{'n': length(h || p), 'rule': h || p, 'v': v}}) FROM r
               WHERE (u.host = h OR ends_with(u.host, '.' || h)) AND starts_with(u.path, p)) AS best
  FROM u)
SELECT page_id, host, path, best.rule AS rule, coalesce(best.v, 'allow') AS verdict FROM judged
"""

def _jaccard(n: int, percent: int, rest: str = "") -> str:
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all({_LOWER.format("coalesce(text, '')")}, '{_W}') AS w FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) = 0 THEN []
    WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(w[i:i + {n - 1}], ' ')) END) AS s
  FROM words),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (
  SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c
  FROM shingles x JOIN shingles y ON x.s = y.s AND x.doc_id < y.doc_id GROUP BY ALL),
links AS (
  SELECT a, b FROM common JOIN sizes p ON p.doc_id = a JOIN sizes q ON q.doc_id = b
  WHERE 100 * c >= {percent} * (p.n + q.n - c)),
edges AS (SELECT a, b FROM links UNION SELECT b, a FROM links),
reach(node, other) AS (
  SELECT doc_id, doc_id FROM documents
  UNION SELECT r.node, e.b FROM reach r JOIN edges e ON e.a = r.other)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, c.component_id{rest}
FROM documents d LEFT JOIN sizes s ON s.doc_id = d.doc_id
JOIN (SELECT node, min(other) AS component_id FROM reach GROUP BY node) c ON c.node = d.doc_id
"""


JACCARD = _jaccard(5, 80)
NEAR = _jaccard(3, 85, ", d.doc_id = c.component_id AS kept")

REPEATS = rf"""
WITH docs AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_W}') AS w FROM documents),
windows AS (
  SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS s
  FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM docs WHERE len(w) >= 13)),
firsts AS (SELECT s, min(doc_id) AS holder FROM windows GROUP BY s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + 13)) AS p
  FROM windows JOIN firsts USING (s) WHERE holder < doc_id),
words AS (SELECT doc_id, unnest(w) AS word, unnest(range(1, len(w) + 1)) AS p FROM docs),
kept AS (
  SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY p) AS t
  FROM words ANTI JOIN gone USING (doc_id, p) GROUP BY doc_id)
SELECT doc_id, len(w)::BIGINT AS n_words, (len(w) - coalesce(n, 0))::BIGINT AS n_removed,
       sha256(coalesce(t, '')) AS kept_sha256
FROM docs LEFT JOIN kept USING (doc_id)
"""

LINES = rf"""
WITH docs AS (
  SELECT doc_id, text, string_split(text, chr(10)) AS every,
         list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) AS l
  FROM documents),
-- a worded line has a character, so a run of 60 lines has 60 and longer ones add nothing
runs AS (
  SELECT doc_id, i, len, md5(array_to_string(l[i:i + len - 1], chr(10))) AS s,
         list_sum(list_transform(l[i:i + len - 1], lambda x: length(x))) AS chars
  FROM (SELECT doc_id, l, i, unnest(range(1, least(60, len(l) - i + 1) + 1)) AS len
        FROM (SELECT doc_id, l, unnest(range(1, len(l) + 1)) AS i FROM docs))),
firsts AS (SELECT len, s, min({{'d': doc_id, 'i': i}}) AS first FROM runs GROUP BY len, s),
gone AS (
  SELECT DISTINCT doc_id, unnest(range(i, i + len)) AS seq
  FROM runs JOIN firsts USING (len, s) WHERE {{'d': doc_id, 'i': i}} > first AND chars >= 60),
lines AS (
  SELECT doc_id, p, every[p] AS line, regexp_matches(every[p], '[^\x20\x09-\x0D]') AS worded,
         sum(regexp_matches(every[p], '[^\x20\x09-\x0D]')::INT) OVER (PARTITION BY doc_id ORDER BY p) AS seq
  FROM (SELECT doc_id, every, unnest(range(1, len(every) + 1)) AS p FROM docs)),
kept AS (
  SELECT doc_id, string_agg(line, chr(10) ORDER BY p) FILTER (WHERE NOT removed) AS t,
         count(*) FILTER (WHERE removed) AS n_removed
  FROM (SELECT l.*, worded AND g.seq IS NOT NULL AS removed
        FROM lines l LEFT JOIN gone g ON g.doc_id = l.doc_id AND g.seq = l.seq) GROUP BY doc_id)
SELECT d.doc_id, coalesce(len(every), 0)::BIGINT AS n_lines, coalesce(n_removed, 0)::BIGINT AS n_removed,
       CASE WHEN text IS NULL THEN NULL ELSE sha256(coalesce(t, '')) END AS kept_sha256
FROM docs d LEFT JOIN kept USING (doc_id)
"""

# The unsigned CRC-32 of a text's UTF-8 bytes, with its table built by the rule.
_CRC_TABLE = """crc_table AS (
  SELECT list_transform(range(256), lambda i: list_reduce(list_concat([i], range(8)), lambda c, k:
           CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END)) AS crc)"""


def _crc32(text: str) -> str:
    byte_list = (f"list_transform(range(0, octet_length(encode({text}))), "
                 f"lambda i: ('0x' || substr(hex(encode({text})), 2 * i + 1, 2))::BIGINT)")
    return (f"xor(list_reduce(list_concat([4294967295::BIGINT], {byte_list}), "
            "lambda c, b: xor(c >> 8, crc[(xor(c, b) & 255) + 1])), 4294967295)")


SPELLING = rf"""
WITH RECURSIVE {_CRC_TABLE},
runs AS (
  SELECT doc_id, unnest(regexp_extract_all({_LOWER.format("text")}, '[A-Za-zÀ-ÿ]+')) AS run FROM documents),
hashed AS (
  SELECT run, {_crc32("coalesce(doc_id::VARCHAR, '') || ':' || run")} AS h, c
  FROM (SELECT doc_id, run, count(*) AS c FROM runs GROUP BY ALL), crc_table),
words AS (
  SELECT word, sum(c)::BIGINT AS n FROM (
    SELECT CASE WHEN h % 97 = 0 THEN run[1:(h % length(run))] || run[(h % length(run)) + 2:] ELSE run END AS word, c
    FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(c) >= 3),
less AS (
  SELECT word, i, word[1:i] || word[i + 2:] AS rest
  FROM (SELECT word, unnest(range(length(word))) AS i FROM words)),
pairs AS (
  SELECT x.word AS a, y.word AS b FROM less x JOIN less y ON x.i = y.i AND x.rest = y.rest AND x.word <> y.word
  UNION SELECT l.word, w.word FROM less l JOIN words w ON w.word = l.rest
  UNION SELECT w.word, l.word FROM less l JOIN words w ON w.word = l.rest),
near AS (
  SELECT a AS word, count(*) AS n_near, max(n) AS form_n, arg_min(b, (-n, b)) AS form
  FROM pairs JOIN words ON word = b GROUP BY a),
found AS (
  SELECT w.word, w.n, coalesce(n_near, 0)::BIGINT AS n_near, CASE WHEN form_n >= 2 * n THEN form END AS form,
         CASE WHEN form_n >= 2 * n THEN form_n END AS form_n
  FROM words w LEFT JOIN near USING (word)),
chain(word, root) AS (
  SELECT word, word FROM found
  UNION SELECT c.word, f.form FROM chain c JOIN found f ON f.word = c.root WHERE f.form IS NOT NULL)
SELECT f.*, c.root FROM found f JOIN chain c ON c.word = f.word JOIN found r ON r.word = c.root WHERE r.form IS NULL
"""

TRIE = rf"""
WITH {_CRC_TABLE},
ids AS (
  SELECT conv_id, turn, octet_length(encode(coalesce(text, ''))) AS b,
         md5(length(coalesce(role, ''))::VARCHAR || ':' || coalesce(role, '') || coalesce(text, '')) AS id
  FROM conversations WHERE conv_id IS NOT NULL),
convs AS (
  SELECT conv_id, list({{'id': id, 'b': b}} ORDER BY turn NULLS FIRST, id) AS l FROM ids GROUP BY conv_id),
heads AS (SELECT *, {_crc32("conv_id::VARCHAR")} % 9 AS h FROM convs, crc_table),
whole AS (
  SELECT c.conv_id, list_concat(coalesce(s.l[1:c.h], []), c.l[c.h + 1:]) AS l
  FROM heads c LEFT JOIN convs s ON s.conv_id = c.conv_id - c.conv_id % 5),
firsts AS (
  SELECT conv_id, d, md5(array_to_string(list_transform(l[1:d], lambda x: x.id), '')) AS k,
         CASE WHEN d > 0 THEN md5(array_to_string(list_transform(l[1:d - 1], lambda x: x.id), '')) END AS up,
         CASE WHEN d > 0 THEN l[d].b ELSE 0 END AS b, d = len(l) AS ends
  FROM (SELECT conv_id, l, unnest(range(len(l) + 1)) AS d FROM whole)),
nodes AS (
  SELECT d, k, min(conv_id) AS conv_id, any_value(up) AS up, count(*) AS n, any_value(b) AS b,
         coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE ends), '') AS ended
  FROM firsts GROUP BY d, k),
family AS (
  SELECT v.*, p.conv_id AS parent_conv_id, coalesce(c.n_children, 0) AS n_children
  FROM nodes v LEFT JOIN nodes p ON p.d = v.d - 1 AND p.k = v.up
  LEFT JOIN (SELECT d - 1 AS d, up AS k, count(*) AS n_children FROM nodes GROUP BY ALL) c ON c.d = v.d AND c.k = v.k),
sums AS (
  SELECT a.d, a.k, sum((u.n - 1) * u.b) AS saved, count(*) FILTER (WHERE u.n_children = 0) AS leaves
  FROM family u JOIN firsts a ON a.conv_id = u.conv_id AND a.d <= u.d GROUP BY ALL)
SELECT conv_id, f.d::BIGINT AS depth, parent_conv_id, n::BIGINT AS n_convs, n_children::BIGINT AS n_children,
       leaves::BIGINT AS n_leaves, saved::BIGINT AS saved_tokens, sha256(ended) AS ends_sha256
FROM family f JOIN sums s ON s.d = f.d AND s.k = f.k
"""
