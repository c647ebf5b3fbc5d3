"""The same results in DuckDB SQL, where SQL can express them."""

WORDS = r"regexp_extract_all(coalesce({}, ''), '[^\x20\x09-\x0D]+')"
LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP7 = f"""
WITH base AS (
  SELECT row_number() OVER () AS rid, doc_id, lang, source, coalesce(text, '') AS text, {WORDS.format("text")} AS w
  FROM documents),
tri AS (
  SELECT rid, i, row(w[i], w[i + 1], w[i + 2]) AS t
  FROM (SELECT rid, w, unnest(generate_series(1, len(w) - 2)) AS i FROM base)),
reps AS (
  SELECT rid, count(DISTINCT j) AS n_repeat_words
  FROM (SELECT rid, unnest([i, i + 1, i + 2]) AS j
        FROM (SELECT rid, i, count(*) OVER (PARTITION BY rid, t) AS c FROM tri) WHERE c > 1)
  GROUP BY rid),
lines AS (
  SELECT rid, count(*) AS n_lines, count(*) - count(DISTINCT l) AS n_dup_lines
  FROM (SELECT rid, unnest(string_split(text, chr(10))) AS l FROM base)
  WHERE regexp_matches(l, '[^\\x20\\x09-\\x0D]') GROUP BY rid),
counts AS (
  SELECT b.rid, doc_id, lang, source, len(w)::BIGINT AS n_words, length(array_to_string(w, ''))::BIGINT AS word_chars,
    len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols, coalesce(n_lines, 0)::BIGINT AS n_lines,
    coalesce(n_dup_lines, 0)::BIGINT AS n_dup_lines, coalesce(n_repeat_words, 0)::BIGINT AS n_repeat_words
  FROM base b LEFT JOIN reps USING (rid) LEFT JOIN lines USING (rid)),
rated AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
    1000 * n_symbols // greatest(n_words, 1) AS m_symbols, 1000 * n_repeat_words // greatest(n_words, 1) AS m_repeats,
    1000 * n_dup_lines // greatest(n_lines, 1) AS m_lines, 100 * word_chars // greatest(n_words, 1) AS m_length
  FROM counts),
long AS (
  SELECT lang, source, metric, v, greatest(length(bin(v)) - 6, 0)::INT AS e
  FROM (UNPIVOT (SELECT lang, source, m_symbols, m_repeats, m_lines, m_length FROM rated WHERE NOT base_failed)
        ON m_symbols, m_repeats, m_lines, m_length INTO NAME metric VALUE v)),
fine AS (SELECT lang, source, metric, (v >> e) << e AS b, count(*) AS n FROM long GROUP BY ALL),
levels AS (
  SELECT 1 AS lv, * FROM fine
  UNION ALL SELECT 2, lang, NULL, metric, b, sum(n) FROM fine GROUP BY lang, metric, b
  UNION ALL SELECT 3, NULL, NULL, metric, b, sum(n) FROM fine GROUP BY metric, b),
cum AS (
  SELECT *, sum(n) OVER (PARTITION BY lv, lang, source, metric ORDER BY b) AS upto,
    sum(n) OVER (PARTITION BY lv, lang, source, metric) AS total FROM levels),
q AS (
  SELECT lv, lang, source, metric, any_value(total) AS total, min(b) FILTER (4 * upto >= total) AS q1,
    min(b) FILTER (4 * upto >= 3 * total) AS q3 FROM cum GROUP BY lv, lang, source, metric),
far AS (
  SELECT *, 3 * (q3 - q1) AS width,
    CASE metric WHEN 'm_symbols' THEN 50 WHEN 'm_repeats' THEN 300 WHEN 'm_lines' THEN 300 ELSE 100 END AS least_ FROM q),
ends AS (
  SELECT lv, lang, source, metric, total, q3 + greatest(width, least_) AS hi,
    CASE WHEN metric = 'm_length' THEN q1 - greatest(width, least_) ELSE -1 END AS lo FROM far),
lim AS (
  SELECT a.lang, a.source, a.metric,
    CASE WHEN a.total >= 100 THEN a.hi WHEN b.total >= 100 THEN b.hi ELSE c.hi END AS hi,
    CASE WHEN a.total >= 100 THEN a.lo WHEN b.total >= 100 THEN b.lo ELSE c.lo END AS lo
  FROM ends a JOIN ends b ON a.lv = 1 AND b.lv = 2 AND a.lang IS NOT DISTINCT FROM b.lang AND a.metric = b.metric
    JOIN ends c ON c.lv = 3 AND c.metric = a.metric),
verdict AS (
  SELECT r.rid, bool_and(x.v BETWEEN lim.lo AND lim.hi) AS fits
  FROM (SELECT rid, lang, source, unnest(['m_symbols', 'm_repeats', 'm_lines', 'm_length']) AS metric,
          unnest([m_symbols, m_repeats, m_lines, m_length]) AS v FROM rated WHERE NOT base_failed) x
    JOIN rated r USING (rid)
    JOIN lim ON lim.lang IS NOT DISTINCT FROM x.lang AND lim.source IS NOT DISTINCT FROM x.source AND lim.metric = x.metric
  GROUP BY r.rid)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
  NOT base_failed AND coalesce(fits, false) AS kept
FROM rated LEFT JOIN verdict USING (rid)
"""

OP9 = f"""
WITH l AS (
  SELECT rid, doc_id, pos, line, {LOWER.format("trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} AS key
  FROM (SELECT rid, doc_id, unnest(ls) AS line, unnest(generate_series(1, len(ls))) AS pos
        FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents))),
k AS (SELECT key, min(doc_id) AS first FROM l WHERE length(key) >= 10 GROUP BY key HAVING count(DISTINCT doc_id) > 1)
SELECT doc_id, count(*)::BIGINT AS n_lines, (count(*) FILTER (k.key IS NOT NULL AND first <> doc_id))::BIGINT AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (k.key IS NULL OR first = doc_id), '')) AS kept_sha256
FROM l LEFT JOIN k USING (key) GROUP BY rid, doc_id
"""

OP10 = r"""
WITH w AS (
  SELECT row_number() OVER () AS rid, doc_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT item_id, regexp_extract_all(LOWERED, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
win AS (
  SELECT DISTINCT item_id, n, w[s:s + n - 1] AS x
  FROM (SELECT item_id, w, least(10, len(w)) AS n, unnest(generate_series(1, len(w) - least(10, len(w)) + 1)) AS s
        FROM i WHERE len(w) > 0)),
n AS (SELECT DISTINCT n FROM win),
hit AS (
  SELECT rid, s, win.n, item_id
  FROM (SELECT rid, n, s, w[s:s + n - 1] AS x
        FROM (SELECT rid, w, n, unnest(generate_series(1, len(w) - n + 1)) AS s FROM w, n WHERE len(w) >= n)) d
    JOIN win ON d.n = win.n AND d.x = win.x),
spots AS (SELECT rid, count(DISTINCT p) AS n_hit FROM (SELECT rid, unnest(generate_series(s, s + n - 1)) AS p FROM hit) GROUP BY rid),
items AS (
  SELECT rid, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids
  FROM (SELECT DISTINCT rid, item_id::VARCHAR AS item FROM hit) GROUP BY rid)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM w LEFT JOIN spots USING (rid) LEFT JOIN items USING (rid)
""".replace("LOWERED", LOWER.format("coalesce(text, '')"))

OP8 = """
WITH p AS (SELECT page_id, url AS uri, coalesce(html, '') AS html, octet_length(encode(coalesce(html, '')))::BIGINT AS payload_bytes FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY html) AS first FROM p)
SELECT page_id, payload_bytes, sha256(html) AS payload_digest,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND first <> page_id THEN first END AS refers_to, coalesce(uri, '') AS uri, true AS ok
FROM f
"""

OP5 = """
WITH m AS (SELECT conv_id, turn, role, coalesce(text, '') AS text FROM conversations),
call AS (
  SELECT u.*, a.text AS answer, a.turn IS NOT NULL AS linked, 'c' || u.conv_id || '_' || u.turn AS call_id
  FROM m u LEFT JOIN m a ON a.role = 'assistant' AND a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user'),
lost AS (
  SELECT a.*, 'c' || a.conv_id || '_' || (a.turn - 1) AS call_id FROM m a
  WHERE a.role = 'assistant' AND NOT EXISTS (FROM m u WHERE u.role = 'user' AND u.conv_id = a.conv_id AND u.turn = a.turn - 1))
SELECT conv_id, turn AS at_turn, 0 AS level, 0 AS number, 0 AS step, 'message' AS kind, NULL AS call_id, true AS linked,
  '' AS problems,
  CASE WHEN role = 'user' THEN '{"content":"","role":"assistant"}'
       ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
FROM m WHERE role <> 'assistant'
UNION ALL
SELECT conv_id, turn, 0, 0, 1, 'call', call_id, linked,
  concat_ws('; ', CASE WHEN NOT linked THEN 'no result' END, CASE WHEN length(text) > 300 THEN 'over question' END),
  '{"arguments":{"question":' || to_json(text) || ',"turn":' || turn || '},"id":"' || call_id || '","name":"reply"}'
FROM call
UNION ALL
SELECT conv_id, turn, 0, 0, 2, 'result', call_id, true, '',
  '{"content":' || to_json(answer) || ',"role":"tool","tool_call_id":"' || call_id || '"}'
FROM call WHERE linked
UNION ALL
SELECT conv_id, turn, 0, 0, 2, 'result', call_id, false, 'no call for it',
  '{"content":' || to_json(text) || ',"role":"tool","tool_call_id":"' || call_id || '"}'
FROM lost
"""

OP11 = r"""
WITH RECURSIVE crc AS (
  SELECT list_transform(range(0, 256), lambda i: list_reduce(list_prepend(i, range(0, 8)),
    lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END)) AS t),
runs AS (
  SELECT doc_id, run, count(*) AS n
  FROM (SELECT coalesce(doc_id::VARCHAR, '') AS doc_id, unnest(regexp_extract_all(LOWERED, '[A-Za-z\x{00C0}-\x{00FF}]+')) AS run
        FROM documents) GROUP BY ALL),
bytes AS (
  SELECT run, n, flatten(list_transform(string_split(doc_id || ':' || run, ''),
    lambda x: CASE WHEN unicode(x) < 128 THEN [unicode(x)::BIGINT] ELSE [192 | (unicode(x) >> 6), 128 | (unicode(x) & 63)]::BIGINT[] END)) AS b
  FROM runs),
hashed AS (
  SELECT run, n, xor(4294967295, list_reduce(list_prepend(4294967295, b),
    lambda c, x: xor(t[(xor(c, x) & 255) + 1], c >> 8))) AS h FROM bytes, crc),
vocab AS MATERIALIZED (
  SELECT word, sum(n)::BIGINT AS n
  FROM (SELECT n, CASE WHEN h % 97 = 0 THEN left(run, (h % length(run))::INT) || substr(run, (h % length(run))::INT + 2) ELSE run END AS word
        FROM hashed)
  WHERE length(word) >= 5 GROUP BY word HAVING sum(n) >= 3),
cut AS (SELECT word, i, left(word, i::INT) || substr(word, i::INT + 2) AS rest FROM (SELECT word, unnest(range(0, length(word))) AS i FROM vocab)),
pairs AS (
  SELECT a.word AS a, b.word AS b FROM cut a JOIN cut b ON a.i = b.i AND a.rest = b.rest AND a.word < b.word
  UNION SELECT c.word, v.word FROM cut c JOIN vocab v ON v.word = c.rest),
near AS (SELECT a AS word, b AS other FROM pairs UNION SELECT b, a FROM pairs),
most AS (
  SELECT v.word, v.n, count(o.word) AS n_near, max(o.n) AS m
  FROM vocab v LEFT JOIN near USING (word) LEFT JOIN vocab o ON o.word = near.other GROUP BY v.word, v.n),
told AS (
  SELECT s.word, s.n, s.n_near, CASE WHEN s.m >= 2 * s.n THEN s.m END AS form_n,
    CASE WHEN s.m >= 2 * s.n THEN (SELECT min(o.word) FROM near JOIN vocab o ON o.word = near.other WHERE near.word = s.word AND o.n = s.m) END AS form
  FROM most s),
way AS (
  SELECT word, word AS at_ FROM told
  UNION ALL SELECT way.word, told.form FROM way JOIN told ON told.word = way.at_ WHERE told.form IS NOT NULL)
SELECT told.word, told.form, way.at_ AS root, told.n, told.n_near, told.form_n
FROM told JOIN way USING (word) JOIN told e ON e.word = way.at_ WHERE e.form IS NULL
""".replace("LOWERED", LOWER.format("coalesce(text, '')"))


def op12(rounds: int = 10) -> str:
    """Every round spelled out: the nearest centroid, then floors of means."""
    apart = "list_sum(list_transform(range(1, 65), lambda i: (v[i] - c[i]) * (v[i] - c[i])))::BIGINT"
    nearest = f"""SELECT rid, arg_min(k, (d, k)) AS k, min(d) AS d
  FROM (SELECT rid, k, {apart} AS d FROM vec, c{{0}}) GROUP BY rid"""
    sql = """
WITH vec AS MATERIALIZED (
  SELECT row_number() OVER () AS rid, vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)::BIGINT) AS v
  FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NOT NULL AND isfinite(x))) = 64),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, v) - 1 AS k, v AS c
  FROM (SELECT v, sha256('3:' || coalesce(vec_id::VARCHAR, '')) AS h FROM vec ORDER BY h, v LIMIT 8)),"""
    for r in range(rounds):
        sql += f"""
a{r} AS MATERIALIZED ({nearest.format(r)}),
s{r} AS (
  SELECT k, i, sum(x) AS s, count(*) AS n
  FROM (SELECT k, unnest(v) AS x, unnest(range(1, 65)) AS i FROM a{r} JOIN vec USING (rid)) GROUP BY k, i),
c{r + 1} AS MATERIALIZED (
  SELECT k, coalesce(m, c) AS c
  FROM c{r} LEFT JOIN (SELECT k, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM s{r} GROUP BY k) USING (k)),"""
    return sql + f"""
z AS MATERIALIZED ({nearest.format(rounds)})
SELECT vec_id, k::INT AS cluster, d AS distance, (sum(d) OVER (PARTITION BY k))::BIGINT AS cluster_inertia,
  (sum(d) OVER ())::BIGINT AS inertia, sha256(array_to_string(c, ',')) AS centroid_sha256
FROM z JOIN vec USING (rid) JOIN c{rounds} USING (k)
"""


OP13 = r"""
WITH p AS (
  SELECT page_id, coalesce(url, '') AS url, LOWERED AS host,
    coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 2), '') AS path FROM pages),
c AS (
  SELECT *, CASE WHEN contains(url, '://') THEN
    regexp_replace(regexp_replace(regexp_replace(host, '(?s)^.*@', ''), '\.?(:(80|443)?)?$', ''), '^www\.', '')
    || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '')
    || CASE WHEN len(query) > 0 THEN '?' || array_to_string(query, '&') ELSE '' END END AS canon
  FROM (SELECT *, list_sort(list_filter(string_split(regexp_extract(url, '(?s)^.*?://[^?#]*\?([^#]*)', 1), '&'),
          lambda x: x <> '' AND NOT regexp_full_match(x, '(?s)(utm_[^=]*|gclid|fbclid|ref)(=.*)?'))) AS query FROM p)),
listed AS (SELECT DISTINCT canon FROM c WHERE regexp_matches(host, '(^|[.-])(adult|ads|bets|casino|pills|spam)([.-]|$)')),
r AS (SELECT * FROM (VALUES ('org', '/', 'allow'), ('example.org', '/es/', 'block'), ('example.org', '/en/1', 'block'),
  ('com', '/fr/', 'allow'), ('com', '/de/', 'block')) AS r(at_, start, says)),
fit AS (
  SELECT page_id, host, path, arg_max(at_ || start, length(at_ || start)) AS rule, arg_max(says, length(at_ || start)) AS says
  FROM (SELECT DISTINCT page_id, host, path FROM c) JOIN r ON ends_with('.' || host, '.' || at_) AND starts_with(path, start)
  GROUP BY ALL)
SELECT c.page_id, c.host, c.path, fit.rule, coalesce(fit.says, CASE WHEN l.canon IS NULL THEN 'allow' ELSE 'block' END) AS verdict,
  l.canon IS NOT NULL AS listed
FROM c LEFT JOIN fit ON fit.page_id IS NOT DISTINCT FROM c.page_id AND fit.host = c.host AND fit.path = c.path
  LEFT JOIN listed l ON l.canon = c.canon
""".replace("LOWERED", LOWER.format("coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)([^?#]*)', 1), '')"))

ORACLES = {"op5_chat_tools": OP5, "op8_warc": OP8, "op7_quality_rules": OP7, "op9_line_dedup": OP9, "op10_decontaminate": OP10}
ORACLES |= {"op11_spelling": OP11, "op12_clusters": op12(), "op13_url_filter": OP13}
