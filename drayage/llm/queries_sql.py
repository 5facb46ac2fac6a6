"""The text queries as SQL, where SQL can express them."""

# translate() leaves every character but A-Z alone, as the operators do.
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = f"""
WITH t AS (SELECT doc_id, {_LOWER} AS n FROM documents),
     h AS (SELECT doc_id, sha256(n) AS text_sha256 FROM t)
SELECT doc_id,
       first_value(doc_id) OVER w AS keep_id,
       count(*) OVER (PARTITION BY text_sha256) AS group_size,
       row_number() OVER w = 1 AS kept,
       text_sha256
FROM h
WINDOW w AS (PARTITION BY text_sha256 ORDER BY doc_id DESC NULLS LAST)
"""

OP4 = r"""
WITH rules(action, h, p) AS (
    VALUES ('allow', 'org', '/'), ('block', 'example.org', '/es/'), ('block', 'example.org', '/en/1'),
           ('allow', 'com', '/fr/'), ('block', 'com', '/de/')),
u AS (
    SELECT page_id,
           translate(regexp_extract(coalesce(url, ''), '^.*?://([^/?#]*)', 1, 's'),
                     'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
           regexp_extract(coalesce(url, ''), '^.*?://[^/?#]*([^?#]*)', 1, 's') AS path
    FROM pages),
d AS (SELECT DISTINCT host, path FROM u),
fit AS (
    SELECT host, path, action, h || p AS rule,
           row_number() OVER (PARTITION BY host, path
                              ORDER BY length(h || p) DESC, length(h) DESC, action DESC, h || p DESC) AS n
    FROM d JOIN rules ON (host = h OR host LIKE '%.' || h) AND starts_with(path, p))
SELECT page_id, u.host, u.path, rule, coalesce(action, 'allow') AS verdict
FROM u LEFT JOIN fit ON fit.host = u.host AND fit.path = u.path AND n = 1
"""

# (conv_id, turn) is unique and not null in the given tables
OP7 = """
WITH m AS (
    SELECT conv_id, turn, role, text, conv_id || ':' || turn AS id, conv_id || ':' || (turn - 1) AS before_id
    FROM conversations),
c AS (SELECT * FROM m WHERE role IN ('user', 'system')),
r AS (SELECT * FROM m WHERE role IS NULL OR role NOT IN ('user', 'system')),
e AS (
    SELECT coalesce(c.id, r.before_id) AS id,
           CASE c.role WHEN 'system' THEN 'configure' WHEN 'user' THEN 'reply' END AS name,
           c.turn AS call_turn, r.turn AS result_turn,
           CASE WHEN c.id IS NULL THEN 'orphan' WHEN r.id IS NULL THEN 'open' ELSE 'linked' END AS status,
           c.role AS role, c.text AS asked, r.text AS answered,
           c.role = 'user' AND c.turn > 0 AS needing, c.conv_id AS conv_id
    FROM c FULL JOIN r ON c.id = r.before_id)
SELECT id, name, call_turn, result_turn,
       CASE WHEN status <> 'orphan' THEN
           CASE WHEN needing AND conv_id || ':0' IN (SELECT id FROM c) THEN 1 ELSE 0 END END AS level,
       status, 1::BIGINT AS copies,
       name IS NULL OR coalesce(length(asked), 0) >= 1 AS valid,
       CASE WHEN name IS NULL OR length(asked) >= 1 THEN ''
            ELSE CASE role WHEN 'system' THEN '$.instructions' ELSE '$.prompt' END
                 || CASE WHEN asked IS NULL THEN ': not string' ELSE ': too short' END END AS errors,
       '{' || CASE WHEN name IS NULL THEN '' ELSE
           '"arguments":{' || CASE role WHEN 'system' THEN '"instructions":' ELSE '"prompt":' END
           || coalesce(to_json(asked)::VARCHAR, 'null') || '},' END
       || '"id":"' || id || '"'
       || CASE WHEN name IS NULL THEN '' ELSE ',"name":"' || name || '"' END
       || CASE WHEN needing THEN ',"needs":["' || conv_id || ':0"]' ELSE '' END
       || CASE WHEN result_turn IS NULL THEN '' ELSE ',"result":' || coalesce(to_json(answered)::VARCHAR, 'null') END
       || ',"status":"' || status || '"}' AS json
FROM e
"""

_TERMS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')"

# doc_id is unique and not null in the given tables, as is item_id
OP11 = f"""
WITH d AS (SELECT doc_id, {_TERMS} AS ts FROM documents),
     c AS (SELECT count(*) FILTER (len(ts) > 0) AS docs, sum(len(ts))::BIGINT AS terms FROM d),
     q AS (SELECT item_id, term, count(*) AS times
           FROM (SELECT item_id, unnest({_TERMS}) AS term FROM benchmark) GROUP BY ALL),
     f AS (SELECT doc_id, size, term, count(*) AS tf
           FROM (SELECT doc_id, len(ts) AS size, unnest(ts) AS term FROM d) GROUP BY ALL),
     w AS (SELECT term, floor(1000 * ln((2 * any_value(docs) + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
           FROM f, c WHERE term IN (SELECT term FROM q) GROUP BY term),
     s AS (SELECT item_id, doc_id,
                  sum(times * weight * ((1000000000 * tf) // (1000 * tf + 8 * (25 + (75 * size * docs) // terms))))::BIGINT
                      AS score
           FROM q JOIN w USING (term) JOIN f USING (term), c GROUP BY ALL),
     r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank
           FROM s WHERE score > 0)
SELECT item_id, rank, doc_id, score FROM r WHERE rank <= 10
"""

OP13 = r"""
WITH d AS (
    SELECT doc_id AS id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size FROM documents),
u AS (SELECT *, row_number() OVER (PARTITION BY source, id, size) AS copy FROM d),
p AS (SELECT *, ('0x' || substr(md5(coalesce(id::VARCHAR, '') || '|' || copy || '|mix'), 1, 15))::BIGINT AS place FROM u),
s AS (SELECT source, sum(size)::BIGINT AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS rank FROM p GROUP BY source),
w AS (SELECT *, [3, 1, 2][((rank - 1) % 3 + 1)::INTEGER] AS weight, 2 * source_size AS most FROM s),
o AS (SELECT *, row_number() OVER (ORDER BY most / weight, rank) AS n FROM w),
-- the level if all before are full
l AS (SELECT n, most, weight,
             ((SELECT sum(source_size) FROM s)::BIGINT * 150 / 100.0::DOUBLE
              - coalesce(sum(most) OVER (ORDER BY n ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)
             / sum(weight) OVER (ORDER BY n ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS level
      FROM o),
v AS (SELECT coalesce(min_by(level, n) FILTER (most > weight * level), 0) AS level FROM l),
t AS (SELECT source, source_size, rank, least(most::DOUBLE, weight * level) AS target FROM w, v),
q AS (SELECT p.*, t.source_size, t.rank, t.target, ceil(t.target)::BIGINT AS cut,
             sum(size) OVER (PARTITION BY t.rank ORDER BY place, id, size, copy) - size AS start
      FROM p JOIN t ON p.source IS NOT DISTINCT FROM t.source),
e AS (SELECT *, greatest(0, least(size, cut - start - pass * source_size))::BIGINT AS words,
             (start + pass * source_size)::BIGINT AS begun
      FROM q, (VALUES (0), (1)) AS x(pass)),
g AS (SELECT *, sum(words) OVER (ORDER BY (begun + words) / target, rank, place, id, size, copy, pass) - words AS position
      FROM e WHERE words > 0),
k AS (SELECT rank, id, size, copy,
             sum(greatest(0, least(words, (SELECT sum(source_size) FROM s)::BIGINT * 150 // 100 - position)))::BIGINT AS taken
      FROM g GROUP BY ALL)
SELECT q.id AS doc_id, q.size, q.source_size, q.target, coalesce(k.taken, 0) AS taken
FROM q LEFT JOIN k ON q.rank = k.rank AND q.id = k.id AND q.size = k.size AND q.copy = k.copy
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_exact_dedup": OP1, "op4_url_filter": OP4, "op7_tool_calls": OP7, "op11_lexical_search": OP11, "op13_mixing": OP13}
