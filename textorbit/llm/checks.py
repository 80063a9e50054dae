"""DuckDB queries for the results of the operators' queries, written on their own."""

LICENSES = r"""
WITH lines AS (
  SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS n
  FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), plain AS (
  SELECT doc_id, n, trim(regexp_replace(regexp_replace(
    translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '^[ \t\r#*/;-]*((copyright[ \t]*(\(c\)|©|:|[0-9]|by )|\(c\)[ \t]|©|all rights reserved).*)$', '', 'g'),
    '[^\p{L}\p{N}]+', ' ', 'g')) AS line
  FROM lines
), usual AS (
  SELECT doc_id, n, array_to_string(list_transform(string_split(line, ' '), lambda w: CASE w
    WHEN 'acknowledgement' THEN 'acknowledgment' WHEN 'authorisation' THEN 'authorization'
    WHEN 'authorised' THEN 'authorized' WHEN 'favour' THEN 'favor' WHEN 'fulfil' THEN 'fulfill'
    WHEN 'judgement' THEN 'judgment' WHEN 'licence' THEN 'license' WHEN 'licenced' THEN 'licensed'
    WHEN 'licences' THEN 'licenses' WHEN 'noncommercial' THEN 'non commercial'
    WHEN 'organisation' THEN 'organization' WHEN 'recognise' THEN 'recognize'
    WHEN 'sublicence' THEN 'sublicense' WHEN 'whilst' THEN 'while' WHEN 'https' THEN 'http' ELSE w END), ' ') AS line
  FROM plain WHERE line <> ''
), notices(license_id, line) AS (VALUES
  ('MIT', 'released under the mit license'), ('MIT', 'licensed under the mit license'),
  ('Apache-2.0', 'licensed under the apache license version 2 0'),
  ('Apache-2.0', 'spdx license identifier apache 2 0'),
  ('GPL-3.0', 'this work is licensed under the gnu general public license version 3'),
  ('GPL-3.0', 'spdx license identifier gpl 3 0'),
  ('CC-BY-NC-4.0', 'licensed under cc by nc 4 0'), ('CC-BY-4.0', 'licensed under cc by 4 0'),
  ('CC0-1.0', 'released into the public domain under cc0 1 0')
), texts(license_id, line, digest) AS (
  SELECT license_id, line, md5(line) FROM notices
  UNION ALL VALUES ('MIT', '', '04ddd61083899c2a5ef03d9fe09b79c9'), ('ISC', '', 'b6ab23f33a368e7f225abed7065c8009'), ('Zlib', '', '6df2a895c31891fec159c01a49b2d3cf')
), named AS (
  SELECT doc_id, string_agg(DISTINCT license_id, ',' ORDER BY license_id) AS notices, count(*) AS n_notices
  FROM usual JOIN notices USING (line) GROUP BY doc_id
), wholes AS (
  SELECT doc_id, md5(string_agg(line, ' ' ORDER BY n)) AS digest FROM usual GROUP BY doc_id
), are AS (
  SELECT doc_id, min(license_id) AS license_id FROM wholes JOIN texts USING (digest) GROUP BY doc_id
)
SELECT doc_id, license_id, coalesce(notices, '') AS notices, coalesce(n_notices, 0)::BIGINT AS n_notices
FROM documents LEFT JOIN are USING (doc_id) LEFT JOIN named USING (doc_id)
"""

CHATS = r"""
WITH turns AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), walked AS (
  SELECT *, coalesce(lag(role) OVER w, '^') AS state, lead(role) OVER w IS NULL AS is_last,
    row_number() OVER w AS place,
    length(regexp_replace(text, '(\\|</?s>|\[/?(SYS|INST|ROLE)\]|\[ANS\]|\[:\])', '\1.', 'g')) AS quoted,
    CASE role WHEN 'system' THEN 13 WHEN 'user' THEN 15 WHEN 'assistant' THEN 10
      ELSE 18 + length(role) END AS marks
  FROM turns WINDOW w AS (PARTITION BY conv_id ORDER BY turn, role, text)
), faults AS (
  SELECT conv_id, place, CASE
    WHEN (state = '^' AND role IN ('system', 'user')) OR (state = 'system' AND role = 'user')
      OR (state = 'user' AND role = 'assistant') OR (state = 'assistant' AND role = 'user') THEN NULL
    ELSE CASE role WHEN '' THEN 'no role' ELSE role END || ' after '
      || CASE state WHEN '^' THEN 'the start' WHEN '' THEN 'no role' ELSE state END END AS problem FROM walked
  UNION ALL
  SELECT conv_id, place + 0.5, 'ends after ' || CASE role WHEN '' THEN 'no role' ELSE role END
  FROM walked WHERE is_last AND role <> 'assistant'
), first_faults AS (
  SELECT conv_id, arg_min(problem, place) AS problem FROM faults WHERE problem IS NOT NULL GROUP BY conv_id
), chats AS (
  SELECT conv_id, count(*) AS n_turns,
    sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY place)) AS turns_sha256,
    coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
    sha256(coalesce(string_agg(text, '' ORDER BY place) FILTER (role = 'assistant'), '')) AS loss_sha256,
    (3 + sum(quoted + marks))::BIGINT AS formatted_chars
  FROM walked GROUP BY conv_id
)
SELECT chats.*, problem FROM chats LEFT JOIN first_faults USING (conv_id)
"""

MIXING = r"""
WITH docs AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source,
    CASE coalesce(try_cast(nullif(regexp_extract(source, '([0-9]+)$', 1), '') AS BIGINT) // 5 % 4, 0)
      WHEN 0 THEN 'web' WHEN 1 THEN 'forum' WHEN 2 THEN 'books' ELSE 'code' END AS domain,
    (strlen(coalesce(text, '')) + 3) // 4 AS tokens
  FROM documents
), leaves AS (
  SELECT domain, lang, source, sum(tokens)::HUGEINT AS total,
    sum(CASE WHEN domain = 'books' AND lang = 'fr' THEN 0 ELSE 2 * tokens END)::HUGEINT AS capacity,
    CASE WHEN domain = 'web' AND lang = 'en' AND source = 'src0' THEN 3 ELSE 1 END AS weight
  FROM docs GROUP BY ALL
), domains AS (
  SELECT domain, sum(capacity) AS capacity, (SELECT sum(total) * 3 // 5 FROM leaves) AS budget,
    CASE domain WHEN 'web' THEN 4 WHEN 'forum' THEN 2 WHEN 'books' THEN 3 ELSE 1 END AS weight
  FROM leaves GROUP BY domain
), d1 AS (
  SELECT *, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM domains WINDOW w AS (ORDER BY capacity / weight, domain)
), d2 AS (SELECT *, capacity * heavy <= rest * weight AS is_full FROM d1
), d3 AS (
  SELECT domain, CASE WHEN is_full THEN capacity ELSE (budget - sum(if(is_full, capacity, 0)) OVER ()) * weight
    // greatest(sum(if(is_full, 0, weight)) OVER (), 1) END AS budget FROM d2
), langs AS (
  SELECT domain, lang, sum(leaves.capacity) AS capacity, any_value(d3.budget) AS budget,
    CASE WHEN domain = 'books' AND lang = 'en' THEN 4 ELSE
    CASE lang WHEN 'en' THEN 5 WHEN 'de' THEN 2 WHEN 'fr' THEN 2 ELSE 1 END END AS weight
  FROM leaves JOIN d3 USING (domain) GROUP BY domain, lang
), l1 AS (
  SELECT *, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM langs WINDOW w AS (PARTITION BY domain ORDER BY capacity / weight, lang)
), l2 AS (SELECT *, capacity * heavy <= rest * weight AS is_full FROM l1
), l3 AS (
  SELECT domain, lang, CASE WHEN is_full THEN capacity ELSE
    (budget - sum(if(is_full, capacity, 0)) OVER (PARTITION BY domain)) * weight
    // greatest(sum(if(is_full, 0, weight)) OVER (PARTITION BY domain), 1) END AS budget FROM l2
), s0 AS (SELECT leaves.*, budget FROM leaves JOIN l3 USING (domain, lang)
), s1 AS (
  SELECT *, budget - coalesce(sum(capacity) OVER (w ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS rest,
    sum(weight) OVER (w ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS heavy
  FROM s0 WINDOW w AS (PARTITION BY domain, lang ORDER BY capacity / weight, source)
), s2 AS (SELECT *, capacity * heavy <= rest * weight AS is_full FROM s1
), s3 AS (
  SELECT domain, lang, source, total, CASE WHEN is_full THEN capacity ELSE
    (budget - sum(if(is_full, capacity, 0)) OVER (PARTITION BY domain, lang)) * weight
    // greatest(sum(if(is_full, 0, weight)) OVER (PARTITION BY domain, lang), 1) END AS budget FROM s2
), plan AS (
  SELECT *, if(total > 0, budget // greatest(total, 1), 0) AS whole FROM s3
), ranked AS (
  SELECT doc_id, domain, lang, source, tokens, whole, budget - whole * total AS rest,
    sum(tokens) OVER (PARTITION BY domain, lang, source
      ORDER BY md5('7:' || whole::VARCHAR || ':' || doc_id::VARCHAR), doc_id, tokens
      ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS reached
  FROM docs JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, tokens, (whole + if(rest > 0 AND reached <= rest, 1, 0))::BIGINT AS copies
FROM ranked
"""

REVISITS = r"""
WITH days AS (
  SELECT page_id, url, md5(html) AS tag, strlen(html) AS size,
    TIMESTAMP '2024-01-01' + to_days((page_id % 365)::INT) + to_seconds(page_id % 86400) AS day
  FROM pages
), spelled AS (
  SELECT *, day + to_days(if(page_id % 11 = 0, -3, page_id % 7 + 1)::INT) AS later, CASE page_id % 3 WHEN 0 THEN url
    WHEN 1 THEN regexp_replace(url, '^https?://', 'HTTPS://WWW.') ELSE url || '#again' END AS again
  FROM days
), addresses AS (
  SELECT page_id, which, regexp_replace(regexp_replace(trim(address), '#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS a
  FROM (SELECT page_id, 'full' AS which, url AS address FROM spelled
    UNION ALL SELECT page_id, 'again', again FROM spelled)
), parts AS (
  SELECT page_id, which,
    regexp_replace(regexp_replace(lower(regexp_extract(a, '^[^/?]*')), ':(80|443)$', ''), '^www[.]', '') AS host,
    regexp_replace(regexp_extract(a, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
    array_to_string(list_sort(list_filter(string_split(regexp_extract(a, '[?](.*)$', 1), '&'),
      lambda p: p <> '' AND NOT starts_with(p, 'utm_'))), '&') AS query
  FROM addresses
), keys AS (
  SELECT page_id, which, CASE WHEN host <> '' THEN host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END END AS key
  FROM parts
), pairs AS (
  SELECT r.page_id, k.key, r.later, r.tag AS own, r.day AS own_day,
    arg_max(f.page_id, (f.day, f.page_id)) AS full_id, arg_max(f.day, (f.day, f.page_id)) AS full_day,
    arg_max(f.tag, (f.day, f.page_id)) AS tag, arg_max(f.size, (f.day, f.page_id)) AS size
  FROM spelled r JOIN keys k ON k.page_id = r.page_id AND k.which = 'again'
  LEFT JOIN (SELECT s.*, key FROM spelled s JOIN keys USING (page_id) WHERE which = 'full') f
    ON f.key = k.key AND f.day < r.later
  GROUP BY ALL
), judged AS (
  SELECT *, CASE page_id % 5 WHEN 0 THEN own WHEN 1 THEN own WHEN 3 THEN 'changed' END AS mine,
    CASE WHEN full_id % 9 <> 0 THEN tag END AS theirs,
    strftime(own_day - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS since,
    strftime(full_day - INTERVAL 1 DAY, '%Y-%m-%d %H:%M:%S') AS dated
  FROM pairs
), status AS (
  SELECT *, CASE WHEN key IS NULL THEN 'no_key' WHEN full_id IS NULL THEN 'no_response'
    WHEN page_id % 5 = 4 THEN 'no_validator'
    WHEN mine IS NOT NULL AND mine = theirs THEN 'resolved'
    WHEN page_id % 5 = 2 AND since = dated THEN 'resolved' ELSE 'mismatch' END AS status
  FROM judged
)
SELECT page_id * 2 + 1 AS record_id, key AS url_key, later AS date, full_id * 2 AS response_id, full_day AS response_date,
  status, CASE WHEN status = 'resolved' THEN concat_ws(chr(10), 'cache-control: max-age=60',
    'content-length: ' || size, 'content-type: text/html', 'date: ' || strftime(later, '%Y-%m-%d %H:%M:%S'),
    'etag: ' || CASE page_id % 5 WHEN 0 THEN '"' || own || '"' WHEN 1 THEN 'W/"' || own || '"'
      ELSE '"' || theirs || '"' END,
    'last-modified: ' || CASE WHEN page_id % 5 = 2 THEN since ELSE dated END) END AS headers
FROM status
"""

NEAR_DUPLICATES = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents
), sets AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS shingle
  FROM (SELECT doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) AS i FROM words WHERE len(w) > 0)
), sizes AS (SELECT doc_id, count(*) AS n FROM sets GROUP BY doc_id
), links AS (
  SELECT a.doc_id AS a, b.doc_id AS b
  FROM sets a JOIN sets b ON a.shingle = b.shingle AND a.doc_id < b.doc_id
  JOIN sizes x ON x.doc_id = a.doc_id JOIN sizes y ON y.doc_id = b.doc_id
  GROUP BY a.doc_id, b.doc_id, x.n, y.n HAVING 100 * count(*) >= 85 * (x.n + y.n - count(*))
), reached AS (
  SELECT doc_id AS a, doc_id AS b FROM documents
  UNION
  SELECT r.a, l.b FROM reached r JOIN (SELECT a, b FROM links UNION ALL SELECT b, a FROM links) l ON l.a = r.b
), least AS (SELECT a AS doc_id, min(b) AS component_id FROM reached GROUP BY a)
SELECT doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, doc_id = component_id AS kept
FROM least LEFT JOIN sizes USING (doc_id)
"""

NEGATIVES = r"""
WITH vectors AS (
  SELECT vec_id, CASE WHEN vec_id % 7 = 0 THEN (label + 1) % 10 ELSE label END AS label,
    list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS v
  FROM embeddings
  WHERE label IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scores AS (
  SELECT a.vec_id AS anchor_id, r.vec_id, r.label = a.label AS same,
    list_inner_product(a.v, r.v)::BIGINT AS score
  FROM vectors a JOIN vectors r ON r.vec_id <> a.vec_id WHERE a.vec_id % 50 = 0
), positives AS (
  SELECT anchor_id, vec_id AS positive_id, score AS positive_score FROM scores WHERE same
  QUALIFY row_number() OVER (PARTITION BY anchor_id ORDER BY score DESC, vec_id) <= 5
)
SELECT p.anchor_id, positive_id,
  row_number() OVER (PARTITION BY p.anchor_id, positive_id ORDER BY n.score DESC, n.vec_id)::INTEGER AS rank,
  n.vec_id AS negative_id, positive_score, n.score AS negative_score
FROM positives p JOIN scores n ON n.anchor_id = p.anchor_id AND NOT n.same
  AND 50 * positive_score <= 100 * n.score AND 100 * n.score <= 95 * positive_score
QUALIFY rank <= 3
"""

REPEATS = r"""
WITH texts AS (
  SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents
), windows AS (
  SELECT doc_id, i, md5_number(array_to_string(w[i:i + 49], ' ')) AS key
  FROM (SELECT doc_id, w, unnest(generate_series(1, len(w) - 49)) AS i FROM texts WHERE len(w) >= 50)
), least AS (SELECT key, min(doc_id) AS least FROM windows GROUP BY key HAVING count(DISTINCT doc_id) > 1
), repeated AS (SELECT doc_id, i FROM windows JOIN least USING (key) WHERE doc_id > least
), positions AS (
  SELECT doc_id, unnest(w) AS word, generate_subscripts(w, 1) AS i FROM texts
), covered AS (
  SELECT p.doc_id, p.i, p.word,
    coalesce(max(r.i) OVER (PARTITION BY p.doc_id ORDER BY p.i ROWS UNBOUNDED PRECEDING) >= p.i - 49, FALSE) AS gone
  FROM positions p LEFT JOIN repeated r ON r.doc_id = p.doc_id AND r.i = p.i
), kept AS (
  SELECT doc_id, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY i) FILTER (NOT gone) AS kept
  FROM covered GROUP BY doc_id
)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_removed, 0)::BIGINT AS n_removed,
  sha256(coalesce(kept, '')) AS kept_sha256
FROM texts LEFT JOIN kept USING (doc_id)
"""
