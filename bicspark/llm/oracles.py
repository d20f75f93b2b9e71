"""DuckDB SQL of the queries that SQL can express."""

MIXING = r"""
WITH d AS (
  SELECT doc_id, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::BIGINT AS size,
    coalesce('+' || source, '~') AS stratum,
    ('0x' || substr(md5('mix:' || coalesce(doc_id::VARCHAR, 'null')), 1, 8))::BIGINT AS unit
  FROM documents
),
s AS (
  SELECT stratum, sum(size)::BIGINT AS source_size,
    [5.0::DOUBLE, 2.0, 1.0][((row_number() OVER (ORDER BY stratum) - 1) % 3 + 1)::INT] AS weight
  FROM d GROUP BY stratum
),
l AS (
  SELECT *, 2.0::DOUBLE * source_size AS room,
    (sum(source_size) OVER () * 1.5::DOUBLE - coalesce(sum(2.0::DOUBLE * source_size) OVER (
        ORDER BY 2.0::DOUBLE * source_size / weight, stratum ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
      / sum(weight) OVER (ORDER BY 2.0::DOUBLE * source_size / weight, stratum ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)
      AS level
  FROM s
),
t AS (
  SELECT stratum, source_size, coalesce(least(room, weight * (
      SELECT level FROM l WHERE room > level * weight ORDER BY room / weight, stratum LIMIT 1)), room) AS target
  FROM l
),
r AS (
  SELECT d.*, source_size, target,
    least(round_even(target, 0)::BIGINT, 2 * source_size) // source_size AS rounds,
    least(round_even(target, 0)::BIGINT, 2 * source_size) % source_size AS rest,
    sum(size) OVER w - size AS before, row_number() OVER w - 1 AS place
  FROM d JOIN t USING (stratum) WHERE size > 0
  WINDOW w AS (PARTITION BY stratum ORDER BY unit, doc_id, size ROWS UNBOUNDED PRECEDING)
),
g AS (
  SELECT stratum, any_value(rest) - coalesce(max(before + size) FILTER (before + size <= rest), 0) AS gap
  FROM r GROUP BY stratum
),
b AS (
  SELECT stratum, place FROM r JOIN g USING (stratum)
  WHERE before + size > rest AND abs(size - gap) < gap
  QUALIFY row_number() OVER (PARTITION BY stratum ORDER BY abs(size - gap), unit, place) = 1
)
SELECT doc_id, size, source_size, target,
  (size * least(2, rounds + CASE WHEN before + size <= rest OR b.place IS NOT NULL THEN 1 ELSE 0 END))::BIGINT AS taken
FROM r LEFT JOIN b USING (stratum, place)
UNION ALL
SELECT doc_id, size, source_size, target, 0 FROM d JOIN t USING (stratum) WHERE size = 0
"""

CONVERSATIONS = r"""
WITH RECURSIVE keyed AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k
  FROM conversations
),
bits AS (
  SELECT *, flatten(list_transform(range(1, length(k) + 1), lambda i: list_transform(range(8), lambda j: (ascii(k[i]) >> j) & 1))) AS b
  FROM keyed
),
cases AS (
  SELECT conv_id, turn, role, text,
    xor(list_reduce(b, lambda c, x: xor(c >> 1, CASE WHEN (c & 1) <> x THEN 3988292384 ELSE 0 END), 4294967295::BIGINT), 4294967295) % 20 AS h
  FROM bits
),
damaged AS (
  SELECT conv_id, turn, CASE WHEN h = 4 THEN 'user' ELSE role END AS role,
    CASE h WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text
  FROM (SELECT *, unnest(CASE h WHEN 0 THEN [] WHEN 3 THEN [1, 2] ELSE [1] END) FROM cases)
),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, md5(length(role)::VARCHAR || ':' || role || text)) AS pos
  FROM damaged
),
marked AS (
  SELECT *, NOT regexp_matches(text, '[^\x20\x09-\x0D]') AS blank,
    row_number() OVER (PARTITION BY conv_id, role, text ORDER BY pos) > 1 AS again,
    NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*\z') AS open_end, substr(role, 1, 1) AS ini,
    lead(substr(role, 1, 1)) OVER (PARTITION BY conv_id ORDER BY pos) AS next_ini
  FROM placed
),
found AS (SELECT *, (blank OR again) AS must, (NOT blank AND NOT again AND open_end)::INT AS cut FROM marked),
steps AS (
  SELECT conv_id, max(pos) + 1 AS pos,
    [{'c': 0, 'a': ''}, {'c': 4, 'a': 'II'}, {'c': 2, 'a': 'I'}, {'c': 0, 'a': ''}] AS v
  FROM found GROUP BY conv_id
  UNION ALL
  SELECT conv_id, pos, [
      list_min([w[1], {'c': x[3].c + 2, 'a': 'I' || x[3].a}]), list_min([w[2], {'c': x[3].c + 2, 'a': 'I' || x[3].a}]), x[3], x[4]]
  FROM (
    SELECT conv_id, pos, w, [w[1], w[2],
      list_min([w[3], {'c': w[4].c + 2, 'a': 'I' || w[4].a}]), list_min([w[4], {'c': w[3].c + 2, 'a': 'I' || w[3].a}])] AS x
    FROM (
      SELECT conv_id, pos, list_transform([1, 2, 3, 4], lambda q: list_min([
        {'c': v[q].c + 3, 'a': 'D' || v[q].a},
        CASE WHEN must OR kept[q] = 0 THEN {'c': 1000000000, 'a': ''} ELSE {'c': v[kept[q]].c + cut, 'a': 'K' || v[kept[q]].a} END,
        CASE WHEN must THEN {'c': 1000000000, 'a': ''} ELSE {'c': v[turned[q]].c + 2 + cut, 'a': 'R' || v[turned[q]].a} END])) AS w
      FROM (
        SELECT f.conv_id, f.pos, f.must, f.cut, s.v, [3, 3, 4, 3] AS turned,
          CASE f.ini WHEN 's' THEN [2, 0, 0, 0] WHEN 'u' THEN [3, 3, 0, 3] WHEN 'a' THEN [0, 0, 4, 0] ELSE [0, 0, 0, 0] END AS kept
        FROM steps s JOIN found f ON f.conv_id IS NOT DISTINCT FROM s.conv_id AND f.pos = s.pos - 1
      )
    )
  )
),
best AS (SELECT conv_id, v[1].c AS cost, v[1].a AS audit FROM steps WHERE pos = 1),
letters AS (
  SELECT conv_id, unnest(range(1, length(audit) + 1)) AS k, unnest(string_split(audit, '')) AS letter FROM best WHERE audit <> ''
),
matched AS (
  SELECT *, count(*) FILTER (letter <> 'I') OVER w AS pos, count(*) FILTER (letter <> 'D') OVER w AS line
  FROM letters WINDOW w AS (PARTITION BY conv_id ORDER BY k)
),
lines AS (
  SELECT m.conv_id, m.k, m.letter, m.line, f.role, f.text, f.ini,
    max(CASE WHEN m.line = 1 AND m.letter = 'K' AND f.ini = 's' THEN 1 ELSE 0 END) OVER (PARTITION BY m.conv_id) AS led
  FROM matched m LEFT JOIN found f ON f.conv_id IS NOT DISTINCT FROM m.conv_id AND f.pos = m.pos AND m.letter <> 'I'
  WHERE m.letter <> 'D'
),
texts AS (
  SELECT conv_id, string_agg(
    CASE WHEN letter = 'K' THEN role WHEN (line - led) % 2 = 1 THEN 'user' ELSE 'assistant' END || ':' || coalesce(text, ''), chr(10) ORDER BY k) AS t
  FROM lines GROUP BY conv_id
),
counts AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, count(*) FILTER (blank) AS blank,
    count(*) FILTER (again AND NOT blank) AS duplicate, sum(cut) AS truncated,
    count(*) FILTER (next_ini IS NOT NULL AND ini || next_ini NOT IN ('su', 'ua', 'au')) AS illegal
  FROM found GROUP BY conv_id
)
SELECT o.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate,
  coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal, coalesce(cost, 0)::BIGINT AS cost,
  coalesce(audit, '') AS audit, sha256(coalesce(t, '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) o
LEFT JOIN counts c ON c.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN best b ON b.conv_id IS NOT DISTINCT FROM o.conv_id
LEFT JOIN texts t ON t.conv_id IS NOT DISTINCT FROM o.conv_id
"""
