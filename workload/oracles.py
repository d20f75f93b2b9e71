"""For each query the same result in SQL, as DuckDB runs it on the driver tables.

Closed itemsets come from plain enumeration: every frequent itemset with its list of
rows, less those that a superset with as many rows covers.
"""

from __future__ import annotations

from workload.matrices import LETTERS
from workload.queries import LITERAL_GRID, SEEDS, THETA, VECTOR_THETA

MINSUP = 10

ORDERS = """cells AS (
  SELECT l_orderkey AS row_id, l_linenumber AS col, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""
PARTS = """cells AS (
  SELECT l_partkey AS row_id, month(l_shipdate)::INT AS col, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2)"""
TWICE = """once AS (
  SELECT l_orderkey AS row_id, l_linenumber AS col, sum(l_quantity) AS value
  FROM lineitem GROUP BY 1, 2),
cells AS (SELECT * FROM once UNION ALL SELECT row_id, col + 10, value FROM once)"""
VECTORS = """cells AS (
  SELECT vec_id AS row_id, generate_subscripts(embedding, 1)::INT - 1 AS col,
         floor(unnest(embedding)::DOUBLE * 100) AS value
  FROM embeddings)"""

SORTED = """sorted AS (
  SELECT row_id, (row_number() OVER (PARTITION BY row_id ORDER BY value, col) - 1)::INT AS pos, col, value
  FROM cells)"""
TRIPLES = f"""{SORTED},
triples AS (
  SELECT * FROM (
    SELECT row_id, pos, col AS c0, lead(col, 1) OVER w AS c1, lead(col, 2) OVER w AS c2,
           value AS v0, lead(value, 1) OVER w AS v1, lead(value, 2) OVER w AS v2
    FROM sorted WINDOW w AS (PARTITION BY row_id ORDER BY pos))
  WHERE c2 IS NOT NULL),
means AS (
  SELECT *, v0 + (v1 - v0) / 2.0 + (v2 - (v0 + (v1 - v0) / 2.0)) / 3.0 AS mean FROM triples),
deviations AS (
  SELECT *, (v0 - mean) * (v0 - mean) AS d0, (v1 - mean) * (v1 - mean) AS d1,
         (v2 - mean) * (v2 - mean) AS d2
  FROM means),
stats AS (
  SELECT *, round(mean, 2) AS mean2, round(variance, 7) AS variance7,
         CASE WHEN mean <> 0 THEN sqrt(variance) / mean END AS cv
  FROM (SELECT *, d0 + (d1 - d0) / 2.0 + (d2 - (d0 + (d1 - d0) / 2.0)) / 3.0 AS variance
        FROM deviations))"""


def grid(step: int, n: int, overlap: int, start: int = 0) -> str:
    return f"""grid AS (
  SELECT i::INT AS bucket_id, ({start} + {step} * i - {overlap})::DOUBLE AS lo,
         ({start} + {step} * (i + 1) + {overlap})::DOUBLE AS hi
  FROM range({n}) t(i))"""


ORDER_GRID = grid(10, 20, 2)
PART_GRID = grid(20, 20, 4)
VECTOR_GRID = grid(5, 24, 1, -60)

LAST = """bucketed AS (
  SELECT s.*, coalesce(g.bucket_id, -1) AS bucket_id
  FROM stats s
  LEFT JOIN (SELECT mean2, max(bucket_id) AS bucket_id
             FROM (SELECT DISTINCT mean2 FROM stats) JOIN grid ON lo <= mean2 AND mean2 <= hi
             GROUP BY 1) g USING (mean2))"""
ALL = """bucketed AS (
  SELECT s.*, g.bucket_id FROM stats s JOIN grid g ON g.lo <= s.mean2 AND s.mean2 <= g.hi)"""
LABEL = "CASE WHEN bucket_id = -1 THEN '' ELSE (SELECT lo || ':' || hi FROM grid g WHERE g.bucket_id = b.bucket_id) END"

ITEMS = """items AS (
  SELECT DISTINCT bucket_id, unnest([c0, c1, c2]) AS item, row_id FROM bucketed)"""
VALUED_ITEMS = """items AS (
  SELECT DISTINCT bucket_id, unnest([c0 || '#' || v0, c1 || '#' || v1, c2 || '#' || v2]) AS item, row_id
  FROM bucketed)"""


def closed_of(minsup: int = MINSUP) -> str:
    return f"""freq AS (
  SELECT bucket_id, item, list(row_id ORDER BY row_id) AS tids
  FROM items GROUP BY 1, 2 HAVING count(*) >= {minsup}),
sets AS (
  SELECT bucket_id, [item] AS cols, item AS last, tids FROM freq
  UNION ALL
  SELECT bucket_id, cols, last, tids FROM (
    SELECT s.bucket_id, list_append(s.cols, f.item) AS cols, f.item AS last,
           list_intersect(s.tids, f.tids) AS tids
    FROM sets s JOIN freq f ON f.bucket_id = s.bucket_id AND f.item > s.last)
  WHERE len(tids) >= {minsup}),
covered AS (
  SELECT DISTINCT s.bucket_id, s.cols
  FROM (SELECT bucket_id, cols, len(tids) AS n,
               unnest([list_concat(cols[:k - 1], cols[k + 1:]) for k in range(1, len(cols) + 1)]) AS part
        FROM sets WHERE len(cols) > 1) t
  JOIN sets s ON s.bucket_id = t.bucket_id AND s.cols = t.part AND len(s.tids) = t.n),
closed AS (
  SELECT bucket_id, cols, len(cols)::INT AS n_cols, list_sort(tids) AS row_ids, len(tids) AS n_rows
  FROM sets ANTI JOIN covered USING (bucket_id, cols))"""


CLOSED = closed_of()
CONCEPTS = """concepts AS (
  SELECT row_ids, cols, any_value(n_cols) AS n_cols, any_value(n_rows) AS n_rows,
         list(bucket_id ORDER BY bucket_id) AS bucket_ids
  FROM closed GROUP BY 1, 2)"""
ROWS = """n_rows, list_min(row_ids) AS row_min, list_max(row_ids) AS row_max,
  list_aggregate(row_ids, 'bit_xor') AS row_xor"""
COLS = "array_to_string(cols, ',') AS cols"


def chain(*parts: str) -> str:
    return "WITH RECURSIVE " + ",\n".join(parts)


ORDER_LAST = chain(ORDERS, TRIPLES, ORDER_GRID, LAST)
ORDER_ALL = chain(ORDERS, TRIPLES, ORDER_GRID, ALL)
PART_CLOSED = chain(PARTS, TRIPLES, PART_GRID, LAST, ITEMS, CLOSED)
PART_CONCEPTS = f"{PART_CLOSED},\n{CONCEPTS}"
VALUED_CONCEPTS = f"{ORDER_LAST},\n{VALUED_ITEMS},\n{CLOSED},\n{CONCEPTS}"
PART_RANGES = chain(PARTS, TRIPLES, """grid AS (
  SELECT o_orderkey AS bucket_id, lo::DOUBLE AS lo, (lo + floor(o_totalprice)::BIGINT % 8)::DOUBLE AS hi
  FROM (SELECT *, floor(o_totalprice / 10)::BIGINT % 200 AS lo FROM orders))""")
RANKED = f"""{PART_CONCEPTS}
SELECT {ROWS}, {COLS}, n_cols, n_sets
FROM (SELECT *, count(*) OVER (PARTITION BY row_ids) AS n_sets FROM concepts) ranked
WHERE n_cols >= 4"""
LINES = f"""{PART_CONCEPTS}
SELECT array_to_string(row_ids, ' ') || ',' || array_to_string(cols, ' ') || ' % ' || n_rows || ',' || n_cols
  AS value
FROM concepts WHERE n_cols >= 4"""

_literal = [pair.split(":") for pair in LITERAL_GRID.split(",")]
LITERAL = "grid AS (SELECT * FROM (VALUES " + ", ".join(
    f"({i}, {float(lo)}::DOUBLE, {float(hi)}::DOUBLE)" for i, (lo, hi) in enumerate(_literal)
) + ") t(bucket_id, lo, hi))"


EVEN = """bucketed AS (
  SELECT s.*, g.bucket_id
  FROM (SELECT * FROM stats WHERE sqrt(variance7) / mean <= 0.25) s
  JOIN grid g ON g.lo <= s.mean2 AND s.mean2 <= g.hi)"""

# The default ranges, each start summed up in doubles from the one before. The ends
# are rounded in decimal: DuckDB takes the double 0.67499... for a tie.
DEFAULT = """starts AS (
  SELECT part, start AS pos, stop, step, overlap
  FROM (VALUES (0, 0e0, 1e0, 0.1e0, 0.025e0), (1, 1e0, 10e0, 1e0, 0.25e0),
               (2, 10e0, 50e0, 5e0, 1e0), (3, 50e0, 700e0, 25e0, 5e0)) t(part, start, stop, step, overlap)
  UNION ALL
  SELECT part, pos + step, stop, step, overlap FROM starts WHERE pos + step < stop),
grid AS (
  SELECT (row_number() OVER (ORDER BY part, pos) - 1)::INT AS bucket_id,
         round((pos - overlap)::VARCHAR::DECIMAL(20, 16), 2)::DOUBLE AS lo,
         round((pos + step + overlap)::VARCHAR::DECIMAL(20, 16), 2)::DOUBLE AS hi
  FROM starts)"""


def per_range(bucketed: str, own_id: str = "bucket_id") -> str:
    return f"""{bucketed}
SELECT g.bucket_id, lo, hi, lo || ':' || hi AS bucket, coalesce(n, 0) AS n_triples
FROM grid g LEFT JOIN (SELECT {own_id} AS bucket_id, count(*) AS n FROM bucketed GROUP BY 1) c USING (bucket_id)"""


def votes(prefix: str, concepts: str) -> str:
    """Seeds, judged concepts and the prediction of every row of ``embeddings``."""
    return f"""{prefix}seeds AS (
  SELECT row_ids, cols, unnest(row_ids[:{SEEDS}]) AS row_id FROM {concepts}),
{prefix}judged AS (
  SELECT s.row_ids, s.cols, count(*) AS n_seeds, min(label) = max(label) AS predictable,
         CASE WHEN min(label) = max(label) THEN min(label) END AS label
  FROM {prefix}seeds s JOIN embeddings e ON e.vec_id = s.row_id GROUP BY 1, 2),
{prefix}votes AS (
  SELECT row_id, label, count(*) AS n
  FROM (SELECT label, unnest(row_ids) AS row_id FROM {prefix}judged WHERE predictable) GROUP BY 1, 2),
{prefix}chosen AS (
  SELECT row_id, label FROM {prefix}votes
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY n DESC, label) = 1),
{prefix}predicted AS (
  SELECT e.vec_id AS row_id, e.label AS actual, s.row_id IS NOT NULL AS is_training,
         CASE WHEN s.row_id IS NOT NULL THEN e.label ELSE c.label END AS predicted
  FROM embeddings e LEFT JOIN (SELECT DISTINCT row_id FROM {prefix}seeds) s ON s.row_id = e.vec_id
  LEFT JOIN {prefix}chosen c ON c.row_id = e.vec_id)"""


def vector_sets(least_cols: int = 2) -> str:
    return chain(VECTORS, TRIPLES, VECTOR_GRID, LAST, ITEMS, CLOSED) + f""",
concepts AS (
  SELECT DISTINCT row_ids, cols, n_cols, n_rows FROM closed WHERE n_cols >= {least_cols}),
{votes('', 'concepts')}"""


VECTOR_SETS = vector_sets()


def blocks(cells: str = "cells") -> str:
    """Blocks [v, v + theta], which take the place of the ranges."""
    return f"""block_items AS (
  SELECT b.v AS bucket_id, c.col AS item, c.row_id, c.value
  FROM {cells} c JOIN (SELECT DISTINCT value AS v FROM {cells}) b
    ON b.v <= c.value AND c.value - b.v <= {THETA})"""


def similar(prefix: str, cells: str = "cells") -> str:
    """Closed sets that come out of every block which holds their span."""
    return f"""{prefix}found AS (
  SELECT row_ids, cols, n_cols, n_rows, count(*) AS n_found FROM {prefix}closed WHERE n_cols >= 2 GROUP BY ALL),
{prefix}spans AS (
  SELECT f.row_ids, f.cols, min(c.value) AS value_min, max(c.value) AS value_max
  FROM (SELECT row_ids, cols, row_id, unnest(cols) AS col
        FROM (SELECT row_ids, cols, unnest(row_ids) AS row_id FROM {prefix}found)) f
  JOIN {cells} c ON c.row_id = f.row_id AND c.col = f.col GROUP BY 1, 2),
{prefix}similar AS (
  SELECT f.row_ids, f.cols, f.n_cols, f.n_rows, s.value_min, s.value_max
  FROM {prefix}found f JOIN {prefix}spans s USING (row_ids, cols)
  WHERE n_found = (SELECT count(*) FROM (SELECT DISTINCT value AS v FROM {cells})
                   WHERE v <= s.value_min AND s.value_max - v <= {THETA}))"""


def renamed(sql: str, prefix: str) -> str:
    """The closed set steps under other names, over the value blocks."""
    for name in ("freq", "sets", "covered", "closed"):
        sql = sql.replace(f"{name} AS (", f"{prefix}{name} AS (")
        for word in ("FROM", "JOIN"):
            sql = sql.replace(f"{word} {name} ", f"{word} {prefix}{name} ")
            sql = sql.replace(f"{word} {name}\n", f"{word} {prefix}{name}\n")
    return sql.replace("FROM sets)", f"FROM {prefix}sets)").replace("FROM items ", "FROM block_items ").replace(
        "FROM freq\n", f"FROM {prefix}freq\n"
    )


BLOCK_CLOSED = renamed(CLOSED, "b_")

COMBINED = f"""{VECTOR_SETS},
{blocks()},
{BLOCK_CLOSED},
{similar('b_')},
{votes('b_', 'b_similar')},
combined AS (
  SELECT row_id, f.actual, f.is_training OR s.is_training AS is_training,
         CASE WHEN f.is_training OR s.is_training THEN f.actual
              ELSE coalesce(f.predicted, s.predicted) END AS predicted
  FROM predicted f JOIN b_predicted s USING (row_id))"""

# Windows [v, v + theta] of the rows' spans, for every set of the first five columns.
SIMILAR_VECTORS = f"""
WITH cells AS (
  SELECT vec_id AS row_id, i AS col, embedding[i + 1]::DOUBLE AS value FROM embeddings, range(5) t(i)),
col_sets AS (SELECT m FROM range(1, 32) t(m)),
spans AS (
  SELECT m, row_id, min(value) AS low, max(value) AS high FROM col_sets JOIN cells ON (m >> col) & 1 = 1
  GROUP BY 1, 2 HAVING count(*) = bit_count(m) AND max(value) - min(value) <= {VECTOR_THETA}),
windows AS (
  SELECT w.m, w.low AS value_min, max(s.high) AS value_max, list(row_id ORDER BY row_id) AS row_ids, count(*) AS n_rows
  FROM (SELECT DISTINCT m, low FROM spans) w JOIN spans s ON s.m = w.m AND s.low >= w.low AND s.high - w.low <= {VECTOR_THETA}
  GROUP BY 1, 2 HAVING count(*) >= {MINSUP}),
full_rows AS (
  SELECT * FROM windows w WHERE NOT EXISTS (
    SELECT 1 FROM spans s WHERE s.m = w.m AND s.low < w.value_min AND w.value_max - s.low <= {VECTOR_THETA})),
full_both AS (
  SELECT * FROM full_rows w WHERE bit_count(m) >= 2 AND NOT EXISTS (
    SELECT 1 FROM full_rows x WHERE x.row_ids = w.row_ids AND x.m & w.m = w.m AND x.m <> w.m))
SELECT {ROWS}, array_to_string(list_filter(range(5), lambda i: (m >> i) & 1 = 1), ',') AS cols, bit_count(m)::INT AS n_cols,
  value_min, value_max
FROM full_both"""

LETTER_CELLS = "cells AS (" + " UNION ALL ".join(
    f"SELECT doc_id AS row_id, {k} AS col, floor(1000 * (length(text) - length(replace(text, '{c}', ''))) / length(text))::DOUBLE AS value "
    "FROM documents WHERE length(text) > 0"
    for k, c in enumerate(LETTERS)
) + ")"
LETTER_CLOSED = chain(LETTER_CELLS, TRIPLES, grid(20, 10, 2), LAST, ITEMS, CLOSED)
PREDICTED_DOCUMENTS = f"""{LETTER_CLOSED},
concepts AS (SELECT DISTINCT row_ids, cols FROM closed WHERE n_cols >= 3),
known AS (SELECT doc_id AS row_id, max(quality) AS label FROM labels GROUP BY 1),
seeds AS (SELECT row_ids, cols, unnest(row_ids[:{SEEDS}]) AS row_id FROM concepts),
judged AS (
  SELECT row_ids, cols, min(label) AS label FROM seeds LEFT JOIN known USING (row_id) GROUP BY 1, 2
  HAVING count(label) = count(*) AND min(label) = max(label)),
chosen AS (
  SELECT row_id, label FROM (SELECT unnest(row_ids) AS row_id, label FROM judged) GROUP BY 1, 2
  QUALIFY row_number() OVER (PARTITION BY row_id ORDER BY count(*) DESC, label) = 1)
SELECT row_id, k.label AS actual, s.row_id IS NOT NULL AS is_training,
  coalesce(CASE WHEN s.row_id IS NOT NULL THEN k.label END, c.label) AS predicted
FROM (SELECT DISTINCT doc_id AS row_id FROM documents UNION SELECT row_id FROM known)
LEFT JOIN known k USING (row_id) LEFT JOIN (SELECT DISTINCT row_id FROM seeds) s USING (row_id) LEFT JOIN chosen c USING (row_id)"""

# Closed sets and the rare items, each once over all ranges.
EVERY = f"""{VALUED_CONCEPTS},
rare AS (
  SELECT row_ids, [min(item)] AS cols, 1 AS n_cols, len(row_ids) AS n_rows, bucket_id
  FROM (SELECT bucket_id, item, list(row_id ORDER BY row_id) AS row_ids
        FROM items GROUP BY 1, 2 HAVING count(*) < {MINSUP})
  GROUP BY bucket_id, row_ids),
every AS (
  SELECT * FROM concepts
  UNION ALL
  SELECT row_ids, cols, any_value(n_cols), any_value(n_rows), list(bucket_id ORDER BY bucket_id)
  FROM rare GROUP BY 1, 2)"""

ORACLES: dict[str, str] = {
    "matrix_cells": chain(ORDERS) + " SELECT * FROM cells",
    "wide_matrix_cells": """
WITH wide AS (
  SELECT l_suppkey AS row_id, sum(l_quantity) AS c0,
         count(*) FILTER (l_returnflag = 'R')::DOUBLE AS c1,
         sum(l_quantity) FILTER (l_linestatus = 'O') AS c2
  FROM lineitem GROUP BY 1)
SELECT row_id, col, value FROM (
  SELECT row_id, 0 AS col, c0 AS value FROM wide
  UNION ALL SELECT row_id, 1, c1 FROM wide
  UNION ALL SELECT row_id, 2, c2 FROM wide)
WHERE value IS NOT NULL""",
    "matrix_preview": chain(ORDERS, SORTED) + """
SELECT row_id, string_agg(value || '$' || col, ' ' ORDER BY pos) AS cells
FROM sorted GROUP BY 1 ORDER BY 1 LIMIT 5""",
    "numbered_matrix": """
SELECT row_id, generate_subscripts(embedding, 1)::INT - 1 AS col, floor(unnest(embedding)::DOUBLE * 100) AS value
FROM (SELECT row_number() OVER (ORDER BY vec_id) - 1 AS row_id, embedding FROM embeddings)""",
    "sorted_cells": chain(ORDERS, SORTED) + " SELECT * FROM sorted",
    "row_text": chain(ORDERS, SORTED) + """
SELECT row_id, string_agg(value || '$' || col, ' ' ORDER BY pos) || '%' || row_id AS line
FROM sorted GROUP BY 1""",
    "row_triples": chain(PARTS, TRIPLES) + """
SELECT row_id, pos, c0 || ',' || c1 || ',' || c2 AS cols, v0 || ',' || v1 || ',' || v2 AS values FROM triples""",
    "triple_stats": chain(PARTS, TRIPLES) + """
SELECT row_id, pos, mean2, variance7, round(mean, 6) AS mean, round(variance, 6) AS variance, round(cv, 6) AS cv
FROM stats""",
    "triple_stats_by_sum": chain(ORDERS, TRIPLES) + """
SELECT row_id, pos, round(m, 2) AS mean2, variance7, round(sqrt(variance7) / m, 6) AS cv
FROM (SELECT row_id, pos, m,
        round(((v0 - m) * (v0 - m) + (v1 - m) * (v1 - m) + (v2 - m) * (v2 - m)) / 3.0, 7) AS variance7
      FROM (SELECT *, (v0 + v1 + v2) / 3.0 AS m FROM triples))""",
    "triple_lines": ORDER_LAST + f"""
SELECT row_id, pos, {LABEL} AS bucket,
       round(variance, 3) || '$' || c0 || '#' || v0 || ',' || c1 || '#' || v1 || ',' || c2 || '#' || v2
         || '$' || row_id AS triple
FROM bucketed b""",
    "range_grid": per_range(chain(PARTS, TRIPLES, DEFAULT, LAST)),
    "range_grid_literal": per_range(
        chain(ORDERS, TRIPLES, LITERAL)
        + """,
bucketed AS (
  SELECT DISTINCT s.row_id, s.pos, (SELECT min(f.bucket_id) FROM grid f WHERE f.lo = g.lo AND f.hi = g.hi) AS bucket_id
  FROM stats s JOIN grid g ON g.lo <= s.mean2 AND s.mean2 <= g.hi)"""
    ),
    "bucket_last": ORDER_LAST + " SELECT row_id, pos, mean2, bucket_id FROM bucketed",
    "bucket_last_unmatched": chain(ORDERS, TRIPLES, grid(10, 6, 2), LAST)
    + f" SELECT row_id, pos, {LABEL} AS bucket FROM bucketed b",
    "bucket_all": ORDER_ALL + " SELECT row_id, pos, mean2, bucket_id FROM bucketed",
    "ranges_all": f"""{PART_RANGES}
SELECT g.bucket_id, count(*) AS n_triples, bit_xor(row_id) AS row_xor
FROM stats JOIN grid g ON g.lo <= mean2 AND mean2 <= g.hi GROUP BY 1""",
    "ranges_last": f"""{PART_RANGES}
SELECT row_id, pos, mean2, coalesce(m.bucket_id, -1) AS bucket_id
FROM stats LEFT JOIN (SELECT mean2, max(bucket_id) AS bucket_id FROM (SELECT DISTINCT mean2 FROM stats)
                      JOIN grid ON lo <= mean2 AND mean2 <= hi GROUP BY 1) m USING (mean2)""",
    "cv_filtered_triples": ORDER_ALL + """
SELECT row_id, pos, bucket_id, round(cv7, 6) AS cv
FROM (SELECT *, sqrt(variance7) / mean AS cv7 FROM bucketed) WHERE cv7 <= 0.17""",
    "bucket_summary": ORDER_LAST + """
SELECT bucket_id, count(*) AS n_triples, count(DISTINCT row_id) AS n_rows, round(avg(cv), 6) AS mean_cv
FROM bucketed GROUP BY 1""",
    "item_tidsets": f"{ORDER_LAST},\n{ITEMS} SELECT * FROM items",
    "frequent_items": f"""{ORDER_LAST},\n{ITEMS}
SELECT bucket_id, item, count(*) AS n_rows FROM items GROUP BY 1, 2 HAVING count(*) >= {MINSUP}""",
    "frequent_tidsets": f"""{ORDER_LAST},\n{VALUED_ITEMS}
SELECT bucket_id, item, row_id FROM items
QUALIFY count(*) OVER (PARTITION BY bucket_id, item) >= {MINSUP}""",
    "pair_support": chain(PARTS, TRIPLES, PART_GRID, LAST, ITEMS) + f"""
SELECT a.bucket_id, a.item AS item_a, b.item AS item_b, count(*) AS n_rows
FROM items a JOIN items b ON a.bucket_id = b.bucket_id AND a.row_id = b.row_id AND a.item < b.item
GROUP BY 1, 2, 3 HAVING count(*) >= {MINSUP}""",
    "closed_itemsets": f"{ORDER_LAST},\n{ITEMS},\n{CLOSED} SELECT bucket_id, {COLS}, n_cols, n_rows FROM closed",
    "closed_itemsets_by_month": f"{PART_CLOSED} SELECT bucket_id, {COLS}, n_cols, n_rows FROM closed",
    "closed_itemsets_twice": chain(TWICE, TRIPLES, ORDER_GRID, LAST, ITEMS, CLOSED)
    + f" SELECT bucket_id, {COLS}, n_cols, n_rows FROM closed",
    "closed_itemsets_all_ranges": f"{ORDER_ALL},\n{ITEMS},\n{CLOSED} SELECT bucket_id, {COLS}, n_cols, n_rows FROM closed",
    "closed_itemsets_wide": f"{PART_CLOSED} SELECT bucket_id, {COLS}, n_cols, n_rows FROM closed WHERE n_cols >= 4",
    "closed_itemsets_by_joins": f"{PART_CLOSED} SELECT bucket_id, {COLS}, n_cols, n_rows FROM closed",
    "closed_filter": chain(TWICE, TRIPLES, ORDER_GRID, LAST, ITEMS, CLOSED)
    + f" SELECT bucket_id, {COLS}, n_cols, n_rows FROM closed",
    # A set goes if a larger one of the collection is in all of its rows.
    "subsumption_filter": f"""{chain(TWICE, TRIPLES, ORDER_GRID, LAST, ITEMS, CLOSED)},
collection AS (SELECT bucket_id, cols, list_sort(tids) AS row_ids, len(tids) AS n_rows FROM sets WHERE len(cols) NOT IN (2, 4)),
gone AS (
  SELECT DISTINCT s.bucket_id, s.cols FROM collection s JOIN collection l
  ON l.bucket_id = s.bucket_id AND l.n_rows = s.n_rows AND len(l.cols) > len(s.cols) AND list_has_all(l.cols, s.cols))
SELECT bucket_id, {COLS}, len(cols)::INT AS n_cols, {ROWS} FROM collection ANTI JOIN gone USING (bucket_id, cols)""",
    "common_rows": chain(PARTS, TRIPLES, PART_GRID, LAST, ITEMS) + f"""
SELECT a.bucket_id, a.item || ',' || b.item || ',' || c.item AS items, count(*) AS n_rows
FROM items a JOIN items b ON a.bucket_id = b.bucket_id AND a.row_id = b.row_id AND a.item < b.item
JOIN items c ON c.bucket_id = b.bucket_id AND c.row_id = b.row_id AND b.item < c.item
GROUP BY 1, 2 HAVING count(*) >= {MINSUP}""",
    "concept_positions": f"""{PART_CONCEPTS},
numbered AS (
  SELECT *, {ROWS.replace('n_rows, ', '', 1)}, count(*) OVER (PARTITION BY row_ids) AS n_sets FROM concepts)
SELECT n_rows, row_min, row_max, row_xor, {COLS}, n_sets,
  row_number() OVER (ORDER BY n_rows DESC, n_sets DESC, row_min, row_max, row_xor, numbered.cols) AS position
FROM numbered WHERE n_cols >= 4""",
    "subsupport_items": f"""{ORDER_LAST},\n{VALUED_ITEMS}
SELECT bucket_id, array_to_string(row_ids, ',') AS rows, min(item) AS cols
FROM (SELECT bucket_id, item, list(row_id ORDER BY row_id) AS row_ids
      FROM items GROUP BY 1, 2 HAVING count(*) < {MINSUP})
GROUP BY bucket_id, row_ids""",
    "concept_extents": f"{PART_CLOSED} SELECT bucket_id, {COLS}, unnest(row_ids) AS row_id FROM closed",
    "concept_row_sets": f"{PART_CLOSED} SELECT bucket_id, {COLS}, {ROWS} FROM closed",
    "distinct_concepts": f"""{ORDER_ALL},\n{ITEMS},\n{CLOSED},\n{CONCEPTS}
SELECT {ROWS}, {COLS}, n_cols, array_to_string(bucket_ids, ',') AS bucket_ids FROM concepts""",
    "concepts_by_rows": f"""{ORDER_ALL},\n{VALUED_ITEMS},\n{CLOSED},\n{CONCEPTS},
by_rows AS (
  SELECT row_ids, any_value(n_rows) AS n_rows,
         array_to_string([array_to_string(s, ' ') for s in list(cols ORDER BY cols)], ',') AS col_sets,
         count(*) AS n_sets
  FROM concepts GROUP BY 1)
SELECT {ROWS}, col_sets, n_sets FROM by_rows""",
    "longest_per_rows": f"""{VALUED_CONCEPTS}
SELECT {ROWS}, {COLS}, n_cols, n_dup
FROM (SELECT *, count(*) OVER (PARTITION BY row_ids) AS n_dup FROM concepts)
QUALIFY row_number() OVER (PARTITION BY row_ids
  ORDER BY n_cols DESC, length(array_to_string(cols, ' ')) DESC, cols) = 1""",
    "concepts_min_cols": f"{PART_CONCEPTS} SELECT {ROWS}, {COLS}, n_cols FROM concepts WHERE n_cols >= 4",
    "concepts_having_value": f"""{VALUED_CONCEPTS}
SELECT {ROWS}, {COLS}, n_cols FROM concepts
WHERE list_contains([split_part(c, '#', 2)::DOUBLE for c in cols], 16.0)""",
    "ranked_concepts": RANKED,
    "top_concepts": f"""{RANKED}
ORDER BY n_rows DESC, n_sets DESC, row_min, row_max, row_xor, ranked.cols LIMIT 20""",
    "longest_text": f"""{VALUED_CONCEPTS}
SELECT array_to_string(row_ids, ' ') || ',' || array_to_string(cols, ' ') || ' % ' || n_rows || ',' || n_cols
  || ',' || n_dup AS value
FROM (SELECT *, count(*) OVER (PARTITION BY row_ids) AS n_dup FROM concepts)
QUALIFY row_number() OVER (PARTITION BY row_ids
  ORDER BY n_cols DESC, length(array_to_string(cols, ' ')) DESC, cols) = 1""",
    "concepts_with_subsupport": f"""{EVERY}
SELECT {ROWS}, {COLS}, n_cols, count(*) OVER (PARTITION BY row_ids) AS n_sets,
       array_to_string(bucket_ids, ',') AS bucket_ids
FROM every""",
    "subsupport_text": f"""{EVERY}
SELECT array_to_string(row_ids, ' ') || ',' || array_to_string(cols, ' ') || ' % ' || n_rows || ',' || n_cols
  AS value
FROM every""",
    "even_biclusters": f"""{chain(ORDERS, TRIPLES, LITERAL, EVEN, VALUED_ITEMS, closed_of(3), CONCEPTS)}
SELECT {ROWS}, {COLS}, n_cols, n_dup
FROM (SELECT *, count(*) OVER (PARTITION BY row_ids) AS n_dup FROM concepts WHERE n_cols >= 2)
QUALIFY row_number() OVER (PARTITION BY row_ids
  ORDER BY n_cols DESC, length(array_to_string(cols, ' ')) DESC, cols) = 1""",
    "bicluster_text": LINES,
    "prepared_roundtrip": chain(ORDERS, SORTED) + " SELECT * FROM sorted",
    "bucket_text_roundtrip": f"""{ORDER_LAST},\n{VALUED_ITEMS}
SELECT {LABEL} AS bucket, item, row_id FROM items b""",
    "bicluster_files": f"""{PART_CONCEPTS}
SELECT n_rows::INT AS n_rows, n_cols, count(*) AS n_lines FROM concepts WHERE n_cols >= 4 GROUP BY 1, 2""",
    "predictable_split": f"""{VECTOR_SETS}
SELECT {ROWS}, {COLS}, n_seeds, predictable, label FROM judged JOIN concepts USING (row_ids, cols)""",
    "training_labels": f"{VECTOR_SETS} SELECT row_id, actual AS label FROM predicted WHERE is_training",
    "predicted_rows": f"{VECTOR_SETS} SELECT * FROM predicted",
    "confusion_matrix": f"""{VECTOR_SETS}
SELECT is_training, actual, predicted, count(*) AS n FROM predicted GROUP BY 1, 2, 3""",
    "confusion_table": f"""{VECTOR_SETS}
SELECT actual, {", ".join(f'count(*) FILTER (predicted = {i}) AS "{i}"' for i in range(10))},
  count(*) FILTER (predicted IS NULL) AS "none"
FROM predicted WHERE NOT is_training GROUP BY 1""",
    "similar_biclusters": chain(ORDERS, blocks(), BLOCK_CLOSED, similar("b_"))
    + f" SELECT {ROWS}, {COLS}, n_cols, value_min, value_max FROM b_similar",
    "similar_vectors": SIMILAR_VECTORS,
    "predicted_documents": PREDICTED_DOCUMENTS,
    "combined_predictions": f"{COMBINED} SELECT * FROM combined",
    "combined_training_labels": f"{COMBINED} SELECT row_id, actual AS label FROM combined WHERE is_training",
    "combined_confusion_matrix": f"""{COMBINED}
SELECT is_training, actual, predicted, count(*) AS n FROM combined GROUP BY 1, 2, 3""",
    "ranked_file": f"""{PART_CONCEPTS},
numbered AS (
  SELECT *, {ROWS.replace('n_rows, ', '', 1)}, count(*) OVER (PARTITION BY row_ids) AS n_sets FROM concepts)
SELECT row_number() OVER (ORDER BY n_rows DESC, n_sets DESC, row_min, row_max, row_xor, cols) - 1 AS line,
  array_to_string(row_ids, ' ') || ',' || array_to_string(cols, ' ') || ' % ' || n_rows || ',' || n_cols AS value
FROM numbered WHERE n_cols >= 4""",
}
