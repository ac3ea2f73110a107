"""SQL that verifies the queries of ticketloom.llm.queries, as far as SQL goes."""

from __future__ import annotations

#: Recursive closure over the ids, as far as SQL goes: the sets' edges are the pairs (id, smallest id with that entity).
_P1 = """
WITH RECURSIVE r AS (
  SELECT record_id, nullif(regexp_extract(lower(semantic_group_id), '([0-9a-f]{40})', 1), '') AS s, nullif(regexp_extract(lower(text_group_id), '([0-9a-f]{40})', 1), '') AS t
  FROM customer_it_support_prepared WHERE record_id IS NOT NULL),
hub AS (
  SELECT record_id AS a, min(record_id) OVER (PARTITION BY s) AS b FROM r WHERE s IS NOT NULL
  UNION SELECT record_id, min(record_id) OVER (PARTITION BY t) FROM r WHERE t IS NOT NULL),
e AS (SELECT a, b FROM hub WHERE a <> b UNION SELECT b, a FROM hub WHERE a <> b),
reach(v, l) AS (
  SELECT record_id, record_id FROM r WHERE record_id IN (SELECT least(a, b) FROM e) OR record_id NOT IN (SELECT a FROM e)
  UNION SELECT e.b, reach.l FROM reach JOIN e ON reach.v = e.a),
sets AS (SELECT v AS record_id, min(l) AS set_id FROM reach GROUP BY v)
SELECT record_id, set_id FROM sets WHERE set_id IN (
  SELECT set_id FROM sets JOIN r USING (record_id) GROUP BY set_id HAVING count(*) > 1 AND (count(DISTINCT s) <> 1 OR count(s) < count(*)))
"""
ORACLES: dict[str, str] = {"p1_found": _P1}

#: Pairs of near records through their shared words. Equal sets of words are one set, so that hot texts cost no pairs until the end.
_NEAR = """
w AS MATERIALIZED (SELECT record_id, list_sort(list_distinct(regexp_extract_all(text_clean, '[\\p{L}\\p{N}]+'))) AS t FROM customer_it_support_prepared WHERE record_id IS NOT NULL AND text_clean IS NOT NULL),
s AS MATERIALIZED (SELECT min(record_id) AS rep, t, len(t) AS n FROM w WHERE len(t) > 0 GROUP BY t),
x AS MATERIALIZED (SELECT rep, n, unnest(t) AS word FROM s),
p AS MATERIALIZED (SELECT a.rep AS a, b.rep AS b FROM x a JOIN x b ON a.word = b.word AND a.rep < b.rep AND a.n >= 0.7 * b.n - 1e-9 AND b.n >= 0.7 * a.n - 1e-9
  GROUP BY a.rep, b.rep, a.n, b.n HAVING count(*) >= 0.7 * (a.n + b.n - count(*)) - 1e-9)"""

ORACLES["p2_found"] = f"""
WITH RECURSIVE {_NEAR},
e AS (SELECT a, b FROM p UNION SELECT b, a FROM p),
reach(v, l) AS (SELECT a, a FROM e UNION SELECT e.b, reach.l FROM reach JOIN e ON reach.v = e.a AND reach.l < e.b),
c AS (SELECT rep, coalesce(min(l), rep) AS group_id FROM s LEFT JOIN reach ON v = rep GROUP BY rep),
g AS (SELECT record_id, group_id FROM w JOIN s USING (t) JOIN c USING (rep))
SELECT DISTINCT record_id, group_id FROM g WHERE group_id IN (SELECT group_id FROM g GROUP BY 1 HAVING count(DISTINCT record_id) > 1)
"""
_CROSS = f"""{_NEAR},
r AS (SELECT DISTINCT p.record_id, s.split = 'training' AS trained FROM customer_it_support_prepared p JOIN split_assignments s USING (source_row_id) WHERE s.split IN ('training', 'validation', 'holdout')),
m AS (SELECT record_id, trained, rep FROM w JOIN s USING (t) JOIN r USING (record_id)),
q AS (SELECT a, b FROM p UNION ALL SELECT b, a FROM p UNION ALL SELECT rep, rep FROM s),
o AS (SELECT DISTINCT least(x.record_id, y.record_id) AS record_id_a, greatest(x.record_id, y.record_id) AS record_id_b FROM q JOIN m x ON x.rep = a AND x.trained JOIN m y ON y.rep = b AND NOT y.trained WHERE x.record_id <> y.record_id)"""
ORACLES["p5_found"] = f"WITH {_CROSS} SELECT record_id_a, record_id_b FROM o"
ORACLES["p5_counts"] = f"""
WITH {_CROSS},
v AS (SELECT source_row_id, min(version) AS version FROM aa_dataset_tickets WHERE source_row_id IS NOT NULL GROUP BY 1),
d AS (SELECT DISTINCT source_row_id, split FROM split_assignments WHERE split IN ('validation', 'holdout')),
k AS (SELECT record_id AS e, split, version FROM customer_it_support_prepared JOIN d USING (source_row_id) LEFT JOIN v USING (source_row_id)),
t AS (SELECT unnest([record_id_a, record_id_b]) AS e FROM o)
SELECT split, version, count(*) AS pairs, count(DISTINCT e) AS eval_records FROM t JOIN k USING (e) GROUP BY 1, 2
"""
