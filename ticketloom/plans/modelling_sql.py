"""SQL that verifies the queries of ticketloom.plans.modelling."""

from __future__ import annotations

from ticketloom.functions.rng import sql_hash_u
from ticketloom.operators.features import STOP_WORDS
from ticketloom.plans.modelling import ASSESSMENTS, BACKGROUND, CASES, CHARS, CLASSES, MODELS, RIGHT, TERMS
from ticketloom.plans.understanding import _assoc

_PRI = "lower(nullif(trim(regexp_replace(priority, '[\\s\\x{00a0}]+', ' ', 'g')), ''))"
_BASE = f"""base AS MATERIALIZED (SELECT p.* EXCLUDE (priority), {_PRI} AS priority, s.split, coalesce(semantic_group_id, record_id::varchar) AS g FROM customer_it_support_prepared p
  JOIN (SELECT source_row_id, min(split) AS split FROM split_assignments WHERE source_row_id IS NOT NULL GROUP BY 1) s USING (source_row_id) WHERE {_PRI} IN ('high', 'low', 'medium'))"""
_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
_TOK = f"tok AS MATERIALIZED (SELECT record_id AS id, priority, split, list_filter(regexp_extract_all(lower(coalesce(text_clean, '')), '[\\p{{L}}\\p{{N}}_]{{2,}}'), lambda w: w NOT IN ({_STOP})) AS ws FROM base)"
_CNT = "cnt AS MATERIALIZED (SELECT id, feature, count(*)::double AS value FROM (SELECT id, unnest(ws) AS feature FROM tok) GROUP BY 1, 2)"


def _tfidf(most: int) -> str:
    return f"""voc AS (SELECT feature, count(*) AS df, sum(value) AS total FROM cnt GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, feature LIMIT {most}),
w AS (SELECT id, feature, (1 + ln(value)) * (ln((1 + (SELECT count(*) FROM base)) / (1 + df)) + 1) AS w FROM cnt JOIN voc USING (feature)),
vec AS MATERIALIZED (SELECT id, feature, w / sqrt(sum(w * w) OVER (PARTITION BY id)) AS value FROM w)"""


_CHI = """sh AS (SELECT priority AS y, count(*)::double / (SELECT count(*) FROM base) AS share FROM base GROUP BY 1),
obs AS (SELECT feature, y, sum(value) AS o FROM {v} JOIN (SELECT record_id AS id, priority AS y FROM base) USING (id) GROUP BY 1, 2),
chi AS (SELECT feature, sum(o * o / share) / sum(o) - sum(o) AS chi2 FROM obs JOIN sh USING (y) GROUP BY 1)"""
_NB = """tr AS (SELECT c.* FROM cnt c JOIN tok USING (id) WHERE split = 'training'), tv AS (SELECT feature FROM tr GROUP BY 1 HAVING count(*) >= 2), val AS MATERIALIZED (SELECT tr.* FROM tr JOIN tv USING (feature)),
own AS (SELECT feature, priority AS label, sum(value) AS own FROM val JOIN (SELECT id, priority FROM tok) USING (id) GROUP BY 1, 2), tot AS (SELECT feature, sum(value) AS total FROM val GROUP BY 1),
grid AS (SELECT feature, label, total - coalesce(own, 0) + 1.0 AS c FROM tot CROSS JOIN (SELECT DISTINCT priority AS label FROM tok WHERE split = 'training') LEFT JOIN own USING (feature, label)),
nb AS MATERIALIZED (SELECT feature, label, -ln(c / sum(c) OVER (PARTITION BY label)) AS weight FROM grid)"""
_PRED = "pred AS MATERIALIZED (" + " UNION ALL ".join(
    f"SELECT record_id, g, priority, split, '{m}' AS model, CASE WHEN u % 100 < {RIGHT[m]} THEN priority ELSE ['high', 'low', 'medium'][u % 3 + 1] END AS pred, (fu % 5)::int AS fold FROM (SELECT *, {sql_hash_u('record_id', m)} AS u, {sql_hash_u('g', 'fold')} AS fu FROM base)" for m in MODELS) + ")"


def _metrics(keys: str) -> str:
    return f"""lab AS (SELECT {keys}, unnest(['high', 'low', 'medium']) AS label FROM (SELECT DISTINCT {keys} FROM pred)),
cm AS (SELECT {keys}, label, count(*) FILTER (priority = label AND p.pred = label) AS tp, count(*) FILTER (priority = label) AS support, count(*) FILTER (p.pred = label) AS named FROM lab JOIN pred p USING ({keys}) GROUP BY {keys}, label),
cl AS (SELECT {keys}, label, coalesce(tp::double / nullif(named, 0), 0) AS precision, coalesce(tp::double / nullif(support, 0), 0) AS recall, coalesce(2.0 * tp / nullif(named + support, 0), 0) AS f1, support, tp FROM cm),
su AS (SELECT {keys}, sum(tp)::double / sum(support) AS accuracy, avg(precision) AS macro_precision, avg(recall) AS macro_recall, avg(f1) AS macro_f1, sum(f1 * support) / sum(support) AS weighted_f1 FROM cl GROUP BY {keys})"""


_FOLDED = f"WITH {_BASE}, {_PRED}, {_metrics('model, fold')}"
_ATT = f"""WITH {_BASE}, {_TOK}, {_CNT}, {_NB}, wt AS MATERIALIZED (SELECT * FROM nb), v AS MATERIALIZED (SELECT cnt.* FROM cnt SEMI JOIN wt USING (feature)),
bk AS (SELECT record_id AS id FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY {sql_hash_u('record_id', 'background')}, record_id) AS r FROM base WHERE split = 'training') WHERE r <= {BACKGROUND}),
bg AS MATERIALIZED (SELECT v.* FROM v SEMI JOIN bk USING (id)),
rp AS (SELECT record_id, priority FROM base WHERE split <> 'training' QUALIFY row_number() OVER (PARTITION BY g ORDER BY record_id) = 1),
ci AS MATERIALIZED (SELECT record_id AS id, priority AS stratum FROM rp QUALIFY row_number() OVER (PARTITION BY priority ORDER BY {sql_hash_u('record_id', 'cases')}, record_id) <= {CASES}),
ca AS MATERIALIZED (SELECT v.* FROM v SEMI JOIN ci USING (id)),
pd AS MATERIALIZED (SELECT id, label AS pred FROM (SELECT ci.id, l.label, coalesce(s, 0) AS s FROM ci CROSS JOIN (SELECT DISTINCT label FROM wt) l LEFT JOIN (SELECT id, label, sum(value * weight) AS s FROM ca JOIN wt USING (feature) GROUP BY 1, 2) x ON x.id = ci.id AND x.label = l.label)
  QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 6) DESC, label) = 1)"""


def _phi(name: str, back: str, weights: str = "wt") -> str:
    return f"""mean_{name} AS (SELECT feature, sum(value) / (SELECT count(DISTINCT id) FROM {back}) AS mean FROM {back} GROUP BY 1),
full_{name} AS (SELECT id, feature FROM ci CROSS JOIN (SELECT feature FROM mean_{name}) UNION SELECT id, feature FROM ca),
{name} AS MATERIALIZED (SELECT id, label, feature, d * weight AS phi FROM (SELECT f.id, f.feature, coalesce(value, 0) - coalesce(mean, 0) AS d FROM full_{name} f LEFT JOIN ca USING (id, feature) LEFT JOIN mean_{name} USING (feature)) JOIN {weights} USING (feature) WHERE d <> 0)"""


def _compact(name: str, phi: str, keys: str) -> str:
    return f"""{name}_a AS (SELECT {keys}, feature, abs(round(phi, 9)) AS a FROM {phi} WHERE abs(round(phi, 9)) > 0), {name}_r AS (SELECT *, sum(a) OVER (PARTITION BY {keys}) AS mass, row_number() OVER (PARTITION BY {keys} ORDER BY a DESC, feature) AS rank FROM {name}_a),
{name}_s AS (SELECT *, a / mass AS share FROM {name}_r), {name}_c AS (SELECT *, sum(share) OVER (PARTITION BY {keys} ORDER BY rank ROWS UNBOUNDED PRECEDING) AS cum FROM {name}_s),
{name} AS MATERIALIZED (SELECT {keys}, any_value(mass) AS mass, count(*) AS nonzero, """ + ", ".join(f"sum(CASE WHEN rank <= {k} THEN share ELSE 0 END) AS top_{k}_share" for k in (5, 10, 20)) + ", " + ", ".join(f"(min(rank) FILTER (round(cum, 12) >= {q / 100}))::int AS k_{q}" for q in (50, 80, 90)) + f", CASE WHEN count(*) > 1 THEN -sum(share * ln(share)) / ln(count(*)) ELSE 0 END AS entropy FROM {name}_c GROUP BY {keys})"


_P = f"{_ATT}, {_phi('phi', 'bg')}"
_LOCAL = "lc AS (SELECT p.*, CASE WHEN phi > 0 THEN 'positive' ELSE 'negative' END AS direction FROM phi p SEMI JOIN ca USING (id, feature) WHERE phi <> 0), lr AS (SELECT *, row_number() OVER (PARTITION BY id, label, direction ORDER BY round(abs(phi), 9) DESC, feature) AS rank FROM lc)"
_METRICS = ("mass", "nonzero", "top_5_share", "top_10_share", "top_20_share", "k_50", "k_80", "k_90", "entropy")
_SETS = {"top": "round(abs(phi), 9) DESC, p.feature", **{f"r{i}": sql_hash_u("p.id || '|' || p.feature", f"random-{i}") + ", p.feature" for i in range(5)}}
_CONTRAST = (("top_10_share", 1), ("top_5_share", 1), ("top_20_share", 1), ("k_80", -1), ("entropy", -1))
_CHARS = """cnt AS MATERIALIZED (SELECT id, feature, count(*)::double AS value FROM (SELECT id, unnest(CASE WHEN length(p) < 3 THEN [p] ELSE list_transform(range(1, length(p) - n + 2), lambda i: substr(p, i, n)) END) AS feature
  FROM (SELECT record_id AS id, ' ' || unnest(list_filter(regexp_split_to_array(lower(coalesce(text_clean, '')), '\\s+'), lambda w: w <> '')) || ' ' AS p FROM base), (SELECT unnest([3, 4, 5]) AS n) WHERE length(p) >= n OR (length(p) < 3 AND n = 3)) GROUP BY 1, 2)"""
_DRAWS = "draws AS (" + " UNION ALL ".join(f"SELECT i AS iteration, '{m}' AS model, {0.5 + 0.01 * k} + {sql_hash_u('i', 'draw-' + m)} / 4294967296.0::double / 20 AS macro_f1 FROM range(400) r(i)" for k, m in enumerate(MODELS)) + ")"
_HOLM = " UNION ALL ".join(f"SELECT '{c}' AS variable, '{lang}' AS language, p FROM ({_assoc('', f'''(SELECT * FROM base WHERE language = '{lang}')''', c, 'priority').replace(', 6) AS p', ', 9) AS p')})" for c in ("type", "queue") for lang in ("de", "en"))
_CELLS = [f"{a}_{p}" for a in CLASSES for p in CLASSES]

ORACLES = {
    "word_tfidf": f"WITH {_BASE}, {_TOK}, cnt AS MATERIALIZED (SELECT id, feature, count(*)::double AS value FROM (SELECT id, unnest(list_concat(ws, list_transform(range(1, len(ws)), lambda i: ws[i] || ' ' || ws[i + 1]))) AS feature FROM tok) GROUP BY 1, 2), {_tfidf(TERMS)} SELECT id, feature, round(value, 6) AS value FROM vec",
    "char_wb_tfidf": f"WITH {_BASE}, {_CHARS}, {_tfidf(CHARS)} SELECT id, feature, round(value, 6) AS value FROM vec",
    "chi2_top_k": f"WITH {_BASE}, {_TOK}, {_CNT}, {_CHI.format(v='cnt')} SELECT feature, round(chi2, 6) AS chi2 FROM chi ORDER BY round(chi2, 6) DESC, feature LIMIT 50",
    "feature_union_profile": f"""WITH {_BASE}, {_TOK}, {_CNT}, voc AS (SELECT feature, sum(value) AS total FROM cnt GROUP BY 1 HAVING count(*) >= 2 ORDER BY total DESC, feature LIMIT {TERMS}),
u AS (SELECT 'word' AS part, feature, value FROM cnt SEMI JOIN voc USING (feature) UNION ALL SELECT 'cat', 'type=' || type, 1.0 FROM base WHERE type IS NOT NULL UNION ALL SELECT 'cat', 'queue=' || queue, 1.0 FROM base WHERE queue IS NOT NULL
  UNION ALL SELECT 'num', 'text_char_count', text_char_count::double FROM base WHERE text_char_count IS NOT NULL UNION ALL SELECT 'num', 'text_word_count', text_word_count::double FROM base WHERE text_word_count IS NOT NULL)
SELECT part, count(*) AS entries, count(DISTINCT feature) AS features, round(sum(value), 6) AS mass FROM u GROUP BY 1""",
    "majority_baseline": f"WITH {_BASE} SELECT priority, count(*) AS records FROM base WHERE split = 'training' GROUP BY 1 ORDER BY records DESC, priority LIMIT 1",
    "complement_nb_scores": f"WITH {_BASE}, {_TOK}, {_CNT}, {_NB}, sc AS (SELECT h.id, l.label, coalesce(s, 0) AS score FROM (SELECT id FROM tok WHERE split <> 'training') h CROSS JOIN (SELECT DISTINCT label FROM nb) l LEFT JOIN (SELECT id, label, sum(value * weight) AS s FROM cnt JOIN nb USING (feature) GROUP BY 1, 2) x ON x.id = h.id AND x.label = l.label) SELECT id, label, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY round(score, 6) DESC, label) AS r FROM sc) WHERE r = 1",
    "knn_votes": f"""WITH {_BASE}, {_TOK}, {_CNT}, {_tfidf(TERMS)}, sim AS (SELECT q.id AS q, t.id AS t, sum(q.value * t.value) AS s FROM vec q JOIN vec t USING (feature) WHERE q.id % 50 = 0 AND q.id <> t.id GROUP BY 1, 2),
tp AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY q ORDER BY round(s, 9) DESC, t) AS r FROM sim) WHERE r <= 5), vo AS (SELECT q AS id, priority AS label, count(*)::double AS score FROM tp JOIN base ON record_id = t GROUP BY 1, 2),
be AS (SELECT id, label, score FROM (SELECT *, row_number() OVER (PARTITION BY id ORDER BY score DESC, label) AS r FROM vo) WHERE r = 1)
SELECT record_id AS id, coalesce(label, (SELECT priority FROM base GROUP BY 1 ORDER BY count(*) DESC, priority LIMIT 1)) AS label, coalesce(score, 0) AS score FROM base LEFT JOIN be ON be.id = record_id WHERE record_id % 50 = 0""",
    "confusion_matrix": f"WITH {_BASE}, {_PRED} SELECT m.model, a.c AS actual, p.c AS predicted, count(x.record_id) AS n FROM (SELECT DISTINCT model FROM pred) m, (SELECT unnest(['high', 'low', 'medium']) AS c) a, (SELECT unnest(['high', 'low', 'medium']) AS c) p LEFT JOIN pred x ON x.model = m.model AND x.priority = a.c AND x.pred = p.c GROUP BY 1, 2, 3",
    "class_metrics": f"WITH {_BASE}, {_PRED}, {_metrics('model')} SELECT model, label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1, 6) AS f1, support FROM cl",
    "model_summary": f"WITH {_BASE}, {_PRED}, {_metrics('model')} SELECT model, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")) + " FROM su",
    "fold_metrics": f"{_FOLDED} SELECT model, round(avg(macro_f1), 6) AS report_mean, round(stddev_samp(macro_f1), 6) AS report_std, round(avg(macro_f1), 6) AS tuning_mean, round(stddev_pop(macro_f1), 6) AS tuning_std FROM su GROUP BY 1",
    "model_ranking": f"{_FOLDED}, m AS (SELECT model, round(avg(macro_f1), 6) AS macro_f1 FROM su GROUP BY 1) SELECT model, macro_f1, (row_number() OVER w)::int AS rank, round(macro_f1 - lead(macro_f1) OVER w, 6) AS gap, round(macro_f1 - (SELECT macro_f1 FROM m WHERE model = 'beta'), 6) AS delta FROM m WINDOW w AS (ORDER BY macro_f1 DESC, list_position(['alpha', 'beta', 'gamma'], model), model)",
    "fold_steps": f"{_FOLDED}, m AS (SELECT model, fold, round(macro_f1, 6) AS macro_f1 FROM su) SELECT *, round(macro_f1 - first_value(macro_f1) OVER w, 6) AS from_first, round(macro_f1 - lag(macro_f1) OVER w, 6) AS from_previous FROM m WINDOW w AS (PARTITION BY model ORDER BY fold)",
    "pairwise_test": f"""WITH {_DRAWS}, d AS (SELECT x.model, x.iteration, x.macro_f1 - y.macro_f1 AS d FROM draws x JOIN draws y ON x.iteration = y.iteration AND y.model = 'alpha' WHERE x.model <> 'alpha'),
o AS (SELECT x.model, x.m - y.m AS delta FROM (SELECT model, avg(macro_f1) AS m FROM draws GROUP BY 1) x, (SELECT avg(macro_f1) AS m FROM draws WHERE model = 'alpha') y WHERE x.model <> 'alpha'), c AS (SELECT model, avg(d) AS mean FROM d GROUP BY 1),
t AS (SELECT model, any_value(delta) AS delta, quantile_cont(d, 0.025) AS low, quantile_cont(d, 0.975) AS high, quantile_cont(d, 0.05) AS lower_bound, least(1.0, (1 + count(*) FILTER (d - mean >= delta))::double / (1 + count(*))) AS p FROM d JOIN o USING (model) JOIN c USING (model) GROUP BY 1),
h AS (SELECT *, (count(*) OVER () - row_number() OVER (ORDER BY p, model) + 1) * p AS raw FROM t), k AS (SELECT *, least(1.0, max(raw) OVER (ORDER BY p, model ROWS UNBOUNDED PRECEDING)) AS p_holm FROM h)
SELECT model, round(delta, 6) AS delta, round(low, 6) AS low, round(high, 6) AS high, round(lower_bound, 6) AS lower_bound, round(p, 6) AS p, round(p_holm, 6) AS p_holm, delta > 0 AND p_holm < 0.05 AS significant FROM k""",
    "group_contributions": f"WITH {_BASE}, {_PRED}, c AS (SELECT g, " + ", ".join(f"count(*) FILTER (model = 'alpha' AND priority = '{a}' AND pred = '{p}') AS alpha_{a}_{p}" for a in CLASSES for p in CLASSES) + " FROM pred GROUP BY g) SELECT *, count(*) AS groups FROM (SELECT * EXCLUDE (g) FROM c) GROUP BY ALL",
    "holm_adjustment": f"WITH {_BASE}, x AS ({_HOLM}), h AS (SELECT *, (count(*) OVER (PARTITION BY variable) - row_number() OVER (PARTITION BY variable ORDER BY p, language) + 1) * p AS raw FROM x) SELECT variable, language, round(p, 6) AS p, round(least(1.0, max(raw) OVER (PARTITION BY variable ORDER BY p, language ROWS UNBOUNDED PRECEDING)), 6) AS p_holm FROM h",
    "linear_attribution": f"{_P} SELECT id, label, feature, round(phi, 6) AS phi FROM phi",
    "attribution_additivity": f"""{_ATT}, l AS (SELECT DISTINCT label FROM wt), h AS (SELECT id FROM tok WHERE split <> 'training'), s AS (SELECT h.id, l.label, coalesce(x.s, 0) AS s FROM h CROSS JOIN l LEFT JOIN (SELECT id, label, sum(value * weight) AS s FROM cnt JOIN wt USING (feature) GROUP BY 1, 2) x ON x.id = h.id AND x.label = l.label),
b AS (SELECT id, round(s, 5) AS s FROM s QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 6) DESC, label) = 1) SELECT true AS additive, count(*) AS records, count(*) AS rebuilt, round(sum(s), 3) AS score FROM b""",
    "attribution_compactness": f"{_P}, {_compact('k', 'phi', 'id, label')} SELECT id, label, nonzero, k_50, k_80, k_90, " + ", ".join(f"round({c}, 6) AS {c}" for c in ("mass", "top_5_share", "top_10_share", "top_20_share", "entropy")) + " FROM k",
    "attribution_top": f"{_P}, m AS (SELECT label, feature, sum(abs(phi)) / (SELECT count(DISTINCT id) FROM phi p2 WHERE p2.label = phi.label) AS mean_abs FROM phi GROUP BY 1, 2) SELECT label, rank::int AS rank, feature, round(mean_abs, 6) AS mean_abs FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY round(mean_abs, 9) DESC, feature) AS rank FROM m) WHERE rank <= 50",
    "attribution_groups": f"{_P}, x AS (SELECT label, CASE WHEN regexp_matches(feature, '[0-9]') THEN 'number' ELSE 'word' END AS feature_group, sum(abs(phi)) AS m FROM phi GROUP BY 1, 2) SELECT label, feature_group, round(m / sum(m) OVER (PARTITION BY label), 6) AS share FROM x",
    "local_contributions": f"{_P}, {_LOCAL} SELECT id, label, direction, rank::int AS rank, feature, round(phi, 6) AS phi FROM lr WHERE rank <= 10",
    "faithfulness_linear": f"""{_P}, o AS (SELECT p.id, p.feature, ca.value, """ + ", ".join(f"row_number() OVER (PARTITION BY p.id ORDER BY {o}) AS {n}" for n, o in _SETS.items()) + """ FROM phi p JOIN pd ON pd.id = p.id AND pd.pred = p.label JOIN ca ON ca.id = p.id AND ca.feature = p.feature),
u AS (""" + " UNION ALL ".join(f"SELECT id, feature, value, '{n}' AS s, {n} AS place FROM o" for n in _SETS) + """), x AS (SELECT id, label, k, s, sum(value * weight) AS score, sum(CASE WHEN place <= k THEN value * weight ELSE 0 END) AS lost, count(*) FILTER (place <= k) AS removed FROM u JOIN wt USING (feature), (SELECT unnest([1, 3, 5, 10]) AS k) GROUP BY 1, 2, 3, 4),
y AS (SELECT id, k, s, sum(lost) FILTER (label = pred) AS d, max(removed) AS removed, any_value(pred) AS pred, arg_min(label, (-round(score - lost, 9), label)) AS now FROM x JOIN pd USING (id) GROUP BY 1, 2, 3),
z AS (SELECT id, k, max(removed)::int AS removed, sum(d) FILTER (s = 'top') AS drop_top, sum((now <> pred)::int) FILTER (s = 'top')::double AS flip_top, avg(d) FILTER (s <> 'top') AS drop_random, avg((now <> pred)::int) FILTER (s <> 'top') AS flip_random FROM y GROUP BY 1, 2)
SELECT id, k, removed, round(drop_top, 6) AS drop_top, flip_top, round(drop_random, 6) AS drop_random, round(flip_random, 6) AS flip_random, round(drop_top - drop_random, 6) AS advantage, round(drop_top - drop_random, 9) > 0 AS stronger FROM z""",
    "spearman_compare": f"""{_P}, m2 AS (SELECT feature, sum(value) / (SELECT count(DISTINCT id) FROM v) AS mean FROM v GROUP BY 1), j AS (SELECT label, round(abs(a.phi), 9) AS x, round(abs((ca.value - mean) * weight), 9) AS y FROM phi a JOIN ca USING (id, feature) JOIN m2 USING (feature) JOIN wt USING (feature, label)),
k AS (SELECT label, rank() OVER (PARTITION BY label ORDER BY x) + (count(*) OVER (PARTITION BY label, x) - 1) / 2.0 AS rx, rank() OVER (PARTITION BY label ORDER BY y) + (count(*) OVER (PARTITION BY label, y) - 1) / 2.0 AS ry FROM j) SELECT label, round(corr(rx, ry), 6) AS spearman, count(*) AS n FROM k GROUP BY 1""",
    "content_digest": """WITH h AS (SELECT sha256(concat_ws(chr(31), """ + ", ".join(f"coalesce({c}::varchar, chr(1))" for c in ("modeling_row_id", "source_row_id", "semantic_group_id", "text_group_id", "priority", "split")) + """)) AS h FROM split_assignments)
SELECT count(*) AS rows, sha256(concat_ws('-', """ + ", ".join(f"sum(('0x' || substr(h, {1 + 8 * i}, 8))::bigint)::varchar" for i in range(4)) + ")) AS digest FROM h",
    "split_mismatches": "WITH j AS (SELECT p.source_row_id AS a, s.source_row_id AS b, p.text_group_id AS t1, s.text_group_id AS t2, p.priority AS p1, s.priority AS p2 FROM customer_it_support_prepared p FULL JOIN (SELECT source_row_id, min(text_group_id) AS text_group_id, min(priority) AS priority FROM split_assignments GROUP BY 1) s USING (source_row_id)) "
    + " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (x1 IS DISTINCT FROM x2 OR a IS NULL OR b IS NULL) AS mismatches FROM (SELECT a, b, {p}1 AS x1, {p}2 AS x2 FROM j)" for c, p in (("text_group_id", "t"), ("priority", "p"))),
    "upserted_reviews": "WITH n AS (SELECT source_row_id, manual_language AS language FROM language_label_manual_review WHERE manual_language IS NOT NULL) SELECT language, count(*) AS records, count(language_confidence) AS with_confidence FROM (SELECT detected_language AS language, language_confidence FROM language_audit ANTI JOIN n USING (source_row_id) UNION ALL SELECT language, NULL FROM n) GROUP BY 1",
    "only_one_side": "(SELECT source_row_id, 'left' AS side FROM (SELECT source_row_id FROM customer_it_support_prepared EXCEPT SELECT source_row_id FROM split_assignments)) UNION ALL SELECT source_row_id, 'right' FROM (SELECT source_row_id FROM split_assignments EXCEPT SELECT source_row_id FROM customer_it_support_prepared)",
    "review_summary": "SELECT language_review_group AS \"group\", count(manual_language) AS reviewed, count(*) - count(manual_language) AS open, " + ", ".join(f"count(*) FILTER (manual_assessment = '{a}') AS {a}" for a in ASSESSMENTS) + ", count(*) FILTER (manual_language = detected_language) AS agreed FROM language_label_manual_review GROUP BY 1",
    "review_defects": "SELECT 'repeated review_id' AS defect, count(*) AS records FROM (SELECT review_id FROM language_label_manual_review GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'unknown assessment', count(*) FILTER (manual_assessment NOT IN (" + ", ".join(f"'{a}'" for a in ASSESSMENTS) + ")) FROM language_label_manual_review UNION ALL SELECT 'confirmed without a language', count(*) FILTER (author_confirmation = 'confirmed' AND manual_language IS NULL) FROM language_label_manual_review UNION ALL SELECT 'language without confirmation', count(*) FILTER (manual_language IS NOT NULL AND coalesce(author_confirmation, '') <> 'confirmed') FROM language_label_manual_review",
    "compactness_summary": f"{_P}, ac AS (SELECT p.* FROM phi p SEMI JOIN ca USING (id, feature)), {_compact('kf', 'phi', 'id, label')}, {_compact('ka', 'ac', 'id, label')}, k AS (SELECT 'full' AS scope, * FROM kf UNION ALL SELECT 'active', * FROM ka), m AS (" + " UNION ALL ".join(f"SELECT label, scope, '{c}' AS metric, {c}::double AS v FROM k" for c in _METRICS) + ") SELECT label, scope, metric, round(avg(v), 6) AS mean, round(quantile_cont(v, 0.5), 6) AS median, round(stddev_samp(v), 6) AS std FROM m GROUP BY 1, 2, 3",
    "assessment_template": f"{_P}, {_LOCAL}, f AS (SELECT id, pred, direction, string_agg(feature, '; ' ORDER BY rank) AS t FROM lr JOIN pd USING (id) WHERE rank <= 3 AND label = pred GROUP BY 1, 2, 3) SELECT pd.id, pd.pred, p.t AS positive, n.t AS negative, NULL::varchar AS plausibility, NULL::varchar AS comment FROM pd LEFT JOIN f p ON p.id = pd.id AND p.direction = 'positive' LEFT JOIN f n ON n.id = pd.id AND n.direction = 'negative'",
    "compactness_contrast": f"""{_P}, mo AS (SELECT feature, priority AS label, sum(value) AS own FROM val JOIN (SELECT id, priority FROM tok) USING (id) GROUP BY 1, 2), mg AS (SELECT feature, label, coalesce(own, 0) + 1.0 AS c FROM (SELECT DISTINCT feature FROM mo) CROSS JOIN (SELECT DISTINCT label FROM nb) LEFT JOIN mo USING (feature, label)),
w2 AS MATERIALIZED (SELECT feature, label, ln(c / sum(c) OVER (PARTITION BY label)) AS weight FROM mg), {_phi('phi2', 'bg', 'w2')},
p2 AS (SELECT id, label FROM (SELECT ci.id, l.label, coalesce(s, 0) AS s FROM ci CROSS JOIN (SELECT DISTINCT label FROM w2) l LEFT JOIN (SELECT id, label, sum(value * weight) AS s FROM ca JOIN w2 USING (feature) GROUP BY 1, 2) x ON x.id = ci.id AND x.label = l.label) QUALIFY row_number() OVER (PARTITION BY id ORDER BY round(s, 6) DESC, label) = 1),
q1 AS (SELECT phi.* FROM phi JOIN pd ON pd.id = phi.id AND pd.pred = phi.label), q2 AS (SELECT phi2.* FROM phi2 SEMI JOIN p2 USING (id, label)), {_compact('k1', 'q1', 'id')}, {_compact('k2', 'q2', 'id')},
d AS MATERIALIZED (SELECT id, stratum, row_number() OVER (PARTITION BY stratum ORDER BY id) - 1 AS i, """ + ", ".join(f"{sign} * (round(k1.{m}::double, 9) - round(k2.{m}::double, 9)) AS {m}" for m, sign in _CONTRAST) + f""" FROM k1 JOIN k2 USING (id) JOIN ci USING (id)), n AS (SELECT stratum, count(*) AS n FROM d GROUP BY 1),
it AS (SELECT stratum, n, unnest(range(20)) AS iteration FROM n), jt AS (SELECT *, unnest(range(n)) AS j FROM it), dr AS (SELECT stratum, n, iteration, {sql_hash_u("stratum || '-' || iteration || '-' || j", 'contrast')} % n AS i FROM jt),
mn AS (SELECT iteration, stratum, any_value(n) AS n, """ + ", ".join(f"avg({m}) AS {m}" for m, _ in _CONTRAST) + " FROM dr JOIN d USING (stratum, i) GROUP BY 1, 2), al AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, iteration, sum({m} * n) / sum(n) AS d FROM mn GROUP BY iteration" for m, _ in _CONTRAST) + "), ob AS (" + " UNION ALL ".join(f"SELECT '{m}' AS metric, avg({m}) AS observed FROM d" for m, _ in _CONTRAST) + """),
ce AS (SELECT metric, avg(d) AS c FROM al GROUP BY 1) SELECT metric, round(any_value(observed), 6) AS observed, round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, round(least(1.0, (1 + count(*) FILTER (d - c >= observed))::double / (1 + count(*))), 6) AS p FROM al JOIN ob USING (metric) JOIN ce USING (metric) GROUP BY metric""",
    "integrity_audit": f"""WITH {_BASE}, {_PRED}, {_metrics('model')}, c AS (
  SELECT 'data' AS category, 'record_id is unique' AS "check", 0.0 AS expected, (SELECT count(*) FROM (SELECT record_id FROM customer_it_support_prepared GROUP BY 1 HAVING count(*) > 1))::double AS v, 0.0 AS t
  UNION ALL SELECT 'data', 'source_row_id is unique', 0, (SELECT count(*) FROM (SELECT source_row_id FROM customer_it_support_prepared GROUP BY 1 HAVING count(*) > 1)), 0
  UNION ALL SELECT 'data', 'raw rows are delivered once', 0, (SELECT count(*) FROM (SELECT source_row_id FROM aa_dataset_tickets GROUP BY 1 HAVING count(*) > 1)), 0
  UNION ALL SELECT 'data', 'prepared tickets exist', 0, (SELECT count(*) FROM customer_it_support_prepared ANTI JOIN aa_dataset_tickets USING (source_row_id)), 0
  UNION ALL SELECT 'data', 'no empty text', 0, (SELECT count(*) FROM customer_it_support_prepared WHERE trim(coalesce(text_clean, '')) = ''), 0
  UNION ALL SELECT 'split', 'share of training', 0.7, (SELECT avg((split = 'training')::int) FROM split_assignments), 0.05
  UNION ALL SELECT 'split', 'no text group in two parts', 0, (SELECT count(*) FROM (SELECT text_group_id FROM split_assignments WHERE text_group_id IS NOT NULL GROUP BY 1 HAVING count(DISTINCT split) > 1)), 0
  UNION ALL SELECT 'evaluation', 'alpha''s accuracy', 0.8, (SELECT round(accuracy, 6) FROM su WHERE model = 'alpha'), 0.03)
SELECT category, "check", expected::double AS expected, round(v, 9) AS observed, CASE WHEN coalesce(abs(v - expected) <= t, false) THEN 'PASS' ELSE 'FAIL' END AS status FROM c""",
}
