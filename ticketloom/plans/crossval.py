"""Queries of cross-validation: grid, out-of-fold predictions, choice of a feature set, refit."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.functions.rng import hash_u, sql_hash_u
from ticketloom.operators import crossval as C
from ticketloom.operators import features as V
from ticketloom.plans.modelling import CLASSES, _base, _r
from ticketloom.plans.modelling_sql import _BASE, _CNT, _TOK
from ticketloom.session import written

FOLDS = 5
ALPHAS = [0.1, 0.5, 1.0]
SETS = ["FS1", "FS2", "FS3", "FS4"]


def _rows(d: DataFrame) -> DataFrame:
    return d.select(F.col("record_id").alias("id"), F.col("priority").alias("label"), (hash_u(F.col("g"), "cv") % FOLDS).cast("int").alias("fold"))


def _fitted(spark, sf, sets, alphas):
    d = _base(spark, sf)
    values = written(C.feature_set_values(d, "record_id", V.tokens(F.col("text_clean")), sets), "fs-values")
    rows = written(_rows(d.where("split = 'training'")), "fs-rows")
    return d, values, rows, written(C.fold_weights(values, rows, FOLDS, alphas), "fs-weights")


def _judged(spark, sf, sets, alphas):
    """Metrics of every candidate. Rows are scored one by one where they lie; where an id has several rows, in or out of the training part, their words count together."""
    keys = ["fs", "model", "alpha"]
    d = _base(spark, sf)
    fold = F.when(F.col("split") == "training", (hash_u(F.col("g"), "cv") % FOLDS).cast("int")).alias("fold")
    known = [F.when(F.col("record_id").isNotNull(), F.col(c)).alias(c) for c in ("text_clean", *C.KINDS[1:])]
    d = d.select(F.col("record_id").alias("id"), F.col("priority").alias("label"), fold, "split", *known)
    train, words = d.where("split = 'training'"), V.tokens(F.col("text_clean"))
    if d.where("id is not null").groupBy("id").count().where("count > 1").isEmpty():
        rows = written(C.coded(train, words, [F.col("label"), F.col("fold")]), "cv-rows")
        labels = sorted(r["label"] for r in rows.select("label").distinct().collect())  # a row per class
    else:
        labels = sorted(r["label"] for r in train.select("label").distinct().collect())
        rows = written(C.by_id(C.coded(d.drop("split").repartition("id").sortWithinPartitions("id"), words, [F.col("id"), F.col("label"), F.col("fold")]), FOLDS, labels), "cv-rows")
    fits = C.FoldFits(rows, FOLDS, labels)
    conf = written(C.fold_confusion(rows, fits, sets, alphas), "cv-confusion")
    fits.discard()
    held, trained = (C.confusion_scores(conf, part, CLASSES, [*keys, "fold"]) for part in ("held_out", "train"))
    return C.grid_summary(held, trained, keys)


_OUT = [f"{n}_{m}" for n in ("mean", "std") for m in C.METRICS] + ["train_macro_f1", "gap"]


def cv_grid(spark, sf):
    """Every candidate over shared folds of groups, with training scores and gap."""
    return _r(_judged(spark, sf, ["FS1"], ALPHAS), *_OUT).drop("fs")


def feature_set_choice(spark, sf):
    return _r(C.choose_feature_set(_judged(spark, sf, SETS, [0.5])), *C.METRICS)


def oof_predictions(spark, sf):
    """A prediction of each model for every training record, by the fit that has not seen its group."""
    _, values, rows, weights = _fitted(spark, sf, ["FS4"], [0.5])
    return C.predictions(values, rows, weights, "held_out", FOLDS).select(F.col("id").alias("record_id"), "model", "fold", "label", "pred")


def refit_holdout(spark, sf):
    """Hold-out metrics of fits on all training rows."""
    d, values, _, weights = _fitted(spark, sf, ["FS4"], [0.5])
    rows = _rows(d.where("split <> 'training'")).withColumn("fold", F.lit(FOLDS))
    return _r(C.scores(C.predictions(values, rows, weights, "held_out", FOLDS + 1), CLASSES, ["model"]), *C.METRICS)


def fold_roles(spark, sf):
    """Hold-out is fold 0 of five; folds 1 and 2 are the screening pool, the others the rest of the training part."""
    d = _base(spark, sf).withColumn("fold", (hash_u(F.col("g"), "role") % FOLDS).cast("int"))
    role = F.when(F.col("fold") == 0, "hold-out").when(F.col("fold") <= 2, "screening").otherwise("training")
    return d.groupBy(role.alias("role"), "priority").agg(F.count("*").alias("records"), F.count_distinct("g").alias("groups"))


QUERIES = {f.__name__: f for f in (cv_grid, feature_set_choice, oof_predictions, refit_holdout, fold_roles)}


def _sql(sets: list[str], alphas: list[float]) -> str:
    """v, rw and the weights w of every fit, as in operators.crossval; fold FOLDS is the fit on all rows."""
    parts = []
    for s in sets:
        parts.append(f"SELECT '{s}' AS fs, id, 'word:' || feature AS feature, value FROM cnt")
        parts += [f"SELECT '{s}', record_id, 'cat:{c}=' || {c}, 1.0 FROM base WHERE {c} IS NOT NULL" for c in C.FEATURE_SETS[s]]
    return f"""WITH {_BASE}, {_TOK}, {_CNT}, v AS MATERIALIZED ({' UNION ALL '.join(parts)}),
al AS (SELECT record_id AS id, priority AS label, split, ({sql_hash_u('g', 'cv')} % {FOLDS})::int AS fold FROM base), rw AS MATERIALIZED (SELECT id, label, fold FROM al WHERE split = 'training'),
ft AS (SELECT unnest(range({FOLDS} + 1))::int AS fold), tr AS MATERIALIZED (SELECT v.fs, ft.fold, feature, label, sum(value) AS v, count(*) AS d FROM v JOIN rw USING (id) JOIN ft ON ft.fold <> rw.fold GROUP BY ALL),
tot AS (SELECT fs, fold, feature, sum(v) AS a FROM tr GROUP BY ALL HAVING sum(d) >= 2),
gr AS (SELECT fs, fold, feature, label, a, coalesce(v, 0) AS v FROM tot CROSS JOIN (SELECT DISTINCT label FROM rw) LEFT JOIN tr USING (fs, fold, feature, label)),
k AS (SELECT fs, fold, feature, label, model, alpha, CASE WHEN model = 'complement_nb' THEN a - v ELSE v END + alpha AS k FROM gr, (SELECT unnest(['complement_nb', 'multinomial_nb']) AS model), (SELECT unnest([{', '.join(f'{a}::double' for a in alphas)}]) AS alpha)),
w AS MATERIALIZED (SELECT *, ln(k / sum(k) OVER (PARTITION BY fs, fold, model, alpha, label)) * CASE WHEN model = 'complement_nb' THEN -1 ELSE 1 END AS weight FROM k)"""


def _pred(name: str, asked: str) -> str:
    return f"""{name}_s AS (SELECT fs, fold, model, alpha, id, w.label, sum(value * weight) AS s FROM ({asked}) q JOIN v USING (id) JOIN w USING (fs, fold, feature) GROUP BY ALL),
{name}_b AS (SELECT fs, fold, model, alpha, id, label AS pred FROM {name}_s QUALIFY row_number() OVER (PARTITION BY fs, fold, model, alpha, id ORDER BY round(s, 6) DESC, label) = 1),
{name} AS MATERIALIZED (SELECT f.fs, fold, f.model, f.alpha, id, q.label, coalesce(pred, (SELECT min(label) FROM rw)) AS pred FROM ({asked}) q JOIN (SELECT DISTINCT fs, fold, model, alpha FROM w) f USING (fold) LEFT JOIN {name}_b USING (fs, fold, model, alpha, id))"""


def _scored(name: str, preds: str, keys: str) -> str:
    return f"""{name}_l AS (SELECT {keys}, unnest(['high', 'low', 'medium']) AS c FROM (SELECT DISTINCT {keys} FROM {preds})),
{name}_c AS (SELECT {keys}, c, count(*) FILTER (label = c AND pred = c) AS tp, count(*) FILTER (label = c) AS su, count(*) FILTER (pred = c) AS na FROM {name}_l JOIN {preds} USING ({keys}) GROUP BY {keys}, c),
{name} AS (SELECT {keys}, sum(tp)::double / sum(su) AS accuracy, avg(coalesce(2.0 * tp / nullif(su + na, 0), 0)) AS macro_f1, sum(coalesce(2.0 * tp / nullif(su + na, 0), 0) * su) / sum(su) AS weighted_f1 FROM {name}_c GROUP BY {keys})"""


_HELD, _TRAIN = "SELECT id, label, fold FROM rw", f"SELECT id, label, f.fold FROM rw JOIN (SELECT unnest(range({FOLDS}))::int AS fold) f ON f.fold <> rw.fold"
_CV = f"""{_pred('ph', _HELD)}, {_pred('pt', _TRAIN)}, {_scored('sh', 'ph', 'fs, model, alpha, fold')}, {_scored('st', 'pt', 'fs, model, alpha, fold')},
gs AS (SELECT fs, model, alpha, {', '.join(f'avg({m}) AS mean_{m}, stddev_pop({m}) AS std_{m}' for m in C.METRICS)} FROM sh GROUP BY ALL),
g AS (SELECT *, train_macro_f1 - mean_macro_f1 AS gap FROM gs JOIN (SELECT fs, model, alpha, avg(macro_f1) AS train_macro_f1 FROM st GROUP BY ALL) USING (fs, model, alpha))"""
_BEST = ", ".join(f"round({{p}}{m}, 9) DESC" for m in C.METRICS)
ORACLES = {
    "cv_grid": f"{_sql(['FS1'], ALPHAS)}, {_CV} SELECT model, alpha, {', '.join(f'round({c}, 6) AS {c}' for c in _OUT)}, (row_number() OVER (ORDER BY {_BEST.format(p='mean_')}, fs, model, alpha))::int AS rank FROM g",
    "feature_set_choice": f"{_sql(SETS, [0.5])}, {_CV}, m AS (SELECT fs, {', '.join(f'avg(mean_{m}) AS {m}' for m in C.METRICS)} FROM g GROUP BY fs), r AS (SELECT *, (row_number() OVER (ORDER BY {_BEST.format(p='')}, fs))::int AS rank FROM m) SELECT fs, {', '.join(f'round({m}, 6) AS {m}' for m in C.METRICS)}, rank, rank = 1 AS selected FROM r",
    "oof_predictions": f"{_sql(['FS4'], [0.5])}, {_pred('ph', _HELD)} SELECT id AS record_id, model, fold, label, pred FROM ph",
    "refit_holdout": f"{_sql(['FS4'], [0.5])}, {_pred('ph', f'''SELECT id, label, {FOLDS} AS fold FROM al WHERE split <> 'training' ''')}, {_scored('sh', 'ph', 'model')} SELECT model, {', '.join(f'round({m}, 6) AS {m}' for m in C.METRICS)} FROM sh",
    "fold_roles": f"WITH {_BASE} SELECT CASE WHEN fold = 0 THEN 'hold-out' WHEN fold <= 2 THEN 'screening' ELSE 'training' END AS role, priority, count(*) AS records, count(DISTINCT g) AS groups FROM (SELECT *, ({sql_hash_u('g', 'role')} % {FOLDS})::int AS fold FROM base) GROUP BY 1, 2",
}
