"""Queries of the reshaping, casting and selection operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from ticketloom.functions.rng import hash_u, sql_hash_u
from ticketloom.operators import shaping as P
from ticketloom.plans.grouping import _edges
from ticketloom.plans.modelling import CLASSES, MODELS, _preds, confusion_matrix, model_summary
from ticketloom.plans.modelling_sql import _BASE, _PRED, _metrics

EDGES, BANDS = [0.42, 0.45, 0.50, 1.01], ["low", "middle", "high"]


def _t(spark, sf, name):
    return spark.read.parquet(f"{sf}/{name}.parquet")


def similarity_bands(spark, sf):
    return _edges(spark, sf).groupBy(P.band(F.col("similarity"), EDGES, BANDS).alias("band")).agg(F.count("*").alias("pairs"))


def group_codes(spark, sf):
    d = _t(spark, sf, "customer_it_support_prepared").select("record_id", "text_group_id")
    return P.factorize(d, "text_group_id").select("record_id", "code")


def lenient_versions(spark, sf):
    d = _t(spark, sf, "aa_dataset_tickets").select(F.regexp_extract("body", r"([A-Za-z0-9]+)[^A-Za-z0-9]*$", 1).alias("x"))
    return P.lenient_cast(d, "x", "bigint").agg(F.count("*").alias("rows"), F.count("x").alias("numbers"))


def metrics_wide(spark, sf):
    m = model_summary(spark, sf)
    long = m.select("model", F.explode(F.array(*[F.struct(F.lit(c).alias("metric"), F.col(c).alias("value")) for c in ("accuracy", "macro_f1", "weighted_f1")])).alias("s")).select("model", "s.*")
    return P.wide(long, ["metric"], "model", "value", MODELS)


def first_subjects(spark, sf):
    d = _t(spark, sf, "aa_dataset_tickets").where("subject is not null").select("queue", "source_row_id", "subject").distinct()
    return P.first_joined(d, ["queue"], [F.col("source_row_id"), F.col("subject")], "subject", 5, "subjects")


def class_probabilities(spark, sf):
    """Softmax of hash scores per record and class, averaged by class."""
    d = _t(spark, sf, "customer_it_support_prepared").select("record_id").crossJoin(F.broadcast(spark.createDataFrame([(c,) for c in CLASSES], "label string")))
    s = d.withColumn("score", hash_u(F.concat_ws("-", "record_id", "label"), "score") / float(1 << 30))
    return P.softmax(s, ["record_id"], "score").groupBy("label").agg(F.round(F.avg("probability"), 6).alias("mean"), F.round(F.max("probability"), 6).alias("highest"))


def invalid_sentiment(spark, sf):
    """Hash probabilities of which every hundredth row is spoilt."""
    d = _t(spark, sf, "customer_it_support_prepared").select("record_id", *[(hash_u(F.col("record_id"), c) + 1).cast("double").alias(c) for c in "abc"])
    total = F.col("a") + F.col("b") + F.col("c")
    p = d.select("record_id", F.when(F.col("record_id") % 100 == 0, 1.5).otherwise(F.col("a") / total).alias("negative"), F.when(F.col("record_id") % 100 == 50, F.lit(None)).otherwise(F.col("b") / total).alias("neutral"), (F.col("c") / total).alias("positive"))
    return P.invalid_probabilities(p, ["negative", "neutral", "positive"]).select("record_id")


def confusion_shares(spark, sf):
    return P.row_normalized(confusion_matrix(spark, sf), ["model"]).withColumn("share", F.round("share", 6))


def selected_models(spark, sf):
    m = model_summary(spark, sf)
    return P.best_per_role(m, {"final": F.lit(True), "without_alpha": F.col("model") != "alpha"}, [F.desc("macro_f1"), F.desc("weighted_f1"), F.desc("accuracy"), F.col("model")]).select("role", "model", "macro_f1")


def cased_types(spark, sf):
    d = _t(spark, sf, "aa_dataset_tickets")
    return d.groupBy(P.label_casing(F.col("queue"), ["Technical Support", "Customer Service", "Product Support", "IT Support"]).alias("queue")).agg(F.count("*").alias("records"), P.thousands(F.count("*") * 1000).alias("shown"))


def shown_cases(spark, sf):
    hit = F.col("pred") == F.col("priority")
    p = _preds(spark, sf).groupBy(F.col("record_id").alias("id"), "g", F.col("priority").alias("actual")).agg(F.count_if(hit).alias("right"), F.count("*").alias("models"), F.count_distinct("pred").alias("kinds"), *[F.count_if(F.col("pred") == c).alias(f"votes_{c}") for c in CLASSES])
    return P.select_cases(p)


QUERIES = {f.__name__: f for f in (similarity_bands, group_codes, lenient_versions, metrics_wide, first_subjects, class_probabilities, invalid_sentiment, confusion_shares, selected_models, cased_types, shown_cases)}
_U = lambda s: sql_hash_u("record_id", s)
_DOT = "list_dot_product(x.embedding::double[], y.embedding::double[])"
_SU = f"WITH {_BASE}, {_PRED}, {_metrics('model')}, m AS (SELECT model, round(accuracy, 6) AS accuracy, round(macro_f1, 6) AS macro_f1, round(weighted_f1, 6) AS weighted_f1 FROM su)"
ORACLES = {
    "similarity_bands": f"SELECT CASE WHEN s < 0.45 THEN 'low' WHEN s < 0.5 THEN 'middle' ELSE 'high' END AS band, count(*) AS pairs FROM (SELECT {_DOT} AS s FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id) WHERE s >= 0.42 GROUP BY 1",
    "group_codes": "SELECT record_id, CASE WHEN text_group_id IS NOT NULL THEN dense_rank() OVER (PARTITION BY text_group_id IS NULL ORDER BY text_group_id) - 1 END AS code FROM customer_it_support_prepared",
    "lenient_versions": "SELECT count(*) AS rows, count(try_cast(nullif(regexp_extract(body, '([A-Za-z0-9]+)[^A-Za-z0-9]*$', 1), '') AS bigint)) AS numbers FROM aa_dataset_tickets",
    "metrics_wide": f"{_SU} " + " UNION ALL ".join(f"SELECT '{c}' AS metric, " + ", ".join(f"(SELECT {c} FROM m WHERE model = '{x}') AS {x}" for x in MODELS) for c in ("accuracy", "macro_f1", "weighted_f1")),
    "first_subjects": "SELECT queue, string_agg(subject, '; ' ORDER BY r) AS subjects FROM (SELECT queue, subject, row_number() OVER (PARTITION BY queue ORDER BY source_row_id, subject) AS r FROM (SELECT DISTINCT queue, source_row_id, subject FROM aa_dataset_tickets WHERE subject IS NOT NULL)) WHERE r <= 5 GROUP BY 1",
    "class_probabilities": f"WITH s AS (SELECT record_id, label, {sql_hash_u(chr(39).join(['record_id || ', '-', ' || label']), 'score')} / 1073741824.0::double AS score FROM customer_it_support_prepared, (SELECT unnest(['high', 'low', 'medium']) AS label)), e AS (SELECT *, exp(score) / sum(exp(score)) OVER (PARTITION BY record_id) AS p FROM s) SELECT label, round(avg(p), 6) AS mean, round(max(p), 6) AS highest FROM e GROUP BY 1",
    "invalid_sentiment": "SELECT record_id FROM customer_it_support_prepared WHERE record_id % 50 = 0",
    "confusion_shares": f"WITH {_BASE}, {_PRED}, n AS (SELECT m.model, a.c AS actual, p.c AS predicted, count(x.record_id) AS n FROM (SELECT DISTINCT model FROM pred) m, (SELECT unnest(['high', 'low', 'medium']) AS c) a, (SELECT unnest(['high', 'low', 'medium']) AS c) p LEFT JOIN pred x ON x.model = m.model AND x.priority = a.c AND x.pred = p.c GROUP BY 1, 2, 3) SELECT *, round(coalesce(n::double / nullif(sum(n) OVER (PARTITION BY model, actual), 0), 0), 6) AS share FROM n",
    "selected_models": f"{_SU} SELECT * FROM (SELECT 'final' AS role, model, macro_f1 FROM m ORDER BY macro_f1 DESC, weighted_f1 DESC, accuracy DESC, model LIMIT 1) UNION ALL SELECT * FROM (SELECT 'without_alpha', model, macro_f1 FROM m WHERE model <> 'alpha' ORDER BY macro_f1 DESC, weighted_f1 DESC, accuracy DESC, model LIMIT 1)",
    "cased_types": "SELECT CASE lower(trim(queue)) WHEN 'technical support' THEN 'Technical Support' WHEN 'customer service' THEN 'Customer Service' WHEN 'product support' THEN 'Product Support' WHEN 'it support' THEN 'IT Support' END AS queue, count(*) AS records, format('{:t.}', count(*) * 1000) AS shown FROM aa_dataset_tickets GROUP BY 1",
}
