"""Queries of similarity, grouping, sampling and resampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.functions.rng import SPAN, hash_u, sql_hash_u
from ticketloom.operators import linkage as L
from ticketloom.operators import sampling as S
from ticketloom.operators import similarity as M
from ticketloom.operators.components import connected_components
from ticketloom.session import written

TAU = 0.42
LEVELS = [0.42, 0.45, 0.5]


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _edges(spark, sf):
    return written(M.similarity_edges(_t(spark, sf, "embeddings"), "vec_id", "embedding", TAU), "edges")


def _groups(spark, sf, edges=None):
    return L.complete_linkage(edges or _edges(spark, sf), _t(spark, sf, "embeddings"), "vec_id")


def similarity_edges(spark, sf):
    return _edges(spark, sf).select("a", "b", F.round("similarity", 6).alias("similarity"))


def nearest_neighbours(spark, sf):
    """Queries: every vector whose id is divisible by 50, against all."""
    d = _t(spark, sf, "embeddings")
    return M.nearest_neighbours(d, d.where("vec_id % 50 = 0"), "vec_id", "embedding", 3).withColumn("similarity", F.round("similarity", 6))


def unit_norms(spark, sf):
    return M.unit_norm_violations(_t(spark, sf, "embeddings"), "embedding")


def redundancy_summary(spark, sf):
    return M.redundancy(_edges(spark, sf), _t(spark, sf, "embeddings"), "vec_id", "label", LEVELS)


def components(spark, sf):
    return connected_components(_edges(spark, sf))


def complete_linkage_groups(spark, sf):
    return _groups(spark, sf)


def group_cohesion(spark, sf):
    """Cohesion of the components with two vectors or more."""
    e = _edges(spark, sf)
    g = connected_components(e).select(F.col("id").alias("vec_id"), F.col("component").alias("group_id"))
    return L.cohesion(g, e, "vec_id", TAU).select("group_id", "pairs", *[F.round(c, 6).alias(c) for c in ("min_similarity", "p05_similarity", "median_similarity", "mean_similarity", "share_above")])


def linkage_cohesion(spark, sf):
    e = _edges(spark, sf)
    return L.cohesion(_groups(spark, sf, e), e, "vec_id", TAU)


def grouping_summary(spark, sf):
    e = _edges(spark, sf)
    out = L.grouping_summary(_groups(spark, sf, e), e, "vec_id", TAU)
    return out.withColumns({c: F.round(c, 6) for c in ("min_similarity", "min_share")})


def linkage_invariants(spark, sf):
    """Violations of complete linkage: members not linked, groups that could still merge, records lost."""
    e, d = _edges(spark, sf), _t(spark, sf, "embeddings")
    g = written(_groups(spark, sf, e), "groups")
    pairs = lambda x: F.col(x) * (F.col(x) - 1) / 2
    side = lambda x: g.select(F.col("vec_id").alias(x), F.col("group_id").alias("g" + x), F.col("group_size").alias("n" + x))
    both = e.join(side("a"), "a").join(side("b"), "b")
    inside = both.where("ga = gb").groupBy("ga").agg(F.count("*").alias("k"))
    loose = g.where("group_size > 1").select("group_id", "group_size").distinct().join(inside, F.col("group_id") == F.col("ga"), "left").where(F.coalesce("k", F.lit(0)) != pairs("group_size"))
    open_ = both.where("ga <> gb").groupBy(F.least("ga", "gb").alias("x"), F.greatest("ga", "gb").alias("y")).agg(F.count("*").alias("k"), F.max(F.col("na") * F.col("nb")).alias("n")).where("k = n")
    n = lambda df, name: df.agg(F.count("*").alias("violations")).select(F.lit(name).alias("invariant"), "violations")
    return n(loose, "all pairs are linked").unionByName(n(open_, "no two groups can merge")).unionByName(n(d.join(g, "vec_id", "left_anti"), "every record has a group"))


def group_names(spark, sf):
    """Names of the components with two vectors or more."""
    g = connected_components(_edges(spark, sf)).select(F.col("id").alias("vec_id"), F.col("component").alias("group_id"))
    return L.group_names(g, "vec_id")


def not_nested(spark, sf):
    """Text groups that are spread over several semantic groups."""
    d = _t(spark, sf, "customer_it_support_prepared")
    hexed = lambda c: F.nullif(F.regexp_extract(F.lower(c), "([0-9a-f]{40})", 1), F.lit(""))
    return L.not_nested(d.select(hexed("text_group_id").alias("text_group"), hexed("semantic_group_id").alias("semantic_group")), "text_group", "semantic_group")


def _prepared(spark, sf):
    return _t(spark, sf, "customer_it_support_prepared").withColumns({"priority": T.clean_category(F.col("priority"), True), "g": F.nullif(F.regexp_extract(F.lower("semantic_group_id"), "([0-9a-f]{40})", 1), F.lit(""))})


def stratified_sample(spark, sf):
    d = _prepared(spark, sf)
    return S.stratified_sample(d, "record_id", [F.col("priority"), F.col("language")], 5, "review").select("record_id", "priority", "language")


def group_representatives(spark, sf):
    return S.group_representatives(_prepared(spark, sf), "g", "record_id").select("g", "record_id")


def nested_background(spark, sf):
    d = _prepared(spark, sf).where("priority is not null")
    ref = S.stratified_sample(d, "record_id", [F.col("priority")], 5, "reference")
    return S.nested_extension(d, ref, "record_id", "priority", 20, "extension")


def fold_balance(spark, sf):
    """Records by hash fold and priority; the groups stay together."""
    d = S.hash_folds(_prepared(spark, sf).where("g is not null"), "g", 5, "folds")
    return d.groupBy("fold", "priority").agg(F.count("*").alias("records"), F.count_distinct("g").alias("groups"))


def stratified_folds(spark, sf):
    d = _prepared(spark, sf).where("g is not null")
    return S.stratified_group_folds(d, "record_id", "g", "priority", 5)


def split_leakage(spark, sf):
    """Text groups in more than one part of the earlier split."""
    d = _t(spark, sf, "split_assignments").withColumn("g", F.nullif(F.regexp_extract(F.lower("text_group_id"), "([0-9a-f]{40})", 1), F.lit("")))
    return S.leaking_groups(d, "g", "split")


def design_summary(spark, sf):
    d = _t(spark, sf, "split_assignments").withColumn("priority", T.clean_category(F.col("priority"), True)).distinct()
    return d.groupBy("split").agg(F.count("*").alias("records"), F.count_distinct("semantic_group_id").alias("groups"), *[F.count_if(F.coalesce(F.col("priority") == p, F.lit(False))).alias(p) for p in ("low", "medium", "high")])


def _means(spark, sf):
    d = _t(spark, sf, "events").groupBy("event_type", "user_id").agg(F.round(F.avg("value"), 6).alias("x"))
    from pyspark.sql import Window

    return d.withColumn("i", (F.row_number().over(Window.partitionBy("event_type").orderBy("user_id")) - 1).cast("bigint")).select("event_type", "i", "x")


def stratified_bootstrap_means(spark, sf):
    """Twenty paired draws of the means of all users within each event type."""
    return S.hash_bootstrap(_means(spark, sf), "i", "x", 20, "boot", ["event_type"]).withColumn("mean", F.round("mean", 6))


QUERIES = {f.__name__: f for f in (
    similarity_edges, nearest_neighbours, unit_norms, redundancy_summary, components, complete_linkage_groups, group_cohesion, linkage_cohesion, grouping_summary, linkage_invariants, group_names, not_nested, stratified_sample, group_representatives, nested_background,
    fold_balance, stratified_folds, split_leakage, design_summary, stratified_bootstrap_means,
)}

_DOT = "list_dot_product(x.embedding::double[], y.embedding::double[]) / sqrt(list_dot_product(x.embedding::double[], x.embedding::double[]) * list_dot_product(y.embedding::double[], y.embedding::double[]))"
_E = f"edges AS MATERIALIZED (SELECT x.vec_id AS a, y.vec_id AS b, {_DOT} AS similarity FROM embeddings x JOIN embeddings y ON x.vec_id < y.vec_id WHERE {_DOT} >= {TAU})"
_C = "sym AS (SELECT a, b FROM edges UNION SELECT b, a FROM edges), reach(v, l) AS (SELECT a, a FROM sym UNION SELECT s.b, r.l FROM reach r JOIN sym s ON r.v = s.a), comp AS (SELECT v AS id, min(l) AS component FROM reach GROUP BY v)"
_P = "(SELECT * EXCLUDE (priority), lower(nullif(trim(regexp_replace(priority, '[\\s\\x{00a0}]+', ' ', 'g')), '')) AS priority, nullif(regexp_extract(lower(semantic_group_id), '([0-9a-f]{40})', 1), '') AS g FROM customer_it_support_prepared)"
_NONE = ""
ORACLES = {
    "similarity_edges": f"WITH {_E} SELECT a, b, round(similarity, 6) AS similarity FROM edges",
    "nearest_neighbours": f"SELECT query, rank::int AS rank, neighbour, round(s, 6) AS similarity FROM (SELECT x.vec_id AS query, y.vec_id AS neighbour, {_DOT} AS s, row_number() OVER (PARTITION BY x.vec_id ORDER BY round({_DOT}, 12) DESC, y.vec_id) AS rank FROM embeddings x JOIN embeddings y ON x.vec_id <> y.vec_id WHERE x.vec_id % 50 = 0) WHERE rank <= 3",
    "unit_norms": "SELECT sum((coalesce(abs(sqrt(list_dot_product(embedding::double[], embedding::double[])) - 1) > 1e-4, true))::bigint)::bigint AS violations FROM embeddings",
    "redundancy_summary": f"WITH {_E} SELECT t AS threshold, (SELECT count(*) FROM edges WHERE similarity >= t) AS pairs, (SELECT count(DISTINCT v) FROM (SELECT unnest([a, b]) AS v, similarity FROM edges) WHERE similarity >= t) AS records, (SELECT count(*) FROM edges JOIN embeddings x ON x.vec_id = a JOIN embeddings y ON y.vec_id = b WHERE similarity >= t AND x.label IS DISTINCT FROM y.label) AS conflicting FROM (SELECT unnest([{', '.join(f'{t}::double' for t in LEVELS)}]) AS t)",
    "components": f"WITH RECURSIVE {_E}, {_C} SELECT id, component FROM comp",
    "group_cohesion": f"WITH RECURSIVE {_E}, {_C} SELECT component AS group_id, count(*) AS pairs, round(min(similarity), 6) AS min_similarity, round(quantile_cont(similarity, 0.05), 6) AS p05_similarity, round(quantile_cont(similarity, 0.5), 6) AS median_similarity, round(avg(similarity), 6) AS mean_similarity, round(avg((similarity >= {TAU} - 1e-6)::int), 6) AS share_above FROM edges JOIN comp ON id = a GROUP BY 1",
    "stratified_sample": f"SELECT record_id, priority, language FROM (SELECT *, row_number() OVER (PARTITION BY priority, language ORDER BY {sql_hash_u('record_id', 'review')}, record_id) AS r FROM {_P}) WHERE r <= 5",
    "group_representatives": f"SELECT g, min(record_id) AS record_id FROM {_P} WHERE g IS NOT NULL GROUP BY g",
    "nested_background": f"""
WITH d AS (SELECT * FROM {_P} WHERE priority IS NOT NULL), ref AS (SELECT record_id, priority FROM (SELECT *, row_number() OVER (PARTITION BY priority ORDER BY {sql_hash_u('record_id', 'reference')}, record_id) AS r FROM d) WHERE r <= 5)
SELECT record_id, priority, 'reference' AS origin FROM ref UNION ALL SELECT record_id, priority, 'extension' FROM (SELECT d.record_id, d.priority, row_number() OVER (PARTITION BY d.priority ORDER BY {sql_hash_u('d.record_id', 'extension')}, d.record_id) AS r, (SELECT count(*) FROM ref WHERE ref.priority = d.priority) AS have FROM d ANTI JOIN ref USING (record_id)) WHERE r <= 20 - have""",
    "fold_balance": f"SELECT ({sql_hash_u('g', 'folds')} % 5)::int AS fold, priority, count(*) AS records, count(DISTINCT g) AS groups FROM {_P} WHERE g IS NOT NULL GROUP BY 1, 2",
    "split_leakage": "SELECT g, count(DISTINCT split) AS parts FROM (SELECT nullif(regexp_extract(lower(text_group_id), '([0-9a-f]{40})', 1), '') AS g, split FROM split_assignments) WHERE g IS NOT NULL GROUP BY g HAVING count(DISTINCT split) > 1",
    "design_summary": "SELECT split, count(*) AS records, count(DISTINCT semantic_group_id) AS groups, " + ", ".join(f"count(*) FILTER (priority = '{p}') AS {p}" for p in ("low", "medium", "high")) + " FROM (SELECT DISTINCT * EXCLUDE (priority), lower(nullif(trim(regexp_replace(priority, '[\\s\\x{00a0}]+', ' ', 'g')), '')) AS priority FROM split_assignments) GROUP BY split",
    "stratified_bootstrap_means": f"""
WITH d AS (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY user_id) - 1 AS i, x FROM (SELECT event_type, user_id, round(avg(value), 6) AS x FROM events GROUP BY 1, 2)),
n AS (SELECT event_type, count(*) AS n FROM d GROUP BY 1),
s AS (SELECT event_type, it AS iteration, {sql_hash_u("event_type || '-' || it || '-' || j", 'boot')} % n AS i FROM (SELECT *, unnest(range(n)) AS j FROM (SELECT *, unnest(range(20)) AS it FROM n)))
SELECT iteration, event_type, round(avg(x), 6) AS mean FROM s JOIN d USING (event_type, i) GROUP BY 1, 2""",
    "linkage_invariants": "SELECT unnest(['all pairs are linked', 'no two groups can merge', 'every record has a group']) AS invariant, 0::bigint AS violations",
    "group_names": f"WITH RECURSIVE {_E}, {_C} SELECT component AS group_id, sha1('semantic_complete_linkage|' || string_agg(id::varchar, '|' ORDER BY id)) AS name FROM comp GROUP BY 1",
    "not_nested": "SELECT text_group, count(DISTINCT semantic_group) AS outers FROM (SELECT nullif(regexp_extract(lower(text_group_id), '([0-9a-f]{40})', 1), '') AS text_group, nullif(regexp_extract(lower(semantic_group_id), '([0-9a-f]{40})', 1), '') AS semantic_group FROM customer_it_support_prepared) WHERE text_group IS NOT NULL AND semantic_group IS NOT NULL GROUP BY 1 HAVING count(DISTINCT semantic_group) > 1",
}
