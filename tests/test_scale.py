"""Operators for large inputs against the long form, brute force or Spark ML."""

import random

import duckdb
import pytest
from pyspark.sql import functions as F

from ticketloom.operators import crossval, features, models, trees


def test_fold_confusion_is_that_of_the_long_form(spark):
    """Scores by rows from a file of counts: the metrics are those of joins in long form, also without known words, categories or a class."""
    rng = random.Random(11)
    rows = [(i, rng.choice("ab" if i % 3 else "b"), i % 4, " ".join(rng.choice(["red", "sea", "sky", f"w{rng.randrange(40)}"]) for _ in range(rng.randrange(7))), rng.choice(["x", "y", None]), rng.choice(["de", "en"]), None) for i in range(200)]
    d = spark.createDataFrame(rows, "id bigint, label string, fold int, text string, type string, language string, queue string")
    words, r, keys = features.tokens(F.col("text")), d.select("id", "label", "fold"), ["fs", "model", "alpha", "fold"]
    coded = crossval.coded(d, words, [F.col("label"), F.col("fold")]).cache()
    fits = crossval.FoldFits(coded, 4, ["a", "b"])
    conf = crossval.fold_confusion(coded, fits, ["FS1", "FS3"], [0.1, 1.0]).cache()
    values = crossval.feature_set_values(d, "id", words, ["FS1", "FS3"]).cache()
    weights = crossval.fold_weights(values, r, 4, [0.1, 1.0]).cache()
    for part in ("held_out", "train"):
        ours, theirs = crossval.confusion_scores(conf, part, ["a", "b", "c"], keys), crossval.scores(crossval.predictions(values, r, weights, part, 4), ["a", "b", "c"], keys)
        plain = lambda x: sorted((*t[:4], *(round(v, 9) for v in t[4:])) for t in x.collect())
        assert plain(ours) == plain(theirs) and ours.count() == 2 * 2 * 2 * 4
    fits.discard()


def test_cv_grid_needs_no_long_form(spark, sf, monkeypatch):
    from ticketloom.plans import crossval as plans

    for name in ("fold_weights", "predictions", "feature_set_values"):
        monkeypatch.setattr(crossval, name, None)
    assert plans.cv_grid(spark, sf).count() == 2 * len(plans.ALPHAS)


@pytest.mark.parametrize("query", ["cv_grid", "feature_set_choice"])
@pytest.mark.parametrize("case", ["in training", "across splits"])
def test_rows_of_one_id_count_together_without_long_form(spark, sf, tmp_path, monkeypatch, query, case):
    """Ids with several rows of other folds, labels and splits, none, or without a group: what the SQL gives, in small parts."""
    from ticketloom.plans import crossval as plans

    for name in ("fold_weights", "predictions", "feature_set_values"):
        monkeypatch.setattr(crossval, name, None)
    for name, value in (("ROWS", 7), ("TOKENS", 300), ("SCORED", 100)):
        monkeypatch.setattr(crossval, name, value)
    duck = duckdb.connect()
    #: Across splits, an id has two rows, of which one is in the training part.
    again = "source_row_id % 4" if case == "in training" else "row_number() OVER (PARTITION BY split = 'training' ORDER BY source_row_id)"
    none = "source_row_id % 9 = 1" if case == "in training" else "false"
    duck.execute(f"CREATE VIEW s AS SELECT source_row_id, min(split) AS split FROM '{sf}/split_assignments.parquet' GROUP BY 1")
    duck.execute(f"COPY (SELECT p.* REPLACE (CASE WHEN NOT {none} THEN 100 + {again} * CASE WHEN source_row_id % 3 > 0 OR {case == 'across splits'} THEN 1 ELSE source_row_id END END AS record_id, CASE WHEN source_row_id % 5 > 0 THEN semantic_group_id END AS semantic_group_id) FROM '{sf}/customer_it_support_prepared.parquet' p JOIN s USING (source_row_id)) TO '{tmp_path}/customer_it_support_prepared.parquet'")
    duck.execute(f"COPY (FROM '{sf}/split_assignments.parquet') TO '{tmp_path}/split_assignments.parquet'")
    for name in ("customer_it_support_prepared", "split_assignments"):
        duck.execute(f"CREATE VIEW {name} AS FROM '{tmp_path}/{name}.parquet'")
    ids = duck.execute("SELECT count(record_id), count(DISTINCT record_id), count(DISTINCT record_id) FILTER (split = 'training'), count(record_id) FILTER (split = 'training') FROM customer_it_support_prepared JOIN s USING (source_row_id)").fetchone()
    assert ids[1] < ids[0] and (ids[2] == ids[3]) == (case == "across splits")
    want = duck.execute(plans.ORACLES[query])
    columns = [c[0] for c in want.description]
    plain = lambda rows: sorted(tuple(round(x, 5) if isinstance(x, float) else x for x in r) for r in rows)
    assert plain(plans.QUERIES[query](spark, str(tmp_path)).select(*columns).collect()) == plain(want.fetchall())


def test_neighbours_are_those_of_all_pairs(spark, monkeypatch):
    """In several blocks, with equal rows, a query without a shared word, values of either sign, and no pair in the plan."""
    for name, value in (("QUERIES", 3), ("ROWS", 7), ("DENSE", 4)):
        monkeypatch.setattr(models, name, value)
    rng = random.Random(5)
    for least in (0, -2):
        rows = {i: {rng.randrange(12): float(rng.randint(least, 3) or 1) for _ in range(4)} for i in range(60)} | {90: {99: 1.0}}
        v = spark.createDataFrame([(i, f"w{f}", x) for i, r in rows.items() for f, x in r.items()], "id bigint, feature string, value double")
        got = models._nearest_sparse(models._packed_rows(v.where("id % 5 = 0")), models._packed_rows(v).repartition(3), 4).collect()
        for q in [i for i in rows if i % 5 == 0]:
            want = sorted((-round(sum(x * rows[t][f] for f, x in rows[q].items() if f in rows[t]), 9), t) for t in rows if t != q and rows[q].keys() & rows[t].keys())[:4]
            assert sorted((-round(r["s"], 9), r["t"]) for r in got if r["q"] == q)[:4] == want
    plan = models.neighbour_votes(v, v, spark.createDataFrame([(1, "a")], "k bigint, y string"), "k", "y")._jdf.queryExecution().toString()
    assert "feature" not in plan.split("MapInArrow")[0]


def test_trees_are_those_of_spark_ml(spark, monkeypatch):
    """Same predictions as Spark ML's estimators on rows that all are in the sample for thresholds; no row has a bin of every feature."""
    rng = random.Random(3)
    y = [rng.choice("pqr") for _ in range(300)]
    rows = [(i, f"{y[i] if rng.random() < 0.6 else 'z'}{rng.randrange(5)}", rng.random() + 0.1) for i in range(300) for _ in range(4)]
    values = spark.createDataFrame(rows, "id bigint, feature string, value double").groupBy("id", "feature").agg(F.sum("value").alias("value")).cache()
    labels = spark.createDataFrame(list(enumerate(y)), "k bigint, y string")
    args = (values.where("id % 4 <> 0"), values.where("id % 4 = 0"), values.select("feature").distinct(), labels, "k", "y", ["p", "q", "r"])
    plain = lambda d: {r["id"]: r["pred"] for r in d.collect()}
    monkeypatch.setattr(trees, "BLOCK", 50)
    for ours, theirs in ((trees.boosted(*args, rounds=3, depth=3), models.fit_predict("boosted", *args, maxIter=3, maxDepth=3)), (trees.adaboost(*args, rounds=3), models.adaboost(*args, rounds=3))):
        a, b = plain(ours), plain(theirs)
        assert a.keys() == b.keys() and sum(a[k] == b[k] for k in a) >= 0.95 * len(a) > 70
