"""Cross-validation, case selection, grouping audit and attributions on small frames."""

import itertools
import math

from pyspark.sql import functions as F

from ticketloom.operators import crossval, explain, features, linkage, models, shaping


def test_fold_weights_are_those_of_separate_fits(spark):
    rows = [(i, "xyz"[i % 3], i % 4) for i in range(60)]
    values = [(i, f"{'xyz'[i % 3]}{(i * k) % 7}", float(1 + k)) for i in range(60) for k in range(3)] + [(i, "common", 1.0) for i in range(0, 60, 2)]
    v = spark.createDataFrame([("A", i, f, x) for i, f, x in values], "fs string, id bigint, feature string, value double").groupBy("fs", "id", "feature").agg(F.sum("value").alias("value")).cache()
    r = spark.createDataFrame(rows, "id bigint, label string, fold int")
    w = crossval.fold_weights(v, r, 4, [0.5], min_df=1).cache()
    for fold in (0, 3, 4):
        train = r.where(F.col("fold") != fold)
        kept = v.join(train, "id").select("id", "feature", "value")
        for model, fit in (("complement_nb", models.complement_nb_weights), ("multinomial_nb", models.multinomial_nb_weights)):
            want = {(x["feature"], x["label"]): x["weight"] for x in fit(kept, train, "id", "label", alpha=0.5).collect()}
            got = {(x["feature"], x["label"]): x["weight"] for x in w.where((F.col("fold") == fold) & (F.col("model") == model)).collect()}
            assert got.keys() == want.keys() and all(math.isclose(got[k], want[k], abs_tol=1e-9) for k in want)
    lonely = spark.createDataFrame([(99, "y", 0)], "id bigint, label string, fold int")
    p = crossval.predictions(v, r.unionByName(lonely), w, "held_out", 4)
    assert p.where("id = 99").select("pred").distinct().collect()[0][0] == "x" and p.select("id", "model").distinct().count() == p.count() == 2 * 61
    assert crossval.fold_weights(v.limit(0), r.limit(0), 4, [0.5]).isEmpty()


def test_faithfulness_of_a_linear_score(spark):
    v = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (1, "c", 1.0), (2, "a", 1.0)], "id bigint, feature string, value double")
    w = spark.createDataFrame([("a", "p", 2.0), ("b", "p", 1.0), ("c", "p", -1.0), ("a", "q", 0.0), ("b", "q", 0.5), ("c", "q", 0.5)], "feature string, label string, weight double")
    phi = explain.linear_attributions(v, w, v.limit(0))
    pred = spark.createDataFrame([(1, "p"), (2, "p")], "id bigint, pred string")
    out = {(r["id"], r["k"]): r for r in explain.faithfulness_study(v, phi, w, pred, [1, 5], 3, "s").collect()}
    assert out[(1, 1)]["drop_top"] == 4 and out[(1, 1)]["flip_top"] == 1 and out[(1, 1)]["stronger"] and out[(1, 5)]["removed"] == 3 and not out[(1, 5)]["stronger"]
    assert out[(2, 1)]["drop_top"] == out[(2, 1)]["drop_random"] == 2


def test_absent_features_sum_to_one_term(spark):
    v = spark.createDataFrame([(1, "a", 2.0), (2, "b", 1.0)], "id bigint, feature string, value double")
    w = spark.createDataFrame([(f, y, x) for f, x in (("a", 1.0), ("b", 3.0), ("c", 5.0)) for y in "pq"], "feature string, label string, weight double")
    bg = spark.createDataFrame([(7, "b", 1.0), (7, "c", 1.0), (8, "a", 1.0)], "id bigint, feature string, value double")
    ids = spark.createDataFrame([(1,), (2,), (3,)], "id bigint")
    total = lambda df: {(r["id"], r["label"]): round(r["s"], 9) for r in df.groupBy("id", "label").agg(F.sum("phi").alias("s")).collect()}
    full, short = explain.linear_attributions(v, w, bg, ids), explain.linear_attributions(v, w, bg, ids, absent=False)
    assert total(full) == total(short) and len(total(full)) == 6
    assert short.where("id = 3").count() == 2


def test_rows_without_features_have_vectors_and_labels(spark):
    v = spark.createDataFrame([(1, "a", 2.0), (1, "z", 1.0)], "id bigint, feature string, value double")
    vec, names = features.to_vectors(v, spark.createDataFrame([("a",), ("b",)], "feature string"), spark.createDataFrame([(1,), (2,), (None,)], "id bigint"))
    assert names == ["a", "b"] and {r["id"]: r["features"].toArray().tolist() for r in vec.collect()} == {1: [2.0, 0.0], 2: [0.0, 0.0]}
    best = spark.createDataFrame([(1, "p", 3.0)], "id bigint, label string, score double")
    got = models.with_default(best, spark.createDataFrame([(1,), (2,)], "id bigint"), spark.createDataFrame([("q", 5)], "y string, records int"))
    assert {tuple(r) for r in got.collect()} == {(1, "p", 3.0), (2, "q", 0.0)}


def test_cases_are_of_different_groups(spark):
    rows = [(i, f"g{i // 2}", ["low", "medium", "high"][i % 3], i % 4, 3, 1 + i % 3, i % 3, (i + 1) % 3, (i + 2) % 3) for i in range(40)]
    votes = spark.createDataFrame(rows, "id bigint, g string, actual string, right bigint, models bigint, kinds bigint, votes_low bigint, votes_medium bigint, votes_high bigint")
    got = shaping.select_cases(votes).collect()
    assert len(got) == len({r["g"] for r in got}) == 12 and all(r["id"] % 2 == 0 for r in got) and [r["case_no"] for r in got] == list(range(1, 13))
    assert len(shaping.select_cases(votes.where("id < 6")).collect()) == 3 and shaping.select_cases(votes.limit(0)).isEmpty()


def test_grouping_audit_finds_planted_faults(spark):
    edges = spark.createDataFrame([(1, 2, 0.9), (2, 3, 0.8), (5, 6, 0.95)], "a bigint, b bigint, similarity double")
    groups = lambda rows: spark.createDataFrame([(i, g, sum(h == g for _, h in rows)) for i, g in rows], "vec_id bigint, group_id bigint, group_size bigint")
    good = linkage.grouping_summary(groups([(1, 1), (2, 1), (3, 3), (4, 4), (5, 5), (6, 5)]), edges, "vec_id", 0.8).first()
    assert (good["components"], good["groups"], good["multi_groups"], good["violations"], good["min_similarity"]) == (3, 4, 2, 0, 0.9)
    bad = linkage.grouping_summary(groups([(1, 1), (2, 1), (3, 1), (4, 4), (5, 4), (6, 6)]), edges, "vec_id", 0.8).first()
    assert bad["violations"] == 2
    names = {r["group_id"]: r["name"] for r in linkage.group_names(groups([(10, 9), (9, 9), (1, 1)]), "vec_id").collect()}
    import hashlib

    assert names == {9: hashlib.sha1(b"semantic_complete_linkage|9|10").hexdigest(), 1: hashlib.sha1(b"semantic_complete_linkage|1").hexdigest()}
    df = spark.createDataFrame([("t", "a"), ("t", "b"), ("u", "a"), ("u", "a"), (None, "b"), ("v", None)], "t string, s string")
    assert [tuple(r) for r in linkage.not_nested(df, "t", "s").collect()] == [("t", 2)]


def test_contrast_of_equal_explanations_is_zero(spark):
    rows = [(i, f"f{k}", 1.0 / (1 + k)) for i, k in itertools.product(range(8), range(6))]
    c = explain.compactness(spark.createDataFrame(rows, "id bigint, feature string, phi double"))
    strata = spark.createDataFrame([(i, "ab"[i % 2]) for i in range(8)], "id bigint, stratum string")
    got = explain.compactness_contrast(c, c, strata, 5, "s").collect()
    assert len(got) == 5 and all(r["observed"] == r["low"] == r["high"] == 0 for r in got)


def test_tables_are_replaced_whole(spark, tmp_path):
    from ticketloom.sources import sinks

    path = f"file://{tmp_path}/t"
    sinks.replace_table(spark.range(3), path)
    sinks.replace_table(spark.range(5), path)
    assert spark.read.parquet(path).count() == 5
    bad = spark.range(3).select(F.raise_error(F.lit("no")).cast("bigint").alias("id"))
    try:
        sinks.replace_table(bad, path)
        raise AssertionError
    except Exception as problem:
        assert not isinstance(problem, AssertionError)
    assert spark.read.parquet(path).count() == 5 and [p.name for p in tmp_path.iterdir() if not p.name.startswith(".")] == ["t"]


def test_vectors_as_numpy_files(spark, tmp_path):
    import numpy as np

    from ticketloom.sources import sinks

    df = spark.createDataFrame([(i, [float(i), 0.5]) for i in range(9)] + [(None, [1.0, 1.0]), (99, None)], "vec_id bigint, v array<double>").repartition(3)
    files = sinks.write_npy(df, "vec_id", "v", f"file://{tmp_path}/n").collect()
    ids = np.concatenate([np.load(tmp_path / "n" / f["file"].replace(".npy", ".ids.npy")) for f in files])
    rows = np.concatenate([np.load(tmp_path / "n" / f["file"]) for f in files])
    assert sorted(ids.tolist()) == list(range(9)) and rows.dtype == np.float32 and (rows[:, 0] == ids).all() and sum(f["rows"] for f in files) == 9
    assert sinks.write_npy(df.limit(0), "vec_id", "v", f"file://{tmp_path}/m").isEmpty()
