"""Quality, statistics, features, models, explanations, guards, sources and streams on small fixtures."""

import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ticketloom.functions import stats
from ticketloom.functions import text as T
from ticketloom.operators import audit, evaluate, explain, features, models, quality
from ticketloom.sources import readers, sinks
from ticketloom.streaming import events


def one(spark, value, f):
    return spark.createDataFrame([(value,)], "x string").select(f(F.col("x"))).first()[0]


def test_text_forms(spark):
    assert one(spark, "  A\\nB  c\tD ", T.comparison_form) == "a b c d"
    assert one(spark, None, T.comparison_form) == ""
    assert one(spark, "\\nHello you_2", T.word_count) == 2
    assert one(spark, "\\nHello", lambda c: T.word_count(c, unescape=False)) == 1
    got = one(spark, "Hi&nbsp;<NAME>,<br/>see <b>ﬁle</b> at https://x.org/a?b or me@x.org​\\n<tel_num>", T.normalize_ticket)
    assert got == "Hi <name>, see file at <url> or <email_address> <tel_num>"
    assert one(spark, None, T.normalize_ticket) is None
    assert one(spark, "    ", T.clean_category) is None


def test_association_goldens(spark):
    got = [spark.range(1).select(stats._even_tail(F.lit(x), F.lit(d))).first()[0] for x, d in ((1.16309, 2), (2.06117, 4))]
    assert got == pytest.approx([0.559034, 0.724509], abs=2e-6)
    df = spark.createDataFrame([(a, b) for a, b, n in (("p", "x", 30), ("p", "y", 10), ("q", "x", 10), ("q", "y", 30), ("q", "z", 20)) for _ in range(n)], "r string, c string")
    row = stats.association(stats.contingency(df, "r", "c")).first()
    obs = np.array([[30, 10, 0], [10, 30, 20]], float)
    e = obs.sum(1, keepdims=True) * obs.sum(0) / obs.sum()
    chi = ((obs - e) ** 2 / e).sum()
    assert row["chi2"] == pytest.approx(chi) and row["dof"] == 2 and row["p"] == pytest.approx(math.exp(-chi / 2))
    assert stats.association(stats.contingency(df.limit(0), "r", "c")).first()["p"] == 1.0


def test_holm_and_spearman(spark):
    p = [0.01, 0.04, 0.03, 0.005, 0.5]
    got = stats.holm(spark.createDataFrame([(i, x) for i, x in enumerate(p)], "i int, p double"), "p").orderBy("i").toPandas().p_holm.tolist()
    order = sorted(range(5), key=lambda i: p[i])
    want, high = [0.0] * 5, 0.0
    for k, i in enumerate(order):
        high = max(high, (5 - k) * p[i])
        want[i] = min(1.0, high)
    assert got == pytest.approx(want)
    df = spark.createDataFrame([("a", 1.0, 3.0), ("a", 2.0, 3.0), ("a", 2.0, 1.0), ("a", 5.0, 0.0)], "k string, x double, y double")
    rx, ry = [1, 2.5, 2.5, 4], [3.5, 3.5, 2, 1]
    assert stats.spearman(df, "x", "y", ["k"]).first()["spearman"] == pytest.approx(np.corrcoef(rx, ry)[0, 1])


def test_quality_on_empty_and_null(spark):
    df = spark.createDataFrame([], "a string, b string")
    assert quality.value_distribution(df, "a").isEmpty()
    assert [r["missing"] for r in quality.column_profile(df, ["a", "b"]).collect()] == [0, 0]
    assert {r["records"] for r in quality.indicator_counts(df, quality.signals(F.col("a"))).collect()} == {0}
    x = spark.createDataFrame([(None, "text"), ("same text of some length", "Same  text of some length"), ("", "")], "answer string, body string")
    assert [r["leak"] for r in quality.leakage_flags(x, "answer", "body").collect()] == [False, True, False]


def test_ngrams(spark):
    df = spark.createDataFrame([("The big red fox",), ("a",), (None,)], "x string")
    assert [r[0] for r in df.select(features.word_ngrams(features.tokens(F.col("x")))).collect()] == [["big", "red", "fox", "big red", "red fox"], [], []]
    assert [r[0] for r in df.select(features.char_wb_ngrams(F.lit("ab c"), 3, 4)).limit(1).collect()] == [[" ab", "ab ", " ab ", " c "]]


def test_tfidf_and_chi2(spark):
    counts = spark.createDataFrame([(1, "a", 2.0), (1, "b", 1.0), (2, "a", 1.0), (3, "b", 4.0)], "id bigint, feature string, value double")
    got = {(r["id"], r["feature"]): r["value"] for r in features.tfidf(counts, features.vocabulary(counts, 1), 3).collect()}
    a = (1 + math.log(2)) * (math.log(4 / 3) + 1)
    b = math.log(4 / 3) + 1
    assert got[(1, "a")] == pytest.approx(a / math.hypot(a, b)) and got[(2, "a")] == 1.0
    y = spark.createDataFrame([(1, "p"), (2, "p"), (3, "q")], "id bigint, y string")
    chi = {r["feature"]: r["chi2"] for r in features.chi2_scores(counts, y, "id", "y").collect()}
    assert chi["a"] == pytest.approx((3 - 2) ** 2 / 2 + 1) and chi["b"] == pytest.approx((1 - 10 / 3) ** 2 / (10 / 3) + (4 - 5 / 3) ** 2 / (5 / 3))


def test_metrics(spark):
    rows = [("a", "a"), ("a", "b"), ("b", "b"), ("b", "b"), ("c", "a"), (None, "a")]
    conf = evaluate.confusion(spark.createDataFrame(rows, "y string, p string"), "y", "p", ["a", "b", "c"])
    assert conf.count() == 9
    row = evaluate.summary_metrics(evaluate.class_metrics(conf)).first()
    assert row["accuracy"] == pytest.approx(0.6) and row["macro_f1"] == pytest.approx((0.5 + 0.8 + 0) / 3)


def test_every_held_out_record_has_a_label(spark, tmp_path):
    from ticketloom.plans.modelling import complement_nb_scores

    texts = ["server down", "server down", "printer paper", "printer paper", "server", "unseen", None, "", "the"]
    rows = [(i, i, t, "high" if i in (0, 1) else "low", None) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "record_id bigint, source_row_id bigint, text_clean string, priority string, semantic_group_id string").write.parquet(str(tmp_path / "customer_it_support_prepared.parquet"))
    spark.createDataFrame([(i, "training" if i < 4 else "holdout") for i in range(9)], "source_row_id bigint, split string").write.parquet(str(tmp_path / "split_assignments.parquet"))
    got = {r["id"]: (r["label"], r["score"]) for r in complement_nb_scores(spark, str(tmp_path)).collect()}
    assert set(got) == {4, 5, 6, 7, 8} and got[4][0] == "high" and got[4][1] > 0
    assert all(got[i] == ("high", 0.0) for i in (5, 6, 7, 8))


def brute_shapley(nodes, x, n):
    def expect(k, known):
        node = nodes[k]
        if node["feature"] < 0:
            return np.array(node["value"])
        l, r = nodes[node["left"]], nodes[node["right"]]
        if node["feature"] in known:
            return expect((l if x[node["feature"]] <= node["threshold"] else r)["id"], known)
        return (l["cover"] * expect(l["id"], known) + r["cover"] * expect(r["id"], known)) / node["cover"]

    phi = {i: 0 for i in range(n)}
    for i in range(n):
        for size in range(n):
            for s in itertools.combinations([j for j in range(n) if j != i], size):
                w = math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
                phi[i] = phi[i] + w * (expect(0, {*s, i}) - expect(0, set(s)))
    return phi


def test_tree_attributions(spark):
    from pyspark.ml.linalg import Vectors

    rng = np.random.default_rng(1)
    x = rng.integers(0, 4, size=(200, 4)).astype(float)
    y = ((x[:, 0] > 1) & (x[:, 1] > 1)) | (x[:, 2] > 2)
    df = spark.createDataFrame([(i, Vectors.dense(v), float(k)) for i, (v, k) in enumerate(zip(x, y))], ["id", "features", "label"])
    model = models.estimator("tree", maxDepth=4).fit(df)
    nodes = explain.tree_paths(model)
    for v in x[:5]:
        exact, want = explain._tree_shap(nodes, 0, v, True), brute_shapley(nodes, v, 4)
        for i in range(4):
            assert np.allclose(exact.get(i, 0), want[i], atol=1e-9)
    phi = explain.tree_attributions(df.limit(3), model, list("abcd"), ["no", "yes"])
    assert {r["label"] for r in phi.collect()} == {"no", "yes"}


def test_permutation_attributions_add_up(spark):
    from pyspark.ml.linalg import Vectors

    df = spark.createDataFrame([(1, Vectors.dense([1.0, 2.0, 3.0]))], ["id", "features"])
    score = lambda r: np.stack([r[:, 0] * r[:, 1] + r[:, 2], -r[:, 2]], axis=1)
    bg = np.array([[0.0, 0.0, 0.0], [1.0, 1.0, 1.0]])
    got = explain.permutation_attributions(df, bg, score, list("abc"), ["p", "q"]).groupBy("label").agg(F.sum("phi").alias("s"))
    base = score(bg).mean(axis=0)
    full = score(np.array([[1.0, 2.0, 3.0]]))[0]
    assert {r["label"]: r["s"] for r in got.collect()} == pytest.approx(dict(zip("pq", full - base)))


def test_guards(spark):
    df = spark.createDataFrame([(1, "a"), (1, None)], "k int, v string")
    for bad in (dict(columns=["x"]), dict(columns=["k"], key=["k"]), dict(columns=["k"], rows=3), dict(columns=["k"], not_null=["v"])):
        with pytest.raises(ValueError):
            audit.require(df, **bad)
    assert audit.require(df.limit(1), ["k", "v"], ["k"], 1) is not None
    with pytest.raises(ValueError):
        audit.joined(df, df, ["k"])
    assert audit.joined(df, df.limit(1), ["k"]).count() == 2
    got = {r["column"]: r["mismatches"] for r in audit.mismatches(df.limit(1), df.where("v is null"), ["k"], ["v"]).collect()}
    assert got == {"v": 1}
    checks = audit.audit([audit.check("c", "good", spark.range(1).select(F.lit(1.0)), 1), audit.check("c", "bad", spark.range(1).select(F.lit(2.0)), 1, 0.5), audit.check("c", "null", spark.range(1).select(F.lit(None).cast("double")), 1)])
    assert [r["status"] for r in checks.collect()] == ["PASS", "FAIL", "FAIL"]
    a, b = audit.content_hash(df, ["k", "v"]).first(), audit.content_hash(df.orderBy("v"), ["k", "v"]).first()
    assert a == b and a != audit.content_hash(df.fillna(""), ["k", "v"]).first()
    assert audit.payload_hash({"b": 1, "a": 2}) == audit.payload_hash({"a": 2, "b": 1})


def test_reuse(spark, tmp_path):
    calls = []

    def make():
        calls.append(1)
        return spark.range(3)

    for _ in range(2):
        assert audit.reuse(spark, f"file://{tmp_path}", "t", {"v": 1}, make).count() == 3
    assert audit.reuse(spark, f"file://{tmp_path}", "t", {"v": 2}, make).count() == 3 and len(calls) == 2


def test_csv_round_trip(spark, tmp_path):
    rows = [(1, 'He said "no"', "a\nb"), (2, "NA", ""), (3, None, "x,y")]
    df = spark.createDataFrame(rows, "k int, s string, t string")
    sinks.write_csv(df, f"file://{tmp_path}/c")
    assert [tuple(r) for r in readers.read_csv(spark, f"file://{tmp_path}/c", "k int, s string, t string", normalize_missing=False).orderBy("k").collect()] == [(k, s, t or None) for k, s, t in rows]
    assert readers.read_csv(spark, f"file://{tmp_path}/c", "k int, s string, t string").where("k = 2").first()["s"] is None
    (tmp_path / "bom.csv").write_bytes(b"\xef\xbb\xbfk,s\n1,x\n")
    assert readers.read_csv(spark, f"file://{tmp_path}/bom.csv", "k int, s string").first() == (1, "x")
    (tmp_path / "bad.csv").write_text("k,s\nx,y\n")
    with pytest.raises(Exception):
        readers.read_csv(spark, f"file://{tmp_path}/bad.csv", "k int, s string").collect()
    sinks.write_manifest({"b": 1}, str(tmp_path / "m.json"))
    assert readers.read_manifest(str(tmp_path / "m.json")) == {"b": 1}
    sinks.write_parquet(df, f"file://{tmp_path}/p")
    assert readers.read_parquet(spark, f"file://{tmp_path}/p").count() == 3
    sinks.write_json_lines(df, f"file://{tmp_path}/j")
    assert sorted(tuple(r) for r in readers.read_json_lines(spark, f"file://{tmp_path}/j", df.schema).select("k").collect()) == [(1,), (2,), (3,)]


def test_streams(spark, tmp_path):
    df = spark.sql("SELECT timestamp'2024-01-01 00:00:00' + make_interval(0, 0, 0, 0, 0, id * 10) AS ts, id % 3 AS user_id, 'T' || (id % 5) AS text, 1.0 AS value FROM range(60)")
    df.write.parquet(f"file://{tmp_path}/in")
    stream = events.read_events(spark, f"file://{tmp_path}/in", df.schema)
    events.run_once(events.distinct_texts(stream, "ts", "text"), f"file://{tmp_path}/out", f"file://{tmp_path}/state")
    assert spark.read.parquet(f"file://{tmp_path}/out").count() == 5
    assert events.distinct_texts(df, "ts", "text").count() == 5
    assert events.sessions(df, "ts", "user_id", "31 minutes").count() == 3


def test_models_beat_the_majority(spark):
    rng = np.random.default_rng(0)
    rows = []
    for i in range(240):
        y = ["p", "q", "r"][i % 3]
        rows += [(i, f"{y}{rng.integers(5)}", 1.0), (i, f"z{rng.integers(9)}", 1.0)]
    values = spark.createDataFrame(rows, "id bigint, feature string, value double").groupBy("id", "feature").agg(F.sum("value").alias("value"))
    labels = spark.createDataFrame([(i, ["p", "q", "r"][i % 3]) for i in range(240)], "k bigint, y string")
    train, test = values.where("id % 4 <> 0"), values.where("id % 4 = 0")
    vocab = features.vocabulary(train, 1).select("feature")
    w = models.complement_nb_weights(train, labels, "k", "y")
    nb = models.best_label(models.linear_scores(test, w)).join(labels, F.col("id") == F.col("k")).where("label = y").count()
    assert nb > 50
    knn = models.best_label(models.neighbour_votes(test, train, labels, "k", "y")).join(labels, F.col("id") == F.col("k")).where("label = y").count()
    assert knn > 50
    boosted = models.adaboost(train, test, vocab, labels, "k", "y", ["p", "q", "r"], rounds=3, depth=4).join(labels, F.col("id") == F.col("k")).where("pred = y").count()
    assert boosted > 30
    assert models.at_edge({"a": [1, 2, 3], "b": ["x"]}, {"a": 3, "b": "x"}) == {"a": True}


def test_shaping(spark):
    from ticketloom.operators import shaping

    df = spark.createDataFrame([(0.9, "b"), (0.95, "a"), (1.0, None), (1.5, "b"), (None, "c")], "s double, v string")
    got = df.select(shaping.band(F.col("s"), [0.9, 0.95, 1.01], ["x", "y"])).collect()
    assert [r[0] for r in got] == ["x", "y", "y", None, None]
    assert sorted((r["v"] or "", r["code"]) for r in shaping.factorize(df, "v").collect()) == [("", None), ("a", 0), ("b", 1), ("b", 1), ("c", 2)]
    t = spark.createDataFrame([("1",), ("x",), (None,)], "n string")
    with pytest.raises(ValueError):
        shaping.strict_cast(t, "n", "int")
    assert [r["n"] for r in shaping.lenient_cast(t, "n", "int").collect()] == [1, None, None]
    with pytest.raises(ValueError):
        shaping.wide(spark.createDataFrame([(1, "a", 2), (1, "a", 3)], "k int, n string, v int"), ["k"], "n", "v", ["a"])
    p = spark.createDataFrame([(0.5, 0.5), (0.7, 0.7), (float("nan"), 0.5), (None, 1.0), (-0.5, 1.5)], "a double, b double")
    assert shaping.invalid_probabilities(p, ["a", "b"]).count() == 4
    assert spark.range(1).select(shaping.thousands(F.lit(1234567))).first()[0] == "1.234.567"
