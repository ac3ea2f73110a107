"""Queries of features, models, evaluation, explanation and audit."""

from __future__ import annotations

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.functions.rng import hash_u, sql_hash_u
from ticketloom.functions.stats import holm
from ticketloom.operators import audit as A
from ticketloom.operators import evaluate as E
from ticketloom.operators import explain as X
from ticketloom.operators import features as V
from ticketloom.operators import models as M
from ticketloom.operators import sampling as S
from ticketloom.operators import trees as TR
from ticketloom.session import written

CLASSES = ["high", "low", "medium"]
MODELS = ["alpha", "beta", "gamma"]
RIGHT = {"alpha": 70, "beta": 62, "gamma": 66}
#: Most frequent words and character n-grams that a vocabulary keeps.
TERMS = 30_000
CHARS = 30_000
#: Explained cases and background rows per class, as sampled from one record per group.
CASES = 50
BACKGROUND = 10


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def _r(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})


def _base(spark, sf):
    d = _t(spark, sf, "customer_it_support_prepared").withColumn("priority", T.clean_category(F.col("priority"), True))
    split = _t(spark, sf, "split_assignments").where("source_row_id is not null").groupBy("source_row_id").agg(F.min("split").alias("split"))
    return d.where(F.col("priority").isin(*CLASSES)).join(split, "source_row_id").withColumn("g", F.coalesce("semantic_group_id", F.col("record_id").cast("string")))


def _words(d):
    return V.term_counts(d, "record_id", V.tokens(F.col("text_clean")))


def _vectors(d):
    counts = written(_words(d), "counts")
    return V.tfidf(counts, V.vocabulary(counts, 2, TERMS), d.count())


def word_tfidf(spark, sf):
    d = _base(spark, sf)
    counts = written(V.term_counts(d.select("record_id", V.tokens(F.col("text_clean")).alias("tokens")), "record_id", V.word_ngrams(F.col("tokens"))), "counts")
    return _r(V.tfidf(counts, V.vocabulary(counts, 2, TERMS), d.count()), "value")


def char_wb_tfidf(spark, sf):
    d = _base(spark, sf)
    counts = written(V.term_counts(d, "record_id", V.char_wb_ngrams(F.col("text_clean"))), "counts")
    return _r(V.tfidf(counts, V.vocabulary(counts, 2, CHARS), d.count()), "value")


def chi2_top_k(spark, sf):
    d = _base(spark, sf)
    return _r(V.select_k(V.chi2_scores(written(_words(d), "counts"), d, "record_id", "priority"), 50), "chi2")


def feature_union_profile(spark, sf):
    d = _base(spark, sf)
    counts = _words(d)
    u = V.union(word=counts.join(V.vocabulary(counts, 2, TERMS).select("feature"), "feature"), cat=V.one_hot(d, "record_id", ["type", "queue"]), num=V.numeric(d, "record_id", ["text_char_count", "text_word_count"]))
    return _r(u.groupBy(F.substring_index("feature", ":", 1).alias("part")).agg(F.count("*").alias("entries"), F.count_distinct("feature").alias("features"), F.sum("value").alias("mass")), "mass")


def majority_baseline(spark, sf):
    return M.majority(_base(spark, sf).where("split = 'training'"), "priority")


def _nb(d):
    train = d.where("split = 'training'")
    counts = written(_words(train), "counts")
    known = written(counts.join(V.vocabulary(counts, 2).select("feature"), "feature"), "known")
    return known, M.complement_nb_weights(known, train, "record_id", "priority")


def complement_nb_scores(spark, sf):
    """A label for every held-out record, also for those without a word of the training rows."""
    d = _base(spark, sf)
    w = written(_nb(d)[1], "weights")
    held = d.where("split <> 'training'")
    best = M.best_label(M.linear_scores(_words(held), w, ids=held.select(F.col("record_id").alias("id"))), 6)
    return _r(best, "score")


def knn_votes(spark, sf):
    """Queries: records whose id is divisible by 50, against all others."""
    d = _base(spark, sf)
    v = written(_vectors(d), "vectors")
    best = written(M.best_label(M.neighbour_votes(v.where("id % 50 = 0"), v, d, "record_id", "priority")), "best")
    return _r(M.with_default(best, d.where("record_id % 50 = 0").select(F.col("record_id").alias("id")), M.majority(d, "priority")), "score")


def _preds(spark, sf):
    d = _base(spark, sf).select("record_id", "g", "priority", "split")
    parts = None
    for m in MODELS:
        u = hash_u(F.col("record_id"), m)
        p = d.withColumns({"model": F.lit(m), "pred": F.when(u % 100 < RIGHT[m], F.col("priority")).otherwise(F.element_at(F.array(*[F.lit(c) for c in CLASSES]), (u % 3 + 1).cast("int"))), "fold": (hash_u(F.col("g"), "fold") % 5).cast("int")})
        parts = p if parts is None else parts.unionByName(p)
    return parts


def confusion_matrix(spark, sf):
    return E.confusion(_preds(spark, sf), "priority", "pred", CLASSES, ["model"])


def class_metrics(spark, sf):
    return _r(E.class_metrics(confusion_matrix(spark, sf), ["model"]).drop("tp"), "precision", "recall", "f1")


def model_summary(spark, sf):
    return _r(E.summary_metrics(E.class_metrics(confusion_matrix(spark, sf), ["model"]), ["model"]), "accuracy", "macro_precision", "macro_recall", "macro_f1", "weighted_f1")


def _folds(spark, sf):
    return E.summary_metrics(E.class_metrics(E.confusion(_preds(spark, sf), "priority", "pred", CLASSES, ["model", "fold"]), ["model", "fold"]), ["model", "fold"])


def fold_metrics(spark, sf):
    f = written(_folds(spark, sf), "folds")
    report = E.fold_summary(f, ["model"], "macro_f1").withColumnsRenamed({"mean": "report_mean", "std": "report_std"})
    tuning = E.fold_summary(f, ["model"], "macro_f1", population=True).withColumnsRenamed({"mean": "tuning_mean", "std": "tuning_std"})
    return _r(report.join(tuning, "model"), "report_mean", "report_std", "tuning_mean", "tuning_std")


def model_ranking(spark, sf):
    f = _r(E.fold_summary(_folds(spark, sf), ["model"], "macro_f1").select("model", F.col("mean").alias("macro_f1")), "macro_f1")
    return _r(E.against_baseline(E.ranking(f, "model", ["macro_f1"], MODELS), [], "model", "beta", "macro_f1"), "gap", "delta")


def fold_steps(spark, sf):
    f = _r(_folds(spark, sf).select("model", "fold", "macro_f1"), "macro_f1")
    return _r(E.stepwise(f, ["model"], "fold", "macro_f1"), "from_first", "from_previous")


def _draws(spark):
    d = None
    for k, m in enumerate(MODELS):
        x = spark.range(400).select(F.col("id").alias("iteration"), F.lit(m).alias("model"), (F.lit(0.5 + 0.01 * k) + hash_u(F.col("id"), "draw-" + m) / float(1 << 32) / 20).alias("macro_f1"))
        d = x if d is None else d.unionByName(x)
    return d


def pairwise_test(spark, sf):
    """Over portable draws: alpha is the reference."""
    seen = _draws(spark).groupBy("model").agg(F.avg("macro_f1").alias("macro_f1"))
    return _r(E.pairwise_test(_draws(spark), seen, "alpha"), "delta", "low", "high", "lower_bound", "p", "p_holm")


def group_bootstrap_ci(spark, sf, draws: int = 2000):
    """Intervals of macro-F1 over whole resampled groups."""
    cells, names = E.confusion_cells(_preds(spark, sf).where("split <> 'training'"), "g", "priority", "pred", "model", CLASSES, MODELS)
    m = written(E.bootstrap_metrics(S.group_bootstrap(cells, names, draws), CLASSES, MODELS), "draws")
    return E.interval(m, ["model"], "macro_f1")


def group_contributions(spark, sf):
    """How many groups have each confusion of model alpha."""
    cells, names = E.confusion_cells(_preds(spark, sf), "g", "priority", "pred", "model", CLASSES, ["alpha"])
    return cells.select(*[F.col(f"`{n}`").alias(n.replace("|", "_")) for n in names]).groupBy(*[n.replace("|", "_") for n in names]).agg(F.count("*").alias("groups"))


def holm_adjustment(spark, sf):
    """p-values of priority against type and queue within each language, as one family per variable."""
    from ticketloom.functions.stats import association, contingency

    d = _base(spark, sf)
    out = None
    for c in ("type", "queue"):
        for lang in ("de", "en"):
            x = association(contingency(d.where(F.col("language") == lang), c, "priority")).select(F.lit(c).alias("variable"), F.lit(lang).alias("language"), F.round("p", 9).alias("p"))
            out = x if out is None else out.unionByName(x)
    return _r(holm(out, "p", ["variable"], ["language"]), "p", "p_holm")


def _case_ids(d, per_class=CASES, seed="cases"):
    """Held-out records to explain: one per group, sampled per class."""
    held = S.group_representatives(d.where("split <> 'training'"), "g", "record_id")
    return S.stratified_sample(held, "record_id", [F.col("priority")], per_class, seed).select(F.col("record_id").alias("id"), F.col("priority").alias("stratum"))


def _attributed(spark, sf):
    """All words' values, the weights of complement naive Bayes, the values of the background and of the cases, and the cases."""
    d = _base(spark, sf)
    w = written(_nb(d)[1], "weights")
    v = written(_words(d).join(w.select("feature").distinct(), "feature"), "values")
    back = S.stratified_sample(d.where("split = 'training'"), "record_id", [F.col("priority")], BACKGROUND, "background").select(F.col("record_id").alias("id"))
    bg = written(v.join(F.broadcast(back), "id", "left_semi"), "background")
    ids = written(_case_ids(d), "cases")
    return v, w, bg, v.join(F.broadcast(ids.select("id")), "id", "left_semi"), ids


def _phi(spark, sf):
    v, w, bg, cases, ids = _attributed(spark, sf)
    return v, w, cases, ids, written(X.linear_attributions(cases, w, bg, ids), "phi")


def _predicted(cases, w, ids):
    return M.best_label(M.linear_scores(cases, w, ids=ids), 6).select("id", F.col("label").alias("pred"))


def linear_attribution(spark, sf):
    """Cases: one held-out record of a group, a sample per class."""
    return _r(_phi(spark, sf)[-1], "phi")


def attribution_additivity(spark, sf):
    """Base and attributions against the score of every held-out record, the features that it lacks being one sum."""
    d = _base(spark, sf)
    v, w, bg, *_ = _attributed(spark, sf)
    ids = d.where("split <> 'training'").select(F.col("record_id").alias("id"))
    held = v.join(ids, "id", "left_semi")
    phi = written(X.linear_attributions(held, w, bg, ids, absent=False), "phi")
    scores = written(M.linear_scores(held, w, ids=ids), "scores")
    base = X.expected_scores(bg, w)
    total = phi.groupBy("id", "label").agg(F.sum("phi").alias("phi"))
    rebuilt = scores.join(F.broadcast(base), "label").join(total, ["id", "label"], "left").select("id", "label", (F.col("base") + F.coalesce("phi", F.lit(0.0))).alias("score"))
    same = M.best_label(scores, 6).alias("a").join(M.best_label(rebuilt, 6).alias("b"), "id").select((F.col("a.label") == F.col("b.label")).alias("same"), F.round("a.score", 5).alias("score"))
    return X.additivity_error(phi, base, scores).select((F.col("max_error") < 1e-6).alias("additive")).crossJoin(same.agg(F.count("*").alias("records"), F.count_if("same").alias("rebuilt"), F.round(F.sum("score"), 3).alias("score")))


def attribution_compactness(spark, sf):
    out = X.compactness(_r(_phi(spark, sf)[-1], "phi", digits=9), None, ("id", "label"))
    return _r(out, "mass", "top_5_share", "top_10_share", "top_20_share", "entropy")


def compactness_summary(spark, sf):
    """Over all features of the background and over those that the case has."""
    *_, cases, ids, phi = _phi(spark, sf)
    phi = _r(phi, "phi", digits=9)
    active = phi.join(cases.select("id", "feature"), ["id", "feature"], "left_semi")
    scopes = [X.compactness(p, None, ("id", "label")).withColumn("scope", F.lit(n)) for n, p in (("full", phi), ("active", active))]
    return _r(X.compactness_summary(scopes[0].unionByName(scopes[1]), ["label", "scope"]), "mean", "median", "std")


def attribution_top(spark, sf):
    return _r(X.top_features(_phi(spark, sf)[-1], 50), "mean_abs")


def attribution_groups(spark, sf):
    phi = _phi(spark, sf)[-1].withColumn("feature", F.concat(F.when(F.col("feature").rlike("[0-9]"), "number:").otherwise("word:"), "feature"))
    return _r(X.group_shares(phi, ("label",)), "share")


def local_contributions(spark, sf):
    *_, cases, _, phi = _phi(spark, sf)
    return _r(X.local_contributions(phi, cases, 10), "phi")


def assessment_template(spark, sf):
    _, w, cases, ids, phi = _phi(spark, sf)
    return X.assessment_template(X.local_contributions(phi, cases, 3), _predicted(cases, w, ids), 3)


def faithfulness_linear(spark, sf):
    """Against five random removals, for several numbers of removed words."""
    _, w, cases, ids, phi = _phi(spark, sf)
    out = X.faithfulness_study(cases, phi, w, written(_predicted(cases, w, ids), "predicted"), [1, 3, 5, 10], 5, "random")
    return _r(out, "drop_top", "drop_random", "flip_random", "advantage")


def compactness_contrast(spark, sf):
    """Complement against multinomial naive Bayes: are the former's attributions more compact?"""
    v, w, cases, ids, _ = _phi(spark, sf)
    d = _base(spark, sf)
    bg = v.join(F.broadcast(S.stratified_sample(d.where("split = 'training'"), "record_id", [F.col("priority")], BACKGROUND, "background").select(F.col("record_id").alias("id"))), "id", "left_semi")
    other = M.multinomial_nb_weights(_nb(d)[0], d.where("split = 'training'"), "record_id", "priority")
    made = []
    for weights in (w, written(other, "other")):
        pred = _predicted(cases, weights, ids)
        phi = _r(X.linear_attributions(cases, weights, bg, ids), "phi", digits=9).join(pred.withColumnRenamed("pred", "label"), ["id", "label"], "left_semi")
        made.append(_r(written(X.compactness(phi), "compact"), "top_5_share", "top_10_share", "top_20_share", "entropy", digits=9))
    return _r(X.compactness_contrast(*made, ids, 20, "contrast"), "observed", "low", "high", "p")


def spearman_compare(spark, sf):
    """Attributions against a background of all rows and of the sample."""
    v, w, bg, cases, ids = _attributed(spark, sf)
    wide = v.join(cases.select("feature").distinct(), "feature")
    rows = v.select("id").distinct().count()
    mean = wide.groupBy("feature").agg((F.sum("value") / rows).alias("mean"))
    full = cases.join(mean, "feature").join(w, "feature").select("id", "label", "feature", ((F.col("value") - F.col("mean")) * F.col("weight")).alias("phi"))
    return _r(X.compare_attributions(X.linear_attributions(cases, w, bg, ids, absent=False).where("feature <> '<absent>'"), full, ["label"]), "spearman")


def _fitted(spark, sf, kind, **params):
    d = _base(spark, sf)
    train, test = d.where("split = 'training'"), d.where("split <> 'training'")
    counts = written(_words(train), "train-words")
    n = train.count()
    full = written(V.vocabulary(counts, 5, TERMS), "vocabulary")
    vocab = full.select("feature")
    a, b = V.tfidf(counts, full, n), V.tfidf(_words(test), full, n)
    of = {"ids": train.select(F.col("record_id").alias("id")), "asked_ids": test.select(F.col("record_id").alias("id"))}
    args = (a, b, vocab, d, "record_id", "priority", CLASSES)
    own = {"adaboost": TR.adaboost, "boosted": TR.boosted}
    pred = own[kind](*args, **of, **params) if kind in own else M.fit_predict(kind, *args, **of, **params)
    judged = pred.join(d.select(F.col("record_id").alias("id"), "priority"), "id")
    return E.summary_metrics(E.class_metrics(E.confusion(judged, "priority", "pred", CLASSES))).withColumn("model", F.lit(kind))


def model_logistic(spark, sf):
    return _fitted(spark, sf, "logistic", regParam=0.001, maxIter=100)


def model_svm(spark, sf):
    return _fitted(spark, sf, "svm", regParam=0.01, maxIter=100)


def model_tree(spark, sf):
    return _fitted(spark, sf, "tree", maxDepth=12)


def model_forest(spark, sf):
    return _fitted(spark, sf, "forest", numTrees=100, maxDepth=10, seed=42)


def model_boosted(spark, sf):
    return _fitted(spark, sf, "boosted", rounds=20, depth=4)


def model_adaboost(spark, sf):
    return _fitted(spark, sf, "adaboost", rounds=10)


def _vectorized(spark, sf):
    """Vectors over all words in five training records or more, the words, the records, and the ids of the cases."""
    d = _base(spark, sf)
    counts = written(_words(d), "words")
    train = counts.join(d.where("split = 'training'").select(F.col("record_id").alias("id")), "id", "left_semi")
    vocab = V.vocabulary(train, 5, TERMS).select("feature")
    vec, names = V.to_vectors(counts, vocab, d.select(F.col("record_id").alias("id")))
    y = (F.array_position(F.array(*[F.lit(c) for c in CLASSES]), F.col("priority")) - 1).cast("double")
    return written(vec.join(d.select(F.col("record_id").alias("id"), y.alias("label"), "split"), "id"), "vectors"), names, d


def _forest(spark, sf):
    data, names, d = _vectorized(spark, sf)
    model = M.estimator("forest", numTrees=20, maxDepth=6, seed=42).fit(data.where("split = 'training'").select("features", "label"))
    cases = data.join(_case_ids(d, 30), "id", "left_semi")
    return [written(X.tree_attributions(cases, model, names, CLASSES, exact=e), "tree") for e in (True, False)]


def tree_attribution(spark, sf):
    """Exact and path attributions of a forest for a sample of cases, compared by rank."""
    return X.compare_attributions(*_forest(spark, sf), ["label"])


def tree_case_metrics(spark, sf):
    """The same two compared by the compactness of each case."""
    return X.compare_case_metrics(*_forest(spark, sf))


def _permuted(spark, sf, *settings):
    """Permutation attributions of nearest-centroid probabilities for each (background rows per class, cycles)."""
    data, names, d = _vectorized(spark, sf)
    from pyspark.ml.stat import Summarizer

    means = {int(r["label"]): r["m"].toArray() for r in data.where("split = 'training'").groupBy("label").agg(Summarizer.mean(F.col("features")).alias("m")).collect()}
    c = np.array([means.get(k, np.zeros(len(names))) for k in range(len(CLASSES))])

    def score(rows: np.ndarray) -> np.ndarray:
        far = (rows**2).sum(axis=1)[:, None] - 2 * rows @ c.T + (c**2).sum(axis=1)
        e = np.exp(-far + far.min(axis=1, keepdims=True))
        return e / e.sum(axis=1, keepdims=True)

    cases = data.join(_case_ids(d, 10), "id", "left_semi")
    train = d.where("split = 'training'")
    out = []
    for per_class, cycles in settings:
        chosen = S.stratified_sample(train, "record_id", [F.col("priority")], per_class, "background").select(F.col("record_id").alias("id"))
        rows = data.join(F.broadcast(chosen), "id", "left_semi").orderBy("id").collect()  # per_class rows of each class
        out.append(written(X.permutation_attributions(cases.repartition(8), np.array([r["features"].toArray() for r in rows]), score, names, CLASSES, cycles), "permuted"))
    return out


def permutation_attribution(spark, sf):
    return X.top_features(_permuted(spark, sf, (1, 2))[0], 15)


def permutation_sensitivity(spark, sf):
    """A larger background against a smaller one, and two cycles against one: rank correlation and compactness."""
    base, small, short = _permuted(spark, sf, (2, 2), (1, 2), (2, 1))
    parts = [X.compare_case_metrics(base, x).join(X.compare_attributions(base, x, []).select("spearman")).withColumn("setting", F.lit(n)) for n, x in (("background", small), ("cycles", short))]
    return parts[0].unionByName(parts[1])


def content_digest(spark, sf):
    return A.content_hash(_t(spark, sf, "split_assignments"), ["modeling_row_id", "source_row_id", "semantic_group_id", "text_group_id", "priority", "split"])


def split_mismatches(spark, sf):
    """Prepared records against the earlier split: spelling of ids and priorities."""
    s = _t(spark, sf, "split_assignments").groupBy("source_row_id").agg(F.min("text_group_id").alias("text_group_id"), F.min("priority").alias("priority"))
    return A.mismatches(_t(spark, sf, "customer_it_support_prepared"), s, ["source_row_id"], ["text_group_id", "priority"])


def upserted_reviews(spark, sf):
    """Detected languages with the reviewers' in their place."""
    old = _t(spark, sf, "language_audit").select("source_row_id", F.col("detected_language").alias("language"), "language_confidence")
    new = _t(spark, sf, "language_label_manual_review").where("manual_language is not null").select("source_row_id", F.col("manual_language").alias("language"))
    return A.upsert(old, new, ["source_row_id"]).groupBy("language").agg(F.count("*").alias("records"), F.count("language_confidence").alias("with_confidence"))


def only_one_side(spark, sf):
    """Ids of prepared records and of the split that the other lacks."""
    a, b = _t(spark, sf, "customer_it_support_prepared").select("source_row_id").distinct(), _t(spark, sf, "split_assignments").select("source_row_id").distinct()
    return A.symmetric_difference(a, b)


ASSESSMENTS = ["detector_correct", "declared_correct", "both_correct", "both_wrong", "mixed_text"]


def review_summary(spark, sf):
    return A.review_summary(_t(spark, sf, "language_label_manual_review"), ASSESSMENTS)


def review_defects(spark, sf):
    return A.review_defects(_t(spark, sf, "language_label_manual_review"), ASSESSMENTS)


def integrity_audit(spark, sf):
    p, t, s = _t(spark, sf, "customer_it_support_prepared"), _t(spark, sf, "aa_dataset_tickets"), _t(spark, sf, "split_assignments")
    n = lambda df, e: df.agg(e.alias("v"))
    repeated = lambda df, k: df.groupBy(k).count().where("count > 1").agg(F.count("*").alias("v"))
    return A.audit([
        A.check("data", "record_id is unique", repeated(p, "record_id"), 0), A.check("data", "source_row_id is unique", repeated(p, "source_row_id"), 0), A.check("data", "raw rows are delivered once", repeated(t, "source_row_id"), 0),
        A.check("data", "prepared tickets exist", p.join(t, "source_row_id", "left_anti").agg(F.count("*").alias("v")), 0), A.check("data", "no empty text", n(p, F.count_if(F.trim(F.coalesce("text_clean", F.lit(""))) == "")), 0),
        A.check("split", "share of training", n(s, F.avg((F.col("split") == "training").cast("double"))), 0.7, 0.05), A.check("split", "no text group in two parts", S.leaking_groups(s, "text_group_id", "split").agg(F.count("*").alias("v")), 0),
        A.check("evaluation", "alpha's accuracy", model_summary(spark, sf).where("model = 'alpha'").select("accuracy"), 0.8, 0.03),
    ])


QUERIES = {f.__name__: f for f in (
    word_tfidf, char_wb_tfidf, chi2_top_k, feature_union_profile, majority_baseline, complement_nb_scores, knn_votes, confusion_matrix, class_metrics, model_summary, fold_metrics, model_ranking, fold_steps, pairwise_test, group_bootstrap_ci,
    group_contributions, holm_adjustment, linear_attribution, attribution_additivity, attribution_compactness, attribution_top, attribution_groups, local_contributions, faithfulness_linear, spearman_compare, model_logistic, model_svm, model_tree,
    model_forest, model_boosted, model_adaboost, tree_attribution, tree_case_metrics, permutation_attribution, permutation_sensitivity, compactness_summary, compactness_contrast, assessment_template, content_digest, split_mismatches, upserted_reviews, only_one_side, review_summary, review_defects, integrity_audit,
)}
