"""Additive explanations: attributions, concentration, faithfulness, tree and permutation values."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.rng import hash_u
from ticketloom.functions.stats import spearman


def linear_attributions(values: DataFrame, weights: DataFrame, background: DataFrame, ids: DataFrame | None = None, absent: bool = True) -> DataFrame:
    """(id, label, feature, phi): weight times (value less the background's mean), for features where that is not 0.

    A feature that a case lacks contributes through the background's mean, so
    each case of a bounded selection is completed with the background's
    features. With absent False these are summed: a feature <absent> has the
    label's constant over all background features less the case's own part of
    it, one join whatever the number of cases. ids, a column id: the cases,
    those without any feature too; else the ids of values.
    """
    rows = background.select("id").distinct().count()
    mean = background.groupBy("feature").agg((F.sum("value") / max(1, rows)).alias("mean"))
    cases = (values if ids is None else ids).select("id").distinct()
    if absent:
        grid = cases.crossJoin(F.broadcast(mean.select("feature"))).unionByName(values.select("id", "feature")).distinct()
        full = grid.join(values, ["id", "feature"], "left").join(mean, "feature", "left")
        shift = full.select("id", "feature", (F.coalesce("value", F.lit(0.0)) - F.coalesce("mean", F.lit(0.0))).alias("d")).where("d <> 0")
        return shift.join(weights, "feature").select("id", "label", "feature", (F.col("d") * F.col("weight")).alias("phi"))
    lost = mean.join(weights, "feature").groupBy("label").agg((-F.sum(F.col("mean") * F.col("weight"))).alias("all"))  # a row per label
    present = values.join(cases, "id", "left_semi").join(mean, "feature", "left").join(weights, "feature").withColumn("mean", F.coalesce("mean", F.lit(0.0)))
    own = present.groupBy("id", "label").agg(F.sum(F.col("mean") * F.col("weight")).alias("own"))
    rest = cases.crossJoin(F.broadcast(lost)).join(own, ["id", "label"], "left").select("id", "label", F.lit("<absent>").alias("feature"), (F.col("all") + F.coalesce("own", F.lit(0.0))).alias("phi"))
    return present.select("id", "label", "feature", ((F.col("value") - F.col("mean")) * F.col("weight")).alias("phi")).unionByName(rest).where("phi <> 0")


def expected_scores(background: DataFrame, weights: DataFrame) -> DataFrame:
    """(label, base): the mean score over the background."""
    rows = background.select("id").distinct().count()
    return background.join(weights, "feature").groupBy("label").agg((F.sum(F.col("value") * F.col("weight")) / max(1, rows)).alias("base"))


def additivity_error(phi: DataFrame, base: DataFrame, scores: DataFrame) -> DataFrame:
    """(max_error): the largest distance of base plus attributions from the score; cases without attributions count."""
    total = phi.groupBy("id", "label").agg(F.sum("phi").alias("sum"))
    joined = scores.join(F.broadcast(base), "label").join(total, ["id", "label"], "left")
    return joined.agg(F.max(F.abs(F.col("base") + F.coalesce("sum", F.lit(0.0)) - F.col("score"))).alias("max_error"))


def compactness(phi: DataFrame, available: int | None = None, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, mass, nonzero, top_5_share, top_10_share, top_20_share, k_50, k_80, k_90, entropy) of absolute attributions per case.

    entropy is normalized by the log of available, or of the nonzero count if
    that is None; 0 for one feature or none.
    """
    a = phi.select(*keys, "feature", F.abs("phi").alias("a")).where("a > 0")
    case = Window.partitionBy(*keys)
    order = case.orderBy(F.desc("a"), "feature")
    r = a.withColumns({"mass": F.sum("a").over(case), "rank": F.row_number().over(order)})
    r = r.withColumn("share", F.col("a") / F.col("mass")).withColumn("cum", F.sum("share").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    top = [F.sum(F.when(F.col("rank") <= k, F.col("share")).otherwise(0.0)).alias(f"top_{k}_share") for k in (5, 10, 20)]
    reach = [F.min(F.when(F.round("cum", 12) >= q / 100, F.col("rank"))).alias(f"k_{q}") for q in (50, 80, 90)]
    n = F.count("*") if available is None else F.lit(available)
    entropy = F.when(n > 1, -F.sum(F.col("share") * F.log("share")) / F.log(n.cast("double"))).otherwise(0.0)
    return r.groupBy(*keys).agg(F.first("mass").alias("mass"), F.count("*").alias("nonzero"), *top, *reach, entropy.alias("entropy"))


def top_features(phi: DataFrame, k: int = 50) -> DataFrame:
    """(label, rank, feature, mean_abs) of the k features of the highest mean absolute attribution per label."""
    cases = phi.groupBy("label").agg(F.count_distinct("id").alias("cases"))
    m = phi.groupBy("label", "feature").agg(F.sum(F.abs("phi")).alias("s")).join(F.broadcast(cases), "label").withColumn("mean_abs", F.col("s") / F.col("cases"))
    order = Window.partitionBy("label").orderBy(F.desc(F.round("mean_abs", 9)), "feature")
    return m.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("label", "rank", "feature", "mean_abs")


def local_contributions(phi: DataFrame, active: DataFrame, k: int = 10) -> DataFrame:
    """(id, label, direction, rank, feature, phi): the k strongest positive and negative attributions among features that the case has."""
    have = phi.join(active.select("id", "feature"), ["id", "feature"], "left_semi").where("phi <> 0").withColumn("direction", F.when(F.col("phi") > 0, "positive").otherwise("negative"))
    order = Window.partitionBy("id", "label", "direction").orderBy(F.desc(F.round(F.abs("phi"), 9)), "feature")
    return have.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("id", "label", "direction", "rank", "feature", "phi")


def group_shares(phi: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
    """(keys, feature_group, share) of absolute mass; a feature's group is what stands before its first colon."""
    g = F.substring_index("feature", ":", 1)
    per = phi.groupBy(*keys, g.alias("feature_group")).agg(F.sum(F.abs("phi")).alias("m"))
    return per.withColumn("share", F.try_divide("m", F.sum("m").over(Window.partitionBy(*keys)))).drop("m")


def faithfulness_study(values: DataFrame, phi: DataFrame, weights: DataFrame, predicted: DataFrame, ks: list[int], repeats: int, seed: str | int) -> DataFrame:
    """(id, k, removed, drop_top, flip_top, drop_random, flip_random, advantage, stronger) per case and k, for a linear score.

    The k strongest active features of the predicted label are set to 0, and,
    repeats times, as many random ones by hash; drop is the loss of that
    label's score, flip whether another label then has the highest (the
    smaller on ties); those of the random sets are means. predicted: id, pred.
    """
    own = phi.join(predicted, (phi["id"] == predicted["id"]) & (phi["label"] == predicted["pred"])).select(phi["id"], "feature", "phi")
    active = own.join(values.select("id", "feature", "value"), ["id", "feature"])
    case = Window.partitionBy("id")
    place = {"top": F.row_number().over(case.orderBy(F.desc(F.round(F.abs("phi"), 9)), "feature"))}
    place |= {f"r{i}": F.row_number().over(case.orderBy(hash_u(F.concat_ws("|", F.col("id").cast("string"), "feature"), f"{seed}-{i}"), "feature")) for i in range(repeats)}
    ranked = active.withColumns({f"_{n}": c for n, c in place.items()}).join(weights, "feature").select("id", "label", (F.col("value") * F.col("weight")).alias("part"), *[f"_{n}" for n in place])
    cuts = F.explode(F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("set"), F.col(f"_{n}").alias("place")) for k in ks for n in place])).alias("c")
    lost = ranked.select("id", "label", "part", cuts).groupBy("id", "label", "c.k", "c.set").agg(F.sum("part").alias("score"), F.sum(F.when(F.col("c.place") <= F.col("c.k"), F.col("part")).otherwise(0.0)).alias("lost"), F.sum((F.col("c.place") <= F.col("c.k")).cast("int")).alias("removed"))
    after = lost.join(predicted, "id").groupBy("id", "k", "set").agg(
        F.sum(F.when(F.col("label") == F.col("pred"), F.col("lost"))).alias("drop"), F.first("removed").alias("removed"),
        F.min(F.struct((-F.round(F.col("score") - F.col("lost"), 9)).alias("s"), "label"))["label"].alias("now"), F.first("pred").alias("pred"))
    flip = (F.col("now") != F.col("pred")).cast("double")
    top, random = F.col("set") == "top", F.col("set") != "top"
    out = after.groupBy("id", "k").agg(F.max("removed").cast("int").alias("removed"), F.sum(F.when(top, F.col("drop"))).alias("drop_top"), F.sum(F.when(top, flip)).alias("flip_top"), F.avg(F.when(random, F.col("drop"))).alias("drop_random"), F.avg(F.when(random, flip)).alias("flip_random"))
    return out.withColumn("advantage", F.col("drop_top") - F.col("drop_random")).withColumn("stronger", F.round("advantage", 9) > 0)


COMPACT = ("mass", "nonzero", "top_5_share", "top_10_share", "top_20_share", "k_50", "k_80", "k_90", "entropy")


def compactness_summary(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, metric, mean, median, std) of the nine metrics of compactness over cases; std with n - 1."""
    long = metrics.select(*keys, F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(m).cast("double").alias("v")) for m in COMPACT])).alias("m")).select(*keys, "m.*")
    return long.groupBy(*keys, "metric").agg(F.avg("v").alias("mean"), F.expr("percentile(v, 0.5)").alias("median"), F.stddev_samp("v").alias("std"))


#: Metrics on which two explanations are compared, and whether more of it speaks for the second one.
SENSITIVITY = (("top_10_share", False), ("top_5_share", False), ("top_20_share", False), ("k_80", True), ("entropy", True))


def compactness_contrast(a: DataFrame, b: DataFrame, strata: DataFrame, draws: int, seed: str | int) -> DataFrame:
    """(metric, observed, low, high, p) of the mean paired difference in compactness of explanation a over b, positive where a is more compact.

    Cases of both are paired by id; strata: id, stratum. Each draw resamples
    the cases within their strata, the same ones for every metric; p is that
    of centred draws, one-sided.
    """
    from ticketloom.operators.evaluate import centred_p
    from ticketloom.operators.sampling import hash_bootstrap

    side = lambda x, n: x.select("id", *[F.col(m).cast("double").alias(f"{n}_{m}") for m, _ in SENSITIVITY])
    wide = side(a, "a").join(side(b, "b"), "id").join(strata, "id")
    wide = wide.select("id", "stratum", *[((F.col(f"b_{m}") - F.col(f"a_{m}")) if flip else (F.col(f"a_{m}") - F.col(f"b_{m}"))).alias(m) for m, flip in SENSITIVITY])
    placed = wide.withColumn("i", (F.row_number().over(Window.partitionBy("stratum").orderBy("id")) - 1).cast("bigint"))
    sizes = placed.groupBy("stratum").agg(F.count("*").alias("n"))
    out = None
    for m, _ in SENSITIVITY:
        seen = wide.agg(F.avg(m).alias("observed")).select(F.lit(m).alias("metric"), "observed")
        drawn = hash_bootstrap(placed, "i", m, draws, seed, ["stratum"]).join(F.broadcast(sizes), "stratum").groupBy("iteration").agg((F.sum(F.col("mean") * F.col("n")) / F.sum("n")).alias("d")).select(F.lit(m).alias("metric"), "d")
        row = seen.join(drawn.groupBy("metric").agg(F.expr("percentile(d, 0.025)").alias("low"), F.expr("percentile(d, 0.975)").alias("high")), "metric").join(centred_p(drawn, seen, ["metric"], "d", "observed"), "metric")
        out = row if out is None else out.unionByName(row)
    return out


def compare_case_metrics(a: DataFrame, b: DataFrame, metrics: tuple[str, ...] = ("top_10_share", "k_80", "entropy")) -> DataFrame:
    """(metric, first, second, difference): means over the cases of two explanations' compactness, and of the absolute difference per case."""
    x, y = (compactness(e, None, ("id", "label")).select("id", "label", *[F.col(m).cast("double").alias(f"{n}_{m}") for m in metrics]) for e, n in ((a, "a"), (b, "b")))
    pairs = F.explode(F.array(*[F.struct(F.lit(m).alias("metric"), F.col(f"a_{m}").alias("x"), F.col(f"b_{m}").alias("y")) for m in metrics])).alias("m")
    return x.join(y, ["id", "label"]).select(pairs).groupBy("m.metric").agg(F.avg("m.x").alias("first"), F.avg("m.y").alias("second"), F.avg(F.abs(F.col("m.x") - F.col("m.y"))).alias("difference"))


def assessment_template(local: DataFrame, predicted: DataFrame, k: int = 3) -> DataFrame:
    """(id, pred, positive, negative, plausibility, comment): what a reviewer fills in, with the k strongest features for and against the predicted label."""
    from ticketloom.operators.shaping import first_joined

    own = local.join(predicted, "id").where("label = pred")
    parts = [first_joined(own.where(F.col("direction") == d), ["id"], [F.col("rank")], "feature", k, d) for d in ("positive", "negative")]
    empty = F.lit(None).cast("string")
    return predicted.join(parts[0], "id", "left").join(parts[1], "id", "left").select("id", "pred", "positive", "negative", empty.alias("plausibility"), empty.alias("comment"))


def compare_attributions(a: DataFrame, b: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, spearman, n) of the absolute attributions of two explanations, over the features that both have for a case and label."""
    on = [*dict.fromkeys(["id", *keys]), "label", "feature"] if "label" not in keys else [*dict.fromkeys(["id", *keys]), "feature"]
    x = a.select(*on, F.round(F.abs("phi"), 9).alias("x"))
    y = b.select(*on, F.round(F.abs("phi"), 9).alias("y"))
    return spearman(x.join(y, on), "x", "y", keys)


def tree_paths(model) -> list[dict]:
    """Nodes of a fitted Spark ML tree or forest: tree, id, feature, threshold (categories not supported), children, cover and class shares."""
    trees = model.trees if hasattr(model, "trees") else [model]
    out = []
    for t, tree in enumerate(trees):
        def walk(node) -> int:
            stats = np.array(node.impurityStats().stats())
            me = {"tree": t, "id": len(out), "feature": -1, "threshold": 0.0, "left": -1, "right": -1, "cover": float(stats.sum()), "value": (stats / max(stats.sum(), 1e-12)).tolist()}
            out.append(me)
            if node.subtreeDepth() > 0:
                me["feature"], me["threshold"] = node.split().featureIndex(), node.split().threshold()
                me["left"], me["right"] = walk(node.leftChild()), walk(node.rightChild())
            return me["id"]

        walk(tree._call_java("rootNode"))
    return out


def _tree_shap(nodes: list[dict], root: int, x: np.ndarray, exact: bool) -> dict[int, np.ndarray]:
    """Attributions of one tree for one row. Not exact: the change of the mean along the path, given to the feature split on."""
    phi: dict[int, np.ndarray] = {}
    if not exact:
        n = nodes[root]
        while n["feature"] >= 0:
            nxt = nodes[n["left"] if x[n["feature"]] <= n["threshold"] else n["right"]]
            phi[n["feature"]] = phi.get(n["feature"], 0) + np.array(nxt["value"]) - np.array(n["value"])
            n = nxt
        return phi
    from math import factorial

    #: Exact: Shapley values of the path-dependent expectation, leaf by leaf over the features of its path.
    stack = [(root, {})]
    while stack:
        k, path = stack.pop()
        n = nodes[k]
        if n["feature"] < 0:
            f = list(path)
            one, zero = np.array([path[j][0] for j in f], float), np.array([path[j][1] for j in f])
            m = len(f)
            for i in range(m):
                poly = np.array([1.0])
                for j in range(m):
                    if j != i:
                        poly = np.convolve(poly, [zero[j], one[j]])
                w = sum(c * factorial(s) * factorial(m - s - 1) / factorial(m) for s, c in enumerate(poly))
                phi[f[i]] = phi.get(f[i], 0) + w * (one[i] - zero[i]) * np.array(n["value"])
            continue
        for side, child in (("left", n["left"]), ("right", n["right"])):
            goes = (x[n["feature"]] <= n["threshold"]) == (side == "left")
            share = nodes[child]["cover"] / max(n["cover"], 1e-12)
            o, z = path.get(n["feature"], (1.0, 1.0))
            stack.append((child, {**path, n["feature"]: (o * goes, z * share)}))
    return phi


def tree_attributions(cases: DataFrame, model, names: list[str], classes: list[str], exact: bool = True) -> DataFrame:
    """(id, label, feature, phi) of a Spark ML tree or forest for (id, features) rows; a forest's are the mean of its trees'."""
    nodes = tree_paths(model)
    roots = [n["id"] for i, n in enumerate(nodes) if i == 0 or n["tree"] != nodes[i - 1]["tree"]]
    known = cases.sparkSession.sparkContext.broadcast((nodes, roots, names, classes))
    from pyspark.ml.functions import vector_to_array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nodes, roots, names, classes = known.value
        for b in batches:
            ids, labels, feats, phis = [], [], [], []
            for key, x in zip(b.column("id").to_pylist(), b.column("x").to_pylist()):
                total: dict[int, np.ndarray] = {}
                for r in roots:
                    for f, v in _tree_shap(nodes, r, np.asarray(x), exact).items():
                        total[f] = total.get(f, 0) + v / len(roots)
                for f, v in total.items():
                    for c, p in zip(classes, v):
                        ids.append(key), labels.append(c), feats.append(names[f]), phis.append(float(p))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(feats, pa.string()), pa.array(phis, pa.float64())], names=["id", "label", "feature", "phi"])

    return cases.select(F.col("id").cast("bigint").alias("id"), vector_to_array("features").alias("x")).mapInArrow(run, "id bigint, label string, feature string, phi double")


def permutation_attributions(cases: DataFrame, background: np.ndarray, score: Callable[[np.ndarray], np.ndarray], names: list[str], classes: list[str], cycles: int = 3, seed: int = 42) -> DataFrame:
    """(id, label, feature, phi) by antithetic permutation cycles over the features in which a case differs from a background (a bounded sample).

    score maps rows to one column per class; every order is walked forwards
    and backwards, so each cycle's attributions sum exactly to the difference
    of the scores.
    """
    known = cases.sparkSession.sparkContext.broadcast((background, names, classes))
    from pyspark.ml.functions import vector_to_array

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        background, names, classes = known.value
        for b in batches:
            ids, labels, feats, phis = [], [], [], []
            for key, x in zip(b.column("id").to_pylist(), b.column("x").to_pylist()):
                x = np.asarray(x)
                rng = np.random.default_rng([seed, int(key) & 0x7FFFFFFF])
                vary = np.flatnonzero((background != x).any(axis=0))
                phi = np.zeros((len(vary), len(classes)))
                for _ in range(cycles):
                    order = rng.permutation(len(vary))
                    for walk in (order, order[::-1]):
                        rows = np.repeat(background[None], len(walk) + 1, axis=0)
                        for s, j in enumerate(walk, 1):
                            rows[s:, :, vary[j]] = x[vary[j]]
                        mean = score(rows.reshape(-1, len(x))).reshape(len(walk) + 1, len(background), -1).mean(axis=1)
                        phi[walk] += np.diff(mean, axis=0) / (2 * cycles)
                for j, v in zip(vary, phi):
                    for c, p in zip(classes, v):
                        ids.append(key), labels.append(c), feats.append(names[j]), phis.append(float(p))
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(labels, pa.string()), pa.array(feats, pa.string()), pa.array(phis, pa.float64())], names=["id", "label", "feature", "phi"])

    return cases.select(F.col("id").cast("bigint").alias("id"), vector_to_array("features").alias("x")).mapInArrow(run, "id bigint, label string, feature string, phi double")
