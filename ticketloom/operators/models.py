"""Classifiers: closed forms in SQL, neighbours, and estimators of Spark ML behind one interface."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.operators.features import to_vectors
from ticketloom.session import MappedFiles


def majority(train: DataFrame, label: str) -> DataFrame:
    """(label, records): the commonest label, the smallest on ties."""
    return train.where(F.col(label).isNotNull()).groupBy(label).agg(F.count("*").alias("records")).orderBy(F.desc("records"), label).limit(1)


def complement_nb_weights(values: DataFrame, labels: DataFrame, id_col: str, label: str, alpha: float = 1.0) -> DataFrame:
    """(feature, label, weight): minus the log share of each feature in the other classes' mass."""
    y = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    known = values.join(y, "id")
    own = known.groupBy("feature", "label").agg(F.sum("value").alias("own"))
    total = known.groupBy("feature").agg(F.sum("value").alias("total"))
    classes = y.select("label").distinct()
    grid = total.crossJoin(F.broadcast(classes)).join(own, ["feature", "label"], "left").select("feature", "label", (F.col("total") - F.coalesce("own", F.lit(0.0)) + alpha).alias("c"))
    mass = grid.groupBy("label").agg(F.sum("c").alias("mass"))
    return grid.join(F.broadcast(mass), "label").select("feature", "label", (-F.log(F.col("c") / F.col("mass"))).alias("weight"))


def multinomial_nb_weights(values: DataFrame, labels: DataFrame, id_col: str, label: str, alpha: float = 1.0) -> DataFrame:
    """(feature, label, weight): the log share of each feature in the class' own mass."""
    y = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("label"))
    own = values.join(y, "id").groupBy("feature", "label").agg(F.sum("value").alias("own"))
    grid = own.select("feature").distinct().crossJoin(F.broadcast(y.select("label").distinct())).join(own, ["feature", "label"], "left").select("feature", "label", (F.coalesce("own", F.lit(0.0)) + alpha).alias("c"))
    mass = grid.groupBy("label").agg(F.sum("c").alias("mass"))
    return grid.join(F.broadcast(mass), "label").select("feature", "label", F.log(F.col("c") / F.col("mass")).alias("weight"))


def linear_scores(values: DataFrame, weights: DataFrame, intercepts: DataFrame | None = None, ids: DataFrame | None = None) -> DataFrame:
    """(id, label, score): sum of weight times value over known features, plus the label's intercept.

    With ids, a column id, each of them has a score for every label of the weights, 0 without a known feature.
    """
    scores = values.join(weights, "feature").groupBy("id", "label").agg(F.sum(F.col("value") * F.col("weight")).alias("score"))
    if ids is not None:
        grid = ids.where("id is not null").select("id").distinct().crossJoin(F.broadcast(weights.select("label").distinct()))
        scores = grid.join(scores, ["id", "label"], "left").select("id", "label", F.coalesce("score", F.lit(0.0)).alias("score"))
    if intercepts is None:
        return scores
    return scores.join(F.broadcast(intercepts), "label").select("id", "label", (F.col("score") + F.col("intercept")).alias("score"))


def best_label(scores: DataFrame, digits: int = 9) -> DataFrame:
    """(id, label, score) of the highest score, the smallest label on ties."""
    order = Window.partitionBy("id").orderBy(F.desc(F.round("score", digits)), "label")
    return scores.withColumn("_r", F.row_number().over(order)).where("_r = 1").drop("_r")


#: Queries and rows of a block of similarities, and features that are multiplied as dense columns, the commonest ones; the others meet one by one.
QUERIES, ROWS, DENSE = 512, 4096, 384


def _packed_rows(values: DataFrame) -> DataFrame:
    """(id, h, v): the features of each row as 64-bit hashes, with their values."""
    pairs = values.where("value is not null").select(F.col("id").cast("bigint").alias("id"), F.struct(F.xxhash64("feature").alias("h"), F.col("value").cast("double").alias("v")).alias("p"))
    return pairs.where("id is not null").groupBy("id").agg(F.collect_list("p").alias("p")).select("id", F.col("p.h").alias("h"), F.col("p.v").alias("v"))


def _nearest_sparse(queries: DataFrame, rows: DataFrame, k: int) -> DataFrame:
    """(q, t, s): for each query at least its k most similar rows but itself, by products over shared features, and few more."""
    files = MappedFiles(queries.sparkSession, "queries")

    def flat(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            if b.num_rows:
                cells = (b.column("id"), b.column("h").value_lengths().cast(pa.int64()), b.column("h").flatten(), b.column("v").flatten())
                yield pa.RecordBatch.from_arrays([pa.array([c.to_numpy(zero_copy_only=False).tobytes()]) for c in cells], names=["id", "size", "h", "v"])

    files.write(queries.mapInArrow(flat, "id binary, size binary, h binary, v binary"))

    def found(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        q, size, qh, qv = files.read("id", np.int64), files.read("size", np.int64), files.read("h", np.int64), files.read("v", np.float64)
        names, code, often = np.unique(qh, return_inverse=True, return_counts=True)
        rank = np.empty(len(names), np.int64)
        rank[np.argsort(-often, kind="stable")] = np.arange(len(names))
        code, start = rank[code], np.concatenate([[0], np.cumsum(size)])
        dense = min(DENSE, len(names))
        signed = bool((qv[:] <= 0).any())
        best = {}

        def dense_part(row: np.ndarray, c: np.ndarray, v: np.ndarray, n: int) -> np.ndarray:
            m = np.zeros((n, dense))
            of = c < dense
            np.add.at(m, (row[of], c[of]), v[of])
            return m

        def products(x: tuple, y: tuple, n: int, m: int) -> np.ndarray:
            """Of n queries and m rows, each (row, code, value); those of y are in the order of the codes."""
            out = dense_part(*x, n) @ dense_part(*y, m).T
            of = x[1] >= dense
            row, c, v = (z[of] for z in x)
            lo, hi = np.searchsorted(y[1], c), np.searchsorted(y[1], c, "right")
            many = hi - lo
            if many.sum():
                at = np.repeat(lo - np.cumsum(many) + many, many) + np.arange(many.sum())
                out += np.bincount(np.repeat(row, many) * m + y[0][at], np.repeat(v, many) * y[2][at], n * m).reshape(n, m)
            return out

        for whole in batches:
            for s in range(0, whole.num_rows, ROWS):
                b = whole.slice(s, ROWS)
                ids, m = b.column("id").to_numpy(), b.num_rows
                row = np.repeat(np.arange(m), b.column("h").value_lengths().to_numpy())
                h, v = b.column("h").flatten().to_numpy(), b.column("v").flatten().to_numpy()
                at = np.minimum(np.searchsorted(names, h), max(0, len(names) - 1))
                use = names[at] == h if len(names) else np.zeros(len(h), bool)
                row, c, v = row[use], rank[at[use]], v[use]
                order = np.argsort(c, kind="stable")
                y = (row[order], c[order], v[order])
                zeros = signed or bool((v <= 0).any())
                for lo in range(0, len(q), QUERIES):
                    hi = min(lo + QUERIES, len(q))
                    n, span = hi - lo, slice(start[lo], start[hi])
                    x = (np.repeat(np.arange(n), size[lo:hi]), code[span], np.asarray(qv[span]))
                    sim = products(x, y, n, m)
                    if zeros:  # only then a sum may be 0 or less over shared features
                        shared = products((x[0], x[1], np.ones(len(x[0]))), (y[0], y[1], np.ones(len(y[0]))), n, m) > 0
                        sim[~shared] = -np.inf
                    else:
                        sim[sim <= 0] = -np.inf
                    sim[q[lo:hi, None] == ids[None, :]] = -np.inf
                    old = best.get(lo)
                    least = np.partition(sim, m - k, axis=1)[:, m - k] if old is None and m > k else old[3] if old else np.full(n, -np.inf)
                    i, j = np.nonzero((sim >= (least - 2e-9)[:, None]) & (sim > -np.inf))
                    t, value = ids[j], sim[i, j]
                    if old:
                        i, t, value = np.concatenate([old[0], i]), np.concatenate([old[1], t]), np.concatenate([old[2], value])
                    order = np.lexsort((t, -np.round(value, 9), i))
                    i, t, value = i[order], t[order], value[order]
                    place = np.arange(len(i)) - np.searchsorted(i, i)
                    last = np.full(n, -np.inf)
                    full = place == k - 1
                    last[i[full]] = value[full]
                    keep = place < k
                    best[lo] = (i[keep], t[keep], value[keep], last)
        for lo, (i, t, value, _) in best.items():
            if len(i):
                yield pa.RecordBatch.from_arrays([pa.array(q[lo + i]), pa.array(t), pa.array(value)], names=["q", "t", "s"])

    return rows.mapInArrow(found, "q bigint, t bigint, s double")


def neighbour_votes(queries: DataFrame, train: DataFrame, labels: DataFrame, id_col: str, label: str, k: int = 5, by_distance: bool = False) -> DataFrame:
    """(id, label, score): votes of the k most similar training rows, rows being unit vectors in long form; ties by the smaller id.

    A query that shares no feature with any row has no vote; see with_default().

    The queries are files that workers map into memory; every worker keeps the
    k best so far of each, so that no pair leaves it. Ids are whole numbers.
    At a distance of 0 a neighbour outweighs all others.
    """
    sim = _nearest_sparse(_packed_rows(queries), _packed_rows(train), k)
    order = Window.partitionBy("q").orderBy(F.desc(F.round("s", 9)), "t")
    top = sim.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= k)
    vote = F.when(F.round(1 - F.col("s"), 9) <= 0, F.lit(1e12)).otherwise(1 / (1 - F.col("s"))) if by_distance else F.lit(1.0)
    y = labels.select(F.col(id_col).alias("t"), F.col(label).alias("label"))
    return top.join(y, "t").groupBy(F.col("q").alias("id"), "label").agg(F.sum(vote).alias("score"))


def with_default(best: DataFrame, ids: DataFrame, default: DataFrame) -> DataFrame:
    """(id, label, score) of best, and for every other id the label of the one row of default with the score 0."""
    rest = ids.select("id").distinct().join(best.select("id"), "id", "left_anti").crossJoin(F.broadcast(default.select(F.col(default.columns[0]).alias("label")).limit(1)))
    return best.select("id", "label", "score").unionByName(rest.select("id", "label", F.lit(0.0).alias("score")))


def estimator(kind: str, **params):
    """A Spark ML estimator over features and label columns: logistic, svm, tree, forest, boosted or naive_bayes."""
    from pyspark.ml import classification as C

    make: dict[str, Callable] = {
        "logistic": lambda p: C.LogisticRegression(standardization=False, elasticNetParam=0.0, maxIter=p.pop("maxIter", 50), **p),
        "svm": lambda p: C.OneVsRest(classifier=C.LinearSVC(maxIter=p.pop("maxIter", 30), **p)),
        "tree": lambda p: C.DecisionTreeClassifier(**p),
        "forest": lambda p: C.RandomForestClassifier(featureSubsetStrategy="sqrt", subsamplingRate=0.75, **p),
        "boosted": lambda p: C.OneVsRest(classifier=C.GBTClassifier(maxIter=p.pop("maxIter", 10), **p)),
        "naive_bayes": lambda p: C.NaiveBayes(modelType="complement", **p),
    }
    return make[kind](dict(params))


def fit_predict(kind: str, train: DataFrame, test: DataFrame, vocab: DataFrame, labels: DataFrame, id_col: str, label: str, classes: list[str], ids: DataFrame | None = None, asked_ids: DataFrame | None = None, **params) -> DataFrame:
    """(id, pred): an estimator fitted on train's long-form features and applied to test's; labels are the index in classes.

    ids and asked_ids name the rows of either part, so that rows without a known feature are fitted and predicted too.
    """
    y = F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1
    truth = labels.where(F.col(label).isin(*classes)).select(F.col(id_col).alias("id"), y.cast("double").alias("label"))
    known, _ = to_vectors(train, vocab, ids)
    asked, _ = to_vectors(test, vocab, asked_ids)
    model = estimator(kind, **params).fit(known.join(truth, "id").select("features", "label"))
    names = F.array(*[F.lit(c) for c in classes])
    return model.transform(asked).select("id", F.element_at(names, F.col("prediction").cast("int") + 1).alias("pred"))


def adaboost(train: DataFrame, test: DataFrame, vocab: DataFrame, labels: DataFrame, id_col: str, label: str, classes: list[str], ids: DataFrame | None = None, asked_ids: DataFrame | None = None, rounds: int = 5, depth: int = 2, seed: int = 42) -> DataFrame:
    """(id, pred): multi-class boosting (SAMME) of weighted trees; ends early when a tree is no better than chance."""
    import math

    from pyspark.ml.classification import DecisionTreeClassifier

    from ticketloom.session import written

    y = (F.array_position(F.array(*[F.lit(c) for c in classes]), F.col(label)) - 1).cast("double")
    truth = labels.where(F.col(label).isin(*classes)).select(F.col(id_col).alias("id"), y.alias("label"))
    data = written(to_vectors(train, vocab, ids)[0].join(truth, "id").withColumn("weight", F.lit(1.0)), "boost")
    asked = to_vectors(test, vocab, asked_ids)[0]
    votes = [F.lit(0.0) for _ in classes]
    for i in range(rounds):
        model = DecisionTreeClassifier(maxDepth=depth, weightCol="weight", seed=seed).fit(data)
        judged = model.transform(data).select("id", "features", "label", "weight", (F.col("prediction") != F.col("label")).alias("miss"))
        row = judged.agg(F.sum("weight").alias("all"), F.sum(F.when(F.col("miss"), F.col("weight")).otherwise(0.0)).alias("bad")).first()
        error = min(1 - 1e-9, max(1e-9, row["bad"] / row["all"]))
        if error >= 1 - 1 / len(classes):
            break
        say = math.log((1 - error) / error) + math.log(len(classes) - 1)
        asked = model.transform(asked).withColumnRenamed("prediction", f"_p{i}").drop("rawPrediction", "probability")
        votes = [v + F.when(F.col(f"_p{i}") == k, say).otherwise(0.0) for k, v in enumerate(votes)]
        data = written(judged.select("id", "features", "label", F.when(F.col("miss"), F.col("weight") * math.exp(say)).otherwise(F.col("weight")).alias("weight")), "boost")
    top = F.array(*votes)
    names = F.array(*[F.lit(c) for c in classes])
    return asked.select("id", F.element_at(names, F.array_position(top, F.array_max(top)).cast("int")).alias("pred"))


def at_edge(grid: dict[str, list], best: dict) -> dict[str, bool]:
    """Which chosen numeric parameters lie at an end of what was searched."""
    return {k: len(v) > 1 and best[k] in (min(v), max(v)) for k, v in grid.items() if all(isinstance(x, (int, float)) for x in v)}
