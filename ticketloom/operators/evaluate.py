"""Confusions, metrics, rankings, intervals and paired tests."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.stats import holm, ratio


def confusion(preds: DataFrame, actual: str, predicted: str, classes: list[str], keys: list[str] | None = None) -> DataFrame:
    """(keys, actual, predicted, n) for every pair of classes, zeros included; rows with another class or null are left out."""
    keys = keys or []
    spark = preds.sparkSession
    grid = spark.createDataFrame([(a, p) for a in classes for p in classes], "actual string, predicted string")
    counted = preds.select(*keys, F.col(actual).alias("actual"), F.col(predicted).alias("predicted")).where(F.col("actual").isin(*classes) & F.col("predicted").isin(*classes)).groupBy(*keys, "actual", "predicted").agg(F.count("*").alias("n"))
    base = counted.select(*keys).distinct().crossJoin(F.broadcast(grid)) if keys else grid
    return base.join(counted, [*keys, "actual", "predicted"], "left").fillna(0, ["n"])


def class_metrics(conf: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, label, precision, recall, f1, support); a metric whose denominator is 0 is 0."""
    keys = keys or []
    ends = F.explode(F.array(F.struct(F.col("actual").alias("label"), F.lit(1).alias("a"), F.lit(0).alias("p")), F.struct(F.col("predicted").alias("label"), F.lit(0).alias("a"), F.lit(1).alias("p")))).alias("e")
    s = conf.select(*keys, "n", (F.col("actual") == F.col("predicted")).alias("hit"), ends).groupBy(*keys, F.col("e.label").alias("label")).agg(
        F.sum(F.when(F.col("hit"), F.col("n") * F.col("e.a")).otherwise(0)).alias("tp"), F.sum(F.col("n") * F.col("e.a")).alias("support"), F.sum(F.col("n") * F.col("e.p")).alias("named"))
    p, r = ratio(F.col("tp"), F.col("named")), ratio(F.col("tp"), F.col("support"))
    return s.select(*keys, "label", p.alias("precision"), r.alias("recall"), ratio(2 * F.col("tp"), F.col("named") + F.col("support")).alias("f1"), "support", "tp")


def summary_metrics(classes: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """(keys, accuracy, macro_precision, macro_recall, macro_f1, weighted_f1)."""
    n = F.sum("support")
    return classes.groupBy(*(keys or [])).agg(ratio(F.sum("tp"), n).alias("accuracy"), F.avg("precision").alias("macro_precision"), F.avg("recall").alias("macro_recall"), F.avg("f1").alias("macro_f1"), ratio(F.sum(F.col("f1") * F.col("support")), n).alias("weighted_f1"))


def fold_summary(metrics: DataFrame, keys: list[str], value: str, population: bool = False) -> DataFrame:
    """(keys, mean, std) over folds; std with n - 1 for reports, with n if population (as in tuning)."""
    return metrics.groupBy(*keys).agg(F.avg(value).alias("mean"), (F.stddev_pop if population else F.stddev_samp)(value).alias("std"))


def ranking(metrics: DataFrame, name: str, order: list[str], declared: list[str], partition: list[str] | None = None) -> DataFrame:
    """metrics with rank (1 is best) by the columns of order, then the declared order of names; and gap to the next."""
    spark = metrics.sparkSession
    place = spark.createDataFrame([(n, i) for i, n in enumerate(declared)], f"`{name}` string, _place int")
    w = Window.partitionBy(*([F.col(c) for c in partition] if partition else [F.lit(1)])).orderBy(*[F.desc(c) for c in order], F.col("_place").asc_nulls_last(), name)
    out = metrics.join(F.broadcast(place), name, "left")
    return out.withColumn("rank", F.row_number().over(w)).withColumn("gap", F.col(order[0]) - F.lead(order[0]).over(w)).drop("_place")


def stepwise(metrics: DataFrame, partition: list[str], order: str, value: str) -> DataFrame:
    """metrics with the difference to the first row and to the row before, along order in each partition."""
    w = Window.partitionBy(*partition).orderBy(order)
    return metrics.withColumns({"from_first": F.col(value) - F.first(value).over(w), "from_previous": F.col(value) - F.lag(value).over(w)})


def against_baseline(metrics: DataFrame, partition: list[str], name: str, baseline: str, value: str) -> DataFrame:
    """metrics with delta: value less that of the named baseline of the partition."""
    base = F.max(F.when(F.col(name) == baseline, F.col(value))).over(Window.partitionBy(*([F.col(c) for c in partition] if partition else [F.lit(1)])))
    return metrics.withColumn("delta", F.col(value) - base)


def interval(draws: DataFrame, keys: list[str], value: str) -> DataFrame:
    """(keys, low, high, lower_bound): 2.5 and 97.5 percentiles, and the 5th as a one-sided bound."""
    return draws.groupBy(*keys).agg(*[F.expr(f"percentile({value}, {q})").alias(n) for n, q in (("low", 0.025), ("high", 0.975), ("lower_bound", 0.05))])


def centred_p(draws: DataFrame, observed: DataFrame, keys: list[str], value: str, seen: str, two_sided: bool = False) -> DataFrame:
    """(keys, p): share of draws, centred on their mean, that reach the observed value; (1 + k) / (1 + n)."""
    centre = draws.groupBy(*keys).agg(F.avg(value).alias("_mean"))
    d = draws.join(centre, keys).join(observed.select(*keys, seen), keys)
    null = F.col(value) - F.col("_mean")
    hit = (F.abs(null) >= F.abs(F.col(seen))) if two_sided else (null >= F.col(seen))
    return d.groupBy(*keys).agg(F.least(F.lit(1.0), (1 + F.count_if(hit)) / (1 + F.count("*"))).alias("p"))


def pairwise_test(draws: DataFrame, observed: DataFrame, reference: str, model: str = "model", value: str = "macro_f1", alpha: float = 0.05) -> DataFrame:
    """(model, delta, low, high, lower_bound, p, p_holm, significant) of every model against the reference, over paired draws."""
    pick = lambda d, c: d.where(F.col(model) == reference).select(*([] if c is None else [c]), F.col(value).alias("_ref"))
    diff = draws.where(F.col(model) != reference).join(F.broadcast(pick(draws, "iteration")), "iteration").select(model, (F.col(value) - F.col("_ref")).alias("d"))
    seen = observed.where(F.col(model) != reference).crossJoin(F.broadcast(pick(observed, None))).select(model, (F.col(value) - F.col("_ref")).alias("delta"))
    joined = seen.join(interval(diff, [model], "d"), model).join(centred_p(diff, seen, [model], "d", "delta"), model)
    return holm(joined, "p", tie=[model]).withColumn("significant", (F.col("delta") > 0) & (F.col("p_holm") < alpha))


def bootstrap_metrics(drawn: DataFrame, classes: list[str], models: list[str]) -> DataFrame:
    """(iteration, model, accuracy, macro_f1, weighted_f1) from summed confusions in columns model|actual|predicted; no group's F1 is averaged."""
    out = []
    for m in models:
        cell = lambda a, p, m=m: F.col(f"`{m}|{a}|{p}`")
        tp = {k: cell(k, k) for k in classes}
        support = {k: sum((cell(k, p) for p in classes), F.lit(0.0)) for k in classes}
        named = {k: sum((cell(a, k) for a in classes), F.lit(0.0)) for k in classes}
        f1 = {k: ratio(2 * tp[k], support[k] + named[k]) for k in classes}
        n = sum(support.values(), F.lit(0.0))
        out.append(F.struct(F.lit(m).alias("model"), ratio(sum(tp.values(), F.lit(0.0)), n).alias("accuracy"), (sum(f1.values(), F.lit(0.0)) / len(classes)).alias("macro_f1"), ratio(sum((f1[k] * support[k] for k in classes), F.lit(0.0)), n).alias("weighted_f1")))
    return drawn.select("iteration", F.explode(F.array(*out)).alias("m")).select("iteration", "m.*")


def confusion_cells(preds: DataFrame, group: str, actual: str, predicted: str, model: str, classes: list[str], models: list[str]) -> tuple[DataFrame, list[str]]:
    """A row per group with its confusion counts of each model as columns, for resampling groups; and the columns' names."""
    names = [f"{m}|{a}|{p}" for m in models for a in classes for p in classes]
    cell = F.concat_ws("|", model, actual, predicted)
    out = preds.where(F.col(group).isNotNull()).groupBy(group).agg(*[F.count_if(cell == n).alias(n) for n in names])
    return out, names
