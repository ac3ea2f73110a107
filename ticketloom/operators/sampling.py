"""Sampling, folds and resampling with portable random numbers."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.rng import SPAN, hash_u


#: Different contributions of groups that a bootstrap takes.
MOST_KINDS = 1 << 18


def stratified_sample(df: DataFrame, key: str, strata: list[Column], n: int, seed: str | int) -> DataFrame:
    """Up to n rows of each stratum, by hash order of the key; key is unique. Null strata are strata.

    A first pass keeps hash ranges that hold n of every stratum almost surely,
    so that no stratum is sorted as a whole.
    """
    named = df.withColumns({f"_s{i}": s for i, s in enumerate(strata)}).withColumn("_u", hash_u(F.col(key), seed))
    by = [f"_s{i}" for i in range(len(strata))]
    sizes = named.groupBy(*by).agg(F.count("*").alias("_n"))
    cut = (4.0 * n + 40) / F.col("_n") * SPAN
    near = named.join(sizes, [named[c].eqNullSafe(sizes[c]) for c in by]).drop(*[sizes[c] for c in by]).where(F.col("_u") < cut)
    order = Window.partitionBy(*by).orderBy("_u", key)
    return near.withColumn("_r", F.row_number().over(order)).where(F.col("_r") <= n).drop("_r", "_u", "_n", *by)


def group_representatives(df: DataFrame, group: str, key: str) -> DataFrame:
    """The row with the smallest key of each group; null groups are left out."""
    least = df.where(F.col(group).isNotNull()).groupBy(group).agg(F.min(key).alias(key))
    return df.join(least, [group, key], "left_semi")


def hash_folds(df: DataFrame, group: str, folds: int, seed: str | int) -> DataFrame:
    """df with fold, the same for all rows of a group, by hash."""
    return df.withColumn("fold", (hash_u(F.col(group), seed) % folds).cast("int"))


def stratified_group_folds(df: DataFrame, key: str, group: str, label: str, folds: int, seed: int = 42) -> DataFrame:
    """(key, fold): groups stay together and every fold has nearly the same label mix.

    Groups are ordered by hash within their commonest label and laid end to end
    by running sums; the fold is where a group's middle falls, the starts of
    the labels staggered.
    """
    from ticketloom.operators.running import running_sum

    rows = df.select(key, F.col(group).alias("_g"), F.coalesce(F.col(label).cast("string"), F.lit("<missing>")).alias("_l"))
    counts = rows.groupBy("_g", "_l").count().groupBy("_g").agg(F.sum("count").alias("size"), F.max(F.struct("count", "_l")).alias("top"))
    groups = counts.select("_g", "size", F.col("top._l").alias("stratum"), F.xxhash64(F.lit(seed), F.col("_g").cast("string")).alias("dice"))
    run = running_sum(groups, "size", "stratum", ["dice", "_g"])
    whole = groups.groupBy("stratum").agg(F.sum("size").alias("whole"))
    at = (F.col("running") - F.col("size") / 2) / F.col("whole") * folds
    placed = run.join(F.broadcast(whole), "stratum").select("_g", F.least(F.floor(at), F.lit(folds - 1)).cast("int").alias("fold"))
    return rows.join(placed, rows["_g"].eqNullSafe(placed["_g"])).select(key, "fold")


def leaking_groups(df: DataFrame, group: str, part: str) -> DataFrame:
    """Groups found in more than one part."""
    return df.where(F.col(group).isNotNull()).groupBy(group).agg(F.count_distinct(part).alias("parts")).where("parts > 1")


def group_bootstrap(contributions: DataFrame, values: list[str], draws: int, seed: int = 42) -> DataFrame:
    """(iteration, <values>): sums of per-group contributions over multinomial draws of groups, as many as there are.

    Groups with equal contributions are counted together first, so a draw is
    one multinomial over few kinds and its cost does not grow with the groups;
    ValueError beyond MOST_KINDS of them, which the driver and every task hold.
    Each iteration has a random stream of its own, so partitioning changes nothing.
    """
    spark = contributions.sparkSession
    kinds = contributions.groupBy(*values).agg(F.count("*").alias("_k")).orderBy(*values).limit(MOST_KINDS + 1).collect()
    if len(kinds) > MOST_KINDS:
        raise ValueError(f"more than {MOST_KINDS} different contributions")
    table = np.array([[r[v] for v in values] for r in kinds], float).reshape(-1, len(values))
    n = np.array([r["_k"] for r in kinds], float)
    known = spark.sparkContext.broadcast((table, n))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table, n = known.value
        for b in batches:
            its = b.column(0).to_numpy()
            out = np.zeros((len(its), table.shape[1]))
            for i, it in enumerate(its):
                if len(n):
                    out[i] = np.random.default_rng([seed, int(it)]).multinomial(int(n.sum()), n / n.sum()) @ table
            yield pa.RecordBatch.from_arrays([b.column(0), *[pa.array(out[:, j]) for j in range(out.shape[1])]], names=["iteration", *values])

    return spark.range(draws).mapInArrow(run, "iteration bigint, " + ", ".join(f"`{v}` double" for v in values))


def hash_bootstrap(df: DataFrame, index: str, value: str, draws: int, seed: str | int, strata: list[str] | None = None) -> DataFrame:
    """(iteration, strata, mean): paired bootstrap means; draw j of iteration i takes the row of index hash mod n, for small tables.

    index runs from 0 to n - 1 in each stratum; the same draws serve every table with the same seed.
    """
    strata = strata or []
    sizes = df.groupBy(*strata).agg(F.count("*").alias("n"))
    its = df.sparkSession.range(draws).select(F.col("id").alias("iteration"))
    slots = its.crossJoin(sizes).withColumn("j", F.explode(F.sequence(F.lit(0).cast("bigint"), F.col("n") - 1)))
    drawn = slots.withColumn(index, hash_u(F.concat_ws("-", *strata, "iteration", "j"), seed) % F.col("n"))
    return drawn.join(df.select(*strata, index, value), [*strata, index]).groupBy("iteration", *strata).agg(F.avg(value).alias("mean"))


def nested_extension(pool: DataFrame, reference: DataFrame, key: str, strata: str, per_stratum: int, seed: str | int) -> DataFrame:
    """(key, strata, origin): the reference rows and as many others of each stratum as it lacks to per_stratum."""
    ref = pool.join(reference.select(key), key, "left_semi").select(key, strata, F.lit("reference").alias("origin"))
    have = ref.groupBy(strata).agg(F.count("*").alias("have"))
    order = Window.partitionBy(strata).orderBy(hash_u(F.col(key), seed), key)
    rest = pool.join(reference.select(key), key, "left_anti").withColumn("r", F.row_number().over(order)).join(have, strata, "left")
    return ref.unionByName(rest.where(F.col("r") <= per_stratum - F.coalesce("have", F.lit(0))).select(key, strata, F.lit("extension").alias("origin")))
