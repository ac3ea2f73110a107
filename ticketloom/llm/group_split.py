"""Splits that keep related records together and the label mix even."""

from __future__ import annotations

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ticketloom.operators.components import connected_components
from ticketloom.operators.running import running_sum
from ticketloom.session import written

#: So many of the largest sets are placed one by one on the driver; the rest by running sums.
LARGE_SETS = 2048


def entity_id(c: Column) -> Column:
    """The 40 hexadecimal digits of an id in lower case, whatever stands around them; null where there are none."""
    found = F.regexp_extract(F.lower(c.cast("string")), r"(?<![0-9a-z])(?:sha1?[:\-_ ]*)?([0-9a-f]{40})(?![0-9a-z])", 1)
    return F.when(F.length(found) == 40, found)


def related_sets(df: DataFrame, id_col: str, entity_cols: list[str]) -> DataFrame:
    """(id, set_id, e1, e2...): records tied by an equal entity of one column, directly or through others.

    set_id is the smallest record id of the set; e1.. are the entities as the
    smallest record id that has them, null where missing. The bipartite graph
    of records and entities is first folded to the entities of the first
    column (each record has one at most), so that label propagation runs over
    the few entities of other columns that tie two of those together; a hot
    entity is reduced by min(). Null record ids are left out.
    """
    first, *others = entity_cols
    named = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), *[entity_id(F.col(c)).alias(f"k{i}") for i, c in enumerate(entity_cols)]).distinct()
    rows = named
    for i in range(len(entity_cols)):
        least = named.where(f"k{i} is not null").groupBy(f"k{i}").agg(F.min("id").alias(f"e{i + 1}"))
        rows = rows.join(least, f"k{i}", "left")
    rows = written(rows.select("id", *[f"e{i + 1}" for i in range(len(entity_cols))]), "entities")
    #: Vertices: the entity's smallest record, with the column in the low digits; records without an entity of the first column stand for themselves.
    width = len(entity_cols) + 1
    anchor = F.coalesce(F.col("e1") * width + 1, F.col("id") * width)
    edges = None
    for i in range(1, len(entity_cols)):
        pairs = rows.where(f"e{i + 1} is not null").select(anchor.alias("a"), (F.col(f"e{i + 1}") * width + i + 1).alias("b")).distinct()
        ties = pairs.groupBy("b").agg(F.count("*").alias("ties")).where("ties > 1").select("b")
        pairs = pairs.join(ties, "b").select("a", "b")
        edges = pairs if edges is None else edges.unionByName(pairs)
    if edges is None:
        labelled = rows.withColumn("v", anchor)
    else:
        parts = connected_components(edges)
        labelled = rows.withColumn("a", anchor).join(parts.withColumnRenamed("id", "a"), "a", "left").withColumn("v", F.coalesce("component", "a"))
    lowest = labelled.groupBy("v").agg(F.min("id").alias("set_id"))
    return written(labelled.join(lowest, "v").select("id", "set_id", *[f"e{i + 1}" for i in range(len(entity_cols))]), "sets")


def mixed_sets(df: DataFrame, id_col: str = "record_id", entity_cols: tuple[str, ...] = ("semantic_group_id", "text_group_id")) -> DataFrame:
    """(id_col, set_id) of sets with two or more records that don't all carry one and the same entity of the first column."""
    rows = related_sets(df, id_col, list(entity_cols))
    kinds = rows.groupBy("set_id").agg(F.countDistinct("id").alias("n"), F.min("e1").alias("low"), F.max("e1").alias("high"), F.max(F.col("e1").isNull()).alias("none"))
    wanted = kinds.where((F.col("n") > 1) & (F.col("none") | (F.col("low") != F.col("high")))).select("set_id")
    return rows.join(wanted, "set_id").select(F.col("id").alias(id_col), "set_id").distinct()


def _place(sizes: np.ndarray, shares: np.ndarray, total: np.ndarray) -> tuple[list[int], np.ndarray]:
    """Greedy: each set, the largest first, where the squared deviation from the aims grows least; and what remains of the aims."""
    left = shares[:, None] * total[None, :]
    scale = 1 / np.maximum(total, 1)
    out = []
    for row in sizes:
        cost = (((left - row) * scale) ** 2 - (left * scale) ** 2).sum(axis=1) + ((left.sum(1) - row.sum()) ** 2 - left.sum(1) ** 2) / max(1.0, total.sum()) ** 2
        k = int(np.argmin(cost))
        left[k] -= row
        out.append(k)
    return out, left


def stratified_group_split(
    df: DataFrame, id_col: str = "record_id", label_col: str = "priority", entity_cols: tuple[str, ...] = ("semantic_group_id", "text_group_id"),
    splits: tuple[str, ...] = ("training", "validation", "holdout"), shares: tuple[float, ...] = (0.70, 0.15, 0.15), seed: int = 42,
) -> DataFrame:
    """(id_col, set_id, label, split): one split per record; related records share it and each split has nearly the same label mix.

    Labels are trimmed and lower-cased; null and blank are the label
    <missing>. The LARGE_SETS largest sets are placed one by one where they
    disturb the label counts least. The others, in random order within each
    stratum (their commonest label), are laid end to end and cut where the
    stratum's remaining aims are filled, so a split misses its share of a
    label by about one small set. Ties go by set id. A record id that comes
    twice counts once; an empty table gives an empty one.
    """
    spark = df.sparkSession
    label = F.lower(F.trim(F.col(label_col).cast("string")))
    named = df.where(F.col(id_col).isNotNull()).select(F.col(id_col).cast("bigint").alias("id"), F.when(label != "", label).otherwise("<missing>").alias("label")).groupBy("id").agg(F.min(F.coalesce("label", F.lit("<missing>"))).alias("label"))
    rows = written(related_sets(df, id_col, list(entity_cols)).select("id", "set_id").distinct().join(named, "id"), "labelled").persist(StorageLevel.MEMORY_AND_DISK)
    counts = rows.groupBy("set_id", "label").count().groupBy("set_id").agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("label", "count")))).alias("mix"), F.sum("count").alias("size"), F.max(F.struct("count", "label")).alias("top"))
    sets = written(counts.select("set_id", "mix", "size", F.col("top.label").alias("stratum")), "mixes")
    totals = {r["label"]: r["count"] for r in rows.groupBy("label").count().collect()}  # a row per label
    labels = sorted(totals)
    total = np.array([totals[x] for x in labels], float)
    aims = np.array(shares) / sum(shares)
    large = sets.orderBy(F.desc("size"), "set_id").limit(LARGE_SETS).collect()
    placed, left = _place(np.array([[r["mix"].get(x, 0) for x in labels] for r in large], float).reshape(len(large), len(labels)), aims, total)
    big = spark.createDataFrame([(r["set_id"], splits[k]) for r, k in zip(large, placed)], "set_id bigint, split string")
    small = sets.join(F.broadcast(big.select("set_id")), "set_id", "left_anti")
    #: Each stratum is cut in the proportions that remain; at LARGE_SETS rows the broadcast is bounded.
    left = np.maximum(left, 0)
    fallback = aims
    fractions = [(x, [float(v) for v in np.cumsum((left[:, i] / left[:, i].sum()) if left[:, i].sum() > 0 else fallback)]) for i, x in enumerate(labels)]
    cuts = spark.createDataFrame(fractions, "stratum string, cuts array<double>")
    ordered = small.withColumn("dice", F.xxhash64(F.lit(seed), "set_id"))
    run = running_sum(ordered.select("set_id", "size", "stratum", "dice"), "size", "stratum", ["dice", "set_id"])
    whole = small.groupBy("stratum").agg(F.sum("size").alias("whole"))
    run = run.join(F.broadcast(whole), "stratum").join(F.broadcast(cuts), "stratum")
    #: The middle of the set decides.
    at = (F.col("running") - F.col("size") / 2) / F.col("whole")
    choice = F.lit(splits[-1])
    for i in range(len(splits) - 2, -1, -1):
        choice = F.when(at <= F.col("cuts")[i], splits[i]).otherwise(choice)
    placed_sets = run.select("set_id", choice.alias("split")).unionByName(big)
    out = written(rows.join(placed_sets, "set_id").select(F.col("id").alias(id_col), "set_id", "label", "split"), "split")
    rows.unpersist()
    return out


def split_shares(assigned: DataFrame, splits: tuple[str, ...] = ("training", "validation", "holdout"), shares: tuple[float, ...] = (0.70, 0.15, 0.15)) -> DataFrame:
    """(split, label, records, target_share, actual_share, label_share, label_share_all) per split and label that occurs."""
    spark = assigned.sparkSession
    counted = assigned.groupBy("split", "label").agg(F.count("*").alias("records"))
    per_split = counted.groupBy("split").agg(F.sum("records").alias("in_split"))
    per_label = counted.groupBy("label").agg(F.sum("records").alias("of_label"))
    whole = counted.agg(F.sum("records").alias("whole"))
    aims = spark.createDataFrame(list(zip(splits, shares)), "split string, target_share double")
    out = counted.join(per_split, "split").join(per_label, "label").crossJoin(F.broadcast(whole)).join(F.broadcast(aims), "split", "left")
    return out.select("split", "label", "records", "target_share", (F.col("in_split") / F.col("whole")).alias("actual_share"), (F.col("records") / F.col("in_split")).alias("label_share"), (F.col("of_label") / F.col("whole")).alias("label_share_all"))
