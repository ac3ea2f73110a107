"""Running sums over a global order without one task per group."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.session import written


def running_sum(df: DataFrame, value: str, group: str, order: list[str], out: str = "running") -> DataFrame:
    """df with out: the sum of value over the rows of the same group up to this one in order, itself included.

    The rows are range-partitioned by (group, order), so that a group which
    holds most rows spreads over many tasks; each task sums its own rows, and
    only one total per task and group, a number bounded by tasks plus groups,
    is summed again. order must be a total order in each group. A null group is
    a group of its own; a null value counts as 0; no rows give no rows.
    """
    parts = written(df.repartitionByRange(group, *order).withColumn("_running_part", F.spark_partition_id()), "ranges")
    totals = parts.groupBy("_running_part", group).agg(F.sum(F.coalesce(F.col(value), F.lit(0))).alias("_running_total"))
    before = Window.partitionBy(group).orderBy("_running_part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_running_before", F.coalesce(F.sum("_running_total").over(before), F.lit(0))).select(F.col("_running_part").alias("_running_p"), F.col(group).alias("_running_g"), "_running_before")
    inside = Window.partitionBy("_running_part", group).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    local = parts.withColumn("_running_in", F.sum(F.coalesce(F.col(value), F.lit(0))).over(inside))
    joined = local.join(offsets, (local["_running_part"] == offsets["_running_p"]) & local[group].eqNullSafe(offsets["_running_g"]))
    return joined.withColumn(out, F.col("_running_in") + F.col("_running_before")).drop("_running_part", "_running_in", "_running_before", "_running_p", "_running_g")
