"""Statistics over DataFrames."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ratio(a: Column, b: Column) -> Column:
    """a / b, 0 where b is 0 or either is null."""
    return F.coalesce(F.try_divide(a.cast("double"), b.cast("double")), F.lit(0.0))


def contingency(df: DataFrame, row: str, col: str) -> DataFrame:
    """(r, c, n, expected) of the full table of values that occur; rows with a null in either are left out."""
    counted = df.where(F.col(row).isNotNull() & F.col(col).isNotNull()).groupBy(F.col(row).alias("r"), F.col(col).alias("c")).agg(F.count("*").alias("n"))
    grid = counted.select("r").distinct().crossJoin(F.broadcast(counted.select("c").distinct())).join(counted, ["r", "c"], "left").fillna(0, ["n"])
    of = lambda *k: F.sum("n").over(Window.partitionBy(*k)) if k else F.sum("n").over(Window.partitionBy(F.lit(1)))
    return grid.select("r", "c", "n", (of("r") * of("c") / of()).alias("expected"))


def _even_tail(x: Column, dof: Column) -> Column:
    """P(chi2 > x) for even degrees of freedom, in closed form."""
    half = x / 2
    step = F.aggregate(
        F.sequence(F.lit(1), F.greatest((dof / 2).cast("int") - 1, F.lit(1))),
        F.struct(F.lit(1.0).alias("term"), F.lit(1.0).alias("sum")),
        lambda a, i: F.when(i < dof / 2, F.struct((a["term"] * half / i).alias("term"), (a["sum"] + a["term"] * half / i).alias("sum"))).otherwise(a),
        lambda a: a["sum"],
    )
    return F.least(F.lit(1.0), F.exp(-half) * step)


def association(table: DataFrame) -> DataFrame:
    """One row from contingency(): chi2, dof, p (null for odd dof), cramers_v (bias-corrected), min_expected, small_cells.

    Without Yates' correction: the target has three classes or more. An empty
    or one-valued table has dof 0, p 1 and cramers_v 0.
    """
    s = table.agg(
        F.sum(F.when(F.col("expected") > 0, (F.col("n") - F.col("expected")) ** 2 / F.col("expected")).otherwise(0.0)).alias("chi2"),
        F.sum("n").alias("total"), F.count_distinct("r").alias("rows"), F.count_distinct("c").alias("cols"), F.min("expected").alias("min_expected"), F.avg((F.col("expected") < 5).cast("double")).alias("small_cells"),
    ).fillna(0.0, ["chi2"])
    s = s.withColumn("dof", F.greatest(F.col("rows") - 1, F.lit(0)) * F.greatest(F.col("cols") - 1, F.lit(0)))
    n1 = F.greatest(F.col("total") - 1, F.lit(1))
    phi = F.greatest(F.lit(0.0), ratio(F.col("chi2"), F.col("total")) - F.col("dof") / n1)
    rc, cc = F.col("rows") - (F.col("rows") - 1) ** 2 / n1, F.col("cols") - (F.col("cols") - 1) ** 2 / n1
    v = F.sqrt(ratio(phi, F.greatest(F.least(rc, cc) - 1, F.lit(0.0))))
    p = F.when(F.col("dof") <= 0, F.lit(1.0)).when(F.col("dof") % 2 == 0, _even_tail(F.col("chi2"), F.col("dof")))
    return s.select("chi2", "dof", p.alias("p"), v.alias("cramers_v"), "min_expected", "small_cells")


def holm(df: DataFrame, p: str, partition: list[str] | None = None, tie: list[str] | None = None, out: str = "p_holm") -> DataFrame:
    """df with Holm's step-down adjusted p; ties go by tie. One family per partition; families are small."""
    keys = [F.col(c) for c in partition or []] or [F.lit(1)]
    order = Window.partitionBy(*keys).orderBy(p, *(tie or []))
    m = F.count("*").over(Window.partitionBy(*keys))
    raw = df.withColumn("_raw", (m - F.row_number().over(order) + 1) * F.col(p))
    return raw.withColumn(out, F.least(F.lit(1.0), F.max("_raw").over(order.rowsBetween(Window.unboundedPreceding, 0)))).drop("_raw")


def average_rank(df: DataFrame, value: str, partition: list[str], out: str) -> DataFrame:
    """df with the rank of value in its partition, ties as their average."""
    by = Window.partitionBy(*partition).orderBy(value)
    same = Window.partitionBy(*partition, value)
    return df.withColumn(out, F.rank().over(by) + (F.count("*").over(same) - 1) / 2.0)


def spearman(df: DataFrame, x: str, y: str, keys: list[str]) -> DataFrame:
    """(keys, spearman, n) per key; null where a side is constant."""
    ranked = average_rank(average_rank(df.where(F.col(x).isNotNull() & F.col(y).isNotNull()), x, keys, "_rx"), y, keys, "_ry")
    return ranked.groupBy(*keys).agg(F.corr("_rx", "_ry").alias("spearman"), F.count("*").alias("n"))
