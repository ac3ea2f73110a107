"""Small reshaping, casting, selection and validation operators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.stats import ratio


def band(c: Column, edges: list[float], labels: list[str]) -> Column:
    """The label of the half-open interval [edge, next edge) that holds c; null outside and for null."""
    out = F.lit(None).cast("string")
    for lo, hi, label in zip(edges[:-1], edges[1:], labels):
        out = F.when((c >= lo) & (c < hi), label).otherwise(out)
    return out


def factorize(df: DataFrame, column: str, out: str = "code") -> DataFrame:
    """df with out: the place of the value among the sorted distinct values, from 0; null has none.

    The distinct values are numbered by running sums, so no task sorts all rows.
    """
    from ticketloom.operators.running import running_sum

    values = df.where(F.col(column).isNotNull()).select(F.col(column).alias("_v")).distinct().withColumns({"_one": F.lit(1), "_all": F.lit(0)})
    codes = running_sum(values, "_one", "_all", ["_v"], "_code").select(F.col("_v"), (F.col("_code") - 1).cast("bigint").alias(out))
    return df.join(codes, df[column] == codes["_v"], "left").drop("_v")


def strict_cast(df: DataFrame, column: str, kind: str) -> DataFrame:
    """df with column as kind; ValueError if a value that is there can't be."""
    if not df.where(F.col(column).isNotNull() & F.col(column).try_cast(kind).isNull()).isEmpty():
        raise ValueError(f"{column} has values that are no {kind}")
    return df.withColumn(column, F.col(column).cast(kind))


def lenient_cast(df: DataFrame, column: str, kind: str) -> DataFrame:
    """df with column as kind, null where that can't be."""
    return df.withColumn(column, F.col(column).try_cast(kind))


def wide(df: DataFrame, keys: list[str], name: str, value: str, names: list[str]) -> DataFrame:
    """A row per key and a column per listed name; ValueError if a pair comes twice, null where it is missing."""
    if not df.groupBy(*keys, name).count().where("count > 1").isEmpty():
        raise ValueError(f"{keys} and {name} are not unique")
    return df.groupBy(*keys).pivot(name, names).agg(F.first(value))


def first_joined(df: DataFrame, keys: list[str], order: list[Column], text: str, n: int, out: str, sep: str = "; ") -> DataFrame:
    """(keys, out): the first n texts of each key in a total order, joined."""
    w = Window.partitionBy(*keys).orderBy(*order)
    ranked = df.withColumn("_r", F.row_number().over(w)).where(F.col("_r") <= n)
    pairs = F.array_sort(F.collect_list(F.struct("_r", F.col(text).cast("string").alias("_t"))))
    return ranked.groupBy(*keys).agg(F.array_join(F.transform(pairs, lambda p: p["_t"]), sep).alias(out))


def softmax(df: DataFrame, keys: list[str], score: str, out: str = "probability") -> DataFrame:
    """df with the softmax of score within keys, computed from the differences to the maximum."""
    w = Window.partitionBy(*keys)
    e = df.withColumn("_e", F.exp(F.col(score) - F.max(score).over(w)))
    return e.withColumn(out, F.col("_e") / F.sum("_e").over(w)).drop("_e")


def invalid_probabilities(df: DataFrame, columns: list[str], tolerance: float = 1e-5) -> DataFrame:
    """Rows whose probabilities are not all finite, within 0 and 1, and of sum 1 within tolerance; nulls are invalid."""
    total = sum((F.col(c) for c in columns), F.lit(0.0))
    good = F.abs(total - 1) <= tolerance
    for c in columns:
        good = good & ~F.isnan(c) & F.col(c).between(0, 1)
    return df.where(~F.coalesce(good, F.lit(False)))


def row_normalized(conf: DataFrame, keys: list[str]) -> DataFrame:
    """conf with share: n over the sum of n for the actual class."""
    return conf.withColumn("share", ratio(F.col("n"), F.sum("n").over(Window.partitionBy(*keys, "actual"))))


def best_per_role(metrics: DataFrame, roles: dict[str, Column], order: list[Column]) -> DataFrame:
    """(role, all columns): the first row in order of those each role admits."""
    out = None
    for role, admitted in roles.items():
        row = metrics.where(admitted).orderBy(*order).limit(1).select(F.lit(role).alias("role"), "*")
        out = row if out is None else out.unionByName(row)
    return out


def label_casing(c: Column, labels: list[str]) -> Column:
    """The listed spelling of a label whatever its case; null if it isn't listed."""
    return F.create_map(*[F.lit(x) for v in labels for x in (v.lower(), v)])[F.lower(F.trim(c))]


def thousands(c: Column) -> Column:
    """A whole number with points between groups of three digits."""
    return F.translate(F.format_number(c, 0), ",", ".")


def select_cases(votes: DataFrame, classes: tuple[str, str, str] = ("low", "medium", "high"), most: int = 12) -> DataFrame:
    """(case_no, kind, id, g) of rows to show, each of another group: a group's row of the smallest id.

    votes has id, g, actual, right (models that are right), models, kinds
    (different predictions), and votes_<class>. In this order: right by all
    models, one per class; typical, an outer class taken for the middle one by
    two models or more, where the fewest are right; critical, an outer class
    taken for the other one, by the most models; then disagreement, the most
    different predictions first; then any row. Ties go to the smaller id. A
    job per row shown, of which there are most; no row is lost to a limit.
    """
    low, middle, high = classes
    one = votes.groupBy("g").agg(F.min_by(F.struct(*[c for c in votes.columns if c != "g"]), "id").alias("r")).select("g", "r.*")
    fewest, many = [F.col("right"), F.col("id")], lambda c: [F.desc(f"votes_{c}"), F.desc("kinds"), F.col("id")]
    rules = [(f"unanimous_{c}", (F.col("actual") == c) & (F.col("right") == F.col("models")), [F.col("id")]) for c in classes]
    rules += [(f"typical_{c}", (F.col("actual") == c) & (F.col(f"votes_{middle}") >= 2), fewest) for c in (low, high)]
    rules += [(f"critical_{c}", (F.col("actual") == c) & (F.col(f"votes_{other}") >= 1), many(other)) for c, other in ((low, high), (high, low))]
    rest = [("disagreement", F.col("kinds") > 1, [F.desc("kinds"), *fewest]), ("additional", F.lit(True), [F.col("id")])]
    from ticketloom.session import written

    one = written(one, "cases")
    shown: list[tuple] = []
    while len(shown) < most and (rules or rest):
        kind, admitted, order = rules[0] if rules else rest[0]
        free = one.where(admitted).join(votes.sparkSession.createDataFrame([(g,) for *_, g in shown], "g string"), "g", "left_anti") if shown else one.where(admitted)
        row = free.orderBy(*order).limit(1).collect()
        if row:
            shown.append((len(shown) + 1, kind, row[0]["id"], row[0]["g"]))
        if rules:
            rules.pop(0)
        elif not row:
            rest.pop(0)
    return votes.sparkSession.createDataFrame(shown, "case_no int, kind string, id bigint, g string")
