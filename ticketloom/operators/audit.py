"""Guards, content hashes, reuse by signature, and the audit table."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def require(df: DataFrame, columns: Iterable[str], key: list[str] | None = None, rows: int | None = None, not_null: Iterable[str] = ()) -> DataFrame:
    """df if it has the columns, a unique and complete key, the number of rows and no nulls where none may be; else ValueError."""
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"columns are missing: {missing}")
    if rows is not None and (n := df.count()) != rows:
        raise ValueError(f"{n} rows instead of {rows}")
    for c in [*not_null, *(key or [])]:
        if not df.where(F.col(c).isNull()).isEmpty():
            raise ValueError(f"{c} has nulls")
    if key and not df.groupBy(*key).count().where("count > 1").isEmpty():
        raise ValueError(f"{key} is not unique")
    return df


def joined(left: DataFrame, right: DataFrame, on: list[str], how: str = "left", validate: str = "many_to_one") -> DataFrame:
    """A join whose cardinality holds: one_to_one, many_to_one, one_to_many or many_to_many; else ValueError."""
    a, b = validate.split("_to_")
    for side, df, kind in (("left", left, a), ("right", right, b)):
        if kind == "one" and not df.groupBy(*on).count().where("count > 1").isEmpty():
            raise ValueError(f"{on} is not unique on the {side}")
    return left.join(right, on, how)


def mismatches(a: DataFrame, b: DataFrame, key: list[str], columns: list[str], tolerance: float | None = None) -> DataFrame:
    """(column, mismatches): rows of either side whose value differs from the other's, null safe; a missing row differs in all columns."""
    x = a.select(*key, *[F.col(c).alias(f"_a_{c}") for c in columns], F.lit(True).alias("_in_a"))
    y = b.select(*key, *[F.col(c).alias(f"_b_{c}") for c in columns], F.lit(True).alias("_in_b"))
    def differs(c: str) -> Column:
        p, q = F.col(f"_a_{c}"), F.col(f"_b_{c}")
        off = ~p.eqNullSafe(q) if tolerance is None else ~(p.eqNullSafe(q) | F.coalesce(F.abs(p - q) <= tolerance, F.lit(False)))
        return off | F.col("_in_a").isNull() | F.col("_in_b").isNull()
    row = x.join(y, key, "full").agg(*[F.count_if(differs(c)).alias(c) for c in columns])
    return row.select(F.explode(F.array(*[F.struct(F.lit(c).alias("column"), F.col(c).alias("mismatches")) for c in columns])).alias("s")).select("s.*")


def upsert(old: DataFrame, new: DataFrame, key: list[str]) -> DataFrame:
    """old with the rows of new in place of those with the same key; columns that one side lacks are null there."""
    return old.join(new.select(*key).distinct(), key, "left_anti").unionByName(new, allowMissingColumns=True)


def symmetric_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Rows of exactly one side, with side; repeated rows count once."""
    return a.exceptAll(b).distinct().withColumn("side", F.lit("left")).unionByName(b.exceptAll(a).distinct().withColumn("side", F.lit("right")))


def content_hash(df: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, digest): an order-free digest of the rows' values: the sums of 32-bit parts of each row's sha256; nulls differ from blanks."""
    text = F.concat_ws("\x1f", *[F.coalesce(F.col(c).cast("string"), F.lit("\x01")) for c in columns])
    h = F.sha2(text, 256)
    part = lambda i: F.sum(F.conv(F.substring(h, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)"))
    row = df.agg(F.count("*").alias("rows"), *[part(i).alias(f"p{i}") for i in range(4)])
    return row.select("rows", F.sha2(F.concat_ws("-", *[F.coalesce(F.col(f"p{i}").cast("string"), F.lit("0")) for i in range(4)]), 256).alias("digest"))


def payload_hash(payload) -> str:
    """sha256 of canonical JSON: sorted keys, no spaces."""
    return hashlib.sha256(json.dumps(payload, sort_keys=True, separators=(",", ":"), ensure_ascii=False, default=str).encode()).hexdigest()


def reuse(spark: SparkSession, folder: str, name: str, signature, make: Callable[[], DataFrame]) -> DataFrame:
    """The table made for this signature before, or make()'s, written under it: a run resumes where it stopped."""
    path = f"{folder.rstrip('/')}/{name}-{payload_hash(signature)[:24]}"
    jvm = spark.sparkContext._jvm
    done = jvm.org.apache.hadoop.fs.Path(path + "/_SUCCESS")
    if not done.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(done):
        make().write.mode("overwrite").option("compression", "zstd").parquet(path)
    return spark.read.parquet(path)


def check(category: str, name: str, observed: DataFrame, expected, tolerance: float = 0.0) -> DataFrame:
    """(category, check, expected, observed, status) from a one-row, one-column observation; a null observation fails."""
    observed = observed.toDF("_value")
    value = F.col("_value").cast("double")
    ok = F.coalesce(F.abs(value - float(expected)) <= tolerance, F.lit(False))
    return observed.select(F.lit(category).alias("category"), F.lit(name).alias("check"), F.lit(float(expected)).alias("expected"), F.round(value, 9).alias("observed"), F.when(ok, "PASS").otherwise("FAIL").alias("status"))


def audit(checks: list[DataFrame]) -> DataFrame:
    out = checks[0]
    for c in checks[1:]:
        out = out.unionByName(c)
    return out


def review_summary(review: DataFrame, decisions: list[str]) -> DataFrame:
    """(group, reviewed, open, <decisions>, agreed) per review group; agreed: the reviewer names the detector's language."""
    d = F.col("manual_assessment")
    return review.groupBy(F.col("language_review_group").alias("group")).agg(
        F.count_if(F.col("manual_language").isNotNull()).alias("reviewed"), F.count_if(F.col("manual_language").isNull()).alias("open"),
        *[F.count_if(F.coalesce(d == x, F.lit(False))).alias(x) for x in decisions], F.count_if(F.coalesce(F.col("manual_language") == F.col("detected_language"), F.lit(False))).alias("agreed"))


def review_defects(review: DataFrame, allowed: list[str]) -> DataFrame:
    """(defect, records): repeated ids, unknown assessments, confirmed rows without a language, and languages without confirmation."""
    r = review.withColumn("_n", F.lit(1))
    repeated = r.groupBy("review_id").count().where("count > 1").agg(F.count("*").alias("records")).select(F.lit("repeated review_id").alias("defect"), "records")
    flags = {
        "unknown assessment": F.col("manual_assessment").isNotNull() & ~F.col("manual_assessment").isin(*allowed),
        "confirmed without a language": (F.col("author_confirmation") == "confirmed") & F.col("manual_language").isNull(),
        "language without confirmation": F.col("manual_language").isNotNull() & (F.coalesce("author_confirmation", F.lit("")) != "confirmed"),
    }
    row = r.agg(*[F.count_if(F.coalesce(v, F.lit(False))).alias(k) for k, v in flags.items()])
    rest = row.select(F.explode(F.array(*[F.struct(F.lit(k).alias("defect"), F.col(k).alias("records")) for k in flags])).alias("s")).select("s.*")
    return repeated.unionByName(rest)
