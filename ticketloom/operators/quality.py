"""Data-quality audit: profiles, signals, duplicates, leakage, exclusions, language decisions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions import text as T
from ticketloom.functions.stats import ratio


def value_distribution(df: DataFrame, column: str, missing: str = "<Missing>") -> DataFrame:
    """(value, records, share); null is a value of its own."""
    counted = df.groupBy(F.coalesce(F.col(column).cast("string"), F.lit(missing)).alias("value")).agg(F.count("*").alias("records"))
    whole = counted.agg(F.sum("records").alias("whole"))
    return counted.crossJoin(F.broadcast(whole)).select("value", "records", (F.col("records") / F.col("whole")).alias("share"))


def column_profile(df: DataFrame, columns: list[str]) -> DataFrame:
    """(variable, distinct_values, missing, blank, missing_share) per column, in one pass and an unpivot."""
    aggs = [F.count("*").alias("rows")]
    for c in columns:
        blank = F.trim(F.col(c).cast("string")) == ""
        aggs += [F.count_distinct(F.col(c)).alias(f"d_{c}"), F.sum(F.col(c).isNull().cast("bigint")).alias(f"m_{c}"), F.sum(F.coalesce(blank, F.lit(False)).cast("bigint")).alias(f"b_{c}")]
    row = df.agg(*aggs)
    rows = F.explode(F.array(*[F.struct(F.lit(c).alias("variable"), F.col(f"d_{c}").alias("distinct_values"), F.coalesce(f"m_{c}", F.lit(0)).alias("missing"), F.coalesce(f"b_{c}", F.lit(0)).alias("blank"), ratio(F.col(f"m_{c}"), F.col("rows")).alias("missing_share")) for c in columns]))
    return row.select(rows.alias("s")).select("s.*")


def text_summary(df: DataFrame, columns: list[str]) -> DataFrame:
    """(field, empty, chars_median, chars_p95, chars_max, words_median, words_p95, words_max) per text column."""
    views = F.explode(F.array(*[F.struct(F.lit(c).alias("field"), T.or_empty(F.col(c)).alias("t")) for c in columns])).alias("v")
    rows = df.select(views).select("v.field", F.length("v.t").alias("chars"), T.word_count(F.col("v.t")).alias("words"), (F.regexp_replace("v.t", r"[\s\u00a0]", "") == "").alias("empty"))
    stats = [F.expr(f"percentile({c}, {q})").alias(f"{c}_{n}") for c in ("chars", "words") for q, n in ((0.5, "median"), (0.95, "p95"))]
    return rows.groupBy("field").agg(F.sum(F.col("empty").cast("bigint")).alias("empty"), *stats, F.max("chars").alias("chars_max"), F.max("words").alias("words_max"))


def signals(text: Column) -> dict[str, Column]:
    """Predicates on a raw text; null counts as empty."""
    t = T.or_empty(text)
    n, w = F.length(F.trim(t)), T.word_count(t)
    return {
        "placeholder": F.trim(t).rlike(T.PLACEHOLDER), "very_short": n.between(1, 20), "short": n.between(21, 40), "missing_whitespace": (w <= 2) & (n > 40),
        "url": t.rlike(T.URL_SIGNAL), "email": t.rlike(T.EMAIL), "markup": t.rlike(T.MARKUP), "stack_trace": t.rlike(T.STACK_TRACE), "literal_escape": t.rlike(T.LITERAL_ESCAPE),
    }


def indicator_counts(df: DataFrame, predicates: dict[str, Column]) -> DataFrame:
    """(indicator, records, share) of rows for which each predicate holds, in one pass."""
    row = df.agg(F.count("*").alias("_rows"), *[F.coalesce(F.sum(p.cast("bigint")), F.lit(0)).alias(k) for k, p in predicates.items()])
    out = F.explode(F.array(*[F.struct(F.lit(k).alias("indicator"), F.col(k).alias("records"), ratio(F.col(k), F.col("_rows")).alias("share")) for k in predicates]))
    return row.select(out.alias("s")).select("s.*")


def first_match(cases: list[tuple[Column, str]], otherwise: str) -> Column:
    """The label of the first case that holds; a null condition doesn't."""
    return reduce(lambda out, c: F.when(c[0], F.lit(c[1])).otherwise(out), reversed(cases), F.lit(otherwise))


def duplicate_groups(df: DataFrame, key: Column, target: str) -> DataFrame:
    """(group_key, records, distinct_targets) of keys that come more than once; empty and null keys form no group."""
    return df.select(key.alias("group_key"), F.col(target).alias("_t")).where("group_key is not null and group_key <> ''").groupBy("group_key").agg(F.count("*").alias("records"), F.count_distinct("_t").alias("distinct_targets")).where("records > 1")


def repeated_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """(groups, records): equal rows over columns, nulls equal, and how many rows they are."""
    counted = df.groupBy(*columns).agg(F.count("*").alias("n")).where("n > 1")
    return counted.agg(F.count("*").alias("groups"), F.coalesce(F.sum("n"), F.lit(0)).alias("records"))


def leakage_flags(df: DataFrame, answer: str, body: str, least: int = 20, coverage: float = 0.70) -> DataFrame:
    """df with exact, contained, coverage and leak: the answer repeats the prompt, wholly or for the most part."""
    a, b = T.comparison_form(F.col(answer)), T.comparison_form(F.col(body))
    out = df.withColumns({"_a": a, "_b": b})
    out = out.withColumn("exact", (F.col("_a") == F.col("_b")) & (F.col("_a") != ""))
    inside = ((F.length("_a") >= least) & F.col("_b").contains(F.col("_a"))) | ((F.length("_b") >= least) & F.col("_a").contains(F.col("_b")))
    out = out.withColumn("contained", inside).withColumn("coverage", ratio(F.length("_a"), F.length("_b")))
    return out.withColumn("leak", F.col("exact") | (F.col("contained") & (F.col("coverage") >= coverage))).drop("_a", "_b")


def threshold_sweep(flags: DataFrame, thresholds: list[float]) -> DataFrame:
    """(threshold, records) of contained rows whose coverage reaches each threshold; one pass."""
    row = flags.agg(*[F.coalesce(F.sum((F.col("exact") | (F.col("contained") & (F.col("coverage") >= t))).cast("bigint")), F.lit(0)).alias(f"t{i}") for i, t in enumerate(thresholds)])
    return row.select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("threshold"), F.col(f"t{i}").alias("records")) for i, t in enumerate(thresholds)])).alias("s")).select("s.*")


def exclusion_reasons(df: DataFrame, reasons: list[tuple[Column, str]]) -> DataFrame:
    """df with exclusion_reason: the labels of all flags that hold, in order; null where none does."""
    joined = F.concat_ws(" | ", *[F.when(flag, F.lit(label)) for flag, label in reasons])
    return df.withColumn("exclusion_reason", F.when(joined != "", joined))


def language_decisions(
    df: DataFrame, declared: str, detected: str, confidence: str, manual: str, targets: tuple[str, ...] = ("de", "en"), confident: float = 0.80, certain: float = 0.99,
) -> DataFrame:
    """df with final_language, corrected and language_scope: a reviewer outranks the detector, which outranks the label if confident."""
    target = lambda c: F.coalesce(F.col(c).isin(*targets), F.lit(False))
    sure = F.coalesce(F.col(confidence) >= confident, F.lit(False))
    final = F.when(F.col(manual).isNotNull(), F.col(manual)).when(sure & target(detected), F.col(detected)).otherwise(F.col(declared))
    scope = first_match([
        (F.col(manual).isNotNull() & target(manual), "manual_target_retained"), (F.col(manual).isNotNull(), "manual_non_target_excluded"),
        (~target(detected) & F.coalesce(F.col(confidence) >= certain, F.lit(False)), "certain_non_target_excluded"), (~sure, "low_confidence_label_retained"),
        (F.coalesce(F.col(detected) != F.col(declared), F.lit(True)), "confident_mismatch_retained"),
    ], "confident_match_retained")
    return df.withColumn("final_language", final).withColumn("corrected", F.coalesce(F.col("final_language") != F.col(declared), F.col("final_language").isNotNull())).withColumn("language_scope", scope)


def artifact_counts(df: DataFrame, before: Column, after: Column) -> DataFrame:
    """(stage, artifact, records) of texts with each kind of artifact before and after normalization."""
    kinds = {"literal_escape": T.LITERAL_ESCAPE, "break_tag": r"(?i)<br\s*/?>", "entity": r"&(?:nbsp|amp|lt|gt|quot|#\d{1,6});", "url": T.URL, "email": T.EMAIL, "double_space": r"\s\s"}
    stages = [indicator_counts(df, {k: T.or_empty(c).rlike(v) for k, v in kinds.items()}).select(F.lit(name).alias("stage"), F.col("indicator").alias("artifact"), "records") for name, c in (("before", before), ("after", after))]
    return stages[0].unionByName(stages[1])


def angle_tokens(df: DataFrame, key: str, text: Column) -> DataFrame:
    """(token, records, occurrences) of tokens in angle brackets, in one pass."""
    found = df.select(F.col(key).alias("k"), F.explode(F.regexp_extract_all(T.or_empty(text), F.lit(T.ANGLE_TOKEN), F.lit(0))).alias("t"))
    return found.groupBy(F.lower("t").alias("token")).agg(F.count_distinct("k").alias("records"), F.count("*").alias("occurrences"))


def tag_frequency(df: DataFrame, tags: list[str]) -> DataFrame:
    """(tag, records, share) over all tag columns; null tags are dropped."""
    long = df.select(F.explode(F.array(*tags)).alias("tag")).where("tag is not null")
    return value_distribution(long, "tag").withColumnRenamed("value", "tag")


def filled_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    """(filled, records): how many rows have so many of the columns."""
    filled = reduce(lambda a, b: a + b, [F.col(c).isNotNull().cast("int") for c in columns])
    return df.groupBy(filled.alias("filled")).agg(F.count("*").alias("records"))


def crosstab(df: DataFrame, row: str, col: str, values: list[str], shares: bool = False) -> DataFrame:
    """A row per value of row, a column per listed value of col; shares of the row if asked."""
    out = df.groupBy(F.coalesce(F.col(row).cast("string"), F.lit("<Missing>")).alias(row)).pivot(col, values).count().fillna(0, values)
    if not shares:
        return out
    total = reduce(lambda a, b: a + b, [F.col(v) for v in values])
    return out.select(row, *[ratio(F.col(v), total).alias(v) for v in values])


def group_audit(df: DataFrame, key: str, joined: list[str], sep: str = " | ") -> DataFrame:
    """(key, records, n_<c>, <c>_values): sizes, distinct counts and the sorted distinct values of each column, per group."""
    aggs = [F.count("*").alias("records")]
    for c in joined:
        aggs += [F.count_distinct(F.col(c)).alias(f"n_{c}"), F.concat_ws(sep, F.array_sort(F.collect_set(F.col(c).cast("string")))).alias(f"{c}_values")]
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(*aggs)


def conflicts(df: DataFrame, key: str, target: str) -> DataFrame:
    """(key, records, distinct_targets) of groups with more than one target."""
    return df.where(F.col(key).isNotNull()).groupBy(key).agg(F.count("*").alias("records"), F.count_distinct(F.col(target)).alias("distinct_targets")).where("distinct_targets > 1")


def latest_per_key(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a total order."""
    return df.withColumn("_r", F.row_number().over(Window.partitionBy(*key).orderBy(*order))).where("_r = 1").drop("_r")
