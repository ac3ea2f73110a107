"""Sparse text and category features in long form: (id, feature, value)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ticketloom.functions.text import or_empty

# A short default of English and German stop words; pass a longer list where one is at hand.
STOP_WORDS = tuple("a an and are as at be by das dem den der des die ein eine es for from ich im in is ist it mit nicht not of on or sich sie that the this to und von we wir with zu".split())


def default_stop_words() -> list[str]:
    """Spark's own English and German lists, sorted; needs a session."""
    from pyspark.ml.feature import StopWordsRemover

    return sorted({*StopWordsRemover.loadDefaultStopWords("english"), *StopWordsRemover.loadDefaultStopWords("german")})


def tokens(text: Column, stop_words: tuple[str, ...] = STOP_WORDS) -> Column:
    """Lower-case words of two or more characters, stop words removed, repeats kept."""
    found = F.regexp_extract_all(F.lower(or_empty(text)), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(*stop_words)) if stop_words else found


def _run_at(words: Column, n: int):
    return lambda i: F.array_join(F.slice(words, i, n), " ")


def _gram_at(text: Column, n: int):
    return lambda i: F.substring(text, i, F.lit(n))


def word_ngrams(words: Column, low: int = 1, high: int = 2) -> Column:
    """All runs of low to high words, joined by a space; words should be a column, since an expression would be evaluated for each run."""
    parts = [words] if low <= 1 <= high else []
    for n in range(max(2, low), high + 1):
        last = F.size(words) - n
        parts.append(F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last + 1, F.lit(1))), _run_at(words, n))).otherwise(F.array().cast("array<string>")))
    return F.flatten(F.array(*parts))


def char_wb_ngrams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams inside each blank-separated word padded by one blank; a shorter word counts once, at the shortest n it falls short of."""
    words = F.filter(F.split(F.lower(or_empty(text)), r"\s+"), lambda w: w != "")

    def grams(w: Column) -> Column:
        padded = F.concat(F.lit(" "), w, F.lit(" "))
        out = []
        for n in range(low, high + 1):
            #: A word shorter than n was given whole at the n before, if that was in range.
            whole = F.when((F.length(padded) < n) & (F.length(padded) < low) & F.lit(n == low), F.array(padded)).otherwise(F.array().cast("array<string>"))
            out.append(F.when(F.length(padded) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), _gram_at(padded, n))).otherwise(whole))
        return F.flatten(F.array(*out))

    return F.flatten(F.transform(words, grams))


def term_counts(df: DataFrame, id_col: str, items: Column) -> DataFrame:
    """(id, feature, value): how often each item comes in a row's list."""
    return df.where(F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), F.explode(items).alias("feature")).groupBy("id", "feature").agg(F.count("*").cast("double").alias("value"))


def vocabulary(counts: DataFrame, min_df: int = 2, most: int | None = None) -> DataFrame:
    """(feature, df, total) of features in min_df rows at least, the most frequent ones; ties by feature."""
    seen = counts.groupBy("feature").agg(F.count("*").alias("df"), F.sum("value").alias("total")).where(F.col("df") >= min_df)
    return seen if most is None else seen.orderBy(F.desc("total"), "feature").limit(most)


def tfidf(counts: DataFrame, vocab: DataFrame, rows: int | Column) -> DataFrame:
    """(id, feature, value): (1 + ln tf) * (ln((1 + n) / (1 + df)) + 1), rows of length 1; n is the fitted number of rows."""
    n = F.lit(rows) if isinstance(rows, int) else rows
    raw = counts.join(vocab.select("feature", "df"), "feature").select("id", "feature", ((1 + F.log("value")) * (F.log((1 + n) / (1 + F.col("df"))) + 1)).alias("w"))
    #: A row's features are brought together once, which is no more than its text was.
    rows = raw.groupBy("id").agg(F.sqrt(F.sum(F.col("w") ** 2)).alias("norm"), F.collect_list(F.struct("feature", "w")).alias("f"))
    return rows.select("id", "norm", F.explode("f").alias("f")).select("id", "f.feature", F.try_divide("f.w", "norm").alias("value"))


def one_hot(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, feature, value): column=value as 1; nulls give none. Joined to a fitted vocabulary, unknown values vanish."""
    pairs = F.explode(F.array(*[F.when(F.col(c).isNotNull(), F.concat(F.lit(c + "="), F.col(c).cast("string"))) for c in columns])).alias("feature")
    return df.select(F.col(id_col).alias("id"), pairs).where("feature is not null").select("id", "feature", F.lit(1.0).alias("value"))


def numeric(df: DataFrame, id_col: str, columns: list[str]) -> DataFrame:
    """(id, feature, value) of numeric columns as they are; nulls give none."""
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in columns])).alias("p")
    return df.select(F.col(id_col).alias("id"), pairs).select("id", "p.*").where("value is not null")


def union(**parts: DataFrame) -> DataFrame:
    """All parts, each feature with the part's name before it."""
    out = None
    for name, part in parts.items():
        named = part.select("id", F.concat(F.lit(name + ":"), "feature").alias("feature"), "value")
        out = named if out is None else out.unionByName(named)
    return out


def chi2_scores(values: DataFrame, labels: DataFrame, id_col: str, label: str) -> DataFrame:
    """(feature, chi2): squared deviation of each class' share of a feature's mass from the class' share of rows, over the expected mass."""
    y = labels.where(F.col(label).isNotNull()).select(F.col(id_col).alias("id"), F.col(label).alias("y"))
    share = y.groupBy("y").agg(F.count("*").alias("k")).withColumn("share", F.col("k") / F.sum("k").over(Window.partitionBy(F.lit(1))))  # a row per class
    observed = values.join(y, "id").groupBy("feature", "y").agg(F.sum("value").alias("o"))
    mass = observed.groupBy("feature").agg(F.sum("o").alias("mass"), F.sum(F.lit(0.0)).alias("_z"))
    #: Classes in which a feature is absent still count: sum over classes of (o - e)^2 / e = sum o^2 / e - mass.
    got = observed.join(F.broadcast(share), "y").groupBy("feature").agg(F.sum(F.col("o") ** 2 / F.col("share")).alias("q"))
    return got.join(mass, "feature").select("feature", (F.col("q") / F.col("mass") - F.col("mass")).alias("chi2"))


def select_k(scores: DataFrame, k: int) -> DataFrame:
    """The k features of the highest score; ties by feature."""
    return scores.orderBy(F.desc(F.round("chi2", 6)), "feature").limit(k)


def select_percentile(scores: DataFrame, percent: float) -> DataFrame:
    """The given percent of features, rounded up, by score; ties by feature."""
    return select_k(scores, -(-int(scores.count() * percent) // 100))


#: Features that a vector may have: the driver holds their names and every task their places.
WIDEST = 1 << 20


def to_vectors(values: DataFrame, vocab: DataFrame, ids: DataFrame | None = None) -> tuple[DataFrame, list[str]]:
    """(id, features) as sparse vectors over the vocabulary in the order of its names, for estimators; ValueError beyond WIDEST features.

    With ids, a column id, each of them has a vector, one of zeros without a known feature.
    """
    from pyspark.ml.linalg import SparseVector, VectorUDT

    names = [r["feature"] for r in vocab.select("feature").orderBy("feature").limit(WIDEST + 1).collect()]
    if len(names) > WIDEST:
        raise ValueError(f"more than {WIDEST} features")
    spark = values.sparkSession
    index = spark.createDataFrame([(n, i) for i, n in enumerate(names)], "feature string, i int")
    size = len(names)
    make = F.udf(lambda pairs: SparseVector(size, [(p["i"], p["value"]) for p in pairs or []]), VectorUDT())
    packed = values.join(F.broadcast(index), "feature").groupBy("id").agg(F.array_sort(F.collect_list(F.struct("i", "value"))).alias("pairs"))
    if ids is not None:
        packed = ids.where("id is not null").select("id").distinct().join(packed, "id", "left")
    return packed.select("id", make("pairs").alias("features")), names
