"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ticketloom.llm.tokens import FOLDER, NAME, token_counts
from ticketloom.operators.running import running_sum
from ticketloom.session import written


def mix(
    documents: DataFrame, targets: DataFrame, total_tokens: int | None = None, id_col: str = "doc_id", source_col: str = "source", text_col: str = "text",
    seed: int = 42, folder: str = FOLDER, name: str = NAME,
) -> DataFrame:
    """(id_col, source, tokens, uses): how often each document of a listed source is used; 0 for those left out.

    Every use of a document has a virtual finish time: the tokens of its source
    up to and including it, in shuffled order and round after round, over the
    target weight. All uses are sorted by that time over the whole corpus and
    taken while they fit the total. total_tokens None: the largest total at
    which no source with documents runs out, so that the shares are met; with
    a larger one, a source stops at max_repeats and the others go on in
    proportion. Weights of sources without documents go to the others in
    proportion. Documents without a listed source, or without tokens, are not
    used and not in the result; a null id counts as a document. Ties go by
    the shuffle and the id. Sources listed twice count with the sum of the
    shares and the largest cap; null or non-positive weights list nothing.
    """
    spark = documents.sparkSession
    named = documents.select(F.col(id_col).alias("_id"), F.col(source_col).cast("string").alias("_source"), F.col(text_col).alias("_t"))
    goals = targets.where("source is not null and target_share > 0 and max_repeats > 0").groupBy(F.col("source").alias("_source")).agg(F.sum("target_share").alias("_weight"), F.max("max_repeats").alias("_most"))
    counted = written(token_counts(named, ["_id", "_source"], "_t", folder, name), "tokens")
    #: One row per listed source; the targets bound it.
    sums = counted.where("tokens > 0").groupBy("_source").agg(F.sum("tokens").alias("_sum")).join(F.broadcast(goals), "_source")
    have = sums.collect()
    if not have:
        return counted.limit(0).select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "tokens", F.lit(0).cast("bigint").alias("uses"))
    whole = sum(r["_weight"] for r in have)
    budget = min(r["_most"] * r["_sum"] * whole / r["_weight"] for r in have) if total_tokens is None else float(total_tokens)
    goal = spark.createDataFrame([(r["_source"], r["_weight"] / whole, int(r["_most"]), int(r["_sum"])) for r in have], "_source string, _weight double, _most int, _sum bigint")
    usable = counted.where("tokens > 0").withColumn("_dice", F.xxhash64(F.lit(seed), "_id"))
    queue = running_sum(usable, "tokens", "_source", ["_dice", "_id"], out="_own").join(F.broadcast(goal), "_source")
    queue = queue.withColumn("_round", F.explode(F.sequence(F.lit(0), F.col("_most") - 1)))
    queue = queue.withColumn("_finish", (F.col("_round") * F.col("_sum") + F.col("_own")) / F.col("_weight")).withColumn("_all", F.lit(0))
    taken = running_sum(queue, "tokens", "_all", ["_finish", "_source", "_round", "_dice", "_id"], out="_total")
    uses = taken.groupBy("_id", "_source", "tokens").agg(F.sum((F.col("_total") <= F.lit(budget + 1e-6)).cast("bigint")).alias("uses"))
    return written(uses.select(F.col("_id").alias(id_col), F.col("_source").alias("source"), "tokens", "uses"), "uses")


def shares(uses: DataFrame, targets: DataFrame) -> DataFrame:
    """(source, target_share, actual_share, documents, uses, tokens) per listed source, those without documents too."""
    reached = uses.groupBy("source").agg(F.sum((F.col("uses") > 0).cast("bigint")).alias("documents"), F.sum("uses").alias("uses"), F.sum(F.col("uses") * F.col("tokens")).alias("tokens"))
    goals = targets.where("source is not null").groupBy("source").agg(F.sum("target_share").alias("target_share"))
    total = uses.agg(F.sum(F.col("uses") * F.col("tokens")).alias("_total"))
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).alias(c)
    joined = goals.join(reached, "source", "left").crossJoin(F.broadcast(total))
    return joined.select("source", "target_share", F.coalesce(F.try_divide("tokens", "_total"), F.lit(0.0)).alias("actual_share"), zero("documents"), zero("uses"), zero("tokens"))
