"""Windows and de-duplication over an event stream; the same functions serve batch tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ticketloom.functions import text as T


def read_events(spark: SparkSession, path: str, schema, files_per_trigger: int = 1) -> DataFrame:
    """A stream of the Parquet files that appear in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(path)


def _timed(df: DataFrame, time: str, late: str | None) -> DataFrame:
    out = df.withColumn(time, F.col(time).cast("timestamp"))
    return out.withWatermark(time, late) if late and out.isStreaming else out


def tumbling(df: DataFrame, time: str, key: str, value: str, length: str = "1 hour", late: str | None = "2 hours") -> DataFrame:
    """(start, key, events, total) per window; on a stream, rows later than late are dropped."""
    w = _timed(df, time, late).groupBy(F.window(time, length), key).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "events", "total")


def sliding(df: DataFrame, time: str, key: str, value: str, length: str = "6 hours", step: str = "3 hours", late: str | None = "2 hours") -> DataFrame:
    w = _timed(df, time, late).groupBy(F.window(time, length, step), key).agg(F.count("*").alias("events"), F.sum(value).alias("total"))
    return w.select(F.col("window.start").alias("start"), key, "events", "total")


def sessions(df: DataFrame, time: str, key: str, gap: str = "30 minutes", late: str | None = "2 hours") -> DataFrame:
    """(key, start, end, events): runs of events of a key less than gap apart."""
    w = _timed(df, time, late).groupBy(F.session_window(time, gap), key).agg(F.count("*").alias("events"))
    return w.select(key, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "events")


def distinct_texts(df: DataFrame, time: str, text: str, late: str = "1 day") -> DataFrame:
    """df with key, the digest of the text's comparison form; a text that comes again within late is dropped."""
    keyed = _timed(df, time, late).withColumn("key", T.group_key(T.comparison_form(F.col(text))))
    return keyed.dropDuplicatesWithinWatermark(["key"]) if keyed.isStreaming else keyed.dropDuplicates(["key"])


def run_once(stream: DataFrame, path: str, checkpoint: str, mode: str = "append") -> None:
    """All that is there now, into Parquet; started again, it goes on where it stopped."""
    stream.writeStream.format("parquet").outputMode(mode).option("path", path).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
