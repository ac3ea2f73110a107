"""Tables from files, with declared schemas."""

from __future__ import annotations

import json
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructType

# Spellings of a missing value in text files, beside the empty field.
MISSING = ("NA", "N/A", "n/a", "null", "NULL", "nan", "NaN", "None", "<NA>", "#N/A")


def read_csv(spark: SparkSession, path: str, schema: StructType | str, normalize_missing: bool = True, sep: str = ",") -> DataFrame:
    """A CSV file with header: fields may be quoted, hold line breaks and double their quotes; a byte-order mark is skipped.

    Malformed rows and rows of another width raise. With normalize_missing,
    the spellings of MISSING are null in text columns; an empty field is null.
    """
    df = spark.read.schema(schema).option("header", True).option("multiLine", True).option("quote", '"').option("escape", '"').option("sep", sep).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)
    if normalize_missing:
        df = df.withColumns({f.name: F.when(~F.trim(F.col(f.name)).isin(*MISSING), F.col(f.name)) for f in df.schema.fields if isinstance(f.dataType, StringType)})
    return df


def read_parquet(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    return (spark.read if schema is None else spark.read.schema(schema)).parquet(path)


def read_manifest(path: str) -> dict:
    """A JSON object of the driver's file system; ValueError if it is none."""
    out = json.loads(Path(path).read_text(encoding="utf-8-sig"))
    if not isinstance(out, dict):
        raise ValueError(f"{path} holds no object")
    return out


def read_json_lines(spark: SparkSession, path: str, schema: StructType | str) -> DataFrame:
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def read_vectors(spark: SparkSession, path: str, id_col: str, vector_col: str, tolerance: float = 1e-4) -> DataFrame:
    """Parquet vectors beside their ids; ValueError if one is not of length 1."""
    from ticketloom.operators.similarity import unit_norm_violations

    df = spark.read.parquet(path).select(id_col, vector_col)
    if (n := unit_norm_violations(df, vector_col, tolerance).first()["violations"]):
        raise ValueError(f"{n} vectors are not of length 1")
    return df


def read_model(path: str):
    """A saved pipeline of Spark ML."""
    from pyspark.ml import PipelineModel

    return PipelineModel.load(path)
