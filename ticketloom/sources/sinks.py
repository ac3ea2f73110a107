"""Tables and manifests to files; the committer renames finished output, so readers never see a part."""

from __future__ import annotations

import json
import os
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def write_csv(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    """With header, quotes doubled; nulls and empty strings are empty fields, and are read as null."""
    df.write.mode(mode).option("header", True).option("quote", '"').option("escape", '"').option("emptyValue", "").option("nullValue", "").csv(path)


def write_parquet(df: DataFrame, path: str, mode: str = "errorifexists", partition_by: list[str] | None = None) -> None:
    out = df.write.mode(mode).option("compression", "zstd")
    (out.partitionBy(*partition_by) if partition_by else out).parquet(path)


def write_json_lines(df: DataFrame, path: str, mode: str = "errorifexists") -> None:
    df.write.mode(mode).option("ignoreNullFields", False).json(path)


def replace_table(df: DataFrame, path: str, write: Callable = write_parquet, **options) -> None:
    """df in place of what is at path, by renames: readers see the old table or the new one, and a failure leaves the old one."""
    spark = df.sparkSession
    new, old = (f"{path.rstrip('/')}.{x}-{uuid.uuid4().hex}" for x in ("new", "old"))
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path
    fs = at(path).getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    try:
        write(df, new, **options)
        if fs.exists(at(path)):
            fs.rename(at(path), at(old))
        if not fs.rename(at(new), at(path)):
            fs.rename(at(old), at(path))
            raise OSError(f"{path} can't be replaced")
    finally:
        fs.delete(at(new), True)
    fs.delete(at(old), True)


def write_npy(df: DataFrame, id_col: str, vector_col: str, folder: str) -> DataFrame:
    """(file, rows): vectors of one length as NumPy arrays of 32-bit floats, a file per partition, with the ids in <file>.ids.npy.

    folder is a URI that all executors reach. A file appears under its name
    when it is whole, and a repeated task replaces it. Rows with a null id or
    vector are left out; a partition without rows has no file.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import io

        from pyarrow import fs
        from pyspark import TaskContext

        ids, rows = [], []
        for b in batches:
            ids += b.column(0).to_pylist()
            rows += b.column(1).to_pylist()
        if not rows:
            return
        target, base = fs.FileSystem.from_uri(folder)
        target.create_dir(base, recursive=True)
        name = f"part-{TaskContext.get().partitionId():05d}"
        for suffix, data in (("ids.npy", np.array(ids)), ("npy", np.array(rows, np.float32))):
            held = io.BytesIO()
            np.save(held, data)
            temporary = f"{base}/.{name}.{suffix}-{uuid.uuid4().hex}"
            with target.open_output_stream(temporary) as f:
                f.write(held.getvalue())
            target.move(temporary, f"{base}/{name}.{suffix}")
        yield pa.RecordBatch.from_arrays([pa.array([f"{name}.npy"]), pa.array([len(rows)], pa.int64())], names=["file", "rows"])

    named = df.where(F.col(id_col).isNotNull() & F.col(vector_col).isNotNull()).select(F.col(id_col).alias("id"), F.col(vector_col).cast("array<float>").alias("v"))
    return df.sparkSession.createDataFrame(named.mapInArrow(run, "file string, rows bigint").collect(), "file string, rows bigint")  # a row per partition


def write_manifest(payload: dict, path: str) -> None:
    """JSON with sorted keys, atomically: a temporary file in the same folder is renamed."""
    folder = os.path.dirname(os.path.abspath(path))
    os.makedirs(folder, exist_ok=True)
    handle, temporary = tempfile.mkstemp(dir=folder, suffix=".part")
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            json.dump(payload, f, sort_keys=True, indent=2, ensure_ascii=False)
            f.flush()
            os.fsync(f.fileno())
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


def write_model(model, path: str) -> None:
    model.write().overwrite().save(path)


def plot_data(df: DataFrame, category: str, value: str, limit: int = 15) -> DataFrame:
    """The rows of a bar chart: the largest values first, ties by category; rendering is not part of this library."""
    return df.select(F.col(category).alias("category"), F.col(value).alias("value")).orderBy(F.desc("value"), "category").limit(limit)
