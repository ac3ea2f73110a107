"""Session helpers: settings, and tables that cut lineage in the shared folder."""

from __future__ import annotations

import atexit
import os
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_made: list[tuple[SparkSession, str]] = []
_local: list[str] = []


def local_session(cores: str = "*", partitions: int = 8, app: str = "ticketloom", **conf: str) -> SparkSession:
    """A session for one machine; clusters bring their own."""
    builder = (
        SparkSession.builder.master(f"local[{cores}]").appName(app)
        .config("spark.sql.shuffle.partitions", str(partitions))
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.host", "127.0.0.1")
        .config("spark.driver.memory", "8g")
        .config("spark.sql.warehouse.dir", os.path.join(tempfile.gettempdir(), "ticketloom-warehouse"))
    )
    for key, value in conf.items():
        builder = builder.config(key.replace("__", "."), value)
    return builder.getOrCreate()


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; only where it is unset and all runs on this machine, a folder of it.

    The folder must be visible to all executors: a table in it survives the
    loss of any of them. A cluster without one is refused, since tables
    would be spread over its machines.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if not named:
        set_by_context = spark.sparkContext._jsc.sc().getCheckpointDir()
        named = set_by_context.get() if set_by_context.isDefined() else None
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith(("local[", "local-cluster[")):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    if not _local:
        _local.append(tempfile.mkdtemp(prefix="ticketloom-shared-"))
        atexit.register(shutil.rmtree, _local[0], ignore_errors=True)
    return "file://" + _local[0]


def written(df: DataFrame, what: str) -> DataFrame:
    """df as a table in the shared folder: its lineage ends there."""
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/ticketloom-{what}-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    _made.append((spark, path))
    out = spark.read.schema(df.schema).parquet(path)
    out._ticketloom_path = path  # for discard()
    return out


class MappedFiles:
    """Columns as files that all workers map into memory: in the shared folder, or sent to every executor where that is no folder of a file system."""

    def __init__(self, spark: SparkSession, what: str):
        shared = shared_folder(spark)
        self.sent = not shared.startswith(("file:", "/"))
        local = tempfile.mkdtemp(prefix="ticketloom-mapped-") if self.sent else shared.removeprefix("file://").removeprefix("file:")
        self.path = f"{local}/ticketloom-{what}-{uuid.uuid4().hex}"

    def write(self, df: DataFrame) -> None:
        """The binary columns of all rows, one after another; the driver holds a partition at a time."""
        os.makedirs(os.path.dirname(self.path), exist_ok=True)
        files = {c: open(f"{self.path}.{c}", "wb") for c in df.columns}  # noqa: SIM115
        for r in df.toLocalIterator():
            for c, f in files.items():
                f.write(r[c])
        for f in files.values():
            f.close()
            atexit.register(_removed, f.name)
            if self.sent:
                df.sparkSession.sparkContext.addFile(f.name)

    def read(self, column: str, dtype):
        import numpy as np
        from pyspark import SparkFiles

        path = f"{self.path}.{column}"
        path = SparkFiles.get(os.path.basename(path)) if self.sent else path
        return np.memmap(path, dtype, "r") if os.path.getsize(path) else np.zeros(0, dtype)


def _removed(path: str) -> None:
    if os.path.exists(path):
        os.remove(path)


def discard(df: DataFrame | None) -> None:
    """Deletes a table of written() that nothing will read again."""
    path = getattr(df, "_ticketloom_path", None)
    if path:
        _delete(df.sparkSession, path)
        _made[:] = [x for x in _made if x[1] != path]


def _delete(spark: SparkSession, path: str) -> None:
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)


@atexit.register
def _discard_all() -> None:
    for spark, path in _made:
        try:
            if path.startswith("file:"):
                shutil.rmtree(path.removeprefix("file://").removeprefix("file:"), ignore_errors=True)
            else:
                _delete(spark, path)
        except Exception:  # the session may be gone; the cluster's folder has its own cleaning
            pass
