"""Session helpers: the engine runs in the caller's session and adds nothing to it."""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> str:
    """Folder for checkpoints and staged tables.

    On a cluster this is whatever ``spark.checkpoint.dir`` names.  A temporary
    folder is used only where that is unset *and* the master is local.
    """
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        if spark.sparkContext.getCheckpointDir() is None:
            spark.sparkContext.setCheckpointDir(named)
        return named
    current = spark.sparkContext.getCheckpointDir()
    if current:
        return current
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="spark-")
    spark.sparkContext.setCheckpointDir(folder)
    return spark.sparkContext.getCheckpointDir() or folder


_scopes = threading.local()


@contextmanager
def scratch_scope(spark: SparkSession) -> Iterator[None]:
    """Remove, at its end, what this thread pinned or staged inside.

    For work whose results are written elsewhere by then; a DataFrame that still
    reads a pinned table must not leave the scope.
    """
    outer = getattr(_scopes, "paths", None)
    _scopes.paths = []
    try:
        yield
    finally:
        paths, _scopes.paths = _scopes.paths, outer
        for name in paths:
            path = spark._jvm.org.apache.hadoop.fs.Path(name)
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path below the shared folder."""
    path = f"{shared_dir(spark).rstrip('/')}/{name}-{uuid.uuid4().hex}"
    if getattr(_scopes, "paths", None) is not None:
        _scopes.paths.append(path)
    return path


#: Spark removes an execution's shuffle files at its end, not when the driver next collects its garbage.
_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_cleaning: dict[int, tuple[int, str | None]] = {}
_cleaning_lock = threading.Lock()


@contextmanager
def exchanges_removed(spark: SparkSession) -> Iterator[None]:
    """Executions inside remove their own shuffle files as they end; the session's setting comes back after the last."""
    key = id(spark)
    with _cleaning_lock:
        depth, was = _cleaning.get(key) or (0, spark.conf.get(_CLEANUP, None))
        _cleaning[key] = depth + 1, was
        spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        with _cleaning_lock:
            depth, was = _cleaning.pop(key)
            if depth > 1:
                _cleaning[key] = depth - 1, was
            elif was is None:
                spark.conf.unset(_CLEANUP)
            else:
                spark.conf.set(_CLEANUP, was)


def pin(df: DataFrame, *by: str, path: str | None = None) -> DataFrame:
    """Write to the shared folder and read back; ``by`` names columns that get a folder a value.

    A ``path`` made before a ``scratch_scope`` began outlives it.

    Cuts the lineage, fixes generated row ids for good, and survives lost
    executors.  A columnar table also keeps pruning and pushdown, which a
    checkpointed plan would lose.  The exchanges behind it leave the disk with the write.
    """
    spark = df.sparkSession
    path = path or scratch_path(spark, "pinned")
    with exchanges_removed(spark):
        (df.write.partitionBy(*by) if by else df.write).parquet(path)
    return spark.read.schema(df.schema).parquet(path).select(*df.columns)
