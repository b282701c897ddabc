"""Tables in versioned folders behind an atomic pointer.

Every version is a folder of its own that is complete before anything points at it.
A version is committed by creating its numbered pointer file, which only one writer can
do; a writer that started from an older version is refused.  Readers follow the
greatest pointer, so they always find a whole table, and a write that fails leaves no
pointer behind.  Works on every file system Spark knows.
"""

from __future__ import annotations

import uuid

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession

POINTERS = "_versions"


class WriteConflict(RuntimeError):
    """Another writer has committed the version that this one was to become."""


class VersionedTable:
    def __init__(self, spark: SparkSession, root: str):
        self.spark, self.root = spark, root.rstrip("/")
        jvm = spark._jvm
        self._path = jvm.org.apache.hadoop.fs.Path
        self._utils = jvm.org.apache.commons.io.IOUtils
        self._fs = self._path(self.root).getFileSystem(spark._jsc.hadoopConfiguration())

    def _pointers(self) -> list[tuple[int, str]]:
        """(version, folder) of all committed versions, the latest first."""
        folder = self._path(f"{self.root}/{POINTERS}")
        if not self._fs.exists(folder):
            return []
        names = sorted((s.getPath().getName() for s in self._fs.listStatus(folder)), reverse=True)
        out = []
        for name in names:
            if not name.isdigit():
                continue
            stream = self._fs.open(self._path(f"{self.root}/{POINTERS}/{name}"))
            try:
                target = self._utils.toString(stream, "UTF-8")
            finally:
                stream.close()
            if target:  # an empty pointer is being written: not committed yet
                out.append((int(name), target))
        return out

    def version(self) -> int:
        """Number of the latest version; 0 if there is none."""
        found = self._pointers()
        return found[0][0] if found else 0

    def folder(self, version: int | None = None) -> str:
        for number, target in self._pointers():
            if version is None or number == version:
                return f"{self.root}/{target}"
        raise LookupError(f"no version {version or ''} of {self.root}")

    def read(self, version: int | None = None) -> DataFrame:
        return self.spark.read.parquet(self.folder(version))

    def stage(self, df: DataFrame) -> str:
        """Write ``df`` whole to a folder nobody reads yet."""
        name = f"data-{uuid.uuid4().hex}"
        df.write.parquet(f"{self.root}/{name}")
        return name

    def commit(self, staged: str, base: int) -> int:
        """Make a staged folder the version after ``base``; raises if someone else was first."""
        pointer = self._path(f"{self.root}/{POINTERS}/{base + 1:012d}")
        if self.version() != base:
            raise WriteConflict(f"{self.root} has moved on from version {base}")
        try:
            stream = self._fs.create(pointer, False)
        except Py4JJavaError as e:
            if "AlreadyExists" in str(e.java_exception.getClass().getName()):
                raise WriteConflict(f"{self.root} has moved on from version {base}") from e
            raise
        try:
            stream.writeBytes(staged)
        finally:
            stream.close()
        return base + 1

    def write(self, df: DataFrame, base: int) -> int:
        """Stage and commit ``df``, which was made from version ``base``."""
        return self.commit(self.stage(df), base)
