"""Intermediate tables in the folder that every executor can reach.

``spark.checkpoint.dir`` names that folder; a machine-local one is set only
where it is unset and the master is local (tests, a laptop).  A table written here
cuts lineage: a lost executor costs a re-read, not a recomputation.
"""

from __future__ import annotations

import tempfile
import threading
import uuid
from collections.abc import Iterator
from contextlib import contextmanager

from pyspark.sql import DataFrame, SparkSession


def shared_root(spark: SparkSession) -> str:
    """The shared folder as a URI or path, set for this session if it was unset.

    On a cluster it must be set: executors would write to their own disks.
    """
    root = spark.conf.get("spark.checkpoint.dir", None)
    if root:
        return root.rstrip("/")
    known = spark.sparkContext._jsc.sc().getCheckpointDir()
    if known.isDefined():
        return known.get().rstrip("/")
    if not spark.sparkContext.master.startswith("local["):
        raise RuntimeError("set spark.checkpoint.dir to a folder that all executors share")
    root = "file://" + tempfile.mkdtemp(prefix="loomline-")
    spark.sparkContext.setCheckpointDir(root)
    return root


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh folder under the shared root, deleted when the driver's JVM ends."""
    path = f"{shared_root(spark)}/loomline-{label}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    fs.deleteOnExit(at)
    return path


_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_lock, _writers, _before = threading.Lock(), 0, None


@contextmanager
def _cleaning(spark: SparkSession) -> Iterator[None]:
    """The setting is on while any thread writes; the last one to end puts back what it was."""
    global _writers, _before
    with _lock:
        if not _writers:
            _before = spark.conf.get(_CLEANUP, None)
            spark.conf.set(_CLEANUP, "true")
        _writers += 1
    try:
        yield
    finally:
        with _lock:
            _writers -= 1
            if not _writers:
                spark.conf.unset(_CLEANUP) if _before is None else spark.conf.set(_CLEANUP, _before)


def save(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` as a table in the shared folder and read it back.

    Once the table stands, the shuffle files of the job that wrote it are of no use
    and go at once.
    """
    spark = df.sparkSession
    path = new_folder(spark, label)
    with _cleaning(spark):
        df.write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out._loomline_path = path
    return out


def drop(df: DataFrame | None) -> None:
    """Delete a table written by :func:`save` that nothing reads any more."""
    path = getattr(df, "_loomline_path", None)
    if path:
        spark = df.sparkSession
        at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(at, True)
