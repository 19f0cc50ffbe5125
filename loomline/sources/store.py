"""A store of contents, compressed texts, paths and pins as a table (ST1, ST3).

Entries are appended and never changed: ``(kind, key, value, at)``, a folder a kind.
The latest entry of a key holds, until its time to live is over.  Writing again
renews an entry.  :meth:`ContentStore.compacted` writes what holds to a new version.
"""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.functions import text as X

CONTENT, COMPRESSED, PATH, PINNED_PATH, PINNED_CONTENT = "content", "compressed", "path", "pinned_path", "pinned_content"
KINDS = (CONTENT, COMPRESSED, PATH, PINNED_PATH, PINNED_CONTENT)
_ENTRY = "key string, value string, at timestamp"


class ContentStore:
    """The store in a folder that all executors reach; one writer at a time."""

    def __init__(self, spark: SparkSession, folder: str, ttl_seconds: int | None = None) -> None:
        self.spark, self.folder, self.ttl = spark, folder.rstrip("/"), ttl_seconds

    def _versions(self) -> list[int]:
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(self.folder)
        fs = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration())
        if not fs.exists(at):
            return []
        names = [s.getPath().getName() for s in fs.listStatus(at)]
        return sorted(int(n.removeprefix("v")) for n in names if n.startswith("v") and n[1:].isdigit())

    def _path(self, kind: str, version: int | None = None) -> str:
        if version is None:
            version = max(self._versions(), default=0)
        return f"{self.folder}/v{version}/{kind}"

    def put(self, kind: str, entries: DataFrame) -> None:
        """Append ``entries(key, value, at)``; those without a key are none."""
        if kind not in KINDS:
            raise ValueError(f"unknown kind '{kind}'; there are {KINDS}")
        rows = entries.select(F.col("key").cast("string"), F.col("value").cast("string"), F.col("at").cast("timestamp"))
        rows.filter("key <> ''").write.mode("append").parquet(self._path(kind))

    def entries(self, kind: str) -> DataFrame:
        """All entries of a kind, those of old too."""
        path = self._path(kind)
        at = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        there = at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(at)
        return self.spark.read.schema(_ENTRY).parquet(path) if there else self.spark.createDataFrame([], _ENTRY)

    def held(self, kind: str, now: datetime | Column) -> DataFrame:
        """``key, value, at``: the latest entry of each key that has not expired (of one moment the greatest value).

        Pins never expire.  The filter on time comes before the shuffle.
        """
        rows = self.entries(kind)
        if self.ttl is not None and kind not in (PINNED_PATH, PINNED_CONTENT):
            now = now if isinstance(now, Column) else F.lit(now)
            rows = rows.filter(F.col("at") > now - F.make_dt_interval(secs=F.lit(self.ttl)))
        return rows.groupBy("key").agg(F.max_by("value", F.struct("at", "value")).alias("value"), F.max("at").alias("at"))

    def remember(self, blocks: DataFrame) -> None:
        """Contents of ``blocks(content, path, at)`` by their ids, and the id last read at each path."""
        rows = blocks.filter("content is not null").withColumn("_id", X.content_id(F.col("content")))
        once = rows.groupBy(F.col("_id").alias("key")).agg(F.min("content").alias("value"), F.max("at").alias("at"))
        self.put(CONTENT, once)
        self.put(PATH, rows.select(F.col("path").alias("key"), F.col("_id").alias("value"), "at"))

    def contents(self, now: datetime | Column) -> DataFrame:
        """``content_id, original``, as :func:`loomline.operators.compress.resolved` wants it."""
        return self.held(CONTENT, now).select(F.col("key").alias("content_id"), F.col("value").alias("original"))

    def cache(self, now: datetime | Column) -> DataFrame:
        """``content_id, compressed``, as :func:`loomline.operators.compress.compress` wants it."""
        return self.held(COMPRESSED, now).select(F.col("key").alias("content_id"), F.col("value").alias("compressed"))

    def pinned(self, blocks: DataFrame) -> DataFrame:
        """``blocks(content, path, ...)`` with ``pinned``: their path or their content is (ST3)."""
        rows = blocks.drop("pinned").withColumn("_id", X.content_id(F.col("content")))
        for kind, column, mark in ((PINNED_PATH, "path", "_by_path"), (PINNED_CONTENT, "_id", "_by_id")):
            keys = self.entries(kind).select(F.col("key").alias("_key")).distinct().withColumn(mark, F.lit(True))
            rows = rows.join(keys, F.col(column) == F.col("_key"), "left").drop("_key")
        return rows.withColumn("pinned", F.coalesce("_by_path", "_by_id", F.lit(False))).drop("_id", "_by_path", "_by_id")

    def compacted(self, now: datetime | Column) -> int:
        """Write what holds to a new version, which is read from then on; the old one stays for its readers."""
        version = max(self._versions(), default=0) + 1
        work = f"{self.folder}/making-{version}"
        for kind in KINDS:
            self.held(kind, now).write.mode("overwrite").parquet(f"{work}/{kind}")
        jvm = self.spark.sparkContext._jvm
        at, to = jvm.org.apache.hadoop.fs.Path(work), jvm.org.apache.hadoop.fs.Path(f"{self.folder}/v{version}")
        if not at.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).rename(at, to):
            raise OSError(f"cannot rename {work} to {self.folder}/v{version}")
        return version
