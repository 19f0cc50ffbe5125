"""One object for the usual calls: settings, a store and the operators together."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from loomline.operators import accounting, compress, requests, tools
from loomline.plans import scratch
from loomline.plans.session import ship
from loomline.settings import Settings, load
from loomline.sources.store import COMPRESSED, ContentStore


class Loom:
    """Compression, references, tool selection, history and accounting under one set of settings.

    Every method takes and returns DataFrames; :meth:`compress` also writes to the
    store if the settings name one.
    """

    def __init__(self, spark: SparkSession, settings: Settings | None = None) -> None:
        ship(spark)
        self.spark, self.settings = spark, settings or load(spark=spark)
        own = self.settings.store
        self.store = ContentStore(spark, own.path, own.ttl_seconds) if own.path else None

    def compress(self, blocks: DataFrame, now: datetime | None = None) -> DataFrame:
        """What becomes of ``blocks(seq, content, kind, level, intent, path[, pinned])``.

        With a store: pins are read from it where ``blocks`` has none, texts compressed
        before are used again, contents and new texts are kept.
        """
        own, now = self.settings.compression, now or datetime.now()
        if "pinned" not in blocks.columns:
            blocks = self.store.pinned(blocks) if self.store else blocks.withColumn("pinned", F.lit(False))
        cache = self.store.cache(now) if self.store else None
        out = compress.compress(blocks, compress.COMPRESSORS[own.compressor], cache, own.min_tokens, own.max_tokens, own.refusal_threshold)
        if not self.store:
            return out
        path = scratch.folder(self.spark, "compressed")  # the compressor runs once, for the store and for the caller
        out.write.parquet(path)
        out = self.spark.read.schema(out.schema).parquet(path)
        at = F.lit(now).alias("at")
        self.store.remember(out.select("content", "path", at))
        self.store.put(COMPRESSED, compress.new_cache(out.filter("not cache_hit")).select(F.col("content_id").alias("key"), F.col("compressed").alias("value"), at))
        return out

    def resolve(self, calls: DataFrame, now: datetime | None = None) -> DataFrame:
        """Calls ``(…, tool_input)`` with the originals that they ask for."""
        if not self.store:
            raise ValueError("references are resolved from a store; set store.path")
        return compress.resolved(calls, self.store.contents(now or datetime.now()))

    def select_tools(self, ranked: DataFrame, by: list[str], wanted: Column) -> DataFrame:
        """``ranked(…, name, description, score, rank)`` with the ``fate`` of each tool."""
        own = self.settings.tool_selection
        rows = tools.selected(ranked, by, wanted, least=min(own.top_k, own.k_max), most=own.k_max)
        signal = tools.mcp_signal(rows.filter("kept"), by, rank="place")
        return tools.applied(rows, signal, by, own.mcp_signal_threshold)

    def fold_history(self, messages: DataFrame, by: list[str], order: str) -> DataFrame:
        """Messages with ``folded``; none is where history is left alone."""
        own = self.settings.history
        if not own.enabled:
            return requests.with_turn(messages, by, order).withColumn("folded", F.lit(False))
        return requests.fold_history(messages, by, order, keep=own.keep_recent_turns, window=own.context_window, share=own.context_threshold)

    def usage(self, log: DataFrame) -> DataFrame:
        """Totals and ratios of a request log."""
        return accounting.snapshot(log)
