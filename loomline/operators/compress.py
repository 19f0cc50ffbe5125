"""The compression decision list as one plan: gates, caches, a pluggable compressor, tags and accounting.

The compressor is any column function from (content, kind, level, intent) to text.
Rows reach it only after every cheaper gate, and each distinct content once.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from loomline.functions import budget, lint
from loomline.functions import text as X

# Fixed values.
REFUSAL = 0.05
LEAST, MOST = 512, 50_000

Compressor = Callable[[Column, Column, Column, Column], Column]


def identity(content: Column, kind: Column, level: Column, intent: Column) -> Column:
    return content


def linting(content: Column, kind: Column, level: Column, intent: Column) -> Column:
    return lint.linted(content)


def external(fn: Callable[[str, str, str, str], str]) -> Compressor:
    """A compressor from a plain function; an error keeps the original and is no task failure."""

    @F.pandas_udf(T.StringType())
    def run(batches: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        def one(*args):
            try:
                return fn(*args)
            except Exception:  # noqa: BLE001 - whatever a backend raises, its input goes on unchanged
                return None

        for columns in batches:
            yield pd.Series([one(*row) for row in zip(*columns, strict=True)], dtype="object")

    return lambda *columns: run(*columns)


COMPRESSORS: dict[str, Compressor] = {"identity": identity, "lint": linting}


def distinct_first(df: DataFrame, key: str, inputs: list[str], fn: Callable[[DataFrame], DataFrame]) -> DataFrame:
    """``fn`` over one row of each ``key``, joined back: an expensive function runs once a content (§4.1)."""
    once = df.groupBy(key).agg(*(F.min(c).alias(c) for c in inputs))
    return df.join(fn(once), key, "left")


def with_prior(blocks: DataFrame, order: str = "seq") -> DataFrame:
    """The latest earlier content of the same path, and whether this one is contained in it."""
    alone = F.when(F.col("path").isNull(), F.xxhash64(order))  # rows without a path have no earlier content, and are dealt
    w = Window.partitionBy("path", alone).orderBy(order)
    own = F.when(F.col("path").isNotNull(), F.lag("content").over(w))
    norm, prior = X.matchable(F.col("content")), X.matchable(own)
    return blocks.withColumn("prior_id", X.content_id(own)).withColumn("contained", F.coalesce((norm == prior) | prior.contains(norm), F.lit(False)))


def compress(blocks: DataFrame, compressor: Compressor = linting, cache: DataFrame | None = None, least: int = LEAST, most: int = MOST, refusal: float = REFUSAL) -> DataFrame:
    """``blocks(seq, content, kind, level, intent, path, pinned)`` with what becomes of each.

    Adds ``content_id, reason, output, original_tokens, compressed_tokens,
    cache_hit``.  The first rule that holds decides: tagged, pinned, contained in
    the latest read of its path, too small, too large, cached, then the compressor,
    whose empty or weak output (under ``refusal`` saved) is refused (PF9, PF10, J13, J14, Q11).
    """
    rows = with_prior(blocks).withColumns({"content_id": X.content_id(F.col("content")), "original_tokens": X.tokens_ceil(F.col("content"))})
    reason = (
        F.when(X.is_tagged(F.col("content")), "already_compressed")
        .when(F.coalesce("pinned", F.lit(False)), "pinned")
        .when(F.col("contained"), "path_shortcircuit")
        .otherwise(budget.skip_reason(F.col("original_tokens"), least, most))
    )
    rows = rows.withColumn("reason", reason)
    if cache is not None:
        rows = rows.join(cache.select("content_id", F.col("compressed").alias("cached")), "content_id", "left")
    else:
        rows = rows.withColumn("cached", F.lit(None).cast("string"))
    rows = rows.withColumn("cache_hit", F.col("reason").isNull() & F.col("cached").isNotNull())
    todo = rows.filter("reason is null and cached is null")
    once = todo.groupBy("content_id").agg(*(F.min(c).alias(c) for c in ("content", "kind", "level", "intent")))
    made = once.select("content_id", compressor(*(F.col(c) for c in ("content", "kind", "level", "intent"))).alias("made"))
    rows = rows.join(made, "content_id", "left")
    text = F.coalesce("cached", "made")
    tokens = X.tokens_ceil(text)
    refused = F.when(text.isNull(), "compressor_error").when(~text.rlike(r"\S"), "empty_output").when(tokens > F.col("original_tokens") * (1 - refusal), "ineffective")
    reason = F.when(F.col("reason").isNotNull(), F.col("reason")).when(F.col("cache_hit"), F.lit(None)).otherwise(refused)
    rows = rows.withColumns({"reason": reason, "_text": text})
    tagged = F.concat(X.reference_tag(F.col("content"), F.col("path")), F.lit("\n"), F.col("_text"))
    tagged = F.when(F.col("reason") == "path_shortcircuit", F.concat(F.lit("[REF:"), "prior_id", F.lit("]"))).when(F.col("reason").isNull(), tagged).otherwise(F.col("content"))
    rows = rows.withColumn("output", tagged)
    return rows.withColumn("compressed_tokens", X.tokens_ceil(F.col("output"))).drop("cached", "made", "_text", "contained", "prior_id")


def new_cache(compressed: DataFrame) -> DataFrame:
    """Cache entries of what was compressed: one row a content."""
    body = F.regexp_replace("output", r"^\[REF:[^\]]*\]\n", "")
    return compressed.filter("reason is null").groupBy("content_id").agg(F.min(body).alias("compressed"))


def reference_id(tool_input: Column) -> Column:
    """The content id that a call asks for, from ``shadow_id`` or else ``id``, bare or as a tag."""
    asked = F.coalesce(F.nullif(F.get_json_object(tool_input, "$.shadow_id"), F.lit("")), F.get_json_object(tool_input, "$.id"), F.lit(""))
    return F.regexp_extract(asked, r"^\s*(?:\[REF:\s*)?([^\s\]]*)", 1)


def resolved(calls: DataFrame, store: DataFrame) -> DataFrame:
    """Calls ``(…, tool_input)`` with ``reference`` and ``content``: the original of ``store(content_id, original)``,
    or what tells the model to go on without it (E16, ST8's lookup).  An id is in the store once."""
    rows = calls.withColumn("reference", reference_id(F.col("tool_input")))
    rows = rows.join(store.select(F.col("content_id").alias("reference"), "original"), "reference", "left")
    gone = F.concat(F.lit("[Reference '"), "reference", F.lit("' can no longer be expanded (it may have aged out of the shadow store). Its summary is still in your context above — carry on using that.]"))
    return rows.withColumn("content", F.coalesce("original", gone)).drop("original")
