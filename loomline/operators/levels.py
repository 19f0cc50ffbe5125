"""Retention levels of a sequence: position, recency, staleness and the ordered level rules.

Two forms: over one row per segment (windows by the sequence's keys) and over an
array of segments (higher-order functions, no shuffle).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.schemas import ACTION_KINDS, PROTECTED_KINDS, RESULT_KINDS

PATH = r'"path":\s*"([^"]+)"'


def with_position(df: DataFrame, by: list[str], order: list) -> DataFrame:
    """``pos`` from 0, ``n``, ``relative_pos``, ``from_end`` and ``is_last`` of each row."""
    w = Window.partitionBy(*by)
    df = df.withColumn("pos", (F.row_number().over(w.orderBy(*order)) - 1).cast("int")).withColumn("n", F.count(F.lit(1)).over(w).cast("int"))
    return df.withColumns(
        {
            "relative_pos": F.col("pos") / F.greatest(F.lit(1), F.col("n") - 1),
            "from_end": F.col("n") - 1 - F.col("pos"),
            "is_last": F.col("pos") == F.col("n") - 1,
        }
    )


def recency(relative: Column, from_end: Column) -> dict[str, Column]:
    """Recency classes, by share of the sequence or by distance from its end."""
    return {
        "very_recent": (relative > 0.85) | (from_end <= 1),
        "recent": (relative > 0.7) | (from_end <= 4),
        "ancient": (relative < 0.25) & (from_end > 8),
    }


def level_and_reason(kind: Column, is_current: Column, relative: Column, from_end: Column, stale: Column) -> Column:
    """``struct<level, reason>``; the first rule that holds decides."""
    r = recency(relative, from_end)
    result = kind.isin(*RESULT_KINDS)

    def to(level: str, *parts) -> Column:
        return F.struct(F.lit(level).alias("level"), F.concat(*(F.lit(p) if isinstance(p, str) else p for p in parts)).alias("reason"))

    return (
        F.when(kind.isin(*PROTECTED_KINDS), to("L0", "protected=", kind))
        .when(is_current, to("L0", "is_current_turn"))
        .when(r["very_recent"] & result, to("L0", "very_recent_tool_result"))
        .when(stale, to("L3", "stale_file_read"))
        .when(r["ancient"] & ~kind.isin("file_operation", "bash_command"), to("L3", F.format_string("ancient(pos=%.2f)", relative)))
        .when(r["recent"] & (kind == "file_read"), to("L1", "recent_file_read"))
        .when(r["recent"] & result, to("L1", "recent_", kind))
        .when(kind.isin(*ACTION_KINDS), to("L1", "action_", kind))
        .when(kind == "file_read", to("L2", "mid_file_read"))
        .when(kind == "assistant_thinking", to("L2", "thinking"))
        .when(result & (relative < 0.4), to("L3", "old_", kind))
        .when(result, to("L2", "mid_", kind))
        .otherwise(to("L2", "default_", kind))
    )


def accessed_paths(content: Column) -> Column:
    """Absolute paths with a dotted file name that a file operation names, repeats included."""
    return F.filter(F.regexp_extract_all(content, F.lit(PATH), F.lit(1)), lambda p: p.startswith("/") & F.substring_index(p, "/", -1).contains("."))


def with_staleness(df: DataFrame, by: list[str], paths: Column) -> DataFrame:
    """``is_stale``: a file operation whose file is accessed again later, or the tool result after one.

    ``df`` has ``pos`` and ``kind``.  A row that names one path twice is stale itself.
    """
    accesses = df.filter(F.col("kind") == "file_operation").select(*by, "pos", F.posexplode(paths).alias("place", "path"))
    last = Window.partitionBy(*by, "path").orderBy(F.desc("pos"), F.desc("place"))
    own = accesses.withColumn("later", F.row_number().over(last)).filter("later > 1").select(*by, "pos").distinct().withColumn("_stale", F.lit(True))
    marked = df.join(own, [*by, "pos"], "left")
    before = F.lag("_stale").over(Window.partitionBy(*by).orderBy("pos"))
    stale = F.coalesce(F.col("_stale"), F.lit(False)) | (F.coalesce(before, F.lit(False)) & (F.col("kind") == "tool_result"))
    return marked.withColumn("is_stale", stale).drop("_stale")


def label_rows(df: DataFrame, by: list[str]) -> DataFrame:
    """``level`` and ``level_reason`` of rows with position and staleness."""
    told = level_and_reason(F.col("kind"), F.col("is_last"), F.col("relative_pos"), F.col("from_end"), F.col("is_stale"))
    return df.withColumn("_told", told).withColumns({"level": F.col("_told.level"), "level_reason": F.col("_told.reason")}).drop("_told")


def with_stale_positions(df: DataFrame, segments: str, name: str = "stale") -> DataFrame:
    """``name``: positions (from 0) of stale segments of an array column (W4, without a shuffle).

    Step by step, so that no step is evaluated again for each element of another.
    """
    paths = lambda s: F.when(s["kind"] == "file_operation", accessed_paths(s["content"])).otherwise(F.array().cast("array<string>"))
    accesses = F.flatten(F.transform(segments, lambda s, i: F.transform(paths(s), lambda p: F.struct(p.alias("path"), i.alias("pos")))))
    df = df.withColumn("_accesses", accesses)
    df = df.withColumn("_paths", F.transform("_accesses", lambda a: a["path"]))
    # An access is superseded if its path stands again behind it.
    again = F.filter("_accesses", lambda a, k: F.array_contains(F.slice("_paths", k + 2, F.size("_paths")), a["path"]))
    df = df.withColumn("_own", F.array_distinct(F.transform(again, lambda a: a["pos"])))
    after = F.filter(F.transform("_own", lambda p: p + 1), lambda p: F.coalesce(F.get(segments, p)["kind"] == "tool_result", F.lit(False)))
    return df.withColumn(name, F.array_sort(F.array_union("_own", after))).drop("_accesses", "_paths", "_own")


def label_segments(segments: str, stale: str) -> Column:
    """``array<struct<seg_id, level, reason>>`` of an array of segments, in order."""
    n = F.size(segments)

    def one(s: Column, i: Column) -> Column:
        told = level_and_reason(s["kind"], s["is_current_turn"], i / F.greatest(F.lit(1), n - 1), n - 1 - i, F.array_contains(stale, i))
        return F.struct(s["seg_id"].alias("seg_id"), told.alias("told"))

    return F.transform(F.transform(segments, one), lambda x: F.struct(x["seg_id"].alias("seg_id"), x["told"]["level"].alias("level"), x["told"]["reason"].alias("reason")))
