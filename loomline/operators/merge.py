"""Keyed merges: upserts, resumes, defaults by lookup, unique resolution."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def upsert(base: DataFrame, replacement: DataFrame, key: str) -> DataFrame:
    """``base`` with rows of equal key replaced whole; nothing is added."""
    other = replacement.dropDuplicates([key]).select(F.col(key), F.struct(*(c for c in base.columns if c != key)).alias("_r"))
    rows = base.join(other, key, "left")
    return rows.select(*(F.col(c) if c == key else F.when(F.col("_r").isNotNull(), F.col(f"_r.{c}")).otherwise(F.col(c)).alias(c) for c in base.columns))


def unmatched(base: DataFrame, replacement: DataFrame, key: str) -> DataFrame:
    """Replacements that replace nothing."""
    return replacement.join(base.select(key), key, "left_anti")


def pending(pool: DataFrame, done: DataFrame, key: str, retry_errors: bool = False) -> DataFrame:
    """Rows that still need work: not done, or done with an error if those are retried (PF7, SK6)."""
    finished = done.filter("error is null") if retry_errors else done
    return pool.join(finished.select(key), key, "left_anti")


def resumed(pool: DataFrame, old: DataFrame, new: DataFrame, key: str, values: list[str]) -> DataFrame:
    """The pool with results, new ones before old ones."""
    rows = pool
    for k, side in enumerate((new, old)):
        rows = rows.join(side.select(key, F.struct(*values).alias(f"_{k}")), key, "left")
    best = F.coalesce("_0", "_1")
    return rows.select(*pool.columns, *(best[v].alias(v) for v in values))


def looked_up(df: DataFrame, table: DataFrame, keys: list[str], value: str, default: str) -> DataFrame:
    """``value`` by key, a default where there is none."""
    return df.join(table.select(*keys, value), keys, "left").withColumn(value, F.coalesce(value, F.lit(default)))


def only_needed(df: DataFrame, keys: DataFrame, key: str) -> DataFrame:
    """Rows whose key is asked for (J2, SC8)."""
    return df.join(keys.select(key), key, "left_semi")


def candidates(gold: DataFrame, found: DataFrame, key: str) -> DataFrame:
    """Gold entries with what was produced for them; nothing means dropped."""
    rows = gold.join(found.withColumn("_found", F.lit(True)), key, "left")
    return rows.withColumn("dropped", F.col("_found").isNull()).drop("_found")


def unique_names(files: DataFrame, path: str = "path") -> DataFrame:
    """Base names that stand for one path only, with that path."""
    name = F.substring_index(F.col(path), "/", -1)
    return files.select(name.alias("name"), path).groupBy("name").agg(F.count_distinct(path).alias("_n"), F.min(path).alias(path)).filter("_n = 1").drop("_n")


def first_of(df: DataFrame, key: list[str], order: Column) -> DataFrame:
    """The first row of each key, as one struct minimum: partial on the map side."""
    rest = [c for c in df.columns if c not in key]
    rows = df.groupBy(*key).agg(F.min_by(F.struct(*rest), order).alias("_r"))
    return rows.select(*key, "_r.*")


def with_default_kind(sources: dict[str, DataFrame]) -> DataFrame:
    """Sources one after the other; where a row has no kind its source's name is it."""
    out = None
    for kind, df in sources.items():
        rows = df.withColumn("kind", F.coalesce("kind", F.lit(kind)) if "kind" in df.columns else F.lit(kind))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    return out
