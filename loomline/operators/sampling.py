"""Deterministic sampling: proportional allocation, choice by hash order, splits by group.

The order of choice is MD5 of id and seed, so it depends on no partitioning and a
SQL engine can repeat it.  Ranks over a whole table are taken in two steps: inside
hash prefixes, then by the few prefix totals; no window holds all rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PREFIX = 2  # hex digits: 256 ranges of the hash order


def hash_order(key: Column, seed: int) -> Column:
    return F.md5(F.concat(key.cast("string"), F.lit(f"|{seed}")).cast("binary"))


def ranked(df: DataFrame, key: str, seed: int, by: list[str] | None = None, name: str = "place") -> DataFrame:
    """``name``: the place, from 1, of each row in hash order, of all rows or within ``by``.

    Rows of a range of hashes are ranked together, so one large group is dealt over
    256 tasks; the totals of the ranges, a few rows a group, give the offsets.
    """
    by = by or []
    rows = df.withColumn("_h", hash_order(F.col(key), seed)).withColumn("_p", F.substring("_h", 1, PREFIX))
    within = Window.partitionBy(*by, "_p").orderBy("_h", key)
    rows = rows.withColumn("_r", F.row_number().over(within))
    totals = rows.groupBy(*by, "_p").agg(F.count(F.lit(1)).alias("_c"))
    before = Window.partitionBy(*by).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)
    offsets = totals.withColumn("_o", F.coalesce(F.sum("_c").over(before), F.lit(0))).drop("_c")
    return rows.join(offsets, [*by, "_p"]).withColumn(name, (F.col("_r") + F.col("_o")).cast("long")).drop("_h", "_p", "_r", "_o")


def allocate(strata: DataFrame, by: list[str], target: int, count: str = "n") -> DataFrame:
    """``take`` of each stratum: its rounded share, then filled or trimmed to the target (T4).

    A share that rounds to nothing drops its stratum for good.  What is missing is
    taken from the largest strata first, what is too much from the largest shares,
    of which one row each stays.  Both are prefix sums over strata, of which there
    are few.
    """
    whole = Window.partitionBy()
    share = F.bround(target * F.col(count) / F.sum(count).over(whole), 0).cast("long")
    rows = strata.withColumn("take", F.least(F.col(count), share)).filter("take > 0")
    rows = rows.withColumn("_lack", F.lit(target) - F.sum("take").over(whole))
    upto = lambda c, order: F.coalesce(F.sum(c).over(Window.partitionBy().orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    room = F.col(count) - F.col("take")
    filled = F.greatest(F.lit(0), F.least(room, F.col("_lack") - upto(room, [F.desc(count), *by])))
    spare = F.col("take") - 1
    trimmed = F.greatest(F.lit(0), F.least(spare, -F.col("_lack") - upto(spare, [F.desc("take"), *by])))
    change = F.when(F.col("_lack") > 0, filled).when(F.col("_lack") < 0, -trimmed).otherwise(0)
    return rows.withColumn("take", (F.col("take") + change).cast("long")).select(*by, count, "take")


def stratified(df: DataFrame, by: list[str], key: str, target: int, seed: int) -> DataFrame:
    """A proportional sample of ``target`` rows, each stratum in hash order (T4, T5)."""
    plan = allocate(df.groupBy(*by).agg(F.count(F.lit(1)).alias("n")), by, target)
    return ranked(df, key, seed, by).join(plan.select(*by, "take"), by).filter("place <= take").drop("place", "take")


def subsample(df: DataFrame, by: list[str], key: str, n: int, seed: int) -> DataFrame:
    """At least one row of each stratum, about its share, at most ``n`` in all."""
    total = df.groupBy(*by).agg(F.count(F.lit(1)).alias("_c"))
    share = F.greatest(F.lit(1), F.bround(n * F.col("_c") / F.sum("_c").over(Window.partitionBy()), 0).cast("long"))
    chosen = ranked(df, key, seed, by).join(total.withColumn("_s", share).drop("_c"), by).filter("place <= _s").drop("place", "_s")
    return ranked(chosen, key, seed + 1).filter(F.col("place") <= n).drop("place")


def split_by_group(df: DataFrame, group: str, share: float, seed: int) -> DataFrame:
    """``split``: ``val`` for whole groups, the first ``share`` of them in hash order, else ``train``."""
    groups = df.select(group).distinct()
    n = groups.agg(F.floor(F.count(F.lit(1)) * share).alias("_n"))
    val = ranked(groups, group, seed).join(F.broadcast(n))  # one row
    val = val.filter("place <= _n").select(group, F.lit("val").alias("split"))
    return df.join(val, group, "left").withColumn("split", F.coalesce("split", F.lit("train")))


def per_kind(df: DataFrame, kind: str, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows of each kind in hash order, and ``short``: whether a kind has fewer."""
    totals = df.groupBy(kind).agg((F.count(F.lit(1)) < n).alias("short"))
    return ranked(df, key, seed, [kind]).filter(F.col("place") <= n).join(totals, kind)


def take(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """``n`` rows in hash order."""
    return df.orderBy(hash_order(F.col(key), seed), key).limit(n)


def repeated(df: DataFrame, condition: Column, times: int) -> DataFrame:
    """Rows that meet the condition ``times`` times, others once."""
    return df.withColumn("_i", F.explode(F.sequence(F.lit(1), F.when(condition, times).otherwise(1)))).drop("_i")
