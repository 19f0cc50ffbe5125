"""Reports: shares, index percentiles, modes, grouping sets, top rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def index_percentile(values: Column, p: float) -> Column:
    """The element at ``int(n * p)`` of the sorted values, as an aggregate over an array (A5)."""
    s = F.array_sort(values)
    return F.get(s, F.floor(F.size(s) * F.lit(p)).cast("int"))


def percentiles(df: DataFrame, by: list[str], value: str, points: dict[str, float]) -> DataFrame:
    """Index percentiles of each group, exact, without holding a group's rows together (A5).

    Values are counted first; the element of an index is the first value whose
    running count passes it, so a group costs its distinct values only.
    """
    counts = df.filter(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count(F.lit(1)).alias("_c"))
    w = Window.partitionBy(*by)
    rows = counts.withColumns({"_upto": F.sum("_c").over(w.orderBy(value)), "_n": F.sum("_c").over(w)})
    return rows.groupBy(*by).agg(F.max("_n").alias("n"), *(F.min(F.when(F.col("_upto") > F.floor(F.col("_n") * F.lit(p)), F.col(value))).alias(name) for name, p in points.items()))


def shares(df: DataFrame, by: list[str]) -> DataFrame:
    """Rows of each group and their percentage of all (A1, A2)."""
    rows = df.groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return rows.withColumn("percent", F.round(100 * F.col("n") / F.sum("n").over(Window.partitionBy()), 4))


def most_common(df: DataFrame, by: list[str], value: str, order: str, k: int) -> DataFrame:
    """The ``k`` most frequent values of each group, ties by first appearance."""
    rows = df.groupBy(*by, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("_first"))
    w = Window.partitionBy(*by).orderBy(F.desc("n"), "_first")
    return rows.withColumn("rank", F.row_number().over(w)).filter(F.col("rank") <= k).drop("_first")


def compression_report(df: DataFrame, sets: list[list[str]]) -> DataFrame:
    """Kept, dropped and mean ratio of kept rows, for several independent groupings in one pass."""
    columns = list(dict.fromkeys(c for s in sets for c in s))
    return df.groupingSets(sets, *columns).agg(F.count("ratio").alias("kept"), F.count_if(F.col("ratio").isNull()).alias("dropped"), F.round(F.avg("ratio"), 6).alias("avg_ratio"))


def hint_lines(spans: DataFrame, by: str, slots, separator: str = ", ") -> DataFrame:
    """Per sample and kind the most frequent span texts, as many as the kind has slots.

    ``spans`` is ``(by, kind, text, pos)``; a text that repeats is told with its count.
    """
    texts = spans.groupBy(by, "kind", "text").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"))
    kind = Window.partitionBy(by, "kind")
    rows = texts.withColumns({"distinct": F.count(F.lit(1)).over(kind), "total": F.count(F.lit(1)).over(Window.partitionBy(by)), "place": F.row_number().over(kind.orderBy(F.desc("n"), "first"))})
    rows = rows.filter(F.col("place") <= slots(F.col("distinct"), F.col("total")))
    told = F.concat(F.lit("`"), "text", F.lit("`"), F.when(F.col("n") > 1, F.concat(F.lit(" (×"), F.col("n").cast("string"), F.lit(")"))).otherwise(""))
    return rows.groupBy(by, "kind").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", told.alias("told")))), lambda x: x["told"]), separator).alias("hints"))


def top_rows(df: DataFrame, n: int, *order) -> DataFrame:
    """The first ``n`` rows of an order; ties must be part of it."""
    return df.orderBy(*order).limit(n)


def distinct_counts(df: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Distinct values of several columns."""
    return df.groupBy(*by).agg(*(F.count_distinct(c).alias(f"n_{c}") for c in columns))
