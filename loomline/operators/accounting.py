"""Token and cost accounting over request logs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Input prices by model prefix in dollars a million tokens, and what a cached token costs of that.
PRICES = {
    "claude-opus": 15.0, "claude-3-7-sonnet": 3.0, "claude-3-5-sonnet": 3.0, "claude-sonnet": 3.0, "claude-3-5-haiku": 0.80, "claude-haiku": 1.0,
    "gpt-5-mini": 0.25, "gpt-5-nano": 0.05, "gpt-5": 1.25, "gpt-4.1-mini": 0.40, "gpt-4.1-nano": 0.10, "gpt-4.1": 2.00, "gpt-4o-mini": 0.15, "gpt-4o": 2.50,
    "o4-mini": 1.10, "o3-mini": 1.10, "o3": 2.00, "minimax-m3": 0.30, "minimax-m2.7": 0.30,
}
CACHE_READ = {"claude": 0.1, "gpt-5": 0.1, "gpt-4.1": 0.25, "gpt-4o": 0.5, "o4": 0.25, "o3": 0.25, "minimax": 0.2}
DEFAULT_PRICE, DEFAULT_CACHE_READ, CACHE_WRITE = 3.0, 0.1, 1.25
ENCODINGS = {
    "gpt-4o": "o200k_base", "gpt-4.1": "o200k_base", "gpt-5": "o200k_base", "o1": "o200k_base", "o3": "o200k_base", "o4-mini": "o200k_base",
    "gpt-4": "cl100k_base", "gpt-3.5-turbo": "cl100k_base",
}
DEFAULT_ENCODING = "cl100k_base"
RECENT = 6


def model_name(model: Column) -> Column:
    """Lower case, without blanks and the provider before the first slash."""
    low = F.lower(F.trim(F.coalesce(model, F.lit(""))))
    return F.when(low.contains("/"), F.substring(low, F.locate("/", low) + 1, F.length(low))).otherwise(low)


def prefix_join(df: DataFrame, name: Column, prefixes: dict[str, float | str], value: str, default, boundary: str = "") -> DataFrame:
    """The value of the longest of ``prefixes`` that ``name`` starts with, and ``<value>_matched``.

    The prefixes are a constant of the plan: they are tried from the longest, in
    one expression, with neither a join nor a shuffle.  With ``boundary`` a prefix
    must be the whole name or end before that text.
    """
    found, matched = F.lit(default), F.lit(False)
    for p in sorted(prefixes, key=lambda p: (len(p), p)):
        hit = name.startswith(p) if not boundary else (name == p) | name.startswith(p + boundary)
        found, matched = F.when(hit, F.lit(prefixes[p])).otherwise(found), matched | hit
    return df.withColumns({value: found, f"{value}_matched": matched})


def longest_prefix(df: DataFrame, name: str, table: DataFrame, prefix: str, by: list[str]) -> DataFrame:
    """``df`` with the row of ``table`` whose ``prefix`` is the longest that ``name`` starts with.

    An equi-join: each distinct name gives its own prefixes, so no pair of a name
    and a prefix that does not match is ever made.
    """
    lengths = table.select(F.length(prefix).alias("_l")).distinct()
    names = df.select(name).distinct().crossJoin(F.broadcast(lengths)).filter(F.length(name) >= F.col("_l"))
    hits = names.withColumn("_p", F.substring(F.col(name), F.lit(1), F.col("_l"))).join(table, F.col("_p") == F.col(prefix))
    best = hits.withColumn("_k", F.row_number().over(Window.partitionBy(name).orderBy(F.desc("_l")))).filter("_k = 1").drop("_k", "_l", "_p")
    return df.join(best, name, "left")


def slots(log: DataFrame, tokens: str, by: str = "model", order: str = "seq") -> DataFrame:
    """``slot``: ``first`` while nothing was counted before in the group, else ``rest``.

    Rows of no tokens do not use up the first slot.
    """
    opened = log.filter(F.col(tokens) != 0).groupBy(F.col(by).alias("_by")).agg(F.min(order).alias("_opened"))  # a row a group
    rows = log.join(opened, F.col(by).eqNullSafe(F.col("_by")), "left")
    first = F.col("_opened").isNull() | (F.col(order) <= F.col("_opened"))
    return rows.withColumn("slot", F.when(first, "first").otherwise("rest")).drop("_by", "_opened")


def accountable(log: DataFrame) -> DataFrame:
    """Requests that the upstream answered (PF11)."""
    return log.filter((F.col("status") >= 200) & (F.col("status") < 300))


def by_model(log: DataFrame) -> DataFrame:
    """Content and tool tokens of each model by slot."""
    rows = slots(slots(accountable(log), "content_orig").withColumnRenamed("slot", "content_slot"), "tools_orig").withColumnRenamed("slot", "tools_slot")
    out = [
        F.coalesce(F.sum(F.when(F.col(f"{part}_slot") == slot, F.col(f"{part}_{side}"))), F.lit(0)).alias(f"{part}_{slot}_{side}")
        for part in ("content", "tools")
        for slot in ("first", "rest")
        for side in ("orig", "comp")
    ]
    return rows.groupBy("model").agg(*out)


def saved_cost(models: DataFrame) -> DataFrame:
    """Dollars saved by model: first tokens at the cache write price, the rest at the read price."""
    name = model_name(F.col("model"))
    rows = prefix_join(prefix_join(models, name, PRICES, "usd_per_mtok", DEFAULT_PRICE), name, CACHE_READ, "read_mult", DEFAULT_CACHE_READ)
    less = lambda slot: sum((F.col(f"{part}_{slot}_orig") - F.col(f"{part}_{slot}_comp") for part in ("content", "tools")), F.lit(0))
    saved = (less("first") * CACHE_WRITE + less("rest") * F.col("read_mult")) * F.col("usd_per_mtok") / 1_000_000
    return rows.withColumn("saved_usd", F.round(saved, 4))


def with_expansions(log: DataFrame) -> DataFrame:
    """Log rows and, for what was expanded again, rows that add to the compressed side only."""
    extra = log.filter("expanded is not null").select(
        *(F.col(c) if c in ("seq", "model", "status") else F.when(F.col("expanded") > 0, F.col("expanded")).otherwise(F.lit(0)).alias(c) if c == "content_comp" else F.lit(0).cast(log.schema[c].dataType).alias(c) if c.endswith(("_orig", "_comp", "skipped")) else F.lit(None).cast(log.schema[c].dataType).alias(c) for c in log.columns)
    )
    return log.unionByName(extra)


def snapshot(log: DataFrame) -> DataFrame:
    """Totals and ratios of a log, expansions given back."""
    rows = accountable(with_expansions(log))
    total = rows.agg(
        F.coalesce(F.sum("content_orig"), F.lit(0)).alias("original"),
        F.coalesce(F.sum("content_comp"), F.lit(0)).alias("compressed"),
        F.coalesce(F.sum("skipped"), F.lit(0)).alias("skipped"),
        F.count("expanded").alias("expansions"),
    )
    return total.withColumns({"saved": F.col("original") - F.col("compressed"), "ratio": F.when(F.col("original") > 0, F.bround(F.col("compressed") / F.col("original"), 3)).otherwise(0.0)})


def skipped_by_reason(log: DataFrame) -> DataFrame:
    return accountable(log).filter("skip_reason is not null").groupBy("skip_reason").agg(F.count(F.lit(1)).alias("n"), F.sum("skipped").alias("tokens"))


def recent(log: DataFrame, by: list[str], order: str, page: int, size: int = 1, window: int = RECENT) -> DataFrame:
    """A page of the latest ``window`` rows of each group, newest first; pages beyond the last show the oldest."""
    w = Window.partitionBy(*by)
    rows = log.withColumn("_k", F.row_number().over(w.orderBy(F.desc(order)))).filter(F.col("_k") <= window)
    pages = F.ceil(F.count(F.lit(1)).over(w) / size)
    rows = rows.withColumn("page", F.least(F.lit(page), (pages - 1).cast("int")))
    return rows.filter((F.col("_k") > F.col("page") * size) & (F.col("_k") <= (F.col("page") + 1) * size)).drop("_k")


def largest_saving(log: DataFrame, by: list[str], order: str) -> DataFrame:
    """The row of each group that saves most, the first of equal ones."""
    saving = F.col("content_orig") - F.col("content_comp")
    best = Window.partitionBy(*by).orderBy(F.desc(saving), order)
    return log.withColumn("saving", saving).withColumn("_k", F.row_number().over(best)).filter("_k = 1").drop("_k")


def resolve_rates(results: DataFrame, baseline: str, arm: str = "arm", resolved: str = "resolved") -> DataFrame:
    """Share of resolved instances of each arm, and how much of the baseline's it keeps."""
    rates = results.groupBy(arm).agg(F.count(F.lit(1)).alias("total"), F.sum(F.col(resolved).cast("long")).alias("n_resolved"))
    base = F.max(F.when(F.col(arm) == baseline, F.col("n_resolved"))).over(Window.partitionBy())
    return rates.withColumns({"rate": F.col("n_resolved") / F.col("total"), "retained": F.when(base > 0, F.col("n_resolved") / base)})
