"""Checks of compressed outputs, segment states and recall of spans that must stay."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import segments

# Fixed values.
SHRUNK = 0.7
NEAR_IDENTITY = 0.65
LAZY_IN, LAZY_OUT, LAZY_RATIO, LAZY_RUN, LAZY_MOST = 500, 200, 0.5, 0.5, 2
RECALL_LEAST, RECALL_SPANS = 0.7, 3


def text_reason(output: Column, budget: Column, original: Column) -> Column:
    """The first text-level check that an output fails, else null (V1-V6)."""
    tokens = X.tokens_floor(output)
    lead = F.regexp_replace(output, r"^\s+", "")
    low = F.lower(lead)
    return (
        F.when(tokens > budget * 1.3, "exceeds_budget")
        .when(tokens < budget * 0.2, "too_short")
        .when(F.length(output) / F.greatest(F.lit(1), F.length(original)) > NEAR_IDENTITY, "near_identity")
        .when(X.occurrences(output, "[SEG id=") != X.occurrences(output, "[/SEG]"), "truncated_segments")
        .when(X.starts_with_any(low, tuple(p.lower() for p in X.PREAMBLES)), "hallucinated_preamble")
        .when(lead.startswith("```") & F.regexp_replace(output, r"\s+$", "").endswith("```"), "wrapped_in_codefence")
        .when(X.starts_with_any(lead, X.QA_STARTS), "looks_like_qa_response")
    )


def verbatim_run(output: Column, original: Column) -> Column:
    """Characters of the longest run of output lines that stand in the original; short lines end a run."""
    start = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(acc: Column, line: Column) -> Column:
        run = F.when((F.length(line) > 5) & original.contains(line), acc["run"] + F.length(line) + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(acc["best"], run).alias("best"))

    lines = F.split(output, r"\r\n|[\n\r\x0B\x0C\x1C\x1D\x1E\x85  ]", -1)
    return F.coalesce(F.aggregate(lines, start, step)["best"], F.lit(0))


def is_lazy(kind: Column, before: Column, after: Column) -> Column:
    """A file read that is mostly copied (V7)."""
    n_in, n_out = F.length(before), F.length(after)
    large = (kind == "file_read") & (n_in >= LAZY_IN) & (n_out >= LAZY_OUT) & (n_out / n_in >= LAZY_RATIO)
    return F.coalesce(large & (verbatim_run(after, before) / F.greatest(F.lit(1), n_out) > LAZY_RUN), F.lit(False))


def lazy_segments(both: DataFrame) -> DataFrame:
    """``both(kind, content, out)`` with ``ratio``, ``verbatim_share`` and ``lazy`` by the strict rule, for any kind (V9)."""
    n_in, n_out = F.length("content"), F.length("out")
    rows = both.withColumns({"ratio": n_out / F.greatest(F.lit(1), n_in), "verbatim_share": verbatim_run(F.col("out"), F.col("content")) / F.greatest(F.lit(1), n_out)})
    strict = (n_in > LAZY_IN) & (n_out > LAZY_OUT) & (F.col("ratio") > LAZY_RATIO) & (F.col("verbatim_share") > LAZY_RUN)
    return rows.withColumn("lazy", F.coalesce(strict, F.lit(False)))


def lazy_by_kind(rows: DataFrame) -> DataFrame:
    """Segments, mean ratio and verbatim share, and lazy ones of each kind (V9)."""
    lazy = F.count_if("lazy")
    return rows.groupBy("kind").agg(
        F.count(F.lit(1)).alias("n_segments"), F.round(F.avg("ratio"), 4).alias("ratio"), F.round(F.avg("verbatim_share"), 4).alias("verbatim_share"),
        lazy.alias("n_lazy"), F.round(100 * lazy / F.count(F.lit(1)), 2).alias("lazy_percent"),
    )


def segment_states(before: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """INTACT, SHRUNK, DROPPED or ADDED for each segment id of either side."""
    a = before.select(*by, F.length("content").alias("n_in"), F.col("kind"), F.col("level"))
    b = after.select(*by, F.length("content").alias("n_out"))
    state = F.when(F.col("n_out").isNull(), "DROPPED").when(F.col("n_in").isNull(), "ADDED").when(F.col("n_out") < SHRUNK * F.col("n_in"), "SHRUNK").otherwise("INTACT")
    return a.join(b, by, "full_outer").withColumn("state", state)


def span_states(spans: DataFrame, states: DataFrame, after: DataFrame, by: list[str]) -> DataFrame:
    """Spans with the state of their segment, ``MISSING`` if there is none, and whether the output holds them."""
    rows = spans.join(states.select(*by, "state"), by, "left").join(after.select(*by, "content"), by, "left")
    return rows.withColumns({"state": F.coalesce("state", F.lit("MISSING")), "kept": F.coalesce(F.col("content").contains(F.col("text")), F.lit(False))}).drop("content")


def recall_report(spans: DataFrame) -> DataFrame:
    """Kept and total spans and their share, by state and kind, and OVERALL by state."""
    rows = spans.groupingSets([["state", "kind"], ["state"]], "state", "kind").agg(
        F.count(F.lit(1)).alias("total"), F.sum(F.col("kept").cast("long")).alias("n_kept"), F.grouping("kind").alias("_all")
    )
    return rows.select("state", F.when(F.col("_all") == 1, "OVERALL").otherwise(F.col("kind")).alias("kind"), "total", "n_kept", F.round(F.col("n_kept") / F.col("total"), 4).alias("recall"))


def validate(pairs: DataFrame, spans: DataFrame | None = None) -> DataFrame:
    """``pairs(sample_id, original, output, budget)`` with ``reject_reason``, ``ok`` if none (PF4, V1-V8).

    Text checks come first; segments are parsed only of outputs that pass them.
    """
    checked = pairs.withColumn("_reason", text_reason(F.col("output"), F.col("budget"), F.col("original")))
    passing = checked.filter("_reason is null")
    by = ["sample_id", "seg_id"]
    before = segments.blocks(passing.select("sample_id", "original"), "original")
    after = segments.blocks(passing.select("sample_id", "output"), "output").select(*by, F.col("content").alias("out"))
    both = before.join(after, by)
    lazy = both.groupBy("sample_id").agg(F.count_if(is_lazy(F.col("kind"), F.col("content"), F.col("out"))).alias("n_lazy"))
    out = checked.join(lazy, "sample_id", "left")
    lost = F.lit(False)
    if spans is not None:
        distinct = spans.select(*by, "text").distinct()
        shrunk = both.filter(F.col("level").isin("L0", "L1") & (F.length("out") < SHRUNK * F.length("content")))
        kept = shrunk.join(distinct, by).groupBy(*by).agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("out").contains(F.col("text"))).alias("k"))
        bad = kept.filter((F.col("n") >= RECALL_SPANS) & (F.col("k") / F.col("n") < RECALL_LEAST)).select("sample_id").distinct().withColumn("_lost", F.lit(True))
        out, lost = out.join(bad, "sample_id", "left"), F.coalesce(F.col("_lost"), F.lit(False))
    reason = F.coalesce("_reason", F.when(F.col("n_lazy") >= LAZY_MOST, "lazy_file_reads"), F.when(lost, "shrunk_lost_mustkeep"), F.lit("ok"))
    return out.withColumn("reject_reason", reason).select(*pairs.columns, "reject_reason")


def failure_flags(output: Column, original: Column, budget: Column, finish: Column, abstractive: Column) -> Column:
    """All failure flags of an output."""
    ratio = F.length(output) / F.greatest(F.lit(1), F.length(original))
    return F.array_compact(
        F.array(
            F.when(ratio > 0.85, "NO_COMPRESSION").when(ratio > 0.65, "WEAK_COMPRESSION"),
            F.when(X.looks_truncated(output), "TRUNCATED"),
            F.when(finish == "length", "HIT_MAX_TOKENS"),
            F.when(abstractive == 0, "PURE_EXTRACTIVE"),
            F.when(X.tokens_floor(output) > budget * 1.3, "EXCEEDS_BUDGET"),
        )
    )


def flag_tally(rows: DataFrame, flags: str, priority: list[str]) -> DataFrame:
    """Rows with each flag, and with it as the primary one, the first by ``priority``."""
    primary = F.coalesce(*(F.when(F.array_contains(flags, p), p) for p in priority), F.lit("NONE"))
    return rows.withColumn("_primary", primary).select("_primary", F.explode(flags).alias("flag")).groupBy("flag").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("_primary") == F.col("flag")).alias("n_primary"))


def batch_guard(results: DataFrame, pool: DataFrame) -> DataFrame:
    """Batch results with ``reject_reason`` of the guards, null if none (J1, PF5)."""
    body = F.get(F.col("response.body.choices"), 0)
    rows = results.join(pool, results["custom_id"] == pool["sample_id"], "left")
    reason = F.when(F.coalesce(F.col("response.status_code"), F.lit(0)) != 200, "api_error").when(body["message"]["content"].isNull(), "malformed_response").when(F.col("sample_id").isNull(), "sample_not_in_pool")
    return rows.withColumns({"output": body["message"]["content"], "finish_reason": body["finish_reason"], "reject_reason": reason})


def decision(pass_rate: Column) -> Column:
    """What a pass rate means for a roll-out."""
    return F.when(pass_rate < 0.70, "stop").when(pass_rate < 0.85, "warn").otherwise("go")


def last_by(df: DataFrame, by: list[str], order: str) -> DataFrame:
    """The last row of each key."""
    w = Window.partitionBy(*by).orderBy(F.desc(order))
    return df.withColumn("_k", F.row_number().over(w)).filter("_k = 1").drop("_k")
