"""From trajectories to samples of segments: decision points, histories, splitting, truncation."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import text as X
from loomline.operators import levels
from loomline.schemas import PROTECTED_KINDS, REAL_ACTIONS

# Fixed values.
MAX_SAMPLES = 8
LEAST_HISTORY = 3
LONG_TOKENS, MAX_SEGMENT_TOKENS, MAX_INPUT_TOKENS = 1000, 4000, 32000


def downsampled(decisions: Column, most: int = MAX_SAMPLES) -> Column:
    """At most ``most`` evenly spaced elements of an array."""
    n = F.size(decisions)
    picked = F.transform(F.sequence(F.lit(0), F.lit(most - 1)), lambda i: F.get(decisions, F.floor(i * (n / F.lit(float(most)))).cast("int")))
    return F.when(n > most, picked).otherwise(decisions)


def tool_calls_text(calls: Column) -> Column:
    """Tool calls as one line of JSON after the content, as names and arguments."""
    quoted = F.transform(calls, lambda c: F.concat(F.lit('{"name": '), _json_string(F.coalesce(c["function"]["name"], F.lit(""))), F.lit(', "args": '), _arguments(c["function"]["arguments"]), F.lit("}")))
    return F.concat(F.lit("[tool_calls]: ["), F.array_join(quoted, ", "), F.lit("]"))


def _json_string(c: Column) -> Column:
    return F.regexp_replace(F.to_json(F.array(c)), r"^\[|\]$", "")


def _arguments(args: Column) -> Column:
    """Arguments as JSON if they parse, else as a JSON string."""
    return F.coalesce(F.when(F.try_parse_json(args).isNotNull(), args), _json_string(args), F.lit('""'))


def history_segments(messages: Column) -> Column:
    """Messages of a history as segment structs.

    Kind, content and size come in steps of their own, each over the array that
    the one before made, so that no expression is written out inside another.
    """
    name = lambda m: F.get(m["tool_calls"], 0)["function"]["name"]
    seen = F.transform(
        messages,
        lambda m, i: F.struct(
            i.alias("i"), F.coalesce(m["role"], F.lit("unknown")).alias("role"), F.coalesce(m["content"], F.lit("")).alias("body"),
            F.when(F.coalesce(F.size(m["tool_calls"]), F.lit(0)) > 0, m["tool_calls"]).alias("calls"), F.coalesce(name(m), F.lit("")).alias("name"),
        ),
    )
    kinds = F.transform(seen, lambda x: F.struct(x.alias("m"), X.message_kind(x["role"], x["body"], F.when(x["calls"].isNotNull(), x["name"]), x["i"]).alias("kind")))
    clipped = F.transform(kinds, lambda x: x.withField("body", F.when(x["kind"] == "system_prompt", X.clip_system(x["m"]["body"])).otherwise(x["m"]["body"])))
    called = F.transform(clipped, lambda x: x.withField("calls", tool_calls_text(x["m"]["calls"])))
    told = F.transform(called, lambda x: x.withField("content", F.when(x["calls"].isNull(), x["body"]).when(x["body"] != "", F.concat(x["body"], F.lit("\n"), x["calls"])).otherwise(x["calls"])))
    return F.transform(
        told,
        lambda x: F.struct(
            F.concat(F.lit("s"), x["m"]["i"].cast("string")).alias("seg_id"),
            x["m"]["role"].alias("role"),
            x["kind"].alias("kind"),
            x["content"].alias("content"),
            X.tokens_floor(x["content"]).alias("tokens"),
            F.lit(None).cast("string").alias("file_path"),
            (x["m"]["i"] == F.size(messages) - 1).alias("is_current_turn"),
            x["m"]["i"].cast("int").alias("turn_idx"),
        ),
    )


def target_of(message: Column) -> Column:
    """The first tool call of a decision, or its text."""
    call = F.get(message["tool_calls"], 0)["function"]
    called = F.coalesce(F.size(message["tool_calls"]), F.lit(0)) > 0
    text = F.lit(None).cast("string")
    return F.struct(
        F.when(called, "tool_call").otherwise("text_response").alias("type"),
        F.when(called, F.coalesce(call["name"], F.lit(""))).alias("name"),
        F.when(called, _arguments(call["arguments"])).otherwise(text).alias("args"),
        F.when(~called, F.coalesce(message["content"], F.lit(""))).alias("content"),
    )


def samples(trajectories: DataFrame, most: int = MAX_SAMPLES) -> DataFrame:
    """One row for each sampled decision of each trajectory, with its history as segments (PF14, W5).

    ``turn_idx`` counts the sampled decisions, those too early for a history
    included; ``decision_idx`` is the message's own position.
    """
    messages = F.col("trajectory")
    at_ = F.filter(F.transform(messages, lambda m, i: F.when(m["role"] == "assistant", i)), lambda i: i.isNotNull())
    rows = trajectories.select("*", F.posexplode(downsampled(at_, most)).alias("turn_idx", "decision_idx")).filter(F.col("decision_idx") >= LEAST_HISTORY)
    history = F.slice(messages, F.lit(1), F.col("decision_idx"))
    rows = rows.withColumn("input_segments", history_segments(history))
    return rows.select(
        F.concat("trajectory_id", F.lit("_t"), F.col("turn_idx").cast("string")).alias("sample_id"),
        "trajectory_id",
        "turn_idx",
        "decision_idx",
        F.coalesce("repo", F.lit("")).alias("repo"),
        (F.coalesce("resolved", F.lit(0)) != 0).alias("resolved"),
        "input_segments",
        target_of(F.get(messages, F.col("decision_idx"))).alias("target_action"),
        F.aggregate("input_segments", F.lit(0), lambda n, s: n + s["tokens"]).alias("total_input_tokens"),
    )


def is_meaningful(target: Column) -> Column:
    """A target that acts on its context (PF1)."""
    return F.coalesce((target["type"] == "tool_call") & target["name"].isin(*REAL_ACTIONS), F.lit(False))


def is_compressible(segments: Column, least: int = LONG_TOKENS) -> Column:
    """Whether some segment is long and not protected (PF2)."""
    return F.exists(segments, lambda s: ~s["kind"].isin(*PROTECTED_KINDS) & (s["tokens"] >= least))


def packed_lines(content: Column, limit: int) -> Column:
    """Greedy packing of lines into chunks of at most ``limit`` characters, a longer line alone.

    A fold over line sizes finds where chunks begin; text is sliced once.
    """
    lines = F.split(content, "\n", -1)
    start = F.struct(F.array().cast("array<int>").alias("cuts"), F.lit(0).alias("held"), F.lit(0).alias("i"))

    def step(acc: Column, line: Column) -> Column:
        size = F.length(line) + 1
        new = (acc["held"] > 0) & (acc["held"] + size > limit)
        return F.struct(
            F.when(new, F.array_append(acc["cuts"], acc["i"])).otherwise(acc["cuts"]).alias("cuts"),
            F.when(new, size).otherwise(acc["held"] + size).alias("held"),
            (acc["i"] + 1).alias("i"),
        )

    cuts = F.aggregate(lines, start, step)["cuts"]
    begins = F.concat(F.array(F.lit(0)), cuts)
    ends = F.concat(cuts, F.array(F.size(lines)))
    return F.zip_with(begins, ends, lambda a, b: F.array_join(F.slice(lines, a + 1, b - a), "\n"))


def split_long(segments: DataFrame, most: int = MAX_SEGMENT_TOKENS) -> DataFrame:
    """Segment rows, long ones split at lines; ``seg_id`` gets the number of its chunk."""
    chunks = F.when(F.col("tokens") > most, packed_lines(F.col("content"), 4 * most)).otherwise(F.array("content"))
    rows = segments.withColumn("_long", F.col("tokens") > most).select("*", F.posexplode(chunks).alias("chunk", "_content"))
    return rows.withColumns(
        {
            "seg_id": F.when(F.col("_long"), F.concat("seg_id", F.lit("_c"), F.col("chunk").cast("string"))).otherwise(F.col("seg_id")),
            "content": F.col("_content"),
            "tokens": X.tokens_floor(F.col("_content")),
        }
    ).drop("_long", "_content")


def split_in_place(segments: Column, most: int = MAX_SEGMENT_TOKENS) -> Column:
    """The same over an array of segments, in order and without a shuffle."""

    def one(s: Column) -> Column:
        parts = F.transform(
            packed_lines(s["content"], 4 * most),
            lambda c, i: s.withField("seg_id", F.concat(s["seg_id"], F.lit("_c"), i.cast("string"))).withField("content", c).withField("tokens", X.tokens_floor(c)),
        )
        return F.when(s["tokens"] > most, parts).otherwise(F.array(s))

    return F.flatten(F.transform(segments, one))


def within_budget(df: DataFrame, by: list[str], budget: int = MAX_INPUT_TOKENS, pos: str = "pos", tokens: str = "tokens") -> DataFrame:
    """Rows of each sequence that a token budget keeps.

    The largest rows of the middle go first, then the largest from the third row
    on while more than four are left; ties by position.  Both greedy phases are
    prefix sums: a row goes while what went before it leaves the sum over budget.
    """
    w = Window.partitionBy(*by)
    n = F.count(F.lit(1)).over(w)
    rows = df.withColumns({"_n": n, "_total": F.sum(tokens).over(w), "_i": F.row_number().over(w.orderBy(pos)) - 1})
    head, tail = F.greatest(F.lit(2), F.expr("_n * 30 div 100")), F.greatest(F.lit(2), F.expr("_n * 50 div 100"))
    rows = rows.withColumn("_middle", (F.col("_i") >= head) & (F.col("_i") < F.col("_n") - tail))

    def gone(flag: str) -> Column:
        order = Window.partitionBy(*by, flag).orderBy(F.desc(tokens), "_i").rowsBetween(Window.unboundedPreceding, -1)
        return F.coalesce(F.sum(tokens).over(order), F.lit(0))

    rows = rows.withColumn("_before", gone("_middle"))
    rows = rows.filter(~(F.col("_middle") & (F.col("_total") - F.col("_before") > budget)))
    rows = rows.withColumns({"_total": F.sum(tokens).over(w), "_n": F.count(F.lit(1)).over(w), "_i": F.row_number().over(w.orderBy(pos)) - 1})
    rows = rows.withColumn("_free", F.col("_i") >= 2)
    rank = F.row_number().over(Window.partitionBy(*by, "_free").orderBy(F.desc(tokens), "_i"))
    rows = rows.withColumns({"_before": gone("_free"), "_rank": rank})
    dropped = F.col("_free") & (F.col("_total") - F.col("_before") > budget) & (F.col("_rank") <= F.col("_n") - 4)
    return rows.filter(~dropped).drop("_n", "_total", "_i", "_middle", "_before", "_free", "_rank")


def collected(rows: DataFrame, by: list[str], pos: str = "pos") -> DataFrame:
    """Segment rows back to one array a sequence, in order."""
    fields = [c for c in rows.columns if c not in by and c != pos]
    return rows.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list(F.struct(pos, *fields))), lambda s: F.struct(*(s[f].alias(f) for f in fields))).alias("segments"))


def labelled(sample_rows: DataFrame) -> DataFrame:
    """Samples with refined kinds, levels and stale segments, all inside the row."""
    refined = F.transform("input_segments", lambda s: s.withField("kind", X.refine_result(s["kind"], s["content"])))
    rows = levels.with_stale_positions(sample_rows.withColumn("input_segments", refined), "input_segments", "_stale")
    return rows.withColumns(
        {
            "token_labels": levels.label_segments("input_segments", "_stale"),
            "stale_segment_ids": F.transform("_stale", lambda p: F.get("input_segments", p)["seg_id"]),
        }
    ).drop("_stale")


def blocks(df: DataFrame, text: str) -> DataFrame:
    """Rows of ``df`` with the blocks of ``text`` as ``seg_id, kind, level, content``; of equal ids the last holds (PF16)."""
    keys = [c for c in df.columns if c != text]
    rows = df.select(*keys, F.posexplode(X.parse_blocks(F.col(text))).alias("_at", "_b"))
    last = Window.partitionBy(*keys, "_b.seg_id").orderBy(F.desc("_at"))
    return rows.withColumn("_k", F.row_number().over(last)).filter("_k = 1").select(*keys, "_b.*")
