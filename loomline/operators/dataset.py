"""From trajectories to training rows: the whole offline build as one lazy plan (D9, PF12, A13, A16)."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from loomline.functions import budget, edits, spans
from loomline.functions import text as X
from loomline.operators import reports, sampling, segments

# Fixed values.
VAL_SHARE = 0.05
INTENT_CHARS = 2000


def prepared(trajectories: DataFrame, most_tokens: int = segments.MAX_INPUT_TOKENS) -> DataFrame:
    """Samples with a real target and something to compress, split, truncated and labelled.

    The cheap filter on the target comes first; only samples over the token budget
    leave the row for truncation.
    """
    rows = segments.samples(trajectories).filter(segments.is_meaningful(F.col("target_action")))
    rows = rows.withColumn("input_segments", segments.split_in_place(F.col("input_segments")))
    rows = rows.filter(segments.is_compressible(F.col("input_segments")))
    total = F.aggregate("input_segments", F.lit(0), lambda n, s: n + s["tokens"])
    rows = rows.withColumns({"total_input_tokens": total, "was_truncated": total > most_tokens})
    long = rows.filter("was_truncated").select("sample_id", F.posexplode("input_segments").alias("pos", "s"))
    kept = segments.within_budget(long.select("sample_id", "pos", "s", F.col("s.tokens").alias("tokens")), ["sample_id"], most_tokens)
    cut = kept.groupBy("sample_id").agg(F.array_sort(F.collect_list(F.struct("pos", "s"))).alias("_cut"))
    rows = rows.join(cut, "sample_id", "left").withColumn("input_segments", F.coalesce(F.transform("_cut", lambda x: x["s"]), "input_segments")).drop("_cut")
    return segments.labelled(rows.withColumn("total_input_tokens", total).filter(segments.is_compressible(F.col("input_segments"))))


def with_spans(samples: DataFrame) -> DataFrame:
    """``must_keep_spans`` of all segments of a sample, each with its ``seg_id``."""
    rows = samples.select("sample_id", F.posexplode("input_segments").alias("pos", "s"))
    found = rows.select("sample_id", "pos", F.col("s.seg_id").alias("seg_id"), F.explode(spans.must_keep(F.col("s.content"), F.col("s.kind"))).alias("m"))
    flat = F.struct("pos", F.col("m.start").alias("start"), "seg_id", F.col("m.end").alias("end"), F.col("m.kind").alias("kind"), F.col("m.text").alias("text"))
    own = found.groupBy("sample_id").agg(F.array_sort(F.collect_list(flat)).alias("must_keep_spans"))
    return samples.join(own, "sample_id", "left").withColumn("must_keep_spans", F.coalesce("must_keep_spans", F.slice(F.array(F.struct(F.lit(0).alias("pos"), F.lit(0).alias("start"), F.lit("").alias("seg_id"), F.lit(0).alias("end"), F.lit("").alias("kind"), F.lit("").alias("text"))), 1, 0)))


def stratum() -> Column:
    """Length bucket, target action and outcome of a sample."""
    return F.concat_ws("|", budget.length_bucket(F.col("total_input_tokens")), F.coalesce("target_action.name", F.lit("other")), F.col("resolved").cast("string"))


def sft_rows(samples: DataFrame, system: str) -> DataFrame:
    """``messages`` and ``metadata`` of labelled samples with spans.

    A segment without a label counts as L2; hints list the most frequent spans of
    each kind in slots by diversity.
    """
    level = F.map_from_entries(F.transform("token_labels", lambda x: F.struct(x["seg_id"], x["level"])))
    rows = samples.withColumn("_level", level)
    block = F.transform("input_segments", lambda s: X.segment_block(s["seg_id"], s["kind"], F.coalesce(F.try_element_at("_level", s["seg_id"]), F.lit("L2")), s["content"]))
    must = F.floor(F.aggregate("must_keep_spans", F.lit(0), lambda n, s: n + F.length(s["text"])) / 4).cast("int")
    rows = rows.withColumns({"_context": F.array_join(block, "\n\n"), "_budget": budget.compression_budget(F.col("total_input_tokens"), must)})
    flat = samples.select("sample_id", F.posexplode("must_keep_spans").alias("pos", "m")).select("sample_id", F.col("m.kind").alias("kind"), F.col("m.text").alias("text"), "pos")
    hints = reports.hint_lines(flat, "sample_id", budget.hint_slots)
    line = F.struct("kind", F.concat(F.lit("- "), "kind", F.lit(": "), "hints").alias("line"))
    told = hints.groupBy("sample_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["line"]), "\n").alias("_hints"))
    rows = rows.join(told, "sample_id", "left")
    user = F.concat(
        F.lit("### COMPRESSION TASK\nBudget: "), F.col("_budget").cast("string"), F.lit(" tokens\nMust keep:\n"), F.coalesce("_hints", F.lit("(none specified)")),
        F.lit("\n\n### INPUT TO COMPRESS\n```input_data\n"), F.col("_context"), F.lit("\n```\n\n### COMPRESSED OUTPUT\n"),
    )
    message = lambda role, content: F.struct(F.lit(role).alias("role"), content.alias("content"))
    metadata = F.struct(
        "sample_id", "trajectory_id", "repo", "resolved", F.col("_budget").alias("compression_budget"), F.col("total_input_tokens").alias("original_tokens"), F.size("input_segments").alias("n_segments"),
        F.size("must_keep_spans").alias("n_must_keep"), F.size("stale_segment_ids").alias("n_stale"), "was_truncated", F.col("target_action.name").alias("target_action_name"),
        budget.length_bucket(F.col("total_input_tokens")).alias("length_bucket"),
    )
    return rows.select(F.array(message("system", F.lit(system)), message("user", user)).alias("messages"), metadata.alias("metadata"))


def built(trajectories: DataFrame, system: str, train: int, val: int, seed: int = 42) -> DataFrame:
    """Training and validation rows: filter, split by trajectory, sample by stratum, assemble.

    Sampling works on keys; only chosen samples are joined back and assembled.  The
    labelled samples are read by several branches, so they are cached, and spill;
    ``spark.catalog.clearCache()`` frees them.
    """
    samples = with_spans(prepared(trajectories))
    reason = budget.reject_reason(F.col("total_input_tokens"), F.size("input_segments"), F.size("must_keep_spans"))
    samples = samples.filter(reason == "ok").withColumn("stratum", stratum()).cache()
    keys = sampling.split_by_group(samples.select("sample_id", "trajectory_id", "stratum"), "trajectory_id", VAL_SHARE, seed)
    chosen = [sampling.stratified(keys.filter(F.col("split") == s).select("sample_id", "stratum"), ["stratum"], "sample_id", n, seed + 1).select("sample_id", F.lit(s).alias("split")) for s, n in (("train", train), ("val", val))]
    picked = chosen[0].unionAll(chosen[1])
    rows = sft_rows(samples.join(picked.select("sample_id"), "sample_id", "left_semi").drop("stratum"), system)
    return rows.join(picked, F.col("metadata.sample_id") == picked["sample_id"]).drop("sample_id")


def segment_pool(samples: DataFrame, kinds: tuple[str, ...] | None = None, least: int = 100) -> DataFrame:
    """Segments to compress one by one, with the sample's first earlier user turn as intent (PF6, W19, D11)."""
    history = F.filter("input_segments", lambda s: s["kind"] == "user_turn_history")
    rows = samples.withColumn("user_intent", F.substring(F.get(history, 0)["content"], 1, INTENT_CHARS))
    rows = rows.select("sample_id", "repo", "user_intent", "token_labels", F.col("total_input_tokens").alias("sample_original_tokens"), F.explode("input_segments").alias("s"))
    rows = rows.filter((F.col("s.kind").isin(*kinds) if kinds else F.lit(True)) & (F.length("s.content") >= least))
    own = F.get(F.filter("token_labels", lambda x: x["seg_id"] == F.col("s.seg_id")), 0)["level"]
    return rows.select(
        F.concat("sample_id", F.lit("__"), "s.seg_id").alias("entry_id"), "sample_id", F.col("s.seg_id").alias("seg_id"), F.col("s.kind").alias("kind"), F.coalesce(own, F.lit("L2")).alias("level"), "repo",
        "user_intent", F.col("s.content").alias("original"), F.length("s.content").alias("seg_original_chars"), "sample_original_tokens",
    )


def recovered_edits(calls: DataFrame, reads: DataFrame, most: int = 8) -> DataFrame:
    """``calls(path, seq, old, new)`` with the edit mapped to the latest read of its path that takes it.

    ``reads(path, seq, content)``: the last distinct contents of a path are tried
    from the newest; ``recovered`` is null where none holds the region once.
    """
    distinct = reads.groupBy("path", X.content_id(F.col("content")).alias("id")).agg(F.max("seq").alias("seq"), F.max_by("content", "seq").alias("content"))
    latest = distinct.withColumn("k", F.row_number().over(Window.partitionBy("path").orderBy(F.desc("seq")))).filter(F.col("k") <= most)
    own = latest.groupBy("path").agg(F.transform(F.array_sort(F.collect_list(F.struct("k", "content"))), lambda x: x["content"]).alias("_sources"))
    rows = calls.join(own, "path", "left")
    return rows.withColumn("recovered", edits.recovered_first(F.col("old"), F.col("new"), F.col("_sources"))).drop("_sources")
