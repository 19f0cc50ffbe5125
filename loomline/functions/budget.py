"""Token budgets: length buckets, compression budgets, intent and generation caps."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values.
BUCKETS = (("short", 5000, 0.50), ("medium", 12000, 0.35), ("long", 22000, 0.25), ("xlong", None, 0.20))
LEVEL_CEILING = {"L0": 0.50, "L1": 0.35, "L2": 0.25, "L3": 0.20}
FLOOR, HEADROOM, MOST = 800, 1.5, 0.95
LEAST_TOKENS, LEAST_SEGMENTS, MOST_SEGMENTS, LEAST_SPANS = 200, 3, 150, 5
HINTS, HINTS_LEAST, HINTS_MOST = 60, 3, 12
OUTPUT_RESERVE, PROMPT_RESERVE, SAFETY = 256, 512, 1.15
GENERATION_MARGIN, GENERATION_MOST, GENERATION_LEAST = 256, 3000, 256


def whole(c: Column) -> Column:
    """Truncation towards zero."""
    return c.cast("int")


def length_bucket(tokens: Column) -> Column:
    """short, medium, long or xlong."""
    out = F.lit(BUCKETS[-1][0])
    for name, below, _ in reversed(BUCKETS[:-1]):
        out = F.when(tokens < below, name).otherwise(out)
    return out


def bucket_ratio(tokens: Column) -> Column:
    out = F.lit(BUCKETS[-1][2])
    for _, below, ratio in reversed(BUCKETS[:-1]):
        out = F.when(tokens < below, ratio).otherwise(out)
    return out


def compression_budget(tokens: Column, must_keep: Column) -> Column:
    """Share by bucket, at least the floor and room for what must stay, at most 95 % of the input."""
    least = F.greatest(whole(tokens * bucket_ratio(tokens)), F.lit(FLOOR), whole(must_keep * HEADROOM))
    return F.least(least, whole(tokens * MOST))


def reject_reason(tokens: Column, segments: Column, spans: Column) -> Column:
    """The first quality rule that a sample breaks, else ``ok`` (PF3)."""
    return (
        F.when(tokens < LEAST_TOKENS, "too_few_tokens")
        .when(segments < LEAST_SEGMENTS, "too_few_segments")
        .when(segments > MOST_SEGMENTS, "too_many_segments")
        .when(spans < LEAST_SPANS, "too_few_must_keep")
        .otherwise("ok")
    )


def hint_slots(distinct: Column, total: Column) -> Column:
    """How many hints a kind gets: its share of all, between 3 and 12."""
    return F.greatest(F.lit(HINTS_LEAST), F.least(F.lit(HINTS_MOST), F.bround(HINTS * distinct / total, 0).cast("int")))


def intent_budget(context: Column, reserved: Column) -> Column:
    """Tokens left for the intent in a model's context."""
    return F.greatest(F.lit(0), whole((context - OUTPUT_RESERVE - PROMPT_RESERVE) / SAFETY) - reserved)


def generation_cap(tokens: Column, context: Column) -> Column:
    """Tokens that a model may write for an input."""
    return F.greatest(F.lit(GENERATION_LEAST), F.least(F.least(tokens + GENERATION_MARGIN, F.lit(GENERATION_MOST)), context - tokens))


def skip_reason(tokens: Column, least: int = 512, most: int = 50_000) -> Column:
    """Why a content is too small or too large to compress, else null (PF9)."""
    return F.when(tokens < least, "below_min_tokens").when(tokens > most, "above_max_tokens")
