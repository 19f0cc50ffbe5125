"""Cumulative-snapshot collapse of logged conversations, then rendering.

A log that saves a conversation after every turn holds each of its prefixes too.
Rolling hashes of turn prefixes find them: a conversation whose last hash is an
inner prefix hash of another one is an earlier snapshot of it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import save

CLOSE = "\n<|end|>\n"


def _role(role):
    return F.coalesce(role, F.lit("unknown"))


def _rendered(role: Column, text: Column) -> Column:
    return F.concat(F.lit("<|"), _role(role), F.lit("|>\n"), F.coalesce(text, F.lit("")), F.lit(CLOSE))


def collapse(turns: DataFrame) -> DataFrame:
    """The maximal conversations of ``turns(conv_id, turn, role, text)``.

    Returns ``conv_id, n_turns, n_copies, rendered``: of conversations with the same
    turns the smallest conv_id stays and ``n_copies`` counts them; proper prefixes of
    longer conversations go.  Turns are ordered by ``turn``, ties by content; rows
    that repeat wholly count once.  Null roles and texts are told apart from empty
    ones.  A row without a conv_id belongs to no other row: it is a conversation of
    one turn, and ``rendered`` is its text; it is null for all others.

    A prefix hash is the exclusive or of position-salted turn hashes, 128 bits, so
    it is a running window aggregate.  Copies collapse before the anti-join, so
    both of its sides have distinct keys and no first turn or copy is hot there.
    """
    seen = F.struct(F.col("role").isNull(), F.coalesce("role", F.lit("")), F.col("text").isNull(), F.coalesce("text", F.lit("")))
    # The salt is hashed first, so the two hashes of a turn have nothing in common.
    salted = [F.xxhash64(F.lit(1), seen).alias("a"), F.xxhash64(F.lit(2), seen).alias("b")]
    prefix = [F.xxhash64("k", "a", "b"), F.xxhash64("b", "k", "a")]
    hashed = turns.filter("conv_id is not null").select("conv_id", "turn", *salted).distinct()
    order = Window.partitionBy("conv_id").orderBy("turn", "a", "b")
    placed = hashed.withColumn("k", F.row_number().over(order))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    rolling = placed.select("conv_id", "k", *(F.bit_xor(h).over(upto).alias(n) for h, n in zip(prefix, ("h1", "h2"), strict=True)), F.lead("k").over(order).isNull().alias("last"))
    lone = turns.filter("conv_id is null").select("conv_id", F.lit(1).alias("k"), *salted, _rendered(F.col("role"), F.col("text")).alias("rendered"))
    lone = lone.select("conv_id", "k", *(h.alias(n) for h, n in zip(prefix, ("h1", "h2"), strict=True)), "rendered")
    ends = rolling.filter("last").select("conv_id", "k", "h1", "h2", F.lit(None).cast("string").alias("rendered")).unionAll(lone.select("conv_id", "k", "h1", "h2", "rendered"))
    ends = ends.groupBy("h1", "h2", "k").agg(F.min("conv_id").alias("conv_id"), F.count("*").alias("n_copies"), F.max("rendered").alias("rendered"))
    inner = rolling.filter("not last").select("h1", "h2", "k").distinct()
    rendered = F.when(F.col("conv_id").isNull(), F.col("rendered"))
    return ends.join(inner, ["h1", "h2", "k"], "left_anti").select("conv_id", F.col("k").cast("long").alias("n_turns"), "n_copies", rendered.alias("rendered"))


def render(turns: DataFrame) -> DataFrame:
    """``conv_id, rendered`` of conversations: each turn between a role tag and an end tag.

    A null role is ``unknown`` and a null text is empty; rows that repeat wholly
    are rendered once.  A conversation is one row in the end, so one task holds it.
    """
    turn = F.struct("turn", "role", "text")
    parts = F.transform(F.sort_array(F.collect_set(turn)), lambda t: _rendered(t["role"], t["text"]))
    return turns.groupBy("conv_id").agg(F.array_join(parts, "").alias("rendered"))


def format_chats(turns: DataFrame) -> DataFrame:
    """Maximal conversations of ``turns(conv_id, turn, role, text, ...)``, rendered.

    Returns ``conv_id, n_turns, n_copies, rendered``; see :func:`collapse` and
    :func:`render`.  Other columns are ignored, an empty table gives no rows.
    """
    own = turns.select("conv_id", "turn", F.col("role").cast("string").alias("role"), F.col("text").cast("string").alias("text"))
    kept = save(collapse(own), "maximal")
    named = kept.filter("conv_id is not null").drop("rendered")
    mine = own.join(named.select("conv_id"), "conv_id", "left_semi")
    told = render(mine).join(named, "conv_id").select("conv_id", "n_turns", "n_copies", "rendered")
    return told.unionAll(kept.filter("conv_id is null"))


#: The same in DuckDB: prefixes are compared as whole strings.
ORACLE = """
WITH t AS (
  SELECT key, conv_id, role, text, row_number() OVER (PARTITION BY key ORDER BY turn) AS k
  FROM (
    SELECT DISTINCT CAST(conv_id AS VARCHAR) AS key, conv_id, turn, role, text FROM conversations WHERE conv_id IS NOT NULL
    UNION ALL SELECT 'row ' || row_number() OVER (), conv_id, turn, role, text FROM conversations WHERE conv_id IS NULL
  )
), p AS (
  SELECT key, conv_id, k,
    string_agg('<|' || coalesce(role, 'unknown') || '|>' || chr(10) || coalesce(text, '') || chr(10) || '<|end|>' || chr(10), '')
      OVER (PARTITION BY key ORDER BY k) AS prefix,
    k = max(k) OVER (PARTITION BY key) AS last
  FROM t
), e AS (
  SELECT min(conv_id) AS conv_id, k AS n_turns, count(*) AS n_copies, prefix AS rendered FROM p WHERE last GROUP BY prefix, k
)
SELECT conv_id, n_turns, n_copies, rendered FROM e
WHERE NOT EXISTS (SELECT 1 FROM p WHERE NOT p.last AND p.k = e.n_turns AND p.prefix = e.rendered)
"""
