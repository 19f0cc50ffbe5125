"""Rows whose id is among many, picked where they lie.

A join by ids would deal all rows out, whole texts with them.  Here a bitmap of
hashed ids goes to the rows, of at most ``MOST_BITS``: a row that it does not know
is certainly not among the ids and stays in place.  The rest are dealt out and
joined exactly, so a bitmap that many ids have filled costs moves and no row.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Bits for each id (a foreign one passes in 1 of so many cases), and at most (16 MB are broadcast).
BITS_AN_ID, MOST_BITS = 64, 1 << 27
#: Bits of a bitmap that Spark's aggregate makes.
_SLICE = 1 << 15


def _marked(rows: DataFrame, ids: DataFrame, column: str) -> tuple[DataFrame, Column]:
    """``rows`` and, on them, a condition that is true for all whose ``column`` is among the ids and for few others."""
    bits = min(MOST_BITS, 1 << max(_SLICE.bit_length() - 1, (BITS_AN_ID * ids.count()).bit_length()))
    at = F.pmod(F.xxhash64(F.col(column).cast("long")), F.lit(bits).cast("long"))
    place = at % _SLICE
    # Dealt by slice first: a slice is 4 KB however few ids it has, and no task sends its own of each.
    known = ids.select(F.shiftright(at, 15).alias("_slice"), place.alias("_place")).repartition("_slice")
    known = known.groupBy("_slice").agg(F.bitmap_construct_agg("_place").alias("_bits"))
    held = rows.withColumn("_slice", F.shiftright(at, 15)).join(F.broadcast(known), "_slice", "left")
    byte = F.conv(F.hex(F.substring("_bits", (F.shiftright(place, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    hit = F.coalesce(byte.bitwiseAND(F.pow(F.lit(2), place % 8).cast("int")) != 0, F.lit(False))
    return held.withColumn("_hit", hit).select(*rows.columns, "_hit"), F.col("_hit")


def likely(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """All rows whose ``column`` is among those of ``ids``, and a few others; none is moved.

    ``ids`` has that one column of whole numbers and is read twice.
    """
    held, hit = _marked(rows, ids, column)
    return held.filter(hit).drop("_hit")


def among(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is among those of ``ids``; a null is not."""
    return likely(rows, ids, column).join(ids, column, "left_semi").select(*rows.columns)


def without(rows: DataFrame, ids: DataFrame, column: str) -> DataFrame:
    """The rows whose ``column`` is not among those of ``ids``; a null is not."""
    held, hit = _marked(rows, ids, column)
    rest = held.filter(hit).join(ids, column, "left_anti").select(*rows.columns)
    return held.filter(~hit).select(*rows.columns).unionAll(rest)
