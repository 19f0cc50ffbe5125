"""Keyed state across requests as streaming queries (ST1-ST7).

Each operator takes a stream (or a table, for the batch form) and returns one;
:func:`run_once` drives it to the end of what is there.  State holds a bounded
number of ids for each key, never contents.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import Any

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

HISTORY, SAMPLES = 8, 6


def stream(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A stream of the parquet files of a folder."""
    return spark.readStream.schema(schema).parquet(path)


def run_once(df: DataFrame, out: str, checkpoint: str, mode: str = "append") -> DataFrame:
    """Run a streaming query over what is there now, to parquet files, and read them."""
    spark = df.sparkSession
    query = df.writeStream.outputMode(mode).format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def run_totals(df: DataFrame, out: str, checkpoint: str) -> DataFrame:
    """Run an aggregating query in complete mode; each batch replaces the table."""
    spark = df.sparkSession

    def replace(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite").parquet(out)

    query = df.writeStream.outputMode("complete").foreachBatch(replace).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.read.schema(df.schema).parquet(out)


def first_sightings(events: DataFrame, keys: list[str], time: str, delay: str) -> DataFrame:
    """The first row of each key: a cache write; later ones are reads (ST7, ST1)."""
    return events.withWatermark(time, delay).dropDuplicates(keys)


def totals(events: DataFrame, by: list[str], **sums: str) -> DataFrame:
    """Running sums by key (ST5)."""
    return events.groupBy(*by).agg(F.count(F.lit(1)).alias("n"), *(F.sum(c).alias(name) for name, c in sums.items()))


def _ordered(frames: Iterable[pd.DataFrame], order: str) -> pd.DataFrame:
    return pd.concat(list(frames)).sort_values(order, kind="stable")


def last_distinct(key: str, item: str, order: str, most: int = HISTORY):
    """State function: the last distinct items of a key, a repeated one moves to the end (ST2, ST6, W13)."""

    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: list[Any] = list(state.get[0]) if state.exists else []
        for x in _ordered(frames, order)[item]:
            held = [h for h in held if h != x][-(most - 1) :] + [x]
        state.update((held,))
        yield pd.DataFrame({key: [keys[0]], "items": [held]})

    return run


def path_history(reads: DataFrame, key: str, item: str, order: str, most: int = HISTORY) -> DataFrame:
    """After each batch, the last ``most`` distinct items of each key it touched (ST2)."""
    kind = reads.schema[item].dataType.simpleString()
    out = f"{key} {reads.schema[key].dataType.simpleString()}, items array<{kind}>"
    return reads.select(key, item, order).groupBy(key).applyInPandasWithState(last_distinct(key, item, order, most), out, f"items array<{kind}>", "append", GroupStateTimeout.NoTimeout)


def _frozen(key: str, order: str, offered: str, chosen: str, least: int):
    def run(keys: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held = list(state.get[0]) if state.exists else []
        rows = []
        for _, row in _ordered(frames, order).iterrows():
            here = set(row[offered])
            kept = [n for n in held if n in here]
            if not kept:  # nothing chosen before is offered any more
                kept = list(row[chosen])
                held = kept if len(row[offered]) > least else held
            rows.append((keys[0], row[order], kept))
        state.update((held,))
        yield pd.DataFrame(rows, columns=[key, order, "selection"])

    return run


def frozen_selection(requests: DataFrame, key: str, order: str, offered: str, chosen: str | None = None, least: int = 0) -> DataFrame:
    """The first selection of a session serves its later requests as far as it is still offered (ST4).

    ``chosen``: what a selection takes of the ``offered`` names, by place; all of
    them if not given.  Requests with ``least`` tools or fewer freeze nothing.
    """
    chosen = chosen or offered
    out = f"{key} {requests.schema[key].dataType.simpleString()}, {order} {requests.schema[order].dataType.simpleString()}, selection array<string>"
    rows = requests.select(key, order, *dict.fromkeys((offered, chosen)))
    return rows.groupBy(key).applyInPandasWithState(_frozen(key, order, offered, chosen, least), out, "names array<string>", "append", GroupStateTimeout.NoTimeout)


def windowed(events: DataFrame, time: str, window: str, delay: str, *by: str) -> DataFrame:
    """Counts by event-time window; an addition beyond keyed state."""
    rows = events.withWatermark(time, delay).groupBy(F.window(time, window), *by).agg(F.count(F.lit(1)).alias("n"))
    return rows.select(F.col("window.start").alias("start"), *by, "n")
