"""Connected components by alternating large-star and small-star; of few links in one task."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from .shared import drop, save

#: So many links at most (1 MB) are solved by one task in memory, which costs less than the stages of a round.
FEW = 1 << 16


def _dealt(df: DataFrame) -> DataFrame:
    """Put an exchange over an aggregate, so that a join on its key can split a hot key."""
    return df.repartition("m", "u")


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours point to the least node of its neighbourhood."""
    both = edges.union(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
    return both.filter("v > u").join(_dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()


def _small_star(edges: DataFrame) -> DataFrame:
    """Every node and its smaller neighbours point to the least of them."""
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
    least = down.groupBy("u").agg(F.min("v").alias("m"))
    joined = down.join(_dealt(least), "u").select(F.col("v").alias("u"), F.col("m").alias("v"))
    return joined.union(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()


def _saved(edges: DataFrame) -> tuple[DataFrame, tuple]:
    """The edges as a table, and their number and checksums, told by the job that wrote it."""
    seen = Observation()
    told = edges.observe(seen, F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("u", "v")).alias("a"), F.bit_xor(F.xxhash64("v", "u")).alias("b"))
    out = save(told, "links")
    got = seen.get
    return out, (got["n"], got["a"], got["b"])


def _together(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Every node of all links that the task gets, and the least node reachable."""
    pieces = [(b.column("u").to_numpy(), b.column("v").to_numpy()) for b in batches]
    if not pieces:
        return
    u, v = (np.concatenate(x) for x in zip(*pieces, strict=True))
    node, at = np.unique(np.concatenate([u, v]), return_inverse=True)
    u, v = at[: len(u)], at[len(u) :]
    least = np.arange(len(node))
    while (least[u] != least[v]).any():
        low = np.minimum(least[u], least[v])
        for side in (least[u], least[v]):
            np.minimum.at(least, side, low)
        while (least[least] != least).any():
            least = least[least]
    yield pa.RecordBatch.from_arrays([pa.array(node), pa.array(node[least])], names=["node", "component"])


def components(links: DataFrame) -> DataFrame:
    """``links(u, v)`` of 64-bit nodes to ``(node, component)``, the least node reachable.

    Only nodes with a link are returned; self links and repeated links are
    harmless, no links give no rows.  Each half round is one join on a node,
    whose hot keys can be split; the edge list is written to the shared folder
    after a round, and only its size and checksum reach the driver.  ``FEW`` links
    or less take one task instead of rounds.
    """
    edges, before = _saved(links.filter("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    if before[0] <= FEW:
        return edges.coalesce(1).mapInArrow(_together, "node long, component long")
    while before[0]:
        after, state = _saved(_small_star(_large_star(edges)))
        drop(edges)
        edges = after
        if state == before:
            break
        before = state
    own = edges.select(F.col("u").alias("node"), F.col("v").alias("component"))
    return own.union(edges.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
