"""MinHash near-duplicate detection with exact confirmation.

Plan: one Arrow pass turns every text into the minima of its 5-word shingles
under many universal hashes; texts with one shingle set collapse to a class;
bands of minima propose pairs of classes; signatures and then whole shingle sets
confirm them; components come from large-star and small-star.

A band bucket never becomes all of its pairs.  First its members are linked to
one pivot, the member that shares most buckets with others: of a group of copies
that is near the original.  Only buckets whose members still lie in different
components go on.  There, blocks of the members outside the pivot's component are
held against all of the bucket's rows, whole set by whole set in Arrow passes over
parts of the bucket, and only links leave the comparison.  Every member outside is in one block, so in the
end every pair across components has been compared, also those that the signatures
put off.  Rounds take one block, two, four and so on of every bucket: what a round
links need not be compared in the next, and rounds are few.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at
from .components import components
from .membership import likely
from .shared import drop, save

SHINGLE = 5
SIMILARITY = 75  # per cent of the union
BANDS, ROWS = 40, 4  # a pair at the threshold is missed with probability (1 - .75^4)^40 = 2e-7
#: Signatures, a byte of each minimum, that agree less are not confirmed: 5.8 standard deviations under the threshold.
SIGNATURE_LEAST = 55
#: Members of a bucket that one block holds against its rows, about, and shingles in them.
BLOCK, BLOCK_SHINGLES = 256, 1 << 20
#: Blocks that the rows of one part of a bucket make, about.
PART = 4
#: Values in more than this fraction (1 / DENSE) of all pairs go by columns of a matrix, so many at a time; the rest by so many pairs at a time.
DENSE, COLUMNS, PAIRS = 32, 1024, 1 << 20

_SIGNED = "doc_id long, n_shingles long, set_a long, set_b long, bands array<long>, minima array<tinyint>"


def _hashes(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Multipliers and addends of ``n`` universal (multiply-add-shift) hashes."""
    seed = np.arange(1, 2 * n + 1, dtype=np.uint64) * np.uint64(0x632BE59BD9B4E019)
    drawn = at.mix(seed)
    return drawn[:n] | np.uint64(1), drawn[n:]


def shingle_sets(batch: pa.RecordBatch, column: str = "text", k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct shingle hashes of each text of a block, flat, and their bounds."""
    data, offsets = at.raw(batch.column(column))
    data = at.lower_ascii(data)
    words = at.cut(data, offsets)
    h = at.span_hash(data, words.start, words.end)
    flat, bounds = at.windows(h, words.first, k)
    sets = []
    for d, n in enumerate(np.diff(words.first)):
        if n >= k:
            sets.append(np.unique(flat[bounds[d] : bounds[d + 1]]))
        elif n:
            own = h[words.first[d] : words.first[d + 1]] * at.WINDOW[k : k + n]
            sets.append(at.mix(own.sum(keepdims=True) + np.uint64(n)))
        else:
            sets.append(np.zeros(0, np.uint64))
    return np.concatenate(sets) if sets else np.zeros(0, np.uint64), np.concatenate([[0], np.cumsum([len(s) for s in sets])]).astype(np.int64)


def _lists(flat: np.ndarray, bounds: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(bounds.astype(np.int32)), pa.array(flat))


def _sign(bands: int, rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        a, b = _hashes(bands * rows)
        for block in at.blocks(batches, "text"):
            flat, bounds = shingle_sets(block)
            n = np.diff(bounds)
            full = np.flatnonzero(n)
            minima = np.zeros((bands * rows, len(full)), np.uint64)
            sums = np.zeros((2, len(n)), np.uint64)
            if len(full):
                heads, scratch = bounds[:-1][full], np.empty_like(flat)
                for i in range(bands * rows):
                    np.multiply(flat, a[i], out=scratch)
                    scratch += b[i]
                    minima[i] = np.minimum.reduceat(scratch, heads)
                sums[0, full] = np.add.reduceat(at.mix(flat), heads)
                sums[1, full] = np.add.reduceat(at.mix(flat ^ np.uint64(0x5851F42D4C957F2D)), heads)
            keys = np.zeros((len(full), bands), np.uint64)
            for band in range(bands):
                acc = np.full(len(full), band + 1, np.uint64)
                for r in range(rows):
                    acc = at.mix(acc * np.uint64(0x2545F4914F6CDD1D) + minima[band * rows + r])
                keys[:, band] = acc
            per = (n > 0).astype(np.int64)
            yield pa.RecordBatch.from_arrays(
                [
                    block.column("doc_id").cast(pa.int64()),
                    pa.array(n.astype(np.int64)),
                    pa.array(sums[0].view(np.int64)),
                    pa.array(sums[1].view(np.int64)),
                    _lists(keys.reshape(-1).view(np.int64), np.concatenate([[0], np.cumsum(per * bands)])),
                    _lists((minima >> np.uint64(56)).astype(np.uint8).T.reshape(-1).view(np.int8), np.concatenate([[0], np.cumsum(per * bands * rows)])),
                ],
                names=["doc_id", "n_shingles", "set_a", "set_b", "bands", "minima"],
            )

    return run


def _sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for block in at.blocks(batches, "text"):
        flat, bounds = shingle_sets(block)
        yield pa.RecordBatch.from_arrays([block.column("node").cast(pa.int64()), _lists(flat.view(np.int64), bounds)], names=["node", "shingles"])


def _ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The values of a list column, flat, and its bounds from 0."""
    bounds = column.offsets.to_numpy().astype(np.int64)
    return column.flatten().to_numpy(zero_copy_only=False), bounds - bounds[0]


@dataclass
class _Members:
    """Members of a bucket: ids, components, whether they are chosen, bands and whole sets."""

    node: np.ndarray
    component: np.ndarray
    own: np.ndarray
    bands: np.ndarray
    flat: np.ndarray
    bounds: np.ndarray

    def __getitem__(self, at: slice) -> _Members:
        start, stop, _ = at.indices(len(self.node))
        bounds = self.bounds[start : stop + 1]
        return _Members(self.node[at], self.component[at], self.own[at], self.bands[at], self.flat[bounds[0] : bounds[-1]], bounds - bounds[0])

    def chosen(self) -> _Members:
        size = np.diff(self.bounds)
        own = self.own
        return _Members(self.node[own], self.component[own], own[own], self.bands[own], self.flat[np.repeat(own, size)], np.concatenate([[0], np.cumsum(size[own])]))

    def blocks(self) -> Iterator[_Members]:
        """Slices of at most ``BLOCK`` members with ``BLOCK_SHINGLES`` shingles (one member at least)."""
        at = 0
        while at < len(self.node):
            to = max(at + 1, min(at + BLOCK, int(np.searchsorted(self.bounds, self.bounds[at] + BLOCK_SHINGLES, "right")) - 1))
            yield self[at:to]
            at = to


def _joined(parts: list[_Members]) -> _Members:
    if len(parts) == 1:
        return parts[0]
    starts = np.cumsum([0] + [len(p.flat) for p in parts])
    bounds = np.concatenate([[0], *(p.bounds[1:] + s for p, s in zip(parts, starts, strict=False))])
    return _Members(*(np.concatenate([getattr(p, f) for p in parts]) for f in ("node", "component", "own", "bands", "flat")), bounds)


def overlaps(x: np.ndarray, x_bounds: np.ndarray, y: np.ndarray, y_bounds: np.ndarray) -> np.ndarray:
    """How many values each of the sets ``x`` shares with each of the sets ``y``.

    A value in many sets of both sides is a column of a product of matrices, any
    other adds one to each pair that shares it.
    """
    nx, ny = len(x_bounds) - 1, len(y_bounds) - 1
    both = np.zeros(nx * ny, np.int64)
    _, word = np.unique(np.concatenate([x, y]), return_inverse=True)
    xw, yw = word[: len(x)], word[len(x) :]
    n = int(word.max(initial=-1)) + 1
    xo, yo = np.repeat(np.arange(nx), np.diff(x_bounds)), np.repeat(np.arange(ny), np.diff(y_bounds))
    x_has, y_has = np.bincount(xw, minlength=n), np.bincount(yw, minlength=n)
    often = (x_has * y_has * DENSE > nx * ny) & (nx * ny > COLUMNS)
    column = np.cumsum(often) - 1
    sides = []
    for owner, w in ((xo, xw), (yo, yw)):
        own = np.flatnonzero(often[w])
        own = own[np.argsort(column[w[own]], kind="stable")]
        sides.append((owner[own], column[w[own]]))
    for at in range(0, int(often.sum()), COLUMNS):
        dense = []
        for rows, (owner, c) in zip((nx, ny), sides, strict=True):
            a, b = np.searchsorted(c, [at, at + COLUMNS])
            dense.append(np.zeros((rows, COLUMNS), np.float32))
            dense[-1][owner[a:b], c[a:b] - at] = 1
        both += (dense[0] @ dense[1].T).astype(np.int64).reshape(-1)
    xs = np.flatnonzero((y_has[xw] > 0) & ~often[xw])
    order, first = np.argsort(yw, kind="stable"), np.concatenate([[0], np.cumsum(y_has)])
    ends = np.cumsum(y_has[xw[xs]])
    at = 0
    while at < len(xs):  # pairs by the million
        before = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, before + PAIRS, "right")))
        own, times = xs[at:to], y_has[xw[xs[at:to]]]
        nth = np.arange(ends[to - 1] - before) - np.repeat(ends[at:to] - times - before, times)
        both += np.bincount(np.repeat(xo[own] * ny, times) + yo[order[np.repeat(first[xw[own]], times) + nth]], minlength=nx * ny)
        at = to
    return both.reshape(nx, ny)


def _linked(bucket: int, held: _Members, others: _Members, similarity: int) -> tuple[np.ndarray, np.ndarray]:
    """Links across components; a pair is told in the first bucket that it shares, so that none is repeated."""
    apart = held.component[:, None] != others.component[None, :]
    if not apart.any():
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    both = overlaps(held.flat, held.bounds, others.flat, others.bounds)
    size = np.diff(held.bounds)[:, None] + np.diff(others.bounds)[None, :]
    i, j = np.nonzero(apart & (100 * both >= similarity * (size - both)))
    band = (held.bands[i] == others.bands[j]).argmax(axis=1) if len(i) else i
    told = held.bands[i, band] == bucket
    i, j = i[told], j[told]
    return np.minimum(held.node[i], others.node[j]), np.maximum(held.node[i], others.node[j])


def _met(similarity: int):
    """Compares the rows of each part of a bucket, which come first, with its own chosen ones and those that visit."""

    def links(bucket: int, held: _Members, others: _Members) -> Iterator[pa.RecordBatch]:
        for rows in held.blocks():
            for block in others.blocks():
                u, v = _linked(bucket, rows, block, similarity)
                if len(u):
                    yield pa.RecordBatch.from_arrays([pa.array(u), pa.array(v)], names=["u", "v"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, waiting, held = None, [], None
        for batch in batches:
            if not batch.num_rows:
                continue
            bucket, part, visits, node, component, own = (batch.column(k).to_numpy(zero_copy_only=False) for k in ("bucket", "part", "visits", "node", "component", "own"))
            members = _Members(node, component, own, _ragged(batch.column("bands"))[0].reshape(len(node), -1), *_ragged(batch.column("shingles")))
            new = np.flatnonzero((bucket[1:] != bucket[:-1]) | (part[1:] != part[:-1]) | (visits[1:] != visits[:-1])) + 1
            for a, b in zip([0, *new], [*new, len(node)], strict=True):
                if waiting and (visits[a] or (bucket[a], part[a]) != key):
                    held, waiting = _joined(waiting), []
                    yield from links(key[0], held, held.chosen())
                key = bucket[a], part[a]
                if visits[a]:
                    yield from links(key[0], held, members[a:b])
                else:
                    waiting.append(members[a:b])
        if waiting:
            held = _joined(waiting)
            yield from links(key[0], held, held.chosen())

    return run


def _confirmed(pairs: DataFrame, signed: DataFrame, sets: DataFrame, similarity: int) -> DataFrame:
    """The pairs ``(a, b)`` of which the signatures and then the whole sets are similar enough."""
    for side in "ab":
        pairs = pairs.join(signed.select(F.col("node").alias(side), F.col("minima").alias(f"minima_{side}")), side)
    same = F.size(F.filter(F.arrays_zip(F.col("minima_a").alias("x"), F.col("minima_b").alias("y")), lambda z: z["x"] == z["y"]))
    pairs = pairs.filter(100 * same >= SIGNATURE_LEAST * F.size("minima_a")).select("a", "b")
    for side in "ab":
        pairs = pairs.join(sets.select(F.col("node").alias(side), F.col("shingles").alias(f"set_{side}")), side)
    both = F.size(F.array_intersect("set_a", "set_b"))
    return pairs.filter(100 * both >= similarity * (F.size("set_a") + F.size("set_b") - both)).select(F.col("a").alias("u"), F.col("b").alias("v")).distinct()


def _across(rows: DataFrame, sets: DataFrame, first: int, upto: int, similarity: int) -> DataFrame:
    """Links between some blocks of the members outside and all rows of open buckets.

    ``rows``: (bucket, node, component, anchor, blocks, parts), ``sets``: (node, bands,
    shingles).  Every row is held in one part of its bucket; the chosen members
    outside also visit the other parts.
    """
    block, part = F.pmod(F.xxhash64("node"), F.col("blocks")), F.pmod(F.xxhash64("node", F.lit(1)), F.col("parts"))
    rows = rows.withColumns({"own": (F.col("component") != F.col("anchor")) & (block >= first) & (block < upto), "part": part})
    if first:  # buckets without members outside any more go
        rows = rows.join(rows.filter("own").select("bucket").distinct(), "bucket", "left_semi")
    named = ["bucket", "part", "visits", "node", "component", "own"]
    visits = rows.filter("own and parts > 1").withColumn("home", F.col("part")).withColumn("part", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)))
    met = rows.withColumn("visits", F.lit(False)).select(*named).union(visits.filter("part <> home").withColumn("visits", F.lit(True)).select(*named))
    met = met.join(sets, "node").select(*named, "bands", "shingles").repartition("bucket", "part").sortWithinPartitions("bucket", "part", "visits")
    return met.mapInArrow(_met(similarity), "u long, v long")


def _merged(label: DataFrame, found: DataFrame) -> DataFrame:
    """Labels after new links: the components that they join take the least of their names."""
    for side in "uv":
        found = found.join(label.select(F.col("node").alias(side), F.col("component").alias(f"c{side}")), side)
    moved = components(found.select(F.col("cu").alias("u"), F.col("cv").alias("v")))
    moved = moved.select(F.col("node").alias("component"), F.col("component").alias("to"))
    merged = save(label.join(moved, "component", "left").select("node", F.coalesce("to", "component").alias("component")), "labels")
    drop(label)
    return merged


def _one_a_document(rows: DataFrame, keys: DataFrame, key: list[str]) -> DataFrame:
    """``rows(doc_id, component_id, ...)`` with the components of a doc_id that has several sets as one."""
    least, most = (f(F.struct(*key)).alias(n) for f, n in ((F.min, "least"), (F.max, "most")))
    several = save(keys.filter("doc_id is not null").groupBy("doc_id").agg(least, most).filter("least <> most").select("doc_id"), "several")
    if several.isEmpty():
        drop(several)
        return rows
    held = rows.join(several, "doc_id", "left_semi").select("doc_id", "component_id").distinct()
    links = held.join(held.groupBy("doc_id").agg(F.min("component_id").alias("u")), "doc_id").select("u", F.col("component_id").alias("v"))
    moved = components(links).select(F.col("node").alias("component_id"), F.col("component").alias("_to"))
    return rows.join(_dealt(moved, "_to", "component_id"), "component_id", "left").withColumn("component_id", F.coalesce("_to", "component_id")).drop("_to")


def near_duplicates(docs: DataFrame, similarity: int = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Near-duplicate components of ``docs(doc_id, text, ...)``.

    Returns one row per input row: ``doc_id``, ``n_shingles``, ``component_id``
    (the smallest doc_id reachable over links), ``kept`` (doc_id equals
    component_id) and ``class_id`` (the smallest doc_id with the same set).

    Words are runs without ASCII white space, A-Z lowered; a text of fewer than
    five words is one shingle; a text without words, or null, has an empty set
    and stands alone.  Rows that share a doc_id are one document: the components of their
    sets are one, and all carry it.  Rows with a null doc_id take the component of their class; where the whole class has no
    id they are kept with a null component.  Other columns are ignored, an empty
    table gives an empty result.
    """
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    signed = save(texts.mapInArrow(_sign(bands, rows), _SIGNED), "signed")
    key = ["n_shingles", "set_a", "set_b"]
    classes = save(signed.filter("n_shingles > 0").groupBy(*key).agg(F.min("doc_id").alias("node")), "classes")
    own = signed.filter("n_shingles > 0").join(classes, key).filter("doc_id = node").dropDuplicates(["node", *key])
    own = save(own.select("node", F.col("n_shingles").alias("n"), "bands", "minima"), "representatives")
    thin = save(signed.select("doc_id", *key), "keys")
    drop(signed)

    members = own.select("node", F.explode("bands").alias("bucket"))
    shared = save(members.groupBy("bucket").agg(F.count("*").alias("size")).filter("size > 1"), "buckets")
    met = save(members.join(shared, "bucket"), "members")
    weight = met.groupBy("node").agg(F.sum("size").alias("weight")).join(own.select("node", "n"), "node")
    pool = save(met.join(_dealt(weight, "weight", "node"), "node").select("bucket", "node", "n", "weight"), "weighted")
    drop(met)
    drop(shared)
    pivot = save(pool.groupBy("bucket").agg(F.max_by("node", F.struct("weight", "node")).alias("pivot")), "pivots")
    paired = save(pool.join(pivot, "bucket").filter("node <> pivot"), "paired")
    wanted = save(pool.select("node").distinct(), "wanted")
    # Texts stay where they are, sets of the wanted ones are dealt out.
    sets = likely(texts.withColumnRenamed("doc_id", "node"), wanted, "node").mapInArrow(_sets, "node long, shingles array<long>")
    sets = sets.dropDuplicates(["node", "shingles"]).join(likely(own.select("node", "bands"), wanted, "node"), "node")
    sets = save(sets.join(wanted, "node", "left_semi"), "sets")
    links = _confirmed(paired.select(F.col("pivot").alias("a"), F.col("node").alias("b")).distinct(), own, sets, similarity)
    label = save(wanted.join(components(links), "node", "left").select("node", F.coalesce("component", "node").alias("component")), "labels")
    drop(own)
    drop(pool)
    drop(wanted)

    def placed(rows: DataFrame) -> DataFrame:
        """Rows of buckets with their component and that of the bucket's pivot."""
        anchors = pivot.join(label.withColumnRenamed("node", "pivot"), "pivot").select("bucket", F.col("component").alias("anchor"))
        return rows.join(label, "node").join(_dealt(anchors, "anchor", "bucket"), "bucket")

    # Only buckets with members outside their pivot's component have pairs left that matter.
    now = placed(paired.select("bucket", "node", "n"))
    room = F.greatest(F.lit(1), F.least(F.lit(BLOCK), F.floor(BLOCK_SHINGLES / F.max("n"))))
    outside = F.count_if(F.col("component") != F.col("anchor"))
    size = now.groupBy("bucket").agg(F.ceil(outside / room).cast("int").alias("blocks"), F.ceil(F.count("*") / (PART * room)).alias("parts"), (F.min("component") < F.max("component")).alias("several"))
    size = size.filter("several and blocks > 0").select("bucket", "blocks", "parts")
    left = save(now.join(_dealt(size, "blocks", "bucket"), "bucket").select("bucket", "node", "component", "anchor", "blocks", "parts"), "open")
    drop(paired)
    most, first, width = left.agg(F.coalesce(F.max("blocks"), F.lit(0))).first()[0], 0, 1
    while first < most:
        rows = placed(left.filter(F.col("blocks") > first).select("bucket", "node", "blocks", "parts")) if first else left
        found = save(_across(rows, sets, first, first + width, similarity), "across")
        if not found.isEmpty():
            label = _merged(label, found)
        drop(found)
        first, width = first + width, 2 * width
    drop(left)
    drop(sets)
    drop(pivot)

    ids = classes.join(label, "node", "left").select(*key, "node", F.coalesce("component", "node").alias("component_id"))
    out = thin.join(_dealt(ids, "node", "set_a"), key, "left")
    alone = F.col("n_shingles") == 0
    component = F.when(alone, F.col("doc_id")).otherwise(F.col("component_id"))
    out = out.select("doc_id", "n_shingles", component.alias("component_id"), F.when(alone, F.col("doc_id")).otherwise(F.col("node")).alias("class_id"))
    out = _one_a_document(out, thin, key)
    kept = F.coalesce(F.col("doc_id") == F.col("component_id"), F.col("component_id").isNull())
    return out.select("doc_id", "n_shingles", "component_id", kept.alias("kept"), "class_id")


def _dealt(df: DataFrame, *columns: str) -> DataFrame:
    """Put an exchange over an aggregate or a join, so that the next join can split a hot key.

    The columns spread evenly, and are not those of the join alone.
    """
    return df.repartition(*columns)
