"""Benchmark passages in training texts, verbatim, edited or paraphrased.

Rare word 3-grams of the test items are seeds; where a text holds one, the item
is aligned against the words about it by Smith-Waterman, which bears replaced,
missing and added words.  A 3-gram is rare by how often its words stand in the
corpus, not by its own count: a passage leaked into very many texts stays a seed.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at

SEED = 3
#: A 3-gram whose words would meet by chance less often than this is rare.
RARE = 1e-9
#: So many of an item's rarest 3-grams are seeds in any case, and the rarest of each stretch.
LEAST_SEEDS = 8
STRETCH = 10
MATCH, MISMATCH, GAP = 2, -1, -1
#: Of the score of the whole item, verbatim; or the score of a verbatim passage of 13 words.
SIMILARITY = 0.5
PASSAGE = 13 * MATCH
#: Text of test items that goes to executors at once; more items take more passes.
BLOCK = 8 << 20

_BREAKS = np.ones(256, bool)
_BREAKS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = False


def words(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (letters and digits, A-Z lowered) of each text, flat, and their bounds."""
    data, offsets = at.raw(column)
    data = at.lower_ascii(data)
    cut = at.cut(data, offsets, _BREAKS)
    return at.span_hash(data, cut.start, cut.end), cut.first


@dataclass
class Items:
    """Test items and their seeds; ``seed`` is sorted and ``seed_item``, ``seed_at`` say where each stands."""

    ids: list
    words: list[np.ndarray]
    seed: np.ndarray
    seed_item: np.ndarray
    seed_at: np.ndarray

    def __post_init__(self) -> None:
        self.sieve = np.zeros(1 << 22, bool)
        self.sieve[(self.seed >> np.uint64(42)).astype(np.int64)] = True

    def hits(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places in ``gram`` and rows of ``seed`` that agree."""
        maybe = np.flatnonzero(self.sieve[(gram >> np.uint64(42)).astype(np.int64)])
        lo, hi = np.searchsorted(self.seed, gram[maybe]), np.searchsorted(self.seed, gram[maybe], "right")
        n = hi - lo
        first = np.repeat(lo - np.concatenate([[0], np.cumsum(n)[:-1]]), n) if len(n) else lo
        return np.repeat(maybe, n), first + np.arange(int(n.sum()))


def align(item: np.ndarray, text: np.ndarray) -> tuple[int, int, int, int]:
    """The best local alignment: score, matched words, and its span in ``text``.

    One row of the table at a time, with where each path began and how many words it
    matched, so memory is a few rows of ``text`` however long both are.
    """
    n = len(text)
    places = np.arange(n + 1)
    score, begin, matched = np.zeros(n + 1, np.int64), places.copy(), np.zeros(n + 1, np.int64)
    best = (0, 0, 0, 0)
    for word in item:
        same = text == word
        diagonal, down = score[:-1] + np.where(same, MATCH, MISMATCH), score[1:] + GAP
        row, from_, hits = np.zeros(n + 1, np.int64), places.copy(), np.zeros(n + 1, np.int64)
        row[1:] = np.maximum(np.maximum(diagonal, down), 0)
        goes = np.flatnonzero(row[1:] > 0)  # a path at 0 begins anew
        across = diagonal[goes] >= down[goes]
        source = goes + ~across  # the place before in the row above, or the same
        from_[goes + 1], hits[goes + 1] = begin[source], matched[source] + (across & same[goes])
        # Gaps in the item: the best of all places to the left, less what the gap costs.
        ramp = row - places * GAP
        upto = np.maximum.accumulate(ramp)
        source = np.maximum.accumulate(np.where(ramp == upto, places, 0))
        score, begin, matched = upto + places * GAP, from_[source], hits[source]
        j = int(score.argmax())
        if score[j] > best[0]:
            best = int(score[j]), int(matched[j]), int(begin[j]), j
    return best


def leaks(items: Items, word: np.ndarray, first: np.ndarray, similarity: float) -> Iterator[tuple]:
    """``(text, item, seeds, score, similarity, matched, start, end)`` of a block, the best of each text and item."""
    gram, bounds = at.windows(word, first, SEED)
    place, row = items.hits(gram)
    if not len(place):
        return
    text = np.searchsorted(bounds, place, "right") - 1
    item, begin = items.seed_item[row], place - bounds[text] - items.seed_at[row]
    order = np.lexsort((begin, item, text))
    text, item, begin = text[order], item[order], begin[order]
    size = np.array([len(w) for w in items.words])[item]
    new = np.ones(len(text), bool)  # hits of one text and item that start near each other share an alignment
    new[1:] = (text[1:] != text[:-1]) | (item[1:] != item[:-1]) | (begin[1:] - begin[:-1] > size[1:])
    heads = np.flatnonzero(new)
    best: dict[tuple[int, int], tuple] = {}
    for a, b in zip(heads, [*heads[1:], len(text)], strict=True):
        d, k, n = int(text[a]), int(item[a]), int(size[a])
        own = word[first[d] : first[d + 1]]
        lo, hi = max(0, int(begin[a]) - n // 2), min(len(own), int(begin[b - 1]) + n + n // 2)
        score, matched, start, end = align(items.words[k], own[lo:hi])
        share = score / (MATCH * n)
        if (share >= similarity or score >= PASSAGE) and (best.get((d, k)) is None or best[d, k][3] < score):
            best[d, k] = (d, k, b - a, score, share, matched, lo + start, lo + end)
    yield from best.values()


def _blocks(benchmark: DataFrame) -> Iterator[tuple[list, pa.Array]]:
    """Test items in blocks of bounded text."""
    own = benchmark.select("item_id", F.col("text").cast("string").alias("text")).filter("text is not null")
    total = own.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // BLOCK)
    for k in range(n):
        rows = own.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == k).orderBy("item_id", "text").collect()
        yield [r["item_id"] for r in rows], pa.array([r["text"] for r in rows], pa.string())


def _counts(docs: DataFrame, known: np.ndarray) -> tuple[np.ndarray, int]:
    """How often each of the sorted word hashes ``known`` stands in all texts, and the number of all words."""
    broadcast = docs.sparkSession.sparkContext.broadcast(known)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        n = np.zeros(len(own) + 1, np.int64)
        for block in at.blocks(batches, "text"):
            h, _ = words(block.column("text"))
            found = np.minimum(np.searchsorted(own, h), len(own) - 1)
            n[:-1] += np.bincount(found[own[found] == h], minlength=len(own))
            n[-1] += len(h)
        at_ = np.flatnonzero(n)
        yield pa.RecordBatch.from_arrays([pa.array(at_), pa.array(n[at_])], names=["k", "n"])

    counted = docs.select("text").mapInArrow(run, "k long, n long").groupBy("k").agg(F.sum("n").alias("n")).toPandas()
    n = np.zeros(len(known) + 1, np.int64)
    n[counted["k"]] = counted["n"]
    return n[:-1], int(n[-1])


def _items(docs: DataFrame, ids: list, column: pa.Array) -> Items:
    word, first = words(column)
    known = np.unique(word)
    if not len(known):
        return Items([], [], *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)))
    count, total = _counts(docs, known)
    log = np.log((count + 1) / (total + len(known)))[np.searchsorted(known, word)]
    gram, bounds = at.windows(word, first, SEED)
    seeds, own, places = [], [], []
    for k in range(len(ids)):
        own_log = log[first[k] : first[k + 1]]
        n = bounds[k + 1] - bounds[k]
        if not n:
            continue
        chance = sum(own_log[j : j + n] for j in range(SEED))
        spread = [at_ + int(chance[at_ : at_ + STRETCH].argmin()) for at_ in range(0, n, STRETCH)]
        rare = reduce(np.union1d, (np.flatnonzero(chance <= np.log(RARE)), np.argsort(chance, kind="stable")[:LEAST_SEEDS], np.array(spread, np.int64)))
        seeds.append(gram[bounds[k] + rare])
        own.append(np.full(len(rare), k))
        places.append(rare)
    if not seeds:
        return Items([], [], *(np.zeros(0, t) for t in (np.uint64, np.int64, np.int64)))
    seed = np.concatenate(seeds)
    order = np.argsort(seed, kind="stable")
    return Items(ids, [word[first[k] : first[k + 1]] for k in range(len(ids))], seed[order], np.concatenate(own)[order], np.concatenate(places)[order])


def _texts(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


_LEAKS = "n_seeds long, score long, similarity double, n_matched long, start_word long, end_word long"


def find_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """Test items of ``benchmark(item_id, text)`` found in ``docs(doc_id, text, ...)``.

    One row for each row of ``docs`` and item that align, by ``similarity`` or by a
    passage of :data:`PASSAGE`: ``doc_id, item_id, n_seeds, score, similarity`` (of
    the score of the whole item), ``n_matched`` words, ``start_word`` and ``end_word``
    in the text; the best place counts.  Two map passes over the texts for each 8 MB
    of items, and no shuffle of texts.  An alignment holds a few rows of its window,
    also where hits follow each other through a very long text.

    Null texts hold nothing; items that are null or of fewer than three words are
    no evidence and match nothing; equal items all match; repeated rows give their
    own rows, rows without an id a null doc_id.  Empty tables give no rows.
    """
    texts, kind = _texts(docs), benchmark.schema["item_id"].dataType
    schema = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("item_id", kind), *T._parse_datatype_string(_LEAKS).fields])
    out = docs.sparkSession.createDataFrame([], schema)
    for ids, column in _blocks(benchmark):
        broadcast = docs.sparkSession.sparkContext.broadcast(_items(texts, ids, column))

        def run(batches: Iterator[pa.RecordBatch], broadcast=broadcast) -> Iterator[pa.RecordBatch]:
            items = broadcast.value
            to = pa.schema([(f.name, _ARROW[f.dataType.typeName()]) for f in schema.fields])
            for block in at.blocks(batches, "text"):
                rows = list(leaks(items, *words(block.column("text")), similarity))
                doc = block.column("doc_id").to_pylist()
                rows = [(doc[d], items.ids[k], *rest) for d, k, *rest in rows]
                yield pa.RecordBatch.from_arrays([pa.array([r[i] for r in rows], f.type) for i, f in enumerate(to)], schema=to)

        out = out.unionAll(texts.mapInArrow(run, schema))
    return out


_ARROW = {"long": pa.int64(), "integer": pa.int32(), "string": pa.string(), "double": pa.float64()}


def drop_leaks(docs: DataFrame, benchmark: DataFrame, similarity: float = SIMILARITY) -> DataFrame:
    """``docs`` without the rows that hold a test item, all columns as they are.

    See :func:`find_leaks`: null texts hold nothing and stay, rows that repeat stay
    or go each, an empty table stays empty.
    """
    texts = _texts(docs)
    for ids, column in _blocks(benchmark):
        broadcast = docs.sparkSession.sparkContext.broadcast(_items(texts, ids, column))

        def run(batches: Iterator[pa.RecordBatch], broadcast=broadcast) -> Iterator[pa.RecordBatch]:
            items = broadcast.value
            for block in at.blocks(batches, "text"):
                clean = np.ones(block.num_rows, bool)
                for d, *_ in leaks(items, *words(block.column("text")), similarity):
                    clean[d] = False
                yield block.filter(pa.array(clean))

        docs = docs.mapInArrow(run, T.StructType(docs.schema.fields))
    return docs
