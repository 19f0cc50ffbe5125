"""Language identification by rank-order profiles of character n-grams.

A profile is a language's most frequent 1- to 3-grams of letters inside padded
words, in order of frequency.  A document takes the language whose profile is
nearest by the out-of-place distance between ranks.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import arrowtext as at

PROFILE = 400
#: More labels than this are no languages: the profiles would not be small any more.
MOST_LANGUAGES = 4096
UNKNOWN = "und"
#: Texts that are less near to every profile are in none of the languages.  On held-out
#: documents of the given tables the least score is 0.39; letter noise scores below 0.3.
LEAST_SCORE = 0.3
_FLUSH = 1_000_000


def grams(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Per text its distinct n-grams, in code point order, and their counts.

    A gram packs up to three code points in 21 bits each; 1 stands for the edge of
    a word.  Letters are lowered where that gives one letter; all else parts words.
    """
    joined = " " + " ".join(t or "" for t in texts) + " "
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.array([len(t or "") for t in texts], np.int64)
    ends = np.cumsum(lengths + 1)  # of each text, in points: the separator after it
    seen = np.zeros(int(points.max()) + 1, bool)
    seen[points] = True
    code = np.ones(len(seen), np.uint64)
    for p in np.flatnonzero(seen):
        if (c := chr(p)).isalpha():
            code[p] = ord(low) if len(low := c.lower()) == 1 else p
    values = code[points]
    keep = values > 1
    keep[1:] |= values[:-1] > 1  # one edge after a word
    keep[0] = True
    at_ = np.flatnonzero(keep)
    v = values[at_]
    bounds = np.searchsorted(at_, np.concatenate([[0], ends]), "right") - 1  # the edges about each text
    ones = v << np.uint64(42)
    twos = ones[:-1] | v[1:] << np.uint64(21)
    threes = twos[:-1] | v[2:]
    letter = v > 1
    # A gram belongs to the text of its first letter; none spans two words.
    for d in range(len(texts)):
        lo, hi = bounds[d], bounds[d + 1]
        if hi <= lo + 1 or not letter[lo : hi + 1].any():
            yield np.zeros(0, np.uint64), np.zeros(0, np.int64)
            continue
        here = letter[lo + 1 : hi + 1]
        # Each text starts at an edge (lo) and ends at one (hi).
        own = np.concatenate([ones[lo + 1 : hi + 1][here], twos[lo:hi], threes[lo : hi - 1][letter[lo + 1 : hi]]])
        yield np.unique(own, return_counts=True)


def ranked(gram: np.ndarray, count: np.ndarray, most: int) -> np.ndarray:
    """The most frequent grams, ties in code point order."""
    return gram[np.argsort(-count, kind="stable")[:most]]


def _learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list] = {}
    size = 0

    def flush() -> Iterator[pa.RecordBatch]:
        for lang, parts in held.items():
            gram, where = np.unique(np.concatenate([g for g, _ in parts]), return_inverse=True)
            count = np.bincount(where, np.concatenate([c for _, c in parts]), len(gram)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(gram), pa.string()), pa.array(gram.view(np.int64)), pa.array(count)], names=["lang", "gram", "n"])
        held.clear()

    for block in at.blocks(batches, "text"):
        langs = block.column("lang").to_pylist()
        for lang, (gram, count) in zip(langs, grams(block.column("text").to_pylist()), strict=True):
            held.setdefault(lang, []).append((gram, count))
            size += len(gram)
        if size > _FLUSH:
            yield from flush()
            size = 0
    yield from flush()


@dataclass
class Profiles:
    """All profiles: ``rank[i, k]`` is the place of ``gram[i]`` in ``langs[k]``, or ``size`` if it has none."""

    langs: list[str]
    gram: np.ndarray
    rank: np.ndarray
    size: int

    def predict(self, gram: np.ndarray, count: np.ndarray) -> tuple[str, float]:
        """The nearest language and how near it is: 1 is the same order, 0 nothing shared."""
        if not len(gram) or not self.langs:
            return UNKNOWN, 0.0
        own = ranked(gram, count, self.size)
        found = np.minimum(np.searchsorted(self.gram, own), len(self.gram) - 1)
        place = np.where((self.gram[found] == own)[:, None], self.rank[found], self.size)
        known = place < self.size
        out = np.where(known, np.abs(place - np.arange(len(own))[:, None]), self.size).sum(axis=0)
        best = int(out.argmin())
        return self.langs[best], float(1 - out[best] / (self.size * len(own)))


def learn(docs: DataFrame, size: int = PROFILE) -> Profiles:
    """Profiles of ``docs(text, lang)``; counts cover all rows given, the driver gets
    ``size`` rows a language.  Rows without text or label teach nothing."""
    counted = docs.filter("text is not null and lang is not null").select("text", F.col("lang").cast("string").alias("lang")).mapInArrow(_learn, "lang string, gram long, n long")
    counted = counted.groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    top = counted.withColumn("place", F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))).filter(F.col("place") <= size)
    rows = top.select("lang", "gram", "place").limit(size * MOST_LANGUAGES + 1).toPandas()
    if len(rows) > size * MOST_LANGUAGES:
        raise ValueError(f"more than {MOST_LANGUAGES} languages")
    langs = sorted(rows["lang"].unique())
    gram, where = np.unique(rows["gram"].to_numpy(np.int64).astype(np.uint64), return_inverse=True)
    rank = np.full((max(len(gram), 1), len(langs)), size)
    if len(rows):
        rank[where, rows["lang"].map({x: k for k, x in enumerate(langs)})] = rows["place"].to_numpy() - 1
    return Profiles(langs, gram if len(gram) else np.zeros(1, np.uint64), rank, size)


def annotate(docs: DataFrame, profiles: Profiles, pred: str = "lang_pred", score: str = "score") -> DataFrame:
    """``docs`` with the predicted language and its score, in one map pass."""
    broadcast = docs.sparkSession.sparkContext.broadcast(profiles)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = broadcast.value
        for block in at.blocks(batches, "text"):
            found = [own.predict(g, n) for g, n in grams(block.column("text").to_pylist())]
            columns = [*block.columns, pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=[*block.schema.names, pred, score])

    schema = T.StructType([*docs.schema.fields, T.StructField(pred, T.StringType()), T.StructField(score, T.DoubleType())])
    return docs.mapInArrow(run, schema)


def accepted(docs: DataFrame, size: int = PROFILE, least: float = LEAST_SCORE) -> DataFrame:
    """The rows of ``docs(doc_id, text, lang, ...)`` whose text is in a learned language.

    Profiles are learned as in :func:`identify`; the out-of-place score decides:
    texts that are nearer than ``least`` to no profile go, as do null ones and those
    without a letter.  Labels do not decide.  Where nothing was learned only the
    latter go.  Rows that repeat stay or go each; all columns stay as they are.
    """
    own = docs.withColumn("_held_out", held_out(F.col("doc_id")))
    profiles = learn(own.filter(~F.col("_held_out") & F.col("doc_id").isNotNull()), size)
    if not profiles.langs:
        return docs.filter(F.col("text").rlike(r"\p{L}"))
    marked = annotate(docs, profiles, "_lang_pred", "_lang_score")
    return marked.filter((F.col("_lang_pred") != UNKNOWN) & (F.col("_lang_score") >= least)).select(*docs.columns)


def held_out(doc_id) -> F.Column:
    """Whether a document is of the fold that nothing is learned from; null counts as not."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame, size: int = PROFILE) -> DataFrame:
    """Language of every row of ``docs(doc_id, text, lang, ...)``.

    Returns ``doc_id, held_out, lang_pred, score``, one row per input row.  It
    learns from text and non-null lang of rows whose doc_id is not null and not of
    the held-out fold; a prediction sees the text alone.  Null texts and texts
    without a letter give ``und`` and 0, as do all texts if nothing was learned.
    Ties between languages go to the first by name.  Repeated rows repeat their
    result; other columns are ignored; an empty table gives an empty result.  More
    than :data:`MOST_LANGUAGES` different labels raise ValueError: they are no
    languages, and their profiles would not be small.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"), F.col("lang"))
    own = own.withColumn("held_out", held_out(F.col("doc_id")))
    profiles = learn(own.filter(~F.col("held_out") & F.col("doc_id").isNotNull()), size)
    return annotate(own.select("doc_id", "held_out", "text"), profiles).select("doc_id", "held_out", "lang_pred", "score")
