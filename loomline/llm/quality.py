"""Quality rules: fixed base rules and a calibrated hashed n-gram classifier.

The classifier is a logistic regression over hashed word 1- and 2-grams and
character (code point) 2- and 4-grams, learned from a bounded sample of labelled rows
and calibrated on a part of it that it did not see.  Scoring needs the weights alone:
one Arrow pass.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at

LEAST_WORDS = 50
REPEATED_PERCENT = 50
#: Calibrated probability of good quality from which a document is kept.
THRESHOLD = 0.5
#: Labelled rows to learn from, at most; drawn by a hash of doc_id.
SAMPLE = 2000
BITS = 15
EPOCHS = 150
CHARS = (2, 4)
FAMILIES = 2 + len(CHARS)

_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_NEWLINE = np.zeros(256, bool)
_NEWLINE[10] = True
#: Start of a code point: any byte but the continuations of UTF-8.
_POINT = np.ones(256, np.int64)
_POINT[128:192] = 0
#: Multiplier of a character's place in its n-gram: odd, and beyond any code point.
_CHAR = np.uint64(0x9E3779B97F4A7C15)


def _sums(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    total = np.concatenate([[0], np.cumsum(values)])
    return total[bounds[1:]] - total[bounds[:-1]]


def _repeated(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each place in ``key``: whether its value stands more than once, and whether it stood before."""
    order = np.argsort(key, kind="stable")
    s = key[order]
    same = s[1:] == s[:-1]
    again, before = np.zeros(len(key), bool), np.zeros(len(key), bool)
    before[order[1:][same]] = True
    again[order[1:][same]] = True
    again[order[:-1][same]] = True
    return again, before


@dataclass
class Block:
    """A block of texts as bytes and words, with what the rules count."""

    data: np.ndarray
    offsets: np.ndarray
    words: at.Words
    hash: np.ndarray

    @classmethod
    def of(cls, column: pa.Array) -> Block:
        data, offsets = at.raw(column)
        words = at.cut(data, offsets)
        return cls(data, offsets, words, at.span_hash(data, words.start, words.end))

    def base(self) -> dict[str, np.ndarray]:
        data, offsets, words = self.data, self.offsets, self.words
        n_docs = len(offsets) - 1
        points = np.concatenate([[0], np.cumsum(_POINT[data])])
        length = points[words.end] - points[words.start]
        n_words = np.diff(words.first)
        salt = at.mix(np.arange(1, n_docs + 1, dtype=np.uint64))
        # Lines that hold a word, equal to an earlier one of their text.
        lines = at.cut(data, offsets, _NEWLINE)
        holds = np.searchsorted(words.start, lines.start) < np.searchsorted(words.start, lines.end)
        line_doc = lines.doc[holds]
        _, before = _repeated(at.span_hash(data, lines.start[holds], lines.end[holds]) ^ salt[line_doc])
        # Words in windows of three that stand twice or more.
        window, bounds = at.windows(self.hash, words.first, 3)
        window_doc = np.repeat(np.arange(n_docs), np.diff(bounds))
        again, _ = _repeated(window ^ salt[window_doc])
        begin = (np.arange(len(window)) - bounds[window_doc] + words.first[window_doc])[again]
        covered = np.zeros(len(self.hash) + 3, bool)
        for k in range(3):
            covered[begin + k] = True
        return {
            "n_words": n_words,
            "word_chars": _sums(length, words.first),
            "n_symbols": _sums(_SYMBOL[data].astype(np.int64), offsets),
            "n_dup_lines": np.bincount(line_doc[before], minlength=n_docs),
            "n_repeat_words": _sums(covered[: len(self.hash)].astype(np.int64), words.first),
        }

    def features(self, bits: int = BITS) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Families of hashed features: buckets of all their places, and bounds by text.

        A family has its own range of buckets.  A text's value of a bucket is the
        share of its family's places that fall there, so length does not matter.
        """
        shift = np.uint64(64 - bits)
        yield (self.hash >> shift).astype(np.int64), self.words.first
        two, bounds = at.windows(self.hash, self.words.first, 2)
        yield (two >> shift).astype(np.int64) + (1 << bits), bounds
        chars = np.frombuffer(self.data.tobytes().decode().encode("utf-32-le"), np.uint32).astype(np.uint64)
        at_ = np.concatenate([[0], np.cumsum(_POINT[self.data])])[self.offsets]
        for family, k in enumerate(CHARS, 2):
            n = np.maximum(np.diff(at_) - k + 1, 0)
            bounds = np.concatenate([[0], np.cumsum(n)])
            code = np.zeros(max(len(chars) - k + 1, 0), np.uint64)
            for i in range(k):
                code = code * _CHAR + chars[i : len(code) + i]
            if len(n) > 1:  # grams that end in another text go
                code = np.concatenate([code[a : a + m] for a, m in zip(at_[:-1], n, strict=True)])
            yield ((code * at.WINDOW[k]) >> shift).astype(np.int64) + (family << bits), bounds


@dataclass
class Model:
    weights: np.ndarray
    bias: float
    slope: float  # calibration: probability = 1 / (1 + exp(-(slope * margin + shift)))
    shift: float

    def probability(self, block: Block) -> np.ndarray:
        margin = np.full(len(block.offsets) - 1, self.bias)
        for bucket, bounds in block.features():
            margin += _sums(self.weights[bucket], bounds) / np.maximum(np.diff(bounds), 1)
        return 1 / (1 + np.exp(-np.clip(self.slope * margin + self.shift, -30, 30)))


def _sparse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts as lists of buckets and their shares."""
    for block in at.blocks(batches, "text"):
        own = Block.of(block.column("text"))
        families = list(own.features())
        keys, values = [], []
        for d in range(block.num_rows):
            found = [np.unique(b[at_[d] : at_[d + 1]], return_counts=True) for b, at_ in families]
            keys.append(np.concatenate([k for k, _ in found]).astype(np.int32))
            values.append(np.concatenate([n / max(n.sum(), 1) for _, n in found]).astype(np.float32))
        yield pa.RecordBatch.from_arrays(
            [block.column("quality"), block.column("draw"), pa.array(keys, pa.list_(pa.int32())), pa.array(values, pa.list_(pa.float32()))], names=["quality", "draw", "keys", "values"]
        )


def _fit(keys: np.ndarray, values: np.ndarray, rows: np.ndarray, y: np.ndarray, size: int, epochs: int) -> tuple[np.ndarray, float]:
    """Logistic regression by AdaGrad over all rows at once; both classes weigh the same."""
    scale = np.sqrt(np.maximum(np.bincount(keys, values, size) / max(len(y), 1), 1e-6))
    x = (values / scale[keys]).astype(np.float32)  # rare buckets count as much as frequent ones
    share = np.where(y > 0, 0.5 / max(y.sum(), 1), 0.5 / max((1 - y).sum(), 1))
    w, bias, squares, bias_square = np.zeros(size), 0.0, np.full(size, 1e-8), 1e-8
    for _ in range(epochs):
        margin = np.bincount(rows, w[keys] * x, len(y)) + bias
        error = share * (1 / (1 + np.exp(-np.clip(margin, -30, 30))) - y)
        grad = np.bincount(keys, x * error[rows], size) + 1e-4 * w
        squares += grad**2
        w -= 0.1 * grad / np.sqrt(squares)
        bias_square += (g := error.sum()) ** 2
        bias -= 0.1 * g / np.sqrt(bias_square)
    return w / scale, bias


def _calibrate(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Platt scaling with smoothed targets, by Newton steps.

    The margin stays as it is, slope 1 and shift 0, where the calibration part lacks a
    class or would turn the margin round.
    """
    good, bad = y.sum(), (1 - y).sum()
    if not good or not bad:
        return 1.0, 0.0
    target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 1.0, 0.0
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(a * margin + b, -30, 30)))
        g = np.array([((p - target) * margin).sum(), (p - target).sum()])
        v = p * (1 - p) + 1e-9
        h = np.array([[(v * margin**2).sum() + 1e-3, (v * margin).sum()], [(v * margin).sum(), v.sum() + 1e-3]])
        step = np.linalg.solve(h, g)
        a, b = a - step[0], b - step[1]
        if abs(step).max() < 1e-6:
            break
    return (float(a), float(b)) if a > 0 else (1.0, 0.0)


def train(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, epochs: int = EPOCHS) -> Model | None:
    """A model from labelled rows, or None where not both classes are labelled.

    The ``sample`` rows with the least hash of doc_id are drawn, the bad class
    up to half of them; a fifth of them, by the same hash, calibrates.
    """
    own = labels.filter("quality in (0, 1) and doc_id is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("long").alias("quality"))
    own = own.groupBy("doc_id").agg(F.min("quality").alias("quality")).withColumn("draw", F.xxhash64("doc_id", F.lit("quality")))
    halves = [own.filter(F.col("quality") == q).orderBy("draw", "doc_id").limit(sample // 2) for q in (0, 1)]
    chosen = halves[0].unionAll(halves[1])
    texts = docs.filter("text is not null").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # The drawn ids are at most ``sample`` rows: a proven bound.
    drawn = texts.join(F.broadcast(chosen), "doc_id").select("text", "quality", "draw")
    rows = drawn.mapInArrow(_sparse, "quality long, draw long, keys array<int>, values array<float>").toArrow()
    order = np.lexsort((np.array([len(k) for k in rows.column("keys")]), rows.column("draw").to_numpy()))
    rows = rows.take(pa.array(order)).combine_chunks()
    y, held = rows.column("quality").to_numpy().astype(float), rows.column("draw").to_numpy() % 5 == 0
    if len(set(y[~held])) < 2:
        return None

    def part(which: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        own = rows.select(["keys", "values"]).filter(pa.array(which)).combine_chunks()
        lists = own.column("keys").chunk(0)
        counts = np.diff(lists.offsets.to_numpy())
        return lists.flatten().to_numpy().astype(np.int64), own.column("values").chunk(0).flatten().to_numpy(), np.repeat(np.arange(len(counts)), counts)

    weights, bias = _fit(*part(~held), y[~held], FAMILIES << BITS, epochs)
    if not held.any():
        return Model(weights, bias, 1.0, 0.0)
    keys, values, at_ = part(held)
    margin = np.bincount(at_, weights[keys] * values, int(held.sum())) + bias
    return Model(weights, bias, *_calibrate(margin, y[held]))


_COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def quality(docs: DataFrame, labels: DataFrame, threshold: float = THRESHOLD, **training) -> DataFrame:
    """Quality of every row of ``docs(doc_id, text, ...)``, learned from ``labels(doc_id, quality)``.

    Returns ``doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
    base_failed, kept, probability``.  Null and empty texts have no words and fail.
    Where labels do not hold both classes there is no model: the probability is
    null and the base rules decide.  Where the part of them that calibrates lacks a
    class, or contradicts the margin, the probability is the uncalibrated one.  Labels of one doc_id that differ count as bad;
    repeated documents give their own rows, those without an id a null doc_id;
    other columns are ignored; an empty table gives an empty result.
    """
    spark = docs.sparkSession
    broadcast = spark.sparkContext.broadcast(train(docs, labels, **training))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = broadcast.value
        for block in at.blocks(batches, "text"):
            own = Block.of(block.column("text"))
            base = own.base()
            n = base["n_words"]
            failed = (n < LEAST_WORDS) | (100 * base["n_repeat_words"] > REPEATED_PERCENT * n)
            p = model.probability(own) if model else None
            kept = ~failed & (p >= threshold) if model else ~failed
            columns = [block.column("doc_id"), *(pa.array(base[c].astype(np.int64)) for c in _COUNTS), pa.array(failed), pa.array(kept), pa.array(p) if model else pa.nulls(block.num_rows, pa.float64())]
            yield pa.RecordBatch.from_arrays(columns, names=["doc_id", *_COUNTS, "base_failed", "kept", "probability"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return texts.mapInArrow(run, "doc_id long, " + ", ".join(f"{c} long" for c in _COUNTS) + ", base_failed boolean, kept boolean, probability double")
