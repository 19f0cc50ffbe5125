"""Cross-entropy difference of matched bigram models.

A target model (documents labelled good) and a background model (all documents)
share the words of the corpus, one smoothing and, by scaling the background's
counts, one size, so they differ in nothing but the text they have seen.  A
document's score is the mean over its tokens of target loss less background loss;
lower is nearer to the target.

Both models smooth with Dirichlet priors.  With n(w) and N the counts of the corpus,
a model of counts m and M in all gives

    p(w) = (m(w) + KAPPA n(w)/N) / (M + KAPPA)
    p(w | a) = (m(a w) + MU p(w)) / (m(a) + MU)

so a loss needs the counts of a word and of a bigram and nothing else.  The counts
cover every word and bigram of every text, and none is broadcast or collected:
a task asks for those of the distinct words and bigrams in each million of its
tokens, the answers are summed where all requests for a word or bigram meet, and
go back to where the texts are.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator
from itertools import groupby

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import arrowtext as at

#: Strength of the prior of a bigram and of a word, in tokens.
MU, KAPPA = 8.0, 1000.0
#: Tokens that a task holds at once and asks for together.  A longer text is held whole.
CHUNK = 1 << 20
#: Tokens of the corpus for each bucket of requests; bounds what is summed at once.
BUCKET = 8 << 20
#: Target ids that are broadcast, 8 bytes each; more of them are joined by a shuffle.
BROADCAST_IDS = 4_000_000
#: The word before the first of a text.
START = 0x5354415254


def _packed(*fields: np.ndarray) -> bytes:
    """Fields of whole numbers from 0, of one length, compressed a byte plane after the other."""
    values = np.concatenate(fields).astype(np.int64)
    most = int(values.max(initial=0))
    size = next(s for s in (1, 2, 4, 8) if most < 1 << (8 * s - 1))
    planes = values.astype(f"<i{size}").view(np.uint8).reshape(-1, size).T.tobytes()
    return struct.pack("<qqq", len(fields), len(values), size) + pa.compress(planes, "zstd", asbytes=True)


def _unpacked(data: memoryview) -> np.ndarray:
    """A row for each field."""
    fields, n, size = struct.unpack_from("<qqq", data)
    planes = np.frombuffer(pa.decompress(bytes(data[24:]), n * size, "zstd", asbytes=True), np.uint8).reshape(size, -1)
    return np.ascontiguousarray(planes.T).view(f"<i{size}").reshape(fields, -1).astype(np.int64)


def _joined(*parts: bytes) -> bytes:
    """Parts with their sizes before them."""
    return b"".join([struct.pack(f"<{len(parts) + 1}q", len(parts), *map(len, parts)), *parts])


def _parts(data: bytes) -> list[memoryview]:
    view = memoryview(data)
    n = struct.unpack_from("<q", view)[0]
    ends = np.cumsum([8 * (n + 1), *struct.unpack_from(f"<{n}q", view, 8)])
    return [view[a:b] for a, b in zip(ends[:-1], ends[1:], strict=True)]


class Chunk:
    """Texts as numbers of their distinct words and bigrams.

    Word 0 stands before the first word of a text.  ``bounds`` are the tokens of
    each text; ``token`` is the bigram of each token, and bigram ``k`` is of the
    words ``before[k]`` and ``word[k]``.
    """

    def __init__(self, bounds: np.ndarray, words: np.ndarray, number: np.ndarray) -> None:
        self.bounds, self.words = bounds, words
        before = np.concatenate([[0], number[:-1]])[: len(number)]
        before[bounds[:-1][bounds[:-1] < bounds[1:]]] = 0
        pairs, self.token = np.unique(before * len(words) + number, return_inverse=True)
        self.before, self.word = np.divmod(pairs, len(words))
        self.pairs = at.mix(words[self.before] * at.WINDOW[0] + words[self.word] * at.WINDOW[1])

    @classmethod
    def of(cls, bounds: np.ndarray, hashes: np.ndarray) -> tuple[Chunk, np.ndarray]:
        """A chunk and the numbers of its tokens' words, most frequent words first."""
        found, where, n = np.unique(hashes, return_inverse=True, return_counts=True)
        order = np.argsort(-n, kind="stable")
        place = np.empty(len(found), np.int64)
        place[order] = np.arange(1, len(found) + 1)
        number = place[where]
        return cls(bounds, np.concatenate([np.array([START], np.uint64), found[order]]), number), number

    def counts(self, good: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """How often each word stands, and stands before another, and each bigram, in all and in good texts."""
        weight = np.repeat(good, np.diff(self.bounds)).astype(float)
        pairs = [np.bincount(self.token, minlength=len(self.pairs)), np.bincount(self.token, weight, len(self.pairs)).astype(np.int64)]
        sums = [np.bincount(side, n, len(self.words)).astype(np.int64) for side in (self.word, self.before) for n in pairs]
        return sums, pairs

    def dealt(self, buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """The words and bigrams of each bucket that has any, by key."""
        places = []
        for keys in (self.words, self.pairs):
            bucket = ((keys >> np.uint64(16)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((keys & _KEY, bucket))
            places.append((order, np.searchsorted(bucket[order], np.arange(buckets + 1))))
        (words, a), (pairs, b) = places
        for k in np.flatnonzero((a[1:] > a[:-1]) | (b[1:] > b[:-1])):
            yield int(k), words[a[k] : a[k + 1]], pairs[b[k] : b[k + 1]]


#: The bits of a hash that tell keys of a bucket apart.
_KEY = np.uint64((1 << 48) - 1)


def _told(keys: np.ndarray) -> bytes:
    """Keys of a bucket, in order, by their distances."""
    return _packed(np.diff((keys & _KEY).astype(np.int64), prepend=0))


def _marked(docs: DataFrame, target: DataFrame) -> DataFrame:
    """``doc_id, text, good`` of every document: whether its doc_id is in ``target``."""
    ids = target.select("doc_id").distinct()
    if ids.count() > BROADCAST_IDS:
        return docs.join(ids.withColumn("good", F.lit(True)), "doc_id", "left").select("doc_id", "text", F.coalesce("good", F.lit(False)).alias("good"))
    broadcast = docs.sparkSession.sparkContext.broadcast(np.sort(ids.toArrow().column(0).to_numpy()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = broadcast.value
        for batch in batches:
            doc = batch.column("doc_id").fill_null(0).to_numpy()
            found = np.zeros(len(doc), bool)
            if len(known):
                found = known[np.minimum(np.searchsorted(known, doc), len(known) - 1)] == doc
            found &= batch.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found)], names=["doc_id", "text", "good"])

    return docs.select("doc_id", "text").mapInArrow(run, "doc_id long, text string, good boolean")


def _totals(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    n = good = 0
    for block in at.blocks(batches, "text"):
        own = np.diff(at.cut(*at.raw(block.column("text"))).first)
        n += int(own.sum())
        good += int(own[block.column("good").to_numpy(zero_copy_only=False)].sum())
    yield pa.RecordBatch.from_arrays([pa.array([n]), pa.array([good])], names=["n", "n_target"])


_ROWS = "bucket long, chunk long, body binary"


def _rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = (pa.int64(), pa.int64(), pa.binary())
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)], names=["bucket", "chunk", "body"])


def _ask(buckets: int, most: int):
    """A request for each chunk and bucket, and for each chunk its texts, which have no bucket of their own.

    A request: words, their counts by field, bigrams, their counts by field.
    """

    def asked(number: int, held: list[tuple]) -> Iterator[pa.RecordBatch]:
        docs, goods, sizes, hashes = (np.concatenate(x) for x in zip(*held, strict=True))
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        own, words = Chunk.of(bounds, hashes)
        of_words, of_pairs = own.counts(goods)
        rows = []
        for bucket, a, b in own.dealt(buckets):
            rows.append((bucket, number, _joined(_told(own.words[a]), _packed(*(x[a] for x in of_words)), _told(own.pairs[b]), _packed(*(x[b] for x in of_pairs)))))
        yield _rows(rows)
        yield _rows([(-1 - number, number, _joined(docs["id"].tobytes(), docs["valid"].tobytes(), _packed(sizes), own.words[1:].tobytes(), _packed(words)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        number, held, size = TaskContext.get().partitionId() << 32, [], 0
        for block in at.blocks(batches, "text"):
            data, offsets = at.raw(block.column("text"))
            data = at.lower_ascii(data)
            words = at.cut(data, offsets)
            docs = np.zeros(block.num_rows, [("id", np.int64), ("valid", bool)])
            docs["id"] = block.column("doc_id").fill_null(0).to_numpy()
            docs["valid"] = block.column("doc_id").is_valid().to_numpy(zero_copy_only=False)
            held.append((docs, block.column("good").to_numpy(zero_copy_only=False), np.diff(words.first), at.span_hash(data, words.start, words.end)))
            size += len(words.start)
            if size >= most:
                yield from asked(number, held)
                number, held, size = number + 1, [], 0
        if held:
            yield from asked(number, held)

    return run


def _sorted(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        for row in range(batch.num_rows):
            yield tuple(batch.column(k)[row].as_py() for k in range(3))


def _summed(asked: list[tuple[np.ndarray, np.ndarray]]) -> list[bytes]:
    """For each request, ``(keys, fields)``, the sums over all requests of its keys."""
    _, where = np.unique(np.concatenate([keys for keys, _ in asked]), return_inverse=True)
    counts = np.concatenate([fields for _, fields in asked], axis=1)
    sums = np.array([np.bincount(where, field, int(where.max(initial=-1)) + 1) for field in counts]).astype(np.int64)[:, where]
    ends = np.cumsum([len(keys) for keys, _ in asked])[:-1]
    return [_packed(*x) for x in np.split(sums, ends, axis=1)]


def _answer(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Requests, a bucket after the other, to answers of the same order; texts pass through."""
    for bucket, rows in groupby(_sorted(batches), lambda r: r[0]):
        if bucket < 0:
            yield _rows(list(rows))
            continue
        chunks, words, pairs = [], [], []
        for _, chunk, body in rows:
            chunks.append(chunk)
            a, of_a, b, of_b = map(_unpacked, _parts(body))
            words.append((np.cumsum(a), of_a))
            pairs.append((np.cumsum(b), of_b))
        for chunk, *sums in zip(chunks, _summed(words), _summed(pairs), strict=True):
            yield _rows([(bucket, chunk, _joined(*sums))])


_SCORES = "doc_id long, n_tokens long, target_loss double, background_loss double, difference double"


def _score(buckets: int, n: int, n_target: int):
    """Answers and texts, a chunk after the other, to scores."""
    scale = n_target / n if n_target else 1.0

    def scored(texts: bytes, answers: dict[int, bytes]) -> pa.RecordBatch:
        ids, valid, sizes, words, number = _parts(texts)
        sizes, number = _unpacked(sizes)[0], _unpacked(number)[0]
        bounds = np.concatenate([[0], np.cumsum(sizes)])
        own = Chunk(bounds, np.concatenate([np.array([START], np.uint64), np.frombuffer(words, np.uint64)]), number)
        of_words, of_pairs = np.zeros((4, len(own.words))), np.zeros((2, len(own.pairs)))
        for bucket, a, b in own.dealt(buckets):
            of_words[:, a], of_pairs[:, b] = map(_unpacked, _parts(answers[bucket]))
        empty = sizes == 0
        prior = of_words[0] / max(n, 1)
        losses = []
        for pair, word, before, total, s in ((of_pairs[1], of_words[1], of_words[3], n_target, 1.0), (of_pairs[0], of_words[0], of_words[2], n * scale, scale)):
            p = (s * word + KAPPA * prior) / (total + KAPPA)
            each = np.log(s * before[own.before] + MU) - np.log(s * pair + MU * p[own.word])
            mean = np.zeros(len(sizes))
            if len(number):
                mean[~empty] = np.add.reduceat(each[own.token], bounds[:-1][~empty]) / sizes[~empty]
            losses.append(mean)
        doc = pa.array(np.frombuffer(ids, np.int64), mask=~np.frombuffer(valid, bool))
        columns = [doc, pa.array(sizes), *(pa.array(x, mask=empty) for x in (*losses, losses[0] - losses[1]))]
        return pa.RecordBatch.from_arrays(columns, names=["doc_id", "n_tokens", "target_loss", "background_loss", "difference"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, rows in groupby(_sorted(batches), lambda r: r[1]):
            found = {bucket: body for bucket, _, body in rows}
            yield scored(found.pop(min(found)), found)

    return run


def score(docs: DataFrame, labels: DataFrame, chunk: int = CHUNK, bucket: int = BUCKET) -> DataFrame:
    """Cross-entropy difference of every row of ``docs(doc_id, text, ...)``.

    ``labels(doc_id, quality, toxic)``: documents of quality 1 that are not toxic
    are the target.  Returns ``doc_id, n_tokens, target_loss, background_loss,
    difference`` in nats a token.  Texts without a word, and null ones, have 0
    tokens and null losses.  Without a target its model is the corpus' words alone.
    Repeated rows count and are scored each; labels that contradict each other are
    no target; other columns are ignored; an empty table gives an empty result.

    ``docs`` must be the same rows in the same order if a task of it runs again, as
    those of a table are.  ``chunk`` and ``bucket`` bound memory and change no score.
    A word or bigram is in one request a chunk, so none is hot by more than that.
    """
    own = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = (F.col("quality") == 1) & (F.coalesce("toxic", F.lit(0)) == 0)
    target = labels.filter("doc_id is not null").groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.bool_and(F.coalesce(good, F.lit(False))).alias("good")).filter("good").select("doc_id")
    marked = _marked(own, target)
    totals = marked.mapInArrow(_totals, "n long, n_target long").agg(F.sum("n"), F.sum("n_target")).first()
    n, n_target = totals[0] or 0, totals[1] or 0
    tasks = int(own.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    buckets = max(2 * tasks, -(-n // bucket))
    asked = marked.mapInArrow(_ask(buckets, chunk), _ROWS)
    answered = asked.repartition("bucket").sortWithinPartitions("bucket").mapInArrow(_answer, _ROWS)
    return answered.repartition("chunk").sortWithinPartitions("chunk").mapInArrow(_score(buckets, n, n_target), _SCORES)
