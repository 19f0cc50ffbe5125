"""Packing of tokenised documents into sequences by minimum bin slack.

Every task tokenises its own split and cuts full windows off long documents.  What
remains of each document is dealt over pools of some ten thousand remainders, each
packed by a bitset subset-sum over the counts of remaining lengths: the largest
length opens a window and the multiset that leaves the least slack joins it.
"""

from __future__ import annotations

import re
import zlib
from collections import defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 1024
#: Remainders of a pool, about: 4 KB each at most.  Enough of them for windows without slack.
POOL = 1 << 15
#: A window is emitted with this share of slack at most; what would leave more is cut.
SLACK = 1 / 128

_PIECES = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


#: The tokenizer's own split of text before merges, as its byte-level pre-tokenizer does it.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


class Encoder:
    """Token ids of a byte-level BPE tokenizer file, as little-endian unsigned 32-bit bytes.

    A byte-level vocabulary lists its tokens in the order of their merges, so its
    ids serve as ranks, and a rank encoder gives the same ids at a fifth of the
    time.  It is quadratic in a word's length, and knows no special tokens; texts
    with enormous words or with the string of an added token take the tokenizer itself.
    """

    _blank = re.compile(r"\s{1000}")

    def __init__(self, path: str) -> None:
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        special = set(added)
        self.added = re.compile("|".join(re.escape(t.content) for t in added.values()) or r"(?!)")
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]  # bytes that stand for themselves in the file
        hidden = [b for b in range(256) if b not in set(plain)]
        byte = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(hidden)}
        ranks = {bytes(byte[c] for c in token): k for token, k in self.tokenizer.get_vocab().items() if k not in special}
        self.fast = tiktoken.Encoding("ranks", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})

    def __call__(self, text: str) -> bytes:
        long = len(text) >= 1000 and (max(map(len, text.split()), default=0) >= 1000 or self._blank.search(text))
        if long or self.added.search(text):
            return np.array(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


def fill(counts: dict[int, int], target: int) -> list[tuple[int, int]]:
    """The multiset of available lengths whose sum comes closest to ``target`` from below.

    Lengths enter from the largest; ``reach`` has bit s set where s is a sum of
    those so far, so one shift and or adds a copy.  It stops as soon as the target
    is a sum.  Backtracking the stored bitsets gives the count of each length.
    """
    mask, reach = (1 << (target + 1)) - 1, 1
    steps = [(0, reach)]
    for length in sorted((x for x in counts if 0 < x <= target), reverse=True):
        for _ in range(min(counts[length], target // length)):
            wider = (reach | reach << length) & mask
            if wider == reach:
                break
            steps.append((length, reach := wider))
        if reach >> target & 1:
            break
    total, used = reach.bit_length() - 1, defaultdict(int)
    for k in range(len(steps) - 1, 0, -1):
        length, _ = steps[k]
        if not steps[k - 1][1] >> total & 1:
            used[length] += 1
            total -= length
    return list(used.items())


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> Iterator[tuple[list[tuple[int, int]], int]]:
    """Patterns of lengths and how many windows take each, until no length is left.

    The largest length opens a window and :func:`fill` picks its company; the
    pattern repeats as often as the counts allow, so the number of patterns is
    bounded by the number of distinct lengths, not of documents.
    """
    left = {k: n for k, n in counts.items() if n and k}
    while left:
        most = max(left)
        left[most] -= 1
        pattern = dict(fill({k: n for k, n in left.items() if n}, capacity - most))
        left[most] += 1
        pattern[most] = pattern.get(most, 0) + 1
        times = min(left[k] // n for k, n in pattern.items())
        for k, n in pattern.items():
            left[k] -= n * times
            if not left[k]:
                del left[k]
        yield sorted(pattern.items(), reverse=True), times


def powers(n: int) -> list[int]:
    """The powers of two that sum to ``n``, largest first."""
    return [1 << b for b in range(n.bit_length() - 1, -1, -1) if n >> b & 1]


def cut(doc_id, ids: bytes, sequence: int, capacity: int) -> tuple[list[tuple], bytes]:
    """The full windows of a document, the first of number ``sequence``, and what remains."""
    n = len(ids) // 4
    whole = n // capacity * capacity
    rows = []
    for k, start in enumerate(range(0, whole, capacity)):
        rows.append((doc_id, start, capacity, zlib.crc32(ids[4 * start : 4 * (start + capacity)]), n, sequence + k, 0))
    return rows, ids[4 * whole :]


def windows(remainders: list[tuple], capacity: int = CAPACITY) -> Iterator[list[tuple]]:
    """Remainders ``(doc_id, start, ids, doc_tokens)`` in windows, for one result whatever their order.

    Lengths that only make windows with more slack than :data:`SLACK` are laid end
    to end and cut at the capacity; the last ids take windows of powers of two.
    """
    pool: dict[int, list[tuple]] = defaultdict(list)
    for r in sorted(remainders, key=lambda r: (r[0] is not None, r[0] or 0, *r[1:])):
        pool[len(r[2]) // 4].append(r)
    left: list[tuple] = []
    for pattern, times in plan({k: len(v) for k, v in pool.items()}, capacity):
        slack = capacity - sum(k * n for k, n in pattern)
        for _ in range(times):
            pieces = [pool[k].pop() for k, n in pattern for _ in range(n)]
            if slack <= SLACK * capacity:
                yield pieces
            else:
                left += pieces
    total = sum(len(p[2]) // 4 for p in left)
    left.reverse()
    for size in [capacity] * (total // capacity) + powers(total % capacity):
        pieces, room = [], size
        while room:
            doc_id, start, ids, n = left.pop()
            take = min(room, len(ids) // 4)
            pieces.append((doc_id, start, ids[: 4 * take], n))
            if 4 * take < len(ids):
                left.append((doc_id, start + take, ids[4 * take :], n))
            room -= take
        yield pieces


_NAMES = ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"]


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([r[k] for r in rows], pa.int64()) for k in range(len(_NAMES))], names=_NAMES)


def _cut(path: str, end: int, capacity: int):
    """Pieces of full windows, and with ``ids`` in place of a sequence what remains of each document."""

    def told(rows: list[tuple]) -> pa.RecordBatch:
        ids = pa.array([r[7] for r in rows], pa.binary())
        return pa.RecordBatch.from_arrays([*_batch(rows).columns, ids, pa.array([r[8] for r in rows], pa.int64())], names=[*_NAMES, "ids", "draw"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from pyspark import TaskContext

        encode, tail = Encoder(path), np.array([end], "<u4").tobytes()
        first = sequence = TaskContext.get().partitionId() << 32
        rows, number, held = [], first, 0
        for batch in batches:
            for row in range(batch.num_rows):
                doc_id, number = batch.column(0)[row].as_py(), number + 1
                ids = encode(batch.column(1)[row].as_py() or "") + tail
                full, rest = cut(doc_id, ids, sequence, capacity)
                sequence += len(full)
                rows += [(*r, None, number) for r in full]
                if rest:
                    rows.append((doc_id, len(ids) // 4 - len(rest) // 4, None, None, len(ids) // 4, None, None, rest, number))
                    held += len(rest)
                if len(rows) >= 20_000 or held >= 8 << 20:
                    yield told(rows)
                    rows, held = [], 0
        yield told(rows)

    return run


def _pack(capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        remainders = []
        for batch in batches:
            full = batch.filter(batch.column("ids").is_null())
            yield full.select(_NAMES)
            rest = batch.filter(batch.column("ids").is_valid()).select(["doc_id", "start", "ids", "doc_tokens"])
            remainders += zip(*(rest.column(k).to_pylist() for k in range(4)), strict=True)
        rows, sequence = [], 1 << 62 | TaskContext.get().partitionId() << 32
        for pieces in windows(remainders, capacity):
            offset = 0
            for doc_id, start, ids, n in pieces:
                rows.append((doc_id, start, len(ids) // 4, zlib.crc32(ids), n, sequence, offset))
                offset += len(ids) // 4
            sequence += 1
            if len(rows) >= 20_000:
                yield _batch(rows)
                rows = []
        yield _batch(rows)

    return run


def pack(docs: DataFrame, tokenizer: str, end_id: int = 0, capacity: int = CAPACITY, pool: int = POOL) -> DataFrame:
    """Packs ``docs(doc_id, text, ...)`` into sequences of at most ``capacity`` ids.

    ``tokenizer`` is the path of a tokenizer file that executors can read.  Every
    document is its ids and then ``end_id``; null text counts as empty, so it is
    the end id alone.  One row per piece: ``doc_id, start, length, ids_crc32,
    doc_tokens, sequence_id, offset``.  A sequence holds ``capacity`` ids, or up to
    :data:`SLACK` of it less, or a power of two.  Rows that repeat, share a doc_id
    or have none are packed as documents of their own; no rows give no rows.

    One shuffle, of the remainders' ids, into pools by row number, so no key is hot;
    a pool is sorted before it is packed, so a task that runs again gives the same
    rows as long as ``docs`` has the same rows in the same order, as a table has.
    """
    if capacity & (capacity - 1):
        raise ValueError("capacity must be a power of two")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pools = max(1, -(-texts.count() // pool))
    pieces = texts.mapInArrow(_cut(tokenizer, end_id, capacity), f"{_PIECES}, ids binary, draw long")
    return pieces.repartition(pools, "draw").mapInArrow(_pack(capacity), _PIECES)
