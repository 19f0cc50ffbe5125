"""Pieces against the tokenizer itself, and the plan against exhaustive search."""

import random
import struct
import zlib
from collections import Counter, defaultdict
from itertools import product

import public_tokenizers
from tokenizers import Tokenizer

from loomline.llm.packing import CAPACITY, POOL, SLACK, Encoder, cut, fill, pack, plan, powers, windows

PATH = public_tokenizers.path("byte_bpe_50k.json")
#: The contract's tokenizer, as it is.
PLAIN = Tokenizer.from_file(PATH)


def ids_of(text):
    return PLAIN.encode(text or "", add_special_tokens=False).ids


def test_fill_is_optimal():
    rng = random.Random(7)
    for _ in range(60):
        counts = {rng.randrange(1, 20): rng.randrange(1, 4) for _ in range(4)}
        target = rng.randrange(1, 50)
        used = dict(fill(counts, target))
        assert all(0 < n <= counts[k] for k, n in used.items())
        sums = (sum(k * n for k, n in zip(counts, ns, strict=True)) for ns in product(*(range(c + 1) for c in counts.values())))
        assert sum(k * n for k, n in used.items()) == max(s for s in sums if s <= target)


def test_plan_uses_everything_once():
    rng = random.Random(8)
    counts = {rng.randrange(1, 1024): rng.randrange(1, 500) for _ in range(300)}
    used, windows = Counter(), 0
    for pattern, times in plan(counts):
        assert sum(k * n for k, n in pattern) <= 1024
        windows += times
        for k, n in pattern:
            used[k] += n * times
    assert used == counts
    assert windows <= sum(k * n for k, n in counts.items()) / 1024 * 1.02 + 2
    assert [sum(powers(n)) for n in (0, 1, 700, 1023)] == [0, 1, 700, 1023]


ODD = ["hello <|endoftext|> world", "<|endoftext|><|endoftext|>", "a <|endoftext |> <|endoftex", "a" * 5000, " " * 3000 + "x", "<|endoftext|> x  y\n\n z", "日本語 テスト 😀 é", "\x1c \x85 a  b", "", " ", "it's 123abc!!! \t\n  foo", "a b  \nc", "x \n y", "  \nb"]


def test_ids_are_the_tokenizers():
    encode = Encoder(PATH)
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("ab '.\n\t 1é！") for _ in range(rng.randrange(60))) for _ in range(500)]
    for text in texts:
        ids = ids_of(text)
        assert encode(text) == struct.pack(f"<{len(ids)}I", *ids), text


def check(rows, documents):
    pieces, sequences = defaultdict(list), defaultdict(list)
    for r in rows:
        pieces[r["doc_id"]].append(r)
        sequences[r["sequence_id"]].append(r)
    for ids in sequences.values():
        ids.sort(key=lambda r: r["offset"])
        total = 0
        for r in ids:
            assert r["offset"] == total
            total += r["length"]
        assert (1 - SLACK) * 1024 <= total <= 1024 or total & (total - 1) == 0 and total < 1024
    for doc_id, texts in documents.items():
        expected = Counter()
        own = [ids_of(t) + [0] for t in texts]
        for ids in own:
            expected.update((k, i) for k, i in enumerate(ids))
        assert sum(r["length"] for r in pieces[doc_id]) == sum(map(len, own))
        if len(texts) == 1:
            at = 0
            for r in sorted(pieces[doc_id], key=lambda r: r["start"]):
                part = own[0][r["start"] : r["start"] + r["length"]]
                assert r["start"] == at and zlib.crc32(struct.pack(f"<{len(part)}I", *part)) == r["ids_crc32"] and r["doc_tokens"] == len(own[0])
                at += r["length"]


def test_round_trip(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    check(pack(docs, PATH).collect(), {r["doc_id"]: [r["text"]] for r in docs.collect()})
    check(pack(docs.repartition(3), PATH, pool=20).collect(), {r["doc_id"]: [r["text"]] for r in docs.collect()})


def test_few_remainders_are_cut(spark):
    """At sf0.1 the method fills the windows: at most 5 % of the remainders' tokens are cut, hardly any is padding."""
    encode = Encoder(PATH)
    texts = [r["text"] for r in spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").collect()]
    assert len(texts) <= POOL
    rest = [(k, 0, cut(k, encode(t) + b"\0\0\0\0", 0, CAPACITY)[1], 0) for k, t in enumerate(texts)]
    rest = [r for r in rest if r[2]]
    size = {r[0]: len(r[2]) for r in rest}
    own = list(windows(rest))
    assert sum(len(p[2]) for w in own for p in w) == sum(size.values())
    torn = {p[0] for w in own for p in w if len(p[2]) < size[p[0]]}
    assert sum(size[k] for k in torn) <= 0.05 * sum(size.values())
    assert sum(CAPACITY - sum(len(p[2]) // 4 for p in w) for w in own) <= 0.001 * sum(size.values()) / 4 + CAPACITY
    rng = random.Random(1)
    assert list(windows(rng.sample(rest, len(rest)))) == own  # whatever their order


def test_awkward(awkward, empty):
    texts = defaultdict(list)
    for r in awkward.collect():
        texts[r["doc_id"]].append(r["text"])
    check(pack(awkward, PATH).collect(), texts)
    assert pack(empty, PATH).collect() == []
