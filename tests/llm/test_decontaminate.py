"""Planted copies, edits and clean texts; the aligner against the textbook recurrence."""

import random

import numpy as np

from loomline.llm import decontaminate as D
from tests.llm.conftest import SCHEMA, prose


def textbook(a, b):
    best, h = 0, [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            s = D.MATCH if a[i - 1] == b[j - 1] else D.MISMATCH
            h[i][j] = max(0, h[i - 1][j - 1] + s, h[i - 1][j] + D.GAP, h[i][j - 1] + D.GAP)
            best = max(best, h[i][j])
    return best


def test_alignment():
    rng = np.random.default_rng(1)
    for _ in range(150):
        a, b = rng.integers(0, 5, rng.integers(1, 14)), rng.integers(0, 5, rng.integers(1, 25))
        score, matched, start, end = D.align(a, b)
        assert score == textbook(a, b) and 0 <= matched <= min(len(a), end - start) and score <= D.MATCH * matched


def test_alignment_tells_its_span():
    item, text = np.arange(10), np.concatenate([[50, 51], [0, 1, 2, 99, 4, 5, 6, 8, 9], [60]])
    score, matched, start, end = D.align(item, text)
    assert (matched, start, end) == (8, 2, 11) and score == 8 * D.MATCH + D.MISMATCH + D.GAP


def test_long_texts_take_little_memory():
    """An item that repeats through a text of 400,000 words: the whole table would take 160 MB."""
    import tracemalloc

    item = np.arange(100)
    text = np.tile(np.concatenate([np.arange(50), [999] * 3]), 7600)
    tracemalloc.start()
    D.align(item, text)
    assert tracemalloc.get_traced_memory()[1] < 80 << 20
    tracemalloc.stop()


def test_brute_force(spark):
    """All pairs of 100 texts and 10 items, each aligned over the whole text by the textbook."""
    rng = random.Random(4)
    common = [f"c{k}" for k in range(150)]
    items = [[rng.choice(common) if rng.random() < 0.8 else f"r{rng.randrange(5000)}" for _ in range(rng.randrange(8, 60))] for _ in range(10)]
    texts = []
    for k in range(100):
        words = [rng.choice(common) for _ in range(rng.randrange(20, 90))]
        own = items[k % 10]
        if k % 4 == 1:
            words[10:10] = edited(rng, " ".join(own), rng.choice([0, 0.15, 0.3])).split()
        elif k % 4 == 2:  # a part of an item
            n = rng.randrange(4, len(own) + 1)
            words[5:5] = own[len(own) - n :]
        texts.append(words)
    expected = set()
    for d, words in enumerate(texts):
        for k, item in enumerate(items):
            score = textbook(item, words)
            if score >= D.SIMILARITY * D.MATCH * len(item) or score >= D.PASSAGE:
                expected.add((d, k, score))
    docs = spark.createDataFrame([(d, " ".join(w), None, None, 0) for d, w in enumerate(texts)], SCHEMA)
    got = {(r["doc_id"], r["item_id"], r["score"]) for r in D.find_leaks(docs, spark.createDataFrame([(k, " ".join(w)) for k, w in enumerate(items)], "item_id long, text string")).collect()}
    assert got == expected and len(got) > 30


def edited(rng, text, share):
    out = []
    for w in text.split():
        u = rng.random()
        if u < share / 3:
            continue
        out.append(f"zz{rng.randrange(10**6)}" if u < share else w)
        if rng.random() < share / 3:
            out.append("extra")
    return " ".join(out)


def cases(spark):
    rng = random.Random(6)
    items = [" ".join(f"w{rng.randrange(3000)}" for _ in range(rng.randrange(16, 60))) for _ in range(12)]
    rows, planted = [], set()
    for k, item in enumerate(items):
        for version in (item, item.upper().replace(" ", ", "), edited(rng, item, 0.2)):
            planted.add((len(rows), k))
            rows.append(prose(rng, rng.randrange(300)) + " " + version + " " + prose(rng, rng.randrange(2000)))
    planted |= {(len(rows), 0), (len(rows), 5)}
    rows.append(items[0] + " " + prose(rng, 500) + " " + items[5] + " " + items[0])
    rows += [prose(rng, 400) for _ in range(30)] + [" ".join(item.split()[:4]) + " " + prose(rng, 50) for item in items]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in enumerate(rows)], SCHEMA)
    return docs, spark.createDataFrame(list(enumerate(items)), "item_id long, text string"), planted


def test_planted(spark):
    docs, items, planted = cases(spark)
    rows = D.find_leaks(docs, items).collect()
    assert {(r["doc_id"], r["item_id"]) for r in rows} == planted and len(rows) == len(planted)
    assert all((D.SIMILARITY <= r["similarity"] or r["score"] >= D.PASSAGE) and r["similarity"] <= 1 for r in rows)
    kept = {r["doc_id"] for r in D.drop_leaks(docs, items).collect()}
    assert kept == set(range(docs.count())) - {d for d, _ in planted}


def test_blocks_give_the_same(spark, monkeypatch):
    docs, items, planted = cases(spark)
    monkeypatch.setattr(D, "BLOCK", 1000)
    assert {(r["doc_id"], r["item_id"]) for r in D.find_leaks(docs, items).collect()} == planted


def test_popular_leak(spark):
    rng = random.Random(2)
    item = " ".join(f"u{rng.randrange(10**6)}" for _ in range(30))
    docs = spark.createDataFrame([(i, prose(rng, 60) + " " + item, None, None, 0) for i in range(200)], SCHEMA)
    assert D.find_leaks(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).count() == 200


def test_awkward(spark, awkward, empty):
    items = spark.createDataFrame([(1, "same text twice for all of us"), (1, "same text twice for all of us"), (2, None), (None, "no id at all here"), (3, "two words"), (4, "")], "item_id long, text string")
    rows = D.find_leaks(awkward, items).collect()
    assert sorted((r["doc_id"] or 0, r["item_id"] or 0) for r in rows) == [(0, 0), (8, 1), (8, 1), (8, 1), (8, 1), (9, 1), (9, 1)]
    assert D.drop_leaks(awkward, items).columns == awkward.columns and D.drop_leaks(awkward, items).count() == awkward.count() - 4
    assert D.find_leaks(empty, items).collect() == [] and D.find_leaks(awkward, items.limit(0)).collect() == []
    assert D.drop_leaks(awkward, items.limit(0)).count() == awkward.count()
