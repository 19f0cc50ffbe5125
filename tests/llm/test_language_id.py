"""Held-out accuracy, and profiles against plain Python counting."""

import random
import zlib
from collections import Counter

from pyspark.sql import functions as F

from loomline.llm import language_id
from tests.llm.conftest import SCHEMA


def plain_grams(text):
    out = Counter()
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    for w in words:
        padded = f" {w} "
        out.update(w)
        out.update(padded[i : i + 2] for i in range(len(padded) - 1))
        out.update(padded[i : i + 3] for i in range(len(padded) - 2))
    return out


def packed(gram):
    p = [1 if c == " " else ord(c) for c in gram] + [0, 0]
    return p[0] << 42 | p[1] << 21 | p[2]


def test_grams():
    texts = ["Ab, cd!", "", None, "...", "x", "É 日本 é", "a-b  c.", "A" * 50]
    for text, (gram, count) in zip(texts, language_id.grams(texts), strict=True):
        assert dict(zip(gram.tolist(), count.tolist(), strict=True)) == {packed(g): n for g, n in plain_grams(text or "").items()}


def test_held_out_accuracy(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet")
    lang = {r["doc_id"]: r["lang"] for r in docs.collect()}
    rows = language_id.identify(docs).collect()
    assert len(rows) == len(lang)
    for r in rows:
        assert r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % 3 == 1) and 0 <= r["score"] <= 1
    held = [r for r in rows if r["held_out"]]
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in held) >= 0.97 * len(held)


def test_brute_force(spark, data):
    docs = spark.read.parquet(f"{data}/documents.parquet").limit(80).cache()
    profiles, rows = {}, docs.collect()
    for r in rows:
        if zlib.crc32(str(r["doc_id"]).encode()) % 3 != 1:
            profiles.setdefault(r["lang"], Counter()).update(plain_grams(r["text"]))
    order = lambda c: sorted(c, key=lambda g: (-c[g], packed(g)))[: language_id.PROFILE]
    ranks = {k: {g: i for i, g in enumerate(order(c))} for k, c in profiles.items()}
    got = {r["doc_id"]: (r["lang_pred"], round(r["score"], 9)) for r in language_id.identify(docs).collect()}
    for r in rows:
        own, far = order(plain_grams(r["text"])), {}
        for k, rank in sorted(ranks.items()):
            far[k] = sum(abs(rank[g] - i) if g in rank else language_id.PROFILE for i, g in enumerate(own))
        best = min(far, key=lambda k: (far[k], k))
        assert got[r["doc_id"]] == (best, round(1 - far[best] / (language_id.PROFILE * len(own)), 9))


def test_awkward(spark, awkward, empty):
    rows = language_id.identify(awkward).collect()
    assert len(rows) == awkward.count()
    und = {r["doc_id"] for r in rows if r["lang_pred"] == "und"}
    assert {1, 2, 3, 5} <= und and all(r["score"] == 0 for r in rows if r["lang_pred"] == "und") and 7 not in und
    assert language_id.identify(empty).collect() == []
    none = spark.createDataFrame([(1, "words here", None, None, 0)], SCHEMA)
    assert [(r["lang_pred"], r["score"]) for r in language_id.identify(none).collect()] == [("und", 0.0)]


def test_the_score_decides(spark, data):
    """Other scripts and letter noise go, short and clean texts stay: no letter filter does that."""
    rng = random.Random(1)
    noise = [" ".join("".join(rng.choice("bcdfghjklmnpqrstvwxyz") for _ in range(rng.randrange(2, 12))) for _ in range(n)) for n in (3, 20, 200)]
    odd = ["Это предложение на другом языке.", "日本語の文章です", "Αυτό είναι ελληνικό", "1234 --", "", None, *noise]
    docs = spark.read.parquet(f"{data}/documents.parquet")
    more = spark.createDataFrame([(10**9 + k, t, "en", "x", 0) for k, t in enumerate(odd)], SCHEMA)
    kept = {r["doc_id"] for r in language_id.accepted(docs.select("doc_id", "text", "lang", "source", F.col("n_chars").cast("long").alias("n_chars")).unionByName(more)).collect()}
    assert kept == {r["doc_id"] for r in docs.collect()}
    nothing = language_id.accepted(more.withColumn("lang", F.lit(None).cast("string"))).collect()
    assert len(nothing) == 6
