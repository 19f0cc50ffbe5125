"""Models and scores against counting in plain Python."""

import math
import re
from collections import Counter

from loomline.llm import lm_score
from tests.llm.conftest import SCHEMA

LOWER = {k: k + 32 for k in range(65, 91)}


def plain(rows, good):
    """Scores by the definition, words as strings."""
    tokens = {d: re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(LOWER)) for d, t in rows}
    counts = []
    for docs in (good, tokens):
        words, two, before = Counter(), Counter(), Counter()
        for d in docs:
            pairs = list(zip(["<s>", *tokens[d]], tokens[d], strict=False))
            words.update(tokens[d])
            two.update(pairs)
            before.update(a for a, _ in pairs)
        counts.append((words, two, before))
    corpus, n, n_target = counts[1][0], sum(counts[1][0].values()), sum(counts[0][0].values())
    scale = n_target / n if n_target else 1
    losses = []
    for (words, two, before), s, total in zip(counts, (1, scale), (n_target, n * scale), strict=True):

        def loss(a, b, words=words, two=two, before=before, s=s, total=total):
            p = (s * words[b] + lm_score.KAPPA * corpus[b] / n) / (total + lm_score.KAPPA)
            return -math.log((s * two[a, b] + lm_score.MU * p) / (s * before[a] + lm_score.MU))

        losses.append({d: sum(loss(a, b) for a, b in zip(["<s>", *ws], ws, strict=False)) / len(ws) if ws else None for d, ws in tokens.items()})
    return losses


def test_brute_force(spark, data):
    """Every text, and chunks and buckets of any size: no word or bigram is left out."""
    docs = spark.read.parquet(f"{data}/documents.parquet")
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    for good in ([d for d, _ in rows[::2]], []):
        labels = spark.createDataFrame([(d, 1, 0) for d in good], "doc_id long, quality int, toxic int")
        target, background = plain(rows, good)
        for sizes in ({}, {"chunk": 500, "bucket": 100}):
            got = lm_score.score(docs, labels, **sizes).collect()
            assert sorted(r["doc_id"] for r in got) == sorted(target)
            for r in got:
                if target[r["doc_id"]] is None:
                    assert r["difference"] is None
                    continue
                assert math.isclose(r["target_loss"], target[r["doc_id"]], rel_tol=1e-6) and math.isclose(r["background_loss"], background[r["doc_id"]], rel_tol=1e-6)
                assert math.isclose(r["difference"], r["target_loss"] - r["background_loss"], abs_tol=1e-9)


def test_probabilities_sum_to_one():
    """Over the words that can follow one word, in either model."""
    texts = ["a b a c", "b c", "a a d"]
    tokens = [t.split() for t in texts]
    words = Counter(w for t in tokens for w in t)
    two = Counter(p for t in tokens for p in zip(["<s>", *t], t, strict=False))
    n = sum(words.values())
    for s, total in ((1, n), (0.3, 0.3 * n)):
        before = sum(c for (a, _), c in two.items() if a == "a") * s
        p = {w: (s * words[w] + lm_score.KAPPA * words[w] / n) / (total + lm_score.KAPPA) for w in words}
        assert math.isclose(sum((s * two["a", w] + lm_score.MU * p[w]) / (before + lm_score.MU) for w in words), 1)


def test_told_apart(spark, data):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    rows = lm_score.score(docs, labels).join(labels, "doc_id").collect()
    mean = lambda q: (lambda x: sum(x) / len(x))([r["difference"] for r in rows if r["quality"] == q])
    assert mean(1) < mean(0) - 0.5


def test_shuffled_ids_give_the_same(spark, data, monkeypatch):
    docs, labels = (spark.read.parquet(f"{data}/{t}.parquet") for t in ("documents", "labels"))
    key = lambda df: sorted((r["doc_id"], round(r["difference"] or 0, 9)) for r in df.collect())
    a = key(lm_score.score(docs, labels, chunk=2000))
    monkeypatch.setattr(lm_score, "BROADCAST_IDS", 1)
    assert key(lm_score.score(docs.repartition(3), labels)) == a


def test_awkward(spark, awkward, empty, labels):
    rows = lm_score.score(awkward, labels).collect()
    assert len(rows) == awkward.count()
    got = {r["doc_id"]: r for r in rows}
    assert got[1]["n_tokens"] == 0 and got[3]["difference"] is None and got[7]["n_tokens"] == 60_000
    assert lm_score.score(empty, labels).collect() == []
    none = lm_score.score(awkward, labels.limit(0)).collect()
    assert len(none) == awkward.count()
    assert lm_score.score(spark.createDataFrame([(1, None, None, None, 0)], SCHEMA), labels).first()["n_tokens"] == 0
