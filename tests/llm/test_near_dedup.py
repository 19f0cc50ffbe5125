"""Components against brute force over all pairs that share a shingle."""

import random
import re
from collections import defaultdict
from itertools import combinations

import numpy as np

from loomline.llm import components as stars
from loomline.llm import near_dedup
from loomline.llm.components import components
from loomline.llm.near_dedup import near_duplicates
from tests.llm.conftest import SCHEMA, prose


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def brute(rows):
    sets = {d: shingles(t) for d, t in rows}
    up = {d: d for d in sets}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    holders = defaultdict(set)
    for d, s in sets.items():
        for g in s:
            holders[g].add(d)
    for a, b in {p for h in holders.values() for p in combinations(sorted(h), 2)}:
        both = len(sets[a] & sets[b])
        if 100 * both >= 75 * (len(sets[a]) + len(sets[b]) - both):
            x, y = find(a), find(b)
            up[max(x, y)] = min(x, y)
    return {d: (len(sets[d]), find(d)) for d in sets}


def corpus():
    """Chains, a group whose copies differ as much as the threshold, groups sharing a passage, short texts."""
    rng = random.Random(4)
    rows = []
    base = prose(rng, 120).split()
    for _ in range(90):  # copies with 0 to 8 words replaced: many are linked by others only
        own = list(base)
        for i in rng.sample(range(len(own)), rng.randrange(9)):
            own[i] = f"x{rng.randrange(10**6)}"
        rows.append(" ".join(own))
    chain = prose(rng, 100).split()
    for k in range(12):
        rows.append(" ".join(chain[6 * k :] + prose(rng, 1).split() * 0 + [f"t{k}_{i}" for i in range(6 * k)][: 6 * k]))
    passage = prose(rng, 80)
    rows += [passage + " " + prose(rng, rng.randrange(20, 120)) for _ in range(30)]
    rows += [prose(rng, n) for n in (1, 2, 3, 4, 5, 6) for _ in range(3)] + ["Same Four Words Here", "same four words here", "same four words"]
    rows += [prose(rng, 40)] * 5
    order = list(range(len(rows)))
    rng.shuffle(order)
    return [(i, rows[k]) for i, k in enumerate(order)]


def test_brute_force(spark):
    rows = corpus()
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], SCHEMA)
    got = {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df).collect()}
    assert got == brute(rows)


def test_rows_of_one_id_are_one_document(spark):
    a, b, c = ("a b c d e f g", "h i j k l m n", "o p q r s t u")
    rows = [(3, a), (7, a), (7, b), (9, b), (11, c), (12, ""), (12, c), (20, None), (None, b), (None, "v w x y z")]
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], SCHEMA)
    got = sorted(((r["doc_id"] or 0), r["n_shingles"], r["component_id"], r["kept"]) for r in near_duplicates(df).collect() if r["n_shingles"] != 1 or r["doc_id"])
    assert got == [(0, 3, 3, False), (3, 3, 3, True), (7, 3, 3, False), (7, 3, 3, False), (9, 3, 3, False), (11, 3, 11, True), (12, 0, 11, False), (12, 3, 11, False), (20, 0, 20, True)]


def test_blocks_in_rounds(spark, monkeypatch):
    """Blocks of two members, so that buckets take several rounds: the same components."""
    from loomline.llm import near_dedup

    rows = corpus()
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in rows], SCHEMA)
    monkeypatch.setattr(near_dedup, "BLOCK", 2)
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in near_duplicates(df, bands=60, rows=2).collect()} == brute(rows)


def test_kept(spark):
    df = spark.createDataFrame([(d, t, None, None, 0) for d, t in corpus()], SCHEMA)
    rows = near_duplicates(df).collect()
    assert all(r["kept"] == (r["doc_id"] == r["component_id"]) for r in rows)
    assert len({r["component_id"] for r in rows}) == sum(r["kept"] for r in rows)


def test_awkward(spark, awkward, empty):
    rows = near_duplicates(awkward).collect()
    assert len(rows) == awkward.count()
    got = {(r["doc_id"], r["n_shingles"], r["component_id"], r["kept"]) for r in rows}
    assert {(1, 0, 1, True), (2, 0, 2, True), (3, 0, 3, True), (4, 1, 4, True), (None, 1, None, True), (8, 3, 8, True), (9, 3, 8, False)} <= got
    assert near_duplicates(empty).collect() == []


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(int(a), int(b)) for a, b in rng.integers(0, 300, (250, 2))] + [(k, k + 1) for k in range(1000, 1040)] + [(2000, k) for k in range(2001, 2100)]
    up = {}

    def find(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    for a, b in edges:
        x, y = find(a), find(b)
        up[max(x, y)] = min(x, y)
    got = {r["node"]: r["component"] for r in components(spark.createDataFrame(edges, "u long, v long")).collect()}
    linked = {x for a, b in edges if a != b for x in (a, b)}
    assert got == {x: find(x) for x in linked}
    assert components(spark.createDataFrame([], "u long, v long")).collect() == []


def test_components_in_rounds(spark, monkeypatch):
    """Links beyond those that one task takes: the same components by stars."""
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(101, 130)] + [(7, 7), (129, 500), (500, 129)]
    links = spark.createDataFrame(edges, "u long, v long")
    alone = sorted(map(tuple, components(links).collect()))
    monkeypatch.setattr(stars, "FEW", 0)
    assert alone == sorted(map(tuple, components(links).collect())) == [(k, 0) for k in range(41)] + [(k, 100) for k in [*range(100, 130), 500]]
    assert components(links.limit(0)).collect() == []


def test_overlaps():
    """Sizes of intersections, by columns of matrices and by single pairs alike."""
    rng = np.random.default_rng(3)
    for nx, ny, most, values in ((60, 50, 100, 300), (50, 60, 40, 20_000), (2, 3, 500, 600), (3, 0, 5, 9)):
        x, y = ([np.unique(rng.integers(0, values, rng.integers(0, most))) for _ in range(n)] for n in (nx, ny))
        flat = [(np.concatenate([np.zeros(0, np.int64), *s]), np.concatenate([[0], np.cumsum([len(v) for v in s])]).astype(np.int64)) for s in (x, y)]
        assert near_dedup.overlaps(*flat[0], *flat[1]).tolist() == [[len(np.intersect1d(a, b)) for b in y] for a in x]


def test_wide_bucket(spark):
    """A bucket of texts that share a passage goes in parts through Arrow, set by set in blocks."""
    rng = np.random.default_rng(5)
    n = 1200
    sets = [(k, [1], sorted({*range(70), *(int(v) for v in rng.integers(1000, 10**9, 30))})) for k in range(n)]
    sets += [(n + k, [1], [*s[:-1], -1]) for k, (_, _, s) in enumerate(sets[:50])]
    rows = spark.createDataFrame([(1, k, k, 0, 5, 2) for k, _, _ in sets], "bucket long, node long, component long, anchor long, blocks int, parts long")
    found = near_dedup._across(rows, spark.createDataFrame(sets, "node long, bands array<long>, shingles array<long>"), 0, 5, 75)
    assert "MapInArrow" in found._jdf.queryExecution().toString() and "array_intersect" not in found._jdf.queryExecution().toString()
    assert {tuple(r) for r in found.collect()} == {(k, n + k) for k in range(50)}
